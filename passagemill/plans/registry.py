"""Named strategies: parsers, chunkers, retrievers. Users add their own with ``register``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from passagemill.operators import chunk, keyword, retrieve, structure


class Registry:
    def __init__(self, what: str):
        self.what = what
        self._known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, make: Callable[..., DataFrame]) -> None:
        self._known[name] = make

    def get(self, name: str) -> Callable[..., DataFrame]:
        if name not in self._known:
            raise ValueError(f"unknown {self.what}: {name!r} (supported: {', '.join(sorted(self._known))})")
        return self._known[name]

    def run(self, name: str, *tables: DataFrame, config: dict | None) -> DataFrame:
        if config is None:
            raise ValueError(f"{self.what} config is required")
        return self.get(name)(*tables, **config)


PARSERS = Registry("parser")
PARSERS.register("markdown", structure.parse_markdown)
PARSERS.register("plain", structure.parse_plain)

CHUNKERS = Registry("chunker")
CHUNKERS.register("fixed", chunk.fixed_chunks)
CHUNKERS.register("recursive", chunk.recursive_chunks)

RETRIEVERS = Registry("retrieval strategy")
RETRIEVERS.register("naive-search", retrieve.top_k)
RETRIEVERS.register("mmr-rerank", retrieve.mmr_search)
RETRIEVERS.register("hybrid", keyword.hybrid_search)
