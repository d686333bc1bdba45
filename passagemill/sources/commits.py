"""The commit table of a collection: which versions readers see, and which batches have been written.

A version is claimed before it is written and committed afterwards, one small JSON file each. Claiming
creates the file exclusively, so two writers never get the same number, and the highest claim is never
removed, so no number is given twice. A fold is a commit that names the versions it holds; of these
only the fold is read. It also remembers the batches that were written, so a batch that is replayed
after its version has been folded is known.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

SCHEMA = (
    "kind string, version long, writer string, batch long, folds array<long>, "
    "written map<string, array<struct<first:long,last:long>>>"
)


@dataclass
class Commits:
    """The table at one moment."""

    claims: dict[int, tuple[str | None, int | None]] = field(default_factory=dict)
    done: set[int] = field(default_factory=set)
    folded: set[int] = field(default_factory=set)
    written: dict[str, list[tuple[int, int]]] = field(default_factory=dict)

    @property
    def live(self) -> list[int]:
        """Versions that readers resolve points from."""
        return sorted(self.done - self.folded)

    def has(self, writer: str, batch: int) -> bool:
        return any(first <= batch <= last for first, last in self.written.get(writer, []))

    def open_claim(self, writer: str, batch: int) -> int | None:
        """The version that a batch claimed and has not committed: it writes there again."""
        found = [v for v, owner in self.claims.items() if owner == (writer, batch) and v not in self.done]
        return max(found, default=None)


class CommitTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self) -> Commits:
        out = Commits()
        if not self._names():
            return out
        batches: dict[str, set[tuple[int, int]]] = {}
        for row in self.spark.read.schema(SCHEMA).json(self.folder).filter("version is not null").collect():
            if row.kind == "claim":
                out.claims[row.version] = (row.writer, row.batch)
                continue
            out.done.add(row.version)
            out.folded.update(row.folds or [])
            if row.writer is not None:
                batches.setdefault(row.writer, set()).add((row.batch, row.batch))
            for writer, spans in (row.written or {}).items():
                batches.setdefault(writer, set()).update((s.first, s.last) for s in spans)
        out.written = {writer: _joined(spans) for writer, spans in batches.items()}
        return out

    def claim(self, writer: str | None = None, batch: int | None = None) -> int:
        """A version above all that were ever claimed."""
        while True:
            version = max((int(n.split("-")[1].split(".")[0]) for n in self._names()), default=-1) + 1
            if self._create("claim", {"version": version, "writer": writer, "batch": batch}):
                return version

    def commit(self, version: int, writer: str | None = None, batch: int | None = None, folds: Iterable[int] = (), written: dict | None = None) -> None:
        spans = {w: [{"first": a, "last": b} for a, b in found] for w, found in (written or {}).items()}
        self._create("done", {"version": version, "writer": writer, "batch": batch, "folds": sorted(folds), "written": spans})

    def forget(self, versions: Iterable[int]) -> None:
        """Drop the records of folded versions; the fold's claim lies above them."""
        fs, _ = self._path("")
        for version in versions:
            for kind in ("claim", "done"):
                fs.delete(self._path(f"{kind}-{version:012d}.json")[1], False)

    def _path(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _names(self) -> list[str]:
        fs, target = self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
        return [n for n in names if n.startswith(("claim-", "done-"))]

    def _create(self, kind: str, record: dict) -> bool:
        """Whether the file is new."""
        fs, target = self._path(f"{kind}-{record['version']:012d}.json")
        if fs.exists(target):
            return False
        try:
            out = fs.create(target, False)
        except Exception as error:  # noqa: BLE001
            if "already exists" in str(error) or "AlreadyExists" in str(error):
                return False
            raise
        out.write(json.dumps({"kind": kind, **record}).encode())
        out.close()
        return True


def _joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and neighbouring spans as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out
