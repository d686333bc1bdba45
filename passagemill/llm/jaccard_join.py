"""Near duplicates by the Jaccard similarity of word shingles, with a vertically cut n-gram order."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm import shingles
from passagemill.llm.components import components
from passagemill.llm.rows import packed
from passagemill.session import cut_lineage

PERCENT = 75
CHARS_PER_FRAGMENT = 6_000_000
LEAST_FRAGMENTS = 64
FLUSH = 400_000
RANGES = 4


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, null_id, text`` without nulls."""
    return packed(docs).select(
        F.coalesce(F.col("row.doc_id"), F.lit(0)).cast("long").alias("doc_id"),
        F.col("row.doc_id").isNull().alias("null_id"),
        F.coalesce(F.col("row.text"), F.lit("")).alias("text"),
    )


_SEGMENT = "fragment int, batch string, keys binary, owners binary, ids binary, nulls binary, digests binary, sizes binary"


def _segments(texts: DataFrame, n_fragments: int) -> DataFrame:
    """All shingle sets, cut at ``n_fragments`` ranges of the key: per range and run of documents one packed row.

    ``owners`` says which document of the run a key is from; ids, digests and sizes of the run's documents
    ride with its first range.
    """

    def rows(batch_docs, batch_keys):
        sizes = np.array([len(k) for k in batch_keys], dtype=np.int64)
        every = np.concatenate(batch_keys) >> np.uint64(16)
        owners = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        order = np.argsort(every, kind="stable")
        every, owners = every[order], owners[order]
        owners = owners.astype(np.uint16) if len(sizes) <= 65_536 else owners
        edges = [(f << 48) // n_fragments for f in range(n_fragments + 1)]
        cuts = np.searchsorted(every, np.array(edges, dtype=np.uint64))
        digests = b"".join(d[2] for d in batch_docs)
        ids = np.array([d[0] for d in batch_docs], dtype=np.int64).tobytes()
        nulls = np.array([d[1] for d in batch_docs], dtype=np.uint8).tobytes()
        batch = hashlib.md5(digests + ids + nulls).hexdigest()
        for f in range(n_fragments):
            a, b = cuts[f], cuts[f + 1]
            if a == b and f:
                continue
            facts = (ids, nulls, digests, sizes.tobytes()) if f == 0 else (None,) * 4
            yield (f, batch, shingles.pack_sorted(every[a:b]), owners[a:b].tobytes(), *facts)

    def run(batches):
        columns = [c.split()[0] for c in _SEGMENT.split(", ")]
        waiting, sets, size = [], [], 0
        for batch in batches:
            for doc_id, null_id, text in zip(batch["doc_id"], batch["null_id"], batch["text"]):
                found = shingles.words(text)
                sets.append(shingles.keys(found))
                waiting.append((doc_id, null_id, shingles.digest(found)))
                size += len(sets[-1])
                if size >= FLUSH or len(waiting) == 65_536:
                    yield pd.DataFrame(list(rows(waiting, sets)), columns=columns)
                    waiting, sets, size = [], [], 0
        if waiting:
            yield pd.DataFrame(list(rows(waiting, sets)), columns=columns)

    return texts.mapInPandas(run, _SEGMENT)


def _lonely(group: pd.DataFrame) -> pd.DataFrame:
    """Per run of documents, how many of each one's keys in this range no other document has."""
    keys = [shingles.unpack_sorted(k) for k in group["keys"]]
    _, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    alone = times[place] == 1
    out, at = [], 0
    for own, owners in zip(keys, group["owners"]):
        width = np.uint16 if len(owners) == 2 * len(own) else np.uint32
        out.append(np.bincount(np.frombuffer(owners, dtype=width)[alone[at : at + len(own)]]).astype(np.int32).tobytes())
        at += len(own)
    return group.drop(columns=["fragment", "keys", "owners"]).assign(alone=out)


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """The facts of one run's documents with their lonely keys summed over all ranges.

    Runs of equal documents share a name; none of their keys is lonely, and each keeps its rows.
    """
    runs = group[group["ids"].notna()]
    facts = runs.iloc[0]
    ids = np.frombuffer(facts["ids"], dtype=np.int64)
    total = np.zeros(len(ids), dtype=np.int64)
    for counts in group["alone"]:
        part = np.frombuffer(counts, dtype=np.int32)
        total[: len(part)] += part
    names = [facts["digests"][16 * i : 16 * i + 16].hex() for i in range(len(ids))]
    frame = pd.DataFrame(
        {"doc_id": ids, "digest": names, "n_shingles": np.frombuffer(facts["sizes"], dtype=np.int64), "alone": total}
    )
    frame["doc_id"] = frame["doc_id"].astype("Int64").mask(np.frombuffer(facts["nulls"], dtype=np.uint8) == 1)
    return pd.concat([frame] * len(runs))


def shingle_facts(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n_shingles, alone`` of every row; ``alone`` counts keys that no other row has."""
    texts = _texts(docs)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n_fragments = max(LEAST_FRAGMENTS, -(-chars // CHARS_PER_FRAGMENT))
    passed = "batch string, ids binary, nulls binary, digests binary, sizes binary, alone binary"
    counted = _segments(texts, n_fragments).groupBy("fragment").applyInPandas(_lonely, passed)
    facts = counted.groupBy("batch").applyInPandas(_summed, "doc_id long, digest string, n_shingles long, alone long")
    return cut_lineage(facts)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, keys`` of the documents in ``nodes``."""

    def run(batches):
        for batch in batches:
            found = [shingles.keys(shingles.words(t)).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"node": batch["doc_id"], "keys": found})

    chosen = _texts(docs).filter(~F.col("null_id")).select("doc_id", "text")
    chosen = chosen.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = chosen.mapInPandas(run, "node long, keys array<long>")
    return sets.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))


def _ordered(sets: DataFrame) -> DataFrame:
    """``node, n, shared``: keys that at least two documents have, in the global order (frequency class, key).

    Rare keys come first. A key's class is the whole part of its frequency's binary logarithm.
    """
    rows = sets.select("node", F.explode("keys").alias("key"))
    classes = rows.groupBy("key").count().filter("count > 1")
    classes = classes.select("key", F.floor(F.log2("count")).cast("int").alias("class"))
    shared = rows.join(classes, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("class", "key"))).alias("shared"))
    return sets.select("node", F.size("keys").alias("n")).join(shared, "node")


def _prefixes(ordered: DataFrame, percent: int) -> DataFrame:
    """``key, node, n, pos``: the rarest keys, one of which every pair similar enough must have in common."""
    n, m = F.col("n"), F.size("shared")
    length = n - F.ceil(percent * n / 100) + 1
    kept = F.slice("shared", F.lit(1), F.greatest(length - (n - m), F.lit(0)).cast("int"))
    listed = ordered.select("node", "n", (n - m).alias("before"), F.posexplode(kept).alias("i", "s"))
    return listed.select("s.key", "node", "n", (F.col("before") + F.col("i")).alias("pos"))


def _may_link(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, percent: int) -> Column:
    """Whether sizes and the places of a common key leave room for enough overlap."""
    room = 1 + F.least(n_a - pos_a - 1, n_b - pos_b - 1)
    sizes = (100 * F.least(n_a, n_b)) >= percent * F.greatest(n_a, n_b)
    return sizes & (room * (100 + percent) >= percent * (n_a + n_b))


def _linked(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that reach the similarity.

    The global order is cut into fragments (frequency class, range of the key). Overlaps are counted
    fragment by fragment and summed per pair, so no document travels in one piece.
    """
    place = F.struct(
        F.col("s.class").alias("class"), F.floor(F.col("s.key") / (2.0**64 / RANGES)).cast("int").alias("range")
    )
    cut = (
        ordered.select("node", "n", F.explode("shared").alias("s"))
        .groupBy("node", "n", place.alias("fragment"))
        .agg(F.collect_list("s.key").alias("segment"))
    )
    left = cut.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("segment").alias("of_a"))
    right = cut.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("segment").alias("of_b"))
    counted = pairs.join(left, "a").join(right, ["b", "fragment"])
    overlap = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum(F.size(F.array_intersect("of_a", "of_b"))).alias("common"))
    return overlap.filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _leaders(prefixes: DataFrame, percent: int) -> DataFrame:
    """One pair per document: with the smallest document of its keys' groups, the one met most often."""
    first = prefixes.groupBy("key").agg(F.min(F.struct("node", "n", "pos")).alias("first"), F.count(F.lit(1)).alias("c"))
    met = prefixes.join(first.filter("c > 1"), "key").filter(F.col("node") != F.col("first.node"))
    met = met.filter(_may_link(F.col("n"), F.col("pos"), F.col("first.n"), F.col("first.pos"), percent))
    votes = met.groupBy("node", F.col("first.node").alias("leader")).count()
    best = votes.groupBy("node").agg(F.max(F.struct("count", (-F.col("leader")).alias("against"))).alias("top"))
    return best.select(F.col("node").alias("b"), (-F.col("top.against")).alias("a"))


def _across(prefixes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``x, y, keys``: documents in different components that share prefix keys and may link.

    In each key's group the largest component is not paired within itself: documents ``x`` of the others
    are paired with the whole group, so a group that has become one component costs nothing.
    """
    placed = prefixes.join(labels, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    parts = placed.groupBy("key", "part").count()
    largest = parts.groupBy("key").agg(F.max(F.struct("count", "part")).alias("top"), F.count(F.lit(1)).alias("parts"))
    open_keys = cut_lineage(largest.filter("parts > 1").select("key", F.col("top.part").alias("main")))
    rows = cut_lineage(placed.join(open_keys, "key"))
    one = rows.filter("part <> main").select("key", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "pos", "part")])
    other = rows.select("key", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "pos", "part")])
    fits = _may_link(F.col("n_x"), F.col("pos_x"), F.col("n_y"), F.col("pos_y"), percent)
    met = one.join(other, "key").filter((F.col("part_x") != F.col("part_y")) & fits)
    return met.groupBy(F.col("node_x").alias("x"), F.col("node_y").alias("y")).agg(F.count(F.lit(1)).alias("keys"))


def _nearest_across(met: DataFrame) -> DataFrame:
    """For each ``x`` the one ``y`` with which it shares most prefix keys."""
    top = met.groupBy("x").agg(F.max(F.struct("keys", (-F.col("y")).alias("against"))).alias("top"))
    return top.select(F.col("x").alias("a"), (-F.col("top.against")).alias("b"))


def _either_way(met: DataFrame) -> DataFrame:
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    A document's set is its distinct five-word shingles (fewer words: the whole sequence; none: empty and
    unlinked). Two documents link when their sets' overlap is ``percent`` of their union or more; a
    component is what links reach, named by its smallest doc_id. Nothing is approximated: keys are 64-bit
    hashes of shingles.

    1. Texts of equal words are one class, represented by the smallest doc_id.
    2. All sets are cut by key range; a range counts which keys only one row has, and the counts are
       summed per document. With more than 1 - ``percent`` of its keys its own, a document has no link.
    3. The keys of the others get a global order, rare ones first. Documents are tried against the
       leader they share most prefix keys with; then against the nearest one of another component; then
       against all of other components with which they share any prefix key and may reach the
       similarity. Overlaps are counted per fragment of the order and summed per pair. Documents of
       one component need no further pair.

    Rows with a null doc_id have their n_shingles and no component; they link to nothing. Rows that share a
    doc_id are one document with all of their shingles. An empty table gives no rows; other columns are not read. The keys
    of a long text are cut by range as all others are. Open: the count of lonely keys has all entries of a key in one
    task, and documents of one key's group that are in different components are paired, so a passage in very many
    documents that are no near duplicates costs the square of their number.
    """
    facts = shingle_facts(docs)
    named = facts.filter("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(
        named.groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.sum("n_shingles").alias("total"), F.sum("alone").alias("alone")
        )
    )
    maybe = classes.filter(100 * F.col("alone") <= (100 - percent) * F.col("total")).select("node").distinct()
    sets = cut_lineage(_sets(docs, cut_lineage(maybe)))
    ordered = cut_lineage(_ordered(sets))
    prefixes = cut_lineage(_prefixes(ordered, percent))
    links = cut_lineage(_linked(_leaders(prefixes, percent), ordered, percent))
    met = cut_lineage(_across(prefixes, cut_lineage(components(links)), percent))
    links = links.unionByName(cut_lineage(_linked(_nearest_across(met), ordered, percent)))
    met = cut_lineage(_across(prefixes, cut_lineage(components(links)), percent))
    more = cut_lineage(_linked(_either_way(met), ordered, percent))
    # A row's doc_id and its class's smallest one are the same document's names.
    same = named.join(classes, "digest").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    final = components(links.unionByName(more).unionByName(same.distinct()))
    out = facts.join(final, facts["doc_id"] == final["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its component; rows with a null doc_id stay."""
    found = near_duplicates(docs, percent)
    gone = cut_lineage(found.filter("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti")
