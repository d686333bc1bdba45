"""Writers and readers of the engine's own tables (parquet folders).

Layout follows the read paths: results and metrics by run, points by collection,
clean corpora by artifact type and tag, so reads and deletes touch one folder.
Rewrites replace whole partitions (dynamic overwrite), which makes a repeated
job idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.operators import vector_table as vt
from passagemill.schemas import JUDGMENT
from passagemill.sources.commits import CommitTable

RESULT_JSON = {
    "expected_paths": T.ArrayType(T.StringType()),
    "retrieved_paths": T.ArrayType(T.StringType()),
    "relevance": T.ArrayType(JUDGMENT),
    # JSON object keys are text; decode_results turns them back into k
    "hit": T.MapType(T.StringType(), T.BooleanType()),
}
RESULT_COLUMNS = (
    "run_id", "question_id", "question", "category", "difficulty", "expected_answer", "answer",
    "ndcg_graded", "expected_paths", "retrieved_paths", "relevance", "hit", "rank_first",
    "prompt_tokens", "completion_tokens", "latency_ms", "answer_score", "created_at",
)


def _overwrite(df: DataFrame, path: str, *partitions: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def _folder(spark: SparkSession, path: str, **values: str) -> str:
    """A partition's folder, with its values escaped as the writer escapes them."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return "/".join([path, *[f"{name}={escape(value)}" for name, value in values.items()]])


def _read_partitioned(spark: SparkSession, path: str, *strings: str) -> DataFrame:
    """A table whose partition columns ``strings`` stay text, so that 007 and 7 are two values."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name in strings else f.dataType) for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def write_clean_corpus(docs: DataFrame, path: str, tag: str, kind: str = "preprocessing") -> None:
    """Cleaned documents under ``artifact/tag/section``; the section is the first folder of the path."""
    section = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(F.lit("_root"))
    folder = _folder(docs.sparkSession, path, artifact=kind, tag=tag)
    # The whole tag is replaced: sections that are gone from the corpus go from the table.
    docs.withColumn("section", section).write.mode("overwrite").partitionBy("section").parquet(folder)


def read_clean_corpus(spark: SparkSession, path: str, tag: str, kind: str = "preprocessing") -> DataFrame:
    return (
        _read_partitioned(spark, path, "artifact", "tag", "section")
        .filter((F.col("artifact") == kind) & (F.col("tag") == tag))
        .drop("artifact", "tag", "section")
    )


def delete_artifact(spark: SparkSession, path: str, tag: str, kind: str = "preprocessing") -> None:
    """Drop one artifact's folder (file-system delete, nothing is rewritten)."""
    _delete_folder(spark, _folder(spark, path, artifact=kind, tag=tag))


#: A document's chunks repeat overlaps and headings, which a wide window finds again: a quarter of the space.
_POINTS = {"compression": "zstd"}
#: Columns of the stored points besides the points' own.
INTERNAL = ("version", "gone")


def _commits(spark: SparkSession, path: str, collection: str) -> CommitTable:
    return CommitTable(spark, _folder(spark, f"{path.rstrip('/')}/_commits", collection=collection))


def write_points(
    points: DataFrame,
    path: str,
    collection: str,
    seq: int | None = None,
    declared_size: int | None = None,
    replaces: DataFrame | None = None,
    writer: str | None = None,
    removed: DataFrame | None = None,
    unique: bool = False,
) -> int | None:
    """Upsert points into a collection and return the version written, None for a batch that was written before.

    An upsert appends: only the incoming rows are written, into a version above all that were ever claimed, and
    readers keep the highest version per point. It shows once it is committed, so a failed write leaves nothing. With
    ``seq``, the number of a batch of ``writer``, a batch that has been committed is not written again, not even after
    compaction; one that failed on the way writes to its own version again. Vectors of another size than declared fail the write.
    All points that lower versions have of the documents in ``replaces`` (``document_path``) go, whether
    or not the document has points now; so do the points in ``removed`` (``point_id``). Rows that mark them are written with the version.
    ``unique`` says that no two of the points share an id: they are written where they are made.
    """
    spark = points.sparkSession
    log = _commits(spark, path, collection)
    writer = None if seq is None else writer or ""
    version = None
    if seq is not None:
        known = log.read()
        if known.has(writer, seq):
            return None
        version = known.open_claim(writer, seq)
    if version is None:
        version = log.claim(writer, seq)
    incoming = points.filter("point_id is not null")
    if not unique:
        incoming = vt.latest(incoming, "point_id", F.col("chunk_id"))
    if declared_size is not None:
        # Checked as the rows are written: the plan runs once.
        wrong = F.raise_error(F.lit(_WRONG_SIZE))
        incoming = incoming.withColumn("vector", F.when(F.size("vector") == declared_size, F.col("vector")).otherwise(wrong))
    incoming = incoming.withColumn("gone", F.lit(False))
    for marks, key in ((replaces, "document_path"), (removed, "point_id")):
        if marks is not None:
            incoming = incoming.unionByName(marks.select(key).distinct().withColumn("gone", F.lit(True)), allowMissingColumns=True)
    stored = incoming.withColumn("version", F.lit(version).cast("bigint"))
    try:
        stored.write.options(**_POINTS).mode("overwrite").parquet(_folder(spark, path, collection=collection, seq=str(version)))
    except Exception as error:
        if _WRONG_SIZE in str(error):
            raise ValueError(f"collection {collection}: vector size differs from {declared_size}") from error
        raise
    log.commit(version, writer, seq)
    return version


_WRONG_SIZE = "vector of a size that the collection does not have"


def _stored(spark: SparkSession, path: str, collection: str, versions: list[int]) -> DataFrame:
    folders = [_folder(spark, path, collection=collection, seq=str(v)) for v in versions]
    return spark.read.option("mergeSchema", "true").parquet(*folders)


def _resolved(stored: DataFrame) -> DataFrame:
    """The newest row of every point that neither a later mark of it nor one of its document takes away.

    It is found by ids and versions alone, so texts and vectors move once at most. A version has one row of a point,
    and perhaps one that marks it.
    """
    key = ["point_id", "version", "gone"]
    points = stored.filter("point_id is not null")
    newest = points.select(*key, *[c for c in stored.columns if c == "document_path"])
    if "document_path" in stored.columns:
        marks = stored.filter("point_id is null").groupBy("document_path").agg(F.max("version").alias("_since"))
        newest = newest.join(marks, "document_path", "left").filter("gone or _since is null or version >= _since")
    newest = vt.latest(newest.select(key), "point_id", F.desc("version"), F.desc("gone"))
    return points.join(newest, key, "left_semi")


def read_points(spark: SparkSession, path: str, collection: str, with_version: bool = False) -> DataFrame | None:
    """Current points of a collection, None if nothing was committed to it; ``with_version`` adds ``version``.

    Versions are taken from the commit table. A collection with a single version needs no look at
    other versions, so it is a plain scan.
    """
    live = _commits(spark, path, collection).read().live
    if not live:
        return None
    stored = _stored(spark, path, collection, live)
    points = _resolved(stored) if len(live) > 1 else stored.filter("point_id is not null")
    return points.filter("not gone").drop(*[c for c in INTERNAL if c != "version" or not with_version])


def compact_points(spark: SparkSession, path: str, collection: str) -> None:
    """Fold the committed versions of a collection into one and drop them.

    Points keep the version they were written with and marks stay, so a batch that was claimed before and is committed
    after the fold takes its place in the order. Batches that were folded are remembered: replayed, they change
    nothing. A crash at any point leaves the same points: before the commit the fold is not read, after it the others are not.
    """
    log = _commits(spark, path, collection)
    known = log.read()
    live = known.live
    if len(live) >= 2:
        stored = _stored(spark, path, collection, live)
        kept = _resolved(stored)
        if "document_path" in stored.columns:
            last = stored.filter("point_id is null").groupBy("document_path").agg(F.max("version").alias("version"))
            kept = kept.unionByName(last.withColumn("gone", F.lit(True)), allowMissingColumns=True)
        version = log.claim()
        kept.write.options(**_POINTS).mode("overwrite").parquet(_folder(spark, path, collection=collection, seq=str(version)))
        log.commit(version, folds=known.done, written=known.written)
    known = log.read()
    folded = known.folded & known.done
    for version in folded:
        folder = _folder(spark, path, collection=collection, seq=str(version))
        if _exists(spark, folder):
            _delete_folder(spark, folder)
    log.forget(folded)


def delete_collection(spark: SparkSession, path: str, collection: str) -> None:
    """Points and commits; a collection of that name starts anew."""
    _delete_folder(spark, _folder(spark, path, collection=collection))
    _delete_folder(spark, _commits(spark, path, collection).folder)


def new_run(spark: SparkSession, tag: str, strategy: dict, version: str = "") -> DataFrame:
    """One run row; its id is a hash of tag, strategy and input version, so a repeated job reuses it."""
    import json

    text = json.dumps(strategy or {}, sort_keys=True)
    row = spark.createDataFrame([(tag, text, version)], "tag string, strategy string, version string")
    return row.select(
        F.substring(F.sha2(F.concat_ws("\u0001", "tag", "strategy", "version"), 256), 1, 32).alias("run_id"),
        "tag",
        "strategy",
        F.current_timestamp().alias("created_at"),
    )


def write_results(results: DataFrame, path: str) -> None:
    """Per-question rows by run, nested columns as JSON text; a run written again replaces itself."""
    have = [c for c in RESULT_COLUMNS if c in results.columns]
    encoded = results.select(
        *[F.to_json(c).alias(c) if c in RESULT_JSON else F.col(c) for c in have]
    )
    _overwrite(encoded, path, "run_id")


def read_results(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """A run's question rows in creation order with the JSON columns decoded; reads one partition."""
    return decode_results(_read_partitioned(spark, path, "run_id").filter(F.col("run_id") == run_id)).orderBy(
        "created_at", "question_id"
    )


def decode_results(stored: DataFrame) -> DataFrame:
    decoded = stored.select(
        *[F.from_json(c, RESULT_JSON[c]).alias(c) if c in RESULT_JSON else F.col(c) for c in stored.columns]
    )
    if "hit" not in stored.columns:
        return decoded
    return decoded.withColumn("hit", F.transform_keys("hit", lambda k, _: k.cast("int")))


def write_metrics(metrics: DataFrame, path: str) -> None:
    _overwrite(metrics, path, "run_id")


def delete_run(spark: SparkSession, run_id: str, *paths: str) -> None:
    """Remove a run's partition from the given tables (runs, results, metrics)."""
    for path in paths:
        _delete_folder(spark, _folder(spark, path, run_id=run_id))


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.exists(target)


def _delete_folder(spark: SparkSession, path: str) -> None:
    if ".." in path.split("/"):
        raise ValueError(f"invalid path: {path}")
    fs, target = _filesystem(spark, path)
    if not fs.exists(target):
        raise FileNotFoundError(path)
    fs.delete(target, True)
