"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "passagemill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for.

    Shuffle partition counts are left to AQE: the initial number is an upper
    bound that is coalesced at run time, so clusters should set it high.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints; a temporary one only on a local master."""
    named = (
        spark.conf.get(CHECKPOINT_CONF, None)
        or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
        or spark.sparkContext.getCheckpointDir()
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    named = tempfile.mkdtemp(prefix="passagemill-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def intermediate_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables go, below the shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/passagemill-{spark.sparkContext.applicationId}"


def drop_intermediates(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that were not written or collected by then are lost."""
    target = spark._jvm.org.apache.hadoop.fs.Path(intermediate_folder(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, with options of the writer, and read it back.

    Unlike executor-local copies the table outlives lost executors, and unlike an
    RDD checkpoint its rows are computed once. :func:`drop_intermediates` removes it.
    """
    spark = df.sparkSession
    path = f"{intermediate_folder(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings of the session while a block runs its actions, dots written as ``__``; put back afterwards.

    Only for those that change how rows are handed on, never what comes out: other actions of the session may meet them.
    """
    wanted = {name.replace("__", "."): value for name, value in conf.items()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
