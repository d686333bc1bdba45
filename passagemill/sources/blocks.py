"""Tables in the shared folder that tasks read block by block, for sides of a computation that may be too large to send.

Tasks read them with Arrow's own file systems (local or mounted paths, hdfs, s3, gs, abfs), so the shared
folder (``spark.checkpoint.dir``) has to be one of these.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame

from passagemill.session import intermediate_folder

#: Schemes that Hadoop and Arrow name differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfss": "abfs"}


def write_blocks(table: DataFrame) -> str:
    """Write a table once, in files of about one advisory partition; returns the address tasks read."""
    spark = table.sparkSession
    path = f"{intermediate_folder(spark)}/{uuid.uuid4().hex}"
    table.hint("rebalance").write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    scheme = _SCHEMES.get(full.getScheme(), full.getScheme())
    return f"{scheme}://{full.getAuthority() or ''}{full.getPath()}"


def read_blocks(address: str, rows: int) -> Iterator:
    """The table as Arrow tables of at most ``rows`` rows, one in memory at a time."""
    import pyarrow as pa
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    files, folder = fs.FileSystem.from_uri(address)
    for found in sorted(files.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
        if found.path.endswith(".parquet"):
            with files.open_input_file(found.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=rows):
                    yield pa.Table.from_batches([batch])
