"""Secret scans over historical versions with a ledger of what has been scanned."""

from __future__ import annotations

import dataclasses
import hashlib
import re
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm.rows import packed
from passagemill.operators.passages import sieve
from passagemill.session import cut_lineage, intermediate_folder


@dataclass(frozen=True)
class Rule:
    """A pattern and the least length of its ``group`` that makes a match a finding. ``base`` rules are the contract's."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    base: bool = False
    hint: str = ""


# The contract's patterns and public token formats.
RULES = (
    Rule(
        "assign",
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        8, 2, True, True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, False, True, "AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, False, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, False, False, "gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, False, False, "xox"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, False, False, "eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0, False, False, "-----BEGIN "),
)
FINDING = "blob string, rules string, kind string, start long, end long"
VERSION = "doc_id long, blob string"


def rules_version(rules=RULES) -> str:
    """A name that changes with any rule, so findings of one rule list never stand for another's."""
    return hashlib.sha256(repr([dataclasses.astuple(r) for r in rules]).encode()).hexdigest()[:16]


def find(text: str, rules=RULES) -> list[tuple[int, int, int]]:
    """(rule number, start, end) of all findings, in code points, by start and then rule."""
    found = []
    for number, rule in enumerate(rules):
        if rule.hint and rule.hint not in text:
            continue
        flags = re.ASCII | (re.IGNORECASE if rule.any_case else 0)
        for hit in re.finditer(rule.pattern, text, flags):
            if hit.end(rule.group) - hit.start(rule.group) >= rule.least:
                found.append((hit.start(), number, hit.end()))
    return [(number, start, end) for start, number, end in sorted(found)]


class Ledger:
    """Tables below a shared folder: versions (path to blob), scanned (blob, rules), findings.

    Every scan appends one batch folder to each. A batch counts only once its ``scanned`` part, written
    last, is complete, so of a scan that dies halfway nothing is read and its blobs are scanned again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        target = path(f"{self.folder}/scanned")
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        batches = [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []
        done = [b for b in batches if files.exists(path(f"{self.folder}/scanned/{b}/_SUCCESS"))]
        folders = [f"{self.folder}/{name}/{b}" for b in done]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, rules string")

    def versions(self) -> DataFrame:
        """Every blob that every path ever held."""
        return self._read("versions", VERSION).distinct()

    def findings(self) -> DataFrame:
        """Findings of completed scans; what two scans at one time both found is listed once."""
        return self._read("findings", FINDING).distinct()

    def findings_by_path(self, rules=RULES) -> DataFrame:
        """``doc_id, blob, kind, start, end``: the findings in every version of every path, whenever it was seen."""
        found = self.findings().filter(F.col("rules") == rules_version(rules)).drop("rules")
        return self.versions().join(found, "blob").select("doc_id", "blob", "kind", "start", "end")

    def append(self, name: str, rows: DataFrame, batch: str) -> None:
        rows.write.parquet(f"{self.folder}/{name}/{batch}")


def scan_unseen(docs: DataFrame, ledger: Ledger, rules=RULES) -> DataFrame:
    """Scan every blob of ``docs`` that the ledger has not seen under these rules; returns the versions.

    Each text is addressed by its SHA-256. Hashes alone say what is new; then the texts of new blobs are picked out
    where they are, by a sieve of fixed size, and shuffled, one copy per task and blob. Texts that the ledger knows
    never move. The result has ``doc_id`` and ``blob`` for every row of ``docs``, also for those seen before.
    """
    batch, version = uuid.uuid4().hex, rules_version(rules)
    addressed = packed(docs).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("row.text"), F.lit("")).alias("text"),
    ).withColumn("blob", F.sha2("text", 256))
    versions = cut_lineage(addressed.select("doc_id", "blob"))
    seen = ledger.scanned().filter(F.col("rules") == version).select("blob")
    unseen = cut_lineage(versions.select("blob").distinct().join(seen, "blob", "left_anti"))
    blobs = sieve(addressed.select("blob", "text"), "blob", unseen).groupBy("blob").agg(F.first("text").alias("text")).join(unseen, "blob")

    def run(batches):
        for frame in batches:
            rows = [(blob, version, rules[n].kind, start, end) for blob, text in zip(frame["blob"], frame["text"]) for n, start, end in find(text, rules)]
            yield pd.DataFrame(rows, columns=["blob", "rules", "kind", "start", "end"])

    ledger.append("findings", blobs.mapInPandas(run, FINDING), batch)
    known = ledger.versions().withColumnsRenamed({"doc_id": "_path", "blob": "_blob"})
    new = versions.distinct().join(known, F.col("doc_id").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_blob")), "left_anti")
    ledger.append("versions", new, batch)
    ledger.append("scanned", unseen.withColumn("rules", F.lit(version)), batch)
    return versions


def scan_secrets(docs: DataFrame, ledger: Ledger | None = None, rules=RULES) -> DataFrame:
    """``doc_id, blob, secrets`` for every row: findings of its text as structs ``kind, start, end, base``.

    Only blobs that the ledger lacks for these rules are scanned; findings are then joined back
    to the rows. ``Ledger.findings_by_path`` has them for all paths ever seen. Null and empty texts are one blob without
    findings; rows with one doc_id are versions of their own, equal rows count once each; patterns are linear in a text's
    length; an empty table gives nothing; other columns are not read. Without a ledger a new one is made in the shared folder.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, f"{intermediate_folder(spark)}/secrets-{uuid.uuid4().hex}")
    versions = scan_unseen(docs, ledger, rules)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = F.array(*[F.lit(r.base) for r in rules])
    order = F.array_position(kinds, F.col("kind")).cast("int")
    entry = F.struct("start", order.alias("order"), "end", "kind", F.get(base, order - 1).alias("base"))
    found = ledger.findings().filter(F.col("rules") == rules_version(rules))
    # A blob's findings are spans of its one text.
    per_blob = cut_lineage(found.groupBy("blob").agg(F.array_sort(F.collect_list(entry)).alias("secrets")))
    none = F.array().cast(per_blob.schema["secrets"].dataType)
    return versions.join(per_blob, "blob", "left").select("doc_id", "blob", F.coalesce("secrets", none).alias("secrets"))


def listed(found):
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
