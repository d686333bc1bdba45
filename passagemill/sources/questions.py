"""Evaluation question files: parsing, validation, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.schemas import QUESTION


def parse_questions(lines: DataFrame, skip: int = 0) -> DataFrame:
    """Questions from JSON lines ``(line_no, line)``.

    Blank and malformed lines and rows without id or question are dropped. ``skip``
    leaves out the first valid rows in line order: their last line number comes from
    a top-``skip`` selection, so nothing is ranked globally.
    """
    parsed = lines.filter(F.col("line") != "").select(
        *[c for c in lines.columns if c != "line"],
        F.from_json("line", QUESTION, {"mode": "PERMISSIVE"}).alias("q"),
        F.try_parse_json("line").isNotNull().alias("is_json"),
    )
    q = F.col("q")
    valid = parsed.filter(
        F.col("is_json")
        & (F.coalesce(q["id"], F.lit("")) != "")
        & (F.coalesce(q["question"], F.lit("")) != "")
    )
    if skip > 0:
        last = valid.select("line_no").orderBy("line_no").limit(skip).agg(F.max("line_no")).scalar()
        valid = valid.filter(F.col("line_no") > last)
    return valid.select(*[c for c in lines.columns if c != "line"], "q.*")


def validate_datasets(lines: DataFrame) -> DataFrame:
    """Per dataset the number of questions, or the number of the first invalid line.

    Lines are counted without blank ones, so ``bad_line`` is the position among
    the non-blank lines. A dataset with an invalid line has no question count.
    """
    text = tx.trim_ws(F.col("line"))
    checked = lines.filter(text != "").select(
        "dataset", "line_no", F.try_parse_json(text).isNull().alias("bad")
    )
    first_bad = checked.groupBy("dataset").agg(
        F.min(F.when(F.col("bad"), F.col("line_no"))).alias("_bad_at")
    )
    # one row per dataset on the right
    joined = checked.join(first_bad, "dataset")
    return joined.groupBy("dataset").agg(
        F.when(F.max("_bad_at").isNull(), F.count("*")).alias("question_count"),
        F.when(
            F.max("_bad_at").isNotNull(), F.count_if(F.col("line_no") <= F.col("_bad_at"))
        ).alias("bad_line"),
    )


def dataset_catalogue(lines: DataFrame) -> DataFrame:
    """``name, size, question_count`` per dataset; the count is 0 for an invalid dataset.

    Size and modification time (``modified``) are the file's where the lines carry
    them, else the size is that of the lines with their line ends.
    """
    from_file = "size" in lines.columns
    size = F.max("size") if from_file else F.sum(tx.byte_size(F.col("line")) + 1)
    extra = [F.max("modified").alias("modified")] if "modified" in lines.columns else []
    sizes = lines.groupBy("dataset").agg(size.alias("size"), *extra)
    return sizes.join(validate_datasets(lines), "dataset", "left").select(
        F.col("dataset").alias("name"),
        "size",
        *(["modified"] if extra else []),
        F.coalesce("question_count", F.lit(0)).alias("question_count"),
    )
