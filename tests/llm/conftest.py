import pytest


@pytest.fixture()
def documents(spark):
    """A function that makes a documents table of (doc_id, text[, source[, extra]]) rows."""

    def make(rows, extra=False):
        full = [(i, t, "en", (r[0] if r else "s"), len(t or "")) for i, t, *r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        if extra:
            clashing = ["row", "n_removed", "size", "score", "id", "pos", "tokens", "pii"]
            full = [f + ("x",) * len(clashing) for f in full]
            schema += "".join(f", `{c}` string" for c in clashing)
        return spark.createDataFrame(full, schema)

    return make
