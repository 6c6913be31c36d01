import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents frame from (doc_id, text[, source]) rows, with extra columns whose names operators use inside."""

    def build(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            for name in ("fp", "key", "size", "spans", "shared", "of_doc", "text_hash", "range_no", "part", "copies", "score", "label", "shard", "rank", "gone_id", "carried", "n_words", "items", "bucket", "digest"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build


#: Nulls, empty and blank texts, ties, repeated rows.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a"), (5, "a"), (None, "a b c"), (7, "é " * 50), (8, "word " * 3000), (8, "word " * 3000)]
