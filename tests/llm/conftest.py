import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside; a table may have them too.
CLASHES = ("batch", "bucket", "node", "kept", "digest", "group", "norm", "size", "target", "taken", "key", "keep_id", "class_id", "component", "version", "windows", "ids", "start", "__barloom_note")


@pytest.fixture(scope="session")
def docs(spark):
    """A table from (doc_id, text[, source[, lang]]) rows, with columns whose names clash."""

    def make(rows, parts=3):
        full = [(i, t, (more[1] if len(more) > 1 else "en"), (more[0] if more else "s"), len(t or "")) for i, t, *more in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in CLASHES:
            df = df.withColumn(name, df.doc_id * 0)
        return df.repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    words = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
    passage = " ".join(f"p{k}" for k in range(80))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, words), (5, words), (6, "one"), (7, "One"), (7, "One"), (None, "one"), (None, None),
        (8, f"{passage} tail of eight", None, None), (9, f"head of nine {passage}", None, "xx"), (10, "a  b\n\nc d 中文 \U0001f600 é"), (11, "x " * 50), (12, "same\nlines\nhere\nsame\nlines\nhere"),
    ]
