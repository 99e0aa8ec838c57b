import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Build a documents table, with columns that clash with names operators use."""

    def build(texts, first=0, clash=True):
        rows = []
        for i, t in enumerate(texts):
            doc_id, text = t if isinstance(t, tuple) else (first + i, t)
            rows.append((doc_id, text, "en", f"s{i % 3}" if i % 4 else None, None if text is None else len(text)))
        df = spark.createDataFrame(rows, DOCS).coalesce(2)
        if clash:
            for name in ("kept", "slot", "shard", "quality", "fingerprint", "n_words", "mark", "position", "id"):
                df = df.selectExpr("*", f"'own' as {name}")
        return df

    return build


# null, empty, blank, one word, repeated rows, ties and a very long text
EDGE = [
    None,
    "",
    " \n\t ",
    "word",
    "a b c d e f",
    "a b c d e f",
    (7, "same id one"),
    (7, "same id two"),
    (None, "no id " * 30),
    (None, None),
    "x" * 200_000 + " " + "long words " * 5000,
]
