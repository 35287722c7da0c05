import pytest

#: Extra columns that carry names the operators use inside.
CLASHING = ("row", "fp", "score", "label", "spans", "_tokens", "rest", "doc")


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from texts, with ids from 0 and clashing extra columns."""
    def build(texts, ids=None, clash=True, sources=None, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["src0"] * len(texts))[k],
                 None if t is None else len(t), *["x"] * (len(CLASHING) if clash else 0))
                for k, (i, t) in enumerate(zip(ids, texts))]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        if clash:
            schema += "".join(f", `{c}` string" for c in CLASHING)
        return spark.createDataFrame(rows, schema)
    return build
