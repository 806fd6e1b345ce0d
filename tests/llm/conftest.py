import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text[, lang[, source]]) tuples, plus columns whose names operators use themselves."""
    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("row", "kept", "score", "_h", "_id", "fp", "ids", "size", "words", "held_out", "c"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return make


@pytest.fixture(scope="session")
def rows_of():
    def rows(df, *columns):
        return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
    return rows
