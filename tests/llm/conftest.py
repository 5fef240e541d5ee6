import pytest

KEY = "a8Kz0QpL7xTn4VbW2mRs9YdE3cHf6JgU"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [r.asDict() for r in documents.collect()]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    long = " ".join(f"word{i % 9973} item{i}" for i in range(60_000))
    prose = " ".join(f"alpha{i} beta{i * 7 % 13}" for i in range(40))
    texts = [None, "", "   \n\t ", "one", "Two Words", prose, prose, prose.upper(), prose + " tail", long, long + " more", "a\x0bb\x0cc\rd e   f", f"password: {KEY}", "x " * 300, "é" * 50, "\n\n\n", "line one here\nline one here\nline one here"]
    out = [dict(doc_id=i, text=t, lang="en", source=f"s{i % 3}", n_chars=len(t or "")) for i, t in enumerate(texts)]
    out.append(dict(out[5]))
    out.append(dict(doc_id=None, text=prose, lang=None, source=None, n_chars=None))
    out.append(dict(doc_id=None, text=None, lang=None, source=None, n_chars=None))
    out.append(dict(doc_id=77, text=prose + " end", lang=None, source=None, n_chars=None))
    return [r | dict(size=1, rank=2, key="k", turn=None, bucket="b", doc="d", spans=None, base=1.5, end=3) for r in out]


EXTRA = "size int, rank int, key string, turn string, bucket string, doc string, spans string, base double, end int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
