import pytest

CLASH = ["id", "fp", "node", "size", "n", "chunk", "record", "word", "words", "links", "seed", "name", "shard", "length", "score", "key", "spans", "count"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text), with columns whose names operators use inside."""

    def made(rows, name="doc_id", value="text", kind="string"):
        df = spark.createDataFrame(rows, f"{name} long, {value} {kind}")
        for c in CLASH:
            df = df.selectExpr("*", f"'x' as {c}")
        return df

    return made
