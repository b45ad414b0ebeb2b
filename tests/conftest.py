import pytest

from gridspark.session import build_session

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """DataFrame from rows and a schema string."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make


def as_dict(df, keys, value="value"):
    keys = [keys] if isinstance(keys, str) else keys
    pick = (lambda row: row[keys[0]]) if len(keys) == 1 else (lambda row: tuple(row[k] for k in keys))
    rows = df.collect()
    out = {pick(row): row[value] for row in rows}
    assert len(out) == len(rows), "duplicate keys"
    return out
