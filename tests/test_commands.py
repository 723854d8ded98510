import json
from types import SimpleNamespace
from unittest.mock import MagicMock

from conftest import SEED, frames

from tillhouse.__main__ import main
from tillhouse.sources.lake import Lake
from tillhouse.sources.landing import jdbc_sources, jdbc_table


def test_run_and_check_from_parquet(spark, tmp_path, capsys):
    source, lake = tmp_path / "source", str(tmp_path / "lake")
    for table, df in frames(spark, SEED).items():
        df.write.parquet(f"{source}/{table}.parquet")
    assert main(["run", "--lake", lake, "--parquet", str(source)]) == 0
    assert Lake(spark, lake).read("marts", "fact_sales").count() == 6
    capsys.readouterr()
    for layer in ("ingestion", "bronze", "gold", "marts"):
        assert main(["check", layer, "--lake", lake]) == 0
        assert json.loads(capsys.readouterr().out)["passed"]
    assert main(["check", "gold", "--lake", str(tmp_path / "nowhere")]) == 1
    assert main(["check", "ingestion", "--lake", str(tmp_path / "nowhere"), "--mode", "cdc"]) == 0


class Reader:
    """Stands for one ``spark.read``: no database is available to the tests."""

    def __init__(self, bounds):
        self.bounds, self.seen = bounds, {}

    def format(self, name):
        return self

    def option(self, key, value):
        self.seen[key] = value
        return self

    def options(self, **values):
        self.seen.update(values)
        return self

    def load(self):
        assert not {"query", "dbtable"} <= set(self.seen)  # Spark refuses both on one reader
        return SimpleNamespace(first=lambda: self.bounds)


class Session:
    """Gives a new reader for each ``read``, as a session does."""

    def __init__(self, bounds):
        self.bounds, self.readers = bounds, []

    @property
    def read(self):
        self.readers.append(Reader(self.bounds))
        return self.readers[-1]


def test_database_tables_are_read_in_key_ranges():
    session = Session(SimpleNamespace(low=1, high=900))
    jdbc_table(session, "jdbc:x", "pos.stores", "store_id", 4, {"user": "u"})
    bounds, reader = session.readers
    assert "query" in bounds.seen and bounds.seen["user"] == "u"
    assert reader.seen["partitionColumn"] == "store_id" and reader.seen["numPartitions"] == 4
    assert (reader.seen["lowerBound"], reader.seen["upperBound"]) == (1, 900)
    assert reader.seen["dbtable"] == "pos.stores" and reader.seen["user"] == "u"
    empty = Session(SimpleNamespace(low=None, high=None))
    jdbc_table(empty, "jdbc:x", "pos.refunds", "refund_id")
    assert set(empty.readers[-1].seen) == {"url", "dbtable"}
    keyless = Session(None)
    jdbc_table(keyless, "jdbc:x", "pos.status_ref")
    assert [set(r.seen) for r in keyless.readers] == [{"url", "dbtable"}]
    assert len(jdbc_sources(MagicMock(), "jdbc:x", "pos")) == 9
