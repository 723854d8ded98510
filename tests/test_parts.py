"""Versions made of parts: what changes is written, all else stays."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillhouse.sources.lake import PART


def dealt(spark, rows, parts=4, extra=0):
    return spark.range(rows).select((F.col("id") + extra).alias("id"), F.pmod("id", F.lit(parts)).alias(PART))


def files(root, table="t"):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob(f"gold/{table}/**/*.parquet")}


def values(lake, parts=None):
    return sorted(r.id for r in lake.read("gold", "t", parts).collect())


def test_one_part_is_rewritten_and_the_files_of_the_others_stay(spark, lake):
    lake.publish_parts(dealt(spark, 40), "gold", "t", map(str, range(4)))
    before = files(lake.root)
    lake.publish_parts(dealt(spark, 40, extra=100).filter(f"{PART} = 2"), "gold", "t", ["2"], facts={"why": "test"})
    after = files(lake.root)
    assert before.items() <= after.items()
    assert all("v00000002" in f and f"{PART}=2" in f for f in after.keys() - before.keys())
    assert values(lake, ["2"]) == [102 + 4 * n for n in range(10)]
    assert values(lake) == sorted([n for n in range(40) if n % 4 != 2] + values(lake, ["2"]))
    version = lake.version("gold", "t")
    assert version.rows == dict.fromkeys("0123", 10) and version.facts == {"why": "test"}


def test_open_readers_keep_their_version_and_unused_parts_are_dropped(spark, lake):
    lake.publish_parts(dealt(spark, 8), "gold", "t", map(str, range(4)))
    reader = lake.read("gold", "t")
    lake.publish_parts(dealt(spark, 8, extra=10).filter(f"{PART} = 0"), "gold", "t", ["0"])
    assert sorted(r.id for r in reader.collect()) == list(range(8))
    for n in range(3):
        lake.publish_parts(dealt(spark, 8, extra=20 + n).filter(f"{PART} = 0"), "gold", "t", ["0"])
    assert lake.versions("gold", "t") == [4, 5]
    folders = {str(Path(f).parent.relative_to("gold/t")) for f in files(lake.root)}
    data = lambda v, p: f"v{v:08d}/data/{PART}={p}"
    assert folders == {data(1, 1), data(1, 2), data(1, 3), data(4, 0), data(5, 0)}
    assert values(lake) == sorted([22, 26, 1, 2, 3, 5, 6, 7])


def test_emptied_and_absent_parts(spark, lake):
    lake.publish_parts(dealt(spark, 8), "gold", "t", map(str, range(4)))
    lake.publish_parts(dealt(spark, 0), "gold", "t", ["1", "3"])
    assert values(lake) == [0, 2, 4, 6] and values(lake, ["1"]) == []
    lake.publish_parts(dealt(spark, 8), "gold", "t", [], facts={"seen": 1})
    assert values(lake) == [0, 2, 4, 6] and lake.version("gold", "t").facts == {"seen": 1}
    lake.publish_parts(dealt(spark, 0), "gold", "t", ["0"], replace=True)
    assert lake.read("gold", "t").columns == ["id"] and values(lake) == []


def test_wrong_parts_and_columns_are_refused(spark, lake):
    lake.publish_parts(dealt(spark, 8), "gold", "t", map(str, range(4)))
    with pytest.raises(ValueError, match="not named"):
        lake.publish_parts(dealt(spark, 8), "gold", "t", ["0"])
    with pytest.raises(ValueError, match="other columns"):
        lake.publish_parts(dealt(spark, 8).withColumn("more", F.lit(1)), "gold", "t", ["0"])
    assert values(lake) == list(range(8))


def test_rows_are_counted_while_they_are_written(spark, lake):
    lake.publish(spark.range(10), "gold", "t", count_if=F.col("id") > 6)
    assert lake.version("gold", "t").row_count == 3
    lake.publish(spark.range(0), "gold", "t", sort_by=["id"])
    assert lake.version("gold", "t").row_count == 0
