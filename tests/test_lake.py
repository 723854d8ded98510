import pytest
from conftest import SOLD

from pyspark.sql import functions as F

from tillhouse.plans.serving import SERVED, SERVED_LAYER, serve, serve_table
from tillhouse.schemas import SOURCES, source_schema
from tillhouse.session import size_shuffles
from tillhouse.sources.lake import Lake
from tillhouse.sources.landing import LANDING, bronze_copy, ingest


def ids(lake, layer="gold", table="t"):
    return sorted(r.id for r in lake.read(layer, table).collect())


def test_missing_table(lake):
    assert not lake.exists("gold", "t")
    with pytest.raises(LookupError):
        lake.read("gold", "t")


def test_overwrite_replaces_rows_and_schema(spark, lake):
    lake.publish(spark.range(3), "gold", "t")
    lake.publish(spark.range(2).selectExpr("id", "'x' AS name"), "gold", "t")
    assert ids(lake) == [0, 1]
    assert lake.read("gold", "t").columns == ["id", "name"]


def test_a_table_can_be_built_from_itself(spark, lake):
    lake.publish(spark.range(2), "gold", "t")
    lake.publish(lake.read("gold", "t").union(spark.range(5, 6)), "gold", "t")
    assert ids(lake) == [0, 1, 5]


def test_old_versions_are_dropped(spark, tmp_path):
    lake = Lake(spark, str(tmp_path), keep_versions=1)
    for n in (1, 2, 3):
        lake.publish(spark.range(n), "gold", "t")
    assert lake.versions("gold", "t") == [3]
    assert [p.name for p in (tmp_path / "gold" / "t").iterdir()] == ["v00000003"]
    with pytest.raises(ValueError):
        Lake(spark, str(tmp_path), keep_versions=0)


def test_open_reader_keeps_its_version(spark, lake):
    lake.publish(spark.range(3), "gold", "t")
    reader = lake.read("gold", "t")
    lake.publish(spark.range(1), "gold", "t")
    assert reader.count() == 3


def test_failed_publish_leaves_the_last_version_and_is_cleared(spark, lake, tmp_path):
    lake.publish(spark.range(3), "gold", "t")
    broken = spark.range(3).selectExpr("CASE WHEN id < 3 THEN raise_error('broken') END AS id")
    with pytest.raises(Exception, match="broken"):
        lake.publish(broken, "gold", "t")
    assert ids(lake) == [0, 1, 2]
    lake.publish(spark.range(1), "gold", "t")
    assert ids(lake) == [0]
    names = sorted(p.name for p in (tmp_path / "lake" / "gold" / "t").iterdir())
    assert all((tmp_path / "lake" / "gold" / "t" / n / "_SUCCESS").exists() for n in names)


def test_served_tables_outlive_the_lake(spark, built, tmp_path):
    served = Lake(spark, str(tmp_path / "served"))
    serve(built, ["fact_sales"], served)
    assert served.read(SERVED_LAYER, "fact_sales").count() == len(SOLD)
    away = Lake(spark, str(tmp_path / "nowhere"))
    with pytest.raises(LookupError):
        serve_table(away, "fact_sales", served)
    assert served.read(SERVED_LAYER, "fact_sales").count() == len(SOLD)


def test_served_copies_are_sorted_by_their_key(spark, lake):
    """Files hold disjoint ranges of the key and are sorted inside."""
    fact = spark.range(2000).selectExpr(
        "CAST(id * 7919 % 2000 AS INT) AS item_key",
        "date_add(DATE '2026-01-01', CAST(id % 5 AS INT)) AS date_key",
    )
    lake.publish(fact.repartition(4), "gold", "fact_sales")
    serve_table(lake, "fact_sales", file_bytes=2000)
    rows = (
        lake.read(SERVED_LAYER, "fact_sales")
        .selectExpr("_metadata.file_name AS f", "_metadata.row_index AS n", "date_key", "item_key")
        .orderBy("f", "n")
        .collect()
    )
    files = {}
    for r in rows:
        files.setdefault(r.f, []).append((r.date_key, r.item_key))
    assert len(files) > 1 and sum(map(len, files.values())) == 2000
    assert all(keys == sorted(keys) for keys in files.values())
    bounds = sorted((keys[0], keys[-1]) for keys in files.values())
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))


def test_served_tables_exist(built):
    for table, (layer, keys) in SERVED.items():
        assert set(keys) <= set(built.read(layer, table).columns), table


def test_an_emptied_source_replaces_the_landed_rows(spark, lake):
    ingest(lake, "stores", spark.createDataFrame([(1, "a")], "store_id INT, store_name STRING"))
    ingest(lake, "stores", spark.createDataFrame([], "store_id INT, store_name STRING"))
    landed = lake.read(LANDING, "stores")
    assert landed.count() == 0 and landed.columns == ["store_id", "store_name"]


def test_bronze_restores_types_and_keeps_extra_columns(spark):
    landed = spark.sql(
        "SELECT 1L AS product_id, 'x' AS product_name, 'ELEC' AS category_code, "
        "CAST(12.5 AS DECIMAL(24,6)) AS unit_price, current_date() AS _loaded_at"
    )
    bronze = bronze_copy(landed, "products", "2026-09-15 12:00:00")
    kinds = dict(bronze.dtypes)
    assert (kinds["product_id"], kinds["unit_price"]) == ("int", "decimal(10,2)")
    assert {"_loaded_at", "_ingested_at"} <= set(kinds)
    assert dict(bronze_copy(landed, "products", "2026-09-15", True).dtypes)["product_id"] == "bigint"


def test_every_source_table_has_a_schema_with_its_key(spark):
    assert len(SOURCES) == 9
    for table, (key, _) in SOURCES.items():
        assert key in source_schema(table).names


def test_shuffles_grow_with_the_input(spark, tmp_path):
    spark.range(20_000).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, str(tmp_path)) == int(before)
        assert size_shuffles(spark, str(tmp_path), 4096) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_point_read_of_a_served_table_skips_the_other_files(spark, lake):
    """Customers by id and flag: of many files one holds the row, and only its rows are read."""
    people = spark.range(20_000).selectExpr(
        "id * 1000000 + 1 AS customer_key", "id AS customer_id", "id % 2 = 0 AS is_current"
    )
    lake.publish(people.repartition(8), "gold", "dim_customer")
    serve_table(lake, "dim_customer", file_bytes=20_000)
    read = lake.read(SERVED_LAYER, "dim_customer")
    files = read.select(F.col("_metadata.file_name")).distinct().count()
    assert files > 5
    found = read.filter("customer_id = 7778 AND is_current")
    assert [r.customer_key for r in found.collect()] == [7778 * 1000000 + 1]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numOutputRows").get().value() <= 20_000 / files * 2


def test_a_served_file_holds_a_bounded_number_of_rows(spark, lake):
    """Rows that compress to next to nothing still fill the memory of the task that sorts them."""
    days = spark.range(9000).selectExpr(
        "date_add(DATE '2024-01-01', CAST(id % 900 AS INT)) AS date_key", "concat('s', id) AS store_name", "0 AS revenue"
    )
    lake.publish(days, "mart", "daily_sales_mart")
    serve_table(lake, "daily_sales_mart", file_rows=1000)
    served = lake.read(SERVED_LAYER, "daily_sales_mart")
    per_file = [r["count"] for r in served.groupBy(F.col("_metadata.file_name")).count().collect()]
    assert len(per_file) == 9 and sum(per_file) == 9000 and max(per_file) < 2000


def test_bloom_filters_of_small_files_are_as_small_as_their_rows(spark, lake):
    """A filter for a million values in each file made a table of many small files hundreds of times its size."""
    rows = spark.range(4000).select(
        F.col("id").alias("item_key"), F.expr("DATE'2024-01-01' + CAST(id % 9 AS INT)").alias("date_key"), F.col("id").alias("customer_key")
    )
    lake.publish(rows, "gold", "fact_sales")
    serve_table(lake, "fact_sales", file_rows=500)
    assert lake.size(SERVED_LAYER, "fact_sales") < 10 * lake.size("gold", "fact_sales")
    assert lake.read(SERVED_LAYER, "fact_sales").exceptAll(rows).isEmpty()


def test_small_files_do_not_grow_in_number_with_the_table(spark, lake):
    """Each file is a task and a block of every map task."""
    rows = spark.range(20_000).select(
        F.col("id").alias("item_key"), F.expr("DATE'2024-01-01' + CAST(id % 9 AS INT)").alias("date_key"), F.col("id").alias("customer_key")
    )
    lake.publish(rows, "gold", "fact_sales")
    assert lake.size("gold", "fact_sales") > 200 * 256
    serve_table(lake, "fact_sales", file_bytes=256)
    served = lake.read(SERVED_LAYER, "fact_sales")
    assert 64 < served.select(F.col("_metadata.file_name")).distinct().count() <= 128
    assert served.exceptAll(rows).isEmpty() and served.count() == 20_000


def test_tables_are_compressed_with_zstd(spark, lake):
    lake.publish(spark.range(9), "gold", "t")
    lake.publish(spark.range(9), "gold", "b", bucket_by="id")
    lake.publish_parts(spark.range(9).withColumn("_part", F.lit("p")), "gold", "p", ["p"])
    for table in "tbp":
        files = lake.read("gold", table).select(F.col("_metadata.file_name").alias("f")).distinct().collect()
        assert files and all(r.f.endswith(".zstd.parquet") for r in files)
