from pyspark.sql import functions as F

from tests.conftest import SMALL
from tillwise import session
from tillwise.sources import mapping


def test_more_lines_of_a_pair_than_usual_keep_numbers_of_their_own(spark, tmp_path):
    for name in ("orders", "supplier", "nation"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    line = spark.read.parquet(f"{SMALL}/lineitem.parquet").orderBy("l_orderkey").limit(1)
    hot = line.crossJoin(spark.range(1_001)).withColumn("l_quantity", F.col("id").cast(line.schema["l_quantity"].dataType))
    neighbour = line.withColumn("l_linenumber", (F.col("l_linenumber") + 1).cast(line.schema["l_linenumber"].dataType))
    hot.drop("id").unionByName(neighbour).write.parquet(f"{tmp_path}/lineitem.parquet")
    lines = mapping.SourceTables(spark, str(tmp_path)).lines()
    found = lines.agg(F.count("*"), F.count_distinct("line_no"), F.max("line_room")).first()
    assert tuple(found) == (1_002, 1_002, 10_000)
    candidates = mapping.purchase_candidates(mapping.SourceTables(spark, str(tmp_path)))
    assert candidates.count() == 1_002


def test_lines_are_shuffled_once(spark):
    plan = mapping._lines(mapping.SourceTables(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "count(" not in plan


def test_lines_take_the_place_among_those_with_one_order_and_number(spark):
    rows = mapping.SourceTables(spark, SMALL).lines()
    again = rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max(F.col("line_no") % 1000).alias("last"))
    assert again.filter("n <> last + 1").count() == 0 and rows.count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()


def test_flat_rows_are_dealt_by_store_once(spark):
    tables = mapping.load_tables(spark, SMALL)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    with session.setting(spark, limit, "-1"), mapping._kept_partitions(spark):
        plan = mapping.flat_rows(tables)._jdf.queryExecution().executedPlan().toString()
    joins_with_stock_visits_and_traffic = plan[: plan.index("Inner", plan.index("FullOuter"))]
    assert "hashpartitioning(product_id" not in joins_with_stock_visits_and_traffic
    assert joins_with_stock_visits_and_traffic.count("REPARTITION_BY_COL") == 1


def test_flat_rows_of_hot_stores_are_the_same(spark):
    tables = mapping.load_tables(spark, SMALL)
    some, none = mapping.flat_rows(tables, 600), mapping.flat_rows(tables)
    sizes = [r["n"] for r in tables.purchase.groupBy("store_id", "store_location").agg(F.count("*").alias("n")).collect()]
    assert min(sizes) <= 600 < max(sizes)
    assert some.count() == none.count() and some.exceptAll(none).isEmpty() and none.exceptAll(some).isEmpty()


def test_flat_rows_in_shares_of_stores_are_the_same(spark):
    tables = mapping.load_tables(spark, SMALL)
    purchase = tables.purchase.withColumn("store_location", F.when(F.col("customer_id") % 50 != 1, F.col("store_location")))
    tables = tables.replacing(purchase=purchase)
    shares = list(mapping.store_shares(tables, 1_500))
    sizes = [share.purchase.count() for share in shares]
    assert len(shares) == -(-tables.purchase.count() // 1_500) > 2 and max(sizes) < sum(sizes) == tables.purchase.count()
    parts, whole = [mapping.flat_rows(share) for share in shares], mapping.flat_rows(tables)
    some = parts[0]
    for part in parts[1:]:
        some = some.unionByName(part)
    assert some.count() == whole.count() > 0 and some.exceptAll(whole).isEmpty() and whole.exceptAll(some).isEmpty()
