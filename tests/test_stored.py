"""What a query leaves on the disks while it is built."""

from pyspark.sql import functions as F

from inspectra.operators import anomaly, facts
from inspectra.plans.materialise import CLEANUP, stored
from inspectra.plans.catalog import QUERIES
from tests.test_growth import plan


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stored_table_keeps_no_shuffle_files(spark):
    before = shuffled(spark)
    rows = stored(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    assert shuffled(spark) <= before and rows.count() == 7
    assert spark.conf.get(CLEANUP) == "false"


def test_rows_are_not_shuffled_for_their_floors(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "establishment_id long, period_end date").withColumn("period_end", F.lit("1997-01-31").cast("date"))
    rates = spark.createDataFrame([("MH", "UNSKILLED", 100, "1996-01-01")], "state_code string, skill_category string, daily_rate_paise long, effective_from string").withColumn("effective_from", F.col("effective_from").cast("date"))
    places = spark.createDataFrame([(1, "MH"), (2, "GJ")], "establishment_id long, state_code string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = facts.with_floors(rows, rates, places, rows)
        assert "Exchange hashpartitioning(establishment_id" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.establishment_id, r.floor_paise) for r in found.collect()} == {(1, 100), (2, None)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_violations_are_found_before_their_values(spark):
    """The plan that shows values holds no count of checks."""
    assert "bit_or" not in plan(QUERIES["e04_observed_values"](spark, "/root/testdata/sf0.001"))


def test_tests_are_not_shuffled_together(spark):
    wages = spark.range(40).selectExpr("1L AS establishment_id", "1997 AS period_year", "id AS worker_key", "id AS row_number", "id * 7 + 1 AS gross_paise", "id * 7 + 1 AS net_paid_paise", "CAST(id AS double) AS days_paid", "CAST(id AS double) AS daily_wage_paise", "0.1D AS deduction_share")
    attendance = spark.range(40).selectExpr("1L AS establishment_id", "1997 AS period_year", "26.0D AS days_present", "0.0D AS days_absent", "CAST(id AS double) AS overtime_hours")
    epf = spark.range(40).selectExpr("1L AS establishment_id", "1997 AS period_year", "5L AS wage_base_paise", "id + 1 AS register_wages_paise")
    peers = spark.createDataFrame([(1, 1e9)], "establishment_id long, peer_paise double")
    found = anomaly.all_tests(wages, attendance, epf, peers, anomaly.YEAR)
    assert "Aggregate" not in plan(found)
    assert {"attendance.zero_variance", "epf.uniform_wage_base", "peer.daily_wage_below_median"} <= {r.test for r in found.collect()}
