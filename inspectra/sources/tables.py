"""The domain tables with their schemas, for stores that hold them as such (the views are adapters for the test tables).

Money is in whole paise, days and hours are doubles, null is unknown. Fact tables are written by month of their period and sorted by
establishment, so that a period's assessment reads its months only and an establishment's rows lie together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_KEY = "establishment_id bigint, period_start date, period_end date"
SCHEMAS = {
    "wage_line": f"{_KEY}, worker_key bigint, row_number bigint, period_year int, days_paid double, days_present double, normal_hours_per_day double, overtime_hours double, basic_paise bigint, da_paise bigint, other_allowances_paise bigint, gross_paise bigint, "
    "overtime_rate_paise bigint, overtime_paise bigint, deductions_paise bigint, pf_paise bigint, esi_paise bigint, advance_paise bigint, net_paid_paise bigint, paid_on date, date_of_exit date, needs_review boolean",
    "attendance": f"{_KEY}, worker_key bigint, row_number bigint, period_year int, days_present double, days_absent double, overtime_hours double, max_daily_hours double, max_weekly_hours double, longest_consecutive_days int",
    "contribution": f"{_KEY}, scheme string, worker_key bigint, row_number bigint, period_year int, wage_base_paise bigint, employee_share_paise bigint, employer_share_paise bigint",
    "incident": "establishment_id bigint, incident_id bigint, occurred_on date, notified_on date, notification_reference string",
    "document": f"{_KEY}, document_id bigint, doc_type string, status string, created_at timestamp, batch_id bigint",
    "establishment": "establishment_id bigint, organisation_id bigint, name string, state_code string, nic_code bigint, worker_count int, worker_count_peak_12m int, women_worker_count int, contract_worker_count int, engages_contract_labour boolean, is_factory boolean, is_active boolean",
    "contractor": "establishment_id bigint, name string, licence_number string, licence_valid_to date, licensed_worker_count int, deployed_worker_count int",
    "prose_assertion": "assertion_id bigint, establishment_id bigint, created_at timestamp, key string, present boolean, value_text string",
    "minimum_wage_rate": "state_code string, skill_category string, daily_rate_paise bigint, effective_from date",
    "identity": "establishment_id bigint, identity_id bigint, display_name string, father_name string, uan string, date_of_joining date, is_contract_worker boolean",
    "registration": "establishment_id bigint, kind string, number string, valid_from date, valid_to date, filed bigint",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def write(df: DataFrame, folder: str, name: str) -> None:
    """A table in its schema: columns that it lacks are null, others are left out."""
    rows = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(name)))
    if "period_start" in rows.columns:
        rows = rows.withColumn("month", F.date_format("period_start", "yyyy-MM")).repartition("month", "establishment_id").sortWithinPartitions("month", "establishment_id")
        rows.write.mode("overwrite").partitionBy("month").parquet(f"{folder}/{name}")
    else:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, name: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The stored table, nothing is inferred; of those that are kept by month the files of the months (yyyy-MM) from first to last only."""
    kept = schema(name)
    rows = spark.read.schema(kept.add("month", "string") if "period_start" in kept.names else kept).parquet(f"{folder}/{name}")
    if "month" in rows.columns:
        rows = rows.where(F.col("month") >= first) if first else rows
        rows = (rows.where(F.col("month") <= last) if last else rows).drop("month")
    return rows
