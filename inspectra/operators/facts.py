"""Facts for all establishments and periods at once. K is the key of an assessment.

Held rows (needs_review) leave first. Each fact table is dealt by K or by K and worker once; the
small lookups (rates, establishments) are left to Spark's size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.functions import predicates as p
from inspectra.plans.materialise import stored
from inspectra.plans.registry import query
from inspectra.sources.views import ORACLE_VIEWS, frame

K = ["establishment_id", "period_start", "period_end"]
ESIC_CEILING_PAISE = 2_100_000
# Document types, names by which rules know their counts, and the prose answers that rules read.
DOC_TYPES = [
    "EMPLOYEE_REGISTER", "WAGE_REGISTER", "MUSTER_ROLL", "WAGE_SLIP", "OVERTIME_REGISTER", "DEDUCTION_REGISTER", "EPF_ECR", "ESIC_CHALLAN", "APPOINTMENT_LETTER", "ESTABLISHMENT_REGISTRATION", "CONTRACTOR_LICENCE",
    "BOCW_CESS_RECEIPT", "ACCIDENT_REGISTER", "HEALTH_CHECKUP_RECORD", "WELFARE_FACILITY_RECORD", "STANDING_ORDERS", "GRIEVANCE_COMMITTEE_RECORD", "LEAVE_REGISTER", "ANNUAL_RETURN", "UNKNOWN",
]
DOC_ALIASES = {
    "works_committee": "GRIEVANCE_COMMITTEE_RECORD", "grievance_committee": "GRIEVANCE_COMMITTEE_RECORD", "creche_record": "WELFARE_FACILITY_RECORD", "canteen_record": "WELFARE_FACILITY_RECORD",
    "health_checkup": "HEALTH_CHECKUP_RECORD",
}
PROSE_FLAGS = [
    "states_employee_name", "states_designation", "states_date_of_joining", "states_wage_rate", "states_working_hours", "is_signed_by_employer",
    "has_chairperson", "is_certified", "adopts_model_standing_orders", "covers_classification_of_workers", "covers_disciplinary_procedure", "covers_termination",
]
PROSE_NUMBERS = ["grievance_committee_members", "grievance_committee_women", "grievance_committee_employer_reps", "grievance_committee_worker_reps", "strike_notice_days", "total_workers"]
USABLE = ["EXTRACTED", "NEEDS_REVIEW", "VERIFIED", "EVALUATED"]


#: Months of assessed periods that are broadcast at most (some 50 MB); more are joined by a shuffle.
FEW_MONTHS = 500_000


def overlapping(rows: DataFrame, periods: DataFrame, few: bool = False) -> DataFrame:
    """rows whose period overlaps an assessment's. Both sides are spread over the months they touch, so the range
    condition becomes an equi-join; a pair is taken in its first common month only. A null bound drops the row. few: the periods were counted (`are_few`) and can be broadcast."""
    month = lambda a, b: F.explode(F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month")))
    left = rows.where("period_start <= period_end").withColumn("_month", month("period_start", "period_end"))
    right = periods.select("establishment_id", F.col("period_start").alias("on_start"), F.col("period_end").alias("on_end")).where("on_start <= on_end")
    right = right.withColumn("_month", month("on_start", "on_end"))
    pair = left.join(F.broadcast(right) if few else right, ["establishment_id", "_month"]).where("period_start <= on_end and period_end >= on_start")
    return pair.where(F.col("_month") == F.trunc(F.greatest("period_start", "on_start"), "month")).drop("_month")


def are_few(periods: DataFrame) -> bool:
    months = F.months_between(F.trunc("period_end", "month"), F.trunc("period_start", "month")) + 1
    return (periods.where("period_start <= period_end").agg(F.sum(months)).first()[0] or 0) <= FEW_MONTHS


def in_periods(rows: DataFrame, periods: DataFrame, few: bool = False) -> DataFrame:
    """F1 for facts: rows under the key of each assessed period that theirs overlaps, in place of their own period."""
    own = [x for x in rows.columns if x not in K]
    return overlapping(rows, periods, few).select("establishment_id", F.col("on_start").alias("period_start"), F.col("on_end").alias("period_end"), *own)


#: Different periods of all establishments that are broadcast at most.
FEW_PERIODS = 10_000


def common_periods(periods: DataFrame) -> DataFrame | None:
    """The different (on_start, on_end) of all establishments, if they are few and no two of them overlap (months, say); else None. Rows meet them without a shuffle."""
    found = periods.where("period_start <= period_end").select("period_start", "period_end").distinct().limit(FEW_PERIODS + 1).collect()
    spans = sorted((r.period_start, r.period_end) for r in found)
    if len(spans) > FEW_PERIODS or any(a[1] >= b[0] for a, b in zip(spans, spans[1:])):
        return None
    return periods.sparkSession.createDataFrame(spans, "on_start date, on_end date")


def in_common_periods(rows: DataFrame, common: DataFrame) -> DataFrame:
    """F1 as `in_periods`, for `common_periods`: rows also come under periods that are assessed for other establishments only; these have to be left out later."""
    month = lambda a, b: F.explode(F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month")))
    left = rows.where("period_start <= period_end").withColumn("_month", month("period_start", "period_end"))
    pair = left.join(F.broadcast(common.withColumn("_month", month("on_start", "on_end"))), "_month").where("period_start <= on_end and period_end >= on_start")
    pair = pair.where(F.col("_month") == F.trunc(F.greatest("period_start", "on_start"), "month"))
    return pair.select("establishment_id", F.col("on_start").alias("period_start"), F.col("on_end").alias("period_end"), *(x for x in rows.columns if x not in K))


def of_batch(documents: DataFrame, members: DataFrame) -> DataFrame:
    """(batch_id, document columns): documents of the batches under assessment, in each batch that holds them."""
    return members.select("batch_id", "document_id").distinct().join(documents.drop("batch_id"), "document_id")


def rates_as_of(rates: DataFrame, wanted: DataFrame) -> DataFrame:
    """for each (state_code, on) of wanted and each skill category the rate with the latest effective_from up to then; the end date is not looked at."""
    known = wanted.join(rates, "state_code").where("effective_from <= on")
    return known.groupBy("state_code", "on", "skill_category").agg(F.max_by("daily_rate_paise", "effective_from").alias("daily_rate_paise"), F.max("effective_from").alias("effective_from"))


def wage_floors(rates: DataFrame, wanted: DataFrame) -> DataFrame:
    """The unskilled rate, or else the lowest: (state_code, on, floor_paise)."""
    found = rates_as_of(rates, wanted).groupBy("state_code", "on")
    return found.agg(F.coalesce(F.max(F.when(F.col("skill_category") == "UNSKILLED", F.col("daily_rate_paise"))), F.min("daily_rate_paise")).alias("floor_paise"))


def period_floors(rates: DataFrame, establishments: DataFrame, periods: DataFrame) -> DataFrame:
    at = periods.join(establishments.select("establishment_id", "state_code"), "establishment_id")
    floors = wage_floors(rates, at.select("state_code", F.col("period_end").alias("on")).distinct())
    return at.join(floors.withColumnRenamed("on", "period_end"), ["state_code", "period_end"], "left").select(*K, "floor_paise")


#: Establishments with their states that are broadcast at most (some 80 MB); more are joined by a shuffle.
FEW_ESTABLISHMENTS = 1_000_000


def with_floors(rows: DataFrame, rates: DataFrame, establishments: DataFrame, periods: DataFrame) -> DataFrame:
    """rows with the floor_paise of their establishment's state at their period's end. Floors are as many as states and period ends, so they are broadcast, establishments are counted first; no row is shuffled for them."""
    states = establishments.select("establishment_id", "state_code")
    states = F.broadcast(states) if states.count() <= FEW_ESTABLISHMENTS else states
    ends = periods.select(F.col("period_end").alias("on")).distinct()
    floors = wage_floors(rates, establishments.select("state_code").distinct().join(F.broadcast(ends))).withColumnRenamed("on", "period_end")
    return rows.join(states, "establishment_id", "left").join(F.broadcast(floors), ["state_code", "period_end"], "left").drop("state_code")


def wage_facts(wages: DataFrame, attendance: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """wage rows (with their floor_paise, or floors by K) and the derived columns; days and overtime from the worker's attendance row of the highest row_number (of equal ones the largest values) where the register has none."""
    seen = attendance.groupBy(*K, "worker_key").agg(F.max_by(F.struct("days_present", "overtime_hours"), F.struct("row_number", F.coalesce("days_present", F.lit(-1.0)), F.coalesce("overtime_hours", F.lit(-1.0)))).alias("_seen"))
    rows = wages.where(~p.truth("needs_review")).join(seen, [*K, "worker_key"], "left")
    rows = rows.withColumns({"days_present": F.coalesce("days_present", "_seen.days_present"), "overtime_hours": F.coalesce("overtime_hours", "_seen.overtime_hours")}).drop("_seen")
    rows = rows.withColumns({"statutory_wages_paise": p.statutory_wages(), "total_remuneration_paise": p.total_remuneration()})
    rows = rows.withColumns(
        {
            "daily_wage_paise": p.ratio("statutory_wages_paise", "days_paid"),
            "deduction_share": p.ratio("deductions_paise", "total_remuneration_paise"),
            "excluded_share": p.ratio("other_allowances_paise", "total_remuneration_paise"),
            "hourly_rate_paise": p.ordinary_hourly_rate("statutory_wages_paise"),
            "settlement_days": p.days_between("date_of_exit", "paid_on"),
            "unpaid_days": F.col("days_present") - F.col("days_paid"),
            "display_rate_paise": F.when(F.col("normal_hours_per_day") > 0, p.to_int(p.ratio("statutory_wages_paise", F.col("days_paid") * F.col("normal_hours_per_day")))),
            "row_verified": ~p.truth("needs_review"),
            "esic_eligible_worker_key": F.when(F.col("total_remuneration_paise") <= ESIC_CEILING_PAISE, F.col("worker_key")),
        }
    )
    if floors is not None:
        rows = rows.join(floors, K, "left")
    if "floor_paise" not in rows.columns:
        return rows
    below = F.col("daily_wage_paise") < F.col("floor_paise")
    return rows.withColumn("shortfall_vs_floor_paise", F.when(below, F.col("floor_paise") - F.col("daily_wage_paise")))


def contribution_facts(lines: DataFrame, wages: DataFrame) -> DataFrame:
    """contribution rows with the statutory wages of the same worker; of several wage rows that of the highest row_number with wages."""
    last = wages.where("statutory_wages_paise is not null").groupBy(*K, "worker_key").agg(F.max_by("statutory_wages_paise", F.struct("row_number", "statutory_wages_paise")).alias("register_wages_paise"))
    return lines.join(last, [*K, "worker_key"], "left")


def incident_facts(incidents: DataFrame, periods: DataFrame) -> DataFrame:
    """incidents inside a period with their notification delay."""
    rows = incidents.withColumn("_month", F.trunc("occurred_on", "month"))
    spread = periods.where("period_start <= period_end").withColumn("_month", F.explode(F.sequence(F.trunc("period_start", "month"), F.trunc("period_end", "month"), F.expr("interval 1 month"))))
    found = rows.join(spread, ["establishment_id", "_month"]).where("occurred_on between period_start and period_end")
    return found.withColumn("delay_days", p.days_between("occurred_on", "notified_on")).drop("_month")


def incident_totals(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*K).agg(
        p.count_rows().alias("incidents_total"), F.count("notified_on").alias("incidents_notified"), F.count_if(F.col("notified_on").isNull()).alias("incidents_unnotified")
    )


def contractor_facts(contractors: DataFrame, run_date: str) -> DataFrame:
    """one row per establishment; an open licence end has not lapsed."""
    expired = p.is_expired("licence_valid_to", F.lit(run_date).cast("date"))
    none = p.is_missing("licence_number", "text") | expired
    return contractors.groupBy("establishment_id").agg(
        p.count_rows().alias("contractors_total"),
        F.count_if(expired).alias("contractors_expired"),
        F.count_if(none).alias("without_valid_licence"),
        F.count_if(p.truth(F.col("deployed_worker_count") > F.col("licensed_worker_count"))).alias("over_deployed"),
        p.total("deployed_worker_count").cast("long").alias("deployed"),
        p.total("licensed_worker_count").cast("long").alias("licensed"),
    )


def registration_facts(registrations: DataFrame, on: str) -> DataFrame:
    """per establishment and kind the registration valid on the date, else the one valid longest; open ends last in that order. Highest `filed` breaks ties."""
    day = F.lit(on).cast("date")
    valid = p.truth(F.col("valid_from") <= day) & ~p.is_expired("valid_to", day)
    best = registrations.withColumn("_valid", valid).groupBy("establishment_id", "kind")
    order = F.struct(F.col("_valid"), F.coalesce(F.col("valid_to"), F.lit("0001-01-01").cast("date")), F.col("filed"))
    return best.agg(
        F.max_by("number", order).alias("number"), F.max_by("valid_to", order).alias("valid_to"), F.max("_valid").alias("has_valid"), F.count_if(p.is_expired("valid_to", day)).alias("expired_count")
    )


def prose_typed(value: Column | str) -> dict[str, Column]:
    """An answer as truth value, number, date and text; exactly one is filled."""
    text = F.trim(p.col(value))
    flag = F.when(F.lower(text).isin("yes", "true", "y"), True).when(F.lower(text).isin("no", "false", "n"), False)
    number = F.when(flag.isNull(), F.translate(text, ",₹", "").try_cast("double"))
    date = F.when(flag.isNull() & number.isNull(), text.try_cast("date"))
    return {"v_flag": flag, "v_number": number, "v_date": date, "v_text": F.when(flag.isNull() & number.isNull() & date.isNull(), text)}


def prose_facts(assertions: DataFrame) -> DataFrame:
    """one row per establishment, the latest answer of each key. Not present: null, not stated. Periods do not matter."""
    latest = assertions.groupBy("establishment_id", "key").agg(F.max_by(F.struct("present", "value_text"), F.struct("created_at", "assertion_id")).alias("a"))
    rows = latest.select("establishment_id", "key", p.truth("a.present").alias("stated"), F.when(p.truth("a.present"), F.col("a.value_text")).alias("value"))
    rows = rows.withColumns(prose_typed("value"))
    pick = lambda key, c: F.max(F.when(F.col("key") == key, c))
    # A flag that is stated but is neither yes nor no is false: it answers the question, not with yes.
    flags = [pick(k, F.when(F.col("stated"), p.truth("v_flag"))).alias(k) for k in PROSE_FLAGS]
    numbers = [pick(k, F.col("v_number")).alias(k) for k in PROSE_NUMBERS]
    texts = [p.truth(F.bool_or((F.col("key") == k) & F.col("stated") & F.col("v_number").isNull())).alias(f"{k}_not_number") for k in PROSE_NUMBERS]
    return rows.groupBy("establishment_id").agg(*flags, *numbers, *texts)


def document_counts(documents: DataFrame) -> DataFrame:
    """usable documents per K by type and by the names that rules use, zero-filled."""
    rows = documents.where(F.col("status").isin(USABLE) & F.col("period_start").isNotNull())
    names = {t.lower(): t for t in DOC_TYPES} | DOC_ALIASES
    by_type = [F.count_if(F.col("doc_type").eqNullSafe(t)).alias(f"{name}_count") for name, t in names.items()]
    return rows.groupBy(*K).agg(*by_type, F.count_if(F.col("status") == "NEEDS_REVIEW").alias("needs_review_count"), p.count_rows().alias("documents_total"))


def register_counts(people: DataFrame, documents: DataFrame) -> DataFrame:
    """(K, register_count, contract_count, unreviewed_matches) of the people in service within each period for which an employee register was filed. documents: those of the assessed periods."""
    filed = documents.where(F.col("status").isin(USABLE) & (F.col("doc_type") == "EMPLOYEE_REGISTER")).select(*K).distinct()
    exit_day = F.col("date_of_exit") if "date_of_exit" in people.columns else F.lit(None).cast("date")
    there = (F.col("date_of_joining").isNull() | (F.col("date_of_joining") <= F.col("period_end"))) & (F.col("date_of_exit").isNull() | (F.col("date_of_exit") >= F.col("period_start")))
    weak = F.coalesce(F.col("match_confidence"), F.lit(1.0)) < 0.9 if "match_confidence" in people.columns else F.lit(False)
    seen = p.truth("match_reviewed") if "match_reviewed" in people.columns else F.lit(False)
    # People with the same days of service are counted together first, so that days meet periods, not persons.
    rows = people.withColumns({"date_of_exit": exit_day, "_contract": p.truth("is_contract_worker"), "_weak": weak & ~seen})
    days = ["establishment_id", "date_of_joining", "date_of_exit"]
    sums = rows.groupBy(*days).agg(F.lit(0).cast("long").alias("persons"), F.count_if("_contract").alias("contract"), F.count_if("_weak").alias("weak"))
    # A person in several rows counts once: each stretch of service adds one where it meets a period, and takes one away where an earlier stretch meets it too.
    first, last = (F.lit(x).cast("date") for x in ("0001-01-01", "9999-12-31"))
    stretch = F.struct(F.coalesce("date_of_joining", first).alias("a"), F.coalesce("date_of_exit", last).alias("b"))
    each = rows.where(F.col("identity_id").isNotNull()).groupBy("establishment_id", "identity_id").agg(F.array_sort(F.collect_set(stretch)).alias("s"))
    signed = lambda x, b, n: F.struct(x["a"].alias("a"), b.alias("b"), F.lit(n).alias("n"))
    again = F.transform("s", lambda x, i: F.when(i > 0, signed(x, F.least(x["b"], F.array_max(F.transform(F.slice("s", F.lit(1), i), lambda y: y["b"]))), -1)))
    both = F.concat(F.transform("s", lambda x: signed(x, x["b"], 1)), F.array_compact(again))
    none = F.lit(0).cast("long")
    persons = each.select("establishment_id", F.inline(both)).groupBy("establishment_id", F.nullif("a", first).alias("date_of_joining"), F.nullif("b", last).alias("date_of_exit")).agg(F.sum("n").alias("persons"), none.alias("contract"), none.alias("weak"))
    met = filed.join(sums.unionByName(persons), "establishment_id").where(there)
    return met.groupBy(*K).agg(F.sum("persons").alias("register_count"), F.sum("contract").alias("contract_count"), F.sum("weak").alias("unreviewed_matches"))


def headcounts(wages: DataFrame, lines: DataFrame, registers: DataFrame | None = None, prose: DataFrame | None = None) -> DataFrame:
    """F8: distinct workers per K in each source, and uncovered_workers, the wage rows of workers without an EPF line: one row per worker first, with the sources that know him, then sums; no row is multiplied. The annual return is the prose answer total_workers.
    A source that is not given or has no row counts 0, the annual return null."""
    keys = wages.select(*K, "worker_key", F.lit("WAGES").alias("source"), F.col("esic_eligible_worker_key").isNotNull().alias("eligible")).unionByName(
        lines.select(*K, "worker_key", F.col("scheme").alias("source"), F.lit(False).alias("eligible"))
    )
    seen = {"wage_count": F.col("source") == "WAGES", "epf_count": F.col("source") == "EPF", "esic_count": F.col("source") == "ESIC", "esic_eligible_count": F.col("eligible")}
    each = keys.groupBy(*K, "worker_key").agg(*(F.bool_or(test).alias(name) for name, test in seen.items()), F.count_if(F.col("source") == "WAGES").alias("wage_rows"))
    known = F.col("worker_key").isNotNull()
    uncovered = F.sum(F.when(known & ~F.col("epf_count"), F.col("wage_rows")).otherwise(0)).alias("uncovered_workers")
    counts = each.groupBy(*K).agg(*(F.count_if(F.col(name) & known).alias(name) for name in seen), uncovered)
    counts = counts.join(registers.select(*K, "register_count"), K, "left") if registers is not None else counts.withColumn("register_count", F.lit(None).cast("long"))
    told = prose.select("establishment_id", F.col("total_workers").alias("annual_return_workers")) if prose is not None else None
    counts = counts.join(told, "establishment_id", "left") if told is not None else counts.withColumn("annual_return_workers", F.lit(None).cast("double"))
    return counts.fillna(0, ["register_count"])


def establishment_facts(establishments: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts are the largest of what was declared and what was seen; women's share is 0 without workers."""
    rows = counts.join(establishments.where("is_active"), "establishment_id")
    told = F.when(F.col("annual_return_workers") >= 0, p.to_int("annual_return_workers"))
    effective = F.greatest(F.col("worker_count").cast("long"), "register_count", "wage_count", "epf_count", "esic_count", told.cast("long")).cast("long")
    return rows.select(
        *K, "state_code", "nic_code", "organisation_id", effective.alias("worker_count"), F.greatest(F.col("worker_count_peak_12m"), effective).cast("long").alias("worker_count_peak_12m"),
        F.col("women_worker_count").cast("long").alias("women_worker_count"), F.col("contract_worker_count").cast("long").alias("contract_worker_count"), "engages_contract_labour", "is_factory",
        F.coalesce(p.ratio("women_worker_count", effective), F.lit(0.0)).alias("women_ratio"), "register_count", "wage_count", "epf_count", "esic_count", "esic_eligible_count", "annual_return_workers", "uncovered_workers",
    )


def period_facts(periods: DataFrame) -> DataFrame:
    """inclusive days and pay basis."""
    days = F.datediff("period_end", "period_start") + 1
    basis = F.when(days <= 1, "daily").when(days <= 8, "weekly").when(days <= 16, "fortnightly").when(days <= 31, "monthly").otherwise("longer")
    return periods.select(*K, days.alias("period_days"), basis.alias("period_basis"))


def wage_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The join that wage, attendance and contribution views are made of, worked out once for all of them."""
    return {"x_wage_base": stored(frame(spark, sf_dir, "x_wage_base"))}


def all_wage_facts(spark: SparkSession, sf_dir: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    given = given or wage_views(spark, sf_dir)
    wages, est = frame(spark, sf_dir, "x_wage_line", given), frame(spark, sf_dir, "x_establishment")
    rows = with_floors(wages, frame(spark, sf_dir, "x_minimum_wage_rate"), est, given["x_wage_base"])
    return wage_facts(rows, frame(spark, sf_dir, "x_attendance", given))


ORACLE_VIEWS["x_o_seen"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY establishment_id, period_start, period_end, worker_key ORDER BY row_number DESC, coalesce(days_present, -1) DESC, coalesce(overtime_hours, -1) DESC) AS rn FROM x_attendance) WHERE rn = 1
"""
ORACLE_VIEWS["x_o_floor"] = """
SELECT k.establishment_id, k.period_start, k.period_end, coalesce(max(daily_rate_paise) FILTER (WHERE skill_category = 'UNSKILLED'), min(daily_rate_paise)) AS floor_paise
FROM (SELECT DISTINCT establishment_id, period_start, period_end FROM x_wage_line) k JOIN x_establishment e USING (establishment_id)
LEFT JOIN LATERAL (SELECT r.skill_category, r.daily_rate_paise FROM x_minimum_wage_rate r WHERE r.state_code = e.state_code AND r.effective_from <= k.period_end
  QUALIFY row_number() OVER (PARTITION BY r.skill_category ORDER BY r.effective_from DESC) = 1) r ON true
GROUP BY ALL
"""
ORACLE_VIEWS["x_o_wage"] = f"""
SELECT *, paid_on - date_of_exit AS settlement_days, days_present - days_paid AS unpaid_days,
       CASE WHEN normal_hours_per_day > 0 AND days_paid > 0 THEN trunc(statutory_wages_paise / (days_paid * normal_hours_per_day))::BIGINT END AS display_rate_paise,
       statutory_wages_paise::DOUBLE / nullif(days_paid, 0) AS daily_wage_paise,
       deductions_paise::DOUBLE / nullif(total_remuneration_paise, 0) AS deduction_share,
       other_allowances_paise::DOUBLE / nullif(total_remuneration_paise, 0) AS excluded_share,
       CASE WHEN statutory_wages_paise <> 0 AND days_paid > 0 THEN statutory_wages_paise::DOUBLE / (days_paid * coalesce(nullif(normal_hours_per_day, 0), 8)) END AS hourly_rate_paise,
       CASE WHEN total_remuneration_paise <= {ESIC_CEILING_PAISE} THEN worker_key END AS esic_eligible_worker_key,
       CASE WHEN statutory_wages_paise::DOUBLE / nullif(days_paid, 0) < floor_paise THEN floor_paise - statutory_wages_paise::DOUBLE / nullif(days_paid, 0) END AS shortfall_vs_floor_paise
FROM (SELECT w.* EXCLUDE (days_present, overtime_hours), coalesce(w.days_present, a.days_present) AS days_present, coalesce(w.overtime_hours, a.overtime_hours) AS overtime_hours,
             CASE WHEN basic_paise IS NOT NULL OR da_paise IS NOT NULL THEN coalesce(basic_paise, 0) + coalesce(da_paise, 0) END AS statutory_wages_paise,
             CASE WHEN coalesce(basic_paise, da_paise, other_allowances_paise) IS NULL THEN gross_paise
                  ELSE coalesce(basic_paise, 0) + coalesce(da_paise, 0) + coalesce(other_allowances_paise, 0) END AS total_remuneration_paise, f.floor_paise
      FROM x_wage_line w LEFT JOIN x_o_seen a USING (establishment_id, period_start, period_end, worker_key) LEFT JOIN x_o_floor f USING (establishment_id, period_start, period_end)
      WHERE NOT needs_review)
"""
ORACLE_VIEWS["x_o_lines"] = """
SELECT c.*, r.register_wages_paise FROM x_contribution c LEFT JOIN (
  SELECT establishment_id, period_start, period_end, worker_key, statutory_wages_paise AS register_wages_paise FROM x_o_wage WHERE statutory_wages_paise IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY establishment_id, period_start, period_end, worker_key ORDER BY row_number DESC, statutory_wages_paise DESC) = 1) r USING (establishment_id, period_start, period_end, worker_key)
"""
ORACLE_VIEWS["x_o_incident"] = """
SELECT i.*, k.period_start, k.period_end, notified_on - occurred_on AS delay_days
FROM x_incident i JOIN (SELECT DISTINCT establishment_id, period_start, period_end FROM x_document) k ON i.establishment_id = k.establishment_id AND occurred_on BETWEEN k.period_start AND k.period_end
"""
ORACLE_VIEWS["x_o_register"] = """
SELECT k.establishment_id, k.period_start, k.period_end, count(DISTINCT identity_id) AS register_count, count(*) FILTER (WHERE is_contract_worker) AS contract_count
FROM (SELECT DISTINCT establishment_id, period_start, period_end FROM x_document WHERE doc_type = 'EMPLOYEE_REGISTER' AND status IN ('EXTRACTED', 'NEEDS_REVIEW', 'VERIFIED', 'EVALUATED')) k
JOIN x_identity i ON i.establishment_id = k.establishment_id AND (date_of_joining IS NULL OR date_of_joining <= k.period_end) GROUP BY 1, 2, 3
"""
ORACLE_VIEWS["x_o_counts"] = """
SELECT k.*, coalesce(r.register_count, 0) AS register_count, p.total_workers AS annual_return_workers FROM (
SELECT establishment_id, period_start, period_end, count(DISTINCT worker_key) FILTER (WHERE s = 'WAGES') AS wage_count, count(DISTINCT worker_key) FILTER (WHERE s = 'EPF') AS epf_count,
       count(DISTINCT worker_key) FILTER (WHERE s = 'ESIC') AS esic_count, count(DISTINCT e) AS esic_eligible_count
FROM (SELECT establishment_id, period_start, period_end, worker_key, 'WAGES' AS s, esic_eligible_worker_key AS e FROM x_o_wage
      UNION ALL SELECT establishment_id, period_start, period_end, worker_key, scheme, NULL FROM x_contribution) GROUP BY 1, 2, 3) k
LEFT JOIN x_o_register r ON r.establishment_id = k.establishment_id AND r.period_start = k.period_start AND r.period_end = k.period_end
LEFT JOIN x_o_prose p ON p.establishment_id = k.establishment_id
"""
ORACLE_VIEWS["x_o_estab"] = """
SELECT establishment_id, period_start, period_end, state_code, nic_code, organisation_id, effective AS worker_count, greatest(worker_count_peak_12m, effective)::BIGINT AS worker_count_peak_12m, women_worker_count::BIGINT AS women_worker_count,
       contract_worker_count::BIGINT AS contract_worker_count, engages_contract_labour, is_factory, coalesce(women_worker_count::DOUBLE / nullif(effective, 0), 0) AS women_ratio,
       register_count, wage_count, epf_count, esic_count, esic_eligible_count, annual_return_workers
FROM (SELECT c.*, e.* EXCLUDE (establishment_id), greatest(e.worker_count, register_count, wage_count, epf_count, esic_count, trunc(annual_return_workers))::BIGINT AS effective FROM x_o_counts c JOIN x_establishment e ON c.establishment_id = e.establishment_id AND e.is_active)
"""
_PROSE = ",\n".join(
    [f"max(CASE WHEN key = '{k}' AND stated THEN coalesce(lower(trim(v)) IN ('yes', 'true', 'y'), false) END) AS {k}" for k in PROSE_FLAGS]
    + [f"max(CASE WHEN key = '{k}' AND lower(trim(v)) NOT IN ('yes', 'true', 'y', 'no', 'false', 'n') THEN try_cast(translate(trim(v), ',₹', '') AS DOUBLE) END) AS {k}" for k in PROSE_NUMBERS]
    + [f"coalesce(bool_or(key = '{k}' AND stated AND coalesce(lower(trim(v)) IN ('yes', 'true', 'y', 'no', 'false', 'n') OR try_cast(translate(trim(v), ',₹', '') AS DOUBLE) IS NULL, true)), false) AS {k}_not_number" for k in PROSE_NUMBERS]
)
ORACLE_VIEWS["x_o_prose"] = f"""
SELECT establishment_id, {_PROSE}
FROM (SELECT establishment_id, key, coalesce(present, false) AS stated, CASE WHEN present THEN value_text END AS v FROM x_prose_assertion
      QUALIFY row_number() OVER (PARTITION BY establishment_id, key ORDER BY created_at DESC, assertion_id DESC) = 1) GROUP BY establishment_id
"""
ORACLE_VIEWS["x_o_docs"] = """
SELECT establishment_id, period_start, period_end, count(*) FILTER (WHERE doc_type = 'EMPLOYEE_REGISTER') AS employee_register_count, count(*) FILTER (WHERE doc_type = 'WAGE_REGISTER') AS wage_register_count,
  count(*) FILTER (WHERE doc_type = 'MUSTER_ROLL') AS muster_roll_count, count(*) FILTER (WHERE doc_type = 'WAGE_SLIP') AS wage_slip_count, count(*) FILTER (WHERE doc_type = 'OVERTIME_REGISTER') AS overtime_register_count,
  count(*) FILTER (WHERE doc_type = 'DEDUCTION_REGISTER') AS deduction_register_count, count(*) FILTER (WHERE doc_type = 'EPF_ECR') AS epf_ecr_count, count(*) FILTER (WHERE doc_type = 'ESIC_CHALLAN') AS esic_challan_count,
  count(*) FILTER (WHERE doc_type = 'APPOINTMENT_LETTER') AS appointment_letter_count, count(*) FILTER (WHERE doc_type = 'ESTABLISHMENT_REGISTRATION') AS establishment_registration_count,
  count(*) FILTER (WHERE doc_type = 'CONTRACTOR_LICENCE') AS contractor_licence_count, count(*) FILTER (WHERE doc_type = 'BOCW_CESS_RECEIPT') AS bocw_cess_receipt_count, count(*) FILTER (WHERE doc_type = 'ACCIDENT_REGISTER') AS accident_register_count,
  count(*) FILTER (WHERE doc_type = 'HEALTH_CHECKUP_RECORD') AS health_checkup_record_count, count(*) FILTER (WHERE doc_type = 'WELFARE_FACILITY_RECORD') AS welfare_facility_record_count,
  count(*) FILTER (WHERE doc_type = 'STANDING_ORDERS') AS standing_orders_count, count(*) FILTER (WHERE doc_type = 'GRIEVANCE_COMMITTEE_RECORD') AS grievance_committee_record_count, count(*) FILTER (WHERE doc_type = 'LEAVE_REGISTER') AS leave_register_count,
  count(*) FILTER (WHERE doc_type = 'ANNUAL_RETURN') AS annual_return_count, count(*) FILTER (WHERE doc_type = 'UNKNOWN') AS unknown_count,
  count(*) FILTER (WHERE doc_type = 'GRIEVANCE_COMMITTEE_RECORD') AS works_committee_count, count(*) FILTER (WHERE doc_type = 'GRIEVANCE_COMMITTEE_RECORD') AS grievance_committee_count,
  count(*) FILTER (WHERE doc_type = 'WELFARE_FACILITY_RECORD') AS creche_record_count, count(*) FILTER (WHERE doc_type = 'WELFARE_FACILITY_RECORD') AS canteen_record_count, count(*) FILTER (WHERE doc_type = 'HEALTH_CHECKUP_RECORD') AS health_checkup_count,
  count(*) FILTER (WHERE status = 'NEEDS_REVIEW') AS needs_review_count, count(*) AS documents_total
FROM x_document WHERE status IN ('EXTRACTED', 'NEEDS_REVIEW', 'VERIFIED', 'EVALUATED') AND period_start IS NOT NULL GROUP BY 1, 2, 3
"""


@query("f01_period_overlap", """SELECT d.document_id, d.establishment_id, d.period_start, d.period_end, q.on_start, q.on_end FROM x_document d JOIN
  (SELECT DISTINCT establishment_id, CAST(date_trunc('quarter', period_start) AS DATE) AS on_start, CAST(date_trunc('quarter', period_start) + INTERVAL 3 MONTH AS DATE) - 1 AS on_end FROM x_document) q
  ON d.establishment_id = q.establishment_id AND d.period_start <= q.on_end AND d.period_end >= q.on_start""")
def _f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frame(spark, sf_dir, "x_document")
    quarter = F.trunc("period_start", "quarter")
    quarters = docs.select("establishment_id", quarter.alias("period_start"), F.date_sub(F.add_months(quarter, 3), 1).alias("period_end")).distinct()
    return overlapping(docs.select("document_id", *K), quarters).select("document_id", *K, "on_start", "on_end")


@query("f03_f04_wage_facts", """SELECT establishment_id, period_start, period_end, worker_key, row_number, days_present, overtime_hours, statutory_wages_paise, total_remuneration_paise, daily_wage_paise,
  deduction_share, excluded_share, hourly_rate_paise, settlement_days, unpaid_days, display_rate_paise, true AS row_verified, shortfall_vs_floor_paise, esic_eligible_worker_key FROM x_o_wage""")
def _f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_wage_facts(spark, sf_dir).select(
        *K, "worker_key", "row_number", "days_present", "overtime_hours", "statutory_wages_paise", "total_remuneration_paise", "daily_wage_paise", "deduction_share", "excluded_share",
        "hourly_rate_paise", "settlement_days", "unpaid_days", "display_rate_paise", "row_verified", "shortfall_vs_floor_paise", "esic_eligible_worker_key",
    )


@query("f05_contribution_facts", "SELECT scheme, establishment_id, period_start, period_end, worker_key, row_number, wage_base_paise, register_wages_paise FROM x_o_lines")
def _f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = wage_views(spark, sf_dir)
    found = contribution_facts(frame(spark, sf_dir, "x_contribution", given), all_wage_facts(spark, sf_dir, given))
    return found.select("scheme", *K, "worker_key", "row_number", "wage_base_paise", "register_wages_paise")


@query("f02_f06_incidents", "SELECT establishment_id, period_start, period_end, count(*) AS incidents_total, count(notified_on) AS incidents_notified, count(*) - count(notified_on) AS incidents_unnotified FROM x_o_incident GROUP BY 1, 2, 3")
def _f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident_totals(incident_facts(frame(spark, sf_dir, "x_incident"), frame(spark, sf_dir, "x_document").select(*K).distinct()))


@query("f08_f09_f16_establishments", "SELECT * FROM x_o_estab")
def _f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    registers = register_counts(frame(spark, sf_dir, "x_identity"), frame(spark, sf_dir, "x_document"))
    given = wage_views(spark, sf_dir)
    counts = headcounts(all_wage_facts(spark, sf_dir, given), frame(spark, sf_dir, "x_contribution", given), registers, prose_facts(frame(spark, sf_dir, "x_prose_assertion")))
    return establishment_facts(frame(spark, sf_dir, "x_establishment"), counts).drop("uncovered_workers")


@query("f08_register_counts", "SELECT *, 0 AS unreviewed_matches FROM x_o_register")
def _f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register_counts(frame(spark, sf_dir, "x_identity"), frame(spark, sf_dir, "x_document"))


@query("f07_register_active", """SELECT establishment_id, identity_id, date_of_joining FROM x_identity i WHERE (date_of_joining IS NULL OR date_of_joining <= DATE '1992-06-30')
  AND EXISTS (SELECT 1 FROM x_document d WHERE d.establishment_id = i.establishment_id AND d.doc_type = 'APPOINTMENT_LETTER')""")
def _f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_register(frame(spark, sf_dir, "x_identity"), frame(spark, sf_dir, "x_document"), "1992-01-01", "1992-06-30", "APPOINTMENT_LETTER").select("establishment_id", "identity_id", "date_of_joining")


def active_register(people: DataFrame, documents: DataFrame, start: str, end: str, register_type: str) -> DataFrame:
    """people in service within the period, of establishments that filed a register of the given type at all."""
    exit_day = F.col("date_of_exit") if "date_of_exit" in people.columns else F.lit(None).cast("date")
    there = (F.col("date_of_joining").isNull() | (F.col("date_of_joining") <= F.lit(end).cast("date"))) & (exit_day.isNull() | (exit_day >= F.lit(start).cast("date")))
    return people.where(there).join(documents.where(F.col("doc_type") == register_type).select("establishment_id").distinct(), "establishment_id", "left_semi")


@query("f10_document_counts", "SELECT * FROM x_o_docs")
def _f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_counts(frame(spark, sf_dir, "x_document"))


@query("f11_rates_as_of", "SELECT * FROM x_o_floor")
def _f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_floors(frame(spark, sf_dir, "x_minimum_wage_rate"), frame(spark, sf_dir, "x_establishment"), frame(spark, sf_dir, "x_wage_line").select(*K).distinct())


@query("f12_n16_prose_facts", "SELECT * FROM x_o_prose")
def _f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose_facts(frame(spark, sf_dir, "x_prose_assertion"))


ORACLE_VIEWS["x_o_contractors"] = """
SELECT establishment_id, count(*) AS contractors_total, count(*) FILTER (WHERE coalesce(licence_valid_to < DATE '1998-01-01', false)) AS contractors_expired,
  count(*) FILTER (WHERE licence_number IS NULL OR trim(licence_number) = '' OR coalesce(licence_valid_to < DATE '1998-01-01', false)) AS without_valid_licence,
  count(*) FILTER (WHERE coalesce(deployed_worker_count > licensed_worker_count, false)) AS over_deployed,
  coalesce(sum(deployed_worker_count), 0)::BIGINT AS deployed, coalesce(sum(licensed_worker_count), 0)::BIGINT AS licensed FROM x_contractor GROUP BY 1
"""


@query("f13_contractors", "SELECT * FROM x_o_contractors")
def _f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contractor_facts(frame(spark, sf_dir, "x_contractor"), "1998-01-01")


@query("f14_registrations", """SELECT establishment_id, kind, number, valid_to, bool_or(ok) OVER w AS has_valid, count(*) FILTER (WHERE coalesce(valid_to < DATE '1996-01-01', false)) OVER w AS expired_count
  FROM (SELECT *, valid_from <= DATE '1996-01-01' AND coalesce(valid_to >= DATE '1996-01-01', true) AS ok FROM x_registration) WINDOW w AS (PARTITION BY establishment_id, kind)
  QUALIFY row_number() OVER (PARTITION BY establishment_id, kind ORDER BY ok DESC, valid_to DESC NULLS LAST, filed DESC) = 1""")
def _f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration_facts(frame(spark, sf_dir, "x_registration"), "1996-01-01")


@query("f15_periods", """SELECT DISTINCT establishment_id, period_start, period_end, (period_end - period_start + 1)::INT AS period_days,
  CASE WHEN period_end - period_start + 1 <= 1 THEN 'daily' WHEN period_end - period_start + 1 <= 8 THEN 'weekly' WHEN period_end - period_start + 1 <= 16 THEN 'fortnightly' WHEN period_end - period_start + 1 <= 31 THEN 'monthly' ELSE 'longer' END AS period_basis FROM x_document""")
def _f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_facts(frame(spark, sf_dir, "x_document").select(*K).distinct())
