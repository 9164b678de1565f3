"""Advisory statistical tests, for all groups at once. `by` is the grain, normally K.

Unknown values are left out. Counts come first (one row per group and value), so no group's rows
are gathered; medians are exact, those of large groups by rank.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inspectra.functions import predicates as p
from inspectra.operators import facts
from inspectra.plans.materialise import cut, stored
from inspectra.plans.registry import query
from inspectra.sources.views import ORACLE_VIEWS, frame

c = F.col
YEAR = ["establishment_id", "period_year"]
OUT = ["test", "severity", "sample_size", "statistic", "value"]


def _result(df: DataFrame, by: list[str], test: str, severity: str, sample: Column, statistic: Column, value: Column) -> DataFrame:
    return df.select(*by, F.lit(test).alias("test"), F.lit(severity).alias("severity"), sample.cast("long").alias("sample_size"), statistic.cast("double").alias("statistic"), value.cast("double").alias("value"))


def benford(rows: DataFrame, columns: str | list[str], by: list[str], least: int = 60, critical: float = 20.09) -> DataFrame:
    """A1: chi-square of first digits, for all columns in one pass; value is the share of digit 1."""
    columns = [columns] if isinstance(columns, str) else columns
    digit = lambda x: F.substring(F.abs(c(x)).cast("long").cast("string"), 1, 1).cast("int")
    held = lambda x, test: F.count_if((c(x) != 0) & test)
    counts = rows.groupBy(*by).agg(*(k for i, x in enumerate(columns) for k in (held(x, F.lit(True)).alias(f"n{i}"), *(held(x, digit(x) == d).alias(f"d{i}_{d}") for d in range(1, 10)))))
    each = F.array(*(F.struct(F.lit(f"benford.{x}").alias("test"), c(f"n{i}").alias("n"), *(c(f"d{i}_{d}").alias(f"d{d}") for d in range(1, 10))) for i, x in enumerate(columns)))
    n = counts.select(*by, F.inline(each))
    expected = {d: F.lit(F_EXPECTED[d]) * c("n") for d in range(1, 10)}
    chi = reduce(lambda a, b: a + b, ((c(f"d{d}") - expected[d]) * (c(f"d{d}") - expected[d]) / expected[d] for d in range(1, 10)))
    found = n.where(c("n") >= least).withColumn("chi", chi).where(c("chi") > critical)
    return found.select(*by, "test", F.lit("MEDIUM").alias("severity"), c("n").alias("sample_size"), F.bround("chi", 2).alias("statistic"), F.bround(c("d1") / c("n"), 4).alias("value"))


# log10(1 + 1/d).
F_EXPECTED = {d: math.log10(1 + 1 / d) for d in range(1, 10)}


def median_by_rank(rows: DataFrame, column: str, by: list[str], accuracy: int = 10_000, few: int = 500_000) -> DataFrame:
    """(by, med, n): the exact median of the known values of each group, whatever its size; groups without any have none.

    `median` keeps a group's values in one buffer. Here a sketch of bounded size gives two values between which the middle ranks must lie (its ranks
    err by 1/accuracy at most); what is below is only counted, what lies between is counted by value. Both combine before their shuffles, so one task
    orders some 8/accuracy of a hot group's distinct values, and may spill. The bounds are worked out once; those of up to `few` groups are broadcast (some 40 MB), so the rows are neither
    dealt nor sorted by group before they are counted. More are met by a join that adaptive execution can split."""
    own = rows.where(c(column).isNotNull()).select(*by, c(column).cast("double").alias("_x"))
    slack = 4.0 / accuracy
    bounds = own.groupBy(*by).agg(p.count_rows().alias("n"), F.percentile_approx("_x", [max(0.0, 0.5 - slack), min(1.0, 0.5 + slack)], accuracy).alias("_b"))
    # Small groups: the sketch is exact there, but the slack is less than the step from one middle value to the other.
    low = F.when(c("n") > accuracy, c("_b")[0])
    high = F.when(c("n") > accuracy, c("_b")[1])
    bounds = cut(bounds.select(*by, "n", low.alias("_low"), high.alias("_high")))
    near = own.join(F.broadcast(bounds) if bounds.count() <= few else bounds, by).where("_high is null or _x <= _high")
    counted = near.groupBy(*by, "n", F.when(c("_low").isNull() | (c("_x") >= c("_low")), c("_x")).alias("_v")).agg(p.count_rows().alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")))
    ranked = counted.withColumn("_to", upto)
    at = lambda rank: F.min(F.when(c("_to") > rank, c("_v")))
    return ranked.groupBy(*by, "n").agg(at(F.floor((c("n") - 1) / 2)).alias("_a"), at(F.floor(c("n") / 2)).alias("_b")).select(*by, (0.5 * c("_a") + 0.5 * c("_b")).alias("med"), "n")


def hot_groups(rows: DataFrame, by: list[str], large: int = 1_000_000) -> DataFrame | None:
    """The groups of more than `large` rows, or None. A table of at most total / large rows; one count decides whether there are any.
    It is not kept: where there are some, they are counted again, which combines before its shuffle."""
    found = rows.groupBy(*by).agg(p.count_rows().alias("_n")).where(c("_n") > large).select(*by)
    return None if found.isEmpty() else found


def medians(rows: DataFrame, column: str, by: list[str], hot: DataFrame | None = None) -> DataFrame:
    """(by, med, n): exact medians, in one buffer a group, but by rank for the groups of `hot`."""
    plain = rows if hot is None else rows.join(hot, by, "left_anti")
    out = plain.where(c(column).isNotNull()).groupBy(*by).agg(F.median(c(column).cast("double")).alias("med"), p.count_rows().alias("n"))
    if hot is None:
        return out
    ranked = median_by_rank(rows.join(hot, by, "left_semi"), column, by).select(*by, c("med").alias("_med"), c("n").alias("_n"))
    # No group is on both sides: a full join is their union, dealt by group for the joins that follow.
    return out.join(ranked, by, "full_outer").select(*by, F.coalesce("med", "_med").alias("med"), F.coalesce("n", "_n").alias("n"))


def outliers(rows: DataFrame, column: str, by: list[str], least: int = 8, threshold: float = 3.5, hot: DataFrame | None = None) -> DataFrame:
    """A2: robust z-scores; statistic is the number of outliers, value the largest absolute score. hot: the groups whose medians are found by rank."""
    own = rows.where(c(column).isNotNull()).select(*by, c(column).cast("double").alias("x"))
    spread = own.join(medians(own, "x", by, hot).where(c("n") >= least), by)
    mad = medians(spread.select(*by, F.abs(c("x") - c("med")).alias("d")), "d", by, hot).select(*by, c("med").alias("mad")).where("mad <> 0")
    z = F.abs(0.6745 * (c("x") - c("med")) / c("mad"))
    found = spread.join(mad, by).withColumn("z", z).where(c("z") >= threshold).groupBy(*by).agg(F.first("n").alias("n"), p.count_rows().alias("k"), F.max("z").alias("z"))
    return _result(found, by, f"outlier.{column}", "LOW", c("n"), c("k"), F.bround("z", 2))


def _top(rows: DataFrame, column: str, other: str, by: list[str]) -> DataFrame:
    """The commonest value of each group with its count, distinct `other` values and the group's size; the smallest value of equally common ones."""
    each = rows.groupBy(*by, c(column).alias("v")).agg(p.count_rows().alias("k"), p.unique_count(other).alias("others"))
    return each.groupBy(*by).agg(F.sum("k").alias("n"), F.max_by(F.struct("v", "k", "others"), F.struct("k", -c("v"))).alias("t")).select(*by, "n", "t.*")


def duplicates(rows: DataFrame, column: str, by: list[str], least: int = 8, share: float = 0.35) -> DataFrame:
    """A3: one amount for workers with differing days. value is the amount."""
    top = _top(rows.where(c(column) != 0), column, "days_paid", by)
    found = top.where((c("n") >= least) & (c("k") >= 4) & (c("k") / c("n") >= share) & (c("others") > 1))
    return _result(found, by, f"duplicates.{column}", "MEDIUM", c("n"), F.bround(c("k") / c("n"), 3), c("v"))


def round_amounts(rows: DataFrame, column: str, by: list[str], least: int = 8, share: float = 0.7, step: int = 50_000) -> DataFrame:
    """A4"""
    n = rows.where(c(column) != 0).groupBy(*by).agg(p.count_rows().alias("n"), F.count_if(c(column) % step == 0).alias("k"))
    return _result(n.where((c("n") >= least) & (c("k") / c("n") >= share)), by, f"round_numbers.{column}", "LOW", c("n"), F.bround(c("k") / c("n"), 3), c("k"))


def zero_variance(rows: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """A5"""
    n = rows.groupBy(*by).agg(F.count("days_present").alias("n"), F.min("days_present").alias("a"), F.max("days_present").alias("b"), F.max("days_absent").alias("absent"))
    found = n.where((c("n") >= least) & (c("a") == c("b")) & (F.coalesce("absent", F.lit(0.0)) <= 0))
    return _result(found, by, "attendance.zero_variance", "MEDIUM", c("n"), c("n"), c("a"))


def uniform_base(lines: DataFrame, by: list[str], least: int = 8, share: float = 0.6) -> DataFrame:
    """A6"""
    pairs = lines.where("wage_base_paise is not null and register_wages_paise <> 0")
    top = _top(pairs, "wage_base_paise", "register_wages_paise", by)
    found = top.where((c("n") >= least) & (c("k") / c("n") >= share) & (c("others") > 1))
    return _result(found, by, "epf.uniform_wage_base", "HIGH", c("n"), F.bround(c("k") / c("n"), 3), c("v"))


def peer_values(wages: DataFrame, establishments: DataFrame) -> DataFrame:
    """Sum of wages over sum of days of the *other* establishments of the same sector and state, over all periods: totals less the own ones."""
    own = wages.where("basic_paise is not null and basic_paise > 0 and days_paid > 0").groupBy("establishment_id").agg(
        F.sum(c("basic_paise") + F.coalesce("da_paise", F.lit(0).cast("long"))).alias("pay"), F.sum("days_paid").alias("days")
    )
    rows = establishments.select("establishment_id", "nic_code", "state_code").join(own, "establishment_id", "left").fillna(0, ["pay", "days"])
    total = rows.groupBy("nic_code", "state_code").agg(F.sum("pay").alias("all_pay"), F.sum("days").alias("all_days"))
    return rows.join(total, ["nic_code", "state_code"]).select("establishment_id", p.ratio(c("all_pay") - c("pay"), c("all_days") - c("days")).alias("peer_paise"))


def peer_gap(rows: DataFrame, peers: DataFrame, by: list[str], least: int = 8, share: float = 0.7, hot: DataFrame | None = None) -> DataFrame:
    """The median daily wage is well below the peers'. hot: the groups whose medians are found by rank."""
    own = medians(rows, "daily_wage_paise", by, hot).where(c("n") >= least)
    found = own.join(peers, "establishment_id").where(c("med") < c("peer_paise") * share)
    return _result(found, by, "peer.daily_wage_below_median", "LOW", c("n"), F.bround(c("med") / c("peer_paise"), 3), F.bround("peer_paise", 2))


def all_tests(wages: DataFrame, attendance: DataFrame, epf: DataFrame, peers: DataFrame, by: list[str]) -> DataFrame:
    """A9. Medians of groups of over a million rows are found by rank. Each test's findings, few rows, are stored before the next one begins: in one job the shuffles of all of them lie on the disks at once."""
    hot, shifts = hot_groups(wages, by), hot_groups(attendance, by)
    parts = [benford(wages, ["gross_paise", "net_paid_paise"], by), outliers(wages, "daily_wage_paise", by, hot=hot), outliers(wages, "deduction_share", by, hot=hot), outliers(attendance, "overtime_hours", by, hot=shifts),
             duplicates(wages, "gross_paise", by), duplicates(wages, "net_paid_paise", by), round_amounts(wages, "gross_paise", by), zero_variance(attendance, by), uniform_base(epf, by), peer_gap(wages, peers, by, hot=hot)]
    return reduce(DataFrame.unionByName, map(stored, parts))


ORACLE_VIEWS["x_o_dev"] = """
SELECT establishment_id, period_year, 'daily_wage_paise' AS f, daily_wage_paise::DOUBLE AS x FROM x_o_wage WHERE daily_wage_paise IS NOT NULL
UNION ALL SELECT establishment_id, period_year, 'deduction_share', deduction_share FROM x_o_wage WHERE deduction_share IS NOT NULL
UNION ALL SELECT establishment_id, period_year, 'overtime_hours', overtime_hours FROM x_attendance WHERE overtime_hours IS NOT NULL
"""


def _benford_sql(f: str) -> str:
    chi = " + ".join(f"(d{d} - {F_EXPECTED[d]!r} * n) * (d{d} - {F_EXPECTED[d]!r} * n) / ({F_EXPECTED[d]!r} * n)" for d in range(1, 10))
    digits = ", ".join(f"count(*) FILTER (WHERE left(abs({f})::VARCHAR, 1) = '{d}') AS d{d}" for d in range(1, 10))
    return f"""SELECT establishment_id, period_year, 'benford.{f}' AS test, 'MEDIUM' AS severity, n AS sample_size, round_even({chi}, 2) AS statistic, round_even(d1 / n, 4) AS value
    FROM (SELECT establishment_id, period_year, count(*) AS n, {digits} FROM x_o_wage WHERE {f} <> 0 GROUP BY 1, 2) WHERE n >= 60 AND {chi} > 20.09"""


_OUTLIER_SQL = """SELECT establishment_id, period_year, 'outlier.' || f AS test, 'LOW' AS severity, any_value(n) AS sample_size, count(*)::DOUBLE AS statistic, round_even(max(z), 2) AS value
 FROM (SELECT establishment_id, period_year, f, n, abs(0.6745 * (x - med) / mad) AS z FROM (SELECT *, median(abs(x - med)) OVER (PARTITION BY establishment_id, period_year, f) AS mad
 FROM (SELECT *, median(x) OVER w AS med, count(*) OVER w AS n FROM x_o_dev WINDOW w AS (PARTITION BY establishment_id, period_year, f))) WHERE n >= 8 AND mad <> 0) WHERE z >= 3.5 GROUP BY 1, 2, f"""


def _top_sql(test: str, severity: str, source: str, f: str, other: str, where: str) -> str:
    return f"""SELECT establishment_id, period_year, '{test}' AS test, '{severity}' AS severity, n AS sample_size, round_even(k / n, 3) AS statistic, v::DOUBLE AS value FROM (
    SELECT *, sum(k) OVER (PARTITION BY establishment_id, period_year)::BIGINT AS n, row_number() OVER (PARTITION BY establishment_id, period_year ORDER BY k DESC, v) AS rn FROM (
    SELECT establishment_id, period_year, {f} AS v, count(*) AS k, count(DISTINCT {other}) AS others FROM {source} GROUP BY 1, 2, 3)) WHERE rn = 1 AND {where}"""


PEER_SQL = """SELECT establishment_id, (sum(pay) OVER w - pay)::DOUBLE / nullif(sum(days) OVER w - days, 0) AS peer_paise FROM (
 SELECT e.establishment_id, nic_code, state_code, coalesce(pay, 0) AS pay, coalesce(days, 0) AS days FROM x_establishment e LEFT JOIN (SELECT establishment_id, sum(basic_paise + coalesce(da_paise, 0)) AS pay, sum(days_paid) AS days
 FROM x_o_wage WHERE basic_paise > 0 AND days_paid > 0 GROUP BY 1) USING (establishment_id)) WINDOW w AS (PARTITION BY nic_code, state_code)"""
ORACLE_VIEWS["x_o_peer"] = PEER_SQL
_PARTS = {
    "a1_benford": _benford_sql("gross_paise") + "\nUNION ALL " + _benford_sql("net_paid_paise"),
    "a2_outliers": _OUTLIER_SQL,
    "a3_duplicates": _top_sql("duplicates.gross_paise", "MEDIUM", "x_o_wage WHERE gross_paise <> 0", "gross_paise", "days_paid", "n >= 8 AND k >= 4 AND k / n >= 0.35 AND others > 1")
    + "\nUNION ALL " + _top_sql("duplicates.net_paid_paise", "MEDIUM", "x_o_wage WHERE net_paid_paise <> 0", "net_paid_paise", "days_paid", "n >= 8 AND k >= 4 AND k / n >= 0.35 AND others > 1"),
    "a4_round_amounts": "SELECT establishment_id, period_year, 'round_numbers.gross_paise' AS test, 'LOW' AS severity, n AS sample_size, round_even(k / n, 3) AS statistic, k::DOUBLE AS value FROM (SELECT establishment_id, period_year, count(*) AS n, count(*) FILTER (WHERE gross_paise % 50000 = 0) AS k FROM x_o_wage WHERE gross_paise <> 0 GROUP BY 1, 2) WHERE n >= 8 AND k / n >= 0.7",
    "a5_zero_variance": "SELECT establishment_id, period_year, 'attendance.zero_variance' AS test, 'MEDIUM' AS severity, count(days_present) AS sample_size, count(days_present)::DOUBLE AS statistic, min(days_present) AS value FROM x_attendance GROUP BY 1, 2 HAVING count(days_present) >= 10 AND min(days_present) = max(days_present) AND coalesce(max(days_absent), 0) <= 0",
    "a6_uniform_base": _top_sql("epf.uniform_wage_base", "HIGH", "x_o_lines WHERE scheme = 'EPF' AND wage_base_paise IS NOT NULL AND register_wages_paise <> 0", "wage_base_paise", "register_wages_paise", "n >= 8 AND k / n >= 0.6 AND others > 1"),
    "a7_peer_gap": "SELECT establishment_id, period_year, 'peer.daily_wage_below_median' AS test, 'LOW' AS severity, n AS sample_size, round_even(med / peer_paise, 3) AS statistic, round_even(peer_paise, 2) AS value FROM (SELECT establishment_id, period_year, median(daily_wage_paise) AS med, count(*) AS n FROM x_o_wage WHERE daily_wage_paise IS NOT NULL GROUP BY 1, 2) JOIN x_o_peer USING (establishment_id) WHERE n >= 8 AND med < peer_paise * 0.7",
}


#: Columns of wage facts that the tests read.
READ = [*facts.K, "period_year", "worker_key", "row_number", "basic_paise", "da_paise", "days_paid", "gross_paise", "net_paid_paise", "statutory_wages_paise", "daily_wage_paise", "deduction_share"]


def _inputs(spark: SparkSession, sf_dir: str, once=lambda df: df) -> tuple[DataFrame, ...]:
    """once: how to keep a table that several tests read; then the join below all of them is kept too."""
    given = facts.wage_views(spark, sf_dir) if once is stored else None
    attendance = once(frame(spark, sf_dir, "x_attendance", given).select("establishment_id", "worker_key", "row_number", "period_start", "period_end", "period_year", "days_present", "days_absent", "overtime_hours"))
    wages = once(facts.wage_facts(frame(spark, sf_dir, "x_wage_line", given), attendance).select(*READ))
    epf = facts.contribution_facts(frame(spark, sf_dir, "x_contribution", given).where("scheme = 'EPF'"), wages)
    return wages, attendance, epf, peer_values(wages, frame(spark, sf_dir, "x_establishment"))


@query("a2_a7_medians_by_rank", """SELECT 'year' AS grain, period_year::BIGINT AS k, median(daily_wage_paise) AS med, count(daily_wage_paise) AS n FROM x_o_wage GROUP BY 2 HAVING n > 0
 UNION ALL SELECT 'establishment', establishment_id, median(daily_wage_paise), count(daily_wage_paise) AS n FROM x_o_wage GROUP BY 2 HAVING n > 0""")
def _by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of few large groups and of many small ones, all by rank."""
    wages = cut(_inputs(spark, sf_dir)[0].select("period_year", "establishment_id", "daily_wage_paise"))
    one = lambda grain, key: median_by_rank(wages, "daily_wage_paise", [key], 1_000).select(F.lit(grain).alias("grain"), c(key).cast("long").alias("k"), "med", "n")
    return one("year", "period_year").unionByName(one("establishment", "establishment_id"))


@query("a8_peer_values", "SELECT * FROM x_o_peer")
def _a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir)[3]


@query("a1_a9_all_tests", "\nUNION ALL ".join(_PARTS.values()))
def _a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_tests(*_inputs(spark, sf_dir, stored), YEAR)


def _one(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w, a, e, peers = _inputs(spark, sf_dir)
        if name == "a2_outliers":  # reads each table several times
            w, a = stored(w.select(*YEAR, "daily_wage_paise", "deduction_share")), stored(a.select(*YEAR, "overtime_hours"))
        return {
            "a1_benford": lambda: benford(w, ["gross_paise", "net_paid_paise"], YEAR),
            "a2_outliers": lambda: reduce(DataFrame.unionByName, (outliers(w, "daily_wage_paise", YEAR), outliers(w, "deduction_share", YEAR), outliers(a, "overtime_hours", YEAR))),
            "a3_duplicates": lambda: duplicates(w, "gross_paise", YEAR).unionByName(duplicates(w, "net_paid_paise", YEAR)),
            "a4_round_amounts": lambda: round_amounts(w, "gross_paise", YEAR),
            "a5_zero_variance": lambda: zero_variance(a, YEAR),
            "a6_uniform_base": lambda: uniform_base(e, YEAR),
            "a7_peer_gap": lambda: peer_gap(w, peers, YEAR),
        }[name]()

    return run


for _name, _sql in _PARTS.items():
    query(_name, _sql)(_one(_name))
