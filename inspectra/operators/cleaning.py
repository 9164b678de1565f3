"""Raw rows to accepted rows: typed cells, removed rows with their reason, and checks of what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.functions import normalise as n
from inspectra.functions import predicates as p
from inspectra.operators.facts import K
from inspectra.plans.registry import query
from inspectra.sources.views import VIEWS, frame

c = F.col

VIEWS["x_raw_amount"] = """
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_id, CAST(l_suppkey AS BIGINT) AS document_id, CAST(l_orderkey % 40 AS BIGINT) AS page,
       CASE l_partkey % 6 WHEN 0 THEN CAST(CAST(l_quantity AS INT) * 37 AS VARCHAR(20)) || '.50' WHEN 1 THEN '1,' || CAST(100 + CAST(l_quantity AS INT) AS VARCHAR(20)) || '.25'
            WHEN 2 THEN '(' || CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) || '.75)' WHEN 3 THEN '₹ 2,' || CAST(200 + CAST(l_quantity AS INT) AS VARCHAR(20)) WHEN 4 THEN '-' ELSE 'n/a' END AS amount,
       CASE l_partkey % 5 WHEN 0 THEN ' semi  skilled ' WHEN 1 THEN 'Semi-Skilled' WHEN 2 THEN 'skilled' WHEN 3 THEN 'expert' ELSE NULL END AS skill,
       CASE l_suppkey % 11 WHEN 0 THEN 'Grand Total' WHEN 1 THEN 'Sub.Total' WHEN 2 THEN 'Name' WHEN 3 THEN 'c/f' WHEN 4 THEN 'Brought   Forward' WHEN 5 THEN 'Member Name' WHEN 6 THEN 'Totals' WHEN 7 THEN 'Sl No'
            ELSE 'Worker ' || CAST(l_suppkey % 20 AS VARCHAR(20)) END AS worker_name,
       CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey AS VARCHAR(20)) END AS uan
FROM lineitem
"""

VIEWS["x_marks"] = """
SELECT CAST(event_id AS BIGINT) AS event_id, substr('P P', 1, CAST(event_id % 4 AS INT)) || repeat('P', CAST(event_id % 5 AS INT)) || CASE event_id % 6 WHEN 0 THEN '/' WHEN 1 THEN 'A' WHEN 2 THEN '*' WHEN 3 THEN 'W.' WHEN 4 THEN ' ' ELSE 'h' END
       || repeat('8', CAST(event_id % 7 AS INT)) AS marks
FROM events
"""


VIEWS["x_page_line"] = """
SELECT CAST(doc_id AS BIGINT) AS document_id, text || chr(10) || 'No 12 345 ' || CAST(doc_id % 100 AS VARCHAR(20)) || CASE doc_id % 5 WHEN 0 THEN ' id 2345 6789 0124' WHEN 1 THEN ' id 2345 6789 0125' ELSE ' none' END AS text FROM documents
"""


@query("n1_n6_cells", r"""SELECT row_id, CASE WHEN amount IN ('-', 'n/a') THEN NULL ELSE amount END AS amount_text, try_cast(replace(CASE WHEN amount IN ('-', 'n/a') THEN NULL ELSE amount END, ',', '') AS DOUBLE) AS number,
  round_even(try_cast(replace(CASE WHEN amount IN ('-', 'n/a') THEN NULL ELSE amount END, ',', '') AS DOUBLE), 0)::BIGINT AS whole,
  CASE WHEN amount LIKE '(%)' THEN -1 ELSE 1 END * round(try_cast(regexp_replace(CASE WHEN amount IN ('-', 'n/a') THEN NULL ELSE amount END, '[^0-9.\-]', '', 'g') AS DECIMAL(18,4)) * 100)::BIGINT AS paise,
  CASE WHEN translate(upper(regexp_replace(trim(skill), '\s+', ' ', 'g')), ' -', '__') IN ('UNSKILLED', 'SEMI_SKILLED', 'SKILLED', 'HIGHLY_SKILLED') THEN translate(upper(regexp_replace(trim(skill), '\s+', ' ', 'g')), ' -', '__') END AS skill FROM x_raw_amount""")
def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "x_raw_amount")
    return rows.select("row_id", n.clean_text("amount").alias("amount_text"), n.parse_number("amount").alias("number"), n.parse_int("amount").alias("whole"), n.parse_paise("amount").alias("paise"), n.parse_skill("skill").alias("skill"))


_FORMS = ["yyyy-MM-dd", "d-M-yyyy", "d/M/yyyy", "dd.MM.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM yyyy", "MMM yyyy", "yyyy-MM", "MM/yyyy", "d-M-yy", "d/M/yy"]


@query("n4_dates", """SELECT document_id, form, CASE WHEN form <= 5 THEN created_at::DATE WHEN form <= 9 THEN date_trunc('month', created_at)::DATE END AS parsed FROM x_document, range(12) AS f(form)""")
def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates printed in the ten formats, and in two that are none, and read again."""
    rows = frame(spark, sf_dir, "x_document").select("document_id", F.posexplode(F.array(*(F.date_format("created_at", f) for f in _FORMS))).alias("form", "text"))
    return rows.select("document_id", F.col("form").cast("long").alias("form"), n.parse_date("text").alias("parsed"))


@query("n7_mark_runs", r"""WITH m AS (SELECT event_id, regexp_replace(lower(marks), '[^a-z0-9\- ./]', '', 'g') AS k FROM x_marks)
 SELECT event_id, CASE WHEN length(k) >= 3 THEN list_max(list_transform(string_split(regexp_replace(k, '[awhlox ./-]', ' ', 'g'), ' '), lambda r: length(r)))::INT END AS run FROM m""")
def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "x_marks").select("event_id", n.longest_run("marks").alias("run"))


def accepted_rows(rows: DataFrame, pages: DataFrame, value_columns: list[str]) -> DataFrame:
    """Rows with `reason` (null: accepted). A repeat is a row like an earlier one of its page; the smallest row_id is the first.
    Repeats are found by a digest of all values, aggregated by page and digest."""
    digest = F.sha2(F.to_json(F.struct(*value_columns), {"ignoreNullFields": "false"}), 256)
    keyed = rows.withColumn("_digest", digest)
    first = keyed.groupBy("document_id", "page", "_digest").agg(F.min("row_id").alias("_first"))
    marked = keyed.join(first, ["document_id", "page", "_digest"]).join(pages.select("document_id", "page").distinct().withColumn("_page", F.lit(True)), ["document_id", "page"], "left")
    return marked.withColumn("reason", n.row_reason("worker_name", p.truth("_page"), c("uan").isNotNull(), c("row_id") > c("_first"))).drop("_digest", "_first", "_page")


def removal_counts(rows: DataFrame) -> DataFrame:
    """N14"""
    kinds = ["bad_page", "total", "header", "duplicate"]
    return rows.groupBy("document_id").agg(p.count_rows().alias("seen"), F.count_if(c("reason").isNull()).alias("accepted"), *(F.count_if(p.truth(c("reason") == k)).alias(f"removed_{k}") for k in kinds))


def removed_counts(rows: DataFrame, pages: DataFrame, value_columns: list[str]) -> DataFrame:
    """N14 as `removal_counts` of `accepted_rows`, where worker_name and uan are among the values. Equal rows of a page share all but the last reason, so they are counted together: those of the smallest row_id are first (a row_id may
    repeat), the others repeat them. Rows are dealt by page once, and no row meets another."""
    dealt = rows.select("document_id", "page", *value_columns, "row_id").repartition("document_id", "page")
    ids = dealt.groupBy("document_id", "page", *value_columns, "row_id").agg(p.count_rows().alias("_k"))
    unnumbered = p.total(F.when(c("row_id").isNull(), c("_k")))
    groups = ids.groupBy("document_id", "page", *value_columns).agg(F.sum("_k").alias("_n"), (F.coalesce(F.min_by("_k", "row_id"), F.lit(0)) + unnumbered).cast("long").alias("_first"))
    marked = groups.join(pages.select("document_id", "page").distinct().withColumn("_page", F.lit(True)), ["document_id", "page"], "left")
    one = lambda repeated, k: F.struct(n.row_reason("worker_name", p.truth("_page"), c("uan").isNotNull(), F.lit(repeated)).alias("reason"), k.alias("k"))
    each = marked.select("document_id", F.inline(F.array(one(False, c("_first")), one(True, c("_n") - c("_first")))))
    kinds = ["bad_page", "total", "header", "duplicate"]
    of = lambda test: F.sum(F.when(test, c("k")).otherwise(0))
    return each.groupBy("document_id").agg(F.sum("k").alias("seen"), of(c("reason").isNull()).alias("accepted"), *(of(p.truth(c("reason") == k)).alias(f"removed_{k}") for k in kinds))


@query("n10_n14_removed_rows", """SELECT document_id, count(*) AS seen, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason = 'bad_page') AS removed_bad_page, count(*) FILTER (WHERE reason = 'total') AS removed_total,
  count(*) FILTER (WHERE reason = 'header') AS removed_header, count(*) FILTER (WHERE reason = 'duplicate') AS removed_duplicate FROM (SELECT document_id, CASE WHEN page >= 38 THEN 'bad_page' WHEN worker_name IN ('Grand Total', 'Sub.Total', 'c/f', 'Brought   Forward') THEN 'total'
  WHEN worker_name IN ('Name', 'Member Name') AND uan IS NULL THEN 'header' WHEN row_id > min(row_id) OVER (PARTITION BY document_id, page, amount, skill, worker_name, uan) THEN 'duplicate' END AS reason FROM x_raw_amount) GROUP BY 1""")
def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "x_raw_amount")
    return removed_counts(rows, rows.where("page < 38"), ["amount", "skill", "worker_name", "uan"])


def reasons(*checks: tuple[Column, str]) -> Column:
    """The names of the checks that a row breaks; unknown values break none."""
    return F.array_compact(F.array(*(F.when(p.truth(bad), F.lit(name)) for bad, name in checks)))


def wage_reasons() -> Column:
    """V6: the arithmetic of a wage row, to a rupee."""
    zero = F.lit(0).cast("long")
    parts = p.total_remuneration(gross=F.lit(None).cast("long"))
    net = c("gross_paise") + F.coalesce("overtime_paise", zero) - F.coalesce("deductions_paise", zero)
    slack = F.greatest(F.lit(100.0), p.to_int("overtime_hours").cast("double") * 100)
    return reasons(
        (F.abs(c("gross_paise") - parts) > 100, "gross"), (F.abs(c("net_paid_paise") - net) > 100, "net"),
        (F.abs(c("deductions_paise") - (c("pf_paise") + c("esi_paise") + c("advance_paise"))) > 100, "deductions"),
        (F.abs(c("overtime_paise") - c("overtime_hours") * c("overtime_rate_paise")) > slack, "overtime"), (c("days_paid") > 31, "days"),
    )


@query("v6_v12_wage_reasons", """SELECT row_number, establishment_id, worker_key, period_start, array_to_string(list_filter([CASE WHEN abs(gross_paise - CASE WHEN coalesce(basic_paise, da_paise, other_allowances_paise) IS NOT NULL THEN coalesce(basic_paise, 0) + coalesce(da_paise, 0) + coalesce(other_allowances_paise, 0) END) > 100 THEN 'gross' END,
  CASE WHEN abs(net_paid_paise - (gross_paise + coalesce(overtime_paise, 0) - coalesce(deductions_paise, 0))) > 100 THEN 'net' END, CASE WHEN abs(deductions_paise - (pf_paise + esi_paise + advance_paise)) > 100 THEN 'deductions' END,
  CASE WHEN abs(overtime_paise - overtime_hours * overtime_rate_paise) > greatest(100, trunc(overtime_hours) * 100) THEN 'overtime' END, CASE WHEN days_paid > 31 THEN 'days' END], lambda x: x IS NOT NULL), ',') AS reasons FROM x_wage_line""")
def _v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "x_wage_line").select("row_number", "establishment_id", "worker_key", "period_start", F.array_join(wage_reasons(), ",").alias("reasons"))


@query("v7_attendance_reasons", """SELECT row_number, establishment_id, worker_key, period_start, array_to_string(list_filter([CASE WHEN days_present + days_absent > 31 THEN 'days' END, CASE WHEN max_daily_hours > 24 THEN 'daily' END,
  CASE WHEN max_weekly_hours > 168 THEN 'weekly' END, CASE WHEN longest_consecutive_days > 31 THEN 'run' END], lambda x: x IS NOT NULL), ',') AS reasons FROM x_attendance""")
def _v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = reasons((c("days_present") + c("days_absent") > 31, "days"), (c("max_daily_hours") > 24, "daily"), (c("max_weekly_hours") > 168, "weekly"), (c("longest_consecutive_days") > 31, "run"))
    return frame(spark, sf_dir, "x_attendance").select("row_number", "establishment_id", "worker_key", "period_start", F.array_join(own, ",").alias("reasons"))


@query("v7_contribution_reasons", """SELECT scheme, row_number, establishment_id, worker_key, period_start, array_to_string(list_filter([CASE WHEN employee_share_paise > wage_base_paise THEN 'share' END, CASE WHEN ncp_days < 0 OR ncp_days > 31 THEN 'ncp' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM (SELECT *, row_number % 40 - 3 AS ncp_days FROM x_contribution)""")
def _v7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "x_contribution").withColumn("ncp_days", c("row_number") % 40 - 3)
    own = reasons((c("employee_share_paise") > c("wage_base_paise"), "share"), (~c("ncp_days").between(0, 31), "ncp"))
    return rows.select("scheme", "row_number", "establishment_id", "worker_key", "period_start", F.array_join(own, ",").alias("reasons"))


def column_totals(rows: DataFrame, printed: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Printed totals against summed rows; a break is more than a rupee and more than a hundredth. Zero or unknown totals are not compared."""
    summed = rows.groupBy(*by).agg(F.sum(column).alias("summed"))
    both = printed.join(summed, by).where("printed <> 0 and summed <> 0")
    return both.withColumn("breaks", F.abs(c("printed") - c("summed")) > F.greatest(F.lit(100), F.floor(F.abs("printed") / 100)))


@query("v11_column_totals", """SELECT establishment_id, period_start, period_end, summed + CASE WHEN establishment_id % 3 = 0 THEN summed // 50 ELSE 0 END AS printed, summed, CASE WHEN establishment_id % 3 = 0 THEN summed // 50 ELSE 0 END > greatest(100, (summed + CASE WHEN establishment_id % 3 = 0 THEN summed // 50 ELSE 0 END) // 100) AS breaks
  FROM (SELECT establishment_id, period_start, period_end, sum(gross_paise)::BIGINT AS summed FROM x_wage_line GROUP BY 1, 2, 3) WHERE summed <> 0""")
def _v11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "x_wage_line")
    printed = rows.groupBy(*K).agg(F.sum("gross_paise").alias("s")).select(*K, (c("s") + F.when(c("establishment_id") % 3 == 0, F.floor(c("s") / 50)).otherwise(0)).cast("long").alias("printed"))
    return column_totals(rows, printed, "gross_paise", K).select(*K, "printed", "summed", "breaks")


def bad_formats(uan: Column, pan: Column | None = None, esic: Column | None = None) -> Column:
    """V9: blank is fine."""
    checks = [(~uan.rlike("^[0-9]{12}$") & (F.trim(uan) != ""), "uan")]
    if pan is not None:
        checks.append((~pan.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$") & (F.trim(pan) != ""), "pan"))
    if esic is not None:
        checks.append((~esic.rlike("^([0-9]{10}|[0-9]{17})$") & (F.trim(esic) != ""), "esic"))
    return reasons(*checks)


@query("v9_formats", """SELECT identity_id, concat_ws(',', CASE WHEN identity_id % 10 = 0 AND uan IS NOT NULL THEN 'uan' END, CASE WHEN identity_id % 7 IN (1, 2) THEN 'pan' END, CASE WHEN identity_id % 6 IN (2, 3) THEN 'esic' END) AS reasons FROM x_identity""")
def _v9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "x_identity").withColumn("u", F.when(c("identity_id") % 10 == 0, F.concat(F.lit("X"), "uan")).otherwise(c("uan")))
    pan = F.when(c("identity_id") % 7 == 0, " ").when(c("identity_id") % 7 == 1, "ABCDE12345").when(c("identity_id") % 7 == 2, "abcde1234f").otherwise("ABCDE1234F")
    esic = F.when(c("identity_id") % 6 == 0, F.repeat(F.lit("7"), 17)).when(c("identity_id") % 6 == 1, "").when(c("identity_id") % 6 == 2, F.repeat(F.lit("7"), 12)).when(c("identity_id") % 6 == 3, "12345-6789").otherwise("1234567890")
    return rows.select("identity_id", F.array_join(bad_formats(c("u"), pan, esic), ",").alias("reasons"))


# The multiplication table of the dihedral group and the position permutations of the Verhoeff check.
_D = [[(i + j) % 5 + 5 * ((i // 5 + j // 5) % 2) if i < 5 else ((i - j) % 5 + 5 * ((1 + j // 5) % 2)) for j in range(10)] for i in range(10)]
_P0 = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def verhoeff_ok(number: Column) -> Column:
    """The check digit of a digit text holds."""
    table = F.array(*(F.lit(x) for row in _D for x in row))
    perms = [list(range(10))]
    for _ in range(7):
        perms.append([_P0[x] for x in perms[-1]])
    perm = F.array(*(F.lit(x) for row in perms for x in row))
    digits = F.reverse(F.filter(F.split(number, ""), lambda d: d != ""))
    walk = F.aggregate(
        F.sequence(F.lit(0), F.size(digits) - 1), F.lit(0),
        lambda a, i: F.get(table, a * 10 + F.get(perm, (i % 8) * 10 + F.get(digits, i).cast("int"))),
    )
    return walk == 0


def national_ids(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, masked) for each 4-4-4 digit group of a text, a word of its own, with a valid check digit. Digits inside a longer word (a hexadecimal secret) are no number."""
    found = F.regexp_extract_all(c(text_col), F.lit(r"(?U)\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b"), F.lit(0))
    rows = texts.select(id_col, F.explode(found).alias("n")).withColumn("n", n.digits_only("n"))
    return rows.where(verhoeff_ok(c("n"))).select(id_col, F.concat(F.lit("XXXXXXXX"), F.substring("n", 9, 4)).alias("masked"))


@query("v10_national_ids", "SELECT document_id, 'XXXXXXXX0124' AS masked FROM x_page_line WHERE document_id % 5 = 0 AND text IS NOT NULL")
def _v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the pages bear a number with a valid check digit, a fifth one with a wrong digit."""
    return national_ids(frame(spark, sf_dir, "x_page_line"), "document_id", "text")


@query("v13_date_sanity", "SELECT 'incident' AS kind, incident_id AS id, coalesce(notified_on < occurred_on, false) AS reversed FROM x_incident UNION ALL SELECT 'registration', filed, coalesce(valid_to < valid_from, false) FROM x_registration")
def _v13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents notified before they occurred, and registrations that end before they begin."""
    incidents = frame(spark, sf_dir, "x_incident").select(F.lit("incident").alias("kind"), c("incident_id").alias("id"), p.is_before("notified_on", "occurred_on").alias("reversed"))
    return incidents.unionByName(frame(spark, sf_dir, "x_registration").select(F.lit("registration").alias("kind"), c("filed").alias("id"), p.is_before("valid_to", "valid_from").alias("reversed")))


def compare_readings(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """V8: (key, field, verdict) of two readings of one page."""
    a, b = (d.select(*key, F.struct(*fields).alias(side)) for d, side in ((left, "a"), (right, "b")))
    both = a.join(b, key, "full_outer")

    def verdict(f: str) -> Column:
        x, y = c(f"a.{f}"), c(f"b.{f}")
        return F.when(x.eqNullSafe(y), "MATCH").when(y.isNull(), "OCR_ONLY").when(x.isNull(), "MODEL_ONLY").otherwise("CONFLICT")

    return both.select(*key, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), verdict(f).alias("verdict")) for f in fields))))


@query("v8_two_readings", """SELECT row_number, establishment_id, worker_key, period_start, basic, field, CASE WHEN x IS NOT DISTINCT FROM y THEN 'MATCH' WHEN y IS NULL THEN 'OCR_ONLY' WHEN x IS NULL THEN 'MODEL_ONLY' ELSE 'CONFLICT' END AS verdict FROM (
  SELECT coalesce(a.row_number, b.row_number) AS row_number, coalesce(a.establishment_id, b.establishment_id) AS establishment_id, coalesce(a.worker_key, b.worker_key) AS worker_key, coalesce(a.period_start, b.period_start) AS period_start, coalesce(a.basic_paise, b.basic_paise) AS basic, f AS field,
  CASE f WHEN 'gross_paise' THEN a.gross_paise ELSE a.net_paid_paise END AS x, CASE f WHEN 'gross_paise' THEN b.gross_paise ELSE b.net_paid_paise END AS y
  FROM (SELECT DISTINCT row_number, establishment_id, worker_key, period_start, basic_paise, gross_paise, net_paid_paise FROM x_wage_line WHERE row_number % 5 <> 0) a FULL JOIN (SELECT DISTINCT row_number, establishment_id, worker_key, period_start, basic_paise, gross_paise + row_number % 2 AS gross_paise, net_paid_paise FROM x_wage_line WHERE row_number % 7 <> 0) b
  ON a.row_number = b.row_number AND a.establishment_id = b.establishment_id AND a.worker_key = b.worker_key AND a.period_start = b.period_start AND a.basic_paise = b.basic_paise, (VALUES ('gross_paise'), ('net_paid_paise')) AS t(f))""")
def _v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["row_number", "establishment_id", "worker_key", "period_start", "basic"]
    rows = frame(spark, sf_dir, "x_wage_line").withColumnRenamed("basic_paise", "basic")
    one = rows.where("row_number % 5 <> 0").select(*key, "gross_paise", "net_paid_paise").distinct()
    two = rows.where("row_number % 7 <> 0").select(*key, (c("gross_paise") + c("row_number") % 2).alias("gross_paise"), "net_paid_paise").distinct()
    return compare_readings(one, two, key, ["gross_paise", "net_paid_paise"])


# Tracing claims on pages


def page_tokens(pages: DataFrame) -> DataFrame:
    """(document_id, line, pos, text): words of the lines of a text. Outer explodes keep the optimizer from splitting twice."""
    lines = pages.select("document_id", F.posexplode_outer(F.split("text", "\n")).alias("line", "_line"))
    words = lines.select("document_id", "line", F.posexplode_outer(F.filter(F.split("_line", " "), lambda w: w != "")).alias("pos", "text"))
    return words.where("text is not null")


def trace_numbers(claims: DataFrame, tokens: DataFrame) -> DataFrame:
    """V1: (document_id, claim_id, verdict, line, pos): the first token of the page that equals the claimed number. A null claim agrees; a page without tokens cannot be checked."""
    numbers = tokens.withColumn("number", n.parse_number("text")).where("number is not null").groupBy("document_id", "number").agg(F.min(F.struct("line", "pos")).alias("at"))
    there = tokens.select("document_id").distinct().withColumn("_tokens", F.lit(True))
    rows = claims.join(numbers, ["document_id", "number"], "left").join(there, "document_id", "left")
    verdict = F.when(~p.truth("_tokens"), "MODEL_ONLY").when(c("number").isNull() | c("at").isNotNull(), "AGREED").otherwise("UNSUPPORTED")
    return rows.select("document_id", "claim_id", verdict.alias("verdict"), c("at.line").alias("line"), c("at.pos").alias("pos"))


@query("v1_trace_numbers", r"""WITH w AS (SELECT document_id, line - 1 AS line, list_filter(string_split(l, ' '), lambda x: x <> '') AS ws FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM x_page_line)),
 t AS (SELECT document_id, line, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS pos FROM w),
 nn AS (SELECT document_id, line, pos, try_cast(replace(text, ',', '') AS DOUBLE) AS number FROM t WHERE regexp_matches(text, '^[0-9][0-9,.]*$')),
 f AS (SELECT document_id, number, line, pos FROM nn WHERE number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, number ORDER BY line, pos) = 1),
 cl AS (SELECT document_id, 1 AS claim_id, (document_id % 300)::DOUBLE AS number FROM x_page_line UNION ALL SELECT document_id, 2, NULL FROM x_page_line)
 SELECT cl.document_id, claim_id, CASE WHEN NOT EXISTS (SELECT 1 FROM t WHERE t.document_id = cl.document_id) THEN 'MODEL_ONLY' WHEN cl.number IS NULL OR f.pos IS NOT NULL THEN 'AGREED' ELSE 'UNSUPPORTED' END AS verdict, line::INT AS line, pos::INT AS pos
 FROM cl LEFT JOIN f USING (document_id, number)""")
def _v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = frame(spark, sf_dir, "x_page_line")
    claims = pages.select("document_id", F.lit(1).alias("claim_id"), (c("document_id") % 300).cast("double").alias("number")).unionByName(pages.select("document_id", F.lit(2).alias("claim_id"), F.lit(None).cast("double").alias("number")))
    # Only tokens that look like plain numbers are compared.
    return trace_numbers(claims, page_tokens(pages).withColumn("text", F.when(c("text").rlike("^[0-9][0-9,.]*$"), c("text"))))
