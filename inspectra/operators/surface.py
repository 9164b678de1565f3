"""Lists, cards and requests over establishments, documents and findings; evidence of failing rows; small ingest operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from inspectra.functions import normalise as n
from inspectra.functions import predicates as p
from inspectra.operators import cleaning, facts
from inspectra.operators.facts import K
from inspectra.operators.findings import OPEN
from inspectra.plans.registry import query
from inspectra.sources.views import VIEWS, frame

c = F.col


@query("q4_establishments", "SELECT establishment_id, name, state_code FROM x_establishment WHERE state_code = 'MH' AND name ILIKE '%supplier%' ORDER BY name, establishment_id LIMIT 100")
def _q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "x_establishment").where((c("state_code") == "MH") & c("name").ilike("%supplier%"))
    return rows.orderBy("name", "establishment_id").limit(100).select("establishment_id", "name", "state_code")


@query("q5_documents_page", "SELECT document_id, status, doc_type, created_at FROM x_document WHERE status IN ('NEEDS_REVIEW', 'FAILED', 'REJECTED') ORDER BY created_at DESC, document_id DESC LIMIT 100")
def _q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that need attention, newest first."""
    rows = frame(spark, sf_dir, "x_document").where(c("status").isin("NEEDS_REVIEW", "FAILED", "REJECTED"))
    return rows.orderBy(F.desc("created_at"), F.desc("document_id")).limit(100).select("document_id", "status", "doc_type", "created_at")


@query("q10_documents_by_type", "SELECT establishment_id, doc_type, count(*) AS documents FROM x_document WHERE status <> 'REJECTED' GROUP BY 1, 2")
def _q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "x_document").where("status <> 'REJECTED'").groupBy("establishment_id", "doc_type").agg(p.count_rows().alias("documents"))


@query("q11_rate_card", """SELECT establishment_id, skill_category, daily_rate_paise, daily_rate_paise * 26 AS monthly_rate_paise FROM (SELECT e.establishment_id, r.skill_category, r.daily_rate_paise, row_number() OVER (PARTITION BY e.establishment_id, r.skill_category ORDER BY r.effective_from DESC) AS rn
  FROM x_establishment e JOIN x_minimum_wage_rate r ON r.state_code = e.state_code AND r.effective_from <= DATE '1998-12-31') WHERE rn = 1""")
def _q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates in force for each establishment on a day, with the month of 26 days."""
    on = F.lit("1998-12-31").cast("date")
    est = frame(spark, sf_dir, "x_establishment").select("establishment_id", "state_code")
    rates = facts.rates_as_of(frame(spark, sf_dir, "x_minimum_wage_rate"), est.select("state_code", on.alias("on")).distinct())
    return est.join(rates, "state_code").select("establishment_id", "skill_category", "daily_rate_paise", (c("daily_rate_paise") * 26).alias("monthly_rate_paise"))


def apply_requests(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """Q12: (finding_id, establishment_id, status, verdict) of status requests (finding_id, establishment_id, role, wanted, note). Employers may acknowledge or dispute, analysts
    nothing; closing needs a note of ten characters; the status that is there already is no change."""
    rows = requests.join(findings.select("finding_id", "establishment_id", "status"), ["finding_id", "establishment_id"], "left")
    closing = c("wanted").isin("RESOLVED", "WAIVED", "FALSE_POSITIVE")
    verdict = (
        F.when(c("status").isNull(), "unknown_finding").when(c("role") == "ANALYST", "not_allowed").when((c("role") == "EMPLOYER") & ~c("wanted").isin("ACKNOWLEDGED", "DISPUTED"), "not_allowed")
        .when(closing & (F.length(F.trim(F.coalesce("note", F.lit("")))) < 10), "note_too_short").when(c("wanted") == c("status"), "no_change").otherwise("accepted")
    )
    return rows.withColumn("verdict", verdict).select("finding_id", "establishment_id", F.when(c("verdict") == "accepted", c("wanted")).otherwise(c("status")).alias("status"), "verdict")


@query("q12_status_requests", """SELECT finding_id, establishment_id, CASE WHEN verdict = 'accepted' THEN wanted ELSE status END AS status, verdict FROM (SELECT *, CASE WHEN role = 'ANALYST' THEN 'not_allowed' WHEN role = 'EMPLOYER' AND wanted NOT IN ('ACKNOWLEDGED', 'DISPUTED') THEN 'not_allowed'
  WHEN wanted = 'RESOLVED' AND finding_id % 3 = 0 THEN 'note_too_short' WHEN wanted = status THEN 'no_change' ELSE 'accepted' END AS verdict FROM (SELECT DISTINCT finding_id, establishment_id, status, CASE finding_id % 3 WHEN 0 THEN 'INSPECTOR' WHEN 1 THEN 'EMPLOYER' ELSE 'ANALYST' END AS role,
  CASE finding_id % 2 WHEN 0 THEN 'RESOLVED' ELSE 'DISPUTED' END AS wanted FROM x_finding))""")
def _q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "x_finding").select("finding_id", "establishment_id", "status").distinct()
    role = F.when(c("finding_id") % 3 == 0, "INSPECTOR").when(c("finding_id") % 3 == 1, "EMPLOYER").otherwise("ANALYST")
    wanted = F.when(c("finding_id") % 2 == 0, "RESOLVED").otherwise("DISPUTED")
    asked = rows.select("finding_id", "establishment_id", role.alias("role"), wanted.alias("wanted"), F.when(c("finding_id") % 3 == 0, "short").otherwise("a note that is long enough").alias("note"))
    return apply_requests(rows, asked)


def evidence(rows: DataFrame, failing: F.Column, shown: int = 8) -> DataFrame:
    """E5: of each K the first failing rows in row order, with how many more there are. The window keeps `shown` rows of a group per task before the shuffle; the count is an aggregate of its own."""
    bad = rows.where(failing)
    first = bad.withColumn("place", F.row_number().over(Window.partitionBy(*K).orderBy("row_number", "worker_key", "gross_paise"))).where(c("place") <= shown)
    return first.join(bad.groupBy(*K).agg(p.count_rows().alias("failing")), K).withColumn("further", F.greatest(c("failing") - shown, F.lit(0)))


@query("e5_evidence", """SELECT establishment_id, period_start, period_end, row_number, place::INT AS place, failing, greatest(failing - 8, 0) AS further FROM (SELECT *, row_number() OVER (PARTITION BY establishment_id, period_start, period_end ORDER BY row_number, worker_key, gross_paise NULLS FIRST) AS place,
  count(*) OVER (PARTITION BY establishment_id, period_start, period_end) AS failing FROM x_wage_line WHERE NOT needs_review AND day(paid_on) > 7) WHERE place <= 8""")
def _e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "x_wage_line").where("not needs_review")
    return evidence(rows, p.truth(F.dayofmonth("paid_on") > 7)).select(*K, "row_number", "place", "failing", "further")


@query("e6_exposure", """SELECT establishment_id, period_start, period_end, count(DISTINCT worker_key) AS affected, sum(total_remuneration_paise - gross_paise)::BIGINT AS exposure_paise FROM x_o_wage WHERE abs(gross_paise - total_remuneration_paise) > 100 GROUP BY 1, 2, 3""")
def _e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected workers and the sum at stake of rows whose gross is not the sum of its parts."""
    rows = facts.wage_facts(frame(spark, sf_dir, "x_wage_line"), frame(spark, sf_dir, "x_attendance")).where(F.abs(c("gross_paise") - c("total_remuneration_paise")) > 100)
    return rows.groupBy(*K).agg(F.count_distinct("worker_key").alias("affected"), F.sum(c("total_remuneration_paise") - c("gross_paise")).alias("exposure_paise"))


def bounded_move(base: F.Column, wanted: F.Column, sound: F.Column, reason: F.Column) -> F.Column:
    """A severity moves one step at most, never to INFO, up only where the verdict is sound, and only with a reason."""
    ladder = F.array(*(F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")))
    at, to = F.array_position(ladder, base), F.array_position(ladder, wanted)
    step = F.when(to > at, F.when(p.truth(sound), 1).otherwise(0)).when((to < at) & (to > 0), -1).otherwise(0)
    return F.when((at == 0) | p.is_missing(reason, "text"), base).otherwise(F.try_element_at(ladder, (at + step).cast("int")))


@query("e10_bounded_severity", """SELECT finding_id, establishment_id, created_on, severity, CASE WHEN severity = 'INFO' THEN 'INFO' WHEN kind = 'ANOMALY' THEN severity WHEN severity = 'CRITICAL' THEN 'CRITICAL' WHEN extraction_confidence IS NULL THEN severity WHEN severity = 'LOW' THEN 'MEDIUM' WHEN severity = 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END AS moved FROM x_finding""")
def _e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer asks for CRITICAL everywhere; anomalies come without a reason."""
    moved = bounded_move(c("severity"), F.lit("CRITICAL"), c("extraction_confidence").isNotNull(), F.when(c("kind") != "ANOMALY", "seen"))
    return frame(spark, sf_dir, "x_finding").select("finding_id", "establishment_id", "created_on", "severity", moved.alias("moved"))


@query("q14_evidence_documents", """SELECT f.finding_id, f.establishment_id, count(d.document_id) AS documents FROM x_finding f LEFT JOIN x_document d ON d.establishment_id = f.establishment_id AND d.period_start = f.period_start WHERE f.severity = 'CRITICAL' GROUP BY 1, 2""")
def _q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical findings with the documents filed for their period; documents are counted before the join."""
    filed = frame(spark, sf_dir, "x_document").groupBy("establishment_id", "period_start").agg(p.count_rows().alias("n"))
    rows = frame(spark, sf_dir, "x_finding").where("severity = 'CRITICAL'").join(filed, ["establishment_id", "period_start"], "left")
    return rows.groupBy("finding_id", "establishment_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("documents"))


def upsert_registrations(old: DataFrame, new: DataFrame) -> DataFrame:
    """By establishment, kind and number; a new value wins where there is one."""
    key = ["establishment_id", "kind", "number"]
    a, b = old.select(*key, F.struct("valid_from", "valid_to").alias("a")), new.select(*key, F.struct("valid_from", "valid_to").alias("b"))
    return a.join(b, key, "full_outer").select(*key, *(F.coalesce(f"b.{x}", f"a.{x}").alias(x) for x in ("valid_from", "valid_to")))


@query("s8_registration_upsert", """SELECT coalesce(a.establishment_id, b.establishment_id) AS establishment_id, coalesce(a.kind, b.kind) AS kind, coalesce(a.number, b.number) AS number, coalesce(b.valid_from, a.valid_from) AS valid_from, coalesce(b.valid_to, a.valid_to) AS valid_to
  FROM (SELECT * FROM x_registration WHERE filed % 3 <> 0) a FULL JOIN (SELECT establishment_id, kind, number, valid_from + 10 AS valid_from, CASE WHEN filed % 2 = 0 THEN valid_to + 365 END AS valid_to FROM x_registration WHERE filed % 4 <> 0) b ON a.establishment_id = b.establishment_id AND a.kind = b.kind AND a.number = b.number""")
def _s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "x_registration")
    new = rows.where("filed % 4 <> 0").withColumns({"valid_from": F.date_add("valid_from", 10), "valid_to": F.when(c("filed") % 2 == 0, F.date_add("valid_to", 365))})
    return upsert_registrations(rows.where("filed % 3 <> 0"), new)


@query("s7_headers_unpivoted", "UNPIVOT (SELECT document_id, doc_type::VARCHAR AS doc_type, status::VARCHAR AS status, strftime(period_start, '%Y-%m-%d') AS period_start FROM x_document) ON doc_type, status, period_start INTO NAME name VALUE value")
def _s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields as name and value rows."""
    rows = frame(spark, sf_dir, "x_document").select("document_id", "doc_type", "status", c("period_start").cast("string").alias("period_start"))
    return rows.unpivot("document_id", ["doc_type", "status", "period_start"], "name", "value").where("value is not null")


# A short form of two types; operators/payloads.py has every shape.
PAYLOADS = {"WAGE_REGISTER": "rows array<struct<page:int,worker_name:string,gross:string,paid_on:string>>", "MUSTER_ROLL": "rows array<struct<page:int,worker_name:string,marks:string>>"}

VIEWS["x_payload"] = """
SELECT row_id, document_id, page, CASE WHEN row_id % 3 = 0 THEN 'MUSTER_ROLL' ELSE 'WAGE_REGISTER' END AS doc_type,
       CASE WHEN row_id % 11 = 0 THEN 'not json' WHEN row_id % 3 = 0 THEN '{"rows":[{"page":' || CAST(page AS VARCHAR(20)) || ',"worker_name":"' || worker_name || '","marks":"PPAPP"},{"page":1,"worker_name":null,"marks":"AA"}]}'
            ELSE '{"rows":[{"page":' || CAST(page AS VARCHAR(20)) || ',"worker_name":" ' || worker_name || '","gross":"' || amount || '","paid_on":"7/4/2026"}]}' END AS payload
FROM x_raw_amount
"""


def payload_rows(payloads: DataFrame) -> DataFrame:
    """(document_id, row_id, doc_type, n, page, worker_name, gross_paise, paid_on, longest_run): the typed rows of JSON payloads, each type of document by its own schema. What is no such JSON has no rows."""
    out = None
    for kind, schema in PAYLOADS.items():
        rows = payloads.where(c("doc_type") == kind).select("document_id", "row_id", "doc_type", F.posexplode(F.from_json("payload", schema)["rows"]).alias("n", "r"))
        wage = kind == "WAGE_REGISTER"
        typed = rows.select(
            "document_id", "row_id", "doc_type", "n", c("r.page").alias("page"), n.clean_text("r.worker_name").alias("worker_name"), (n.parse_paise("r.gross") if wage else F.lit(None).cast("long")).alias("gross_paise"),
            (n.parse_date("r.paid_on") if wage else F.lit(None).cast("date")).alias("paid_on"), (F.lit(None).cast("int") if wage else n.longest_run("r.marks")).alias("longest_run"),
        )
        out = typed if out is None else out.unionByName(typed)
    return out


@query("s4_payload_rows", """WITH w AS (SELECT document_id, row_id, page::INT AS page, trim(regexp_replace(worker_name, '\\s+', ' ', 'g')) AS name, amount FROM x_raw_amount WHERE row_id % 11 <> 0)
 SELECT document_id, row_id, 'MUSTER_ROLL' AS doc_type, 0 AS n, page, name AS worker_name, NULL::BIGINT AS gross_paise, NULL::DATE AS paid_on, 2 AS longest_run FROM w WHERE row_id % 3 = 0 UNION ALL SELECT document_id, row_id, 'MUSTER_ROLL', 1, 1, NULL, NULL, NULL, NULL FROM w WHERE row_id % 3 = 0
 UNION ALL SELECT document_id, row_id, 'WAGE_REGISTER', 0, page, name, CASE WHEN amount LIKE '(%)' THEN -1 ELSE 1 END * round(try_cast(regexp_replace(CASE WHEN amount IN ('-', 'n/a') THEN NULL ELSE amount END, '[^0-9.\\-]', '', 'g') AS DECIMAL(18,4)) * 100)::BIGINT, DATE '2026-04-07', NULL FROM w WHERE row_id % 3 <> 0""")
def _s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_rows(frame(spark, sf_dir, "x_payload"))


def merged_header(pages: DataFrame, key: str, page: str, fields: list[str]) -> DataFrame:
    """Of each field the value on the first page that has one."""
    return pages.groupBy(key).agg(*(F.min_by(f, F.when(c(f).isNotNull(), c(page))).alias(f) for f in fields))


@query("d10_merged_headers", "SELECT document_id, arg_min(uan, row_id) FILTER (WHERE uan IS NOT NULL) AS uan, arg_min(skill, row_id) FILTER (WHERE skill IS NOT NULL) AS skill FROM (SELECT DISTINCT document_id, row_id, max(uan) AS uan, max(skill) AS skill FROM x_raw_amount GROUP BY 1, 2) GROUP BY 1")
def _d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "x_raw_amount").groupBy("document_id", "row_id").agg(F.max("uan").alias("uan"), F.max("skill").alias("skill"))
    return merged_header(rows, "document_id", "row_id", ["uan", "skill"])


def token_spans(tokens: DataFrame, most: int = 4) -> DataFrame:
    """V2: (document_id, line, pos, width, text): two to `most` neighbouring words of a line, joined. The window is one line of one page."""
    w = Window.partitionBy("document_id", "line").orderBy("pos")
    rows = tokens
    for i in range(1, most):
        rows = rows.withColumn(f"t{i}", F.lead("text", i).over(w))
    spans = F.array(*(F.when(c(f"t{i}").isNotNull(), F.struct(F.lit(i + 1).alias("width"), F.concat("text", *(c(f"t{j}") for j in range(1, i + 1))).alias("text"))) for i in range(1, most)))
    return rows.select("document_id", "line", "pos", F.inline(F.array_compact(spans)))


@query("v2_split_numbers", r"""WITH w AS (SELECT document_id, line - 1 AS line, list_filter(string_split(l, ' '), lambda x: x <> '') AS ws FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM x_page_line)),
 s AS (SELECT document_id, line, i - 1 AS pos, width, array_to_string(ws[i : i + width - 1], '') AS t FROM (SELECT document_id, line, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (VALUES (2), (3), (4)) AS v(width) WHERE i + width - 1 <= len(ws))
 SELECT document_id, line::INT AS line, pos::INT AS pos, width, t::DOUBLE AS number FROM s WHERE regexp_matches(t, '^[0-9]{4,12}$')""")
def _v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that were printed in two to four pieces."""
    spans = token_spans(cleaning.page_tokens(frame(spark, sf_dir, "x_page_line")))
    return spans.where(c("text").rlike("^[0-9]{4,12}$")).select("document_id", "line", "pos", "width", c("text").cast("double").alias("number"))


def trace_split_numbers(claims: DataFrame, tokens: DataFrame) -> DataFrame:
    """V2: claims (document_id, claim_id, value) that no single token carries, held to neighbouring tokens of a line: the joined text is that number, or has its digits (a decimal point was lost).
    The first line, start and width count: (document_id, claim_id, line, pos, width)."""
    return trace_in_spans(claims, token_spans(tokens))


def line_spans(pages: DataFrame, most: int = 4) -> DataFrame:
    """V2: the spans of `token_spans` that hold a digit, from the texts of pages: only lines with a digit are taken apart, where they lie, so no word is shuffled."""
    lines = pages.select("document_id", F.posexplode(F.split("text", "\n")).alias("line", "_line")).where(c("_line").rlike("[0-9]"))
    words = lines.select("document_id", "line", F.filter(F.split("_line", " "), lambda w: w != "").alias("_w"))
    joined = lambda i, k: F.struct(i.alias("pos"), F.lit(k).alias("width"), F.array_join(F.slice("_w", i + 1, k), "").alias("text"))
    spans = F.flatten(F.transform("_w", lambda w, i: F.array(*(F.when(i + k <= F.size("_w"), joined(i, k)) for k in range(2, most + 1)))))
    return words.select("document_id", "line", F.inline(F.filter(spans, lambda s: s["text"].rlike("[0-9]"))))


def trace_in_spans(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """trace_split_numbers over spans (document_id, line, pos, width, text). One equi-join, on one row for each number and each digit sequence of a page."""
    money = lambda x: F.regexp_replace(x, r"[^0-9.\-]", "").try_cast("decimal(30,10)").cast("string")
    keys = lambda x: F.inline(F.array(F.struct(F.lit("number").alias("kind"), money(x).alias("key")), F.struct(F.lit("digits").alias("kind"), n.digits_only(x).alias("key"))))
    printed = spans.where(c("text").rlike("[0-9]")).select("document_id", F.struct("line", "pos", "width").alias("at"), keys(c("text"))).where("key is not null")
    printed = printed.groupBy("document_id", "kind", "key").agg(F.min("at").alias("at"))
    wanted = claims.where(n.digits_only("value") != "").select("document_id", "claim_id", keys(c("value")))
    return wanted.join(printed, ["document_id", "kind", "key"]).groupBy("document_id", "claim_id").agg(F.min("at").alias("at")).select("document_id", "claim_id", "at.*")


@query("v2_traced_spans", """SELECT document_id, claim_id, len(string_split(text, chr(10))) - 1 AS line, 0 AS pos, 3 AS width FROM x_page_line, (VALUES (1), (2)) AS t(claim_id) WHERE text IS NOT NULL""")
def _v2_traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three claims a page: one printed in pieces, one that lost its point, one that is nowhere; of each the first span."""
    pages = frame(spark, sf_dir, "x_page_line")
    claims = pages.select("document_id", F.inline(F.array(*(F.struct(F.lit(i).alias("claim_id"), F.lit(v).alias("value")) for i, v in enumerate(("12,345", "123.45", "98989898.1"), 1)))))
    return trace_in_spans(claims, line_spans(pages))


def trace_texts(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """V3: the first line of the page that holds the claimed text, or its first six letters: (document_id, claim_id, line)."""
    lines = pages.select("document_id", F.posexplode_outer(F.split("text", "\n")).alias("line", "_l")).where("_l is not null")
    plain = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    both = claims.withColumn("_v", plain(c("value"))).join(lines.withColumn("_l", plain(c("_l"))), "document_id")
    found = F.contains("_l", "_v") | ((F.length("_v") >= 6) & F.contains(c("_l"), F.substring("_v", 1, 6)))
    return both.where((c("_v") != "") & found).groupBy("document_id", "claim_id").agg(F.min("line").alias("line"))


@query("v3_trace_texts", r"""WITH l AS (SELECT document_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^a-z0-9]', '', 'g') AS l FROM x_page_line),
 cl AS (SELECT document_id, 1 AS claim_id, regexp_replace(lower(substr(text, 21, 30)), '[^a-z0-9]', '', 'g') AS v FROM x_page_line)
 SELECT document_id, claim_id, min(line)::INT AS line FROM cl JOIN l USING (document_id) WHERE v <> '' AND (contains(l, v) OR (length(v) >= 6 AND contains(l, left(v, 6)))) GROUP BY 1, 2""")
def _v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = frame(spark, sf_dir, "x_page_line")
    return trace_texts(pages.select("document_id", F.lit(1).alias("claim_id"), F.substring("text", 21, 30).alias("value")), pages)


@query("n8_n9_name_keys", r"""SELECT identity_id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(upper('Shri. ' || display_name || ' Sardar, Dr'), '[^A-Z0-9\s]', ' ', 'g')), '\s+'), lambda t: t <> '' AND t NOT IN ('SHRI', 'SHRIMATI', 'SMT', 'SRI', 'MR', 'MRS', 'MS', 'MISS', 'MASTER', 'SARDAR', 'LATE', 'DECEASED', 'SO', 'DO', 'WO', 'CO', 'OF')), ' ') AS name_key,
  regexp_replace(uan, '\D', '', 'g') AS digits FROM x_identity""")
def _n9(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Shri. "), "display_name", F.lit(" Sardar, Dr s / o Ram Lal"))
    return frame(spark, sf_dir, "x_identity").select("identity_id", n.name_key(name).alias("name_key"), n.digits_only("uan").alias("digits"))


VIEWS["x_inspector"] = """
SELECT CAST(c_custkey AS BIGINT) AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 'ANALYST' ELSE 'INSPECTOR' END AS role, (c_custkey % 9 <> 0) AS is_active,
       CASE c_custkey % 5 WHEN 0 THEN 'IN/MH,IN/GJ' WHEN 1 THEN 'IN/KA' WHEN 2 THEN '' WHEN 3 THEN 'IN/DL,IN/RJ' ELSE 'IN/MH' END AS jurisdictions
FROM customer
"""


def inspector_queue(findings: DataFrame, establishments: DataFrame, users: DataFrame) -> DataFrame:
    """C14: (user_id, findings, establishments): what each active inspector whose jurisdictions hold the establishment is told of. Findings are counted by establishment, and these by jurisdiction, before they fan out: an inspector meets a row a jurisdiction."""
    open_ = findings.where(c("status").isin(OPEN)).groupBy("establishment_id").agg(p.count_rows().alias("n"))
    rows = open_.join(establishments.where("is_active").select("establishment_id", F.concat(F.lit("IN/"), "state_code").alias("jurisdiction")), "establishment_id")
    who = users.where("is_active and role = 'INSPECTOR'").select("user_id", F.explode(F.array_distinct(F.split("jurisdictions", ","))).alias("jurisdiction")).where("jurisdiction <> ''")
    rows = rows.groupBy("jurisdiction").agg(F.sum("n").alias("findings"), p.count_rows().alias("establishments"))
    return who.join(rows, "jurisdiction").groupBy("user_id").agg(F.sum("findings").alias("findings"), F.sum("establishments").alias("establishments"))


@query("c14_inspector_queue", """SELECT user_id, count(*) AS findings, count(DISTINCT f.establishment_id) AS establishments FROM x_finding f JOIN x_establishment e USING (establishment_id) JOIN (SELECT user_id, unnest(string_split(jurisdictions, ',')) AS j FROM x_inspector WHERE is_active AND role = 'INSPECTOR') u ON u.j = 'IN/' || e.state_code
 WHERE e.is_active AND status IN ('OPEN', 'ACKNOWLEDGED', 'DISPUTED') GROUP BY 1""")
def _c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspector_queue(frame(spark, sf_dir, "x_finding"), frame(spark, sf_dir, "x_establishment"), frame(spark, sf_dir, "x_inspector"))
