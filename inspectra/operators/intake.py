"""What comes in from outside and is judged before it counts: printed rate tables, claims with boxes and corrections, quotations,
word positions, links of printed workers to known ones, and headers bound to an employer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inspectra.functions import normalise as n
from inspectra.functions import predicates as p
from inspectra.operators import cleaning, documents
from inspectra.operators.pages import page_lines
from inspectra.operators.surface import trace_texts
from inspectra.plans.materialise import cut
from inspectra.plans.registry import query
from inspectra.sources.views import ORACLE_VIEWS, VIEWS, frame

c = F.col

# Codes of states and union territories as printed in rate tables, and the rates' standing.
STATE_CODES = {
    "Andhra Pradesh": "AP", "Arunachal Pradesh": "AR", "Assam": "AS", "Bihar": "BR", "Chandigarh": "CH", "Chhattisgarh": "CG", "Delhi": "DL", "Goa": "GA", "Gujarat": "GJ", "Haryana": "HR",
    "Himachal Pradesh": "HP", "Jammu & Kashmir": "JK", "Jharkhand": "JH", "Karnataka": "KA", "Kerala": "KL", "Madhya Pradesh": "MP", "Maharashtra": "MH", "Manipur": "MN", "Meghalaya": "ML", "Mizoram": "MZ",
    "Nagaland": "NL", "Odisha": "OD", "Puducherry": "PY", "Punjab": "PB", "Rajasthan": "RJ", "Sikkim": "SK", "Tamil Nadu": "TN", "Telangana": "TG", "Tripura": "TR", "Uttar Pradesh": "UP", "Uttarakhand": "UK", "West Bengal": "WB",
}
REFERENCE_FROM, WORKING_DAYS = "2026-03-01", 26

VIEWS["x_rate_text"] = """
SELECT CAST(s_suppkey AS BIGINT) AS line,
       CASE s_suppkey % 7 WHEN 0 THEN 'State' WHEN 1 THEN 'Delhi' WHEN 2 THEN '  Tamil   Nadu' WHEN 3 THEN 'Atlantis' WHEN 4 THEN 'Jammu & Kashmir' ELSE 'Kerala' END
       || CASE WHEN s_suppkey % 7 = 0 THEN ' Unskilled Semi-Skilled Skilled' ELSE chr(9) || '₹' || CAST(300 + s_suppkey % 90 AS VARCHAR(20)) || '/day ₹ ' || CAST(400 + s_suppkey % 80 AS VARCHAR(20)) || ' / day ₹1,' || CAST(100 + s_suppkey % 70 AS VARCHAR(20)) || '/day' END AS value
FROM supplier
"""


def parse_rates(lines: DataFrame) -> DataFrame:
    """(line, state_name, state_code, skill_category, daily_rate_paise) of the lines that state three daily rates; state_code is null where the state is unknown, to be reported."""
    form = r"^\s*([A-Za-z&.\s]+?)\s+₹\s*([\d,]+)\s*/\s*day\s+₹\s*([\d,]+)\s*/\s*day\s+₹\s*([\d,]+)\s*/\s*day\s*$"
    rows = lines.where(c("value").rlike(form))
    paise = lambda i: F.translate(F.regexp_extract("value", form, i), ",", "").cast("long") * 100
    state = F.trim(F.regexp_replace(F.regexp_extract("value", form, 1), r"\s+", " "))
    codes = F.create_map(*(F.lit(x) for kv in STATE_CODES.items() for x in kv))
    each = F.array(*(F.struct(F.lit(skill).alias("skill_category"), paise(i).alias("daily_rate_paise")) for i, skill in enumerate(("UNSKILLED", "SEMI_SKILLED", "SKILLED"), 2)))
    return rows.select("line", state.alias("state_name"), F.try_element_at(codes, state).alias("state_code"), F.inline(each))


def load_rates(old: DataFrame, parsed: DataFrame, effective_from: str = REFERENCE_FROM) -> DataFrame:
    """S3: the next rate table. Of one (state, category, effective_from) the last line read wins over earlier lines and over what was there; loading twice changes nothing."""
    new = parsed.where("state_code is not null").select("state_code", "skill_category", F.lit(effective_from).cast("date").alias("effective_from"), F.struct(F.lit("REFERENCE").alias("source"), "daily_rate_paise").alias("v"), c("line").alias("n"))
    both = old.select("state_code", "skill_category", "effective_from", F.struct("source", "daily_rate_paise").alias("v"), F.lit(-1).cast("long").alias("n")).unionByName(new)
    return both.groupBy("state_code", "skill_category", "effective_from").agg(F.max_by("v", "n").alias("v")).select("state_code", "skill_category", "effective_from", "v.*", F.lit(WORKING_DAYS).alias("working_days"))


_LINES = """SELECT line, state_code, rate.skill AS skill_category, rate.paise AS daily_rate_paise FROM (SELECT line, CASE s WHEN 1 THEN 'DL' WHEN 2 THEN 'TN' WHEN 4 THEN 'JK' WHEN 5 THEN 'KL' WHEN 6 THEN 'KL' END AS state_code,
 unnest([{'skill': 'UNSKILLED', 'paise': (300 + line % 90) * 100}, {'skill': 'SEMI_SKILLED', 'paise': (400 + line % 80) * 100}, {'skill': 'SKILLED', 'paise': (1100 + line % 70) * 100}]) AS rate FROM (SELECT line, line % 7 AS s FROM x_rate_text) WHERE s <> 0)"""


@query("s2_rate_lines", _LINES)
def _s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rates(frame(spark, sf_dir, "x_rate_text")).drop("state_name")


@query("s3_rates_loaded", f"""SELECT state_code, skill_category, effective_from, source, daily_rate_paise, 26 AS working_days FROM (SELECT state_code, skill_category, effective_from, 'NOTIFIED' AS source, daily_rate_paise, -1 AS n FROM x_minimum_wage_rate
 UNION ALL SELECT state_code, skill_category, DATE '2026-03-01', 'REFERENCE', daily_rate_paise, line FROM ({_LINES}) WHERE state_code IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY state_code, skill_category, effective_from ORDER BY n DESC) = 1""")
def _s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed table loaded twice over the notified rates."""
    parsed = parse_rates(frame(spark, sf_dir, "x_rate_text"))
    return load_rates(load_rates(frame(spark, sf_dir, "x_minimum_wage_rate").withColumn("source", F.lit("NOTIFIED")), parsed), parsed)


def printed_counts(removed: DataFrame, printed: DataFrame) -> DataFrame:
    """Documents whose printed number of rows is not the number of accepted ones: (document_id, printed, accepted). Unknown or negative numbers are not compared."""
    return removed.join(printed, "document_id").where("printed >= 0 and printed <> accepted").select("document_id", "printed", "accepted")


@query("n15_printed_counts", """SELECT document_id, seen - document_id % 3 AS printed, accepted FROM (SELECT document_id, count(*) AS seen, count(*) FILTER (WHERE NOT (worker_name IN ('Grand Total', 'Sub.Total', 'c/f', 'Brought   Forward') OR (worker_name IN ('Name', 'Member Name') AND uan IS NULL))
 AND row_id = first) AS accepted FROM (SELECT *, min(row_id) OVER (PARTITION BY document_id, page, amount, skill, worker_name, uan) AS first FROM x_raw_amount) GROUP BY 1) WHERE document_id % 5 <> 0 AND printed <> accepted""")
def _n15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "x_raw_amount")
    removed = cut(cleaning.removed_counts(rows, rows, ["amount", "skill", "worker_name", "uan"]))  # a row a document, read twice
    printed = removed.select("document_id", F.when(c("document_id") % 5 != 0, c("seen") - c("document_id") % 3).alias("printed"))
    return printed_counts(removed, printed)


VIEWS["x_box"] = """
SELECT CAST(l_orderkey AS BIGINT) AS document_id, CAST(l_linenumber AS BIGINT) AS claim_id, CAST(l_partkey % 100 AS DOUBLE) / 128 AS box_left, CAST(l_quantity AS DOUBLE) / 64 AS box_top, CAST(l_suppkey % 20 AS DOUBLE) / 256 AS width,
       CAST(l_linenumber AS DOUBLE) / 512 AS height, CAST(l_partkey AS BIGINT) AS part
FROM lineitem
"""


def box_union(tokens: DataFrame, by: list[str]) -> DataFrame:
    """V4: the box around all of a claim's tokens, to five places: (by, box_left, box_top, width, height)."""
    edges = tokens.groupBy(*by).agg(F.min("box_left").alias("l"), F.min("box_top").alias("t"), F.max(c("box_left") + c("width")).alias("r"), F.max(c("box_top") + c("height")).alias("b"))
    return edges.select(*by, F.bround("l", 5).alias("box_left"), F.bround("t", 5).alias("box_top"), F.bround(F.greatest(F.lit(0.0), c("r") - c("l")), 5).alias("width"), F.bround(F.greatest(F.lit(0.0), c("b") - c("t")), 5).alias("height"))


@query("v4_box_unions", """SELECT document_id, round_even(min(box_left), 5) AS box_left, round_even(min(box_top), 5) AS box_top, round_even(max(box_left + width) - min(box_left), 5) AS width, round_even(max(box_top + height) - min(box_top), 5) AS height FROM x_box GROUP BY 1""")
def _v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_union(frame(spark, sf_dir, "x_box"), ["document_id"])


def plain(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def correction_key(value: Column) -> Column:
    return F.coalesce(F.nullif(n.digits_only(value), F.lit("")), F.nullif(plain(value), F.lit("")))


def apply_corrections(traces: DataFrame, corrections: DataFrame) -> DataFrame:
    """V5: unsupported values that were declared as corrected: the last declaration of a document and key counts. corrections: (document_id, n, corrected_to, reason)."""
    known = corrections.withColumn("key", correction_key(c("corrected_to"))).where("key is not null").groupBy("document_id", "key").agg(F.max_by(F.coalesce("reason", F.lit("no reason given")), "n").alias("note"))
    rows = traces.withColumn("key", F.when(c("verdict") == "UNSUPPORTED", correction_key(c("value")))).join(known, ["document_id", "key"], "left")
    return rows.withColumn("verdict", F.when(c("note").isNotNull(), "CORRECTED").otherwise(c("verdict"))).drop("key")


@query("v5_corrections", """SELECT t.document_id, claim_id, value, CASE WHEN verdict = 'UNSUPPORTED' AND k.note IS NOT NULL THEN 'CORRECTED' ELSE verdict END AS verdict, CASE WHEN verdict = 'UNSUPPORTED' THEN k.note END AS note
 FROM (SELECT document_id, claim_id, 'Rs ' || part AS value, CASE WHEN part % 3 = 0 THEN 'AGREED' ELSE 'UNSUPPORTED' END AS verdict FROM x_box) t
 LEFT JOIN (SELECT document_id, key, arg_max(coalesce(reason, 'no reason given'), n) AS note FROM (SELECT document_id, claim_id AS n, part::VARCHAR AS key, CASE WHEN part % 4 <> 0 THEN 'smudged ' || claim_id END AS reason FROM x_box WHERE part % 5 < 3) GROUP BY 1, 2) k
 ON k.document_id = t.document_id AND k.key = regexp_replace(t.value, '\\D', '', 'g')""")
def _v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = frame(spark, sf_dir, "x_box")
    text = c("part").cast("string")
    traces = boxes.select("document_id", "claim_id", F.concat(F.lit("Rs "), text).alias("value"), F.when(c("part") % 3 == 0, "AGREED").otherwise("UNSUPPORTED").alias("verdict"))
    declared = boxes.where("part % 5 < 3").select("document_id", c("claim_id").alias("n"), F.concat(text, F.lit(".")).alias("corrected_to"), F.when(c("part") % 4 != 0, F.concat(F.lit("smudged "), c("claim_id").cast("string"))).alias("reason"))
    return apply_corrections(traces, declared)


def unsupported_quotes(assertions: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, claim_id, reason) of present answers without a quotation, or whose quotation's first 60 characters no line of the page holds (pages without words are not looked at).
    assertions: (document_id, claim_id, present, quote)."""
    rows = assertions.where(p.truth("present"))
    blank = F.coalesce(F.trim("quote"), F.lit("")) == ""
    found = trace_texts(rows.where(~blank).select("document_id", "claim_id", F.substring("quote", 1, 60).alias("value")), pages).select("document_id", "claim_id").withColumn("_found", F.lit(True))
    read = pages.where(plain(F.coalesce("text", F.lit(""))) != "").select("document_id").distinct().withColumn("_read", F.lit(True))
    rows = rows.join(found, ["document_id", "claim_id"], "left").join(read, "document_id", "left")
    empty = plain(F.substring(F.coalesce("quote", F.lit("")), 1, 60)) == ""
    reason = F.when(blank, "no_quote").when(~empty & p.truth("_read") & ~p.truth("_found"), "quote_not_found")
    return rows.withColumn("reason", reason).where("reason is not null").select("document_id", "claim_id", "reason")


@query("v14_unsupported_quotes", r"""WITH a AS (SELECT document_id, CASE WHEN document_id % 5 = 0 THEN ' ' WHEN document_id % 3 = 0 THEN 'surely not on this page' ELSE substr(text, 11, 30) END AS quote, text FROM x_page_line WHERE document_id % 7 <> 0),
 q AS (SELECT document_id, quote, regexp_replace(lower(substr(quote, 1, 60)), '[^a-z0-9]', '', 'g') AS v, list_transform(string_split(text, chr(10)), lambda l: regexp_replace(lower(l), '[^a-z0-9]', '', 'g')) AS ls FROM a)
 SELECT document_id, 1 AS claim_id, CASE WHEN trim(coalesce(quote, '')) = '' THEN 'no_quote' ELSE 'quote_not_found' END AS reason FROM q
 WHERE trim(coalesce(quote, '')) = '' OR (v <> '' AND len(list_filter(ls, lambda l: l <> '')) > 0 AND len(list_filter(ls, lambda l: contains(l, v) OR (length(v) >= 6 AND contains(l, left(v, 6))))) = 0)""")
def _v14(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = frame(spark, sf_dir, "x_page_line")
    i = c("document_id")
    quote = F.when(i % 5 == 0, " ").when(i % 3 == 0, "surely not on this page").otherwise(F.substring("text", 11, 30))
    return unsupported_quotes(pages.select(i, F.lit(1).alias("claim_id"), (i % 7 != 0).alias("present"), quote.alias("quote")), pages)


def trust_share(provenance: Column) -> Column:
    """Share of a row's fields (map of field to agreement) that were read from the page; 0 without fields."""
    values = F.map_values(provenance)
    trusted = F.size(F.filter(values, lambda v: p.truth(v.isin("AGREED", "OCR_ONLY"))))
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.bround(trusted / F.size(values), 3)).otherwise(0.0)


@query("v15_trust_shares", """SELECT document_id, round_even(count(*) FILTER (WHERE part % 4 < 2)::DOUBLE / count(*), 3) AS share FROM (SELECT document_id, claim_id, min(part) AS part FROM x_box GROUP BY 1, 2) GROUP BY 1""")
def _v15(spark: SparkSession, sf_dir: str) -> DataFrame:
    agreement = F.element_at(F.array(*map(F.lit, ("AGREED", "OCR_ONLY", "MODEL_ONLY", "UNSUPPORTED"))), (c("part") % 4 + 1).cast("int"))
    fields = frame(spark, sf_dir, "x_box").groupBy("document_id", "claim_id").agg(F.min("part").alias("part"))
    rows = fields.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct(c("claim_id").cast("string"), agreement))).alias("provenance"))
    return rows.select("document_id", trust_share(c("provenance")).alias("share"))


def word_lines(words: DataFrame, tolerance: float = 0.004) -> DataFrame:
    """The line of each word of a page (document_id, token, box_left, box_top, height): in reading order a word joins the first line whose first word's centre is near, else it begins one. A fold in the JVM (`pages.page_lines`)."""
    kinds = {"document_id": "long", "token": "long", "box_left": "double", "box_top": "double", "height": "double"}
    rows = words.select(*(c(x).cast(kind).alias(x) for x, kind in kinds.items()))
    return page_lines(rows, tolerance, ["document_id"]).select(*kinds, "line")


@query("v16_word_lines")
def _v16(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = frame(spark, sf_dir, "x_box")
    return word_lines(boxes.select("document_id", c("claim_id").alias("token"), "box_left", (c("box_top") / 64).alias("box_top"), "height")).select("document_id", "token", "line")


def document_reasons(reasons: DataFrame, most: int = 40, width: int = 400) -> DataFrame:
    """(document_id, reasons): distinct review reasons in the order of their first mention, cut to `width` characters, the first `most`. One row per reason before any is gathered."""
    rows = reasons.withColumn("reason", F.substring(F.trim("reason"), 1, width)).where("reason <> ''")
    first = rows.groupBy("document_id", "reason").agg(F.min("n").alias("n"))
    return first.groupBy("document_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("n", "reason"))), 1, most), lambda x: x["reason"]).alias("reasons"))


@query("d8_document_reasons", """SELECT document_id, string_agg(reason, '|' ORDER BY n, reason) AS reasons FROM (SELECT document_id, n, reason, row_number() OVER (PARTITION BY document_id ORDER BY n, reason) AS k FROM (
 SELECT part % 500 AS document_id, 'reason ' || (part // 500) AS reason, min(document_id * 8 + claim_id) AS n FROM x_box GROUP BY 1, 2)) WHERE k <= 40 GROUP BY 1""")
def _d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "x_box").select((c("part") % 500).alias("document_id"), F.concat(F.lit(" reason "), F.floor(c("part") / 500).cast("string")).alias("reason"), (c("document_id") * 8 + c("claim_id")).alias("n"))
    return document_reasons(rows).select("document_id", F.array_join("reasons", "|").alias("reasons"))


def resolvable(rows: DataFrame, name: str = "printed_name", uan: str = "uan") -> DataFrame:
    """L2: rows that can be a person: they have a name, or digits of an account number."""
    return rows.where((F.coalesce(F.trim(name), F.lit("")) != "") | (F.coalesce(n.digits_only(uan), F.lit("")) != ""))


@query("l2_resolvable", "SELECT identity_id FROM x_identity WHERE (identity_id % 6 <> 0 AND trim(display_name) <> '') OR uan IS NOT NULL")
def _l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = frame(spark, sf_dir, "x_identity").withColumn("printed_name", F.when(c("identity_id") % 6 != 0, c("display_name")).when(c("identity_id") % 12 == 0, " "))
    return resolvable(people).select("identity_id")


def link_decisions(pairs: DataFrame, accept: float = 0.75, sure: float = 0.9) -> DataFrame:
    """L4: which known person a printed row is, decided by rule. pairs: shortlisted (establishment_id, name_id, identity_id, score) with same_uan, same_father and same_gender
    (null: one side is silent). Differing account numbers disqualify; an equal one settles; a father counts both ways. A row and a person must be each other's best; ties go to smaller ids.
    (establishment_id, name_id, identity_id, confidence, reviewed), identity_id null: a new person."""
    father = F.when(c("same_father"), 0.15).when(~c("same_father"), -0.3).otherwise(0.0)
    gender = F.when(~c("same_gender"), -0.3).otherwise(0.0)
    score = F.when(~F.coalesce("same_uan", F.lit(True)), 0.0).when(p.truth("same_uan"), 1.0).otherwise(p.clamp(c("score") / 100 * 0.85 + father + gender, 0, 1))
    rows = pairs.withColumn("confidence", F.bround(score, 3)).where(c("confidence") >= accept)
    best = lambda who, other: F.row_number().over(Window.partitionBy("establishment_id", who).orderBy(F.desc("confidence"), other))
    mutual = rows.withColumns({"a": best("name_id", "identity_id"), "b": best("identity_id", "name_id")}).where("a = 1 and b = 1").select("establishment_id", "name_id", "identity_id", "confidence")
    every = pairs.select("establishment_id", "name_id").distinct()
    return every.join(mutual, ["establishment_id", "name_id"], "left").withColumn("reviewed", F.coalesce(c("confidence") >= sure, F.lit(False)))


ORACLE_VIEWS["x_o_short"] = documents.SHORTLIST_SQL


@query("l4_links", """WITH s AS (SELECT t.*, a.uan = b.uan AS same_uan, a.father_name = b.father_name AS same_father FROM x_o_short t JOIN x_identity a ON a.identity_id = t.name_id JOIN x_identity b ON b.identity_id = t.identity_id),
 r AS (SELECT *, round_even(CASE WHEN same_uan = false THEN 0 WHEN same_uan THEN 1 ELSE greatest(0, least(1, score / 100 * 0.85::DOUBLE + CASE WHEN same_father THEN 0.15::DOUBLE WHEN same_father = false THEN -0.3::DOUBLE ELSE 0 END)) END, 3) AS confidence FROM s),
 m AS (SELECT *, row_number() OVER (PARTITION BY establishment_id, name_id ORDER BY confidence DESC, identity_id) AS a, row_number() OVER (PARTITION BY establishment_id, identity_id ORDER BY confidence DESC, name_id) AS b FROM r WHERE confidence >= 0.75)
 SELECT e.establishment_id, e.name_id, m.identity_id, m.confidence, coalesce(m.confidence >= 0.9, false) AS reviewed FROM (SELECT DISTINCT establishment_id, name_id FROM s) e LEFT JOIN m ON m.establishment_id = e.establishment_id AND m.name_id = e.name_id AND a = 1 AND b = 1""")
def _l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortlist of every known person's shortened name, decided."""
    people = frame(spark, sf_dir, "x_identity")
    side = lambda i, x: people.select(c("identity_id").alias(i), c("uan").alias(f"{x}_uan"), c("father_name").alias(f"{x}_father"))
    pairs = documents.shortlist(documents.shortened(people), people).join(side("name_id", "a"), "name_id").join(side("identity_id", "b"), "identity_id")
    pairs = pairs.withColumns({"same_uan": c("a_uan") == c("b_uan"), "same_father": c("a_father") == c("b_father"), "same_gender": F.lit(None).cast("boolean")})
    return link_decisions(pairs)


def absorb(people: DataFrame, rows: DataFrame, most: int = 20) -> DataFrame:
    """Known people enriched by newly read rows (identity_id, n, printed_name, uan, father_name, date_of_joining, is_contract_worker), in their order: blanks are filled by the first row that has a value, a
    longer name replaces a shorter one, new spellings are added up to `most`, and contract work stays."""
    name = F.trim("printed_name")
    fill = [x for x in ("uan", "father_name", "date_of_joining")]
    first = lambda x: F.min_by(x, F.when(c(x).isNotNull(), c("n"))).alias(f"new_{x}")
    longest = F.max_by(name, F.struct(F.length(name), -c("n"))).alias("longest")
    seen = rows.groupBy("identity_id").agg(*map(first, fill), longest, F.max("is_contract_worker").alias("contract"))
    spelled = rows.where(name != "").groupBy("identity_id", name.alias("spelling")).agg(F.min("n").alias("n"))
    spellings = spelled.groupBy("identity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "spelling"))), lambda x: x["spelling"]).alias("spellings"))
    joined = people.join(seen, "identity_id", "left").join(spellings, "identity_id", "left")
    grown = F.when(F.length("longest") > F.length(F.coalesce("display_name", F.lit(""))), c("longest")).otherwise(c("display_name"))
    variants = F.slice(F.array_distinct(F.concat(F.array("display_name"), F.coalesce("spellings", F.array().cast("array<string>")))), 1, most)
    return joined.select("identity_id", grown.alias("display_name"), *(F.coalesce(x, f"new_{x}").alias(x) for x in fill), (p.truth("is_contract_worker") | p.truth("contract")).alias("is_contract_worker"), variants.alias("name_variants"))


_READ = "SELECT b.part % 400 AS identity_id, b.document_id * 8 + b.claim_id AS n, CASE WHEN part % 3 = 0 THEN ' ' ELSE 'Name ' || repeat('x', (part % 40)::INT) END AS printed_name, CASE WHEN part % 4 = 0 THEN lpad(part::VARCHAR, 12, '0') END AS uan, CASE WHEN part % 5 = 0 THEN 'F' || part END AS father_name, part % 90 = 0 AS k FROM x_box b"


@query("l7_absorbed", f"""WITH r AS ({_READ}), s AS (SELECT identity_id, arg_min(uan, n) FILTER (WHERE uan IS NOT NULL) AS u, arg_min(father_name, n) FILTER (WHERE father_name IS NOT NULL) AS f, bool_or(k) AS k FROM r GROUP BY 1),
 l AS (SELECT identity_id, trim(printed_name) AS longest FROM r QUALIFY row_number() OVER (PARTITION BY identity_id ORDER BY length(trim(printed_name)) DESC, n) = 1),
 v AS (SELECT identity_id, trim(printed_name) AS spelling, min(n) AS n FROM r WHERE trim(printed_name) <> '' GROUP BY 1, 2), w AS (SELECT identity_id, list(spelling ORDER BY n, spelling) AS sp FROM v GROUP BY 1)
 SELECT i.identity_id, CASE WHEN length(longest) > length(display_name) THEN longest ELSE display_name END AS display_name, coalesce(uan, u) AS uan, coalesce(father_name, f) AS father_name, date_of_joining, is_contract_worker OR coalesce(k, false) AS is_contract_worker,
 array_to_string(list_concat([display_name], list_filter(coalesce(sp, []), lambda x: x <> display_name))[1:20], '|') AS name_variants FROM x_identity i LEFT JOIN s USING (identity_id) LEFT JOIN l USING (identity_id) LEFT JOIN w USING (identity_id)""")
def _l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = c("part")
    rows = frame(spark, sf_dir, "x_box").select(
        (part % 400).alias("identity_id"), (c("document_id") * 8 + c("claim_id")).alias("n"), F.when(part % 3 == 0, " ").otherwise(F.concat(F.lit("Name "), F.repeat(F.lit("x"), (part % 40).cast("int")))).alias("printed_name"),
        F.when(part % 4 == 0, F.lpad(part.cast("string"), 12, "0")).alias("uan"), F.when(part % 5 == 0, F.concat(F.lit("F"), part.cast("string"))).alias("father_name"), F.lit(None).cast("date").alias("date_of_joining"), (part % 90 == 0).alias("is_contract_worker"),
    )
    return absorb(frame(spark, sf_dir, "x_identity"), rows).withColumn("name_variants", F.array_join("name_variants", "|"))


def match_employers(headers: DataFrame, establishments: DataFrame, registrations: DataFrame) -> DataFrame:
    """The establishment of each document header (document_id, organisation_id, number, employer_name): active ones of the same organisation only. A registration number outranks the name; a match must be
    the only one. (document_id, establishment_id, basis), both null: unbound."""
    own = establishments.where("is_active").select("establishment_id", "organisation_id", n.name_key("name").alias("_name"))
    numbers = registrations.select("establishment_id", F.upper(F.regexp_replace("number", "[^A-Za-z0-9]", "")).alias("_number")).distinct().join(own.select("establishment_id", "organisation_id"), "establishment_id")
    keyed = headers.withColumns({"_number": F.upper(F.regexp_replace("number", "[^A-Za-z0-9]", "")), "_name": n.name_key("employer_name")})
    only = lambda df, basis: df.groupBy("document_id").agg(F.min("establishment_id").alias(basis), F.max("establishment_id").alias("_top")).where(c(basis) == c("_top")).drop("_top")
    by_number = only(keyed.where("_number <> ''").join(numbers, ["organisation_id", "_number"]), "by_number")
    by_name = only(keyed.where("_name <> ''").join(own, ["organisation_id", "_name"]), "by_name")
    found = headers.select("document_id").join(by_number, "document_id", "left").join(by_name, "document_id", "left")
    return found.select("document_id", F.coalesce("by_number", "by_name").alias("establishment_id"), F.when(c("by_number").isNotNull(), "number").when(c("by_name").isNotNull(), "name").alias("basis"))


@query("l8_bound_headers", """WITH h AS (SELECT filed AS document_id, (establishment_id + filed % 2) % 7 AS organisation_id, CASE WHEN filed % 3 <> 0 THEN lower(number) END AS number, 'Mr. Supplier#' || lpad(establishment_id::VARCHAR, 9, '0') AS employer_name FROM x_registration),
 a AS (SELECT document_id, min(r.establishment_id) AS x, max(r.establishment_id) AS y FROM h JOIN x_registration r ON upper(regexp_replace(r.number, '[^A-Za-z0-9]', '', 'g')) = upper(regexp_replace(h.number, '[^A-Za-z0-9]', '', 'g')) JOIN x_establishment e ON e.establishment_id = r.establishment_id AND e.is_active AND e.organisation_id = h.organisation_id GROUP BY 1),
 b AS (SELECT document_id, min(establishment_id) AS x, max(establishment_id) AS y FROM h JOIN x_establishment e ON e.is_active AND e.organisation_id = h.organisation_id AND regexp_replace(upper(e.name), '[^A-Z0-9]', ' ', 'g') = 'SUPPLIER ' || substr(employer_name, 14) GROUP BY 1)
 SELECT h.document_id, CASE WHEN a.x = a.y THEN a.x WHEN b.x = b.y THEN b.x END AS establishment_id, CASE WHEN a.x = a.y THEN 'number' WHEN b.x = b.y THEN 'name' END AS basis FROM h LEFT JOIN a USING (document_id) LEFT JOIN b USING (document_id)""")
def _l8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with a registration number in two of three cases, half of them from another organisation."""
    filed = frame(spark, sf_dir, "x_registration")
    headers = filed.select(c("filed").alias("document_id"), ((c("establishment_id") + c("filed") % 2) % 7).alias("organisation_id"), F.when(c("filed") % 3 != 0, F.lower("number")).alias("number"), F.concat(F.lit("Mr. Supplier#"), F.lpad(c("establishment_id").cast("string"), 9, "0")).alias("employer_name"))
    return match_employers(headers, frame(spark, sf_dir, "x_establishment"), filed)


def sound_period(start: Column, end: Column) -> tuple[Column, Column]:
    """A period that ends before it begins was misread: both ends are dropped."""
    bad = p.truth(end < start)
    return F.when(~bad, start), F.when(~bad, end)


@query("l9_sound_periods", "SELECT filed, CASE WHEN coalesce(valid_to >= valid_from, true) THEN valid_from END AS valid_from, CASE WHEN valid_to >= valid_from THEN valid_to END AS valid_to FROM x_registration")
def _l9(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = sound_period(c("valid_from"), c("valid_to"))
    return frame(spark, sf_dir, "x_registration").select("filed", start.alias("valid_from"), end.alias("valid_to"))
