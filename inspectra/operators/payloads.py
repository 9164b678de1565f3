"""JSON payloads of document pages to typed rows, one shape for each family of document types.

A payload is parsed once, to VARIANT; its entries are exploded beside it and its fields read by path, so a page costs no shuffle.
Numbers count by value (1.50 is 1.5), amounts never pass through a binary fraction. What is no JSON, or repeats a key in one object, has no entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.functions import normalise as n
from inspectra.functions import predicates as p
from inspectra.operators import cleaning
from inspectra.plans.registry import query
from inspectra.sources.views import ORACLE_VIEWS, VIEWS, frame

c = F.col

# The document types of each family; all other types answer in prose.
FAMILIES = {
    "wage": ["WAGE_REGISTER", "WAGE_SLIP", "OVERTIME_REGISTER", "DEDUCTION_REGISTER"],
    "employee": ["EMPLOYEE_REGISTER"],
    "attendance": ["MUSTER_ROLL", "LEAVE_REGISTER"],
    "contribution": ["EPF_ECR", "ESIC_CHALLAN"],
    "incident": ["ACCIDENT_REGISTER"],
    "registration": ["ESTABLISHMENT_REGISTRATION", "CONTRACTOR_LICENCE", "BOCW_CESS_RECEIPT"],
}
# The fields of an entry by kind, as `name` or `name in the payload>name in the table`.
SHAPES = {
    "wage": {
        "text": "worker_name father_or_husband_name>father_name employee_code uan designation gender",
        "int": "row_number",
        "skill": "skill_category",
        "number": "days_paid days_present normal_hours_per_day overtime_hours",
        "money": "basic>basic_paise dearness_allowance>da_paise other_allowances>other_allowances_paise gross>gross_paise overtime_amount>overtime_paise overtime_rate>overtime_rate_paise pf_deduction>pf_paise "
        "esi_deduction>esi_paise advance_recovery>advance_paise total_deductions>deductions_paise net_paid>net_paid_paise",
        "date": "paid_on date_of_joining date_of_exit",
    },
    "employee": {"text": "worker_name father_or_husband_name>father_name employee_code uan esic_number designation gender contractor_name", "int": "row_number", "skill": "skill_category", "date": "date_of_birth date_of_joining date_of_exit", "flag": "is_contract_worker"},
    "attendance": {"text": "worker_name employee_code daily_marks", "number": "days_present days_absent total_hours overtime_hours max_daily_hours max_weekly_hours", "int": "weekly_offs_given longest_consecutive_days"},
    "contribution": {"text": "worker_name uan member_id", "money": "wage_base>wage_base_paise employee_share>employee_share_paise employer_share>employer_share_paise", "number": "ncp_days"},
    "incident": {"text": "description severity notification_reference", "date": "occurred_on notified_on", "int": "workers_affected"},
    "registration": {"text": "kind number issuing_authority holder_name", "date": "valid_from valid_to", "int": "licensed_worker_count"},
    "prose": {"text": "key value>value_text quote", "flag": "present", "number": "confidence"},
}
# Fields of the header; names and numbers that a row may carry; fields around the entries of every shape.
HEADER = {"text": "establishment_name lin registration_number address state wage_period_basis", "date": "period_start period_end"}
NAMES = ["worker_name", "employee_name", "member_name", "name"]
NUMBERS = ["employee_code", "uan", "member_id", "esic_number"]
AROUND = ["header", "corrections", "unreadable_regions", "notes"]

PARSERS = {"text": n.clean_text, "number": n.parse_number, "int": n.parse_int, "money": n.parse_paise, "date": n.parse_date, "skill": n.parse_skill}


def fields(shape: dict[str, str]) -> list[tuple[str, str, str]]:
    """(kind, name in the payload, name in the table)"""
    return [(kind, f.split(">")[0], f.split(">")[-1]) for kind, names in shape.items() for f in names.split()]


def _text(item: str, path: str) -> Column:
    return F.try_variant_get(item, f"$.{path}", "string")


def _typed(item: str, kind: str, path: str) -> Column:
    if kind == "flag":
        return F.coalesce(F.try_variant_get(item, f"$.{path}", "boolean"), F.lit(False))
    return PARSERS[kind](_text(item, path))


def _keys(item: Column | str) -> Column:
    """Null where the value is no object."""
    return F.map_keys(F.try_variant_get(item, "$", "map<string,variant>"))


def family(doc_type: Column | str = "doc_type") -> Column:
    out = F.lit("prose")
    for name, types in FAMILIES.items():
        out = F.when(p.col(doc_type).isin(types), name).otherwise(out)
    return out


def payload_items(payloads: DataFrame, about: dict[str, Column] | None = None) -> DataFrame:
    """The entries of payloads (document_id, page, doc_type, payload, and `pages`, the pages that it was read from; without it `page` alone).

    Adds family, whole (the payload), n (the place of the entry), item, entry_page, reason (N10-N13: why a row of a table is removed; null: accepted).
    about: columns over `whole`, worked out once a payload, not once an entry. A payload without entries keeps one row with null n. Rows of tables must name one of the payload's pages by a whole number; answers and
    certificates that do not are taken to be on `page`. Of equal entries of a payload the first stays."""
    pages = c("pages") if "pages" in payloads.columns else F.array(c("page").cast("int"))
    base = payloads.select("document_id", c("page").cast("int").alias("page"), "doc_type", pages.cast("array<int>").alias("_pages"), family().alias("family"), F.try_parse_json("payload").alias("whole"))
    listed = lambda name: F.try_variant_get("whole", f"$.{name}", "array<variant>")
    entries = F.when(c("family") == "registration", F.when(_keys("whole").isNotNull(), F.array("whole"))).when(c("family") == "prose", listed("assertions")).otherwise(listed("rows"))
    about = about or {}
    # Sorted by their canonical text, equal entries are neighbours: no comparison of all with all, and no shuffle.
    marked = F.transform("_items", lambda x, i: F.when(_keys(x).isNotNull(), F.struct(F.to_json(x).alias("text"), i.alias("n"))))
    rows = base.withColumns({**about, "_items": entries}).withColumn("_sorted", F.array_sort(F.array_compact(marked)))
    one = lambda x, i: F.struct(x["n"].alias("n"), F.get("_items", x["n"]).alias("item"), ((i > 0) & (F.get("_sorted", i - 1)["text"] == x["text"])).alias("_repeated"))
    rows = rows.select("document_id", "doc_type", "page", "_pages", "family", "whole", *about, F.inline_outer(F.transform("_sorted", one)))
    claimed = F.when(F.schema_of_variant(F.try_variant_get("item", "$.page", "variant")) == "BIGINT", F.try_variant_get("item", "$.page", "int"))
    known = p.truth(F.array_contains("_pages", claimed))
    name = F.coalesce(*(_text("item", k) for k in NAMES))
    has_number = F.coalesce(F.greatest(*(F.length(_text("item", k)) for k in NUMBERS)), F.lit(0)) > 0
    is_table = ~c("family").isin("registration", "prose")
    return rows.select(
        "document_id", "doc_type", "page", "family", "whole", "n", "item", F.when(known & (c("family") != "registration"), claimed).otherwise(c("page")).alias("entry_page"),
        F.when(is_table & c("n").isNotNull(), n.row_reason(name, known, has_number, c("_repeated"))).alias("reason"), *about,
    )


def _review(kind: str) -> Column:
    """V6, V7, V9, V13 and the checks of certificates and answers: the names of what is doubtful about an entry."""
    if kind == "wage":
        return F.concat(cleaning.wage_reasons(), cleaning.bad_formats(c("uan")))
    if kind == "employee":
        return cleaning.bad_formats(c("uan"), esic=c("esic_number"))
    checks = {
        "attendance": [(c("days_present") + c("days_absent") > 31, "days"), (c("max_daily_hours") > 24, "daily"), (c("max_weekly_hours") > 168, "weekly"), (c("longest_consecutive_days") > 31, "run")],
        "contribution": [(c("employee_share_paise") > c("wage_base_paise"), "share"), (~c("ncp_days").between(0, 31), "ncp")],
        "incident": [(c("notified_on") < c("occurred_on"), "notified_before")],
        "registration": [(c("number").isNull(), "no_number"), (c("valid_to") < c("valid_from"), "ends_before")],
        "prose": [(c("present") & c("quote").isNull(), "no_quote")],
    }[kind]
    found = cleaning.reasons(*checks)
    return F.concat(found, cleaning.bad_formats(c("uan"))) if kind == "contribution" else found


def payload_rows(payloads: DataFrame, kind: str) -> DataFrame:
    """The typed entries of one family: document_id, doc_type, page, n, reason, the fields of the shape, unknown_fields and missing_fields
    (names that the shape does not have, or the entry does not), and review. Of a certificate the fields around the entries count as known."""
    types = [t for ts in FAMILIES.values() for t in ts]
    own = payloads.where(c("doc_type").isin(FAMILIES[kind]) if kind != "prose" else ~p.truth(c("doc_type").isin(types)))
    shape = fields(SHAPES[kind])
    names = [f for _, f, _ in shape] + ([] if kind == "registration" else ["page"])
    known, keys = F.array(*(F.lit(f) for f in names)), _keys("item")
    rows = payload_items(own).where("n is not null").select(
        "document_id", "doc_type", c("entry_page").alias("page"), "n", "reason", *(_typed("item", k, source).alias(target) for k, source, target in shape),
        F.array_except(keys, F.concat(known, F.array(*(F.lit(f) for f in AROUND))) if kind == "registration" else known).alias("unknown_fields"), F.array_except(known, keys).alias("missing_fields"),
    )
    if kind == "attendance":
        derived = n.longest_run("daily_marks")
        rows = rows.withColumns({"run_recomputed": p.truth(derived != c("longest_consecutive_days")), "longest_consecutive_days": F.coalesce(derived.cast("long"), "longest_consecutive_days")})
    if kind == "contribution":
        rows = rows.withColumn("scheme", F.when(c("doc_type") == "EPF_ECR", "EPF").otherwise("ESIC"))
    if kind == "registration":
        rows = rows.withColumn("kind", F.coalesce("kind", F.lit("ESTABLISHMENT_REGISTRATION")))
    return rows.withColumn("review", _review(kind))


def payload_documents(payloads: DataFrame) -> DataFrame:
    """D10, N14, V11, V12 over payloads (one a page): a row a document with its merged header, scheme, challan and deposit day (each from the first page that has it), printed totals,
    counts of rows seen, accepted and removed, and review: nothing_extracted, illegible, gross_total (over a rupee and a hundredth off), row_count. One aggregation, combined before its shuffle."""
    first = lambda value: F.min_by(value, F.when(value.isNotNull(), c("page")))
    head = {target: _typed("whole", k, f"header.{source}") for k, source, target in fields(HEADER)}
    head |= {"scheme": n.clean_text(_text("whole", "scheme")), "challan_number": n.clean_text(_text("whole", "challan_number")), "deposited_on": n.parse_date(_text("whole", "deposited_on"))}
    totals = {"printed_gross_paise": n.parse_paise(_text("whole", "printed_totals.gross")), **{f"_{k}": n.parse_int(_text("whole", f"printed_totals.{k}")) for k in ("worker_count", "member_count")}}
    bad = F.coalesce(F.size(F.try_variant_get("whole", "$.unreadable_regions", "array<variant>")), F.lit(0))
    found = payload_items(payloads, {**head, **totals, "_bad": bad})
    seen, kept = c("n").isNotNull(), c("n").isNotNull() & c("reason").isNull()
    rows = found.select(
        "document_id", "page", "doc_type", "family", "n", "reason", F.when(kept & (c("family") == "wage"), n.parse_paise(_text("item", "gross"))).alias("_gross"), *head, *totals, "_bad",
    )
    out = rows.groupBy("document_id").agg(
        F.min_by("doc_type", "page").alias("doc_type"), F.min_by("family", "page").alias("_family"), *(first(c(k)).alias(k) for k in head | totals), F.count_if(seen).alias("seen"), F.count_if(kept).alias("accepted"),
        *(F.count_if(p.truth(c("reason") == k)).alias(f"removed_{k}") for k in ("bad_page", "total", "header", "duplicate")), F.sum("_gross").alias("summed_gross_paise"), F.max("_bad").alias("_bad"),
    )
    printed = F.coalesce(F.when(c("_worker_count") != 0, c("_worker_count")), "_member_count")
    counted = c("_family").isin("wage", "employee", "contribution") & (c("accepted") > 0) & (printed > 0)
    gross = (c("printed_gross_paise") != 0) & (c("summed_gross_paise") != 0) & (F.abs(c("summed_gross_paise") - c("printed_gross_paise")) > F.greatest(F.lit(100), F.floor(c("printed_gross_paise") / 100)))
    review = cleaning.reasons(((c("accepted") == 0) & (c("_family") != "registration"), "nothing_extracted"), (c("_bad") > 0, "illegible"), (gross, "gross_total"), (counted & (printed != c("accepted")), "row_count"))
    scheme = F.when(c("_family") == "contribution", F.coalesce("scheme", F.when(c("doc_type") == "EPF_ECR", "EPF").otherwise("ESIC")))
    return out.withColumns({"printed_count": printed, "review": review, "scheme": scheme}).drop("_family", "_bad", "_worker_count", "_member_count")


# Queries: payloads of two pages a document, made from the test tables, against DuckDB's own JSON functions.


def _json(*parts: tuple[str, str]) -> str:
    """SQL of a JSON object. A value in double quotes is a text, else it stands as it is; null is null."""
    one = lambda name, x: f"'\"{name}\":' || coalesce('\"' || {x[1:-1]} || '\"', 'null')" if x.startswith('"') else f"'\"{name}\":' || coalesce(CAST({x} AS VARCHAR(60)), 'null')"
    return "'{' || " + " || ',' || ".join(one(*f) for f in parts) + " || '}'"


VIEWS["x_payload_line"] = """
SELECT CAST(l_orderkey AS BIGINT) AS document_id, CASE WHEN l_linenumber > 4 THEN 2 ELSE 1 END AS page, CAST(l_linenumber AS INT) AS ln, CAST(l_orderkey % 7 AS INT) AS fam, CAST(l_partkey AS BIGINT) AS pk, CAST(l_quantity AS INT) AS q,
       CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) AS d, CAST(CAST(CAST(l_shipdate AS DATE) + 9 AS DATE) AS VARCHAR(10)) AS e, CAST(l_partkey % 900 AS VARCHAR(10)) AS code, CAST(100000000000 + l_partkey AS VARCHAR(20)) AS uan,
       CASE WHEN l_partkey % 13 = 0 THEN 'Grand  Total' WHEN l_partkey % 17 = 0 THEN 'Name' ELSE ' Worker  ' || CAST(l_suppkey AS VARCHAR(20)) END AS name,
       CASE WHEN l_partkey % 19 = 0 THEN '99' WHEN l_partkey % 23 = 0 THEN '"1"' WHEN l_partkey % 29 = 0 THEN 'null' WHEN l_linenumber > 4 THEN '2' ELSE '1' END AS pg
FROM lineitem
"""
_D2 = "substr(d, 9, 2) || '/' || substr(d, 6, 2) || '/' || substr(d, 1, 4)"
_N = "CASE WHEN pk % 17 <> 0 THEN {} END"
VIEWS["x_payload_entry"] = f"""
SELECT document_id, page, ln, fam, pk, d, CASE fam
 WHEN 0 THEN {_json(("page", "pg"), ("row_number", "ln"), ("worker_name", '"name"'), ("father_or_husband_name", '"CASE WHEN pk % 4 = 0 THEN \'n/a\' ELSE \'F \' || code END"'), ("employee_code", f'"{_N.format("code")}"'), ("uan", f'"{_N.format("uan")}"'), ("designation", '"CASE WHEN pk % 3 = 0 THEN \'Fitter\' END"'), ("skill_category", '"CASE pk % 4 WHEN 0 THEN \'semi skilled\' WHEN 1 THEN \'SKILLED\' WHEN 2 THEN \'expert\' END"'), ("gender", '"CASE WHEN pk % 2 = 0 THEN \'F\' ELSE \'M\' END"'), ("days_paid", "q % 32"), ("days_present", "CASE WHEN pk % 5 <> 0 THEN q % 32 END"), ("normal_hours_per_day", "8.5"), ("overtime_hours", "q % 9"), ("basic", '"CAST(q * 300 AS VARCHAR(10)) || \'.50\'"'), ("dearness_allowance", '"CASE WHEN pk % 3 = 0 THEN \'-\' ELSE \'₹ 1,\' || CAST(100 + q AS VARCHAR(10)) END"'), ("other_allowances", "q * 10"), ("gross", '"CAST(q * 400 AS VARCHAR(10)) || \'.255\'"'), ("overtime_amount", '"CAST(q AS VARCHAR(10))"'), ("overtime_rate", "12.25"), ("pf_deduction", '"\'(\' || CAST(q AS VARCHAR(10)) || \')\'"'), ("esi_deduction", "q"), ("advance_recovery", "NULL"), ("total_deductions", "q * 2"), ("net_paid", '"CAST(q * 398 AS VARCHAR(10))"'), ("paid_on", '"d"'), ("date_of_joining", f'"{_D2}"'), ("date_of_exit", '"CASE WHEN pk % 9 = 0 THEN \'soon\' END"'), ("remarks", "ln"))}
 WHEN 1 THEN {_json(("page", "pg"), ("row_number", "ln"), ("worker_name", '"name"'), ("father_or_husband_name", "NULL"), ("employee_code", f'"{_N.format("code")}"'), ("uan", f'"{_N.format("uan")}"'), ("esic_number", '"CASE WHEN pk % 17 <> 0 THEN CASE WHEN pk % 3 = 0 THEN \'12-34\' ELSE \'1234567890\' END END"'), ("designation", '"\' Helper \'"'), ("skill_category", '"\'UNSKILLED\'"'), ("gender", '"\'F\'"'), ("date_of_birth", f'"{_D2}"'), ("date_of_joining", '"d"'), ("is_contract_worker", "CASE pk % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END"), ("contractor_name", '"CASE WHEN pk % 3 = 0 THEN \'C \' || code END"'))}
 WHEN 2 THEN {_json(("page", "pg"), ("worker_name", '"name"'), ("employee_code", f'"{_N.format("code")}"'), ("days_present", "q"), ("days_absent", '"CASE WHEN pk % 3 = 0 THEN \'--\' ELSE \'1.5\' END"'), ("weekly_offs_given", '"\'4.5\'"'), ("total_hours", '"\'1,2\' || code"'), ("overtime_hours", "q % 11"), ("max_daily_hours", "q % 27"), ("max_weekly_hours", "q * 4"), ("longest_consecutive_days", "q % 8"), ("daily_marks", '"CASE pk % 4 WHEN 0 THEN \'PPAPPPW\' WHEN 1 THEN \'PP\' WHEN 2 THEN \'PPPPAP\' END"'))}
 WHEN 3 THEN {_json(("page", "pg"), ("worker_name", '"name"'), ("uan", f'"{_N.format("CASE WHEN pk % 5 = 0 THEN code ELSE uan END")}"'), ("member_id", f'"{_N.format("code")}"'), ("wage_base", '"CAST(q * 100 AS VARCHAR(10)) || \'.5\'"'), ("employee_share", '"CAST(q * CASE WHEN pk % 6 = 0 THEN 101 ELSE 12 END AS VARCHAR(10))"'), ("employer_share", "q * 13"), ("ncp_days", "q - 5"))}
 WHEN 4 THEN {_json(("page", "pg"), ("occurred_on", '"d"'), ("description", '"\'fall  from  \' || code"'), ("severity", '"CASE pk % 3 WHEN 0 THEN \'fatal\' WHEN 1 THEN \'None\' END"'), ("workers_affected", "q % 4"), ("notified_on", '"CASE WHEN pk % 4 = 0 THEN \'1990-01-02\' WHEN pk % 4 = 1 THEN e END"'), ("notification_reference", '"CASE WHEN pk % 4 < 2 THEN \'R/\' || code END"'))}
 WHEN 5 THEN {_json(("kind", '"CASE WHEN pk % 3 = 0 THEN \'EPF\' END"'), ("number", '"CASE WHEN pk % 4 = 0 THEN \' - \' ELSE \'L-\' || code END"'), ("issuing_authority", '"\'Board\'"'), ("holder_name", '"name"'), ("valid_from", '"d"'), ("valid_to", '"CASE WHEN pk % 5 = 0 THEN \'1991-02-03\' WHEN pk % 5 < 3 THEN e END"'), ("licensed_worker_count", '"CAST(q AS VARCHAR(10))"'), ("colour", "q"))}
 ELSE {_json(("key", '"\'k\' || CAST(ln AS VARCHAR(10))"'), ("present", "CASE pk % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END"), ("value", '"CASE WHEN pk % 3 = 0 THEN code END"'), ("quote", '"CASE WHEN pk % 6 = 0 THEN \'said  \' || code END"'), ("page", "pg"), ("confidence", "0.75"))} END AS j
FROM x_payload_line
"""
_ENTRIES = "concat_ws(',', " + ", ".join(f"max(CASE WHEN ln = {i} THEN CASE WHEN pk % 10 = 0 THEN j || ',' || replace(j, '{{\"', '{{ \"') WHEN pk % 31 = 0 THEN j || ',7' ELSE j END END)" for i in range(1, 8)) + ")"
_HEAD = """'"header":{"establishment_name":' || CASE WHEN page = 1 AND document_id % 2 = 0 THEN 'null' ELSE '" Works  ' || CAST(page AS VARCHAR(10)) || '"' END || ',"state":"MH","period_start":"' || min(d) || '"},"unreadable_regions":' || CASE WHEN document_id % 12 = 0 THEN '[{"page":1}]' ELSE '[]' END"""
VIEWS["x_payload_page"] = f"""
SELECT document_id, page, CASE fam WHEN 0 THEN CASE WHEN document_id % 2 = 0 THEN 'WAGE_REGISTER' ELSE 'WAGE_SLIP' END WHEN 1 THEN 'EMPLOYEE_REGISTER' WHEN 2 THEN 'MUSTER_ROLL' WHEN 3 THEN CASE WHEN document_id % 2 = 0 THEN 'EPF_ECR' ELSE 'ESIC_CHALLAN' END
         WHEN 4 THEN 'ACCIDENT_REGISTER' WHEN 5 THEN 'CONTRACTOR_LICENCE' ELSE CASE WHEN document_id % 2 = 0 THEN 'ANNUAL_RETURN' END END AS doc_type,
       CASE WHEN document_id % 41 = 0 AND page = 1 THEN 'no json' WHEN document_id % 43 = 0 THEN '{{"rows":4}}' WHEN document_id % 47 = 0 THEN NULL
            WHEN fam = 5 THEN '{{' || {_HEAD} || ',' || substr(min(j), 2)
            ELSE '{{' || {_HEAD} || ',"scheme":' || CASE WHEN document_id % 3 = 0 THEN '"EPF"' ELSE 'null' END || ',"challan_number":' || CASE WHEN page = 2 THEN '"T 1"' ELSE 'null' END || ',"deposited_on":"' || max(d) || '","printed_totals":{{"gross":"' || CAST(document_id % 9 * 5000 AS VARCHAR(20))
                 || '","worker_count":' || CAST(document_id % 3 AS VARCHAR(10)) || ',"member_count":"4"}},' || CASE WHEN fam = 6 THEN '"assertions":[' ELSE '"rows":[' END || {_ENTRIES} || ']}}' END AS payload
FROM x_payload_entry GROUP BY document_id, page, fam
"""

_BLANK_SQL = ", ".join(f"'{b}'" for b in n.BLANKS)


def _sql(kind: str, text: str) -> str:
    """DuckDB SQL of one typed value."""
    clean = f"(SELECT CASE WHEN lower(t) NOT IN ({_BLANK_SQL}) THEN t END FROM (SELECT trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS t))"
    return {
        "text": clean,
        "number": f"try_cast(replace({clean}, ',', '') AS DOUBLE)",
        "int": f"round_even(try_cast(replace({clean}, ',', '') AS DOUBLE), 0)::BIGINT",
        "money": f"(SELECT CASE WHEN m LIKE '(%)' THEN -1 ELSE 1 END * round(try_cast(regexp_replace(m, '[^0-9.\\-]', '', 'g') AS DECIMAL(30,10)) * 100, 0)::BIGINT FROM (SELECT {clean} AS m))",
        "date": f"coalesce(try_strptime({clean}, '%Y-%m-%d'), try_strptime({clean}, '%d/%m/%Y'))::DATE",
        "skill": f"(SELECT CASE WHEN s IN ('UNSKILLED', 'SEMI_SKILLED', 'SKILLED', 'HIGHLY_SKILLED') THEN s END FROM (SELECT translate(upper({clean}), ' -', '__') AS s))",
        "flag": f"coalesce({text} = 'true', false)",
    }[kind]


_FAMILY_SQL = "CASE " + " ".join(f"WHEN doc_type IN ({', '.join(repr(t) for t in types)}) THEN '{name}'" for name, types in FAMILIES.items()) + " ELSE 'prose' END"
ORACLE_VIEWS["x_o_item"] = f"""
SELECT *, CASE WHEN n IS NULL OR family IN ('registration', 'prose') THEN NULL WHEN known IS NOT TRUE THEN 'bad_page' WHEN name IN ('GRAND TOTAL') THEN 'total' WHEN name = 'NAME' AND ids = 0 THEN 'header'
       WHEN row_number() OVER (PARTITION BY document_id, page, item::VARCHAR ORDER BY n) > 1 THEN 'duplicate' END AS reason FROM (
  SELECT *, CASE WHEN json_type(item, '$.page') IN ('UBIGINT', 'BIGINT') THEN (item->>'page')::INT = page ELSE false END AS known, upper(trim(regexp_replace(coalesce(item->>'worker_name', ''), '\\s+', ' ', 'g'))) AS name,
         length(coalesce(item->>'employee_code', '')) + length(coalesce(item->>'uan', '')) + length(coalesce(item->>'member_id', '')) + length(coalesce(item->>'esic_number', '')) AS ids FROM (
    SELECT document_id, page::INT AS page, doc_type, family, whole, unnest(CASE WHEN len(items) > 0 THEN items ELSE [NULL] END) AS item, unnest(CASE WHEN len(items) > 0 THEN range(len(items)) ELSE [NULL] END) AS n FROM (
      SELECT *, CASE family WHEN 'registration' THEN CASE WHEN whole IS NOT NULL THEN [whole] END WHEN 'prose' THEN json_extract(whole, '$.assertions[*]') ELSE json_extract(whole, '$.rows[*]') END AS items
      FROM (SELECT *, {_FAMILY_SQL} AS family, CASE WHEN json_valid(payload) THEN payload::JSON END AS whole FROM x_payload_page))) WHERE n IS NULL OR json_type(item) = 'OBJECT')
"""


def _rows_sql(kind: str) -> str:
    shape = fields(SHAPES[kind])
    names = [f for _, f, _ in shape] + ([] if kind == "registration" else ["page"])
    known = ", ".join(f"'{f}'" for f in names)
    around = known + "".join(f", '{f}'" for f in AROUND) if kind == "registration" else known
    typed = {target: _sql(k, f"(item->>'{source}')") for k, source, target in shape}
    extra = ""
    if kind == "attendance":
        # Fixed by the view: three marks or more hold runs of 3 and 4.
        run = "CASE item->>'daily_marks' WHEN 'PPAPPPW' THEN 3 WHEN 'PPPPAP' THEN 4 END"
        claimed = typed["longest_consecutive_days"]
        typed["longest_consecutive_days"] = f"coalesce({run}, {claimed})::BIGINT"
        extra = f", coalesce({run} <> {claimed}, false) AS run_recomputed"
    if kind == "contribution":
        extra = ", CASE doc_type WHEN 'EPF_ECR' THEN 'EPF' ELSE 'ESIC' END AS scheme"
    if kind == "registration":
        typed["kind"] = f"coalesce({typed['kind']}, 'ESTABLISHMENT_REGISTRATION')"
    columns = ", ".join(f"{x} AS {t}" for t, x in typed.items())
    uan = "CASE WHEN NOT regexp_matches(uan, '^[0-9]{12}$') AND trim(uan) <> '' THEN 'uan' END"
    parts = "CASE WHEN coalesce(basic_paise, da_paise, other_allowances_paise) IS NOT NULL THEN coalesce(basic_paise, 0) + coalesce(da_paise, 0) + coalesce(other_allowances_paise, 0) END"
    checks = {
        "wage": f"""CASE WHEN abs(gross_paise - {parts}) > 100 THEN 'gross' END, CASE WHEN abs(net_paid_paise - (gross_paise + coalesce(overtime_paise, 0) - coalesce(deductions_paise, 0))) > 100 THEN 'net' END,
          CASE WHEN abs(deductions_paise - (pf_paise + esi_paise + advance_paise)) > 100 THEN 'deductions' END, CASE WHEN abs(overtime_paise - overtime_hours * overtime_rate_paise) > greatest(100, trunc(overtime_hours) * 100) THEN 'overtime' END, CASE WHEN days_paid > 31 THEN 'days' END, {uan}""",
        "employee": f"{uan}, CASE WHEN NOT regexp_matches(esic_number, '^([0-9]{{10}}|[0-9]{{17}})$') THEN 'esic' END",
        "attendance": "CASE WHEN days_present + days_absent > 31 THEN 'days' END, CASE WHEN max_daily_hours > 24 THEN 'daily' END, CASE WHEN max_weekly_hours > 168 THEN 'weekly' END, CASE WHEN longest_consecutive_days > 31 THEN 'run' END",
        "contribution": f"CASE WHEN employee_share_paise > wage_base_paise THEN 'share' END, CASE WHEN ncp_days NOT BETWEEN 0 AND 31 THEN 'ncp' END, {uan}",
        "incident": "CASE WHEN notified_on < occurred_on THEN 'notified_before' END",
        "registration": "CASE WHEN number IS NULL THEN 'no_number' END, CASE WHEN valid_to < valid_from THEN 'ends_before' END",
        "prose": "CASE WHEN present AND quote IS NULL THEN 'no_quote' END",
    }[kind]
    return f"""SELECT *, concat_ws(',', {checks}) AS review FROM (SELECT document_id, doc_type, page, n::INT AS n, reason, {columns}{extra},
 array_to_string(list_sort(list_filter(json_keys(item), lambda k: k NOT IN ({around}))), ',') AS unknown_fields, array_to_string(list_filter([{known}], lambda k: NOT list_contains(json_keys(item), k)), ',') AS missing_fields
 FROM x_o_item WHERE family = '{kind}' AND n IS NOT NULL)"""


def _flat(df: DataFrame) -> DataFrame:
    """Lists as texts, as the twins write them."""
    return df.withColumns({"review": F.array_join("review", ",")} | {f: F.array_join(F.array_sort(f) if f == "unknown_fields" else f, ",") for f in ("unknown_fields", "missing_fields") if f in df.columns})


def _one(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(payload_rows(frame(spark, sf_dir, "x_payload_page"), kind))

    return run


for _kind in SHAPES:
    query(f"s4_{_kind}_rows", _rows_sql(_kind))(_one(_kind))


def _documents_sql() -> str:
    def first(x: str) -> str:
        return f"arg_min({x}, page) FILTER (WHERE {x} IS NOT NULL)"

    head = {target: _sql(k, f"(whole->'header'->>'{source}')") for k, source, target in fields(HEADER)}
    head |= {"scheme_": _sql("text", "(whole->>'scheme')"), "challan_number": _sql("text", "(whole->>'challan_number')"), "deposited_on": _sql("date", "(whole->>'deposited_on')")}
    head |= {"printed_gross_paise": _sql("money", "(whole->'printed_totals'->>'gross')"), "wc": _sql("int", "(whole->'printed_totals'->>'worker_count')"), "mc": _sql("int", "(whole->'printed_totals'->>'member_count')")}
    removed = ", ".join(f"count(*) FILTER (WHERE reason = '{k}') AS removed_{k}" for k in ("bad_page", "total", "header", "duplicate"))
    return f"""SELECT * EXCLUDE (family, wc, mc, scheme_, bad), CASE WHEN family = 'contribution' THEN coalesce(scheme_, CASE doc_type WHEN 'EPF_ECR' THEN 'EPF' ELSE 'ESIC' END) END AS scheme, coalesce(nullif(wc, 0), mc) AS printed_count,
 concat_ws(',', CASE WHEN accepted = 0 AND family <> 'registration' THEN 'nothing_extracted' END, CASE WHEN bad > 0 THEN 'illegible' END,
  CASE WHEN printed_gross_paise <> 0 AND summed_gross_paise <> 0 AND abs(summed_gross_paise - printed_gross_paise) > greatest(100, printed_gross_paise // 100) THEN 'gross_total' END,
  CASE WHEN family IN ('wage', 'employee', 'contribution') AND accepted > 0 AND coalesce(nullif(wc, 0), mc) > 0 AND accepted <> coalesce(nullif(wc, 0), mc) THEN 'row_count' END) AS review
 FROM (SELECT document_id, arg_min(doc_type, page) AS doc_type, arg_min(family, page) AS family, {", ".join(f"{first(t)} AS {t}" for t in head)}, count(n) AS seen, count(n) FILTER (WHERE reason IS NULL) AS accepted, {removed},
  sum(gross) FILTER (WHERE family = 'wage' AND n IS NOT NULL AND reason IS NULL)::BIGINT AS summed_gross_paise, max(bad) AS bad
  FROM (SELECT document_id, page, doc_type, family, n, reason, {_sql("money", "(item->>'gross')")} AS gross, coalesce(json_array_length(whole, '$.unreadable_regions'), 0) AS bad, {", ".join(f"{x} AS {t}" for t, x in head.items())} FROM x_o_item) GROUP BY 1)"""


@query("s4_documents", _documents_sql())
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(payload_documents(frame(spark, sf_dir, "x_payload_page")))
