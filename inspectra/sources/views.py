"""Domain tables as views over the test tables: the same SQL text in Spark and in DuckDB.

`frame(spark, sf_dir, name)` gives a view as a DataFrame; `with_views(sql)` puts the definitions
that a DuckDB statement refers to in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark")

VIEWS: dict[str, str] = {
    "x_wage_base": """
SELECT CAST(l.l_suppkey AS BIGINT) AS establishment_id,
       CAST(o.o_custkey AS BIGINT) AS worker_key,
       CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS row_number,
       l.l_partkey AS pk, l.l_orderkey AS ok, l.l_linenumber AS ln, l.l_discount AS disc, l.l_tax AS tax,
       CAST(date_trunc('month', l.l_shipdate) AS DATE) AS period_start,
       last_day(CAST(l.l_shipdate AS DATE)) AS period_end,
       CAST(year(l.l_shipdate) AS INT) AS period_year,
       CAST(l.l_quantity AS INT) AS qty,
       CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""",
    "x_wage_parts": """
SELECT b.*,
       CASE WHEN pk % 41 = 0 THEN NULL ELSE CAST(((qty - 1) % 31) + 1 AS DOUBLE) END AS days_paid,
       CAST(floor(cents * 0.45) AS BIGINT) AS basic_paise,
       CASE WHEN ln = 7 THEN NULL ELSE CAST(floor(cents * 0.15) AS BIGINT) END AS da_paise,
       CAST(floor(cents * (0.2 + disc * 6)) AS BIGINT) AS other_allowances_paise,
       CASE WHEN ln IN (1, 2) THEN CAST(0 AS DOUBLE) WHEN ln = 3 THEN NULL ELSE CAST(ln * 2 AS DOUBLE) END AS overtime_hours,
       CASE WHEN pk % 17 = 0 THEN NULL ELSE CAST(8 + CASE WHEN pk % 19 = 0 THEN 1 ELSE 0 END AS DOUBLE) END AS normal_hours_per_day
FROM x_wage_base b
""",
    "x_wage_core": """
SELECT establishment_id, worker_key, row_number, pk, period_start, period_end, period_year, days_paid,
       CASE WHEN pk % 7 = 0 THEN NULL ELSE days_paid + (ln % 3) - 1 END AS days_present,
       normal_hours_per_day, overtime_hours, basic_paise, da_paise, other_allowances_paise,
       CASE WHEN pk % 53 = 0 THEN NULL WHEN establishment_id % 37 = 5 AND pk % 2 = 0 THEN CAST(1234567 AS BIGINT)
            WHEN establishment_id % 37 = 6 THEN basic_paise - basic_paise % 50000 + 50000
            ELSE basic_paise + coalesce(da_paise, 0) + other_allowances_paise
                 + CASE WHEN pk % 29 = 0 THEN 5000 ELSE 0 END END AS gross_paise,
       CASE WHEN overtime_hours > 0 THEN CAST(20000 + (ok % 50) * 1000 AS BIGINT) END AS overtime_rate_paise,
       CASE WHEN overtime_hours > 0 AND pk % 13 <> 0
            THEN CAST(overtime_hours * (20000 + (ok % 50) * 1000) AS BIGINT) + CASE WHEN ok % 43 = 0 THEN 700 ELSE 0 END END AS overtime_paise,
       CAST(floor((basic_paise + coalesce(da_paise, 0) + other_allowances_paise) * tax * 8) AS BIGINT) AS deductions_paise,
       CASE WHEN pk % 59 = 0 THEN NULL
            ELSE basic_paise + coalesce(da_paise, 0) + other_allowances_paise
                 + coalesce(CASE WHEN overtime_hours > 0 AND pk % 13 <> 0
                                 THEN CAST(overtime_hours * (20000 + (ok % 50) * 1000) AS BIGINT) END, 0)
                 - CAST(floor((basic_paise + coalesce(da_paise, 0) + other_allowances_paise) * tax * 8) AS BIGINT)
                 + CASE WHEN ok % 37 = 0 THEN 900 ELSE 0 END END AS net_paid_paise,
       CASE WHEN pk % 43 = 0 THEN NULL ELSE CAST(period_end + CAST(ok % 12 AS INT) AS DATE) END AS paid_on,
       CASE WHEN pk % 23 = 0 THEN CAST(period_end - 3 AS DATE) END AS date_of_exit,
       (pk % 61 = 0) AS needs_review
FROM x_wage_parts
""",
    "x_wage_line": """
SELECT w.establishment_id, w.worker_key, w.row_number, w.period_start, w.period_end, w.period_year, w.days_paid, w.days_present, w.normal_hours_per_day, w.overtime_hours, w.basic_paise, w.da_paise, w.other_allowances_paise,
       w.gross_paise, w.overtime_rate_paise, w.overtime_paise, w.deductions_paise, w.net_paid_paise, w.paid_on, w.date_of_exit, w.needs_review,
       CASE WHEN pk % 9 = 0 THEN NULL ELSE CAST(floor(w.deductions_paise * 0.5) AS BIGINT) END AS pf_paise, CAST(floor(w.deductions_paise * 0.25) AS BIGINT) AS esi_paise,
       w.deductions_paise - CAST(floor(w.deductions_paise * 0.5) AS BIGINT) - CAST(floor(w.deductions_paise * 0.25) AS BIGINT) + CASE WHEN pk % 31 = 0 THEN 500 ELSE 0 END AS advance_paise
FROM x_wage_core w
""",
    "x_attendance": """
SELECT establishment_id, worker_key, row_number, period_start, period_end, period_year,
       CASE WHEN establishment_id % 37 = 7 THEN CAST(26 AS DOUBLE) ELSE days_paid + (ln % 2) END AS days_present,
       CASE WHEN pk % 11 = 0 THEN NULL WHEN establishment_id % 37 = 7 THEN CAST(0 AS DOUBLE) ELSE CAST(30 - qty % 31 AS DOUBLE) END AS days_absent,
       overtime_hours,
       CAST(7 + qty % 4 AS DOUBLE) AS max_daily_hours,
       CAST(40 + qty % 13 AS DOUBLE) AS max_weekly_hours,
       CASE WHEN pk % 31 = 0 THEN NULL ELSE CAST(4 + qty % 9 AS INT) END AS longest_consecutive_days
FROM x_wage_parts WHERE ln <> 5
""",
    "x_contribution": """
SELECT 'EPF' AS scheme, establishment_id, worker_key, row_number, period_start, period_end, period_year,
       CASE WHEN pk % 47 = 0 THEN NULL WHEN establishment_id % 37 = 8 AND pk % 4 <> 0 THEN CAST(1500000 AS BIGINT) WHEN worker_key % 10 = 3
            THEN CAST(floor((basic_paise + coalesce(da_paise, 0)) * 0.6) AS BIGINT)
            ELSE basic_paise + coalesce(da_paise, 0) END AS wage_base_paise,
       CASE WHEN pk % 71 = 0 THEN NULL ELSE CAST(floor((basic_paise + coalesce(da_paise, 0)) * 0.12) AS BIGINT) END AS employee_share_paise,
       CASE WHEN pk % 67 = 0 THEN NULL
            ELSE CAST(floor((basic_paise + coalesce(da_paise, 0)) * 0.0367) AS BIGINT) END AS employer_share_paise
FROM x_wage_parts WHERE worker_key % 10 NOT IN (1, 2)
UNION ALL
SELECT 'ESIC', establishment_id, worker_key, row_number, period_start, period_end, period_year,
       CASE WHEN pk % 73 = 0 THEN NULL ELSE basic_paise END, CASE WHEN pk % 79 = 0 THEN NULL ELSE CAST(floor(basic_paise * 0.0075) AS BIGINT) END, CASE WHEN pk % 83 = 0 THEN NULL ELSE CAST(floor(basic_paise * 0.0325) AS BIGINT) END
FROM x_wage_parts WHERE cents <= 2100000 AND worker_key % 5 <> 4
""",
    "x_establishment": """
SELECT CAST(s_suppkey AS BIGINT) AS establishment_id, CAST(s_suppkey % 7 AS BIGINT) AS organisation_id, s_name AS name,
       CASE s_nationkey % 5 WHEN 0 THEN 'MH' WHEN 1 THEN 'GJ' WHEN 2 THEN 'KA' WHEN 3 THEN 'DL' ELSE 'RJ' END AS state_code,
       CAST(s_suppkey % 3 AS BIGINT) AS nic_code,
       CAST((s_suppkey * 13) % 400 AS INT) AS worker_count, CAST((s_suppkey * 17) % 450 AS INT) AS worker_count_peak_12m,
       CAST((s_suppkey * 5) % 60 AS INT) AS women_worker_count, CAST((s_suppkey * 7) % 90 AS INT) AS contract_worker_count,
       (s_suppkey % 2 = 0) AS engages_contract_labour, (s_suppkey % 3 = 0) AS is_factory, (s_suppkey % 11 <> 0) AS is_active
FROM supplier
""",
    "x_document": """
SELECT CAST(o_orderkey AS BIGINT) AS document_id, CAST(o_custkey % 20 AS BIGINT) AS establishment_id,
       CASE CAST(substr(o_orderpriority, 1, 1) AS INT) * 4 + CAST((o_custkey - o_custkey % 20) / 20 AS INT) % 4
            WHEN 4 THEN 'EMPLOYEE_REGISTER' WHEN 5 THEN 'WAGE_REGISTER' WHEN 6 THEN 'MUSTER_ROLL' WHEN 7 THEN 'WAGE_SLIP' WHEN 8 THEN 'OVERTIME_REGISTER' WHEN 9 THEN 'DEDUCTION_REGISTER' WHEN 10 THEN 'EPF_ECR'
            WHEN 11 THEN 'ESIC_CHALLAN' WHEN 12 THEN 'APPOINTMENT_LETTER' WHEN 13 THEN 'ESTABLISHMENT_REGISTRATION' WHEN 14 THEN 'CONTRACTOR_LICENCE' WHEN 15 THEN 'BOCW_CESS_RECEIPT' WHEN 16 THEN 'ACCIDENT_REGISTER'
            WHEN 17 THEN 'HEALTH_CHECKUP_RECORD' WHEN 18 THEN 'WELFARE_FACILITY_RECORD' WHEN 19 THEN 'STANDING_ORDERS' WHEN 20 THEN 'GRIEVANCE_COMMITTEE_RECORD' WHEN 21 THEN 'LEAVE_REGISTER' WHEN 22 THEN 'ANNUAL_RETURN' ELSE 'UNKNOWN' END AS doc_type,
       CASE WHEN o_orderkey % 19 = 0 THEN 'FAILED' WHEN o_orderkey % 17 = 0 THEN 'REJECTED' WHEN o_orderstatus = 'F' THEN 'EXTRACTED'
            WHEN o_orderstatus = 'O' THEN 'EVALUATED' ELSE 'NEEDS_REVIEW' END AS status,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start, last_day(CAST(o_orderdate AS DATE)) AS period_end,
       o_orderdate AS created_at, CAST(o_custkey % 97 AS BIGINT) AS batch_id
FROM orders
""",
    "x_incident": """
SELECT CAST(user_id AS BIGINT) AS establishment_id, CAST(event_id AS BIGINT) AS incident_id, CAST(DATE '1995-01-15' + CAST(event_id % 2400 AS INT) AS DATE) AS occurred_on,
       CASE WHEN event_id % 4 <> 0 THEN CAST(DATE '1995-01-15' + CAST(event_id % 2400 + event_id % 9 - 1 AS INT) AS DATE) END AS notified_on,
       CASE WHEN event_id % 3 <> 0 THEN 'REF' || CAST(event_id AS VARCHAR(20)) END AS notification_reference
FROM events WHERE event_type = 'error'
""",
    "x_minimum_wage_rate": """
SELECT state_code, skill_category, CAST(rate * 100 AS BIGINT) AS daily_rate_paise, CAST(eff AS DATE) AS effective_from
FROM (VALUES ('MH','UNSKILLED',563,'1996-03-01'),('MH','SKILLED',690,'1996-03-01'),('MH','UNSKILLED',610,'1999-03-01'),
             ('GJ','UNSKILLED',324,'1995-01-01'),('GJ','SEMI_SKILLED',357,'1995-01-01'),('KA','UNSKILLED',480,'1997-07-01'),
             ('DL','UNSKILLED',783,'1995-01-01'),('DL','SKILLED',949,'1998-01-01')) AS t(state_code, skill_category, rate, eff)
""",
    "x_contractor": """
SELECT CAST(s_suppkey % 40 AS BIGINT) AS establishment_id, s_name AS name,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'LIC' || CAST(s_suppkey AS VARCHAR(20)) END AS licence_number,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(DATE '1995-01-01' + CAST((s_suppkey * 37) % 2200 AS INT) AS DATE) END AS licence_valid_to,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(10 + s_suppkey % 30 AS INT) END AS licensed_worker_count,
       CAST(5 + (s_suppkey * 3) % 50 AS INT) AS deployed_worker_count
FROM supplier
""",
    "x_prose_assertion": """
SELECT CAST(event_id AS BIGINT) AS assertion_id, CAST(user_id AS BIGINT) AS establishment_id, ts AS created_at,
       CASE event_id % 18 WHEN 0 THEN 'states_employee_name' WHEN 1 THEN 'states_designation' WHEN 2 THEN 'states_date_of_joining' WHEN 3 THEN 'states_wage_rate'
            WHEN 4 THEN 'states_working_hours' WHEN 5 THEN 'is_signed_by_employer' WHEN 6 THEN 'grievance_committee_members' WHEN 7 THEN 'grievance_committee_women'
            WHEN 8 THEN 'grievance_committee_employer_reps' WHEN 9 THEN 'grievance_committee_worker_reps' WHEN 10 THEN 'has_chairperson' WHEN 11 THEN 'strike_notice_days'
            WHEN 12 THEN 'is_certified' WHEN 13 THEN 'adopts_model_standing_orders' WHEN 14 THEN 'covers_classification_of_workers'
            WHEN 15 THEN 'covers_disciplinary_procedure' WHEN 16 THEN 'covers_termination' ELSE 'total_workers' END AS key,
       (event_id % 10 <> 0) AS present,
       CASE WHEN event_id % 18 IN (8, 9) THEN CAST(user_id % 4 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) WHEN event_id % 18 IN (6, 7) THEN CAST(CAST(floor(value) AS INT) % 14 AS VARCHAR(20)) WHEN event_id % 18 = 17 THEN CAST(user_id % 500 AS VARCHAR(20)) WHEN event_id % 18 = 11 THEN CAST(CAST(floor(value) AS INT) % 70 AS VARCHAR(20))
            ELSE CASE CAST(floor(value) AS INT) % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' Y ' WHEN 3 THEN 'unclear' WHEN 4 THEN 'TRUE' ELSE 'False' END END AS value_text
FROM events
""",
    "x_registration": """
SELECT CAST(c_custkey % 100 AS BIGINT) AS establishment_id,
       CASE c_nationkey % 4 WHEN 0 THEN 'EPF' WHEN 1 THEN 'ESIC' WHEN 2 THEN 'FACTORY' ELSE 'SHOPS' END AS kind,
       c_name AS number, CAST(DATE '1992-01-01' + CAST(c_custkey % 1500 AS INT) AS DATE) AS valid_from,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(DATE '1994-01-01' + CAST((c_custkey * 31) % 2500 AS INT) AS DATE) END AS valid_to,
       CAST(c_custkey AS BIGINT) AS filed
FROM customer
""",
    "x_identity": """
SELECT CAST(p_partkey % 20 AS BIGINT) AS establishment_id, CAST(p_partkey AS BIGINT) AS identity_id, p_name AS display_name,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS father_name,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE lpad(CAST(p_partkey % 900 AS VARCHAR(20)), 12, '0') END AS uan,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(DATE '1990-01-01' + CAST(p_partkey % 1000 AS INT) AS DATE) END AS date_of_joining,
       (p_partkey % 13 = 0) AS is_contract_worker
FROM part
""",
    "x_finding": """
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS finding_id, CAST(l_suppkey AS BIGINT) AS establishment_id,
       CAST(l_suppkey % 7 AS BIGINT) AS organisation_id,
       CASE l_linenumber % 5 WHEN 0 THEN NULL WHEN 1 THEN 'WAGES' WHEN 2 THEN 'SOCIAL_SECURITY' WHEN 3 THEN 'OSH' ELSE 'INDUSTRIAL_RELATIONS' END AS code,
       CASE l_partkey % 11 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'MEDIUM' WHEN 5 THEN 'MEDIUM' WHEN 6 THEN 'INFO' ELSE 'LOW' END AS severity,
       CASE l_partkey % 9 WHEN 0 THEN 'ANOMALY' WHEN 1 THEN 'DISCREPANCY' WHEN 2 THEN 'DISCREPANCY' ELSE 'NON_COMPLIANCE' END AS kind,
       CASE l_orderkey % 8 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'ACKNOWLEDGED' WHEN 2 THEN 'DISPUTED' WHEN 3 THEN 'WAIVED' ELSE 'OPEN' END AS status,
       CASE WHEN l_partkey % 17 = 0 THEN 'MODEL.OBSERVATION' ELSE 'RULE.' || CAST(l_partkey % 44 AS VARCHAR(20)) END AS rule_id,
       CASE WHEN l_partkey % 13 = 0 THEN 'RULES_PENDING' ELSE 'STATUTE' END AS rule_basis,
       CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS affected_worker_count,
       CASE WHEN l_partkey % 3 = 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS exposure_paise,
       CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE CAST(l_discount * 10 AS DOUBLE) END AS extraction_confidence,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start, CAST(l_shipdate AS DATE) AS created_on,
       CASE WHEN l_partkey % 4 = 0 THEN CAST(CAST(l_shipdate AS DATE) + CAST(l_partkey % 60 AS INT) AS DATE) END AS due_on
FROM lineitem
""",
}

#: Parts of the SQL twins, for DuckDB only.
ORACLE_VIEWS: dict[str, str] = {}


def _closure(sql: str) -> list[str]:
    """The views that a statement refers to, each after those it refers to itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bx_\w+", text):
            if name in (VIEWS | ORACLE_VIEWS) and name not in out:
                visit((VIEWS | ORACLE_VIEWS)[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def with_views(sql: str) -> str:
    """The statement as one query, with its views as common table expressions."""
    names = _closure(sql)
    if not names:
        return sql
    heads = ",\n".join(f"{n} AS ({(VIEWS | ORACLE_VIEWS)[n].strip()})" for n in names)
    body = sql.strip()
    return f"WITH {heads},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads}\n{body}"


def frame(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A test table or view. Tables are passed to the statement itself, so no temporary view of the caller is touched. given: views that were worked out before."""
    if given and name in given:
        return given[name]
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = [t for t in BASE if re.search(rf"\b{t}\b", sql)] + list(dict.fromkeys(re.findall(r"\bx_\w+", sql)))
    for t in used:
        sql = re.sub(rf"((?:FROM|JOIN)\s+){t}\b(?:\s+(?!JOIN|ON|WHERE|UNION|LEFT|GROUP)(\w+))?", lambda m, t=t: f"{m[1]}{{{t}}} AS {m[2] or t}", sql)
    return spark.sql(sql, **{t: frame(spark, sf_dir, t, given) for t in used})
