"""Payload shapes against rows that were typed by hand."""

import datetime
import json

from inspectra.operators import payloads as y

DAY = datetime.date


def _table(spark, *rows):
    return spark.createDataFrame([(d, p, pages, t, x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)) for d, p, pages, t, x in rows], "document_id long, page int, pages array<int>, doc_type string, payload string")


def _one(spark, doc_type, payload, kind):
    (row,) = y.payload_rows(_table(spark, (1, 3, [3], doc_type, payload)), kind).collect()
    return row.asDict()


def test_wage_row(spark):
    raw = {
        "page": 3, "row_number": 7, "worker_name": " Sita  Devi", "father_or_husband_name": "n/a", "employee_code": "E1", "uan": "100000000001", "designation": "Fitter", "skill_category": "Semi-Skilled", "gender": "F",
        "days_paid": 26, "days_present": 25.5, "normal_hours_per_day": 8, "overtime_hours": None, "basic": "10,000.50", "dearness_allowance": "₹ 500", "other_allowances": 250.25, "gross": "10750.75", "overtime_amount": "-", "overtime_rate": None,
        "pf_deduction": "(12.5)", "esi_deduction": "0", "advance_recovery": "", "total_deductions": "80.005", "net_paid": 10670.74, "paid_on": "07/04/2026", "date_of_joining": "April 2020", "date_of_exit": "soon",
    }
    row = _one(spark, "OVERTIME_REGISTER", {"rows": [raw]}, "wage")
    want = {
        "row_number": 7, "worker_name": "Sita Devi", "father_name": None, "employee_code": "E1", "uan": "100000000001", "designation": "Fitter", "skill_category": "SEMI_SKILLED", "gender": "F", "days_paid": 26.0, "days_present": 25.5,
        "normal_hours_per_day": 8.0, "overtime_hours": None, "basic_paise": 1000050, "da_paise": 50000, "other_allowances_paise": 25025, "gross_paise": 1075075, "overtime_paise": None, "overtime_rate_paise": None, "pf_paise": -1250, "esi_paise": 0,
        "advance_paise": None, "deductions_paise": 8001, "net_paid_paise": 1067074, "paid_on": DAY(2026, 4, 7), "date_of_joining": DAY(2020, 4, 1), "date_of_exit": None,
        "document_id": 1, "doc_type": "OVERTIME_REGISTER", "page": 3, "n": 0, "reason": None, "unknown_fields": [], "missing_fields": [], "review": [],
    }
    assert row == want


def test_other_shapes(spark):
    row = _one(spark, "EMPLOYEE_REGISTER", {"rows": [{"page": 3, "worker_name": "A", "esic_number": "12", "date_of_birth": "1990-01-02", "is_contract_worker": True, "contractor_name": "C", "shoe": 9}]}, "employee")
    assert (row["esic_number"], row["date_of_birth"], row["is_contract_worker"], row["contractor_name"], row["unknown_fields"], row["review"]) == ("12", DAY(1990, 1, 2), True, "C", ["shoe"], ["esic"])
    assert row["missing_fields"] == ["father_or_husband_name", "employee_code", "uan", "designation", "gender", "row_number", "skill_category", "date_of_joining", "date_of_exit"]
    row = _one(spark, "LEAVE_REGISTER", {"rows": [{"page": 3, "worker_name": "A", "days_present": 30, "days_absent": "2", "weekly_offs_given": 4, "daily_marks": "PPPPAPW", "longest_consecutive_days": 9}]}, "attendance")
    assert (row["longest_consecutive_days"], row["run_recomputed"], row["weekly_offs_given"], row["review"]) == (4, True, 4, ["days"])
    row = _one(spark, "ESIC_CHALLAN", {"rows": [{"page": 3, "worker_name": "A", "uan": "5", "wage_base": "100", "employee_share": "100.01", "employer_share": 3.25, "ncp_days": -1}]}, "contribution")
    assert (row["scheme"], row["wage_base_paise"], row["employee_share_paise"], row["employer_share_paise"], row["review"]) == ("ESIC", 10000, 10001, 325, ["share", "ncp", "uan"])
    row = _one(spark, "ACCIDENT_REGISTER", {"rows": [{"page": 3, "occurred_on": "2026-01-05", "notified_on": "2026-01-04", "workers_affected": "2", "severity": "none"}]}, "incident")
    assert (row["occurred_on"], row["workers_affected"], row["severity"], row["review"]) == (DAY(2026, 1, 5), 2, None, ["notified_before"])
    row = _one(spark, "BOCW_CESS_RECEIPT", {"header": {}, "number": "--", "valid_from": "2026-01-05", "valid_to": "2025-01-05"}, "registration")
    assert (row["kind"], row["number"], row["page"], row["unknown_fields"], row["review"]) == ("ESTABLISHMENT_REGISTRATION", None, 3, [], ["no_number", "ends_before"])
    row = _one(spark, "STANDING_ORDERS", {"assertions": [{"key": "hours", "present": True, "value": "8", "quote": " ", "page": 4, "confidence": 0.5}]}, "prose")
    assert (row["key"], row["present"], row["value_text"], row["quote"], row["page"], row["confidence"], row["review"]) == ("hours", True, "8", None, 3, 0.5, ["no_quote"])


def test_removed_rows_and_documents(spark):
    a = {"page": 1, "worker_name": "A", "uan": None, "gross": "100.00"}
    rows = [a, {**a, "page": 2}, dict(reversed(a.items())), {**a, "page": 9}, {**a, "page": "1"}, {**a, "page": 1.5}, {**a, "worker_name": "sub.total"}, {**a, "worker_name": "Name"}, {**a, "worker_name": "Name", "uan": "7"}, None, 5, [a]]
    table = _table(
        spark,
        (1, 1, [1, 2], "WAGE_SLIP", {"header": {"establishment_name": None, "state": "MH"}, "rows": rows, "printed_totals": {"gross": "500", "worker_count": 0, "member_count": "3"}, "unreadable_regions": [{}]}),
        (1, 3, [3], "WAGE_SLIP", {"header": {"establishment_name": "Works", "state": "GJ"}, "rows": [{**a, "page": 3}], "printed_totals": {"gross": "900", "worker_count": 8}}),
        (2, 1, [1], "MUSTER_ROLL", "no json"), (3, 1, [1], None, None), (4, 1, [1], "CONTRACTOR_LICENCE", {}), (5, 1, [1], "EPF_ECR", {"rows": [5]}), (6, 1, None, "EPF_ECR", {"rows": [a]}),
    )
    found = {r["n"]: r["reason"] for r in y.payload_rows(table.where("page = 1 and document_id = 1"), "wage").collect()}
    assert found == {0: None, 1: None, 2: "duplicate", 3: "bad_page", 4: "bad_page", 5: "bad_page", 6: "total", 7: "header", 8: None}
    docs = {r["document_id"]: r.asDict() for r in y.payload_documents(table).collect()}
    one = docs[1]
    assert (one["establishment_name"], one["state"], one["seen"], one["accepted"], one["printed_gross_paise"], one["summed_gross_paise"], one["printed_count"]) == ("Works", "MH", 10, 4, 50000, 40000, 3)
    assert [one[f"removed_{k}"] for k in ("bad_page", "total", "header", "duplicate")] == [3, 1, 1, 1]
    assert one["review"] == ["illegible", "gross_total", "row_count"]
    assert {d: r["review"] for d, r in docs.items() if d > 1} == {2: ["nothing_extracted"], 3: ["nothing_extracted"], 4: [], 5: ["nothing_extracted"], 6: ["nothing_extracted"]}
    assert docs[5]["scheme"] == "EPF" and docs[3]["scheme"] is None


def test_empty_table_and_long_payload(spark):
    table = _table(spark, (1, 1, [1], "WAGE_SLIP", {"rows": [{"page": 1, "worker_name": f"W{i % 3000}"} for i in range(6000)]}))
    (one,) = y.payload_documents(table).collect()
    assert (one["seen"], one["accepted"], one["removed_duplicate"]) == (6000, 3000, 3000)
    assert y.payload_documents(table.limit(0)).count() == 0 and y.payload_rows(table.limit(0), "prose").count() == 0


def test_one_shuffle(spark):
    plan = y.payload_documents(_table(spark, (1, 1, [1], "WAGE_SLIP", {"rows": []})))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
