"""Plans whose work must grow no faster than their input, and the results of the steps that see to it."""

import datetime
import random
import re

from pyspark.sql import functions as F

from inspectra.functions import normalise
from inspectra.operators import documents, facts, intake, pages, payloads, surface

DAY = datetime.date


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_inspectors_meet_a_row_a_jurisdiction(spark):
    """One hot state: each of its inspectors met each of its establishments."""
    findings = spark.createDataFrame([(i % 50, "OPEN" if i % 7 else "RESOLVED") for i in range(400)], "establishment_id long, status string")
    places = spark.createDataFrame([(i, i % 10 != 0, "MH" if i < 40 else "KA") for i in range(50)], "establishment_id long, is_active boolean, state_code string")
    users = spark.createDataFrame([(u, "INSPECTOR", True, "IN/MH,IN/KA" if u == 0 else "IN/MH") for u in range(30)], "user_id long, role string, is_active boolean, jurisdictions string")
    found = surface.inspector_queue(findings, places, users)
    assert "Aggregate [jurisdiction" in plan(found)
    n = lambda top: sum(1 for i in range(400) if i % 7 and i % 50 % 10 and i % 50 < top)
    assert {tuple(r) for r in found.collect()} == {(u, n(50), 45) if u == 0 else (u, n(40), 36) for u in range(30)}


def test_people_meet_periods_by_days_of_service(spark):
    """A person in several rows counts once, with breaks, overlaps, open ends and days in the wrong order."""
    rng = random.Random(5)
    day = lambda: None if rng.random() < 0.2 else DAY(2020, 1, 1) + datetime.timedelta(days=rng.randrange(300))
    people = [(rng.randrange(3), rng.choice([None, *range(12)]), day(), day(), rng.random() < 0.3) for _ in range(120)]
    periods = [(e, DAY(2020, m, 1), DAY(2020, m + 1, 1) - datetime.timedelta(days=1)) for e in range(3) for m in range(1, 11)]
    docs = spark.createDataFrame([(*k, "EMPLOYEE_REGISTER", "EXTRACTED") for k in periods], "establishment_id long, period_start date, period_end date, doc_type string, status string")
    rows = spark.createDataFrame(people, "establishment_id long, identity_id long, date_of_joining date, date_of_exit date, is_contract_worker boolean")
    counts = facts.register_counts(rows, docs)
    assert "distinct" not in plan(counts)
    there = lambda r, k: r[0] == k[0] and (r[2] is None or r[2] <= k[2]) and (r[3] is None or r[3] >= k[1])
    met = {k: [r for r in people if there(r, k)] for k in periods}
    want = {(*k, len({r[1] for r in v} - {None}), sum(r[4] for r in v)) for k, v in met.items() if v}
    assert {tuple(r)[:5] for r in counts.collect()} == want


def test_months_need_no_shuffle_to_meet_their_rows(spark):
    month = lambda m: (DAY(2020, m, 1), DAY(2020, m + 1, 1) - datetime.timedelta(days=1))
    kinds = "establishment_id long, period_start date, period_end date"
    periods = spark.createDataFrame([(e, *month(m)) for e in range(4) for m in range(1, 9) if (e + m) % 3], kinds)
    rows = spark.createDataFrame([(e, *month(m), m) for e in range(4) for m in range(1, 10)] + [(1, DAY(2020, 2, 20), DAY(2020, 5, 2), 99), (2, DAY(2020, 3, 9), DAY(2020, 3, 1), 98)], kinds + ", x long")
    common = facts.common_periods(periods)
    found = facts.in_common_periods(rows, common)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    held = found.join(periods, facts.K, "left_semi").select(*found.columns)
    assert sorted(held.collect()) == sorted(facts.in_periods(rows, periods).select(*found.columns).collect())
    assert facts.common_periods(periods.union(spark.createDataFrame([(1, DAY(2020, 2, 20), DAY(2020, 5, 2))], kinds))) is None


def test_words_are_shuffled_once_by_page(spark):
    """Lines, claims and verdicts lie by page: one exchange of words, one of claims. Repeated claims keep their rows; a page of signs was read."""
    kinds = "document_id long, page int, token long, text string, box_left double, box_top double, width double, height double"
    words = spark.createDataFrame([(1, 1, 1, "Ram", 0.1, 0.1, 0.1, 0.01), (1, 1, 2, "Lal", 0.3, 0.1, 0.1, 0.01), (1, 2, 1, "--", 0.1, 0.1, 0.1, 0.01)], kinds)
    claims = spark.createDataFrame([(1, 1, 1, "ramlal"), (1, 1, 1, "ramlal"), (1, 2, 2, "ram"), (1, 3, 3, "ram"), (1, 3, 4, None)], "document_id long, page int, claim_id long, value string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pages.trace_texts(claims, pages.page_lines(words))
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        got = sorted((r.claim_id, r.verdict, r.how, r.text) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(1, "AGREED", "line", "Ram Lal")] * 2 + [(2, "UNSUPPORTED", None, None), (3, "MODEL_ONLY", None, None), (4, "AGREED", None, None)]


def test_numbers_are_looked_up_on_their_page(spark):
    """Runs of words are neither stored nor shuffled: one exchange of words, one of claims. A word that is no number ends nothing; lines order before places."""
    kinds = "document_id long, page int, token long, text string, box_left double, box_top double, width double, height double"
    texts = [(1, "1.2.3", 0.1), (2, "4,", 0.3), (3, "-", 0.5), (4, "500", 0.7), (5, "x", 0.9)]
    words = [(1, 1, t, x, left, 0.1, 0.1, 0.01) for t, x, left in texts] + [(1, 1, 6, "7", 0.1, 0.5, 0.1, 0.01), (1, 1, 7, "00.5", 0.3, 0.5, 0.1, 0.01), (1, 2, 1, None, 0.1, 0.1, 0.1, 0.01)]
    values = ["500", "4-500", "4500", "123", "123 4500", "700.50", "7005", "7", "-", None, "-500", "9"]
    claims = spark.createDataFrame([(1, 1, i, v) for i, v in enumerate(values)] + [(1, 2, 20, "7"), (1, 3, 21, "7"), (1, 1, 0, "500")], "document_id long, page int, claim_id long, value string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = pages.page_lines(spark.createDataFrame(words, kinds))
        found = pages.trace_numbers(claims, lines)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        got = sorted(((r.claim_id, r.verdict, r.how, r.text) for r in found.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [(0, "AGREED", "word", "500")] * 2 + [(1, "UNSUPPORTED", None, None), (2, "AGREED", "digits", "4,-500"), (3, "UNSUPPORTED", None, None), (4, "AGREED", "digits", "1.2.34,-500"), (5, "AGREED", "joined", "700.5"), (6, "AGREED", "digits", "700.5"), (7, "AGREED", "word", "7"), (8, "UNSUPPORTED", None, None), (9, "AGREED", None, None), (10, "AGREED", "joined", "-500"), (11, "UNSUPPORTED", None, None)]
    assert got == sorted([*want, (20, "UNSUPPORTED", None, None), (21, "MODEL_ONLY", None, None)], key=str)


def test_quotes_need_no_boxes(spark):
    """V14 asks whether a line holds a quotation: no box is made for it, and lines are not gathered again."""
    kinds = "document_id long, page int, token long, text string, box_left double, box_top double, width double, height double"
    words = spark.createDataFrame([(1, 1, 1, "Ram", 0.1, 0.1, 0.1, 0.01), (1, 1, 2, "Lal", 0.3, 0.1, 0.1, 0.01)], kinds)
    answers = spark.createDataFrame([(1, 1, 1, True, "ram lal"), (1, 1, 2, True, "sita"), (1, 1, 3, True, " "), (1, 2, 4, True, "ram"), (1, 1, 5, False, "sita")], "document_id long, page int, claim_id long, present boolean, quote string")
    found = pages.quotes_on_pages(answers, pages.lined_pages(words))
    assert "bround" not in plan(found) and plan(found).count("posexplode") == 0
    assert {(r.claim_id, r.reason) for r in found.collect()} == {(2, "quote_not_found"), (3, "no_quote")}


def test_equal_names_are_paired_once(spark):
    """Three thousand people of one name: nine million pairs before."""
    people = spark.createDataFrame([(1, i, "Ram Lal" if i % 2 else "Sita Devi") for i in range(3000)], "establishment_id long, identity_id long, display_name string")
    names = spark.createDataFrame([(1, i, "Ram L" if i % 3 else "R") for i in range(3000)], "establishment_id long, name_id long, printed_name string")
    found = documents.shortlist(names, people)
    rows = found.collect()
    assert len(rows) == 3000 * 8 and {(r.identity_id, r.place) for r in rows} == {(2 * i + 1, i + 1) for i in range(8)}
    assert {r.score for r in rows if r.name_id % 3} == {100.0} and {r.score for r in rows if r.name_id % 3 == 0} == {66.7}


def test_word_lines_need_no_python(spark):
    words = spark.createDataFrame([(1, 1, 0.1, 0.1, 0.01), (1, 2, 0.3, 0.102, 0.01), (1, 3, 0.1, 0.5, 0.01)], "document_id long, token long, box_left double, box_top double, height double")
    found = intake.word_lines(words)
    assert "Pandas" not in plan(found) and "Arrow" not in plan(found)
    assert {(r.token, r.line) for r in found.collect()} == {(1, 0), (2, 0), (3, 1)}


def test_no_date_format_is_tried_that_cannot_fit(spark):
    """A parser that does not fit throws for each row: only formats of a text's own shape are asked, with the same days as all of them give."""
    texts = ["2020-1-02", "2-1-2020", "02/1/2020", "2.1.2020", "2 January 2020", "2 jan 2020", "March 2020", "Mar 2020", "2020-3", "3/2020", "2-1-20", "31/2/2020", "+12020-1-2", "-2020-1-2", "2 Sept 2020", "20-1-2", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tried = F.coalesce(*(F.try_to_timestamp("t", F.lit(f)).cast("date") for f in normalise.DATE_FORMATS))
    assert df.where(~normalise.parse_date("t").eqNullSafe(tried)).count() == 0
    assert all(sum(bool(re.fullmatch(shape, t)) for shape in normalise.DATE_SHAPES) in (1, 2) for t in texts[:10]) and not any(re.fullmatch(shape, "2-1-20") for shape in normalise.DATE_SHAPES)


def test_a_header_is_read_once_a_payload(spark):
    """Not again for each of its entries."""
    found = payloads.payload_documents(spark.createDataFrame([(1, 1, "WAGE_REGISTER", '{"header":{"state":"MH"},"rows":[{"page":1,"worker_name":"a"},{"page":1,"worker_name":"b"}]}')], "document_id long, page int, doc_type string, payload string"))
    text = plan(found)
    assert text.index("Generate") < text.index("$.header.state")
    assert [(r.state, r.seen) for r in found.collect()] == [("MH", 2)]
