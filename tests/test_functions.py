import datetime

from pyspark.sql import functions as F

from inspectra.functions import normalise as n
from inspectra.functions import predicates as p
from inspectra.operators.cleaning import national_ids, verhoeff_ok
from inspectra.operators.documents import chain_breaks, shortlist
from inspectra.operators.facts import of_batch
from inspectra.operators.findings import upsert
from inspectra.operators.intake import word_lines
from inspectra.sources.views import frame


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def lit(x, kind):
    return F.lit(x).cast(kind)


def test_two_valued_logic(spark):
    t, f, u = F.lit(True), F.lit(False), lit(None, "boolean")
    assert one(spark, p.both(t, u), p.either(f, u), p.either(t, u), p.negate(u), p.both(t, t)) == [False, False, True, True, True]


def test_missing(spark):
    assert one(spark, p.is_missing(F.lit(0)), p.is_missing(lit(None, "int")), p.is_missing(F.lit("  "), "text"), p.is_missing(F.array(), "array")) == [False, True, True, True]


def test_numbers(spark):
    assert one(spark, p.ratio(F.lit(1), F.lit(0)), p.ratio(F.lit(1), F.lit(4)), p.within_tolerance(F.lit(5), lit(None, "int")), p.to_int(F.lit(-1.7)), p.round_even(F.lit(2.5)), p.rupees_to_paise(F.lit(12.345))) == [None, 0.25, False, -1, 2.0, 1234]


def test_wage_rows(spark):
    null = lit(None, "long")
    got = one(
        spark, p.statutory_wages(null, null), p.statutory_wages(null, lit(5, "long")), p.total_remuneration(null, null, null, lit(9, "long")),
        p.ordinary_hourly_rate(lit(800, "long"), F.lit(10.0), F.lit(0.0)), p.ordinary_hourly_rate(lit(800, "long"), F.lit(0.0), F.lit(8.0)),
    )
    assert got == [None, 5, 9, 10.0, None]


def test_dates_and_texts(spark):
    d = lambda x: lit(x, "date")
    assert one(spark, p.days_between(d("2024-01-01"), d("2024-01-31")), p.is_expired(d(None), d("2024-01-01")), p.month_end_day(d("2024-02-10")), p.is_after(d(None), d("2024-01-01"))) == [30, False, 29, False]
    assert one(spark, p.text_contains(F.lit("Wage Slip"), F.lit("SLIP")), p.matches_any(F.lit(" Yes "), "yes", "y"), p.normalise_number(F.lit("ab-1 2")), p.has_length(F.lit("12-34"), 4), p.length_of(lit(None, "string"))) == [True, True, "AB12", True, 0]


def test_cells(spark):
    s = lambda x: lit(x, "string")
    assert one(spark, n.clean_text(s(" a  b ")), n.clean_text(s("N/A")), n.parse_number(s("1,234.5")), n.parse_number(s("x")), n.parse_int(s("2.5"))) == ["a b", None, 1234.5, None, 2]
    assert one(spark, *(n.parse_date(s(x)) for x in ("5-4-2026", "2026-4-5", "05.04.2026", "5 april 2026", "Apr 2026", "2026-04", "4/2026", "05/04/26", "5-4-26"))) == [datetime.date(2026, 4, 5)] * 4 + [datetime.date(2026, 4, 1)] * 3 + [None] * 2
    assert one(spark, *(n.parse_paise(s(x)) for x in ("1,250.005", "(1,250.00)", "₹ 12", "-", "abc"))) == [125001, -125000, 1200, None, None]
    marks = ("PPAPPPW", "P P", "P", "PP", "P*P*PP", "P/PP.", "12A345", "")
    assert one(spark, *(n.longest_run(s(x)) for x in marks)) == [3, 1, None, None, 4, 2, 3, None]
    names = ("SARDAR Amar Singh d / o X", "Dr. Late Devi wife  of Y", "Kumari Devi", "S O Rao")
    assert one(spark, *(n.name_key(s(x)) for x in names)) == ["AMAR SINGH", "DR DEVI", "KUMARI DEVI", "S O RAO"]
    row = lambda name, has_id=False: n.row_reason(s(name), F.lit(True), F.lit(has_id), F.lit(False))
    assert one(spark, *map(row, ("c/f", "Sub.Total", "Brought  forward", "Member name", "Totals", "Sl No", "sub-total", None)), row("NAME", True)) == ["total"] * 3 + ["header", None, None, "total", None, None]
    assert one(spark, n.parse_skill(s("semi skilled")), n.name_key(s("Shri. Rajesh Kumar S/O Ram Lal"))) == ["SEMI_SKILLED", "RAJESH KUMAR"]


def test_national_ids(spark):
    assert one(spark, verhoeff_ok(F.lit("2363")), verhoeff_ok(F.lit("2364"))) == [True, False]
    df = spark.createDataFrame([(1, "no 2345 6789 0124 here"), (2, None), (3, "")], "id int, t string")
    assert all(r.masked.startswith("XXXXXXXX") for r in national_ids(df, "id", "t").collect())


def test_national_ids_are_words_of_their_own(spark):
    """The first was found inside a secret; white space of any kind parts a number, and no first digit is left out."""
    texts = ["86a31e945411267126c0174875cf8d131", "é945411267126", "_945411267126_", "1945411267126", "9454\t1126-7126.", "(945411267126)", "9454\n11267126", "945411267127"]
    zero = next(x for x in ("0000 0000 000" + str(d) for d in range(10)) if one(spark, verhoeff_ok(F.lit(x.replace(" ", ""))))[0])
    df = spark.createDataFrame(list(enumerate([*texts, zero])), "id long, t string")
    assert sorted((r.id, r.masked) for r in national_ids(df, "id", "t").collect()) == [(4, "XXXXXXXX7126"), (5, "XXXXXXXX7126"), (6, "XXXXXXXX7126"), (8, "XXXXXXXX" + zero[-4:])]


def test_upsert_is_idempotent(spark):
    now = spark.createDataFrame([("a", "violation", "HIGH", 3), ("b", "pass", "HIGH", None), ("c", "unassessed", "LOW", None), ("d", "violation", "LOW", 1)], "dedupe_key string, state string, severity string, affected long")
    old = spark.createDataFrame([("b", "OPEN", "HIGH", 2), ("c", "OPEN", "LOW", 2), ("d", "DISPUTED", "LOW", 9), ("e", "WAIVED", "LOW", 1)], "dedupe_key string, status string, severity string, affected long")
    first = upsert(now, old)
    want = {("a", "OPEN", 3), ("b", "RESOLVED", 2), ("c", "OPEN", 2), ("d", "DISPUTED", 1), ("e", "WAIVED", 1)}
    assert {(r.dedupe_key, r.status, r.affected) for r in first.collect()} == want
    assert {(r.dedupe_key, r.status, r.affected) for r in upsert(now, first).collect()} == want


def test_chain_and_shortlist(spark):
    entries = spark.createDataFrame([(1, "h1", "0"), (2, "h2", "h1"), (4, "h4", "h3"), (5, "h5", "x")], "sequence long, entry_hash string, prev_hash string")
    assert sorted((r.sequence, r.reason) for r in chain_breaks(entries).collect()) == [(4, "sequence"), (5, "prev_hash")]
    names = spark.createDataFrame([(1, 7, "R. Kumar"), (1, 8, "R K"), (1, 9, "Zed")], "establishment_id long, name_id long, printed_name string")
    people = spark.createDataFrame([(1, 70, "Rajesh Kumar"), (1, 71, "Sita Devi"), (1, 72, "R Kumar"), (2, 73, "Rajesh Kumar")], "establishment_id long, identity_id long, display_name string")
    everybody = sorted((r.name_id, r.place, r.identity_id) for r in shortlist(names, people).collect())
    assert everybody == [(7, 1, 70), (7, 2, 72), (7, 3, 71), (8, 1, 70), (8, 2, 72), (8, 3, 71), (9, 1, 70), (9, 2, 71), (9, 3, 72)]
    best = sorted((r.name_id, r.place, r.identity_id, r.score) for r in shortlist(names, people, few=2).collect())
    assert best == [(7, 1, 70, 100.0), (7, 2, 72, 100.0), (8, 1, 70, 100.0), (8, 2, 72, 100.0)]
    assert len(shortlist(names, people, top=1, few=2).collect()) == 2


def test_row_functions(spark):
    """The scalar functions that no check uses."""
    d = lambda x: lit(x, "date")
    assert one(spark, p.default(lit(None, "int"), F.lit(3)), p.default(F.lit(0), F.lit(3)), p.percent(F.lit(1), F.lit(4)), p.percent(F.lit(1), F.lit(0))) == [3, 0, 25.0, None]
    assert one(spark, p.paise_to_rupees(F.lit(1250)), p.rupees_to_paise(F.lit(0.125)), p.add_days(d("2024-02-28"), 2), p.is_all_digits(F.lit("0123")), p.is_all_digits(F.lit("1a"))) == [12.5, 12, datetime.date(2024, 3, 1), True, False]
    assert one(spark, p.unique(F.array(*map(F.lit, (3, 1, 3, 2, 1)))), p.smallest(lit(None, "int"), F.lit(2)), p.largest(lit(None, "int"), F.lit(2))) == [[3, 1, 2], 2, 2]


def test_row_aggregates(spark):
    df = spark.createDataFrame([(1,), (5,), (5,), (0,), (None,)], "v int")
    empty = df.where("false")
    made = [p.total("v"), p.count_rows(), F.avg("v"), p.count_missing("v"), p.count_below("v", F.lit(5)), p.count_above("v", F.lit(0)), p.count_equal("v", F.lit(5)), p.count_nonzero("v"), p.all_below("v", F.lit(6)), p.all_below("v", F.lit(5)), p.all_at_least("v", F.lit(0)), p.all_at_least("v", F.lit(1)), p.unique_count("v")]
    assert list(df.agg(*made).first()) == [11, 5, 2.75, 1, 2, 3, 2, 3, True, False, True, False, 3]
    assert list(empty.agg(p.total("v"), F.avg("v"), p.all_below("v", F.lit(1)), p.all_at_least("v", F.lit(1))).first()) == [0, None, True, True]


def test_word_lines(spark):
    """A word joins the first line whose first word is near, in reading order: drifting words do not pull a line along."""
    tops = [0.100, 0.103, 0.106, 0.1005, 0.2, 0.1985, 0.1045]
    rows = [(1, i, 0.1 * i, t, 0.01) for i, t in enumerate(tops)] + [(2, 0, 0.5, 0.5, 0.01)]
    got = {(r.document_id, r.token): r.line for r in word_lines(spark.createDataFrame(rows, "document_id long, token long, box_left double, box_top double, height double")).collect()}
    order = sorted(range(len(tops)), key=lambda i: (tops[i], 0.1 * i))
    anchors, want = [], {}
    for i in order:
        centre = tops[i] + 0.005
        at = next((k for k, a in enumerate(anchors) if abs(centre - a) <= 0.004), None)
        if at is None:
            anchors.append(centre)
            at = len(anchors) - 1
        want[1, i] = at
    assert got == want | {(2, 0): 0}


def test_the_callers_views_stay(spark):
    spark.range(3).createOrReplaceTempView("orders")
    assert frame(spark, "/root/testdata/sf0.001", "x_document").count() > 3
    assert spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")


def test_batch_scope(spark):
    docs = spark.createDataFrame([(1, "A", 9), (2, "B", 9), (3, "C", 9)], "document_id long, doc_type string, batch_id long")
    members = spark.createDataFrame([(50, 1), (50, 1), (51, 1), (51, 3)], "batch_id long, document_id long")
    assert sorted((r.batch_id, r.doc_type) for r in of_batch(docs, members).collect()) == [(50, "A"), (51, "A"), (51, "C")]
