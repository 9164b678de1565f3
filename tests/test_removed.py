import random

from inspectra.operators import cleaning


def test_removed_rows_are_counted_without_looking_at_them(spark):
    """Ids that repeat or are null, pages that are unknown or null; the rows meet no table of themselves."""
    rng = random.Random(4)
    some = [(rng.choice([None, *range(60)]), rng.randrange(3), rng.choice([None, 1, 2, 3]), rng.choice(["5", None]), rng.choice(["Grand Total", "Name", "Ram", None]), rng.choice(["u", None])) for _ in range(900)]
    rows = spark.createDataFrame(some, "row_id long, document_id long, page long, amount string, worker_name string, uan string")
    values = ["amount", "worker_name", "uan"]
    for pages in (rows, rows.where("page < 3")):
        found = cleaning.removed_counts(rows, pages, values)
        want = cleaning.removal_counts(cleaning.accepted_rows(rows.where("page is not null"), pages, values))
        known = cleaning.removed_counts(rows.where("page is not null"), pages, values)
        assert sorted(map(str, known.collect())) == sorted(map(str, want.select(*known.columns).collect()))
        assert sum(r.seen for r in found.collect()) == len(some)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
