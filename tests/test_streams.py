"""The stream operators, run to the end of what is there."""

import datetime as dt

from pyspark.sql import functions as F

from inspectra.streaming.documents import barrier, coalesced, unique_uploads
from inspectra.streaming.filings import FILING, Assessments, Register, keep_register
from inspectra.streaming.snapshots import Snapshots

REQUEST = "establishment_id long, period_start date, period_end date, state string"
T = dt.datetime(2026, 4, 1, 12)


def stream(spark, folder, rows, kinds):
    """Each list of rows is a file, so a micro-batch of its own."""
    for part in rows:
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(folder)


def test_unique_uploads(spark, tmp_path):
    kinds = "organisation_id long, client_key string, created_at timestamp, upload_id long"
    rows = [[(1, "a", T, 1), (1, "a", T, 2)], [(1, "a", T + dt.timedelta(minutes=5), 3), (2, "a", T, 4), (1, "b", T, 5)]]
    found = unique_uploads(stream(spark, f"{tmp_path}/in", rows, kinds))
    found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.organisation_id, r.client_key) for r in got) == [(1, "a"), (1, "b"), (2, "a")]


def test_coalesced(spark):
    day = dt.date(2026, 4, 1)
    rows = spark.createDataFrame([(1, day, day, "x"), (1, day, day, "y"), (2, day, day, "x"), (1, day, dt.date(2026, 4, 2), "x")], REQUEST)
    assert coalesced(rows).count() == 3


EVENT = "batch_id long, document_id long, status string, dated boolean, sealed boolean, created_at timestamp"


def test_barrier(spark, tmp_path):
    """Releases once, when sealed and done; an older event of a document changes nothing; a later failure of the only usable document keeps the batch back."""
    at = lambda n: T + dt.timedelta(minutes=n)
    seal = lambda b: (b, None, None, False, True, T)
    rows = [
        [(1, 10, "EXTRACTED", True, False, at(5)), (1, 11, "RECEIVED", True, False, at(1)), seal(1), (2, 20, "EXTRACTED", True, False, at(1)), (3, 30, "VERIFIED", True, False, at(1)), seal(3)],
        [(1, 10, "RECEIVED", True, False, at(1)), (1, 11, "FAILED", True, False, at(6)), (2, 20, "FAILED", True, False, at(2)), seal(2), (3, 31, "RECEIVED", True, False, at(9))],
        [(2, 21, "RECEIVED", True, False, at(3)), (1, 12, "EXTRACTED", True, False, at(9)), (4, 40, "EXTRACTED", False, False, at(1)), seal(4)],
        [(2, 21, "EXTRACTED", True, False, at(4)), (4, 40, "EXTRACTED", True, False, at(2))],
    ]
    found = barrier(stream(spark, f"{tmp_path}/in", rows, EVENT))
    found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("batch_id", "documents", "usable").collect())) == [(1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 1, 1)]


FACTS = "document_id long, establishment_id long, period_start date, period_end date, amount long"


def extract(documents):
    return documents.selectExpr("document_id", "establishment_id", "period_start", "period_end", "explode(array(document_id * 10, document_id * 10 + 1)) as amount")


def filing(doc, month, status="EXTRACTED", minutes=0, place=1, kind="WAGE_REGISTER"):
    return (doc, place, kind, dt.date(2026, month, 1), dt.date(2026, month, 28), status, T + dt.timedelta(minutes=minutes))


FILINGS = [
    [filing(1, 4), filing(2, 4, minutes=-5), filing(3, 5), filing(4, 4, place=2, status="FAILED"), filing(9, 4, place=2)],
    [filing(5, 4, minutes=3), filing(3, 6, minutes=1), filing(6, 5, status="REJECTED")],  # 5 replaces 1; 3 moves to June
    [filing(5, 4, status="FAILED", minutes=4), filing(7, 4, minutes=-9)],  # 5 fails, so 1 stands again; 7 is late
]


def live(register, number):
    return sorted((r.document_id, r.period_start.month, r.amount) for r in register.rows.read(number).collect())


def rows_of(*documents):
    return sorted((d, m, d * 10 + k) for d, m in documents for k in (0, 1))


def test_refilings_withdraw_rows_and_replay(spark, tmp_path):
    register = Register(spark, f"{tmp_path}/r", FACTS, extract, 8)
    want = [rows_of((1, 4), (3, 5), (9, 4)), rows_of((5, 4), (3, 6), (9, 4)), rows_of((1, 4), (3, 6), (9, 4))]
    asked = [{(1, 4), (1, 5), (2, 4)}, {(1, 4), (1, 5), (1, 6)}, {(1, 4)}]
    for again in range(2):  # each micro-batch runs twice, as after a lost driver
        for n, part in enumerate(FILINGS):
            for _ in range(2):
                requests = register.take(spark.createDataFrame(part, FILING), n)
                assert {(r.establishment_id, r.period_start.month) for r in requests.collect()} == asked[n]
                assert live(register, n) == want[n]
    keep_register(stream(spark, f"{tmp_path}/in", FILINGS, FILING), f"{tmp_path}/check", streamed := Register(spark, f"{tmp_path}/s", FACTS, extract, 8))
    assert live(streamed, 2) == want[2]


def test_a_small_batch_writes_few_buckets(spark, tmp_path):
    """What a micro-batch writes is in proportion to its buckets."""
    table = Snapshots(spark, f"{tmp_path}/t", "k long, v long", "k", 32)
    table.write(spark.range(1000).selectExpr("id as k", "0L as v"), list(range(32)), 0)
    one = spark.createDataFrame([(5, 1)], "k long, v long")
    touched = table.touched(one)
    table.write(table.read(0, touched).where("k <> 5").union(one), touched, 1)
    assert len(touched) == 1 and len(list((tmp_path / "t/data/number=1").glob("bucket=*"))) == 1
    got = {r.k: r.v for r in table.read(1).collect()}
    assert len(got) == 1000 and got[5] == 1 and sum(got.values()) == 1
    table.write(table.read(1, touched).where("false"), touched, 2)  # a bucket may become empty
    assert table.read(2).count() == table.read(1).count() - table.read(1, touched).count()


def test_assessments_follow_and_cards_are_added(spark, tmp_path):
    def assess(requests, rows):
        both = requests.join(rows.groupBy("establishment_id", "period_start", "period_end").agg(F.max("amount").alias("m")), ["establishment_id", "period_start", "period_end"], "left")
        return both.selectExpr("establishment_id", "period_start", "period_end", "concat(establishment_id, '|', month(period_start)) as dedupe_key", "case when m is null then 'not_assessed' when m >= 50 then 'violation' else 'pass' end as state", "'HIGH' as severity", "1L as affected")

    score = lambda findings: findings.groupBy("establishment_id").agg(F.count_if(F.col("status") == "OPEN").alias("open"))
    register, done = Register(spark, f"{tmp_path}/r", FACTS, extract, 4), Assessments(spark, f"{tmp_path}/a", assess, score, 4)
    for n, part in enumerate(FILINGS):
        for _ in range(2):
            done.take(register.take(spark.createDataFrame(part, FILING), n), register.rows, n)
    status = lambda n: {r.dedupe_key: r.status for r in done.findings.read(n).collect()}
    assert [status(n) for n in range(3)] == [{"2|4": "OPEN"}, {"2|4": "OPEN", "1|4": "OPEN"}, {"2|4": "OPEN", "1|4": "RESOLVED"}]
    assert sorted((r.number, r.establishment_id, r.open) for r in done.cards().collect()) == [(0, 2, 1), (1, 1, 1), (2, 1, 0)]


def test_barrier_reads_its_state_by_neighbours():
    """A thousand neighbouring documents, twice: an entry is read and written once a chunk, not once a document."""
    import pandas as pd

    from inspectra.streaming.documents import Barrier

    class State(dict):
        calls = 0

        def _call(self, f, *x):
            self.calls += 1
            return f(*x)

        containsKey, getValue, updateValue = (lambda self, k: self._call(self.__contains__, k)), (lambda self, k: self._call(self.get, k)), (lambda self, k, v: self._call(self.__setitem__, k, v))
        exists, update = (lambda self: "v" in self), (lambda self, v: self.__setitem__("v", v))
        get_value = dict.get

        def get(self, *k):
            return self.get_value(*k) if k else self["v"]

    held, counts = State(), State()
    barrier_ = Barrier()
    barrier_.init(type("Handle", (), {"getMapState": lambda *x: held, "getValueState": lambda *x: counts})())
    rows = lambda status, day, sealed: pd.DataFrame({"document_id": range(1000), "status": status, "dated": True, "sealed": sealed, "created_at": pd.Timestamp(f"2020-01-0{day}")})
    out = [x for part in (rows("RECEIVED", 1, True), rows("EXTRACTED", 3, False), rows("RECEIVED", 2, False)) for x in barrier_.handleInputRows((7,), [part], None)]
    assert [x.to_dict("records") for x in out] == [[{"batch_id": 7, "documents": 1000, "usable": 1000}]]
    assert held.calls <= 9


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    """Of two establishments one has nearly all rows: no task sorts them all, and what is read is the same."""
    table = Snapshots(spark, str(tmp_path), "establishment_id long, x long", "establishment_id", 4)
    rows = spark.range(0, 200_000, 1, 8).selectExpr("case when id % 1000 = 0 then 2L else 1L end as establishment_id", "xxhash64(id) as x")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "200k")
    try:
        table.write(rows, table.touched(rows), 0)
    finally:
        spark.conf.set(size, before)
    files = {b.name: len(list(b.glob("*.parquet"))) for b in (tmp_path / "data/number=0").iterdir() if b.is_dir()}
    assert max(files.values()) > 2
    assert table.read(0).exceptAll(rows).isEmpty() and table.read(0).count() == 200_000
