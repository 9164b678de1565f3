import io
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from inspectra.llm import decontaminate, exact, language, mixture, quality, toxicity, warc
from inspectra.llm.registry import ORACLE_SQL, QUERIES
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


def test_queries_match_sql(spark):
    con = connect(SF)
    for name, sql in ORACLE_SQL.items():
        same(QUERIES[name](spark, SF), con, sql)


def test_chunks_join_to_the_text():
    rng = random.Random(1)
    for size in (0, 1, 64, 65, 5000, 300_000):
        data = bytes(rng.choice(b"ab ") for _ in range(size))
        assert b"".join(exact.chunks(data)) == data
        assert all(exact.chunks(data)) or not data
    assert exact.chunks(b"x" * 200_000)[0] == b"x" * (1 << 16)


def test_exact_groups(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, "", "x"), (5, "a ", "x"), (5, "a ", "x"), (6, "long " * 40_000, "x"), (7, "long " * 40_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, recipe string")
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df).collect())
    assert got == [(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (5, 5, 2, True), (6, 7, 2, False), (7, 7, 2, True)]
    assert exact.clashing_chunks(df).count() == 0
    assert exact.exact_groups(df.where("false")).count() == 0
    nameless = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (None, "c"), (7, "c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact.exact_groups(nameless).collect())
    assert got == [(0, 0, 1, True), (0, 0, 2, True), (0, 0, 2, True), (0, 7, 2, False), (7, 7, 2, True)]
    # Identifiers that clash prove nothing: whole texts are compared.
    want = sorted(map(tuple, exact.exact_groups(df).collect()))
    weak = lambda chunk: chunk[:1]
    assert exact.clashing_chunks(df, identify=weak).count() > 0
    assert sorted(map(tuple, exact.exact_groups(df, identify=weak).collect())) == want


def test_decontaminate_cases(spark):
    bench = spark.createDataFrame([("i1", "One two THREE four five six seven eight nine ten eleven"), ("i2", "short item"), ("i3", None), ("i4", "...")], "item_id string, text string")
    docs = [(1, "x one two three four five six seven eight nine ten y"), (2, None), (3, "!!"), (4, "a short, ITEM here short item"), (5, "one two three four five six seven eight nine"), (6, "Éa short item")]
    df = spark.createDataFrame([(i, t, "w") for i, t in docs], "doc_id long, text string, words string")
    for limits in ({}, {"block": 1}, {"block": 1, "hashes": 1}):
        got = {r.doc_id: (r.n_words, r.spans, r["items"]) for r in decontaminate.hits(df, bench, **limits).collect()}
        span = lambda v: [(s.start, s.end) for s in v]
        assert {k: (n, span(s), i) for k, (n, s, i) in got.items()} == {
            1: (12, [(1, 11)], ["i1"]), 2: (0, [], []), 3: (0, [], []), 4: (6, [(1, 3), (4, 6)], ["i2"]), 5: (9, [], []), 6: (3, [(1, 3)], ["i2"]),
        }
    assert sorted(r.doc_id for r in decontaminate.remove_documents(df, bench).collect()) == [2, 3, 5]
    clashing = df.withColumns({"bad_id": F.lit(1), "bad_text": F.lit("x"), "own": F.lit(2), "hashes": F.lit(3)})
    left = decontaminate.remove_documents(clashing, bench)
    assert left.columns == clashing.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5]
    assert decontaminate.remove_documents(clashing.where("false"), bench).count() == 0
    assert decontaminate.decontaminate(df.where("false"), bench).count() == 0
    again = spark.createDataFrame([(1, "short item"), (1, "clean text of another row"), (1, "short item"), (None, "a short item"), (None, "clean")], "doc_id long, text string")
    got = sorted((r.n_words, r.n_hit) for r in decontaminate.decontaminate(again, bench).collect())
    assert got == [(1, 0), (2, 2), (3, 2), (5, 0)]
    assert sorted(r.text for r in decontaminate.remove_documents(again, bench).collect()) == ["clean", "clean text of another row"]
    assert decontaminate.decontaminate(df, bench.where("false")).where("contaminated").count() == 0


def test_mixture(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 10 == 1, None).otherwise("a").alias("source"), F.lit("t").alias("text"))
    rates = {r.source: r.rate for r in mixture.source_rates(df, {"a": 1.0, "b": 3.0}).collect()}
    assert rates[None] == 0 and abs(rates["b"] - 7.5) < 1e-9
    n = {r.source: r["count"] for r in mixture.mix(df, {"a": 1.0, "b": 3.0}).groupBy("source").count().collect()}
    assert abs(n["a"] - 1000) < 120 and abs(n["b"] - 3000) < 200 and None not in n
    big = mixture.mix(df, {"b": 50.0}, size=20.0)  # a rate of 200 is split
    assert abs(big.count() - 80_000) < 1200
    again = mixture.mix(df.repartition(7), {"a": 1.0, "b": 3.0})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixture.mix(df, {"a": 1.0, "b": 3.0}).collect()))
    assert mixture.mix(df.where("false")).count() == 0
    odd = df.select("*", *(F.lit(1).alias(c) for c in ("source_", "rate_", "N_", "deal_", "a.b`c", "cdf_")), F.lit(9).alias("Copy"))
    got = mixture.mix(odd, {"a": 1.0, "b": 3.0})
    assert got.columns == ["doc_id", "source", "text", "source_", "rate_", "N_", "deal_", "a.b`c", "cdf_", "copy"] and got.count() == n["a"] + n["b"]
    many = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert mixture.mix(many, {"a": 1.0}, size=9.0).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_toxicity_matching(spark):
    lexicon = {" idiot ": 5.0, " lowe": 4.0, " trash ": 5.0}
    auto = toxicity.matcher(lexicon)
    assert toxicity.match_weight(auto, "You 1d10t!")[1] == 1
    assert toxicity.match_weight(auto, "yоu іdіоt")[1] == 1  # look-alike letters
    assert toxicity.match_weight(auto, "idiotic slowest trash can")[1] == 0
    assert toxicity.match_weight(auto, "Loweisch")[1] == 1
    assert toxicity.match_weight(auto, None) == (0.0, 0) == toxicity.match_weight(None, "idiot")
    df = spark.createDataFrame([(1, None), (2, ""), (3, "idiot")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(df, (lexicon, 5.0, -2.0)).collect()}
    assert got == {1: 0, 2: 0, 3: 1}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(df, none, lambda i: ~toxicity.held_out(i))
    assert all(r.predicted == 0 for r in toxicity.toxicity(df, model).collect())


def test_language(spark):
    rows = [(i, ["the cat sat on the mat with that", "der hund und die katze sind nicht"][i % 2] + f" {'xyz'[i % 3]}", ["en", "de"][i % 2]) for i in range(40)]
    df = spark.createDataFrame([*rows, (100, None, None), (101, "12 34", None), (102, "the mat", None)], "doc_id long, text string, lang string")
    filters = language.fit(df, lambda i: ~language.held_out(i))
    got = {r.doc_id: r.lang_pred for r in language.identify(df, filters).collect()}
    assert got[100] == got[101] == "und" and got[102] == "en"
    assert all(got[i] == lang for i, _, lang in rows)
    many = language.Filters([f"l{i:03}" for i in range(70)], language.grams("aaa bbb")[:3], np.array([0, 65, 65]))
    assert len(many.scores("aaa")) == 70
    assert all(r.lang_pred == "und" for r in language.identify(df, language.fit(df, lambda i: F.lit(False))).collect())


def test_quality_top_k(spark):
    rng = random.Random(2)
    keys = [(i, rng.choice([0.5, 1.5, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(keys, "doc_id long, key double")
    order = sorted(keys, key=lambda x: (-x[1], x[0]))
    for k in (1, 700, 1500, 3000):
        assert quality.kth_largest(df, k, ranges=8, few=50) == (order[k - 1][1], order[k - 1][0])
    assert quality.kth_largest(df.where("false"), 3) is None


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(4)
    pages = [(i, f"http://x/{i}", [None, "", "same", "".join(chr(rng.randrange(32, 900)) for _ in range(rng.randrange(3000)))][i % 4]) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/w"
    archives = warc.write(df, folder)
    for split in (1 << 22, 997):
        got = {r.page_id: r for r in warc.read(archives, folder, split).collect()}
        assert len(got) == 60
        first = {}
        for i, url, html in pages:
            data = (html or "").encode()
            r = got[i]
            want = first.setdefault(data, i)
            assert (r.record_type, r.refers_to) == (("response", None) if want == i else ("revisit", want))
            assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(data), warc.digest32(data))
            assert r.payload == (data if want == i else None) or (want == i and bytes(r.payload) == data)


def test_warc_repeated_page_id(spark, tmp_path):
    pages = [(3, "u", "A"), (7, "u", "A"), (7, "u", "C"), (4, "u", "B"), (7, "u", "B"), (7, "u", "C"), (None, "u", "A")]
    folder = f"file://{tmp_path}/w"
    archives = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), folder)
    got = sorted((r.page_id or 0, r.refers_to or 0, bytes(r.payload or b"")) for r in warc.read(archives, folder).collect())
    assert got == [(0, 0, b"A"), (3, 0, b"A"), (4, 0, b"B"), (7, 0, b"C"), (7, 0, b"C"), (7, 3, b""), (7, 4, b"")]


def records(blob, cuts, piece=16):
    edges = [0, *cuts, len(blob)]
    return [x for a, b in zip(edges, edges[1:]) for x in warc.scan(io.BytesIO(blob), a, b, piece)]


def test_false_magic_is_not_a_record():
    inner = warc.member(b"not a record")
    blob = b"".join(warc.member(warc.record(i, "u", zlib.compress(bytes([i])) + inner, None), 0) for i in range(5))
    for cut in range(1, len(blob), 7):
        assert [warc.parse(x)["page_id"] for x in records(blob, [cut])] == list(range(5))


def test_archive_in_a_payload():
    inner = b"".join(warc.member(warc.record(90 + i, "u", b"inner", None)) for i in range(2))
    blob = b"".join(warc.member(warc.record(i, "u", inner if i == 1 else b"x" * i, None), 0) for i in range(4))
    for cut in range(1, len(blob), 5):
        assert [warc.parse(x)["page_id"] for x in records(blob, [cut])] == list(range(4)), cut


def test_archives_of_other_writers():
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n"
    plain = b"WARC/1.0\r\nwarc-type:response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    blob = warc.member(info) + warc.member(plain)
    assert [warc.parse(x) for x in records(blob, [])] == [None, {"page_id": None, "url": "http://x", "record_type": "response", "refers_to": None, "payload_digest": warc.digest32(b"body"), "payload_bytes": 4, "payload": b"body"}]
    assert records(b"", []) == [] and records(b"junk", [2]) == []
    assert len(records(warc.member(plain) + b"junk", [9])) == 1
