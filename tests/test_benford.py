import random

from inspectra.operators import anomaly


def test_first_digits_of_all_columns_take_one_pass(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(i % 2, rng.choice([None, 0, -31, 7, 72, 900]), rng.choice([0, 1, 15])) for i in range(600)], "e long, a long, b long")
    found = anomaly.benford(rows, ["a", "b"], ["e"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    each = anomaly.benford(rows, "a", ["e"]).unionByName(anomaly.benford(rows, "b", ["e"]))
    assert sorted(found.collect()) == sorted(each.collect()) and found.count() == 4
    for r in found.collect():
        own = [str(abs(x))[0] for e, *ab in map(tuple, rows.collect()) if e == r.e and (x := ab["ab".index(r.test[-1])])]
        assert (r.sample_size, r.value) == (len(own), round(own.count("1") / len(own), 4))
