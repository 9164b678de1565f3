"""Stored domain tables: written and read back by their schemas, and assessed like the views."""

import pytest

from inspectra.operators import rules
from inspectra.sources import tables
from inspectra.sources.views import frame

SF = "/root/testdata/sf0.001"


def test_stored_tables_are_assessed_like_the_views(spark, tmp_path):
    for name in rules.TABLES:
        tables.write(frame(spark, SF, f"x_{name}"), str(tmp_path), name)
    stored = [tables.read(spark, str(tmp_path), name) for name in rules.TABLES]
    for name, df in zip(rules.TABLES, stored):
        assert df.schema.simpleString() == tables.schema(name).simpleString()
        assert df.count() == frame(spark, SF, f"x_{name}").count()
    some = tables.read(spark, str(tmp_path), "wage_line", "1995-01", "1995-03")
    assert some.count() == frame(spark, SF, "x_wage_line").where("period_start between '1995-01-01' and '1995-03-31'").count() > 0
    pick = lambda df: sorted(map(tuple, df.select(*rules.K, "rule_id", "state", "assessed", "failing").collect()))
    assert pick(rules.outcomes_of(rules.Tables(*stored))) == pick(rules.outcomes(spark, SF))


@pytest.mark.parametrize("name", ["registration", "identity"])
def test_other_tables(spark, tmp_path, name):
    tables.write(frame(spark, SF, f"x_{name}"), str(tmp_path), name)
    assert sorted(map(str, tables.read(spark, str(tmp_path), name).collect())) == sorted(map(str, frame(spark, SF, f"x_{name}").select(*tables.schema(name).names).collect()))
