"""Canonical JSON and hashes against the standard library's."""

import datetime as dt
import decimal
import hashlib
import json

from pyspark.sql import functions as F

from inspectra.functions.canonical import canonical_json, content_hash
from inspectra.operators.documents import HASHED, chain_breaks, entry_hash

KINDS = "b struct<z:string,a:array<int>>, a string, m map<string,array<string>>, n bigint, t boolean, d date, x decimal(10,2)"


def test_canonical_json_equals_the_standard_library(spark):
    rows = [
        (("é  \U0001f600", [3, None, 1]), 'quote " back \\ tab \t nl \n \x00\x7f', {"b": ["1"], "a": [], "é": None}, -5, True, dt.date(2026, 4, 1), decimal.Decimal("10.50")),
        (None, "", {}, None, False, None, None),
        ((None, []), None, None, 1 << 60, None, dt.date(1999, 12, 31), decimal.Decimal("-0.05")),
    ]
    df = spark.createDataFrame(rows, KINDS)
    got = [r[0] for r in df.select(canonical_json(F.struct(*df.columns), df.schema)).collect()]
    names = df.columns
    plain = lambda r: {k: dict(zip(("z", "a"), v)) if k == "b" and v is not None else v for k, v in zip(names, r)}
    want = [json.dumps(plain(r), sort_keys=True, separators=(",", ":"), default=str) for r in rows]
    assert got == want
    assert [r[0] for r in df.select(content_hash(F.struct(*names), df.schema)).collect()] == [hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_a_tampered_chain(spark):
    entries, prev = [], "0"
    for i in range(1, 30):
        e = {"sequence": i, "recorded_at": dt.datetime(2026, 4, 1, 12, 0, i, 250000 * (i % 3), tzinfo=dt.timezone.utc), "action": "REVIEW", "actor_id": None, "actor_role": "ANALYST", "subject_type": "finding", "subject_id": str(i), "establishment_id": i % 4, "purpose": 'why "so"\n', "detail": {"reason": "größer", "by": str(i)}, "prev_hash": prev}
        text = json.dumps({**e, "recorded_at": e["recorded_at"].isoformat()}, sort_keys=True, separators=(",", ":"), default=str)
        prev = hashlib.sha256(text.encode()).hexdigest()
        entries.append({**e, "entry_hash": prev})
    entries[6]["purpose"] = "another"  # content, but not the hash
    entries[11]["prev_hash"] = "x"
    del entries[20]
    df = spark.createDataFrame([tuple(e[k] for k in [*HASHED, "entry_hash"]) for e in entries], "sequence bigint, recorded_at timestamp, action string, actor_id string, actor_role string, subject_type string, subject_id string, establishment_id bigint, purpose string, detail map<string,string>, prev_hash string, entry_hash string")
    assert sorted(map(tuple, chain_breaks(df, content=entry_hash(df)).collect())) == [(7, "entry_hash"), (12, "prev_hash"), (22, "sequence")]
