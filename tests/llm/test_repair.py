"""Conversation repair against a search over all edit sequences and a plain table of states."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from inspectra.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")
DELETABLE_ONLY = ("blank", "duplicate")


def every_audit(rows):
    """Cheapest (cost, audit) by trying all edits with at most one insert in each gap (a second one never helps)."""
    best = None
    for letters in itertools.product("KRD", repeat=len(rows)):
        if any(f in DELETABLE_ONLY and x != "D" for (_, f), x in zip(rows, letters)):
            continue
        cost = sum({"K": 0, "R": 3, "D": 4}[x] + (3 if f == "truncated" and x != "D" else 0) for (_, f), x in zip(rows, letters))
        for gaps in itertools.product((0, 1), repeat=len(rows) + 1):
            audit = "".join("I" * g + x for g, x in zip(gaps, [*letters, ""]))
            if best and (cost + 3 * sum(gaps), audit) >= best:
                continue
            # Own turns may be u or a; try both.
            kept, options = iter(rows), [""]
            for x in audit:
                initial = next(kept)[0] if x != "I" else None
                if x == "K":
                    options = [o + (initial or "?") for o in options]
                elif x != "D":
                    options = [o + r for o in options for r in "ua"]
            if any(LEGAL.fullmatch(o) for o in options):
                best = (cost + 3 * sum(gaps), audit)
    return best


def test_search_equals_all_edits():
    rng = random.Random(5)
    for _ in range(250):
        rows = [(rng.choice("suuaa x"), rng.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 5))]
        assert repair.cheapest(rows) == every_audit(rows), rows


def table_of_states(rows, entry=0, exits=(0, 3)):
    """The same by one pass over rows with the best audit of each state."""
    put = lambda b, c, x: None if b is None else (b[0] + c, b[1] + x)
    least = lambda *o: min((x for x in o if x is not None), default=None)
    step = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(b):
        for _ in range(3):
            b = [least(b[t], *(put(b[s], 3, "I") for s in range(4) if step[s] == t)) for t in range(4)]
        return b

    best = inserted([(0, "") if s == entry else None for s in range(4)])
    for c, f in rows:
        more = 3 if f == "truncated" else 0
        new = [put(b, 4, "D") for b in best]
        if f in (None, "truncated"):
            for s in range(4):
                new[step[s]] = least(new[step[s]], put(best[s], 3 + more, "R"))
                t = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, c))
                if t is not None:
                    new[t] = least(new[t], put(best[s], more, "K"))
        best = inserted(new)
    return least(*(best[s] for s in exits))


def test_long_search_equals_table_of_states():
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice("suuaaa "), rng.choice([None, None, None, "truncated", "blank"])) for _ in range(rng.randint(0, 120))]
        assert repair.cheapest(rows) == table_of_states(rows)
        for a in range(4):
            for b in range(4):
                assert repair.cheapest(rows[:20], a, (b,)) == table_of_states(rows[:20], a, (b,))


def plain(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)} of damaged rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or " ").encode() if r[1] is not None else b" ", (" " if r[2] is None else r[2]).encode()))
        own = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in own]
        seen, faults = set(), []
        for _, r, x in own:
            last = re.sub(r"[\x20\x09-\x0D]", "", x)[-1:]
            faults.append("blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last not in ".!?" else None)
            seen.add((r, x))
        cost, audit = table_of_states([(r[:1], f) for (_, r, _), f in zip(own, faults)])
        turns = {t for t, _, _ in own if t is not None}
        said, at, system = [], iter(own), 0
        for x in audit:
            _, role, text = next(at) if x != "I" else (0, None, "")
            if x == "D":
                continue
            if x == "K":
                system += not said and role[:1] == "s"
            else:
                role = ("user", "assistant")[(len(said) - system) % 2]
            said.append(f"{role}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def got(repaired):
    found = repair.summary(repaired).withColumnRenamed("conv_id", "c").join(repair.digests(repaired), F.col("c").eqNullSafe(F.col("conv_id")))
    return {r.c: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found.collect()}


def conversations():
    rng = random.Random(7)
    texts = ["Yes.", "No!", "What?", "cut off", " ", "", None, "Ünï. ", "a\nb.\n", "long " * 3000 + "."]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.") for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(50, t, ("user", "assistant")[t % 2], f"turn {t}" + rng.choice([".", "", ""])) for t in range(150)]
    rows += [(51, 3, "user", "same.")] * 90 + [(51, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b.", "c"])) for t in range(60)]
    rows += [(None, None, None, None), (None, None, "user", "x."), (None, 4, "user", "x."), (60, None, "user", "hi."), (60, None, "assistant", "ho."), (61, 2, "user", ""), (62, 1, "system", "only.")]
    return rows


@pytest.mark.parametrize("segment", [512, 16, 3])
def test_equals_plain_over_segments(spark, segment):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumns({"part": F.lit("x"), "seq": F.lit(1), "cost": F.lit(None).cast("int"), "c": F.lit(9)})
    assert got(repair.repair(df, segment)) == plain(rows)


def test_text_ids_and_empty_table(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("b", 1, "assistant", "Ho."), ("b", 2, "user", "No.")], "conv_id string, turn long, role string, text string")
    for segment in (512, 1):
        assert {k: v[5:7] for k, v in got(repair.repair(df, segment)).items()} == {"a": (3, "KI"), "b": (6, "IKKI")}
        assert repair.repair(df.where("false"), segment).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(10)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("x"))
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert sorted(map(tuple, repair.damage(df).collect()), key=str) == sorted(want, key=str)
