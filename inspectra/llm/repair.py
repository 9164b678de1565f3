"""Conversation structure repair: cheapest edits that make the roles of a conversation `(s?(ua)+)?`.

The edit lattice of a conversation has a node for each (rows behind, what the repaired roles so far allow): nothing yet, after
the system turn, after a user turn, after an assistant turn. Edges are Keep, Rerole, Delete and Insert. A bidirectional Dijkstra search walks it: a forward heap from the start
and a reverse heap from the ends settle nodes by cost; each node keeps the least prefix or suffix of the audit among its cheapest. They meet at nodes and
edges; the search goes on until the two heads cost more than the best meeting, so that all crossings of equal cost are seen, and the least concatenated audit is taken. Of two
audits of the same rows with equal cost none begins with the other (what follows would be inserts, which cost), so least parts make a least whole.

Conversations of up to `segment` rows are repaired in one go. Longer ones are sorted over all tasks and cut into segments; each is searched from every state to every
state (16 searches), and a fold along the segments, which holds four audits and four pointers a segment, picks states. So no
conversation is gathered in a task; only what a conversation's audit and hash are by their nature sequential in is streamed by one task.

Defined cases: nulls in turn come first; a null role or text is one space; a null conv_id is an id like others; equal turns are ordered by role, then text; repeated rows are
duplicates of the first; empty texts are blank; very long texts move once with their row, in texts and hashes whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, table

SEGMENT = 512
#: State after an initial, by state: nothing yet 0, after system 1, after user 2, after assistant 3.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one state that a user or assistant turn of the repair's own leads to, and its role.
NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
ENDS = (0, 3)
RETYPE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_BLANKS = " \t\n\x0b\x0c\r"

_EDITS = "array<struct<edit: string, role: string, text: string>>"
_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long"
_COUNT_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults dealt by crc32 of `conv_id:turn`."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    held = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return held.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("again")).drop("again")


def fault(role: str, text: str, seen: bool) -> str | None:
    """blank, duplicate, truncated or none; seen: the same role and text stood before."""
    if not _SEEN.search(text):
        return "blank"
    if seen:
        return "duplicate"
    return None if text.rstrip(_BLANKS)[-1] in ".!?" else "truncated"


def _forward(rows: list[tuple[str, str | None]], i: int, s: int) -> Iterator[tuple[int, int, int, str]]:
    yield i, NEXT[s][0], INSERT, "I"
    if i < len(rows):
        initial, wrong = rows[i]
        yield i + 1, s, DELETE, "D"
        if wrong in (None, "truncated"):
            more = CUT_OFF if wrong else 0
            if initial in AFTER[s]:
                yield i + 1, AFTER[s][initial], more, "K"
            yield i + 1, NEXT[s][0], RETYPE + more, "R"


#: What leads to a state: by keeping an initial, by the repair's own turn.
_KEPT_FROM = [[(p, c) for p in range(4) for c, t in AFTER[p].items() if t == s] for s in range(4)]
_OWN_FROM = [[p for p in range(4) if NEXT[p][0] == s] for s in range(4)]


def _backward(rows: list[tuple[str, str | None]], i: int, s: int) -> Iterator[tuple[int, int, int, str]]:
    for p in _OWN_FROM[s]:
        yield i, p, INSERT, "I"
    if i:
        initial, wrong = rows[i - 1]
        yield i - 1, s, DELETE, "D"
        if wrong in (None, "truncated"):
            more = CUT_OFF if wrong else 0
            for p, c in _KEPT_FROM[s]:
                if c == initial:
                    yield i - 1, p, more, "K"
            for p in _OWN_FROM[s]:
                yield i - 1, p, RETYPE + more, "R"


def cheapest(rows: list[tuple[str, str | None]], entry: int = 0, exits: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, audit) from a state to one of the exits over rows (role initial, fault), or None. Ties: the least audit."""
    n = len(rows)
    ahead: list[tuple] = [(0, 0, "", entry)]  # cost, rows behind, prefix, state: keeping costs nothing and moves on, so equal costs settle in the order of rows
    back: list[tuple] = [(0, -n, "", s) for s in exits]
    heapq.heapify(back)
    done: tuple[dict, dict] = ({}, {})
    best: tuple[int, str] | None = None
    while ahead and back and (best is None or ahead[0][0] + back[0][0] <= best[0]):
        side = 0 if ahead[0][0] <= back[0][0] else 1
        heap, own, other = (ahead, back)[side], done[side], done[1 - side]
        cost, at, audit, s = heapq.heappop(heap)
        i = -at if side else at
        if (i, s) in own:
            continue
        own[i, s] = (cost, audit)
        met = [(cost + other[i, s][0], other[i, s][1] + audit if side else audit + other[i, s][1])] if (i, s) in other else []
        for j, t, more, letter in (_backward if side else _forward)(rows, i, s):
            longer = letter + audit if side else audit + letter
            if (j, t) in other:
                far = other[j, t]
                met.append((cost + more + far[0], far[1] + longer if side else longer + far[1]))
            if (j, t) not in own:
                heapq.heappush(heap, (cost + more, -j if side else j, longer, t))
        best = min([*met, *([best] if best else [])], default=None)
    return best


def edits(audit: str, rows: list[tuple[str, str]], entry: int = 0) -> list[dict]:
    """The edits of an audit over rows (role, text): each with the role and text of the repaired turn, null where a row is deleted."""
    out, i, s = [], 0, entry
    for letter in audit:
        role, text = (None, None) if letter == "I" else rows[i]
        i += letter != "I"
        if letter == "D":
            out.append({"edit": "D", "role": None, "text": None})
            continue
        if letter == "K":
            s = AFTER[s][role[:1]]
        else:
            s, role = NEXT[s]
        out.append({"edit": letter, "role": role, "text": text or ""})
    return out


def _counts(rows: list[tuple], faults: list[str | None]) -> dict:
    turns = {r[0] for r in rows if r[0] is not None}
    legal = ("su", "ua", "au")
    return {
        **{k: sum(f == k for f in faults) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in legal for a, b in zip(rows, rows[1:])),
        "turns": len(turns), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None),
    }


def _streamed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[object, int, list[tuple]]]:
    """(id, number of the piece, rows) of sorted rows (id, ...): a piece ends with its id or after `most` rows."""
    each = ((r[0], r[1:]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for key, group in groupby(each, key=lambda r: r[0]):
        held, k = [], 0
        for _, row in group:
            held.append(row)
            if len(held) == most:
                yield key, k, held
                held, k = [], k + 1
        if held:
            yield key, k, held


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(id_type: pa.DataType, extra: list[tuple]) -> pa.Schema:
    edit = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return pa.schema([("conv_id", id_type), ("part", pa.int32()), ("seq", pa.int32()), *((c, pa.int64()) for c in _COUNT_NAMES), *((k, pa.list_(edit) if v == "edits" else v) for k, v in extra)])


def _short(rows: DataFrame, id_type: str) -> DataFrame:
    """Conversations whole, one row each."""
    arrow = _arrow(to_arrow_type(rows.schema["conv_id"].dataType), [("cost", pa.int64()), ("audit", pa.string()), ("edits", "edits")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, _, own in _streamed(batches, 1 << 62):
            seen, faults = set(), []
            for _, role, text in own:
                mark = (role, hashlib.md5(text.encode()).digest())
                faults.append(fault(role, text, mark in seen))
                seen.add(mark)
            cost, audit = cheapest([(r[1][:1], f) for r, f in zip(own, faults)])
            out.append({"conv_id": conv, "part": 0, "seq": 0, **_counts(own, faults), "cost": cost, "audit": audit, "edits": edits(audit, [r[1:] for r in own])})
            size += sum(len(r[2]) for r in own)
            if len(out) == 1000 or size > 8 << 20:
                yield _batch(out, arrow)
                out, size = [], 0
        if out:
            yield _batch(out, arrow)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {id_type}, part int, seq int, {_COUNTS}, cost long, audit string, edits {_EDITS}")


def _segments(rows: DataFrame, id_type: str, most: int) -> DataFrame:
    """Long conversations as segments, in the order of (part, seq), each with costs and audits of all 16 pairs of states. rows: with first_at, the first turn of the same role and text."""
    arrow = _arrow(to_arrow_type(rows.schema["conv_id"].dataType), [("begin", pa.list_(pa.string())), ("end", pa.list_(pa.string())), ("begin_turn", pa.int64()), ("end_turn", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for conv, seq, own in _streamed(batches, most):
            # Repeated rows stand side by side, in one partition; `copy` numbers them.
            faults = [fault(role, text, copy > 0 or turn != first) for turn, role, text, first, copy in own]
            lattice = [(r[1][:1], f) for r, f in zip(own, faults)]
            found = [cheapest(lattice, a, (b,)) or (None, None) for a in range(4) for b in range(4)]
            row = {"conv_id": conv, "part": part, "seq": seq, **_counts(own, faults), "begin": [own[0][1][:1]], "end": [own[-1][1][:1]], "begin_turn": own[0][0], "end_turn": own[-1][0]}
            yield _batch([row | {"costs": [c for c, _ in found], "audits": [a for _, a in found], "roles": [r[1] for r in own], "texts": [r[2] for r in own]}], arrow)

    place = ["conv_id", "turn", "role", "text", "copy"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *place).sortWithinPartitions(*place)
    return cut(dealt.select("conv_id", "turn", "role", "text", "first_at", "copy").mapInArrow(run, f"conv_id {id_type}, part int, seq int, {_COUNTS}, begin array<string>, end array<string>, begin_turn long, end_turn long, costs array<long>, audits array<string>, roles array<string>, texts array<string>"))


def _states(segments: DataFrame, id_type: str) -> DataFrame:
    """(conv_id, part, seq, way, more_illegal, same_turn): the pair of states that each segment goes through, and what lies across its beginning."""
    arrow = pa.schema([("conv_id", to_arrow_type(segments.schema["conv_id"].dataType)), *((k, pa.int32()) for k in ("part", "seq", "way", "more_illegal", "same_turn"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for conv, group in groupby(each, key=lambda r: r[0]):
            best: list = [(0, ""), None, None, None]
            steps, last = [], None
            for _, part, seq, begin, end, begin_turn, end_turn, costs, audits in group:
                after: list = [None] * 4
                back = [0] * 4
                for t in range(4):
                    options = [(best[s][0] + costs[4 * s + t], best[s][1] + audits[4 * s + t], s) for s in range(4) if best[s] and costs[4 * s + t] is not None]
                    if options:
                        cost, audit, back[t] = min(options)
                        after[t] = (cost, audit)
                illegal = last is not None and last[0] + begin[0] not in ("su", "ua", "au")
                same = last is not None and last[1] is not None and last[1] == begin_turn
                steps.append((part, seq, back, int(illegal), int(same)))
                best, last = after, (end[0], end_turn)
            t = min((best[s], s) for s in ENDS if best[s])[1]
            out = []
            for part, seq, back, illegal, same in reversed(steps):
                out.append({"conv_id": conv, "part": part, "seq": seq, "way": 4 * back[t] + t, "more_illegal": illegal, "same_turn": same})
                t = back[t]
            yield _batch(out, arrow)

    rows = segments.select("conv_id", "part", "seq", "begin", "end", "begin_turn", "end_turn", "costs", "audits")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return dealt.mapInArrow(run, f"conv_id {id_type}, part int, seq int, way int, more_illegal int, same_turn int")


def _long(rows: DataFrame, id_type: str, most: int) -> DataFrame:
    """Conversations of many rows, a row for each segment."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = rows.withColumn("own", F.md5("text"))
    first = rows.groupBy("conv_id", "role", "own").agg(F.min(place).alias("first")).withColumnsRenamed({"conv_id": "c", "role": "r", "own": "o"})
    # Equal rows are counted and dealt again as copies, so that they are numbered without a window.
    counted = rows.groupBy("conv_id", "turn", "role", "text", "own").agg(F.count(F.lit(1)).alias("n"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("own") == F.col("o"))
    segments = _segments(each.join(first, same).withColumn("first_at", F.col("first.turn")), id_type, most)
    ways = _states(segments, id_type).withColumnsRenamed({"conv_id": "c", "part": "p", "seq": "q"})
    chosen = segments.join(ways, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("q")))
    chosen = chosen.withColumns({"illegal": F.col("illegal") + F.col("more_illegal"), "turns": F.col("turns") - F.col("same_turn"), "cost": F.get("costs", F.col("way")), "audit": F.get("audits", F.col("way"))})

    @F.udf(_EDITS)
    def applied(audit, roles, texts, way):
        return edits(audit, list(zip(roles, texts)), way // 4)

    return chosen.select("conv_id", "part", "seq", *_COUNT_NAMES, "cost", "audit", applied("audit", "roles", "texts", "way").alias("edits"))


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, part, seq, counts, cost, audit, edits) of rows (conv_id, turn, role, text): a row for each conversation, or, above `segment` rows, for each of its segments in the order of (part, seq).

    edits: array of (edit, role, text); of a deleted row role and text are null.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    one = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    held = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role"), one("text"))
    many = cut(held.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > segment).select(F.col("conv_id").alias("c")))
    if many.isEmpty():
        return _short(held, id_type)
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    return _short(held.join(many, same, "left_anti"), id_type).unionByName(_long(held.join(many, same, "left_semi"), id_type, segment))


def summary(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): one row for each conversation."""
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"]), "")
    return repaired.groupBy("conv_id").agg(gaps, *sums, audit.alias("audit"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of `role:text` of the turns, newline-joined. The hash is fed turn by turn."""
    rows = repaired.select("conv_id", "part", "seq", F.filter("edits", lambda e: e["edit"] != "D").alias("e"))
    rows = rows.select("conv_id", "part", "seq", F.array_join(F.transform("e", lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n").alias("said"), (F.size("e") > 0).alias("any"))
    arrow = pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for conv, group in groupby(each, key=lambda r: r[0]):
            state, begun = hashlib.sha256(), False
            for _, said, some in group:
                if some:
                    state.update((b"\n" if begun else b"") + said.encode())
                    begun = True
            out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
            if len(out) == 1000:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    id_type = repaired.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "said", "any")
    return dealt.mapInArrow(run, f"conv_id {id_type}, repaired_sha256 string")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repaired = cut(repair(damage(rows)))
    found = summary(repaired).withColumnRenamed("conv_id", "c")
    hashes = digests(repaired).withColumnRenamed("conv_id", "d")
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The remainders of four bits in the CRC-32 of zlib.
_CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"


def _put(state: str, cost: str, letter: str) -> str:
    return f"lpad((substr({state}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({state}, 13) || '{letter}'"


#: What a row makes of the four states; audits behind costs of twelve digits, so that the least text is the best.
_ROW = ",\n".join(
    f"least({', '.join(options)}) AS {state}"
    for state, options in {
        "x0": [_put("b0", "4", "D")],
        "x1": [_put("b1", "4", "D"), f"CASE WHEN keep AND c = 's' THEN {_put('b0', 'cut', 'K')} END"],
        "x2": [_put("b2", "4", "D"), *(f"CASE WHEN keep AND c = 'u' THEN {_put(p, 'cut', 'K')} END" for p in ("b0", "b1", "b3")), *(f"CASE WHEN keep THEN {_put(p, '3 + cut', 'R')} END" for p in ("b0", "b1", "b3"))],
        "x3": [_put("b3", "4", "D"), f"CASE WHEN keep AND c = 'a' THEN {_put('b2', 'cut', 'K')} END", f"CASE WHEN keep THEN {_put('b2', '3 + cut', 'R')} END"],
    }.items()
)
_INSERTED = f"x0 AS b0, x1 AS b1, least(x2, {', '.join(_put(p, '3', 'I') for p in ('x0', 'x1', 'x3'))}) AS b2, least(x3, {_put('x2', '3', 'I')}) AS b3"

OP11_SQL = rf"""
WITH RECURSIVE
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS spot FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(spot, ''), lambda b: [ascii(b) & 15, ascii(b) >> 4]))::BIGINT[]),
          lambda c, x: xor(c >> 4, ({_CRC}::BIGINT[])[(xor(c, x) & 15) + 1])), 4294967295::BIGINT) % 20 AS kind FROM coded),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM kinds, range(2) AS r(again) WHERE kind <> 0 AND (again = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
           role[1] AS c, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
steps AS (SELECT conv_id, i, c, fault IN ('', 'truncated') AS keep, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS cut FROM faulty),
walk AS (SELECT conv_id, 0::BIGINT AS i, {_INSERTED} FROM (SELECT DISTINCT conv_id, '000000000000' AS x0, NULL::VARCHAR AS x1, NULL::VARCHAR AS x2, NULL::VARCHAR AS x3 FROM steps)
         UNION ALL
         SELECT conv_id, i, {_INSERTED} FROM (SELECT w.conv_id, s.i, {_ROW} FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1)),
ended AS (SELECT conv_id, arg_max(least(b0, b3), i) AS best FROM walk GROUP BY conv_id),
letters AS (SELECT conv_id, substr(best, 13) AS audit, unnest(range(1, length(best) - 11)) AS j FROM ended),
edit AS (SELECT conv_id, j, audit[j] AS letter, sum((audit[j] <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM letters),
turned AS (SELECT e.conv_id, j, letter, f.role, f.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY j) - 1 AS p,
           first_value(letter = 'K' AND f.c = 's') OVER (PARTITION BY e.conv_id ORDER BY j) AS system
           FROM edit e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND letter <> 'I' WHERE letter <> 'D'),
said AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (p - system::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS said FROM turned GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(substr(best, 1, 12)::BIGINT, 0) AS cost, coalesce(substr(best, 13), '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
"""
