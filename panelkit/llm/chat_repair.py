"""Conversation structure repair: the cheapest edits that leave no faulty turn and
give role initials ``(s?(ua)+)?``.

Rows are sorted once over the whole table, so that a conversation is a run of
rows that may cross partitions; its part in one partition is a segment.  Four
states tell what of the pattern stands so far (nothing, the system turn, a user
turn, an assistant turn).  What a segment costs from each state to each is a
small min-plus matrix; a conversation's matrices give the cost vector behind each
segment and so the state it starts in.  Inside a segment the backward cost vectors
are stored at every square root of its length only; blocks between them are
recomputed while walking forward, which emits at each step the ASCII-least letter
that the vectors allow.  No step holds more than one segment's codes (one byte a
row), or one conversation's matrices (one for each partition at most)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import materialise, on_workers

# What the edits cost, and an undeleted truncated turn beside them.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: More than any cost; costs beyond it are cut back to it.
NEVER = 1 << 60
#: White space of texts.
BLANKS = " \t\n\x0b\f\r"

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
#: Where an inserted or reroled turn leads: to a user turn, after one to an assistant turn.
ONWARD = (2, 2, 3, 2)
#: Where a kept turn leads, by its initial (s, u, a, other) and the state; None: nowhere.
KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None, None, None, None))
#: Cost of ending in a state, inserts included.
ENDED = (0, INSERT * 2, INSERT, 0)

# A row's code: its initial, +4 if it has to go, +8 if it is truncated.
GONE, CUT = 4, 8


def _inserted(v: list[int]) -> list[int]:
    """Costs where any number of inserts may come before what ``v`` tells."""
    user, assistant = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return [min(v[0], INSERT + user), min(v[1], INSERT + user), user, assistant]


def _moves(code: int) -> list[tuple[tuple[str, int, int], ...]]:
    """For each state: (letter, cost, next state) of the ways to deal with a row."""
    out = []
    for state in range(4):
        ways = [("D", DELETE, state)]
        if not code & GONE:
            extra = TRUNCATED if code & CUT else 0
            to = KEPT[code & 3][state]
            if to is not None:
                ways.append(("K", extra, to))
            ways.append(("R", REROLE + extra, ONWARD[state]))
        out.append(tuple(ways))
    return out


MOVES = [_moves(code) for code in range(16)]


def before_row(code: int, v: list[int]) -> list[int]:
    """The cost vector before a row, from the one behind it."""
    return _inserted([min(cost + v[to] for _, cost, to in ways) for ways in MOVES[code]])


def matrix(codes: bytes) -> list[int]:
    """Least costs through the rows, from state (row) to state (column)."""
    columns = []
    for end in range(4):
        v = [0 if state == end else NEVER for state in range(4)]
        for code in reversed(codes):
            v = before_row(code, v)
        columns.append(v)
    return [min(columns[end][start], NEVER) for start in range(4) for end in range(4)]


def through(m: list[int], v: list[int]) -> list[int]:
    """The cost vector before a segment, from its matrix and the one behind it."""
    return [min(m[4 * start + end] + v[end] for end in range(4)) for start in range(4)]


def walk(codes: bytes, v_end: list[int], state: int, last: bool, emit: Callable[[int, str, int], None] | None = None) -> int:
    """Walk the ASCII-least cheapest edits through the rows and return the state
    they lead to. ``emit(row, letter, state after)``; inserts come with the row
    they precede, those at the very end (``last``) with row ``len(codes)``."""
    n = len(codes)
    step = isqrt(n) + 1
    v, stored = list(v_end), {}
    for at in range(n, 0, -1):
        if at % step == 0 or at == n:
            stored[at] = v
        v = before_row(codes[at - 1], v)
    for start in range(0, n, step):
        stop = min(start + step, n)
        block = [stored[stop]]  # vectors behind rows start .. stop - 1, from the back
        for at in range(stop - 1, start, -1):
            block.append(before_row(codes[at], block[-1]))
        for at in range(start, stop):
            v = block[stop - 1 - at]
            here = before_row(codes[at], v)
            while True:
                # letters in ASCII order: D, I, K, R
                ways = MOVES[codes[at]][state]
                if here[state] == DELETE + v[state]:
                    letter, to = "D", state
                elif here[state] == INSERT + here[ONWARD[state]]:
                    letter, to = "I", ONWARD[state]
                else:
                    letter, to = next((x, to) for x, cost, to in ways[1:] if cost + v[to] == here[state])
                if emit:
                    emit(at, letter, to)
                state = to
                if letter != "I":
                    break
    if last:
        while ENDED[state]:
            state = ONWARD[state]
            if emit:
                emit(n, "I", state)
    return state


# ---- runs of sorted rows --------------------------------------------------

def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[int], bytearray, list | None]]:
    """((conversation, part), positions, codes, info) of rows (conv, part, pos,
    code, info) that are sorted; an info row comes first, with position -1."""
    key, at, codes, info = None, [], bytearray(), None
    for batch in batches:
        for conv, part, pos, code, told in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (conv, part):
                if key is not None:
                    yield key, at, codes, info
                key, at, codes, info = (conv, part), [], bytearray(), None
            if pos < 0:
                info = told
            else:
                at.append(pos)
                codes.append(code)
    if key is not None:
        yield key, at, codes, info


def _rows(out: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in out:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _by_segment(coded: DataFrame, info: DataFrame | None, added: str, work: Callable) -> DataFrame:
    """Run ``work(key, positions, codes, info)``, which yields tuples of the
    columns ``added``, over each segment; with ``info`` (conv, part, info) only
    over those that it tells of. Returns (conv, part) and these columns."""
    rows = coded.select("conv", "part", "pos", "code", F.lit(None).cast("array<bigint>").alias("info"))
    if info is not None:
        rows = rows.unionByName(info.select("conv", "part", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("code"), "info"))
    rows = rows.repartition("conv", "part").sortWithinPartitions("conv", "part", "pos")
    kind = T.StructType([coded.schema["conv"], coded.schema["part"], *T.StructType.fromDDL(added)])
    schema, told = to_arrow_schema(kind), info is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(((*key, *row) for key, at, codes, x in _runs(batches) if x is not None or not told
                      for row in work(key, at, bytes(codes), x)), schema)

    on_workers(coded.sparkSession)
    return rows.mapInArrow(run, kind)


def _by_conversation(segments: DataFrame, fields: list[str], added: str, work: Callable) -> DataFrame:
    """Run ``work(segments in order)``, which yields tuples of ``added`` for each
    segment, over each conversation's segments: one for each partition at most."""
    all_of = segments.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", *fields))).alias("parts"))
    kind = T.StructType([segments.schema["conv"], segments.schema["part"], *T.StructType.fromDDL(added)])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for batch in batches:
                for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for part, row in zip(parts, work(parts)):
                        yield conv, part["part"], *row

        return _rows(out(), schema)

    on_workers(segments.sparkSession)
    return all_of.mapInArrow(run, kind)


# ---- the operator -----------------------------------------------------------

def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def faulty_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per turn: conv, part and pos (place in the order of the whole
    table), turn, role, text, ``fault`` (blank, duplicate, truncated or null).

    Turns stand by number, nulls first, those that share one by role and text.
    Null role or text counts as one space, a null conversation as one of its own.
    Blank: no character but white space. Duplicate: role and text stand earlier
    in the conversation. Truncated: the last character that is not white space
    is none of ``.!?``. Other columns are ignored. The result is a written table."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"),
                     text(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv", "turn", "role", "text", "tie"]  # the tie lets rows that repeat go to several partitions
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "turn", "role", "text",
        F.sha2("text", 256).alias("sha"), (ended == "").alias("blank"), (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("cut")))
    same = ["conv", "role", "sha"]
    first = placed.groupBy(*same).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("conv").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s"), "first")
    at = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s"))
    again = placed.select("pos", *same).join(first, at).where("pos > first").select("pos", F.lit(True).alias("again"))
    return materialise(placed.join(again, "pos", "left").select(
        "conv", "part", "pos", "turn", "role", "text",
        F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated").alias("fault")))


def _segments(coded: DataFrame) -> DataFrame:
    """Each segment with its matrix and what it tells of adjacent initials."""

    def work(key, at, codes, info):
        roles = [c & 3 for c in codes]
        legal = {(0, 1), (1, 2), (2, 1)}
        yield [matrix(codes), roles[0], roles[-1], sum(pair not in legal for pair in zip(roles, roles[1:]))]

    return materialise(_by_segment(coded, None, "matrix array<bigint>, head int, tail int, illegal long", work))


def _behind(segments: DataFrame) -> DataFrame:
    """Each segment with the cost vector behind it, whether it is the last, the
    conversation's cost, and the illegal neighbours that end in it."""

    def work(parts):
        v, vectors = list(ENDED), []
        for p in reversed(parts):
            vectors.append(v)
            v = through(p["matrix"], v)
        for k, p in enumerate(parts):
            met = k > 0 and (parts[k - 1]["tail"], p["head"]) not in {(0, 1), (1, 2), (2, 1)}
            yield vectors[-1 - k], k == len(parts) - 1, len(parts), v[0], p["illegal"] + met

    return materialise(_by_conversation(segments, ["matrix", "head", "tail", "illegal"],
                                        "behind array<bigint>, last boolean, parts int, cost long, illegal long", work))


def _starts(coded: DataFrame, behind: DataFrame) -> DataFrame:
    """The state in which each segment starts: 0 for the first; for those of
    conversations in several partitions, by walking each from all four states."""
    several = behind.where("parts > 1")

    def ends(key, at, codes, info):
        yield [[walk(codes, info[:4], state, bool(info[4])) for state in range(4)]]

    def chain(parts):
        state = 0
        for p in parts:
            yield [state]
            state = p["ends"][state]

    told = several.select("conv", "part", F.concat("behind", F.array(F.col("last").cast("long"))).alias("info"))
    walked = _by_segment(coded, told, "ends array<bigint>", ends)
    later = _by_conversation(walked, ["ends"], "start int", chain)
    return behind.where("parts = 1").select("conv", "part", F.lit(0).alias("start")).unionByName(later)


def _coded(turns: DataFrame) -> DataFrame:
    initial = _initial(F.col("role"))
    code = (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
            + F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(0) + F.when(F.col("fault") == "truncated", CUT).otherwise(0))
    return turns.select("conv", "part", "pos", code.cast("int").alias("code"))


def _planned(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits (conv, pos, step, edit, to), segments with cost and illegal pairs)."""
    coded = _coded(turns)
    behind = _behind(_segments(coded))
    starts = materialise(_starts(coded, behind))
    here = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.part") == F.col("b.part"))
    told = behind.alias("a").join(starts.alias("b"), here).select("a.conv", "a.part", F.concat(
        F.col("behind"), F.array(F.col("last").cast("long"), F.col("start").cast("long"))).alias("info"))

    def work(key, at, codes, info):
        out: list[tuple] = []
        step = 0

        def emit(row: int, letter: str, state: int) -> None:
            nonlocal step
            pos = at[min(row, len(at) - 1)]
            step = step + 1 if out and out[-1][0] == pos else 0
            out.append((pos, step, letter, "assistant" if state == 3 else "user"))

        walk(codes, info[:4], info[5], bool(info[4]), emit)
        yield from out

    edits = _by_segment(coded, told, "pos long, step int, edit string, to string", work)
    return edits, behind


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per edit of the cheapest repair, in the order (conversation,
    ``pos``, ``step``): ``edit`` (Keep, Delete, Rerole or Insert by initial),
    ``turn`` of the row it is for (null for inserts), ``role`` and ``text`` after
    it (null for deleted rows).

    Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of an empty user
    or assistant turn 3; a truncated row that stays costs 3 more; blank and
    duplicate rows have to go (see ``faulty_turns``, also for nulls and ties). Of
    equally cheap repairs, the one whose initials are ASCII-least. An empty table
    gives an empty result."""
    turns = faulty_turns(df, conv_col, turn_col, role_col, text_col)
    return _with_texts(_planned(turns)[0], turns).withColumnRenamed("conv", conv_col)


def _with_texts(edits: DataFrame, turns: DataFrame) -> DataFrame:
    both = edits.join(turns.select("pos", "turn", "role", "text"), "pos")
    is_in = lambda *x: F.col("edit").isin(*x)
    return both.select("conv", "pos", "step", "edit", F.when(~is_in("I"), F.col("turn")).alias("turn"),
                       F.when(is_in("K"), F.col("role")).when(is_in("R", "I"), F.col("to")).alias("role"),
                       F.when(is_in("K", "R"), F.col("text")).when(is_in("I"), "").alias("text"))


def repair_summary(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """One row per conversation of ``df``: ``gaps`` (turn numbers missing between
    the least and the greatest), ``blank``, ``duplicate``, ``truncated`` (rows by
    first fault), ``illegal`` (neighbours whose initials are not su, ua or au),
    ``cost``, ``audit`` (the initials of the edits) and ``repaired_sha256`` (of
    the repaired ``role:text``, joined by newlines). Definitions as in ``repair``.

    The digest of one conversation is by nature sequential: its rows are streamed,
    never held together."""
    turns = faulty_turns(df, conv_col, turn_col, role_col, text_col)
    edits, segments = _planned(turns)
    fault = lambda x: F.sum((F.coalesce(F.col("fault"), F.lit("")) == x).cast("long")).alias(x)
    counts = (turns.groupBy("conv", "turn").agg(*[fault(x) for x in ("blank", "duplicate", "truncated")])
              .groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
                                   *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")]))
    costs = segments.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"))
    ordered = _with_texts(edits, turns).select("conv", "pos", "step", "edit", F.concat_ws(":", "role", "text").alias("line"), F.col("role").isNotNull().alias("stays"))
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "pos", "step")
    kind = T.StructType([turns.schema["conv"], *T.StructType.fromDDL("audit string, repaired_sha256 string")])
    schema = to_arrow_schema(kind)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        # the digest and the letters so far of the conversation that is read
        key, digest, letters, empty = (), None, [], True
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "edit", "line", "stays")]
            for conv, edit, line, stays in zip(*columns):
                if key != (conv,):
                    if key:
                        yield *key, "".join(letters), digest.hexdigest()
                    key, digest, letters, empty = (conv,), hashlib.sha256(), [], True
                letters.append(edit)
                if stays:
                    digest.update(line.encode() if empty else b"\n" + line.encode())
                    empty = False
        if key:
            yield *key, "".join(letters), digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(digests(batches), schema)

    told = ordered.mapInArrow(run, kind)
    on = lambda d, c: F.col("conv").eqNullSafe(F.col(c))
    out = (counts.join(costs.withColumnRenamed("conv", "c1"), on(costs, "c1")).join(told.withColumnRenamed("conv", "c2"), on(told, "c2")))
    return out.select(F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of a table (conv_id, turn, role, text) with faults put in by
    crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2
    removes ``.!?`` from it, 3 repeats the row, 4 sets its role to user. Nulls
    count as one space, in the checksum too."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                (F.crc32(key.cast("binary")) % 20).alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair_of_damaged(conversations: DataFrame) -> DataFrame:
    """``repair_summary`` of the damaged table, with a row for every conversation
    of the original: zeros and empty values for those that lost all rows."""
    found = repair_summary(damaged(conversations)).withColumnRenamed("conv_id", "found")
    every = conversations.select("conv_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


REPAIR_SQL = r"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)) AS bytes
        FROM conversations),
    coded AS (
        SELECT *, xor(4294967295::BIGINT, list_reduce(bytes, lambda crc, b: list_reduce(
            list_concat([xor(crc, b)], list_transform(range(8), lambda k: k::BIGINT)), lambda y, k: xor(y >> 1, (y & 1) * 3988292384)))) % 20 AS code FROM keyed),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
               CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM coded, range(2) r(k) WHERE code <> 0 AND (k = 0 OR code = 3)),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
               count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended FROM damaged),
    faults AS (
        SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                       WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS r,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faults GROUP BY conv_id),
    walk AS (  -- for each state the cost of the cheapest edits so far, their letters and the repaired lines
        SELECT conv_id, 0::BIGINT AS i, [{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}, {'c': 1000000000::BIGINT, 'a': '', 'o': []::VARCHAR[]},
               {'c': 1000000000::BIGINT, 'a': '', 'o': []::VARCHAR[]}, {'c': 1000000000::BIGINT, 'a': '', 'o': []::VARCHAR[]}] AS s FROM counts
        UNION ALL
        SELECT conv_id, i, CASE WHEN fault IN ('blank', 'duplicate') THEN [d0, d1, d2, d3] ELSE [
                   d0,
                   list_min([d1] || CASE WHEN r = 's' THEN [{'c': v0.c + t, 'a': v0.a || 'K', 'o': v0.o || [line]}] ELSE [] END),
                   list_min([d2, {'c': v0.c + 3 + t, 'a': v0.a || 'R', 'o': v0.o || ['user:' || text]}, {'c': v1.c + 3 + t, 'a': v1.a || 'R', 'o': v1.o || ['user:' || text]},
                             {'c': v3.c + 3 + t, 'a': v3.a || 'R', 'o': v3.o || ['user:' || text]}]
                            || CASE WHEN r = 'u' THEN [{'c': v0.c + t, 'a': v0.a || 'K', 'o': v0.o || [line]}, {'c': v1.c + t, 'a': v1.a || 'K', 'o': v1.o || [line]},
                                                       {'c': v3.c + t, 'a': v3.a || 'K', 'o': v3.o || [line]}] ELSE [] END),
                   list_min([d3, {'c': v2.c + 3 + t, 'a': v2.a || 'R', 'o': v2.o || ['assistant:' || text]}]
                            || CASE WHEN r = 'a' THEN [{'c': v2.c + t, 'a': v2.a || 'K', 'o': v2.o || [line]}] ELSE [] END)] END
        FROM (SELECT *, {'c': v0.c + 4, 'a': v0.a || 'D', 'o': v0.o} AS d0, {'c': v1.c + 4, 'a': v1.a || 'D', 'o': v1.o} AS d1,
                     {'c': v2.c + 4, 'a': v2.a || 'D', 'o': v2.o} AS d2, {'c': v3.c + 4, 'a': v3.a || 'D', 'o': v3.o} AS d3
              FROM (SELECT *, list_min([s[4], {'c': v2.c + 3, 'a': v2.a || 'I', 'o': v2.o || ['assistant:']}]) AS v3
                    FROM (SELECT f.conv_id, f.i, f.r, f.fault, f.text, f.role || ':' || f.text AS line, CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END AS t,
                                 s, s[1] AS v0, s[2] AS v1,
                                 list_min([s[3]] || list_transform([s[1], s[2], s[4]], lambda x: {'c': x.c + 3, 'a': x.a || 'I', 'o': x.o || ['user:']})) AS v2
                          FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)))),
    ends AS (
        SELECT w.conv_id, list_min([s[1], s[4], {'c': v2.c + 3, 'a': v2.a || 'I', 'o': v2.o || ['assistant:']}]) AS e
        FROM (SELECT *, list_min([s[3]] || list_transform([s[1], s[2], s[4]], lambda x: {'c': x.c + 3, 'a': x.a || 'I', 'o': x.o || ['user:']})) AS v2 FROM walk) w
        JOIN (SELECT conv_id, max(n) AS n FROM placed GROUP BY conv_id) p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.n = w.i)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit,
           sha256(coalesce(array_to_string(e.o, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN ends x ON x.conv_id IS NOT DISTINCT FROM o.conv_id"""
