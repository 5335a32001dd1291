"""Conversation repair, byte-level BPE and hard negatives against brute force."""

import base64
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from panelkit.llm import byte_bpe as B
from panelkit.llm import chat_repair as R
from panelkit.llm import hard_negatives as H
from panelkit.llm.queries import tokenizer_path

# ---- repair

ONWARD = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def cheapest(rows):
    """(cost, audit, repaired lines) of the least edits by (cost, audit); rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, s, lines = heapq.heappop(heap)
        if i == len(rows) and s in (0, 3):
            return cost, audit, list(lines)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        named = "assistant" if ONWARD[s] == 3 else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", i, ONWARD[s], (*lines, named + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            extra = 3 if fault == "truncated" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s, lines))
            if fault not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, ONWARD[s], (*lines, f"{named}:{text}")))
                if (to := KEPT.get((s, role[:1]))) is not None:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to, (*lines, f"{role}:{text}")))


def brute_summary(rows):
    """rows (turn, role, text) of one conversation, after damage."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        ended = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not ended else "duplicate" if (role, text) in seen else "" if ended[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest([(r, x, f) for (_, r, x), f in zip(rows, faults)])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(seed, sizes):
    r = random.Random(seed)
    texts = ["Hi.", "Yes!", "cut", "", "  \n", "Why?", "éa.", "tail. \t"]
    rows = []
    for conv, n in enumerate(sizes):
        for _ in range(n):
            rows.append((conv if conv else None, r.choice([None, *range(max(1, n))]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                         r.choice([None, *texts]) if r.random() < 0.3 else f"t{r.randint(0, 400)}."))
    return rows


def test_repair_summary_equals_brute_force(spark):
    rows = conversations(5, [4, 1, 2, 3, 5, 8, 8, 13, 40, 900])
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "conv_id long, turn long, role string, text string, pos int, part string")
    # 8 partitions, so that the long conversation is a run over several of them
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.conv_id: tuple(r[c] for c in SUMMARY) for r in R.repair_summary(df).collect()}
        parts = R.faulty_turns(df).where("conv = 9").select("part").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 1
    assert got == {c: brute_summary([x[1:] for x in rows if x[0] == c]) for c in {x[0] for x in rows}}


def test_repair_gives_the_rows_of_the_repaired_conversation(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "cut"), (1, 2, "user", " ")], "conv_id long, turn long, role string, text string")
    got = [(r.edit, r.turn, r.role, r.text) for r in R.repair(df).orderBy("pos", "step").collect()]
    assert got == [("R", 0, "user", "Hi."), ("K", 1, "assistant", "cut"), ("D", 2, None, None)]  # 3 + 3 + 4
    df = spark.createDataFrame([(1, 0, "assistant", "Hi.")], "conv_id long, turn long, role string, text string")
    got = [(r.edit, r.turn, r.role, r.text) for r in R.repair(df).orderBy("pos", "step").collect()]
    assert got == [("I", None, "user", ""), ("K", 0, "assistant", "Hi.")]


def test_repair_of_damaged_returns_every_conversation(spark):
    rows = [(c, t, r, x) for c, t, r, x in conversations(6, [3] * 60) if r is not None]
    df = spark.createDataFrame([*rows, (7000, 5, "user", "x.")], "conv_id long, turn long, role string, text string")
    after = []
    for c, t, r, x in [*rows, (7000, 5, "user", "x.")]:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = " " if x is None else x
        row = (c, t, "user" if code == 4 else r, "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x)
        after += [row] * (0 if code == 0 else 2 if code == 3 else 1)
    got = {r.conv_id: tuple(r[c] for c in SUMMARY) for r in R.repair_of_damaged(df).collect()}
    assert got == {c: brute_summary([x[1:] for x in after if x[0] == c]) for c in {*(x[0] for x in rows), 7000}}
    assert R.repair_of_damaged(df.limit(0)).count() == 0 and R.repair(df.limit(0)).count() == 0


def test_walk_in_segments_equals_walk_of_the_whole():
    r = random.Random(8)
    for _ in range(300):
        codes = bytes(r.choice([0, 1, 2, 1, 2, 3, 5, 6, 8, 9, 10]) for _ in range(r.randint(0, 60)))
        whole = []
        R.walk(codes, list(R.ENDED), 0, True, lambda row, letter, to: whole.append(letter))
        cut = r.randint(0, len(codes))
        first, second = codes[:cut], codes[cut:]
        middle = R.through(R.matrix(second), list(R.ENDED))
        got, state = [], 0
        for part, v, last in ((first, middle, False), (second, list(R.ENDED), True)):
            state = R.walk(part, v, state, last, lambda row, letter, to: got.append(letter))
        assert got == whole


# ---- byte-level BPE

def test_ids_equal_the_library_and_decode_to_the_text(spark):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    alphabets = ["ab", "aab c", "0123456789 ", "éßñ漢字 a", "=-*#<|>", "\n\t  a\x85\x1c　", "abcdefghijklmnopqrstuvwxyz '"]
    texts = ["".join(r.choice(a) for _ in range(n)) for a in alphabets for n in (1, 2, 3, 17, 90, 700)]
    texts += ["", None, "<|endoftext|>", "a" * 50_000, " " * 30_000, "word " * 40_000, "don't I'll we've", "x"]
    rows = [(i if i % 9 else None, t, 1, "k") for i, t in enumerate(texts)] + [(3, "again", 1, "k")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, id string")
    want = sorted((-1 if i is None else i, library.encode_ordinary(t or "")) for i, t, *_ in rows)
    got = B.encode(df, path)
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.ids) for x in got.collect()) == want
    back = B.decode(got, path)
    assert sorted(bytes(x.decoded) for x in back.collect()) == sorted((t or "").encode() for _, t, *_ in rows)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    digests = sorted((x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in B.round_trip_digests(df, path).collect())
    assert digests == sorted((len(k), digest(np.array(k, "<u4").tobytes()), digest((t or "").encode()))
                             for k, t in ((library.encode_ordinary(t or ""), t) for _, t, *_ in rows))
    assert B.round_trip_digests(df.limit(0), path).count() == 0


def test_leftmost_of_equal_ranks_merges_first():
    ranks = {bytes([c]): c for c in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258}
    assert B.merged(b"aaa", {k: v for k, v in ranks.items() if k != b"aaa"}, 3) == [256, 97]
    assert B.merged(b"aaaab", ranks, 3) == [256, 256, 98]


# ---- hard negatives

def brute_negatives(rows):
    """rows (id, label, vector); the first of those that share an id by (label, vector)."""
    rows = [x for x in rows if x[0] is not None and x[1] is not None and x[2] is not None and None not in x[2]]
    best = {}
    for i, label, v in rows:
        best[i] = min(best.get(i, (label, v)), (label, v))
    ids = sorted(best)
    dim = max((len(v) for _, v in best.values()), default=0)
    x = np.array([best[i][1] + [0] * (dim - len(best[i][1])) for i in ids], dtype=np.int64).reshape(len(ids), dim)
    labels = np.array([best[i][0] for i in ids])
    out = set()
    for a, i in enumerate(ids):
        if i % 100:
            continue
        score = x @ x[a]
        order = sorted((k for k in range(len(ids)) if k != a), key=lambda k: (-score[k], ids[k]))
        for p in [k for k in order if labels[k] == labels[a]][:5]:
            inside = [k for k in order if labels[k] != labels[a] and 80 * score[p] <= 100 * score[k] <= 100 * score[p]]
            out |= {(i, ids[p], n + 1, ids[k], int(score[p]), int(score[k])) for n, k in enumerate(inside[:5])}
    return out


NEGATIVE = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("kind", ["clusters", "hot", "ties"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(H, "CHUNK", 60)  # so that a small table has several leaves and chunks
    r = np.random.default_rng(3)
    n = 1500
    centres = r.integers(-40, 40, (12, 6))
    x = centres[r.integers(0, 12, n)] + r.integers(-6, 7, (n, 6))
    if kind == "hot":
        x[r.random(n) < 0.4] = x[0]  # one vector holds two fifths of all rows
    if kind == "ties":
        x = r.integers(0, 3, (n, 6))
    rows = [(i, int(r.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]
    rows += [rows[100], rows[100], (200, 0, [1, 1]), (None, 1, [1] * 6), (5000, None, [1] * 6), (5100, 1, None), (5200, 1, [1, None]), (5300, 2, [])]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "vec_id long, label int, vector array<long>, part int, key string")
    got = [tuple(x[c] for c in NEGATIVE) for x in H.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows)


def test_tree_eliminates_leaves_but_no_row():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-5, 6, (300, 8)) + c for c in r.integers(-200, 200, (10, 8))]).astype(float)
    r2 = float((x**2).sum(axis=1).max())
    tree = H.build(x, 3000 * 10, 8, r2)
    leaf, seen = H.routed(tree, x)
    for node in tree.nodes:
        node.ranges = next(met for number, met in seen if number == node.number)
    scores = x @ x[:50].T
    low = np.sort(scores, axis=0)[-20]
    found = H.visited(tree, x[:50], low, np.full(50, np.inf))
    pairs = {(k, q) for k, some in found for q in some}
    assert all((leaf[row], q) in pairs for row, q in np.argwhere(scores >= low))
    assert len(pairs) < 0.6 * 50 * len(np.unique(leaf))


def test_mined_leaves_out_what_is_not_finite(spark):
    rows = [(0, [0.5, 0.25], 1), (1, [0.5, 0.2], 1), (2, [0.4, 0.3], 3), (3, [float("nan"), 1.0], 3), (4, [float("inf"), 1.0], 3), (7, [0.45, 0.25], 1), (8, None, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(x[c] for c in NEGATIVE) for x in H.mined(df).collect()]
    # the anchor's label becomes 2: only row 7 (1 -> 2) has it too
    v = {i: np.floor(256 * np.array(e, np.float32).astype(float)).astype(int) for i, e, _ in rows if i in (0, 1, 2, 7)}
    p, scores = int(v[0] @ v[7]), {i: int(v[0] @ v[i]) for i in (1, 2)}
    inside = sorted((i for i in scores if 80 * p <= 100 * scores[i] <= 100 * p), key=lambda i: (-scores[i], i))
    assert got == [(0, 7, k + 1, i, p, scores[i]) for k, i in enumerate(inside)]
    assert H.mined(df.limit(0)).count() == 0 and H.mined(df.where("vec_id > 0")).count() == 0
    with pytest.raises(ValueError):
        H.hard_negatives(spark.createDataFrame([(0, 1, [2**40])], "vec_id long, label int, vector array<long>"), F.lit(True))
