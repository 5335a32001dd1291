"""Results that lose nothing: probes of earlier losses, brute force, clashing columns."""

import bisect
import math
import random
import time

import numpy as np
import pytest

from panelkit.llm import chat_format as C
from panelkit.llm import decontaminate, html_extract, langid, packing, pii
from panelkit.llm import substring_dedup as S

WORDS = "the and of to in ing er tion ha st en re on at ed es or ti".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(WORDS, k=r.randint(1, 3))) for _ in range(n))


# ---- HTML

def pages(spark, rows):
    df = spark.createDataFrame([(k, f"http://a.b/{k}", h) for k, h in enumerate(rows)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}


@pytest.mark.parametrize("inside", ["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>"])
def test_constant_headings_of_an_article_stay(spark, inside):
    page = "<body><ul><li>Home</li></ul>" + inside.format("<h1>T{0}</h1><h2>Background</h2><p>B{0}</p><h2>Results</h2><p>R{0}</p>") + "<div class=z>All rights</div></body>"
    got = pages(spark, [page.format(k) for k in range(10)])
    assert got == {k: f"T{k} Background B{k} Results R{k}" for k in range(10)}


def test_a_quote_that_several_articles_hold_stays(spark):
    page = "<body><article><h1>T{0}</h1>{1}<p>Body {0}</p></article></body>"
    got = pages(spark, [page.format(k, "<blockquote>To be or not</blockquote>" if k < 3 else "") for k in range(30)])
    assert got == {k: f"T{k} " + "To be or not " * (k < 3) + f"Body {k}" for k in range(30)}


def test_without_a_container_headings_beside_varying_text_stay(spark):
    page = "<body><ul><li>Home</li><li>Away</li></ul><div class=q7><h2>Background</h2><p>B{0}</p><h2>Results</h2><p>R{0}</p></div><div class=z>All rights</div></body>"
    assert pages(spark, [page.format(k) for k in range(8)]) == {k: f"Background B{k} Results R{k}" for k in range(8)}


def test_match_by_sets_equals_match_by_trying():
    r = random.Random(6)
    for _ in range(300):
        made = [html_extract.fold([r.choice(["<p>", "</p>", "#", "<i>"]) for _ in range(r.randint(0, 20))]) for _ in range(4)]
        whole = made[0]
        for m in made[1:]:
            whole = html_extract.align(whole, m)
        wrapper = "\n".join(whole)
        for page in [html_extract.once("\n".join(m)) for m in made] + [[r.choice(["<p>", "#"]) for _ in range(r.randint(0, 9))]]:
            assert html_extract.match_by_sets(html_extract.program(wrapper), page) == html_extract.match(wrapper, page)


def test_long_pages_are_matched_and_wide_cards_folded(monkeypatch):
    monkeypatch.setattr(html_extract, "TRIED_STEPS", 50)
    items = "<p> # </p>".split() * 4000
    assert html_extract.match("(<p> # </p>)+".replace(" ", " "), items) == [0] * 4000
    card = [f"<c{i}>" for i in range(60)] + ["#"]
    assert html_extract.fold(["<ul>"] + card * 3 + ["</ul>"]) == ["<ul>", f"({' '.join(card)})+", "</ul>"]


# ---- preferences

def test_sparse_ids_lose_no_conversation_and_no_turn(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"c{c}t{t}") for c in (2, 4, 6, 8) for t in range(4)]
    rows += [(8, 4, "user", "after the last"), (100, 0, "user", "no answer"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.pair_id: r for r in C.assembled(C.preference_segments(*C.swapped_responses(df))).collect()}
    assert set(got) == {2, 4, 6, 8}
    after = "<|im_start|>user\nafter the last<|im_end|>\n"
    for c, partner in ((2, 4), (4, 6), (6, 8), (8, 2)):
        assert [f"c{c}t{t}" in got[c].prompt for t in range(4)] == [True, True, True, False]
        answer = lambda x, c=c: f"<|im_start|>assistant\nc{x}t3<|im_end|>\n" + after * (c == 8)
        assert (got[c].chosen, got[c].rejected) == (answer(c), answer(partner))
        assert [got[c].chosen[s.start:s.end] for s in got[c].chosen_spans] == [f"c{c}t3<|im_end|>"]


def test_a_single_conversation_is_its_own_partner(spark):
    df = spark.createDataFrame([(5, 0, "user", "q"), (5, 1, "assistant", "a")], "conv_id long, turn int, role string, text string")
    r, = C.assembled(C.preference_segments(*C.swapped_responses(df))).collect()
    assert r.prompt.count("<|im_start|>") == 2 and not r.chosen and not r.rejected
    assert C.preference_segments(*C.swapped_responses(df.limit(0))).count() == 0


# ---- personal data

def test_many_cues_take_linear_time():
    machine = pii.automaton()
    for text in ("account word word " * 100_000, "account-" * 100_000, "iban " + "DE89 " * 200_000, "iban" + " " * 500_000 + "x"):
        start = time.time()
        assert not [s for s in pii.find(text, machine) if s[0] == "account"]
        assert time.time() - start < 8


def test_ibans_in_groups():
    machine = pii.automaton()
    for text, found in [("iban DE89 3704 0044 0532 0130 00, x", "DE89 3704 0044 0532 0130 00"), ("IBAN: GB82WEST12345698765432.", "GB82WEST12345698765432"),
                        ("account de89370400440532013000 and more", "de89370400440532013000"), ("iban DE89 3704 0044 0532 0130 00 ", "DE89 3704 0044 0532 0130 00"),
                        ("iban DE89 3704 0044 0532 0130 01", None), ("iban XXXX", None)]:
        assert [text[a:b] for k, a, b in pii.find(text, machine) if k == "account"] == [found] * bool(found)


# ---- decontamination

def test_a_benchmark_of_several_blocks_finds_the_same(spark, monkeypatch):
    items = [(i, prose(700 + i, 30)) for i in range(9)]
    rows = [(k, prose(800 + k, 40) + " " + (items[k % 9][1] if k % 2 else "")) for k in range(20)] + [(50, None), (50, "")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, item int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.contamination(df, bench).collect()))
    left = sorted(r.doc_id for r in decontaminate.decontaminate(df, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 400)
    assert sorted(map(tuple, decontaminate.contamination(df, bench).collect())) == one and {x[0] for x in one} == {k for k in range(20) if k % 2}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, bench).collect()) == left
    with pytest.raises(ValueError):
        decontaminate.contamination(df, bench.withColumnRenamed("item_id", "doc_id"), item_col="doc_id")


def test_index_of_a_block_is_small():
    r = np.random.default_rng(0)
    text = "".join(chr(97 + c) for c in r.integers(0, 26, 200_000))
    index = decontaminate.build_index([(k, text[k: k + 2000]) for k in range(0, len(text), 2000)])
    held = sum(x.nbytes for x in (index.key, index.window, index.place, index.code, index.start, index.size, index.items, index.edits, index.shared))
    assert held < 70 * len(text)


# ---- packing

def best_fit_decreasing(histogram, size):
    free, n = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = bisect.bisect_left(free, length)
            if k == len(free):
                n, rest = n + 1, size - length
            else:
                rest = free.pop(k) - length
            bisect.insort(free, rest)
    return n


@pytest.mark.parametrize("kind", ["uniform", "lognormal", "middle", "thirds", "short"])
def test_patterns_pack_as_well_as_best_fit_decreasing(kind):
    r = random.Random(1)
    draw = {"uniform": lambda: r.randint(1, 4096), "lognormal": lambda: min(4096, max(1, int(r.lognormvariate(6, 1)))),
            "middle": lambda: r.randint(1200, 2400), "thirds": lambda: r.randint(1300, 1400), "short": lambda: r.randint(1, 300)}[kind]
    histogram = {}
    for _ in range(6000):
        n = draw()
        histogram[n] = histogram.get(n, 0) + 1
    groups = packing.layouts(dict(histogram), 4096)
    seen = {}
    for lengths, count in groups:
        assert sum(lengths) <= 4096
        for n in lengths:
            seen[n] = seen.get(n, 0) + count
    assert seen == histogram
    plain = best_fit_decreasing(histogram, 4096)
    assert sum(c for _, c in groups) <= plain + max(1, plain // 500)


# ---- substring dedup

def test_each_shared_passage_stays_once_and_the_rest_untouched(spark):
    r = random.Random(12)
    blocks = [prose(9000 + k, 90) for k in range(30)]
    rows = []
    for doc in range(40):
        own = [prose(20_000 + 100 * doc + k, 40) for k in range(3)]
        some = [blocks[r.randrange(30)] for _ in range(2)]
        rows.append((doc, " ".join(x for pair in zip(own, [*some, ""]) for x in pair)))
    df = spark.createDataFrame([(i, t, "user's", 1, 2) for i, t in rows], "doc_id long, text string, _id string, _key int, _cut int")
    out = S.substring_dedup(df)
    assert out.columns == df.columns
    got = {x.doc_id: x for x in out.collect()}
    assert {(x._id, x._key, x._cut) for x in got.values()} == {("user's", 1, 2)}
    whole = " ".join(t for _, t in rows)
    for b in blocks:
        middle = b[len(b) // 2 - 60: len(b) // 2 + 60]  # chunk borders lie before and after
        holders = [i for i, t in rows if middle in t]
        assert sum(got[i].text.count(middle) for i in got) == min(1, whole.count(middle))
        if holders:
            assert middle in got[holders[0]].text
    for i, t in rows:
        for k in range(3):
            own = prose(20_000 + 100 * i + k, 40)
            assert own[80:-80] in got[i].text


# ---- language model

def test_ftrl_equals_a_dense_loop():
    r = np.random.default_rng(4)
    n, langs, d = 60, 3, 40
    x, y = [], r.integers(0, langs, n)
    for i in range(n):
        at = np.sort(r.choice(d, 8, replace=False))
        x.append((at.astype(np.uint16), r.random(8).astype(np.float32)))
    got = langid.ftrl(x, y, langs, epochs=2)
    alpha, beta, l1, l2 = 0.5, 1.0, 1e-4, 1e-4
    size = langid.DIM + 1
    z, q = np.zeros((size, langs)), np.zeros((size, langs))
    order = np.random.default_rng(7)
    weight = lambda: np.array([[0.0 if abs(z[j, c]) <= l1 else -(z[j, c] - math.copysign(l1, z[j, c])) / ((beta + math.sqrt(q[j, c])) / alpha + l2)
                                for c in range(langs)] for j in [*range(d), size - 1]])
    rows = [*range(d), size - 1]
    for _ in range(2):
        for i in order.permutation(n):
            dense = np.zeros(d + 1)
            dense[x[i][0]], dense[-1] = x[i][1], 1.0
            w = weight()
            s = dense @ w
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            for place, j in enumerate(rows):
                if dense[place]:
                    for c in range(langs):
                        g = dense[place] * (p[c] - (y[i] == c))
                        z[j, c] += g - (math.sqrt(q[j, c] + g * g) - math.sqrt(q[j, c])) / alpha * w[place, c]
                        q[j, c] += g * g
    assert got[rows] == pytest.approx(weight(), abs=1e-9)
    assert not got[d: size - 1].any()


def test_temperature_is_the_best_of_a_grid():
    r = np.random.default_rng(2)
    scores, y = r.normal(0, 6, (400, 3)), r.integers(0, 3, 400)
    scores[np.arange(400), y] += 4

    def loss(t):
        s = scores / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(400), y]).mean())

    grid = np.exp(np.linspace(math.log(0.05), math.log(20), 4000))
    assert loss(langid.temperature(scores, y)) <= min(map(loss, grid)) + 1e-6


# ---- pipeline edges

def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame(
        [(1, prose(1, 60), "en", "a", 3), (1, prose(1, 60), "en", "a", 3), (2, prose(1, 60), "en", "b", 3), (None, prose(2, 60), "en", "a", 3),
         (3, None, "en", "a", 0), (4, "", None, "a", 0), (5, prose(3, 4000), "en", None, 9), (6, prose(5, 30), None, "a", 3)],
        "doc_id long, text string, lang string, source string, n_chars long").withColumn("id", P.F.lit("x")).withColumn("key", P.F.lit(1))
    for rows in (docs, docs.limit(0)):
        out = P.exact_duplicates(spark, rows, "")
        assert out.columns == docs.columns
        out = P.near_duplicates(spark, P.materialise(out), "")
        assert out.columns == docs.columns
        ids = sorted((r.doc_id for r in out.collect()), key=str)
        assert ids == ([1, 3, 5, 6, None] if rows is docs else [])


def test_pipeline_rows_that_share_an_id_go_together(spark):
    import corpus_pipeline as P

    rows = [(1, prose(1, 60)), (2, prose(1, 60) + " more"), (2, prose(9, 60)), (3, prose(4, 60))]
    docs = spark.createDataFrame([(*x, "en", "a", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, "").collect()) == [1, 3]
