"""Small tests of the training-data operators: brute force and edge cases."""

import hashlib
import html
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest

from panelkit.llm import chat_format as C
from panelkit.llm import components, decontaminate, exact_dedup, html_extract, jaccard_join, langid, licenses, packing, pii
from panelkit.llm import substring_dedup as S
from panelkit.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORDS = "the and of to in ing er tion ha st en re on at ed es or ti".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(WORDS, k=r.randint(1, 3))) for _ in range(n))


LONG = prose(1, 20_000)
ROWS = [(1, "a b c d e f"), (2, "a b c d e f"), (3, ""), (4, None), (5, LONG), (6, LONG + " x"), (None, "a b c d e f"),
        (7, prose(2, 60)), (7, prose(2, 60)), (8, "Ünï 漢字"), (9, "   \n")]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns that clash with private names."""
    rows = [(i, t, "en" if i else None, "x", 1, 2) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, row int, key int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- exact dedup

@pytest.mark.parametrize("keep,best", [("min", min), ("max", max)])
def test_exact_dedup(docs, keep, best):
    got = exact_dedup.exact_dedup(docs, keep=keep).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    expect = sorted((i if i is not None else -1, best(x for x in groups[t or ""] if x is not None), len(groups[t or ""]),
                     hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.text_sha256) for r in got) == expect
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_spreads_a_hot_group_over_partitions(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i % 7}") for i in range(600)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = by_id(exact_dedup.exact_dedup(df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[1].group_size == 400 and got[599].keep_id == 1 and sum(r.kept for r in got.values()) == 8


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


# ---- Jaccard join

def brute_links(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k:k + n]) for k in range(len(w) - n + 1)])
    links = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and
             100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return sets, links, root


def near_copies():
    rows, r = [], random.Random(4)
    for base in range(12):
        words = prose(base, r.choice([5, 8, 14, 30, 90, 300])).split()
        for _ in range(6):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = "edit" + str(r.randint(0, 3))
            rows.append((len(rows), " ".join(w)))
    words = prose(77, 120).split()  # a large group, about whose threshold its members lie
    for _ in range(300):
        w = list(words)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = "edit" + str(r.randint(0, 400))
        rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_components_and_links_equal_brute_force(spark, n, percent):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, links, root = brute_links(rows, n, percent)
    got = by_id(jaccard_join.jaccard_components(df, n=n, percent=percent))
    assert {i: (r.component_id, r.n_shingles) for i, r in got.items()} == {i: (root[i], len(sets[i])) for i in sets}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    expect = {tuple(sorted((first[sets[a]], first[sets[b]]))) for a, b in links if sets[a] != sets[b]}
    assert {tuple(r) for r in jaccard_join.jaccard_links(df, n=n, percent=percent).collect()} == expect


def test_jaccard_edges(docs, empty):
    got = jaccard_join.jaccard_components(docs, n=4, percent=85).collect()
    assert len(got) == len(ROWS)
    rows = {r.doc_id: r for r in got}
    assert [rows[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 9, None)] == [1, 1, 3, 4, 5, 5, 7, 9, 1]
    assert rows[3].n_shingles == 0 and rows[8].n_shingles == 1
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (41, 40)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {got[i] for i in range(42)} == {0} and {got[i] for i in range(100, 130)} == {100}


# ---- substring dedup

def test_substring_repeats_survive_shifts_and_leave_clean_documents(spark):
    passage = prose(50, 60)
    rows = [(1, prose(51, 80) + " " + passage + " " + prose(52, 40)), (2, "x" + prose(53, 33) + " " + passage), (3, prose(54, 200)),
            (4, passage[:40]), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.substring_repeats(df).collect()
    assert {r.doc_id for r in got} == {1, 2} and {r.first_id for r in got} == {1}
    for r in got:
        text = rows[r.doc_id - 1][1].encode()[r.start:r.end].decode()
        assert text in passage and r.end - r.start >= S.RUN and r.dropped == (r.doc_id == 2)
    cut = by_id(S.substring_dedup(df))
    assert cut[1].text == rows[0][1] and len(cut[2].text) < len(rows[1][1]) - S.RUN and cut[5].text is None and cut[3].text == rows[2][1]


def test_a_passage_first_seen_beside_an_older_one_keeps_one_copy(spark):
    header, body = prose(60, 80), prose(61, 120)
    rows = [(1, header + " " + prose(62, 30)), (2, header + " " + body), (3, prose(63, 20) + " " + header + " " + body), (4, body)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = by_id(S.substring_dedup(df))
    for passage in (header, body):
        inner = passage[S.MOST:-S.MOST]  # whole chunks, whatever stands beside
        assert sum(r.text.count(inner) for r in cut.values()) == 1
    assert cut[1].text == rows[0][1] and body[S.MOST:] in cut[2].text and header[S.MOST:-S.MOST] not in cut[2].text
    got = [r for r in S.substring_repeats(df).collect() if r.doc_id == 2]
    assert sorted((r.first_id, r.dropped) for r in got) == [(1, True), (2, False)]


def test_repeats_inside_a_document_and_between_rows_of_an_id(spark):
    once, twin = prose(70, 90), prose(71, 90)
    rows = [(5, prose(72, 20) + " " + once + " " + prose(73, 20) + " " + once + " " + prose(74, 9) + " " + once),
            (7, prose(75, 20) + " " + twin), (7, twin + " " + prose(76, 20)), (8, once), (9, prose(77, 90)), (9, prose(77, 90))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = [(r.doc_id, r.text) for r in S.substring_dedup(df).collect()]
    for passage in (once, twin):
        assert sum(t.count(passage[S.MOST:-S.MOST]) for _, t in cut) == 1
    five = next(t for i, t in cut if i == 5)
    assert rows[0][1].startswith(five[:20 + len(once)]) and once[:-S.MOST] in five
    assert [t for i, t in cut if i == 9] == [rows[-1][1]] * 2  # rows that repeat whole are one document
    got = S.substring_repeats(df).collect()
    assert {r.doc_id for r in got} == {5, 7, 8}
    whole = [r.dropped for r in got if r.doc_id == 5 and r.end - r.start >= S.RUN]  # edges of two copies may agree beyond the first
    assert sorted(whole) == [False, True, True]


def test_kept_passages_have_no_holes():
    ends = np.arange(40, 440, 40)
    # an older chunk of 40 bytes amid chunks first seen here; then 120 older bytes
    assert S.split(np.arange(5), np.array([0, 0, 1, 0, 0], bool), ends) == [(0, 200, 5, 0, 5, False)]
    assert S.split(np.arange(1, 6), np.array([0, 0, 1, 1, 1], bool), ends) == [(40, 120, 2, 0, 2, False), (120, 240, 3, 2, 3, True)]
    assert S.split(np.array([0, 1, 4, 5]), np.ones(4, bool), ends) == []


def test_chunks_do_not_depend_on_the_batch():
    texts = [prose(i, 50) + "é漢" * i for i in range(5)]
    def ends(parts):
        raw = np.frombuffer("".join(parts).encode(), np.uint8)
        off = np.cumsum([0] + [len(p.encode()) for p in parts])
        e, r = S.cuts(raw, off)
        return [[x - off[k] for x, row in zip(e, r) if row == k] for k in range(len(parts))]
    assert ends(texts) == [ends([t])[0] for t in texts]
    for t, e in zip(texts, ends(texts)):
        assert e[-1] == len(t.encode())
        for a, b in zip([0, *e], e):
            t.encode()[a:b].decode()


def test_substring_edges(docs, empty):
    got = S.substring_repeats(docs).collect()
    assert {r.doc_id for r in got} == {5, 6}
    assert S.substring_repeats(empty).count() == 0


# ---- chat formatting

def test_preference_prefix_is_rendered_once(spark):
    schema = "pair_id long, turn int, role string, text string, extra int"
    a = [(1, 0, "user", "q", 0), (1, 1, "assistant", "good <|im_end|>", 0), (2, 0, "user", "x", 0), (3, 0, None, None, 0), (3, 0, None, None, 0)]
    b = [(1, 0, "user", "q", 0), (1, 1, "assistant", "bad", 0), (1, 2, "user", "more", 0), (3, 0, None, None, 0), (None, 0, "user", "n", 0)]
    seg = C.preference_segments(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    got = {r.pair_id: r for r in C.assembled(seg).collect()}
    assert got[1].prompt == "<|im_start|>user\nq<|im_end|>\n"
    assert got[1].chosen == "<|im_start|>assistant\ngood < |im_end|><|im_end|>\n"
    assert [got[1].rejected[s.start:s.end] for s in got[1].rejected_spans] == ["bad<|im_end|>"]
    assert got[2].prompt == "" and got[2].chosen and not got[2].rejected
    assert got[3].prompt == "<|im_start|>unknown\n<|im_end|>\n" and not got[3].chosen
    none = spark.createDataFrame([], schema)
    assert C.preference_segments(none, none).count() == 0


# ---- decontamination

def edits(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, e in enumerate(t, 1):
            cur.append(min(prev[j - 1] + (c != e), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(9)
    items = [(i, prose(200 + i, 25)) for i in range(4)] + [(10, None), (11, ""), (12, "short")]
    index = decontaminate.build_index(items)
    rows = []
    for k in range(24):
        src = decontaminate.fold(items[k % 4][1])
        frag = list(src[r.randint(0, 15):][:95])
        for _ in range(k // 3):
            p = r.randrange(len(frag))
            frag[p:p + 1] = r.choice([[], ["q"], [frag[p], "z"]])
        rows.append((k, prose(300 + k, 6) + "  \n " + "".join(frag).upper() + " " + prose(400 + k, 6)))
    rows += [(100, None), (101, ""), (102, prose(500, 300))]
    expect = set()
    for k, t in rows:
        code = decontaminate.codes(decontaminate.fold(t or "")).tolist()
        for w, p in enumerate(index.windows):
            if edits(p.tolist(), code) <= index.edits[w]:
                expect.add((k, items[index.items[w]][0]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(df, bench)
    assert {(x.doc_id, x.item_id) for x in found.collect()} == expect and expect
    kept = {x.doc_id for x in decontaminate.decontaminate(df, bench).collect()}
    assert kept == {k for k, _ in rows} - {k for k, _ in expect}
    assert decontaminate.contamination(df, bench.limit(0)).count() == 0 and decontaminate.contamination(df.limit(0), bench).count() == 0


# ---- personal data

def brute_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0]), s[2]))


def test_pii_base_equals_expressions():
    r, machine = random.Random(3), pii.automaton()
    for _ in range(20_000):
        t = "".join(r.choices("a@.+-0123456789 (1.1.@bé漢", k=r.randint(0, 50)))
        assert [s for s in pii.find(t, machine) if s[0] in pii.BASE] == brute_pii(t), t


def test_pii_cues_in_any_case_and_mailto():
    machine = pii.automaton()
    for text, kind, found in [
            ("Tax ID 123-45-6789.", "account", "123-45-6789"), ("tAX iD: 123-45-6789", "account", "123-45-6789"),
            ("İ Social security 123-45-6789", "account", "123-45-6789"), ("write MailTo:a.b@c.de, or", "url", "MailTo:a.b@c.de"),
            ("mailto://a.b@c.de", "url", "mailto://a.b@c.de"), ("HTTP://X.Y/z", "url", "HTTP://X.Y/z")]:
        assert [text[a:b] for k, a, b in pii.find(text, machine) if k == kind] == [found]
    assert [s for s in pii.find("xmailto:a mailto: b", machine) if s[0] == "url"] == []
    assert ("email", 7, 13) in pii.find("mailto:a@b.de", machine)


def test_pii_rows(docs, empty, spark):
    assert pii.find_pii(docs).count() == len(ROWS) and pii.find_pii(empty).count() == 0
    df = spark.createDataFrame([(1, "m a.b@c.de +1 (873) 555-9509 see https://x.y/z. IBAN DE89 3704 0044 0532 0130 00!")], "doc_id long, text string")
    r = pii.find_pii(df, redact=True).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 0, 0, 1)
    assert r.redacted == "m <EMAIL> <PHONE> see <URL>. IBAN <ACCOUNT>!"


# ---- language

@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_language_accuracy(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = by_id(langid.language_id(df))
    truth = {r.doc_id: r.lang for r in df.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2} == set(held)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_every_language_is_learned(spark):
    rows = [(10 * k + i, chr(0x4E00 + 7 * k) * 6 + chr(0x4E01 + 7 * k) * 4, f"l{k:03}") for k in range(210) for i in range(1 if k >= 207 else 4)]
    model = langid.train(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert len(model.langs) == 210
    assert {lang for _, _, lang in rows} == {model.predict(t)[0] for _, t, _ in rows}


def test_texts_of_a_language():
    assert langid.texts_each([9999] * 4, 1500) == 1500 and langid.texts_each([9999] * 8, 1500) == 1000
    assert langid.texts_each([10] * 300 + [9999] * 5, 1500) == 1000 and langid.texts_each([50] * 9000, 1500) == langid.LEAST
    assert langid.texts_each([3, 4], 1500) == 1500


def test_language_edges(docs, empty, spark):
    rows = langid.language_id(docs).collect()
    assert len(rows) == len(ROWS) and {r.lang_pred for r in rows if r.doc_id in (3, 4, 9)} == {"und"}
    assert langid.language_id(empty).count() == 0
    nolang = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.language_id(nolang).first().lang_pred == "und"


def test_long_texts_are_counted_in_steps(monkeypatch):
    whole = langid.counts("abc déf 漢 " * 30)
    monkeypatch.setattr(langid, "STEP", 7)
    assert (langid.counts("abc déf 漢 " * 30) == whole).all()


# ---- licences

def test_license_base_equals_brute_force(spark):
    r = random.Random(8)
    parts = ["GNU General Public License", "apache license", "cc-by", "CC BY", "mit license", "the", "é", "license", "mit", ".", "_", "\n", "cc"]
    rows = [(k, "".join(r.choice(parts) + r.choice([" ", "-", ", "]) for _ in range(r.randint(0, 14)))) for k in range(120)]
    got = by_id(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    for k, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(i, lab) for i in range(len(w)) for p, lab in licenses.BASE.items() if w[i:i + len(p.split())] == p.split()]
        x = got[k]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (
            len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({a for _, a in at}))), t


def test_license_rules_suppress_contained_detections(spark, docs, empty):
    assert 200 < len(licenses.rules()) < 999
    text = "Licensed under the GNU Lesser General Public License, version 3. SPDX-License-Identifier: Apache-2.0"
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.labels == "apache,lgpl" and r.score == 1.0 and len(r.detections) == 2 and r.n_base == 0
    assert licenses.scan_licenses(docs).count() == len(ROWS) and licenses.scan_licenses(empty).count() == 0


def test_license_texts_that_do_not_name_themselves(spark):
    rows = [(w, label) for label, found in licenses.SIGNATURES.items() for w, _ in found]
    assert len(rows) == len(set(rows)) >= 70
    texts = [("\n * " + "\n * ".join(" ".join(w.split()[i:i + 7]).capitalize() for i in range(0, len(w.split()), 7)) + ".", label) for w, label in rows]
    texts += [
        ("Permission is hereby granted, free of charge, to any person", "mit"),
        ("// Redistribution and use in source and\n// binary forms, with or without", "bsd"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,", "isc"),
        ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
         "damages arising from the use of this software.", "zlib"),
        ("# SPDX-License-Identifier: PSF-2.0", "python"), ("license = 'MIT-0'", "mit"), ("SPDX-License-Identifier: BSL-1.0", "boost"),
        ("permission is granted, free of charge", ""), ("redistribution and use in source form", "")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = by_id(licenses.scan_licenses(df))
    assert [(t, got[k].labels) for k, (t, _) in enumerate(texts) if label_missing(got[k].labels, texts[k][1])] == []


def label_missing(labels, expect):
    # a longer name inside a signature may add its own label, never take the signature's away
    return expect not in labels.split(",") if expect else bool(labels)


# ---- HTML

def test_wrapper_has_optional_and_repeated_groups():
    a = html_extract.fold("<ul> <li> # </li> <li> # </li> </ul> <p> # </p>".split())
    assert a == ["<ul>", "(<li> # </li>)+", "</ul>", "<p>", "#", "</p>"]
    w = html_extract.align(a, "<ul> <li> # </li> </ul> <hr> <p> # </p>".split())
    assert w == ["<ul>", "(<li> # </li>)+", "</ul>", "(<hr>)?", "<p>", "#", "</p>"]


def test_pages_are_matched_against_the_wrapper():
    w = ["<ul>", "(<li> # </li>)+", "</ul>", "(<hr>)?", "((<b>)? (#)? (</b>)? <p> # </p>)+"]
    page = "<ul> <li> # </li> <li> # </li> </ul> <p> # </p> <b> # </b> <p> # </p>".split()
    assert html_extract.match("\n".join(w), page) == [0, 0, 2, 1, 2]
    assert html_extract.match("\n".join(w), page[:-1]) is None
    assert html_extract.match("((<i>)?)+\n#", ["#"]) == [0]
    r = random.Random(5)
    for _ in range(200):
        made = [html_extract.fold([r.choice(["<p>", "</p>", "#", "<i>"]) for _ in range(r.randint(0, 14))]) for _ in range(4)]
        whole = made[0]
        for m in made[1:]:
            whole = html_extract.align(whole, m)
        for m in made:
            assert html_extract.match("\n".join(whole), html_extract.once("\n".join(m))) is not None


def test_constant_slots_of_a_host_are_template(spark):
    bare = "<body><div class=top>Our shop since 1901</div><ul>{}</ul><div class=x1><h1>{}</h1><p>{}</p></div><div class=x2>All rights <b>kept</b></div></body>"
    links = "<li>Home</li><li>Away</li>"
    rows = [(k, "http://a.b/%d" % k, bare.format(links, "Head %d" % k, "Body %d" % k)) for k in range(5)]
    rows.append((5, "http://a.b/5", "<body><div class=top>Our shop since 1901</div><div class=post><p>Post</p></div><div class=z>Zed</div></body>"))
    # another host: all pages alike, and one that has too few
    rows += [(10 + k, "http://c.d/%d" % k, bare.format(links, "H", "B")) for k in range(4)]
    rows += [(20 + k, "http://e.f/%d" % k, bare.format(links, "H%d" % k, "B")) for k in range(2)]
    got = by_id(html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert [got[k].text for k in range(5)] == ["Head %d Body %d" % (k, k) for k in range(5)]
    assert got[5].text == "Post"
    whole = "Our shop since 1901 Home Away {} B All rights kept"
    assert {got[10 + k].text for k in range(4)} == {whole.format("H")} and got[21].text == whole.format("H1")


@pytest.mark.parametrize("mark", ["content-sidebar-wrap", "layout with-sidebar", "has-sidebar", "no-comments", "sidebar"])
def test_what_the_article_stands_in_is_never_skipped(mark):
    page = (f"<body><nav>N</nav><div class='{mark}'><article><header class='entry-header'><h1>Title</h1></header><p>One</p>"
            f"<div class='{mark} x1'>%s</div><div class='related-posts'>R</div><div class='comments'>C</div></article></div><footer>F</footer></body>")
    inner = "" if mark == "sidebar" else " Two"
    assert html_extract.main_text(page % "Two", "article", None) == "Title One" + inner
    # an article of its own beside keeps what stands in a skipped element out
    both = "<body><article><p>One</p></article><div class='sidebar'><article>Card</article></div></body>"
    assert html_extract.main_text(both, "article", None) == "One"


def test_names_with_a_boilerplate_part_stay_without_a_container():
    page = "<body><div class='layout with-sidebar'><p>One</p></div><div class='sidebar'>S</div><div class='site-footer'>F</div><div class='header'>H</div></body>"
    assert html_extract.main_text(page, "body", None) == "One"


def test_main_text(spark):
    page = ("<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><header>H</header><nav><a>N</a></nav>"
            "<!-- c --><div class='ad'>AD</div><article><h1>Title &amp; more</h1><p>One <b>two</b>\n three<br>four<aside>A</aside>"
            "<div id=\"comments\"><p>C</p></div><form>F</form></article><footer>&copy;</footer></body></html>")
    rows = [(1, "http://a.b/x", page), (2, "http://a.b/y", page[:page.index("</article>")]), (3, None, None), (4, "http://c.d", ""),
            (5, "http://e.f", "<div class=content><p>Text</p></div><div class=sidebar>S</div>"), (6, "http://g.h", "plain < text <unclosed attr='x")]
    got = by_id(html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[1].text == "Title & more One two three four" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[1].text and got[3].text == got[4].text == "" and got[5].text == "Text" and got[6].text == "plain < text"
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_main_text_of_the_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = by_id(html_extract.extract_main_text(df), "page_id")
    for r in df.collect():
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]))
        assert got[r.page_id].text == " ".join(html.unescape(body).split())


# ---- packing

@pytest.mark.parametrize("histogram", [{}, {1: 10_000}, {4096: 5}, {3000: 100, 1096: 99, 1: 3}, {n: n % 13 for n in range(1, 4097, 7)}])
def test_layouts_use_every_piece_once(histogram):
    seen = {}
    groups = packing.layouts(histogram, 4096)
    for lengths, count in groups:
        assert sum(lengths) <= 4096 and count > 0
        for n in lengths:
            seen[n] = seen.get(n, 0) + count
    assert seen == {n: c for n, c in histogram.items() if c}
    total = sum(n * c for n, c in histogram.items())
    assert sum(c for _, c in groups) <= 1.02 * -(-total // 4096) + 2


def test_nnls():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    x = packing.nnls(a, np.array([3.0, 5.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [3, 5])
    assert np.allclose(packing.nnls(a, np.array([-1.0, 2.0])), [0, 2, 0])


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer
    t, ids, r = Tokenizer.from_file(tokenizer_path()), packing.word_ids(tokenizer_path()), random.Random(3)
    alphabet = list("abZ.,'é É İ ßſKΣσ́ \x1c\x85   \t\n0١<|>中😀st|") + ["<|endoftext|>", "'s", "'re", "word"]
    for _ in range(4000):
        x = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        assert np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() == ids.of(x), ascii(x)


def test_packing_is_gapless_and_whole(docs, empty):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_documents(docs, tokenizer_path(), size=512, keep_ids=True).collect()
    expect = sorted((str(i), k // 512, tuple(x[k:k + 512])) for i, text in ROWS
                    for x in [t.encode(text or "", add_special_tokens=False).ids + [1]] for k in range(0, len(x), 512))
    assert sorted((str(r.doc_id), r.piece, tuple(r.ids)) for r in rows) == expect
    places = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) and r.start == 512 * r.piece
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


# ---- pipeline

@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in P.STAGES:
        out = P.materialise(stage(spark, docs, SF))
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
        if name != "packing":
            assert out.columns == columns
            docs = out
        if name == "exact_dedup":
            texts = [r.text for r in out.select("text").collect()]
            assert len(texts) == len(set(texts))
        if name == "jaccard_join":
            _, links, _ = brute_links([(r.doc_id, r.text) for r in out.collect()], 5, 80)
            assert not links
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] == kept[4]
    bench = [decontaminate.fold(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in decontaminate.fold(r.text or "") for r in docs.collect() for b in bench)
