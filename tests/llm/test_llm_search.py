"""Periodic runs, licence templates and hard negatives against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrel.llm import licenses, negatives, runs
from sentrel.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(words, least=12):
    """All runs (start, end, period) by trying every period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def found_in(texts, least=12):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(int)
    words = np.array([w for t in texts for w in t], np.int64)
    out = [[] for _ in texts]
    for text, *run in zip(*(c.tolist() for c in runs.find_runs(words, bounds, least))):
        out[text].append(tuple(run))
    return out


def odd_text(rnd):
    n = rnd.choice([0, 1, 11, 12, 13, 40, 150])
    words = [rnd.randrange(rnd.choice([1, 2, 3, 30])) for _ in range(n)]
    if n and rnd.random() < 0.6:
        a = rnd.randrange(n)
        p = 1 + (n - a) // rnd.randint(1, 9)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if rnd.random() < 0.4:
            words[rnd.randrange(n)] = 99
    return words


@pytest.mark.parametrize("candidates", [1 << 20, 5])
def test_runs_equal_brute_force(monkeypatch, candidates):
    monkeypatch.setattr(runs, "CANDIDATES", candidates)
    rnd = random.Random(candidates)
    for _ in range(300):
        texts = [odd_text(rnd) for _ in range(rnd.randint(0, 5))]
        assert found_in(texts) == [runs_of(t) for t in texts]


def test_runs_of_fibonacci_words_and_of_one_word():
    a, b = [1], [1, 2]
    while len(b) < 900:
        a, b = b, b + a
    assert found_in([b]) == [runs_of(b)]
    assert found_in([[7] * 50_000]) == [[(0, 50_000, 1)]]
    assert found_in([[7] * 12, [7] * 11, [7] * 30], 20) == [[], [], [(0, 30, 1)]]


def test_no_pair_comes_twice_in_what_is_left():
    rnd = random.Random(3)
    words = np.array([rnd.randrange(40) for _ in range(3000)])
    words = np.unique(words, return_inverse=True)[1]
    grammar = runs.compress(words, np.array([0, len(words)]))

    def expand(symbol):
        if symbol < grammar.terminals:
            return [symbol]
        i = symbol - grammar.terminals
        return expand(grammar.left[i]) + expand(grammar.right[i])

    assert expand(grammar.roots[0]) == words.tolist()
    # A rule's words stand where it first comes, and every rule but those of the tree on top is used twice.
    for i, (size, first) in enumerate(zip(grammar.size, grammar.first)):
        assert expand(grammar.terminals + i) == words[first : first + size].tolist()


def digests(doc_id, text):
    words = WORDS.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_of(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    line = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    size = best and best[1] - best[0]
    return (
        doc_id,
        len(found),
        *((best[0], size, best[2], 1000 * size // best[2]) if best else (None,) * 4),
        hashlib.sha256(line.encode()).hexdigest(),
        hashlib.sha256(left.encode()).hexdigest(),
    )


def test_run_query_on_odd_rows(spark, docs_of):
    texts = ["", None, " \t\n", "a " * 40, "x y z " * 9 + "x", "é　ß " * 20, "one\x0btwo\x1cthree " * 14]
    rows = [(i, t) for i, t in enumerate(texts * 12)] + [(None, "a " * 12), (3, "a " * 40), (3, "a " * 40)]
    docs = docs_of(rows, ["n_runs", "runs", "w", "g"])
    got = sorted((tuple(r) for r in runs.report(docs).collect()), key=repr)
    assert got == sorted((digests(*r) for r in rows), key=repr)
    assert runs.report(docs_of([])).count() == 0


def test_run_query_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = {r.doc_id: r.text for r in docs.where("length(coalesce(text, '')) < 9000").collect()}
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == docs.count()
    assert {d: got[d] for d in short} == {d: digests(d, t) for d, t in short.items()}
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_collapsed_text_keeps_one_period(spark, docs_of):
    (row,) = runs.detect(docs_of([(1, "start " + "a b c " * 8 + "end")])).collect()
    assert row.collapsed == "start a b c end" and row.n_words == 26
    assert [tuple(r) for r in row.runs] == [(1, 24, 3)]


def accepts(parts, words, at, end):
    """Whether a template takes exactly ``words[at:end]``, by trying everything."""
    if not parts:
        return at == end
    first, rest = parts[0], parts[1:]
    if isinstance(first, licenses.Word):
        return at < end and words[at] == first.text and accepts(rest, words, at + 1, end)
    if isinstance(first, licenses.Optional):
        return accepts(first.parts + rest, words, at, end) or accepts(rest, words, at, end)
    for k in range(first.least, min(first.most, end - at) + 1):
        fits = first.match is None or all(re.fullmatch(first.match.encode(), w) for w in words[at : at + k])
        if fits and accepts(rest, words, at + k, end):
            return True
    return False


def places_of(templates, words):
    out = []
    for start in range(len(words)):
        for t, markup in enumerate(templates):
            parts = licenses.parse(markup)
            ends = [e for e in range(start + 1, min(len(words), start + 40) + 1) if accepts(parts, words, start, e)]
            out += [(start, max(ends), t)] if ends else []
    return out


def test_automaton_equals_trying_everything(monkeypatch):
    templates = [
        "a b",
        "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> a",
        "b <<var;words=0-3>> a",
        'a <<var;words=1-2;match="[0-9]+">> <<beginOptional>>a<<endOptional>>',
        "c <<var;words=2-4>>",
        "a <<beginOptional>>a<<endOptional>> <<beginOptional>>a<<endOptional>>",
    ]
    machine, rnd = licenses.Automaton(templates), random.Random(4)
    for i in range(400):
        words = [rnd.choice([b"a", b"b", b"c", b"1", b"22", b"x"]) for _ in range(rnd.randint(0, 14))]
        if i == 200:
            monkeypatch.setattr(licenses, "STATES", 3)
            monkeypatch.setattr(licenses, "SYMBOLS", 1)
        assert sorted(machine.find(words)) == sorted(places_of(templates, words))


@pytest.mark.parametrize("markup", ["<<var;words=1-2>> a", "a <<beginOptional>> b", "a <<endOptional>>", "", "a <<var;words=3-2>>"])
def test_broken_markup_is_refused(markup):
    with pytest.raises(ValueError):
        licenses.parse(markup)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def labels_of(spark, docs_of, text):
    (row,) = licenses.report(docs_of([(1, text)])).collect()
    return row.labels


def test_mandatory_wording_must_match_exactly(spark, docs_of):
    assert labels_of(spark, docs_of, MIT) == "mit"
    assert labels_of(spark, docs_of, MIT.replace("Software", "Work").upper()) == "mit"
    assert labels_of(spark, docs_of, MIT.replace("publish, ", "")) == ""
    assert labels_of(spark, docs_of, MIT.replace("free of charge", "for a fee")) == ""
    assert labels_of(spark, docs_of, "This is under the GNU General Public License, version 3.") == "gpl-3"
    assert labels_of(spark, docs_of, "CC BY 4.0, CC-BY-SA or CC BY-NC") == "cc-by,cc-by-nc,cc-by-sa"


def test_license_rows_of_odd_texts(spark, docs_of):
    texts = [
        None,
        "",
        "under the MIT license",
        "Under-the\x00MIT_license apache license\n\nversion 2.0 cc by nc cc by nc",
        "sunder the mit license",
        "ünder the mit licenseé",
        "under the MİT license",  # the dotted capital is no A to Z
        "cc by nc " * 20_000,
    ]
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(None, texts[2]), (2, texts[2])], ["labels", "places"])
    got = sorted(licenses.report(docs).collect(), key=repr)
    assert len(got) == 10
    for row in got:
        text = texts[row.doc_id if row.doc_id is not None else 2] or ""
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = LETTERS.findall(small.encode())
        starts = {
            label: [i for i in range(len(words)) if words[i : i + n] == phrase]
            for label, phrase, n in [(a, b.encode().split(), len(b.split())) for a, b in licenses.PHRASES]
        }
        every = sorted(i for s in starts.values() for i in s)
        base = ",".join(sorted(label for label, s in starts.items() if s))
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(every), base)
        assert (row.first_word, row.last_word) == ((every[0], every[-1]) if every else (None, None))
        assert set(base.split(",")) <= set(row.labels.split(",")) and 0 <= row.score <= 1
    assert licenses.report(docs_of([])).count() == 0


VEC = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def mined(rows, is_anchor, k=5, low=80, high=100):
    rows = {i: (label, v) for i, label, v in rows}
    out = set()
    for a in rows:
        if not is_anchor(a):
            continue
        scores = sorted((-int(np.dot(rows[a][1], rows[b][1])), b) for b in rows if b != a)
        same = [(b, -s) for s, b in scores if rows[b][0] == rows[a][0]][:k]
        for p, top in same:
            fits = [(b, -s) for s, b in scores if rows[b][0] != rows[a][0] and low * top <= -100 * s <= high * top]
            out |= {(a, p, rank + 1, b, top, s) for rank, (b, s) in enumerate(fits[:k])}
    return out


@pytest.mark.parametrize("most", [256, 1 << 24])
def test_packed_products_are_exact(most):
    rng = np.random.default_rng(most)
    x = rng.integers(-most, most + 1, (300, 64 if most == 256 else 8))
    x[0], x[1] = most, -most
    packed = negatives.Packed(x, most)
    for anchor in (x[0], x[1], x[2], np.zeros(x.shape[1], np.int64)):
        assert packed.scores(anchor).tolist() == (x @ anchor).tolist()


def test_hard_negatives_equal_brute_force_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (400, 6)) + np.array([2, 0, 0, 0, 0, 0])
    x[100:180] = x[100]  # ties: many copies
    rows = [(i, int(rng.integers(0, 4)) if i % 3 else 0, x[i].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, v array<int>")
    for block, anchors in ((4096, 4096), (37, 5)):
        monkeypatch.setattr(negatives, "BLOCK", block)
        monkeypatch.setattr(negatives, "ANCHORS", anchors)
        got = {tuple(r) for r in negatives.mine(df, F.col("id") % 10 == 0).collect()}
        assert got == mined(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, i / 10], i % 2) for i in range(0, 30)] + [(100, [1.0, 0.5], 1), (200, [1.0, 0.5], 0)]
    odd = [
        (300, None, 1),
        (400, [1.0, None], 1),
        (500, [nan, 1.0], 1),
        (600, [1.0, inf], 1),
        (700, [1.0, 2.0], None),
        (None, [1.0, 2.0], 1),
        (800, [], 1),
        (900, [3e38, 1.0], 1),
        (1000, [1.0, 2.0, 3.0], 1),
        (1001, [1.0, 2.0, 3.0], 1),
        (1002, [1.0, 2.0, 3.0], 0),
        (100, [1.0, 0.5], 1),
    ]
    df = spark.createDataFrame(good + odd, VEC).withColumn("id", F.lit(0)).withColumn("score", F.lit("x"))
    three = [r for r in odd if r[1] and len(r[1]) == 3]
    want = set()
    for part in (good, three):
        rows = [
            (i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * np.float32(c))) for c in v])
            for i, v, label in part
        ]
        want |= mined(rows, lambda i: i % 100 == 0)
    assert {tuple(r) for r in negatives.report(df).collect()} == want
    assert any(r[0] == 1000 for r in want) or len(want) > 10
    assert negatives.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_license_scan", "op13_hard_negatives"])
def test_search_queries_equal_sql(spark, name):
    from oracle import compare

    assert compare(spark, name, QUERIES[name], ORACLES[name], SF)[2] == "ok"
