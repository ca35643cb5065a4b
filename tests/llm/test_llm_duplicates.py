"""Near-duplicates of texts and vectors, main text, and the pipeline, against plain loops."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest

from sentrel.llm import embeddings, html, minhash
from sentrel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _classes(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _weighted(texts, least=0.8):
    """Linked pairs of ids by the definition, over exact document frequencies."""
    sets, df = {}, Counter()
    for i, text in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
        df.update(sets[i].keys())
    n = len(texts)
    idf = {s: 1 + 0.1 * math.log((1 + n) / (1 + c)) / math.log(2 + n) for s, c in df.items()}
    total = {i: sum(c * idf[s] for s, c in g.items()) for i, g in sets.items()}
    have = defaultdict(list)
    for i, g in sets.items():
        for s in g or [()]:
            have[s].append(i)
    links = set()
    for a, b in {p for owners in have.values() for p in combinations(owners, 2)}:
        common = sum(min(c, sets[b][s]) * idf[s] for s, c in sets[a].items() if s in sets[b])
        union = total[a] + total[b] - common
        if not union or common / union >= least:
            links.add((a, b))
    return links


def test_minhash_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    want = _classes(_weighted(texts), texts)
    rows = QUERIES["op3_minhash_near_duplicates"](spark, sf).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.kept == (r.doc_id == want[r.doc_id]) for r in rows)


def test_minhash_chains_groups_and_edges(spark, docs_of):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    base = [word() for _ in range(300)]
    rows = [(i, " ".join(base[:i] + [word()] + base[i + 1 :])) for i in range(0, 300, 7)]
    # A chain: each differs from the next by a little, the ends by much.
    step, chain = 12, [word() for _ in range(420)]
    rows += [(1000 + k, " ".join(chain[k * step : k * step + 300])) for k in range(10)]
    shared = " ".join(word() for _ in range(60))
    rows += [(2000 + k, shared + " " + " ".join(word() for _ in range(200))) for k in range(40)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "one  two\n"), (3005, "one two three")]
    rows += [(3006, "lone " * 9000), (1, rows[0][1])]
    texts = {i: t for i, t in rows}
    want = _classes(_weighted(texts), texts)
    got = {r.doc_id: r.component_id for r in minhash.report(docs_of(rows, ["key", "bands", "root"])).collect()}
    assert got == want
    assert len({got[1000 + k] for k in range(10)}) == 1 and len({got[2000 + k] for k in range(40)}) == 40
    assert got[3001] == got[3002] == 3000 and got[3004] == 3003


def test_minhash_around_the_threshold(spark, docs_of):
    """Pairs of weighted similarity 0.77 to 0.83, alone and among copies of one side."""
    rng = random.Random(11)
    texts = {}
    for p in range(60):
        words = [f"p{p}w{k}" for k in range(rng.randrange(200, 400))]
        shingles, aim = len(words) - 4, rng.uniform(0.77, 0.83)
        changed = list(words)
        for k in range(round(shingles * (1 - aim) / (1 + aim) / 5)):
            changed[4 + 5 * k] = f"p{p}c{k}"
        texts[100 * p], texts[100 * p + 1] = " ".join(words), " ".join(changed)
        texts |= {100 * p + 2 + k: texts[100 * p] for k in range(rng.choice([0, 0, 5]))}
    # Hashed counters move a similarity by less than 0.002.
    near = {a // 100 for a, _ in _weighted(texts, 0.798) - _weighted(texts, 0.802)}
    texts = {i: t for i, t in texts.items() if i // 100 not in near}
    want = _classes(_weighted(texts), texts)
    linked = [want[i] != i for i in texts if i % 100 == 1]
    assert 10 < sum(linked) < len(linked) - 10
    got = {r.doc_id: r.component_id for r in minhash.report(docs_of(list(texts.items()))).collect()}
    assert got == want


def test_size_of_a_group_does_not_undo_its_links(spark, docs_of):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(305)]
    rows = []
    for i in range(20):
        words = list(base)
        for k in (i, 20 + i, 40 + i):
            words[4 + 5 * k] = f"c{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.report(docs_of(rows)).collect()}
    assert got == {i: 0 if i < 20 else i for i, _ in rows}


def test_deduplicate_keeps_one_of_each(spark, docs_of):
    rows = [(5, "a b c d e f g"), (3, "a b c d  e f g"), (None, "a b c d e f g"), (7, "other words altogether here now")]
    rows += [(7, "other words altogether here now")] * 2 + [(None, "third text of its own"), (8, None), (9, "")]
    docs = docs_of(rows, ["key", "root", "__row", "id"])
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "None"]
    assert minhash.deduplicate(docs.limit(0)).count() == 0
    assert minhash.report(docs.limit(0)).count() == 0


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(7)
    common = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    agree = total = 0
    for seed in range(40):
        mine = np.sort(np.concatenate([common, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
        other = np.sort(np.concatenate([common, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
        both = np.concatenate([mine, other])
        weights = np.where(np.isin(both, common), 1.25, 2.0).astype(np.float32)
        bands = minhash.sample(both, weights, np.array([0, 450, 900]), seed)
        agree += (bands[0] == bands[1]).sum()
        total += minhash.BANDS
    similarity = 400 * 1.25 / (400 * 1.25 + 100 * 2.0)
    assert abs(agree / total - similarity**minhash.ROWS) < 0.1


def _by_cosine(rows):
    good = {}
    for i, (key, v) in enumerate(rows):
        x = np.array(v if v and all(c is not None for c in v) else [np.nan], float)
        if np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            good[i] = x / np.linalg.norm(x)
    links = [(a, b) for a, b in combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    degree = Counter(i for p in links for i in p)
    root = _classes(links, range(len(rows)))
    low = {}
    for i, (key, _) in enumerate(rows):
        low[root[i]] = min(low.get(root[i], key), key)
    return sorted((key, degree[i], low[root[i]], key == low[root[i]]) for i, (key, _) in enumerate(rows))


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    for c in range(6):
        centre = rng.normal(size=16)
        rows += [(1000 + c * 100 + k, (centre + 0.12 * rng.normal(size=16)).tolist()) for k in range(30)]
    rows += [(5000 + k, rows[3][1]) for k in range(40)] + [(6000, [x * 1e-200 for x in rows[4][1]])]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 16), (7003, [float("nan")] * 16), (7004, [None] * 16)]
    rows += [(7005, [float("inf")] + [1.0] * 15), (7006, [1.0, 2.0]), (7007, [2.0, 4.0]), (7008, rows[5][1]), (7008, rows[5][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = sorted(tuple(r) for r in embeddings.report(df).collect())
    assert got == _by_cosine(rows)
    assert embeddings.report(df.limit(0)).count() == 0


def test_forest_finds_pairs_across_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 64)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 32))
    x = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape)])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {tuple(p) for p in np.stack(embeddings.near(unit), 1).tolist()}
    found = set()
    for seed in range(embeddings.TREES):
        found |= {tuple(p) for p in embeddings.pairs_within(np.arange(len(x)), unit, seed).tolist()}
    assert found <= want and len(found) >= 0.97 * len(want)


def test_every_link_of_large_groups_counts(spark):
    rng = np.random.default_rng(11)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    tight = centre + 0.03 * rng.normal(size=(5000, 64))
    loose = -centre + 0.045 * rng.normal(size=(1500, 64))
    other = rng.normal(size=(3000, 64))
    x = np.concatenate([tight, loose, other, other[:500] + 0.2 * rng.normal(size=(500, 64))])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    want = near.sum(1) - 1
    assert want[:5000].min() > 4000 and 50 < np.median(want[5000:6500]) < 1450
    got = {r["vec_id"]: r for r in embeddings.report(df).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert found[:5000].sum() == want[:5000].sum()
    assert (found <= want).all() and (found[5000:] == want[5000:]).mean() > 0.99
    assert {got[i]["component_id"] for i in range(5000)} == {0}


def test_vector_query_on_the_given_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    got = sorted(tuple(r) for r in QUERIES["op8_embedding_near_duplicates"](spark, SF).collect())
    assert got == _by_cosine(rows)


def _page(host, body, i):
    nav = "".join(f'<li><a href="/{w}">{w}</a>' for w in ("home", f"n{i}", "about"))
    return (
        f"<html><head><title>T{i}</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><ul class='menu'>{nav}</ul>"
        f"<div class=sidebar><p>Side {i}</p></div><div id='c'>{body}</div><div class='comments'><p>Reader {i} says</p></div>"
        f"<form><p>Mail</p></form><div class='cookie-notice'>We use cookies</div><script>var a='</p>';</script><footer>&copy; {host}</footer></body></html>"
    )


def test_main_text_without_article_elements(spark):
    rows, want = [], {}
    for i in range(12):
        paras = [f"Paragraph {k} of   page {i} with &amp; some words &#233;." for k in range(1 + i % 4)]
        body = f"<h2>Head {i}</h2>" + "".join(f"<p>{p}" for p in paras) + ("<ul><li>one</li><li>two</li></ul>" if i % 3 == 0 else "")
        rows.append((i, f"http://h.org/{i}", _page("h.org", body, i)))
        lines = [f"Head {i}", *[re.sub(r"\s+", " ", p).replace("&amp;", "&").replace("&#233;", "é") for p in paras]]
        want[i] = "\n".join(lines + (["one", "two"] if i % 3 == 0 else []))
    rows += [(90, None, None), (91, "http://e.org/", ""), (92, "x", "<p>cut <b>off"), (93, "http://one.org/", "<article><p>a<br>b</p><aside>c</aside></article>")]
    rows += [(93, "http://one.org/", "<article><p>a<br>b</p><aside>c</aside></article>")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, wrapper string")
    got = html.main_text(df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {i: text[i] for i in want} == want
    assert text[90] == text[91] == "" and text[92] == "cut off" and text[93] == "a b"
    assert html.main_text(df.limit(0)).count() == 0


def test_wrapper_expression():
    pages = ["<div><p>x</p></div>", "<div><p>y</p><p>z</p></div>", "<div><h2>t</h2><p>w</p></div>"]
    wrapper = None
    for p in pages:
        tree = html.fold(html.parse(p))
        wrapper = html.align(wrapper, tree) if wrapper else tree
    assert html.expression(wrapper) == '<div>(<h2>"t"</h2>)?(<p>#</p>)+</div>'


def test_main_text_of_a_host_with_mixed_templates(spark):
    frames = ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<div id=q>{}</div>", "<div id=z>{}</div>", "{}"]
    bodies = [f.format(f"<p>Text number {i} of this page.</p>") for i in range(40) for f in frames]
    urls = ["http://mixed.example/x", None]
    rows = [(i * 2 + k, u, _page("mixed", b, i)) for i, b in enumerate(bodies) for k, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert got == {i: f"Text number {i // 2 // len(frames)} of this page." for i, _, _ in rows}


def test_main_text_leaves_out_what_all_pages_say(spark):
    notice = "<p>Read our terms of use before you write to us.</p>" + f"<p>{'long ' * 60}</p>"
    said = [" ".join(f"w{i}x{k}" for k in range(120)) for i in range(20)]
    rows = [(i, "http://n.example/x", _page("n", f"<article><p>{t}</p>{notice}<p>End {i}</p></article>", i)) for i, t in enumerate(said)]
    rows += [(100 + i, "http://copies.example/", _page("n", "<article><p>The same.</p></article>", 0)) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert got == {i: f"{t}\nEnd {i}" for i, t in enumerate(said)} | {100 + i: "The same." for i in range(20)}


def test_main_text_query_gives_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    squeeze = lambda t: "\n".join(x for x in (re.sub(r"\s+", " ", y).strip() for y in t.split("\n")) if x)
    known = {squeeze(t) for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()}
    rows = QUERIES["op9_main_text"](spark, sf).collect()
    assert len(rows) == 250
    # Below the heading, each page shows one document.
    assert all(r.text.split("\n", 1)[1] in known for r in rows)


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from sentrel.functions.staging import materialise
    from sentrel.llm.common import table

    docs = table(spark, SF, "documents")
    made = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
        made.append((name, docs))
    return made


def test_pipeline_stages_take_effect(stages):
    tables = dict(stages)
    names = [n for n, _ in stages]
    assert names[1:] == ["quality rules", "toxicity", "near-duplicates", "source mixing", "byte-level encoding"]
    assert all(t.columns == stages[0][1].columns for _, t in stages[:-1])
    ids = {n: Counter(r.doc_id for r in t.select("doc_id").collect()) for n, t in stages}
    assert all(ids[b] <= ids[a] for a, b in zip(names[:3], names[1:4], strict=True))
    texts = {r.doc_id: r.text for r in tables["toxicity"].collect()}
    classes = set(_classes(_weighted(texts), texts).values())
    assert set(ids["near-duplicates"]) == classes
    assert set(ids["source mixing"]) <= set(ids["near-duplicates"]) and max(ids["source mixing"].values()) <= 3
    last = tables["byte-level encoding"].collect()
    assert Counter(r.doc_id for r in last) == ids["source mixing"] and all(r.ok for r in last)


def test_pipeline_run_agrees(spark, stages):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[-1][1].columns
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[-1][1].collect()))
