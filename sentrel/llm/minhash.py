"""Near-duplicates by improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles.

A text is the multiset of its five-word shingles, each weighing its count times an inverse
document frequency. Samples that agree with the probability of the weighted Jaccard similarity are
banded; texts that share a band are compared exactly, and links join texts into classes.

* Texts with the same words are one text from the start, so groups of copies cost nothing further.
* Document frequencies are counted over all rows, in a fixed number of hashed counters, so the
  table that tasks need has the same size at any scale.
* In a bucket every text is compared with the bucket's smallest key. Only texts that this leaves
  outside are compared with the others, in blocks and without writing pairs, and only where
  distances to that key, a metric, allow a link. What texts share but do not consist of (a passage,
  a footer) fills no buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.staging import materialise
from sentrel.llm.common import WORD_GAP, slices, whole
from sentrel.operators.clusters import components

SHINGLE, THRESHOLD = 5, 0.8
#: How much more a shingle of one row weighs than one of all rows. A pair of plain similarity s keeps
#: s / (s + (1 - s) (1 + IDF_SPAN)) whatever the counts.
IDF_SPAN = 0.1
#: At similarity 0.8 a pair misses all bands once in 1300 times.
BANDS, ROWS = 10, 3
#: Counters of document frequency, and how many of them travel in one row.
COUNTERS, BLOCK = 1 << 18, 1 << 14
#: Entries of the tables that the random numbers of the sampling are drawn from.
DRAWS, SEED = 1 << 16, 42
#: Texts of a bucket that are compared with as many others in one go.
BLOCK_TEXTS = 1024
#: Bits of the filter that tells which texts a comparison needs.
FILTER_BITS = 1 << 23
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd factors of the hashes.
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: int, name: str) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        known = np.ones(n, np.uint64)
        known[1:] = np.uint64(base)
        np.multiply.accumulate(known, out=known)
        if n <= 1 << 21:
            _powers[name] = known
    return known[:n]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts in order, and where each text's words begin and end.

    A word's hash is a polynomial of its bytes, taken as a difference of running sums.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))  # starts and ends in turn
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(len(data), _BASE, "up"), out=sums[1:])
    back = _power(len(data), pow(_BASE, -1, 1 << 64), "down")
    hashes = _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    lengths = np.array([len(t) + 1 for t in texts])
    bounds = np.searchsorted(start, np.append(0, np.cumsum(lengths)))
    return hashes, bounds


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in rising order, their counts, and each text's bounds.

    A text of fewer words than a shingle is one shingle of all its words; one without words has
    none.
    """
    words, bounds = words_of(texts)
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(texts)), n)
    usable = max(0, len(words) - SHINGLE + 1)
    sums = np.zeros(usable, np.uint64)
    for k in range(SHINGLE):
        sums = sums * np.uint64(_STEP) + words[k : k + usable]
    inside = text[:usable] == text[SHINGLE - 1 :] if usable else np.zeros(0, bool)
    made, owner = _mix(sums[inside]), text[:usable][inside]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        alone = []
        for t in short:
            total = int(n[t])
            for w in words[bounds[t] : bounds[t + 1]].tolist():
                total = (total * _STEP + w) & 0xFFFFFFFFFFFFFFFF
            alone.append(total)
        made = np.concatenate([made, _mix(np.array(alone, np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        made, owner = made[order], owner[order]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        made[a:b].sort()
    first = np.ones(len(made), bool)
    if len(made):
        first[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(made)))
    return made[at], counts, np.searchsorted(owner[at], np.arange(len(texts) + 1))


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many rows a shingle of each counter occurs, and the number of rows.

    Every task adds up its rows and sends its counters that are not zero, in blocks; blocks are
    added by key. The result has ``COUNTERS`` numbers whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(COUNTERS, np.int64), 0
        for batch in slices(batches, "text", 1 << 20):
            hashes, _, _ = shingles([t.encode() for t in batch.column("text").to_pylist()])
            total += np.bincount(_counter(hashes), minlength=COUNTERS)
            rows += batch.num_rows
        places, numbers, blocks = [], [], []
        for block in range(COUNTERS // BLOCK):
            part = total[block * BLOCK : (block + 1) * BLOCK]
            used = np.flatnonzero(part)
            if len(used):
                blocks.append(block)
                places.append(used.astype(np.uint16).tobytes())
                numbers.append(part[used].tobytes())
        if rows:
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([*blocks, -1], pa.int32()), "places": pa.array([*places, b"\0\0"], pa.binary()),
                 "numbers": pa.array([*numbers, np.int64(rows).tobytes()], pa.binary())}
            )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for places, numbers in zip(group["places"], group["numbers"], strict=True):
            total[np.frombuffer(places, np.uint16)] += np.frombuffer(numbers, np.int64)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "numbers": [total.tobytes()]})

    sent = docs.select(whole(text).alias("text")).mapInArrow(count, "block int, places binary, numbers binary")
    total, rows = np.zeros(COUNTERS, np.int64), 0
    for r in sent.groupBy("block").applyInPandas(add, "block int, numbers binary").collect():
        part = np.frombuffer(bytes(r["numbers"]), np.int64)
        if r["block"] < 0:
            rows = int(part[0])
        else:
            total[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = part
    return total, rows


def inverse_frequencies(counts: np.ndarray, rows: int) -> np.ndarray:
    """1 for a shingle in all rows, up to 1 + ``IDF_SPAN`` for one in a single row.

    What many texts share weighs less than what few have, but only so little that the number of a
    text's copies, or counters that shingles share, cannot part texts of plain similarity 0.815.
    """
    rarity = np.log((1 + rows) / (1 + np.minimum(counts, rows))) / np.log(2 + rows)
    return (1 + IDF_SPAN * rarity).astype(np.float32)


def sample(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Band hashes (texts x BANDS) of weighted sets; texts must not be empty.

    The Gamma and uniform variables of a shingle and a sample come from tables, at a place that
    hashes the two. The least of ln a = ln c - r (t - beta + 1), with t = floor(ln w / r + beta),
    is the sample; equal values go to the smaller shingle.
    """
    rng = np.random.default_rng(seed)
    r = rng.gamma(2.0, 1.0, DRAWS).astype(np.float32)
    beta = rng.random(DRAWS).astype(np.float32)
    log_c = np.log(rng.gamma(2.0, 1.0, DRAWS)).astype(np.float32)
    per = 1 / r
    factors = rng.integers(1 << 62, (1 << 63) - 1, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    log_w = np.log(weights).astype(np.float32)
    starts, sizes = bounds[:-1], np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bands = np.zeros((len(sizes), BANDS), np.uint64)
    for k, factor in enumerate(factors):
        at = ((hashes * factor) >> np.uint64(48)).astype(np.int64)
        b = beta[at]
        t = np.floor(log_w * per[at] + b)
        a = log_c[at] - r[at] * (t - b + np.float32(1))
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
        of = owner[least]
        chosen = least[np.append(True, of[1:] != of[:-1])]
        drawn = _mix(hashes[chosen] ^ (t[chosen].astype(np.int64).astype(np.uint64) * np.uint64(_BASE)))
        bands[:, k // ROWS] = bands[:, k // ROWS] * np.uint64(_STEP) + drawn
    return _mix(bands)


def text_key(text: Column) -> Column:
    """MD5 of the words with single spaces between, as bytes: texts with the same words are one."""
    return F.unhex(F.md5(F.btrim(F.regexp_replace(text, WORD_GAP, " "), F.lit(" "))))


def _key(text: bytes) -> bytes:
    return hashlib.md5(b" ".join(text.split()), usedforsecurity=False).digest()


def signatures(docs: DataFrame, idf: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, bands) of every row; a text without words has no bands."""
    kind = docs.select(f"`{key}`").schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in slices(batches, "text", 1 << 20):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            hashes, counts, bounds = shingles(texts)
            full = np.flatnonzero(np.diff(bounds))
            bands: list = [None] * len(texts)
            if len(full):
                made = sample(hashes, counts * weight[_counter(hashes)], bounds[np.append(full, len(texts))])
                for i, row in zip(full.tolist(), made.view(np.int64), strict=True):
                    bands[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(_key, texts)), pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "key", "bands"],
            )

    rows = docs.select(F.col(f"`{key}`").alias("id"), whole(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, key binary, bands array<bigint>")


def _features(docs: DataFrame, text: str, needed: DataFrame) -> DataFrame:
    """(key, shingles, counts) of the texts with the needed keys, one row a key.

    Shingles are the upper halves of their hashes, which still name their counters; counts are
    empty if all are 1.

    Texts are read again and not shuffled: a filter of fixed size lets through what is needed and
    a little more, whatever is too much falls out in the join that follows.
    """
    place = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % FILTER_BITS
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    one = F.expr("shiftleft(1L, cast(p % 64 as int))")
    words = needed.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(one).alias("b"))
    filled = words.toArrow()
    bits[filled.column("w").to_numpy()] = filled.column("b").to_numpy()
    sc = docs.sparkSession.sparkContext
    wanted = sc.broadcast(bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, sent = wanted.value, set()
        for batch in slices(batches, "text", 1 << 20):
            texts = []
            for t in batch.column("text").to_pylist():
                said = t.encode()
                key = _key(said)
                p = int.from_bytes(key[:4], "big") % FILTER_BITS
                if int(mask[p >> 6]) >> (p & 63) & 1 and key not in sent:
                    sent.add(key)
                    texts.append((key, said))
            if texts:
                hashes, counts, bounds = shingles([t for _, t in texts])
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                times = [c if (c := counts[a:b]).max(initial=1) > 1 else c[:0] for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in texts], pa.binary()),
                        pa.array([short[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([c.astype(np.uint32).tobytes() for c in times], pa.binary()),
                    ],
                    ["key", "s", "n"],
                )

    made = docs.select(whole(text).alias("text")).mapInArrow(run, "key binary, s binary, n binary")
    return made.groupBy("key").agg(F.first("s").alias("s"), F.first("n").alias("n"))


def _weighted(idf: np.ndarray, shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(shingles, np.uint32)
    w = idf[s >> np.uint32(32 - 18)]
    return s, w * np.frombuffer(counts, np.uint32) if counts else w


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of sorted shingles."""
    _, i, j = np.intersect1d(a, b, return_indices=True)
    common = float(np.minimum(wa[i], wb[j]).sum(dtype=np.float64))
    total = float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - common
    # Shared shingles count with the larger weight in the union.
    return common / total if total else 1.0


def verified(docs: DataFrame, text: str, idf: np.ndarray, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys with their similarity."""

    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            out = []
            # Values are taken one by one: a list of them all would hold the batch twice.
            for s, n, s2, n2 in zip(*[batch.column(c) for c in ("s", "n", "s2", "n2")], strict=True):
                one = _weighted(weight, s.as_py(), n.as_py())
                out.append(similarity(*one, *_weighted(weight, s2.as_py(), n2.as_py())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"]
            )

    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    rows = materialise(_features(docs, text, needed))
    left = pairs.join(rows.withColumnRenamed("key", "a"), "a")
    both = left.join(rows.select(F.col("key").alias("b"), F.col("s").alias("s2"), F.col("n").alias("n2")), "b")
    return both.select("a", "b", "s", "n", "s2", "n2").mapInArrow(run, "a binary, b binary, similarity double")


def outside_links(
    docs: DataFrame, text: str, idf: np.ndarray, placed: DataFrame, signed: DataFrame
) -> DataFrame | None:
    """Links (a, b) between texts of one bucket and different classes; None if all buckets are of
    one class.

    ``placed`` are the texts of buckets (``band, value, key, d, root, leader_root``; ``d`` is the
    distance to the bucket's leader), ``signed`` their bands. A bucket is cut into blocks; a block
    of texts that are not in the leader's class meets a block of all texts in one task, so tasks
    hold at most two blocks, and only links are written. A pair that shares an earlier band is
    left to that bucket, where it is compared just so.
    """
    outside = F.col("root") != F.col("leader_root")
    counts = placed.groupBy("band", "value").agg(F.count("*").alias("m"), F.count_if(outside).alias("r"))
    open_rows = placed.join(counts.where("r > 0"), ["band", "value"]).withColumn("out", outside)
    open_rows = materialise(open_rows.drop("leader_root"))
    if open_rows.isEmpty():
        return None
    needed = open_rows.select("key").distinct()
    known = materialise(_features(docs, text, needed).join(signed, "key"))
    rows = open_rows.join(known, "key")
    parts = {c: F.ceil(F.col(c) / BLOCK_TEXTS).cast("int") for c in ("r", "m")}
    own = {c: F.pmod(F.xxhash64("key"), n).cast("int") for c, n in parts.items()}
    every = {c: F.explode(F.sequence(F.lit(0), n - 1)) for c, n in parts.items()}
    left = rows.where("out").withColumns({"i": own["r"], "x": F.lit(True)}).withColumn("j", every["m"])
    right = rows.withColumns({"j": own["m"], "x": F.lit(False)}).withColumn("i", every["r"])
    both = left.unionByName(right).drop("r", "m")
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        band = int(group["band"].iloc[0])
        mine, theirs = group[group["x"]], group[~group["x"]]
        found = []
        if len(mine) and len(theirs):
            weight = shared.value
            sets = [_weighted(weight, s, n) for s, n in zip(theirs["s"], theirs["n"], strict=True)]
            totals = np.array([w.sum(dtype=np.float64) for _, w in sets])
            keys, roots = theirs["key"].to_numpy(), theirs["root"].to_numpy()
            d, out = theirs["d"].to_numpy(), theirs["out"].to_numpy()
            bands = np.array(theirs["bands"].tolist(), np.int64)[:, :band]
            for x in mine.itertuples():
                may = (np.abs(d - x.d) <= 1 - THRESHOLD + 1e-6) & (roots != x.root) & ~(out & (keys <= x.key))
                may &= ~(bands == np.array(x.bands[:band], np.int64)).any(1)
                at = np.flatnonzero(may)
                if not len(at):
                    continue
                s, w = _weighted(weight, x.s, x.n)
                total = w.sum(dtype=np.float64)
                most = np.minimum(totals[at], total) / np.maximum(totals[at], total)
                at = at[most >= THRESHOLD - 1e-6]
                if not len(at):
                    continue
                others = np.concatenate([sets[k][0] for k in at])
                place = np.minimum(np.searchsorted(s, others), len(s) - 1)
                least = np.minimum(w[place], np.concatenate([sets[k][1] for k in at]))
                least = np.where(s[place] == others, least, 0).astype(np.float64)
                sizes = np.array([len(sets[k][0]) for k in at])
                common = np.add.reduceat(least, np.cumsum(sizes) - sizes)
                close = common >= THRESHOLD * (totals[at] + total - common)
                found += [(x.key, keys[k]) for k in at[close]]
        return pd.DataFrame(found, columns=["a", "b"])

    links = both.groupBy("band", "value", "i", "j").applyInPandas(compare, "a binary, b binary")
    return materialise(links.distinct())


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, key) of every row, and (key, root) of every key that is linked with another."""
    counts, rows = document_frequencies(docs, text)
    idf = inverse_frequencies(counts, max(rows, 1))
    signed = materialise(signatures(docs, idf, key, text))
    one = signed.where("bands is not null").groupBy("key").agg(F.first("bands").alias("bands"))
    spread = materialise(one.select("key", F.posexplode("bands").alias("band", "value")))
    groups = spread.groupBy("band", "value").agg(F.min("key").alias("leader"), F.count("*").alias("n"))
    buckets = materialise(spread.join(groups.where("n > 1").drop("n"), ["band", "value"]))
    first = buckets.where("key <> leader").select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct()
    compared = materialise(verified(docs, text, idf, first))
    links = compared.where(F.col("similarity") >= THRESHOLD).select("a", "b")
    roots = components(links)
    # Texts that are not in their bucket leader's class: compare them with the bucket's others.
    known = roots.select(F.col("id").alias("key"), "root")
    lead = known.select(F.col("key").alias("leader"), F.col("root").alias("leader_root"))
    far = compared.select(F.col("a").alias("key"), F.col("b").alias("leader"), (1 - F.col("similarity")).alias("d"))
    placed = (
        buckets.where("key <> leader")
        .join(known, "key", "left")
        .join(lead, "leader", "left")
        .join(far, ["key", "leader"])
        .select(
            "band", "value", "key", "d",
            F.coalesce("root", "key").alias("root"),
            F.coalesce("leader_root", "leader").alias("leader_root"),
        )
    )
    more = outside_links(docs, text, idf, materialise(placed), one)
    if more is not None:
        roots = components(links.union(more))
    return signed.select("id", "key"), roots.select(F.col("id").alias("key"), "root")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its key, ``component_id`` (smallest id of its class) and ``kept``.

    A class holds the texts that links of similarity 0.8 or more join, and all copies of them. Null
    and empty texts are copies of one another. A class whose rows have null ids only has a null
    ``component_id``. Rows stay as they are counted, repeated ones too.
    """
    rows, roots = classes(docs, key, text)
    ids = rows.groupBy("key").agg(F.min("id").alias("low")).join(roots, "key", "left")
    ids = ids.withColumn("root", F.coalesce("root", "key"))
    lows = ids.groupBy("root").agg(F.min("low").alias("component_id"))
    by_key = materialise(ids.join(lows, "root").select("key", "component_id"))
    return rows.join(by_key, "key").select(
        F.col("id").alias(key), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every class, with its columns: that of the smallest id (null last), of repeated
    rows of that id one."""
    rows, roots = classes(docs, key, text)
    ids = rows.groupBy("key", "id").agg(F.count("*").alias("n")).join(roots, "key", "left")
    # Null last: a missing id sorts behind every other; equal ids go by their text's key.
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    best = ids.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min_by(F.struct("id", "key", "n"), rank).alias("x"))
    keep = materialise(best.select(F.col("x.id").alias("__id"), F.col("x.key").alias("__k"), F.col("x.n").alias("n")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    marked = docs.select(row, F.col(f"`{key}`").alias("__i"), text_key(whole(text)).alias("__key"))
    kept = marked.join(keep, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left_semi")
    if not keep.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["__i", "__key"])
    return kept.select("__row.*")
