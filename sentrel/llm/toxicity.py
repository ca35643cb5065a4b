"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams and of itself, a window of words the
mean of its words, and a linear softmax over the two labels reads that mean. Embeddings and
softmax are trained jointly in numpy on labels of whole texts: windows are pooled with weights that
sharpen from the mean of all windows towards the strongest one, so a few words count in a long
text too. Misspelt words share n-grams with the words that training saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrel.llm.common import slices, whole

#: n-gram lengths, buckets, dimensions and words in a window.
GRAMS, BUCKETS, DIM, WINDOW = (3, 4, 5, 6), 1 << 20, 8, 12
#: At most so many labelled rows of each label, with at most so many characters, are fitted on.
FIT_ROWS, FIT_CHARS = 2000, 100_000
ROUNDS, RATE, DECAY, SEED = 60, 0.05, 0.02, 42
#: Pooling's final sharpness.
SHARP = 4.0
#: A bucket learns only if its share among texts of the two labels differs by so many deviations.
LEAST_SIGNAL = 4.5
#: Words whose margins a worker remembers; a full memory is emptied.
CACHE_WORDS = 250_000
#: Words whose n-grams are hashed at once.
PART_WORDS = 20_000
#: Start and factor of the n-gram hash (FNV-1a, 64 bits).
_START, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of all n-grams of ``<word>`` and of the words themselves, by word."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    if len(words) > PART_WORDS:
        parts = [(at, features(words[at : at + PART_WORDS])) for at in range(0, len(words), PART_WORDS)]
        return np.concatenate([b for _, (b, _) in parts]), np.concatenate([w + np.int32(at) for at, (_, w) in parts])
    joined = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    state = np.full(len(points), _START)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            usable = len(points) - n + 1
            if usable <= 0:
                break
            state = (state[:usable] ^ points[n - 1 :]) * _PRIME
            if n in GRAMS:
                inside = owner[:usable] == owner[n - 1 :]
                buckets.append((state[inside] ^ (state[inside] >> np.uint64(29))) % np.uint64(BUCKETS))
                owners.append(owner[:usable][inside])
        # The word itself: a sum over its letters and places.
        place = np.arange(len(points), dtype=np.uint64) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.uint64)
        mixed = (points * _PRIME + place + np.uint64(1)) * _START
        mixed ^= mixed >> np.uint64(31)
        sums = np.add.reduceat(mixed * _PRIME, np.cumsum(sizes) - sizes)
        buckets.append((sums ^ (sums >> np.uint64(29))) % np.uint64(BUCKETS))
        owners.append(np.arange(len(words)))
    owners_all = np.concatenate(owners)
    order = np.argsort(owners_all, kind="stable")
    return np.concatenate(buckets).astype(np.int32)[order], owners_all[order].astype(np.int32)


def split(text: str) -> list[str]:
    """Lower-case words of a whole text."""
    return text.lower().split()


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows in the row of all words, and the text of each; texts have words."""
    per = -(-counts // WINDOW)
    text = np.repeat(np.arange(len(counts)), per)
    first = np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(counts) - counts, per)
    return start + (np.arange(len(text)) - first) * WINDOW, text


def train(texts: list[str], labels: list[int], odds: float, seed: int = SEED) -> dict:
    """Fit embeddings and softmax jointly; ``odds`` are the label's odds in the whole population.

    Returns ``margin`` (what each bucket adds to the log-odds) and ``bias``: the softmax of two
    classes only needs their difference, and both layers are linear, so a bucket's embedding times
    the difference of the two output vectors is all that scoring uses. Without texts of both labels
    every score is the prior.
    """
    pairs = [(w, y) for t, y in zip(texts, labels, strict=True) if (w := split(t))]
    y = np.array([b for _, b in pairs], np.float64)
    prior = float(np.log(odds)) if odds > 0 else -20.0
    if not len(y) or y.min() == y.max():
        return {"margin": np.zeros(BUCKETS, np.float32), "bias": prior}
    vocabulary: dict[str, int] = {}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for ws, _ in pairs for w in ws])
    counts = np.array([len(ws) for ws, _ in pairs])
    starts, owner = _windows(counts)
    sizes = np.diff(np.append(starts, len(ids)))
    first = np.searchsorted(owner, np.arange(len(y)))
    bucket, word = features(list(vocabulary))
    share = 1.0 / np.bincount(word)
    # In how many texts of either label a bucket occurs, and how far from chance that is.
    texts = np.repeat(np.arange(len(y)), counts)
    cell = np.unique(texts * len(vocabulary) + ids)
    of_text, of_word = cell // len(vocabulary), cell % len(vocabulary)
    begin = np.searchsorted(word, np.arange(len(vocabulary) + 1))
    seen = np.zeros((2, BUCKETS), np.float32)
    for label in (0, 1):
        for text in np.flatnonzero(y == label):
            mine = of_word[np.searchsorted(of_text, text) : np.searchsorted(of_text, text + 1)]
            seen[label, np.unique(np.concatenate([bucket[begin[w] : begin[w + 1]] for w in mine]))] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()])
    rate = seen.sum(0) / total.sum()
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / total).sum())
    signal = np.abs(seen[1] / total[1] - seen[0] / total[0]) / spread
    often = signal[bucket] >= LEAST_SIGNAL
    word, share = word[often], share[word[often]]
    used, bucket = np.unique(bucket[often], return_inverse=True)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    bias = 0.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    memory = [[np.zeros_like(table), np.zeros_like(table)], [np.zeros_like(out), np.zeros_like(out)], [0.0, 0.0]]

    def moved(value, push, kept, step):  # Adam
        kept[0] = 0.9 * kept[0] + 0.1 * push
        kept[1] = 0.99 * kept[1] + 0.01 * push * push
        return value - RATE * (kept[0] / (1 - 0.9**step)) / (np.sqrt(kept[1] / (1 - 0.99**step)) + 1e-8)

    for step in range(1, ROUNDS + 1):
        sharp = SHARP * (step - 1) / ROUNDS
        ahead = out[1] - out[0]
        each = table @ ahead
        of_word = np.bincount(word, each[bucket] * share, len(vocabulary))
        window = np.add.reduceat(of_word[ids], starts) / sizes * WINDOW
        peak = np.maximum.reduceat(window, first)
        pull = np.exp(sharp * (window - peak[owner]))
        pull /= np.add.reduceat(pull, first)[owner]
        text = np.add.reduceat(pull * window, first)
        p = 1 / (1 + np.exp(-(text + bias)))
        slope = (p - y) * weight / len(y)
        # Pooling weights are held fixed within a step.
        to_window = slope[owner] * pull * WINDOW / sizes
        to_word = np.bincount(ids, np.repeat(to_window, sizes), len(vocabulary))
        to_bucket = np.bincount(bucket, to_word[word] * share, len(used)).astype(np.float32)
        to_out = to_bucket @ table
        table = moved((1 - DECAY) * table, to_bucket[:, None] * ahead, memory[0], step)
        out = moved(out, np.stack([-to_out, to_out]), memory[1], step)
        bias = moved(bias, float(slope.sum()), memory[2], step)
    margin = np.zeros(BUCKETS, np.float32)
    margin[used] = table @ (out[1] - out[0])
    # The fit weighs both labels alike; what is scored is judged on its own odds.
    model = {"margin": margin, "bias": 0.0}
    raw = np.array([_margin(model, [" ".join(w)], {})[0] for w, _ in pairs])
    scale, shift = _calibrate(raw, y, weight * np.where(y == 1, odds, 1.0))
    return {"margin": margin * np.float32(scale), "bias": float(shift)}


def _calibrate(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of the label on the pooled margin, by Newton's steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([(g * raw).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def _margin(model: dict, texts: list[str], known: dict[str, float]) -> np.ndarray:
    """Log-odds of the strongest window of each text, without the bias; 0 where no word is."""
    words = [split(t) for t in texts]
    flat = [w for ws in words for w in ws]
    out = np.zeros(len(texts))
    if not flat:
        return out
    new = [w for w in set(flat) if w not in known]
    if new:
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(set(flat))
        for at in range(0, len(new), PART_WORDS):
            part = new[at : at + PART_WORDS]
            bucket, word = features(part)
            sums = np.bincount(word, model["margin"][bucket], len(part)) / np.bincount(word, minlength=len(part))
            known.update(zip(part, sums.tolist(), strict=True))
    values = np.fromiter(map(known.__getitem__, flat), np.float64, len(flat))
    counts = np.array([len(ws) for ws in words])
    full = np.flatnonzero(counts)
    starts, owner = _windows(counts[full])
    sizes = np.diff(np.append(starts, len(flat)))
    window = np.add.reduceat(values, starts) / sizes * WINDOW
    out[full] = np.maximum.reduceat(window, np.searchsorted(owner, np.arange(len(full))))
    return out


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: CRC-32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> dict:
    """Fit on a bounded, seeded sample of the labelled rows that are not held out.

    The bound is ``FIT_ROWS`` rows of each label, of at most ``FIT_CHARS`` characters each (longer
    labelled texts are left to scoring). Ids are drawn from the labels first, so only the sample's
    texts travel. The labels' odds come from all labelled rows that are not held out.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & ~held_out("id") & F.col("id").isNotNull()
    )
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.lit(SEED), "id")
    drawn = None
    for label in (0, 1):
        one = known.where(F.col("toxic") == label).orderBy(order, "id").limit(FIT_ROWS)
        drawn = one if drawn is None else drawn.union(one)
    rows = (
        docs.select(F.col(f"`{key}`").alias("id"), whole(text).alias("text"))
        .where(F.length("text") <= FIT_CHARS)
        .join(F.broadcast(drawn.distinct()), "id")
        .orderBy(order, "id", "toxic", "text")
        .limit(2 * FIT_ROWS)
        .select("text", "toxic")
        .toArrow()
    )
    odds = counts.get(1, 0) / max(1, counts.get(0, 0))
    return train(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), odds)


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: probability (0 to 1) that a whole text is toxic; null and empty texts get the
    score of the bias alone. Rows and other columns stay; nothing is shuffled."""
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != out], T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        m = shared.value
        for batch in slices(batches, "__text", 1 << 22):
            odds = _margin(m, batch.column("__text").to_pylist(), known) + m["bias"]
            p = pa.array(1 / (1 + np.exp(-np.clip(odds, -40, 40))))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [p], [*kept, out])

    return docs.select(*[F.col(f"`{c}`") for c in kept], whole(text).alias("__text")).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``. Labels, languages, sources and
    ids are no inputs of the score. Null ids count as not held out and have no label."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``, with their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    scored = score(docs.select(row, F.col("text").alias("__t")), fit(docs, labels), "__t", "__score")
    return scored.where(F.col("__score") < threshold).select("__row.*")
