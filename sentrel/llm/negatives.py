"""Hard negatives by exact inner products of packed integer vectors.

A block of candidates is packed by Kronecker substitution: component j of all of them, made
non-negative by a bias, becomes one wide integer with a field for each candidate. An anchor's
component j multiplies that integer once, the sum over j holds all inner products in its fields,
and the biases are taken off again after unpacking. Fields are wide enough that none carries over.

Anchors and candidates meet in blocks of bounded size, so every anchor sees every row and no group
grows with the data or with a label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions.staging import materialise

#: Rows of a block of candidates, and of anchors.
BLOCK, ANCHORS = 4096, 4096
#: Positives of an anchor, negatives of a positive, and the percentages of its score they lie between.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Most that dimension times the square of the largest component may come to: a hundred times an
#: inner product of two such vectors still fits 64 bits.
MOST = 1 << 55

_FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint"
_MINED = f"{_FOUND}, negative_id bigint, negative_score bigint"


class Packed:
    """Candidates' components in the fields of one wide integer for each dimension.

    ``most`` bounds the size of every component, also of the anchors'.
    """

    def __init__(self, x: np.ndarray, most: int):
        self.n, self.d = x.shape
        self.most = most
        self.width = 4 if 4 * self.d * most * most < 1 << 32 else 8
        biased = (x.astype(np.int64) + most).astype(f"<u{self.width}")
        self.fields = [int.from_bytes(np.ascontiguousarray(biased[:, j]).tobytes(), "little") for j in range(self.d)]
        self.taken = most * x.sum(1, dtype=np.int64)

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Inner products of the anchor with all candidates."""
        parts = anchor.tolist()
        total = 0
        for part, field in zip(parts, self.fields):
            total += (part + self.most) * field
        sums = np.frombuffer(total.to_bytes(self.n * self.width, "little"), f"<u{self.width}")
        return sums.astype(np.int64) - self.taken - self.most * (sum(parts) + self.d * self.most)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(scores) > k:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))][:k]


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _vectors(rows: pa.Table) -> np.ndarray:
    flat = rows.column("v").combine_chunks().flatten().to_numpy()
    return flat.reshape(rows.num_rows, -1).astype(np.int64)


def usable(rows: DataFrame) -> DataFrame:
    """``id, label, v, dim`` of the rows that take part, one for each id.

    Left out are rows whose id, label or vector is null, empty vectors, and vectors with a null or
    non-finite component or with components so large that inner products may not fit 64 bits (see
    ``MOST``; for 64 dimensions that is above 23 million). Of several rows of an id the one with the
    smallest label, then vector, counts.
    """
    v = F.col("v")
    sizes = F.transform("v", lambda x: F.abs(x.cast("double")))
    most = F.array_max(sizes)
    fits = F.size("v") * most * most < float(MOST)
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    full = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size("v") > 0)
    kept = rows.where(full).where(finite & fits)
    one = F.min(F.struct(F.col("label").cast("long").alias("label"), v.cast("array<int>").alias("v")))
    return kept.groupBy(F.col("id").cast("long").alias("id")).agg(one.alias("r")).select(
        "id", "r.label", "r.v", F.size("r.v").alias("dim")
    )


def _dealt(rows: DataFrame, mine: str, n_mine: int, other: str, n_other: int) -> DataFrame:
    """Rows in blocks ``mine`` by id, once for every block ``other`` of the other side."""
    block = F.pmod(F.xxhash64("id"), F.lit(n_mine)).cast("int")
    return rows.withColumn(mine, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """Hard negatives of the rows ``id, label, v`` (v: array of whole numbers) that are anchors.

    An anchor's positives are its first ``positives`` other rows of the same label by inner product,
    ties by smaller id. For each of them come the first ``negatives`` rows of other labels whose score
    lies between ``low`` and ``high`` per cent of the positive's:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Anchors without
    positives and positives without negatives give no row; vectors of other dimensions do not meet.
    ``is_anchor`` is a condition on ``id`` and ``label``. Further columns play no part. See ``usable``
    for the rows that take part.
    """
    base = materialise(usable(rows).withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    size = base.agg(F.count("*"), F.count_if("is_anchor"), F.coalesce(F.max(largest), F.lit(0))).first()
    n_blocks, n_groups, most = max(1, -(-size[0] // BLOCK)), max(1, -(-size[1] // ANCHORS)), max(1, size[2])
    anchors = base.where("is_anchor").drop("is_anchor")
    anchors = anchors.toDF(*anchors.columns)  # columns of its own, since it meets the table it comes from
    keys = ["dim", "block", "group"]
    candidates = _dealt(base.drop("is_anchor"), "block", n_blocks, "group", n_groups).groupBy(keys)

    def positive(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, vectors = _column(left, "id"), _column(left, "label"), _vectors(left)
        out = []
        wanted, theirs, whose = _column(right, "label"), _vectors(right), _column(right, "id")
        for label in np.unique(wanted):
            same = np.flatnonzero(labels == label)
            if not len(same):
                continue
            packed, id_ = Packed(vectors[same], most), ids[same]
            for i in np.flatnonzero(wanted == label):
                scores = packed.scores(theirs[i])
                others = np.flatnonzero(id_ != whose[i])
                at = others[best(scores[others], id_[others], positives)]
                out.append((np.full(len(at), whose[i]), id_[at], scores[at]))
        return _rows(out, ["anchor_id", "positive_id", "positive_score"])

    def negative(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels = _column(left, "id"), _column(left, "label")
        packed = Packed(_vectors(left), most) if left.num_rows and right.num_rows else None
        out = []
        theirs = _vectors(right) if right.num_rows else []
        for anchor, label, v, found in zip(
            right.column("id").to_pylist(), right.column("label").to_pylist(), theirs, right.column("found").to_pylist()
        ):
            if packed is None:
                break
            scores = packed.scores(v)
            differs = np.flatnonzero(labels != label)
            s, id_ = scores[differs], ids[differs]
            for pair in found:
                top = pair["positive_score"]
                fits = np.flatnonzero((low * top <= 100 * s) & (100 * s <= high * top))
                at = fits[best(s[fits], id_[fits], negatives)]
                whole = [np.full(len(at), x) for x in (anchor, pair["positive_id"], top)]
                out.append((*whole, id_[at], s[at]))
        return _rows(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    first = candidates.cogroup(_dealt(anchors, "group", n_groups, "block", n_blocks).groupBy(keys))
    found = _first(first.applyInArrow(positive, _FOUND), ["anchor_id"], "positive", positives).drop("rank")
    pairs = found.groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("found")  # at most ``positives``
    )
    asking = _dealt(anchors.join(pairs, "id"), "group", n_groups, "block", n_blocks)
    second = candidates.cogroup(asking.groupBy(keys)).applyInArrow(negative, _MINED)
    mined = _first(second, ["anchor_id", "positive_id"], "negative", negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _rows(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names)


def _first(rows: DataFrame, keys: list[str], what: str, k: int) -> DataFrame:
    """The ``k`` best rows of each key over all blocks, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.col(f"{what}_score").desc(), f"{what}_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised(embeddings: DataFrame) -> DataFrame:
    """``id, label, v`` of ``vec_id, embedding, label``: components times 256, rounded down.

    Where the id is divisible by 7 the label becomes (label + 1) % 10 first.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # As a double, because rounding a non-finite or huge component to a whole number would hide it.
    v = F.transform("embedding", lambda x: F.rint(F.floor(F.lit(256.0) * x.cast("double")).cast("double")))
    huge = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x.cast("double")) > 1e15), F.lit(False)))
    return embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), F.when(~huge, v).alias("v"))


def report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 100."""
    return mine(quantised(embeddings), F.col("id") % 100 == 0)


def sql() -> str:
    """The same from all pairs of anchors and rows."""
    return f"""WITH r AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
      list_inner_product(a.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score
    FROM r a JOIN r ON a.id <> r.id AND len(a.v) = len(r.v) WHERE a.id % 100 = 0),
  p AS (SELECT * FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
  SELECT p.anchor_id, p.id AS positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank,
    s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
  QUALIFY rank <= {NEGATIVES}"""
