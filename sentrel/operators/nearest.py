"""Nearest stored row within a distance, without comparing all with all.

Reference points (pivots) divide the stored rows: each belongs to its nearest pivot and, there, to a
ring of one threshold's width by its distance from it. By the triangle inequality a row within the
threshold of a query lies in one of at most four rings of a pivot, and only at pivots that are hardly
further from the query than its own nearest one. Queries and stored rows meet on (pivot, ring) by
an equality join, and every pair that meets is measured, so the result is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIVOTS, SAMPLE = 24, 2000
#: Distances of the same two rows may differ in the last digits; bounds are widened by this share.
SLACK = 1e-9


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e150))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of numbers of one length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _pivots(rows: DataFrame, n: int) -> list[list[float]]:
    """Up to ``n`` rows far from one another, of a bounded sample."""
    drawn = rows.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect()
    x = np.array([r["v"] for r in drawn], float)
    chosen: list[int] = []
    far = np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)) and (not chosen or far.max() > 0):
        best = int(np.argmax(far)) if chosen else 0
        chosen.append(best)
        far = np.minimum(far, np.sqrt(((x - x[best]) ** 2).sum(1)))
    return x[chosen].tolist()


def within(queries: DataFrame, stored: DataFrame, threshold: float, pivots: int = PIVOTS) -> DataFrame:
    """All pairs ``query_id, stored_id, distance`` of rows ``id, v`` not further apart than ``threshold``.

    ``v`` are arrays of numbers of one length for all rows; rows with a null or non-finite number, or
    a null array, are near nothing. Pivots come from at most ``SAMPLE`` stored rows; they decide how
    fast the search is, not what it finds.
    """
    if not threshold > 0:
        raise ValueError("the threshold must be positive")
    v = F.col("v").cast("array<double>")
    asking, known = (
        d.select("id", v.alias("v")).where(_finite(F.col("v"))) for d in (queries, stored)
    )
    points = F.lit(_pivots(known, pivots)).cast("array<array<double>>")
    reach = F.transform(points, lambda p: distance(p, F.col("v")))
    asking, known = asking.withColumn("far", reach), known.withColumn("far", reach)
    nearest = F.array_min("far")
    home = F.array_position("far", nearest).cast("int")

    def ring(d: Column) -> Column:
        return F.floor(d / threshold)

    cells = known.select(
        F.col("id").alias("stored_id"), F.col("v").alias("w"), home.alias("pivot"), ring(nearest).alias("ring")
    )
    # A stored row at home with pivot p is no nearer to any other pivot.
    near_enough = F.transform(
        "far",
        lambda d, i: F.when(
            d * (1 - SLACK) <= (F.array_min("far") + 2 * threshold) * (1 + SLACK),
            F.transform(
                F.sequence(
                    ring(F.greatest(d * (1 - SLACK) - threshold * (1 + SLACK), F.lit(0.0))),
                    ring((d + threshold) * (1 + SLACK)),
                ),
                lambda r: F.struct((i + 1).alias("pivot"), r.alias("ring")),
            ),
        ),
    )
    asked = asking.select(F.col("id").alias("query_id"), "v", F.inline(F.flatten(F.array_compact(near_enough))))
    return (
        asked.join(cells, ["pivot", "ring"])
        .select("query_id", "stored_id", distance(F.col("v"), F.col("w")).alias("distance"))
        .where(F.col("distance") <= threshold)
    )


def nearest_within(queries: DataFrame, stored: DataFrame, threshold: float, pivots: int = PIVOTS) -> DataFrame:
    """For each query that has one, the nearest stored row within ``threshold``; ties: the smallest id.

    ``query_id, matched_id, distance, n_within``. See ``within``.
    """
    best = F.min(F.struct("distance", "stored_id"))
    found = within(queries, stored, threshold, pivots)
    return found.groupBy("query_id").agg(best.alias("b"), F.count("*").alias("n_within")).select(
        "query_id", F.col("b.stored_id").alias("matched_id"), "b.distance", "n_within"
    )


def scaled_signature(signature: Column | str, scales: dict[str, tuple[float, float]]) -> Column:
    """A signature map as an array of (value - centre) / spread, in the order of ``scales``.

    The scales belong to the version of the signature: a fixed reference, never the batch at hand.
    """
    signature = F.col(signature) if isinstance(signature, str) else signature
    return F.array(
        *[(F.try_element_at(signature, F.lit(k)).cast("double") - F.lit(c)) / F.lit(s) for k, (c, s) in scales.items()]
    )

