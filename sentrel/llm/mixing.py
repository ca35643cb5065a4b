"""Mixing sources to target weights by subset sums over exact text lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions.staging import materialise
from sentrel.llm.common import count_words, whole

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
MOST = 3
#: Rows of one (source, length) that a task may have to order to find a cut.
BLOCK = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target of each source (``source, source_size``): its share of all sizes by weight.

    Sources take the weights in turn, in code point order, null last. No target is above ``most``
    times the source's size; what is cut off is shared by weight among the others, until none is
    above. The level at which the shares balance rises in rounds of one small aggregation each.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    place = (F.row_number().over(order) - 1) % len(weights) + 1
    weighted = materialise(
        sizes.select(
            "source",
            F.col("source_size").cast("long"),
            F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place).alias("weight"),
            (F.col("source_size") * most).cast("double").alias("cap"),
        )
    )
    total, weight = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    level = total / weight if total else 0.0
    while total:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        capped, rest = weighted.agg(
            F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if not rest or (total - (capped or 0.0)) / rest <= level:
            break
        level = (total - (capped or 0.0)) / rest
    return weighted.select(
        "source", "source_size", "weight", F.least(F.col("weight") * F.lit(level), "cap").alias("target")
    )


def fit_budget(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many texts of each length to take so that the lengths sum to ``budget``, or to less by
    as little as the last step can.

    Every length first gives its share; then, from the longest on, whole texts are added until
    about one longest text is missing. That rest is a bounded knapsack over what is left: the
    reachable sums are the bits of one number, each length entering in powers of two of its count.
    It stops as soon as the rest is reached, else at the nearest sum below, and is traced back.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if total <= budget:
        return list(counts)
    taken = [c * budget // total for c in counts]
    rest = budget - sum(s * t for s, t in zip(sizes, taken, strict=True))
    order = sorted((i for i, s in enumerate(sizes) if s > 0), key=lambda i: -sizes[i])
    reserve = sizes[order[0]] if order else 0
    for i in order:
        more = min(counts[i] - taken[i], max(0, rest - reserve) // sizes[i])
        taken[i] += more
        rest -= more * sizes[i]
    reached, mask, steps = 1, (1 << (rest + 1)) - 1, []
    for i in reversed(order):
        left, chunk = counts[i] - taken[i], 1
        while left and sizes[i] <= rest and not reached >> rest & 1:
            n = min(chunk, left)
            steps.append((i, n, reached))
            reached |= reached << n * sizes[i] & mask
            left -= n
            chunk *= 2
        if reached >> rest & 1:
            break
    at = reached.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * sizes[i]
    return taken


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    rest = int(group["rest"].iloc[0])
    extra = fit_budget([int(x) for x in group["size"]], [int(x) for x in group["n"]], rest)
    return group[["source", "size", "n", "passes"]].assign(extra=extra)


def with_size(docs: DataFrame, seed: int, text: str, source: str, key: str) -> DataFrame:
    """Add ``__source``, ``__size`` (words) and ``__h``, the place in the seeded order (63 bits)."""
    mixed = F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string"), F.col(f"`{source}`"), whole(text))
    return docs.withColumns(
        {
            "__source": F.col(f"`{source}`").cast("string"),
            "__size": count_words(whole(text)),
            "__h": F.shiftrightunsigned(mixed, 1),
        }
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["__source"].eqNullSafe(b["source"]) & (a["__size"] == b["size"])


def plan(sized: DataFrame) -> DataFrame:
    """What the mix takes from each (``source``, ``size``): all texts ``passes`` times, and those
    up to the place ``cut`` once more; of equal texts at the cut, ``ties`` of ``n_ties``.

    ``sized`` are narrow rows ``__source, __size, __h`` that can be read again cheaply. Lengths are
    counted first, so a source enters the knapsack as its distinct lengths, which are few even in
    the largest source (their sum is below its size). A cut is found in two steps: blocks of
    places are counted, then only the block with the cut is ordered.
    """
    hist = materialise(
        sized.groupBy(F.col("__source").alias("source"), F.col("__size").alias("size")).agg(
            F.count("*").alias("n")
        )
    )
    goals = targets(hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    goals = materialise(
        goals.withColumn("budget", F.round("target").cast("long"))
        .withColumn("passes", times.cast("long"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_size"))
    )
    g = goals.select(F.col("source").alias("s"), "passes", "rest")
    fitted = materialise(
        hist.join(g, F.col("source").eqNullSafe(F.col("s")))
        .groupBy("source")
        .applyInPandas(_fit, "source string, size long, n long, passes long, extra long")
    )
    part = fitted.where("extra > 0 and extra < n").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    block = F.floor(F.shiftright("__h", 10) * F.col("blocks") / F.lit(float(1 << 53))).alias("block")
    rows = sized.join(part, _same(sized, part)).select("source", "size", "extra", block, "__h")
    counted = rows.groupBy("source", "size", "extra", "block").agg(F.count("*").alias("m"))
    chain = Window.partitionBy("source", "size").orderBy("block")
    last = (
        counted.withColumn("upto", F.sum("m").over(chain))
        .where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("m") < F.col("extra")))
        .select("source", "size", "block", (F.col("extra") - F.col("upto") + F.col("m")).alias("need"))
    )
    r, c = rows.alias("r"), materialise(last).alias("c")
    inside = r.join(
        c,
        F.col("r.source").eqNullSafe(F.col("c.source"))
        & (F.col("r.size") == F.col("c.size"))
        & (F.col("r.block") == F.col("c.block")),
    ).select("r.source", "r.size", "need", "__h")
    ranked = (
        inside.groupBy("source", "size", "need", "__h")
        .agg(F.count("*").alias("n_ties"))
        .withColumn("upto", F.sum("n_ties").over(Window.partitionBy("source", "size").orderBy("__h")))
    )
    cuts = ranked.where(
        (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n_ties") < F.col("need"))
    ).select(
        F.col("source").alias("s"),
        F.col("size").alias("z"),
        F.col("__h").alias("cut"),
        "n_ties",
        (F.col("need") - F.col("upto") + F.col("n_ties")).alias("ties"),
    )
    full = fitted.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    goals = goals.select(F.col("source").alias("g"), "source_size", "target")
    return materialise(
        full.drop("s", "z")
        .withColumn("whole", F.col("extra") >= F.col("n"))
        .join(goals, F.col("source").eqNullSafe(F.col("g")))
        .select("source", "size", "source_size", "target", "passes", "whole", "cut", "ties", "n_ties")
    )


def with_copies(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """Add ``source_size``, ``target`` and ``__copies`` to sized rows."""
    joined = sized.join(planned, _same(sized, planned), "left").drop("source", "size")
    once = F.coalesce(F.col("whole") | (F.col("__h") <= F.col("cut")), F.lit(False))
    at_cut = F.coalesce((F.col("__h") == F.col("cut")) & (F.col("ties") < F.col("n_ties")), F.lit(False))
    if planned.where("ties < n_ties").isEmpty():
        take = once.cast("long")
    else:
        # Rows that agree in key, source and text: which of them are taken makes no difference.
        tie = Window.partitionBy("__source", "__size", "__h").orderBy("__h")
        joined = joined.where(~at_cut).withColumn("__tie", F.lit(0)).unionByName(
            joined.where(at_cut).withColumn("__tie", F.row_number().over(tie))
        )
        take = (once & ((F.col("__tie") == 0) | (F.col("__tie") <= F.col("ties")))).cast("long")
    return joined.withColumn("__copies", F.col("passes") + take).drop(
        "passes", "whole", "cut", "ties", "n_ties", "__tie"
    )


def report(docs: DataFrame, seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row of ``docs``: key, ``size``, ``source_size``, ``target`` and ``taken``.

    ``taken`` is the row's size times its copies in the mix, 0 to ``MOST``. Null texts have size 0
    and give nothing; a null source is a source, the last one. Equal seeds and rows give equal
    mixes whatever the order or partitions. Empty tables give empty tables.
    """
    narrow = with_size(
        docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{source}`").alias("s")),
        seed, "t", "s", "k",
    )
    sized = materialise(narrow.select(F.col("k").alias(key), "__source", "__size", "__h"))
    return with_copies(sized, plan(sized)).select(
        f"`{key}`",
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def mix(docs: DataFrame, seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    cols = [F.col(f"`{c}`").alias(a) for c, a in ((key, "__k"), (text, "__t"), (source, "__s"))]
    wide = with_size(docs.select(row, *cols), seed, "__t", "__s", "__k").drop("__k", "__t", "__s")
    planned = plan(materialise(wide.select("__source", "__size", "__h")))
    mixed = with_copies(wide, planned).where("__copies > 0")
    return mixed.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
