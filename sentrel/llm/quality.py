"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

DataFrame functions only. Every rule gives 1 (good), -1 (bad) or 0 (no opinion). How often a rule
says what on good and on bad texts is unknown; these accuracies and the share of good texts are
estimated from the votes alone, and a text stays if its posterior probability of being good is high
enough.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.staging import materialise
from sentrel.llm.common import WORD, WORD_GAP, whole

#: Names of the rules; see ``votes``.
RULES = ("symbols", "repeats", "lines", "capitals", "word_length", "endings", "sentences")
#: What a rule can say, and rounds of expectation-maximisation.
VOTES, ROUNDS = (-1, 0, 1), 12
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts of every whole text, and the further counts that rules use.

    Three-word windows are compared by 64-bit hashes of the window within one text. Windows that
    recur are found by sorting (hash, place), so a long text costs n log n.
    """
    rows = docs.withColumn("__text", whole(text))
    rows = rows.withColumn("__words", F.array_remove(F.split("__text", WORD_GAP), ""))
    rows = rows.withColumns(
        {
            "__lines": F.filter(F.split("__text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD))),
            # The last two places have no full window; a slice takes them off.
            "__windows": F.slice(
                F.transform(
                    "__words",
                    lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)),
                ),
                F.lit(1),
                F.greatest(F.size("__words") - 2, F.lit(0)),
            ),
        }
    )
    rows = rows.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    again = F.filter(
        "__sorted",
        lambda x, j: same(x, F.get("__sorted", j + 1))
        | F.when(j > 0, same(x, F.get("__sorted", j - 1))).otherwise(False),
    )
    covered = F.array_distinct(
        F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    )
    long = lambda c: c.cast("long")
    return rows.withColumns(
        {
            "n_words": long(F.size("__words")),
            "word_chars": long(F.length(F.array_join("__words", ""))),
            "n_symbols": long(F.regexp_count("__text", F.lit(r"[#*$%&|<>]"))),
            "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))),
            "n_repeat_words": F.when(F.col("__sorted").isNull(), F.lit(0)).otherwise(long(F.size(covered))),
            "__n_lines": long(F.size("__lines")),
            "__n_upper": long(F.regexp_count("__text", F.lit(r"\p{Lu}"))),
            "__n_ends": long(F.regexp_count("__text", F.lit(r"[.!?](?![^\x20\x09-\x0D])"))),
            "__n_plain": long(F.regexp_count("__text", F.lit(r"(?<!\p{L})\p{L}++[.,;:?]?(?![^\x20\x09-\x0D])"))),
        }
    ).drop("__text", "__words", "__lines", "__windows", "__sorted")


def base_failed() -> Column:
    """Too short, or more than half of the words in windows that recur."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """The rules on the counts of ``with_counts``; products instead of quotients, so no division
    by zero. Five rules know junk and say nothing else; two know prose too. A text without words
    gets bad votes or none."""
    n, chars = F.col("n_words"), F.col("word_chars")
    junk = lambda c: F.when(c, -1).otherwise(0)
    either = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    return {
        "symbols": junk(20 * F.col("n_symbols") > chars),
        "repeats": junk(10 * F.col("n_repeat_words") > 3 * n),
        "lines": junk(10 * F.col("n_dup_lines") > 3 * F.col("__n_lines")),
        "capitals": junk(10 * F.col("__n_upper") > 3 * chars),
        "word_length": junk((chars < 2 * n) | (chars > 14 * n)),
        "endings": either(10 * F.col("__n_plain") < 6 * n, 10 * F.col("__n_plain") >= 8 * n),
        "sentences": either(
            (200 * F.col("__n_ends") < n) | (3 * F.col("__n_ends") > n),
            (50 * F.col("__n_ends") >= n) & (5 * F.col("__n_ends") <= n),
        ),
    }


def fit(counts: DataFrame, rounds: int = ROUNDS) -> dict[str, tuple[float, float, float]]:
    """Estimate how often each rule votes -1, 0 and 1 on good and on bad texts, from votes alone.

    Rows are reduced to patterns of votes first (at most 3 ** len(RULES), whatever the input);
    each round is one aggregation over that table and brings one row to the driver. It starts from
    votes that are right three times in four, which also says which of the two groups is the good
    one; every count gets one more, so no vote ever decides alone. Returns the log-odds that each
    vote of each rule adds; those of the share of good texts are in the first rule's. Without rows
    the start values stay.
    """
    patterns = materialise(
        counts.select([v.cast("int").alias(k) for k, v in votes().items()])
        .groupBy(*RULES)
        .agg(F.count("*").cast("double").alias("n"))
        .coalesce(1)
    )
    weights = {k: (-log(3.0), 0.0, log(3.0)) for k in RULES}
    n, p = F.col("n"), F.col("p")
    sums = [F.sum(n * p).alias("good"), F.sum(n * (1 - p)).alias("bad")]
    for k in RULES:
        for v in VOTES:
            sums.append(F.sum(F.when(F.col(k) == v, n * p).otherwise(0.0)).alias(f"good {k} {v}"))
            sums.append(F.sum(F.when(F.col(k) == v, n * (1 - p)).otherwise(0.0)).alias(f"bad {k} {v}"))
    for _ in range(rounds):
        row = patterns.withColumn("p", posterior(weights)).agg(*sums).first()
        if row["good"] is None:
            break
        share = log((row["good"] + 1) / (row["bad"] + 1))
        base = log((row["bad"] + 3) / (row["good"] + 3))
        weights = {
            k: tuple(
                log((row[f"good {k} {v}"] + 1) / (row[f"bad {k} {v}"] + 1)) + base + (share if k == RULES[0] else 0.0)
                for v in VOTES
            )
            for k in RULES
        }
    return weights


def posterior(weights: dict[str, tuple], vote: dict[str, Column] | None = None) -> Column:
    """Probability that a text is good, given its votes (columns named like the rules by default).

    The weights stand in array literals, so the code Spark compiles is the same for every round.
    """
    odds = None
    for k in RULES:
        one = F.get(F.array(*[F.lit(float(w)) for w in weights[k]]), (F.col(k) if vote is None else vote[k]) + 1)
        odds = one if odds is None else odds + one
    return 1 / (1 + F.exp(-odds))


def judge(counts: DataFrame, weights: dict[str, tuple], threshold: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``quality`` (posterior) and ``kept`` to counted rows."""
    return (
        counts.withColumn("quality", posterior(weights, votes()))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, base counts, ``base_failed``, ``kept``, ``quality``.

    Counts are made once and written narrow (no texts); fitting and judging read that table. Null
    texts have no words and fail, like empty ones. Rows stay whatever their keys; an empty table
    gives an empty table.
    """
    counts = materialise(
        with_counts(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text"))).drop("text")
    )
    return judge(counts, fit(counts)).select(f"`{key}`", *BASE, "base_failed", "kept", "quality")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were.

    The rules are fitted on all rows, then each row is judged where it is read: no join, no shuffle
    of texts. Columns with the names of counts are not touched.
    """
    only = docs.select(F.col(f"`{text}`").alias("text"))
    weights = fit(materialise(with_counts(only).drop("text")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    counted = with_counts(docs.select(row, F.col(f"`{text}`").alias("__t")), "__t").drop("__t")
    # A generator of one row: Spark does not move the filter below it, where it would make the
    # counts once for every mention.
    numbers = F.struct(*[F.col(c) for c in counted.columns if c != "__row"])
    counted = counted.select("__row", F.inline(F.array(numbers)))
    return judge(counted, weights).where("kept").select("__row.*")


def sql(threshold: float = 0.5, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL over ``documents``; each round is a table of one row."""
    word = r"[^\x20\x09-\x0D]"

    def vote(bad: str, good: str = "FALSE") -> str:
        return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"

    rules = {
        "symbols": vote("20 * n_symbols > word_chars"),
        "repeats": vote("10 * n_repeat_words > 3 * n_words"),
        "lines": vote("10 * n_dup_lines > 3 * n_lines"),
        "capitals": vote("10 * n_upper > 3 * word_chars"),
        "word_length": vote("word_chars < 2 * n_words OR word_chars > 14 * n_words"),
        "endings": vote("10 * n_plain < 6 * n_words", "10 * n_plain >= 8 * n_words"),
        "sentences": vote(
            "200 * n_ends < n_words OR 3 * n_ends > n_words",
            "50 * n_ends >= n_words AND 5 * n_ends <= n_words",
        ),
    }
    names = {-1: "m", 0: "z", 1: "p"}
    cells = [(k, v) for k in rules for v in VOTES]
    start = ", ".join(f"{v} * ln(3.0) AS {k}_{names[v]}" for k, v in cells)
    steps = [f"r0 AS (SELECT {start})"]
    odds = " + ".join(f"CASE {k} WHEN -1 THEN {k}_m WHEN 0 THEN {k}_z ELSE {k}_p END" for k in rules)
    for i in range(1, rounds + 1):
        sums = ", ".join(
            f"sum(CASE WHEN {k} = {v} THEN n * p ELSE 0 END) AS g_{k}_{names[v]},"
            f" sum(CASE WHEN {k} = {v} THEN n * (1 - p) ELSE 0 END) AS b_{k}_{names[v]}"
            for k, v in cells
        )
        logs = ", ".join(
            f"ln((g_{k}_{names[v]} + 1) / (b_{k}_{names[v]} + 1)) + ln((bad + 3) / (good + 3))"
            + (" + ln((good + 1) / (bad + 1))" if k == RULES[0] else "")
            + f" AS {k}_{names[v]}"
            for k, v in cells
        )
        steps.append(
            f"r{i} AS (SELECT {logs} FROM (SELECT sum(n * p) AS good, sum(n * (1 - p)) AS bad, {sums} FROM"
            f" (SELECT *, 1 / (1 + exp(-({odds}))) AS p FROM patterns, r{i - 1})))"
        )
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{word}+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM again, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
counts AS MATERIALIZED (
  SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words,
    length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper,
    len(list_filter(ws, lambda x: regexp_matches(x, '[.!?]$')))::BIGINT AS n_ends,
    len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}[.,;:?]?$')))::BIGINT AS n_plain
  FROM w LEFT JOIN rep USING (rid)),
v AS MATERIALIZED (SELECT *, {', '.join(f'{x} AS {k}' for k, x in rules.items())} FROM counts),
patterns AS MATERIALIZED (SELECT {', '.join(rules)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
{(','+chr(10)).join(s.replace(' AS (SELECT', ' AS MATERIALIZED (SELECT', 1) for s in steps)},
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1 / (1 + exp(-({odds}))) AS quality FROM v, r{rounds})
SELECT doc_id, {', '.join(BASE)}, base_failed, NOT base_failed AND quality >= {threshold} AS kept FROM judged
"""
