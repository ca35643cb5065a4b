"""URL filter: rules on hosts and paths, and trust and distrust spread over links between hosts.

DataFrame functions only. A page with a rule gets the rule's verdict. For the others, personalised
PageRank flows from trusted hosts along links and, as distrust, from blocked hosts against links;
a host with more distrust than trust is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.staging import materialise

#: Host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Share of rank that follows links, and the most rounds of it.
DAMPING, ROUNDS = 0.85, 30
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _first_fit(rules: tuple, value) -> Column:
    """The longest fitting rule's value; null if none fits."""
    out = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(value(host, path, verdict))).otherwise(out)
    return out


def with_rules(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Add ``rule`` and ``ruled``, its verdict, to rows with ``host`` and ``path``."""
    return pages.withColumns(
        {
            "rule": _first_fit(rules, lambda host, path, verdict: host + path),
            "ruled": _first_fit(rules, lambda host, path, verdict: verdict),
        }
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links (src, dst) between different hosts, from absolute addresses in ``html``."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))
    return (
        pages.where("host <> ''")
        .select(F.col("host").alias("src"), F.explode(F.array_distinct(targets)).alias("dst"))
        .select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
        .where("src <> dst")
        .distinct()
    )


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds`` (host), in units of one seed.

    ``edges`` are distinct (src, dst). Each round is a join and an aggregation by host, whose
    result is written; rank of hosts without links goes back to the seeds. It ends when ranks
    move no more, or after ``rounds``. Without links the seeds keep their rank.
    """
    start = seeds.select("host", F.lit(1.0).alias("seed"))
    n = seeds.count()
    if not n or edges.isEmpty():
        return start.select("host", F.col("seed").alias("rank"))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    weighted = materialise(edges.join(out, "src").select("src", "dst", (1 / F.col("out")).alias("w")))
    hosts = weighted.select(F.explode(F.array("src", "dst")).alias("host")).union(seeds.select("host")).distinct()
    hosts = materialise(
        hosts.join(start, "host", "left")
        .join(out.select(F.col("src").alias("host"), "out"), "host", "left")
        .select("host", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.col("out").isNull().alias("dangling"))
    )
    ranks = hosts.select("host", "seed", "dangling", F.col("seed").alias("rank"))
    for _ in range(rounds):
        lost = ranks.agg(F.sum(F.when(F.col("dangling"), F.col("rank")))).first()[0] or 0.0
        moved = (
            weighted.join(ranks.select(F.col("host").alias("src"), "rank"), "src")
            .groupBy(F.col("dst").alias("host"))
            .agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        )
        back = F.col("seed") * F.lit(1 - DAMPING + DAMPING * lost / n)
        new = materialise(
            ranks.join(moved, "host", "left").select(
                "host", "seed", "dangling", "rank",
                (back + DAMPING * F.coalesce("got", F.lit(0.0))).alias("new"),
            )
        )
        change = new.agg(F.sum(F.abs(F.col("new") - F.col("rank")))).first()[0]
        ranks = new.select("host", "seed", "dangling", F.col("new").alias("rank"))
        if change < 1e-9:
            break
    return ranks.select("host", "rank")


def host_verdicts(ruled: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(host, blocked) of every host on whose side trust or distrust arrives.

    Seeds are hosts most of whose pages a rule allows (trusted) or blocks. Blocked are hosts with
    distrust above ``threshold`` of the sum of both.
    """
    hosts = materialise(
        ruled.where("host <> ''")
        .groupBy("host")
        .agg(
            F.count("*").alias("n"),
            F.count(F.when(F.col("ruled") == "allow", 1)).alias("allow"),
            F.count(F.when(F.col("ruled") == "block", 1)).alias("block"),
        )
    )
    edges = materialise(edges)
    trust = spread(edges, hosts.where("2 * allow > n").select("host"))
    distrust = spread(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), hosts.where("2 * block > n").select("host")
    )
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    return both.select("host", (d > threshold * (t + d)).alias("blocked"))


def judge(pages: DataFrame, rules: tuple = RULES, key: str = "page_id") -> DataFrame:
    """Per row of ``pages``: key, ``host``, ``path``, ``rule`` and ``verdict``.

    A null url, or one without ``://``, has an empty host and path, no rule, and is allowed, as are
    hosts that neither trust nor distrust reaches. Null html has no links.
    """
    rows = pages.select(
        F.col(f"`{key}`").alias("id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html"
    )
    ruled = with_rules(rows, rules)
    narrow = materialise(ruled.drop("html"))
    blocked = host_verdicts(narrow, host_edges(rows)).where("blocked").select("host", "blocked")
    verdict = F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow"))
    return narrow.join(blocked, "host", "left").select(
        F.col("id").alias(key), "host", "path", "rule", verdict.alias("verdict")
    )


def sql(rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL over ``pages``, every round a table."""

    def fits(value) -> str:
        out = ""
        for host, path, verdict in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
            at_host = f"(host = '{host}' OR ends_with(host, '.{host}'))"
            out += f" WHEN {at_host} AND starts_with(path, '{path}') THEN '{value(host, path, verdict)}'"
        return f"CASE{out} END"

    def flow(name: str, edges: str, seeds: str) -> str:
        parts = [
            f"{name}_s AS MATERIALIZED (SELECT host FROM hosts WHERE {seeds})",
            f"{name}_e AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM {edges})",
            f"{name}_h AS MATERIALIZED (SELECT host, (host IN (SELECT host FROM {name}_s))::INT::DOUBLE AS seed,"
            f" host NOT IN (SELECT src FROM {name}_e) AS dangling FROM"
            f" (SELECT src AS host FROM {name}_e UNION SELECT dst FROM {name}_e UNION SELECT host FROM {name}_s))",
            f"{name}0 AS MATERIALIZED (SELECT host, seed, dangling, seed AS rank FROM {name}_h)",
        ]
        for i in range(1, rounds + 1):
            parts.append(
                f"{name}{i} AS MATERIALIZED (SELECT r.host, r.seed, r.dangling,"
                f" r.seed * ({1 - DAMPING} + {DAMPING} * coalesce((SELECT sum(rank) FROM {name}{i - 1} WHERE dangling), 0)"
                f" / (SELECT count(*) FROM {name}_s)) + {DAMPING} * coalesce(g.got, 0) AS rank FROM {name}{i - 1} r"
                f" LEFT JOIN (SELECT dst, sum(w * rank) AS got FROM {name}_e JOIN {name}{i - 1} p ON p.host = src"
                f" GROUP BY dst) g ON g.dst = r.host)"
            )
        return ",\n".join(parts)

    link = _LINK.replace("'", "''")
    return f"""
WITH p AS MATERIALIZED (
  SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages),
ruled AS MATERIALIZED (
  SELECT page_id, host, path, {fits(lambda h, p, v: h + p)} AS rule, {fits(lambda h, p, v: v)} AS ruled FROM p),
hosts AS MATERIALIZED (
  SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block
  FROM ruled WHERE host <> '' GROUP BY host),
fwd AS MATERIALIZED (
  SELECT DISTINCT src, translate(dst, '{_UPPER}', '{_LOWER}') AS dst FROM
    (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM p WHERE host <> '')
  WHERE src <> translate(dst, '{_UPPER}', '{_LOWER}')),
rev AS (SELECT dst AS src, src AS dst FROM fwd),
{flow('t', 'fwd', '2 * allow > n')},
{flow('d', 'rev', '2 * block > n')},
blocked AS (
  SELECT host FROM t{rounds} FULL JOIN d{rounds} USING (host)
  WHERE coalesce(d{rounds}.rank, 0) > 0.5 * (coalesce(t{rounds}.rank, 0) + coalesce(d{rounds}.rank, 0)))
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""
