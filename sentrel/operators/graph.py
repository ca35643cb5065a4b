"""Attack graph as node and edge tables, as-of views, degrees and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.scalars import lookup


def _usable(events: DataFrame, hosts_only: bool) -> DataFrame:
    """All events with UNKNOWN for missing ends, or only those with both ends."""
    if hosts_only:
        return events.where((F.col("src") != "") & (F.col("dst") != ""))
    return events.withColumn("src", F.coalesce("src", F.lit("UNKNOWN"))).withColumn(
        "dst", F.coalesce("dst", F.lit("UNKNOWN"))
    )


def graph_edges(events: DataFrame, hosts_only: bool = False) -> DataFrame:
    """One edge per event; a missing confidence stays null, or is 0 in the host variant."""
    confidence = F.coalesce("confidence", F.lit(0.0)) if hosts_only else F.col("confidence")
    behaviour = F.coalesce("type", F.lit("UNKNOWN"))
    return _usable(events, hosts_only).select(
        F.col("src").alias("source"),
        F.col("dst").alias("target"),
        behaviour.alias("type"),
        behaviour.alias("behavior"),
        confidence.alias("confidence"),
        "ts_us",
        "seq",
    )


def graph_nodes(events: DataFrame, hosts_only: bool = False) -> DataFrame:
    """Distinct ends; the first role seen wins, the source before the destination."""
    # Place of the end in the order of events: even for sources, odd for destinations. A minimum of
    # whole numbers is combined in a hash table, and its parity tells the role.
    seq = F.coalesce(F.col("seq") * 2, F.lit(-(1 << 62)))
    ends = F.array(
        F.struct(F.col("src").alias("id"), seq.alias("at")), F.struct(F.col("dst").alias("id"), (seq + 1).alias("at"))
    )
    role = F.when(F.pmod(F.col("at"), F.lit(2)) == 0, "HOST" if hosts_only else "SOURCE").otherwise("DESTINATION")
    return (
        _usable(events, hosts_only)
        .select(F.inline(ends))
        .groupBy("id")
        .agg(F.min("at").alias("at"))
        .select("id", role.alias("type"))
    )


def edges_as_of(edges: DataFrame, at_us: int) -> DataFrame:
    """Edges up to an instant; edges without a time are always shown."""
    return edges.where(F.col("ts_us").isNull() | (F.col("ts_us") <= at_us))


def active_nodes(nodes: DataFrame, edges: DataFrame, shown: DataFrame) -> DataFrame:
    """Nodes at an end of a shown edge; every node if no edge at all carries a time."""
    ends = shown.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    timed = edges.select(F.max(F.col("ts_us").isNotNull()).alias("timed")).scalar()
    flagged = nodes.join(ends.withColumn("hit", F.lit(True)), "id", "left")
    return flagged.where(F.col("hit") | ~F.coalesce(timed, F.lit(False))).drop("hit")


def as_of_view(
    nodes: DataFrame, edges: DataFrame, at_us: int, hidden_types: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Visible nodes and the edges between them at an instant."""
    shown = edges_as_of(edges, at_us)
    visible = active_nodes(nodes, edges, shown)
    if hidden_types:
        visible = visible.where(~F.col("type").isin(*hidden_types))
    ids = visible.select("id")
    links = shown.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )
    return visible, links


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends per node; a self loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbour pairs, one row per (node, neighbour)."""
    both = F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("neighbor")),
        F.struct(F.col("target").alias("id"), F.col("source").alias("neighbor")),
    )
    return edges.select(F.explode(both).alias("p")).select("p.*").distinct()


def node_types(nodes: DataFrame) -> DataFrame:
    return nodes.select("type").distinct().orderBy("type")


def search_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose id contains the text, ignoring case."""
    return nodes.where(F.lower("id").contains(text.lower()))


def node_styles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree-based weight, short label and colours of every node."""
    base = F.greatest(F.lit(8.0), F.log2(F.coalesce("degree", F.lit(0)) + 2) * 5)
    scale = F.when(F.col("type") == "INCIDENT", 1.8).when(
        F.col("type") == "UNKNOWN_BEHAVIOR", 1.5
    )
    size = fixed.NODE_LABEL_LENGTH
    label = F.when(
        F.length("id") > size, F.concat(F.substring("id", 1, size), F.lit("..."))
    ).otherwise(F.col("id"))
    return nodes.join(degrees(edges), "id", "left").select(
        "id",
        "type",
        F.coalesce("degree", F.lit(0)).alias("degree"),
        (base * F.coalesce(scale, F.lit(1.0))).alias("weight"),
        label.alias("label"),
        lookup("type", fixed.NODE_COLOURS, fixed.DEFAULT_NODE_COLOUR).alias("colour"),
        lookup("type", fixed.VIEW_COLOURS, fixed.DEFAULT_VIEW_COLOUR).alias("view_colour"),
    )


def edge_display(edges: DataFrame) -> DataFrame:
    """Relation table with display names."""
    return edges.select(
        F.col("source").alias("Source"),
        F.col("target").alias("Target"),
        F.col("type").alias("Behavior"),
        F.col("confidence").alias("Confidence"),
        F.col("ts_us").alias("Timestamp"),
    )
