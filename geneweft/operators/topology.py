"""Netlists and interaction graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geneweft.functions.values import pick_first_of
from geneweft.operators.skew import dealt
from geneweft.schemas import NETLIST


def species_type(node_type: Column) -> Column:
    t = F.upper(F.coalesce(node_type, F.lit("")))
    return (
        F.when(t.isin("PRIMARY_INPUT", "SENSOR"), F.lit("sensor"))
        .when(t.isin("PRIMARY_OUTPUT", "REPORTER"), F.lit("reporter"))
        .when(t.contains("GATE"), F.lit("repressor"))
        .otherwise(F.lit("unknown"))
    )


def display_name() -> Column:
    return pick_first_of(F.col("gate_name"), F.col("protein"), F.col("name"), F.col("node_id"))


def numbers(parameters: Column) -> Column:
    """The parameters that are numbers; texts among them are left out."""
    cast = F.transform_values(parameters, lambda _, v: v.try_cast("double"))
    return F.map_filter(cast, lambda _, v: v.isNotNull())


def split_netlists(netlists: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node rows, edge rows and error rows of netlist JSON texts, one design per text."""
    parsed = netlists.select("design_id", F.from_json(text, NETLIST).alias("_n"))
    complete = F.col("_n.nodes").isNotNull() & F.col("_n.edges").isNotNull()
    errors = parsed.where(~F.coalesce(complete, F.lit(False))).select("design_id", F.lit("invalid netlist").alias("error"))
    # an incomplete netlist has no position; outer, since a condition on the list would parse the texts again to test it
    unfold = lambda member: F.posexplode_outer(F.when(complete, F.col(f"_n.{member}")))
    nodes = parsed.select("design_id", unfold("nodes").alias("pos", "n")).where("pos is not null").select(
        "design_id",
        F.col("pos").cast("long").alias("pos"),
        F.col("n.id").alias("node_id"),
        "n.node_type",
        "n.gate_name",
        "n.protein",
        "n.name",
        numbers(F.col("n.parameters")).alias("parameters"),
    )
    edges = parsed.select("design_id", unfold("edges").alias("pos", "e")).where("pos is not null").select(
        "design_id",
        F.col("pos").cast("long").alias("edge_pos"),
        F.col("e.source").alias("source_id"),
        F.col("e.target").alias("target_id"),
        numbers(F.col("e.parameters")).alias("parameters"),
    )
    return nodes, edges, errors


def resolve_edges(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Both end nodes of every edge; edges with a missing end are dropped.

    An end matches a node by id or by name, and the first node in order wins. The nodes are
    first reduced to one row per (design, id or name), so an edge meets one row per end and
    no OR condition is joined. The edges of a hub node or a huge design land on one key; the
    lookup side has one row there.

    Both sides are sorted in their tasks. ``tasks`` deals them into that many, so that what a task holds is
    the caller's choice (see ``skew.tasks_for``) and does not grow with the tables.
    """
    carried = F.struct(
        F.col("node_id"), display_name().alias("shown"), F.col("node_type"), F.col("parameters")
    )
    by_id = nodes.select("design_id", F.col("node_id").alias("key"), "pos", carried.alias("node"))
    by_name = nodes.select("design_id", F.col("name").alias("key"), "pos", carried.alias("node"))
    first = (
        dealt(by_id.unionByName(by_name).where("key is not null"), tasks, "design_id", "key")
        .groupBy("design_id", "key")
        .agg(F.min_by("node", "pos").alias("node"))
    )

    def attach(rows: DataFrame, end: str) -> DataFrame:
        table = first.select("design_id", F.col("key").alias(f"{end}_id"), F.col("node").alias(f"{end}_node"))
        return dealt(rows, tasks, "design_id", f"{end}_id").join(table, ["design_id", f"{end}_id"])

    return attach(attach(edges, "source"), "target")


def interaction_type(source_type: Column, target_type: Column) -> Column:
    gate = F.upper(F.coalesce(source_type, F.lit(""))).contains("GATE") | F.upper(
        F.coalesce(target_type, F.lit(""))
    ).contains("GATE")
    return F.when(gate, F.lit("repression")).otherwise(F.lit("expression"))


def shown_interactions(resolved: DataFrame) -> DataFrame:
    """Interactions out of edges with both of their nodes."""
    own = F.when(F.size("parameters") > 0, F.col("parameters"))
    inherited = F.when(F.size("source_node.parameters") > 0, F.col("source_node.parameters"))
    return resolved.select(
        "design_id",
        "edge_pos",
        F.coalesce("source_node.shown", "source_id").alias("source"),
        F.coalesce("target_node.shown", "target_id").alias("target"),
        interaction_type(F.col("source_node.node_type"), F.col("target_node.node_type")).alias("type"),
        F.coalesce(own, inherited).alias("parameters"),
    )


def netlist_interactions(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(design, edge_pos, source, target, type, parameters); parameters from the edge, else its source node."""
    return shown_interactions(resolve_edges(nodes, edges, tasks))


#: Longest netlist text, in bytes, whose edges meet their nodes inside its own row.
TEXT_BYTES = 1 << 16


def text_interactions(netlists: DataFrame, text: str = "content", max_bytes: int = TEXT_BYTES) -> DataFrame:
    """As :func:`netlist_interactions` over netlist texts, one design per text.

    A text holds all nodes of its edges, so an edge finds its ends in its own row: the text is parsed once and
    nothing is shuffled. In a row an edge is compared with every node; the texts of huge circuits, longer than
    ``max_bytes``, are split and joined instead.
    """
    short = F.octet_length(text) <= max_bytes
    parsed = netlists.where(short).select("design_id", F.from_json(text, NETLIST).alias("_n"))
    held = parsed.select("design_id", "_n.nodes", F.col("_n.nodes.id").alias("_ids"), F.col("_n.nodes.name").alias("_names"), "_n.edges")
    # outer, since a condition on the edges would parse the texts again to test it; what has no edge finds no ends
    unfolded = F.posexplode_outer(F.when(F.col("nodes").isNotNull(), F.col("edges"))).alias("pos", "e")
    edges = held.select("design_id", "nodes", "_ids", "_names", unfolded).select(
        "design_id",
        F.col("pos").cast("long").alias("edge_pos"),
        F.col("e.source").alias("source_id"),
        F.col("e.target").alias("target_id"),
        numbers(F.col("e.parameters")).alias("parameters"),
        "nodes", "_ids", "_names",
    )
    zero = F.lit(0).cast("long")
    for end in ("source", "target"):
        # positions from 1, 0 where there is none; the first node in order wins
        by_id, by_name = (F.nullif(F.array_position(c, F.col(f"{end}_id")), zero) for c in ("_ids", "_names"))
        edges = edges.withColumn(f"_{end}", F.least(by_id, by_name).cast("int"))
    edges = edges.where("_source is not null and _target is not null")
    for end in ("source", "target"):
        edges = edges.withColumn(f"_{end}", F.get("nodes", F.col(f"_{end}") - 1))
        node = F.col(f"_{end}")
        shown = pick_first_of(node["gate_name"], node["protein"], node["name"], node["id"])
        carried = F.struct(shown.alias("shown"), node["node_type"].alias("node_type"), numbers(node["parameters"]).alias("parameters"))
        edges = edges.withColumn(f"{end}_node", carried)
    # dealt once for both halves of the join
    nodes, long_edges, _ = split_netlists(netlists.where(~short).select("design_id", text).repartition("design_id"), text)
    return shown_interactions(edges).unionByName(netlist_interactions(nodes, long_edges))


def netlist_species(nodes: DataFrame) -> DataFrame:
    """(design, pos, name, type) of named nodes."""
    named = nodes.withColumn("species_name", display_name()).where("species_name is not null")
    return named.select(
        "design_id", "pos", F.col("species_name").alias("name"), species_type(F.col("node_type")).alias("type")
    )


def parse_netlists(netlists: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Species, interactions and error rows of netlist texts."""
    nodes, _, errors = split_netlists(netlists, text)
    return netlist_species(nodes), text_interactions(netlists, text), errors


def interaction_sign(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(k.isin("repression", "repress"), F.lit("repression")).when(
        k.isin("activation", "activate"), F.lit("activation")
    )


def regulators(interactions: DataFrame, tasks: int | None = None) -> DataFrame:
    """Repressors and activators of every target, as ordered lists of distinct sources with their counts.

    The lists are bounded by the species of one circuit: sources are reduced per (target, sign,
    source) before they are collected. ``tasks`` as in :func:`resolve_edges`.
    """
    signed = interactions.withColumn("sign", interaction_sign(F.col("type"))).where("sign is not null")
    per_source = (
        dealt(signed, tasks, "design_id", "target", "sign", "source")
        .groupBy("design_id", "target", "sign", "source")
        .agg(F.count(F.lit(1)).alias("n_edges"), F.min("edge_pos").alias("_p"))
    )
    return dealt(per_source, tasks, "design_id", "target", "sign").groupBy("design_id", "target", "sign").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_p", "source", "n_edges"))),
            lambda s: F.struct(s["source"].alias("source"), s["n_edges"].alias("n_edges")),
        ).alias("sources"),
        F.sum("n_edges").alias("n_edges"),
    )


def packed_edges(interactions: DataFrame) -> DataFrame:
    """(design_id, edges): the signed interactions of every design as one array, bounded by the circuit's size."""
    signed = interactions.withColumn("sign", interaction_sign(F.col("type"))).where("sign is not null")
    edges = F.array_sort(F.collect_list(F.struct("edge_pos", "source", "target", "sign")))
    return signed.groupBy("design_id").agg(edges.alias("edges"))


def with_inducers(rows: DataFrame, inducer_targets: DataFrame | None, at: list[str], species: str) -> DataFrame:
    """Rows with the inducer, and its level, that acts on column ``species``; the last by ``pos`` wins.

    The inducers of a design (and of those of the keys ``at`` that they depend on) are one map, met by one row each.
    """
    if inducer_targets is None:
        return rows.withColumns({"inducer": F.lit(None).cast("string"), "inducer_level": F.lit(None).cast("double")})
    on = [c for c in at if c in inducer_targets.columns]
    last = inducer_targets.where("species is not null").groupBy(*on, "species").agg(
        F.struct(F.max_by("inducer", "pos").alias("inducer"), F.max_by("level", "pos").alias("level")).alias("acting")
    )
    maps = last.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("species", "acting"))).alias("_acting"))
    acting = F.try_element_at("_acting", F.col(species))
    return rows.join(maps, on, "left").withColumns({"inducer": acting["inducer"], "inducer_level": acting["level"]}).drop("_acting")


def expand_topology(
    snapshots: DataFrame, interactions: DataFrame, inducer_targets: DataFrame | None, keys: tuple[str, ...]
) -> DataFrame:
    """Every (snapshot, interaction) with the level of its source species and of the inducer that acts on it.

    snapshots: (design_id, *keys, species, protein, mrna); interactions: (design_id, edge_pos, source,
    target, type); inducer_targets: (design_id, inducer, species, level, pos) and any of the keys the
    level depends on, say only the state. Of several inducers on one species the last wins.

    A row meets its design's packed edges, one row per design, and unfolds those that leave its species.
    """
    at = ["design_id", *keys]
    carried = [c for c in ("params",) if c in snapshots.columns]
    levels = snapshots.select(*at, F.col("species").alias("source"), F.col("protein").alias("level"), *carried)
    leaving = F.transform(
        F.filter("edges", lambda e: e["source"] == F.col("source")),
        lambda e: F.struct(e["edge_pos"].alias("edge_pos"), e["target"].alias("target"), e["sign"].alias("sign")),
    )
    expanded = levels.join(packed_edges(interactions), "design_id").select(*levels.columns, F.inline(leaving))
    return with_inducers(expanded, inducer_targets, at, "source")
