"""Promoter activity, resource load and effective rates evaluated on stored snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geneweft.config import RateConfig
from geneweft.functions import kinetics as K
from geneweft.functions.values import param
from geneweft.operators.topology import packed_edges, with_inducers


def _param(key: str, species: Column | None, default: float) -> Column:
    return param(F.col("params"), key, species, default)


def hill_factors(rows: DataFrame, cfg: RateConfig = RateConfig()) -> DataFrame:
    """Rows with ``rep`` and ``act``, the factors by which their species represses or activates any target.

    A factor depends on its source alone (level, parameters, inducer), so it is computed once per species and not per edge.
    """
    kd = _param("kd", F.col("species"), cfg.kd)
    n = _param("n", F.col("species"), cfg.n)
    kd_ind = F.coalesce(F.try_element_at("params", F.concat(F.lit("kd_inducer_"), F.col("inducer"))), F.lit(cfg.kd_inducer))
    n_ind = F.coalesce(F.try_element_at("params", F.concat(F.lit("n_inducer_"), F.col("inducer"))), F.lit(cfg.n_inducer))
    level = F.col("protein")
    active = F.when(
        F.col("inducer").isNotNull(), K.active_repressor(level, F.coalesce("inducer_level", F.lit(0.0)), kd_ind, n_ind)
    ).otherwise(level)
    return rows.withColumns({"rep": K.hill_rep(active, kd, n), "act": K.hill_act(level, kd, n)})


def promoter_activity(
    snapshots: DataFrame,
    interactions: DataFrame,
    keys: tuple[str, ...],
    inducer_targets: DataFrame | None = None,
    cfg: RateConfig = RateConfig(),
) -> DataFrame:
    """Snapshot rows with ``activity``, the product of the factors of all regulators (1 without any).

    One exchange: the rows of a snapshot (one time point of one sample, as many as the circuit has species) meet in a
    window, and every row looks its regulators up in the design's packed edges. Factors without a value count as 1, edges
    from a species that the snapshot lacks do not count, rows that repeat a species each count. The exchange is stated
    because the join before it is by design alone: a hot design is split there and dealt by snapshot here.
    """
    at = ["design_id", *keys]
    factors = hill_factors(with_inducers(snapshots, inducer_targets, at, "species"), cfg)
    sources = F.collect_list(F.struct("species", "rep", "act")).over(Window.partitionBy(*at))
    rows = factors.join(packed_edges(interactions), "design_id", "left").repartition(*at).withColumn("sources", sources)

    def factor(edge: Column) -> Column:
        return F.aggregate(
            F.filter("sources", lambda s: s["species"] == edge["source"]),
            F.lit(1.0),
            lambda p, s: p * F.coalesce(F.when(edge["sign"] == "repression", s["rep"]).otherwise(s["act"]), F.lit(1.0)),
        )

    entering = F.filter("edges", lambda e: e["target"] == F.col("species"))
    activity = F.aggregate(entering, F.lit(1.0), lambda p, e: p * factor(e))
    return rows.select(*snapshots.columns, F.coalesce(activity, F.lit(1.0)).alias("activity"))


def _binding(cfg: RateConfig) -> list[Column]:
    """Polymerase and ribosome binding of one species."""
    species = F.col("species")
    rnap = F.lit(cfg.plasmid) * F.col("activity") / _param("km_rnap", species, cfg.km_rnap)
    ribo = F.col("mrna") / _param("km_ribo", species, cfg.km_ribo)
    return [rnap, ribo]


def resource_load(active: DataFrame, keys: tuple[str, ...], cfg: RateConfig = RateConfig()) -> DataFrame:
    """Sums of polymerase and ribosome binding per snapshot."""
    rnap, ribo = _binding(cfg)
    return active.groupBy("design_id", *keys).agg(F.sum(rnap).alias("rnap_load"), F.sum(ribo).alias("ribo_load"))


def with_load(active: DataFrame, keys: tuple[str, ...], cfg: RateConfig = RateConfig()) -> DataFrame:
    """Rows with the load of their snapshot, summed over the window that ``promoter_activity`` has dealt them by."""
    snapshot = Window.partitionBy("design_id", *keys)
    rnap, ribo = _binding(cfg)
    return active.withColumns({"rnap_load": F.sum(rnap).over(snapshot), "ribo_load": F.sum(ribo).over(snapshot)})


def rate_table(
    snapshots: DataFrame,
    interactions: DataFrame,
    keys: tuple[str, ...],
    inducer_targets: DataFrame | None = None,
    cfg: RateConfig = RateConfig(),
) -> DataFrame:
    """Effective transcription and translation rates and net changes for every stored snapshot row.

    snapshots: (design_id, *keys, species, protein, mrna, params). Nothing is integrated.
    """
    active = promoter_activity(snapshots, interactions, keys, inducer_targets, cfg)
    rows = with_load(active, keys, cfg)
    s = F.col("species")
    free_rnap = K.free_pool(_param("total_rnap", None, cfg.total_rnap), F.col("rnap_load"))
    free_ribo = K.free_pool(_param("total_ribosomes", None, cfg.total_ribosomes), F.col("ribo_load"))
    tx = K.transcription(
        _param("transcription_rate", s, cfg.transcription_rate),
        _param("leakage", s, cfg.leakage),
        F.col("activity"),
        F.col("free_rnap"),
        _param("km_rnap", s, cfg.km_rnap),
    )
    tl = K.translation(
        _param("translation_rate", s, cfg.translation_rate),
        F.col("mrna"),
        F.col("free_ribo"),
        _param("km_ribo", s, cfg.km_ribo),
    )
    return (
        rows.withColumns({"free_rnap": free_rnap, "free_ribo": free_ribo})
        .withColumns({"tx_rate": tx, "tl_rate": tl})
        .withColumns(
            {
                "d_mrna": F.col("tx_rate") - _param("mrna_deg_rate", s, cfg.mrna_deg_rate) * F.col("mrna"),
                "d_protein": F.col("tl_rate") - _param("protein_deg_rate", s, cfg.protein_deg_rate) * F.col("protein"),
            }
        )
    )
