"""Queries over trajectories: reshaping, series metrics, burden, stimuli and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from geneweft.functions import kinetics as K
from geneweft.functions.units import host_baseline, normalize_host
from geneweft.functions.values import clamp_log, literal_map, param
from geneweft.operators import rates, series
from geneweft.operators.topology import expand_topology
from geneweft.plans import views as V
from geneweft.plans.registry import prepared, query, table

T1 = V.points_sql("t1")
T1D = V.points_sql("t1d")


@query(
    "melt_trajectories",
    """select l_orderkey as design_id, l_partkey as part, l_suppkey as line, time,
      case when name like 'Input_%' then substr(name, 7) when name like '%_mRNA' then replace(name, '_mRNA', '') else name end as species,
      case when name like '%_mRNA' then 'mrna' when name like 'Input_%' then 'input' else 'protein' end as kind,
      round(value, 6) as value
    from (unpivot (select l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as double) as time, l_quantity as "GFP",
      l_discount as "GFP_mRNA", l_tax as "Input_IPTG" from lineitem) on "GFP", "GFP_mRNA", "Input_IPTG" into name name value value)""",
)
def _melt(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("design_id"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("line"),
        F.col("l_linenumber").cast("double").alias("Time"),
        F.col("l_quantity").alias("GFP"),
        F.col("l_discount").alias("GFP_mRNA"),
        F.col("l_tax").alias("Input_IPTG"),
    )
    return series.melt_trajectories(wide, ["design_id", "part", "line"])


@query(
    "trajectory_points",
    """with wide as (select o_custkey as design_id, epoch(cast(o_orderdate as timestamp)) + o_orderkey / 1e6 as time, o_totalprice as gfp from orders),
      numbered as (select *, row_number() over (partition by design_id order by time) - 1 as seq, count(*) over (partition by design_id) as n_points from wide)
    select design_id, 'GFP' as species, kind, seq, n_points, round(time, 6) as time,
      round(case kind when 'protein' then gfp when 'mrna' then gfp / 100 else 7.0e0 end, 6) as value
    from numbered, (values ('protein'), ('mrna'), ('input')) k(kind)""",
)
def _points(spark, sf):
    """Frames of a protein, its mRNA and an input of the same name."""
    wide = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("design_id"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") / 1e6).alias("Time"),
        F.col("o_totalprice").alias("GFP"),
        (F.col("o_totalprice") / 100).alias("GFP_mRNA"),
        F.lit(7.0).alias("Input_GFP"),
    )
    return series.trajectory_points(wide, ["design_id"])


@query(
    "tail_slice",
    V.with_sql(T1)
    + """select sample_id, state_name, species, kind, seq, round(value, 6) as value, fraction
      from t1, (values (cast(0.9 as double), 'tenth'), (cast(0.5 as double), 'half')) f(f, fraction)
      where seq >= cast(floor(n_points * f) as bigint)""",
)
def _tail(spark, sf):
    t1 = V.points(spark, sf)
    keep = ["sample_id", "state_name", "species", "kind", "seq", "value"]
    tenth = series.tail_slice(t1, 0.9).select(*keep, F.lit("tenth").alias("fraction"))
    return tenth.unionByName(series.tail_slice(t1, 0.5).select(*keep, F.lit("half").alias("fraction")))


@query(
    "steady_state",
    V.with_sql(T1, V.STEADY_SQL.format(view="t1"))
    + "select design_id, sample_id, state_name, species, kind, round(steady_state, 6) as steady_state from steady",
)
def _steady(spark, sf):
    return series.steady_state(V.points(spark, sf))


@query(
    "oscillation",
    V.with_sql(T1)
    + """, tail as (select * from t1 where seq >= cast(floor(n_points * cast(0.5 as double)) as bigint)),
      centred as (select *, sign(value - avg(value) over (partition by design_id, sample_id, state_name, species, kind)) as s from tail),
      turned as (select *, lag(s) over (partition by design_id, sample_id, state_name, species, kind order by seq) as p from centred)
    select design_id, sample_id, state_name, species, kind, max(n_points) as n_points,
      cast(count(*) filter (s <> p) as bigint) as crossings, round(max(value) - min(value), 6) as amplitude,
      max(n_points) >= 100 and count(*) filter (s <> p) >= 3 and max(value) - min(value) > 100 as oscillates
    from turned group by all""",
)
def _oscillation(spark, sf):
    return series.oscillation(V.points(spark, sf))


@query(
    "rise_time",
    V.with_sql(T1)
    + """select design_id, sample_id, state_name, species, kind,
      round(coalesce(min(case when value >= 350 then time end), max(time)), 6) as rise_time from t1 group by all""",
)
def _rise(spark, sf):
    return series.rise_time(V.points(spark, sf), 350.0)


SUMMARY_SQL = """round(avg(case when seq < greatest(3, least(25, n_points // 20)) then value end), 6) as initial_mean,
      round(max(value), 6) as peak_value, round(arg_max(value, seq), 6) as final_value,
      round(max(value) - avg(case when seq < greatest(3, least(25, n_points // 20)) then value end), 6) as dynamic_range,
      round(case when max(value) > 0 then avg(case when seq < greatest(3, least(25, n_points // 20)) then value end) / max(value)
        else 0 end, 6) as leakage_ratio"""


@query(
    "trajectory_summary",
    V.with_sql(T1) + f"select design_id, sample_id, state_name, species, kind, {SUMMARY_SQL} from t1 group by all",
)
def _summary(spark, sf):
    return series.summarize(V.points(spark, sf))


@query(
    "trajectory_summary_output",
    V.with_sql(T1)
    + f"select design_id, sample_id, state_name, species, kind, {SUMMARY_SQL} from t1 where species = 'purchase' and kind = 'protein' group by all",
)
def _summary_output(spark, sf):
    return series.summarize(V.points(spark, sf), output=V.TARGET)


@query(
    "series_metrics",
    V.with_sql(T1D)
    + f"""select design_id, sample_id, state_name, species, kind, max(n_points) as n_points,
      round(avg(case when seq >= cast(floor(n_points * cast(0.9 as double)) as bigint) then value end), 6) as steady_state,
      round(coalesce(min(case when value >= 350 then time end), max(time)), 6) as rise_time, {SUMMARY_SQL}
      from t1d group by all""",
)
def _metrics(spark, sf):
    return series.series_metrics(V.points(spark, sf, "t1d"), 350.0)


@query(
    "ensemble_mean",
    V.with_sql(T1D)
    + """select design_id, state_name, species, kind, seq, round(avg(greatest(value, 1e-3)), 6) as mean_value,
      count(*) as n_samples from t1d group by all""",
)
def _ensemble(spark, sf):
    return series.ensemble_mean(V.points(spark, sf, "t1d"))


@query(
    "clamp_log",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(l_discount - 0.05e0, 1e-3), 6) as clamped from lineitem""",
)
def _clamp(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber"), "l_partkey", "l_suppkey",
        clamp_log(F.col("l_discount") - F.lit(0.05)).alias("clamped"),
    )


@query(
    "burden_species",
    V.with_sql(T1D)
    + """select design_id, sample_id, state_name, seq, round(sum(value), 6) as burden, count(*) as n_species
      from t1d where species <> 'purchase' and kind = 'protein' group by all""",
)
def _burden_species(spark, sf):
    rows = V.points(spark, sf, "t1d").where(series.is_burden_species(V.TARGET))
    return rows.groupBy(*series.STATE, "seq").agg(F.sum("value").alias("burden"), F.count(F.lit(1)).alias("n_species"))


@query(
    "max_burden_sample",
    V.with_sql(T1D)
    + """select design_id, sample_id, round(greatest(coalesce(max(b), 0), 0), 6) as max_burden from
      (select design_id, sample_id, state_name, seq, sum(value) filter (kind = 'protein') as b from t1d group by all) group by all""",
)
def _burden_sample(spark, sf):
    return series.max_burden(V.points(spark, sf, "t1d"), "sample")


@query(
    "max_burden_design",
    V.with_sql(T1D)
    + """select design_id, round(greatest(coalesce(max(b), 0), 0), 6) as max_burden from
      (select design_id, sample_id, state_name, seq, sum(value) filter (species <> 'purchase' and kind = 'protein') as b from t1d group by all)
      group by all""",
)
def _burden_design(spark, sf):
    return series.max_burden(V.points(spark, sf, "t1d"), "design", V.TARGET)


@query(
    "failed_runs",
    """with runs as (select distinct user_id % 7 as design_id, user_id * 100 + day(ts) as sample_id from events),
      alive as (select distinct user_id % 7 as design_id, user_id * 100 + day(ts) as sample_id from events
        where event_type = 'purchase')
    select r.design_id, count(*) as n_runs, count(a.sample_id) as n_ok, count(*) - count(a.sample_id) as n_failed
    from runs r left join alive a using (design_id, sample_id) group by r.design_id""",
)
def _failed(spark, sf):
    """Runs are (user, day); a run without any reading of the target gave an empty frame."""
    rows = table(spark, sf, "events").select(
        F.expr("user_id % 7").alias("design_id"),
        F.expr("user_id * 100 + day(ts)").alias("sample_id"),
        F.when(F.col("event_type") == V.TARGET, F.col("value")).alias("value"),
    )
    return series.drop_failed(rows, rows)[1]


@query(
    "stimulus_waveform",
    """select event_id, t, kind, round(case kind
        when 'pulse' then case when t >= start and t <= start + 500000 then amp else 0 end
        when 'sine' then amp * (1 + sin(2 * pi() * cast(0.00001 as double) * t)) / 2 else 0 end, 6) as level,
      round(case when t < 100000 then 0 else 500 * exp(-0.000001 * (t - 100000)) end, 6) as expression_level
    from (select event_id, cast(floor(epoch_us(ts) / 1e6) - 1704067200 as double) as t,
      case event_id % 3 when 0 then 'pulse' when 1 then 'sine' else 'ramp' end as kind,
      cast(user_id * 1000 as double) as start, value as amp from events)""",
)
def _stimulus(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        F.expr("cast(floor(unix_micros(cast(ts as timestamp)) / 1e6) - 1704067200 as double)").alias("t"),
        F.expr("case event_id % 3 when 0 then 'pulse' when 1 then 'sine' else 'ramp' end").alias("kind"),
        F.expr("cast(user_id * 1000 as double)").alias("start"),
        F.col("value").alias("amp"),
    )
    spec = F.struct(
        F.col("kind").alias("type"), "start", F.lit(500000.0).alias("duration"), "amp", F.lit(0.00001).alias("freq")
    )
    return rows.select(
        "event_id",
        "t",
        "kind",
        K.stimulus(F.col("t"), spec).alias("level"),
        K.stimulus_expression("100000: 500 * exp(-0.000001 * (t - 100000))").alias("expression_level"),
    )


# --- rates on stored snapshots -----------------------------------------------------------

SNAPSHOT = ("sample_id", "state_name", "seq")
OVERRIDES = {"kd_click": 300.0, "n_view": 1.5, "km_rnap_error": 80.0, "leakage": 0.01}


def snapshots(spark, sf):
    """Readings as protein levels, mRNA a hundredth of them, with the baseline of a host per sample."""
    t1 = V.points(spark, sf).where(series.is_protein())
    host = F.expr("case sample_id % 3 when 0 then 'Bacillus subtilis' when 1 then 'baker''s yeast' else 'E. coli' end")
    return t1.select(
        "design_id",
        *SNAPSHOT,
        "species",
        F.col("value").alias("protein"),
        (F.col("value") / 100.0).alias("mrna"),
        F.map_concat(host_baseline(normalize_host(host)), literal_map(OVERRIDES)).alias("params"),
    )


def ring(spark, sf):
    """Species in a ring by name, alternately repressing and activating, plus one more repression of each third."""
    kinds = table(spark, sf, "events").select(F.lit(0).cast("long").alias("design_id"), "event_type")
    names = kinds.groupBy("design_id").agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    size = F.size("names")
    link = lambda i, step, kind: F.struct(
        F.get("names", i).alias("source"), F.get("names", (i + step) % size).alias("target"), kind.alias("type")
    )
    even = lambda i: F.when(i % 2 == 0, F.lit("repression")).otherwise(F.lit("activation"))
    index = F.sequence(F.lit(0), size - 1)
    both = F.concat(
        F.transform(index, lambda i: link(i, F.lit(1), even(i))),
        F.transform(index, lambda i: link(i, F.lit(2), F.lit("repress"))),
    )
    return names.select("design_id", F.posexplode(both).alias("edge_pos", "e")).select("design_id", "edge_pos", "e.*")


def inducers(spark, sf):
    """Two inducers on one species in every state; the second has the last word."""
    states = table(spark, sf, "events").select(
        F.lit(0).cast("long").alias("design_id"), F.expr(V.STATE_SQL).alias("state_name")
    ).distinct()
    kinds = F.array(
        F.struct(F.lit("IPTG").alias("inducer"), F.lit(900.0).alias("level"), F.lit(0).alias("pos")),
        F.struct(F.lit("aTc").alias("inducer"), F.lit(5000.0).alias("level"), F.lit(1).alias("pos")),
    )
    return states.select("*", F.lit("click").alias("species"), F.explode(kinds).alias("i")).select(
        "design_id", "state_name", "species", "i.*"
    )


RATES_SQL = V.with_sql(
    T1,
    """snap as (select design_id, sample_id, state_name, seq, species, value as protein, value / 100.0e0 as mrna,
      case sample_id % 3 when 0 then 6.5e0 when 1 then 0.5e0 else 8.33e0 end as tx,
      case sample_id % 3 when 0 then 0.02e0 when 1 then 0.005e0 else 0.033e0 end as tl,
      case sample_id % 3 when 0 then 0.002e0 when 1 then 0.0005e0 else 0.00167e0 end as mdeg,
      case sample_id % 3 when 0 then 0.0005e0 when 1 then 0.0001e0 else 0.00083e0 end as pdeg,
      case when species = 'click' then 300e0 else case sample_id % 3 when 0 then 1200e0 when 1 then 500e0 else 1000e0 end end as kd,
      case when species = 'view' then 1.5e0 else 2e0 end as n,
      case sample_id % 3 when 0 then 40e0 when 1 then 150e0 else 50e0 end as rnap,
      case sample_id % 3 when 0 then 400e0 when 1 then 2000e0 else 500e0 end as ribo,
      case when species = 'error' then 80e0 else 100e0 end as km_rnap, 500e0 as km_ribo from t1 where kind = 'protein')""",
    "names as (select species, row_number() over (order by species) - 1 as i, count(*) over () as c from (select distinct species from t1))",
    """ring as (select a.i as edge_pos, a.species as source, b.species as target,
        case when a.i % 2 = 0 then 'repression' else 'activation' end as sign
      from names a join names b on b.i = (a.i + 1) % a.c
      union all select a.c + a.i, a.species, b.species, 'repression' from names a join names b on b.i = (a.i + 2) % a.c)""",
    """expanded as (select s.*, r.edge_pos, r.source, r.target, r.sign from snap s join ring r on s.species = r.source)""",
    """factors as (select *, case when species = 'click' then protein / (1 + pow(5000e0 / 5000e0, 2)) else protein end as active
      from expanded)""",
    """products as (select design_id, sample_id, state_name, seq, target, product(case when sign = 'repression'
        then 1 / (1 + pow(active / kd, n)) else pow(protein / kd, n) / (1 + pow(protein / kd, n)) end) as activity
      from factors group by all)""",
    """act as (select s.*, coalesce(p.activity, 1) as activity from snap s left join products p
      on p.sample_id = s.sample_id and p.state_name = s.state_name and p.seq = s.seq and p.target = s.species)""",
    """load as (select sample_id, state_name, seq, sum(20 * activity / km_rnap) as rnap_load, sum(mrna / km_ribo) as ribo_load
      from act group by all)""",
    """free as (select act.*, rnap_load, ribo_load, rnap / (1 + rnap_load) as free_rnap, ribo / (1 + ribo_load) as free_ribo
      from act join load using (sample_id, state_name, seq))""",
    """rated as (select *, tx * (0.01e0 + (1 - 0.01e0) * activity) * (free_rnap / (km_rnap + free_rnap)) as tx_rate,
      tl * mrna * (free_ribo / (km_ribo + free_ribo)) as tl_rate from free)""",
)


@query(
    "hill_terms",
    """select p_partkey, round(1 / (1 + pow(p_retailprice / 950, 2)), 6) as repression,
      round(pow(p_retailprice / 950, 2) / (1 + pow(p_retailprice / 950, 2)), 6) as activation,
      round(p_retailprice / (1 + pow(p_size * 100 / 5000.0e0, 2)), 6) as active_repressor from part""",
)
def _hill(spark, sf):
    level, kd, n = F.col("p_retailprice"), F.lit(950.0), F.lit(2.0)
    return table(spark, sf, "part").select(
        "p_partkey",
        K.hill_rep(level, kd, n).alias("repression"),
        K.hill_act(level, kd, n).alias("activation"),
        K.active_repressor(level, F.col("p_size") * 100, F.lit(5000.0), n).alias("active_repressor"),
    )


@query(
    "parameter_override",
    """select p_partkey, key, round(value, 6) as value from (select p_partkey, unnest(['kd', 'km_rnap', 'leakage']) as key,
      unnest([case when p_size % 2 = 0 then p_retailprice when p_size % 3 = 0 then 500 else 1000 end,
              case when p_size % 3 = 0 then 70 else 100 end, cast(0.005 as double)]) as value from part)""",
)
def _param(spark, sf):
    """Per-species key, else shared key, else literal; which keys exist depends on the part."""
    species = F.col("p_name")
    entry = lambda key, value: F.struct(key.alias("k"), value.alias("v"))
    some = F.map_from_entries(
        F.array_compact(
            F.array(
                F.when(F.col("p_size") % 2 == 0, entry(F.concat(F.lit("kd_"), species), F.col("p_retailprice"))),
                F.when(F.col("p_size") % 3 == 0, entry(F.lit("kd"), F.lit(500.0))),
                F.when(F.col("p_size") % 3 == 0, entry(F.lit("km_rnap"), F.lit(70.0))),
            )
        )
    )
    rows = table(spark, sf, "part").withColumn("params", some)
    wanted = F.array(
        *[
            F.struct(F.lit(k).alias("key"), param(F.col("params"), k, species, d).alias("value"))
            for k, d in (("kd", 1000.0), ("km_rnap", 100.0), ("leakage", 0.005))
        ]
    )
    return rows.select("p_partkey", F.explode(wanted).alias("w")).select("p_partkey", "w.*")


@query(
    "topology_expansion",
    RATES_SQL
    + """select sample_id, state_name, seq, edge_pos, source, target, sign, round(protein, 6) as level,
      case when source = 'click' then 'aTc' end as inducer, case when source = 'click' then 5000e0 end as inducer_level
      from expanded""",
)
def _expand(spark, sf):
    out = expand_topology(snapshots(spark, sf).drop("params"), ring(spark, sf), inducers(spark, sf), SNAPSHOT)
    return out.drop("design_id")


@query(
    "resource_load",
    RATES_SQL
    + """select sample_id, state_name, seq, round(rnap_load, 6) as rnap_load, round(ribo_load, 6) as ribo_load from load""",
)
def _load(spark, sf):
    active = rates.promoter_activity(snapshots(spark, sf), ring(spark, sf), SNAPSHOT, inducers(spark, sf))
    return rates.resource_load(active, SNAPSHOT).drop("design_id")


@query(
    "rate_table",
    RATES_SQL
    + """select sample_id, state_name, seq, species, round(activity, 6) as activity, round(free_rnap, 6) as free_rnap,
      round(free_ribo, 6) as free_ribo, round(tx_rate, 6) as tx_rate, round(tl_rate, 6) as tl_rate,
      round(tx_rate - mdeg * mrna, 6) as d_mrna, round(tl_rate - pdeg * protein, 6) as d_protein from rated""",
)
def _rates(spark, sf):
    out = rates.rate_table(snapshots(spark, sf), ring(spark, sf), SNAPSHOT, inducers(spark, sf))
    return out.select(
        *SNAPSHOT, "species", "activity", "free_rnap", "free_ribo", "tx_rate", "tl_rate", "d_mrna", "d_protein"
    )
