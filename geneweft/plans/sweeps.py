"""Queries over truth tables, sweep grids, noise and the result memo."""

from __future__ import annotations

from pyspark.sql import functions as F

from geneweft.functions.units import host_baseline
from geneweft.operators import sweep as O
from geneweft.plans import views as V
from geneweft.plans.registry import query, table
from geneweft.plans.scores import levels, levels_sql

def designs(spark, sf):
    """Orders as designs with none to three inputs."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("design_id"),
        F.expr("slice(array('IPTG', 'aTc', 'Ara'), 1, cast(o_orderkey % 4 as int))").alias("inputs"),
    )


STATES_SQL = """states as (select o_orderkey as design_id, o_orderkey % 4 as n, i as state_index,
      case when o_orderkey % 4 = 0 then 'default_state' else lpad(bin(i), cast(o_orderkey % 4 as int), '0') || '_state' end as state_name,
      case when o_orderkey % 4 = 0 then '' else lpad(bin(i), cast(o_orderkey % 4 as int), '0') end as bits
      from (select o_orderkey, unnest(range(cast(1 << cast(o_orderkey % 4 as int) as bigint))) as i from orders))"""


@query(
    "truth_table",
    V.with_sql(STATES_SQL)
    + """select design_id, state_index, state_name, cast(substr(bits, 1, 1) as double) as iptg, cast(substr(bits, 2, 1) as double) as atc from
      (select design_id, state_index, state_name, bits from states where n >= 2)
      union all select design_id, state_index, state_name, cast(substr(bits, 1, 1) as double), null from states where n = 1
      union all select design_id, state_index, state_name, null, null from states where n = 0""",
)
def _truth(spark, sf):
    rows = O.truth_table(designs(spark, sf))
    value = lambda k: F.try_element_at("state_inputs", F.lit(k))
    return rows.select("design_id", "state_index", "state_name", value("IPTG").alias("iptg"), value("aTc").alias("atc"))


WIDE_SQL = "(select o_orderkey, cast(o_orderkey % 8 as int) as n from orders)"


@query(
    "truth_table_dealt",
    f"""select o_orderkey as design_id, i as state_index, case when n = 0 then 'default_state' else lpad(bin(i), n, '0') || '_state' end as state_name
      from (select o_orderkey, n, unnest(range(cast(1 << n as bigint))) as i from {WIDE_SQL})""",
)
def _dealt(spark, sf):
    """Orders as designs with none to seven inputs, expanded by two bits at the least in the tasks they are dealt to."""
    wide = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("design_id"),
        F.expr("transform(slice(sequence(1, 7), 1, cast(o_orderkey % 8 as int)), i -> concat('in', i))").alias("inputs"),
    )
    return O.truth_table(wide, tasks=16, low_bits=2).select("design_id", "state_index", "state_name")


@query(
    "sweep_grid",
    """select s_suppkey as design_id, v.state_name, r.sample_id from supplier,
      (values ('00_state'), ('01_state'), ('10_state'), ('11_state')) v(state_name), (select unnest(range(10)) as sample_id) r""",
)
def _grid(spark, sf):
    two = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("design_id"), F.array(F.lit("a"), F.lit("b")).alias("inputs")
    )
    return O.sweep_grid(O.truth_table(two), 10).select("design_id", "state_name", "sample_id")


@query(
    "stimuli_for_states",
    V.with_sql(STATES_SQL)
    + """select design_id, state_name, input, 'pulse' as type, 0e0 as start, 100000e0 as duration,
      case when substr(bits, cast(k as bigint), 1) = '1' then 50000e0 else 0e0 end as amp
      from states, (values (1, 'IPTG'), (2, 'aTc'), (3, 'Ara')) v(k, input) where k <= n""",
)
def _stimuli(spark, sf):
    rows = O.stimuli_for_states(O.truth_table(designs(spark, sf)))
    return rows.select("design_id", "state_name", F.explode("stimuli").alias("input", "s")).select(
        "design_id", "state_name", "input", "s.type", "s.start", "s.duration", "s.amp"
    )


def _uniform_sql(suffix: str) -> str:
    return (
        "((cast(cast('0x' || substr(md5(concat_ws(',', design_id, sample_id, key, 7) || ',"
        + suffix
        + "'), 1, 13) as bigint) as double) + 0.5e0) / 4503599627370496e0)"
    )


NOISE_SQL = f"""params as (select p_partkey as design_id, v.key, case v.key when 'kd' then p_retailprice else cast(p_size as double) end as value
      from part, (values ('kd'), ('n')) v(key)),
    draws as (select *, sqrt(-2 * ln({_uniform_sql('u')})) * cos(2 * pi() * {_uniform_sql('v')}) as z
      from params, (select unnest(range(10)) as sample_id) r)"""


@query(
    "noisy_parameters",
    V.with_sql(NOISE_SQL)
    + "select design_id, key, sample_id, round(greatest(value * (1 + cast(0.15 as double) * z), 1e-10), 6) as noisy_value from draws",
)
def _noise(spark, sf):
    kinds = F.array(
        F.struct(F.lit("kd").alias("key"), F.col("p_retailprice").alias("value")),
        F.struct(F.lit("n").alias("key"), F.col("p_size").cast("double").alias("value")),
    )
    params = table(spark, sf, "part").select(F.col("p_partkey").alias("design_id"), F.explode(kinds).alias("k"))
    rows = O.noisy_parameters(params.select("design_id", "k.*"), 0.15, 10, seed=7)
    return rows.select("design_id", "key", "sample_id", "noisy_value")


MEMO_SQL = """keyed as (select distinct l_returnflag, l_linestatus, l_linenumber, l_quantity, sha256('{"flag":"' || l_returnflag || '","status":"'
      || l_linestatus || '"},null,' || l_linenumber || ',' || cast(cast(l_quantity as bigint) as varchar)) as memo_key from lineitem)"""


def memo_runs(spark, sf):
    """Line items as requested runs: two JSON inputs (the second absent), a sample count and a noise level."""
    rows = table(spark, sf, "lineitem").select(
        F.to_json(F.struct(F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"))).alias("params"),
        F.lit(None).cast("string").alias("stimulus"),
        F.col("l_linenumber").alias("samples"),
        F.col("l_quantity").cast("long").alias("noise"),
        "l_returnflag",
    )
    return O.memo_key(rows, ["params", "stimulus"], ["samples", "noise"])


@query("memo_key", V.with_sql(MEMO_SQL) + "select distinct memo_key from keyed")
def _memo(spark, sf):
    return memo_runs(spark, sf).select("memo_key").distinct()


@query("pending_runs", V.with_sql(MEMO_SQL) + "select distinct memo_key, l_linenumber as samples from keyed where l_returnflag <> 'A'")
def _pending(spark, sf):
    """The store holds every run of the accepted lines."""
    runs = memo_runs(spark, sf)
    store = runs.where("l_returnflag = 'A'").select("memo_key")
    return O.pending_runs(runs.select("memo_key", "samples"), store)


@query(
    "apply_focus",
    """select p_partkey, case f when 'leakage' then 0.08e0 when 'toxicity' then 0.04e0 else 0.02e0 end as leakage,
      round(case f when 'toxicity' then 8.33e0 * 1.35e0 else 8.33e0 end, 6) as tx, round(case f when 'toxicity' then 0.033e0 * 1.25e0 else 0.033e0 end, 6) as tl
      from (select p_partkey, case p_size % 4 when 0 then 'leakage' when 1 then 'toxicity' when 2 then 'stability' end as f from part)""",
)
def _focus(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.expr("case p_size % 4 when 0 then ' Leakage' when 1 then 'toxicity' when 2 then 'stability' end").alias("focus"),
        host_baseline(F.lit("Escherichia coli")).alias("params"),
    )
    get = lambda k: F.element_at("params", F.lit(k))
    return O.apply_focus(rows).select(
        "p_partkey", get("leakage").alias("leakage"), get("transcription_rate").alias("tx"), get("translation_rate").alias("tl")
    )


@query(
    "merge_states",
    V.with_sql(V.points_sql("t1d"), levels_sql())
    + """select design_id, sample_id, count(distinct state_name) as n_states, string_agg(state_name, ',' order by state_name) as states,
      round(max(value) filter (state_name = '01_state'), 6) as level_01 from levels group by all""",
)
def _merge(spark, sf):
    merged = O.merge_states(levels(spark, sf))
    return merged.select(
        "design_id", "sample_id", "n_states",
        F.array_join(F.array_sort(F.map_keys("levels")), ",").alias("states"),
        F.try_element_at("levels", F.lit("01_state")).alias("level_01"),
    )
