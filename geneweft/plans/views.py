"""Circuit-shaped views over the supplied tables, each next to the SQL text that says the same."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geneweft.operators.series import points_from_events
from geneweft.operators.skew import dealt, index_points, tasks_for
from geneweft.plans.registry import table

STATES = ("00_state", "01_state", "10_state", "11_state")
TARGET = "purchase"


# --- trajectories ------------------------------------------------------------------------

POINT_KEYS = {
    "t1": ("0", "user_id % 5"),
    "t1d": ("user_id % 7", "cast(floor(user_id / 7.0e0) as bigint) % 3"),
    "t1u": ("user_id", "cast(floor(event_id / 4.0e0) as bigint) % 3"),
}
STATE_SQL = (
    "case event_id % 4 when 0 then '00_state' when 1 then '01_state' when 2 then '10_state' else '11_state' end"
)


KIND_SQL = (
    "case cast(floor(event_id / 4.0e0) as bigint) % 7 when 5 then 'mrna' when 6 then 'input' else 'protein' end"
)


def points(spark: SparkSession, sf_dir: str, view: str = "t1") -> DataFrame:
    """Events as trajectory points: one design (t1), seven designs (t1d) or one design per user (t1u).

    A species has a protein, an mRNA and an input series.
    """
    design, sample = POINT_KEYS[view]
    raw = table(spark, sf_dir, "events").select(
        F.expr(f"cast({design} as bigint)").alias("design_id"),
        F.expr(f"cast({sample} as bigint)").alias("sample_id"),
        F.expr(STATE_SQL).alias("state_name"),
        F.col("event_type").alias("species"),
        F.expr(KIND_SQL).alias("kind"),
        F.expr("unix_micros(cast(ts as timestamp)) / 1e6 - 1704067200").alias("time"),
        F.expr("value * 10").alias("value"),
        "event_id",
    )
    return points_from_events(raw, order_by=("time", "event_id")).drop("event_id")


def points_sql(view: str = "t1") -> str:
    design, sample = POINT_KEYS[view]
    keys = f"{design}, {sample}, event_id % 4, event_type, {KIND_SQL}"
    return f"""{view} as (
      select cast({design} as bigint) as design_id, cast({sample} as bigint) as sample_id,
             {STATE_SQL} as state_name, event_type as species, {KIND_SQL} as kind,
             row_number() over (partition by {keys} order by ts, event_id) - 1 as seq,
             count(*) over (partition by {keys}) as n_points,
             epoch_us(ts) / 1e6 - 1704067200 as time, value * 10 as value
      from events)"""


SPEC = {"00_state": 0, "01_state": 1, "10_state": 1, "11_state": 0}
# A truth table with a state that has no data and without one that has.
SPEC_PARTIAL = {"00_state": 0, "01_state": 1, "10_state": 1, "zz_state": 1}


def spec_for(spark: SparkSession, sf_dir: str, view: str, spec: dict[str, int] = SPEC) -> DataFrame:
    """The truth table for every design of a view, and for design -1, which has no points."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("state_name"), F.lit(e).alias("expected")) for s, e in spec.items()]))
    designs = table(spark, sf_dir, "events").select(F.expr(f"cast({POINT_KEYS[view][0]} as bigint)").alias("design_id"))
    designs = designs.union(designs.select(F.lit(-1).cast("long")).limit(1)).distinct()
    return designs.select("design_id", rows.alias("r")).select("design_id", "r.*")


def spec_sql(view: str, spec: dict[str, int] = SPEC) -> str:
    values = ", ".join(f"('{s}', {e})" for s, e in spec.items())
    return f"""spec as (select d.design_id, v.state_name, v.expected from (select distinct design_id from {view} union select -1) d,
      (values {values}) v(state_name, expected))"""


STEADY_SQL = """steady as (select design_id, sample_id, state_name, species, kind, avg(value) as steady_state from {view}
      where seq >= cast(floor(n_points * cast(0.9 as double)) as bigint) group by all)"""


# --- components and documents ------------------------------------------------------------

COMPONENT_EXPR = {
    "comp_id": "p_partkey",
    "name": "p_name",
    "collection": "case p_size % 5 when 0 then 'gates' when 1 then 'input_sensors' when 2 then 'output_devices' "
    "when 3 then 'motif_library' else 'input_output_map' end",
    "gate_type": "case when p_size % 2 = 0 then p_brand end",
    "sensor_type": "case when p_size % 3 = 0 then '' else p_type end",
    "toxicity_value": "case when p_size % 7 <> 0 then p_retailprice / 1000 end",
}


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(*[F.expr(e).alias(n) for n, e in COMPONENT_EXPR.items()])


COMPONENT_SQL = "t3 as (select " + ", ".join(f"{e} as {n}" for n, e in COMPONENT_EXPR.items()) + " from part)"
ROLE_SQL = (
    "case when lower(collection) like '%gate%' then 'gate' "
    "when lower(collection) like '%output%' and lower(collection) like '%device%' then 'output' "
    "when lower(collection) like '%sensor%' or (lower(collection) like '%input%' and lower(collection) not like '%output%') "
    "then 'sensor' else 'component' end"
)

# --- topology ----------------------------------------------------------------------------

NODE_TYPE_SQL = (
    "case l_suppkey % 4 when 0 then 'PRIMARY_INPUT' when 1 then 'LOGIC_GATE' "
    "when 2 then 'NOR_GATE' else 'PRIMARY_OUTPUT' end"
)
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """In how many tasks the line items are sorted and grouped; their number stands in the footers of the files."""
    return tasks_for(spark, table(spark, sf_dir, "lineitem").count())


def nodes(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Netlist nodes; an id may have several nodes of different type, the first by type wins."""
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("design_id"),
        F.expr("cast(l_suppkey % 10 as string)").alias("node_id"),
        F.expr(NODE_TYPE_SQL).alias("node_type"),
    )
    # few rows repeat, so without ``tasks`` each task of the scan holds nearly all of its rows before dealing them
    rows = dealt(raw, tasks, *raw.columns).distinct()
    return rows.select(
        "*",
        F.concat_ws("|", "node_type", "node_id").alias("pos"),
        F.lit(None).cast("string").alias("gate_name"),
        F.lit(None).cast("string").alias("protein"),
        F.concat(F.lit("s"), "node_id").alias("name"),
        F.lit(None).cast("map<string,double>").alias("parameters"),
    )


def lines(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Line items numbered from 1 inside their order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    return index_points(rows, ["l_orderkey"], LINE_ORDER, "pos", None, tasks).withColumn(
        "pos", F.col("pos") + 1
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Netlist edges; targets may be dangling, and every third refers to its node by name."""
    return lines(spark, sf_dir, line_tasks(spark, sf_dir)).select(
        F.col("l_orderkey").alias("design_id"),
        F.col("pos").alias("edge_pos"),
        F.expr("cast(l_suppkey % 10 as string)").alias("source_id"),
        F.expr("concat(case when pos % 3 = 0 then 's' else '' end, cast(l_partkey % 10 as string))").alias("target_id"),
        F.lit(None).cast("map<string,double>").alias("parameters"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected parts of a design in list order."""
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("design_id"), "pos", F.expr("l_suppkey % 10").alias("part")
    )


def unordered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parts without their positions, for counting; there is one edge for each."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("design_id"), F.expr("l_suppkey % 10").alias("part")
    )


NODES_SQL = f"""t7n as (select distinct l_orderkey as design_id, cast(l_suppkey % 10 as varchar) as node_id,
      {NODE_TYPE_SQL} as node_type from lineitem)"""
LINES_SQL = """lines as (select l_orderkey, l_partkey, l_suppkey, row_number() over (partition by l_orderkey
      order by l_linenumber, l_partkey, l_suppkey) as pos from lineitem)"""
EDGES_SQL = """t7e as (select l_orderkey as design_id, pos as edge_pos, cast(l_suppkey % 10 as varchar) as source_id,
      case when pos % 3 = 0 then 's' else '' end || cast(l_partkey % 10 as varchar) as target_id from lines)"""
PARTS_SQL = "t7p as (select l_orderkey as design_id, pos, l_suppkey % 10 as part from lines)"

# --- measurements, iterations, decisions, transcripts ------------------------------------

MEASUREMENT_EXPR = {
    "meas_id": "p_partkey",
    "raw_value": "p_retailprice",
    "param_type": "case p_size % 4 when 0 then 'kd' when 1 then 'transcription_rate' when 2 then 'mrna_deg_rate' else 'n' end",
    "raw_unit": "case p_size % 4 when 0 then case p_partkey % 3 when 0 then 'nM' when 1 then 'uM' else 'furlong' end "
    "when 1 then case p_partkey % 2 when 0 then 'uM/min' else 'nM/s' end "
    "when 2 then case p_partkey % 3 when 0 then '1/min' when 1 then 'h^-1' else 's-1' end else 'dimensionless' end",
}


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(*[F.expr(e).alias(n) for n, e in MEASUREMENT_EXPR.items()])


MEASUREMENT_SQL = "t8 as (select " + ", ".join(f"{e} as {n}" for n, e in MEASUREMENT_EXPR.items()) + " from part)"


def iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as iterations of one experiment per customer, numbered by date."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"),
        "o_orderdate",
        F.col("o_orderkey").alias("design"),
        F.expr("cast(floor(o_totalprice) as bigint) % 101").alias("score"),
    )
    numbered = index_points(rows, ["run_id"], ["o_orderdate", "design"], "_i", None)
    return numbered.withColumn("iteration", F.col("_i") + 1).drop("_i", "o_orderdate")


ITERATIONS_SQL = """t9 as (select o_custkey as run_id, row_number() over (partition by o_custkey
      order by o_orderdate, o_orderkey) as iteration, o_orderkey as design,
      cast(floor(o_totalprice) as bigint) % 101 as score from orders)"""

DECISION_EXPR = {
    "run_id": "doc_id",
    "current_round": "1 + doc_id % 4",
    "decision": "case when quality = 1 then 'PASS' else 'REVISE' end",
    "error_type": "case when quality = 1 and toxic = 0 then 'NONE' when quality = 0 and toxic = 1 then 'BOTH' "
    "when toxic = 1 then 'PART_ERROR' else 'LOGIC_ERROR' end",
    "selected_index": "case when quality = 1 then doc_id % 4 end",
    "has_human_feedback": "doc_id % 17 = 0",
    "feedback": "text",
}


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return joined.select(*[F.expr(e).alias(n) for n, e in DECISION_EXPR.items()])


DECISION_SQL = (
    "t10 as (select "
    + ", ".join(f"{e} as {n}" for n, e in DECISION_EXPR.items())
    + " from (select labels.doc_id, quality, toxic, text from labels join documents on labels.doc_id = documents.doc_id))"
)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        "turn",
        F.expr("cast(floor(turn / 2) as bigint) + 1").alias("round_number"),
        F.expr("case when role = 'user' then 'builder' else 'critic' end").alias("role"),
        "text",
    )


TURNS_SQL = """t6 as (select conv_id as session_id, turn, cast(floor(turn / 2) as bigint) + 1 as round_number,
      case when role = 'user' then 'builder' else 'critic' end as role, text from conversations)"""


def with_sql(*views: str) -> str:
    """The views as common tables, each computed once."""
    once = [re.sub(r"(?m)^( *)(\w+) as \(", r"\1\2 as materialized (", v) for v in views]
    return "with " + ",\n".join(once) + "\n"


def col(expr: str) -> Column:
    return F.expr(expr)
