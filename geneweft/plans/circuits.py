"""Queries over netlists and interaction graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geneweft.operators import topology as O
from geneweft.plans import views as V
from geneweft.plans.registry import query, table
from geneweft.sources.readers import prefer_netlists

FILE_EXPR = """concat('/runs/', l_orderkey, '/', case l_linenumber % 3 when 0 then concat('z', l_partkey, '_netlist.json')
  when 1 then concat('a', l_partkey, '.json') else concat('b', l_partkey, '.log') end)"""


@query(
    "prefer_netlists",
    f"""select folder, path from (select folder, path, row_number() over (partition by folder order by
      case when path like '%\\_netlist.json' escape '\\' then 0 else 1 end, path) as rn from
      (select distinct '/runs/' || l_orderkey as folder, {FILE_EXPR} as path from lineitem) where path like '%.json') where rn = 1""",
)
def _prefer(spark, sf):
    """Line items as files of their order's folder: netlists, other JSON and logs."""
    files = table(spark, sf, "lineitem").select(F.expr(FILE_EXPR).alias("path")).distinct()
    return prefer_netlists(files).select("folder", "path")


NETLIST_EXPR = """concat('{"nodes": [{"id": "n1", "node_type": "primary_input", "name": "in', l_suppkey, '"}, ',
  '{"id": "n2", "node_type": "', case l_partkey % 3 when 0 then 'NOR_GATE' when 1 then 'REPORTER' else 'OTHER' end,
  '", "protein": "p', l_partkey, '", "parameters": {"kd": ', l_linenumber, '}}, {"node_type": "SENSOR"}], "edges": [',
  '{"source": "in', l_suppkey, '", "target": "n2"}, {"source": "n2", "target": "n1", "parameters": {"n": 2}}, {"source": "n9", "target": "n1"}]}')"""


def netlist_texts(spark, sf):
    """One netlist text per line item; two-unit lines have no edges at all and are invalid."""
    text = F.expr(f"case when l_quantity = 2 then '{{\"nodes\": []}}' else {NETLIST_EXPR} end")
    key = F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)")
    return table(spark, sf, "lineitem").select(key.alias("design_id"), text.alias("content"))


KEY_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as design_id"


@query(
    "parse_netlist_species",
    f"""select design_id, 0 as pos, 'in' || l_suppkey as name, 'sensor' as type from (select *, {KEY_SQL} from lineitem) where l_quantity <> 2
    union all select design_id, 1, 'p' || l_partkey, case l_partkey % 3 when 0 then 'repressor' when 1 then 'reporter' else 'unknown' end
      from (select *, {KEY_SQL} from lineitem) where l_quantity <> 2""",
)
def _species(spark, sf):
    return O.parse_netlists(netlist_texts(spark, sf))[0]


@query(
    "parse_netlist_interactions",
    f"""with s as (select *, {KEY_SQL} from lineitem where l_quantity <> 2)
    select design_id, 0 as edge_pos, 'in' || l_suppkey as source, 'p' || l_partkey as target,
      case l_partkey % 3 when 0 then 'repression' else 'expression' end as type, null as parameters from s
    union all select design_id, 1, 'p' || l_partkey, 'in' || l_suppkey, case l_partkey % 3 when 0 then 'repression' else 'expression' end,
      '{{"n":2.0}}' from s""",
)
def _interactions(spark, sf):
    rows = O.parse_netlists(netlist_texts(spark, sf))[1]
    return rows.withColumn("parameters", F.to_json("parameters"))


@query(
    "invalid_netlists",
    f"select design_id, 'invalid netlist' as error from (select {KEY_SQL} from lineitem where l_quantity = 2)",
)
def _invalid(spark, sf):
    return O.parse_netlists(netlist_texts(spark, sf))[2]


FIRST_SQL = """named as (select design_id, node_id as key, node_type, node_id from t7n
      union all select design_id, 's' || node_id, node_type, node_id from t7n),
    firsts as (select design_id, key, arg_min(node_type, node_type || '|' || node_id) as node_type, min(node_id) as node_id from named group by all),
    resolved as (select e.design_id, e.edge_pos, s.node_id as source_node, t.node_id as target_node, s.node_type as source_type, t.node_type as target_type
      from t7e e join firsts s on s.design_id = e.design_id and s.key = e.source_id
      join firsts t on t.design_id = e.design_id and t.key = e.target_id)"""
GRAPH_SQL = (V.NODES_SQL, V.LINES_SQL, V.EDGES_SQL, FIRST_SQL)


@query(
    "resolve_edges",
    V.with_sql(*GRAPH_SQL) + "select design_id, edge_pos, source_node, target_node, source_type, target_type from resolved",
)
def _resolve(spark, sf):
    tasks = V.line_tasks(spark, sf)
    rows = O.resolve_edges(V.nodes(spark, sf, tasks), V.edges(spark, sf), tasks)
    return rows.select(
        "design_id", "edge_pos",
        F.col("source_node.node_id").alias("source_node"), F.col("target_node.node_id").alias("target_node"),
        F.col("source_node.node_type").alias("source_type"), F.col("target_node.node_type").alias("target_type"),
    )


INTERACTION_SQL = """interactions as (select design_id, edge_pos, 's' || source_node as source, 's' || target_node as target,
      case when contains(source_type, 'GATE') or contains(target_type, 'GATE') then 'repression' else 'expression' end as type from resolved)"""


@query(
    "netlist_topology",
    V.with_sql(*GRAPH_SQL, INTERACTION_SQL) + "select design_id, edge_pos, source, target, type from interactions",
)
def _topology(spark, sf):
    tasks = V.line_tasks(spark, sf)
    return O.netlist_interactions(V.nodes(spark, sf, tasks), V.edges(spark, sf), tasks).drop("parameters")


@query(
    "netlist_species",
    V.with_sql(V.NODES_SQL)
    + """select design_id, 's' || node_id as name, node_type || '|' || node_id as pos, case when node_type = 'PRIMARY_INPUT' then 'sensor'
      when node_type = 'PRIMARY_OUTPUT' then 'reporter' else 'repressor' end as type from t7n""",
)
def _node_species(spark, sf):
    return O.netlist_species(V.nodes(spark, sf))


@query(
    "regulators",
    V.with_sql(*GRAPH_SQL, INTERACTION_SQL)
    + """select design_id, target, sign, string_agg(source || ':' || n, ',' order by p, source) as sources, cast(sum(n) as bigint) as n_edges
      from (select design_id, target, case when type = 'expression' then 'activation' else type end as sign, source, count(*) as n, min(edge_pos) as p
        from interactions group by all) group by all""",
)
def _regulators(spark, sf):
    """Expression edges stand for activations here, so that both lists are filled."""
    tasks = V.line_tasks(spark, sf)
    rows = O.netlist_interactions(V.nodes(spark, sf, tasks), V.edges(spark, sf), tasks)
    acting = rows.withColumn("type", F.when(F.col("type") == "expression", F.lit("activate")).otherwise(F.lit("repress")))
    shown = F.transform("sources", lambda s: F.concat(s["source"], F.lit(":"), s["n_edges"].cast("string")))
    sign = F.col("sign")
    return O.regulators(acting, tasks).select("design_id", "target", sign, F.array_join(shown, ",").alias("sources"), "n_edges")
