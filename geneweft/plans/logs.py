"""Queries over run logs: decisions, routes, designs, rounds and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from geneweft.functions.values import experiment_id
from geneweft.operators import runs as O
from geneweft.plans import views as V
from geneweft.plans.registry import query, table
from geneweft.sources.sinks import package_skills

# --- decisions ---------------------------------------------------------------------------


def answers(spark, sf):
    """Decisions as the critic's JSON answers, a third of them fenced; answers to German texts are cut off."""
    body = F.to_json(
        F.struct(
            "decision", "error_type", "selected_index",
            F.when(F.col("run_id") % 5 == 0, F.lit("Eco2")).alias("recommended_ucf"),
            F.when(F.col("run_id") % 7 != 0, F.col("feedback")).alias("feedback"),
        )
    )
    fenced = F.when(F.col("run_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    cut = F.when(F.col("run_id") % 11 == 0, F.substring(body, 1, 9)).otherwise(fenced)
    three = F.array(*[F.concat(F.lit(f"topology {i} of "), F.col("run_id")) for i in range(3)])
    return V.decisions(spark, sf).select("run_id", cut.alias("response"), three.alias("candidates"))


@query(
    "parse_decision",
    V.with_sql(V.DECISION_SQL)
    + """select run_id, run_id % 11 = 0 as malformed, case when run_id % 11 <> 0 then decision end as decision,
      case when run_id % 11 <> 0 then error_type end as error_type, run_id % 11 <> 0 and decision = 'PASS' as approved,
      case when run_id % 11 <> 0 and decision = 'PASS' and selected_index < 3 then selected_index end as selected_index,
      case when run_id % 11 <> 0 and decision = 'PASS' and selected_index < 3 then 'topology ' || selected_index || ' of ' || run_id end as best_topology,
      case when run_id % 11 <> 0 then (case when decision <> 'PASS' then '[ROUTE: ' || decision || '] [ERROR: ' || error_type || '] '
          || case when run_id % 5 = 0 then '[UCF: Eco2] ' else '' end
        when selected_index >= 3 then 'Warning: Valid PASS but invalid selected_index ' || selected_index || '. ' else '' end)
        || case when run_id % 7 = 0 then 'No feedback provided.' else feedback end end as feedback from t10""",
)
def _decision(spark, sf):
    return O.parse_decision(answers(spark, sf)).select(
        "run_id", "malformed", "decision", "error_type", "approved", "selected_index", "best_topology", "feedback"
    )


ROUTE_SQL = """routed as (select run_id, current_round, case
      when has_human_feedback then case when current_round >= 3 then 'Human_in_Loop' else 'Builder' end
      when (error_type = 'NONE' or decision = 'PASS') and coalesce(selected_index, 3) < 3 then 'Consolidator'
      when error_type in ('LOGIC_ERROR', 'BOTH') and current_round < 3 then 'Builder'
      when error_type = 'PART_ERROR' and current_round < 3 then 'Translator'
      when current_round >= 3 and run_id % 6 <> 0 then 'Consolidator' when current_round >= 3 then 'Failed' else 'Builder' end as next_node from t10)"""


def routed(spark, sf):
    rows = V.decisions(spark, sf).withColumns(
        {
            "approved": F.col("decision") == "PASS",
            "has_topology": F.coalesce(F.col("selected_index") < 3, F.lit(False)),
            "has_fallback": F.col("run_id") % 6 != 0,
        }
    )
    return O.route(rows)


@query("route", V.with_sql(V.DECISION_SQL, ROUTE_SQL) + "select run_id, next_node from routed")
def _route(spark, sf):
    return routed(spark, sf).select("run_id", "next_node")


@query(
    "route_counts",
    V.with_sql(V.DECISION_SQL, ROUTE_SQL) + "select current_round, next_node, count(*) as n from routed group by all",
)
def _route_counts(spark, sf):
    return O.route_counts(routed(spark, sf))


# --- designs -----------------------------------------------------------------------------

BEST_SQL = """best as (select run_id, arg_max(design, score * 1000000 - iteration) filter (score > 0) as best_design,
      cast(greatest(max(score), 0) as double) as best_score, max(iteration) as iterations from t9 group by all)"""


@query("best_design", V.with_sql(V.ITERATIONS_SQL, BEST_SQL) + "select * from best")
def _best(spark, sf):
    return O.best_design(V.iterations(spark, sf))


FALLBACK_EXPR = {
    "pos": "iteration - 1",
    "score": "case design % 4 when 0 then cast(score as string) when 1 then 'n/a' end",
    "fold_change": "cast(score as string)",
    "error": "case when design % 5 = 0 then 'failed' end",
}


@query(
    "fallback_design",
    V.with_sql(
        V.ITERATIONS_SQL,
        """scored as (select run_id, iteration - 1 as pos, case design % 4 when 1 then 0 else score end as s, design % 5 <> 0 as valid from t9)""",
    )
    + """select run_id, coalesce(arg_max(pos, s * 1000000 + pos) filter (valid), 0) as chosen_pos, count(*) filter (valid) as n_valid
      from scored group by all""",
)
def _fallback(spark, sf):
    """Score as text: given, not a number, or absent with only a fold change."""
    rows = V.iterations(spark, sf).selectExpr("run_id", *[f"{e} as {n}" for n, e in FALLBACK_EXPR.items()])
    return O.fallback_design(rows)


@query(
    "zip_by_position",
    """with l as (select o_custkey as run_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as pos, o_orderkey as design from orders),
      r as (select l_suppkey as run_id, l_linenumber as pos, max(l_extendedprice) as result from lineitem group by all)
    select run_id, pos, design, round(result, 6) as result from l join r using (run_id, pos)""",
)
def _zip(spark, sf):
    left = V.iterations(spark, sf).select("run_id", F.col("iteration").alias("pos"), "design")
    right = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("pos"))
        .agg(F.max("l_extendedprice").alias("result"))
    )
    return O.zip_by_position(left, right)


@query(
    "best_so_far",
    V.with_sql(V.ITERATIONS_SQL)
    + """select run_id, iteration, design, score, best_score from (select *, greatest(max(score) over w, 0) as best_score,
        coalesce(sum(case when score >= 80 then 1 else 0 end) over (w rows between unbounded preceding and 1 preceding), 0) as earlier
      from t9 where iteration <= 3 window w as (partition by run_id order by iteration)) where earlier = 0""".replace(
        "over (w rows between", "over (partition by run_id order by iteration rows between"
    ),
)
def _so_far(spark, sf):
    return O.best_so_far(V.iterations(spark, sf)).select("run_id", "iteration", "design", "score", "best_score")


# --- rounds and transcripts --------------------------------------------------------------


@query(
    "latest_feedback",
    V.with_sql(V.TURNS_SQL)
    + """select s.run_id, f.latest_feedback from (select distinct session_id as run_id from t6) s left join
      (select session_id as run_id, arg_max(text, turn) as latest_feedback from t6 where role = 'critic' group by all) f using (run_id)""",
)
def _latest(spark, sf):
    turns = V.turns(spark, sf).withColumnRenamed("session_id", "run_id")
    log = turns.where("role = 'critic'").select("run_id", F.col("turn").alias("seq"), F.col("text").alias("feedback"))
    return O.latest_feedback(turns, log)


@query(
    "number_rounds",
    V.with_sql(V.TURNS_SQL)
    + "select session_id, turn, row_number() over (partition by session_id order by turn) as round_number from t6",
)
def _number(spark, sf):
    return O.number_rounds(V.turns(spark, sf).select("session_id", "turn"))


ROUNDS_SQL = """rounds as (select session_id, round_number, arg_max(text, turn) filter (role = 'builder') as builder_output,
      arg_max(text, turn) filter (role = 'critic') as critic_output from t6 group by all)"""


@query(
    "round_records",
    V.with_sql(V.TURNS_SQL, ROUNDS_SQL) + "select * from rounds",
)
def _rounds(spark, sf):
    return O.round_records(V.turns(spark, sf))


def _quoted(text: str) -> str:
    return " || chr(10) || ".join(f"'{p}'" for p in text.split("\n"))


T = O.TRANSCRIPT_TEXT


@query(
    "render_transcript",
    V.with_sql(V.TURNS_SQL, ROUNDS_SQL)
    + f"""select session_id, round_number - 1 as pos, case when round_number = 1 then
      '{T['session'].split('%d')[0]}' || session_id || '{T['session'].split('%d')[1]}' || chr(10) else '' end
      || chr(10) || '{T['round'].strip().split('%d')[0]}' || round_number || '{T['round'].split('%d')[1]}' || chr(10)
      || {_quoted(T['builder'])} || chr(10) || coalesce(builder_output, '') || chr(10) || {_quoted(T['critic'])} || chr(10)
      || coalesce(critic_output, '') as line from rounds""",
)
def _transcript(spark, sf):
    return O.render_transcript(O.round_records(V.turns(spark, sf)))


@query(
    "append_rounds",
    """select conv_id, turn, role, cast(null as varchar) as condition from conversations
    union all select doc_id, 0, null, text from documents""",
)
def _append(spark, sf):
    history = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    new = table(spark, sf, "documents").select(
        F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.col("text").alias("condition")
    )
    return O.append_rounds(history, new)


BLANK = "' ' || chr(10) || chr(13) || chr(9)"


@query(
    "carry_intent",
    f"""select conv_id, turn, case when cond <> '' then rtrim(intent, {BLANK}) || case when turn % 2 = 0 then {_quoted(O.CARRY_TEXT['oracle'])}
        else {_quoted(O.CARRY_TEXT['user'])} end || cond end as new_intent, case when cond = '' then 'blank condition' end as error
      from (select conv_id, turn, text || '  ' || chr(10) as intent, case when turn % 3 = 0 then '' else role end as cond from conversations)""",
)
def _carry(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.concat(F.col("text"), F.lit("  \n")).alias("intent"),
        F.expr("case when turn % 3 = 0 then case when turn % 2 = 0 then '' else ' ' end else role end").alias("condition"),
        F.expr("case when turn % 2 = 0 then 'oracle' else 'user' end").alias("source"),
    )
    return O.carry_intent(rows).select("conv_id", "turn", "new_intent", "error")


C = O.CANDIDATE_TEXT


def _around(label: str, value: str) -> str:
    left, right = C[label].replace("%d", "%s").split("%s")
    return f"{_quoted(left)} || {value} || {_quoted(right)}"


@query(
    "candidate_sections",
    V.with_sql(V.TURNS_SQL)
    + f"""select r.run_id, coalesce(pos, 0) as pos, coalesce(section, '{O.NO_CANDIDATES}') as section from
      (select distinct conv_id as run_id from conversations) r left join (select run_id, pos,
        {_around('index', 'pos')} || {_around('topology', 'topology')} || {_around('result', 'result')} as section
      from (select session_id as run_id, round_number - 1 as pos, arg_max(text, turn) as topology from t6 where role = 'builder' group by all)
      join (select session_id as run_id, round_number - 1 as pos, arg_max(text, turn) as result from t6 where role = 'critic' group by all)
        using (run_id, pos)) s using (run_id)""",
)
def _sections(spark, sf):
    """Builder texts stand for topologies and critic texts for results."""
    rounds = O.round_records(V.turns(spark, sf)).withColumn("pos", F.col("round_number") - 1)
    rounds = rounds.withColumnRenamed("session_id", "run_id")
    topologies = rounds.where("builder_output is not null").select("run_id", "pos", F.col("builder_output").alias("topology"))
    results = rounds.where("critic_output is not null").select("run_id", "pos", F.col("critic_output").alias("result"))
    runs = table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"))
    return O.candidate_sections(runs, topologies, results)


@query(
    "experiment_summary",
    V.with_sql(V.ITERATIONS_SQL, BEST_SQL)
    + """select c.c_custkey as run_id, c_name as user_intent, best_design, best_score, iterations from customer c
      left join best on best.run_id = c.c_custkey""",
)
def _summary(spark, sf):
    metadata = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("user_intent"))
    return O.experiment_summary(V.iterations(spark, sf), metadata)


@query(
    "experiment_dialogue",
    V.with_sql(V.TURNS_SQL, ROUNDS_SQL)
    + """select session_id as run_id, round_number - 1 as pos, concat_ws(chr(10) || chr(10), '【Builder (Round ' || round_number || ')】' || chr(10)
      || builder_output, '【Critic (Round ' || round_number || ')】' || chr(10) || critic_output) as line from rounds""",
)
def _dialogue(spark, sf):
    return O.experiment_dialogue(O.round_records(V.turns(spark, sf)).withColumnRenamed("session_id", "run_id"))


@query(
    "experiment_id",
    """select o_orderkey, 'EXP-' || strftime(o_orderdate, '%Y%m%d') || '-' || upper(substr(md5(cast(o_orderkey as varchar)), 1, 6)) as experiment_id
      from orders""",
)
def _experiment(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", experiment_id(F.col("o_orderdate"), F.col("o_orderkey").cast("string")).alias("experiment_id")
    )


@query(
    "package_skills",
    """select 'exp ' || event_id || ':' || event_type as experiment_id, 'skill_exp_' || event_id || '-' || event_type || '.json' as file_id,
      '{"experiment_id":"exp ' || event_id || ':' || event_type || '"' || case when user_id % 2 = 0 then ',"user_intent":"' || event_type || '"' else '' end
      || ',"iterations":' || user_id || ',"skills":{"module_1_plausibility":{"has_skill":true'
      || case when user_id % 3 = 0 then ',"rule_summary":"' || event_type || '"' else '' end || '}}}' as package from events""",
)
def _package(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("exp "), "event_id", F.lit(":"), "event_type").alias("experiment_id"),
        F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("user_intent"),
        F.col("user_id").alias("iterations"),
        F.struct(
            F.struct(
                F.lit(True).alias("has_skill"), F.when(F.col("user_id") % 3 == 0, F.col("event_type")).alias("rule_summary")
            ).alias("module_1_plausibility")
        ).alias("skills"),
    )
    return package_skills(rows, ["experiment_id", "user_intent", "iterations"]).drop("record")
