"""Design-run logs: decisions, routes, best designs, rounds and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geneweft.config import CANDIDATE_TEXT, CARRY_TEXT, DECISION_TEXT, DIALOGUE_TEXT, TRANSCRIPT_TEXT
from geneweft.functions.text import strip_fences
from geneweft.functions.values import is_json
from geneweft.operators.skew import index_points
from geneweft.schemas import DECISION

BLANK = " \n\r\t"


# --- decisions and routing ---------------------------------------------------------------


def parse_decision(df: DataFrame, response: str = "response", candidates: str = "candidates") -> DataFrame:
    """Decision columns out of a critic's JSON answer, with defaults, approval, choice and log line.

    ``candidates`` is an array of topologies. A PASS with an index outside it is approved
    without a choice and its feedback carries a warning. Text that is not JSON gives
    ``malformed`` and no decision.
    """
    cleaned = strip_fences(F.col(response))
    raw = F.from_json(cleaned, DECISION)
    malformed = ~(is_json(cleaned) & F.coalesce(cleaned.startswith("{"), F.lit(False)))
    d = df.withColumn("_d", raw).withColumn("malformed", malformed)
    decided = ~F.col("malformed")
    index = F.col("_d.selected_index").try_cast("double").try_cast("int")
    in_range = index.between(0, F.size(candidates) - 1)
    approved = (F.col("decision") == "PASS") & F.col("_d.selected_index").isNotNull()
    parsed = d.withColumns(
        {
            "decision": F.when(decided, F.coalesce("_d.decision", F.lit(DECISION_TEXT["decision"]))),
            "error_type": F.when(decided, F.coalesce("_d.error_type", F.lit(DECISION_TEXT["error_type"]))),
            "_said": F.when(decided, F.coalesce("_d.feedback", F.lit(DECISION_TEXT["feedback"]))),
            "recommended_ucf": F.col("_d.recommended_ucf"),
        }
    ).withColumn("approved", F.coalesce(approved, F.lit(False)))
    chosen = F.when(F.col("approved") & in_range, F.get(F.col(candidates), index))
    ucf = F.col("recommended_ucf")
    tags = F.concat(
        F.format_string(DECISION_TEXT["route"], F.col("decision"), F.col("error_type")),
        F.when(F.coalesce(ucf, F.lit("")) != "", F.format_string(DECISION_TEXT["ucf"], ucf)).otherwise(F.lit("")),
    )
    warning = F.format_string(DECISION_TEXT["warning"], F.col("_d.selected_index"))
    prefix = (
        F.when(~F.col("approved"), tags).when(F.coalesce(in_range, F.lit(False)), F.lit("")).otherwise(warning)
    )
    return (
        parsed.withColumn("selected_index", F.when(F.col("approved") & in_range, index))
        .withColumn("best_topology", chosen)
        .withColumn("feedback", F.concat(prefix, F.col("_said")))
        .drop("_d", "_said")
    )


def route(decisions: DataFrame, max_rounds: int = 3) -> DataFrame:
    """Next node of every decision row, by fixed priority.

    Needs has_human_feedback, error_type, approved, has_topology, current_round, has_fallback.
    """
    last = F.col("current_round") >= max_rounds
    to_builder = F.when(last, F.lit("Human_in_Loop")).otherwise(F.lit("Builder"))
    node = (
        F.when(F.col("has_human_feedback"), to_builder)
        .when(((F.col("error_type") == "NONE") | F.col("approved")) & F.col("has_topology"), F.lit("Consolidator"))
        .when(F.col("error_type").isin("LOGIC_ERROR", "BOTH") & ~last, F.lit("Builder"))
        .when((F.col("error_type") == "PART_ERROR") & ~last, F.lit("Translator"))
        .when(last & F.col("has_fallback"), F.lit("Consolidator"))
        .when(last, F.lit("Failed"))
        .otherwise(F.lit("Builder"))
    )
    return decisions.withColumn("next_node", node)


def route_counts(routed: DataFrame, keys: tuple[str, ...] = ("current_round",)) -> DataFrame:
    return routed.groupBy(*keys, "next_node").agg(F.count(F.lit(1)).alias("n"))


# --- choosing designs --------------------------------------------------------------------


def best_design(iterations: DataFrame, key: str = "run_id") -> DataFrame:
    """Highest positive score, first iteration on ties; no design where nothing beats 0."""
    positive = F.col("score") > 0
    rank = F.when(positive, F.struct(F.col("score"), -F.col("iteration")))
    return iterations.groupBy(key).agg(
        F.max_by("design", rank).alias("best_design"),
        F.greatest(F.coalesce(F.max("score"), F.lit(0)), F.lit(0)).cast("double").alias("best_score"),
        F.max("iteration").alias("iterations"),
    )


def fallback_design(results: DataFrame, key: str = "run_id") -> DataFrame:
    """Highest score among results without error, last on ties; position 0 where none is valid.

    results: (run_id, pos, score, fold_change, error[, has_topology]) with scores as text.
    """
    has_topology = F.col("has_topology") if "has_topology" in results.columns else F.lit(True)
    valid = F.col("error").isNull()
    number = F.coalesce(F.coalesce(F.col("score"), F.col("fold_change"), F.lit("0")).try_cast("double"), F.lit(0.0))
    number = F.when(~F.isnan(number), number)  # a score that is not a number beats nothing
    rank = F.when(valid & has_topology, F.struct(number, F.col("pos")))
    return results.groupBy(key).agg(
        F.coalesce(F.max_by("pos", rank), F.when(~F.coalesce(F.max(valid & has_topology), F.lit(False)), F.lit(0))).alias("chosen_pos"),
        F.count_if(valid).alias("n_valid"),
    )


def zip_by_position(left: DataFrame, right: DataFrame, key: str = "run_id", pos: str = "pos") -> DataFrame:
    """Rows of both sides at the same position; the longer side is cut."""
    return left.join(right, [key, pos])


def best_so_far(iterations: DataFrame, target: float = 80.0, max_iter: int = 3, key: str = "run_id") -> DataFrame:
    """Iterations up to the first at or above the target (or the limit), with the best score so far.

    The limit comes first, so a window holds at most ``max_iter`` rows.
    """
    order = Window.partitionBy(key).orderBy("iteration")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    hits = F.sum(F.when(F.col("score") >= target, 1).otherwise(0)).over(upto)
    own = F.when(F.col("score") >= target, 1).otherwise(0)
    return (
        iterations.where(F.col("iteration") <= max_iter)
        .withColumn("_earlier", hits - own)
        .withColumn("best_score", F.greatest(F.max("score").over(upto), F.lit(0)))
        .where("_earlier = 0")
        .drop("_earlier")
    )


def latest_feedback(runs: DataFrame, log: DataFrame, key: str = "run_id", seq: str = "seq") -> DataFrame:
    """Last feedback of every run; null where there is none."""
    last = log.groupBy(key).agg(F.max_by("feedback", seq).alias("latest_feedback"))
    return runs.select(key).distinct().join(last, key, "left")


# --- rounds and transcripts --------------------------------------------------------------


def number_rounds(turns: DataFrame, key: str = "session_id", turn: str = "turn") -> DataFrame:
    """Round number of every turn of a session, from 1 in turn order."""
    numbered = index_points(turns, [key], [turn], "_seq", None)
    return numbered.withColumn("round_number", F.col("_seq") + 1).drop("_seq")


def append_rounds(history: DataFrame, new: DataFrame) -> DataFrame:
    return history.unionByName(new, allowMissingColumns=True)


def round_records(turns: DataFrame, key: str = "session_id") -> DataFrame:
    """One row per round with the builder's and the critic's text; the last turn of a role wins."""
    return turns.groupBy(key, "round_number").agg(
        F.max_by("text", F.when(F.col("role") == "builder", F.col("turn"))).alias("builder_output"),
        F.max_by("text", F.when(F.col("role") == "critic", F.col("turn"))).alias("critic_output"),
    )


def render_transcript(rounds: DataFrame, key: str = "session_id", labels: dict[str, str] = TRANSCRIPT_TEXT) -> DataFrame:
    """Readable text of every session as ordered lines (session_id, pos, line), one per round.

    rounds: (session_id, round_number from 1, builder_output, critic_output). The session
    header opens the first. A session has as many rows as rounds, however long it is; whoever
    needs one text joins the lines by newline.
    """
    number = F.col("round_number").cast("long")
    header = F.format_string(labels["session"].replace("%d", "%s"), F.col(key).cast("string"))
    body = F.concat_ws(
        "\n",
        F.when(number == 1, header),
        F.format_string(labels["round"], number),
        F.lit(labels["builder"]),
        F.coalesce("builder_output", F.lit("")),
        F.lit(labels["critic"]),
        F.coalesce("critic_output", F.lit("")),
    )
    return rounds.select(key, (number - 1).alias("pos"), body.alias("line"))


def carry_intent(df: DataFrame, labels: dict[str, str] = CARRY_TEXT) -> DataFrame:
    """Intent with a new condition appended; ``source`` is user or oracle, a blank condition is rejected."""
    condition = F.when(F.col("source") == "oracle", F.coalesce("condition", F.lit(""))).otherwise(
        F.trim(F.coalesce("condition", F.lit("")), F.lit(BLANK))
    )
    label = F.when(F.col("source") == "oracle", F.lit(labels["oracle"])).otherwise(F.lit(labels["user"]))
    carried = F.concat(F.rtrim(F.col("intent"), F.lit(BLANK)), label, condition)
    blank = condition == ""
    return df.withColumn("new_intent", F.when(~blank, carried)).withColumn(
        "error", F.when(blank, F.lit("blank condition"))
    )


NO_CANDIDATES = "ERROR: no candidate topologies or simulation results"


def candidate_sections(
    runs: DataFrame, topologies: DataFrame, results: DataFrame, key: str = "run_id", labels: dict[str, str] = CANDIDATE_TEXT
) -> DataFrame:
    """One row per candidate in order (run_id, pos, section); an error text at position 0 where a side is empty."""
    both = zip_by_position(topologies.select(key, "pos", "topology"), results.select(key, "pos", "result"), key)
    section = F.concat(
        F.format_string(labels["index"], F.col("pos").cast("long")),
        F.format_string(labels["topology"], F.col("topology")),
        F.format_string(labels["result"], F.col("result")),
    )
    sections = both.select(key, F.col("pos").cast("long").alias("pos"), section.alias("section"))
    return (
        runs.select(key)
        .distinct()
        .join(sections, key, "left")
        .select(key, F.coalesce("pos", F.lit(0).cast("long")).alias("pos"), F.coalesce("section", F.lit(NO_CANDIDATES)).alias("section"))
    )


def experiment_summary(iterations: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per experiment: metadata with best design, score and iteration count (keyed by run_id)."""
    return metadata.join(best_design(iterations), "run_id", "left")


def experiment_dialogue(rounds: DataFrame) -> DataFrame:
    """What was said in every round of an experiment, as ordered lines (run_id, pos, line)."""
    def said(role: str, text: str) -> Column:
        line = F.format_string(DIALOGUE_TEXT[role], F.col("round_number").cast("long"), F.col(text))
        return F.when(F.col(text).isNotNull(), line)

    line = F.concat_ws("\n\n", said("builder", "builder_output"), said("critic", "critic_output"))
    return rounds.select("run_id", (F.col("round_number").cast("long") - 1).alias("pos"), line.alias("line"))


# --- error flags -------------------------------------------------------------------------


def failure_flags(items: DataFrame, failed: Column, key: str) -> DataFrame:
    """Whether any and whether all items of a group failed."""
    return items.groupBy(key).agg(
        F.bool_or(failed).alias("any_failed"), F.bool_and(failed).alias("all_failed")
    )
