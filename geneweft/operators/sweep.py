"""Truth tables, sweep grids, reproducible parameter noise and the result memo."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geneweft.functions.values import canonical_json


#: Inputs that one task expands when a truth table is dealt over tasks: 2^10 states.
LOW_BITS = 10


def counted(bits: Column) -> Column:
    """The numbers of ``bits`` bits in order."""
    return F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)


def truth_table(designs: DataFrame, inputs: str = "inputs", tasks: int | None = None, low_bits: int = LOW_BITS) -> DataFrame:
    """All 0/1 assignments of each design's inputs in order; a design without inputs has one default state.

    Without ``tasks`` every design is expanded where it stands. With it, the bits above the lowest ``low_bits``
    are expanded first, these blocks are dealt over so many tasks, and the low bits follow there: no task makes more
    than its share of a design with many inputs. ``state_index`` keeps the order.
    """
    names = F.coalesce(F.col(inputs), F.array().cast("array<string>"))
    n = F.size(names)
    if tasks is None:
        numbered = designs.withColumn("_n", n).withColumn("_i", F.explode(counted(n)))
    else:
        low = F.least(F.col("_n"), F.lit(low_bits))
        blocks = designs.withColumn("_n", n).withColumn("_high", F.explode(counted(F.col("_n") - low)))
        numbered = (
            blocks.repartition(tasks)
            .withColumn("_low", F.explode(counted(low)))
            .withColumn("_i", F.col("_high") * (1 << low_bits) + F.col("_low"))
            .drop("_high", "_low")
        )
    bits = F.lpad(F.bin(F.col("_i")), F.col("_n"), F.lit("0"))
    values = F.transform(
        F.sequence(F.lit(1), F.col("_n")), lambda p: F.substring(bits, p, F.lit(1)).cast("double")
    )
    none = F.create_map().cast("map<string,double>")
    return (
        numbered.withColumn("state_name", F.when(F.col("_n") == 0, F.lit("default_state")).otherwise(F.concat(bits, F.lit("_state"))))
        .withColumn("state_inputs", F.when(F.col("_n") == 0, none).otherwise(F.map_from_arrays(names, values)))
        .withColumnRenamed("_i", "state_index")
        .drop("_n")
    )


def sweep_grid(states: DataFrame, n_samples: int = 50) -> DataFrame:
    """One row per (design, state, sample); samples are generated in place, nothing is joined or shuffled."""
    return states.withColumn("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_samples - 1).cast("long"))))


def stimuli_for_states(vectors: DataFrame, amp: float = 50000.0, duration: float = 100000.0) -> DataFrame:
    """A long pulse for every input that is on and an empty one for every input that is off."""
    pulse = lambda _, bit: F.struct(
        F.lit("pulse").alias("type"),
        F.lit(0.0).alias("start"),
        F.lit(float(duration)).alias("duration"),
        F.when(bit > 0, F.lit(float(amp))).otherwise(F.lit(0.0)).alias("amp"),
        F.lit(None).cast("double").alias("freq"),
    )
    return vectors.withColumn("stimuli", F.transform_values("state_inputs", pulse))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from a text key, the same on every run and partitioning."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def standard_normal(*parts: Column) -> Column:
    """A normal draw keyed by its parts (Box-Muller over two keyed uniforms)."""
    key = F.concat_ws(",", *[p.cast("string") for p in parts])
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(F.concat(key, F.lit(",u")))))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(F.concat(key, F.lit(",v"))))


def noisy_parameters(params: DataFrame, sigma: float = 0.15, n: int = 50, seed: int = 0) -> DataFrame:
    """Each parameter of (design_id, key, value) multiplied by N(1, sigma) for ``n`` samples, at least 1e-10.

    Without noise values are copied; null values (not numeric) stay null.
    """
    rows = sweep_grid(params, n)
    if sigma <= 0.0:
        return rows.withColumn("noisy_value", F.col("value"))
    draw = standard_normal(F.col("design_id"), F.col("sample_id"), F.col("key"), F.lit(seed))
    scaled = F.col("value") * (F.lit(1.0) + F.lit(float(sigma)) * draw)
    return rows.withColumn("noisy_value", F.when(F.col("value").isNotNull(), F.greatest(scaled, F.lit(1e-10))))


def memo_key(df: DataFrame, json_columns: list[str], scalar_columns: list[str], out: str = "memo_key") -> DataFrame:
    """Hash of the canonical JSON of all inputs of a run."""
    parts = [F.coalesce(canonical_json(F.col(c)), F.lit("null")) for c in json_columns]
    parts += [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in scalar_columns]
    return df.withColumn(out, F.sha2(F.concat_ws(",", *parts), 256))


def pending_runs(grid: DataFrame, store: DataFrame | None, key: str = "memo_key") -> DataFrame:
    """Runs whose key has no stored result, each once; without a store all are pending."""
    rest = [c for c in grid.columns if c != key]
    runs = grid.distinct()  # exact copies collapse before anything is moved
    if rest:
        runs = runs.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")
    return runs if store is None else runs.join(store.select(key).distinct(), key, "left_anti")


def apply_focus(params: DataFrame, focus: str = "focus", column: str = "params") -> DataFrame:
    """Adjust a parameter map for the focus of a request."""
    f = F.lower(F.trim(F.coalesce(F.col(focus), F.lit(""))))
    leak = F.when(f == "leakage", F.lit(0.08)).when(f == "toxicity", F.lit(0.04)).otherwise(F.lit(0.02))
    factor = {"transcription_rate": 1.35, "translation_rate": 1.25}

    def scaled(key: Column, value: Column) -> Column:
        grown = value
        for name, by in factor.items():
            grown = F.when((key == name) & (f == "toxicity"), value * F.lit(by)).otherwise(grown)
        return grown

    base = F.map_filter(F.transform_values(column, scaled), lambda key, _: key != "leakage")
    return params.withColumn(column, F.map_concat(base, F.create_map(F.lit("leakage"), leak)))


def merge_states(results: DataFrame) -> DataFrame:
    """States of one sample brought together: (design, sample) with a map of state to level and the state count."""
    return results.groupBy("design_id", "sample_id").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("state_name", "value")))).alias("levels"),
        F.countDistinct("state_name").alias("n_states"),
    )
