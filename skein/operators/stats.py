"""Aggregations over extraction logs: bands, paired runs, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.turns import turn_band

# Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom; beyond, the normal's.
T_95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
Z_95 = 1.96


def token_bands(log: DataFrame) -> DataFrame:
    """Calls, tokens and their mean a call (4 decimals, half to even) by band of turns and arm."""
    own = log.groupBy(turn_band(F.col("turn_no")).alias("band"), "arm").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
    return own.withColumn("per_call", F.bround(F.col("tokens") / F.col("calls"), 4))


def matched_turns(log: DataFrame, runs: int) -> DataFrame:
    """Turns in which all runs made the same number of calls."""
    return log.where("calls > 0").groupBy("turn_no").agg(F.count("run").alias("_r"), F.min("calls").alias("calls"), F.max("calls").alias("_m")).where((F.col("_r") == runs) & (F.col("calls") == F.col("_m"))).select("turn_no", "calls")


def population_turns(log: DataFrame, runs: int) -> DataFrame:
    """Turns in which every run made a call."""
    return log.where("calls > 0").groupBy("turn_no").agg(F.countDistinct("run").alias("_r")).where(F.col("_r") == runs).select("turn_no")


def paired_deltas(log: DataFrame, turns: DataFrame) -> DataFrame:
    """Mean tokens a call of both arms in each turn, and B less A."""
    per = (F.col("tokens") / F.col("calls"))
    own = log.join(turns.select("turn_no"), "turn_no").groupBy("turn_no").agg(F.avg(F.when(F.col("arm") == "A", per)).alias("a"), F.avg(F.when(F.col("arm") == "B", per)).alias("b"), F.sum("calls").alias("weight"))
    return own.withColumn("delta", F.col("b") - F.col("a"))


def paired_summary(deltas: DataFrame, noise_floor: float = 5.0) -> DataFrame:
    """n, means, median, deviation, effect size, 95 % interval, and whether the arms can be told apart."""
    own = deltas.agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.median("delta").alias("median"), F.stddev_samp("delta").alias("stdev"), (F.sum(F.col("delta") * F.col("weight")) / F.sum("weight")).alias("weighted_mean"))
    t = F.when(F.col("n") - 1 > len(T_95), F.lit(Z_95)).otherwise(F.try_element_at(F.array(*map(F.lit, T_95)), F.greatest(F.col("n") - 1, F.lit(1)).cast("int")))
    own = own.withColumn("_h", t * F.col("stdev") / F.sqrt("n")).withColumn("low", F.col("mean") - F.col("_h")).withColumn("high", F.col("mean") + F.col("_h"))
    apart = (F.col("n") >= 10) & ((F.col("low") > 0) | (F.col("high") < 0)) & (F.abs("mean") > noise_floor)
    return own.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "stdev", "weighted_mean", "low", "high")), F.round(F.col("mean") / F.col("stdev"), 6).alias("effect"), F.coalesce(apart, F.lit(False)).alias("separable"))


def prior_divergence(log: DataFrame) -> DataFrame:
    """Turns before which the runs' running token sums differ."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    own = log.withColumn("prior", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    return own.groupBy("turn_no").agg(F.countDistinct("prior").alias("states")).where("states > 1")


def last_status(log: DataFrame) -> DataFrame:
    """Turns whose last told status (key, ord, ok; null tells none) is a failure."""
    return log.where("ok is not null").groupBy("key").agg(F.max_by("ok", "ord").alias("ok"), F.max("ord").alias("last_ord")).where("not ok").select("key", "last_ord")


def retention(before: DataFrame, after: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Retained, removed and added ids by type and in all (type null), and whether removals pass the threshold."""
    both = before.select("id", "type", F.lit(1).alias("_a")).join(after.select("id", F.col("type").alias("_type"), F.lit(1).alias("_b")), "id", "full")
    own = both.withColumn("type", F.coalesce("type", "_type")).rollup("type").agg(F.count_if(F.expr("_a = 1 and _b = 1")).alias("retained"), F.count_if(F.expr("_b is null")).alias("removed"), F.count_if(F.expr("_a is null")).alias("added"))
    return own.withColumn("flagged", F.col("removed") > threshold * (F.col("retained") + F.col("removed")))


def phase_deltas(log: DataFrame, runs: int, per_call: bool = True) -> DataFrame:
    """By phase and turn the arms' mean tokens (a call, or in all) and their difference, over turns that are matched within the phase.

    log: run, arm, phase, turn_no, calls, tokens. A call: turns in which all runs made the same number of calls of the phase;
    in all: turns in which all runs made some. Weight: the calls of both arms.
    """
    own = log.where("calls > 0").groupBy("phase", "turn_no", "run", "arm").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
    value = F.col("tokens") / F.col("calls") if per_call else F.col("tokens").cast("double")
    mean = lambda arm: F.avg(F.when(F.col("arm") == arm, value))
    out = own.groupBy("phase", "turn_no").agg(F.count("*").alias("_r"), F.min("calls").alias("_lo"), F.max("calls").alias("_hi"), mean("A").alias("a"), mean("B").alias("b"), F.sum("calls").alias("weight"))
    out = out.where(F.col("_r") == runs)
    return (out.where("_lo = _hi") if per_call else out).select("phase", "turn_no", "a", "b", (F.col("b") - F.col("a")).alias("delta"), "weight")
