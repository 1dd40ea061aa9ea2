"""Isotonic and temperature calibration of class probabilities."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelens.operators import ordered
from wirelens.session import materialise

#: Score blocks that a task pools at once.
POOLED = 65_536
BLOCK = "cls int, x0 double, x1 double, hits long, weight long, part int"
#: A knot with the one after it, so that a lookup needs one row; null after the last.
KNOT = ["cls", "x", "y", "next_x", "next_y"]


def normalise(raw: Column, calibrated: Column) -> Column:
    """``calibrated`` scaled to sum one; ``raw`` where it sums to zero."""
    total = F.aggregate(calibrated, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(total > 0, F.transform(calibrated, lambda v: v / total)).otherwise(raw)


def _pool(rows: DataFrame, parts: int) -> DataFrame:
    """Neighbouring blocks of a class pooled inside each of ``parts`` ranges of scores until their means rise."""
    ranges = rows.drop("part").repartitionByRange(parts, "cls", "x0").sortWithinPartitions("cls", "x0")

    def run(batches):
        part = TaskContext.get().partitionId()
        stack: list[list] = []

        def out(blocks):
            columns = [*zip(*blocks, strict=True)] if blocks else [()] * 5
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)), pa.array([part] * len(blocks), pa.int32())],
                ["cls", "x0", "x1", "hits", "weight", "part"])

        for batch in batches:
            for cls, x0, x1, hits, weight in zip(*(batch.column(c).to_pylist() for c in ("cls", "x0", "x1", "hits", "weight")), strict=True):
                if stack and stack[-1][0] != cls:
                    yield out(stack)
                    stack = []
                stack.append([cls, x0, x1, hits, weight])
                # Integers, so equal means are equal; they are one block too.
                while len(stack) > 1 and stack[-2][3] * stack[-1][4] >= stack[-1][3] * stack[-2][4]:
                    last = stack.pop()
                    stack[-1][2] = last[2]
                    stack[-1][3] += last[3]
                    stack[-1][4] += last[4]
        yield out(stack)

    return ranges.mapInArrow(run, BLOCK)


def pooled_blocks(points: DataFrame, at_once: int = POOLED) -> DataFrame:
    """``BLOCK`` rows of the monotone fit to ``points`` (cls, x, hits, weight), in ranges of scores.

    Pooling neighbours whose means do not rise gives the same blocks in any order. So each
    range pools its own, then what is left is cut elsewhere (into one range more every
    other time), until no two blocks at a border are out of order. No task holds more
    than its range.
    """
    blocks = materialise(points.select("cls", F.col("x").alias("x0"), F.col("x").alias("x1"), "hits", "weight"))
    mean, turn = F.struct("hits", "weight"), 0
    while True:
        parts = 1 + blocks.count() // at_once
        blocks = materialise(_pool(blocks, parts + turn if parts > 1 else 1))
        turn = 1 - turn
        ends = blocks.groupBy("cls", "part").agg(F.min_by(mean, "x0").alias("first"), F.max_by(mean, "x0").alias("last"))
        before = F.lag("last").over(Window.partitionBy("cls").orderBy("part"))  # a row a range
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        ends = ends.withColumn("before", before).filter(
            wide("before.hits") * wide("first.weight") >= wide("first.hits") * wide("before.weight"))
        if ends.isEmpty():
            return blocks


def knots_of(blocks: DataFrame) -> DataFrame:
    """``KNOT`` rows: both ends of every block, once if they are one."""
    knots = blocks.select("cls", "part", F.explode(F.array_distinct(F.array("x0", "x1"))).alias("x"), (F.col("hits") / F.col("weight")).alias("y"))
    knots = knots.withColumn("_down", -F.col("x"))
    found = ordered.lagged(knots, ["cls"], ["_down"], -F.col("part"), ["x", "y"])
    return found.select("cls", "x", "y", F.col("prev_x").alias("next_x"), F.col("prev_y").alias("next_y"))


def knot_table(spark: SparkSession, knots: list[dict[str, list[float]]]) -> DataFrame:
    """``KNOT`` rows of written-out knots, one dictionary of ``x`` and ``y`` a class."""
    rows = []
    for cls, k in enumerate(knots):
        points = list(zip(map(float, k["x"]), map(float, k["y"]), strict=True))
        rows += [(cls, *p, *q) for p, q in zip(points, [*points[1:], (None, None)], strict=False)]
    return spark.createDataFrame(rows, "cls int, x double, y double, next_x double, next_y double")


def fit_isotonic(scored: DataFrame, classes: int, at_once: int = POOLED) -> DataFrame:
    """``KNOT`` rows: one monotone fit per class on (probability, is that class).

    Equal scores are one point with their weight. A class absent from the fold, or the
    only one in it, keeps the identity; an empty fold gives no knots.
    """
    spark = scored.sparkSession
    present = {r["label"] for r in scored.select("label").distinct().collect()}  # at most `classes` rows
    fitted = [i for i in range(classes) if i in present and len(present) > 1]
    plain = [i for i in range(classes) if i not in fitted] if present else []
    points = scored.select("label", F.posexplode("probabilities").alias("cls", "x")).filter(F.col("cls").isin(fitted) if fitted else F.lit(False))
    points = points.groupBy("cls", "x").agg(F.count_if(F.col("label") == F.col("cls")).alias("hits"), F.count(F.lit(1)).alias("weight"))
    knots = knot_table(spark, [{"x": [0.0, 1.0], "y": [0.0, 1.0]} if i in plain else {"x": [], "y": []} for i in range(classes)])
    return materialise(knots_of(pooled_blocks(points, at_once)).unionByName(knots)) if fitted else knots


def interpolated(values: DataFrame, knots: DataFrame, parts: int | None = None) -> DataFrame:
    """``values`` (cls, p, each once) with ``v``: clamped linear interpolation between the knots around ``p``.

    An as-of join: knots and values lie in common ranges, cut at quantiles of both, and the
    last knot of a range is carried into the next. A class without knots gives null.
    """
    at = knots.select("cls", F.col("x").alias("p"), F.lit(0).alias("side"), F.struct("x", "y", "next_x", "next_y").alias("knot"))
    asked = values.select("cls", "p", F.lit(1).alias("side"), F.lit(None).cast(at.schema["knot"].dataType).alias("knot"))
    order = ["cls", "p", "side"]
    both = at.unionByName(asked)
    both = both.repartitionByRange(parts, *order) if parts else both.repartitionByRange(*order)
    both = materialise(both.withColumn("_part", F.spark_partition_id()))
    found = ordered.last_value(both, ["cls"], ["p", "side"], F.col("_part"), "knot", "hit").filter("side = 1")
    lowest = knots.groupBy("cls").agg(F.min_by("y", "x").alias("_low"))  # a row a class
    k = F.col("hit")
    slope = k["y"] + (k["next_y"] - k["y"]) * (F.col("p") - k["x"]) / (k["next_x"] - k["x"])
    value = F.when(k.isNull(), F.col("_low")).when(k["next_x"].isNull(), k["y"]).otherwise(slope)
    return found.join(F.broadcast(lowest), "cls", "left").select("cls", "p", value.alias("v"))


def apply_knots(df: DataFrame, knots: DataFrame | None, column: str = "probabilities") -> DataFrame:
    """Calibrate an array of class probabilities by ``KNOT`` rows, however many; null arrays stay null.

    Each distinct (class, probability) is looked up once. Without knots nothing changes.
    """
    if knots is None or knots.isEmpty():
        return df
    row = "_row"
    rows = materialise(df.withColumn(row, F.monotonically_increasing_id()))
    long = rows.select(row, F.posexplode(column).alias("cls", "p"))
    found = interpolated(long.select("cls", "p").distinct(), knots)
    back = long.join(found, ["cls", "p"]).groupBy(row).agg(F.array_sort(F.collect_list(F.struct("cls", "v"))).alias("_cal"))
    out = rows.join(back, row, "left").withColumn("_cal", F.col("_cal.v"))
    return out.withColumn(column, normalise(F.col(column), F.col("_cal"))).select(*df.columns)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp((v - top) / t))
    total = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / total)


def apply_temperature(df: DataFrame, temperature: float, column: str = "logits") -> DataFrame:
    return df.withColumn("probabilities", softmax(F.col(column), temperature))


def _scaled_exp(top: Column, t: float):
    return lambda v: F.exp((v - top) / t)


def nll_by_temperature(scored: DataFrame, log_ts: list[float]) -> DataFrame:
    """(log_t, nll): the summed loss at each candidate, all in one pass over the rows."""
    top = F.array_max("logits")
    own = F.get("logits", F.col("label"))
    sums = []
    for j, lt in enumerate(log_ts):
        t = math.exp(lt)
        z = F.aggregate(F.transform("logits", _scaled_exp(top, t)), F.lit(0.0), lambda acc, v: acc + v)
        sums.append(F.sum(F.log(z) - (own - top) / t).alias(f"n{j}"))
    one = scored.agg(*sums)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(lt).alias("log_t"), F.col(f"n{j}").alias("nll")) for j, lt in enumerate(log_ts)
    ])).alias("s")).select("s.*")


def fit_temperature(scored: DataFrame, steps: int = 21, rounds: int = 4) -> float:
    """Temperature with the least loss; 1.0 for an empty or error-free fold.

    ``scored``: logits array, integer label. Each round is one aggregation with
    one row back; the grid narrows around the best value.
    """
    best = F.expr("array_position(logits, array_max(logits)) - 1")
    state = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(best != F.col("label")).alias("wrong")).first()
    if state["n"] == 0 or state["wrong"] == 0:
        return 1.0
    lo, hi, at = math.log(0.05), math.log(20.0), 0.0
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]
        rows = nll_by_temperature(scored, grid).collect()  # `steps` rows
        at = min(rows, key=lambda r: (r["nll"], r["log_t"]))["log_t"]
        width = (hi - lo) / (steps - 1)
        lo, hi = at - width, at + width
    return math.exp(at)
