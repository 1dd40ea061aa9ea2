"""Importance resampling towards a target: hashed n-gram weights, Gumbel keys, exact selection without a full sort."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm.common import Scratch

#: Word separators; everything else is part of a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Ascending, a document's key: higher score, smaller id (null last), then content and place for equal ids.
KEY = ("k_score", "k_null", "k_id", "k_tie", "k_place")
#: When so few keys remain, the rest of the selection is one sort of them.
REST = 1000


@dataclass(frozen=True)
class Draw:
    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7


def _words(text: str) -> F.Column:
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, GAP), "")


def _bucket(feature: F.Column, buckets: int) -> F.Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def _pairs(words: str, value) -> F.Column:
    """``value`` of each two neighbouring words, joined by a space."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: value(F.concat(a, F.lit(" "), b)))


def bucket_counts(docs: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """bucket, n: occurrences of one- and two-word features of all rows of ``docs`` (text) by hash bucket."""
    rows = docs.select(_words("text").alias("words"))
    # A row a word with its follower, of which each gives two buckets: all in generated code.
    rows = rows.select(F.explode(F.arrays_zip("words", F.slice("words", F.lit(2), F.size("words")).alias("next"))).alias("w"))
    rows = rows.select(F.explode(F.array(_bucket(F.col("w.words"), draw.buckets), _bucket(F.concat("w.words", F.lit(" "), "w.next"), draw.buckets))).alias("bucket"))
    return rows.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """bucket, gain of every bucket: 1000 times the log of its smoothed share in ``target`` over that in ``docs``, floored."""
    spark = docs.sparkSession
    held = bucket_counts(docs, draw).select(F.col("bucket").alias("id"), F.col("n").alias("s"))
    held = spark.range(draw.buckets).join(held, "id", "left").join(
        bucket_counts(target, draw).select(F.col("bucket").alias("id"), F.col("n").alias("t")), "id", "left").fillna(0, ["s", "t"])
    everything = Window.partitionBy()  # one row a bucket
    of = lambda c, extra: (F.col(c) + extra).cast("double")
    share = of("t", 1) * (F.sum("s").over(everything) + draw.buckets).cast("double") / (of("s", 1) * (F.sum("t").over(everything) + draw.buckets).cast("double"))
    return held.select(F.col("id").cast("int").alias("bucket"), F.floor(1000 * F.ln(share)).cast("long").alias("gain"))


def weigh(docs: DataFrame, table: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and the KEY columns of every row of ``docs`` (doc_id, text).

    ``table`` (bucket, gain) becomes one array, in which each feature's gain is looked up
    where the text is: no feature is shuffled.
    """
    values = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"])
    rows = docs.select(F.col("doc_id").cast("long"), _words("text").alias("_words"), F.xxhash64("text").alias("_hash"))
    rows = rows.withColumn("_gains", table.agg(values.alias("gains")).scalar())
    gain = lambda feature: F.get("_gains", _bucket(feature, draw.buckets))
    total = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda x, y: x + y)
    rows = rows.withColumn("_sum", total(F.transform("_words", gain)) + total(_pairs("_words", gain)))
    n_words = F.size("_words").cast("long")
    rows = rows.select("doc_id", n_words.alias("n_words"), F.greatest(2 * n_words - 1, F.lit(0)).alias("n_features"), "_sum", "_hash")
    rows = rows.withColumn("weight", F.expr("if(n_features = 0, 0L, (_sum - pmod(_sum, n_features)) div n_features)"))
    name = F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    rows = rows.withColumn("score", F.col("weight") + noise)
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", (-F.col("score")).alias("k_score"), F.col("doc_id").isNull().alias("k_null"),
                       F.coalesce("doc_id", F.lit(0)).alias("k_id"), F.col("_hash").alias("k_tie"), F.monotonically_increasing_id().alias("k_place"))


def _key() -> F.Column:
    return F.struct(*KEY)


def _value(key) -> F.Column:
    return F.struct(*(F.lit(key[c]).alias(c) for c in KEY))


def sorted_runs(rows: DataFrame) -> DataFrame:
    """The KEY columns of ``rows`` with ``run`` and ``at``: each partition sorted where it lies, and places in it."""
    serial = F.monotonically_increasing_id()
    rows = rows.select(*KEY).sortWithinPartitions(*KEY).withColumn("_serial", serial)
    return rows.select(*KEY, F.shiftright("_serial", 33).alias("run"), F.expr("_serial & 8589934591").alias("at"))


def cutoff(runs: DataFrame, k: int, rest: int = REST):
    """The key of rank ``k`` (from 1) among the rows of ``runs`` (see ``sorted_runs``).

    In each round every run gives the median of its keys that remain, found by its
    place; the median of these, weighted by how many remain, has at least about a
    quarter of all that remain on either side, and one side goes. Only two keys and
    three counts come to the driver. Runs are sorted, so bounds on the score skip
    parts of files.
    """
    low = high = None
    n = runs.count()
    while True:
        left = runs
        if low is not None:
            left = left.filter((F.col("k_score") >= low["k_score"]) & (_key() > _value(low)))
        if high is not None:
            left = left.filter((F.col("k_score") <= high["k_score"]) & (_key() <= _value(high)))
        if n <= rest:
            return left.orderBy(*KEY).limit(k).agg(F.max(_key()).alias("key")).first()["key"]
        spans = left.groupBy("run").agg(F.count("*").alias("n"), F.min("at").alias("first"))
        spans = spans.select("run", "n", (F.col("first") + F.expr("(n - 1) div 2")).alias("at"))
        medians = left.join(spans, ["run", "at"]).select(_key().alias("key"), "n")  # a row a run
        before = F.sum("n").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
        pivot = medians.select("key", before.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
        pivot = pivot.filter("2 * upto >= all").agg(F.min("key").alias("key")).first()["key"]
        under = left.filter(_key() <= _value(pivot)).count()
        if k <= under:
            high, n = pivot, under
        else:
            low, n, k = pivot, n - under, k - under


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text), drawn towards the texts of ``target`` (text).

    Of the N rows with at least ``least_words`` words, the floor(percent * N / 100) highest
    scores get ranks from 1, ties by smaller id; the others have a null rank. Repeated
    rows count each; rows alike in score and id rank by content. A null id ranks last among
    its ties and draws its noise as an empty name; null and empty texts have no features,
    weight 0, and are not drawn unless ``least_words`` is 0. An empty table gives no
    rows, an empty target weighs by rarity alone. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    table = scratch.keep(gains(docs, target, draw), "gains")
    rows = scratch.keep(weigh(docs, table, draw), "scored")
    scratch.drop("gains")
    fit = F.col("n_words") >= draw.least_words
    runs = scratch.keep(sorted_runs(rows.filter(fit)), "runs")
    k = runs.count() * draw.percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*out, unranked)
    last = cutoff(runs, k)
    scratch.drop("runs")
    drawn = fit & (_key() <= _value(last))
    winners = rows.filter(drawn).repartitionByRange(*KEY).sortWithinPartitions(*KEY).select(*out, F.monotonically_increasing_id().alias("_serial"))
    winners = scratch.keep(winners.select(*out, F.shiftright("_serial", 33).alias("_run"), F.expr("_serial & 8589934591").alias("_at")), "winners")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = winners.groupBy("_run").agg(F.count("*").alias("n")).select("_run", before.alias("_before"))  # a row a run
    winners = winners.join(starts, "_run").select(*out, (F.col("_before") + F.col("_at") + 1).alias("rank"))
    return winners.unionByName(rows.filter(~drawn).select(*out, unranked))
