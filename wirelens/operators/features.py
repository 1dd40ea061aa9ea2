"""The 74 features over whole pairs, and the six mode features; windows are in ``panes``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.functions import scalars
from wirelens.operators import ordered
from wirelens.operators.panes import BURST_GAP_US
from wirelens.session import materialise

PATH_MTU = 1500


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(0.0))


def _moments(prefix: str, value: Column, scale: float = 1.0) -> list[Column]:
    """Mean, std, min and max: mergeable, so reduced on the map side."""
    parts = {"mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value)}
    return [(c.cast("double") / scale).alias(f"{prefix}_{n}") for n, c in parts.items()]


def histogram_percentiles(hist: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Nearest-rank percentiles from a ``(keys, v, c)`` value histogram.

    ``bucket`` splits the cumulative count of wide value ranges over tasks.
    """
    cum = ordered.running_sum(hist, keys, ["v"], bucket, F.col("c"), "cum", "total")
    cols = []
    for p in dims.PERCENTILES:
        rank = scalars.nearest_rank(F.col("total"), p)
        hit = (F.col("cum") >= rank) & (F.col("cum") - F.col("c") < rank)
        cols.append(F.max(F.when(hit, F.col("v"))).cast("double").alias(f"p{p}"))
    return cum.groupBy(*keys).agg(*cols)


def pair_features(tagged: DataFrame, min_packets: int = 1) -> DataFrame:
    """The same 74 features over whole pairs instead of windows.

    A pair can hold a third of all rows, so nothing here sorts a whole pair in
    one task: moments are mergeable aggregates, gaps cross ten-second buckets by
    a carry, and percentiles are read off value histograms.
    """
    keys = ["capture_id", "pair_id"]
    base = tagged.select(*keys, "paired", "ts_us", "index",
                         F.coalesce("esp_payload_len", F.lit(0)).alias("length"), "up")
    length, up = F.col("length"), F.col("up")
    facts = base.groupBy(*keys).agg(
        F.max("paired").alias("paired"), F.count(F.lit(1)).alias("n"),
        F.sum("length").cast("double").alias("byte_count"),
        F.greatest(F.lit(1e-6), (F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration_s"),
        *_moments("esp_len", length), *_moments("up_len", F.when(up, length)),
        *_moments("down_len", F.when(~up, length)),
        *[F.avg(F.when(length % 16 == r, 1.0).otherwise(0.0)).alias(f"esp_len_mod16_{r}") for r in range(16)],
        F.count_if(up).cast("double").alias("up_packets"), F.count_if(~up).cast("double").alias("down_packets"),
        F.coalesce(F.sum(F.when(up, length)), F.lit(0)).cast("double").alias("_ub"),
        F.coalesce(F.sum(F.when(~up, length)), F.lit(0)).cast("double").alias("_db"),
    ).filter(F.col("n") >= min_packets)

    gaps = ordered.lagged(base.select(*keys, "ts_us", "index"), keys, ["ts_us", "index"],
                          F.expr("ts_us div 10000000"), ["ts_us"])
    gaps = gaps.select(*keys, (F.col("ts_us") - F.col("prev_ts_us")).alias("v")).filter("v is not null")
    burst = F.col("v") > BURST_GAP_US
    timing = gaps.groupBy(*keys).agg(
        *_moments("iat", F.col("v"), 1e6), F.count_if(burst).cast("double").alias("burst_count"),
        (F.sum(F.when(burst, F.col("v"))) / 1e6).alias("idle_total_s"),
        (F.avg(F.when(burst, F.col("v"))) / 1e6).alias("idle_mean_s"))

    # Packets and gaps reduce to counted values before anything is ordered.
    kinds = F.array(F.lit("esp_len"), F.when(up, "up_len").otherwise("down_len"))
    sizes = base.select(*keys, F.explode(kinds).alias("kind"), length.cast("bigint").alias("v")).unionByName(
        gaps.select(*keys, F.lit("iat").alias("kind"), "v"))
    hist = materialise(sizes.groupBy(*keys, "kind", "v").agg(F.count(F.lit(1)).alias("c")))
    wide = F.when(F.col("kind") == "iat", F.expr("v div 100000")).otherwise(F.expr("v div 4096"))
    pct = histogram_percentiles(hist, [*keys, "kind"], wide)
    shapes = pct.groupBy(*keys).agg(*[
        (F.max(F.when(F.col("kind") == kind, F.col(f"p{p}"))) / (1e6 if kind == "iat" else 1.0)).alias(f"{kind}_p{p}")
        for kind in ("esp_len", "up_len", "down_len", "iat") for p in dims.PERCENTILES
    ])
    modal = hist.filter("kind = 'esp_len'").groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("esp_len_distinct"),
        F.max_by(F.struct("v", "c"), F.struct("c", -F.col("v"))).alias("_modal"))

    out = facts.join(shapes, keys).join(modal, keys).join(timing, keys, "left")
    c = F.col
    out = out.withColumns({
        "esp_len_modal": c("_modal.v").cast("double"),
        "esp_len_modal_share": c("_modal.c") / c("n"),
        "packet_count": c("n").cast("double"),
        "packets_per_s": c("n") / c("duration_s"),
        "bytes_per_s": c("byte_count") / c("duration_s"),
        "iat_cv": _ratio(F.coalesce(c("iat_std"), F.lit(0.0)), F.coalesce(c("iat_mean"), F.lit(0.0))),
        "up_down_byte_ratio": _ratio(c("_ub"), c("_db")),
        "up_down_packet_ratio": _ratio(c("up_packets"), c("down_packets")),
        "sa_spi_count": F.when(c("paired"), 2.0).otherwise(1.0),
        "sa_paired": F.when(c("paired"), 1.0).otherwise(0.0),
    })
    return out.select(*keys, *[F.coalesce(c(f), F.lit(0.0)).alias(f) for f in dims.FEATURES])


def session_geometry(tagged: DataFrame) -> DataFrame:
    """(ip_version, min, max and modal length) per pair from a length histogram."""
    keys = ["capture_id", "pair_id"]
    hist = (
        tagged.filter(F.col("esp_payload_len").isNotNull())
        .groupBy(*keys, "esp_payload_len")
        .agg(F.count(F.lit(1)).alias("c"), F.max("ip_version").alias("ip_version"))
    )
    length = F.col("esp_payload_len")
    return hist.groupBy(*keys).agg(
        F.max("ip_version").alias("ip_version"),
        F.min(length).alias("min_len"),
        F.max(length).alias("max_len"),
        F.max_by(length, F.struct("c", -length)).alias("modal_len"),
    )


def expected_geometry(distribution: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline lengths for a class distribution, renormalised over known classes.

    ``distribution``: keys, ip_version, traffic_class, p. ``baseline``:
    traffic_class, ip_version, base_min, base_modal (at most classes x 2 rows).
    """
    b = F.broadcast(baseline)  # seven classes times two IP versions
    known = distribution.join(b, ["traffic_class", "ip_version"])
    return known.groupBy(*keys).agg(
        (F.sum(F.col("base_min") * F.col("p")) / F.nullif(F.sum("p"), F.lit(0.0))).alias("expected_min"),
        (F.sum(F.col("base_modal") * F.col("p")) / F.nullif(F.sum("p"), F.lit(0.0))).alias("expected_modal"),
    )


def mode_classifier_features(tagged: DataFrame, packets: DataFrame, distribution: DataFrame,
                             baseline: DataFrame) -> DataFrame:
    """The six features of the tunnel/transport classifier, per pair."""
    keys = ["capture_id", "pair_id"]
    geometry = session_geometry(tagged)
    ends = tagged.select(*keys, F.explode(F.array("src", "dst")).alias("e")).groupBy(*keys, "e").agg(
        F.lit(1).alias("x")).groupBy(*keys).agg(F.count(F.lit(1)).alias("endpoints"))
    capture = packets.groupBy("capture_id", "proto", "src", "spi").agg(F.count(F.lit(1)).alias("c"))
    capture = capture.groupBy("capture_id").agg(
        F.count_distinct(F.when(F.col("spi").isNotNull(), F.struct("src", "spi"))).alias("spi_pairs"),
        (F.sum(F.when(F.col("proto") == "other", F.col("c")).otherwise(0)) / F.sum("c")).alias("cleartext_ratio"),
    )
    dist = distribution.join(geometry.select(*keys, "ip_version"), keys)
    expected = expected_geometry(dist, baseline, keys)
    joined = (
        geometry.join(ends, keys).join(capture, "capture_id").join(expected, keys, "left")
    )
    def offset(actual: str, base: str) -> Column:
        return F.when(F.coalesce(F.col(base), F.lit(0.0)) != 0, F.col(actual) - F.col(base)).otherwise(F.lit(0.0))

    return joined.select(
        *keys,
        (F.col("max_len") / F.lit(float(PATH_MTU))).alias("max_len_over_mtu"),
        (F.col("spi_pairs") / F.col("endpoints")).alias("spi_pairs_per_endpoint"),
        F.col("cleartext_ratio"),
        offset("modal_len", "expected_modal").alias("modal_len_offset"),
        offset("min_len", "expected_min").alias("min_len_offset"),
        scalars.inner_header_bytes(F.col("ip_version")).alias("inner_header_bytes"),
    )
