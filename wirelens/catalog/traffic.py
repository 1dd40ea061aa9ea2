"""Packets, flows, pairs, windows and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.catalog import sqlviews
from wirelens.catalog.registry import query
from wirelens.functions import scalars
from wirelens.operators import features, flows, panes, quality, windows
from wirelens.plans import adapters


def rounded(df: DataFrame) -> DataFrame:
    """Every double rounded to six places, as the SQL twins do."""
    return df.selectExpr(*[f"round(`{c}`, 6) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes])


def tagged(spark, sf):
    return flows.pair_and_tag(adapters.packets(spark, sf))[1]


def windowed(spark, sf):
    """What the sequences of windows need."""
    return windows.assign_windows(windows.pane_heads(tagged(spark, sf)))


@query("window_features", "A5 A6 A7 A8 A9 A10 A11 A12 A13 W1 W2 W3 J6 U2", views="features", sql="""
SELECT * FROM features""")
def window_features(spark, sf, min_packets: int = windows.MIN_PACKETS):
    """The flagship: packets to flows, pairs, sliding windows and 74 features."""
    return rounded(panes.window_features(tagged(spark, sf), min_packets))


@query("packet_protocol_counts", "P1 P2", views="packets", sql="""
SELECT capture_id, proto, count(*) AS packets, count(spi) AS with_spi,
       count(*) FILTER (proto IN ('esp','ah') AND spi IS NOT NULL) AS flow_packets
FROM packets GROUP BY capture_id, proto""")
def packet_protocol_counts(spark, sf):
    p = adapters.packets(spark, sf)
    return p.groupBy("capture_id", "proto").agg(
        F.count(F.lit(1)).alias("packets"), F.count("spi").alias("with_spi"),
        F.count_if(scalars.is_flow_packet(F.col("proto"), F.col("spi"))).alias("flow_packets"),
    )


@query("flow_summary", "A1 P2 P3", views="flows", sql="""
SELECT capture_id, src, dst, lpad(lower(to_hex(spi)), 8, '0') AS spi, proto, first_index, start_ts_us, end_ts_us, packets, bytes
FROM flows""")
def flow_summary(spark, sf):
    f = flows.summarise_flows(adapters.packets(spark, sf))
    return f.select("capture_id", "src", "dst", scalars.spi_hex(F.col("spi")).alias("spi"), "proto",
                    "first_index", "start_ts_us", "end_ts_us", "packets", "bytes")


@query("flow_pairs", "J1", views="pairs", sql="""
SELECT capture_id, pair_id, proto, src, dst, fwd_spi, coalesce(rev_spi, -1) AS rev_spi, paired FROM pairs""")
def flow_pairs(spark, sf):
    p = flows.pair_flows(flows.summarise_flows(adapters.packets(spark, sf)))
    return p.select("capture_id", "pair_id", "proto", F.col("fwd.src").alias("src"),
                    F.col("fwd.dst").alias("dst"), F.col("fwd.spi").alias("fwd_spi"),
                    F.coalesce("rev.spi", F.lit(-1)).alias("rev_spi"), "paired")


@query("flow_pairs_split_groups", "J1", views="pairs", sql="""
SELECT capture_id, pair_id, proto, src, dst, fwd_spi, coalesce(rev_spi, -1) AS rev_spi, paired FROM pairs""")
def flow_pairs_split_groups(spark, sf):
    """The same pairing with blocks of one flow, so that every open flow is handed on."""
    p = flows.pair_flows(flows.summarise_flows(adapters.packets(spark, sf)), block_flows=1, numbered=1000)
    return p.select("capture_id", "pair_id", "proto", F.col("fwd.src").alias("src"),
                    F.col("fwd.dst").alias("dst"), F.col("fwd.spi").alias("fwd_spi"),
                    F.coalesce("rev.spi", F.lit(-1)).alias("rev_spi"), "paired")


# Arrivals one by one: each takes the earliest open flow that runs the other way and overlaps it.
sqlviews.view("crossing_flows", "", """
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY first_index) AS n FROM (
    SELECT user_id % 5 AS capture_id, CAST(user_id // 5 % 2 AS INTEGER) AS way, user_id * 1000 + (ts_us + user_id * 700000) // 20000000 AS spi,
           min(event_id) AS first_index, min(ts_us) AS start_us, max(ts_us) AS end_us
    FROM (SELECT *, (epoch_us(ts) - 1704067200000000) // 10000 AS ts_us FROM events) GROUP BY ALL)""")


@query("flow_pairs_crossing", "J1", views="crossing_flows", sql="""
WITH RECURSIVE sweep AS (
  SELECT DISTINCT capture_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(i BIGINT, way INTEGER, s BIGINT, e BIGINT, spi BIGINT)[]) AS open,
         CAST(NULL AS STRUCT(i BIGINT, way INTEGER, s BIGINT, e BIGINT, spi BIGINT)) AS hit, CAST(NULL AS BIGINT) AS rev_spi FROM crossing_flows
  UNION ALL
  SELECT capture_id, n, CASE WHEN hit IS NULL THEN list_append(open, {'i': first_index, 'way': way, 's': start_us, 'e': end_us, 'spi': spi})
                        ELSE list_filter(open, lambda o: o.i <> hit.i) END, hit, spi
  FROM (SELECT f.*, w.open, list_filter(w.open, lambda o: o.way <> f.way AND o.s <= f.end_us AND f.start_us <= o.e)[1] AS hit
        FROM sweep w JOIN crossing_flows f ON f.capture_id = w.capture_id AND f.n = w.n + 1)),
met AS (SELECT capture_id, hit.i AS pair_id, hit.spi AS fwd_spi, rev_spi FROM sweep WHERE hit IS NOT NULL)
SELECT capture_id, pair_id, fwd_spi, rev_spi, TRUE AS paired FROM met
UNION ALL SELECT capture_id, first_index, spi, -1, FALSE FROM crossing_flows f
WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.capture_id = f.capture_id AND (m.fwd_spi = f.spi OR m.rev_spi = f.spi))""")
def flow_pairs_crossing(spark, sf):
    """Pairing where many generations of one endpoint pair are alive at a time, over several blocks."""
    p = flows.pair_flows(flows.summarise_flows(adapters.crossing_packets(spark, sf)), block_flows=128)
    return p.select("capture_id", "pair_id", F.col("fwd.spi").alias("fwd_spi"), F.coalesce("rev.spi", F.lit(-1)).alias("rev_spi"), "paired")


@query("sa_rollup", "A4 P3 P4 P27", views="pairs", sql="""
SELECT capture_id, pair_id, lpad(lower(to_hex(fwd_spi)), 8, '0') AS spi_initiator,
       coalesce(lpad(lower(to_hex(rev_spi)), 8, '0'), '') AS spi_responder, first_us, last_us,
       CAST(packet_count AS BIGINT) AS packet_count, CAST(byte_count AS BIGINT) AS byte_count, udp_encapsulated,
       strftime(make_timestamp(first_us), '%Y-%m-%dT%H:%M:%S') AS first_seen
FROM pairs""")
def sa_rollup(spark, sf):
    r = flows.sa_rollup(flows.pair_flows(flows.summarise_flows(adapters.packets(spark, sf))))
    stamp = F.expr("date_format(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, first_us div 1000000), \"yyyy-MM-dd'T'HH:mm:ss\")")
    return r.select("capture_id", "pair_id", "spi_initiator",
                    F.coalesce("spi_responder", F.lit("")).alias("spi_responder"), "first_us", "last_us",
                    "packet_count", "byte_count", "udp_encapsulated", stamp.alias("first_seen"))


@query("directional_sa_counts", "A3", views="flows", sql="""
SELECT capture_id, count(*) FILTER (proto = 'esp') AS esp_sa_count, count(*) FILTER (proto = 'ah') AS ah_sa_count
FROM flows GROUP BY capture_id""")
def directional_sa_counts(spark, sf):
    return flows.directional_counts(flows.summarise_flows(adapters.packets(spark, sf)))


sqlviews.view("quality", "packets flows", """
  SELECT p.capture_id, count(*) AS packet_count, (max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE AS duration_s,
         bool_or(captured_len < orig_len) AS truncated, bool_or(proto IN ('isakmp', 'isakmp_natt')) AS has_ike,
         bool_or(proto IN ('isakmp', 'isakmp_natt')) AND bool_or(coalesce(ike_message_id = 0, FALSE)) AS ike_complete,
         count(esp_len) AS esp_packets, count(DISTINCT esp_len) AS distinct_lengths,
         (NOT bool_or(captured_len < orig_len)) AND count(esp_len) >= 200 AND count(DISTINCT esp_len) >= 8 AS sufficient_for_lattice,
         (SELECT count(*) FROM flows f WHERE f.capture_id = p.capture_id AND f.proto = 'esp') AS esp_sa_count
  FROM packets p GROUP BY p.capture_id""")


@query("capture_quality", "A2 P34", views="quality", sql="""
SELECT capture_id, packet_count, round(duration_s, 6) AS duration_s, truncated, has_ike, ike_complete, esp_sa_count,
       esp_packets, distinct_lengths, sufficient_for_lattice,
       concat_ws(' | ',
         CASE WHEN truncated THEN 'capture is truncated: some packets were cut short by the snaplen' END,
         CASE WHEN has_ike AND NOT ike_complete THEN 'key exchange is present but its first exchange was not captured' END,
         CASE WHEN NOT sufficient_for_lattice AND NOT truncated AND esp_packets > 0 THEN
           'too few distinct ESP lengths for the suite sieve: ' || esp_packets || ' packets and ' || distinct_lengths || ' lengths' END) AS warnings
FROM quality""")
def capture_quality(spark, sf):
    q = quality.capture_quality(adapters.packets(spark, sf))
    return rounded(q.withColumn("warnings", F.concat_ws(" | ", "warnings")))


@query("quality_caveats", "P34", views="quality", sql="""
SELECT capture_id, concat_ws(' | ',
  CASE WHEN truncated THEN 'truncated: packet geometry could not be analysed' END,
  CASE WHEN NOT has_ike THEN 'no key exchange captured: settings estimated where possible' END,
  CASE WHEN has_ike AND NOT ike_complete THEN 'key exchange joined mid-stream' END,
  CASE WHEN NOT sufficient_for_lattice AND esp_sa_count > 0 THEN 'too few distinct packet sizes to identify the cipher family' END) AS caveats
FROM quality""")
def quality_caveats(spark, sf):
    c = quality.quality_caveats(quality.capture_quality(adapters.packets(spark, sf)))
    return c.select("capture_id", F.concat_ws(" | ", "caveats").alias("caveats"))


@query("session_admission", "A39", views="packets", sql="""
WITH s AS (SELECT c_custkey AS capture_id, CAST(floor(c_acctbal) AS BIGINT) % 4000 AS duration_s FROM customer),
n AS (SELECT capture_id, count(*) FILTER (proto = 'esp') AS esp_packets FROM packets GROUP BY capture_id)
SELECT s.capture_id, s.duration_s, coalesce(n.esp_packets, 0) AS esp_packets,
       greatest(20, CASE WHEN s.duration_s >= 0 THEN s.duration_s // 4 ELSE 0 END) AS required,
       coalesce(n.esp_packets, 0) >= greatest(20, CASE WHEN s.duration_s >= 0 THEN s.duration_s // 4 ELSE 0 END) AS admitted
FROM s LEFT JOIN n USING (capture_id)""")
def session_admission(spark, sf):
    s = adapters.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("capture_id"),
        F.expr("cast(floor(c_acctbal) as bigint) % 4000").alias("duration_s"))
    return quality.admit_sessions(adapters.packets(spark, sf), s)


@query("window_counts", "W1 W2 J6", views="window_counts", sql="""
SELECT capture_id, pair_id, k, start_us, packets, up_packets, end_us, packets >= 20 AS scorable FROM window_counts""")
def window_counts(spark, sf):
    return windows.window_counts(tagged(spark, sf)).withColumn("scorable", F.col("packets") >= 20)


@query("window_gaps", "W3", views="gapped", sql="""
SELECT capture_id, pair_id, k, count(gap_us) AS gaps, CAST(coalesce(sum(gap_us), 0) AS BIGINT) AS total_us,
       coalesce(max(gap_us), 0) AS longest_us FROM gapped GROUP BY capture_id, pair_id, k""")
def window_gaps(spark, sf):
    return windows.gap_summary(tagged(spark, sf))


sqlviews.view("sequences", "windowed", """
  SELECT capture_id, pair_id, k, list(CASE WHEN up THEN len ELSE -len END ORDER BY ts_us, idx)[1:128] AS seq
  FROM windowed GROUP BY capture_id, pair_id, k""")


@query("window_sequences", "W4 P5", views="sequences", sql="""
SELECT capture_id, pair_id, k, 128 AS slots, array_to_string(seq, ',') || repeat(',0', 128 - len(seq)) AS seq FROM sequences""")
def window_sequences(spark, sf):
    s = windows.sequence_vector(windowed(spark, sf))
    text = F.concat_ws(",", F.transform("seq", lambda v: v.cast("bigint").cast("string")))
    return s.select("capture_id", "pair_id", "k", F.size("seq").alias("slots"), text.alias("seq"))


@query("conversation_sequences", "W4 P5", sql="""
SELECT conv_id % 50 AS capture_id, conv_id AS pair_id,
       array_to_string(list(CASE WHEN role = 'assistant' THEN -length(text) ELSE length(text) END ORDER BY turn)[1:128], ',')
         || repeat(',0', CAST(128 - least(128, count(*)) AS INT)) AS seq
FROM conversations GROUP BY conv_id""")
def conversation_sequences(spark, sf):
    """Turns as a directional sequence: assistants answer downstream."""
    c = adapters.table(spark, sf, "conversations").select(
        F.expr("conv_id % 50").alias("capture_id"), F.col("conv_id").alias("pair_id"), F.lit(0).alias("k"),
        F.col("turn").alias("ts_us"), F.col("turn").alias("index"), F.length("text").alias("length"),
        (F.col("role") != "assistant").alias("up"))
    s = windows.sequence_vector(c)
    text = F.concat_ws(",", F.transform("seq", lambda v: v.cast("bigint").cast("string")))
    return s.select("capture_id", "pair_id", text.alias("seq"))


sqlviews.view("pair_lists", "tagged", """
  SELECT capture_id, pair_id, bool_or(paired) AS paired, min(ts_us) AS lo, max(ts_us) AS hi, list_sort(list(len)) AS lens,
         list_sort(coalesce(list(gap_us) FILTER (gap_us IS NOT NULL), [])) AS gaps,
         list_sort(coalesce(list(len) FILTER (up), [])) AS ups, list_sort(coalesce(list(len) FILTER (NOT up), [])) AS downs
  FROM (SELECT *, coalesce(esp_len, 0) AS len,
               ts_us - lag(ts_us) OVER (PARTITION BY capture_id, pair_id ORDER BY ts_us, idx) AS gap_us FROM tagged)
  GROUP BY capture_id, pair_id""")


@query("pair_features", "A5 A6 A7 A8 A9 A10 A11 A12 A13 M12", views="pair_lists",
       sql="SELECT capture_id, pair_id,\n  " + sqlviews.feature_columns("pair_lists") + "\nFROM pair_lists")
def pair_features(spark, sf):
    """The 74 features of whole pairs, from value histograms."""
    return rounded(features.pair_features(tagged(spark, sf)))


@query("feature_anomalies", "X9", views="features", sql="SELECT feature, count(*) AS bad FROM (UNPIVOT (SELECT "
       + ", ".join(dims.FEATURES) + " FROM features) ON COLUMNS(*) INTO NAME feature VALUE v) WHERE v IS NULL OR isnan(v) OR isinf(v) GROUP BY feature")
def feature_anomalies(spark, sf):
    from wirelens.operators import constraints
    return constraints.bad_features(panes.window_features(tagged(spark, sf), windows.MIN_PACKETS), dims.FEATURES)
