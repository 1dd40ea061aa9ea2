"""Suite sieve, sequence health, rekeys, forward secrecy and negotiations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelens import dims
from wirelens.catalog import sqlviews
from wirelens.catalog.registry import query
from wirelens.catalog.traffic import rounded
from wirelens.functions import scalars
from wirelens.operators import flows, ike, lattice, pfs, quality, replay
from wirelens.plans import adapters
from wirelens.session import materialise


def pairs_of(spark, sf):
    return flows.pair_flows(flows.summarise_flows(adapters.packets(spark, sf)))


def messages_of(spark, sf):
    """The message table, written once as a landing job would leave it."""
    return materialise(adapters.ike_messages(spark, sf))


def flat(column: str) -> list:
    """An attribute as value, provenance and confidence columns."""
    c = F.col(column)
    return [
        F.coalesce(c["value"].cast("string"), F.lit("")).alias(f"{column}_value"),
        c["provenance"].alias(f"{column}_provenance"),
        F.round(F.coalesce(c["confidence"], F.lit(-1.0)), 6).alias(f"{column}_confidence"),
    ]


sqlviews.view("lengths", "tagged", """
  SELECT capture_id, pair_id, esp_len AS length, count(*) AS packets FROM tagged
  WHERE proto = 'esp' AND esp_len IS NOT NULL GROUP BY capture_id, pair_id, esp_len""")
sqlviews.view("survivors", "lengths suites", """
  SELECT l.capture_id, l.pair_id, s.ordinal, s.suite, s.block, s.overhead, s.encryption, s.integrity
  FROM lengths l CROSS JOIN suites s GROUP BY ALL
  HAVING bool_and((l.length - s.overhead) % s.block = 0 AND l.length - s.overhead >= s.block)""")
sqlviews.view("ranked_survivors", "survivors", """
  SELECT *, row_number() OVER (PARTITION BY capture_id, pair_id ORDER BY block DESC, overhead DESC, ordinal) AS place
  FROM survivors""")


@query("suite_survivors", "J14 A15 O5", views="ranked_survivors", sql="""
SELECT capture_id, pair_id, place, suite, encryption, integrity FROM ranked_survivors""")
def suite_survivors(spark, sf):
    p = adapters.packets(spark, sf)
    t = flows.pair_and_tag(p)[1]
    return lattice.suite_long(lattice.length_histogram(t))


@query("suite_detection", "A16 P13", views="ranked_survivors quality pairs", sql="""
WITH a AS (SELECT capture_id, pair_id, count(*) AS n, count(DISTINCT encryption) AS ne, count(DISTINCT integrity) AS ni,
             max(suite) FILTER (place = 1) AS suite, max(encryption) FILTER (place = 1) AS enc, max(integrity) FILTER (place = 1) AS integ
           FROM ranked_survivors GROUP BY capture_id, pair_id),
g AS (SELECT p.capture_id, p.pair_id, a.*, (NOT q.truncated) AND q.sufficient_for_lattice AND coalesce(a.n, 0) > 0 AS ok
      FROM pairs p JOIN quality q ON q.capture_id = p.capture_id LEFT JOIN a ON a.capture_id = p.capture_id AND a.pair_id = p.pair_id)
SELECT capture_id, pair_id,
  CASE WHEN ok THEN suite ELSE '' END AS suite_value, CASE WHEN ok THEN 'inferred' ELSE 'unavailable' END AS suite_provenance,
  CASE WHEN ok THEN round(1.0::DOUBLE - (n - 1) / 7.0::DOUBLE, 6) ELSE -1.0::DOUBLE END AS suite_confidence,
  CASE WHEN ok THEN enc ELSE '' END AS encryption_alg_value, CASE WHEN ok THEN 'inferred' ELSE 'unavailable' END AS encryption_alg_provenance,
  CASE WHEN ok THEN round(1.0::DOUBLE - (ne - 1) / 5.0::DOUBLE, 6) ELSE -1.0::DOUBLE END AS encryption_alg_confidence,
  CASE WHEN ok THEN integ ELSE '' END AS integrity_alg_value, CASE WHEN ok THEN 'inferred' ELSE 'unavailable' END AS integrity_alg_provenance,
  CASE WHEN ok THEN round(1.0::DOUBLE - (ni - 1) / 3.0::DOUBLE, 6) ELSE -1.0::DOUBLE END AS integrity_alg_confidence
FROM g""")
def suite_detection(spark, sf):
    p = adapters.packets(spark, sf)
    t = flows.pair_and_tag(p)[1]
    found = lattice.detect_suite(lattice.suite_survivors(lattice.length_histogram(t)), quality.capture_quality(p))
    return found.select("capture_id", "pair_id", *flat("suite"), *flat("encryption_alg"), *flat("integrity_alg"))


sqlviews.view("seq_stats", "tagged", """
  SELECT capture_id, pair_id, src, dst, spi, count(*) AS packets, count(*) - count(DISTINCT seq) AS duplicates,
         count(*) FILTER (seq < prev) AS out_of_order, min(seq) AS first_seq, max(seq) AS last_seq,
         greatest(0, max(seq) - min(seq) + 1 - count(DISTINCT seq)) AS missing,
         greatest(0, max(seq) - min(seq) + 1 - count(DISTINCT seq)) / greatest(1, max(seq) - min(seq) + 1)::DOUBLE AS gap_ratio
  FROM (SELECT *, lag(seq) OVER (PARTITION BY capture_id, pair_id, spi ORDER BY idx) AS prev FROM tagged WHERE seq IS NOT NULL)
  GROUP BY capture_id, pair_id, src, dst, spi""")


@query("sequence_stats", "A14 W7", views="seq_stats", sql="""
SELECT capture_id, pair_id, src, dst, spi, packets, duplicates, out_of_order, first_seq, last_seq, missing,
       round(gap_ratio, 6) AS gap_ratio FROM seq_stats""")
def sequence_stats(spark, sf):
    p = adapters.packets(spark, sf, sequenced=True)
    return rounded(replay.sequence_stats(flows.pair_and_tag(p)[1]))


@query("sequence_health", "A14", views="seq_stats", sql="""
WITH p AS (SELECT capture_id, pair_id, sum(packets) AS packets, sum(duplicates) AS duplicates, sum(out_of_order) AS out_of_order,
             sum(missing) AS missing, max(gap_ratio) AS gap_ratio FROM seq_stats GROUP BY capture_id, pair_id)
SELECT capture_id, pair_id, CAST(packets AS BIGINT) AS packets, CAST(duplicates AS BIGINT) AS duplicates,
       CAST(out_of_order AS BIGINT) AS out_of_order, CAST(missing AS BIGINT) AS missing,
       CASE WHEN packets < 20 THEN '' WHEN duplicates = 0 AND gap_ratio <= 0.02 THEN 'true' ELSE 'false' END AS replay_sane_value,
       CASE WHEN packets < 20 THEN 'unavailable' ELSE 'inferred' END AS replay_sane_provenance,
       CASE WHEN packets < 20 THEN -1.0::DOUBLE ELSE 0.95::DOUBLE END AS replay_sane_confidence
FROM p""")
def sequence_health(spark, sf):
    p = adapters.packets(spark, sf, sequenced=True)
    h = replay.sequence_health(replay.sequence_stats(flows.pair_and_tag(p)[1]))
    return h.select("capture_id", "pair_id", "packets", "duplicates", "out_of_order", "missing", *flat("replay_sane"))


sqlviews.view("spi_series", "flows", """
  SELECT *, CAST(round_even((start_ts_us - lag(start_ts_us) OVER (PARTITION BY capture_id, src, dst ORDER BY start_ts_us, first_index)) / 1000000.0::DOUBLE, 0) AS BIGINT) AS gap_s
  FROM flows""")


@query("spi_series", "W6 J5", views="spi_series", sql="""
SELECT capture_id, src, dst, spi, start_ts_us, first_index, coalesce(gap_s, -1) AS gap_s FROM spi_series""")
def spi_series(spark, sf):
    s = flows.spi_series(flows.summarise_flows(adapters.packets(spark, sf)))
    return s.withColumn("gap_s", F.coalesce("gap_s", F.lit(-1)))


@query("rekey_interval", "A19", views="spi_series", sql="""
WITH g AS (SELECT capture_id, src, dst, count(*) AS spi_count, list_sort(coalesce(list(gap_s) FILTER (gap_s IS NOT NULL), [])) AS gaps
           FROM spi_series GROUP BY capture_id, src, dst)
SELECT capture_id, src, dst, spi_count,
       CASE WHEN spi_count < 2 THEN '' ELSE CAST(gaps[len(gaps) // 2 + 1] AS VARCHAR) END AS observed_rekey_s_value,
       CASE WHEN spi_count < 2 THEN 'unavailable' ELSE 'inferred' END AS observed_rekey_s_provenance,
       CASE WHEN spi_count < 2 THEN -1.0::DOUBLE ELSE 0.95::DOUBLE END AS observed_rekey_s_confidence
FROM g""")
def rekey_interval(spark, sf):
    r = replay.rekey_interval(flows.spi_series(flows.summarise_flows(adapters.packets(spark, sf))))
    return r.select("capture_id", "src", "dst", "spi_count", *flat("observed_rekey_s"))


sqlviews.view("exchanges", "", """
  SELECT l_suppkey % 50 AS capture_id, '10.1.' || (l_partkey % 4) || '.1' AS lo, '10.1.' || (l_partkey % 4) || '.2' AS hi,
         CASE WHEN l_suppkey % 7 = 0 THEN 'ikev1' ELSE 'ikev2' END AS ike_version,
         CASE WHEN l_linenumber % 3 = 2 THEN 35 ELSE 36 + l_linenumber % 2 END AS exchange_type,
         CASE WHEN l_partkey % 40 = 0 THEN 0 ELSE 200 + l_partkey % 300 END AS length,
         100 + l_partkey * 3 % 200 AS plain
  FROM lineitem""")
sqlviews.view("sizes", "exchanges", """
  SELECT capture_id, lo, hi, CASE exchange_type WHEN 36 THEN 'create_child' ELSE 'informational' END AS kind, length
  FROM exchanges WHERE ike_version = 'ikev2' AND length <> 0 AND exchange_type IN (36, 37)""")


@query("exchange_sizes", "A17", views="sizes", sql="""
SELECT capture_id, lo, hi, kind, length, count(*) AS messages FROM sizes GROUP BY ALL""")
def exchange_sizes(spark, sf):
    return pfs.exchange_sizes(adapters.exchanges(spark, sf))


@query("exchange_medians", "A17", views="sizes", sql="""
SELECT capture_id, lo, hi, kind, count(*) AS messages, round(median(length)::DOUBLE, 6) AS median_length FROM sizes GROUP BY ALL""")
def exchange_medians(spark, sf):
    return rounded(pfs.exchange_summary(pfs.exchange_sizes(adapters.exchanges(spark, sf))))


@query("pfs_inference", "A18 J15", views="sizes dh_sizes", sql=f"""
WITH g AS (SELECT s_suppkey % 50 AS capture_id, '10.1.' || (s_suppkey // 50 % 5) || '.1' AS lo, '10.1.' || (s_suppkey // 50 % 5) || '.2' AS hi,
             CAST({adapters.cycle('s_suppkey', [14, 19, 2, 99, 'NULL'])} AS INTEGER) AS dh_group FROM supplier),
c AS (SELECT capture_id, lo, hi, median(length) AS m FROM sizes WHERE kind = 'create_child' GROUP BY ALL),
b AS (SELECT capture_id, lo, hi, median(plain) AS m FROM exchanges GROUP BY ALL),
j AS (SELECT g.*, c.m AS cm, b.m AS bm, d.public_bytes + 8 AS expected FROM g LEFT JOIN c USING (capture_id, lo, hi)
      LEFT JOIN b USING (capture_id, lo, hi) LEFT JOIN dh_sizes d ON d.dh_group = g.dh_group),
k AS (SELECT *, CASE WHEN dh_group IS NULL OR expected IS NULL OR cm IS NULL OR bm IS NULL THEN FALSE ELSE TRUE END AS ok FROM j)
SELECT capture_id, lo, hi, coalesce(dh_group, -1) AS dh_group,
  CASE WHEN ok THEN CASE WHEN abs(cm - bm - expected) <= expected * 0.4 THEN 'true' ELSE 'false' END ELSE '' END AS pfs_enabled_value,
  CASE WHEN ok THEN 'inferred' ELSE 'unavailable' END AS pfs_enabled_provenance,
  CASE WHEN NOT ok THEN -1.0::DOUBLE WHEN dh_group IN (19, 20, 21) THEN 0.65::DOUBLE ELSE 0.9::DOUBLE END AS pfs_enabled_confidence,
  CASE WHEN ok THEN '' WHEN dh_group IS NULL THEN 'the key-exchange group was not observed'
       WHEN expected IS NULL THEN 'the group''s public size is not known'
       WHEN cm IS NULL THEN 'no rekey exchange in this capture' ELSE 'no exchange without a key exchange to measure from' END AS reason
FROM k""")
def pfs_inference(spark, sf):
    e = adapters.exchanges(spark, sf)
    s = pfs.exchange_sizes(e)
    plain = e.groupBy("capture_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"),
                      F.col("plain").alias("length")).agg(F.count(F.lit(1)).alias("messages"))
    r = pfs.infer_pfs(s.filter("kind = 'create_child'"),
                      plain, adapters.groups_seen(spark, sf))
    reason = F.when(F.col("pfs_enabled.provenance") == "unavailable", F.col("pfs_enabled.note")).otherwise("")
    return r.select("capture_id", "lo", "hi", F.coalesce("dh_group", F.lit(-1)).alias("dh_group"),
                    *flat("pfs_enabled"), reason.alias("reason"))


# --- negotiations -----------------------------------------------------------

def _name(code: str, kinds: dict[str, tuple]) -> str:
    """CASE from (version, code) to registry names."""
    parts = []
    for version, key in kinds.items():
        arms = " ".join(f"WHEN {c} THEN '{n}'" for c, n in dims.TRANSFORM_IDS[key].items())
        parts.append(f"WHEN version = '{version}' THEN CASE {code} {arms} ELSE 'unknown' END")
    return f"CASE WHEN {code} IS NULL THEN NULL {' '.join(parts)} END"


O, I = adapters.OFFER, adapters.IKE
sqlviews.view("offers", "", f"""
  SELECT o_orderkey, o_custkey, o_orderstatus, {I['capture_id']} AS capture_id, {I['version']} AS version, {I['ts_us']} AS ts_us, j,
         j = {I['chosen']} AS chosen, {O['encr']} AS encr, {O['bits']} AS bits, {O['prf']} AS prf, {O['integ']} AS integ, {O['dh']} AS dh,
         {O['esn']} AS esn, {O['auth']} AS auth, {O['life_type']} AS life_type, {O['life']} AS life
  FROM orders, LATERAL (SELECT unnest(range(1, 2 + o_custkey % 4)) AS j)""")
sqlviews.view("named_offers", "offers", f"""
  SELECT *, {_name('encr', {'ikev2': ('ikev2', 'encr'), 'ikev1': ('ikev1', 'encr')})} AS alg,
         CASE WHEN (version = 'ikev1' AND encr = 7) OR (version = 'ikev2' AND encr IN (12, 20, 18)) THEN bits
              WHEN (version = 'ikev1' AND encr = 1) OR (version = 'ikev2' AND encr = 1) THEN 56
              WHEN (version = 'ikev1' AND encr = 5) OR (version = 'ikev2' AND encr = 3) THEN 168 END AS keylen
  FROM offers""")
sqlviews.view("strong_offers", "named_offers", """
  SELECT *, CASE alg WHEN 'null' THEN 0 WHEN 'des-cbc' THEN 1 WHEN '3des-cbc' THEN 2 ELSE 3 END * 10000 + coalesce(keylen, 0) AS strength
  FROM named_offers""")
sqlviews.view("negotiations", "strong_offers", f"""
  SELECT s.o_orderkey, s.capture_id, lpad(lower(to_hex(s.o_orderkey)), 16, '0') AS init_spi, s.version AS ike_version,
         s.o_orderstatus <> 'F' AS answered, CASE WHEN s.o_orderstatus <> 'F' THEN lpad(lower(to_hex(s.o_orderkey + 1)), 16, '0') END AS resp_spi,
         CASE WHEN version = 'ikev1' THEN CASE s.o_custkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'aggressive' END END AS exchange_mode,
         '10.0.' || s.capture_id || '.' || (CASE WHEN s.o_orderkey % 2 = 1 THEN 2 ELSE 1 END) AS src,
         '10.0.' || s.capture_id || '.' || (CASE WHEN s.o_orderkey % 2 = 1 THEN 1 ELSE 2 END) AS dst,
         s.ts_us + CASE WHEN s.o_orderstatus <> 'F' THEN 1000000 ELSE 0 END AS ts_us, 2 * s.o_orderkey + 1 AS request_frame,
         CASE WHEN s.o_orderstatus <> 'F' THEN 2 * s.o_orderkey + 2 END AS response_frame,
         CASE WHEN o_orderstatus <> 'F' THEN alg END AS encryption_alg, CASE WHEN o_orderstatus <> 'F' THEN keylen END AS encryption_keylen,
         CASE WHEN o_orderstatus <> 'F' THEN {_name('integ', {'ikev2': ('ikev2', 'integ'), 'ikev1': ('ikev1', 'hash')})} END AS integrity_alg,
         CASE WHEN o_orderstatus <> 'F' AND version = 'ikev2' THEN {_name('prf', {'ikev2': ('ikev2', 'prf')})} END AS prf_alg,
         CASE WHEN o_orderstatus <> 'F' THEN dh END AS dh_group,
         CASE WHEN o_orderstatus <> 'F' AND version = 'ikev1' AND life_type = 1 THEN life END AS lifetime_s,
         CASE WHEN o_orderstatus <> 'F' AND version = 'ikev1' THEN {_name('auth', {'ikev1': ('ikev1', 'auth')})} END AS auth_method,
         CASE WHEN o_orderstatus <> 'F' AND version = 'ikev2' THEN esn = 1 END AS esn,
         o_orderkey % 4 = 0 OR (o_orderstatus <> 'F' AND o_orderkey % 8 = 1) AS nat_detected,
         o_orderstatus <> 'F' AND (SELECT min(w.strength) FROM strong_offers w WHERE w.o_orderkey = s.o_orderkey) < s.strength AS downgrade_available
  FROM strong_offers s WHERE chosen""")

NEG_SQL = """
SELECT capture_id, init_spi, coalesce(resp_spi, '') AS resp_spi, ike_version, coalesce(exchange_mode, '') AS exchange_mode, src, dst, ts_us,
       request_frame, coalesce(response_frame, -1) AS response_frame, coalesce(encryption_alg, '') AS encryption_alg,
       coalesce(encryption_keylen, -1) AS encryption_keylen, coalesce(integrity_alg, '') AS integrity_alg, coalesce(prf_alg, '') AS prf_alg,
       coalesce(dh_group, -1) AS dh_group, coalesce(lifetime_s, -1) AS lifetime_s, coalesce(auth_method, '') AS auth_method,
       CASE WHEN esn THEN 1 WHEN NOT esn THEN 0 ELSE -1 END AS esn, nat_detected, downgrade_available FROM negotiations"""


def no_nulls(df):
    fixed = []
    for c, t in df.dtypes:
        empty = F.lit("") if t == "string" else F.lit(-1)
        if t == "boolean":
            fixed.append(F.col(c))
        else:
            fixed.append(F.coalesce(F.col(c), empty.cast(t)).alias(c))
    return df.select(*fixed)


@query("negotiations", "J3 W8 W11 P15 P16 P17 P26 P28 P29 P30", views="negotiations", sql=NEG_SQL)
def negotiations(spark, sf):
    n = ike.build_negotiations(messages_of(spark, sf)).drop("proposed", "selected")
    n = n.withColumn("esn", F.when(F.col("esn"), 1).when(~F.col("esn"), 0))
    return no_nulls(n)


@query("offered_ciphers", "P15 P16 P29", views="strong_offers", sql="""
SELECT version, alg, coalesce(keylen, -1) AS keylen, count(*) AS offers, count(*) FILTER (chosen AND o_orderstatus <> 'F') AS chosen
FROM strong_offers GROUP BY version, alg, keylen""")
def offered_ciphers(spark, sf):
    """Ciphers offered in requests and picked in responses, with effective key bits."""
    m = adapters.ike_messages(spark, sf)
    rows = m.select("ike_version", (F.col("frame_index") % 2 == 1).alias("request"),
                    F.explode("sa_payload").alias("p"))
    rows = rows.select("ike_version", "request", F.explode("p.transforms").alias("t"))
    c = ike._cipher(F.col("t"), F.col("ike_version"))
    rows = rows.select(F.col("ike_version").alias("version"), "request", c.alias("c")).filter("c.alg is not null")
    return rows.groupBy("version", F.col("c.alg").alias("alg"), F.coalesce("c.bits", F.lit(-1)).alias("keylen")).agg(
        F.count_if("request").alias("offers"), F.count_if(~F.col("request")).alias("chosen"))


sqlviews.view("correlated", "pairs negotiations", """
  SELECT * FROM (
    SELECT p.capture_id, p.pair_id, n.* EXCLUDE (capture_id, src, dst), n.src AS neg_src,
           row_number() OVER (PARTITION BY p.capture_id, p.pair_id ORDER BY n.ts_us DESC NULLS LAST, n.request_frame) AS rn
    FROM pairs p LEFT JOIN negotiations n ON n.capture_id = p.capture_id AND least(n.src, n.dst) = least(p.src, p.dst)
         AND greatest(n.src, n.dst) = greatest(p.src, p.dst) AND n.ts_us <= p.fwd_start_us AND p.fwd_start_us - n.ts_us <= 30000000)
  WHERE rn = 1""")


def correlated(spark, sf, rollup):
    return ike.correlate_messages(rollup, adapters.ike_messages(spark, sf), of_spis=lambda spis: adapters.ike_messages(spark, sf, spis))


@query("flow_negotiation_asof", "J2 W11", views="correlated", sql="""
SELECT capture_id, pair_id, coalesce(init_spi, '') AS init_spi, coalesce(ts_us, -1) AS ts_us FROM correlated""")
def flow_negotiation_asof(spark, sf):
    c = correlated(spark, sf, flows.sa_rollup(pairs_of(spark, sf)))
    return c.select("capture_id", "pair_id", F.coalesce("negotiation.init_spi", F.lit("")).alias("init_spi"),
                    F.coalesce("negotiation.ts_us", F.lit(-1)).alias("ts_us"))


def _attr_sql(name: str, has: str, value: str, prov: str, conf: str = "-1.0::DOUBLE") -> str:
    return (f"CASE WHEN {has} THEN CAST({value} AS VARCHAR) ELSE '' END AS {name}_value, "
            f"CASE WHEN {has} THEN '{prov}' ELSE 'unavailable' END AS {name}_provenance, "
            f"CASE WHEN {has} THEN {conf} ELSE -1.0::DOUBLE END AS {name}_confidence")


def _sa_columns() -> str:
    cols = [
        _attr_sql("ike_version", "init_spi IS NOT NULL", "ike_version", "observed"),
        _attr_sql("ike_exchange_mode", "exchange_mode IS NOT NULL", "exchange_mode", "observed"),
        _attr_sql("encryption_alg", "encryption_alg IS NOT NULL AND encryption_alg <> 'unknown'", "encryption_alg", "inferred", "0.6::DOUBLE"),
        _attr_sql("encryption_keylen", "encryption_keylen IS NOT NULL", "encryption_keylen", "inferred", "0.6::DOUBLE"),
        _attr_sql("integrity_alg", "integrity_alg IS NOT NULL AND integrity_alg <> 'unknown'", "integrity_alg", "inferred", "0.6::DOUBLE"),
        _attr_sql("prf_alg", "prf_alg IS NOT NULL", "prf_alg", "observed"),
        _attr_sql("dh_group", "dh_group IS NOT NULL", "dh_group", "observed"),
        _attr_sql("operating_mode", "FALSE", "''", "inferred"),
        _attr_sql("pfs_enabled", "FALSE", "''", "inferred"),
        _attr_sql("auth_method", "auth_method IS NOT NULL", "auth_method", "observed"),
        _attr_sql("negotiated_lifetime_s", "lifetime_s IS NOT NULL", "lifetime_s", "observed"),
        _attr_sql("observed_rekey_s", "FALSE", "''", "inferred"),
        _attr_sql("esn_negotiated", "esn IS NOT NULL", "CASE WHEN esn THEN 'true' ELSE 'false' END", "observed"),
        _attr_sql("replay_sane", "FALSE", "''", "inferred"),
        _attr_sql("nat_traversal", "TRUE", "CASE WHEN udp_encapsulated THEN 'true' ELSE 'false' END", "observed"),
        _attr_sql("downgrade_available", "answered", "CASE WHEN downgrade_available THEN 'true' ELSE 'false' END", "observed"),
    ]
    return ",\n  ".join(cols)


def sas_of(spark, sf):
    roll = flows.sa_rollup(pairs_of(spark, sf))
    return ike.assemble_sas(roll, correlated(spark, sf, roll))


sqlviews.view("sas_base", "correlated pairs", "SELECT c.*, p.udp_encapsulated FROM correlated c JOIN pairs p USING (capture_id, pair_id)")


@query("security_associations", "P32 P27 P13", views="sas_base",
       sql="SELECT capture_id, pair_id,\n  " + _sa_columns() + "\nFROM sas_base")
def security_associations(spark, sf):
    s = sas_of(spark, sf)
    return s.select("capture_id", "pair_id", *[c for n, _, _ in dims.PARAMETERS for c in flat(n)])


@query("association_exchange_sizes", "J4", views="pairs exchanges", sql="""
WITH z AS (SELECT capture_id, replace(lo, '10.1.', '10.0.') AS lo, replace(hi, '10.1.', '10.0.') AS hi,
             CASE exchange_type WHEN 36 THEN 'create_child' ELSE 'informational' END AS kind, count(*) AS messages
           FROM exchanges WHERE ike_version = 'ikev2' AND length <> 0 AND exchange_type IN (36, 37) GROUP BY ALL)
SELECT p.capture_id, p.pair_id, coalesce(z.kind, '') AS kind, coalesce(z.messages, 0) AS messages
FROM pairs p LEFT JOIN z ON z.capture_id = p.capture_id AND z.lo = least(p.src, p.dst) AND z.hi = greatest(p.src, p.dst)""")
def association_exchange_sizes(spark, sf):
    e = adapters.exchanges(spark, sf)
    e = e.withColumn("src", F.replace("src", F.lit("10.1."), F.lit("10.0."))).withColumn(
        "dst", F.replace("dst", F.lit("10.1."), F.lit("10.0.")))
    j = ike.with_exchange_sizes(flows.sa_rollup(pairs_of(spark, sf)), pfs.exchange_summary(pfs.exchange_sizes(e)))
    return j.select("capture_id", "pair_id", F.coalesce("kind", F.lit("")).alias("kind"),
                    F.coalesce("messages", F.lit(0)).alias("messages"))


@query("association_rekeys", "J5 J16", views="pairs spi_series", sql="""
WITH g AS (SELECT capture_id, src, dst, count(*) AS spi_count, list_sort(coalesce(list(gap_s) FILTER (gap_s IS NOT NULL), [])) AS gaps
           FROM spi_series GROUP BY capture_id, src, dst)
SELECT p.capture_id, p.pair_id, g.spi_count, CASE WHEN g.spi_count < 2 THEN -1 ELSE gaps[len(gaps) // 2 + 1] END AS rekey_s
FROM pairs p JOIN g USING (capture_id, src, dst)""")
def association_rekeys(spark, sf):
    p = adapters.packets(spark, sf)
    f = flows.summarise_flows(p)
    j = ike.with_rekey(flows.sa_rollup(flows.pair_flows(f)), replay.rekey_interval(flows.spi_series(f)))
    return j.select("capture_id", "pair_id", "spi_count",
                    F.coalesce("observed_rekey_s.value", F.lit(-1)).cast("bigint").alias("rekey_s"))


@query("association_overlay", "P33", views="sas_base ranked_survivors quality", sql="""
WITH a AS (SELECT capture_id, pair_id, count(DISTINCT encryption) AS ne, max(encryption) FILTER (place = 1) AS enc
           FROM ranked_survivors GROUP BY capture_id, pair_id),
j AS (SELECT s.capture_id, s.pair_id, s.encryption_alg IS NOT NULL AND s.encryption_alg <> 'unknown' AS known, s.encryption_alg,
        (NOT q.truncated) AND q.sufficient_for_lattice AND a.enc IS NOT NULL AS sieved, a.enc, a.ne
      FROM sas_base s JOIN quality q USING (capture_id) LEFT JOIN a ON a.capture_id = s.capture_id AND a.pair_id = s.pair_id)
SELECT capture_id, pair_id, CASE WHEN known THEN encryption_alg WHEN sieved THEN enc ELSE '' END AS encryption_alg_value,
       CASE WHEN known OR sieved THEN 'inferred' ELSE 'unavailable' END AS encryption_alg_provenance,
       CASE WHEN known THEN 0.6::DOUBLE WHEN sieved THEN round(1.0::DOUBLE - (ne - 1) / 5.0::DOUBLE, 6) ELSE -1.0::DOUBLE END AS encryption_alg_confidence
FROM j""")
def association_overlay(spark, sf):
    p = adapters.packets(spark, sf)
    pairs, tagged = flows.pair_and_tag(p)
    roll = flows.sa_rollup(pairs)
    sas = ike.assemble_sas(roll, correlated(spark, sf, roll))
    sieve = lattice.detect_suite(
        lattice.suite_survivors(lattice.length_histogram(tagged)), quality.capture_quality(p))
    return ike.overlay(sas, sieve).select("capture_id", "pair_id", *flat("encryption_alg"))


@query("dissector_integers", "P20", sql="""
SELECT event_id, event_id % 7 AS shape, CASE WHEN event_id % 7 = 6 THEN -1 ELSE event_id END AS parsed FROM events""")
def dissector_integers(spark, sf):
    """Event ids rendered in each spelling a dissector uses, parsed back."""
    hexa = "lower(hex(event_id))"
    padded = f"lpad({hexa}, 8, '0')"
    e = adapters.table(spark, sf, "events").selectExpr("event_id", "event_id % 7 AS shape", (
        "CASE event_id % 7 WHEN 0 THEN cast(event_id as string) WHEN 1 THEN concat(' ', event_id, ' ') "
        f"WHEN 2 THEN concat('0x', {hexa}) WHEN 3 THEN concat_ws(':', substr({padded},1,2), substr({padded},3,2), substr({padded},5,2), substr({padded},7,2)) "
        f"WHEN 4 THEN concat('NAME (', event_id, ')') WHEN 5 THEN concat('NAME (0x', {hexa}, ')') ELSE concat('x', event_id) END AS text"))
    return e.select("event_id", "shape", F.coalesce(scalars.tolerant_int(F.col("text")), F.lit(-1)).alias("parsed"))
