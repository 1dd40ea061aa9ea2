"""Constraint jobs over rows derived from the tables, some of them broken."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelens import dims
from wirelens.catalog.registry import query
from wirelens.operators import constraints, policy
from wirelens.plans import adapters

PROV = adapters.cycle("event_id", ["'observed'", "'inferred'", "'unavailable'"])


@query("attribute_violations", "X1", sql=f"""
WITH p AS (SELECT event_id, {PROV} AS provenance, CASE WHEN event_id % 5 <> 0 THEN event_type END AS value,
             CASE WHEN event_id % 4 <> 0 THEN (event_id % 120) / 100.0::DOUBLE END AS confidence, CASE WHEN event_id % 7 <> 0 THEN 'why' ELSE ' ' END AS note FROM events),
d AS (SELECT event_id, CASE WHEN provenance = 'inferred' AND confidence IS NULL THEN 'inferred without confidence'
  WHEN provenance = 'inferred' AND value IS NULL THEN 'inferred without value' WHEN provenance = 'observed' AND confidence IS NOT NULL THEN 'observed with confidence'
  WHEN provenance = 'observed' AND value IS NULL THEN 'observed without value' WHEN provenance = 'unavailable' AND confidence IS NOT NULL THEN 'unavailable with confidence'
  WHEN provenance = 'unavailable' AND value IS NOT NULL THEN 'unavailable with value' WHEN provenance = 'unavailable' AND trim(note) = '' THEN 'unavailable without reason'
  WHEN confidence > 1 THEN 'confidence outside 0..1' END AS detail FROM p)
SELECT event_id, detail FROM d WHERE detail IS NOT NULL""")
def attribute_violations(spark, sf):
    p = adapters.table(spark, sf, "events").selectExpr(
        "event_id", f"{PROV} AS provenance", "CASE WHEN event_id % 5 <> 0 THEN event_type END AS value",
        "CASE WHEN event_id % 4 <> 0 THEN event_id % 120 / 100D END AS confidence",
        "CASE WHEN event_id % 7 <> 0 THEN 'why' ELSE ' ' END AS note")
    return constraints.attribute_violations(p).select("event_id", "detail")


@query("quality_violations", "X2", sql="""
WITH q AS (SELECT c_custkey AS capture_id, c_custkey % 2 = 0 AS ike_complete, c_custkey % 3 = 0 AS has_ike, c_custkey % 5 = 0 AS sufficient,
             c_nationkey AS esp_sa_count, c_acctbal < 0 AS truncated FROM customer),
d AS (SELECT capture_id, CASE WHEN ike_complete AND NOT has_ike THEN 'complete without key exchange' WHEN sufficient AND esp_sa_count = 0 THEN 'sufficient without associations'
        WHEN sufficient AND truncated THEN 'sufficient though truncated' END AS detail FROM q)
SELECT * FROM d WHERE detail IS NOT NULL""")
def quality_violations(spark, sf):
    q = adapters.table(spark, sf, "customer").selectExpr(
        "c_custkey AS capture_id", "c_custkey % 2 = 0 AS ike_complete", "c_custkey % 3 = 0 AS has_ike",
        "c_custkey % 5 = 0 AS sufficient_for_lattice", "c_nationkey AS esp_sa_count", "c_acctbal < 0 AS truncated")
    return constraints.quality_violations(q).select("capture_id", "detail")


@query("sa_violations", "X3", sql="""
WITH s AS (SELECT o_orderkey, o_custkey * 10 AS first_us, o_orderkey AS last_us, CASE WHEN o_orderkey % 9 = 0 THEN 6 ELSE 4 END AS ip_version, o_orderkey % 4 AS packets,
             floor(o_totalprice) AS bytes FROM orders),
d AS (SELECT o_orderkey AS pair_id, CASE WHEN last_us < first_us THEN 'ends before it starts' WHEN ip_version <> 4 THEN 'address family'
        WHEN packets = 0 AND bytes > 0 THEN 'bytes without packets' END AS detail FROM s)
SELECT * FROM d WHERE detail IS NOT NULL""")
def sa_violations(spark, sf):
    s = adapters.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS pair_id", "o_custkey * 10 AS first_us", "o_orderkey AS last_us", "'10.0.0.1' AS src", "'10.0.0.2' AS dst",
        "CASE WHEN o_orderkey % 9 = 0 THEN 6 ELSE 4 END AS ip_version", "o_orderkey % 4 AS packet_count", "floor(o_totalprice) AS byte_count")
    return constraints.sa_violations(s).select("pair_id", "detail")


CATEGORY = adapters.cycle("l_partkey", [f"'{c}'" for c in dims.CATEGORY_CAPS])
SEVERITY = adapters.cycle("l_suppkey", [f"'{s}'" for s in dims.SEVERITIES])


@query("finding_violations", "X4", sql=f"""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, {CATEGORY} AS category, {SEVERITY} AS severity, CAST(l_quantity AS INTEGER) AS penalty FROM lineitem),
d AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN penalty > CASE category {' '.join(f"WHEN '{c}' THEN {v}" for c, v in dims.CATEGORY_CAPS.items())} END THEN 'penalty over cap'
        WHEN severity = 'informational' AND penalty <> 0 THEN 'informational with penalty' END AS detail FROM f)
SELECT * FROM d WHERE detail IS NOT NULL""")
def finding_violations(spark, sf):
    f = adapters.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", f"{CATEGORY} AS category", f"{SEVERITY} AS severity", "cast(l_quantity as int) AS penalty")
    return constraints.finding_violations(f).select("l_orderkey", "l_linenumber", "l_partkey", "detail")


@query("score_violations", "X5", sql="""
WITH s AS (SELECT p_partkey, p_size % 40 AS crypto, p_partkey % 21 AS exchange, 100 - p_size % 40 - p_partkey % 21 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS total FROM part),
d AS (SELECT p_partkey AS capture_id, CASE WHEN crypto > 30 OR exchange > 20 THEN 'category outside its cap' WHEN total <> greatest(0, 100 - crypto - exchange) THEN 'total does not add up' END AS detail FROM s)
SELECT * FROM d WHERE detail IS NOT NULL""")
def score_violations(spark, sf):
    s = adapters.table(spark, sf, "part").selectExpr(
        "p_partkey AS capture_id",
        "map('cryptographic_strength', cast(p_size % 40 as bigint), 'key_exchange', cast(p_partkey % 21 as bigint)) AS category_penalties",
        "100 - p_size % 40 - p_partkey % 21 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS total")
    return constraints.score_violations(s).select("capture_id", "detail")


@query("dangling_references", "X6", sql="""
WITH f AS (SELECT l_suppkey % 50 AS capture_id, 'R-' || l_linenumber AS id, 's' || l_partkey AS sa_spi FROM lineitem),
s AS (SELECT ps.c AS capture_id, 's' || p_partkey AS spi FROM part, LATERAL (SELECT p_partkey % 50 AS c) ps),
t AS (SELECT n_nationkey AS capture_id, 'T' || (1000 + n_nationkey) AS technique_id, unnest(['R-1', 'R-9']) AS id FROM nation)
SELECT capture_id, id || ' ' || sa_spi AS key, 'finding without association' AS detail FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.capture_id = f.capture_id AND s.spi = f.sa_spi)
UNION ALL SELECT capture_id, technique_id || ' ' || id, 'threat without finding' FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.capture_id = t.capture_id AND f.id = t.id)
UNION ALL SELECT capture_id, id || ' ' || sa_spi, 'duplicate finding' FROM f GROUP BY capture_id, id, sa_spi HAVING count(*) > 1""")
def dangling_references(spark, sf):
    f = adapters.spread_table(spark, sf, "lineitem", 8 << 20).selectExpr(
        "l_suppkey % 50 AS capture_id", "concat('R-', l_linenumber) AS id", "concat('s', l_partkey) AS sa_spi")
    s = adapters.table(spark, sf, "part").selectExpr(
        "p_partkey % 50 AS capture_id", "concat('s', p_partkey) AS spi_initiator", "cast(null as string) AS spi_responder")
    t = adapters.table(spark, sf, "nation").selectExpr(
        "n_nationkey AS capture_id", "concat('T', 1000 + n_nationkey) AS technique_id", "array('R-1', 'R-9') AS finding_ids")
    return constraints.dangling_references(f, s, t)


@query("format_violations", "X7", sql="""
WITH f AS (SELECT o_orderkey, o_custkey % 50 AS capture_id, CASE WHEN o_orderkey % 3 = 0 THEN lower(to_hex(o_orderkey)) ELSE lpad(lower(to_hex(o_orderkey)), 8, '0') END AS sa_spi,
             CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE 'RULE-' || o_orderkey END AS id, 'T' || (o_custkey % 1100) || CASE WHEN o_orderkey % 2 = 0 THEN '.001' ELSE '' END AS t FROM orders)
SELECT capture_id, 'spi ' || sa_spi AS detail FROM f WHERE NOT regexp_full_match(sa_spi, '[0-9a-f]{8}|[0-9a-f]{16}')
UNION ALL SELECT capture_id, 'finding ' || id FROM f WHERE NOT regexp_full_match(id, '[A-Z][A-Z0-9]*(-[A-Z0-9]+)*')
UNION ALL SELECT capture_id, 'technique ' || t FROM f WHERE NOT regexp_full_match(t, 'T[0-9]{4}(\\.[0-9]{3})?')""")
def format_violations(spark, sf):
    f = adapters.table(spark, sf, "orders").selectExpr(
        "o_custkey % 50 AS capture_id",
        "CASE WHEN o_orderkey % 3 = 0 THEN lower(hex(o_orderkey)) ELSE lpad(lower(hex(o_orderkey)), 8, '0') END AS sa_spi",
        "CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE concat('RULE-', o_orderkey) END AS id",
        "array(concat('T', o_custkey % 1100, CASE WHEN o_orderkey % 2 = 0 THEN '.001' ELSE '' END)) AS attack_techniques")
    return constraints.format_violations(f)


RULE_WHEN = ("CASE p_partkey % 4 WHEN 0 THEN '{{\"attribute\": \"dh_group\", \"operator\": \"eq\", \"value\": 2}}' "
             "WHEN 1 THEN '{{\"attribute\": \"pfs_enabled\", \"operator\": \"eq\", \"value\": false}}' "
             "WHEN 2 THEN '{{\"all\": [{{\"attribute\": \"pfs_enabled\", \"operator\": \"eq\", \"value\": false}}, {{\"attribute\": \"pfs_enabled\", \"operator\": \"confidence_gte\", \"value\": 0.7}}]}}' "
             "ELSE '{{\"any\": [{{\"all\": [{{\"attribute\": \"replay_sane\", \"operator\": \"eq\", \"value\": false}}]}}, {{\"attribute\": \"dh_group\", \"operator\": \"gt\", \"value\": 1}}]}}' END").replace("{{", "{").replace("}}", "}")
RULE_CAT = adapters.cycle("p_partkey", [f"'{c}'" for c in dims.CATEGORY_CAPS])
RULE_SEV = adapters.cycle("p_size", [f"'{s}'" for s in dims.SEVERITIES])


@query("policy_lint", "X8", sql=f"""
WITH r AS (SELECT 'R-' || (p_partkey - p_partkey % 3 % 2) AS id, {RULE_CAT} AS category, {RULE_SEV} AS severity, p_size AS penalty, p_partkey % 4 AS shape FROM part)
SELECT id, 'penalty over cap' AS defect FROM r WHERE penalty > CASE category {' '.join(f"WHEN '{c}' THEN {v}" for c, v in dims.CATEGORY_CAPS.items())} END
UNION ALL SELECT id, 'informational with penalty' FROM r WHERE severity = 'informational' AND penalty <> 0
UNION ALL SELECT id, 'duplicate id' FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT id, 'unguarded pfs_enabled' FROM r WHERE shape = 1 AND id NOT IN (SELECT id FROM r WHERE shape = 2)
UNION ALL SELECT DISTINCT id, 'unguarded replay_sane' FROM r WHERE shape = 3""")
def policy_lint(spark, sf):
    r = adapters.table(spark, sf, "part").selectExpr(
        "concat('R-', p_partkey - p_partkey % 3 % 2) AS id", f"{RULE_CAT} AS category", f"{RULE_SEV} AS severity",
        "p_size AS penalty", f"{RULE_WHEN} AS `when`")
    return policy.lint_policy(r)


@query("evidence_violations", "X10 P19", sql="""
SELECT o_orderkey AS pair_id, CASE WHEN o_custkey % 50 < least(25, o_orderkey % 30) THEN 'total below listed' ELSE 'more than 20 listed' END AS detail
FROM orders WHERE o_custkey % 50 < least(25, o_orderkey % 30) OR least(25, o_orderkey % 30) > 20""")
def evidence_violations(spark, sf):
    f = adapters.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS pair_id",
        "named_struct('packet_indices', array_repeat(0L, cast(least(25, o_orderkey % 30) as int)), 'total_matching', o_custkey % 50) AS evidence")
    return constraints.evidence_violations(f).select("pair_id", "detail")


@query("capped_evidence", "P19", sql="""
SELECT o_orderkey AS pair_id, least(20, o_orderkey % 45) AS listed, CASE WHEN o_orderkey % 45 > 20 THEN o_orderkey % 45 ELSE -1 END AS total FROM orders""")
def capped_evidence(spark, sf):
    from wirelens.functions import attrs

    o = adapters.table(spark, sf, "orders").selectExpr("o_orderkey AS pair_id", "array_repeat(1L, cast(o_orderkey % 45 as int)) AS idx")
    e = o.withColumn("e", attrs.evidence("listing", F.col("idx")))
    return e.select("pair_id", F.size("e.packet_indices").alias("listed"), F.coalesce("e.total_matching", F.lit(-1)).alias("total"))


@query("column_anomalies", "X9", sql="""
SELECT 'ratio' AS feature, count(*) FILTER (l_discount = 0) AS bad FROM lineitem UNION ALL
SELECT 'share', count(*) FILTER (l_tax = 0) FROM lineitem UNION ALL SELECT 'line', count(*) FILTER (l_linenumber = 3) FROM lineitem""")
def column_anomalies(spark, sf):
    """Line items with an infinite, an undefined and a missing measure, and a sound one."""
    m = adapters.table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_discount = 0 THEN double('Infinity') ELSE l_tax / l_discount END AS ratio",
        "CASE WHEN l_tax = 0 THEN double('NaN') ELSE l_discount / l_tax END AS share",
        "CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS line", "l_quantity AS sound")
    return constraints.bad_features(m, ["ratio", "share", "line", "sound"])
