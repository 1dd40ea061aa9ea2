"""The whole assessment: packets and messages to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelens.catalog.registry import query
from wirelens.plans import adapters, assess
from wirelens.session import materialise
from wirelens.sources import sinks


def assessed(spark, sf):
    """Packets are written once: five results read them, and each would rank every flow anew."""
    packets = materialise(adapters.packets(spark, sf, sequenced=True))

    def messages(spis=None):
        return adapters.ike_messages(spark, sf, spis).withColumn("length", F.lit(0))

    return assess.assess(packets, messages(), of_spis=messages)


CONDITIONS = [
    ("CRYPTO-3DES", "cryptographic_strength", 30, "enc_v = '3des-cbc' AND enc_c >= 0.7"),
    ("CRYPTO-DES", "cryptographic_strength", 30, "enc_v = 'des-cbc' AND enc_c >= 0.7"),
    ("CRYPTO-WEAK-INTEG-MD5", "cryptographic_strength", 12, "int_v = 'hmac-md5-96' AND int_c >= 0.7"),
    ("CRYPTO-SHA1", "cryptographic_strength", 8, "int_v = 'hmac-sha1-96' AND int_c >= 0.7"),
    ("CRYPTO-DOWNGRADE-OFFER", "cryptographic_strength", 15, "answered AND downgrade_available"),
    ("KEX-WEAK-DH", "key_exchange", 15, "dh_group IN (1, 2, 5)"),
    ("PROTO-AGGRESSIVE-MODE", "protocol_version_mode", 10, "exchange_mode = 'aggressive'"),
    ("PROTO-IKEV1", "protocol_version_mode", 7, "ike_version = 'ikev1'"),
    ("KEYMGMT-LONG-LIFETIME", "key_management", 10, "lifetime_s > 28800"),
    ("REPLAY-SEQ-ANOMALY", "replay_integrity", 10, "n >= 20 AND NOT (d = 0 AND g <= 0.02)"),
]


def _findings_sql() -> str:
    """Findings of view ``a`` by rule number, one scan."""
    hits = ", ".join(f"CASE WHEN {w} THEN {i} END" for i, (_, _, _, w) in enumerate(CONDITIONS))
    names = " ".join(f"WHEN {i} THEN '{r}'" for i, (r, _, _, _) in enumerate(CONDITIONS))
    groups = " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c, _, _) in enumerate(CONDITIONS))
    costs = " ".join(f"WHEN {i} THEN {p}" for i, (_, _, p, _) in enumerate(CONDITIONS))
    return (f"f AS (SELECT capture_id, fwd_spi, CASE r {names} END AS id, CASE r {groups} END AS category, CASE r {costs} END AS penalty "
            f"FROM (SELECT capture_id, fwd_spi, unnest([{hits}]) AS r FROM a) WHERE r IS NOT NULL)")


RULE_SQL = """
b AS (SELECT s.capture_id, s.pair_id, s.fwd_spi, s.first_us, s.last_us, c.* EXCLUDE (capture_id, pair_id) FROM pairs s JOIN correlated c USING (capture_id, pair_id)),
h AS (SELECT capture_id, pair_id, sum(packets) AS n, sum(duplicates) AS d, max(gap_ratio) AS g FROM seq_stats GROUP BY capture_id, pair_id),
v AS (SELECT capture_id, pair_id, any_value(encryption) FILTER (place = 1) AS enc, any_value(integrity) FILTER (place = 1) AS integ,
        1.0::DOUBLE - (count(DISTINCT encryption) - 1) / 5.0::DOUBLE AS ec, 1.0::DOUBLE - (count(DISTINCT integrity) - 1) / 3.0::DOUBLE AS ic
      FROM ranked_survivors JOIN quality USING (capture_id) WHERE NOT truncated AND sufficient_for_lattice GROUP BY capture_id, pair_id),
a AS (SELECT b.*, h.n, h.d, h.g,
        CASE WHEN encryption_alg IS NOT NULL AND encryption_alg <> 'unknown' THEN encryption_alg ELSE v.enc END AS enc_v,
        CASE WHEN encryption_alg IS NOT NULL AND encryption_alg <> 'unknown' THEN 0.6 ELSE v.ec END AS enc_c,
        CASE WHEN integrity_alg IS NOT NULL AND integrity_alg <> 'unknown' THEN integrity_alg ELSE v.integ END AS int_v,
        CASE WHEN integrity_alg IS NOT NULL AND integrity_alg <> 'unknown' THEN 0.6 ELSE v.ic END AS int_c
      FROM b LEFT JOIN h USING (capture_id, pair_id) LEFT JOIN v USING (capture_id, pair_id)),
""" + _findings_sql()


@query("assessment_findings", "S9 J16 P33", views="pairs correlated seq_stats ranked_survivors quality", sql="WITH " + RULE_SQL.strip() + """
SELECT capture_id, lpad(lower(to_hex(fwd_spi)), 8, '0') AS sa_spi, id, category, penalty FROM f""")
def assessment_findings(spark, sf):
    """Findings of the complete assessment of every capture."""
    return assessed(spark, sf).findings.select("capture_id", "sa_spi", "id", "category", "penalty")


def documents(spark, sf):
    a = assessed(spark, sf)
    ids = a.quality.select(
        "capture_id", F.concat(F.lit("assessment-"), F.col("capture_id")).alias("assessment_id"),
        F.lit("2024-01-31T00:00:00Z").alias("generated_at"), F.lit("1").alias("engine_version"),
        F.lit("1.0").alias("policy_version"), F.create_map().cast("map<string,string>").alias("model_versions"))
    return sinks.assessment_documents(a.quality, a.sas, a.findings, a.scores, a.exposure, a.threats, ids)


@query("assessment_documents", "S10 S9", views="pairs correlated seq_stats ranked_survivors quality caps", sql="WITH " + RULE_SQL.strip() + """,
t AS (SELECT capture_id, greatest(0, 100 - sum(capped)) AS total, sum(n) AS findings FROM (
  SELECT capture_id, category, least(sum(penalty), any_value(cap)) AS capped, count(*) AS n FROM f JOIN caps USING (category) GROUP BY capture_id, category) GROUP BY capture_id)
SELECT q.capture_id, 'assessment-' || q.capture_id AS assessment_id, CAST(coalesce(total, 100) AS BIGINT) AS score_total, 0 AS exposure_score,
       CAST(coalesce(findings, 0) AS BIGINT) AS findings, (SELECT count(*) FROM pairs p WHERE p.capture_id = q.capture_id) AS associations
FROM quality q LEFT JOIN t ON t.capture_id = q.capture_id""")
def assessment_documents(spark, sf):
    """Documents read back: promoted score beside counts taken from the JSON text."""
    d = documents(spark, sf)
    return d.select(
        "capture_id", "assessment_id", "score_total", "exposure_score",
        F.coalesce(F.json_array_length(F.get_json_object("document", "$.findings")), F.lit(0)).cast("bigint").alias("findings"),
        F.coalesce(F.json_array_length(F.get_json_object("document", "$.security_associations")), F.lit(0)).cast("bigint").alias("associations"))
