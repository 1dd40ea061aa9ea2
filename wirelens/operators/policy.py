"""Rules as column predicates, evaluated in one scan of the associations."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.functions import attrs

BASELINE = Path(__file__).resolve().parent.parent / "data" / "baseline_policy.json"
TYPES = {name: typ for name, _, typ in dims.PARAMETERS}
RULE_SCHEMA = (
    "id string, category string, severity string, penalty int, when string, title string, "
    "description string, remediation string, standards array<struct<ref:string,clause:string>>, "
    "attack array<string>"
)


def load_policy(path: str | Path = BASELINE) -> list[dict]:
    """Rules of one policy file: configuration, a few kilobytes, read by the driver.

    JSON, or YAML where its parser is installed.
    """
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)["rules"]
    return json.loads(text)["rules"]


def policy_rules(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """The rules as a table; conditions keep their JSON text."""
    rows = [{**r, "when": json.dumps(r["when"]),
             "standards": r.get("standards", []), "attack": r.get("attack", [])} for r in rules]
    names = [f.split()[0] for f in RULE_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RULE_SCHEMA)


def leaves(condition: dict) -> list[dict]:
    branches = condition.get("all") or condition.get("any")
    return [leaf for b in branches for leaf in leaves(b)] if branches else [condition]


def referenced(condition: dict) -> list[str]:
    """Attributes tested, without confidence guards, sorted."""
    return sorted({c["attribute"] for c in leaves(condition) if c["operator"] != "confidence_gte"})


def guarded(condition: dict) -> list[str]:
    return sorted({c["attribute"] for c in leaves(condition) if c["operator"] == "confidence_gte"})


def derived(sas: DataFrame) -> DataFrame:
    """Add the three per-association values that are no contract field."""
    n = F.size("inner_traffic")
    total = F.aggregate("inner_traffic", F.lit(0.0), lambda acc, p: acc + p["probability"])
    return sas.withColumns({
        "metadata_exposure_confidence": F.when(n > 0, total / F.when(n > 0, n)).otherwise(0.0),
        "rekey_observed": F.col("observed_rekey_s.provenance") != "unavailable",
        "sa_duration_s": (F.col("last_us") - F.col("first_us")) / 1e6,
    })


def _value(name: str) -> Column:
    if name in dims.DERIVED:
        return F.col(name)
    return F.when(F.col(name)["provenance"] != "unavailable", F.col(name)["value"])


def _literal_type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "number" if isinstance(value, (int, float)) else "string"


def _kind(name: str) -> str:
    if name in dims.DERIVED:
        return "boolean" if name == "rekey_observed" else "number"
    return {"int": "number"}.get(TYPES[name], TYPES[name])


def predicate(condition: dict) -> Column:
    """A condition tree as one boolean column; unavailable values match nothing."""
    if condition.get("all") or condition.get("any"):
        parts = [predicate(b) for b in condition.get("all") or condition["any"]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if condition.get("all") else out | p
        return out
    name, op = condition["attribute"], condition["operator"]
    if name not in dims.DERIVED and name not in TYPES:
        return F.lit(False)
    if op == "confidence_gte":
        if name in dims.DERIVED:
            return F.col(name).isNotNull()
        a = F.col(name)
        return F.coalesce(
            (a["provenance"] == "observed")
            | ((a["provenance"] == "inferred") & (a["confidence"] >= float(condition["value"]))),
            F.lit(False))
    kind, v = _kind(name), _value(name)
    if op in ("eq", "in"):
        wanted = [condition["value"]] if op == "eq" else condition["values"]
        same = [w for w in wanted if _literal_type(w) == kind]
        return F.coalesce(v.isin(*same), F.lit(False)) if same else F.lit(False)
    if kind != "number":
        return F.lit(False)
    bound = F.lit(float(condition["value"]))
    test = v.cast("double") < bound if op == "lt" else v.cast("double") > bound
    return F.coalesce(test, F.lit(False))


def _finding(rule: dict) -> Column:
    measured = {name: _value(name) for name in referenced(rule["when"])}
    pairs = [p for name, v in measured.items() for p in (F.lit(name), v.cast("string"))]
    proof = F.struct(
        F.lit(f"policy_rule:{rule['id']}").alias("method"),
        F.array().cast("array<bigint>").alias("packet_indices"),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("measured"),
        F.lit(None).cast("bigint").alias("total_matching"),
    ).cast(attrs.EVIDENCE_TYPE)
    standards = [F.struct(F.lit(s["ref"]).alias("ref"), F.lit(s["clause"]).alias("clause"))
                 for s in rule.get("standards", [])]
    return F.struct(
        F.lit(rule["id"]).alias("id"), F.lit(rule["title"]).alias("title"),
        F.lit(rule["severity"]).alias("severity"), F.lit(rule["category"]).alias("category"),
        F.lit(int(rule["penalty"])).alias("penalty"), F.lit(rule["description"]).alias("description"),
        F.lit(rule["remediation"]).alias("remediation"),
        F.array(*standards).cast("array<struct<ref:string,clause:string>>").alias("standards"),
        F.array(*[F.lit(t) for t in rule.get("attack", [])]).cast("array<string>").alias("attack_techniques"),
        proof.alias("evidence"),
    )


def evaluate_policy(sas: DataFrame, rules: list[dict]) -> DataFrame:
    """One finding per matching (rule, association); a narrow, shuffle-free scan."""
    hits = F.array(*[F.when(predicate(r["when"]), _finding(r)) for r in rules])
    return (
        derived(sas)
        .select("capture_id", "pair_id", F.col("spi_initiator").alias("sa_spi"),
                F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("f"))
        .select("capture_id", "pair_id", "sa_spi", "f.*")
    )


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per (capture, rule, SPI): the first association's.

    Each column is reduced on its own, so those a reader leaves out are never shuffled;
    all meet the rows in the same order, so a tie gives every column the same row.
    """
    key = ["capture_id", "id", "sa_spi"]
    rest = [c for c in findings.columns if c not in key]
    return findings.groupBy(*key).agg(*[F.min_by(c, "pair_id").alias(c) for c in rest])


def lint_policy(rules: DataFrame) -> DataFrame:
    """Rule defects: over the cap, priced observation, unguarded inference, repeated id."""
    leaf = "$.attribute"
    caps = dims.lookup(dims.CATEGORY_CAPS, F.col("category"))
    over = rules.filter(F.col("penalty") > caps).select("id", F.lit("penalty over cap").alias("defect"))
    priced = rules.filter((F.col("severity") == "informational") & (F.col("penalty") != 0)).select(
        "id", F.lit("informational with penalty").alias("defect"))
    twice = rules.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate id").alias("defect"))
    # Leaves of the condition text, whatever their depth.
    tests = rules.select("id", F.explode(F.regexp_extract_all("when", F.lit(r"(\{[^{}]*\})"), F.lit(1))).alias("leaf"))
    tests = tests.select("id", F.get_json_object("leaf", leaf).alias("attribute"),
                         F.get_json_object("leaf", "$.operator").alias("operator"))
    used = tests.filter((F.col("operator") != "confidence_gte") & F.col("attribute").isin(*dims.INFERABLE))
    guards = tests.filter(F.col("operator") == "confidence_gte")
    bare = used.join(guards, ["id", "attribute"], "left_anti").select(
        "id", F.concat(F.lit("unguarded "), "attribute").alias("defect")).distinct()
    return over.unionByName(priced).unionByName(twice).unionByName(bare)
