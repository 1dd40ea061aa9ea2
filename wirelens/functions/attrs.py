"""Facts with provenance: ``struct<value, provenance, confidence, evidence, note>``.

observed: value, no confidence. inferred: value and confidence. unavailable:
neither, but a reason in ``note``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVIDENCE_TYPE = (
    "struct<method:string,packet_indices:array<bigint>,"
    "measured:map<string,string>,total_matching:bigint>"
)
MAX_INDICES = 20


def attribute_type(value_type: str) -> str:
    return (
        f"struct<value:{value_type},provenance:string,confidence:double,"
        f"evidence:{EVIDENCE_TYPE},note:string>"
    )


def evidence(method: str | Column, indices: Column | None = None, measured: dict | None = None,
             total: Column | None = None) -> Column:
    """Evidence with at most 20 listed packets; ``total_matching`` only when cut.

    ``total`` is given when ``indices`` was already shortened upstream.
    """
    listed = indices if indices is not None else F.array().cast("array<bigint>")
    full = total if total is not None else F.size(listed)
    pairs = []
    for name, value in (measured or {}).items():
        pairs += [F.lit(name), value.cast("string")]
    return F.struct(
        (F.lit(method) if isinstance(method, str) else method).alias("method"),
        F.slice(listed, 1, MAX_INDICES).cast("array<bigint>").alias("packet_indices"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("measured"),
        F.when(full > MAX_INDICES, full.cast("bigint")).alias("total_matching"),
    ).cast(EVIDENCE_TYPE)


def _build(value_type, value, provenance, confidence, proof, note) -> Column:
    return F.struct(
        (value if value is not None else F.lit(None)).cast(value_type).alias("value"),
        F.lit(provenance).alias("provenance"),
        (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"),
        (proof if proof is not None else F.lit(None).cast(EVIDENCE_TYPE)).alias("evidence"),
        (F.lit(note) if isinstance(note, str) or note is None else note).cast("string").alias("note"),
    ).cast(attribute_type(value_type))


def observed(value: Column, value_type: str, proof: Column | None = None, note=None) -> Column:
    return _build(value_type, value, "observed", None, proof, note)


def inferred(value: Column, value_type: str, confidence, proof: Column | None = None, note=None) -> Column:
    level = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return _build(value_type, value, "inferred", level, proof, note)


def unavailable(note: str | Column, value_type: str, proof: Column | None = None) -> Column:
    return _build(value_type, None, "unavailable", None, proof, note)
