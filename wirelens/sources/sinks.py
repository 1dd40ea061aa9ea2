"""Result tables: assessments, findings, associations, matrices and artefacts."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.operators import ordered
from wirelens.session import materialise


DYNAMIC = {"partitionOverwriteMode": "dynamic"}


# Associations in one document; larger captures continue in further parts.
PART_ASSOCIATIONS = 10_000


def assessment_documents(quality: DataFrame, sas: DataFrame, findings: DataFrame, scores: DataFrame,
                         exposure: DataFrame, threats: DataFrame, ids: DataFrame,
                         part_associations: int = PART_ASSOCIATIONS) -> DataFrame:
    """JSON documents per capture, with the promoted scalars beside them.

    ``ids``: capture_id, assessment_id, generated_at, engine_version,
    policy_version, model_versions (supplied by the caller, so runs repeat
    byte for byte). A capture is one document unless it holds more than
    ``part_associations`` associations; then it continues in numbered parts,
    each with its associations and their findings, so no list is unbounded.
    """
    key = ["capture_id", "part"]

    def listed(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
        rest = [c for c in df.columns if c not in key]
        item = F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("v"))
        return df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(item), _by_order), lambda i: i["v"]).alias(name))

    def whole(df: DataFrame, name: str) -> DataFrame:
        return df.select("capture_id", F.struct(*[c for c in df.columns if c != "capture_id"]).alias(name))

    numbered = ordered.numbered(sas.select("capture_id", "pair_id"), ["capture_id"], ["pair_id"],
                                F.expr("pair_id div 1000000"), "place")
    parts = materialise(numbered.select("capture_id", "pair_id", F.expr(f"(place - 1) div {part_associations}").alias("part")))
    last = parts.groupBy("capture_id").agg(F.max("part").alias("_last"))
    heads = ids.join(last, "capture_id", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_last", F.lit(0).cast("bigint"))))).drop("_last")
    worst = [dims.severity_rank(F.col("severity")).alias("a"), (-F.col("penalty")).alias("b"), F.col("id").alias("c"),
             F.coalesce("sa_spi", F.lit("")).alias("d")]
    # Techniques of a capture are few: at most one row per rule and technique.
    threat_list = listed(threats.withColumn("part", F.lit(0).cast("bigint")), "threat_matrix",
                         [F.col("technique_id").alias("a")]).drop("part")
    pairs = ["capture_id", "pair_id"]
    doc = (
        heads.join(whole(quality, "capture_quality"), "capture_id")
        .join(listed(_dated(sas).join(parts, pairs), "security_associations", [F.col("pair_id").alias("a")]), key, "left")
        .join(listed(findings.join(parts, pairs), "findings", worst), key, "left")
        .join(scores.select("capture_id", F.struct("total", "category_penalties", "rating").alias("score")), "capture_id", "left")
        .join(whole(exposure, "metadata_exposure"), "capture_id", "left")
        .join(threat_list, "capture_id", "left")
    )
    body = ["assessment_id", "capture_id", "generated_at", "engine_version", "policy_version", "model_versions",
            "capture_quality", "security_associations", "findings", "score", "metadata_exposure", "threat_matrix"]
    text = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), *body), {"ignoreNullFields": "false"})
    return doc.select(
        "assessment_id", "capture_id", "part", "generated_at", "engine_version", "policy_version",
        F.col("score.total").alias("score_total"), F.col("score.rating").alias("rating"),
        F.col("metadata_exposure.score").alias("exposure_score"), text.alias("document"))


def _by_order(a: Column, b: Column) -> Column:
    return F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)


def _dated(sas: DataFrame) -> DataFrame:
    """Times as UTC text with a ``Z``, independent of the session's zone."""
    def text(us: str) -> Column:
        stamp = F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({us} as decimal(20,6)) / 1000000)")
        return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    return sas.withColumns({"first_seen": text("first_us"), "last_seen": text("last_us")}).drop("first_us", "last_us")


def write_assessments(documents: DataFrame, findings: DataFrame, sas: DataFrame, folder: str) -> None:
    """Three tables partitioned by capture; writing a capture again replaces it.

    Rows are clustered by capture first, so each capture's partition gets few
    files; a capture with many rows is spread over several writers.
    """
    for name, df, order in (
        ("assessments", documents, "assessment_id"), ("findings", findings, "severity"),
        ("security_associations", sas, "pair_id"),
    ):
        (
            df.hint("rebalance", "capture_id").sortWithinPartitions("capture_id", order)
            .write.mode("overwrite").options(**DYNAMIC).partitionBy("capture_id").parquet(f"{folder}/{name}")
        )


def write_documents(documents: DataFrame, folder: str) -> None:
    """The documents alone, one JSON text per line."""
    documents.select("document").write.mode("overwrite").text(folder)


def write_matrix(matrix: DataFrame, folder: str) -> None:
    """Feature matrix partitioned by fold."""
    matrix.write.mode("overwrite").options(**DYNAMIC).partitionBy("fold").parquet(folder)


def write_metrics(rows: DataFrame, folder: str, title: str) -> None:
    """Evaluation, reliability or knot rows: a small table with its title."""
    rows.withColumn("title", F.lit(title)).coalesce(1).write.mode("overwrite").json(folder)




def write_captures(frames: DataFrame, folder: str, part_frames: int = 1_000_000) -> DataFrame:
    """(path, frames) of classic capture files below ``folder``, written by tasks: one a capture, link type and ``part_frames`` indexes.

    ``frames``: capture_id, index, ts_us, linktype, frame, orig_len. A file's name does not
    depend on the attempt that writes it, so a repeated task replaces what it left.
    """
    from pyarrow import fs

    key = ["capture_id", "linktype", "part"]
    rows = frames.select("capture_id", "linktype", F.expr(f"index div {part_frames}").alias("part"), "index", "ts_us", "orig_len", "frame")
    rows = rows.repartition(*key).sortWithinPartitions(*key, "ts_us", "index")

    def run(batches):
        name, out, count = None, None, 0
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        system.create_dir(root, recursive=True)
        done = []
        for batch in batches:
            for capture, linktype, part, _, ts, length, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != (capture, linktype, part):
                    if out is not None:
                        out.close()
                        done.append((path, count))
                    name, count, path = (capture, linktype, part), 0, f"{root}/{capture}-{linktype}-{part}.pcap"
                    out = system.open_output_stream(path)
                    out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 0, linktype))
                out.write(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(frame), length) + frame)
                count += 1
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "frames"])

    return rows.mapInArrow(run, "path string, frames long")
