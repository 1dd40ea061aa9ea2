"""Label sidecars and calibration artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = (
    "name string, schema_version string, generated_at string, seed long, "
    "dimensions struct<dh:int,duration_s:int,esp:string,ike:string,ip:string,lifetime_s:int,mode:string,pfs:boolean,traffic:string>, "
    "expected struct<auth_method:string,dh_group:int,encryption_alg:string,encryption_keylen:int,ike_exchange_mode:string,"
    "ike_version:string,integrity_alg:string,negotiated_lifetime_s:int,operating_mode:string,pfs_enabled:boolean,"
    "prf_alg:string,traffic_class:string>, "
    "not_observable_from_ike map<string,string>, "
    "observed struct<has_ike_delete:boolean,ike_packets:int,negotiated_esp:string,negotiated_ike:string,packet_count:int>, "
    "peers struct<left:string,left_ts:string,right:string,right_ts:string,subnet:string>, "
    "proposals struct<esp:string,ike:string>, image_versions map<string,string>"
)


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """Ground truth of every session below ``root``; malformed files fail the read."""
    rows = (
        spark.read.option("multiLine", "true").option("mode", "FAILFAST").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "labels.json").schema(LABELS).json(root)
    )
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return rows.withColumn("session_name", folder)


def read_knots(spark: SparkSession, path: str) -> list[dict[str, list[float]]]:
    """Calibration knots in class order: one small artefact of a model."""
    rows = spark.read.schema("position int, x array<double>, y array<double>").json(path).orderBy("position").collect()
    return [{"x": list(r["x"]), "y": list(r["y"])} for r in rows]


def write_knots(spark: SparkSession, knots: list[dict[str, list[float]]], path: str) -> None:
    rows = [(i, k["x"], k["y"]) for i, k in enumerate(knots)]
    spark.createDataFrame(rows, "position int, x array<double>, y array<double>").coalesce(1).write.mode("overwrite").json(path)
