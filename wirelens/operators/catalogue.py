"""Capture catalogue, batch manifest and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.sources import captures

MAX_ERROR = 2000


def digests(files: DataFrame) -> DataFrame:
    """path, sha256, size_bytes, magic of ``files`` (path, content); for files themselves see ``captures.digest_files``."""
    return files.select(
        "path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"),
        F.lower(F.hex(F.substring("content", 1, 4))).alias("magic"))


def register_captures(files: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """New captures: recognised by magic, one row per content.

    ``files``: path, content; or path alone, or digests as ``captures.digest_files`` takes
    them. Only hash, size and first bytes leave the scan, and a file at a path is
    hashed block by block, whatever its size.
    """
    if "sha256" in files.columns:
        facts = files
    else:
        facts = digests(files) if "content" in files.columns else captures.digest_files(files)
    new = facts.filter(F.col("magic").isin(*dims.PCAP_MAGICS))
    if catalogue is not None:
        new = new.join(catalogue.select("sha256"), "sha256", "left_anti")
    # The first path of each content, so repeated runs agree.
    return new.groupBy("sha256").agg(
        F.min("path").alias("path"), F.first("size_bytes").alias("size_bytes"), F.first("magic").alias("magic"))


def artefact_versions(files: DataFrame) -> DataFrame:
    return files.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("version"))


def page(captures: DataFrame, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest key first, with the total on every row."""
    total = captures.agg(F.count(F.lit(1))).scalar()
    rows = captures.orderBy(F.col(key).desc()).offset(offset).limit(limit)
    return rows.select("*", total.alias("total"))


def record_outcomes(log: DataFrame) -> DataFrame:
    """Latest outcome per name with its number of attempts; errors cut to 2000 characters.

    ``log``: name, finished_at, status, packet_count, duration_s, error (append only).
    """
    latest = F.max_by(F.struct("status", "packet_count", "duration_s", "error", "finished_at"), "finished_at")
    m = log.groupBy("name").agg(latest.alias("l"), F.count(F.lit(1)).alias("attempts"))
    return m.select(
        "name", "attempts", "l.status", "l.packet_count", F.round("l.duration_s", 1).alias("duration_s"),
        F.substring("l.error", 1, MAX_ERROR).alias("error"), "l.finished_at")


def pending(sessions: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions not completed before, or completed but no longer on disk."""
    done = manifest.filter(F.col("status") == "completed").select("name").join(
        files.select("name").distinct(), "name", "left_semi")
    return sessions.join(done, "name", "left_anti")
