"""Streaming operators over several micro-batches: results equal the whole table's."""

import uuid

from pyspark.sql import functions as F

from wirelens.session import checkpoint_ready
from wirelens.streaming import live

SCHEMA = "capture_id long, index long, ts_us long, src string, dst string, spi long, seq long"


def streamed(spark, batches, operator):
    """Rows of ``operator`` with each list of packets as a micro-batch of its own."""
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/test-{uuid.uuid4().hex}"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/b{k:02}")
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    live.run_available(operator(files), f"{folder}/out")
    return spark.read.parquet(f"{folder}/out/rows")


def packet(n, second, spi, seq):
    return (0, n, int((1000 + second) * 1_000_000), "a", "b", spi, seq)


def test_an_spi_that_lives_for_minutes_starts_once(spark):
    batches = [[packet(100 * k + j, 30 * k + j, 7, 100 * k + j) for j in range(29)] for k in range(6)]
    batches[4].append(packet(990, 149, 8, 1))
    batches[5].append(packet(991, 170, 8, 2))
    got = live.rekey_gaps(streamed(spark, batches, live.stream_starts)).collect()
    assert sorted((r["spi"], r["start_us"], r["gap_s"]) for r in got) == [(7, 1_000_000_000, -1), (8, 1_149_000_000, 149)]


def test_counts_survive_an_idle_gap(spark):
    first = [packet(s, s / 10, 5, s) for s in range(1, 100)]
    other = [packet(1000 + k, 300 + k, 6, k) for k in range(50)]  # moves the watermark past the idle time
    later = [packet(2000 + s, 600 + s / 10, 5, s) for s in range(100, 200) if s != 150] + [packet(3000, 621, 5, 120), packet(3001, 622, 5, 130)]
    rows = streamed(spark, [first, other, later, [packet(4000, 900, 6, 70)]], lambda p: live.stream_sequence(p, idle_ms=60_000))
    got = {r["spi"]: r for r in live.sequence_totals(rows).collect()}
    five = got[5]
    assert (five["packets"], five["duplicates"], five["out_of_order"], five["first_seq"], five["last_seq"], five["missing"]) == (200, 2, 1, 1, 199, 1)
    assert got[6]["missing"] == 20 and abs(got[6]["gap_ratio"] - 20 / 71) < 1e-6


def test_batches_and_one_table_agree(spark):
    packets = [packet(n, n / 5, n % 3, (n * 7) % 400 + 65_400) for n in range(900)]
    parts = [packets[k : k + 150] for k in range(0, 900, 150)]
    many = live.sequence_totals(streamed(spark, parts, live.stream_sequence))
    one = live.sequence_totals(streamed(spark, [packets], live.stream_sequence))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect())) and many.count() == 3
    assert many.agg(F.sum("packets")).first()[0] == 900
