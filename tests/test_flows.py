"""Flows, pairing against brute force, windows and features."""

import random

import pytest
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.operators import constraints, features, flows, ordered, panes, quality, windows

PACKET = ("capture_id long, index long, ts_us long, ip_version int, src string, dst string, proto string, spi long, seq long, "
          "ip_payload_len int, esp_payload_len int, captured_len int, orig_len int, udp_encapsulated boolean, ike_message_id long")


def packet(index, ts_us, up=True, spi=1, length=100, seq=None, proto="esp", capture=0, message=None, cut=False):
    a, b = ("10.0.0.1", "10.0.0.2") if up else ("10.0.0.2", "10.0.0.1")
    return (capture, index, ts_us, 4, a, b, proto, spi if proto in ("esp", "ah") else None,
            seq if seq is not None else index, length + 8, length if proto == "esp" else None,
            50 if cut else length + 42, length + 42, False, message)


def table(spark, rows):
    return spark.createDataFrame(rows, PACKET)


def brute_pairs(rows):
    """Arrival-order matching of (index, src, dst, start, end) tuples."""
    open_, out = [], []
    for f in sorted(rows):
        hit = next((o for o in open_ if o[1] == f[2] and o[2] == f[1] and o[3] <= f[4] and f[3] <= o[4]), None)
        if hit:
            open_.remove(hit)
            out.append((hit[0], f[0]))
        else:
            open_.append(f)
    return sorted(out + [(o[0], None) for o in open_], key=str)


FLOW = ("capture_id long, src string, dst string, spi long, proto string, first_index long, start_ts_us long, end_ts_us long, "
        "packets long, bytes long, ip_version int, udp_encapsulated boolean")


@pytest.mark.parametrize("kind", ["orderly", "bursty", "shuffled"])
def test_pairing_equals_brute_force_on_both_paths(spark, kind):
    rng = random.Random(kind)
    rows, flat, t = [], {}, 0
    for capture in range(12):
        mine, t = [], 0
        for i in range(40):
            t += rng.choice([0, 1, 5, 40])
            life = rng.choice([0, 2, 10, 60])
            up = (i % 2 == 0) if kind == "orderly" else rng.random() < 0.5
            start = rng.randrange(500) if kind == "shuffled" else t
            a, b = ("a", "b") if up else ("b", "a")
            mine.append((i, a, b, start, start + life))
            rows.append((capture, a, b, i, "esp", i, start, start + life, 1, 1, 4, False))
        flat[capture] = brute_pairs(mine)
    df = spark.createDataFrame(rows, FLOW)
    for limits in ({}, {"block_flows": 9, "numbered": 7}):
        got = {}
        for r in flows.pair_flows(df, **limits).collect():
            got.setdefault(r["capture_id"], []).append((r["pair_id"], r["rev"]["first_index"] if r["rev"] else None))
        assert {c: sorted(v, key=str) for c, v in got.items()} == flat


def test_a_change_that_runs_through_all_blocks_takes_few_rounds(spark, monkeypatch):
    # One flow too many: handed on from block to block, it changes every match after it.
    ways = [True] + [True, False] * 60
    flat = [(i, *(("a", "b") if up else ("b", "a")), 0, 10) for i, up in enumerate(ways)]
    df = spark.createDataFrame([(0, a, b, i, "esp", i, s, e, 1, 1, 4, False) for i, a, b, s, e in flat], FLOW)
    rounds, sweep = [], flows._sweep
    monkeypatch.setattr(flows, "_sweep", lambda *args: rounds.append(1) or sweep(*args))
    got = [(r["pair_id"], r["rev"]["first_index"] if r["rev"] else None) for r in flows.pair_flows(df, block_flows=3).collect()]
    assert sorted(got, key=str) == brute_pairs(flat)
    assert len(rounds) <= 5
    # Stretches that may not widen still come to the same end.
    monkeypatch.setattr(flows, "STRETCH_FLOWS", 3 * flows.WIDEN)
    got = [(r["pair_id"], r["rev"]["first_index"] if r["rev"] else None) for r in flows.pair_flows(df, block_flows=3).collect()]
    assert sorted(got, key=str) == brute_pairs(flat)


def test_pairs_need_overlap_and_reverse(spark):
    rows = [packet(0, 0), packet(1, 10, up=False, spi=2), packet(2, 100, spi=3), packet(3, 500, up=False, spi=4),
            packet(4, 600, proto="isakmp")]
    p = {r["pair_id"]: r for r in flows.pair_flows(flows.summarise_flows(table(spark, rows))).collect()}
    assert len(p) == 4 and not any(r["paired"] for r in p.values())
    rows.append(packet(5, 20, spi=1))
    p = [r for r in flows.pair_flows(flows.summarise_flows(table(spark, rows))).collect() if r["paired"]]
    assert [(r["fwd"]["spi"], r["rev"]["spi"]) for r in p] == [(1, 2)]


def test_quality_cases(spark):
    empty = quality.capture_quality(table(spark, []), spark.createDataFrame([(7,)], "capture_id long")).first()
    assert (empty["packet_count"], empty["duration_s"], empty["sufficient_for_lattice"]) == (0, 0.0, False)
    same = quality.capture_quality(table(spark, [packet(i, i * 1000) for i in range(300)])).first()
    assert not same["sufficient_for_lattice"] and len(same["warnings"]) == 1
    many = [packet(i, i * 1000, length=28 + 16 * (1 + i % 40)) for i in range(300)]
    assert quality.capture_quality(table(spark, many)).first()["sufficient_for_lattice"]
    late = quality.capture_quality(table(spark, [packet(0, 0, proto="isakmp", message=3)])).first()
    assert late["has_ike"] and not late["ike_complete"]
    cut = quality.capture_quality(table(spark, [*many, packet(999, 5, cut=True)])).first()
    assert cut["truncated"] and not cut["sufficient_for_lattice"]


def test_windows_step_and_anchor(spark):
    rows = [packet(i, 3_000_000 + i * 100_000) for i in range(400)]
    pairs, tagged = flows.pair_and_tag(table(spark, rows))
    w = windows.window_counts(tagged).orderBy("k").collect()
    starts = [r["start_us"] for r in w]
    assert starts[0] == 3_000_000 and {b - a for a, b in zip(starts, starts[1:])} == {5_000_000}
    assert [r["packets"] for r in w][:7] == [100] * 7


def test_reverse_only_windows_are_dropped(spark):
    rows = [packet(0, 0)] + [packet(i, 12_000_000 + i, up=False, spi=2) for i in range(1, 9)] + [packet(20, 30_000_000)]
    _, tagged = flows.pair_and_tag(table(spark, rows))
    assert [r["k"] for r in windows.window_counts(tagged).orderBy("k").collect()] == [0, 5, 6]


def test_single_packet_features_have_no_nan(spark):
    _, tagged = flows.pair_and_tag(table(spark, [packet(0, 0, length=64)]))
    for f in (panes.window_features(tagged), features.pair_features(tagged)):
        row = f.first()
        assert row["esp_len_std"] == 0.0 and row["iat_mean"] == 0.0 and row["esp_len_modal"] == 64.0
        assert constraints.bad_features(f, dims.FEATURES).count() == 0


def test_window_and_pair_features_agree_on_one_window(spark):
    rng = random.Random(5)
    rows = [packet(i, rng.randrange(9_000_000), up=rng.random() < 0.6, spi=1 + (i % 2 == 0), length=rng.randrange(0, 1400)) for i in range(2, 200)]
    rows = [r[:4] + (("10.0.0.1", "10.0.0.2") if r[7] == 1 else ("10.0.0.2", "10.0.0.1")) + r[6:] for r in rows]
    rows.insert(0, packet(0, 0, spi=1))
    _, tagged = flows.pair_and_tag(table(spark, rows))
    a = panes.window_features(tagged).filter("k = 0").first()
    b = features.pair_features(tagged).first()
    for name in dims.FEATURES:
        assert a[name] == pytest.approx(b[name], rel=1e-9, abs=1e-9), name
    assert len(dims.FEATURES) == 74


def test_sequence_vector_is_padded_and_signed(spark):
    rows = [packet(0, 0), packet(1, 1, up=False, spi=2), packet(2, 2), packet(3, 3, up=False, spi=2), packet(4, 4)]
    _, tagged = flows.pair_and_tag(table(spark, rows))
    seq = windows.sequence_vector(windows.assign_windows(tagged)).first()["seq"]
    assert len(seq) == 128 and seq[:6] == [100.0, -100.0, 100.0, -100.0, 100.0, 0.0]


def test_ordered_helpers_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b"]), i, rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, at long, v long")
    bucket = F.expr("at div 13")
    w = "over (partition by key order by at)"
    plain = {r["at"]: r for r in df.selectExpr(
        "*", f"lag(v) {w} AS lag_v", f"row_number() {w} AS rn", f"sum(v) {w} AS total",
        "max(v) over (partition by key order by at rows between unbounded preceding and 1 preceding) AS top").collect()}
    for r in ordered.lagged(df, ["key"], ["at"], bucket, ["v"]).collect():
        assert r["prev_v"] == plain[r["at"]]["lag_v"]
    for r in ordered.numbered(df, ["key"], ["at"], bucket).collect():
        assert r["rank"] == plain[r["at"]]["rn"]
    for r in ordered.running_sum(df, ["key"], ["at"], bucket, F.col("v"), "s").collect():
        assert r["s"] == plain[r["at"]]["total"]
    for r in ordered.running_max(df, ["key"], ["at"], bucket, F.col("v"), "m").collect():
        assert r["m"] == plain[r["at"]]["top"]


def test_spans_merge_touching_windows_only(spark):
    rows = [(0, 1, 0, 10, "web", 0.9), (0, 1, 5, 15, "web", 0.7), (0, 1, 10, 20, "voip", 0.8), (0, 1, 40, 50, "voip", 0.6)]
    df = spark.createDataFrame(rows, "capture_id long, pair_id long, start_us long, end_us long, label string, probability double")
    df = df.withColumn("top_features", F.col("start_us"))
    got = [(r["label"], r["probability"], r["window_start_us"], r["window_end_us"], r["top_features"])
           for r in windows.merge_spans(df, bucket_us=7).orderBy("window_start_us").collect()]
    assert got == [("web", 0.7, 0, 15, 0), ("voip", 0.8, 10, 20, 10), ("voip", 0.6, 40, 50, 40)]


def test_window_features_do_not_depend_on_how_panes_are_cut(spark):
    """Small batches split panes and windows; other window shapes equal a computation over the packets."""
    rng = random.Random(8)
    rows = [packet(i, rng.randrange(60_000_000), spi=7, length=rng.choice([0, 40, 41, 900, 1400])) for i in range(1, 900)]
    rows.insert(0, packet(0, 0, spi=7))
    _, tagged = flows.pair_and_tag(table(spark, rows))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    for shape in ((10_000_000, 5_000_000), (6_000_000, 4_000_000), (3_000_000, 5_000_000)):
        whole = sorted(map(tuple, panes.window_features(tagged, 2, *shape).collect()))
        try:
            spark.conf.set(name, "7")
            cut = sorted(map(tuple, panes.window_features(tagged, 2, *shape).collect()))
        finally:
            spark.conf.set(name, kept)
        assert cut == whole and len(whole) > 8
        times = sorted((r[2], r[1], r[10]) for r in rows)
        got = {r["k"]: r for r in panes.window_features(tagged, 1, *shape).collect()}
        for k in range(60_000_000 // shape[1]):
            mine = [t for t in times if k * shape[1] <= t[0] < k * shape[1] + shape[0]]
            assert (k in got) == bool(mine)
            if mine:
                sizes, gaps = sorted(x for *_, x in mine), [b[0] - a[0] for a, b in zip(mine, mine[1:])]
                assert got[k]["packet_count"] == len(mine) and got[k]["byte_count"] == sum(sizes)
                assert got[k]["esp_len_p50"] == sizes[((len(sizes) - 1) * 50 + 50) // 100]
                assert got[k]["iat_max"] == max(gaps, default=0) / 1e6 and got[k]["esp_len_distinct"] == len(set(sizes))
        counts = {r["k"]: r["packets"] for r in windows.window_counts(tagged, *shape).collect()}
        assert counts == {k: r["packet_count"] for k, r in got.items()}
