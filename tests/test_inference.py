"""Suite sieve, sequence health, rekeys, forward secrecy and negotiations."""

import pytest
from pyspark.sql import functions as F

from test_flows import packet, table
from wirelens.operators import flows, ike, lattice, pfs, quality, replay


def sieve(spark, lengths):
    rows = [(0, 0, n, 1) for n in lengths]
    hist = spark.createDataFrame(rows, "capture_id long, pair_id long, length int, packets long")
    q = spark.createDataFrame([(0, False, True)], "capture_id long, truncated boolean, sufficient_for_lattice boolean")
    return lattice.detect_suite(lattice.suite_survivors(hist), q).first()


def test_cbc_sha1_is_named(spark):
    r = sieve(spark, [28 + 16 * k for k in range(1, 41)])
    assert r["suite"]["value"] == "AES-CBC + HMAC-SHA1-96" and r["encryption_alg"]["value"] == "aes-cbc"


def test_gcm_before_chacha_and_uncertain(spark):
    r = sieve(spark, [24 + 4 * k for k in range(1, 41)])
    assert r["suite"]["value"] == "AES-GCM-16" and 0 < r["suite"]["confidence"] < 1


def test_no_suite_fits(spark):
    r = sieve(spark, range(31, 46, 2))
    assert r["suite"]["provenance"] == "unavailable" and r["suite"]["note"] == lattice.NO_SUITE


def test_confidence_ends(spark):
    row = spark.range(1).select(lattice.survivor_confidence(F.lit(1), 8).alias("a"), lattice.survivor_confidence(F.lit(8), 8).alias("b")).first()
    assert (row["a"], row["b"]) == (1.0, 0.0)


def health(spark, seqs):
    _, tagged = flows.pair_and_tag(table(spark, [packet(i, i, seq=s) for i, s in enumerate(seqs)]))
    return replay.sequence_health(replay.sequence_stats(tagged, bucket_rows=7)).first()


def test_sequence_goldens(spark):
    assert health(spark, range(50))["replay_sane"]["value"] is True
    bad = health(spark, [i % 25 for i in range(50)])
    assert bad["replay_sane"]["value"] is False and bad["duplicates"] == 25 and bad["out_of_order"] == 1
    assert health(spark, range(5))["replay_sane"]["provenance"] == "unavailable"


def rekeys(spark, starts):
    rows = [(0, "a", "b", i, s * 1_000_000, i) for i, s in enumerate(starts)]
    f = spark.createDataFrame(rows, "capture_id long, src string, dst string, spi long, start_ts_us long, first_index long")
    return replay.rekey_interval(flows.spi_series(f)).first()["observed_rekey_s"]


def test_rekey_upper_median(spark):
    assert rekeys(spark, [0, 298, 601])["value"] == 303
    assert rekeys(spark, [0])["provenance"] == "unavailable"


@pytest.mark.parametrize("sizes, base, group, value, confidence", [
    ([664] * 3, [400] * 5, 14, True, 0.9), ([405, 402, 408], [400], 14, False, 0.9), ([472] * 3, [400] * 5, 19, True, 0.65),
    ([], [400], 14, None, None), ([400], [], 14, None, None), ([400], [400], None, None, None), ([400], [400], 99, None, None)])
def test_pfs_goldens(spark, sizes, base, group, value, confidence):
    def hist(values):
        return spark.createDataFrame([(0, "a", "b", v, 1) for v in values], "capture_id long, lo string, hi string, length int, messages long")

    g = spark.createDataFrame([(0, "a", "b", group)], "capture_id long, lo string, hi string, dh_group int")
    r = pfs.infer_pfs(hist(sizes), hist(base), g).first()["pfs_enabled"]
    assert (r["value"], r["confidence"]) == (value, confidence)
    assert (r["note"] or "").strip()


NEG = "capture_id long, src string, dst string, ts_us long, request_frame long, response_frame long"


def asof(spark, negs, start, ends=("a", "b")):
    n = spark.createDataFrame([(0, *x) for x in negs], NEG)
    r = spark.createDataFrame([(0, 5, ends[0], ends[1], start)], "capture_id long, pair_id long, src string, dst string, fwd_start_us long")
    m = ike.correlate(r, n).first()["negotiation"]
    return m and m["request_frame"]


def test_asof_cases(spark):
    s = 1_000_000
    assert asof(spark, [("b", "a", 10 * s, 1, 2)], 20 * s) == 1
    assert asof(spark, [("a", "b", 10 * s, 1, 2)], 41 * s) is None
    assert asof(spark, [("a", "b", 10 * s, 1, 2)], 40 * s) == 1
    assert asof(spark, [("a", "b", 10 * s, 1, 2)], 9 * s) is None
    assert asof(spark, [("a", "c", 10 * s, 1, 2)], 11 * s) is None
    assert asof(spark, [("a", "b", 10 * s, 1, 2), ("a", "b", 12 * s, 3, 4)], 15 * s) == 3
    assert asof(spark, [("a", "b", 10 * s, 5, 6), ("a", "b", 10 * s, 1, 2)], 15 * s) == 1


def test_matching_messages_builds_only_what_is_matched(spark, monkeypatch):
    from wirelens.plans import adapters
    m = adapters.ike_messages(spark, "/root/testdata/sf0.001")
    s = 1_000_000
    starts = [("10.0.0.1", "10.0.0.2", 3 * s), ("10.0.1.2", "10.0.1.1", 40 * s), ("10.0.2.1", "10.0.2.2", 500 * s), ("x", "y", 3 * s)]
    r = spark.createDataFrame([(i % 4, i, *x) for i, x in enumerate(starts)], "capture_id long, pair_id long, src string, dst string, fwd_start_us long")

    def matched(df):
        return sorted((x["pair_id"], x["negotiation"] and x["negotiation"].asDict(True)) for x in df.collect())

    want = matched(ike.correlate(r, ike.build_negotiations(m)))
    # Times and endpoints are told without any proposal.
    assert "sequence(" not in ike.negotiation_heads(m)._jdf.queryExecution().optimizedPlan().toString()
    built, build = [], ike.build_negotiations
    monkeypatch.setattr(ike, "build_negotiations", lambda rows: built.append(rows.select("init_spi").distinct().count()) or build(rows))
    assert matched(ike.correlate_messages(r, m)) == want
    assert built == [sum(n is not None for _, n in want)] and built[0] == 2


def test_messages_of_some_spis_make_no_other_proposals(spark):
    from wirelens.plans import adapters
    folder = "/root/testdata/sf0.001"
    every = adapters.ike_messages(spark, folder)
    wanted = every.select("capture_id", "init_spi").distinct().orderBy("init_spi").limit(7)
    spis = spark.createDataFrame([(None, None), (99, "0"), *wanted.collect()], "capture_id long, init_spi string")
    some = adapters.ike_messages(spark, folder, spis)
    want = every.join(spis, ["capture_id", "init_spi"], "left_semi").select(every.columns)
    assert sorted(map(repr, some.collect())) == sorted(map(repr, want.collect())) and some.count() >= 7
    # Rows are left out below the step that makes their proposals.
    lines = some._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, x in enumerate(lines) if "LeftSemi" in x]
    assert joins and not any("sequence(" in x for i in joins for x in lines[i:i + 3])


def proposal(number, *transforms):
    return (number, 1, [(k, i, [(14, bits)] if bits else []) for k, i, bits in transforms])


def negotiation(spark, offers, chosen, version="ikev2"):
    rows = [(0, "s", version, 34, 1, 0, "a", "b", None, offers, False), (0, "s", version, 34, 2, 1, "b", "a", "r", [chosen], False)]
    m = spark.createDataFrame(rows, "capture_id long, init_spi string, ike_version string, exchange_type int, frame_index long, ts_us long, "
                                    f"src string, dst string, resp_spi string, sa_payload {ike.PROPOSALS_TYPE}, nat_detected boolean")
    return ike.build_negotiations(m).first()


def test_downgrade_and_names(spark):
    strong = proposal(1, (1, 12, 256), (2, 5, None), (3, 12, None), (4, 19, None))
    weak = proposal(2, (1, 3, None))
    r = negotiation(spark, [strong, weak], strong)
    assert (r["encryption_alg"], r["encryption_keylen"], r["dh_group"], r["prf_alg"], r["downgrade_available"]) == (
        "aes-cbc", 256, 19, "hmac-sha256", True)
    assert not negotiation(spark, [weak], weak)["downgrade_available"]
    odd = proposal(3, (1, 99, None))
    assert not negotiation(spark, [strong, odd], strong)["downgrade_available"]


def test_overlay_never_overwrites(spark):
    attr = "struct<value:string,provenance:string,confidence:double,note:string>"
    sas = spark.createDataFrame([(0, 1, ("aes-cbc", "observed", None, None), (None, "unavailable", None, "x"))],
                                f"capture_id long, pair_id long, encryption_alg {attr}, integrity_alg {attr}")
    inf = spark.createDataFrame([(0, 1, ("3des-cbc", "inferred", 0.9, None), ("none", "inferred", 0.9, None))],
                                f"capture_id long, pair_id long, encryption_alg {attr}, integrity_alg {attr}")
    r = ike.overlay(sas, inf).first()
    assert r["encryption_alg"]["value"] == "aes-cbc" and r["integrity_alg"]["value"] == "none"


def test_quality_gate_refuses(spark):
    _, tagged = flows.pair_and_tag(table(spark, [packet(i, i) for i in range(5)]))
    q = quality.capture_quality(table(spark, [packet(i, i) for i in range(5)]))
    r = lattice.detect_suite(lattice.suite_survivors(lattice.length_histogram(tagged)), q).first()
    assert r["suite"]["note"] == lattice.TOO_UNIFORM
