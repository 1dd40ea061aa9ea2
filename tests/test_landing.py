"""Capture files, frame bytes, dissector JSON, sidecars and sinks."""

import hashlib
import json
import random
import struct

from pyspark.sql import functions as F

from wirelens import session
from wirelens.functions import scalars
from wirelens.operators import catalogue, dataset
from wirelens.sources import captures, decode, dissector, sidecars, sinks


def ip4(payload, proto, src="0a000001", dst="0a000002", frag=0):
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), 0, frag, 64, proto, 0)
    return head + bytes.fromhex(src) + bytes.fromhex(dst) + payload


def ip6(payload, nxt, src="fd00" + "0" * 24 + "0001", dst="fe80" + "0" * 16 + "00010000" + "0002"):
    return struct.pack(">IHBB", 0x60000000, len(payload), nxt, 64) + bytes.fromhex(src) + bytes.fromhex(dst) + payload


def udp(payload, port):
    return struct.pack(">HHHH", port, port, 8 + len(payload), 0) + payload


ESP = struct.pack(">II", 0xCAFE, 7) + b"\0" * 24
AH = struct.pack(">BBHII", 4, 4, 0, 0xBEEF, 9) + b"\0" * 12
IKE = b"\1" * 20 + struct.pack(">I", 5) + b"\0" * 4
ETH = b"\xff" * 12


def decoded(spark, frame, linktype=101):
    df = spark.createDataFrame([(0, 0, 0, linktype, len(frame), len(frame), bytearray(frame))],
                               "capture_id long, index long, ts_us long, linktype int, captured_len int, orig_len int, frame binary")
    return decode.decode_frames(df).first()


def test_frames(spark):
    r = decoded(spark, ip4(ESP, 50))
    assert (r["proto"], r["spi"], r["seq"], r["esp_payload_len"], r["ip_payload_len"], r["src"]) == ("esp", 0xCAFE, 7, 24, 32, "10.0.0.1")
    r = decoded(spark, ip4(AH, 51))
    assert (r["proto"], r["spi"], r["seq"], r["esp_payload_len"]) == ("ah", 0xBEEF, 9, None)
    r = decoded(spark, ip4(udp(IKE, 500), 17))
    assert (r["proto"], r["ike_message_id"]) == ("isakmp", 5)
    r = decoded(spark, ip4(udp(b"\0" * 4 + IKE, 4500), 17))
    assert (r["proto"], r["ike_message_id"], r["udp_encapsulated"]) == ("isakmp_natt", 5, True)
    r = decoded(spark, ip4(udp(ESP, 4500), 17))
    assert (r["proto"], r["spi"], r["esp_payload_len"], r["udp_encapsulated"]) == ("esp", 0xCAFE, 24, True)
    assert decoded(spark, ip4(udp(b"\1\2\3\4", 4500), 17))["proto"] == "other"
    assert decoded(spark, ip4(ESP, 50, frag=10))["proto"] == "other"
    assert decoded(spark, b"\x00\x01")["ip_version"] == 0
    assert decoded(spark, ETH + b"\x08\x06" + b"\0" * 28, 1)["ip_version"] == 0


def test_ipv6_extension_headers(spark):
    hop = bytes([50, 0]) + b"\0" * 6
    r = decoded(spark, ip6(hop + ESP, 0))
    assert (r["proto"], r["spi"], r["ip_version"], r["src"], r["dst"]) == ("esp", 0xCAFE, 6, "fd00::1", "fe80::1:0:2")
    r = decoded(spark, ip6(bytes([6]) + AH[1:], 51))
    assert (r["proto"], r["spi"]) == ("ah", 0xBEEF)
    r = decoded(spark, ip6(bytes([50]) + AH[1:] + ESP, 51))
    assert (r["proto"], r["esp_payload_len"]) == ("esp", 24)


def test_any_number_of_extension_headers(spark):
    for n in (5, 40):
        chain = b"".join(bytes([60 if k + 1 < n else 50, 0]) + b"\0" * 6 for k in range(n))
        r = decoded(spark, ip6(chain + ESP, 60))
        assert (r["proto"], r["spi"], r["esp_payload_len"]) == ("esp", 0xCAFE, 24)
    assert decoded(spark, ip6(bytes([60, 200]) + b"\0" * 6 + ESP, 0))["proto"] == "other"


def test_integers_of_any_width(spark):
    given = {"0x" + "f" * 16: 2**64 - 1, "ff:" * 15 + "ff": 16**32 - 1 if 16**32 < 10**38 else None, "0x1" + "0" * 25: 16**25, "12:34": 0x1234,
             "9" * 38: 10**38 - 1, "NAME (0x1ffffffffffffffff)": 0x1FFFFFFFFFFFFFFFF, "0" * 50 + "7": 7, "0x": None, "x": None, " 5 ": 5,
             "0x0" + "0" * 40 + "a": 10, "-3": -3, "": None}
    df = spark.createDataFrame([(t,) for t in given], "t string")
    got = {r["t"]: None if r["n"] is None else int(r["n"]) for r in df.select("t", scalars.tolerant_number(F.col("t")).alias("n")).collect()}
    assert got == given
    small = {r["t"]: r["n"] for r in df.select("t", scalars.tolerant_int(F.col("t")).alias("n")).collect()}
    assert small["12:34"] == 0x1234 and small["0x" + "f" * 16] is None and small[" 5 "] == 5


def test_link_types(spark):
    body = ip4(ESP, 50)
    for link, head in ((1, ETH + b"\x08\x00"), (1, ETH + b"\x81\x00\x00\x07\x08\x00"), (113, b"\0" * 14 + b"\x08\x00"), (276, b"\x08\x00" + b"\0" * 18)):
        assert decoded(spark, head + body, link)["spi"] == 0xCAFE


def capture_file(frames, order="<", nano=False, tail=b""):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 101)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 10 + i, 500_000 if not nano else 500_000_000, len(f), len(f) + 3) + f
    return out + tail


def test_capture_files(spark, tmp_path):
    frames = [ip4(ESP, 50), ip4(udp(IKE, 500), 17)] * 20
    (tmp_path / "one.pcap").write_bytes(capture_file(frames))
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "capture.pcap").write_bytes(capture_file(frames[:3], ">", True))
    (tmp_path / "bad.pcap").write_bytes(b"nonsense" * 10)
    (tmp_path / "cut.pcap").write_bytes(capture_file(frames[:1], tail=b"\0" * 5))
    (tmp_path / "short.pcap").write_bytes(b"\xd4\xc3")
    got, rejects = captures.read_frames(spark, str(tmp_path), chunk_bytes=300)
    rows = got.orderBy("capture_id", "index").collect()
    assert [r["index"] for r in rows if r["capture_id"] == "one"] == list(range(40))
    assert [(r["ts_us"], r["orig_len"] - r["captured_len"]) for r in rows if r["capture_id"] == "s1"] == [
        (10_500_000, 3), (11_500_000, 3), (12_500_000, 3)]
    assert bytes(rows[0]["frame"]) == frames[0]
    assert {r["path"].split("/")[-1]: r["reason"] for r in rejects.collect()} == {
        "bad.pcap": "not a classic capture file", "cut.pcap": "truncated record header", "short.pcap": "truncated file header"}
    assert decode.decode_frames(got).groupBy("proto").count().count() == 2


def test_splits_equal_the_walk(spark, tmp_path):
    """Payloads that imitate chains of headers mislead guesses, not the frames; any split size gives the same."""
    rng = random.Random(5)
    lure = b"".join(struct.pack("<IIII", 12 + i, 500_000, 4, 4) + b"abcd" for i in range(40))
    frames = [rng.choice([lure, lure[7:], rng.randbytes(rng.randrange(0, 90)), b"", ip4(ESP, 50)]) for _ in range(400)]
    frames[200] = rng.randbytes(5000)
    (tmp_path / "a.pcap").write_bytes(capture_file(frames))
    (tmp_path / "b.pcap").write_bytes(capture_file(frames[::-1], ">", True))
    (tmp_path / "c.pcap").write_bytes(capture_file(frames[:50])[:-1])
    (tmp_path / "d.pcap").write_bytes(capture_file([]))
    for size in (1500, 4000, 1 << 20):
        got, rejects = captures.read_frames(spark, str(tmp_path), chunk_bytes=size)
        rows = got.collect()
        for name, own in (("a", frames), ("b", frames[::-1])):
            assert [(r["index"], bytes(r["frame"])) for r in sorted((r for r in rows if r["capture_id"] == name), key=lambda r: r["index"])] == list(enumerate(own))
        assert len(rows) == 800 and [r["reason"] for r in rejects.collect()] == ["truncated record body"]


def test_few_rounds_and_many_tasks(spark, tmp_path):
    """Zeros mislead no guess, imitated headers few rounds, and the frames of a file come from many tasks."""
    lure = b"".join(struct.pack("<IIII", 12 + i, 500_000, 4, 4) + b"abcd" for i in range(40))
    for name, payload, rounds in (("zeros", b"\0" * 800, 1), ("lures", lure, 7)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.pcap").write_bytes(capture_file([payload] * 60))
        before = len(session._KEPT)
        got, rejects = captures.read_frames(spark, str(tmp_path / name), chunk_bytes=820)
        assert len(session._KEPT) - before <= 4 + 3 * rounds
        assert sorted((r["index"], bytes(r["frame"])) for r in got.collect()) == [(i, payload) for i in range(60)] and rejects.count() == 0
        assert got.rdd.getNumPartitions() >= 8


def test_files_over_two_gigabytes_are_registered(spark, tmp_path):
    with open(tmp_path / "large.pcap", "wb") as fh:
        fh.write(capture_file([]))
        fh.truncate((1 << 31) + 5)
    (tmp_path / "other.pcap").write_bytes(b"text, not a capture")
    want = hashlib.sha256()
    with open(tmp_path / "large.pcap", "rb") as fh:
        while data := fh.read(1 << 24):
            want.update(data)
    got = catalogue.register_captures(captures.scan_captures(spark, str(tmp_path))).collect()
    assert [(r["sha256"], r["size_bytes"], r["magic"]) for r in got] == [(want.hexdigest(), (1 << 31) + 5, "d4c3b2a1")]


def packet(isakmp, frame="7"):
    return {"_source": {"layers": {"frame": {"frame.number": frame, "frame.time_epoch": "1.500000000"},
                                   "ip": {"ip.src": "10.0.0.1", "ip.dst": "10.0.0.2"}, "isakmp": isakmp}}}


def attr(container, kind, value):
    return {f"{container}.format": "1", f"{container}.type": str(kind), f"{container}.value": value, f"{container}.life_type": "9"}


def test_dissector_json(spark, tmp_path):
    v1 = packet({
        "isakmp.ispi": "AA:bb", "isakmp.version": "0x10", "isakmp.exchangetype": "4", "isakmp.messageid": "0x00000000",
        "isakmp.typepayload": ["1", "20"], "isakmp.typepayload_tree": [{
            "isakmp.typepayload": "2", "isakmp.typepayload_tree": {
                "isakmp.prop.number": "1", "isakmp.prop.protoid": "1", "isakmp.typepayload": "3", "isakmp.typepayload_tree": {
                    "isakmp.trans.id": "1", "isakmp.ike.attr": [attr("isakmp.ike.attr", 1, "00:05"), attr("isakmp.ike.attr", 12, "00:01:51:80")]}}}, {}]})
    v2 = packet({
        "isakmp.ispi": "01:02", "isakmp.version_tree": {"isakmp.mjver": "0x02"}, "isakmp.exchangetype": "34", "isakmp.length": "300",
        "isakmp.typepayload": ["33", "41"], "isakmp.typepayload_tree": [{
            "isakmp.typepayload": "2", "isakmp.typepayload_tree": {"isakmp.prop.number": "1", "isakmp.typepayload": ["3", "3", "3"], "isakmp.typepayload_tree": [
                {"isakmp.tf.type": "1", "isakmp.tf.id.encr": "AES-CBC (12)", "isakmp.ike2.attr": attr("isakmp.ike2.attr", 14, "01:00")},
                {"isakmp.tf.type": "4", "isakmp.tf.id.dh": "19"}]}}, {"isakmp.notify.msgtype": "16388"}]})
    plain = packet({"isakmp.ispi": "03", "isakmp.version": "2.0", "isakmp.exchangetype": "36"}, "9")
    other = {"_source": {"layers": {"frame": {"frame.number": "1"}}}}
    deep = {"isakmp.typepayload": "20", "isakmp.typepayload_tree": {}}
    for _ in range(9):
        deep = {"isakmp.typepayload": ["9", "2"], "isakmp.typepayload_tree": [{}, deep]}
    (tmp_path / "c2.json").write_text(json.dumps([packet({"isakmp.ispi": "04", "isakmp.version": "0x20", **deep})]))
    assert [r["nat_detected"] for r in dissector.parse_messages(dissector.read_ike_json(spark, str(tmp_path / "c2.json"))).collect()] == [True]
    (tmp_path / "c2.json").unlink()
    (tmp_path / "c1.json").write_text(json.dumps([v1, v2, plain, other]))
    rows = {r["init_spi"]: r for r in dissector.parse_messages(dissector.read_ike_json(spark, str(tmp_path))).collect()}
    assert set(rows) == {"aabb", "0102", "03"}
    a, b, c = rows["aabb"], rows["0102"], rows["03"]
    assert (a["capture_id"], a["ike_version"], a["exchange_type"], a["frame_index"], a["ts_us"], a["nat_detected"]) == (
        "c1", "ikev1", 4, 7, 1_500_000, True)
    assert [(x["attr_type"], x["value"]) for x in a["sa_payload"][0]["transforms"][0]["attrs"]] == [(1, 5), (12, 86400)]
    assert b["ike_version"] == "ikev2" and b["nat_detected"] and b["length"] == 300
    assert [(t["transform_type"], t["transform_id"]) for t in b["sa_payload"][0]["transforms"]] == [(1, 12), (4, 19)]
    assert b["sa_payload"][0]["transforms"][0]["attrs"][0]["value"] == 256
    assert c["ike_version"] == "ikev2" and c["sa_payload"] is None and not c["nat_detected"]


def test_labels_and_knots(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "labels.json").write_text(json.dumps({
        "name": "s1", "expected": {"ike_version": "ikev2", "dh_group": 19}, "not_observable_from_ike": {"auth_method": "encrypted"}}, indent=1))
    r = sidecars.read_labels(spark, str(tmp_path)).first()
    assert (r["session_name"], r["expected"]["dh_group"], r["not_observable_from_ike"]) == ("s1", 19, {"auth_method": "encrypted"})
    knots = [{"x": [0.0, 1.0], "y": [0.1, 0.9]}, {"x": [0.5], "y": [0.5]}]
    sidecars.write_knots(spark, knots, str(tmp_path / "knots"))
    assert sidecars.read_knots(spark, str(tmp_path / "knots")) == knots


def test_assessment_tables_replace_only_their_captures(spark, tmp_path):
    def tables(ids, score):
        base = spark.createDataFrame([(i,) for i in ids], "capture_id long")
        return (base.withColumn("assessment_id", F.lit("a")).withColumn("score", F.lit(score)),
                base.withColumn("severity", F.lit("high")), base.withColumn("pair_id", F.lit(1)))

    sinks.write_assessments(*tables([1, 2], 10), str(tmp_path))
    sinks.write_assessments(*tables([2], 20), str(tmp_path))
    rows = {r["capture_id"]: r["score"] for r in spark.read.parquet(f"{tmp_path}/assessments").collect()}
    assert rows == {1: 10, 2: 20}


def test_matrix_metrics_and_documents_come_back(spark, tmp_path):
    m = spark.createDataFrame([("a", "train", 1.0, [0.5]), ("b", "test", 2.0, [1.5])], "config_name string, fold string, iat_mean double, seq array<double>")
    assert dataset.feature_columns(m) == ["iat_mean"] and dataset.sequence_columns(m) == ["seq"]
    sinks.write_matrix(m, str(tmp_path / "matrix"))
    sinks.write_matrix(m.filter("fold = 'test'").withColumn("iat_mean", F.lit(3.0)), str(tmp_path / "matrix"))  # replaces its fold only
    back = {r["fold"]: (r["config_name"], r["iat_mean"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "matrix")).collect()}
    assert back == {"train": ("a", 1.0, [0.5]), "test": ("b", 3.0, [1.5])}
    sinks.write_metrics(spark.createDataFrame([("ece", 0.1)], "metric string, value double"), str(tmp_path / "metrics"), "calibration")
    assert [r.asDict() for r in spark.read.json(str(tmp_path / "metrics")).collect()] == [{"metric": "ece", "value": 0.1, "title": "calibration"}]
    sinks.write_documents(spark.createDataFrame([("c", '{"x": 1}')], "capture_id string, document string"), str(tmp_path / "docs"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "docs")).collect()] == [{"x": 1}]
