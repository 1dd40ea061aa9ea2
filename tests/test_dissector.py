"""Dissector packets read many at a time, against a plain walk of each, and the dumps made of messages."""

import glob
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wirelens import session
from wirelens.functions import scalars
from wirelens.operators.ike import PROPOSALS_TYPE
from wirelens.plans import dumps
from wirelens.sources import dissector

TEXTS = ["5", " 7 ", "-3", "+4", "0x2f", "0X2F", "00:05", "00:01:51:80", "00:0g", "AES (12)", "X (0x0c)", "X ( 9 )", "X ()", "()", ")", ":", "", " ", "x",
         "0x", "1.5", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "0x7fffffffffffffff", "0xffffffffffffffff",
         "0" * 50 + "7", "0x0" + "0" * 40 + "a", "9" * 40, "ff:" * 7 + "ff", "00:" * 20 + "01", "12:34\t", "(5) x", "a(1)(2)", "5)"]


def test_whole_numbers_are_those_of_the_column(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", scalars.tolerant_int(F.col("t")).alias("n"))
    assert {r["t"]: scalars.whole_number(r["t"]) for r in df.collect()} == {r["t"]: r["n"] for r in df.collect()}


def number(v):
    if isinstance(v, str):
        return scalars.whole_number(v)
    if isinstance(v, float) and v.is_integer():
        return int(v)  # kept as a decimal, whose text has no point then
    return v if isinstance(v, int) and not isinstance(v, bool) and -2**63 <= v < 2**63 else None


def below(node):
    def many(v):
        return v if isinstance(v, list) else [v]

    if "isakmp.typepayload" not in node or "isakmp.typepayload_tree" not in node:
        return []
    pairs = zip(many(node["isakmp.typepayload"]), many(node["isakmp.typepayload_tree"]), strict=False)
    return [(number(k), t) for k, t in pairs if number(k) is not None and isinstance(t, dict)]


def first(node, test):
    return number(next((node[k] for k in sorted(node) if test(k)), None))


def walked(isakmp, two):
    """Proposals and NAT discovery of one message."""
    def transform(t):
        kind, code = (number(t.get("isakmp.tf.type")), first(t, lambda k: k.startswith("isakmp.tf.id"))) if two else (-1, number(t.get("isakmp.trans.id")))
        name = "isakmp.ike2.attr" if two else "isakmp.ike.attr"
        some = t.get(name, [])
        attrs = [(first(a, lambda k: k.endswith(".attr.type")), first(a, lambda k: k.endswith(".attr.value")))
                 for a in (some if isinstance(some, list) else [some]) if isinstance(a, dict)]
        return kind, code, [a for a in attrs if None not in a]

    proposals = [(number(p.get("isakmp.prop.number")) or 0, number(p.get("isakmp.prop.protoid")) or 0,
                  [t for t in (transform(t) for k, t in below(p) if k == 3) if None not in t[:2]])
                 for kind, sa in below(isakmp) if kind in (1, 33) for k, p in below(sa) if k == 2]
    queue, nat = [isakmp], False
    for node in queue:
        for kind, tree in below(node):
            nat |= kind == 20 or kind in (11, 41) and number(tree.get("isakmp.notify.msgtype")) in (16388, 16389)
            queue.append(tree)
    return proposals or None, nat


def grown(rng, depth, level=0):
    """A payload's contents: lists and bare values, texts and numbers, things missing and things in the way."""
    def value():
        return str(rng.choice([1, 12, 16388])) if rng.random() < 0.6 else rng.choice([str(rng.randrange(60)), f"NAME ({rng.randrange(40)})", "00:0c", "0x10", rng.randrange(70000), -4, 2.5, 7.0, None, True, "x", ["3"], {"a": 1},
                           "long " * 30 + "(8)", 12345678901234567890, "16388", 16389])

    def some(make):
        n = rng.choice([0, 1, 2, 3, 3, 5])
        return make() if rng.random() < 0.3 else [make() for _ in range(n)]

    node = {f"isakmp.{n}": value() for n in ("prop.number", "prop.protoid", "notify.msgtype", "tf.type", "tf.id.encr", "tf.id", "trans.id", "extra") if rng.random() < 0.85}
    for name in ("isakmp.ike.attr", "isakmp.ike2.attr"):
        if rng.random() < 0.85:
            node[name] = some(lambda: rng.choice([value(), *[{f"{name}.{k}": value() for k in rng.sample(["type", "value", "format", "b.attr.type", "life_type"], 4)}] * 5]))
    if depth and rng.random() < 0.9:
        usual = (["33", "1", 33, "SA (0x21)"], ["2"], ["3"])[min(level, 2)]
        odd = ["9", "41", "3", 2, 11, "0x01", None, "x", []] + ["20"] * (rng.random() < 0.3)
        node["isakmp.typepayload"] = some(lambda: rng.choice(usual if rng.random() < 0.7 else odd))
        node["isakmp.typepayload_tree"] = some(lambda: grown(rng, depth - 1, level + 1) if rng.random() < 0.9 else rng.choice([None, "x", [], 5]))
    return node


def shaped(proposals):
    return None if proposals is None else [
        (p["number"], p["protocol_id"], [(t["transform_type"], t["transform_id"], [(a["attr_type"], a["value"]) for a in t["attrs"]]) for t in p["transforms"]])
        for p in proposals]


def test_batches_equal_the_walk(spark, monkeypatch):
    """Odd shapes, names by the hundred, big objects and lists; small reads cut between any two messages."""
    rng = random.Random(7)
    packets = [{"isakmp": grown(rng, rng.randrange(2, 6)) | {"isakmp.version": rng.choice(["0x20", "0x10"])}} for _ in range(400)]
    for n in (300, 70_000):
        many = {f"vendor.{k}": str(k) for k in range(n)}
        tree = {"isakmp.typepayload": ["2"], "isakmp.typepayload_tree": [many | {"isakmp.typepayload": ["3"] * 400, "isakmp.typepayload_tree": [{"isakmp.trans.id": "1"}] * 400}]}
        packets.append({"isakmp": {"isakmp.version": "0x10", "isakmp.typepayload": "1", "isakmp.typepayload_tree": tree}})
    packets += [{"isakmp": 5}, {"ip": {}}, {"isakmp": []}, {"isakmp": {}}, {"isakmp": None}]
    text = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(packets)], "capture_id int, j string").repartition(3)
    layers = text.select("capture_id", F.parse_json("j").alias("layers")).union(spark.sql("SELECT -1, cast(null as variant)"))
    want = {i: walked(p["isakmp"], p["isakmp"].get("isakmp.version") == "0x20") for i, p in enumerate(packets) if isinstance(p.get("isakmp"), dict)}
    assert sum(p is not None for p, _ in want.values()) > 100 and 10 < sum(nat for _, nat in want.values()) < 350
    for size in (dissector.AT_ONCE, 3000):
        monkeypatch.setattr(dissector, "AT_ONCE", size)
        rows = dissector.parse_messages(layers).collect()
        assert {r["capture_id"]: (shaped(r["sa_payload"]), r["nat_detected"]) for r in rows} == want and len(rows) == len(want)


def test_no_part_of_a_message_is_interpreted_or_built_anew(spark):
    """Before, every payload was taken out of its VARIANT by functions over arrays, and VARIANTs were shredded when kept."""
    layers = spark.range(20).select(F.col("id").alias("capture_id"), F.parse_json(F.lit('{"isakmp": {"isakmp.length": "7"}}')).alias("layers"))
    plan = dissector.parse_messages(layers)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" in plan
    kept = session.materialise(layers)
    file = glob.glob(f"{kept.inputFiles()[0].removeprefix('file:').rpartition('/')[0]}/*.parquet")[0]
    assert "typed_value" not in str(pq.ParquetFile(file).schema)
    assert [r["length"] for r in dissector.parse_messages(kept).collect()] == [7] * 20


def test_dumps_leave_nulls_out(spark):
    sa = pa.array([[{"number": 1, "protocol_id": 1, "transforms": [
        {"transform_type": 1, "transform_id": 12, "attrs": [{"attr_type": 14, "value": 256}]}, {"transform_type": 4, "transform_id": 19, "attrs": []}]}], None, [None],
        [{"number": 2, "protocol_id": None, "transforms": [{"transform_type": -1, "transform_id": 1, "attrs": [{"attr_type": 1, "value": None}, {"attr_type": 12, "value": 86400}]}]}]],
        spark.createDataFrame([], f"p {PROPOSALS_TYPE}").toArrow().schema.field("p").type)
    batch = pa.RecordBatch.from_pydict({
        "capture_id": [1, 2, 3, 4], "ike_version": ["ikev2", "ikev2", "ikev2", "ikev1"], "exchange_type": [34, 34, None, 2], "init_spi": ["ab", None, "cd", "ef"],
        "resp_spi": [None, None, "01", "02"], "frame_index": [1, 2, 3, None], "seconds": [1, None, 3, 4], "src": ["a", "b", "c", None], "dst": ["z", "b", "c", None],
        "sa_payload": sa, "nat_detected": [True, False, None, True]})
    got = [json.loads(t) for t in dumps.layers(batch).to_pylist()]
    assert got[1] == {"frame": {"frame.number": "2"}, "ip": {"ip.src": "b", "ip.dst": "b"}, "isakmp": {
        "isakmp.version": "0x20", "isakmp.exchangetype": "34", "isakmp.messageid": "0x00000000", "isakmp.length": "300",
        "isakmp.typepayload": ["33"], "isakmp.typepayload_tree": [{}]}}
    assert got[2]["isakmp"]["isakmp.typepayload_tree"] == [{"isakmp.typepayload": ["2"], "isakmp.typepayload_tree": [{}]}]
    assert got[3]["ip"] == {} and got[3]["isakmp"]["isakmp.typepayload_tree"][1] == {}
    assert [walked(g["isakmp"], i < 3) for i, g in enumerate(got)] == [
        ([(1, 1, [(1, 12, [(14, 256)]), (4, 19, [])])], True), (None, False), ([(0, 0, [])], False), ([(2, 0, [(-1, 1, [(12, 86400)])])], True)]
    assert [json.loads(t) for t in dumps.layers(batch.slice(2, 2)).to_pylist()] == got[2:]
