"""Packet, message and session views derived from the star-schema tables.

They let every operator run over whole given tables with a SQL twin. Integer
arithmetic only, and independent of the session time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.operators import ordered
from wirelens.plans import dumps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of a megabyte of these tables become up to a gigabyte in the widest views.
PART_BYTES = 1 << 20


def spread_table(spark: SparkSession, sf_dir: str, name: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """``table`` for views that cost far more than their input: dealt out to all cores,
    ``part_bytes`` of the file or less to a task, so that a task's rows do not grow with the table.
    """
    df = table(spark, sf_dir, name)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-size // part_bytes)))


def packets(spark: SparkSession, sf_dir: str, sequenced: bool = False) -> DataFrame:
    """Events as packets: five captures, three SPI generations, two directions.

    Sequence numbers cost a ranking of every flow, so they are made on request.
    """
    return packets_of(spread_table(spark, sf_dir, "events"), sequenced)


def packets_of(e: DataFrame, sequenced: bool = False) -> DataFrame:
    """``packets`` of any batch or stream of events."""
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))"
    p = e.select(
        F.expr("user_id % 5").alias("capture_id"),
        F.col("event_id").alias("index"),
        F.expr(f"({micros}) div 10000").alias("ts_us"),
        F.expr("event_id % 2").alias("dir"),
        F.expr(
            "CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'other' "
            "WHEN event_type = 'signup' AND event_id % 20 = 3 THEN 'isakmp' ELSE 'esp' END"
        ).alias("proto"),
        F.expr("cast(floor(value) as bigint)").alias("v"),
    )
    esp = "proto = 'esp'"
    p = p.selectExpr(
        "capture_id", "index", "ts_us", "proto",
        "concat('10.0.', capture_id, '.', dir + 1) AS src",
        "concat('10.0.', capture_id, '.', 2 - dir) AS dst",
        f"CASE WHEN {esp} THEN 4096 + capture_id * 64 + (ts_us div 90000000) * 2 + dir END AS spi",
        f"CASE WHEN NOT ({esp}) THEN NULL "
        "WHEN capture_id = 0 THEN 28 + 16 * (1 + v % 60) WHEN capture_id = 1 THEN 24 + 4 * (1 + v % 200) "
        "WHEN capture_id = 2 THEN 120 + 16 * (v % 2) WHEN capture_id = 3 THEN 20 + 8 * (1 + v % 100) "
        "ELSE 32 + 16 * (1 + v % 60) END AS esp_payload_len",
        "CASE WHEN proto = 'isakmp' THEN index % 3 END AS ike_message_id",
    )
    if not sequenced:
        p = p.withColumn("rn", F.lit(None).cast("bigint"))
    else:
        p = ordered.numbered(p, ["capture_id", "spi"], ["ts_us", "index"],
                             F.expr("ts_us div 10000000"), "rn")
    return p.selectExpr(
        "capture_id", "index", "ts_us", "4 AS ip_version", "src", "dst", "proto", "spi",
        f"CASE WHEN {esp} THEN rn - CASE WHEN index % 97 = 0 THEN 1 ELSE 0 END END AS seq",
        "coalesce(esp_payload_len + 8, 100) AS ip_payload_len",
        "esp_payload_len",
        "CASE WHEN capture_id = 4 THEN least(96, coalesce(esp_payload_len + 42, 134)) "
        "ELSE coalesce(esp_payload_len + 42, 134) END AS captured_len",
        "coalesce(esp_payload_len + 42, 134) AS orig_len",
        "proto = 'esp' AND capture_id = 1 AS udp_encapsulated",
        "ike_message_id",
    )


def crossing_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets of many associations at a time: each user is a direction that rekeys every 20 s, at its own phase."""
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))"
    p = spread_table(spark, sf_dir, "events").selectExpr("event_id AS index", "user_id", f"({micros}) div 10000 AS ts_us", "value")
    way = "user_id div 5 % 2"
    return p.selectExpr(
        "user_id % 5 AS capture_id", "index", "ts_us", "4 AS ip_version",
        f"concat('10.0.', user_id % 5, '.', 1 + {way}) AS src", f"concat('10.0.', user_id % 5, '.', 2 - {way}) AS dst", "'esp' AS proto",
        "user_id * 1000 + (ts_us + user_id * 700000) div 20000000 AS spi", "cast(floor(value) as int) AS ip_payload_len", "false AS udp_encapsulated")


def cycle(index: str, values: list) -> str:
    """SQL choosing ``values[index % n]``; the same text serves both engines."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {arms} END"


def portable(sql: str) -> str:
    """Integer division as Spark spells it."""
    return sql.replace("//", "div")


# Key-exchange messages from orders: one negotiation per order, request and
# (unless the status is F) response; proposal j of k, j from 1.
IKE = {
    "capture_id": "o_custkey % 5",
    "version": "CASE WHEN o_orderkey % 3 = 0 THEN 'ikev1' ELSE 'ikev2' END",
    "offers": "1 + o_custkey % 4",
    "chosen": "1 + o_orderkey % (1 + o_custkey % 4)",
    "ts_us": "(o_orderkey % 260) * 1000000",
    "v1_exchange": cycle("o_custkey", [2, 4, 5]),
}
OFFER = {
    "encr": "CASE WHEN o_orderkey % 3 = 0 THEN " + cycle("o_orderkey // 7 + j", [1, 5, 7])
            + " ELSE " + cycle("o_orderkey // 7 + j", [12, 20, 3, 12, 18, 1]) + " END",
    "bits": "128 + 128 * ((o_custkey + j) % 2)",
    "prf": cycle("o_orderkey // 3 + j", [2, 5, 6, 99]),
    "integ": "CASE WHEN o_orderkey % 3 = 0 THEN " + cycle("o_custkey // 5 + j", [1, 2, 4])
             + " ELSE " + cycle("o_custkey // 5 + j", [2, 12, 13, 14, 0]) + " END",
    "dh": "CASE WHEN o_orderkey % 3 = 0 THEN " + cycle("o_orderkey // 13 + j", [2, 5, 14])
          + " ELSE " + cycle("o_orderkey // 11 + j", [2, 14, 19, 20]) + " END",
    "esn": "CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey // 13 + j) % 2 END",
    "auth": cycle("o_orderkey // 11 + j", [1, 3, 9, 7]),
    "life_type": "1 + (o_orderkey // 17 + j) % 2",
    "life": "3600 * (1 + (o_custkey + j) % 12)",
}


def ike_messages(spark: SparkSession, sf_dir: str, spis: DataFrame | None = None) -> DataFrame:
    """Orders as key-exchange messages with nested proposals.

    With ``spis`` (capture_id, init_spi) only theirs, and no other proposals are made: the
    planner would leave a join with the messages above the proposals.
    """
    from wirelens.operators import ike
    from wirelens.operators.ike import PROPOSALS_TYPE

    def x(sql: str) -> str:
        return f"cast({portable(sql)} as int)"

    def tf(kind: int, code: str, attrs: str = "array()") -> str:
        return f"struct({kind} AS transform_type, {code} AS transform_id, {attrs} AS attrs)"

    def at(kind: int, value: str) -> str:
        return f"struct({kind} AS attr_type, cast({value} as bigint) AS value)"

    offer = {k: x(v) for k, v in OFFER.items()}
    keyed = f"CASE WHEN {offer['encr']} IN (12, 20, 18, 7) AND NOT (version = 'ikev2' AND {offer['encr']} = 7) THEN array({at(14, offer['bits'])}) ELSE array() END"
    v2 = (
        f"filter(array({tf(1, offer['encr'], keyed)}, {tf(2, offer['prf'])}, {tf(3, offer['integ'])}, "
        f"{tf(4, offer['dh'])}, {tf(5, offer['esn'])}), t -> t.transform_id IS NOT NULL)"
    )
    v1_attrs = (
        f"concat(array({at(1, offer['encr'])}, {at(2, offer['integ'])}, {at(3, offer['auth'])}, "
        f"{at(4, offer['dh'])}, {at(11, offer['life_type'])}, {at(12, offer['life'])}), "
        f"CASE WHEN {offer['encr']} = 7 THEN array({at(14, offer['bits'])}) ELSE array() END)"
    )
    v1 = f"array({tf(-1, '1', v1_attrs)})"
    offers = (
        f"cast(transform(sequence(1, cast({IKE['offers']} as int)), j -> struct(j AS number, 1 AS protocol_id, "
        f"CASE WHEN version = 'ikev1' THEN cast({v1} as array<struct<transform_type:int,transform_id:int,attrs:array<struct<attr_type:int,value:bigint>>>>) "
        f"ELSE cast({v2} as array<struct<transform_type:int,transform_id:int,attrs:array<struct<attr_type:int,value:bigint>>>>) END AS transforms)) as {PROPOSALS_TYPE})"
    )
    o = spread_table(spark, sf_dir, "orders").selectExpr(
        "*", f"{IKE['version']} AS version", f"{IKE['capture_id']} AS capture_id",
        "lpad(lower(hex(o_orderkey)), 16, '0') AS init_spi")
    if spis is not None:
        o = o.join(ike.spi_keys(spis), ike.same_spi(), "left_semi")
    o = o.withColumn("offers", F.expr(offers))
    common = [
        "capture_id", "init_spi", "version AS ike_version",
        f"CASE WHEN version = 'ikev1' THEN {IKE['v1_exchange']} ELSE 34 END AS exchange_type",
    ]
    left, right = "concat('10.0.', capture_id, '.1')", "concat('10.0.', capture_id, '.2')"
    turned = "o_orderkey % 2 = 1"
    a = f"CASE WHEN {turned} THEN {right} ELSE {left} END"
    b = f"CASE WHEN {turned} THEN {left} ELSE {right} END"
    def request(rows: DataFrame, payload: str) -> DataFrame:
        return rows.selectExpr(
            *common, "2 * o_orderkey + 1 AS frame_index", f"{IKE['ts_us']} AS ts_us", f"{a} AS src", f"{b} AS dst",
            "cast(null as string) AS resp_spi", f"{payload} AS sa_payload", "o_orderkey % 4 = 0 AS nat_detected")

    # Offers are missing without a customer only; apart, the planner knows that the others have some and need not build them to see it.
    asked = request(o.filter("o_custkey IS NOT NULL"), f"coalesce(offers, cast(array() as {PROPOSALS_TYPE}))")
    bare = request(o.filter("o_custkey IS NULL"), f"cast(null as {PROPOSALS_TYPE})")
    response = o.filter("o_orderstatus <> 'F'").selectExpr(
        *common, "2 * o_orderkey + 2 AS frame_index", f"{IKE['ts_us']} + 1000000 AS ts_us", f"{b} AS src",
        f"{a} AS dst", "lpad(lower(hex(o_orderkey + 1)), 16, '0') AS resp_spi",
        f"array(offers[cast({portable(IKE['chosen'])} as int) - 1]) AS sa_payload", "o_orderkey % 8 = 1 AS nat_detected")
    return asked.unionByName(bare).unionByName(response)


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as encrypted exchanges: type, size, and a size known to hold no key exchange."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey % 50 AS capture_id",
        "concat('10.1.', l_partkey % 4, '.', 1 + l_orderkey % 2) AS src",
        "concat('10.1.', l_partkey % 4, '.', 2 - l_orderkey % 2) AS dst",
        "CASE WHEN l_suppkey % 7 = 0 THEN 'ikev1' ELSE 'ikev2' END AS ike_version",
        "CASE WHEN l_linenumber % 3 = 2 THEN 35 ELSE 36 + l_linenumber % 2 END AS exchange_type",
        "CASE WHEN l_partkey % 40 = 0 THEN 0 ELSE 200 + l_partkey % 300 END AS length",
        "100 + l_partkey * 3 % 200 AS plain")


def groups_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-exchange group per endpoint pair of ``exchanges``, some unknown or missing."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey % 50 AS capture_id", "cast(s_suppkey div 50 % 5 as int) AS pair_no", "s_suppkey",
    ).selectExpr(
        "capture_id", "concat('10.1.', pair_no, '.1') AS lo", "concat('10.1.', pair_no, '.2') AS hi",
        f"cast({cycle('s_suppkey', [14, 19, 2, 99, 'NULL'])} as int) AS dh_group")


# Declared associations from orders: one per order, each parameter with a value
# and a provenance that cycle with the keys.
DECLARED = {
    "ike_version": cycle("o_orderkey", ["'ikev1'", "'ikev2'"]),
    "ike_exchange_mode": cycle("o_orderkey // 2", ["'main'", "'aggressive'"]),
    "encryption_alg": cycle("o_orderkey // 3", ["'aes-cbc'", "'3des-cbc'", "'des-cbc'", "'null'", "'aes-gcm-16'", "'unknown'"]),
    "encryption_keylen": "128 * (1 + o_custkey % 2)",
    "integrity_alg": cycle("o_custkey", ["'none'", "'hmac-md5-96'", "'hmac-sha1-96'", "'hmac-sha256-128'"]),
    "prf_alg": cycle("o_custkey // 2", ["'hmac-sha1'", "'hmac-sha256'"]),
    "dh_group": cycle("o_orderkey // 5", [1, 2, 5, 14, 19, 20]),
    "operating_mode": cycle("o_orderkey // 4", ["'tunnel'", "'transport'"]),
    "pfs_enabled": "o_custkey % 2 = 0",
    "auth_method": cycle("o_custkey // 3", ["'psk'", "'rsa_sig'"]),
    "negotiated_lifetime_s": "CAST(floor(o_totalprice) AS BIGINT) % 60000",
    "observed_rekey_s": "o_custkey % 4000",
    "esn_negotiated": "o_orderkey % 7 = 0",
    "replay_sane": "o_custkey % 3 = 0",
    "nat_traversal": "o_custkey % 5 = 0",
    "downgrade_available": "o_orderkey % 4 = 1",
}


def declared_provenance(position: int) -> str:
    return cycle(f"o_orderkey // {position + 2} + {position}", ["'observed'", "'inferred'", "'unavailable'"])


DECLARED_CONFIDENCE = "(o_custkey % 100) / 100.0"
PREDICTIONS = "o_orderkey % 4"
PREDICTED_PROBABILITY = "((o_orderkey * 7 + i * 13) % 100) / 100.0"


def declared_sas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as associations with all sixteen parameters and some predictions."""
    from wirelens import dims
    from wirelens.functions import attrs

    o = spread_table(spark, sf_dir, "orders")
    cols = [
        F.expr("o_custkey % 50").alias("capture_id"), F.col("o_orderkey").alias("pair_id"),
        F.lpad(F.lower(F.hex("o_orderkey")), 8, "0").alias("spi_initiator"),
        F.when(F.expr("o_orderkey % 2 = 0"), F.lpad(F.lower(F.hex(F.expr("o_orderkey + 1"))), 8, "0")).alias("spi_responder"),
        F.lit("10.0.0.1").alias("src"), F.lit("10.0.0.2").alias("dst"), F.lit(4).alias("ip_version"),
        F.lit("esp").alias("protocol"), F.lit(0).cast("bigint").alias("first_us"),
        F.expr("(o_orderkey % 20000) * 1000000").alias("last_us"),
        F.expr("o_orderkey % 300").alias("packet_count"), F.expr("o_orderkey % 300 * 100").alias("byte_count"),
    ]
    for i, (name, _, typ) in enumerate(dims.PARAMETERS):
        value = F.expr(portable(DECLARED[name]))
        prov = F.expr(portable(declared_provenance(i)))
        level = F.expr(DECLARED_CONFIDENCE).cast("double")
        cols.append(
            F.when(prov == "observed", attrs.observed(value, typ))
            .when(prov == "inferred", attrs.inferred(value, typ, level))
            .otherwise(attrs.unavailable("not in this view", typ)).alias(name))
    label = cycle("o_orderkey + i", [f"'{c}'" for c in dims.TRAFFIC_CLASSES])
    cols.append(F.expr(portable(
        f"transform(filter(sequence(0, 3), i -> i < {PREDICTIONS}), i -> struct({label} AS label, "
        f"cast({PREDICTED_PROBABILITY} as double) AS probability, cast(i * 5000000 as bigint) AS start_us, "
        "cast(i * 5000000 + 10000000 as bigint) AS end_us))")).alias("inner_traffic"))
    return o.select(*cols)


def predictions(sas: DataFrame) -> DataFrame:
    """The predictions held inside associations, one per row."""
    return sas.select("capture_id", "pair_id", F.explode("inner_traffic").alias("p")).select(
        "capture_id", "pair_id", "p.*")


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as comparisons of two captures each."""
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS cmp_id", "cast(n_nationkey as bigint) AS a", "cast(49 - n_nationkey as bigint) AS b")


SESSION = {
    "config_name": "'cfg' || (doc_id // 4)",
    "session_name": "'cfg' || (doc_id // 4) || CASE WHEN doc_id % 4 > 0 THEN '-r' || (doc_id % 4) ELSE '' END",
    "traffic_class": cycle("doc_id // 4", ["'email'", "'file_transfer'", "'icmp'", "'messaging'", "'video'", "'voip'", "'web'"]),
}


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sessions: up to four repeats of a configuration, one class each."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", *[f"{portable(v)} AS {k}" for k, v in SESSION.items()], "n_chars AS start_us")


NEXT_TYPE = ("CASE event_type WHEN 'click' THEN 'error' WHEN 'error' THEN 'purchase' WHEN 'purchase' THEN 'signup' "
             "WHEN 'signup' THEN 'view' ELSE 'click' END")
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def event_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as classified windows: every seventh is wrong."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type AS truth",
        f"CASE WHEN event_id % 7 = 0 THEN {NEXT_TYPE} ELSE event_type END AS predicted",
        "0.5D + (event_id % 50) / 100D AS confidence")


FILE_STEMS = ["vpn_youtube", "email1a", "skype_file1", "voipbuzz2", "torTwitter", "facebook_chat", "VPN-icq_chat",
              "ftps_up", "browsing", "hangouts_audio", "p2p_multi", "netflix3", "ping6"]


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as capture files whose names carry a label, flows and readability."""
    stem = cycle("doc_id", [f"'{s}'" for s in FILE_STEMS])
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"concat('/data/', source, '/', {stem}, doc_id, '.pcap') AS name",
        "n_chars % 5 AS flows", "n_chars % 11 = 0 AS unreadable")


MAGIC_CYCLE = ["a1b2c3d4", "4d3cb2a1", "0a0d0d0a", "00000000", "d4c3b2a1"]


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as capture bytes: a magic number, then the text."""
    magic = cycle("length(text)", [f"'{m}'" for m in MAGIC_CYCLE])
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('f', lpad(cast(doc_id as string), 12, '0')) AS path",
        f"concat(unhex({magic}), encode(text, 'utf-8')) AS content")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets as raw frames: four link types, IPv4 and IPv6, UDP-wrapped ESP, a VLAN tag."""
    def hx(value: str, digits: int) -> str:
        return f"lpad(lower(hex({value})), {digits}, '0')"

    p = packets(spark, sf_dir).selectExpr(
        "*", "cast(substring_index(src, '.', -1) as bigint) AS a", "cast(substring_index(dst, '.', -1) as bigint) AS b")
    esp = f"concat({hx('spi', 8)}, {hx('index', 8)}, repeat('00', cast(esp_payload_len as int)))"
    ike = f"concat('01f401f4', '0024', '0000', repeat('ab', 16), '21202208', {hx('ike_message_id', 8)}, '0000001c')"
    p = p.withColumn("upper", F.expr(
        f"CASE WHEN proto = 'esp' AND capture_id = 1 THEN concat('11941194', {hx('esp_payload_len + 16', 4)}, '0000', {esp}) "
        f"WHEN proto = 'esp' THEN {esp} WHEN proto = 'isakmp' THEN {ike} ELSE repeat('00', 20) END"))
    p = p.withColumn("number", F.expr(
        "CASE WHEN proto = 'isakmp' OR (proto = 'esp' AND capture_id = 1) THEN '11' WHEN proto = 'esp' THEN '32' ELSE '06' END"))
    four = (f"concat('4500', {hx('20 + length(upper) div 2', 4)}, '00000000', '40', number, '0000', "
            f"'0a00', {hx('capture_id', 2)}, {hx('a', 2)}, '0a00', {hx('capture_id', 2)}, {hx('b', 2)})")
    six = (f"concat('60000000', {hx('length(upper) div 2', 4)}, number, '40', "
           f"'fd00', repeat('0000', 5), {hx('capture_id', 4)}, {hx('a', 4)}, 'fd00', repeat('0000', 5), {hx('capture_id', 4)}, {hx('b', 4)})")
    link = ("CASE capture_id WHEN 0 THEN concat(repeat('ff', 12), '0800') WHEN 1 THEN concat(repeat('00', 14), '0800') "
            "WHEN 2 THEN concat('86dd', repeat('00', 18)) WHEN 3 THEN '' ELSE concat(repeat('ee', 12), '810000070800') END")
    return p.selectExpr(
        "capture_id", "index", "ts_us",
        f"cast({cycle('capture_id', [1, 113, 276, 101, 1])} as int) AS linktype",
        f"unhex(concat({link}, CASE WHEN capture_id = 2 THEN {six} ELSE {four} END, upper)) AS frame",
    ).selectExpr("*", "octet_length(frame) AS captured_len", "octet_length(frame) AS orig_len")


def dissected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key-exchange messages as dissector packets: nested payload pairs, octet values.

    Their text is put together column by column: functions over the elements of arrays, and
    ``to_json``, are interpreted for every field.
    """
    m = ike_messages(spark, sf_dir).selectExpr(
        "capture_id", "ike_version", "exchange_type", "init_spi", "resp_spi", "frame_index", "ts_us div 1000000 AS seconds", "src", "dst",
        "sa_payload", "nat_detected")
    return m.mapInArrow(dumps.texts, "capture_id bigint, layers string").select("capture_id", F.parse_json("layers").alias("layers"))
