"""Outer headers of frames as column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ETHERNET, SLL, SLL2 = 1, 113, 276
ESP, AH, UDP = 50, 51, 17
# IPv6 extension headers that may stand before ESP or AH.
OPTION_HEADERS = (0, 43, 60)
FRAGMENT = 44


def _bytes(at: Column, n: int) -> Column:
    return F.substring(F.col("frame"), (at + 1).cast("int"), F.lit(n))


def _uint(at: Column, n: int) -> Column:
    """Big-endian unsigned integer, null when the frame ends before it."""
    return F.when(at + n <= F.octet_length("frame"), F.conv(F.hex(_bytes(at, n)), 16, 10).cast("bigint"))


def _ipv4(at: Column) -> Column:
    return F.concat_ws(".", *[F.conv(F.hex(_bytes(at + i, 1)), 16, 10) for i in range(4)])


def _groups(at: Column) -> Column:
    """``:g1:...:g8:`` without leading zeros, from the 32 hex digits of an address."""
    wide = F.regexp_replace(F.lower(F.hex(_bytes(at, 16))), "(.{4})", ":$1")
    return F.concat(F.regexp_replace(wide, ":0{1,3}", ":"), F.lit(":"))


def _ipv6(full: Column, mapped: Column) -> Column:
    """Canonical text of ``_groups``: the first longest run of zeros is shortened."""
    short = full
    for n in range(2, 9):  # the longest run is tested last and wins
        run = ":" + "0:" * n
        short = F.when(full.contains(run), F.regexp_replace(full, f"^(.*?){run}", "$1::")).otherwise(short)
    text = F.regexp_replace(short, "^:(?!:)|(?<!:):$", "")
    return F.when(full.startswith(":0:0:0:0:0:ffff:"), F.concat(F.lit("::ffff:"), mapped)).otherwise(text)


def _link(df: DataFrame) -> DataFrame:
    """Offset of the IP header and the version its link layer announces."""
    zero = F.lit(0)
    link = F.col("linktype")
    kind = F.when(link == ETHERNET, _uint(F.lit(12), 2)).when(link == SLL, _uint(F.lit(14), 2)).when(
        link == SLL2, _uint(zero, 2))
    df = df.withColumn("_kind", kind)
    # Up to two VLAN tags sit between the Ethernet addresses and the type.
    one = (link == ETHERNET) & F.col("_kind").isin(0x8100, 0x88A8)
    df = df.withColumn("_inner", F.when(one, _uint(F.lit(16), 2)))
    two = one & F.col("_inner").isin(0x8100, 0x88A8)
    df = df.withColumn("_tags", F.when(two, 2).when(one, 1).otherwise(0))
    df = df.withColumn("_type", F.when(F.col("_tags") == 2, _uint(F.lit(20), 2)).when(
        F.col("_tags") == 1, F.col("_inner")).otherwise(F.col("_kind")))
    start = F.when(link == ETHERNET, 14 + 4 * F.col("_tags")).when(link == SLL, 16).when(link == SLL2, 20).otherwise(0)
    df = df.withColumn("_ip", start)
    nibble = F.shiftright(_uint(F.col("_ip"), 1), 4)
    listed = F.when(F.col("_type") == 0x0800, 4).when(F.col("_type") == 0x86DD, 6)
    return df.withColumn("_v", F.when(link.isin(ETHERNET, SLL, SLL2), listed).when(nibble.isin(4, 6), nibble))


def _network(df: DataFrame) -> DataFrame:
    """Addresses, payload length, and where the upper layer starts and ends."""
    ip = F.col("_ip")
    size = F.octet_length("frame")
    head = _uint(ip, 1).bitwiseAND(15) * 4
    total = _uint(ip + 2, 2)
    plen = _uint(ip + 4, 2)
    whole = F.when(F.col("_v") == 4, size >= ip + 20).when(F.col("_v") == 6, size >= ip + 40).otherwise(F.lit(False))
    df = df.withColumn("_v", F.when(whole, F.col("_v")))
    six = F.col("_v") == 6
    df = df.withColumn("_s6", F.when(six, _groups(ip + 8))).withColumn("_d6", F.when(six, _groups(ip + 24)))
    four = F.col("_v") == 4
    first = F.when(four, _uint(ip + 6, 2).bitwiseAND(0x1FFF) == 0).otherwise(F.lit(True))
    end4 = F.when(total > 0, F.least(size, ip + total)).otherwise(size)
    end6 = F.when(plen > 0, F.least(size, ip + 40 + plen)).otherwise(size)
    return df.withColumns({
        "_src": F.when(four, _ipv4(ip + 12)).otherwise(_ipv6(F.col("_s6"), _ipv4(ip + 20))),
        "_dst": F.when(four, _ipv4(ip + 16)).otherwise(_ipv6(F.col("_d6"), _ipv4(ip + 36))),
        "_plen": F.when(four, total - head).otherwise(plen),
        "_end": F.when(four, end4).otherwise(end6),
        # Later fragments carry no upper-layer header.
        "_p": F.when(four, F.when(first, _uint(ip + 9, 1))).otherwise(_uint(ip + 6, 1)),
        "_at": F.when(four, ip + head).otherwise(ip + 40),
    })


def _extensions(df: DataFrame) -> DataFrame:
    """Walk all IPv6 extension headers; an AH is remembered and walked past.

    Every header takes eight bytes at least, which bounds the steps by the packet's length.
    """
    end = F.col("_end")
    kind = "struct<p:bigint,at:bigint,ah:bigint,go:boolean>"

    def step(s: Column, _: Column) -> Column:
        p, at = s["p"], s["at"]
        size = (
            F.when(p.isin(*OPTION_HEADERS), (_uint(at + 1, 1) + 1) * 8).when(p == FRAGMENT, F.lit(8))
            .when(p == AH, (_uint(at + 1, 1) + 2) * 4)
        )
        move = s["go"] & F.coalesce(at + size <= end, F.lit(False))
        p, at = F.when(move, _uint(at, 1)).otherwise(p), F.when(move, at + size).otherwise(at)
        return F.struct(p, at, F.coalesce(s["ah"], F.when(p == AH, at)), move).cast(kind)

    ah = F.when(F.col("_p") == AH, F.col("_at"))
    start = F.struct(F.col("_p"), F.col("_at"), ah, F.lit(True)).cast(kind)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), ((end - F.col("_at")) / 8).cast("int")))
    walks = (F.col("_v") == 6) & F.col("_p").isin(*OPTION_HEADERS, FRAGMENT, AH)
    df = df.withColumn("_walk", F.when(walks, F.aggregate(steps, start, step)).otherwise(start))
    return df.withColumns({"_p": F.col("_walk.p"), "_at": F.col("_walk.at"), "_ah": F.col("_walk.ah")}).drop("_walk")


def decode_frames(frames: DataFrame) -> DataFrame:
    """Frames to packets: addresses, protocol, SPI, sequence and lengths.

    Frames that cannot be read as IP are kept as ``other`` with version zero.
    """
    df = _extensions(_network(_link(frames)))
    at, end = F.col("_at"), F.col("_end")
    room = F.greatest(F.lit(0), end - at)
    udp = (F.col("_p") == UDP) & (room >= 8)
    sport, dport = _uint(at, 2), _uint(at + 2, 2)
    body, inner = at + 8, room - 8
    df = df.withColumns({
        "_esp": F.col("_v").isNotNull() & (F.col("_p") == ESP) & (room >= 8),
        "_isah": F.col("_v").isNotNull() & F.col("_ah").isNotNull() & (end - F.col("_ah") >= 12),
        "_ike": udp & ((sport == 500) | (dport == 500)),
        "_natt": udp & ((sport == 4500) | (dport == 4500)),
        "_marker": (inner >= 4) & (_uint(body, 4) == 0),
        "_body": body, "_inner_len": inner,
    })
    on = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("_esp", "_isah", "_ike", "_natt", "_marker")}
    wrapped = on["_natt"] & ~on["_marker"] & (F.col("_inner_len") >= 8)
    proto = (
        F.when(on["_esp"], "esp").when(on["_isah"], "ah").when(on["_ike"], "isakmp")
        .when(on["_natt"] & on["_marker"], "isakmp_natt").when(wrapped, "esp").otherwise("other")
    )
    df = df.withColumn("_proto", proto)
    plain, boxed = on["_esp"], (F.col("_proto") == "esp") & ~on["_esp"]
    ike_at = F.when(F.col("_proto") == "isakmp", F.col("_body")).when(
        F.col("_proto") == "isakmp_natt", F.col("_body") + 4)
    ah = F.col("_proto") == "ah"
    return df.select(
        "capture_id", "index", "ts_us",
        F.coalesce("_v", F.lit(0)).cast("int").alias("ip_version"),
        F.coalesce("_src", F.lit("")).alias("src"), F.coalesce("_dst", F.lit("")).alias("dst"),
        F.col("_proto").alias("proto"),
        F.when(plain, _uint(F.col("_at"), 4)).when(boxed, _uint(F.col("_body"), 4)).when(
            ah, _uint(F.col("_ah") + 4, 4)).alias("spi"),
        F.when(plain, _uint(F.col("_at") + 4, 4)).when(boxed, _uint(F.col("_body") + 4, 4)).when(
            ah, _uint(F.col("_ah") + 8, 4)).alias("seq"),
        F.when(F.col("_v").isNotNull(), F.col("_plen")).otherwise(0).cast("int").alias("ip_payload_len"),
        F.when(plain, F.col("_end") - F.col("_at") - 8).when(boxed, F.col("_inner_len") - 8).cast("int").alias("esp_payload_len"),
        "captured_len", "orig_len",
        (boxed | (F.col("_proto") == "isakmp_natt")).alias("udp_encapsulated"),
        F.when(F.col("_end") - ike_at >= 28, _uint(ike_at + 20, 4)).alias("ike_message_id"),
    )
