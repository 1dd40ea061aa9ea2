"""Negotiations from key-exchange messages, and their link to associations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.functions import attrs, scalars
from wirelens.operators import ordered
from wirelens.session import materialise

CORRELATION_US = 30_000_000
SAME_FAMILY = 0.6

TRANSFORM_TYPE = (
    "struct<transform_type:int,transform_id:int,attrs:array<struct<attr_type:int,value:bigint>>>"
)
PROPOSALS_TYPE = f"array<struct<number:int,protocol_id:int,transforms:array<{TRANSFORM_TYPE}>>>"


def _first(array: Column, test) -> Column:
    return F.get(F.filter(array, test), F.lit(0))


def _attr(transform: Column, attr_type: int) -> Column:
    return _first(transform["attrs"], lambda a: a["attr_type"] == attr_type)["value"]


def _typed(proposal: Column, transform_type: int) -> Column:
    return _first(proposal["transforms"], lambda t: t["transform_type"] == transform_type)


def _cipher_code(transform: Column, version: Column) -> Column:
    """Registry id of the cipher a transform offers, null when it offers none."""
    return F.when(version == "ikev2", F.when(
        transform["transform_type"] == dims.TF_ENCR, transform["transform_id"]
    ).cast("bigint")).otherwise(_attr(transform, dims.AT_V1_ENCR))


def _cipher(transform: Column, version: Column) -> Column:
    """(alg, bits) one transform offers; null alg when it offers no cipher."""
    def named(code: Column) -> Column:
        return scalars.algorithm(version, code, {"ikev2": "encr", "ikev1": "encr"})

    return scalars.let(
        scalars.let(_cipher_code(transform, version), named),
        lambda alg: F.struct(alg.alias("alg"), scalars.key_bits(_attr(transform, dims.AT_KEY_LENGTH), alg).alias("bits")))


def exchange_mode(version: Column, exchange_type: Column) -> Column:
    return F.when(version == "ikev1", F.when(exchange_type == 2, "main").when(
        exchange_type == 4, "aggressive"))


def _by_spi():
    return Window.partitionBy("capture_id", "init_spi").orderBy("ts_us", "frame_index")


def _first_two(messages: DataFrame) -> DataFrame:
    """First and second message per initiator SPI, numbered.

    The rank filter also runs on the map side, so a repeated SPI ships at most
    two messages per task.
    """
    return messages.withColumn("_rn", F.row_number().over(_by_spi())).filter(F.col("_rn") <= 2)


def request_response(messages: DataFrame) -> DataFrame:
    """First and second proposal-bearing message per initiator SPI."""
    rows = _first_two(messages.filter(F.col("sa_payload").isNotNull()))
    whole = F.struct(*[c for c in messages.columns if c not in ("capture_id", "init_spi")])
    return rows.groupBy("capture_id", "init_spi").agg(
        F.first(F.when(F.col("_rn") == 1, whole), True).alias("req"),
        F.first(F.when(F.col("_rn") == 2, whole), True).alias("res"),
    )


def negotiation_heads(messages: DataFrame) -> DataFrame:
    """``build_negotiations`` without what was negotiated: SPI, endpoints, time and request frame, in one shuffle of narrow rows."""
    slim = messages.filter(F.col("sa_payload").isNotNull()).select("capture_id", "init_spi", "src", "dst", "ts_us", "frame_index")
    rows = _first_two(slim).withColumn("_next", F.lead("ts_us").over(_by_spi())).filter("_rn = 1")
    return rows.select("capture_id", "init_spi", "src", "dst", F.coalesce("_next", "ts_us").alias("ts_us"),
                       F.col("frame_index").alias("request_frame"))


def build_negotiations(messages: DataFrame) -> DataFrame:
    """One row per negotiation: what was offered, chosen, and could be forced."""
    n = request_response(messages)
    n = n.withColumn("version", F.col("req.ike_version"))
    n = n.withColumn("selected", F.get(F.col("res.sa_payload"), F.lit(0)))
    n = n.withColumn("t0", F.get(F.col("selected.transforms"), F.lit(0)))
    v, sel, t0 = F.col("version"), F.col("selected"), F.col("t0")
    v2 = v == "ikev2"
    n = n.withColumn("encr", F.when(v2, _typed(sel, dims.TF_ENCR)).otherwise(t0))
    # Registry ids first, as columns: each is looked up in several places below.
    n = n.withColumns({
        "c_encr": _cipher_code(F.col("encr"), v),
        "c_bits": _attr(F.col("encr"), dims.AT_KEY_LENGTH),
        "c_integ": F.when(v2, _typed(sel, dims.TF_INTEG)["transform_id"].cast("bigint")).otherwise(_attr(t0, dims.AT_V1_HASH)),
        "c_prf": F.when(v2, _typed(sel, dims.TF_PRF)["transform_id"]),
        "c_dh": F.when(v2, _typed(sel, dims.TF_DH)["transform_id"].cast("bigint")).otherwise(_attr(t0, dims.AT_V1_GROUP)),
        "c_esn": _typed(sel, dims.TF_ESN)["transform_id"],
        "c_auth": F.when(~v2, _attr(t0, dims.AT_V1_AUTH)),
        "c_life": F.when(~v2 & (_attr(t0, dims.AT_V1_LIFE_TYPE) == dims.LIFE_TYPE_SECONDS),
                         _attr(t0, dims.AT_V1_LIFE_DURATION)),
    })
    n = n.withColumn("alg", scalars.algorithm(v, F.col("c_encr"), {"ikev2": "encr", "ikev1": "encr"}))
    return n.select(
        "capture_id", "init_spi", F.col("res.resp_spi").alias("resp_spi"),
        v.alias("ike_version"),
        exchange_mode(v, F.col("req.exchange_type")).alias("exchange_mode"),
        F.col("req.src").alias("src"), F.col("req.dst").alias("dst"),
        F.coalesce("res.ts_us", "req.ts_us").alias("ts_us"),
        F.col("req.frame_index").alias("request_frame"),
        F.col("res.frame_index").alias("response_frame"),
        F.col("req.sa_payload").alias("proposed"), sel.alias("selected"),
        F.col("alg").alias("encryption_alg"), scalars.key_bits(F.col("c_bits"), F.col("alg")).alias("encryption_keylen"),
        scalars.algorithm(v, F.col("c_integ"), {"ikev2": "integ", "ikev1": "hash"}).alias("integrity_alg"),
        scalars.algorithm(v, F.col("c_prf"), {"ikev2": "prf"}).alias("prf_alg"),
        F.col("c_dh").cast("int").alias("dh_group"), F.col("c_life").cast("int").alias("lifetime_s"),
        scalars.algorithm(v, F.col("c_auth"), {"ikev1": "auth"}).alias("auth_method"),
        (F.col("c_esn") == 1).alias("esn"),
        (F.col("req.nat_detected") | F.coalesce(F.col("res.nat_detected"), F.lit(False))).alias("nat_detected"),
    ).transform(downgrade_available)


def downgrade_available(negotiations: DataFrame) -> DataFrame:
    """Add whether any offered cipher is weaker than the chosen one."""
    chosen = scalars.strength(F.col("encryption_alg"), F.col("encryption_keylen"))

    def weaker(t: Column) -> Column:
        return scalars.let(_cipher(t, F.col("ike_version")), lambda c: (
            c["alg"].isNotNull() & (c["alg"] != "unknown") & (scalars.strength(c["alg"], c["bits"]) < chosen)))

    offered = F.flatten(F.transform("proposed", lambda p: p["transforms"]))
    possible = F.col("encryption_alg").isNotNull() & (F.col("encryption_alg") != "unknown")
    return negotiations.withColumn(
        "downgrade_available", F.coalesce(possible & F.exists(offered, weaker), F.lit(False)))


ENDS = ["capture_id", "lo", "hi"]


def _with_ends(df: DataFrame) -> DataFrame:
    return df.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))


def _latest(rollup: DataFrame, known: DataFrame, window_us: int, bucket_us: int) -> DataFrame:
    """ENDS, pair_id, time and request frame (``_ts``, ``_frame``) of each flow's negotiation among ``known``."""
    # Equal times: of two negotiations the one seen first wins, so one a time is enough.
    neg = known.groupBy(*ENDS, F.col("ts_us").alias("at")).agg(F.min("request_frame").alias("frame"))
    neg = neg.select(*ENDS, "at", F.lit(0).alias("kind"), F.struct(F.col("at").alias("ts"), "frame").alias("mark"),
                     F.lit(None).cast("bigint").alias("pair_id"))
    sa = _with_ends(rollup).select(*ENDS, F.col("fwd_start_us").alias("at"), F.lit(1).alias("kind"),
                                   F.lit(None).cast(neg.schema["mark"].dataType).alias("mark"), "pair_id")
    line = ordered.last_value(neg.unionByName(sa), ENDS, ["at", "kind"], F.expr(f"at div {bucket_us}"), "mark", "_m")
    near = F.when(F.col("at") - F.col("_m.ts") <= window_us, F.col("_m"))
    found = line.filter("kind = 1").select(*ENDS, "pair_id", near.alias("_m"))
    return found.select(*ENDS, "pair_id", F.col("_m.ts").alias("_ts"), F.col("_m.frame").alias("_frame"))


_AT = [*ENDS, "_ts", "_frame"]


def _attach(found: DataFrame, negotiations: DataFrame) -> DataFrame:
    wide = _with_ends(negotiations).select(*ENDS, F.col("ts_us").alias("_ts"), F.col("request_frame").alias("_frame"),
                                           F.struct(*negotiations.columns).alias("negotiation"))
    return found.join(wide, _AT, "left").select("capture_id", "pair_id", "negotiation")


def correlate(rollup: DataFrame, negotiations: DataFrame, window_us: int = CORRELATION_US,
              bucket_us: int = 1_000_000) -> DataFrame:
    """Latest negotiation of the same endpoints at most ``window_us`` before each flow.

    An as-of join without pairs: times and frames of both sides lie on one line, on
    which the last negotiation is carried forward from bucket to bucket, so a busy
    endpoint pair is split by time. Only then the matched negotiations' columns are joined.
    """
    return _attach(_latest(rollup, _with_ends(negotiations), window_us, bucket_us), negotiations)


def spi_keys(spis: DataFrame) -> DataFrame:
    """``spis`` (capture_id, init_spi) named for ``same_spi``."""
    return spis.select(F.col("capture_id").alias("_capture"), F.col("init_spi").alias("_spi"))


def same_spi() -> Column:
    return (F.col("capture_id") == F.col("_capture")) & F.col("init_spi").eqNullSafe(F.col("_spi"))


def correlate_messages(rollup: DataFrame, messages: DataFrame, window_us: int = CORRELATION_US,
                       bucket_us: int = 1_000_000, of_spis: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``correlate`` from messages: only matched negotiations are built from their proposals.

    Times, endpoints and the matches are written once; they are narrow and read twice.
    ``of_spis`` returns the messages of given SPIs (capture_id, init_spi), for sources that
    can leave the others unmade; without it they are joined with ``messages``.
    """
    heads = materialise(_with_ends(negotiation_heads(messages)))
    found = materialise(_latest(rollup, heads, window_us, bucket_us))
    met = heads.withColumnsRenamed({"ts_us": "_ts", "request_frame": "_frame"}).join(found.select(*_AT).distinct(), _AT, "left_semi")
    spis = materialise(met.select("capture_id", "init_spi").distinct())
    mine = of_spis(spis) if of_spis is not None else messages.join(spi_keys(spis), same_spi(), "left_semi")
    return _attach(found, build_negotiations(mine))


def _proof() -> Column:
    frames = F.filter(
        F.array(F.col("negotiation.request_frame"), F.col("negotiation.response_frame")),
        lambda x: x.isNotNull())
    # Dissector frames count from one, packet indices from zero.
    return attrs.evidence("ike_sa_init_transform", F.transform(frames, lambda x: x - 1))


NO_NEGOTIATION = "no negotiation in this capture matches by endpoints and time"


def assemble_sas(rollup: DataFrame, correlated: DataFrame) -> DataFrame:
    """Associations with their sixteen provenance-carrying parameters."""
    j = rollup.join(correlated, ["capture_id", "pair_id"], "left")
    has = F.col("negotiation").isNotNull()
    proof = _proof()

    def neg(name: str) -> Column:
        return F.col(f"negotiation.{name}")

    v2 = neg("ike_version") == "ikev2"

    def seen(name: str, typ: str, reason: str, gate: tuple[Column, str] | None = None) -> Column:
        out = F.when(~has, attrs.unavailable(NO_NEGOTIATION, typ))
        if gate is not None:
            out = out.when(gate[0], attrs.unavailable(gate[1], typ))
        return out.when(neg(name).isNotNull(), attrs.observed(neg(name), typ, proof)).otherwise(
            attrs.unavailable(reason, typ))

    def family(name: str, typ: str, what: str) -> Column:
        known = neg(name).isNotNull()
        if typ == "string":
            known = known & (neg(name) != "unknown")
        return (
            F.when(~has, attrs.unavailable(NO_NEGOTIATION, typ))
            .when(known, attrs.inferred(neg(name), typ, SAME_FAMILY, proof,
                                        f"assumed equal to the negotiated {what}; the child's own is encrypted"))
            .otherwise(attrs.unavailable(f"the negotiated {what} could not be identified", typ))
        )

    nat_proof = attrs.evidence("udp_4500_encapsulation", F.array("pair_id"))
    return j.select(
        "capture_id", "pair_id", "spi_initiator", "spi_responder", "src", "dst", "ip_version",
        F.col("proto").alias("protocol"), "first_us", "last_us", "packet_count", "byte_count",
        seen("ike_version", "string", "no version").alias("ike_version"),
        seen("exchange_mode", "string", "the exchange was neither main nor aggressive",
             (v2, "version 2 has no exchange mode")).alias("ike_exchange_mode"),
        family("encryption_alg", "string", "cipher").alias("encryption_alg"),
        family("encryption_keylen", "int", "key length").alias("encryption_keylen"),
        family("integrity_alg", "string", "integrity algorithm").alias("integrity_alg"),
        seen("prf_alg", "string", "no such transform in the proposal",
             (~v2, "version 1 derives it from the hash")).alias("prf_alg"),
        seen("dh_group", "int", "no group in the proposal").alias("dh_group"),
        attrs.unavailable("not carried in the clear; inferred from packet geometry", "string").alias("operating_mode"),
        attrs.unavailable("inferred from rekey exchange sizes", "boolean").alias("pfs_enabled"),
        seen("auth_method", "string", "no such attribute in the proposal",
             (v2, "version 2 authenticates inside an encrypted exchange")).alias("auth_method"),
        seen("lifetime_s", "int", "no lifetime in seconds in the proposal",
             (v2, "version 2 negotiates no lifetime")).alias("negotiated_lifetime_s"),
        attrs.unavailable("inferred from SPI rotation", "int").alias("observed_rekey_s"),
        seen("esn", "boolean", "negotiated inside an encrypted exchange").alias("esn_negotiated"),
        attrs.unavailable("inferred from sequence numbers", "boolean").alias("replay_sane"),
        attrs.observed(
            F.col("udp_encapsulated"), "boolean", nat_proof,
            F.when(~F.col("udp_encapsulated") & F.coalesce(neg("nat_detected"), F.lit(False)),
                   "discovery ran and found no translation")).alias("nat_traversal"),
        F.when(~has, attrs.unavailable(NO_NEGOTIATION, "boolean"))
        .when(neg("selected").isNotNull(), attrs.observed(neg("downgrade_available"), "boolean", proof))
        .otherwise(attrs.unavailable("the chosen proposal was not captured", "boolean"))
        .alias("downgrade_available"),
        F.array().cast("array<struct<label:string,probability:double,start_us:bigint,end_us:bigint>>")
        .alias("inner_traffic"),
    )


def overlay(sas: DataFrame, inferred: DataFrame, always: tuple[str, ...] = (
        "operating_mode", "pfs_enabled", "replay_sane", "observed_rekey_s", "inner_traffic"),
        fallback: tuple[str, ...] = ("encryption_alg", "integrity_alg")) -> DataFrame:
    """Fold inferences into associations; observations are never overwritten.

    ``inferred`` has one row per (capture_id, pair_id) and any of the columns.
    """
    keys = ["capture_id", "pair_id"]
    names = [c for c in inferred.columns if c in always or c in fallback]
    right = inferred.select(*keys, *[F.col(c).alias(f"_i_{c}") for c in names])
    j = sas.join(right, keys, "left")
    out = []
    for c in sas.columns:
        if c not in names:
            out.append(F.col(c))
            continue
        new = F.col(f"_i_{c}")
        if c in fallback:
            take = (F.col(c)["provenance"] == "unavailable") & new["value"].isNotNull()
            out.append(F.when(take, new).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(new, F.col(c)).alias(c))
    return j.select(*out)


def with_exchange_sizes(rollup: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each association's exchange summaries by unordered endpoints."""
    r = rollup.select("capture_id", "pair_id", F.least("src", "dst").alias("lo"),
                      F.greatest("src", "dst").alias("hi"))
    return r.join(sizes, ["capture_id", "lo", "hi"], "left")


def with_rekey(rollup: DataFrame, rekeys: DataFrame) -> DataFrame:
    """Each association's rekey interval by directed endpoints."""
    return rollup.select("capture_id", "pair_id", "src", "dst").join(
        rekeys, ["capture_id", "src", "dst"], "left")

