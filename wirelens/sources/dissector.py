"""Dissector JSON dumps to typed key-exchange messages."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.functions.scalars import whole_number
from wirelens.operators.ike import PROPOSALS_TYPE
from wirelens.sources import variant

SA_TYPES, NOTIFY_TYPES = (1, 33), (11, 41)
PROPOSAL, TRANSFORM, NAT_D = 2, 3, 20
NAT_NOTIFIES = (16388, 16389)

#: Header numbers of a message and their fields.
NUMBERS = {"exchange_type": "isakmp.exchangetype", "message_id": "isakmp.messageid", "length": "isakmp.length"}
MESSAGE = ("frame_index bigint, ts_us bigint, src string, dst string, ike_version string, exchange_type bigint, message_id bigint, "
           f"init_spi string, resp_spi string, sa_payload {PROPOSALS_TYPE}, nat_detected boolean, length bigint")
#: Bytes of payloads that a task reads at once.
AT_ONCE = 1 << 20


def read_ike_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per dissected packet: capture_id (file stem) and its ``layers`` as VARIANT.

    The reader streams the elements of each dump's array, so a dump is never
    held whole.
    """
    rows = (
        spark.read.option("multiLine", "true").option("recursiveFileLookup", "true")
        .schema("_source struct<layers:variant>").json(path)
    )
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    return rows.select(stem.alias("capture_id"), F.col("_source.layers").alias("layers"))


def _path(*keys: str) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def _text(v: Column, *keys: str) -> Column:
    return F.try_variant_get(v, _path(*keys), "string")


def _whole(text: str | None) -> int | None:
    """``whole_number`` of a field; short texts are remembered."""
    return None if text is None else _remembered(text) if len(text) <= 64 else whole_number(text)


@functools.lru_cache(1 << 15)
def _remembered(text: str) -> int | None:
    return whole_number(text)


ROLES = {name: 1 << i for i, name in enumerate((
    "isakmp", "isakmp.typepayload", "isakmp.typepayload_tree", "isakmp.prop.number", "isakmp.prop.protoid", "isakmp.notify.msgtype",
    "isakmp.tf.type", "isakmp.trans.id", "isakmp.ike2.attr", "isakmp.ike.attr"))}
TF_ID, ATTR_TYPE, ATTR_VALUE = (1 << len(ROLES) + i for i in range(3))


def _roles(name: str) -> int:
    """What a field is read for: some by their whole name, some by how it begins or ends."""
    return (ROLES.get(name, 0) | TF_ID * name.startswith("isakmp.tf.id") | ATTR_TYPE * name.endswith(".attr.type")
            | ATTR_VALUE * name.endswith(".attr.value"))


class Payloads:
    """Payloads below objects: the row, the payload above (by number), type, contents and the contents' fields."""

    def __init__(self, values: variant.Values, row: np.ndarray, above: np.ndarray, kind: np.ndarray, place: np.ndarray):
        self.values, self.row, self.above, self.kind = values, row, above, kind
        self.fields = values.fields(place, row)

    def whole(self, role: int, of: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        return self.values.whole(self.fields.at(role)[of], _whole)

    def below(self) -> Payloads:
        """Types and contents paired by position.

        The two lists are cut to the shorter one; entries without a readable type
        or an object as content are dropped.
        """
        kinds, trees = self.fields.at(ROLES["isakmp.typepayload"]), self.fields.at(ROLES["isakmp.typepayload_tree"])
        both = np.flatnonzero((kinds >= 0) & (trees >= 0))
        (i, k, kind), (j, m, tree) = self.values.items(kinds[both]), self.values.items(trees[both])
        pairs = np.minimum(np.bincount(i, minlength=len(both)), np.bincount(j, minlength=len(both)))
        i, kind, tree = i[k < pairs[i]], kind[k < pairs[i]], tree[m < pairs[j]]
        kind, known = self.values.whole(kind, _whole)
        kept = known & (self.values.kind(tree) == variant.OBJECT)
        above = both[i[kept]]
        return Payloads(self.values, self.row[above], above, kind[kept], tree[kept])

    def nat_rows(self) -> np.ndarray:
        """Rows with a payload that tells of NAT discovery."""
        notify = np.flatnonzero(np.isin(self.kind, NOTIFY_TYPES))
        told, known = self.whole(ROLES["isakmp.notify.msgtype"], notify)
        return np.concatenate([self.row[self.kind == NAT_D], self.row[notify[known & np.isin(told, NAT_NOTIFIES)]]])


def _ends(owner: np.ndarray, owners: int) -> pa.Array:
    """Where the things of each owner end, from 0."""
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=owners))]).astype(np.int32))


def _rows(**columns: np.ndarray | pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], [*columns])


def _ints(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers).cast(pa.int32())


def read_payloads(layers: pa.StructArray, two: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Rows that hold a message, its proposals, and whether a payload at any depth tells of NAT discovery.

    ``two`` tells which rows are of version two. Proposals are null where none is readable, as in encrypted messages.
    """
    values = variant.Values(layers, _roles)
    rows = np.flatnonzero(values.kind(values.starts) == variant.OBJECT)
    isakmp = values.fields(values.starts[rows], rows).at(ROLES["isakmp"])
    message = values.kind(isakmp) == variant.OBJECT
    rows, isakmp = rows[message], isakmp[message]
    none = np.zeros(len(rows), np.int64)
    first = Payloads(values, rows, none, none, isakmp).below()
    second = first.below()
    third = second.below()
    nat = np.zeros(len(layers), bool)
    for level in (first, second):
        nat[level.nat_rows()] = True
    deep = third
    while len(deep.kind):
        nat[deep.nat_rows()] = True
        deep = deep.below()

    props = np.flatnonzero((second.kind == PROPOSAL) & np.isin(first.kind, SA_TYPES)[second.above])
    number, protocol = (second.whole(ROLES[f"isakmp.prop.{n}"], props)[0] for n in ("number", "protoid"))
    of = np.full(len(second.kind), -1)
    of[props] = np.arange(len(props))
    tfs = np.flatnonzero((third.kind == TRANSFORM) & (of[third.above] >= 0))
    new = two[third.row[tfs]]

    def versioned(v2: int, v1: int) -> np.ndarray:
        return np.where(new, third.fields.at(v2)[tfs], third.fields.at(v1)[tfs])

    kind, typed = third.whole(ROLES["isakmp.tf.type"], tfs)
    code, known = values.whole(versioned(TF_ID, ROLES["isakmp.trans.id"]), _whole)
    attrs = versioned(ROLES["isakmp.ike2.attr"], ROLES["isakmp.ike.attr"])
    kept = known & (typed | ~new)
    tfs, kind, code, attrs = tfs[kept], np.where(new, kind, -1)[kept], code[kept], attrs[kept]
    owner, _, place = values.items(attrs)
    objects = values.kind(place) == variant.OBJECT
    owner, place = owner[objects], place[objects]
    fields = values.fields(place, third.row[tfs][owner])
    (attr_type, has_type), (value, has_value) = (values.whole(fields.at(role), _whole) for role in (ATTR_TYPE, ATTR_VALUE))
    both = has_type & has_value

    parts = pa.ListArray.from_arrays(_ends(owner[both], len(tfs)), _rows(attr_type=_ints(attr_type[both]), value=value[both]))
    parts = pa.ListArray.from_arrays(_ends(of[third.above[tfs]], len(props)), _rows(
        transform_type=_ints(kind), transform_id=_ints(code), attrs=parts))
    parts = _rows(number=_ints(number), protocol_id=_ints(protocol), transforms=parts)
    place = np.searchsorted(rows, second.row[props])
    parts = pa.ListArray.from_arrays(_ends(place, len(rows)), parts, mask=pa.array(np.bincount(place, minlength=len(rows)) == 0))
    return rows, parts, pa.array(nat[rows])


@functools.lru_cache(1 << 10)
def is_version_two(nibble: str | None, spelled: str | None, raw: str | None) -> bool:
    """Whether the major version from the nibble, a spelled-out field, dotted text or the packed byte is two."""
    if (major := _whole(nibble)) is not None:
        return major == 2
    if spelled is not None:
        return _whole(spelled) == 2
    if raw is not None and "." in raw:
        return _whole(raw.partition(".")[0]) == 2
    packed = _whole(raw)
    return packed is not None and packed >> 4 == 2


def _spi(layers: Column, *names: str) -> Column:
    return F.lower(F.replace(F.coalesce(*[_text(layers, "isakmp", n) for n in names], F.lit("")), F.lit(":"), F.lit("")))


def parse_messages(packets: DataFrame) -> DataFrame:
    """Typed messages of (capture_id, layers VARIANT); other packets are dropped.

    Spark reads the header's texts. Payloads are walked level by level, many messages at once, over the
    VARIANT's own bytes: an expression that takes a part out of a VARIANT builds that part anew, and so again at every level.
    """
    layers = F.col("layers")
    seconds = F.coalesce(_text(layers, "frame", "frame.time_epoch").try_cast("decimal(20,9)"), F.lit(0).cast("decimal(20,9)"))
    df = packets.filter(layers.isNotNull()).select(
        "capture_id", F.floor(seconds * 1_000_000).cast("bigint").alias("ts_us"),
        F.coalesce(_text(layers, "ip", "ip.src"), _text(layers, "ipv6", "ipv6.src"), F.lit("")).alias("src"),
        F.coalesce(_text(layers, "ip", "ip.dst"), _text(layers, "ipv6", "ipv6.dst"), F.lit("")).alias("dst"),
        _spi(layers, "isakmp.ispi", "isakmp.init_spi", "isakmp.icookie").alias("init_spi"),
        _spi(layers, "isakmp.rspi", "isakmp.resp_spi", "isakmp.rcookie").alias("resp_spi"),
        _text(layers, "frame", "frame.number").alias("frame_index"),
        *[_text(layers, "isakmp", field).alias(name) for name, field in NUMBERS.items()],
        _text(layers, "isakmp", "isakmp.version_tree", "isakmp.mjver").alias("nibble"),
        _text(layers, "isakmp", "isakmp.majorversion").alias("spelled"), _text(layers, "isakmp", "isakmp.version").alias("raw"),
        "layers")
    schema = T.StructType([packets.schema["capture_id"], *T.StructType.fromDDL(MESSAGE).fields])
    names = schema.names

    def run(batches):
        for whole in batches:
            for start, stop in variant.slices(whole.column("layers"), AT_ONCE):
                batch = whole.slice(start, stop - start)
                column = {n: batch.column(n) for n in batch.schema.names}
                two = np.array([*map(is_version_two, *(column[n].to_pylist() for n in ("nibble", "spelled", "raw")))], bool)
                rows, proposals, nat = read_payloads(column["layers"], two)
                column["ike_version"] = pa.array(np.where(two, "ikev2", "ikev1"), pa.string())
                for n in ("frame_index", *NUMBERS):
                    column[n] = pa.array([_whole(t) or 0 for t in column[n].to_pylist()], pa.int64())
                column = {n: column[n].take(pa.array(rows)) for n in names if n in column}
                column |= {"sa_payload": proposals, "nat_detected": nat}
                yield pa.RecordBatch.from_arrays([column[n] for n in names], names)

    return df.mapInArrow(run, schema)
