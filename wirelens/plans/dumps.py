"""Messages as the text that a dissector prints for them, many at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TF_IDS = {1: "encr", 2: "prf", 3: "integ", 4: "dh", 5: "esn"}


def _mapped(column: pa.Array, text: Callable[[int], str]) -> pa.Array:
    """``text`` of each number, made once for all that are equal; null stays null."""
    known = pc.dictionary_encode(column)
    return pa.array([text(n) for n in known.dictionary.to_pylist()], pa.string()).take(known.indices)


def _string(column: pa.Array) -> pa.Array:
    return column.cast(pa.string())


def _field(name: str, value: pa.Array, quote: str = '"') -> pa.Array:
    """A field's text; null, so that it is left out, where ``value`` is."""
    return pc.binary_join_element_wise(f'"{name}":{quote}', value, f"{quote},", "")


def _object(*fields: pa.Array) -> pa.Array:
    joined = pc.binary_join_element_wise(*fields, "", null_handling="replace", null_replacement="")
    return pc.binary_join_element_wise("{", pc.ascii_rtrim(joined, ","), "}", "")


def _when(test: np.ndarray, value: pa.Array | str) -> pa.Array:
    return pc.if_else(pa.array(test), value, pa.scalar(None, pa.string()))


class Lists:
    """Elements of a column of lists, and how many each row has; null lists are known and hold none."""

    def __init__(self, column: pa.Array):
        self.known = column.is_valid().to_numpy(zero_copy_only=False)
        self.sizes = pc.list_value_length(column).fill_null(0).to_numpy().astype(np.int64)
        self.elements = column.flatten()

    def spread(self, of_rows: np.ndarray) -> np.ndarray:
        return np.repeat(of_rows, self.sizes)

    def text(self, texts: pa.Array) -> pa.Array:
        ends = pa.array(np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(ends, texts), ",")
        return _when(self.known, pc.binary_join_element_wise("[", joined, "]", ""))

    def kinds(self, kind: int) -> pa.Array:
        return _when(self.known, _mapped(pa.array(self.sizes), lambda n: "[" + ",".join([f'"{kind}"'] * n) + "]"))


def octets(n: int) -> str:
    """Big-endian octets of four or eight hex digits."""
    digits = 4 if n < 65536 else 8
    text = f"{n & (1 << 64) - 1:x}"[:digits].rjust(digits, "0")
    return ":".join(text[k:k + 2] for k in range(0, digits, 2))


def _attributes(attrs: Lists, container: str) -> pa.Array:
    kind, value = attrs.elements.flatten()
    return attrs.text(_object(
        pa.array([f'"{container}.format":"1",'] * len(kind), pa.string()), _field(f"{container}.type", _string(kind)),
        _field(f"{container}.value", _mapped(value, octets).fill_null(""))))


def _transforms(column: pa.Array, two: np.ndarray) -> pa.Array:
    kind, code, attrs = column.flatten()
    attrs = Lists(attrs)
    named = pc.binary_join_element_wise("NAME (", _string(code), ")", "")
    number = kind.fill_null(0).to_numpy()
    return _object(
        _field("isakmp.tf.type", _when(two, _string(kind))),
        *[_field(f"isakmp.tf.id.{name}", _when(two & (number == k), named)) for k, name in TF_IDS.items()],
        _field("isakmp.trans.id", _when(~two, _string(code))),
        _field("isakmp.ike2.attr", _when(two & (attrs.sizes > 0), _attributes(attrs, "isakmp.ike2.attr")), ""),
        _field("isakmp.ike.attr", _when(~two, _attributes(attrs, "isakmp.ike.attr")), ""))


def _proposals(column: pa.Array, two: np.ndarray) -> pa.Array:
    number, protocol, transforms = column.flatten()
    transforms = Lists(transforms)
    return _object(
        _field("isakmp.prop.number", _string(number)), _field("isakmp.prop.protoid", _string(protocol)),
        _field("isakmp.typepayload", transforms.kinds(3), ""),
        _field("isakmp.typepayload_tree", transforms.text(_transforms(transforms.elements, transforms.spread(two))), ""))


def layers(messages: pa.RecordBatch) -> pa.Array:
    """The layers of each message: frame, addresses and ISAKMP with nested pairs of payload types and contents."""
    column = {n: messages.column(n) for n in messages.schema.names}
    two = pc.equal(column["ike_version"], "ikev2").fill_null(False).to_numpy(zero_copy_only=False)
    offers = Lists(column["sa_payload"])
    sa = _object(_field("isakmp.typepayload", offers.kinds(2), ""),
                 _field("isakmp.typepayload_tree", offers.text(_proposals(offers.elements, offers.spread(two))), ""))
    nat = column["nat_detected"].fill_null(False).to_numpy(zero_copy_only=False)
    told = pa.array(np.where(two, ',{"isakmp.notify.msgtype":"16388"}', ",{}"), pa.string())
    trees = pc.binary_join_element_wise("[", sa, pc.if_else(pa.array(nat), told, ""), "]", "")
    kinds = np.where(two, np.where(nat, '["33","41"]', '["33"]'), np.where(nat, '["1","20"]', '["1"]'))
    every = [*map(pa.array, ([text] * len(two) for text in ('"isakmp.messageid":"0x00000000",', '"isakmp.length":"300",')))]
    isakmp = _object(
        _field("isakmp.ispi", column["init_spi"]), _field("isakmp.rspi", column["resp_spi"]),
        _field("isakmp.version", pa.array(np.where(two, "0x20", "0x10"), pa.string())),
        _field("isakmp.exchangetype", _string(column["exchange_type"])), *every,
        _field("isakmp.typepayload", pa.array(kinds, pa.string()), ""), _field("isakmp.typepayload_tree", trees, ""))
    frame = _object(_field("frame.number", _string(column["frame_index"])), _field(
        "frame.time_epoch", pc.binary_join_element_wise(_string(column["seconds"]), ".000000", "")))
    ip = _object(_field("ip.src", column["src"]), _field("ip.dst", column["dst"]))
    return _object(_field("frame", frame, ""), _field("ip", ip, ""), _field("isakmp", isakmp, ""))


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Capture and layers of messages, a thousand at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            some = batch.slice(start, 1000)
            yield pa.RecordBatch.from_arrays([some.column("capture_id"), layers(some)], ["capture_id", "layers"])
