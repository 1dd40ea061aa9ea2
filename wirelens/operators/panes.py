"""Sliding windows as merges of panes.

A pane is the part of a pair's time that lies in the same windows. Its packets meet
once, in one task, and become a state whose size the pane's length bounds, not its
rate: counted lengths by direction, counted gaps (their sum is at most the pane, so
few are distinct), the first and the last time. A window merges the states of its panes
and adds the gaps between them. States of parts of a pane merge in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.operators.windows import PANE_KEYS, STRIDE_US, WINDOW_KEYS, WINDOW_US, in_windows, pane_us

BURST_GAP_US = 200_000
#: Counted values of a state: lengths forth and back, gaps.
KINDS = ("up", "down", "gap")
STATE = ("capture_id long, pair_id long, pane long, paired boolean, anchor_us long, first_us long, first_index long, last_us long, "
         + ", ".join(f"{k}_value array<long>, {k}_count array<long>" for k in KINDS))


def _breaks(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted run of equal keys begins."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _counted(owner: np.ndarray, value: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) in order, and how often each occurs."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    at = np.flatnonzero(_breaks(owner, value))
    total = np.diff(np.r_[at, len(owner)]) if count is None else np.add.reduceat(count[order], at) if len(at) else count
    return owner[at], value[at], total


def pane_states(tagged: DataFrame, window_us: int = WINDOW_US, stride_us: int = STRIDE_US) -> DataFrame:
    """``STATE`` rows of the panes of ``tagged`` packets; large panes give several, in order of time."""
    rows = tagged.select("capture_id", "pair_id", F.expr(f"(ts_us - first_us) div {pane_us(window_us, stride_us)}").alias("pane"), "ts_us", "index",
                         F.coalesce("esp_payload_len", F.lit(0)).cast("long").alias("length"), "up", "paired", "first_us")
    rows = rows.repartition(*PANE_KEYS).sortWithinPartitions(*PANE_KEYS, "ts_us", "index")
    names = [f.split()[0] for f in STATE.split(", ")]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            ts, index, length, up = at("ts_us"), at("index"), at("length"), at("up").astype(bool)
            new = _breaks(*(at(k) for k in PANE_KEYS))
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(new)] - 1
            piece = np.cumsum(new) - 1
            inside = np.flatnonzero(~new)
            lists = []
            for owner, value in ((piece[up], length[up]), (piece[~up], length[~up]), (piece[inside], ts[inside] - ts[inside - 1])):
                owner, value, count = _counted(owner, value)
                offsets = pa.array(np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32))
                lists += [pa.ListArray.from_arrays(offsets, pa.array(value, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(count, pa.int64()))]
            pick = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pick) for c in (*PANE_KEYS, "paired", "first_us")), pa.array(ts[first]), pa.array(index[first]), pa.array(ts[last]), *lists], names)

    return rows.mapInArrow(run, STATE)


class _Histogram:
    """Counted values of ``n`` windows, by window and value."""

    def __init__(self, n: int, owner: np.ndarray, value: np.ndarray, count: np.ndarray):
        self.n, self.owner, self.value, self.count = n, *_counted(owner, value, count)
        self.total = self.sum(self.count)
        self.some = self.total > 0
        self.starts = np.searchsorted(self.owner, np.arange(n + 1))

    def sum(self, weight: np.ndarray, where: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(self.owner[where], weight[where], minlength=self.n)

    def of(self, places: np.ndarray) -> np.ndarray:
        """The values at ``places``, zero for windows without any."""
        return np.where(self.some, self.value[np.minimum(places, max(len(self.value) - 1, 0))], 0).astype(float) if len(self.value) else np.zeros(self.n)

    def stats(self, prefix: str, scale: float = 1.0) -> dict[str, np.ndarray]:
        """Mean, deviation, range and nearest-rank percentiles; zero when there is no value."""
        mean = self.sum(self.value * self.count) / np.maximum(self.total, 1)
        spread = self.sum((self.value - mean[self.owner]) ** 2 * self.count)
        out = {"mean": mean, "std": np.sqrt(spread / np.maximum(self.total - 1, 1)), "min": self.of(self.starts[:-1]), "max": self.of(np.maximum(self.starts[1:] - 1, 0))}
        seen = np.cumsum(self.count)
        before = np.cumsum(self.total) - self.total
        for p in dims.PERCENTILES:
            rank = (np.maximum(self.total.astype(np.int64) - 1, 0) * p + 50) // 100 + 1
            out[f"p{p}"] = self.of(np.searchsorted(seen, before + rank))
        return {f"{prefix}_{name}": value / scale for name, value in out.items()}

    def modal(self) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent value, the smaller of several, and its count."""
        order = np.lexsort((self.value, -self.count, self.owner))
        found = _Histogram.of(self, order[np.minimum(self.starts[:-1], max(len(order) - 1, 0))]) if len(order) else np.zeros(self.n)
        often = self.count[order[np.minimum(self.starts[:-1], max(len(order) - 1, 0))]] if len(order) else np.zeros(self.n)
        return found, np.where(self.some, often, 0)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b != 0, a / np.where(b != 0, b, 1), 0.0)


def _features(rows: pa.Table, stride_us: int, min_packets: int) -> pa.RecordBatch:
    """The features of whole windows, whose states lie together in order of time."""
    at = lambda name: rows.column(name).to_numpy()
    new = _breaks(*(at(k) for k in WINDOW_KEYS))
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(new)] - 1
    n, window = len(first), np.cumsum(new) - 1
    held = {}
    for kind in KINDS:
        value, count = (rows.column(f"{kind}_{part}").combine_chunks() for part in ("value", "count"))
        held[kind] = (np.repeat(window, value.value_lengths().to_numpy(zero_copy_only=False)), value.flatten().to_numpy(), count.flatten().to_numpy())
    inside = np.flatnonzero(~new)  # states after another one of the window: a gap lies between
    held["gap"] = tuple(np.concatenate(x) for x in zip(held["gap"], (window[inside], at("first_us")[inside] - at("last_us")[inside - 1], np.ones(len(inside), np.int64)), strict=True))
    up, down, gap = (_Histogram(n, *held[kind]) for kind in KINDS)
    every = _Histogram(n, *(np.concatenate(x) for x in zip(held["up"], held["down"], strict=True)))
    packets, size = every.total, every.sum(every.value * every.count)
    duration = np.maximum(1e-6, (at("last_us")[last] - at("first_us")[first]) / 1e6)
    burst = gap.value > BURST_GAP_US
    bursts, idle = gap.sum(gap.count, burst), gap.sum(gap.value * gap.count, burst)
    ups, downs = up.sum(up.value * up.count), down.sum(down.value * down.count)
    modal, often = every.modal()
    iat = gap.stats("iat", 1e6)
    paired = at("paired")[first].astype(bool)
    made = {
        **every.stats("esp_len"), **{f"esp_len_mod16_{r}": every.sum(every.count, every.value % 16 == r) / packets for r in range(16)},
        "esp_len_distinct": np.diff(every.starts), "esp_len_modal": modal, "esp_len_modal_share": often / packets,
        "packet_count": packets, "byte_count": size, "duration_s": duration, "packets_per_s": packets / duration, "bytes_per_s": size / duration,
        **iat, "iat_cv": _share(iat["iat_std"], iat["iat_mean"]),
        "burst_count": bursts, "idle_total_s": idle / 1e6, "idle_mean_s": _share(idle, bursts) / 1e6,
        "up_packets": up.total, "down_packets": down.total, "up_down_byte_ratio": _share(ups, downs), "up_down_packet_ratio": _share(up.total, down.total),
        **up.stats("up_len"), **down.stats("down_len"),
        "sa_spi_count": np.where(paired, 2.0, 1.0), "sa_paired": np.where(paired, 1.0, 0.0),
    }
    keep = np.flatnonzero((up.total > 0) & (packets >= min_packets))
    keys = [at(k)[first][keep] for k in WINDOW_KEYS]
    start = at("anchor_us")[first][keep] + keys[2] * stride_us
    columns = [*(pa.array(k, pa.int64()) for k in keys), pa.array(start, pa.int64()), *(pa.array(made[f][keep].astype(float)) for f in dims.FEATURES)]
    return pa.RecordBatch.from_arrays(columns, [*WINDOW_KEYS, "start_us", *dims.FEATURES])


def window_features(tagged: DataFrame, min_packets: int = 1, window_us: int = WINDOW_US, stride_us: int = STRIDE_US) -> DataFrame:
    """One row per (pair, window) with the 74 features in model order.

    Packets are shuffled once, by pane; what then meets by window are states. Windows
    without a forward packet, or with fewer than ``min_packets``, give none. ``tagged``:
    capture_id, pair_id, first_us, ts_us, index, esp_payload_len (null counts as 0), up, paired.
    """
    states = in_windows(pane_states(tagged, window_us, stride_us), window_us, stride_us)
    states = states.repartition(*WINDOW_KEYS).sortWithinPartitions(*WINDOW_KEYS, "first_us", "first_index")

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            begins = np.flatnonzero(_breaks(*(table.column(k).to_numpy() for k in WINDOW_KEYS)))
            if begins[-1]:
                yield _features(table.slice(0, begins[-1]).combine_chunks(), stride_us, min_packets)
            held = table.slice(begins[-1])  # its window may go on in the next batch
        if held is not None:
            yield _features(held.combine_chunks(), stride_us, min_packets)

    schema = ", ".join([*(f"{k} long" for k in WINDOW_KEYS), "start_us long", *(f"{f} double" for f in dims.FEATURES)])
    return states.mapInArrow(run, schema)
