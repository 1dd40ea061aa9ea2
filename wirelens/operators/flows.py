"""Flows, paired security associations and their rollups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.functions import scalars
from wirelens.operators import ordered
from wirelens.session import materialise

FLOW_KEYS = ["capture_id", "src", "dst", "spi", "proto"]
GROUP = ["capture_id", "lo", "hi", "proto"]

#: Flows of one endpoint pair that a task matches at once; longer lists are swept block by block.
BLOCK_FLOWS = 8192
#: Packet numbers within which the flows of an endpoint pair are counted together.
NUMBERED = 1_000_000
#: How many times as many blocks a task sweeps again in each round, and the flows of them it comes to at most.
WIDEN = 8
STRETCH_FLOWS = 1 << 20


def summarise_flows(packets: DataFrame) -> DataFrame:
    """One row per directed flow, aggregated map-side before its only shuffle."""
    return (
        packets.filter(scalars.is_flow_packet(F.col("proto"), F.col("spi")))
        .groupBy(*FLOW_KEYS)
        .agg(
            F.min("index").alias("first_index"),
            F.min("ts_us").alias("start_ts_us"),
            F.max("ts_us").alias("end_ts_us"),
            F.count(F.lit(1)).alias("packets"),
            F.sum("ip_payload_len").cast("bigint").alias("bytes"),
            F.min_by("ip_version", "index").alias("ip_version"),
            F.max("udp_encapsulated").alias("udp_encapsulated"),
        )
    )


def _flow_struct() -> Column:
    return F.struct(
        "first_index", "src", "dst", "spi", "start_ts_us", "end_ts_us", "packets", "bytes",
        "ip_version", "udp_encapsulated",
    )


BLOCK = [*GROUP, "block"]
#: What flows of later blocks could still overlap, by direction; null where none follow.
LATER = ["up_from", "up_to", "down_from", "down_to"]
FATE = "capture_id long, lo string, hi string, proto string, block long, first_index long, partner long, start_ts_us long, end_ts_us long, up boolean, open boolean"


class _Waiting:
    """Open flows of one direction in arrival order; the earliest that overlaps is found over whole columns."""

    def __init__(self):
        self.place, self.n = [], 0
        self.start, self.end = np.empty(64, np.int64), np.empty(64, np.int64)

    def add(self, place: int, start: int, end: int) -> None:
        if self.n == len(self.start):
            self.start, self.end = np.resize(self.start, 2 * self.n), np.resize(self.end, 2 * self.n)
        self.start[self.n], self.end[self.n] = start, end
        self.place.append(place)
        self.n += 1

    def take(self, begin: int, until: int) -> int | None:
        """The earliest flow that overlaps, no longer open."""
        hit = (self.start[:self.n] <= until) & (self.end[:self.n] >= begin)
        at = int(hit.argmax()) if self.n else 0
        if not self.n or not hit[at]:
            return None
        self.start[at:self.n - 1], self.end[at:self.n - 1] = self.start[at + 1:self.n], self.end[at + 1:self.n]
        self.n -= 1
        return self.place.pop(at)

    def drop(self, soonest: int | None) -> list[int]:
        """Flows that end before all that follows starts, no longer open."""
        keep = self.end[:self.n] >= soonest if soonest is not None else np.zeros(self.n, bool)
        if keep.all():
            return []
        past = [j for j, k in zip(self.place, keep, strict=True) if not k]
        self.place = [j for j, k in zip(self.place, keep, strict=True) if k]
        n = len(self.place)
        self.start[:n], self.end[:n] = self.start[:self.n][keep], self.end[:self.n][keep]
        self.n = n
        return past


#: Open flows of a direction beyond which those that nothing can meet any more are looked for, again at twice what is left.
CROWD = 64


def _swept(index, start, end, up, alone: bool, later) -> list[tuple]:
    """(place, place of the partner or -1, still open) of the flows of one block, in arrival order.

    Each flow takes the earliest open flow that runs the other way and overlaps it, else
    it stays open. Open flows that end before all that follows starts are out of the way.
    """
    n = len(index)
    soonest, latest = [None] * (n + 1), {True: (later[0], later[1]), False: (later[2], later[3])}
    soonest[n] = min((x for x, _ in latest.values() if x is not None), default=None)
    for i in range(n - 1, -1, -1):
        soonest[i] = start[i] if soonest[i + 1] is None else min(start[i], soonest[i + 1])
    waiting = {True: _Waiting(), False: _Waiting()}
    crowd = {True: CROWD, False: CROWD}
    out = []
    for i in range(n):
        j = waiting[up[i] if alone else not up[i]].take(start[i], end[i])
        if j is not None:
            out.append((j, i, False))
            continue
        mine = waiting[up[i]]
        mine.add(i, start[i], end[i])
        if mine.n > crowd[up[i]]:
            out.extend((j, -1, False) for j in mine.drop(soonest[i + 1]))
            crowd[up[i]] = max(CROWD, 2 * mine.n)
    for way, open_ in waiting.items():
        from_, to = latest[way if alone else not way]
        for j in open_.place:
            out.append((j, -1, from_ is not None and from_ <= end[j] and start[j] <= to))
    return out


def _sweep(rows: DataFrame, width: int = 1) -> DataFrame:
    """``FATE`` of the flows of ``rows`` (BLOCK, first_index, start_ts_us, end_ts_us, up, LATER), each stretch of ``width`` blocks in one task.

    The blocks of a stretch are swept one after the other, each with the flows left open by the one before;
    the task holds one of them at a time. A flow matched here has its partner (or none) and is not open;
    one still open after the stretch waits for the block that follows.
    """
    stretch = [*GROUP, "stretch"]
    rows = rows.select(*GROUP, F.expr(f"block div {width}").alias("stretch"), "block", "first_index", "start_ts_us", "end_ts_us", "up", *LATER)
    rows = rows.repartition(*stretch).sortWithinPartitions(*stretch, "block", "first_index")

    def run(batches):
        schema, out = None, [[] for _ in range(11)]
        key, block, held, later = None, None, ([], [], [], []), None

        def close(last: bool):
            """Fates of the block held; flows still open inside the stretch stay held."""
            nonlocal held
            index, start, end, up = held
            found = _swept(index, start, end, up, key[1] == key[2], later)
            kept = [] if last else sorted(j for j, _, o in found if o)
            done = [f for f in found if last or not f[2]]
            n = len(done)
            first = [j for j, _, _ in done]
            for into, new in zip(out, [
                    *([k] * n for k in (*key[:4], block)), [index[j] for j in first], [index[i] if i >= 0 else None for _, i, _ in done],
                    [start[j] for j in first], [end[j] for j in first], [up[j] for j in first], [o for _, _, o in done]], strict=True):
                into.extend(new)
            held = tuple([v[j] for j in kept] for v in held)

        def full():
            batch = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)
            for v in out:
                v.clear()
            return batch

        for batch in batches:
            if schema is None:
                schema = pa.schema([pa.field(n, batch.schema.field(n).type) for n in BLOCK] + [
                    pa.field("first_index", pa.int64()), pa.field("partner", pa.int64()), pa.field("start_ts_us", pa.int64()),
                    pa.field("end_ts_us", pa.int64()), pa.field("up", pa.bool_()), pa.field("open", pa.bool_())])
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:6] != (*(key or ()), block):
                    if key is not None:
                        close(row[:5] != key)
                        if len(out[0]) >= BLOCK_FLOWS:
                            yield full()
                    key, block, later = row[:5], row[5], row[10:]
                for into, value in zip(held, row[6:10], strict=True):
                    into.append(value)
        if key is not None:
            close(True)
            yield full()

    return rows.mapInArrow(run, FATE)


def _blocks(f: DataFrame, block_flows: int, numbered: int) -> tuple[DataFrame, bool]:
    """``f`` narrow, with its block (so many flows of a group in arrival order) and what later blocks of the group span; whether there are later ones."""
    rows = f.select(*GROUP, "first_index", "start_ts_us", "end_ts_us", (F.col("src") == F.col("lo")).alias("up"))
    if f.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_flows).isEmpty():  # every group is one block
        return rows.select("*", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("long").alias(c) for c in LATER]), False
    rows = ordered.numbered(rows, GROUP, ["first_index"], F.expr(f"first_index div {numbered}"), "place")
    rows = materialise(rows.withColumn("block", F.expr(f"(place - 1) div {block_flows}")).drop("place"))
    spans = rows.groupBy(*BLOCK).agg(*[
        fn(F.when(F.col("up") == way, F.col(f"{edge}_ts_us"))).alias(f"{name}_{to}")
        for way, name in ((True, "up"), (False, "down")) for fn, edge, to in ((F.min, "start", "from"), (F.max, "end", "to"))])
    after = Window.partitionBy(*GROUP).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*BLOCK, *[(F.min if c.endswith("from") else F.max)(c).over(after).alias(c) for c in LATER])
    return materialise(rows.join(spans, BLOCK)), True


def _arrivals(fates: DataFrame) -> DataFrame:
    """Open flows as the next block's first rows, with a digest of what each block gets."""
    return fates.filter("open").select(*GROUP, (F.col("block") + 1).alias("block"), "first_index", "start_ts_us", "end_ts_us", "up")


def _digest(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy(*BLOCK).agg(F.sum(F.xxhash64("first_index").cast("decimal(38,0)")).alias("digest"))


def _match(f: DataFrame, block_flows: int = BLOCK_FLOWS, numbered: int = NUMBERED) -> DataFrame:
    """GROUP, first_index, partner of the flows ``f``, matched one to one in arrival order.

    First every block is swept as if nothing were open before it. Then blocks whose
    open flows from the block before are not those they were swept with are swept again,
    and what follows them in their stretch with them, until none is left. Stretches widen
    from round to round up to ``STRETCH_FLOWS``, so a change that runs through all blocks
    takes rounds by the logarithm of their number, and one a stretch of that size. As flows
    that overlap nothing to come are not handed on, two or three rounds usually do. A task
    holds one block at a time and the flows handed to it. A repeated sweep is the same
    sweep, so a lost executor costs its tasks only.
    """
    rows, several = _blocks(f, block_flows, numbered)
    names = [*GROUP, "first_index", "partner"]
    if not several:
        return _sweep(rows).select(*names)
    fates, used, width = materialise(_sweep(rows)), None, 1
    # Only groups of several blocks hand anything on; the others are done.
    given = materialise(_arrivals(fates))
    if given.isEmpty():
        return fates.select(*names)
    while True:
        now = _digest(given)
        stale = now if used is None else now.withColumnRenamed("digest", "new").join(used, BLOCK, "full").filter(
            ~F.col("new").eqNullSafe(F.col("digest")))
        if width * WIDEN * block_flows <= STRETCH_FLOWS:
            width *= WIDEN
        # Flows are handed to blocks swept first in a task only, so what a stretch is swept again from is one of those.
        stretch = F.expr(f"block div {width}").alias("stretch")
        again_from = materialise(stale.groupBy(*GROUP, stretch).agg(F.min("block").alias("since")))
        if again_from.isEmpty():
            return fates.filter("NOT open").select(*names)

        def part(df: DataFrame, how: str, test: str) -> DataFrame:
            on = [*GROUP, "stretch"]
            other = again_from.select(*[F.col(c).alias(f"_{c}") for c in on], "since")
            same = F.expr(" AND ".join(f"{c} = _{c}" for c in on) + f" AND {test}")
            return df.withColumn("stretch", stretch).join(other, same, how).drop("stretch")

        mine = part(rows, "left_semi", "block >= since")
        spans = mine.select(*BLOCK, *LATER).distinct()
        handed = part(given, "left_semi", "block = since").join(spans, BLOCK)
        again = _sweep(mine.unionByName(handed), width)
        known = part(now, "left_semi", "block = since")
        used = materialise(known if used is None else part(used, "left_anti", "block >= since").unionByName(known))
        fates = materialise(part(fates, "left_anti", "block >= since").unionByName(again))
        given = materialise(_arrivals(fates))


def pair_flows(flows: DataFrame, block_flows: int = BLOCK_FLOWS, numbered: int = NUMBERED) -> DataFrame:
    """Match each flow with the first later overlapping flow of the reverse direction.

    Works on flow summaries only, which are written once to the checkpoint folder: they
    are a small fraction of the packets and are read several times. An endpoint pair
    of any number of flows is swept in blocks of ``block_flows`` (see ``_match``). The
    earlier flow of a pair becomes ``fwd``; flows without a partner keep a null ``rev``.
    """
    return _pair(materialise(_with_ends(flows)), block_flows, numbered)


def _with_ends(flows: DataFrame) -> DataFrame:
    return flows.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))


def _pair(f: DataFrame, block_flows: int = BLOCK_FLOWS, numbered: int = NUMBERED) -> DataFrame:
    found = _match(f, block_flows, numbered)
    both = F.filter(F.array(F.col("first_index"), F.col("partner")), lambda x: x.isNotNull())
    place = found.select(*GROUP, F.col("first_index").alias("pair_id"), F.explode(both).alias("first_index"))
    first = F.col("first_index") == F.col("pair_id")
    matched = f.join(place, [*GROUP, "first_index"]).groupBy("capture_id", "pair_id", "proto").agg(
        F.max(F.when(first, _flow_struct())).alias("fwd"), F.max(F.when(~first, _flow_struct())).alias("rev"))
    return matched.select("capture_id", "pair_id", "proto", "fwd", "rev", F.col("rev").isNotNull().alias("paired"))


def pair_and_tag(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, tagged packets) of one packet table."""
    pairs = _pair(materialise(_with_ends(summarise_flows(packets))))
    return pairs, tag_packets(packets, pairs)


def tag_packets(packets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Packets of both directions with their pair's id, anchor and direction.

    The flow sides are written once, so the planner knows their size: small ones are
    broadcast, others joined by a shuffle in which AQE splits hot flows.
    """
    rows = packets.filter(scalars.is_flow_packet(F.col("proto"), F.col("spi")))
    return rows.join(materialise(_sides(pairs)), FLOW_KEYS)


def _sides(pairs: DataFrame) -> DataFrame:
    """One row per directed flow of each pair."""
    first = F.least("fwd.start_ts_us", "rev.start_ts_us")
    last = F.greatest("fwd.end_ts_us", "rev.end_ts_us")
    ends = ["src", "dst", "spi"]
    forward = F.struct(F.lit(True).alias("up"), *[F.col(f"fwd.{c}").alias(c) for c in ends])
    reverse = F.struct(F.lit(False).alias("up"), *[F.col(f"rev.{c}").alias(c) for c in ends])
    both = F.filter(F.array(forward, F.when(F.col("paired"), reverse)), lambda s: s.isNotNull())
    return pairs.select(
        "capture_id", "pair_id", "proto", "paired", first.alias("first_us"), last.alias("last_us"),
        F.explode(both).alias("s"),
    ).select("capture_id", "s.src", "s.dst", "s.spi", "proto", "pair_id", "paired", "first_us", "last_us", "s.up")


def sa_rollup(pairs: DataFrame) -> DataFrame:
    """First/last seen, packets and bytes of each association."""
    def both(name: str) -> Column:
        return F.col(f"fwd.{name}") + F.coalesce(F.col(f"rev.{name}"), F.lit(0))

    return pairs.select(
        "capture_id", "pair_id", "proto", "paired",
        scalars.spi_hex(F.col("fwd.spi")).alias("spi_initiator"),
        scalars.spi_hex(F.col("rev.spi")).alias("spi_responder"),
        F.col("fwd.src").alias("src"), F.col("fwd.dst").alias("dst"),
        F.col("fwd.ip_version").alias("ip_version"),
        F.least("fwd.start_ts_us", "rev.start_ts_us").alias("first_us"),
        F.greatest("fwd.end_ts_us", "rev.end_ts_us").alias("last_us"),
        both("packets").alias("packet_count"),
        both("bytes").alias("byte_count"),
        (F.col("fwd.udp_encapsulated") | F.coalesce(F.col("rev.udp_encapsulated"), F.lit(False)))
        .alias("udp_encapsulated"),
        F.col("fwd.start_ts_us").alias("fwd_start_us"),
    )


def directional_counts(flows: DataFrame) -> DataFrame:
    """Directed flows per capture and protocol."""
    return flows.groupBy("capture_id").agg(
        F.count_if(F.col("proto") == "esp").alias("esp_sa_count"),
        F.count_if(F.col("proto") == "ah").alias("ah_sa_count"),
    )


def spi_series(flows: DataFrame, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Successive SPIs per directed endpoint pair with the gap to the one before."""
    s = ordered.lagged(
        flows.select("capture_id", "src", "dst", "spi", "start_ts_us", "first_index"),
        ["capture_id", "src", "dst"], ["start_ts_us", "first_index"],
        F.expr(f"start_ts_us div {bucket_us}"), ["start_ts_us"],
    )
    gap = F.bround((F.col("start_ts_us") - F.col("prev_start_ts_us")) / 1e6, 0).cast("bigint")
    return s.select("capture_id", "src", "dst", "spi", "start_ts_us", "first_index",
                    gap.alias("gap_s"))
