"""SQL building blocks shared by the twins: each view is a named CTE."""

from __future__ import annotations

from wirelens import dims

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (needs.split(), sql)


def compose(names: list[str], body: str) -> str:
    """``WITH`` the named views and everything they need, in order, then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"


def values(rows: list[tuple], columns: str) -> str:
    """A constant relation."""
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return f"'{v}'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


view("raw_packets", "", """
  SELECT user_id % 5 AS capture_id, event_id AS idx,
         (epoch_us(ts) - 1704067200000000) // 10000 AS ts_us, event_id % 2 AS dir,
         CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'other'
              WHEN event_type = 'signup' AND event_id % 20 = 3 THEN 'isakmp' ELSE 'esp' END AS proto,
         CAST(floor(value) AS BIGINT) AS v
  FROM events""")
view("shaped_packets", "raw_packets", """
  SELECT capture_id, idx, ts_us, proto,
         '10.0.' || capture_id || '.' || (dir + 1) AS src, '10.0.' || capture_id || '.' || (2 - dir) AS dst,
         CASE WHEN proto = 'esp' THEN 4096 + capture_id * 64 + (ts_us // 90000000) * 2 + dir END AS spi,
         CASE WHEN proto <> 'esp' THEN NULL
              WHEN capture_id = 0 THEN 28 + 16 * (1 + v % 60) WHEN capture_id = 1 THEN 24 + 4 * (1 + v % 200)
              WHEN capture_id = 2 THEN 120 + 16 * (v % 2) WHEN capture_id = 3 THEN 20 + 8 * (1 + v % 100)
              ELSE 32 + 16 * (1 + v % 60) END AS esp_len,
         CASE WHEN proto = 'isakmp' THEN idx % 3 END AS ike_message_id
  FROM raw_packets""")
view("packets", "shaped_packets", """
  SELECT capture_id, idx, ts_us, 4 AS ip_version, proto, src, dst, spi,
         CASE WHEN proto = 'esp' THEN row_number() OVER (PARTITION BY capture_id, spi ORDER BY ts_us, idx)
              - CASE WHEN idx % 97 = 0 THEN 1 ELSE 0 END END AS seq,
         coalesce(esp_len + 8, 100) AS ip_payload_len, esp_len,
         CASE WHEN capture_id = 4 THEN least(96, coalesce(esp_len + 42, 134)) ELSE coalesce(esp_len + 42, 134) END AS captured_len,
         coalesce(esp_len + 42, 134) AS orig_len, (proto = 'esp' AND capture_id = 1) AS udp_encapsulated, ike_message_id
  FROM shaped_packets""")
view("flows", "packets", """
  SELECT capture_id, src, dst, spi, proto, min(idx) AS first_index, min(ts_us) AS start_ts_us, max(ts_us) AS end_ts_us,
         count(*) AS packets, CAST(sum(ip_payload_len) AS BIGINT) AS bytes, bool_or(udp_encapsulated) AS udp_encapsulated
  FROM packets WHERE proto IN ('esp', 'ah') AND spi IS NOT NULL GROUP BY ALL""")
# One flow per direction and generation, generations disjoint in time: the only
# candidate partner of a flow is the other direction of its generation.
view("pairs", "flows", """
  SELECT f.capture_id, f.first_index AS pair_id, f.proto, f.src, f.dst, f.spi AS fwd_spi, r.spi AS rev_spi,
         f.start_ts_us AS fwd_start_us, r.spi IS NOT NULL AS paired,
         least(f.start_ts_us, coalesce(r.start_ts_us, f.start_ts_us)) AS first_us,
         greatest(f.end_ts_us, coalesce(r.end_ts_us, f.end_ts_us)) AS last_us,
         f.packets + coalesce(r.packets, 0) AS packet_count, f.bytes + coalesce(r.bytes, 0) AS byte_count,
         f.udp_encapsulated OR coalesce(r.udp_encapsulated, FALSE) AS udp_encapsulated
  FROM flows f LEFT JOIN flows r ON r.capture_id = f.capture_id AND r.spi // 2 = f.spi // 2 AND r.spi <> f.spi
       AND r.proto = f.proto AND r.start_ts_us <= f.end_ts_us AND f.start_ts_us <= r.end_ts_us
  WHERE r.first_index IS NULL OR f.first_index < r.first_index""")
view("tagged", "packets pairs", """
  SELECT p.*, q.pair_id, q.paired, q.first_us, q.last_us, (p.spi = q.fwd_spi) AS up
  FROM packets p JOIN pairs q ON q.capture_id = p.capture_id AND q.proto = p.proto AND (p.spi = q.fwd_spi OR p.spi = q.rev_spi)""")
view("windowed", "tagged", """
  SELECT capture_id, pair_id, paired, first_us, k, ts_us, idx, coalesce(esp_len, 0) AS len, up, first_us + k * 5000000 AS start_us
  FROM tagged, LATERAL (SELECT unnest(range(
       CASE WHEN ts_us - first_us >= 10000000 THEN (ts_us - first_us - 10000000) // 5000000 + 1 ELSE 0 END,
       (ts_us - first_us) // 5000000 + 1)) AS k)""")
view("window_counts", "windowed", """
  SELECT capture_id, pair_id, k, min(start_us) AS start_us, count(*) AS packets, count(*) FILTER (up) AS up_packets,
         min(start_us) + 10000000 AS end_us
  FROM windowed GROUP BY ALL HAVING count(*) FILTER (up) > 0""")
view("suites", "", values([(i, *s, s[1] + s[2]) for i, s in enumerate(dims.SUITES)],
                          "ordinal, suite, iv, icv, block, encryption, integrity, overhead"))
view("dh_sizes", "", values(list(dims.DH_PUBLIC_BYTES.items()), "dh_group, public_bytes"))
view("caps", "", values(list(dims.CATEGORY_CAPS.items()), "category, cap"))
view("classes", "", values([(i, c) for i, c in enumerate(dims.TRAFFIC_CLASSES)], "class_no, traffic_class"))


def round6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def rank_of(list_expr: str, percent: int) -> str:
    """Nearest-rank percentile of a sorted list."""
    return f"{list_expr}[((len({list_expr}) - 1) * {percent} + 50) // 100 + 1]"


def stats_sql(prefix: str, list_expr: str, scale: str = "1") -> str:
    """Ten statistics of a sorted list, zeros when empty, rounded."""
    parts = [
        f"round(coalesce(list_avg({list_expr}), 0) / {scale}, 6) AS {prefix}_mean",
        f"round(coalesce(list_aggregate({list_expr}, 'stddev_samp'), 0) / {scale}, 6) AS {prefix}_std",
        f"round(coalesce(list_min({list_expr}), 0) / {scale}, 6) AS {prefix}_min",
        f"round(coalesce(list_max({list_expr}), 0) / {scale}, 6) AS {prefix}_max",
    ]
    for p in dims.PERCENTILES:
        parts.append(f"round(coalesce({rank_of(list_expr, p)}, 0) / {scale}, 6) AS {prefix}_p{p}")
    return ", ".join(parts)


def feature_columns(source: str) -> str:
    """SELECT list of the 74 features over ``source``'s grouped lists.

    ``source`` offers lens, gaps, ups, downs (sorted lists), paired, lo, hi.
    """
    s = source
    n = f"len({s}.lens)"
    dur = f"greatest(0.000001, ({s}.hi - {s}.lo) / 1000000.0::DOUBLE)"
    modal = f"list_sort(list_transform(map_entries(list_histogram({s}.lens)), lambda e: {{'c': -e.value::BIGINT, 'v': e.key}}))[1]"
    big = f"list_filter({s}.gaps, lambda g: g > 200000)"
    mean_iat = f"coalesce(list_avg({s}.gaps), 0)"
    std_iat = f"coalesce(list_aggregate({s}.gaps, 'stddev_samp'), 0)"
    up_b, down_b = f"coalesce(list_sum({s}.ups), 0)::DOUBLE", f"coalesce(list_sum({s}.downs), 0)::DOUBLE"
    up_n, down_n = f"len({s}.ups)", f"len({s}.downs)"
    cols = [
        stats_sql("esp_len", f"{s}.lens", "1.0::DOUBLE"),
        *[f"round(len(list_filter({s}.lens, lambda x: x % 16 = {r})) / {n}::DOUBLE, 6) AS esp_len_mod16_{r}" for r in range(16)],
        f"len(list_distinct({s}.lens))::DOUBLE AS esp_len_distinct",
        f"({modal}).v::DOUBLE AS esp_len_modal",
        f"round((-({modal}).c) / {n}::DOUBLE, 6) AS esp_len_modal_share",
        f"{n}::DOUBLE AS packet_count",
        f"list_sum({s}.lens)::DOUBLE AS byte_count",
        f"round({dur}, 6) AS duration_s",
        f"round({n} / {dur}, 6) AS packets_per_s",
        f"round(list_sum({s}.lens)::DOUBLE / {dur}, 6) AS bytes_per_s",
        stats_sql("iat", f"{s}.gaps", "1000000.0::DOUBLE"),
        f"round(CASE WHEN {mean_iat} > 0 THEN ({std_iat} / 1000000.0::DOUBLE) / ({mean_iat} / 1000000.0::DOUBLE) ELSE 0 END, 6) AS iat_cv",
        f"len({big})::DOUBLE AS burst_count",
        f"round(coalesce(list_sum({big}), 0)::DOUBLE / 1000000.0::DOUBLE, 6) AS idle_total_s",
        f"round(coalesce(list_avg({big}), 0) / 1000000.0::DOUBLE, 6) AS idle_mean_s",
        f"{up_n}::DOUBLE AS up_packets", f"{down_n}::DOUBLE AS down_packets",
        f"round(CASE WHEN {down_b} <> 0 THEN {up_b} / {down_b} ELSE 0 END, 6) AS up_down_byte_ratio",
        f"round(CASE WHEN {down_n} <> 0 THEN {up_n} / {down_n}::DOUBLE ELSE 0 END, 6) AS up_down_packet_ratio",
        stats_sql("up_len", f"{s}.ups", "1.0::DOUBLE"),
        stats_sql("down_len", f"{s}.downs", "1.0::DOUBLE"),
        f"CASE WHEN {s}.paired THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS sa_spi_count",
        f"CASE WHEN {s}.paired THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sa_paired",
    ]
    return ",\n  ".join(cols)


view("gapped", "windowed", """
  SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY capture_id, pair_id, k ORDER BY ts_us, idx) AS gap_us FROM windowed""")
view("window_lists", "gapped", """
  SELECT capture_id, pair_id, k, min(start_us) AS start_us, bool_or(paired) AS paired, min(ts_us) AS lo, max(ts_us) AS hi,
         list_sort(list(len)) AS lens, list_sort(coalesce(list(gap_us) FILTER (gap_us IS NOT NULL), [])) AS gaps,
         list_sort(coalesce(list(len) FILTER (up), [])) AS ups, list_sort(coalesce(list(len) FILTER (NOT up), [])) AS downs
  FROM gapped GROUP BY ALL HAVING count(*) FILTER (up) > 0 AND count(*) >= 20""")
view("features", "window_lists", "SELECT capture_id, pair_id, k, start_us,\n  " + feature_columns("window_lists") + "\n  FROM window_lists")
