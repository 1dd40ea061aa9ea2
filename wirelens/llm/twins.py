"""SQL twins of the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from wirelens.llm.license import CUE, LICENCE_FILE, TEMPLATES, TERM, Vectors
from wirelens.llm.quality import CLASSES, COMMON, Limits

# All pairs that share a shingle are counted; groups by the smallest id reachable.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) END AS set_ FROM w),
k AS (SELECT min(doc_id) AS node, md5(array_to_string(list_sort(set_), chr(10))) AS key, len(any_value(set_)) AS n, any_value(set_) AS set_
      FROM s WHERE len(set_) > 0 GROUP BY 2),
x AS (SELECT node, n, unnest(set_) AS g FROM k),
p AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.g = b.g AND a.node < b.node
      GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT node, node AS top FROM k WHERE node IN (SELECT a FROM e) UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.set_) AS BIGINT) AS n_shingles, coalesce(c.top, k.node, s.doc_id) AS component_id,
       s.doc_id = coalesce(c.top, k.node, s.doc_id) AS kept
FROM s LEFT JOIN k ON len(s.set_) > 0 AND k.key = md5(array_to_string(list_sort(s.set_), chr(10))) LEFT JOIN c ON c.node = k.node"""

# The checksum byte by byte, with the usual table of the reflected polynomial.
BYTE_SHARDS = """
WITH t AS (SELECT list(v ORDER BY n) AS steps FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS n))),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, CAST(len(x) // 2 + 1 AS BIGINT) AS size,
             list_transform(range(0, len(x) // 2), lambda i: CAST((position(x[2 * i + 1] IN '0123456789ABCDEF') - 1) * 16 + position(x[2 * i + 2] IN '0123456789ABCDEF') - 1 AS BIGINT)) AS bytes FROM h),
d AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, v: xor(c >> 8, steps[(xor(c, v) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM d),
p AS (SELECT *, CAST(least(7, (2 * before + size) * 8 // (2 * total)) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""

# Checksums of distinct features only, byte by byte as above.
TARGET_RESAMPLING = r"""
WITH t AS (SELECT list(v ORDER BY n) AS steps FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS n))),
x AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda s: s <> '') AS ws FROM x),
f AS (SELECT side, doc_id, ws, list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS fs FROM w),
u AS (SELECT side, doc_id, unnest(fs) AS feature FROM f),
g AS (SELECT side, doc_id, feature, count(*) AS n FROM u GROUP BY ALL),
h AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM g)),
b AS (SELECT feature, list_transform(range(0, len(x) // 2), lambda i: CAST((position(x[2 * i + 1] IN '0123456789ABCDEF') - 1) * 16 + position(x[2 * i + 2] IN '0123456789ABCDEF') - 1 AS BIGINT)) AS bytes FROM h),
c AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, v: xor(c >> 8, steps[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM b, t),
k AS (SELECT side, doc_id, bucket, CAST(sum(n) AS BIGINT) AS n FROM g JOIN c USING (feature) GROUP BY ALL),
m AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM k GROUP BY bucket),
z AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM m),
p AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM m, z),
q AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS total FROM k JOIN p USING (bucket) WHERE side = 0 GROUP BY doc_id),
d AS (SELECT f.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(fs) AS BIGINT) AS n_features,
             CASE WHEN len(fs) = 0 THEN 0 ELSE CAST(floor(CAST(total AS DOUBLE) / len(fs)) AS BIGINT) END AS weight,
             CAST('0x' || substr(sha256('7:' || coalesce(CAST(f.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
      FROM f LEFT JOIN q ON q.doc_id = f.doc_id WHERE side = 0),
e AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM e WHERE n_words >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM e LEFT JOIN r USING (doc_id)"""


def quality_rules(limits: Limits = Limits()) -> str:
    """The counts, histograms, summed references and distances, by lists."""
    k = 1 + max(len(words.split()) for words in COMMON.values())
    listed = " ".join(
        f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words.split())}]" for lang, words in COMMON.items())
    known = ", ".join(repr(lang) for lang in COMMON)
    sums = lambda column, n: "[" + ", ".join(f"sum({column}[{i + 1}])" for i in range(n)) + "]"

    def distance(p: str, q: str) -> str:
        x, y = f"CAST({p}[i] AS DOUBLE) / list_sum({p})", f"CAST({q}[i] AS DOUBLE) / list_sum({q})"
        part = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
        return (f"round(sqrt(greatest(0, least(1, list_sum(list_transform(range(1, len({p}) + 1), lambda i: "
                f"({part.format(a=f'({x})', b=f'({y})')} + {part.format(a=f'({y})', b=f'({x})')}) / 2))))), 6)")

    n_classes = len(CLASSES)
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             regexp_replace(t, '[a-z\x20\x09-\x0D]+', '', 'g') AS t1, CASE lang {listed} END AS listed FROM d),
g AS (SELECT doc_id, row, unnest(range(1, len(ws) - 3)) AS i, ws FROM (SELECT *, row_number() OVER () AS row FROM w) WHERE len(ws) >= 5),
h AS (SELECT row, i, count(*) OVER (PARTITION BY row, array_to_string(list_slice(ws, i, i + 4), ' ')) AS c FROM g),
m AS (SELECT row, i - coalesce(lag(i) OVER (PARTITION BY row ORDER BY i), -9) AS gap FROM h WHERE c > 1),
r AS (SELECT row, CAST(sum(least(5, gap)) AS BIGINT) AS n FROM m GROUP BY row),
s AS (SELECT *, row_number() OVER () AS row, regexp_replace(t1, '[A-Z]+', '', 'g') AS t2 FROM w),
u AS (SELECT *, regexp_replace(t2, '\p{{L}}+', '', 'g') AS t3 FROM s),
v AS (SELECT *, regexp_replace(t3, '\p{{N}}+', '', 'g') AS t4 FROM u),
z AS (SELECT v.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t4) - length(regexp_replace(t4, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM v LEFT JOIN r USING (row)),
q AS (SELECT *, [length(t) - length(t1) - (length(t) - word_chars), length(t) - word_chars, length(t1) - length(t2), length(t2) - length(t3),
                 length(t3) - length(t4), n_symbols, length(t4) - n_symbols] AS classes,
             list_transform(listed, lambda x: len(list_filter(ws, lambda y: y = x))) AS found FROM z),
a AS (SELECT *, list_append(found, n_words - list_sum(found)) AS words, CASE WHEN lang IN ({known}) THEN lang ELSE '' END AS ref FROM q),
f AS (SELECT lang AS ref, {sums('classes', n_classes)} AS rc, {sums('words', k)} AS rw FROM a WHERE lang IN ({known}) GROUP BY lang
      UNION ALL SELECT '', {sums('classes', n_classes)}, NULL FROM a),
j AS (SELECT a.*, CASE WHEN n_words >= {limits.guard} THEN {distance('classes', 'rc')} END AS class_distance,
             CASE WHEN n_words >= {limits.guard} AND words IS NOT NULL AND rw IS NOT NULL THEN {distance('words', 'rw')} END AS word_distance,
             n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed FROM a LEFT JOIN f USING (ref))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(class_distance > {limits.classes} + {limits.noise} * sqrt({n_classes}.0 / word_chars), false)
       AND NOT coalesce(word_distance > {limits.words} + {limits.noise} * sqrt({k}.0 / n_words), false) AS kept, class_distance, word_distance FROM j"""


def license_scan(threshold: float = 0.7) -> str:
    """The derived tree, cosines by a table of template terms, and the nearest licensed ancestor."""
    vectors = Vectors.of(TEMPLATES)
    weights = ", ".join(f"({i}, '{t}', {w!r})" for i, ws in enumerate(vectors.weights) for t, w in ws.items())
    idf = ", ".join(f"('{t}', {x!r})" for t, x in sorted(vectors.idf.items()))
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(vectors.names))
    return rf"""
WITH weight(i, term, w) AS (VALUES {weights}), idf(term, x) AS (VALUES {idf}), name(i, name) AS (VALUES {names}),
f AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, CASE WHEN doc_id IS NOT NULL THEN concat_ws('/', source, 'k' || doc_id // 10000,
        'c' || doc_id // 100, CASE WHEN regexp_matches(regexp_extract(text, '^[^\n]*'), '{CUE}') THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END) END AS path
      FROM documents),
s AS (SELECT row, unnest(list_distinct(list_filter(list_concat(regexp_split_to_array(t, '\r?\n'), regexp_split_to_array(t, '\r?\n\s*\n'),
        CASE WHEN regexp_matches(path, '{LICENCE_FILE}') THEN [t] ELSE [] END), lambda p: regexp_matches(p, '{CUE}')))) AS p FROM f),
n AS (SELECT *, row_number() OVER () AS k FROM s),
e AS (SELECT row, k, unnest(list_distinct(regexp_extract_all(lower(p), '{TERM}'))) AS term FROM n),
m AS (SELECT k, sqrt(sum(pow(coalesce(x, {vectors.unseen!r}), 2))) AS norm FROM e LEFT JOIN idf USING (term) GROUP BY k),
c AS (SELECT e.row, weight.i, round(sum(x * w) / any_value(norm), 9) AS score FROM e JOIN weight USING (term) JOIN idf USING (term) JOIN m USING (k) GROUP BY e.row, e.k, weight.i),
b AS (SELECT row, i, score FROM c WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, i) = 1),
o AS (SELECT f.row, doc_id, path, name AS own, score, regexp_replace(path, '/?[^/]*$', '') AS dir, coalesce(regexp_matches(path, '{LICENCE_FILE}'), false) AS is_file
      FROM f LEFT JOIN b USING (row) LEFT JOIN name USING (i)),
g AS (SELECT dir AS above, own AS given, score AS given_score FROM o WHERE is_file AND own IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, own) = 1),
l AS (SELECT d.dir, g.* FROM (SELECT DISTINCT dir FROM o WHERE dir IS NOT NULL) d JOIN g ON d.dir = g.above OR g.above = '' OR starts_with(d.dir, g.above || '/')
      QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(g.above) DESC) = 1)
SELECT doc_id, path, coalesce(own, given) AS licence, CASE WHEN own IS NOT NULL THEN score ELSE given_score END AS score,
       CASE WHEN own IS NOT NULL AND is_file THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own IS NULL THEN above END AS from_dir FROM o LEFT JOIN l USING (dir)"""
