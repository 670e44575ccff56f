"""DuckDB SQL for the rows of those operators that it can express."""

from __future__ import annotations

from evenkeel.llm.rules import RULES, STOP_WORDS, SYMBOLS


def quality_rules(table: str = "documents") -> str:
    stop = ", ".join(f"'{x}'" for x in sorted({x for s in STOP_WORDS.values() for x in s.split()}))
    metric = {
        "n_words": "n_words",
        "repeat_ratio": "n_repeat_words / n",
        "mean_word_chars": "word_chars / n",
        "symbol_ratio": "n_symbols / n",
        "stop_ratio": "n_stop / n",
        "capital_ratio": "n_capitals / greatest(word_chars, 1)",
        "duplicate_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    }
    bad = " OR ".join(f"{metric[r.metric]} {op} {v}" for r in RULES for op, v in (("<", r.low), (">", r.high)) if abs(v) != float("inf"))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, i + j AS at FROM r, (SELECT unnest([0, 1, 2]) AS j)) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(array_to_string(w, ''), '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
        length(regexp_replace(array_to_string(w, ''), '[^A-Z]+', '', 'g')) AS n_capitals, len(ln) AS n_lines, greatest(len(w), 1)::DOUBLE AS n
      FROM w LEFT JOIN p USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT ({bad}) AS kept FROM m
"""


def mix_sources(table: str = "documents", seed: int = 7, tries: int = 32) -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM {table}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(2.0::DOUBLE * source_size) OVER q AS caps, sum(w) OVER q AS ws, row_number() OVER q AS k,
        sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM s WINDOW q AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * total - (caps - cap)) / (all_w - (ws - w)) AS level FROM o),
b AS (SELECT arg_min(level, k) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, CASE WHEN b.level * w > cap THEN cap ELSE b.level * w END AS target FROM o, b),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
u AS (SELECT d.*, source_size, target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part, ('0x' || substr(h, 1, 8))::BIGINT AS a, ('0x' || substr(h, 9, 8))::BIGINT AS z
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
x AS (SELECT source, k, abs(any_value(whole) * any_value(source_size) + sum(CASE WHEN ((a + k * z) % 4294967296) / 4294967296.0::DOUBLE < part THEN size ELSE 0 END) - any_value(target)) AS off
      FROM u, (SELECT unnest(range({tries})) AS k) GROUP BY source, k),
c AS (SELECT source, arg_min(k, (off, k)) AS k FROM x GROUP BY source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN ((a + k * z) % 4294967296) / 4294967296.0::DOUBLE < part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source
"""


def conversation_repair(table: str = "conversations") -> str:
    """Edits by a shortest path, turn by turn: every way to end in a role is kept with the least (cost, audit)."""
    return r"""
WITH RECURSIVE
c AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM TABLE),
d AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 AS h FROM k, c),
e AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM d, (SELECT unnest([1, 2]) AS nth) WHERE h <> 0 AND (nth = 1 OR h = 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM e),
o AS (SELECT *, role[1:1] AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), again) AS place,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM r),
f AS MATERIALIZED (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
v AS (SELECT * FROM (VALUES ('', 's', []::VARCHAR[]), ('', 'u', []), ('', 'a', ['user:']), ('s', 'u', []), ('s', 'a', ['user:']), ('u', 'a', []), ('u', 'u', ['assistant:']), ('a', 'u', []), ('a', 'a', ['user:'])) x(was, now, added)),
p AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS place, '' AS last, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM f
  UNION ALL
  SELECT conv_id, place, last, x.cost, x.audit, x.said FROM (
    SELECT p.conv_id, f.place, w.last, min({'cost': p.cost + w.cost, 'audit': p.audit || w.edits, 'said': p.said || w.said}) AS x
    FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.place = p.place + 1,
      LATERAL (SELECT p.last AS last, 4 AS cost, 'D' AS edits, []::VARCHAR[] AS said
        UNION ALL SELECT now, 3 * len(added) + CASE WHEN f.initial = now THEN 0 ELSE 3 END + CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END,
          repeat('I', len(added)) || CASE WHEN f.initial = now THEN 'K' ELSE 'R' END,
          added || [CASE WHEN f.initial = now THEN f.role WHEN now = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text]
        FROM v WHERE was = p.last AND f.fault IN ('', 'truncated') AND (now <> 's' OR f.initial = 's')) w
    GROUP BY p.conv_id, f.place, w.last)),
q AS (SELECT p.conv_id, min({'cost': cost + 3 * CASE last WHEN 's' THEN 2 WHEN 'u' THEN 1 ELSE 0 END, 'audit': audit || CASE last WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
        'said': said || CASE last WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE [] END}) AS x
      FROM p JOIN g ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.place = g.n GROUP BY p.conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(x.cost, 0)::BIGINT AS cost, coalesce(x.audit, '') AS audit, sha256(coalesce(array_to_string(x.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM k) i LEFT JOIN g ON i.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN q ON i.conv_id IS NOT DISTINCT FROM q.conv_id
""".replace("TABLE", table)


def _whole(table: str, scale: int, where: str = "true") -> str:
    fine = f"len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0"
    return f"SELECT vec_id, list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)) AS x FROM {table} WHERE embedding IS NOT NULL AND {fine} AND {where}"


def exact_top_k(table: str = "embeddings", scale: int = 256, top: int = 5) -> str:
    return f"""
WITH v AS (SELECT DISTINCT * FROM ({_whole(table, scale, "vec_id IS NOT NULL")})),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {top}
"""


def centroids(table: str = "embeddings", scale: int = 64, dim: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> str:
    near = lambda c: f"SELECT i, vec_id, x, arg_min(c.cluster, (list_reduce(list_prepend(0, list_transform(list_zip(x, c.c), lambda y: (y[1] - y[2]) * (y[1] - y[2]))), lambda a, b: a + b), c.cluster)) AS cluster FROM v, {c} c GROUP BY i, vec_id, x"
    steps = ""
    for r in range(rounds):
        steps += f"""
a{r} AS MATERIALIZED ({near(f"c{r}")}),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT cluster, list(floor(s / n) ORDER BY d) AS c FROM (
  SELECT cluster, d, sum(x[d]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {dim} + 1)) AS d) GROUP BY cluster, d) GROUP BY cluster) m ON c.cluster = m.cluster),"""
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, * FROM ({_whole(table, scale, f"len(embedding) = {dim}")})),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1)::INTEGER AS cluster, x AS c FROM v QUALIFY cluster < {k}),{steps}
z AS MATERIALIZED ({near(f"c{rounds}")}),
d AS (SELECT z.vec_id, z.cluster, list_sum(list_transform(list_zip(x, c), lambda y: (y[1] - y[2]) * (y[1] - y[2])))::BIGINT AS distance, sha256(array_to_string(list_transform(c, lambda y: y::BIGINT::VARCHAR), ',')) AS centroid_sha256
      FROM z JOIN c{rounds} c ON z.cluster = c.cluster)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM d
"""
