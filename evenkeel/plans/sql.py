"""DuckDB SQL for the queries in `queries`, written independently of them."""

from __future__ import annotations

from evenkeel.sources import generated as made

PARTS = ("SELECT p_partkey AS id, p_brand = 'Brand#11' AS rare, p_size::DOUBLE AS f1, p_retailprice::DOUBLE AS f2 FROM part", "part")
OLD = "SELECT p_partkey AS id, p_size >= 45 AS rare, p_size::DOUBLE AS f1, p_retailprice::DOUBLE AS f2 FROM part"
EVENTS = ("SELECT event_id AS id, event_type = 'purchase' AS rare, value::DOUBLE AS f1, hour(ts)::DOUBLE AS f2 FROM events", "events")
TOXIC = ("SELECT l.doc_id AS id, l.toxic = 1 AS rare, d.n_chars::DOUBLE AS f1, l.quality::DOUBLE AS f2 FROM labels l JOIN documents d ON l.doc_id = d.doc_id", "labels")


def scaled(rows: str, ddof: int = 1) -> str:
    sd = "stddev_samp" if ddof else "stddev_pop"
    return f"""WITH b AS ({rows}),
s AS (SELECT avg(f1) AS m1, {sd}(f1) AS s1, avg(f2) AS m2, {sd}(f2) AS s2, min(f1) AS lo1, max(f1) AS hi1, min(f2) AS lo2, max(f2) AS hi2 FROM b),
z AS (SELECT id, rare, (f1 - m1) / s1 AS z1, (f2 - m2) / s2 AS z2 FROM b, s),
n AS (SELECT count(*) FILTER (rare) AS n_min, count(*) FILTER (NOT rare) AS n_maj FROM b)"""


def nearest(name: str, queries: str, refs: str, k: int, exclude: bool = True) -> str:
    """A CTE of (query_id, rank, neighbor_id, d2)."""
    self_ = "AND q.id <> r.id" if exclude else ""
    return f"""{name} AS (SELECT query_id, rank, neighbor_id, d2 FROM (
  SELECT query_id, neighbor_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbor_id) AS rank FROM (
    SELECT q.id AS query_id, r.id AS neighbor_id, round((q.z1 - r.z1) * (q.z1 - r.z1) + (q.z2 - r.z2) * (q.z2 - r.z2), 9) AS d2
    FROM ({queries}) q, ({refs}) r WHERE true {self_})) WHERE rank <= {k})"""


MINOR, MAJOR, ALL = ("SELECT id, z1, z2 FROM z WHERE rare", "SELECT id, z1, z2 FROM z WHERE NOT rare", "SELECT id, z1, z2 FROM z")


def allocation(ratio: float, k: int, adaptive: bool) -> str:
    """CTEs up to `a`: (id, c, n)."""
    g = f"g AS (SELECT greatest(1, floor(n_min * {ratio}::DOUBLE))::BIGINT AS g FROM n)"
    if not adaptive:
        return f"""{g},
a AS (SELECT id, g // n_min + CASE WHEN place <= g % n_min THEN 1 ELSE 0 END AS n FROM (SELECT id, row_number() OVER (ORDER BY id) AS place FROM z WHERE rare), n, g)"""
    return f"""{nearest("ka", MINOR, ALL, k)}, {g},
c AS (SELECT query_id AS id, count(*) FILTER (NOT z.rare) AS c, count(*) AS k FROM ka JOIN z ON z.id = neighbor_id GROUP BY query_id),
t AS (SELECT sum(c)::BIGINT AS t, count(*) AS rows FROM c),
e AS (SELECT id, c.c, CASE WHEN t > 0 THEN (g * c.c) // t ELSE g // rows END AS base, CASE WHEN t > 0 THEN (g * c.c) % t ELSE g % rows END AS rem FROM c, t, g),
a AS (SELECT id, c, (base + CASE WHEN row_number() OVER (ORDER BY rem DESC, id) <= g - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS n FROM e, g)"""


def synthetic(ratio: float, k: int, seed: int, adaptive: bool) -> str:
    """CTEs up to `syn`: (base_id, copy, neighbor_id, share, z1, z2)."""
    u = lambda tag: f"('0x' || substr(md5('{seed}|' || id || '|' || copy || '|{tag}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return f"""{allocation(ratio, k, adaptive)}, {nearest("km", MINOR, MINOR, k)},
kk AS (SELECT least({k}, n_min - 1) AS kk FROM n),
x AS (SELECT id, unnest(range(1, n + 1)) AS copy FROM a WHERE n > 0),
y AS (SELECT id, copy, least(floor({u("pick")} * kk), kk - 1) + 1 AS pick, {u("share")} AS share FROM x, kk),
syn AS (SELECT y.id AS base_id, copy, neighbor_id, share, f.z1 + share * (o.z1 - f.z1) AS z1, f.z2 + share * (o.z2 - f.z2) AS z2
  FROM y JOIN km ON km.query_id = y.id AND km.rank = pick JOIN z f ON f.id = y.id JOIN z o ON o.id = neighbor_id)"""


def retained(ratio: float, k: int, with_syn: bool, squared: bool = False, least: bool = False) -> str:
    """CTEs up to `r`: (id, score) of the majority rows to keep."""
    refs = MINOR if not with_syn else "SELECT id::VARCHAR AS id, z1, z2 FROM z WHERE rare UNION ALL SELECT 's' || base_id || '|' || copy, z1, z2 FROM syn"
    score = "avg(d2)" if squared else "avg(sqrt(d2))"
    total = "n_min + g" if with_syn else "n_min"
    m = f"least(n_maj, floor(({total}) * {ratio}::DOUBLE))"
    m = f"greatest(1, {m})" if least else m
    return f"""{nearest("kn", MAJOR, refs, k, exclude=False)},
sc AS (SELECT query_id AS id, round({score}, 9) AS score FROM kn GROUP BY query_id),
r AS (SELECT id, score FROM (SELECT id, score, row_number() OVER (ORDER BY score, id) AS place FROM sc) WHERE place <= (SELECT {m} FROM n{", g" if with_syn else ""}))"""


def rows(kept: str, with_syn: bool, whole: str = "12") -> str:
    """The balanced rows: originals in `kept`, then synthetic ones; columns id, f1, f2, rare."""
    out = f"SELECT id, f1, f2, rare FROM b WHERE {kept}"
    if with_syn:
        back = [f"least(greatest(round_even(z{i} * s{i} + m{i}, 0), lo{i}), hi{i})" if str(i) in whole else f"z{i} * s{i} + m{i}" for i in (1, 2)]
        out += f" UNION ALL SELECT NULL, {back[0]}, {back[1]}, true FROM syn, s"
    return out


def generated(rows: int, features: int, prevalence: float, seed: int, signals: int = 20) -> str:
    """The generated table with a rare class, from md5 digests of seed, row and column."""
    u = lambda tag: f"(('0x' || substr(md5('{seed}|' || id || '|{tag}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    z = lambda tag: f"(sqrt(-2 * ln(1 - {u(tag + 'u')})) * cos({u(tag + 'v')} * 6.283185307179586::DOUBLE))"
    wait = lambda tag: f"(-ln(1 - {u(tag)}))"
    count = lambda at, tag: "(" + " + ".join(f"({x!r}::DOUBLE <= {u(tag)})::INTEGER" for x in at) + ")"
    names = [f"f{i:03d}" for i in range(features)]

    def form(i: int, c: str) -> str:
        kind = made.KINDS[i % 4]
        if kind == "binary":
            return f"({u(c)} < {0.05 if i < signals else made.chance(c, seed)!r}::DOUBLE)::INTEGER"
        shape = made.FAMILIES[kind][0] if i < signals else made.family(kind, c, seed)
        value = {
            ("monetary", "uniform"): f"1000 + 39000 * {u(c)}",
            ("monetary", "normal"): f"abs(20000 + 15000 * {z(c)})",
            ("monetary", "lognormal"): f"exp(9.5::DOUBLE + {z(c)})",
            ("monetary", "gamma"): f"10000 * ({wait(c)} + {wait(c + 'w')})",
            ("monetary", "weibull"): f"20000 * pow({wait(c)}, 1 / 1.5::DOUBLE)",
            ("monetary", "exponential"): f"20000 * {wait(c)}",
            ("monetary", "chisq"): f"5000 * (pow({z(c)}, 2) + 2 * {wait(c)})",
            ("ratio", "uniform"): u(c),
            ("ratio", "beta"): f"list_sort([{', '.join(u(f'{c}b{j}') for j in range(6))}])[2]",
            ("ratio", "exponential"): f"{wait(c)} / 5",
            ("ratio", "folded_normal"): f"abs(0.2::DOUBLE + 0.3::DOUBLE * {z(c)})",
            ("integer", "poisson"): count(made.poisson_steps(2.0), c),
            ("integer", "geometric"): f"floor({wait(c)} / -ln(0.7::DOUBLE))",
            ("integer", "negative_binomial"): f"floor({wait(c)} / -ln(0.8::DOUBLE))",
            ("integer", "binomial"): count(made.binomial_steps(10, 0.1), c),
        }[kind, shape]
        value = {"monetary": f"least(greatest({value}, 1000), 40000)", "ratio": f"least({value}, 1)", "integer": f"({value})::INTEGER"}[kind]
        return f"CASE WHEN {u(c + 'zero')} < {made.FILLED[kind]}::DOUBLE THEN {value} ELSE 0 END"

    columns = ", ".join(f"{form(i, c)} AS {c}" for i, c in enumerate(names))
    own = [f"(({c} - avg({c}) OVER ()) / (coalesce(stddev_samp({c}) OVER (), 0) + 1e-6::DOUBLE))" for c in names[:signals]]
    signal = " + ".join(f"{a} * {b}" for a, b in zip(own[::2], own[1::2], strict=False))
    out = ", ".join(f"round({c}, 6) AS {c}" if i % 4 < 2 else c for i, c in enumerate(names))
    at = -(-rows * (1 - prevalence) // 1)
    return f"""WITH t AS (SELECT id, {columns} FROM (SELECT unnest(range({rows})) AS id)),
p AS (SELECT *, {signal} AS pure FROM t),
s AS (SELECT *, pure + 0.4::DOUBLE * stddev_samp(pure) OVER () * {z("noise")} AS signal FROM p)
SELECT id AS ID, CASE WHEN signal > (SELECT signal FROM s ORDER BY signal LIMIT 1 OFFSET {int(at) - 1}) THEN 'Yes' ELSE 'No' END AS TARGET_CLASS, {out} FROM s"""
