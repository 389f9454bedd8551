"""The named queries as plain SQL over the same tables.

The statements follow the textbook definition of each result (full matrices,
matrix inverses by the sweep operator, matrix square roots by the Newton-Schulz
iteration) rather than the route the Spark queries take.
"""

from __future__ import annotations

from kindred.plans.datasets import OFFSET, SLICE_SCALES
from kindred.plans.queries import ALGEBRAIC, ENTRYWISE, GRID, K, LMBD, NOISE, PORTABLE_SAMPLES, SAMPLED


def _with(*ctes: tuple[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in ctes) + "\n" + final


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


# --- matrix algebra in SQL -----------------------------------------------------


def _sweep(source: str, keys: str, dim: int, name: str) -> list[tuple[str, str]]:
    """CTEs for ``<name>(keys, i, j, v, ld)``: inverse and log-determinant of ``source``."""
    steps, last = [], f"(SELECT {keys}, i, j, v, 0.0::DOUBLE AS ld FROM {source})"
    for k in range(dim):
        body = f"""SELECT {keys}, i, j, ld + coalesce(ln(abs(p)), 0) AS ld,
          CASE WHEN p IS NULL THEN v WHEN i = {k} AND j = {k} THEN -1 / p
               WHEN i = {k} OR j = {k} THEN v / p ELSE v - r * c / p END AS v
          FROM (SELECT *, max(CASE WHEN i = {k} AND j = {k} THEN v END) OVER (PARTITION BY {keys}) AS p,
                  max(CASE WHEN j = {k} THEN v END) OVER (PARTITION BY {keys}, i) AS r,
                  max(CASE WHEN i = {k} THEN v END) OVER (PARTITION BY {keys}, j) AS c FROM {last})"""
        steps.append((f"{name}_{k}", body))
        last = f"{name}_{k}"
    steps.append((name, f"SELECT {keys}, i, j, -v AS v, ld FROM {last}"))
    return steps


def _matmul(x: str, y: str, keys: str = "a, b") -> str:
    xs = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    on = " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))
    return f"SELECT {xs}, x.i, y.j, sum(x.v * y.v) AS v FROM {x} x JOIN {y} y ON {on} AND x.j = y.i GROUP BY ALL"


def _root_trace(source: str, name: str, steps: int = 24) -> list[tuple[str, str]]:
    """CTEs for ``<name>(a, b, rt)``: trace of the square root of ``source (a, b, i, j, v)``."""
    out = [
        (f"{name}_c", f"SELECT a, b, sum(v) FILTER (WHERE i = j) AS c FROM {source} GROUP BY a, b"),
        (f"{name}_y0", f"SELECT a, b, i, j, v / c AS v FROM {source} JOIN {name}_c USING (a, b)"),
        (f"{name}_z0", f"SELECT a, b, i, j, (i = j)::INT::DOUBLE AS v FROM {source}"),
    ]
    for s in range(steps):
        y, z, t = f"{name}_y{s}", f"{name}_z{s}", f"{name}_t{s}"
        out.append((t, f"SELECT a, b, i, j, ((i = j)::INT * 3 - v) / 2 AS v FROM ({_matmul(z, y)})"))
        out.append((f"{name}_y{s + 1}", _matmul(y, t)))
        out.append((f"{name}_z{s + 1}", _matmul(t, z)))
    total = f"SELECT a, b, sum(v) FILTER (WHERE i = j) AS s FROM {name}_y{steps} GROUP BY a, b"
    out.append((name, f"SELECT a, b, s * sqrt(c) AS rt FROM ({total}) JOIN {name}_c USING (a, b)"))
    return out


# --- embedding layers ----------------------------------------------------------

_EMB = [
    ("e", "SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings"),
    (
        "acts",
        "SELECT 'slice_' || lpad((pos // 8)::VARCHAR, 2, '0') AS layer, vec_id AS stim, (pos % 8)::INTEGER AS feat, v FROM e",
    ),
]
_PAR = [
    ("num", "SELECT count(*)::DOUBLE AS n, count(*) * 0.01 / (1 + count(*) * 0.01) AS nu FROM embeddings"),
    ("par", "SELECT layer, sum(v * v) AS tr, any_value(n) AS n, any_value(nu) AS nu, (1 - any_value(nu)) * any_value(n) / sum(v * v) AS al FROM acts, num GROUP BY layer"),
]
_CROSS = [
    ("mu", "SELECT layer, feat, avg(v) AS m FROM acts GROUP BY ALL"),
    (
        "g",
        "SELECT x.layer AS a, y.layer AS b, x.feat AS i, y.feat AS j, sum(x.v * y.v) AS v "
        "FROM acts x JOIN acts y ON x.stim = y.stim GROUP BY ALL",
    ),
    (
        "gc",
        "SELECT a, b, i, j, v - n * p.m * q.m AS v FROM g JOIN mu p ON p.layer = a AND p.feat = i "
        "JOIN mu q ON q.layer = b AND q.feat = j, num",
    ),
    ("pairs", "SELECT x.layer AS a, y.layer AS b, x.al AS a1, y.al AS a2, x.n, x.nu FROM par x JOIN par y ON x.layer < y.layer"),
]


def _stacked(source: str, dim: int = 8) -> str:
    """The Gram, of twice the features' number, of the features of both layers of each pair."""
    return f"""SELECT p.a, p.b, i + CASE WHEN s.a = p.b THEN {dim} ELSE 0 END AS i, j + CASE WHEN s.b = p.b THEN {dim} ELSE 0 END AS j,
        v, a1, a2, nu, n FROM pairs p JOIN {source} s ON s.a IN (p.a, p.b) AND s.b IN (p.a, p.b)"""


def _algebraic_layers(measure: str, head: list | None = None, dim: int = 8) -> str:
    head = head or [*_EMB, *_PAR, *_CROSS]
    if measure == "kldiv":
        inv = [
            ("core", "SELECT a AS layer, i, j, v + CASE WHEN i = j THEN nu / al ELSE 0 END AS v FROM g JOIN par ON layer = a WHERE a = b"),
            *_sweep("core", "layer", dim, "w"),
            ("cc", "SELECT x.a, x.b, x.j AS i, y.j AS j, sum(x.v * y.v) AS v FROM g x JOIN g y USING (a, b, i) WHERE a <> b GROUP BY ALL"),
            ("wb", "SELECT layer, sum(w.v * g.v) AS v FROM w JOIN g ON g.a = layer AND g.b = layer AND g.i = w.i AND g.j = w.j GROUP BY layer"),
            ("t", """SELECT cc.a, cc.b, any_value(((1 - nu) * n + nu * n - nu * wb.v) / nu) - any_value(al) / any_value(nu) * sum(cc.v * w.v) AS t
                FROM cc JOIN w ON w.layer = cc.b AND w.i = cc.i AND w.j = cc.j JOIN par ON par.layer = cc.a JOIN wb ON wb.layer = cc.b GROUP BY cc.a, cc.b"""),
        ]
        final = f"""SELECT 'kldiv' AS measure, p.a, p.b, {_r('0.25 * (x.t + y.t) - n / 2', 'value')}
            FROM pairs p JOIN t x ON x.a = p.a AND x.b = p.b JOIN t y ON y.a = p.b AND y.b = p.a"""
        return _with(*head, *inv, final=final)
    if measure in ("bhattacharyya", "hellinger"):
        dets = [
            ("one", "SELECT a AS layer, i, j, (i = j)::INT + al / nu * v AS v FROM g JOIN par ON layer = a WHERE a = b"),
            *_sweep("one", "layer", dim, "d"),
            ("z", _stacked("g", dim)),
            ("two", f"SELECT a, b, i, j, (i = j)::INT + sqrt((CASE WHEN i < {dim} THEN a1 ELSE a2 END) * (CASE WHEN j < {dim} THEN a1 ELSE a2 END)) / (2 * nu) * v AS v FROM z"),
            *_sweep("two", "a, b", 2 * dim, "m"),
            ("l1", "SELECT DISTINCT layer, ld FROM d WHERE i = 0 AND j = 0"),
            ("db", "SELECT m.a, m.b, 0.5 * (m.ld - 0.5 * (x.ld + y.ld)) AS db FROM m JOIN l1 x ON x.layer = m.a JOIN l1 y ON y.layer = m.b WHERE i = 0 AND j = 0"),
        ]
        value = "db" if measure == "bhattacharyya" else "sqrt(1 - exp(-db))"
        return _with(*head, *dets, final=f"SELECT '{measure}' AS measure, a, b, {_r(value, 'value')} FROM db")
    if measure == "gulp":
        inv = [
            ("core", f"SELECT a AS layer, i, j, v + CASE WHEN i = j THEN (nu + {LMBD}) / al ELSE 0 END AS v FROM g JOIN par ON layer = a WHERE a = b"),
            *_sweep("core", "layer", 8, "w"),
            ("wg", "SELECT g.a, g.b, w.i, g.j, sum(w.v * g.v) AS v FROM w JOIN g ON g.a = w.layer AND g.i = w.j GROUP BY ALL"),
            ("dots", "SELECT x.a, x.b, sum(x.v * y.v) AS d FROM wg x JOIN wg y ON y.a = x.b AND y.b = x.a AND y.i = x.j AND y.j = x.i GROUP BY ALL"),
        ]
        value = f"{LMBD} / (nu + {LMBD}) * sqrt(x.d + y.d - 2 * c.d)"
        final = f"""SELECT 'gulp' AS measure, p.a, p.b, {_r(value, 'value')} FROM pairs p
            JOIN dots x ON x.a = p.a AND x.b = p.a JOIN dots y ON y.a = p.b AND y.b = p.b JOIN dots c ON c.a = p.a AND c.b = p.b"""
        return _with(*head, *inv, final=final)
    source = "g" if measure == "wasserstein" else "gc"
    dims = "n - 16" if measure == "wasserstein" else "n - 17"
    root = [
        ("z", _stacked(source)),
        ("f1", "SELECT a, b, i, j, CASE WHEN i < 8 THEN a1 * v ELSE 0 END + CASE WHEN i = j THEN nu ELSE 0 END AS v FROM z"),
        ("f2", "SELECT a, b, i, j, CASE WHEN i < 8 THEN 0 ELSE a2 * v END + CASE WHEN i = j THEN nu ELSE 0 END AS v FROM z"),
        ("prod", _matmul("f1", "f2")),
        *_root_trace("prod", "rt"),
        ("ctr", f"SELECT a AS layer, sum(v) AS t FROM {source} WHERE a = b AND i = j GROUP BY a"),
        ("res", f"""SELECT p.a, p.b, n, rt + ({dims}) * nu AS rt, a1 * x.t + nu * ({dims} + 16) AS t1, a2 * y.t + nu * ({dims} + 16) AS t2
            FROM pairs p JOIN rt USING (a, b) JOIN ctr x ON x.layer = p.a JOIN ctr y ON y.layer = p.b"""),
    ]
    value = "n * rt / sqrt(t1 * t2)" if measure == "nbs" else "sqrt(greatest(t1 + t2 - 2 * rt, 0))"
    return _with(*head, *root, final=f"SELECT '{measure}' AS measure, a, b, {_r(value, 'value')} FROM res")


#: customers as stimuli, 35 years and priorities as features: matrices of many stimuli and low rank
_CUSTOMERS = [
    ("raw", "SELECT o_orderstatus AS layer, o_custkey AS stim, year(o_orderdate) || o_orderpriority AS f, count(*)::DOUBLE AS v FROM orders GROUP BY ALL"),
    ("feats", "SELECT f, (row_number() OVER (ORDER BY f) - 1)::INTEGER AS feat FROM (SELECT DISTINCT f FROM raw)"),
    ("acts", "SELECT layer, stim, feat, v FROM raw JOIN feats USING (f)"),
    ("num", "SELECT count(DISTINCT stim)::DOUBLE AS n, count(DISTINCT stim) * 0.01 / (1 + count(DISTINCT stim) * 0.01) AS nu FROM acts"),
    ("par", "SELECT layer, sum(v * v) AS tr, any_value(n) AS n, any_value(nu) AS nu, (1 - any_value(nu)) * any_value(n) / sum(v * v) AS al FROM acts, num GROUP BY layer"),
    ("met", "SELECT x.layer AS a, y.layer AS b, x.feat AS i, y.feat AS j, sum(x.v * y.v) AS v FROM acts x JOIN acts y ON x.stim = y.stim GROUP BY ALL"),
    ("g", """SELECT p.layer AS a, q.layer AS b, x.feat AS i, y.feat AS j, coalesce(met.v, 0) AS v FROM par p, par q, feats x, feats y
        LEFT JOIN met ON met.a = p.layer AND met.b = q.layer AND met.i = x.feat AND met.j = y.feat"""),
    ("pairs", "SELECT x.layer AS a, y.layer AS b, x.al AS a1, y.al AS a2, x.n, x.nu FROM par x JOIN par y ON x.layer < y.layer"),
]


def _coordinates(measure: str) -> str:
    """Rank-one matrices have closed forms in n, the noise and the angle between the coordinates."""
    ctes = [
        _EMB[0],
        ("acts", "SELECT 'coord_' || lpad(pos::VARCHAR, 2, '0') AS layer, vec_id AS stim, v FROM e"),
        ("num", _PAR[0][1]),
        ("s", "SELECT layer, sum(v * v) AS q, avg(v) AS m FROM acts GROUP BY layer"),
        ("x", "SELECT x.layer AS a, y.layer AS b, sum(x.v * y.v) AS d FROM acts x JOIN acts y ON x.stim = y.stim AND x.layer < y.layer GROUP BY ALL"),
        ("p", """SELECT a, b, n, nu, (1 - nu) * n AS t, d * d / (s1.q * s2.q) AS c2,
            (1 - nu) * n * (s1.q - n * s1.m * s1.m) / s1.q AS t1, (1 - nu) * n * (s2.q - n * s2.m * s2.m) / s2.q AS t2,
            (d - n * s1.m * s2.m) ** 2 / ((s1.q - n * s1.m * s1.m) * (s2.q - n * s2.m * s2.m)) AS k2
            FROM x JOIN s s1 ON s1.layer = a JOIN s s2 ON s2.layer = b, num"""),
        ("r", """SELECT *, (n - 2) * nu + sqrt(n * nu * nu + 2 * nu * t + t * t * c2 - (n - 2) * nu * nu + 2 * nu * (nu + t)) AS rt,
            (n - 3) * nu + sqrt((n - 1) * nu * nu + nu * (t1 + t2) + t1 * t2 * k2 - (n - 3) * nu * nu
              + 2 * sqrt(nu * (nu + t1) * nu * (nu + t2))) AS rc,
            0.5 * (ln((1 + t / (2 * nu)) ** 2 - (t / (2 * nu)) ** 2 * c2) - ln(1 + t / nu)) AS db FROM p"""),
    ]
    both = "t1 + nu * (n - 1)", "t2 + nu * (n - 1)"
    value = {
        "kldiv": "0.5 * t * t * (1 - c2) / (nu * (nu + t))",
        "bhattacharyya": "db",
        "hellinger": "sqrt(1 - exp(-db))",
        "wasserstein": "sqrt(2 * n - 2 * rt)",
        "gulp": f"((t + nu) / (t + nu + {LMBD}) - nu / (nu + {LMBD})) * sqrt(2 * (1 - c2))",
        "procrustes": f"sqrt({both[0]} + {both[1]} - 2 * rc)",
        "nbs": f"n * rc / sqrt(({both[0]}) * ({both[1]}))",
    }[measure]
    return _with(*ctes, final=f"SELECT '{measure}' AS measure, a, b, {_r(value, 'value')} FROM r")


def _sampled_coordinates(measure: str) -> str:
    """Two relative eigenvalues differ from one, l and 1 / l; the draws repeat those of the portable generator."""
    head = _coordinates("kldiv")
    inner = head[: head.rindex("SELECT 'kldiv'")]

    def uniform(start: int) -> str:
        return f"(('0x' || substr(h, {start}, 8))::BIGINT + 0.5) / 4294967296.0"

    ctes = [
        ("k", "SELECT a, b, t * t * (1 - c2) / (nu * (nu + t)) AS k FROM r"),
        ("l", "SELECT a, b, 1 + k / 2 - sqrt(k + k * k / 4) AS lo, 1 + k / 2 + sqrt(k + k * k / 4) AS hi FROM k"),
        ("h", f"""SELECT a, b, lo, hi, c, d, x, md5('11:' || a || ':' || b || ':' || c || ':' || d || ':' || x) AS h FROM l,
            (SELECT unnest(range(2)) AS c), (SELECT unnest(range({PORTABLE_SAMPLES})) AS d), (SELECT unnest(range(2)) AS x)"""),
        ("z", f"""SELECT a, b, c, d, CASE WHEN x = 0 THEN lo ELSE hi END AS l, (-2 * ln({uniform(1)})) * cos(2 * pi() * {uniform(9)}) ** 2 AS zz FROM h"""),
        ("lr", "SELECT a, b, c, d, 0.5 * sum(zz * CASE WHEN c = 0 THEN l - 1 ELSE 1 - 1 / l END) AS lr FROM z GROUP BY ALL"),
    ]
    value = {
        "tvd": "0.5 * sum(greatest(1 - exp(CASE WHEN c = 0 THEN -lr ELSE lr END), 0)) / {n}",
        "jsd": "greatest(1 - sum(ln(1 + exp(CASE WHEN c = 0 THEN -lr ELSE lr END))) / {n} / (2 * ln(2)), 0)",
    }[measure].format(n=PORTABLE_SAMPLES)
    rest = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in ctes)
    return f"{inner.rstrip()},\n{rest}\nSELECT '{measure}' AS measure, a, b, {_r(value, 'value')} FROM lr GROUP BY a, b"


#: step of the trapezoidal rule and number of steps; t is the frequency at node x, w the weight of the integrand
_RULES = {
    "tvd": (0.05, 760, "(exp(x) - exp(-x)) / 4", "2 / pi() * 2 / (exp(x) + exp(-x))"),
    "jsd": (0.05, 260, "x", "1 / (2 * ln(2)) * 2 / (exp(pi() * x) + exp(-pi() * x)) / (x * x + 0.25)"),
}


def _nodes(measure: str) -> tuple[str, str]:
    step, count, t, w = _RULES[measure]
    return "node", f"SELECT k AS node, {t} AS t, {step} * ({w}) * CASE WHEN k = 0 THEN 0.5 ELSE 1 END AS w FROM (SELECT k, k * {step} AS x FROM range({count}) AS _(k))"


def _complex_log_det(source: str, dim: int) -> str:
    """(a, b, node, lr, li): logarithm of the determinant of complex matrices ``source (a, b, node, re, im)`` by elimination.

    Their real parts are positive definite, so all pivots have positive real parts.
    """
    row, column = f"((x // {dim}) * {dim} + k + 1)", f"(k * {dim} + x % {dim} + 1)"
    below = f"x // {dim} > k AND x % {dim} > k"
    real = f"(re[{row}] * re[{column}] - im[{row}] * im[{column}])"
    imag = f"(re[{row}] * im[{column}] + im[{row}] * re[{column}])"
    return f"""SELECT a, b, node, lr, li FROM (
        WITH RECURSIVE step(a, b, node, k, re, im, lr, li) AS (
          SELECT a, b, node, 0, re, im, 0.0::DOUBLE, 0.0::DOUBLE FROM {source}
          UNION ALL
          SELECT a, b, node, k + 1,
            list_transform(range({dim * dim}), lambda x: CASE WHEN {below} THEN re[x + 1] - ({real} * pr + {imag} * pi) / q ELSE 0 END),
            list_transform(range({dim * dim}), lambda x: CASE WHEN {below} THEN im[x + 1] - ({imag} * pr - {real} * pi) / q ELSE 0 END),
            lr + 0.5 * ln(q), li + atan2(pi, pr)
          FROM (SELECT *, pr * pr + pi * pi AS q FROM (SELECT *, re[k * {dim + 1} + 1] AS pr, im[k * {dim + 1} + 1] AS pi FROM step WHERE k < {dim})))
        SELECT * FROM step WHERE k = {dim})"""


def _overlap_sql(measure: str, exponent: str = "zr", phase: str = "zi") -> str:
    """The measure from ``z (a, b, zr, zi, w)``, the logarithm of the integral of p^u q^(1-u) at the nodes."""
    return f"SELECT '{measure}' AS measure, a, b, {_r(f'sum(w * (1 - exp({exponent}) * cos({phase})))', 'value')} FROM z GROUP BY a, b"


def _exact_layers(measure: str) -> str:
    """With a factor 1 - u for one layer and u for the other, the determinant is that of noise / factor + Gram of all 16 features."""
    ctes = [
        *_EMB, *_PAR, *_CROSS, _nodes(measure),
        ("core", "SELECT a AS layer, i, j, v + CASE WHEN i = j THEN nu / al ELSE 0 END AS v FROM g JOIN par ON layer = a WHERE a = b"),
        *_sweep("core", "layer", 8, "d"),
        ("one", "SELECT DISTINCT layer, 8 * ln(nu) + 8 * ln(al) + ld AS ld FROM d JOIN par USING (layer) WHERE i = 0 AND j = 0"),
        ("st", _stacked("g")),
        ("m", """SELECT a, b, any_value(nu) AS nu, list(sqrt((CASE WHEN i < 8 THEN a1 ELSE a2 END) * (CASE WHEN j < 8 THEN a1 ELSE a2 END)) * v ORDER BY i, j) AS g
            FROM st GROUP BY a, b"""),
        ("src", """SELECT a, b, node,
            list_transform(range(256), lambda x: g[x + 1] + CASE WHEN x // 16 = x % 16 THEN nu * 0.5 / (0.25 + t * t) ELSE 0 END) AS re,
            list_transform(range(256), lambda x: CASE WHEN x // 16 <> x % 16 THEN 0.0 WHEN x // 16 < 8 THEN nu * t / (0.25 + t * t) ELSE -nu * t / (0.25 + t * t) END) AS im
            FROM m, node"""),
        ("ld", _complex_log_det("src", 16)),
        ("z", """SELECT ld.a, ld.b, w, 0.25 * (x.ld + y.ld) - 0.5 * (8 * ln(0.25 + t * t) + lr) AS zr, 0.5 * t * (y.ld - x.ld) - 0.5 * li AS zi
            FROM ld JOIN node USING (node) JOIN one x ON x.layer = ld.a JOIN one y ON y.layer = ld.b"""),
    ]
    return _with(*ctes, final=_overlap_sql(measure))


def _exact_sales(measure: str) -> str:
    ctes = [
        *_SALES, _COND, _nodes(measure),
        *_sweep("k", "layer", 25, "s"),
        ("one", "SELECT DISTINCT layer, ld FROM s WHERE i = 0 AND j = 0"),
        ("m", "SELECT x.layer AS a, y.layer AS b, list(x.v ORDER BY i, j) AS p, list(y.v ORDER BY i, j) AS q FROM k x JOIN k y USING (i, j) WHERE x.layer < y.layer GROUP BY ALL"),
        ("src", """SELECT a, b, node, list_transform(range(625), lambda x: (p[x + 1] + q[x + 1]) / 2) AS re,
            list_transform(range(625), lambda x: t * (q[x + 1] - p[x + 1])) AS im FROM m, node"""),
        ("ld", _complex_log_det("src", 25)),
        ("z", """SELECT ld.a, ld.b, w, 0.25 * (x.ld + y.ld) - 0.5 * lr AS zr, 0.5 * t * (y.ld - x.ld) - 0.5 * li AS zi
            FROM ld JOIN node USING (node) JOIN one x ON x.layer = ld.a JOIN one y ON y.layer = ld.b"""),
    ]
    return _with(*ctes, final=_overlap_sql(measure))


def _exact_coordinates(measure: str) -> str:
    """Two relative eigenvalues differ from one, l and 1 / l, so logarithms of determinants cancel."""
    head = _coordinates("kldiv")
    inner = head[: head.rindex("SELECT 'kldiv'")]
    ctes = [
        ("k", "SELECT a, b, t * t * (1 - c2) / (nu * (nu + t)) AS k FROM r"),
        ("l", "SELECT a, b, 1 + k / 2 - sqrt(k + k * k / 4) AS l FROM k"),
        _nodes(measure),
        # the product of both factors ln(u / l + 1 - u) and ln(u l + 1 - u) has no imaginary part
        ("z", "SELECT a, b, w, -0.5 * ln(((1 + l) / 2) ** 2 / l + (t * (1 - l)) ** 2 / l) AS zr, 0.0 AS zi FROM l, node"),
    ]
    rest = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in ctes)
    return f"{inner.rstrip()},\n{rest}\n{_overlap_sql(measure)}"


def _agreement(measure: str) -> str:
    """Exact values; whether estimates lie near them is expected to be true."""
    parts = [f"SELECT '{source}' AS source, measure, a, b, value, true AS agrees FROM ({sql})" for source, sql in (("layers", _exact_layers(measure)), ("sales", _exact_sales(measure)))]
    return " UNION ALL ".join(parts)


_EMB_CELLS = [
    ("num", _PAR[0][1]),
    ("lay", "SELECT unnest(range(8)) AS l"),
    (
        "vec",
        "SELECT vec_id AS stim, 'slice_' || lpad(l::VARCHAR, 2, '0') AS layer, embedding[(l * 8 + 1):(l * 8 + 8)]::DOUBLE[] AS x FROM embeddings, lay",
    ),
    ("nrm", "SELECT stim, layer, x, list_dot_product(x, x) AS q FROM vec"),
    ("al", "SELECT layer, (1 - any_value(nu)) * any_value(n) / sum(q) AS al FROM nrm, num GROUP BY layer"),
    (
        "k",
        "SELECT layer, x.stim AS i, y.stim AS j, al * list_dot_product(x.x, y.x) + CASE WHEN x.stim = y.stim THEN nu ELSE 0 END AS v "
        "FROM nrm x JOIN nrm y USING (layer) JOIN al USING (layer), num",
    ),
]


def _rank_sql(rows: str) -> list[tuple[str, str]]:
    return [
        ("rk", f"SELECT layer, i, j, rank() OVER (PARTITION BY layer ORDER BY d) + (count(*) OVER (PARTITION BY layer, d) - 1) / 2.0 AS r FROM {rows}"),
        ("res", """SELECT x.layer AS a, y.layer AS b, count(*)::DOUBLE AS m, sum((x.r - cnt) * (y.r - cnt)) AS s FROM rk x JOIN rk y USING (i, j),
            (SELECT (count(*) + 1) / 2.0 AS cnt FROM rk WHERE layer = (SELECT min(layer) FROM rk)) WHERE x.layer < y.layer GROUP BY ALL"""),
    ]


def _entrywise(measure: str, cells: list[tuple[str, str]], k: int) -> str:
    """From a table ``k (layer, i, j, v)`` of conditioned matrices."""
    ctes = list(cells)
    if measure in ("cka", "distcorr"):
        ctes += [
            ("c", """SELECT layer, i, j, v - avg(v) OVER (PARTITION BY layer, i) - avg(v) OVER (PARTITION BY layer, j)
                + avg(v) OVER (PARTITION BY layer) AS v FROM k"""),
            ("nm", "SELECT layer, sum(v * v) AS q FROM c GROUP BY layer"),
            ("res", """SELECT x.layer AS a, y.layer AS b, sum(x.v * y.v) / sqrt(any_value(p.q)) / sqrt(any_value(q.q)) AS r
                FROM c x JOIN c y USING (i, j) JOIN nm p ON p.layer = x.layer JOIN nm q ON q.layer = y.layer WHERE x.layer < y.layer GROUP BY ALL"""),
        ]
        value = "r" if measure == "cka" else "sqrt(r)"
    elif measure == "jaccard":
        ctes += [
            ("dg", "SELECT layer, i, v FROM k WHERE i = j"),
            ("nb", f"""SELECT layer, i, list(j) AS s FROM (SELECT k.layer, k.i, k.j, row_number() OVER (PARTITION BY k.layer, k.i
                ORDER BY round(k.v / sqrt(p.v * q.v), 12) DESC, k.j) AS rn FROM k JOIN dg p ON p.layer = k.layer AND p.i = k.i
                JOIN dg q ON q.layer = k.layer AND q.i = k.j WHERE k.i <> k.j) WHERE rn <= {k} GROUP BY ALL"""),
            ("res", """SELECT x.layer AS a, y.layer AS b, avg(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE) AS r
                FROM nb x JOIN nb y USING (i) WHERE x.layer < y.layer GROUP BY ALL"""),
        ]
        value = "r"
    else:
        ctes += [
            ("dg", "SELECT layer, i, v FROM k WHERE i = j"),
            ("d", """SELECT k.layer, k.i, k.j, round(p.v + q.v - 2 * k.v, 12) AS d FROM k JOIN dg p ON p.layer = k.layer AND p.i = k.i
                JOIN dg q ON q.layer = k.layer AND q.i = k.j WHERE k.i < k.j"""),
        ]
        if measure == "rsarank":
            ctes += _rank_sql("d")
            value = "12 * s / (m ** 3 - m)"
        else:
            agg = "corr(x.d, y.d)" if measure == "rsacorr" else "sum(x.d * y.d) / sqrt(sum(x.d * x.d)) / sqrt(sum(y.d * y.d))"
            ctes.append(("res", f"SELECT x.layer AS a, y.layer AS b, {agg} AS r FROM d x JOIN d y USING (i, j) WHERE x.layer < y.layer GROUP BY ALL"))
            value = "acos(r)" if measure == "rsaarccos" else "r"
    return _with(*ctes, final=f"SELECT '{measure}' AS measure, a, b, {_r(value, 'value')} FROM res")


# --- sales layers --------------------------------------------------------------

_SALES = [
    ("idx", "SELECT s_nationkey AS stim, (row_number() OVER (ORDER BY s_nationkey) - 1)::INTEGER AS i FROM (SELECT DISTINCT s_nationkey FROM supplier)"),
    ("sa", """SELECT l_returnflag || l_linestatus AS layer, i, l_partkey AS feat, sum(l_quantity) AS v
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN idx ON stim = s_nationkey GROUP BY ALL"""),
    ("grid", "SELECT layer, x.i, y.i AS j FROM (SELECT DISTINCT layer FROM sa), idx x, idx y"),
    ("g", """SELECT layer, grid.i, grid.j, coalesce(v, 0)::DOUBLE AS v FROM grid LEFT JOIN (SELECT x.layer, x.i, y.i AS j, sum(x.v * y.v) AS v
        FROM sa x JOIN sa y ON x.layer = y.layer AND x.feat = y.feat GROUP BY ALL) USING (layer, i, j)"""),
    ("fact", "SELECT layer, count(*)::DOUBLE AS n, sum(v) AS tr, count(*) * 0.01 / (1 + count(*) * 0.01) AS nu FROM g WHERE i = j GROUP BY layer"),
]
_TN = ("tn", "SELECT layer, i, j, v * n / tr AS v FROM g JOIN fact USING (layer)")
_COND = ("k", "SELECT layer, i, j, (1 - nu) * v * n / tr + CASE WHEN i = j THEN nu ELSE 0 END AS v FROM g JOIN fact USING (layer)")
_IDEAL = ("g2", """SELECT 'ideal' AS layer, x.i, y.i AS j, (p.n_regionkey = q.n_regionkey)::INT::DOUBLE AS v FROM idx x JOIN nation p ON p.n_nationkey = x.stim,
    idx y JOIN nation q ON q.n_nationkey = y.stim""")  # fmt: skip


def _cells(source: str, value: str, *ctes, where: str = "") -> str:
    return _with(*_SALES, *ctes, final=f"SELECT layer, i, j, {_r(value, 'v')} FROM {source} {where}")


def _kl_sql(pairs: str) -> list[tuple[str, str]]:
    """``t (a, b, t)``: trace of inverse(b) times a, over ordered pairs of ``k``."""
    return [
        *_sweep("k", "layer", 25, "w"),
        ("t", f"SELECT x.layer AS a, w.layer AS b, sum(x.v * w.v) AS t FROM k x JOIN w USING (i, j) WHERE {pairs} GROUP BY ALL"),
    ]


def _algebraic_sales(measure: str) -> str:
    head = [*_SALES, _COND]
    dim = "(SELECT max(n) FROM fact)"
    if measure == "kldiv":
        final = f"""SELECT 'kldiv' AS measure, x.a, x.b, {_r(f'0.25 * (x.t + y.t) - {dim} / 2', 'value')}
            FROM t x JOIN t y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b"""
        return _with(*head, *_kl_sql("x.layer <> w.layer"), final=final)
    if measure in ("bhattacharyya", "hellinger"):
        ctes = [
            ("mid", "SELECT x.layer AS a, y.layer AS b, i, j, (x.v + y.v) / 2 AS v FROM k x JOIN k y USING (i, j) WHERE x.layer < y.layer"),
            *_sweep("mid", "a, b", 25, "m"),
            *_sweep("k", "layer", 25, "w"),
            ("db", """SELECT a, b, 0.5 * (m.ld - 0.5 * (x.ld + y.ld)) AS db FROM m JOIN w x ON x.layer = a AND x.i = 0 AND x.j = 0
                JOIN w y ON y.layer = b AND y.i = 0 AND y.j = 0 WHERE m.i = 0 AND m.j = 0"""),
        ]
        value = "db" if measure == "bhattacharyya" else "sqrt(1 - exp(-db))"
        return _with(*head, *ctes, final=f"SELECT '{measure}' AS measure, a, b, {_r(value, 'value')} FROM db")
    if measure == "gulp":
        ctes = [
            ("reg", f"SELECT layer, i, j, v + CASE WHEN i = j THEN {LMBD} ELSE 0 END AS v FROM k"),
            *_sweep("reg", "layer", 25, "w"),
            ("p", "SELECT w.layer, w.i, k.j, sum(w.v * k.v) AS v FROM w JOIN k ON k.layer = w.layer AND k.i = w.j GROUP BY ALL"),
        ]
        value = "sqrt(sum((x.v - y.v) ** 2))"
        final = f"SELECT 'gulp' AS measure, x.layer AS a, y.layer AS b, {_r(value, 'value')} FROM p x JOIN p y USING (i, j) WHERE x.layer < y.layer GROUP BY ALL"
        return _with(*head, *ctes, final=final)
    centre = """SELECT layer, i, j, v - avg(v) OVER (PARTITION BY layer, i) - avg(v) OVER (PARTITION BY layer, j)
        + avg(v) OVER (PARTITION BY layer) AS v FROM k"""
    ctes = [
        ("c", "SELECT * FROM k" if measure == "wasserstein" else centre),
        ("prod", """SELECT x.layer AS a, y.layer AS b, x.i, y.j, sum(x.v * y.v) AS v FROM c x JOIN c y ON x.j = y.i AND x.layer < y.layer GROUP BY ALL"""),
        *_root_trace("prod", "rt"),
        ("t", "SELECT layer, sum(v) AS t FROM c WHERE i = j GROUP BY layer"),
        ("res", "SELECT a, b, rt, x.t AS t1, y.t AS t2 FROM rt JOIN t x ON x.layer = a JOIN t y ON y.layer = b"),
    ]
    value = f"{dim} * rt / sqrt(t1 * t2)" if measure == "nbs" else "sqrt(greatest(t1 + t2 - 2 * rt, 0))"
    return _with(*head, *ctes, final=f"SELECT '{measure}' AS measure, a, b, {_r(value, 'value')} FROM res")


# --- trials --------------------------------------------------------------------

_STATS = [
    ("tr", "SELECT user_id AS voxel, event_type AS stim, event_id AS trial, value AS v FROM events"),
    ("st", "SELECT voxel, stim, count(*) AS n, avg(v) AS mean, var_pop(v) * count(*) AS ss FROM tr GROUP BY ALL"),
    ("rel", """SELECT voxel, n, mean, noise_var, total_var FROM (SELECT voxel, sum(ss) / (sum(n) - count(*)) AS noise_var FROM st GROUP BY voxel)
        JOIN (SELECT voxel, count(*) AS n, avg(v) AS mean, var_samp(v) AS total_var FROM tr GROUP BY voxel) USING (voxel)"""),
]
_RUNS = [
    _STATS[0],
    ("fl", "SELECT *, CASE WHEN stim <> lag(stim) OVER (PARTITION BY voxel ORDER BY trial) THEN 1 ELSE 0 END AS f FROM tr"),
    ("ru", "SELECT *, sum(f) OVER (PARTITION BY voxel ORDER BY trial ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM fl"),
]
_LOGS = "sum(ln(noise_var / total_var))"
_FIT = ("fit", f"SELECT CASE WHEN {_LOGS} < 0 THEN greatest(-count(*) / {_LOGS}, 1e-6) ELSE 'inf'::DOUBLE END AS a, count(*) AS n FROM rel")
_GRIDSQL = ("grid", f"SELECT g::INTEGER AS noise_id, ((2 * g + 1) / {2 * GRID}.0) ** (1 / a) AS noise_var FROM fit, (SELECT unnest(range({GRID})) AS g)")


def _candidates(features: str) -> list[tuple[str, str]]:
    """Stimulus index, trace-normalised model matrices, z-scored responses and noise per channel."""
    return [
        ("ix", "SELECT stim, (row_number() OVER (ORDER BY stim) - 1)::INTEGER AS i FROM (SELECT DISTINCT stim FROM tr)"),
        ("ma", f"SELECT layer, i, feat, sum(v) AS v FROM ({features}) JOIN ix USING (stim) GROUP BY ALL"),
        ("mg", "SELECT x.layer AS model, x.i, y.i AS j, sum(x.v * y.v) AS v FROM ma x JOIN ma y ON x.layer = y.layer AND x.feat = y.feat GROUP BY ALL"),
        ("mt", "SELECT model, sum(v) / count(*) AS s FROM mg WHERE i = j GROUP BY model"),
        ("mk", "SELECT model, i, j, v / s AS v FROM mg JOIN mt USING (model)"),
        ("z", """SELECT voxel, i, (st.mean - rel.mean) / sqrt(total_var * (rel.n - 1) / rel.n) AS y, st.n AS w FROM st JOIN rel USING (voxel) JOIN ix USING (stim)"""),
        ("zn", "SELECT voxel, noise_var / (total_var * (n - 1) / n) AS nu, n / (n - 1.0) - noise_var / (total_var * (n - 1) / n) AS sv FROM rel"),
        ("w", "SELECT i, avg(n) AS w FROM st JOIN ix USING (stim) GROUP BY i"),
    ]


_MODELS = _candidates("""SELECT 'hour' AS layer, event_type AS stim, hour(ts)::VARCHAR AS feat, 1.0::DOUBLE AS v FROM events
    UNION ALL SELECT 'weekday', event_type, dayofweek(ts)::VARCHAR, 1.0 FROM events
    UNION ALL SELECT 'key', event_type, regexp_extract(props, '([0-9]+)', 1), value FROM events""")
_DISCOUNT = [
    ("tr", "SELECT l_suppkey AS voxel, round(l_discount * 100)::INTEGER AS stim, l_extendedprice * l_discount AS v FROM lineitem"),
    *_STATS[1:],
]
_DISCOUNT_EV = [
    *_DISCOUNT,
    *_candidates("""SELECT 'rate' AS layer, round(l_discount * 100)::INTEGER AS stim, 'rate' AS feat, l_discount AS v FROM lineitem
        UNION ALL SELECT 'state', round(l_discount * 100)::INTEGER, l_returnflag || l_linestatus, 1.0 FROM lineitem
        UNION ALL SELECT 'quantity', round(l_discount * 100)::INTEGER, l_quantity::VARCHAR, l_tax FROM lineitem"""),
]
_LL = "-0.5 * (any_value(ld) + sum(p.y * c.v * q.y) + {dim} * ln(2 * pi()))"


def _shared_ll(cov: str, keys: str, dim: int = 5) -> list[tuple[str, str]]:
    """``ll (voxel, keys, ll)`` for covariances that do not depend on the channel."""
    ks = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return [
        ("cov", cov),
        *_sweep("cov", keys, dim, "c"),
        ("ll", f"SELECT p.voxel, {ks}, {_LL.format(dim=dim)} AS ll FROM c JOIN z p ON p.i = c.i JOIN z q ON q.i = c.j AND q.voxel = p.voxel GROUP BY ALL"),
    ]


def _own_ll(noise: str, join: str = "", dim: int = 5) -> list[tuple[str, str]]:
    """``ll (voxel, model, ll)`` with one covariance per channel and model."""
    return [
        ("cov", f"SELECT zn.voxel, model, mk.i, mk.j, sv * mk.v + CASE WHEN mk.i = mk.j THEN {noise} ELSE 0 END AS v FROM zn, mk {join}"),
        *_sweep("cov", "voxel, model", dim, "c"),
        ("ll", f"SELECT p.voxel, c.model, {_LL.format(dim=dim)} AS ll FROM c JOIN z p ON p.i = c.i AND p.voxel = c.voxel JOIN z q ON q.i = c.j AND q.voxel = p.voxel GROUP BY ALL"),
    ]


_SINGLE = f"SELECT model, i, j, (1 - {NOISE}) * v + CASE WHEN i = j THEN {NOISE} ELSE 0 END AS v FROM mk"
_GRIDCOV = "SELECT model, noise_id, i, j, (1 - noise_var) * v + CASE WHEN i = j THEN noise_var ELSE 0 END AS v FROM mk, grid"
_EV = [*_STATS, *_MODELS]
_ONGRID = [*_DISCOUNT_EV, _FIT, _GRIDSQL, *_shared_ll(_GRIDCOV, "model, noise_id", 11)]
_ONE = [*_EV, *_shared_ll(_SINGLE, "model")]


def _post(keys: str, source: str = "ll") -> str:
    return f"SELECT *, ll - (m + ln(sum(exp(ll - m)) OVER (PARTITION BY {keys}))) AS lp FROM (SELECT *, max(ll) OVER (PARTITION BY {keys}) AS m FROM {source})"


_MARGINAL = ("marg", "SELECT voxel, model, m + ln(sum(exp(ll - m))) AS ll FROM (SELECT *, max(ll) OVER (PARTITION BY voxel, model) AS m FROM ll) GROUP BY voxel, model, m")


def _key(column: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {column}), 1, 8))::BIGINT % 2147483648)"


def _split(table: str, column: str, label: str, seed: int) -> str:
    return f"""SELECT {column}, {label}, CASE WHEN rn <= floor(c * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS part FROM (
        SELECT {column}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {_key(column, seed)}, {column}) AS rn,
        count(*) OVER (PARTITION BY {label}) AS c FROM {table})"""


def _count(column: str, letter: str) -> str:
    return f"(length({column}) - length(replace({column}, '{letter}', '')))"


def _chars(letters: str, agg: str = "") -> str:
    return "[" + ", ".join(f"{agg}({_count('lower(text)', c)})::DOUBLE" for c in letters) + "]"


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ALGEBRAIC:
        found[f"layers_{m}"] = _algebraic_layers(m)
        found[f"coordinates_{m}"] = _coordinates(m)
        found[f"sales_{m}"] = _algebraic_sales(m)
    for m in ("kldiv", "bhattacharyya", "hellinger"):
        found[f"tiled_{m}"] = _algebraic_layers(m, _CUSTOMERS, 35)
    for m in SAMPLED:
        found[f"layers_{m}"] = _exact_layers(m)
        found[f"sales_{m}"] = _exact_sales(m)
        found[f"exact_coordinates_{m}"] = _exact_coordinates(m)
        found[f"sampled_{m}"] = _agreement(m)
    # tiles of 16 x 64 products: a tile's inner product is that of 16 factors times that of all coordinates
    found["wide_moments"] = f"""WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x, list_concat(embedding::DOUBLE[], list_transform(embedding[1:16]::DOUBLE[], lambda z: z * z)) AS u FROM embeddings),
        t AS (SELECT unnest(range(5)) AS t),
        s AS MATERIALIZED (SELECT vec_id, t, list_sum(u[(t * 16 + 1):(t * 16 + 16)]) * list_sum(x) AS s FROM v, t),
        d AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b, t, list_dot_product(p.x, q.x) * list_dot_product(p.u[(t * 16 + 1):(t * 16 + 16)], q.u[(t * 16 + 1):(t * 16 + 16)]) AS k FROM v p, v q, t),
        totals AS (SELECT x.t AS tile_i, y.t AS tile_j, sum(x.s * y.s) AS total FROM s x JOIN s y ON x.vec_id = y.vec_id AND x.t <= y.t GROUP BY ALL),
        squares AS (SELECT x.t AS tile_i, y.t AS tile_j, sum(x.k * y.k) AS squares FROM d x JOIN d y ON x.a = y.a AND x.b = y.b AND x.t <= y.t GROUP BY ALL)
        SELECT tile_i::INTEGER AS tile_i, tile_j::INTEGER AS tile_j, {_r('total', 'total', 3)}, {_r('squares', 'squares', 3)} FROM totals JOIN squares USING (tile_i, tile_j)"""
    for m in ENTRYWISE:
        found[f"layers_{m}"] = _entrywise(m, _EMB_CELLS, K)
        found[f"sales_{m}"] = _entrywise(m, [*_SALES, _COND], 3)
    # names in the order of the ids change nothing
    found |= {f"named_{m}": found[f"layers_{m}"] for m in ("jaccard", "rsarank")}
    factor = "CASE pos // 8 " + " ".join(f"WHEN {k} THEN {v!r}" for k, v in SLICE_SCALES.items()) + " ELSE 1 END"
    for m in ("kldiv", "wasserstein"):
        found[f"scaled_{m}"] = _algebraic_layers(m).replace("(pos % 8)::INTEGER AS feat, v FROM e", f"(pos % 8)::INTEGER AS feat, v * {factor} AS v FROM e")
    scaled = f"list_transform(embedding[(l * 8 + 1):(l * 8 + 8)]::DOUBLE[], lambda z: z * {factor.replace('pos // 8', 'l')}) AS x"
    found["scaled_cka"] = _entrywise("cka", _EMB_CELLS, K).replace("embedding[(l * 8 + 1):(l * 8 + 8)]::DOUBLE[] AS x", scaled)
    # distances straight from the differences of features
    correlated = "SELECT x.layer AS a, y.layer AS b, corr(x.d, y.d) AS r FROM d x JOIN d y USING (i, j) WHERE x.layer < y.layer GROUP BY ALL"
    final = f"SELECT 'rsacorr' AS measure, a, b, {_r('r', 'value')} FROM res"
    apart = "SELECT x.layer, x.stim AS i, y.stim AS j, list_distance(x.x, y.x) ** 2 AS d FROM vec x JOIN vec y ON x.layer = y.layer AND x.stim < y.stim"
    moved = _EMB_CELLS[2][1].replace("::DOUBLE[] AS x", f"::DOUBLE[].list_transform(lambda z: z + {OFFSET!r}) AS x")
    found["offset_rsacorr"] = _with(_EMB_CELLS[1], ("vec", moved), ("d", apart), ("res", correlated), final=final)
    # the squared distance of two outer products from inner products
    products = "list_dot_product(x.p, x.p) ** 2 + list_dot_product(y.p, y.p) ** 2 - 2 * list_dot_product(x.p, y.p) ** 2"
    found["wide_rsacorr"] = _with(
        ("vec", "SELECT vec_id AS stim, embedding[1:55]::DOUBLE[] AS p, embedding[56:64]::DOUBLE[] AS r FROM embeddings"),
        ("d", f"""SELECT 'products' AS layer, x.stim AS i, y.stim AS j, {products} AS d FROM vec x JOIN vec y ON x.stim < y.stim
            UNION ALL SELECT 'rest', x.stim, y.stim, list_distance(x.r, y.r) ** 2 FROM vec x JOIN vec y ON x.stim < y.stim"""),
        ("res", correlated), final=final,
    )
    found["gram_orders"] = f"""WITH a AS (SELECT l_returnflag AS layer, l_orderkey AS stim, l_partkey AS feat, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
        idx AS (SELECT stim, row_number() OVER (ORDER BY stim) - 1 AS i FROM (SELECT DISTINCT stim FROM a)),
        t AS (SELECT layer, feat, i, v FROM a JOIN idx USING (stim)),
        g AS (SELECT x.layer, x.i, y.i AS j, sum(x.v * y.v) AS v FROM t x JOIN t y ON x.layer = y.layer AND x.feat = y.feat AND x.i <= y.i GROUP BY ALL)
        SELECT layer, (i // 1024)::INTEGER AS tile_i, (j // 1024)::INTEGER AS tile_j, count(*) AS n, {_r('sum(v)', 'total', 3)},
          {_r('sum(v * v)', 'squares', 3)} FROM g WHERE v <> 0 GROUP BY ALL"""
    means = ("mu", "SELECT layer, i, avg(v) / 100 AS m FROM sa GROUP BY ALL")
    delta = ("de", "SELECT x.layer AS a, y.layer AS b, i, x.m - y.m AS d FROM mu x JOIN mu y USING (i) WHERE x.layer < y.layer")
    quad = "SELECT p.a, p.b, sum(p.d * w.v * q.d) AS q FROM de p JOIN de q ON p.a = q.a AND p.b = q.b JOIN w ON {} AND w.i = p.i AND w.j = q.i GROUP BY ALL"
    found["sales_kldiv_means"] = _with(
        *_SALES, _COND, means, delta, *_kl_sql("x.layer <> w.layer"), ("q1", quad.format("w.layer = p.a")), ("q2", quad.format("w.layer = p.b")),
        final=f"""SELECT 'kldiv' AS measure, x.a, x.b, {_r('0.25 * (x.t + y.t + q1.q + q2.q) - (SELECT max(n) FROM fact) / 2', 'value')}
            FROM t x JOIN t y ON y.a = x.b AND y.b = x.a JOIN q1 ON q1.a = x.a AND q1.b = x.b JOIN q2 ON q2.a = x.a AND q2.b = x.b WHERE x.a < x.b""",
    )
    found["sales_mahalanobis_means"] = _with(
        *_SALES, _COND, means, delta,
        ("mid", "SELECT x.layer AS a, y.layer AS b, i, j, (x.v + y.v) / 2 AS v FROM k x JOIN k y USING (i, j) WHERE x.layer < y.layer"),
        *_sweep("mid", "a, b", 25, "w"), ("q", quad.format("w.a = p.a AND w.b = p.b")),
        final=f"SELECT 'mahalanobis' AS measure, a, b, {_r('sqrt(q)', 'value')} FROM q",
    )
    found["layers_mahalanobis"] = _with(
        *_EMB, ("l", "SELECT DISTINCT layer FROM acts"),
        final="SELECT 'mahalanobis' AS measure, x.layer AS a, y.layer AS b, 0.0::DOUBLE AS value FROM l x JOIN l y ON x.layer < y.layer",
    )
    found["sales_mahalanobis"] = _with(
        *_SALES, ("l", "SELECT DISTINCT layer FROM g"),
        final="SELECT 'mahalanobis' AS measure, x.layer AS a, y.layer AS b, 0.0::DOUBLE AS value FROM l x JOIN l y ON x.layer < y.layer",
    )

    found["acts_long"] = _with(*_EMB, final="SELECT layer, stim, feat, v FROM acts")
    found["layer_catalog"] = _with(*_EMB, final="SELECT layer, count(DISTINCT stim) AS n_stim, count(DISTINCT feat)::INTEGER AS n_feat FROM acts GROUP BY layer")
    found["document_catalog"] = "SELECT layer, count(*) AS n_stim, w AS n_feat FROM documents, (VALUES ('vowels', 5), ('size', 2), ('length', 1)) t(layer, w) GROUP BY ALL"
    found["activation_rows"] = f"""SELECT 'vowels' AS layer, doc_id AS stim, list_sum({_chars('aeiou')}) AS total FROM documents
        UNION ALL SELECT 'length', doc_id, n_chars::DOUBLE FROM documents"""
    found["stored_activations"] = f"""SELECT 'vowels' AS layer, count(*) AS n_stim, round(sum(list_sum({_chars('aeiou')})), 3) AS total FROM documents
        UNION ALL SELECT 'size', count(*), round(sum(length(text) + len(string_split(text, ' '))), 3)::DOUBLE FROM documents"""
    found["activation_coverage"] = """SELECT layer, n AS n_rows, n AS n_stim, n = (SELECT count(*) FROM documents) AS complete FROM (
        SELECT layer, count(*) AS n FROM documents, (VALUES ('vowels'), ('size'), ('length')) t(layer) GROUP BY layer
        UNION ALL SELECT 'labels', count(*) FROM labels)"""
    found["turns_between"] = """SELECT conv_id, turn FROM (SELECT *, lag(role) OVER w AS p, lead(role) OVER w AS q FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE contains(role, 'assist') AND contains(p, 'user') AND contains(q, 'user')"""
    found["gram_sales"] = _cells("g", "v")
    found["gram_centroids"] = _with(
        _EMB[0],
        ("ix", "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS i FROM (SELECT DISTINCT label FROM embeddings)"),
        ("c", "SELECT pos, i, avg(v) AS v FROM e JOIN embeddings USING (vec_id) JOIN ix USING (label) GROUP BY ALL"),
        final=f"""SELECT 'slice_' || lpad((x.pos // 8)::VARCHAR, 2, '0') AS layer, x.i, y.i AS j, {_r('sum(x.v * y.v)', 'v', 8)}
            FROM c x JOIN c y ON x.pos = y.pos GROUP BY ALL""",
    )
    found["gram_stored"] = _with(
        ("t", f"SELECT (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS i, {_chars('aeiou', 'sum')} AS vo, {_chars('xyz', 'sum')} AS ra FROM documents GROUP BY lang"),
        final="""SELECT 'vowels' AS layer, x.i, y.i AS j, list_dot_product(x.vo, y.vo) AS v FROM t x, t y
            UNION ALL SELECT 'rare', x.i, y.i, list_dot_product(x.ra, y.ra) FROM t x, t y""",
    )
    found["gram_validate"] = _with(
        *_SALES, _TN,
        final=f"""SELECT layer, max(i) + 1 AS dim, count(*) = (max(i) + 1) * (max(i) + 1) AS square, {_r('sum(v) FILTER (WHERE i = j)', 'trace')},
            bool_and(abs(v - tv) <= 1e-8 + 1e-5 * abs(tv)) AS symmetric, abs(sum(v) FILTER (WHERE i = j) - (max(i) + 1)) < 1e-4 AS normalized
            FROM (SELECT p.*, q.v AS tv FROM tn p JOIN tn q ON q.layer = p.layer AND q.i = p.j AND q.j = p.i) GROUP BY layer""",
    )
    found["gram_agreement"] = _with(*_SALES, final="SELECT DISTINCT layer, true AS agrees FROM g")
    found["trace_norm"] = _cells("tn", "v", _TN)
    found["condition_norm_only"] = found["trace_norm"]
    found["condition_raw"] = found["gram_sales"]
    found["add_noise"] = _cells("tn", f"CASE WHEN i = j THEN {NOISE} ELSE 0 END", _TN)
    wt = ("wt", "SELECT i, count(*)::DOUBLE AS w FROM supplier JOIN idx ON stim = s_nationkey GROUP BY i")
    found["add_noise_weighted"] = _with(
        *_SALES, _TN, wt,
        final=f"SELECT layer, i, j, {_r(f'(1 - {NOISE}) * v + CASE WHEN i = j THEN {NOISE} / w ELSE 0 END', 'v')} FROM tn JOIN wt USING (i)",
    )
    found["condition_b"] = _cells("k", "v", _COND)
    nu5 = "(n * 0.05 / (1 + n * 0.05))"
    found["condition_noise_only"] = _cells("g JOIN fact USING (layer)", f"(1 - {nu5}) * v + CASE WHEN i = j THEN {nu5} ELSE 0 END")
    found["condition_noise_var"] = _cells("tn", f"(1 - {NOISE}) * v + CASE WHEN i = j THEN {NOISE} ELSE 0 END", _TN)
    found["double_center"] = _cells(
        "tn", "v - avg(v) OVER (PARTITION BY layer, i) - avg(v) OVER (PARTITION BY layer, j) + avg(v) OVER (PARTITION BY layer)", _TN
    )
    diag = ("dg", "SELECT layer, i, v AS d FROM tn WHERE i = j")
    found["rdm_sqeuclid"] = _with(
        *_SALES, _TN, diag,
        final=f"""SELECT t.layer, t.i, t.j, {_r('p.d + q.d - 2 * t.v', 'v')} FROM tn t JOIN dg p ON p.layer = t.layer AND p.i = t.i
            JOIN dg q ON q.layer = t.layer AND q.i = t.j""",
    )
    kdiag = ("dg", "SELECT layer, i, v AS d FROM k WHERE i = j")
    found["cos_sim"] = _with(
        *_SALES, _COND, kdiag,
        final=f"""SELECT t.layer, t.i, t.j, {_r('CASE WHEN t.i = t.j THEN 1 ELSE t.v / sqrt(p.d * q.d) END', 'v')} FROM k t
            JOIN dg p ON p.layer = t.layer AND p.i = t.i JOIN dg q ON q.layer = t.layer AND q.i = t.j""",
    )
    span = "OVER (PARTITION BY layer)"
    found["minmax_scale"] = _cells("g", f"2 * (v - min(v) {span}) / (max(v) {span} - min(v) {span}) - 1")
    found["ideal_representation"] = _with(_SALES[0], _IDEAL, final="SELECT layer, i, j, v FROM g2")
    found["neighbour_sets"] = _with(
        *_SALES, _COND, kdiag,
        final="""SELECT layer, i, string_agg(j, ',' ORDER BY rn) AS neighbours FROM (SELECT t.layer, t.i, t.j, row_number() OVER (
            PARTITION BY t.layer, t.i ORDER BY round(t.v / sqrt(p.d * q.d), 12) DESC, t.j) AS rn FROM k t
            JOIN dg p ON p.layer = t.layer AND p.i = t.i JOIN dg q ON q.layer = t.layer AND q.i = t.j WHERE t.i <> t.j) WHERE rn <= 3 GROUP BY ALL""",
    )
    full = """SELECT measure, {cols} FROM r UNION ALL SELECT measure, b, a, {v} FROM r
        UNION ALL SELECT DISTINCT measure, x.l, x.l, {d} FROM (SELECT measure, a AS l FROM r UNION SELECT measure, b FROM r) x"""
    found["sim_to_dist"] = f"WITH r AS MATERIALIZED ({found['sales_cka']}) " + full.format(
        cols="a, b, round(1 - value, 6) + 0.0 AS value", v="round(1 - value, 6) + 0.0", d="0.0::DOUBLE"
    )
    parts = " UNION ALL ".join(f"SELECT * FROM ({found[f'layers_{m}']})" for m in ("kldiv", "cka", "rsaarccos"))
    found["dist_matrix"] = f"WITH r AS MATERIALIZED ({parts}) " + full.format(
        cols="a, b, value", v="value", d="CASE WHEN measure = 'kldiv' THEN 0.0 ELSE 1.0 END::DOUBLE"
    )
    found["matrix_products"] = _with(
        *_SALES,
        final=f"""SELECT x.layer AS a, y.layer AS b, count(*) AS n, {_r('sum(x.v * y.v)', 'sxy', 3)}, {_r('sum(x.v * x.v)', 'sxx', 3)}, {_r('sum(y.v * y.v)', 'syy', 3)}
            FROM g x JOIN g y USING (i, j) WHERE x.layer < y.layer GROUP BY ALL""",
    )
    centred = ("c", """SELECT layer, i, j, v - avg(v) OVER (PARTITION BY layer, i) - avg(v) OVER (PARTITION BY layer, j)
        + avg(v) OVER (PARTITION BY layer) AS v FROM tn""")  # fmt: skip
    found["mean_cell_product"] = _with(
        *_SALES, _TN, centred,
        final=f"SELECT x.layer AS a, y.layer AS b, {_r('avg(x.v * y.v)', 'dcov2')} FROM c x JOIN c y USING (i, j) WHERE x.layer < y.layer GROUP BY ALL",
    )
    orders = [
        ("oa", """SELECT i, o_orderpriority AS feat, count(*)::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey
            JOIN idx ON stim = c_nationkey GROUP BY ALL"""),
        ("og", """SELECT 'orders' AS layer, p.i, q.i AS j, coalesce(v, 0)::DOUBLE AS v FROM idx p CROSS JOIN idx q LEFT JOIN (
            SELECT x.i AS i, y.i AS j, sum(x.v * y.v) AS v FROM oa x JOIN oa y USING (feat) GROUP BY ALL) s ON s.i = p.i AND s.j = q.i"""),
        ("g3", "SELECT layer, i, j, v FROM g UNION ALL SELECT layer, i, j, v FROM og"),
        ("f3", "SELECT layer, count(*)::DOUBLE AS n, sum(v) AS tr, count(*) * 0.01 / (1 + count(*) * 0.01) AS nu FROM g3 WHERE i = j GROUP BY layer"),
        ("k", "SELECT layer, i, j, (1 - nu) * v * n / tr + CASE WHEN i = j THEN nu ELSE 0 END AS v FROM g3 JOIN f3 USING (layer)"),
    ]
    found["two_families"] = _entrywise("cka", [*_SALES, *orders], 3)
    ideal = [
        _IDEAL,
        ("g3", "SELECT layer, i, j, v FROM g UNION ALL SELECT layer, i, j, v FROM g2"),
        *orders[3:],
        *_kl_sql("(x.layer = 'ideal') <> (w.layer = 'ideal')"),
    ]
    value = "0.25 * (x.t + y.t) - (SELECT max(n) FROM fact) / 2"
    found["kl_to_ideal"] = _with(
        *_SALES, *ideal,
        final=f"SELECT 'kldiv' AS measure, x.a, x.b, {_r(value, 'value')} FROM t x JOIN t y ON y.a = x.b AND y.b = x.a WHERE x.b = 'ideal'",
    )
    found["measure_names"] = "SELECT lower(regexp_replace(p_name, '[ _-]+', '', 'g')) AS name, count(*) AS n FROM part GROUP BY ALL"
    gap, cosine = "((l_discount - l_tax) * 1e-6)", "(1 + (l_discount - 0.05) * 2e-6)"
    found["scalar_rules"] = f"""SELECT l_returnflag, count(*) FILTER (WHERE {gap} = 0 OR ({gap} > -1e-7 AND {gap} < 0)) AS n_zeroed,
        count(*) FILTER (WHERE {cosine} = 1 OR ({cosine} > 1 AND {cosine} - 1 <= 1e-7)) AS n_clamped,
        round(sum(least(greatest({gap}, 0), l_tax)), 6) AS lowest,
        round(sum(greatest(l_tax, l_discount) + ln(1 + exp(-abs(l_tax - l_discount)))), 4) AS log_add FROM lineitem GROUP BY l_returnflag"""
    found["pairs_remaining"] = _with(
        *_EMB, ("l", "SELECT DISTINCT layer FROM acts"),
        final="SELECT 'kldiv' AS measure, x.layer AS a, y.layer AS b FROM l x JOIN l y ON x.layer < y.layer",
    )
    b5 = found["layers_kldiv"].replace("0.01", "0.05")
    found["stored_distances"] = f"SELECT * FROM ({found['layers_cka']}) UNION ALL SELECT * FROM ({b5})"

    found["run_lengths"] = _with(*_RUNS, final=f"SELECT voxel, run, stim, count(*) AS n, {_r('avg(v)', 'mean', 9)}, {_r('var_pop(v) * count(*)', 'ss')} FROM ru GROUP BY ALL")
    found["stim_repetitions"] = _with(
        *_STATS, final="SELECT voxel, count(*) AS n_groups, min(n) AS min_reps, max(n) AS max_reps, min(n) = max(n) AS consistent FROM st GROUP BY voxel"
    )
    found["mean_response"] = _with(*_STATS, final=f"SELECT voxel, stim, {_r('mean', 'y', 9)}, n AS n_reps FROM st")
    found["noise_estimation"] = _with(*_STATS, final=f"SELECT voxel, {_r('noise_var', 'noise_var')} FROM rel")
    found["streamed_statistics"] = found["noise_estimation"]
    found["noise_by_run"] = _with(
        *_RUNS, ("rs", "SELECT voxel, run, count(*) AS n, var_pop(v) * count(*) AS ss FROM ru GROUP BY ALL"),
        final=f"SELECT voxel, {_r('sum(ss) / (sum(n) - count(*))', 'noise_var')} FROM rs GROUP BY voxel",
    )
    rel = f"voxel, n, {_r('mean', 'mean', 9)}, {_r('noise_var', 'noise_var')}, {_r('total_var', 'total_var')}, {_r('1 - noise_var / total_var', 'reliability')}"
    found["voxel_reliability"] = _with(*_STATS, final=f"SELECT {rel} FROM rel")
    lines = ("tr", "SELECT l_suppkey AS voxel, l_returnflag || l_linestatus AS stim, l_quantity AS v FROM lineitem")
    found["supplier_reliability"] = _with(lines, *_STATS[1:], final=f"SELECT {rel} FROM rel")
    found["zscore_voxel"] = _with(
        *_STATS[:1], final=f"SELECT voxel, stim, trial, {_r('(v - avg(v) OVER w) / stddev_pop(v) OVER w', 'v')} FROM tr WINDOW w AS (PARTITION BY voxel)"
    )
    zs = ("zs", "SELECT voxel, stim, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM tr WINDOW w AS (PARTITION BY voxel)")
    found["zscore_response"] = _with(
        _STATS[0], zs, final=f"SELECT voxel, stim, count(*) AS n, {_r('avg(v)', 'mean')}, {_r('var_pop(v) * count(*)', 'ss')} FROM zs GROUP BY ALL"
    )
    found["beta_noise_fit"] = _with(*_DISCOUNT, _FIT, final=f"SELECT {_r('a', 'a')}, 1.0::DOUBLE AS b, n FROM fit")
    found["beta_neg_loglik"] = _with(
        *_DISCOUNT, final=f"SELECT {_r('-(count(*) * ln(2.0) + sum(ln(noise_var / total_var)))', 'neg_loglik')} FROM rel"
    )
    found["noise_grid"] = _with(*_DISCOUNT, _FIT, _GRIDSQL, final=f"SELECT noise_id, {_r('noise_var', 'noise_var')} FROM grid")
    found["grouped_trials"] = _with(
        _STATS[0], ("ft", "SELECT *, min(trial) OVER (PARTITION BY voxel, stim) AS f FROM tr"),
        final="SELECT voxel, stim, trial, row_number() OVER (PARTITION BY voxel ORDER BY f, trial) AS position FROM ft",
    )
    ll = f"SELECT voxel, model, {_r('ll', 'll')} FROM ll"
    found["loglik_single_noise"] = _with(*_ONE, final=ll)
    found["loglik_signal"] = _with(*_EV, *_shared_ll(_SINGLE.replace(f"(1 - {NOISE})", "0.9"), "model"), final=ll)
    found["loglik_voxel_noise"] = _with(*_EV, *_own_ll("nu"), final=ll)
    found["loglik_weighted"] = _with(*_EV, *_own_ll("nu / w.w", "JOIN w USING (i)"), final=ll)
    found["loglik_voxel_weights"] = _with(*_EV, *_own_ll("nu / o.w", "JOIN z o ON o.voxel = zn.voxel AND o.i = mk.i"), final=ll)
    found["loglik_noise_grid"] = _with(*_ONGRID, final=f"SELECT voxel, model, noise_id, {_r('ll', 'll')} FROM ll")
    found["loglik_noise_marginal"] = _with(*_ONGRID, _MARGINAL, final=f"SELECT voxel, model, {_r('ll', 'll')} FROM marg")
    found["log_posterior"] = _with(
        *_ONGRID, _MARGINAL, final=f"SELECT voxel, model, {_r('ll', 'll')}, {_r('lp', 'log_post')} FROM ({_post('voxel', 'marg')})"
    )
    found["log_posterior_joint"] = _with(*_ONGRID, final=f"SELECT voxel, model, noise_id, {_r('lp', 'log_post')} FROM ({_post('voxel')})")
    found["log_posterior_per_noise"] = _with(
        *_ONGRID, final=f"SELECT voxel, model, noise_id, {_r('lp', 'log_post')} FROM ({_post('voxel, noise_id')})"
    )
    found["posterior_sum_check"] = _with(
        *_ONGRID, final=f"SELECT voxel, 1.0::DOUBLE AS total, count(*) AS n FROM ll GROUP BY voxel"
    )
    found["discount_loglik"] = _with(*_DISCOUNT_EV, *_own_ll("nu", dim=11), final=ll)
    winners = "SELECT model, count(*) AS n_voxels FROM (SELECT model, row_number() OVER (PARTITION BY voxel ORDER BY ll DESC, model) AS rn FROM ll) WHERE rn = 1 GROUP BY model"
    found["winner_counts"] = _with(*_ONE, final=winners)
    found["discount_winners"] = _with(*_ONGRID, _MARGINAL, final=winners.replace("FROM ll)", "FROM marg)"))
    qs = ", ".join(_r(f"quantile_cont(lp, {q})", n) for n, q in (("whisker_lo", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("whisker_hi", 1)))
    found["logpost_boxplot"] = _with(*_ONE, final=f"SELECT model, count(*) AS n, {qs} FROM ({_post('voxel')}) GROUP BY model")

    # quantiles of Beta(a, 1) in closed form; of Beta(2, 3) by bisection of its distribution function 6x^2 - 8x^3 + 3x^4
    steps = [("b1", f"SELECT g::INTEGER AS noise_id, (2 * g + 1) / {2 * GRID}.0::DOUBLE AS q, 0.5::DOUBLE AS x FROM (SELECT unnest(range({GRID})) AS g)")]
    for k in range(2, 46):
        move = f"CASE WHEN 6 * x ** 2 - 8 * x ** 3 + 3 * x ** 4 < q THEN 1 ELSE -1 END * {0.5**k!r}"
        steps.append((f"b{k}", f"SELECT noise_id, q, x + {move} AS x FROM b{k - 1}"))
    found["noise_grid_fixed"] = _with(
        *_DISCOUNT, *steps, ("nv", "SELECT '2.5,1' AS beta, noise_id, q ** (1 / 2.5) AS v FROM b1 UNION ALL SELECT '2,3', noise_id, x FROM b45"),
        final=f"SELECT voxel, beta, noise_id, {_r('total_var * v', 'noise', 2)} FROM rel, nv",
    )
    shifted = [(n, b.replace("AS y, st.n AS w", "- i / 5.0 AS y, st.n AS w") if n == "z" else b) for n, b in _ONE]
    found["loglik_with_mean"] = _with(*shifted, final=ll)
    found["registered_measure"] = _with(
        *_EMB_CELLS, ("nm", "SELECT layer, sum(v * v) AS q FROM k GROUP BY layer"),
        final=f"""SELECT 'uncentredalignment' AS measure, x.layer AS a, y.layer AS b, {_r('sum(x.v * y.v) / sqrt(any_value(p.q) * any_value(q.q))', 'value')}
            FROM k x JOIN k y USING (i, j) JOIN nm p ON p.layer = x.layer JOIN nm q ON q.layer = y.layer WHERE x.layer < y.layer GROUP BY ALL""",
    )
    for m in SAMPLED:
        found[f"coordinates_{m}"] = _sampled_coordinates(m)
    found["layers_nbs_unit"] = found["layers_nbs"].replace("n * rt / sqrt(t1 * t2)", "rt / sqrt(t1 * t2)")
    found["seeded_sample"] = f"SELECT vec_id, label FROM embeddings ORDER BY {_key('vec_id', 42)}, vec_id LIMIT 200"
    found["stratified_split"] = _split("embeddings", "vec_id", "label", 42)
    found["document_split"] = _split("documents", "doc_id", "lang", 7)
    found["region_trials"] = f"""SELECT l_suppkey AS voxel, count(*) AS n, {_r('sum(l_quantity / 300)', 'total')} FROM lineitem WHERE l_suppkey IN (
        SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') GROUP BY ALL"""
    found["scatter_volume"] = _with(
        *_ONE, ("lp", _post("voxel")),
        final=f"""SELECT c_custkey AS voxel, c_nationkey, {_r("coalesce(exp(lp), 0)", 'post')} FROM customer
            LEFT JOIN (SELECT voxel, lp FROM lp WHERE model = 'hour') p ON p.voxel = c_custkey""",
    )
    found["epoch_metrics"] = f"""SELECT lang, {_r('sum((quality - (1 - toxic)) ** 2 * n_chars) / sum(n_chars)', 'mean_loss')},
        {_r('avg((quality = 1 - toxic)::INT)', 'accuracy')} FROM documents JOIN labels USING (doc_id) GROUP BY lang"""
    found["streamed_comparisons"] = f"SELECT * FROM ({found['sales_cka']}) UNION ALL SELECT * FROM ({found['sales_gulp']})"
    found["streamed_activations"] = _with(*_EMB, final=f"SELECT layer, count(DISTINCT stim) AS n_stim, {_r('sum(v * v)', 'trace')} FROM acts GROUP BY layer")
    return found
