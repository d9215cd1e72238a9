"""The same results in DuckDB's SQL, written out from the formulas rather than from the operators."""

from __future__ import annotations

from ..functions import elements, units
from ..functions import kernels as k

EPS = "2.220446049250313e-16"


def num(v) -> str:
    if v is None:
        return "NULL"
    s = repr(v)
    return s if isinstance(v, int) or "e" in s else s + "e0"


def r(x: str, digits: int = 6) -> str:
    return f"CASE WHEN round({x}, {digits}) = 0 THEN 0e0 ELSE round({x}, {digits}) END"


def div(x: str, y: str) -> str:
    return f"(({x}) / CASE WHEN ({y}) <> 0 THEN ({y}) ELSE {EPS} END)"


_COLS = list(elements.TABLE)
EL = "el AS (SELECT * FROM (VALUES " + ", ".join(f"({z}, '{elements.SYMBOLS[z]}', " + ", ".join(num(elements.TABLE[c][z]) for c in _COLS) + ")" for z in range(87)) + ") AS t(z, symbol, " + ", ".join(_COLS) + "))"
A = """a AS (SELECT l_orderkey AS sys_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) - 1 AS INTEGER) AS atom_idx,
  CAST(list_extract([1, 6, 7, 8, 9, 14, 16, 17], CAST(l_partkey % 8 + 1 AS BIGINT)) AS INTEGER) AS z, l_quantity * 0.16e0 AS x, l_extendedprice * 0.00008e0 AS y, l_discount * 80e0 AS pz FROM lineitem)"""
PAD = A + ", pad AS (SELECT sys_id, atom_idx, CASE WHEN atom_idx % 4 = 3 THEN 0 ELSE z END AS z, x, y, pz FROM a)"
AE = f"{EL}, {A}, ae AS (SELECT a.*, el.r_cov AS r, el.en AS en, el.mass AS mass FROM a JOIN el USING (z))"
_D2 = "((j.x - i.x) * (j.x - i.x) + (j.y - i.y) * (j.y - i.y) + (j.pz - i.pz) * (j.pz - i.pz))"
P = f"""{AE}, p AS (SELECT i.sys_id, i.atom_idx AS i, j.atom_idx AS j, i.z AS zi, j.z AS zj, j.x - i.x AS dx, j.y - i.y AS dy, j.pz - i.pz AS dz,
  i.r + j.r AS r0, i.en AS ei, j.en AS ej, sqrt(greatest({_D2}, {EPS})) AS d FROM ae i JOIN ae j ON i.sys_id = j.sys_id)"""


def exp_count(d: str, r0: str, kcn: float) -> str:
    return f"(1e0 / (1e0 + exp({num(-kcn)} * ({div(r0, d)} - 1e0))))"


def dexp_count(d: str, r0: str, kcn: float) -> str:
    e = f"exp({num(-kcn)} * ({r0} / {d} - 1e0))"
    return f"(CASE WHEN {num(-kcn)} * ({r0} / {d} - 1e0) > 300 THEN 0e0 ELSE {num(-kcn)} * {r0} * {e} / ({d} * {d} * ({e} + 1e0) * ({e} + 1e0)) END)"


def _horner(v: str, top, bottom) -> str:
    n, d = f"({num(top[-1])} * {v})", v
    for a, b in zip(top[:-2], bottom[:-1]):
        n, d = f"(({n} + {num(a)}) * {v})", f"(({d} + {num(b)}) * {v})"
    return f"(({n} + {num(top[-2])}) / ({d} + {num(bottom[-1])}))"


def erf(x: str) -> str:
    """Of a column."""
    v = f"(1e0 / ({x} * {x}))"
    far = f"(1e0 - exp(-{x} * {x}) * (0.5641895835477563e0 - {v} * {_horner(v, k._P, k._Q)}) / abs({x}))"
    mid = f"(1e0 - exp(-{x} * {x}) * {_horner(f'abs({x})', k._C, k._D)})"
    return f"(CASE WHEN abs({x}) <= 0.46875e0 THEN {x} * {_horner(f'({x} * {x})', k._A, k._B)} ELSE sign({x}) * CASE WHEN abs({x}) <= 4e0 THEN {mid} WHEN abs({x}) < 6e0 THEN {far} ELSE 1e0 END END)"


def _cn(pair: str, f: str, cutoff: float | None, out: str = "s") -> str:
    gate = "i <> j" + (f" AND d <= {num(cutoff)}" if cutoff else "")
    return f"WITH {P}, q AS (SELECT *, {pair} AS u FROM p), g AS (SELECT sys_id, i, zi, sum(CASE WHEN {gate} THEN {f} ELSE 0e0 END) AS s FROM q GROUP BY 1, 2, 3) SELECT sys_id, i AS atom_idx, zi AS z, {r(out)} AS cn FROM g"


def _erf_cn(kcn: float, weight: str, cutoff: float | None, out: str = "s") -> str:
    return _cn(f"{num(-kcn)} * (d / r0 - 1e0)", f"0.5e0 * (1e0 + {erf('u')}) * {weight}", cutoff, out)


ORD = "o AS (SELECT o_orderkey, 0.5e0 + (o_totalprice % 1000e0) / 100e0 AS r, 2e0 + (o_orderkey % 7) * 0.5e0 AS r0 FROM orders)"
BAL = "b AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 0e0 ELSE c_acctbal END AS x FROM customer)"
CND3 = f"cn AS (SELECT sys_id, i AS atom_idx, sum(CASE WHEN i <> j AND d <= 25e0 THEN {exp_count('d', 'r0', 16.0)} ELSE 0e0 END) AS cn FROM p GROUP BY 1, 2)"
BL = f"""{P}, {CND3}, c AS (SELECT a.sys_id, a.atom_idx, el.bo_r0 + el.bo_cf * cn.cn AS ra, el.bo_en AS en, el.bo_p1 AS p1, el.bo_p2 AS p2 FROM a JOIN cn USING (sys_id, atom_idx) JOIN el USING (z)),
bl AS (SELECT p.sys_id, p.i, p.j, p.d, (1e0 - 0.5e0 * (x.p1 + y.p1) * abs(x.en - y.en) - 0.5e0 * (x.p2 + y.p2) * (x.en - y.en) * (x.en - y.en)) * (x.ra + y.ra) AS bond_length
 FROM p JOIN c x ON x.sys_id = p.sys_id AND x.atom_idx = p.i JOIN c y ON y.sys_id = p.sys_id AND y.atom_idx = p.j)"""
BO = f"{BL}, bu AS (SELECT *, -7.5e0 * (d / bond_length - 1e0) AS u FROM bl WHERE i <> j), bo AS (SELECT sys_id, i, j, 0.5e0 * (1e0 + {erf('u')}) AS bond_order FROM bu)"
ANG = f"""{P}, t AS (SELECT a.sys_id, a.j AS i, a.i AS j, b.j AS k, a.dx * b.dx + a.dy * b.dy + a.dz * b.dz AS ab, a.dx * a.dx + a.dy * a.dy + a.dz * a.dz AS aa, b.dx * b.dx + b.dy * b.dy + b.dz * b.dz AS bb
 FROM p a JOIN p b ON a.sys_id = b.sys_id AND a.i = b.i WHERE a.i <> a.j AND b.i <> b.j AND a.j <> b.j),
ang AS (SELECT sys_id, i, j, k, degrees(acos(greatest(least({div('ab', 'sqrt(aa) * sqrt(bb)')}, 1e0), -1e0))) AS angle FROM t)"""
COM = f"{AE}, com AS (SELECT sys_id, sum(mass * x) * (1e0 / (sum(mass) + {EPS})) AS cx, sum(mass * y) * (1e0 / (sum(mass) + {EPS})) AS cy, sum(mass * pz) * (1e0 / (sum(mass) + {EPS})) AS cz FROM ae GROUP BY 1)"
REL = COM + ", rel AS (SELECT sys_id, atom_idx, mass, x - cx AS x, y - cy AS y, pz - cz AS pz FROM ae JOIN com USING (sys_id))"


def _moments(source: str) -> str:
    return f"(SELECT sys_id, sum(mass*x*x) AS xx, sum(mass*y*y) AS yy, sum(mass*pz*pz) AS zz, sum(mass*x*y) AS xy, sum(mass*x*pz) AS xz, sum(mass*y*pz) AS yz FROM {source} GROUP BY 1)"


INERTIA = REL + f", i6 AS (SELECT sys_id, xx + yy + zz - xx AS xx, xx + yy + zz - yy AS yy, xx + yy + zz - zz AS zz, -xy AS xy, -xz AS xz, -yz AS yz FROM {_moments('rel')})"


def _eigen3(source: str) -> str:
    """CTEs that end in w(key, w0, w1, w2) from source(key, xx, yy, zz, xy, xz, yz)."""
    return f"""q1 AS (SELECT *, (xx + yy + zz) / 3e0 AS q FROM {source}), q2 AS (SELECT *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + (xy*xy + xz*xz + yz*yz) * 2e0) / 6e0) AS p FROM q1),
q3 AS (SELECT key, q, p, (xx-q)/s AS a, (yy-q)/s AS b, (zz-q)/s AS c, xy/s AS d, xz/s AS e, yz/s AS f FROM (SELECT *, CASE WHEN p > 0 THEN p ELSE 1e0 END AS s FROM q2)),
q4 AS (SELECT key, q, p, acos(greatest(least((a*(b*c - f*f) - d*(d*c - f*e) + e*(d*f - b*e)) / 2e0, 1e0), -1e0)) / 3e0 AS phi FROM q3),
q5 AS (SELECT key, q, q + p * 2e0 * cos(phi + {num(2.0 * 3.141592653589793 / 3.0)}) AS w0, q + p * 2e0 * cos(phi) AS w2 FROM q4), w AS (SELECT key, w0, q * 3e0 - w2 - w0 AS w1, w2 FROM q5)"""


V = "v AS (SELECT vec_id AS id, label AS batch, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) AS BIGINT) - 1 AS ix FROM embeddings)"


def _m(n: int) -> str:
    return f"{V}, m AS (SELECT id AS m, CAST(ix // {n} AS INTEGER) AS i, CAST(ix % {n} AS INTEGER) AS j, v FROM v WHERE ix < {n * n}), s AS (SELECT a.m, a.i, a.j, (a.v + b.v) / 2e0 AS v FROM m a JOIN m b ON a.m = b.m AND a.i = b.j AND a.j = b.i)"


def _dist(inner: str, outer: str, y: str = "y.ix") -> str:
    return f"WITH {V}, g AS (SELECT x.batch, x.id AS i, y.id AS j, sum({inner}) AS s FROM v x JOIN v y ON x.batch = y.batch AND x.ix = {y} GROUP BY 1, 2, 3) SELECT batch, i, j, {r(outer)} AS dist FROM g"


PARTS = f"{EL}, pt AS (SELECT p_partkey, CAST(p_partkey % 87 AS INTEGER) AS z FROM part)"
_SCAN = f"WITH {A} SELECT sys_id, CAST(0 AS INTEGER) AS frame, atom_idx, z, {r('x')} AS x, {r('y')} AS y, {r('pz')} AS pz FROM a"
_F = "(CASE WHEN i <> j AND d <= 25e0 THEN " + dexp_count("d", "r0", 16.0) + " / d ELSE 0e0 END)"


_G = "(CASE WHEN i <> j AND d <= 25e0 THEN -7.5e0 / sqrt(pi()) / r0 * exp(-56.25e0 * (d - r0) * (d - r0) / (r0 * r0)) / d ELSE 0e0 END)"


def _two() -> str:
    """CTE t(m, a, b, c): symmetric 2 x 2 matrices."""
    return f"{_m(2)}, t AS (SELECT m, max(CASE WHEN i = 0 AND j = 0 THEN v END) AS a, max(CASE WHEN i = 0 AND j = 1 THEN v END) AS b, max(CASE WHEN i = 1 AND j = 1 THEN v END) AS c FROM s GROUP BY 1)"


def _entries(source: str, **cols: tuple[str, str, str]) -> str:
    """Rows m, i, j and columns from symmetric 2 x 2 results, each given as (00, 01, 11)."""
    at = lambda x: f"CASE i + j WHEN 0 THEN {x[0]} WHEN 1 THEN {x[1]} ELSE {x[2]} END"
    return f"SELECT m, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {', '.join(f'{at(x)} AS {n}' for n, x in cols.items())} FROM {source}, (SELECT unnest(range(2)) AS i) p, (SELECT unnest(range(2)) AS j) q"


def _vjp2() -> str:
    """The gradient in closed form, for the seeds w = (0.3, -0.7), v = ((0.2, 0.5), (-0.4, 0.1))."""
    return f"""WITH {_two()}, e AS (SELECT *, (a + c) / 2e0 - sqrt((a - c) * (a - c) / 4e0 + b * b) AS lo, (a + c) / 2e0 + sqrt((a - c) * (a - c) / 4e0 + b * b) AS hi FROM t),
h AS (SELECT *, CASE WHEN a >= c THEN hi - c ELSE b END AS hx, CASE WHEN a >= c THEN b ELSE hi - a END AS hy FROM e),
n AS (SELECT m, lo, hi, hx / sqrt(hx * hx + hy * hy) AS x, hy / sqrt(hx * hx + hy * hy) AS y FROM h),
u AS (SELECT *, CASE WHEN abs(x) >= abs(y) THEN -y ELSE y END AS lx, CASE WHEN abs(x) >= abs(y) THEN x ELSE -x END AS ly FROM n),
q AS (SELECT *, ((x * 0.2e0 - y * 0.4e0) - (lx * 0.5e0 + ly * 0.1e0)) / (lo - hi) AS q FROM u),
g AS (SELECT m, 0.3e0 * lx * lx - 0.7e0 * x * x + q * x * lx AS g0, 0.3e0 * lx * ly - 0.7e0 * x * y + q * (x * ly + y * lx) / 2e0 AS g1, 0.3e0 * ly * ly - 0.7e0 * y * y + q * y * ly AS g2 FROM q)
{_entries("g", v=(r("g0", 5), r("g1", 5), r("g2", 5)))}"""


def _general_vjp2() -> str:
    """b^-1 and -b^-1 a b^-1."""
    return f"""WITH {_two()}, b AS (SELECT *, 10e0 + a * 0.1e0 AS p, b * 0.1e0 AS o, 10e0 + c * 0.1e0 AS s FROM t),
n AS (SELECT m, a, b, c, s / (p * s - o * o) AS x, -o / (p * s - o * o) AS y, p / (p * s - o * o) AS z FROM b),
g AS (SELECT m, x, y, z, -(x * x * a + 2e0 * x * y * b + y * y * c) AS g0, -(x * y * a + (x * z + y * y) * b + y * z * c) AS g1, -(y * y * a + 2e0 * y * z * b + z * z * c) AS g2 FROM n)
{_entries("g", by_a=(r("x"), r("y"), r("z")), by_b=(r("g0"), r("g1"), r("g2")))}"""


def queries() -> dict[str, str]:
    gap = f"(abs(ei - ej) + {num(k.D4_K5)})"
    e8 = num(2.718281828459045**8.0)
    out = {
        "safe_divide": f"SELECT event_id, {r(f'CASE WHEN event_id % 3 = 0 THEN value / {EPS} * {EPS} ELSE value / CAST(event_id % 3 AS DOUBLE) * 1e0 END')} AS r FROM events",
        "safe_reciprocal": f"WITH {BAL} SELECT c_custkey, {r(f'log10(abs(1e0 / (x + {EPS})))')} AS r FROM b",
        "safe_pow_int": f"WITH {BAL} SELECT c_custkey, {r('pow(x / 1000e0, 3e0)')} AS cube, {r(f'log10(abs(pow(CASE WHEN x = 0 THEN {EPS} ELSE x END, -2e0)))')} AS square FROM b",
        "safe_pow_frac": f"WITH {BAL} SELECT c_custkey, {r(f'CASE WHEN x = 0 THEN NULL ELSE log10(sqrt(CASE WHEN x < 0 THEN {EPS} ELSE x END)) END')} AS r FROM b",
        "safe_pow_neg": f"WITH {BAL} SELECT c_custkey, {r(f'log10(pow(CASE WHEN x <= 0 THEN {EPS} ELSE x END, -1.5e0))')} AS r FROM b",
        "safe_sqrt": f"WITH {BAL} SELECT c_custkey, {r(f'log10(sqrt(greatest(x, {EPS})))')} AS r FROM b",
        "safe_pow_column": f"WITH {BAL} SELECT c_custkey, {r(f'log10(pow(CASE WHEN x > 0 THEN x ELSE {EPS} END, c_custkey % 3 - 1e0))')} AS r FROM b",
        "fn_erf": f"WITH {ORD}, u AS (SELECT o_orderkey, r - 5.5e0 AS x FROM o) SELECT o_orderkey, {r(erf('x'), 9)} AS erf FROM u",
        "count_exp": f"WITH {ORD} SELECT o_orderkey, {r(exp_count('r', 'r0', 16.0))} AS c FROM o",
        "count_erf": f"WITH {ORD}, u AS (SELECT o_orderkey, -7.5e0 * (r / r0 - 1e0) AS x FROM o) SELECT o_orderkey, {r(f'0.5e0 * (1e0 + {erf("x")})')} AS c FROM u",
        "count_gfn2": f"WITH {ORD} SELECT o_orderkey, {r(exp_count('r', 'r0', 10.0) + ' * ' + exp_count('r', '(r0 + 2e0)', 20.0))} AS c FROM o",
        "count_dexp": f"WITH {ORD} SELECT o_orderkey, {r(dexp_count('r', 'r0', 16.0))} AS c FROM o",
        "count_derf": f"WITH {ORD} SELECT o_orderkey, {r('-7.5e0 / sqrt(pi()) / r0 * exp(-56.25e0 * (r - r0) * (r - r0) / (r0 * r0))')} AS c FROM o",
        "count_dgfn2": f"WITH {ORD} SELECT o_orderkey, {r(dexp_count('r', 'r0', 10.0) + ' * ' + exp_count('r', '(r0 + 2e0)', 20.0) + ' + ' + exp_count('r', 'r0', 10.0) + ' * ' + dexp_count('r', '(r0 + 2e0)', 20.0))} AS c FROM o",
        "cn_cut": f"WITH {ORD} SELECT o_orderkey, {r(f'ln(1e0 + {e8}) - ln(1e0 + exp(8e0 - r))')} AS cn, {r('r')} AS uncut FROM o",
        "elem_lookup": f"WITH {PARTS} SELECT p_partkey, {', '.join(f'{r(c)} AS {c}' for c in ('r_atomic', 'r_cov', 'r_vdw', 'en', 'hardness'))}, ecore, zeff, zvalence FROM pt JOIN el USING (z)",
        "elem_masses": f"WITH {PARTS} SELECT p_partkey, {r('mass', 4)} AS mass, {r('mass_au', 4)} AS mass_au FROM pt JOIN el USING (z)",
        "conv_symbol_to_number": f"WITH {PARTS} SELECT p_partkey, el.z FROM pt JOIN el USING (z)",
        "conv_number_to_symbol": f"WITH {PARTS} SELECT p_partkey, symbol FROM pt JOIN el USING (z)",
        "conv_any_to_double": "SELECT o_orderkey, CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS v FROM orders",
        "unit_convert": "SELECT o_orderkey, " + ", ".join(f"{r(f'o_totalprice / 1e5 * {num(units.FACTORS[u])}', 4)} AS {u.lower()}" for u in ("AU2EV", "AU2KCALMOL", "AA2AU", "AU2DEBYE", "AU2RCM")) + " FROM orders",
        "tool_memory_tensor": f"SELECT l_orderkey AS sys_id, {r('8e0 * count(*) * count(*) / 1048576e0', 9)} AS mb FROM lineitem GROUP BY 1",
        "mask_atoms": f"WITH {PAD} SELECT sys_id, atom_idx, z FROM pad WHERE z <> 0",
        "mask_pairs": f"WITH {PAD} SELECT x.sys_id, x.atom_idx AS i, y.atom_idx AS j FROM pad x JOIN pad y USING (sys_id) WHERE x.z <> 0 AND y.z <> 0 AND x.atom_idx <> y.atom_idx",
        "mask_pairs_diag": f"WITH {PAD} SELECT x.sys_id, x.atom_idx AS i, y.atom_idx AS j FROM pad x JOIN pad y USING (sys_id) WHERE x.z <> 0 AND y.z <> 0",
        "pairs_within_cutoff": f"WITH {P} SELECT sys_id, i, j, {r('d')} AS d FROM p WHERE i <> j AND d <= 5e0",
        "cn_d3": _cn("d", exp_count("d", "r0", 16.0), 25.0),
        "cn_gfn2": _cn("d", exp_count("d", "r0", 10.0) + " * " + exp_count("d", "(r0 + 2e0)", 20.0), 25.0),
        "cn_d4": _erf_cn(7.5, f"{num(k.D4_K4)} * exp(-({gap} * {gap}) / {num(k.D4_K6)})", 30.0),
        "cn_eeq": _erf_cn(7.5, "1e0", 25.0, f"ln(1e0 + {e8}) - ln(1e0 + exp(8e0 - s))"),
        "cn_uncut": _erf_cn(7.5, "1e0", None),
        "cn_eeq_en": _erf_cn(2.6, "(ej - ei)", 25.0),
        "cn_grid": _erf_cn(7.5, "1e0", 6.0),
        "cn_d3_gradient": f"WITH {P} SELECT sys_id, i, j, " + ", ".join(f"{r(f'{_F} * {c}')} AS g{c[1]}" for c in ("dx", "dy", "dz")) + " FROM p WHERE i <> j",
        "bond_length": f"WITH {BL} SELECT sys_id, i, j, {r('bond_length')} AS bond_length FROM bl",
        "bond_order": f"WITH {BO} SELECT sys_id, i, j, {r('bond_order')} AS bond_order FROM bo",
        "bond_bonded_pairs": f"WITH {BO} SELECT sys_id, i, j, {r('bond_order')} AS bond_order FROM bo WHERE bond_order > 0.3e0",
        "geom_bond_angles": f"WITH {ANG} SELECT sys_id, j, count(*) AS n, {r('sum(angle)', 4)} AS total, {r('min(angle)', 4)} AS least, {r('max(angle)', 4)} AS most FROM ang GROUP BY 1, 2",
        "geom_is_linear": f"WITH {ANG} SELECT s.sys_id, coalesce(b.n, 0) = 0 AS is_linear FROM (SELECT DISTINCT sys_id FROM a) s LEFT JOIN (SELECT sys_id, count(*) AS n FROM ang WHERE NOT (abs(angle) <= 1e-8 OR abs(angle - 180e0) <= 1e-8 + 1e-5 * 180e0) GROUP BY 1) b USING (sys_id)",
        "prop_com": f"WITH {COM} SELECT sys_id, {r('cx')} AS cx, {r('cy')} AS cy, {r('cz')} AS cz FROM com",
        "prop_rel_com": f"WITH {REL} SELECT sys_id, atom_idx, {r('x')} AS x, {r('y')} AS y, {r('pz')} AS pz FROM rel",
        "prop_inertia": f"WITH {INERTIA} SELECT sys_id, " + ", ".join(f"{r(c, 4)} AS i{c}" for c in ("xx", "yy", "zz", "xy", "xz", "yz")) + " FROM i6",
        "prop_inertia_raw": f"WITH {AE} SELECT sys_id, " + ", ".join(f"{r(c, 4)} AS i{c}" for c in ("xx", "yy", "zz", "xy", "xz", "yz")) + f" FROM {_moments('ae')}",
        "prop_rot_consts": f"WITH {INERTIA}, i7 AS (SELECT sys_id AS key, xx, yy, zz, xy, xz, yz FROM i6), {_eigen3('i7')} SELECT key AS sys_id, " + ", ".join(f"{r(f'log10(1e0 + CASE WHEN {w} <= 1e-6 THEN 0e0 ELSE 1e0 / ({num(4.0 * 3.141592653589793 * 137.035999139)} * {w} + {EPS}) END * 1e9)', 4)} AS rot_{c}" for w, c in zip(("w0", "w1", "w2"), "abc")) + " FROM w",
        "mol_distances": f"WITH {P} SELECT sys_id, i, j, {r('d')} AS d FROM p",
        "mol_enn": f"WITH {P} SELECT sys_id, {r('0.5e0 * sum(CASE WHEN i <> j AND d <= 25e0 THEN zi * zj / d ELSE 0e0 END)')} AS enn FROM p GROUP BY 1",
        "mol_mass": f"WITH {AE} SELECT sys_id, {r('sum(mass)')} AS mass FROM ae GROUP BY 1",
        "mol_composition": f"WITH {A} SELECT sys_id, z, count(*) AS n FROM a GROUP BY 1, 2",
        "mol_sum_formula": f"WITH {EL}, {A}, c AS (SELECT sys_id, z, count(*) AS n FROM a GROUP BY 1, 2) SELECT sys_id, string_agg(symbol || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END, '' ORDER BY z) AS formula FROM c JOIN el USING (z) GROUP BY 1",
        "chk_coldfusion": f"WITH {A} SELECT i.sys_id, bool_or(i.atom_idx <> j.atom_idx AND sqrt({_D2}) < 1e0) AS collides FROM a i JOIN a j USING (sys_id) GROUP BY 1",
        "chk_content": f"WITH {PAD}, z AS (SELECT sys_id, max(z) AS max_z, min(z) AS min_z FROM pad GROUP BY 1), c AS (SELECT i.sys_id, bool_or(i.atom_idx <> j.atom_idx AND sqrt({_D2}) < 1e0) AS hit FROM pad i JOIN pad j USING (sys_id) WHERE i.z <> 0 AND j.z <> 0 GROUP BY 1) SELECT z.sys_id, max_z, min_z, max_z <= 16 AND min_z >= 1 AND NOT coalesce(hit, false) AS ok FROM z LEFT JOIN c USING (sys_id)",
        "chk_deflatable": f"WITH {A} SELECT sys_id, max_by(z, atom_idx) = 1 OR max_by(x = 0 AND y = 0 AND pz = 0, atom_idx) AS last_is_pad FROM a GROUP BY 1",
        "chk_shape": f"WITH {A} SELECT sys_id, bool_and(z <> 17) AS ok FROM a GROUP BY 1",
        "batch_pack": f"WITH {A}, n AS (SELECT max(atom_idx) AS n FROM a), g AS (SELECT s.sys_id, CAST(t.at AS INTEGER) AS at FROM (SELECT DISTINCT sys_id FROM a) s, (SELECT unnest(range(n + 1)) AS at FROM n) t) SELECT g.sys_id, g.at, {r('coalesce(a.x, 0e0)')} AS x FROM g LEFT JOIN a ON a.sys_id = g.sys_id AND a.atom_idx = g.at",
        "batch_pack_mask": f"WITH {A}, n AS (SELECT max(atom_idx) AS n FROM a), g AS (SELECT s.sys_id, CAST(t.at AS INTEGER) AS at FROM (SELECT DISTINCT sys_id FROM a) s, (SELECT unnest(range(n + 1)) AS at FROM n) t) SELECT g.sys_id, g.at, coalesce(a.z, 0) AS z, a.z IS NOT NULL AS real FROM g LEFT JOIN a ON a.sys_id = g.sys_id AND a.atom_idx = g.at",
        "batch_unpack": f"WITH {A} SELECT sys_id, atom_idx, {r('x')} AS value FROM a",
        "batch_deflate": f"WITH {PAD} SELECT sys_id, CAST(max(CASE WHEN z <> 0 THEN atom_idx + 1 ELSE 0 END) AS INTEGER) AS n FROM pad GROUP BY 1",
        "batch_merge": f"WITH {A} SELECT sys_id, atom_idx, z FROM a UNION ALL SELECT sys_id + (SELECT max(sys_id) + 1 FROM a), atom_idx, z FROM a",
        "batch_psort": f"WITH {PAD} SELECT sys_id, CAST(row_number() OVER (PARTITION BY sys_id ORDER BY z = 0, x, atom_idx) - 1 AS INTEGER) AS rank, {r('x')} AS x FROM pad",
        "batch_pargsort": f"WITH {PAD} SELECT sys_id, CAST(row_number() OVER (PARTITION BY sys_id ORDER BY z = 0, y, atom_idx) - 1 AS INTEGER) AS rank, atom_idx FROM pad",
        "dist_quadratic": _dist("(x.v - y.v) * (x.v - y.v)", f"sqrt(greatest(s, {EPS}))"),
        "dist_p1": _dist("abs(x.v - y.v)", f"greatest(s, {EPS})"),
        "dist_p3": _dist("pow(abs(x.v - y.v), 3e0)", f"pow(greatest(s, {EPS}), {num(1.0 / 3)})"),
        "dist_cdist_xy": _dist("(x.v - y.v) * (x.v - y.v)", f"sqrt(greatest(s, {EPS}))", "63 - y.ix"),
        "la_einsum_matmul": f"WITH {V} SELECT x.batch AS b, x.id AS i, y.id AS k, {r('sum(x.v * y.v)')} AS v FROM v x JOIN v y ON x.batch = y.batch AND x.ix = y.ix GROUP BY 1, 2, 3",
        "la_einsum_chain": f"WITH {_m(8)} SELECT a.m, a.i, {r('sum(a.v * b.v * c.v)')} AS v FROM m a JOIN m b ON a.m = b.m AND a.j = b.i JOIN m c ON c.m = b.m AND c.i = 0 AND c.j = b.j GROUP BY 1, 2",
        "conv_symmetrize": f"WITH {_m(8)} SELECT m, i, j, {r('v')} AS v FROM s",
        "conv_reshape_fortran": f"WITH {V} SELECT id AS m, CAST(ix % 16 AS INTEGER) AS i, CAST(ix // 16 AS INTEGER) AS j, {r('v')} AS v FROM v WHERE ix < 64",
        "la_eye": "SELECT n_nationkey, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 2.5e0 ELSE 0e0 END AS v FROM (SELECT n_nationkey, n_regionkey, unnest(range(n_regionkey + 1)) AS i FROM nation) a, LATERAL (SELECT unnest(range(a.n_regionkey + 1)) AS j) b",
        "la_gershgorin": f"WITH {_m(8)}, g AS (SELECT m, i, sum(abs(v)) AS t, sum(CASE WHEN i = j THEN v ELSE 0e0 END) AS c FROM s GROUP BY 1, 2) SELECT m, {r('min(c - (t - abs(c)))')} AS low, {r('max(c + (t - abs(c)))')} AS high FROM g GROUP BY 1",
        "la_eigvals3": f"WITH {_m(3)}, six AS (SELECT m AS key, " + ", ".join(f"max(CASE WHEN i = {i} AND j = {j} THEN v END) AS {n}" for i, j, n in ((0, 0, "xx"), (1, 1, "yy"), (2, 2, "zz"), (0, 1, "xy"), (0, 2, "xz"), (1, 2, "yz"))) + f" FROM s GROUP BY 1), {_eigen3('six')} SELECT key AS m, {r('w0')} AS w0, {r('w1')} AS w1, {r('w2')} AS w2 FROM w",
        "la_eigh_moments": f"WITH {_m(8)} SELECT m, {r('sum(CASE WHEN i = j THEN v ELSE 0e0 END)', 5)} AS trace, {r('sum(v * v)', 5)} AS square FROM s GROUP BY 1",
        "la_eigh_vjp": _vjp2(),
        "la_eigh_general_vjp": _general_vjp2(),
        "la_eigh_padded": f"WITH {_m(8)}, t AS (SELECT m, sum(CASE WHEN i = j AND i < 6 THEN v ELSE 0e0 END) AS t FROM s GROUP BY 1) SELECT s.m, i, {r('t')} AS trace, 0e0 AS w6, 0e0 AS w7, CASE WHEN i = 6 THEN 1e0 ELSE 0e0 END AS v6, CASE WHEN i = 7 THEN 1e0 ELSE 0e0 END AS v7 FROM s JOIN t USING (m) WHERE j = 0",
        "la_einsum_trace": f"WITH {_m(8)} SELECT m, {r('sum(v)')} AS v FROM m WHERE i = j GROUP BY 1",
        "la_einsum_outer": "SELECT n_nationkey AS i, r_regionkey AS j, (n_regionkey + 0.5e0) * (r_regionkey - 1.5e0) AS v FROM nation, region",
        "batch_deflate_axis": "SELECT vec_id AS m, CAST(6 AS INTEGER) AS rows, CAST(4 AS INTEGER) AS cols, CAST(8 AS INTEGER) AS rows0, CAST(4 AS INTEGER) AS cols0, CAST(6 AS INTEGER) AS rows1, CAST(8 AS INTEGER) AS cols1 FROM embeddings",
        "batch_merge_axis": f"WITH {A}, n AS (SELECT max(atom_idx) + 1 AS n, max(CASE WHEN sys_id % 3 = 0 THEN atom_idx END) + 1 AS k FROM a), g AS (SELECT s.sys_id, CAST(t.at AS INTEGER) AS at, n, k FROM (SELECT DISTINCT sys_id FROM a) s, (SELECT unnest(range(n + k)) AS at, n, k FROM n) t) SELECT g.sys_id, g.at, {r('coalesce(CASE WHEN g.at < n THEN CAST(o.z AS DOUBLE) ELSE o.x END, -1e0)')} AS v FROM g LEFT JOIN a o ON o.sys_id = g.sys_id AND ((g.at < n AND o.atom_idx = g.at) OR (g.at >= n AND o.sys_id % 3 = 0 AND o.atom_idx = g.at - n))",
        "conv_version_tuple": "SELECT p_partkey, CAST(p_partkey % 5 AS INTEGER) AS major, CAST(p_size AS INTEGER) AS minor, CAST(p_partkey AS INTEGER) AS patch FROM part",
        "unit_constants": "SELECT name, " + r("sign(v) * log10(1e0 + abs(v * 1e20))", 9) + " AS value FROM (VALUES " + ", ".join(f"('{n}', CAST({num(float(v))} AS DOUBLE))" for n, v in sorted((units.CONSTANTS | units.FACTORS).items())) + ") AS t(name, v)",
        "scan_xyz_frames": f"WITH {A}, f AS (SELECT sys_id, sys_id // 40 AS file, CAST(dense_rank() OVER (PARTITION BY sys_id // 40 ORDER BY sys_id) - 1 AS INTEGER) AS frame, atom_idx, z, x, y, pz FROM a) SELECT file, frame, atom_idx, z, {r('x')} AS x, {r('y')} AS y, {r('pz')} AS pz FROM f",
        "scan_turbomole_energy": f"WITH {A} SELECT sys_id, {r('sum(x)')} AS energy FROM a GROUP BY 1",
        "scan_orca_engrad": f"WITH {A} SELECT sys_id, atom_idx, {r('sum(x) OVER (PARTITION BY sys_id)')} AS energy, {r('x')} AS gx, {r('y')} AS gy, {r('pz')} AS gz FROM a",
        "scan_tblite_engrad": f"WITH {A} SELECT sys_id, atom_idx, {r('x')} AS energy, {r('x')} AS gx, {r('y')} AS gy, {r('pz')} AS gz FROM a",
        "la_eig_sort_out": f"WITH {_m(8)}, d AS (SELECT m, i, CASE WHEN i % 3 = 1 THEN 0e0 ELSE v END AS w FROM m WHERE i = j) SELECT m, CAST(row_number() OVER (PARTITION BY m ORDER BY w = 0, i) - 1 AS INTEGER) AS n, {r('w')} AS w, CAST(i AS BIGINT) AS row FROM d",
        "ad_cn_d3_jacobian": f"WITH {P}, g AS (SELECT sys_id, i, j, {_F} * dx AS gx, {_F} * dy AS gy, {_F} * dz AS gz FROM p), t AS (SELECT * FROM g WHERE i <> j UNION ALL SELECT sys_id, i, i, -sum(gx), -sum(gy), -sum(gz) FROM g GROUP BY 1, 2) SELECT sys_id, i, j, {r('gx')} AS gx, {r('gy')} AS gy, {r('gz')} AS gz FROM t",
        "ad_erf_jacobian": f"WITH {P}, g AS (SELECT sys_id, i, j, {_G} * dx AS gx, {_G} * dy AS gy, {_G} * dz AS gz FROM p), t AS (SELECT * FROM g WHERE i <> j UNION ALL SELECT sys_id, i, i, -sum(gx), -sum(gy), -sum(gz) FROM g GROUP BY 1, 2) SELECT sys_id, i, j, {r('gx')} AS gx, {r('gy')} AS gy, {r('gz')} AS gz FROM t",
        "ad_gradgradcheck_enn": f"WITH {P} SELECT sys_id, true AS ok FROM p WHERE i <> j AND d > 0.5e0 GROUP BY 1",
        "ad_gradcheck_cn_d3": f"WITH {A} SELECT sys_id, true AS ok FROM a GROUP BY 1 HAVING count(*) > 1",
        "scan_xyz_roundtrip": _SCAN, "scan_qm9": _SCAN, "scan_turbomole": _SCAN, "scan_qcschema": _SCAN,
        "sink_xyz_text": f"WITH {EL}, {A} SELECT sys_id, CAST(count(*) AS VARCHAR) || chr(10) || 'made by a query' || chr(10) || string_agg(rpad(symbol, 2, ' ') || ' ' || " + " || ' ' || ".join(f"printf('%12.6f', {c} * {num(units.AU2AA)})" for c in ("x", "y", "pz")) + ", chr(10) ORDER BY atom_idx) || chr(10) AS text FROM a JOIN el USING (z) GROUP BY 1",
        "sink_turbomole_text": f"WITH {EL}, {PAD} SELECT sys_id, '$coord' || chr(10) || string_agg(" + " || '  ' || ".join(f"printf('%12.6f', {c})" for c in ("x", "y", "pz")) + " || '      ' || lower(CASE WHEN z = 0 THEN 'q' ELSE symbol END) || ' ', chr(10) ORDER BY atom_idx) || chr(10) || '$end' || chr(10) AS text FROM pad JOIN el USING (z) GROUP BY 1",
    }
    out["pairs_within_grid"] = out["pairs_within_cutoff"]
    for name in ("la_eigh", "la_eigh_general_chol", "la_eigh_general_lowd"):  # eigenvectors leave nothing over and are orthonormal
        out[name] = "SELECT vec_id AS m, CAST(i AS INTEGER) AS i, CAST(k AS INTEGER) AS k, 0e0 AS residual, CASE WHEN i = k THEN 1e0 ELSE 0e0 END AS gram FROM embeddings, (SELECT unnest(range(8)) AS i) a, (SELECT unnest(range(8)) AS k) b"
    for name, gate in (("mask_triples", "y.atom_idx <> t.atom_idx AND x.atom_idx <> y.atom_idx AND x.atom_idx <> t.atom_idx"), ("mask_triples_noself", "y.atom_idx <> t.atom_idx")):
        out[name] = f"WITH {PAD} SELECT x.sys_id, x.atom_idx AS i, y.atom_idx AS j, count(*) AS n, CAST(sum(t.atom_idx) AS BIGINT) AS k FROM pad x JOIN pad y USING (sys_id) JOIN pad t USING (sys_id) WHERE x.z <> 0 AND y.z <> 0 AND t.z <> 0 AND {gate} GROUP BY 1, 2, 3"
    blocks = ", ".join(f"zi * zj * (3e0 * d{a} * d{b}{' - d * d' if a == b else ''}) / (d * d * d * d * d) AS h{a}{b}" for a in "xyz" for b in "xyz")
    names = [f"h{a}{b}" for a in "xyz" for b in "xyz"]
    out["ad_enn_hessian"] = f"WITH {P}, h AS (SELECT sys_id, i, j, {blocks} FROM p WHERE i <> j), t AS (SELECT sys_id, i, j, " + ", ".join(f"-{n} AS {n}" for n in names) + " FROM h UNION ALL SELECT sys_id, i, i, " + ", ".join(f"sum({n})" for n in names) + " FROM h GROUP BY 1, 2) SELECT sys_id, i, j, " + ", ".join(f"{r(f'sign({n}) * log10(1e0 + abs({n}))', 5)} AS {n}" for n in names) + " FROM t"
    return out
