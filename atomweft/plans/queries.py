"""Registered queries: every operator over whole driver tables; `oracle` has the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elements, units, versions
from ..functions import kernels as k
from ..operators import autodiff, batch, bond, checks, distance, geometry, linalg, pairs
from ..operators import ncoord as nc
from ..sources import reader, writer
from . import oracle as sql
from .views import atoms, matrices, padded, rounded, table, tidy, vectors

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


# scalar functions ---------------------------------------------------------------------------


def _log(c):
    return rounded(F.log10(F.abs(c)))


def _signed_log(c):
    """For values over many magnitudes, of which rounding to decimals would compare the last bit."""
    return F.signum(c) * F.log10(F.lit(1.0) + F.abs(c))


def _scalar(name: str, source: str, key: str, *columns: Callable) -> None:
    """A projection of one table: key and named columns."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, *[c() for c in columns])

    run.__name__ = name
    query(run)


_bal = lambda: F.when(F.col("c_custkey") % 9 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal"))
_y = lambda: (F.col("event_id") % 3).cast("double")
_scalar("safe_divide", "events", "event_id", lambda: rounded(k.divide(F.col("value"), _y()) * F.when(_y() == 0, F.lit(k.EPS)).otherwise(F.lit(1.0))).alias("r"))
_scalar("safe_reciprocal", "customer", "c_custkey", lambda: _log(k.reciprocal(_bal())).alias("r"))
_scalar("safe_pow_int", "customer", "c_custkey", lambda: rounded(k.power(_bal() / 1000.0, 3)).alias("cube"), lambda: _log(k.power(_bal(), -2)).alias("square"))
_scalar("safe_pow_frac", "customer", "c_custkey", lambda: _log(k.power(_bal(), 0.5)).alias("r"))
_scalar("safe_pow_neg", "customer", "c_custkey", lambda: _log(k.power(_bal(), -1.5)).alias("r"))
_scalar("safe_sqrt", "customer", "c_custkey", lambda: _log(k.sqrt(_bal())).alias("r"))


@query
def safe_pow_column(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", _bal().alias("x"), (F.col("c_custkey") % 3 - 1).cast("double").alias("e"))
    plain = t.agg((F.bool_and(F.col("e") > 0) & F.bool_and(F.col("x") >= 0)).alias("plain"))  # one row
    return t.crossJoin(F.broadcast(plain)).select("c_custkey", _log(k.power_all(F.col("x"), F.col("e"), F.col("plain"))).alias("r"))


def _orders(spark, sf_dir):
    r = F.lit(0.5) + (F.col("o_totalprice") % 1000.0) / 100.0
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r"), (F.lit(2.0) + (F.col("o_orderkey") % 7) * 0.5).alias("r0"))


@query
def fn_erf(spark, sf_dir):
    return _orders(spark, sf_dir).withColumn("x", F.col("r") - 5.5).select("o_orderkey", rounded(k.erf(F.col("x")), 9).alias("erf"))


def _count(name, f):
    def run(spark, sf_dir):
        return nc.with_count(_orders(spark, sf_dir), f, "c", r="r").select("o_orderkey", rounded("c").alias("c"))

    run.__name__ = name
    query(run)


for _n, _f in {"count_exp": k.exp_count, "count_erf": k.erf_count, "count_gfn2": k.gfn2_count, "count_dexp": k.dexp_count, "count_derf": k.derf_count, "count_dgfn2": k.dgfn2_count}.items():
    _count(_n, _f)


@query
def cn_cut(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", rounded(k.cut(F.col("r"), 8.0)).alias("cn"), rounded(k.cut(F.col("r"), 51.0)).alias("uncut"))


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 87).cast("int").alias("z"))


@query
def elem_lookup(spark, sf_dir):
    names = ["r_atomic", "r_cov", "r_vdw", "en", "hardness", "ecore", "zeff", "zvalence"]
    return tidy(_parts(spark, sf_dir).select("p_partkey", *[elements.lookup(n, F.col("z")).alias(n) for n in names]))


@query
def elem_masses(spark, sf_dir):
    return tidy(_parts(spark, sf_dir).select("p_partkey", *[elements.lookup(n, F.col("z")).alias(n) for n in ("mass", "mass_au")]), 4)


@query
def conv_symbol_to_number(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", elements.number(F.lower(elements.symbol(F.col("z")))).alias("z"))


@query
def conv_number_to_symbol(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", elements.symbol(F.col("z")).alias("symbol"))


@query
def conv_any_to_double(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", batch.any_to_double(F.col("o_totalprice").cast("string")).alias("v"))


@query
def unit_convert(spark, sf_dir):
    small = F.col("o_totalprice") / 1e5
    return table(spark, sf_dir, "orders").select("o_orderkey", *[rounded(units.convert(small, u), 4).alias(u.lower()) for u in ("AU2EV", "AU2KCALMOL", "AA2AU", "AU2DEBYE", "AU2RCM")])


@query
def tool_memory_tensor(spark, sf_dir):
    n = atoms(spark, sf_dir).groupBy("sys_id").agg(F.count("*").alias("n"))
    return n.select("sys_id", rounded(batch.memory_mb(F.col("n"), F.col("n")), 9).alias("mb"))


# masks and pairs ----------------------------------------------------------------------------


@query
def mask_atoms(spark, sf_dir):
    return pairs.real_atoms(padded(spark, sf_dir)).select("sys_id", "atom_idx", "z")


@query
def mask_pairs(spark, sf_dir):
    return pairs.mask_pairs(padded(spark, sf_dir))


@query
def mask_pairs_diag(spark, sf_dir):
    return pairs.mask_pairs(padded(spark, sf_dir), mask_diagonal=False)


def _triples(mask_self):
    def run(spark, sf_dir):
        return pairs.count_triples(padded(spark, sf_dir), mask_self=mask_self)

    return run


_QUERIES["mask_triples"], _QUERIES["mask_triples_noself"] = _triples(True), _triples(False)


@query
def pairs_within_cutoff(spark, sf_dir):
    return tidy(pairs.within(atoms(spark, sf_dir), 5.0).select("sys_id", "i", "j", "d"))


@query
def pairs_within_grid(spark, sf_dir):
    return tidy(pairs.within_grid(atoms(spark, sf_dir), 5.0).select("sys_id", "i", "j", "d"))


# coordination numbers and bonds -------------------------------------------------------------


def _cn(name, f, **kw):
    def run(spark, sf_dir):
        return tidy(f(atoms(spark, sf_dir), **kw))

    run.__name__ = name
    query(run)


for _n, _f in {"cn_d3": nc.cn_d3, "cn_d4": nc.cn_d4, "cn_eeq": nc.cn_eeq, "cn_eeq_en": nc.cn_eeq_en, "cn_gfn2": nc.cn_gfn2, "cn_d3_gradient": nc.cn_d3_gradient}.items():
    _cn(_n, _f)
_cn("cn_uncut", nc.cn_eeq, cutoff=None, cn_max=None)


@query
def cn_grid(spark, sf_dir):
    return tidy(nc.coordination_number(atoms(spark, sf_dir), count=k.erf_count, cutoff=6.0, grid=True))


def _with_cn(spark, sf_dir):
    """Atoms with their D3 coordination number; carried through the grouping, not joined back."""
    return nc.cn_d3(atoms(spark, sf_dir), keep=("x", "y", "pz"))


@query
def bond_length(spark, sf_dir):
    return tidy(bond.bond_length(_with_cn(spark, sf_dir)).select("sys_id", "i", "j", "bond_length"))


@query
def bond_order(spark, sf_dir):
    return tidy(bond.bond_order(_with_cn(spark, sf_dir)))


@query
def bond_bonded_pairs(spark, sf_dir):
    return tidy(bond.bonded(bond.bond_order(_with_cn(spark, sf_dir))))


# geometry and properties --------------------------------------------------------------------


@query
def geom_bond_angles(spark, sf_dir):
    a = geometry.bond_angles(atoms(spark, sf_dir)).groupBy("sys_id", "j").agg(F.count("*").alias("n"), F.sum("angle").alias("total"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    return tidy(a, 4)


@query
def geom_is_linear(spark, sf_dir):
    return geometry.is_linear(atoms(spark, sf_dir))


def _massed(spark, sf_dir):
    return geometry.with_mass(atoms(spark, sf_dir), atomic_units=False)


@query
def prop_com(spark, sf_dir):
    return tidy(geometry.center_of_mass(_massed(spark, sf_dir)))


@query
def prop_rel_com(spark, sf_dir):
    return tidy(geometry.relative_to_com(_massed(spark, sf_dir)).select("sys_id", "atom_idx", "x", "y", "pz"))


@query
def prop_inertia(spark, sf_dir):
    return tidy(geometry.inertia(_massed(spark, sf_dir)), 4)


@query
def prop_inertia_raw(spark, sf_dir):
    return tidy(geometry.inertia(_massed(spark, sf_dir), center_pa=False, already_com=True), 4)


@query
def prop_rot_consts(spark, sf_dir):
    rot = geometry.rotational_constants(_massed(spark, sf_dir))
    return tidy(rot.select("sys_id", *[_signed_log(F.col(c) * 1e9).alias(c) for c in ("rot_a", "rot_b", "rot_c")]), 4)


@query
def mol_distances(spark, sf_dir):
    return tidy(pairs.pairs(atoms(spark, sf_dir), diagonal=True).select("sys_id", "i", "j", "d"))


@query
def mol_enn(spark, sf_dir):
    return tidy(geometry.nuclear_repulsion(atoms(spark, sf_dir)))


@query
def mol_mass(spark, sf_dir):
    return tidy(geometry.total_mass(atoms(spark, sf_dir)))


@query
def mol_composition(spark, sf_dir):
    return geometry.composition(atoms(spark, sf_dir))


@query
def mol_sum_formula(spark, sf_dir):
    return geometry.sum_formula(atoms(spark, sf_dir))


# checks -------------------------------------------------------------------------------------


@query
def chk_coldfusion(spark, sf_dir):
    return checks.coldfusion(atoms(spark, sf_dir), 1.0)


@query
def chk_content(spark, sf_dir):
    return checks.content(padded(spark, sf_dir), max_element=16, allow_batched=False, threshold=1.0)


@query
def chk_deflatable(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return checks.deflatable(a.withColumns({c: F.when(F.col("z") == 1, F.lit(0.0)).otherwise(F.col(c)) for c in ("x", "y", "pz")}))


@query
def chk_shape(spark, sf_dir):
    three = F.when(F.col("z") == 17, F.array("x", "y")).otherwise(F.array("x", "y", "pz"))
    packed = atoms(spark, sf_dir).groupBy("sys_id").agg(F.collect_list("z").alias("numbers"), F.collect_list(three).alias("positions"))
    return checks.shape(packed)


# batches ------------------------------------------------------------------------------------


@query
def batch_pack(spark, sf_dir):
    return tidy(batch.pack(atoms(spark, sf_dir), "x").select("sys_id", F.posexplode("packed").alias("at", "x")))


@query
def batch_pack_mask(spark, sf_dir):
    return batch.pack(atoms(spark, sf_dir), "z", mask=True).select("sys_id", F.posexplode(F.arrays_zip("packed", "mask")).alias("at", "p")).select("sys_id", "at", F.col("p.packed").alias("z"), F.col("p.mask").alias("real"))


@query
def batch_unpack(spark, sf_dir):
    return tidy(batch.unpack(batch.pack(atoms(spark, sf_dir), "x")))


@query
def batch_deflate(spark, sf_dir):
    packed = batch.pack(padded(spark, sf_dir), "z")
    return packed.select("sys_id", F.size(batch.deflate(F.col("packed"))).alias("n"))


@query
def batch_merge(spark, sf_dir):
    a = atoms(spark, sf_dir).select("sys_id", "atom_idx", "z")
    return batch.merge(a, a)


@query
def batch_psort(spark, sf_dir):
    return tidy(batch.psort(padded(spark, sf_dir), "x", F.col("z") == 0).select("sys_id", "rank", "x"))


@query
def batch_pargsort(spark, sf_dir):
    return batch.pargsort(padded(spark, sf_dir), "y", F.col("z") == 0)


@query
def batch_deflate_axis(spark, sf_dir):
    """8 x 8 matrices with padding behind row 5 and column 3: sizes after deflating all axes, and with one spared."""
    kept = matrices(spark, sf_dir).withColumn("v", F.when((F.col("i") <= 5) & (F.col("j") <= 3), F.lit(1.0)).otherwise(F.lit(0.0)))
    a = linalg.dense(kept)
    size = lambda axis, n: [F.size(batch.deflate2(F.col("a"), axis=axis)).alias(f"rows{n}"), F.size(F.get(batch.deflate2(F.col("a"), axis=axis), 0)).alias(f"cols{n}")]
    return a.select("m", *size(None, ""), *size(0, "0"), *size(1, "1"))


@query
def batch_merge_axis(spark, sf_dir):
    """Orders' numbers and every third order's positions, packed each, end to end."""
    a = atoms(spark, sf_dir).select("sys_id", "atom_idx", F.col("z").cast("double").alias("z"), "x")
    both = batch.merge_packed(batch.pack(a, "z", pad=-1.0), batch.pack(a.filter("sys_id % 3 = 0"), "x", pad=-1.0), pad=-1.0, axis=1)
    return tidy(both.select("sys_id", F.posexplode("packed").alias("at", "v")))


@query
def conv_version_tuple(spark, sf_dir):
    text = F.concat_ws(".", F.col("p_partkey") % 5, F.col("p_size"), F.concat(F.col("p_partkey").cast("string"), F.lit("a0+git7")))
    return table(spark, sf_dir, "part").select("p_partkey", versions.version_tuple(text).alias("v")).select("p_partkey", *[F.get("v", n).alias(c) for n, c in enumerate(("major", "minor", "patch"))])


@query
def unit_constants(spark, sf_dir):
    return units.frame(spark).select("name", _signed_log(F.col("value") * 1e20).alias("value")).select("name", rounded("value", 9).alias("value"))


# distances and linear algebra ---------------------------------------------------------------


def _dist(p):
    def run(spark, sf_dir):
        return tidy(distance.cdist(vectors(spark, sf_dir), p=p))

    return run


_QUERIES |= {"dist_quadratic": _dist(2), "dist_p1": _dist(1), "dist_p3": _dist(3)}


@query
def dist_cdist_xy(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return tidy(distance.cdist(x, x.withColumn("v", F.reverse("v"))))


@query
def la_einsum_matmul(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.col("batch").alias("b"), F.col("id").alias("i"), F.posexplode("v").alias("j", "v"))
    return tidy(linalg.einsum("bij,bkj->bik", v, v.select("b", F.col("i").alias("k"), "j", "v")))


@query
def la_einsum_chain(spark, sf_dir):
    a = matrices(spark, sf_dir)
    b = a.select("m", F.col("i").alias("j"), F.col("j").alias("k"), "v")
    return tidy(linalg.einsum("mij,mjk,mk->mi", a, b, a.filter("i = 0").select("m", F.col("j").alias("k"), "v")))


def _symmetric(spark, sf_dir, n=8):
    return batch.symmetrize(matrices(spark, sf_dir, n), force=True)


@query
def conv_symmetrize(spark, sf_dir):
    return tidy(_symmetric(spark, sf_dir))


@query
def conv_reshape_fortran(spark, sf_dir):
    m = vectors(spark, sf_dir).select(F.col("id").alias("m"), F.posexplode(batch.reshape_fortran(F.col("v"), 16, 4)).alias("i", "r"))
    return tidy(m.select("m", "i", F.posexplode("r").alias("j", "v")))


@query
def la_eye(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(batch.eye(F.col("n_regionkey") + 1, 2.5)).alias("i", "r"))
    return n.select("n_nationkey", "i", F.posexplode("r").alias("j", "v"))


@query
def la_gershgorin(spark, sf_dir):
    return tidy(linalg.gershgorin(_symmetric(spark, sf_dir)))


@query
def la_eigvals3(spark, sf_dir):
    s = _symmetric(spark, sf_dir, 3)
    at = lambda i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v")))
    six = s.groupBy("m").agg(at(0, 0).alias("xx"), at(1, 1).alias("yy"), at(2, 2).alias("zz"), at(0, 1).alias("xy"), at(0, 2).alias("xz"), at(1, 2).alias("yz"))
    w = geometry.eigenvalues3(*[F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")])
    return tidy(six.select("m", *[c.alias(n) for c, n in zip(w, ("w0", "w1", "w2"))]))


def _dense(spark, sf_dir):
    return linalg.dense(_symmetric(spark, sf_dir))


def _positive(spark, sf_dir, n=8):
    """a, and b = 10 on the diagonal plus a small symmetric part."""
    s = _symmetric(spark, sf_dir, n)
    b = s.withColumn("v", F.when(F.col("i") == F.col("j"), F.lit(10.0)).otherwise(F.lit(0.0)) + F.col("v") * 0.1)
    return linalg.dense(s).join(linalg.dense(b).withColumnRenamed("a", "b"), "m")


def _matmul(a, b):
    """Rows of a times rows of b, as nested arrays."""
    add = lambda r, k: F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), F.lit(0.0), lambda s, j: s + F.get(r, j) * F.get(F.get(b, j), k))
    return F.transform(a, lambda r: F.transform(F.sequence(F.lit(0), F.size(F.get(b, 0)) - 1), lambda k: add(r, k)))


def _turned(a):
    return F.transform(F.sequence(F.lit(0), F.size(F.get(a, 0)) - 1), lambda k: F.transform(a, lambda r: F.get(r, k)))


def _eigen_rows(e, b=None):
    """m, i, k, residual of (a - w b) v and the Gram entry v' b v, from columns m, a, w, v (and b)."""
    v = F.col("v")
    e = e.withColumn("av", _matmul(F.col("a"), v)).withColumn("bv", v if b is None else _matmul(F.col(b), v))
    e = e.withColumn("gram", _matmul(_turned(v), F.col("bv")))
    residual = F.transform("av", lambda r, i: F.transform(r, lambda x, k: x - F.get(F.col("w"), k) * F.get(F.get(F.col("bv"), i), k)))
    e = e.withColumn("residual", residual).select("m", F.posexplode(F.arrays_zip("residual", "gram")).alias("i", "r"))
    return tidy(e.select("m", "i", F.posexplode(F.arrays_zip("r.residual", "r.gram")).alias("k", "x")).select("m", "i", "k", "x.residual", "x.gram"))


@query
def la_eigh(spark, sf_dir):
    return _eigen_rows(_dense(spark, sf_dir).withColumn("e", linalg.eigh("a")).select("m", "a", "e.w", "e.v"))


@query
def la_eigh_padded(spark, sf_dir):
    """Matrices packed with two rows and columns of zeros: the ghosts' eigenvalues and vectors, and the sum of the others."""
    s = _symmetric(spark, sf_dir).withColumn("v", F.when((F.col("i") % 8 >= 6) | (F.col("j") >= 6), F.lit(0.0)).otherwise(F.col("v")))
    e = linalg.dense(s).select("m", linalg.eigh_padded("a").alias("e")).select("m", "e.w", "e.v")
    e = e.withColumn("trace", F.aggregate(F.slice("w", 1, 6), F.lit(0.0), lambda t, x: t + x))
    e = e.select("m", "trace", F.slice("w", 7, 2).alias("ghosts"), F.posexplode(F.transform("v", lambda r: F.slice(r, 7, 2))).alias("i", "r"))
    return tidy(e.select("m", "i", "trace", F.get("ghosts", 0).alias("w6"), F.get("ghosts", 1).alias("w7"), F.get("r", 0).alias("v6"), F.get("r", 1).alias("v7")))


@query
def la_eigh_moments(spark, sf_dir):
    """Sums of eigenvalues and of their squares, which SQL can tell from the matrix."""
    e = _dense(spark, sf_dir).select("m", linalg.eigh("a")["w"].alias("w"))
    add = lambda f: F.aggregate("w", F.lit(0.0), lambda s, x: s + f(x))
    return tidy(e.select("m", add(lambda x: x).alias("trace"), add(lambda x: x * x).alias("square")), 5)


def _general(scheme):
    def run(spark, sf_dir):
        e = _positive(spark, sf_dir).withColumn("e", linalg.eigh_general(scheme)("a", "b"))
        return _eigen_rows(e.select("m", "a", "b", "e.w", "e.v"), "b")

    return run


_QUERIES |= {"la_eigh_general_chol": _general("chol"), "la_eigh_general_lowd": _general("lowd")}
#: Seeds of the gradient by 2 x 2 matrices.
W_BAR, V_BAR = (0.3, -0.7), ((0.2, 0.5), (-0.4, 0.1))


@query
def la_eigh_vjp(spark, sf_dir):
    a = linalg.dense(_symmetric(spark, sf_dir, 2))
    g = a.select("m", F.posexplode(linalg.eigh_vjp()("a", F.array(*map(F.lit, W_BAR)), F.array(*[F.array(*map(F.lit, r)) for r in V_BAR]))).alias("i", "r"))
    return tidy(g.select("m", "i", F.posexplode("r").alias("j", "v")), 5)


@query
def la_eigh_general_vjp(spark, sf_dir):
    """The gradients of the sum of all eigenvalues, tr(b^-1 a), by a and by b, for 2 x 2 matrices."""
    ones, zeros = F.array(F.lit(1.0), F.lit(1.0)), F.array(*[F.array(F.lit(0.0), F.lit(0.0))] * 2)
    g = _positive(spark, sf_dir, 2).withColumn("g", linalg.eigh_general_vjp()("a", "b", ones, zeros))
    g = g.select("m", F.posexplode(F.arrays_zip("g.a", "g.b")).alias("i", "r")).select("m", "i", F.posexplode(F.arrays_zip("r.a", "r.b")).alias("j", "x"))
    return tidy(g.select("m", "i", "j", F.col("x.a").alias("by_a"), F.col("x.b").alias("by_b")))


@query
def la_einsum_trace(spark, sf_dir):
    return tidy(linalg.einsum("mii->m", matrices(spark, sf_dir).toDF("m", "i", "i_2", "v")))


@query
def la_einsum_outer(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), (F.col("n_regionkey") + 0.5).alias("v"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("j"), (F.col("r_regionkey") - 1.5).alias("v"))
    return linalg.einsum("i,j->ij", n, r)


@query
def la_eig_sort_out(spark, sf_dir):
    """Diagonal matrices as their own eigenproblem; every third diagonal entry is a ghost. `row` is where an eigenvector's 1 stands."""
    s = matrices(spark, sf_dir).withColumn("v", F.when(F.col("i") != F.col("j"), F.lit(0.0)).when(F.col("i") % 3 == 1, F.lit(0.0)).otherwise(F.col("v")))
    w = s.filter("i = j").groupBy("m").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("w"))
    e = linalg.sort_out(w.withColumn("v", batch.eye(F.size("w"))))
    row = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda k: F.array_position(F.transform("v", lambda r: F.get(r, k)), F.lit(1.0)) - 1)
    e = e.select("m", F.posexplode(F.arrays_zip("w", row.alias("row"))).alias("n", "x"))
    return tidy(e.select("m", "n", "x.w", "x.row"))


# differentiation ----------------------------------------------------------------------------


@query
def ad_cn_d3_jacobian(spark, sf_dir):
    return tidy(autodiff.cn_d3_jacobian(atoms(spark, sf_dir)).select("sys_id", "i", "j", "gx", "gy", "gz"))


@query
def ad_enn_hessian(spark, sf_dir):
    h = autodiff.enn_hessian(atoms(spark, sf_dir))
    six = tidy(h.select("sys_id", "i", "j", *[_signed_log(F.col(n)).alias(n) for n in ("hxx", "hxy", "hxz", "hyy", "hyz", "hzz")]), 5)
    return six.select("sys_id", "i", "j", *[F.col(f"h{min(a, b)}{max(a, b)}").alias(f"h{a}{b}") for a in "xyz" for b in "xyz"])


@query
def ad_gradcheck_cn_d3(spark, sf_dir):
    return autodiff.gradcheck_cn_d3(atoms(spark, sf_dir)).select("sys_id", (F.col("max_error") < 1e-6).alias("ok"))


@query
def ad_erf_jacobian(spark, sf_dir):
    a = atoms(spark, sf_dir).withColumn("r", elements.lookup("r_cov", F.col("z")))
    return tidy(autodiff.pair_jacobian(a, autodiff.erf_count(autodiff.Var("r0")), 25.0, ("r",), r0=F.col("r_i") + F.col("r_j")).select("sys_id", "i", "j", "gx", "gy", "gz"))


@query
def ad_gradgradcheck_enn(spark, sf_dir):
    both = pairs.pairs(atoms(spark, sf_dir)).filter("d > 0.5").withColumn("zz", (F.col("zi") * F.col("zj")).cast("double"))
    return autodiff.gradgradcheck(both, autodiff.repulsion()).select("sys_id", (F.col("max_error") < 1e-4).alias("ok"))


# files --------------------------------------------------------------------------------------


def _scan(render, ftype):
    def run(spark, sf_dir):
        texts = render(atoms(spark, sf_dir)).select(F.col("sys_id").cast("string").alias("path"), F.col("text").alias("value"))
        rows = reader.parse(texts, ftype)
        return tidy(rows.select(F.col("path").cast("long").alias("sys_id"), "frame", "atom_idx", elements.number(F.col("symbol")).alias("z"), "x", "y", "pz"))

    return run


_QUERIES |= {"scan_xyz_roundtrip": _scan(writer.xyz_text, "xyz"), "scan_turbomole": _scan(writer.turbomole_text, "turbomole"), "scan_qcschema": _scan(writer.qcschema_text, "qcschema")}


def _qm9_text(atoms):
    """Files as the QM9 set has them: properties, charges, *^ for e, and trailing lines."""
    number = lambda c: F.regexp_replace(F.format_string("%.17e", F.col(c) * F.lit(units.AU2AA)), "e", "*^")
    line = F.concat_ws("\t", elements.symbol(F.col("z")), number("x"), number("y"), number("pz"), F.lit("-2.5*^-6"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("atom_idx", line.alias("line")))), lambda s: s["line"])
    rows = atoms.groupBy("sys_id").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("body"))
    return rows.select("sys_id", F.concat_ws("\n", F.col("n").cast("string"), F.lit("gdb 1\t157.7118\t6.5*^-2"), "body", F.lit("1341.3\t1341.4\nC\tC\nInChI=1S/CH4/h1H4")).alias("text"))


_QUERIES["scan_qm9"] = _scan(_qm9_text, "qm9")


@query
def scan_xyz_frames(spark, sf_dir):
    """Ten orders' frames after one another in a file."""
    texts = writer.xyz_text(atoms(spark, sf_dir)).withColumn("file", F.floor(F.col("sys_id") / 40))
    files = texts.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sys_id", "text"))), lambda s: s["text"]), "").alias("value"))
    rows = reader.parse(files.select(F.col("file").cast("string").alias("path"), "value"), "xyz")
    return tidy(rows.select(F.col("path").cast("long").alias("file"), "frame", "atom_idx", elements.number(F.col("symbol")).alias("z"), "x", "y", "pz"))


def _gradients(spark, sf_dir):
    """sys_id, energy and the sorted gradient of each order."""
    rows = atoms(spark, sf_dir).groupBy("sys_id").agg(F.sum("x").alias("energy"), F.sort_array(F.collect_list(F.struct("atom_idx", "x", "y", "pz"))).alias("g"))
    return rows.withColumn("flat", F.flatten(F.transform("g", lambda s: F.array(s["x"], s["y"], s["pz"]))))


@query
def scan_turbomole_energy(spark, sf_dir):
    text = F.format_string("$energy      SCF               SCFKIN            SCFPOT\n     1 %.12f 1.0 -2.0\n$end\n", "energy")
    rows = reader.values(_gradients(spark, sf_dir).select(F.col("sys_id").cast("string").alias("path"), text.alias("value")), "turbomole_energy")
    return tidy(rows.select(F.col("path").cast("long").alias("sys_id"), "energy"))


def _engrad(kind, value):
    def run(spark, sf_dir):
        rows = reader.values(_gradients(spark, sf_dir).select(F.col("sys_id").cast("string").alias("path"), value().alias("value")), kind)
        return tidy(rows.select(F.col("path").cast("long").alias("sys_id"), "atom_idx", "energy", "gx", "gy", "gz"))

    return run


_lines = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.12f", x)), "\n")
_QUERIES["scan_orca_engrad"] = _engrad("orca_engrad", lambda: F.concat(F.lit("#\n# The current total energy in Eh\n#\n"), F.format_string("%.12f", "energy"), F.lit("\n#\n# The current gradient in Eh/bohr\n#\n"), _lines("flat"), F.lit("\n#\n# The atomic numbers\n")))
_QUERIES["scan_tblite_engrad"] = _engrad("tblite_engrad", lambda: F.to_json(F.struct(F.lit("1").alias("version"), F.transform("g", lambda s: s["x"]).alias("energies"), F.col("flat").alias("gradient"))))


@query
def sink_xyz_text(spark, sf_dir):
    return writer.xyz_text(atoms(spark, sf_dir), fmt="%12.6f", comment="made by a query")


@query
def sink_turbomole_text(spark, sf_dir):
    return writer.turbomole_text(padded(spark, sf_dir), fmt="%12.6f")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {n: s for n, s in sql.queries().items() if n in _QUERIES}
