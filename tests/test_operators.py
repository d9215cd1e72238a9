"""Checks, batches, dense problems, files, streaming and the façade on small fixtures."""

import json
import os
from collections import Counter
from itertools import product

import numpy as np
import pytest
from atomweft.functions import elements, versions
from atomweft.mol import Mol
from atomweft.operators import batch, checks, distance, linalg, pairs, products, tiles
from atomweft.operators import ncoord as nc
from atomweft.plans import views
from atomweft.sources import parsers, reader, samples, writer
from atomweft.streaming import ingest
from pyspark.sql import functions as F

ATOM = "sys_id long, atom_idx int, z int, x double, y double, pz double"


def test_pack_unpack_deflate_merge(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (2, 0, 0.0)], "sys_id long, atom_idx int, x double")
    packed = {r["sys_id"]: (r["packed"], r["mask"]) for r in batch.pack(rows, "x", mask=True).collect()}
    assert packed == {0: ([1.0, 2.0, 3.0], [True] * 3), 1: ([4.0, 0.0, 0.0], [True, False, False]), 2: ([0.0] * 3, [True, False, False])}
    assert sorted(map(tuple, batch.unpack(batch.pack(rows, "x", size=5)).collect())) == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0)]
    merged = batch.merge(rows, rows).groupBy("sys_id").count().collect()
    assert {r["sys_id"]: r["count"] for r in merged} == {0: 3, 1: 1, 2: 1, 3: 3, 4: 1, 5: 1}
    two = spark.sql("SELECT array(array(1, 0, 2, 0), array(0, 3, 0, 0), array(0, 0, 0, 0)) AS a")
    assert two.select(batch.deflate2(F.col("a"), 0)).first()[0] == [[1, 0, 2], [0, 3, 0]]


def test_sorts_put_padding_last(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0.5), (0, 1, 1, 3.0), (0, 2, 1, 1.0), (0, 3, 1, 1.0)], "sys_id long, atom_idx int, z int, x double")
    got = batch.pargsort(rows, "x", F.col("z") == 0).orderBy("rank").collect()
    assert [r["atom_idx"] for r in got] == [2, 3, 1, 0]


def test_symmetrize_refuses_asymmetric(spark):
    coo = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 0, 2.0)], "m long, i int, j int, v double")
    assert {r["v"] for r in batch.symmetrize(coo, force=True).collect()} == {1.5}
    with pytest.raises(Exception, match="not symmetric"):
        batch.symmetrize(coo).collect()


def _matrices(spark, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for n in (1, 3, 6):
        a, c = rng.normal(size=(n, n)), rng.normal(size=(n, n))
        rows.append((n, (a + a.T).tolist(), (c @ c.T + n * np.eye(n)).tolist(), rng.normal(size=n).tolist(), rng.normal(size=(n, n)).tolist()))
    return rows, spark.createDataFrame(rows, "n int, a array<array<double>>, b array<array<double>>, w array<double>, v array<array<double>>")


@pytest.mark.parametrize("scheme", ["chol", "lowd"])
def test_general_eigenproblem(spark, scheme):
    rows, df = _matrices(spark)
    got = {r["n"]: r["e"] for r in df.select("n", linalg.eigh_general(scheme)("a", "b").alias("e")).collect()}
    for n, a, b, *_ in rows:
        w, v = np.array(got[n]["w"]), np.array(got[n]["v"])
        assert np.allclose(np.array(a) @ v, np.array(b) @ v * w, atol=1e-9)
    with pytest.raises(ValueError):
        linalg.eigh_general("other")


def test_eigen_gradient_against_differences(spark):
    rows, df = _matrices(spark)
    got = {r["n"]: np.array(r["g"]) for r in df.select("n", linalg.eigh_vjp("lorn", 0.0)("a", "w", F.transform("a", lambda x: F.transform(x, lambda _: F.lit(0.0)))).alias("g")).collect()}
    for n, a, _, wbar, _ in rows:
        a, num, h = np.array(a), np.zeros((n, n)), 1e-6
        for i in range(n):
            for j in range(n):
                d = np.zeros((n, n))
                d[i, j] += h / 2
                d[j, i] += h / 2
                num[i, j] = (np.linalg.eigvalsh(a + d) - np.linalg.eigvalsh(a - d)) @ np.array(wbar) / (2 * h)
        assert np.allclose(got[n], num, atol=1e-6)
    with pytest.raises(ValueError):
        linalg.eigh_vjp("other")


def test_einsum_orders_agree(spark):
    _, df = _matrices(spark)
    a = df.select(F.col("n").alias("m"), F.posexplode("a").alias("i", "r")).select("m", "i", F.posexplode("r").alias("j", "v"))
    b = a.select("m", F.col("i").alias("j"), F.col("j").alias("k"), "v")
    one, two = ({tuple(r)[:3]: round(r["v"], 9) for r in linalg.einsum("mij,mjk->mik", a, b, order=o).collect()} for o in ("greedy", "left"))
    assert one == two and len(one) == 1 + 9 + 36


def test_distance_norms(spark):
    x = spark.createDataFrame([(0, 0, [0.0, 3.0]), (0, 1, [4.0, 0.0]), (1, 2, [1.0, 1.0])], "batch int, id long, v array<double>")
    d = {(r["i"], r["j"]): r["dist"] for r in distance.cdist(x).collect()}
    assert d[0, 1] == 5.0 and abs(d[2, 2] - 1.4901161193847656e-08) < 1e-20 and (0, 2) not in d
    assert {(r["i"], r["j"]): r["dist"] for r in distance.cdist(x, p=1).collect()}[0, 1] == 7.0


def test_checks(spark):
    rows = [(0, 0, 1, 0.0, 0.0, 1.0), (0, 1, 1, 0.0, 0.0, 1.0), (1, 0, 119, 1.0, 0.0, 0.0), (1, 1, 1, 0.0, 0.0, 0.0)]
    a = spark.createDataFrame(rows, ATOM)
    assert {r["sys_id"]: r["collides"] for r in checks.coldfusion(a).collect()} == {0: True, 1: False}
    assert {r["sys_id"]: r["ok"] for r in checks.content(a).collect()} == {0: False, 1: False}
    assert {r["sys_id"]: r["last_is_pad"] for r in checks.deflatable(a).collect()} == {0: False, 1: True}
    assert checks.shifted(a).filter("sys_id = 1 AND x = 0").count() == 0
    with pytest.raises(Exception, match="bad content"):
        checks.require(checks.content(a), "ok", "bad content").collect()
    with pytest.raises(checks.DtypeError):
        checks.schema(a.withColumn("z", F.col("z").cast("double")))
    checks.dimension(spark.sql("SELECT array(array(1)) AS a"), "a", 1, 2)
    with pytest.raises(RuntimeError):
        checks.dimension(spark.sql("SELECT array(array(1)) AS a"), "a", 3)


@pytest.mark.parametrize(
    "kind, text, error",
    [
        ("xyz", "two\n\nH 0 0 0\nH 0 0 1\n", checks.FormatErrorXYZ),
        ("xyz", "2\n\nH 0 0 1\nH 0 0 0\n", checks.MoleculeError),
        ("xyz", "3\n\nH 0 0 1\n", checks.FormatErrorXYZ),
        ("xyz", "", checks.EmptyFileError),
        ("xyz", "1\n\nJj 0 0 1\n", KeyError),
        ("turbomole", "$coord\n 0.0 0.0 o\n$end\n", checks.FormatErrorTM),
        ("turbomole", "0 0 0 h\n", checks.FormatErrorTM),
        ("turbomole", "$coord\n$end\n", checks.EmptyFileError),
        ("qcschema", "{}", KeyError),
        ("qcschema", '{"molecule": {"symbols": ["H"]}}', KeyError),
    ],
)
def test_malformed_structures(kind, text, error):
    with pytest.raises(error):
        list(parsers.STRUCTURES[kind](text.splitlines()))


def test_value_files():
    assert parsers.turbomole_energy("$energy SCF\n 1 -2.5 0.0 0.0\n$end".splitlines()) == -2.5
    for bad in ("energy\n1 2 3 4", "$energy\n1 2 3", "$energy", "$energy\n\n"):
        with pytest.raises(checks.FormatErrorTM):
            parsers.turbomole_energy(bad.splitlines())
    orca = "#\n# The current total energy in Eh\n#\n -17.25\n#\n# The current gradient in Eh/bohr\n#\n 1.0\n 2.0\n 3.0\n#\n"
    assert parsers.orca_engrad(orca.splitlines()) == (-17.25, [(1.0, 2.0, 3.0)])
    with pytest.raises(checks.FormatErrorORCA):
        parsers.orca_engrad(orca.replace(" 1.0\n", "\n").splitlines())
    with pytest.raises(checks.EmptyFileError):
        parsers.orca_engrad(["#"])
    assert parsers.tblite_engrad([json.dumps({"energies": [1.0], "gradient": [1, 2, 3]})]) == ([1.0], [(1, 2, 3)])
    assert parsers.dotfile(["-1"]) == -1
    with pytest.raises(checks.EmptyFileError):
        parsers.dotfile([])
    with pytest.raises(checks.FormatError):
        parsers.dotfile(["one"])
    assert next(iter(parsers.qm9(["1", "gdb", "H\t0.0\t1.0*^-1\t2.0\t0.5"])))[2] == "H"


def test_kinds():
    assert parsers.kind_of("/a/coord") == "turbomole" and parsers.kind_of("b.XYZ") == "xyz" and parsers.kind_of("c.txt", "qm9") == "qm9"
    with pytest.raises(NotImplementedError):
        parsers.kind_of("a.pdb")
    with pytest.raises(ValueError):
        parsers.kind_of("a.what")


def test_write_and_read_back(spark, tmp_path):
    a = samples.atoms(spark, "SiH4", "CO2").select("sys_id", "atom_idx", "z", "x", "y", "pz").withColumn("x", F.col("x") + 1.0)
    for kind in ("xyz", "turbomole"):
        out = str(tmp_path / kind)
        writer.write(a, out, kind)
        with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
            writer.write(a, out, kind)
        back = reader.as_atoms(reader.read(spark, out, kind))
        old, new = (sorted((r["z"], round(r["x"], 8), round(r["y"], 8), round(r["pz"], 8)) for r in d.collect()) for d in (a, back))
        assert old == new
    writer.write(a, str(tmp_path / "files"), "turbomole", files=True)
    assert sorted(p.name for p in (tmp_path / "files").glob("sys_id=*")) == ["sys_id=0", "sys_id=1"]
    with pytest.raises(NotImplementedError):
        writer.write(a, str(tmp_path / "q"), "qm9")
    with pytest.raises(ValueError):
        writer.xyz_text(a, comment="a\nb")


def test_permissive_and_dotfiles(spark, tmp_path):
    for name, text in (("a/good.xyz", "1\n\nHe 0 0 1\n"), ("b/bad.xyz", "x\n")):
        os.makedirs(tmp_path / name[0])
        (tmp_path / name).write_text(text)
    (tmp_path / "a/.CHRG").write_text("2\n")
    rows = reader.read(spark, [str(tmp_path / "a"), str(tmp_path / "b")], mode="permissive")
    assert rows.filter("error IS NOT NULL").count() == 1 and rows.filter("symbol = 'He'").count() == 1
    with pytest.raises(Exception, match="FormatErrorXYZ|XYZ frame"):
        reader.read(spark, str(tmp_path / "b")).collect()
    charged = reader.dotfiles(rows.select("path").distinct())
    assert sorted(r["charge"] for r in charged.collect()) == [0, 2]
    (tmp_path / "a/.UHF").write_text("1\n")
    mol = Mol.from_path(spark, str(tmp_path / "a"))
    assert [tuple(r)[1:] for r in mol.charge().collect()] == [(2, 1)]
    assert [tuple(r) for r in Mol(samples.atoms(spark, "H2")).charge().collect()] == [(0, 0, 0)]
    (tmp_path / "a/.CHRG").write_text("two\n")
    with pytest.raises(Exception, match="no whole number"):
        reader.dotfiles(rows.select("path").distinct()).collect()


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xyz").write_text("2\n\nH 0 0 0.1\nH 0 0 0.9\n")
    for n in (1, 2):
        ingest.run(spark, str(tmp_path / "in"), nc.cn_d3, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * n
        (tmp_path / "in/b.xyz").write_text("2\n\nLi 0 0 0.1\nH 0 0 1.9\n")


def test_mol(spark):
    m = Mol(samples.atoms(spark, "H2"))
    d = m.distances().filter("i < j").first()["d"]
    assert abs(m.enn().first()["enn"] - 1 / d) < 1e-12 and m.sum_formula().first()["formula"] == "H2"
    assert abs(m.mass().first()["mass"] - 2.01594) < 1e-9 and m.cn("d3").count() == 2 and m.com().count() == 1
    with pytest.raises(ValueError):
        Mol(spark.range(1))


def test_symbols(spark):
    df = spark.createDataFrame([("na",), ("CL",)], "s string")
    assert [r[0] for r in df.select(elements.number(F.col("s"))).collect()] == [11, 17]
    with pytest.raises(Exception, match="unknown element"):
        spark.sql("SELECT 'Qq' AS s").select(elements.number(F.col("s"))).collect()
    assert elements.frame(spark).count() == 119
    assert samples.merged({"a": {"x": 1}}, {"a": {"y": 2}, "b": {}}) == {"a": {"x": 1, "y": 2}}


def test_einsum_of_repeated_letters_and_outer_products(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 1.0), (1, 1, 2.0)], "i int, i_2 int, v double")
    assert linalg.einsum("ii->", a).first()["v"] == 3.0
    assert {r["i"]: r["v"] for r in linalg.einsum("ii->i", a).collect()} == {0: 1.0, 1: 2.0}
    x, y = (spark.createDataFrame([(0, 2.0), (1, 3.0)], f"{c} int, v double") for c in "ij")
    assert sorted(tuple(r) for r in linalg.einsum("i,j->ij", x, y).collect()) == [(0, 0, 4.0), (0, 1, 6.0), (1, 0, 6.0), (1, 1, 9.0)]
    with pytest.raises(ValueError):
        linalg.einsum("i->k", x)


def test_eigenproblems_with_padding_and_nulls(spark):
    a = [[2.0, 1.0, 0.0], [1.0, 2.0, 0.0], [0.0, 0.0, 0.0]]
    b = [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(1, a, b), (2, None, b), (3, [], [])], "m int, a array<array<double>>, b array<array<double>>")
    got = {r["m"]: r["e"] for r in df.select("m", linalg.eigh_padded("a").alias("e")).collect()}
    assert got[1]["w"] == pytest.approx([1, 3, 0]) and [r[2] for r in got[1]["v"]] == [0, 0, 1] and got[2]["w"] is None and got[3]["w"] == []
    for scheme in ("chol", "lowd"):
        got = {r["m"]: r["e"] for r in df.select("m", linalg.eigh_general(scheme)("a", "b").alias("e")).collect()}
        assert got[1]["w"] == pytest.approx([0.5, 1.5, 0]) and got[2]["w"] is None and got[3]["w"] == []
        with pytest.raises(Exception, match="ositive definite|LinAlgError|divide|inf"):
            assert df.filter("m = 1").select(linalg.eigh_general(scheme, is_posdef=True)("a", "b").alias("e")).first()["e"]["w"] == "never"


def test_nested_batches(spark):
    one, two = [[1.0, 0.0], [0.0, 0.0]], [[1.0, 2.0, 3.0]]
    df = spark.createDataFrame([(0, one), (1, two)], "sys_id long, a array<array<double>>")
    packed = batch.pack_nd(df, "a", 2, pad=-1.0)
    assert {r["sys_id"]: r["packed"] for r in packed.collect()} == {0: [[1, 0, -1], [0, 0, -1]], 1: [[1, 2, 3], [-1, -1, -1]]}
    for axis, want in ((None, [[1.0]]), (0, [[1.0], [0.0]]), (1, [[1.0, 0.0]]), (-1, [[1.0, 0.0]])):
        assert df.filter("sys_id = 0").select(batch.deflate_nd(F.col("a"), 2, axis=axis).alias("d")).first()["d"] == want
    cube = spark.createDataFrame([([one, one, [[0.0, 0.0], [0.0, 0.0]]],)], "a array<array<array<double>>>")
    assert cube.select(batch.deflate_nd(F.col("a"), 3).alias("d")).first()["d"] == [[[1.0]], [[1.0]]]
    with pytest.raises(ValueError):
        batch.deflate_nd(F.col("a"), 1, axis=0)
    p, q = (spark.createDataFrame(rows, "sys_id long, packed array<double>") for rows in ([(0, [1.0, 2.0]), (1, [3.0, 0.0])], [(0, [5.0])]))
    assert {r["sys_id"]: r["packed"] for r in batch.merge_packed(p, q, pad=9.0, axis=1).collect()} == {0: [1, 2, 5], 1: [3, 0, 9]}
    assert {r["sys_id"]: r["packed"] for r in batch.merge_packed(p, q, pad=9.0).collect()} == {0: [1, 2], 1: [3, 0], 2: [5, 9]}
    assert {r["at"]: r["packed"] for r in batch.last_axis(p).collect()} == {0: [1, 3], 1: [2, 0]}


def test_symmetrize_sparse_lists(spark):
    coo = spark.createDataFrame([(0, 0, 1, 4.0), (0, 1, 1, 2.0)], "m int, i int, j int, v double")
    assert sorted(tuple(r) for r in batch.symmetrize(coo, force=True).collect()) == [(0, 0, 1, 2.0), (0, 1, 0, 2.0), (0, 1, 1, 2.0)]
    with pytest.raises(Exception, match="not symmetric"):
        batch.symmetrize(coo).collect()


def test_grid_and_self_join_agree(spark):
    """By default large systems take the grid; all pair operators give the same either way."""
    a = samples.atoms(spark, "cube", "H2O", "H", more={"cube": samples.lattice(5)})
    from atomweft.operators import geometry

    near = lambda grid: {(r["sys_id"], r["i"], r["j"]): round(r["d"], 9) for r in pairs.near(a, 6.0, grid=grid).collect()}
    assert near(True) == near(False) and not pairs.needs_grid(a)
    for f in (lambda g: nc.cn_d3_gradient(a, cutoff=6.0, grid=g), lambda g: geometry.nuclear_repulsion(a, 6.0, grid=g), lambda g: nc.coordination_number(a, cutoff=6.0, grid=g)):
        rows = [Counter(tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in f(g).collect()) for g in (True, False)]
        assert rows[0] == rows[1]


def test_linear_systems(spark):
    line = [(6, 0.3 * n, 0.1 * n, -0.7 * n) for n in range(40)]
    made = {"line": line, "bent": [*line, (6, 5.0, 5.0, 5.0)], "two": line[:2], "twice": [line[0], line[0], line[1]], "ghost": [*line[:3], (0, 9.0, 1.0, 2.0)]}
    from atomweft.operators import geometry

    got = {r["sys_id"]: r["is_linear"] for r in geometry.is_linear(samples.atoms(spark, *made, more=made), atol=1e-4).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_versions(spark):
    df = spark.createDataFrame([("2.8.0a0+git7482eb2",), ("1.2.3-rc1",), (None,)], "s string").select(versions.version_tuple(F.col("s")).alias("v"))
    assert [r["v"] for r in df.collect()] == [[2, 8, 0], [1, 2, 3], None]
    with pytest.raises(Exception, match="MAJOR.MINOR.PATCH"):
        spark.sql("SELECT '1.2' AS s").select(versions.version_tuple(F.col("s"))).collect()


def test_samples_from_files(spark, tmp_path):
    (tmp_path / "water.xyz").write_text("3\n\nO 0 0 0.1\nH 0 0 0.9\nH 0 0.9 0\n")
    assert {(r["name"], r["symbol"]) for r in samples.from_files(spark, str(tmp_path)).collect()} == {("water", "O"), ("water", "H")}


def test_cdist_tiles_equal_columns(spark, monkeypatch):
    """One batch is many tiles of bounded size, and gives what the column expressions give, odd vectors included."""
    monkeypatch.setattr(tiles, "ROWS", 7)
    rows = [(n % 3 if n % 10 else None, n, [float((n * k) % 11) / 3 for k in range(5)]) for n in range(60)]
    x = spark.createDataFrame([*rows, (0, 100, None), (0, 101, [1.0]), (0, 102, [1.0, None, 2.0, 3.0, 4.0]), (0, 102, []), (9, 103, [float("nan")] * 5)], "batch int, id long, v array<double>")
    y = x.filter("batch < 2").withColumn("v", F.reverse("v"))
    for p in (1, 2, 3, 2.5):
        got = distance.cdist(x, y, p=p)
        assert "MapInArrow" in got._jdf.queryExecution().toString() and not got.filter("batch = 9").count()
        d = distance.quadratic(F.col("vi"), F.col("vj")) if p == 2 else distance.direct(F.col("vi"), F.col("vj"), p)
        want = x.select("batch", F.col("id").alias("i"), F.col("v").alias("vi")).join(y.select("batch", F.col("id").alias("j"), F.col("v").alias("vj")), "batch").select("batch", "i", "j", d.alias("dist"))
        tell = lambda df: sorted((r["batch"], r["i"], r["j"], round(r["dist"], 9)) for r in df.collect())
        assert tell(got) == tell(want)


def test_triples_of_arrays_equal_brute_force(spark):
    """Counts of triples from each system's array, in one plan without joins or groups."""
    rows = [(s, n, (n + s) % 4) for s in range(5) for n in range(s + 1)]
    a = spark.createDataFrame(rows, "sys_id long, atom_idx int, z int").withColumns({c: F.lit(0.0) for c in ("x", "y", "pz")})
    real = {s: [n for t, n, z in rows if t == s and z] for s in range(5)}
    for own in (True, False):
        want = {}
        for s, at in real.items():
            for i, j, k in ((i, j, k) for i in at for j in at for k in at if j != k and not (own and (i == j or i == k))):
                n, total = want.get((s, i, j), (0, 0))
                want[s, i, j] = (n + 1, total + k)
        counts = pairs.count_triples(a, mask_self=own)
        assert {tuple(r)[:3]: tuple(r)[3:] for r in counts.collect()} == want
        assert pairs.mask_triples(a, mask_self=own).count() == sum(n for n, _ in want.values())
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_atoms_are_dealt_once(spark, tmp_path):
    """Pairs of the lines of an order need one exchange: the view's."""
    spark.createDataFrame([(n // 4, n % 4, n, n, 1.0 * n, 9.0 * n, 0.01) for n in range(20)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = pairs.pairs(views.atoms(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_grid_pairs_small_systems_in_place(spark, monkeypatch):
    """Small systems aren't copied to cells; what is over the bound goes by cells, with the same pairs."""
    a = spark.createDataFrame([(s, n, 1 + n % 8, n * 1.7 % 9, n * 2.3 % 9, n * 3.1 % 9) for s, most in ((0, 5), (1, 40)) for n in range(most)], ATOM)
    tell = lambda df: sorted((r["sys_id"], r["i"], r["j"], round(r["d"], 9)) for r in df.collect())
    want = tell(pairs.within(a, 4.0))
    for bound in (0, 10, 500):
        monkeypatch.setattr(pairs, "GRID_ATOMS", bound)
        assert tell(pairs.within_grid(a, 4.0)) == want


def test_parse_hands_rows_on_in_bounded_batches(monkeypatch):
    """However many rows a batch of files has, no more than `ROWS` are handed on at a time."""
    import pyarrow as pa

    class Texts:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(reader, "ROWS", 5)
    text = "".join(f"2\n\nH 0 0 {n}\nO 1 1 {n}\n" for n in range(9))
    files = pa.RecordBatch.from_pydict({"path": ["a.xyz", "b.xyz"], "value": [text, text]})
    sizes = [b.num_rows for b in reader.parse(Texts())(iter([files]))]
    assert sum(sizes) == 36 and max(sizes) <= 5


@pytest.mark.parametrize("spec", ["bij,bkj->bik", "ij,jk->ik", "abij,abjk->aik", "bij,bjkl->bkil", "bijc,bkj->bik"])
def test_matrix_products_are_tiles(spark, monkeypatch, spec):
    """Sums of products equal the join's, odd numbers, absent and null coordinates included, and no product is a row."""
    monkeypatch.setattr(tiles, "ROWS", 3)
    monkeypatch.setattr(products, "KEYS", 2)
    rng, ops = np.random.default_rng(5), []
    for t in spec.split("->")[0].split(","):
        at = [p for p in product(*[[0, 1, 2, 3, None]] * len(t)) if rng.random() < 0.4]
        odd = [None, float("nan"), float("inf"), 0.0] if "c" not in spec else [None, 0.0]
        rows = [(*p, odd[n] if (n := rng.integers(60)) < len(odd) else float(rng.normal())) for p in at]
        rows += [(*p, 0.5) for p in at[:5]] if "c" in spec else []  # coordinates that occur twice
        ops.append(spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'k' else 'string' if c == 'a' else 'int'}" for c in t) + ", v double"))
    got = linalg.einsum(spec, *ops)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    monkeypatch.setattr(products, "fit", lambda x, y: False)
    want = linalg.einsum(spec, *ops)
    assert got.dtypes == want.dtypes
    tell = lambda df: sorted((str(tuple(None if v is None else round(v, 7) + 0.0 if isinstance(v, float) else v for v in r)) for r in df.collect()))
    assert tell(got) == tell(want)


def test_a_chain_of_contractions_meets_the_vector_first(spark):
    a = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 1, 1, 3.0)], "m int, i int, j int, v double")
    b, c = a.toDF("m", "j", "k", "v"), spark.createDataFrame([(0, 0, 1.0), (0, 1, 10.0)], "m int, k int, v double")
    got = linalg.einsum("mij,mjk,mk->mi", a, b, c)
    assert {tuple(r) for r in got.collect()} == {(0, 0, 81.0), (0, 1, 90.0)} and "MapInArrow" not in got._jdf.queryExecution().toString()


def test_a_large_batch_has_larger_blocks(spark, monkeypatch):
    """The rows that visit the blocks of a batch grow with the batch, not with its square."""
    monkeypatch.setattr(tiles, "ROWS", 4)
    x = spark.range(300).select((F.col("id") >= 60).cast("int").alias("batch"), "id", F.array(F.col("id").cast("double")).alias("v"))
    assert distance.cdist(x).count() == 60**2 + 240**2
    assert {tuple(r) for r in x.groupBy("batch").agg(tiles.blocks(F.count("*"))).collect()} == {(0, 8), (1, 8)}
