from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import queries as q
from tensorloom import source_queries
from tensorloom.operators import algebra as al
from tensorloom.operators import sampling as sp
from tensorloom.plans import als, analysis
from tensorloom.sources import tensors as ts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.sql(f"create view {p.stem} as from '{p}'")
    return c


QUERIES, ORACLE_SQL = q.QUERIES | source_queries.QUERIES, q.ORACLE_SQL | source_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert ours == sorted(map(str, duck.sql(f"with z as ({ORACLE_SQL[name]}) select {','.join(cols)} from z").fetchall()))


def dense(t):
    x = np.zeros(t.dims)
    for r in t.df.collect():
        x[tuple(r[:-1])] += r[-1]
    return x


def array(f, n, rank):
    u = np.zeros((n, rank))
    for r in f.collect():
        u[r["idx"]] = r["u"]
    return u


def test_rounds_equal_dense_als(spark):
    """Exact rounds equal dense ALS in NumPy from the same start; sampled ones with many draws come near it."""
    rng, dims = np.random.default_rng(1), [6, 5, 4]
    x = np.einsum("ir,jr,kr->ijk", *(rng.standard_normal((n, 2)) for n in dims))
    t = ts.Tensor(spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(x)], "i0 long, i1 long, i2 long, v double"), dims)
    u = [array(f, n, 2) for f, n in zip(als.start(t, 2, seed=4).factors, dims)]
    want = []
    for _ in range(3):
        for k, axes in enumerate(("jr,kr,ijk->ir", "ir,kr,ijk->jr", "ir,jr,ijk->kr")):
            o = [u[m] for m in range(3) if m != k]
            u[k] = np.einsum(axes, *o, x) @ np.linalg.pinv((o[0].T @ o[0]) * (o[1].T @ o[1]))
            sigma = np.linalg.norm(u[k], axis=0)
            u[k] = u[k] / sigma
        want.append(1 - np.linalg.norm(x - np.einsum("r,ir,jr,kr->ijk", sigma, *u)) / np.linalg.norm(x))
    model, trace = als.decompose(t, 2, 3, seed=4)
    fits = [r["fit"] for r in trace[1:]]
    assert np.allclose(fits, want, atol=1e-6) and fits == sorted(fits)
    assert all(np.allclose(array(f, n, 2), v, atol=1e-6) for f, n, v in zip(model.factors, dims, u))
    for how in ("product", "tree"):
        assert als.decompose(t, 2, 2, how, draws=2000, seed=4, warm_start=True)[1][-1]["fit"] > want[0] - 0.05


def test_factors_of_any_size_give_the_same_rounds(spark, monkeypatch):
    """Factors that the driver may not hold are solved where they are, with the same fits."""
    rng, dims = np.random.default_rng(6), [30, 7, 5]
    x = np.einsum("ir,jr,kr->ijk", *(rng.standard_normal((n, 2)) for n in dims))
    t = ts.Tensor(spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(x)], "i0 long, i1 long, i2 long, v double"), dims)
    for how in ("exact", "product", "tree"):
        near = als.decompose(t, 2, 2, how, draws=400, seed=4)
        for most in (40, 1):  # the first mode, and all of them
            with monkeypatch.context() as m:
                m.setattr(al, "BROADCAST_CELLS", most)
                far = als.decompose(t, 2, 2, how, draws=400, seed=4)
            assert np.allclose([r["fit"] for r in near[1]], [r["fit"] for r in far[1]], atol=1e-6), how
            assert [r["nonzeros"] for r in near[1]] == [r["nonzeros"] for r in far[1]]
            assert all(np.allclose(array(a, n, 2), array(b, n, 2), atol=1e-6) for a, b, n in zip(near[0].factors, far[0].factors, dims)), how


def test_tree_samples_follow_leverage(spark):
    m = als.start(ts.Tensor(spark.range(1), [5, 4, 3]), 3, seed=2)
    s = sp.TreeSampler(m.factors, [5, 4, 3], 3).draw(20000, 0, 1).collect()
    b, c = array(m.factors[1], 4, 3), array(m.factors[2], 3, 3)
    h = np.einsum("jr,kr->jkr", b, c).reshape(12, 3)
    p = np.einsum("ir,rs,is->i", h, np.linalg.pinv(h.T @ h), h) / 3
    seen = np.bincount([r["i1"] * 3 + r["i2"] for r in s], minlength=12) / len(s)
    assert np.abs(seen - p).max() < 0.015
    assert all(abs(r["w"] - 1 / (20000 * p[r["i1"] * 3 + r["i2"]])) < 1e-9 for r in s[:50])


def test_tree_samples_of_large_modes(spark, monkeypatch):
    """Factors that stay distributed, over several levels of blocks, give the draws that broadcast ones give."""
    dims = [5, 400, 90, 3]
    m = als.start(ts.Tensor(spark.range(1), dims), 3, seed=2)
    rows = [array(f, n, 3) for f, n in zip(m.factors, dims)]
    rows[1][100:300] = 0  # whole blocks without rows of any mass
    rows[1][17] *= 30
    m.factors[1] = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(rows[1])], "idx long, u array<double>")
    near = {r["sample_id"]: r for r in sp.TreeSampler(m.factors, dims, 3).draw(300, 0, 1).collect()}
    monkeypatch.setattr(al, "BROADCAST_CELLS", 50)
    monkeypatch.setattr(sp, "BLOCK_CELLS", 24)
    monkeypatch.setattr(sp, "TREE_CELLS", 64)
    monkeypatch.setattr(sp, "MEET", 16)
    far = sp.TreeSampler(m.factors, dims, 3)
    assert len(far.below[1]) >= 1 and 1 not in far.rows and 3 in far.rows
    got = far.draw(300, 0, 1).collect()
    assert len(got) == 300 and sum([r[f"i{k}"] for k in (1, 2, 3)] == [near[r["sample_id"]][f"i{k}"] for k in (1, 2, 3)] for r in got) >= 298
    assert not any(100 <= r["i1"] < 300 for r in got) and all(abs(r["w"] - near[r["sample_id"]]["w"]) < 1e-9 * abs(r["w"]) for r in got if r["i1"] == near[r["sample_id"]]["i1"] and r["i2"] == near[r["sample_id"]]["i2"] and r["i3"] == near[r["sample_id"]]["i3"])


def test_text_sources_and_permutation(spark, tmp_path):
    (tmp_path / "x.tns").write_text("# c\n1 2 3 1.5\n2 2 1 2\n2 2 1 4\n")
    t = ts.read_coordinates(spark, str(tmp_path / "x.tns"))
    assert t.dims == [2, 1, 3] and dense(t)[1, 0, 0] == 6 and t.coalesced().df.count() == 2
    ts.write_coordinates(t, str(tmp_path / "out"))
    assert np.array_equal(dense(ts.read_coordinates(spark, str(tmp_path / "out"))), dense(t))
    ts.write_tensor(t, str(tmp_path / "pq"))
    assert np.array_equal(dense(ts.read_tensor(spark, str(tmp_path / "pq"))), dense(t))
    assert sorted(dense(ts.permuted(t)).ravel()) == sorted(dense(t).ravel())
    (tmp_path / "e").write_text("% head\n1 2 7 86400\n")
    assert tuple(ts.read_temporal_edges(spark, str(tmp_path / "e"), 1900).first()) == (1, 2, 70, 1, 2, 1.0)
    assert ts.in_box(t.df, {"i0": (1, 2)}).count() == 2
    with pytest.raises(ValueError):
        ts.preprocess(t, "squared")


def test_rank_deficient_pinv_and_zero_columns(spark):
    f = al.cosine_factor(spark, 9, 4)  # of rank 2
    assert abs(sum(r["score"] for r in al.leverage(f, 4).collect()) - 2) < 1e-8
    unit, size = al.normalized(al.zero_factor(spark, 3, 2), 2)
    assert list(size) == [0, 0] and all(r["u"] == [0.0, 0.0] for r in unit.collect())


def test_products_over_batches_equal_expressions(spark, monkeypatch):
    f = al.gaussian_factor(spark, 50, 4, 0, 1).repartition(3)
    u, m = array(f, 50, 4), np.arange(16.0).reshape(4, 4)
    sym = m + m.T
    for most in (4, 3):
        monkeypatch.setattr(al, "SMALL_RANK", most)
        assert np.allclose(al.gram(f, 4), u.T @ u)
        both = f.withColumn("w", F.transform("u", lambda x: x * x))
        assert np.allclose(al.gram_parts(both, 4, "w"), u.T @ (u * u))
        assert np.allclose(array(al.times(f, m), 50, 4), u @ m)
        got = {r["idx"]: r["score"] for r in al.quadratic(f, sym).collect()}
        assert np.allclose([got[i] for i in range(50)], ((u @ sym) * u).sum(1))
        model = al.Kruskal([f, al.gaussian_factor(spark, 7, 4, 1, 2)], np.array([1.0, 2.0, 0.5, 3.0]), [50, 7])
        at = spark.createDataFrame([(3, 6, "x"), (49, 0, None), (50, 1, "out"), (None, 2, "out")], "i0 long, i1 long, tag string")
        hats = {r["i0"]: r["vhat"] for r in al.reconstructed(at, model).collect()}
        w = array(model.factors[1], 7, 4)
        assert set(hats) == {3, 49} and np.allclose([hats[3], hats[49]], [(model.sigma * u[3] * w[6]).sum(), (model.sigma * u[49] * w[0]).sum()])
        assert not al.gram(f.limit(0), 4).any() and al.times(f.limit(0), m).count() == 0


def test_models_traces_and_catalog(spark, tmp_path):
    from tensorloom.sources import catalog

    m = als.start(ts.Tensor(spark.range(1), [5, 4, 3]), 3, seed=2)
    als.write_model(m, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m" / "mode=1"))
    assert np.array_equal(array(back, 4, 3), array(m.factors[1], 4, 3)) and spark.read.parquet(str(tmp_path / "m" / "sigma")).count() == 3
    for trial in (0, 1):
        als.write_trace(spark, [{"round": 0, "fit": 0.25, "seconds": 0.0}, {"round": 1, "fit": 0.5, "seconds": 1.0}], str(tmp_path / "runs"), algorithm="tree", trial=str(trial))
    runs = analysis.load_runs(spark, str(tmp_path / "runs"), algorithm="tree", round=1)
    assert [r["fit"] for r in runs.collect()] == [0.5, 0.5]
    back = als.read_model(spark, str(tmp_path / "m"))
    assert back.dims == m.dims and np.array_equal(back.sigma, m.sigma) and np.array_equal(array(back.factors[2], 3, 3), array(m.factors[2], 3, 3))
    assert analysis.missing_trials(runs, 4, algorithm="tree") == [2, 3] and analysis.missing_trials(runs, 2, algorithm="exact") == [0, 1] and analysis.missing_trials(None, 1) == [0]
    assert analysis.next_trial(runs) == 2 and analysis.next_trial(runs, algorithm="exact") == 0
    with pytest.raises(ValueError):
        catalog.load(spark, SF, "none such")


def test_command_line(spark, tmp_path):
    """Trials that are there are not run again; the trace says what each phase took and how many nonzeros were met."""
    import tensorloom.__main__ as cli

    given = ["--tensor", "synthetic:40:5", "--rank", "2", "--rounds", "2", "--epoch", "1", "--output", str(tmp_path / "runs"), "--model", str(tmp_path / "m")]
    assert cli.main([*given, "--repetitions", "1"], spark) == [0] and cli.main([*given[:-2], "--repetitions", "3"], spark) == [1, 2]
    assert cli.main([*given[:-2], "--repetitions", "3"], spark) == []
    assert cli.main([*given[:-2], "--algorithm", "tree", "--draws", "50"], spark) == [0]
    runs = analysis.load_runs(spark, str(tmp_path / "runs"))
    assert runs.count() == 12 and runs.where("round > 0 and algorithm = 'exact'").select("nonzeros").distinct().count() == 1
    assert runs.where("round > 0 and algorithm = 'tree' and sampling > 0 and refresh > 0 and nonzeros > 0").count() == 2
    assert als.read_model(spark, str(tmp_path / "m")).dims == [40, 40, 40]
    assert catalog_names() == sorted(["nation_segment_month_priority", "part_supplier_month", "supplier_part_date", "user_type_hour_day"])
    assert cli.main(["--tensor", "user_type_hour_day", "--folder", SF, "--rank", "2", "--rounds", "1"], spark) == [0]
    with pytest.raises(SystemExit):
        cli.arguments(["--rank", "2"])


def catalog_names():
    from tensorloom.sources import catalog

    return sorted(catalog.CATALOG)


def test_decomposition_finds_a_planted_model(spark):
    t = ts.low_rank(spark, [30, 20, 10], 2, 5).cache()
    assert t.df.count() == 6000 and als.decompose(t, 2, 12, seed=3)[1][-1]["fit"] > 0.95
    for how in ("product", "tree"):
        fits = [r["fit"] for r in als.decompose(t, 2, 12, how, draws=3000, seed=3)[1]]
        assert fits[-1] > 0.7 and fits[-1] > fits[1] > fits[0], fits


def test_analysis(spark):
    lines = spark.createDataFrame([("its = 1 (0.5s) fit = 0.25",), ("noise",), ("its = 2 (0.25s) fit = 0.5",)], "value string")
    assert [tuple(r) for r in analysis.parse_trace(lines).orderBy("its").collect()] == [(1, 0.5, 0.25, 0.5), (2, 0.25, 0.5, 0.75)]
    runs = spark.createDataFrame([("a", [1.0, 2.0], 10.0, 1.0, 3.0)], "k string, times array<double>, nonzeros double, x double, y double")
    assert analysis.throughput(runs).first()["rate"] == 5 and analysis.roll_up(runs, ["k"], {"z": ["x", "y"]}).first()["z"] == 4
    assert analysis.mean_phases(runs, ["k"], ["x"]).first()["x"] == 1
    one = runs.select("k", F.lit(2.0).alias("seconds"))
    assert analysis.speedup(one, runs.select("k", F.lit(6.0).alias("seconds")), "k").first()["speedup"] == 3
