"""Queries of the tensor operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.draws import rounded, uniform
from tensorloom.operators import algebra as al
from tensorloom.operators import sampling as sp
from tensorloom.plans import als, analysis
from tensorloom.sources import tensors as ts

DRAWS = 4000


def psm(spark: SparkSession, d: str) -> ts.Tensor:
    """part x supplier x month, counting line items."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_suppkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("m"))
    return ts.encode(items.groupBy("l_partkey", "l_suppkey", "m").agg(F.count("*").alias("n")), ["l_partkey", "l_suppkey", "m"], "n", keys=items)[0]


#: The tensor t (i0, i1, i2, v), its sizes, and cosine factors f0, f1, f2 (idx, r, u) of R columns.
T = """
raw as (select l_partkey as a, l_suppkey as b, (year(l_shipdate) * 12 + month(l_shipdate))::bigint as c, count(*)::double as v from lineitem group by 1, 2, 3),
d0 as (select a, row_number() over (order by a) - 1 as i0 from (select distinct a from raw)),
d1 as (select b, row_number() over (order by b) - 1 as i1 from (select distinct b from raw)),
d2 as (select c, row_number() over (order by c) - 1 as i2 from (select distinct c from raw)),
t as (select i0, i1, i2, v from raw join d0 using (a) join d1 using (b) join d2 using (c))"""


def factors(rank: int) -> str:
    return "".join(f",\nf{k} as (select i{k} as idx, r, cos((i{k} * {rank} + r)::double) as u from d{k}, range({rank}) as x(r))" for k in range(3))


def cosines(t: ts.Tensor, rank: int, sigma: list[float] | None = None) -> al.Kruskal:
    return al.Kruskal([al.cosine_factor(t.df.sparkSession, n, rank) for n in t.dims], np.array(sigma or [1.0] * rank), list(t.dims))


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def cells(f: DataFrame, digits: int = 6) -> DataFrame:
    return f.select("idx", F.posexplode("u").alias("r", "x")).select("idx", F.col("r").cast("long").alias("r"), rounded(F.col("x"), digits).alias("value"))


def matrix_rows(spark: SparkSession, g: np.ndarray, digits: int = 6) -> DataFrame:
    return frame(spark, [(r, s, round(float(g[r, s]), digits) + 0.0) for r in range(len(g)) for s in range(len(g))], "r long, s long, g double")


def tensor_summary(spark, d):
    t = psm(spark, d)
    out = None
    for how in ("none", "log_count", "ones"):
        p = ts.preprocess(t, how)
        one = p.df.agg(F.count("*").alias("nnz"), rounded(F.sum("v"), 4).alias("total"), rounded(F.sqrt(F.sum(F.col("v") * F.col("v"))), 4).alias("norm")).select(F.lit(how).alias("how"), "nnz", "total", "norm", *(F.lit(n).cast("long").alias(f"size{k}") for k, n in enumerate(p.dims)))
        out = one if out is None else out.union(one)
    return out


def mode_counts(spark, d):
    return al.mode_counts(psm(spark, d), 1)


def matricize(spark, d):
    return al.matricized(psm(spark, d), 1)


def cosine_init(spark, d):
    t = psm(spark, d)
    return cells(al.normalized(al.cosine_factor(spark, t.dims[0], 3), 3)[0], 8)


def mttkrp_exact(spark, d):
    t = psm(spark, d)
    return cells(al.mttkrp(t, cosines(t, 3).factors, 0, 3))


def gram_matrix(spark, d):
    return matrix_rows(spark, al.gram(al.cosine_factor(spark, psm(spark, d).dims[0], 4), 4), 5)


def hadamard_chain(spark, d):
    return matrix_rows(spark, al.hadamard([al.gram(f, 3) for f in cosines(psm(spark, d), 3).factors], 0), 4)


def reconstruct(spark, d):
    t = psm(spark, d)
    return al.reconstructed(t.df, cosines(t, 3, [1.0, 0.5, 2.0])).select("i0", "i1", "i2", rounded(F.col("vhat")).alias("vhat"))


def exact_fit(spark, d):
    t = psm(spark, d)
    return frame(spark, [(round(al.fit(t, cosines(t, 2, [0.01, 0.02])), 8),)], "fit double")


def inner_product(spark, d):
    t = psm(spark, d)
    a = cosines(t, 2, [1.0, 2.0])
    b = al.Kruskal([al.normalized(f, 2)[0] for f in a.factors], np.array([3.0, 0.5]), a.dims)
    return frame(spark, [(round(al.inner(a, b), 3),)], "value double")


def khatri_rao(spark, d):
    t = psm(spark, d)
    out = al.krp(al.cosine_factor(spark, t.dims[1], 2), al.cosine_factor(spark, t.dims[2], 2), 2)
    return out.select("i0", "i1", rounded(F.col("u")[0]).alias("x0"), rounded(F.col("u")[1]).alias("x1"))


def leverage_scores(spark, d):
    return al.leverage(al.cosine_factor(spark, psm(spark, d).dims[0], 2), 2).select("idx", rounded(F.col("score"), 9).alias("score"))


def als_step(spark, d):
    t = psm(spark, d)
    m = cosines(t, 2)
    m.factors = [al.normalized(f, 2)[0] for f in m.factors]
    als.exact_step(t, m, [al.gram(f, 2) for f in m.factors], 0)
    return cells(m.factors[0])


def _trace_of(t: ts.Tensor, *args, **kw) -> list[dict]:
    """The trace of a decomposition of ``t``, cached as long as that runs."""
    t = t.cache()
    try:
        return als.decompose(t, *args, **kw)[1]
    finally:
        t.df.unpersist()


def als_exact(spark, d):
    trace = _trace_of(psm(spark, d), 4, 3, init="gaussian", seed=3)
    return frame(spark, [(r["round"], round(r["fit"], 5)) for r in trace], "round int, fit double")


def als_sampled(spark, d, algorithm="product"):
    trace = _trace_of(psm(spark, d), 4, 2, algorithm, draws=2000, seed=3, warm_start=True)
    return frame(spark, [(r["round"], round(r["fit"], 5)) for r in trace], "round int, fit double")


def als_tree(spark, d):
    return als_sampled(spark, d, "tree")


def leverage_draws(spark, d):
    size = psm(spark, d).dims[0]
    cdf = sp.cumulative(al.leverage(al.cosine_factor(spark, size, 2), 2), size)
    draws = spark.range(DRAWS).select(F.col("id").alias("sample_id"), uniform(5, 0, F.col("id")).alias("u"))
    return sp.inverse_cdf(draws, cdf).select("sample_id", "idx", rounded(-F.log("p"), 6).alias("log_weight"))


def _samples(spark, d):
    t = psm(spark, d)
    m = cosines(t, 2)
    s = sp.distinct_samples(sp.ProductSampler(m.factors, m.dims, 2).draw(DRAWS, 0, 5), ["i1", "i2"])
    return t, m, s


def product_samples(spark, d):
    return _samples(spark, d)[2].select("i1", "i2", rounded(F.col("w"), 5).alias("w"))


def mttkrp_sampled(spark, d):
    t, m, s = _samples(spark, d)
    return cells(sp.sampled_mttkrp(t.df, sp.design(s, m.factors, m.dims, 0, 2), 0, ["i1", "i2"], 2, t.dims, DRAWS), 4)


def tree_samples(spark, d):
    t = psm(spark, d)
    m = cosines(t, 2)
    return sp.TreeSampler(m.factors, m.dims, 2).draw(DRAWS, 0, 5)


def gram_tree(spark, d):
    levels = sp.gram_tree(al.cosine_factor(spark, psm(spark, d).dims[1], 2), 2)
    h = len(levels) - 1
    return frame(spark, [(h - lv, n, r, s, round(float(g[n, r, s]), 6) + 0.0) for lv, g in enumerate(levels) for n in range(len(g)) for r in range(2) for s in range(2) if np.abs(g[n]).sum() > 0], "height int, node long, r int, s int, g double")


def synthetic_tensor(spark, d):
    return ts.synthetic(spark, 60, 6, 9).df.groupBy("i0").agg(F.count("*").alias("n"), F.sum("i1").alias("s1"), F.sum("i2").alias("s2"))


def permuted_tensor(spark, d):
    t = psm(spark, d)
    p = ts.permutation(spark, t.dims[1], 1)
    return t.df.join(p, t.df.i1 == p.old).groupBy("new").agg(F.sum("v").alias("total"))


def temporal_edges(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("u"), F.length("event_type").cast("long").alias("v"), "ts")
    return ts.temporal_modes(rows, "ts", 2000).groupBy("u", "v", "year", "month", "day").agg(F.sum("val").alias("n"))


def coordinate_semi_join(spark, d):
    t = psm(spark, d)
    probe = spark.range(5000).select(*(F.floor(uniform(3, k, F.col("id")) * n).cast("long").alias(f"i{k}") for k, n in enumerate(t.dims)))
    return probe.distinct().join(t.df, t.indices(), "left_semi")


def zero_fit(spark, d):
    t = psm(spark, d)
    return frame(spark, [(round(al.estimated_fit(t, cosines(t, 2, [0.01, 0.02]), 5000, 3), 6),)], "fit double")


def range_finder(spark, d):
    t = psm(spark, d)
    return cells(als.range_finder(t, 2, 2000, 4).factors[1])


def _trace(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy((F.col("user_id") % 7).alias("run"), F.dayofmonth("ts").cast("double").alias("seconds")).agg(F.avg("value").alias("fit"))


def running_best(spark, d):
    return analysis.running_best(_trace(spark, d)).select("run", "seconds", rounded(F.col("best")).alias("best"))


def fit_over_time(spark, d):
    return analysis.on_grid(_trace(spark, d), 50).select(F.col("k").cast("long").alias("k"), rounded(F.col("seconds")).alias("seconds"), rounded(F.col("fit")).alias("fit"))


def fit_accuracy(spark, d):
    best = _trace(spark, d).groupBy("run").agg(F.max("fit").alias("best")).withColumn("kind", F.col("run") % 2)
    return analysis.accuracy(best, ["kind"]).select("kind", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))


def load_imbalance(spark, d):
    parts = psm(spark, d).df.groupBy(F.pmod("i0", F.lit(16)).alias("part"), F.pmod("i2", F.lit(3)).alias("key")).agg(F.count("*").alias("nonzeros"))
    return analysis.imbalance(parts, "key").select("key", rounded(F.col("imbalance")).alias("imbalance"))


def part_stats(spark, d):
    parts = psm(spark, d).df.groupBy(F.pmod("i0", F.lit(16)).alias("part"), F.pmod("i2", F.lit(3)).alias("key")).agg(F.sum("v").alias("x"))
    return analysis.part_stats(parts, ["key"], "x").select("key", *(rounded(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    tensor_summary, mode_counts, matricize, cosine_init, mttkrp_exact, gram_matrix, hadamard_chain, reconstruct, exact_fit, inner_product, khatri_rao, leverage_scores,
    als_step, als_exact, als_sampled, als_tree, leverage_draws, product_samples, mttkrp_sampled, tree_samples, gram_tree, synthetic_tensor, permuted_tensor, temporal_edges,
    coordinate_semi_join, zero_fit, range_finder, running_best, fit_over_time, fit_accuracy, load_imbalance, part_stats,
)}

U = lambda seed, stream, i: f"(('0x' || substr(md5('{seed}:{stream}:' || {i}::varchar), 1, 8))::bigint / 4294967296.0::double)"
DIMS = ", dims as (select (select count(*) from d0) as n0, (select count(*) from d1) as n1, (select count(*) from d2) as n2)"
HAT = "sum({s} * a.u * b.u * c.u)"
#: Leverage scores s{k} (idx, score) of cosine factors of two columns, by the closed inverse of their Gram matrix.
LEV = "".join(f""",
w{k} as (select idx, max(u) filter (where r = 0) as x, max(u) filter (where r = 1) as y from f{k} group by idx),
g{k} as (select sum(x*x) as a, sum(x*y) as b, sum(y*y) as c from w{k}),
s{k} as (select idx, x, y, (x*x*c - 2*x*y*b + y*y*a) / (a*c - b*b) as score from w{k}, g{k})""" for k in range(3))


def _draw(k: int) -> str:
    return f""",
c{k} as (select idx, score, sum(score) over (order by idx) as hi, sum(score) over () as total from s{k}),
e{k} as (select idx, score, total, hi - score as lo from c{k}),
q{k} as (select sample_id, idx, score / total as p from (select range as sample_id, {U(5, k, 'range')} * (select max(total) from e{k}) as aim from range({DRAWS})) asof join e{k} on aim >= lo)"""


MODEL = "m as (select i0, i1, i2, v, sum(sg * a.u * b.u * c.u) as vhat from t join f0 a on a.idx = i0 join f1 b on b.idx = i1 and b.r = a.r join f2 c on c.idx = i2 and c.r = a.r join sig on sig.r = a.r group by i0, i1, i2, v)"
G3 = "".join(f", g{k} as (select a.r, b.r as s, sum(a.u * b.u) as g from f{k} a join f{k} b using (idx) group by 1, 2)" for k in range(3))
SIG2 = ", sig as (select * from (values (0, 0.01::double), (1, 0.02::double)) as x(r, sg))"
SAMPLES = LEV + _draw(1) + _draw(2) + f", smp as (select q1.idx as i1, q2.idx as i2, min(1 / ({DRAWS} * q1.p * q2.p)) * count(*) as w from q1 join q2 using (sample_id) group by 1, 2)"
TRACE = "tr as (select user_id % 7 as run, day(ts)::double as seconds, avg(value) as fit from events group by 1, 2), bs as (select *, max(fit) over (partition by run order by seconds) as best from tr)"

ORACLE_SQL: dict[str, str] = {
    "tensor_summary": "with" + T + DIMS + ", p as (select 'none' as how, v from t union all select 'log_count', ln(v + 1) from t union all select 'ones', 1.0 from t) select how, count(*) as nnz, round(sum(v), 4) as total, round(sqrt(sum(v * v)), 4) as norm, n0 as size0, n1 as size1, n2 as size2 from p, dims group by how, n0, n1, n2",
    "mode_counts": "with" + T + " select i1 as idx, count(*) as n, sum(v) as total from t group by i1",
    "matricize": "with" + T + DIMS + " select i1 as row, i0 * n2 + i2 as col, v from t, dims",
    "cosine_init": "with" + T + factors(3) + " select idx, r, round(u / sqrt(sum(u * u) over (partition by r)), 8) + 0.0 as value from f0",
    "mttkrp_exact": "with" + T + factors(3) + " select i0 as idx, b.r, round(sum(v * b.u * c.u), 6) + 0.0 as value from t join f1 b on b.idx = i1 join f2 c on c.idx = i2 and c.r = b.r group by 1, 2",
    "gram_matrix": "with" + T + factors(4) + " select a.r, b.r as s, round(sum(a.u * b.u), 5) + 0.0 as g from f0 a join f0 b using (idx) group by 1, 2",
    "hadamard_chain": "with" + T + factors(3) + G3 + " select g1.r, g1.s, round(g1.g * g2.g, 4) + 0.0 as g from g1 join g2 using (r, s)",
    "reconstruct": "with" + T + factors(3) + ", sig as (select * from (values (0, 1.0::double), (1, 0.5::double), (2, 2.0::double)) as x(r, sg)), " + MODEL + " select i0, i1, i2, round(vhat, 6) + 0.0 as vhat from m",
    "exact_fit": "with" + T + factors(2) + G3 + SIG2 + ", " + MODEL + ", n as (select sum(x.sg * y.sg * g0.g * g1.g * g2.g) as n2 from g0 join g1 using (r, s) join g2 using (r, s) join sig x on x.r = g0.r join sig y on y.r = g0.s) select round(1 - sqrt(n2 + (select sum(v * v - 2 * v * vhat) from m)) / (select sqrt(sum(v * v)) from t), 8) as fit from n",
    "inner_product": "with" + T + factors(2) + "".join(f", g{k} as (select a.r, b.r as s, sum(a.u * b.u) / sqrt((select sum(z.u * z.u) from f{k} z where z.r = b.r)) as g from f{k} a join f{k} b using (idx) group by a.r, b.r)" for k in range(3)) + " select round(sum((case r when 0 then 1.0 else 2.0 end)::double * (case s when 0 then 3.0 else 0.5 end)::double * g0.g * g1.g * g2.g), 3) as value from g0 join g1 using (r, s) join g2 using (r, s)",
    "khatri_rao": "with" + T + factors(2) + " select b.idx as i0, c.idx as i1, round(sum(b.u * c.u) filter (where b.r = 0), 6) + 0.0 as x0, round(sum(b.u * c.u) filter (where b.r = 1), 6) + 0.0 as x1 from f1 b join f2 c on c.r = b.r group by 1, 2",
    "leverage_scores": "with" + T + factors(2) + LEV + " select idx, round(score, 9) + 0.0 as score from s0",
    "als_step": "with" + T + factors(2) + "".join(f", h{k} as (select idx, r, u / sqrt(sum(u * u) over (partition by r)) as u from f{k}), k{k} as (select a.r, b.r as s, sum(a.u * b.u) as g from h{k} a join h{k} b using (idx) group by 1, 2)" for k in (1, 2))
    + ", p as (select max(k1.g * k2.g) filter (where r = 0 and s = 0) as a, max(k1.g * k2.g) filter (where r = 0 and s = 1) as b, max(k1.g * k2.g) filter (where r = 1 and s = 1) as c from k1 join k2 using (r, s)), mk as (select i0 as idx, sum(v * b.u * c.u) filter (where b.r = 0) as x, sum(v * b.u * c.u) filter (where b.r = 1) as y from t join h1 b on b.idx = i1 join h2 c on c.idx = i2 and c.r = b.r group by 1), sv as (select idx, (x * c - y * b) / (a * c - b * b) as x, (y * a - x * b) / (a * c - b * b) as y from mk, p) select idx, 0::bigint as r, round(x / sqrt(sum(x * x) over ()), 6) + 0.0 as value from sv union all select idx, 1::bigint, round(y / sqrt(sum(y * y) over ()), 6) + 0.0 from sv",
    "leverage_draws": "with" + T + factors(2) + LEV + _draw(0) + " select sample_id, idx, round(-ln(p), 6) + 0.0 as log_weight from q0",
    "product_samples": "with" + T + factors(2) + SAMPLES + " select i1, i2, round(w, 5) + 0.0 as w from smp",
    "mttkrp_sampled": "with" + T + factors(2) + SAMPLES + " select t.i0 as idx, b.r, round(sum(w * v * b.u * c.u), 4) + 0.0 as value from t join smp using (i1, i2) join f1 b on b.idx = i1 join f2 c on c.idx = i2 and c.r = b.r group by 1, 2",
    "gram_tree": "with" + T + factors(2) + ", lv as (select idx // 2 as node, a.r::int as r, b.r::int as s, sum(a.u * b.u) as g from f1 a join f1 b using (idx) group by 1, 2, 3), hs as (select range::int as h from range(60) where range = 0 or (select max(node) from lv) >> (range - 1) > 0) select h as height, node >> h as node, r, s, round(sum(g), 6) + 0.0 as g from lv, hs group by 1, 2, 3, 4",
    "synthetic_tensor": "with " + ", ".join(f"a{k} as (select range as i{k}, floor({U(9, k, 'range')} * 6)::bigint as q from range(60))" for k in range(3)) + " select i0, count(*) as n, sum(i1)::bigint as s1, sum(i2)::bigint as s2 from a0 join a1 using (q) join a2 using (q) group by i0",
    "permuted_tensor": "with" + T + f", p as (select i1, row_number() over (order by {U(42, 1, 'i1')}, i1) - 1 as new from d1) select new, sum(v) as total from t join p using (i1) group by new",
    "temporal_edges": "select user_id as u, length(event_type) as v, (year(ts) - 2000)::bigint as year, month(ts)::bigint as month, day(ts)::bigint as day, count(*)::double as n from events group by 1, 2, 3, 4, 5",
    "coordinate_semi_join": "with" + T + DIMS + ", pr as (select distinct " + ", ".join(f"floor({U(3, k, 'range')} * n{k})::bigint as i{k}" for k in range(3)) + " from range(5000), dims) select i0, i1, i2 from pr semi join t using (i0, i1, i2)",
    "zero_fit": "with" + T + factors(2) + DIMS + SIG2 + ", " + MODEL + ", pr as (select range as id, " + ", ".join(f"floor({U(3, k, 'range')} * n{k})::bigint as i{k}" for k in range(3)) + " from range(5000), dims), z as (select id, sum(sg * a.u * b.u * c.u) as vhat from (select * from pr anti join t using (i0, i1, i2)) x join f0 a on a.idx = i0 join f1 b on b.idx = i1 and b.r = a.r join f2 c on c.idx = i2 and c.r = a.r join sig on sig.r = a.r group by id), e as (select (select sum(vhat * vhat) / count(*) from z) * (n0::double * n1 * n2 - (select count(*) from m)) as rest from dims) select round(1 - sqrt((select sum((v - vhat) ** 2) from m) + rest) / (select sqrt(sum(v * v)) from t), 6) as fit from e",
    "running_best": f"with {TRACE} select run, seconds, round(best, 6) + 0.0 as best from bs",
    "fit_over_time": f"with {TRACE}, en as (select max(a) as lo, min(b) as hi from (select min(seconds) as a, max(seconds) as b from tr group by run)), gr as (select range as k, lo + range * (hi - lo) / 49 as t from range(49), en), pc as (select run, seconds, best, lead(seconds) over w as ns, lead(best) over w as nf from bs window w as (partition by run order by seconds)) select k, round(min(t), 6) + 0.0 as seconds, round(avg(best + (nf - best) * (t - seconds) / (ns - seconds)), 6) + 0.0 as fit from gr join pc on t >= seconds and t < ns group by k",
    "fit_accuracy": f"with {TRACE}, b as (select run % 2 as kind, max(fit) as best from tr group by run) select kind, round(avg(best), 6) as mean, round(stddev_pop(best), 6) as std from b group by kind",
    "load_imbalance": "with" + T + ", p as (select i2 % 3 as key, i0 % 16 as part, count(*) as n from t group by 1, 2) select key, round(max(n) / avg(n), 6) as imbalance from p group by key",
    "part_stats": "with" + T + ", p as (select i2 % 3 as key, i0 % 16 as part, sum(v) as x from t group by 1, 2) select key, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, round(min(x), 6) as min, round(max(x), 6) as max from p group by key",
}
