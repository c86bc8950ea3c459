"""Queries of sources, initialisers, samplers' parts and run analysis, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom import queries as q
from tensorloom.functions.draws import rounded
from tensorloom.functions.storage import scratch
from tensorloom.operators import algebra as al
from tensorloom.operators import sampling as sp
from tensorloom.plans import als, analysis
from tensorloom.sources import catalog
from tensorloom.sources import tensors as ts


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


# ---- sources and transforms


def catalog_summary(spark, d):
    out = None
    for name in catalog.CATALOG:
        t = catalog.load(spark, d, name)
        one = t.df.agg(F.count("*").alias("nnz"), rounded(F.sum("v"), 4).alias("total"), rounded(F.sqrt(F.sum(F.col("v") * F.col("v"))), 4).alias("norm"))
        one = one.select(F.lit(name).alias("name"), F.lit(t.order).cast("long").alias("modes"), F.lit(float(np.prod(t.dims))).alias("cells"), "nnz", "total", "norm")
        out = one if out is None else out.union(one)
    return out


def compacted_ids(spark, d):
    return ts.dictionary(spark.read.parquet(f"{d}/orders.parquet").select("o_custkey"))


def rebased_tensor(spark, d):
    """Keys that start at 7 and 2, moved to 0."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") + 7).alias("part"), (F.col("l_suppkey") + 2).alias("supplier"), "l_quantity")
    t = ts.rebased(items, ["part", "supplier"], "l_quantity")
    return t.df.groupBy("i1").agg(F.count("*").alias("n"), F.sum("i0").alias("s0"), F.sum("v").alias("total"), F.lit(t.dims[0]).cast("long").alias("size0"))


def coordinate_text(spark, d):
    """The tensor written as one-based coordinate text, read again, its values set to 1."""
    path = scratch(spark, "coordinates")
    ts.write_coordinates(q.psm(spark, d), path)
    back = ts.read_coordinates(spark, path)
    return ts.ones(back).df.join(back.df.withColumnRenamed("v", "w"), back.indices()).groupBy("i1").agg(F.sum("v").alias("ones"), F.sum("w").alias("total"), F.sum("i0").alias("s0"), F.sum("i2").alias("s2"))


def temporal_text(spark, d):
    """Events written as a temporal edge list, read again with years from 2000."""
    path = scratch(spark, "edges")
    e = _events(spark, d).select(F.concat_ws(" ", "user_id", F.length("event_type"), F.lit(3), F.unix_timestamp(F.col("ts").cast("timestamp"))))
    e.write.text(path)
    return ts.read_temporal_edges(spark, path, 2000).groupBy("u", "v", "year", "month", "day").agg(F.sum("val").alias("n"))


def edges_as_coordinates(spark, d):
    """Events written as a temporal edge list, turned into coordinate text, read again."""
    edges, path = scratch(spark, "edges"), scratch(spark, "coordinates")
    _events(spark, d).select(F.concat_ws(" ", "user_id", F.length("event_type"), F.lit(3), F.unix_timestamp(F.col("ts").cast("timestamp")))).write.text(edges)
    ts.edges_to_coordinates(spark, edges, path)
    t = ts.read_coordinates(spark, path)
    return t.df.groupBy("i0", "i4").agg(F.sum("v").alias("n"), *(F.lit(t.dims[k]).cast("long").alias(f"size{k}") for k in (1, 2, 3)))


def packet_tensor(spark, d):
    """Events as packets: users by kind by time, an archive a day and a matrix an hour."""
    rows = _events(spark, d).select("user_id", "event_type", F.dayofmonth("ts").alias("archive"), F.hour("ts").alias("slot"))
    counts = ts.packet_times(rows, "archive", "slot").groupBy("user_id", "event_type", "time").agg(F.count("*").alias("n"))
    t, dicts = ts.encode(counts, ["user_id", "event_type", "time"], "n")
    return t.df.join(dicts[2].withColumnsRenamed({"key": "time", "idx": "i2"}), "i2").groupBy("i1", "time").agg(F.sum("v").alias("n"), F.count("*").alias("users"), F.lit(t.dims[0]).cast("long").alias("size0"))


def low_rank_tensor(spark, d):
    t = ts.low_rank(spark, [40, 12, 9], 3, 6)
    return t.df.groupBy("i0").agg(F.count("*").alias("n"), rounded(F.sum("v")).alias("total"), rounded(F.sum(F.col("v") * F.col("v"))).alias("square"))


# ---- models, products and fits of more modes, initialisers


def mttkrp_five_modes(spark, d):
    t = catalog.load(spark, d, "supplier_part_date")
    return q.cells(al.mttkrp(t, q.cosines(t, 2).factors, 0, 2))


def fit_four_modes(spark, d):
    t = catalog.load(spark, d, "user_type_hour_day")
    return q.frame(spark, [(round(al.fit(t, q.cosines(t, 2, [0.01, 0.02])), 8),)], "fit double")


def gaussian_init(spark, d):
    return q.cells(al.normalized(al.gaussian_factor(spark, q.psm(spark, d).dims[0], 3, 0, 7), 3)[0], 8)


def model_norm(spark, d):
    t = q.psm(spark, d)
    m = q.cosines(t, 3, [1.0, 0.5, 2.0])
    return q.frame(spark, [(round(float(np.sqrt(al.model_norm2(m.sigma, [al.gram(f, 3) for f in m.factors]))), 6),)], "norm double")


def pinv_matrix(spark, d):
    return q.matrix_rows(spark, al.pinv(al.gram(al.cosine_factor(spark, q.psm(spark, d).dims[0], 2), 2)), 9)


# ---- many columns, and factors that are not broadcast


def mixing(rank: int) -> np.ndarray:
    """A fixed matrix: cos(r * R + s)."""
    return np.cos(np.arange(float(rank * rank)).reshape(rank, rank))


def gram_r25(spark, d):
    return q.matrix_rows(spark, al.gram(al.cosine_factor(spark, q.psm(spark, d).dims[0], 25), 25), 5)


def row_products_r16(spark, d):
    return q.cells(al.times(al.cosine_factor(spark, q.psm(spark, d).dims[0], 16), mixing(16)))


def quadratic_form_r16(spark, d):
    m = mixing(16)
    return al.quadratic(al.cosine_factor(spark, q.psm(spark, d).dims[0], 16), m + m.T).select("idx", rounded(F.col("score")).alias("score"))


def reconstruct_r16(spark, d):
    t = q.psm(spark, d)
    return al.reconstructed(t.df, q.cosines(t, 16)).select("i0", "i1", "i2", rounded(F.col("vhat")).alias("vhat"))


def fit_r16(spark, d):
    t = q.psm(spark, d)
    return q.frame(spark, [(round(al.fit(t, q.cosines(t, 16, [0.01] * 16)), 8),)], "fit double")


def mttkrp_r25(spark, d):
    t = q.psm(spark, d)
    return q.cells(al.mttkrp(t, q.cosines(t, 25).factors, 0, 25))


def mttkrp_shuffled(spark, d):
    """The product with factors that are joined by shuffles."""
    with al.broadcasting(1):
        return mttkrp_r25(spark, d)


def fit_shuffled(spark, d):
    with al.broadcasting(1):
        return fit_r16(spark, d)


def samples_shuffled(spark, d):
    """Draws from running sums that stay distributed."""
    with al.broadcasting(1):
        return q.product_samples(spark, d)


def step_shuffled(spark, d):
    """The sampled step with factors solved where they are."""
    with al.broadcasting(1):
        return sampled_step(spark, d)


def unit_columns(spark, d):
    t = q.psm(spark, d)
    return q.frame(spark, [(r, round(float(x), 6)) for r, x in enumerate(al.unit_columns(q.cosines(t, 3, [1.0, 0.5, 2.0])).sigma)], "r int, sigma double")


def exported_model(spark, d):
    """A model written and read again."""
    path, t = scratch(spark, "model"), q.psm(spark, d)
    als.write_model(q.cosines(t, 3, [1.0, 0.5, 2.0]), path)
    back = als.read_model(spark, path)
    return q.cells(back.factors[1]).select("idx", "r", (F.col("value") * F.element_at(F.lit(back.sigma.tolist()), (F.col("r") + 1).cast("int"))).alias("value"), F.lit(back.dims[0]).cast("long").alias("size0"))


# ---- samplers


def leverage_mass(spark, d):
    t = q.psm(spark, d)
    out = None
    for k, n in enumerate(t.dims):
        one = al.leverage(al.cosine_factor(spark, n, 2), 2).agg(rounded(F.sum("score")).alias("mass"), rounded(F.max("score"), 9).alias("most")).select(F.lit(k).alias("mode"), "mass", "most")
        out = one if out is None else out.union(one)
    return out


def sampled_factor_rows(spark, d):
    t, m, s = q._samples(spark, d)
    return q.cells(m.factors[2].join(s.select(F.col("i2").alias("idx")).distinct(), "idx", "left_semi"))


def sample_box(spark, d):
    s = q._samples(spark, d)[2]
    return ts.in_box(s, {"i1": (1, 6), "i2": (10, 40)}).select("i1", "i2", rounded(F.col("w"), 5).alias("w"))


def sampled_hits(spark, d):
    t, _, s = q._samples(spark, d)
    return t.df.join(s, ["i1", "i2"]).groupBy("i0").agg(F.count("*").alias("n"))


def sampled_step(spark, d):
    """One sampled least-squares step: the solved factor, its columns of unit length."""
    t = q.psm(spark, d)
    m = q.cosines(t, 2)
    als.sampled_step(t, m, sp.ProductSampler(m.factors, m.dims, 2), 0, q.DRAWS, 5)
    return q.cells(m.factors[0], 5)


# ---- run analysis, over runs made of the events


def _runs(spark, d):
    phases = {"sampling": "view", "mttkrp": "click", "allgather": "signup", "reduce_scatter": "error", "solve": "purchase"}
    kind = F.col("event_type")
    return _events(spark, d).groupBy((F.col("user_id") % 7).alias("run"), F.dayofmonth("ts").alias("trial")).agg(*(F.sum(F.when(kind == v, F.col("value")).otherwise(0.0)).alias(p) for p, v in phases.items()), F.count("*").alias("nonzeros"))


def mean_phases(spark, d):
    names = ["sampling", "mttkrp", "allgather"]
    return analysis.mean_phases(_runs(spark, d), ["run"], names).select("run", *(rounded(F.col(c)).alias(c) for c in names))


def phase_roll_up(spark, d):
    groups = {"communication": ["allgather", "reduce_scatter"], "computing": ["sampling", "mttkrp", "solve"]}
    return analysis.roll_up(_runs(spark, d), ["run", "trial"], groups).select("run", "trial", *(rounded(F.col(c)).alias(c) for c in groups))


def run_throughput(spark, d):
    runs = _runs(spark, d).groupBy("run").agg(F.sum("nonzeros").alias("nonzeros"), F.transform(F.sort_array(F.collect_list(F.struct("trial", (F.col("mttkrp") + 1.0).alias("s")))), lambda x: x["s"]).alias("times"))
    return analysis.throughput(runs).select("run", rounded(F.col("rate")).alias("rate"))


def iteration_speedup(spark, d):
    per = _runs(spark, d).groupBy("trial", (F.col("run") % 2).alias("kind")).agg(F.sum("mttkrp").alias("seconds"))
    out = analysis.speedup(per.where("kind = 1"), per.where("kind = 0"), "trial")
    return out.select("trial", rounded(F.col("speedup")).alias("speedup"))


def parsed_trace(spark, d):
    days = _events(spark, d).groupBy(F.dayofmonth("ts").alias("its")).agg(F.count("*").alias("n"))
    lines = days.select(F.format_string("  its = %3d (%d.5s)  fit = %.5f  delta = +1e-3", "its", "n", F.col("n") / 100000).alias("value"))
    out = analysis.parse_trace(lines.union(spark.createDataFrame([("Factoring",), ("",)], "value string")))
    return out.select("its", "seconds", rounded(F.col("fit")).alias("fit"), "elapsed")


def segmented_traces(spark, d):
    """Trace files with a segment for each rank, of which those of one program count."""
    days = _events(spark, d).groupBy((F.col("user_id") % 2).alias("file"), (F.col("user_id") % 5).alias("k"), F.dayofmonth("ts").alias("its")).agg(F.count("*").alias("n"))
    line = F.format_string("  its = %3d (%d.5s)  fit = %.5f  delta = +1e-3", "its", "n", F.col("n") / 1e8)
    head = F.when(F.col("k") == 4, F.lit("another program")).otherwise(F.format_string("factor v1\nNFACTORS=%d MAXITS=40", (F.col("k") + 1) * 10))
    parts = days.groupBy("file", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("its", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines")).withColumn("part", F.concat(head, F.lit("\n"), "lines"))
    texts = parts.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "\n" + "*" * 70 + "\n").alias("value"))
    return analysis.parse_traces(texts, "file", "factor v1").select("file", "rank", "its", "seconds", rounded(F.col("fit"), 5).alias("fit"), "elapsed")


def decomposed_runs(spark, d):
    """Two trials of an exact decomposition: what their traces say after writing and loading."""
    path, t = scratch(spark, "runs"), q.psm(spark, d).cache()
    for trial in (0, 2):
        als.write_trace(spark, als.decompose(t, 2, 2, seed=trial + 1)[1], path, trial=trial, algorithm="exact")
    t.df.unpersist()
    runs = analysis.load_runs(spark, path, algorithm="exact")
    left = analysis.missing_trials(runs, 4, algorithm="exact")
    whole = analysis.mean_phases(runs, ["trial", "round"], [*als.PHASES, "seconds", "nonzeros"])
    spent = sum((F.col(p) for p in ("sampling", "product", "refresh")), F.lit(0.0))
    return whole.select("trial", "round", F.col("nonzeros").cast("long").alias("nonzeros"), (F.col("seconds") + 1e-4 >= spent).alias("adds_up"), F.lit(",".join(map(str, left))).alias("missing"))


def final_fits(spark, d):
    best = q._trace(spark, d).groupBy("run", (F.col("seconds") % 3).cast("int").alias("draws")).agg(F.max("fit").alias("best"))
    out = analysis.final_fits(best, "draws")
    return out.select("draws", F.size("fits").cast("long").alias("n"), *(rounded(F.col("quartiles")[k]).alias(n) for k, n in enumerate(("q1", "q2", "q3"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    catalog_summary, compacted_ids, rebased_tensor, coordinate_text, temporal_text, mttkrp_five_modes, fit_four_modes, gaussian_init, model_norm, pinv_matrix, leverage_mass,
    edges_as_coordinates, packet_tensor, low_rank_tensor, gram_r25, row_products_r16, quadratic_form_r16, reconstruct_r16, fit_r16, mttkrp_r25, mttkrp_shuffled, fit_shuffled,
    samples_shuffled, step_shuffled, unit_columns, exported_model, segmented_traces, decomposed_runs,
    sampled_factor_rows, sample_box, sampled_hits, sampled_step, mean_phases, phase_roll_up, run_throughput, iteration_speedup, parsed_trace, final_fits,
)}

#: The rows of each named tensor: mode expressions, source, value.
RAW = {
    "part_supplier_month": (["l_partkey", "l_suppkey", "year(l_shipdate) * 12 + month(l_shipdate)"], "lineitem", "ln(count(*) + 1)"),
    "nation_segment_month_priority": (["c_nationkey", "c_mktsegment", "year(o_orderdate) * 12 + month(o_orderdate)", "o_orderpriority"], "orders join customer on o_custkey = c_custkey", "count(*)::double"),
    "user_type_hour_day": (["user_id", "event_type", "hour(ts)", "day(ts)"], "events", "count(*)::double"),
    "supplier_part_date": (["l_suppkey", "l_partkey", "year(l_shipdate)", "month(l_shipdate)", "day(l_shipdate)"], "lineitem", None),
}


def raw(name: str, alias: str) -> str:
    modes, source, value = RAW[name]
    cols = ", ".join(f"{e} as a{k}" for k, e in enumerate(modes))
    return f"{alias} as (select {cols}, {value or '1.0::double'} as v from {source}" + (f" group by {', '.join(map(str, range(1, len(modes) + 1)))})" if value else ")")


def tensor(name: str) -> str:
    """The tensor t (i0, .., v) of a named one, and cosine factors f0, .. of two columns."""
    n = len(RAW[name][0])
    ids = "".join(f", d{k} as (select a{k}, row_number() over (order by a{k}) - 1 as i{k} from (select distinct a{k} from raw))" for k in range(n))
    joins = "".join(f" join d{k} using (a{k})" for k in range(n))
    return f"with {raw(name, 'raw')}{ids}, t as (select {', '.join(f'i{k}' for k in range(n))}, v from raw{joins})" + "".join(f", f{k} as (select i{k} as idx, r, cos((i{k} * 2 + r)::double) as u from d{k}, range(2) as x(r))" for k in range(n))


def hat(modes: list[int]) -> str:
    """Joins of factors f{k} as b{k} to t, all of one column r."""
    return "".join(f" join f{k} b{k} on b{k}.idx = i{k}" + (f" and b{k}.r = b{modes[0]}.r" if k != modes[0] else "") for k in modes)


def normal(seed: int, stream: str, i: str) -> str:
    u, v = (f"(('0x' || substr(md5('{seed}:' || {stream} || '{x}:' || {i}::varchar), 1, 8))::bigint / 4294967296.0::double)" for x in "ab")
    return f"sqrt(-2.0::double * ln(1.0::double - {u})) * cos(2 * 3.141592653589793::double * {v})"


def _grams(n: int) -> str:
    return "".join(f", g{k} as (select a.r, b.r as s, sum(a.u * b.u) as g from f{k} a join f{k} b using (idx) group by 1, 2)" for k in range(n))


T2 = "with" + q.T + q.factors(2)
RUNS = "with rn as (select user_id % 7 as run, day(ts)::int as trial, " + ", ".join(f"sum(case when event_type = '{e}' then value else 0 end) as {p}" for p, e in (("sampling", "view"), ("mttkrp", "click"), ("allgather", "signup"), ("reduce_scatter", "error"), ("solve", "purchase"))) + ", count(*) as nonzeros from events group by 1, 2)"

ORACLE_SQL: dict[str, str] = {
    "catalog_summary": "with " + ", ".join(raw(n, f"t{i}") for i, n in enumerate(RAW)) + " " + " union all ".join(f"select '{n}' as name, {len(m)}::bigint as modes, ({' * '.join(f'count(distinct a{k})::double' for k in range(len(m)))}) as cells, count(*) as nnz, round(sum(v), 4) as total, round(sqrt(sum(v * v)), 4) as norm from t{i}" for i, (n, (m, _, _)) in enumerate(RAW.items())),
    "compacted_ids": "select o_custkey as key, row_number() over (order by o_custkey) - 1 as idx from (select distinct o_custkey from orders)",
    "rebased_tensor": "with x as (select l_partkey + 7 as a, l_suppkey + 2 as b, l_quantity as v from lineitem), e as (select min(a) as a0, max(a) as a1, min(b) as b0 from x) select b - b0 as i1, count(*) as n, sum(a - a0)::bigint as s0, sum(v) as total, a1 - a0 + 1 as size0 from x, e group by b, b0, a0, a1",
    "coordinate_text": "with" + q.T + " select i1, count(*)::double as ones, sum(v) as total, sum(i0)::bigint as s0, sum(i2)::bigint as s2 from t group by i1",
    "temporal_text": q.ORACLE_SQL["temporal_edges"],
    "mttkrp_five_modes": tensor("supplier_part_date") + " select i0 as idx, b1.r, round(sum(v * b1.u * b2.u * b3.u * b4.u), 6) + 0.0 as value from t" + hat([1, 2, 3, 4]) + " group by 1, 2",
    "fit_four_modes": tensor("user_type_hour_day") + _grams(4) + q.SIG2 + ", m as (select i0, i1, i2, i3, v, sum(sg * b0.u * b1.u * b2.u * b3.u) as vhat from t" + hat([0, 1, 2, 3]) + " join sig on sig.r = b0.r group by all), n as (select sum(x.sg * y.sg * g0.g * g1.g * g2.g * g3.g) as n2 from g0 join g1 using (r, s) join g2 using (r, s) join g3 using (r, s) join sig x on x.r = g0.r join sig y on y.r = g0.s) select round(1 - sqrt(n2 + (select sum(v * v - 2 * v * vhat) from m)) / (select sqrt(sum(v * v)) from t), 8) as fit from n",
    "gaussian_init": "with" + q.T + f", g as (select i0 as idx, r, {normal(7, chr(39) + '0.' + chr(39) + ' || r::varchar || ' + chr(39) + chr(39), 'i0')} as u from d0, range(3) as x(r)) select idx, r, round(u / sqrt(sum(u * u) over (partition by r)), 8) + 0.0 as value from g",
    "model_norm": "with" + q.T + q.factors(3) + q.G3 + ", sig as (select * from (values (0, 1.0::double), (1, 0.5::double), (2, 2.0::double)) as x(r, sg)) select round(sqrt(sum(x.sg * y.sg * g0.g * g1.g * g2.g)), 6) as norm from g0 join g1 using (r, s) join g2 using (r, s) join sig x on x.r = g0.r join sig y on y.r = g0.s",
    "pinv_matrix": T2 + q.LEV + " select r, s, round(case when r <> s then -b when r = 0 then c else a end / (a * c - b * b), 9) + 0.0 as g from g0, range(2) as x(r), range(2) as y(s)",
    "leverage_mass": T2 + q.LEV + " " + " union all ".join(f"select {k} as mode, round(sum(score), 6) as mass, round(max(score), 9) as most from s{k}" for k in range(3)),
    "sampled_factor_rows": T2 + q.SAMPLES + " select idx, r, round(u, 6) + 0.0 as value from f2 where idx in (select i2 from smp)",
    "sample_box": T2 + q.SAMPLES + " select i1, i2, round(w, 5) + 0.0 as w from smp where i1 >= 1 and i1 < 6 and i2 >= 10 and i2 < 40",
    "sampled_hits": T2 + q.SAMPLES + " select i0, count(*) as n from t join smp using (i1, i2) group by i0",
    "sampled_step": T2 + q.SAMPLES + ", hs as (select i1, i2, w, w1.x * w2.x as x, w1.y * w2.y as y from smp join w1 on w1.idx = i1 join w2 on w2.idx = i2), hg as (select sum(w * x * x) as a, sum(w * x * y) as b, sum(w * y * y) as c from hs), mk as (select i0, sum(w * v * x) as x, sum(w * v * y) as y from t join hs using (i1, i2) group by i0), sv as (select d0.i0 as idx, coalesce(mk.x * hg.c - mk.y * hg.b, 0) / (hg.a * hg.c - hg.b * hg.b) as x, coalesce(mk.y * hg.a - mk.x * hg.b, 0) / (hg.a * hg.c - hg.b * hg.b) as y from d0 left join mk using (i0), hg) select idx, 0::bigint as r, round(x / sqrt(sum(x * x) over ()), 5) + 0.0 as value from sv union all select idx, 1::bigint, round(y / sqrt(sum(y * y) over ()), 5) + 0.0 from sv",
    "mean_phases": RUNS + " select run, round(avg(sampling), 6) as sampling, round(avg(mttkrp), 6) as mttkrp, round(avg(allgather), 6) as allgather from rn group by run",
    "phase_roll_up": RUNS + " select run, trial, round(allgather + reduce_scatter, 6) as communication, round(sampling + mttkrp + solve, 6) as computing from rn",
    "run_throughput": RUNS + " select run, round(sum(nonzeros) / (arg_max(mttkrp, trial) + 1), 6) as rate from rn group by run",
    "iteration_speedup": RUNS + ", p as (select trial, run % 2 as kind, sum(mttkrp) as seconds from rn group by 1, 2) select trial, round(b.seconds / nullif(a.seconds, 0), 6) as speedup from p a join p b using (trial) where a.kind = 1 and b.kind = 0",
    "parsed_trace": "with x as (select day(ts)::int as its, count(*) as n from events group by 1) select its, n + 0.5::double as seconds, round(n / 100000.0::double, 6) as fit, sum(n + 0.5::double) over (order by its) as elapsed from x",
    "final_fits": f"with {q.TRACE}, b as (select run, (seconds % 3)::int as draws, max(fit) as best from tr group by 1, 2) select draws, count(*) as n, " + ", ".join(f"round(quantile_cont(best, {p}), 6) as {n}" for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))) + " from b group by draws",
}

_MIX = "cos((r * 16 + s)::double)"
_SIG = lambda rank, x: f", sig as (select range as r, {x}::double as sg from range({rank})), "
_HEAVY = lambda k, n: f"a{k} as (select range as i{k}, r, ({q.U(6, f'{k}.' + chr(39) + ' || r || ' + chr(39), 'range')} - 0.5) * case when {q.U(6, f'heavy{k}', 'range')} < 0.1 then 8.0 else 1.0 end as u from range({n}), range(3) as x(r))"
ORACLE_SQL |= {
    "edges_as_coordinates": "with e as (select user_id as u, length(event_type) as v, day(ts) as dd, month(ts) as mm, year(ts) as yy from events), x as (select min(u) as u0, min(dd) as d0, max(v) - min(v) + 1 as size1, max(yy) - min(yy) + 1 as size2, max(mm) - min(mm) + 1 as size3 from e) select u - u0 as i0, (dd - d0)::bigint as i4, count(*)::double as n, size1::bigint as size1, size2::bigint as size2, size3::bigint as size3 from e, x group by all",
    "packet_tensor": "with e as (select user_id, event_type, (day(ts) * 64 + hour(ts))::bigint as time, count(*)::double as n from events group by 1, 2, 3), k as (select event_type, row_number() over (order by event_type) - 1 as i1 from (select distinct event_type from e)) select i1, time, sum(n) as n, count(*) as users, (select count(distinct user_id) from e) as size0 from e join k using (event_type) group by i1, time",
    "low_rank_tensor": "with " + ", ".join(_HEAVY(k, n) for k, n in enumerate((40, 12, 9))) + ", v as (select i0, i1, i2, sum(a0.u * a1.u * a2.u) as v from a0 join a1 using (r) join a2 using (r) group by 1, 2, 3) select i0, count(*) as n, round(sum(v), 6) + 0.0 as total, round(sum(v * v), 6) + 0.0 as square from v group by i0",
    "gram_r25": "with" + q.T + q.factors(25) + " select a.r, b.r as s, round(sum(a.u * b.u), 5) + 0.0 as g from f0 a join f0 b using (idx) group by 1, 2",
    "row_products_r16": "with" + q.T + q.factors(16) + f", m as (select x.r, y.s, {_MIX} as m from range(16) as x(r), range(16) as y(s)) select idx, s as r, round(sum(u * m), 6) + 0.0 as value from f0 join m using (r) group by 1, 2",
    "quadratic_form_r16": "with" + q.T + q.factors(16) + f", m as (select x.r, y.s, cos((r * 16 + s)::double) + cos((s * 16 + r)::double) as m from range(16) as x(r), range(16) as y(s)) select a.idx, round(sum(a.u * m * b.u), 6) + 0.0 as score from f0 a join m using (r) join f0 b on b.idx = a.idx and b.r = m.s group by 1",
    "reconstruct_r16": "with" + q.T + q.factors(16) + _SIG(16, 1.0) + q.MODEL + " select i0, i1, i2, round(vhat, 6) + 0.0 as vhat from m",
    "fit_r16": "with" + q.T + q.factors(16) + q.G3 + _SIG(16, 0.01) + q.MODEL + ", n as (select sum(x.sg * y.sg * g0.g * g1.g * g2.g) as n2 from g0 join g1 using (r, s) join g2 using (r, s) join sig x on x.r = g0.r join sig y on y.r = g0.s) select round(1 - sqrt(n2 + (select sum(v * v - 2 * v * vhat) from m)) / (select sqrt(sum(v * v)) from t), 8) as fit from n",
    "mttkrp_r25": "with" + q.T + q.factors(25) + " select i0 as idx, b.r, round(sum(v * b.u * c.u), 6) + 0.0 as value from t join f1 b on b.idx = i1 join f2 c on c.idx = i2 and c.r = b.r group by 1, 2",
    "samples_shuffled": q.ORACLE_SQL["product_samples"], "step_shuffled": ORACLE_SQL["sampled_step"],
    "unit_columns": "with" + q.T + q.factors(3) + " select r::int as r, round((case r when 0 then 1.0 when 1 then 0.5 else 2.0 end)::double * sqrt(a.n * b.n * c.n), 6) as sigma from " + " join ".join(f"(select r, sum(u * u) as n from f{k} group by r) {x}" + (" using (r)" if k else "") for k, x in enumerate("abc")),
    "exported_model": "with" + q.T + q.factors(3) + " select idx, r, (round(u, 6) + 0.0) * (case r when 0 then 1.0 when 1 then 0.5 else 2.0 end)::double as value, (select count(*) from d0) as size0 from f1",
    "segmented_traces": "with x as (select user_id % 2 as file, user_id % 5 as k, day(ts)::int as its, count(*) as n from events group by 1, 2, 3) select file, ((k + 1) * 10)::int as rank, its, n + 0.5::double as seconds, round(n / 1e8::double, 5) + 0.0 as fit, sum(n + 0.5::double) over (partition by file, k order by its) as elapsed from x where k <> 4",
    "decomposed_runs": "with" + q.T + " select trial::bigint as trial, round::bigint as round, case when round = 0 then 0 else 3 * (select count(*) from t) end as nonzeros, true as adds_up, '1,3' as missing from (values (0), (2)) as x(trial), (values (0), (1), (2)) as y(round)",
}
ORACLE_SQL |= {"mttkrp_shuffled": ORACLE_SQL["mttkrp_r25"], "fit_shuffled": ORACLE_SQL["fit_r16"]}

#: A start from random combinations of uniformly drawn fibres of mode 1, in SQL.
_RANGE = f", rs as (select range as id, floor({q.U(4, 'f1.0', 'range')} * n0)::bigint as i0, floor({q.U(4, 'f1.2', 'range')} * n2)::bigint as i2 from range(2000), dims)"
RANGE_FINDER_SQL = "with" + q.T + q.DIMS + _RANGE + ", mk as (select i1 as idx, r, sum(v * h) as u from t join (select *, " + normal(4, "'g1.' || r::varchar || ''", "id") + " as h from rs, range(2) as x(r)) using (i0, i2) group by 1, 2) select i1 as idx, d.r, round(coalesce(u, 0) / sqrt(sum(u * u) over (partition by d.r)), 6) + 0.0 as value from (select i1, r from d1, range(2) as x(r)) d left join mk on mk.idx = i1 and mk.r = d.r"
ORACLE_SQL["range_finder"] = RANGE_FINDER_SQL
