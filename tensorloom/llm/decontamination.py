"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Texts become word hashes; of every 6 neighbouring 5-grams the one of smallest hash is a fingerprint, so any 10 words that
a text shares with an item share a fingerprint. Stage one semi-joins the texts' distinct fingerprints with all 5-grams of
the items, which leaves candidate documents. Stage two gives candidates' fingerprints their places, joins them with the
items' places and extends each alignment (document, item, offset) over the item: runs of 10 equal words are hits. Items of
1 to 9 words are one window each and are looked up by their whole hash, for the lengths that occur.

The items' side is broadcast only if its grams were counted to be at most ``BROADCAST_ROWS``; else both sides are shuffled,
distinct per document first. Word equality is equality of 64-bit hashes; a false hit needs ten of them to collide in a row
(or, for shorter items, one joint hash).

Null and empty texts have no words: no hits. Items without words are ignored. Rows of one id have the hits of their own
texts; null ids never hit. Repeated items each count. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.storage import checkpointed

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def grams(name: str, n: int, placed: bool = False) -> Column:
    """Hashes of every n consecutive elements of the array column ``name``; the last n-1 are of fewer elements.

    placed: structs of hash and place. Arrays that lambdas refer to are columns of their own, named at least twice,
    which keeps the optimiser from copying their making into the lambda.
    """
    a = F.col(name)

    def one(x: Column, i: Column) -> Column:
        h = F.xxhash64(x, *(F.get(a, i + j) for j in range(1, n)))
        return F.struct(h.alias("h"), i.alias("p")) if placed else h

    return F.transform(a, one)


def lowest(name: str, n: int) -> Column:
    """The least of every n consecutive elements (fewer at the end)."""
    a = F.col(name)
    return F.transform(a, lambda x, i: F.least(x, *(F.get(a, i + j) for j in range(1, n))))


def _first(a: Column, n: Column) -> Column:
    return F.slice(a, 1, F.greatest(n, F.lit(0)))


def _fingerprints(rows: DataFrame, window: int, gram: int, placed: bool = False) -> DataFrame:
    """Adds column fp, the distinct winnowed grams of column w of texts of ``window`` words at least."""
    width = window - gram + 1
    out = rows.withColumn("g", grams("w", gram, placed)).withColumn("g", _first(F.col("g"), F.size("w") - (gram - 1)))
    return out.withColumn("fp", F.array_distinct(_first(lowest("g", width), F.size("g") - (width - 1))))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: id_col, n_words, n_hit, n_items, items_sha256 and contaminated."""
    # rows are told apart by id and text, so that rows of one id keep their own hits
    slim = docs.select(docs[id_col].alias("id"), F.coalesce(F.xxhash64(docs[text_col]), F.lit(0)).alias("tag"), docs[text_col].alias("t"))
    bench = items.select(items[item_col].cast("string").alias("item"), word_hashes(items[item_text_col]).alias("iw")).withColumn("n", F.size("iw"))
    long_items = bench.where(F.col("n") >= window)
    places = long_items.withColumn("g", grams("iw", GRAM)).select("item", "iw", "n", F.posexplode(_first(F.col("g"), F.col("n") - (GRAM - 1))).alias("q", "h"))
    shape = bench.agg(F.sum("n").alias("n"), F.collect_set(F.when(F.col("n").between(1, window - 1), F.col("n"))).alias("short")).first()
    small, short = (shape["n"] or 0) <= BROADCAST_ROWS, sorted(shape["short"])
    sized = F.broadcast if small else (lambda x: x)

    # one pass marks candidates: fingerprints, and whole windows of the short lengths, of one array of word hashes
    hashed = _fingerprints(slim.where("t is not null and id is not null").select("id", "tag", word_hashes(F.col("t")).alias("w")), window, GRAM)
    for n in short:
        hashed = hashed.withColumn(f"g{n}", grams("w", n)).withColumn(f"g{n}", _first(F.col(f"g{n}"), F.size("w") - (n - 1)))
    # outer: an inner one has a filter inferred that makes the arrays of every row once more, before any join
    marked = hashed.select("id", "tag", F.explode_outer(F.concat("fp", *(f"g{n}" for n in short))).alias("h"))
    whole = {n: bench.where(F.col("n") == n).select("item", grams("iw", n)[0].alias("h")) for n in short}
    known = places.select("h")
    for rows in whole.values():
        known = known.union(rows.select("h"))
    found = marked.join(sized(known.distinct()), "h", "left_semi").select(F.col("id").alias("cid"), F.col("tag").alias("ctag")).distinct()
    candidates = checkpointed(found)
    few = F.broadcast if candidates.count() <= BROADCAST_ROWS // 2 else (lambda x: x)

    # candidates alone need their texts again; of all others the number of words is all that is left to say
    again = slim.join(few(candidates), (slim.id == candidates.cid) & (slim.tag == candidates.ctag), "left_semi").select("id", "tag", word_hashes(F.col("t")).alias("w"))
    hits = _extended(again, places, sized, window)
    for n in short:
        rows = again.withColumn("g", grams("w", n)).select("id", "tag", F.posexplode_outer(_first(F.col("g"), F.size("w") - (n - 1))).alias("p", "h"))
        hits = hits.union(rows.join(sized(whole[n]), "h").select("id", "tag", "item", F.col("p").cast("int").alias("start"), F.lit(n).alias("n")))
    spans = hits.groupBy("id", "tag").agg(F.array_sort(F.collect_set(F.struct("start", F.expr("start + n").alias("end")))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    union = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    per = spans.select(F.col("id").alias("hid"), F.col("tag").alias("htag"), union.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("sha"))
    out = slim.select("id", "tag", F.size(words(F.col("t"))).cast("long").alias("n_words")).join(few(per), (F.col("id") == F.col("hid")) & (F.col("tag") == F.col("htag")), "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _extended(again: DataFrame, places: DataFrame, sized, window: int) -> DataFrame:
    """(id, tag, item, start, n) of every run of ``window`` words that the alignments of shared fingerprints extend to."""
    rows = _fingerprints(again, window, GRAM, placed=True).select("id", "tag", F.explode_outer("fp").alias("s")).select("id", "tag", "s.h", "s.p")
    pairs = rows.join(sized(places.select("item", "q", "h")), "h").select("id", "tag", "item", (F.col("p") - F.col("q")).alias("shift")).distinct()
    texts = again.withColumnsRenamed({"id": "aid", "tag": "atag"})
    side = places.select("item", "iw").where("q = 0").withColumnRenamed("item", "bitem")
    both = pairs.join(sized(side), pairs.item == side.bitem).join(texts, (F.col("id") == F.col("aid")) & (F.col("tag") == F.col("atag")))
    dw, shift = F.col("w"), F.col("shift")
    equal = F.transform("iw", lambda x, j: F.coalesce(F.when(shift + j >= 0, F.get(dw, shift + j)) == x, F.lit(False)))
    run = F.aggregate(
        F.transform("eq", lambda e, j: F.struct(e.alias("e"), j.alias("j"))),
        F.struct(F.lit(0).alias("len"), F.array().cast("array<int>").alias("out")),
        lambda a, s: F.struct(F.when(s["e"], a["len"] + 1).otherwise(0).alias("len"), F.when(s["e"] & (a["len"] + 1 >= window), F.array_append(a["out"], s["j"] - (window - 1))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"],
    )
    runs = both.select("id", "tag", "item", "shift", equal.alias("eq")).select("id", "tag", "item", "shift", run.alias("js"))
    return runs.select("id", "tag", "item", "shift", F.explode_outer("js").alias("j")).where("j is not null").select("id", "tag", "item", (F.col("shift") + F.col("j")).cast("int").alias("start"), F.lit(window).alias("n"))


SQL = r"""
with dw as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
bw as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
iwin as (select item_id, n, array_to_string(w[i:i+n-1], ' ') as k from (select *, least(len(w), 10) as n from bw where len(w) > 0), unnest(range(1, len(w) - n + 2)) as t(i)),
dwin as (select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') as k from dw, (select distinct n from iwin) as m, unnest(range(1, len(w) - n + 2)) as t(i)),
hit as (select distinct doc_id, i, n, item_id from dwin join iwin using (n, k)),
cov as (select doc_id, count(distinct i + j)::bigint as n_hit from (select distinct doc_id, i, n from hit), unnest(range(0, n)) as t(j) group by doc_id),
its as (select doc_id, count(*)::bigint as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join cov using (doc_id) left join its using (doc_id)
"""
