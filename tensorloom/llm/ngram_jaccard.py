"""N-gram Jaccard join: documents whose sets of five-word shingles have similarity 0.8 or more.

1. Shingle hashes (56 bits) of every text are packed by bucket and counted (dealt as in ``repeats``, in two steps beyond
   ``FAN`` buckets); each document gets back those that other documents have too, with the count on a coarse scale.
   Documents of which over a fifth is their own alone link with none. Hot shingles, found before by ``hot_shingles``, skip
   the buckets: they count as most frequent everywhere, so a bucket holds no more than twice its share of any one shingle.
   Any common order of shingles is right.
2. Equal sets become one class, stood for by its smallest id. Of each class, the shingles that come first by (rarity,
   hash) form the prefix: two linked sets share one in it. Classes that share such a shingle meet in its group; of groups
   with the same members one is kept.
3. Signature trees: the nodes of a group's tree hold the OR of their members' shingle bitmaps, the range of sizes and the
   component, if it is one. All candidates come from traversals of these trees, which prune node pairs by maximum possible
   overlap and by size. The first traversal goes along the tree's own edges and pairs each node's first member with its
   parent's, so that groups of copies become one component from as many pairs as members; the second, a dual traversal,
   takes all node pairs that are not yet in one component. Groups of over ``GROUP`` members are dealt out as blocks, in the
   first traversal each with the group's first member, in the second as pairs of blocks.
4. Candidates are checked on whole sets of hashes; components of the links give each document's component id.

Equality of shingles is equality of 56-bit hashes: two different sets of n shingles have a false common one with a chance of
n*n/2**56 (4e-12 for 500), and only a pair that misses the threshold by that one shingle changes.

Null and empty texts have no shingles and link with nothing; fewer than five words are one shingle. Rows that share an id
are one document, whose set is the union of theirs; rows with null ids link with none. Very long texts are one chunk each;
a document's set, and the distinct texts of one id, are held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm import text as tx
from tensorloom.llm.graph import checkpointed, components
from tensorloom.llm import repeats
from tensorloom.llm.repeats import BROADCAST_IDS, SLOT, bucket_count, from_slots, pack, pack_small, to_slots, unpack, unpack_small

SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
BITS, GROUP, FANOUT, BROADCAST_PAIRS, BROADCAST_CLASSES = 2048, 1024, 8, 200_000, 2_000_000
#: The smallest share of all occurrences that makes a shingle hot, which bounds the broadcast to 1.4 million numbers.
LEAST_SHARE = 2.0**-20


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the text of each."""
    start, end = tx.spans(buf, offs, tx.WORDS)
    units, bounds = tx.span_hashes(buf, start, end, tx.LOWER), np.searchsorted(start, offs)
    at, doc = tx.window_starts(bounds, k)
    h = tx.window_hashes(units, k)[at]
    n = np.diff(bounds)
    for size in range(1, k):
        if (few := np.flatnonzero(n == size)).size:
            h = np.r_[h, tx.mix(tx.window_hashes(units, size)[bounds[few]] + np.uint64(size))]
            doc = np.r_[doc, few]
    h = h >> np.uint64(8)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], doc[new]


def frequent(parts: Iterator[np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Every hash that is at least ``share`` of all occurrences, its count (at most a quarter of that too low), and the total.

    A Misra-Gries summary: of more than 4 / share hashes, the counts fall by that of the first one left out.
    """
    kept, total = int(4 / share), 0
    h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in parts:
        total += len(part)
        new, count = np.unique(part, return_counts=True)
        h, at = np.unique(np.r_[h, new], return_inverse=True)
        n = np.bincount(at, np.r_[n, count], len(h)).astype(np.int64)
        if len(h) > kept:
            n -= np.partition(n, -kept - 1)[-kept - 1]
            h, n = h[n > 0], n[n > 0]
    often = n >= 0.75 * share * total
    return h[often], n[often], total


def hot_shingles(slim: DataFrame, buckets: int) -> np.ndarray:
    """All shingles with at least twice ``share`` of all occurrences, over all texts; no more than 4 / 3 / share of them.

    ``share`` is a quarter of a bucket. What partitions leave out of a sum is under 1.25 times it, hence the factors.
    """
    share = max(1 / (4 * buckets), LEAST_SHARE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, total = frequent((shingles(buf, offs)[0] for _, buf, offs in tx.chunks(batches, "text", 4 << 20)), share)
        yield pa.RecordBatch.from_arrays([pa.array([None, *h.astype(np.int64).tolist()], pa.int64()), pa.array([total, *n.tolist()], pa.int64())], names=["h", "n"])

    counts = checkpointed(slim.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = (counts.where("h is null").first() or (None, 0))[1]
    hot = counts.where(F.col("h").isNotNull() & (F.col("n") > 1) & (F.col("n") >= 0.75 * share * total)).select("h").toArrow()
    return np.sort(hot.column("h").to_numpy().astype(np.uint64))


BLOCK = "bucket long, n long, ids binary, hashes binary, docs binary, sums binary"
HOT, SIGN = np.uint64(255 << 56), np.uint64(1 << 63)


def _ids(raw: bytes) -> np.ndarray:
    return (unpack(raw) - SIGN).view(np.int64)


def _edges(lo: int, hi: int, parts: int) -> np.ndarray:
    return (np.arange(lo + 1, hi, dtype=object) * (1 << 56) // parts).astype(np.uint64)


def _block(bucket: int, sign: int, h: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> tuple:
    """Ascending hashes and the document of each, by its number among the block's own (in order of id)."""
    have, local = np.unique(doc, return_inverse=True)
    own = ids[have]
    by = np.argsort(own)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return bucket, sign * len(h), pack(own[by].view(np.uint64) + SIGN), pack(h), pack_small(rank[local], 1 if len(have) < 256 else 2 if len(have) < 65536 else 4), b""


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["bucket", "n", "ids", "hashes", "docs", "sums"])


def _deal(ids: np.ndarray, h: np.ndarray, doc: np.ndarray, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of documents' sets (hashes by document), and a row with the documents' sizes and sums."""
    sums = [np.bincount(doc, minlength=len(ids)).astype(np.uint64)]
    for salt in (1, 2):
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(tx.mix(h + np.uint64(salt << 60)), dtype=np.uint64)]
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        sums.append(total[cut[1:]] - total[cut[:-1]])
    rows: list[tuple] = [(int(ids[0]) % buckets, 0, ids.tobytes(), b"", b"", np.stack(sums).tobytes())]
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    if len(hot) and len(h):
        often = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        if often.any():
            rows.append(_block(rows[0][0], -1, h[often], doc[often], ids))
            h, doc = h[~often], doc[~often]
    cuts = np.r_[0, np.searchsorted(h, _edges(0, buckets, buckets)), len(h)]
    rows += [_block(b, 1, h[cuts[b] : cuts[b + 1]], doc[cuts[b] : cuts[b + 1]], ids) for b in np.flatnonzero(np.diff(cuts)).tolist()]
    yield from _batches(rows)


def _blocks(buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, buf, offs in tx.chunks(batches, "text", 4 << 20):
            yield from _deal(table.column("id").to_numpy(), *shingles(buf, offs), buckets, hot)

    return run


def _united(buckets: int, hot: np.ndarray):
    """``_blocks`` of rows in order of id, in which rows of one id are one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for table, buf, offs in tx.chunks(batches, "text", 4 << 20):
            ids, (h, doc) = table.column("id").to_numpy(), shingles(buf, offs)
            cuts = np.flatnonzero(np.r_[True, np.diff(ids) != 0, True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if parts and ids[a] != now:
                    whole = np.unique(np.concatenate(parts))
                    yield from _deal(np.array([now]), whole, np.zeros(len(whole), np.int64), buckets, hot)
                    parts = []
                now = ids[a]
                lo, hi = np.searchsorted(doc, [a, b])
                parts = [np.unique(np.concatenate([*parts, h[lo:hi]]))]
        if parts:
            yield from _deal(np.array([now]), parts[0], np.zeros(len(parts[0]), np.int64), buckets, hot)

    return run


def _again(ranges: int, buckets: int, most: int):
    """From blocks of ranges, in order of these, to blocks of the buckets that each range is cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, now = [], 0, -1

        def out() -> Iterator[pa.RecordBatch]:
            lo, hi = now * buckets // ranges, -(-(now + 1) * buckets // ranges)
            h, of = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            ids, doc = np.unique(of, return_inverse=True)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            cuts = np.r_[0, np.searchsorted(h, _edges(lo, hi, buckets)), len(h)]
            yield from _batches([_block(lo + b, 1, h[cuts[b] : cuts[b + 1]], doc[cuts[b] : cuts[b + 1]], ids) for b in np.flatnonzero(np.diff(cuts)).tolist()])

        for batch in batches:
            for i, (part, size, ids, hashes, docs, _) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if size <= 0:
                    yield batch.slice(i, 1)
                    continue
                if held and (part != now or n >= most):
                    yield from out()
                    held, n = [], 0
                now = part
                held.append((unpack(hashes), _ids(ids)[unpack_small(docs, size)]))
                n += size
        if held:
            yield from out()

    return run


#: Sizes and sums travel to a document's slot as three values of these kinds beside its shared hashes (kind 0).
KINDS = 3


def _shared(table: pa.Table, slots: int) -> pa.Table:
    """A bucket's hashes that more than one document has, dealt back to slots of documents, with documents' own rows."""
    out_ids, out, hashes, ids = [], [], [], []
    for n, i, h, d, s in zip(*(c.combine_chunks() for c in table.columns[1:]), strict=True):
        n = n.as_py()
        i = _ids(i.as_py()) if n else np.frombuffer(i.as_py(), np.int64)
        if n < 0:
            out_ids.append(i[unpack_small(d.as_py(), -n)])
            out.append(HOT | unpack(h.as_py()))
        elif n:
            hashes.append(unpack(h.as_py()))
            ids.append(i[unpack_small(d.as_py(), n)])
        else:
            # a marker and three values, in this order, for each document: no shared hash is 0, as its scale is 8 at least
            own = np.concatenate([np.zeros((1, len(i)), np.uint64), np.frombuffer(s.as_py(), np.uint64).reshape(KINDS, -1)])
            out_ids.append(np.repeat(i, KINDS + 1))
            out.append(own.T.ravel())
    if hashes:
        h, i = np.concatenate(hashes), np.concatenate(ids)
        del hashes, ids
        order = np.argsort(h)
        h, i = h[order], i[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        df = np.diff(np.r_[first, len(h)])
        scale = np.minimum(255, 8 * np.log2(df)).astype(np.uint64)
        many = np.repeat(df > 1, df)
        out.append(np.repeat(scale << np.uint64(56), df)[many] | h[many])
        out_ids.append(i[many])
    return to_slots(np.concatenate(out_ids), np.concatenate(out), slots)


def _documents(table: pa.Table) -> pa.Table:
    """A slot's documents: id, size and sums of the set, and its shared hashes if they are 0.8 of it at least."""
    ids, _, values = from_slots(table, "<u8")
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    cuts = np.flatnonzero(np.r_[True, np.diff(ids) != 0, True]) if len(ids) else np.zeros(1, np.int64)
    rows: list[tuple] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        mine = values[a:b]
        at = int(np.flatnonzero(mine == 0)[0])
        own = mine[at + 1 : at + 1 + KINDS]
        toks = np.sort(np.delete(mine, at + np.arange(KINDS + 1)))
        n = int(own[0])
        near = n > 0 and len(toks) * DENOMINATOR >= n * NUMERATOR
        rows.append((int(ids[a]), n, int(own[1].astype(np.int64)), int(own[2].astype(np.int64)), toks.tobytes() if near else None))
    kinds = (pa.int64(),) * 4 + (pa.binary(),)
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "n", "s1", "s2", "toks"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n, tok) for each shared shingle in the prefix of a class."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            reps, sizes, toks = [], [], []
            for rep, n, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                t = np.frombuffer(t, np.uint64)
                own = n - len(t)
                keep = max(0, n - -(-n * NUMERATOR // DENOMINATOR) + 1 - own)
                toks.append(t[:keep])
                reps.append(np.full(len(toks[-1]), rep))
                sizes.append(np.full(len(toks[-1]), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64), pa.int64()) for x in (reps, sizes, [t.view(np.int64) for t in toks])], names=["rep", "n", "tok"])


def bitmap(toks: bytes) -> bytes:
    at = (np.frombuffer(toks, np.uint64) % np.uint64(BITS)).astype(np.int64)
    bits = np.zeros(BITS, np.uint8)
    bits[at] = 1
    return np.packbits(bits).tobytes()


def _levels(bits: np.ndarray, size: np.ndarray, shared: np.ndarray, comp: np.ndarray, side: np.ndarray) -> list[tuple]:
    """A signature tree over members in order, leaves first: bitmap, sizes' range, most that a bitmap hides, components, sides."""
    level = [(bits, size, size, shared - np.bitwise_count(bits).sum(1, dtype=np.int64), comp, comp, side, side)]
    while len(level[-1][1]) > 1:
        b, lo, hi, loss, c0, c1, s0, s1 = level[-1]
        cut = np.arange(0, len(lo), FANOUT)
        level.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(loss, cut), np.minimum.reduceat(c0, cut), np.maximum.reduceat(c1, cut), np.minimum.reduceat(s0, cut), np.maximum.reduceat(s1, cut)))
    return level


def _may_overlap(nodes: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which node pairs may hold a link: an overlap of 0.8 / 1.8 of the sizes' sum at least."""
    bit, lo, _, loss = nodes[:4]
    keep = np.zeros(len(a), bool)
    for i in range(0, len(a), 1 << 14):
        x, y = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
        most = np.bitwise_count(bit[x] & bit[y]).sum(1, dtype=np.int64) + np.minimum(loss[x], loss[y])
        keep[i : i + (1 << 14)] = most * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (lo[x] + lo[y])
    return keep


def edge_pairs(size: np.ndarray, shared: np.ndarray, bits: np.ndarray, first: int) -> np.ndarray:
    """Pairs of member numbers along the tree's edges: of each node's first member and its first sibling's, where they may link.

    The member ``first`` comes first of all, the others by their bitmaps, so that like ones are near each other.
    """
    order = np.lexsort((size, bits[:, 0], np.arange(len(size)) != first))
    nothing = np.zeros(len(order), np.int64)
    leaves = _levels(bits[order], size[order], shared[order], nothing, nothing)[0]
    out, step, n = [], 1, len(order)
    while step < n:
        b = np.arange(0, n, step)
        a = b - b % (step * FANOUT)
        a, b = a[a != b], b[a != b]
        ok = (np.minimum(leaves[1][a], leaves[1][b]) * DENOMINATOR >= np.maximum(leaves[1][a], leaves[1][b]) * NUMERATOR) & _may_overlap(leaves, a, b)
        out.append(np.stack([order[a[ok]], order[b[ok]]], 1))
        step *= FANOUT
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def tree_pairs(rep: np.ndarray, size: np.ndarray, shared: np.ndarray, comp: np.ndarray, bits: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Pairs of member numbers that may link, found by a dual traversal of the signature tree over the members.

    ``shared``: how many shingles the bitmap stands for; ``side`` (0 or 1): when both occur, only pairs across count.
    """
    order = np.lexsort((size, comp, side))
    level = _levels(bits[order], size[order], shared[order], comp[order], side[order])
    across = side.min() != side.max()
    a = b = np.zeros(1, np.int64)
    for depth in range(len(level) - 1, -1, -1):
        bit, lo, hi, loss, c0, c1, s0, s1 = level[depth]
        if depth < len(level) - 1:
            n = len(lo)
            kids = np.arange(FANOUT)
            a, b = (np.repeat(a * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(kids, FANOUT), len(a)), np.repeat(b * FANOUT, FANOUT * FANOUT) + np.tile(kids, len(b) * FANOUT))
            ok = (a < n) & (b < n) & (a <= b)
            a, b = a[ok], b[ok]
        # one size at least 0.8 of the other, not all of one component, and sides that differ where they must
        ok = (hi[a] * DENOMINATOR >= lo[b] * NUMERATOR) & (hi[b] * DENOMINATOR >= lo[a] * NUMERATOR)
        ok &= ~((c0[a] == c1[a]) & (c0[b] == c1[b]) & (c0[a] == c0[b]))
        if across:
            ok &= ~((s0[a] == s1[a]) & (s0[b] == s1[b]) & (s0[a] == s0[b]))
        a, b = a[ok], b[ok]
        keep = _may_overlap(level[depth], a, b)
        a, b = a[keep], b[keep]
    ok = a != b
    return np.stack([order[a[ok]], order[b[ok]]], 1)


def _edges_of(table: pa.Table) -> pa.Table:
    """The first traversal over a block of a group."""
    rep, size, shared, head = (table.column(c).to_numpy() for c in ("rep", "n", "shared", "head"))
    return _pairs(rep[edge_pairs(size, shared, _bitmaps(table), int(np.flatnonzero(rep == head[0])[0]))])


def _group(table: pa.Table) -> pa.Table:
    """The second traversal over a block or a pair of blocks of a group."""
    rep, size, shared, comp, side = (table.column(c).to_numpy() for c in ("rep", "n", "shared", "comp", "side"))
    return _pairs(rep[tree_pairs(rep, size, shared, comp, _bitmaps(table), side)])


def _bitmaps(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(table.num_rows, -1)


def _pairs(pairs: np.ndarray) -> pa.Table:
    pairs.sort(axis=1)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, an, bn, at, bt = (c.to_pylist() for c in batch.columns)
        ok = []
        for n, m, x, y in zip(an, bn, at, bt, strict=True):
            both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            ok.append(DENOMINATOR * both >= NUMERATOR * (n + m - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _check(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) that link, by their whole sets.

    Pairs counted to be few are broadcast to the sets, so that these are shuffled once less.
    """
    pairs = checkpointed(pairs)
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    one = sets.select(F.col("rep").alias("a"), F.col("n").alias("an"), F.col("toks").alias("at"))
    two = sets.select(F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("toks").alias("bt"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "an", "bn", "at", "bt").mapInArrow(_linked, "a long, b long")


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id_col, n_shingles, component_id (the smallest id reachable by links, its own included)."""
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    slots = bucket_count(docs, text_col)
    ranges, some = min(slots, repeats.FAN), slim.where("id is not null")
    hot = hot_shingles(some, slots)
    often = checkpointed(some.groupBy("id").count().where("count > 1").select("id"))
    many = often.count()
    if many:
        often = F.broadcast(often) if many <= BROADCAST_IDS else often
        blocks = some.join(often, "id", "left_anti").select("id", "text").mapInArrow(_blocks(ranges, hot), BLOCK)
        shared = some.join(often, "id", "left_semi").select("id", "text").distinct()
        blocks = blocks.union(shared.repartition("id").sortWithinPartitions("id").mapInArrow(_united(ranges, hot), BLOCK))
    else:
        blocks = some.mapInArrow(_blocks(ranges, hot), BLOCK)
    if slots > ranges:
        # a range is merged by several tasks, as any of its blocks may be merged with any other
        tasks = -(-slots // 8)
        blocks = blocks.repartition(tasks, "bucket", F.pmod(F.xxhash64("hashes"), F.lit(-(-tasks // ranges)))).sortWithinPartitions("bucket").mapInArrow(_again(ranges, slots, repeats.WINDOWS), BLOCK)
    dealt = blocks.groupBy("bucket").applyInArrow(lambda t: _shared(t, slots), SLOT)
    all_docs = checkpointed(dealt.groupBy("slot").applyInArrow(_documents, "id long, n long, s1 long, s2 long, toks binary"))
    classes = all_docs.where("toks is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    classes = checkpointed(classes)
    reps = classes.select("rep")
    reps = F.broadcast(reps) if classes.count() <= BROADCAST_CLASSES else reps
    sets = checkpointed(all_docs.join(reps, F.col("id") == F.col("rep"), "left_semi").select(F.col("id").alias("rep"), "n", "toks"))
    rows = sets.mapInArrow(_prefixes, "rep long, n long, tok long")
    # of groups with the same members, as copies make them, one is enough
    same = rows.groupBy("tok").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2"), F.min("rep").alias("head")).where("members > 1")
    count = same.groupBy("members", "x1", "x2", "head").agg(F.min("tok").alias("tok")).select("tok", "members", "head")

    @F.pandas_udf("binary")
    def bits(toks):
        import pandas as pd

        return pd.Series([bitmap(t) for t in toks], dtype=object)

    signed = sets.select(F.col("rep").alias("srep"), "n", bits("toks").alias("bits"), (F.octet_length("toks") / 8).cast("long").alias("shared"))
    groups = checkpointed(rows.select("tok", "rep").join(count, "tok"))
    blocks_of = F.ceil(F.col("members") / GROUP).cast("int")
    cut = groups.withColumn("k", blocks_of).withColumn("mine", F.pmod(F.xxhash64("rep"), "k").cast("int"))
    # first traversal: every block with the group's first member
    every = F.sequence(F.lit(0), F.col("k") - 1)
    apart = cut.withColumn("i", F.explode(F.when(F.col("rep") == F.col("head"), every).otherwise(F.array("mine"))))
    near = apart.select("tok", "i", "rep", "head").join(signed, F.col("rep") == F.col("srep")).select("tok", "i", "rep", "head", "n", "shared", "bits")
    links = checkpointed(_check(near.groupBy("tok", "i").applyInArrow(_edges_of, "a long, b long").distinct(), sets))
    comp = components(links)
    # second traversal: groups that are not yet one component
    marked = cut.join(comp, cut.rep == comp.v, "left").select("tok", "rep", "k", "mine", F.coalesce("comp", "rep").alias("comp"))
    open_ = marked.groupBy("tok").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("tok")
    members = marked.join(open_, "tok").join(signed, F.col("rep") == F.col("srep"))
    dealt_out = members.withColumn("other", F.explode(every))
    dealt_out = dealt_out.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "side": F.when(F.col("mine") > F.col("other"), 1).otherwise(0)})
    more = dealt_out.select("tok", "i", "j", "rep", "n", "shared", "comp", "side", "bits").groupBy("tok", "i", "j").applyInArrow(_group, "a long, b long").distinct()
    links = links.union(_check(more, sets))
    comp = components(links).withColumnRenamed("comp", "component")
    known = all_docs.select("id", "n", "s1", "s2").join(classes.withColumnsRenamed({"n": "cn", "s1": "cs1", "s2": "cs2"}), F.expr("n = cn and s1 = cs1 and s2 = cs2"), "left")
    final = known.join(comp, known.rep == comp.v, "left").select(F.col("id").alias("kid"), "n", F.coalesce("component", "rep", "id").alias("component_id"))
    out = slim.select("id").join(final, F.col("id") == F.col("kid"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


SQL = r"""
with recursive
w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i+4], ' ') as k from w, unnest(range(1, greatest(len(w) - 3, least(len(w) + 1, 2)))) as t(i)),
n as (select doc_id, count(*) as n from sh group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh as a join sh as b using (k) where a.doc_id <> b.doc_id group by all),
links as (select a, b from met join n as x on x.doc_id = a join n as y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, links.b from reach join links on links.a = reach.r)
select doc_id, any_value(coalesce(n.n, 0))::bigint as n_shingles, min(r)::bigint as component_id
from reach left join n using (doc_id) group by doc_id
"""
