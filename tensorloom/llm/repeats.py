"""Windows of units (words, lines) that occur earlier in the corpus, found by a shuffle of packed hashes.

Every window of k consecutive units of every text gets a 64-bit Rabin-Karp hash. A map over chunks of texts keeps, for
each hash, its earliest window among about ``WINDOWS`` windows (the others are repeats already) and packs these by range of
the hash: sorted, as differences, in as few bytes as hold them, with a place of 3 or 4 bytes and the documents that the
block has windows of. So a window that a third of all texts share is sent once per chunk, and no bucket grows with one hot
hash. Each bucket finds the hashes of more than one block, keeps the earliest by (id, start) and reports the other starts
to their documents. Buckets hold about ``BUCKET_BYTES`` of text each, so their number follows the input; beyond ``FAN`` of
them, hashes are dealt in two steps, to ``FAN`` ranges first and from those, merged to long blocks again, to buckets, so
that blocks stay long however many buckets there are.

Equal 64-bit hashes count as equal windows: over n windows about n*n/2**65 pairs are expected to differ (0.0006 for 10**8
windows, 2.7 for 10**10).

Rows with a null id or text have no windows. Rows that share an id are documents of their own, in order of a hash of the
row; of rows that are equal in all columns the first stays and the others are repeats throughout, so that nothing that
occurs once is lost and one copy of everything else is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm import text as tx
from tensorloom.llm.graph import checkpointed, fresh

BUCKET_BYTES = 16 << 20
#: Windows that blocks are cut from together; buckets, or ranges of buckets, that one step deals to.
WINDOWS, FAN = 1_000_000, 2048


@dataclass(frozen=True)
class Units:
    """What a window consists of. ``lines``: whole lines, and windows of blank lines only are none; else words."""

    k: int
    lines: bool = False

    def cut(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units' starts and ends, and each text's offsets in them."""
        if self.lines:
            start, end, doc = tx.line_spans(buf, offs)
            return start, end, np.searchsorted(doc, np.arange(len(offs)))
        start, end = tx.spans(buf, offs, tx.WORDS)
        return start, end, np.searchsorted(start, offs)

    def windows(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first unit and text of every window, and the texts' unit offsets."""
        start, end, bounds = self.cut(buf, offs)
        at, doc = tx.window_starts(bounds, self.k)
        if not len(at):
            return np.zeros(0, np.uint64), at, doc, bounds
        if self.lines:
            full = np.searchsorted(words := tx.spans(buf, offs, tx.WORDS)[0], end) > np.searchsorted(words, start)
            some = np.flatnonzero(np.convolve(full, np.ones(self.k, int))[self.k - 1 :][at] > 0)
            at, doc = at[some], doc[some]
        return tx.window_hashes(tx.span_hashes(buf, start, end), self.k)[at], at, doc, bounds


def pack(x: np.ndarray) -> bytes:
    """Ascending uint64 as differences in the fewest whole bytes; the first byte tells how many."""
    d = np.diff(x, prepend=np.uint64(0))
    d[0] = 0
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([width]) + x[:1].tobytes() + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(b: bytes) -> np.ndarray:
    width, first = b[0], np.frombuffer(b, np.uint64, 1, 1)
    planes = np.frombuffer(b, np.uint8, offset=9).reshape(width, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :width] = planes.T
    d = d.view(np.uint64).ravel()
    d[0] = first[0]
    return np.cumsum(d, dtype=np.uint64)


def pack_small(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def unpack_small(b: bytes, n: int) -> np.ndarray:
    d = np.zeros((n, 4), np.uint8)
    d[:, : len(b) // max(n, 1)] = np.frombuffer(b, np.uint8).reshape(-1, n).T
    return d.view("<u4").ravel().astype(np.int64)


def cut_binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[cuts[i]:cuts[i+1]] as rows of a binary column."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def bucket_count(docs: DataFrame, text_col: str) -> int:
    """Buckets of about BUCKET_BYTES of text, and no fewer than shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


@dataclass
class Found:
    """Windows (hash, document number, first unit) of documents (id, tag, number of units)."""

    h: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    ids: np.ndarray
    tags: np.ndarray
    sizes: np.ndarray


def _joined(parts: list[Found]) -> Found:
    base = np.cumsum([0, *(len(p.ids) for p in parts[:-1])])
    doc = np.concatenate([p.doc + n for p, n in zip(parts, base, strict=True)])
    return Found(*(np.concatenate([getattr(p, c) for p in parts]) if c != "doc" else doc for c in ("h", "doc", "start", "ids", "tags", "sizes")))


BLOCK = "part long, n long, ids binary, tags binary, bounds binary, hashes binary, places binary"
BLOCK_KINDS = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
SIGN = np.uint64(1 << 63)


def _deal(w: Found, edge: np.ndarray, base: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK: the earliest window of each hash by part (``base`` plus the number of edges below), and all others' starts."""
    by = np.lexsort((w.tags, w.ids))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    ids, tags, sizes = w.ids[by], w.tags[by], w.sizes[by]
    key = rank[w.doc] << 32 | w.start  # windows in order of (id, tag, start)
    h = w.h
    if (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, h = key[order], h[order]
    order = np.argsort(h, kind="stable")
    h, key = h[order], key[order]
    again = np.r_[False, h[1:] == h[:-1]]
    rows: list[tuple] = []
    tagged = bool(tags.any())
    if again.any():
        late = np.sort(key[again])
        doc = late >> 32
        cuts = np.flatnonzero(np.r_[True, np.diff(doc) > 0, True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            d = doc[a]
            rows.append((int(ids[d]) % parts, 0, pack((ids[d : d + 1].view(np.uint64)) + SIGN), tags[d : d + 1].tobytes() if tagged else b"", b"", b"", (late[a:b] & 0xFFFFFFFF).astype("<u4").tobytes()))
    h, key = h[~again], key[~again]
    cuts = np.r_[0, np.searchsorted(h, edge), len(h)]
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = int(cuts[b]), int(cuts[b + 1])
        # places count the units of the block's own documents only, so that a block is as long as its windows
        have, local = np.unique(key[lo:hi] >> 32, return_inverse=True)
        ends = np.r_[0, np.cumsum(sizes[have])]
        place = (key[lo:hi] & 0xFFFFFFFF) + ends[local]
        rows.append((base + b, hi - lo, pack(ids[have].view(np.uint64) + SIGN), tags[have].tobytes() if tagged else b"", pack(ends.astype(np.uint64)), pack(h[lo:hi]), pack_small(place, 3 if ends[-1] < 1 << 24 else 4)))
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), BLOCK_KINDS, strict=True)], names=["part", "n", "ids", "tags", "bounds", "hashes", "places"])


def _edges(lo: int, hi: int, parts: int) -> np.ndarray:
    """Where ranges ``lo`` + 1 to ``hi`` - 1 of ``parts`` equal ones of all hashes begin."""
    return (np.arange(lo + 1, hi, dtype=object) * (1 << 64) // parts).astype(np.uint64)


def _from_texts(units: Units, parts: int, windows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the high bits choose the part, so that parts are ranges and blocks stay sorted
        edge, held, n = _edges(0, parts, parts), [], 0
        for table, buf, offs in tx.chunks(batches, "text"):
            h, at, doc, bounds = units.windows(buf, offs)
            some, doc = np.unique(doc, return_inverse=True)
            if not len(h):
                continue
            start = at - bounds[some][doc]
            held.append(Found(h, doc, start, table.column("id").to_numpy()[some], table.column("tag").to_numpy()[some], (bounds[1:] - bounds[:-1])[some]))
            n += len(h)
            if n >= windows:
                yield from _deal(_joined(held), edge, 0, parts)
                held, n = [], 0
        if held:
            yield from _deal(_joined(held), edge, 0, parts)

    return run


def _documents(ids: bytes, tags: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = (unpack(ids) - SIGN).view(np.int64)
    return ids, np.frombuffer(tags, np.int64) if tags else np.zeros(len(ids), np.int64)


def _unblocked(n: int, ids: bytes, tags: bytes, bounds: bytes, hashes: bytes, places: bytes) -> Found:
    ids, tags = _documents(ids, tags)
    bounds, at = unpack(bounds).astype(np.int64), unpack_small(places, n)
    doc = np.searchsorted(bounds, at, "right") - 1
    return Found(unpack(hashes), doc, at - bounds[doc], ids, tags, np.diff(bounds))


def _again(ranges: int, parts: int, windows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From blocks of ranges, in order of these, to blocks of the parts that each range is cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, now = [], 0, -1

        def out() -> Iterator[pa.RecordBatch]:
            lo, hi = now * parts // ranges, -(-(now + 1) * parts // ranges)
            yield from _deal(_joined(held), _edges(lo, hi, parts), lo, parts)

        for batch in batches:
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if not row[1]:
                    yield batch.slice(i, 1)
                    continue
                if held and (row[0] != now or n >= windows):
                    yield from out()
                    held, n = [], 0
                now = row[0]
                held.append(_unblocked(*row[1:]))
                n += row[1]
        if held:
            yield from out()

    return run


def _bucket(table: pa.Table, slots: int) -> pa.Table:
    """All blocks of a bucket: the windows that occur earlier, and the blocks' own repeats, dealt to slots of documents."""
    found, out = [], []
    for n, *row in zip(*(c.combine_chunks().to_pylist() for c in table.columns[1:]), strict=True):
        if n:
            f = _unblocked(n, *row)
            found.append((f.h, f.ids[f.doc], f.tags[f.doc], f.start.astype(np.int32)))
        else:
            x = np.frombuffer(row[-1], "<u4")
            out.append((*(np.repeat(c, len(x)) for c in _documents(*row[:2])), x))
    if found:
        h, ids, tags, start = (np.concatenate(c) for c in zip(*found, strict=True))
        del found
        order = np.argsort(h)
        same = np.r_[False, (s := h[order])[1:] == s[:-1]]
        del s
        pick = order[same | np.r_[same[1:], False]]
        pick = pick[np.lexsort((start[pick], tags[pick], ids[pick], h[pick]))]
        late = pick[np.r_[False, h[pick][1:] == h[pick][:-1]]] if len(pick) else pick
        out.append((ids[late], tags[late], start[late].astype("<u4")))
    ids, tags, starts = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"))
    return to_slots(ids, starts, slots, tags)


def to_slots(ids: np.ndarray, values: np.ndarray, slots: int, tags: np.ndarray | None = None) -> pa.Table:
    """(slot, ids, tags, counts, data): values by document, one packed row for each slot that documents are dealt to."""
    slot = (tx.mix(ids.astype(np.uint64)) % np.uint64(slots)).astype(np.int64)
    tagged = tags is not None and bool(tags.any())
    order = np.lexsort((tags, ids, slot) if tagged else (ids, slot))
    ids, values, slot, tags = ids[order], values[order], slot[order], tags[order] if tagged else None
    new = (ids[1:] != ids[:-1]) | (slot[1:] != slot[:-1]) | (tags[1:] != tags[:-1] if tagged else False)
    heads = np.flatnonzero(np.r_[True, new]) if len(ids) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[heads, len(ids)])
    tops = np.flatnonzero(np.r_[True, np.diff(slot[heads]) != 0]) if len(heads) else np.zeros(0, np.int64)
    cuts = np.r_[tops, len(heads)]
    return pa.table({
        "slot": pa.array(slot[heads][tops], pa.int32()), "ids": cut_binary(ids[heads], cuts), "tags": cut_binary(tags[heads], cuts) if tagged else pa.array([b""] * len(tops), pa.binary()),
        "counts": cut_binary(counts.astype("<u4"), cuts), "data": cut_binary(values, np.r_[heads, len(ids)][cuts]),
    })


def from_slots(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (id and tag) and value of everything that rows of ``to_slots`` hold."""
    raw = table.column("ids").to_pylist()
    ids = np.frombuffer(b"".join(raw), np.int64)
    tags = np.frombuffer(b"".join(t or bytes(len(i)) for t, i in zip(table.column("tags").to_pylist(), raw, strict=True)), np.int64)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
    return np.repeat(ids, counts), np.repeat(tags, counts), np.frombuffer(b"".join(table.column("data").to_pylist()), kind)


SLOT = "slot int, ids binary, tags binary, counts binary, data binary"


def _slot(table: pa.Table) -> pa.Table:
    ids, tags, starts = from_slots(table, "<u4")
    order = np.lexsort((tags, ids))
    ids, tags, starts = ids[order], tags[order], starts[order]
    cuts = np.flatnonzero(np.r_[True, (np.diff(ids) != 0) | (np.diff(tags) != 0), True]) if len(ids) else np.zeros(1, np.int64)
    return pa.table({"id": pa.array(ids[cuts[:-1]], pa.int64()), "tag": pa.array(tags[cuts[:-1]], pa.int64()), "starts": cut_binary(starts, cuts)})


def repeated_starts(rows: DataFrame, units: Units) -> DataFrame:
    """(id, tag, starts): for each document (id, tag, text) with any, the units where windows begin that also begin earlier, packed.

    No two rows have the same id and tag.
    """
    slim, n = rows.where("id is not null and text is not null"), bucket_count(rows, "text")
    ranges = min(n, FAN)
    blocks = slim.select("id", "tag", "text").mapInArrow(_from_texts(units, ranges, WINDOWS), BLOCK)
    if n > ranges:
        # a range is merged by several tasks, as any of its blocks may be merged with any other
        tasks = -(-n // 8)
        salt = F.pmod(F.xxhash64("hashes"), F.lit(-(-tasks // ranges)))
        blocks = blocks.repartition(tasks, "part", salt).sortWithinPartitions("part").mapInArrow(_again(ranges, n, WINDOWS), BLOCK)
    found = blocks.groupBy("part").applyInArrow(lambda t: _bucket(t, n), SLOT)
    return found.groupBy("slot").applyInArrow(_slot, "id long, tag long, starts binary")


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str, bool]:
    """``docs`` with two more columns, whose names follow: a tag that tells rows of one id apart, and copies, how many equal rows a
    row stands for; and whether any id is repeated. Where none is, the tag is 0 and nothing is shuffled but the ids.
    """
    tag, copies, gone = fresh(docs, "_tag"), fresh(docs, "_copies"), fresh(docs, "_gone")
    key = F.col(id_col).cast("long")
    often = docs.where(key.isNotNull()).groupBy(key.alias(gone)).count().where("count > 1").select(gone)
    often = checkpointed(often)
    n = often.count()
    single = {tag: F.lit(0).cast("long"), copies: F.lit(1).cast("long")}
    if not n:
        return docs.withColumns(single), tag, copies, False
    often = F.broadcast(often) if n <= BROADCAST_IDS else often
    other = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    many = docs.join(often, key == F.col(gone), "left_semi").withColumn(tag, F.xxhash64(*other))
    # equal rows are first counted where they are, so that a third of all rows may be copies of one
    first = many.groupBy(key.alias(gone), tag).agg(F.first(F.struct(*docs.columns)).alias(copies + "_row"), F.count("*").alias(copies))
    many = first.select(*(F.col(f"{copies}_row.`{c}`").alias(c) for c in docs.columns), tag, copies)
    return docs.join(often, key == F.col(gone), "left_anti").withColumns(single).unionByName(many), tag, copies, True


BROADCAST_IDS = 1_000_000


def times_copies(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as ``copies`` says, less one; a row that stands for many is first cut into rows that stand for fewer."""
    part = fresh(df, "_part")
    cut = df.withColumn(part, F.explode(F.expr(f"sequence(0L, (`{copies}` - 2) div {COPIES})"))).repartition(F.col(part), F.rand(7))
    return cut.withColumn(part, F.explode(F.expr(f"sequence(1L, least({COPIES}L, `{copies}` - 1 - `{part}` * {COPIES}))"))).drop(part)


COPIES = 100_000


def covered(starts: bytes | None, n: int, k: int) -> np.ndarray:
    """Which of n units the windows at ``starts`` cover: the union of [start, start+k)."""
    step = np.zeros(n + k + 1, np.int32)
    if starts:
        at = np.frombuffer(starts, "<u4").astype(np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + k, -1)
    return np.cumsum(step)[:n] > 0


def kept(texts: list[bytes], starts: list[bytes | None], units: Units) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts without covered units, rejoined by one blank (words) or newline (lines); units and removed units of each."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    offs = np.cumsum(size + 1) - (size + 1)
    # every text is followed by one separator, which units leave out
    if units.lines:
        cuts = np.flatnonzero(buf == 10)
        start, end = np.r_[0, cuts[:-1] + 1], cuts
        bounds = np.searchsorted(start, np.r_[offs, len(buf)])
        some = np.repeat(size > 0, np.diff(bounds))
        start, end = start[some], end[some]
        bounds = np.searchsorted(start, np.r_[offs, len(buf)])
    else:
        start, end = tx.spans(buf, np.r_[offs, len(buf)], tx.WORDS)
        bounds = np.searchsorted(start, np.r_[offs, len(buf)])
    gone = np.zeros(len(start), bool)
    for i, s in enumerate(starts):
        if s:
            gone[bounds[i] : bounds[i + 1]] = covered(s, int(bounds[i + 1] - bounds[i]), units.k)
    stay = ~gone
    step = np.zeros(len(buf) + 1, np.int8)
    np.add.at(step, start[stay], 1)
    np.add.at(step, end[stay] + 1, -1)
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    out = buf[mask]
    if not units.lines:
        out[~tx.WORDS[out]] = 32
    length = np.r_[0, np.cumsum(np.where(stay, end - start + 1, 0))]
    removed = np.r_[0, np.cumsum(gone)]
    data, a, b = out.tobytes(), length[bounds[:-1]], length[bounds[1:]]
    return [data[x : max(x, y - 1)] for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.diff(bounds), removed[bounds[1:]] - removed[bounds[:-1]]


def every_start(text: bytes, units: Units) -> bytes:
    """The starts of all windows of a text, as ``repeated_starts`` packs them."""
    _, at, _, _ = units.windows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    return at.astype("<u4").tobytes()


def pieces(batch: pa.RecordBatch, sizes: list[int], most: int = 4 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that ``sizes`` bytes of each row make no longer than ``most``, or one row."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and (total + n > most or i - at >= rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def without_repeats(docs: DataFrame, units: Units, id_col: str, text_col: str) -> DataFrame:
    """``docs``, all columns, with repeats taken out of ``text_col`` (see ``kept``); texts without repeats stay as they are."""
    rows, tag, copies, repeated = told_apart(docs, id_col, text_col)
    key = F.col(id_col).cast("long")
    rid, rtag, rstarts = (fresh(rows, c) for c in ("_repeat_id", "_repeat_tag", "_repeat_starts"))
    found = repeated_starts(rows.select(key.alias("id"), F.col(tag).alias("tag"), F.col(text_col).cast("string").alias("text")), units)
    found = found.withColumnsRenamed({"id": rid, "tag": rtag, "starts": rstarts})

    @F.pandas_udf("string")
    def rejoin(text, starts):
        import pandas as pd

        out = []
        for t, s in zip(text, starts, strict=True):
            if t is not None and s is not None:
                t = t.encode()
                t = kept([t], [bytes(s) or every_start(t, units)], units)[0][0].decode()
            out.append(t)
        return pd.Series(out, dtype=object)

    def cut(df: DataFrame, starts: str) -> DataFrame:
        # only texts that change go through Python
        new = rejoin(F.when(F.col(starts).isNotNull(), F.col(text_col).cast("string")), starts)
        return df.withColumn(text_col, F.when(F.col(starts).isNotNull(), new).otherwise(F.col(text_col)))

    on = key == F.col(rid)
    out = cut(rows.join(found, on & (F.col(tag) == F.col(rtag)) if repeated else on, "left"), rstarts).select(*docs.columns)
    if repeated:
        more = cut(rows.where(f"`{copies}` > 1").withColumn(rstarts, F.lit(b"")), rstarts)  # no starts: all of them
        out = out.unionByName(times_copies(more, copies).select(*docs.columns))
    return out


def digests(docs: DataFrame, units: Units, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n_units, n_removed, kept_sha256) of every row; texts cross the join compressed."""
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows, tag, copies, repeated = told_apart(slim, "id", "text")
    rows = rows.withColumnsRenamed({tag: "tag", copies: "copies"})
    found = repeated_starts(rows, units).withColumnsRenamed({"id": "rid", "tag": "rtag"})

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for table, buf, offs in tx.chunks(batches, "text"):
            data, o = buf.tobytes(), offs.tolist()
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), table.column("tag").combine_chunks(), table.column("copies").combine_chunks(), pa.array([z.compress(data[a:b]) for a, b in zip(o[:-1], o[1:], strict=True)], pa.binary())], names=["id", "tag", "copies", "z"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in pieces(batch, [zstandard.frame_content_size(x) for x in batch.column("z").to_pylist()]):
                texts = [z.decompress(x) for x in part.column("z").to_pylist()]
                starts = [every_start(t, units) if s == b"" else s for t, s in zip(texts, part.column("starts").to_pylist(), strict=True)]
                out, n, gone = kept(texts, starts, units)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copies"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([sha256(x).hexdigest() for x in out])], names=["id", "copies", "n_units", "n_removed", "kept_sha256"])

    def finished(df: DataFrame) -> DataFrame:
        return df.select("id", "copies", "z", "starts").mapInArrow(finish, "id long, copies long, n_units long, n_removed long, kept_sha256 string")

    packed = rows.select("id", "tag", "copies", "text").mapInArrow(squeeze, "id long, tag long, copies long, z binary")
    on = F.col("id") == F.col("rid")
    out = finished(packed.join(found, on & (F.col("tag") == F.col("rtag")) if repeated else on, "left"))
    if repeated:
        out = out.unionByName(times_copies(finished(packed.where("copies > 1").withColumn("starts", F.lit(b""))), "copies"))
    return out.drop("copies").withColumnRenamed("id", id_col)
