"""SentencePiece BPE encoding and decoding by suffix-array matching.

The distinct words of a batch are laid end to end and indexed by a suffix array; every piece of the vocabulary is binary
searched in it at once, which gives its range of occurrences. The occurrences are edges (from, to, piece). Sorted by
position they are relaxed: a position holds the last piece of the encoding of the word up to it, and an edge is taken if
its start is reached and its piece is compatible with the last piece there, that is, if byte-pair merging of the two
pieces' text leaves exactly these two. Merging never looks past a boundary that it does not cross, so exactly one edge
into each position is taken, and following them back from a word's end gives the merged pieces. (Relaxing by the sum of
scores would be the unigram model's answer, which differs from this vocabulary's.)

Words start at a run of blanks; no piece has a blank after another character, so no merge crosses into the next word.
Characters of no longer piece (newlines) are words alone. Unknown characters become byte pieces.

Null texts give null ids, empty texts empty ids. Texts are whole. Decoding gives the text back, but for the marker
character U+2581, which the library's escaping also turns into a blank. Rows are independent of each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
BASE = np.int64(1) << 32
REMEMBERED = 450_000
#: New words encoded at a time, which bounds the suffix array and the edges.
AT_ONCE = 40_000


def _final_splits(pieces: dict[str, int], rank: dict[str, int]) -> dict[int, tuple[int, int]]:
    """Piece id to the two pieces that the last merge of its own text joins; unreachable pieces are left out."""
    out = {}
    for text, i in pieces.items():
        if len(text) < 2:
            continue
        parts = list(text)
        while len(parts) > 2:
            best = min(((rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2 and parts[0] in pieces and parts[1] in pieces:
            out[i] = pieces[parts[0]], pieces[parts[1]]
    return out


def load(path: str) -> dict:
    """Arrays of a .model file (BPE with byte fallback, identity normalisation, blank prefix)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    texts = [sp.id_to_piece(i) for i in range(n)]
    byte = {int(texts[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    plain = {texts[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    if len(byte) != 256 or any(BLANK in t.lstrip(BLANK) for t in plain):
        raise ValueError(f"{path}: pieces of this kind are not supported")
    order = sorted((t for t in plain if len(t) > 1), key=lambda t: (-sp.get_score(plain[t]), plain[t]))
    rank = {t: k for k, t in enumerate(order)}
    split = _final_splits(plain, rank)
    kept = {t: i for t, i in plain.items() if len(t) == 1 or i in split}
    ranks, left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for t, i in kept.items():
        if len(t) > 1:
            ranks[i], (left[i], right[i]) = rank[t], split[i]
    joins = sorted((plain[t[:k]] * int(BASE) + plain[t[k:]], rank[t]) for t in rank for k in range(1, len(t)) if t[:k] in plain and t[k:] in plain)
    longer = {c for t in plain if len(t) > 1 for c in t}
    return {
        "texts": texts, "byte": np.array([byte[b] for b in range(256)], np.int64), "rank": ranks, "left": left, "right": right,
        "join": np.array([k for k, _ in joins], np.int64), "join_rank": np.array([r for _, r in joins], np.int64),
        "pieces": sorted((t, i) for t, i in kept.items()), "alone": "\n" if "\n" not in longer else "",
    }


def compatible(a: np.ndarray, b: np.ndarray, tables: dict) -> np.ndarray:
    """For pairs of pieces, whether merging their joint text leaves them as they are; -1 stands for nothing, which fits."""
    rank, left, right, keys, joined = (tables[k] for k in ("rank", "left", "right", "join", "join_rank"))
    ok = np.ones(len(a), bool)
    live = np.flatnonzero((a >= 0) & (b >= 0))
    a, b = a[live], b[live]
    limit = np.full(len(live), BASE)
    while len(live):
        at = np.minimum(np.searchsorted(keys, key := a * BASE + b), len(keys) - 1)
        bad = (keys[at] == key) & (joined[at] < limit)
        ok[live[bad]] = False
        # undo the later of the two pieces' last merges: of equal ones the right, as merging goes from the left
        undo_a = rank[a] > rank[b]
        limit = np.where(undo_a, rank[a], rank[b] + 1)
        go = ~bad & ((rank[a] >= 0) | (rank[b] >= 0))
        a, b = np.where(undo_a, right[a], a)[go], np.where(undo_a, b, left[b])[go]
        live, limit = live[go], limit[go]
    return ok


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions in the order of their first ``depth`` symbols at least, by prefix doubling."""
    padded = np.r_[text + 1, 0, 0]
    key, h = padded[:-2] << 42 | padded[1:-1] << 21 | padded[2:], 3
    order = np.argsort(key)
    while h < depth:
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.r_[False, np.diff(key[order]) != 0])
        follow = np.zeros(len(rank), np.int64)
        follow[:-h] = rank[h:] + 1
        key = rank * (len(rank) + 1) + follow
        order = np.argsort(key)
        h *= 2
    return order


def occurrences(text: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) of the suffixes that begin with each piece (rows of ``pieces``, padded), narrowed symbol by symbol."""
    lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(text), np.int64)
    padded = np.concatenate([text, np.full(pieces.shape[1] + 1, -1, text.dtype)])

    def bound(a: np.ndarray, b: np.ndarray, d: int, symbol: np.ndarray, after: bool) -> np.ndarray:
        a, b = a.copy(), b.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            seen = padded[order[np.minimum(mid, len(order) - 1)] + d]
            less = open_ & ((seen <= symbol) if after else (seen < symbol))
            a = np.where(less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return a

    for d in range(pieces.shape[1]):
        on = np.flatnonzero((lengths > d) & (lo < hi))
        if not len(on):
            break
        first = bound(lo[on], hi[on], d, pieces[on, d], False)
        hi[on] = bound(first, hi[on], d, pieces[on, d], True)
        lo[on] = first
    return lo, np.maximum(lo, hi)


def encode_words(words: list[str], tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of each word (blanks already escaped) end to end, and the words' offsets in them."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    if "grid" not in tables:
        width = max(len(t) for t, _ in tables["pieces"])
        grid = np.zeros((len(tables["pieces"]), width), np.int64)
        for k, (t, _) in enumerate(tables["pieces"]):
            grid[k, : len(t)] = [ord(c) for c in t]
        tables |= {"grid": grid, "lengths": np.array([len(t) for t, _ in tables["pieces"]]), "ids": np.array([i for _, i in tables["pieces"]])}
    n = np.array([len(w) for w in words])
    raw = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    # one place more than characters for each word: node i is before character i, a word's last place its end
    starts = np.cumsum(n + 1) - (n + 1)
    text = np.concatenate([raw, [0]])
    text[starts + n] = -1
    order = suffix_array(text, tables["grid"].shape[1])
    lo, hi = occurrences(text, order, tables["grid"], tables["lengths"])
    count = hi - lo
    which = np.repeat(np.arange(len(count)), count)
    source = order[np.arange(int(count.sum())) - (np.cumsum(count) - count)[which] + lo[which]]
    piece, length = tables["ids"][which], tables["lengths"][which]
    single = np.zeros(len(text), bool)
    single[source[length == 1]] = True
    lost = np.flatnonzero(~single & (text >= 0))
    source, piece, length = np.r_[source, lost], np.r_[piece, np.full(len(lost), -1)], np.r_[length, np.ones(len(lost), np.int64)]
    depth = source - np.repeat(starts, n + 1)[source]
    by = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
    source, piece, length, depth = source[by], piece[by], length[by], depth[by]
    cuts = np.flatnonzero(np.r_[True, np.diff(depth) > 0, True]) if len(depth) else np.zeros(1, np.int64)
    last, back = np.full(len(text), -1, np.int64), np.full(len(text), -1, np.int64)
    reached = np.zeros(len(text), bool)
    reached[starts] = True
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        s, p = source[a:b], piece[a:b]
        on = reached[s]
        s, p, to = s[on], p[on], s[on] + length[a:b][on]
        fits = compatible(last[s], p, tables)
        to = to[fits]
        last[to], back[to], reached[to] = p[fits], s[fits], True
    # from each word's end back to its start, all words in step; one more row of places each step
    at, out = starts + n, []
    word = np.arange(len(words))
    while len(on := np.flatnonzero(at > starts[word])):
        at, word = at[on], word[on]
        out.append((word, at, last[at]))
        at = back[at]
    if not out:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    word, place, ids = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.argsort(place)
    word, place, ids = word[by], place[by], ids[by]
    if (unknown := np.flatnonzero(ids < 0)).size:
        spelled = [chr(text[p - 1]).encode("utf-8", "replace") for p in place[unknown]]
        many = np.ones(len(ids), np.int64)
        many[unknown] = [len(x) for x in spelled]
        ids, word = np.repeat(ids, many), np.repeat(word, many)
        ids[ids < 0] = tables["byte"][np.frombuffer(b"".join(spelled), np.uint8)]
    return ids, np.searchsorted(word, np.arange(len(words) + 1))


class Encoder:
    """Encodes texts, remembering the ids of words."""

    def __init__(self, tables: dict):
        self.tables = tables
        alone = re.escape(tables["alone"])
        self.word = re.compile(f"[{alone}]|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if alone else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the texts' offsets."""
        if len(self.known) > REMEMBERED:
            self.forget()
        words = [self.word.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = list(set().union(*words) - self.known.keys())
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        ids, offs = [self.ids], [self.offs]
        for a in range(0, len(new), AT_ONCE):
            some, cuts = encode_words(new[a : a + AT_ONCE], self.tables)
            ids.append(some.astype(np.int32))
            offs.append(cuts[1:] + offs[-1][-1])
        self.ids, self.offs = np.concatenate(ids), np.concatenate(offs)
        at = np.array([i for w in words for i in map(self.known.__getitem__, w)], np.int64)
        n = self.offs[at + 1] - self.offs[at]
        ends = np.cumsum(n)
        out = self.ids[np.arange(int(n.sum())) - np.repeat(ends - n - self.offs[at], n)]
        per_text = np.cumsum([0, *map(len, words)])
        return out, np.r_[0, ends][per_text]


class Decoder:
    """Turns ids back into text, with one table of each piece's bytes."""

    def __init__(self, texts: list[str], byte: np.ndarray):
        spelled = [t.replace(BLANK, " ").encode() for t in texts]
        for i in range(3):
            spelled[i] = b"" if i else " ⁇ ".encode()
        for b, i in enumerate(byte):
            spelled[i] = bytes([b])
        self.spelled = spelled

    def text(self, ids: list[int] | np.ndarray) -> str:
        out = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def _slices(batch: pa.RecordBatch, nbytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch where about nbytes of it are full, at 500 rows at most."""
    step = max(1, min(2000, int(batch.num_rows * nbytes / max(1, batch.nbytes))))
    return (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every row of ``docs``; null for a null text."""
    tables, kind = load(path), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(tables)
        for part in (p for b in batches for p in _slices(b, 2 << 20)):
            texts = part.column(1)
            ids, offs = coder.batch(texts.to_pylist())
            made = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null())
            yield pa.RecordBatch.from_arrays([part.column(0), made], names=["id", "ids"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.select(out.id.alias(id_col), "ids")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of every row of ``encoded``; null for null ids."""
    tables, kind = load(path), encoded.schema[id_col].dataType.simpleString()
    texts, byte = tables["texts"], tables["byte"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Decoder(texts, byte)
        for part in (p for b in batches for p in _slices(b, 2 << 20)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else coder.text(x) for x in part.column(1).to_pylist()], pa.string())], names=["id", "text"])

    out = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.select(out.id.alias(id_col), "text")


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_pieces, ids_sha256 of the ids as little-endian int32, round_trip): encoding, decoding and comparing in one map.

    round_trip: the decoded text is the text, once U+2581 in it counts as a blank. Null and empty texts have no pieces.
    """
    tables, kind = load(path), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        coder, back = Encoder(tables), Decoder(tables["texts"], tables["byte"])
        for part in (p for b in batches for p in _slices(b, 2 << 20)):
            texts = part.column(1).to_pylist()
            ids, offs = coder.batch(texts)
            small, ints = ids.astype("<i4"), ids.tolist()
            bounds = offs.tolist()
            cut = list(zip(bounds[:-1], bounds[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(np.diff(offs), pa.int64()), pa.array([sha256(small[a:b].tobytes()).hexdigest() for a, b in cut]),
                    pa.array([back.text(ints[a:b]) == (t or "").replace(BLANK, " ") for (a, b), t in zip(cut, texts, strict=True)]),
                ], names=["id", "n_pieces", "ids_sha256", "round_trip"],
            )

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_pieces long, ids_sha256 string, round_trip boolean")
    return out.select(out.id.alias(id_col), "n_pieces", "ids_sha256", "round_trip")
