"""Token counts of a byte-level BPE vocabulary, by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one ragged array of symbols. In every round each sequence finds its
lowest-rank adjacent pair and applies it at all its places at once (leftmost first where places overlap); finished
sequences leave the array. What survives is counted. A pair that contains a merged symbol always ranks after the merge
that made it, which makes this the same as merging one pair at a time; ``load`` checks that of the vocabulary.

Nulls and empty texts have 0 bytes and 0 tokens. Texts are whole, of any length. Rows are independent: repeated rows and
ids give repeated results, null ids stay null, and no other column is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the public pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.int64(1) << 40
#: Pre-tokens remembered by a worker before it starts afresh; only speed depends on it.
REMEMBERED = 700_000
#: Pre-tokens of one text taken at a time, so that a very long text needs no list of all of them.
AT_ONCE = 200_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it prints, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def load(path: str) -> dict:
    """Arrays of a tokenizer file: each byte's symbol; pair keys in order, their ranks and merged symbols; specials."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    vocab = model["vocab"]
    first = np.array([vocab[s] for _, s in sorted(byte_symbols().items())], np.int64)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
    born = np.full(max(vocab.values()) + 1, -1, np.int64)
    ranks = np.arange(len(pairs))
    born[made[::-1]] = ranks[::-1]
    if (np.maximum(born[left], born[right]) >= ranks).any():
        raise ValueError(f"{path}: a merge comes before the symbols that it joins")
    keys = left << 32 | right
    order = np.argsort(keys)
    return {"first": first, "keys": keys[order], "rank": ranks[order], "made": made[order], "special": [a["content"] for a in spec["added_tokens"]]}


def merged_lengths(words: list[bytes], tables: dict) -> np.ndarray:
    """How many symbols each byte string has when no pair of its symbols merges any more."""
    out = np.array([len(w) for w in words], np.int64)
    ids = np.flatnonzero(out > 1)
    sym = tables["first"][np.frombuffer(b"".join(words[i] for i in ids), np.uint8)]
    seq = np.repeat(np.arange(len(ids)), out[ids])
    keys, ranks, made = tables["keys"], tables["rank"], tables["made"]
    while len(sym):
        at = np.minimum(np.searchsorted(keys, key := sym[:-1] << 32 | sym[1:]), len(keys) - 1)
        rank = np.full(len(sym), NEVER)
        rank[:-1] = np.where((keys[at] == key) & (seq[:-1] == seq[1:]), ranks[at], NEVER)
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        size = np.diff(np.r_[starts, len(seq)])
        done = lowest == NEVER
        out[ids[seq[starts[done]]]] = size[done]
        live = np.repeat(~done, size)
        hit = live & (rank == np.repeat(lowest, size))
        # in a row of overlapping places (a symbol paired with itself) every second one, from the left
        where = np.flatnonzero(hit)
        fresh = np.r_[True, np.diff(where) > 1]
        run = np.arange(len(where)) - np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
        where = where[run % 2 == 0]
        sym[where] = made[at[where]]
        live[where + 1] = False
        sym, seq = sym[live], seq[live]
    return out


def counter(tables: dict):
    """A function from Arrow batches (id, text) to batches (id, n_bytes, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern, special = regex.compile(PATTERN), regex.compile("|".join(map(regex.escape, tables["special"])) or r"(?!)")
        known: dict[str, int] = {}

        def learn(tokens: set[str]) -> None:
            new = list(tokens - known.keys())
            known.update(zip(new, merged_lengths([t.encode() for t in new], tables).tolist(), strict=True))

        def pieces(text: str) -> Iterator[list[str]]:
            for part in special.split(text) if tables["special"] else [text]:
                if len(part) < AT_ONCE:
                    yield pattern.findall(part)
                else:
                    found = pattern.finditer(part)
                    while got := [m[0] for m in islice(found, AT_ONCE)]:
                        yield got

        def count(texts: list[str | None]) -> list[int]:
            out, wait, new = [0] * len(texts), [], set()
            for i, text in enumerate(texts):
                if not text:
                    continue
                n = sum(1 for _ in special.finditer(text))
                for tokens in pieces(text):
                    try:
                        n += sum(map(known.__getitem__, tokens))
                    except KeyError:
                        if len(tokens) >= AT_ONCE:
                            learn(set(tokens))
                            n += sum(map(known.__getitem__, tokens))
                        else:
                            wait.append((i, tokens))
                            new.update(tokens)
                out[i] += n
                if len(new) > 100_000:
                    learn(new)
                    for j, tokens in wait:
                        out[j] += sum(map(known.__getitem__, tokens))
                    wait, new = [], set()
            learn(new)
            for j, tokens in wait:
                out[j] += sum(map(known.__getitem__, tokens))
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                if len(known) > REMEMBERED:
                    known.clear()
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(count(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row of ``docs``: its id, n_bytes, n_tokens and over_limit (n_tokens > limit); one map, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = slim.mapInArrow(counter(load(path)), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(out.id.alias(id_col), "n_bytes", "n_tokens", (out.n_tokens > limit).alias("over_limit"))
