"""Small fixtures with nulls, empty and very long texts, ties, repeats and clashing columns, against brute force."""

import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import ann, decontamination, line_dedup, ngram_jaccard, quality, queries, repeats, sentencepiece_codec, substring_dedup, token_counts, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id string, starts int, bucket int, label string, n long"
ROWS = None


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    base, passage = say(120), say(30)
    out = [None, "", " \n ", "one", "one two", "ONE  Two", base, base, base.upper(), base + " tail", "x" + base[1:], passage + " " + say(40), say(40) + "\n" + passage, passage + " " + passage]
    out += ["l1\nl2\nl3\nl4", "z\nl1\nl2\nl3\ny", "l2\nl3\nl4\n", "\n\n\n\n", "\n\n\n", "é 漢字 🙂 " + "a" * 3000, " ".join(["so"] * 5000), say(30000)]
    return out + [say(60) for _ in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "id", i % 2, 7, "label", None) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "one two three", None, None, None, None, None)], SCHEMA).repartition(3)


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect() if r[0] is not None}


def test_token_counts(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    got = by_id(token_counts.count_tokens(docs, queries.tokenizer("byte_bpe_50k.json")))
    for i, x in enumerate(texts()):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert got[i] == (len((x or "").encode()), n, n > 1024)


def test_sentencepiece(docs):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    made = sentencepiece_codec.encode(docs, path)
    ids, back, digest = by_id(made), by_id(sentencepiece_codec.decode(made, path)), by_id(sentencepiece_codec.encode_digest(docs, path))
    for i, x in enumerate(texts()):
        want = sp.encode(x or "")
        assert (ids[i][0] or []) == want and back[i][0] == x and digest[i] == (len(want), sha256(np.array(want, "<i4").tobytes()).hexdigest(), True)


def test_substring_dedup(docs):
    seen, want = set(), {}
    for i, t in enumerate(texts()):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            gone[k : k + 20] = [True] * 20 if key in seen else gone[k : k + 20]
            seen.add(key)
        want[i] = len(w), sum(gone), sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()
    assert by_id(substring_dedup.dedup_digest(docs)) == want
    kept = substring_dedup.dedup(docs)
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect()}[0] is None


def test_line_dedup(docs):
    seen, want = set(), {}
    for i, t in enumerate(texts()):
        w = t.split("\n") if t else []
        gone = [False] * len(w)
        for k in range(len(w) - 2):
            key = tuple(w[k : k + 3])
            if WORD.search("".join(key)):
                gone[k : k + 3] = [True] * 3 if key in seen else gone[k : k + 3]
                seen.add(key)
        want[i] = len(w), sum(gone), sha256("\n".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()
    assert by_id(line_dedup.dedup_digest(docs)) == want
    text = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert text[15] == "z\ny" and text[14] == "l1\nl2\nl3\nl4" and text[None] == "one two three"


def shared_ids(spark):
    """Rows of one id with other texts, equal rows, and copies under other ids, some with null texts or ids."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words, n))
    a, b, c, once = say(30), say(50), "l1 x\nl2 x\nl3 x\nl4 x", " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, a), (1, a), (2, once), (2, a + " " + say(5)), (3, b), (3, b[:120] + " " + say(25)), (4, b), (4, b), (5, c), (5, c), (6, c + "\nend"), (6, "l0\n" + c)]
    rows += [(7, None), (7, None), (7, "x"), (7, "x"), (8, ""), (8, ""), (None, a), (None, a), (9, say(40)), (-3, c + " " + say(30)), (-3, a)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_repeats(rows, k, cut, counts, glue):
    """(id, units, removed, digest) of every row; equal rows in a row, the others of an id by tag."""
    seen, out = set(), []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        w = cut(t) if t else []
        gone = [False] * len(w)
        for s in range(len(w) - k + 1) if i is not None else ():
            key = tuple(w[s : s + k])
            if counts(key):
                gone[s : s + k] = [True] * k if key in seen else gone[s : s + k]
                seen.add(key)
        out.append((i, len(w), sum(gone), sha256(glue.join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("parts", [1, 2, 3])
@pytest.mark.parametrize("fan", [repeats.FAN, 2])
def test_rows_that_share_an_id(spark, monkeypatch, parts, fan):
    """The first copy of everything stays, however rows are dealt to partitions and hashes to buckets."""
    monkeypatch.setattr(repeats, "FAN", fan)
    monkeypatch.setattr(repeats, "COPIES", 1)
    docs = shared_ids(spark).repartition(parts).persist()
    rows = [tuple(r) for r in docs.withColumn("t", F.xxhash64("text")).collect()]
    kinds = {substring_dedup: (20, WORD.findall, lambda key: True, " "), line_dedup: (3, lambda t: t.split("\n"), lambda key: WORD.search("".join(key)), "\n")}
    for mod, (k, cut, counts, glue) in kinds.items():
        assert sorted(str(tuple(r)) for r in mod.dedup_digest(docs).collect()) == brute_repeats(rows, k, cut, counts, glue)
        texts_ = sorted((r for r in mod.dedup(docs.withColumn("n", F.lit(1))).collect()), key=str)
        assert len(texts_) == len(rows) and set(" ".join(r["text"] or "" for r in texts_).split()) == set(" ".join(r[1] or "" for r in rows).split())
        assert sum(r["text"] is None for r in texts_) == 2
    docs.unpersist()


def test_two_step_dealing_changes_nothing(spark, docs, monkeypatch):
    one = by_id(substring_dedup.dedup_digest(docs))
    for fan, windows in ((3, 1000), (2, 50)):
        monkeypatch.setattr(repeats, "FAN", fan)
        monkeypatch.setattr(repeats, "WINDOWS", windows)
        assert by_id(substring_dedup.dedup_digest(docs)) == one


def test_pieces_and_chunks_are_bounded():
    import pyarrow as pa

    from tensorloom.llm import text

    batch = pa.RecordBatch.from_pydict({"text": ["ab"] * 10 + [None] * 300 + ["x" * 50] + [""] * 5})
    sizes = [len(t or "") for t in batch.column(0).to_pylist()]
    cut = list(repeats.pieces(batch, sizes, 10, 100))
    assert sum(p.num_rows for p in cut) == 316 and max(p.num_rows for p in cut) <= 100
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 10 for p in cut)
    got = list(text.chunks(iter([batch, batch]), "text", 20, 64))
    assert sum(t.num_rows for t, _, _ in got) == 632 and max(t.num_rows for t, _, _ in got) <= 64 and all(t.num_rows == 1 or len(b) <= 20 for t, b, _ in got)
    assert [t for x, _, _ in got for t in x.column("text").to_pylist()] == batch.column(0).to_pylist() * 2


def test_ngram_jaccard(docs):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts():
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    assert by_id(ngram_jaccard.linked_documents(docs)) == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp))}


def brute_components(rows):
    """(id, size, component) of every row, in any order; rows of one id are one set."""
    low, sets = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}), {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        if i is not None:
            sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    comp = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((comp[i], comp[j]))
                comp = {k: a if c == b else c for k, c in comp.items()}
    return sorted(str((i, len(sets[i]), comp[i]) if i is not None else (None, 0, None)) for i, _ in rows)


@pytest.mark.parametrize("parts", [1, 2, 4])
@pytest.mark.parametrize("fan", [repeats.FAN, 2])
def test_jaccard_of_rows_that_share_an_id(spark, monkeypatch, parts, fan):
    monkeypatch.setattr(repeats, "FAN", fan)
    monkeypatch.setattr(ngram_jaccard, "GROUP", 4)
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(200)]
    say = lambda n: list(rng.choice(words, n))
    base = say(100)
    rows = [(i, " ".join(base[:90] + say(rng.integers(0, 14)))) for i in range(25)] + [(i, " ".join(base[:40] + say(60))) for i in range(30, 40)]
    rows += [(2, " ".join(say(30))), (2, rows[2][1]), (3, rows[3][1]), (3, None), (50, None), (50, ""), (None, rows[0][1]), (-5, " ".join(base[:95])), (51, "one two"), (52, "One  two"), (51, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted(str(tuple(r)) for r in ngram_jaccard.linked_documents(docs).collect()) == brute_components(rows)


def test_frequent_finds_every_hot_hash():
    rng = np.random.default_rng(4)
    parts = [np.r_[rng.integers(100, 1 << 40, 900), np.repeat(np.arange(4), [1, 3, 30, 66])].astype(np.uint64) for _ in range(40)]
    h, n, total = ngram_jaccard.frequent(iter(parts), 0.02)
    assert total == 40000 and h.tolist() == [2, 3] and n[0] > 1000 and n[1] > 2440
    assert [len(x) for x in ngram_jaccard.frequent(iter([]), 0.02)[:2]] == [0, 0]


def test_edge_pairs_connect_copies():
    """Near copies become one component from fewer pairs than members; strangers give no pair."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 55, 300)
    sets = [np.unique(np.r_[base[rng.random(300) > 0.02], rng.integers(0, 1 << 55, 3)]).astype(np.uint64) for _ in range(100)]
    sets += [np.unique(rng.integers(0, 1 << 55, 300)).astype(np.uint64) for _ in range(20)]
    bits = np.frombuffer(b"".join(ngram_jaccard.bitmap(s.tobytes()) for s in sets), np.uint64).reshape(120, -1)
    size = np.array([len(s) for s in sets])
    pairs = ngram_jaccard.edge_pairs(size, size, bits, 7)
    comp = np.arange(120)
    for a, b in pairs:
        comp[comp == comp[b]] = comp[a]
    assert len(pairs) < 120 and pairs.max() < 100 and len(np.unique(comp[:100])) < 25
    assert len(ngram_jaccard.edge_pairs(size[:1], size[:1], bits[:1], 0)) == 0


def test_tree_pairs_keep_every_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 55, 100)
    sets = [np.unique(np.r_[base[rng.random(100) > d], rng.integers(0, 1 << 55, 5)]).astype(np.uint64) for d in rng.random(60) * 0.3]
    bits = np.frombuffer(b"".join(ngram_jaccard.bitmap(s.tobytes()) for s in sets), np.uint64).reshape(60, -1)
    size = np.array([len(s) for s in sets])
    pairs = {tuple(sorted(p)) for p in ngram_jaccard.tree_pairs(np.arange(60), size, size, np.arange(60), bits, np.zeros(60, int)).tolist()}
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert 100 * both < 80 * (size[i] + size[j] - both) or (j, i) in pairs


def test_decontamination(spark, docs):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    t = texts()
    items = [(1, t[6]), (2, "one two"), (3, None), (4, "?!"), (5, " ".join(t[11].split()[3:14])), (6, t[6])]
    rows = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert not any(n in rows._jdf.queryExecution().toString() for n in ("MapInArrow", "ArrowEvalPython", "BatchEvalPython"))
    got = by_id(rows)
    for i, x in enumerate(t):
        w, hit, names = cut(x), set(), set()
        for name, y in items:
            b = cut(y)
            n = min(10, len(b))
            wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in wins]
            hit |= {k + d for k in at for d in range(n)}
            names |= {str(name)} if at else set()
        assert got[i] == (len(w), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)), i


def test_decontamination_of_rows_that_share_an_id(spark, monkeypatch):
    leak = " ".join(f"k{i}" for i in range(20))
    rows = [(1, "a " + leak), (1, "b " * 30), (1, "a " + leak), (1, None), (2, "short tail"), (2, "tail"), (None, leak)]
    want = sorted(str(x) for x in [(1, 21, 20, 1, True), (1, 21, 20, 1, True), (1, 30, 0, 0, False), (1, 0, 0, 0, False), (2, 2, 2, 1, True), (2, 1, 0, 0, False), (None, 20, 0, 0, False)])
    items = spark.createDataFrame([(1, leak), (2, "SHORT, tail!")], "item_id long, text string")
    for most in (decontamination.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
        for parts in (1, 3):
            got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), items)
            assert sorted(str((r[0], r[1], r[2], r[3], r[5])) for r in got.collect()) == want


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 3_000_000
    pages = [(1, "u", "short"), (2, "u", "short"), (3, None, "x" * 100), (4, "a b", "x" * 100), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (None, "u", "x" * 100)]
    got = {(r[0], r[3]): tuple(r) for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages) and all(r[5] for r in got.values())
    first = {3: None, 4: 3, 7: None, 8: 7}
    for i, _, html in pages:
        b = (html or "").encode()
        to = first.get(i)
        assert got[i, "revisit" if to else "response"][1:5] == (len(b), sha256(b).hexdigest(), "revisit" if to else "response", to)
    one = warc.write(spark.createDataFrame(pages[6:7], "page_id long, url string, html string"), f"file://{tmp_path}/w").collect()
    rows = warc.read(spark.createDataFrame([(one[0]["path"],)] if len(one) == 1 else [(r["path"],) for r in one if r["records"]], "path string"), f"file://{tmp_path}/w").orderBy("chunk_no").collect()
    assert len(rows) == 6 and b"".join(bytes(r["chunk"]) for r in rows) == big.encode() and max(len(r["chunk"]) for r in rows) <= warc.CHUNK


def test_classifiers(spark, docs):
    good, bad = [f"plain words here number {i} and more" for i in range(60)], [f"plain awful!! WORDS!! {i} HERE!!" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), int(i >= 60)) for i, _ in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for mod, label in ((quality, lambda i: i < 60), (toxicity, lambda i: i >= 60)):
        model = mod.train(table, labels)
        out = mod.score(table, model).collect()
        assert len(out) == 120 and all(r["predicted"] == label(r["doc_id"]) for r in out) and len({r["held_out"] for r in out}) == 2
        assert all(0 <= r["score"] <= 1 for r in mod.score(docs, model).collect())
        assert {r["score"] for r in mod.score(docs, mod.train(table, labels.limit(0))).collect()} == {0.5}
    assert toxicity.accepted(table, toxicity.train(table, labels)).count() == 60


def test_vote_equals_plain_nearest_neighbours():
    rng = np.random.default_rng(2)
    say = lambda: " ".join(rng.choice([f"w{i}" for i in range(50)] + ["A1", "b!", "--"], int(rng.integers(1, 60)))).encode()
    parts = [say() for _ in range(700)] + [b"", b"x"]
    buf, offs = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    x, y = quality.counts(buf, offs), rng.integers(0, 2, len(parts))
    model = quality.fit(x[:300], y[:300])
    unit = quality.latent(x, model["weights"], model["basis"])
    for i, got in enumerate(quality.vote(model, x)):
        near = sorted(((-round(float(unit[i] @ v), 6), j, label) for j, (v, label) in enumerate(zip(model["vectors"], model["labels"]))))[: quality.NEIGHBOURS]
        near = [(-c, label) for c, _, label in near]
        w = [min(max(c, 0.0), 1.0) ** quality.SHARPNESS for c, _ in near]
        want = sum(a * label for a, (_, label) in zip(w, near)) / sum(w) if sum(w) > 0 else model["prior"]
        assert abs(got - want) < 1e-5, i
    # counts of texts do not depend on what else is in the chunk
    for i in (0, 5, 699, 700, 701):
        assert np.array_equal(quality.counts(np.frombuffer(parts[i], np.uint8), np.array([0, len(parts[i])]))[0], x[i])


def test_fit_equals_scalar_ftrl():
    rng = np.random.default_rng(9)
    rows = [(int(y), np.unique(rng.integers(0, 40, 12) + (5 * y))) for y in rng.integers(0, 2, 400)]
    z, n = dict.fromkeys(range(60), 0.0), dict.fromkeys(range(60), 0.0)

    def weight(i):
        return 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for y, at in rows:
            w = {i: weight(i) for i in at.tolist()}
            g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (toxicity.TOXIC if y else 1)
            for i in w:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in z if abs(z[i]) > toxicity.L1}
    numbers, weights = toxicity.fit(rows)
    assert numbers.tolist() == sorted(want) and np.allclose(weights, [want[i] for i in sorted(want)])
    # features of a text, written out
    text, h = b"One two  one-THREE", lambda w: int(toxicity.tx.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    words, mix, m = [h(w) for w in (b"one", b"two", b"one", b"three")], lambda v: int(toxicity.tx.mix(np.array([v % 2**64], np.uint64))[0]), toxicity.DIMENSIONS - 1
    pairs = [mix(a * (2 * gap + 1) + mix(b + gap)) for gap in (1, 2) for a, b in zip(words, words[gap:])]
    got = set(toxicity.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist())
    assert got == {0, *(1 + v % m for v in words + pairs)}


def test_classifiers_on_held_out_labels(spark):
    """Held-out rows of the given labels: of 4,000 labelled ones most toxic are found, and clean ones left alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for mod, label, least in ((quality, "quality", 0.97), (toxicity, "toxic", 0.8)):
        got = mod.score(docs, mod.train(docs, labels)).where("held_out").join(labels.where(f"{label} is not null"), "doc_id").select("predicted", label).collect()
        ones = [r["predicted"] for r in got if r[label] == 1]
        zeros = [r["predicted"] for r in got if r[label] == 0]
        assert len(ones) > 20 and len(zeros) > 20 and np.mean(ones) > least and np.mean(zeros) < 0.01, (label, np.mean(ones), np.mean(zeros))


def test_classifiers_on_odd_tables(spark, monkeypatch):
    """Empty tables, repeated rows and ids, equal rows by the thousand, and long labelled texts under a small bound."""
    none, no_labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(i, f"{'bad awful' if i % 2 else 'fine good'} words {i % 7} here") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)] * 2, "doc_id long, quality int, toxic int")
    for mod in (quality, toxicity):
        assert mod.score(none, mod.train(none, no_labels)).count() == 0 and mod.score(none, mod.train(none, labels)).count() == 0
        once = mod.score(spark.createDataFrame(rows, "doc_id long, text string"), mod.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)).collect()
        often = spark.createDataFrame(rows + rows[:1] * 2000, "doc_id long, text string").repartition(3)
        again = mod.score(often, mod.train(often, labels)).collect()
        assert len(again) == 2060 and all(abs({r["doc_id"]: r["score"] for r in once}[r["doc_id"]] - r["score"]) < 1e-9 for r in again)
        # 60 texts of 100 kB, of which the bound lets some in
        monkeypatch.setattr(mod, "SAMPLE_BYTES", 1_000_000)
        long = spark.createDataFrame([(i, (t + " ") * 4500) for i, t in rows], "doc_id long, text string")
        assert all(0 <= r["score"] <= 1 for r in mod.score(long, mod.train(long, labels)).collect())


def test_short_texts_by_the_hundred_thousand(spark):
    """Null and two-letter texts are scored in blocks of a bounded number of rows."""
    from tensorloom.llm import labelled

    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("ab")).alias("text")).coalesce(1)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for mod in (quality, toxicity):
        assert mod.score(docs, mod.train(docs, labels)).where("score between 0 and 1").count() == 300_000
    assert labelled.ROWS * quality.WIDTH * 4 < 32 << 20


def test_ann(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    x[1000:2000] = x[1000]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0]), (9020, [None] * 16), (None, [1.0] * 16)]
    rows += [(10000 + i, [float(i % 3), 1.0]) for i in range(30)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), lambda i: i % 20 == 0).collect()
    hit = 0
    for i in range(0, 3000, 20):
        s = (x * x[i]).sum(1)
        s[i] = -np.inf
        mine = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])
        assert len(mine) == 20 and all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)
        assert all((a["score"], -a["vec_id"]) > (b["score"], -b["vec_id"]) for a, b in zip(mine, mine[1:]))
        assert all(r["vec_id"] < 3000 for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
    assert hit / 3000 >= 0.9
    # vectors of a rarer length are searched among themselves
    short = {i: [float(i % 3), 1.0] for i in range(30)}
    for i in (0, 20):
        want = sorted((-(short[i][0] * v[0] + 1.0), j) for j, v in short.items() if j != i)[:20]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == 10000 + i), key=lambda r: r["rank"])] == [(n + 1, 10000 + j, -s) for n, (s, j) in enumerate(want)]


def test_cut_in_task_keeps_the_best(monkeypatch):
    rng = np.random.default_rng(3)
    parts = [(rng.integers(0, 50, 300), rng.integers(0, 10**6, 300), rng.integers(0, 40, 300) / 4.0) for _ in range(20)]
    whole = [np.concatenate(c) for c in zip(*parts)]
    want = sorted(zip(*(c.tolist() for c in ann.cut(*whole, 7))))
    for held in (ann.HELD, 600):
        monkeypatch.setattr(ann, "HELD", held)
        out = [b.to_pydict() for b in ann.cut_in_task(iter(parts), 7)]
        flat = [np.concatenate([b[c] for b in out]) for c in ("query_id", "vec_id", "score")]
        assert sorted(zip(*(c.tolist() for c in ann.cut(*flat, 7)))) == want and len(flat[0]) < 6000
    by_hand = sorted(zip(*whole), key=lambda r: (r[0], -r[2], r[1]))
    assert [r for q in range(50) for r in [x for x in by_hand if x[0] == q][:7]] == [tuple(r) for r in zip(*ann.cut(*whole, 7))]


def test_ann_visits_until_enough_rows_are_seen(spark):
    """Leaves of few rows: every query still gets as many neighbours as there are."""
    tree = {"centres": np.eye(4)[[0, 0, 1, 2]], "child": np.array([1, 0, 0, 0]), "count": np.array([3, 0, 0, 0]), "leaf": np.array([-1, 0, 1, 2])}
    assert ann.visits(np.eye(4)[:1], tree, 1, np.array([2, 5, 50]), 1) == [[0]]
    assert [len(v) for v in ann.visits(np.eye(4)[:1], tree, 1, np.array([2, 5, 50]), 8)] == [3]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, queries.tokenizer("byte_bpe_50k.json")).count() == 0
    assert sentencepiece_codec.encode_digest(none, queries.tokenizer("piece_bpe_32k.model")).count() == 0
    assert substring_dedup.dedup_digest(none).count() == 0 and line_dedup.dedup(none).count() == 0
    assert ngram_jaccard.linked_documents(none).count() == 0
    assert decontamination.contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 20 == 0).count() == 0


def test_extra_columns_with_clashing_names(spark):
    """Columns named as the operators' own, of other types, change no result."""
    names = ["payload_digest", "record_type", "chunk_no", "record", "last", "query_id", "rank", "score", "leaf", "node", "h", "label", "lid", "held_out", "n_tokens", "n_bytes", "item_id", "slot", "bucket", "kid", "rep", "component_id", "_repeat_id"]

    def more(df):
        for n in names:
            df = df.withColumn(n, F.lit("clash"))
        return df

    texts_ = [None, "", "plain words here", "plain words here", "a b c d e f g h i j k l m n o p q r s t u", "x a b c d e f g h i j k l m n o p q r s t u"]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, None, "x" * 200), (3, "u", None)], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    items = spark.createDataFrame([(1, texts_[4])], "item_id long, text string")
    runs = {
        "tokens": lambda f: token_counts.count_tokens(f(docs), queries.tokenizer("byte_bpe_50k.json")),
        "pieces": lambda f: sentencepiece_codec.encode_digest(f(docs), queries.tokenizer("piece_bpe_32k.model")),
        "quality": lambda f: quality.score(f(docs), quality.train(f(docs), labels)),
        "toxicity": lambda f: toxicity.score(f(docs), toxicity.train(f(docs), labels)),
        "warc": lambda f: warc.round_trip(f(pages)),
        "jaccard": lambda f: ngram_jaccard.linked_documents(f(docs)),
        "decontamination": lambda f: decontamination.contamination(f(docs), items),
        "substrings": lambda f: substring_dedup.dedup_digest(f(docs)),
        "lines": lambda f: line_dedup.dedup_digest(f(docs)),
        "ann": lambda f: ann.search(f(vectors), lambda i: i % 20 == 0),
    }
    for name, run in runs.items():
        want, got = run(lambda df: df), run(more)
        assert want.columns == got.columns and sorted(map(str, want.collect())) == sorted(map(str, got.collect())), name
    assert toxicity.accepted(more(docs), toxicity.train(docs, labels)).columns == more(docs).columns
    assert line_dedup.dedup(more(docs)).columns == more(docs).columns
