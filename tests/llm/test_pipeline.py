"""The pipeline's stages against plain Python on a small corpus with nulls, copies, toxic texts and a clashing column."""

import re
from hashlib import sha256

import numpy as np

import corpus_pipeline
from tensorloom.llm import queries

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _repeat_id long, _repeat_starts string"


def corpus():
    rng = np.random.default_rng(8)
    say = lambda n: "number and more plain words here " + " ".join(f"w{i}" for i in rng.integers(0, 500, n))
    clean = [f"plain words here number {i} and more" for i in range(60)]
    toxic = [f"plain awful!! WORDS!! {i} HERE!!" for i in range(60)]
    base, leak, block = say(120), say(40), "number and more first\nnumber and more second\nnumber and more third"
    more = [None, "", " \n ", base, base, base.upper(), base + " tail", say(80) + " " + leak, say(50), block + "\n" + say(20), say(20) + "\n" + block, block, say(20000)]
    return clean + toxic + more, leak


def without_lines(texts):
    seen, out = set(), []
    for t in texts:
        lines, gone = t.split("\n") if t else [], set()
        for k in range(len(lines) - 2):
            key = tuple(lines[k : k + 3])
            if "".join(key).strip(" \t\n\v\f\r"):
                gone |= {k, k + 1, k + 2} if key in seen else set()
                seen.add(key)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t)
    return out


def components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return comp


def leaks(text, item):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = lambda w: {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    return bool(wins(cut(text)) & wins(cut(item)))


def test_every_stage(spark, tmp_path):
    import sentencepiece

    texts, item = corpus()
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1, "y") for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, (None, "plain words here number and more", *[None] * 6)], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = {i: t for i, t in enumerate(texts) if not 60 <= i < 120}
    expected = [dict(want)]
    want = dict(zip(want, without_lines(want.values())))
    expected.append(dict(want))
    ids = list(want)
    want = {i: want[i] for i, c in zip(ids, components(list(want.values()))) if ids[c] == i}
    expected.append(dict(want))
    want = {i: t for i, t in want.items() if not leaks(t, item)}
    expected.append(dict(want))
    assert [len(texts) - 60 - len(e) for e in expected] == [0, 0, 3, 4]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), right in zip(corpus_pipeline.STAGES, expected):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
        assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None} == right, name
        assert len(got) == len(right) + 1 and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got if r["doc_id"] is not None), name
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    got = {r[0]: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r[0] is not None}
    pieces = {i: sp.encode(t or "") for i, t in want.items()}
    assert got == {i: (len(p), sha256(np.array(p, "<i4").tobytes()).hexdigest(), True) for i, p in pieces.items()}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
