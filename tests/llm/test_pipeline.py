"""The pipeline, stage by stage, against plain versions of what each stage has to do."""

import random
import zlib
from collections import Counter

import corpus_pipeline
from stowage.llm.tokenizing import load
from tests.llm.conftest import documents, words
from tests.llm.test_brute_force import BLANK, base_counts, removals, targets


def corpus():
    rng = random.Random(31)
    letters = str.maketrans("0123456789", "abcdefghij")
    text = lambda n: ". ".join(words(rng, 9, 5000).translate(letters).capitalize() for _ in range(n)) + "."
    clean = [text(rng.randrange(10, 30)) for _ in range(120)]
    passage = text(4)
    texts = [t if k % 10 else f"{t} {passage} {text(3)}" for k, t in enumerate(clean)]
    near = []
    for t in texts[:15]:
        w = t.split()
        w[len(w) // 2] = "altered"
        near.append(" ".join(w))
    junk = [" ".join(w + "***" for w in text(14).split()) for _ in range(12)]
    loud = [" ".join(w.upper() + "!!" for w in text(14).split()) for _ in range(12)]
    short = ["only a few words"] * 5
    every = texts + texts[20:35] + near + junk + loud + short
    return [(k, t, f"s{k % 3}") for k, t in enumerate(every)], len(texts), len(texts) + 15, len(texts) + 30


def run_stage(spark, k, docs):
    out = corpus_pipeline.STAGES[k][1](spark, docs, "unused")
    return spark.createDataFrame(out.collect(), out.schema)


def test_stages(spark):
    rows, n_clean, n_exact, n_near = corpus()
    docs = documents(spark, rows)
    text = {i: t for i, t, _ in rows}

    good = run_stage(spark, 0, docs)
    ids = {r["doc_id"] for r in good.collect()}
    assert ids == set(range(n_near))
    assert all(base_counts(text[i])[0] >= 50 for i in ids)

    one = run_stage(spark, 1, good)
    kept = [r["doc_id"] for r in one.collect()]
    assert len(kept) == len(set(kept))
    # All of the originals stay, no exact copy does, and near copies of one word in a hundred go.
    assert set(range(n_clean)) <= set(kept)
    assert not set(kept) & set(range(n_clean, n_exact))
    assert len(set(kept) & set(range(n_exact, n_near))) <= 2

    cut = run_stage(spark, 2, one)
    want = removals([(i, text[i], "") for i in kept])
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert {i: len(BLANK.findall(t.encode())) for i, t in got.items()} == {i: n - gone for i, (n, gone, _) in want.items()}
    assert sum(gone for _, gone, _ in want.values()) > 200

    mixed = run_stage(spark, 3, cut)
    assert mixed.columns == docs.columns
    source = {i: s for i, _, s in rows}
    size, taken = Counter(), Counter()
    for i, t in got.items():
        size[source[i]] += len(BLANK.findall(t.encode()))
    copies = Counter(r["doc_id"] for r in mixed.collect())
    for i, n in copies.items():
        assert n <= 3
        taken[source[i]] += n * len(BLANK.findall(got[i].encode()))
    for s, target in targets(size).items():
        assert abs(taken[s] - target) <= max(len(t) for i, t in got.items() if source[i] == s)

    packed = run_stage(spark, 4, mixed).collect()
    model = load("word_bpe_49k.json")
    ids = {i: [*model.encode(t, add_special_tokens=False).ids, 0] for i, t in got.items()}
    want = Counter((i, k // 2048, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[i][k : k + 2048]))) for i, n in copies.items() for _ in range(n) for k in range(0, len(ids[i]), 2048))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == want
    bins = Counter()
    for r in packed:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048


def test_run_gives_the_last_stage(spark, tmp_path):
    rows = corpus()[0]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 50
