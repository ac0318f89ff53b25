"""Operators against plain versions that look at every pair, window or word."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import lm_score, media, mixing, packing, quality, simhash, substring, url_filter, warc
from stowage.llm.tokenizing import load
from tests.llm.conftest import documents, words

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=60):
    """Texts with exact and near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    passage = words(rng, 35, 60)
    texts = []
    for k in range(n):
        kind = k % 6
        if kind == 1 and texts:
            texts.append(texts[-1])
        elif kind == 2 and texts:
            w = texts[-1].split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(f"{words(rng, rng.randrange(40), 60)}\n{passage} {words(rng, 25, 60)}")
        else:
            texts.append(words(rng, rng.randrange(1, 160), rng.choice([3, 60, 500])))
    ids = list(range(n))
    rng.shuffle(ids)
    return [(i, t, f"s{i % 4}") for i, t in zip(ids, texts, strict=True)]


# Repeated passages -----------------------------------------------------------------------------


def removals(rows, size=20):
    first = {}
    split = {i: BLANK.findall((t or "").encode()) for i, t, _ in rows}
    for i in sorted(split):
        w = split[i]
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), (i, k))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (i, k):
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "group"), [(1, 20_000), (2, 1), (3, 2), (4, 5)])
def test_substring(spark, monkeypatch, seed, group):
    """With a bound of one suffix every prefix is lengthened to the whole window; with a few, some are."""
    split = substring.split_by_prefix
    monkeypatch.setattr(substring, "split_by_prefix", lambda s: split(s, group))
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.removals(documents(spark, rows)).collect()}
    assert got == removals(rows)
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring.without_repeats(documents(spark, rows)).collect()}
    for i, t, _ in rows:
        if got[i][1] == 0:
            assert kept[i] == (t, len(t))
        else:
            assert hashlib.sha256(kept[i][0].encode()).hexdigest() == got[i][2]
            assert kept[i][1] == len(kept[i][0])


def test_a_suffix_tree_node_needs_whole_words():
    body = lambda last: " ".join(["w"] * 19 + [last]) + " "
    marked = lambda *bodies: [x for node in substring.subtree(sorted((b, [(k, k, 0)]) for k, b in enumerate(bodies)), substring._all_of) for x in substring.later_suffixes(*node)]
    assert marked(body("ab"), body("abc"), body("ab\x01")) == []
    assert marked(body("ab"), body("ab")) == [(1, 1, 0, 1)]


def test_subtrees_give_all_internal_nodes():
    rng = random.Random(17)
    for _ in range(50):
        n = rng.randrange(2, 40)
        suffixes = sorted("".join(rng.choice(["a ", "b ", "ab "]) for _ in range(rng.randrange(1, 9))) for _ in range(n))
        want = Counter()
        for words in range(2, 9):
            for head in {tuple(x.split()[:words]) for x in suffixes}:
                below = [k for k, x in enumerate(suffixes) if tuple(x.split()[:words]) == head]
                deeper = {tuple(suffixes[k].split()[: words + 1]) for k in below}
                # A node is where suffixes part, or where one of several ends.
                if len(head) == words and len(below) > 1 and (len(deeper) > 1 or any(len(suffixes[k].split()) == words for k in below)):
                    want[words, tuple(below)] += 1
        got = Counter((depth, tuple(sorted(leaves))) for depth, leaves, _ in substring.subtree([(x, [k]) for k, x in enumerate(suffixes)], substring._all_of, 2))
        assert got == want


@pytest.mark.parametrize(("seed", "group"), [(1, 20_000), (5, 2)])
def test_maximal_repeats(spark, monkeypatch, seed, group):
    split = substring.split_by_prefix
    monkeypatch.setattr(substring, "split_by_prefix", lambda s: split(s, group))
    rng = random.Random(seed)
    rows = corpus(seed, 36) + [(900, words(rng, 700, 9), "a"), (901, "x " * 60, "a")]
    split_texts = {i: BLANK.findall((t or "").encode()) for i, t, _ in rows}
    places = {}
    for i, w in split_texts.items():
        for k in range(len(w) - 19):
            places.setdefault(tuple(w[k : k + 20]), []).append((i, k))
    want = Counter()
    before = lambda i, k: split_texts[i][k - 1] if k else None
    level = {k: v for k, v in places.items() if len(v) > 1}
    size = 20
    while level:
        longer = {}
        for run, at in level.items():
            after = {}
            for i, k in at:
                if k + size < len(split_texts[i]):
                    after.setdefault(split_texts[i][k + size], []).append((i, k))
            right = len(after) > 1 or sum(map(len, after.values())) < len(at)
            left = len({before(i, k) for i, k in at}) > 1 or any(k == 0 for _, k in at)
            if right and left:
                want[(size, len(at), *min(at))] += 1
            longer |= {(*run, w): v for w, v in after.items() if len(v) > 1}
        level, size = longer, size + 1
    got = Counter((r["n_words"], r["n"], r["doc_id"], r["start"]) for r in substring.maximal_repeats(documents(spark, rows)).collect())
    assert got == want
    assert max(n for n, *_ in want) > 30


# SimHash -------------------------------------------------------------------------------------------


def plain_fingerprint(text, size=4):
    from xxhash import xxh64_intdigest

    w = BLANK.findall((text or "").encode().lower())
    shingles = [b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash(spark):
    rows = corpus(7, 80)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    fps = {i: plain_fingerprint(t) for i, t, _ in rows}
    roots = groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in fps}
    assert F.xxhash64  # the same hash as Spark's own
    assert spark.sql("SELECT xxhash64('a b c d')").first()[0] == int(np.uint64(simhash.shingle_hashes(b"a b c d")[0]).view(np.int64))


@pytest.mark.parametrize(("tile", "blocks"), [(16_384, 6), (10, 6), (16_384, 7), (16_384, 8)])
def test_links_lose_nothing(spark, monkeypatch, tile, blocks):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(11)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))))
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    df = spark.createDataFrame([(x, x) for (x,) in signed], "node long, f0 long")
    keyed = df.select(F.explode(simhash.bucket_keys(F.col("f0"), blocks)).alias("key"), "node", "f0")
    stars = {r["node"]: r["root"] for r in simhash.components(simhash.links(keyed)).collect()}
    nodes = sorted(x for (x,) in signed)
    want = groups(nodes, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert {n: stars.get(n, n) for n in nodes} == want


@pytest.mark.parametrize("radius", [0, 1, 4, 6, 43])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 64, (200, 2), dtype=np.uint64)
    for k in range(1, 200, 2):
        fps[k] = fps[k - 1]
        for b in rng.choice(128, rng.integers(0, 10 + radius), replace=False):
            fps[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    keys = np.repeat([1, 2], 100)
    u, v = simhash.bucket_links(keys, np.arange(200), fps, radius)
    far = lambda a, b: sum(int(x).bit_count() for x in fps[a] ^ fps[b]) > radius
    want = groups(range(200), lambda a, b: a // 100 == b // 100 and not far(a, b))
    got = dict(zip(u.tolist(), v.tolist(), strict=True))
    assert {n: got.get(n, n) for n in range(200)} == want


def test_near_copies_at_a_similarity_of_four_fifths(spark):
    rng = random.Random(23)
    rows, pairs = [], []
    for k in range(40):
        w = words(rng, 300, 5000).split()
        changed = list(w)
        for at in rng.sample(range(300), 5):
            changed[at] = f"new{k}"
        rows += [(2 * k, " ".join(w), "a"), (2 * k + 1, " ".join(changed), "a")]
        pairs.append((2 * k, 2 * k + 1))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(documents(spark, rows)).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 36
    assert len(set(got.values())) >= 40


# Quality ---------------------------------------------------------------------------------------------


def base_counts(text):
    t = text or ""
    w = [x.decode() for x in BLANK.findall(t.encode())]
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if BLANK.search(x.encode())]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, awkward):
    rng = random.Random(2)
    rows = corpus(5) + [(100 + k, "\n".join(words(rng, rng.randrange(6), 4) for _ in range(30)) + "##$ <a|b> É", "z") for k in range(20)]
    rows += [(1000 + k, t, s) for k, (_, t, s) in enumerate(awkward)]
    got = {r["doc_id"]: r for r in quality.verdicts(documents(spark, rows)).collect()}
    for i, t, _ in rows:
        n, chars, symbols, lines, repeated = base_counts(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated), i
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_learns_which_rules_to_trust(spark):
    rng = random.Random(9)
    letters = str.maketrans("0123456789", "abcdefghij")
    some = lambda n: words(rng, n, 3000).translate(letters)
    clean = [(k, ". ".join(some(9).capitalize() for _ in range(12)) + ".", "a") for k in range(200)]
    marks = ["***", "###", "$$$"]
    junk = [(1000 + k, " ".join(w + rng.choice(marks) for w in some(120).split()), "a") for k in range(30)]
    loud = [(2000 + k, " ".join(w.upper() + "!!" for w in some(120).split()), "a") for k in range(20)]
    kept = {r["doc_id"] for r in quality.keep_good(documents(spark, clean + junk + loud)).collect()}
    assert kept == {k for k, _, _ in clean}


# Mixing ------------------------------------------------------------------------------------------------


def targets(sizes):
    """Shares by weight, what passes three times a size shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(k, words(rng, rng.randrange(120)), rng.choice(["a", "b", "b", "b", None, "é", "Z", "c"])) for k in range(400)]
    rows.append((999, words(rng, 30), "tiny"))
    docs = documents(spark, rows)
    got = mixing.mix_table(docs).collect()
    size, source = {i: len((t or "").split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    sizes = Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    want, taken = targets(sizes), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s])
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(v for i, v in size.items() if source[i] == s)
    again = mixing.mix_table(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    mixed = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert mixed == Counter({r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]})


def test_positions_follow_the_schedules(spark):
    rows = [(k, "w " * 10, "abc"[k % 3]) for k in range(600)]
    got = mixing.mix_table(documents(spark, rows)).collect()
    mean = {s: np.mean([r["position"] for r in got if "abc"[r["doc_id"] % 3] == s and r["position"] is not None]) for s in "abc"}
    assert mean["b"] < mean["a"] or mean["c"] > mean["a"]
    assert mean["b"] < mean["c"]


# Packing -------------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(4)
    rows = corpus(2, 40) + [(500, words(rng, 6000, 20_000), "a"), (501, "w " * 2047, "a"), (502, "w " * 2048, "a"), (503, None, "a")]
    model = load("word_bpe_49k.json")
    got = packing.pack(documents(spark, rows)).collect()
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t, _ in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert len(parts) == -(-len(ids) // 2048)
        for k, r in enumerate(parts):
            part = ids[2048 * k : 2048 * (k + 1)]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, 2048 * k, len(part), zlib.crc32(part.tobytes()))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.1 * sum(r["length"] for r in got) / 2048 + 1


# Media -----------------------------------------------------------------------------------------------------


def test_media(spark):
    rng = random.Random(6)
    shared = words(rng, 3000, 9000)
    rows = corpus(8) + [(700, shared, "a"), (701, shared + " end", "a"), (702, "start " + shared, "a"), (703, None, "a"), (704, "", "a"), (705, "x" * 576, "a")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in media.media_table(docs).collect()}
    for i, t, _ in rows:
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
    assert got[703]["media_sha256"] == got[704]["media_sha256"] != got[705]["media_sha256"]
    lists, store = media.store_media(docs)
    held = store.df.where("kind = 1").count()
    assert held > 3
    assert store.df.where("kind = 1").select("key").distinct().count() == held
    chunks = lists.dropDuplicates(["payload"]).select(F.explode("digests").alias("d"))
    assert chunks.count() > chunks.distinct().count()
    # The digest of a medium is that of the bytes in the store that it is rebuilt from.
    packs = {bytes(r["key"]): r for r in store.df.where("kind = 0").collect()}
    shared = {bytes(r["key"]): bytes(r["data"]) for r in store.df.where("kind = 1").collect()}
    for r in got.values():
        pack = packs[bytes.fromhex(r["payload_sha256"])]
        stored = bytes(pack["list"]) + bytes(pack["data"]) + b"".join(shared[bytes(d)] for d in pack["taken"])
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_cuts_follow_the_content():
    gear, rng = media._gear(), random.Random(1)
    data = rng.randbytes(200_000)
    one, two = media.chunks_of(data, gear), media.chunks_of(b"some bytes in front" + data, gear)
    assert b"".join(one) == data
    assert all(len(c) <= media.MOST for c in one) and all(len(c) >= media.LEAST for c in one[:-1])
    assert len(set(one) & set(two)) > 0.9 * len(one)


def test_damaged_media_are_noticed(spark):
    _, store = media.store_media(documents(spark, [(1, "some text " * 300, "a")]))
    worse = store.df.withColumn("data", F.when(F.col("kind") == 0, F.lit(zlib.compress(b"z" * 3168))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="damaged"):
        media.read_media(worse).collect()


# WARC ------------------------------------------------------------------------------------------------------


def test_warc(spark):
    rng = random.Random(3)
    rows = [(k, f"https://h{k}.org/", rng.choice([None, "", "<p>same</p>", words(rng, 50), "é" * 500])) for k in range(200)]
    got = {r["page_id"]: r for r in warc.warc_table(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    last = {}
    for k, _, html in rows:
        last[html or ""] = k
    for k, url, html in rows:
        data = (html or "").encode()
        r = got[k]
        assert (r["payload_bytes"], r["payload_digest"], r["url"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), url)
        first = last[html or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == k else ("revisit", first))


def test_reader_is_sequential_and_notices_damage():
    import io

    parts = [warc.record(k, "u", b"payload %d " % k * 9000, None, False) for k in range(5)]
    records = list(warc.read_records(io.BytesIO(b"".join(parts))))
    assert [p for _, _, p in records] == [b"payload %d " % k * 9000 for k in range(5)]
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(b"".join(parts)[:-20])))
    inside = zlib.decompress(parts[0], 31).replace(b"payload 0", b"payload X", 1)
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(squeeze.compress(inside) + squeeze.flush())))
    assert list(warc.read_records(io.BytesIO(b""))) == []


# Language model -----------------------------------------------------------------------------------------------


def lm_corpus():
    rng = random.Random(12)
    nouns, verbs, rare = [f"n{k}" for k in range(30)], [f"v{k}" for k in range(30)], [f"r{k}" for k in range(400)]
    line = lambda: " ".join(rng.choice(rare) if rng.random() < 0.05 else rng.choice(nouns if k % 2 else verbs) for k in range(rng.randrange(60)))
    rows = [(k, line().title() if k % 7 else None, "a") for k in range(300)] + [(300, "n1 " + "y" * 200 + " v1", "a"), (302, "y" * 200, "a"), (303, "Y" * 200 + " v2", "a")]
    tok = {i: [*BLANK.findall((t or "").encode().lower()), b"\n"] for i, t, _ in rows}
    return rows, tok, {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in rows}


@pytest.mark.parametrize(("context", "head"), [(20, 40), (2048, 100_000), (0, 0)])
def test_lm_scores(spark, monkeypatch, context, head):
    """Scores word by word from the classes that training gave, counted anew."""
    monkeypatch.setattr(lm_score, "CONTEXT", context)
    monkeypatch.setattr(lm_score, "HEAD", head)
    rows, tok, out = lm_corpus()
    docs = documents(spark, rows)
    of = {bytes(r["word"]): r["cls"] for r in lm_score.train(docs)[1].collect()}
    counts = Counter(w for i in tok if not out[i] for w in tok[i])
    states = set(sorted((w for w in counts if w != b"\n" and len(w) <= 64), key=lambda w: (-counts[w], w))[:context])
    last = lm_score.CLASSES - 1
    assert set(of) == set(counts)
    assert [w for w in of if of[w] == last] == [b"\n"]
    # All words that are met often enough have a class of their own choice, the others share one.
    assert all((of[w] == last - 1) == (counts[w] < lm_score.LEAST and w not in states) for w in counts if w != b"\n")
    state = lambda w: last if w == b"\n" else of[w] if w in states else last - 1
    pairs, single, members = Counter(), Counter(), Counter(of.values())
    for i in tok:
        if not out[i]:
            for a, b in zip([b"\n", *tok[i]], tok[i], strict=False):
                pairs[state(a), of[b]] += 1
                single[of[b]] += 1
    total, d = sum(single.values()), lm_score.DELTA

    def transition(s, c):
        row = [pairs[s, k] for k in range(last + 1)]
        kinds = sum(x > 0 for x in row) + 1
        return (pairs[s, c] + kinds * (single[c] + d) / (total + d * (last + 1))) / (sum(row) + kinds)

    room = lambda c: max(1, members[c] + (c == last - 1))
    emission = lambda w, c: (counts[w] + d) / (single[c] + d * room(c))
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm_score.scores(docs).collect()}
    for i, w in tok.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(w), sum(x in counts for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        want = sum(math.log10(transition(state(a), of.get(b, last - 1)) * emission(b, of.get(b, last - 1))) for a, b in zip([b"\n", *w], w, strict=False))
        assert r["score"] == pytest.approx(want)
    for s in range(last + 1):
        assert sum(transition(s, c) for c in range(last + 1)) == pytest.approx(1)
    for c in set(of.values()):
        unseen = d / (single[c] + d * room(c)) if c == last - 1 else 0
        assert sum(emission(w, c) for w in of if of[w] == c) + unseen == pytest.approx(1)
    if context:
        held = [r for i, r in got.items() if out[i]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize(("singly", "head"), [(10, 40), (0, 0)])
def test_all_words_are_states(spark, monkeypatch, singly, head):
    """By default the class of every word is the state before the next, whatever the driver and the tasks know."""
    monkeypatch.setattr(lm_score, "SINGLY", singly)
    monkeypatch.setattr(lm_score, "HEAD", head)
    rows, tok, out = lm_corpus()
    docs = documents(spark, rows).repartition(40)  # more than tasks that write
    of = {bytes(r["word"]): r["cls"] for r in lm_score.train(docs)[1].collect()}
    counts = Counter(w for i in tok if not out[i] for w in tok[i])
    last, d = lm_score.CLASSES - 1, lm_score.DELTA
    first = set(sorted((w for w in counts if w != b"\n" and len(w) <= 64), key=lambda w: (-counts[w], w))[:singly])
    assert all((of[w] == last - 1) == (counts[w] < lm_score.LEAST and w not in first) for w in counts if w != b"\n")
    grid, words = np.zeros((last + 1, last + 1)), np.bincount(list(of.values()), minlength=last + 1)
    cls = lambda w: of.get(w, last - 1)
    for i in tok:
        if not out[i]:
            for a, b in zip([b"\n", *tok[i]], tok[i], strict=False):
                grid[of[a], of[b]] += 1
    model = lm_score.ClassModel(grid, words, sum(counts.values()), len(counts))
    got = {r["doc_id"]: r for r in lm_score.scores(docs).collect()}
    for i, w in tok.items():
        want = sum(model.transition[cls(a), cls(b)] + math.log10(counts[b] + d) - model.log_class[cls(b)] for a, b in zip([b"\n", *w], w, strict=False))
        assert got[i]["score"] == pytest.approx(want)
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(w), sum(x in counts for x in w))


def test_words_beyond_the_context_join_their_likes(spark, monkeypatch):
    """With few context words, words that follow the same ones get the same class, whatever their names."""
    monkeypatch.setattr(lm_score, "CONTEXT", 4)
    rng = random.Random(5)
    rows = [(k, " ".join(f"{left} {left} {rng.choice([left + str(j) for j in range(40)])}" for left in rng.choices(["aa", "bb", "cc", "dd"], k=40)), "a") for k in range(300)]
    of = {bytes(r["word"]).decode(): r["cls"] for r in lm_score.train(documents(spark, rows))[1].collect()}
    groups = [{of[f"{left}{j}"] for j in range(40)} for left in ("aa", "bb", "cc", "dd")]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4


def test_exchange_finds_the_classes():
    n = 24
    counts = np.zeros((n + 1, n + 1))
    for a in range(n):
        counts[a, [b for b in range(n) if b % 3 == (a + 1) % 3]] = 5 + a % 2
    counts[n, :n] = counts[:n, n] = 1
    of = lm_score.exchange(counts, 4)
    assert len({(k % 3, of[k]) for k in range(n)}) == 3 == len(set(of[:n]))
    assert of[n] == 3 and not (of[:n] == 3).any()


# Link graph -----------------------------------------------------------------------------------------------------


def test_ranks_against_a_matrix(spark):
    rng = random.Random(8)
    edges = {(f"h{a}", f"h{b}"): float(rng.randrange(1, 4)) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(30)) if a != b}
    seeds = {"h0": (3, 0), "h1": (0, 2), "h5": (1, 4)}
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(
        spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double"),
        spark.createDataFrame([(h, a, b) for h, (a, b) in seeds.items()], "host string, allowed long, blocked long"),
        1e-7,
    ).collect()}
    hosts = [f"h{k}" for k in range(12)]
    for side in (0, 1):
        m = np.zeros((12, 12))
        for (a, b), w in edges.items():
            a, b = (a, b) if side == 0 else (b, a)
            m[hosts.index(b), hosts.index(a)] = w
        m = m / np.maximum(m.sum(axis=0), 1e-12)
        s = np.array([seeds.get(h, (0, 0))[side] for h in hosts], dtype=float)
        r = np.linalg.solve(np.eye(12) - url_filter.DAMPING * m, (1 - url_filter.DAMPING) * s)
        for k, h in enumerate(hosts):
            assert got.get(h, (0, 0))[side] == pytest.approx(r[k], rel=1e-5)


def test_a_long_chain_is_walked_to_its_end(spark):
    edges = spark.createDataFrame([(f"h{k:02}", f"h{k + 1:02}", 1.0) for k in range(30)], "src string, dst string, weight double")
    got = {r["host"]: r["trust"] for r in url_filter.propagate(edges, spark.createDataFrame([("h00", 1, 0)], "host string, allowed long, blocked long")).collect()}
    assert got == pytest.approx({f"h{k:02}": 0.15 * 0.85**k for k in range(31)})


def test_strangers_below_a_public_suffix_share_no_owner(spark):
    rows = [("a.b.co.uk", None), ("x.github.io", None), ("w.x.github.io", None), ("c.d.com", None), ("co.uk", None)]
    got = {(r["src"], r["dst"]) for r in url_filter.host_edges(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert got == {(a, b) for p in (("a.b.co.uk", "b.co.uk"), ("w.x.github.io", "x.github.io"), ("c.d.com", "d.com")) for a, b in (p, p[::-1])}


def test_links_of_pages_join_hosts(spark):
    rows = [("a.x.org", '<a href="https://B.y.org/p">q</a> <A class="z" HREF=\'//c.net\'>r</A> <a href="/own">s</a>'), ("a.x.org", '<a href="https://b.y.org">')]
    got = {(r["src"], r["dst"]): r["weight"] for r in url_filter.host_edges(spark.createDataFrame(rows, "host string, html string")).collect()}
    half = url_filter.FAMILY
    assert got == {("a.x.org", "b.y.org"): 2.0, ("a.x.org", "c.net"): 1.0, ("a.x.org", "x.org"): half, ("x.org", "a.x.org"): half, ("b.y.org", "y.org"): half, ("y.org", "b.y.org"): half}
