"""Operators on asset collections: truth tables and invariants."""

import gzip
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowage.functions import content, globs, keys
from stowage.operators import diff, dml, merge, metrics, profile, store

ENTRY = "path string, hash string"


def entries(spark, **of):
    return spark.createDataFrame(list(of.items()), ENTRY)


def paths(df):
    return sorted(r["path"] for r in df.collect())


def column(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


GLOBS = [
    ("file.txt", "*.txt", True), ("dir/file.txt", "*.txt", False), ("dir/subdir/file.txt", "dir/*.txt", False), ("dir/file.txt", "dir/*.txt", True),
    ("file.txt", "**/*.txt", True), ("data/file.txt", "data/**/*.txt", True), ("logs/file.txt", "data/**/*.txt", False), ("very/deep/nested/file.txt", "**/*.txt", True),
    ("a1.bin", "a[0-9].bin", True), ("ab.bin", "a[!0-9].bin", True), ("a1.bin", "a[!0-9].bin", False), ("ab", "a?", True), ("a/", "a?", False),
    ("x/y", "x/**", True), ("x", "x/**", True), ("a[1].txt", "**/a[1].txt", True), ("a.b", "a.b", True), ("aXb", "a.b", False), ("a&b", "a[&]b", True),
]


def test_globs(spark):
    rows = spark.createDataFrame([(p,) for p, _, _ in GLOBS], "path string")
    for pattern in {g for _, g, _ in GLOBS}:
        hit = {r["path"] for r in rows.where(globs.matches("path", pattern)).collect()}
        for path, glob, expected in GLOBS:
            if glob == pattern:
                assert (path in hit) == expected, (path, pattern)


@settings(max_examples=200, deadline=None)
@given(st.text("ab*?[]!-.", max_size=8), st.text("ab-.!]", max_size=8))
def test_segment_globs_agree_with_fnmatch(pattern, text):
    import fnmatch
    import re
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("error")
        try:
            ours = re.fullmatch(globs.compile_glob(pattern, "segment").removeprefix(r"\A").removesuffix(r"\z"), text) is not None
        except (re.error, FutureWarning):
            return
    if "-" not in pattern:
        assert ours == fnmatch.fnmatchcase(text, pattern)


def test_selection_falls_back_to_the_directory(spark):
    rows = spark.createDataFrame([(p,) for p in ("file1.txt", "data/dataset1.txt", "data/subdir/nested.txt", "logs/app.log")], "path string")
    assert paths(globs.select(rows, "*.txt")) == ["file1.txt"]
    assert paths(globs.select(rows, "data")) == ["data/dataset1.txt", "data/subdir/nested.txt"]
    assert paths(globs.select(rows, "logs/app.log")) == ["logs/app.log"]
    assert paths(globs.select(rows, "nothing")) == []
    gone = dml.remove_matching(rows, "data*txt")
    assert paths(gone) == ["file1.txt", "logs/app.log"]
    assert paths(dml.remove_matching(rows, "logs")) == ["data/dataset1.txt", "data/subdir/nested.txt", "file1.txt"]


def test_keys(spark):
    assert [column(spark, p, keys.normalise) for p in ("a/./b/../c", "a//b", "../x", "/x", "a/..", "")] == ["a/c", "a/b", None, None, "", ""]
    assert [column(spark, p, keys.is_valid_key) for p in ("a/b", "", "/a", "a/", "../a", "a/../b", "a\\b", None)] == [True] + [False] * 7
    assert [column(spark, p, keys.shard_for) for p in ("a/b/c", "top.txt")] == ["a", "_root"]
    assert column(spark, "x.txt", lambda c: keys.from_input(c, "sub")) == "sub/x.txt"
    assert column(spark, "sub/x.txt", lambda c: keys.from_input(c, "sub")) == "sub/x.txt"
    assert column(spark, "../x.txt", lambda c: keys.from_input(c, "sub")) == "x.txt"
    assert column(spark, r"a[1]*?\b", keys.escape_ignore) == r"a\[1\]\*\?\\b"
    assert [column(spark, n, keys.human_size, "long") for n in (0, 1023, 1024, 1536, 5 << 40, 3 << 50)] == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "5.0 TB", "3.0 PB"]
    assert [column(spark, k, lambda c: keys.is_asset_key("p", c)) for k in ("p/assets/h/p/x.gz", "other/assets/h/f", "p/short", "p/assets/only")] == [True, False, False, False]
    assert [column(spark, p, keys.is_internal) for p in (".git/x", "a/.manifest.yaml", "a.lock", "a/b")] == [True, True, True, False]
    errors = [("SlowDown", 400, True), ("NoSuchKey", 404, False), (None, 429, False), ("Other", 503, True), (None, None, True), ("AccessDenied", None, False), ("InvalidBucketName", 500, False), ("TooManyRequests", 429, False), ("Any", 408, False), ("RequestTimeout", 408, True), ("Throttling", 429, True)]
    retry = spark.createDataFrame(errors, "code string, status int, want boolean")
    assert [r[0] for r in retry.select(keys.is_retryable("code", "status")).collect()] == [x for _, _, x in errors]


def test_coverage_of_look_alikes(spark):
    found = spark.createDataFrame([(f"p/assets/h/a.bin{x}", 1) for x in ("", ".gz", ".gz.chunk0", ".chunk12", ".gz2", ".chunkX", ".chunk1.gz")], "key string, size long")
    base = spark.createDataFrame([("p/assets/h/a.bin",)], "base string")
    got = {r["key"][16:] for r in store.coverage(found, base).collect()}
    assert got == {"", ".gz", ".gz.chunk0", ".chunk12"}


def test_garbage_goes_by_hash_and_path(spark):
    objects = spark.createDataFrame([(k, 1) for k in ("p/assets/same/a/x.bin.gz", "p/assets/same/b/x.bin.gz", "p/assets/h2/big.bin.gz.chunk0", "p/assets/h2/big.bin.gz.chunk1", "p/assets/h3/gone.bin.gz.chunk0", "p/assets/h4/up.bin", "other/key")], "key string, size long")
    manifest = spark.createDataFrame([("b/x.bin", "same"), ("big.bin", "h2")], ENTRY)
    claims = spark.createDataFrame([("p/assets/h4/up.bin", 1000.0), ("p/assets/h3/gone.bin", 1000.0 - 86_461)], "base string, claimed_at double")
    live = store.live_set(manifest, claims, "p", 1000.0)
    got = store.garbage(objects, live, "p")
    assert sorted(r["key"] for r in got.collect()) == ["p/assets/h3/gone.bin.gz.chunk0", "p/assets/same/a/x.bin.gz"]
    assert store.confirmed_garbage(got, got.limit(0)).count() == 0
    assert sorted(r["key"] for r in store.delete_victims("p/assets/h2/big.bin", objects).collect()) == ["p/assets/h2/big.bin.gz.chunk0", "p/assets/h2/big.bin.gz.chunk1"]
    assert [r["key"] for r in store.delete_victims("p/assets/h9/no.bin", objects).collect()] == ["p/assets/h9/no.bin"]


def test_locate_prefers_raw_then_whole_and_needs_all_chunks(spark):
    names = {"a": ["", ".gz", ".chunk0"], "b": [".gz.chunk0", ".gz.chunk1", ".gz.chunk2"], "c": [".gz.chunk0", ".gz.chunk2"], "d": [".gz", ".chunk0", ".chunk1"], "f": [".gz", ".chunk1"]}
    objects = spark.createDataFrame([(f"p/assets/h/{p}{x}", 2) for p, ends in names.items() for x in ends], "key string, size long")
    got = {r["path"]: tuple(r)[1:] for r in store.locate(entries(spark, a="h", b="h", c="h", d="h", e="h", f="h"), objects, "p").collect()}
    assert got == {"a": ("ok", "raw", False, 1, 2), "b": ("ok", "gz", True, 3, 6), "c": ("broken", "gz", True, 2, 4), "d": ("ok", "raw", True, 2, 4), "e": ("missing", None, None, None, None), "f": ("broken", "raw", True, 1, 2)}


def test_status_and_sync(spark):
    manifest, disk = entries(spark, a="1", b="2", c="3"), entries(spark, a="1", b="x")
    states = diff.status(manifest, disk)
    assert {r["path"]: r["status"] for r in states.collect()} == {"a": "up_to_date", "b": "modified", "c": "missing"}
    assert [(r["code"], r["path"]) for r in diff.porcelain(states).collect()] == [("M", "b"), ("D", "c"), (" ", "a")]
    nothing = entries(spark, z="0").limit(0)
    plan = {r["path"]: r["action"] for r in diff.sync_plan(manifest, disk, nothing).collect()}
    assert plan == {"a": "skip", "b": "keep", "c": "download"}
    assert {r["path"]: r["action"] for r in diff.sync_plan(manifest, disk, nothing, force=True).collect()}["b"] == "download"
    prune = diff.prune_plan(spark.createDataFrame([("a",), ("b",), ("q",)], "path string"), disk, entries(spark, a="1"))
    assert {r["path"]: r["action"] for r in prune.collect()} == {"a": "remove", "b": "keep", "q": "skip"}


def test_no_plan_loses_what_the_store_has_not(spark):
    rng = random.Random(4)
    for _ in range(4):
        some = lambda: {f"f{k}": str(rng.randrange(3)) for k in range(30) if rng.random() < 0.7}
        manifest, disk, kept = some(), some(), some()
        safe = {p for p, h in disk.items() if kept.get(p) == h}
        d = entries(spark, **disk)
        recoverable = d.where(F.col("path").isin(*safe, "-"))
        over = {r["path"] for r in diff.sync_plan(entries(spark, **manifest), d, recoverable).where("action = 'download'").collect()}
        gone = {r["path"] for r in diff.prune_plan(d.select("path"), d, recoverable).where("action = 'remove'").collect()}
        assert not {p for p in over if p in disk and p not in safe}
        assert gone == safe


def test_bulk_guard(spark):
    def scan(deleted, checked):
        states = [("deleted" if k < deleted else "unchanged",) for k in range(checked)]
        return diff.bulk_guard(spark.createDataFrame([(str(k), s) for k, (s,) in enumerate(states)], "path string, state string")).first()

    assert tuple(scan(1, 8)) == (8, 1, False)
    assert tuple(scan(8, 8)) == (8, 8, True)
    assert tuple(scan(6, 12)) == (12, 6, False)
    assert tuple(scan(5, 5)) == (5, 5, False)


def test_cache_hits(spark):
    disk = spark.createDataFrame([("a", 1, 5.0, 9, b"x"), ("b", 1, 5.0, None, b"y"), ("c", 1, 5.0, 9, b"z"), ("d", 1, 5.0, 9, b"w")], "path string, size long, mtime double, inode long, content binary")
    cache = spark.createDataFrame([("a", "ha", 1, 5.0, 9, 60.0), ("b", "hb", 1, 5.0, None, 60.0), ("c", "hc", 1, 5.0, 9, 5.5), ("d", "hd", 2, 5.0, 9, 60.0)], "path string, hash string, size long, mtime double, inode long, timestamp double")
    assert {r["path"]: r["hit"] for r in diff.cached_hash(disk, cache).collect()} == {"a": True, "b": True, "c": False, "d": False}
    assert {r["path"]: r["hit"] for r in diff.cached_hash(disk, cache, trust_racy=True).collect()}["c"]


MERGES = [
    ({"s": "h0"}, {"s": "h0", "a": "ha"}, {"s": "h0", "b": "hb"}, {"s": "h0", "a": "ha", "b": "hb"}, set()),
    ({"a": "0"}, {"a": "1"}, {"a": "1"}, {"a": "1"}, set()),
    ({"a": "0"}, {"a": "0"}, {"a": "2"}, {"a": "2"}, set()),
    ({"a": "0", "b": "b"}, {"a": "0", "b": "b"}, {"b": "b"}, {"b": "b"}, set()),
    ({"a": "0"}, {"a": "1"}, {"a": "2"}, {"a": "1"}, {"a"}),
    ({"e": None}, {"e": None}, {"e": None}, {"e": None}, set()),
    ({"e": None}, {"e": None}, {}, {}, set()),
]


@pytest.mark.parametrize(("base", "ours", "theirs", "want", "conflicts"), MERGES)
def test_merge(spark, base, ours, theirs, want, conflicts):
    side = lambda d: spark.createDataFrame(list(d.items()), "key string, value string")
    got = merge.merge_maps(side(base), side(ours), side(theirs)).collect()
    assert {r["key"]: r["value"] for r in got} == want
    assert {r["key"] for r in got if r["conflict"]} == conflicts


def test_merge_lists(spark):
    side = lambda lines: spark.createDataFrame([(x, k) for k, x in enumerate(lines)], "line string, ord long")
    merged = lambda *x: [r["line"] for r in dml.ordinals(merge.merge_lists(*map(side, x))).orderBy("ord").collect()]
    assert merged([], ["/a"], ["/b"]) == ["/a", "/b"]
    assert merged(["/a", "/b"], ["/a", "/b"], ["/b"]) == ["/b"]
    assert merged(["/a"], ["/a", "/c"], ["/d", "/a"]) == ["/a", "/c", "/d"]
    assert merged(["a", "b"], ["b", "x", "a"], ["a", "b"]) == ["a", "b", "x"]
    assert merged(["a", "b"], ["b"], ["a"]) == []


def test_ordinals_across_ranges(spark):
    rows = spark.createDataFrame([(k % 2, k * 30_000, f"l{k}") for k in range(40)], "part int, ord long, line string")
    got = [r["line"] for r in dml.ordinals(rows).orderBy("ord").collect()]
    assert got == [f"l{k}" for k in range(0, 40, 2)] + [f"l{k}" for k in range(1, 40, 2)]
    assert [r["ord"] for r in dml.ordinals(rows).orderBy("ord").collect()] == list(range(1, 41))


def test_marked_blocks(spark):
    file = lambda *lines: spark.createDataFrame(list(enumerate(lines)), "ord long, line string")
    parts = lambda *lines: [(r["section"], r["line"]) for r in dml.split_block(file(*lines), "<", ">").orderBy("ord").collect()]
    assert parts("a", "<", "b", "", " ", "c", ">", "", "d") == [("before", "a"), ("block", "b"), ("block", "c"), ("after", ""), ("after", "d")]
    assert parts("a", ">", "<", "b", "", "c") == [("before", "a"), ("before", ">"), ("after", "b"), ("after", ""), ("after", "c")]
    assert parts("a", "", "b") == [("before", "a"), ("before", ""), ("before", "b")]
    block = file("/a", "/b", "/c")
    assert [r["line"] for r in dml.remove_lines(block, file("/b", "/x")).orderBy("ord").collect()] == ["/a", "/c"]
    written = lambda *lines: [r["line"] for r in dml.write_block(dml.split_block(file(*lines), "<", ">"), "<", ">").orderBy("ord").collect()]
    assert written("a", "<", "b", "", ">", "d") == ["a", "", "<", "b", ">", "d"]
    assert written("a", "", "<", "b", ">") == ["a", "", "<", "b", ">"]
    assert written("<", "b", ">", "d") == ["<", "b", ">", "d"]
    assert written("a", "<", "", ">", "d") == ["a", "d"]
    specs = [("data*/", False, False, "/data*/"), ("data/", True, False, "/data/"), ("r[1]", False, True, "/r\\[1\\]"), ("r[1]/", True, False, "/r\\[1\\]/"), ("x.bin", False, False, "/x.bin"), ("*.bin", False, False, "/*.bin")]
    rows = spark.createDataFrame(specs, "spec string, is_dir boolean, is_file boolean, want string")
    assert [r[0] for r in rows.select(dml.ignore_pattern(F.col("spec"), F.col("is_dir"), F.col("is_file"))).collect()] == [x[-1] for x in specs]


def test_split(spark):
    cut = lambda n: [len(c["content"]) for c in column(spark, b"x" * n, lambda c: content.split(c, 1024), "binary")]
    assert cut(2500) == [1023, 1023, 454]
    assert cut(5) == [5]
    assert cut(1023) == [1023]
    assert cut(2046) == [1023, 1023]
    assert cut(0) == []
    data = random.Random(1).randbytes(5000)
    parts = spark.createDataFrame([("k", bytearray(data))], "manifest_key string, content binary").select("manifest_key", F.explode(content.split(F.col("content"), 700)).alias("c"))
    assert bytes(store.reassemble(parts.select("manifest_key", "c.*")).first()["content"]) == data


def test_compression(spark):
    noise = random.Random(2).randbytes(300 * 1024)
    assert not column(spark, noise, content.should_compress, "binary")
    assert column(spark, b"text " * 1000, content.should_compress, "binary")
    assert not column(spark, b"", content.should_compress, "binary")
    assert column(spark, noise, lambda c: content.should_compress(c, "always"), "binary")
    packed = column(spark, b"abc" * 100, content.gzip_compress, "binary")
    assert gzip.decompress(packed) == b"abc" * 100
    assert column(spark, packed, content.gzip_decompress, "binary") == b"abc" * 100


def test_the_compression_query_against_gzip(spark):
    from stowage.plans.queries import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't here")
    texts = {f"{r['source']}/{r['lang']}/{r['doc_id']}.txt": r["text"].encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {p: bool(t) and len(gzip.compress(t[: 256 * 1024], 1)) < 0.9 * len(t[: 256 * 1024]) for p, t in texts.items()}
    assert {r["path"]: r["compress"] for r in queries()["o_p17_should_compress"](spark, folder).collect()} == want


def test_commit_ranges(spark):
    commits = spark.createDataFrame([(k, f"c{k}") for k in range(6)], "ord long, sha string")
    shas = lambda *ends: [r["sha"] for r in diff.commit_range(commits, *ends).collect()]
    assert shas("c1", "c4") == ["c2", "c3", "c4"]
    assert shas(None, "c1") == ["c0", "c1"]
    assert shas("c4", "c4") == shas("none", "c4") == shas("c1", "none") == []


def test_cone(spark):
    rows = spark.createDataFrame([(p,) for p in ("keep/in.bin", "keep/deep/nested.bin", "root.bin", "drop/out.bin", "a/x", "a/b/y", "a/c/z")], "path string")
    assert paths(profile.inside(rows, ["keep", "a/b"])) == ["a/b/y", "a/x", "keep/deep/nested.bin", "keep/in.bin", "root.bin"]
    assert paths(profile.inside(rows, ["*.bin"])) == paths(rows)
    inside, outside = profile.partition(rows, ["keep"])
    assert sorted(paths(inside) + paths(outside)) == paths(rows)
    many = ["keep", "a/b", *[f"none{k}" for k in range(profile.PREFIXES)]]
    assert paths(profile.inside(rows, many)) == paths(profile.inside(rows, ["keep", "a/b"]))
    assert profile.reachable_shards(["keep", "a/b"]) == ["_root", "a", "keep"]
    assert profile.reachable_shards(["a*"]) is None


def test_metrics(spark):
    timeline = spark.createDataFrame([("h", 0.0, 0, 1), ("h", 2.5, 1, 2), ("h", 5.0, 2, 0)], "stage string, ts double, seq long, workers int")
    areas = metrics.parallelism(timeline)
    workers = spark.createDataFrame([("h", 2)], "stage string, max_workers int")
    row = metrics.utilisation(areas, workers).first()
    assert (row["average"], row["utilisation"]) == (1.5, 0.75)
    tasks = spark.createDataFrame([("h", 1.0), ("h", 2.0), ("h", 3.0), ("i", None)], "stage string, duration double")
    assert {r["stage"]: tuple(r)[1:] for r in metrics.durations(tasks).collect()} == {"h": (3, 2.0, 1.0, 3.0), "i": (0, 0.0, 0.0, 0.0)}
    tracker = metrics.Tracker()
    tracker.start_stage("s")
    with tracker.track("s"), tracker.track("s"):
        pass
    tracker.end_stage("s")
    events, tasks, stages = tracker.frames(spark)
    assert metrics.peak_workers(metrics.active_workers(events)).first()["peak"] == 2
    assert metrics.stage_spans(stages).first()["seconds"] >= 0


def test_changes(spark):
    block = spark.createDataFrame([(1, "/a"), (2, "/b")], "ord int, line string")
    lines = spark.createDataFrame([(1, "/b"), (2, "/c"), (3, "/c")], "ord int, line string")
    assert [r["line"] for r in dml.add_lines(block, lines).orderBy("ord").collect()] == ["/a", "/b", "/c"]
    held = spark.createDataFrame([("/d/x",), ("/dx",), ("/e/y/z",)], "entry string")
    added = spark.createDataFrame([("/d/",), ("/e/y/",)], "entry string")
    assert sorted(r["entry"] for r in dml.upgrade_ignores(held, added).collect()) == ["/d/", "/dx", "/e/y/"]
    attributes = spark.createDataFrame([("*.bin filter=lfs diff=lfs",), ("# note",), ("*.txt text",), ("filter=lfs",), ("  data/** -text  filter=lfs",)], "value string")
    assert sorted(r["pattern"] for r in dml.lfs_patterns(attributes).collect()) == ["*.bin", "data/**"]
    hidden = diff.hidden(spark.createDataFrame([(p,) for p in ("d/new.bin", "d/old.bin", "d/x.swp", "d/x.pyc", "d/__pycache__/m", "d/.git/x", "d/x.lock", "e/n", "d/s/deep")], "path string"), spark.createDataFrame([("d",)], "directory string"), entries(spark, **{"d/old.bin": "h"}))
    assert [r["path"] for r in hidden.collect()] == ["d/__pycache__/m", "d/new.bin", "d/s/deep", "d/x.lock"]


def test_manifest_files(spark, tmp_path):
    from stowage.sources import manifest

    rows = entries(spark, **{"b/x": "h2", "a": "h1"})
    for name in ("m.yaml", "m.json"):
        where = str(tmp_path / name)
        manifest.write_manifest(rows, where, bucket="q")
        assert sorted(map(tuple, manifest.read_manifest(spark, where).collect())) == [("a", "h1"), ("b/x", "h2")]
    manifest.convert(spark, str(tmp_path / "m.json"), str(tmp_path / "n.yaml"))
    with pytest.raises(FileExistsError):
        manifest.convert(spark, str(tmp_path / "m.json"), str(tmp_path / "n.yaml"))
    assert manifest.parse("", True) == {"files": {}}
    with pytest.raises(ValueError, match="conflict"):
        manifest.parse("<<<<<<< ours\na: [\n", True)
    with pytest.raises(ValueError, match="mapping"):
        manifest.parse("- a\n", True)


def test_files(spark, tmp_path):
    from stowage.sources import files

    for name, data in (("a.txt", b"x"), (".hidden", b"y"), ("_u/empty", b""), (".git/config", b"no"), ("d/_z", b"w")):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.list_files(spark, str(tmp_path))
    assert paths(found) == [".hidden", "_u/empty", "a.txt", "d/_z"]
    held = files.with_content(found, str(tmp_path))
    assert {r["path"]: bytes(r["content"]) for r in held.collect()}["_u/empty"] == b""
    hashed = files.hash_files(found, str(tmp_path))
    assert {tuple(r) for r in hashed.collect()} == {tuple(r) for r in held.select("path", F.sha2("content", 256)).collect()}


def test_snapshots(spark, tmp_path):
    from stowage.plans.snapshots import Conflict, NoRevision, Snapshots

    held = Snapshots(spark, f"file://{tmp_path}")
    rows = entries(spark, **{"alpha/f": "1", "beta/f": "2", "gamma/f": "3", "top": "4"})
    assert held.read("r1") is None and held.head() is None
    held.write(rows, "r1")
    assert held.shards("r1") == ["_root", "alpha", "beta", "gamma"]
    assert paths(held.read("r1")) == paths(rows)
    one = held.read("r1", ["beta"])
    assert paths(one) == ["beta/f"]
    assert "PartitionFilters: [" in (plan := one._jdf.queryExecution().toString()) and "beta" in plan
    held.advance(None, "r1")
    written = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before = written()
    held.write_changed("r1", entries(spark, **{"alpha/g": "9"}), "r2", ["alpha", "gamma"])
    assert paths(held.read("r2")) == ["alpha/g", "beta/f", "top"]
    assert held.shards("r2") == ["_root", "alpha", "beta"]
    assert paths(held.read("r2", ["alpha"])) == ["alpha/g"]
    assert len(held.read("r2", ["alpha"]).inputFiles()) == 1
    # Only the changed shard was written, and none was rewritten.
    after = written()
    assert {p.parent.name for p in after.keys() - before.keys()} == {"shard=alpha"}
    assert {p: after[p] for p in before} == before
    held.advance("r1", "r2")
    assert held.head() == "r2"
    with pytest.raises(Conflict):
        held.advance("r1", "r2")
    with pytest.raises(NoRevision):
        held.advance("r2", "r9")
    with pytest.raises(NoRevision):
        held.write_changed("r9", rows, "r3", ["alpha"])
    with pytest.raises(FileExistsError):
        held.write(rows, "r2")


def test_a_writer_that_stops_blocks_nobody(spark, tmp_path, monkeypatch):
    from stowage.plans.snapshots import Conflict, Snapshots

    held = Snapshots(spark, f"file://{tmp_path}")
    rows = entries(spark, **{"a/f": "1", "b c%/f": "2"})
    held.write(rows, "r1")
    held.write(rows, "r2")
    assert held.shards("r1") == ["a", "b c%"] and paths(held.read("r1", ["b c%"])) == ["b c%/f"]
    held.advance(None, "r1")
    # One that stops before its move has a name leaves at most a file that nothing reads.
    (tmp_path / ".half").write_text("r2")
    assert held.head() == "r1"
    # Of two that have read the same revision, the second to move is told.
    monkeypatch.setattr(held, "_last", lambda: 0)
    with pytest.raises(Conflict):
        held.advance(None, "r2")
    monkeypatch.undo()
    held.advance("r1", "r2")
    assert held.head() == "r2"


def test_on_move(spark, tmp_path):
    from stowage.plans.snapshots import Snapshots

    held, seen = Snapshots(spark, f"file://{tmp_path / 'c'}"), []
    for name in ("r1", "r2", "r3"):
        held.write(entries(spark, a=name), name)
    follow = lambda: held.on_move(lambda before, after: seen.append((before, after)), str(tmp_path / "seen"))
    held.advance(None, "r1")
    follow()
    held.advance("r1", "r2")
    held.advance("r2", "r3")
    follow()
    follow()
    assert seen == [(None, "r1"), ("r1", "r3")]


def test_sql_functions(spark):
    from stowage.plans.snapshots import register_sql

    register_sql(spark)
    assert spark.sql("SELECT asset_key('p', 'h', 'a/b'), shard_for('a/b'), array_sort(key_stems('k.gz.chunk3'))").first()[:2] == ("p/assets/h/a/b", "a")


def _rows(spark, query, name):
    query.processAllAvailable()
    return sorted(map(tuple, spark.table(name).collect()))


def test_streams(spark, tmp_path):
    import datetime

    from stowage.streaming import claims

    at = lambda day, hour=0: datetime.datetime(2024, 1, day, hour)
    kind = "manifest_key string, chunk_index int, num_chunks int, landed_at timestamp"
    spark.createDataFrame([("k1", 0, 2, at(1)), ("k2", 0, 1, at(1)), ("k1", 1, 2, at(1)), ("k3", 1, 2, at(1))], kind).write.mode("append").parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "c"))
    q = claims.completed_files(stream).writeStream.format("memory").queryName("done_files").outputMode("append").start()
    assert _rows(spark, q, "done_files") == [("k1", 2), ("k2", 1)]
    # A chunk that comes again makes no second file; the state of files that rest goes, and k3 begins anew.
    spark.createDataFrame([("k1", 1, 2, at(1)), ("k4", 0, 1, at(9))], kind).write.mode("append").parquet(str(tmp_path / "c"))
    assert _rows(spark, q, "done_files") == [("k1", 2), ("k2", 1), ("k4", 1)]
    spark.createDataFrame([("k5", 0, 1, at(9, 1))], kind).write.mode("append").parquet(str(tmp_path / "c"))
    _rows(spark, q, "done_files")
    spark.createDataFrame([("k3", 0, 2, at(10))], kind).write.mode("append").parquet(str(tmp_path / "c"))
    assert ("k3", 2) not in _rows(spark, q, "done_files")
    q.stop()
    spark.createDataFrame([("b", at(1, 23)), ("b", at(1, 22)), ("c", at(1, 1))], "base string, claimed_at timestamp").write.mode("append").parquet(str(tmp_path / "l"))
    stream = spark.readStream.schema("base string, claimed_at timestamp").parquet(str(tmp_path / "l"))
    q = claims.latest_claims(stream).writeStream.format("memory").queryName("held_claims").outputMode("update").start()
    assert _rows(spark, q, "held_claims") == [("b", at(1, 23), True), ("c", at(1, 1), True)]
    # Claimed again after midnight: the same claim, prolonged. The other one has expired.
    for row in (("b", at(2, 2)), ("d", at(2, 3))):
        spark.createDataFrame([row], "base string, claimed_at timestamp").write.mode("append").parquet(str(tmp_path / "l"))
        _rows(spark, q, "held_claims")
    got = _rows(spark, q, "held_claims")
    q.stop()
    assert got == [("b", at(1, 23), True), ("b", at(2, 2), True), ("c", at(1, 1), False), ("c", at(1, 1), True), ("d", at(2, 3), True)]


def test_metrics_across_slices(spark):
    rng = random.Random(6)
    events = [(s, rng.randrange(10_000), k, rng.choice([1, -1])) for k, s in enumerate(rng.choices("xy", k=3000))] + [("z", 5, 9000, 1), ("z", 5, 9001, 1)]
    got = metrics.active_workers(spark.createDataFrame(events, "stage string, ts long, seq long, delta int"))
    want, area = {}, {}
    for s in "xyz":
        n, before = 0, None
        for _, ts, seq, delta in sorted(e for e in events if e[0] == s):
            if before is not None:
                area[s] = area.get(s, 0) + n * (ts - before)
            n, before = n + delta, ts
            want[s, ts, seq] = n
    assert {tuple(r)[:3]: r["workers"] for r in got.collect()} == want
    assert {r["stage"]: r["area"] for r in metrics.parallelism(got).collect()} == {"z": 0} | area


def test_named_files(spark, tmp_path):
    import glob

    from stowage.sources import files

    names = ["a.txt", "d/b.txt", "d/e/c.txt", "d/.h/x.txt", ".top.txt", "d/e/.dot", "r[1]/f", "g.d/x", "deep/a/b/c/d.txt", "d/e.bin"]
    for n in names:
        os.makedirs((tmp_path / n).parent, exist_ok=True)
        (tmp_path / n).write_text(n)

    def want(spec):
        place = tmp_path / spec
        if place.is_file():
            return [spec]
        found = [place] if place.is_dir() else [tmp_path / x for x in glob.glob(spec, root_dir=tmp_path, recursive=True)]
        return sorted({str(f.relative_to(tmp_path)) for x in found for f in ([x] if x.is_file() else x.rglob("*")) if f.is_file()})

    for spec in ("a.txt", "d", "d/", "*.txt", "**/*.txt", "d/*", "d/**", "d/**/*.txt", "r[1]", "r[1]/f", "g.?", "**", ".t*", "d/e*", "deep/**/d.txt", "none/*", "?"):
        assert paths(files.resolve(spark, str(tmp_path), spec)) == want(spec), spec
    assert sorted(r["key"] for r in files.inventory(spark, str(tmp_path), "d/e").collect()) == ["d/e.bin", "d/e/.dot", "d/e/c.txt"]
    assert files.inventory(spark, str(tmp_path), "q/e").collect() == []


def test_transfers(spark, tmp_path):
    from stowage.operators import transfer
    from stowage.sources import files

    rng = random.Random(8)
    data = {"a/noise.bin": rng.randbytes(5000), "a/text.txt": b"word " * 4000, "b/empty": b"", "b/one": b"x" * 1999, "b/two": rng.randbytes(2001)}
    for n, d in data.items():
        os.makedirs((tmp_path / "w" / n).parent, exist_ok=True)
        (tmp_path / "w" / n).write_bytes(d)
    root, to, back = str(tmp_path / "w"), str(tmp_path / "s"), str(tmp_path / "b")
    listed = files.list_files(spark, root)
    kept = listed.select("path").union(spark.createDataFrame([("gone",)], "path string"))
    first = {r["path"]: r for r in transfer.upload(kept, root, f"file://{to}", "p", 2000).collect()}
    assert {p: (r["landed"], r["objects"], r["sent"]) for p, r in first.items()} == {"a/noise.bin": (True, 3, 3), "a/text.txt": (True, 1, 1), "b/empty": (True, 1, 1), "b/one": (True, 1, 1), "b/two": (True, 2, 2), "gone": (False, 0, 0)}
    assert {r["sent"] for r in transfer.upload(listed, root, f"file://{to}", "p", 2000).collect()} == {0}
    manifest = entries(spark, **{p: r["hash"] for p, r in first.items() if r["landed"]})
    located = lambda: store.locate(manifest, files.inventory(spark, to), "p").join(manifest, "path")
    assert all(r["ok"] for r in transfer.download(located(), f"file://{to}", back, "p").collect())
    assert {p: open(f"{back}/{p}", "rb").read() for p in data} == data
    # A damaged object, a lost chunk and a lost object are told, and leave what is there as it is.
    stem = lambda p: f"{to}/p/assets/{first[p]['hash']}/{p}"
    open(stem("b/one") + ".gz", "wb").write(gzip.compress(b"y" * 1999))
    os.unlink(stem("a/noise.bin") + ".chunk1")
    os.unlink(stem("b/empty"))
    got = {r["path"]: (r["ok"], r["error"]) for r in transfer.download(located(), f"file://{to}", back, "p").collect()}
    assert {p for p, (ok, _) in got.items() if ok} == {"a/text.txt", "b/two"}
    assert "broken" in got["a/noise.bin"][1] and "missing" in got["b/empty"][1] and "digest" in got["b/one"][1]
    assert {p: open(f"{back}/{p}", "rb").read() for p in data} == data
    assert not [p for p in (tmp_path / "b").rglob("*.tmp")]


def test_cache_and_claims(spark, tmp_path):
    from stowage.sources import cache

    where = tmp_path / "cache.yaml"
    held = cache.HashCache(spark, str(where))
    assert held.load().collect() == [] and not held.save() and not where.exists()
    rows = spark.createDataFrame([("é/\U0001f600 \\ud83d", "h", 1, 2.5, 3, 4.0), ("b", "g", 1, 1.0, None, None)], "path string, hash string, size long, mtime double, inode long, timestamp double")
    held.set(rows)
    assert held.save() and not held.save()
    again = cache.HashCache(spark, str(where))
    assert sorted(map(tuple, again.load().collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    read = again.load()
    assert again.load() is read and again.load(force=True) is not read
    cache.convert_cache(spark, str(where), str(tmp_path / "cache.json"))
    assert sorted(map(tuple, cache.HashCache(spark, str(tmp_path / "cache.json")).load().collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(FileExistsError):
        cache.convert_cache(spark, str(where), str(tmp_path / "cache.json"))
    where.write_text("{not: [yaml")
    assert again.load(force=True).collect() == []
    claims = spark.createDataFrame([("b", 1.0), ("b", 2.0), ("c", 1.0)], "base string, claimed_at double")
    cache.write_claims(claims, str(tmp_path / "claims.yaml"))
    assert sorted(map(tuple, cache.read_claims(spark, str(tmp_path / "claims.yaml")).collect())) == [("b", 2.0), ("c", 1.0)]
    for text in ("", "- a", "claims: [1]", "{{{"):
        (tmp_path / "claims.yaml").write_text(text)
        assert cache.read_claims(spark, str(tmp_path / "claims.yaml")).collect() == []
    assert cache.read_claims(spark, str(tmp_path / "none.yaml")).collect() == []


def test_manifest_paths_and_index(spark, tmp_path):
    import subprocess

    from stowage.sources import index, manifest

    assert manifest.manifest_path(str(tmp_path)).endswith(".manifest.yaml")
    (tmp_path / ".manifest.json").write_text("{}")
    assert manifest.manifest_path(str(tmp_path)).endswith(".manifest.json")
    (tmp_path / ".manifest.yaml").write_text("")
    assert manifest.manifest_path(str(tmp_path)).endswith(".manifest.yaml")
    assert index.read_index(spark, str(tmp_path)).collect() == []
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / "a b\rc").write_text("x")
    subprocess.run(["git", "-C", str(tmp_path), "add", "a b\rc", ".manifest.json"], check=True)
    assert paths(index.read_index(spark, str(tmp_path))) == [".manifest.json", "a b\rc"]


def test_large_caches_are_read_in_tasks(spark, tmp_path, monkeypatch):
    """No entry passes through the driver's parser, in whatever layout; ranges, pieces and batches cut anywhere."""
    import json

    import yaml

    from stowage.sources import cache

    monkeypatch.setattr(cache, "_RANGE", 300)
    monkeypatch.setattr(cache, "_PIECE", 7)
    monkeypatch.setattr(cache, "_BATCH", 5)
    monkeypatch.setattr(cache, "_document", None)
    want = [(f"d/{k}-é\U0001f600\\U0001f600\n{'x' * (k * 11)}", f"h{k}", k, k / 3, None if k % 5 == 0 else k + 10**12, 1e17 + k) for k in range(60)]
    rows = spark.createDataFrame(want, "path string, hash string, size long, mtime double, inode long, timestamp double")
    plain = {p: {"hash": h, "metadata": {"size": s, "mtime": m, "inode": i}, "timestamp": t} for p, h, s, m, i, t in want}
    for ending in ("yaml", "json"):
        held = cache.HashCache(spark, str(tmp_path / f"own.{ending}"))
        held.set(rows)
        held.save()
    (tmp_path / "block.yaml").write_text(yaml.safe_dump(plain, default_flow_style=False))
    (tmp_path / "flow.yaml").write_text(yaml.safe_dump(plain, default_flow_style=True, allow_unicode=True))
    (tmp_path / "wide.json").write_text(json.dumps(plain, indent=2))
    (tmp_path / "narrow.json").write_text(json.dumps(plain, ensure_ascii=False))
    read = lambda name: sorted(map(tuple, cache.HashCache(spark, str(tmp_path / name)).load().collect()))
    for name in ("own.yaml", "own.json", "block.yaml", "flow.yaml", "wide.json", "narrow.json"):
        assert read(name) == sorted(want), name
    whole = {n: (tmp_path / n).read_text() for n in ("own.yaml", "own.json", "wide.json")}
    for name, text in whole.items():
        (tmp_path / name).write_text(text[: len(text) // 2])
        assert read(name) == []
    (tmp_path / "own.yaml").write_text(whole["own.yaml"] + '"other": 5\n"d/z": {"hash": "a"}\n"d/z": {"hash": "b"}\n')
    assert [r for r in read("own.yaml") if r[0] == "d/z"] == [("d/z", "b", None, None, None, None)] and len(read("own.yaml")) == 61
    # What was read stays as it was when the file is another.
    held = cache.HashCache(spark, str(tmp_path / "own.yaml"))
    before = held.load()
    held.set(before.where("size < 3"))
    held.save()
    assert before.count() == 61 and sorted(r["size"] for r in held.load().collect()) == [0, 1, 2]
