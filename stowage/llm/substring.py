"""Removal of repeated passages by prefix-partitioned suffix trees.

A window is 20 consecutive words. Words are removed that lie in a window whose words also start
earlier: in a document with a smaller doc_id, or earlier in the same one.

1. A suffix can have a window in common with another only if they share what the window holds. Of the
   six-word runs in a window, the one with the least hash is its anchor; equal windows have equal
   anchors, at the same place. A scan gives the anchors, about one for eight words; suffixes whose anchor
   is met once in the corpus are done with. Whole texts that are equal are found by their 128-bit hash
   beforehand: all but the earliest go, and have no suffixes.
2. Consecutive suffixes mostly share their anchor: they are one segment, known by its anchor and a 128-bit
   hash of its words. Suffixes of equal segments are equal: they end in the same leaves, of which only
   the earliest can stay, so only the earliest of each content goes on, and that where its anchor has
   other contents.
3. Those suffixes, each with its text up to the end of its segment, are split by prefixes of variable
   length: a prefix of PREFIXES[0] words that more than GROUP suffixes share is lengthened to
   PREFIXES[1] words, and so on, up to the window. A prefix of a whole window can't be split further, nor
   need it: all its suffixes hang below one node, whose earliest is a plain minimum.
4. A task builds the subtree of each prefix from its sorted suffixes and the depths to which neighbours
   agree (subtree()). Below each of the shallowest internal nodes at the depth of a window or deeper, the
   earliest suffix stays and the windows at the others are marked.
5. Marked windows go back to their texts.

maximal_repeats() reports the deep internal nodes themselves, from the same groups and subtrees, with
suffixes of DEPTH words.

Defined results: null and empty texts have no words; a text of any length is cut into segments in one
task, in memory of a few times its size; rows that repeat both doc_id and text are one document and get
equal results; rows with equal doc_id and other texts are ordered by a hash of the text; a null doc_id
comes last; an empty table gives an empty result; other columns, whatever their names, are ignored, or
passed through by without_repeats(). A document is known by its doc_id and a 64-bit hash of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import BLANKS, Written

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 20, 6
#: Words of the prefixes by which suffixes are split, and the most suffixes of a subtree.
PREFIXES, GROUP = (8, 12, 16, 20), 20_000
#: Words of a suffix in maximal_repeats().
DEPTH = 256
#: Bytes of texts whose words are hashed at a time.
HASHED = 1 << 20
#: Odd multipliers of the two rolling hashes, and of the final mixing: the fixed values of SplitMix64 and XXH64.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Stands for a null doc_id.
LAST = (1 << 63) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, MIXERS[0]), (27, MIXERS[1])):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _runs_hash(h: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """Hash of each run of `size` values."""
    n = len(h) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(multiplier) + h[k : k + n]
    return _mixed(out)


def anchors_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all anchor-sized runs, and for each window the place of its anchor: the first with the least hash."""
    runs = _runs_hash(h, ANCHOR, MULTIPLIERS[0])
    span = WINDOW - ANCHOR + 1
    n = len(h) - WINDOW + 1
    # Least over a span by doubling; places follow their values.
    least, place, have = runs, np.arange(len(runs)), 1
    while have < span:
        step = min(have, span - have)
        left, right = least[: len(least) - step], least[step:]
        later = right < left
        place = np.where(later, place[step:], place[: len(place) - step])
        least = np.where(later, right, left)
        have += step
    return runs, place[:n]


def _batch(schema: str, columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))


class _Powers:
    """Powers of an odd multiplier and of its inverse, as far as they have been asked for."""

    def __init__(self, multiplier: int):
        self.steps = (multiplier, pow(multiplier, -1, 1 << 64))
        self.held = [np.ones(1, dtype=np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.held[0]) < n:
            self.held = [np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, step, dtype=np.uint64))), dtype=np.uint64) for step in self.steps]
        return [x[:n] for x in self.held]


_POWERS = [_Powers(m) for m in MULTIPLIERS]


def _spans_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash of each of the spans of values, from sums of their products with powers of a multiplier."""
    up, down = powers.upto(len(values) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(MIXERS[1]))


class Anchored:
    """The words of some texts as one sequence: `begin` of each text, `of` each word its text, `hashes`, hashes of all anchor-sized `runs`, and each window's `first` word and anchor `place`."""

    def __init__(self, texts: pa.BinaryArray):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        blank, edge = _BLANK[data], np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        start = np.flatnonzero(~blank & (np.concatenate(([True], blank[:-1]))[: len(blank)] | edge[:-1]))
        end = np.flatnonzero(~blank & (np.concatenate((blank[1:], [True]))[: len(blank)] | edge[1:])) + 1
        self.of = np.searchsorted(offsets, start, side="right") - 1
        self.begin = np.searchsorted(start, offsets[:-1])
        self.hashes = _spans_hash(data.astype(np.uint64) + np.uint64(1), start, end, _POWERS[0])
        if len(start) < WINDOW:
            self.runs, self.first, self.place = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
            return
        runs, place = anchors_of(self.hashes)
        self.runs = runs.view(np.int64)
        # Windows that reach into the next text are none.
        self.first = np.flatnonzero(self.of[: len(place)] == self.of[WINDOW - 1 :])
        self.place = place[self.first]


def _some(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some at a time: as many as have HASHED bytes in a column, or one."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HASHED, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """key, ref, pos: the anchors of each text."""
    schema = "key long, ref long, pos int"

    def run(batches):
        for whole in batches:
            for batch in _some(whole, 1):
                refs, a = batch.column(0).to_numpy(zero_copy_only=False), Anchored(batch.column(1))
                place = a.place[np.flatnonzero(np.concatenate(([True], a.place[1:] != a.place[:-1])))] if len(a.place) else a.place
                if len(place):
                    text = a.of[place]
                    yield _batch(schema, (a.runs[place], refs[text], (place - a.begin[text]).astype(np.int32)))

    return docs.select("_ref", F.col("text").cast("binary")).mapInArrow(run, schema)


def _segments(found: DataFrame) -> DataFrame:
    """key, c1, c2 (a hash of the words), ord, ref, start and n (windows) of the segments of texts (_order, _ref, text, pos)."""
    schema = "key long, c1 long, c2 long, ord long, ref long, start int, n int"

    def run(batches):
        for whole in batches:
            for batch in _some(whole, 2):
                orders, refs = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
                a = Anchored(batch.column(2))
                if not len(a.first):
                    continue
                wanted = np.zeros(len(a.of), dtype=bool)
                sizes = batch.column(3).value_lengths().to_numpy()
                at = np.repeat(a.begin, sizes) + batch.column(3).flatten().to_numpy()
                wanted[at[at < len(wanted)]] = True
                # Consecutive windows with the same anchor are one segment.
                begin = np.flatnonzero(np.concatenate(([True], (a.place[1:] != a.place[:-1]) | (a.first[1:] != a.first[:-1] + 1))))
                n = np.diff(np.append(begin, len(a.first)))
                meet = wanted[a.place[begin]]
                begin, n = begin[meet], n[meet]
                if not len(begin):
                    continue
                first = a.first[begin]
                text = a.of[first]
                c1, c2 = (_spans_hash(h, first, first + n - 1 + WINDOW, p).view(np.int64) for h, p in zip((a.hashes, _mixed(a.hashes)), _POWERS, strict=True))
                yield _batch(schema, (a.runs[a.place[begin]], c1, c2, orders[text], refs[text], (first - a.begin[text]).astype(np.int32), n.astype(np.int32)))

    return found.select("_order", "_ref", F.col("text").cast("binary"), "pos").mapInArrow(run, schema)


def _suffix_rows(found: DataFrame, depth: int | None = None) -> DataFrame:
    """ord, ref, start, left and suffix, a row for each of the n first words of each of the `spans` (start, n) of texts (_order, _ref, text).

    A suffix goes to the end of its span's last window, each word closed by a blank; with `depth`, it has so many
    words at most, and `left` is the word before it.
    """
    schema = "ord long, ref long, start int, left string, suffix string"

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for order, ref, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split()
                for span in spans:
                    at, n = span["start"], min(span["n"], len(words) - WINDOW + 1 - span["start"])
                    past = len(words) if depth else at + n - 1 + WINDOW
                    if not depth:
                        closed = b" ".join(words[at:past]) + b" "
                        cut = 0
                    for k in range(at, at + n):
                        if depth:
                            suffix = b" ".join(words[k : k + depth]) + b" "
                        else:
                            suffix = closed[cut:]
                            cut += len(words[k]) + 1
                        out.append((order, ref, k, words[k - 1].decode() if depth and k else None, suffix.decode()))
                        held += len(suffix) + 100
                        if held > 4_000_000:
                            yield _batch(schema, zip(*out, strict=True))
                            out, held = [], 0
            if out:
                yield _batch(schema, zip(*out, strict=True))

    return found.select("_order", "_ref", F.coalesce(F.col("text").cast("binary"), F.lit(b"")), "spans").mapInArrow(run, schema)


def split_by_prefix(suffixes: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame | None]:
    """Suffixes with the `prefix` that makes their subtree, `group` of them at most; and those whose whole window is shared by more, if any are.

    Prefixes are known by a hash, as a subtree that holds two of them is none the worse; the whole window is known by its words.
    """
    ready, rest = None, suffixes
    for words in PREFIXES:
        head = F.substring_index("suffix", " ", words)
        marked = rest.withColumn("prefix", F.concat(head, F.lit(" ")) if words == WINDOW else F.hex(F.xxhash64(head)))
        many = Written(marked.groupBy("prefix").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group).select("prefix"), "prefixes").df
        none = many.isEmpty()
        fits = marked if none else marked.join(many, "prefix", "left_anti")
        ready = fits.select(*suffixes.columns, "prefix") if ready is None else ready.unionByName(fits.select(*suffixes.columns, "prefix"))
        if none:
            return ready, None
        rest = marked.join(many, "prefix", "left_semi").select(*suffixes.columns)
    return ready, rest


def depth_of(one: str, two: str) -> int:
    """Words that two suffixes have in common from their beginning; each word is closed by a blank."""
    if two.startswith(one):
        same = len(one)
    else:
        low, high = 0, min(len(one), len(two))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if one[:mid] == two[:mid] else (low, mid - 1)
        same = one.rfind(" ", 0, low) + 1
    return one.count(" ", 0, same)


def subtree(leaves: Iterable[tuple[str, object]], merge: Callable, least: int = WINDOW) -> Iterator[tuple[int, object, bool]]:
    """The internal nodes, of a depth of `least` words or more, of the suffix tree of `leaves` (suffix, value) in order of suffix.

    Gives the depth in words, the values of all leaves below merged by `merge(of the node, of a part)`, and
    whether no other such node is above. Holds no more than the nodes on the way to one leaf.
    """
    path: list[list] = []  # depth and value of each open node
    before, value = None, None
    for suffix, new in chain(leaves, [("", None)]):
        if before is not None:
            depth = depth_of(before, suffix)
            while path and path[-1][0] > depth:
                deep, whole = path.pop()
                value = merge(whole, value) if whole is not None else value
                yield deep, value, depth < least and not path
            if depth >= least:
                if not path or path[-1][0] < depth:
                    path.append([depth, None])
                path[-1][1] = value if path[-1][1] is None else merge(path[-1][1], value)
        before, value = suffix, new


def _subtrees(suffixes: DataFrame, leaf: Callable, merge: Callable, emit: Callable, schema: str) -> DataFrame:
    """What `emit` makes of the nodes of each prefix's subtree; `leaf` gives the value of a row (ord, ref, start, left)."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list[tuple] = []
        for _, group in groupby(rows(), key=lambda r: r[0]):
            for node in subtree(((r[-1], leaf(r[1:-1])) for r in group), merge):
                out += emit(*node)
            if len(out) > 20_000:
                yield _batch(schema, zip(*out, strict=True))
                out = []
        if out:
            yield _batch(schema, zip(*out, strict=True))

    rows = suffixes.select("prefix", "ord", "ref", "start", "left", "suffix")
    return rows.repartition("prefix").sortWithinPartitions("prefix", "suffix").mapInArrow(run, schema)


def _all_of(node: list, part: list) -> list:
    node += part
    return node


def later_suffixes(depth: int, leaves: list[tuple], outermost: bool) -> list[tuple]:
    """(ord, ref, start, 1) of all suffixes below an outermost node but the earliest."""
    return [(*x, 1) for x in sorted(set(leaves))[1:]] if outermost else []


def _marks(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """ord, ref, start, n: runs of n windows that also start earlier, from all segments of the texts in `rows`."""
    contents = segments.groupBy("c1", "c2").agg(F.min(F.struct("ord", "ref", "start")).alias("first"), F.count(F.lit(1)).alias("n_equal"), F.first("key").alias("key"), F.first("n").alias("n"))
    # Written, like the next one, so that a content, or an anchor, with very many rows can be split in the join.
    contents = Written(contents, "segment-contents").df
    later = segments.select("c1", "c2", "ord", "ref", "start", "n").join(contents.where("n_equal > 1").select("c1", "c2", "first"), ["c1", "c2"])
    later = later.where(F.struct("ord", "ref", "start") > F.col("first")).select("ord", "ref", "start", "n")
    several = Written(contents.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"), "anchors-several").df
    different = contents.join(several, "key").select("first.ord", "first.ref", F.struct("first.start", "n").alias("span"))
    spans = different.groupBy("ref", "ord").agg(F.collect_list("span").alias("spans"))
    found = rows.join(spans, (rows["_ref"] == spans["ref"]) & (rows["_order"] == spans["ord"])).select("_order", "_ref", "text", "spans")
    # Rows that repeat a document give its suffixes once more, which later_suffixes() tells.
    suffixes = Written(_suffix_rows(found), "suffixes")
    trees, whole = split_by_prefix(suffixes.df)
    marks = Written(_subtrees(trees, lambda r: [r[:3]], _all_of, later_suffixes, "ord long, ref long, start int, n int"), "subtree-marks").df.union(later)
    if whole is None:
        return marks
    # A whole window that very many suffixes share is one node, whose earliest suffix stays.
    whole = whole.withColumn("window", F.substring_index("suffix", " ", WINDOW))
    earliest = Written(whole.groupBy("window").agg(F.min(F.struct("ord", "ref", "start")).alias("first")), "window-first").df
    many = whole.select("window", "ord", "ref", "start").join(earliest, "window").where(F.struct("ord", "ref", "start") > F.col("first"))
    return marks.union(many.select("ord", "ref", "start", F.lit(1).alias("n")))


def maximal_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The maximal repeats of a window's length or more: n_words, n (how often), and doc_id, ref and start of the earliest.

    These are the internal nodes of the suffix tree whose suffixes have different words before them (the
    beginning of a text is different from any word). Repeats longer than `depth` come cut to it, one for
    each place at which `depth` words have different words before them. Rows that repeat both doc_id and
    text are one document.
    """
    rows = _referred(docs.select("doc_id", "text")).dropDuplicates(["_ref", "_order"])
    every = rows.withColumn("spans", F.array(F.struct(F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("n"))))
    trees, whole = split_by_prefix(Written(_suffix_rows(every, depth), "deep-suffixes").df)
    if whole is not None:
        # Sorted by Spark like any other prefix; a subtree takes no more memory than its deepest path.
        trees = trees.unionByName(whole.withColumn("prefix", F.substring_index("suffix", " ", WINDOW)))
    leaf = lambda r: (1, r[:3], r[3], r[3] is None)
    merge = lambda a, b: (a[0] + b[0], min(a[1], b[1]), a[2], a[3] or b[3] or a[2] != b[2])
    emit = lambda words, node, _: [(words, node[0], *node[1])] if node[3] else []
    got = _subtrees(trees, leaf, merge, emit, "n_words int, n long, ord long, ref long, start int")
    return got.select("n_words", "n", F.when(F.col("ord") != LAST, F.col("ord")).alias("doc_id"), "ref", "start")


def _referred(docs: DataFrame) -> DataFrame:
    """`docs` with _ref, a hash of doc_id and text, and _order."""
    return docs.withColumns({"_ref": F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), "_order": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))})


def marked_windows(docs: DataFrame) -> DataFrame:
    """ord, ref, runs (an array of start, n) of marked windows, and copy (the whole text also stands earlier), for the documents that have any."""
    rows = _referred(docs.select("doc_id", "text"))
    twice = (F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("copy"), "text").alias("t2"))
    narrow = Written(rows.select("_ref", "_order", *twice), "substring-texts").df
    first = narrow.groupBy("t1", "t2").agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    first = Written(first, "substring-equal").df
    copies = Written(narrow.join(first, ["t1", "t2"]).where("_order > _first").select(F.col("_ref").alias("ref"), F.col("_order").alias("ord")).distinct(), "substring-copies").df

    anchors = Written(_anchor_rows(rows), "anchors")
    # Written, so that the join deals the anchors anew and a skewed key can be split there.
    met = Written(anchors.df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "substring-met").df
    places = anchors.df.join(met, "key").groupBy("ref").agg(F.collect_list("pos").alias("pos"))
    without = copies.groupBy("ref").agg(F.collect_set("ord").alias("ords"))
    places = Written(places.join(without, "ref", "left"), "substring-places").df
    anchors.drop()

    # Places of texts whose hashes are equal are wanted in both, which does no harm.
    found = rows.join(places, rows["_ref"] == places["ref"]).where(~F.coalesce(F.array_contains("ords", F.col("_order")), F.lit(False)))
    segments = Written(_segments(found.select("_order", "_ref", "text", "pos")), "segments")
    marks = Written(_marks(segments.df, rows), "substring-marks").df
    segments.drop()
    runs = marks.groupBy("ref", "ord").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return runs.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("runs", F.lit(None)).withColumn("copy", F.lit(True)))


def _removal(words: list[bytes], runs, copy: bool | None) -> np.ndarray:
    """Which words go."""
    if copy:
        return np.full(len(words), len(words) >= WINDOW)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for run in runs or ():
        edge[run["start"]] += 1
        edge[run["start"] + run["n"] - 1 + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def _with_marks(docs: DataFrame) -> DataFrame:
    marks = marked_windows(docs)
    return _referred(docs).join(marks.select(F.col("ref").alias("_ref"), F.col("ord").alias("_order"), F.col("runs").alias("_runs"), F.col("copy").alias("_copy")), ["_ref", "_order"], "left")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, a row for each of `docs`."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, runs, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or b"").split()
                gone = _removal(words, runs, copy)
                kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x] if gone.any() else words
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield _batch(schema, zip(*out, strict=True))

    joined = _with_marks(docs.select(F.col("doc_id").cast("long"), "text"))
    return joined.select("doc_id", F.col("text").cast("binary"), "_runs", "_copy").mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` without the repeated words. A text that loses none stays as it is; another becomes its kept words joined by blanks, with n_chars to match."""
    columns, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out = []
            for text, runs, copy in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split() if text and (runs or copy) else []
                gone = _removal(words, runs, copy)
                out.append(" ".join(w.decode() for w, x in zip(words, gone.tolist(), strict=True) if not x) if gone.any() else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[3:]], ["text", *batch.schema.names[3:]])

    rest = [c for c in columns if c != "text"]
    joined = _with_marks(docs).select(F.col("text").cast("string"), "_runs", "_copy", *rest)
    kept = joined.mapInArrow(run, "text string" + "".join(f", `{c}` {schema[c].dataType.simpleString()}" for c in rest))
    if "n_chars" in rest:
        kept = kept.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return kept.select(*columns)
