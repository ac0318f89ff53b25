"""Near-duplicate documents by SimHash, compared bit-sliced.

Distinct fingerprints meet in buckets: the 64 bits are cut into six blocks, and two fingerprints at
most four bits apart agree in at least two of them, so each of the 15 pairs of blocks is a key and no
link is lost. With more fingerprints than such keys tell apart, there are seven or eight blocks, and a key
for each three or four of them. Within a bucket, fingerprints are stored vertically in planes: word b of a plane set has
bit b of 64 fingerprints. One fingerprint is compared with all 64 at once: each plane is flipped to
its differing bits, which carry-save adders sum into bitwise counters, and a plane set whose 64
counters have all passed the radius is abandoned. A bucket gives a spanning forest of its links, never
all pairs; components come from alternating large and small stars over those links.

A bucket above TILE rows is dealt over tasks in tiles, each pair of tiles to one of them, which covers
all pairs exactly. Copies of a text cost one fingerprint.

near_duplicates() is that, with 64 bits. Four bits of 64 stand for a similarity far above 0.8, though:
texts that share 80 % of their shingles differ in ten. keep_one(), which drops near copies from a
corpus, therefore takes the sets of shingles of five words, and links texts whose sets have a Jaccard
similarity of SIMILAR or more, counted exactly. Its buckets are bands of least hashes: texts meet if the
ROWS least hashes of one of BANDS bands agree, which pairs at 0.8 do with the probability met(0.8) and
unlike texts hardly ever, however many texts there are. Within a bucket, fingerprints of 256 bits are
compared bit-sliced: at 0.8 they differ in 39 bits with a deviation of 6, in WIDE_RADIUS or fewer all
but surely; what is within the radius is a candidate. A forest of candidates won't do, as a candidate
that falls short may be all that joins two that don't; but nodes that are known to be connected need no
further link. So forests at the CLOSE radii are verified first, by joins with the sets; then, in buckets
whose nodes these leave apart, the sets come along, and candidates that are not yet connected are verified
where they are compared. A bucket gives links, never its pairs.

Defined results: null and empty texts have fingerprint zero, which links like any other, and in
keep_one() the empty set of shingles, which is similar to itself only; a text of any length is hashed
whole by one task, some of its shingles at a time; repeated rows get equal results; rows that share a
doc_id are documents of their own where their texts differ; a component of rows without doc_id has no
component_id; an empty table gives an empty result; other columns, whatever their names, are ignored,
or passed through by keep_one().
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import Written

#: Words of a shingle, the largest number of differing bits that links, and the seed of XXH64.
SHINGLE, RADIUS, SEED = 4, 4, 42
#: Numbers of blocks that 64 bits are cut into, all but RADIUS of which agree where RADIUS bits differ: 15 keys of 21 bits, 35 of 27, 70 of 32.
BLOCKS = (6, 7, 8)
#: Fingerprints for each value of a key above which there are to be more blocks, and so longer keys.
CROWDED = 64
#: Fingerprints of a bucket that one task compares at once.
TILE = 16_384
#: keep_one(): the least similarity, as a fraction, that links.
SIMILAR = (4, 5)
#: keep_one(): words of a shingle, 64-bit words of a fingerprint, and the radius of candidates.
WIDE_SHINGLE, WIDE_WORDS, WIDE_RADIUS = 5, 4, 56
#: keep_one(): bands of least hashes, and least hashes of a band.
BANDS, ROWS = 14, 5
#: Radii of the forests that are verified first.
CLOSE = (12, 24, 36)
#: Hashes whose least are sought at a time.
SOUGHT = 20_000
#: Hash values whose bits are unpacked at a time, bytes of rows gathered before their buckets are compared, comparisons (of one with 64) held at a time.
UNPACKED, GATHERED, HELD = 200_000, 8_000_000, 400_000


def _remixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hash values from which word `word` of a fingerprint is summed; word 0 takes them as they are."""
    if word:
        h = (h ^ np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(29))
    return h


def _fingerprints(hashes: list[np.ndarray], shingles: int = UNPACKED, words: int = 1) -> np.ndarray:
    """The fingerprint, `words` 64-bit words, of each array of shingle hashes; zero for an empty one."""
    out = np.zeros((len(hashes), words), dtype=np.uint64)
    at = 0
    while at < len(hashes):
        stop, n = at, 0
        while stop < len(hashes) and (stop == at or n + len(hashes[stop]) <= shingles):
            n += len(hashes[stop])
            stop += 1
        full = [k for k in range(at, stop) if len(hashes[k])]
        if full:
            sizes = np.array([len(hashes[k]) for k in full])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            every = np.concatenate([hashes[k] for k in full])
            for word in range(words):
                one = _remixed(every, word).astype("<u8")
                ones = np.zeros((len(full), 64), dtype=np.int64)
                for part in range(0, len(one), shingles):  # more than one only for a very long text
                    bits = np.unpackbits(one[part : part + shingles].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones += np.add.reduceat(bits, starts, axis=0, dtype=np.int32) if len(one) <= shingles else bits.sum(axis=0, dtype=np.int64)
                majority = (2 * ones > sizes[:, None]).astype(np.uint8)
                out[full, word] = np.packbits(majority, axis=1, bitorder="little").view("<u8").reshape(-1)
        at = stop
    return out


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - size].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def _names(words: int) -> list[str]:
    return [f"f{k}" for k in range(words)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id and the words f0, f1, ... of the fingerprint (64 bits each, as signed numbers), a row for each of `docs`."""
    schema = "doc_id long" + "".join(f", {n} long" for n in _names(words))

    def run(batches):
        for batch in batches:
            hashes = [shingle_hashes(x, shingle) for x in batch.column(1).to_pylist()]
            found = _fingerprints(hashes, words=words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(words))], ["doc_id", *_names(words)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def widths(blocks: int) -> list[int]:
    """Widths of so many blocks of 64 bits, from bit 0."""
    return [64 // blocks + (k < 64 % blocks) for k in range(blocks)]


def blocks_for(n: int) -> int:
    """The least number of blocks whose keys are not crowded by n fingerprints, or the greatest there is."""
    return next((b for b in BLOCKS if n <= CROWDED << min(sum(c) for c in combinations(widths(b), b - RADIUS))), BLOCKS[-1])


def bucket_keys(fingerprint: Column, blocks: int = BLOCKS[0]) -> Column:
    """The keys of a fingerprint: which blocks, and their bits."""
    width = widths(blocks)
    at = np.concatenate(([0], np.cumsum(width)))
    block = [F.shiftrightunsigned(fingerprint, int(a)).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for a, w in zip(at, width, strict=False)]
    out = []
    for k, some in enumerate(combinations(range(blocks), blocks - RADIUS)):
        bits = block[some[0]]
        for j in some[1:]:
            bits = F.shiftleft(bits, width[j]).bitwiseOR(block[j])
        out.append(F.lit(k).cast("long") * (1 << 40) + bits)
    return F.array(*out)


def _planes(fps: np.ndarray, starts: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Plane b of each run of at most 64 fingerprints: bit l is bit b of the run's fingerprint l."""
    words = fps.shape[1]
    out = np.empty((64 * words, len(starts)), dtype=np.uint64)
    for b in range(64 * words):
        out[b] = np.add.reduceat(((fps[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << lane, starts)
    return out


def within_radius(fps: np.ndarray, row: np.ndarray, planes: np.ndarray, run: np.ndarray, valid: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Which of the comparisons of fingerprint row[k] with plane set run[k] have matches, and the lanes within the radius as bits.

    Counters are as many words as the radius has bits; what passes beyond them is kept as a flag.
    """
    live = np.arange(len(row))
    counter = [np.zeros(len(row), dtype=np.uint64) for _ in range(max(2, radius.bit_length()))]
    over = np.zeros(len(row), dtype=np.uint64)
    bits = len(planes)
    for b in range(0, bits, 2):
        x, y = (planes[k][run] ^ (np.uint64(0) - ((fps[row, k // 64] >> np.uint64(k % 64)) & np.uint64(1))) for k in (b, b + 1))
        half = counter[0] ^ x
        carry = (counter[0] & x) | (half & y)
        counter[0] = half ^ y
        for k in range(1, len(counter)):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 16 == 14:
            alive = ~(over | _above(counter, radius)) & valid[run]
            some = alive != 0
            if b == bits - 2 or np.count_nonzero(some) < 0.8 * len(some):
                live, row, run, over, alive, *counter = (v[some] for v in (live, row, run, over, alive, *counter))
    return live, alive


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius, compared from the highest bit down."""
    more, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counter[k]
        else:
            more |= same & counter[k]
            same = same & ~counter[k]
    return more


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[k] and b[k] for all k; a set's label is its least member."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nearer = labels[labels]
            if np.array_equal(nearer, labels):
                break
            labels[:] = nearer


def _shared(keys: np.ndarray) -> np.ndarray:
    """Whether a row's bucket has other rows; rows of a bucket stand together."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    return np.repeat(size > 1, size)


def _matches(keys: np.ndarray, fps: np.ndarray, radius: int):
    """Rows a and b of the same bucket within the radius, some at a time; each pair comes once or twice, and each row with itself."""
    n = len(keys)
    if not n:
        return
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, size)
    starts = np.flatnonzero(place % 64 == 0)
    length = np.diff(np.append(starts, n))
    planes = _planes(fps, starts, (place % 64).astype(np.uint64))
    valid = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - length).astype(np.uint64)
    own = np.repeat(np.arange(len(starts)), length)  # plane set of each row
    last = np.repeat(np.searchsorted(starts, first + size) - 1, size)  # last plane set of its bucket
    each = last - own + 1
    upto = np.cumsum(each)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + HELD, side="right")))
        count = each[row:stop]
        rows = np.repeat(np.arange(row, stop), count)
        sets = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + own[rows]
        for part in range(0, len(rows), HELD):  # more than one only where one row has so many
            r, s = rows[part : part + HELD], sets[part : part + HELD]
            live, alive = within_radius(fps, r, planes, s, valid, radius)
            r, s = r[live], s[live]
            while len(r):
                low = alive & (~alive + np.uint64(1))
                yield r, starts[s] + np.log2(low.astype(np.float64)).astype(np.int64)
                alive = alive ^ low
                more = alive != 0
                r, s, alive = r[more], s[more], alive[more]
        row = stop


def bucket_links(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between nodes within each bucket; rows of a bucket stand together."""
    keep = _shared(keys)
    keys, nodes, fps = keys[keep], nodes[keep], fps[keep]
    labels = np.arange(len(keys))
    for a, b in _matches(keys, fps, radius):
        _union(labels, a, b)
    linked = np.flatnonzero(labels != np.arange(len(keys)))
    return nodes[linked], nodes[labels[linked]]


def _similar(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sets of hashes, each in order, are as similar as SIMILAR says; the union has `total - both` of them."""
    total = len(one) + len(two)
    both = total - len(np.union1d(one, two))
    return both * (SIMILAR[0] + SIMILAR[1]) >= total * SIMILAR[0]


def bucket_similar(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], radius: int) -> tuple[list[int], list[int]]:
    """Links of sufficient similarity that connect nodes of different labels within each bucket: a pair within the radius is verified if no link so far connects its labels."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    sizes, label, node = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets)), labels.tolist(), nodes.tolist()
    links: tuple[list[int], list[int]] = ([], [])
    for a, b in _matches(keys, fps, radius):
        # Sets of sizes further apart can't be similar.
        alike = np.minimum(sizes[a], sizes[b]) * SIMILAR[1] >= np.maximum(sizes[a], sizes[b]) * SIMILAR[0]
        apart = (b > a) & (labels[a] != labels[b]) & alike
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            one, two = find(label[x]), find(label[y])
            if one != two and _similar(sets[x], sets[y]):
                root[max(one, two)] = min(one, two)
                links[0].append(node[x])
                links[1].append(node[y])
    return links


def met(similarity: float) -> float:
    """The probability that two sets of a similarity meet in a bucket."""
    return 1 - (1 - similarity**ROWS) ** BANDS


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A key for each band, as signed numbers, for each of some sets of hashes (none may be empty)."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    flip, factor = (rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    least = np.empty((len(sets), BANDS * ROWS), dtype=np.uint64)

    def hashed(h: np.ndarray) -> np.ndarray:
        x = (h[:, None] ^ flip) * factor
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    at = 0
    while at < len(sets):
        stop, n = at, 0
        while stop < len(sets) and (stop == at or n + len(sets[stop]) <= SOUGHT):
            n += len(sets[stop])
            stop += 1
        if n > SOUGHT:  # one long set
            least[at] = np.min([hashed(sets[at][k : k + SOUGHT]).min(axis=0) for k in range(0, n, SOUGHT)], axis=0)
        else:
            starts = np.cumsum([0, *map(len, sets[at : stop - 1])])
            least[at:stop] = np.minimum.reduceat(hashed(np.concatenate(sets[at:stop])), starts, axis=0)
        at = stop
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
    for row in range(ROWS):
        keys = _remixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, row::ROWS], 1)
    return keys.view(np.int64)


def _dealt(rows: DataFrame) -> DataFrame:
    """`rows` (key, ...) with `tiles`, dealt and sorted by both: a bucket above TILE rows is cut into tiles, and each pair of them is one task's."""
    names = [c for c in rows.columns if c != "key"]
    hot = Written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE), "simhash-hot").df
    if hot.isEmpty():
        rows = rows.withColumn("tiles", F.lit(0))
    else:
        tiles = hot.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("_t"))
        rows = rows.join(tiles, "key", "left").withColumn("_t", F.coalesce("_t", F.lit(1)))
        mine = F.pmod(F.xxhash64("node", F.lit("tile")), F.col("_t")).cast("int")
        other = F.explode(F.transform(F.sequence(F.lit(0), F.col("_t") - 1), lambda t: F.least(t, mine) * F.col("_t") + F.greatest(t, mine)))
        rows = rows.select("key", *names, other.alias("tiles"))
    return rows.select("key", "tiles", *names).repartition("key", "tiles").sortWithinPartitions("key", "tiles")


def _whole_buckets(batches, size: int):
    """Batches joined until they have so many bytes, and cut where a bucket ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            rows = pa.Table.from_batches(held).combine_chunks()
            key, tiles = (rows.column(k).to_numpy() for k in range(2))
            ends = np.flatnonzero((key != key[-1]) | (tiles != tiles[-1]))
            whole = int(ends[-1]) + 1 if len(ends) else 0
            if whole:
                yield rows.slice(0, whole)
            held = rows.slice(whole).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bucket_numbers(rows: pa.Table) -> np.ndarray:
    """A number for each row's bucket."""
    key, tiles = (rows.column(k).to_numpy() for k in range(2))
    return np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (tiles[1:] != tiles[:-1]))))


def _prints(rows: pa.Table, words: int) -> np.ndarray:
    return np.ascontiguousarray(np.stack([rows.column(f"f{k}").to_numpy() for k in range(words)], axis=1)).view(np.uint64)


def links(rows: DataFrame, words: int = 1, radii: tuple[int, ...] = (RADIUS,)) -> DataFrame:
    """Links u, v that connect all nodes of a bucket within each radius of each other, from rows (key, node, f0, ...)."""

    def run(batches):
        for some in _whole_buckets(batches, GATHERED):
            keys, fps, nodes = _bucket_numbers(some), _prints(some, words), some.column("node").to_numpy()
            for radius in radii:
                u, v = bucket_links(keys, nodes, fps, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return _dealt(rows.select("key", "node", *_names(words))).mapInArrow(run, "u long, v long").where("u <> v").distinct()


def similar_in_buckets(rows: DataFrame, words: int = WIDE_WORDS, radius: int = WIDE_RADIUS) -> DataFrame:
    """Links u, v of sufficient similarity that connect what labels leave apart in a bucket, from rows (key, node, f0, ..., label, shingles). No pair leaves its task but as a link."""

    def run(batches):
        for some in _whole_buckets(batches, GATHERED):
            keys = _bucket_numbers(some)
            keep = np.flatnonzero(_shared(keys))
            if not len(keep):
                continue
            some, keys = some.take(pa.array(keep)), keys[keep]
            lists = some.column("shingles").combine_chunks()
            ends, flat = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))), lists.flatten().to_numpy()
            sets = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            u, v = bucket_similar(keys, some.column("node").to_numpy(), _prints(some, words), some.column("label").to_numpy(), sets, radius)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return _dealt(rows.select("key", "node", *_names(words), "label", "shingles")).mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node but the roots of `edges` (u, v).

    Alternating large and small stars (Kiveris et al., 2014): every step keeps the components and
    brings each node closer to its least; the stars stand still when each node hangs on its root.
    """
    now = Written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "stars")
    mark = None
    while True:
        state = now.df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == mark or not state["n"]:
            break
        mark = (state["n"], state["h"])
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join deals the links anew and a root with very many of them can be split there.
        sums = Written(both.groupBy("u").agg(F.min("v").alias("m")), "stars-least")
        least = sums.df.select("u", F.least("u", "m").alias("m"))
        large = Written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        new = Written(small.distinct(), "stars")
        for old in (sums, large, now):
            old.drop()
        now = new
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(rows: DataFrame, edges: DataFrame, first: str = "doc_id") -> DataFrame:
    """node and component_id, the least `first` of its component, from rows (first, node) and the links u, v between nodes."""
    least = rows.groupBy("node").agg(F.min(first).alias("first"))
    stars = components(edges)
    rooted = Written(least.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node")), "fingerprint-roots").df
    least = Written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "fingerprint-least").df
    return Written(rooted.join(least, "root").select("node", "component_id"), "fingerprint-classes").df


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, a row for each of `docs`."""
    rows = Written(fingerprints(docs), "fingerprints").df.withColumn("node", F.col("f0"))
    fps = Written(rows.select("node", "f0").distinct(), "fingerprints-distinct").df
    keyed = fps.select(F.explode(bucket_keys(F.col("f0"), blocks_for(fps.count()))).alias("key"), "node", "f0")
    known = _classes(rows, links(keyed))
    return rows.join(known, "node").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def document() -> Column:
    """What tells documents apart: doc_id and the MD5 of the text, both empty where they are null."""
    md5 = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    return F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), md5)


def _set_of(text: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDE_SHINGLE))


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, document, node (a hash of the set of a text's shingles), f0, ... and `bands` (the keys of its buckets), a row for each of `docs`."""
    f = _names(WIDE_WORDS)
    schema = "doc_id long, document string, node long" + "".join(f", {n} long" for n in f) + ", bands array<long>"

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [_set_of(x) for x in batch.column(2).to_pylist()]
            nodes = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64).view(np.int64)
            prints = _fingerprints(sets, words=WIDE_WORDS).view(np.int64)
            bands = _lists(np.array([BANDS * (len(x) > 0) for x in sets], dtype=np.int64), band_keys([x for x in sets if len(x)]).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), *(pa.array(np.ascontiguousarray(prints[:, k])) for k in range(WIDE_WORDS)), bands], ["doc_id", "document", "node", *f, "bands"])

    return docs.select(F.col("doc_id").cast("long"), document().alias("document"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and `shingles`, the set of hashes, of some `nodes`: from the text of one document of each, as the `rows` of sketches() have them."""

    def run(batches):
        for batch in batches:
            sets = [_set_of(x) for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sizes, np.concatenate([np.empty(0, dtype=np.uint64), *sets]).view(np.int64))], ["node", "shingles"])

    one = Written(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("document").alias("_doc")), "bucket-documents").df
    # Rows that repeat a document meet under its key, where one is taken.
    texts = docs.select(document().alias("_doc"), F.col("text").cast("binary").alias("text")).join(one, "_doc")
    texts = texts.groupBy("_doc", "node").agg(F.first("text").alias("text"))
    return Written(texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>"), "shingle-sets").df


def similar(candidates: DataFrame, every: DataFrame) -> DataFrame:
    """Those of the `candidates` (u, v) whose sets, from `every` (node, shingles), are as similar as SIMILAR says."""
    met = candidates.select(F.col("u").alias("node")).union(candidates.select("v")).distinct()
    # Written, so that a node with very many candidates can be split in the joins.
    sets = Written(every.join(met, "node", "left_semi"), "candidate-sets").df
    one, two = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"_{n}")) for n in ("u", "v"))
    both, total = F.size(F.array_intersect("_u", "_v")), F.size("_u") + F.size("_v")
    # The union has `total - both` shingles.
    return candidates.join(one, "u").join(two, "v").where(both * (SIMILAR[0] + SIMILAR[1]) >= total * SIMILAR[0]).select("u", "v")


def similar_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links u, v of sufficient similarity that connect all nodes of a component, from `docs` and their sketches()."""
    f = _names(WIDE_WORDS)
    keyed = Written(rows.select("node", *f, "bands").dropDuplicates(["node"]).select(F.explode("bands").alias("key"), "node", *f), "bands").df
    shared = Written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"), "bands-shared").df
    buckets = Written(keyed.join(shared, "key"), "buckets").df
    sets = shingle_sets(docs, rows, buckets.select("node").distinct())
    close = Written(links(buckets, WIDE_WORDS, CLOSE), "close-candidates").df
    close = Written(similar(close, sets), "close-links").df
    labelled = Written(buckets.join(components(close), "node", "left").select("key", "node", *f, F.coalesce("root", "node").alias("label")), "buckets-labelled").df
    # A bucket whose nodes are all connected by now has no candidates left. In the others, sets go where they are compared.
    apart = labelled.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a < _b").select("key")
    labelled = labelled.join(Written(apart, "buckets-apart").df, "key")
    wide = similar_in_buckets(Written(labelled.join(sets, "node"), "buckets-with-sets").df)
    return Written(close.union(wide), "similar-links").df


def _copies(docs: DataFrame) -> DataFrame:
    """doc_id, document and `stays`, the first (unnamed, doc_id, document) of the component, a row for each of `docs`."""
    rows = Written(sketches(docs), "sketches").df
    # A document without id comes after all others.
    rows = rows.withColumn("place", F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "document"))
    known = _classes(rows, similar_links(docs, rows), "place")
    return rows.join(known, "node").select("doc_id", "document", F.col("component_id").alias("stays"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id by links of texts that share SIMILAR of their shingles or more, a row for each of `docs`."""
    return _copies(docs).select("doc_id", F.col("stays.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: one of each group of near copies.

    It is the row with the least doc_id, a null doc_id being the last; of equal ids that with the least MD5 of
    its text; of equal texts that with the least other columns. Groups are made of texts, so different texts
    stay whether they have no id or share one.
    """
    stay = Written(_copies(docs).select(F.col("stays.document").alias("_doc")).distinct(), "copies-stay").df
    rest = F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_none"))
    rows = docs.select(document().alias("_doc"), F.struct("doc_id", "text").alias("_own"), rest.alias("_rest")).join(stay, "_doc", "left_semi")
    # Rows that repeat an id and a text meet under their document, where the least is taken.
    one = rows.groupBy("_doc").agg(F.first("_own").alias("_own"), F.min("_rest").alias("_rest"))
    return one.select(*[F.col(f"{'_own' if c in ('doc_id', 'text') else '_rest'}.{c}").alias(c) for c in docs.columns])
