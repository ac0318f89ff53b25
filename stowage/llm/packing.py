"""Best-fit packing of documents into training sequences, by large-item matching.

Pieces above a third of the capacity are large: no three fit a bin, so a bin holds two at most. They
are paired by greedy matching, the longest first with the longest partner that fits. The others go,
longest first, into the smallest gap that takes them.

Lengths are whole numbers up to the capacity, so the packing is worked out on the histogram of
lengths, at most `capacity` counts whatever the number of documents. Its result is a list of runs
"the ranks from r on of length L fill the bins from b on, q to a bin, from offset o"; each piece then
finds its place from its length and its rank among the pieces of that length. Ranks are counted by
the tasks that encode, and offset by sums over tasks: nothing is sorted.

Defined results: null and empty texts hold only the closing id; a text of any length is encoded by one
task and cut into pieces; pieces of equal length take their places in the order in which they are
encoded, whatever their doc_ids; an empty table gives no pieces; repeated rows, and rows that share a
doc_id or have none, are packed each on its own; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import Written
from stowage.llm.tokenizing import word_ids

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
CLOSING_ID = 0


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32; `task` and `nth`, the piece's number among those of its length in that task."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"

    def encode(batches):
        from pyspark import TaskContext

        ids, met, task = word_ids(tokenizer), defaultdict(int), TaskContext.get().partitionId()
        closing = CLOSING_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column(1).to_pylist()
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                packed = ids.text(text) + closing
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    n = len(part) // 4
                    out.append((doc_id, k, at // 4, n, zlib.crc32(part), task, met[n]))
                    met[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(encode, schema)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, items, first bin, items a bin, offset) that pack `counts` (length: number)."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of bins (first, number)
    have = 0  # bit g is set if there are bins with gap g
    bins = 0

    def put(length: int, items: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], items, first, each, offset))
        used[length] += items
        left[length] -= items

    def leave(gap: int, first: int, number: int) -> None:
        nonlocal have
        if gap and number:
            gaps[gap].append((first, number))
            have |= 1 << gap

    def opened(number: int) -> int:
        nonlocal bins
        bins += number
        return bins - number

    halves = sorted((n for n in left if 3 * n > capacity >= 2 * n), reverse=True)
    for big in sorted((n for n in left if 2 * n > capacity), reverse=True):
        for other in (n for n in halves if n <= capacity - big):
            if number := min(left[big], left[other]):
                first = opened(number)
                put(big, number, first, 1, 0)
                put(other, number, first, 1, big)
                leave(capacity - big - other, first, number)
            if not left[big]:
                break
        if number := left[big]:
            first = opened(number)
            put(big, number, first, 1, 0)
            leave(capacity - big, first, number)
    single: tuple[int, int] | None = None  # a bin with one item of half the capacity at most: its length, the bin
    for n in halves:
        if single and left[n]:
            put(n, 1, single[1], 1, single[0])
            leave(capacity - single[0] - n, single[1], 1)
            single = None
        if number := left[n] // 2:
            first = opened(number)
            put(n, 2 * number, first, 2, 0)
            leave(capacity - 2 * n, first, number)
        if left[n]:
            single = (n, opened(1))
            put(n, 1, single[1], 1, 0)
    if single:
        leave(capacity - single[0], single[1], 1)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            if fits := have >> n:
                gap = n + (fits & -fits).bit_length() - 1
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    have &= ~(1 << gap)
            else:
                gap = capacity
                number = -(-left[n] // (gap // n))
                first = opened(number)
            each = gap // n
            if full := min(number, left[n] // each):
                put(n, full * each, first, each, capacity - gap)
                leave(gap - each * n, first, full)
                first, number = first + full, number - full
            if number and left[n] and left[n] < each:
                items = left[n]
                put(n, items, first, items, capacity - gap)
                leave(gap - items * n, first, 1)
                first, number = first + 1, number - 1
            if number and gap < capacity:
                leave(gap, first, number)
    return runs


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of all documents with the sequence and the offset that each takes."""
    rows = Written(pieces(docs, capacity, tokenizer), "pieces").df
    tally = Written(rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts").df
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = np.array(sorted(plan_bins(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    span = np.int64(max(counts.values(), default=0) + 1)
    key = runs[:, 0] * span + runs[:, 1]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each task and length: it grows with the input, so it is merged, never broadcast.
    tally = tally.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")).hint("merge")
    ranked = rows.join(tally, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("_before")).alias("_rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            run = runs[np.searchsorted(key, length * span + rank, side="right") - 1]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 3] + nth // run[:, 4], run[:, 5] + nth % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
