"""Scores of texts by a class-based bigram model (Brown et al., 1992).

Every word that training texts hold LEAST times or more is assigned to a class by exchange clustering
(Martin, Liermann and Ney, 1998): a word moves to the class that raises the likelihood of the class
bigrams most. The probability of a word is that of its class after the state before it, times that of
the word within its class, both smoothed; the score is its log10, summed. The state is the class of
the word before, whichever that is; the closing token is a state and a class of its own.

The exchange has two parts. The SINGLY most frequent words are exchanged one after the other on the
driver, from the counts of their bigrams: SINGLY^2 numbers at most. All other words are exchanged in
Spark, all at once: each moves to the class that makes what it follows most likely in the grid of the
round before (Dhillon, Mallela and Kumar, 2003), until a round gains less than SETTLED of the likelihood.
That is done twice. At first, words that tasks don't know (see below) are one context; then they have
the classes that they were given, by joins, and every word is exchanged again from the classes of all
words before it. Last, the grid is counted with the classes that all words have in the end. The counts
are a table with a row a word, which grows with the vocabulary; the grid doesn't. Rarer words, and words
not seen in training, share the last class but one.

Counts cover all training texts. Tasks know the HEAD most frequent words of at most HEAD_BYTES bytes,
with their counts and classes; the others meet theirs by a join, to which a document sends each of them
once. Pairs of words that tasks don't know are counted as such.

Defined results: null and empty texts have only the closing token; a null doc_id counts as the empty
text, so it is learned from; rows that repeat a doc_id are scored each on its own; words that are
equally frequent go by their bytes; a text of any length is one row and is taken whole; an empty table
gives an empty result; without training texts the model knows nothing and all scores are finite; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import Written

#: The closing token: no word holds a line feed.
END = b"\n"
#: Words whose classes are states (None: all words; a number: so many of the most frequent ones, the others are one state), classes (with that of rare words and that of the closing token), and the least count of a word that is clustered.
CONTEXT, CLASSES, LEAST = None, 64, 3
#: Words that are exchanged one after the other, on the driver; so many as CONTEXT where that is a number.
SINGLY = 2048
#: Words whose counts every task knows, and the most bytes of one.
HEAD, HEAD_BYTES = 100_000, 64
#: Added to each count.
DELTA = 0.5
#: The exchange ends when a round raises the log likelihood by no more than this share; that in Spark also after so many rounds.
SETTLED, ROUNDS = 1e-4, 20
#: Words a task remembers or counts before it empties its memory, and tokens whose contexts it holds.
REMEMBERED, HELD = 400_000, 2_000_000


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text; the closing token is not among them."""
    return (text or b"").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """word and n over all `texts` (text, binary), the closing token among them."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def emptied():
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
                counts[END] += 1
                if len(counts) > REMEMBERED:
                    yield emptied()
        if counts:
            yield emptied()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Numbers(dict):
    """The number of a word: its rank for a known word, then those of any other word and of the closing token, then words as they are met."""

    def __init__(self, known: list[bytes]):
        super().__init__({w: k for k, w in enumerate(known)})
        self[END] = len(known) + 1
        self.width, self.met = len(known) + 2, []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.width + len(self.met)
        self.met.append(word)
        return number


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, with the sum of its numbers."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(n, first)


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


_FOUND = "word binary, units array<int>, counts array<long>, followers array<binary>, times array<long>"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def context_counts(texts: DataFrame, known: list[bytes], singly: int, pairs: bool) -> DataFrame:
    """How often each word follows each unit, which is a known word, any other word (len(known)) or the beginning (the next).

    A word comes in as many rows as tasks have met it, with units and counts. With `pairs`, other words also
    have the units that follow them (those plus the number of units) and their followers that aren't known. Rows
    without a word have the counts of the first `singly` known words and of the closing token after each
    other, the beginning and all other words; their units are codes, the unit before times singly + 2 plus that
    of the word.
    """
    width, side = len(known) + 2, singly + 2
    low = np.int64((1 << 32) - 1)

    def small(at: np.ndarray) -> np.ndarray:
        return np.where(at < singly, at, np.where(at == width - 1, singly + 1, singly))

    def run(batches):
        number, held, size, lefts, rights = Numbers(known), [], 0, [], []
        square = np.zeros(side * side, dtype=np.int64)

        def counted():
            codes = np.concatenate(held)
            held.clear()
            word, before = codes >> 32, codes & low
            to, of = small(word), small(before)
            inside = to != singly
            square[:] += np.bincount(of[inside] * side + to[inside], minlength=side * side)
            # Small words after other than small ones have them as units too, but for words that aren't known: those are in the square.
            later = ~inside | ((of == singly) & (before < width))
            if later.any():
                lefts.append(np.unique((word[later] << 32) | np.where(before < width, before, width - 2)[later], return_counts=True))
            if pairs and (after := before >= width).any():
                rights.append(np.unique((before[after] << 32) | word[after], return_counts=True))

        def emptied():
            left, right = ([np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 for parts in (lefts, rights))
            lefts.clear()
            rights.clear()
            met = number.met
            name = lambda k: known[k] if k < len(known) else END if k < width else met[k - width]
            far = (right[0] & low) >= width
            # The units that follow a word lie behind those before it.
            codes, n = _summed(np.concatenate((left[0], right[0][~far] + width)), np.concatenate((left[1], right[1][~far])))
            pair, times = _summed(right[0][far], right[1][far]) if far.any() else (right[0][far], right[1][far])
            words = np.union1d(codes >> 32, pair >> 32)
            ends, stops = (np.concatenate(([0], np.searchsorted(x >> 32, words, "right"))) for x in (codes, pair))
            followers = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array([met[k - width] for k in (pair & low).tolist()], pa.binary()))
            columns = [pa.array([name(k) for k in words.tolist()], pa.binary()), _lists(ends, (codes & low).astype(np.int32)), _lists(ends, n), followers, _lists(stops, times)]
            return pa.RecordBatch.from_arrays(columns, _FOUND_NAMES)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = tokens(text)
                at = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
                held.append((np.append(at, width - 1) << 32) | np.concatenate(([width - 1], at)))
                size += len(at) + 1
                if size > HELD:
                    counted()
                    size = 0
                    if len(number.met) > REMEMBERED:
                        yield emptied()
                        number = Numbers(known)
        if held:
            counted()
        if lefts or rights:
            yield emptied()
        codes = np.flatnonzero(square)
        if len(codes):
            ends, none = np.array([0, len(codes)]), np.array([0, 0])
            columns = [pa.array([None], pa.binary()), _lists(ends, codes.astype(np.int32)), _lists(ends, square[codes]), pa.ListArray.from_arrays(pa.array(none.astype(np.int32)), pa.array([], pa.binary())), _lists(none, np.zeros(0, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, _FOUND_NAMES)

    return texts.select("text").mapInArrow(run, _FOUND)


def _without_word(found: DataFrame, width: int) -> np.ndarray:
    """The sums of the rows without a word, by unit or code."""
    each = found.where("word is null").select(F.explode(F.arrays_zip("units", "counts")).alias("x"))
    rows = each.groupBy(F.col("x.units").alias("unit")).agg(F.sum("x.counts").alias("n")).toArrow()
    out = np.zeros(width, dtype=np.float64)
    out[rows["unit"].to_numpy()] = rows["n"].to_numpy()
    return out


def _merged(rows: pa.RecordBatch, group: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """Rows of context_counts() summed by group, whose names are given."""
    out, n = [names], len(names)
    for kind in (1, 3):
        at, sizes = rows.column(kind).flatten(), rows.column(kind).value_lengths().to_numpy()
        held = None
        if kind == 3:
            at, held = at.dictionary_encode().indices, at.dictionary_encode().dictionary
        codes, times = (np.repeat(group.astype(np.int64), sizes) << 32) | at.to_numpy().astype(np.int64), rows.column(kind + 1).flatten().to_numpy()
        if len(codes):
            codes, times = _summed(codes, times)
        ends = np.searchsorted(codes >> 32, np.arange(n + 1))
        at = (codes & 0xFFFFFFFF).astype(np.int32)
        out += [_lists(ends, at) if held is None else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), held.take(pa.array(at))), _lists(ends, times)]
    return pa.RecordBatch.from_arrays(out, _FOUND_NAMES)


def word_contexts(found: DataFrame, known: list[bytes], singly: int, least: int = LEAST) -> DataFrame:
    """A row for each word that is known or met `least` times or more, from context_counts(), with its unit, or -1 where it has none; rows without a word have the sums of the rarer ones.

    Of the known words, only the first `singly` count as met often enough by that alone.
    """
    width = len(known) + 2
    units = pa.array([*known, b" ", END], pa.binary())  # no word has a blank

    def finished(rows: pa.RecordBatch):
        unit = pa.compute.fill_null(pa.compute.index_in(rows.column(0), units), -1).to_numpy()
        sizes = rows.column(1).value_lengths().to_numpy()
        at, n = rows.column(1).flatten().to_numpy(), rows.column(2).flatten().to_numpy()
        met = np.bincount(np.repeat(np.arange(rows.num_rows), sizes), weights=n * (at < width), minlength=rows.num_rows)
        often = (met >= least) | ((unit >= 0) & (unit < singly)) | (unit == width - 1)
        kept = rows.filter(pa.array(often))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(unit[often], pa.int32())], [*_FOUND_NAMES, "unit"])
        if not often.all():
            rest = rows.filter(pa.array(~often))
            rest = _merged(rest, np.zeros(rest.num_rows, np.int64), pa.array([None], pa.binary()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([-1], pa.int32())], [*_FOUND_NAMES, "unit"])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def summed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            word = rows.column(0).dictionary_encode()
            return _merged(rows, word.indices.to_numpy(), word.dictionary)

        entries = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            entries += batch.num_rows + len(batch.column(1).flatten()) + len(batch.column(3).flatten())
            if entries >= 1_000_000:
                rows = summed()
                if rows.num_rows > 1:
                    yield from finished(rows.slice(0, rows.num_rows - 1))
                held, entries = [rows.slice(rows.num_rows - 1)], 0
        if held:
            yield from finished(summed())

    rows = found.where("word is not null").withColumn("_h", F.xxhash64("word"))
    return rows.repartition("_h").sortWithinPartitions("_h", "word").select(*_FOUND_NAMES).mapInArrow(run, _FOUND + ", unit int")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, classes: int = CLASSES, own: int = 1) -> np.ndarray:
    """The class of each unit, exchanged until a round over all raises the likelihood by SETTLED of it or less; the last `own` units keep a class each to themselves, the last classes.

    The criterion is the log likelihood of the class bigrams, of which a move changes two rows and two
    columns.
    """
    n = len(counts)
    often = np.argsort(-counts.sum(axis=0)[: n - own], kind="stable")
    of = np.empty(n, dtype=np.int64)
    of[often] = np.arange(n - own) % (classes - own)
    of[n - own :] = np.arange(classes - own, classes)
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    grid = member.T @ counts @ member
    after, before = counts @ member, counts.T @ member  # by unit: the classes that follow it, and that it follows
    free = np.arange(classes - own)
    best_so_far = -math.inf
    while True:
        now = _xlogx(grid).sum() - _xlogx(grid.sum(axis=0)).sum() - _xlogx(grid.sum(axis=1)).sum()
        if now - best_so_far <= SETTLED * abs(now):
            break
        best_so_far = now
        for w in often:
            row, col, twice, a = after[w].copy(), before[w].copy(), counts[w, w], of[w]
            if not row.any() and not col.any():
                continue
            # Without w; its own bigram is then counted once more in the corner.
            row[a] -= twice
            col[a] -= twice
            base = grid.copy()
            base[a, :] -= row
            base[:, a] -= col
            base[a, a] -= twice
            right, left = base.sum(axis=1), base.sum(axis=0)
            gain = (_xlogx(base[free, :] + row) - _xlogx(base[free, :])).sum(axis=1) + (_xlogx(base[:, free].T + col) - _xlogx(base[:, free].T)).sum(axis=1)
            corner = base[free, free]
            gain += _xlogx(corner + row[free] + col[free] + twice) + _xlogx(corner) - _xlogx(corner + row[free]) - _xlogx(corner + col[free])
            out, into = row.sum() + twice, col.sum() + twice
            gain -= _xlogx(right[free] + out) - _xlogx(right[free]) + _xlogx(left[free] + into) - _xlogx(left[free])
            best = int(free[np.argmax(gain)])
            if best != a and gain[best] > gain[a] + 1e-9 * (1 + abs(gain[a])):
                base[best, :] += row
                base[:, best] += col
                base[best, best] += twice
                grid = base
                after[:, a] -= counts[:, w]
                after[:, best] += counts[:, w]
                before[:, a] -= counts[w, :]
                before[:, best] += counts[w, :]
                of[w] = best
    return of


class Exchange:
    """The classes of words that aren't exchanged singly, from their counts after each unit and a grid of states and classes."""

    def __init__(self, columns: np.ndarray, grid: np.ndarray, first: bool = False):
        #: The state that a code of a word's row counts for, or -1.
        self.columns = columns
        cells = grid[:, : CLASSES - 2] + 1e-3
        if first:
            # A state after which no context word comes still has a class that its words can begin in.
            cells[np.arange(CLASSES), np.arange(CLASSES) % (CLASSES - 2)] += 1
        self.odds = np.log(cells) - np.log(cells.sum(axis=0))

    def classes(self, after: np.ndarray) -> np.ndarray:
        """The class that makes each word's bigrams most likely; of several the least."""
        return np.argmax(after @ self.odds, axis=1)


def _after(columns: np.ndarray, units: pa.ListArray, counts: pa.ListArray) -> np.ndarray:
    """How often each word follows each state."""
    state, n = columns[units.flatten().to_numpy()], counts.flatten().to_numpy()
    rows = np.repeat(np.arange(len(units)), units.value_lengths().to_numpy())
    keep = state >= 0
    return np.bincount((rows * CLASSES + state)[keep], weights=n[keep], minlength=len(units) * CLASSES).reshape(-1, CLASSES)


class Assigned:
    """The classes of all words: those of the words that are exchanged singly (`of`, then that of other words and of the closing token), and those of the others by an Exchange."""

    def __init__(self, of: np.ndarray, width: int, last: Exchange | None = None, known: np.ndarray | None = None):
        self.of, self.singly, self.width, self.last = of, len(of) - 2, width, last
        #: The class of each unit.
        self.known = np.full(width, CLASSES - 2)
        if known is not None:
            self.known[:] = known
        self.known[: self.singly], self.known[width - 1] = of[: self.singly], CLASSES - 1

    def columns(self, others: int, rest: bool) -> np.ndarray:
        """The states of the units (that of words that aren't known is `others`), of those that follow, and of the codes of _completed()."""
        state = self.known.copy()
        if CONTEXT is not None:
            state[CONTEXT : self.width - 1] = CLASSES - 2
        state[self.width - 2] = others
        return np.concatenate((state, np.full(self.width, -1), np.arange(CLASSES) if rest else np.full(CLASSES, -1)))

    def free(self, rows: pa.RecordBatch) -> np.ndarray:
        """Which rows of word_contexts() have a word that can move."""
        unit = rows.column("unit").to_numpy()
        return rows.column("word").is_valid().to_numpy(zero_copy_only=False) & ((unit < 0) | ((unit >= self.singly) & (unit < self.width - 1)))

    def classes(self, rows: pa.RecordBatch) -> np.ndarray:
        """The class of each row of word_contexts()."""
        unit = rows.column("unit").to_numpy()
        fixed = np.where(unit < 0, CLASSES - 2, self.known[unit])
        return fixed if self.last is None else np.where(self.free(rows), self.last.classes(_after(self.last.columns, rows.column("units"), rows.column("counts"))), fixed)


class ClassModel:
    """The trained model. `transition` has log10 P(class | state); a word's emission is log10(count + DELTA) less its class's `log_class`."""

    def __init__(self, grid: np.ndarray, words: np.ndarray, n: int, v: int):
        """From the counts of `grid` (states by classes) and the number of different words of each class."""
        self.n, self.v = n, v
        follow = grid.sum(axis=1, keepdims=True)
        kinds = (grid > 0).sum(axis=1, keepdims=True) + 1
        alone = (grid.sum(axis=0) + DELTA) / (grid.sum() + DELTA * CLASSES)
        # Witten and Bell's weight between the bigram and the unigram of classes.
        self.transition = np.log10((grid + kinds * alone) / (follow + kinds))
        # Only the class of rare words has room for words that training texts don't hold.
        room = words + (np.arange(CLASSES) == CLASSES - 2)
        self.log_class = np.log10(grid.sum(axis=0) + DELTA * np.maximum(room, 1))
        self.log_all = math.log10(n + DELTA * (v + 1))


class Head:
    """What every task knows: the most frequent words with their counts, classes and the states after them, and the model."""

    def __init__(self, model: ClassModel, rows: list[tuple[bytes, int, int]], context: int, closing: int):
        self.model, self.closing = model, closing
        self.words = [w for w, _, _ in rows]
        self.log_count = np.log10(np.array([n for _, n, _ in rows], dtype=np.float64) + DELTA)
        self.classes = np.array([k for _, _, k in rows], dtype=np.int64)
        self.states = np.where(np.arange(len(rows)) < context, self.classes, CLASSES - 2)


def _most_frequent(words: DataFrame, n: int) -> list[tuple]:
    """The rows of the n most frequent words that have HEAD_BYTES bytes at most, in order; of equally frequent ones the first by its bytes."""
    short = words.where((F.octet_length("word") <= HEAD_BYTES) & (F.col("word") != F.lit(END)))
    return sorted(map(tuple, short.orderBy(F.desc("n"), "word").limit(n).toArrow().to_pandas().itertuples(index=False)), key=lambda x: (-x[1], x[0]))


def _tallied(table: DataFrame, now: Assigned, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often classes of the words in `table` follow states, the number of words that can move in each class, and the classes of the units."""
    size = CLASSES * CLASSES

    def tally(batches):
        sums, met = np.zeros((CLASSES, CLASSES)), np.zeros(CLASSES)
        at, x = [], []
        for batch in batches:
            if batch.num_rows:
                classes, free, unit = now.classes(batch), now.free(batch), batch.column("unit").to_numpy()
                member = np.zeros((len(classes), CLASSES))
                member[np.arange(len(classes)), classes] = 1
                sums += _after(columns, batch.column("units"), batch.column("counts")).T @ member
                met += member[free].sum(axis=0)
                at.append(size + CLASSES + unit[free & (unit >= 0)])
                x.append(classes[free & (unit >= 0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((np.arange(size + CLASSES), *at))), pa.array(np.concatenate((sums.ravel(), met, *x)))], ["at", "x"])

    got = table.select("word", "units", "counts", "unit").mapInArrow(tally, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # bounded: HEAD units and arrays of fixed size
    sums = np.zeros(size + CLASSES + now.width)
    sums[size + CLASSES :] = CLASSES - 2
    sums[got["at"].to_numpy()] = got["x"].to_numpy()
    return sums[:size].reshape(CLASSES, CLASSES), sums[size : size + CLASSES], sums[size + CLASSES :].astype(np.int64)


def _exchanged(table: DataFrame, start: Assigned, grid: np.ndarray, fixed: np.ndarray, others: int) -> Assigned:
    """The last round of the exchange of the words in `table`, which begins with the states of `start` and `grid`. `fixed` is what the table doesn't have of the grid."""

    def likelihood(grid: np.ndarray) -> float:
        return _xlogx(grid).sum() - _xlogx(grid.sum(axis=0)).sum()

    found, held, best = None, start, -math.inf
    for _ in range(ROUNDS):
        columns = held.columns(others, True)
        now = Assigned(start.of, start.width, Exchange(columns, grid, start.last is None and found is None))
        sums, _, known = _tallied(table, now, columns)
        new = fixed + sums
        better = likelihood(new)
        if found is not None and better <= best:
            break
        done = better - best <= SETTLED * abs(better)
        found = held = Assigned(start.of, start.width, now.last, known)
        grid, best = new, better
        if done or not sums.any():
            break
    return found


def _followed(table: DataFrame, now: Assigned, known: list[bytes]) -> DataFrame:
    """word, unit, state and n: how often a word follows words of each class that aren't known. Words that are exchanged singly, and the closing token, have their unit instead of a name."""
    width, singly = now.width, now.singly

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names = ["word", "unit", "state", "n"]
        for batch in batches:
            if not batch.num_rows:
                continue
            classes = now.classes(batch)
            codes, n = batch.column("units").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            state = np.repeat(classes, batch.column("units").value_lengths().to_numpy())
            right = (codes >= width) & (codes < 2 * width)
            if right.any():
                held.append(_summed((codes[right] - width).astype(np.int64) * CLASSES + state[right], n[right]))
            far = batch.column("followers").flatten().dictionary_encode()
            if len(far):
                state = np.repeat(classes, batch.column("followers").value_lengths().to_numpy())
                codes, n = _summed(far.indices.to_numpy().astype(np.int64) * CLASSES + state, batch.column("times").flatten().to_numpy())
                yield pa.RecordBatch.from_arrays([far.dictionary.take(pa.array(codes // CLASSES)), pa.array(np.full(len(codes), -1), pa.int32()), pa.array(codes % CLASSES, pa.int32()), pa.array(n)], names)
        if held:
            codes, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            unit = codes // CLASSES
            small = (unit < singly) | (unit == width - 1)
            words = pa.array([None if s else known[u] for u, s in zip(unit.tolist(), small.tolist(), strict=True)], pa.binary())
            unit = np.where(small, np.minimum(unit, singly + 1), -1)
            yield pa.RecordBatch.from_arrays([words, pa.array(unit, pa.int32()), pa.array(codes % CLASSES, pa.int32()), pa.array(n)], names)

    return table.mapInArrow(run, "word binary, unit int, state int, n long")


def _square(rows: DataFrame, to: str, width: int) -> np.ndarray:
    """The sums of n by state and another column, of fixed size."""
    got = rows.groupBy("state", to).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((CLASSES, width))
    out[got["state"].to_numpy(), got[to].to_numpy()] = got["n"].to_numpy()
    return out


def _completed(table: DataFrame, followed: DataFrame, width: int) -> DataFrame:
    """`table` with the states of words that aren't known among the units, as codes behind them."""
    rest = followed.where("word is not null").groupBy("word", "state").agg(F.sum("n").alias("n"))
    rest = rest.groupBy("word").agg(F.collect_list(F.struct((F.col("state") + 2 * width).alias("unit"), "n")).alias("_rest"))
    more = lambda name, part, kind: F.concat(name, F.coalesce(F.col(f"_rest.{part}"), F.array().cast(kind))).alias(name)
    return table.join(rest, "word", "left").select("word", more("units", "unit", "array<int>"), more("counts", "n", "array<long>"), "followers", "times", "unit")


def train(docs: DataFrame) -> tuple[Head, DataFrame]:
    """The model, and word, n and cls of all words of the documents that aren't held out."""
    spark = docs.sparkSession
    texts = docs.where(~held_out(F.col("doc_id"))).select(F.col("text").cast("binary").alias("text"))
    counts = Written(word_counts(texts), "word-counts").df
    n, v, closing = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1)), F.max(F.when(F.col("word") == F.lit(END), F.col("n")))).first())
    known = [bytes(w) for w, _ in _most_frequent(counts, max(HEAD, SINGLY) if CONTEXT is None else CONTEXT)]
    singly, width = min(SINGLY if CONTEXT is None else CONTEXT, len(known)), len(known) + 2
    found = Written(context_counts(texts, known, singly, CONTEXT is None), "contexts")
    side = singly + 2
    square = _without_word(found.df, side * side).reshape(side, side)
    of = exchange(square, CLASSES, 2)
    member = np.zeros((side, CLASSES))
    member[np.arange(side), of] = 1
    table = Written(word_contexts(found.df, known, singly), "word-contexts")
    found.drop()
    # Words that aren't known are one state at first.
    start = Assigned(of, width)
    grid = member.T @ square @ member
    now = _exchanged(table.df, start, grid, grid, CLASSES - 2)
    others = CLASSES - 2
    if CONTEXT is None:
        # Then they have the classes that they were given, and all words are exchanged again.
        others = -1
        followed = Written(_followed(table.df, now, known), "followed")
        square[singly] = 0
        fixed = member.T @ square @ member
        rest = _square(followed.df.where("word is null"), "unit", side) @ member
        whole = Written(_completed(table.df, followed.df, width), "word-contexts")
        table.drop()
        followed.drop()
        table = whole
        sums, _, _ = _tallied(table.df, now, now.columns(others, True))
        now = _exchanged(table.df, now, fixed + rest + sums, fixed + rest, others)
    else:
        fixed = grid

    def assigned(batches):
        for batch in batches:
            if batch.num_rows:
                free = pa.array(now.free(batch))
                yield pa.RecordBatch.from_arrays([batch.column("word").filter(free), pa.array(now.classes(batch)).filter(free)], ["word", "cls"])

    classes = Written(table.df.select("word", "units", "counts", "unit").mapInArrow(assigned, "word binary, cls long"), "classes").df
    given = [(bytearray(w), int(k)) for w, k in zip([*known[:singly], None, END], of.tolist(), strict=True) if w is not None]
    classes = classes.union(spark.createDataFrame(given, "word binary, cls long"))
    # The grid is counted with the classes that all words have in the end.
    sums, number, _ = _tallied(table.df, now, now.columns(others, False))
    grid = fixed + sums
    if CONTEXT is None:
        followed = Written(_followed(table.df, now, known), "followed")
        grid += _square(followed.df.where("word is null"), "unit", side) @ member
        named = followed.df.where("word is not null").join(classes, "word", "left").select("state", F.coalesce("cls", F.lit(CLASSES - 2)).alias("cls"), "n")
        grid += _square(named, "cls", CLASSES)
        followed.drop()
    number = number + np.bincount(of, minlength=CLASSES)
    number[CLASSES - 2] = 0
    number[CLASSES - 2] = max(0, v - number.sum())
    vocabulary = Written(counts.join(classes, "word", "left").select("word", "n", F.coalesce("cls", F.lit(CLASSES - 2)).alias("cls")), "vocabulary").df
    table.drop()
    rows = [(bytes(w), int(c), int(k)) for w, c, k in _most_frequent(vocabulary, HEAD)]
    return Head(ClassModel(grid, number, n, v), rows, len(rows) if CONTEXT is None else CONTEXT, closing), vocabulary


class Places(dict):
    """The rank of a word of the head, and for other words of a text places behind those, as they are met."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: k for k, w in enumerate(words)})
        self.base, self.met = len(words), []

    def __missing__(self, word: bytes) -> int:
        place = self[word] = self.base + len(self.met)
        self.met.append(word)
        return place

    def emptied(self) -> list[bytes]:
        """The other words in order, which are forgotten."""
        met, self.met = self.met, []
        for word in met:
            del self[word]
        return met


_PARTIAL = "row long, doc_id long, n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>, before array<int>, after array<int>, pairs array<int>"


def _partial(docs: DataFrame, head: Head) -> DataFrame:
    """A row for each document: what the head gives of its scores; its other words, each once, with their numbers; and its pairs of a state and a class that aren't known before those words are.

    Of a pair, numbers from CLASSES on are places among the words.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), *[pa.list_(pa.int32())] * 4)
    names = [x.split()[0] for x in _PARTIAL.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(head)  # bounded: HEAD words of HEAD_BYTES bytes and arrays of fixed size
    one_state = CONTEXT is not None

    def run(batches):
        h = shared.value
        m = h.model
        rank = Places(h.words)
        end, base = CLASSES - 1, len(h.words)
        log_end = math.log10(h.closing + DELTA)
        for batch in batches:
            out = []
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens(text)
                ranks = np.fromiter(map(rank.__getitem__, words), dtype=np.int64, count=len(words))
                other = rank.emptied()
                inside = ranks < base
                met = ranks[inside]
                place = ranks - base + CLASSES
                state, cls = np.empty(len(words) + 1, dtype=np.int64), np.empty(len(words) + 1, dtype=np.int64)
                state[0] = cls[-1] = end
                state[1:] = CLASSES - 2 if one_state else place
                state[1:][inside] = h.states[met]
                cls[:-1] = place
                cls[:-1][inside] = h.classes[met]
                sure = (state < CLASSES) & (cls < CLASSES)
                log = h.log_count[met].sum()
                score = m.transition[state[sure], cls[sure]].sum() + log - m.log_class[h.classes[met]].sum() + log_end - m.log_class[end]
                codes, pairs = np.unique((state[~sure] << 32) | cls[~sure], return_counts=True)
                times = np.bincount(ranks[~inside] - base, minlength=len(other))
                out.append((row, doc_id, len(words) + 1, len(met) + (h.closing > 0), float(log + log_end - (len(words) + 1) * m.log_all), float(score), other, times, codes >> 32, codes & 0xFFFFFFFF, pairs))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    # Spark numbers the rows: one task of Written may take several partitions, and a count in it would begin anew with each.
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _PARTIAL)


def _finished(rows: DataFrame, model: ClassModel) -> DataFrame:
    """doc_id, n_tokens, n_known, base and score from rows of _partial() with `met`, the place, count and class of each of their other words."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            of = lambda name: np.repeat(np.arange(batch.num_rows), batch.column(name).value_lengths().fill_null(0).to_numpy())  # noqa: B023, E731
            flat = lambda name: batch.column(name).flatten()  # noqa: B023, E731
            sizes = batch.column("times").value_lengths().to_numpy()
            first = np.cumsum(sizes) - sizes
            count, cls = np.zeros(sizes.sum()), np.full(sizes.sum(), CLASSES - 2)
            got = flat("met")
            at = first[of("met")] + got.field("place").to_numpy()
            count[at], cls[at] = got.field("n").to_numpy(), got.field("cls").to_numpy()
            times, row = flat("times").to_numpy(), of("times")
            log = np.bincount(row, weights=times * np.log10(count + DELTA), minlength=batch.num_rows)
            score = log - np.bincount(row, weights=times * model.log_class[cls], minlength=batch.num_rows)
            n_known = np.bincount(row, weights=times * (count > 0), minlength=batch.num_rows).astype(np.int64)
            row = of("pairs")

            def known(name, row=row, cls=cls, first=first, flat=flat):
                code = flat(name).to_numpy()
                later = code >= CLASSES
                out = code.copy()
                out[later] = cls[first[row[later]] + code[later] - CLASSES]
                return out

            score += np.bincount(row, weights=flat("pairs").to_numpy() * model.transition[known("before"), known("after")], minlength=batch.num_rows)
            sums = [batch.column(name).to_numpy() + x for name, x in (("n_known", n_known), ("base", log), ("score", score))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base", "score"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, score double")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each of `docs`; perplexity is the model's."""
    head, vocabulary = train(docs)
    model = head.model
    rows = Written(_partial(docs, head), "lm-partial").df
    rest = rows.select("row", F.posexplode("words").alias("place", "word")).join(vocabulary, "word")
    rest = rest.groupBy("row").agg(F.collect_list(F.struct("place", "n", "cls")).alias("met"))
    rows = _finished(rows.drop("words").join(rest, "row", "left"), model)
    # The head's part of the base has log_all for every word of the document, in the head or not.
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
