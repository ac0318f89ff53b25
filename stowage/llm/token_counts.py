"""Token counts that follow edits: a segment tree of pre-tokens for each document.

A text is cut into pre-tokens, which a byte-level BPE encodes one by one. Leaves of the tree hold
blocks of pre-tokens; inner nodes hold the sums of their characters and tokens. A tree is kept with its
text, as the sums of its leaves, and taken up again when the text is edited: only leaves that an edit
touches are cut again. An edit finds its leaves from the sums, cuts the text anew from two pre-tokens before it until a cut falls on an old
one behind it, encodes only those, and updates the sums above the leaves it touched.

Two pre-tokens are context enough on the left: where a match of the pattern ends is decided by the
characters up to and including the first one after the run of white space that follows it, which is
in the next pre-token. On the right, the pattern never looks back, so once a cut falls on an old one
in unchanged text all later cuts agree.

Defined results: a null text counts as empty; edits outside the text are clipped to it; null edits
are none; rows that repeat a doc_id, and rows without one, are counted each on its own, equal texts
alike; a text of any length is one tree, built by one task; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import Written
from stowage.llm.tokenizing import REMEMBERED, load

TOKENIZER = "byte_bpe_50k.json"
#: Pre-tokens of a fresh leaf; one that grows beyond four times as many is split.
LEAF = 64


class PieceCounts(dict):
    """Number of tokens of a pre-token."""

    def __init__(self, tokenizer: str):
        super().__init__()
        self.model = load(tokenizer)
        self.model.encode_special_tokens = True

    def __missing__(self, piece: str) -> int:
        n = len(self.model.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


@cache
def piece_counts(tokenizer: str) -> PieceCounts:
    """The worker's own PieceCounts: tasks that share a Python worker share what it remembers."""
    return PieceCounts(tokenizer)


def cutter():
    """The pattern of the public byte-level tokenizers, which cuts a text into pre-tokens."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class PieceTree:
    """Pre-tokens of one text under a segment tree of sums. `encoded` counts the pre-tokens encoded so far.

    With `chars` and `tokens`, the sums of its leaves, a tree is taken up again as it was stored: the
    leaves' pre-tokens are cut from the text only when an edit touches them.
    """

    def __init__(self, text: str, cut, counts: PieceCounts, chars: list[int] | None = None, tokens: list[int] | None = None):
        self.cut, self.counts, self.source = cut, counts, text
        if chars is None:
            pieces = cut.findall(text)
            self.encoded = len(pieces)
            leaves = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
            self._grow([(leaf, sum(map(len, leaf)), self._tokens_of(leaf), 0) for leaf in leaves])
        else:
            self.encoded = 0
            places = accumulate(chars[:-1], initial=0)
            self._grow([(None, c, t, at) for c, t, at in zip(chars, tokens, places, strict=True)])

    def _tokens_of(self, pieces: list[str]) -> int:
        return sum(map(self.counts.__getitem__, pieces))

    def _grow(self, leaves: list[tuple[list[str] | None, int, int, int]]) -> None:
        """Build the tree over leaves (pieces or None, characters, tokens, place in the text as it was stored)."""
        self.leaves, self.places = [x[0] for x in leaves], [x[3] for x in leaves]
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (_, chars, tokens, _) in enumerate(leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = chars, tokens
        for node in range(self.width - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def leaf(self, k: int) -> list[str]:
        """The pieces of a leaf. It begins at a cut, and the pattern never looks back, so they are those of the whole text."""
        if self.leaves[k] is None:
            at, pieces = self.places[k], []
            end = at + self.chars[self.width + k]
            for found in self.cut.finditer(self.source, at) if end > at else ():
                pieces.append(found.group())
                if found.end() >= end:
                    break
            self.leaves[k] = pieces
        return self.leaves[k]

    def stored(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves: with the text, all that it takes to take the tree up again."""
        return self.chars[self.width :][: len(self.leaves)], self.tokens[self.width :][: len(self.leaves)]

    def _sum_up(self, leaf: int, tokens: int) -> None:
        """A leaf has new pieces and so many more tokens: correct the sums above it."""
        node = self.width + leaf
        chars = sum(map(len, self.leaf(leaf))) - self.chars[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        parts = []
        for k, leaf in enumerate(self.leaves):
            parts += [self.source[self.places[k] : self.places[k] + self.chars[self.width + k]]] if leaf is None else leaf
        return "".join(parts)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def _back(self, leaf: int, k: int) -> tuple[int, int] | None:
        """The piece before piece `k` of a leaf."""
        if k:
            return leaf, k - 1
        while leaf:
            leaf -= 1
            if self.leaf(leaf):
                return leaf, len(self.leaf(leaf)) - 1
        return None

    def edit(self, start: int, stop: int, put: str) -> None:
        """Replace the characters from `start` to `stop` by `put`."""
        start = min(max(start, 0), self.n_chars)
        stop = min(max(stop, start), self.n_chars)
        leaf, before = self.find(start)
        k = 0
        while k < len(self.leaf(leaf)) and before + len(self.leaf(leaf)[k]) <= start:
            before += len(self.leaf(leaf)[k])
            k += 1
        for _ in range(2):
            if (back := self._back(leaf, k)) is None:
                break
            leaf, k = back
            before -= len(self.leaf(leaf)[k])
        # Old pieces from there on, one by one, until all of the edit is in hand and the cuts agree again.
        first, old, old_chars, at = (leaf, k), [], 0, (leaf, k)

        def more() -> bool:
            nonlocal at, old_chars
            leaf, k = at
            while leaf < len(self.leaves) and k >= len(self.leaf(leaf)):
                leaf, k = leaf + 1, 0
            if leaf >= len(self.leaves):
                return False
            old.append(self.leaf(leaf)[k])
            old_chars += len(old[-1])
            at = (leaf, k + 1)
            return True

        while before + old_chars < stop and more():
            pass
        take, ended = 4, False
        while True:
            for _ in range(take):
                if not more():
                    ended = True
                    break
            text = "".join(old)
            new_text = text[: start - before] + put + text[stop - before :]
            pieces = self.cut.findall(new_text)
            if ended:
                break
            # Old cuts behind the edit, as places from the end, with two pieces of what follows in hand to decide them.
            ends, here = {}, 0
            for n in range(len(old) - 1, 0, -1):
                here += len(old[n])
                if len(text) - here < stop - before:
                    break
                if n <= len(old) - 3:
                    ends[here] = n
            here, found = len(new_text), None
            for n, piece in enumerate(pieces):
                if here in ends and here < len(new_text) and here > 0 and len(new_text) - here >= start - before + len(put):
                    found = (n, ends[here])
                    break
                here -= len(piece)
            if found:
                pieces, old = pieces[: found[0]], old[: found[1]]
                break
            take *= 2
        self.encoded += len(pieces)
        # The new pieces go to the first leaf touched; what they replace leaves its own leaf.
        leaf, k, gone = first[0], first[1], len(old)
        tokens = self._tokens_of(pieces)
        head = self.leaf(leaf)
        here = head[k : k + gone]
        head[k : k + gone] = pieces
        self._sum_up(leaf, tokens - self._tokens_of(here))
        gone -= len(here)
        grown = len(head)
        while gone:
            leaf += 1
            here = self.leaf(leaf)[:gone]
            del self.leaf(leaf)[:gone]
            self._sum_up(leaf, -self._tokens_of(here))
            gone -= len(here)
        if grown > 4 * LEAF:
            parts = []
            for k, x in enumerate(self.leaves):
                if x is None or len(x) <= 4 * LEAF:
                    parts.append((x, self.chars[self.width + k], self.tokens[self.width + k], self.places[k]))
                else:
                    parts += [(y, sum(map(len, y)), self._tokens_of(y), 0) for y in (x[n : n + LEAF] for n in range(0, len(x), LEAF))]
            self._grow(parts)


_TREES = "doc_id long, text string, n_pieces long, chars array<int>, tokens array<int>"
_COUNTS = "doc_id long, n_chars long, n_pieces long, n_tokens long, n_edits int, n_encoded long, edited_tokens long, edited_chars long, edited_crc32 long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def build_trees(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, text, n_pieces and the tree, `chars` and `tokens` of its leaves in order, a row for each of `docs`: what a table of token counts keeps."""

    def run(batches):
        cut, counts = cutter(), piece_counts(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = PieceTree(text or "", cut, counts)
                out.append((doc_id, text or "", tree.encoded, *tree.stored()))
            if out:
                yield _batch(_TREES, out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _TREES)


def _edited(trees: DataFrame, edits: Column, tokenizer: str, schema: str, row) -> DataFrame:
    def run(batches):
        cut, counts = cutter(), piece_counts(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, n_pieces, chars, tokens, changes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = PieceTree(text, cut, counts, chars, tokens)
                before, changes = (tree.n_chars, tree.n_tokens), [c for c in changes or () if c is not None]
                for c in changes:
                    tree.edit(c["start"] or 0, c["stop"] or 0, c["put"] or "")
                out.append(row(doc_id, n_pieces, tree, before, len(changes)))
            if out:
                yield _batch(schema, out)

    return trees.select("doc_id", "text", "n_pieces", "chars", "tokens", edits.alias("_edits")).mapInArrow(run, schema)


def edit_trees(trees: DataFrame, edits: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """The table of build_trees() after `edits`, an array of (start, stop, put) for each row, applied in order; n_pieces stays that of the text as first built."""
    return _edited(trees, edits, tokenizer, _TREES, lambda doc_id, n_pieces, tree, _, __: (doc_id, tree.text, n_pieces, *tree.stored()))


def edit_counts(trees: DataFrame, edits: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each of build_trees()'s: its tokens before and after `edits`.

    `n_pieces` are the pre-tokens of the text as built, `n_encoded` those that the edits made encode
    again, `edited_chars` and `edited_crc32` describe the text after.
    """

    def row(doc_id, n_pieces, tree, before, n):
        n_chars, n_tokens = before
        return doc_id, n_chars, n_pieces, n_tokens, n, tree.encoded, tree.n_tokens, tree.n_chars, zlib.crc32(tree.text.encode())

    return _edited(trees, edits, tokenizer, _COUNTS, row)


def count_edits(docs: DataFrame, edits: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """The trees of `docs`, stored, and what `edits`, made of the columns doc_id and text, do to them: the columns of edit_counts()."""
    return edit_counts(Written(build_trees(docs, tokenizer), "trees").df, edits, tokenizer)


def sample_edits() -> Column:
    """Four edits of each document for the query: a word replaced in the middle, two words joined, a header put in front, an end cut off."""
    n = F.length(F.coalesce(F.col("text"), F.lit("")))
    edit = lambda start, stop, put: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), put.cast("string").alias("put"))
    half = F.floor(n / 2)
    space = F.greatest(F.instr(F.coalesce(F.col("text"), F.lit("")), " ") - 1, F.lit(0))
    return F.array(
        edit(half, half + 7, F.concat(F.lit(" revised "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        edit(space, space + 1, F.lit("")),
        edit(F.lit(0), F.lit(0), F.concat(F.lit("["), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("]\n\n"))),
        edit(F.floor(n * 0.97), n + 64, F.lit("'s end")),
    )
