"""Edit-aware token counts against encoding the whole edited text again."""

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.llm.token_counts import PieceCounts, PieceTree, build_trees, cutter, edit_counts, edit_trees, sample_edits
from stowage.llm.tokenizing import WordIds, load
from tests.llm.conftest import documents

CUT, COUNTS = cutter(), PieceCounts("byte_bpe_50k.json")
WHOLE = load("byte_bpe_50k.json")
WHOLE.encode_special_tokens = True


def whole(text: str) -> int:
    return len(WHOLE.encode(text, add_special_tokens=False).ids)


TEXT = st.text(alphabet="ab 'stn\n\té1.!  ", max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 30), TEXT), max_size=5))
def test_edits_agree_with_encoding_again(text, edits):
    tree = PieceTree(text, CUT, COUNTS)
    assert tree.n_tokens == whole(text)
    for start, length, put in edits:
        start = min(start, len(text))
        stop = min(start + length, len(text))
        text = text[:start] + put + text[stop:]
        tree.edit(start, stop, put)
        assert tree.text == text
        assert tree.n_tokens == whole(text)
        assert [x for leaf in tree.leaves for x in leaf] == CUT.findall(text)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 30), TEXT), max_size=4), st.integers(1, 6))
def test_a_stored_tree_is_taken_up_again(text, edits, leaf):
    pieces = CUT.findall(text)
    leaves = [pieces[k : k + leaf] for k in range(0, len(pieces), leaf)] or [[]]
    chars, tokens = [sum(map(len, x)) for x in leaves], [sum(COUNTS[p] for p in x) for x in leaves]
    for start, length, put in edits:
        tree = PieceTree(text, CUT, COUNTS, chars, tokens)
        assert (tree.text, tree.encoded, tree.n_tokens) == (text, 0, whole(text))
        start = min(start, len(text))
        stop = min(start + length, len(text))
        text = text[:start] + put + text[stop:]
        tree.edit(start, stop, put)
        assert (tree.text, tree.n_tokens) == (text, whole(text))
        assert [x for k in range(len(tree.leaves)) for x in tree.leaf(k)] == CUT.findall(text)
        chars, tokens = tree.stored()
        assert (sum(chars), sum(tokens)) == (len(text), whole(text))


def test_an_edit_cuts_only_the_leaves_it_touches():
    text = " ".join(f"word{k}" for k in range(20_000))
    chars, tokens = PieceTree(text, CUT, COUNTS).stored()
    tree = PieceTree(text, CUT, COUNTS, chars, tokens)
    tree.edit(50_000, 50_004, "other words")
    assert sum(x is not None for x in tree.leaves) <= 3
    assert tree.encoded < 30
    assert tree.n_tokens == whole(text[:50_000] + "other words" + text[50_004:])


def test_trees_in_a_table(spark, awkward):
    trees = spark.createDataFrame(build_trees(documents(spark, awkward)).collect(), "doc_id long, text string, n_pieces long, chars array<int>, tokens array<int>")
    got = edit_counts(trees, sample_edits()).collect()
    after = edit_trees(trees, sample_edits()).collect()
    want = Counter((r["doc_id"], whole(r["text"]), zlib.crc32(r["text"].encode())) for r in after)
    assert Counter((r["doc_id"], r["edited_tokens"], r["edited_crc32"]) for r in got) == want
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, whole(t or "")) for i, t, _ in awkward)
    assert all(sum(r["tokens"]) == whole(r["text"]) and sum(r["chars"]) == len(r["text"]) for r in after)


def test_long_text_encodes_only_what_an_edit_touches():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma's", "12", "…"]) for _ in range(20_000))
    tree = PieceTree(text, CUT, COUNTS)
    before = tree.encoded
    for _ in range(200):
        at = rng.randrange(len(text))
        text = text[:at] + "new words here " + text[at + 5 :]
        tree.edit(at, at + 5, "new words here ")
    assert tree.text == text
    assert tree.n_tokens == whole(text)
    assert tree.encoded - before < 200 * 30


@pytest.mark.parametrize("text", ["a\x1cb", "a\x85b c\xa0d", "x​y 　z", "é <|endoftext|> q", "a\x0bb\x0cc", "İstanbul ΣΑΣ ß", "﻿q", "a᠎b", "Word,.; ÀÉß!! don't it's x×y a÷ <|startoftext|>z Ünï...", "ab1 (c) --d-- é"])
def test_words_and_pieces_agree_with_the_library(text):
    ids = WordIds("word_bpe_49k.json")
    want = load("word_bpe_49k.json").encode(text, add_special_tokens=False).ids
    got = ids.text(text.encode())
    assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == want
    assert PieceTree(text, CUT, COUNTS).n_tokens == whole(text)
