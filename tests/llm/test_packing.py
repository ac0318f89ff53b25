"""Packing: every item once, no overlap, no gap, close to the bound."""

from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.llm.packing import plan_bins


def layout(counts, capacity):
    bins = defaultdict(list)
    for length, rank, items, first, each, offset in plan_bins(counts, capacity):
        for n in range(items):
            bins[first + n // each].append((offset + n % each * length, length, rank + n))
    return bins


def check(counts, capacity):
    bins, seen = layout(counts, capacity), defaultdict(set)
    for items in bins.values():
        at = 0
        for offset, length, rank in sorted(items):
            assert offset == at
            at += length
            assert rank not in seen[length]
            seen[length].add(rank)
        assert at <= capacity
    assert {n: c for n, c in counts.items() if c} == {n: len(x) for n, x in seen.items()}
    assert all(x == set(range(len(x))) for x in seen.values())
    assert sorted(bins) == list(range(len(bins)))
    return bins


def best_fit(counts, capacity):
    """Plain best fit, longest first, one item at a time."""
    gaps = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [k for k, g in enumerate(gaps) if g >= n]
            if fits:
                gaps[min(fits, key=lambda k: gaps[k])] -= n
            else:
                gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 9), max_size=12))
def test_every_item_is_packed_once(counts):
    bins = check(counts, 30)
    assert len(bins) >= -(-sum(n * c for n, c in counts.items()) // 30)
    assert len(bins) <= best_fit(counts, 30) * 1.2 + 1


def test_large_items_pair_as_often_as_they_can():
    assert len(check({6: 3, 4: 3}, 10)) == 3
    assert len(check({7: 1, 6: 1, 4: 1, 3: 1}, 10)) == 2
    assert len(check({4: 5}, 11)) == 3
    assert check({}, 10) == {}


def test_millions_of_items_take_few_runs():
    counts = {n: 1_000_003 + n for n in range(1, 2049)}
    runs = plan_bins(counts, 2048)
    assert len(runs) < 20_000
    used = max(first + -(-items // each) for _, _, items, first, each, _ in runs)
    assert used <= 1.01 * sum(n * c for n, c in counts.items()) / 2048 + 1
