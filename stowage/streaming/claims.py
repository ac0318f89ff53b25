"""Streams of claims and of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A claim lasts so long unless it is made again.
CLAIM_TTL, CLAIM_MS = "24 hours", 86_400_000


def latest_claims(claims: DataFrame) -> DataFrame:
    """base, claimed_at and live, in update mode: each base's latest claim as it changes, and once more, no longer live, when it expires; from a stream (base, claimed_at timestamp).

    A base has one state, its latest claim, whatever day that falls on; it is dropped when the watermark is a claim's life behind it.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get[0]
            state.remove()
            yield pd.DataFrame({"base": [key[0]], "claimed_at": [pd.Timestamp(held, unit="us")], "live": [False]})
            return
        held = state.get[0] if state.exists else None
        latest = max([int(b["claimed_at"].max().value) // 1000 for b in batches] + ([] if held is None else [held]))
        state.update((latest,))
        state.setTimeoutTimestamp(max(latest // 1000 + CLAIM_MS, state.getCurrentWatermarkMs() + 1))
        if latest != held:
            yield pd.DataFrame({"base": [key[0]], "claimed_at": [pd.Timestamp(latest, unit="us")], "live": [True]})

    rows = claims.select("base", "claimed_at").withWatermark("claimed_at", "0 seconds")
    return rows.groupBy("base").applyInPandasWithState(keep, "base string, claimed_at timestamp, live boolean", "latest long", "update", GroupStateTimeout.EventTimeTimeout)


def once_per_claim(claims: DataFrame) -> DataFrame:
    """Claims without repeats, however late within a claim's life."""
    return claims.withWatermark("claimed_at", CLAIM_TTL).dropDuplicatesWithinWatermark(["base", "claimed_at"])


def completed_files(chunks: DataFrame) -> DataFrame:
    """manifest_key and n_chunks once all chunks of a file have landed in any order, from a stream (manifest_key, chunk_index, num_chunks, landed_at timestamp).

    A file's state is a bit for each chunk. It is dropped when no chunk has landed for a claim's life, whether the file is complete or was given up.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bits, wanted, done, last = state.get if state.exists else (b"", 0, False, 0)
        seen = int.from_bytes(bits, "little")
        for batch in batches:
            for k in batch["chunk_index"]:
                seen |= 1 << int(k)
            wanted = int(batch["num_chunks"].max())
            last = max(last, int(batch["landed_at"].max().value) // 1_000_000)
        complete = bool(wanted) and seen & (1 << wanted) - 1 == (1 << wanted) - 1
        if complete and not done:
            yield pd.DataFrame({"manifest_key": [key[0]], "n_chunks": [wanted]})
        # A complete file needs no bits any more.
        state.update((b"" if complete or done else seen.to_bytes(-(-seen.bit_length() // 8), "little"), wanted, complete or done, last))
        state.setTimeoutTimestamp(max(last + CLAIM_MS, state.getCurrentWatermarkMs() + 1))

    rows = chunks.select("manifest_key", "chunk_index", "num_chunks", "landed_at").withWatermark("landed_at", "0 seconds")
    return rows.groupBy("manifest_key").applyInPandasWithState(count, "manifest_key string, n_chunks long", "bits binary, wanted long, done boolean, last long", "append", GroupStateTimeout.EventTimeTimeout)
