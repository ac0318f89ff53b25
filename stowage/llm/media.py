"""Media columns in a store of content-defined chunks.

A payload is cut where a rolling gear hash of its bytes meets a mask, so that equal passages give
equal chunks wherever they stand. Chunk digests are deduplicated by Spark joins:

1. A scan gives each payload's ordered chunk list (digests and lengths), no bytes.
2. Digests met once stay with their payload; of one met again, the first payload in order of
   (payload digest, index) writes it to the shared chunks, and the others refer to it.
3. Payloads, each once and compressed, meet their part of that decision and are written as packs:
   the ordered chunk list and the bytes that are only theirs, compressed.
4. Packs are read back. Those with shared chunks fetch them by digest; the others need no shuffle.
   Every chunk and every payload is verified by digest before anything is computed from it.

The stored form of a medium, which media_bytes and media_sha256 describe, are the bytes in the store
that it is rebuilt from, in this order: its pack's chunk list, its pack's own samples (compressed) and
the shared chunks that the list refers to (compressed, in the order of the list).

Defined results: a null text is empty, and an empty payload is one frame of padding; equal texts are
one medium; rows are matched to media by payload digest, so repeated doc_ids do no harm; a text of any
length is one payload, held whole by one task; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import Written

#: Payloads are padded by PAD to a multiple of FRAME samples.
FRAME, PAD = 576, b"\xff"
#: Bounds of a chunk in bytes, and the mask that a cut's hash meets: 2 KB beyond the least on average.
LEAST, MOST, MASK = 1024, 8192, np.uint32(0x7FF)
#: Seed of the table of the gear hash.
GEAR_SEED = 20240229
#: Where a chunk's bytes are: in the pack, in the shared chunks by this payload, in the shared chunks by another.
OWN, GIVEN, TAKEN = 0, 1, 2


def _gear() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(GEAR_SEED)).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: bytes | None) -> bytes:
    """The samples of a text: its bytes, padded to a positive multiple of FRAME."""
    text = text or b""
    return text.ljust(max(1, -(-len(text) // FRAME)) * FRAME, PAD)


def cuts(payload: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks. The hash of a place covers the 32 bytes up to it."""
    if len(payload) <= LEAST:
        return [len(payload)]
    h = gear[np.frombuffer(payload, dtype=np.uint8)]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    ends, at = [], 0
    for end in (np.flatnonzero((h >> np.uint32(20)) & MASK == 0) + 1).tolist():
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end - at >= LEAST:
            at = end
            ends.append(at)
    while len(payload) - at > MOST:
        at += MOST
        ends.append(at)
    if at < len(payload):
        ends.append(len(payload))
    return ends


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunks_of(payload: bytes, gear: np.ndarray) -> list[bytes]:
    ends = cuts(payload, gear)
    return [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _table(schema: str, columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def chunk_lists(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload (its SHA-256) and digests, the ordered chunk list, a row for each of `docs`."""
    schema = "doc_id long, n_bytes long, payload binary, digests array<binary>"

    def run(batches):
        gear = _gear()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = payload_of(text)
                out.append((doc_id, len(text or b""), hashlib.sha256(payload).digest(), [digest(c) for c in chunks_of(payload, gear)]))
            if out:
                yield _table(schema, zip(*out, strict=True))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _distinct_payloads(docs: DataFrame) -> DataFrame:
    """payload and packed, the compressed text, for each distinct payload."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                payload = payload_of(text)
                out.append((hashlib.sha256(payload).digest(), zlib.compress(payload, 6)))
            if out:
                yield _table("payload binary, packed binary", zip(*out, strict=True))

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "payload binary, packed binary").groupBy("payload").agg(F.first("packed").alias("packed"))


def _shared(lists: DataFrame) -> DataFrame:
    """payload, given, taken: the places in its list of the shared chunks that it writes and of those that another does."""
    chunks = lists.select("payload", "digests").dropDuplicates(["payload"]).select("payload", F.posexplode("digests").alias("place", "digest"))
    chunks = Written(chunks, "chunks")
    owners = chunks.df.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("payload", "place")).alias("owner")).where("n > 1").select("digest", "owner")
    owners = Written(owners, "chunk-owners").df
    met = chunks.df.join(owners, "digest").withColumn("mine", F.struct("payload", "place") == F.col("owner"))
    found = met.groupBy("payload").agg(F.collect_list(F.when(F.col("mine"), F.col("place"))).alias("given"), F.collect_list(F.when(~F.col("mine"), F.col("place"))).alias("taken"))
    found = Written(found, "chunks-shared").df
    chunks.drop()
    return found


#: kind 0, a pack: key is its payload's digest, `list` its chunk list, `taken` the digests of its shared chunks, data its own chunks. kind 1, a shared chunk: key is its digest.
_STORE = "kind int, key binary, list binary, taken array<binary>, data binary"
#: Bytes of an entry of a chunk list: digest, length, place.
_ENTRY = 21


def pack_list(entries: list[tuple[bytes, int, int]]) -> bytes:
    """A chunk list (digest, length, place) as it is stored."""
    return b"".join(d + n.to_bytes(4, "little") + bytes([place]) for d, n, place in entries)


def unpack_list(packed: bytes) -> list[tuple[bytes, int, int]]:
    return [(packed[k : k + 16], int.from_bytes(packed[k + 16 : k + 20], "little"), packed[k + 20]) for k in range(0, len(packed), _ENTRY)]


def _store(payloads: DataFrame) -> DataFrame:
    """Packs and shared chunks of payloads (payload, packed, given, taken)."""

    def run(batches):
        gear = _gear()
        for batch in batches:
            out, held = [], 0
            for key, packed, given, taken in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = chunks_of(zlib.decompress(packed), gear)
                where = [OWN] * len(parts)
                for kind, places in ((GIVEN, given), (TAKEN, taken)):
                    for k in places or ():
                        where[k] = kind
                digests = [digest(c) for c in parts]
                own = zlib.compress(b"".join(c for c, w in zip(parts, where, strict=True) if w == OWN), 6)
                out.append((0, key, pack_list(list(zip(digests, map(len, parts), where, strict=True))), [d for d, w in zip(digests, where, strict=True) if w != OWN], own))
                out += [(1, d, None, None, zlib.compress(c, 6)) for c, w, d in zip(parts, where, digests, strict=True) if w == GIVEN]
                held += len(packed)
                if held > 8_000_000:
                    yield _table(_STORE, zip(*out, strict=True))
                    out, held = [], 0
            if out:
                yield _table(_STORE, zip(*out, strict=True))

    return payloads.select("payload", "packed", "given", "taken").mapInArrow(run, _STORE)


def feature_of(payload: bytes, n_chunks: int) -> str:
    """Chunks, mean and entropy of the samples."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    mean = int((counts * np.arange(256)).sum()) / len(payload)
    return f"chunks={n_chunks};mean={mean:.6f};entropy={float(-(p * np.log2(p)).sum()):.6f}"


_MEDIA = "payload binary, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _restore(packs: DataFrame) -> DataFrame:
    """What each pack holds: rebuilt from its list, its own bytes and the shared chunks (digest, data) that it refers to; verified."""

    def run(batches):
        for batch in batches:
            out = []
            for key, listed, data, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shared = {x["digest"]: x["data"] for x in others or ()}
                own, at, parts, entries = zlib.decompress(data), 0, [], unpack_list(listed)
                media, media_bytes = hashlib.sha256(listed + data), len(listed) + len(data)
                for d, n, place in entries:
                    if place == OWN:
                        part, at = own[at : at + n], at + n
                    else:
                        part = zlib.decompress(shared[d])
                        media.update(shared[d])
                        media_bytes += len(shared[d])
                    if len(part) != n or digest(part) != d:
                        raise ValueError(f"chunk {d.hex()} of payload {key.hex()} is damaged")
                    parts.append(part)
                payload = b"".join(parts)
                if hashlib.sha256(payload).digest() != key:
                    raise ValueError(f"payload {key.hex()} is damaged")
                out.append((key, len(payload), zlib.crc32(payload[-32:]), media_bytes, media.hexdigest(), feature_of(payload, len(entries))))
            if out:
                yield _table(_MEDIA, zip(*out, strict=True))

    return packs.select("key", "list", "data", "others").mapInArrow(run, _MEDIA)


def store_media(docs: DataFrame) -> tuple[DataFrame, Written]:
    """Write the media of `docs`. The chunk lists of its rows, and the store."""
    lists = Written(chunk_lists(docs), "chunk-lists").df
    shared = _shared(lists)
    payloads = _distinct_payloads(docs).join(shared, "payload", "left")
    return lists, Written(_store(payloads), "media", codec="none")


def read_media(store: DataFrame) -> DataFrame:
    """What is computed from each stored medium, by payload digest."""
    packs = store.where("kind = 0").select("key", "list", "taken", "data")
    nothing = F.lit(None).cast("array<struct<digest: binary, data: binary>>").alias("others")
    alone = packs.where("size(taken) = 0").select("*", nothing)
    # The shared places of a list that this pack has written itself are read back like any other's.
    wanted = packs.where("size(taken) > 0").select("key", F.explode(F.array_distinct("taken")).alias("digest"))
    chunks = store.where("kind = 1").select(F.col("key").alias("digest"), "data")
    others = wanted.join(chunks, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "data")).alias("others"))
    return _restore(alone.unionByName(packs.where("size(taken) > 0").join(others, "key")))


def media_table(docs: DataFrame) -> DataFrame:
    """The digest columns, a row for each of `docs`, from the media as read back."""
    lists, store = store_media(docs)
    media = Written(read_media(store.df), "media-read").df
    rows = lists.select("doc_id", "n_bytes", "payload").join(media, "payload")
    return rows.select("doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload")).alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature")
