"""Substring de-duplication with fixed-block anchors.

Every document is indexed by its non-overlapping blocks of half a window's words, and probed with every rolling
window of that length. Any repeated run of a whole window holds one full block of the earlier document, so
that a block met in two documents marks all places from which a run can be extended. Around these places the
full windows are compared across documents; a window that a document of smaller id has too is a repeat, and
joined repeats form maximal runs.

Probes travel packed: a task sends, for each part of the hash range, the hashes of many documents' windows in
one row, with their places as gaps. A probe so costs some six bytes instead of a row. Both exchanges are dealt
by parts of the hash, so that a passage that many documents share adds places to a part, not pairs.

Hashes only propose at the first exchange (32 bits and the part). At the second they are 64-bit hashes of the
window's words; equality of these is taken as equality of the words.

A document is known by a 64-bit hash of its id and text: places come back by it, and ids travel only to the second
exchange, which orders by them.

Cases: a null text has no words. Documents shorter than a window are kept whole. Rows that repeat an id are
each judged by their own text, against smaller ids only. A null id counts as the largest id, and stays null. Very long
texts are probed whole. Empty tables give empty tables. Only the id and the text are read, whatever other columns are named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, partitions, slices, window_hashes, word_hashes

WINDOW = 50
#: Bytes of text whose probes make one part of the hash range: a part is unpacked in one task.
PART_TEXT = 32 << 20
NO_ID = 2**63 - 1
PACKED = "part int, keys binary, ids binary, counts binary, gaps binary, hashes binary, wide int"
PLACES = "key long, places binary"
_PACKED = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary()), ("hashes", pa.binary()), ("wide", pa.int32())])
_PLACES = pa.schema([("key", pa.int64()), ("places", pa.binary())])


def pack(part: np.ndarray, parts: int, keys: np.ndarray, ids: np.ndarray | None, owner: np.ndarray, place: np.ndarray, payload: np.ndarray) -> Iterator[tuple]:
    """Rows of PACKED for places of documents (owner: index into keys and, if they travel, ids, ascending; place ascending within an owner)."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        rows = order[bounds[p] : bounds[p + 1]]
        own, at = owner[rows], place[rows]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        gap = np.diff(at, prepend=0)
        gap[first] = at[first]
        wide = 1 if gap.max() < 256 else 2 if gap.max() < 65536 else 8
        count = np.diff(np.r_[first, len(rows)])
        yield int(p), keys[own[first]].astype("<i8").tobytes(), b"" if ids is None else ids[own[first]].astype("<i8").tobytes(), count.astype("<u4").tobytes(), gap.astype(f"<u{wide}").tobytes(), payload[rows].tobytes(), wide


def pack_probes(keys: np.ndarray, ids: np.ndarray | None, owner: np.ndarray, place: np.ndarray, hashes: np.ndarray, parts: int, bits: int) -> Iterator[tuple]:
    """Probes, dealt by their upper bits; the payload is the lower 32 bits or the whole hash."""
    part = ((hashes >> U64(32)) % U64(parts)).astype(np.int64)
    return pack(part, parts, keys, ids, owner, place, (hashes & U64(0xFFFFFFFF)).astype("<u4") if bits == 32 else hashes)


def pack_places(doc: np.ndarray, place: np.ndarray, parts: int) -> Iterator[tuple]:
    """Places, dealt by their document, without a payload."""
    order = np.lexsort((place, doc))
    keys, owner = np.unique(doc[order], return_inverse=True)
    part = (mix(keys.view(U64)) % U64(parts)).astype(np.int64)
    return pack(part[owner], parts, keys, None, owner, place[order], np.zeros(len(doc), dtype="V0"))


def unpack(table: pa.Table, payload: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key and id (the key again where ids do not travel) of the document, place and payload of everything in the rows."""
    docs, named, places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, payload or "<u4")]
    for keys, ids, counts, gaps, h, wide in zip(*(table.column(c).to_pylist() for c in ("keys", "ids", "counts", "gaps", "hashes", "wide")), strict=True):
        count = np.frombuffer(counts, "<u4").astype(np.int64)
        total = np.cumsum(np.frombuffer(gaps, f"<u{wide}").astype(np.int64))
        first = np.cumsum(count) - count
        before = np.where(first > 0, total[first - 1], 0)
        docs.append(np.repeat(np.frombuffer(keys, "<i8"), count))
        named.append(np.repeat(np.frombuffer(ids or keys, "<i8"), count))
        places.append(total - np.repeat(before, count))
        if payload:
            hashes.append(np.frombuffer(h, payload))
    return np.concatenate(docs), np.concatenate(named), np.concatenate(places), np.concatenate(hashes)


def rows_of_places(doc: np.ndarray, place: np.ndarray) -> pa.Table:
    """One row for each document, with its places (little-endian, 32 bits each)."""
    order = np.argsort(doc, kind="stable")
    doc, place = doc[order], place[order].astype("<u4")
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    cut = np.split(place, first[1:]) if len(doc) else []
    return pa.table([pa.array(doc[first], pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())], schema=_PLACES)


def met_in_two(doc: np.ndarray, place: np.ndarray, hashes: np.ndarray, block: int) -> np.ndarray:
    """Which probes equal an indexed block (a place divisible by its length) and occur in two documents at least."""
    index = np.unique(hashes[place % block == 0])
    at = np.searchsorted(index, hashes)
    found = np.flatnonzero(index[np.minimum(at, len(index) - 1)] == hashes) if len(index) else np.zeros(0, np.int64)
    key = at[found]
    low, high = np.full(len(index), NO_ID, np.int64), np.full(len(index), -(2**63), np.int64)
    np.minimum.at(low, key, doc[found])
    np.maximum.at(high, key, doc[found])
    return found[low[key] < high[key]]


def in_smaller(doc: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which windows occur in a document of smaller id."""
    known, key = np.unique(hashes, return_inverse=True)
    low = np.full(len(known), NO_ID, np.int64)
    np.minimum.at(low, key, doc)
    return np.flatnonzero(doc > low[key])


def exchange(packed: DataFrame, judge: Callable[..., np.ndarray], bits: int, parts: int) -> DataFrame:
    """Brings each part's probes together; (key, places): the places of each document that the judge picks."""

    def decide(table: pa.Table) -> pa.Table:
        doc, named, place, hashes = unpack(table, "<u4" if bits == 32 else "<u8")
        kept = judge(named, place, hashes)
        rows = list(pack_places(doc[kept], place[kept], parts))
        return pa.Table.from_batches([_batch(rows, _PACKED)] if rows else [], schema=_PACKED)

    def gather(table: pa.Table) -> pa.Table:
        doc, _, place, _ = unpack(table, None)
        return rows_of_places(doc, place)

    return packed.groupBy("part").applyInArrow(decide, PACKED).groupBy("part").applyInArrow(gather, PLACES)


def _places(found: bytes | None) -> np.ndarray:
    return np.unique(np.frombuffer(found, "<u4").astype(np.int64)) if found else np.zeros(0, np.int64)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words in windows that begin at these places."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + window, n), -1)
    return np.cumsum(steps[:n]) > 0


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, text and `places`: the packed first words of the windows that a document of smaller id has too (null: none)."""
    block = window // 2
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), -(-size // PART_TEXT))
    own = F.col(id_col).cast("long")
    known = F.coalesce("own", F.lit(NO_ID)).alias("doc_id")
    slim = docs.select(F.col(text_col).cast("string").alias("text"), own.alias("own"))
    # both joins below take the same three columns, so that the texts are shuffled once
    slim = slim.select("text", F.xxhash64(F.col("own").isNull(), known, "text").alias("key"), "own")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8 << 20):
            bounds, words = word_hashes(batch.column(1))
            hashes = window_hashes(words, block)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))[: len(hashes)]
            place = np.arange(len(hashes)) - bounds[owner]
            inside = bounds[owner + 1] - bounds[owner] - place >= block
            rows = list(pack_probes(batch.column(2).to_numpy(zero_copy_only=False), None, owner[inside], place[inside], hashes[inside], parts, 32))
            if rows:
                yield _batch(rows, _PACKED)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8 << 20):
            bounds, words = word_hashes(batch.column(1))
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 3))
            owners, places, hashes = [], [], []
            for i, found in enumerate(batch.column(2).to_pylist()):
                mine = words[bounds[i] : bounds[i + 1]]
                if len(mine) < window:
                    continue
                hit = _places(found)
                lo, hi = np.maximum(hit + block - window, 0), np.minimum(hit, len(mine) - window)  # windows that hold the block
                steps = np.zeros(len(mine) + 2, dtype=np.int64)
                ok = lo <= hi
                np.add.at(steps, lo[ok], 1)
                np.add.at(steps, hi[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(steps) > 0)
                if len(at):
                    owners.append(np.full(len(at), i))
                    places.append(at)
                    hashes.append(window_hashes(mine, window)[at])
            if owners:
                rows = list(pack_probes(keys, ids, np.concatenate(owners), np.concatenate(places), np.concatenate(hashes), parts, 64))
                yield _batch(rows, _PACKED)

    anchors = exchange(slim.select(known, "text", "key").mapInArrow(probe, PACKED), lambda d, p, h: met_in_two(d, p, h, block), 32, parts)
    around = slim.join(anchors, "key").select(known, "text", "places", "key").mapInArrow(candidates, PACKED)
    flagged = exchange(around, in_smaller, 64, parts)
    return slim.join(flagged, "key", "left").select(F.col("own").alias("doc_id"), "text", "places")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and runs: the maximal repeated runs [first word, words]."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for key, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                gone = covered(len(words), _places(found), window)
                edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if found else b" ".join(words)
                rows.append((key, len(words), int(gone.sum()), kept.decode("utf-8", "surrogatepass"), [[int(a), int(b - a)] for a, b in zip(edge[::2], edge[1::2], strict=True)]))
            yield _batch(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("runs", pa.list_(pa.list_(pa.int64())))])
    return repeats(docs, id_col=id_col, text_col=text_col, window=window).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, runs array<array<long>>")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
