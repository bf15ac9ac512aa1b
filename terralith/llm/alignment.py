"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Tokens of A and B are the two sides of a graph, joined where their byte ranges overlap. Its connected components,
found by union-find, are exactly the smallest groups of A and B tokens that cover the same bytes. The members of a
component give its links: the pairs of an A and a B token that end at the same byte. As a component is cut wherever
both end, that is its last A and its last B token, so a document has as many links as groups.

Work: one pass over the texts, in blocks of BLOCK_BYTES of text, gives each document's groups and each block's
different pairs with their counts. Pairs are counted over all blocks, so that a common pair is one row a block, and
blocks ask for the counts of their own pairs; nothing but the best count of each B id (VOCABULARY rows at most)
is broadcast. Each document's sums are made where its block's answers meet its documents.

Cases: a null or empty text, and one whose tokens do not spell it (U+2581 in it, for one), has no tokens: zeros, and
'' for the checksum. Very long texts are blocks of their own, and a task holds some hundred bytes for each of their tokens.
Ties for the best count all count as best. Repeated rows and null ids are counted and returned row by row. An empty table
gives an empty table. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, give_back
from .packing import BYTE_SIGNS

#: Bytes of text whose pairs are counted together, and bytes whose tokens are held at once.
BLOCK_BYTES, BATCH_BYTES = 8 << 20, 1 << 20
#: Ids of each vocabulary at most; with the pairs as A id * VOCABULARY + B id this also bounds what is broadcast.
VOCABULARY = 1 << 20
#: Fixed value: the pattern that cuts text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DOC_SCHEMA = "block long, of_block boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, pairs binary, times binary"
_DOC_ARROW = pa.schema([("block", pa.int64()), ("of_block", pa.bool_()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int64()), ("pairs", pa.binary()), ("times", pa.binary())])
OUT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteLevel:
    """Side A: a byte-level BPE file. Its merges are run by tiktoken where ids are ranks (checked on load), else by the file's own library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        rules = json.loads(self.slow.to_str())
        vocab, special = rules["model"]["vocab"], {t["content"] for t in rules["added_tokens"]}
        byte_of = {sign: b for b, sign in enumerate(chr(b) if b not in BYTE_SIGNS else BYTE_SIGNS[b] for b in range(256))}
        spelled = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t not in special}
        self.bytes = [spelled.get(i, b"") for i in range(max(spelled, default=-1) + 2)]
        before, model = rules["pre_tokenizer"] or {}, rules["model"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" ", 1))] for m in model["merges"]]
        as_ranks = (
            rules["normalizer"] is None
            and (before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) == ("ByteLevel", True, False)
            and not model.get("dropout")
            and made == sorted(set(made))
            and all(len(spelled[i]) == 1 for i in set(spelled) - set(made))
        )
        self.fast = None
        self.spells_all = as_ranks and len({b for b in spelled.values() if len(b) == 1}) == 256  # ids of any text then spell it
        if as_ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in spelled.items()}, special_tokens={})
        self.long_gap = re.compile(r"\s{1000}")  # beyond the stack of the faster library's pattern

    def encode(self, text: str) -> np.ndarray:
        """Ids of a space and the text."""
        if self.fast is None or self.long_gap.search(text):
            return np.array(self.slow.encode(" " + text, add_special_tokens=False).ids, np.int32)
        return np.array(self.fast.encode_ordinary(" " + text), np.int32)


class Pieces:
    """Side B: a sentencepiece file, which adds a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(m.get_piece_size()):
            name = m.id_to_piece(i)
            self.bytes.append(bytes([int(name[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else name.replace("▁", " ").encode())

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int32)


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over many edges at once: the smallest node of each node's component."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:  # paths to their roots
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def groups_of(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token, numbered along the bytes, from the ends of two ways to cut the same bytes."""
    n_a = len(end_a)
    start_a, start_b = np.r_[0, end_a[:-1]], np.r_[0, end_b[:-1]]
    first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    count = last - first
    u = np.repeat(np.arange(n_a), count)
    v = np.arange(len(u)) - np.repeat(np.cumsum(count) - count - first, count)
    root = components(n_a + len(end_b), u, n_a + v)
    number = np.cumsum(root[:n_a] == np.arange(n_a)) - 1
    return number, number[root[n_a:]]


@lru_cache(maxsize=1)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One for each worker: loading takes longer than a small block."""
    return Aligner(a_path, b_path)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        if max(len(self.a.bytes), len(self.b.bytes)) > VOCABULARY:
            raise ValueError(f"more than {VOCABULARY} ids")
        self.spelled = [pa.array(x.bytes, pa.large_binary()) for x in (self.a, self.b)]
        self.length = [np.array([len(t) for t in x.bytes], np.int64) for x in (self.a, self.b)]
        self.signs = pa.array([f"{i}{s}" for i in range(max(len(self.a.bytes), len(self.b.bytes))) for s in ",|;"], pa.large_binary())

    def _spells(self, side: int, ids: np.ndarray, raw: bytes) -> bool:
        if self.length[side][ids].sum() != len(raw):
            return False
        taken = self.spelled[side].take(pa.array(ids))
        return taken.buffers()[2].slice(0, len(raw)).equals(pa.py_buffer(raw))

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int32)
        if not text:
            return none, none
        a, b, raw = self.a.encode(text), self.b.encode(text), b" " + text.encode()
        return (a, b) if (self.a.spells_all or self._spells(0, a, raw)) and self._spells(1, b, raw) else (none, none)

    def align(self, texts: list[str | None]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        """Columns of the documents, and the pair and the document of each link."""
        both = [self.tokens(t) for t in texts]
        a, b = (np.concatenate([x[k] for x in both] or [np.zeros(0, np.int32)]).astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
        # documents follow each other, and both sides end with each of them
        in_a, in_b = groups_of(np.cumsum(self.length[0][a]), np.cumsum(self.length[1][b])) if len(a) else (a, b)
        last_a, last_b = np.flatnonzero(np.diff(in_a, append=-1)), np.flatnonzero(np.diff(in_b, append=-1))
        pairs = a[last_a] * VOCABULARY + b[last_b]
        doc = np.repeat(np.arange(len(texts)), n_a)[last_a]
        n_groups = np.bincount(doc, minlength=len(texts))
        # a1,a2|b1;a3|b2,b3 of all documents, one after another
        which = np.lexsort((np.r_[np.zeros(len(a), np.int8), np.ones(len(b), np.int8)], np.r_[in_a, in_b]))
        sign = np.zeros(len(a) + len(b), np.int64)
        sign[last_a], sign[len(a) + last_b] = 1, 2
        written = self.signs.take(pa.array((np.r_[a, b] * 3 + sign)[which]))
        ends = np.frombuffer(written.buffers()[1], np.int64, len(written) + 1) if len(written) else np.zeros(1, np.int64)
        data = memoryview(written.buffers()[2] if len(written) else b"").cast("B")
        at = ends[np.r_[0, np.cumsum(n_a + n_b)]]
        sha = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_groups, "groups_sha256": sha}, pairs, doc


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(numbers).tobytes(), codec="zstd", asbytes=True) if len(numbers) else b""


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64) if n else np.zeros(0, np.int64)


def _block(number: int, ids: list, found: list[dict], pairs: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the block's documents, whose pairs are places among the block's different pairs, and the block's own row with these."""
    known, place, count = np.unique(pairs, return_inverse=True, return_counts=True)
    own, times = np.unique(doc * max(1, len(known)) + place, return_counts=True)
    of, at = own // max(1, len(known)), own % max(1, len(known))
    to = np.searchsorted(of, np.arange(len(ids) + 1))
    columns = {c: np.concatenate([f[c] for f in found]) if c != "groups_sha256" else [s for f in found for s in f[c]] for c in found[0]} if found else {}
    n = len(ids)
    data = [
        [number] * (n + 1),
        [False] * n + [True],
        [*ids, None],
        *[[*map(int, columns.get(c, [])), 0] for c in ("n_a", "n_b", "n_groups", "n_links")],
        [*columns.get("groups_sha256", []), ""],
        [*np.diff(to).tolist(), len(known)],
        [_packed(np.diff(at[x:y], prepend=0)) for x, y in zip(to[:-1], to[1:], strict=True)] + [_packed(np.diff(known, prepend=0))],
        [_packed(times[x:y].astype(np.int64)) for x, y in zip(to[:-1], to[1:], strict=True)] + [_packed(count.astype(np.int64))],
    ]
    yield pa.RecordBatch.from_arrays([pa.array(d, f.type) for d, f in zip(data, _DOC_ARROW, strict=True)], schema=_DOC_ARROW)


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """DOC_SCHEMA: the documents of each block, and one row for the block with its different pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = aligner_of(a_path, b_path), TaskContext.get().partitionId()
        made, held = 0, ([], [], [], [])
        bytes_, waiting, ids, rows = 0, [], [], 0

        def flush():
            nonlocal waiting, ids, rows
            if ids:
                columns, pairs, doc = aligner.align(waiting)
                held[0].extend(ids)
                held[1].append(columns)
                held[2].append(pairs)
                held[3].append(doc + len(held[0]) - len(ids))
            waiting, ids, rows = [], [], 0

        def block():
            nonlocal made, held, bytes_
            flush()
            number = (part << 33) + made
            made, full, held, bytes_ = made + 1, held, ([], [], [], []), 0
            return _block(number, full[0], full[1], np.concatenate(full[2]), np.concatenate(full[3]))

        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = text.as_py()
                    size = len(text or "")
                    if ids and rows + size > BATCH_BYTES:
                        flush()
                    if held[0] and bytes_ + size > block_bytes:
                        yield from block()
                    waiting.append(text)
                    ids.append(doc_id)
                    rows, bytes_ = rows + size + 64, bytes_ + size + 64
            if ids or held[0]:
                yield from block()
        finally:
            give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, DOC_SCHEMA)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pair, n) of the blocks' own rows."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs, n = np.cumsum(_unpacked(row["pairs"], row["n_pairs"])), _unpacked(row["times"], row["n_pairs"])
            for at in range(0, len(pairs), 65_536):
                some = slice(at, at + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs[some]), row["block"])), pa.array(pairs[some]), pa.array(n[some])], names=["block", "pair", "n"])


def _sums(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
    """One block: its documents' sums over the counts of its pairs, which come in any order but are all there."""
    order = np.argsort(answers.column("pair").to_numpy())
    n, best = answers.column("total").to_numpy()[order], answers.column("best").to_numpy(zero_copy_only=False).astype(bool)[order]
    n_best, count_sum = [], []
    for k, raw, raw_times in zip(docs.column("n_pairs").to_pylist(), docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
        at, times = np.cumsum(_unpacked(raw, k)), _unpacked(raw_times, k)
        n_best.append(int(times[best[at]].sum()) if k else 0)
        count_sum.append(int((times * n[at]).sum()) if k else 0)
    columns = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups_sha256")], names=[x.split()[0] for x in OUT_SCHEMA.split(", ")])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, total, best): how many links of the whole corpus hold a pair of ids, and whether that is its B id's highest count."""
    return _counted(_asked(blocks)).select(F.expr(f"pair div {VOCABULARY}").alias("a"), (F.col("pair") % VOCABULARY).alias("b"), "total", "best")


def _asked(blocks: DataFrame) -> DataFrame:
    return blocks.filter("of_block").select("block", "n_pairs", "pairs", "times").mapInArrow(_spread, "block long, pair long, n long")


def _counted(asked: DataFrame) -> DataFrame:
    total = asked.groupBy("pair").agg(F.sum("n").alias("total"))
    highest = total.groupBy((F.col("pair") % VOCABULARY).alias("b")).agg(F.max("total").alias("highest"))  # one row for each B id
    return total.join(F.broadcast(highest), F.col("pair") % VOCABULARY == F.col("b")).select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """OUT_SCHEMA, a row for each document."""
    blocks = checkpoint(aligned_blocks(docs, a_path, b_path, id_col, text_col, block_bytes))
    asked = _asked(blocks)
    answers = asked.select("block", "pair").join(_counted(asked), "pair").select("block", "pair", "total", "best")
    own = blocks.filter("not of_block").drop("of_block")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sums, OUT_SCHEMA)
