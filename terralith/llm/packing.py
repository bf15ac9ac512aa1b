"""Packing by power-of-two decomposition.

A document of n tokens is cut into floor(n / most) pieces of `most` tokens and one piece for each bit of the
rest, longest first. Pieces of equal length form a bucket; a piece is a sequence of its own, so that none
crosses documents and none is padded. Tasks give their pieces bucket by bucket, and write_buckets lays them out as
one folder a bucket. No shuffle is needed: each document's cut depends on that document alone.

Tokens: where the vocabulary's own rules (checked on load) never join characters across white space, a text's
ids are those of its white-space-free runs, one after another, and each run's ids are looked up once per batch.
With any other vocabulary whole texts are encoded.

Cases: a null text counts as empty and gives one piece, the end id. Very long texts are encoded alone. Ties and
repeated rows: each row is cut by itself; null ids stay null. An empty table gives an empty table. Columns other than
the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, split_words

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
END_ID = 2
MOST = 4096
#: Bytes of one generation of a worker's table of ids (two are kept), each run counted with what Python holds for it; it bounds memory and changes no result.
KEPT_BYTES, RUN_BYTES = 32 << 20, 160
#: Bytes of text that are encoded at once; a longer text comes alone. A step takes some 40 times as much for its words, their numbers and their ids (measured: 40 MB for 1 MB, 92 MB for 4 MB).
STEP_BYTES = 1 << 20
#: The rules under which a text's ids are those of its runs.
RUN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
RUN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_signs() -> dict[int, str]:
    """Byte-level vocabularies write a byte as its Latin-1 character where that is visible, and as the next one from 256 on where not."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_SIGNS = _byte_signs()


def piece_lengths(n: int, most: int = MOST) -> list[int]:
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces_of(n: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """piece_lengths of many documents: the document of each piece and its length, in the order of the tokens."""
    bits = most.bit_length() - 1
    set_ = (n[:, None] >> np.arange(bits - 1, -1, -1)) & 1  # of the rest, longest first
    count = n // most + set_.sum(axis=1)
    doc = np.repeat(np.arange(len(n)), count)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.full(len(doc), most, dtype=np.int64)
    _, at = np.nonzero(set_)
    length[rank >= (n // most)[doc]] = 1 << (bits - 1 - at)
    return doc, length


class RunTokenizer:
    """Ids of texts by a vocabulary whose tokens never cross white space; any other vocabulary encodes whole texts.

    Runs are looked up without the case of ASCII letters and without the ASCII signs that end them after a letter,
    which the vocabulary sets apart too; this only makes runs meet more often. A run of lower-case Latin letters is
    one pre-token, which the vocabulary's model encodes without the steps before it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_runs = self._has_run_rules(json.loads(self.tokenizer.to_str()))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _has_run_rules(rules: dict) -> bool:
        def steps(part: dict | None, inner: str) -> list[dict]:
            return [] if part is None else part.get(inner) or [part]

        before, cuts = steps(rules["normalizer"], "normalizers"), steps(rules["pre_tokenizer"], "pretokenizers")
        return (
            [x["type"] for x in before] == RUN_NORMALIZERS
            and before[1]["pattern"] == {"Regex": r"\s+"}
            and before[1]["content"] == " "
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": RUN_PATTERN}
            and (cuts[0]["behavior"], cuts[0]["invert"], cuts[1]["add_prefix_space"], cuts[1]["use_regex"]) == ("Removed", True, False, False)
            and rules["model"]["type"] == "BPE"
            and not rules["model"].get("dropout")
            and all(t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) and not t["lstrip"] and not t["rstrip"] for t in rules["added_tokens"])
        )

    def learn(self, new: list[str]) -> None:
        young, cut = self.young, self.tokenizer.model.tokenize
        rest = []
        for w in new:
            if w.isalpha() and w.islower() and (w.isascii() or max(w) < "\u0250" and w.lower() == w):
                ids = [t.id for t in cut(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_SIGNS))]
                young[w] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(w)
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids = e.ids
                young[w] = struct.pack(f"<{len(ids)}I", *ids)

    def runs(self, words: list[str]) -> list[bytes]:
        """Each run's ids, four bytes each. Runs not seen for a generation are forgotten."""
        if self.held > KEPT_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        out = list(map(young.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            w = words[i]
            if w in old:
                young[w] = old[w]
            else:
                new.append(w)
        self.learn(new)
        for i in missing:
            out[i] = young[words[i]]
            self.held += RUN_BYTES + len(words[i]) + len(out[i])
        return out

    @staticmethod
    def prepared(text: pa.Array) -> pa.Array:
        """ASCII letters in lower case, ASCII signs at the end of a run set apart after a Latin letter; texts stay as they are where a special token could arise."""
        text = pc.fill_null(text, "")
        if pc.any(pc.match_substring(text, "<|"), min_count=0).as_py():
            return text
        return pc.replace_substring_regex(pc.ascii_lower(text), r"([A-Za-zÀ-ÖØ-öø-įı-ɏ])([!-/:-@\[-`{-~]+)([ \t\n\r\f\v]|$)", r"\1 \2\3")  # İ turns into two characters

    def encode(self, text: pa.Array, end: int) -> tuple[np.ndarray, pa.Buffer]:
        """Bounds of each text's ids, the end id included, and all ids, four bytes each."""
        if not self.by_runs:
            every = [np.array([*e.ids, end], "<u4") for e in self.tokenizer.encode_batch_fast([t or "" for t in text.to_pylist()], add_special_tokens=False)]
            return np.concatenate([[0], np.cumsum([len(x) for x in every])]).astype(np.int64), pa.py_buffer(b"".join(x.tobytes() for x in every))
        bounds, at, words = split_words(self.prepared(text))
        each = pa.array([*self.runs(words.to_pylist()), struct.pack("<I", end)], pa.large_binary())
        order = np.insert(at.astype(np.int64), bounds[1:], len(words))  # the end id after each text's last run
        flat = each.take(pa.array(order))
        ends = np.frombuffer(flat.buffers()[1], np.int64, len(order) + 1)
        to = np.concatenate([[0], ends[bounds[1:] + np.arange(1, len(bounds))]]) // 4
        return to, flat.buffers()[2]


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, most: int = MOST) -> DataFrame:
    """One row per piece: the id, start, length, ids (little-endian, 32 bits each), doc_tokens, bucket, sequence_id and offset."""
    if most & (most - 1):
        raise ValueError("the longest piece must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = RunTokenizer(tokenizer_path)
        for batch in slices(batches, "text", STEP_BYTES):
            to, raw = tok.encode(batch.column(1), end_id)
            n = np.diff(to)
            doc, length = pieces_of(n, most)
            ends = np.cumsum(length)
            start = ends - length - to[:-1][doc]
            # pieces follow each other as the ids do, so that the ids need no copy
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.r_[0, 4 * ends].astype(np.int64)), raw])
            by_bucket = np.argsort(-length, kind="stable")
            keys = batch.column(0).take(pa.array(doc))
            table = pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(length), ids, pa.array(n[doc])], names=_ARROW.names).take(pa.array(by_bucket))
            for at in range(0, table.num_rows, 8192):
                part = table.slice(at, 8192)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, _ARROW, strict=True)], schema=_ARROW)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return (
        slim.mapInArrow(cut, SCHEMA)
        .withColumn("bucket", F.log2("length").cast("int"))
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes the pieces as one folder for each bucket (bucket=0 to bucket=12), so that a batch of sequences of one length is read from one place."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: the ids become their checksum."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
