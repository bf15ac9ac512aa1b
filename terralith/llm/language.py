"""Language identification by a byte convolutional network.

Bytes are folded to a small alphabet, embedded, and passed through filters of several widths; the largest
response of each filter over a fixed-length window goes through a softmax layer. The network is trained in
numpy on a bounded sample of windows of labelled texts. A text is scored over all its windows, weighted by
their bytes.

Cases: a null text, or one without a letter, is `und` with score 0. Rows without a language teach nothing; if
there are no labelled rows at all, every text is `und`. Repeated rows are scored alike. Other columns pass
through untouched unless they carry the names that are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Bounds of the training sample: windows drawn from one document, and windows in all.
WINDOWS_PER_DOC = 4
TRAIN_WINDOWS = 16_000
EPOCHS = 4
UNKNOWN = "und"


def _alphabet() -> np.ndarray:
    """Byte to symbol. 0 pads; letters lose their case; continuation bytes keep five bits, so that accented letters do too."""
    out = np.full(256, 1, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if c.isascii() and c.isalpha():
            out[b] = 4 + ord(c.lower()) - ord("a")
        elif b in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
            out[b] = 2
        elif c.isascii() and c.isdigit():
            out[b] = 3
        elif 0x80 <= b < 0xC0:
            out[b] = 30 + (b & 31)
        elif b >= 0xC0:
            out[b] = 62 + min((b & 0x3F) // 4, 15) if b != 0xC3 else 78
    return out


SYMBOL, SYMBOLS = _alphabet(), 79


def windows_of(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the windows (padded with 0), the text each belongs to, and its number of bytes."""
    count = np.array([(len(t) + window - 1) // window for t in texts], dtype=np.int64)
    out = np.zeros((int(count.sum()), window), dtype=np.uint8)
    flat, at = out.reshape(-1), 0
    for t, c in zip(texts, count, strict=True):
        flat[at : at + len(t)] = SYMBOL[np.frombuffer(t, dtype=np.uint8)]
        at += int(c) * window
    owner = np.repeat(np.arange(len(texts)), count)
    return out, owner, (out != 0).sum(axis=1)


@dataclass
class ByteNet:
    labels: list[str]
    embed: np.ndarray  # symbols x EMBED
    filters: np.ndarray  # (widest * EMBED) x (FILTERS * widths); a narrow filter has zeros beyond its width
    bias: np.ndarray
    out_w: np.ndarray
    out_b: np.ndarray

    @staticmethod
    def mask(widths=WIDTHS, filters: int = FILTERS, embed: int = EMBED) -> np.ndarray:
        widest = max(widths)
        m = np.zeros((widest * embed, filters * len(widths)), dtype=np.float32)
        for k, w in enumerate(widths):
            m[: w * embed, k * filters : (k + 1) * filters] = 1
        return m

    def _columns(self, x: np.ndarray) -> np.ndarray:
        widest = len(self.filters) // self.embed.shape[1]
        e = self.embed[np.pad(x, ((0, 0), (0, widest - 1)))]
        n, long, d = x.shape[0], x.shape[1], e.shape[2]
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (n, long, widest * d), (s[0], s[1], s[2]))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter, and the columns they were taken from."""
        cols = self._columns(x)
        r = np.ascontiguousarray(cols).reshape(-1, cols.shape[2]) @ self.filters
        return r.reshape(x.shape[0], x.shape[1], -1), cols

    def probabilities(self, x: np.ndarray, step: int = 256) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)), dtype=np.float32)
        for at in range(0, len(x), step):
            r, _ = self.pooled(x[at : at + step])
            h = np.maximum(r.max(axis=1) + self.bias, 0)
            out[at : at + step] = _softmax(h @ self.out_w + self.out_b)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], *, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Adam on the cross-entropy; a filter's gradient comes only from the place of its largest response."""
    rng = np.random.default_rng(seed)
    mask = ByteNet.mask()
    f32 = lambda a: a.astype(np.float32)
    net = ByteNet(labels, f32(rng.normal(0, 0.5, (SYMBOLS, EMBED))), f32(rng.normal(0, 0.3, mask.shape)) * mask, np.zeros(mask.shape[1], np.float32), f32(rng.normal(0, 0.1, (mask.shape[1], len(labels)))), np.zeros(len(labels), np.float32))
    net.embed[0] = 0
    params = [net.embed, net.filters, net.bias, net.out_w, net.out_b]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    widest = mask.shape[0] // EMBED
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            xb, yb = x[rows], y[rows]
            r, cols = net.pooled(xb)
            where = r.argmax(axis=1)
            top = np.take_along_axis(r, where[:, None, :], axis=1)[:, 0] + net.bias
            h = np.maximum(top, 0)
            p = _softmax(h @ net.out_w + net.out_b)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            dh = (p @ net.out_w.T) * (top > 0)
            picked = cols[np.arange(len(xb))[:, None], where]  # batch x filters x (widest * embed)
            d_filters = np.einsum("bfk,bf->kf", picked, dh) * mask
            d_cols = (dh[:, :, None] * net.filters.T[None]).reshape(len(xb), -1, widest, EMBED)
            padded = np.pad(xb, ((0, 0), (0, widest - 1)))
            symbol = padded[np.arange(len(xb))[:, None, None], where[:, :, None] + np.arange(widest)]
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, symbol.reshape(-1), d_cols.reshape(-1, EMBED))
            d_embed[0] = 0
            t += 1
            for i, g in enumerate((d_embed, d_filters, dh.sum(axis=0), h.T @ p, p.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's decimal text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", windows: int = TRAIN_WINDOWS, per_doc: int = WINDOWS_PER_DOC, window: int = WINDOW) -> ByteNet | None:
    """Trains on at most `windows` windows, at most `per_doc` of one document, picked by hash from all labelled rows.

    Half of the windows follow the labels' numbers of documents, half are dealt equally to the labels, so that a rare
    label is learned too. Of more than windows / 4 labels only the most frequent are.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for key, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                n = (len(raw) + window - 1) // window
                rng = np.random.default_rng(key & (2**63 - 1))
                for w in rng.permutation(n)[:per_doc] if n else ():
                    rows.append((int(rng.integers(2**62)), label, raw[w * window : (w + 1) * window]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["h", "label", "raw"])

    slim = labelled.select(F.xxhash64(id_col).alias("key"), F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).filter("label is not null and text is not null")
    # Whole documents are picked by hash first, about windows / 2 of them, so that what tasks send does not grow with the corpus.
    counts = slim.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(windows // 4).collect()  # bounded by `windows`
    if not counts:
        return None
    total, each = sum(r["n"] for r in counts), windows // 4 / len(counts)
    shares = [(r["label"], int(min(1.0, windows / 4 / total + each / r["n"]) * (1 << 30))) for r in counts]
    slim = slim.join(F.broadcast(slim.sparkSession.createDataFrame(shares, "label string, below long")), "label").filter(F.pmod("key", F.lit(1 << 30)) < F.col("below"))
    drawn = slim.select("key", "label", "text").mapInArrow(draw, "h long, label string, raw binary")
    # an equal share of each label comes first, then the rest by hash
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "raw"))
    rows = drawn.withColumn("rest", place > windows // 2 // len(counts)).orderBy("rest", "h", "label", "raw").limit(windows).collect()  # bounded by `windows`
    if not rows:
        return None
    labels = sorted({r["label"] for r in rows})
    x, owner, _ = windows_of([bytes(r["raw"]) for r in rows], window)
    y = np.array([labels.index(r["label"]) for r in rows])[owner]
    return train(x, y, labels)


def classify(docs: DataFrame, net: ByteNet | None, *, text_col: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language of the whole text and the mean probability of it over the text's windows."""
    docs = docs.drop(label, score)
    if net is None:
        return docs.withColumn(label, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            said = [t is not None and any(map(str.isalpha, t)) for t in texts]
            x, owner, weight = windows_of([t.encode("utf-8", "surrogatepass") if s else b"" for t, s in zip(texts, said, strict=True)])
            total = np.zeros((len(texts), len(net.labels)))
            np.add.at(total, owner, net.probabilities(x) * weight[:, None])
            best = total.argmax(axis=1)
            share = total[np.arange(len(texts)), best] / np.maximum(total.sum(axis=1), 1e-9)
            names = [net.labels[b] if s else UNKNOWN for b, s in zip(best, said, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.where(said, np.clip(share, 0, 1), 0.0), pa.float64())], names=[*batch.schema.names, label, score])

    schema = docs.select("*", F.lit("").alias(label), F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(predict, schema)
