"""Toxicity by a weighted finite-state pattern grammar.

Words map to symbols: INSULT, THREAT, TARGET, NEGATION, REPORT, or OTHER; a full stop, exclamation, question
mark or semicolon, also before closing quotes and brackets, or a line's end ends a clause. Five transducers read a
clause from left to right and rewrite its symbols: insults and threats get their base reading, a target before aims
them, a negation shortly before lifts them, a verb of speech before reports them. Their composition is one transducer,
a table over (state, symbol). The target transducer also reads the clause from right to left, so that a target after a
match aims it too; both directions together make a bimachine, which is run on the clauses that hold an insult or a
threat. Each reading of a matched clause has a weight; a document's score is the logistic function of its summed
readings.

Learned, from labelled training rows only: the insults (words and word stems that occur in many different
contexts of toxic texts and hardly in others) and the readings' weights. Targets, negations, verbs of speech
and threats are the short word lists below. The fit uses a sample of at most TRAIN_DOCS labelled rows, picked
by hash; support counts distinct neighbourhoods, so that copies of one text count once.

Cases: a null or empty text matches nothing and has the score of the fit's constant alone. Very long texts are read
whole. Without labelled rows of both kinds no insult is known and all scores are the share of toxic rows (0 without
rows). Rows without a label teach nothing. Repeated rows score alike, null ids too. Further columns pass through, but
for those that carry the added names. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, slices, split_words

TRAIN_DOCS = 16_000
#: Candidates looked at more closely, and entries kept.
MOST_CANDIDATES, MOST_ENTRIES = 20_000, 5_000
LEAST_EVIDENCE, LEAST_ODDS, LEAST_CONTEXTS = 14.0, 20.0, 3
STEMS = (4, 5, 6)
THRESHOLD = 0.7

# The closed word classes of the grammar, in four languages.
TARGETS = frozenset("you your yours yourself u he him his she her they them their this these those du dich dir dein deine ihr euch sie er tu te toi ton ta tes vous votre il elle ils tú ti tu tus usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never nobody neither nor don't isn't aren't wasn't ain't nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás tampoco".split())
REPORTS = frozenset("said says say saying called calls claimed claims wrote writes quoted quotes reported alleged sagte sagt nannte schrieb behauptete dit disait écrit appelé selon dijo dice llamó escribió según".split())
THREATS = frozenset("kill killing hurt destroy burn beat stab shoot murder töten umbringen schlagen verbrennen tuer frapper brûler détruire matar golpear quemar destruir".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
SYMBOLS = 7
#: Readings a match can have: (insult or threat) x aimed x negated x reported.
READINGS = 16
MATCH = 16
NEGATION_REACH = 3


@dataclass
class Transducer:
    """step[(state, symbol)] = (next state, flags added to the reading of a match)."""

    start: int
    step: dict[tuple[int, int], tuple[int, int]]

    def states(self) -> set[int]:
        return {s for s, _ in self.step}


def insulting() -> Transducer:
    """Bit 16: an insult, which is a match."""
    return Transducer(0, {(0, s): (0, MATCH if s == INSULT else 0) for s in range(SYMBOLS)})


def threatening() -> Transducer:
    """Bits 16 and 8: a threat, which is a match of its own kind."""
    return Transducer(0, {(0, s): (0, MATCH | 8 if s == THREAT else 0) for s in range(SYMBOLS)})


def targeting() -> Transducer:
    """Bit 1: a target stands in the part of the clause read so far, from either end."""
    return Transducer(0, {(q, s): (0 if s == END else 1 if s == TARGET else q, 1 if q else 0) for q in (0, 1) for s in range(SYMBOLS)})


def negating() -> Transducer:
    """Bit 2: a negation stands at most NEGATION_REACH words before."""
    return Transducer(0, {(q, s): (0 if s == END else NEGATION_REACH if s == NEGATION else max(0, q - 1), 2 if q else 0) for q in range(NEGATION_REACH + 1) for s in range(SYMBOLS)})


def reporting() -> Transducer:
    """Bit 4: a verb of speech stands in the clause so far."""
    return Transducer(0, {(q, s): (0 if s == END else 1 if s == REPORT else q, 4 if q else 0) for q in (0, 1) for s in range(SYMBOLS)})


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same symbols; the flags of both are added."""
    index: dict[tuple[int, int], int] = {(a.start, b.start): 0}
    todo, step = [(a.start, b.start)], {}
    while todo:
        x, y = todo.pop()
        for s in range(SYMBOLS):
            (nx, fx), (ny, fy) = a.step[x, s], b.step[y, s]
            if (nx, ny) not in index:
                index[nx, ny] = len(index)
                todo.append((nx, ny))
            step[index[x, y], s] = (index[nx, ny], fx | fy)
    return Transducer(0, step)


def tables(t: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """Next state and flags of a transducer, by state and symbol."""
    n = len(t.states())
    return tuple([[t.step[q, s][k] for s in range(SYMBOLS)] for q in range(n)] for k in (0, 1))


def grammar() -> Transducer:
    """The composition of the five transducers that read from left to right."""
    return compose(compose(compose(insulting(), threatening()), targeting()), compose(negating(), reporting()))


FORWARD, BACKWARD = tables(grammar()), tables(targeting())


def read_clause(clause: list[int]) -> list[tuple[int, int]]:
    """(place, reading) of each match of a clause."""
    (go, flags), (back, seen) = FORWARD, BACKWARD
    ahead, state = [], 0
    for s in reversed(clause):
        ahead.append(seen[state][s])
        state = back[state][s]
    out, state = [], 0
    for i, (s, aimed) in enumerate(zip(clause, reversed(ahead), strict=True)):
        flag = flags[state][s]
        if flag & MATCH:
            reading = flag & ~MATCH | aimed
            if not reading & 8 or reading & 1:  # a threat without a target is none
                out.append((i, reading))
        state = go[state][s]
    return out


#: A line's end as a word of its own, and what may stand between a clause's last sign and the end of its word.
LINE_END, CLOSING = "\u2029", "\"'”’»)]}*_"


def bare(word: str) -> str:
    """Lower case, without signs at either end."""
    w = word.lower()
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


def features_of(word: str) -> list[str]:
    """The word itself, and its stems, written with a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(READINGS))
    bias: float = -20.0

    def symbol(self, word: str) -> tuple[int, float]:
        w = bare(word)
        if not w:
            return OTHER, 0.0
        found = max((self.lexicon.get(f, 0.0) for f in features_of(w)), default=0.0)
        if found > 0:
            return INSULT, found
        for symbol, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if w in words:
                return symbol, 1.0
        return OTHER, 0.0

    def readings(self, text: pa.Array) -> np.ndarray:
        """texts x READINGS: summed weights of the matches in all clauses, by reading."""
        bounds, at, words = split_words(pc.replace_substring(pc.fill_null(text, ""), "\n", f" {LINE_END} "))
        names = words.to_pylist()
        each = [self.symbol(w) for w in names]
        symbol = np.array([s for s, _ in each], dtype=np.int64)
        weight = np.array([x for _, x in each])
        ends = np.array([w[-1] in ".!?;" or w == LINE_END or w[-1] in CLOSING and w.rstrip(CLOSING)[-1:] in (*".!?;",) for w in names], dtype=bool)
        out = np.zeros((len(bounds) - 1, READINGS))
        if not len(at):
            return out
        seq = symbol[at]
        hits = np.flatnonzero((seq == INSULT) | (seq == THREAT))
        closes = np.flatnonzero(ends[at])
        owner = np.searchsorted(bounds, hits, side="right") - 1
        done = -1
        for h, doc in zip(hits.tolist(), owner.tolist(), strict=True):
            if h <= done:
                continue  # its clause was read with an earlier match
            k = int(np.searchsorted(closes, h))
            first = max(int(bounds[doc]), int(closes[k - 1]) + 1 if k else 0)
            last = min(int(bounds[doc + 1]), int(closes[k]) + 1 if k < len(closes) else int(bounds[doc + 1]))
            for i, reading in read_clause(seq[first:last].tolist()):
                out[doc, reading] += weight[at[first + i]]
            done = last - 1
        return out

    def score(self, readings: np.ndarray) -> np.ndarray:
        z = np.clip(self.bias + np.log1p(readings) @ self.weights, -30, 30)
        return 1 / (1 + np.exp(-z))


def evidence(n1: np.ndarray, n0: np.ndarray, t1: float, t0: float) -> np.ndarray:
    """Log-likelihood ratio of a feature's counts against equal shares in both kinds."""
    n = n1 + n0
    e1, e0 = n * t1 / (t1 + t0), n * t0 / (t1 + t0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(n1 > 0, n1 * np.log(n1 / e1), 0) + np.where(n0 > 0, n0 * np.log(n0 / e0), 0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge towards 0, the bias free."""
    a = np.c_[x, np.ones(len(x))]
    w, r = np.zeros(a.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + r * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(r)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame, *, text_col: str = "text", label_col: str = "toxic", key_col: str = "doc_id", most: int = TRAIN_DOCS) -> Model:
    """Learns from at most about `most` rows of (key, text, label)."""
    rows = labelled.select(F.xxhash64(key_col).alias("key"), F.col(label_col).cast("int").alias("label"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("label is not null")
    share = min(1.0, most / max(1, rows.count()))
    sample = checkpoint(rows.filter(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30))).select("label", "text"))
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two labels
    t1, t0 = totals.get(1, 0), sum(n for k, n in totals.items() if k != 1)
    if not t1 or not t0:
        return Model(bias=30.0 if t1 else -30.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {bare(w) for w in set(text.split())}
                seen[int(label == 1)].update({f for w in words if w for f in features_of(w)})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["feature", "n1", "n0"])

    counts = sample.mapInArrow(count, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = ((F.col("n1") + 0.5) / (t1 + 1)) / ((F.col("n0") + 0.5) / (t0 + 1))
    some = counts.filter((F.col("n1") >= LEAST_CONTEXTS) & (odds >= LEAST_ODDS / 2)).orderBy(F.desc("n1"), "feature").limit(MOST_CANDIDATES).collect()  # bounded
    wanted = {r["feature"] for r in some}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = set()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = ["", *(bare(w) for w in text.split()), ""]
                for i in range(1, len(words) - 1):
                    for f in features_of(words[i]) if words[i] else ():
                        if f in wanted:
                            found.add((f, int(label == 1), f"{words[i - 1]} {words[i + 1]}"))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], names=["feature", "label", "around"])

    around = sample.mapInArrow(contexts, "feature string, label int, around string").distinct().groupBy("feature").agg(F.sum("label").alias("c1"), F.sum(1 - F.col("label")).alias("c0")).collect()  # MOST_CANDIDATES at most
    if around:
        n = {r["feature"]: r for r in some}
        names = [r["feature"] for r in around]
        c1 = np.minimum(np.array([r["c1"] for r in around], float), [n[f]["n1"] for f in names])
        c0 = np.array([n[f]["n0"] for f in names], float)
        odds1 = ((c1 + 0.5) / (t1 + 1)) / ((c0 + 0.5) / (t0 + 1))
        good = np.flatnonzero((evidence(c1, c0, t1, t0) >= LEAST_EVIDENCE) & (odds1 >= LEAST_ODDS) & (c1 >= LEAST_CONTEXTS))
        good = good[np.argsort(-c1[good], kind="stable")][:MOST_ENTRIES]
        lexicon = {names[i]: math.log(odds1[i]) / math.log(LEAST_ODDS) for i in good}
    else:
        lexicon = {}
    model = Model(lexicon)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(model.readings(batch.column(1))), pa.list_(pa.float64()))], names=["label", "x"])

    got = sample.mapInArrow(read, "label int, x array<double>").collect()  # at most about `most` rows of numbers
    x, y = np.log1p(np.array([r["x"] for r in got])), np.array([float(r["label"] == 1) for r in got])
    # readings that the sample does not show keep the grammar's prior weight, relative to a plain insult
    prior = np.array([(0.8 if k & 8 else 1.0) * (1.3 if k & 1 else 1.0) * (0.2 if k & 2 else 1.0) * (0.4 if k & 4 else 1.0) for k in range(READINGS)])
    base = (x * prior).sum(axis=1, keepdims=True)
    slope, bias = logistic(base, y)
    extra, shift = logistic_offset(x, y, base[:, 0] * slope[0] + bias)
    model.weights, model.bias = prior * slope[0] + extra, bias + shift
    return model


def logistic_offset(x: np.ndarray, y: np.ndarray, offset: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, float]:
    """Corrections of the readings' weights, drawn to 0: what a reading shows beyond its prior."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(offset + x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w, 0.0


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score, predicted and matches (the summed weight of all matched readings)."""
    docs = docs.drop("score", "predicted", "matches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            r = model.readings(batch.column(batch.schema.get_field_index(text_col)))
            s = model.score(r)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array(r.sum(axis=1), pa.float64())], names=[*batch.schema.names, "score", "predicted", "matches"])

    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("matches")).schema
    return docs.mapInArrow(run, schema)
