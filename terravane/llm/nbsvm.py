"""Naive Bayes support vectors for document quality.

Features are indicators of n-grams: of bytes (3 and 4), and of marks that say whether a word repeats the one
before it (1 to 3). They hash into 2**BITS places. Each place's indicator is scaled by the log of the ratio of
its smoothed shares in both classes; on the scaled rows a linear hinge-loss model is fitted by dual coordinate
descent. A logistic curve, fitted to margins of rows left out of the fit, turns a margin into a score.

The fit sees at most SAMPLE labelled rows, those with the least hash of their id; a row comes to the driver as
its places or as one bit for each place, whichever is shorter, so SAMPLE rows take 2**(BITS - 3) bytes each at
most, however long their texts are. Scores cover every row.

Defined cases: null text is empty and scores by the bias alone; rows without a label, or with a label other
than 0 or 1, are never learnt from, nor are documents that have both labels; a document that occurs in several
rows is learnt from each, within the sample's bound; repeated rows score alike; with no label at all, or labels of one class
only, every score is that class's smoothed share; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm import textblock as tb
from terravane.runtime import arrow_limits, ship

BITS = 18
#: The most labelled rows that a fit sees.
SAMPLE = 6000
PENALTY, EPOCHS, SMOOTH = 1.0, 12, 1.0


def features(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Distinct places of a text's n-grams, in no order. data: lower-cased bytes; words: word fingerprints."""
    x = data.astype(np.uint32)
    found = []
    if len(x) >= 3:
        three = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
        found.append(three * np.uint32(0x9E3779B1))
        if len(x) >= 4:
            found.append((three[:-1] | x[3:] << np.uint32(24)) * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F))
    if len(words) > 1:
        same = np.concatenate(([0], words[1:] == words[:-1])).astype(np.uint32) + np.uint32(1)
        grams = same
        for k in range(1, 4):
            if k > 1:
                grams = grams[:-1] * np.uint32(3) + same[k - 1 :]
            if len(grams):
                found.append((np.unique(grams) + np.uint32(1000 * k)) * np.uint32(0xC2B2AE35))
    if not found:
        return np.zeros(0, np.int64)
    return (np.concatenate(found) >> np.uint32(32 - BITS)).astype(np.int64)


def distinct(at: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """One of each place, without a sort. mark: scratch space of 2**BITS integers."""
    order = np.arange(len(at), dtype=np.int32)
    mark[at] = order
    return at[mark[at] == order]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, at: np.ndarray) -> float:
        return (float(self.weights[at].sum()) / max(1.0, len(at)) ** 0.5 if len(at) else 0.0) + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


class Rows:
    """Distinct places of some texts, kept as they came: int32 places, or a bit for each place."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> np.ndarray:
        return unpacked(self.packed[i])

    def some(self, which: list[int]) -> Rows:
        return Rows([self.packed[i] for i in which])


def packed(at: np.ndarray) -> bytes:
    """Places in the shorter of two forms; the first byte tells which."""
    if len(at) <= 1 << (BITS - 5):
        return b"\0" + at.astype(np.int32).tobytes()
    bits = np.zeros(1 << BITS, bool)
    bits[at] = True
    return b"\1" + np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32, offset=1) if data[0] == 0 else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))


def _ratios(rows: Rows, y: np.ndarray) -> np.ndarray:
    size = 1 << BITS
    logs = []
    for label in (1, 0):
        n = np.full(size, SMOOTH)
        for i in np.flatnonzero(y == label):
            n[rows[i]] += 1
        logs.append(np.log(n / n.sum()))
    return logs[0] - logs[1]


def _descend(rows: Rows, y: np.ndarray, ratio: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights on plain indicators and a bias: hinge loss with penalty, by dual coordinate descent."""
    sign = np.where(y == 1, 1.0, -1.0)
    # rarer labels weigh as much as common ones
    upper = PENALTY * len(y) / (2 * np.where(y == 1, max(1, (y == 1).sum()), max(1, (y == 0).sum())))
    norm, square = np.empty(len(rows)), np.empty(len(rows))
    for i in range(len(rows)):
        r = rows[i]
        norm[i] = 1 / max(1.0, len(r)) ** 0.5
        square[i] = float((ratio[r] ** 2).sum()) * norm[i] ** 2 + 1
    w, b, a = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        most = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            scaled = ratio[r] * norm[i]
            slope = sign[i] * (float(w[r] @ scaled) + b) - 1
            new = min(max(a[i] - slope / square[i], 0.0), upper[i])
            step = (new - a[i]) * sign[i]
            if step:
                w[r] += step * scaled
                b += step
                most = max(most, abs(new - a[i]))
                a[i] = new
        if most < 1e-4:
            break
    return w * ratio, b


def fit(rows: Rows, y: np.ndarray) -> Model:
    """rows: distinct places of each text; y: 0 or 1."""
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    if not good or not bad:
        share = (good + 1) / (good + bad + 2)
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(y))
    fold = np.arange(len(y)) % 3
    if min(good, bad) >= 6:
        for k in range(3):
            ins = [i for i in range(len(y)) if fold[i] != k]
            part = Model(*_descend(rows.some(ins), y[ins], _ratios(rows.some(ins), y[ins])), 1.0, 0.0)
            for i in np.flatnonzero(fold == k):
                margins[i] = part.margin(rows[i])
        slope, shift = _logistic(margins, y)
    else:
        slope, shift = 2.0, 0.0
    return Model(*_descend(rows, y, _ratios(rows, y)), slope, shift)


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest curve, with both classes' targets drawn in by one row."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    at = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(y))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (p - goal) + 1e-3 * at
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        at -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
    return float(max(at[0], 1e-3)), float(at[1])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mark = np.zeros(1 << BITS, np.int32)
    for batch, texts in tb.blocks(batches):
        words = tb.Words(texts)
        out = [packed(distinct(features(words.data[words.at[i] : words.at[i + 1] - 1], words.hashes[words.bounds[i] : words.bounds[i + 1]]), mark)) for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["doc_id", "y", "places"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on at most sample rows of labels that train holds for and docs has."""
    ship(docs.sparkSession)
    arrow_limits(docs.sparkSession)
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if train is not None:
        chosen = chosen.filter(train)
    one = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("z"))
    chosen = one.filter("y = z").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    # rows of documents that repeat are held to the bound again
    rows = texts.select("doc_id", "text", "y").mapInArrow(_places, "doc_id long, y int, places binary").orderBy(F.xxhash64("doc_id"), "doc_id", "places").limit(sample)
    found = sorted(rows.collect(), key=lambda r: (r.doc_id, bytes(r.places)))
    order = np.random.default_rng(3).permutation(len(found))
    return fit(Rows([bytes(found[i].places) for i in order]), np.array([found[i].y for i in order], np.int64))


def _margins(model: Model, texts: list[bytes], mark: np.ndarray) -> np.ndarray:
    words = tb.Words(texts)
    return np.array([model.margin(distinct(features(words.data[words.at[i] : words.at[i + 1] - 1], words.hashes[words.bounds[i] : words.bounds[i + 1]]), mark)) for i in range(len(texts))])


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, np.int32)
        for batch, texts in tb.blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_margins(model, texts, mark)))], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    at = Model(model.weights.astype(np.float32), model.bias, model.slope, model.shift)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_scores(at), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, mod: int = 5, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels whose crc32(doc_id) mod is 0 are held out."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == 0
    model = learn(docs, labels, train=~out)
    return scored(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _keep(model: Model, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, np.int32)
        for batch, texts in tb.blocks(batches):
            yield batch.filter(pa.array(model.score(_margins(model, texts, mark)) >= cut))

    return run


def accepted(docs: DataFrame, labels: DataFrame, mod: int = 5, cut: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns, in one pass."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == 0
    model = learn(docs, labels, train=~out)
    at = Model(model.weights.astype(np.float32), model.bias, model.slope, model.shift)
    return docs.mapInArrow(_keep(at, cut), docs.schema)
