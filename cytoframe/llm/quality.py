"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

A document's features are the distinct n-grams of two views of its words: the folded words (one and
two) and their shapes (one to three; a shape tells letters' case, digits, marks, length and whether
the word repeats the one before). Each indicator is scaled by the log ratio of its smoothed shares
in the two classes, and a linear hinge-loss model is fit by dual coordinate descent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.llm._session import durable
from cytoframe.llm._text import Texts, Words, mix, slices

U = np.uint64
#: log2 of the number of hashed features; the bounds on training rows of each class and on the bytes of their features.
FEATURE_BITS, MAX_ROWS_PER_CLASS, MAX_FEATURE_BYTES = 17, 3000, 96 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 16
_MARKS = np.where(_KIND == 16, np.arange(256), 0).astype(np.uint8)


def _grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Document and hashed feature of each n-gram of a batch."""
    words = Words(texts)
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = words.hashes(texts, fold_case=True)
    of = words.text_of()
    kinds = np.bitwise_or.reduceat(_KIND[texts.bytes], words.start).astype(U)
    marks = np.maximum.reduceat(_MARKS[texts.bytes], words.start).astype(U)
    length = np.minimum((words.end - words.start), 24).astype(U) // U(4)
    repeats = np.zeros(len(of), U)
    repeats[1:] = ((folded[1:] == folded[:-1]) & (of[1:] == of[:-1])).astype(U)
    shape = mix(kinds | marks << U(8) | length << U(16) | repeats << U(24))
    doc, feature = [], []
    for view, most, seed in ((folded, 2, 1), (shape, 3, 101)):
        gram = np.zeros(len(of), U)
        for n in range(1, most + 1):
            starts = words.windows(n)
            gram = gram[: len(of)] * U(0x9E3779B97F4A7C15)
            head = gram[starts] + view[starts + n - 1]
            full = np.zeros(len(of), U)
            full[starts] = head
            gram = full
            doc.append(of[starts])
            feature.append((mix(head + U(seed * n)) >> U(64 - FEATURE_BITS)).astype(np.int64))
    return np.concatenate(doc), np.concatenate(feature)


def features(texts: Texts) -> list[np.ndarray]:
    """Ascending distinct features of each document."""
    doc, feature = _grams(texts)
    order = np.argsort(doc, kind="stable")
    cuts = np.searchsorted(doc[order], np.arange(1, texts.n))
    return [np.unique(x) for x in np.split(feature[order], cuts)] if texts.n else []


class Model:
    """Weights of features (log-count ratio times the hinge model's weight), a bias and the scale of scores."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[x].sum(dtype=np.float64) / np.sqrt(max(1, len(x))) for x in rows]) + self.bias

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.clip(self.slope * self.margins(rows) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, passes: int = 12, smoothing: float = 1.0) -> Model:
    """Fits a model to rows of features and labels 0 or 1; one class alone, or none, gives a constant score."""
    size = 1 << FEATURE_BITS
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return Model(np.zeros(size, np.float32), 0.0, 0.0, float(np.clip((share - 0.5) * 10, -5, 5)))
    count = np.full((2, size), smoothing)
    for x, y in zip(rows, labels):
        count[int(y), x] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    sign = np.where(labels > 0, 1.0, -1.0)
    cost = np.where(labels > 0, c * 0.5 / share, c * 0.5 / (1 - share))
    values = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    norm = np.array([v @ v for v in values]) + 1.0
    alpha, w, bias = np.zeros(len(rows)), np.zeros(size), 0.0
    random = np.random.default_rng(7)
    for _ in range(passes):
        for i in random.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * sign[i]) != 0:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return Model((w * ratio).astype(np.float32), bias, 4.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS_PER_CLASS, max_bytes: int = MAX_FEATURE_BYTES) -> Model:
    """Fits to at most max_rows documents of each class, the first by a hash of doc_id, outside the held-out third.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out. Labels other than 0 and 1 are ignored;
    an id labelled both ways counts once in each class; of rows with one id the one with the least
    features counts. Whole texts are read; only the distinct hashed features of those rows reach the
    driver, up to max_bytes of them, in the same order.
    """
    known = labels.where(~held_out("doc_id") & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_y")).distinct()
    picked = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = some if picked is None else picked.unionByName(some)
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 * max_rows narrow rows

    def extract(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = features(Texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), pa.array([x.astype(np.int32).tobytes() for x in rows], pa.binary())], names=["doc_id", "_y", "features"])

    rows = chosen.mapInArrow(extract, "doc_id long, _y int, features binary").groupBy("doc_id", "_y").agg(F.min("features").alias("features"))
    rows = durable(rows.withColumn("_at", F.xxhash64("doc_id")))
    sizes = sorted(map(tuple, rows.select("_at", "doc_id", "_y", F.length("features")).collect()))  # at most 2 * max_rows
    fits = int(np.searchsorted(np.cumsum([n for *_, n in sizes]), max_bytes, "right"))
    if fits < len(sizes):
        last = sizes[fits][:3]
        rows = rows.where(F.struct("_at", "doc_id", "_y") < F.struct(*[F.lit(x).cast(k) for x, k in zip(last, ("long", "long", "int"))]))
    got = sorted((r["doc_id"], r["_y"], bytes(r["features"])) for r in rows.collect())
    return fit([np.frombuffer(x, np.int32) for _, _, x in got], np.array([y for _, y, _ in got]))


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs, then quality_score (0 to 1, higher: class 1) and quality_predicted (1 at 0.5 and over).

    Null and empty texts have no features and get the model's bias. Every row is scored alone. Columns
    of docs with the names of the two new ones are replaced.
    """
    docs = docs.drop("quality_score", "quality_predicted")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            score = model.scores(features(Texts(batch.column(batch.schema.names.index("text")))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names, "quality_score", "quality_predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, quality_score double, quality_predicted int")
