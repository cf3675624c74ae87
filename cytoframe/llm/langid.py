"""Language ID with error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.llm._text import Texts, slices
from cytoframe.llm.quality import held_out

FEATURE_BITS, MAX_TRAIN_ROWS = 12, 6000
#: Parts of a language's ids that are ranked apart before they are ranked together.
SALTS = 64
AMBIGUOUS_MARGIN = 0.1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


def vectors(texts: Texts) -> np.ndarray:
    """Square roots of the shares of hashed 1-, 2- and 3-grams of folded bytes, of unit length; empty texts are zero."""
    size = 1 << FEATURE_BITS
    folded = _FOLD[texts.bytes].astype(np.uint32)
    out = np.zeros((texts.n, size), np.float32)
    if not len(folded):
        return out
    grams = []
    code = np.zeros(len(folded), np.uint32)
    for n in (1, 2, 3):
        code = code[: len(folded) - n + 1] << np.uint32(8) | folded[n - 1 :] if n > 1 else folded
        grams.append(((code * np.uint32(2654435761) + np.uint32(n * 97)) >> np.uint32(32 - FEATURE_BITS)).astype(np.int32))
    for i in range(texts.n):
        a, b = texts.offsets[i], texts.offsets[i + 1]
        if b > a:
            count = sum(np.bincount(g[a : max(a, b - n)], minlength=size) for n, g in enumerate(grams))
            row = np.sqrt(count, dtype=np.float32)
            out[i] = row / np.sqrt(row @ row)
    return out


def has_letter(texts: Texts) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letters = np.concatenate([[0], np.cumsum(_LETTERS[texts.bytes])])
    found = ascii_letters[texts.offsets[1:]] > ascii_letters[texts.offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts.raw(i).decode("utf-8", "replace"))
    return found


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """Rows of +1 and -1, one for each class: all splits for few classes, else random rows far from each other."""
    if classes < 2:
        return np.ones((classes, 1), np.int8)
    if classes <= 5:  # every split into two parts but the trivial one
        splits = np.arange(1, 1 << (classes - 1))
        return np.where((splits[None, :] >> np.arange(classes)[:, None]) & 1, -1, 1).astype(np.int8)
    bits = max(15, int(np.ceil(10 * np.log2(classes))))
    random = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        code = random.choice(np.array([-1, 1], np.int8), (classes, bits))
        apart = ((code[:, None, :] != code[None, :, :]).sum(2) + bits * np.eye(classes, dtype=int)).min()
        if apart > far and (np.abs(code.sum(0)) < classes).all():
            best, far = code, apart
    return best


class Model:
    """Class names, their codewords, a linear classifier for each bit and the bits' weights."""

    def __init__(self, names, code, weights, bias, trust):
        self.names, self.code, self.weights, self.bias, self.trust = names, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest class by weighted exponential loss, its score and the lead over the next class."""
        if len(self.names) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x)), np.ones(len(x))
        margin = np.clip(x @ self.weights + self.bias, -8, 8)
        loss = np.stack([(np.exp(-margin * row) * self.trust).sum(1) for row in self.code], 1)
        share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        ranked = np.sort(share, 1)
        return loss.argmin(1), share.max(1), ranked[:, -1] - ranked[:, -2]


def fit(x: np.ndarray, names: list[str], steps: int = 150, decay: float = 1e-4) -> Model:
    """One logistic classifier a bit, by accelerated gradient; bits weigh by their accuracy on the rows."""
    langs = sorted(set(names))
    code = codewords(len(langs))
    target = code[[langs.index(n) for n in names]].astype(np.float32) if names else np.zeros((0, 1), np.float32)
    weights, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    look_w, look_b, last_w, last_b = weights, bias, weights, bias
    for step in range(steps if len(langs) > 1 else 0):
        pull = -target / (1 + np.exp(target * (x @ look_w + look_b))) / len(x)
        weights = look_w - 8.0 * (x.T @ pull + decay * look_w)
        bias = look_b - 8.0 * pull.sum(0)
        lead = step / (step + 3)
        look_w, look_b = weights + lead * (weights - last_w), bias + lead * (bias - last_b)
        last_w, last_b = weights, bias
    right = (np.sign(x @ weights + bias) == target).mean(0) if len(langs) > 1 else np.ones(code.shape[1])
    trust = np.maximum(right - 0.5, 0.01)
    return Model(langs, code, weights, bias, trust / trust.sum())


def training_ids(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """At most max_rows distinct (doc_id, lang) outside the held-out third, of rows with a lang and a text.

    Languages share the rows evenly, each with its first by a hash of doc_id; what a rare one leaves goes
    to the others. A language's ids are ranked in SALTS parts first, so the task that ranks them over all
    parts gets SALTS * max_rows narrow rows at most, however many the language has.
    """
    order = [F.xxhash64("doc_id"), "doc_id"]
    known = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang").distinct()
    known = known.withColumn("_salt", F.pmod(F.xxhash64(F.lit(SALTS), "doc_id"), F.lit(SALTS)))
    for keys in (["lang", "_salt"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        known = known.withColumn("_place", place).where(F.col("_place") <= max_rows)
    return known.orderBy("_place", *order, "lang").limit(max_rows).select("doc_id", "lang")


def train(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fits to the rows of training_ids, at most max_rows of them.

    Of rows with one doc_id and lang the one with the least vector counts.
    """
    picked = F.broadcast(training_ids(docs, max_rows).withColumnRenamed("lang", "_lang"))  # at most max_rows narrow rows

    def extract(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            x = vectors(Texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_lang"), pa.array([np.round(r * 65535).astype(np.uint16).tobytes() for r in x], pa.binary())], names=["doc_id", "_lang", "x"])

    rows = docs.select("doc_id", "text", "lang").join(picked, "doc_id").where("lang = _lang").select("doc_id", "text", "_lang")
    distinct = rows.mapInArrow(extract, "doc_id long, _lang string, x binary").groupBy("doc_id", "_lang").agg(F.min("x").alias("x"))
    got = sorted((r[0], r[1], bytes(r[2])) for r in distinct.collect())
    x = np.stack([np.frombuffer(r[2], np.uint16) for r in got]).astype(np.float32) / 65535 if got else np.zeros((0, 1 << FEATURE_BITS), np.float32)
    return fit(x, [r[1] for r in got])


def predict_language(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every whole text.

    `und` with score 0 where the text is null or has no letter, or where no language was learned.
    ambiguous: the nearest codeword leads the next by less than AMBIGUOUS_MARGIN. Rows are judged alone.
    """
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = Texts(batch.column("text"))
                known = has_letter(texts) & bool(model.names)
                lang, score, lead = model.decode(vectors(texts)) if model.names else (np.zeros(texts.n, np.int64), np.zeros(texts.n), np.zeros(texts.n))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array([model.names[i] if ok else "und" for i, ok in zip(lang, known)], pa.string()),
                        pa.array(np.where(known, score, 0.0)),
                        pa.array(known & (lead < AMBIGUOUS_MARGIN)),
                    ],
                    names=["doc_id", "lang_pred", "score", "ambiguous"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
