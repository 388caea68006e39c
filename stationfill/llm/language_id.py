"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of bits; one linear classifier a bit says on which side of that bit a text lies. A text
gets the language whose codeword loses least under the weighted losses of the bits, and a flag where the second is near.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationfill.llm.common import lean
from stationfill.llm.textbytes import CODES, LOWER, mix, pack_rows, slices, unpack_rows

#: Features: hashes of byte n-grams of these lengths, in one table of this many places.
ORDERS = (1, 2, 3, 4)
PLACES = 1 << 13


def _features(data: np.ndarray, offsets: np.ndarray, places: int = PLACES) -> np.ndarray:
    """A row of square-rooted n-gram shares for each text; an n-gram never crosses texts. Digits and marks don't count."""
    n = len(offsets) - 1
    data = LOWER[data]
    code = CODES[data]
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    code = np.where(letter, code, CODES[32])
    rows = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.zeros(n * places, np.float32)
    key = np.zeros(len(data), np.uint64)
    for k in range(ORDERS[-1]):
        # the key of an n-gram of length k + 1 grows from the one before
        key = key[: len(data) - k] * np.uint64(0x9E3779B97F4A7C15) + code[k:]
        if k + 1 not in ORDERS or not len(key):
            continue
        start = rows[: len(key)]
        use = (start == rows[k:]) & (letter[: len(key)] | letter[k:])
        slot = start[use] * places + (mix(key[use]) & np.uint64(places - 1)).astype(np.int64)
        counts += np.bincount(slot, minlength=n * places).astype(np.float32)
    counts = counts.reshape(n, places)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def codewords(n: int, rng: np.random.Generator) -> np.ndarray:
    """n rows of signs, far from each other: all two-way splits for few languages, the best of random draws for more."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = [[1 if j == 0 or (bits >> (j - 1)) & 1 else -1 for j in range(n)] for bits in range(2 ** (n - 1) - 1)]
        return np.array(splits, float).T
    width, best, most = int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        draw = rng.choice([-1.0, 1.0], (n, width))
        draw = draw[:, np.abs(draw.sum(axis=0)) < n]
        gap = min((draw[i] != draw[j]).sum() for i in range(n) for j in range(i))
        if gap > most:
            best, most = draw, gap
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray  # of each bit, from its training accuracy
    margin: float

    def losses(self, x: np.ndarray) -> np.ndarray:
        """For each text and language the mean loss log(1 + exp(-bit * output)), weighted by the bits' trust."""
        out = np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)
        lost = np.stack([np.log1p(np.exp(-out * code)) @ self.trust for code in self.codes], axis=1)
        return lost / self.trust.sum()

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, a score from 0 to 1, and whether the second codeword is nearly as close."""
        lost = self.losses(x)
        likely = np.exp(-(lost - lost.min(axis=1, keepdims=True)) * self.codes.shape[1])
        share = likely / likely.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        score = share[np.arange(len(share)), best]
        rest = np.where(np.arange(share.shape[1]) == best[:, None], 0, share).max(axis=1) if share.shape[1] > 1 else np.zeros(len(share))
        return best, score, score - rest < self.margin


def train(x: np.ndarray, labels: list[str], margin: float = 0.2, rounds: int = 150, seed: int = 7) -> Model:
    """Logistic classifiers of all bits at once, by gradient steps with momentum; languages weigh the same however often they occur."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    codes = codewords(len(languages), np.random.default_rng(seed))
    target = codes[y]
    each = (1 / np.bincount(y, minlength=len(languages)))[y]
    each = (each / each.sum()).astype(np.float32)[:, None]
    weights = np.zeros((x.shape[1] + 1, codes.shape[1]), np.float32)
    step = np.zeros_like(weights)
    for _ in range(rounds):
        out = x @ weights[:-1] + weights[-1]
        slope = (-target / (1 + np.exp(np.clip(target * out, -30, 30))) * each).astype(np.float32)
        grad = np.vstack([x.T @ slope, slope.sum(axis=0, keepdims=True)]) + 1e-5 * weights
        step = 0.9 * step - 8.0 * grad
        weights += step
    right = ((np.sign(x @ weights[:-1] + weights[-1]) == target) * each).sum(axis=0)
    return Model(languages, codes, weights, np.clip(2 * right - 1, 0.05, 1), margin)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def fit(docs: DataFrame, for_training: Column, most: int = 600) -> Model | None:
    """A model from a bounded sample: of each language the `most` training texts with the least hash of (doc_id), whole;
    only their vectors come to the driver, of repeated rows of a doc_id one. None if no text is labelled. The languages are the distinct labels, a set whose size the data don't set.
    """
    known = docs.filter(for_training & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # ids first, of all languages in one pass, in which a task keeps `most` a language; so only the chosen texts are gathered
    by_hash = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = F.broadcast(known.select("lang", "doc_id").withColumn("r", F.row_number().over(by_hash)).filter(F.col("r") <= most).select("doc_id").distinct())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text"), 1 << 18, 256):
                columns = [batch.column(c).slice(a, b - a) for c in ("lang", "doc_id")]
                yield pa.RecordBatch.from_arrays([*columns, *pack_rows(_scaled(data, offsets))], ["lang", "doc_id", "at", "value"])

    texts = known.join(picked, "doc_id", "left_semi").select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = texts.mapInArrow(lean(learn), "lang string, doc_id long, at binary, value binary").groupBy("lang", "doc_id").agg(F.min(F.struct("at", "value")).alias("v"))
    rows = sorted((r["lang"], r["doc_id"], bytes(r["v"]["at"]), bytes(r["v"]["value"])) for r in vectors.collect())
    if not rows:
        return None
    return train(unpack_rows([r[2:] for r in rows], PLACES), [r[0] for r in rows])


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, ambiguous. A text that is null or has no letter gets `und` and 0."""
    kinds = "doc_id long, lang_pred string, score double, ambiguous boolean"
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("text"))
    if model is None:
        return slim.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    none = "und"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            known = np.asarray(batch.column("text").is_valid())
            for a, b, data, offsets in slices(batch.column("text"), 1 << 18, 256):
                best, score, near = own.decide(_scaled(data, offsets))
                has = known[a:b]
                names = [own.languages[i] if h else none for i, h in zip(best, has, strict=True)]
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(names), pa.array(np.where(has, score, 0.0)), pa.array(near | ~has)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "ambiguous"])

    return slim.mapInArrow(lean(run), kinds)


def _scaled(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Features of whole texts; a very long text is counted in pieces of `step` bytes, whose shares are averaged by length."""
    if len(data) <= 2 * step:
        return _features(data, offsets)
    # such a run holds one text (see slices)
    cuts = np.append(np.arange(0, len(data), step), len(data))
    parts = np.concatenate([_features(data[a:b], np.array([0, b - a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return np.sqrt(((parts**2) * np.diff(cuts)[:, None]).sum(axis=0, keepdims=True) / len(data)).astype(np.float32)


def identify(docs: DataFrame) -> DataFrame:
    """Languages of documents (doc_id, text, lang) by a model learned from those that aren't held out: doc_id, held_out, lang_pred, score, ambiguous.

    Neither lang nor doc_id is an input of a prediction. Repeated rows are predicted alike; no rows give no rows.
    """
    docs = docs.select("doc_id", "text", "lang")
    found = predict(docs, fit(docs, ~held_out(F.col("doc_id"))))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def with_language(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of docs with a letter and a score of `least` at least, all columns unchanged. Without a model, all rows with a letter."""
    letters = docs.filter(F.col("text").rlike(r"\p{L}"))
    if model is None:
        return letters
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            kept = [shared.value.decide(_scaled(data, offsets))[1] >= least for _, _, data, offsets in slices(batch.column(at), 1 << 18, 256)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return letters.mapInArrow(lean(run), letters.schema)
