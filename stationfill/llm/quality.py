"""Quality classifier from weak labels: overlapping heuristic labellers, their accuracies by expectation-maximisation,
and a hashed linear scorer trained on the posterior labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationfill.llm.textbytes import RollingHash, U, mix, pack_rows, slices, unpack_rows, words

#: Labellers: name, measure, the vote against from this value on, the vote for up to this value. Between them a labeller abstains.
LABELLERS = [
    ("symbols", "symbols", 0.02, 0.004),
    ("capitals", "capitals", 0.40, 0.15),
    ("repeats", "repeats", 0.75, 0.55),
    ("line_ends", "open_lines", 0.60, 0.20),
    ("long_words", "word_length", 9.0, 6.5),
    ("common_word", "top_share", 0.25, 0.12),
    ("shouting", "shouts", 0.02, 0.002),
    ("same_lines", "same_lines", 0.40, 0.15),
]
PLACES = 1 << 12
_MEASURES = ["symbols", "capitals", "repeats", "open_lines", "word_length", "top_share", "shouts", "same_lines"]

_CLASS = np.full(256, ord("a"), np.uint8)  # bytes of other letters count as small ones
_CLASS[:128] = np.arange(128)
_CLASS[97:123] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*|<>{}[]\\^~_=+@"))


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of the labellers' measures for each text; a text without words has zeros."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    row = np.repeat(np.arange(n), np.diff(offsets))

    def share(mask: np.ndarray, by: np.ndarray = size) -> np.ndarray:
        return np.bincount(row[mask], minlength=n) / np.maximum(by, 1)

    kind = _CLASS[data]
    starts, ends, owner = words(data, offsets)
    n_words = np.bincount(owner, minlength=n)
    letters = np.bincount(row[(kind == ord("a")) | (kind == ord("A"))], minlength=n)
    shout = np.zeros(len(data), bool)
    shout[1:] = (data[1:] == 33) & (data[:-1] == 33)
    hashes = RollingHash(data).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(o[new], minlength=n)
    top = np.zeros(n)
    if len(h):
        runs = np.diff(np.append(np.flatnonzero(new), len(h)))
        np.maximum.at(top, o[new], runs)
    # lines: from each text's start and after each line feed
    line_ends = np.flatnonzero(data == 10)
    last = np.unique(np.concatenate([line_ends, offsets[1:][np.diff(offsets) > 0]]))
    first = np.append(0, last[:-1] + (data[np.minimum(last[:-1], max(len(data) - 1, 0))] == 10)) if len(last) else np.zeros(0, np.int64)
    filled = last > first
    first, last = first[filled], last[filled]
    line_row = row[first] if len(first) else np.zeros(0, np.int64)
    n_lines = np.bincount(line_row, minlength=n)
    stopped = np.isin(data[last - 1], list(b".!?:\"")) if len(last) else np.zeros(0, bool)
    texts = RollingHash(data).of(first, last) if len(first) else np.zeros(0, np.uint64)
    by = np.lexsort((texts, line_row))
    line, text = line_row[by], texts[by]
    pairs = line[np.append(True, (text[1:] != text[:-1]) | (line[1:] != line[:-1]))] if len(line) else line
    return np.stack(
        [
            share(_SYMBOL[data]),
            share(kind == ord("A"), letters),
            1 - distinct / np.maximum(n_words, 1),
            np.bincount(line_row[~stopped], minlength=n) / np.maximum(n_lines, 1),
            np.bincount(owner, weights=ends - starts, minlength=n) / np.maximum(n_words, 1),
            np.where(n_words >= 8, top / np.maximum(n_words, 1), 0),
            share(shout),
            1 - np.bincount(pairs, minlength=n) / np.maximum(n_lines, 1),
        ],
        axis=1,
    )


def votes(found: np.ndarray) -> np.ndarray:
    """1 for, -1 against, 0 abstains: a column for each labeller."""
    out = np.zeros((len(found), len(LABELLERS)), np.int8)
    for k, (_, measure, bad, good) in enumerate(LABELLERS):
        value = found[:, _MEASURES.index(measure)]
        out[:, k] = np.where(value >= bad, -1, np.where(value <= good, 1, 0))
    return out


def shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed shares of runs of 2 to 5 bytes by kind (small, capital, digit, each mark), and of the measures in steps."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[data].astype(np.uint64)
    counts = np.zeros(n * PLACES, np.float32)
    key = kind.copy()
    for k in range(1, 5):
        key = key[:-1] * U(131) + kind[k:] if len(key) > 1 else key[:0]
        use = row[: len(key)] == row[k:] if len(key) else np.zeros(0, bool)
        slot = (mix(key[use] + U(k << 56)) % U(PLACES - 256)).astype(np.int64)
        counts += np.bincount(row[: len(key)][use] * PLACES + slot, minlength=n * PLACES)
    counts = counts.reshape(n, PLACES)
    out = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    steps = np.clip(measures(data, offsets) / np.array([0.05, 1, 1, 1, 12, 0.5, 0.05, 1]), 0, 0.999)
    at = PLACES - 256 + np.arange(steps.shape[1]) * 32 + (steps * 32).astype(np.int64)
    out[np.arange(n)[:, None], at] = 0.5
    return out


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over a good class and a faulty one for each labeller, votes being independent within a class.

    A labeller looks for one kind of fault and says nothing of the others, hence several faulty classes: a pattern begins in
    those of the labellers that vote against, or as good if none does. Returns P(vote | class) by class, labeller and vote,
    each pattern's posterior of the good class, and the share of good documents.
    """
    seen = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    against = (patterns < 0).astype(float)
    some = against.sum(axis=1, keepdims=True)
    post = np.hstack([np.where(some > 0, 0.05, 0.95), np.where(some > 0, 0.95 * against / np.maximum(some, 1), 0.05 / patterns.shape[1])])
    for _ in range(rounds):
        prior = (post * counts[:, None]).sum(axis=0) + 1
        prior /= prior.sum()
        table = np.einsum("pc,plv->clv", post * counts[:, None], seen) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        logs = np.einsum("plv,clv->pc", seen, np.log(table)) + np.log(prior)
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-6:
            break
    return table, post[:, 0], float(prior[0])


def score(docs: DataFrame, sample: int = 3000, keep: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, weak_label (posterior of the labellers' votes), score (of the linear scorer), kept (score is `keep` at least; the weak label only trains the scorer).

    Votes are counted over all documents; their patterns (at most 3 to the number of labellers) come to the driver. The
    scorer is trained on the `sample` documents with the least hash of (doc_id), a bounded number; vectors and labels come from
    their whole texts, in tasks. Null or empty text has
    no evidence against it: its labellers vote as for an empty text, and it is scored like any other. No rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                found, n = np.unique(votes(measures(data, offsets)), axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict({"pattern": pa.array([x.tobytes() for x in found], pa.binary()), "n": n.astype(np.int64)})

    rows = docs.select("text").mapInArrow(vote, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not rows:
        return docs.select("doc_id", F.lit(0.0).alias("weak_label"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    patterns = np.array([np.frombuffer(r["pattern"], np.int8) for r in rows])
    _, post, _ = accuracies(patterns, np.array([r["n"] for r in rows], float))
    posterior = {bytes(r["pattern"]): float(p) for r, p in zip(rows, post, strict=True)}

    def label(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.array([posterior.get(v.tobytes(), 0.5) for v in votes(measures(data, offsets))])

    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text"), 1 << 19, 512):
                columns = [batch.column("doc_id").slice(a, b - a), *pack_rows(shapes(data, offsets)), pa.array(label(data, offsets))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "value", "label"])

    chosen = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").mapInArrow(learn, "doc_id long, at binary, value binary, label double")
    chosen = chosen.groupBy("doc_id").agg(F.min(F.struct("label", "at", "value")).alias("v"))  # of repeated rows one
    rows = sorted((r["doc_id"], r["v"]["label"], bytes(r["v"]["at"]), bytes(r["v"]["value"])) for r in chosen.collect())
    weights = _fit(unpack_rows([r[2:] for r in rows], PLACES), np.array([r[1] for r in rows]))
    shared = spark.sparkContext.broadcast((weights, posterior))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, _ = shared.value
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text"), 1 << 19, 512):
                value = 1 / (1 + np.exp(-np.clip(shapes(data, offsets) @ w[:-1] + w[-1], -30, 30)))
                weak = label(data, offsets)
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(weak), pa.array(value.astype(np.float64)), pa.array(value >= keep)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "weak_label", "score", "kept"])

    return docs.mapInArrow(apply, "doc_id long, weak_label double, score double, kept boolean")


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Logistic regression on soft labels; both classes weigh the same."""
    weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1)).astype(np.float32)
    w, step = np.zeros(x.shape[1] + 1, np.float32), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        slope = ((p - y) * weight).astype(np.float32)
        step = 0.9 * step - 2.0 * (np.append(x.T @ slope, slope.sum()) + 1e-4 * w)
        w = (w + step).astype(np.float32)
    return w
