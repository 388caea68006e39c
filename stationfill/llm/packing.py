"""Packing of documents into fixed windows: repeat counts of window fillings by non-negative least squares on the length histogram.

Only the histogram of lengths (at most one bin for each length below the window) is planned on the driver. Documents
find their places by their rank among those of the same length, which is counted in parallel.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationfill.llm.common import Scratch, lean, shuffle_partitions
from stationfill.llm.textbytes import slices

_loaded: dict[str, object] = {}
_ID = attrgetter("id")

#: ASCII without letters, digits and white space.
MARKS = bytes(x for x in range(128) if not chr(x).isalnum() and x not in b" \t\n\v\f\r")


#: Words of lower-case Latin letters: the library's normaliser and splitter leave them as they are, so its model alone gives their ids.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Byte-level vocabularies write a byte as the character of its number, or where that can't be printed as one from 256 on, in their order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class _Words(dict):
    """Ids by word; a word that isn't there is learned when it is asked for."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class WordEncoder:
    """Ids of a lower-casing tokenizer whose words never hold white space, by a bounded memory of the words seen.

    The memory has two generations: a full one becomes the older, and words still in use move to the younger.
    """

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.sign = os.path.commonprefix(self.special)
        self.raw_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # no word comes to the model twice soon: the library's own memory of words only costs time
        self.tokenize = model.tokenize
        self.young = _Words(self._learn)
        self.old: dict[bytes, bytes] = {}
        self.most = most

    @staticmethod
    def at(path: str) -> WordEncoder:
        if path not in _loaded:
            _loaded[path] = WordEncoder(path)
        return _loaded[path]

    def _stem(self, word: bytes) -> bytes:
        """The word without the ASCII marks at its end, where what is left ends in a letter or digit, lower-cased too: they are words of their own."""
        stem = word.rstrip(MARKS)
        if len(stem) == len(word) or not stem:
            return word
        return stem if stem[-1] < 128 or stem.decode("utf-8", "replace")[-1].lower()[-1].isalpha() else word

    def _by_model(self, printed: str) -> bytes:
        return b"".join(map(self.raw_of.__getitem__, map(_ID, self.tokenize(printed))))

    def _learn(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is not None:
            return ids
        if word.isalpha():  # of ASCII letters only, which the vocabulary writes as they are
            return self._by_model(word.decode())
        stem = self._stem(word)
        if len(stem) < len(word):
            return self.young[stem] + self.young[word[len(stem) :]]
        if _LETTERS.fullmatch(word):
            return self._by_model(word.decode("latin-1").translate(_BYTES))
        found = self.tokenizer.encode([word.decode("utf-8", "replace")], is_pretokenized=True, add_special_tokens=False)
        return b"".join([self.raw_of[i] for i in found.ids])

    def rest(self, most: int = 50_000) -> None:
        """Keep some of the words that came up again, the frequent ones first: a worker that other stages use next shouldn't hold more."""
        again = (x for x in self.young if not self.old or x in self.old)
        kept = {x: self.young[x] for x in islice(again, most)}
        self.old, self.young = {}, _Words(self._learn)
        self.young.update(kept)

    def encode(self, raws: list[bytes], last: bytes) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, followed by `last`."""
        for raw in raws:
            text = raw.lower()
            # what may hold the name of a special token goes to the library whole, as it is
            if self.sign in text and any(name in text for name in self.special):
                yield np.array(self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() + last
                continue
            if len(self.young) > self.most:
                self.old, self.young = self.young, _Words(self._learn)
            yield b"".join([*map(self.young.__getitem__, text.split()), last])


def fillings(lengths: np.ndarray, window: int, partners: int = 6) -> list[tuple[int, ...]]:
    """Combinations of at most four of the lengths that add up to the window."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    found: set[tuple[int, ...]] = set()
    for k in (1, 2, 4):
        if window % k == 0 and have[window // k]:
            found.add((window // k,) * k)
    for a in lengths[::-1].tolist():
        rest = window - a
        if rest > 0 and have[rest]:
            found.add(tuple(sorted((a, rest))))
        # the partners nearest below half of what is left, whose complement is at hand
        near = lengths[(lengths <= rest // 2) & (lengths > 0)][::-1]
        near = near[have[rest - near]][:partners].tolist()
        found.update(tuple(sorted((a, b, rest - b))) for b in near)
        if len(near) < 2:
            for b in lengths[lengths < rest][::-1][:partners].tolist():
                left = rest - b
                third = lengths[lengths <= left // 2][::-1]
                third = third[have[left - third]][:1].tolist()
                found.update(tuple(sorted((a, b, c, left - c))) for c in third)
    return sorted(found)


def least_squares(combos: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Repeats x >= 0 of the combinations that bring their lengths nearest to the counts, by coordinate descent."""
    columns = [np.unique(c, return_counts=True) for c in combos]
    x, rest = np.zeros(len(combos)), counts.astype(float)
    norms = [float((m * m).sum()) for _, m in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, m) in enumerate(columns):
            new = max(0.0, x[j] + float(rest[at] @ m) / norms[j])
            if new != x[j]:
                rest[at] -= m * (new - x[j])
                moved, x[j] = moved + abs(new - x[j]), new
        if moved < 0.5:
            break
    return x


class Plan:
    """Which rank of which length goes where: rows (length, from rank, to rank, begin, size, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], window: int):
        self.window, self.rows, self.sequences = window, [], 0
        self.bins: dict[int, list[list[int]]] = defaultdict(list)  # size: runs of pieces [length, from, to, begin]
        self.left: dict[int, int] = {}
        for size, n in sorted(counts.items()):
            if n and size:
                self.bins[size].append([size, 0, n, 0])
                self.left[size] = n
        self._by_least_squares()
        self._by_greed()
        self._rest()

    def _take(self, size: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
        while n:
            run = self.bins[size][-1]
            k = min(n, run[2] - run[1])
            yield run[0], run[1], run[1] + k, run[3]
            run[1] += k
            n -= k
            if run[1] == run[2]:
                self.bins[size].pop()

    def _place(self, slots: list[tuple[int, int]], n: int) -> None:
        """n sequences with pieces (size of the bin, size used) one after the other; what is cut off goes back to the bins."""
        offset = 0
        for size, used in slots:
            first = self.sequences
            for length, a, b, begin in list(self._take(size, n)):
                self.rows.append((length, a, b, begin, used, first, offset))
                first += b - a
                if used < size:
                    self.bins[size - used].append([length, a, b, begin + used])
                    self.left[size - used] = self.left.get(size - used, 0) + b - a
            offset += used
        self.sequences += n

    def _by_least_squares(self) -> None:
        lengths = np.array(sorted(self.left), np.int64)
        if not len(lengths):
            return
        combos = fillings(lengths, self.window)
        counts = np.zeros(self.window + 1)
        for size, n in self.left.items():
            counts[size] = n
        repeats = np.rint(least_squares(combos, counts)).astype(np.int64) if combos else []
        for j in np.argsort(-np.asarray(repeats), kind="stable"):
            sizes, each = np.unique(combos[j], return_counts=True)
            n = min([int(repeats[j]), *(self.left.get(int(s), 0) // int(k) for s, k in zip(sizes, each, strict=True))])
            if n > 0:
                self._place([(s, s) for s in sorted(combos[j], reverse=True)], n)

    def _by_greed(self) -> None:
        while sum(s * n for s, n in self.left.items()) >= self.window:
            slots: list[tuple[int, int]] = []
            room, used = self.window, defaultdict(int)
            for size in sorted(self.left, reverse=True):
                k = min(room // size, self.left[size])
                slots += [(size, size)] * k
                used[size] += k
                room -= k * size
                if not room:
                    break
            if room:
                free = [s for s, n in self.left.items() if n > used[s] and s > room]
                slots.append((min(free), room))
                used[min(free)] += 1
            self._place(slots, min(self.left[s] // k for s, k in used.items() if k))

    def _rest(self) -> None:
        """Less than a window is left: sequences of the powers of two that add up to it need no padding."""
        total = sum(s * n for s, n in self.left.items())
        for k in reversed(range(self.window.bit_length())):
            if not total >> k & 1:
                continue
            slots, room, used = [], 1 << k, defaultdict(int)
            while room:
                size = max(s for s, n in self.left.items() if n > used[s])
                slots.append((size, min(size, room)))
                used[size] += 1
                room -= min(size, room)
            self._place(slots, 1)

    def arrays(self) -> tuple[np.ndarray, list[list[tuple]]]:
        """Starts of disjoint runs of ranks as length << 44 | rank, and the pieces (begin, size, sequence less rank, offset) of each run."""
        by: dict[int, list[tuple]] = defaultdict(list)
        for row in self.rows:
            by[row[0]].append(row)
        starts, pieces, self.n_cut = [], [], 0
        for length in sorted(by):
            marks = sorted({x for row in by[length] for x in row[1:3]})
            runs: list[list[tuple]] = [[] for _ in marks[:-1]]
            place = {x: i for i, x in enumerate(marks)}
            for _, a, b, begin, size, first, offset in by[length]:
                for i in range(place[a], place[b]):
                    runs[i].append((begin, size, first - a, offset))
            self.n_cut += sum(b - a for a, b, run in zip(marks[:-1], marks[1:], runs, strict=True) if len(run) > 1)
            starts += [length << 44 | x for x in marks[:-1]]
            pieces += [sorted(r) for r in runs]
        return np.array(starts, np.int64), pieces


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, last_id: int = 2, doc_id: str = "doc_id", text: str = "text", most_ids: int = 1_000_000) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and `last_id`; a null text is `last_id` alone. Full windows of a document are sequences of their
    own; what is left of it is packed with others. A row without doc_id is a document like any other. Sequences hold `window` ids, but for those of a power of two that take
    the last ids. A repeated row is packed again, and so is each text of a doc_id that has several. No rows give no pieces. `tokenizer` is the path of a vocabulary whose words hold no white space.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    end = np.array([last_id], "<u4").tobytes()
    step = 4 * window

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.at(tokenizer)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text"), 1 << 21):
                raw = data.tobytes()
                n, full, rest = [], [], []
                for ids in encoder.encode([raw[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], end):
                    whole = len(ids) // step * step
                    n.append(len(ids) // 4)
                    full.append([zlib.crc32(ids[k : k + step]) for k in range(0, whole, step)])
                    rest.append(zlib.crc32(ids[whole:]))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a), "mark": batch.column("mark").slice(a, b - a), "n": n, "full": pa.array(full, pa.list_(pa.int64())), "rest": rest})
        encoder.rest()

    lengths = docs.mapInArrow(lean(measure), "doc_id long, mark long, n long, full array<long>, rest long")
    salts = 8 * shuffle_partitions(spark)
    lengths = lengths.withColumn("r", F.col("n") % window).withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(salts)).cast("int"))
    lengths = scratch.save(lengths.withColumn("n_full", F.size("full").cast("long")), "lengths")
    # A length that a third of the documents have is dealt into salts, each ranked by itself.
    cells = scratch.save(lengths.groupBy("r", "salt").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_full").alias("fulls")), "cells")
    histogram = cells.groupBy("r").agg(F.sum("docs").alias("docs"), F.sum("fulls").alias("fulls")).orderBy("r").collect()
    plan = Plan({row["r"]: row["docs"] for row in histogram}, window)
    base, at = {}, plan.sequences
    for row in histogram:
        base[row["r"]] = at
        at += row["fulls"]
    before = W.partitionBy("r").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("r", "salt", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("fulls_before"))
    own = W.partitionBy("r", "salt").orderBy("doc_id", "n", "rest", "full")
    ranked = lengths.withColumn("k", F.row_number().over(own)).withColumn("f", F.sum("n_full").over(own.rowsBetween(W.unboundedPreceding, -1)))
    ranked = ranked.join(cells, ["r", "salt"]).select(
        "doc_id", "mark", "n", "r", "full", "rest", (F.col("docs_before") + F.col("k") - 1).alias("rank"), (F.col("fulls_before") + F.coalesce("f", F.lit(0))).alias("fulls")
    )
    shared = spark.sparkContext.broadcast((*plan.arrays(), base))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    marked = [*names, "rest", "mark"]  # the sum of the document's ids after its full windows and a hash of its text, by which the text is known again
    kinds = ", ".join(f"{k} long" for k in marked)
    schema = pa.schema([(k, pa.int64()) for k in marked])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, pieces, bases = shared.value
        for batch in batches:
            n, r, rest, rank, fulls, mark = (batch.column(k).to_numpy() for k in ("n", "r", "rest", "rank", "fulls", "mark"))
            ids = batch.column("doc_id").to_pylist()
            run = np.searchsorted(starts, r.astype(np.int64) << 44 | rank, "right") - 1
            out = []
            for k, full in enumerate(batch.column("full").to_pylist()):
                first = bases[int(r[k])] + fulls[k]
                out += [(ids[k], i * window, window, crc, n[k], first + i, 0, rest[k], mark[k]) for i, crc in enumerate(full)]
                if r[k]:
                    parts = pieces[run[k]]
                    for begin, size, sequence, offset in parts:
                        crc = rest[k] if len(parts) == 1 else None
                        out.append((ids[k], n[k] - r[k] + begin, size, crc, n[k], sequence + rank[k], offset, rest[k], mark[k]))
            yield pa.RecordBatch.from_pydict({k: [x[i] for x in out] for i, k in enumerate(marked)}, schema)

    placed = scratch.save(ranked.mapInArrow(assign, kinds), "placed")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last, ids = WordEncoder.at(tokenizer), None, b""
        for batch in batches:
            out = []
            for text, *row in zip(batch.column("text"), *(batch.column(k).to_pylist() for k in marked), strict=True):
                raw = text.as_buffer().to_pybytes()
                if raw != last:
                    (ids,), last = encoder.encode([raw], end), raw
                if len(ids) == 4 * row[4] and zlib.crc32(ids[len(ids) // step * step :]) == row[7]:
                    row[3] = zlib.crc32(ids[4 * row[1] : 4 * (row[1] + row[2])])
                    out.append(row)
            yield pa.RecordBatch.from_pydict({k: [x[i] for x in out] for i, k in enumerate(marked)}, schema)

    # Only documents cut below a window are read again, for the sums of their parts. The plan knows how many: few ids are
    # broadcast, so that other texts aren't shuffled; beyond `most_ids` it is a join of both sides.
    cut = placed.filter("ids_crc32 is null")
    wanted = cut.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    texts = docs.join(F.broadcast(wanted) if plan.n_cut <= most_ids else wanted, same, "left_semi").dropDuplicates(["doc_id", "text"])
    texts = texts.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "text")
    summed = cut.join(texts, same).select(*marked, "text").mapInArrow(lean(sums), kinds).dropDuplicates(["sequence_id", "offset"])
    return placed.filter("ids_crc32 is not null").unionByName(summed).select(*names)
