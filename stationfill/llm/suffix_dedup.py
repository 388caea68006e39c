"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays of shards.

A shard holds the surroundings of content-chosen anchors: every string of `window` bytes contains an anchor, chosen by
its bytes alone, so equal strings have equal anchors and meet in the shard of that anchor's leader. A shard too large
for a task is dealt into parts with a suffix array each, and the sorted windows of the parts are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationfill.llm.blocks import leaders, sub_blocks
from stationfill.llm.common import Scratch, lean, shuffle_partitions
from stationfill.llm.jaccard_join import grouped
from stationfill.llm.textbytes import BASES, PIECE, RollingHash, slices, word_hashes, words

#: Bytes of text that a shard gathers before it is sorted, and three times that a part of a split block; arrays take about 100 times that.
SHARD_BYTES = 1 << 20


class ByteWindows:
    """Every string of `size` bytes that begins at a multiple of `step` in its text."""

    def __init__(self, size: int, step: int = 1):
        self.least = self.most = size
        self.step = step

    def of(self, data: np.ndarray, offsets: np.ndarray, opened: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the windows that lie whole in one of the pieces; opened, closed: whether a piece begins or ends its text."""
        starts = np.flatnonzero(np.arange(len(data), dtype=np.int32) + self.least <= np.repeat(offsets[1:].astype(np.int32), np.diff(offsets)))
        return starts, np.full(len(starts), self.least, np.int32)


class WordWindows:
    """From each word on, `words` words; at least `least` bytes, and at most `most` where the words take more."""

    step = 1

    def __init__(self, words: int = 50, least: int = 200, most: int = 512):
        self.words, self.least, self.most = words, least, most

    def of(self, data: np.ndarray, offsets: np.ndarray, opened: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, piece = words(data, offsets)
        room = offsets[1:][piece] - starts
        # a run at the edge of a piece may be a part of a word
        cut = (ends == offsets[1:][piece]) & ~closed[piece]
        last = np.minimum(np.arange(len(starts)) + self.words - 1, max(len(starts) - 1, 0))
        full = (np.arange(len(starts)) + self.words <= len(starts)) & (piece[last] == piece) & ~cut[last]
        size = np.where(full, np.clip(ends[last] - starts, self.least, self.most), self.most)
        use = (size <= room) & ((starts > offsets[:-1][piece]) | opened[piece])
        return starts[use], size[use]


def _sliding(best: np.ufunc, values: np.ndarray, width: int, neutral: int) -> np.ndarray:
    """Minimum or maximum of each run of `width` values, from running extremes of blocks of that width."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, neutral, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the byte `gram`s that have the least hash of some `window` of a row (all of equal hash).

    A long row is taken in pieces with their surroundings, which are all that an anchor depends on.
    """
    if len(offsets) == 2 and len(data) > 2 * PIECE:
        found = []
        for a in range(0, len(data), PIECE):
            low, high = max(0, a - window), min(len(data), a + PIECE + window)
            at, hashes = anchors(data[low:high], np.array([0, high - low]), window, gram)
            own = (at + low >= a) & (at + low < a + PIECE)
            found.append((at[own] + low, hashes[own]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    n, span = len(data), window - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n - gram + 1)
    hashes = RollingHash(data).of(at, at + gram) >> np.uint64(1)
    top = 2**64 - 1
    inside = at + gram <= ends[: len(at)]
    hashes = np.where(inside, hashes, np.uint64(top))
    least = _sliding(np.minimum, hashes, span, top)
    whole = np.arange(len(least)) + window <= ends[: len(least)]
    least = np.where(whole, least, np.uint64(0))
    around = np.zeros(len(least) + 2 * (span - 1), np.uint64)
    around[span - 1 : span - 1 + len(least)] = least
    chosen = np.flatnonzero((_sliding(np.maximum, around, span, 0) == hashes) & inside & (hashes > 0))
    return chosen, hashes[chosen]


def _opens(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    opens = np.empty(len(values), bool)
    opens[0] = True
    np.not_equal(values[1:], values[:-1], out=opens[1:])
    return opens


def _tied(opens: np.ndarray) -> np.ndarray:
    tied = ~opens
    tied[:-1] |= ~opens[1:]
    return tied


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` bytes at least, and each position's first 8 bytes as a number.

    Prefix doubling by ranks: each round only sorts the suffixes that still share their rank with others. Positions are
    32-bit numbers, since a shard is a few MB.
    """
    n = len(data)
    padded = np.append(data, np.zeros(8, np.uint8))
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word <<= np.uint64(8)
        word |= padded[k : k + n]
    order = np.argsort(word, kind="stable").astype(np.int32)
    opens = _opens(word[order])
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(opens).astype(np.int32)[np.cumsum(opens, dtype=np.int32) - 1]
    places, known = np.flatnonzero(_tied(opens)).astype(np.int32), 8
    while known < depth and len(places):
        those = order[places]
        after = np.where(those + known < n, rank[np.minimum(those + known, n - 1)] + 1, 0)
        key = rank[those].astype(np.int64) * (n + 1) + after
        by = np.argsort(key, kind="stable")
        those, opens = those[by], _opens(key[by])
        order[places] = those
        rank[those] = places[np.flatnonzero(opens)[np.cumsum(opens, dtype=np.int32) - 1]]
        places, known = places[_tied(opens)], known * 2
    return order, word


def common_prefixes(data: np.ndarray, order: np.ndarray, word: np.ndarray, enough: int) -> np.ndarray:
    """For each position the length of the prefix it shares with the suffix before it in the order, exact below `enough` at least.

    In text order a length is the one before less one wherever the neighbour also moves on by one; only the others are compared.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (data[:-1] == data[np.maximum(before[:-1], 0)])
    first = np.flatnonzero(~follows).astype(np.int32)
    runs = np.diff(np.append(first, np.int32(n)))
    length = np.zeros(len(first), np.int32)
    active = np.flatnonzero(before[first] >= 0)
    while len(active):
        a, b = first[active] + length[active], before[first[active]] + length[active]
        inside = np.maximum(a, b) < n
        active, a, b = active[inside], a[inside], b[inside]
        differ = word[a] ^ word[b]
        room = n - np.maximum(a, b)
        same = np.full(len(a), 8, np.int32)
        for k in range(8):
            same[(differ >> np.uint64(8 * k)) & np.uint64(255) > 0] = 7 - k
        same = np.minimum(same, room)
        length[active] += same
        active = active[(same == 8) & (length[active] < enough + runs[active])]
    return np.repeat(length + first, runs) - np.arange(n, dtype=np.int32)


def _covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes under the windows from the sorted `starts` to `ends`."""
    ends = np.maximum.accumulate(ends)
    cut = np.flatnonzero(starts[1:] > ends[:-1])
    return starts[np.append(0, cut + 1)], ends[np.append(cut, len(ends) - 1)]


def _spans(kind: int, ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[dict]:
    """A row for each document: the runs that its windows cover."""
    order = np.lexsort((at, ids))
    ids, at, size = ids[order], at[order], size[order]
    cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
    rows = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        opens, closes = _covered(at[i:j], at[i:j] + size[i:j])
        rows.append({"doc_id": int(ids[i]), "kind": kind, "opens": opens, "closes": closes})
    return rows


class Shard:
    """Pieces (document, start, bytes, owned, last) with overlaps of one document joined, so that each place occurs once.

    owned: how many places of the piece may begin a window; the rest is there for the windows to end in. last: whether the text ends with it.
    """

    def __init__(self, pieces: list[tuple[int, int, bytes, int, bool]]):
        kept: list[list] = []
        for doc, start, raw, owned, last in sorted(pieces, key=lambda x: (x[0], x[1], -len(x[2]))):
            if kept and kept[-1][0] == doc and start <= kept[-1][1] + kept[-1][3]:
                more = start + len(raw) - kept[-1][1] - kept[-1][3]
                if more > 0:
                    kept[-1][2].append(raw[-more:])
                    kept[-1][3] += more
                kept[-1][4] = max(kept[-1][4], start + owned)
                kept[-1][5] |= last
            else:
                kept.append([doc, start, [raw], len(raw), start + owned, last])
        lengths = np.array([x[3] for x in kept])
        self.data = np.frombuffer(b"".join(b for x in kept for b in x[2]), np.uint8)
        self.offsets = np.append(0, np.cumsum(lengths))
        starts = np.array([x[1] for x in kept])
        self.opened, self.closed = starts == 0, np.array([x[5] for x in kept])
        self.doc = np.repeat(np.array([x[0] for x in kept], np.int64), lengths)
        self.at = np.arange(len(self.data)) - np.repeat(self.offsets[:-1] - starts, lengths)
        self.owned = self.at < np.repeat(np.array([x[4] for x in kept]), lengths)

    def windows(self, kind) -> tuple[np.ndarray, np.ndarray]:
        starts, size = kind.of(self.data, self.offsets, self.opened, self.closed)
        own = self.owned[starts] if kind.step == 1 else self.owned[starts] & (self.at[starts] % kind.step == 0)
        return starts[own], size[own]

    def prints(self, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """128 bits of each window, as two columns."""
        return np.stack([RollingHash(self.data, base).of(starts, starts + size) for base in BASES], axis=1)

    def solve(self, kinds: list, split: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each kind: the windows (starts, lengths) that repeat in the shard, and, of a split block, those that may repeat elsewhere (one of each string of bytes)."""
        reach = max(k.most for k in kinds)
        order, word = suffix_array(self.data, reach)
        shared = common_prefixes(self.data, order, word, reach)
        del word
        out = []
        for kind in kinds:
            starts, size = self.windows(kind)
            nothing = starts[:0], size[:0]
            if not len(starts):
                out.append(nothing + nothing)
            elif kind.least == kind.most:
                # suffixes of one run agree in a window's length; its windows count
                run = np.empty(len(order), np.int32)
                run[order] = np.cumsum(shared[order] < kind.least, dtype=np.int32)
                by = run[starts]
                several = np.bincount(by)[by] > 1
                first = np.empty(int(by.max()) + 1, np.int32)
                first[by[::-1]] = np.arange(len(by) - 1, -1, -1, dtype=np.int32)
                one = first[by] == np.arange(len(by)) if split else slice(0, 0)
                out.append((starts[several], size[several], starts[one], size[one]))
            else:
                # lengths differ: who shares that much with a neighbour in the order is compared by prints
                after = np.zeros(len(order), np.int32)
                after[order[:-1]] = shared[order[1:]]
                near = np.flatnonzero(np.maximum(shared[starts], after[starts]) >= size)
                _, group, counts = np.unique(self.prints(starts[near], size[near]), axis=0, return_inverse=True, return_counts=True)
                near = near[counts[group.ravel()] > 1]
                out.append((starts[near], size[near], *((starts, size) if split else nothing)))
        return out


_FOUND = "doc_id long, kind int, opens array<long>, closes array<long>, lead long, bucket int, prints binary, more binary, docs binary, places binary, sizes binary"


def _rows(rows: list[dict]) -> pa.RecordBatch:
    whole = pa.list_(pa.int64())
    kinds = [("doc_id", pa.int64()), ("kind", pa.int32()), ("opens", whole), ("closes", whole), ("lead", pa.int64()), ("bucket", pa.int32())]
    kinds += [(k, pa.binary()) for k in ("prints", "more", "docs", "places", "sizes")]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _several(lists: list[np.ndarray]) -> list[np.ndarray]:
    """For sorted lists of 128-bit prints: which of each list's prints another list has too, by binary search in what the lists before it hold."""
    held, order = np.zeros((0, 2), np.uint64), []
    twice = np.zeros((0, 2), np.uint64)
    for own in lists:
        place = np.minimum(np.searchsorted(held[:, 0], own[:, 0]), max(len(held) - 1, 0))
        hit = (held[place] == own).all(axis=1) if len(held) else np.zeros(len(own), bool)
        twice = np.concatenate([twice, own[hit]])
        held = np.concatenate([held, own[~hit]])
        held = held[np.argsort(held[:, 0], kind="stable")]
    twice = twice[np.argsort(twice[:, 0], kind="stable")]
    for own in lists:
        place = np.minimum(np.searchsorted(twice[:, 0], own[:, 0]), max(len(twice) - 1, 0))
        order.append((twice[place] == own).all(axis=1) if len(twice) else np.zeros(len(own), bool))
    return order


def repeat_spans(docs: DataFrame, kinds: list, gram: int = 64, most: int = 128) -> tuple[DataFrame, DataFrame]:
    """(facts, spans). facts: per row of docs (doc_id, text) its doc_id, n_bytes, sha256, `copied`, true if another document has
    the same bytes, and `windowed`, whether it holds a window of each kind (its copies then repeat whole).
    spans: (doc_id, sha256, kind, opens, closes), the runs of bytes under windows of a kind that repeat, of one document of each text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    least, reach = min(k.least for k in kinds), max(k.most for k in kinds)
    gram = min(gram, least)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                at, hashes = anchors(data, offsets, least, gram)
                cuts = np.searchsorted(at, offsets)
                whole, holds = np.ones(b - a, bool), []
                for kind in kinds:
                    starts = np.flatnonzero(np.diff(offsets) >= kind.least) if kind.least == kind.most else np.searchsorted(offsets, kind.of(data, offsets, whole, whole)[0], "right") - 1
                    holds.append(np.bincount(starts, minlength=b - a) > 0)
                out: dict[str, list] = {"doc_id": batch.column("doc_id").slice(a, b - a), "n_bytes": np.diff(offsets)}
                digests, tokens, again = [], [], []
                for i in range(b - a):
                    digests.append(hashlib.sha256(data[offsets[i] : offsets[i + 1]]).digest())
                    values, counts = np.unique(hashes[cuts[i] : cuts[i + 1]], return_counts=True)
                    tokens.append(values.view(np.int64))
                    again.append(values[counts > 1].view(np.int64))
                out |= {"digest": digests, "windowed": pa.array(np.stack(holds, axis=1).tolist(), pa.list_(pa.bool_()))}
                out |= {"tokens": pa.array(tokens, pa.list_(pa.int64())), "again": pa.array(again, pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(out)

    fields = "doc_id long, n_bytes long, digest binary, windowed array<boolean>, tokens array<long>, again array<long>"
    facts = scratch.save(docs.mapInArrow(lean(describe), fields), "facts")
    # doc_id counts once, however often its row is repeated
    classes = facts.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("doc_id").alias("member"), (F.min("doc_id") < F.max("doc_id")).alias("copied"))
    classes = scratch.save(classes, "classes")
    searched = scratch.save(classes.groupBy("member").agg(F.min("digest").alias("digest")), "searched")
    # Both sides of these joins grow with the documents, so neither is ever broadcast.
    reps = facts.withColumnRenamed("doc_id", "member").hint("merge").join(searched, ["digest", "member"]).select("member", "tokens", "again")
    reps = scratch.save(reps.dropDuplicates(["member"]), "reps")
    postings = reps.select(F.explode("tokens").alias("token"), "member")
    marked = postings.withColumn("again", F.lit(False)).unionByName(reps.select(F.explode("again").alias("token"), "member", F.lit(True).alias("again")))
    found = leaders(marked, scratch, repeats=True)
    pairs = postings.hint("merge").join(found, "token").groupBy("lead", "member").agg(F.collect_list("token").alias("tokens"))
    pairs = scratch.save(pairs.withColumn("weight", F.size("tokens") * (2 * reach - gram)), "pairs")
    scratch.drop("reps", "leaders")
    dealt = sub_blocks(pairs, scratch, most, "weight", 3 * SHARD_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, raw, at, hashes = None, b"", None, None
        names = ["lead", "sub", "n_sub", "member", "start", "raw", "owned", "last"]
        schema = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()], strict=True)))
        for batch in batches:
            rows, size = [], 0
            texts, wanted = batch.column("text"), batch.column("tokens")
            for k, (lead, sub, n_sub, member) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lead", "sub", "n_sub", "member")), strict=True)):
                if member != last:
                    raw, last = texts[k].as_buffer().to_pybytes(), member
                    at, hashes = anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), least, gram)
                tokens = np.sort(wanted[k].values.to_numpy().view(np.uint64))
                if not len(at):
                    continue
                places = at[tokens[np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)] == hashes]
                if not len(places):
                    continue
                # a byte more on either side tells where words begin and end
                opens, closes = np.maximum(places - (reach - gram) - 1, 0), np.minimum(places + reach + 1, len(raw))
                new = np.append(True, opens[1:] > closes[:-1])
                n = 0
                for a, b in zip(opens[new].tolist(), closes[np.append(np.flatnonzero(new)[1:] - 1, len(closes) - 1)].tolist(), strict=True):
                    # a long piece is dealt over the parts of its block; each place begins windows in one of them
                    for c in range(a, b, SHARD_BYTES // 2):
                        end = min(b, c + SHARD_BYTES // 2 + reach + 1)
                        owned = min(b, c + SHARD_BYTES // 2) - c
                        low = max(a, c - 1)
                        piece = raw[low:end]
                        rows.append(dict(zip(names, (lead, (sub + n) % n_sub, n_sub, member, low, piece, owned + c - low, end == len(raw)), strict=True)))
                        n, size = n + (b - a > SHARD_BYTES // 2), size + len(piece)
                        if size > SHARD_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(lead: int | None = None, n_sub: int = 1) -> pa.RecordBatch:
            shard, rows = Shard(held), []
            for k, (starts, sizes, other, other_sizes) in enumerate(shard.solve(kinds, n_sub > 1)):
                rows += _spans(k, shard.doc[starts], shard.at[starts], sizes)
                if n_sub == 1 or not len(other):
                    continue
                prints = shard.prints(other, other_sizes)
                order = np.lexsort((prints[:, 1], prints[:, 0]))
                prints, other, other_sizes = prints[order], other[order], other_sizes[order]
                bucket = (prints[:, 1] % np.uint64(n_sub)).astype(np.int64)
                for j in np.unique(bucket):
                    those = bucket == j
                    packed = (prints[those, 0], prints[those, 1], shard.doc[other[those]], shard.at[other[those]], other_sizes[those].astype(np.int64))
                    rows.append({"kind": k, "lead": lead, "bucket": int(j)} | {n: x.tobytes() for n, x in zip(("prints", "more", "docs", "places", "sizes"), packed, strict=True)})
            return _rows(rows)

        for (lead, _), block in grouped(batches, ["lead", "sub"]):
            n_sub = block.column("n_sub")[0].as_py()
            pieces = list(zip(*(block.column(k).to_pylist() for k in ("member", "start", "raw", "owned", "last")), strict=True))
            more = sum(len(x[2]) for x in pieces)
            if held and (n_sub > 1 or size + more > SHARD_BYTES):
                yield flush()
                held, size = [], 0
            held, size = held + pieces, size + more
            if n_sub > 1:
                yield flush(lead, n_sub)
                held, size = [], 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, kind), block in grouped(batches, ["lead", "bucket", "kind"]):
            read = lambda name, of: [np.frombuffer(x, of) for x in block.column(name).to_pylist()]
            lists = [np.stack(x, axis=1) for x in zip(read("prints", np.uint64), read("more", np.uint64), strict=True)]
            rows = []
            for hit, ids, places, sizes in zip(_several(lists), read("docs", np.int64), read("places", np.int64), read("sizes", np.int64), strict=True):
                rows += _spans(kind, ids[hit], places[hit], sizes[hit])
            yield _rows(rows)

    n = shuffle_partitions(spark)
    texts = docs.select(F.col("doc_id").alias("member"), F.unhex(F.sha2("text", 256)).alias("digest"), "text").hint("merge")
    pieces = dealt.join(searched, "member").join(texts, ["member", "digest"]).select("lead", "sub", "n_sub", "member", "tokens", "text")
    pieces = pieces.mapInArrow(lean(cut), "lead long, sub int, n_sub int, member long, start long, raw binary, owned long, last boolean")
    result = pieces.repartition(n, "lead", "sub").sortWithinPartitions("lead", "sub").mapInArrow(lean(solve), _FOUND)
    result = scratch.save(result, "found")
    scratch.drop("pairs", "splits")
    parts = result.filter("bucket is not null").drop("doc_id", "opens", "closes")
    across = parts.repartition(n, "lead", "bucket").sortWithinPartitions("lead", "bucket", "kind").mapInArrow(lean(merge), _FOUND)
    spans = result.filter("bucket is null").unionByName(across).groupBy("doc_id", "kind").agg(
        F.flatten(F.collect_list("opens")).alias("opens"), F.flatten(F.collect_list("closes")).alias("closes")
    )
    hexed = F.lower(F.hex("digest")).alias("sha256")
    spans = scratch.save(spans.join(searched.select(F.col("member").alias("doc_id"), hexed), "doc_id"), "spans")
    facts = facts.select("doc_id", "n_bytes", "digest", "windowed").join(classes.filter("copied").select("digest", "copied"), "digest", "left")
    facts = scratch.save(facts.select("doc_id", "n_bytes", hexed, "windowed", F.coalesce("copied", F.lit(False)).alias("copied")), "marked")
    scratch.drop("facts", "classes", "searched", "found")
    return facts, spans


def _kept(raw: bytes, opens: np.ndarray, closes: np.ndarray) -> tuple[bytes, int]:
    """What lies outside the spans, and the number of maximal spans."""
    if not len(opens):
        return raw, 0
    order = np.argsort(opens, kind="stable")
    opens, closes = _covered(opens[order], closes[order])
    return b"".join(raw[a:b] for a, b in zip(np.append(0, closes), np.append(opens, len(raw)), strict=True)), len(opens)


#: Passages that count as repeated text beside the byte strings of a fixed length.
PASSAGES = WordWindows()


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def repeat_digests(docs: DataFrame, window: int = 400, passages: WordWindows = PASSAGES, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removing every byte under a `window`-byte string that also
    starts elsewhere; then passage_bytes and has_passage, the bytes under windows of `passages` that also start elsewhere.

    Null text is empty; texts without a window lose nothing. Repeated rows of one doc_id are one document and no repeat of
    each other. Where rows of one doc_id differ in text, the text of the least SHA-256 stands for the document, the others lose nothing
    unless another document has all their bytes. A row without doc_id loses nothing.
    """
    docs = _slim(docs, doc_id, text)
    facts, spans = repeat_spans(docs, [ByteWindows(window), passages], **options)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch.column("doc_id"), "sha256": batch.column("sha256"), "gone": [], "n_spans": [], "kept": [], "passage": []}
            for raw, kinds, opens, closes in zip(batch.column("text"), *(batch.column(k).to_pylist() for k in ("kinds", "opens", "closes")), strict=True):
                raw = raw.as_buffer().to_pybytes()
                left, runs, digest = [len(raw)] * 2, [0, 0], None
                for k, a, b in zip(kinds, opens, closes, strict=True):
                    kept, runs[k] = _kept(raw, np.array(a, np.int64), np.array(b, np.int64))
                    left[k] = len(kept)
                    digest = hashlib.sha256(kept).hexdigest() if k == 0 else digest
                out["gone"].append(len(raw) - left[0])
                out["passage"].append(len(raw) - left[1])
                out["n_spans"].append(runs[0])
                out["kept"].append(digest)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("sha256", pa.string()), ("gone", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string()), ("passage", pa.int64())]))

    key = ["doc_id", "sha256"]
    marks = spans.groupBy(*key).agg(*(F.collect_list(F.struct("kind", "opens", "closes"))[c].alias(n) for c, n in (("kind", "kinds"), ("opens", "opens"), ("closes", "closes"))))
    marks = marks.join(facts.filter("not copied").select(*key).distinct(), key, "left_semi")
    partly = docs.withColumn("sha256", F.sha2("text", 256)).hint("merge").join(marks, key).select(*key, "text", "kinds", "opens", "closes")
    partly = partly.mapInArrow(lean(measure), "doc_id long, sha256 string, gone long, n_spans long, kept string, passage long").dropDuplicates(key)
    joined = facts.join(partly, key, "left")
    empty = hashlib.sha256(b"").hexdigest()
    whole = [F.col("copied") & F.col("windowed")[k] for k in (0, 1)]
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(whole[0], F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(whole[0], F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole[0], F.lit(empty)).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
        F.when(whole[1], F.col("n_bytes")).otherwise(F.coalesce("passage", F.lit(0))).alias("passage_bytes"),
        (whole[1] | (F.coalesce("passage", F.lit(0)) > 0)).alias("has_passage"),
    )


def without_repeats(docs: DataFrame, windows: ByteWindows | WordWindows = PASSAGES, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with all bytes under repeated `windows` cut out of `text`, all rows and columns kept; of a character cut in part nothing stays.

    A text that another document has whole becomes empty if it holds a window. Repeated, differing and missing doc_ids as in repeat_digests.
    """
    facts, spans = repeat_spans(_slim(docs, doc_id, text), [windows], **options)
    copied = facts.filter(F.col("copied") & F.col("windowed")[0]).select("doc_id", "sha256").distinct().withColumn("whole", F.lit(True))
    marks = copied.join(spans.drop("kind"), ["doc_id", "sha256"], "full")
    marks = marks.select(F.col("doc_id").alias("_id"), F.col("sha256").alias("_sha256"), F.col("whole").alias("_whole"), F.col("opens").alias("_opens"), F.col("closes").alias("_closes"))
    same = (docs[doc_id].cast("long") == marks["_id"]) & (F.sha2(F.coalesce(docs[text], F.lit("")), 256) == marks["_sha256"])
    joined = docs.hint("merge").join(marks, same, "left")
    names, at = docs.columns, docs.columns.index(text)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in range(len(names))]
            texts = []
            for raw, whole, opens, closes in zip(columns[at], *(batch.column(len(names) + k) for k in (2, 3, 4)), strict=True):
                if whole.as_py():
                    texts.append("" if raw.is_valid else None)
                elif opens.is_valid and raw.is_valid:
                    kept, _ = _kept(raw.as_buffer().to_pybytes(), opens.values.to_numpy(), closes.values.to_numpy())
                    texts.append(kept.decode("utf-8", "ignore"))
                else:
                    texts.append(raw.as_py())
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(lean(strip), docs.schema)


#: Bytes of a word's code. Fifty codes would all have to agree for a passage to be taken for another.
CODE = 5


def _codes(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """For each row the codes of its words, one after the other."""
    starts, ends, rows = words(data, offsets)
    codes = word_hashes(data, starts, ends).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE]
    cuts = CODE * np.searchsorted(rows, np.arange(len(offsets)))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(codes.tobytes())])


def without_repeated_passages(docs: DataFrame, n_words: int = 50, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with every passage of `n_words` words that also begins elsewhere cut out of `text`, all rows and columns kept.

    Words are runs without white space, of any length in bytes; which white space parts them makes no difference. A text is
    searched as the codes of its words, so a passage is a byte string of a fixed length. Cut passages that overlap or touch go
    as one, from their first letter to their last; white space around them stays. A text that another document has whole, but for white space,
    becomes empty if it holds a passage. Null stays null. Repeated, differing and missing doc_ids as in repeat_digests.
    """
    slim = _slim(docs, doc_id, text).withColumn("own", F.sha2("text", 256))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                columns = [batch.column(c).slice(a, b - a) for c in ("doc_id", "own")]
                yield pa.RecordBatch.from_arrays([*columns, _codes(data, offsets)], ["doc_id", "own", "text"])

    coded = slim.select("doc_id", "own", "text").mapInArrow(lean(encode), "doc_id long, own string, text binary")
    scratch = Scratch(docs.sparkSession, "passages")
    names = scratch.save(coded.select("doc_id", "own", F.sha2("text", 256).alias("sha256")).filter("doc_id is not null").distinct(), "names")
    facts, spans = repeat_spans(coded.select("doc_id", "text"), [ByteWindows(n_words * CODE, CODE)], **options)
    copied = facts.filter(F.col("copied") & F.col("windowed")[0]).select("doc_id", "sha256").distinct().withColumn("whole", F.lit(True))
    marks = copied.join(spans.drop("kind"), ["doc_id", "sha256"], "full").join(names, ["doc_id", "sha256"])
    marks = marks.select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"), F.col("whole").alias("_whole"), F.col("opens").alias("_opens"), F.col("closes").alias("_closes"))
    same = (docs[doc_id].cast("long") == marks["_id"]) & (F.sha2(F.coalesce(docs[text], F.lit("")), 256) == marks["_own"])
    joined = docs.hint("merge").join(marks, same, "left")
    columns_of, at = docs.columns, docs.columns.index(text)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in range(len(columns_of))]
            texts = []
            for raw, whole, opens, closes in zip(columns[at], *(batch.column(len(columns_of) + k) for k in (2, 3, 4)), strict=True):
                if whole.as_py():
                    texts.append("" if raw.is_valid else None)
                elif opens.is_valid and raw.is_valid:
                    body = raw.as_buffer().to_pybytes()
                    starts, ends, _ = words(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
                    first, last = opens.values.to_numpy() // CODE, closes.values.to_numpy() // CODE - 1
                    order = np.argsort(first, kind="stable")
                    first, after = _covered(first[order], last[order] + 1)
                    kept, _ = _kept(body, starts[first], ends[after - 1])
                    texts.append(kept.decode("utf-8", "ignore"))
                else:
                    texts.append(raw.as_py())
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=columns_of)

    return joined.mapInArrow(lean(strip), docs.schema)
