"""Exact set-similarity join of word shingles: prefix keys find blocks, a prefix tree joins each block."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationfill.llm.blocks import asked_for, leaders
from stationfill.llm.common import Scratch, lean, shuffle_partitions
from stationfill.llm.components import components, joined_components
from stationfill.llm.textbytes import shingle_sets, slices


class Groups:
    """Union-find over positions."""

    def __init__(self, labels):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


class PrefixTree:
    """Sets as root-to-end paths of shared elements, the most frequent element first, so that like sets share long paths.

    An element that only one set holds can't be in any overlap; it counts in the set's size alone.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = np.flatnonzero(counts > 1)
        rank = np.full(len(values), -1, np.int64)
        rank[common[np.argsort(-counts[common], kind="stable")]] = np.arange(len(common))
        self.width = len(common)
        ranks, owner = rank[inverse], np.repeat(np.arange(len(sets)), self.sizes)
        ranks, owner = ranks[ranks >= 0], owner[ranks >= 0]
        order = np.lexsort((ranks, owner))
        cuts = np.searchsorted(owner[order], np.arange(len(sets) + 1))
        self.paths = [ranks[order[cuts[i] : cuts[i + 1]]] for i in range(len(sets))]
        self.order = sorted(range(len(sets)), key=lambda i: self.paths[i].astype(">u4").tobytes())
        self.lengths = np.array([len(self.paths[i]) for i in self.order], np.int64)
        self.ordered_sizes = self.sizes[self.order]
        self.shared = np.zeros(len(sets), np.int64)  # with the path before it
        for k in range(1, len(sets)):
            a, b = self.paths[self.order[k - 1]], self.paths[self.order[k]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.shared[k] = differ[0] if len(differ) else n

    def links(self, num: int, den: int, groups: Groups, probes: list[int]) -> Iterator[tuple[int, int]]:
        """Pairs (probe, set) with num/den similarity at least that join two groups; all probes walk down the tree together."""
        step = max(1, (1 << 25) // max(1, self.width))
        for at in range(0, len(probes), step):
            chosen = np.array(probes[at : at + step])
            holds = np.zeros((len(chosen), self.width), bool)
            for k, i in enumerate(chosen):
                holds[k, self.paths[i]] = True
            everyone = np.arange(len(chosen))
            stack = [(0, len(self.order), 0, everyone, np.zeros(len(chosen), np.int64))]
            while stack:
                low, high, depth, active, overlap = stack.pop()
                if high - low == 1:
                    end = self.lengths[low]
                else:
                    end = min(self.shared[low + 1 : high].min(), self.lengths[low])
                if end > depth:
                    edge = self.paths[self.order[low]][depth:end]
                    part = holds[:, edge] if len(active) == len(chosen) else holds[np.ix_(active, edge)]
                    overlap = overlap + part.sum(axis=1)
                least, largest = self.ordered_sizes[low:high].min(), self.ordered_sizes[low:high].max()
                rest = self.lengths[low:high].max() - end
                own = self.sizes[chosen[active]]
                may = ((overlap + rest) * (num + den) >= num * (own + least)) & (largest * den >= num * own) & (own * den >= num * least)
                if not may.all():
                    active, overlap = active[may], overlap[may]
                if not len(active):
                    continue
                while low < high and self.lengths[low] == end:
                    i = self.order[low]
                    for k in active[overlap * (num + den) >= num * (self.sizes[chosen[active]] + self.sizes[i])]:
                        j = int(chosen[k])
                        a, b = groups.find(i), groups.find(j)
                        if a != b:
                            groups.up[max(a, b)] = min(a, b)
                            yield j, i
                    low += 1
                if low < high:
                    cuts = [low, *(low + 1 + np.flatnonzero(self.shared[low + 1 : high] == end)), high]
                    stack.extend((int(a), int(b), int(end), active, overlap) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in sorted batches; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a].item() for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def required(size: int, num: int, den: int) -> int:
    """The least overlap with any set that can be similar to one of this size."""
    return -(-num * size // den)


def prefix(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """The first size - required + 1 tokens in the global order: similar sets have one of these in common.

    The order is the token's count where it is frequent, else 0, then the token; so what many documents share comes last.
    """
    keep = len(tokens) - required(len(tokens), num, den) + 1
    if not len(tokens) or not len(frequent[0]):
        return tokens[:keep]
    place = np.minimum(np.searchsorted(frequent[0], tokens), len(frequent[0]) - 1)
    counts = np.where(frequent[0][place] == tokens, frequent[1][place], 0)
    return tokens[np.lexsort((tokens, counts))[:keep]]


def parity_map(tokens: np.ndarray) -> bytes:
    """Bit i: whether an odd number of tokens ends in the bits i. Two to four bits a token, the count of bits a power of two.

    Each token that only one of two sets holds flips one bit, so the number of differing bits is at most that of such tokens.
    """
    bits = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def alike(sizes: np.ndarray, maps: list[bytes], labels: np.ndarray, probes: np.ndarray, num: int, den: int) -> Groups:
    """Groups of sets that the bound of their parity maps lets be similar, by pairs of different label with a probe among them."""
    groups = Groups(range(len(sizes)))
    widths = np.array([len(x) for x in maps])
    rows = {w: np.frombuffer(b"".join(maps[i] for i in np.flatnonzero(widths == w)), np.uint64).reshape(-1, w // 8) for w in np.unique(widths)}
    for narrow in rows:
        for wide in (w for w in rows if w >= narrow):
            mine, other, folded = np.flatnonzero(widths == narrow), np.flatnonzero(widths == wide), rows[wide]
            if sizes[mine].max() * den < num * sizes[other].min():
                continue
            while folded.shape[1] > narrow // 8:
                half = folded.shape[1] // 2
                folded = folded[:, :half] ^ folded[:, half:]
            for k, i in enumerate(mine):
                j = other[k + 1 :] if narrow == wide else other
                j_rows = folded[k + 1 :] if narrow == wide else folded
                use = (labels[j] != labels[i]) & (probes[j] | probes[i]) & (np.maximum(sizes[j], sizes[i]) * num <= np.minimum(sizes[j], sizes[i]) * den)
                if not use.any():
                    continue
                j = j[use]
                both = sizes[j] + sizes[i]
                apart = np.bitwise_count(j_rows[use] ^ rows[narrow][k]).sum(axis=1, dtype=np.int64)
                for x in j[(both - apart) * (num + den) >= 2 * num * both].tolist():
                    a, b = groups.find(int(i)), groups.find(x)
                    groups.up[max(a, b)] = min(a, b)
    return groups


def frequent_shingles(docs: DataFrame, width: int, share: int = 2000, local: int = 4, unit: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than one in `share` documents hold, and about how many hold them.

    Counted over every document; a task reports those that stand out in each run of `unit` shingles, so at most `share` times the mean
    size of a document's set comes to the driver. It only sets an order: any order gives the same links.
    """

    def standing(held: list[np.ndarray], n: int) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        there = counts >= max(local, n / (2 * share))
        return pa.RecordBatch.from_pydict({"token": values[there].view(np.int64), "n": counts[there].astype(np.int64)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                for tokens in shingle_sets(data, offsets, width):
                    held.append(tokens)
                    size += len(tokens)
                n += b - a
                if size > unit:
                    yield standing(held, n)
                    held, n, size = [], 0, 0
        yield standing(held, n)

    total = docs.count()
    seen = docs.select("text").mapInArrow(lean(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = seen.filter(F.col("n") >= F.lit(max(4 * local, total / share))).toArrow()
    tokens = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("n").to_numpy().astype(np.int64)[order]


def similarity_components(
    docs: DataFrame,
    width: int,
    num: int,
    den: int,
    doc_id: str = "doc_id",
    text: str = "text",
    most: int = 128,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, the smallest doc_id that links of similarity num/den reach.

    Null text, or text without words, has no shingles and links with nothing. Documents with equal sets are one class and
    only the class's smallest doc_id is joined. Repeated rows of a doc_id get the same answer; no rows give no rows. A row
    without doc_id has the component of the documents of its set, null if there are none, and links with no other.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, width))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(a, b - a)
                sizes, marks, prefixes, maps = [], [], [], []
                for i, tokens in zip(ids.to_pylist(), shingle_sets(data, offsets, width), strict=True):
                    sizes.append(len(tokens))
                    marks.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else str(i).encode())
                    maps.append(parity_map(tokens))
                    prefixes.append(prefix(tokens, frequent.value, num, den).view(np.int64))
                cuts = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(maps, pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))],
                    ["doc_id", "n_shingles", "mark", "map", "prefix"],
                )

    sets = scratch.save(docs.mapInArrow(lean(describe), "doc_id long, n_shingles long, mark binary, map binary, prefix array<long>"), "sets")
    classes = scratch.save(sets.groupBy("mark").agg(F.min("doc_id").alias("rep")), "classes")
    rows = sets.count()
    # What no class is named after goes before it is sent; the few such rows that the filter lets pass are linked to their class once more.
    reps = asked_for(sets.select(F.col("doc_id").alias("member"), "mark", "prefix", "n_shingles"), ["member", "mark"], classes.select(F.col("rep").alias("member"), "mark"), rows)
    postings = reps.select(F.explode("prefix").alias("token"), "member", "n_shingles")
    found = leaders(postings, scratch)
    pairs = scratch.save(postings.hint("merge").join(found, "token").select("lead", "member", "n_shingles").distinct(), "pairs")
    scratch.drop("leaders")
    dealt, splits = _deal(pairs, scratch, most, num, den)
    dealt = scratch.save(dealt, "dealt")
    scratch.drop("pairs")
    texts = docs.withColumnRenamed("doc_id", "member")
    maps = sets.select(F.col("doc_id").alias("member"), "n_shingles", "map")
    n = shuffle_partitions(spark)

    def narrow(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
        for _, block in grouped(batches, keys):
            labels, probes = block.column("label").to_numpy(), block.column("role").to_numpy() > 0
            groups = alike(block.column("n_shingles").to_numpy(), block.column("map").to_pylist(), labels, probes, num, den)
            roots = np.array([groups.find(i) for i in range(len(labels))])
            several = np.bincount(roots, minlength=len(roots))[roots] > 1
            if several.any():
                kept = block.drop_columns(["n_shingles", "map"]).append_column("root", pa.array(roots.astype(np.int32)))
                yield from kept.filter(pa.array(several)).combine_chunks().to_batches()

    def solve(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
        for _, block in grouped(batches, keys):
            members, labels, roles = (block.column(k).to_numpy() for k in ("member", "label", "role"))
            if len(np.unique(labels)) < 2:
                continue
            own = [x for _, _, data, offsets in slices(block.column("text"), 1 << 22) for x in shingle_sets(data, offsets, width)]
            probes = np.flatnonzero(roles).tolist()
            made = [(int(members[i]), int(members[j])) for i, j in PrefixTree(own).links(num, den, Groups(labels.tolist()), probes)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in made], pa.int64()), "b": pa.array([x for _, x in made], pa.int64())})

    def joined(asked: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Links within the blocks of `keys`: parity maps tell which members can have one, and only their texts are sent."""
        mapped = asked.join(asked_for(maps, ["member"], asked, rows).hint("merge"), "member").repartition(n, *keys).sortWithinPartitions(*keys)
        kinds = ", ".join(f"{k} {t}" for k, t in asked.dtypes) + ", root int"
        order = [k for k, _ in asked.dtypes]
        near = mapped.select(*order, "n_shingles", "map").mapInArrow(lean(lambda batches: narrow(batches, keys)), kinds)
        near, within = scratch.save(near, name), [*keys, "root"]
        full = near.join(asked_for(texts, ["member"], near, rows).hint("merge"), "member").repartition(n, *within).sortWithinPartitions(*within)
        return full.mapInArrow(lean(lambda batches: solve(batches, within)), "a long, b long")

    first = dealt.select("lead", "band", "sub", "member", F.col("member").alias("label"), F.col("home").alias("role"))
    edges = scratch.save(joined(first, ["lead", "band", "sub"], "near"), "edges")
    scratch.drop("near")
    within = components(edges, scratch, "within")
    scratch.drop("edges")
    if not splits.isEmpty():
        across = scratch.save(_across(dealt, within, scratch, most), "across")
        edges = scratch.save(joined(across, ["lead", "band", "sub", "part"], "near-2"), "edges-2")
        scratch.drop("across", "near-2", "members", "main")
        within = joined_components(within, edges, scratch, "whole")
        scratch.drop("edges-2", "within-out")
    scratch.drop("dealt", "sizes")
    named = classes.join(within, classes["rep"] == within["id"], "left").select("mark", F.coalesce("component", "rep").alias("component_id"))
    named = scratch.save(named, "named")
    found = sets.select("doc_id", "n_shingles", "mark").hint("merge").join(named, "mark").select("doc_id", "n_shingles", "component_id")
    found = scratch.save(found, "components")
    scratch.drop("sets", "classes", "named", "within-out", "whole-joined")
    return found


def _deal(pairs: DataFrame, scratch: Scratch, most: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """pairs with columns band, home, sub, n_sub and hub, and a table of the blocks that are split (n_sub over 1).

    Similar sets differ in size by num/den at most, so they are in the same band of sizes or in adjacent ones: a member goes
    to the block of its own band (home 1) and of the next (home 0). Two that are not at home meet in the band before, so a block
    without any at home isn't made, and elsewhere only pairs with one at home are compared. A block of more than `most` members is dealt into n_sub parts by a hash
    of the member; its smallest member, the hub, goes to each part, so that what is like it is found in each.
    """
    band = F.floor(F.ln("n_shingles") / F.lit(math.log(den / num) * (1 + 1e-9))).cast("int") if num < den else F.col("n_shingles").cast("int")
    places = F.array(*(F.struct((band + k).alias("band"), F.lit(1 - k).alias("home")) for k in (0, 1)))
    banded = pairs.select("*", F.inline(places))
    key = ["lead", "band"]
    sizes = banded.groupBy(*key).agg(F.count(F.lit(1)).alias("n_all"), F.max("home").alias("lived_in"), F.min("member").alias("hub"))
    sizes = sizes.filter("n_all > 1 and lived_in = 1").withColumn("n_sub", F.ceil(F.col("n_all") / F.lit(most)).cast("int"))
    sizes = scratch.save(sizes.drop("n_all", "lived_in"), "sizes")
    own = F.pmod(F.xxhash64("member"), F.col("n_sub")).cast("int")
    every = F.when(F.col("member") == F.col("hub"), F.sequence(F.lit(0), F.col("n_sub") - 1)).otherwise(F.array(own))
    dealt = banded.join(sizes, key).withColumn("sub", F.explode(every)).select(*key, "home", "sub", "member", "n_sub", "hub")
    return dealt, sizes.filter("n_sub > 1")


def _across(dealt: DataFrame, within: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """Of split blocks, what may still link across their parts: members outside the block's largest component against every part.

    Both sides come in parts of bounded size; the pairs of parts are tasks, and no pair of documents is a row.
    """
    within = within.withColumnRenamed("id", "member")
    key = ["lead", "band"]
    members = dealt.filter("n_sub > 1").join(within, "member", "left").withColumn("label", F.coalesce("component", "member")).drop("component")
    members = scratch.save(members, "members")
    once = members.filter((F.col("member") != F.col("hub")) | (F.col("sub") == 0))
    sizes = once.groupBy(*key, "label").count()
    largest = sizes.groupBy(*key).agg(F.max(F.struct("count", "label"))["label"].alias("main"), F.sum("count").alias("n_all"), F.max("count").alias("n_main"))
    largest = largest.filter("n_all > n_main").withColumn("parts", F.ceil((F.col("n_all") - F.col("n_main")) / F.lit(most)).cast("int"))
    once = once.join(scratch.save(largest, "main"), key)
    part = F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")
    others = once.filter("label <> main").withColumn("part", part).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n_sub") - 1)))
    against = once.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["lead", "band", "sub", "part", "member", "label"]
    return others.select(*columns, F.lit(1).alias("role")).unionByName(against.select(*columns, F.lit(0).alias("role")))
