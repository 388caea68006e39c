"""Byte-level BPE by recursive DuckDB queries within each task, and decoding by ordered aggregation.

Rows are (word, position, id). A step joins each row and its successor with the merge table, and contracts each word's
leftmost pair of the least rank; the recursion ends when no word has a pair left. Spark deals the texts out; a task
contracts each distinct word once and keeps a bounded memory of words. A recursion of n steps keeps the rows of all of them,
n * n for a word of n bytes: words over LONG bytes take the same contractions from a heap of pairs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationfill.llm.textbytes import slices

_loaded: dict[tuple, object] = {}

#: One contraction a word and step. A row also has the next row's place and id, and the rank t of the pair it begins, so
#: a step needs no order: the least pair of each word comes from a grouping, its second row gives the new neighbour.
STEP = """
WITH RECURSIVE step(n, w, p, follows, id, after, t) AS (
  SELECT 0, w, p, follows, id, after, t
  FROM (SELECT *, lead(p) OVER o AS follows, lead(id) OVER o AS after FROM start WINDOW o AS (PARTITION BY w ORDER BY p)) s
  LEFT JOIN merges m ON m.pair = (s.id::BIGINT << 32) | s.after
  UNION ALL
  SELECT n, w, p, follows, id, after, m.t
  FROM (
    SELECT s.n + 1 AS n, s.w, s.p,
      CASE WHEN s.p = spot THEN next_follows ELSE s.follows END AS follows,
      CASE WHEN s.p = spot THEN token ELSE s.id END AS id,
      CASE WHEN s.p = spot THEN next_after WHEN s.follows = spot THEN token ELSE s.after END AS after
    FROM step s
    JOIN (
      SELECT c.w, spot, token, gone, b.follows AS next_follows, b.after AS next_after
      FROM (
        SELECT w, best & 16777215 AS spot, best >> 24 AS token, gone
        FROM (
          SELECT w, min((t::BIGINT << 24) | p) AS best, arg_min(follows, (t::BIGINT << 24) | p) AS gone
          FROM step WHERE t IS NOT NULL AND n < $most GROUP BY w)) c
      JOIN step b ON b.w = c.w AND b.p = c.gone
    ) g ON g.w = s.w
    WHERE s.p <> g.gone
  ) r
  LEFT JOIN merges m ON m.pair = (r.id::BIGINT << 32) | r.after
)
SELECT n, w, p, id FROM step SEMI JOIN (SELECT w, max(n) AS n FROM step GROUP BY w) l USING (w, n) ORDER BY w, p
"""

WHOLE = "SELECT w, 0::INTEGER AS p, id FROM words JOIN vocabulary USING (raw)"

DECODE = "SELECT count(*) AS n, unhex(string_agg(v.hex, '' ORDER BY p)) AS raw FROM tokens JOIN vocabulary v USING (id) GROUP BY w ORDER BY w"

#: Bytes of a word above which a heap of pairs replaces the recursion, and words that a query takes.
LONG = 256
WORDS = 50_000

#: A space that white space or the end follows (more than that does no harm).
LOOSE = r" ([\s\v\pZ\x{1c}-\x{1f}\x{85}]|$)"


def contracted(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Contracts the leftmost pair of the least rank until none is left: a heap of (rank, place), and links to the places on both sides."""
    n = len(ids)
    follows, before = array("l", range(1, n + 1)), array("l", range(-1, n - 1))
    heap = [t << 32 | p for p in range(n - 1) if (t := merges.get(ids[p] << 32 | ids[p + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        t, p = top >> 32, top & 0xFFFFFFFF
        q = follows[p]
        if ids[p] < 0 or q == n or merges.get(ids[p] << 32 | ids[q]) != t:
            continue  # one of the two has been contracted meanwhile
        ids[p], ids[q], r = t, -1, follows[q]
        follows[p] = r
        if r < n:
            before[r] = p
            if (new := merges.get(t << 32 | ids[r])) is not None:
                heapq.heappush(heap, new << 32 | p)
        if before[p] >= 0 and (new := merges.get(ids[before[p]] << 32 | t)) is not None:
            heapq.heappush(heap, new << 32 | before[p])
    return [x for x in ids if x >= 0]


class Memory:
    """Ids and decoded bytes by text, in two generations: a full one becomes the older, and keys still in use move to the younger."""

    def __init__(self, most: int):
        self.young: tuple[dict, dict] = {}, {}
        self.old: tuple[dict, dict] = {}, {}
        self.most = most

    def turn(self) -> None:
        if len(self.young[0]) > self.most:
            self.old, self.young = self.young, ({}, {})

    def missing(self, keys: set) -> list:
        """The keys that neither generation has; until the next turn all others are in the younger."""
        unknown = keys - self.young[0].keys()
        again = unknown & self.old[0].keys()
        for young, old in zip(self.young, self.old, strict=True):
            young.update((x, old[x]) for x in again)
        return list(unknown - again)


class Encoder:
    """Merges and vocabulary of a rank file in a DuckDB connection, and a memory of parts of texts: their ids and decoded bytes."""

    def __init__(self, path: str, pattern: str, most: int = 200_000, rows: int = 3_000_000):
        import duckdb
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.split, self.rows = regex.compile(pattern), rows
        self.gap = regex.compile(r" (?=\S)")
        self.bytes_of = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[token[:k]] << 32 | ranks[token[k:]], t) for token, t in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self._table("merges", pair=pa.array([p for p, _ in pairs], pa.int64()), t=pa.array([t for _, t in pairs], pa.int32()))
        self._table("vocabulary", id=pa.array(list(ranks.values()), pa.int32()), raw=pa.array(list(ranks), pa.binary()), hex=[x.hex() for x in ranks])
        self.memory = Memory(most)

    @cached_property
    def merges(self) -> dict[int, int]:
        """Ranks by pair, for the heap; the recursion has them as a table."""
        found = self.duck.sql("SELECT pair, t FROM merges").to_arrow_table()
        return dict(zip(found.column("pair").to_pylist(), found.column("t").to_pylist(), strict=True))

    @staticmethod
    def at(path: str, pattern: str) -> Encoder:
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = Encoder(path, pattern)
        return _loaded[path, pattern]

    def _table(self, name: str, **columns) -> None:
        self.duck.register("given", pa.table(columns))
        self.duck.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given").fetchall()
        self.duck.unregister("given")

    def _contract(self, w: np.ndarray, raws: list[bytes]) -> Iterator[pa.Table]:
        """(w, p, id) of all words; a query runs so many steps that its rows fit, and what isn't finished goes on."""
        lengths = np.array([len(x) for x in raws])
        p = (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        rows = pa.table({"w": np.repeat(w, lengths), "p": p, "id": self.bytes_of[np.frombuffer(b"".join(raws), np.uint8)]})
        while rows.num_rows:
            most = max(8, self.rows // rows.num_rows)
            self._table("start", w=rows.column("w"), p=rows.column("p"), id=rows.column("id"))
            found = self.duck.sql(STEP.replace("$most", str(most))).to_arrow_table()
            over = found.column("n").to_numpy() < most
            yield found.filter(pa.array(over)).select(["w", "p", "id"])
            rows = found.filter(pa.array(~over)).select(["w", "p", "id"])

    def words(self, words: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids (little-endian, 32 bits each) and the bytes they decode to, of distinct matches of the pattern."""
        raws = [x.encode() for x in words]
        self._table("words", w=np.arange(len(raws), dtype=np.int32), raw=pa.array(raws, pa.binary()))
        tokens = [self.duck.sql(WHOLE).to_arrow_table()]
        rest = np.ones(len(raws), bool)
        rest[tokens[0].column("w").to_numpy()] = False
        long = np.fromiter((len(x) > LONG for x in raws), bool, len(raws))
        if (rest & ~long).any():
            w = np.flatnonzero(rest & ~long).astype(np.int32)
            tokens += self._contract(w, [raws[i] for i in w.tolist()])
        for i in np.flatnonzero(rest & long).tolist():
            ids = np.array(contracted(self.bytes_of[np.frombuffer(raws[i], np.uint8)].tolist(), self.merges), np.int32)
            tokens.append(pa.table({"w": np.full(len(ids), i, np.int32), "p": np.arange(len(ids), dtype=np.int32), "id": ids}))
        tokens = pa.concat_tables(tokens)
        self._table("tokens", w=tokens.column("w"), p=tokens.column("p"), id=tokens.column("id"))
        back = self.duck.sql(DECODE).to_arrow_table()
        tokens = self.duck.sql("SELECT id FROM tokens ORDER BY w, p").to_arrow_table()
        cuts = np.append(0, np.cumsum(back.column("n").to_numpy())) * 4
        ids = pa.py_buffer(tokens.column("id").to_numpy().astype("<i4").tobytes())
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(raws), [None, pa.py_buffer(cuts.astype(np.int32)), ids])
        return ids.to_pylist(), back.column("raw").to_pylist()

    def match(self, part: str) -> list[str]:
        """The pattern's matches in a part of a text. A space and letters with a mark after them are two: no search is needed."""
        if part[:1] == " " and part[-1] in ".,;:!?" and part[1:-1].isalpha():
            return [part[:-1], part[-1]]
        return self.split.findall(part)

    def learn(self, parts: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """The memory with all parts of texts in it: a part has the ids and bytes of its matches one after the other."""
        memory = self.memory
        memory.turn()
        new: set[str] = set()
        several: dict[str, list[str]] = {}
        for x in memory.missing(set(parts)):
            if x[:1] == " " and x[1:].isalpha():
                new.add(x)
                continue
            matches = self.match(x)
            if len(matches) != 1:
                several[x] = matches
            new.update(matches)
        missing = memory.missing(new)
        for at in range(0, len(missing), WORDS):
            some = missing[at : at + WORDS]
            for held, values in zip(memory.young, self.words(some), strict=True):
                held.update(zip(some, values, strict=True))
        for held in memory.young:
            held.update((x, b"".join([held[w] for w in matches])) for x, matches in several.items())
        return memory.young

    def cut(self, texts: pa.StringArray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct parts of the texts, the number of each part in their order, and where each text begins there.

        No match reaches over a space that a non-white character follows, so the texts are cut before those.
        """
        odd = pc.match_substring_regex(texts, LOOSE)
        lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        rest = [self.gap.split(x) for x in texts.filter(odd).to_pylist()]  # a space before white space stays in its part
        flat = pa.concat_arrays([lists.flatten(), pa.array([x for parts in rest for x in parts], pa.string())]).dictionary_encode()
        own = np.append(np.diff(lists.offsets.to_numpy()), [len(x) for x in rest]).astype(np.int64)
        place = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
        sizes, begins = np.empty_like(own), np.empty_like(own)
        sizes[place], begins[place] = own, np.cumsum(own) - own
        cuts = np.append(0, np.cumsum(sizes))
        if len(rest):
            flat = flat.take(pa.array(np.arange(cuts[-1]) + np.repeat(begins - cuts[:-1], sizes)))
        first = flat.take(pa.array(cuts[:-1])).to_pylist()
        parts = [" " + x for x in flat.dictionary.to_pylist()]
        number = flat.indices.to_numpy().astype(np.int64)
        number[cuts[:-1]] = len(parts) + np.arange(len(first))
        return parts + first, number, cuts

    def encode(self, texts: pa.StringArray) -> tuple[list[memoryview], list[memoryview]]:
        """Ids and decoded bytes of whole texts."""
        parts, number, cuts = self.cut(texts)
        return tuple(_joined([held[x] for x in parts], number, cuts) for held in self.learn(parts))


def _joined(values: list[bytes], number: np.ndarray, cuts: np.ndarray) -> list[memoryview]:
    """For each text the values of its parts in their order."""
    laid = pa.array(values, pa.large_binary()).take(pa.array(number))
    ends = np.frombuffer(laid.buffers()[1], np.int64)[cuts].tolist()
    data = memoryview(laid.buffers()[2] or b"").cast("B")
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; with `with_ids` also ids, an array.

    Null and empty texts have no ids. Each row stands for itself, repeated or not. `ranks` is the path of a rank file and
    `pattern` what splits texts into words.
    """
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(ranks, pattern)
        for batch in batches:
            whole = pc.fill_null(batch.column("text"), "")
            for a, b, *_ in slices(whole, 1 << 23):
                ids, back = encoder.encode(whole.slice(a, b - a))
                out: dict[str, object] = {
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back],
                }
                if with_ids:
                    out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, kinds)
