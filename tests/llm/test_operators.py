"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers as tokenizers_of
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stationfill.llm import blocks, bpe, html_extract, jaccard_join, language_id, packing, quality, suffix_dedup, textbytes, token_counts, voronoi
from stationfill.llm.common import Scratch
from stationfill.llm.components import components
from stationfill.llm.exact_dedup import DigestIndex, dedup

RANKS = tokenizers_of.path("byte_bpe_multi_50k.tiktoken")
WORDS = tokenizers_of.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, member long, lead long, token string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "an", "le", "é", "on", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    passage = prose(rng, 120)
    texts = [None, "", " \t\n", "one two", "ONE  two", "one two three", "x" * 3000, "ab" * 900]
    base = [prose(rng, rng.randint(30, 220)) for _ in range(12)]
    texts += base + base[:3]
    for t in base[:6]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), " ".join(w) + " tail"]
    texts += [prose(rng, 60) + " " + passage + " " + prose(rng, 40) for _ in range(5)]
    texts += [prose(rng, 4000)]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows.append(rows[5])  # a repeated row
    df = spark.createDataFrame([(i, t, "en", "s", i, i, "t") for i, t in rows], SCHEMA).repartition(3).cache()
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *names):
    return {tuple(r) for r in df.select(*names).collect()}


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def classes(links, ids):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_exact_dedup(spark, docs, empty):
    texts = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in texts_of(docs).items()}
    rows = Counter(texts[r["doc_id"]] for r in docs.collect())
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    found = DigestIndex(spark, "test_index").ingest(docs)
    want = {(i, first[t], rows[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
    assert got(found.withColumn("d", F.lower(F.hex("digest"))), "doc_id", "keep_id", "group_size", "kept", "d") == want
    again = DigestIndex(spark, "test_index").ingest(spark.createDataFrame([(9000, "one two"), (9001, "never seen"), (9002, "never  seen")], "doc_id long, text string"))
    assert got(again, "doc_id", "keep_id", "kept", "known") == {(9000, first["one two"], False, True), (9001, 9001, True, False), (9002, 9001, False, False)}
    assert DigestIndex(spark, "test_index").ingest(empty).count() == 0
    assert spark.table("test_index").count() == len(first) + 1
    index = DigestIndex(spark, "test_index")
    index.compact()
    assert spark.table("test_index").count() == len(first) + 1 and len(spark.table("test_index").inputFiles()) <= index.buckets
    index.drop()


def test_exact_dedup_in_batches(spark, docs, empty):
    texts = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in texts_of(docs).items()}
    rows = Counter(texts[r["doc_id"]] for r in docs.collect())
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    for batches in (1, 2, 5):
        assert got(dedup(docs, batches=batches), "doc_id", "keep_id", "group_size", "kept") == {(i, first[t], rows[t], first[t] == i) for i, t in texts.items()}
    odd = spark.createDataFrame([(None, "a  b"), (7, "a b"), (None, "lone"), (None, "lone"), (3, "z")], "doc_id long, text string")
    assert got(dedup(odd), "doc_id", "keep_id", "group_size", "kept") == {(None, 7, 2, False), (7, 7, 2, True), (None, None, 2, True), (3, 3, 1, True)}
    assert got(dedup(odd.filter("doc_id is null")), "doc_id", "keep_id", "kept") == {(None, None, True)}
    assert dedup(empty).count() == 0 and not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_exact_dedup_of_a_batch_that_comes_twice(spark):
    """A retried batch gets its first answer again, also in a session with other partitions; new copies are dropped."""
    rows = [(5, "a b"), (2, "a  b"), (7, "c"), (7, "c"), (None, "d")]
    batch = spark.createDataFrame(rows, "doc_id long, text string")
    index = DigestIndex(spark, "test_retry", 3)
    columns = ("doc_id", "keep_id", "group_size", "kept", "known")
    first = got(index.ingest(batch), *columns)
    assert first == {(5, 2, 2, False, False), (2, 2, 2, True, False), (7, 7, 2, True, False), (None, None, 1, True, False)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        later = DigestIndex(spark, "test_retry")
        assert later.buckets == 3
        assert got(later.ingest(batch), *columns) == first - {(None, None, 1, True, False)} | {(None, None, 1, False, True)}
        more = spark.createDataFrame([(1, "a b"), (9, "e"), (None, "c")], "doc_id long, text string")
        assert got(later.ingest(more), *columns) == {(1, 2, 1, False, True), (9, 9, 1, True, False), (None, 7, 1, False, True)}
        later.compact()
        assert spark.table("test_retry").count() == 4 and DigestIndex(spark, "test_retry").buckets == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        later.drop()


def test_long_words_with_equal_polynomials_are_not_linked(spark):
    """A word of the Thue-Morse sequence and its complement collide in any polynomial modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    words = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    rows = [(1, words[0]), (2, words[1]), (3, words[0]), (4, f"x y {words[0]} z"), (5, f"x y {words[1]} z"), (None, "q r s t"), (None, "one two three four"), (8, "one two three four")]
    found = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    assert got(found, "doc_id", "component_id") == {(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (None, None), (None, 8), (8, 8)}


@pytest.mark.parametrize(("width", "num", "den", "most"), [(4, 85, 100, 128), (5, 80, 100, 2)])
def test_jaccard_join(docs, empty, width, num, den, most):
    sets = {}
    for i, t in texts_of(docs).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = classes(links, sets)
    found = jaccard_join.similarity_components(docs, width, num, den, most=most)
    assert got(found, "doc_id", "n_shingles", "component_id") == {(i, len(s), root[i]) for i, s in sets.items()}
    assert len(set(root.values())) < len(root)
    assert jaccard_join.similarity_components(empty, width, num, den).count() == 0


def test_prefix_tree_finds_all_links():
    rng = np.random.default_rng(3)
    for _ in range(30):
        core = rng.integers(0, 40, 12)
        sets = [np.unique(np.concatenate([core[: rng.integers(1, 13)], rng.integers(0, 60, rng.integers(1, 6))])).astype(np.uint64) for _ in range(12)]
        groups = jaccard_join.Groups(range(12))
        list(jaccard_join.PrefixTree(sets).links(7, 10, groups, list(range(12))))
        links = [(a, b) for a, b in combinations(range(12), 2) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 7 * len(np.union1d(sets[a], sets[b]))]
        want = classes(links, range(12))
        assert all((groups.find(a) == groups.find(b)) == (want[a] == want[b]) for a, b in combinations(range(12), 2))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    ids = {x for a, b in edges if a != b for x in (a, b)}
    assert got(found, "id", "component") == set(classes(edges, {x for e in edges for x in e} | ids).items()) & {(i, c) for i in ids for c in range(200)}


def covered(raws, windows):
    """Per text which bytes lie under its windows (start, bytes) that occur twice."""
    seen = Counter(w for own in windows.values() for w in own.values())
    out = {}
    for i, b in raws.items():
        gone = np.zeros(len(b), bool)
        for k, w in windows[i].items():
            if seen[w] > 1:
                gone[k : k + len(w[0])] = True
        out[i] = gone
    return out


def byte_windows(raws, size):
    return {i: {k: (b[k : k + size],) for k in range(len(b) - size + 1)} for i, b in raws.items()}


def word_windows(raws, n, least, most):
    out = {}
    for i, b in raws.items():
        found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        out[i] = {}
        for k, (start, _) in enumerate(found):
            size = min(most, max(least, found[k + n - 1][1] - start)) if k + n <= len(found) else most
            if start + size <= len(b):
                out[i][start] = (b[start : start + size], size)
    return out


@pytest.mark.parametrize(("window", "gram", "most", "words"), [(400, 64, 128, (50, 200, 512)), (60, 20, 2, (12, 40, 70))])
def test_suffix_dedup(docs, empty, window, gram, most, words):
    raws = {i: t.encode() for i, t in texts_of(docs).items()}
    gone, passages = covered(raws, byte_windows(raws, window)), covered(raws, word_windows(raws, *words))
    want = set()
    for i, b in raws.items():
        spans = int((np.diff(np.concatenate([[0], gone[i].astype(int)])) == 1).sum())
        want.add((i, len(b), int(gone[i].sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[i]])).hexdigest(), bool(passages[i].any())))
    assert any(x[2] and x[2] < x[1] for x in want) and len({x[5] for x in want}) == 2
    kind = suffix_dedup.WordWindows(*words)
    found = suffix_dedup.repeat_digests(docs, window, kind, gram=gram, most=most)
    assert got(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_passage") == want
    same = Counter(raws.values())
    assert all(r["passage_bytes"] == passages[r["doc_id"]].sum() for r in found.collect() if same[raws[r["doc_id"]]] == 1)
    kept = suffix_dedup.without_repeats(docs, kind, gram=gram, most=most)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    for r in kept.collect():
        raw = raws[r["doc_id"]]
        if same[raw] == 1:
            assert (r["text"] or "").encode() == bytes(np.frombuffer(raw, np.uint8)[~passages[r["doc_id"]]]).decode("utf-8", "ignore").encode()
    assert suffix_dedup.repeat_digests(empty).count() == 0


def test_suffix_dedup_of_long_texts_and_odd_ids(spark, monkeypatch):
    """Texts over the size of a piece and of a shard; one doc_id with two texts, and none."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    monkeypatch.setattr(textbytes, "PIECE", 1000)
    rng = random.Random(11)
    long, passage = prose(rng, 4000), prose(rng, 90)
    rows = [(1, long + " one " + passage), (2, long[5000:]), (3, passage), (4, prose(rng, 80)), (None, passage), (4, passage + " x")]
    raws = {k: (t or "").encode() for k, (_, t) in enumerate(rows[:4])}
    # of the texts of document 4 the one with the least digest takes part
    four = min((rows[3][1], rows[5][1]), key=lambda t: hashlib.sha256(t.encode()).digest())
    raws[3] = four.encode()
    gone = covered(raws, byte_windows(raws, 400))
    found = {(r["doc_id"], r["n_bytes"]): r for r in suffix_dedup.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string"), gram=64).collect()}
    for k in range(4):
        r = found[(rows[k][0], len(raws[k]))]
        assert (r["n_removed"], r["kept_sha256"]) == (gone[k].sum(), hashlib.sha256(bytes(np.frombuffer(raws[k], np.uint8)[~gone[k]])).hexdigest())
    assert len(found) == 6


def test_hashes_in_pieces():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4000, 300))
    ends = np.maximum.accumulate(starts + rng.integers(1, 500, 300))
    want = textbytes.RollingHash(data).of(starts, ends)
    for piece in (64, 1000, 4999):
        textbytes.PIECE, held = piece, textbytes.PIECE
        try:
            assert (textbytes.slice_hashes(data, starts, ends) == want).all()
        finally:
            textbytes.PIECE = held


def test_byte_bpe(docs, empty):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    tok = tiktoken.Encoding("t", pat_str=tokenizers_of.PATTERN, mergeable_ranks=table, special_tokens={})
    want = set()
    for i, t in texts_of(docs).items():
        ids = tok.encode_ordinary(t)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got(bpe.encode_decode(docs, RANKS, tokenizers_of.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.encode_decode(empty, RANKS, tokenizers_of.PATTERN).count() == 0
    odd = ["  a  b ", "a   b", "a\n b", "a \nb", "don't it's", "é" * 80, "日本 語", "🙂 🙂", "\x00", "12345 67", "a", "the, end.", " x!"]
    encoder = bpe.Encoder(RANKS, tokenizers_of.PATTERN)
    for text, ids, back in zip(odd, *encoder.encode(pa.array(odd)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode_ordinary(text) and back == text.encode()


def test_long_words_take_seconds():
    """Words without a gap, of random letters, of one letter, of a script without spaces, beside short ones: the same ids in near-linear time."""
    import time

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    tok = tiktoken.Encoding("t", pat_str=tokenizers_of.PATTERN, mergeable_ranks=table, special_tokens={})
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "a" * 30_000, "日本語の文" * 3000, "short words, " + "".join(rng.choice("etaoin") for _ in range(257)), "x" * 256 + " " + "xy" * 129]
    encoder = bpe.Encoder(RANKS, tokenizers_of.PATTERN)
    began = time.process_time()
    found = list(zip(*encoder.encode(pa.array(texts)), strict=True))
    assert time.process_time() - began < 10
    for text, (ids, back) in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode_ordinary(text) and bytes(back) == text.encode()


def test_token_counts(docs, empty):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    tok = tiktoken.Encoding("t", pat_str=tokenizers_of.PATTERN, mergeable_ranks=table, special_tokens={})
    found = token_counts.token_counts(docs, RANKS, tokenizers_of.PATTERN, 50256, block=64).collect()
    assert len(found) == docs.count()
    assert {tuple(r) for r in found} == {(i, len(tok.encode_ordinary(t))) for i, t in texts_of(docs).items()}
    assert token_counts.token_counts(empty, RANKS, tokenizers_of.PATTERN, 50256).count() == 0


def test_token_file_without_a_last_separator(spark, tmp_path):
    np.array([7, 7, 0, 0, 7, 0, 7, 7, 7], "<u2").tofile(tmp_path / "a.bin")
    np.array([], "<u2").tofile(tmp_path / "b.bin")
    for block in (1, 2, 4, 100):
        found = token_counts.scan_token_files(spark, tmp_path.as_uri(), 0, block=block)
        assert got(found, "file", "ordinal", "n_tokens") == {("a.bin", 0, 2), ("a.bin", 1, 0), ("a.bin", 2, 1), ("a.bin", 3, 3)}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    window = 256
    rows = [r for r in packing.pack(docs, WORDS, window).collect()]
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts_of(docs).items()}
    many = Counter(r["doc_id"] for r in docs.collect())
    assert sum(r["length"] for r in rows) == sum(len(ids[i]) * n for i, n in many.items())
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for i, n in many.items():
        assert Counter(x for r in rows if r["doc_id"] == i for x in range(r["start"], r["start"] + r["length"])) == {x: n for x in range(len(ids[i]))}
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == window or n < window and n & (n - 1) == 0 for n in sequences.values())
    assert packing.pack(empty, WORDS).count() == 0


def test_packing_of_odd_rows(spark):
    """Special tokens and letters whose lower case is two, and one doc_id with two texts of as many ids that are cut."""
    from tokenizers import Tokenizer

    tok, encoder = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    rng = random.Random(3)
    signs = [" ", "\n", "\x1c", "a", "The", "'LL", "é", "\u0301", "İ", "ß", "日", "🙂", "12", "_", "...", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x00"]
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    for text, ids in zip(odd, encoder.encode([x.encode() for x in odd], b""), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text
    texts = [" ".join(rng.choice(["cat", "dog", "sun"]) for _ in range(n)) for n in (21, 21, 17, 30, 5, 9)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[0].upper()), *enumerate(texts[2:], 2)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 16).collect()
    want = Counter()
    for i, t in rows:
        own = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want[i] += len(own)
    assert {i: sum(r["length"] for r in found if r["doc_id"] == i) for i in want} == want and all(r["ids_crc32"] is not None for r in found)
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == len(found)


def test_packing_of_rows_without_doc_id(spark):
    """They are packed like others, those that are cut as well."""
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(WORDS), random.Random(8)
    rows = [(i if i % 3 else None, " ".join(rng.choice(["cat", "dog", "sun"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(None, rows[0][1]), (None, None), (4, rows[0][1])]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 16).collect()
    pieces, want = Counter(), Counter()
    for i, t in rows:
        own = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] += len(own)
    for r in found:
        pieces[r["doc_id"]] += r["length"]
    assert pieces == want and all(r["ids_crc32"] is not None for r in found)
    own = {zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows if i is None}
    whole = [r for r in found if r["doc_id"] is None and r["length"] == r["doc_tokens"]]
    assert whole and all(r["ids_crc32"] in own for r in whole)
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == len(found)


def test_language_id(spark):
    rng = random.Random(9)
    parts = {"aa": ["the", "ing", "and", "er"], "bb": ["der", "sch", "und", "ei"], "cc": ["que", "eau", "é", "tion"], "dd": ["los", "ció", "ñ", "ar"]}
    rows = [(i, " ".join("".join(rng.choice(parts[n]) for _ in range(3)) for _ in range(20)), n) for i in range(400) for n in [rng.choice(list(parts))]]
    rows += [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, rows[0][1], None), (0, rows[0][1], rows[0][2])]
    found = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found[1000]["lang_pred"] == found[1001]["lang_pred"] == "und" and found[1002]["lang_pred"] == rows[0][2]
    held = [(i, n) for i, _, n in rows[:400] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["held_out"] for i, _ in held) and sum(found[i]["lang_pred"] == n for i, n in held) >= 0.97 * len(held)
    again = spark.createDataFrame([r for r in rows for _ in range(3)], "doc_id long, text string, lang string")
    assert got(language_id.identify(again), "doc_id", "lang_pred", "score") == {(i, r["lang_pred"], r["score"]) for i, r in found.items()}  # repeated rows are learned once
    none = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert got(language_id.identify(none), "doc_id", "lang_pred") == {(1, "und")}
    assert language_id.identify(none.limit(0)).count() == 0
    codes = language_id.codewords(20, np.random.default_rng(1))
    assert min((a != b).sum() for a, b in combinations(codes, 2)) >= 8


def test_voronoi_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[50:150] = vectors[50]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(vectors)] + [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [None] + [1.0] * 7, 1), (7, vectors[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int")
    whole = np.floor(1024 * vectors.astype(np.float64)).astype(np.int64)
    want = set()
    for q in range(0, 300, 20):
        scores = whole @ whole[q]
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:10]
        want |= {(q, k + 1, i, int(scores[i])) for k, i in enumerate(order)}
    for pivots in (1, 16):
        assert got(voronoi.top_k(df, F.col("vec_id") % 20 == 0, pivots=pivots, most=64), "query_id", "rank", "vec_id", "score") == want
    mixed = spark.createDataFrame([(0, [1.0, 0.5]), (1, [2.0, 1.0]), (2, [1.0, 1.0, 1.0]), (3, [0.5] * 3), (4, [float("inf"), 1.0]), (5, []), (3, [9.0] * 3), (3, None)], "vec_id long, embedding array<double>")
    assert got(voronoi.top_k(mixed, F.lit(True)), "query_id", "rank", "vec_id", "score") == {(0, 1, 1, 2621440), (1, 1, 0, 2621440), (2, 1, 3, 1572864), (3, 1, 2, 1572864)}
    few = df.filter("vec_id < 4")
    assert voronoi.top_k(few, F.col("vec_id") == 0).count() == 3 and voronoi.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(5)
    good = [prose(rng, rng.randint(20, 90)).capitalize() + "." for _ in range(300)]
    bad = [" ".join(w + "###" for w in prose(rng, 60).split()) for _ in range(30)] + ["Buy " * 80 for _ in range(30)] + [prose(rng, 60).upper() + "!!" for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    found = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i]["kept"] for i in range(300)) >= 295 and sum(not found[i]["kept"] for i in range(300, 390)) >= 85
    assert quality.score(docs).count() == docs.count() and quality.score(empty).count() == 0


def test_quality_is_the_scorers(spark):
    """Junk that the labellers don't see goes if the scorer learned its shape; the threshold holds on labelled texts."""
    rng = random.Random(6)
    good = [prose(rng, rng.randint(20, 90)).capitalize() + "." for _ in range(300)]
    digits = [" ".join(str(rng.randint(10, 9999999)) for _ in range(60)) + "." for _ in range(62)]
    rows = list(enumerate(good + [x.replace("7", "#") for x in digits[:60]] + digits[60:]))
    found = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i]["kept"] for i in range(300)) and not any(found[i]["kept"] for i in range(300, 360))
    assert all(found[i]["weak_label"] >= 0.5 and not found[i]["kept"] for i in (360, 361))
    assert all(r["kept"] == (r["score"] >= 0.5) for r in found.values())


def test_training_on_whole_texts(spark):
    """What a text is shows late in it."""
    rng = random.Random(7)
    good = [prose(rng, rng.randint(20, 90)).capitalize() + "." for _ in range(200)]
    late = [prose(rng, 2600) + " " + " ".join("w###" for _ in range(8000)) for _ in range(40)]
    found = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(list(enumerate(good + late)), "doc_id long, text string")).collect()}
    assert sum(found[i]["kept"] for i in range(200)) >= 195 and not any(found[i]["kept"] for i in range(200, 240))

    def other(n):
        return " ".join("".join(rng.choice(["qu", "zx", "vy", "jo", "kuf"]) for _ in range(3)) for _ in range(n))

    rows = [(i, prose(rng, 1200) + " " + other(6000), "late") if i % 2 else (i, prose(rng, 60), "plain") for i in range(120)]
    assert min(len(prose(rng, 1200)) for _ in range(5)) > 4000
    out = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == ("late" if r["doc_id"] % 2 else "plain") and not r["ambiguous"] for r in out)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="sidebar"><p>Popular now.</p></div><article><h1>A title &amp; more</h1><p>First   block,<br>one line.<p><b>Second</b> block.</p><div class="ad">Buy it.</div></article>
<section class="comments"><p>So true, thanks.</p></section><footer>&copy; us</footer></body></html>"""


def test_html_extract(spark):
    leaves = html_extract.parse(PAGE).leaves
    assert [x.text for x in leaves][3:7] == ["A title & more", "First block, one line.", "Second block.", "Buy it."]
    rows = [(i, "u", PAGE.replace("block", f"block{i}")) for i in range(40)] + [(100, None, None), (101, "u", ""), (102, "u", "<p"), (0, "u", PAGE.replace("block", "block0"))]
    found = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3]["text"] == "A title & more\nFirst block3, one line.\nSecond block3." and found[3]["n_chars"] == len(found[3]["text"])
    assert found[100]["text"] == found[101]["text"] == found[102]["text"] == "" and found[100]["n_chars"] == 0


def test_html_extract_beyond_listed_names(spark):
    """Names that no list holds, layout names, and a form around the page: what decides is evidence, not a keyword in the vector."""
    rng = random.Random(9)

    def page(i, notice, body="", form=("", "")):
        paragraphs = "".join(f"<p>{prose(rng, rng.randint(12, 40)).capitalize()} end{i}.</p>" for _ in range(5))
        text = f'<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><article><h1>Title {i}</h1>{paragraphs}</article>'
        return f'<html><body{body}>{form[0]}{text}<div class="announcement"><p>{notice}</p></div><footer>&copy; us</footer>{form[1]}</body></html>'

    rows = [(i, f"http://a.example/{i}", page(i, "We close on Monday.")) for i in range(60)]
    rows.append((60, "http://a.example/60", page(60, "We open on Friday.")))
    rows.append((61, "http://a.example/61", page(61, "We close on Monday.", body=' class="no-sidebar widget"')))
    rows.append((62, "http://a.example/62", page(62, "We close on Monday.", form=('<form id="login">', "</form>"))))
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(63):
        kept = found[i].split("\n")
        assert kept[0] == f"Title {i}" and sum(x.endswith(f"end{i}.") for x in kept) == 5 and len(kept) == 6, (i, kept)
    told = html_extract.parse('<html><body class="widget"><div class="no-sidebar"><p>A text.</p><p><a>A link.</a></p><p>A text.</p></div></body></html>')
    assert html_extract.evidence(told, [False, False, True]).tolist() == [1, 0, 0]


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    model = html_extract.Labeller(hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    pages = [rng.normal(size=(n, html_extract.SIZE)).astype(np.float32) for n in (3, 5)]
    labels = [np.array([1, 0, 1.0]), np.array([0, 0, 1, 1, 0.0])]

    def loss():
        out, kept = model.forward(pages)
        want = np.zeros_like(out)
        for k, y in enumerate(labels):
            want[k, : len(y)] = y
        each = -(want * np.log(out) + (1 - want) * np.log(1 - out))
        return (each * kept["mask"]).sum() / kept["mask"].sum()

    before = loss()
    model.fit(pages, labels, epochs=40, batch=2)
    assert loss() < 0.3 * before


def test_words_never_cross_rows():
    import pyarrow as pa

    column = pa.array(["ab", None, "cd ef", "", " x"])
    ((_, _, data, offsets),) = textbytes.slices(column)
    starts, ends, rows = textbytes.words(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"ef", b"x"] and rows.tolist() == [0, 2, 2, 4]


def test_words_of_latin_letters_by_the_model_alone():
    """The same ids as from the whole library, for every such letter and for words of many of them."""
    from tokenizers import Tokenizer

    tok, encoder = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(x) for x in range(0xDF, 0x100) if x != 0xF7)
    words = [*letters, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(3000)), "a÷b", "Éa", "ÿ", "á"]
    for text, ids in zip(words, encoder.encode([w.encode() for w in words], b""), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_words_are_learned_as_they_come():
    """Of many texts only those read so far are held; a small memory and a rest give the same ids, and a rest keeps one generation."""
    from tokenizers import Tokenizer

    tok, encoder = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS, 8)
    texts = [f"the cat{i}, dogs{i % 3}... été {'xyz' * (i % 5)} the! дом{i % 2}" for i in range(40)]
    found = encoder.encode([t.encode() for t in texts], b"")
    for i, text in enumerate(texts):
        assert np.frombuffer(next(found), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text
        assert f"cat{i + 1},".encode() not in encoder.young
        if i % 7 == 6:
            encoder.rest()
            assert not encoder.old and len(encoder.young) <= 24 and b"the" in encoder.young


def test_rows_that_nobody_asks_for_are_not_sent(spark):
    """The filter ahead of a join keeps every row that is asked for, with few bits as well, and few others with enough of them."""
    rows = spark.range(20_000).selectExpr("id AS member", "id % 7 AS k", "CAST(id AS STRING) AS text")
    asked = rows.filter("member % 50 = 3").select("k", "member")
    for bits, most in ((1 << 27, 450), (1 << 15, 20_000)):
        kept = {r["member"] for r in blocks.asked_for(rows, ["member", "k"], asked, 20_000, bits).collect()}
        assert {x for x in range(20_000) if x % 50 == 3} <= kept and len(kept) <= most
    assert blocks.asked_for(rows, ["member"], asked.filter("member < 0"), 20_000).count() == 0


def test_members_meet_in_one_block(spark):
    """Two sets of one band of sizes are compared in its block alone, those of adjacent bands in the upper one."""
    pairs = spark.createDataFrame([(1, 1, 100), (1, 2, 101), (5, 5, 100), (5, 6, 120), (8, 8, 100), (8, 9, 400)], "lead long, member long, n_shingles long")
    dealt, _ = jaccard_join._deal(pairs, Scratch(spark, "deal"), 128, 85, 100)
    got = {}
    for r in dealt.collect():
        got.setdefault((r["lead"], r["band"]), set()).add((r["member"], r["home"]))
    assert {lead for lead, _ in got} == {1, 5} and len(got) == 2
    assert sorted(map(sorted, got.values())) == [[(1, 1), (2, 1)], [(5, 0), (6, 1)]]
