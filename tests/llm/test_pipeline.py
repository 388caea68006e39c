"""The pipeline's stages on a small table against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from stationfill.llm import language_id, suffix_dedup
from stationfill.llm.queries import oracle_sql, queries

from .test_operators import classes, corpus

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def passages_cut(texts, n=50):
    """Texts by key without the passages of n words that also begin elsewhere, and whether the text is another's whole."""
    at, words = defaultdict(set), {k: [m.span() for m in WORDS.finditer(t)] for k, t in texts.items()}
    said = {k: [texts[k][a:b] for a, b in v] for k, v in words.items()}
    for k, v in said.items():
        for i in range(len(v) - n + 1):
            at[tuple(v[i : i + n])].add((k, i))
    out = {}
    for k, t in texts.items():
        gone = np.zeros(len(said[k]), bool)
        for i in range(len(said[k]) - n + 1):
            if len(at[tuple(said[k][i : i + n])]) > 1:
                gone[i : i + n] = True
        keep, i, last = [], 0, 0
        while i < len(gone):
            if gone[i]:
                j = i
                while j < len(gone) and gone[j]:
                    j += 1
                keep.append(t[last : words[k][i][0]])
                last, i = words[k][j - 1][1], j
            else:
                i += 1
        out[k] = "".join([*keep, t[last:]])
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in corpus(2)]
    rows.append(rows[4])
    rows += [(None, "one lone text without an id", "en", "s", 27), (None, " ".join(["mot"] * 5000), "fr", "s", 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def in_pieces(rows, docs):
    """Whether pieces are those of docs (doc_id, text): every id once, sums, sequences without gaps."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = defaultdict(list)
    for i, t in docs:
        whole[i].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    sums = {i: {(a.tobytes(), len(a)) for a in v} for i, v in whole.items()}
    for r in rows:
        a, b = r["start"], r["start"] + r["length"]
        assert any(n == r["doc_tokens"] and zlib.crc32(raw[4 * a : 4 * b]) == r["ids_crc32"] for raw, n in sums[r["doc_id"]])
    held, ends = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
        held[r["doc_id"]] += r["length"]
    assert held == {i: sum(map(len, v)) for i, v in whole.items()}
    assert all(n == 4096 or n & (n - 1) == 0 for n in ends.values())


def test_stages_keep_the_columns_and_do_their_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, folder)
    model = language_id.fit(docs, ~language_id.held_out(docs["doc_id"]))
    sure = {(r["doc_id"], r["lang_pred"] != "und" and r["score"] >= 0.5) for r in language_id.predict(docs.filter("doc_id is not null"), model).collect()}
    left = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == columns and left == Counter((r["doc_id"], r["text"]) for r in docs.collect() if (r["doc_id"], True) in sure or r["doc_id"] is None)
    first = stages["exact_dedup"](spark, kept, folder)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    once = {}
    for i, t in sorted(left, key=lambda x: (x[0] is None, x[0] or 0)):
        once.setdefault(norm(t), i)
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert first.columns == columns and Counter((norm(t), i) for i, t in rows) == Counter(once.items())
    near = stages["jaccard_join"](spark, first, folder)
    sets = {}
    for i, t in rows:
        w = WORDS.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    named = [i for i in sets if i is not None]
    links = [(a, b) for a, b in combinations(named, 2) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root = classes(links, named)
    want = Counter((i, t) for i, t in rows if i is None or root[i] == i)
    assert near.columns == columns and Counter((r["doc_id"], r["text"]) for r in near.collect()) == want and len(want) < len(rows)
    cut = stages["suffix_dedup"](spark, near, folder)
    plain = passages_cut({i: t for i, t in want if i is not None})
    got = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in cut.collect())
    assert cut.columns == columns and got == Counter((i, plain.get(i, t), len(plain.get(i, t))) for i, t in want)
    assert sum(len(t) for t in plain.values()) < sum(len(t) for _, t in want)
    packed = stages["packing"](spark, cut, folder)
    in_pieces(packed.collect(), [(i, t) for i, t, _ in got.elements()])


def test_passages_of_any_length_in_bytes(spark):
    """Fifty long words in scripts of two and three bytes, forty-nine, other white space, a passage twice in one text, and copies."""
    import random

    rng = random.Random(12)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    greek = [word("αβγδεζηθικλμ", rng.randint(8, 20)) for _ in range(60)]
    hindi = [word("कखगघचछजझ", rng.randint(6, 30)) for _ in range(50)]
    tiny = [word("ab", 1) + word("cdefgh", 1) for _ in range(55)]
    fill = lambda n: [word("mnopqr", 5) for _ in range(n)]
    texts = {
        1: " ".join(fill(30) + greek + fill(20)), 2: "\n\t ".join(fill(5) + greek) + " ", 3: " ".join(greek[:49] + fill(40)), 4: "  ".join(hindi), 5: " ".join(fill(3) + hindi + fill(3)),
        6: " ".join(tiny + fill(9) + tiny), 7: " ".join(fill(200)), 8: "", 9: " ".join(hindi[:49]), 10: "x" * 5000, 11: " ".join(["x" * 5000] * 51),
    }
    rows = [(i, t, 0) for i, t in texts.items()] + [(12, None, 0), (None, texts[1], 0), (7, texts[7], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own int").repartition(3)
    found = suffix_dedup.without_repeated_passages(docs, 50)
    want = passages_cut(texts)
    assert Counter((r["doc_id"], r["text"]) for r in found.collect()) == Counter([*want.items(), (12, None), (None, texts[1]), (7, want[7])])
    assert want[3] == texts[3] and want[4] == "" and want[11] == "" and len(want[6]) < 70 and found.columns == docs.columns
    copies = spark.createDataFrame([(1, texts[1]), (2, texts[1].replace(" ", "\n")), (3, "a b"), (4, "a  b")], "doc_id long, text string")
    assert {tuple(r) for r in suffix_dedup.without_repeated_passages(copies, 50).collect()} == {(1, ""), (2, ""), (3, "a b"), (4, "a  b")}
    assert suffix_dedup.without_repeated_passages(docs.limit(0), 50).count() == 0


def test_run_is_its_stages(spark, folder, tmp_path):
    """run() gives what the stages do one after the other, each on what the one before kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    rows = corpus_pipeline.run(spark, folder).collect()
    in_pieces(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_go_to_python_in_small_batches(spark):
    """Whole texts of a partition at once took an executor's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(6).selectExpr("id AS doc_id", "repeat('some words ', 50000) AS text", "'en' AS lang").coalesce(1)
    rows = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    for name, stage in corpus_pipeline.STAGES:
        if name != "exact_dedup":  # it has no Python
            spark.conf.set(key, str(1 << 26))
            stage(spark, docs, "")
            assert max(r["n"] for r in docs.select("text").union(docs.select("text")).coalesce(1).mapInArrow(rows, "n long").collect()) < 12, name


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
