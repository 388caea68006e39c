"""Near-duplicate embeddings, spelling variants and hard negatives against brute force on small tables with rows of every odd kind."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationfill.llm import embedding_dedup, hard_negatives, spelling
from stationfill.llm.common import Scratch

from .test_operators import classes

VECTORS = "vec_id long, embedding array<float>, label int, id long, tile string, x string, digest int, n int"


def cloud(seed, n=260, width=16):
    """Rows (vec_id, vector, label): random ones, a dense group, exact copies, chains of near ones, and odd rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[60:130] = x[60] + 0.08 * rng.normal(size=(70, width))
    x[130:150] = x[130]
    for k in range(151, 175):
        x[k] = x[k - 1] + 0.11 * rng.normal(size=width)
    x *= rng.uniform(0.01, 50, size=(n, 1))
    rows = [(int(i) * 5 % (5 * n + 1), [float(np.float32(v)) for v in x[i]], int(i % 60 // 15) if i < 60 else 1) for i in range(n)]
    odd = [(9001, None, 1), (9002, [0.0] * width, 1), (9003, [float("nan"), *[1.0] * (width - 1)], 1), (9004, [None, *[1.0] * (width - 1)], 1), (9005, rows[70][1], None), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1), (9008, [], 1), (9010, [float("inf")] * width, 2), rows[3], rows[3], (9100, rows[70][1], 1), (9100, rows[4][1], 3)]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", "x", 2, 3) for r in rows], VECTORS).repartition(5)


def one_each(rows):
    """The least (label, vector) of each vec_id; null is least."""
    key = lambda r: (r[2] is not None, r[2] or 0, r[1] is not None, [(v is not None, v if v == v else 9e99) if v is not None else (False, 0) for v in r[1] or ()])
    out = {}
    for r in rows:
        if r[0] not in out or key(r) < key(out[r[0]]):
            out[r[0]] = r
    return out


def fit(vector):
    return bool(vector) and all(v is not None and np.isfinite(v) for v in vector)


@pytest.mark.parametrize(("most", "least"), [(1024, 0.98), (7, 0.98), (16, 0.9)])
def test_near_duplicates(spark, most, least):
    rows = cloud(most)
    own = one_each(rows)
    ids = [i for i, r in own.items() if fit(r[1]) and any(r[1]) and r[2] is not None]
    unit = {i: np.array(own[i][1]) / np.linalg.norm(own[i][1]) for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and own[a][2] == own[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    number, root = Counter(i for pair in links for i in pair), classes(links, own)
    found = embedding_dedup.near_duplicates(frame(spark, rows), least=least, most=most)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()}
    assert got == {i: (number[i], root[i], root[i] == i) for i in own} and found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert max(number.values()) > 60 and len(links) > 1000


def test_near_duplicates_of_nothing(spark):
    assert embedding_dedup.near_duplicates(frame(spark, [])).count() == 0
    lone = frame(spark, [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)])
    assert {tuple(r) for r in embedding_dedup.near_duplicates(lone).collect()} == {(None, 0, None, True), (4, 0, 4, True)}


def test_error_bounds_hold_and_huge_vectors_stay_finite():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 33)) ** 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for least in (0.1, 0.3, 0.6):
        sure, may = embedding_dedup.bracketed(embedding_dedup.quantised(x), embedding_dedup.quantised(x), least)
        good = x @ x.T >= least
        assert (good | ~sure).all() and (sure | may | ~good).all() and sure.sum() > 100
    import pyarrow as pa

    assert np.allclose(embedding_dedup.units(pa.array([[3e300, 4e300], [3e-310, 4e-310]], pa.list_(pa.float64()))), [[0.6, 0.8]] * 2)


def test_forest_finds_components():
    rng = random.Random(5)
    for n, m in ((40, 25), (40, 80), (200, 199)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m < 199 else [(k, k + 1) for k in rng.sample(range(n - 1), n - 1)]
        want = classes(pairs, range(n))
        up = embedding_dedup.forest(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), n)
        assert [int(v) for v in up] == [want[i] for i in range(n)]


def brute_negatives(rows, scale, positives, negatives, low):
    own = {i: r for i, r in one_each([r for r in rows if r[2] is not None and fit(r[1])]).items()}
    vectors = {i: [int(np.floor(scale * v)) for v in r[1]] for i, r in own.items()}
    out = set()
    for a in (i for i in own if i % 10 == 0):
        score = {i: sum(u * v for u, v in zip(vectors[a], vectors[i], strict=True)) for i in own if i != a and len(vectors[i]) == len(vectors[a])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if own[i][2] == own[a][2]][:positives]:
            good = [i for i in order if own[i][2] != own[a][2] and low[0] * score[p] <= low[1] * score[i] <= low[1] * score[p]][:negatives]
            out |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(good)}
    return out


@pytest.mark.parametrize(("most", "scale"), [(32_768, 256), (20, 3)])
def test_hard_negatives(spark, monkeypatch, most, scale):
    """Coarse components make ties; small blocks make many of them, and chunks of few queries."""
    rows = [r for r in cloud(8, 300) if r[0] != 9100]
    rows += [(9200 + k, rows[k][1], 2) for k in range(30)]
    plain = hard_negatives.Search.__init__
    monkeypatch.setattr(hard_negatives.Search, "__init__", lambda self, x, scratch, total: plain(self, x, scratch, total, most=most, per=4096 if most > 20 else 3))
    found = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), scale=scale)
    want = brute_negatives(rows, scale, 5, 5, (80, 100))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 200


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    few = frame(spark, [(10, [1.0, 0.0], 1), (11, [-1.0, 0.0], 1), (12, [1.0, 0.0], 2), (None, [1.0, 0.0], 2)])
    assert hard_negatives.hard_negatives(few, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0  # the positive scores below 0


def test_brackets_hold_the_scores():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-300, 300, size=(400, 9)), rng.integers(-300, 300, size=(30, 9))
    table = hard_negatives.PivotTable(x[:40], int((x**2).sum(axis=1).max()), 8)
    far, own = table.distances(table.rows_of(x)), table.distances(table.queries_of(q))
    least, most = np.abs(own[:, None] - far[None]).max(axis=2), (own[:, None] + far[None]).min(axis=2)
    scores, room = q @ x.T, table.slack(q)[:, None]
    assert (table.scores(q, least**2) + room >= scores).all() and (table.scores(q, most**2) - room <= scores).all()


def edits(docs, every, shortest, least, times):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if i is not None and every and h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    near, by = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by[k, w[:k] + w[k + 1 :]].add(w)
    for (_, rest), words in by.items():
        for a in words:
            near[a] |= words - {a}
            if rest in n:
                near[a].add(rest)
                near[rest].add(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= times * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeÀéÿ") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    words += ["aaaaa", "aaaab", "baaaa", "aaaaaa", "ccccccc" * 400, "ccccccc" * 400 + "c", "ÀÀéÿx", "ààéÿx", "abcdefghij", "bcdefghij", "abcdefghi"]
    words += [w[:2] + rng.choice("abc") + w[3:] for w in words] + [w + "e" for w in words[:30]]
    docs = [(None, "aaaaa aaaab"), (1, None), (2, ""), (3, " 123 _ 日本 "), (4, "naïve—Straße x"), (7, "one two"), (7, "one two")]
    docs += [(10 + i, " ".join(rng.choice(words)[: rng.choice([99999, 99999, 99999, 5])].replace("b", rng.choice("bbbB")) for _ in range(rng.randint(1, 80)))) for i in range(150)]
    docs += [(900, " ".join(["abcde", "abcdd"] * 20_000)), (901, " ".join(["zzzzz"] * 12 + ["zzzzy"] * 6 + ["zzzyy"] * 3))]
    return docs


@pytest.mark.parametrize(("most", "every"), [(64, 97), (2, 3), (1, None)])
def test_spelling_variants(spark, texts, most, every):
    """Groups of one or two members are cut down to the last code point, which changes nothing."""
    docs = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in texts], "doc_id long, text string, word string, n int, key string").repartition(4)
    found = spelling.spelling_variants(docs, every=every, most=most)
    want = edits(texts, every, 5, 3, 2)
    assert {tuple(r) for r in found.collect()} == want and found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sum(1 for r in want if r[1]) > 20 and any(r[1] != r[2] and r[1] for r in want)


def test_spelling_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(empty).count() == 0


def test_near_pairs_of_words_that_share_their_halves(spark):
    """Three hundred words of one first half, in which groups of thirty-two are cut again and again."""
    rng = random.Random(9)
    words = sorted({"abcdefgh" + "".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(300)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(df, Scratch(spark, "t"), most=32).collect()}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    want = {frozenset((a, b)) for a in words for b in words if a < b and one(a, b)}
    assert {frozenset(p) for p in got} == want and len(got) == len(want)
