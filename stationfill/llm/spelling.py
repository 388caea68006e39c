"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join, and the form that each is a variant of."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationfill.llm.common import Scratch

RUN = "[A-Za-zÀ-ÿ]+"


def ascii_lower(text: Column) -> Column:
    """A-Z only; other capitals stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def thinned(doc_id: Column, run: Column, every: int) -> Column:
    """The run; where `every` divides the crc32 h of <doc_id>:<run>, without its code point h % length. Without a doc_id, the run."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, every: int | None = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) over all texts: words of at least `shortest` code points with `least` occurrences.

    A null text has no words; every row of a repeated document counts. Counts are summed before the shuffle, so a frequent
    word arrives as one row a task.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= shortest)
    words = runs.select((thinned(F.col("doc_id"), F.col("run"), every) if every else F.col("run")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _in_segments(members: DataFrame) -> DataFrame:
    """Each member twice: with the first segment of its middle in the key, or with the second one.

    Columns lo and hi bound the middle, what no segment has matched so far; it is as long as the indexed words' middle in
    a group, `rest`, or one longer in probing words. An edit leaves one of two segments whole: the first stands at the
    middle's beginning, the second at its end, which in a longer word is a place shifted by one.
    """
    half = F.floor(F.col("rest") / 2).cast("int")
    tail = F.col("rest") - half
    piece = lambda at, n: F.substring("word", at + 1, n)
    first = F.struct(F.xxhash64("key", F.lit(1), piece(F.col("lo"), half)).alias("key"), tail.alias("rest"), (F.col("lo") + half).alias("lo"), F.col("hi"))
    second = F.struct(F.xxhash64("key", F.lit(2), piece(F.col("hi") - tail, tail)).alias("key"), half.alias("rest"), F.col("lo"), (F.col("hi") - tail).alias("hi"))
    return members.select("word", "n", "probes", F.inline(F.array(first, second)))


def near_pairs(words: DataFrame, scratch: Scratch, most: int = 64) -> DataFrame:
    """(a, b, n_a, n_b) once for each two words that one insertion, deletion or replacement parts.

    Words are indexed by two segments, whose lengths follow from the word's; words of the same length or one longer probe them.
    Groups of over `most` members are cut into segments again, and so on while their middle has two code points: no group
    grows with the vocabulary, and no candidate is left out. Keys are hashes; every candidate is verified.
    """
    size = F.length("word")
    role = lambda probes: F.struct((size - int(probes)).cast("long").alias("key"), (size - int(probes)).alias("rest"), F.lit(0).alias("lo"), size.alias("hi"), F.lit(probes).alias("probes"))
    members, found, level = _in_segments(words.select("word", "n", F.inline(F.array(role(False), role(True))))), [], 0
    while True:
        members = scratch.save(members, f"members-{level}")
        large = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("rest").alias("rest")).filter((F.col("size") > most) & (F.col("rest") > 1))
        large = scratch.save(large.select("key", F.lit(True).alias("large")), f"large-{level}")
        last = large.isEmpty()
        marked = members if last else scratch.save(members.join(large, "key", "left"), f"marked-{level}")
        small = marked if last else marked.filter("large is null")
        a = small.filter("NOT probes").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = small.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "probes")
        pairs = a.join(b, "key").filter((F.col("probes") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        found.append(scratch.save(pairs.select("a", "b", "n_a", "n_b"), f"pairs-{level}"))
        scratch.drop(f"members-{level}", f"large-{level}", *([] if last else [f"marked-{level - 1}"] if level else []))
        if last:
            break
        members, level = _in_segments(marked.filter("large").drop("large")), level + 1
    return reduce(DataFrame.unionByName, found).distinct()


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): the end of the chain of forms. Pointers double each round; counts double each step, so chains are short."""
    now, k = scratch.save(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = scratch.save(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{k + 1}")
        scratch.drop(f"roots-{k}")
        now, k = moved.select("word", "root"), k + 1
        if moved.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, every: int | None = 97, shortest: int = 5, least: int = 3, times: int = 2, most: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word of the vocabulary.

    form is the near word of largest n, ties to the smallest in code-point order, if that n is `times` the word's own at least;
    root is the end of the chain of forms, the word itself without one. Documents without words, and empty tables, add
    nothing; extra columns are not read. `every` thins runs as in `thinned`; None leaves them whole.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(vocabulary(docs, every, shortest, least), "words")
    pairs = scratch.save(near_pairs(words, scratch, most), "pairs")
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("n_b").alias("n"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("n_a").alias("n"), F.col("a").alias("other")))
    near = pairs.select(F.inline(sides)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    best, enough = F.col("best"), -F.col("best")["less"] >= times * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, best["other"]).alias("form"), F.when(enough, -best["less"]).alias("form_n"))
    found = scratch.save(found, "found")
    roots = _roots(found.filter("form is not null"), scratch)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
