"""Spelling variants: words at distance one, grouped under their most frequent form.

Symmetric deletes. Every word emits a key for itself and for each distinct string that it gives without one
letter; words at distance one share a key (the shorter word, or both without the letter that differs). Keys
are joined, pairs are distinct by id, and an exact edit distance of one decides. Keys are 64-bit hashes, so a
word of n letters emits n numbers and not n words; a collision only adds a pair to verify.

A key is shared by at most as many words as there are letters to insert at its places, so groups of a join
are bounded by the alphabet, not by the text. Counts are summed before they are shuffled. Forms point to a
word of at least `ratio` times the count, so they have no cycle, and pointers are doubled until they end.
What many words point to is joined over salts. All joins are sort-merge ones: Spark sizes keys as the words that they
come from, and words as their packed files, so a table of some 100 MB and more would pass for one to be broadcast.

Nulls, empties: null texts have no words, and rows without a word take no part. Repeated rows of words are an
error of the caller (counts are per word); repeated documents count as often as they come. Empty tables give
empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import materialize
from loomfield.operators.ranking import salted_join

#: Letters of a word: Latin ones, and all of U+00C0 to U+00FF.
LETTERS = r"[A-Za-zÀ-ÿ]+"


def lowered(word: Column) -> Column:
    """A-Z in lower case; only words that have any are looked at letter by letter."""
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(word.rlike("[A-Z]"), F.translate(word, capital, small)).otherwise(word)


def word_runs(docs: DataFrame, *kept: str, text_col: str = "text") -> DataFrame:
    """(kept columns, word): every maximal run of letters of every text, lower-cased."""
    found = F.explode(F.regexp_extract_all(text_col, F.lit(f"({LETTERS})"), F.lit(1)))
    runs = docs.select(*kept, found.alias("_run"))
    return runs.select(*kept, lowered(F.col("_run")).alias("word"))


def word_counts(runs: DataFrame, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of runs(word) with enough letters that occur often enough."""
    counts = runs.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from loomfield.llm.hashing import deletion_hashes

    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        at = 0
        while at < len(words):
            end, letters = at, 0
            while end < len(words) and (end == at or letters + len(words[end]) <= 1 << 20):
                letters += len(words[end])
                end += 1
            points = np.frombuffer("".join(words[at:end]).encode("utf-32-le"), "<u4")
            ends = np.cumsum([len(w) for w in words[at:end]])
            starts = np.concatenate([[0], ends[:-1]])
            owner, keys = deletion_hashes(points, starts, ends)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[at:end][owner])], names=["key", "id"])
            at = end


def near_words(words: DataFrame) -> DataFrame:
    """(a, b) for words(id, word), a < b: ids of all pairs of words with one letter inserted, deleted or
    replaced, each once. Words are distinct and not null."""
    keys = words.select("id", "word").mapInArrow(_keys, "key long, id long")
    pairs = keys.select("key", F.col("id").alias("a")).join(keys.select("key", F.col("id").alias("b")).hint("merge"), "key").filter("a < b")
    named = lambda c, w: words.select(F.col("id").alias(c), F.col("word").alias(w)).hint("merge")
    both = pairs.select("a", "b").distinct().join(named("a", "_w"), "a").join(named("b", "_x"), "b")
    return both.filter(F.levenshtein("_w", "_x", 1) == 1).select("a", "b")


def spelling_variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for counts(word, n), words distinct. A word's form is its near
    word of the largest n (ties: the smallest by code points) if that is at least ratio times its own, else
    null; its root is where forms lead to, itself where it has none; n_near counts near words."""
    if ratio < 2:
        raise ValueError("forms must be more frequent than what they stand for")
    words = counts.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    words = materialize(words.withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = near_words(words).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    told = pairs.select(F.col("p.a").alias("a"), F.col("p.b").alias("id")).join(words.hint("merge"), "id")
    best = told.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "word", F.col("id").alias("to"))).alias("b"))
    joined = words.join(best.hint("merge"), "id", "left").withColumn("form_n", -F.col("b.less"))
    taken = F.col("form_n") >= ratio * F.col("n")
    forms = joined.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("b.word")).alias("form"),
        F.when(taken, F.col("form_n")).alias("form_n"), F.when(taken, F.col("b.to")).alias("to"),
    )
    forms = materialize(forms, "forms")
    roots = _ends(forms.filter("to IS NOT NULL").select("id", "to"))
    named = salted_join(roots, words.select(F.col("id").alias("to"), F.col("word").alias("root")), ["to"], ["id"], hint="merge")
    out = forms.drop("to").join(named.select("id", "root").hint("merge"), "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _ends(links: DataFrame) -> DataFrame:
    """links(id, to), one for an id and without cycles -> (id, to) with the end of each chain. Pointers are
    doubled, so a chain of n links takes about log2(n) rounds."""
    links = materialize(links, "links")
    while True:
        further = links.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        doubled = materialize(salted_join(links, further, ["to"], ["id"], "left", "merge"), "links")
        moved = bool(doubled.filter("_next IS NOT NULL").take(1))
        links = doubled.select("id", F.coalesce("_next", "to").alias("to"))
        if not moved:
            return links
