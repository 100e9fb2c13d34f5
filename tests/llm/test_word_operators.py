"""Periodic runs and spelling variants: against their definitions, on planted and random texts."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.llm import periods, spelling
from loomfield.llm import queries as Q

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def plain_runs(words, least=12):
    """All runs by the definition: stretches of equal words q apart that end on both sides, of no smaller period."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                w = words[i : j + q]
                if not any(w[p:] == w[:-p] for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def solved(spark, texts, **more):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, runs int, n_words string")
    return {r.id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(df, **more).collect()}


@pytest.mark.parametrize("at_once", [1, 300, 100_000])
def test_runs_match_the_definition(spark, at_once):
    rng = np.random.default_rng(at_once)
    texts = [None, "", " \n\t", "a", "a " * 12, "a\x0ba\x0ca\ra\na\ta " * 3, "ab cd " * 6 + "ef", " \u0085  " * 6]
    for k in range(120):
        words = [f"w{x}" for x in rng.integers(0, 1 + k % 4, rng.integers(1, 90))]
        for _ in range(k % 3):  # a stretch repeated, twice at times within another
            a, p, m = rng.integers(0, len(words)), rng.integers(1, 9), rng.integers(2, 6)
            words[a:a] = words[a : a + p] * m
        texts.append(" ".join(words))
    fib = ["a", "b"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    texts += [" ".join(fib[-1]), " ".join("ab" * 40 + "ba" * 40), texts[9], texts[9]]
    got = solved(spark, texts, at_once=at_once)
    for k, text in enumerate(texts):
        words = SPACE.findall(text or "")
        runs = plain_runs(words)
        assert got[k] == (len(words), runs, plain_collapsed(words, runs)), text
    assert sum(len(v[1]) for v in got.values()) > 200


def test_other_least_lengths_and_long_texts(spark):
    rng = np.random.default_rng(0)
    words = [f"w{x}" for x in rng.integers(0, 3, 60)]
    assert solved(spark, [" ".join(words)], least=4)[0][1] == plain_runs(words, 4)
    long = [f"w{x}" for x in rng.integers(0, 5000, 60_000)]
    long[1000:1000] = long[500:700] * 5
    long[40_000:40_000] = ["z"] * 3000
    got = solved(spark, [" ".join(long), "y " * 50_000, " ".join(long[:900])])
    assert got[0][1] == [(s, n, q) for s, n, q in got[0][1] if long[s + q : s + n] == long[s : s + n - q] and (s == 0 or long[s - 1] != long[s - 1 + q])]
    assert {(q, n >= 1000) for _, n, q in got[0][1]} == {(200, True), (1, True)} and got[1][1] == [(0, 50_000, 1)] and got[1][2] == "y"
    assert got[2][1] == []


def test_names_tell_stretches_apart():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 3, 400)
    ids[[0, 200, 399]] = [-1, -2, -3]
    names = periods.power_names(ids, 400)
    for j, name in enumerate(names):
        want = {}
        for i in range(400 - (1 << j) + 1):
            want.setdefault(tuple(ids[i : i + (1 << j)]), set()).add(int(name[i]))
        assert all(len(v) == 1 for v in want.values()) and len(set.union(*want.values())) == len(want)
    assert len(names) > 3 and len(periods.power_names(np.arange(50), 50)) == 1
    x, y = np.array([1, 5, 201]), np.array([2, 9, 300])
    ahead, behind = periods.ahead(names, x, y), periods.behind(names, x, y)
    for a, b, n, m in zip(x, y, ahead, behind):
        assert (ids[a : a + n] == ids[b : b + n]).all() and (b + n == 400 or ids[a + n] != ids[b + n])
        assert (ids[a - m : a] == ids[b - m : b]).all() and (a == m or ids[a - m - 1] != ids[b - m - 1])


def test_grid_in_blocks_is_the_grid():
    for n in (12, 13, 50, 301):
        want = [(k * q, q) for q in range(1, n // 2 + 1) for k in range(n) if k * q + q < n]
        for most in (1, 7, 10**6):
            assert [(int(i), int(q)) for a, b in periods.grid(n, most) for i, q in zip(a, b)] == want


def plain_planted(doc, text):
    words = SPACE.findall(text or "")
    n, h = len(words), zlib.crc32(str("" if doc is None else doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def plain_periods(doc, text):
    words = plain_planted(doc, text)
    runs = plain_runs(words)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return doc, len(runs), s, n, q, n and 1000 * n // q, sha(lines), sha(plain_collapsed(words, runs))


def test_registered_periods(spark, sample, odd, nothing, tmp_path):
    for name, docs in (("sample", sample), ("odd", odd), ("none", nothing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = Counter(tuple(r) for r in Q.op11_periods(spark, f"{tmp_path}/{name}").collect())
        assert got == Counter(plain_periods(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        assert name != "sample" or sum(n > 0 for _, n, *_ in got) > 10


def edits(word, letters):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}


def plain_variants(counts, ratio=2):
    letters, out = {c for w in counts for c in w}, set()
    near = {w: (edits(w, letters) & counts.keys()) - {w} for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_variants_match_the_definition(spark):
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 8))): int(rng.integers(1, 5) ** rng.integers(1, 6)) for _ in range(900)}
    words |= {"a" * k: 2**k for k in range(1, 20)}  # a chain of forms
    words |= {"aa" + chr(65 + k): 7 for k in range(26)} | {"𝔸b": 3, "𝔸": 9, "b" * 3000: 5, "b" * 2999: 10, "b" * 1500 + "c" + "b" * 1499: 11}
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, id string")
    got = [tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert set(got) == plain_variants(words) and len(got) == len(words)
    assert max(len(r[0]) - len(r[2]) for r in got) >= 0 and any(r[2] != (r[1] or r[0]) for r in got)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, ratio=1)


def test_deletions_are_hashed_as_the_words_they_give():
    from loomfield.llm.hashing import deletion_hashes

    words = ["a", "ab", "aab", "abab", "ba", "b", "", "bbb", "bb", "éab", "é" * 40]
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(w) for w in words])
    owner, keys = deletion_hashes(points, ends - [len(w) for w in words], ends)
    want = [(k, w) for k, w in enumerate(words)] + [(k, w[:i] + w[i + 1 :]) for k, w in enumerate(words) for i in range(len(w)) if i == 0 or w[i] != w[i - 1]]
    assert owner.tolist() == [k for k, _ in want]
    of = {}
    for (_, text), key in zip(want, keys.tolist()):
        of.setdefault(text, set()).add(key)
    assert all(len(v) == 1 for v in of.values()) and len(set.union(*of.values())) == len(of)


LOWER = {i: i + 32 for i in range(65, 91)}


def plain_words_of(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_spelling_broadcasts_nothing(spark, monkeypatch):
    """Keys are many times the words that Spark sizes them by, and words many times their packed file."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())

    def kept(df, name):
        plan(df)
        return stored(df, name)

    stored = spelling.materialize
    monkeypatch.setattr(spelling, "materialize", kept)
    rows = [(f"word{k:04d}".translate(str.maketrans("0123456789", "abcdefghij")) * 3, 9) for k in range(200)]
    df = spark.createDataFrame([*rows, *[(w[:-1], 3) for w, _ in rows]], "word string, n long")
    out = spelling.spelling_variants(df)
    plan(out)
    assert out.filter("root <> word").count() == 200
    assert sum(p.count("SortMergeJoin") for p in plans) == 8 and not any("Broadcast" in p for p in plans)


def test_registered_spelling(spark, sample, odd, nothing, tmp_path):
    extra = spark.createDataFrame([(k, "Straße STRASSE Überfluß überfluss ÀÉÎ× naïve Naïve naive × ÷÷÷÷÷÷ " * 4) for k in range(40)], "doc_id long, text string")
    for name, docs in (("sample", sample), ("odd", odd), ("none", nothing), ("extra", extra.withColumn("word", F.lit("w")))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = Q.op12_spelling(spark, f"{tmp_path}/{name}").select("word", "form", "root", "n", "n_near", "form_n").collect()
        want = plain_variants(plain_words_of([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        assert name != "sample" or (len(want) > 300 and any(r[1] for r in want))
