"""Language identification by a linear-chain conditional random field over words.

Each word of a text is labelled with a language. The score of a labelling sums, over the words, the
weights of the word's features (affixes, character n-grams, the word itself, and the one language
the lexicon knows it in) and, between neighbours, learned transition weights. Forward-backward gives
every word's marginal distribution; a text's language is the label with the largest mean marginal,
which is its score (ties: the first label in alphabetical order).

The model is fitted on a bounded sample of labelled rows: `per_language` whole documents of each
language, the least by a hash of the id. Every other document of the sample builds the lexicon, the
rest train the weights, also in mixed sequences whose language switches, so that transitions are
learned from code-switched text.

Marginals sum to one over the known labels, whatever the text. Whether it is in any of them is told by
its support: the share of its words' pieces (four letters, word ends among them) that training texts
have. least_support is half of what all but 2 in 100 training texts reach on the pieces of the others.

Nulls, empties: a text that is null or has no letter is `und` with score 0, and so is every text if
no labelled row exists. Labels that are null are not learned from. Repeated rows are returned each.
Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

_RUNS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words in a block of the forward-backward recursion.
_BLOCK = 64
#: Letters in a piece of a word, and pieces that each text is granted, so that a word or two decide nothing.
_PIECE, _GRANTED = 4, 4


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    if not text:
        return []
    own = _RUNS.findall(text.lower())
    if not text.isascii() and not all(map(str.isalpha, own)):
        own = [w for x in own if (w := "".join(filter(str.isalpha, x)))]
    return own


def word_pieces(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[k : k + _PIECE] for k in range(max(1, len(w) - _PIECE + 1))}


def text_support(words: list[str], pieces: frozenset[str], held: dict[str, tuple[int, int]], max_words: int = 250_000) -> float:
    """Share of the words' pieces that are in pieces; held keeps (known, all) of words between texts."""
    if len(held) > max_words:
        held.clear()
    known = total = _GRANTED
    for w, n in Counter(words).items():
        if (x := held.get(w)) is None:
            own = word_pieces(w)
            x = held[w] = (len(own & pieces), len(own))
        known += n * x[0]
        total += n * x[1]
    return known / total


def training_support(texts: list[list[str]]) -> tuple[frozenset[str], float]:
    """The pieces of texts, and the least support of a text in their languages."""
    halves = texts[::2], texts[1::2]
    seen = [frozenset(x for w in {w for own in half for w in own} for x in word_pieces(w)) for half in halves]
    if not all(halves):
        return seen[0] | seen[1], 0.0
    cross = [text_support(own, other, held) for half, other, held in zip(halves, seen[::-1], ({}, {}), strict=True) for own in half]
    return seen[0] | seen[1], 0.5 * float(np.quantile(cross, 0.02))


def _hash(codes: np.ndarray, at: np.ndarray, size: int, salt: int) -> np.ndarray:
    h = np.full(len(at), salt, np.uint64)
    for k in range(size):
        h = (h ^ codes[at + k]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word number) of every affix of 1 to 4, n-gram of 1 to 3 letters and whole word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(words)), n)
    found, of = [], []
    for size in (1, 2, 3):
        at = np.arange(max(0, len(codes) - size + 1))
        at = at[row[at] == row[at + size - 1]]
        found.append(_hash(codes, at, size, size))
        of.append(row[at])
    for size in (1, 2, 3, 4):
        long = np.flatnonzero(n >= size)
        found += [_hash(codes, first[long], size, 16 + size), _hash(codes, first[long] + n[long] - size, size, 32 + size)]
        of += [long, long]
    found.append(np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words)) * _MIX >> np.uint64(20))
    of.append(np.arange(len(words)))
    return (np.concatenate(found) & np.uint64(buckets - 1)).astype(np.int64), np.concatenate(of)


@dataclass
class Crf:
    """labels in alphabetical order; weights[feature, label]; transitions[from, to]; the lexicon
    gives a word's label, whose weight is lexical[known label, label]."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexical: np.ndarray
    lexicon: dict[str, int]
    pieces: frozenset[str] = field(default=frozenset(), repr=False)
    least_support: float = 0.0
    _index: dict = field(default_factory=dict, repr=False)
    _held: dict = field(default_factory=dict, repr=False)
    _scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_index": {}, "_held": {}, "_scores": None}

    def support(self, words: list[str]) -> float:
        return text_support(words, self.pieces, self._held)

    def word_scores(self, words: list[str]) -> np.ndarray:
        feature, row = word_features(words, len(self.weights))
        out = np.stack(
            [np.bincount(row, self.weights[feature, k], minlength=len(words)) for k in range(len(self.labels))], axis=1
        )
        known = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        out[known >= 0] += self.lexical[known[known >= 0]]
        return out

    def unary(self, texts: list[list[str]], max_words: int = 250_000) -> np.ndarray:
        """Scores of all words of all texts. Distinct words are scored once while they are held."""
        if len(self._index) > max_words or self._scores is None:
            self._index, self._scores = {}, np.empty((0, len(self.labels)))
        index = self._index
        new = list({w for own in texts for w in set(own).difference(index)})
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self._scores = np.concatenate([self._scores, self.word_scores(new)])
        at = [np.fromiter(map(index.__getitem__, own), np.int64, len(own)) for own in texts]
        return self._scores[np.concatenate(at)]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Per text an array [word, label] of marginal probabilities; texts have words."""
        lengths = np.array([len(x) for x in texts])
        post = forward_backward(self.unary(texts), lengths, self.transitions)[0]
        return np.split(post, np.cumsum(lengths)[:-1])


def forward_backward(unary: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word of sequences laid end to end, and the summed marginals of neighbouring
    label pairs. Sequences are cut into blocks, which are solved side by side: each block's transfer
    matrix first, then the messages between blocks, then the words within all blocks."""
    m = unary.shape[1]
    step = np.exp(transitions - transitions.max())
    emit = np.exp(unary - unary.max(axis=1, keepdims=True))
    per = -(-lengths // _BLOCK)
    n_blocks = int(per.sum())
    first_block = np.cumsum(per) - per
    word = np.arange(len(unary)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    block = np.repeat(first_block, lengths) + word // _BLOCK
    slot = word % _BLOCK
    e = np.ones((_BLOCK, n_blocks, m))
    live = np.zeros((_BLOCK, n_blocks), bool)
    e[slot, block] = emit
    live[slot, block] = True
    opens = np.zeros(n_blocks, bool)
    opens[first_block] = True

    transfer = np.broadcast_to(np.eye(m), (n_blocks, m, m)).copy()
    transfer[opens] = e[0, opens][:, None, :]
    for t in range(_BLOCK):
        on = live[t] & ~opens if t == 0 else live[t]
        if not on.any():
            continue
        x = (transfer[on] @ step) * e[t, on][:, None, :]
        transfer[on] = x / x.max(axis=(1, 2), keepdims=True)

    enter, leave = np.full((n_blocks, m), 1.0 / m), np.ones((n_blocks, m))
    for k in range(1, int(per.max(initial=1))):
        at = first_block[per > k] + k
        x = np.einsum("bi,bij->bj", enter[at - 1], transfer[at - 1])
        enter[at] = x / x.sum(axis=1, keepdims=True)
        back = first_block[per > k] + per[per > k] - k
        x = np.einsum("bij,bj->bi", transfer[back], leave[back])
        leave[back - 1] = x / x.sum(axis=1, keepdims=True)

    ahead = np.empty((_BLOCK, n_blocks, m))
    now = enter
    before = np.empty((_BLOCK, n_blocks, m))
    for t in range(_BLOCK):
        before[t] = now
        x = now @ step
        if t == 0:
            x[opens] = 1.0
        x *= e[t]
        x /= x.sum(axis=1, keepdims=True)
        now = np.where(live[t][:, None], x, now)
        ahead[t] = now
    post = np.empty((_BLOCK, n_blocks, m))
    pairs = np.zeros((m, m))
    now = leave
    for t in range(_BLOCK - 1, -1, -1):
        x = ahead[t] * now
        post[t] = x / x.sum(axis=1, keepdims=True)
        on = live[t] & ~opens if t == 0 else live[t]
        inner = e[t] * now
        if on.any():
            left, right = before[t, on], inner[on]
            whole = np.einsum("bi,ij,bj->b", left, step, right)
            pairs += step * ((left / whole[:, None]).T @ right)
        x = inner @ step.T
        now = np.where(live[t][:, None], x / x.sum(axis=1, keepdims=True), now)
    return post[slot, block], pairs


def _mixed(texts: list[list[int]], labels: list[int], rng: np.random.Generator, mean: int = 12) -> tuple[list, list]:
    """The texts' words again, as sequences made of short stretches of different texts."""
    parts = []
    for own, label in zip(texts, labels, strict=True):
        k = 0
        while k < len(own):
            n = int(rng.geometric(1 / mean))
            parts.append((own[k : k + n], label))
            k += n
    rng.shuffle(parts)
    rows, tags = [], []
    for k in range(0, len(parts), 6):
        rows.append([w for own, _ in parts[k : k + 6] for w in own])
        tags.append([label for own, label in parts[k : k + 6] for _ in own])
    return rows, tags


def train(sample: list[tuple[str, str]], buckets: int = 1 << 17, rounds: int = 25, rate: float = 0.5, decay: float = 1e-6, support: bool = False) -> Crf:
    """A model from (text, label) pairs, by Adagrad on the conditional likelihood; with support, also the
    pieces of the training texts and least_support."""
    labels = sorted({label for _, label in sample})
    m, number = len(labels), {x: k for k, x in enumerate(labels)}
    texts = [(own, number[label]) for text, label in sample if (own := letter_words(text))]
    seen: dict[str, Counter] = {}
    for own, label in texts[::2]:
        for w in own:
            seen.setdefault(w, Counter())[label] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in seen.items() if len(c) == 1 and c.total() >= 3}
    model = Crf(labels, np.zeros((buckets, m), np.float32), np.zeros((m, m)), np.zeros((m, m)), lexicon)
    if support:
        model.pieces, model.least_support = training_support([own for own, _ in texts])
    learn = texts[1::2] or texts
    if not learn or m < 2:
        return model
    vocabulary: dict[str, int] = {}
    coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in own] for own, _ in learn]
    rows, tags = _mixed(coded, [label for _, label in learn], np.random.default_rng(0))
    rows += coded
    tags += [[label] * len(own) for own, label in learn]
    lengths = np.array([len(x) for x in rows])
    word, tag = np.concatenate([np.array(x) for x in rows]), np.concatenate([np.array(x) for x in tags])
    feature, of = word_features(list(vocabulary), buckets)
    known = np.fromiter((lexicon.get(w, -1) for w in vocabulary), np.int64, len(vocabulary))
    inner = np.ones(len(word), bool)
    inner[np.cumsum(lengths) - lengths] = False
    here = np.flatnonzero(inner)
    true_pairs = np.bincount(tag[here - 1] * m + tag[here], minlength=m * m).reshape(m, m)
    used, feature = np.unique(feature, return_inverse=True)
    w, moved = np.zeros((len(used), m)), [np.full((len(used), m), 1e-8), np.full((m, m), 1e-8), np.full((m, m), 1e-8)]
    total = len(word)
    true_words = np.bincount(word * m + tag, minlength=len(vocabulary) * m).reshape(-1, m)
    for _ in range(rounds):
        scores = np.stack([np.bincount(of, w[feature, k], minlength=len(vocabulary)) for k in range(m)], axis=1)
        scores[known >= 0] += model.lexical[known[known >= 0]]
        post, pairs = forward_backward(scores[word], lengths, model.transitions)
        miss = (np.stack([np.bincount(word, post[:, k], minlength=len(vocabulary)) for k in range(m)], axis=1) - true_words) / total
        grads = [
            np.stack([np.bincount(feature, miss[of, k], minlength=len(used)) for k in range(m)], axis=1) + decay * w,
            np.stack([miss[known == k].sum(axis=0) for k in range(m)]),
            (pairs - true_pairs) / total,
        ]
        for value, grad, past in zip((w, model.lexical, model.transitions), grads, moved, strict=True):
            past += grad**2
            value -= rate * grad / np.sqrt(past)
    model.weights[used] = w
    return model


def held_out(id_col: str) -> Column:
    """Rows that are kept from training: CRC-32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(
    docs: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int, max_chars: int, max_labels: int
) -> list[tuple[str, str]]:
    """(text, label) of the sample that fit() describes; all bounds hold before anything is collected."""
    rows = docs.filter(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(id_col).alias("h")
    )
    most = rows.groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(max_labels)
    counts = {r.label: r["count"] for r in most.collect()}
    if not counts:
        return []
    unit, chars = 1 << 20, max_chars // len(counts)
    share = F.create_map(
        *[x for k, c in counts.items() for x in (F.lit(k), F.lit(min(unit, 2 + int(unit * (per_language + 4 * per_language**0.5) / c))))]
    )
    first = [F.pmod("h", F.lit(unit)), F.col("h"), F.col("text")]
    near = rows.filter((F.length("text") <= chars) & (F.pmod("h", F.lit(unit)) < share[F.col("label")]))
    upto = W.partitionBy("label").orderBy(*first).rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("n", F.count("*").over(upto)).withColumn("chars", F.sum(F.length("text").cast("long")).over(upto))
    taken = near.filter((F.col("n") <= per_language) & (F.col("chars") <= chars)).select("text", "label", "h").collect()
    return [(r.text, r.label) for r in sorted(taken, key=lambda r: (r.h % unit, r.label, r.text))]


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    per_language: int = 120,
    max_chars: int = 4_000_000,
    max_labels: int = 200,
    support: bool = False,
) -> Crf:
    """A model from the labelled rows of docs that are not held out: of each of the max_labels labels that
    have most rows (ties: alphabetically), up to per_language whole documents, the least by a hash of the
    id, while they fit in the label's even share of max_chars; longer documents are left out of the sample."""
    sample = training_rows(docs, id_col, text_col, label_col, per_language, max_chars, max_labels)
    if not sample:
        return Crf([], np.zeros((1, 0), np.float32), np.zeros((0, 0)), np.zeros((0, 0)), {})
    return train(sample, support=support)


_MODELS: dict[str, Crf] = {}


def _held(sent) -> Crf:
    """The model of a broadcast; a worker keeps it, with the words it has scored, between tasks."""
    if sent.value[0] not in _MODELS:
        _MODELS.clear()
        _MODELS[sent.value[0]] = sent.value[1]
    return _MODELS[sent.value[0]]


def tagged(
    docs: DataFrame,
    model: Crf,
    text_col: str = "text",
    keep: list[str] | None = None,
    added: tuple[str, ...] = ("lang_pred", "score"),
    texts_at_once: int = 128,
) -> DataFrame:
    """Every row of docs with its columns (or those in keep), its predicted language and its score
    under the added names (see common.fresh() where docs may have them); a third name gets its support."""
    names = list(docs.columns if keep is None else keep)
    schema = T.StructType(
        [docs.schema[c] for c in names] + [T.StructField(added[0], T.StringType())] + [T.StructField(c, T.DoubleType()) for c in added[1:]]
    )
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = _held(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(at, texts_at_once)
                texts = part.column(part.num_columns - 1 if text_col not in names else names.index(text_col))
                own = [letter_words(x.as_py()) for x in texts] if crf.labels else [[]] * part.num_rows
                some = [k for k, x in enumerate(own) if x]
                pred, score = ["und"] * len(own), [0.0] * len(own)
                for k, p in zip(some, crf.marginals([own[k] for k in some]) if some else [], strict=True):
                    mean = p.mean(axis=0)
                    best = int(mean.argmax())
                    pred[k], score[k] = crf.labels[best], min(1.0, float(mean[best]))
                columns = [*part.columns[: len(names)], pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                if len(added) > 2:
                    columns.append(pa.array([crf.support(x) if x else 0.0 for x in own], pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*names, *([] if text_col in names else [text_col])).mapInArrow(run, schema)


def predict(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row of docs."""
    return tagged(docs, model, text_col, keep=[id_col])


def label_words(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, words, langs): every word of every row with its most likely language."""
    words = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("words", words), T.StructField("langs", words)])
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = _held(sent)
        for batch in batches:
            own = [letter_words(x.as_py()) for x in batch.column(1)]
            langs = [
                [crf.labels[k] for k in crf.marginals([x])[0].argmax(axis=1)] if x and crf.labels else ["und"] * len(x) for x in own
            ]
            form = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, form), pa.array(langs, form)], names=schema.names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
