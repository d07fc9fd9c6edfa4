"""Language of every word, and so of every text, by a linear-chain conditional random field.

A word's features are its affixes, its letter n-grams, its spelling and the lexicons that hold it; a long run
without white space is cut and each piece is a word. Their
weights and the transitions between languages are learned together by gradient steps on the likelihood.
Forward-backward gives each word the probability of each language given the whole text, so that a switch
inside a text costs a transition. A text's language is the one with most probability over its letters.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.common import lean, remainder, set_aside

#: Labelled documents the model is fitted on, about, dealt evenly over the languages; prediction covers every row.
SAMPLE = 3_000
FOLDS = 3
#: Words of one training sequence, of one span in it, and spans taken from a sampled document.
SEQUENCE, SPAN, SPANS = 60, 20, 4
#: Hashed features; one more row holds nothing and fills gaps.
SIZE = 1 << 16
#: Letters of the longest word that is one place of a chain, and letters of an affix.
LETTERS, AFFIX = 16, 3
#: Words of each language's lexicon.
LEXICON = 300
EPOCHS, BATCH, RATE = 5, 64, 0.4
#: Words that one round of forward-backward holds; distinct words whose scores a task remembers (more are worked out anew).
HELD, REMEMBERED = 300_000, 200_000
UNKNOWN = "und"
#: Probability below which the pipeline rejects a text.
LEAST = 0.4


def hashes(words: list[str]) -> np.ndarray:
    """Feature numbers, one row for each word: spelling first, then prefixes, suffixes, bigrams and trigrams."""
    n = len(words)
    head = np.zeros((n, LETTERS + 2), dtype=np.uint64)
    chars = np.array([w[:LETTERS] for w in words], dtype=f"<U{LETTERS}").view(np.uint32).reshape(n, LETTERS)
    size = np.minimum(np.array([len(w) for w in words]), LETTERS)
    head[:, 1:-1] = chars
    head[:, 0] = 2
    head[np.arange(n), size + 1] = 3
    tail = np.array([w[::-1][:AFFIX] for w in words], dtype=f"<U{AFFIX}").view(np.uint32).reshape(n, AFFIX).astype(np.uint64)
    prime = np.uint64(0x9E3779B97F4A7C15)

    def mix(kind: int, parts: list[np.ndarray], there: np.ndarray) -> np.ndarray:
        h = np.full(n, kind + 1, dtype=np.uint64) * prime
        for p in parts:
            h = (h ^ p) * prime
            h ^= h >> np.uint64(29)
        return np.where(there, (h * prime >> np.uint64(40)).astype(np.int64) % SIZE, SIZE)

    always = np.ones(n, dtype=bool)
    whole = np.array([hash_word(w) for w in words], dtype=np.uint64)
    out = [mix(0, [whole], always)]
    for k in range(1, AFFIX + 1):
        out.append(mix(k, [head[:, i] for i in range(1, k + 1)], size >= k))
        out.append(mix(AFFIX + k, [tail[:, i] for i in range(k)], size >= k))
    for width, kind in ((2, 10), (3, 11)):
        for at in range(LETTERS + 3 - width):
            out.append(mix(kind, [head[:, at + i] for i in range(width)], size + 2 >= at + width))
    return np.stack(out, axis=1)


def hash_word(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


@dataclass
class Model:
    """Languages, feature weights, transition scores and the lexicons' words."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)

    def features(self, words: list[str]) -> np.ndarray:
        known = np.array([self.lexicon.get(w, -1) for w in words], dtype=np.int64)
        return np.concatenate([hashes(words), np.where(known >= 0, SIZE + 1 + known, SIZE)[:, None]], axis=1)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        for at in range(0, len(words), 20_000):
            out[at:at + 20_000] = self.weights[self.features(words[at:at + 20_000])].sum(axis=1)
        return out


def forward_backward(scores: np.ndarray, there: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language probabilities of each place, and of each move between neighbours summed over all, of a padded batch of chains.

    ``scores`` is (chains, places, languages); places beyond a chain's end are not ``there`` and pass everything on.
    """
    b, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True)).transpose(1, 0, 2).astype(np.float64)
    on = there.T[:, :, None]
    m = np.exp(moves)
    fore, back = np.empty((t, b, k)), np.ones((t, b, k))
    a = e[0] / e[0].sum(axis=1, keepdims=True)
    fore[0] = a
    for i in range(1, t):
        a = np.where(on[i], (a @ m) * e[i], a)
        a /= a.sum(axis=1, keepdims=True)
        fore[i] = a
    z = np.ones((b, k)) / k
    back[t - 1] = z
    for i in range(t - 1, 0, -1):
        z = np.where(on[i], (e[i] * z) @ m.T, z)
        z /= z.sum(axis=1, keepdims=True)
        back[i - 1] = z
    p = fore * back
    p /= p.sum(axis=2, keepdims=True)
    moved = np.zeros((k, k))
    return p.transpose(1, 0, 2), moved if t < 2 else _moves(fore, back, e, on, m)


def _moves(fore: np.ndarray, back: np.ndarray, e: np.ndarray, on: np.ndarray, m: np.ndarray) -> np.ndarray:
    pair = fore[:-1, :, :, None] * m * (e[1:] * back[1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return (pair * on[1:, :, :, None]).sum(axis=(0, 1))


def pieces_of(text: str | None) -> list[str]:
    """Lower-cased words; a longer run without white space is cut into pieces of ``LETTERS``, so that all of it is seen."""
    words = (text or "").lower().split()
    if max(map(len, words), default=0) <= LETTERS:
        return words
    return [w[at:at + LETTERS] for w in words for at in range(0, len(w), LETTERS)]


def words_of(text: str | None) -> list[str]:
    """Words, or pieces of long ones, that hold a letter."""
    return [w for w in pieces_of(text) if any(c.isalpha() for c in w)]


def fit(spans: list[tuple[str, list[str]]], seed: int = 11) -> Model:
    """Learn from labelled runs of words. Runs of different documents are strung together, so that switches occur."""
    langs = sorted({lang for lang, _ in spans})
    k = len(langs)
    at = {lang: i for i, lang in enumerate(langs)}
    counts = [Counter() for _ in langs]
    for lang, words in spans:
        counts[at[lang]].update(words)
    total = sum(counts, Counter())
    lexicon = {w: i for i in range(k) for w, n in sorted(counts[i].items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if 2 * n > total[w]}
    model = Model(langs, np.zeros((SIZE + 1 + k, k), dtype=np.float32), np.zeros((k, k)), lexicon)
    if k < 2:
        return model
    rng = np.random.default_rng(seed)
    vocabulary = {w: i for i, w in enumerate(sorted(total))}
    table = model.features(list(vocabulary))
    squares, move_squares = np.full(model.weights.shape, 1e-6, dtype=np.float32), np.full((k, k), 1e-6)
    runs = [(np.array([vocabulary[w] for w in words]), at[lang]) for lang, words in spans if words]
    for _ in range(EPOCHS):
        sequences, ids, tags = [], [], []
        for i in rng.permutation(len(runs)):
            ids.append(runs[i][0])
            tags.append(np.full(len(runs[i][0]), runs[i][1]))
            if sum(map(len, ids)) >= SEQUENCE:
                sequences.append((np.concatenate(ids)[:SEQUENCE], np.concatenate(tags)[:SEQUENCE]))
                ids, tags = [], []
        if ids:
            sequences.append((np.concatenate(ids), np.concatenate(tags)))
        for lo in range(0, len(sequences), BATCH):
            some = sequences[lo:lo + BATCH]
            width = max(len(s) for s, _ in some)
            word, tag = np.zeros((len(some), width), dtype=np.int64), np.full((len(some), width), -1)
            for r, (s, g) in enumerate(some):
                word[r, : len(s)], tag[r, : len(s)] = s, g
            there = tag >= 0
            f = table[word]
            p, moved = forward_backward(model.weights[f].sum(axis=2), there, model.moves)
            pull = (np.eye(k)[np.maximum(tag, 0)] - p) * there[:, :, None]
            own, inverse = np.unique(f[there], return_inverse=True)
            inverse = inverse.reshape(-1)
            grad = np.stack([np.bincount(inverse, np.repeat(pull[there][:, c], f.shape[2]), len(own)) for c in range(k)], axis=1) / len(some)
            grad[own == SIZE] = 0
            grad -= 1e-5 * model.weights[own]
            squares[own] += grad ** 2
            model.weights[own] += RATE * grad / np.sqrt(squares[own])
            seen = np.zeros((k, k))
            both = there[:, 1:]
            np.add.at(seen, (tag[:, :-1][both], tag[:, 1:][both]), 1)
            g = (seen - moved) / len(some)
            move_squares += g ** 2
            model.moves += 0.1 * g / np.sqrt(move_squares)
    return model


def sampled(docs: DataFrame, size: int = SAMPLE) -> list[tuple[str, list[str]]]:
    """Runs of words of about ``size`` training documents, as many of each language; a hash of doc_id chooses them.

    Every sampled document gives up to ``SPANS`` runs of ``SPAN`` words, spread over its length, so the driver
    holds at most about ``size * SPANS * SPAN`` words whatever the lengths of the texts.
    """
    rows = docs.select("doc_id", "lang", "text").filter((remainder(F.col("doc_id"), FOLDS) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000))
    limit = F.lit(1e9) * size / (F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) * F.col("n"))
    shares = counts.select(F.col("lang").alias("_l"), limit.alias("_limit"))
    chosen = rows.join(F.broadcast(shares), F.col("lang") == F.col("_l")).filter(part < F.col("_limit")).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                step = max(SPAN, len(words) // SPANS)
                out += [(doc_id, i, lang, words[i:i + SPAN]) for i in range(0, len(words), step)][:SPANS]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["doc_id", "at", "lang", "words"])

    got = chosen.mapInArrow(run, "doc_id long, at long, lang string, words array<string>").limit(2 * size * SPANS).collect()
    return [(r["lang"], r["words"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["at"], r["lang"]))]


class Labeller:
    """Applies a model to texts; remembers the scores of words, which changes no result."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)

    def look_up(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        if len(rows) > REMEMBERED:
            rows.clear()
            self.scores, self.letters = self.scores[:0], self.letters[:0]
        start = len(rows)
        ids = np.fromiter((rows.setdefault(w, len(rows)) for w in words), dtype=np.int64, count=len(words))
        if len(rows) > start:
            new = list(rows)[start:] if start < len(rows) // 2 else [w for w, i in rows.items() if i >= start]
            self.scores = np.concatenate([self.scores, self.model.emissions(new)])
            self.letters = np.concatenate([self.letters, np.array([sum(map(str.isalpha, w)) for w in new])])
        return ids

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and probability of each text, weighted by letters."""
        k = len(self.model.langs)
        if not k:
            return [(UNKNOWN, 0.0)] * len(texts)
        out = [(UNKNOWN, 0.0)] * len(texts)
        split = [pieces_of(t) for t in texts]
        flat = self.look_up([w for words in split for w in words])
        ends = np.cumsum([len(w) for w in split])
        flat_letters = self.letters[flat]
        chains = []
        for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
            own = flat[a:b][flat_letters[a:b] > 0]
            if len(own):
                chains.append((len(own), i, own))
        chains.sort(key=lambda c: c[:2])
        while chains:
            width = chains[-1][0]
            take = max(1, HELD // width)
            some, chains = chains[-take:], chains[:-take]
            ids, there = np.zeros((len(some), width), dtype=np.int64), np.zeros((len(some), width), dtype=bool)
            for r, (n, _, own) in enumerate(some):
                ids[r, :n], there[r, :n] = own, True
            p = posterior(self.scores[ids], there, self.model.moves)
            weight = self.letters[ids] * there
            share = (p * weight[:, :, None]).sum(axis=1) / weight.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            for r, (_, i, _) in enumerate(some):
                out[i] = (self.model.langs[best[r]], float(min(1.0, share[r, best[r]])))
        return out


def posterior(scores: np.ndarray, there: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The first half of :func:`forward_backward`: chains are padded at their ends only, so the forward pass just stops counting there."""
    b, t, k = scores.shape
    e = np.ascontiguousarray(np.exp(scores - scores.max(axis=2, keepdims=True)).transpose(1, 0, 2))
    m = np.exp(moves).astype(np.float32)
    e[~there.T] = 1
    fore = np.empty((t, b, k), dtype=np.float32)
    a = e[0]
    fore[0] = a
    for i in range(1, t):
        a = (a @ m) * e[i]
        a /= a.sum(axis=1, keepdims=True)
        fore[i] = a
    z = np.ones((b, k), dtype=np.float32)
    for i in range(t - 1, 0, -1):
        z = np.where(there[:, i, None], (e[i] * z) @ m.T, z)
        z /= z.sum(axis=1, keepdims=True)
        fore[i - 1] *= z
    fore /= fore.sum(axis=2, keepdims=True)
    return fore.transpose(1, 0, 2)


def predicted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``.

    A null text, or one without a letter, is ``und`` with score 0; so is every text when there is nothing to
    learn from. With a single language every other text is of that language. Repeated rows get equal
    results; equal probabilities go to the language that sorts first; ``lang``, ``source`` and ``doc_id``
    are never looked at. Columns of ``docs`` named like the new ones are replaced.
    """
    model = model or fit(sampled(docs))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SIZE and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                lang, score = zip(*labeller.label(some.column(keep.index("text")).to_pylist()))
                made = [pa.array(lang), pa.array(score, type=pa.float64())]
                yield pa.RecordBatch.from_arrays([*some.columns, *made], [*keep, "lang_pred", "score"])

    slim = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*slim.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return slim.mapInArrow(lean(run), schema)


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; one without doc_id is not held out."""
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == 1, F.lit(False)).alias("held_out")
    model = fit(sampled(docs))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


def known_language(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``least`` probability, all columns as they were."""
    model = fit(sampled(docs))
    slim, back = set_aside(docs, ("text",))
    return back(predicted(slim, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)))
