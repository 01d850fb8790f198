"""Language of whole texts by a linear-chain conditional random field over their words.

A word's features are its character 2- to 4-grams with word-edge marks (those at an edge are its affixes) and its entry in a
lexicon of the fitted sample; transitions between the labels of neighbouring words are learned too. Training sequences join segments
of documents of the same and of different languages, so that code-switching has a price that fits the data. Forward-backward
gives each word a distribution over labels; a text's language is the label with the largest mean, which is its score.

Forward-backward is exact for texts of any length: texts are cut into blocks whose transfer matrices carry the messages across,
and all blocks of a batch advance together.

Defined results: a null text or one without letters is `und` with score 0; so is every text if there is nothing to learn from.
Every value of lang is learned, however many there are: the sample shrinks to LEAST_DOCUMENTS of each, and the fit holds a bounded number of sequences at a
time, so its memory is the weights (buckets x languages) and the words of the sample (words x languages), in single precision. Its time grows with the
square of the languages. Of languages with equal scores the first in code-point order is taken.
Repeated rows get equal results. Extra columns stay; columns named as an output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm.base import as_small, id_hash, written

#: Of each language about so many documents are fitted on, fewer where there would be more than ALL_DOCUMENTS, but at least LEAST_DOCUMENTS; and of each
#: document so many segments of so many words, spread over it.
DOCUMENTS, ALL_DOCUMENTS, LEAST_DOCUMENTS, SEGMENTS, SEGMENT_WORDS = 150, 2400, 15, 4, 24
#: Sequences, and words of the sample, that the fit treats at a time.
SEQUENCES, WORDS_AT_ONCE = 512, 4096
#: Buckets for n-grams, most lexicon entries, steps and rate of the fit, weight of the squared weights.
BUCKETS, LEXICON, STEPS, RATE, DECAY = 1 << 15, 4000, 60, 0.15, 1e-4
#: Words in a block, words that advance together, words remembered by a Python worker (a full memory is emptied); the last two for up to four languages, fewer for more.
BLOCK, TOGETHER, CACHE_ENTRIES = 1024, 1_000_000, 500_000
LETTERS = re.compile(r"[^\W\d_]+")
NGRAMS = (2, 3, 4)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of marked words, and the word that each belongs to."""
    marked = "".join([f"\x02{w}\x03" for w in words])
    code = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    buckets, owners = [], []
    for n in NGRAMS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h ^ code[j : len(code) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = of[: len(h)] == of[n - 1 :]
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(of[: len(h)][inside])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def normal(x: np.ndarray) -> np.ndarray:
    """Scaled to sum 1 along the last axis."""
    return x / x.sum(axis=-1, keepdims=True)


@dataclass
class Field:
    """The fitted model: weights of buckets and lexicon entries, transition scores."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        buckets, owners = grams(words)
        known = [(BUCKETS + self.lexicon[w], i) for i, w in enumerate(words) if w in self.lexicon]
        if known:
            extra = np.array(known, np.int64)
            buckets, owners = np.concatenate([buckets, extra[:, 0]]), np.concatenate([owners, extra[:, 1]])
        return buckets, owners

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row of potentials (largest 1) for each word."""
        buckets, owners = self.features(words)
        total = np.stack([np.bincount(owners, self.weights[buckets, k], len(words)) for k in range(len(self.labels))], axis=1)
        return np.exp(total - total.max(axis=1, keepdims=True)) + 1e-9

    def marginals(self, potential: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over each sequence of the words' label distributions. potential: the words' rows, sequence after sequence."""
        k, move = len(self.labels), np.exp(self.moves)
        per = -(-lengths // BLOCK)
        seq = np.repeat(np.arange(len(lengths)), per)
        nth = np.arange(len(seq)) - np.repeat(np.cumsum(per) - per, per)
        start = np.repeat(np.cumsum(lengths) - lengths, per) + nth * BLOCK
        size = np.minimum(BLOCK, np.repeat(lengths, per) - nth * BLOCK)
        order = np.argsort(-size, kind="stable")
        seq, nth, start, size = seq[order], nth[order], start[order], size[order]
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        enter, leave = np.full((len(seq), k), 1.0 / k), np.ones((len(seq), k))
        many = np.repeat(per, per)[order] > 1
        if many.any():
            rows = np.flatnonzero(many)
            carry = np.broadcast_to(np.eye(k), (len(rows), k, k)).copy()
            for t in range(size[rows].max()):
                on = size[rows] > t
                step = (carry[on] @ move) * potential[start[rows[on]] + t][:, None, :]
                carry[on] = step / step.max(axis=(1, 2), keepdims=True)
            place = {(s, n): i for i, (s, n) in enumerate(zip(seq[rows], nth[rows], strict=True))}
            at = np.array([[place.get((s, n), -1) for n in range(nth[rows].max() + 1)] for s in np.unique(seq[rows])])
            for n in range(at.shape[1] - 1):
                a = at[at[:, n + 1] >= 0]
                enter[rows[a[:, n + 1]]] = normal(np.einsum("bi,bij->bj", enter[rows[a[:, n]]], carry[a[:, n]]))
            for n in range(at.shape[1] - 2, -1, -1):
                a = at[at[:, n + 1] >= 0]
                leave[rows[a[:, n]]] = normal(np.einsum("bij,bj->bi", carry[a[:, n + 1]], leave[rows[a[:, n + 1]]]))
        ahead, state = np.empty(potential.shape), enter
        for t, n in enumerate(active):
            state = normal((state[:n] @ move) * potential[start[:n] + t])
            ahead[start[:n] + t] = state
        sums, back = np.zeros((len(seq), k)), leave
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            sums[:n] += normal(ahead[start[:n] + t] * back[:n])
            back[:n] = normal((potential[start[:n] + t] * back[:n]) @ move.T)
        total = np.zeros((len(lengths), k))
        np.add.at(total, seq, sums)
        return total


def of_each(languages: int) -> int:
    """Documents of each language in the sample."""
    return max(LEAST_DOCUMENTS, min(DOCUMENTS, ALL_DOCUMENTS // max(1, languages)))


def segments(docs: DataFrame, usable: Column | None, lang: str, text: str, doc_id: str) -> list[tuple[str, list[str]]]:
    """(language, words) of evenly spread segments of about of_each() documents of each language, chosen by a hash of id and language."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.where(usable) if usable is not None else known
    counted = written(known.groupBy(F.col(lang).alias("_name")).agg(F.count(F.lit(1)).alias("_n")), "languages")
    many = counted.count()
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.lit("langid")), F.lit(1_000_000))
    bound = F.least(F.lit(1_000_000), F.floor(F.lit(1_000_000.0 * of_each(many)) / F.col("_n")))
    drawn = known.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), draw.alias("_draw"))
    drawn = drawn.join(as_small(counted, many, 128), F.col("_lang") == F.col("_name")).where(F.col("_draw") < bound).select("_lang", "_text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(value)
                for i in range(SEGMENTS):
                    at = (len(words) - SEGMENT_WORDS) * i // (SEGMENTS - 1)
                    if at < 0 and i:
                        break
                    part = words[max(at, 0) : max(at, 0) + SEGMENT_WORDS]
                    if part:
                        names.append(name)
                        found.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.list_(pa.string()))], ["lang", "words"])

    rows = drawn.mapInArrow(cut, "lang string, words array<string>").collect()
    return sorted((r["lang"], list(r["words"])) for r in rows)


def fit(docs: DataFrame, usable: Column | None = None, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", seed: int = 5) -> Field:
    """Fits the field on a bounded sample of the rows where lang is not null and usable holds."""
    found = segments(docs, usable, lang, text, doc_id)
    labels = sorted({name for name, _ in found})
    k = len(labels)
    counts = Counter((w, name) for name, ws in found for w in ws)
    frequent = sorted({w for (w, _), n in counts.most_common() if n >= 3}, key=lambda w: (-sum(counts[w, x] for x in labels), w))[:LEXICON]
    model = Field(labels, np.zeros((BUCKETS + len(frequent), k), np.float32), np.zeros((k, k)), {w: i for i, w in enumerate(frequent)})
    if k < 2:
        return model
    random = np.random.default_rng(seed)
    order = random.permutation(len(found))
    joined = [[found[i] for i in order[j : j + 3]] for j in range(0, len(order), 3)]
    joined += [[found[i], found[i]] for i in order]  # most neighbours in real texts share their language
    length = max(sum(len(ws) for _, ws in s) for s in joined)
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in found for w in ws}))}
    ids, truth, lens = np.zeros((len(joined), length), np.int64), np.zeros((len(joined), length), np.int64), np.zeros(len(joined), np.int64)
    for row, parts in enumerate(joined):
        at = 0
        for name, ws in parts:
            ids[row, at : at + len(ws)] = [vocabulary[w] for w in ws]
            truth[row, at : at + len(ws)] = labels.index(name)
            at += len(ws)
        lens[row] = at
    mask = np.arange(length)[None, :] < lens[:, None]
    buckets, owners = model.features(list(vocabulary))
    starts = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(vocabulary)))])  # features of a word stand together
    by_owner = np.argsort(owners, kind="stable")
    buckets = buckets[by_owner]
    moved, total = np.zeros((k, k)), mask.sum()
    both = mask[:, 1:]
    np.add.at(moved, (truth[:, :-1][both], truth[:, 1:][both]), 1.0)
    speed = [(np.zeros_like(x), np.zeros_like(x)) for x in (model.weights, model.moves)]
    for step in range(1, STEPS + 1):
        gap, pairs = expectations(model, buckets, starts, ids, lens)
        np.add.at(gap, (ids[mask], truth[mask]), np.float32(-1.0))
        slope = DECAY * model.weights
        for at in range(0, len(vocabulary), WORDS_AT_ONCE):
            _scatter(slope, buckets, starts, gap, at, min(at + WORDS_AT_ONCE, len(vocabulary)), 1.0 / total)
        for x, g, (m, v) in zip((model.weights, model.moves), (slope, (pairs - moved) / total + DECAY * model.moves), speed, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model


def _gathered(weights: np.ndarray, buckets: np.ndarray, starts: np.ndarray, a: int, b: int) -> np.ndarray:
    """Scores of the words a to b: the sums of their features' weights."""
    rows = weights[buckets[starts[a] : starts[b]]]
    return np.add.reduceat(rows, starts[a:b] - starts[a], axis=0)  # no word is without features


def _scatter(slope: np.ndarray, buckets: np.ndarray, starts: np.ndarray, gap: np.ndarray, a: int, b: int, scale: float) -> None:
    """Adds each word's gap, scaled, to the slopes of its features."""
    of = np.repeat(np.arange(a, b), np.diff(starts[a : b + 1]))
    own = buckets[starts[a] : starts[b]]
    order = np.argsort(own, kind="stable")
    rows, first = np.unique(own[order], return_index=True)
    slope[rows] += np.add.reduceat(gap[of[order]], first, axis=0) * scale


def expectations(model: Field, buckets: np.ndarray, starts: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the model expects each word of the sample with each label, and each pair of neighbouring labels, over all sequences: forward-backward, some sequences at a time. A pair's sum over sequences is one product of matrices, so nothing of sequences x labels x labels is held."""
    n_words, k = len(starts) - 1, len(model.labels)
    potential = np.empty((n_words, k), np.float32)
    for a in range(0, n_words, WORDS_AT_ONCE):
        scores = _gathered(model.weights, buckets, starts, a, min(a + WORDS_AT_ONCE, n_words))
        potential[a : a + len(scores)] = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-9
    move, expected, pairs = np.exp(model.moves).astype(np.float32), np.zeros((n_words, k), np.float32), np.zeros((k, k))
    for a in range(0, len(ids), SEQUENCES):
        own, size = ids[a : a + SEQUENCES], lens[a : a + SEQUENCES]
        length = int(size.max())
        ahead, state = np.empty((length, len(own), k), np.float32), np.full((len(own), k), 1.0 / k, np.float32)
        for t in range(length):
            ahead[t] = state = normal((state @ move) * potential[own[:, t]])
        back, one = np.ones((len(own), k), np.float32), np.float32(1.0)
        for t in range(length - 1, -1, -1):
            on = size > t
            back = np.where(on[:, None], back, one)
            ready = potential[own[:, t]] * back
            post = normal(ahead[t] * back)
            if t:
                before, after = ahead[t - 1][on], ready[on]
                weight = ((before @ move) * after).sum(axis=1, keepdims=True)
                pairs += move * ((before / weight).T @ after)
            ahead[t] = post  # read by none of the places that are left
            back = normal(np.where(on[:, None], ready @ move.T, one))
        there = np.arange(length)[None, :] < size[:, None]
        words, post = own[:, :length][there], ahead.transpose(1, 0, 2)[there]
        order = np.argsort(words, kind="stable")
        rows, first = np.unique(words[order], return_index=True)
        expected[rows] += np.add.reduceat(post[order], first, axis=0)
    return expected, pairs


class _Memory(dict):
    """Word -> number; words met for the first time wait in fresh. Runs without a letter have number -1."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.known = 0

    def __missing__(self, word: str) -> int:
        if not (word.isalpha() or any(map(str.isalpha, word))):
            self[word] = -1
            return -1
        self[word] = number = self.known
        self.known += 1
        self.fresh.append(word)
        return number


def predict(docs: DataFrame, model: Field, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds lang_pred and score (0 to 1) to the other columns of docs; the text stays."""
    taken = {lang_pred.lower(), score.lower()}
    rest = [c for c in docs.columns if c.lower() not in taken or c == text]
    source = docs.select(*[F.col(f"`{c}`") for c in rest])
    place = rest.index(text)
    kept = [i for i, c in enumerate(rest) if c.lower() not in taken]
    schema = T.StructType([source.schema[i] for i in kept] + [T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_ = shared.value
        k = len(field_.labels)
        together, entries = (max(BLOCK, n * 4 // max(4, k)) for n in (TOGETHER, CACHE_ENTRIES))  # a row of k numbers for each
        memory, table = _Memory(), np.zeros((0, max(k, 1)))
        for batch in batches:
            best, share = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            waiting: list[tuple[int, np.ndarray]] = []
            held = 0
            for row, value in enumerate(batch.column(place) if k else []):
                found = LETTERS.findall(value.as_py().lower()) if value.is_valid else []
                ids = np.fromiter(map(memory.__getitem__, found), np.int64, len(found))
                ids = ids[ids >= 0]
                if len(ids):
                    waiting.append((row, ids))
                    held += len(ids)
                if waiting and (held >= together or row + 1 == batch.num_rows):  # the last row may add nothing
                    if memory.fresh:
                        table = np.concatenate([table, field_.emissions(memory.fresh)])
                        memory.fresh.clear()
                    lengths = np.array([len(i) for _, i in waiting])
                    sums = field_.marginals(table[np.concatenate([i for _, i in waiting])], lengths) / lengths[:, None]
                    rows = [r for r, _ in waiting]
                    best[rows], share[rows] = sums.argmax(axis=1), np.clip(sums.max(axis=1), 0, 1)
                    waiting, held = [], 0
                    if len(memory) > entries:
                        memory, table = _Memory(), np.zeros((0, k))
            names = pa.array([field_.labels[b] if b >= 0 else "und" for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), names, pa.array(share)], [*(rest[i] for i in kept), lang_pred, score])

    return source.mapInArrow(run, schema)


def learnable(doc_id: str = "doc_id", folds: int = 4, held: int = 2) -> Column:
    """Whether an id is outside the held-out fold."""
    return id_hash(doc_id) % folds != held
