"""Periodic runs of words: stretches that repeat with a period, found by a dictionary of basic factors.

A run is a stretch with least period q, at least max(least, copies * q) words long, which no neighbouring word extends. The
dictionary names the factors of each power-of-two length L: those of 2 L are pairs of names of L. A factor's successor is its next
occurrence. Where neighbouring places all have their successors at the same distance d, at most 2 L, the occurrences form
arithmetic progressions: the stretch of such places proposes the period d. Proposals are extended to both sides and those
that meet in one run are told apart by their period and end.

Why none is missed: in a run of period q take the least L >= q. A factor of that length holds a whole period, which is primitive, so
its successor in the run stands exactly q words on; as L < 2 q and the run has copies >= 4 periods, more than q such places follow each other.
Why the period is the least: a lesser one would bring a nearer successor.

Several texts share one pass: they are laid out in one array with a word of its own between them, so numpy works on some hundred thousand
words at a time. A place whose factor occurs once is left out of all longer lengths; the work is n log n for a text of n words.

Defined results: null or empty text has no words, no runs and an empty collapsed text; rows without id, repeated rows and other columns
are kept as they are (a column with an output's name is replaced); a text of any length is treated whole, in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words laid out for one pass; a longer text has a pass of its own.
PASS_WORDS = 1 << 18
#: Bytes of text in one batch given back to Spark.
BATCH_BYTES = 4 << 20

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _stretch_ends(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch; same[i] tells whether i + 1 goes on with the stretch of i."""
    breaks = np.flatnonzero(~same)
    return np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(same)]])


def _extended(words: np.ndarray, first: int, last: int, d: int) -> tuple[int, int]:
    """The longest stretch around first..last (exclusive end) in which words d apart are equal, by steps that double."""
    step = 8
    while last < len(words):
        differ = words[last : last + step] != words[last - d : last - d + len(words[last : last + step])]
        if differ.any():
            last += int(differ.argmax())
            break
        last, step = last + len(differ), 2 * step
    step = 8
    while first > 0:
        low = max(0, first - step)
        differ = (words[low:first] != words[low + d : first + d])[::-1]
        if differ.any():
            first -= int(differ.argmax())
            break
        first, step = low, 2 * step
    return first, last


def find_runs(words: np.ndarray, least: int = 6, copies: int = 4) -> np.ndarray:
    """start, length and period of every run in an array of word numbers, by start, then period. copies is at least 4."""
    if copies < 4:
        raise ValueError("runs of fewer than four periods are not found whole by this method")
    n, size = len(words), 1
    found: set[tuple[int, int, int]] = set()
    latest: dict[int, tuple[int, int]] = {}
    names = np.unique(words, return_inverse=True)[1].astype(np.int64)
    at = np.arange(n)  # places whose factor may occur again
    while len(at) > 1 and (size == 1 or size // 2 < n // copies):
        order = np.argsort(names, kind="stable")
        again = names[order[1:]] == names[order[:-1]]
        here, there = at[order[:-1][again]], at[order[1:][again]]
        near = there - here <= 2 * size
        here, d = here[near], (there - here)[near]
        sort = np.argsort(here)
        here, d = here[sort], d[sort]
        if len(here):
            lo, hi = _stretch_ends((np.diff(here) == 1) & (np.diff(d) == 0))
            wide = here[hi] - here[lo] >= d[lo]  # more places than one period
            for first, last, period in zip(here[lo[wide]].tolist(), here[hi[wide]].tolist(), d[lo[wide]].tolist()):
                low, high = latest.get(period, (0, 0))
                if low <= first and last + period + size <= high:
                    continue  # within the stretch of this period that was extended last
                latest[period] = low, high = _extended(words, first, last + period + size, period)
                if high - low >= max(least, copies * period):
                    found.add((low, high - low, period))
        # places of names that occur once can't have an equal longer factor
        twice = np.zeros(len(order), bool)
        twice[order[1:][again]] = True
        twice[order[:-1][again]] = True
        number = np.full(n + 1, -1, np.int64)
        number[at[twice]] = names[twice]
        at = at[twice]
        right = number[np.minimum(at + size, n)]
        at, right = at[right >= 0], right[right >= 0]
        names = np.unique(number[at] * (n + 1) + right, return_inverse=True)[1].astype(np.int64)
        size *= 2
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _texts_runs(texts: list[list[bytes]], least: int, copies: int) -> list[np.ndarray]:
    """The runs of each list of words, with starts counted in it."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    numbers: dict[bytes, int] = {}
    laid = np.empty(int(ends[-1]), np.int64)
    for k, (t, end) in enumerate(zip(texts, ends)):
        laid[end - 1 - len(t) : end - 1] = [numbers.setdefault(w, len(numbers)) for w in t]
        laid[end - 1] = -1 - k  # a word of its own
    runs = find_runs(laid, least, copies)
    text = np.searchsorted(ends, runs[:, 0], side="right")
    runs[:, 0] -= np.concatenate([[0], ends])[text]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those in a run after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps)[:n] == 0


def periodic_runs(docs: DataFrame, least: int = 6, copies: int = 4, text: str = "text") -> DataFrame:
    """docs with n_words (bigint), runs (array of start, length, period in words, by start, then period) and collapsed: the words that stay if every run is cut to its first period, joined by one space. Words are divided by ASCII white space."""
    outputs = ("n_words", "runs", "collapsed")
    rest = [c for c in docs.columns if c.lower() not in outputs or c == text]
    source = docs.select(*[F.col(f"`{c}`") for c in rest])
    place = source.columns.index(text)
    kept = [i for i, c in enumerate(rest) if c.lower() not in outputs]
    schema = T.StructType([source.schema[i] for i in kept] + [T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(f"array<{RUN}>")), T.StructField("collapsed", T.StringType())])
    arrow_runs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def judged(part: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = _texts_runs(texts, least, copies)
        collapsed = [b" ".join([w for w, stays in zip(words, _kept(len(words), runs)) if stays] if len(runs) else words).decode() for words, runs in zip(texts, found)]
        flat = np.concatenate(found)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], ["start", "length", "period"])
        ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32))
        columns = [pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(ends, structs).cast(arrow_runs), pa.array(collapsed, pa.string())]
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *columns], [*(rest[i] for i in kept), *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, texts, words, held = 0, [], 0, 0
            for row, value in enumerate(batch.column(place)):
                texts.append((value.as_py() or "").encode().split())
                words, held = words + len(texts[-1]), held + sum(map(len, texts[-1]))
                if words >= PASS_WORDS or held >= BATCH_BYTES or row + 1 == batch.num_rows:
                    yield judged(batch.slice(start, len(texts)), texts)
                    start, texts, words, held = row + 1, [], 0, 0

    return source.mapInArrow(run, schema)


def strongest(runs: str = "runs"):
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null without a run."""
    more = "r.length * best.period > best.length * r.period"
    return F.expr(f"aggregate(`{runs}`, cast(null as {RUN}), (best, r) -> if(best is null or {more}, r, best))")
