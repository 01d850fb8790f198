"""Exact repeats of at least SPAN bytes, by naming and sorting sampled places that stand alike in equal strings.

A window is SPAN bytes from one place. Its anchor is the place of the least hash of KEY bytes in it, so equal windows have equal anchors
at equal offsets: the anchors are a cover in which the difference of two equal windows' anchors is that of the windows. Windows
that share an anchor's place are one context (the bytes that they cover).

1. Anchors of all documents with a hash of each context. An anchor met once ends here; if all contexts of an anchor are equal, all
   their windows repeat; an equal context met twice repeats too. No bytes are moved for these.
2. Of the other contexts, one of each kind, every STEP-th place counted from the anchor is sampled and named by the CORE bytes from
   there. A window begins up to EDGE bytes before a sampled place, so it is the name, its leading bytes and the bytes after the core.
3. Places whose name is met once end here. Where all places of a name have equal bytes around, all their windows repeat. Of the rest, one
   of each kind is taken apart into its windows, which are merged by (name, leading bytes, last bytes), and neighbours compared.
4. Spans are united per document.

The rows are linear in the contexts at every size: at most a row per sampled place in 2 and STEP rows per different place in 3. A key,
name or window with a third of all rows is joined on its own (join_counted). Names have 128 bits.

Defined results: text is UTF-8 bytes, null is empty; matches never cross documents, overlaps count; rows with equal id and text are
different places, so both lose their repeats; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm.base import join_counted, written
from regimen.llm.neardup import mix

SPAN, KEY = 200, 64
#: Windows of a document, and bytes of contexts, taken at a time; distance of the sampled places.
CHUNK, STEP = 1 << 20, 8
EDGE = STEP - 1
#: Bytes of a text within which touching spans are made one before they meet in a row.
STRETCH = 1 << 16
CORE = SPAN - EDGE
_PLACE = np.uint64((1 << 21) - 1)


class Rolling:
    """Hashes of byte ranges: sums of byte values times powers of an odd base, modulo 2^64."""

    def __init__(self, salt: int) -> None:
        base = int(mix(np.array([salt], np.uint64))[0]) | 1
        self.values = mix(np.arange(256, dtype=np.uint64) + np.uint64(salt * 1000 + 1))
        n = CHUNK + 2 * SPAN
        self.up = np.cumprod(np.full(n, base, np.uint64))
        self.down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=total[1:])
        return total

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of width values, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def chunks(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, bytes) of pieces that hold each window once."""
    for at in range(0, len(raw) - SPAN + 1, CHUNK):
        yield at, raw[at : at + CHUNK + SPAN - 1]


def anchors(raw: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """bucket, context hash, first window and number of windows of each context in order of place, and the anchor's distance from the first window."""
    found = []
    for at, piece in chunks(raw):
        sums = rolling.sums(piece)
        place = np.arange(len(piece) - KEY + 1)
        hashes = rolling.ranges(sums, place, place + KEY)
        chosen = (least((hashes & ~_PLACE) | place.astype(np.uint64), SPAN - KEY + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        count = np.diff(np.append(first, len(chosen)))
        away = chosen[first] - first
        context = mix(rolling.ranges(sums, first, first + count + SPAN - 1) + away.astype(np.uint64))
        found.append((hashes[chosen[first]].view(np.int64), context.view(np.int64), first + at, count, away))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))


def block_rows(buffer: np.ndarray, base: np.ndarray, many: np.ndarray, away: np.ndarray, rolling: tuple[Rolling, Rolling]) -> tuple[np.ndarray, ...]:
    """The sampled places of contexts that lie in buffer from base on, with EDGE bytes of anything before and after: (context, place less base, low, high, one, two, left, right) of each.

    A window that begins i bytes before a sampled place p is known by i, the name of the CORE bytes from p on, the i bytes before
    them and the EDGE - i bytes after them. low and high bound i; left and right hold the bytes that some window of the place covers.
    """
    least_, most = (away - many + 1) // STEP, away // STEP
    per = most - least_ + 1
    owner = np.repeat(np.arange(len(base)), per)
    k = np.repeat(least_, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    low = np.maximum(away[owner] - many[owner] + 1 - STEP * k, 0)
    high = np.minimum(away[owner] - STEP * k, EDGE)
    inside = away[owner] - STEP * k
    place = base[owner] + inside
    one, two = (r.ranges(r.sums(buffer), place, place + CORE) for r in rolling)
    left, right = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for j in range(EDGE):
        left = (left << 8) | buffer[place - EDGE + j]
        right = (right << 8) | buffer[place + CORE + j]
    return owner, inside, low, high, one.view(np.int64), two.view(np.int64), left & ((1 << 8 * high) - 1), right & ~((1 << 8 * low) - 1)


def repeated_spans(docs: DataFrame, text: str = "text", row: str = "_row") -> DataFrame:
    """_row, _text (hash of the text), start, stop: byte ranges covered by windows that also start elsewhere; they may overlap. row: a column that tells rows apart."""
    source = docs.select(F.col(row).cast("bigint").alias("_row"), F.xxhash64(text).alias("_text"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).where(F.octet_length("t") >= SPAN)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols = [anchors(np.frombuffer(v.as_buffer(), np.uint8), rolling) for v in part.column(2)]
                many = np.array([len(c[0]) for c in cols])
                ids = [np.repeat(part.column(i).to_numpy(zero_copy_only=False), many) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ids] + [pa.array(np.concatenate([c[i] for c in cols])).cast(k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["_row", "_text", "bucket", "context", "first", "many", "away"])

    every = written(source.mapInArrow(scan, "_row bigint, _text bigint, bucket bigint, context bigint, first bigint, many int, away int"), "anchors")
    seen = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (F.min("context") != F.max("context")).alias("mixed")).where("n > 1")
    again = written(join_counted(every, written(seen, "repeated-keys"), ["bucket"]), "repeated-anchors")
    mixed = again.where("mixed")
    kinds = written(mixed.groupBy("bucket", "context").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("_row", "_text", "first", "many", "away"), F.struct("_row", "_text", "first")).alias("at")), "contexts")
    copies = join_counted(mixed, kinds.where("n > 1").select("bucket", "context", "n"), ["bucket", "context"])
    spanned = lambda df: df.select("_row", "_text", F.col("first").alias("start"), (F.col("first") + F.col("many") + SPAN - 1).alias("stop"))
    whole = spanned(again.where("not mixed")).union(spanned(copies))

    wanted = kinds.select("at._row", "at._text", F.struct("at.first", "at.many", "at.away", (F.col("n") > 1).alias("done")).alias("c"))
    wanted = written(wanted.groupBy("_row", "_text").agg(F.collect_list("c").alias("cs")), "wanted-contexts").withColumnsRenamed({"_row": "_wrow", "_text": "_wtext"}).hint("shuffle_hash")
    texts = source.join(wanted, (F.col("_row") == F.col("_wrow")) & (F.col("_text") == F.col("_wtext"))).select("_row", "_text", "t", "cs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, pieces, weight = (Rolling(2), Rolling(3)), [], [np.zeros(EDGE, np.uint8)], EDGE

        def flush() -> pa.RecordBatch:
            row_, text_, first, many, away, done, base = (np.array([h[i] for h in held]) for i in range(7))
            owner, inside, low, high, one, two, left, right = block_rows(np.concatenate([*pieces, np.zeros(EDGE, np.uint8)]), base, many, away, rolling)
            columns = [row_[owner], text_[owner], first[owner] + inside, one, two, (low << 59) | (high << 56) | left, right, done[owner]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_row", "_text", "place", "one", "two", "left", "right", "done"])

        for batch in batches:
            for r, h, t, cs in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                r, h, raw = r.as_py(), h.as_py(), np.frombuffer(t.as_buffer(), np.uint8)
                for first, many, away, done in zip(*(cs.values.field(i).to_pylist() for i in range(4)), strict=True):
                    pieces.append(raw[first : first + many + SPAN - 1])
                    held.append((r, h, first, many, away, done, weight))
                    weight += len(pieces[-1])
                    if weight > CHUNK:
                        yield flush()
                        held, pieces, weight = [], [np.zeros(EDGE, np.uint8)], EDGE
        if held:
            yield flush()

    blocks = written(texts.mapInArrow(cut, "_row bigint, _text bigint, place bigint, one bigint, two bigint, left bigint, right bigint, done boolean"), "blocks")
    name, kind = ["one", "two"], ["one", "two", "left", "right"]
    differ = (F.min("left") != F.max("left")) | (F.min("right") != F.max("right"))
    names = written(blocks.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), differ.alias("differ")).where("n > 1"), "block-names")
    shared = written(join_counted(blocks, names, name), "shared-blocks")
    low, high = F.expr("cast(left >> 59 as int)"), F.expr("cast(left >> 56 & 7 as int)")
    covered = lambda df: df.where("not done").select("_row", "_text", (F.col("place") - high).alias("start"), (F.col("place") - low + SPAN).alias("stop"))

    # equal blocks repeat as a whole; of different blocks with one name, one of each kind is compared window by window
    different = shared.where("differ").drop("differ")
    alike = written(different.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("_row", "_text", "place", "done"), F.struct("_row", "_text", "place")).alias("at")), "block-kinds")
    twins = covered(join_counted(different, alike.where("n > 1").select(*kind, "n"), kind))
    each = alike.select("one", "two", "left", "right", "at._row", "at._text", "at.place", (F.col("at.done") | (F.col("n") > 1)).alias("done"), F.explode(F.sequence(low, high)).alias("i"))
    outside = F.expr(f"shiftleft(cast(i as bigint), 56) | shiftleft(left & (shiftleft(1L, 8 * i) - 1), 8 * ({EDGE} - i)) | shiftright(right, 8 * i)")
    each = written(each.select("one", "two", outside.alias("outside"), "_row", "_text", "place", "i", "done"), "windows")
    window = [*name, "outside"]
    twice = written(each.groupBy(*window).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-windows")
    dealt = join_counted(each.where("not done"), twice, window).select("_row", "_text", (F.col("place") - F.col("i")).alias("start"), (F.col("place") - F.col("i") + SPAN).alias("stop"))
    return whole.union(covered(shared.where("not differ"))).union(twins).union(dealt)


def united(spans: DataFrame) -> DataFrame:
    """The spans (_row, _text, start, stop) with those that touch within a stretch of STRETCH bytes made one: a group holds the distinct spans of one stretch, so a text that repeats in every byte comes as a few spans a stretch."""
    stretch = F.expr(f"start div {STRETCH}").alias("_stretch")
    grouped = spans.groupBy("_row", "_text", stretch).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw")
            flat, many = raw.flatten(), np.diff(np.asarray(raw.offsets))
            if not len(flat):
                continue
            start, stop, of = np.asarray(flat.field("start")), np.asarray(flat.field("stop")), np.repeat(np.arange(batch.num_rows), many)
            # starts ascend within a group; shifted by group, one running maximum of the stops serves them all
            shift = of * (int(stop.max()) + 2)
            reach = np.maximum.accumulate(stop + shift)
            first = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
            at = np.flatnonzero(first)
            ends = reach[np.concatenate([at[1:], [len(start)]]) - 1] - shift[at]
            rows, texts = (np.asarray(batch.column(c))[of[at]] for c in ("_row", "_text"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, texts, start[at], ends)], ["_row", "_text", "start", "stop"])

    return grouped.mapInArrow(run, "_row bigint, _text bigint, start bigint, stop bigint")


def without_repeats(docs: DataFrame, text: str = "text", output: str = "kept") -> DataFrame:
    """docs with n_bytes, spans (array of start and stop of the maximal removed byte ranges) and output (binary: the bytes that stay)."""
    docs = docs.drop("n_bytes", "spans", output)
    numbered = docs.withColumn("_row", F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c != text]))
    # rows that agree in all columns can't be told apart; their number makes their text repeat
    copies = numbered.groupBy("_row", F.xxhash64(text).alias("_text")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = written(united(repeated_spans(numbered, text)), "spans")
    found = found.union(copies.select("_row", "_text", F.lit(0).cast("bigint"), F.lit(1 << 40).cast("bigint")))
    spans = found.groupBy("_row", "_text").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("raw")).withColumnsRenamed({"_row": "_srow", "_text": "_stext"}).hint("shuffle_hash")
    joined = numbered.withColumn("_text", F.xxhash64(text)).join(spans, (F.col("_row") == F.col("_srow")) & (F.col("_text") == F.col("_stext")), "left").drop("_row", "_text", "_srow", "_stext")
    rest = [f for f in joined.schema if f.name != "raw"]
    place, at = [f.name for f in rest].index(text), len(rest)
    ordered = joined.select(*[F.col(f"`{f.name}`") for f in rest], "raw")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                sizes, united, kept = [], [], []
                for value, raw in zip(part.column(place).to_pylist(), part.column(at).to_pylist(), strict=True):
                    data = (value or "").encode()
                    merged: list[list[int]] = []
                    for s in (raw or []) if len(data) >= SPAN else []:
                        start, stop = s["start"], min(s["stop"], len(data))
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], stop)
                        else:
                            merged.append([start, stop])
                    ends = [0, *(x for m in merged for x in m), len(data)]
                    sizes.append(len(data))
                    united.append([{"start": a, "stop": b} for a, b in merged])
                    kept.append(b"".join(data[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), pa.array(sizes, pa.int64()), pa.array(united, kind), pa.array(kept, pa.binary())], [*(f.name for f in rest), "n_bytes", "spans", output])

    extra = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField(output, T.BinaryType())])
    return ordered.mapInArrow(drop, T.StructType([*rest, *extra]))
