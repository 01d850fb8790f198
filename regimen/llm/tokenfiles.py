"""Token ids in files: canonical length-limited Huffman coding in blocks that are read on their own.

Folder format, written by write_tokens and read by read_tokens and read_range:

* blocks/ (Parquet, no second compression): a row is one block of up to BLOCK_IDS ids of neighbouring documents; only a document that is longer has
  several blocks, its pieces. shard and seq order the blocks, first counts the ids before a block in its shard, docs lists document ids and their numbers of
  ids, piece of pieces says which part of a long document it is. payload holds the codes, most significant bit first; marks holds
  the bit offset of every MARK-th code, so decoding may begin at any mark, and does at all of them at once.
* code/ (Parquet): id and code length of every id that occurs. Codes are canonical: counted up in the order of length, then id. It is
  written last: a folder without it isn't complete and can't be read.

The counts are summed in Spark, and a row per distinct id (bounded by the vocabulary) comes to the driver for the lengths, by package-merge.
Documents are sorted by ranges of (id, hash of the ids, place), so rows of one id spread over shards; the place of an id in the whole is its place in
the shard and the sizes of the shards before, a row each.

Defined results: null text counts as empty and has the end id only; documents follow each other in ascending order of id, rows without id first,
repeated rows beside each other; no documents give no blocks and an empty code; other columns are left aside.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm.base import erase, written

#: Ids in a block, and between two marks.
BLOCK_IDS, MARK = 1 << 16, 1 << 9
#: Longest code; longer only where more ids occur than codes of this length exist.
LONGEST = 16
#: Parts of words, or whole ones, remembered by a Python worker in each of two generations; longer ones aren't.
CACHE_PARTS, CACHE_CHARS = 450_000, 48
#: Parts of words that a call of the library encodes, a multiple of 64.
CALL_PARTS = 1 << 13
# The pre-token pattern by which letters and marks of a word are encoded on their own; marks but for the apostrophe; letters
# of Latin-1 that have two cases, which no normalization touches.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = """!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"""
LETTERS = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
#: Ids up to which a code has a table by id.
DENSE = 1 << 22
#: Blocks decoded at a time.
TOGETHER = 48
#: Bytes of text encoded at a time; a longer text comes alone.
BATCH_BYTES = 12 << 20


class LibraryCoder:
    """Encodes with the tokenizers library. Where a vocabulary is known to treat the words between white space on their own, each word is encoded once and remembered; with the pattern PARTS, so are a word's letters and the marks around them."""

    def __init__(self, spec: str, end: int | None, width: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        data = json.loads(spec)
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.width, self.kind = width, f"<u{width}"
        self.end = b"" if end is None else int(end).to_bytes(width, "little")
        self.by_word, self.parts = drops_spaces(data), Remembered(CACHE_PARTS)
        # marks that no added token holds; the apostrophe begins parts of its own
        added = [t["content"] for t in data.get("added_tokens", [])]
        self.marks = "".join(set(MARKS) - set("".join(added)))
        suffix = data["model"].get("end_of_word_suffix")
        whole = self.by_word and data["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": PARTS} and suffix and all(set(a) & set(MARKS) for a in added)
        self.ends = np.array([t.endswith(suffix) for t, _ in sorted(data["model"]["vocab"].items(), key=lambda x: x[1])]) if whole else None

    def pack(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pack_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of letters or marks, each of which ends with the one token that has the suffix: many in one text, some of these at a time."""
        coded = [np.zeros(0, self.kind)]
        for first in range(0, len(parts), CALL_PARTS):
            texts = [" ".join(parts[i : i + 64]) for i in range(first, min(len(parts), first + CALL_PARTS), 64)]
            coded += [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(coded)
        cuts = (self.width * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for _, a, b in zip(parts, [0, *cuts][: len(cuts)], cuts, strict=True)]

    def known(self, keys: list[str], pack: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of different words or parts of words; pack is asked for those that aren't remembered."""
        found = self.parts.all(keys)
        new = [k for k, ids in zip(keys, found) if ids is None]
        fresh = pack(new)
        for k, ids in zip(new, fresh):
            if len(k) <= CACHE_CHARS:
                self.parts[k] = ids
        others = iter(fresh)
        return [next(others) if ids is None else ids for ids in found]

    def pieces(self, words: pa.StringArray) -> tuple[list[bytes], np.ndarray]:
        """Ids of distinct pieces, of which the first has none, and for each of these different words the pieces that it is made of, three of them: marks, letters and marks, or the whole word alone."""
        n = len(words)
        of = np.zeros((n, 3), np.int64)
        if self.ends is None or not n:
            of[:, 1] = np.arange(1, n + 1)
            return [b"", *self.known(words.to_pylist(), self.pack)], of
        rest = pc.utf8_ltrim(words, self.marks)
        core = pc.utf8_rtrim(rest, self.marks)
        letters = pc.match_substring_regex(core, LETTERS)
        plain = np.asarray(letters)
        size, left, inner = (np.asarray(pc.binary_length(x), np.int64) for x in (words, rest, core))
        start, raw = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][:n], np.frombuffer(words.buffers()[2] or b"", np.uint8)
        # the marks before and after the letters, each side a stretch of the words' bytes
        marks = []
        for at, lengths in ((start, size - left), (start + size - (left - inner), left - inner)):
            has = np.flatnonzero(plain & (lengths > 0))
            marks.append((has, pa.Array.from_buffers(pa.string(), len(has), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths[has])]).astype(np.int32)), pa.py_buffer(stretches(raw, at[has], lengths[has]))])))
        parts = pa.concat_arrays([pc.utf8_lower(core.filter(letters)), *(m for _, m in marks)]).dictionary_encode()
        which = np.asarray(parts.indices, np.int64) + 1
        rows = np.flatnonzero(plain)
        of[rows, 1] = which[: len(rows)]
        cut = len(rows) + len(marks[0][0])
        of[marks[0][0], 0], of[marks[1][0], 2] = which[len(rows) : cut], which[cut:]
        odd = np.flatnonzero(~plain)
        of[odd, 1] = 1 + len(parts.dictionary) + np.arange(len(odd))
        return [b"", *self.known(parts.dictionary.to_pylist(), self.pack_parts), *self.known(words.take(pa.array(odd)).to_pylist(), self.pack)], of

    def __call__(self, texts: pa.Array) -> pa.Array:
        """Ids of each text and the end id, as little-endian unsigned integers of width bytes."""
        if not self.by_word:
            return pa.array([ids + self.end for ids in self.pack(texts.to_pylist())], pa.binary())
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        found, of = self.pieces(coded.dictionary)
        # the ids of all pieces in one array, then those of all distinct words, of which each word of a text takes its stretch; the last is the end id
        of = np.append(of, [[0, len(found), 0]], axis=0)
        found.append(self.end)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        flat = stretches(np.frombuffer(b"".join(found), self.kind), (np.cumsum(lengths) - lengths)[of].ravel(), lengths[of].ravel())
        lengths = lengths[of].sum(axis=1).astype(np.int32)
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        cuts = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
        word = np.insert(np.asarray(coded.indices), cuts[1:], len(lengths) - 1)
        size = lengths[word]  # a slice of texts has fewer ids than 2 ** 31, as a binary array has bytes
        ids = stretches(flat, starts[word], size)
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int32)])[cuts + np.arange(len(cuts))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((self.width * at).astype(np.int32)), pa.py_buffer(ids)])


def stretches(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of an array, one after the other."""
    ends = np.cumsum(sizes, dtype=sizes.dtype)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=sizes.dtype)]


class Remembered:
    """A memory of two generations of most entries each: a full one becomes the old one, whose entries come back when they are asked for."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def __setitem__(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value

    def all(self, keys: list[str]) -> list[bytes | None]:
        """What is remembered of each key."""
        found = list(map(self.new.get, keys))
        if self.old:
            for i, value in enumerate(found):
                if value is None and (value := self.old.get(keys[i])) is not None:
                    found[i] = self[keys[i]] = value
        return found


def drops_spaces(data: dict) -> bool:
    """Whether a vocabulary file is known to encode the words between ASCII white space independently of each other: it normalizes within words, drops white space and has no added token that holds any."""
    steps = (data.get("normalizer") or {}).get("normalizers", [data.get("normalizer")])
    plain = all(s is None or s["type"] in ("NFC", "NFKC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in steps)
    first = ((data.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    matches = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and not {"\\s", " "} & set(re.findall(r"\\s| ", first["pattern"]["Regex"].replace("[^\\s", "[^")))
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].split() == [t["content"]] for t in data.get("added_tokens", []))
    return bool(plain and matches and added)


def id_width(vocabulary: str) -> int:
    """Bytes that an id of a vocabulary file needs: 2 or 4."""
    data = json.loads(vocabulary)
    most = max([0, *data["model"]["vocab"].values(), *(t["id"] for t in data.get("added_tokens", []))])
    return 2 if most < 1 << 16 else 4


_CODERS: dict[tuple[int, int | None, int], LibraryCoder] = {}


def encode_ids(docs: DataFrame, vocabulary: str, end: int | None = 1, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned integers of width bytes) of each row: what the tokenizers library gives without special tokens, truncation and padding, and the id end. vocabulary: the text of the library's file."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = (hash(vocabulary), end, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _CODERS:
            _CODERS.clear()
            _CODERS[key] = LibraryCoder(shared.value, end, width)
        coder = _CODERS[key]
        for batch in batches:
            sizes, start = np.cumsum(np.asarray(pc.binary_length(batch.column(1)))), 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + BATCH_BYTES)))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), coder(part.column(1))], ["doc_id", "ids"])
                start = stop

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("ids", T.BinaryType())]))


def count_ids(coded: DataFrame, width: int = 4) -> DataFrame:
    """id (bigint) and n of all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{width}")
            if width == 2:
                n = np.bincount(own)
                ids = np.flatnonzero(n)
                n = n[ids]
            else:
                ids, n = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n.astype(np.int64))], ["id", "n"])

    return coded.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code lengths of least total size, none over longest bits (or over what so many symbols need), by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    longest = max(longest, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    weights, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        weights = both[place]
        is_leaf.append(place < n)
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(is_leaf):
        own = int(level[:taken].sum())
        lengths[order[:own]] += 1
        taken = 2 * (taken - own)
    return lengths


class Code:
    """The canonical code of ids and lengths: tables for coding and decoding."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.bits = int(self.lengths.max()) if len(order) else 1
        span = np.left_shift(1, self.bits - self.lengths)
        ends = np.cumsum(span)
        if len(order) and ends[-1] > 1 << self.bits:
            raise ValueError("these lengths are no prefix code")
        self.codes = np.right_shift(ends - span, self.bits - self.lengths)
        self.symbol, self.size = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
        if len(order):
            self.symbol[: ends[-1]], self.size[: ends[-1]] = np.repeat(self.ids, span), np.repeat(self.lengths, span)
        self.by_id = np.sort(self.ids)
        self.dense = self._place(np.arange(self.by_id[-1] + 1)) if len(order) and self.by_id[-1] < DENSE else None

    def _place(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id in the code; any for an id that isn't in it."""
        return np.argsort(self.ids)[np.minimum(np.searchsorted(self.by_id, ids), len(self.ids) - 1)]

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Codes of ids, and the bit offset of every MARK-th of them."""
        at = self._place(ids) if self.dense is None else self.dense[ids]
        code, length = self.codes[at].astype(np.uint64), self.lengths[at]
        ends = np.cumsum(length)
        offsets = ends - length
        place = (code << (64 - length - (offsets & 31)).astype(np.uint64)).astype(np.uint64)
        word = offsets >> 5
        n = int(ends[-1] + 31 >> 5)
        # the bits of different codes don't overlap, so sums of halves below 2 ** 32 are exact in doubles
        high = np.bincount(word, weights=(place >> np.uint64(32)).astype(np.float64), minlength=n + 1)
        low = np.bincount(word + 1, weights=(place & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n + 1)
        return (high + low)[:n].astype(">u4").tobytes(), offsets[::MARK].astype(np.int32)

    def unpack(self, payloads: list[bytes], marks: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """The ids of several stretches of codes, all their marks at once. marks: bit offsets of every MARK-th code of a stretch; counts: its numbers of ids."""
        starts = np.cumsum([0, *(len(p) + 8 for p in payloads)])
        words = np.frombuffer(b"".join(p + b"\0" * 8 for p in payloads), ">u4").astype(np.uint64)
        lanes = np.concatenate([m.astype(np.int64) + 8 * s for m, s in zip(marks, starts)])
        last, out = 8 * int(starts[-1]) - 64, np.empty((min(MARK, max(counts, default=0)), len(lanes)), np.uint32)
        for step in range(len(out)):
            word = lanes >> 5
            window = (words[word] << np.uint64(32) | words[word + 1]) << (lanes & 31).astype(np.uint64)
            window >>= np.uint64(64 - self.bits)
            window = window.astype(np.int64)
            out[step] = self.symbol[window]
            lanes = np.minimum(lanes + self.size[window], last)  # short last lanes run on into the padding; their ids are cut off
        cuts = np.cumsum([0, *map(len, marks)])
        return [out[:, a:b].T.reshape(-1)[:n] for a, b, n in zip(cuts[:-1], cuts[1:], counts)]


def write_tokens(coded: DataFrame, path: str, longest: int = LONGEST, width: int = 4) -> None:
    """Writes doc_id and ids (binary, of width bytes an id, as encode_ids gives them) as a folder of token files."""
    spark = coded.sparkSession
    held = written(coded.select("doc_id", "ids"), "token-ids", "zstd")
    counts = count_ids(held, width).orderBy("id").collect()  # a row per id of the vocabulary
    ids, n = np.array([r["id"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.int64)
    lengths = code_lengths(n, longest)
    shared = spark.sparkContext.broadcast((ids, lengths))
    id_type = held.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("pieces", T.IntegerType()), T.StructField("docs", T.ArrayType(T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType())]))), T.StructField("marks", T.ArrayType(T.IntegerType())), T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, seq, first, names, parts, size = Code(*shared.value), TaskContext.get().partitionId(), 0, 0, [], [], 0
        kind = None

        def block(ids: np.ndarray, docs: list, piece: int = 0, pieces: int = 1) -> pa.RecordBatch:
            nonlocal seq, first
            payload, marks = code.pack(ids)
            own = pa.array([docs], pa.list_(pa.struct([("doc_id", kind), ("n_tokens", pa.int64())])))
            row = [pa.array([v], t) for v, t in ((shard, pa.int32()), (seq, pa.int32()), (first, pa.int64()), (len(ids), pa.int32()), (piece, pa.int32()), (pieces, pa.int32()))]
            seq, first = seq + 1, first + len(ids)
            return pa.RecordBatch.from_arrays([*row, own, pa.array([marks], pa.list_(pa.int32())), pa.array([payload], pa.binary())], schema.names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(packed.as_py(), f"<u{width}").astype(np.int64)
                if parts and size + len(ids) > BLOCK_IDS:
                    yield block(np.concatenate(parts), names)
                    names, parts, size = [], [], 0
                if len(ids) > BLOCK_IDS:
                    pieces = -(-len(ids) // BLOCK_IDS)
                    for piece in range(pieces):
                        yield block(ids[piece * BLOCK_IDS : (piece + 1) * BLOCK_IDS], [{"doc_id": name, "n_tokens": len(ids)}], piece, pieces)
                elif len(ids):
                    names.append({"doc_id": name, "n_tokens": len(ids)})
                    parts.append(ids)
                    size += len(ids)
        if parts:
            yield block(np.concatenate(parts), names)

    keys = ["doc_id", "_tie", "_place"]
    placed = held.withColumns({"_tie": F.xxhash64("ids"), "_place": F.monotonically_increasing_id()})
    blocks = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids").mapInArrow(run, schema)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id bigint, length int").coalesce(1).write.parquet(f"{path}/code")
    erase(held)


def _read(spark: SparkSession, path: str):
    """The code, broadcast, and the blocks with start: the number of ids before them in all shards."""
    code = spark.read.parquet(f"{path}/code").collect()  # a row per id of the vocabulary
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in code], np.int64), np.array([r["length"] for r in code], np.int64)))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shifts = F.broadcast(sizes.select("shard", F.coalesce(before, F.lit(0)).alias("_before")))  # a row per shard
    return shared, blocks.join(shifts, "shard").withColumn("start", F.col("first") + F.col("_before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (binary) of each document in the files."""
    shared, blocks = _read(spark, path)
    id_type = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = None
        for batch in batches:
            code = code or Code(*shared.value)
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                counts = part.column("n_ids").to_pylist()
                found = code.unpack(part.column("payload").to_pylist(), [np.asarray(m.values) for m in part.column("marks")], counts)
                names, starts, sizes, pieces, ids = [], [], [], [], []
                for start, piece, docs, own in zip(part.column("start").to_pylist(), part.column("piece").to_pylist(), part.column("docs").to_pylist(), found):
                    raw, used = own.astype("<u4").tobytes(), 0
                    for d in docs:
                        n = min(d["n_tokens"], len(own))
                        names.append(d["doc_id"])
                        starts.append(start + used)
                        sizes.append(d["n_tokens"])
                        pieces.append(piece)
                        ids.append(raw[4 * used : 4 * (used + n)])
                        used += n
                kind = batch.schema.field("docs").type.value_type.field("doc_id").type
                yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(pieces, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "piece", "ids"])

    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, piece int, ids binary"
    columns = ["start", "n_ids", "piece", "docs", "marks", "payload"]
    whole = blocks.where("pieces = 1").select(columns).mapInArrow(run, schema).drop("piece")
    cut = blocks.where("pieces > 1").select(columns).mapInArrow(run, schema).withColumn("start", F.expr(f"start - piece * {BLOCK_IDS}L"))
    joined = cut.groupBy("doc_id", "start", "n_tokens").agg(F.expr("listagg(ids) within group (order by piece)").alias("ids"))
    return whole.unionByName(joined)


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """start and ids (binary) of stretches that cover the places start to start + n of all ids, a row per block they lie in; only the marks around them are decoded."""
    shared, blocks = _read(spark, path)
    wanted = blocks.where((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start)).select("start", "n_ids", "marks", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value)
        for batch in batches:
            starts, ids = [], []
            for begin, size, marks, payload in zip(*(batch.column(i) for i in range(4))):
                begin, size, marks = begin.as_py(), size.as_py(), np.asarray(marks.values)
                low, high = max(0, start - begin), min(size, start + n - begin)
                lane = low // MARK
                found = code.unpack([payload.as_py()], [marks[lane : -(-high // MARK)]], [high - lane * MARK])[0]
                starts.append(begin + low)
                ids.append(found[low - lane * MARK :].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["start", "ids"])

    return wanted.mapInArrow(run, "start bigint, ids binary")
