"""Byte-level BPE encoding and decoding by a per-prefix dynamic programme.

For every prefix of a pre-token the BPE encoding has exactly one last token. A token that ends at a prefix is that last
token if it may follow the last token of the prefix before it, i.e. if merging their bytes alone gives the two tokens
back. An Aho-Corasick automaton lists the tokens ending at each position; back-pointers (the token lengths) give the ids.
The cost is linear in the length of a pre-token, so a text that is one huge word is no special case.

Defined results: null text counts as empty (no ids, empty decoded text); strings of added tokens inside a text become
their id, as in the tokenizers library with its default settings; repeated rows give repeated results; other columns
are kept as they are, whatever their names (a column with an output's name is replaced).
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split of byte-level BPE vocabularies into pre-tokens; letters, numbers and spaces are put in.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
# Code points newer than the tables of the tokenizers library, for which it knows no class.
UNKNOWN = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: Entries of the pre-token and of the pair cache of a Python worker; a full cache is emptied.
CACHE_ENTRIES = 700_000
#: Bytes of text in one batch given back to Spark.
BATCH_BYTES = 4 << 20
#: A vocabulary file may have so many bytes, as it is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def splitters() -> tuple:
    """The split for texts within Latin-1, and the one for all texts. Code points that the library's Unicode tables don't know count as punctuation, whatever the regex module knows."""
    import regex

    newer = "".join(f"\\U{int(a, 16):08X}-\\U{int(b, 16):08X}" for a, _, b in (x.partition("-") for x in (r if "-" in r else f"{r}-{r}" for r in UNKNOWN.split())))
    latin = "".join(map(chr, range(0x100)))
    near = {name: "".join(map(re.escape, regex.findall(kind, latin))) for name, kind in (("letters", r"\p{L}"), ("numbers", r"\p{N}"), ("spaces", r"\s"))}
    classes = {"letters": r"\p{L}", "numbers": r"\p{N}", "spaces": r"\s"}
    known, seen = regex.compile(PATTERN.format(**classes)).findall, regex.compile(f"[{newer}]").search
    strict = PATTERN.format(**classes)
    for plain, less in ((r"[\p{L}]", rf"[^\P{{L}}{newer}]"), (r"[\p{N}]", rf"[^\P{{N}}{newer}]"), (r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])")):
        strict = strict.replace(plain, less)
    strict = regex.compile(strict).findall
    return re.compile(PATTERN.format(**near)).findall, lambda text: strict(text) if seen(text) else known(text)


class PairRules:
    """Which token may follow which, from the merge ranks."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> rank, left, right
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank.setdefault((a, b), rank)
            self.made.setdefault(whole, (rank, a, b))

    def follows(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """True if BPE over the bytes of a and b ends as [a, b]: undo the later merge of the two and see that the pair then at the border was not due before it. Equal ranks merge left to right."""
        while True:
            if self.rank.get((a, b), limit) < limit:
                return False
            last_a, last_b = self.made.get(a), self.made.get(b)
            rank_a, rank_b = last_a[0] if last_a else -1, last_b[0] if last_b else -1
            if rank_b >= rank_a:
                if last_b is None:
                    return True
                limit, b = rank_b + 1, last_b[1]
            else:
                limit, a = rank_a, last_a[2]

    def is_stable(self, token: int) -> bool:
        """True if BPE over the token's own bytes gives the token."""
        made = self.made.get(token)
        return made is None or (self.is_stable(made[1]) and self.is_stable(made[2]) and self.follows(made[1], made[2], made[0]))


class PrefixCoder:
    """Encoder and decoder for one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, spec: str) -> None:
        import ahocorasick

        data = json.loads(spec)
        model, pre = data["model"], data.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or data.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        alphabet = byte_alphabet()
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in added}
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        self.rules = PairRules(vocab, model["merges"])
        self.matcher = ahocorasick.Automaton()
        for t, i in vocab.items():
            if self.rules.is_stable(i):
                self.matcher.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.matcher.make_automaton()
        self.near, self.far = splitters()
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)

    def prefix_tokens(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        raw = piece.encode().decode("latin-1")
        last, fits = [-1] * (len(raw) + 1), self.fits
        for end, (token, length) in self.matcher.iter(raw):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - length
            if start:
                pair = (last[start], token)
                if (ok := fits.get(pair)) is None:
                    if len(fits) >= CACHE_ENTRIES:
                        fits.clear()
                    ok = fits[pair] = self.rules.follows(*pair)
                if not ok:
                    continue
            last[end + 1] = token
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return ids[::-1]

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.far(text)
        return self.near(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pieces = self.pieces
        if len(pieces) >= CACHE_ENTRIES:
            pieces.clear()
        if self.at_added is None or not self.at_added.search(text):
            return b"".join(map(pieces.__getitem__, self.split(text)))
        return b"".join(self.added.get(part) or b"".join(map(pieces.__getitem__, self.split(part))) for part in self.at_added.split(text) if part)

    def decode(self, packed: bytes | None) -> str:
        ids = array("I", packed or b"")
        if sys.byteorder == "big":
            ids.byteswap()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Pieces(dict):
    """Pre-token -> packed ids."""

    def __init__(self, coder: PrefixCoder) -> None:
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        packed = array("I", self.coder.prefix_tokens(piece))
        if sys.byteorder == "big":
            packed.byteswap()
        packed = packed.tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


_CODERS: dict[int, PrefixCoder] = {}


def _coder(spec: str) -> PrefixCoder:
    """One coder for each vocabulary in a Python worker."""
    key = hash(spec)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = PrefixCoder(spec)
    return _CODERS[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file at a path of the driver, at most MAX_VOCABULARY_BYTES."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(spec) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to be broadcast")
    return spec


def _map_column(df: DataFrame, column: str, output: str, kind: T.DataType, spec: str, method: str) -> DataFrame:
    """Adds output = coder.method(column) in Arrow batches of bounded size."""
    rest = [c for c in df.columns if c.lower() != output.lower() or c == column]
    source = df.select(*[F.col(f"`{c}`") for c in rest])
    place = source.columns.index(column)
    kept = [i for i, c in enumerate(rest) if c.lower() != output.lower()]
    schema = T.StructType([source.schema[i] for i in kept] + [T.StructField(output, kind)])
    shared = df.sparkSession.sparkContext.broadcast(spec)
    arrow_kind = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = getattr(_coder(shared.value), method)
        for batch in batches:
            start, made, held = 0, [], 0
            for row, value in enumerate(batch.column(place)):
                made.append(apply(value.as_py()))
                held += len(made[-1])
                if held >= BATCH_BYTES or row + 1 == batch.num_rows:
                    part = batch.slice(start, len(made))
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(made, arrow_kind)], [*(rest[i] for i in kept), output])
                    start, made, held = row + 1, [], 0

    return source.mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the column ids: the token ids of text, packed as little-endian unsigned 32-bit integers (binary); see unpack_ids."""
    return _map_column(df, text, ids, T.BinaryType(), vocabulary, "encode")


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the column text: the text of packed ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    return _map_column(df, ids, text, T.StringType(), vocabulary, "decode")


def count_ids(ids: str = "ids") -> Column:
    """Number of packed ids."""
    return F.expr(f"cast(octet_length(`{ids}`) div 4 as bigint)")


def unpack_ids(ids: str = "ids") -> Column:
    """Packed ids as array<bigint>."""
    byte = "conv(substring(h, 8 * i + {}, 2), 16, 10)"
    value = " + ".join(f"cast({byte.format(2 * k + 1)} as bigint) * {256**k}" for k in range(4))
    return F.expr(f"transform(filter(sequence(0, cast(octet_length(`{ids}`) div 4 as int)), i -> i < octet_length(`{ids}`) div 4), i -> element_at(transform(array(hex(`{ids}`)), h -> {value}), 1))")
