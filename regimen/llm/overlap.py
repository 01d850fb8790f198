"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of each window of W consecutive k-gram hashes the least is kept, of equal ones the first. Documents and items that share
window = k + W - 1 words share a kept hash at the same place in it, so none is missed. Each shared hash is extended to the windows of
the document around it, and those whose words all equal an item's window count. A row is a window or a document, never all that
a document or an item has met, and the work is linear in the words.

Items shorter than a window are one window of their own length; they are found by their longest word.

Defined results: null or empty text has no words, no hits and isn't contaminated; an item without words is never found; repeated
items count as one; an item without id hits words and is counted as one of n_items but not named; repeated documents are judged
alike. Extra columns of the inputs are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.llm.base import join_met, written
from regimen.llm.lines import ascii_lower

#: All ASCII that is no digit and no small letter divides words.
DIVIDER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """The words of a text in lower case (A-Z only), as an array; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), DIVIDER), lambda w: w != "")


def winnowed(words: str, k: int, per: int) -> Column:
    """The kept k-grams of an array of words, each as 32 hash bits before 31 bits of position; of fewer than per k-grams the least one."""
    grams = F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.shiftleft(F.hash(*[F.get(words, i + j) for j in range(k)]).cast("bigint"), 31) + i))
    least = lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.size(g) - per + 1, F.lit(1))), lambda i: F.array_min(F.slice(g, i, per)))
    return F.coalesce(F.array_distinct(F.flatten(F.transform(F.filter(F.array(grams), lambda g: g.isNotNull()), least))), F.array().cast("array<bigint>"))


def _prints(kept: str, at: str) -> list[Column]:
    return [F.shiftright(kept, 31).cast("int").alias("print"), F.col(kept).bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias(at)]


def _windows(words: Column, at: Column) -> Column:
    """start, size and window (the words, by blanks) of the windows that begin at one of the places of at (first, last, size) and lie in words.

    The words are handed to a lambda as one value: named in it, Spark would split the text again for each window.
    """

    def cut(w: Column) -> Column:
        def starts(c: Column) -> Column:
            first, last = F.greatest(F.lit(0), c["first"]), F.least(c["last"], F.size(w) - c["size"])
            places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda s: s * F.lit(1 << 20).cast("bigint") + c["size"])  # as numbers, of which array_distinct takes n steps; of structs it takes n squared

        def written_out(code: Column) -> Column:
            start, size = F.shiftright(code, 20).cast("int"), code.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
            return F.struct(start.alias("start"), size.alias("size"), F.array_join(F.slice(w, start + 1, size), " ").alias("window"))

        return F.transform(F.array_distinct(F.flatten(F.transform(at, starts))), written_out)

    return F.flatten(F.transform(F.array(words), cut))


def benchmark_overlap(docs: DataFrame, items: DataFrame, window: int = 13, k: int = 5, share: tuple[int, int] = (1, 20), doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row per document: _id, _text (hash of the text), n_words, n_hit (words inside a shared window), n_items (items found), items (their ids, as sorted strings), contaminated (n_hit is at least share of the words)."""
    per = window - k + 1
    parts = written(docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_text"), words_of(text).alias("w")).select("_id", "_text", F.size("w").cast("bigint").alias("n_words"), winnowed("w", k, per).alias("kept")), "prints")
    pieces = written(items.select(F.col(item_id).alias("item"), words_of(text).alias("iw")).where(F.size("iw") > 0).distinct(), "items")
    size = F.least(F.size("iw"), F.lit(window))
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.size("iw") - size).alias("last"), size.alias("size")))
    theirs = written(pieces.select("item", F.inline(_windows(F.col("iw"), whole))).select("item", "window").distinct(), "item-windows")
    n_windows, n_short = theirs.count(), pieces.where(F.size("iw") < window).count()

    # places where a window may begin: around a shared print, or where an item's longest word stands right
    prints = pieces.where(F.size("iw") >= window).select(F.explode(winnowed("iw", k, per)).alias("kept")).select(*_prints("kept", "ipos")).select("print").distinct()
    found = parts.select("_id", "_text", F.explode("kept").alias("kept")).select("_id", "_text", *_prints("kept", "pos"))
    found = join_met(found, prints, ["print"], n_windows, 16).select("_id", "_text", F.struct((F.col("pos") - per + 1).alias("first"), F.col("pos").alias("last"), F.lit(window).alias("size")).alias("at"))
    if n_short:
        longest = F.array_max(F.transform("iw", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("back"), w.alias("word"))))
        short = pieces.where(F.size("iw") < window).select(longest.alias("a"), F.size("iw").alias("size")).select(F.col("a.word").alias("word"), (-F.col("a.back")).alias("ipos"), "size").distinct()
        every = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_text"), F.posexplode(words_of(text)).alias("pos", "word"))
        start = F.col("pos") - F.col("ipos")
        found = found.unionByName(join_met(every, short, ["word"], n_short, 256).select("_id", "_text", F.struct(start.alias("first"), start.alias("last"), "size").alias("at")))
    found = written(found.groupBy("_id", "_text").agg(F.collect_set("at").alias("at")), "candidates")

    texts = docs.select(F.col(doc_id).alias("_tid"), F.xxhash64(text).alias("_ttext"), F.col(text).alias("_body"))
    near = texts.join(found.hint("shuffle_hash"), F.col("_tid").eqNullSafe(F.col("_id")) & (F.col("_ttext") == F.col("_text")))
    own = written(near.select("_id", "_text", F.inline(_windows(words_of("_body"), F.col("at")))), "windows")
    hits = join_met(own, theirs, ["window"], n_windows, 256)
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    names = F.collect_set(F.struct("item"))
    judged = hits.groupBy("_id", "_text").agg(F.collect_set(F.struct("start", "size")).alias("spans"), names.alias("names"))
    known = F.array_sort(F.array_compact(F.transform("names", lambda x: x["item"].cast("string"))))
    judged = judged.select(F.col("_id").alias("_hid"), F.col("_text").alias("_htext"), F.size(covered).cast("bigint").alias("n_hit"), F.size("names").cast("bigint").alias("n_items"), known.alias("items"))
    base = parts.select("_id", "_text", "n_words").join(judged.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_text") == F.col("_htext")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    none = F.array().cast("array<string>")
    return base.select("_id", "_text", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), F.coalesce("items", none).alias("items"), ((n_hit > 0) & (share[1] * n_hit >= share[0] * F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    bad = written(benchmark_overlap(docs, items, doc_id=doc_id, text=text, **params).where("contaminated").select("_id", "_text").distinct(), "contaminated")
    return docs.join(bad.hint("shuffle_hash"), docs[doc_id].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text]) == bad["_text"]), "left_anti")
