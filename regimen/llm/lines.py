"""Line dedup with DataFrame functions only.

Line keys are hashed in their row; only hashes, document keys and positions are shuffled. The occurrences are dealt by ranges
of (hash, document) and sorted there by hash, document and position, so a line that a third of all documents share
spreads over many ranges; a window streams the first occurrence in each document, and those are counted per hash with
map-side sums. What is to go comes back as sparse keep bitmaps (64 lines a word, words with all lines kept left out).

Defined results: a document is a row's (id, text); repeated rows count once and are treated alike. Null or empty text is one
empty line. Blank lines are never counted nor dropped. A document that loses all lines keeps its row with empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimen.llm.base import join_met, written

# ASCII white space and letters.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; lower() does for ASCII, translate() is slower."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _document(doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_text")]


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _text (hash of the text) and keep array<bigint> of each document that loses a line; bit i % 64 of word i / 64 says whether line i stays, and lines beyond the last word stay. A line goes, in every document, if its key has min_chars code points and stands in min_docs documents."""
    keys = F.transform(F.transform(_lines(text), line_key), lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g"))))
    hashed = written(docs.select(*_document(doc_id, text), keys.alias("keys")), "line-keys")
    lines = hashed.select("_id", "_text", F.posexplode("keys").alias("pos", "k")).where("k is not null").select("k.h", "k.g", "_id", "_text", "pos")
    one = Window.partitionBy("h", "g", "_id", "_text").orderBy("pos")
    firsts = lines.repartitionByRange(F.col("h"), F.col("g"), F.col("_id"), F.col("_text")).withColumn("nth", F.row_number().over(one)).where("nth = 1")
    common = written(firsts.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs).select("h", "g"), "common-lines")
    gone = join_met(lines, common, ["h", "g"], common.count(), 64).select("_id", "_text", F.expr("pos div 64").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    words = gone.groupBy("_id", "_text", "word").agg(F.bitwise_not(F.bit_or("bit")).alias("bits"))
    sparse = words.groupBy("_id", "_text").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    dense = F.flatten(F.transform("w", lambda w, k: F.concat(F.array_repeat(F.lit(-1).cast("bigint"), (w["word"] - F.when(k > 0, F.get("w", k - 1)["word"]).otherwise(-1) - 1).cast("int")), F.array(w["bits"]))))
    return sparse.select("_id", "_text", dense.alias("keep"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text cut to the lines that stay, and n_lines, n_dropped (bigint). Extra columns stay; columns of these names are replaced."""
    maps = written(keep_bitmaps(docs, min_docs, min_chars, doc_id, text), "keep-bitmaps")
    own = docs.drop("n_lines", "n_dropped").withColumns({"__id": F.col(doc_id), "__text": F.xxhash64(text)})
    maps = maps.withColumnsRenamed({"_id": "__mid", "_text": "__mtext", "keep": "__keep"}).hint("shuffle_hash")  # grows with docs: one plan at every size
    joined = own.join(maps, own["__id"].eqNullSafe(maps["__mid"]) & (own["__text"] == maps["__mtext"]), "left")
    lines = _lines(text)
    word = lambda i: F.coalesce(F.get("__keep", F.floor(i / 64).cast("int")), F.lit(-1).cast("bigint"))
    stays = lambda line, i: F.getbit(word(i), (i % 64).cast("int")) == 1
    kept = F.when(F.col("__keep").isNull(), lines).otherwise(F.filter(lines, stays))
    done = joined.withColumns({"n_lines": F.size(lines).cast("bigint"), "__kept": kept})
    return done.withColumns({"n_dropped": F.col("n_lines") - F.size("__kept"), text: F.array_join("__kept", "\n")}).drop("__id", "__text", "__mid", "__mtext", "__keep", "__kept")
