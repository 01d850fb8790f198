"""Quality rules: base counts of a text, and how far its histograms are from those of known languages. DataFrame functions only.

Each text gives a histogram over character classes and one over common words of some languages (and the rest). The reference of a
language sums the histograms of all documents of that language which pass the base rules; only languages in COMMON have one for words.
A text is rejected if its least Jensen-Shannon distance to a reference is over a bound, for characters or for words; texts under a
least length pass. A text is compared with the references of the languages in COMMON and of its own language, one without a language
with all; words only count where its language, or else the nearest for characters, is in COMMON.

Three-word windows that repeat in a text are found by sorting numbers within the row, of 33 bits of hash and the place; only windows whose
bits are met twice are sorted by their words, so that the count is exact and one long text costs n log n and no shuffle.

Defined results: null text counts as one without words; repeated rows are judged alike; a language without documents that pass the
base rules has no reference, and its documents aren't rejected beyond the base rules; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.llm.base import as_small, written
from regimen.llm.lines import SPACE

#: Least words and least characters for a verdict by distance, and the largest distances (0 to 1) that pass. Clean labelled documents
#: of sf0.1 reach 0.2791 for words; a text without any common word stands at 0.2846 there, as those are about 15 % of all words.
LEAST_WORDS, LEAST_CHARS, MOST_CLASSES, MOST_WORDS = 50, 300, 0.30, 0.28

# Frequent function words of the reference languages.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for"],
    "fr": ["de", "la", "le", "et", "les", "des", "que", "en", "un", "pour"],
    "de": ["der", "die", "und", "in", "den", "das", "von", "zu", "mit", "ist"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "por"],
}
#: Bits of a place in a text.
PLACE_BITS = 31
WORDS = sorted({w for ws in COMMON.values() for w in ws})
CLASSES = ["lower", "upper", "digits", "spaces", "symbols", "beyond_ascii", "rest"]


def window_number(words: list[Column], place: Column) -> Column:
    """Bits of the hash of a window's words before its place (an int): an array of such numbers sorts as primitive values."""
    return F.shiftleft(F.shiftright(F.xxhash64(*words), PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("bigint"))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _words, _word_chars, _symbols, _dup_lines, _repeat_words (bigint), _chars, _classes and _common (array<bigint>: counts by CLASSES, and by WORDS)."""
    gap, none = "[ \t\n\x0b\f\r]+", F.array().cast("array<string>")
    own = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    own = own.withColumn("_trimmed", F.btrim("_t", F.lit(SPACE)))
    own = own.withColumn("_w", F.when(F.col("_trimmed") != "", F.split("_trimmed", gap)).otherwise(none)).drop("_trimmed")
    own = own.withColumn("_words", F.size("_w").cast("bigint"))
    three = lambda i: [F.get("_w", i + j) for j in range(3)]
    windows = F.when(F.col("_words") > 2, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: window_number(three(i), i))).otherwise(F.array().cast("array<bigint>"))
    only = lambda kept: F.length(F.regexp_replace("_t", kept, ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    own = own.withColumns({
        "_sorted": F.sort_array(windows),
        "_lines": lines,
        "_chars": F.length("_t"),
        "_word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
        "_symbols": only("[^#*$%&|<>]+").cast("bigint"),
        "_lower": only("[^a-z]+"), "_upper": only("[^A-Z]+"), "_digits": only("[^0-9]+"), "_beyond": only(r"[\x00-\x7F]+"),
        "_known": F.filter("_w", lambda w: w.isin(WORDS)),
    })

    def met(column: str, key: Callable[[Column], Column]) -> Column:
        """The elements of a sorted array that have a neighbour of the same key."""
        equal = lambda x, k: F.coalesce(key(F.get(column, k)) == key(x), F.lit(False))
        return F.filter(column, lambda x, k: equal(x, k + 1) | ((k > 0) & equal(x, F.greatest(k - 1, F.lit(0)))))

    own = own.withColumn("_near", F.transform(met("_sorted", lambda x: F.shiftright(x, PLACE_BITS)), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")))
    own = own.withColumn("_near", F.sort_array(F.transform("_near", lambda i: F.struct(*[w.alias(x) for w, x in zip(three(i), "abc")], i.alias("i")))))
    twice = met("_near", lambda x: F.struct(x["a"], x["b"], x["c"]))
    own = own.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["i"].cast("bigint"))))
    spaces = F.col("_chars") - F.col("_word_chars")
    counted = [F.col("_lower").cast("bigint"), F.col("_upper").cast("bigint"), F.col("_digits").cast("bigint"), spaces, F.col("_symbols"), F.col("_beyond").cast("bigint")]
    rest = F.col("_chars") - sum(counted[1:], counted[0])
    return own.withColumns({
        "_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_repeat_words": F.aggregate(F.transform("_twice", lambda x, k: F.coalesce(F.least(F.get("_twice", k + 1) - x, F.lit(3)), F.lit(3)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x),
        "_classes": F.array(*counted, F.greatest(rest, F.lit(0))),
        "_common": F.transform(F.array(*map(F.lit, WORDS)), lambda word: F.size(F.filter("_known", lambda w: w == word)).cast("bigint")),
    }).drop("_t", "_w", "_sorted", "_near", "_lines", "_lower", "_upper", "_digits", "_beyond", "_known", "_twice")


def base_failed() -> Column:
    return (F.col("_words") < LEAST_WORDS) | (100 * F.col("_repeat_words") > 50 * F.col("_words"))


def references(found: DataFrame, lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Shares of character classes and of common words (last: all other words) in all documents of each reference language that pass the base rules; a row per language comes to the driver."""
    sums = [F.sum(F.get("_classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get("_common", F.lit(i))).alias(f"w{i}") for i in range(len(WORDS))]
    rows = found.where(F.col(lang).isin(list(COMMON)) & ~base_failed()).groupBy(lang).agg(F.sum("_words").alias("words"), *sums).collect()
    out = {}
    for r in rows:
        classes, common = [r[f"c{i}"] for i in range(len(CLASSES))], [r[f"w{i}"] if w in COMMON[r[lang]] else 0 for i, w in enumerate(WORDS)]
        out[r[lang]] = ([c / max(1, sum(classes)) for c in classes], [c / max(1, r["words"]) for c in [*common, r["words"] - sum(common)]])
    return out


def further_references(found: DataFrame, lang: str = "lang") -> DataFrame:
    """_of, _own: shares of character classes in all documents of each language outside COMMON that pass the base rules."""
    rows = found.where(F.col(lang).isNotNull() & ~F.col(lang).isin(list(COMMON)) & ~base_failed())
    sums = rows.groupBy(F.col(lang).alias("_of")).agg(F.array(*[F.sum(F.get("_classes", F.lit(i))).cast("double") for i in range(len(CLASSES))]).alias("_sums"))
    total = F.greatest(F.aggregate("_sums", F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    return sums.select("_of", F.transform("_sums", lambda x: x / total).alias("_own"))


def distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence to base 2) of a histogram (array of counts) to a reference (array of shares)."""
    zero = F.lit(0.0)

    def term(count: Column, q: Column) -> Column:
        p = count / total
        m = (p + q) / 2
        return F.when(count > 0, p * F.log2(p / m)).otherwise(zero) + F.when(q > 0, q * F.log2(q / m)).otherwise(zero)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(counts, shares, term), zero, lambda a, x: a + x) / 2, zero))


def _numbers(values: list) -> Column:
    return F.array(*map(F.lit, values))


def judge(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance (least over the references; null without one to compare with), kept."""
    found = written(features(docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")), "_text").drop("_text"), "quality-counts")
    known = references(found, "_lang")
    chars, words = F.greatest(F.col("_chars"), F.lit(1)), F.greatest(F.col("_words"), F.lit(1))
    to = lambda shares: distance(F.col("_classes"), chars, shares)

    def to_words(r: Column) -> Column:
        """The distance of the words to a reference: the counts of its own common words and the rest."""
        own = F.transform(r["places"], lambda i: F.get("_common", i))
        return distance(F.array_append(own, F.col("_words") - F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x)), words, r["shares"])

    # arrays of references, and one expression for all of them: a term for each class, word and language would be too much code to compile
    least = lambda each: F.array_min(each) if known else F.lit(None).cast("double")
    own = {name: [i for i, w in enumerate(WORDS) if w in COMMON[name]] for name in known}
    by_class = least(F.transform(F.array(*[_numbers(shares) for _, (shares, _) in sorted(known.items())]), to))
    by_word = least(F.transform(F.array(*[F.struct(_numbers(own[name]).alias("places"), _numbers([*(shares[i] for i in own[name]), shares[-1]]).alias("shares")) for name, (_, shares) in sorted(known.items())]), to_words))
    others = written(further_references(found, "_lang"), "references")
    many = others.count()
    unnamed, fixed = F.col("_lang").isNull(), F.col("_lang").isin(list(known))
    compared, by_words, class_distance = unnamed | fixed, unnamed | fixed, by_class
    if many:
        every = others.agg(F.collect_list("_own").alias("_every"))  # one row with all references
        further = F.when(unnamed, F.array_min(F.transform("_every", to))).when(F.col("_own").isNotNull(), to(F.col("_own")))
        joined = found.join(as_small(others, many, 128), F.col("_lang") == F.col("_of"), "left").crossJoin(F.broadcast(every))
        # written, as Spark would compute each distance again where it is compared
        found = written(joined.withColumns({"_fixed": class_distance, "_further": further}).drop("_of", "_own", "_every"), "quality-distances")
        compared, class_distance = unnamed | fixed | F.col("_further").isNotNull(), F.least("_fixed", "_further")
        by_words = fixed | (unnamed & F.coalesce(F.col("_fixed") <= F.col("_further"), F.lit(True)))
    judged = found.withColumns({"class_distance": F.when(compared, class_distance), "word_distance": F.when(by_words, by_word), "base_failed": base_failed()})
    long = (F.col("_words") >= LEAST_WORDS) & (F.col("_chars") >= LEAST_CHARS)
    far = long & (F.coalesce(F.col("class_distance") > MOST_CLASSES, F.lit(False)) | F.coalesce(F.col("word_distance") > MOST_WORDS, F.lit(False)))
    named = {"_words": "n_words", "_word_chars": "word_chars", "_symbols": "n_symbols", "_dup_lines": "n_dup_lines", "_repeat_words": "n_repeat_words"}
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).select("_id", *[F.col(a).alias(b) for a, b in named.items()], "base_failed", "class_distance", "word_distance", "kept")
