"""The registered queries of the corpus operators, over the whole given tables, and their SQL where SQL can say them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.llm import bpe, hostgraph, langid, licenses, lines, neardup, overlap, periods, phrases, quality, repeats, rules, tokenfiles
from regimen.llm.base import id_hash, own_folder, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and text."""
    spec = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, spec).drop("text")
    back = bpe.decode(coded.withColumns({"n_tokens": bpe.count_ids(), "ids_sha256": F.sha2("ids", 256)}), spec).drop("ids")
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict by distribution divergence."""
    judged = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return judged.select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op4_sql() -> str:
    n_classes, words = len(rules.CLASSES), rules.WORDS
    only = lambda kept: f"length(regexp_replace(t, '{kept}', '', 'g'))"
    common = ", ".join(f"len([x for x in w if x = '{word}']) AS w{i}" for i, word in enumerate(words))
    classes = ", ".join(f"c{i}" for i in range(n_classes))
    own = {i: "(" + " OR ".join(f"lang = '{name}'" for name, ws in rules.COMMON.items() if word in ws) + ")" for i, word in enumerate(words)}
    shares = ", ".join([f"sum(c{i}) / greatest(sum({' + '.join(f'c{k}' for k in range(n_classes))}), 1) AS qc{i}" for i in range(n_classes)] + [f"CASE WHEN {own[i]} THEN sum(w{i}) / greatest(sum(n_words), 1) ELSE 0 END AS qw{i}" for i in range(len(words))])
    term = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END"
    by_class = " + ".join(term(f"(c{i} / greatest(n_chars, 1))", f"qc{i}") for i in range(n_classes))
    mine = lambda i: f"(CASE WHEN {own[i]} THEN w{i} ELSE 0 END)"
    rest = f"((n_words - ({' + '.join(mine(i) for i in range(len(words)))})) / greatest(n_words, 1))"
    by_word = " + ".join([term(f"({mine(i)} / greatest(n_words, 1))", f"qw{i}") for i in range(len(words))] + [term(rest, "(1 - (" + " + ".join(f"qw{i}" for i in range(len(words))) + "))")])
    return rf"""
WITH doc AS (
    SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n
    FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc))
), again AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY doc_id
), lined AS (
    SELECT doc_id, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM doc
), counted AS (
    SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {only('[^#*$%&|<>]+')}::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, length(t) AS n_chars,
           {only('[^a-z]+')} AS c0, {only('[^A-Z]+')} AS c1, {only('[^0-9]+')} AS c2, length(t) - length(array_to_string(w, '')) AS c3, {only('[^#*$%&|<>]+')} AS c4, {only('[\x00-\x7F]+')} AS c5,
           greatest(n_chars - c0 - c1 - c2 - c3 - c4 - c5, 0) AS c6, {common}
    FROM doc JOIN lined USING (doc_id) LEFT JOIN again USING (doc_id)
), judged AS (
    SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), reference AS (
    SELECT lang, {shares} FROM judged WHERE lang IN ({', '.join(f"'{name}'" for name in rules.COMMON)}) AND NOT base_failed GROUP BY lang
), near AS (
    SELECT doc_id, min(sqrt(greatest(({by_class}) / 2, 0))) AS class_distance, min(sqrt(greatest(({by_word}) / 2, 0))) AS word_distance
    FROM (SELECT * EXCLUDE (lang) FROM judged), reference GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {rules.LEAST_WORDS} AND n_chars >= {rules.LEAST_CHARS} AND (coalesce(class_distance > {rules.MOST_CLASSES}, false) OR coalesce(word_distance > {rules.MOST_WORDS}, false))) AS kept
FROM judged LEFT JOIN near USING (doc_id)
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for quality; learns from labels outside the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, usable=quality.learnable())
    return quality.classify(docs, model, 0.3).select("doc_id", (id_hash() % 5 == 0).alias("held_out"), "score", "predicted")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop the lines that ten documents share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_common_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
    FROM lines
), common AS (
    SELECT line_key AS common_key FROM keyed WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(common_key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common_key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON line_key = common_key
GROUP BY doc_id
"""

def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(named).select(F.col("_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _op7_sql() -> str:
    index = licenses.postings(licenses.TEMPLATES, licenses.PHRASES)
    values = ", ".join(f"({p.template}, '{p.label}', {p.place}, '{p.word}', {p.key}, {p.phrase})" for p in index)
    return rf"""
WITH posting(template, label, place, word, key, phrase) AS (VALUES {values}), doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), hit AS (
    SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM doc) WHERE word IN (SELECT word FROM posting)
), weighed AS (
    SELECT p.*, ln(((SELECT count(*) FROM doc) + 1) / (coalesce(n, 0) + 1)) + 1 AS idf
    FROM posting p LEFT JOIN (SELECT word, count(DISTINCT doc_id) AS n FROM hit GROUP BY word) USING (word)
), rare AS (
    SELECT template, word FROM (SELECT DISTINCT template, word, idf FROM weighed) QUALIFY row_number() OVER (PARTITION BY template ORDER BY idf DESC, word) <= {licenses.INDEXED}
), total AS (
    SELECT template, sum(idf) AS weight, count(*) FILTER (WHERE key) AS n_key FROM weighed GROUP BY template
), vote AS (
    SELECT doc_id, template, label, phrase, place, key, word, idf, pos - place AS spot FROM hit JOIN weighed USING (word)
), exact AS (
    SELECT doc_id, template, label, phrase, spot FROM vote JOIN total USING (template) GROUP BY doc_id, template, label, phrase, spot, n_key HAVING count(*) FILTER (WHERE key) = n_key
), grouped AS (
    SELECT doc_id, template, g, sum(idf) AS placed, count(DISTINCT rare_word) AS agreeing FROM (
        SELECT DISTINCT doc_id, template, place, idf, CASE WHEN (template, word) IN (SELECT (template, word) FROM rare) THEN word END AS rare_word, unnest([floor(spot / {licenses.SHIFT // 2}), floor(spot / {licenses.SHIFT // 2}) - 1]) AS g
        FROM vote WHERE NOT phrase) GROUP BY ALL
), strong AS (
    SELECT doc_id, template, g, least(1.0, round(placed / weight, 6)) AS share FROM grouped JOIN total USING (template) WHERE agreeing >= {licenses.AGREEING} AND least(1.0, round(placed / weight, 6)) >= {licenses.COVERAGE}
), good AS (
    SELECT doc_id, label, phrase, spot, 1.0 AS share FROM exact WHERE phrase
    UNION ALL SELECT doc_id, label, phrase, spot, share FROM (SELECT *, unnest([floor(spot / {licenses.SHIFT // 2}), floor(spot / {licenses.SHIFT // 2}) - 1]) AS g FROM exact WHERE NOT phrase) JOIN strong USING (doc_id, template, g)
), judged AS (
    SELECT doc_id, count(*) FILTER (WHERE phrase) AS n_base, min(spot) FILTER (WHERE phrase) AS first_word, max(spot) FILTER (WHERE phrase) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
    FROM good GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM doc LEFT JOIN judged USING (doc_id)
"""


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every byte inside a 200-byte string that starts elsewhere too."""
    cut = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url by rules, and by the host graph where no rule fits."""
    return hostgraph.judge_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


def _op9_sql() -> str:
    """The rules, and both ranks as one recursion that ends at the tolerance."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = sorted(URL_RULES, key=lambda r: -len(r[1]) - len(r[2]))
    rule = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in rules) + " END"
    link = hostgraph.LINK.replace("'", "''")
    d = hostgraph.DAMPING
    return f"""
WITH RECURSIVE page AS (
    SELECT page_id, {lower.format("regexp_extract(coalesce(url, ''), '" + hostgraph.URL + "', 1)")} AS host, regexp_extract(coalesce(url, ''), '{hostgraph.URL}', 2) AS path, html FROM pages
), ruled AS (
    SELECT *, {rule} AS fit FROM page
), seed AS (
    SELECT host, count(*) FILTER (WHERE fit LIKE 'allow %') / count(*) AS good, count(*) FILTER (WHERE fit LIKE 'block %') / count(*) AS bad, count(*) AS own FROM ruled WHERE host <> '' GROUP BY host
), link AS (
    SELECT host AS src, dst, count(*) AS n FROM (SELECT DISTINCT page_id, host, {lower.format("unnest(regexp_extract_all(coalesce(html, ''), '" + link + "', 1))")} AS dst FROM page) WHERE host <> '' AND host <> dst GROUP BY ALL
), above AS (
    SELECT host AS src, k, array_to_string(string_split(host, '.')[k:], '.') AS dst FROM (SELECT DISTINCT host, unnest(range(2, len(string_split(host, '.')) + 1)) AS k FROM page WHERE host <> '')
), parent AS (
    SELECT src, arg_min(dst, k) AS dst, (SELECT avg(own) FROM seed) AS n FROM above WHERE dst IN (SELECT host FROM page) GROUP BY src
), edge AS (
    SELECT src, dst, sum(n) AS n FROM (SELECT * FROM link UNION ALL SELECT * FROM parent) GROUP BY ALL
), weight AS (
    SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM edge
), node AS (
    SELECT host, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM (SELECT src AS host FROM edge UNION SELECT dst FROM edge UNION SELECT host FROM seed) LEFT JOIN seed USING (host)
), flow AS (
    SELECT 'trust' AS kind, src, dst, forth AS weight, NULL::DOUBLE AS base FROM weight UNION ALL SELECT 'distrust', dst, src, back, NULL FROM weight
    UNION ALL SELECT 'trust', host, host, 0, good FROM node UNION ALL SELECT 'distrust', host, host, 0, bad FROM node
), rank(kind, host, round, value, grown) AS (
    SELECT kind, src, 0, base * {1 - d}, 1.0::DOUBLE FROM flow WHERE base IS NOT NULL
    UNION ALL
    SELECT kind, host, round, value, max((value - before) / greatest(value, {hostgraph.LEAST})) OVER () FROM (
        SELECT f.kind AS kind, dst AS host, max(round) + 1 AS round, sum(CASE WHEN base IS NULL THEN value * weight * {d} ELSE base * {1 - d} END) AS value, sum(CASE WHEN base IS NOT NULL THEN value END) AS before
        FROM rank r JOIN flow f ON r.kind = f.kind AND r.host = f.src WHERE r.grown > {hostgraph.TOLERANCE} GROUP BY ALL)
), last AS (
    SELECT host, sum(value) FILTER (WHERE kind = 'trust') AS trust, sum(value) FILTER (WHERE kind = 'distrust') AS distrust FROM rank WHERE round = (SELECT max(round) FROM rank) GROUP BY host
)
SELECT page_id, ruled.host AS host, path, substr(fit, 7) AS rule,
       coalesce(substr(fit, 1, 5), CASE WHEN distrust > {hostgraph.RATIO} * trust AND distrust >= {hostgraph.LEAST} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN last ON ruled.host = last.host
"""


def op10_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside benchmark passages."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = overlap.benchmark_overlap(docs, items, window=13)
    return found.select(F.col("_id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH item AS (
    SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item_word AS (
    SELECT item_id, w, least(len(w), 13) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM item
), item_window AS (
    SELECT DISTINCT item_id, size, win FROM (
        SELECT item_id, size, i, len(w) AS n, string_agg(word, ' ') OVER (PARTITION BY item_id, w ORDER BY i ROWS BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS win FROM item_word)
    WHERE i <= n - size + 1
), doc_word AS (
    SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc
), doc_window AS (
    SELECT doc_id, i, size, win FROM (
        SELECT doc_id, n, i, size, string_agg(word, ' ') OVER (PARTITION BY doc_id, size ORDER BY i ROWS BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS win
        FROM doc_word, (SELECT DISTINCT size FROM item_window))
    WHERE i <= n - size + 1
), hit AS (
    SELECT doc_id, item_id, i, size FROM doc_window JOIN item_window USING (size, win)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document; learns outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, usable=langid.learnable())
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (id_hash() % 4 == 2).alias("held_out"), "lang_pred", "score")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates on three-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, size=3, similarity=(85, 100), bands=32, rows=5).withColumnRenamed("_id", "doc_id")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"), least=10, longest=3, top=2000, inside=(50, 100))


OP11_SQL = r"""
WITH doc AS (
    SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS parts FROM documents
), piece AS (
    SELECT lang, regexp_extract_all(unnest(parts), '[^\x20\x09]+') AS w FROM doc
), place AS (
    SELECT lang, w, len(w) AS n, unnest(generate_series(1, len(w))) AS i FROM piece
), gram AS (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM place, (SELECT unnest([1, 2, 3]) AS size) WHERE i + size - 1 <= n GROUP BY ALL
), total AS (
    SELECT lang, sum(f) AS n FROM gram WHERE size = 1 GROUP BY lang
), candidate AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM gram WHERE size > 1 AND f >= 10
), cut AS (
    SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM candidate, (SELECT unnest([1, 2]) AS k) WHERE k < size
), scored AS (
    SELECT cut.lang, cut.phrase, a, k, h.f AS l, t.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS score
    FROM cut JOIN gram h ON h.lang = cut.lang AND h.phrase = head JOIN gram t ON t.lang = cut.lang AND t.phrase = tail
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
    SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM candidate WHERE size = 3) GROUP BY ALL
), kept AS (
    SELECT lowest.* FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND part = phrase WHERE part IS NULL OR 100 * longer.a < 50 * lowest.a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000
"""


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, write the ids as files and read them back."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    path = f"{own_folder(spark)}/token-files-{uuid.uuid4().hex}"
    width = tokenfiles.id_width(vocabulary)
    tokenfiles.write_tokens(tokenfiles.encode_ids(table(spark, sf_dir, "documents"), vocabulary, end=1, width=width), path, width=width)
    return tokenfiles.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by crc32(doc_id) repeats a stretch of its words from a place on."""
    h = id_hash()
    planted = lambda w: F.transform(F.transform(F.array(F.struct(w.alias("w"), F.floor(h / 10).alias("g"))), lambda x: F.struct(x["w"].alias("w"), F.pmod(x["g"], F.size(x["w"])).alias("a"), x["g"].alias("g"))), lambda x: F.struct(x["w"].alias("w"), x["a"].alias("a"), (1 + F.floor((F.size(x["w"]) - x["a"]) / (3 + x["g"] % 8))).alias("p")))
    moved = lambda x: F.array_join(F.transform(x["w"], lambda word, i: F.when(i < x["a"], word).otherwise(F.get(x["w"], (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")))), " ")
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    text = F.transform(planted(words), moved)[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & (F.size(words) > 0), text).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document and what is left without their repetitions, some with planted runs."""
    found = periods.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))).withColumn("best", periods.strongest())
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op1_bpe": op1_bpe, "op2_langid": op2_langid, "op3_neardup": op3_neardup, "op4_rules": op4_rules, "op5_quality": op5_quality, "op6_lines": op6_lines, "op7_licenses": op7_licenses, "op8_repeats": op8_repeats, "op9_urls": op9_urls, "op10_overlap": op10_overlap, "op11_phrases": op11_phrases, "op12_token_files": op12_token_files, "op13_periods": op13_periods}
ORACLES = {"op4_rules": _op4_sql(), "op6_lines": OP6_SQL, "op7_licenses": _op7_sql(), "op9_urls": _op9_sql(), "op10_overlap": OP10_SQL, "op11_phrases": OP11_SQL}
