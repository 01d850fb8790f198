"""License scan with a positional index of rare words. DataFrame functions only.

Words of the templates are looked up in every text; their document frequencies over all texts give IDF weights, and each template's
rarest words are its index. Texts with enough of some template's rarest words and all words of its key phrase are looked up again for these templates, with positions: a word at place p
that stands at place q in a template votes for the alignment p - q. Alignments that lie within SHIFT words of each other are one
group (groups overlap by half, so that none is cut), since a word put in or left out moves all that follow. A group counts if enough
of the template's rarest words vote in it, its key phrase stands there word by word, and the template's places met carry enough of
its IDF weight. Phrases are templates whose words must all be in place at one alignment. Everything is grouped by (document,
template, alignment), so a hot word is only many short groups.

Defined results: null or empty text has no words, labels or score; repeated rows are judged alike; extra columns are left aside.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.llm.base import written
from regimen.llm.overlap import words_of

#: Rarest words of a template that are indexed, how many of them must agree, the share of the IDF weight in place, and the words that
#: alignments of one group may differ by.
INDEXED, AGREEING, COVERAGE, SHIFT = 6, 2, 0.7, 16

# Label, template words, key phrase.
TEMPLATES = [
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions of source code must retain the above copyright notice"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4"),
]
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


@dataclass(frozen=True)
class Posting:
    template: int
    label: str
    place: int
    word: str
    key: bool
    phrase: bool


def postings(templates: list[tuple[str, str, str]], phrases: list[tuple[str, str]]) -> list[Posting]:
    """The words of all templates and phrases with their places; a bounded list of parameters."""
    found = []
    for k, (label, text, key, phrase) in enumerate([*((*t, False) for t in templates), *((label, p, p, True) for label, p in phrases)]):
        words, must = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        found += [Posting(k, label, i, w, at <= i < at + len(must), phrase) for i, w in enumerate(words)]
    return found


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _text (hash of the text), n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays), score: the largest share of a template's IDF weight in place among those found, else 0."""
    index = postings(templates, phrases)
    vocabulary = sorted({p.word for p in index})
    words = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_text"), words_of(text).alias("w"))
    seen = F.array_distinct(F.filter("w", lambda w: w.isin(vocabulary)))
    found = written(words.select("_id", "_text", F.size("w").cast("bigint").alias("n_words"), seen.alias("seen")), "license-words")

    total = found.count()
    frequency = {r.word: r.n for r in found.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per template word at most
    idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) + 1 for w in vocabulary}
    by_template: dict[int, list[Posting]] = {}
    for p in index:
        by_template.setdefault(p.template, []).append(p)
    rare = {k: sorted({p.word for p in ps}, key=lambda w: (-idf[w], w))[:INDEXED] for k, ps in by_template.items()}
    rows = [(p.template, p.label, p.place, p.word, p.key, p.phrase, idf[p.word], p.word in rare[p.template], sum(idf[q.word] for q in by_template[p.template]), sum(q.key for q in by_template[p.template])) for p in index]
    table = docs.sparkSession.createDataFrame(rows, "template int, label string, place int, word string, key boolean, phrase boolean, idf double, rare boolean, weight double, n_key int")

    rows_of = {k: (ws, sorted({p.word for p in by_template[k] if p.key})) for k, ws in rare.items()}

    def possible(seen: Column) -> Column:
        """The templates that a text of these words can hold: enough of the rarest words, and all words of the key phrase."""
        held = lambda ws: F.size(F.array_intersect(seen, F.array(*map(F.lit, ws))))
        return F.array_compact(F.array(*[F.when((held(ws) >= min(AGREEING, len(ws))) & (held(keys) == len(keys)), F.lit(k)) for k, (ws, keys) in rows_of.items()]))

    def looked_up(w: Column) -> Column:
        """The vocabulary's words with their places, and the templates that they may vote in. Values are handed on to lambdas, so that each is computed once."""
        known = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("pos"), x.alias("word"))), lambda h: h["word"].isin(vocabulary))
        places = lambda h, may: F.when(F.size(may) > 0, F.transform(h, lambda x: F.struct(x["pos"].alias("pos"), x["word"].alias("word"), may.alias("may"))))
        each = F.transform(F.array(known), lambda h: F.get(F.transform(F.array(possible(F.array_distinct(F.transform(h, lambda x: x["word"])))), lambda may: places(h, may)), F.lit(0)))
        return F.get(each, F.lit(0))

    # no join brings the texts back: they would all be shuffled. Words that stand in all texts, such as the, vote in these templates only
    again = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_text"), F.get(F.transform(F.array(words_of(text)), looked_up), F.lit(0)).alias("hits"))
    votes = again.select("_id", "_text", F.inline_outer("hits")).where("word is not null").join(F.broadcast(table), "word").where(F.array_contains("may", F.col("template"))).drop("may")
    votes = votes.dropDuplicates(["_id", "_text", "template", "place", "pos"])
    votes = written(votes.withColumn("at", F.col("pos") - F.col("place")), "license-votes")

    one = ["_id", "_text", "template"]
    exact = votes.groupBy(*one, "label", "phrase", "n_key", "at").agg(F.count_if("key").alias("keys")).where("keys = n_key").select(*one, "label", "phrase", "at")
    half = SHIFT // 2
    groups = F.explode(F.array(F.floor(F.col("at") / half), F.floor(F.col("at") / half) - 1)).alias("group")
    met = votes.where("not phrase").select(*one, "weight", "place", "idf", F.when(F.col("rare"), F.col("word")).alias("rare"), groups).distinct()
    lined = met.groupBy(*one, "weight", "group").agg(F.sum("idf").alias("placed"), F.count_distinct("rare").alias("agreeing"))
    share = F.least(F.lit(1.0), F.round(F.col("placed") / F.col("weight"), 6))
    strong = lined.withColumn("share", share).where((F.col("agreeing") >= AGREEING) & (F.col("share") >= COVERAGE))
    strong = strong.select(F.col("_id").alias("_sid"), F.col("_text").alias("_stext"), F.col("template").alias("_of"), F.col("group").alias("_in"), "share")
    same = F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_text") == F.col("_stext")) & (F.col("template") == F.col("_of")) & (F.col("group") == F.col("_in"))
    loose = exact.where("not phrase").select("*", groups).join(strong, same).select("_id", "_text", "label", "phrase", "at", "share")
    good = exact.where("phrase").select("_id", "_text", "label", "phrase", "at", F.lit(1.0).alias("share")).unionByName(loose)
    base = lambda value: F.when(F.col("phrase"), value)
    judged = good.groupBy("_id", "_text").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(base(F.col("at").cast("bigint"))).alias("first_word"),
        F.max(base(F.col("at").cast("bigint"))).alias("last_word"),
        F.array_sort(F.collect_set(base(F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    judged = judged.withColumnsRenamed({"_id": "_jid", "_text": "_jtext"}).hint("shuffle_hash")
    none = F.array().cast("array<string>")
    joined = found.select("_id", "_text", "n_words").join(judged, F.col("_id").eqNullSafe(F.col("_jid")) & (F.col("_text") == F.col("_jtext")), "left")
    return joined.select("_id", "_text", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
