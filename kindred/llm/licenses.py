"""License scans: a set-similarity join of text blocks with license notices, in native expressions only.

A block is a window of a whole text's words, half a window apart, so that line breaks don't matter. Windows are sized by
template: the smallest of SMALLEST, twice, four times ... that many words that is twice as long as the template, so that
a notice lies in one block whole. Words of templates are ordered by their frequency in the whole corpus, rarest first. A
block can hold a share t of a template's n words only if it has one of the template's first n - ceil(t n) + 1 in that
order (prefix filter), enough words of the vocabulary (length filter), and enough words left behind the
shared one on both sides (positional filter). What passes is verified on full sets. Texts without a word of any prefix
hold no such block, nor a base phrase, and are left out as soon as they are cut into words.

Beside the join, places where a base phrase's words stand consecutively are counted.

Defined results: a null or empty text has no words, no labels and score 0; a very long text is cut into windows like
any other; repeated rows are scanned each; an empty table gives an empty result; ties between templates do not arise,
as all labels are returned. Further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a lowered text: the contract's class, written as what it holds, which is matched faster than what it leaves out.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Words of the smallest window.
SMALLEST = 32
#: Share of a template's words that a block must hold.
THRESHOLD = 0.8
#: The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: The words of common notices, short and whole, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it under the gnu general public license": "gpl",
    "licensed under the mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under the creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under the creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
    "the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
    "apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
    "under the license is distributed on an as is basis without warranties or conditions of any kind either express or "
    "implied see the license for the specific language governing permissions and limitations under the license": "apache-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version this program is distributed in the hope that it will be useful but without any warranty without even the "
    "implied warranty of merchantability or fitness for a particular purpose": "gpl-3",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
    "public license as published by the free software foundation": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
    "distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
    "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
    "commercial or non commercial and by any means": "unlicense",
}


def lowered(text: Column) -> Column:
    """text with A-Z lowered, and other letters perhaps. Two characters alone become ASCII letters where all are lowered."""
    odd = text.contains("\u0130") | text.contains("\u212a")
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), 0)


def once(value: Column) -> Column:
    """value, of one row each. Unlike a projection, a generator is never merged into the expressions above it,
    which would compute value anew for every element that they visit."""
    return F.explode(F.array(value))


def _places(ws: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    starts = F.when(F.size(ws) >= len(parts), F.sequence(F.lit(0), F.size(ws) - len(parts))).otherwise(F.array().cast("array<int>"))
    # The first word is looked at alone: slices are made where it stands.
    first = F.filter(starts, lambda i: ws[i] == parts[0])
    return F.filter(first, lambda i: F.slice(ws, i + 1, len(parts)) == F.array(*map(F.lit, parts)))


def base(rows: DataFrame) -> DataFrame:
    """key, n_base, first_word, last_word and base (labels) of every row (key, ws) with a base phrase."""
    every = [f"p{i}" for i in range(len(PHRASES))]
    found = rows.select("key", once(F.struct(*(_places(F.col("ws"), p).alias(c) for c, p in zip(every, PHRASES, strict=True)))).alias("p")).select("key", "p.*")
    starts = F.concat(*every)
    names = F.array_compact(F.array(*(F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(every, PHRASES.values(), strict=True))))
    found = found.select("key", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), names.alias("base"))
    return found.filter("n_base > 0")


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for t in (*templates, *PHRASES) for w in t.split(" ")})


def least_shared(template: str, threshold: float = THRESHOLD) -> int:
    """How many of a template's distinct words a block must hold."""
    return math.ceil(threshold * len(set(template.split(" "))) - 1e-9)


def window(template: str) -> int:
    """Words of the windows that are met with a template."""
    return SMALLEST << max(0, math.ceil(math.log2(2 * len(template.split(" ")) / SMALLEST)))


def token_order(texts: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' words, from the one in the fewest documents of the corpus up. The list is as long as the vocabulary, whatever the corpus."""
    vocab = F.array(*map(F.lit, vocabulary(templates)))
    counted = texts.select(F.explode(F.array_intersect(words(F.col("text")), vocab)).alias("token")).groupBy("token").count()
    count = {r["token"]: r["count"] for r in counted.collect()}
    return sorted(vocabulary(templates), key=lambda t: (count.get(t, 0), t))


class Prefixes:
    """For each template its words' places in the order, how many a block must share, and the prefix."""

    def __init__(self, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD):
        place = {w: i for i, w in enumerate(order)}
        self.order, self.rows = order, []
        for t, label in templates.items():
            ranks, least = sorted({place[w] for w in t.split(" ")}), least_shared(t, threshold)
            self.rows += [(label, ranks, least, window(t), i, r) for i, r in enumerate(ranks[: len(ranks) - least + 1])]
        rarest = {min(p.split(" "), key=place.__getitem__) for p in PHRASES}
        #: A text with none of these words has neither a base phrase nor a block that passes.
        self.tokens = sorted({order[r[-1]] for r in self.rows} | rarest)


def blocks(rows: DataFrame, prefixes: Prefixes) -> DataFrame:
    """key, wide and ranks (places in order of a block's template words, ascending) of the blocks that can pass. rows: key, ws."""
    vocab = F.array(*map(F.lit, prefixes.order))
    # Words outside the vocabulary are of no account: from here on, each is the place in the order, or null.
    held = rows.select("key", F.size("ws").alias("n"), F.posexplode("ws").alias("at", "w")).withColumn("rank", F.array_position(vocab, F.col("w")).cast("int") - 1).filter("rank >= 0")
    out = None
    for wide in sorted({r[3] for r in prefixes.rows}):
        half, least = wide // 2, min(r[2] for r in prefixes.rows if r[3] == wide)
        # A word lies in the window that begins in its own half, and in the one before, if windows begin there.
        last = F.greatest(F.ceil((F.col("n") - wide) / half), F.lit(0))
        own = F.floor(F.col("at") / half)
        starts = F.filter(F.array(own - 1, own), lambda i: (i >= 0) & (i <= last))
        b = held.select("key", "rank", F.explode(starts).alias("start")).groupBy("key", "start").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
        b = b.filter(F.size("ranks") >= least).select("key", F.lit(wide).alias("wide"), "ranks")
        out = b if out is None else out.unionByName(b)
    return out


def similar(rows: DataFrame, prefixes: Prefixes) -> DataFrame:
    """key, near (labels) and containment (the largest) of every row (key, ws) with a block that holds the share of a template's words."""
    # As many rows as the templates' prefixes have words: a bound that the parameters set.
    prefix = F.broadcast(rows.sparkSession.createDataFrame(prefixes.rows, "label string, of array<int>, least int, of_wide int, i int, token int"))
    left = blocks(rows, prefixes).select("key", "wide", "ranks", F.posexplode("ranks").alias("j", "rank"))
    behind = 1 + F.least(F.size("of") - F.col("i") - 1, F.size("ranks") - F.col("j") - 1)
    pairs = left.join(prefix, (F.col("rank") == F.col("token")) & (F.col("wide") == F.col("of_wide"))).filter((F.size("ranks") >= F.col("least")) & (behind >= F.col("least")))
    verified = pairs.withColumn("shared", F.size(F.array_intersect("ranks", "of"))).filter("shared >= least")
    return verified.groupBy("key").agg(F.collect_set("label").alias("near"), F.max(F.col("shared") / F.size("of")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold=THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    score is 1 with a base phrase, else the largest share of a template that a block holds, or 0."""
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    prefixes = Prefixes(token_order(texts, templates), templates, threshold)
    some = F.arrays_overlap("ws", F.array(*map(F.lit, prefixes.tokens)))
    # A result depends on the text alone: copies of one text are scanned once, by its hash.
    cut = texts.select("doc_id", "text", once(words(F.col("text"))).alias("ws")).select("doc_id", F.size("ws").cast("long").alias("n_words"), F.when(some, F.md5(F.col("text").cast("binary"))).alias("key"), F.when(some, F.col("ws")).alias("ws"))
    cut = written(cut, "license-words")
    rows = cut.filter(F.col("key").isNotNull()).select("key", "ws").dropDuplicates(["key"])
    found = base(rows).join(similar(rows, prefixes).withColumnRenamed("key", "key_s"), F.col("key") == F.col("key_s"), "full")
    found = found.select(F.coalesce("key", "key_s").alias("of"), "n_base", "first_word", "last_word", "base", "near", "containment")
    none = F.array().cast("array<string>")
    label = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base_labels, near = F.coalesce("base", none), F.coalesce("near", none)
    return cut.drop("ws").join(found, F.col("key") == F.col("of"), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        label(base_labels).alias("base_labels"), label(F.concat(base_labels, near)).alias("labels"),
        F.when(F.size(base_labels) > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op4_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Every window of every whole text against every template of its size, by brute force."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    starts = "list_concat(" + ", ".join(f"list_filter(range(len(ws)), lambda i: ws[i + 1 : i + {len(p.split(' '))}] = [{', '.join(repr(w) for w in p.split(' '))}])" for p in PHRASES) + ")"
    names = "list_concat(" + ", ".join(f"CASE WHEN list_contains(list_transform(range(len(ws)), lambda i: ws[i + 1 : i + {len(p.split(' '))}]), [{', '.join(repr(w) for w in p.split(' '))}]) THEN ['{label}'] ELSE [] END" for p, label in PHRASES.items()) + ")"
    templates = ", ".join(f"({[*dict.fromkeys(t.split(' '))]!r}, {least_shared(t)}, '{label}', {window(t)})" for t, label in TEMPLATES.items())
    sizes = ", ".join(f"({n})" for n in sorted({window(t) for t in TEMPLATES}))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({low}, '{word}') AS ws FROM documents),
b AS (SELECT doc_id, r, len(ws)::BIGINT AS n_words, {starts} AS starts, {names} AS base FROM d),
z(wide) AS (VALUES {sizes}),
y AS (SELECT r, wide, ws[i + 1 : i + wide] AS ws FROM (SELECT r, ws, wide, unnest(CASE WHEN len(ws) <= wide THEN [0] ELSE range(0, len(ws) - wide // 2, wide // 2) END) AS i FROM d CROSS JOIN z)),
p(tws, least, label, wide) AS (VALUES {templates}),
n AS (SELECT r, label, len(list_intersect(tws, ws)) AS shared, len(tws) AS n, least FROM y JOIN p USING (wide)),
s AS (SELECT r, list(DISTINCT label) AS near, max(shared / n) AS containment FROM n WHERE shared >= least GROUP BY r)
SELECT doc_id, n_words, len(starts)::BIGINT AS n_base, list_min(starts)::BIGINT AS first_word, list_max(starts)::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(near, [])))), ',') AS labels,
       CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END::DOUBLE AS score
FROM b LEFT JOIN s USING (r)
"""


OP4_SQL = _sql()
