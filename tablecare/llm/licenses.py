"""License scans: phrases at word places, and an exact set-similarity join of text blocks with license templates. DataFrame functions only.

A text block is a line or, within it, a sentence; beside these, a sentence that runs over several lines is a block too, numbered after them.
Lines without a word end such sentences. A block matches a template when it holds at least a share of the template's distinct words (each
template may have a share of its own: tags need all words). The join is exact: template words are ordered by how many documents of the whole
corpus hold them, rarest first; a template with m words of which r are needed must share one of its m - r + 1 rarest with a matching block
(prefix filter), the block must hold at least r template words (length filter), and the words after the shared one must still suffice on both
sides (positional filter). Candidates are verified by their full overlap.

Texts are read once. The words of a whole text bound those of its blocks, so a text that holds too few words of every template is done:
what is stored of it are its phrase places and the template words it holds, from which the order is counted. Only the others keep their
text and are cut into blocks. The templates are a parameter of fixed size, so joining them by broadcast is bounded, and only their words are
counted on the driver.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Null and empty texts have no words. Every row has its own
result, so repeated ids, repeated rows and null ids do no harm, and nothing is grouped by source. A very long text is held whole by its task,
as its words and its blocks. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.llm.common import Workspace

# Fixed phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Templates (label, text) of sentences from common license notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "apache license version 2 0 january 2004"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl-3", "gnu general public license version 3 29 june 2007"),
    ("gpl-2", "gnu general public license version 2 june 1991"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license version 3 29 june 2007", 1.0),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007", 1.0),
    ("mpl-2", "mozilla public license version 2 0"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("boost", "boost software license version 1 0 august 17th 2003"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)
# SPDX tags and their labels; every word of a tag is needed.
TAGS = {
    "mit": "mit", "apache 2 0": "apache-2", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl-3", "mpl 2 0": "mpl-2",
    "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "isc": "isc", "zlib": "zlib", "bsl 1 0": "boost", "epl 2 0": "epl-2", "cc0 1 0": "cc0", "unlicense": "unlicense",
}
TEMPLATES += tuple((label, f"spdx license identifier {tag}", 1.0) for tag, label in TAGS.items())
THRESHOLD = 0.8
BREAK, GAP = r"[.!?;]\s+|[\r\n]+", r"[^0-9a-z\x{80}-\x{10FFFF}\n]+"
# Ends of sentences that may run over lines: marks, and lines without a word. What is left of line ends is inside a sentence.
PARAGRAPH = r"[.!?;]\s+|\n(?:[^0-9a-z\x{80}-\x{10FFFF}\n]*\n)+"


def word_list(text: str) -> list[str]:
    """The words of a phrase or template given by a caller."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def needs(templates, threshold: float) -> list[tuple[str, list[str], int]]:
    """(label, distinct words, words needed) of each template."""
    out = []
    for label, text, *share in templates:
        words = sorted(set(word_list(text)))
        if not words:
            raise ValueError(f"a template of {label} has no words")
        out.append((label, words, max(1, math.ceil((share[0] if share else threshold) * len(words) - 1e-9))))
    return out


def lowered(text: Column) -> Column:
    """A-Z lower-cased. The Kelvin sign, the only other character that lower() turns into an ASCII letter by itself, is put out of its way."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def phrase_places(docs: DataFrame, text_col: str, phrases: dict[str, str]) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base (array of labels) for the places where a phrase's words stand consecutively, and _words."""
    body = F.trim(F.regexp_replace(lowered(F.col(text_col)), r"[^0-9a-z\x{80}-\x{10FFFF}]+", " "))
    rows = docs.withColumn("_body", F.concat(F.lit(" "), body, F.lit(" "))).withColumn("_words", F.split(F.trim("_body"), " "))
    rows = rows.withColumn("n_words", F.when(F.col("_body") == "  ", 0).otherwise(F.size("_words")).cast("long"))
    made = {}
    listed = [word_list(p) for p in phrases]
    if not all(listed):
        raise ValueError("a phrase has no words")
    for i, words in enumerate(listed):
        phrase = " ".join(words)  # words hold neither quotes nor characters with a meaning in patterns
        there = F.contains(F.col("_body"), F.lit(f" {phrase} "))
        before = F.expr(f"left(_body, instr(_body, ' {phrase} ') - 1)")
        after = F.substring_index("_body", f" {phrase} ", -1)
        made |= {f"_n{i}": F.when(there, F.regexp_count("_body", F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long"), f"_a{i}": F.when(there, _spaces(before).cast("long")),
                 f"_z{i}": F.when(there, F.col("n_words") - _spaces(after) - len(words))}
    rows = rows.withColumns(made).drop("_body")
    total = reduce(lambda a, b: a + b, [F.col(f"_n{i}") for i in range(len(phrases))], F.lit(0).cast("long"))
    ends = [F.array_compact(F.array(*[F.col(f"_{c}{i}") for i in range(len(phrases))]).cast("array<bigint>")) for c in "az"]
    labels = F.array_compact(F.array(*[F.when(F.col(f"_n{i}") > 0, F.lit(v)) for i, v in enumerate(phrases.values())]).cast("array<string>"))
    return rows.withColumns({"n_base": total, "first_word": F.array_min(ends[0]), "last_word": F.array_max(ends[1]), "base": F.array_distinct(labels)}).drop(
        *[f"_{c}{i}" for c in "naz" for i in range(len(phrases))])


def _blocks(docs: DataFrame, text_col: str, vocabulary: list[str]) -> DataFrame:
    """One row per block: its number, and the vocabulary's words that it holds, in the vocabulary's order."""
    low = lowered(F.col(text_col))
    clean = F.regexp_replace(F.regexp_replace(low, BREAK, "\n"), GAP, " ")
    # Sentences end at a form feed here; only those with a line end inside are blocks of their own.
    wide = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.replace(low, F.lit("\f"), F.lit(" ")), r"\r\n?", "\n"), PARAGRAPH, "\f"), "\f"), lambda x: F.rlike(x, F.lit(r"[^\n]\n[^\n]")))
    wide = F.transform(wide, lambda x: F.regexp_replace(F.replace(x, F.lit("\n"), F.lit(" ")), GAP, " "))
    each = docs.withColumn("_clean", F.concat(F.split(clean, "\n"), wide)).select(*[c for c in docs.columns if c != text_col], F.posexplode("_clean").alias("block", "_block"))
    return each.withColumn("held", F.array_intersect(_words(vocabulary), F.split("_block", " "))).drop("_block")


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _read(ws: Workspace, docs: DataFrame, id_col: str, text_col: str, phrases: dict[str, str], told) -> DataFrame:
    """One pass over the texts: phrase places, the template words each holds (_held), and the text of those that may hold a match (_text)."""
    vocabulary = sorted({w for _, words, _ in told for w in words})
    # Of m words of which r are needed, any m - r + 1 hold one of a match's: the longest, which are rare in other texts.
    signals = sorted({w for _, words, need in told for w in sorted(words, key=lambda w: (-len(w), w))[: len(words) - need + 1]})
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text0"), F.monotonically_increasing_id().alias("_row"))
    rows = phrase_places(rows, "_text0", phrases).withColumn("_held", F.array_intersect(_words(vocabulary), F.col("_words"))).drop("_words")
    enough = F.exists(F.array(*[F.struct(_words(words).alias("words"), F.lit(need).alias("need")) for _, words, need in told]),
                      lambda t: F.size(F.array_intersect("_held", t["words"])) >= t["need"])
    text = F.when(F.arrays_overlap("_held", _words(signals)) & enough, F.col("_text0"))
    return ws.put(rows.withColumn("_text", text).drop("_text0"), "read")


def _join(read: DataFrame, told) -> DataFrame:
    """_id, _row, block, template, label, overlap, containment: every block that holds enough words of a template."""
    seen = read.select(F.explode("_held").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    often = {r["word"]: r["n"] for r in seen.collect()}  # one row per template word at most
    order = sorted({w for _, words, _ in told for w in words}, key=lambda w: (often.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes = []
    for i, (label, words, need) in enumerate(told):
        ranked = sorted(words, key=place.get)
        prefixes += [(w, i, label, p, len(words), need, ranked) for p, w in enumerate(ranked[: len(words) - need + 1])]
    table = read.sparkSession.createDataFrame(prefixes, "word string, template int, label string, place int, size int, need int, words array<string>")
    held = _blocks(read.where("_text IS NOT NULL").select("_id", "_row", "_text"), "_text", order).where(F.size("held") >= min(need for _, _, need in told))
    met = held.select("_id", "_row", "block", "held", F.posexplode("held").alias("at", "word")).join(F.broadcast(table), "word")
    left = F.least(F.col("size") - F.col("place"), F.size("held") - F.col("at"))
    candidates = met.where((F.size("held") >= F.col("need")) & (left >= F.col("need"))).withColumn("overlap", F.size(F.array_intersect("held", "words")))
    return candidates.where("overlap >= need").select("_id", "_row", "block", "template", "label", "overlap", (F.col("overlap") / F.col("size")).alias("containment")).distinct()


def template_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """id_col, _row (number of the document's row), block, template, label, overlap, containment: every block that meets its template's share."""
    told = needs(templates, threshold)
    return _join(_read(Workspace(docs.sparkSession), docs, id_col, text_col, {}, told), told).withColumnRenamed("_id", id_col)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, phrases: dict[str, str] | None = None, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score (largest containment), n_blocks."""
    ws, told = Workspace(docs.sparkSession), needs(templates, threshold)
    read = _read(ws, docs, id_col, text_col, PHRASES if phrases is None else phrases, told)
    found = _join(read, told).groupBy("_row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"), F.size(F.collect_set("block")).alias("n_blocks"))
    own = ["_id", "_row", "n_words", "n_base", "first_word", "last_word", "base"]
    some = read.where("_text IS NOT NULL").select(*own).join(found, "_row", "left")
    rest = read.where("_text IS NULL").select(*own, F.lit(None).cast("array<string>").alias("found"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("n_blocks"))
    text = lambda x: F.concat_ws(",", F.array_sort(x))
    return ws.finish(some.unionByName(rest).select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"),
        text(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks")))


def sql(phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result in DuckDB's SQL, without filters: every block, those of several lines too, against every template."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    listed = ", ".join(f"({i}, '{label}', {quoted(words)}::VARCHAR[], {need})" for i, (label, words, need) in enumerate(needs(templates, threshold)))
    told = ", ".join(f"('{p}', '{v}', {quoted(word_list(p))}::VARCHAR[])" for p, v in phrases.items())
    other, space = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F", "[\\t\\n\\x0B\\f\\r ]+"
    wordless = "\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F"
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, {low} AS low FROM documents),
 words AS (SELECT r, doc_id, low, list_filter(regexp_split_to_array(low, '[{other}]+'), lambda x: x <> '') AS w FROM base),
 phrases(phrase, label, pw) AS (VALUES {told}),
 places AS (SELECT r, label, i FROM (SELECT r, w, unnest(range(len(w))) AS i FROM words WHERE contains(low, 'license') OR contains(low, 'cc')), phrases
            WHERE list_slice(w, i + 1, i + len(pw)) = pw),
 based AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY r),
 templates(template, label, tw, need) AS (VALUES {listed}),
 sentences AS (SELECT r, unnest(string_split(regexp_replace(regexp_replace(replace(low, chr(12), ' '), '\\r\\n?', chr(10), 'g'), '[.!?;]{space}|\\n([{wordless}]*\\n)+', chr(12), 'g'), chr(12))) AS b FROM base),
 texts AS (SELECT r, unnest(regexp_split_to_array(low, '[.!?;]{space}|[\\r\\n]+')) AS b FROM base
           UNION ALL SELECT r, b FROM sentences WHERE regexp_matches(b, '[^\\n]\\n[^\\n]')),
 blocks AS (SELECT r, list_distinct(list_filter(regexp_split_to_array(b, '[{other}]+'), lambda x: x <> '')) AS bw FROM texts),
 found AS (SELECT r, label, len(list_intersect(bw, tw)) / len(tw) AS share FROM blocks, templates WHERE len(list_intersect(bw, tw)) >= need),
 matched AS (SELECT r, max(share) AS best, list(DISTINCT label) AS labels, count(*) AS n FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
 coalesce(array_to_string(base_labels, ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(matched.labels, [])))), ','), '') AS labels,
 greatest(coalesce(best, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM words LEFT JOIN (SELECT r, n AS n_base, a, z, labels AS base_labels FROM based) USING (r) LEFT JOIN matched USING (r)
"""
