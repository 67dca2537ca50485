"""Operator 5: licences in files, by a positional index of rare words. DataFrame functions only.

Method: each template's anchor is the word of its mandatory phrase with the highest inverse document frequency. Wherever
an anchor stands in a file it is looked up in the templates' postings, which say where the template would begin; the
postings of the phrase's next rarest words (MARKS in all) must agree on that place, and then the mandatory phrase must
stand there. Base labels come from three phrases, wherever they stand.

Files that have no key word can neither hold a mandatory nor a base phrase, so only the others (written once, with
their words) are looked up. What is broadcast is the table of postings, whose size is that of the templates below.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import common

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: what separates words.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels. Each ends in the same word, which no two of them share a place of.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
_LAST = "license"
#: Labels, mandatory phrases and texts of the templates; a phrase is part of its text.
TEMPLATES = (
    ("mit-text", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-notice", "released under the mit license", "released under the mit license"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-or-later", "gnu general public license as published by the free software foundation", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-4.0", "licensed under cc by 4 0", "this work is licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc0-1.0", "cc0 1 0 universal", "licensed under cc0 1 0 universal public domain dedication"),
    ("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
)
#: Rarest words of a phrase that must agree on where a template begins.
MARKS = 3
_VOCABULARY = sorted({w for _, _, t in TEMPLATES for w in t.split()})
#: Words to both sides of an anchor that a template can reach.
_REACH = max(len(t.split()) for _, _, t in TEMPLATES)


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def _words(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, _BREAK), "")


def inverse_frequencies(docs: DataFrame, text_col: str) -> dict[str, float]:
    """Of each licence word, over all documents. As many values as the templates have words reach the driver."""
    words = F.array_intersect(F.split(_lowered(F.col(text_col)), _BREAK), F.array(*(F.lit(w) for w in _VOCABULARY)))
    rows = docs.select(F.explode(F.array_append(words, "")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r.w: r.n for r in rows}
    n = counts.get("", 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 0.5)) for w in _VOCABULARY}


def _base(words: Column) -> Column:
    """start and label of each place of a base phrase."""

    def at(word: Column, i: Column) -> Column:
        out = F.lit(None)
        for phrase, label in BASE.items():
            first = i - (len(phrase) - 1)
            before = [F.get(words, first + k) == w for k, w in enumerate(phrase[:-1])]
            out = F.when(reduce(lambda a, b: a & b, before, word == _LAST), F.struct(first.cast("long").alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.filter(F.transform(words, at), lambda x: x.isNotNull())


def scan_licenses(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a found template's weight (by inverse document frequency) that stands in its place,
    and at least 0.5 where a base phrase stands; 0 without labels. A null or empty text has no words, no places and
    empty labels. Repeated rows and null ids stay; an empty table gives an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    idf = inverse_frequencies(docs, "text")
    anchors = [max(phrase.split(), key=lambda w: (idf[w], w)) for _, phrase, _ in TEMPLATES]
    keys = sorted({*anchors, _LAST})
    worded = docs.select("doc_id", _words(_lowered(F.col("text"))).alias("words"))
    has_key = F.arrays_overlap("words", F.array(*(F.lit(k) for k in keys)))

    files = worded.filter(has_key).select(F.monotonically_increasing_id().alias("file"), "doc_id", "words")
    files = common.written(files, f"{folder}/files")
    # Each anchor with the words around it, so that the files' words aren't needed again.
    low = lambda i: F.greatest(i - _REACH, F.lit(0))
    spot = lambda w, i: F.when(w.isin(*set(anchors)), F.struct(i.alias("i"), w.alias("word"), F.slice("words", low(i) + 1, 2 * _REACH + 1).alias("near")))
    hits = files.select("file", F.explode(F.filter(F.transform("words", spot), lambda x: x.isNotNull())).alias("x")).select("file", "x.word", "x.near", low(F.col("x.i")).alias("low"), "x.i")

    rows = []
    for k, (label, phrase, text) in enumerate(TEMPLATES):
        body, key = text.split(), phrase.split()
        at = next(p for p in range(len(body)) if body[p : p + len(key)] == key)
        marks = sorted(set(key), key=lambda w: (idf[w], w), reverse=True)[:MARKS]
        rows.append((anchors[k], k, label, key, at, at + key.index(anchors[k]), body, [idf[w] for w in body], [(w, at + key.index(w)) for w in marks]))
    templates = spark.createDataFrame(rows, "word string, template int, label string, key array<string>, at int, place int, body array<string>, weights array<double>, marks array<struct<word:string,place:int>>")
    # Where the template would begin before the file does, its phrase may still stand in the file.
    first = F.col("offset") + F.col("at")
    placed = hits.join(F.broadcast(templates), "word").withColumn("offset", F.col("i") - F.col("place") - F.col("low"))
    agree = F.forall("marks", lambda m: F.coalesce(F.get("near", F.col("offset") + m["place"]) == m["word"], F.lit(False)))
    stands = agree & (first >= 0) & (F.slice("near", F.greatest(first, F.lit(0)) + 1, F.size("key")) == F.col("key"))
    share = F.aggregate(
        F.zip_with("weights", F.transform("body", lambda w, p: F.get("near", F.col("offset") + p) == w), lambda v, ok: F.when(ok, v).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b
    ) / F.aggregate("weights", F.lit(0.0), lambda a, b: a + b)
    found = placed.filter(stands).groupBy("file", "template").agg(F.first("label").alias("label"), F.max(share).alias("share"))
    found = found.groupBy("file").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))

    joined = files.withColumn("base", _base(F.col("words"))).join(found, "file", "left")
    names = F.transform("base", lambda x: x["label"])
    starts = F.transform("base", lambda x: x["start"])
    listed = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    scanned = joined.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(names).alias("base_labels"),
        listed(F.concat(names, F.coalesce("own", F.array()))).alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))).alias("score"),
    )
    place = F.lit(None).cast("long")
    rest = worded.filter(~has_key).select("doc_id", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_base"), place.alias("first_word"), place.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    return scanned.unionByName(rest)
