"""License scan by a positional index of rare licence words.

A template is a line or paragraph of a licence with a key phrase that must be there word by
word. The index holds, for the rarest words of each key phrase (highest inverse document
frequency over the scanned corpus), the template and the word's place in it. A file is
looked up by its rare licence words only: each place of one proposes a start of the
template (its own position less the word's place), the starts that all rare words of a
template propose are kept, and there the whole key phrase is verified. The rest of the
template then gives the score: the share of its words found at their relative positions.

Postings are intersected inside a row, so nothing is shuffled but the counts of at most a
few hundred vocabulary words. Every place of a key phrase holds its rare words, so none is
lost.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import UPPER

# separators of words before lower-casing: ASCII other than digits and letters
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``text`` in lower-case words; ``phrase``, a part of it, must be there word by word."""

    name: str
    label: str
    text: str
    phrase: str | None = None

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key(self) -> list[str]:
        return (self.phrase or self.text).split()

    @property
    def key_at(self) -> int:
        """Place of the key phrase in the template."""
        words, key = self.words, self.key
        for at in range(len(words) - len(key) + 1):
            if words[at:at + len(key)] == key:
                return at
        raise ValueError(f"template {self.name}: the phrase is not in the text")


# fixed values: phrases whose places are counted, with their labels
BASE = (
    Template("base-mit", "mit", "mit license"),
    Template("base-apache", "apache", "apache license"),
    Template("base-gpl", "gpl", "general public license"),
)
# fixed values: common notices of public licences
NOTICES = (
    Template("mit-notice", "mit-notice", "released under the mit license", "the mit license"),
    Template("mit-grant", "mit-text", "permission is hereby granted free of charge to any person "
             "obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache-notice", "apache-2.0", "licensed under the apache license version 2 0",
             "apache license version 2 0"),
    Template("gpl-notice", "gpl-3.0", "licensed under the gnu general public license version 3",
             "gnu general public license version 3"),
    Template("lgpl-notice", "lgpl", "under the terms of the gnu lesser general public license",
             "gnu lesser general public license"),
    Template("cc-by-nc-notice", "cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("bsd-grant", "bsd", "redistribution and use in source and binary forms with or "
             "without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-notice", "mpl-2.0", "subject to the terms of the mozilla public license v 2 0",
             "mozilla public license"),
    Template("reserved", "all-rights-reserved", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    """Words in their own case: maximal runs of digits, letters and characters past ASCII."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _lower(word: Column) -> Column:
    return F.translate(word, UPPER, UPPER.lower())


def document_frequency(docs: DataFrame, vocabulary: Sequence[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and how many hold each word of the vocabulary.

    Reads all documents. What comes back is one row per vocabulary word.
    """
    vocabulary = sorted(vocabulary)
    # lower() may fold letters past ASCII onto a-z; it only chooses words here
    found = F.array_intersect(F.transform(words_of(F.col(text)), F.lower),
                              F.array(*map(F.lit, vocabulary)))
    marked = docs.select(F.explode_outer(found).alias("word"), F.lit(1).alias("one"))
    counted = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    rows = marked.filter(F.col("word").isNotNull()).groupBy("word").agg(F.count("one").alias("n")).collect()
    return counted, {row["word"]: row["n"] for row in rows}


def rare_words(template: Template, documents: int, frequency: dict[str, int], most: int) -> list[tuple[str, int]]:
    """The ``most`` highest-IDF words of the key phrase with their places in the template."""
    idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in template.key}
    first = {w: template.key_at + template.key.index(w) for w in reversed(template.key)}
    return [(w, first[w]) for w in sorted(first, key=lambda w: (-idf[w], first[w]))[:most]]


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, rare: int = 2,
         keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document: ``keep``, ``n_words`` and ``matches``.

    ``matches`` is an array of (template, label, start, score): ``start`` is the place of the
    key phrase in words from 0, ``score`` the share of the template's words that stand at
    their relative places. NULL and empty texts have no words and no matches; repeated rows
    each have their row; other columns are not read.
    """
    vocabulary = {w for t in templates for w in t.key}
    documents, frequency = document_frequency(docs, sorted(vocabulary), text)
    index = {t.name: rare_words(t, documents, frequency, rare) for t in templates}
    anchors = sorted({w for posts in index.values() for w, _ in posts})

    words = docs.select(*keep, words_of(F.col(text)).alias("words"))
    places = F.array_compact(F.transform(
        "words", lambda w, i: F.when(F.lower(w).isin(anchors), i)))
    hit = words.withColumn("hits", places).select(
        "*", F.transform("hits", lambda i: _lower(F.get("words", i))).alias("hit_words"))

    def proposals(word: str, at: int) -> Column:
        """Template starts that the hits of one rare word propose."""
        hits = F.filter(F.arrays_zip("hits", "hit_words"), lambda h: h["hit_words"] == word)
        return F.transform(hits, lambda h: h["hits"] - F.lit(at))

    def starts(template: Template) -> Column:
        """Starts of the template that all its rare words propose; may lie before the text."""
        first, *others = (proposals(word, at) for word, at in index[template.name])
        for more in others:
            first = F.array_intersect(first, more)
        return first

    def matches(template: Template) -> Column:
        size, key, at = len(template.words), template.key, template.key_at

        def word(start: Column, k: int) -> Column:
            """The word at the template's place k; NULL outside the text."""
            return _lower(F.get("words", start + F.lit(k)))

        def whole_phrase(start: Column) -> Column:
            held = F.lit(True)
            for k, expected in enumerate(key):
                held = held & F.coalesce(word(start, at + k) == expected, F.lit(False))
            return held

        def match(start: Column) -> Column:
            found = F.lit(0)
            for k, expected in enumerate(template.words):
                found = found + F.when(word(start, k) == expected, 1).otherwise(0)
            return F.struct(
                F.lit(template.name).alias("template"), F.lit(template.label).alias("label"),
                (start + F.lit(at)).cast("long").alias("start"),
                (found / F.lit(float(size))).alias("score"))
        return F.transform(F.filter(starts(template), whole_phrase), match)

    return hit.select(
        *keep, F.size("words").cast("long").alias("n_words"),
        F.when(F.size("hits") > 0, F.concat(*[matches(t) for t in templates])).otherwise(
            F.array().cast("array<struct<template:string,label:string,start:bigint,score:double>>")
        ).alias("matches"))
