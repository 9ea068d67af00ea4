"""Licence scan with a positional index of rare template words, in DataFrame functions only.

Every template is a licence phrase.  The words of all templates are counted over all files, and each
template is filed under its word of the highest IDF, its rarest one.  A file's words are
looked up there: each place of such a word, shifted by the word's place in the template, is a possible start;
the postings of the template's other words are then intersected by relative position, which for
a whole file held in one row means comparing the words at these places.  A start counts as exact when
all words stand there.  The method's own labels also take starts at which at least
``SHARE`` of the template's IDF weight stands in place, provided its mandatory key phrase stands
there in full.

The template list is small and given by the caller; it becomes part of the plan.  Everything else
is done inside each row: no shuffle but the counting of at most one row per template word.

Defined cases: NULL and empty texts have no words, no labels and score 0; overlapping places all count;
repeated files are scanned alike; input columns other than the two named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.words import lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 0.6


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]  # must stand in place; all words for a base phrase
    base: bool = False


def template(label: str, phrase: str, key: str | None = None, base: bool = False) -> Template:
    return Template(label, tuple(phrase.split()), tuple((phrase if key is None else key).split()), base)


BASE = (
    template("mit", "under the mit license", base=True),
    template("apache-2", "apache license version 2", base=True),
    template("cc-by-nc", "cc by nc", base=True),
)
OWN = (
    template("mit", "released under the mit license", "mit license"),
    template("apache-2", "licensed under the apache license version 2 0", "apache license"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license"),
    template("bsd", "redistribution and use in source and binary forms", "source and binary forms"),
    template("mpl-2", "mozilla public license version 2 0", "mozilla public license"),
    template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
)


def with_words(files: DataFrame, text: str = "text", into: str = "words") -> DataFrame:
    body = lower_ascii(F.coalesce(text, F.lit("")))
    return files.withColumn(into, F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))


def word_idf(files: DataFrame, templates: Sequence[Template], words: str = "words") -> dict[str, float]:
    """IDF over all files of every word of the templates: one small aggregate."""
    known = sorted({w for t in templates for w in t.words})
    # The empty word stands once in every file and so counts the files.
    seen = F.explode(F.concat(F.array(F.lit("")), F.array_intersect(words, F.array(*map(F.lit, known)))))
    counts = {r.word: r.n for r in files.select(seen.alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: math.log(1 + (1 + counts.get("", 0)) / (1 + counts.get(w, 0))) for w in known}


def _anchor(t: Template, idf: dict[str, float]) -> int:
    """Place of the rarest word; of a template with a key phrase, the rarest inside it."""
    place = _key_place(t)
    return max(range(place, place + len(t.key)), key=lambda i: (idf[t.words[i]], -i))


def _key_place(t: Template) -> int:
    n = len(t.key)
    return next(i for i in range(len(t.words) - n + 1) if t.words[i : i + n] == t.key)


def _places(words: Column, word: str) -> Column:
    """Positions of a word, the empty list without a look at every word if it doesn't occur."""
    places = F.filter(F.transform(words, lambda w, i: F.when(w == word, i)), lambda p: p.isNotNull())
    return F.when(F.array_contains(words, word), places).otherwise(F.array().cast("array<int>"))


def _in_place(words: Column, start: Column, t: Template, i: int) -> Column:
    at = start + i
    return F.coalesce((at >= 0) & (F.get(words, at) == t.words[i]), F.lit(False))


def _hits(places: Column, words: Column, t: Template, idf: dict[str, float]) -> Column:
    """Starts of one template from the places of its anchor word."""
    shift, first = _anchor(t, idf), _key_place(t)
    weights = [idf[w] for w in t.words]
    rarest_first = sorted(range(first, first + len(t.key)), key=lambda i: -weights[i])

    def kept(place):
        test = F.lit(True)
        for i in rarest_first:
            test = test & _in_place(words, place - shift, t, i)
        return test

    def judged(place):
        found = [F.when(_in_place(words, place - shift, t, i), w).otherwise(0.0) for i, w in enumerate(weights)]
        return F.struct(
            F.lit(t.label).alias("label"), (place - shift).cast("long").alias("start"),
            F.round(sum(found[1:], found[0]) / sum(weights), 6).alias("share"), F.lit(t.base).alias("base"),
        )

    hits = F.transform(F.filter(places, kept), judged)
    return hits if t.base else F.filter(hits, lambda h: h["share"] >= SHARE)


def scan(
    files: DataFrame, file_id: str = "doc_id", text: str = "text", base: Sequence[Template] = BASE,
    own: Sequence[Template] = OWN,
) -> DataFrame:
    """(file_id, n_words, places array<struct<label, start, share, base>>) of every file.

    ``places`` holds every start at which a template counts, with the share of its weight found.
    """
    templates = [*base, *own]
    worded = with_words(files.select(file_id, text), text, "_words").drop(text)
    idf = word_idf(worded, templates, "_words")
    anchors = {}
    for t in templates:
        anchors.setdefault(t.words[_anchor(t, idf)], []).append(t)
    words, found = F.col("_words"), []
    posted = worded.withColumns({f"_at{n}": _places(words, word) for n, word in enumerate(anchors)})
    for n, here in enumerate(anchors.values()):
        found += [_hits(F.col(f"_at{n}"), words, t, idf) for t in here]
    return posted.select(file_id, F.size(words).cast("long").alias("n_words"), F.concat(*found).alias("places"))


def summary(scanned: DataFrame, file_id: str = "doc_id") -> DataFrame:
    """One row of counts and labels per file."""
    base = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["start"])
    joined = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda p: p["label"]))), ",")
    best = F.array_max(F.transform("places", lambda p: p["share"]))
    return scanned.select(
        file_id,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).alias("first_word"),
        F.array_max(base).alias("last_word"),
        joined(F.filter("places", lambda p: p["base"])).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
