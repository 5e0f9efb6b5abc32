"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are groups of consecutive lines, one starting at every line, so that wrapped texts are found:
of LONG_LINES lines for templates of LONG_FROM distinct words or more, of SHORT_LINES for others. A
template is found in a block if the share of its distinct words that the block holds is at least
`threshold`. The join orders words by how often they occur in the whole corpus, rarest first: a block
that holds enough of a template must hold one of its first size - needed + 1 words (prefix filter),
must have `needed` distinct words (length filter), and the words left behind the first shared one must
suffice (positional filter). What passes is counted. A block is reported by its lines from the first
to the last that hold a word of the template, and each such place once.

Templates are a table (label, text) or those of TEMPLATES; a label may have several. Null and empty
texts have no words and no labels. Repeated rows each give their row.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.shared import by_value, opened, shipped, small_batches

by_value(__name__)

SHORT_LINES, LONG_LINES, LONG_FROM, THRESHOLD = 3, 8, 16, 0.8
#: Templates that the driver takes at most; they are kept by every task.
MOST_TEMPLATES = 20_000

# fixed values: phrases and their labels
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# fixed values: opening or granting sentences of public licenses, by label
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("mit-line", "Released under the MIT License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache-line", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-line", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: A-Z become a-z, every other ASCII character but digits and letters a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


def template_words(templates: DataFrame | None = None) -> list[tuple[str, frozenset[bytes]]]:
    """(label, distinct words) of each template that has any."""
    rows = list(TEMPLATES)
    if templates is not None:
        rows = [tuple(r) for r in templates.select(F.col("label").cast("string"), F.col("text").cast("string")).where("label is not null").distinct().limit(MOST_TEMPLATES + 1).collect()]
        if len(rows) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return sorted((label, words) for label, text in rows if (words := frozenset(folded(text).split())))


def word_counts(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of the templates occurs in all documents; others aren't counted."""

    def run(batches):
        for b in batches:
            met = Counter()
            for t in b.column(0):
                met.update(filter(vocabulary.__contains__, folded(t.as_py()).split()))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in met], pa.string()), pa.array(list(met.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counted.collect()}  # at most one row for each word of the templates


class Index:
    """Prefix lists of the templates, in the order of the words' frequencies."""

    def __init__(self, templates: list[tuple[str, frozenset[bytes]]], counts: dict[bytes, int], threshold: float):
        vocabulary = set().union(*[words for _, words in templates])
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.templates: list[tuple[str, frozenset[bytes], int, dict[bytes, int]]] = []
        self.prefix: dict[bytes, list[int]] = {}
        for label, words in sorted(templates, key=lambda t: (t[0], sorted(t[1]))):
            ordered = sorted(words, key=self.rank.__getitem__)
            needed = math.ceil(threshold * len(ordered) - 1e-9)
            at = len(self.templates)
            self.templates.append((label, words, needed, {w: i for i, w in enumerate(ordered)}))
            for w in ordered[: len(ordered) - needed + 1]:
                self.prefix.setdefault(w, []).append(at)

    def found(self, words: set[bytes], least: int = 0, most: float = math.inf) -> list[tuple[int, float]]:
        """(template, containment) of the templates of `least` to `most` words that a block holds."""
        out, tried = [], set()
        for w in sorted(words & self.prefix.keys(), key=self.rank.__getitem__):
            for at in self.prefix[w]:
                if at in tried:
                    continue
                tried.add(at)
                _, own, needed, place = self.templates[at]
                if not least <= len(own) <= most or len(words) < needed or len(own) - place[w] < needed:
                    continue
                shared = len(own & words)
                if shared >= needed:
                    out.append((at, shared / len(own)))
        return out


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    out = []
    line = None
    for phrase, label in PHRASES:
        parts = phrase.encode().split()
        if parts[0] not in words:
            continue
        line = line or b" " + b" ".join(words) + b" "
        sought, at, done, n = b" " + phrase.encode() + b" ", 0, 0, 0
        while (at := line.find(sought, at)) >= 0:
            n += line.count(b" ", done, at)
            done = at
            out.append((n, label))
            at += 1
    return sorted(out)


def block_places(text: str, index: Index) -> list[tuple[str, int, int, float]]:
    """(label, first line, lines, containment) of the templates found, each place once."""
    # words of no template only count for the length filter, which the shared words pass anyway
    lines = [index.rank.keys() & folded(x).split() for x in text.split("\n")]
    places: dict[tuple[str, int, int], float] = {}
    for size, least, most in ((SHORT_LINES, 0, LONG_FROM - 1), (LONG_LINES, LONG_FROM, math.inf)):
        for i in range(len(lines)):
            if not lines[i]:
                continue
            for at, share in index.found(set().union(*lines[i : i + size]), least, most):
                label, own, _, _ = index.templates[at]
                held = [k for k in range(i, min(i + size, len(lines))) if not own.isdisjoint(lines[k])]
                key = label, held[0], held[-1] - held[0] + 1
                places[key] = max(share, places.get(key, 0.0))
    return [(*k, share) for k, share in sorted(places.items())]


def scan_text(text: str | None, index: Index) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
    """Number of words, places of phrases, and the blocks found."""
    words = folded(text).split()
    blocks = [] if index.prefix.keys().isdisjoint(words) else block_places(text, index)
    return len(words), phrase_places(words), blocks


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: DataFrame | None = None) -> DataFrame:
    """(id, n_words, places, blocks): one row per row of docs."""
    small_batches(docs.sparkSession)
    known = template_words(templates)
    counts = word_counts(docs, text_col, frozenset().union(*[words for _, words in known]))
    index = shipped(docs.sparkSession, Index(known, counts, threshold))
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    block = pa.list_(pa.struct([("label", pa.string()), ("line", pa.int64()), ("lines", pa.int64()), ("containment", pa.float64())]))

    def run(batches):
        own = opened(index)
        for b in batches:
            got = [scan_text(t.as_py(), own) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([[{"word": w, "label": x} for w, x in g[1]] for g in got], place), pa.array([[dict(zip(("label", "line", "lines", "containment"), x, strict=True)) for x in g[2]] for g in got], block)],
                ["id", "n_words", "places", "blocks"],
            )

    out = "id long, n_words long, places array<struct<word:long,label:string>>, blocks array<struct<label:string,line:long,lines:long,containment:double>>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, out)
