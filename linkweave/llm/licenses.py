"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from linkweave.llm.common import session, view

# Notices that the licenses' publishers ask to be put on a work, and short forms in common use.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the'
        " License. You may obtain a copy of the License at",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction',
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "Proprietary": ["All rights reserved."],
}
# Fingerprints: the least of WINDOW hashes of GRAM words; any GRAM + WINDOW - 1 words in common share one.
GRAM, WINDOW = 3, 2
# A template may shift by BAND words against the text; COVERAGE of its words must match.
BAND, COVERAGE = 8, 0.8

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words (with inner points and hyphens) and their places in the text."""
    found = list(WORD.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


def grams(words: list[str], size: int) -> list[int]:
    hashes = [xxhash.xxh64_intdigest(w) for w in words]
    if len(words) < size:
        return [xxhash.xxh64_intdigest(" ".join(words))] if words else []
    return [hash(tuple(hashes[i : i + size])) for i in range(len(hashes) - size + 1)]


def winnow(values: list[int], window: int) -> dict[int, int]:
    """Of each window the least value, the rightmost of equals, as place: value."""
    chosen = {}
    for start in range(max(1, len(values) - window + 1)) if values else ():
        part = values[start : start + window]
        least = min(part)
        chosen[start + max(i for i, v in enumerate(part) if v == least)] = least
    return chosen


@dataclass
class Template:
    license: str
    words: list[str]


@dataclass
class Index:
    """The inverted index of the templates' fingerprints: value to (template, place)."""

    templates: list[Template]
    places: dict[int, list[tuple[int, int]]]
    heads: set[str]

    @staticmethod
    def build(templates: Mapping[str, list[str]]) -> Index:
        made: list[Template] = []
        places: dict[int, list[tuple[int, int]]] = {}
        heads: set[str] = set()
        for name, texts in templates.items():
            for text in texts:
                words, _ = words_of(text)
                if not words:
                    continue
                for place, value in winnow(grams(words, GRAM), WINDOW).items():
                    places.setdefault(value, []).append((len(made), place))
                heads.update(words)
                made.append(Template(name, words))
        return Index(made, places, heads)


def align(template: list[str], words: list[str], shift: int) -> tuple[int, int, int]:
    """Global alignment of the template to a stretch of the text around the diagonal ``shift``, within
    BAND words: matched words, and the first and last word matched (-1, -1 if none).

    A word of the template left out costs 1, a word of the text between matches 1; those before the first and after the last
    match are free. The greatest score wins, then the more matches.
    """
    low = -10**6
    width = 2 * BAND + 1
    # cell: (score, matches, first, last)
    none = (low, 0, -1, -1)
    row = [(0, 0, -1, -1)] * width
    best = (low, 0, -1, -1)
    for i, wanted in enumerate(template):
        new = [none] * width
        for k in range(width):
            j = i + shift + k - BAND  # word of the text
            score, matches, first, last = row[k]
            options = []
            if 0 <= j < len(words) and words[j] == wanted:
                options.append((score + 2, matches + 1, j if first < 0 else first, j))
            if k + 1 < width:  # the template's word is left out
                s, m, f, t = row[k + 1]
                options.append((s - 1, m, f, t))
            if k > 0 and new[k - 1][1]:  # the text's word is left out
                s, m, f, t = new[k - 1]
                options.append((s - 1, m, f, t))
            new[k] = max(options, key=lambda o: (o[0], o[1], -o[3]), default=none)
        row = new
    best = max(row, key=lambda o: (o[0], o[1], -o[3]))
    return best[1], best[2], best[3]


def scan_text(index: Index, text: str | None) -> list[tuple[str, float, int, int, int, int]]:
    """(license, coverage, matched words, words, start, end) of all matches, in characters, end exclusive.

    Of overlapping matches the one with more matched words stays, then the higher coverage, then the earlier template.
    """
    if not text:
        return []
    words, spans = words_of(text)
    # only stretches of words that templates use can hold a fingerprint; the others are not hashed
    known = np.fromiter((w in index.heads for w in words), bool, len(words))
    if not known.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    candidates: set[tuple[int, int]] = set()
    for start, end in zip(edges[::2], edges[1::2]):
        run = words[start:end]
        if len(run) < GRAM and len(words) > len(run) and not any(len(t.words) < GRAM for t in index.templates):
            continue
        for at, value in enumerate(grams(run, GRAM)):
            for number, place in index.places.get(value, ()):
                candidates.add((number, int(start) + at - place))
    found = []
    for number, shift in candidates:
        template = index.templates[number]
        matched, first, last = align(template.words, words, shift)
        coverage = matched / len(template.words)
        if coverage >= COVERAGE:
            found.append((matched, coverage, number, first, last, template))
    found.sort(key=lambda f: (-f[0], -f[1], f[2], f[3]))
    taken: list[tuple[int, int]] = []
    rows = []
    for matched, coverage, _, first, last, template in found:
        if all(last < a or first > b for a, b in taken):
            taken.append((first, last))
            rows.append((template.license, coverage, matched, len(template.words), spans[first][0], spans[last][1]))
    return sorted(rows, key=lambda r: r[4])


FOUND = (
    "doc_id long, n_licenses long, licenses array<string>, "
    "spans array<struct<license:string,coverage:double,matched:int,words:int,start:int,end:int>>"
)


def scan(docs: DataFrame, templates: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_licenses`` (matches), ``licenses`` (distinct, sorted), ``spans`` (by place).

    Whole texts are scanned; all fingerprints of a text are looked up, so a template whose GRAM + WINDOW - 1 words in a row are there
    is always aligned. A null or empty text has no match. Repeated rows get equal
    results; an empty table gives an empty result. The index is a parameter that every task gets; no row moves.
    """
    spark = session(docs.sparkSession).sparkContext
    index = spark.broadcast(Index.build(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct(
            [("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
        )
        for batch in batches:
            found = [scan_text(index.value, t) for t in batch.column("text").to_pylist()]
            rows = [[dict(zip(("license", "coverage", "matched", "words", "start", "end"), r)) for r in f] for f in found]
            columns = [
                batch.column("doc_id"),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([sorted({r[0] for r in f}) for f in found], pa.list_(pa.string())),
                pa.array(rows, pa.list_(kind)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_licenses", "licenses", "spans"])

    return view(docs).select("doc_id", "text").mapInArrow(run, FOUND)
