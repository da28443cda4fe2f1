"""Fuzzy search for short license notices.

A notice of n bytes may be matched with up to k errors (insertions, deletions, substitutions). Cut into k + 1
pieces, at least one of them must occur unchanged (pigeonhole), so exact finds of the pieces locate candidate
places, and the regex library's bounded-error matching verifies a window of the notice's own length around each
and reports the best span and its errors. Matches that overlap compete: the fewest errors win, then the longest
notice, so that a notice is not also read as its near relative. Texts are compared as their lower-cased words
joined by one blank. The exact base phrases are counted apart and their labels always stay.

The work grows in proportion to the text: each find of a piece costs one window, whatever lies around it. Null and
empty texts have no words and no labels. Repeated rows get equal results, each as a row. An empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table, with_columns

# The contract's phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Short notices, as lower-case words.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the gnu general public license", "gpl"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("gnu general public license as published by the free software foundation either version 3 of the license", "gpl-3"),
    ("gnu general public license as published by the free software foundation either version 2 of the license", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("gnu lesser general public license as published by the free software foundation either version", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("gnu affero general public license as published by the free software foundation either version", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("redistributions of source code must retain the above copyright notice", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("to the extent possible under law the author has waived all copyright", "cc0"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
)
#: One error is allowed for so many bytes of a notice, and no more than MOST_ERRORS.
BYTES_AN_ERROR, MOST_ERRORS = 9, 4

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Notice:
    def __init__(self, text: str, label: str, errors: int | None = None):
        self.body, self.label = text.encode(), label
        self.errors = min(MOST_ERRORS, len(self.body) // BYTES_AN_ERROR) if errors is None else errors
        cuts = [round(i * len(self.body) / (self.errors + 1)) for i in range(self.errors + 2)]
        self.seeds = [(a, self.body[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(rb"(?<= )(?:" + regex.escape(self.body, literal_spaces=True) + b"){e<=%d}(?= )" % self.errors, regex.BESTMATCH)

    def places(self, norm: bytes) -> list[int]:
        """Where the notice may start: each find of a piece, less the piece's place in the notice, sorted."""
        out = []
        for offset, seed in self.seeds:
            at = norm.find(seed)
            while at >= 0:
                out.append(at - offset)
                at = norm.find(seed, at + 1)
        return sorted(out)

    def found(self, norm: bytes) -> list[tuple[int, int, int]]:
        """(start, end, errors) of the best match around each candidate place of a blank-framed text, each once."""
        out: dict[tuple[int, int], int] = {}
        first = last = None
        for at in [*self.places(norm), None]:
            if first is not None and (at is None or at > first + self.errors):
                m = self.pattern.search(norm, max(0, first - self.errors - 1), last + len(self.body) + self.errors + 1)
                if m:
                    out[m.span()] = sum(m.fuzzy_counts)
                first = None
            first, last = (at if first is None else first), at
        return [(a, b, e) for (a, b), e in out.items()]


def settled(matches: list[tuple[int, int, int, int, str]]) -> list[tuple[int, int, int, int, str]]:
    """Of (errors, -length, start, end, label), those that no better match overlaps."""
    starts: list[int] = []
    taken: list[tuple[int, int, int, int, str]] = []
    for m in sorted(matches):
        i = bisect_left(starts, m[2])
        if (i == len(taken) or m[3] <= starts[i]) and (i == 0 or taken[i - 1][3] <= m[2]):
            starts.insert(i, m[2])
            taken.insert(i, m)
    return taken


@lru_cache(4)
def _notices(which: tuple[tuple[str, str], ...]) -> list[Notice]:
    return [Notice(*x) for x in which]


def normal(text: str | None) -> tuple[bytes, int]:
    """The words, each with a blank before, and a blank at the end; and how many they are."""
    found = (text or "").encode().translate(_WORDS).split()
    return b"".join([b" " + w for w in found] + [b" "]), len(found)


def base_places(norm: bytes, blanks: np.ndarray) -> list[tuple[int, str]]:
    """(word, label) of each place of a base phrase; ``blanks``: the places of all blanks."""
    out = []
    for phrase, label in BASE:
        framed = b" " + phrase.encode() + b" "
        at = norm.find(framed)
        while at >= 0:
            out.append((int(np.searchsorted(blanks, at)), label))
            at = norm.find(framed, at + 1)
    return sorted(out)


ADDED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:int,last_word:int,errors:int>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("errors", pa.int32())]))


def scan(text: str | None, notices: list[Notice]) -> tuple:
    """The values of ADDED for one text. The score is that of the best match: 1 - errors / length."""
    norm, n = normal(text)
    blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    base = base_places(norm, blanks)
    won = settled([(e, -len(notice.body), a, b, notice.label) for notice in notices for a, b, e in notice.found(norm)])
    score = max([1.0 if base else 0.0, *(1 + e / size for e, size, *_ in won)])
    spans = [(int(np.searchsorted(blanks, a)) - 1, int(np.searchsorted(blanks, b)) - 1, label, e) for e, _, a, b, label in won]
    labels = {label for _, label in base}
    return (
        n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)),
        ",".join(sorted(labels | {x[2] for x in spans})), score, [{"label": x[2], "first_word": x[0], "last_word": x[1], "errors": x[3]} for x in spans],
    )


def license_scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """id and ADDED, a row for each document. ``spans`` are the fuzzy matches, in words."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS)

    def measure(column: pa.Array) -> list[pa.Array]:
        rows = [scan(cell.as_py(), _notices(notices)) for cell in column]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]

    return with_columns(docs, text, measure, ADDED, [id_column])


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
