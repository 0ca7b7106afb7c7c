"""License scans: exact phrases, and fuzzy search for short notices.

A notice split into p parts that occurs with at most k edits holds p - k of them unchanged (pigeonhole). The parts are
the seeds, p = 2k + 2: found exactly in the normalised text by one automaton, they give the only windows, with k + 2
different parts or more near their places, where the regex library has to verify the notice under its bounded-error
matching. It reports the edits and the span.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels: fixed values of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices that the fuzzy search looks for, as normalised words: standard texts of the licenses.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved no part of this publication may be reproduced": "proprietary",
    "you should have received a copy of the gnu general public license along with this program": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "this software is provided by the copyright holders and contributors as is": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "distributed under the boost software license version 1 0": "bsl-1.0",
    "made available under the terms of the eclipse public license": "epl",
    "creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0",
    "dedicated to the public domain under cc0 1 0 universal": "cc0",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 16

_WORD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
OUT = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: bigint, end_word: bigint, edits: int, text: string>>"
)


def edits_for(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """2k + 2 parts of about equal length with their places: k + 2 of them stand unchanged in every occurrence with at most k edits."""
    bounds = [len(notice) * i // (2 * k + 2) for i in range(2 * k + 3)]
    return [(a, notice[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class Scanner:
    def __init__(self):
        import ahocorasick
        import regex

        self.notices, wanted = [], {}
        for n, (notice, label) in enumerate(NOTICES.items()):
            k = edits_for(notice)
            self.notices.append((label, len(notice), k, regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}")))
            for at, part in seeds(notice, k):
                wanted.setdefault(part, []).append((n, at))
        for phrase, label in PHRASES.items():
            wanted.setdefault(f" {phrase} ", []).append((-1, label))
        self.automaton = ahocorasick.Automaton()
        for part, uses in wanted.items():
            self.automaton.add_word(part, (len(part), uses))
        self.automaton.make_automaton()

    def verify(self, text: str, n: int, found: list[tuple[int, int]]) -> list[tuple[str, int, int, int, str]]:
        """(label, first word, end word, edits, text) of one notice near its seeds (start it would have, part), in a normalised text with a blank at both ends."""
        label, length, k, pattern = self.notices[n]
        windows: list[list[int]] = []  # first and last start; parts of one occurrence lie within k of its start
        found = sorted(set(found))
        low = 0
        for high, (at, _) in enumerate(found):
            while found[low][0] < at - 2 * k:
                low += 1
            if len({part for _, part in found[low : high + 1]}) >= k + 2:
                if windows and found[low][0] <= windows[-1][1] + 2 * k and at - windows[-1][0] < 4 * length:
                    windows[-1][1] = at
                else:
                    windows.append([found[low][0], at])
        taken: list[tuple[int, int]] = []
        for a, b in windows:
            for start, end in self.best(text, n, max(a - k, 0), min(b + length + 2 * k, len(text))):
                i = bisect_left(taken, (start, end))  # taken ones lie apart, so only the neighbours can overlap
                if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= end):
                    insort(taken, (start, end))
        out, at, blanks = [], 0, 0  # blanks before a place, counted on from the last one
        for start, end in taken:
            blanks += text.count(" ", at, start + 1)
            at, found = start + 1, text[start:end]
            edits = sum(pattern.fullmatch(text, start, end).fuzzy_counts)
            out.append((label, blanks - 1, blanks - 1 + len(found.split()), edits, found.strip()))
        return out

    def best(self, text: str, n: int, start: int, end: int) -> list[tuple[int, int]]:
        """Places of a notice within a range, apart from each other: the best match there, then the best to both sides of it. Blanks before a place do not belong to it."""
        _, length, k, pattern = self.notices[n]
        out, todo = [], [(start, end)]
        while todo:
            a, b = todo.pop()
            if b - a >= length - k and (m := pattern.search(text, a, b)):
                first = m.start() + len(m.group()) - len(m.group().lstrip())
                out.append((first, m.end()))
                todo += [(a, m.start()), (max(m.end(), a + 1), b)]
        return out

    def scan(self, raw: str) -> tuple:
        words = raw.encode().translate(_WORD).split()
        text = (b" " + b" ".join(words) + b" ").decode()
        places, base, near = [], set(), {}
        for end, (size, uses) in self.automaton.iter(text):
            begin = end - size + 1
            for n, what in uses:
                if n < 0:
                    places.append(begin)
                    base.add(what)
                else:
                    near.setdefault(n, []).append((begin - what, what))
        spans = sorted((x for n, at in near.items() for x in self.verify(text, n, at)), key=lambda s: (s[1], s[0], s[2]))
        lengths = {}
        for label, length, _, _ in self.notices:
            lengths[label] = max(lengths.get(label, 0), length)
        score = 1.0 if places else max((1 - e / lengths[s] for s, _, _, e, _ in spans), default=0.0)
        labels = sorted(base | {s[0] for s in spans})
        first, last = (text.count(" ", 0, f(places)) if places else None for f in (min, max))
        return (len(words), len(places), first, last, ",".join(sorted(base)), ",".join(labels), score, spans)


_scanner: Scanner | None = None


def scan_batches(batches):
    import pyarrow as pa

    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("text", pa.string())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    global _scanner
    _scanner = _scanner or Scanner()
    for batch in batches:
        rows = [_scanner.scan(t or "") for t in batch.column(1).to_pylist()]
        fields = [f for f in span.value_type]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        cols[-1] = [[dict(zip([f.name for f in fields], s, strict=True)) for s in x] for x in cols[-1]]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", *names])


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: words, exact places (n_base, first_word, last_word, base_labels), all labels, score and spans.

    score is 1 with an exact place, else 1 - edits / length of the closest notice, else 0. A null or empty text has no
    words, no places and no labels (empty strings). Rows may repeat; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan_batches, f"doc_id bigint, {OUT}")


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("spans")
