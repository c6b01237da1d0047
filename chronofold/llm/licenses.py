"""Fuzzy search for short licence notices.

A notice of n characters may differ in up to n // EDITS_EVERY characters (inserted, deleted or replaced). It is split into
one seed more than that, so by the pigeonhole principle one seed stands unchanged in every place that counts; one
Aho-Corasick pass over the words of a text finds the seeds, and the regex library's bounded-error matching verifies the
stretch around each and gives the edits and the span.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chronofold.llm.common import slices

#: Exact phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Short notices, as words, and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under the creative commons attribution", "cc-by"),
    ("this work is licensed under cc by", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("all rights reserved", "reserved"),
)
EDITS_EVERY = 12

_UPPER = bytes(range(0x41, 0x5B))
#: Lower-cases A-Z and turns every other ASCII character that belongs to no word into a space.
_WORDS = bytes(c + 32 if c in _UPPER else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Searcher:
    def __init__(self, notices: tuple = NOTICES, edits_every: int = EDITS_EVERY) -> None:
        self.seeds, self.checks, self.edits_every = ahocorasick.Automaton(), [], edits_every
        places: dict[str, list[tuple[int, int]]] = {}
        for at, (notice, label) in enumerate(notices):
            edits = len(notice) // edits_every
            self.checks.append((regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}"), len(notice), edits, label))
            for k in range(edits + 1):
                a, b = len(notice) * k // (edits + 1), len(notice) * (k + 1) // (edits + 1)
                places.setdefault(notice[a:b], []).append((at, b))
        for seed, found in places.items():
            self.seeds.add_word(seed, found)
        self.seeds.make_automaton()

    def find(self, joined: str) -> list[tuple[int, int, int, str, float]]:
        """(start, end, notice, label, likeness) in the space-joined words; spans of a notice don't overlap."""
        areas: dict[int, list[tuple[int, int]]] = {}
        for end, found in self.seeds.iter(joined):
            for at, seed_end in found:
                _, n, edits, _ = self.checks[at]
                areas.setdefault(at, []).append((max(0, end + 1 - seed_end - edits), min(len(joined), end + 1 - seed_end + n + edits)))
        out = []
        for at, places in areas.items():
            check, n, _, label = self.checks[at]
            stretches: list[tuple[int, int]] = []
            for lo, hi in sorted(places):
                if stretches and lo <= stretches[-1][1]:
                    stretches[-1] = (stretches[-1][0], max(hi, stretches[-1][1]))
                else:
                    stretches.append((lo, hi))
            while stretches:  # the best match of a stretch comes first; what lies before and behind it is searched again
                lo, hi = stretches.pop()
                if m := check.search(joined, lo, hi):
                    out.append((m.start(), m.end(), at, label, 1 - sum(m.fuzzy_counts) / n))
                    stretches += [(a, b) for a, b in ((lo, m.start()), (m.end(), hi)) if b - a >= n - n // self.edits_every]
        return out


def scan_text(text: str, searcher: Searcher) -> tuple:
    words = words_of(text)
    joined = b" ".join(words)
    padded, n_base, first, last, base = b" " + joined + b" ", 0, None, None, set()
    for phrase, label in BASE:
        target, at, seen, index = b" " + phrase.encode() + b" ", padded.find(b" " + phrase.encode() + b" "), 0, 0
        while at >= 0:
            index += padded.count(b" ", seen, at)
            seen = at
            n_base += 1
            first, last = index if first is None else min(first, index), index if last is None else max(last, index)
            base.add(label)
            at = padded.find(target, at + 1)
    found = searcher.find(joined.decode("utf-8", "surrogatepass"))
    score = 1.0 if base else max((x[4] for x in found), default=0.0)
    spans = ",".join(f"{label}:{start}:{end}" for start, end, _, label, _ in sorted(found))
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | {x[3] for x in found})), score, spans


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> a row for each row: words, exact phrases, labels, score, spans in the space-joined words.

    A null text counts as empty: no words, no labels (empty strings), null first and last word, score 0. The score is 1
    where an exact phrase stands, else the likeness of the best notice. One narrow stage, nothing shuffled.
    """
    columns = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notice_spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        for batch in slices(batches):
            rows = [scan_text(x or "", searcher) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[c.split()[0] for c in columns.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, columns)
