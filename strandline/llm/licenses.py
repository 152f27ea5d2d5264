"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice of which at most ``edits`` characters are inserted, deleted or replaced still holds one
of its ``edits + 1`` pieces unchanged. One Aho-Corasick pass finds all pieces of all notices; only
the stretch around a hit goes to the regex library's bounded-error matching, which says whether
the notice is there, where, and with how many edits.

Defined cases: null text is an empty text; a text without words has no places and score 0;
repeated rows and ids each get a result; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: Phrases and their labels: fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


class Notice(NamedTuple):
    label: str
    words: str
    edits: int


#: Short notices in normal form (lower case, words with one space between).
NOTICES = (
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("gpl", "this work is licensed under the gnu general public license version", 5),
    Notice("gpl", "redistribute it and or modify it under the terms of the gnu general public license", 6),
    Notice("lgpl", "under the terms of the gnu lesser general public license", 4),
    Notice("agpl", "under the terms of the gnu affero general public license", 4),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 7),
    Notice("mpl", "subject to the terms of the mozilla public license", 4),
    Notice("cc-by", "licensed under cc by 4 0", 1),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 1),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 1),
    Notice("cc-by", "licensed under a creative commons attribution 4 0 international license", 4),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
    Notice("all-rights-reserved", "all rights reserved", 1),
)
#: Bytes that stand in words: digits, letters in lower case and all beyond ASCII; others become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Span(NamedTuple):
    label: str
    first_word: int
    last_word: int
    edits: int
    size: int


def split_points(words: str, parts: int) -> list[tuple[int, str]]:
    edges = [round(len(words) * i / parts) for i in range(parts + 1)]
    return [(i, words[i:j]) for i, j in zip(edges, edges[1:])]


def slack(notice: Notice) -> int:
    """Characters a copy can begin before the best one that it overlaps, with its own edits on top."""
    return 3 * notice.edits + 1


def all_matches(first: regex.Pattern, best: regex.Pattern, text: str, low: int, high: int, size: int):
    """From left to right: where a match starts, the best one in the next ``size`` characters."""
    while low < high and (found := first.search(text, low, high)):
        at = found.start()
        found = best.search(text, at, min(high, at + size)) or found
        yield found
        low = max(found.end(), at + 1)


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] = PHRASES):
        self.notices, self.phrases = notices, phrases
        self.tree = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(notices):
            if len(notice.words) <= 2 * slack(notice) + notice.edits:
                raise ValueError(f"too many edits for a notice of this length: {notice}")
            for at, seed in split_points(notice.words, notice.edits + 1):
                seeds.setdefault(seed, []).append((n, at))
        for seed, uses in seeds.items():
            self.tree.add_word(seed, (len(seed), uses))
        self.tree.make_automaton()
        fuzzy = [rf"(?<![^ ])(?:{regex.escape(n.words)}){{e<={n.edits}}}(?![^ ])" for n in notices]
        self.first, self.match = [regex.compile(f) for f in fuzzy], [regex.compile("(?b)" + f) for f in fuzzy]

    def exact(self, joined: bytes) -> list[tuple[str, int]]:
        """(label, start word) of every place where a phrase's words stand."""
        found = []
        for phrase, label in self.phrases.items():
            need = b" " + phrase.encode() + b" "
            at = joined.find(need)
            while at >= 0:
                found.append((label, at))
                at = joined.find(need, at + 1)
        found.sort(key=lambda f: f[1])
        places, before, word = [], 0, 0
        for label, at in found:
            word += joined.count(b" ", before, at)
            before = at
            places.append((label, word))
        return places

    def fuzzy(self, text: str) -> list[Span]:
        """Notices in a normalised text (words with a space before, between and after)."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.tree.iter(text):
            for n, at in uses:
                notice = self.notices[n]
                start = end + 1 - size - at
                windows.setdefault(n, []).append((max(0, start - notice.edits - 1), min(len(text), start + len(notice.words) + notice.edits + 1)))
        spans = []
        for n, some in windows.items():
            notice, stretches = self.notices[n], []
            for low, high in sorted(some):
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = max(stretches[-1][1], high)
                else:
                    stretches.append([low, high])
            size, counted, spaces = len(notice.words) + slack(notice), 0, 0
            for low, high in stretches:
                for m in all_matches(self.first[n], self.match[n], text, low, high, size):
                    start = m.start() + (text[m.start()] == " ")
                    spaces += text.count(" ", counted, start)
                    counted = start
                    spans.append(Span(notice.label, spaces - 1, spaces - 1 + m.group().strip().count(" "), sum(m.fuzzy_counts), len(notice.words)))
        return sorted(spans, key=lambda s: (s.first_word, s.label))

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[Span]]:
        words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        if not words:
            return 0, [], []
        joined = b" " + b" ".join(words) + b" "
        return len(words), self.exact(joined), self.fuzzy(joined.decode("utf-8", "surrogatepass"))


@lru_cache(maxsize=2)
def scanner(notices: tuple[Notice, ...] = NOTICES) -> Scanner:
    return Scanner(notices)


SPANS = "array<struct<label:string,first_word:long,last_word:long,edits:int,similarity:double>>"


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, places, spans) of every row of docs(doc_id, text).

    places: the exact phrases' (label, word); spans: the notices found, with their edits and the
    similarity 1 - edits / characters.
    """
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place)), ("spans", pa.list_(span))])

    def run(batches):
        with_notices = scanner(notices)
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                n, places, spans = with_notices.scan(text)
                out.append({
                    "doc_id": doc_id, "n_words": n, "places": [{"label": x, "word": w} for x, w in places],
                    "spans": [{"label": s.label, "first_word": s.first_word, "last_word": s.last_word, "edits": s.edits, "similarity": 1 - s.edits / s.size} for s in spans],
                })
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return texts(docs).mapInArrow(run, f"doc_id long, n_words long, places array<struct<label:string,word:long>>, spans {SPANS}")


def digest(scanned: DataFrame) -> DataFrame:
    """The scan's columns per document: counts, ends, labels and a score.

    score is 1 where an exact phrase stands, else the best notice's similarity, else 0.
    """
    words, labels = F.col("places.word"), lambda c: F.array_sort(F.array_distinct(c))
    join = lambda c: F.array_join(labels(c), ",")
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        join(F.col("places.label")).alias("base_labels"), join(F.concat("places.label", "spans.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.similarity"), F.lit(0.0))).alias("score"),
    )
