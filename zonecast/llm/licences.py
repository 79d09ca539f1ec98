"""License scans: a positional index of rare template words, alignment by relative position, mandatory phrases."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.common import slices, table, texts_of

#: Fixed: phrases that label a text wherever their words stand in a row.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Template text and the phrases it must hold, by label; several templates may share one.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software",
        ("hereby granted free of charge", "without restriction"),
    ),
    ("apache", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("except in compliance with the license",),
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
        ("redistribute it and or modify it", "general public license"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
)

#: Words of each template that are looked up: the rarest of the corpus. So many must agree on where the template starts.
ANCHORS, AGREE = 6, 2
#: Words that an anchor may be off its place.
DRIFT = 2
#: Share of a template's words that must stand in their places.
COVERED = 0.7

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of ASCII letters, digits and anything beyond ASCII, A-Z in lower case."""
    return text.encode().translate(_PLAIN).split()


VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.encode().split()})


def document_counts(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and in how many of all documents each template word occurs. A row per task and word is all
    that moves; the words are a fixed few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(VOCABULARY)
        counts = {w: 0 for w in VOCABULARY} | {b"": 0}
        for batch in slices(batches, "text"):
            for text in texts_of(batch):
                counts[b""] += 1
                for w in known.intersection(words_of(text)):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    got = {r["word"].encode(): r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop(b"", 0), got


class Index:
    """Postings (template, position) of the anchors."""

    def __init__(self, documents: int, counts: dict[bytes, int]) -> None:
        self.idf = {w: math.log((1 + documents) / (1 + counts.get(w, 0))) for w in VOCABULARY}
        self.templates = [(label, text.encode().split(), [p.encode().split() for p in phrases]) for label, text, phrases in TEMPLATES]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, words, _) in enumerate(self.templates):
            anchors = sorted(set(words), key=lambda w: (-self.idf[w], w))[:ANCHORS]
            for p, w in enumerate(words):
                if w in anchors:
                    self.postings.setdefault(w, []).append((t, p))
        self.anchors = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> dict:
        """Base places, labels and score of a text's words."""
        places: list[tuple[int, int, str]] = []
        labels: set[str] = set()
        score = 0.0
        there = self.anchors.intersection(words)
        if b"license" in words:
            for i, w in enumerate(words):
                if w == b"license":
                    for phrase, label in PHRASES.items():
                        want = phrase.encode().split()
                        at = i - len(want) + 1
                        if at >= 0 and words[at : i + 1] == want:
                            places.append((at, i, label))
        base = {x[2] for x in places}
        if len(there) >= AGREE:
            votes: dict[tuple[int, int], set[bytes]] = {}
            for i, w in enumerate(words):
                if w in there:
                    for t, p in self.postings[w]:
                        votes.setdefault((t, i - p), set()).add(w)
            for (t, start), agreeing in votes.items():
                near = agreeing.union(*(votes.get((t, start + d), ()) for d in range(-DRIFT, DRIFT + 1)))
                if len(near) < AGREE:
                    continue
                label, wanted, phrases = self.templates[t]
                window = words[max(start - DRIFT, 0) : max(start + len(wanted) + DRIFT, 0)]
                first = start - max(start - DRIFT, 0)
                held = sum(w in window[max(first + p - DRIFT, 0) : first + p + DRIFT + 1] for p, w in enumerate(wanted))
                share = held / len(wanted)
                if all(holds(window, p) for p in phrases) and share >= COVERED:
                    labels.add(label)
                    score = max(score, share)
                else:
                    score = max(score, 0.5 * share)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min((x[0] for x in places), default=None),
            "last_word": max((x[0] for x in places), default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | labels)),
            "score": max(score, 0.6 if base else 0.0),
        }


def holds(words: list[bytes], phrase: list[bytes]) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i in range(len(words) - n + 1))


SCANNED = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
}


def scan_licences(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    ``base_labels`` come from ``PHRASES`` at any place; ``labels`` adds those of templates whose rare words agree on a
    start, whose words stand in their places and whose mandatory phrases are there. ``score`` is the share of the best
    template, at least 0.6 with a base label. Null texts count as empty: no words, no labels, score 0. Rows are
    independent: repeated rows and null ids give a row each, an empty table none; other columns are ignored; whole
    texts are read. A map without shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [index.scan(words_of(t)) for t in texts_of(batch)]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in SCANNED.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *SCANNED])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    schema = "doc_id long, " + ", ".join(f"{c} {kinds[k]}" for c, k in SCANNED.items())
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, schema)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licences(docs, Index(*document_counts(docs)))
