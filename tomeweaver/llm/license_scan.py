"""Licence scan by a positional rare-token index.

Every template (a base phrase or the opening of a licence notice) is a word
sequence, and the index holds the postings of its words with their inverse
document frequency over all scanned documents.  Of the documents that hold the
rarest word of a template's key phrase, the rarest words that they share with the
template are looked up, and the words of its key phrases; a posting at template position q met at document
position p votes for the alignment p - q; alignments on which enough postings
agree are kept if the template's mandatory key phrases stand there.  Base
phrases are their own key phrase, so their places are exact.

Nulls: a null text is empty, a null doc_id stays null.  Empty texts, texts
without licence words and very long texts give plain rows; repeated rows each
get a row; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

#: Phrases whose places count as base, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, notice words, key phrases that must stand in it.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]

#: Rare words of a document that are looked up in a template, and how many postings must agree on an alignment.
ANCHORS, AGREE = 4, 2


def templates() -> list[tuple[str, list[str], list[list[str]], bool]]:
    base = [(label, words.split(), [words.split()], True) for words, label in BASE.items()]
    return base + [(label, words.split(), [k.split() for k in keys], False) for label, words, keys in TEMPLATES]


VOCABULARY = sorted({w for _, ws, ks, _ in templates() for w in (*ws, *(x for k in ks for x in k))})


def _ids() -> tuple[np.ndarray, np.ndarray]:
    h = np.array([tb.hash_of(w) for w in VOCABULARY], np.uint64)
    order = np.argsort(h)
    return h[order], order


def _word_ids(data: np.ndarray, off: np.ndarray, table: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, first = tb.words(data, off, tb.ALNUM)
    at = tb.lookup(table, h)
    return np.where(at < 0, -1, order[at]), first


def document_frequencies(docs: DataFrame) -> tuple[dict[int, int], int]:
    """For each word of the licence vocabulary the documents that hold it, over all rows; and the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, order = _ids()
        df, n = np.zeros(len(order), np.int64), 0
        for b in batches:
            for i, j, data, off in tb.slices(b.column(0)):
                wid, first = _word_ids(data, off, table, order)
                at = np.flatnonzero(wid >= 0)
                doc = np.searchsorted(first, at, "right") - 1
                df += np.bincount(np.unique(doc * len(order) + wid[at]) % len(order), minlength=len(order))
                n += j - i
        yield pa.RecordBatch.from_pydict({"w": pa.array([-1, *range(len(order))], pa.int32()), "n": pa.array([n, *df], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # as many rows as licence words
    found = {r.w: r.n for r in rows}
    return found, found.get(-1, 0)


def build_index(df: dict[int, int], n: int) -> list[dict]:
    """Each template with its rarest words' postings, and the votes that an alignment needs."""
    at = {w: i for i, w in enumerate(VOCABULARY)}
    idf = lambda w: math.log((n + 1) / (df.get(at[w], 0) + 1))
    out = []
    for label, ws, keys, exact in templates():
        rare = sorted(set(ws), key=lambda w: (-idf(w), w))
        key = min(keys[0], key=lambda w: (-idf(w), w))
        postings = [(at[w], q, rare.index(w)) for q, w in enumerate(ws) if not exact or w == key]
        out.append({"label": label, "words": [at[w] for w in ws], "keys": [[at[w] for w in k] for k in keys], "key": at[key], "key_ranks": sorted({rare.index(w) for k in keys for w in k if w in rare}), "exact": exact, "postings": postings, "votes": 1 if exact else AGREE, "idf": [idf(w) for w in ws]})
    return out


def _stand(wid: np.ndarray, at: np.ndarray, doc_end: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Whether the phrase's words stand consecutively from each place, before the document's end."""
    ok = (at >= 0) & (at + len(phrase) <= doc_end)
    for k, w in enumerate(phrase):
        ok &= wid[np.clip(at + k, 0, len(wid) - 1)] == w
    return ok


def scan_slice(data: np.ndarray, off: np.ndarray, index: list[dict], table: np.ndarray, order: np.ndarray) -> dict[str, list]:
    wid, first = _word_ids(data, off, table, order)
    n = len(off) - 1
    out = {"n_words": np.diff(first), "n_base": np.zeros(n, np.int64), "first": [None] * n, "last": [None] * n, "base": [set() for _ in range(n)], "labels": [set() for _ in range(n)], "score": np.zeros(n)}
    hits = np.flatnonzero(wid >= 0)
    if not len(hits):
        return out
    by_word = {w: hits[wid[hits] == w] for w in np.unique(wid[hits])}
    none = np.zeros(0, np.int64)
    for t in index:
        if t["key"] not in by_word:
            continue
        holders = np.unique(np.searchsorted(first, by_word[t["key"]], "right") - 1)
        # an alignment may begin before the text (a notice cut at its head), so a vote carries its document
        doc, at, rank = [], [], []
        for w, q, r in t["postings"]:
            p = by_word.get(w, none)
            d = np.searchsorted(first, p, "right") - 1
            own = np.isin(d, holders)
            doc.append(d[own])
            at.append(p[own] - q)
            rank.append(np.full(int(own.sum()), r))
        doc, at, rank = np.concatenate(doc), np.concatenate(at), np.concatenate(rank)
        if not t["exact"]:  # of each document, its rarest words, and those of the key phrases wherever they stand
            some = np.unique(np.stack([doc, rank]), axis=1)
            nth = np.arange(some.shape[1]) - np.searchsorted(some[0], some[0])
            some = some[:, nth < ANCHORS]
            use = np.isin(doc * len(VOCABULARY) + rank, some[0] * len(VOCABULARY) + some[1]) | np.isin(rank, t["key_ranks"])
            doc, at = doc[use], at[use]
        pairs, counts = np.unique(np.stack([doc, at]), axis=1, return_counts=True)
        doc, at = pairs[:, counts >= t["votes"]]
        if not len(at):
            continue
        lo, hi = first[doc], first[doc + 1]
        ok = np.ones(len(at), bool)
        for key in t["keys"]:
            q = next((i for i in range(len(t["words"])) if t["words"][i : i + len(key)] == key), 0)
            here = np.zeros(len(at), bool)
            for shift in (0,) if t["exact"] else range(-3, 4):
                here |= _stand(wid, at + q + shift, hi, key) & (at + q + shift >= lo)
            ok &= here
        doc, at, lo, hi = doc[ok], at[ok], lo[ok], hi[ok]
        if not len(at):
            continue
        total, share = sum(t["idf"]) or 1.0, np.zeros(len(at))
        for q, (w, x) in enumerate(zip(t["words"], t["idf"], strict=True)):
            p = at + q
            share += np.where((p >= lo) & (p < hi) & (wid[np.clip(p, 0, len(wid) - 1)] == w), x, 0.0)
        share = np.clip(share / total, 0, 1) if sum(t["idf"]) else np.ones(len(at))
        for d, a, s in zip(doc.tolist(), (at - lo).tolist(), share.tolist(), strict=True):
            out["labels"][d].add(t["label"])
            out["score"][d] = max(out["score"][d], s)
            if t["exact"]:
                out["base"][d].add(t["label"])
                out["n_base"][d] += 1
                out["first"][d] = a if out["first"][d] is None else min(a, out["first"][d])
                out["last"][d] = a if out["last"][d] is None else max(a, out["last"][d])
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> one row per document: counts, places, labels and the best template's matched share of IDF."""
    index = build_index(*document_frequencies(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, order = _ids()
        for b in batches:
            for i, j, data, off in tb.slices(b.column(1)):
                r = scan_slice(data, off, index, table, order)
                join = lambda x: pa.array([",".join(sorted(s)) for s in x], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(r["n_words"], pa.int64()), pa.array(r["n_base"], pa.int64()), pa.array(r["first"], pa.int64()), pa.array(r["last"], pa.int64()), join(r["base"]), join(r["labels"]), pa.array(r["score"], pa.float64())], SCHEMA_NAMES)

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
