"""Licence scans: a positional index of the rare words of licence notices.

Templates are licence notices with mandatory key phrases. A first pass counts, over all
documents, in how many each licence word (a word of any template) occurs. The scan then, per
document and template, looks up the words that are rarest in the corpus (highest IDF): the two
rarest words of every key phrase, and the ``RARE`` rarest others of the template that the
document holds. Each place p of such a word and each posting q of it in the template vote for
the alignment p - q; alignments with two votes are candidates. A candidate is verified: every key
phrase must stand, word by word, within ``SLACK`` words of where the template has it, and
``MIN_COVER`` of the template's words must stand within ``SLACK`` words of their place. A phrase
that stands in a document always brings its own two votes, so the lookup loses no verified notice.

Base phrases are found wherever their words stand consecutively. Words are runs of letters,
digits and characters beyond ASCII, A-Z lower-cased. Texts are cut into words once per pass, a
block of texts at a time, without a Python object per word; nothing of the texts is shuffled.
Broadcast is the index alone: its size is that of the templates, which the caller gives, and at
most ``MAX_INDEX_WORDS`` words (more raise).

``score``: the greatest cover of a verified notice; at least 0.5 with a base phrase, else 0.

Defined results: null counts as empty, and an empty text has no words, no places and score 0;
a text of any length is one piece; repeated rows and ids are scanned each (and count each
in the IDF); words equally rare go in alphabetical order, and of equal covers the smaller
alignment is given; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.chunks import blocks
from proofline.llm.common import whole_text

RARE, SLACK, MIN_COVER = 4, 8, 0.6
MAX_INDEX_WORDS = 100_000
BASE_ONLY = 0.5
_REACH = 1 << 24  # alignments of a template before the first word of a text


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


# Base phrase -> label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices in their public wording.
TEMPLATES = (
    Template("reserved", "All rights reserved.", ("all rights reserved",)),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.",
             ("gnu general public license",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of "
             "the GNU General Public License as published by the Free Software Foundation",
             ("free software", "gnu general public license")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software "
             "Foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software "
             "Foundation", ("gnu affero general public license",)),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license version",)),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of "
             "the License at http://www.apache.org/licenses/LICENSE-2.0",
             ("in compliance with the license", "www apache org licenses")),
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
             "and associated documentation files, to deal in the Software without restriction",
             ("permission is hereby granted free of charge", "without restriction")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "conditions are met")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
             "without fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
             ("mozilla public license",)),
    Template("cc-by", "Licensed under CC BY 4.0.", ("licensed under cc by",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0.", ("cc by nd",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
             ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
             "License", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
             "License", ("creative commons attribution noncommercial",)),
    Template("cc0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.",
             ("free and unencumbered software",)),
)

# Byte -> itself if part of a word (A-Z lower-cased), else 0.
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58], _FOLD[97:123], _FOLD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_FOLD[65:91] = np.arange(97, 123)


def words_of(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts one after the other, the number of words of each text)."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data if data is not None else b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    low = _FOLD[raw]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = at[:-1][at[:-1] < len(raw)]
    begins[borders] |= inside[borders]  # a text does not go on in the next
    starts = np.flatnonzero(begins)
    before = np.concatenate(([0], np.cumsum(inside)))
    offsets = np.concatenate((before[starts], before[-1:])).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()),
                                        pa.py_buffer(low[inside].tobytes()))
    n = np.diff(np.searchsorted(starts, at, side="left"))
    return words, n


@dataclass
class Index:
    """Templates and phrases over one vocabulary of licence words."""
    templates: tuple[Template, ...] = TEMPLATES
    base: dict[str, str] = field(default_factory=lambda: dict(BASE))

    def __post_init__(self):
        self.base = {" ".join(words_of(k)): v for k, v in self.base.items()}
        texts = [words_of(t.text) for t in self.templates]
        phrases = sorted({" ".join(words_of(p)) for t in self.templates for p in t.phrases} | set(self.base))
        self.vocabulary = sorted({w for t in texts for w in t} | {w for p in phrases for w in p.split()})
        if len(self.vocabulary) > MAX_INDEX_WORDS:
            raise ValueError(f"{len(self.vocabulary)} licence words; {MAX_INDEX_WORDS} at most")
        self.code = {w: i for i, w in enumerate(self.vocabulary)}
        self.words = [np.array([self.code[w] for w in t], np.int64) for t in texts]
        self.phrases = {p: np.array([self.code[w] for w in p.split()], np.int64) for p in phrases}
        self.keys = []  # per template: (phrase, its place in the template)
        for t, text in zip(self.templates, texts, strict=True):
            keys = []
            if not t.phrases:
                raise ValueError(f"a template of {t.label!r} has no key phrase")
            for p in t.phrases:
                w = words_of(p)
                where = [i for i in range(len(text) - len(w) + 1) if text[i:i + len(w)] == w]
                if not where or len(set(w)) < 2:
                    raise ValueError(f"key phrase {p!r} needs two words and a place in its template")
                keys.append((" ".join(w), where[0]))
            self.keys.append(keys)
        self.lookup = pa.array(self.vocabulary, pa.string())

    def coded(self, words: pa.Array) -> np.ndarray:
        return pc.index_in(words, value_set=self.lookup).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def ranked(self, df: np.ndarray) -> None:
        """Set the order of the words by document frequency: rarest first, ties alphabetical."""
        self.rank = np.empty(len(df), np.int64)
        self.rank[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))
        self.sure, self.others = [], []
        for t, keys in zip(self.words, self.keys, strict=True):
            sure = {int(w) for p, _ in keys for w in sorted(set(self.phrases[p].tolist()), key=self.rank.__getitem__)[:2]}
            self.sure.append(sorted(sure))
            self.others.append(sorted(set(t.tolist()) - sure, key=self.rank.__getitem__))


def document_frequency(docs: DataFrame, index: Index, text_col: str = "text") -> np.ndarray:
    """In how many documents each licence word occurs: one row per word and task is shuffled,
    one per word reaches the driver."""
    def run(batches):
        df = np.zeros(len(index.vocabulary), np.int64)
        for batch in batches:
            for b in blocks(batch, 0):
                words, n = cut(b.column(0))
                code = index.coded(words)
                doc = np.repeat(np.arange(len(n)), n)[code >= 0]
                seen = np.unique(doc * len(df) + code[code >= 0])
                df += np.bincount(seen % len(df), minlength=len(df))
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(df[hit], pa.int64())], names=["w", "n"])
    rows = docs.select(whole_text(text_col).alias("t")).mapInArrow(run, "w long, n long")
    out = np.zeros(len(index.vocabulary), np.int64)
    for w, n in rows.groupBy("w").agg(F.sum("n")).collect():
        out[w] = n
    return out


def phrase_places(code: np.ndarray, doc: np.ndarray, phrase: np.ndarray, rank: np.ndarray, by_word) -> np.ndarray:
    """Starts of a phrase, from the places of its rarest word."""
    r = int(np.argmin(rank[phrase]))
    at = by_word(int(phrase[r])) - r
    at = at[(at >= 0) & (at + len(phrase) <= len(code))]
    for i, w in enumerate(phrase):
        at = at[code[at + i] == w]
    return at[doc[at] == doc[at + len(phrase) - 1]]


def scan_block(texts: pa.Array, index: Index) -> dict[str, list]:
    words, n = cut(texts)
    code = index.coded(words)
    ends = np.cumsum(n)
    first = ends - n
    doc = np.repeat(np.arange(len(n)), n)
    hits = np.flatnonzero(code >= 0)
    hits = hits[np.argsort(code[hits], kind="stable")]
    border = np.searchsorted(code[hits], np.arange(len(index.vocabulary) + 1))

    def by_word(w):
        return hits[border[w]:border[w + 1]]
    places = {p: phrase_places(code, doc, c, index.rank, by_word) for p, c in index.phrases.items()}
    rows = len(n)
    n_base, low, high = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    base = [set() for _ in range(rows)]
    for p, label in index.base.items():
        at = places[p]
        n_base += np.bincount(doc[at], minlength=rows)
        np.minimum.at(low, doc[at], at - first[doc[at]])
        np.maximum.at(high, doc[at], at - first[doc[at]])
        for d in np.unique(doc[at]):
            base[d].add(label)
    found: list[dict] = [{} for _ in range(rows)]
    for t, (template, keys) in enumerate(zip(index.words, index.keys, strict=True)):
        for d, key_at, cover in notices(index, t, template, keys, code, doc, first, ends, by_word, places):
            k = (index.templates[t].label, key_at)
            found[d][k] = max(found[d].get(k, 0.0), cover)
    out = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")}
    for d in range(rows):
        labels = base[d] | {k[0] for k in found[d]}
        some = n_base[d] > 0
        out["n_words"].append(int(n[d]))
        out["n_base"].append(int(n_base[d]))
        out["first_word"].append(int(low[d]) if some else None)
        out["last_word"].append(int(high[d]) if some else None)
        out["base_labels"].append(",".join(sorted(base[d])))
        out["labels"].append(",".join(sorted(labels)))
        out["score"].append(max([BASE_ONLY if some else 0.0, *found[d].values()]))
        out["notices"].append([{"label": k[0], "word": k[1], "cover": v} for k, v in sorted(found[d].items())])
    return out


def notices(index, t, template, keys, code, doc, first, ends, by_word, places):
    """(document, place of the first key phrase in it, cover) of each verified notice."""
    rows = len(first)
    chosen, taken = [(w, None) for w in index.sure[t]], np.zeros(rows, np.int64)
    for w in index.others[t]:  # rarest first: each document takes the first RARE that it holds
        held = np.zeros(rows, bool)
        held[doc[by_word(w)]] = True
        chosen.append((w, held & (taken < RARE)))
        taken += held
    votes = []
    for w, of in chosen:
        at = by_word(w)
        at = at if of is None else at[of[doc[at]]]
        for q in np.flatnonzero(template == w):
            votes.append(doc[at] * (_REACH << 8) + (at - first[doc[at]] - q + _REACH))
    shift, n = np.unique(np.concatenate(votes), return_counts=True)
    shift = shift[n >= 2]
    d, s = shift // (_REACH << 8), shift % (_REACH << 8) - _REACH
    origin = first[d] + s
    key_at = None
    for p, q in keys:
        where = places[p]
        i = np.searchsorted(where, np.maximum(origin + q - SLACK, first[d]))
        at = where[np.minimum(i, len(where) - 1)] if len(where) else np.zeros(len(d), np.int64)
        ok = (i < len(where)) & (at <= origin + q + SLACK) & (at < ends[d])
        key_at = at if key_at is None else key_at
        d, origin, key_at = d[ok], origin[ok], key_at[ok]
    for a in range(0, len(d), 4096):
        own, key = d[a:a + 4096], key_at[a:a + 4096]
        cover = covers(code, template, origin[a:a + 4096], first[own], ends[own])
        for i in np.flatnonzero(cover >= MIN_COVER):
            yield int(own[i]), int(key[i] - first[own[i]]), float(cover[i])


def covers(code, template, origin, first, ends) -> np.ndarray:
    """Share of the template's words that stand within SLACK words of their place."""
    met = np.zeros((len(origin), len(template)), bool)
    for shift in range(-SLACK, SLACK + 1):
        g = origin[:, None] + np.arange(len(template)) + shift
        inside = (g >= first[:, None]) & (g < ends[:, None])
        met |= inside & (code[np.where(inside, g, 0)] == template)
    return met.mean(1)


SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, notices array<struct<label: string, word: long, cover: double>>")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, notices (label, word at which its first key phrase starts, cover)."""
    index = Index(templates, dict(BASE if base is None else base))
    index.ranked(document_frequency(docs, index, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
             "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
             "notices": pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("cover", pa.float64())]))}

    def run(batches):
        for batch in batches:
            for b in blocks(batch, 1):
                out = scan_block(b.column(1), index)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(out[c], t) for c, t in types.items())], names=[id_col, *types])
    src = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return src.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
