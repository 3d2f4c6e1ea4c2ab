"""License scan with a positional rare-token index.

Templates are licence texts, whole ones and the short notices that stand in
their place; others can be passed.  Template postings hold only each template's
rarest words (highest inverse document frequency, counted over the whole corpus).  A text's words are
looked up in them; the hits of one template are intersected by relative
position (place in the text minus place in the template), and where enough
rare words agree the template's mandatory key phrases must stand at their
places.  Beside the templates, base phrases are found wherever their words
stand consecutively.

A null text counts as empty; empty texts have no words, no labels and score
0.  Repeated rows are judged each; a template that matches at several places
gives each; words equally rare are posted in order of name.  Other columns pass
no further, whatever their names.  Texts are read whole; memory is one text's
words.  An empty table gives none.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engram.llm._common import prepare

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of the licences and notices, and the phrases that must stand in them.
MIT_TEXT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to use copy
modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished
to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not
limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or
copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from
out of or in connection with the software or the use or other dealings in the software"""
ISC_TEXT = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author
disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall
the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data
or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
performance of this software"""
BSD_TEXT = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the
following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the
following disclaimer in the documentation and or other materials provided with the distribution"""
APACHE_NOTICE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to
in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either
express or implied see the license for the specific language governing permissions and limitations under the license"""
GPL_NOTICE = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
as published by the free software foundation either version {} of the license or at your option any later version this program is
distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness
for a particular purpose see the gnu general public license for more details"""
MPL_NOTICE = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
distributed with this file you can obtain one at http mozilla org mpl 2 0"""
UNLICENSE_TEXT = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
commercial and by any means"""
TEMPLATES = {
    "mit": [
        (MIT_TEXT, ["permission is hereby granted free of charge", "provided as is without warranty of any kind"]),
        ("released under the mit license", ["mit license"]),
        ("licensed under the mit license", ["mit license"]),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "copy of this software"]),
    ],
    "isc": [(ISC_TEXT, ["for any purpose with or without fee is hereby granted"])],
    "apache-2": [
        (APACHE_NOTICE, ["apache license", "version 2", "without warranties or conditions"]),
        ("licensed under the apache license version 2 0", ["apache license", "version 2"]),
        ("you may not use this file except in compliance with the license", ["except in compliance with the license"]),
    ],
    "gpl-3": [
        (GPL_NOTICE.format(3), ["gnu general public license", "version 3"]),
        ("this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
        ("gnu general public license as published by the free software foundation either version 3", ["gnu general public license", "version 3"]),
    ],
    "gpl-2": [
        (GPL_NOTICE.format(2), ["gnu general public license", "version 2"]),
        ("gnu general public license as published by the free software foundation either version 2", ["gnu general public license", "version 2"]),
    ],
    "bsd": [
        (BSD_TEXT, ["redistribution and use", "redistributions of source code must retain"]),
        ("redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "are permitted"]),
    ],
    "mpl-2": [(MPL_NOTICE, ["mozilla public license", "copy of the mpl"]), ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license"])],
    "unlicense": [(UNLICENSE_TEXT, ["free and unencumbered software", "into the public domain"])],
    "cc-by-nc": [("licensed under cc by nc 4 0", ["cc by nc"])],
    "cc-by-sa": [("licensed under cc by sa 4 0", ["cc by sa"])],
    "cc-by": [("licensed under cc by 4 0", ["cc by 4"])],
}

#: Words that are neither A-Z nor digits nor beyond ASCII separate.
_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Rare words of a template that are posted, and the share of its words that must match.
RARE, AGREE = 3, 0.75


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return (text or "").encode().translate(_KEEP).split()


def read_templates(templates: dict[str, list[tuple[str, list[str]]]]) -> list[tuple[str, list[bytes], list[tuple[int, list[bytes]]]]]:
    """(label, words, [(place, phrase)]) of each template."""
    out = []
    for label, texts in templates.items():
        for text, phrases in texts:
            words = words_of(text)
            keys = []
            for phrase in (words_of(p) for p in phrases):
                at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
                keys.append((at, phrase))
            out.append((label, words, keys))
    return out


def document_frequencies(docs: DataFrame, text_col: str, templates: list) -> tuple[int, dict[bytes, int]]:
    """Rows, and rows that hold each template word, over the whole corpus.

    The result is as large as the templates' vocabulary, whatever the corpus.
    """
    vocabulary = {w for _, words, _ in templates for w in words}

    def count(batches):
        rows, held = 0, dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column(0):
                rows += 1
                for w in vocabulary.intersection(words_of(text.as_py())):
                    held[w] += 1
        yield pa.RecordBatch.from_pydict({"word": ["", *(w.decode() for w in held)], "held": [rows, *held.values()]})

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, held long")
    sums = {r["word"]: r["held"] for r in counted.groupBy("word").agg(F.sum("held").alias("held")).collect()}
    return sums.pop("", 0), {w.encode(): n for w, n in sums.items()}


def build_index(rows: int, held: dict[bytes, int], templates: list) -> dict[bytes, list[tuple[int, int]]]:
    """word -> [(template, place)], posting each template's rarest words."""
    index: dict[bytes, list[tuple[int, int]]] = {}
    for t, (_, words, _) in enumerate(templates):
        idf = {w: math.log((1 + rows) / (1 + held.get(w, 0))) for w in words}
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:RARE]
        for place, w in enumerate(words):
            if w in rare:
                index.setdefault(w, []).append((t, place))
    return index


def scan_text(words: list[bytes], index: dict[bytes, list[tuple[int, int]]], templates: list) -> dict:
    """Base places and template matches of one text."""
    base, labels, n_base, first, last, score = set(), set(), 0, None, None, 0.0
    hits = [i for i, w in enumerate(words) if w in index or w in _BASE_LAST]
    votes: dict[tuple[int, int], int] = {}
    for i in hits:
        for phrase, label in _BASE_LAST.get(words[i], ()):
            at = i - len(phrase) + 1
            if at >= 0 and words[at : i + 1] == phrase:
                n_base += 1
                base.add(label)
                first, last = at if first is None else min(first, at), at if last is None else max(last, at)
        for t, place in index.get(words[i], ()):
            votes[t, i - place] = votes.get((t, i - place), 0) + 1
    matches = []
    for (t, at), n in votes.items():
        label, wording, keys = templates[t]
        if n < min(RARE, len(set(wording))) - 1 or at < 0:
            continue
        if not all(words[at + p : at + p + len(k)] == k for p, k in keys):
            continue
        share = sum(a == b for a, b in zip(wording, words[at : at + len(wording)])) / len(wording)
        if share >= AGREE:
            labels.add(label)
            matches.append((label, at, share))
            score = max(score, share)
    if n_base:
        score = 1.0
    return {
        "n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": score,
        "matches": [{"label": a, "start": b, "share": c} for a, b, c in sorted(matches, key=lambda m: (m[1], m[0]))],
    }


_BASE_LAST: dict[bytes, list[tuple[list[bytes], str]]] = {}
for _phrase, _label in BASE.items():
    _BASE_LAST.setdefault(_phrase.encode().split()[-1], []).append((_phrase.encode().split(), _label))

_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[tuple[str, list[str]]]] = TEMPLATES) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels,
    score, matches) for every row; matches lists (label, start, share)."""
    prepare(docs.sparkSession)
    known = read_templates(templates)
    index = build_index(*document_frequencies(docs, text_col, known), known)

    def run(batches):
        for batch in batches:
            found = [scan_text(words_of(t.as_py()), index, known) for t in batch.column(1)]
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": _SPAN}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[c] for f in found], k) for c, k in kinds.items())], [id_col, *kinds]
            )

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        run,
        f"`{id_col}` long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, matches array<struct<label string, start long, share double>>",
    )
