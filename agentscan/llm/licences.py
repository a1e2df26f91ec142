"""Licence scan by a positional index of rare licence words, in built-in functions only.

One pass counts, for the words of the licence templates, in how many documents each stands; that
gives their IDF over the whole corpus. A second pass keeps the places of each template's rarest words
in every document. A document is looked up by its own highest-IDF words of these: their postings in a
template are shifted by their places in it, and places that agree are the document's copy of the
template. A label needs its key phrases verified word for word. Both passes are plain projections over
the documents; only the counts are shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that give a label wherever their words stand consecutively.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Fixed values: (label, key phrases that must all stand in the document, the notice of the licence).
TEMPLATES = (
    ("mit", ("permission is hereby granted", "without restriction"), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", ("mit license",), "Released under the MIT License"),
    ("apache-2", ("licensed under the apache license",), "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-2", ("apache license version 2",), "Licensed under the Apache License, Version 2.0"),
    ("bsd", ("redistribution and use in source and binary forms",), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", ("permission to use copy modify",), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", ("without any express or implied warranty",), "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("boost", ("boost software license",), "Distributed under the Boost Software License, Version 1.0."),
    ("gpl", ("gnu general public license",), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl", ("gnu general public license",), "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", ("gnu lesser general public license",), "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", ("gnu affero general public license",), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", ("mozilla public license",), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl-2", ("eclipse public license",), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("unlicense", ("unencumbered software",), "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", ("cc0 1 0",), "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain under CC0 1.0 Universal"),
    ("cc-by", ("creative commons attribution 4",), "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", ("attribution sharealike",), "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", ("attribution noncommercial",), "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", ("cc by nc",), "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", ("cc by sa",), "Licensed under CC BY-SA 4.0."),
    ("cc-by-nd", ("attribution noderivatives",), "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("proprietary", ("all rights reserved",), "Copyright. All rights reserved."),
)
#: Rare words of a template that are indexed, those of them that a document is looked up by, its own
#: rarest, and the part of these that must agree on one place. A word is indexed however common it is.
INDEXED, RARE, ALIGNED = 16, 6, 0.6

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text in lower case.

    ``lower`` also changes letters beyond ASCII, which no licence word holds; the one such letter that
    it turns into an ASCII one, the Kelvin sign, is set aside first.
    """
    body = F.coalesce(text, F.lit(""))
    plain = F.when(F.contains(body, F.lit("\u212a")), F.translate(body, "\u212a", "\u0138")).otherwise(body)
    return F.regexp_extract_all(F.lower(plain), F.lit(_WORD), F.lit(0))


def _split(notice: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", notice.lower())


def _vocabulary() -> list[str]:
    texts = [p for p, _ in BASE] + [t for _, _, t in TEMPLATES] + [k for _, keys, _ in TEMPLATES for k in keys]
    return sorted({w for t in texts for w in _split(t)})


def rarest(words: list[str], idf: dict[str, float], df: dict[str, int]) -> list[tuple[str, list[int]]]:
    """The INDEXED rarest words of a template that the corpus has, rarest first, with their places in it."""
    own = sorted((w for w in set(words) if df.get(w, 0)), key=lambda w: (-idf[w], words.index(w)))
    return [(w, [i for i, x in enumerate(words) if x == w]) for w in own[:INDEXED]]


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and in how many each licence word stands (one row per licence word)."""
    w = docs.select(words_of(F.col(f"`{text}`")).alias("w"))
    vocabulary = F.array(*[F.lit(x) for x in _vocabulary()])
    hits = w.select(F.explode(F.array_append(F.array_intersect("w", vocabulary), F.lit(""))).alias("word"))
    df = {r["word"]: r["n"] for r in hits.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return df.pop("", 0), df


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` with n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases, first_word and last_word are their least and largest
    start (null without any). labels adds those of templates of whose rare words the document's RARE
    rarest agree, ALIGNED of them or more, on the place where the template would begin, and whose key
    phrases all stand in the text; both lists are distinct, sorted and comma-joined. score: 1 with a
    base phrase, else the best part of words that agree for a verified template, else 0.

    A null or empty text has no words, no labels and score 0. Each row is judged alone, so repeated
    rows get equal results; columns of ``docs`` with the added names are replaced.
    """
    total, df = document_frequencies(docs, text)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in _vocabulary()}
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]

    def anchor(ws: list[str]) -> int:
        return max(range(len(ws)), key=lambda i: (idf[ws[i]], -i))

    keys = sorted({k for _, ks, _ in TEMPLATES for k in ks})
    phrases = {p: p.split() for p in [p for p, _ in BASE] + keys}
    indexed_words = [rarest(_split(t), idf, df) for _, _, t in TEMPLATES]
    anchors = sorted({ws[anchor(ws)] for ws in phrases.values()} | {w for ws in indexed_words for w, _ in ws})

    worded = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row__"), words_of(F.col(f"`{text}`")).alias("w"))
    listed = F.array(*[F.lit(a) for a in anchors])
    postings = F.when(
        F.arrays_overlap("w", listed),
        F.filter(F.transform("w", lambda w, i: F.when(w.isin(anchors), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull()),
    )
    indexed = worded.select("__row__", "w", F.size("w").cast("long").alias("n_words"), postings.alias("places")).withColumn("present", F.array_distinct(F.transform("places", lambda p: p["word"])))

    def starts(ws: list[str]) -> Column:
        """Starts of places where the words stand consecutively: the anchor's postings, verified."""
        o = anchor(ws)
        return F.transform(
            F.filter("places", lambda p: (p["word"] == ws[o]) & (p["at"] >= o) & (F.slice("w", F.greatest(p["at"] - o, F.lit(0)) + 1, F.lit(len(ws))) == F.array(*[F.lit(x) for x in ws]))),
            lambda p: (p["at"] - o).cast("long"),
        )

    def most_equal(at: Column, most: int) -> Column:
        """How often the commonest number stands in a sorted list, ``most`` at most."""
        runs = [F.when(F.exists(F.zip_with(at, F.slice(at, F.lit(k), F.size(at)), lambda a, b: a == b), lambda x: x), F.lit(k)) for k in range(2, most + 1)]
        return F.coalesce(*runs[::-1], F.when(F.size(at) > 0, F.lit(1)), F.lit(0))

    def aligned(words: list[tuple[str, list[int]]]) -> Column:
        """The largest part of the document's rarest words of a template that agree on its place."""
        if not words:
            return F.lit(0.0)
        listed = F.array(*[F.struct(F.lit(w).alias("word"), F.array(*[F.lit(i) for i in at]).alias("at")) for w, at in words])
        own = F.slice(F.filter(listed, lambda x: F.array_contains("present", x["word"])), 1, RARE)
        most = min(RARE, len(words))
        begins = F.flatten(F.transform(own, lambda x: F.flatten(F.transform(x["at"], lambda i: F.transform(F.filter("places", lambda p: p["word"] == x["word"]), lambda p: p["at"] - i)))))
        enough = F.size(F.array_intersect("present", F.array(*[F.lit(w) for w, _ in words]))) >= math.ceil(ALIGNED * most)
        # the lambda's variable holds the list, which would otherwise be made anew for each comparison
        return F.when(enough, F.transform(F.array(F.array_sort(begins)), lambda at: most_equal(at, most))[0] / float(most)).otherwise(0.0)

    some = F.col("places").isNotNull()
    none = F.array().cast("array<long>")
    found = indexed.select(
        "__row__",
        "n_words",
        *[F.when(some, starts(p.split())).otherwise(none).alias(f"b{i}") for i, (p, _) in enumerate(BASE)],
        *[F.when(some, F.size(starts(phrases[k])) > 0).otherwise(False).alias(f"k{i}") for i, k in enumerate(keys)],
        *[F.when(some, F.coalesce(aligned(ws), F.lit(0.0))).otherwise(0.0).alias(f"t{i}") for i, ws in enumerate(indexed_words)],
    )
    base = [(F.size(f"b{i}") > 0, label) for i, (_, label) in enumerate(BASE)]
    fits = []
    for i, (label, ks, _) in enumerate(TEMPLATES):
        key = F.lit(True)
        for k in ks:
            key = key & F.col(f"k{keys.index(k)}")
        fits.append((key & (F.col(f"t{i}") >= ALIGNED), label, F.col(f"t{i}")))

    def joined(xs: list[tuple[Column, str]]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(x)) for c, x in xs]), lambda x: x.isNotNull()))), ",")

    places = F.concat(*[f"b{i}" for i in range(len(BASE))])
    out = {
        "n_base": F.size(places).cast("long"),
        "first_word": F.array_min(places),
        "last_word": F.array_max(places),
        "base_labels": joined(base),
        "labels": joined(base + [(c, x) for c, x, _ in fits]),
        "score": F.greatest(*[F.when(c, 1.0).otherwise(0.0) for c, _ in base], *[F.when(c, s).otherwise(0.0) for c, _, s in fits]),
    }
    return found.select("__row__.*", "n_words", *[c.alias(n) for n, c in out.items()])
