"""License scan by a positional rare-token index, in DataFrame functions only.

1. Templates are short standard notices of public licenses, cut into words
   like the texts.  One pass counts, over all documents, in how many each
   template word occurs (at most as many rows as the templates have words).
2. Per template its ``RARE`` words of highest inverse document frequency (the
   fewest documents, then by spelling) enter the index with all their
   positions in the template.
3. A document looks its words up in the index.  A hit at position i of a
   posting at position p votes for the template standing at i - p; postings
   that agree on this relative position are intersected by counting them.
4. A placement with votes of at least half of the template's rare positions
   is verified: the template's mandatory phrases must stand in the document.
   Its label is then added, and its score is the share of the template's words
   that stand at their places.

Base: each place where a base phrase's words stand consecutively.  ``score``
is the best verified placement's share, 0.5 for a base phrase alone, else 0.

Definitions.  Null and empty texts have no words, labels or places.  Words are
runs of digits, letters and characters beyond ASCII, A-Z lower-cased.  Repeated
rows are rows of their own; nothing is joined by id, so ids may be null or
repeat, and other columns are not read.  Words equally rare are taken by
spelling.  The work per row is linear in its words and index hits, and no row
meets another one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE = 8

# The phrases of the contract, and standard notices of public licenses.
BASE_PHRASES: list[tuple[str, str]] = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

#: (label, notice, phrases that must stand in the text)
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("mit", "Released under the MIT License", ["the mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge", "without restriction"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0", ["in compliance with the license", "apache org licenses license 2 0"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
     ["gnu lesser general public license"]),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ["with or without fee is hereby granted"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ["cc by nc sa 4 0"]),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
     ["waived all copyright and related or neighboring rights"]),
]


def words_of(text: str) -> list[str]:
    """The words of a template (on the driver)."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def words(text_col: str) -> Column:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _literal(nested: list) -> Column:
    return F.array(*[_literal(x) if isinstance(x, list) else F.lit(x) for x in nested])


# ---- the index ---------------------------------------------------------------------------

def template_frequencies(documents: DataFrame, text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(word, df): in how many documents each template word occurs."""
    wanted = sorted({w for _, notice, _ in templates for w in words_of(notice)})
    found = documents.select(words(text_col).alias("w")).select(
        F.explode(F.array_distinct(F.filter("w", lambda w: w.isin(wanted)))).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def rare_postings(frequencies: dict[str, int], templates=TEMPLATES, rare: int = RARE) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings (template, position) by index word, and the votes each
    template needs.  Bounded by the templates, whatever the corpus holds."""
    postings: dict[str, list[tuple[int, int]]] = {}
    needed = []
    for t, (_, notice, _) in enumerate(templates):
        listed = words_of(notice)
        chosen = sorted(set(listed), key=lambda w: (frequencies.get(w, 0), w))[:rare]
        places = [(w, p) for p, w in enumerate(listed) if w in chosen]
        for w, p in places:
            postings.setdefault(w, []).append((t, p))
        needed.append(max(2, math.ceil(len(places) / 2)))
    return postings, needed


# ---- per document --------------------------------------------------------------------------

_ROOM = 1 << 20  # more than any template has words
_SPAN = 1 << 40  # more than any document has words


def _placements(postings: dict[str, list[tuple[int, int]]], needed: list[int]) -> Column:
    """Distinct codes template * _SPAN + _ROOM + place with enough votes, from
    the column ``w``."""
    index = sorted(postings)
    lists = F.array(*[F.array(*[F.lit(t * _SPAN + _ROOM - p).cast("long") for t, p in postings[w]]) for w in index])
    at = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(index))
    votes = F.flatten(F.transform(at, lambda x: F.transform(
        F.get(lists, F.array_position(_literal(index), x["w"]).cast("int") - 1), lambda code: code + x["i"])))
    need = _literal(needed)

    def enough(votes: Column) -> Column:
        template = lambda x: F.floor(x / F.lit(_SPAN)).cast("int")
        return F.array_distinct(F.filter(votes, lambda x, i: F.get(votes, i + F.get(need, template(x)) - 1) == x))

    # the one-element array binds the sorted votes, so that they are made once
    return F.transform(F.array(F.array_sort(votes)), enough)[0]


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base_phrases=BASE_PHRASES, rare: int = RARE) -> DataFrame:
    """(id, n_words, base array<struct<place, label>>, found
    array<struct<label, place, share>>, score) per row of ``documents``."""
    frequencies = {r["word"]: r["df"] for r in template_frequencies(documents, text_col, templates).collect()}
    postings, needed = rare_postings(frequencies, templates, rare)
    phrases = [(words_of(p), label) for p, label in base_phrases]
    rows = documents.select(F.col(id_col).cast("long").alias("id"), words(text_col).alias("w"))

    def stands(phrase: list[str], i: Column) -> Column:
        out = F.lit(True)
        for k, word in enumerate(phrase[1:], 1):
            out = out & F.coalesce(F.get("w", i + k) == word, F.lit(False))
        return out

    def base_label(w: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in phrases:
            out = F.when((w == phrase[0]) & stands(phrase, i), F.lit(label)).otherwise(out)
        return F.struct(i.cast("long").alias("place"), out.alias("label"))

    starts = sorted({p[0] for p, _ in phrases})
    at = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(starts))
    base = F.filter(F.transform(at, lambda x: base_label(x["w"], x["i"])), lambda x: x["label"].isNotNull())
    placed = rows.select(
        "id", F.size("w").cast("long").alias("n_words"), base.alias("base"), _placements(postings, needed).alias("codes"), "w")

    labels = _literal([label for label, _, _ in templates])
    listed = _literal([words_of(notice) for _, notice, _ in templates])
    musts = _literal([[f" {p} " for p in must] for _, _, must in templates])

    def verified(joined: Column) -> Column:
        def judge(code: Column) -> Column:
            t = F.floor(code / F.lit(_SPAN)).cast("int")
            place = (code - t.cast("long") * F.lit(_SPAN) - F.lit(_ROOM)).cast("int")
            notice = F.get(listed, t)
            in_place = F.size(F.filter(notice, lambda word, k: F.when(place + k >= 0, F.get("w", F.greatest(place + k, F.lit(0))) == word).otherwise(F.lit(False))))
            return F.struct(
                F.get(labels, t).alias("label"), place.cast("long").alias("place"), (in_place / F.size(notice)).alias("share"),
                F.forall(F.get(musts, t), lambda phrase: F.contains(joined, phrase)).alias("whole"))

        return F.filter(F.transform("codes", judge), lambda x: x["whole"])

    joined = F.array(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    found = F.when(F.size("codes") > 0, F.transform(joined, verified)[0])
    shaped = placed.select("id", "n_words", "base", F.transform(F.coalesce(found, F.array().cast("array<struct<label:string,place:long,share:double,whole:boolean>>")), lambda x: F.struct(
        x["label"].alias("label"), x["place"].alias("place"), x["share"].alias("share"))).alias("found"))
    best = F.array_max(F.transform("found", lambda x: x["share"]))
    return shaped.select("*", F.coalesce(best, F.when(F.size("base") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"))


def label_text(labels: Column) -> Column:
    """Distinct labels, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
