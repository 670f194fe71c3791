"""License scans with a positional index of rare template words (native).

The templates' words are the index: each word has postings (template, position). A template is open in a file that has the rarest
word of its key phrases, by inverse document frequency over the whole corpus; all words of the file are looked up in the postings of its open
templates. Postings that agree on the relative position of file and template are an alignment, and an alignment counts if the mandatory
key phrases stand where it says. No alignment that counts is lost to the rarest words, since each has its key phrases whole, and one notice
of a file cannot push out another. A file without an open template and without a base phrase's first word is only split into words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: What separates words: all ASCII but letters and digits.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases that always count, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Words of a template that have to agree on one relative position (all, if the template has fewer).
AGREEING = 3
#: Words around the aligned place in which key phrases may stand.
SLACK = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return re.findall(r"[a-z0-9]+", self.text.lower())


#: Notices of common licences, as their publishers word them, and their mandatory phrases.
TEMPLATES = (
    Template("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0",)),
    Template("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2 0",)),
    Template("artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0", ("artistic license 2 0",)),
    Template("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause", ("spdx license identifier bsd 2 clause",)),
    Template("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    Template("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause", ("spdx license identifier bsd 3 clause",)),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0 international",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0 international",)),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge",)),
    Template("mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
)


def words_of(text: Column) -> Column:
    """The words as they are written; to be compared through ``lower`` with ASCII words of the same number of bytes."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def _present(text: Column, vocabulary: list[str]) -> Column:
    """The distinct words of the vocabulary in a text; some letters beyond ASCII pass for those that are their lower case."""
    return F.array_intersect(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), F.lit(vocabulary))


def _hits(words: str, vocabulary: list[str]) -> Column:
    """Array of (w, i): words of the vocabulary and their positions."""
    at = F.transform(words, lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("i"), F.octet_length(w).alias("n")))
    # the number of bytes tells A-Z from letters beyond ASCII whose lower case is ASCII
    return F.filter(at, lambda x: x["w"].isin(vocabulary) & (x["n"] == F.length(x["w"])))


def _phrase_at(words: Column, start: Column, phrase: str) -> Column:
    part = F.array_join(F.slice(words, start + 1, phrase.count(" ") + 1), " ")
    return (F.lower(part) == phrase) & (F.octet_length(part) == len(phrase))


def _starts(phrase: str) -> Column:
    """The positions at which a phrase stands, from the hits of its first word."""
    first = phrase.split(" ")[0]
    hits = F.filter("hits", lambda x: (x["w"] == first) & _phrase_at(F.col("words"), x["i"], phrase))
    return F.transform(hits, lambda x: x["i"])


def word_ranks(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each template word by document frequency over all of ``docs``, rarest first; ties by the word.

    The counts are combined on the map side; as many rows as the templates have words reach the driver.
    """
    seen = docs.select(F.explode(_present(F.col(text_col), vocabulary)).alias("w"))
    df = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (df.get(w, 0), w)))}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and license_spans.

    ``license_spans`` lists (label, start, score) of each verified alignment by template and place, start in words from 0; score is the share of
    those template words that the file has at all which agree on the place, and the column ``score`` is 1 where a base phrase stands, else the
    best of the spans, else 0. Null and empty texts have no words and no labels. Each row is judged by itself, whole, whatever its length;
    repeated rows give repeated results, of words of equal frequency the first by name is the rarer one, and an empty table gives an empty
    result. Columns with the names of the new ones, in whatever case, are replaced; all others stay as they are.
    """
    news = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_spans"]
    own = [c for c in docs.columns if c.lower() not in news or c == text_col]
    vocabulary = sorted({w for t in templates for w in t.words} | {p.split(" ")[0] for p, _ in base})
    rank = word_ranks(docs, f"`{text_col}`", vocabulary)
    postings: dict[str, list[tuple[int, int]]] = {w: [] for w in vocabulary}
    for t, template in enumerate(templates):
        for i, w in enumerate(template.words):
            postings[w].append((t, i))
    by_rank = sorted(vocabulary, key=rank.__getitem__)
    rank_of = lambda w: F.array_position(F.lit(by_rank), w).cast("int")  # noqa: E731  1 is the rarest
    as_array = lambda xs: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in xs]) if xs else F.array().cast("array<struct<t:int,i:int>>")
    index = F.array(*[as_array(postings[w]) for w in by_rank])
    need = F.lit([min(AGREEING, len(set(t.words))) for t in templates])
    rarest = [min((w for phrase in t.key_phrases for w in phrase.split(" ")), key=rank.__getitem__) for t in templates]
    opening = F.lit(sorted({p.split(" ")[0] for p, _ in base} | set(rarest)))

    # the columns of ``docs`` travel in one struct, where no name can clash
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    df = df.withColumn("words", words_of(F.col("text"))).withColumn("present", _present(F.col("text"), vocabulary))
    df = df.withColumn("hits", F.when(F.arrays_overlap("present", opening), _hits("words", vocabulary)).otherwise(F.array().cast("array<struct<w:string,i:int,n:int>>")))
    df = df.withColumn("base", F.array(*[_starts(phrase) for phrase, _ in base]))
    df = df.withColumn("ranked", F.transform("hits", lambda x: F.struct(rank_of(x["w"]).alias("r"), x["i"].alias("i"))))
    df = df.withColumn("has", F.array_distinct(F.transform("ranked", lambda x: x["r"])))
    df = df.withColumn("open", F.array_compact(F.array(*[F.when(F.array_contains("has", rank[w] + 1), F.lit(t)) for t, w in enumerate(rarest)])))
    looked_up = F.when(F.size("open") > 0, F.col("ranked")).otherwise(F.slice("ranked", 1, 0))
    postings_of = lambda x: F.filter(F.element_at(index, x["r"]), lambda p: F.array_contains("open", p["t"]))
    places = F.flatten(F.transform(looked_up, lambda x: F.transform(postings_of(x), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["i"]).alias("d")))))
    df = df.withColumn("places", F.array_sort(places))
    # runs of equal (template, relative position); a place is noted once, when its run is long enough
    same = lambda s, x: F.when((x["t"] == s["t"]) & (x["d"] == s["d"]), s["n"] + 1).otherwise(1)
    run = F.aggregate(
        "places",
        F.struct(F.lit(-1).alias("t"), F.lit(0).alias("d"), F.lit(0).alias("n"), F.array().cast("array<struct<t:int,d:int>>").alias("out")),
        lambda s, x: F.struct(
            x["t"].alias("t"), x["d"].alias("d"), same(s, x).alias("n"),
            F.when(same(s, x) == F.element_at(need, x["t"] + 1), F.concat(s["out"], F.array(F.struct(x["t"].alias("t"), x["d"].alias("d"))))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    df = df.withColumn("found", run)

    phrases = F.array(*[F.lit([f" {p} " for p in t.key_phrases]) for t in templates])
    lengths = F.lit([len(t.words) for t in templates])

    def verified(x: Column) -> Column:
        begin = F.greatest(x["d"] - SLACK, F.lit(0))
        part = F.slice(F.col("words"), begin + 1, F.element_at(lengths, x["t"] + 1) + SLACK + x["d"] - begin)
        line = F.concat(F.lit(" "), F.lower(F.array_join(part, " ")), F.lit(" "))
        return F.forall(F.element_at(phrases, x["t"] + 1), lambda p: F.contains(line, p))

    labels = F.lit([t.label for t in templates])
    template_words = F.array(*[F.lit([rank[w] + 1 for w in t.words]) for t in templates])

    def span(x: Column) -> Column:
        agreeing = F.size(F.filter("places", lambda p: (p["t"] == x["t"]) & (p["d"] == x["d"])))
        all_ = F.size(F.filter(F.element_at(template_words, x["t"] + 1), lambda r: F.array_contains("has", r)))
        return F.struct(F.element_at(labels, x["t"] + 1).alias("label"), x["d"].cast("long").alias("start"), (agreeing / all_).alias("score"))

    df = df.withColumn("license_spans", F.transform(F.filter("found", verified), span))
    base_labels = F.array_compact(F.array(*[F.when(F.size(F.col("base")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(base)]))
    starts = F.flatten("base")
    return df.select(
        "row.*",
        F.size("words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.transform("license_spans", lambda x: x["label"]))), ",").alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("license_spans", lambda x: x["score"])), F.lit(0.0))).alias("score"),
        "license_spans",
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
