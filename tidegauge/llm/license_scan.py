"""Operator 10: licence scans, in DataFrame functions only.

Whole files are compared with licence texts, and their lines, sentences and paragraphs with notices
and standard headers, by the cosine of sparse TF-IDF vectors.  A file that is a licence text, or whose
words are mostly notices, is a licence file of its directory; a file without a notice of its own
inherits from the nearest directory above it that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored
from .tables import table

#: Public licence texts, one file each, named by licence.
TEXTS_DIR = Path(__file__).parent / "licenses"
_OR_LATER = "or (at your option) any later version"
_GNU = (
    "is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License "
    "as published by the Free Software Foundation, either version {} of the License, " + _OR_LATER + "."
)
#: (licence, notice or paragraph of a standard header). A licence may have several.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Artistic-1.0", "Licensed under the Artistic License, version 1.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("AGPL-3.0", "This program " + _GNU.format("Affero", 3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program " + _GNU.format("", 2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program " + _GNU.format("", 3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL-2.1", "This library " + _GNU.format("Lesser", "2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This library " + _GNU.format("Lesser", 3)),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("proprietary", "All rights reserved"),
]
#: Least cosine of a notice.
LEAST_COSINE = 0.75
#: Words too common to look for, as long as they cannot reach LEAST_COSINE alone: function words
#: first, then digits, then words of general English.
COMMON = (
    "the of to and is this in or a any with are that by has all under for it as not may was which your so into made on be if you at an from he she they we than then "
    "only here there their no nor do does what when been have had but can will its each other such 0 1 2 3 4 v work use met law form forms "
    "free following person public general source possible provided subject without copy conditions author terms "
    "version extent code related files associated charge documentation permitted binary rights software january"
).split()
#: Directories that are broadcast at most; beyond, the join shuffles.
BROADCAST_DIRS = 500_000

_TERM, _BREAK = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
#: Comment marks at the start of a line, empty lines between paragraphs, and ends of sentences.
_MARKS = r"(?md)^[ \t]*(?:#+|//+|/\*+|\*+/?|--+|;+|%+|<!--)[ \t]?"
_BLANK, _SENTENCE = r"\n[ \t]*\n", r"(?<=[.!?])\s+"


@cache
def licence_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files in TEXTS_DIR."""
    return [(p.stem, p.read_text("utf-8")) for p in sorted(TEXTS_DIR.glob("*.txt"))]


def _vectors(templates: list[tuple[str, str]]) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]], float]:
    """Inverse document frequencies over the templates, their vectors (frequencies damped to
    1 + ln tf), and the inverse frequency of an unknown term."""
    bags = [(name, Counter(re.findall(r"[^\W_]+", text.lower()))) for name, text in templates]
    seen = Counter(t for _, bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in seen.items()}
    return idf, [(name, {t: (1 + math.log(n)) * idf[t] for t, n in bag.items()}) for name, bag in bags], math.log(1 + len(bags)) + 1


def _within(v: dict[str, float], terms: set[str]) -> float:
    """Length of a vector's part with these terms, as a share of the vector's length."""
    return math.sqrt(sum(w * w for t, w in v.items() if t in terms) / sum(w * w for w in v.values()))


def key_terms(templates: list[tuple[str, str]], least: float = LEAST_COSINE) -> list[str]:
    """Terms of which a text needs one to reach ``least`` with any template.

    By Cauchy and Schwarz, a text that shares only the terms W with a template T has a cosine of at
    most |T restricted to W| / |T|. All terms are left out that can be: common words first, then
    those that the fewest templates have, which leaves a short list of terms of law.
    """
    idf, vectors, _ = _vectors(templates)
    vectors = [v for _, v in vectors]
    weak: set[str] = set()
    for term in [*COMMON, *sorted(set(idf) - set(COMMON), key=lambda t: (-idf[t], t))]:
        if all(term not in v or _within(v, weak | {term}) < least for v in vectors):
            weak.add(term)
    return sorted(set(idf) - weak)


def least_terms(templates: list[tuple[str, str]], least: float = LEAST_COSINE) -> int:
    """Number of different terms that a text must share with some template to reach ``least``."""
    few = []
    for _, v in _vectors(templates)[1]:
        heavy, shared = sorted(v, key=v.get, reverse=True), set()
        while _within(v, shared) < least:
            shared.add(heavy[len(shared)])
        few.append(len(shared))
    return min(few)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _words(text: Column) -> Column:
    return F.split(F.lower(text), _BREAK)


def _literals(terms: list[str]) -> Column:
    return F.array(*(F.lit(t) for t in terms))


def _can_match(words: Column, templates: list[tuple[str, str]], keys: list[str], least: float) -> Column:
    """Whether a text of these words can reach ``least`` with any template.

    It must have one of the key terms.  Then, let s of its different terms be known and u unknown.  The
    dot product is at most the length of the known part, which is at most the greatest weight times
    sqrt(s) times 1 + ln of their mean frequency (Jensen), and the unknown part is at least sqrt(u) long.
    """
    idf, _, unknown = _vectors(templates)
    s = F.size(F.array_intersect(words, _literals(sorted(idf))))
    u = F.greatest(F.size(F.array_distinct(words)) - s - 1, F.lit(0))  # one may be the empty string
    known = s * max(idf.values()) ** 2 * F.pow(1 + F.log((F.size(words) - u) / s), 2)
    enough = (s >= least_terms(templates, least)) & (known * (1 - least**2) >= u * (unknown * least) ** 2)
    return F.coalesce(F.arrays_overlap(words, _literals(keys)) & enough, F.lit(False))


def match_templates(texts: DataFrame, templates: list[tuple[str, str]], least: float = LEAST_COSINE) -> DataFrame:
    """(key, license, cosine) of the texts (key, unit), each key once, that match a template."""
    spark = texts.sparkSession
    idf, vectors, unknown = _vectors(templates)
    known = spark.createDataFrame(list(idf.items()), "term string, idf double")
    rows = [(i, name, t, w / math.sqrt(sum(x * x for x in v.values()))) for i, (name, v) in enumerate(vectors) for t, w in v.items()]
    shares = spark.createDataFrame(rows, "template int, license string, term string, share double")
    # both tables are made of the templates and have some thousand rows
    counted = texts.select("key", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    weighed = counted.join(F.broadcast(known), "term", "left").select("key", "term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(unknown))).alias("w"))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(shares), "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    scored = dots.join(norms, "key").select("key", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= least)
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def file_units(base: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(id, path, copy, words, pos, level, unit, key, n): the parts of files (id, path, text) that can match.

    Level "file" is the whole text. With comment marks at the start of lines taken away, level "line" are
    the lines, "sentence" the sentences of each paragraph, its lines joined, and "paragraph" the
    paragraphs; copy is a hash of the text, pos the number of the part, n its words. One pass over the texts; parts
    that can't reach ``least`` are left out, by bounds that a long text of plain English may pass.
    """
    keys = key_terms(TEMPLATES, least)
    noticed = F.arrays_overlap("all", _literals(keys))
    whole = _can_match(F.col("all"), licence_texts(), key_terms(licence_texts(), least), least)
    # no filter here: it would be pushed below and cut the words again; rows without parts give none
    read = base.withColumn("all", _words(F.col("text"))).withColumn("noticed", noticed).withColumn("whole", whole)
    level = lambda name, parts: F.transform(parts, lambda u: F.struct(F.lit(name).alias("level"), F.trim(u).alias("unit")))
    plain = F.regexp_replace("text", _MARKS, "")
    paragraphs = F.transform(F.split(plain, _BLANK), lambda p: F.regexp_replace(p, r"\s+", " "))
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, _SENTENCE)))
    inner = F.concat(level("line", F.split(plain, "\n")), level("sentence", sentences), level("paragraph", paragraphs))
    none = F.array().cast("array<struct<level:string,unit:string>>")
    parts = F.concat(F.when(F.col("noticed"), inner).otherwise(none), F.when(F.col("whole"), level("file", F.array("text"))).otherwise(none))
    file = ["id", "path", F.xxhash64("text").alias("copy"), F.size(_terms(F.col("text"))).alias("words")]
    units = read.select(*file, F.posexplode(parts).alias("pos", "u")).select("id", "path", "copy", "words", "pos", "u.level", "u.unit")
    likely = units.where((F.col("level") == "file") | _can_match(_words(F.col("unit")), TEMPLATES, keys, least))
    return likely.withColumn("key", F.sha2("unit", 256)).withColumn("n", F.size(_terms(F.col("unit"))))


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """One row per file: ``id_col``, path, license, cosine, origin and inherited_from.

    origin is "license_file" (the whole text reaches ``least`` with a licence text, or at least half of
    the file's words stand in notices of one level, see ``file_units``), "header" (a notice in the
    file), "inherited" or "none".  A match of the whole text decides before notices, of these the
    strongest; of equal ones, the name that sorts first.  A directory has the licence that most of its
    licence files name (of equal numbers the name that sorts first) and passes it on to all below that
    have none of their own.

    Parts that can match are found in one pass and written to the shared folder.  Equal parts are
    scored once, whatever their number.  Directories are resolved before files are joined, and every
    count combines before its shuffle, so that a directory may hold any share of the files.  A null path
    is a file at the root, a null or empty text has no notice.  Rows that share id and path get the same
    result, the strongest of their texts.  Other columns of ``files`` are not returned.
    """
    base = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    units = stored(file_units(base, least), "units")
    is_whole = F.col("level") == "file"
    match = lambda rows, templates: match_templates(rows.select("key", "unit").distinct(), templates, least)
    notices = match(units.where(~is_whole), TEMPLATES).withColumn("whole", F.lit(False))
    files = match(units.where(is_whole), licence_texts()).withColumn("whole", F.lit(True))
    parts = units.drop("unit").withColumn("whole", is_whole)
    found = parts.join(notices.unionByName(files), ["key", "whole"]).dropDuplicates(["id", "path", "copy", "pos"])
    best = F.min(F.struct((~F.col("whole")).alias("part"), (-F.col("cosine")).alias("c"), "license"))
    levels = found.groupBy("id", "path", "copy", "level").agg(best.alias("b"), F.sum("n").alias("inside"), F.max("words").alias("words"))
    texts = levels.groupBy("id", "path", "copy").agg(F.min("b").alias("b"), (2 * F.max("inside") >= F.max("words")).alias("is_file"))
    own = texts.groupBy(F.col("id").alias("own_id"), F.col("path").alias("own_path")).agg(F.min("b").alias("b"), F.bool_or("is_file").alias("is_file"))
    own = own.select("own_id", "own_path", F.col("b.license").alias("own"), (-F.col("b.c")).alias("own_cosine"), "is_file")

    votes = own.where("is_file").groupBy(_parent(F.col("own_path")).alias("dir"), "own").agg(F.count("*").alias("n"))
    declared = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("v")).select(F.col("dir").alias("above"), F.col("v.own").alias("dir_license"))
    dirs = base.select(_parent(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))
    ancestors = dirs.select("dir", F.explode(chain).alias("a")).select("dir", "a.depth", "a.above")
    nearest = ancestors.join(declared, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("d")).select("dir", F.col("d.above").alias("from_dir"), F.col("d.dir_license").alias("dir_license"))
    nearest = F.broadcast(nearest) if dirs.count() <= BROADCAST_DIRS else nearest
    joined = base.select("id", "path", _parent(F.col("path")).alias("dir")).join(own, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("path") == F.col("own_path")), "left").join(nearest, "dir", "left")
    origin = F.when(F.col("is_file"), "license_file").when(F.col("own").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    inherits = F.col("own").isNull() & F.col("dir_license").isNotNull()
    return joined.select(F.col("id").alias(id_col), F.col("path"), F.coalesce("own", "dir_license").alias("license"), F.col("own_cosine").alias("cosine"), origin.alias("origin"), F.when(inherits, F.col("from_dir")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents as files source/lang/doc_id."""
    part = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown"))).alias("path"), "text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(document_paths(table(spark, sf_dir, "documents")))
