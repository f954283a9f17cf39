"""License scans: MinHash bands over overlapping windows of a text retrieve templates, exact containment confirms them.

Words are runs of [a-z0-9] of the lower-cased text; a shingle is five words. Windows of WINDOW shingles begin at every
STEP-th word; each has BANDS hash functions and a band is the least hash of one of them. Templates are cut into windows
that begin at every word. A window inside a copied template is equal to one of the template's, and meets it in every
band. The hardest case is a template of one shingle, which is at least 1 / WINDOW of the shingles of WINDOW / STEP
windows: all of these miss it with (1 - 1 / WINDOW)^(BANDS * WINDOW / STEP), about one in a million. For retrieved
templates all shingles of the text are looked up, and the share of the template's shingles that are there must be
CONTAINED or more.

Only DataFrame operations: word hashes are made once for a text, windows and bands are rows that live inside one
generated loop, and only those that meet a template leave it. The table of templates is a parameter; it is broadcast, as
its size does not depend on the data.

A text's first two shingles are in a window less than the others; where a template's only shingle is there, a shorter window
ahead of the text makes up for it. Very long text: its words are rows inside one task and are never collected.
Null text, or one with fewer than five words: no matches. Null key: kept. Rows with equal key and text give one result.
Empty table, or no templates: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, WINDOW, STEP, BANDS, CONTAINED = 5, 4, 2, 24, 0.75

# Short notices and openings of public licenses, by SPDX identifier.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "LGPL-2.1": "licensed under the GNU Lesser General Public License, version 2.1",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _hashed(rows: DataFrame, text: str) -> DataFrame:
    """rows without the text, with h: the hashes of its words."""
    # An empty piece at either end belongs to no shingle of a template, so it does no harm.
    return rows.withColumn("h", F.transform(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.xxhash64(w))).drop(text)


def _shingle(at: Column | int) -> Column:
    return F.xxhash64(*[F.col("h")[at + j] for j in range(SHINGLE)])


def template_table(spark, templates: Mapping[str, str]) -> DataFrame:
    """template, i, s: the shingles of all templates, by place."""
    rows = [(name, text) for name, text in templates.items() if len(words_of(text)) >= SHINGLE]
    made = _hashed(spark.createDataFrame(rows, "template string, text string"), "text")
    # The pieces at the ends of a template are words, unless it begins or ends with signs; these are cut off first.
    return made.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("h") - SHINGLE))).select("template", "i", _shingle(F.col("i")).alias("s"))


def _least(shingles: list[Column], band: Column) -> Column:
    return F.least(*[F.xxhash64(s, band) for s in shingles])


def _bands() -> Column:
    return F.explode(F.array(*[F.lit(k) for k in range(BANDS)])).alias("band")


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, template, n_shingles, n_found, containment, start_word, end_word for each text and template found in it."""
    spark = docs.sparkSession
    cut = {name: " ".join(words_of(t)) for name, t in templates.items()}
    own = template_table(spark, cut)
    shingles = own.groupBy("template", "s").agg(F.min("i").alias("i"))
    sizes = shingles.groupBy("template").agg(F.count(F.lit(1)).alias("n_shingles"))
    # Template windows: the shingles at i to i + WINDOW - 1, as far as there are; shorter templates have one window.
    heads = own.groupBy("template").agg(F.max("i").alias("last")).select("template", F.explode(F.sequence(F.lit(0), F.greatest(F.col("last") - (WINDOW - 1), F.lit(0)))).alias("w"))
    inside = heads.join(own, "template").filter(f"i between w and w + {WINDOW - 1}").select("template", "w", "s", _bands())
    keys = inside.groupBy("template", "w", "band").agg(F.min(F.xxhash64("s", "band")).alias("m")).select("template", "m").distinct()

    hashed = _hashed(docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("v"), F.col(text).alias("t")), "t").filter(F.size("h") >= SHINGLE)
    last = F.size("h") - SHINGLE
    # The window at -STEP holds the first places only, so that these are in as many windows as any other.
    starts = hashed.select("k", "v", "h", F.explode(F.sequence(F.lit(-STEP), last, F.lit(STEP))).alias("i"))
    # A window at either end of the text has fewer shingles: its first or last one stands in for those that are missing.
    window = [_shingle(F.least(F.greatest(F.col("i") + j, F.lit(0)), F.greatest(last, F.lit(0)))).alias(f"s{j}") for j in range(WINDOW)]
    banded = starts.select("k", "v", *window).select("k", "v", *[f"s{j}" for j in range(WINDOW)], _bands())
    met = banded.select("k", "v", _least([F.col(f"s{j}") for j in range(WINDOW)], F.col("band")).alias("m")).join(F.broadcast(keys), "m")
    candidates = met.groupBy("k", "v", "template").agg(F.count(F.lit(1)).alias("bands"))

    places = hashed.select("k", "v", "h", F.explode(F.sequence(F.lit(0), last)).alias("i")).select("k", "v", "i", _shingle(F.col("i")).alias("s"))
    found = places.join(F.broadcast(shingles.select("template", "s")), "s").groupBy("k", "v", "template", "s").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    found = found.groupBy("k", "v", "template").agg(F.count(F.lit(1)).alias("n_found"), F.min("lo").alias("start_word"), F.max("hi").alias("hi"))
    same = [found[c].eqNullSafe(candidates[c]) for c in ("k", "v", "template")]
    sure = found.join(candidates, same, "left_semi").join(F.broadcast(sizes), "template").withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    sure = sure.filter(F.col("containment") >= CONTAINED)
    return sure.select(F.col("k").alias(key), "template", "n_shingles", "n_found", "containment", "start_word", (F.col("hi") + SHINGLE).alias("end_word"))
