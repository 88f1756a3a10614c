"""License notices in texts.

Overlapping windows of 12 words every 6 words of a text get MinHash values over their five-word shingles; windows
of the templates do too, at every word. Each of the BANDS hash functions is a band of one row, and a text
and a template with an equal band value are candidates. A notice of up to 7 words lies whole in some
window, which then has a similarity of 1/8 at least: it is missed with probability (7/8)**64 < 0.0002; longer ones less.
Candidates are verified by the exact share of the template's shingles that the text contains.

A window without a shingle of a template can't become a candidate, so MinHash values are taken only of texts that
have one. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.decontam import BROADCAST_ROWS, words
from gridloom.llm.secrets import bound
from gridloom.llm.workspace import stored

WIDTH = 5
WINDOW = 12
STRIDE = 6
BANDS = 64
CONTAINMENT = 0.75
#: Shingles of all templates are compared as literals up to this many.
MOST_LITERALS = 5_000

#: Notices to look for (fixed values: customary wording of public licenses).
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-line": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}


def shingle_strings(w: Column, width: int = WIDTH) -> Column:
    """Distinct shingles of a word array; fewer words than width are one shingle, no words none."""

    def of(ws: Column) -> Column:
        n = F.size(ws)
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.array_join(F.slice(ws, i + 1, width), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))

    return bound(w, of)


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """A hash for each shingle of a word array, in order; places past the end don't count."""
    return bound(w, lambda ws: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)])))


def _bands(hashes: Column, stride: int, window: int = WINDOW, width: int = WIDTH, bands: int = BANDS) -> Column:
    """Distinct band values of the windows over shingle hashes, every `stride` words."""
    per = window - width + 1

    def of_window(hs: Column, at: Column) -> Column:
        part = F.slice(hs, at + 1, per)
        return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda f: F.xxhash64(f, F.array_min(F.transform(part, lambda x: F.xxhash64(x, f)))))

    def of_text(hs: Column) -> Column:
        last = F.greatest(F.size(hs) - (1 if stride > 1 else per), F.lit(0))
        return F.flatten(F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda at: of_window(hs, at)))

    return F.array_distinct(bound(hashes, of_text))


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((templates or TEMPLATES).items()), "name string, notice string")


def license_matches(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT, most_templates: int = 10_000) -> DataFrame:
    """(doc_id, h, name, containment) of verified matches; h is a hash of the text. The template table is a
    parameter of bounded size: more than most_templates rows are an error."""
    t = templates.select("name", words(F.col("notice")).alias("w")).filter("size(w) > 0")
    t = t.withColumn("shingles", shingle_strings(F.col("w")))
    rows = t.select("name", "shingles").limit(most_templates + 1).collect()
    if len(rows) > most_templates:
        raise ValueError("too many templates")
    spark = docs.sparkSession
    none = spark.createDataFrame([], "doc_id long, h long, name string, containment double")
    if not rows:
        return none
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), words(text).alias("w"))
    t = t.withColumn("hashes", shingle_hashes(F.col("w")))
    hashed = base.select("doc_id", "h", shingle_hashes(F.col("w")).alias("hashes"))
    known = [r[0] for r in t.select(F.explode("hashes")).distinct().limit(MOST_LITERALS + 1).collect()]
    if len(known) <= MOST_LITERALS:
        hashed = hashed.filter(F.arrays_overlap("hashes", F.array(*map(F.lit, known))))
    some = hashed.select("doc_id", "h", F.explode(_bands(F.col("hashes"), STRIDE)).alias("band"))
    theirs = t.select("name", F.explode(_bands(F.col("hashes"), 1)).alias("band"))
    pairs = stored(some.join(F.broadcast(theirs) if theirs.count() <= BROADCAST_ROWS else theirs, "band").select("doc_id", "h", "name").distinct(), "candidates")
    met = pairs.groupBy("doc_id", "h").agg(F.collect_set("name").alias("names"))
    met = (F.broadcast(met) if met.count() <= BROADCAST_ROWS else met).alias("m")
    found = base.alias("d").join(met, (F.col("d.h") == F.col("m.h")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")))
    both = found.select("d.doc_id", "d.h", shingle_strings(F.col("w")).alias("own"), "names").select("doc_id", "h", "own", F.explode("names").alias("name"))
    both = both.join(F.broadcast(t.select("name", "shingles")), "name")
    share = F.size(F.array_intersect("own", "shingles")) / F.size("shingles")
    return both.select("doc_id", "h", "name", share.alias("containment")).filter(F.col("containment") >= containment)


def licensed(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row: doc_id, n_licenses, licenses (names in order, comma-joined), best (largest
    containment, 0 without a match). Null and empty texts match nothing."""
    found = license_matches(docs, templates if templates is not None else template_table(docs.sparkSession), containment)
    found = stored(found, "licenses")
    per = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("name")).alias("names"), F.max("containment").alias("best"))
    per = (F.broadcast(per) if per.count() <= BROADCAST_ROWS else per).alias("m")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h")).alias("d")
    out = d.join(per, (F.col("d.h") == F.col("m.h")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), "left")
    return out.select("d.doc_id", F.when(F.col("names").isNull(), 0).otherwise(F.size("names")).alias("n_licenses"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"))
