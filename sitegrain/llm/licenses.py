"""Licence scans: MinHash bands over overlapping text windows, then exact shingle containment. DataFrame functions only.

Every template is a set of five-word shingles. Texts are cut into overlapping windows whose size
follows the class of the template's shingle count, so one window always holds a whole occurrence
and the template is at least ``MIN_JACCARD`` (0.3) of it. Each of the ``BANDS`` (24) bands is the
smallest shingle hash under its own hash function, so a window with a whole template collides in
some band with probability 1 - 0.7^24 > 0.9998; a window that holds the least that counts (0.8
of the template, Jaccard 0.22 at worst) with 1 - 0.78^24 > 0.997.

A band can only collide if the window's smallest shingle belongs to a template. Texts, and then
windows, without any template shingle are therefore left out before the bands are computed,
without losing a collision; the test is one hash look-up per shingle.

Candidates are verified on the shingle strings: the share of the template's shingles that the
window contains must be ``min_containment`` or more.

Nulls: a null text has no windows; null ids are carried. Texts of fewer than five words match
nothing. Repeated rows are judged alike. Case does not count.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SHINGLE = 5
BANDS = 24
MIN_JACCARD = 0.3
MIN_CONTAINMENT = 0.8
#: (most template shingles, window shingles, stride): a window holds every occurrence, as size >= most + stride - 1.
CLASSES = ((1, 2, 2), (3, 5, 3), (8, 12, 5), (20, 30, 11), (50, 75, 26))
#: More template shingles than the last class are scanned as consecutive parts of that many.
PART = 50
#: The scan keeps the template hashes in the plan; beyond this many it refuses instead of growing the plan.
MAX_TEMPLATE_SHINGLES = 20_000

# Short public licence notices, name to wording.
NOTICES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation",
}


def shingles_of(text: str) -> list[str]:
    words = text.lower().split()
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def template_parts(templates: Mapping[str, str]) -> list[tuple[str, int, list[str]]]:
    """(name, class, distinct shingles) of every template or part of a long one. Templates need five words."""
    out = []
    for name, text in sorted(templates.items()):
        all_of = list(dict.fromkeys(shingles_of(text)))
        if not all_of:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        for first in range(0, len(all_of), PART):
            part = all_of[first : first + PART]
            out.append((name, next(i for i, c in enumerate(CLASSES) if len(part) <= c[0]), part))
    if sum(len(p) for _, _, p in out) > MAX_TEMPLATE_SHINGLES:
        raise ValueError("too many template shingles for one scan; scan them in several")
    return out


def _words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in lower case; one empty word for a blank text."""
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def _shingled(text: Column) -> Column:
    """An array of one (words, shingle hashes). Words are a lambda's argument, so a text is split once."""

    def both(words: Column) -> Column:
        n = F.size(words) - (SHINGLE - 1)
        # Single elements: ``slice`` would copy the whole array for every shingle.
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[words[i + j] for j in range(SHINGLE)]))
        return F.struct(words.alias("words"), F.when(n > 0, each).alias("hashes"))

    return F.transform(F.array(_words(text)), both)


def _part(values: Column, first: Column, count: Column) -> Column:
    """``count`` elements from ``first`` on, fewer at the end."""
    return F.transform(F.sequence(first, F.least(first + count, F.size(values)) - 1), lambda i: values[i])


def _bands(hashes: Column) -> Column:
    """The smallest shingle hash in the order of every band; the band number picks the hash function."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)), lambda band: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band)))
    )


def template_table(spark: SparkSession, parts: list[tuple[str, int, list[str]]]) -> DataFrame:
    """(template, part, class, shingles, hashes): one row per template part, bounded by ``MAX_TEMPLATE_SHINGLES``."""
    rows = spark.createDataFrame([(n, i, c, s) for i, (n, c, s) in enumerate(parts)], "template string, part int, class int, shingles array<string>")
    return rows.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(*[F.split(s, " ")[j] for j in range(SHINGLE)])))


def scan(docs: DataFrame, templates: Mapping[str, str], doc_id: str = "doc_id", text: str = "text", min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """(doc_id, template, part, windows, containment, first_word): every template part found in each document."""
    spark = docs.sparkSession
    parts = template_parts(templates)
    table = template_table(spark, parts)
    known = table.select(F.explode("hashes").alias("h")).agg(F.collect_set("h").alias("h"))
    hashed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.inline(_shingled(F.col(f"`{text}`"))))
    # A monotonic id tells repeated rows apart; it never leaves this plan's last aggregate.
    marked = hashed.filter(F.arrays_overlap("hashes", known.scalar())).withColumn("row", F.monotonically_increasing_id())
    used = sorted({c for _, c, _ in parts})
    grid = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(CLASSES[c][1]).alias("width"), F.lit(CLASSES[c][2]).alias("stride")) for c in used])
    classed = marked.withColumn("g", F.explode(grid))
    g = F.col("g")
    cut = lambda s: F.struct(
        s.alias("start"), _part(F.col("hashes"), s, g["width"]).alias("own"), _part(F.col("words"), s, g["width"] + (SHINGLE - 1)).alias("span")
    )
    windows = classed.select(
        "row", "doc_id", g["class"].alias("class"), F.inline(F.transform(F.sequence(F.lit(0), F.size("hashes") - 1, g["stride"]), cut))
    ).filter(F.arrays_overlap("own", known.scalar()))
    left = windows.select("row", "doc_id", "class", "start", "span", F.posexplode(_bands(F.col("own"))).alias("band", "least"))
    right = table.select("template", "part", "class", "shingles", F.posexplode(_bands(F.col("hashes"))).alias("band", "least"))
    # Bounded by MAX_TEMPLATE_SHINGLES.
    hit = left.join(F.broadcast(right), ["class", "band", "least"])
    own_shingles = F.transform(
        F.sequence(F.lit(1), F.size("span") - (SHINGLE - 1)), lambda i: F.array_join(F.slice("span", i, SHINGLE), " ")
    )
    share = F.size(F.array_intersect(own_shingles, F.col("shingles"))) / F.size("shingles")
    verified = hit.withColumn("share", share).filter(F.col("share") >= min_containment)
    # A window may collide in several bands.
    each = verified.groupBy("row", "doc_id", "template", "part", "start").agg(F.max("share").alias("share"))
    return each.groupBy("row", "doc_id", "template", "part").agg(
        F.count(F.lit(1)).alias("windows"), F.max("share").alias("containment"), F.min("start").cast("long").alias("first_word")
    ).drop("row")


def sql(templates: Mapping[str, str], table: str = "documents", min_containment: float = MIN_CONTAINMENT) -> str:
    """The same windows as plain SQL, every shingle compared with every template."""
    parts = template_parts(templates)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(
        f"({quote(n)}, {i}, {len(p)}, {CLASSES[c][1]}, {CLASSES[c][2]}, {quote(s)})" for i, (n, c, p) in enumerate(parts) for s in p
    )
    return f"""
with t(template, part, size, width, stride, shingle) as (values {rows}),
w as (select row_number() over () r, doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws
  from {table} where text is not null),
s as (select r, doc_id, unnest(range(1, len(ws) - {SHINGLE - 2})) pos, ws from w where len(ws) >= {SHINGLE}),
h as (select r, doc_id, pos - 1 pos, template, part, size, width, stride, t.shingle
  from s join t on t.shingle = ws[pos] || ' ' || ws[pos + 1] || ' ' || ws[pos + 2] || ' ' || ws[pos + 3] || ' ' || ws[pos + 4]),
x as (select *, unnest(range(greatest(0, (pos - width + stride) // stride), pos // stride + 1)) * stride as start from h),
c as (select r, doc_id, template, part, start, count(distinct shingle)::double / any_value(size) share from x
  where start <= pos and pos < start + width group by all)
select doc_id, template, part::int part, count(*) windows, max(share) containment, min(start)::bigint first_word
from c where share >= {min_containment} group by r, doc_id, template, part"""
