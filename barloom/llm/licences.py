r"""Licence scans (native): TF-IDF cosine to templates, then inheritance along paths.

Units are the lines of every text, and the whole text. Templates are short notices
and the full texts of licences. A unit is compared with each template by the cosine of sparse
TF-IDF vectors; document frequencies are counted over the whole corpus for the
terms of the templates, and a term outside them weighs as much as the rarest. The
best template of at least SIMILAR is the unit's licence. A file whose whole text has
a licence, or which consists of licence lines for the most part, speaks for its directory; a file without a licence of its
own inherits from the nearest ancestor directory that has one.

Scale. A unit is skipped only if its terms cannot give SIMILAR: by Cauchy-Schwarz the
cosine is at most the share of the template's norm that lies in common terms, so the
commonest terms of a template are left out as long as their share is below SIMILAR,
and only units with one of its other terms are exploded. Templates are a fixed table
of templates x terms, so they are collected and broadcast. Inheritance joins distinct
directories with their ancestors by equality, never documents with documents.
"""

from __future__ import annotations

from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, small, text_of

SIMILAR = 0.7
#: A file is a licence file if its licence lines hold at least this share of its words.
FILE_SHARE = 0.5

#: Short public licence notices and their SPDX identifiers.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 into the public domain."),
    ("LicenseRef-Proprietary", "All rights reserved."),
)


def full_texts() -> list[tuple[str, str]]:
    """The identifiers and full texts in licence_texts, read by the driver alone."""
    texts = resources(__package__).joinpath("licence_texts").iterdir()
    return sorted((x.name.removesuffix(".txt"), x.read_text(encoding="utf-8")) for x in texts if x.name.endswith(".txt"))


def _terms(text: Column) -> Column:
    """Lower-case runs of letters, digits, points and hyphens, without points and hyphens at the ends."""
    return F.filter(F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}.\-]+"), lambda w: F.btrim(w, F.lit(".-"))), lambda w: w != "")


def _templates(docs: DataFrame) -> DataFrame:
    rows = docs.sparkSession.createDataFrame([(k, *x) for k, x in enumerate([*TEMPLATES, *full_texts()])], "template int, licence string, notice string")
    return rows.select("template", "licence", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))


def _cues(weights: list, similar: float) -> list[str]:
    """The terms of which a unit holds at least one if its cosine with any template is at least `similar`."""
    cues, left = set(), {}
    for row in sorted(weights, key=lambda r: (-(r["df"] or 0), r["term"])):
        room = left.get(row["template"], max(0.0, similar - 1e-6) ** 2)  # scores are rounded at six digits
        share = (row["tf"] * row["idf"] / row["norm"]) ** 2
        if share < room:
            left[row["template"]] = room - share
        else:
            cues.add(row["term"])
    return sorted(cues)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, similar: float = SIMILAR) -> DataFrame:
    """doc_id, path, own_licence, own_score, licences, licence, inherited_from: one row per input row.

    own_licence is the best match in the text (ties: first identifier), licences all
    identifiers found, sorted. licence is own_licence or else what is inherited from
    inherited_from. A null or empty text holds none; a null path has no ancestors.
    Where licence files of one directory differ, the better score, then the first
    identifier holds. Repeated rows are scanned one by one. No rows in, no rows out.
    """
    where = F.lit(None).cast("string") if path is None else path
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("doc_id"), where.alias("path"), text_of(text_col).alias("text"))
    templates = cut(_templates(docs))
    vocabulary = [r[0] for r in templates.select("term").distinct().collect()]  # of the fixed templates
    terms = _terms(F.col("text"))
    n = float(rows.count())
    frequency = rows.select(F.explode(F.array_distinct(F.filter(terms, lambda t: t.isin(vocabulary)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = cut(templates.join(frequency, "term", "left").withColumn("idf", F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).withColumn("norm", F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).over(Window.partitionBy("template")))))
    cues = _cues(weights.collect(), similar)
    held = cut(rows.select("row_key", "doc_id", "path", F.when(F.exists(terms, lambda t: t.isin(cues)), F.col("text")).alias("text")))
    n_words = F.size(terms)
    lines = F.filter(F.split("text", "\n"), lambda x: F.exists(_terms(x), lambda t: t.isin(cues)))
    units = F.concat(F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))), F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))))
    exploded = held.where("text IS NOT NULL").select("row_key", n_words.alias("n_words"), F.posexplode(units).alias("u", "unit")).select("row_key", "n_words", "u", "unit.whole", _terms(F.col("unit.unit")).alias("terms"))
    counted = exploded.select("row_key", "n_words", "u", "whole", F.size("terms").alias("unit_words"), F.explode("terms").alias("term")).groupBy("row_key", "n_words", "u", "whole", "unit_words", "term").agg(F.count("*").alias("n"))
    idf = weights.select("term", "idf").distinct()
    weighed = counted.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.log(F.lit(n) + 1) + 1)).drop("idf")
    norms = weighed.groupBy("row_key", "u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("unit_norm"))
    dots = weighed.join(F.broadcast(weights), "term").groupBy("row_key", "n_words", "u", "whole", "unit_words", "template", "licence", "norm").agg(F.sum(F.col("w") * F.col("tf") * F.col("idf")).alias("dot"))
    matched = dots.join(norms, ["row_key", "u"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("unit_norm")), 6))
    best = matched.groupBy("row_key", "n_words", "u", "whole", "unit_words").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).where(-F.col("b.s") >= similar)
    own = best.groupBy("row_key", "n_words").agg(F.min("b").alias("b"), F.sort_array(F.collect_set("b.licence")).alias("licences"), F.sum(F.when(~F.col("whole"), F.col("unit_words")).otherwise(0)).alias("line_words"), F.max("whole").alias("whole")).select(
        "row_key", F.col("b.licence").alias("own_licence"), (-F.col("b.s")).alias("own_score"), "licences", (F.col("whole") | (F.col("line_words") >= FILE_SHARE * F.col("n_words"))).alias("is_file"))
    files = held.drop("text").join(own, "row_key", "left").withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    files = cut(files.withColumn("dir", F.when(F.col("path").contains("/"), F.col("dir"))))
    speaks = files.where("is_file AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_licence").alias("licence"))).alias("b")).select(F.col("dir").alias("ancestor"), F.col("b.licence").alias("dir_licence"))
    parts = F.split("dir", "/")
    ancestors = files.where("own_licence IS NULL AND dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("ancestor"))
    nearest = ancestors.join(speaks, "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "dir_licence")).alias("a")).select("dir", F.col("a.ancestor").alias("ancestor"), F.col("a.dir_licence").alias("dir_licence"))
    mine = F.col("own_licence").isNotNull()
    # directories are far fewer than files, and one may hold most of them
    return files.join(small(nearest), "dir", "left").select(
        "doc_id", "path", "own_licence", "own_score", "licences", F.coalesce("own_licence", "dir_licence").alias("licence"), F.when(~mine, F.col("ancestor")).alias("inherited_from"))
