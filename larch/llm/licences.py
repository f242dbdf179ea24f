"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Units are all windows of 1 to WINDOW consecutive lines (those without words don't count), so a header
may be wrapped, and the whole text.  Units and templates become sparse TF-IDF vectors; document
frequencies come from all lines of the table and the templates.  Only units that can reach the least
cosine leave the scan: the product with a template needs the frequencies of the templates' words only,
and any other word weighs at least its count, which bounds the cosine from above.  An SPDX identifier is
one word with its tag, so it matches as a whole or not.  A file's own licence is the best template of its
windows; a file whose
whole text is like a template (or whose name says so) is a licence file and speaks for its directory.
Files without an own licence take that of the nearest directory above them that has one: ancestors
are spelled out once per distinct directory, joined on the path, and the deepest match wins.

Only words joined on templates make products, so the join's output is units x words shared; ancestors
are per directory, so a hot directory costs one row there and is joined to its files last.

Defined cases: null or empty texts have no own licence but inherit; a null path is a directory of its
own without ancestors; ties between templates go to the first name, between licence files of one
directory to the smallest path; repeated rows are files each; very long texts and lines are read
whole; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larch.llm.common import cut
from larch.llm.words import pieces

#: Names and public header statements of licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *((name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "MIT", "MPL-2.0")),
)
#: Most lines of a window.
WINDOW = 6
#: A text with one of these (in lower case) is judged whole whatever its bound, for files whose name says that they are licences.
ANCHORS = ("licens", "licenc", "copyright", "spdx", "redistribut", "permission is hereby")
FILE_NAMES = "(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
#: Least cosine of an own licence, and of a licence file's whole text.
LINE_COSINE, FILE_COSINE = 0.6, 0.5


_WORD = re.compile(r"(?:spdx-license-identifier=)?[a-z0-9.+-]*[a-z0-9][a-z0-9.+-]*")
_SPDX = re.compile(r"spdx-license-identifier:[ \t]*\(?")


def _words(line: str) -> list[str]:
    """Words of a line in lower case, without full stops behind them; an SPDX identifier and its tag are one."""
    if "spdx-" in line:
        line = _SPDX.sub("spdx-license-identifier=", line)
    return [w.rstrip(".") for w in _WORD.findall(line)]


def _lines(text: str) -> list[list[str]]:
    return [w for w in map(_words, text.lower().split("\n")) if w]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many lines hold each word, by piece; the number of lines itself stands at the empty word."""
    for batch in batches:
        for piece in pieces(batch, limit=8 << 20):
            counts = Counter()
            for text in piece.column(0).to_pylist():
                lines = _lines(text or "")
                counts[""] += len(lines)
                for words in lines:
                    counts.update(set(words))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "df"])


def _units(idf: dict[str, float], limits: tuple[float, float]):
    """Units whose cosine to a template may reach limits (windows, whole texts), given the idf of the templates' words."""
    bags = [Counter(_words(t.lower())) for _, t in TEMPLATES]
    weights = np.array([[bag[w] * idf[w] for w in idf] for bag in bags])
    unit = weights / np.linalg.norm(weights, axis=1)[:, None]
    at = {w: k for k, w in enumerate(idf)}
    weight = np.array(list(idf.values()))
    # By Cauchy and Schwarz a cosine is at most the root of the summed squares of the template's words that the unit has.
    most = dict(zip(idf, (unit * unit).max(axis=0).tolist(), strict=True))
    vocabulary = set(idf)

    def bound(tf: Counter) -> float:
        shared = [w for w in tf if w in at]
        k, n = [at[w] for w in shared], np.array([tf[w] for w in shared], dtype=float)
        x = n * weight[k]
        other = sum(c * c for w, c in tf.items() if w not in at)
        return float((unit[:, k] @ x).max() / math.sqrt(x @ x + other)) if shared else 0.0

    def of(text: str) -> Iterator[tuple[bool, list[str]]]:
        lines, low = _lines(text), text.lower()
        hits = [vocabulary.intersection(x) for x in lines]
        part = [sum(most[w] for w in x) for x in hits]
        seen = set()
        for i in range(len(lines)):
            # A window that starts or ends with a line without words of templates is less like them than without that line.
            if not part[i]:
                continue
            mass, words = 0.0, []
            for j in range(i, min(i + WINDOW, len(lines))):
                mass += part[j]
                words = words + lines[j]
                if part[j] and mass >= limits[0] ** 2 - 1e-9 and bound(Counter(words)) >= limits[0] - 1e-9 and tuple(words) not in seen:
                    seen.add(tuple(words))
                    yield False, words
        if sum(part) >= limits[1] ** 2 - 1e-9 or any(a in low for a in ANCHORS):
            words = [w for x in lines for w in x]
            if words and (any(a in low for a in ANCHORS) or bound(Counter(words)) >= limits[1] - 1e-9):
                yield True, words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = [(i, w, x) for i, text in enumerate(piece.column(1).to_pylist()) for w, x in of(text or "")]
                rows = piece.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, pa.array([f[1] for f in found], pa.bool_()), pa.array([f[2] for f in found], pa.list_(pa.string()))], names=["row", "whole", "words"])

    return run


def own_licences(files: DataFrame) -> DataFrame:
    """row, whole (boolean), licence, cosine: the best template of each file's windows of lines (whole false) and of its whole text.

    Windows below LINE_COSINE, and whole texts below FILE_COSINE that hold none of ANCHORS, may be missing.
    """
    spark = files.sparkSession
    bags = [Counter(_words(t.lower())) for _, t in TEMPLATES]
    base = spark.createDataFrame([(k, n, w, c) for k, ((n, _), bag) in enumerate(zip(TEMPLATES, bags, strict=True)) for w, c in bag.items()], "t int, licence string, word string, tf long")
    lines = files.select("text").mapInArrow(_counted, "word string, df long")
    counts = cut(lines.unionByName(base.select("word", F.lit(1).cast("long").alias("df"))).groupBy("word").agg(F.sum("df").alias("df")))
    vocabulary = sorted(set().union(*bags))
    df = {r["word"]: r["df"] for r in counts.filter(F.col("word").isin(["", *vocabulary])).collect()}
    n_units = df.get("", 0) + len(TEMPLATES)
    known = {w: math.log((1 + n_units) / (1 + df[w])) + 1 for w in vocabulary}
    schema = T.StructType([T.StructField("row", files.schema["row"].dataType), T.StructField("whole", T.BooleanType()), T.StructField("words", T.ArrayType(T.StringType()))])
    units = files.select("row", "text").mapInArrow(_units(known, (LINE_COSINE, FILE_COSINE)), schema)
    # Equal units of a file are one; each unit gets a number from its words.
    units = units.withColumn("u", F.xxhash64("words")).dropDuplicates(["row", "whole", "u"])
    bag = cut(units.select("row", "whole", "u", F.explode("words").alias("word")).groupBy("row", "whole", "u", "word").agg(F.count(F.lit(1)).alias("tf")))
    idf = counts.filter("word <> ''").select(F.col("word").alias("_w"), (F.log(F.lit(float(1 + n_units)) / (1 + F.col("df"))) + 1).alias("idf"))
    weigh = lambda x: x.join(idf, F.col("word") == F.col("_w")).drop("_w").withColumn("w", F.col("tf") * F.col("idf"))
    bag, base = weigh(bag), weigh(base)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    base_norm = base.groupBy("t").agg(norm.alias("tn"))
    base = base.join(base_norm, "t").select("t", "licence", F.col("word").alias("tw"), (F.col("w") / F.col("tn")).alias("tv"))
    norms = bag.groupBy("row", "whole", "u").agg(norm.alias("un"))
    # The templates are a fixed list of a few hundred words: a broadcast of proven size.
    dots = bag.join(F.broadcast(base), F.col("word") == F.col("tw")).groupBy("row", "whole", "u", "licence", "t").agg(F.sum(F.col("w") * F.col("tv")).alias("dot"))
    cosines = dots.join(norms, ["row", "whole", "u"]).select("row", "whole", "licence", F.round(F.col("dot") / F.col("un"), 9).alias("cosine"))
    best = cosines.groupBy("row", "whole", "licence").agg(F.max("cosine").alias("cosine"))
    top = Window.partitionBy("row", "whole").orderBy(F.desc("cosine"), "licence")
    return best.withColumn("_r", F.row_number().over(top)).filter("_r = 1").drop("_r")


def _parent(path: Column) -> Column:
    """The directory of a path; '' at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def licences(files: DataFrame) -> DataFrame:
    """row, path, own_licence, own_cosine, is_licence_file, licence, how, from_directory for files (row, path, text).

    row tells the files apart; how is 'own', 'inherited' or null.
    """
    found = cut(own_licences(files.select("row", F.col("text").cast("string").alias("text"))))
    line = found.filter(~F.col("whole") & (F.col("cosine") >= LINE_COSINE)).select(F.col("row").alias("_lr"), F.col("licence").alias("own_licence"), F.col("cosine").alias("own_cosine"))
    whole = found.filter(F.col("whole")).select(F.col("row").alias("_wr"), F.col("licence").alias("whole_licence"), F.col("cosine").alias("whole_cosine"))
    slim = files.select("row", "path").join(line, F.col("row") == F.col("_lr"), "left").join(whole, F.col("row") == F.col("_wr"), "left").drop("_lr", "_wr")
    is_file = (F.col("whole_cosine") >= FILE_COSINE) | (F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False)) & F.coalesce("whole_licence", "own_licence").isNotNull())
    slim = cut(slim.withColumn("is_licence_file", F.coalesce(is_file, F.lit(False))).withColumn("directory", _parent(F.col("path"))))
    speaks = F.coalesce(F.when(F.col("whole_cosine") >= FILE_COSINE, F.col("whole_licence")), F.col("own_licence"), F.col("whole_licence"))
    by_path = F.min(F.struct("path", speaks.alias("l"))).alias("m")
    declared = slim.filter("is_licence_file and path is not null").groupBy(F.col("directory").alias("at")).agg(by_path).select("at", F.col("m.l").alias("dir_licence"))
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    directories = slim.filter("path is not null").select("directory").distinct().withColumn("at", F.explode(F.array_distinct(above)))
    nearest = directories.join(declared, "at").groupBy(F.col("directory").alias("_d")).agg(F.max_by(F.struct("at", "dir_licence"), F.length("at")).alias("n"))
    nearest = cut(nearest.select("_d", F.col("n.at").alias("from_directory"), F.col("n.dir_licence").alias("inherited")))
    out = slim.join(nearest, (F.col("directory") == F.col("_d")) & F.col("path").isNotNull(), "left")
    own = F.coalesce(F.col("own_licence"), F.when(F.col("is_licence_file"), speaks))
    return out.select(
        "row", "path", "own_licence", "own_cosine", "is_licence_file", F.coalesce(own, "inherited").alias("licence"),
        F.when(own.isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").alias("how"),
        F.when(own.isNull(), F.col("from_directory")).alias("from_directory"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: row (doc_id and a hash of the text, so that repeated ids stay apart), path source/lang/doc_id, text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return docs.select(
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h")).alias("row"),
        F.concat_ws("/", name("source"), name("lang"), name("doc_id")).alias("path"), "text",
    )
