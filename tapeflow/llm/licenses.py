"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

A notice is a paragraph of the whole text with a line that holds a licence word. It is scored in units: the paragraph,
its lines, its sentences and its SPDX tags, those that hold a licence word; so a notice is found alone, wrapped, inside
prose or before code, and a licence's full text by its paragraphs. Each unit meets every template: headers, short
sentences, SPDX ids, openings and first paragraphs of licence files. The nearest template of the nearest unit names the file.

Weights are (1 + log tf) (1 + log (N / df)), smoothed by the templates themselves, with the true document frequencies of
all terms over the notices of the corpus: counted by one aggregation, joined back to the terms. Only those of template
terms, a fixed vocabulary, reach the driver. A template of few terms counts only where its telling terms (name and
version) are all there. A file without a licence of its own inherits that of the nearest directory at or above its own
that has a licence file, by joins on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import Scratch, slices
from tapeflow.llm.url_filters import with_host_path

# Notices as their publishers give them, shortened to the part that names the licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-3.0": "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 3",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT License, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version"
_FILE = "GNU {0}GENERAL PUBLIC LICENSE Version {1}, Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"


def _short(name: str, *ids: str) -> tuple[str, ...]:
    return (f"Licensed under the {name}", f"Released under the {name}", f"This work is licensed under the {name}", *(x.format(i) for i in ids for x in ("Licensed under {0}", "Licensed under the {0} license", "SPDX-License-Identifier: {0}")))


def _gnu(kind: str, short: str, n: int) -> tuple[str, ...]:
    name = f"GNU {kind}General Public License"
    return (*_short(f"{name}, version {n}", f"{short}-{n}.0", f"{short}v{n}"), f"SPDX-License-Identifier: {short}-{n}.0-only", f"SPDX-License-Identifier: {short}-{n}.0-or-later", _HEADER.format(kind, n), _FILE.format(kind, n))


#: The other forms of a notice: a licence's score is the best over its template and these.
VARIANTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (*_short("Apache License, Version 2.0", "Apache-2.0"), "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    "BSD-3-Clause": (*_short("BSD 3-Clause License", "BSD-3-Clause"), "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "CC0-1.0": _short("CC0 1.0 Universal Public Domain Dedication", "CC0-1.0"),
    **{f"CC-{k}-4.0": _short(f"Creative Commons {v} 4.0 International License", f"CC-{k}-4.0") for k, v in _CC.items()},
    "GPL-2.0": _gnu("", "GPL", 2),
    "GPL-3.0": _gnu("", "GPL", 3),
    "ISC": (*_short("ISC License", "ISC"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "LGPL-3.0": _gnu("Lesser ", "LGPL", 3),
    "MIT": (*_short("MIT License", "MIT"), "MIT License Copyright (c)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    "MPL-2.0": _short("Mozilla Public License, v. 2.0", "MPL-2.0"),
}
#: Terms that tell no licence from another; of a template of at most SHORT terms all others must be in a notice.
GENERIC = frozenset("a and c clause copyright general identifier international is license licensed of public released spdx the this under universal v version work".split())
SHORT = 14
TRIGGER = re.compile(r"licen[sc]e|copyright|redistribut|permission|public domain|spdx", re.IGNORECASE)
LEAST_COSINE = 0.5
#: A file is a licence file if its name says so, or if its notice has this share of its words or more.
LEAST_SHARE = 0.5
_SPDX = re.compile(r"(?i)spdx-license-identifier:[^\S\n]*[^\s]+")
#: Sentences end at a mark and white space, but not after a single letter (v. 2.0).
_SENTENCE = re.compile(r"(?<=[.:;!?])(?<!\b[A-Za-z]\.)\s+")
_TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)?")


def terms(text: str) -> Counter:
    """Words and numbers with their counts; a number's ``.0`` goes, so that version 2 is 2.0."""
    return Counter(t.removesuffix(".0") for t in _TERM.findall(text.lower()))


def forms(templates: dict[str, str], variants: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(name, text) of every template and variant, by name."""
    return sorted({*templates.items(), *((name, text) for name, texts in variants.items() for text in texts)})


def notices(text: str | None) -> list[str]:
    """The paragraphs that hold a licence word, as they stand."""
    if not text or not TRIGGER.search(text):
        return []
    return [p for p in re.split(r"\n(?:[^\S\n]*\n)+", text) if TRIGGER.search(p)]


def units(notice: str) -> list[str]:
    """The notice, then its lines, sentences and SPDX tags with a licence word; each once."""
    lines = [x for x in notice.split("\n") if TRIGGER.search(x)]
    sentences = [x for x in _SENTENCE.split(" ".join(notice.split())) if TRIGGER.search(x)]
    return list(dict.fromkeys([notice, *lines, *sentences, *_SPDX.findall(notice)]))


class Matcher:
    """Templates under document frequencies ``df`` of their terms among ``n`` notices."""

    def __init__(self, df: dict[str, int], n: int, templates: dict[str, str] = TEMPLATES, variants: dict[str, tuple[str, ...]] = VARIANTS):
        every = forms(templates, variants)
        self.own, self.df = Counter(t for _, text in every for t in terms(text).keys()), df
        self.total = 1 + n + len(every)
        self.vectors = []
        for name, text in every:
            v = self.weights(terms(text))
            norm = math.sqrt(sum(x * x for x in v.values()))
            needs = v.keys() - GENERIC if len(v) <= SHORT else frozenset()
            self.vectors.append((name, {t: x / norm for t, x in v.items()}, needs))

    def weights(self, counts: dict[str, int]) -> dict[str, float]:
        return {t: (1 + math.log(c)) * (1 + math.log(self.total / (1 + self.df.get(t, 0) + self.own[t]))) for t, c in counts.items()}

    def nearest(self, v: dict[str, float], norm: float) -> tuple[str | None, float]:
        """The licence of the nearest template and its cosine, from the weights of a unit's template terms and the length
        of all its weights; ties go to the name first in order."""
        found: tuple[str | None, float] = (None, 0.0)
        for name, w, needs in self.vectors:
            if needs <= v.keys():
                s = sum(x * w[t] for t, x in v.items() if t in w) / (norm or 1.0)
                if s > found[1] + 1e-9:
                    found = (name, s)
        return found


_UNITS = "array<struct<whole:boolean,share:double,known:array<struct<t:string,c:int>>,other:array<struct<t:string,c:int>>>>"


def _extracted(files: DataFrame, keys: tuple[str, ...], known: frozenset[str]) -> DataFrame:
    """uid, keys, path, named, units: one row for each file, in one pass over the texts."""
    pair = pa.list_(pa.struct([("t", pa.string()), ("c", pa.int32())]))
    kind = pa.list_(pa.struct([("whole", pa.bool_()), ("share", pa.float64()), ("known", pair), ("other", pair)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, named = [], []
            for text, path in zip(batch.column("text").to_pylist(), batch.column("path").to_pylist()):
                own = []
                some = notices(text)
                size = max(1, len(_TERM.findall(text.lower()))) if some else 1
                for notice in some:
                    share = sum(terms(notice).values()) / size
                    for k, unit in enumerate(units(notice)):
                        split: tuple[list, list] = ([], [])
                        for t, c in terms(unit).items():
                            split[t not in known].append({"t": t, "c": c})
                        own.append({"whole": k == 0, "share": share, "known": split[0], "other": split[1]})
                found.append(own or None)
                named.append(bool(path) and bool(re.match(r"(?i)(licen[sc]e|copying|notice)\b", path.rsplit("/", 1)[-1])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", *keys, "path")), pa.array(named), pa.array(found, type=kind)], names=["uid", *keys, "path", "named", "units"])

    own = files.select(F.monotonically_increasing_id().alias("uid"), *keys, "path", "text")
    kept = own.drop("text").schema.simpleString()[7:-1]
    return own.mapInArrow(run, f"{kept},named:boolean,units:{_UNITS}")


def own_licenses(files: DataFrame, scratch: Scratch, keys: tuple[str, ...] = ("doc_id",), templates: dict[str, str] = TEMPLATES, least: float = LEAST_COSINE, variants: dict[str, tuple[str, ...]] = VARIANTS) -> DataFrame:
    """files(keys, path, text) -> keys, path, own_license, cosine, license_file: a row for each row.

    own_license is null (cosine 0) for a null or empty text and where no notice comes near enough; of several notices
    the nearest counts, of equal ones the first. license_file: the file has a licence of its own, and is named as a
    licence or holds little but that notice.
    """
    spark = files.sparkSession
    known = frozenset(t for _, text in forms(templates, variants) for t in terms(text))
    every = scratch.cut(_extracted(files, keys, known))
    each = every.where("units is not null").select("uid", F.posexplode("units").alias("k", "u")).select("uid", "k", "u.*")
    whole = each.where("whole").select(F.explode(F.concat("known", "other")).alias("x")).groupBy("x.t").agg(F.count(F.lit(1)).alias("df"))
    df = scratch.cut(whole)
    n = each.where("whole").count()
    vocabulary = F.broadcast(spark.createDataFrame([(t,) for t in sorted(known)], "t string"))  # the templates' terms
    matcher = Matcher({r["t"]: r["df"] for r in df.join(vocabulary, "t").collect()}, n, templates, variants)
    # The other terms of a unit count for its length alone; theirs are the frequencies that the driver doesn't hold.
    squares = F.pow((1 + F.log("c")) * (1 + F.log(F.lit(float(matcher.total)) / (1 + F.col("df")))), F.lit(2.0))
    other = each.select("uid", "k", F.explode("other").alias("x")).select("uid", "k", "x.t", "x.c").join(df, "t").groupBy("uid", "k").agg(F.sum(squares).alias("rest"))
    scored = each.select("uid", "k", "share", "known").join(other, ["uid", "k"], "left").select("uid", "k", "share", "known", F.coalesce("rest", F.lit(0.0)).alias("rest"))
    shared = spark.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = []
            for some, rest in zip(batch.column("known").to_pylist(), batch.column("rest").to_pylist()):
                v = m.weights({x["t"]: x["c"] for x in some or []})
                found.append(m.nearest(v, math.sqrt(rest + sum(x * x for x in v.values()))))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("k"), batch.column("share"), pa.array([x[0] for x in found], type=pa.string()), pa.array([round(x[1], 9) for x in found], type=pa.float64())], names=["uid", "k", "share", "name", "cosine"])

    near = scored.mapInArrow(run, "uid long, k int, share double, name string, cosine double").where(F.col("cosine") >= least)
    best = near.groupBy("uid").agg(F.max(F.struct("cosine", (-F.col("k")).alias("first"), "name", "share")).alias("s"))
    best = scratch.cut(best.select("uid", "s.*"))
    own = F.col("name").isNotNull()
    out = every.select("uid", *keys, "path", "named").join(best, "uid", "left")
    return out.select(*keys, "path", F.col("name").alias("own_license"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"), (own & (F.col("named") | F.coalesce(F.col("share") >= LEAST_SHARE, F.lit(False)))).alias("license_file"))


def directory(path: Column) -> Column:
    """The part before the last ``/``; empty at the top, null for a null path."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def inherit(found: DataFrame, scratch: Scratch, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds license and inherited_from (the directory; null where the licence is the file's own or there is none).

    Of several licence files of a directory the first by path decides. Joins are by directory: every distinct directory
    meets its ancestors once, then files meet their directory. Null paths inherit nothing.
    """
    found = found.withColumn("_dir", directory(F.col("path")))
    given = found.where(F.col("license_file") & F.col("_dir").isNotNull()).groupBy("_dir").agg(F.min(F.struct("path", "own_license")).alias("s"))
    given = scratch.cut(given.select(F.col("_dir").alias("above"), F.col("s.own_license").alias("given")))
    dirs = found.where(F.col("_dir").isNotNull()).select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    pairs = dirs.select("_dir", F.explode(above).alias("a")).select("_dir", "a.depth", "a.above").join(given, "above")
    nearest = pairs.groupBy("_dir").agg(F.max(F.struct("depth", "above", "given")).alias("s"))
    nearest = scratch.cut(nearest.select("_dir", F.col("s.above").alias("_from"), F.col("s.given").alias("_given")))
    # The directories of files without a licence of their own may hold a third of them: only directories that inherit
    # meet files, and Spark splits what is large.
    out = found.join(nearest, "_dir", "left")
    takes = F.col("own_license").isNull()
    return out.select(*keys, "path", "own_license", F.round("cosine", 6).alias("cosine"), "license_file", F.coalesce("own_license", "_given").alias("license"), F.when(takes, F.col("_from")).alias("inherited_from"))


def scan(files: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """files(keys, path, text) -> a row for each row: keys, path, own_license, cosine, license_file, license, inherited_from.

    ``keys`` name the columns that are carried along, whatever they hold; nulls and repeated rows stay rows of their own.
    """
    scratch = Scratch(files.sparkSession, "licenses")
    return inherit(scratch.cut(own_licenses(files, scratch, keys)), scratch, keys)


def document_files(docs: DataFrame) -> DataFrame:
    """doc_id, path, text of documents: the table tells no document's neighbours, so each is alone in its directory."""
    path = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("unknown")), F.col("doc_id").cast("string"), F.lit("text"))
    return docs.select("doc_id", path.alias("path"), "text")


def page_files(pages: DataFrame) -> DataFrame:
    """page_id, path, text of pages: host and path of the URL, and the text between the tags."""
    found = with_host_path(pages.select("page_id", "url", "html"))
    text = F.regexp_replace("html", "<[^>]*>", "\n")
    return found.select("page_id", F.when(F.col("host") != "", F.concat("host", "path")).alias("path"), text.alias("text"))
