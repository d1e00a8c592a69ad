"""License scan by sparse TF-IDF cosine to templates, then nearest-ancestor inheritance, in DataFrame operations only.

A file is compared by units: its lines' sentences, its paragraphs (headers among them) with line breaks and comment marks
taken out, the sentences of these, and the whole file. Units and templates (statements, headers, titles of licence texts,
SPDX lines) are sparse TF-IDF vectors; document frequencies of the templates' terms are counted over all files, terms of
no template weigh as unseen. A unit matches a template if the cosine reaches the threshold and the unit holds the words
that tell the licence from its kin. A template's signature is the rarest of these words, or the words without which the
others can't reach the threshold, whichever fewer files hold; only files and units with one are taken apart, and none that
could match is passed over. A file's licence is its best match.

A file without one takes that of the nearest directory above it in which a file speaks: directories, made distinct first,
are joined with speaking files by their ancestor paths, and files with their own directory; both joins are salted.

Defined results: null text is the empty text and a null path the empty path; equal cosines go to the smaller licence
name; of several speaking files in a directory the best match counts, then the smallest path; repeated rows give a row
each; an empty table gives an empty result; columns named like the result's give way to them, all others stay.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_join

#: Statements by which licences are declared, each with the words without which it means another licence.
TEMPLATES = (
    ("AGPL-3.0", "affero 3", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "affero 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "apache 2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "apache 2", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "bsd 2", "Released under the 2-Clause BSD License."),
    ("BSD-3-Clause", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "bsd 3", "Released under the 3-Clause BSD License."),
    ("CC-BY-4.0", "creative 4 attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "nc 4", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "noncommercial 4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "sa 4", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "sharealike 4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "domain", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("GPL-2.0", "gnu 2", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "gnu 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "gnu 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "gnu 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gnu 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "gnu 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "isc", "Released under the ISC License."),
    ("ISC", "purpose fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "lesser 3", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "lesser 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "MIT License"),
    ("MIT", "permission charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "permission charge", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "mozilla 2", "Mozilla Public License Version 2.0"),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
)
SPDX = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
TEMPLATES += tuple((name, f"spdx {name}", f"SPDX-License-Identifier: {name}") for name in SPDX)
#: Where lines end or a sentence does; where paragraphs part; line breaks inside one, with comment marks; sentences of one.
SENTENCE, PARAGRAPH, BREAK, STOP = r"\n|(?<=[.;!?])[ \t]+", r"\n[ \t\r*#/;%!|<>=-]*\n", r"[ \t\r]*\n[ \t\r*#/;%!|<>-]*", r"(?<=[.;!?])[ \t]+"
BROADCAST_DIRS = 20_000
COLUMNS = ("path", "license", "similarity", "found", "license_dir")


def _terms(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def term_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def units(text: Column) -> Column:
    """The distinct units of a text."""
    paragraphs = F.transform(F.split(text, PARAGRAPH), lambda p: F.regexp_replace(p, BREAK, " "))
    whole = F.array(F.array_join(paragraphs, " "))
    return F.array_distinct(F.concat(F.split(text, SENTENCE), F.flatten(F.transform(paragraphs, lambda p: F.split(p, STOP))), paragraphs, whole))


class Statements:
    """Template vectors under given document frequencies."""

    def __init__(self, df: dict[str, int], n: int, threshold: float, templates=TEMPLATES):
        self.unseen = math.log(n + 1) + 1
        self.idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for _, _, s in templates for t in _terms(s)}
        self.rows, self.signature = [], set()
        for k, (name, must, s) in enumerate(templates):
            terms, needed = _terms(s), set(_terms(must))
            v = {t: terms.count(t) * self.idf[t] for t in terms}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.rows += [(k, name, t, x / norm, t in needed) for t, x in v.items()]
            # a unit must hold every needed word, and one of the rarest words, as the others can't reach the threshold: what fewer files hold
            rarest = sorted(v, key=lambda t: (-df.get(t, 0), t))
            mass = [sum((v[t] / norm) ** 2 for t in rarest[: i + 1]) for i in range(len(rarest))]
            ways = [{t for t, m in zip(rarest, mass, strict=True) if m >= threshold**2 - 1e-9}, *({t} for t in sorted(needed))]
            self.signature |= min(ways, key=lambda w: sum(df.get(t, 0) for t in w))
        self.needed = {k: len({t for j, _, t, _, m in self.rows if j == k and m}) for k in range(len(templates))}

    def table(self, spark) -> DataFrame:
        """(template, license, term, weight, must, needed): as many rows as the templates have terms."""
        rows = ", ".join(f"({k}, '{name}', '{t}', {x!r}D, {int(m)}, {self.needed[k]})" for k, name, t, x, m in self.rows)
        return spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, license, term, weight, must, needed)")

    def term_weights(self, spark) -> DataFrame:
        rows = ", ".join(f"('{t}', {x!r}D)" for t, x in sorted(self.idf.items()))
        return spark.sql(f"SELECT * FROM VALUES {rows} AS t(term, idf)")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", speaks: Column | None = None, threshold: float = 0.7, templates=TEMPLATES) -> DataFrame:
    """The columns of ``files`` but the text, and path, license, similarity, found ("own", "inherited" or null) and license_dir.

    ``speaks`` says which files, if they have a licence, speak for their directory; by default those named LICENSE, LICENCE,
    COPYING, NOTICE or UNLICENSE.
    """
    spark = files.sparkSession
    vocabulary = sorted({t for _, _, s in templates for t in _terms(s)})
    if speaks is None:
        speaks = F.element_at(F.split(F.coalesce(F.col(path_col), F.lit("")), "/"), -1).rlike(r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$")
    rest = [c for c in files.columns if c not in (path_col, text_col) and c.lower() not in COLUMNS]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = F.array(*map(F.lit, vocabulary))
    held = F.concat(F.array_intersect(term_array(text), known), F.array(F.lit("")))  # the empty term counts the files
    counts = {r[0]: r[1] for r in files.select(F.explode(held).alias("term")).groupBy("term").count().collect()}  # at most the templates' terms
    st = Statements(counts, counts.get("", 0), threshold, templates)
    sign = F.array(*map(F.lit, sorted(st.signature)))
    signed = lambda x: F.arrays_overlap(term_array(x), sign)
    rows = files.select(
        F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("_path"), F.struct(*rest).alias("_rest") if rest else F.lit(None).alias("_rest"), F.coalesce(speaks, F.lit(False)).alias("_speaks"),
        F.when(signed(text), F.filter(units(text), signed)).alias("_units"),
    )
    rows = materialize(rows, "files")
    each = rows.where("_units is not null").select("_row", F.posexplode("_units").alias("unit", "s"))
    terms = each.select("_row", "unit", F.explode(term_array(F.col("s"))).alias("term")).groupBy("_row", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = terms.join(F.broadcast(st.term_weights(spark)), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(st.unseen)))
    norms = weighed.groupBy("_row", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(F.broadcast(st.table(spark)), "term").groupBy("_row", "unit", "template", "license", "needed").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.sum("must").alias("has"))
    cosines = dots.where("has = needed").join(norms, ["_row", "unit"]).select("_row", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    best = cosines.groupBy("_row").agg(F.min(F.struct((-F.col("similarity")).alias("d"), "license")).alias("m")).select("_row", F.col("m.license").alias("own"), (-F.col("m.d")).alias("similarity"))
    own = materialize(rows.drop("_units").join(best, "_row", "left").withColumn("_dir", F.regexp_extract("_path", "^(.*)/[^/]*$", 1)), "own")
    # nearest ancestor in which a file speaks
    given = own.where("_speaks and own is not null").groupBy(F.col("_dir").alias("_above")).agg(F.min(F.struct((-F.col("similarity")).alias("d"), "_path", "own")).alias("m")).select("_above", F.col("m.own").alias("given"))
    dirs = own.where("own is null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("_above"))
    near = salted_join(above.distinct(), given, "_above", "_dir").groupBy("_dir").agg(F.max(F.struct(F.length("_above").alias("n"), F.col("_above"), F.col("given"))).alias("m"))
    near = materialize(near.select("_dir", F.col("m.given").alias("given"), F.col("m._above").alias("license_dir")), "inherited")
    out = own.join(F.broadcast(near), "_dir", "left") if near.count() <= BROADCAST_DIRS else salted_join(own, near, "_dir", "_row", "left")
    return out.select(
        *(F.col("_rest").getField(c).alias(c) for c in rest), F.col("_path").alias("path"), F.coalesce("own", "given").alias("license"), "similarity",
        F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").alias("found"), F.when(F.col("own").isNull(), F.col("license_dir")).alias("license_dir"),
    )


def op9_license_scan(spark, sf_dir):
    """Documents as files source/language/hundred/id; each that has a licence speaks for its directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.col("source"), F.col("lang"), (F.col("doc_id") / 100).cast("long").cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text"), speaks=F.lit(True))
