"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from directories.

Templates are short notices and whole licence texts. Every line of every file is compared with
the notices; the whole body of a file named like a licence is compared with both. A file without
a licence of its own takes that of the nearest ancestor directory that has a licence file.
DataFrame operations only.

Weights: term count times 1 + ln((1 + T) / (1 + number of the T templates with the term)), apart
for the notices and the whole texts; a term of no template has the largest weight. A line is
looked at only if it has one of the telling terms: these are taken from the notices,
uncommon and rare ones first, until what is left of each notice is too light to reach the threshold alone, so by Cauchy
and Schwarz no line is missed. For the same reason a line is dropped if its terms that no notice
has are too heavy beside the others, or the terms that it shares with each notice too light. Only
what is left is taken apart and shuffled, once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronokv.llm.common import checked_broadcast, fresh, settled, stage

TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Words that any text has: taken as telling terms last. They have their weight like all others.
COMMON = frozenset("a an and any are as at be by can for from in is it may not of on or that the this to under was which with you your use work without either except file files found form later software source version".split())
LICENSE_FILE = "(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([._-][^/]*)?$"
#: Whole public licence texts.
TEXTS = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "templates").glob("*.txt"))]
#: Public short notices of common licences (fixed values).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def weights(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float]:
    """(weight of every template term, weight of any other term)."""
    n = Counter(t for _, text in templates for t in set(terms(text)))
    total = len(templates)
    return {t: 1 + math.log((1 + total) / (1 + k)) for t, k in n.items()}, 1 + math.log(1 + total)


def vectors(templates: list[tuple[str, str]]) -> list[tuple[int, str, str, float]]:
    """(template, licence, term, share of the unit vector)."""
    weight, _ = weights(templates)
    out = []
    for i, (name, text) in enumerate(templates):
        v = {t: k * weight[t] for t, k in Counter(terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out += [(i, name, t, x / norm) for t, x in sorted(v.items())]
    return out


def telling(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Terms one of which any text that reaches the threshold has."""
    rows = vectors(templates)
    weight, _ = weights(templates)
    chosen: set[str] = set()
    for i in range(len(templates)):
        mine = sorted(((t, x) for k, _, t, x in rows if k == i), key=lambda p: (p[0] in COMMON, -weight[p[0]], -len(p[0]), p[0]))
        left = sum(x * x for t, x in mine if t not in chosen)
        for t, x in mine:
            if left < threshold * threshold * 0.999999:
                break
            if t not in chosen:
                chosen.add(t)
                left -= x * x
    return sorted(chosen)


@settled
def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, texts: list[tuple[str, str]] | None = None, threshold: float = 0.6, path: str = "path", text: str = "text") -> DataFrame:
    """The columns of ``files`` but the text, with license, similarity, inherited_from and effective_license.

    ``license``: of the template most similar to one of the file's lines or, for a licence file,
    to its body, if the cosine (to six digits) reaches ``threshold``; among equals the first by
    name. ``inherited_from``: for files without one, the nearest ancestor directory with a licence
    file that has one. Null texts have no licence; a null path has no ancestors; repeated rows are
    kept. Where the table has a column of one of these names, that keeps it and the operator's
    has an underscore before it.
    """
    notices, whole = TEMPLATES if templates is None else templates, TEXTS if texts is None else texts
    spark = files.sparkSession
    keep = [c for c in files.columns if c != text]
    license, similarity, inherited_from, effective = (fresh(c, *keep) for c in ("license", "similarity", "inherited_from", "effective_license"))
    # Staged narrow: what a row is called again, whether it is a licence file, the terms of its telling lines and of a licence file's body.
    body = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    is_file = F.coalesce(F.regexp_like(F.col(path).cast("string"), F.lit(LICENSE_FILE)), F.lit(False))
    marks = sorted(telling(notices, threshold), key=lambda t: (-len(t), t))
    telling_line = "(^|[^a-z0-9])(" + "|".join(map(re.escape, marks)) + ")([^a-z0-9]|$)"
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, F.lit(telling_line)))
    words = lambda x: F.regexp_extract_all(x, F.lit(TERM), 0)
    parts = F.concat(F.array(F.when(is_file, words(body))), F.transform(lines, words))  # part 0 is the body, null in other files
    rows = stage(files.select(F.struct(*keep).alias("file"), F.col(path).cast("string").alias("at"), F.monotonically_increasing_id().alias("row"), is_file.alias("is_file"), parts.alias("parts")), "files")

    families = [(weights(notices), vectors(notices)), (weights(whole), vectors(whole))]
    names = [n for n, _ in notices] + [n for n, _ in whole]
    first = len(notices)  # the number of the first whole text
    share: dict[str, list[float]] = {}
    for k, (_, rows_of) in enumerate(families):
        for i, _, t, x in rows_of:
            share.setdefault(t, [0.0] * len(names))[i + k * first] = x
    known = spark.createDataFrame([(t, *[float(w.get(t, other)) for (w, other), _ in families], x) for t, x in share.items()], "term string, w0 double, w1 double, share array<double>")

    taken = rows.select("row", F.posexplode("parts").alias("part", "terms")).where("terms is not null")
    least = threshold * threshold * 0.999999
    body, known_share = F.col("part") == 0, _known_share(*families[0][0])
    near = taken.where(body | (known_share >= least)).where(body | (known_share * _reach(families[0][1]) >= least))
    counts = near.select("row", "part", F.explode("terms").alias("term")).repartition("row", "part").groupBy("row", "part", "term").agg(F.count("*").alias("tf"))
    other = [o for (_, o), _ in families]
    weighed = counts.join(F.broadcast(known), "term", "left").select("row", "part", *[(F.col("tf") * F.coalesce(f"w{k}", F.lit(o))).alias(f"x{k}") for k, o in enumerate(other)], "share")  # one row per template term
    of = lambda i: f"x{int(i >= first)}"
    sums = weighed.groupBy("row", "part").agg(*[F.sqrt(F.sum(F.col(x) * F.col(x))).alias(f"norm_{x}") for x in ("x0", "x1")], *[F.sum(F.col(of(i)) * F.col("share")[i]).alias(f"dot{i}") for i in range(len(names))])
    cosine = lambda i: F.round(F.col(f"dot{i}") / F.col(f"norm_{of(i)}"), 6)
    match = lambda i, n: F.when((cosine(i) >= threshold) & ((F.col("part") == 0) if i >= first else F.lit(True)), F.struct((-cosine(i)).alias("s"), F.lit(n).alias("name")))
    matches = sums.select("row", F.array_min(F.array(*[match(i, n) for i, n in enumerate(names)])).alias("b")).where("b is not null")
    best = matches.groupBy("row").agg(F.min("b").alias("b")).select("row", F.col("b.name").alias("license"), (-F.col("b.s")).alias("similarity"))
    own = stage(rows.drop("parts").join(best, "row", "left").withColumn("dir", parent("at")), "own")

    found = own.where("is_file and license is not null").groupBy(F.col("dir").alias("ancestor")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b")).select("ancestor", F.col("b.license").alias("theirs"))
    # Each directory is resolved once, however many files it holds.
    above = own.where("dir is not null").select("dir").distinct().select("dir", F.explode(ancestors("dir")).alias("ancestor"))
    inherited = above.join(checked_broadcast(stage(found, "found")), "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "theirs")).alias("i")).select("dir", "i.ancestor", "i.theirs")
    done = own.join(checked_broadcast(stage(inherited, "inherited")), "dir", "left")
    lacks = F.col("license").isNull()
    return done.select("file.*", F.col("license").alias(license), F.col("similarity").alias(similarity), F.when(lacks, F.col("ancestor")).alias(inherited_from), F.coalesce("license", "theirs").alias(effective))


def _known_share(weight: dict[str, float], other: float) -> Column:
    """At most which share of the squared norm of ``terms`` is of terms that some template has."""
    mine = F.array_intersect("terms", F.array(*[F.lit(t) for t in sorted(weight)]))
    square = F.create_map(*[F.lit(v) for t, w in sorted(weight.items()) for v in (t, w * w)])
    times = lambda t: F.size("terms") - F.size(F.array_remove("terms", t))
    known = F.aggregate(mine, F.lit(0.0), lambda a, t: a + F.element_at(square, t) * times(t) * times(t))
    rest = (F.size(F.array_distinct("terms")) - F.size(mine)) * other * other
    return F.try_divide(known, known + rest)


def _reach(rows: list[tuple[int, str, str, float]]) -> Column:
    """The largest squared weight that ``terms`` shares with a template: a bound on the squared cosine."""
    by: dict[int, list[tuple[str, float]]] = {}
    for i, _, t, x in rows:
        by.setdefault(i, []).append((t, x * x))

    def one(parts: list[tuple[str, float]]) -> Column:
        weight = F.create_map(*[F.lit(v) for p in parts for v in p])
        return F.aggregate(F.array_intersect("terms", F.array(*[F.lit(t) for t, _ in parts])), F.lit(0.0), lambda a, t: a + F.element_at(weight, t))

    return F.greatest(*[one(p) for p in by.values()], F.lit(0.0))


def parent(path: str) -> Column:
    """The directory of a path; the root is an empty one."""
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def ancestors(directory: str) -> Column:
    """The directory and all above it, the root last."""
    parts = F.split(F.col(directory), "/")
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit(""))))


def document_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents filed by source, thousand and hundred; the first of each is its LICENSE."""
    top = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"))
    sub = F.concat_ws("/", top, F.floor(F.pmod(F.col("doc_id"), F.lit(1000)) / 100).cast("string"))
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).when(F.col("doc_id") % 100 == 0, F.concat(sub, F.lit("/LICENSE"))).otherwise(F.concat(sub, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scan_sql(threshold: float = 0.6) -> str:
    """The same over all lines, without the telling terms, for ``document_paths`` of the table documents."""
    known, unit, others = [], [], []
    for k, templates in enumerate((TEMPLATES, TEXTS)):
        weight, other = weights(templates)
        others.append(f"({k}, {other!r}::DOUBLE)")
        known += [f"({k}, {_quoted(t)}, {w!r}::DOUBLE)" for t, w in sorted(weight.items())]
        unit += [f"({k}, {i}, {_quoted(n)}, {_quoted(t)}, {x!r}::DOUBLE)" for i, n, t, x in vectors(templates)]
    return f"""
WITH known(family, term, weight) AS (VALUES {", ".join(known)}), unit(family, template, license, term, share) AS (VALUES {", ".join(unit)}),
others(family, other) AS (VALUES {", ".join(others)}),
t AS (SELECT doc_id, lower(coalesce(text, '')) AS body, coalesce(source, 'unknown') || '/' || (doc_id // 1000)::VARCHAR AS top,
  coalesce(source, 'unknown') || '/' || (doc_id // 1000)::VARCHAR || '/' || (doc_id % 1000 // 100)::VARCHAR AS sub FROM documents),
f AS (SELECT doc_id, body, doc_id % 100 = 0 AS is_file, CASE WHEN doc_id % 1000 = 0 THEN top ELSE sub END AS dir,
  CASE WHEN doc_id % 1000 = 0 THEN top || '/LICENSE' WHEN doc_id % 100 = 0 THEN sub || '/LICENSE' ELSE sub || '/' || doc_id::VARCHAR || '.txt' END AS path FROM t),
l AS (SELECT doc_id, generate_subscripts(s, 1) AS part, unnest(s) AS s FROM (SELECT doc_id, string_split(body, chr(10)) AS s FROM f)
  UNION ALL SELECT doc_id, 0, body FROM f WHERE is_file),
c AS (SELECT doc_id, part, term, count(*) AS tf FROM (SELECT doc_id, part, unnest(regexp_extract_all(s, '{TERM}')) AS term FROM l) GROUP BY ALL),
w AS (SELECT doc_id, part, family, term, tf * coalesce(weight, other) AS x FROM c JOIN others ON family = 0 OR part = 0 LEFT JOIN known USING (family, term)),
n AS (SELECT doc_id, part, family, sqrt(sum(x * x)) AS norm FROM w GROUP BY ALL),
dots AS (SELECT doc_id, part, family, template, license, sum(x * share) AS dot FROM w JOIN unit USING (family, term) GROUP BY ALL),
cosine AS (SELECT doc_id, license, round(dot / norm, 6) AS similarity FROM dots JOIN n USING (doc_id, part, family)),
best AS (SELECT doc_id, license, similarity FROM cosine WHERE similarity >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, license) = 1),
own AS (SELECT f.doc_id, f.path, f.dir, f.is_file, b.license, b.similarity FROM f LEFT JOIN best b USING (doc_id)),
found AS (SELECT dir AS ancestor, license AS theirs FROM own WHERE is_file AND license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, license) = 1),
up AS (SELECT o.dir, a.ancestor, a.theirs FROM (SELECT DISTINCT dir FROM own) o JOIN found a ON o.dir = a.ancestor OR starts_with(o.dir, a.ancestor || '/') OR a.ancestor = ''
  QUALIFY row_number() OVER (PARTITION BY o.dir ORDER BY length(a.ancestor) DESC) = 1)
SELECT doc_id, path, license, similarity, CASE WHEN license IS NULL THEN ancestor END AS inherited_from, coalesce(license, theirs) AS effective_license
FROM own LEFT JOIN up USING (dir)
"""
