"""License scans by diagonal voting.

Every run of ``GRAM`` words of every document is joined, by hash, to the
places where it stands in the license templates. Hits of one copy lie on one
diagonal (document position minus template position); small edits move them
to neighbouring ones. Votes are counted by diagonal, neighbouring diagonals
are merged, and a merged span counts when it holds enough of the template's
runs within a length like the template's. Only DataFrame functions run; the
templates are a fixed table, so their side of the join is broadcast.

Null and empty texts have no words and no labels. Rows with equal id and text
are one document to the vote and get the same labels each. Ties: labels are
listed once each, sorted. Very long texts are read whole. The columns added win
over clashing ones. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from answerlake.llm import common
from answerlake.llm.common import let

GRAM = 4
#: Diagonals this near are one span.
NEAR = 3
#: Least share of the template's runs, and most words of the span over the template's.
MIN_COVER, MAX_STRETCH = 0.6, 1.5

#: Phrases of the base check and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public license texts, characteristic passages (fixed values).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions:"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
                   "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
             "as published by the Free Software Foundation"),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(common.lower_ascii(text), F.lit(common.TERM), F.lit(0))


def _grams(words: Column, k: int) -> Column:
    """The hash of every run of ``k`` words; none in a shorter text."""
    return let(words, lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k))))
               .otherwise(F.array().cast("array<bigint>")))


def templates(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEMPLATES, k: int = GRAM) -> DataFrame:
    """(template, label, size, runs, at, h): the runs of each template; a fixed, small table."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(a).alias("label"), F.lit(b).alias("t")) for i, (a, b) in enumerate(texts)])
    words = spark.range(1).select(F.explode(rows).alias("r")).select("r.template", "r.label", _words(F.col("r.t")).alias("w"))
    return words.select("template", "label", F.size("w").alias("size"), (F.size("w") - (k - 1)).alias("runs"), F.posexplode(_grams(F.col("w"), k)).alias("at", "h"))


def spans(docs: DataFrame, known: DataFrame, k: int = GRAM) -> DataFrame:
    """(id, text_hash, template, label, start, stop, cover): verified spans of documents (id, text_hash, text)."""
    grams = docs.select("id", "text_hash", F.posexplode(_grams(_words(F.col("text")), k)).alias("p", "h"))
    hits = grams.join(F.broadcast(known), "h").select("id", "text_hash", "template", "label", "size", "runs", "p", "at", (F.col("p") - F.col("at")).alias("diagonal"))
    by = ["id", "text_hash", "template", "label", "size", "runs"]
    # Sets, not counts: repeated rows vote once.
    votes = hits.groupBy(*by, "diagonal").agg(F.min("p").alias("start"), (F.max("p") + k).alias("stop"), F.collect_set("at").alias("ats"))
    here = W.partitionBy(*by).orderBy("diagonal")
    group = F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(here) <= NEAR, 0).otherwise(1)).over(here)
    merged = votes.withColumn("group", group).groupBy(*by, "group").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    spans = merged.withColumn("cover", F.size("ats") / F.col("runs"))
    return (spans.filter((F.col("cover") >= MIN_COVER) & (F.col("stop") - F.col("start") <= MAX_STRETCH * F.col("size")))
            .select("id", "text_hash", "template", "label", "start", "stop", "cover"))


def _places(words: Column) -> Column:
    """(label, start) of every base phrase."""
    def starts(w: Column, phrase: str, label: str) -> Column:
        def fits(i: Column) -> Column:
            out = F.lit(True)
            for n, part in enumerate(phrase.split()):
                out = out & F.get(w, i + n).eqNullSafe(F.lit(part))
            return out
        at = F.filter(F.transform(w, lambda _, i: F.when(fits(i), i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))

    return let(words, lambda w: F.concat(*[starts(w, phrase, label) for phrase, label in PHRASES]))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row."""
    spark = common.ready(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    plain = docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = spans(plain, templates(spark))
    labels = common.stored(found.groupBy("id", "text_hash").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover")), "license-labels")
    nowhere = F.array().cast("array<struct<label:string,start:bigint>>")
    places = F.when(F.col("text").rlike("(?i)license"), _places(_words(F.col("text")))).otherwise(nowhere)
    n_words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    base = plain.select("id", "text_hash", n_words.alias("n_words"), places.alias("places"))
    both = base.join(labels.withColumnRenamed("id", "l_id").withColumnRenamed("text_hash", "l_hash"),
                     F.col("id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_hash")), "left")
    base_set = F.array_sort(F.array_distinct("places.label"))
    none = F.array().cast("array<string>")
    return both.select("id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"),
                       F.array_max("places.start").alias("last_word"), F.concat_ws(",", base_set).alias("base_labels"),
                       F.concat_ws(",", F.array_sort(F.array_union(base_set, F.coalesce("found", none)))).alias("labels"),
                       F.greatest(F.coalesce("cover", F.lit(0.0)), (F.size("places") > 0).cast("double")).alias("score"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir, "doc_id", "text")).withColumnRenamed("id", "doc_id")


def _op4_sql() -> str:
    """The same rows in DuckDB: word runs as text instead of hashes."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER x" for k in range(1, GRAM))])
    phrases = " UNION ALL ".join(
        f"SELECT r, p, '{label}' AS label FROM g WHERE " + " AND ".join(f"w{k} = '{part}'" for k, part in enumerate(phrase.split())) for phrase, label in PHRASES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words.format("coalesce(text, '')")} AS ws FROM documents),
u AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
g AS (SELECT r, p, w AS w0, lead(w, 1) OVER x AS w1, lead(w, 2) OVER x AS w2, {runs} AS g FROM u WINDOW x AS (PARTITION BY r ORDER BY p)),
t AS (SELECT i, label, {words.format("body")} AS ws FROM (VALUES {rows}) AS v(i, label, body)),
tu AS (SELECT i, label, len(ws) AS size, len(ws) - {GRAM - 1} AS runs, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS place FROM t),
tg AS (SELECT * FROM (SELECT i, label, size, runs, place, {runs} AS g FROM tu WINDOW x AS (PARTITION BY i ORDER BY place)) WHERE g IS NOT NULL),
hits AS (SELECT r, i, label, size, runs, p, place, p - place AS diagonal FROM g JOIN tg USING (g)),
votes AS (SELECT DISTINCT r, i, diagonal FROM hits),
turns AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER x <= {NEAR} THEN 0 ELSE 1 END AS turn FROM votes WINDOW x AS (PARTITION BY r, i ORDER BY diagonal)),
spans AS (SELECT r, i, diagonal, sum(turn) OVER (PARTITION BY r, i ORDER BY diagonal) AS part FROM turns),
merged AS (
  SELECT r, i, label, size, CAST(count(DISTINCT place) AS DOUBLE) / runs AS cover, min(p) AS start, max(p) + {GRAM} AS stop
  FROM hits JOIN spans USING (r, i, diagonal) GROUP BY r, i, label, size, runs, part),
found AS (SELECT r, label, cover FROM merged WHERE cover >= {MIN_COVER} AND stop - start <= {MAX_STRETCH} * size),
places AS ({phrases}),
b AS (SELECT r, count(*) AS n, min(p) AS low, max(p) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM places GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM (SELECT r, label FROM places UNION ALL SELECT r, label FROM found) GROUP BY r),
best AS (SELECT r, max(cover) AS cover FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.low AS BIGINT) AS first_word, CAST(b.high AS BIGINT) AS last_word,
  coalesce(b.names, '') AS base_labels, coalesce(every.names, '') AS labels, greatest(coalesce(best.cover, 0.0), CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)
"""


OP4_SQL = _op4_sql()
