"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

Templates and texts are sequences of shingles (``SHINGLE`` words; a shorter template is one shingle of
its own length). Templates are classed by span S, the power of two at or above their number of
shingles; windows of 2 S shingle positions begin every S positions, so every occurrence lies whole in
one. A window's band is the least of its shingles' hashes under the band's own hash function, and a
window retrieves the templates of its class with which any band agrees. The number of bands is
derived: a window that holds ``containment`` of a template is missed with a chance of at most ``miss``.
Retrieved templates are verified: the share of the template's distinct shingles in the window is
counted exactly.

A band can only agree if the window has the shingle that gives the template its least hash. So only
windows with such a shingle get their bands computed, always from all the window's shingles; all other
windows' bands are known to agree with nothing. Those shingles (one per template and band at most) are
told from others by two bitmaps in the plan and then exactly.

Cases: null and empty texts match nothing. A text with fewer words than a template's shingle can't
match it. Repeated rows get rows of their own. Other columns of any name are not read. Templates
without words are left out; without templates, or for an empty table, the result is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held

SHINGLE, BROADCAST = 5, 500_000

#: Notices that are looked for: fixed texts of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


def bands(least: float, miss: float) -> int:
    """Bands of one row each that miss a pair of similarity ``least`` with a chance of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - least))


def similarity(containment: float, shingles: int, span: int) -> float:
    """Least Jaccard similarity of a window (2 S shingles at most) and a template of which it holds ``containment``."""
    return containment * shingles / (2 * span + shingles * (1 - containment))


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, size: int) -> Column:
    """Hashes of the shingles of an array of words, by position."""
    made = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
    return F.when(F.size(w) >= size, made).otherwise(F.array().cast("array<bigint>"))


def signature(values: Column, n: int) -> Column:
    """For each of n bands the struct (least: its least hash over an array of shingles, h: the shingle that has it)."""
    of = lambda b: F.array_min(F.transform(values, lambda h: F.struct(F.xxhash64(h, b).alias("least"), h.alias("h"))))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of)


def _templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(license_id, size: words in a shingle, span: S, hashes)."""
    rows = spark.createDataFrame(list(texts.items()), "license_id string, text string").withColumn("w", words(F.col("text"))).where(F.size("w") > 0)
    size = F.least(F.lit(SHINGLE), F.size("w"))
    hashes = F.coalesce(*(F.when(size == k, F.array_distinct(shingles(F.col("w"), k))) for k in range(1, SHINGLE + 1)))
    places = F.greatest(F.size("w") - SHINGLE + 1, F.lit(1))
    return rows.select("license_id", size.alias("size"), F.pow(F.lit(2), F.ceil(F.log2(places))).cast("int").alias("span"), hashes.alias("hashes"))


class _Known:
    """Tells the shingles in ``hashes`` from others: two bits of bitmaps 64 times sparser than full, then the list."""

    def __init__(self, hashes: set[int]):
        self.width = max(12, (64 * len(hashes)).bit_length())
        self.hashes = F.lit(sorted(hashes)).cast("array<bigint>")
        self.maps = []
        for shift in (64 - self.width, 0):
            cells = [0] * (1 << self.width - 6)
            for h in hashes:
                bit = (h >> shift) & (1 << self.width) - 1
                cells[bit >> 6] |= 1 << (bit & 63)
            signed = [c - (1 << 64) if c >> 63 else c for c in cells]
            self.maps.append((shift, F.lit(signed).cast("array<bigint>")))

    def maybe(self, h: Column) -> Column:
        def one(shift: int, cells: Column) -> Column:
            bit = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << self.width) - 1).cast("long"))
            return F.getbit(F.get(cells, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

        return one(*self.maps[0]) & one(*self.maps[1])


def scan(docs: DataFrame, texts: dict[str, str] | None = None, containment: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """doc_id, license_id, containment (best window's), first_word (of the first matching window's first template shingle), n_windows."""
    spark = docs.sparkSession
    rows = _templates(spark, TEMPLATES if texts is None else texts).collect()  # the templates are the caller's parameter
    if not rows:
        return docs.select("doc_id", F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"), F.lit(0).cast("long").alias("n_windows")).where(F.lit(False))
    n = bands(min(similarity(containment, len(r["hashes"]), r["span"]) for r in rows), miss)
    shape = "license_id string, size int, span int, hashes array<bigint>"
    rows = spark.createDataFrame(rows, shape).withColumn("signature", signature(F.col("hashes"), n)).collect()
    templates = spark.createDataFrame(rows, f"{shape}, signature array<struct<least:bigint,h:bigint>>")
    classes = sorted({(r["size"], r["span"]) for r in rows})
    sizes = sorted({k for k, _ in classes})
    known = {k: _Known({b["h"] for r in rows if r["size"] == k for b in r["signature"]}) for k in sizes}

    own = docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id()).withColumn("w", words(F.col("text"))).drop("text")
    own = own.select("uid", "doc_id", held({f"h{k}": shingles(F.col("w"), k) for k in sizes}))

    def places(k: int) -> Column:
        """Positions of the text's shingles of k words that give a template a band; usually none."""
        h = F.col(f"h{k}")
        maybe = F.filter(F.transform(h, lambda x, i: F.when(known[k].maybe(x), F.struct(i.alias("i"), x.alias("h")))), lambda s: s.isNotNull())
        sure = F.transform(F.filter(maybe, lambda s: F.array_contains(known[k].hashes, s["h"])), lambda s: s["i"])
        return F.when(F.exists(h, known[k].maybe), sure).otherwise(F.array().cast("array<int>"))

    def windows(k: int, span: int) -> Column:
        """The class's windows that have such a shingle, each with all its shingles (at most 2 S, whatever the text)."""
        first = lambda i: F.floor(i / span).cast("int")
        numbers = F.array_distinct(F.flatten(F.transform(f"p{k}", lambda i: F.array(first(i), F.greatest(first(i) - 1, F.lit(0))))))
        return F.transform(numbers, lambda x: F.struct(F.lit(k).alias("size"), F.lit(span).alias("span"), x.alias("window"), F.slice(F.col(f"h{k}"), x * span + 1, 2 * span).alias("hashes")))

    found = own.select("*", held({f"p{k}": places(k) for k in sizes})).where(" or ".join(f"size(p{k}) > 0" for k in sizes))
    found = found.select("uid", "doc_id", F.explode(F.concat(*(windows(*c) for c in classes))).alias("x")).select("uid", "doc_id", "x.*")
    banded = found.select("*", F.posexplode(F.transform(signature(F.col("hashes"), n), lambda b: b["least"])).alias("band", "least"))
    index = templates.select("license_id", "size", "span", F.posexplode(F.transform("signature", lambda b: b["least"])).alias("band", "least"))
    # a row of some 50 bytes per template and band; of more than BROADCAST, windows are shuffled to them
    few = F.broadcast if n * len(rows) <= BROADCAST else (lambda df: df)
    met = banded.join(few(index), ["size", "span", "band", "least"]).drop("band", "least").dropDuplicates(["uid", "size", "span", "window", "license_id"])
    met = met.join(templates.select("license_id", F.col("hashes").alias("template")), "license_id")
    share = F.size(F.array_intersect("hashes", "template")) / F.size("template")
    at = F.array_min(F.filter(F.transform("hashes", lambda h, i: F.when(F.array_contains("template", h), i)), lambda i: i.isNotNull()))
    matches = met.withColumn("containment", share).where(F.col("containment") >= containment).withColumn("first_word", F.col("window") * F.col("span") + at)
    best = matches.groupBy("uid", "doc_id", "license_id").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.count(F.lit(1)).alias("n_windows"))
    return best.select("doc_id", "license_id", F.round("containment", 6).alias("containment"), "first_word", "n_windows")


def op3(docs: DataFrame) -> DataFrame:
    return scan(docs)


def _oracle() -> str:
    """Every window against every template, without bands, as DuckDB SQL."""
    rows = ", ".join(f"""('{k}', '{v.replace("'", "''")}')""" for k, v in TEMPLATES.items())
    return rf"""WITH tpl AS (SELECT * FROM (VALUES {rows}) AS t(license_id, text)),
  tw AS (SELECT license_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM tpl),
  cls AS (SELECT license_id, w, least({SHINGLE}, len(w))::BIGINT AS size, pow(2, ceil(log2(greatest(len(w) - {SHINGLE - 1}, 1))))::BIGINT AS span FROM tw),
  ts AS (SELECT DISTINCT license_id, size, span, array_to_string(w[i:i + size - 1], ' ') AS s FROM cls, unnest(range(1, len(w) - size + 2)) AS r(i)),
  n AS (SELECT license_id, count(*) AS n FROM ts GROUP BY license_id),
  d AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
  ds AS (SELECT uid, doc_id, size, i - 1 AS i, array_to_string(w[i:i + size - 1], ' ') AS s FROM d, (SELECT DISTINCT size FROM cls), unnest(range(1, len(w) - size + 2)) AS r(i)),
  hit AS (SELECT uid, doc_id, license_id, span, i, s FROM ds JOIN ts USING (size, s)),
  win AS (SELECT DISTINCT uid, doc_id, license_id, span, i, s, unnest([i // span, greatest(i // span - 1, 0)]) AS k FROM hit),
  m AS (SELECT uid, doc_id, license_id, k, count(DISTINCT s) / any_value(n.n)::DOUBLE AS c, min(i) AS i FROM win JOIN n USING (license_id) GROUP BY uid, doc_id, license_id, k)
SELECT doc_id, license_id, round(max(c), 6) AS containment, min(i)::INTEGER AS first_word, count(*) AS n_windows FROM m WHERE c >= 0.8 GROUP BY uid, doc_id, license_id"""


#: The same as DuckDB SQL.
ORACLE = _oracle()
