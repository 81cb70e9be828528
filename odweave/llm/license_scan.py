"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

Templates are grouped by length. For a group of templates of up to L shingles, texts are cut into
windows of 2L shingles, one every L/2, so that a passage with up to half as many shingles again as
L lies within one window. Windows and templates are hashed to MinHash values; a band is one value, and
there are as many bands as the wanted collision probability needs. Windows that collide with a template
are verified: the share of the template's distinct shingles that the window holds must reach the limit.
Everything is DataFrame functions.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a shingle, least containment, and the probability with which bands may miss a match.
SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-4
#: Template rows (one per template and band) up to which they are broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 100_000

# Notices and passages of public licences, as their publishers word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def shingles_of(words: list[str], k: int = SHINGLE) -> list[str]:
    """k-word shingles; of fewer words, the whole sequence; of none, none."""
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def bands_for(similarity: float, miss: float = MISS) -> int:
    """Bands of one MinHash value for which two sets of this Jaccard similarity all differ with a probability of at most `miss`."""
    return math.ceil(math.log(miss) / math.log1p(-similarity))


def templates_of(table: DataFrame, name: str = "license", text: str = "text") -> dict[str, str]:
    """Templates from a table of licences. It is gathered: the scales are planned from it. Rows without name or text are left out; of a repeated name the last text counts."""
    return {r[0]: r[1] for r in table.select(name, text).dropna().orderBy(name, text).toLocalIterator()}


def plan_scales(templates: dict[str, str], k: int = SHINGLE, containment: float = CONTAINMENT) -> list[dict]:
    """By template length: the templates with their distinct shingles, window and stride in shingles, and bands."""
    groups: dict[int, list[tuple[str, list[str]]]] = {}
    for name, text in templates.items():
        sh = list(dict.fromkeys(shingles_of(words_of(text), k)))
        if sh:
            groups.setdefault(1 << (len(sh) - 1).bit_length(), []).append((name, sh))
    scales = []
    for size, members in sorted(groups.items()):
        stride, window = max(1, size // 2), 2 * size
        least = min(len(sh) for _, sh in members) * containment
        scales.append({"size": size, "window": window, "stride": stride, "bands": bands_for(least / (window + least * (1 / containment - 1))), "templates": members})
    return scales


def _anchors(scales: list[dict], containment: float) -> list[str]:
    """Words such that a text without any of them holds too few shingles of every template."""
    found: list[str] = []
    for name, sh in (t for s in scales for t in s["templates"]):
        left = [set(x.split(" ")) for x in sh if not set(x.split(" ")) & set(found)]
        while len(left) >= containment * len(sh):
            most: dict[str, int] = {}
            for x in left:
                for w in x:
                    most[w] = most.get(w, 0) + 1
            word = max(most, key=lambda w: (len(w) > 6, most[w], len(w), w))  # long words are rare in other texts
            found.append(word)
            left = [x for x in left if word not in x]
    return found


def _shingles(words: Column, k: int) -> Column:
    """Distinct k-word shingles of an array of words that isn't empty."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (k - 1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " ")))


def _banded(df: DataFrame, shingles: str) -> DataFrame:
    """df once for each band, with the band and its MinHash value. Column `bands` says how many there are."""
    hashes = F.transform(shingles, lambda x: F.xxhash64(x))
    keys = F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda b: F.struct(b.alias("band"), F.array_min(F.transform("_hashes", lambda h: F.xxhash64(h, b))).alias("value")))
    return df.withColumn("_hashes", hashes).withColumn("_k", F.explode(keys)).select(*df.columns, "_k.band", "_k.value")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and licence found: key, license, containment (of the best window), first_word (where the first such window starts) and n_windows.

    Null, empty and wordless texts hold no licence; texts of fewer than k words are one shingle. Very long
    texts give more windows and nothing is cut. Documents whose key is repeated are scanned one by one and
    reported together; an empty table gives no rows, nor do templates without words. Columns of other names are ignored.
    """
    spark = docs.sparkSession
    scales = plan_scales(TEMPLATES if templates is None else templates, k, containment)
    if not scales:
        return spark.createDataFrame([], f"{key} {dict(docs.dtypes)[key]}, license string, containment double, first_word long, n_windows long")
    anchors = _anchors(scales, containment)
    some = F.array(*[F.lit(a) for a in anchors])
    # No match is without an anchor, so this loses none; it spares most texts the cutting into words, and most windows the hashing.
    rough = docs.select(F.col(key).alias("_key"), F.lower(F.col(text)).alias("_low")).filter(F.col("_low").rlike("|".join(re.escape(a) for a in anchors)))
    rows = rough.select("_key", F.filter(F.split("_low", r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("_w")).filter(F.arrays_overlap("_w", some))

    scale = F.array(*[F.struct(*[F.lit(s[n]).alias(n) for n in ("size", "window", "stride", "bands")]) for s in scales])
    rows = rows.withColumn("_s", F.explode(scale)).select("_key", "_w", "_s.*")
    shingles = F.greatest(F.lit(1), F.size("_w") - (k - 1))
    last = F.greatest(F.lit(0), F.ceil((shingles - F.col("window")) / F.col("stride")).cast("int"))
    # Windows are cut before they become rows, so that no row carries a whole text.
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * F.col("stride")).alias("at"), F.slice("_w", i * F.col("stride") + 1, F.col("window") + (k - 1)).alias("w")))
    windows = rows.select("_key", "size", "bands", F.explode(F.filter(cut, lambda p: F.arrays_overlap(p["w"], some))).alias("_p")).select("_key", "size", "bands", "_p.*")
    windows = windows.select("_key", "at", "size", "bands", _shingles(F.col("w"), k).alias("sh"))

    listed = F.array(*[F.struct(F.lit(s["size"]).alias("size"), F.lit(s["bands"]).alias("bands"), F.lit(name).alias("license"), F.lit("\x1f".join(sh)).alias("_t")) for s in scales for name, sh in s["templates"]])
    known = spark.range(1).select(F.explode(listed).alias("_x")).select("_x.*").withColumn("template", F.split("_t", "\x1f")).drop("_t")
    right = _banded(known, "template").drop("bands")
    if sum(len(s["templates"]) * s["bands"] for s in scales) <= BROADCAST_ROWS:
        right = F.broadcast(right)
    near = _banded(windows, "sh").join(right, ["size", "band", "value"])
    held = near.select("_key", "at", "license", (F.size(F.array_intersect("template", "sh")) / F.size("template")).alias("c")).filter(F.col("c") >= containment)
    once = held.groupBy("_key", "license", "at").agg(F.max("c").alias("c"))
    best = once.groupBy("_key", "license").agg(F.max("c").alias("containment"), F.min("at").cast("long").alias("first_word"), F.count("*").alias("n_windows"))
    return best.withColumnRenamed("_key", key)


def oracle(templates: dict[str, str] | None = None, k: int = SHINGLE, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for the rows of scan_licenses(): every window against every template, without bands."""
    scales = plan_scales(TEMPLATES if templates is None else templates, k, containment)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(name)}, {quote(x)}, {len(sh)}, {s['window']}, {s['stride']})" for s in scales for name, sh in s["templates"] for x in sh)
    return f"""
WITH t(license, sh, n_sh, win, stride) AS (VALUES {rows}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, greatest(1, len(w) - {k - 1}) AS n, unnest(range(0, greatest(1, len(w) - {k - 1}))) AS pos, w FROM w WHERE len(w) > 0),
h AS (SELECT s.doc_id, s.n, s.pos, t.* FROM s JOIN t ON array_to_string(w[pos + 1:pos + {k}], ' ') = t.sh),
i AS (SELECT *, unnest(range(greatest(0, (pos - win) // stride), pos // stride + 1)) AS win_no FROM h),
c AS (SELECT doc_id, license, win_no * stride AS at_word, count(DISTINCT sh) / max(n_sh) AS c FROM i
      WHERE pos >= win_no * stride AND pos < win_no * stride + win AND win_no <= greatest(0, CAST(ceil((n - win) / stride) AS BIGINT)) GROUP BY ALL)
SELECT doc_id, license, max(c) AS containment, min(at_word)::BIGINT AS first_word, count(*) AS n_windows FROM c WHERE c >= {containment} GROUP BY doc_id, license"""
