"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8
PASS_SHINGLES = 1 << 16  # of the templates of one pass, which are literals of its plan; more templates are more passes
#: (shingles of a window, bands of one MinHash each, shingles from one window of a template to the next). A document's
#: windows begin at every half window, the largest ones at every eighth. Of a template's text with containment c some
#: window has local containment c at least: 4 of 4 shingles, 13 of 16, or 47 of 64 where both grids lie worst.
WINDOWS = ((1, 1, 1), (4, 1, 1), (16, 6, 1), (64, 6, 8))
BLOCK = 8  # shingles from one window of the largest size to the next
WHOLE_TEXTS = Path(__file__).with_name("licence_texts")  # whole licences, one a file, as Debian's base-files has them

#: Notices and short licences as their publishers word them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
        " copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT"
        " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
        " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION"
        " OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
        " DEALINGS IN THE SOFTWARE."
    ),
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list"
        " of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
        " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided"
        " with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS"
        " OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
        " PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,"
        " INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF"
        " SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY"
        " THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN"
        " ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-third-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS"
        " PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED"
        " WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,"
        " OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION"
        " OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF"
        " THIS SOFTWARE."
    ),
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with"
        " the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by"
        " applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language"
        " governing permissions and limitations under the License."
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later"
        " version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more"
        " details."
    ),
    "agpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version."
    ),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)"
        " any later version."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def whole_texts(folder: str | Path = WHOLE_TEXTS) -> dict[str, str]:
    """Licences of a folder of text files on the driver, by file name. Links are left out. A folder that is missing or has
    no files, a file that is not UTF-8 or two names that differ in case only are errors: fewer templates would find less
    and look like a result."""
    files = sorted(f for f in Path(folder).iterdir() if f.is_file() and not f.is_symlink())
    out = {f"{f.name.lower()}-text": f.read_text(encoding="utf-8") for f in files}
    if not files or len(out) < len(files):
        raise ValueError(f"no licences in {folder}" if not files else f"files of one name in {folder}")
    return out


def collision_probability(bands: int, similarity: float) -> float:
    """That two windows of this Jaccard similarity share a band of one MinHash."""
    return 1 - (1 - similarity) ** bands


def window_class(shingles: int) -> int:
    """The largest window of WINDOWS that lies, wherever the half-overlapping grid falls, inside the template."""
    return max(w for w, _, _ in WINDOWS if w == 1 or shingles >= w + w // 2 - 1)


def _mask(band: int) -> int:
    """Hashes order differently under each mask; the least one of a set is a MinHash."""
    return ((band * 0x9E3779B97F4A7C15 + 0x1234567) & (1 << 64) - 1) - (1 << 63)


def listed(values: list, kind: str = "array<bigint>") -> Column:
    """A literal array of any length, folded once."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def words_of(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.split(clean, " ")


def shingle_hashes(words: Column) -> Column:
    """xxhash64 of each run of SHINGLE_WORDS words; none for shorter texts."""
    last = F.size(words) - SHINGLE_WORDS
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE_WORDS)]))


def block_minima(h: Column, size: int, mask: int) -> Column:
    """The least masked hash of each run of size/2 shingles."""
    step = size // 2
    blocks = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.floor((F.size(h) - 1) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(blocks, lambda b: F.array_min(F.transform(F.slice(h, b * step + 1, F.lit(step)), lambda v: v.bitwiseXOR(F.lit(mask)))))


def with_window_keys(hashed: DataFrame) -> DataFrame:
    """hashed with columns keys_<class>: MinHashes, by band, of overlapping windows.

    Block minima are columns first, for an expression inside a lambda is evaluated for each element. The largest
    windows are made of the 16-shingle windows' blocks of BLOCK shingles: minima over two, four, then eight of them.
    """
    low = {(size, band): f"low_{size}_{band}" for size, bands, _ in WINDOWS if 1 < size < 64 for band in range(bands)}
    blocks = hashed.select("*", *[block_minima(F.col("h"), size, _mask(band)).alias(name) for (size, band), name in low.items()])

    def minima(name: str, step: int = 1) -> Column:
        return F.transform(name, lambda x, i: F.least(x, F.get(F.col(name), i + step)))

    large = dict(enumerate(low[16, b] for b in range(WINDOWS[3][1])))
    wide = blocks
    for step in (1, 2, 4):
        wide = wide.select("*", *[F.when(F.size("h") >= 64, minima(name if step == 1 else f"wide_{step}_{b}", step)).otherwise(F.array().cast("array<bigint>")).alias(f"wide_{2 * step}_{b}") for b, name in large.items()])
    keys = {1: F.col("h"), 64: F.concat(*[F.col(f"wide_8_{b}") for b in large])}
    keys |= {size: F.concat(*[minima(low[size, b]) for b in range(bands)]) for size, bands, _ in WINDOWS if 1 < size < 64}
    return wide.select(*hashed.columns, *[keys[size].alias(f"keys_{size}") for size, _, _ in WINDOWS])


def template_keys(spark: SparkSession, templates: Mapping[str, str]) -> dict[str, tuple[list[int], list[list[int]]]]:
    """By name: the distinct shingle hashes, and per class of WINDOWS the keys of its windows."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    out = {}
    for r in rows.select("name", words_of(F.col("text")).alias("words")).select("name", shingle_hashes(F.col("words")).alias("h")).collect():
        h = list(r["h"])
        if not h:
            raise ValueError(f"template {r['name']} has fewer than {SHINGLE_WORDS} words")
        cls = window_class(len(h))
        keys = []
        for size, bands, stride in WINDOWS:
            at = sorted({*range(0, len(h) - size + 1, stride), len(h) - size}) if size == cls else ()
            keys.append(sorted({h[i] for i in at} if size == 1 else {min(v ^ _mask(b) for v in h[i : i + size]) for i in at for b in range(bands)}))
        out[r["name"]] = (sorted(set(h)), keys)
    return out


def _scan(hashed: DataFrame, known: dict[str, tuple[list[int], list[list[int]]]], least: float) -> DataFrame:
    """One pass for templates that are literals of the plan."""
    names = sorted(known)
    keyed = with_window_keys(hashed)
    hits = []
    for c, (size, _, _) in enumerate(WINDOWS):
        keys = sorted({k for n in names for k in known[n][1][c]})
        if keys:
            hits.append(F.when(F.size(f"keys_{size}") > 0, F.array_intersect(f"keys_{size}", listed(keys))).otherwise(F.array().cast("array<bigint>")))
    found = keyed.select("doc_id", "h", F.concat(*hits).alias("hits"))
    owned = listed([sorted({k for c in known[n][1] for k in c}) for n in names], "array<array<bigint>>")
    own = F.filter(F.array(*[F.lit(i) for i in range(len(names))]), lambda i: F.arrays_overlap(F.get(owned, i), F.col("hits")))
    # outer: the optimiser would push a test of the array's size below, with all that makes the array repeated in it
    candidates = found.select("doc_id", "h", F.explode_outer(F.when(F.size("hits") > 0, own)).alias("i")).where("i is not null")
    wanted = F.get(listed([known[n][0] for n in names], "array<array<bigint>>"), F.col("i"))
    return (
        candidates.select("doc_id", F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("license"), F.size(wanted).alias("n_shingles"), F.size(F.array_intersect(wanted, F.col("h"))).alias("n_found"))
        .withColumn("containment", F.col("n_found") / F.col("n_shingles"))
        .where(F.col("containment") >= least)
    )


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = MIN_CONTAINMENT) -> DataFrame:
    """A row for each document and template it contains: doc_id, license, n_shingles, n_found, containment.

    Words are runs of letters and digits, in lower case; containment is the share of the template's
    distinct five-word shingles (by 64-bit hash) that the document has. Everything happens inside a row: no shuffle,
    and a document's cost is in proportion to its length. Templates may have any length and number: passes of about
    PASS_SHINGLES shingles hold them all.
    Cases: a null text or one of fewer than five words matches nothing; a null doc_id stays null;
    equal rows give equal rows; a template found twice is one row; other columns are ignored;
    empty in, empty out; a template of fewer than five words is an error.
    """
    known = template_keys(spark, templates)
    passes: list[dict] = [{}]
    size = 0
    for name in sorted(known):
        if passes[-1] and size + len(known[name][0]) > PASS_SHINGLES:
            passes.append({})
            size = 0
        passes[-1][name] = known[name]
        size += len(known[name][0])
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words")).select("doc_id", shingle_hashes(F.col("words")).alias("h"))
    return reduce(DataFrame.unionAll, [_scan(hashed, p, least) for p in passes])


def production_templates() -> dict[str, str]:
    """The notices and short licences above, and the whole licences beside this file: the same on every machine."""
    return TEMPLATES | whole_texts()


def op6_minhash_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, documents(spark, sf_dir), production_templates())


def _template_values() -> str:
    return ", ".join(f"('{name}', '{re.sub(r'[\W_]+', ' ', text.lower()).strip()}')" for name, text in sorted(production_templates().items()))


OP6_SQL = rf"""
WITH t0(license, text) AS (VALUES {_template_values()}),
t1 AS (SELECT license, string_split(text, ' ') AS w FROM t0),
t2 AS (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM t1),
t AS (SELECT DISTINCT license, array_to_string(w[i:i+4], ' ') AS s FROM t2),
size AS (SELECT license, count(*) AS n FROM t GROUP BY license),
d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM p)
SELECT doc_id, license, CAST(any_value(n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_found, count(*) / any_value(n) AS containment
FROM g JOIN t USING (s) JOIN size USING (license) GROUP BY doc_id, license HAVING count(*) >= 0.8 * any_value(n)
"""
