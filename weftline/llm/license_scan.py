"""Licence scans: lines and whole texts against licence templates; DataFrame functions only.

A text is normalised to lower-case words of letters and digits. Two texts are compared by the Dice coefficient of
their sets of word bigrams, 2 * |A and B| / (|A| + |B|). For a coefficient of at least t the sizes must satisfy
|A| <= |B| * (2 - t) / t and the reverse, so a template is only compared with candidates of fitting size: each line
with the short notices, the whole text with the full licences. Both kinds of candidates are kept in the row; there is
no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.quality import bound

#: Least Dice coefficient of a match, in hundredths.
LEAST = 80

# Short notices of public licences (several wordings may share a name).
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "Released under the GNU General Public License v3.0."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)
# Full texts, compared with whole documents.
LICENCES = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = "[^a-z0-9]+"


def bigrams_of(text: str) -> list[str]:
    """Sorted distinct word bigrams of a template; one word stands for itself."""
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))}) if words else []


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAP, -1), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) >= 2, F.array_distinct(pairs)).otherwise(words)


def _templates(rows) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, bigrams_of(text))).alias("b")) for name, text in rows))


def _limits(rows, least: int) -> tuple[int, int]:
    """Bigram set sizes beyond which no template can match."""
    sizes = [len(bigrams_of(text)) for _, text in rows]
    return -(-min(sizes) * least // (200 - least)), max(sizes) * (200 - least) // least


def _best(pairs: Column, templates: Column, least: int) -> Column:
    """The best match of a bigram set: struct(score in millionths, name), or null; equal scores go to the later name."""

    def against(t: Column) -> Column:
        n, m = F.size(pairs), F.size(t["b"])
        fits = (n * least <= m * (200 - least)) & (m * least <= n * (200 - least))
        common = F.when(fits, F.size(F.array_intersect(pairs, t["b"])))
        return bound(common, lambda c: F.when(200 * c >= least * (n + m), F.struct((2_000_000 * c.cast("long") / (n + m)).cast("long").alias("score"), t["name"].alias("name"))))

    return F.array_max(F.filter(F.transform(templates, against), lambda x: x.isNotNull()))


def scan(documents: DataFrame, notices=NOTICES, licences=LICENCES, least: int = LEAST) -> DataFrame:
    """Per document row: doc_id, n_lines (matching a notice), licences (sorted names), best, best_score (Dice, 0 without a match).

    A null or empty text matches nothing. Repeated rows repeat their result; further columns are ignored.
    """
    low, high = _limits(notices, least)
    whole_low, whole_high = _limits(licences, least)
    text = F.coalesce(F.col("text"), F.lit(""))
    # a line of k words has at most k - 1 bigrams but may have fewer, so only the lower bound prunes before they are made;
    # the bytes of a line bound its words from above, and lines without room for the words are skipped first
    notices_, licences_ = _templates(notices), _templates(licences)

    def line(x: Column) -> Column:
        def judged(w: Column) -> Column:
            return F.when(F.size(w) >= max(1, low), bound(_bigrams(w), lambda b: F.when(F.size(b) <= high, F.element_at(F.transform(F.array(notices_), lambda t: _best(b, t, least)), 1))))

        return F.when(F.length(x) >= 2 * low, bound(_words(x), judged))

    lines = F.filter(F.transform(F.split(text, "\n", -1), line), lambda x: x.isNotNull())
    whole = F.when(
        F.length(text) >= 2 * whole_low,
        bound(_words(text), lambda w: F.when(F.size(w) >= whole_low, bound(_bigrams(w), lambda b: F.when(F.size(b) <= whole_high, F.element_at(F.transform(F.array(licences_), lambda t: _best(b, t, least)), 1))))),
    )
    found = documents.select("doc_id", lines.alias("lines"), whole.alias("whole"))
    every = F.filter(F.concat("lines", F.array("whole")), lambda x: x.isNotNull())
    found = found.select("doc_id", F.size("lines").cast("long").alias("n_lines"), every.alias("every"))
    best = F.array_max("every")
    return found.select(
        "doc_id", "n_lines", F.array_join(F.array_sort(F.array_distinct(F.transform("every", lambda x: x["name"]))), ",").alias("licences"), best["name"].alias("best"), F.coalesce(best["score"] / F.lit(1e6), F.lit(0.0)).alias("best_score")
    )


def oracle(notices=NOTICES, licences=LICENCES, least: int = LEAST) -> str:
    """The same result in DuckDB SQL over `documents`."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({kind}, {k}, {quote(name)}, [{', '.join(map(quote, bigrams_of(text)))}])" for kind, rows in ((0, notices), (1, licences)) for k, (name, text) in enumerate(rows))
    return f"""
WITH templates(kind, k, name, b) AS (VALUES {values}),
parts AS (
    SELECT doc_id, 0 AS kind, unnest(string_split(coalesce(text, ''), chr(10))) AS part FROM documents
    UNION ALL SELECT doc_id, 1, coalesce(text, '') FROM documents
), numbered AS (SELECT row_number() OVER () AS id, doc_id, kind, regexp_extract_all(translate(part, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') AS w FROM parts),
sets AS (
    SELECT id, doc_id, kind, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS b
    FROM numbered WHERE len(w) > 0 AND len(w) <= 1000000
), scored AS (
    SELECT s.id, s.doc_id, s.kind, t.name, len(list_intersect(s.b, t.b)) AS c, len(s.b) + len(t.b) AS total
    FROM sets AS s JOIN templates AS t ON s.kind = t.kind AND len(s.b) * {least} <= len(t.b) * {200 - least} AND len(t.b) * {least} <= len(s.b) * {200 - least}
), best AS (
    SELECT id, doc_id, kind, max({{'score': 2000000 * c // total, 'name': name}}) AS m FROM scored WHERE 200 * c >= {least} * total GROUP BY id, doc_id, kind
), per AS (
    SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_lines, string_agg(DISTINCT m.name, ',' ORDER BY m.name) AS licences, max(m) AS top FROM best GROUP BY doc_id
)
SELECT d.doc_id, coalesce(p.n_lines, 0)::BIGINT AS n_lines, coalesce(p.licences, '') AS licences, p.top.name AS best, coalesce(p.top.score / 1e6, 0.0)::DOUBLE AS best_score
FROM documents AS d LEFT JOIN per AS p USING (doc_id)
"""
