"""License scans: Dice coefficient over word bigrams between normalised text and license templates.

Texts are lower-cased, every run of other than letters and digits becomes a blank, and what is left are words, whatever
lines they stood on. A template of n words is compared with spans of n words: Dice is twice the shared distinct bigrams
over the sum of both sides' distinct bigrams. Templates are short notices, headers and whole license texts.

Size bounds prune: a span that reaches Dice t shares at least t / (2 - t) of the template's bigrams. So it misses at most
the others, and has one of any choice of one bigram more than that; documents without a word of any such bigram go first.
Then only spans are tried in which so many places hold a bigram of the template, found from the sorted places: every span
that can reach the threshold is tried, wherever words were inserted, left out or changed. A document of fewer words than
a template is compared as a whole, however long a document is, all of its places count.

For each license the best span of a document counts (the earliest among equals), unless a span of another license that
overlaps it shares more bigrams (among equals: has the higher Dice, then the first name), so that a whole header comes
before the short notice inside it. Any number of templates may be given. DataFrame functions only.

Null and empty texts match nothing. Rows are independent: repeated and null doc_ids are reported each. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Notices, headers and texts of public licenses.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}
as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should
have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-header": GPL_HEADER.format(name="Affero General Public License", version="3"),
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "bsd-2-clause": "Released under the BSD 2-Clause License.",
    "bsd-2-clause-text": f"{BSD_TERMS} {BSD_END}",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "bsd-3-clause-text": f"{BSD_TERMS} {BSD_NAMES} {BSD_END}",
    "bsl-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following:""",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "Released into the public domain under CC0 1.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": GPL_HEADER.format(name="General Public License", version="2"),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": GPL_HEADER.format(name="General Public License", version="3"),
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-header": GPL_HEADER.format(name="Lesser General Public License", version="3"),
    "mit": "Released under the MIT License.",
    "mit-text": MIT,
    "mpl-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution.""",
}
THRESHOLD = 0.8
SMALL = 1_000_000  # bigrams of all templates up to which they are broadcast; more are shuffled
MANY = 5_000  # words up to which documents are filtered by them before their bigrams are looked up


def words_of(text: str) -> list[str]:
    return re.sub(r"[^\w]|_", " ", text.lower()).split()


def anchors_of(text: str, threshold: float) -> list[str]:
    """Bigrams, the longest ones, of which a span that reaches the threshold has at least one."""
    words = words_of(text)
    grams = {" ".join(p) for p in zip(words, words[1:])}
    missing = int(len(grams) * (1 - threshold / (2 - threshold)) + 1e-9)
    return sorted(grams, key=lambda g: (-len(g), g))[: missing + 1]


def _bigrams(words):
    """The bigrams of an array of words, repeats included; none of fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start, n_words, dice): the best span of each license in each document."""
    templates = {k: v for k, v in sorted((TEMPLATES if templates is None else templates).items()) if len(words_of(v)) > 1}
    spark = docs.sparkSession
    rows = [(k, len(words_of(v)), sorted({" ".join(p) for p in zip(words_of(v), words_of(v)[1:])})) for k, v in templates.items()]
    rows = [(k, n, max(1, math.ceil(len(g) * threshold / (2 - threshold) - 1e-9)), g) for k, n, g in rows]
    known = spark.createDataFrame(rows, "license string, n int, least int, grams array<string>")
    cells = known.select("license", F.explode("grams").alias("gram"))
    if sum(len(r[3]) for r in rows) <= SMALL:
        known, cells = F.broadcast(known), F.broadcast(cells)

    words = F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ", -1), "")
    texts = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    needles = sorted({max(g.split(), key=lambda w: (len(w), w)) for v in templates.values() for g in anchors_of(v, threshold)})
    if len(needles) <= MANY:
        texts = texts.filter(F.arrays_overlap("words", F.array(*map(F.lit, needles)).cast("array<string>")))
    texts = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").alias("size"), _bigrams(F.col("words")).alias("pairs"))
    texts = stored(texts, "license-texts")

    hits = texts.select("row", F.posexplode("pairs").alias("at", "gram")).join(cells, "gram")
    places = hits.groupBy("row", "license").agg(F.sort_array(F.collect_list("at")).alias("at")).join(known, "license").filter(F.size("at") >= F.col("least"))
    each = texts.join(places, "row").withColumn("long", F.least("n", "size"))

    def starts(j):
        """Starts of the spans whose first place is the j-th and that hold enough places."""
        after = F.when(j > 0, F.get("at", j - 1) + 1).otherwise(0)
        low = F.greatest(after, F.get("at", j + F.col("least") - 1) - F.col("long") + 2)
        high = F.least(F.get("at", j), F.col("size") - F.col("long"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def judged(start):
        own = F.array_distinct(F.slice("pairs", start + 1, F.col("long") - 1))
        one = F.transform(F.array(own), lambda o: F.struct(F.size(F.array_intersect(o, "grams")).alias("shared"), F.size(o).alias("own")))
        return F.transform(one, lambda c: F.struct((c["shared"] * -2.0 / (c["own"] + F.size("grams"))).alias("d"), start.alias("start"), c["shared"].alias("shared")))[0]

    tried = F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("least")), starts))
    best = each.select("row", "doc_id", "license", "n", F.array_min(F.transform(tried, judged)).alias("b")).filter(F.col("b.d") <= -threshold)
    of_row = best.groupBy("row", "doc_id").agg(F.collect_list(F.struct("b.d", "license", "b.start", (F.col("b.start") + F.col("n")).alias("end"), "n", "b.shared")).alias("all"))
    better = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & (F.struct(-y["shared"], y["d"], y["license"]) < F.struct(-x["shared"], x["d"], x["license"]))
    kept = of_row.select("doc_id", F.explode(F.filter("all", lambda x: ~F.exists("all", lambda y: better(x, y)))).alias("s"))
    return kept.select("doc_id", "s.license", F.col("s.start").cast("long").alias("start"), F.col("s.n").cast("long").alias("n_words"), F.round(-F.col("s.d"), 6).alias("dice"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license that a document holds, with the place of its best span."""
    return scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))


_WORDS = "list_filter(string_split(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_GRAMS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
#: Every span of every document that has enough of a template's bigrams anywhere.
OP10_SQL = f"""
WITH tpl(license, body) AS (VALUES {_values()}),
tw AS (SELECT license, {_WORDS.format('body')} AS w FROM tpl),
tg AS (SELECT license, len(w) AS n, list_distinct({_GRAMS.format('w')}) AS g FROM tw),
tp AS (SELECT license, unnest(g) AS gram FROM tg),
dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
d AS (SELECT r, doc_id, len(w) AS size, {_GRAMS.format('w')} AS p FROM dw),
dg AS (SELECT DISTINCT r, gram FROM (SELECT r, unnest(p) AS gram FROM d)),
m AS (SELECT r, license, count(*) AS k FROM dg JOIN tp USING (gram) GROUP BY r, license),
c AS (SELECT r, doc_id, license, n, g, p, least(n, size) AS k, unnest(range(greatest(size - n, 0) + 1)) AS start FROM m JOIN tg USING (license) JOIN d USING (r) WHERE m.k * (2 - {THRESHOLD}) >= len(g) * {THRESHOLD} - 1e-6),
sp AS (SELECT r, doc_id, license, n, start, g, list_distinct(p[start + 1:start + k - 1]) AS own FROM c),
sh AS (SELECT r, doc_id, license, n, start, len(list_intersect(own, g)) AS shared, len(own) + len(g) AS both_sizes FROM sp),
sc AS (SELECT *, shared * 2.0 / both_sizes AS dice FROM sh),
b AS (SELECT *, row_number() OVER (PARTITION BY r, license ORDER BY dice DESC, start) AS k FROM sc WHERE dice >= {THRESHOLD})
SELECT doc_id, license, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS n_words, round(CAST(dice AS DOUBLE), 6) AS dice FROM b x
WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM b y WHERE y.k = 1 AND y.r = x.r AND y.start < x.start + x.n AND x.start < y.start + y.n AND (y.shared > x.shared OR (y.shared = x.shared AND (y.dice > x.dice OR (y.dice = x.dice AND y.license < x.license)))))
"""
