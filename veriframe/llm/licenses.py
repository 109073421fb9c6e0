"""License scans (4): canonical digest lookup.

A unit is a whole document, one line of it (notices stand on lines of their own), or a run of
blocks, a block being what stands between blank lines (headers wrapped over lines, licences
embedded in a file). Its canonical form has no case, no copyright clauses, one spelling for
equivalent words of a block and only letters and digits between single spaces, so that comment
marks go too. A copyright clause begins a line and ends with the sentence, so that a licence that
goes on in the same line stays. SHA-256 digests of canonical units are hash-joined with the digests
of known licences: of the texts and notices in ``KNOWN``, which the same expression makes, and of
long texts, which ``KNOWN_DIGESTS`` holds as digests only.

A run may have any number of blocks. It can equal a known form only if it begins with the first
word of one and is as long as it: so for each block that begins with such a word the known lengths
are added to its place, and what ends where a block does is hashed, nothing else. The first words
and lengths are part of the plan; a caller's own table (``known``) may have ``MOST_KNOWN`` of them.

A text is canonicalised once, block by block; the forms of its lines, runs and of itself are put
together from that, in work linear in the text. All of it is built-in expressions.

Null and empty texts, and units whose canonical form is empty, match nothing. A unit that equals
several known texts reports the smallest licence id. Each row gets its own answer, also of equal
ids, by its place-free key (id and digest of the text); other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm.common import let, text_of

# Spellings that count as one word, left as found, right as compared.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("modelling", "modeling"), ("noncommercial", "non commercial"),
    ("organisation", "organization"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("analogue", "analog"), ("catalogue", "catalog"), ("centre", "center"), ("behaviour", "behavior"), ("judgement", "judgment"),
    ("copyright holder", "copyright owner"), ("per cent", "percent"), ("https", "http"), ("v2", "version 2"), ("v3", "version 3"),
)

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
) + _WARRANTY

_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
    "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
    "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
) + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + (
    " For more information, please refer to <https://unlicense.org>"
)

# Known licence texts and the notices that name them (id, text).
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_1 + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Released under the BSD License."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."), ("Proprietary", "All rights reserved."), ("Proprietary", "Proprietary and confidential. All rights reserved."),
)

# SHA-256 of the canonical forms of long licence texts (id, digest, first word, length).
KNOWN_DIGESTS = (
    ("Apache-2.0", "4bc3c949c895ead14c0dc8c6e33fd6ed118359acaad7c084c4d563cd526a878d", "apache", 9860),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "creative", 6692),
    ("GPL-1.0", "2b62a0899e7031347a9577241eb9b504d0eafb4d91b28e1f99580099701d0a1a", "gnu", 11764),
    ("GPL-2.0", "d3d1ea54d09952fcd9626a8c4c7c325e00c7f6febdc41bf004285919d6bfaa0a", "gnu", 17115),
    ("GPL-3.0", "d0789f68ce73b9e5aca95bb2dba2f119b08a484f0c2b8875edd430f7ac40622c", "gnu", 33397),
    ("LGPL-2.0", "1862ecc2c3c5e3b9e88481e95603c88e089c43e9d5702b2ec01391491b606a9e", "gnu", 24127),
    ("LGPL-2.1", "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5", "gnu", 25214),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "gnu", 7104),
    ("MPL-1.1", "30aa97cb04734e0d721099d21418771167ebadbcea9b46e50da82f3fbadf8bb0", "mozilla", 22333),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9", "mozilla", 14271),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a", "the", 5823),
    ("GFDL-1.2", "b1f65daa9629999daa8f6054cae35d89d60ee1849ea0b7633e5344aa68b9b338", "gnu", 19582),
    ("GFDL-1.3", "5b157581d13408f14fb2a5239bf7cd819b15b3b79a5bb413122811f990dd30d2", "gnu", 22011),
)

#: Pairs of a first word and a length that known forms may have.
MOST_KNOWN = 5000

# Words that a full stop shortens, besides single letters.
SHORTENED = ("inc", "ltd", "co", "corp", "llc", "jr", "sr", "dr", "al", "dept", "univ")
_STOPS = r"(^|[^\p{L}\p{N}])(" + "|".join(SHORTENED) + r"|\p{L})\."
# a mark of copyright at the front of a line, then up to the end of the sentence or of the line
_MARK = r"[^\p{L}\p{N}\n]*(?:copyright\b[^\n.]*?(?:\(c\)|©|[0-9]{4})|\(c\)|©)"
_REST = r"[^\n.]*+(?:\.[^\s][^\n.]*+)*+(?:\.[\x20\x09]+|\.?$)(?:all rights reserved\.?(?:[\x20\x09]+|$))?"
_CLAUSES = f"(?md)^(?:{_MARK}{_REST})+"
_NEEDS = r"copyright|\(c\)|©"
_BLANK_LINES = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"


def _blocks(text: Column) -> Column:
    """For each block of a text that holds words, the plain forms of its lines that do."""
    bare = lambda low: F.regexp_replace(F.regexp_replace(low, _STOPS, "$1$2"), _CLAUSES, "- ")
    kept = let(F.lower(text), lambda low: F.when(low.rlike(_NEEDS), bare(low)).otherwise(low))
    plain = lambda block: F.split(F.regexp_replace(block, r"[^\p{L}\p{N}\n]+", " "), "\n")
    lines = lambda block: F.array_remove(F.transform(plain(block), lambda line: F.trim(line)), "")
    return F.filter(F.transform(F.split(kept, _BLANK_LINES), lines), lambda b: F.size(b) > 0)


def _spelled(plain: Column) -> Column:
    form = F.concat(F.lit(" "), plain, F.lit(" "))
    for found, used in SPELLINGS:
        form = F.replace(form, F.lit(f" {found} "), F.lit(f" {used} "))
    return F.trim(form)


def _forms(text: Column) -> Column:
    """``blocks`` and ``lines`` (canonical forms) and ``sizes`` (lines of each block)."""
    odd = " (?:" + "|".join(found for found, _ in SPELLINGS) + ") "
    joined = lambda b: F.transform(b, lambda lines: F.array_join(lines, " "))

    def units(t: Column) -> Column:
        spell = lambda x: F.when(t.odd, _spelled(x)).otherwise(x)  # noqa: E731  most texts hold none of the spellings
        return F.struct(
            F.transform(joined(t.b), spell).alias("blocks"), F.transform(F.flatten(t.b), spell).alias("lines"), F.transform(t.b, lambda x: F.size(x)).alias("sizes"),
        )

    bound = let(_blocks(text), lambda b: F.struct(b.alias("b"), F.concat(F.lit(" "), F.array_join(F.flatten(b), " "), F.lit(" ")).rlike(odd).alias("odd")))
    return let(bound, units)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    return F.array_join(_forms(text).blocks, " ")


def _running(numbers: Column) -> Column:
    """Running sums of an array, by doubling steps: for n numbers log n passes over them."""
    def doubled(step: int):
        far = lambda p: F.transform(p, lambda v, i: v + F.when(i >= step, F.get(p, i - step)).otherwise(0))
        return lambda p: F.when(F.size(p) > step, far(p)).otherwise(p)

    for k in range(24):
        numbers = let(numbers, doubled(1 << k))
    return numbers


def _runs(forms: Column, lengths: Column) -> Column:
    """The runs of blocks, of more than one line, that are as long as a known form of their first word.

    ``lengths`` maps a first word to the lengths of the known forms."""

    def candidates(f: Column) -> Column:
        """``t``: the blocks joined by line feeds, ``ends``: where each ends, ``c``: places to try."""
        ends = _running(F.transform(f.blocks, lambda b: F.length(b) + 1))

        def tried(t: Column) -> Column:
            start = F.transform(f.blocks, lambda b, i: F.struct(
                (F.get(t.ends, i) - F.length(b) - 1).alias("at"), F.try_element_at(lengths, F.substring_index(b, " ", 1)).alias("n"), F.get(f.sizes, i).alias("lines"),
            ))
            each = lambda s: F.transform(s.n, lambda n: F.struct(s.at.alias("at"), n.alias("n"), s.lines.alias("lines")))
            return F.struct(t.ends.alias("ends"), F.flatten(F.transform(F.filter(start, lambda s: s.n.isNotNull()), each)).alias("c"))

        return let(F.struct(ends.alias("ends")), tried)

    def cut(f: Column) -> Column:
        def found(t: Column) -> Column:
            met = F.array_intersect(F.transform(t.c, lambda c: c.at + c.n + 1), t.ends)  # by hash: linear
            return let(F.struct(met.alias("met"), F.array_join(f.blocks, "\n").alias("text"), t.c.alias("c")), lambda m: F.when(F.size(m.met) > 0, F.transform(
                F.filter(F.transform(F.filter(m.c, lambda c: F.array_contains(m.met, c.at + c.n + 1)), lambda c: F.struct(F.substring(m.text, c.at + 1, c.n).alias("run"), c.lines.alias("lines"))),
                         lambda r: (r.lines > 1) | r.run.contains("\n")),
                lambda r: F.replace(r.run, F.lit("\n"), F.lit(" ")),
            )).otherwise(F.array().cast("array<string>")))

        return let(candidates(f), found)

    return cut(forms)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license, word, length) of a table of texts (``license``, ``text``), or of the built-in ones."""
    texts = known
    if texts is None:
        texts = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("license"), F.lit(t).alias("text")) for i, t in KNOWN])))
    found = texts.select(canonical(text_of("text")).alias("form"), "license").filter("form <> '' AND license IS NOT NULL")
    found = found.select(F.sha2("form", 256).alias("digest"), "license", F.substring_index("form", " ", 1).alias("word"), F.length("form").alias("length"))
    if known is None:
        more = [F.struct(F.lit(d).alias("digest"), F.lit(i).alias("license"), F.lit(w).alias("word"), F.lit(n).alias("length")) for i, d, w, n in KNOWN_DIGESTS]
        found = found.unionByName(spark.range(1).select(F.inline(F.array(*more))))
    return found.groupBy("digest").agg(F.min("license").alias("license"), F.min("word").alias("word"), F.min("length").alias("length"))


def _lengths(known: DataFrame) -> Column:
    """A map: first word of known forms -> their lengths."""
    pairs = known.select("word", "length").distinct().limit(MOST_KNOWN + 1).collect()
    if len(pairs) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} first words and lengths of known texts")
    by_word: dict[str, list[int]] = {}
    for r in pairs:
        by_word.setdefault(r.word, []).append(r.length)
    if not by_word:
        return F.lit(None).cast("map<string,array<int>>")
    return F.create_map(*[c for word, all_ in sorted(by_word.items()) for c in (F.lit(word), F.array(*map(F.lit, sorted(all_))))])


WHOLE, LINE, RUN = 0, 1, 2


def _digests(text: Column, lengths: Column) -> Column:
    """(kind, digest) of all units of a text."""
    entry = lambda kind: lambda form: F.struct(F.lit(kind).alias("kind"), F.sha2(form, 256).alias("digest"))
    return let(_forms(text), lambda f: F.concat(
        F.transform(F.filter(F.array(F.array_join(f.blocks, " ")), lambda w: w != ""), entry(WHOLE)),
        F.transform(f.lines, entry(LINE)), F.transform(_runs(f, lengths), entry(RUN)),
    ))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``license`` (of the whole text, or null), ``notices``
    (licences of its lines, sorted, comma between), ``n_notice_lines`` and ``embedded`` (licences
    of its runs of several lines, sorted, comma between)."""
    known = known_digests(docs.sparkSession, known)
    lengths = _lengths(known)
    known = known.select("digest", "license")
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    key = [F.col("id"), F.sha2("text", 256).alias("key")]
    units = source.select(*key, F.posexplode(_digests(F.col("text"), lengths)).alias("place", "unit")).select("id", "key", "place", "unit.*")
    hits = units.join(known, "digest").groupBy("id", "key", "place", "kind").agg(F.min("license").alias("license"))  # equal rows hit alike
    of = lambda kind: F.when(F.col("kind") == kind, F.col("license"))
    listed = lambda kind: F.array_join(F.array_sort(F.collect_set(of(kind))), ",")
    by_row = hits.groupBy("id", "key").agg(
        F.min(of(WHOLE)).alias("license"), listed(LINE).alias("notices"), F.count_if(F.col("kind") == LINE).alias("n_lines"), listed(RUN).alias("embedded"),
    ).withColumnsRenamed({"id": "hit_id", "key": "hit_key"})
    rows = source.select(*key)
    found = rows.join(by_row, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    return found.select(
        F.col("id").alias(id_col), "license", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_notice_lines"), F.coalesce("embedded", F.lit("")).alias("embedded"),
    )


def oracle() -> str:
    clauses = _CLAUSES.replace("*+", "*").replace("(?md)", "(?m)")
    stops = lambda x: rf"regexp_replace({x}, '{_STOPS}', '\1\2', 'g')"
    low = lambda x: rf"CASE WHEN regexp_matches(lower({x}), '{_NEEDS}') THEN regexp_replace({stops(f'lower({x})')}, '{clauses}', '- ', 'g') ELSE lower({x}) END"
    plain = lambda x: rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

    def spelled(x: str) -> str:
        out = f"(' ' || {x} || ' ')"
        for found, used in SPELLINGS:
            out = f"replace({out}, ' {found} ', ' {used} ')"
        return f"trim({out})"

    quoted = [t.replace("'", "''") for _, t in KNOWN]
    values = ", ".join(f"('{i}', '{t}')" for (i, _), t in zip(KNOWN, quoted))
    digests = ", ".join(f"('{i}', '{d}', {n})" for i, d, _, n in KNOWN_DIGESTS)
    blank = r"\n([\x20\x09\x0B-\x0D]*\n)+"
    return rf"""
WITH kf AS (SELECT {spelled(plain(low('text')))} AS form, license FROM (VALUES {values}) AS v(license, text)),
ka AS (SELECT sha256(form) AS digest, license, length(form) AS n FROM kf UNION ALL SELECT digest, license, n FROM (VALUES {digests}) AS w(license, digest, n)),
known AS (SELECT digest, min(license) AS license FROM ka GROUP BY 1),
d AS (SELECT doc_id, {low("coalesce(text, '')")} AS low FROM documents),
b AS (SELECT doc_id, i, block FROM (SELECT doc_id, unnest(string_split_regex(low, '{blank}')) AS block,
        unnest(range(0, len(string_split_regex(low, '{blank}')))) AS i FROM d) WHERE regexp_matches(block, '[\p{{L}}\p{{N}}]')),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j,
        list_filter(list_transform(string_split(block, chr(10)), lambda x: {plain('x')}), lambda x: x <> '') AS lines FROM b),
e0 AS (SELECT doc_id, j, {spelled("array_to_string(lines, ' ')")} AS form, len(lines) AS n FROM c),
e AS (SELECT *, sum(length(form) + 1) OVER (PARTITION BY doc_id ORDER BY j) AS stop FROM e0),
w AS (SELECT doc_id, string_agg(form, ' ' ORDER BY j) AS whole FROM e GROUP BY doc_id),
u AS (SELECT doc_id, 1 AS kind, {spelled('line')} AS unit FROM (SELECT doc_id, unnest(lines) AS line FROM c)
      UNION ALL SELECT doc_id, 0, whole FROM w
      UNION ALL SELECT a.doc_id, 2, substr(whole, (a.stop - length(a.form))::BIGINT, (z.stop - 1 - (a.stop - length(a.form) - 1))::BIGINT) FROM e a JOIN e z
        ON z.doc_id = a.doc_id AND z.j >= a.j AND z.stop - a.stop + length(a.form) IN (SELECT n FROM ka) AND (z.j > a.j OR a.n > 1) JOIN w ON w.doc_id = a.doc_id),
h AS (SELECT doc_id, kind, license FROM (SELECT doc_id, kind, sha256(unit) AS digest FROM u) JOIN known USING (digest)),
r AS (SELECT doc_id, min(license) FILTER (kind = 0) AS license, array_to_string(list_sort(list_distinct(list(license) FILTER (kind = 1))), ',') AS notices,
             count(*) FILTER (kind = 1) AS n, array_to_string(list_sort(list_distinct(list(license) FILTER (kind = 2))), ',') AS embedded FROM h GROUP BY doc_id)
SELECT d.doc_id, license, coalesce(notices, '') AS notices, coalesce(n, 0)::BIGINT AS n_notice_lines, coalesce(embedded, '') AS embedded FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
