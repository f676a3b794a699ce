"""License scans: Dice coefficient over word bigrams against license templates.

Units are the lines, the paragraphs and the whole of a text.  A unit is normalised (ASCII
lower case; words are runs of letters and digits, with dotted numbers kept whole) and
becomes its set of word bigrams.  Dice = 2 |A and B| / (|A| + |B|) can reach the threshold t
only if |A| lies between t / (2 - t) and (2 - t) / t times |B|; templates outside of these
bounds are not compared.  All of it is DataFrame functions on one row at a time; nothing is
shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tablemeld.llm.common import LOWER, UPPER, ascii_lower

THRESHOLD = 0.9
WORDS = r"[a-z0-9]+(?:\.[0-9]+)*"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(work: str, name: str, version: str) -> str:
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published "
        f"by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {work} is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        f"PURPOSE. See the GNU {name} Public License for more details."
    )


#: Public license texts, notices and one-line statements.
TEMPLATES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software. " + _WARRANTY),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
     "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
     "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
     "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
     "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", _gnu("program", "General", "3")),
    ("GPL-2.0", _gnu("program", "General", "2")),
    ("LGPL-3.0", _gnu("library", "Lesser General", "3")),
    ("LGPL-2.1", _gnu("library", "Lesser General", "2.1")),
    ("LGPL-2.0", _gnu("library", "Library General", "2")),
    ("AGPL-3.0", _gnu("program", "Affero General", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
     "this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def template_bigrams(text: str) -> list[str]:
    words = re.findall(WORDS, text.translate(str.maketrans(UPPER, LOWER)))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a normalised text; fewer than two words have none."""
    words = F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORDS})"), F.lit(1))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def scan_licenses(documents: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each unit that matches a template: the columns of ``documents`` but the text, and
    ``unit`` (line, paragraph or document), ``place`` (from 0), ``license`` and ``dice``.

    Of several templates the best counts, ties by name.  Paragraphs are parted by blank lines;
    one of a single line is a line only, and a text of one paragraph is no document unit.
    Null and empty texts match nothing; repeated rows match each; columns of ``documents``
    that are named like the new ones are replaced.
    """
    kept = [c for c in documents.columns if c != text and c.lower() not in ("unit", "place", "license", "dice")]
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    known = []
    for name, body in templates or TEMPLATES:
        own = template_bigrams(body)
        known.append(F.struct(
            F.lit(name).alias("license"), F.lit(len(own)).alias("n"), F.lit(len(own) * threshold / (2 - threshold)).alias("low"),
            F.lit(len(own) * (2 - threshold) / threshold).alias("high"), F.array(*map(F.lit, own)).alias("pairs"),
        ))
    known = F.array(*known)
    lines, paragraphs = F.split(content, "\n", -1), F.split(content, r"\n[\x20\x09-\x0D]*\n", -1)
    unit = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("place"), x.alias("body"))
    units = F.concat(
        F.transform(lines, unit("line")),
        F.filter(F.transform(paragraphs, unit("paragraph")), lambda u: F.contains(u["body"], F.lit("\n"))),
        F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).alias("place"), content.alias("body")))).otherwise(
            F.array().cast("array<struct<unit: string, place: int, body: string>>")
        ),
    )
    rows = documents.select(*[F.col(f"`{c}`") for c in kept], F.inline(units))
    # exploded as one element: the optimizer does not compute a generated column again where it is used
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], "unit", "place", F.explode(F.array(bigrams(F.col("body")))).alias("_pairs"))
    n = F.size("_pairs")
    rows = rows.withColumn("_near", F.filter(known, lambda k: (n >= k["low"]) & (n <= k["high"]))).filter(F.size("_near") > 0)
    scored = F.transform("_near", lambda k: F.struct((-2.0 * F.size(F.array_intersect("_pairs", k["pairs"])) / (n + k["n"])).alias("dice"), k["license"].alias("license")))
    rows = rows.withColumn("_best", F.array_min(scored)).filter(F.col("_best.dice") <= -threshold)
    return rows.select(*[F.col(f"`{c}`") for c in kept], "unit", "place", F.col("_best.license").alias("license"), (-F.col("_best.dice")).alias("dice"))
