"""License scans by canonical digests, with DataFrame functions only.

A text is brought into canonical form (ASCII case, Unicode quotes, dashes and bullets, copyright lines,
list marks, punctuation, spellings that mean the same; of a whole text also the heading and rights lines
that it opens with) and its SHA-256 is joined to the digests of known licenses, canonical in the same
way. Known licenses are given as texts or, long ones, as digests. Each line is looked up as well (by the
MD5 of its canonical form), which finds one-line notices inside other text.

A text is read and brought into form once: what is stored of it, for the joins, are digests.

Nulls, empties: a null text has no digest and no license, an empty one the digest of nothing. Null
ids and repeated rows are kept. Known texts that are empty in canonical form are not used; known
texts with one canonical form share it, and all their names are given. Empty tables give empty
results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import ascii_lower, materialize

#: Spellings that mean the same, second form used (after those before it), wherever they occur, so
#: that other forms of a word change with it.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisation", "capitalization"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("merchantibility", "merchantability"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programmes", "programs"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

#: The same for whole words alone, as longer words (programmed, fulfills) begin with them.
WHOLE_WORDS = (("fulfil", "fulfill"), ("https", "http"), ("programme", "program"))

#: Headings that license files open with, in canonical form.
HEADINGS = (
    "mit license", "the mit license", "the mit license mit", "mit license mit", "expat license", "mit no attribution",
    "isc license", "the isc license", "isc license isc", "isc license iscl", "zlib license", "the zlib license", "zlib libpng license",
    "bsd 2 clause license", "the bsd 2 clause license", "simplified bsd license", "freebsd license", "bsd license", "the bsd license",
    "bsd 3 clause license", "the bsd 3 clause license", "new bsd license", "the new bsd license", "modified bsd license", "bsd zero clause license",
    "boost software license version 1 0", "boost software license version 1 0 august 17th 2003", "boost software license 1 0", "the unlicense", "unlicense",
)

#: Unicode quotes, dashes, bullets and blanks, and line ends but LF, which count as blanks do.
MARKS = "\r\x85\u2028\u2029\u2018\u2019\u201a\u201c\u201d\u201e\u00ab\u00bb\u2010\u2011\u2012\u2013\u2014\u2015\u2022\u00b7\u25cf\u25e6\u00a0\u2003\u2009\ufeff"

#: Public license texts and notices.
KNOWN = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "MIT-0",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "BSL-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    ),
    (
        "GPL-2.0-or-later",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<http://www.gnu.org/licenses/>.""",
    ),
    (
        "GPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<http://www.gnu.org/licenses/>.""",
    ),
    (
        "LGPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this program. If not, see
<http://www.gnu.org/licenses/>.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)

#: Digests of long license texts in canonical form.
KNOWN_DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "f213b407df637bc294997de205aecfc82e06a5e4ef6d75893ec348ca26dd13c2"),
    ("Apache-2.0", "d4660dd61c430428a5a8a94b10068fbbbf015ab69577e38e518d54f2a6b291c6"),
    ("Artistic-1.0-Perl", "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651"),
    ("CC0-1.0", "888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c"),
    ("GFDL-1.2", "11b443626816c538e555b7fb60eaba9f2a83a9ecb67ad4a1663e07c118b8e550"),
    ("GFDL-1.3", "cc84a6c6a2b84e8cde0619ed37d987e1a9b39e53ddcaf34f4735e2138dfe6e4a"),
    ("GPL-1.0", "ac910954c3184907f3947de0193b0169b8c69656ff2de7f3330438f6ba4fb746"),
    ("GPL-2.0", "2e8e378a3d24393c0f3fd1439ffbe84e750886c09715e622426a6a0e54fa1bee"),
    ("GPL-3.0", "3695e90f7fe4b461853cec533de5675ab2b6b1fcafcb504d6c64ded76f675d64"),
    ("LGPL-2.0", "4a1b1cb15d45262f049457ae26945909d0e5af93e2e3fb5de82c9f72ac6bebe2"),
    ("LGPL-2.1", "f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98"),
    ("LGPL-3.0", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45"),
    ("MPL-1.1", "a1ea0c4b634aa7b4256d56525c941092a1facf7d3e96c4ecb68ba71bc6744f7d"),
    ("MPL-2.0", "2dca1486b3652fa5c4043c17f6755fcb372a3ea6a1721c5c6dcf83806278116b"),
)

#: Patterns that Java and RE2 read alike. Lines that state a copyright; list marks; the lines that a license file opens with.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(?:copyright|\(c\)|©)[ \t:]*(?:\(c\)|©|[0-9]{4}|<year>|\[yyyy\])[^\n]*$"
LIST_MARK = r"(?m)^[ \t*#/;-]*\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]+"
OPENING = r"\A(?: *(?:(?:" + "|".join(sorted(HEADINGS, key=lambda x: (-len(x), x))) + r")|copyright[^\n]*|c [0-9][^\n]*|(?:all )?rights reserved[^\n]*)? *\n)+"


def _unified(text: Column, parted: bool) -> Column:
    """Spellings of one word, or (parted) those of two, between which a line may end."""
    for other, ours in SPELLINGS:
        if (" " in other.strip()) == parted:
            text = F.replace(text, F.lit(other), F.lit(ours))
    for other, ours in () if parted else WHOLE_WORDS:
        text = F.regexp_replace(text, rf"\b{other}\b", ours)
    return text


def canonical_lines(text: Column) -> Column:
    """Canonical text but for spellings of two words, line ends kept: blanks between words."""
    c = F.translate(ascii_lower(text), MARKS, " " * len(MARKS))
    c = F.regexp_replace(F.regexp_replace(c, COPYRIGHT_LINE, ""), LIST_MARK, "")
    c = F.regexp_replace(c, r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+", " ")
    return _unified(c, False)


def canonical(lines: Column) -> Column:
    """Canonical lines as one text, without the lines that a license file opens with."""
    return _unified(F.trim(F.regexp_replace(F.regexp_replace(lines, OPENING, ""), r"[ \n]+", " ")), True)


def canonical_line(line: Column) -> Column:
    return _unified(F.trim(F.regexp_replace(line, " +", " ")), True)


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license string, text string")


def _shared(forms: DataFrame, key: Column) -> DataFrame:
    """(digest, license): names with one digest sorted and comma-joined."""
    return forms.groupBy(key.alias("digest")).agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("license"))


def license_scan(
    docs: DataFrame,
    known: DataFrame | None = None,
    digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, digest, license, line_licenses, n_lines) for every row: the digest of its canonical text,
    the license that it is as a whole, those of its lines (sorted), and the count of such lines. known
    (license, text) takes the place of the known texts; digests are those of more whole texts."""
    spark = docs.sparkSession
    lines = canonical_lines(F.col("text"))
    forms = (known if known is not None else known_licenses(spark)).select("license", lines.alias("lines"))
    texts = forms.select("license", canonical(F.col("lines")).alias("form")).filter("form <> ''")
    own = spark.createDataFrame(list(digests), "license string, digest string")
    whole = _shared(texts.select("license", F.sha2("form", 256).alias("digest")).union(own), F.col("digest"))
    single = forms.select("license", canonical_line(F.replace("lines", F.lit("\n"), F.lit(" "))).alias("form")).filter("form <> ''")
    per_line = _shared(single, F.unhex(F.md5("form"))).withColumnRenamed("license", "found")

    each = F.filter(F.transform(F.split("lines", "\n", -1), canonical_line), lambda x: x != "")
    rows = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines")).select(
        "id", F.sha2(canonical(F.col("lines")), 256).alias("digest"), F.transform(each, lambda x: F.unhex(F.md5(x))).alias("lines")
    )
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "licenses")
    hits = rows.select("row", F.explode("lines").alias("digest")).join(per_line, "digest")
    hits = hits.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("found")), ",").alias("line_licenses"), F.count("*").alias("n_lines"))
    return (
        rows.select("row", "id", "digest")
        .join(whole, "digest", "left")
        .join(hits, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "digest",
            "license",
            F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
            F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        )
    )
