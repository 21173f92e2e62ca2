"""License scans: canonical digest lookup, in DataFrame functions only.

A text's canonical form is lower case, without copyright lines, runs of anything but letters and digits made one blank
(line ends too, so that wrapping does not matter), and equivalent spellings made one. Its digest is the SHA-256 of
that. A document's whole text is looked up, and each of its lines (a notice is a whole text in one line); both meet the
table of known digests by one hash join on the digest. The table is a fixed list, so it is broadcast. Every unit is
digested: nothing is left out by what it looks like.

Known texts are held as texts, or, the long ones, as the digests of their published files; some are known with their
usual titles as well. Null and empty texts have no license. Rows that share a doc_id are told of together by
documents(), and one by one by scan(). Ties cannot occur: two known texts with the same canonical form are refused.
Very long texts are split into lines and looked up like others. An empty table gives no rows. Only doc_id and text are
read, so further columns, of whatever name, do not matter; rows with a null doc_id are told of under null.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as the same (pattern, replacement), applied in this order to words set between blanks.
SPELLINGS = [
    ("licence", "license"),
    ("licensing", "license"),
    (" https ", " "),
    (" http ", " "),
    (" version ([0-9])", " v$1"),
    (" v ([0-9])", " v$1"),
    ("([0-9]) 0 ", "$1 "),
    ("copyright owner", "copyright holder"),
    (" non commercial", " noncommercial"),
    ("organisation", "organization"),
    ("favour", "favor"),
    (" whilst ", " while "),
    ("merchantibility", "merchantability"),
]
COPYRIGHT_LINE = "(?m)^[^a-z0-9\\n]*(copyright[ \\t]*(\\(c\\)|©|[0-9]{4}|[<\\[{]|by )|\\(c\\)[ \\t]|©|all rights reserved)[^\\n]*$"

# Known notices and licence texts, as their publishers word them.
KNOWN = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program; if not, see <https://www.gnu.org/licenses/>."
    ),
    "LGPL-3.0-or-later": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. "
        "You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. "
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. "
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
        "For more information, please refer to <https://unlicense.org/>"
    ),
}
# Titles that texts are also published under.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "Unlicense": ["The Unlicense"],
}
# Digests of the canonical forms of whole licenses as published (digest() of the file's text).
DIGESTS = {
    "Apache-2.0-full": "d3bea61bad8c12886fd09ac52b4b11f2f2c0a8f8564af79c5a46316bd54ed434",
    "Artistic-1.0-Perl": "abb32f6f53898c6ece1a5e74108225f7710b7d936ebb9651b889c39d5f3abde6",
    "CC0-1.0": "edfcae7e301ff2624e2aa67f2bb0171018ce8aa6befdf1154ec830eb85592f3d",
    "GFDL-1.2": "26f5be4621f718fa9bded616dc07d8100828f1726b2035c6a322bdb6112c1cfb",
    "GFDL-1.3": "ea432a56078bb5830495d5041746687be53ad344ea0ab3a01c9fd940578b3b14",
    "GPL-1.0": "c99c820668a8e870b9ab2d3fde5095f0fc8d8fce7728a0dac7c485018d22649e",
    "GPL-2.0": "d1fa61212ae86f10c1b0ea5c8db2b3512d73899ca35873143cc967722492e2b6",
    "GPL-3.0": "f63c5b510fe59d1d216f0a02538e11d1630fce637e1ade235fedca0920c8c5d2",
    "LGPL-2.0": "a888d77e6cc8e53e11ee3ed23bccf3baaabdb48b46cd0cd50afaae864da4e6b3",
    "LGPL-2.1": "f8b1d38ac8ea665fe831af3585b7a2308e9b913f9b67be6f8b9716d7bb485690",
    "LGPL-3.0": "b9d017245d5b6307f6fc2b6dc02be9744eb7e632f313cf7b809a2cd3996db0f6",
    "MPL-1.1": "139ef7a4e31405b58ed09b2a942bc9501802eec4ebbdbc1371de645995d18219",
    "MPL-2.0": "f998fe992b34a4416bb71d5a5423db737d94abbc7752bc21a5fc6ee375348bae",
}


def words(text: Column) -> Column:
    """Lower case, copyright lines left out, runs of anything but letters and digits one blank, one at either end too."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    return F.concat(F.lit(" "), F.regexp_replace(out, "[^\\p{L}\\p{N}]+", " "), F.lit(" "))


def spelt(out: Column) -> Column:
    """words() in one spelling. A text that holds no part that every match of a spelling has is left as it is, which is all but a few."""
    parts = [max(re.split("\\(?\\[[^]]*\\]\\)?", p), key=len) for p, _ in SPELLINGS]
    some = functools.reduce(operator.or_, [out.contains(p) for p in parts])
    new = out
    for pattern, to in SPELLINGS:
        new = F.regexp_replace(new, pattern, to)
    return F.trim(F.when(some, new).otherwise(out))


def canonical(text: Column) -> Column:
    return spelt(words(text))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(canonical(text), "utf-8"), 256)


def wordings() -> list[tuple[str, str]]:
    """(license, text) of the texts of KNOWN, alone and under each of their titles."""
    return [(k, f"{title}\n\n{v}" if title else v) for k, v in KNOWN.items() for title in ["", *TITLES.get(k, [])]]


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license, digest of each known text (given ones instead of all that are known here); refuses two with one canonical form."""
    rows = spark.createDataFrame(list(texts.items()) if texts else wordings(), "license string, text string").select("license", digest(F.col("text")).alias("digest")).collect()
    rows = [tuple(r) for r in rows] + ([] if texts else list(DIGESTS.items()))
    if len({d for _, d in rows}) != len(rows):
        raise ValueError("two known texts have one canonical form")
    return spark.createDataFrame(rows, "license string, digest string")


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, line (-1: the whole text), license, digest of each whole text and line that is a known text."""
    names = known(docs.sparkSession, texts)
    rows = docs.select("doc_id", "text").filter(F.length("text") > 0)
    # a text of one line is digested once, and told of as both
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.when(F.instr("text", "\n") == 0, F.array(F.lit(-1), F.lit(0))).otherwise(F.array(i)).alias("lines"), x.alias("unit")))
    units = F.when(F.instr("text", "\n") > 0, F.concat(F.array(F.struct(F.array(F.lit(-1)).alias("lines"), F.col("text").alias("unit"))), lines)).otherwise(lines)
    # never null, or the join would test for that below the digest, and work it out twice
    each = rows.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.lines", words(F.col("u.unit")).alias("words"))
    found = each.select("doc_id", "lines", F.coalesce(F.sha2(F.encode(spelt(F.col("words")), "utf-8"), 256), F.lit("")).alias("digest"))
    return found.join(F.broadcast(names), "digest").select("doc_id", F.explode("lines").alias("line"), "license", "digest")


def documents(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, whole_license (the last by name where rows share the doc_id), line_licenses (distinct, sorted, comma-joined), n_lines_found of documents with any."""
    return (
        scan(docs, texts)
        .groupBy("doc_id")
        .agg(
            F.max(F.when(F.col("line") < 0, F.col("license"))).alias("whole_license"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("line") >= 0, F.col("license")))), ",").alias("line_licenses"),
            F.count(F.when(F.col("line") >= 0, 1)).alias("n_lines_found"),
        )
    )
