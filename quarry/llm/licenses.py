"""Licence scans by canonical digest lookup.

A text is brought to canonical form: lower case, lines that state a copyright dropped, punctuation
turned into blanks, equivalent spellings made one, white space collapsed. Its SHA-256 digest is then
joined to the digests of known licence texts, whole against whole. Three kinds of text are looked up: a document as
a whole, each of its lines by itself, as notices stand on a line of their own, and, where the opening words of a
known text stand in a document, as much of it from there on as that text is long, however its lines are broken.
All of it is native DataFrame code; the tables of known texts are fixed below (a few rows), so they are
broadcast; a table that the caller gives is joined as Spark sees fit.

Null and empty texts match nothing; very long ones are read whole. Rows with the same doc_id count as one document. A text that is
the same for several licences is found for each. An empty table gives an empty result; extra columns are ignored, and
columns of the input may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence matching treats as the same word.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("sub licensable", "sublicensable"), ("non commercial", "noncommercial"), ("copy right", "copyright"), ("per cent", "percent"), ("favour", "favor"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment")]
#: Characters that canonical form turns into blanks.
PUNCTUATION = "\t\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~‘’“”–— "
#: A canonical line that states a copyright.
STATES = r"^(c )?copyright (c |© |[0-9]{4})|^©|^all rights reserved$"
#: Licence texts and the notices by which works state them.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Licences and standard notices of several lines: id, the first eight words, length and digest of the canonical form.
PASSAGES = [
    ("MIT", "permission is hereby granted free of charge to", 988, "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("0BSD", "permission to use copy modify and or distribute", 590, "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("ISC", "permission to use copy modify and or distribute", 679, "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms", 1197, "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms", 1386, "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("Zlib", "this software is provided as is without any", 784, "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
    ("Unlicense", "this is free and unencumbered software released into", 1114, "f507d73d343a3d7b0b7ecd39319f6c349b515eeed80b814918af61cdac69e4a5"),
    ("BSL-1.0", "permission is hereby granted free of charge to", 1242, "4f4c9e65217414246c604405ee4900201bd9f230d226fa803a0b7a1f5775bf85"),
    ("Apache-2.0", "apache license version 2 0 january 2004 http", 9921, "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", "apache license version 2 0 january 2004 http", 8838, "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("MPL-1.1", "mozilla public license version 1 1 1 definitions", 22448, "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "mozilla public license version 2 0 1 definitions", 14341, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("GPL-1.0", "gnu general public license version 1 february 1989", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "gnu general public license version 2 june 1991", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "gnu general public license version 3 29 june", 33409, "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "gnu library general public license version 2 june", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "gnu lesser general public license version 2 1", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("GFDL-1.2", "gnu free documentation license version 1 2 november", 19579, "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "gnu free documentation license version 1 3 3", 22015, "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("CC0-1.0", "creative commons legal code cc0 1 0 universal", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("Artistic-1.0", "the artistic license preamble the intent of this", 5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("Apache-2.0", "licensed under the apache license version 2 0", 501, "7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7"),
    ("MPL-2.0", "this source code form is subject to the", 185, "a7891d5763bc6e48071bd0cff7b7aa922b30c550600350b3ec16485e4e8312a6"),
    ("GPL-3.0-or-later", "this program is free software you can redistribute", 233, "66237b20dfaa335f5c003a3da64555538643deb65ca015c0d5fa588527312c4e"),
    ("AGPL-3.0-or-later", "this program is free software you can redistribute", 240, "dcaf5fc7bcb7a7ddf0023e5716f0d0d0b8bfe3feec817b5b03d5de36b55f5250"),
    ("LGPL-3.0-or-later", "this program is free software you can redistribute", 240, "3fb4aecf0c6eb4f5aebb042c6cc1b9d675906ede73b6337c2fc1cf64c21d126a"),
    ("GPL-2.0-or-later", "this program is free software you can redistribute", 233, "a311bfb80ef013414e08cf2ea0128d424ffe3b22888612edd81cc8f04be43f8d"),
]


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; empty for a line that states a copyright."""
    plain = F.translate(F.lower(line), PUNCTUATION, " " * len(PUNCTUATION))
    one = F.array_join(F.array_remove(F.split(plain, " "), ""), " ")
    for old, new in SPELLINGS:
        one = F.replace(one, F.lit(old), F.lit(new))
    return F.transform(F.array(one), lambda x: F.when(x.rlike(STATES), F.lit("")).otherwise(x))[0]


def canonical_lines(text: Column) -> Column:
    """Canonical forms of the lines of a text that keep one."""
    return F.array_remove(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), "")


def known_digests(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the fixed texts."""
    table = spark.createDataFrame(KNOWN, "license_id string, text string")
    long = spark.createDataFrame([(i, d) for i, _, _, d in PASSAGES], "license_id string, digest string")
    return table.select("license_id", F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest")).unionByName(long).distinct()


def passages(whole: Column) -> Column:
    """Stretches of a canonical text that begin with the opening words of a known one and have its length."""
    found = []
    for opening, size in dict.fromkeys((o, n) for _, o, n, _ in PASSAGES):
        pattern = F.lit(f"(?s)(?<![^ ])(?=({opening}.{{{size - len(opening)}}})(?: |$))")
        found.append(F.when(F.contains(whole, F.lit(opening)), F.regexp_extract_all(whole, pattern, F.lit(1))).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*found))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license_id, n_lines, n_passages, whole_text): the licences that a document states, on how many
    lines and in how many passages, and whether all of the document is one."""
    table = F.broadcast(known_digests(docs.sparkSession)) if known is None else known
    lines = docs.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.col(text)).alias("lines")).withColumn("whole", F.array_join("lines", " "))

    def of(kind: str):
        return lambda x: F.struct(F.sha2(x, 256).alias("digest"), F.lit(kind).alias("kind"))

    units = F.concat(F.transform("lines", of("line")), F.transform(passages(F.col("whole")), of("passage")), F.array(of("whole")(F.col("whole"))))
    found = lines.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.digest", "u.kind").join(table, "digest")
    count = {k: F.count_if(F.col("kind") == k) for k in ("line", "passage", "whole")}
    return found.groupBy("doc_id", "license_id").agg(count["line"].alias("n_lines"), count["passage"].alias("n_passages"), (count["whole"] > 0).alias("whole_text"))
