"""License scans: TF-IDF cosine of licence headers and files to templates, and inheritance along directories.

Whole files, paragraphs, lines and sentences that hold a telling term of some template are vectors of terms, weighted by
how rare a term is among all such sentences of the corpus. Whole files are compared with the texts of licences, the rest
with notices. Each distinct unit is compared once, however many documents hold it. A file without a licence of its own
takes that of the nearest directory above it which has a licence file, found by joins on paths.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, maybe_broadcast, text_or_empty

MIN_COSINE = 0.6
#: The same for whole files and texts of licences.
MIN_FILE_COSINE = 0.8
#: Terms that a sentence and a template must share at least.
MIN_SHARED = 2
#: A tag that names the licence of a file outright.
SPDX_TAG = r"SPDX-License-Identifier:\s*\(*\s*([A-Za-z0-9][A-Za-z0-9.+-]*)"
#: Licences whose notice other licences hold too: they count only if nothing else in the file names another.
SHARED_NOTICES = ("Proprietary", "BSD-2-Clause")
#: A file is a licence file by its name, or if the whole of it is the text of a licence.
LICENCE_FILE_NAME = r"(?i)^(un)?licen[cs]e|^copying|^notice|^copyright"
#: Lines of a wrapped notice that are joined at most, besides whole paragraphs.
WRAPPED_LINES = 4
#: Files with a telling term that one task cuts up.
FILES = 400
#: What a line of a comment begins with.
COMMENT = r"^\s*(?:(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--)\s*)?"
#: Words of templates that texts hold anyway ("mit" is German); all other terms of templates are telling.
COMMON = frozenset(
    "a all any are as by can either in into is it mit of or that the this to under with you and "
    "above appear august be copies covered deal do express february fee for from holder including january june its limitation may merge name names neither nor november organization parties persons prepare prior products provided purpose restriction rights sell so specific subject third used works whom without written".split()
)

#: Usual notices of well-known licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "Copyright. All rights reserved"),
)


#: The texts of short licences, as a licence file holds them after its copyright line.
FILE_TEMPLATES = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
)


TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: A sentence is compared if it matches this: words about licences, or a telling term of a template.
MARKERS = r"(?i)licen[cs]|copyright|spdx|copyleft|public domain|\bCC[ -](BY|0|ZERO)|\b(" + "|".join(sorted({t for _, notice in TEMPLATES for t in re.findall(TERM, notice.lower()) if t not in COMMON and re.search("[a-z]{2}", t)})) + r")\b"


def terms(sentence: Column) -> Column:
    return F.regexp_extract_all(F.lower(sentence), F.lit(TERM.replace("a-z0-9", r"\p{L}\p{N}")), F.lit(0))


def stripped_lines(body: Column) -> Column:
    return F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, COMMENT, "")))


def sentences(lines: Column, marked: Column) -> Column:
    """(lines, sentence) of the units of a text's stripped lines that may name a licence.

    The whole text is one unit (-1), a paragraph is cut into sentences (0), and so are lines one by one (1) and 2 to
    WRAPPED_LINES lines in a row joined, so that a notice is found however it is wrapped. A sentence ends after . ! or ?
    and a space. Marks of comments before lines don't count. `marked` says which lines match MARKERS: a joined line has
    a term only if one of its lines has it.
    """
    cut = lambda n, parts: F.transform(F.filter(F.flatten(F.transform(parts, lambda x: F.split(x, r"(?<=[.!?])[ \t]+"))), lambda s: s.rlike(MARKERS)), lambda s: F.struct(F.lit(n).alias("lines"), F.trim(s).alias("sentence")))
    whole = F.array(F.struct(F.lit(-1).alias("lines"), F.array_join(lines, " ").alias("sentence")))
    paragraphs = F.filter(F.split(F.array_join(lines, "\n"), "\n{2,}"), lambda x: x.rlike(MARKERS))
    found = [whole, cut(0, F.transform(paragraphs, lambda x: F.translate(x, "\n", " ")))]
    for n in range(1, WRAPPED_LINES + 1):
        starts = F.when(F.size(lines) >= n, F.sequence(F.lit(1), F.greatest(F.size(lines) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda k, n=n: F.exists(F.slice(marked, k, F.lit(n)), lambda m: m))
        rows = F.filter(F.transform(starts, lambda k, n=n: F.slice(lines, k, F.lit(n))), lambda x: F.forall(x, lambda line: line != ""))
        found.append(cut(n, F.transform(rows, lambda x: F.array_join(x, " "))))
    return F.concat(*found)


def template_terms(spark: SparkSession) -> DataFrame:
    rows = [(k, name, text, k >= len(TEMPLATES)) for k, (name, text) in enumerate([*TEMPLATES, *FILE_TEMPLATES])]
    return spark.createDataFrame(rows, "template int, licence string, notice string, whole boolean").select("template", "licence", "whole", F.explode(terms(F.col("notice"))).alias("term"))


def matched_units(found: DataFrame) -> DataFrame:
    """(unit, licence, score): the best template of each distinct unit in `found` (unit, whole, n, terms).

    n is how often it stands in single lines; whole files and joined lines
    have 0 and don't count for rareness again.
    """
    spark = found.sparkSession
    words = found.select("unit", "whole", "n", F.explode("terms").alias("term")).groupBy("unit", "whole", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    words = materialise(words, "terms")
    total = found.agg(F.sum("n")).first()[0] or 0
    rare = F.lit(1.0) + F.log(F.lit(1.0 + total))  # of terms that no single line holds
    idf = words.filter("n > 0").groupBy("term").agg(F.log((1.0 + total) / (1.0 + F.sum("n"))).alias("idf"))
    idf = materialise(idf.select("term", (F.col("idf") + 1.0).alias("idf")), "idf")
    own = template_terms(spark).groupBy("template", "licence", "whole", "term").agg(F.count(F.lit(1)).alias("t_tf"))
    own = own.join(maybe_broadcast(idf), "term", "left")
    own = own.withColumn("t_w", F.col("t_tf") * F.coalesce("idf", rare)).drop("idf", "t_tf")
    norm = own.groupBy("template").agg(F.sqrt(F.sum(F.col("t_w") ** 2)).alias("t_norm"))
    own = F.broadcast(own.join(norm, "template"))  # the terms of the templates, a fixed list
    weighted = words.join(maybe_broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", rare))
    lengths = weighted.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    dots = weighted.join(own, ["term", "whole"]).groupBy("unit", "whole", "template", "licence", "t_norm").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"), F.count(F.lit(1)).alias("shared"))
    scored = dots.filter(F.col("shared") >= MIN_SHARED).join(lengths, "unit")
    least = F.when(F.col("whole"), MIN_FILE_COSINE).otherwise(MIN_COSINE)
    scored = scored.withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6)).filter(F.col("score") >= least)
    best = F.min(F.struct((-F.col("score")).alias("s"), "template", "licence"))
    return scored.groupBy("unit").agg(best.alias("best")).select("unit", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score"))


def licence_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, path, licence, score, origin.

    origin is 'own' if the file's own text names the licence, else the directory whose licence file it comes from,
    '' for the topmost; licence, score and origin are null if there is none. An SPDX tag decides (score 1), then a file that
    is the text of a licence as a whole. Of several notices in a file the one of the highest cosine counts, then the first
    by name, and those of SHARED_NOTICES only if there is no other, as licensed files reserve rights too; of several licence files in a directory likewise, then the
    first path. Rows that share id and path are one file. Null and empty texts have no licence of their own; a file
    without a path inherits none. Other columns are ignored.
    """
    rows = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), text_or_empty(text_col).alias("body"))
    hits = rows.filter(F.col("body").rlike(MARKERS))  # most texts hold no such term and aren't cut up
    hits = hits.select("doc_id", "path", F.regexp_extract("body", SPDX_TAG, 1).alias("tag"), stripped_lines(F.col("body")).alias("all"))
    marked = hits = materialise(hits.withColumn("marks", F.transform("all", lambda x: x.rlike(MARKERS))), "marked")  # written, so that lines are cut once and not again for each that is joined
    hits = hits.repartition(max(1, hits.count() // FILES))
    hits = hits.select("doc_id", "path", F.inline(sentences(F.col("all"), F.col("marks"))))
    # Units are told apart by 128 bits of their text, which isn't carried along.
    named = hits.select("doc_id", "path", "lines", F.xxhash64("sentence").alias("u1"), F.xxhash64(F.lit(1), "sentence").alias("u2"), terms(F.col("sentence")).alias("terms"))
    hits = materialise(named, "hits")
    whole = (F.col("lines") == -1).alias("whole")
    units = hits.groupBy("u1", "u2", whole).agg(F.sum((F.col("lines") == 1).cast("long")).alias("n"), F.first("terms").alias("terms"))
    units = materialise(units.select("u1", "u2", "whole", "n", F.monotonically_increasing_id().alias("unit"), "terms"), "units")
    matched = materialise(matched_units(units.select("unit", "whole", "n", "terms")), "matched").withColumnRenamed("unit", "m")
    matched = materialise(units.select("u1", "u2", "whole", "unit").join(maybe_broadcast(matched), F.col("unit") == F.col("m")).select(F.col("u1").alias("k1"), F.col("u2").alias("k2"), F.col("whole").alias("k3"), "licence", "score"), "names")
    held = hits.drop("terms").join(maybe_broadcast(matched), (F.col("u1") == F.col("k1")) & (F.col("u2") == F.col("k2")) & ((F.col("lines") == -1) == F.col("k3")))
    tags = marked.filter("tag <> ''").select("doc_id", "path", F.lit(-2).alias("lines"), F.col("tag").alias("licence"), F.lit(1.0).alias("score"))
    held = held.select("doc_id", "path", "lines", "licence", "score").unionByName(tags)
    kind = F.when(F.col("lines") < 0, F.col("lines")).otherwise(F.lit(0))  # a tag, a whole file, a notice
    shared = (F.col("lines") >= 0) & F.col("licence").isin(*SHARED_NOTICES)
    own = held.groupBy("doc_id", "path").agg(
        F.min(F.struct(kind.alias("kind"), F.when(shared, F.array_position(F.array(*[F.lit(x) for x in SHARED_NOTICES[::-1]]), F.col("licence"))).otherwise(0).alias("last"), (-F.col("score")).alias("s"), "licence")).alias("best"),
        F.bool_or(F.col("lines") == -1).alias("whole"),
    )
    own = materialise(own.select("doc_id", "path", F.col("best.licence").alias("own_licence"), (-F.col("best.s")).alias("own_score"), "whole"), "own")
    name, folder = F.regexp_extract("path", r"[^/]*$", 0), F.regexp_replace("path", r"/?[^/]*$", "")
    governing = own.filter(F.col("path").isNotNull() & (F.col("whole") | name.rlike(LICENCE_FILE_NAME)))
    governing = governing.groupBy(folder.alias("folder")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_licence")).alias("best"))
    governing = materialise(governing.select("folder", F.col("best.own_licence").alias("up_licence"), (-F.col("best.s")).alias("up_score")), "governing")
    narrow = rows.select("doc_id", "path").alias("f").join(
        maybe_broadcast(own.select(F.col("doc_id").alias("__id"), F.col("path").alias("__path"), "own_licence", "own_score")),
        F.col("f.doc_id").eqNullSafe(F.col("__id")) & F.col("f.path").eqNullSafe(F.col("__path")),
        "left",
    )
    narrow = narrow.select("doc_id", "path", "own_licence", "own_score")
    named = narrow.filter("own_licence IS NOT NULL").select("doc_id", "path", F.col("own_licence").alias("licence"), F.col("own_score").alias("score"), F.lit("own").alias("origin"))
    return named.unionByName(_inherited(narrow.filter("own_licence IS NULL").select("doc_id", "path"), governing))


def _inherited(bare: DataFrame, governing: DataFrame) -> DataFrame:
    """Files without a licence of their own, each with the licence of the nearest directory above that has one.

    Directories without a licence file are resolved once for all files in them: their chains of ancestors are joined
    with the governing directories, and the longest match is taken.
    """
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    bare = bare.withColumn("folder", F.when(F.col("path").isNotNull(), folder))
    folders = materialise(bare.filter("folder IS NOT NULL").select("folder").distinct(), "folders")
    parts = F.split("folder", "/")
    chain = F.array_union(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), F.array(F.lit("")))
    ups = folders.select(F.col("folder").alias("__folder"), F.explode(chain).alias("up"))
    up = ups.join(maybe_broadcast(governing), F.col("up") == F.col("folder"))
    nearest = up.groupBy("__folder").agg(F.max(F.struct(F.length("up").alias("n"), "up", "up_licence", "up_score")).alias("best"))
    nearest = materialise(nearest.select("__folder", F.col("best.up").alias("origin"), F.col("best.up_licence").alias("licence"), F.col("best.up_score").alias("score")), "nearest")
    return bare.join(maybe_broadcast(nearest), F.col("folder") == F.col("__folder"), "left").select("doc_id", "path", "licence", "score", "origin")
