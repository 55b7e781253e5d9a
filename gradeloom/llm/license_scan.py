"""License scan: TF-IDF cosine to templates, then inheritance from the nearest directory.

Only DataFrame functions run here. The parts of a file that are compared are its leading comment block, each
paragraph that speaks of a licence, the stretches of one to three lines around a line that does, and, for a
file with a licence's name (``LICENSE``, ``COPYING``), the whole text. Words are weighed by how rare
they are among all different parts and templates; a part belongs to the template with the largest
cosine. A file without a licence of its own inherits that of its nearest ancestor directory that has
one, by an equi-join on directory paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.operators.hot_keys import look_up
from gradeloom.plans.durable import written

#: Public licence notices, and whole texts of the short licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-3.0": [
        "Licensed under the GNU GPL v3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "GPL-2.0": [
        "Licensed under the GNU GPL v2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    ],
    "AGPL-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
    "Proprietary": ["Copyright. All rights reserved. No licence is granted"],
}
#: Words that speak of a licence, lines of comments, and names of licence files.
CUE = r"(?i)licen[cs]e|copyright|public domain|spdx|permission is hereby|redistribution and use"
COMMENT = r"^\s*$|^\s*(#|//|/\*|\*|--|;|%|<!--)"
LICENCE_FILE = r"^(?i)(un)?licen[cs]e([._-].*)?$|^(?i)(copying|copyright|notice)([._-].*)?$"
#: The tag by which a file names its licence, without what says that later versions count.
SPDX = r"(?i)SPDX-License-Identifier:\s*\(?([a-z0-9][a-z0-9.\-]*?)(?:-only|-or-later|\+)?(?=[\s()*\"'<;,]|\.?$)"
#: Templates with more words than this are joined by a shuffle.
BROADCAST_TERMS = 100_000
WORD = r"[\p{L}\p{N}][\p{L}\p{N}.\-]*"


def terms(column: str) -> Column:
    """Small-letter words of a part, without dots and dashes at the end."""
    return F.transform(F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0)), lambda x: F.regexp_replace(x, r"[.\-]+$", ""))


def compared_parts(rows: DataFrame) -> DataFrame:
    """``id``, ``path`` and ``part`` of all parts of the files that are compared to templates."""
    lines = F.split("text", "\n")
    name = F.regexp_extract(F.coalesce("path", F.lit("")), "[^/]*$", 0)
    code = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), False).cast("int")
    block = F.array_join(F.slice(lines, F.lit(1), F.when(code == 0, F.size(lines)).otherwise(code - 1)), " ")
    header = F.when(F.length(F.trim(block)) > 0, F.array(block)).otherwise(F.array().cast("array<string>"))
    whole = F.when(name.rlike(LICENCE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    speaks = F.col("text").rlike(CUE)
    paragraphs = F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda x: x.rlike(CUE))
    around = F.transform(lines, lambda x, i: F.when(x.rlike(CUE), F.array(x, F.concat_ws(" ", x, F.get(lines, i + 1)), F.concat_ws(" ", F.get(lines, i - 1), x), F.concat_ws(" ", F.get(lines, i - 1), x, F.get(lines, i + 1)))))
    spoken = F.when(speaks, F.concat(paragraphs, F.flatten(F.filter(around, lambda x: x.isNotNull())))).otherwise(F.array().cast("array<string>"))
    some = rows.filter(speaks | F.col("text").rlike(r"^\s*(#|//|/\*|\*|--|;|%|<!--)") | name.rlike(LICENCE_FILE))
    return some.select("id", "path", F.explode(F.array_distinct(F.concat(header, whole, spoken))).alias("part"))


def scan_licenses(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", least: float = 0.6, templates: DataFrame | None = None) -> DataFrame:
    """One row for each file: its id, ``path``, ``license``, ``similarity``, ``origin`` and ``from_dir``.

    ``origin`` is ``own`` if a part of the file comes to a template with a cosine of ``least`` or
    more (the most similar part; ties go to the template first by name), ``inherited`` if the nearest
    ancestor directory that holds a file of its own licence gives it (``from_dir``; there the first file
    by path and id decides), else ``none`` with a null license. ``templates`` (``license``, ``text``) takes the place of the built-in ones. Null and empty texts have no parts. A null
    path has no directory: the file neither gives nor inherits. Rows alike in path and id are one file
    and give one row each. Very long texts are read whole. An empty table gives an empty result. Other columns are not read.
    """
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    key = ["id", "path"]
    parts = written(compared_parts(rows).withColumn("key", F.md5(F.col("part").cast("binary"))))
    best = part_licenses(parts, templates).filter(F.col("similarity") >= least)
    # a notice of a third of all files is looked up where the files lie
    uses = written(parts.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).join(best.hint("merge"), "key"))
    own = look_up(parts.select(*key, "key"), uses, "key", parts.count()).groupBy(*key).agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "license")).alias("m"))
    own = written(own.select(*key, F.col("m.license").alias("license"), (-F.col("m.minus")).alias("similarity")))
    # the licence of a directory is that of its first licensed file
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    holders = own.filter(F.col("path").isNotNull()).withColumn("holder", folder).groupBy("holder").agg(F.min(F.struct("path", "id", "license")).alias("m"))
    # ancestors of each directory, not of each file
    places = written(rows.filter(F.col("path").isNotNull()).groupBy(folder.alias("dir")).agg(F.count(F.lit(1)).alias("_n")))
    split = F.split("dir", "/")
    ancestors = places.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(split)))).alias("depth"))
    ancestors = written(ancestors.select("dir", "depth", F.array_join(F.slice(split, F.lit(1), F.col("depth")), "/").alias("holder")))
    named = ancestors.groupBy("holder").agg(F.count(F.lit(1)).alias("_n"))
    holders = written(named.join(holders.select("holder", F.col("m.license").alias("dir_license")).hint("merge"), "holder"))
    near = look_up(ancestors, holders, "holder", ancestors.count()).groupBy("dir").agg(F.max(F.struct("depth", "holder", "dir_license")).alias("m"))
    near = written(places.join(near.select("dir", F.col("m.holder").alias("from_dir"), "m.dir_license").hint("merge"), "dir", "left"))
    mine = own.select(*[F.col(c).alias(f"own_{c}") for c in (*key, "license", "similarity")])
    same = F.col("id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path"))
    out = written(rows.select(*key).withColumn("dir", folder).join(mine.hint("merge"), same, "left"))
    alone = out.filter(F.col("dir").isNull()).withColumns({"from_dir": F.lit(None).cast("string"), "dir_license": F.lit(None).cast("string")})
    out = look_up(out, near, "dir", out.count()).unionByName(alone)
    has = F.col("own_license").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.col("path").alias(path_col),
        F.coalesce("own_license", "dir_license").alias("license"),
        F.col("own_similarity").alias("similarity"),
        F.when(has, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("from_dir")).alias("from_dir"),
    )


def part_licenses(parts: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """``key``, the most similar ``license`` and the ``similarity``, for every different part.

    A notice that a third of all files carry is compared once. Parts without a word of any template are
    left out.
    """
    different = written(parts.select("key", "part").dropDuplicates(["key"]))
    if templates is None:
        templates = parts.sparkSession.createDataFrame([(k, t) for k, v in sorted(TEMPLATES.items()) for t in v], "license string, text string")
    templates = templates.filter(F.col("license").isNotNull() & F.col("text").isNotNull()).select("license", "text").distinct()
    spoken = written(different.select("key", F.explode(terms("part")).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf")))
    given = written(templates.select("license", F.xxhash64("text").alias("text"), F.explode(terms("text")).alias("term")).groupBy("license", "text", "term").agg(F.count(F.lit(1)).alias("tf")))
    frequency = spoken.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).join(given.groupBy("term").agg(F.count(F.lit(1)).alias("more")).hint("merge"), "term", "full")
    number = different.count() + templates.count()
    df = F.coalesce("_n", F.lit(0)) + F.coalesce("more", F.lit(0))
    idf = written(frequency.select("term", F.coalesce("_n", F.lit(0)).alias("_n"), (F.log((F.lit(float(number)) + 1) / (df + 1)) + 1).alias("idf")))
    spoken = written(look_up(spoken, idf, "term", spoken.count()).select("key", "term", (F.col("tf") * F.col("idf")).alias("w")))
    given = given.join(idf.drop("_n").hint("merge"), "term").select("license", "text", "term", (F.col("tf") * F.col("idf")).alias("v"))
    given = given.withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("license", "text"))))
    norm = spoken.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("part_norm"))
    given = written(given)
    few = given.count() <= BROADCAST_TERMS
    dot = spoken.join(F.broadcast(given) if few else given.hint("merge"), "term").groupBy("key", "license", "text").agg(F.sum(F.col("w") * F.col("v") / F.col("norm")).alias("dot"))
    cosine = dot.join(norm.hint("merge"), "key").select("key", "license", F.round(F.col("dot") / F.col("part_norm"), 6).alias("similarity"))
    # a tag names its licence outright
    tag = F.lower(F.regexp_extract("part", SPDX, 1))
    names = templates.select("license", F.lower("license").alias("tag")).distinct()
    tagged = different.withColumn("tag", tag).filter("tag <> ''").join(names.hint("merge"), "tag").select("key", "license", F.lit(1.0).alias("similarity"))
    cosine = cosine.join(tagged.select("key").hint("merge"), "key", "left_anti").unionByName(tagged)
    best = cosine.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "license")).alias("m"))
    return best.select("key", F.col("m.license").alias("license"), (-F.col("m.minus")).alias("similarity"))
