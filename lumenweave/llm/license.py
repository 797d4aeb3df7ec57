"""License scans: TF-IDF cosine of headers and license files to templates, then inheritance from the nearest directory.

The cosine decides: the best template's license is a text's own if it is near enough, by a margin nearer than any other
license, and if the header grants something, or the file is named as a license. What only mentions a license, quotes a
grant or denies it has none, and a license that no template has is none rather than the next best.

Only DataFrame functions run. Texts are read once for their license lines; each distinct header's terms are weighed
against the templates' once, and files without a license of their own take that of the nearest directory above them,
found by joins on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import prepare, table, text_column

#: Fixed notices that headers are compared with.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0, Creative Commons Attribution NonCommercial 4.0 International License.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal by Creative Commons.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
    "Unlicense": "This is free and unencumbered software released into the public domain under the Unlicense.",
}
#: Fixed texts of licenses and of the notices that they ask for, with which license files are compared.
FULL = {
    "MIT": """MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": """BSD 3-Clause License Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names
of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0": """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms
and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is
granting the License. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license
document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. This program is free software: you can redistribute
it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
}
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
FULL["ISC"] = f"ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS}"
FULL["BSD-2-Clause"] = FULL["BSD-3-Clause"].replace("BSD 3-Clause", "BSD 2-Clause").replace(
    """Neither the name of the copyright holder nor the names
of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. """, "")  # fmt: skip
FULL["Unlicense"] = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be
an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to unlicense.org"""
#: Notices that licenses ask for in each file.
_GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
NOTICES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0",
} | {name: _GNU_NOTICE.format(kind, n) for name, kind, n in (("AGPL-3.0", "Affero ", 3), ("LGPL-3.0", "Lesser ", 3), ("GPL-3.0", "", 3), ("GPL-2.0", "", 2))}
#: Least cosine of a header to the template whose license it has, and of one of more terms than SHORT; and what it is
#: nearer by than the best template of another license.
LEAST, LEAST_LONG, SHORT, MARGIN = 0.35, 0.7, 60, 0.01
#: Terms one of which a header must hold to have a license of that version, as its name alone is shared by versions.
VERSIONS = {"GPL-2.0": ["2", "2.0", "v2"]} | dict.fromkeys(["GPL-3.0", "LGPL-3.0", "AGPL-3.0"], ["3", "3.0", "v3"])
#: What grants a license, and clauses that deny one or quote it, which don't count.
GRANT = r"(?i)licen[cs]ed (?:under|to)|(?:released|distributed|available|provided) (?:in)?(?:to|under)|under the terms|subject to the terms|permission |redistribution and use|public domain|all rights reserved|spdx-"
DENIED = r"(?i)\b(?:not|never|no longer|neither|isn't|aren't)\s+(?:\w+\s+){0,3}?(?:licen[cs]ed|released|dedicated)\b[^\n;]*"
QUOTED = r"""(?i)["“][^"”\n]*(?:licen[cs]ed|released|distributed|available) under[^"”\n]*["”]"""
#: A line that belongs to a license header, and terms of it.
HEADER = r"(?i)licen[cs]ed? |licen[cs]e\b|copyright|all rights reserved|public domain|spdx-"
#: SPDX identifiers, and where in a text licenses' own words begin and end, if their end is there: what the cosine weighs.
SPDX = r"(?i)spdx-license-identifier:\s*\(?([a-z0-9.-]+?)(?:-only|-or-later|\+)?(?:[^a-z0-9.+-]|$)"
_GNU = r"gnu {0}general public license (?:version {1}, (?:29 june 2007|19 november 2007|june 1991)|as published by the free software foundation[,;] (?:either )?version {1}\b)"
PASSAGES = {
    "MIT": ("permission is hereby granted, free of charge, to any person obtaining a copy", "use or other dealings in the software"),
    "BSD-3-Clause": (r"redistribution and use in source and binary forms, with or without modification, are permitted (?:under the bsd 3-clause|.*?neither the name)", "possibility of such damage"),
    "BSD-2-Clause": (r"redistribution and use in source and binary forms, with or without modification, are permitted provided", "possibility of such damage"),
    "ISC": (r"permission to use, copy, modify, and ?(?:or)? distribute this software for any purpose", "performance of this software"),
    "Unlicense": ("this is free and unencumbered software", r"unlicense\.org"),
    "Apache-2.0": (r"apache license,? version 2\.0,? january 2004|licensed under the apache license, version 2\.0 \(the license\)", "end of terms and conditions|limitations under the license"),
    "MPL-2.0": (r"mozilla public license,? version 2\.0 =|subject to the terms of the mozilla public license, v\. 2\.0", r"defined by the mozilla public license, v\. 2\.0|mozilla\.org/mpl/2\.0"),
    "AGPL-3.0": (_GNU.format("affero ", 3), "<?https? ?www.gnu.org licenses ?>?"),
    "LGPL-3.0": (_GNU.format("lesser ", 3), "permanent authorization for you to choose that version"),
    "GPL-3.0": (_GNU.format("", 3), r"why-not-lgpl\.html"),
    "GPL-2.0": (_GNU.format("", 2), "possibility of such damages"),
    "CC0-1.0": (r"cc0 1\.0 universal", "with respect to this cc0 or use of the work"),
    "CC-BY-NC-4.0": (r"creative commons attribution-noncommercial 4\.0 international", r"creativecommons\.org\."),
    "CC-BY-4.0": (r"creative commons attribution 4\.0 international (?:public license|license \()", r"creativecommons\.org\."),
}
_TERM = r"[a-z0-9]+(?:[.-][0-9a-z]+)*"
#: Names of license files, and the share of a text that header lines make up if it is one by content.
FILE_NAME, FILE_SHARE = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$", 0.4


def terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def all_templates(templates: dict[str, str] = TEMPLATES, full: dict[str, str] = FULL, notices: dict[str, str] = NOTICES) -> list[tuple[str, str]]:
    return [*templates.items(), *full.items(), *notices.items()]


def weights(templates: list[tuple[str, str]] | None = None) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """Inverse document frequencies of the templates' terms, that of other terms, and each template's license and unit vector."""
    templates = templates or all_templates()
    n = len(templates)
    counts = [Counter(terms(text)) for _, text in templates]
    holds = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + n) / (1 + holds[t])) + 1 for t in sorted(holds)}
    out = []
    for (name, _), own in zip(templates, counts):
        raw = {t: k * idf[t] for t, k in own.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.append((name, {t: x / norm for t, x in raw.items()}))
    return idf, math.log(1 + n) + 1, out


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def identified(text: Column) -> Column:
    """The license that a text names by an SPDX identifier, else null."""
    return F.try_element_at(_map({n.lower(): n for n in TEMPLATES}), F.lower(F.regexp_extract(text, SPDX, 1)))


def passage(text: Column) -> Column:
    """The stretch of a text, in lower case and without marks of comments, in which a license's own words stand; else null.

    A notice of the GNU kind begins before its name does, so some words before are taken along.
    """
    flat = F.regexp_replace(F.lower(text), r"[\s*#/;\"“”]+", " ")
    found = F.lit(None).cast("string")
    for start, end in reversed(PASSAGES.values()):
        own = F.regexp_extract(flat, f"(?:this (?:program|library|file) is free software.{{0,120}}?)?(?:{start})(?:.*(?:{end})|.{{0,120}}any later version)?", 0)
        found = F.when(own != "", own).otherwise(found)
    return F.when(found.isNotNull(), F.struct(found.alias("text"), (F.length(found) / F.greatest(F.length(flat), F.lit(1))).alias("share")))


def headers(files: DataFrame) -> DataFrame:
    """files (path, text, ...) to (path, row: their other columns, header, header_share, spdx): one pass, written once.

    The header is the whole text of a file that is named as a license file, else the stretch of a license's own words, else
    the license lines; clauses that deny or quote a grant are left out, and a header that grants nothing is empty.
    """
    prepare(files.sparkSession)
    text = text_column(files)
    some = F.lower(text).rlike("licen|copyright|rights reserved|spdx|permission|redistribution and use|public domain")
    granted = F.when(some, F.regexp_replace(F.regexp_replace(text, DENIED, " "), QUOTED, " ")).otherwise("")
    files = files.select("path", F.struct(*[c for c in files.columns if c != "text"]).alias("row"), F.length(text).alias("n_text"), text.alias("text"), granted.alias("granted"))
    lines = F.array_join(F.filter(F.split("granted", "\n"), lambda x: x.rlike(HEADER)), "\n")
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    worth = F.lower("granted").rlike("cc0 |public licen|permission |redistribution and use|apache licen|creative commons|unencumbered")
    cut = files.select("path", "row", "n_text", named.alias("named"), F.when(named, F.col("text")).otherwise(lines).alias("lines"), F.when(worth & ~named, passage(F.col("granted"))).alias("own"), identified(F.col("granted")).alias("spdx")).checkpoint()
    header = F.when(F.length("own.text") > F.length("lines"), F.col("own.text")).otherwise(F.col("lines"))
    granting = F.col("named") | header.rlike(GRANT)
    share = F.greatest(F.length("lines") / F.greatest("n_text", F.lit(1)), "own.share")
    return cut.select("path", "row", F.when(granting, header).otherwise("").alias("header"), share.alias("header_share"), "spdx")


def scored(heads: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Distinct headers (digest, header) to (digest, own_license, own_score): the license of the largest cosine, where it decides.

    Terms are counted and shuffled under the digest of their header, never its text.
    """
    idf, other, vectors = weights(templates)
    own = F.regexp_extract_all(F.lower("header"), F.lit(_TERM), F.lit(0))
    terms_ = heads.select("digest", F.explode(own).alias("t")).groupBy("digest", "t").agg(F.count("*").alias("n"))
    weighted = terms_.withColumn("w", F.col("n") * F.coalesce(F.try_element_at(_map(idf), "t"), F.lit(other)))
    dot = lambda v: F.sum(F.col("w") * F.coalesce(F.try_element_at(_map(v), "t"), F.lit(0.0)))
    held = {n: F.bool_or(F.col("t").isin(VERSIONS[n])) for n in ("GPL-2.0", "GPL-3.0")}
    sums = weighted.groupBy("digest").agg(F.sum("n").alias("n"), *(x.alias(n) for n, x in held.items()), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *(dot(v).alias(f"d{i}") for i, (_, v) in enumerate(vectors)))
    each = F.array(*(F.struct((F.col(f"d{i}") / F.col("norm")).alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, _) in enumerate(vectors)))
    best = sums.select("digest", "n", *(f"`{n}`" for n in held), each.alias("each")).withColumn("best", F.array_max("each"))
    next_ = F.array_max(F.transform(F.filter("each", lambda x: x["name"] != F.col("best.name")), lambda x: x["score"]))
    least = F.when(F.col("n") > SHORT, LEAST_LONG).otherwise(LEAST)
    version = F.when(F.col("best.name") == "GPL-2.0", F.col("`GPL-2.0`")).when(F.col("best.name").isin([*VERSIONS]), F.col("`GPL-3.0`")).otherwise(True)
    decides = version & (F.col("best.score") >= least) & (F.col("best.score") - F.coalesce(next_, F.lit(0.0)) >= MARGIN)
    return best.select("digest", F.when(decides, F.col("best.name")).alias("own_license"), F.round("best.score", 6).alias("own_score"))


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """files (path, text) to all rows as (path, license, score, origin, inherited_from).

    score is the cosine, and 1 for a license that the text names by its SPDX identifier.
    origin: header (its own), directory (of the nearest directory above or beside it with a license file, named in
    inherited_from) or none. A directory with several license files has the license of the best score, then least path.
    Null and empty texts have no header; a null path inherits nothing; repeated rows stay; other columns are kept unless
    they clash with the new ones, which win. An empty table gives no rows. Of equal scores and paths in a directory the
    license of the lesser name counts.
    """
    cut = headers(files).withColumn("own_dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    headed, bare = cut.where("header != ''"), cut.where("header = ''")
    headed = headed.withColumn("digest", F.unhex(F.sha2("header", 256)))
    best = scored(headed.groupBy("digest").agg(F.min("header").alias("header")), templates)
    found = headed.join(best, "digest", "left").select(*cut.columns, "own_license", "own_score")
    rows = found.unionByName(bare.withColumns({"own_license": F.lit(None).cast("string"), "own_score": F.lit(None).cast("double")}))
    named = F.col("spdx").isNotNull()
    rows = rows.withColumns({"own_license": F.coalesce("spdx", "own_license"), "own_score": F.when(named, F.lit(1.0)).otherwise(F.col("own_score"))})
    is_file = F.col("own_license").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(FILE_NAME) | (F.col("header_share") >= FILE_SHARE))
    dirs = rows.where(is_file).groupBy(F.col("own_dir").alias("above")).agg(F.min_by(F.struct("own_license", "own_score"), F.struct(-F.col("own_score"), F.col("path"), F.col("own_license"))).alias("x"))
    names = F.split("own_dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(names)), lambda i: F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(names, 1, i), "/")))
    asked = rows.where("own_license is null and path is not null").select("own_dir").distinct().select("own_dir", F.explode(F.array_distinct(ups)).alias("above"))
    near = asked.join(dirs, "above").groupBy("own_dir").agg(F.max_by(F.struct("above", "x"), F.length("above")).alias("near"))
    out = rows.join(near, "own_dir", "left")
    own = F.col("own_license").isNotNull()
    from_above = ~own & F.col("near").isNotNull() & F.col("path").isNotNull()
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in files.columns if c not in ("license", "score", "origin", "inherited_from", "text")],
        F.when(own, F.col("own_license")).when(from_above, F.col("near.x.own_license")).alias("license"),
        F.when(own, F.col("own_score")).when(from_above, F.col("near.x.own_score")).alias("score"),
        F.when(own, "header").when(from_above, "directory").otherwise("none").alias("origin"),
        F.when(from_above, F.col("near.above")).alias("inherited_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, then directories of 1,000 and of 20 consecutive ids."""
    path = F.concat_ws("/", F.col("source"), F.concat(F.lit("k"), F.floor(F.col("doc_id") / 1000)), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 20)), F.concat(F.lit("doc"), F.col("doc_id")))
    return docs.withColumn("path", path)


def op6_license(spark, sf_dir):
    docs = document_paths(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return scan(docs).select("doc_id", "path", "license", "score", "origin", "inherited_from")
