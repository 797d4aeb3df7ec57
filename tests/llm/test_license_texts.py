import pytest

from lumenweave.llm import license as lic

MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# distributed under the License is distributed on an "AS IS" BASIS,
# See the License for the specific language governing permissions and
# limitations under the License."""
GPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version. */"""


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"t/{n}/x.py", x) for n, x in lic.TEMPLATES.items()]
    rows += [(f"s/{n}{e}/x.py", f"# SPDX-License-Identifier: {n}{e}\nx = 1\n") for n in lic.TEMPLATES for e in ("", "-only", "-or-later", "+") if n != "Proprietary"]
    rows += [("m/notes.txt", MIT), ("m/deep/x.py", "x = 1"), ("a/x.py", APACHE + "\nx = 1"), ("g/x.c", GPL + "\nint x;"), ("g/y.c", "int y;"), ("w/x.py", MIT + "y = 2\n" * 3000), ("w/y.py", "y = 3")]
    return {r.path: (r.license, r.origin) for r in lic.scan(spark.createDataFrame(rows, "path string, text string")).collect()}


def test_every_template_by_its_own_text(found):
    assert {n: found[f"t/{n}/x.py"][0] for n in lic.TEMPLATES} == {n: n for n in lic.TEMPLATES}


def test_spdx_forms(found):
    got = {p: x for p, x in found.items() if p.startswith("s/")}
    assert all(x == (p[2:-5].removesuffix("-only").removesuffix("-or-later").removesuffix("+"), "header") for p, x in got.items()) and len(got) == 4 * (len(lic.TEMPLATES) - 1)


def test_full_texts_and_notices(found):
    assert found["m/notes.txt"] == ("MIT", "header") and found["m/deep/x.py"] == ("MIT", "directory")
    assert found["a/x.py"] == ("Apache-2.0", "header") and found["g/x.c"] == ("GPL-3.0", "header")
    assert found["w/x.py"] == ("MIT", "header") and found["w/y.py"] == (None, "none")


OTHERS = {
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "EPL": "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE. ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT. Contribution means in the case of the initial Contributor, the initial content distributed under this Agreement, and in the case of each subsequent Contributor changes to the Program, and additions to the Program, where such changes or additions originate from and are Distributed by that particular Contributor.",
    "gnu without a version": "This work is licensed under the GNU General Public License.",
}
MENTIONS = [
    "This file is NOT licensed under the Apache License, Version 2.0 (the License).",
    "The essay compares the GNU General Public License version 3, 29 June 2007, with others that are less well known.",
    "It was never released under the MIT License.",
    'A reader asked what "licensed under the Apache License, Version 2.0" may mean.',
    "I wonder which license they chose, and whether copyright matters at all.",
    "The parts of it aren't licensed under the GNU General Public License, version 3.",
]


def test_open_set(spark):
    """Licenses are named as themselves or not at all; what only speaks of one has none."""
    fill = lambda x: x.replace("Copyright (c)", "Copyright (c) 2021 Some Body and others")
    rows = [(f"full/{n}/LICENSE", fill(x)) for n, x in lic.FULL.items()] + [(f"notice/{n}/x.c", f"/* Copyright 2020 Some Body\n * {x} */\nint x;") for n, x in lic.NOTICES.items()]
    rows += [(f"plain/{n}/text", fill(x) + "\n" + "other words " * 40) for n, x in lic.FULL.items()]
    rows += [(f"other/{n}/LICENSE", x) for n, x in OTHERS.items()] + [(f"mention/{i}/x.md", "Some words before.\n" + x) for i, x in enumerate(MENTIONS)]
    got = {r.path: r.license for r in lic.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: x for p, x in got.items() if p.split("/")[0] in ("full", "notice", "plain") and x != p.split("/")[1]} == {}
    assert {p: x for p, x in got.items() if p.split("/")[0] in ("other", "mention") and x is not None} == {}


def test_many_license_files_shuffle_less_than_their_text(spark):
    """Terms travel under digests: 10,000 files of 1,500 words, a few of them different."""
    text = " ".join(f"word{i}" for i in range(1300)) + lic.FULL["MIT"]
    files = spark.range(2000).selectExpr("concat('r', id, '/LICENSE') as path", f"concat('{text.replace(chr(39), '')}', ' ', id % 50) as text")
    heads = lic.headers(files)
    plan = lic.scored(heads.selectExpr("unhex(sha2(header, 256)) as digest", "header").groupBy("digest").agg({"header": "min"}).withColumnRenamed("min(header)", "header"))._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert exchanges and all("header" not in x for x in exchanges)
