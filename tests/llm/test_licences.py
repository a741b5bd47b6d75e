import re
import textwrap

import duckdb
import pytest

from lodestone.llm import licences

TEXTS = [
    None,
    "",
    "No rights here.",
    "Intro.\nThis work is licensed under the GNU General Public License, version 3.\nEnd",
    "LICENSED under the Apache License, Version 2.0. You may not use this file except in compliance with the License! more",
    "Released under the MIT License. All rights reserved.",
    "Released under the MIT License.\nReleased under the MIT License.",
    "Licensed under CC BY-NC 4.0.",
    "Subject to a custom licence of ours; all else is free.",
    "İstanbul ÉCOLE: Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "word " * 30_000 + ". Released under the MIT License.",
]


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licences string")
    return {r.doc_id: (r.sentence_ids, r.licences) for r in licences.scan(df).collect()}


def test_rules_apply_in_order(spark):
    found = scanned(spark, TEXTS)
    assert found[0] == found[1] == found[2] == ([], [])
    assert found[3] == (["Ref:GPL-3.0-only"], ["GPL-3.0-only"])
    assert found[4] == (["Ref:Apache-2.0", "ApacheNoUse"], ["Apache-2.0"])
    assert found[5][1] == ["MIT", "LicenseRef-AllRightsReserved"]
    assert found[6] == (["Ref:MIT", "Ref:MIT"], ["MIT"])
    assert found[7][1] == ["CC-BY-NC-4.0"]
    assert found[8] == (["Unknown"], ["LicenseRef-Unknown"])
    assert found[9][1] == ["BSD-2-Clause"]
    assert found[10][1] == ["MIT"]


MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def wrapped(text, width, mark=""):
    """The text's paragraphs wrapped at a width, with a comment mark before each line."""
    return "\n".join(f"{mark}{line}" for p in text.split("\n") for line in textwrap.wrap(p, width) or [""])


def notices():
    """(text, licences): the licences' own words, whole, wrapped, in comments and inside other text."""
    out = []
    for text, names in ((MIT, {"MIT", "LicenseRef-CopyrightNotice"}), (BSD, {"BSD-3-Clause"}), (GPL, {"GPL-3.0-or-later"}), (APACHE, {"Apache-2.0"})):
        forms = [text, text.replace("\n", "\r\n"), f"Prose before it.\n\n{text}\n\nProse behind it.", *(wrapped(text, w) for w in (60, 72, 79, 80))]
        forms += [wrapped(text, 76, mark) for mark in ("# ", " * ", "// ", ";; ", "-- ")]
        out += [(f, names) for f in forms]
    return out


def test_whole_licences(spark):
    texts = notices()
    found = scanned(spark, [t for t, _ in texts])
    wrong = [(t, found[i]) for i, (t, names) in enumerate(texts) if not names >= set(found[i][1]) or not found[i][1]]
    assert not wrong, wrong[0]


@pytest.mark.parametrize(
    "line, licence",
    [
        ("This file is licensed under the MIT License", "MIT"),
        ("The code is released under the terms of the Apache License 2.0.", "Apache-2.0"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
        ("These files are made available under the BSD 3-Clause License.", "BSD-3-Clause"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0-or-later"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "CC0-1.0"),
        ("Copyright (c) 2021 A. N. Other", "LicenseRef-CopyrightNotice"),
        ("The licence of this one is a secret", "LicenseRef-Unknown"),
    ],
)
def test_references(spark, line, licence):
    assert scanned(spark, [line])[0][1] == [licence]


def test_tables_hang_together():
    ids = set(licences.SENTENCES.values())
    assert ids | {"Copyright", "Unknown"} == set(licences.SINGLE) and {i for rule, _ in licences.RULES for i in rule} <= ids
    assert all(re.search(licences.LIKELY, s) for s in licences.SENTENCES)


def test_like_sql(spark):
    texts = [*TEXTS, *(t for t, _ in notices())]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = {r[0]: (r[1], r[2]) for r in con.execute(licences.oracle()).fetchall()}
    assert want == {k: (" ".join(a), " ".join(b)) for k, (a, b) in scanned(spark, texts).items()}


def test_no_rows(spark):
    assert scanned(spark, []) == {}
