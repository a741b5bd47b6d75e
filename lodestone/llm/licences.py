"""Licence scans by sentence rules, in DataFrame functions only.

Lines that a sentence is wrapped over are joined: those that end in a comma or a joining word, or go on in lower case,
in capitals or with a quotation mark, with comment marks in front or not. The text is then split into sentences at
``.``, ``!``, ``?`` before white space, at a colon before a capitalised word and at the other line ends; each is normalised (A-Z lowered, all but letters a-z
and digits to single spaces; "this file is distributed under the terms of the" and the like become "licensed under")
and looked up among known licence sentences. The identifiers found, in order, are matched against ordered rules: each
rule is a sequence of identifiers and, where it occurs, becomes its licence, so earlier rules bind first and a sentence
counts for one licence only. Every identifier has a rule of its own at the end, so none is dropped: a sentence that
speaks of a licence but isn't known is ``Unknown``, a line that names an owner and a year ``Copyright``.

Rules and sentences are fixed tables; they are literals of the plan, so no row leaves its partition. Nulls and empty
texts have no sentences and no licences. Repeated licences are listed once, in order of first match. Columns
``sentence_ids`` and ``licences`` of docs are replaced; all others, whatever their names, stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wording of public licences and of their notices, by identifier.
WORDING = {
    "MitGrant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "MitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "AsIs": [
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement',
        'The software is provided "as is", without warranty of any kind, express or implied',
        'The software is provided "as is", without warranty of any kind',
    ],
    "MitLiable": ["In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"],
    "IscGrant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "IscAsIs": ['The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness'],
    "IscLiable": ["In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software"],
    "BsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BsdNames": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of the copyright holder nor the names of the contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "BsdAsIs": [
        'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed',
    ],
    "BsdLiable": [
        "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage",
        "In no event shall the copyright owner or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage",
    ],
    "BsdStyle": ["Use of this source code is governed by a BSD-style license", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "ApacheNotice": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'],
    "ApacheRef": ['Licensed under the Apache License, Version 2.0 (the "License")', "Licensed under the Apache License, Version 2.0, the License"],
    "ApacheNoUse": ["you may not use this file except in compliance with the License"],
    "ApacheCopy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "ApacheUrl": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "ApacheAsIs": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "ApacheSee": ["See the License for the specific language governing permissions and limitations under the License"],
    "ApacheVersion": ["Version 2.0, January 2004"],
    "GplV3Later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3, or (at your option) any later version",
    ],
    "GplV2Later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2, or (at your option) any later version",
    ],
    "GplV2Only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "LgplV3Later": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "LgplV21Later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "AgplV3Later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "GplNoWarranty": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ],
    "GplSee": ["See the GNU General Public License for more details", "See the GNU Lesser General Public License for more details", "See the GNU Affero General Public License for more details"],
    "GplCopy": [
        "You should have received a copy of the GNU General Public License along with this program",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "You should have received a copy of the GNU Affero General Public License along with this program",
    ],
    "GplUrl": ["If not, see <https://www.gnu.org/licenses/>", "If not, see <http://www.gnu.org/licenses/>"],
    "GplName": ["GNU General Public License"],
    "LgplName": ["GNU Lesser General Public License"],
    "AgplName": ["GNU Affero General Public License"],
    "GplVersion3": ["Version 3, 29 June 2007", "Version 3, 19 November 2007"],
    "GplVersion2": ["Version 2, June 1991"],
    "LgplVersion21": ["Version 2.1, February 1999"],
    "MplNotice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v", "Subject to the terms of the Mozilla Public License, v. 2.0"],
    "MplCopy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "UnlicenseGrant": ["This is free and unencumbered software released into the public domain"],
    "Cc0Waiver": ["To the extent possible under law, the author has waived all copyright and related rights to this work", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "AllRights": ["All rights reserved"],
}

#: Names that a licence goes by; "licensed under" one of them, or one as a title, or with an SPDX tag, is its reference.
NAMES = {
    "MIT": ["MIT License", "MIT License (MIT)"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause License", "3-Clause BSD License", "New BSD License", "BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL version 2", "GPLv2"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GPL version 2 or later", "GPLv2+"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL version 3", "GPLv3"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GPL version 3 or later", "GPLv3 or later"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPL version 2.1", "LGPLv2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPL version 3", "LGPLv3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPL version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal License", "CC0 1.0 Universal License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}

#: Ordered rules: a sequence of identifiers and the licence that it means; longer sequences come before their parts.
RULES = [
    (["MitGrant", "MitNotice", "AsIs", "MitLiable"], "MIT"),
    (["MitGrant", "MitNotice", "AsIs"], "MIT"),
    (["MitGrant", "MitNotice"], "MIT"),
    (["IscGrant", "IscAsIs", "IscLiable"], "ISC"),
    (["IscGrant", "IscAsIs"], "ISC"),
    (["BsdGrant", "BsdSource", "BsdBinary", "BsdNames", "BsdAsIs", "BsdLiable"], "BSD-3-Clause"),
    (["BsdGrant", "BsdSource", "BsdBinary", "BsdNames", "BsdAsIs"], "BSD-3-Clause"),
    (["BsdGrant", "BsdSource", "BsdBinary", "BsdNames"], "BSD-3-Clause"),
    (["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiable"], "BSD-2-Clause"),
    (["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs"], "BSD-2-Clause"),
    (["BsdGrant", "BsdSource", "BsdBinary"], "BSD-2-Clause"),
    (["ApacheNotice", "ApacheCopy", "ApacheUrl", "ApacheAsIs", "ApacheSee"], "Apache-2.0"),
    (["ApacheNotice", "ApacheCopy", "ApacheAsIs", "ApacheSee"], "Apache-2.0"),
    (["ApacheRef", "ApacheNoUse", "ApacheCopy"], "Apache-2.0"),
    (["ApacheRef", "ApacheNoUse"], "Apache-2.0"),
    (["ApacheNotice", "ApacheCopy"], "Apache-2.0"),
    (["GplV3Later", "GplNoWarranty", "GplSee", "GplCopy", "GplUrl"], "GPL-3.0-or-later"),
    (["GplV3Later", "GplNoWarranty", "GplSee", "GplCopy"], "GPL-3.0-or-later"),
    (["GplV3Later", "GplNoWarranty", "GplSee"], "GPL-3.0-or-later"),
    (["GplV2Later", "GplNoWarranty", "GplSee", "GplCopy", "GplUrl"], "GPL-2.0-or-later"),
    (["GplV2Later", "GplNoWarranty", "GplSee", "GplCopy"], "GPL-2.0-or-later"),
    (["GplV2Later", "GplNoWarranty", "GplSee"], "GPL-2.0-or-later"),
    (["GplV2Only", "GplNoWarranty", "GplSee"], "GPL-2.0-only"),
    (["LgplV3Later", "GplNoWarranty", "GplSee", "GplCopy", "GplUrl"], "LGPL-3.0-or-later"),
    (["LgplV3Later", "GplNoWarranty", "GplSee", "GplCopy"], "LGPL-3.0-or-later"),
    (["LgplV21Later", "GplNoWarranty", "GplSee", "GplCopy", "GplUrl"], "LGPL-2.1-or-later"),
    (["LgplV21Later", "GplNoWarranty", "GplSee", "GplCopy"], "LGPL-2.1-or-later"),
    (["AgplV3Later", "GplNoWarranty", "GplSee", "GplCopy", "GplUrl"], "AGPL-3.0-or-later"),
    (["AgplV3Later", "GplNoWarranty", "GplSee", "GplCopy"], "AGPL-3.0-or-later"),
    (["GplName", "GplVersion3"], "GPL-3.0-only"),
    (["GplName", "GplVersion2"], "GPL-2.0-only"),
    (["LgplName", "GplVersion3"], "LGPL-3.0-only"),
    (["LgplName", "LgplVersion21"], "LGPL-2.1-only"),
    (["AgplName", "GplVersion3"], "AGPL-3.0-only"),
    (["MplNotice", "MplCopy"], "MPL-2.0"),
]

#: What a single identifier that no sequence has taken means.
SINGLE = {
    **dict.fromkeys(("MitGrant", "MitNotice", "MitLiable"), "MIT"),
    **dict.fromkeys(("IscGrant", "IscAsIs", "IscLiable"), "ISC"),
    **dict.fromkeys(("BsdGrant", "BsdSource", "BsdBinary"), "BSD-2-Clause"),
    **dict.fromkeys(("BsdNames", "BsdStyle"), "BSD-3-Clause"),
    **dict.fromkeys(("ApacheNotice", "ApacheRef", "ApacheNoUse", "ApacheCopy", "ApacheUrl", "ApacheAsIs", "ApacheSee", "ApacheVersion"), "Apache-2.0"),
    **dict.fromkeys(("MplNotice", "MplCopy"), "MPL-2.0"),
    **dict.fromkeys(("AsIs", "BsdAsIs", "BsdLiable"), "LicenseRef-Disclaimer"),
    **dict.fromkeys(("GplNoWarranty", "GplSee", "GplCopy", "GplUrl", "GplName"), "LicenseRef-GPL"),
    "GplV3Later": "GPL-3.0-or-later", "GplV2Later": "GPL-2.0-or-later", "GplV2Only": "GPL-2.0-only", "GplVersion3": "GPL-3.0-only", "GplVersion2": "GPL-2.0-only",
    "LgplV3Later": "LGPL-3.0-or-later", "LgplV21Later": "LGPL-2.1-or-later", "LgplVersion21": "LGPL-2.1-only", "LgplName": "LicenseRef-LGPL",
    "AgplV3Later": "AGPL-3.0-or-later", "AgplName": "LicenseRef-AGPL", "UnlicenseGrant": "Unlicense", "Cc0Waiver": "CC0-1.0",
    "AllRights": "LicenseRef-AllRightsReserved", "Copyright": "LicenseRef-CopyrightNotice", "Unknown": "LicenseRef-Unknown",
    **{f"Ref:{name}": name for name in NAMES},
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[ \t]*\r?\n[ \t]*(?:(?:\*|//+|#+|;+|--+)[ \t]*)?"
#: A line end inside a sentence, by what stands before it, and by what stands around it.
WRAPS = [
    (r"(,|[ (](?:the|of|and|or|by|to|as|at|in|see|under|version|Version|GNU|General|Public|Lesser|Affero|Free|Software|Apache|Mozilla|THE|OF|AND|OR|BY|TO|FOR))" + _BREAK, 1),
    (r"([^.!?\x20\t\r\n])" + _BREAK + r"""([a-z(]|["'][A-Za-z]|[A-Z][A-Z ])""", 2),
]
#: A colon in front of a sentence's first words, and those; sentences also end at a mark with white space behind it, and
#: at the other line ends.
HEADING = r":[ \t]+([A-Z][a-z]+ [a-z])"
ENDS, OTHER, AROUND = r"[.!?]+[ \t\r\n\f\x0B]|[\r\n]", r"[^a-z0-9\x01]+", r" ?\x01[ \x01]*"
#: Ways of saying "licensed under", in normalised sentences.
SUBJECT = r"^(this|the|these|all|our) ([a-z0-9]+ )?([a-z0-9]+ )?(is|are) (also )?"
VERB = r"^(licensed|released|distributed|available|provided|published|made available)( to you)? under ((the )?terms (and conditions )?of )?(the |a |an )?"
#: Every known sentence holds one of these words; a sentence that isn't known speaks of a licence if it holds one of SPEAKS.
LIKELY = "licen[cs]|copyright|redistribut|warrant|permission|liable|gpl|rights reserved|unencumbered|cc (by|0)|cc0|mpl 2|version [0-9]( [0-9])? ([0-9]+ )?(january|february|june|november) |free software"
SPEAKS = "(^| )(licensed|license|licence|licenses|licences|copyright|redistribution|warranty)( |$)"
OWNER = "^(c |portions )?copyright .*(19|20)[0-9][0-9]"


def normalised(sentence: str) -> str:
    """A sentence of the tables, as the scan normalises it."""
    plain = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()
    return re.sub(VERB, "licensed under ", re.sub(SUBJECT, "", plain))


def _sentences() -> dict[str, str]:
    """Identifiers by normalised sentence."""
    out = {}
    for spdx, names in NAMES.items():
        tag = spdx.replace("-only", "")
        forms = [*names, *(f"The {n}" for n in names), *(f"Licensed under the {n}" for n in [spdx, tag, *names]), *(f"SPDX-License-Identifier: {t}" for t in (spdx, tag))]
        out |= {normalised(x): f"Ref:{spdx}" for x in forms}
        out |= {normalised(x).removesuffix(" license"): f"Ref:{spdx}" for x in forms if normalised(x).startswith("licensed under")}
    return out | {normalised(x): name for name, forms in WORDING.items() for x in forms}


SENTENCES = _sentences()


def sentences(text: Column) -> Column:
    """Normalised sentences, in order."""
    whole = F.concat(text, F.lit("\n"))
    for pattern, groups in WRAPS:
        whole = F.regexp_replace(whole, pattern, " ".join(f"${k}" for k in range(1, groups + 1)) + " " * (groups == 1))
    marked = F.regexp_replace(F.regexp_replace(whole, HEADING, "\u0001$1"), ENDS, "\u0001")
    plain = F.regexp_replace(F.translate(marked, UPPER, LOWER), OTHER, " ")
    return F.split(F.ltrim(F.regexp_replace(plain, AROUND, "\u0001")), "\u0001")


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences, of owners and Unknown, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])

    def of(s: Column) -> Column:
        form = F.regexp_replace(F.regexp_replace(s, SUBJECT, ""), VERB, "licensed under ")
        return F.coalesce(known[form], F.when(s.rlike(OWNER), F.lit("Copyright")).when(s.rlike(SPEAKS), F.lit("Unknown")))

    found = F.transform(F.filter(sentences(text), lambda s: s.rlike(LIKELY)), of)
    return F.filter(found, lambda x: x.isNotNull())


def licences(sequence: Column) -> Column:
    """Licences of an identifier sequence, by the ordered rules."""
    joined = F.concat(F.lit(""), F.array_join(F.transform(sequence, lambda x: F.concat(F.lit("["), x, F.lit("]"))), ""))
    for ids, name in RULES:
        joined = F.replace(joined, F.lit("".join(f"[{x}]" for x in ids)), F.lit(f"<{name}>"))
    single = F.create_map(*[F.lit(x) for pair in SINGLE.items() for x in pair])
    marks = F.regexp_extract_all(joined, F.lit(r"[<\[]([^>\]]*)[>\]]"), F.lit(1))
    return F.array_distinct(F.transform(marks, lambda x: F.coalesce(single[x], x)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``sentence_ids`` and ``licences``, arrays of strings."""
    ids = identifiers(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn("sentence_ids", ids).withColumn("licences", licences(F.col("sentence_ids")))


def oracle() -> str:
    """DuckDB's SQL for the scan of table documents."""
    quoted = lambda x: x.replace("'", "''")
    cases = lambda pairs: " ".join(f"when '{a}' then '{b}'" for a, b in pairs.items())
    whole = "coalesce(text, '') || chr(10)"
    for pattern, groups in WRAPS:
        whole = f"regexp_replace({whole}, '{quoted(pattern)}', '{' '.join(f'{chr(92)}{k}' for k in range(1, groups + 1)) + ' ' * (groups == 1)}', 'g')"
    joined = "array_to_string(list_transform(ids, lambda x: '[' || x || ']'), '')"
    for ids, name in RULES:
        joined = f"replace({joined}, '{''.join(f'[{x}]' for x in ids)}', '<{name}>')"
    form = f"regexp_replace(regexp_replace(x, '{SUBJECT}', ''), '{VERB}', 'licensed under ')"
    return f"""
with marked as (select doc_id, translate(regexp_replace(regexp_replace({whole}, '{HEADING}', chr(1) || '\\1', 'g'), '{ENDS}', chr(1), 'g'), '{UPPER}', '{LOWER}') t from documents),
split as (select doc_id, list_filter(string_split(ltrim(regexp_replace(regexp_replace(t, '{OTHER}', ' ', 'g'), '{AROUND}', chr(1), 'g'), ' '), chr(1)), lambda x: regexp_matches(x, '{LIKELY}')) s from marked),
found as (select doc_id, list_filter(list_transform(s, lambda x: case {form} {cases(SENTENCES)} else case when regexp_matches(x, '{OWNER}') then 'Copyright' when regexp_matches(x, '{SPEAKS}') then 'Unknown' end end), lambda x: x is not null) ids from split),
matched as (select doc_id, ids, {joined} j from found),
named as (select doc_id, ids, list_transform(regexp_extract_all(j, '[<\\[]([^>\\]]*)[>\\]]', 1), lambda x: case x {cases(SINGLE)} else x end) l from matched)
select doc_id, array_to_string(ids, ' ') sentence_ids, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') licences from named"""
