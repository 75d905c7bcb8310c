"""Licences in texts, recognised by their sentences.

A text is cut into sentences, which are normalised (ASCII lower case, only letters and digits, single spaces). A
sentence that is known becomes its identifier; the others are dropped. What is left, a short list of identifiers in the
order of the text, is matched against the licence rules, each an ordered list of identifiers.

Texts are cut twice: with line feeds as spaces, for sentences that run over lines, and with line feeds as ends, for
lines without a full stop. All of it is column expressions within the row: no shuffle, no Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import LOWER, UPPER

# Sentences of published licences. A sentence with an inner end (";" or ":" before a space) is listed in parts.
SENTENCES = {
    "mit-title": "MIT License",
    "mit-title-long": "The MIT License (MIT)",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-project": "This project is licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "no-event": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-licensed-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-program": "This program is licensed under the GNU General Public License, version 3.",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "gpl2-terms-end": "either version 2 of the License, or (at your option) any later version.",
    "gpl2-terms-start": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl-library": "This library is free software",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "spdx": "SPDX-License-Identifier",
    "name-mit": "MIT",
    "name-apache": "Apache-2.0",
    "name-gpl3": "GPL-3.0-or-later",
    "name-bsd3": "BSD-3-Clause",
    "name-isc": "ISC",
    "name-mpl2": "MPL-2.0",
}
#: (licence, identifiers that follow each other among the known sentences); the order is that of the answer.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-event")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-project",)),
    ("MIT", ("spdx", "name-mit")),
    ("Apache-2.0", ("apache-licensed-the", "apache-compliance", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("spdx", "name-apache")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-3.0-or-later", ("spdx", "name-gpl3")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl3-program",)),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms-start", "gpl2-terms-end", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-2.0", ("gpl2-work",)),
    ("LGPL", ("lgpl-library", "lgpl-terms")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("spdx", "name-bsd3")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("spdx", "name-isc")),
    ("MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("MPL-2.0", ("spdx", "name-mpl2")),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
)
#: Sentences and rules that the SQL of :func:`oracle` does not have.
LATER_SENTENCES = {
    "apache-copy-at": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    # lines of a comment are not empty, so the address has no end
    "apache-copy-unless": SENTENCES["apache-copy"] + " " + SENTENCES["apache-unless"],
    "mpl-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "name-gpl2": "GPL-2.0",
    "name-gpl2-only": "GPL-2.0-only",
    "name-gpl2-later": "GPL-2.0-or-later",
    "name-gpl3-plain": "GPL-3.0",
    "name-gpl3-only": "GPL-3.0-only",
    **{f"name-lgpl-{v}{e}": f"LGPL-{v}{e}" for v in ("2.0", "2.1", "3.0") for e in ("", "-only", "-or-later")},
    "either-2.1": "either version 2.1 of the License, or (at your option) any later version.",
    "either-3": "either version 3 of the License, or (at your option) any later version.",
    "lgpl2.1-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "name-bsd2": "BSD-2-Clause",
    "name-unlicense": "Unlicense",
    "name-cc-by-nc-4": "CC-BY-NC-4.0",
    "name-cc-by-sa-4": "CC-BY-SA-4.0",
    "name-cc-by-4": "CC-BY-4.0",
}
LATER_RULES = (
    ("Apache-2.0", ("apache-licensed-the", "apache-compliance", "apache-copy-at", "apache-url", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-compliance", "apache-copy-unless", "apache-see")),
    ("MPL-2.0", ("mpl-subject", "mpl-copy-https")),
    ("GPL-2.0", ("spdx", "name-gpl2")),
    ("GPL-2.0", ("spdx", "name-gpl2-only")),
    ("GPL-2.0-or-later", ("spdx", "name-gpl2-later")),
    ("GPL-3.0", ("spdx", "name-gpl3-plain")),
    ("GPL-3.0", ("spdx", "name-gpl3-only")),
    *((f"LGPL-{v}{'-or-later' if e == '-or-later' else ''}", ("spdx", f"name-lgpl-{v}{e}")) for v in ("2.0", "2.1", "3.0") for e in ("", "-only", "-or-later")),
    *((f"LGPL-{v}-or-later", (work, "lgpl-terms", end)) for v, end in (("2.0", "gpl2-terms-end"), ("2.1", "either-2.1"), ("3.0", "either-3")) for work in ("lgpl-library", "gpl-free")),
    *((f"LGPL-{v}-or-later", (work, terms)) for v, terms in (("2.1", "lgpl2.1-terms"), ("3.0", "lgpl3-terms")) for work in ("lgpl-library", "gpl-free")),
    ("BSD-2-Clause", ("spdx", "name-bsd2")),
    ("Unlicense", ("spdx", "name-unlicense")),
    ("CC-BY-NC-4.0", ("spdx", "name-cc-by-nc-4")),
    ("CC-BY-SA-4.0", ("spdx", "name-cc-by-sa-4")),
    ("CC-BY-4.0", ("spdx", "name-cc-by-4")),
)
ORDER = list(dict.fromkeys(licence for licence, _ in (*RULES, *LATER_RULES)))
#: The rules of a licence together, in the order of the answer.
ALL_RULES = sorted((*RULES, *LATER_RULES), key=lambda r: ORDER.index(r[0]))
#: Every rule has a sentence with one of these in it, within a word: a text without all of them has no licence.
ANCHORS = ("licens", "permission", "redistribut", "unencumbered")
#: A run of marks is looked at once, as a whole.
MARKS = r"(?<![.;:!?])[.;:!?]++(?=\s)"
ENDS = MARKS + r"|\n\s*\n"
LINE_ENDS = MARKS + r"|\n"
#: The rest of a line behind the SPDX mark, and what stands between the names of an expression.
EXPRESSION = r"spdx-license-identifier:[ \t]*([^\r\n]*)"
OPERATORS = r"[ \t]+(?:or|and|with[ \t]+[^ \t()]+)(?=[ \t(]|$)|[()*/>]"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


ALL_SENTENCES = SENTENCES | LATER_SENTENCES
ALL_NUMBERS = {name: i for i, name in enumerate(ALL_SENTENCES)}
ALL_BY_TEXT = {normalised(s): ALL_NUMBERS[name] for name, s in ALL_SENTENCES.items()}
#: What an SPDX name means, by its normalised form.
BY_NAME = {normalised(ALL_SENTENCES[sequence[1]]): licence for licence, sequence in ALL_RULES if sequence[0] == "spdx"}


def as_line(sequence: tuple[str, ...]) -> str:
    return "".join(f"<{ALL_NUMBERS[s]}>" for s in sequence)


def longer_rules(licence: str, sequence: tuple[str, ...]) -> list[str]:
    """Lines of other licences' rules of which this one is a part: where they match, it does not count."""
    return [as_line(other) for name, other in ALL_RULES if name != licence and len(other) > len(sequence) and as_line(sequence) in as_line(other)]


def identifiers(low: Column, ends: str) -> Column:
    """Numbers of the known sentences of a lower-cased text, in its order."""
    plain = F.regexp_replace(F.regexp_replace(low, ends, " \x01 "), "[^a-z0-9\x01]+", " ")
    sentences = F.transform(F.split(plain, "\x01"), lambda s: F.trim(s))
    known = F.filter(sentences, lambda s: s.isin(*ALL_BY_TEXT))
    numbers = F.create_map(*[F.lit(x) for pair in ALL_BY_TEXT.items() for x in pair])
    return F.transform(known, lambda s: F.element_at(numbers, s))


def spdx_names(low: Column) -> Column:
    """Normalised names in the SPDX expressions of a lower-cased text."""
    parts = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(EXPRESSION), F.lit(1)), lambda x: F.split(x, OPERATORS)))
    named = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "[^a-z0-9]+", " ")))
    return F.when(low.contains("spdx-license-identifier:"), named).otherwise(F.array().cast("array<string>"))


def line(ids: Column) -> Column:
    return F.concat(F.lit("<"), F.array_join(ids.cast("array<string>"), "><"), F.lit(">"))


def licences(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_known, sentences, licences.

    A text without a word of ANCHORS has n_known 0 and no sentences: no rule can match there. For the others,
    sentences names the known sentences in the order of the text (comma-joined), n_known their number. licences are
    those whose rule's identifiers stand one after the other among them, and not as part of a longer rule of another
    licence there, or that an SPDX expression names, each once, in the order of the rules. A null or empty text has none. Rows are independent of each other; other columns are ignored.
    """
    # the normalised sentence has no plus sign
    low = F.regexp_replace(F.translate("text", UPPER, LOWER), r"(gpl-[0-9.]+)\+", "$1-or-later")
    maybe = reduce(lambda a, b: a | b, [F.lower("text").contains(a) for a in ANCHORS])
    none = F.array().cast("array<int>")
    found = docs.select("doc_id", F.when(maybe, F.struct(identifiers(low, ENDS).alias("run"), identifiers(low, LINE_ENDS).alias("lines"))).alias("ids"), spdx_names(low).alias("spdx"))
    ids = found.select("doc_id", *[F.coalesce(F.col("ids")[k], none).alias(k) for k in ("run", "lines")], "spdx")
    matched = []
    for licence in ORDER:
        for sequence in (own for name, own in ALL_RULES if name == licence):
            for c in ("run", "lines"):
                seen = reduce(lambda x, other: F.replace(x, F.lit(other), F.lit("<>")), longer_rules(licence, sequence), line(F.col(c)))
                matched.append(F.when(seen.contains(as_line(sequence)), F.lit(licence)))
        names = [name for name, own in BY_NAME.items() if own == licence]
        if names:
            matched.append(F.when(F.arrays_overlap("spdx", F.array(*map(F.lit, names))), F.lit(licence)))
    longer = F.when(F.size("lines") > F.size("run"), F.col("lines")).otherwise(F.col("run"))
    names = F.array(*map(F.lit, ALL_SENTENCES))
    return ids.select(
        "doc_id",
        F.size(longer).cast("long").alias("n_known"),
        F.array_join(F.transform(longer, lambda i: F.element_at(names, i + 1)), ",").alias("sentences"),
        F.array_join(F.array_distinct(F.array_compact(F.array(*matched))), ",").alias("licences"),
    )


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    known = ", ".join(f"('{text}', {i}, '{list(ALL_SENTENCES)[i]}')" for text, i in ALL_BY_TEXT.items())
    lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    rules = ", ".join(f"({ORDER.index(licence)}, '{licence}', '{as_line(sequence)}', {lists(longer_rules(licence, sequence))})" for licence, sequence in ALL_RULES)
    spdx = ", ".join(f"({ORDER.index(licence)}, '{licence}', '{name}')" for name, licence in BY_NAME.items())
    maybe = " OR ".join(f"contains(lower(text), '{a}')" for a in ANCHORS)
    low = f"regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '(gpl-[0-9.]+)\\+', '\\1-or-later', 'g')"

    def numbers(ends: str) -> str:
        # a look-ahead in the splitter is a captured blank here
        plain = f"regexp_replace(regexp_replace(low, '{ends}', ' \x01 ', 'g'), '[^a-z0-9\x01]+', ' ', 'g')"
        return f"list_filter(list_transform(string_split({plain}, '\x01'), lambda s: element_at(m, trim(s))[1]), lambda k: k IS NOT NULL)"

    seen = lambda c: f"contains(list_reduce(list_prepend('<' || array_to_string({c}, '><') || '>', masks), lambda a, b: replace(a, b, '<>')), ids)"
    return f"""
WITH known(txt, id, name) AS (VALUES {known}), rules(n, licence, ids, masks) AS (VALUES {rules}), spdx(n, licence, name) AS (VALUES {spdx}),
maps AS (SELECT map(list(txt ORDER BY id), list(id ORDER BY id)) AS m, list(name ORDER BY id) AS names FROM known),
lowered AS (SELECT doc_id, text, {low} AS low, row_number() OVER () AS r FROM documents),
cut AS (
  SELECT doc_id, r, names,
    CASE WHEN {maybe} THEN {numbers('[.;:!?]+[ \t\n\x0b\f\r]|\n[ \t\n\x0b\f\r]*\n')} ELSE [] END AS run,
    CASE WHEN {maybe} THEN {numbers('[.;:!?]+[ \t\n\x0b\f\r]|\n')} ELSE [] END AS lines
  FROM lowered, maps
), picked AS (
  SELECT *, CASE WHEN len(lines) > len(run) THEN lines ELSE run END AS longer FROM cut
), expressions AS (
  SELECT r, unnest(string_split(regexp_replace(expression, '[ \t]+(or|and|with[ \t]+[^ \t()]+)([ \t]|$)|[()*/>]', '\x01', 'g'), '\x01')) AS part
  FROM (SELECT r, unnest(regexp_extract_all(low, 'spdx-license-identifier:[ \t]*([^\r\n]*)', 1)) AS expression
    FROM lowered WHERE contains(low, 'spdx-license-identifier:'))
), hits AS (
  SELECT r, list(licence ORDER BY n) AS licences FROM (
    SELECT DISTINCT r, licence, n FROM (
      SELECT r, licence, n FROM picked JOIN rules ON {seen('run')} OR {seen('lines')} WHERE len(longer) > 0
      UNION ALL SELECT r, licence, n FROM expressions JOIN spdx ON trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) = name))
  GROUP BY r
)
SELECT doc_id, len(longer)::BIGINT AS n_known,
  coalesce(array_to_string(list_transform(longer, lambda i: names[i + 1]), ','), '') AS sentences,
  coalesce(array_to_string(licences, ','), '') AS licences
FROM picked LEFT JOIN hits USING (r)
"""
