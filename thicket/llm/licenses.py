"""License scans: normalised text against licence templates by the Dice coefficient of word bigrams.

SQL functions only. The units of a text are its lines, its paragraphs (cut at blank lines), its
sentences and the whole. A unit with ``a`` distinct bigrams can reach a coefficient ``t`` with a template of ``b`` only
if ``a`` lies between ``b * t / (2 - t)`` and ``b * (2 - t) / t``; units that fit no template by
their number of words are dropped before any bigram is made, and each other unit meets only the
templates whose size fits. The templates are a short constant list, so no join is needed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence notices, fixed values. The one-line ones are usual short forms; ``PUBLISHED`` adds the wording that licences publish.
TEMPLATES = {
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MPL-2.0": "This work is licensed under the Mozilla Public License, version 2.0.",
}
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by "
    "the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
)
_GNU_2 = (
    "{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by "
    "the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
)
_CC = "This work is licensed under {0} Creative Commons {1} 4.0 International License."
_CC_NAMES = {"CC-BY-4.0": "Attribution", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-SA-4.0": "Attribution-ShareAlike"}
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
#: Sentences and paragraphs of the published notices, headers and grants. What several licences share is named for the family.
PUBLISHED = {
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-permissions": "See the License for the specific language governing permissions and limitations under the License.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-binary": _BSD_BINARY,
    "BSD-3-Clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    **{f"{name}-notice": _CC.format("a", title) for name, title in _CC_NAMES.items()},
    "CC0-1.0-notice": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": _GNU_2.format("This program", "", 2),
    "GPL-3.0-header": _GNU.format("This program", "", 3),
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": _GNU_2.format("This library", "Lesser ", "2.1"),
    "LGPL-3.0-header": _GNU.format("This library", "Lesser ", 3),
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: Whole notices of several sentences, as they stand in one paragraph.
PUBLISHED |= {
    "BSD-disclaimer": PUBLISHED["BSD-warranty"] + " " + PUBLISHED["BSD-liability"],
    "MPL-2.0-notice": PUBLISHED["MPL-2.0-header"] + " " + PUBLISHED["MPL-2.0-copy"],
}
TEMPLATES |= PUBLISHED
#: A coefficient of at least ``MATCH[0] / MATCH[1]`` is a match.
MATCH = (9, 10)


def normal_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    out = {}
    for name, text in templates.items():
        w = normal_words(text)
        out[name] = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
    return out


def _words(text: Column) -> Column:
    """Runs of ASCII letters and digits, as they stand; they are lower-cased where they are compared."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, match: tuple[int, int] = MATCH, sentences: bool = True
) -> DataFrame:
    """Licences of every text.

    With ``sentences``, sentences (cut at blanks after a full stop, question or exclamation mark) are
    units too, across lines, so a notice is found inside a longer paragraph. Not found are a notice
    inside a longer sentence and licences or translations that are not listed. Full licence texts
    are found by those of their sentences that are listed.

    Returns one row per input row: ``id_col``, ``licenses`` (sorted names of matched templates; for
    each unit the template with the greatest coefficient, of equal ones the last by name),
    ``n_matches`` (matching units) and ``best`` (the greatest coefficient in
    thousandths, rounded down; 0 without a match). Equal units of a text count once. A unit with more
    bigrams, repeats included, than any template's bound allows is not compared.
    Null, blank and other texts have no licence. Repeated rows give repeated results; other columns
    are ignored; an empty table gives an empty result.
    """
    grams = template_bigrams(templates or TEMPLATES)
    num, den = match
    low = min(-(-len(b) * num // (2 * den - num)) for b in grams.values())
    high = max(len(b) * (2 * den - num) // num for b in grams.values())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = [F.split(text, "\n"), F.split(text, r"\n[\x20\x09-\x0D]*\n"), F.array(text)]
    if sentences:
        cut.append(F.split(text, r"(?<=[.!?])[\x20\x09-\x0D]+"))
    units = F.array_distinct(F.concat(*cut))
    units = F.filter(F.transform(units, _words), lambda w: (F.size(w) > low) & (F.size(w) <= high + 1))

    def coefficients(unit: Column) -> Column:
        return F.array(*[_against(unit, name, b, num, den) for name, b in sorted(grams.items())])

    fits = F.transform(
        F.transform(units, lambda w: F.transform(w, F.lower)),
        lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))),
    )
    rows = docs.select(F.col(id_col).alias("_id"), fits.alias("_units"))
    rows = rows.withColumn("_best", F.transform("_units", lambda u: F.array_max(coefficients(u))))
    rows = rows.withColumn("_hits", F.filter("_best", lambda x: x["at"] >= 0))
    names = F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["name"])))
    best = F.coalesce(F.array_max(F.transform("_hits", lambda x: x["at"])), F.lit(0))
    return rows.select(F.col("_id").alias(id_col), names.alias("licenses"), F.size("_hits").cast("long").alias("n_matches"), best.cast("long").alias("best"))


def _against(unit: Column, name: str, template: list[str], num: int, den: int) -> Column:
    size = len(template)
    fits = (F.size(unit) * (2 * den - num) >= size * num) & (F.size(unit) * num <= size * (2 * den - num))
    shared = F.size(F.array_intersect(unit, F.array(*map(F.lit, template))))
    total = F.size(unit) + size
    at = F.when(fits, F.when(shared * 2 * den >= total * num, F.floor(shared * 2000 / total).cast("int")))
    # array_max takes the greatest coefficient, then the last name
    return F.struct(F.coalesce(at, F.lit(-1)).alias("at"), F.lit(name).alias("name"))
