"""License scans: a trained paragraph classifier, confirmed by comparison with templates; DataFrame functions only.

Paragraphs are cut by blank lines. As notices wrap and stand between other lines, a paragraph is judged by its units: every line,
and every two and three lines that follow each other. The features of a unit are the words and word pairs (stop words aside) it has in
common with the labelled notices below. A multinomial logistic regression over these sparse features tells licence families and
the class ``unknown`` apart. It is fitted on the labelled rows alone (about 200, the bound of the training set), on the
driver; its temperature is fitted on predictions for rows that were held out, each in one of ``FOLDS`` folds.

A prediction counts if its probability reaches ``LEAST`` and a template of the family confirms it: the unit has at least ``AGREE`` of the
template's words and pairs, and of the words that decide between families (versions, and words as ``lesser``, ``noncommercial``,
``sharealike``) exactly those of the template. A paragraph names the families of its
confirmed units; one without a version (``GENERAL``) only where none with a version is named.

The weights and the templates are of fixed size and are broadcast. A notice has one of the words in ``TRIGGERS``; units without one are
unknown and go first. All others are split into features, which meet the weights in a broadcast join and are summed up for each unit.

Defined cases: a null or empty text has no paragraphs and no licence; paragraphs of any length are taken whole; of families with
equal scores the first in the list below counts; a family found in several paragraphs is counted each time and named once; repeated
rows get equal results; ids may be null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm._shared import keyed

UNKNOWN = "unknown"
LEAST = 0.4
#: Least share of a template's words and pairs that a unit has.
AGREE = 0.7
FOLDS = 5
LINES = 3
WORD = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"

# Words that say nothing about a licence.
STOP_WORDS = "a an and are as at by can do each for from has have if in into is it its no not of on or other our so such that the their there these they this to under was we were which who will with you your all any may must shall be des die das der und ein les le la el de que en un una del los per sie wir".split()

# Words of which a notice has one.
TRIGGERS = "license licensed licence licenced licenses spdx-license-identifier gpl gplv2 gplv3 lgpl lgplv3 agpl agplv3 mit apache bsd mpl mozilla isc boost unlicense cc cc0 cc-by creative creativecommons.org redistribution redistribute permission contributors unencumbered unlicense.org".split()

# Words that decide between families, beside version numbers.
DECIDING = "lesser affero sharealike noderivatives noderivs noncommercial by-sa by-nd by-nc by-nc-sa by-nc-nd nc sa nd lgpl lgplv2.1 lgplv3 agpl agplv3 gplv2 gplv3 2-clause two-clause simplified 3-clause three-clause modified 1 1.0 1.1 2 2.0 2.1 2.5 3 3.0 4 4.0 v1 v2 v2.0 v2.1 v3 v3.0 v4.0 zero cc0 lgpl-2.1 lgpl-3.0 gpl-2.0 gpl-3.0".split()

#: Families without a version or variant, and those beside which they say nothing more.
GENERAL = {"GPL": ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"]}

# Labelled notices; the families' are templates too.
LABELLED = {
    "Apache-2.0": """
Licensed under the Apache License, Version 2.0.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
SPDX-License-Identifier: Apache-2.0
This project is released under the Apache License 2.0.
Distributed under the terms of the Apache 2.0 license.
Apache License Version 2.0, January 2004
Apache License, Version 2.0
Apache License 2.0
""",
    "MIT": """
Released under the MIT License.
This project is licensed under the MIT License.
SPDX-License-Identifier: MIT
The MIT License (MIT)
Licensed under MIT.
MIT License
Code is available under the terms of the MIT License.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction
""",
    "GPL-3.0": """
This work is licensed under the GNU General Public License, version 3.
under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version
SPDX-License-Identifier: GPL-3.0-or-later
SPDX-License-Identifier: GPL-3.0-only
Released under the GNU GPL v3.
GNU GENERAL PUBLIC LICENSE Version 3
Licensed under the GPL version 3.
distributed under the GNU General Public License v3.0.
GNU General Public License 3.0
Licensed under the GPLv3.
GNU GPLv3
GPL-3.0 license
""",
    "GPL-2.0": """
This work is licensed under the GNU General Public License, version 2.
under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version
SPDX-License-Identifier: GPL-2.0-or-later
SPDX-License-Identifier: GPL-2.0-only
Released under the GNU GPL v2.
GNU GENERAL PUBLIC LICENSE Version 2
Licensed under the GPL version 2.
distributed under the GNU General Public License v2.0.
GNU General Public License 2.0
Licensed under the GPLv2.
GNU GPLv2
GPL-2.0 license
""",
    "GPL": """
You should have received a copy of the GNU General Public License along with this program.
Licensed under the GNU General Public License.
Released under the GPL.
Distributed under the terms of the GNU GPL.
GNU General Public License
""",
    "LGPL-3.0": """
This library is licensed under the GNU Lesser General Public License, version 3.
under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version
SPDX-License-Identifier: LGPL-3.0-or-later
SPDX-License-Identifier: LGPL-3.0-only
GNU LESSER GENERAL PUBLIC LICENSE Version 3
Licensed under the LGPL version 3.
GNU Lesser General Public License v3.0
Released under the GNU LGPL v3.
Licensed under the LGPLv3.
""",
    "LGPL-2.1": """
This library is licensed under the GNU Lesser General Public License, version 2.1.
under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version
SPDX-License-Identifier: LGPL-2.1-or-later
SPDX-License-Identifier: LGPL-2.1-only
GNU LESSER GENERAL PUBLIC LICENSE Version 2.1
Licensed under the LGPL version 2.1.
GNU Lesser General Public License v2.1
Released under the GNU LGPL v2.1.
""",
    "AGPL-3.0": """
This work is licensed under the GNU Affero General Public License, version 3.
under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version
SPDX-License-Identifier: AGPL-3.0-or-later
SPDX-License-Identifier: AGPL-3.0-only
GNU AFFERO GENERAL PUBLIC LICENSE Version 3
Licensed under the AGPL version 3.
GNU Affero General Public License v3.0
Released under the GNU AGPL v3.
Licensed under the AGPLv3.
""",
    "MPL-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
Mozilla Public License, v. 2.0
Mozilla Public License Version 2.0
SPDX-License-Identifier: MPL-2.0
Licensed under the Mozilla Public License, version 2.0.
Released under the Mozilla Public License 2.0
Licensed under the MPL 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/
""",
    "BSD-3-Clause": """
Released under the BSD 3-Clause License.
SPDX-License-Identifier: BSD-3-Clause
Licensed under the 3-clause BSD license.
3-clause BSD license
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
This project is distributed under the three-clause BSD license.
Modified BSD License
""",
    "BSD-2-Clause": """
Released under the BSD 2-Clause License.
SPDX-License-Identifier: BSD-2-Clause
Licensed under the 2-clause BSD license.
2-clause BSD license
This project is distributed under the two-clause BSD license.
Simplified BSD License
""",
    "BSD": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.
Licensed under the BSD License.
Released under the BSD license.
BSD License
""",
    "ISC": """
Released under the ISC License.
This project is licensed under the ISC License.
SPDX-License-Identifier: ISC
ISC License
Licensed under ISC.
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
""",
    "BSL-1.0": """
Distributed under the Boost Software License, Version 1.0.
Boost Software License - Version 1.0
SPDX-License-Identifier: BSL-1.0
Licensed under the Boost Software License 1.0.
See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt
""",
    "Unlicense": """
This is free and unencumbered software released into the public domain.
SPDX-License-Identifier: Unlicense
Released under the Unlicense.
For more information, please refer to http://unlicense.org
Licensed under the Unlicense.
""",
    "CC0-1.0": """
Licensed under CC0 1.0.
This work is dedicated to the public domain under Creative Commons CC0 1.0 Universal.
SPDX-License-Identifier: CC0-1.0
Creative Commons Zero 1.0 Universal license
Released under CC0.
http://creativecommons.org/publicdomain/zero/1.0/
""",
    "CC-BY-4.0": """
Licensed under CC BY 4.0.
This work is licensed under a Creative Commons Attribution 4.0 International License.
SPDX-License-Identifier: CC-BY-4.0
Content is available under CC BY 4.0.
Text released under the Creative Commons Attribution license, version 4.0.
http://creativecommons.org/licenses/by/4.0/
Creative Commons Attribution 4.0 International
Licensed under CC-BY 4.0.
""",
    "CC-BY-SA-4.0": """
Licensed under CC BY-SA 4.0.
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
SPDX-License-Identifier: CC-BY-SA-4.0
Content is available under CC BY-SA 4.0.
Text released under the Creative Commons Attribution ShareAlike license, version 4.0.
http://creativecommons.org/licenses/by-sa/4.0/
Creative Commons Attribution Share Alike 4.0 International
""",
    "CC-BY-ND-4.0": """
Licensed under CC BY-ND 4.0.
This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.
SPDX-License-Identifier: CC-BY-ND-4.0
Content is available under CC BY-ND 4.0.
Text released under the Creative Commons Attribution NoDerivatives license, version 4.0.
http://creativecommons.org/licenses/by-nd/4.0/
""",
    "CC-BY-NC-4.0": """
Licensed under CC BY-NC 4.0.
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
SPDX-License-Identifier: CC-BY-NC-4.0
Content is available under CC BY-NC 4.0.
Text released under the Creative Commons Attribution NonCommercial license, version 4.0.
http://creativecommons.org/licenses/by-nc/4.0/
Creative Commons Attribution NonCommercial 4.0
""",
    "CC-BY-NC-SA-4.0": """
Licensed under CC BY-NC-SA 4.0.
This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.
SPDX-License-Identifier: CC-BY-NC-SA-4.0
Content is available under CC BY-NC-SA 4.0.
http://creativecommons.org/licenses/by-nc-sa/4.0/
""",
    "CC-BY-NC-ND-4.0": """
Licensed under CC BY-NC-ND 4.0.
This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.
SPDX-License-Identifier: CC-BY-NC-ND-4.0
Content is available under CC BY-NC-ND 4.0.
http://creativecommons.org/licenses/by-nc-nd/4.0/
""",
    UNKNOWN: """
The driver's license was renewed last week.
Please read the terms before you use the site.
Permission to park is granted to residents only.
The general public is invited to the meeting.
A copy of the report is available on request.
He works as a free software developer.
The version 3 of the map shows the new roads.
Apache tribes lived in the southwest.
All rights reserved.
The foundation published its annual report.
She graduated from MIT and works in Boston.
Creative work needs time and patience.
The commons were open to all villagers.
Version 2.0 of the game was released today.
The team received a license to broadcast.
Attribution of the painting is disputed.
The file contains the names of all members.
Commercial use of the hall costs extra.
Software and documentation are sold together.
Mit und ohne Strom.
Das ist mit der Zeit besser.
Public transport is free of charge on Sunday.
The source of the river was found.
Conditions on the road are bad.
Redistribution of income is a goal of the tax.
This program is broadcast on Monday.
Copyright 2020 by the author.
The international conference was held in June.
Each person obtained a ticket without restriction.
The restaurant lost its liquor license.
Released prisoners need support.
The clause was struck from the treaty.
The library has four floors.
A boost for the local economy.
The fishing license costs 20 dollars.
Licensed drivers may enter the race.
The marriage license was issued in Boston.
Permission to use the hall is granted by the mayor.
The contributors of the volume met in Paris.
The magazine is published under license.
Mozilla held a meeting in Berlin.
The work is in the public domain of debate.
License agreement
Terms of the license
Proprietary license, all rights reserved.
Commercial license required.
SPDX-License-Identifier: LicenseRef-Proprietary
Licensed under the terms of the contract.
""",
}


def words_of(text: str) -> list[str]:
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    return [w for w in re.findall(WORD, lower) if w not in _STOP]


_STOP = set(STOP_WORDS)


def grams_of(words: list[str]) -> set[str]:
    """Words and pairs of words that follow each other once stop words are gone."""
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def rows() -> list[tuple[str, str]]:
    return [(line, family) for family, lines in LABELLED.items() for line in lines.strip().split("\n")]


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@cache
def fit(steps: int = 200, rate: float = 2.0, decay: float = 1e-3) -> dict:
    """Classes, bias and weights by feature, divided by the temperature."""
    data = [(words_of(t), y) for t, y in rows()]
    known = sorted({g for ws, y in data if y != UNKNOWN for g in grams_of(ws)})
    at = {g: i for i, g in enumerate(known)}
    classes = [UNKNOWN, *(c for c in LABELLED if c != UNKNOWN)]
    # rows of the unknown class count for more where they share no feature with a notice: that is what most text looks like
    data += [([], UNKNOWN)] * 20
    y = np.array([classes.index(c) for _, c in data])
    own = [sorted(at[g] for g in grams_of(ws) if g in at) for ws, _ in data]
    row, feature = np.repeat(np.arange(len(data)), [len(o) for o in own]), np.array([f for o in own for f in o])
    size = np.sqrt(np.maximum([len(o) for o in own], 1))[:, None]
    truth = np.eye(len(classes))[y]

    def scores(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        out = np.repeat(bias[None, :], len(data), axis=0)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[first]] += np.add.reduceat(weights[feature], first)
        return out

    def train(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights, bias = np.zeros((len(known), len(classes))), np.zeros(len(classes))
        pairs = np.flatnonzero(some[row])
        pairs = pairs[np.argsort(feature[pairs], kind="stable")]
        first = np.flatnonzero(np.append(True, feature[pairs][1:] != feature[pairs][:-1]))
        for _ in range(steps):
            gap = np.exp(log_softmax(scores(weights, bias))) - truth
            up = np.add.reduceat((gap / size)[row[pairs]], first) / np.sqrt(some.sum())
            weights *= 1 - rate * decay
            weights[feature[pairs][first]] -= rate * up
            bias -= rate * gap[some].mean(axis=0)
        return weights, bias

    held = np.zeros((len(data), len(classes)))
    for fold in range(FOLDS):
        out = np.arange(len(data)) % FOLDS == fold
        held[out] = scores(*train(~out))[out]
    loss = lambda t: -log_softmax(held / t)[np.arange(len(data)), y].mean()
    heat = min((k / 8 for k in range(4, 41)), key=loss)
    weights, bias = train(np.ones(len(data), bool))
    return {"classes": classes, "bias": (bias / heat).tolist(), "weights": dict(zip(known, (weights / heat).tolist())), "heat": heat}


def templates() -> list[tuple[str, list[str], list[str]]]:
    """Family, words and pairs, and deciding words of each template."""
    return [(y, sorted(grams_of(ws := words_of(t))), sorted(set(ws) & set(DECIDING))) for t, y in rows() if y != UNKNOWN]


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.regexp_extract_all(lower, F.lit(f"({WORD})"), F.lit(1)), lambda w: ~w.isin(STOP_WORDS))


def _units_of(lines: str) -> Column:
    """Every line, and every two to ``LINES`` lines in a row, joined by a blank."""
    runs, n = [F.col(lines)], F.size(lines)
    for k in range(2, LINES + 1):
        # arrays are shifted once and joined place by place, which is linear in the lines
        rest = F.greatest(n - k + 1, F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], 1, rest), F.slice(lines, k, rest), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(*runs)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Units with a word of ``TRIGGERS``, once each: ``_k1``, ``_k2``, ``paragraph``, ``unit`` (numbers), ``own``.

    ``own`` holds the words and pairs that the weights, the templates or ``DECIDING`` name. No others are looked at later, so they stay out of the shuffle.
    """
    pattern = r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in TRIGGERS) + r")(?![a-z0-9])"
    texts = keyed(docs, id_col, text_col)
    some = texts.where(F.col("_text").rlike(pattern)).select("_k1", "_k2", F.posexplode(F.split("_text", r"\r?\n[ \t\r]*\n")).alias("paragraph", "body"))
    # the lines are split once, in a projection of their own
    units = some.where(F.col("body").rlike(pattern)).withColumn("lines", F.split("body", "\n")).select("_k1", "_k2", "paragraph", _units_of("lines").alias("units"))
    units = units.select("_k1", "_k2", "paragraph", F.posexplode("units").alias("unit", "body")).where(F.col("body").rlike(pattern))
    units = units.select("_k1", "_k2", "paragraph", "unit", _words(F.col("body")).alias("words"))
    rest = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, rest), F.slice("words", 2, rest), lambda a, b: F.concat_ws(" ", a, b))
    known = sorted({*fit()["weights"], *DECIDING})
    own = F.array_distinct(F.filter(F.concat("words", pairs), lambda g: g.isin(known)))
    units = units.select("_k1", "_k2", "paragraph", "unit", own.alias("own")).where(F.size("own") > 0)
    # units of copies of a row are equal; one of them stands for all
    return units.dropDuplicates(["_k1", "_k2", "paragraph", "unit"])


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Confirmed notices: ``_k1``, ``_k2`` (keys of the document), ``paragraph`` (its number), ``family``, ``probability``."""
    spark = docs.sparkSession
    model = fit()
    classes = model["classes"]
    units = features(docs, id_col, text_col)
    weights = spark.createDataFrame([(f, *w) for f, w in sorted(model["weights"].items())], "feature string, " + ", ".join(f"w{c} double" for c in range(len(classes))))
    grams = units.select("*", F.explode("own").alias("feature"))
    found = grams.join(F.broadcast(weights), "feature")
    key = ["_k1", "_k2", "paragraph", "unit"]
    sums = found.groupBy(*key).agg(F.first("own").alias("own"), *[(F.sum(f"w{c}") + model["bias"][c]).alias(f"z{c}") for c in range(len(classes))])
    top = F.greatest(*[F.col(f"z{c}") for c in range(len(classes))])
    total = sum((F.exp(F.col(f"z{c}") - top) for c in range(1, len(classes))), F.exp(F.col("z0") - top))
    best = F.coalesce(*[F.when(F.col(f"z{c}") == top, F.lit(name)) for c, name in enumerate(classes)])
    scored = sums.select("_k1", "_k2", "paragraph", "own", best.alias("family"), (1 / total).alias("probability"))
    scored = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST))
    known = spark.createDataFrame(templates(), "family string, grams array<string>, deciding array<string>")
    known = known.groupBy("family").agg(F.collect_list(F.struct("grams", "deciding")).alias("templates"))
    decides = F.array_sort(F.array_intersect("own", F.array(*[F.lit(w) for w in DECIDING])))
    fits = F.exists("templates", lambda t: (F.size(F.array_intersect(F.col("own"), t["grams"])) >= AGREE * F.size(t["grams"])) & (F.col("decides") == F.array_sort(t["deciding"])))
    return scored.withColumn("decides", decides).join(F.broadcast(known), "family").where(fits).select("_k1", "_k2", "paragraph", "family", "probability")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``id_col``, carried columns, ``families`` (sorted), ``n_licensed`` (paragraphs that name one), ``probability``.

    A paragraph has the greatest probability of its confirmed units, a document the least of such paragraphs (null without any).
    """
    each = paragraphs(docs, id_col, text_col).groupBy("_k1", "_k2", "paragraph").agg(F.collect_set("family").alias("families"), F.max("probability").alias("probability"))
    for general, special in GENERAL.items():
        named = F.arrays_overlap("families", F.array(*[F.lit(x) for x in special]))
        each = each.withColumn("families", F.when(named, F.array_remove("families", general)).otherwise(F.col("families")))
    found = each.groupBy("_k1", "_k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"), F.count("*").alias("n_licensed"), F.min("probability").alias("probability"))
    found = found.select(F.col("_k1").alias("_m1"), F.col("_k2").alias("_m2"), "families", "n_licensed", "probability")
    every = keyed(docs, id_col, text_col, carry).select("_k1", "_k2", "_carry")
    out = every.join(found, (F.col("_k1") == F.col("_m1")) & (F.col("_k2") == F.col("_m2")), "left")
    none = F.array().cast("array<string>")
    return out.select("_carry.*", F.coalesce("families", none).alias("families"), F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), "probability")
