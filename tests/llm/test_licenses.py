import random
import re

import numpy as np
import pytest

from pagewright.llm import licenses as L

NOTICES = [
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Released under the MIT License.", "MIT"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("(c) Somebody. Licensed under the Apache License, Version 2.0", "Apache-2.0"),
    ("This library is released under the MIT license, see LICENSE.", "MIT"),
    ("The text is licensed under a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    ("This code is licensed under the 3-clause BSD license.", "BSD-3-Clause"),
]
CONFUSABLE = [
    ("The wiki is licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Photos are licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"),
    ("It is distributed under the GNU General Public License, version 2", "GPL-2.0"),
    ("It is licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    ("It is licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("It is licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"),
    ("Released under the GPL.", "GPL"),
    ("The code is released under the ISC License", "ISC"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "BSL-1.0"),
    ("Mozilla Public License Version 2.0", "MPL-2.0"),
    ("Licensed under the 2-clause BSD license", "BSD-2-Clause"),
]
OTHERS = [
    "The board renewed the license of the radio station.", "Mit und ohne.", "General terms apply to the public.", "hello", "", "Version 2.0", "He met an Apache.",
    "She graduated from MIT and has a driver's license.", "Licensed under CC BY 3.0.", "Licensed under the Apache License, Version 1.1.", "SPDX-License-Identifier: CC-BY-SA-3.0",
]


def units(text):
    """Paragraph by paragraph, its lines and runs of lines."""
    for body in re.split(r"\r?\n[ \t\r]*\n", text or ""):
        lines = body.split("\n")
        yield [" ".join(lines[i : i + k]) for k in range(1, L.LINES + 1) for i in range(len(lines) - k + 1)]


def plain(text):
    """The same scan, one unit after the other."""
    model, found = L.fit(), []
    for paragraph in units(text):
        hits = []
        for unit in paragraph:
            words = L.words_of(unit)
            if not re.search(r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, L.TRIGGERS)) + r")(?![a-z0-9])", unit):
                continue
            own = L.grams_of(words)
            z = np.array(model["bias"]) + sum((np.array(model["weights"].get(g, 0.0)) for g in sorted(own)), np.zeros(len(model["classes"])))
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            family, odds = model["classes"][int(p.argmax())], float(p.max())
            decides = set(words) & set(L.DECIDING)
            if family != L.UNKNOWN and odds >= L.LEAST and any(len(own & set(g)) >= L.AGREE * len(g) and decides == set(d) for y, g, d in L.templates() if y == family):
                hits.append((family, odds))
        if hits:
            families = {f for f, _ in hits}
            found.append(({f for f in families if not families & set(L.GENERAL.get(f, []))}, max(q for _, q in hits)))
    return sorted(set().union(*(f for f, _ in found))), len(found), min((q for _, q in found), default=None)


def test_held_out_notices():
    assert [plain(t)[0] for t, _ in NOTICES + CONFUSABLE] == [[y] for _, y in NOTICES + CONFUSABLE]
    assert [(t, plain(t)) for t in OTHERS if plain(t)[1]] == []


def test_every_template_is_found():
    rows = [(t, y, plain(t)[0]) for t, y in L.rows()]
    assert [r for r in rows if r[2] != ([] if r[1] == L.UNKNOWN else [r[1]])] == []


def test_against_plain_scan(spark):
    r = random.Random(6)
    lines = [t for t, _ in NOTICES + CONFUSABLE] + OTHERS + ["ordinary words " * 400, "SPDX-License-Identifier: MIT", "mit MIT Mit license"]
    gap = lambda: r.choice(["\n", "\n", "\n\n", "\n \t\n", "\r\n\r\n"])
    rows = [(i, "".join(r.choice(lines) + gap() for _ in range(r.randrange(1, 7)))) for i in range(120)]
    rows += [(200, None), (201, ""), (5, rows[5][1]), (None, NOTICES[0][0]), (202, "word " * 200_000 + NOTICES[1][0] + "\n" + "x\n" * 20_000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, families string").repartition(4)
    got = sorted(((x["doc_id"], x["families"], x["n_licensed"], x["probability"]) for x in L.scan(df).collect()), key=lambda x: str(x[:3]))
    want = sorted(((k, *plain(t)) for k, t in rows), key=lambda x: str(x[:3]))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-9)
    assert L.scan(df.limit(0)).collect() == []


def test_wrapped_notices():
    """A notice that is wrapped over lines is found, across a blank line it is not."""
    assert plain("Foo is licensed under the GNU Lesser General\nPublic License, version 2.1")[0] == ["LGPL-2.1"]
    assert plain("Foo is licensed under the\nGNU General Public\nLicense, version 2")[0] == ["GPL-2.0"]
    assert plain("Creative Commons Attribution-ShareAlike\n4.0 International License")[0] == ["CC-BY-SA-4.0"]
    assert plain("Foo is licensed under the GNU Affero General\n\nPublic License, version 3")[1] == 0


def test_equal_scores_go_to_the_first_family():
    model = L.fit()
    assert model["classes"][0] == L.UNKNOWN and model["classes"][1:] == [c for c in L.LABELLED if c != L.UNKNOWN]


def test_only_features_that_count_are_shuffled(spark):
    text = "The license of " + " ".join(f"ordinary{i}" for i in range(5_000)) + "\nReleased under the MIT License, version 9.9.\nmit freundlichen"
    rows = L.features(spark.createDataFrame([(1, text), (1, text), (2, "permission ordinary")], "doc_id long, text string")).collect()
    known = {*L.fit()["weights"], *L.DECIDING}
    assert rows and all(r["own"] and set(r["own"]) <= known for r in rows) and len({(r["_k1"], r["unit"]) for r in rows}) == len(rows)
    assert any(L.grams_of(L.words_of("Released under the MIT License")) & known <= set(r["own"]) for r in rows)
