import random
import re

import pytest

pytest.importorskip("quern.llm")

from quern.llm import licenses

SCHEMA = "doc_id long, text string, license string"


def test_finds_wordings(spark):
    filler = "ouwhea the of rend and threlyes nd of " * 80
    texts = {
        1: f"{filler}\nReleased under the MIT License.\n{filler}",
        2: "Licensed under CC BY-NC 4.0.",
        3: "licensed   under\nCC BY 4.0",
        4: f"x Licensed under the Apache License,\nVersion 2.0. y {filler} This work is licensed under the GNU General Public License, version 3.",
        5: "Permission is hereby granted, free of charge, to ANY person obtaining a copy of this program and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        6: "We talked about a license to drive and the permission of the owner of the car.",
        7: filler,
        8: None,
        9: "",
        10: "Released under the MIT License. Released under the MIT License.",
        11: "É İ Released under the MIT License.",
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA)
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.differences, r.exact))
        assert licenses.wording(texts[r.doc_id][r.place :])[: r.n_words]
    assert got[1] == [("MIT", 0, True)] and got[2] == [("CC-BY-NC-4.0", 0, True)] and got[3] == [("CC-BY-4.0", 0, True)]
    assert got[4] == [("Apache-2.0", 0, True), ("GPL-3.0", 0, True)]
    assert got[5] == [("MIT", 1, False)]
    assert got[10] == [("MIT", 0, True)] * 2 and got[11] == [("MIT", 0, True)]
    assert set(got) == {1, 2, 3, 4, 5, 10, 11}
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_planted_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = sorted((r.doc_id, name, r.text.count(line)) for r in docs.collect() for line, name in lines.items() if line in r.text)
    got = {}
    for r in licenses.scan(docs).collect():
        got[r.doc_id, r.license] = got.get((r.doc_id, r.license), 0) + 1
    assert sorted((i, n, k) for (i, n), k in got.items()) == want and want


def test_every_template_is_found():
    for name, text in licenses.TEMPLATES:
        assert licenses.anchor().search(text)
        (found,) = licenses.found_in(f"some words before it . {text} and some after", 0.1)
        assert found[0] == name and found[3] == 0


def test_large_blocks_lose_nothing():
    text = ""
    for i in range(100):  # an anchor within reach of the next throughout, so that all is one block
        text += "Released under the MIT License. " + " ".join(f"{w}{(i * 7 + j) % 89}" for j, w in enumerate("the of rend and threlyes nd ouwhea of".split() * 10)) + "\n"
        found = licenses.found_in(text, 0.1) if i in (2, 19, 59, 99) else None
        assert found is None or ([r[0] for r in found] == ["MIT"] * (i + 1) and all(r[3] == 0 and r[4] > 0 for r in found))
        assert found is None or [r[1] for r in found] == [m.start() for m in re.finditer("Released", text)]


def test_windows_hold_each_range():
    for n in range(1, 60):
        made = licenses.windows(5, 5 + n, 9, 4)
        assert made[0][0] == 5 and made[-1][1] == 5 + n and all(b - a <= 9 for a, b in made)
        assert all(any(a <= i and i + k <= b for a, b in made) for k in range(1, 5) for i in range(5, 6 + n - k))


def test_short_notices_beside_altered_long_ones():
    long = " ".join(" ".join("zzq" if i % 6 == 3 else w for i, w in enumerate(text.split())) for _, text in licenses.TEMPLATES if len(text.split()) > 14)
    for name, text in licenses.TEMPLATES:
        found = licenses.found_in(f"{long} {text}", 0.1)
        assert [(r[0], r[3]) for r in found] == [(name, 0)], (name, found)


def test_differences_equal_the_plain_table():
    rng = random.Random(5)
    for _ in range(3000):
        template, block = ([rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(low, 9))] for low in (1, 0))
        row = [(0, j) for j in range(len(block) + 1)]
        for i, w in enumerate(template, 1):
            new = [(i, 0)]
            for j, b in enumerate(block, 1):
                new.append(min((row[j - 1][0] + (w != b), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
            row = new
        end = min(range(len(row)), key=lambda j: (row[j][0], j))
        want = (row[end][0], row[end][1], end)
        got = licenses.differences(template, block)
        assert got == want, (template, block)
        assert licenses.differences(template, block, want[0]) == want and licenses.differences(template, block, want[0] - 1) is None


def test_any_words_within_the_differences_may_change():
    for name, text in licenses.TEMPLATES:
        words = [w for w, _ in licenses.wording(text)]
        anchors = [i for i, w in enumerate(words) if licenses.anchor().search(w)]
        most = int(0.1 * len(words))
        assert len(anchors) > most, name
        changed = " ".join("zzq" if i in anchors[:most] else w for i, w in enumerate(words))
        assert [r[3] for r in licenses.found_in(changed, 0.1)] == [most], name


def test_further_notices():
    for text, name in (
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "EPL-2.0"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ):
        assert [(r[0], r[3]) for r in licenses.found_in(f"a b c {text} d e", 0.1)] == [(name, 0)]
