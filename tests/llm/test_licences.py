import re

import numpy as np
import pytest

from duskwatch.llm import licences, queries
from duskwatch.llm.common import table

STRANGERS = [licences.words_of(t.lower().encode()) for t in ("The driver showed a licence to the officer.", "All rights reserved by the band.", "Version two of the plan was released under pressure.", "He has the permission of the owner to use the boat.") for _ in range(20)]


@pytest.fixture(scope="module")
def scanner():
    return licences.learn(STRANGERS)


def test_notices_and_strangers(scanner):
    for family, templates in licences.TEMPLATES.items():
        for text in templates:
            assert [(p, f) for p, f, *_ in scanner.scan(f"Some line.\n{text}\nMore.")] == [(1, family)], text
    assert scanner.scan("Licensed under the Apache License, Version 9.1 by its author")[0][1] == "apache"
    for text in (None, "", "\n\n", "The apache helicopter flew over the massachusetts institute.", "license", "A licence under the table", "under the terms of the of the under the"):
        assert scanner.scan(text) == []


def test_notice_in_long_line(scanner):
    for family, templates in licences.TEMPLATES.items():
        for text in templates:
            for words in (60, 20_000):
                half = "the driver of a boat showed us plans " * (words // 16)
                assert [f[:2] for f in scanner.scan(f"{half}{text} {half}")] == [(0, family)], (text, words)
    apart = f"Released under {'the driver of a boat ' * 50} the MIT {'plan and a boat ' * 50} License"
    assert scanner.scan(apart) == []


def test_wrapped_and_reworded_notices(scanner):
    wrapped = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nin the Software without restriction",
        "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
        "gpl": " * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or",
        "lgpl": "rem under the terms of the GNU Lesser\nrem General Public License as published by the\nrem Free Software Foundation",
        "apache": "// Licensed under the Apache\n// License, Version 2.0 (the License); you may not use this\n// file except in compliance with the License.",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted",
    }
    for family, text in wrapped.items():
        assert [f[1] for f in scanner.scan(f"A first line.\n\n{text}\n\nThe end.")] == [family], text
    reworded = {
        "Licensed under the MIT License": "mit",
        "This file is distributed under the terms of the MIT Licence; see LICENSE.txt": "mit",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "bsd",
        "Made available under the Mozilla Public License 2.0": "mpl",
        "SPDX-License-Identifier: Apache-2.0": "apache",
        "Permission is granted, free of charge, to any person obtaining a copy of this software and its associated documentation files": "mit",
        "This text is released under the terms of the Creative Commons Attribution-ShareAlike 3.0 license": "cc-by-sa",
        "You can redistribute it under the GNU GPL, version 2 or later": "gpl",
    }
    for text, family in reworded.items():
        assert [f[:2] for f in scanner.scan(text)] == [(0, family)], text
    assert [f[:2] for f in scanner.scan("Released under the MIT License\nor, at your choice, licensed under the Apache License, Version 2.0.")] == [(0, "mit"), (1, "apache")]
    for text in ("The MIT License is short.", "He read the GNU General Public License on the boat.", "MIT\n\nLicense", "licensed officers under the driver"):
        assert scanner.scan(text) == [], text


def test_headings_negation_and_unknown(scanner):
    found = {
        "MIT License": "mit", "The MIT License (MIT)": "mit", "License: MIT": "mit", "Licensed under MIT": "mit", "This project is MIT licensed": "mit",
        "Licensed under the GPL": "gpl", "Licensed under GPLv3": "gpl", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "gpl",
        "Apache License Version 2.0, January 2004": "apache", "ISC License": "isc", "The zlib License": "unknown",
        "Licensed under the Zlib License": "unknown", "Boost Software License - Version 1.0": "unknown", "Distributed under the Boost Software License, Version 1.0.": "unknown",
        "Licensed under CC BY-ND 4.0": "unknown", "This font is under the SIL Open Font License, Version 1.1": "unknown", "Artistic License 2.0": "unknown",
    }
    for text, family in found.items():
        for around in (text, f"Some line.\n{text}\n\nMore."):
            got = scanner.scan(around)
            assert [f[1] for f in got] == [family], (around, got)
            assert family != "unknown" or not got[0][4]
    for text in ("Not released under the MIT License", "The MIT License is short.", "He read a book published under the Apache License story of the west", "This library is not licensed under the GPL.", "We no longer ship this under the Apache License.", "She studies at MIT in Boston.", "A driver's license is required.", "the " * 100, "and " * 20, "rewh " * 70):
        assert scanner.scan(text) == [], text
    assert scanner.scan("Released under the MIT License.")[0][4] and not scanner.scan("Licensed under MIT")[0][4]


def test_held_out_wordings(scanner):
    """Sentences around a name that are in no list: at least nine of ten are found, at most one of sixteen negated ones is."""
    names = {"mit": "MIT License", "gpl": "GNU General Public License", "apache": "Apache License 2.0", "bsd": "BSD 3-Clause License", "mpl": "Mozilla Public License 2.0", "lgpl": "GNU Lesser General Public License", "cc-by": "Creative Commons Attribution 4.0 License", "isc": "ISC License"}
    wordings = ["This crate is licensed under the {} as of today", "You may redistribute the code under the {}", "All files here are subject to the {}", "Source is offered under the {}", "The tools come under the {}, without warranty", "We license our samples under the {}", "Unless stated otherwise, everything is under the {}."]
    rows = [(f, w.format(n)) for f, n in names.items() for w in wordings]
    right = [[z[1] for z in scanner.scan(text)] == [f] for f, text in rows]
    assert sum(right) >= 0.9 * len(rows), [t for (_, t), ok in zip(rows, right) if not ok]
    negated = ["These samples are not licensed under the {}", "Our code is not available under the {}."]
    wrong = [w.format(n) for n in names.values() for w in negated if scanner.scan(w.format(n))]
    assert len(wrong) <= 1, wrong


def test_windows_against_plain_scoring(scanner):
    """Prefix sums, in blocks or not, give what scoring each window by itself gives."""
    text = ("the driver of a boat. Released under the MIT License. " + "under the terms of the plan " * 30 + ". Licensed under GPLv3 ") * 3
    (words, _), = licences.paragraphs(text)
    ids, single, double = scanner.rows_of(words)
    cuts = [k + 1 for k, w in enumerate(words) if w == licences.END]
    starts, ends = np.array([0, *cuts]), np.array([*cuts, len(words)])
    first, last = licences.windows(starts, ends)
    assert set(range(len(words))) == {k for a, b in zip(first, last) for k in range(a, b)} and (last - first).max() <= 64
    want = {(a, b): p for a, b in zip(first.tolist(), last.tolist()) if (p := scanner.probabilities(single[a:b], double[a : b - 1]))[-1] <= 0.5}
    for block in (1 << 16, 50):
        licences.BLOCK, old = block, licences.BLOCK
        try:
            got = {(a, b): p for a, b, p in scanner.candidates(single, double, starts, ends)}
        finally:
            licences.BLOCK = old
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_edges(spark, edges, nothing):
    scanner = licences.fit(edges)
    assert licences.scan(edges, scanner).count() == 0 and licences.scan(nothing, scanner).count() == 0
    assert licences.fit(nothing).families[-1] == licences.UNKNOWN
    mit = spark.createDataFrame([(None, "x\nReleased under the MIT License."), (1, "Released under the MIT License.\n" * 3)], "doc_id long, text string")
    assert sorted(map(repr, (tuple(r)[:3] for r in licences.scan(mit.union(mit), scanner).collect()))) == sorted(map(repr, 2 * [(None, 1, "mit"), *((1, k, "mit") for k in range(3))]))


def test_unknown_sample(spark, monkeypatch):
    monkeypatch.setattr(licences, "learn", lambda lines, **options: lines)
    long = "\n".join(f"line{'x' * (k % 7)} {chr(97 + k % 26)} of the text" + " word" * 100 for k in range(200))
    texts = ["the same text", *["a copy of one text"] * 300, *[None] * 50, *[""] * 50, *["- * -"] * 50, "another text", "third text", long]
    sample = licences.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), rows=5)
    found = sorted(b" ".join(w) for w in sample)
    assert len(found) == 25 and found.count(b"a copy of one text") <= 1
    early = {b" ".join(licences.words_of(line.encode())) for line in long.split("\n")[:5]}
    assert len([f for f in found if f.endswith(b"word") and f not in early]) > 10
    short = licences.fit(spark.createDataFrame(list(enumerate(texts[:-1])), "doc_id long, text string"), rows=5)
    assert sorted(b" ".join(w) for w in short) == [b"a copy of one text", b"another text", b"the same text", b"third text"]


def test_op8_query(spark):
    folder = "/root/testdata/sf0.01"
    marks = {"gpl": "GNU General Public License", "cc-by-nc": "CC BY-NC", "mit": "MIT License", "apache": "Apache License"}
    want = {(r["doc_id"], k, f) for r in table(spark, folder, "documents").collect() for k, line in enumerate((r["text"] or "").split("\n")) for f, m in marks.items() if re.search(m, line, re.I)}
    got = {tuple(r)[:3] for r in queries.op8_licences(spark, folder).collect()}
    assert want and got == want
