"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines with words, joined; comment marks are signs, which only part words. Its sentences are cut into
overlapping windows of 8 to 64 words, and every window is classified: multinomial logistic regression over words and pairs of
following words, with all words outside the training notices counted as one. The classes are the families, licences outside
them (``unknown``) and plain text, which negated notices and mere talk about a licence belong to. A temperature fitted on
examples kept apart calibrates the probabilities; a class's bound is what the best window of a plain paragraph hardly ever
reaches. The words that speak for the class are then judged once more with their neighbours in the sentence, so that a
negation just before a window counts; one word alone is never a notice. Last, the find is compared with the family's names and passages: ``similarity`` is the
share of the nearest one's word pairs, and ``confirmed`` says whether that is enough. Finds that nothing confirms stay in the
result, as do those of the unknown class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import arrow_map, lowest, texts_of

# The usual notices of well-known licences, by family; digits stand for any version.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain."],
}
# The families' names, and passages that only their notices have.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPL 3.0", "the AGPLv3", "Affero GPL"],
    "apache": ["Apache License", "Apache 2.0", "Apache Software License", "Apache Public License"],
    "bsd": ["BSD License", "BSD 3-Clause", "BSD style license", "3-clause BSD", "Simplified BSD", "New BSD"],
    "cc-by": ["CC BY 4.0", "CC BY License", "Creative Commons Attribution 4.0", "Creative Commons Attribution License", "Creative Commons Attribution International"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC License", "Creative Commons Attribution-NonCommercial 4.0", "Commons Attribution-NonCommercial License", "Commons Attribution-NonCommercial International"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA License", "Creative Commons Attribution-ShareAlike 4.0", "Commons Attribution-ShareAlike License", "Commons Attribution-ShareAlike International"],
    "cc0": ["CC0 1.0", "CC0 License", "CC0 Public Domain Dedication", "Creative Commons Zero"],
    "epl": ["Eclipse Public License", "EPL 2.0"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPL 3.0", "GPL version 3", "the GPLv3"],
    "isc": ["ISC License"],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL 2.1", "LGPL version 3", "the LGPLv3"],
    "mit": ["MIT License", "Expat License", "MIT X11"],
    "mpl": ["Mozilla Public License", "MPL 2.0"],
    "unlicense": ["the Unlicense"],
}
PASSAGES = {
    "bsd": ["Redistribution and use in source and binary forms", "SPDX-License-Identifier: BSD"],
    "cc0": ["waived all copyright and related or neighboring rights"],
    "isc": ["copy, modify, and/or distribute this software for any purpose with or without fee", "SPDX-License-Identifier: ISC"],
    "mit": ["free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "unlicense": ["free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
}
# What training sentences are made of. {} is a licence's name, * a word of no notice.
SHORT = {
    "agpl": ["AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only"],
    "apache": ["Apache-2.0", "Apache 2.0", "Apache 2", "ASL 2.0"],
    "bsd": ["BSD", "BSD-3-Clause", "BSD 2-Clause", "3-clause BSD"],
    "cc-by": ["CC-BY", "CC BY", "CC-BY-4.0"],
    "cc-by-nc": ["CC-BY-NC", "CC BY-NC", "CC-BY-NC-4.0"],
    "cc-by-sa": ["CC-BY-SA", "CC BY-SA", "CC-BY-SA-4.0"],
    "cc0": ["CC0", "CC0-1.0"],
    "epl": ["EPL", "EPL-2.0", "EPLv2"],
    "gpl": ["GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0-or-later", "GNU GPL v3"],
    "isc": ["ISC"],
    "lgpl": ["LGPL", "LGPLv3", "LGPL-2.1", "LGPL-2.1-or-later"],
    "mit": ["MIT", "MIT/X11"],
    "mpl": ["MPL", "MPL-2.0", "MPLv2"],
    "unlicense": ["Unlicense"],
}
OTHERS = ["Creative Commons Attribution-NoDerivatives 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC BY-NC-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-ND", "CC BY-NC-SA License", "GNU Free Documentation License", "Academic Free License", "* License", "* * License", "* Public License", "* * Public License", "* Software License", "* Open Source License", "* License 1.0", "* Public License, version 2.0", "* * Software License, Version 1.0", "* General License", "* to Public License"]
GRANTS = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Distributed under the {}, see the file LICENSE.", "Distributed under the terms of the {}; see *", "This work is licensed under a {}.", "This work is licensed under the {}, version 3.", "This program is licensed under the {}.", "Available under the {}", "Made available under the {} 2.0", "This software is made available under the terms of the {}.", "Use of this source code is governed by a {} that can be found in the LICENSE file.", "This project is published under {}", "This text is released under the terms of the {}", "You may use it subject to the terms of the {}", "You can redistribute it under the {}, version 2 or later", "It may be used, copied and modified under the terms of the {}.", "This project is covered by the {}.", "SPDX-License-Identifier: {}", "License: {}", "Licensed under the {} by its author", "Released under the {} and copyright by *", "This * is free software under the {}.", "Code and documentation released under the {}", "The * is * under the {}", "* are * under the {}.", "* * * under the {}"]
HEADINGS = ["{}", "The {}", "{} Version 2.0", "{}, version 3", "{} Version 2.0, January 2004", "{} Version 3, 29 June 2007", "{} Copyright (c) 2020 *", "The {} Copyright (c) 2020 * *", "Copyright (c) 2020 * * {}"]
SHORT_GRANTS = ["This project is {} licensed.", "{} licensed", "License {}", "This code is under the {} license", "Licensed under the {} license", "dual licensed under {}", "The {} license", "{} license"]
NEGATED = ["Not available under the {}", "Nothing of this is * under the {}", "It is not free under the {} * *", "* not * * under the {} 2.0.", "No longer * under the {}", "We no longer * this under the {}", "They do not * this under the {}", "It was never * under the {}", "Not * under the {}", "The * is not * under the {}.", "They are not * under {}", "Not released under the {}", "Not licensed under the {}.", "This work is not licensed under the {}.", "This is not under the {}", "No longer distributed under the {}", "It is no longer available under the terms of the {}", "It was never released under the {}.", "Not covered by the {}", "This file cannot be used under the {}", "This program isn't licensed under the {}", "It has not been published under {}", "Neither licensed under {} nor under *", "* is not distributed under the {}; *"]
MENTIONS = ["The {} is short.", "The {} is *.", "The {} was * by *.", "He read the {} on the *.", "She read a * about the {}.", "He read a * published under the {} * of the *", "They * the {} with *", "The * of the {} * the *", "A talk about the {}", "The history of the {} is long.", "* * the {} * * *", "* of {} * *", "What does the {} say about *?", "We compared the {} and others.", "Why did they choose the {}?", "* {} * *", "Some people prefer the {}.", "The article explains the {}."]
PLAIN = ["* * * * a * license", "* * * * * license", "* and a * license * *", "* * * the * license", "* * * * * public license", "license", "licensed", "the license", "mit", "apache", "public license *", "bsd", "gnu", "cc", "a license under the *", "all rights reserved by *", "licensed * under the *", "* * license to the *", "permission of the * to use the *", "under the terms of the *", "the * * under the *", "released under *", "released * * under the *", "the apache * * over the *", "general public", "creative * in the commons", "a copy of this *", "the public * * license", "driver license", "* was licensed to *", "version 2.0 of the *", "published under the * of *", "the mit * *", "* apache * *", "copyright (c) 2020 *", "see the file *", "under the of the terms", "published by the * foundation", "use of this * is *", "sent under the * name"]
UNKNOWN, NONE = "unknown", "none"
LENGTHS, AROUND = (8, 16, 32, 64), 8  # words in a window; words at either side that a find is judged with
END = b"\1"  # the end of a sentence
BLOCK = 1 << 16  # words whose prefix sums are held at a time
PASSAGE = 300  # most words of a sampled passage
_COMMENTS = {b"c", b"dnl", b"rem"}  # comment marks that are words
_KEEP = bytes(b if b == 10 or 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 46 if b in b".!?" else 32 for b in range(256))
_UNDOT = bytes(32 if b == 46 else b for b in range(256))


def lines_of(text: bytes) -> list[list[bytes]]:
    """Words and sentence ends of each line of a lower-cased text; signs part words, a digit is 0, a licence a license."""
    marked = (text.replace(b"licence", b"license") + b"\n").translate(_KEEP).replace(b". ", b" \1 ").replace(b".\n", b" \1\n")
    lines = [line.split() for line in marked.translate(_UNDOT)[:-1].split(b"\n")]
    return [line if line and line[0] != END else [w for k, w in enumerate(line) if w != END or any(v != END for v in line[:k])] for line in lines]


def words_of(line: bytes) -> list[bytes]:
    return [w for words in lines_of(line) for w in words]


def paragraphs(text: str) -> Iterator[tuple[list[bytes], list[int]]]:
    """The words of every run of lines that have words, and the line of each word."""
    held: list[tuple[int, list[bytes]]] = []
    for k, words in enumerate([*lines_of(text.lower().encode(errors="replace")), []]):
        if words:
            held.append((k, words))
        elif held:
            if held[0][1][0] in _COMMENTS and len({words[0] for _, words in held}) == 1:
                held = [(k, words[1:]) for k, words in held]
            yield [w for _, words in held for w in words], [k for k, words in held for _ in words]
            held = []


def windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and past the last word of the windows of sentences [starts, ends): a quarter of a length apart.

    A sentence of at most the greatest length is a window too, so no word is in none.
    """
    sizes = ends - starts
    whole = sizes <= LENGTHS[-1]
    firsts, lasts = [starts[whole]], [ends[whole]]
    for length in LENGTHS:
        longer = np.flatnonzero(sizes > length)
        step = length // 4
        count = -(-(sizes[longer] - length) // step) + 1
        owner = np.repeat(longer, count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        first = starts[owner] + np.minimum(number * step, sizes[owner] - length)
        firsts.append(first)
        lasts.append(first + length)
    return np.concatenate(firsts), np.concatenate(lasts)


def pairs(words: list) -> set[tuple]:
    return set(zip(words, words[1:]))


@dataclass
class Scanner:
    families: list[str]  # the last is UNKNOWN; the class of plain text comes behind it in every array
    vocabulary: dict[bytes, int]  # words of the training sentences, from 1; 0 is any other word
    row: np.ndarray  # word, or pair behind the words, to its row of weights; 0: never seen in training
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bounds: np.ndarray  # least probability, by class
    cores: list[list[set[tuple[int, int]]]]  # by class: word pairs of its names and passages
    least_similarity: float

    def rows_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words, rows of the words, rows of the pairs of following words; a word said again at once counts once."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))
        size = len(self.vocabulary) + 1
        again = ids[1:] == ids[:-1]
        single, double = ids.copy(), size + ids[:-1] * size + ids[1:]
        single[1:][again] = 0
        double[again] = 0
        return ids, self.row[single], self.row[double]

    def probabilities(self, single: np.ndarray, double: np.ndarray) -> np.ndarray:
        """Of one window: weights of its features, scaled by the root of their number."""
        z = self.weights[single].sum(axis=0) + self.weights[double].sum(axis=0)
        z = (z / np.sqrt(max(len(single) + len(double), 1)) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def candidates(self, single: np.ndarray, double: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, past the last word, probabilities) of all windows that plain text does not win.

        Prefix sums of weights, over BLOCK words at a time, make a window cost the same at every length.
        """
        first, last = windows(starts, ends)
        for low in range(0, len(single), BLOCK):
            here = np.flatnonzero((first >= low) & (first < low + BLOCK)) if len(single) > BLOCK else slice(None)
            a, b = first[here] - low, last[here] - low
            if not len(a):
                continue
            high = low + int(b.max())
            total = np.zeros((high - low + 1, len(self.bias)))
            np.cumsum(self.weights[single[low:high]], axis=0, out=total[1:])
            linked = np.zeros((high - low + 1, len(self.bias)))  # at k: pairs of which word k is the second, or earlier
            np.cumsum(self.weights[double[low : high - 1]], axis=0, out=linked[1 : high - low])
            z = total[b] - total[a] + linked[b - 1] - linked[a]
            z = (z / np.sqrt(2.0 * (b - a) - 1)[:, None] + self.bias) / self.temperature
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            for k in np.flatnonzero(p[:, -1] <= 0.5).tolist():
                yield low + int(a[k]), low + int(b[k]), p[k]

    def verdict(self, p: np.ndarray) -> tuple[int, float] | None:
        """The class of a window and its probability, or None for plain text."""
        best = int(p[:-2].argmax())
        if p[best] >= self.bounds[best]:
            return best, float(p[best])
        if 1 - p[-1] >= self.bounds[-2]:
            return len(self.families) - 1, float(1 - p[-1])
        return None

    def finds(self, words: list[bytes]) -> list[tuple[int, int, float, float]]:
        """(first word, class, probability, similarity) of a paragraph's notices, one for each sentence and class."""
        ids, single, double = self.rows_of(words)
        cuts = np.flatnonzero(ids == self.vocabulary[END]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ids)]])
        starts, ends = starts[starts < ends], ends[starts < ends]
        found = []
        for a, b, p in self.candidates(single, double, starts, ends):
            named = self.verdict(p)
            if named is None:
                continue
            family, p_best = named
            a, b = self.speaking(single, double, a, b, family)
            k = int(np.searchsorted(starts, a, side="right")) - 1
            low, high = max(int(starts[k]), a - AROUND), min(int(ends[k]), b + AROUND)
            known = ids[a:b][(ids[a:b] > 0) & (ids[a:b] != self.vocabulary[END])]
            if len(known) and b - a - (ids[b - 1] == self.vocabulary[END]) > 1 and self.probabilities(single[low:high], double[low : high - 1])[-1] < 0.5:
                found.append((family == len(self.families) - 1, -p_best, a, b, family, k, low, high))
        taken: list[tuple[int, int]] = []
        out: dict[tuple[int, int], tuple[int, int, float, float]] = {}
        for unknown, p, a, b, family, k, low, high in sorted(found):
            room = AROUND if unknown else 0  # a piece of a named notice is no unknown one
            if any(a < end + room and start - room < b for start, end in taken):
                continue
            taken.append((a, b))
            held = pairs(ids[low:high].tolist())
            near = max((len(core & held) / len(core) for core in self.cores[family]), default=0.0)
            old = out.get((k, family), (a, family, -p, near))
            out[k, family] = (min(a, old[0]), family, max(-p, old[2]), max(near, old[3]))
        return sorted(out.values())

    def speaking(self, single: np.ndarray, double: np.ndarray, a: int, b: int, family: int) -> tuple[int, int]:
        """The stretch of a window whose words and pairs speak most for the class against plain text."""
        gain = self.weights[:, family] - self.weights[:, -1]
        each = gain[single[a:b]]
        each[1:] += gain[double[a : b - 1]]
        best, span, run, start = -np.inf, (a, b), 0.0, 0
        for k, value in enumerate(each.tolist()):
            if run <= 0:
                run, start = 0.0, k
            run += value
            if run > best:
                best, span = run, (a + start, a + k + 1)
        return span

    def scan(self, text: str | None) -> list[tuple[int, str, float, float, bool]]:
        """(line from 0, family, probability, similarity, confirmed) of every notice; the line is where it begins.

        A family is named once for a line.
        """
        named: dict[tuple[int, int], tuple[float, float]] = {}
        for words, line in paragraphs(text or ""):
            for at, family, p, near in self.finds(words):
                place = line[at], family
                named[place] = max(named.get(place, (0.0, 0.0)), (p, near))
        return [(k, self.families[f], p, near, near >= self.least_similarity) for (k, f), (p, near) in sorted(named.items())]


def examples(unknown: list[list[bytes]], random: np.random.Generator, count: int) -> Iterator[tuple[list[bytes], str]]:
    """Training sentences and their classes."""
    words = [w for line in unknown[:500] for w in line if w != END] or [b"*"]

    def filled(sentence: str, name: str = "") -> list[bytes]:
        return words_of(sentence.format(name).lower().replace("*", "zq").encode())

    def some(least: int, most: int) -> list[bytes]:
        if random.random() < 0.5:
            return [b"zq"] * int(random.integers(least, most))
        return [words[i] for i in random.integers(0, len(words), random.integers(least, most))]

    def varied(sentence: list[bytes], times: int) -> Iterator[list[bytes]]:
        """The sentence, with words lost, behind other words, and before others where it ends or is long."""
        for k in range(times):
            kept = [w for w in sentence if k == 0 or len(sentence) < 7 or random.random() > 0.06]
            if k % 3 == 2:
                kept = some(0, 14) + kept
                if len(sentence) > 12:
                    kept = kept + some(0, 14)
            yield kept

    for family in TEMPLATES:
        longer = TEMPLATES[family] + PASSAGES.get(family, [])
        for text in longer:
            yield from ((v, family) for v in varied(filled(text.replace("{", "").replace("}", "")), count))
        full = [*NAMES[family], *(f"{name} ({short})" for name in NAMES[family][:2] for short in SHORT[family][:2])]
        for name in full:
            for sentence in GRANTS + HEADINGS:
                yield from ((v, family) for v in varied(filled(sentence, name), 3 if sentence in GRANTS else 1))
        for name in SHORT[family]:
            for sentence in SHORT_GRANTS + GRANTS:
                yield from ((v, family) for v in varied(filled(sentence, name), 2))
    for name in OTHERS:
        for sentence in GRANTS:
            yield from ((v, UNKNOWN) for v in varied(filled(sentence, name), 3))
        for sentence in HEADINGS:
            yield from ((filled(sentence, name), UNKNOWN) for _ in range(6))
    every = [name for family in TEMPLATES for name in NAMES[family] + SHORT[family]] + OTHERS
    for name in every:
        for sentence in NEGATED:
            yield from ((v, NONE) for v in varied(filled(sentence, name), 2))
        for sentence in MENTIONS:
            yield filled(sentence, name), NONE
    for sentence in PLAIN:
        yield from ((v, NONE) for v in varied(filled(sentence), 12))
    pool = sorted({w for group in TEMPLATES.values() for text in group for w in filled(text)})
    for _ in range(500):
        yield [pool[i] for i in random.integers(0, len(pool), random.integers(1, 20))], NONE
    nameless = [filled(sentence) for sentence in GRANTS]
    for sentence in nameless:
        yield from ((v, NONE) for v in varied(sentence, 6))
    for _ in range(500):
        yield [w for i in random.integers(0, len(nameless), 3) for w in nameless[i][random.integers(0, len(nameless[i])) :][: random.integers(1, 6)]], NONE
    for word in [*pool, *(w for name in every for w in filled("{}", name)), *[b"zq"] * 100]:
        yield [word], NONE
        yield [word] * int(random.integers(2, 64)), NONE  # texts that say one word again and again
        yield [word, *some(1, 4)] * int(random.integers(2, 16)), NONE
    for _ in range(500):
        yield some(1, 40), NONE


def pieces(words: list[bytes], random: np.random.Generator) -> Iterator[list[bytes]]:
    """A line of plain text cut into sentences, and these into stretches as short or long as windows are."""
    first = 0
    for end in [k + 1 for k, w in enumerate(words) if w == END] + [len(words)]:
        while first < end:
            size = int(random.integers(1, LENGTHS[-1]) if random.random() < 0.5 else LENGTHS[0])
            yield words[first : min(end, first + size)]
            first += size
        first = end


def descend(parts: list[np.ndarray], labels: np.ndarray, size: int, classes: int, rounds: int, rate: float, ridge: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of multinomial logistic regression over sparse rows, by adaptive steps on an eighth of them each.

    The bias is fixed: a text without a feature is of the last class, plain text.
    """
    share = 1 / np.sqrt(np.bincount(labels, minlength=classes).clip(1))
    share = share / share[labels].mean()
    batches = []
    for chosen in np.array_split(random.permutation(len(parts)), 8):
        feature = np.concatenate([parts[k] for k in chosen])
        lengths = np.array([len(parts[k]) for k in chosen])
        at = np.repeat(np.arange(len(chosen)), lengths)
        order = np.argsort(feature, kind="stable")
        touched, firsts = np.unique(feature[order], return_index=True)
        scale = (1 / np.sqrt(lengths)).astype(np.float32)[:, None]
        cost = (share[labels[chosen]] / len(chosen)).astype(np.float32)[:, None]
        batches.append((feature, np.cumsum(lengths) - lengths, at[order], touched, firsts, scale, cost, np.eye(classes, dtype=np.float32)[labels[chosen]]))
    weights, bias = np.zeros((size, classes), np.float32), np.zeros(classes, np.float32)
    bias[-1] = 4.0
    one, two = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        feature, first, at, touched, firsts, scale, cost, target = batches[step % len(batches)]
        z = np.add.reduceat(weights[feature], first) * scale + bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        error = (e / e.sum(axis=1, keepdims=True) - target) * cost
        slope = ridge * weights
        slope[touched] += np.add.reduceat((error * scale)[at], firsts)
        pace = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        one += 0.1 * (slope - one)
        two += 0.01 * (slope * slope - two)
        weights -= pace * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
        weights[0] = 0.0
    return weights.astype(np.float64), bias.astype(np.float64)


def learn(unknown: list[list[bytes]], count: int = 30, rounds: int = 480, rate: float = 0.1, ridge: float = 1e-5, least_similarity: float = 0.8, seed: int = 7) -> Scanner:
    """Train on made sentences and on ``unknown`` lines as plain text, by full-batch adaptive steps on sparse rows.

    Lines that hold a family's name or passage are no examples of plain text.
    """
    random = np.random.default_rng(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    classes = [*families, NONE]
    made = list(examples(unknown, random, count))
    known = sorted({w for text in [*(t for part in (TEMPLATES, NAMES, PASSAGES, SHORT) for group in part.values() for t in group), *OTHERS, *GRANTS, *HEADINGS, *SHORT_GRANTS, *NEGATED, *MENTIONS, *PLAIN] for w in words_of(text.lower().replace("*", "").encode())} | {END})
    vocabulary = {w: k for k, w in enumerate(known, 1)}
    size = len(vocabulary) + 1
    cores = [[pairs([vocabulary[w] for w in words_of(t.lower().encode()) if w != END]) for t in NAMES.get(f, []) + PASSAGES.get(f, [])] for f in families]
    cores = [[core for core in group if core] for group in cores]
    named = [pairs(words_of(t.lower().encode())) for part in (NAMES, PASSAGES) for group in part.values() for t in group]
    unknown = [w for w in unknown if w and not any(t <= pairs(w) for t in named if t)]
    cut = [sentence for w in unknown for sentence in pieces(w, random)]
    data = made + [(w, NONE) for w in cut]
    scanner = Scanner(families, vocabulary, np.arange(size + size * size), np.zeros((1, len(classes))), np.zeros(len(classes)), 1.0, np.full(len(classes), 0.5), cores, least_similarity)
    parts = [np.concatenate(scanner.rows_of(w)[1:]) for w, _ in data]
    labels = np.array([classes.index(f) for _, f in data])
    held = np.arange(len(data)) % 5 == 0
    # Words of no notice have no weight by themselves, only next to words that have.
    own = np.setdiff1d(np.concatenate([p for p, h in zip(parts, held) if not h]), [0, size])
    scanner.row = np.zeros(size + size * size, dtype=np.int32)
    scanner.row[own] = np.arange(1, len(own) + 1)
    parts = [scanner.row[p] for p in parts]
    weights, bias = descend([parts[k] for k in np.flatnonzero(~held)], labels[~held], len(own) + 1, len(classes), rounds, rate, ridge, random)
    scanner.weights, scanner.bias = weights, bias
    tests = np.flatnonzero(held)
    truth = labels[tests]

    def windowed(k: int) -> np.ndarray:
        n = len(data[k][0])
        return scanner.probabilities(parts[k][:n], parts[k][n:])

    def loss(temperature: float) -> float:
        scanner.temperature = temperature
        return float(-np.log(np.maximum([windowed(k)[t] for k, t in zip(tests, truth)], 1e-12)).mean())

    scanner.temperature = min((0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    # The bound of a class: what finds in at most one in two hundred plain sentences kept apart reach, and at least a half.
    best = np.zeros((int((truth == len(families)).sum()), len(classes)))
    for row, k in enumerate(tests[truth == len(families)]):
        for _, family, p, _ in scanner.finds(data[k][0]):
            best[row, family] = max(best[row, family], p)
    scanner.bounds = np.clip(np.quantile(best, 0.995, axis=0), 0.5, 0.95)
    return scanner


def fit(documents: DataFrame, rows: int = 1_000, **options) -> Scanner:
    """Train with passages of at most ``rows`` distinct texts as unknown paragraphs.

    Texts with a word are chosen by a hash of the text. Of all their lines, cut into passages of at most PASSAGE words, the
    ``5 * rows`` with the lowest hash of text and number are taken, wherever in the text they stand.
    """
    text = F.col("text").cast("string")
    texts = documents.select(F.xxhash64(text).alias("code"), text.alias("text")).where(F.col("text").rlike(r"[A-Za-z0-9]|[^\x00-\x7F]"))
    chosen = lowest(texts.select("code").distinct(), "code", rows)
    most = 5 * rows

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), []
        for batch in batches:
            codes = batch.column(0).to_pylist()
            for first, _, part in texts_of(batch, 1):
                for code, text in zip(codes[first:], part):
                    if code in seen:
                        continue
                    seen.add(code)
                    lines = lines_of(text.lower().encode(errors="replace"))
                    cut = (w[k : k + PASSAGE] for w in lines for k in range(0, len(w), PASSAGE))
                    held += [(crc32(b"%d" % number, code & 0xFFFFFFFF), code, number, b" ".join(w)) for number, w in enumerate(cut)]
                    if len(held) > 4 * most:
                        held = nsmallest(most, held)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*nsmallest(most, held)), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["draw", "code", "number", "words"])

    drawn = arrow_map(texts.join(F.broadcast(chosen), "code").select("code", "text"), draw, "draw long, code long, number long, words binary")
    found = drawn.dropDuplicates(["draw", "code", "number"]).orderBy("draw", "code", "number").limit(most).collect()
    return learn([bytes(r["words"]).split() for r in found], **options)


def scan(documents: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, paragraph (line from 0), family, probability, similarity, confirmed: one row per licence notice.

    ``family`` is "unknown" for a notice of a licence outside the families; no template confirms it. Null and empty texts have
    no paragraph. Repeated rows and null ids are scanned each for itself; other columns are not looked at.
    """
    schema = documents.select("doc_id").schema
    for name, kind in (("paragraph", "long"), ("family", "string"), ("probability", "double"), ("similarity", "double"), ("confirmed", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, texts in texts_of(batch, 1):
                rows = [(k, *found) for k, text in enumerate(texts, first) for found in scanner.scan(text)]
                if rows:
                    at, *columns = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, columns)], names=schema.names)

    return arrow_map(documents.select("doc_id", F.col("text").cast("string").alias("_text")), run, schema)
