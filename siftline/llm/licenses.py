"""License scans: a paragraph classifier in native columns, confirmed by comparison with templates.

A softmax regression over word n-grams knows the licence families, licences of
no known family ("unknown") and text that is no licence.  It is trained on
customary notices; a temperature fitted on other wordings, licence names and
paragraphs, none of which are trained on, calibrates it.  Its weights are sparse
and few, so they are literals of the plan; there is no shuffle and no Python on
executors.  Predictions are confirmed by the share of a template's n-grams that a
notice holds.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Customary wordings of licence notices, by family.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache 2.0 license.",
        "Apache License Version 2.0, January 2004",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; see the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under GPL v3 or later.",
        "GNU GENERAL PUBLIC LICENSE Version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the LGPL v3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under AGPL v3 or later.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Use of this source code is governed by a BSD style license.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "SPDX-License-Identifier: ISC",
    ],
    "CC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Content licensed under CC BY-SA 3.0.",
        "Released into the public domain under CC0 1.0.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "Released under MPL 2.0.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
        "Licensed under the Eclipse Public License 2.0.",
        "Released under EPL 2.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without written permission.",
        "This document is confidential and proprietary; unauthorized copying is prohibited.",
    ],
}
# Other wordings of the same families, for calibration alone.
HELD_NOTICES = {
    "Apache-2.0": ["Distributed under the terms of the Apache License 2.0.", "The code is Apache-2.0 licensed; see the LICENSE file."],
    "MIT": ["Code and documentation are distributed under the MIT license.", "Copyright 2020 the authors. MIT License."],
    "GPL": ["It may be copied under version 2 of the GNU General Public License.", "The tool is free software under the GNU GPL, version 2 or any later version."],
    "LGPL": ["The module is covered by the GNU Lesser General Public License.", "The library may be linked under the LGPL 2.1."],
    "AGPL": ["The server is covered by the GNU Affero General Public License.", "The service is available under the AGPL 3.0."],
    "BSD": ["Distributed under the 2-clause BSD license.", "The program is available under a BSD license with three clauses."],
    "ISC": ["Distributed under the terms of the ISC license."],
    "CC": ["The pictures are available under a Creative Commons Attribution-NonCommercial licence.", "Images: CC BY 2.0."],
    "MPL-2.0": ["Distributed under the Mozilla Public License, version 2.0."],
    "EPL": ["Distributed under the Eclipse Public License, version 1.0."],
    "Unlicense": ["The author has placed this unencumbered software under the Unlicense."],
    "Proprietary": ["Copyright by the publisher, all rights reserved worldwide.", "Confidential and proprietary; do not distribute."],
}
# Licences of no known family, to train on and to calibrate with, and sentences that name a licence.
OTHER_LICENCES = ["Zlib", "Artistic", "Boost Software", "SIL Open Font", "Open Database", "Python Software Foundation", "Common Development and Distribution", "Academic Free", "Microsoft Public", "Sleepycat", "Beerware", "Vovida Software", "Open Publication", "Nokia Open Source"]
HELD_LICENCES = ["PostgreSQL", "European Union Public", "NASA Open Source", "Ruby", "Historical Permission", "W3C Software", "Ricoh Source Code", "Sun Industry Standards"]
LICENCE_SENTENCES = [
    "Licensed under the {} License.",
    "Released under the {} license, version 2.0.",
    "This software is distributed under the terms of the {} License.",
    "This work is licensed under the {} licence, version 1.1.",
    "See the {} License for details.",
    "The {} License",
    "SPDX-License-Identifier: LicenseRef-{}",
    "You may use this file under the terms of the {} license.",
    "Distributed under the {} license.",
    "The code is covered by the {} Licence.",
    "Provided under the {} License; see the file LICENSE.",
    "Released under the {} licence.",
    "The {} Licence applies to this work.",
    "This package is distributed under the {} Public License.",
]
HELD_SENTENCES = ["The sources may be copied under the {} License.", "Available under the terms of the {} licence."]
# Paragraphs that speak of licences or share their words, but are none; the last six calibrate.
OTHERS = [
    "The driver renewed the license at the office and paid the fee in general.",
    "A public version of the work was released in January to the general public.",
    "The museum is free of charge for any person under the age of ten.",
    "With permission of the city the software company may use the hall.",
    "She bought a copy of the first version and a new part of the source text.",
    "The common conditions of the contract were met and the name was changed.",
    "He is a professor at MIT and has a licence to fly.",
    "The Apache people lived in the south under hard conditions.",
    "Bison roam free on the foundation land; the library is open to the public.",
    "Rights and duties of members are reserved for the next meeting.",
    "You may modify the recipe under the terms you like and use any binary choice.",
    "The creative team made a commons area; attribution of the work was unclear.",
    "Der Text ist unter der Brücke und nicht bei der Arbeit in Version zwei.",
    "La licence du bar est publique et la version du projet est bonne.",
    "The moon hid the sun during the eclipse, and the public watched from the library.",
    "A warranty of two years covers the pump; the fitness club is available to members.",
    "The author provided the material for any purpose and without a fee.",
    "The students got a driving license and sold copies of the program at the door.",
    "The city granted a fishing licence to the old man in June.",
    "A new version of the general plan was published by the foundation.",
    "He has a driving license and a car.",
    "The bar lost its license last year.",
    "A licence to fish costs nine euros.",
    "The conference at MIT was open to the public and free of charge.",
    "Members may use the library and copy any part of the books.",
    "Mozilla, Apache and Eclipse are names of projects that she works on.",
    "The contract is subject to conditions and may be changed without notice.",
]
HELD_OTHERS = 6
_FILLER = "the of and to in is that it was for on with as by be this from are at an or not we they story house river city made time people water little long day after".split()
#: Words that say nothing alone: an n-gram needs another one to be a feature.
_PLAIN = set(_FILLER) | set("all any no nor may use used its into can general free name names text work source form forms files copy person available following part deal later holder style project document code little long public version provided met a you under without written conditions library content program subject terms rights products software modify charge domain international into see file should received along have get one purpose above appear list must hope useful more details fee author permission notice law writing specific language kind either basis has 1 2 3 4 1.0 2.0 3.0 4.0 1.1".split())

UNKNOWN, NONE = "unknown", "none"
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def _grams(text: str) -> set[str]:
    """Words, pairs and triples, as the plan makes them."""
    w = re.findall(WORD, text.lower())
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def _varied(rng: random.Random, words: list[str], k: int) -> list[str]:
    """A notice as it is, cut, with words around it, or with those and one word changed."""
    if k % 4 == 1 and len(words) > 10:
        words = words[: rng.randint(8, len(words))]
    if k % 4 >= 2:
        words = rng.choices(_FILLER, k=rng.randint(0, 8)) + words + rng.choices(_FILLER, k=rng.randint(0, 8))
    if k % 4 == 3:
        words[rng.randrange(len(words))] = rng.choice(_FILLER)
    return words


def _examples(seed: int, times: int, notices: dict[str, list[str]], licences: list[str], sentences: list[str], others: list[str]) -> list[tuple[set[str], str]]:
    """Notices of the families, of other licences, and paragraphs of other kinds."""
    rng = random.Random(seed)
    texts = [(n, family) for family, own in notices.items() for n in own]
    texts += [(sentence.format(name), UNKNOWN) for name in licences for sentence in sentences]
    out = []
    for text, family in texts:
        for k in range(times if family != UNKNOWN else max(1, times // 4)):
            out.append((_grams(" ".join(_varied(rng, text.split(), k if family != UNKNOWN else rng.randrange(4)))), family))
    pool = " ".join(others).split() + _FILLER * 3
    for text in others:
        out += [(_grams(text), NONE)] * times
    licence_words = [w for n, _ in texts for w in n.split()]
    for _ in range(len(out)):
        words = rng.choices(pool, k=rng.randint(3, 40))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(licence_words)
        out.append((_grams(" ".join(words)), NONE))
    return out


def training_examples() -> list[tuple[set[str], str]]:
    return _examples(1, 8, NOTICES, OTHER_LICENCES, LICENCE_SENTENCES, OTHERS[:-HELD_OTHERS])


def held_examples() -> list[tuple[set[str], str]]:
    """Other wordings, other licences and other paragraphs than those that are trained on."""
    return _examples(2, 4, HELD_NOTICES, HELD_LICENCES, HELD_SENTENCES, OTHERS[-HELD_OTHERS:])


class Model:
    """Sparse softmax weights by n-gram and class, biases, a temperature, and template n-grams."""

    def __init__(self, l1: float = 0.001, rate: float = 8.0, steps: int = 250, support: int = 3, heavy: float = 2.0):
        self.families = [*NOTICES, UNKNOWN, NONE]
        train, held = training_examples(), held_examples()
        seen = Counter(g for grams, _ in train for g in grams)
        cues = Counter(g for grams, f in train if f != NONE for g in grams)
        # a licence of no known family is told by what stands around its name
        names = {w for x in OTHER_LICENCES for w in re.findall(WORD, x.lower())} - {w for own in NOTICES.values() for x in own for w in re.findall(WORD, x.lower())}
        vocabulary = sorted(g for g, n in seen.items() if n >= support and cues[g] >= 0.5 * n and not _PLAIN.issuperset(w := g.split()) and names.isdisjoint(w))
        y = np.zeros((len(train), len(self.families)))
        y[np.arange(len(train)), [self.families.index(f) for _, f in train]] = 1
        share = y / np.maximum(y.sum(0), 1)  # classes weigh the same, but these two more
        row = (share * np.array([{UNKNOWN: 2.0, NONE: heavy}.get(f, 1.0) for f in self.families])).sum(1)
        row /= row.sum()
        chosen = self._fit(self._matrix(train, vocabulary), y, row, l1, 0.0, rate, steps)[0].any(1)
        vocabulary = [g for g, c in zip(vocabulary, chosen.tolist(), strict=True) if c]
        w, b = self._fit(self._matrix(train, vocabulary), y, row, 0.0, 1e-4, rate, steps)  # again, on what L1 has chosen
        self.weight = dict(zip(vocabulary, w.round(4).tolist(), strict=True))
        self.bias = b.round(4).tolist()
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: self.loss(held, t))
        self.templates = {f: [sorted(_grams(n)) for n in notices] for f, notices in NOTICES.items()}

    @staticmethod
    def _matrix(examples: list[tuple[set[str], str]], vocabulary: list[str]) -> np.ndarray:
        """Each text's n-grams of the vocabulary as a vector of length one."""
        place = {g: i for i, g in enumerate(vocabulary)}
        x = np.zeros((len(examples), len(vocabulary)))
        for r, (grams, _) in enumerate(examples):
            own = [place[g] for g in grams if g in place]
            x[r, own] = 1 / math.sqrt(len(own) or 1)
        return x

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, row: np.ndarray, l1: float, l2: float, rate: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Proximal gradient descent on the weighted softmax loss."""
        w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
        for step in range(steps):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - y) * row[:, None]
            pace = rate / (1 + step / 200)
            w -= pace * (x.T @ d + l2 * w)
            b -= pace * 0.2 * d.sum(0)
            w = np.sign(w) * np.maximum(0, np.abs(w) - l1 * pace)
        return w, b

    def loss(self, examples: list[tuple[set[str], str]], temperature: float | None = None) -> float:
        """Mean negative log likelihood."""
        return -sum(math.log(max(self.probabilities(g, temperature)[self.families.index(f)], 1e-9)) for g, f in examples) / len(examples)

    @staticmethod
    def _softmax(scores: list[float], temperature: float) -> list[float]:
        top = max(scores)
        e = [math.exp((s - top) / temperature) for s in scores]
        return [x / sum(e) for x in e]

    def probabilities(self, grams: set[str], temperature: float | None = None) -> list[float]:
        """What the plan computes, in Python."""
        known = [self.weight[g] for g in sorted(grams) if g in self.weight]
        scores = [b + sum(w[k] for w in known) / math.sqrt(len(known) or 1) for k, b in enumerate(self.bias)]
        return self._softmax(scores, temperature or self.temperature)

    def cue_words(self) -> list[str]:
        """Words of which a notice must hold one to be a licence: each n-gram that speaks for a class against none holds one
        that is not plain."""
        last = len(self.families) - 1
        helpful = [g for g, w in self.weight.items() if max(w[:last]) > w[last]]
        cues = {g for g in helpful if " " not in g}
        for g in sorted(helpful, key=len):
            if not cues & set(g.split()):
                cues.add(max((w for w in g.split() if w not in _PLAIN), key=len))
        return sorted(cues)


@functools.cache
def model() -> Model:
    return Model()


def _word_grams(paragraph: Column) -> Column:
    words = F.regexp_extract_all(paragraph, F.lit(f"({WORD})"), F.lit(1))

    def of(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    # through a lambda's variable, so that the words are made once and not for every place that names them
    return F.element_at(F.transform(F.array(words), lambda w: F.array_distinct(F.concat(w, of(w, 2), of(w, 3)))), 1)


def _literal(value, schema: str) -> Column:
    """A constant of the plan; Catalyst folds it once."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _by_letter(branches: dict[str, str]) -> str:
    """An alternative of words, each with a pattern behind it, that tries a word only where its first letter stands."""
    letters: dict[str, list[str]] = defaultdict(list)
    for word in sorted(branches):
        letters[word[0]].append(re.escape(word[1:]) + branches[word])
    return "(?:" + "|".join(re.escape(c) + "(?:" + "|".join(rest) + ")" for c, rest in sorted(letters.items())) + ")"


@functools.cache
def wrap_pattern() -> str:
    """A line break within a notice, and what stands before it on its line: the words around it follow each other in a
    template, one word of either side left out if need be."""
    near, far = defaultdict(set), defaultdict(set)
    for notices in NOTICES.values():
        for n in notices:
            w = re.findall(WORD, n.lower())
            for i in range(len(w) - 1):
                near[w[i]].add(w[i + 1])
            for i in range(len(w) - 2):
                far[w[i]].add(w[i + 2])
    gap, word = r"[^a-z0-9\n]", r"[a-z0-9]+(?:\.[0-9]+)*+"

    def after(words: set[str]) -> str:
        return _by_letter(dict.fromkeys(words, "")) + r"(?![a-z0-9]|\.[0-9])"

    def behind(w: str) -> str:
        skipped = rf"|{gap}++{word}{gap}*+(?=\n{gap}*+{after(far[w])})|{gap}*+(?=\n{gap}*+{word}{gap}++{after(far[w])})" if w in far else ""
        return rf"(?:{gap}*+(?=\n{gap}*+{after(near[w])}){skipped})"

    return r"(?<![a-z0-9.])(" + _by_letter({w: behind(w) for w in near}) + r")\n"


#: Paragraphs are what stands between blank lines.
PARAGRAPH = r"(?:[^\n]*[^\s][^\n]*(?:\n|\z))+"


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text", similar: float = 0.6) -> DataFrame:
    """One row for each input row: key, n_paragraphs, n_license (notices of a known family), n_unknown (notices of a licence
    of no known family), family (of the most certain notice; ``unknown`` if there are unknown ones alone; null without
    any), probability, similarity (the largest share of one of that family's templates that the notice holds),
    confirmed (``similarity >= similar``) and families (all known ones, sorted).

    Paragraphs are separated by blank lines.  A notice is a line of a paragraph, or the lines over which it is wrapped:
    those are joined where the words around a break follow each other in a template, so that a paragraph may hold
    several notices.  It is of a known family from a probability of a half, and else unknown if it is no licence with
    less than a half.  Null and empty texts have no paragraph; texts are read whole; ties in probability go to the first family in
    order of ``NOTICES``; repeated rows and null keys stay; other columns are not read; no rows in, none out.  Nothing is
    shuffled.
    """
    m = model()
    last = len(m.families) - 2
    gate = r"(?<![a-z0-9])" + _by_letter(dict.fromkeys(m.cue_words(), "")) + r"(?![a-z0-9])"
    known = _literal(list(m.weight), "array<string>")
    weights = _literal(m.weight, "map<string,array<double>>")
    bias = _literal(m.bias, "array<double>")
    zeros = _literal([0.0] * len(m.bias), "array<double>")
    # column names of the input may be anything: only these two are carried; case says nothing
    source = df.select(F.col(key).alias("_key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    notices = F.split(F.regexp_replace("_text", F.lit(wrap_pattern()), F.lit("$1 ")), "\n")
    source = source.withColumn("_n", F.regexp_count("_text", F.lit(PARAGRAPH)))
    candidates = F.when(F.col("_text").rlike(gate), F.filter(notices, lambda x: x.rlike(gate))).otherwise(F.array().cast("array<string>"))

    def judge(notice: Column) -> Column:
        # through a lambda's variable, so that the n-grams are made once
        def scores(grams: Column) -> Column:
            total = F.aggregate(grams, zeros, lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b))
            scale = F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double")) * F.lit(m.temperature)
            return F.zip_with(total, bias, lambda t, b: t / scale + b / F.lit(m.temperature))

        return F.struct(notice.alias("text"), F.element_at(F.transform(F.array(F.array_intersect(_word_grams(notice), known)), scores), 1).alias("s"))

    def settle(x: Column) -> Column:
        top = F.array_max(x["s"])
        total = F.aggregate(x["s"], F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
        best = F.array_max(F.slice(x["s"], 1, last))
        none = F.exp(F.element_at(x["s"], last + 2) - top) / total
        return F.struct((F.exp(best - top) / total).alias("probability"), F.array_position(F.slice(x["s"], 1, last), best).cast("int").alias("k"), x["text"].alias("text"), none.alias("none"))

    settled = source.withColumn("_settled", F.transform(F.transform(candidates, judge), settle))
    judged = settled.withColumn("_found", F.filter("_settled", lambda x: x["probability"] >= 0.5)).withColumn("_open", F.size(F.filter("_settled", lambda x: (x["probability"] < 0.5) & (x["none"] < 0.5))))
    names = _literal(m.families[:last], "array<string>")
    best = F.aggregate("_found", F.struct(F.lit(0.0).alias("probability"), F.lit(0).alias("k"), F.lit("").alias("text"), F.lit(1.0).alias("none")), lambda acc, x: F.when((x["probability"] > acc["probability"]) | ((x["probability"] == acc["probability"]) & (x["k"] < acc["k"])), x).otherwise(acc))
    judged = judged.withColumn("_best", F.when(F.size("_found") > 0, best))
    templates = _literal([m.templates[f] for f in m.families[:last]], "array<array<array<string>>>")
    share = F.transform(F.array(_word_grams(F.col("_best.text"))), lambda g: F.array_max(F.transform(F.element_at(templates, F.col("_best.k")), lambda t: F.size(F.array_intersect(t, g)) / F.size(t))))
    similarity = F.element_at(share, 1)
    out = judged.withColumn("similarity", F.when(F.col("_best").isNotNull(), similarity))
    return out.select(
        F.col("_key").alias(key),
        F.col("_n").cast("long").alias("n_paragraphs"),
        F.size("_found").cast("long").alias("n_license"),
        F.col("_open").cast("long").alias("n_unknown"),
        F.when(F.col("_best").isNotNull(), F.element_at(names, F.col("_best.k"))).when(F.col("_open") > 0, UNKNOWN).alias("family"),
        F.col("_best.probability").alias("probability"),
        "similarity",
        F.coalesce(F.col("similarity") >= similar, F.lit(False)).alias("confirmed"),
        F.array_sort(F.array_distinct(F.transform("_found", lambda x: F.element_at(names, x["k"])))).alias("families"),
    )
