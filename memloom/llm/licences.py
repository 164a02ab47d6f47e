"""Licence scans: a trained paragraph classifier. A sparse word n-gram logistic regression names the licence
family of a paragraph, with a calibrated unknown class, and comparison with the family's templates confirms it.

The model is fitted on the driver from the fixed sentences below; paragraphs are scored with SQL functions only,
inside the row of their document, so that nothing is shuffled.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import free_name

# Sentences by which licences are granted or named, by family.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is distributed under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "The code is available under the terms of the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.",
        "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "MIT License. Copyright (c) 2021 The Authors.",
        "The code is MIT licensed.",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Distributed under the BSD license.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under the GNU GPL license version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPLv3.",
        "This file is part of a program under the GNU General Public License v3.0.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GNU GPL license version 2.",
        "Licensed under the GPLv2 or, at your option, any later version.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is distributed under the LGPL license.",
        "This library is free software; you can redistribute it under the terms of the GNU Library General Public License, version 2.1.",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL license version 3.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Content is available under the CC BY-NC license.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the CC BY license.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 license terms.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (public domain).",
        "Licensed under the Unlicense license.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Use, modification and distribution are subject to the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License - v 1.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "cddl": [
        "The contents of this file are subject to the terms of the Common Development and Distribution License.",
        "Licensed under the CDDL license, version 1.0.",
        "SPDX-License-Identifier: CDDL-1.0",
    ],
    "artistic": [
        "You may distribute under the terms of the Artistic License.",
        "This library is released under the Artistic License 2.0.",
        "SPDX-License-Identifier: Artistic-2.0",
    ],
    "proprietary": [
        "Copyright 2024 Example Inc. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without permission of the publisher.",
        "All rights reserved.",
        "Copyright the company, all rights reserved. Unauthorized use is prohibited.",
        "This software is proprietary and confidential; unauthorized copying is prohibited without a license agreement.",
    ],
}
# Sentences that use the same words and license nothing.
UNKNOWN_TEXTS = [
    "The driver has to show a licence and pay the fee.",
    "He lost his driving license after the accident.",
    "She asked for permission to leave the room.",
    "The warranty covers parts for two years.",
    "The city council granted the bar a liquor license last week.",
    "Poetic licence let the author change the order of events.",
    "They discussed copyright law at the conference.",
    "The fishing license is valid until the end of the season.",
    "The pilot renewed the license in the spring.",
    "The parks are in the public domain of the town.",
    "A license costs ten dollars at the office.",
    "He gave permission for the trip without any doubt.",
    "Which license should I choose for my project?",
    "The redistribution of land took ten years.",
    "The company bought a software license for the new office.",
    "We debated whether the court would rule on copyright.",
    "The minister promised redistribution of income under the new law.",
    "The teacher asked the class for permission to record.",
    "There is a warranty and a license plate on the car.",
    "The apache helicopter flew over the village.",
    "The version of the story that the license clerk told was odd.",
    "The copyright of the photo is disputed and the license has expired.",
    "A permission notice hung on the door of the school.",
    "The eclipse was seen by the general public, no license needed.",
    "An artistic license covers the changes in the film.",
    "The permission was granted to the team after a long debate.",
    "You need a license to fish, and a copy of it must be shown.",
    "The warranty does not cover damage caused by the user of the car.",
    "Copyright is a matter of law, and the publisher asked for legal advice.",
    "He studied at MIT and lost his license there.",
    "The general public needs a license to hunt.",
]
UNKNOWN = "unknown"
#: An n-gram is a feature only if it holds one of these; so a paragraph without any of them has no feature and is
#: unknown, and needs no scoring.
STEMS = r"licen[sc]e|copyright|warrant|permission|permitted|redistribut|public domain|rights reserved|creative commons|\bcc[^a-z0-9]+by\b|\bcc0\b|proprietary|unencumbered|apache|mozilla|\bgnu\b|\b[al]?gpl|\bbsd\b|spdx|\bmpl\b|\bcddl\b|\bdisclaimer\b"
#: So are these, in a paragraph that holds one of the former.
DETAIL = r"\bversion [0-9]|\bv 2 0\b|lesser|affero|noncommercial|sharealike|\bnc\b|\bsa\b|spdx|free software|eclipse|artistic|boost|\bisc\b|\bmit\b|common development"
#: The same before a text is split into words: between two words of a stem may stand signs and line ends.
LOOSE = "(?i)" + STEMS.replace(" ", r"[^a-z0-9]+")
WORDS = 4
SLOTS = 1 << 13
#: Words of a window, and from one window's beginning to the next one's: a long paragraph is scored in windows, so
#: that a phrase of up to half a window is whole in one of them.
WINDOW, STRIDE = 48, 24
#: Calibrated probability below which a paragraph is unknown, and the share of a paragraph's or template's words
#: that the other must hold to confirm a family.
CONFIDENT, CONFIRMS = 0.5, 0.6


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def features_of(words: list[str]) -> set[str]:
    grams = {" ".join(words[k : k + n]) for n in range(1, WORDS + 1) for k in range(len(words) - n + 1)}
    return {g for g in grams if re.search(f"{STEMS}|{DETAIL}", g)}


def _slots(gram: str, salt: int) -> list[int]:
    """The two places of an n-gram in the literal tables; CRC-32 is the same in SQL."""
    return [zlib.crc32(f"{salt}{side}{gram}".encode()) % SLOTS for side in "ab"]


def _table(vocabulary: list[str], salt: int) -> list[int] | None:
    """The number of the n-gram at each place, -1 elsewhere, with every n-gram at one of its two places; None if it
    can't be had with this salt."""
    table = [-1] * SLOTS
    for k in range(len(vocabulary)):
        own, at = k, _slots(vocabulary[k], salt)[0]
        for _ in range(200):
            own, table[at] = table[at], own
            if own < 0:
                break
            one, two = _slots(vocabulary[own], salt)
            at = two if at == one else one
        else:
            return None
    return table


def _fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 600, rate: float = 1.0, shrink: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by gradient descent with momentum: weights and biases. The weights are held as
    sums of rows (there are fewer rows than n-grams), and made out of them at the end."""
    a, b = np.zeros((len(x), classes)), np.zeros(classes)
    va, vb = np.zeros_like(a), np.zeros_like(b)
    goal, alike = np.eye(classes)[y], x @ x.T
    for _ in range(rounds):
        z = alike @ a + b
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - goal) / len(x)
        va, vb = 0.9 * va - rate * (d + shrink * a), 0.9 * vb - rate * d.sum(0)
        a, b = a + va, b + vb
    return x.T @ a, b


@functools.cache
def model() -> dict:
    """Classes, n-grams with their weights, biases, and the temperature that calibrates the probabilities: of a
    grid, the one of least log-loss over sentences left out of training (a third at a time)."""
    whole = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t) for t in UNKNOWN_TEXTS]
    rows = []
    for f, t in whole:  # a sentence as it stands, and as a window may cut it
        words = t.split()
        rows += [(f, t)] + [(f, " ".join(part)) for part in (words[: len(words) * 2 // 3], words[len(words) // 3 :]) if len(words) >= 18]
    classes = [*TEMPLATES, UNKNOWN]
    feats = [features_of(words_of(t)) for _, t in rows]
    vocabulary = sorted(set().union(*feats))
    index = {g: k for k, g in enumerate(vocabulary)}
    x, y = np.zeros((len(rows), len(vocabulary))), np.array([classes.index(f) for f, _ in rows])
    for k, own in enumerate(feats):
        for g in own:
            x[k, index[g]] = 1 / max(1, len(own)) ** 0.5
    left, goal = [], []
    for fold in range(3):
        out = np.arange(len(rows)) % 3 == fold
        w, b = _fit(x[~out], y[~out], len(classes))
        left.append(x[out] @ w + b)
        goal.append(y[out])
    z, goal = np.concatenate(left), np.concatenate(goal)

    def loss(t: float) -> float:
        p = np.exp(z / t - (z / t).max(1, keepdims=True))
        return -np.log((p / p.sum(1, keepdims=True))[np.arange(len(z)), goal]).mean()

    heat = min((0.25 * 1.25**k for k in range(16)), key=loss)
    w, b = _fit(x, y, len(classes))
    salt, table = next((k, t) for k in itertools.count() if (t := _table(vocabulary, k)) is not None)
    return {"classes": classes, "vocabulary": vocabulary, "w": w / heat, "b": b / heat, "salt": salt, "table": table}


def _literal(values: list[str], kind: str) -> Column:
    """A constant array; the optimiser folds the split once."""
    return F.split(F.lit("\x1f".join(values)), "\x1f").cast(f"array<{kind}>")


def _score(words: Column) -> Column:
    """family, probability, confirmed of a paragraph given as its words."""
    m = model()
    n, classes = len(m["classes"]), m["classes"]
    places = _literal([str(k + 1) for k in m["table"]], "int")  # 0 where no n-gram is
    names = _literal(["", *m["vocabulary"]], "string")
    flat = _literal([f"{v:.6f}" for row in m["w"] for v in row], "double")
    last = F.size(words)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(WORDS)), lambda k: F.when(last >= k, F.transform(F.sequence(F.lit(1), F.greatest(last - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))))
    grams = F.array_distinct(F.filter(grams, lambda g: g.rlike(f"{STEMS}|{DETAIL}")))
    place = lambda g, side: F.element_at(places, F.pmod(F.crc32(F.concat(F.lit(f"{m['salt']}{side}"), g).cast("binary")), F.lit(SLOTS)).cast("int") + 1)
    found = F.transform(grams, lambda g: F.struct(g.alias("g"), place(g, "a").alias("a"), place(g, "b").alias("b")))
    found = F.transform(found, lambda x: F.when(F.element_at(names, x.a + 1) == x.g, x.a).when(F.element_at(names, x.b + 1) == x.g, x.b).otherwise(0))
    found = F.filter(found, lambda k: k > 0)
    known = F.transform(found, lambda k: F.struct(k.alias("k")))
    known = F.transform(known, lambda x: F.slice(flat, (x.k - 1) * n + 1, F.lit(n)))
    zero, bias = F.array(*[F.lit(0.0)] * n), F.array(*[F.lit(float(v)) for v in m["b"]])
    total = F.aggregate(known, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    z = F.transform(F.array(F.struct(total.alias("t"), F.greatest(F.size(found), F.lit(1)).alias("m"))), lambda s: F.zip_with(s.t, bias, lambda p, q: p / F.sqrt(s.m) + q))[0]

    def soft(z: Column) -> Column:
        e = F.transform(F.array(z), lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))[0]
        return F.transform(F.array(e), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y)))[0]

    labels = F.array(*[F.lit(c) for c in classes])
    templates = F.create_map(*[x for f, ts in TEMPLATES.items() for x in (F.lit(f), F.array(*[F.array(*[F.lit(w) for w in dict.fromkeys(words_of(t))]) for t in ts]))])

    def name(p: Column) -> Column:
        top = F.array_max(p)
        family = F.when(top >= CONFIDENT, F.element_at(labels, F.array_position(p, top).cast("int"))).otherwise(F.lit(UNKNOWN))
        own = F.array_distinct(words)
        shared = F.transform(F.coalesce(F.element_at(templates, family), F.array().cast("array<array<string>>")), lambda t: F.size(F.array_intersect(t, own)) / F.greatest(F.lit(1), F.least(F.size(t), F.size(own))))
        return F.struct(family.alias("family"), top.alias("probability"), (F.coalesce(F.array_max(shared), F.lit(0.0)) >= CONFIRMS).alias("confirmed"))

    return F.transform(F.transform(F.array(z), soft), name)[0]


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: ``keep``, n_paragraphs, and licences: an array of (paragraph, family, probability,
    confirmed), one for each family that a window of the paragraph has, with the greatest probability; paragraphs
    whose windows are all of the unknown class have none.

    Paragraphs stand between lines without letters and digits (blank ones, or comment signs alone) and are counted
    from 1; a notice wrapped over several lines is one paragraph, and comment signs are no words. Null and empty
    texts have none. Every row gives one row; long texts are scored whole."""
    body = F.coalesce(F.col(text), F.lit(""))
    own, lines = free_name(docs, "paragraphs"), free_name(docs, "found")
    paragraphs = F.filter(F.split(body, r"\n(?:[^\p{L}\p{N}\n]*\n)+"), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    rows = docs.select(*keep, paragraphs.alias(own), body.rlike(LOOSE).alias(lines))

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - STRIDE, F.lit(1)), F.lit(STRIDE))
        return F.filter(F.transform(starts, lambda k: F.slice(words, k, F.lit(WINDOW))), lambda w: F.array_join(w, " ").rlike(STEMS))

    def families(scores: Column, paragraph: Column) -> Column:
        named = F.array_sort(F.array_distinct(F.transform(F.filter(scores, lambda x: x.family != UNKNOWN), lambda x: x.family)))
        return F.transform(named, lambda f: F.struct(paragraph.alias("paragraph"), f.alias("family"), F.array_max(F.transform(F.filter(scores, lambda x: x.family == f), lambda x: x.probability)).alias("probability"), F.exists(scores, lambda x: (x.family == f) & x.confirmed).alias("confirmed")))

    marked = F.filter(F.transform(F.col(own), lambda p, k: F.struct((k + 1).alias("paragraph"), p.alias("p"))), lambda x: x.p.rlike(LOOSE))
    cut_up = F.transform(marked, lambda x: F.struct(x.paragraph.alias("paragraph"), windows(F.regexp_extract_all(F.lower(x.p), F.lit("[a-z0-9]+"), 0)).alias("w")))
    scored = F.transform(cut_up, lambda x: F.struct(x.paragraph.alias("paragraph"), F.transform(x.w, _score).alias("s")))
    scored = F.flatten(F.transform(scored, lambda x: families(x.s, x.paragraph)))
    none = F.array().cast("array<struct<paragraph:int,family:string,probability:double,confirmed:boolean>>")
    return rows.select(*keep, F.size(own).cast("long").alias("n_paragraphs"), F.when(F.col(lines), scored).otherwise(none).alias("licences"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, families and confirmed (sorted, comma-joined) and the least
    probability among the document's licence paragraphs (null if none)."""
    got = scan(docs)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x.family))), ",")
    return got.select(
        "doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), joined(F.col("licences")).alias("families"),
        joined(F.filter("licences", lambda x: x.confirmed)).alias("confirmed"), F.round(F.array_min(F.transform("licences", lambda x: x.probability)), 6).alias("least_probability"),
    )
