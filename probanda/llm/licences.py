"""Licence scans: a trained paragraph classifier, in DataFrame functions only.

A paragraph is what stands between empty lines and has a letter or digit. It is read as its words in order,
however its lines are broken, and a notice may be all of it or stand anywhere in it: around each of its
`signs()`, windows as wide as the notices are long (`widths()`) are classified. Distinct word n-grams up to
MOST words are the features of a softmax regression over licence families and
`unknown`. Weights are learnt on the driver from generated
variants of the notices below and of harmless lines, TRAINED of each, and go
into the plan as one constant; small ones are dropped. A family counts only if
its probability reaches a limit calibrated on other generated lines (at most
MISSED of the harmless ones pass) and the window holds at least SHARED of the word pairs
of a notice of that family. An SPDX identifier has the family of that
identifier, exactly, or none. All else is unknown.

Signs are words picked so that more than 1 - SHARED of each notice's pairs have one: where none stands,
nothing could be confirmed.

Null and empty texts have no paragraphs. Families are listed by name, once each; n_licences counts
each family once a paragraph.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening notices of common licences.
NOTICES: dict[str, list[str]] = {
    "AGPL": ["This program is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This text is available under the Creative Commons Attribution License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work and placed it in the public domain.", "Dedicated to the public domain under CC0."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 1.0."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL, version 2 or later."],
    "ISC": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "Licensed under the MIT license."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "Proprietary": ["Copyright. All rights reserved.", "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher. All rights reserved."],
}
#: Harmless lines with the same words.
HARMLESS = ["her driver's license was issued in the city", "the license fee is due in version two of the plan", "a licensed physician works under the general hospital", "he had a fishing license and a public library card", "the apache helicopter landed in the field", "students of mit met the public", "the copyright office is open to the public", "licence plates are sold by the state", "free software was discussed at the meeting", "a creative commons of the village", "the terms of the public debt were general", "permission was granted to the visitors", "the software license costs money each year", "license"]
#: The identifiers of each family.
IDENTIFIERS: dict[str, str] = {
    "AGPL": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later",
    "Apache-2.0": "Apache-2.0",
    "BSD": "BSD-2-Clause BSD-3-Clause 0BSD BSD-4-Clause",
    "CC-BY": "CC-BY-3.0 CC-BY-4.0",
    "CC-BY-NC": "CC-BY-NC-3.0 CC-BY-NC-4.0",
    "CC-BY-SA": "CC-BY-SA-3.0 CC-BY-SA-4.0",
    "CC0": "CC0-1.0",
    "EPL": "EPL-1.0 EPL-2.0",
    "GPL": "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later",
    "ISC": "ISC",
    "LGPL": "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later",
    "MIT": "MIT MIT-0",
    "MPL": "MPL-1.1 MPL-2.0",
    "Unlicense": "Unlicense",
    "Zlib": "Zlib",
}
IDENTIFIER = r"spdx-license-identifier:\s*([a-z0-9.+-]+)"
#: What parts paragraphs: an end of line and one or more empty lines.
BLANK = r"\n(?:[ \t\r\x0B\x0C]*\n)+"
UNKNOWN = "unknown"
CLASSES = (UNKNOWN, *sorted(NOTICES))
MOST, TRAINED, ROUNDS, DROPPED, MISSED, SHARED = 3, 60, 120, 0.03, 0.01, 0.6
#: Words that the narrowest windows reach to either side; the others double it until the longest notice fits.
NARROWEST = 6
TOKEN = re.compile("[a-z0-9]+")


def grams(text: str, most: int = MOST) -> list[str]:
    w = TOKEN.findall(text.lower())
    return list(dict.fromkeys(" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)))


def _variants(r: random.Random, texts: list[str], n: int) -> list[str]:
    """Texts with words left out, cut short or set among other words."""
    word = lambda: "".join(r.choice(["ta", "ro", "li", "en", "su", "mo", "che", "vi"]) for _ in range(r.randint(1, 4)))
    out = list(texts)
    while len(out) < n:
        w = r.choice(texts).split()
        if len(w) > 8 and r.random() < 0.3:
            w = w[: r.randint(6, len(w))]
        w = [x for x in w if r.random() > 0.04]
        if r.random() < 0.5:
            w = [word() for _ in range(r.randint(0, 6))] + w + [word() for _ in range(r.randint(0, 6))]
        out.append(" ".join(w))
    return out


def generated(seed: int) -> list[tuple[str, str]]:
    r = random.Random(seed)
    lines = [(k, t) for k in CLASSES[1:] for t in _variants(r, NOTICES[k], TRAINED)]
    return lines + [(UNKNOWN, t) for t in _variants(r, HARMLESS, 4 * TRAINED)]


class Model:
    """weights: by n-gram, one number a class; bias; limit: least probability of a family."""

    def __init__(self, seed: int = 3):
        lines = generated(seed)
        names = sorted({g for _, t in lines for g in grams(t)})
        seen = np.zeros(len(names))
        place = {g: i for i, g in enumerate(names)}
        for _, t in lines:
            seen[[place[g] for g in grams(t)]] += 1
        names = [g for g in names if seen[place[g]] >= 3]
        place = {g: i for i, g in enumerate(names)}
        x, y = np.zeros((len(lines), len(names) + 1)), np.zeros((len(lines), len(CLASSES)))
        for i, (k, t) in enumerate(lines):
            x[i, [place[g] for g in grams(t) if g in place]] = 1
            x[i, -1] = 1
            y[i, CLASSES.index(k)] = 1
        w = np.zeros((x.shape[1], len(CLASSES)))
        for _ in range(ROUNDS):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w += 2.0 * (x.T @ (y - p) / len(x) - 1e-4 * w)
        self.weights = {g: [round(float(v), 4) for v in w[i]] for g, i in place.items() if np.abs(w[i]).max() >= DROPPED}
        self.bias = [round(float(v), 4) for v in w[-1]]
        harmless = sorted((p for k, p in (self.predict(t) for label, t in generated(seed + 1) if label == UNKNOWN) if k != UNKNOWN), reverse=True)
        allowed = int(MISSED * 4 * TRAINED)
        self.limit = round(max(0.5, harmless[allowed] + 0.01 if len(harmless) > allowed else 0.5), 4)

    def predict(self, text: str) -> tuple[str, float]:
        z = np.array(self.bias)
        for g in grams(text):
            if g in self.weights:
                z = z + np.array(self.weights[g])
        k = int(np.argmax(z))
        return CLASSES[k], float(1 / np.exp(z - z[k]).sum())


@cache
def model() -> Model:
    return Model()


def _pairs(text: str) -> list[str]:
    w = TOKEN.findall(text.lower())
    return list(dict.fromkeys(" ".join(p) for p in zip(w, w[1:], strict=False)))


@cache
def signs() -> tuple[str, ...]:
    """Words of which all that shares enough with a notice has one, found greedily: those that most pairs still need, the longest first."""
    words = Counter(w for v in NOTICES.values() for t in v for w in TOKEN.findall(t.lower()))
    out: list[str] = []
    left = [p for v in NOTICES.values() for p in map(_pairs, v) if p]
    while left:
        best = max(words, key=lambda w: (len(w) >= 5, sum(w in x.split() for p in left for x in p) * min(len(w), 8), w))
        out.append(best)
        del words[best]
        left = [p for p in left if sum(any(w in x.split() for w in out) for x in p) <= (1 - SHARED) * len(p)]
    return tuple(sorted(out))


@cache
def widths() -> tuple[int, ...]:
    longest, out = max(len(TOKEN.findall(t)) for v in NOTICES.values() for t in v), [NARROWEST]
    while out[-1] < longest:
        out.append(2 * out[-1])
    return tuple(out)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def _runs(w: Column, k: int) -> Column:
    """The runs of k words of an array."""
    first = F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0)))
    return F.transform(first, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, k)]))


def _windows(words: Column) -> Column:
    """What stands around each sign among the words, at every width, once each."""
    listed = F.array(*[F.lit(x) for x in signs()])

    def around(p: Column) -> Column:  # p from 0
        start = lambda n: F.greatest(p - (n - 2), F.lit(1))
        return F.array(*[F.slice(words, start(n), p + n - start(n) + 1) for n in widths()])

    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(F.filter(places, lambda p: F.array_contains(listed, F.get(words, p))), around)))


def _classified(words: Column, m: Model) -> Column:
    """family, probability, shared of the words of a window."""
    weights = F.from_json(F.lit(json.dumps(m.weights)), "map<string,array<double>>")
    known = F.from_json(F.lit(json.dumps(list(m.weights))), "array<string>")
    notices = F.from_json(F.lit(json.dumps({k: [_pairs(t) for t in v] for k, v in NOTICES.items()})), "map<string,array<array<string>>>")
    names = F.array(*[F.lit(c) for c in CLASSES])
    bias = F.array(*[F.lit(b) for b in m.bias])
    add = lambda acc, g: _let(F.try_element_at(weights, g), lambda v: F.when(v.isNull(), acc).otherwise(F.zip_with(acc, v, lambda a, b: a + b)))

    def judged(w: Column) -> Column:
        features = F.array_intersect(F.concat(w, *[_runs(w, k) for k in range(2, MOST + 1)]), known)  # distinct ones that have weights
        scores = F.aggregate(features, bias, add)
        best = _let(scores, lambda z: F.struct(F.array_position(z, F.array_max(z)).cast("int").alias("k"), (1 / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(z)))).alias("p")))

        def compared(b: Column) -> Column:
            family = F.element_at(names, b["k"])
            own = F.array_distinct(_runs(w, 2))
            shared = _let(own, lambda o: F.array_max(F.transform(F.try_element_at(notices, family), lambda t: F.size(F.array_intersect(o, t)) / F.size(t))))
            return F.struct(family.alias("family"), b["p"].alias("probability"), F.coalesce(shared, F.lit(0.0)).alias("shared"))

        return _let(best, compared)

    return judged(words)


def _has_sign(lowered: Column) -> Column:
    """Whether a sign, or what begins an identifier, is among the words."""
    return F.arrays_overlap(F.split(lowered, "[^a-z0-9]+"), F.array(*[F.lit(s) for s in (*signs(), "spdx")]))


def _identified(block: Column) -> Column:
    """The families that SPDX identifiers name, null for unknown ones."""
    named = F.from_json(F.lit(json.dumps({i.lower(): k for k, v in IDENTIFIERS.items() for i in v.split()})), "map<string,string>")
    return F.transform(F.regexp_extract_all(block, F.lit(IDENTIFIER), 1), lambda x: F.try_element_at(named, F.rtrim(x, F.lit("."))))


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, n_unknown (paragraphs without a licence), all long, families (comma-joined) of every document; no shuffle."""
    m = model()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    has_content = lambda x: x.rlike("[\\p{L}\\p{N}]")
    blocks = F.filter(F.split("text", BLANK), has_content)
    rows = rows.select("doc_id", F.size(blocks).cast("long").alias("n_paragraphs"), F.when(_has_sign(F.col("text")), F.filter(blocks, _has_sign)).otherwise(F.array().cast("array<string>")).alias("_blocks"))

    def found(block: Column) -> Column:
        """The families of a paragraph."""
        classified = lambda ws: F.transform(F.filter(F.transform(_windows(ws), lambda x: _classified(x, m)), sure), lambda c: c["family"])
        return F.concat(_identified(block), _let(F.regexp_extract_all(block, F.lit("[a-z0-9]+"), 0), classified))

    sure = lambda c: (c["family"] != UNKNOWN) & (c["probability"] >= m.limit) & (c["shared"] >= SHARED)
    rows = rows.withColumn("_found", F.transform("_blocks", lambda b: F.array_compact(F.array_distinct(found(b)))))
    size = lambda c: F.size(c).cast("long")
    return rows.select("doc_id", "n_paragraphs", size(F.flatten("_found")).alias("n_licences"), (F.col("n_paragraphs") - size(F.filter("_found", lambda x: F.size(x) > 0))).alias("n_unknown"), F.array_join(F.array_sort(F.array_distinct(F.flatten("_found"))), ",").alias("families"))


def licences_sql() -> str:
    """The same scan as DuckDB SQL over the same weights."""
    m = model()
    text = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(xs) + "]"
    weights = ", ".join(f"({text(g)}, {listed(map(str, v))})" for g, v in m.weights.items())
    notices = ", ".join(f"({text(k)}, {listed(map(text, _pairs(t)))})" for k, v in NOTICES.items() for t in v)
    named = ", ".join(f"({text(i.lower())}, {text(k)})" for k, v in IDENTIFIERS.items() for i in v.split())
    run = lambda k: f"list_transform(generate_series(1, len(w) - {k - 1}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))"
    content = "regexp_matches({}, '[\\p{{L}}\\p{{N}}]')".format
    return f"""
WITH weights(g, v) AS (VALUES {weights}), notices(family, pairs) AS (VALUES {notices}), named(name, family) AS (VALUES {named}),
d AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS text FROM documents),
q AS (SELECT r, b, block, regexp_extract_all(block, '[a-z0-9]+') AS w
      FROM (SELECT r, generate_subscripts(x, 1) AS b, unnest(x) AS block FROM (SELECT r, string_split_regex(text, '{BLANK}') AS x FROM d)) WHERE {content("block")}),
c AS (SELECT row_number() OVER () AS i, r, b, w[greatest(j - n + 1, 1):j + n - 1] AS w
      FROM (SELECT r, b, w, unnest(generate_series(1, len(w))) AS j FROM q), (VALUES {", ".join(f"({n})" for n in widths())}) AS t(n) WHERE list_contains({listed(map(text, signs()))}, w[j])),
f AS (SELECT i, unnest(list_distinct(list_concat(w, {run(2)}, {run(3)}))) AS g FROM c),
s AS (SELECT i, k, sum(v[k]) AS z FROM f JOIN weights USING (g), generate_series(1, {len(CLASSES)}) AS t(k) GROUP BY ALL),
a AS (SELECT s.i, t.k, coalesce(z, 0) + ({listed(map(str, m.bias))})[t.k] AS z FROM (SELECT DISTINCT i FROM s) AS s CROSS JOIN generate_series(1, {len(CLASSES)}) AS t(k) LEFT JOIN s AS z ON s.i = z.i AND z.k = t.k),
b AS (SELECT i, arg_max(k, z) AS k, 1 / sum(exp(z - top)) AS p FROM (SELECT *, max(z) OVER (PARTITION BY i) AS top FROM a) GROUP BY i),
e AS (SELECT b.i, ({listed(map(text, CLASSES))})[b.k] AS family, p, list_distinct({run(2)}) AS own FROM b JOIN c USING (i) WHERE p >= {m.limit}),
h AS (SELECT DISTINCT i, family FROM e JOIN notices USING (family) WHERE len(list_intersect(own, pairs)) / len(pairs) >= {SHARED}),
o AS (SELECT r, b, family FROM h JOIN c USING (i) UNION
      SELECT r, b, family FROM (SELECT r, b, unnest(regexp_extract_all(block, '{IDENTIFIER}', 1)) AS x FROM q) JOIN named ON name = rtrim(x, '.')),
n AS (SELECT r, count(*) AS n_paragraphs FROM q GROUP BY r),
x AS (SELECT r, count(*) AS n_licences, count(DISTINCT b) AS n_known, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM o GROUP BY r)
SELECT doc_id, CAST(coalesce(n_paragraphs, 0) AS BIGINT) AS n_paragraphs, CAST(coalesce(n_licences, 0) AS BIGINT) AS n_licences,
       CAST(coalesce(n_paragraphs, 0) - coalesce(n_known, 0) AS BIGINT) AS n_unknown, coalesce(families, '') AS families
FROM d LEFT JOIN n USING (r) LEFT JOIN x USING (r)
"""
