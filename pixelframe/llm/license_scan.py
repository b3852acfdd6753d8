"""License scans by patience alignment of documents with notice templates.

Words that stand once in both a template and a stretch of text are anchors; the longest increasing
subsequence of their places keeps those in order, and the gaps between them are aligned in the same way.
A template's coverage is the share of its words that are matched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import small_batches

WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

# Public licence notices.
TEMPLATES = {
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


@dataclass(frozen=True)
class LicenseRules:
    """min_coverage of a template's words must be matched within max_spread times its length of text."""

    min_coverage: float = 0.8
    max_spread: float = 1.5


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs ascending in their first place, a longest subsequence ascending in the second."""
    tails, at, before = [], [], {}
    for k, (_, y) in enumerate(pairs):
        d = bisect_left(tails, y)
        tails[d : d + 1] = [y]
        at[d : d + 1] = [k]
        before[k] = at[d - 1] if d else None
    out, k = [], at[-1] if at else None
    while k is not None:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), ascending. A gap without anchors matches nothing but its equal ends."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = longest_increasing([(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x0 + 1, x1, y0 + 1, y1) for (x0, y0), (x1, y1) in zip(ends, ends[1:])]
    return sorted(out)


class LicenseFinder:
    def __init__(self, templates: dict[str, str], rules: LicenseRules):
        self.rules = rules
        self.templates = [(name, w) for name, t in sorted(templates.items()) if (w := words_of(t))]
        self.holding = defaultdict(list)
        for k, (_, w) in enumerate(self.templates):
            for x in dict.fromkeys(w):
                self.holding[x].append(k)

    def find(self, text: str | None) -> list[tuple[str, int, int, int]]:
        """(template, first word, last word + 1, matched words) of each notice; where they overlap, the one with most matched words, then
        that of the shorter template: a notice isn't taken for a longer one of a like licence.

        A template is looked for in the stretches of text around its rarest word there: enough words on
        both sides for the whole template at the allowed spread.
        """
        if not text:
            return []
        words = words_of(text)
        places: dict[str, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            if w in self.holding:
                places[w].append(k)
        found = []
        for name, template in self.templates:
            need = self.rules.min_coverage * len(template)
            own = Counter(template)
            if sum(n for w, n in own.items() if w in places) < need:
                continue
            # At most len - need words may be missing: one of any so many + 1 of the template's words is there.
            spare = int(len(template) - need)
            ranked, seeds = sorted(own, key=lambda w: (len(places.get(w, ())), w)), []
            for w in ranked:
                seeds += places.get(w, ())
                spare -= own[w]
                if spare < 0:
                    break
            reach, end = int(self.rules.max_spread * len(template)), -1
            for seed in sorted(seeds):
                if seed < end:
                    continue
                low = max(0, seed - reach, end)
                matched = patience(template, words[low : seed + reach])
                if len(matched) >= need and matched[-1][1] + 1 - matched[0][1] <= self.rules.max_spread * len(template):
                    end = low + matched[-1][1] + 1
                    found.append((name, low + matched[0][1], end, len(matched)))
        out: list[tuple[str, int, int, int]] = []
        size = {name: len(w) for name, w in self.templates}
        for x in sorted(found, key=lambda x: (-x[3], size[x[0]], x[1], x[0])):
            if all(x[2] <= y[1] or x[1] >= y[2] for y in out):
                out.append(x)
        return sorted(out, key=lambda x: x[1])


SPANS = "array<struct<template string, start long, end long, matched long>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, rules: LicenseRules = LicenseRules()) -> DataFrame:
    """doc_id and licenses (template, start and end in words, end exclusive, matched words), per row of docs.

    Null and empty texts have none; notices don't overlap, the one with more matched words wins, then the
    shorter template, the earlier, the first by name. Repeated rows are scanned each; other columns aren't read. The
    templates are a fixed list, sent with the code.
    """
    small_batches(docs.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        finder = LicenseFinder(templates, rules)
        return pd.Series([[dict(zip(("template", "start", "end", "matched"), x)) for x in finder.find(t)] for t in texts], dtype=object)

    return docs.select("doc_id", F.pandas_udf(run, SPANS, F.PandasUDFType.SCALAR)("text").alias("licenses"))


def license_digest(docs: DataFrame, templates: dict[str, str] = TEMPLATES, rules: LicenseRules = LicenseRules()) -> DataFrame:
    """doc_id, n_licenses, licenses (distinct templates, sorted, comma-joined), covered_words, min_coverage_pct (of the least covered notice; null without one)."""
    sizes = F.create_map(*[F.lit(x) for k, t in templates.items() for x in (k, len(words_of(t)))])
    shares = F.transform("licenses", lambda s: F.floor(100 * s.matched / sizes[s.template]))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda s: s.template)))
    covered = F.aggregate("licenses", F.lit(0).cast("long"), lambda n, s: n + s.matched)
    return scan_licenses(docs, templates, rules).select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), covered.alias("covered_words"), F.array_min(shares).alias("min_coverage_pct"))
