"""License scans by patience alignment.

Method: anchors are the words unique to both text and template; the longest
increasing subsequence of their places is aligned, and the gaps between its
anchors are aligned in the same way, each with the words unique inside it. A
template's coverage is the share of its words that end up aligned.

Compared are stretches of a text, since the words of a long text would not be
unique in it: around each word that tells of a template a narrow and a wide
window of words where the template would lie, whatever the line breaks, and each
line (and two or three on end), for notices with much text in between. Of
matches that share words the best one stays.

A window is aligned only if it holds enough of the template's words to reach the
coverage asked for; alignment cannot use words that are not there, so nothing is
lost by that.

Defined results: a null or empty text has no matches and the label ``none``; on
equal coverage the more specific (longer) template wins, then the first by name;
repeated rows give repeated results.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import whole_text

# Public wordings of common licenses and notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-named": "Licensed under the BSD License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved. No part of this publication may be reproduced without written permission.",
}

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


@dataclass(frozen=True)
class Scan:
    """Parameters: least coverage in percent, and how many lines on end may hold a notice."""

    percent: int = 80
    lines: int = 3


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with rising second members of pairs in order of the first (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect.bisect_left(tops, b)
        before[i] = last[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(b)
            last.append(i)
        else:
            tops[pile], last[pile] = b, i
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal words: equal ends, then unique anchors, then the gaps between them in the same way."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = rising([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False) if x + 1 < u and y + 1 < v]
    return sorted(out)


class Templates:
    """The templates' words, and which templates a line's words can reach."""

    def __init__(self, templates: dict[str, str], scan: Scan) -> None:
        self.scan = scan
        self.words = {k: words_of(v) for k, v in templates.items()}
        self.bags = {k: Counter(v) for k, v in self.words.items()}
        self.vocabulary = {w for v in self.words.values() for w in v}
        # A word from the rarest of each template: enough words must be there, so of any `missing + 1` words one must.
        self.telling: set[str] = set()
        self.places: dict[str, list[tuple[str, int]]] = {}
        common = Counter(w for v in self.bags.values() for w in v)
        for k, bag in self.bags.items():
            n = len(self.words[k])
            spare = n - -(-n * scan.percent // 100)
            for w in sorted(bag, key=lambda x: (common[x], -len(x), x)):
                self.telling.add(w)
                self.places.setdefault(w, []).extend((k, j) for j, x in enumerate(self.words[k]) if x == w)
                spare -= bag[w]
                if spare < 0:
                    break
        self.quick = re.compile("|".join(map(re.escape, sorted(self.telling))))

    def matches(self, text: str) -> list[tuple[str, int, int, int]]:
        """(template, first line, last line, coverage in percent) of the best match of each run of words."""
        lines = text.lower().split("\n")
        hit = [i for i, line in enumerate(lines) if self.quick.search(line)]
        if not hit:
            return []
        words: list[str] = []
        line_of: list[int] = []
        begins = [0]  # each line's first word
        for i, line in enumerate(lines):
            words += _WORD.findall(line)
            line_of += [i] * (len(words) - len(line_of))
            begins.append(len(words))
        windows: dict[tuple[int, int], set[str]] = {}
        for line in hit:
            for i in range(begins[line], begins[line + 1]):
                for k, j in self.places.get(words[i], ()):
                    n = len(self.words[k])
                    for slack in (n // 4 + 1, 2 * n):
                        windows.setdefault((max(0, i - j - slack), min(len(words), i - j + n + slack)), set()).add(k)
            for start in range(max(0, line - self.scan.lines + 1), line + 1):
                for stop in range(start + 1, min(start + self.scan.lines, len(lines)) + 1):
                    windows[begins[start], begins[stop]] = set(self.bags)
        found = []
        for (a, b), names in windows.items():
            have = Counter(w for w in words[a:b] if w in self.vocabulary)
            for k in names:
                n = len(self.words[k])
                if 100 * sum(min(c, have[w]) for w, c in self.bags[k].items() if w in have) < self.scan.percent * n:
                    continue
                pairs = aligned(words[a:b], self.words[k])
                if 100 * len(pairs) // n >= self.scan.percent:
                    found.append((k, a + pairs[0][0], a + pairs[-1][0], 100 * len(pairs) // n))
        # The best match of each place: most coverage, longest template, fewest words, first name.
        found.sort(key=lambda m: (-m[3], -len(self.words[m[0]]), m[2] - m[1], m[0], m[1]))
        taken: set[int] = set()
        out = []
        for m in found:
            span = range(m[1], m[2] + 1)
            if taken.isdisjoint(span):
                taken.update(span)
                out.append(m)
        return [(k, line_of[a], line_of[b], share) for k, a, b, share in sorted(out, key=lambda m: m[1])]


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, scan: Scan = Scan(), text: str = "text", into: str = "licenses") -> DataFrame:  # noqa: B008
    """``documents`` with an array of (license, first_line, last_line, coverage) per whole text."""
    chosen = TEMPLATES if templates is None else templates

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = Templates(chosen, scan)
        for texts in batches:
            yield pd.Series([t.matches(x) for x in texts])

    run = F.pandas_udf(rows, "array<struct<license:string,first_line:int,last_line:int,coverage:int>>")
    return documents.withColumn(into, run(whole_text(text)))


def license_report(documents: DataFrame, id_col: str = "doc_id", scan: Scan = Scan()) -> DataFrame:  # noqa: B008
    """Per row: id, n_licenses, the best one (or ``none``), its coverage and all as name:first-last:coverage."""
    best = F.array_max(F.transform("found", lambda m: F.struct(m["coverage"].alias("c"), (-m["first_line"]).alias("f"), m["license"].alias("l"))))
    said = F.transform("found", lambda m: F.concat(m["license"], F.lit(":"), m["first_line"], F.lit("-"), m["last_line"], F.lit(":"), m["coverage"]))
    return scan_licenses(documents.select(id_col, "text"), scan=scan, into="found").select(
        id_col,
        F.size("found").cast("long").alias("n_licenses"),
        F.coalesce(best["l"], F.lit("none")).alias("license"),
        F.coalesce(best["c"], F.lit(0)).cast("long").alias("coverage"),
        F.concat_ws(",", said).alias("matches"),
    )
