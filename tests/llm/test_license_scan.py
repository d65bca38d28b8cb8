import math
import re
import time
from collections import Counter

import duckdb
import pytest

from pitengine.llm import license_scan as S


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[a-z0-9]+(?:[.][a-z0-9]+)*", low)


def plain(files):
    """own licence and cosine of each text, every window held against every template, and the number of the template's terms."""
    docs = [terms(t) for _, t in files]
    seen = Counter(t for d in docs for t in set(d))
    idf = lambda t: math.log((1.0 + len(files)) / (1 + seen[t])) + 1
    top = math.log(1.0 + len(files)) + 1
    vectors = []
    for name, x in S.TEMPLATES:
        own = terms(x)
        v = {t: n * idf(t) for t, n in Counter(own).items()}
        size = math.sqrt(sum(y * y for y in v.values()))
        vectors.append((name, len(own), {t: y / size for t, y in v.items()}))
    out = []
    for d in docs:
        best = None
        for name, n, u in vectors:
            if sum(u[t] ** 2 for t in set(d) if t in u) < S.THRESHOLD**2 - 1e-6:
                continue
            for at in range(0, len(d), max(1, n // 8)):
                window = Counter(d[at : at + n])
                dot = sum(k * idf(t) * u[t] for t, k in window.items() if t in u)
                squares = sum((k * idf(t)) ** 2 if t in u else k * top**2 for t, k in window.items())
                cos = round(dot / math.sqrt(squares), 6)
                if cos >= S.THRESHOLD and (best is None or (-cos, name, -n) < best):
                    best = (-cos, name, -n)
        out.append(best)
    return out


def inherited(files):
    """Rows (path, license, how, score, is_license_file, license_dir) by walking up from each file."""
    own, given, out = plain(files), {}, []
    folder = lambda p: None if p is None else p.rsplit("/", 1)[0] if "/" in p else ""
    is_file = [bool(b and p is not None and re.match(S.FILE_NAMES, p.rsplit("/", 1)[-1].lower()) or b and -2 * b[2] >= len(terms(t))) for (p, t), b in zip(files, own)]
    for (p, _), b, yes in zip(files, own, is_file):
        if yes and p is not None:
            given[folder(p)] = min(given.get(folder(p), b), b)
    for (p, _), b, yes in zip(files, own, is_file):
        up = folder(p)
        while not b and up is not None and up not in given:
            up = None if up == "" else up.rsplit("/", 1)[0] if "/" in up else ""
        if b:
            out.append((p, b[1], "own", -b[0], yes, folder(p)))
        elif up is not None:
            out.append((p, given[up][1], "inherited", -given[up][0], yes, up))
        else:
            out.append((p, None, "none", None, yes, None))
    return out


FILES = [
    ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"),
    ("a/b/c/x.py", "import os"),
    ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 2."),
    ("a/b/y.py", "# Licensed under the Apache License, Version 2.0 (the License);\n# You may not use this file except in compliance with the License.\n" + "code and more code " * 30),
    ("a/z.py", None),
    ("d/e/f.py", ""),
    ("d/e/f.py", ""),
    ("top.py", "nothing here"),
    (None, "Released under the MIT License."),
    (None, "text"),
    ("d/notes.txt", "Licensed under CC BY-NC 4.0." + " many other words stand in this file" * 20),
    ("g/1", "Licensed under CC BY-SA 4.0."),
    ("g/h/2", "the license of the version is under the terms of use. " * 30),
]


def test_matches_brute_force(spark, sf):
    docs = [(f"{r.source}/{r.doc_id}", r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for files in (FILES, docs):
        got = S.scan(spark.createDataFrame([(*f, "k", 1) for f in files], "path string, text string, dir string, n int")).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got), key=key) == sorted(inherited(files), key=key)


def test_sql_gives_the_same(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = S.query(spark, sf)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({S.ORACLE})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


GPL2 = """/*
 * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
"""


@pytest.mark.parametrize(
    "text, license",
    [
        (GPL2, "GPL-2.0"),
        (GPL2.replace("program", "library").replace("General", "Lesser General").replace("version 2", "version 2.1"), "LGPL-2.1"),
        ("#!/bin/sh\n# SPDX-License-Identifier: BSD-3-Clause\nset -e", "BSD-3-Clause"),
        ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        ("// SPDX-License-Identifier: SomethingElse-9", None),
        ("Our code is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("It is released under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("Pictures: licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("Pictures: licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("a song about licences, permission and free software, and nothing under any terms", None),
    ],
)
def test_usual_notices(spark, text, license):
    filler = [(f"p/{k}.txt", f"some other words {k} stand here and tell of the sea of the wind and of a license to sail " * 3) for k in range(30)]
    got = S.scan(spark.createDataFrame([("n/a.txt", "before it other words are said\n" + text + "\nand more words follow it"), *filler], "path string, text string")).where("path = 'n/a.txt'").first()
    assert got.license == license


def test_work_grows_with_the_length_of_a_line_only(spark):
    """A line of 20,000 words, template terms among them, without an end of a sentence."""
    import random

    rng = random.Random(3)
    some = sorted({t for _, x in S.TEMPLATES for t in terms(x)})
    line = " ".join(rng.choice(some) if k % 3 else f"word{rng.randrange(5000)}" for k in range(20_000))
    files = [("a/1", line + " Licensed under the MIT License"), ("a/2", line)]
    began = time.monotonic()
    got = {r.path: r.license for r in S.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/1"] == "MIT" and time.monotonic() - began < 120


def test_inheritance(spark):
    got = {}
    for r in S.scan(spark.createDataFrame(FILES, "path string, text string")).collect():
        got.setdefault(r.path, set()).add((r.how, r.license, r.license_dir))
    assert got["a/b/c/x.py"] == {("inherited", "GPL-2.0", "a/b")}
    assert got["a/b/y.py"] == {("own", "Apache-2.0", "a/b")}
    assert got["a/z.py"] == {("inherited", "MIT", "a")}
    assert got["d/e/f.py"] == {("none", None, None)} == got["top.py"]
    assert got["g/h/2"] == {("inherited", "CC-BY-SA-4.0", "g")}
    assert got[None] == {("own", "MIT", None), ("none", None, None)}


def test_top_directory_and_empty_table(spark):
    files = [("LICENSE", "Released under the MIT License."), ("x/y/z", "a")]
    rows = S.scan(spark.createDataFrame(files, "path string, text string")).collect()
    assert {(r.path, r.how, r.license_dir) for r in rows} == {("LICENSE", "own", ""), ("x/y/z", "inherited", "")}
    assert S.scan(spark.createDataFrame([], "path string, text string")).count() == 0
