from __future__ import annotations

import re

import corpus
import numpy as np
import pytest

from tidemark.llm import licenses, lines, nearest, secrets


def vectors(spark, n=700, d=8):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (n, d)).astype(np.float32)
    x[100:180] = x[100]  # a crowd of equal vectors
    data = [(i, [float(v) for v in x[i]]) for i in range(n)]
    data += [(n, None), (n + 1, []), (n + 2, [0.0] * d), (n + 3, [None] * d), (n + 4, [float("nan")] * d), (n + 5, [1.0] * 3), (None, [1.0] * d)]
    return x, spark.createDataFrame(data, "vec_id long, embedding array<float>")


def test_factor_one_is_exact(spark):
    x, frame = vectors(spark)
    got = nearest.nearest(frame, frame.where("vec_id % 20 = 0"), shard_rows=200, leaf=16).collect()
    y = x.astype(np.float64)
    for q in range(0, 700, 20):
        score = np.array([sum(a * b for a, b in zip(y[i], y[q], strict=True)) for i in range(700)])
        want = [int(i) for i in np.lexsort((np.arange(700), -score)) if i != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == want and [r["rank"] for r in mine] == list(range(1, 21))
        assert np.allclose([r.score for r in mine], score[want], rtol=0, atol=1e-12)
    assert {r.query_id for r in got} <= set(range(0, 720, 20))


def test_smaller_factor_keeps_recall(spark):
    _, frame = vectors(spark)
    exact, relaxed = ({(r.query_id, r.vec_id) for r in nearest.nearest(frame, frame.where("vec_id % 20 = 0"), factor=f, leaf=16).collect()} for f in (1.0, 0.8))
    assert len(exact & relaxed) >= 0.9 * len(exact)
    assert nearest.nearest(frame.limit(0), frame).count() == 0 and nearest.nearest(frame, frame.limit(0)).count() == 0


def test_licence_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
    mit += "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
    mit += "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
    mit += "included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    mit += "WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    data = [(1, mit), (2, "no stop here\nReleased under the MIT License.\nmore"), (3, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."), (4, "We all like a licence."), (5, None), (5, None)]
    got = {r.doc_id: r.licences for r in licenses.licence_scan(corpus.simple(spark, data)).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["Apache-2.0"], 4: [], 5: []}
    assert licenses.licence_scan(corpus.documents(spark)).count() == len(corpus.rows()) and licenses.licence_scan(corpus.documents(spark, [])).count() == 0


GPL = """    This program is free software{0} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""


def test_verbatim_notices(spark):
    by = "Copyright (c) 2020 Some Name"
    texts = {
        "MIT": ["MIT License\n\n" + by + "\n\n" + MIT, by + "\n" + MIT, by + "\r\n\r\n" + MIT.replace("\n", "\r\n")],
        "ISC": [by + "\n\n" + ISC, "ISC License\n" + by + "\n" + ISC],
        "BSD-2-Clause": [by + "\n\n" + BSD, by + "\nAll rights reserved.\n\n" + BSD],
        "BSD-3-Clause": [by + "\n\n" + BSD + ENDORSE, "".join(f" * {x}\n" for x in (by + "\n\n" + BSD + ENDORSE).split("\n"))],
        "GPL-3.0-or-later": [by + "\n\n" + GPL.format(":"), by + "\n" + GPL.format(";")],
        "MPL-2.0": [MPL, "words before\n" + MPL],
    }
    data = [(n, k, t) for n, (k, t) in enumerate((k, t) for k, many in texts.items() for t in many)]
    # both readings in one text, and a known sentence inside of another one
    data += [(100, "Apache-2.0 MIT", "Released under the MIT License\nmore words\nLicensed under the Apache License,\nVersion 2.0."), (101, "", "It is not released under the MIT license of ours.")]
    got = {r.doc_id: r.licences for r in licenses.licence_scan(corpus.simple(spark, [(n, t) for n, _, t in data])).collect()}
    assert got == {n: k.split() for n, k, _ in data}


def test_licence_tables():
    names = [s for _, run in licenses.RULES for s in run]
    assert set(names) == set(licenses.SENTENCES)
    for texts in licenses.SENTENCES.values():
        for t in texts:
            assert re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", t) and any(h in t for h in licenses.HINTS)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("crowd", [False, True])
def test_lines_equal_brute_force(spark, crowd):
    rng = np.random.default_rng(8)
    bases = ["".join(rng.choice(list("abcdé "), rng.integers(15, 60))) for _ in range(40)]
    data, at = [], 0
    for i in range(60):
        text = []
        for _ in range(6):
            s = bases[int(rng.integers(len(bases)))] if not crowd else "the very same beginning of a line, number "
            k = int(rng.integers(len(s)))
            s = [s, s[:k] + "x" + s[k:], s[:k] + s[k + 1 :], s[:k] + "y" + s[k + 1 :], s + str(at)][int(rng.integers(5))]
            at += 1
            text.append(s)
        data.append((i, "\n".join([*text, "", " "])))
    seen, verdict, first = {}, {}, {}
    for i, t in data:
        for n, s in enumerate(t.split("\n")):
            if not s.strip():
                verdict[i, n] = "blank"
            elif s in first:
                verdict[i, n] = "equal"
            else:
                first[s] = (i, n)
                near = len(s) >= lines.LEAST_CHARS and any(len(o) >= lines.LEAST_CHARS and within_one(o, s) for o in seen)
                verdict[i, n] = "near" if near else "kept"
                seen[s] = True
    got = {(r.doc_id, r.line_no): r.verdict for r in lines.line_dedup(corpus.simple(spark, data)).collect()}
    assert got == verdict


def test_line_edges(spark):
    got = lines.line_report(corpus.documents(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert by[14].dropped_lines == "1,3" and by[14].n_near == 1 and by[4].n_lines == 1
    assert by[8].n_lines == 1 and by[9].n_near == 0
    assert lines.line_report(corpus.documents(spark, [])).count() == 0


def secret_corpus():
    rng = np.random.default_rng(12)
    data = []
    for i in range(150):
        value = "".join(rng.choice(list("0123456789abcdef"), 40))
        # the harmless ones look like the others but stand beside other words
        text = [f'words here token = "{value}" and more', f"seen in commit {value} of the day", f"card 4929963689861{i:03d} was used", "nothing to see"][i % 4]
        data.append((i, f"plain words before. {text}\nplain words behind"))
    return data


def test_candidates_are_those_of_the_pattern(spark):
    data = [*secret_corpus(), (900, None), (901, ""), (902, "a" * 50), (903, "x" * 15 + "1"), (904, "A1" * 30 + "," + "B2" * 20)]
    got = {(r.doc_id, r.place, r.nth, r.value) for r in secrets.candidates(corpus.simple(spark, data)).collect()}
    want = set()
    for i, t in data:
        for n, token in enumerate(re.split(r"[\x09-\x0D\x20]+", t or "")):
            want |= {(i, n, k, v) for k, v in enumerate(re.findall(secrets.CANDIDATE, token)) if re.search("[0-9]", v)}
    assert got == want


def test_forest_on_reviewed_findings(spark):
    data = secret_corpus()
    docs = corpus.simple(spark, data)
    found = secrets.candidates(docs).select("doc_id", "place", "nth").collect()
    reviewed = spark.createDataFrame([(r.doc_id, r.place, r.nth, int(r.doc_id % 4 == 0)) for r in found if r.doc_id % 3], "doc_id long, place int, nth int, label int")
    got = secrets.secret_scan(docs, reviewed).collect()
    held = [r for r in got if r.doc_id % 3 == 0]
    assert len(held) > 20 and all(r.secret == (r.doc_id % 4 == 0) for r in held)


def test_secret_edges(spark):
    got = secrets.secret_scan(corpus.documents(spark)).collect()
    assert all(r.secret and r.score == 1.0 for r in got)
    assert secrets.secret_scan(corpus.documents(spark, [])).count() == 0


def test_unquoted_short_and_bare_secrets(spark):
    rng = np.random.default_rng(21)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    every = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    forms = {
        "unquoted": lambda: f"API_KEY={pick(every, 24)}", "env": lambda: f"export DB_PASSWORD={pick(every, 14)}", "short": lambda: f"password: {pick(every, 4)}!{pick(every, 5)}",
        "letters": lambda: f"secret = '{pick(every[:48], 20)}'", "header": lambda: f"Authorization: Bearer {pick(every, 32)}", "cloud": lambda: f"see AKIA{pick('ABCDEFGHIJ234567', 16)} here",
        "repository": lambda: f"ghp_{pick(every, 36)}", "address": lambda: f"postgres://user:{pick(every, 6)}@host/db", "quoted": lambda: f'token = "{pick("0123456789abcdef", 40)}"',
        "commit": lambda: f"seen in commit {pick('0123456789abcdef', 40)} of the day",
    }
    data, kind = [], {}
    for i in range(300):
        k = list(forms)[i % len(forms)]
        kind[i] = k
        data.append((i, f"plain words before\n{forms[k]()}\nplain words behind"))
    got = {r.doc_id for r in secrets.secret_scan(corpus.simple(spark, data)).where("secret").collect()}
    recall = {k: sum(i in got for i in kind if kind[i] == k) / 30 for k in forms}
    print(recall)
    assert all(v >= 0.9 for k, v in recall.items() if k != "commit") and recall["commit"] <= 0.1


def test_repeated_query_ids_are_asked_once(spark):
    import numpy as np

    from tidemark.llm import nearest as near

    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(20, rng.normal(size=6).tolist()) for _ in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in near.nearest(df, df.where("vec_id % 20 = 0"), k=5, shard_rows=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 300, 20):
        vector = min(v for i, v in rows if i == q)
        want = sorted(((-float(np.dot(vector, v)), i) for i, v in rows if i != q))[:5]
        assert [v for _, v in sorted(got[q])] == [i for _, i in want]
