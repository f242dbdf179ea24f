from larch.llm import licences


def test_own_and_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "nothing here"), (3, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/y.py", "code\nLicensed under the Apache License, Version 2.0.\nmore code " * 1), (5, "z/x.py", None), (6, None, "text"), (7, "a/b/q.py", ""),
        (8, "top.py", "we hold a driving licence"), (9, "a/bb/x.py", "x"), (9, "a/bb/x.py", "x"),
    ]
    files = spark.createDataFrame(rows, "row long, path string, text string").withColumnRenamed("x", "x")
    got = {r["row"]: (r["licence"], r["how"], r["from_directory"]) for r in licences.licences(files).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("GPL-3.0", "own", None), 4: ("Apache-2.0", "own", None), 5: (None, None, None),
        6: (None, None, None), 7: ("GPL-3.0", "inherited", "a/b"), 8: (None, None, None), 9: ("MIT", "inherited", "a"),
    }
    assert licences.licences(files).count() == len(rows)


def test_documents(documents, nothing):
    assert licences.licences(licences.document_files(documents)).count() == documents.count()
    assert licences.licences(licences.document_files(nothing)).count() == 0


def test_every_template_is_its_own_best(spark):
    rows = [(k, f"d{k}/x", t) for k, (_, t) in enumerate(licences.TEMPLATES)]
    found = licences.own_licences(spark.createDataFrame(rows, "row long, path string, text string")).filter("not whole").collect()
    for r in found:
        assert r["licence"] == licences.TEMPLATES[r["row"]][0] and abs(r["cosine"] - 1) < 1e-9


def test_wrapped_and_spdx_headers_in_code(spark):
    code = "\n".join(f"x{i} = call_{i}(y{i}, z{i})  # step {i} of the work" for i in range(200))
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    narrow = "# Permission is hereby granted, free of\n# charge, to any person obtaining a copy\n# of this software and associated\n# documentation files."
    heads = [
        (1, mpl, "MPL-2.0"), (2, narrow, "MIT"), (3, "// SPDX-License-Identifier: MIT", "MIT"), (4, "<!-- SPDX-License-Identifier: Apache-2.0 -->", "Apache-2.0"),
        (5, "# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), (6, "# SPDX-License-Identifier: Unheard-Of-1.0", None), (7, "", None),
    ]
    files = spark.createDataFrame([(k, f"d{k}/x.py", h + "\n" + code) for k, h, _ in heads], "row long, path string, text string")
    got = {r["row"]: (r["own_licence"], r["how"]) for r in licences.licences(files).collect()}
    assert got == {k: (want, "own" if want else None) for k, _, want in heads}


def test_bound_loses_no_unit(spark, monkeypatch):
    import itertools

    words = sorted({w for _, t in licences.TEMPLATES for w in t.split()})
    texts = ["\n".join(" ".join([*words[(7 * i + j) % len(words) :][: 1 + j % 5], f"n{i}"]) for j in range(6)) for i in range(40)]
    texts += [a + "\n" + b for (_, a), (_, b) in itertools.islice(itertools.combinations(licences.TEMPLATES, 2), 30)]
    files = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    best = lambda: {(r["row"], r["whole"]): (r["licence"], r["cosine"]) for r in licences.own_licences(files).collect() if r["cosine"] >= (licences.FILE_COSINE if r["whole"] else licences.LINE_COSINE)}
    got, plain = best(), licences._units
    monkeypatch.setattr(licences, "_units", lambda idf, limits: plain(idf, (0.0, 0.0)))
    assert got == best() and len(got) > 30


def direct(rows):
    """path -> (own licence, its cosine, licence, how) by plain loops over all windows, texts and directories."""
    import math
    import re
    from collections import Counter

    lines = {path: licences._lines(text or "") for _, path, text in rows}
    df = Counter(w for x in lines.values() for line in x for w in set(line))
    bags = [(name, Counter(licences._words(text.lower()))) for name, text in licences.TEMPLATES]
    for _, bag in bags:
        df.update(set(bag))
    n = sum(map(len, lines.values())) + len(bags)
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
    norm = lambda bag: math.sqrt(sum((c * idf[w]) ** 2 for w, c in bag.items()))

    def best(units):
        top = {}
        for words in units:
            bag = Counter(words)
            for name, t in bags:
                cosine = round(sum(c * t[w] * idf[w] ** 2 for w, c in bag.items() if w in t) / (norm(bag) * norm(t)), 9)
                top[name] = max(top.get(name, 0.0), cosine)
        return min(((-c, name) for name, c in top.items()), default=(0.0, None))

    own, speaks, told = {}, {}, {}
    for path, x in lines.items():
        c, name = best([sum(x[i:j], []) for i in range(len(x)) for j in range(i + 1, min(i + licences.WINDOW, len(x)) + 1)])
        own[path] = (name, -c) if -c >= licences.LINE_COSINE else (None, None)
        c, whole = best([sum(x, [])] if x else [])
        named = re.search(licences.FILE_NAMES, path)
        if -c >= licences.FILE_COSINE or (named and (whole or own[path][0])):
            told[path] = whole if -c >= licences.FILE_COSINE else own[path][0] or whole
    for path in sorted(told):
        speaks.setdefault(path.rpartition("/")[0], told[path])
    out = {}
    for path in lines:
        name = own[path][0] or told.get(path)
        at, how = path.rpartition("/")[0], "own"
        while name is None and at is not None:
            name, how = speaks.get(at), "inherited"
            at = at.rpartition("/")[0] if at else None
        out[path] = (*own[path], name, how if name else None)
    return out


def test_against_plain_loops(spark):
    """Headers in code, wrapped ones, whole licence files, ties between templates, and files that inherit."""
    code = "import os\ndef f(x):\n    return x + 1\n"
    t = [text for _, text in licences.TEMPLATES]
    wrapped = "\n".join(t[9][i : i + 40] for i in range(0, len(t[9]), 40))
    rows = [
        (1, "a/LICENSE", t[11] + "\n" + t[10]), (2, "a/x.py", code), (3, "a/b/y.py", f"# {t[0]}\n{code}"), (4, "a/b/z.py", f"{code}{wrapped}\n{code}"), (5, "c/d/e/f.py", code), (6, "c/COPYING", t[12]), (7, "c/d/NOTICE", None),
        (8, "g.py", ""), (9, "h/SPDX.txt", "SPDX-License-Identifier: MIT"), (10, "h/i/j", "the licence of the house and this work"), (11, "k/l", t[4] + " " + t[6]), (12, "m", "This work is licensed under a licence\n" * 3 + code),
    ]
    table = spark.createDataFrame(rows, "row long, path string, text string")
    got = {r["path"]: (r["own_licence"], r["own_cosine"], r["licence"], r["how"]) for r in licences.licences(table).collect()}
    want = direct(rows)
    assert {p: (x[0], x[2], x[3]) for p, x in got.items()} == {p: (x[0], x[2], x[3]) for p, x in want.items()}
    assert all((x[1] is None) == (want[p][1] is None) and abs((x[1] or 0) - (want[p][1] or 0)) < 1e-8 for p, x in got.items())
    assert len({x[2] for x in want.values()}) >= 4 and "inherited" in {x[3] for x in want.values()}
