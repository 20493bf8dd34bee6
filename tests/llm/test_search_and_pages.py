"""Top-k against DuckDB, page extraction and licence rules by cases, minimum cuts by brute force."""

import itertools
import random
import textwrap

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertloom.llm import licences, pages, topk
from alertloom.llm.queries import OP8_SQL


def searched(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, rank int")
    vectors = table.select("vec_id", topk.whole(F.col("embedding")).alias("v"))
    return sorted(tuple(r) for r in topk.top_k(vectors.where("vec_id % 20 = 0"), vectors).collect())


def by_sql(rows):
    con = duckdb.connect()
    embeddings = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    con.register("embeddings", embeddings)
    return sorted(con.sql(OP8_SQL).fetchall())


def test_topk_matches_sql(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)], "", 0) for i in range(300)]
    rows += [(i, rows[40][1], "", 0) for i in range(300, 340)]  # ties
    rows += [(1000, None, "", 0), (1020, [None] + [1.0] * 7, "", 0), (1040, [float("nan")] * 8, "", 0), (1060, [float("inf")] + [0.0] * 7, "", 0)]
    rows += [(None, rows[0][1], "", 0), (1080, [0.0] * 8, "", 0), rows[20], (20_000, [1000.0] * 8, "", 0)]
    assert searched(spark, rows) == by_sql(rows)


def test_topk_with_few_rows_and_none(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(20, [1.0], "", 0)]) == []
    assert searched(spark, [(20, [1.0, 2.0], "", 0), (21, [1.0], "", 0)]) == [(20, 1, 21, 64 * 64)]  # short ones end in zeros


@pytest.mark.parametrize("scale", [1, 10**5, 3 * 10**7])
def test_bounds_keep_the_best_in_every_number_type(scale):
    rng = np.random.default_rng(scale % 97)
    x = rng.integers(-20, 20, (400, 6)) * scale
    q = rng.integers(-20, 20, (9, 6)) * scale
    ids = rng.permutation(400).astype(np.int64)
    a, b, score = topk.nra(q, x, ids, np.full(9, -1), 5)
    for i in range(9):
        full = q[i] @ x.T
        right = sorted(zip((-full).tolist(), ids.tolist(), strict=True))[:5]
        assert sorted((-s, ids[v]) for u, v, s in zip(a, b, score, strict=True) if u == i) == right


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randint(1, 8)
        z = [rng.choice([-2, -1, -0.5, 0, 0.5, 1, 2, 0.3]) for _ in range(n)]
        ties = [(a, b, rng.choice([0.2, 0.5, 1, 2])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda labels: sum(abs(v) for v, g in zip(z, labels, strict=True) if v and (v > 0) != g) + sum(w for a, b, w in ties if labels[a] != labels[b])  # noqa: E731, B023
        assert cost(pages.minimum_cut(z, ties)) == pytest.approx(min(cost(c) for c in itertools.product([False, True], repeat=n)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><a href="/x">Home</a></header>
<nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav><div class="side-bar"><p>Side text, long enough to look like prose.</p></div>
<div id="cookieNotice">We use cookies.</div><main><h1>Head &amp; line</h1><p>One <i>two</i>&nbsp;three &lt;b&gt;<br>four<ul><li>item a<li>item b</ul>
<table><tr><td>c1<td>c2</table><div class=advert>Buy!</div><!-- no --><p><b>End a < b<p>Last, &eacute;&#8364;.</p><section class="comments"><p>Nice
post!</p></section><form><p>Subscribe</p></form><textarea>zz</textarea></main><footer>&copy;</footer><script>var t="</p>";if(a<b){}</script></body></html>"""
TEXT = "Head & line\n\nOne two three <b> four\n\nitem a\n\nitem b\n\nc1\n\nc2\n\nEnd a < b\n\nLast, é€."


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "", "", "x"), (4, "u", "<p>unclosed <b", "x"), (5, "u", PAGE[: PAGE.index("Last, ") + 6], "x")]
    rows += [(None, "u", PAGE, "x"), (1, "u", PAGE, "x"), (6, "u", f"<article>{'<p>many words, in a row.</p>' * 5000}</article>", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in pages.main_text(table, pages.fit(table), ["page_id", "url"]).collect()}
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got.values())
    assert got[1].text == got[None].text == TEXT
    assert got[2].text == got[3].text == "" and got[5].text == TEXT[:-4]
    assert got[6].text == "\n\n".join(["many words, in a row."] * 5000)
    empty = table.where("false")
    assert pages.main_text(empty, pages.fit(empty), ["page_id"]).collect() == []


def test_unmarked_page():
    body = PAGE.replace("<main>", "<div>").replace("</main>", "</div>")
    prose = "This is a paragraph of some length, and it has a link to nowhere. " * 3
    found = pages.extract(body.replace("One <i>", prose + "<i>"), pages.PLAIN_SHAPE)
    assert prose.strip() in found[1] and not any("cookies" in t or "post" in t or "Side" in t for t in found)


STORY = ["A headline of the story", "The first paragraph of the story, which says, in some words, what it is about.", "It goes on here, and ends."]
INNER = f"<h1>{STORY[0]}</h1><p>{STORY[1]}</p><p>{STORY[2]}</p>"
AROUND = '<div class="sidebar"><p>Side text, long enough to look like prose.</p></div><div id="comments"><article class="comment-body"><p>Nice post, thank you.</p></article></div><footer>End</footer>'
WRAPPERS = """class="content-sidebar-wrap"|class="page-with-sidebar"|class="overflow-hidden"|id="page-no-menu"|class="row md:hidden-none overflow-x-hidden"|class="sidebar"
class="site sidebar-open"|class="layout-sidebar"|class="sidebar-page-container"|id="banner"|class="modal-overlay"|class="hidden-xs"|class='widget nav-wrap'"""


@pytest.mark.parametrize("wrapper", WRAPPERS.replace("\n", "|").split("|"))
def test_article_in_layout_wrappers(wrapper):
    for opened, closed in [("<main><article>", "</article></main>"), ("<article>", "</article>"), ("<div role=main>", "</div>")]:
        page = f"<body><nav><a href=a>A</a></nav><div {wrapper}>{opened}{INNER}{closed}</div>{AROUND}</body>"
        assert pages.extract(page, pages.PLAIN_SHAPE) == STORY, (wrapper, opened)


FILED = '''article class="post-12 post category-social-media"|article class="post category-legal tag-cookies"|article id="social-study"|article class="story--promo"
article class="hentry tag-newsletter format-standard"|div class="post category-newsletter"|section class="topic-advertising"'''.replace("\n", "|").split("|")


@pytest.mark.parametrize("opened", FILED)
def test_articles_filed_under_words_for_other_elements(opened):
    closed = opened.split()[0]
    for start, end in [("", ""), ("<main>", "</main>")]:
        page = f"<body><nav><a href=a>A</a></nav>{start}<{opened}>{INNER}</{closed}>{end}{AROUND}</body>"
        assert pages.extract(page, pages.PLAIN_SHAPE) == STORY, (opened, start)


def test_adverts_and_surroundings_of_an_article_stay_out():
    other = "<p>This is a longer text of another kind, with commas, and it ends like prose does.</p>"
    for name in ("post-comments", "post-footer", "story-related", "comments", "advert", "article-sidebar"):
        page = f"<body><main><article class=post>{INNER}<div class='{name}'>{other}</div></article></main></body>"
        assert pages.extract(page, pages.PLAIN_SHAPE) == STORY, name
    for name in ("promo", "post ad", "sponsored", "comment", "related-post"):
        page = f"<body><main><article>{INNER}</article><article class='{name}'>{other}</article></main></body>"
        assert pages.extract(page, pages.PLAIN_SHAPE) == STORY, name


def test_short_items_cells_and_formulas_are_text():
    lists = "<ul><li>Salt</li><li>Flour</li><li>Eggs</li></ul>"
    cells = "<table><tr><td>Salt</td><td>2 g</td></tr><tr><td>Eggs</td><td>3</td></tr></table>"
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>Contact us</a></li><li><a href=c>Imprint</a></li></ul>"
    found = pages.extract(f"<body><div>{menu}</div><div>{INNER}{lists}{INNER}{cells}</div><div>{menu}</div></body>", pages.PLAIN_SHAPE)
    assert found == [*STORY, "Salt", "Flour", "Eggs", *STORY, "Salt", "2 g", "Eggs", "3"]
    many = "".join(f"<li>thing {i}</li>" for i in range(500))
    assert len(pages.extract(f"<body><div>{INNER}<ol>{many}</ol></div></body>", pages.PLAIN_SHAPE)) == 503
    formula = "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=tex>x=1</annotation></math>"
    assert pages.extract(f"<body><article><p>Let {formula} be.</p></article></body>", pages.PLAIN_SHAPE) == ["Let x=1 be."]


def test_marked_elements_stay_out_of_the_text():
    side = "<p>This is a longer text of the side, with commas, and it ends like prose does.</p>"
    names = "sidebar sidebar-wrapper nav-wrap main-menu-container content-sidebar is-hidden comments-wrapper post-comments-wrap related-posts footer-content-wrap".split()
    for name in names:
        for inner in (side, f"<article>{side}</article>"):
            page = f"<body><main>{INNER}</main><div class='{name}'>{inner}</div></body>"
            assert pages.extract(page, pages.PLAIN_SHAPE) == STORY, (name, inner)
    hidden = f"<body><div class=a hidden><main>{INNER}</main></div><aside><article>{side}</article></aside></body>"
    assert pages.extract(hidden, pages.PLAIN_SHAPE) == []
    comments = f"<body><div>{INNER}</div><div id=comments><article>{side}</article></div></body>"
    assert not any("side" in t for t in pages.extract(comments, pages.PLAIN_SHAPE))


def test_licences(spark):
    rows = [
        (1, "x foo\nReleased under the MIT License.\nbar", "MIT", 1),
        (2, '/* Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n', "Apache-2.0", 1),
        (3, None, "", 0), (4, "", "", 0), (5, "A license is not a match.", "", 0),
        (6, "Licensed under CC BY-NC 4.0. Released under the MIT License!\n\nLicensed under CC BY-NC 4.0.", "MIT,CC-BY-NC-4.0", 3),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "MIT", 1),
        (8, "word " * 50000 + "\nReleased under the MIT License.", "MIT", 1),
    ]
    table = spark.createDataFrame([(i, t, "own", i) for i, t, _, _ in rows], "doc_id long, text string, licences string, n long")
    got = {r.doc_id: (",".join(r.licences), r.n_matches) for r in licences.recognised(table).collect()}
    assert got == {i: (names, n) for i, _, names, n in rows}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    assert {d: (names, n) for d, names, n in con.sql(licences.oracle_sql()).select("doc_id, licences, n_matches").fetchall()} == got
    assert licences.recognised(table.where("false")).collect() == []
    assert all(any(h in s for h in licences.HINTS) for s in licences.SENTENCES.values())


def scanned(spark, texts):
    """(licences, n_matches) of each text, after a comparison with DuckDB."""
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (",".join(r.licences), r.n_matches) for r in licences.recognised(table).collect()}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    assert {d: (names, n) for d, names, n in con.sql(licences.oracle_sql()).select("doc_id, licences, n_matches").fetchall()} == got
    return [got[i] for i in range(len(texts))]


def test_all_rights_reserved(spark):
    found = [
        "All rights reserved.", "word word.\nALL RIGHTS RESERVED\nword", "Copyright (c) 2019 Jane Doe. All rights reserved.",
        "Copyright 2001-2020, Example Inc., all rights reserved", "foo\n© 2011 Example GmbH | All Rights Reserved.\nbar",
        "# Copyright (C) 1999 by A. Person\n# All rights reserved.\nimport x", "This text may not be copied without written permission of the copyright holder.",
    ]
    none = ["Some rights reserved.", "All rights are reserved for later.", "Copyright 2020 by all authors.", "All seats reserved."]
    assert scanned(spark, found + none) == [("All-rights-reserved", 1)] * len(found) + [("", 0)] * len(none)


#: One text a rule of a single sentence, as such lines are written in files.
LINES = """MIT|Released under the MIT License.
MIT|Licensed under the MIT license
MIT|This project is licensed under the MIT License.
MIT|// SPDX-License-Identifier: MIT
Apache-2.0|Licensed under the Apache License, Version 2.0.
Apache-2.0|Licensed under the Apache License, Version 2.0 (the "License");
Apache-2.0|# SPDX-License-Identifier: Apache-2.0
GPL-3.0-or-later|SPDX-License-Identifier: GPL-3.0-or-later
GPL-3.0-only|This work is licensed under the GNU General Public License, version 3.
GPL-2.0-only|This work is licensed under the GNU General Public License, version 2.
GPL-2.0-only|/* SPDX-License-Identifier: GPL-2.0-only */
LGPL-3.0-only|This work is licensed under the GNU Lesser General Public License, version 3.
AGPL-3.0-only|This work is licensed under the GNU Affero General Public License, version 3.
BSD-3-Clause|SPDX-License-Identifier: BSD-3-Clause
BSD|Released under the BSD License.
MPL-2.0|This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
CC-BY-4.0|Licensed under CC BY 4.0.
CC-BY-4.0|This work is licensed under a Creative Commons Attribution 4.0 International License.
CC-BY-SA-4.0|Licensed under CC BY-SA 4.0.
CC-BY-NC-4.0|Licensed under CC BY-NC 4.0.
CC-BY-ND-4.0|Licensed under CC BY-ND 4.0.
CC-BY-NC-SA-4.0|Licensed under CC BY-NC-SA 4.0.
CC-BY-NC-ND-4.0|Licensed under CC BY-NC-ND 4.0.
CC0-1.0|This work is dedicated to the public domain.
Unlicense|This is free and unencumbered software released into the public domain."""


def test_licence_lines(spark):
    names, texts = zip(*[line.split("|") for line in LINES.splitlines()], strict=True)
    assert scanned(spark, [f"A first line\n{t}\n\nMore words." for t in texts]) == [(n, 1) for n in names]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
THIRD = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
LAST = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
GNU = """This SUBJECT is free software: you can redistribute it and/or modify it under the terms of the GNU KIND General Public License as published by the Free Software Foundation, either version NUMBER of the License, or (at your option) any later version.

This SUBJECT is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU KIND General Public License for more details.

You should have received a copy of the GNU KIND General Public License along with this SUBJECT."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
OWNER = "Copyright (c) 2019, Jane Doe\nAll rights reserved.\n\n"


def gnu(subject, kind, number):
    return GNU.replace("SUBJECT", subject).replace("KIND ", f"{kind} ".lstrip()).replace("NUMBER", number)


def layouts(text):
    """A text in several widths, as comments, and in one line."""
    parts = text.split("\n\n")
    for width in (40, 66, 72, 79, 1000):
        yield "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in parts)
    filled = "\n\n".join(textwrap.fill(p, 70) for p in parts)
    for sign in ("//", " *", "#"):
        yield "x = 1;\n\n" + "".join(f"{sign} {line}".rstrip() + "\n" for line in filled.split("\n"))
    yield " ".join(text.split())


def test_whole_licence_texts_in_several_wrappings(spark):
    texts = {
        APACHE: "Apache-2.0", APACHE.replace("http:", "https:"): "Apache-2.0", MIT: "MIT",
        BSD2 + LAST: "BSD-2-Clause", BSD2 + THIRD + LAST: "BSD-3-Clause", OWNER + BSD2 + THIRD + LAST: "BSD-3-Clause", OWNER + BSD2 + LAST: "BSD-2-Clause",
        BSD2 + THIRD.replace("the copyright holder", "Example Inc.") + LAST: "BSD-3-Clause",
        gnu("program", "", "3"): "GPL-3.0-or-later", gnu("program", "", "2"): "GPL-2.0-or-later", gnu("program", "Affero", "3"): "AGPL-3.0-or-later",
        gnu("library", "Lesser", "2.1"): "LGPL-2.1-or-later", gnu("program", "Lesser", "3"): "LGPL-3.0-or-later", gnu("library", "Lesser", "3"): "LGPL-3.0-or-later",
        gnu("library", "Library", "2"): "LGPL-2.0-or-later",
    }
    rows = [(name, way) for text, name in texts.items() for way in layouts(text)]
    for marks in ("(1) |(2) |(3) ", "a) |b) |c) ", "* |* |* ", "- |- |- "):
        listed = BSD2 + THIRD
        for old, new in zip(("1. ", "2. ", "3. "), marks.split("|"), strict=True):
            listed = listed.replace(old, new)
        rows += [("BSD-3-Clause", listed), ("BSD-3-Clause", listed.replace("\n\n", "\n"))]
    rows += [("Apache-2.0", APACHE[APACHE.index("Unless") :]), ("BSD", BSD2.split("\n\n")[0])]
    got = scanned(spark, [text for _, text in rows])
    assert [(name, text) for (name, text), found in zip(rows, got, strict=True) if found != (name, 1)] == []
