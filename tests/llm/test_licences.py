from __future__ import annotations

import textwrap

from tests.llm.helpers import edge, labels, nothing  # noqa: F401
from codeveritas.llm import licences


def test_same_licence_in_other_clothes(spark):
    mit = licences.KNOWN["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit), (2, mit.upper().replace(",", " ;")), (3, mit + "\nAll rights reserved."),
        (4, mit.replace("sublicense", "sublicence")), (5, mit[:-20]), (6, "prose\nReleased under the MIT License.\nmore"),
        (7, "© 2021 me\r\n" + mit.replace("\n", "\r\n")), (8, None), (9, ""), (10, "Copyright 2020 me"), (11, "..."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(df, licences.known_licences(spark)).collect()}
    assert {k for k, r in got.items() if r.licence == "MIT"} == {1, 2, 3, 4, 7}
    assert got[6].line_licences == ["MIT-notice"] and got[6].licence is None
    assert all(got[k].digest is None for k in (8, 9, 10, 11))
    own = spark.createDataFrame([("Mine", "all yours")], "licence string, text string")
    df = spark.createDataFrame([(1, "ALL, yours!")], "doc_id long, text string")
    assert licences.scan_licences(df, licences.known_licences(spark, own)).first().licence == "Mine"


def test_line_widths_titles_and_holders(spark):
    titles = {
        "MIT": "MIT License", "ISC": "ISC License", "Zlib": "zlib License", "0BSD": "Zero-Clause BSD License",
        "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "MPL-2.0": "",
    }
    rows, want = [], {}
    for name, text in sorted(licences.KNOWN.items()):
        if "notice" in name:
            continue
        parts = text.split("\n\n")
        # Titles and copyright statements of the licence texts themselves keep their lines.
        n_top = next(k for k, p in enumerate(parts) if len(p.split()) > 12)
        kept = [k < n_top or "copyright (c)" in p.lower() for k, p in enumerate(parts)]
        for width in (30, 47, 60, 72, 80, 100, 1000):
            body = "\n\n".join(p if k else textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False)
                                for p, k in zip(parts, kept))
            holder = "Copyright (c) 2020, 2021 Some One and\u00a0Others. All rights reserved.\n\n"
            for top in ("", holder, "Copyright Some One\nCopyright \u00a9 You\n\n", titles.get(name, "") + "\n\n" + holder):
                want[len(rows)] = name
                rows.append((len(rows), top + body))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan_licences(df, licences.known_licences(spark)).collect()}
    assert sorted({(want[k], got[k]) for k in want if got[k] != want[k]}, key=str) == []
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "Unlicense", "BSD-2-Clause", "BSD-3-Clause"} <= set(got.values())


def test_edge_cases(spark, edge, nothing):
    known = licences.known_licences(spark)
    assert licences.scan_licences(edge, known).count() == edge.count()
    assert licences.scan_licences(nothing, known).count() == 0
    plan = licences.scan_licences(edge, known)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
