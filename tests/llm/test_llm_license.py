"""Licences of small file trees."""

import corpus
from wirelens.llm import license

MIT = "Released under the MIT License."
APACHE = "Licensed under the Apache License, Version 2.0."


def scan(spark, rows):
    files = spark.createDataFrame([(i, p, t, "x", "y") for i, (p, t) in enumerate(rows)], "key long, path string, text string, own string, dir string")
    return {r["key"]: (r["licence"], r["origin"], r["from_dir"]) for r in license.scan(files).collect()}


def test_headers_files_and_nearest_ancestor(spark):
    got = scan(spark, [
        ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                      "documentation files (the \"Software\"), to deal in the Software without restriction"),
        ("a/b/x.txt", "nothing here"), ("a/b/c/COPYING", APACHE), ("a/b/c/d/y.txt", "text"), ("a/b/c/d/z.txt", f"# head\n{MIT}\nbody"),
        ("q/w.txt", "a permission to enter"), ("w.txt", "x"), (None, APACHE), ("a/b/n.txt", None), ("a/b/e.txt", "")])
    assert got == {
        0: ("MIT", "file", None), 1: ("MIT", "inherited", "a"), 2: ("Apache-2.0", "file", None), 3: ("Apache-2.0", "inherited", "a/b/c"),
        4: ("MIT", "header", None), 5: (None, "none", None), 6: (None, "none", None), 7: ("Apache-2.0", "header", None),
        8: ("MIT", "inherited", "a"), 9: ("MIT", "inherited", "a")}


def test_root_licence_and_ties(spark):
    got = scan(spark, [("LICENSE.b", MIT), ("LICENSE.a", APACHE), ("x.txt", "x"), ("d/e/x.txt", "x"), ("d/e/x.txt", "x")])
    assert got[2] == ("Apache-2.0", "inherited", "") and got[3] == got[4] == ("Apache-2.0", "inherited", "")


def test_close_names_are_told_apart(spark):
    rows = [(f"f{i}.txt", text) for i, (_, text) in enumerate(license.TEMPLATES)]
    assert [v[0] for _, v in sorted(scan(spark, rows).items())] == [name for name, _ in license.TEMPLATES]


def test_headers_that_are_no_templates(spark):
    gnu = ("{} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the "
           "Free Software Foundation; either version {} of the License, or (at your option) any later version.")
    isc = ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the "
           "above copyright notice and this permission notice appear in all copies.")
    mpl = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
           "this file, You can obtain one at http://mozilla.org/MPL/2.0/.")
    first, second, third, end = (x.strip() for x in (license._CONDITIONS.split(" 2. ")[0], "2. " + license._CONDITIONS.split(" 2. ")[1], license._ENDORSEMENT, license._DISCLAIMER))
    cases = [("GPL-2.0", gnu.format("Foo", "", "2")), ("GPL-3.0", gnu.format("Foo", "", "3")), ("LGPL-2.1", gnu.format("This file", "Lesser ", "2.1")),
             ("LGPL-3.0", gnu.format("Bar", "Lesser ", "3")), ("AGPL-3.0", gnu.format("Bar", "Affero ", "3")), ("ISC", isc), ("MPL-2.0", mpl),
             ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later"), ("MIT", "# SPDX-License-Identifier: MIT"), ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
             ("Apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */"), ("GPL-2.0", "under the GNU General Public License version 2"), (None, "a licence to kill"),
             ("MIT", "Copyright (c) 2024 A. Person\n\nReleased under the MIT license")]
    names = [c[0] for c in cases] + ["BSD-2-Clause", "BSD-3-Clause"]
    rows = [(f"d{i}/x.c", text) for i, (_, text) in enumerate(cases)]
    rows += [(f"f{k}/LICENSE", "Copyright (c) 2020, A. Person\n\n" + "\n\n".join(parts)) for k, parts in enumerate(([first, second, end], [first, second, third, end]))]
    assert [v[0] for _, v in sorted(scan(spark, rows).items())] == names


def test_documents_as_files(spark):
    docs = corpus.frame(spark, [*corpus.edges(), (120, f"{MIT}\nbody"), (130, "plain")])
    got = {r["key"]: r["origin"] for r in license.scan(license.corpus_files(docs)).collect()}
    assert got[120] == "file" and got[130] == "inherited" and got[1] == "none" and len(got) == 12
    assert license.scan(license.corpus_files(corpus.frame(spark, []))).count() == 0
