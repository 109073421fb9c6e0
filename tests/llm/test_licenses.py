"""License scans: canonical forms, whole texts, lines and the odd inputs."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veriframe.llm import licenses


def scan(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, license string, line_no int")
    return [(r.doc_id, r.license, r.notices, r.n_notice_lines) for r in licenses.scan(docs).collect()]


def test_whole_texts_and_lines(spark):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    body = licenses.KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + body.upper().replace(" ", "\n")), (2, body + " and more"), (3, "some words\nreleased under  the MIT LICENCE!\nother"),
        (4, "Licensed under CC BY-NC 4.0."), (5, None), (6, ""), (7, "...\n!!\n"), (8, "Copyright 2001 all"),
        (9, "Released under the MIT License.\nLicensed under CC BY 4.0.\nReleased under the MIT license"), (None, "Licensed under CC BY 4.0."), (3, "x"), (3, "x"), (10, "word " * 50000),
    ]
    assert mit
    got = sorted(scan(spark, rows), key=str)
    want = [
        (1, "MIT", "", 0), (2, None, "", 0), (3, None, "MIT", 1), (4, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), (5, None, "", 0), (6, None, "", 0), (7, None, "", 0), (8, None, "", 0),
        (9, None, "CC-BY-4.0,MIT", 3), (None, "CC-BY-4.0", "CC-BY-4.0", 1), (3, None, "", 0), (3, None, "", 0), (10, None, "", 0),
    ]
    assert got == sorted(want, key=str)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_own_table(spark):
    known = spark.createDataFrame([("House", "You may look."), ("House", "you MAY, look"), (None, "x"), ("Y", None)], "license string, text string")
    docs = spark.createDataFrame([(1, "you may look")], "doc_id long, text string")
    assert [tuple(r) for r in licenses.scan(docs, known).collect()] == [(1, "House", "House", 1, "")]


def test_canonical(spark):
    df = spark.createDataFrame([("The Licence, v2 -- Favour\n(c) 1999 Me\nCopyrights stay", )], "t string")
    assert df.select(licenses.canonical(F.col("t"))).first()[0] == "the license version 2 favor copyrights stay"


def test_wrapped_and_embedded(spark):
    header = next(t for i, t in licenses.KNOWN if i == "Apache-2.0" and "may not use" in t)
    words, lines = header.split(), []
    while words:
        lines.append("# " + " ".join(words[:9]))
        words = words[9:]
    wrapped = "# Copyright 2019 Somebody\n#\n" + "\n#\n".join(lines) + "\n\nimport os\n"
    mit = licenses.KNOWN[0][1].replace("conditions: The above", "conditions:\n\nThe above").replace("Software. THE SOFTWARE", "Software.\n  \nTHE\nSOFTWARE")
    docs = spark.createDataFrame([(1, wrapped), (2, "A tool.\n\n" + mit + "\n\n\nThe end."), (3, mit), (4, "A tool. " + mit)], "doc_id long, text string")
    assert sorted(tuple(r) for r in licenses.scan(docs).collect()) == [(1, None, "", 0, "Apache-2.0"), (2, None, "", 0, "MIT"), (3, "MIT", "", 0, "MIT"), (4, None, "", 0, "")]


def test_runs_have_no_most_blocks(spark):
    """A licence of five paragraphs, and a long one, inside a file."""
    bsd = licenses._BSD_START + "\n\n" + licenses._BSD_1 + "\n\n" + licenses._BSD_2 + "\n \n" + licenses._BSD_3 + "\n\n" + licenses._BSD_END
    words = licenses.KNOWN[0][1].split()
    every = "\n\n".join(words)  # a block for each word
    docs = spark.createDataFrame([(1, "A file.\n\n" + bsd + "\n\nThe end."), (2, bsd), (3, "x\n\n" + every + "\n\nmore"), (4, "\n\n".join(["this"] * 20_000) + "\n\n" + bsd), (5, bsd.replace("Neither", "Either"))], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.embedded) for r in licenses.scan(docs).collect())
    assert got == [(1, None, "BSD-3-Clause"), (2, "BSD-3-Clause", "BSD-3-Clause"), (3, None, "MIT"), (4, None, "BSD-3-Clause"), (5, None, "")]


def test_texts_in_the_line_of_the_copyright(spark):
    mit = licenses.KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 Foo. " + mit), (2, "/* Copyright 1999-2020 J. R. Foo, Inc. All rights reserved. " + mit + " */"),
        (3, "(c) 2020 Foo. Copyright (C) 2021 by Bar. Released under the MIT License."), (4, "Copyright (c) 2020 Foo Ltd. and others\n" + mit),
        (5, "Copyright 2020 www.example.org, version 1.2. All rights reserved."), (6, "© 2020 Foo. Released under the MIT License."), (7, "Copyright is a right. Nothing else."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.license) for r in licenses.scan(docs).collect())
    assert got == [(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "MIT"), (5, None), (6, "MIT"), (7, None)]
    assert docs.filter("doc_id >= 5").select(licenses.canonical(F.col("text"))).collect()[2][0] == "copyright is a right nothing else"


def test_running_sums(spark):
    rows = [(list(range(n)),) for n in (0, 1, 2, 3, 64, 1000)]
    for r in spark.createDataFrame(rows, "x array<int>").select("x", licenses._running(F.col("x")).alias("s")).collect():
        assert r.s == [sum(r.x[: k + 1]) for k in range(len(r.x))]


# The names of licence texts in the folder of common licences of some systems.
FOLDER = {
    "Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0-Perl", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3",
}


def test_every_digest_of_a_long_text(spark):
    """Digests, first words and lengths as the canonical form gives them now."""
    folder = Path("/usr/share/common-licenses")
    texts = [(i, (folder / name).read_text(encoding="utf-8")) for name, i in FOLDER.items() if (folder / name).exists()]
    if not texts:
        pytest.skip("no licence texts on this machine")
    known = {r.license: (r.digest, r.word, r.length) for r in licenses.known_digests(spark, spark.createDataFrame(texts, "license string, text string")).collect()}
    assert known == {i: (d, w, n) for i, d, w, n in licenses.KNOWN_DIGESTS if i in known} and len(known) == len(texts)


def test_long_texts(spark, tmp_path):
    place = Path("/usr/share/common-licenses/GPL-3")
    if not place.exists():
        pytest.skip("no licence text on this machine")
    text = place.read_text(encoding="utf-8")
    docs = spark.createDataFrame([(1, text.upper()), (2, text.replace("freedom", "liberty"))], "doc_id long, text string")
    assert sorted((r.doc_id, r.license) for r in licenses.scan(docs).collect()) == [(1, "GPL-3.0"), (2, None)]
