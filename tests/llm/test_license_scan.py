import pathlib
import textwrap

import duckdb

from ledgerweave.llm import license_scan as ls

MIT = dict(ls.KNOWN[:1])["MIT"]


def sample():
    shouted = "Copyright (c) 2024 Someone, all rights reserved\n\n" + MIT.upper().replace(",", " ,").replace("\n", "\n\n  ")
    british = "(C) 1999 A. Nother\nISC Licence\n© 2000 B\n" + dict(ls.KNOWN[2:3])["ISC"]
    rows = [(1, MIT), (2, shouted), (3, british), (4, MIT + " and more"), (5, "Some text.\nReleased under the MIT Licence!\nlicensed under cc by-nc 4.0\nEnd"), (6, None), (7, ""), (8, "!!!\n\n"), (None, "Copyright 2020 X"), (9, "Copyright 2020 X\nReleased under the MIT License."), (1, MIT), (10, "é" * 50000 + "\n" + "x " * 50000)]
    return [(i, t, "c") for i, t in rows]


def test_equals_sql_and_finds_variants(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string").repartition(3)
    got = sorted((tuple(x) for x in ls.license_scan(df, ls.known_table(spark)).collect()), key=str)
    c = duckdb.connect()
    c.sql("create table documents(doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    # a repeated row gives one list for both
    assert got == sorted(c.sql(ls.SQL).fetchall(), key=str)
    by = {x[0]: x for x in got}
    assert [by[k][2] for k in (1, 2, 3, 4, 9)] == ["MIT", "MIT", "ISC", None, "MIT"]
    assert by[5][2:] == (None, ["CC-BY-NC-4.0", "MIT"]) and by[6][1] is None and by[8][1] is None and by[None][1] is None
    assert ls.license_scan(df.limit(0), ls.known_table(spark)).collect() == []
    assert all(x.license_id is None for x in ls.license_scan(df, ls.known_table(spark).limit(0)).collect())


def test_wrapped_and_whole_licences(spark):
    """Wrapped at any width, a licence keeps the lines that begin with "copyright" or "(c)" but are no notices."""
    isc, bsd = dict(ls.KNOWN[2:3])["ISC"], ls.KNOWN[-1][1]
    rows = [(k, "ISC", "Copyright (c) 2020 Jane Doe\n" + textwrap.fill(isc, w)) for k, w in enumerate((40, 60, 72, 80))]
    rows += [(10, "BSD-3-Clause", "Copyright 2021, X\n\n" + "\n".join(textwrap.fill(x, 62) for x in bsd.splitlines())), (11, "ISC", "Copyright Jane Doe\n" + isc), (12, None, "copyright notice and so on"), (13, None, isc.replace("copyright notice and ", ""))]
    system = pathlib.Path("/usr/share/common-licenses")
    for k, (name, file) in enumerate((("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0"))):
        if (system / file).exists():
            text = (system / file).read_text()
            rows += [(20 + k, name, text), (30 + k, name, "\n".join(textwrap.fill(x, 50) for x in text.upper().split("\n\n")) if name != "GPL-3.0" else text)]
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    assert {x.doc_id: x.license_id for x in ls.license_scan(df, ls.known_table(spark)).collect()} == {i: n for i, n, _ in rows}
