"""Licence scans on a small tree of files, the prefix filter, edge cases (the query itself has SQL)."""

import duckdb

from storylake.llm import licence_scan as ls
from storylake.llm import registry

MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
FILES = [
    (1, "a/LICENSE", GPL), (2, "a/x.py", "import os\nprint(os)"), (3, "a/b/c/y.py", "code here"), (4, "a/b/z.py", f"first line of code\n# {MIT}\nmore code"),
    (5, "top.txt", "nothing"), (6, "ab/q.py", "not under a"), (7, None, MIT), (8, None, "text"), (9, "a/b/LICENSE", None), (10, "a/b/e.txt", ""), (4, "a/b/z.py", MIT),
    (11, "a/long.txt", "the of under license " * 30_000), (12, "a/d/w.py", "plain words of the kind"),
]


def scanned(spark, files=FILES, **options):
    frame = spark.createDataFrame([(*f, "x") for f in files], "file_id long, path string, text string, licence string")
    return ls.scan(frame, **options).collect()


def test_headers_files_and_inheritance(spark):
    rows = scanned(spark)
    got = {(r.file_id, r.line): (r.licence, r.origin, r.source_dir) for r in rows}
    assert len(rows) == len(FILES)
    assert got[1, 1] == ("GPL-3.0", "header", None)
    assert got[2, 0] == got[11, 0] == got[12, 0] == ("GPL-3.0", "inherited", "a")
    assert got[3, 0] == got[10, 0] == ("MIT", "inherited", "a/b")  # its z.py is a licence text as a whole
    assert got[4, 2] == got[4, 1] == ("MIT", "header", None)
    assert got[5, 0] == got[6, 0] == got[8, 0] == (None, "none", None)
    assert got[7, 1][:2] == ("MIT", "header")


def test_top_directory_reaches_everything(spark):
    rows = scanned(spark, [(1, "LICENSE", GPL), (2, "a/b/c", "x"), (3, "/abs/d", "y"), (4, None, "z")])
    assert {r.file_id: r.origin for r in rows} == {1: "header", 2: "inherited", 3: "inherited", 4: "none"}


def test_whole_file_over_several_lines(spark):
    rows = scanned(spark, [(1, "a/COPYING", MIT.replace(" ", "\n")), (2, "a/f", "code")])
    assert {r.file_id: (r.licence, r.origin) for r in rows} == {1: ("MIT", "file"), 2: ("MIT", "inherited")}


def test_prefix_filter_loses_nothing(spark, monkeypatch):
    few = sorted(map(str, scanned(spark)))
    with monkeypatch.context() as patch:
        patch.setattr(ls, "strong_terms", lambda vectors, threshold: sorted(r.term for r in vectors.select("term").distinct().collect()))
        assert sorted(map(str, scanned(spark))) == few
    monkeypatch.setattr(ls, "MAX_TERMS", 3)  # more strong terms than a plan holds
    assert sorted(map(str, scanned(spark))) == few


def test_empty_table_and_query_against_sql(spark):
    assert scanned(spark, []) == []
    none = scanned(spark, template_rows=ls.templates(spark).limit(0))
    assert {r.origin for r in none} == {"none"} and len(none) == len(FILES)
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = connection.sql(registry.ORACLES["op10_licence_scan"]).df()
    got = registry.op10_licence_scan(spark, folder).toPandas()[list(want.columns)]
    plain = lambda f: sorted(map(str, f.astype(object).where(f.notna(), None).values.tolist()))
    assert plain(got) == plain(want)
