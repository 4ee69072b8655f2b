"""Edge cases of skill checks, settings, extraction and the player."""

import random
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from storylake.functions import text as tx
from storylake.operators import config, extraction, html, player, scripts, skills
from storylake.sources import nested
from storylake.sources.library import left_to_read, open_library, upserted, write_checkpoints, write_volumes
from storylake.sources.settings import csv_cells, yaml_entries


def one(spark, value, kind, build):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first().y


def test_noise_at_both_ends_only(spark):
    lines = ["Người đăng: a", "text", "b.com", "more", "c.net"]
    assert one(spark, lines, "array<string>", extraction.trimmed) == ["text", "b.com", "more"]
    assert one(spark, ["x.com"], "array<string>", extraction.trimmed) == [] and one(spark, [], "array<string>", extraction.trimmed) == []
    assert one(spark, ["Chương 3: a", "b"], "array<string>", extraction.headless) == ["b"] and one(spark, [], "array<string>", extraction.headless) == []


def test_white_space_of_any_kind_is_stripped_and_joined(spark):
    assert one(spark, "　 a \n\t b  c ﻿", "string", tx.single_spaced) == "a b c"
    assert one(spark, "", "string", tx.sentences) == [] and one(spark, "...", "string", tx.sentences) == ["..."]
    assert one(spark, "a😀", "string", tx.utf16_length) == 3


def test_arguments(spark):
    good = one(spark, ["a=1", "b=x=y", "a=2"], "array<string>", config.arguments)
    assert good.ok and good.settings == {"a": "2", "b": "x=y"}
    assert not one(spark, ["a=1", "=x"], "array<string>", config.arguments).ok and not one(spark, ["none"], "array<string>", config.arguments).ok


def test_csv_cells(spark):
    assert one(spark, 'a,"b, ""c""",,d', "string", csv_cells) == ["a", 'b, "c"', "", "d"] and one(spark, "", "string", csv_cells) == [""]


def test_player(spark):
    row = spark.range(1).select(
        player.back_target(F.lit(4), F.lit(5)).alias("same"), player.back_target(F.lit(0), F.lit(1)).alias("first"), player.forward_target(F.lit(9), F.lit(10)).alias("last"),
        player.fetched_ahead(F.lit(7), F.lit(10)).alias("ahead"), player.fetched_ahead(F.lit(9), F.lit(10)).alias("none"),
    ).first()
    assert tuple(row) == (4, 0, 9, [8, 9], [])


def test_skills_without_a_main_file_and_null_contents(spark):
    rows = [("a", "1-x.md", "hello"), ("b", "SKILL.md", None), ("c", "SKILL.md", "---\nname: good-one\ndescription: Use when tested\n---\n## Overview\n## On Activation\n")]
    files = spark.createDataFrame(rows, "skill string, path string, content string")
    found = skills.integrity(files).collect()
    assert [(r.category, r.severity) for r in found if r.skill == "a"] == [("missing-file", "critical")]
    assert {r.detail for r in found if r.skill == "b"} == {"no front matter", "Overview", "On Activation"}
    assert {r.skill: r.status for r in skills.summary(files, skills.integrity(files)).collect()} == {"a": "fail", "b": "fail", "c": "pass"}
    assert skills.integrity(files.limit(0)).count() == 0


def test_checkpoints_and_volumes(spark, tmp_path):
    schema = "story string, seq int, next_url string, next_index int"
    old, new = spark.createDataFrame([("a", 1, "/1", 1), ("b", 1, "/1", 1)], schema), spark.createDataFrame([("a", 2, None, 5), ("c", 1, "/2", 2)], schema)
    points = upserted(old, new, spark.createDataFrame([("b",)], "story string"), ["story"], "seq")
    assert {(r.story, r.seq) for r in points.collect()} == {("a", 2), ("c", 1)}
    chapters = spark.createDataFrame([(s, i) for s in "ac" for i in range(4)], "story string, index int")
    assert sorted(map(tuple, left_to_read(chapters, points, ["story"], "index", 2).collect())) == [("a", 0), ("a", 1), ("c", 2), ("c", 3)]
    volumes = spark.createDataFrame([("s é", "t+1 %2B", 1000, 1204, "é", ["p"])], "source string, slug string, volume int, index int, title string, paragraphs array<string>")
    base = str(tmp_path / "v")
    write_volumes(volumes, base)
    row = open_library(spark, base).chapters().first()
    assert (row.source, row.slug, row.vol_file, row.title, row["index"]) == ("s é", "t+1 %2B", "vol-1000-ch1205-1205.json", "é", 1204)
    at = spark.createDataFrame([("s", "a", "/1", 1, None), ("s", "b", None, 2, "B")], "source string, slug string, next_url string, next_index int, story_title string")
    write_checkpoints(at, at.limit(0), base)
    write_checkpoints(at.where("slug = 'a'").withColumn("next_index", F.lit(9)), at.where("slug = 'b'"), base)
    assert [tuple(r) for r in open_library(spark, base).progress().collect()] == [("s", "a", "/1", 9, None)]
    assert open_library(spark, str(tmp_path / "none")).progress().count() == 0


def test_facts_of_sources():
    facts = scripts.source_facts
    assert facts("self.input(3)\nx = 'call input() now'\n# input()\n\"\"\"\nimport os\n\"\"\"\n") == []
    assert facts("x = (") == facts("a\0") == facts("(" * 5_000) == facts("x = 'a") == [(1, "error", "syntax")]
    assert facts("import os.path, re as r\nfrom json import dumps\nif 1:\n  sys.exit(input(json.dumps(1)))\np = argparse.ArgumentParser()") == [
        (1, "import", "os.path"), (1, "import", "re"), (2, "import", "json"), (4, "call", "dumps"), (4, "call", "exit"), (4, "call", "input"), (5, "attribute", "ArgumentParser")
    ]
    assert facts("") == [] and facts("dumps(1); from . import x") == []


YAML = """---
# definition
code: abc   # short
"name": 'It: is # it'
empty:
variables:
  lang:
    prompt: "Which: one?"
    default: en
    options:
    - a
    - key: b
      text: |
        not: an entry
        - nor this
      deep:
        - - x
  out: {project-root}/o
list:
  - 1
  -
    k: v
last: ""
url: http://x/y#z
"""


def test_yaml_entries(spark):
    found = spark.createDataFrame([(YAML,), (None,), ("- a\n- b: c\n",)], "t string").select(yaml_entries(F.col("t")).alias("e")).collect()
    assert [tuple(e) for e in found[0].e] == [
        ("code", "abc"), ("name", "It: is # it"), ("variables.lang.prompt", "Which: one?"), ("variables.lang.default", "en"), ("variables.lang.options.0", "a"), ("variables.lang.options.1.key", "b"),
        ("variables.lang.options.1.deep.0", "- x"), ("variables.out", "{project-root}/o"), ("list.0", "1"), ("list.1.k", "v"), ("last", ""), ("url", "http://x/y#z"),
    ]
    assert found[1].e == [] and [tuple(e) for e in found[2].e] == [("0", "a"), ("1.b", "c")]


def test_titles_keep_references_without_a_semicolon(spark):
    page = "<title>x\n&amp &amp;lt;</title>\n<h1>a &amp;&amp;&amp</h1><article><p>b &amp c &lt; d</p></article>"
    got = html.page_fields(page, html.SITES["default"])
    assert got["title"] == "a &&&amp" and got["story_title"] == "x &amp &lt;" and got["paragraphs"] == ["b & c < d"]


def test_lines_keep_references_that_were_cut_off(spark):
    page = "<h1>&quotx; &ampquot;</h1><article><p>a = &quot</p><p>a = &quot;b&quot; &amp</p>&copy 1 &ampquot; &quotx; &#34 &#34;\n&amp;amp; &am</article>"
    got = html.page_fields(page, html.SITES["default"])
    assert got["title"] == "&quotx; &ampquot;" and got["paragraphs"] == ["a = &quot", 'a = "b" &', '&copy 1 &quot; &quotx; &#34 "', "&amp; &am"]


def test_pages_are_handed_on_in_small_batches(spark, monkeypatch):
    sizes = []
    real = pa.RecordBatch.from_pylist
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(1_000)), "html": ["<h1>t</h1><article>a\nb</article>"] * 999 + [None]})
    monkeypatch.setattr(html, "pa", SimpleNamespace(RecordBatch=SimpleNamespace(from_pylist=lambda rows, schema: sizes.append(len(rows)) or real(rows, schema=schema), from_arrays=pa.RecordBatch.from_arrays)))
    found = pa.Table.from_batches(list(html.parsed([pages], html.SITES["default"])))
    assert max(sizes) <= html.PARSED and found.column("page_id").to_pylist() == list(range(1_000)) and found.column("error").null_count == 999


def test_yaml_patterns_are_tried_once_a_line(spark):
    plan = spark.createDataFrame([(YAML,)], "t string").select(yaml_entries(F.col("t")).alias("e"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("regexp_extract(") <= 3


def test_yaml_rows_equal_the_fold(spark):
    pick = random.Random(7).choice
    parts = ("a", "b c", ":", ": ", " ", "  ", "- ", "-", "- - ", "#", " # x", '"', "'", '"q: r"', "'s # t'", "''", "[", "{x: 1}", ">", "|-", "---", "...", "\t", "\r", "\x85", "\u2028", "\xa0", "é", "a: 1", "- b: 2", "c:", "d: >", "'e': 'f'", "a:b")
    made = ["".join(pick(("", "", "  ", "    ", "\t")) + "".join(pick(parts) for _ in range(pick((0, 1, 2, 3, 5)))) + pick(("\n", "\n", "\r\n", "\n\n", "\n    ")) for _ in range(pick(range(14)))) for _ in range(2_000)]
    texts = spark.createDataFrame(list(enumerate([YAML, None, "", "- a\n- b: c\n", *made])), "id long, t string")
    found = {}
    for r in nested.yaml_rows(texts, "id", "t").collect():
        found.setdefault(r.id, []).append((r.path, r.value))
    assert len(found) > 1_000
    for r in texts.select("id", "t", yaml_entries(F.col("t")).alias("e")).collect():
        assert found.get(r.id, []) == [tuple(e) for e in r.e], r.t


def test_yaml_rows_go_on_in_small_batches(monkeypatch):
    monkeypatch.setattr(nested, "BYTES", 20)
    texts = pa.RecordBatch.from_pydict({"id": list(range(9)), "t": ["a: 1\nb:\n- 2\n- 3\n"] * 4 + [None, "", "# no", "- |\n  x", "---"]})
    found = list(nested.entry_batches([texts, texts.slice(0, 0), texts.slice(4)], ["id", "path", "value"]))
    assert len(found) > 4 and pa.Table.from_batches(found).to_pylist() == [{"id": i, "path": p, "value": v} for i in range(4) for p, v in (("a", "1"), ("b.0", "2"), ("b.1", "3"))]


def test_yaml_rows_of_deep_and_long_texts():
    deep = "".join(f"{' ' * i}k{i}:\n" for i in range(200)) + f"{' ' * 200}- end\n"
    flat = "".join(f"- {i}\n" for i in range(5_000))
    block = "a: |\n" + "  b: |\n   c\n" * 2_000 + "d: 1\n"
    got = [x.to_pylist() for x in nested.entries(pa.array([1, 2, 3]), pa.array([deep, flat, block]))]
    assert list(zip(*got)) == [(1, ".".join(f"k{i}" for i in range(200)) + ".0", "end"), *((2, str(i), str(i)) for i in range(5_000)), (3, "d", "1")]
