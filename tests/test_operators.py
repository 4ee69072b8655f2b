"""Operators on small fixtures: one expectation for each of the semantics that matter."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storylake.functions import text as tx
from storylake.operators import access, chunks, corpus, findings, graph, html, library, lines, merge, rulebook, templates, tracking, volumes
from storylake.sources import settings as conf
from storylake.sources.library import open_library, write_volumes


def column(spark, values, kind, expression):
    frame = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r.o for r in frame.select(expression(F.col("v")).alias("o")).collect()]


# --- text and chunks -------------------------------------------------------

WHITE = "\\s\u0085\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def model_chunks(paragraphs):
    """Chunk packing straight from its rules."""
    strip = lambda s: re.sub(f"^[{WHITE}]+|[{WHITE}]+$", "", s)
    size = lambda s: len(s.encode("utf-16-be")) // 2
    out, text, start, end = [], "", -1, -1
    for p, paragraph in enumerate(paragraphs):
        normal = strip(re.sub(f"[{WHITE}]+", " ", paragraph))
        found = [x for x in (strip(m) for m in re.findall(r"[^.!?]+(?:[.!?]+[\"')\]]*|$)", normal)) if x] or ([normal] if normal else [])
        for sentence in found:
            gap = "" if not text else " " if p == end else "\n\n"
            if text and size(text + gap + sentence) > chunks.MAX_CHARS and size(text) >= chunks.MIN_CHARS:
                out.append((text, start, end))
                text = ""
            if not text:
                start, gap = p, ""
            text, end = text + gap + sentence, p
    return [*out, (text, start, end)] if text else out


def test_chunks_equal_the_model(spark):
    long = "A sentence of some words here. " * 60
    cases = [[], ["one.", "two.", "three", "four!"], [long, "x", long], ["", " \u00a0 ", "a", "", "b"], ["..."], ['He said "no." Then (yes!) he left. 3.14 too'], ["😀" * 500 + ". " + "b" * 1200], ["w" * 3000, "tail."]]
    got = column(spark, cases, "array<string>", chunks.chunks)
    assert [[tuple(c) for c in g] for g in got] == [model_chunks(c) for c in cases]


def test_chunks_of_documents_equal_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", chunks.chunks(F.split("text", "\n")).alias("c")).collect()
    for r in docs:
        assert [tuple(c) for c in r.c] == model_chunks(r.text.split("\n"))


def test_paragraph_to_chunk(spark):
    frame = spark.createDataFrame([(["a.", "b.", "c."],)], "p array<string>").select(chunks.chunks(F.col("p")).alias("c"))
    assert frame.select(*(chunks.chunk_of(F.col("c"), F.lit(p)).alias(f"x{p}") for p in (0, 1, 99))).first() == (0, 0, -1)


def test_text_helpers(spark):
    assert column(spark, [" a\t\u00a0", "\u3000b\ufeff"], "string", tx.strip_white) == ["a", "b"]
    assert column(spark, ["a😀"], "string", tx.utf16_length) == [3]
    assert column(spark, ["<a & \"b's\">"], "string", tx.xml_escaped) == ["&lt;a &amp; &quot;b&apos;s&quot;&gt;"]


# --- library -----------------------------------------------------------------


@pytest.fixture
def shelf(tmp_path):
    def write(source, slug, **files):
        folder = tmp_path / source / slug
        folder.mkdir(parents=True, exist_ok=True)
        for name, value in files.items():
            (folder / f"{name.replace('__', '-')}.json").write_text(json.dumps(value, ensure_ascii=False))

    chapter = lambda i, t: {"title": t, "paragraphs": [f"đoạn {i}", "hai"], "index": i}
    write("a", "tale", metadata={"story_title": "Test Story Title"}, chapters_index=[{"index": 0, "title": "Một"}, {"index": 1, "title": "Hai"}], vol__001__ch001__002={"volume": 1, "chapterRange": [1, 2], "chapters": [chapter(0, "Một"), chapter(1, "Hai")]})
    write("b", "tale", metadata={"story_title": "Shadowed"}, chapters_index=[{"index": 7, "title": "x"}])
    write("b", "partial", metadata={"story_title": ""}, chapters_index=[{"index": i, "title": str(i)} for i in range(4)], vol__001__ch001__001={"volume": 1, "chapterRange": [1, 1], "chapters": [chapter(0, "0")]}, vol__002__ch002__004={"volume": 2, "chapterRange": [2, 4], "chapters": [chapter(i, str(i)) for i in (1, 2, 3)]})
    return str(tmp_path)


def test_data_api(spark, shelf):
    lib = open_library(spark, shelf)
    assert sorted(r.slug for r in lib.list_stories().collect()) == ["partial", "tale", "tale"]
    assert [tuple(r) for r in lib.get_chapter_index("tale").collect()] == [(0, "Một"), (1, "Hai")]
    assert lib.get_chapter("tale", 0).paragraphs == ["đoạn 0", "hai"] and lib.get_chapter("tale", 99) is None and lib.get_chapter("none", 0) is None
    assert lib.get_story_title("tale") == "Test Story Title" and lib.get_story_title("partial") == "partial" and lib.get_story_title("none") == "none"
    assert lib.get_total_chapters("tale") == 2 and lib.get_total_chapters("none") == 0
    assert lib.get_chapter("partial", 1, "strict", 3) is None and lib.get_chapter("partial", 1).title == "1"


def test_written_volumes(spark, shelf, tmp_path):
    same = lambda base: sorted(map(str, open_library(spark, base).chapters().select("source", "slug", "volume", "index", "title", "paragraphs").collect()))
    before = same(shelf)
    write_volumes(open_library(spark, shelf).chapters(), str(tmp_path / "out"))
    back = json.loads(next(tmp_path.glob("out/*/partial/vol-002-ch002-004.json")).read_text())
    assert back["chapterRange"] == [2, 4] and [c["index"] for c in back["chapters"]] == [1, 2, 3] and back["volume"] == 2
    assert same(str(tmp_path / "out")) == before


def test_last_writer_wins_is_idempotent(spark):
    rows = [("s", 1, "vol-002", 0, "late"), ("s", 1, "vol-001", 5, "early"), ("s", 2, "vol-001", 0, "a"), ("s", 2, "vol-001", 1, "b")]
    once = volumes.last_written(spark.createDataFrame(rows, "story string, index int, file string, pos int, title string"), ["story", "index"], "file", "pos")
    assert sorted((r["index"], r.title) for r in once.collect()) == [(1, "late"), (2, "b")]
    assert sorted(map(tuple, volumes.last_written(once, ["story", "index"], "file", "pos").collect())) == sorted(map(tuple, once.collect()))


def test_volume_names_and_numbers(spark):
    names = spark.createDataFrame([("vol-007-ch001-050.json",), ("vol-1000-x.json",), ("vol-x.json",), ("notes",)], "file_name string").withColumn("k", F.lit(1))
    assert volumes.next_volume(names, ["k"]).first().next_volume == 1001
    assert spark.range(1).select(volumes.volume_name(F.lit(1234), F.lit(1), F.lit(50))).first()[0] == "vol-1234-ch001-050.json"


def test_search_and_percent(spark):
    index = spark.createDataFrame([(0, "Đầu"), (11, "cuối")], "index int, title string")
    assert [library.search(index, q).count() for q in ("", " đẦu ", "12", "zz")] == [2, 1, 1, 0]
    assert column(spark, [-1, 1, 3], "int", lambda c: library.percent(c, F.lit(8))) == [0, 13, 38]


# --- lines and findings ------------------------------------------------------

MARKDOWN = "---\nname: x\n---\n\n## Overview\none\ntwo\n## Next\n```\n/home/a/b\n```\nsee /home/me/x and ../up\n| a |\n| b |\ntext\n| c |\n" + "wall\n" * 16


def test_line_facts(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, "```\nopen")], "doc_id int, text string")
    frame = lines.line_arrays(docs)
    assert {r.doc: (r.n_blocks, r.n_lines) for r in lines.fence_blocks(frame).collect()} == {1: (1, 1), 2: (1, 1)}
    assert {r.doc: (r.n_tables, r.n_lines) for r in lines.table_runs(frame).collect()}[1] == (2, 3)
    assert lines.section_extent(frame, "Overview").first().n_lines == 2
    assert [(r.n_lines,) for r in lines.walls(frame).collect()] == [(16,)]
    assert [(r.level, r.title) for r in lines.sections(lines.doc_lines(docs)).orderBy("line_no").collect()] == [(2, "Overview"), (2, "Next")]
    found = findings.scan(lines.with_fences(frame), findings.rules(spark, list(rulebook.PATHS)), outside_fences=True)
    assert sorted((r.category, r.title) for r in found.collect()) == [("absolute-path", "Absolute path"), ("relative-prefix", "Parent directory reference")]


def test_fences_and_line_numbers(spark):
    texts = ["a\n ```\nb\n```\nc", "```", "", "x\n```", "```\n```\n\n```\ny"]
    docs = lines.line_arrays(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    for indented in (True, False):
        want = []
        for n, text in enumerate(texts):
            fences = 0
            for i, line in enumerate(text.split("\n"), 1):
                fence = (line.strip() if indented else line).startswith("```")
                want.append((n, i, line, fence, fences % 2 == 1))
                fences += fence
        found = lines.with_fences(docs, indented)
        assert sorted(map(tuple, found.collect())) == want
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_required_text_is_in_every_match():
    assert findings.required(r"(?i)\b[Mm]ake sure (?:to|you)\b") == ("ake sure ", True)
    assert findings.required(r"\{project-root\}/\{[^}]+\}") == ("{project-root}/{", False)
    assert findings.required(r"a|bcd")[0] == findings.required(r"[ab]{2}(?:cd)?")[0] == "" and findings.required("abc?d+e{2}f")[0] == "ab"
    assert findings.required(r"x[]^)]yz(?:[)(]|u)w") == ("yz", False) and findings.required(r"(?:^|[\s\"`'(])~/\S+") == ("~/", False)


def test_rule_tables_hit_their_phrases(spark):
    text = "Make sure to load the relevant files, as described above. You are an AI."
    frame = lines.doc_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    rules = findings.rules(spark, [*rulebook.WASTE, *rulebook.BACK_REFERENCES, *rulebook.SUGGESTIVE_LOADING])
    assert sorted(r.category for r in findings.scan(frame, rules).collect()) == ["back-reference", "defensive-padding", "meta-explanation", "suggestive-loading"]


def test_statuses_differ_by_scanner(spark):
    row = spark.createDataFrame([(1, 0, 0, 1)], "total int, n_critical int, n_high int, n_medium int")
    assert row.select(*(findings.status(k) for k in ("path", "integrity", "dependencies", "validator"))).first() == ("fail", "pass", "warning", "pass")
    with pytest.raises(ValueError):
        findings.status("other")


def test_metrics_and_reductions(spark):
    frame = spark.createDataFrame([("# T\n\n## A\none two\n\n## B\nthree\n",), ("a\r\nb\u2028c",), ("",)], "t string")
    got = frame.select(*(c.alias(n) for n, c in lines.metrics(F.col("t")).items())).collect()
    assert [(r.lines, r.words, r.sections) for r in got] == [(7, 9, 2), (3, 3, 0), (0, 0, 0)]
    pairs = spark.createDataFrame([(10, 1), (8, 3), (0, 5), (4, 4)], "o int, n int").select(lines.reduction(F.col("o"), F.col("n")).alias("r"))
    assert [r.r for r in pairs.collect()] == ["90%", "62%", "N/A", "0%"]


# --- corpus, merges, settings --------------------------------------------------


def test_doc_types_and_groups(spark):
    names = {"product-brief-foo-discovery-notes.md": "discovery-notes", "product_brief.md": "product-brief", "my-design-doc.md": "design-doc", "design-doc-spec.md": "specification", "PRD-v2.md": "prd", "x.md": "unknown", "interview-1.md": "interview-notes"}
    assert column(spark, list(names), "string", corpus.doc_type) == list(names.values())
    files = spark.createDataFrame([("a.md",), ("a-discovery-notes.md",), ("a-appendix-b.md",), ("b.md",), ("c-review.md",)], "filename string")
    got = {r.filename: (r.group_key, r.role) for r in corpus.groups(files).collect()}
    assert got == {"a.md": ("a.md", "primary"), "a-discovery-notes.md": ("a.md", "companion"), "a-appendix-b.md": ("a.md", "companion"), "b.md": ("b.md", "standalone"), "c-review.md": ("c.md", "companion")}


def test_resolve_and_routing(spark):
    files = spark.createDataFrame([("d/a.md", 100), ("d/a.md", 100), ("d/i.png", 1), ("node_modules/j.md", 1), ("d/sub/p.TXT", 11)], "path string, size_bytes long")
    kept = corpus.resolve(files)
    assert sorted(r.path for r in kept.collect()) == ["d/a.md", "d/sub/p.TXT"]
    assert corpus.totals(kept).first() == (2, 111, 27, "single", False)
    assert corpus.totals(files.limit(0)).first()[:2] == (0, 0)


def test_replace_by_key_is_idempotent(spark):
    target = spark.createDataFrame([("m1", 1), ("m2", 2), (" m1 ", 3), (None, 4)], "module string, v int")
    source = spark.createDataFrame([("m1", 9)], "module string, v int")
    once = merge.replace_by_key(target, source, "module")
    assert sorted(map(str, once.collect())) == sorted(map(str, merge.replace_by_key(once, source, "module").collect()))
    assert {r.v for r in once.collect()} == {2, 4, 9}


def test_specs_and_settings(spark):
    assert column(spark, ["a:x:y, b"], "string", merge.parsed_spec) == [{"a": "x:y", "b": None}]
    text = "---\nname: 'n'\n# c\n- item\nempty:\nurl: http://x:1\nname: last\n---\nbody\n\nmore"
    assert column(spark, [text, "no"], "string", lambda c: conf.key_values(conf.front_matter(c))) == [{"url": "http://x:1", "name": "last"}, None]
    lines = "a: >-\nb: > folded\nc: ''x''\nd: \"'y'\"\ne: \"\"\nf: 'it''s'\ng: first\ng: >\n"
    assert column(spark, [lines], "string", conf.key_values) == [{"c": "x", "d": "y", "f": "it''s", "g": "first"}]
    assert column(spark, [text, "no", "---\nopen"], "string", conf.front_matter_state) == ["present", "missing", "unclosed"]
    assert column(spark, [text], "string", conf.content_lines) == [2]


def test_catalog_rows(spark, tmp_path):
    (tmp_path / "c.csv").write_text('a,b,c\n1,"x, ""y""",3\n4,5\n6,7,8,9\n')
    rows = conf.read_catalog(spark, str(tmp_path / "c.csv"), ["a", "b", "c"]).orderBy("row_no").collect()
    assert [(r.a, r.b, r.c) for r in rows] == [("1", 'x, "y"', "3"), ("4", "5", None), ("6", "7", "8")]


# --- graph, access, templates, tracking, pages -------------------------------------


@settings(max_examples=5, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)).filter(lambda e: e[0] > e[1]), min_size=1, max_size=9))
def test_levels_are_complete_on_acyclic_graphs(spark, edges):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "node int")
    got = {r.node: r.level for r in graph.levels(nodes, spark.createDataFrame(sorted(edges), "src int, dst int")).collect()}
    assert set(got) == set(range(7))
    assert all(got[n] == max((got[d] + 1 for s, d in edges if s == n), default=0) for n in got)


def test_cycles_and_redundant_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert graph.closure(edges).count() == 12 and sorted(r.node for r in graph.on_cycles(edges).collect()) == ["a", "b", "c"]
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    assert [r.node for r in graph.levels(nodes, edges).collect()] == ["d"]
    plain = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert [tuple(r) for r in graph.redundant(plain).collect()] == [("a", "c", "b")]


def test_access(spark):
    import base64

    coded = lambda s: "Basic " + base64.b64encode(s.encode("latin-1")).decode()
    headers = [coded("u:p:q"), coded("u:"), coded(":p"), coded("nocolon"), "basic x", "Bearer x", "Basic not-base64", None, coded("é:ü")]
    got = column(spark, headers, "string", access.credentials)
    assert [tuple(c) if c else None for c in got] == [("u", "p:q"), ("u", ""), None, None, None, None, None, None, ("é", "ü")]
    paths = ["/", "/read/a/1", "/_next/static/x", "/favicon.ico"]
    assert column(spark, paths, "string", access.guarded) == [True, True, False, False]


def test_templates(spark):
    assert templates.resolve_blocks("{if-a}1{if-b}2{/if-b}{/if-a}{if-c}3{/if-c}", {"a"}) == "1"
    assert templates.resolve_blocks("{if-a}x{if-a}y{/if-a}z{/if-a}", {"a"}) == "xyz"
    frame = spark.createDataFrame([("v-{value}", "ans"), ("v-{value}", "{project-root}/x")], "t string, a string")
    assert [r[0] for r in frame.select(templates.result_of(F.col("t"), F.col("a"))).collect()] == ["v-ans", "{project-root}/x"]


def test_tracking(spark):
    assert column(spark, ["Story 1.1: User Auth"], "string", tracking.story_key) == ["1-1-user-auth"]
    assert column(spark, ["epic-1", "epic-1-retrospective", "1-2-x"], "string", tracking.kind) == ["epic", "retrospective", "story"]
    assert column(spark, ["review", "done"], "string", lambda c: tracking.never_back(c, F.lit("in-progress"))) == ["review", "done"]


PAGE = """<title>Truyện &amp; kể</title><nav><a href="/b" class="next disabled">x</a></nav><h1> Chương 1: Mở </h1><article>A<b>b</b><script>no</script>
 c<div>boxed</div></article><a href="#" class="next">n</a><a href="/2"> Sau </a>"""


def test_page_fields(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>bare")], "page_id int, html string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[1].title == "Chương 1: Mở" and got[1].story_title == "Truyện & kể" and got[1].paragraphs == ["A", "b", "c", "boxed"] and got[1].next_url == "/2"
    assert got[2].error == got[3].error == "no content" and got[3].title == "Unknown"
    boxed = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")
    assert html.page_fields(boxed, html.SITES["boxed"])["paragraphs"] == ["A", "b", "c"]
    crumbs = "<div class=c-breadcrumb-wrapper><a> Tale </a><ol><li>x<li class=active>Chương 2: Two</ol></div><div class=reading-content>Chương 2: Two\nline</div><div class=nav-next><a href='#'>x</a><a href=/3>y</a></div><a href=/4>Sau</a>"
    row = html.extract(spark.createDataFrame([(1, crumbs)], "page_id int, html string"), "breadcrumb").first()
    assert (row.title, row.story_title, row.paragraphs, row.next_url) == ("Two", "Tale", ["line"], None)
    both = "<div class='portlet-title'><div><h1>Đọc truyện A</h1></div></div><div class=caption><h1 class=read>B</h1></div><h2>T</h2><p id=noidungchap>x.com\nreal<div>no</div>\nx.net</p>"
    assert html.extract(spark.createDataFrame([(1, both)], "page_id int, html string"), "captioned").select("story_title", "paragraphs").first() == ("A", ["real"])
    assert html.page_fields("<div class=truyen>no</div><div class=vung-doc><p><div class=truyen>no</div></p><div class=truyen>yes</div></div>", html.SITES["nested"])["paragraphs"] == ["yes"]
    assert column(spark, ["Chương 12: X", "Chương 3."], "string", html.clean_title) == ["X", "Chương 3."]


def test_link_chains_and_stops(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "gone"), ("y", None)], "url string, next_url string")
    starts = spark.createDataFrame([("a",), ("x",), ("y",)], "url string")
    got = {(r.start, r.url): r.depth for r in html.link_order(links, starts).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("x", "x"): 0, ("y", "y"): 0}
    rows = spark.createDataFrame([("s", 0, None), ("s", 1, "bad"), ("s", 2, None), ("t", 0, None)], "story string, n int, error string")
    assert sorted((r.story, r.n) for r in html.before_first_error(rows, "story", "n").collect()) == [("s", 0), ("t", 0)]
