"""Extraction on hand-made pages and on the table's own pages."""

import html
import re
import time

from storylake.llm.html_density import main_text, page_texts


def test_table_pages_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for row in page_texts(pages).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", source[row.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        assert row.text == "\n".join(b for b in blocks if b) and row.n_chars == len(row.text)


def test_article_without_semantic_tags():
    page = """<body><div id="menu"><a href=a>one</a> <a href=b>two</a></div><div class="wrap"><div class="story">
      <p>The first paragraph of the story is long enough to have weight.</p><p>So is the second &amp; last&nbsp;one,
      with a <a href=c>link</a> in it.</p></div></div><div class="footer"><a href=d>imprint</a> <a href=e>terms</a></div></body>"""
    assert main_text(page) == "The first paragraph of the story is long enough to have weight.\nSo is the second & last one, with a link in it."


def test_sections_beside_the_core_stay():
    section = "<div><p>{0} long paragraph with many words in it, for the density.</p><p>{0} second paragraph, also with words.</p></div>"
    page = f"<body><nav><a href=x>x</a></nav><div>{section.format('One')}{section.format('Two')}</div></body>"
    assert main_text(page).count("\n") == 3


def test_text_in_and_beside_several_articles_stays():
    part = "<p>{0} long paragraph with many words in it, for the density.</p>" * 4
    one, two = (f"<article>{part.format(n)}</article>" for n in ("One", "Two"))
    assert main_text(f"<body><main>{one}{two}</main></body>").count("\n") == 7
    assert main_text(f"<body><nav><a href=x>x</a></nav>{one}{two}</body>").count("\n") == 7
    assert main_text(f"<body><main><div>{part.format('Intro')}</div>{one}</main></body>").count("\n") == 7


def test_noise_inside_the_article_is_left_out():
    page = """<article><header><h1>Title</h1></header><p>Body text here<p>More body<div class="ad">buy</div><form>f<input></form>
      <aside>side</aside><script>var a="<p>x</p>"</script><!-- c --><section id="comments"><p>reader</p></section><ul><li>a<li>b</ul></article>"""
    assert main_text(page) == "Title\nBody text here\nMore body\na\nb"


def test_edge_cases(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "no tags at all", "x"), (4, "u", "<p>unclosed <b>bold", "x"), (5, "u", "<script>only</script>", "x"), (6, "u", "<div>" * 3000 + "deep" , "x"), (7, "u", "<article>" + "<p>word</p>" * 20_000, "x"), (1, "u", None, "x"), (8, "u", "</div></p><<>&#0;&bogus; a < b", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = page_texts(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[2] == text[5] == "" and text[3] == "no tags at all" and text[4] == "unclosed bold" and text[6] == "deep"
    assert text[7].count("\n") == 19_999
    assert page_texts(pages.limit(0)).count() == 0


def test_sections_and_end_tags_without_meaning():
    assert main_text("<p>a</p><![foo[x]]>") == "a"
    assert main_text("<![if !IE]><p>a</p><![endif]><![CDATA[x]]><p>b</p><![") .startswith("a\nb")
    assert main_text("<article>" + "<b>" * 20_000 + "x" + "</i>" * 20_000 + "<p>y</article>").split() == ["x", "y"]


def test_names_that_only_hint_are_decided_by_density():
    body = "<p>{0} long paragraph with many words in it, for the density of the text.</p>" * 3
    page = f"<body><div><div>{body.format('A')}<p class='share-price'>Shares fell 3 percent.</p><div class='share-buttons'>tell others</div><div class=\"comment-list\"><p>{'reader ' * 40}</p></div></div></div></body>"
    text = main_text(page)
    assert "Shares fell 3 percent." in text and "tell others" not in text and "reader" not in text


def test_density_leaves_out_what_no_name_tells():
    links = "".join(f"<li><a href=x>item {i}</a></li>" for i in range(12))
    story = "".join(f"<p>Paragraph {i} of the story, which has enough words to have some weight.</p>" for i in range(6))
    page = f"<body><div class=x1><ul>{links}</ul></div><div class=x2>{story}</div><div class=x3><a href=a>imprint</a> <a href=b>terms</a></div></body>"
    assert main_text(page).count("\n") == 5 and "item" not in main_text(page) and "imprint" not in main_text(page)


def test_measures_against_a_model_on_random_trees():
    """Densities and sums by recursion over the random tree itself, without the parser."""
    import math
    import random

    from storylake.llm import html_density as hd

    rnd = random.Random(9)

    def tree(depth):
        return [rnd.choice(["div", "section", "p", "a"] if depth else ["p", "a"]), [rnd.choice(["some words here ", "x ", "a longer run of words than the others "]) if rnd.random() < 0.5 or not depth else tree(depth - 1) for _ in range(rnd.randint(1, 4))]]

    def html_of(node):
        return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(html_of, node[1]))}</{node[0]}>"

    def plain(node, inside=()):
        """p and a hold text only, as their nesting would be mended by the parser."""
        return node if isinstance(node, str) else [node[0], [plain(c) for c in node[1]] if node[0] in ("div", "section") else [c for c in node[1] if isinstance(c, str)] or ["y "]]

    def counts(node):
        c = t = lc = lt = 0
        for part in node[1]:
            if isinstance(part, str):
                c += len(part.strip())
            else:
                a, b, d, e = counts(part)
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (part[0] == "a")
        return c, t, c if node[0] == "a" else lc, lt

    for _ in range(40):
        body = ["body", [plain(tree(3)) for _ in range(3)]]
        top = counts(["html", [body]])
        parsed = hd._Tree()
        parsed.feed(html_of(body))
        parsed.close()
        hd._measure(parsed.nodes)
        expected = []

        def walk(node):
            c, t, lc, lt = counts(node)
            density = 0.0
            if c:
                t1, l1, lt1 = max(1, t), max(1, lc), max(1, lt)
                base = math.log(c / max(1, c - lc) * lc + top[2] / max(1, top[0]) * c + math.e)
                density = c / t1 * math.log(max(1.0, c / l1 * t1 / lt1)) / (math.log(base) if base > 1 + 1e-9 else 1.0)
            at = len(expected)
            expected.append(None)
            children = sum(walk(p) for p in node[1] if not isinstance(p, str))
            expected[at] = (node[0], c, density, children)
            return density

        walk(["html", [body]])
        # The parser joins neighbouring texts, so characters are compared where no text parts meet.
        assert [n.tag for n in parsed.nodes] == [e[0] for e in expected]
        for n, (tag, chars, density, total) in zip(parsed.nodes, expected):
            if n.chars == chars and parsed.root.chars == top[0]:
                assert math.isclose(n.density, density, abs_tol=1e-9), (tag, chars, n.tags, n.link_chars, n.link_tags, counts(body), [tuple(x) for x in expected][:3])
                assert (tag != "p" or n.total == 0)


def test_density_alone_finds_the_article_of_the_tables_pages(spark):
    """With tags and names that tell the parts of a page taken away, the core by density stands for them."""
    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    plain = [re.sub(r"<(/?)(nav|article|footer)>", r"<\1div>", p).replace(' class="ad"', "") for p in pages]
    same = sum(main_text(a) == main_text(b) for a, b in zip(pages, plain))
    assert same >= 0.95 * len(pages)


def test_names_inside_an_article_may_be_its_subject():
    body = "".join(f"<p>Paragraph {i} of the article speaks about many things at some length, as articles do.</p>" for i in range(6))
    blocks = ("<div class='social'><p>The social sphere matters.</p></div>", "<p class='comment'>A remark by the author on what has been said so far.</p>", "<section id='notice'><p>Theorem. Every notice is read once.</p></section>")
    for block in blocks:
        text = main_text(f"<html><body><nav><a href=/>Home</a></nav><article>{body}{block}<p>The end of the article comes here.</p></article></body></html>")
        assert len(text.split("\n")) == 8, block
    links = "<div class='social'><a href=/a>Tweet</a> <a href=/b>Like</a> <a href=/c>Pin</a></div>"
    for block in (links, "<div class='comments'><p>Great article, thank you so much for all of this.</p></div>", "<div class='ad-banner'><p>Buy it now.</p></div>"):
        text = main_text(f"<html><body><article>{body}{block}</article></body></html>")
        assert len(text.split("\n")) == 6, block


def test_unclosed_elements_take_no_square_of_their_number():
    n = 60_000
    for page in ("<i><div>" + "<b>" * n + "</i>" * n, "<ul><li><ul>" + "<b>" * n + "<li></li>" * n, "<table>" + "<td>" * n):
        began = time.process_time()
        main_text(page + "end")
        assert time.process_time() - began < 5
