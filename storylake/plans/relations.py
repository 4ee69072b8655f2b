"""Queries of merges, integrity, graphs, access, templates, tracking, pages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from storylake.functions import text
from storylake.operators import access, cache, extraction, graph, html, library, merge, templates, tracking
from storylake.sources.tables import table
from storylake.streaming import progress


def _parts(spark, folder):
    """Parts as an installed catalog and a newer one for some brands."""
    target = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    source = target.where("p_brand IN ('Brand#1', 'Brand#11', 'Brand#23') AND p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 100)
    return target, source


def anti_zombie_merge(spark, folder):
    """Catalog rows after replacing every brand that the newer catalog has."""
    return merge.replace_by_key(*_parts(spark, folder), "p_brand")


def merge_summary(spark, folder):
    """Rows removed, added and in total by that merge."""
    return merge.merge_counts(*_parts(spark, folder), "p_brand")


def config_overlay(spark, folder):
    """Three layers of settings: all customers, those with an even number of orders, and overrides of which some are absent."""
    customers = table(spark, folder, "customer").select(F.lower("c_mktsegment").alias("segment"), "c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), "c_nationkey")
    base = customers.select(F.col("segment").alias("scope"), "key", F.col("c_nationkey").cast("string").alias("value"))
    mid = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n % 2 = 0").join(customers, "c_custkey")
    mid = mid.select(F.col("segment").alias("scope"), "key", F.concat(F.lit("n"), F.col("n").cast("string")).alias("value"))
    top = customers.where("c_nationkey < 5").select(F.when(F.col("c_custkey") % 2 == 0, F.col("segment")).otherwise("user").alias("scope"), "key", F.when(F.col("c_nationkey") != 3, "set").alias("value"))
    return merge.overlay(base, mid, top)


def missing_and_orphans(spark, folder):
    """Customers without orders and orders of customers outside a segment."""
    customers = table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("custkey"))
    return merge.missing_and_orphans(customers, table(spark, folder, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


def dup_keys(spark, folder):
    """Suppliers that share nation and rounded balance."""
    rows = table(spark, folder, "supplier").select(F.concat_ws("-", F.col("s_nationkey").cast("string"), F.floor(F.col("s_acctbal") / 2000).cast("string")).alias("code"), "s_name", "s_suppkey")
    return merge.duplicate_keys(rows, "code", "s_name", "s_suppkey")


def ref_integrity(spark, folder):
    """Listed nation keys that no nation of an even region has."""
    rows = table(spark, folder, "supplier").select("s_suppkey", F.concat_ws(", ", F.col("s_nationkey").cast("string"), (F.col("s_nationkey") + 7).cast("string")).alias("refs"))
    return merge.broken_references(rows, "s_suppkey", "refs", table(spark, folder, "nation").where("n_regionkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("ref")))


def _edges(spark, folder, cyclic=False):
    """Customers depend on the one of half their number and of a quarter; with a cycle on top if asked."""
    keys = table(spark, folder, "customer").select(F.col("c_custkey").cast("int").alias("src"))
    part = lambda n: keys.select("src", F.floor(F.col("src") / n).cast("int").alias("dst"))
    edges = part(2).union(part(4)).where("src <> dst AND dst > 0").distinct()
    return edges.union(keys.where("src = 1").select("src", F.lit(6))) if cyclic else edges


def dep_closure(spark, folder):
    """All dependencies, direct or not."""
    return graph.closure(_edges(spark, folder, cyclic=True))


def dep_cycles(spark, folder):
    """Customers on a cycle."""
    return graph.on_cycles(_edges(spark, folder, cyclic=True))


def dep_redundant(spark, folder):
    """Dependencies that another one brings along."""
    return graph.redundant(_edges(spark, folder))


def dep_levels(spark, folder):
    """Customers that can be done side by side, with their level."""
    return graph.parallel_groups(graph.levels(table(spark, folder, "customer").select(F.col("c_custkey").cast("int").alias("node")), _edges(spark, folder)))


def dep_cycle_paths(spark, folder):
    """Ways around the cycles: customers that depend on each other in rings of three to seven, and on one outside."""
    own = table(spark, folder, "customer").select(F.col("c_custkey").cast("int").alias("c"))
    last = own.agg(F.max("c").alias("last"))
    ring = own.join(F.broadcast(last), F.lit(True)).select("c", "last", (F.col("c") - F.col("c") % 10).alias("first"), (3 + F.floor(F.col("c") / 10) % 5).cast("int").alias("size"))
    inside = ring.where("c % 10 < size AND first + size - 1 <= last AND first > 0")
    around = inside.select(F.col("c").alias("src"), F.when(F.col("c") - F.col("first") + 1 == F.col("size"), F.col("first")).otherwise(F.col("c") + 1).alias("dst"))
    out = inside.where("c % 10 = 2").select(F.col("c").alias("src"), F.lit(1).alias("dst"))
    return graph.cycle_paths(around.union(out)).select("component", "n", F.array_join("path", ">").alias("path"))


def page_chains(spark, folder):
    """Pages in the order of next links: each page leads to the one three ids on, every hundredth back to an earlier one."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("id"))
    to = F.when(F.col("id") % 100 == 99, F.col("id") - 60).otherwise(F.col("id") + 3)
    links = pages.select(F.col("id").cast("string").alias("url"), to.cast("string").alias("next_url"))
    return html.link_order(links, pages.where("id < 3 OR id % 50 = 0").select(F.col("id").cast("string").alias("url")))


def _requests(spark, folder):
    """Events as requests with a basic-auth header of some kind."""
    pair = F.concat(F.col("event_type"), F.when(F.col("event_id") % 4 == 0, "").otherwise(":"), F.col("user_id").cast("string"))
    coded = F.base64(pair.cast("binary"))
    header = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("Bearer "), coded)).when(F.col("event_id") % 11 == 0, F.lit("Basic ?not base64?")).otherwise(F.concat(F.lit("Basic "), coded))
    return table(spark, folder, "events").select("event_id", header.alias("header"))


def basic_auth_decode(spark, folder):
    """User and password of every header that has them."""
    return _requests(spark, folder).select("event_id", access.credentials(F.col("header")).alias("c")).select("event_id", F.coalesce("c.username", F.lit("-")).alias("username"), F.coalesce("c.password", F.lit("-")).alias("password"))


def access_decision(spark, folder):
    """Status of every request if one user is expected."""
    found = _requests(spark, folder).select("event_id", access.credentials(F.col("header")).alias("c"))
    return found.select("event_id", access.status_code(F.col("event_id") % 5 != 0, F.col("c"), F.lit(" click "), F.when(F.col("event_id") % 13 == 0, "").otherwise("7")).alias("status_code"))


def route_filter(spark, folder):
    """Pages whose path a decision is made for; some paths are those of files that need none."""
    own = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1), F.lit("")), F.lit("/"))
    others = ("/_next/static/a.js", "/favicon.ico", "/robots.txt.old", "/a/robots.txt", "relative")
    path = F.coalesce(F.try_element_at(F.array(*map(F.lit, others)), (F.col("page_id") % 8 + 1).cast("int")), own)
    return table(spark, folder, "pages").select("page_id", access.guarded(path).alias("guarded"))


def template_vars(spark, folder):
    """Greetings to every customer; unknown names stay."""
    variables = F.create_map(F.lit("name"), F.col("c_name"), F.lit("region"), F.col("c_nationkey").cast("string"), F.lit("none"), F.lit(None).cast("string"))
    return table(spark, folder, "customer").select("c_custkey", templates.filled(F.lit("Hi {name} of {region}, {none} {other}"), variables).alias("text"))


def template_conditionals(spark, folder):
    """Templates with blocks that depend on the customer."""
    text = F.lit("a{if-even}E{if-big}B{/if-big}{/if-even}\n\n\n\n{if-odd}O{/if-odd}z")
    names = F.array_compact(F.array(F.when(F.col("c_custkey") % 2 == 0, "even"), F.when(F.col("c_custkey") % 2 == 1, "odd"), F.when(F.col("c_custkey") > 10, "big")))
    return table(spark, folder, "customer").select("c_custkey", templates.resolved(text, names).alias("text"))


def _sprint(spark, folder):
    status = F.element_at(F.array(*map(F.lit, ("done", "in-progress", "review", "ready-for-dev", "backlog", "drafted", "contexted"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    key = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("epic-"), F.col("o_custkey").cast("string"))).when(F.col("o_orderkey") % 10 == 1, F.concat(F.lit("epic-"), F.col("o_custkey").cast("string"), F.lit("-retrospective"))).otherwise(F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit("story")))
    return table(spark, folder, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey", key.alias("key"), status.alias("status"))


def sprint_counts(spark, folder):
    """Entries by kind and status."""
    return tracking.counts(_sprint(spark, folder))


def next_story(spark, folder):
    """The next story of every priority."""
    return tracking.next_story(_sprint(spark, folder).where("key NOT LIKE 'epic%'"), "o_orderpriority")


def status_merge(spark, folder):
    """Statuses after a detection that must not set them back."""
    detected = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "in-progress").otherwise("backlog")
    return _sprint(spark, folder).select("o_orderkey", tracking.never_back(tracking.current_status(F.col("status")), detected).alias("status"))


def html_title(spark, folder):
    """Chapter titles of all pages."""
    return html.extract(table(spark, folder, "pages")).select("page_id", F.md5("title").alias("title_md5"))


def html_paragraphs(spark, folder):
    """Lines of all pages."""
    return html.extract(table(spark, folder, "pages")).select("page_id", F.posexplode("paragraphs").alias("para_idx", "text"))


def html_links(spark, folder):
    """Next links and errors of all pages."""
    return html.extract(table(spark, folder, "pages")).select("page_id", "next_url", "error")


def site_fields(spark, folder):
    """Fields of documents as chapters of three sites, each with its own places, noise and ways on."""
    rows = table(spark, folder, "documents").select("doc_id", F.col("source").alias("s"), F.regexp_replace(text.xml_escaped(F.coalesce("text", F.lit(""))), "\r", " ").alias("t"))
    n = F.col("doc_id").cast("string")
    title = F.concat(F.lit("Chương "), n, F.lit(": of "), F.col("s"))
    parts = {
        "breadcrumb": (F.lit("<div class='x c-breadcrumb-wrapper'><ol><li>x</li><li><a href=/>"), F.col("s"), F.lit("</a></li><li class=active>"), title, F.lit("</li></ol></div><li class=active>no</li><div class=reading-content><p>"), title, F.lit("</p><p>"), F.col("t"), F.lit("</p></div><a href=/no>Sau</a><div class=nav-next>"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<a href=/c"), n, F.lit(">on</a>"))).otherwise("<a href=''>on</a><a href=/no>on</a>"), F.lit("</div>")),
        "captioned": (F.lit("<div class=caption><h1 class=read>Đọc truyện "), F.col("s"), F.lit("</h1></div><h2>"), title, F.lit("</h2><div id=noidungchap>Người đăng: me\n<div>none of it</div>"), F.col("t"), F.lit("\nsite.com</div><a href=/c"), n, F.lit("> Sau </a>")),
        "nested": (F.lit("<h1>"), F.col("s"), F.lit("</h1><h2>"), title, F.lit("</h2><div class=truyen>no</div><div class=vung-doc><div class=truyen>"), F.col("t"), F.lit("</div></div><a class=next href=/no>x</a><div id=gotochap><a class='btn next"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(" disabled"), F.lit("' href=/c"), n, F.lit(">x</a></div>")),
    }
    found = [html.extract(rows.where(F.col("doc_id") % 3 == i).select("doc_id", F.concat(*made).alias("html")), site, "doc_id", "html").withColumn("site", F.lit(site)) for i, (site, made) in enumerate(parts.items())]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("site", F.col("page_id").alias("doc_id"), "title", "story_title", F.size("paragraphs").alias("n_lines"), F.md5(F.array_join("paragraphs", "\n")).alias("lines_md5"), F.coalesce("next_url", F.lit("-")).alias("next_url"))


def url_slug(spark, folder):
    """Slugs, and links joined to the site of every page."""
    href = F.element_at(F.array(*map(F.lit, ("/top", "next.html", "//cdn.example.com/x", "https://other.example/y"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, folder, "pages").select("page_id", html.slug(F.col("url")).alias("slug"), html.joined_url(F.col("url"), href).alias("joined"))


def stream_progress(spark, folder):
    """Latest progress of every reader, read as a stream."""
    events = progress.event_stream(spark, folder).select("event_id", "ts", "user_id", F.col("event_type").alias("slug"), F.get_json_object("props", "$.k").try_cast("int").alias("chapter_idx"))
    return progress.drained(progress.latest(events, ["user_id", "slug"], "chapter_idx", ["ts", "event_id"]))


def stream_cache(spark, folder):
    """Cache keys that stay, first insertions read as a stream."""
    events = progress.event_stream(spark, folder).select("event_id", "ts", F.concat_ws(":", "event_type", F.get_json_object("props", "$.k").try_cast("int").cast("string")).alias("key"))
    first = progress.drained(progress.first_insertions(events, "key", ["ts", "event_id"])).select("key", "first.ts", "first.event_id")
    return cache.retained(first, "key", "ts", "event_id")


def progress_batch(spark, folder):
    """The batch twin of the progress stream."""
    return library.latest_progress(table(spark, folder, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("slug"), F.get_json_object("props", "$.k").try_cast("int").alias("chapter_idx")))


_WS = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

QUERIES = {f.__name__: f for f in (anti_zombie_merge, merge_summary, config_overlay, missing_and_orphans, dup_keys, ref_integrity, dep_closure, dep_cycles, dep_redundant, dep_levels, dep_cycle_paths, page_chains, basic_auth_decode, access_decision, route_filter, template_vars, template_conditionals, sprint_counts, next_story, status_merge, html_title, html_paragraphs, html_links, site_fields, url_slug, stream_progress, stream_cache, progress_batch)}

_PARTS = """t AS (SELECT p_partkey, p_brand, p_size FROM part),
  s AS (SELECT p_partkey, p_brand, p_size + 100 AS p_size FROM part WHERE p_brand IN ('Brand#1', 'Brand#11', 'Brand#23') AND p_partkey % 2 = 0),
  m AS (SELECT * FROM t WHERE p_brand NOT IN (SELECT p_brand FROM s) UNION ALL SELECT * FROM s)"""
_EDGES = "e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey // 2 > 0 UNION SELECT c_custkey, c_custkey // 4 FROM customer WHERE c_custkey // 4 > 0)"
_CYCLIC = f"{_EDGES}, c AS (SELECT * FROM e UNION SELECT 1, 6)"
_CLOSE = "r(src, dst) AS (SELECT src, dst FROM {0} UNION SELECT r.src, {0}.dst FROM r JOIN {0} ON r.dst = {0}.src)"
_REQ = """q AS (SELECT event_id, event_type || CASE WHEN event_id % 4 = 0 THEN '' ELSE ':' END || CAST(user_id AS VARCHAR) AS pair, event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 4 <> 0 AS ok FROM events)"""
_SPRINT = """sp AS (SELECT o_orderpriority, o_orderstatus, o_orderkey, (['done', 'in-progress', 'review', 'ready-for-dev', 'backlog', 'drafted', 'contexted'])[o_orderkey % 7 + 1] AS raw,
  CASE WHEN o_orderkey % 10 = 0 THEN 'epic-' || o_custkey WHEN o_orderkey % 10 = 1 THEN 'epic-' || o_custkey || '-retrospective' ELSE o_custkey || '-' || o_orderkey || '-story' END AS key, o_custkey FROM orders),
  st AS (SELECT *, CASE raw WHEN 'drafted' THEN 'ready-for-dev' WHEN 'contexted' THEN 'in-progress' ELSE raw END AS status FROM sp)"""
_LATEST = """SELECT user_id, slug, chapter_idx FROM (SELECT user_id, event_type AS slug, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS chapter_idx,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""

ORACLES = {
    "html_paragraphs": r"""WITH a AS (SELECT page_id, regexp_split_to_array(regexp_extract(html, '<article>((?s).*?)</article>', 1), '<[^>]*>') AS parts FROM pages),
        l AS (SELECT page_id, list_filter(list_transform(flatten(list_transform(parts, lambda x: string_split(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), chr(10)))),
          lambda x: regexp_replace(x, '^[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g')), lambda x: x <> '') AS l FROM a)
        SELECT page_id, CAST(i - 1 AS INTEGER) AS para_idx, l[i] AS text FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)""",
    "route_filter": r"""WITH p AS (SELECT page_id, coalesce((['/_next/static/a.js', '/favicon.ico', '/robots.txt.old', '/a/robots.txt', 'relative'])[page_id % 8 + 1], nullif(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), ''), '/') AS path FROM pages)
        SELECT page_id, starts_with(path, '/') AND NOT regexp_matches(path, '^/(_next/static|_next/image|favicon\.ico|robots\.txt|sitemap\.xml)') AS guarded FROM p""",
    "html_links": r"""SELECT page_id, nullif(regexp_extract(html, '<a [^>]*class="next"[^>]*href="([^"#]+)"', 1), '') AS next_url,
        CASE WHEN regexp_replace(regexp_extract(html, '<article>((?s).*?)</article>', 1), '<[^>]*>|\s', '', 'g') = '' THEN 'no content' END AS error FROM pages""",
    "anti_zombie_merge": f"WITH {_PARTS} SELECT * FROM m",
    "merge_summary": f"WITH {_PARTS} SELECT (SELECT count(*) FROM t) + (SELECT count(*) FROM s) - (SELECT count(*) FROM m) AS removed, (SELECT count(*) FROM s) AS added, (SELECT count(*) FROM m) AS total",
    "config_overlay": """WITH c AS (SELECT lower(c_mktsegment) AS segment, c_custkey, 'c' || c_custkey AS key, c_nationkey FROM customer), k AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) % 2 = 0),
        a AS (SELECT segment AS scope, key, CAST(c_nationkey AS VARCHAR) AS value, 0 AS r FROM c UNION ALL SELECT segment, key, 'n' || n, 1 FROM k JOIN c ON o_custkey = c_custkey
          UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN segment ELSE 'user' END, key, CASE WHEN c_nationkey <> 3 THEN 'set' END, 2 FROM c WHERE c_nationkey < 5)
        SELECT scope, key, value FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY r DESC) AS n FROM a WHERE value IS NOT NULL) WHERE n = 1""",
    "missing_and_orphans": """WITH c AS (SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment <> 'BUILDING'), o AS (SELECT DISTINCT o_custkey AS custkey FROM orders)
        SELECT custkey, 'missing' AS finding FROM c WHERE custkey NOT IN (SELECT custkey FROM o) UNION ALL SELECT custkey, 'orphan' FROM o WHERE custkey NOT IN (SELECT custkey FROM c)""",
    "dup_keys": "SELECT code, count(*) AS n, string_agg(s_name, ', ' ORDER BY s_suppkey) AS names FROM (SELECT s_nationkey || '-' || CAST(floor(s_acctbal / 2000) AS BIGINT) AS code, s_name, s_suppkey FROM supplier) GROUP BY code HAVING count(*) > 1",
    "ref_integrity": """SELECT s_suppkey, ref FROM (SELECT s_suppkey, unnest([CAST(s_nationkey AS VARCHAR), CAST(s_nationkey + 7 AS VARCHAR)]) AS ref FROM supplier) WHERE ref NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey % 2 = 0)""",
    "dep_closure": f"WITH RECURSIVE {_CYCLIC}, {_CLOSE.format('c')} SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM r",
    "dep_cycles": f"WITH RECURSIVE {_CYCLIC}, {_CLOSE.format('c')} SELECT CAST(src AS INTEGER) AS node FROM r WHERE src = dst",
    "dep_redundant": f"WITH RECURSIVE {_EDGES}, {_CLOSE.format('e')} SELECT CAST(d.src AS INTEGER) AS src, CAST(d.dst AS INTEGER) AS dst, CAST(o.dst AS INTEGER) AS through FROM e d JOIN e o ON d.src = o.src AND d.dst <> o.dst JOIN r ON r.src = o.dst AND r.dst = d.dst",
    "dep_levels": f"""WITH RECURSIVE {_EDGES}, w(node, level) AS (SELECT c_custkey, 0 FROM customer UNION SELECT e.src, w.level + 1 FROM w JOIN e ON e.dst = w.node),
        l AS (SELECT node, max(level) AS level FROM w GROUP BY node)
        SELECT CAST(level AS INTEGER) AS level, CAST(node AS INTEGER) AS node FROM l WHERE level IN (SELECT level FROM l GROUP BY level HAVING count(*) > 1)""",
    "dep_cycle_paths": """WITH c AS (SELECT c_custkey AS c, max(c_custkey) OVER () AS last, c_custkey - c_custkey % 10 AS first, 3 + (c_custkey // 10) % 5 AS size FROM customer),
        r AS (SELECT DISTINCT first, size FROM c WHERE first > 0 AND first + size - 1 <= last)
        SELECT CAST(first AS INTEGER) AS component, 0::BIGINT AS n, array_to_string(range(first, first + size), '>') || '>' || first AS path FROM r""",
    "page_chains": """WITH RECURSIVE l AS (SELECT page_id AS id, CASE WHEN page_id % 100 = 99 THEN page_id - 60 ELSE page_id + 3 END AS nxt FROM pages),
        w(start, id, depth) AS (SELECT page_id, page_id, 0 FROM pages WHERE page_id < 3 OR page_id % 50 = 0
            UNION ALL SELECT start, nxt, depth + 1 FROM w JOIN l USING (id) WHERE nxt IN (SELECT page_id FROM pages) AND depth <= (SELECT count(*) FROM pages))
        SELECT CAST(start AS VARCHAR) AS start, CAST(id AS VARCHAR) AS url, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY start, id""",
    "site_fields": f"""WITH t AS (SELECT doc_id, source AS s, doc_id % 3 AS k, replace(coalesce(text, ''), chr(13), ' ') AS text FROM documents),
        l AS (SELECT doc_id, s, k, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS l FROM t),
        g AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: NOT regexp_matches(l[i], '{"|".join(extraction.NOISE)}')) AS good FROM l),
        p AS (SELECT *, CASE WHEN k <> 1 THEN l WHEN len(good) = 0 THEN [] ELSE l[list_min(good):list_max(good)] END AS p FROM g)
        SELECT CASE k WHEN 0 THEN 'breadcrumb' WHEN 1 THEN 'captioned' ELSE 'nested' END AS site, doc_id, CASE WHEN k = 0 THEN 'of ' || s ELSE 'Chương ' || doc_id || ': of ' || s END AS title, s AS story_title,
               CAST(len(p) AS INTEGER) AS n_lines, md5(coalesce(array_to_string(p, chr(10)), '')) AS lines_md5, CASE WHEN k = 1 OR doc_id % 2 = 0 THEN '/c' || doc_id ELSE '-' END AS next_url FROM p""",
    "basic_auth_decode": f"WITH {_REQ} SELECT event_id, CASE WHEN ok THEN split_part(pair, ':', 1) ELSE '-' END AS username, CASE WHEN ok THEN split_part(pair, ':', 2) ELSE '-' END AS password FROM q",
    "access_decision": f"WITH {_REQ} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 200 WHEN event_id % 13 = 0 THEN 500 WHEN ok AND pair = 'click:7' THEN 200 ELSE 401 END AS status_code FROM q",
    "template_vars": "SELECT c_custkey, 'Hi ' || c_name || ' of ' || c_nationkey || ', {none} {other}' AS text FROM customer",
    "template_conditionals": "SELECT c_custkey, 'a' || CASE WHEN c_custkey % 2 = 0 THEN 'E' || CASE WHEN c_custkey > 10 THEN 'B' ELSE '' END ELSE '' END || chr(10) || chr(10) || CASE WHEN c_custkey % 2 = 1 THEN 'O' ELSE '' END || 'z' AS text FROM customer",
    "sprint_counts": f"WITH {_SPRINT} SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'epic' WHEN o_orderkey % 10 = 1 THEN 'retrospective' ELSE 'story' END AS kind, status, count(*) AS n FROM st GROUP BY ALL",
    "next_story": f"""WITH {_SPRINT}, p AS (SELECT *, list_position(['in-progress', 'review', 'ready-for-dev', 'backlog'], raw) AS place FROM st WHERE key NOT LIKE 'epic%')
        SELECT o_orderpriority, key, raw AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY place, o_custkey, o_orderkey) AS r FROM p WHERE place > 0) WHERE r = 1""",
    "status_merge": f"""WITH {_SPRINT}, d AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'in-progress' ELSE 'backlog' END AS new FROM st), o AS (SELECT ['backlog', 'ready-for-dev', 'in-progress', 'review', 'done'] AS o)
        SELECT o_orderkey, CASE WHEN coalesce(list_position(o, new), 0) > coalesce(list_position(o, status), 0) THEN new ELSE status END AS status FROM d, o""",
    "html_title": "SELECT page_id, md5(trim(replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&'))) AS title_md5 FROM pages",
    "url_slug": r"""WITH u AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS p, (['/top', 'next.html', '//cdn.example.com/x', 'https://other.example/y'])[page_id % 4 + 1] AS href FROM pages)
        SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(p, '^[a-z]+://[^/]+/(?:.*/)?([^/]+)$', 1), '\.[a-z]+$', ''), ''), 'unknown') AS slug,
          CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+):', 1) || ':' || href
            WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href
            ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://[^/]+(?:/.*)?)/[^/]*$', 1) || '/' || href END AS joined FROM u""",
    "stream_progress": _LATEST,
    "progress_batch": _LATEST,
    "stream_cache": """WITH ins AS (SELECT concat_ws(':', event_type, CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR)) AS key, ts, event_id FROM events)
        SELECT key, ts AS first_ts FROM (SELECT key, ts, event_id, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS r FROM ins) WHERE r = 1 ORDER BY ts DESC, event_id DESC LIMIT 200""",
}
