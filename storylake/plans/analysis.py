"""Queries over lines of documents: metrics, findings, roll-ups, document types."""

from __future__ import annotations

from pyspark.sql import functions as F

from storylake.functions import text as tx
from storylake.operators import corpus, extraction, findings, lines, rulebook
from storylake.sources.tables import table


def _markdown(spark, folder):
    """Documents with markdown woven in, so that fences, tables and headings occur."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    table_rows = F.lit("| a | b |\n|---|---|\n| 1 | 2 |")
    woven = F.concat_ws("\n", F.lit("# Title"), F.lit("## Overview"), F.substring("text", 1, 60), F.concat(F.lit("## "), F.col("lang")), table_rows, F.lit("```\ncode\n```"), F.col("text"), F.when(F.col("doc_id") % 3 == 0, "```\nopen end").otherwise("| tail |"))
    return docs.select("doc_id", woven.alias("text"))


def _lines(spark, folder):
    return lines.doc_lines(_markdown(spark, folder))


def _arrays(spark, folder):
    return lines.line_arrays(_markdown(spark, folder))


def _findings(spark, folder):
    found = lines.with_fences(lines.line_arrays(table(spark, folder, "documents")))
    return findings.scan(found, findings.rules(spark, list(rulebook.TEXT_NOISE)), outside_fences=True)


def _files(spark, folder):
    """Documents as files of a synthetic tree."""
    suffix = F.element_at(F.array(*map(F.lit, ("", "-discovery-notes", "-appendix-a", "-review", "-prd", "_design-doc"))), (F.col("doc_id") % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("product-brief", "research-report", "spec", "plain", "interview"))), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(kind, F.lit("-"), (F.floor(F.col("doc_id") / 6)).cast("string"), suffix, F.lit(".md"))
    return table(spark, folder, "documents").select("doc_id", name.alias("filename"), F.octet_length("text").alias("size_bytes"), "source")


def noise_trim(spark, folder):
    """Lines of a document without leading and trailing noise lines; interior noise stays."""
    found = table(spark, folder, "documents").select("doc_id", extraction.trimmed(tx.paragraphs(F.col("text")), (r"[#$%&*]{3}", "!!", r" \| ")).alias("l"))
    return found.select("doc_id", F.size("l").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("text_md5"))


def doc_lines_metrics(spark, folder):
    """Lines, words, characters, sections and tokens of every document."""
    docs = _markdown(spark, folder)
    return docs.select("doc_id", *(c.cast("long").alias(n) for n, c in lines.metrics(F.col("text")).items()), tx.byte_tokens(F.col("text")).alias("byte_tokens"), tx.code_point_tokens(F.col("text")).alias("char_tokens"))


def table_runs(spark, folder):
    """Tables and table lines of every document."""
    return lines.table_runs(_arrays(spark, folder))


def fence_blocks(spark, folder):
    """Fenced blocks of every document, some of them left open."""
    return lines.fence_blocks(_arrays(spark, folder))


def walls_of_text(spark, folder):
    """Walls of at least eight lines."""
    return lines.walls(lines.line_arrays(table(spark, folder, "documents")), least=8)


def section_extent(spark, folder):
    """Lines of every overview."""
    return lines.section_extent(_arrays(spark, folder), "Overview")


def section_inventory(spark, folder):
    """Headings of every document."""
    return lines.sections(_lines(spark, folder))


def rule_findings(spark, folder):
    """Findings of the noise rules, counted by line."""
    return _findings(spark, folder).groupBy("doc", "line_no", "severity", "category").agg(F.count("*").alias("n"))


def severity_rollup(spark, folder):
    """Severities of every document with findings."""
    return findings.roll_up(_findings(spark, folder), "doc")


def severity_open(spark, folder):
    """Findings by severity, unknown ones as well."""
    return findings.open_roll_up(_findings(spark, folder))


def category_rollup(spark, folder):
    """Closed set of categories as columns."""
    return findings.by_category(_findings(spark, folder), "doc", ["secret", "personal-data", "markup-noise", "shouting"])


def scan_status(spark, folder):
    """Status of every document under the four ways to derive it."""
    rolled = findings.roll_up(_findings(spark, folder), "doc")
    return rolled.select("doc", *(findings.status(k).alias(k) for k in ("path", "integrity", "dependencies", "validator")))


def corpus_routing(spark, folder):
    """Totals and routing of all documents."""
    return corpus.totals(_files(spark, folder))


def doc_type_classify(spark, folder):
    """Type and base name of every synthetic file."""
    return _files(spark, folder).select("doc_id", corpus.doc_type(F.col("filename")).alias("doc_type"), corpus.base_name(F.col("filename")).alias("base"))


def companion_groups(spark, folder):
    """Groups of base files and companions."""
    return corpus.groups(_files(spark, folder))


def metric_reduction(spark, folder):
    """How much a source shrinks without copies of a text."""
    docs = table(spark, folder, "documents").select("source", "text", F.length("text").alias("n"))
    old = docs.groupBy("source").agg(F.sum("n").alias("old"), F.count("*").alias("old_docs"))
    new = docs.select("source", "text", "n").distinct().groupBy("source").agg(F.sum("n").alias("new"), F.count("*").alias("new_docs"))
    return old.join(new, "source").select("source", lines.reduction(F.col("old"), F.col("new")).alias("chars"), lines.reduction(F.col("old_docs"), F.col("new_docs")).alias("docs"))


def number_gaps(spark, folder):
    """Missing line numbers of every order that lacks some."""
    items = table(spark, folder, "lineitem").where("(l_orderkey + l_linenumber) % 4 <> 0").select("l_orderkey", "l_linenumber")
    gaps = lines.number_gaps(items, "l_orderkey", "l_linenumber")
    return gaps.select("l_orderkey", F.array_join("missing", ",").alias("missing"))


QUERIES = {f.__name__: f for f in (noise_trim, doc_lines_metrics, table_runs, fence_blocks, walls_of_text, section_extent, section_inventory, rule_findings, severity_rollup, severity_open, category_rollup, scan_status, corpus_routing, doc_type_classify, companion_groups, metric_reduction, number_gaps)}

_WS = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_MD = """md AS (SELECT doc_id, concat_ws(chr(10), '# Title', '## Overview', substring(text, 1, 60), '## ' || lang, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |',
  '```' || chr(10) || 'code' || chr(10) || '```', text, CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || 'open end' ELSE '| tail |' END) AS text FROM documents)"""
_L = "l AS (SELECT doc_id AS doc, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM md)"
_F = f"""f AS (SELECT *, starts_with(regexp_replace(line, '^{_WS}+', ''), '```') AS is_fence FROM l),
  g AS (SELECT *, coalesce(sum(is_fence::INT) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence FROM f)"""
_RULES = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r[:3]) + ")" for r in rulebook.TEXT_NOISE)
_HITS = f"""l AS (SELECT doc_id AS doc, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
  {_F}, r(pattern, severity, category) AS (VALUES {_RULES}),
  h AS (SELECT doc, line_no, severity, category, len(regexp_extract_all(line, pattern)) AS n FROM g, r WHERE NOT is_fence AND NOT in_fence),
  x AS (SELECT * FROM h WHERE n > 0)"""
_ROLL = "SELECT doc, CAST(sum(n) AS BIGINT) AS total, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE severity = '{s}'), 0) AS BIGINT) AS n_{s}" for s in findings.SEVERITIES) + " FROM x GROUP BY doc"
_FILES = """files AS (SELECT doc_id, source, strlen(text) AS size_bytes,
  (['product-brief', 'research-report', 'spec', 'plain', 'interview'])[doc_id % 5 + 1] || '-' || CAST(doc_id // 6 AS VARCHAR) || (['', '-discovery-notes', '-appendix-a', '-review', '-prd', '_design-doc'])[doc_id % 6 + 1] || '.md' AS filename FROM documents)"""
_TYPES = "CASE " + " ".join(f"WHEN regexp_matches(lower(filename), '{p}') THEN '{k}'" for p, k in corpus.DOC_TYPES) + " ELSE 'unknown' END"
_BASE = "CASE " + " ".join(f"WHEN regexp_matches(filename, '(?i){p}') THEN regexp_replace(filename, '(?i){p}', '\\1.\\2')" for p in corpus.COMPANIONS) + " END"

ORACLES = {
    "noise_trim": f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
        g AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: NOT regexp_matches(l[i], '[#$%&*]{{3}}|!!| \\| ')) AS good FROM p),
        t AS (SELECT doc_id, CASE WHEN len(good) = 0 THEN [] ELSE l[list_min(good):list_max(good)] END AS t FROM g)
        SELECT doc_id, CAST(len(t) AS INTEGER) AS n_lines, md5(coalesce(array_to_string(t, chr(10)), '')) AS text_md5 FROM t""",
    "doc_lines_metrics": f"""WITH {_MD}, s AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM md), w AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM s)
        SELECT doc_id, CAST(len(l) - (l[-1] = '')::INT AS BIGINT) AS lines, CAST(words AS BIGINT) AS words, length(text) AS chars, CAST(len(list_filter(l, lambda x: starts_with(x, '## '))) AS BIGINT) AS sections,
          CAST(floor(words * 1.3::DOUBLE) AS BIGINT) AS estimated_tokens, CAST(strlen(text) // 4 AS BIGINT) AS byte_tokens, CAST(length(text) // 4 AS BIGINT) AS char_tokens FROM w""",
    "table_runs": f"""WITH {_MD}, {_L}, t AS (SELECT *, regexp_matches(line, '^\\s*\\|') AS is_table FROM l), s AS (SELECT *, is_table AND NOT coalesce(lag(is_table) OVER (PARTITION BY doc ORDER BY line_no), false) AS starts FROM t)
        SELECT doc, count(*) FILTER (WHERE starts) AS n_tables, count(*) FILTER (WHERE is_table) AS n_lines FROM s GROUP BY doc""",
    "fence_blocks": f"WITH {_MD}, {_L}, {_F} SELECT doc, count(*) FILTER (WHERE is_fence AND NOT in_fence) AS n_blocks, count(*) FILTER (WHERE NOT is_fence AND in_fence) AS n_lines FROM g GROUP BY doc",
    "walls_of_text": f"""WITH md AS (SELECT doc_id, text FROM documents), {_L}, b AS (SELECT *, regexp_matches(line, '{lines.WALL_BREAK}') AS breaks FROM l),
        i AS (SELECT *, sum(breaks::INT) OVER (PARTITION BY doc ORDER BY line_no) AS island FROM b)
        SELECT doc, CAST(min(line_no) AS INTEGER) AS line_no, count(*) AS n_lines FROM i WHERE NOT breaks GROUP BY doc, island HAVING count(*) >= 8""",
    "section_extent": f"""WITH {_MD}, {_L}, h AS (SELECT *, regexp_matches(line, '^##\\s') AS is_h2 FROM l), n AS (SELECT *, sum(is_h2::INT) OVER (PARTITION BY doc ORDER BY line_no) AS no FROM h),
        w AS (SELECT doc, min(no) AS wanted FROM n WHERE is_h2 AND starts_with(line, '## Overview') GROUP BY doc)
        SELECT n.doc, count(*) FILTER (WHERE NOT is_h2) AS n_lines FROM n JOIN w ON n.doc = w.doc AND no = wanted GROUP BY n.doc""",
    "section_inventory": f"""WITH {_MD}, {_L} SELECT doc, CAST(line_no AS INTEGER) AS line_no, CAST(length(regexp_extract(line, '^(#{{2,3}})\\s+(.+)$', 1)) AS INTEGER) AS level,
          regexp_replace(regexp_extract(line, '^(#{{2,3}})\\s+(.+)$', 2), '^{_WS}+|{_WS}+$', '', 'g') AS title FROM l WHERE regexp_matches(line, '^(#{{2,3}})\\s+(.+)$')""",
    "rule_findings": f"WITH {_HITS} SELECT doc, CAST(line_no AS INTEGER) AS line_no, severity, category, CAST(n AS BIGINT) AS n FROM x",
    "severity_rollup": f"WITH {_HITS} {_ROLL}",
    "severity_open": f"WITH {_HITS} SELECT severity, CAST(sum(n) AS BIGINT) AS n FROM (SELECT severity, n FROM x UNION ALL SELECT unnest(['critical', 'high', 'medium', 'low']), 0) GROUP BY severity",
    "category_rollup": f"WITH {_HITS} SELECT doc, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE category = '{c}'), 0) AS BIGINT) AS {c.replace('-', '_')}" for c in ("secret", "personal-data", "markup-noise", "shouting")) + " FROM x GROUP BY doc",
    "scan_status": f"""WITH {_HITS}, s AS ({_ROLL}) SELECT doc, CASE WHEN total = 0 THEN 'pass' ELSE 'fail' END AS path,
        CASE WHEN n_critical > 0 THEN 'fail' WHEN n_high > 0 THEN 'warning' ELSE 'pass' END AS integrity,
        CASE WHEN n_critical > 0 THEN 'fail' WHEN n_high > 0 OR n_medium > 0 THEN 'warning' ELSE 'pass' END AS dependencies,
        CASE WHEN n_critical > 0 OR n_high > 0 THEN 'fail' ELSE 'pass' END AS validator FROM s""",
    "corpus_routing": f"""WITH {_FILES}, t AS (SELECT count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(sum(size_bytes) // 4 AS BIGINT) AS estimated_tokens FROM files)
        SELECT *, CASE WHEN n_files <= 3 AND estimated_tokens <= 15000 THEN 'single' ELSE 'fan-out' END AS routing, estimated_tokens // 3 > 5000 AS split_likely FROM t""",
    "doc_type_classify": f"WITH {_FILES} SELECT doc_id, {_TYPES} AS doc_type, {_BASE} AS base FROM files",
    "companion_groups": f"""WITH {_FILES}, k AS (SELECT filename, {_BASE} AS base FROM files)
        SELECT coalesce(base, filename) AS group_key, filename, CASE WHEN base IS NOT NULL THEN 'companion' WHEN filename IN (SELECT base FROM k WHERE base IS NOT NULL) THEN 'primary' ELSE 'standalone' END AS role FROM k""",
    "metric_reduction": """WITH o AS (SELECT source, sum(length(text)) AS oc, count(*) AS od FROM documents GROUP BY source), n AS (SELECT source, sum(length(text)) AS nc, count(*) AS nd FROM (SELECT DISTINCT source, text FROM documents) GROUP BY source)
        SELECT source, CAST(CAST(round_even((1 - nc / oc) * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS chars, CAST(CAST(round_even((1 - nd / od) * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS docs FROM o JOIN n USING (source)""",
    "number_gaps": """WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS seen FROM lineitem WHERE (l_orderkey + l_linenumber) % 4 <> 0 GROUP BY l_orderkey),
        m AS (SELECT l_orderkey, list_filter(range(seen[1], seen[1] + len(seen)), lambda x: NOT list_contains(seen, x)) AS missing FROM s)
        SELECT l_orderkey, array_to_string(missing, ',') AS missing FROM m WHERE len(missing) > 0""",
}
