"""Queries of settings, module checks, reports and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from storylake.operators import config, modules, reports, scripts
from storylake.sources.tables import table


def config_state(spark, folder):
    """State of every customer's settings."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select("c_custkey", config.state(key % 7 != 0, key % 3 != 0, key % 2 == 0).alias("state"))


def nearest_marker(spark, folder):
    """Nearest marked directory of every document's path."""
    paths = table(spark, folder, "documents").select(F.concat_ws("/", "source", "lang", (F.col("doc_id") % 5).cast("string")).alias("path")).distinct()
    marks = table(spark, folder, "documents").where("doc_id % 11 = 0").select(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.concat_ws("/", "source", "lang")).alias("dir"))
    return config.nearest_marked(paths, marks).select("path", F.coalesce("root", F.lit("-")).alias("root"))


def search_path(spark, folder):
    """First of three places that exists, for every supplier."""
    rows = table(spark, folder, "supplier").select("s_suppkey", F.posexplode(F.array(*(F.concat(F.lit(p), (F.col("s_suppkey") % 13).cast("string")) for p in ("a/", "b/", "c/")))).alias("ord", "path"))
    there = table(spark, folder, "nation").select(F.concat(F.element_at(F.array(F.lit("a/"), F.lit("b/"), F.lit("c/")), F.col("n_nationkey") % 3 + 1), F.col("n_nationkey").cast("string")).alias("path"))
    return config.first_existing(rows, there, "s_suppkey").select("s_suppkey", F.coalesce("path", F.lit("-")).alias("path"))


def _catalog(spark, folder):
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("row_no"), F.concat(F.lit("skill-"), (F.col("s_suppkey") % 40).cast("string")).alias("skill"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("run").alias("action"),
        F.concat(F.lit("C"), (F.col("s_suppkey") % 60).cast("string")).alias("code"), F.col("s_name").alias("name"),
        F.concat(F.lit("skill-"), (F.col("s_suppkey") % 50).cast("string"), F.lit(":run")).alias("after"), F.lit("").alias("before"),
    )


def module_findings(spark, folder):
    """Integrity of a catalog made of suppliers."""
    folders = table(spark, folder, "part").select(F.concat(F.lit("skill-"), F.col("p_partkey").cast("string")).alias("skill"))
    return modules.check(_catalog(spark, folder), folders).groupBy("severity", "category", "detail").agg(F.count("*").alias("n"))


def help_next(spark, folder):
    """What to do next where parts are the catalog, their sizes its phases, and the first phases and parts returned in bulk are done."""
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias("code")
    part = table(spark, folder, "part")
    catalog = part.select(name("p_partkey"), F.col("p_size").alias("phase"), F.col("p_partkey").alias("ord"), (~F.contains("p_type", F.lit("BRASS"))).alias("required"))
    done = part.where("p_size < 3").select(name("p_partkey")).unionByName(table(spark, folder, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(name("l_partkey")))
    return modules.next_steps(catalog, done)


def report_status(spark, folder):
    """Reports of events by user, some with a count or rank of their own."""
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").cast("int").alias("n"))
    made = rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("user_id").cast("int").alias("ord"), F.when(F.col("user_id") % 5 == 0, 1).alias("rank"), F.lit(None).cast("string").alias("status"), F.when(F.col("user_id") % 2 == 0, F.col("n")).alias("finding_count"), F.lit(None).cast(f"array<{reports.FINDING}>").alias("findings"))
    return reports.normalised(made)


def compression_ratio(spark, folder):
    """Characters of a language against those of its distinct texts."""
    docs = table(spark, folder, "documents").select("lang", "text", F.length("text").alias("n"))
    whole = docs.groupBy("lang").agg(F.sum("n").alias("a"))
    return whole.join(docs.distinct().groupBy("lang").agg(F.sum("n").alias("b")), "lang").select("lang", reports.ratio(F.col("a"), F.col("b")).alias("ratio"), reports.bar_width(F.col("b"), F.col("a")).alias("width"))


def script_inventory(spark, folder):
    """Every script of a synthetic tree with its language, and whether it has a test."""
    ending = F.element_at(F.array(*map(F.lit, (".py", ".sh", ".ts", ".md"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    parts = table(spark, folder, "part")
    files = parts.select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), ending).alias("path"))
    tests = parts.where("p_partkey % 3 = 0").select(F.concat(F.lit("tests/test_p"), F.col("p_partkey").cast("string"), ending).alias("path"))
    return scripts.inventory(files.union(tests))


def script_languages(spark, folder):
    """Scripts by language, and how many lack a test."""
    return scripts.by_language(script_inventory(spark, folder))


QUERIES = {f.__name__: f for f in (config_state, nearest_marker, search_path, module_findings, help_next, report_status, compression_ratio, script_inventory, script_languages)}

ORACLES = {
    "config_state": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'no_project' WHEN c_custkey % 2 = 0 THEN 'ready' WHEN c_custkey % 3 = 0 THEN 'core_missing' ELSE 'module_missing' END AS state FROM customer",
    "nearest_marker": """WITH p AS (SELECT DISTINCT source, lang, doc_id % 5 AS k FROM documents), m AS (SELECT CASE WHEN doc_id % 2 = 0 THEN source ELSE source || '/' || lang END AS dir FROM documents WHERE doc_id % 11 = 0)
        SELECT source || '/' || lang || '/' || k AS path, CASE WHEN source || '/' || lang IN (SELECT dir FROM m) THEN source || '/' || lang WHEN source IN (SELECT dir FROM m) THEN source ELSE '-' END AS root FROM p""",
    "search_path": """WITH t AS (SELECT (['a/', 'b/', 'c/'])[n_nationkey % 3 + 1] || n_nationkey AS path FROM nation), k AS (SELECT s_suppkey, s_suppkey % 13 AS k FROM supplier)
        SELECT s_suppkey, CASE WHEN 'a/' || k IN (SELECT path FROM t) THEN 'a/' || k WHEN 'b/' || k IN (SELECT path FROM t) THEN 'b/' || k WHEN 'c/' || k IN (SELECT path FROM t) THEN 'c/' || k ELSE '-' END AS path FROM k""",
    "module_findings": """WITH c AS (SELECT s_suppkey AS row_no, 'skill-' || s_suppkey % 40 AS skill, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'run' END AS action, 'C' || s_suppkey % 60 AS code, s_name AS name, 'skill-' || s_suppkey % 50 || ':run' AS ref FROM supplier),
        f AS (SELECT 'skill-' || p_partkey AS skill FROM part),
        a AS (SELECT 'high' AS severity, 'missing-entry' AS category, skill AS detail FROM f WHERE skill NOT IN (SELECT skill FROM c)
          UNION ALL SELECT DISTINCT 'high', 'orphan-entry', skill FROM c WHERE skill NOT IN (SELECT skill FROM f)
          UNION ALL SELECT 'high', 'duplicate-code', code || ': ' || string_agg(name, ', ' ORDER BY row_no) FROM c GROUP BY code HAVING count(*) > 1
          UNION ALL SELECT 'medium', 'invalid-after', skill || ' -> ' || ref FROM c WHERE ref NOT IN (SELECT skill || ':' || action FROM c WHERE action <> ''))
        SELECT severity, category, detail, count(*) AS n FROM a GROUP BY ALL""",
    "help_next": """WITH l AS (SELECT 'p' || p_partkey AS code, p_size AS phase, p_partkey AS ord, p_type NOT LIKE '%BRASS%' AS required FROM part WHERE p_size >= 3 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)),
        r AS (SELECT phase, ord FROM l WHERE required ORDER BY phase, ord LIMIT 1)
        SELECT l.code, l.phase, l.ord, l.required FROM l, r WHERE l.phase = r.phase AND (NOT l.required OR l.ord = r.ord)""",
    "report_status": """WITH r AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY user_id), c AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN n ELSE 0 END AS n FROM r)
        SELECT 'u' || user_id AS name, CASE WHEN user_id % 5 = 0 THEN 1 ELSE CAST(user_id AS INTEGER) + 1 END AS rank, CAST(n AS INTEGER) AS finding_count, CASE WHEN n = 0 THEN 'good' ELSE 'needs-attention' END AS status FROM c""",
    "compression_ratio": """WITH a AS (SELECT lang, sum(length(text)) AS a FROM documents GROUP BY lang), b AS (SELECT lang, sum(length(text)) AS b FROM (SELECT DISTINCT lang, text FROM documents) GROUP BY lang)
        SELECT lang, printf('%.1f:1', a::DOUBLE / b::DOUBLE) AS ratio, round(b::DOUBLE / a::DOUBLE * 100, 1) AS width FROM a JOIN b USING (lang)""",
    "script_inventory": """WITH p AS (SELECT p_partkey AS k, (['.py', '.sh', '.ts', '.md'])[p_partkey % 4 + 1] AS e FROM part), s AS (SELECT k, 'p' || k || e AS name, CASE e WHEN '.py' THEN 'python' WHEN '.sh' THEN 'shell' ELSE 'node' END AS language FROM p WHERE e <> '.md')
        SELECT 'src/' || name AS path, name, language, k % 3 = 0 AS tested FROM s""",
    "script_languages": """WITH p AS (SELECT p_partkey AS k, (['.py', '.sh', '.ts', '.md'])[p_partkey % 4 + 1] AS e FROM part WHERE p_partkey % 4 <> 3)
        SELECT CASE e WHEN '.py' THEN 'python' WHEN '.sh' THEN 'shell' ELSE 'node' END AS language, count(*) AS n, count(*) FILTER (WHERE k % 3 <> 0) AS n_untested FROM p GROUP BY ALL""",
}
