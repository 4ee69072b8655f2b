"""Queries of settings, arguments, module definitions and catalogs, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storylake.operators import config, findings, modules, tracking
from storylake.operators.merge import parsed_spec
from storylake.sources import nested
from storylake.sources import settings as source
from storylake.sources.tables import table


def _shown(settings):
    """A map as one text, keys in order; nulls as ``-``."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(settings), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))), ";")


def _customers(spark, folder):
    """Customers with settings of their own."""
    key = F.col("c_custkey")
    own = F.create_map(F.lit("user_name"), F.col("c_name"), F.lit("output"), F.concat(F.lit("{project-root}/out/"), F.lower("c_mktsegment")), F.lit("version"), F.when(key % 3 == 0, key.cast("string")), F.lit("name"), F.concat(F.lit("m"), (key % 7).cast("string")), F.lit("secret"), F.lit("x"))
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", own.alias("own"))


def config_resolved(spark, folder):
    """Every customer's settings with the project's root resolved, and those that a specification asks for."""
    found = _customers(spark, folder).withColumn("all", config.rooted(F.col("own"), F.concat(F.lit("/p"), F.col("c_nationkey").cast("string"))))
    spec = parsed_spec(F.lit("output,missing:none, name"))
    asked = F.map_from_entries(F.transform(F.map_entries(spec), lambda e: F.struct(e["key"], F.coalesce(F.try_element_at("all", e["key"]), e["value"]))))
    return found.select("c_custkey", _shown(F.col("all")).alias("settings"), _shown(asked).alias("asked"))


def config_kept(spark, folder):
    """Settings by scope: core ones, those that are not the user's, and the metadata."""
    own = F.col("own")
    return _customers(spark, folder).select("c_custkey", _shown(config.only(own, ("user_name", "output"))).alias("core"), _shown(config.without(own, ("user_name", "secret"))).alias("shared"), _shown(config.metadata(own)).alias("meta"))


def config_written(spark, folder):
    """Variables of every customer written in order, each filled from those before."""
    v = lambda name, default, result=None: F.struct(F.lit(name).alias("name"), F.lit(default).alias("default"), F.lit(result).cast("string").alias("result"))
    variables = F.array(v("root", "{segment}-root"), v("docs", "{root}/docs", "{project-root}/{value}"), v("plan", "{docs}/plan"), v("user", "nobody", "<{value}>"))
    answers = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("docs"), F.lit("mine"), F.lit("user"), F.col("c_mktsegment"))).otherwise(F.create_map(F.lit("plan"), F.lit("{project-root}/p"), F.lit("user"), F.lit("")))
    context = F.create_map(F.lit("segment"), F.lower("c_mktsegment"))
    done = table(spark, folder, "customer").select("c_custkey", F.posexplode(config.written_settings(variables, answers, context)).alias("ord", "v"))
    return done.select("c_custkey", "ord", "v.name", "v.value")


def default_answers(spark, folder):
    """Defaults of variables filled from each customer's answers."""
    answers = F.create_map(F.lit("project"), F.col("c_name"), F.lit("lang"), F.when(F.col("c_mktsegment") == "BUILDING", "en").otherwise(""))
    variables = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(d).alias("default")) for n, d in (("lang", "de"), ("folder", "{project}/out"), ("note", "plain"))))
    rows = table(spark, folder, "customer").select(answers.alias("answers"), F.explode(variables).alias("v")).select("answers", "v.*")
    return config.expanded_defaults(rows, F.col("answers")).groupBy("name", "value").agg(F.count("*").alias("n"))


def key_value_args(spark, folder):
    """Arguments of every order: one with a faulty pair, others with repeated keys."""
    key = F.col("o_orderkey").cast("string")
    pairs = F.array(F.concat(F.lit("a="), key), F.when(F.col("o_orderkey") % 5 == 0, F.lit("=x")).when(F.col("o_orderkey") % 5 == 1, F.lit("none")).otherwise(F.lit("b=1=2")), F.concat(F.lit("a=again-"), F.col("o_orderstatus")))
    found = table(spark, folder, "orders").select("o_orderkey", config.arguments(pairs).alias("r"))
    return found.select("o_orderkey", "r.ok", _shown(F.col("r.settings")).alias("settings"))


def settings_scan(spark, folder):
    """Settings read from lines woven out of every supplier."""
    lines = F.concat_ws("\n", F.lit("# about"), F.concat(F.lit("name: \""), F.col("s_name"), F.lit("\"")), F.lit("- item: no"), F.lit("folded: >"), F.lit("empty:"), F.concat(F.lit("  url:  http://x/"), F.col("s_suppkey").cast("string")), F.when(F.col("s_suppkey") % 2 == 0, "name: later"))
    return table(spark, folder, "supplier").select("s_suppkey", _shown(source.key_values(lines)).alias("settings"))


def catalog_cells(spark, folder):
    """Cells of a CSV line a part, some quoted, some rows short."""
    line = F.concat(F.lit('"'), F.replace(F.col("p_name"), F.lit(" "), F.lit(', ""x"" ')), F.lit('",'), F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(",,"), F.col("p_type"))))
    cells = source.csv_cells(line)
    return table(spark, folder, "part").select("p_partkey", F.size(cells).alias("n"), F.array_join(cells, "|").alias("cells"))


def _module_files(spark, folder):
    """A listing of two folders a module; some modules have a setup folder, some one skill only."""
    key = F.col("p_partkey")
    module, own = F.concat(F.lit("m"), F.floor(key / 2).cast("string")), F.concat(F.lit("k"), (key % 50).cast("string"))
    kind = F.floor(key / 2) % 4
    paths = F.array(
        F.when((kind != 1) | (key % 2 == 0), F.concat(own, F.lit("/SKILL.md"))), F.when((kind == 1) & (key % 2 == 0), F.concat(own, F.lit("/assets/module.yaml"))), F.when(kind == 2, F.lit("a-setup/SKILL.md")),
        F.when((kind == 2) & (key % 3 == 0), F.lit("a-setup/assets/module.yaml")), F.when(kind == 2, F.concat(F.lit("z-setup/assets/x"), key.cast("string"))), F.when(kind == 3, F.concat(own, F.lit("/scripts/merge-config.py"))), F.concat(own, F.lit("/notes.tmp")),
    )
    return table(spark, folder, "part").select(module.alias("module"), F.explode(F.filter(paths, lambda p: p.isNotNull())).alias("path"))


def module_structure(spark, folder):
    """Kind of every module, its folder and what that lacks."""
    return modules.structure(_module_files(spark, folder))


def module_file_counts(spark, folder):
    """Files below every folder."""
    return modules.file_counts(_module_files(spark, folder))


def module_copy_set(spark, folder):
    """Files to copy, temporary notes left out."""
    return modules.copy_set(_module_files(spark, folder), ("notes.tmp",))


def cleanup_targets(spark, folder):
    """Folders to clean up for every part, each once."""
    extras = F.array(F.col("p_brand"), F.lit("core"), F.col("p_type"), F.col("p_brand"))
    return table(spark, folder, "part").select("p_partkey", F.array_join(modules.cleanup_targets(F.col("p_type"), extras), ",").alias("targets"))


def skills_not_installed(spark, folder):
    """Skill folders of modules that the installed tree lacks."""
    installed = table(spark, folder, "supplier").select(F.concat(F.lit("tools/k"), (F.col("s_suppkey") % 60).cast("string"), F.when(F.col("s_suppkey") % 4 == 0, "/x.md").otherwise("/SKILL.md")).alias("path"))
    return modules.not_installed(modules.skill_folders(_module_files(spark, folder)), installed)


def capability_tables(spark, folder):
    """Tables of what every brand's parts offer, those without a code left out."""
    rows = table(spark, folder, "part").select(F.col("p_brand").alias("module"), F.format_string("%09d.md", "p_partkey").alias("path"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("code"), F.when(F.col("p_size") > 10, F.concat(F.lit("P"), F.col("p_size").cast("string"))).otherwise("")).alias("f"))
    return modules.capabilities(rows, F.col("f")).select("module", "n", F.md5("table").alias("table_md5"))


def catalog_findings(spark, folder):
    """Findings of a catalog an order, whose lines are its entries."""
    text = lambda c: F.col(c).cast("string")
    head = F.when(F.col("o_orderkey") % 4 == 0, F.array(*map(F.lit, (*modules.CATALOG[:-1], "extra")))).otherwise(F.array(*map(F.lit, modules.CATALOG)))
    header = table(spark, folder, "orders").select(text("o_orderkey").alias("module"), F.lit(1).alias("row_no"), head.alias("cells"))
    blank = F.lit("")
    cells = F.array(blank, text("l_partkey"), F.when(F.col("l_linenumber") == 2, " ").otherwise("shown"), text("l_suppkey"), F.when(F.col("l_returnflag") == "A", "").otherwise("told"), *([blank] * 7), blank)
    lines = table(spark, folder, "lineitem").select(text("l_orderkey").alias("module"), (F.col("l_linenumber") + 1).cast("int").alias("row_no"), F.when(F.col("l_linenumber") == 3, F.slice(cells, 1, 5)).otherwise(cells).alias("cells"))
    return modules.catalog_findings(header.unionByName(lines)).groupBy("severity", "category", "detail").agg(F.count("*").alias("n"))


def module_verdicts(spark, folder):
    """Verdict on a module an order: folders and catalog entries from its lines, a definition as text; some without setup, files or entries."""
    text = lambda c: F.col(c).cast("string")
    orders, lines = table(spark, folder, "orders").select(F.col("o_orderkey").alias("m"), "o_orderstatus"), table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("m"), "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    setup = F.array(*(F.lit(f) for f in ("x-setup/SKILL.md", "x-setup/assets/module.yaml", "x-setup/assets/module-help.csv")))
    own = orders.select("m", F.explode(F.when(F.col("m") % 8 == 0, F.array(F.lit("notes.md"))).when(F.col("m") % 9 == 0, F.slice(setup, 1, 2)).otherwise(setup)).alias("path"))
    listing = own.unionByName(lines.select("m", F.concat(F.lit("k"), text("l_partkey"), F.lit("/SKILL.md")).alias("path"))).select(text("m").alias("module"), "path")
    yaml = F.concat(F.lit("# made\ncode: "), F.when(F.col("m") % 7 == 0, "").otherwise(text("m")), F.lit('\nname: "Order: '), F.col("o_orderstatus"), F.lit('"\ndescription: of lines\n'))
    skill = F.concat(F.lit("k"), text("l_partkey"))
    cells = F.concat_ws(",", F.lit("mod"), F.when(F.col("l_linenumber") == 4, "ghost").otherwise(skill), F.when(F.col("l_linenumber") == 2, " ").otherwise('"Shown, so"'), F.concat(F.lit("C"), (F.col("l_suppkey") % 50).cast("string")), F.lit("told"), F.lit("run"), F.lit(""), F.lit(""), F.when(F.col("l_linenumber") == 3, "k0:run").otherwise(F.concat(skill, F.lit(":run"))), F.lit(""), F.lit(""), F.lit(""), F.lit(""))
    head = F.concat(F.lit(",".join(modules.CATALOG[:-1])), F.when(F.col("m") % 5 == 0, ",other").otherwise(f",{modules.CATALOG[-1]}"))
    rows = orders.select("m", F.lit(1).alias("row_no"), head.alias("line")).unionByName(lines.where("m % 11 > 0").select("m", (F.col("l_linenumber") + 1).alias("row_no"), cells.alias("line")))
    catalogs = rows.select(text("m").alias("module"), "row_no", source.csv_cells(F.col("line")).alias("cells"))
    _, verdict = modules.verdicts(listing, orders.select(text("m").alias("module"), source.key_values(yaml).alias("settings")), catalogs)
    return verdict.select("module", "status", "total", "n_critical", "n_high", "n_medium", "kind", *(F.coalesce(c, F.lit("-")).alias(c) for c in ("code", "name")), F.coalesce("n_entries", F.lit(-1)).alias("n_entries"))


def yaml_nested(spark, folder):
    """Every order as nested YAML, its lines a list of mappings in one of two layouts, read back as paths."""
    text = lambda c: F.col(c).cast("string")
    pad = F.when(F.col("l_orderkey") % 2 == 0, "  ").otherwise("")
    line = F.concat(pad, F.lit("- part: "), text("l_partkey"), F.lit("  # no part of it\n"), pad, F.lit("  note: '"), F.col("l_returnflag"), F.lit(": # kept'\n"), pad, F.lit("  tags:\n"), pad, F.lit("    - "), F.col("l_linestatus"), F.lit("\n"), pad, F.lit('    - "'), text("l_suppkey"), F.lit('"'))
    listed = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    orders = table(spark, folder, "orders").join(listed, "o_orderkey")
    whole = F.concat(F.lit("---\n# an order\norder:\n  key: "), text("o_orderkey"), F.lit("\n  customer:\n    id: "), text("o_custkey"), F.lit("\n    about: >\n      folded: text\n      - more\n  status: "), F.col("o_orderstatus"), F.lit("\nlines:\n"), F.col("lines"), F.lit("\nend: [a, b]\n"))
    return nested.yaml_rows(orders.select("o_orderkey", whole.alias("text")), "o_orderkey", "text")


def definition_findings(spark, folder):
    """Fields that every customer's definition lacks: the lines of its orders' priorities (``1-URGENT`` gives ``code``, ``2-HIGH`` a name, ``5-LOW`` a description) are parsed as settings."""
    orders = table(spark, folder, "orders")
    field = F.element_at(F.array(*map(F.lit, ("code", "name", "title", "code", "description"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    line = F.concat(field, F.lit(": "), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderkey").cast("string")))
    listed = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return modules.definition_findings(listed.select(F.col("o_custkey").alias("module"), source.key_values(text).alias("settings")))


def orphan_stories(spark, folder):
    """Stories of orders whose epic isn't there, and running epics without a story."""
    orders = table(spark, folder, "orders")
    key = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("epic-"), F.col("o_custkey").cast("string"))).otherwise(F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit("story")))
    return tracking.loose_ends(orders.select(key.alias("key"), F.when(F.col("o_orderstatus") == "O", "in-progress").otherwise("done").alias("status")))


def open_categories(spark, folder):
    """Events by type as an open set of categories."""
    return findings.open_categories(table(spark, folder, "events").select(F.col("event_type").alias("category"), (F.col("user_id") % 10).alias("key")), "key").select("key", _shown(F.transform_values("counts", lambda _, n: n.cast("string"))).alias("counts"))


QUERIES = {
    f.__name__: f
    for f in (
        config_resolved, config_kept, config_written, default_answers, key_value_args, settings_scan, catalog_cells, module_structure, module_file_counts, module_copy_set, cleanup_targets,
        skills_not_installed, capability_tables, catalog_findings, module_verdicts, yaml_nested, definition_findings, orphan_stories, open_categories,
    )
}

_OWN = """c AS (SELECT c_custkey, c_nationkey, c_name, '{project-root}/out/' || lower(c_mktsegment) AS output, 'm' || c_custkey % 7 AS name, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '-' END AS version FROM customer)"""
_MODULES = """f AS (SELECT 'm' || p_partkey // 2 AS module, p_partkey AS k, (p_partkey // 2) % 4 AS kind, 'k' || p_partkey % 50 AS own FROM part),
  files AS (SELECT module, own || '/SKILL.md' AS path FROM f WHERE kind <> 1 OR k % 2 = 0 UNION ALL SELECT module, own || '/assets/module.yaml' FROM f WHERE kind = 1 AND k % 2 = 0 UNION ALL SELECT module, 'a-setup/SKILL.md' FROM f WHERE kind = 2
    UNION ALL SELECT module, 'a-setup/assets/module.yaml' FROM f WHERE kind = 2 AND k % 3 = 0 UNION ALL SELECT module, 'z-setup/assets/x' || k FROM f WHERE kind = 2 UNION ALL SELECT module, own || '/scripts/merge-config.py' FROM f WHERE kind = 3
    UNION ALL SELECT module, own || '/notes.tmp' FROM f)"""
_HEAD = "[" + ", ".join(f"'{c}'" for c in modules.CATALOG) + "]"

ORACLES = {
    "config_resolved": f"""WITH {_OWN} SELECT c_custkey, 'name=' || name || ';output=' || replace(output, '{{project-root}}', '/p' || c_nationkey) || ';secret=x;user_name=' || c_name || ';version=' || version AS settings,
        'missing=none;name=' || name || ';output=' || replace(output, '{{project-root}}', '/p' || c_nationkey) AS asked FROM c""",
    "config_kept": f"WITH {_OWN} SELECT c_custkey, 'output=' || output || ';user_name=' || c_name AS core, 'name=' || name || ';output=' || output || ';version=' || version AS shared, 'name=' || name || ';version=' || version AS meta FROM c",
    "config_written": """WITH c AS (SELECT c_custkey, lower(c_mktsegment) || '-root' AS root, c_custkey % 2 = 0 AS even, c_mktsegment AS seg FROM customer),
        d AS (SELECT *, '{project-root}/' || CASE WHEN even THEN 'mine' ELSE root || '/docs' END AS docs FROM c)
        SELECT c_custkey, CAST(0 AS INTEGER) AS ord, 'root' AS name, root AS value FROM d UNION ALL SELECT c_custkey, 1, 'docs', docs FROM d
        UNION ALL SELECT c_custkey, 2, 'plan', CASE WHEN even THEN docs || '/plan' ELSE '{project-root}/p' END FROM d UNION ALL SELECT c_custkey, 3, 'user', '<' || CASE WHEN even THEN seg ELSE 'nobody' END || '>' FROM d""",
    "default_answers": """SELECT name, value, count(*) AS n FROM (SELECT 'lang' AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'en' ELSE 'de' END AS value FROM customer UNION ALL SELECT 'folder', c_name || '/out' FROM customer UNION ALL SELECT 'note', 'plain' FROM customer) GROUP BY ALL""",
    "key_value_args": "SELECT o_orderkey, o_orderkey % 5 > 1 AS ok, 'a=again-' || o_orderstatus || CASE WHEN o_orderkey % 5 > 1 THEN ';b=1=2' ELSE '' END AS settings FROM orders",
    "settings_scan": "SELECT s_suppkey, 'name=' || CASE WHEN s_suppkey % 2 = 0 THEN 'later' ELSE s_name END || ';url=http://x/' || s_suppkey AS settings FROM supplier",
    "catalog_cells": """WITH l AS (SELECT p_partkey, '"' || replace(p_name, ' ', ', ""x"" ') || '",' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',,' || p_type END AS line FROM part),
        c AS (SELECT p_partkey, list_transform(regexp_extract_all(line || ',', '("(?:[^"]|"")*"|[^,"]*),', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substring(x, 2, length(x) - 2), '""', '"') ELSE x END) AS c FROM l)
        SELECT p_partkey, CAST(len(c) AS INTEGER) AS n, array_to_string(c, '|') AS cells FROM c""",
    "module_structure": f"""WITH {_MODULES}, s AS (SELECT module, min(string_split(path, '/')[1]) FILTER (WHERE string_split(path, '/')[1] LIKE '%-setup') AS setup,
          count(DISTINCT string_split(path, '/')[1]) FILTER (WHERE path LIKE '%/SKILL.md') AS n, min(string_split(path, '/')[1]) FILTER (WHERE path LIKE '%/SKILL.md') AS single FROM files GROUP BY module),
        k AS (SELECT module, CASE WHEN setup IS NOT NULL THEN 'setup' WHEN n = 1 AND (module, single || '/assets/module.yaml') IN (SELECT module, path FROM files) THEN 'standalone' ELSE 'none' END AS kind, setup, single FROM s),
        w AS (SELECT module, kind, coalesce(setup, CASE WHEN kind = 'standalone' THEN single END) AS folder, CASE kind WHEN 'setup' THEN ['SKILL.md', 'assets/module.yaml', 'assets/module-help.csv']
          WHEN 'standalone' THEN ['assets/module.yaml', 'assets/module-help.csv', 'assets/module-setup.md', 'scripts/merge-config.py', 'scripts/merge-help-csv.py'] END AS files FROM k),
        x AS (SELECT module, string_agg(file, ', ' ORDER BY file) AS missing FROM (SELECT module, folder, unnest(files) AS file FROM w) WHERE (module, folder || '/' || file) NOT IN (SELECT module, path FROM files) GROUP BY module)
        SELECT w.module, kind, coalesce(folder, '') AS folder, coalesce(missing, '') AS missing FROM w LEFT JOIN x USING (module)""",
    "module_file_counts": f"WITH {_MODULES}, p AS (SELECT string_split(module || '/' || path, '/') AS p FROM files) SELECT array_to_string(p[1:n], '/') AS folder, count(*) AS n_files FROM (SELECT p, unnest(range(1, len(p))) AS n FROM p) GROUP BY ALL",
    "module_copy_set": f"WITH {_MODULES} SELECT DISTINCT module, path FROM files WHERE path NOT LIKE '%/notes.tmp'",
    "cleanup_targets": "SELECT p_partkey, p_type || ',core,' || p_brand AS targets FROM part",
    "skills_not_installed": f"WITH {_MODULES} SELECT DISTINCT string_split(path, '/')[1] AS folder FROM files WHERE path LIKE '%/SKILL.md' AND string_split(path, '/')[1] NOT IN (SELECT 'k' || s_suppkey % 60 FROM supplier WHERE s_suppkey % 4 <> 0)",
    "capability_tables": "SELECT p_brand AS module, CAST(count(*) AS INTEGER) AS n, md5(string_agg('| [P' || p_size || '] | ' || p_name || ' |  |', chr(10) ORDER BY p_partkey)) AS table_md5 FROM part WHERE p_size > 10 GROUP BY p_brand",
    "catalog_findings": f"""WITH h AS (SELECT o_orderkey AS m, o_orderkey % 4 = 0 AS odd FROM orders), l AS (SELECT l_orderkey AS m, l_linenumber AS i, l_returnflag AS flag FROM lineitem),
        a AS (SELECT 'high' AS severity, 'csv-header' AS category, 'missing: outputs; extra: extra' AS detail FROM h WHERE odd
          UNION ALL SELECT 'high', 'csv-empty', '' FROM h WHERE m NOT IN (SELECT m FROM l) UNION ALL SELECT 'medium', 'csv-columns', '4: 5' FROM l WHERE i = 3
          UNION ALL SELECT 'high', 'missing-field', (i + 1) || ': display-name' FROM l JOIN h USING (m) WHERE i = 2 UNION ALL SELECT 'high', 'missing-field', (i + 1) || ': description' FROM l JOIN h USING (m) WHERE flag = 'A')
        SELECT severity, category, detail, count(*) AS n FROM a GROUP BY ALL""",
    "module_verdicts": """WITH o AS (SELECT o_orderkey AS m, o_orderstatus AS st FROM orders),
        l AS (SELECT l_orderkey AS m, 'k' || l_partkey AS k, l_linenumber AS i, ',' || CASE l_linenumber WHEN 4 THEN 'ghost' ELSE 'k' || l_partkey END || ',' || CASE l_linenumber WHEN 2 THEN ' ' ELSE 'Shown' END || ',C' || l_suppkey % 50 || ',told,run,,,'
              || CASE l_linenumber WHEN 3 THEN 'k0' ELSE 'k' || l_partkey END || ':run,,,,' AS line FROM lineitem),
        stop AS (SELECT m, CASE WHEN m % 8 <> 0 THEN 'setup' ELSE 'none' END AS kind, CASE WHEN m % 8 = 0 OR m % 9 = 0 THEN 1 ELSE 0 END AS stop FROM o),
        e AS (SELECT l.m, i, k, string_split(line, ',') AS c FROM l JOIN stop USING (m) WHERE stop = 0 AND m % 11 <> 0),
        p AS (SELECT m, i, k, trim(c[2]) AS skill, trim(c[3]) AS name, trim(c[4]) AS code, trim(c[6]) AS action, trim(c[9]) AS after FROM e),
        a AS (SELECT m, 'critical' AS s FROM stop WHERE stop = 1
          UNION ALL SELECT m, 'high' FROM stop WHERE stop = 0 AND m % 7 = 0 UNION ALL SELECT m, 'high' FROM stop WHERE stop = 0 AND m % 5 = 0
          UNION ALL SELECT m, 'high' FROM stop WHERE stop = 0 AND (m % 11 = 0 OR m NOT IN (SELECT m FROM l))
          UNION ALL SELECT m, 'high' FROM p WHERE name = ''
          UNION ALL SELECT m, 'high' FROM (SELECT DISTINCT m, k FROM p WHERE (m, k) NOT IN (SELECT m, skill FROM p))
          UNION ALL SELECT m, 'high' FROM (SELECT DISTINCT m, skill FROM p WHERE (m, skill) NOT IN (SELECT m, k FROM p))
          UNION ALL SELECT m, 'high' FROM (SELECT m, code FROM p GROUP BY ALL HAVING count(*) > 1)
          UNION ALL SELECT m, 'medium' FROM p WHERE (m, after) NOT IN (SELECT m, skill || ':' || action FROM p)),
        n AS (SELECT m, count(*) AS total, count(*) FILTER (s = 'critical') AS n_critical, count(*) FILTER (s = 'high') AS n_high, count(*) FILTER (s = 'medium') AS n_medium FROM a GROUP BY m),
        x AS (SELECT m, count(*) AS n_entries FROM e GROUP BY m)
        SELECT CAST(m AS VARCHAR) AS module, CASE WHEN coalesce(n_critical + n_high, 0) > 0 THEN 'fail' ELSE 'pass' END AS status, coalesce(total, 0) AS total, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, kind,
               CASE WHEN stop = 1 THEN '-' WHEN m % 7 = 0 THEN '' ELSE CAST(m AS VARCHAR) END AS code, CASE WHEN stop = 1 THEN '-' ELSE 'Order: ' || st END AS name, coalesce(n_entries, -1) AS n_entries
        FROM stop JOIN o USING (m) LEFT JOIN n USING (m) LEFT JOIN x USING (m)""",
    "yaml_nested": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n FROM lineitem), o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l))
        SELECT o_orderkey, 'order.key' AS path, CAST(o_orderkey AS VARCHAR) AS value FROM o UNION ALL SELECT o_orderkey, 'order.customer.id', CAST(o_custkey AS VARCHAR) FROM o UNION ALL SELECT o_orderkey, 'order.status', o_orderstatus FROM o UNION ALL SELECT o_orderkey, 'end', '[a, b]' FROM o
        UNION ALL SELECT l_orderkey, 'lines.' || n || '.part', CAST(l_partkey AS VARCHAR) FROM l UNION ALL SELECT l_orderkey, 'lines.' || n || '.note', l_returnflag || ': # kept' FROM l
        UNION ALL SELECT l_orderkey, 'lines.' || n || '.tags.0', l_linestatus FROM l UNION ALL SELECT l_orderkey, 'lines.' || n || '.tags.1', CAST(l_suppkey AS VARCHAR) FROM l""",
    "definition_findings": """WITH o AS (SELECT o_custkey, o_orderkey, (['code', 'name', 'title', 'code', 'description'])[CAST(left(o_orderpriority, 1) AS INTEGER)] AS field, o_orderstatus = 'P' AS blank FROM orders),
        f AS (SELECT unnest(['code', 'name', 'description']) AS detail), c AS (SELECT DISTINCT o_custkey FROM orders)
        SELECT o_custkey AS module, 'high' AS severity, 'yaml' AS category, detail FROM c CROSS JOIN f WHERE (o_custkey, detail) NOT IN (SELECT o_custkey, field FROM o WHERE NOT blank)""",  # a line without a value is left out, so an earlier one counts
    "orphan_stories": """WITH o AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'epic-' || o_custkey ELSE o_custkey || '-' || o_orderkey || '-story' END AS key, o_custkey AS c, o_orderkey % 5 = 0 AS epic, o_orderstatus = 'O' AS running FROM orders)
        SELECT key, 'orphan-story' AS finding FROM o WHERE NOT epic AND c NOT IN (SELECT c FROM o WHERE epic) UNION SELECT key, 'empty-epic' FROM o WHERE epic AND running AND c NOT IN (SELECT c FROM o WHERE NOT epic)""",
    "open_categories": "SELECT key, string_agg(event_type || '=' || n, ';' ORDER BY event_type || '=' || n) AS counts FROM (SELECT user_id % 10 AS key, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY key",
}
