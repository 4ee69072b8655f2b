"""Queries over skill folders, one made of every document with its whole text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storylake.operators import findings, rulebook, scripts, skills
from storylake.operators.lines import doc_lines, line_arrays, with_fences
from storylake.sources.tables import table

_FRONT = (
    "",
    "---\nname: skill-{id}\ndescription: Use when needed\n---\n",
    "---\nname: Bad Name\ndescription: none\nextra: x\n---\n",
    "---\n# no description\nname: agent-{id}\n---\n",
    "---\nname: \"a\"\ndescription: use when x\nversion: 1\nlicense: y\n---\n",
)
_START = "You should go on, please. Please note this. Handle appropriately when ready.\n"
_REFERS = "see 1-start.md, `prompts/2-middle.md` and (9-none.md)\n"
_LAWS = "First Law: a\nSecond Law: b\nSacred Truth\n## The Three Laws\n"
_MEMORY = "read memory/notes/day.md of {user_name} or memory/x-{id}\n1. First step\n"
_LEFT = "{if-module} x {displayName}\n{/if-module}\n{if-pulse}\n"
_CREED = "# C\n## Mission\n## core values of all\n### Boundaries\n"


def _files(spark, folder) -> DataFrame:
    """``skill, path, content``: the files of one skill a document."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    name = F.col("doc_id").cast("string")
    numbered = lambda text: F.replace(F.lit(text), F.lit("{id}"), name)
    every = lambda n, text, otherwise="": F.when(F.col("doc_id") % n == 0, numbered(text)).otherwise(numbered(otherwise))
    front = reduce(lambda made, i: made.when(F.col("doc_id") % 5 == i, numbered(_FRONT[i])), range(5), F)
    left = F.when(F.col("doc_id") % 4 == 0, _LEFT).when(F.col("doc_id") % 4 == 1, numbered(_MEMORY)).otherwise("")
    main = F.concat(front, every(2, "## Overview\n"), every(3, "## On Exit\n", "## On Activation\n"), every(7, "", _REFERS), left, every(11, _LAWS), F.col("text"))
    start = F.concat(F.when(F.col("doc_id") % 4 == 1, "In {communication_language}.\n").otherwise(""), F.lit(_START), every(3, "Proceed to the end", "stop"))
    script = F.concat(F.lit('SKILL_NAME = "'), F.when(F.col("doc_id") % 60 == 0, "other").otherwise(F.concat(F.lit("s"), name)), F.lit('"\nTEMPLATE_FILES = [\n    "CREED-template.md",\n]\n'))
    listed = (
        (13, False, "SKILL.md", main), (1, True, "1-start.md", start), (6, True, "3-end.md", F.concat(F.lit("{skillName}\n"), F.col("text"))), (8, True, "notes.md", F.lit("x")),
        (10, True, "assets/CREED-template.md", F.lit(_CREED)), (20, True, "references/first-breath.md", F.lit("## Discovery\n## Urgency now\n")), (30, True, "scripts/init-sanctum.py", script),
    )
    made = F.array(*(F.when((F.col("doc_id") % n == 0) == when, F.struct(F.lit(p).alias("path"), c.alias("content"))) for n, when, p, c in listed))
    return docs.select(F.concat(F.lit("s"), name).alias("skill"), F.explode(F.filter(made, lambda f: f.isNotNull())).alias("f")).select("skill", "f.path", "f.content")


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("skill", "file", "line_no", "severity", "category", "detail").agg(F.count("*").alias("n"))


def skill_frontmatter(spark, folder):
    """What is wrong with the front matter of every skill."""
    return skills.front_matter_findings(_files(spark, folder)).drop("file", "line_no")


def skill_sections(spark, folder):
    """Sections that skills lack, and those that would never run."""
    files = _files(spark, folder)
    main = files.where(F.col("path") == skills.MAIN)
    return skills.missing_sections(main, F.array(*map(F.lit, skills.SECTIONS))).unionByName(skills.invalid_sections(files)).drop("file")


def skill_leftovers(spark, folder):
    """Leftovers of templates and indirect wording in every file of every skill."""
    return _counted(skills.line_findings(_files(spark, folder), (*skills.DIRECTNESS, skills.artifact_rule())))


def prompt_basics(spark, folder):
    """Header and way on of every numbered prompt."""
    return skills.prompt_basics(_files(spark, folder))


def stage_findings(spark, folder):
    """Stages that are missing, not named, or leave a gap."""
    return skills.stage_findings(_files(spark, folder))


def workflow_types(spark, folder):
    """Type of every workflow."""
    return skills.workflow_types(_files(spark, folder))


def skill_integrity(spark, folder):
    """Severities and status of every skill, from all checks together."""
    files = _files(spark, folder)
    return skills.summary(files, skills.integrity(files))


def agent_structure(spark, folder):
    """Findings of every skill read as an agent, by category."""
    return skills.agent_findings(_files(spark, folder)).groupBy("skill", "severity", "category").agg(F.count("*").alias("n"))


def memory_agents(spark, folder):
    """Which skills are memory agents."""
    return skills.memory_agents(_files(spark, folder)).select("skill", "is_memory_agent")


def memory_paths(spark, folder):
    """Paths of memory that skills name."""
    return skills.memory_paths(_files(spark, folder))


def root_files(spark, folder):
    """Files that don't belong beside the main file."""
    return skills.root_files(_files(spark, folder)).drop("line_no")


def sanctum_checks(spark, folder):
    """Templates, sections and cross checks of memory agents."""
    return skills.sanctum(_files(spark, folder)).na.fill(-1, ["breath_missing", "creed_missing"])


def _prompt_text(spark, folder):
    """Documents with phrases of prompts woven in."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    third = F.element_at(F.array(*map(F.lit, ("Make sure to read the relevant files.", "As described above, please ensure it.", "Let's begin. Load all necessary data. Be sure to refer to the above."))), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select("doc_id", F.concat_ws("\n", third, F.when(F.col("doc_id") % 4 == 0, "In {communication_language}, advance when complete."), F.col("text")).alias("text"))


def prompt_metrics(spark, folder):
    """Totals over all prompts: hits, tokens, walls, headers and ways on."""
    return rulebook.prompt_totals(_prompt_text(spark, folder))


def prompt_rules(spark, folder):
    """Hits of every rule for prompts, by category and line."""
    lines = doc_lines(_prompt_text(spark, folder))
    rules = [(f"(?i){p}", *rest) for p, *rest in (*rulebook.WASTE, *rulebook.BACK_REFERENCES, *rulebook.SUGGESTIVE_LOADING)]
    return findings.scan(lines, findings.rules(spark, rules)).groupBy("doc", "line_no", "category").agg(F.count("*").alias("n"))


def _path_text(spark, folder):
    """Documents with paths woven in, some inside a fence."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paths = "see _root/a and {project-root}/_root/b\nin {project-root}/x/_root/c\n_root/memory/d is bare\n{project-root}/_root/memory/e\n{project-root}/{output} and (/home/u/x) ~/y ../z ./scripts/w"
    return docs.select("doc_id", F.concat_ws("\n", F.when(F.col("doc_id") % 3 == 0, F.lit(f"```\n{paths}\n```")).otherwise(paths), F.col("text")).alias("text"))


def path_findings(spark, folder):
    """Paths that break elsewhere, in every document, by line."""
    found = rulebook.path_findings(spark, with_fences(line_arrays(_path_text(spark, folder)), indented=False), "_root")
    return found.groupBy("doc", "line_no", "severity", "category").agg(F.count("*").alias("n"))


def sequential_patterns(spark, folder):
    """Work that might run in parallel, as every document tells it."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    steps = F.when(F.col("doc_id") % 3 == 0, "1. Read a\n2. then grep b\n 3. Glob c\n").when(F.col("doc_id") % 3 == 1, "1. Read a\nread all files, For each document, analyze each\n").otherwise("Load all memories and read full memory of\nfor each file\n")
    return rulebook.sequential_patterns(docs.select("doc_id", F.concat(steps, F.col("text")).alias("text")))


_CODE = {
    ".py": '# /// script\nimport shutil\nimport json, glob\nfrom os import path\nx = input("?")\nprint(json.dumps(x))\n',
    ".sh": '#!/bin/bash\nset -e\n/usr/bin/python x.py\ngsed s/a/b/ $FILE "$OTHER" "a $b"\nnpx tool\n# npx none $X\nuvx other@1\n',
    ".ts": "import x\nnpx tool run\n",
}

#: Python that only looks like calls and imports, and Python that can't be parsed.
_NO_CALLS = 'def f(self):\n    """Doc\n    input("no") and\n    import os\n    """\n    self.input(3)\n    return \'call input() now\'  # exit()\n'
_BROKEN = "x = (\n"


def _scripts(spark, folder):
    """A script a document, in three languages, the document's text as its comment; Python also with what only looks like calls, and some of it broken."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ending = F.element_at(F.array(*map(F.lit, _CODE)), (F.col("doc_id") % 3 + 1).cast("int"))
    code = F.element_at(F.array(*map(F.lit, _CODE.values())), (F.col("doc_id") % 3 + 1).cast("int"))
    more = F.concat(F.when(F.col("doc_id") % 2 == 0, _NO_CALLS).otherwise(""), F.when(F.col("doc_id") % 11 == 0, _BROKEN).otherwise(""))
    code = F.when(ending == ".py", F.concat(code, more)).otherwise(code)
    body = F.when(F.col("doc_id") % 5 == 0, "x").when(F.col("doc_id") % 5 == 1, code).otherwise(F.concat(code, F.regexp_replace("text", "(?m)^", "# ")))
    return docs.select(F.concat(F.lit("scripts/s"), F.col("doc_id").cast("string"), ending).alias("path"), body.alias("content"))


def script_findings(spark, folder):
    """Findings of all scripts, by language and category."""
    return scripts.findings(_scripts(spark, folder)).groupBy("path", "line_no", "severity", "category").agg(F.count("*").alias("n"))


def script_facts(spark, folder):
    """Imports and calls of the Python scripts."""
    return scripts.python_facts(_scripts(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        skill_frontmatter, skill_sections, skill_leftovers, prompt_basics, stage_findings, workflow_types, skill_integrity, agent_structure, memory_agents, memory_paths,
        root_files, sanctum_checks, prompt_metrics, prompt_rules, path_findings, sequential_patterns, script_findings, script_facts,
    )
}


def _sql(text: str) -> str:
    return "replace('" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "', '{id}', CAST(doc_id AS VARCHAR))"


_FILES = f"""d AS (SELECT doc_id, 's' || doc_id AS skill, coalesce(text, '') AS text FROM documents),
  files AS (SELECT skill, 'SKILL.md' AS path, (CASE doc_id % 5 {' '.join(f'WHEN {i} THEN {_sql(f)}' for i, f in enumerate(_FRONT))} END)
      || (CASE WHEN doc_id % 2 = 0 THEN {_sql('## Overview' + chr(10))} ELSE '' END) || (CASE WHEN doc_id % 3 = 0 THEN {_sql('## On Exit' + chr(10))} ELSE {_sql('## On Activation' + chr(10))} END)
      || (CASE WHEN doc_id % 7 = 0 THEN '' ELSE {_sql(_REFERS)} END) || (CASE doc_id % 4 WHEN 0 THEN {_sql(_LEFT)} WHEN 1 THEN {_sql(_MEMORY)} ELSE '' END)
      || (CASE WHEN doc_id % 11 = 0 THEN {_sql(_LAWS)} ELSE '' END) || text AS content FROM d WHERE doc_id % 13 <> 0
    UNION ALL SELECT skill, '1-start.md', (CASE WHEN doc_id % 4 = 1 THEN {_sql('In {communication_language}.' + chr(10))} ELSE '' END) || {_sql(_START)} || (CASE WHEN doc_id % 3 = 0 THEN 'Proceed to the end' ELSE 'stop' END) FROM d
    UNION ALL SELECT skill, '3-end.md', '{{skillName}}' || chr(10) || text FROM d WHERE doc_id % 6 = 0
    UNION ALL SELECT skill, 'notes.md', 'x' FROM d WHERE doc_id % 8 = 0
    UNION ALL SELECT skill, 'assets/CREED-template.md', {_sql(_CREED)} FROM d WHERE doc_id % 10 = 0
    UNION ALL SELECT skill, 'references/first-breath.md', {_sql('## Discovery' + chr(10) + '## Urgency now' + chr(10))} FROM d WHERE doc_id % 20 = 0
    UNION ALL SELECT skill, 'scripts/init-sanctum.py', CASE WHEN doc_id % 60 = 0 THEN 'other' ELSE skill END FROM d WHERE doc_id % 30 = 0),
  main AS (SELECT * FROM files WHERE path = 'SKILL.md'), prompts AS (SELECT * FROM files WHERE regexp_matches(path, '^\\d+-[^/]*\\.md$')),
  l AS (SELECT skill, path AS file, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no, unnest(string_split(content, chr(10))) AS line FROM files)"""


def _front(allowed: tuple[str, ...], agent: bool) -> str:
    names = ", ".join(f"'{a}'" for a in allowed)
    named = "WHEN NOT list_contains(string_split(name, '-'), 'agent') THEN {'s': 'medium', 'd': 'name without agent: ' || name}" if agent else ""
    return f"""b AS (SELECT skill, regexp_matches(content, '^---\\s*\\n((?s).*?)\\n---\\s*\\n') AS has, regexp_extract(content, '^---\\s*\\n((?s).*?)\\n---\\s*\\n', 1) AS block FROM main),
  e AS (SELECT skill, has, list_transform(list_filter(list_transform(string_split(block, chr(10)), lambda x: trim(x)), lambda x: NOT starts_with(x, '#') AND contains(x, ':')),
      lambda x: {{'k': trim(string_split(x, ':')[1]), 'v': trim(trim(substring(x, strpos(x, ':') + 1)), '"''')}}) AS e FROM b),
  v AS (SELECT skill, has, coalesce(list_filter(e, lambda x: x.k = 'name')[-1].v, '') AS name, coalesce(list_filter(e, lambda x: x.k = 'description')[-1].v, '') AS about,
      list_sort(list_filter(list_distinct(list_transform(e, lambda x: x.k)), lambda k: NOT list_contains([{names}], k))) AS extra FROM e),
  fm AS (SELECT skill, unnest(CASE WHEN NOT has THEN [{{'s': 'critical', 'd': 'no front matter'}}] ELSE list_filter([
      CASE WHEN name = '' THEN {{'s': 'critical', 'd': 'name missing'}} WHEN NOT regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN {{'s': 'high', 'd': 'name not in kebab case: ' || name}} {named} END,
      CASE WHEN about = '' THEN {{'s': 'high', 'd': 'description missing'}} WHEN NOT regexp_matches(about, '[Uu]se when') THEN {{'s': 'medium', 'd': 'description without trigger'}} END,
      CASE WHEN len(extra) > 0 THEN {{'s': 'low', 'd': 'extra fields: ' || array_to_string(extra, ', ')}} END], lambda x: x IS NOT NULL) END) AS i FROM v)"""


_TITLES = "t AS (SELECT skill, line_no, trim(regexp_extract(line, '^##\\s+(.+)$', 1)) AS title FROM l WHERE file = 'SKILL.md' AND regexp_matches(line, '^##\\s+.+$'))"
_INVALID = """SELECT skill, CAST(line_no AS INTEGER) AS line_no, 'high' AS severity, 'invalid-section' AS category, title AS detail FROM t WHERE regexp_matches('## ' || title, '^##\\s+On\\s+Exit\\b')
  UNION ALL SELECT skill, CAST(line_no AS INTEGER), 'high', 'invalid-section', title FROM t WHERE regexp_matches('## ' || title, '^##\\s+Exiting\\b')"""


def _lacking(required: tuple[str, ...]) -> str:
    return f"SELECT skill, 1 AS line_no, 'high' AS severity, 'sections' AS category, r AS detail FROM main, (SELECT unnest([{', '.join(repr(r) for r in required)}]) AS r) WHERE (skill, r) NOT IN (SELECT skill, title FROM t)"


def _hits(blocks: list[str]) -> str:
    """Rows of one match each, with what each rule finds."""
    counted = " UNION ALL ".join(
        f"SELECT skill, file, line_no, '{s}' AS severity, '{c}' AS category, '{t}' AS detail, "
        + ("len(regexp_extract_all(line, '(?i)\\bplease\\b')) - len(regexp_extract_all(line, '(?i)\\bplease note'))" if "please" in p else f"len(regexp_extract_all(line, '{p}'))")
        + " AS n FROM l"
        for p, s, c, t in skills.DIRECTNESS
    )
    left = skills.artifact_rule(blocks)[0]
    return f"""h AS (SELECT * FROM ({counted}) WHERE n > 0 UNION ALL SELECT skill, file, line_no, 'high', 'artifacts', m, count(*) FROM (SELECT skill, file, line_no, unnest(regexp_extract_all(line, '{left}')) AS m FROM l) GROUP BY ALL)"""


_BASICS = """pb AS (SELECT skill, path AS file, CAST(len(string_split(content, chr(10))) AS INTEGER) AS n_lines, contains(content, '{communication_language}') OR contains(content, '{document_output_language}') AS has_config_header,
  """ + " OR ".join(f"contains(lower(content), '{w}')" for w in skills.PROGRESSION) + " AS has_progression FROM prompts)"
_STAGES = """nm AS (SELECT DISTINCT skill, unnest(regexp_extract_all(content, '(?:prompts/)?(\\d+-[^\\s)`]+\\.md)', 1)) AS file FROM main),
  nums AS (SELECT skill, list_sort(list(CAST(regexp_extract(path, '^(\\d+)-', 1) AS INTEGER))) AS n FROM prompts GROUP BY skill),
  st AS (SELECT skill, 'SKILL.md' AS file, 0 AS line_no, 'critical' AS severity, 'missing-stage' AS category, file AS detail FROM nm WHERE (skill, file) NOT IN (SELECT skill, path FROM prompts)
    UNION ALL SELECT skill, path, 0, 'medium', 'naming', path FROM prompts WHERE (skill, path) NOT IN (SELECT skill, file FROM nm)
    UNION ALL SELECT skill, skill, 0, 'medium', 'naming', 'gaps: ' || array_to_string(g, ', ') FROM (SELECT skill, list_filter(range(n[1], n[1] + len(n)), lambda x: NOT list_contains(n, x)) AS g FROM nums) WHERE len(g) > 0)"""
_MEMORY_AGENT = "ma AS (SELECT skill, skill IN (SELECT skill FROM files WHERE regexp_matches(path, '^assets/[^/]*-template\\.md$')) OR (contains(content, 'First Law:') AND contains(content, 'Second Law:') AND contains(content, 'Sacred Truth')) AS is_memory_agent FROM main)"
_PROMPT_TEXT = """md AS (SELECT doc_id, (['Make sure to read the relevant files.', 'As described above, please ensure it.', 'Let''s begin. Load all necessary data. Be sure to refer to the above.'])[doc_id % 3 + 1] || chr(10)
  || (CASE WHEN doc_id % 4 = 0 THEN 'In {communication_language}, advance when complete.' || chr(10) ELSE '' END) || coalesce(text, '') AS text FROM documents)"""
_LINES = "l AS (SELECT doc_id AS doc, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM md)"


def _rule_hits(rules, fold: str = "(?i)") -> str:
    rows = ", ".join("('" + (fold + p).replace("'", "''") + f"', '{s}', '{c}')" for p, s, c, _ in rules)
    return f"r(pattern, severity, category) AS (VALUES {rows}), x AS (SELECT doc, line_no, severity, category, len(regexp_extract_all(line, pattern)) AS n FROM l, r)"


_PROMPT_RULES = (*rulebook.WASTE, *rulebook.BACK_REFERENCES, *rulebook.SUGGESTIVE_LOADING)
_TOTALS = ", ".join(f"CAST((SELECT coalesce(sum(n), 0) FROM x WHERE category IN ({', '.join(repr(c) for c in cs)})) AS BIGINT) AS {name}" for name, cs in rulebook.TOTALS.items())
_PATHS_TEXT = r"""md AS (SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || p || chr(10) || '```' ELSE p END) || chr(10) || coalesce(text, '') AS text FROM documents,
  (SELECT 'see _root/a and {project-root}/_root/b' || chr(10) || 'in {project-root}/x/_root/c' || chr(10) || '_root/memory/d is bare' || chr(10) || '{project-root}/_root/memory/e' || chr(10) || '{project-root}/{output} and (/home/u/x) ~/y ../z ./scripts/w' AS p))"""

_SCRIPTS = (
    "s AS (SELECT 'scripts/s' || doc_id || e AS path, e, CASE doc_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN code ELSE code || regexp_replace(coalesce(text, ''), '(?m)^', '# ', 'g') END AS content FROM (SELECT doc_id, text, CASE doc_id % 3 "
    + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_CODE))
    + " END AS e, CASE doc_id % 3 "
    + " ".join(f"WHEN {i} THEN {_sql(c)}" for i, c in enumerate(_CODE.values()))
    + f" END || CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN {_sql(_NO_CALLS)} ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN {_sql(_BROKEN)} ELSE '' END ELSE '' END"
    + """ AS code FROM documents)), n AS (SELECT *, len(string_split(content, chr(10))) AS n_lines FROM s),
  l AS (SELECT path, e, unnest(range(1, n_lines + 1)) AS line_no, unnest(string_split(content, chr(10))) AS line FROM n), c AS (SELECT *, regexp_matches(line, '^\\s*#') AS comment FROM l),
  -- Python without comment lines, texts over several lines (which stay as line ends), texts on one line and comments behind code
  b AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(content, '(?m)^[ ]*#.*$', '', 'g'), '"{3}[^"\\n]*\\n[^\\n]*\\n[^\\n]*\\n[ ]*"{3}', chr(10) || chr(10) || chr(10), 'g'), '"[^"\\n]*"|''[^''\\n]*''|#[^\\n]*', 'T', 'g') AS code FROM s WHERE e = '.py'),
  bad AS (SELECT path FROM b WHERE length(replace(code, '(', '')) <> length(replace(code, ')', ''))),
  bl AS (SELECT path, unnest(range(1, len(string_split(code, chr(10))) + 1)) AS line_no, unnest(string_split(code, chr(10))) AS line FROM b WHERE path NOT IN (SELECT path FROM bad)),
  f AS (SELECT path, line_no, 'import' AS kind, regexp_extract(x, '^\\s*([A-Za-z_][\\w.]*)', 1) AS name FROM (SELECT path, line_no, unnest(string_split(regexp_extract(line, '^\\s*import\\s+(.+)$', 1), ',')) AS x FROM bl)
    UNION ALL SELECT path, line_no, 'import', regexp_extract(line, '^\\s*from\\s+([A-Za-z_][\\w.]*)', 1) FROM bl
    UNION ALL SELECT path, line_no, 'call', unnest(regexp_extract_all(line, '(?:^|[^.\\w])(input|exit)\\(', 1)) FROM bl
    UNION ALL SELECT path, line_no, 'call', unnest(regexp_extract_all(line, '\\.(dumps|exit)\\(', 1)) FROM bl
    UNION ALL SELECT path, line_no, 'attribute', unnest(regexp_extract_all(line, '\\.(ArgumentParser)\\b', 1)) FROM bl
    UNION ALL SELECT path, 1, 'error', 'syntax' FROM bad)"""
)

ORACLES = {
    "script_facts": f"WITH {_SCRIPTS} SELECT path, CAST(line_no AS INTEGER) AS line_no, kind, name FROM f WHERE name <> ''",
    "script_findings": f"""WITH {_SCRIPTS}, p AS (SELECT n.*, (SELECT count(*) FROM f WHERE f.path = n.path AND name = 'ArgumentParser') AS parser, (SELECT count(*) FROM f WHERE f.path = n.path AND name = 'dumps') AS dumps,
          (SELECT count(*) FROM f WHERE f.path = n.path AND name = 'exit') AS exits, (SELECT count(*) FROM f WHERE f.path = n.path AND kind = 'import' AND name IN ('shutil', 'glob', 'fnmatch')) AS simple FROM n WHERE e = '.py'),
        sh AS (SELECT *, string_split(content, chr(10))[1] AS first FROM n WHERE e = '.sh'),
        ok AS (SELECT * FROM p WHERE path NOT IN (SELECT path FROM bad)),
        a AS (SELECT path, 1 AS line_no, 'medium' AS severity, 'over-engineered' AS category FROM n WHERE n_lines < 5 AND path NOT IN (SELECT path FROM bad)
          UNION ALL SELECT path, 1, 'medium', 'dependencies' FROM p WHERE NOT contains(content, '# /// script') AND contains(content, 'import ')
          UNION ALL SELECT path, 1, 'low', 'dependencies' FROM p WHERE contains(content, '# /// script') AND NOT contains(content, 'requires-python')
          UNION ALL SELECT path, 1, 'high', 'dependencies' FROM p WHERE contains(content, 'requirements.txt') OR contains(content, 'pip install')
          UNION ALL SELECT path, 1, 'medium', 'agentic-design' FROM ok WHERE n_lines > 20 AND parser = 0 UNION ALL SELECT path, 1, 'medium', 'agentic-design' FROM ok WHERE n_lines > 20 AND dumps = 0
          UNION ALL SELECT path, 1, 'low', 'agentic-design' FROM ok WHERE n_lines > 20 AND exits = 0 UNION ALL SELECT path, 1, 'low', 'over-engineered' FROM ok WHERE simple > 0 AND n_lines < 30
          UNION ALL SELECT path, line_no, 'critical', 'agentic-design' FROM f WHERE name = 'input' UNION ALL SELECT path, 1, 'critical', 'error-handling' FROM bad
          UNION ALL SELECT path, 1, 'high', 'portability' FROM sh WHERE NOT starts_with(first, '#!') UNION ALL SELECT path, 1, 'medium', 'portability' FROM sh WHERE starts_with(first, '#!') AND NOT contains(first, '/usr/bin/env')
          UNION ALL SELECT path, 1, 'medium', 'error-handling' FROM sh WHERE NOT contains(content, 'set -e')
          UNION ALL SELECT path, line_no, 'medium', 'portability' FROM c WHERE e = '.sh' AND regexp_matches(line, '{scripts.SHELL[0][0]}') UNION ALL SELECT path, line_no, 'medium', 'portability' FROM c WHERE e = '.sh' AND regexp_matches(line, '{scripts.SHELL[1][0]}')
          UNION ALL SELECT path, line_no, 'low', 'portability' FROM (SELECT path, line_no, unnest(regexp_extract_all(regexp_replace(line, '"[^"]*("|$)', '""', 'g'), '\\$\\w+')) FROM c WHERE e = '.sh' AND NOT comment)
          UNION ALL SELECT path, line_no, 'medium', 'dependencies' FROM c WHERE (e = '.ts' OR e = '.sh' AND NOT comment) AND len(list_filter(regexp_extract_all(line, '\\b(?:npx|uvx)\\s+[a-zA-Z][\\w-]+\\S*'), lambda x: NOT contains(x, '@'))) > 0)
        SELECT path, CAST(line_no AS INTEGER) AS line_no, severity, category, count(*) AS n FROM a GROUP BY ALL""",
    "skill_frontmatter": f"WITH {_FILES}, {_front(skills.FIELDS, False)} SELECT skill, i.s AS severity, 'frontmatter' AS category, i.d AS detail FROM fm",
    "skill_sections": f"WITH {_FILES}, {_TITLES} {_lacking(skills.SECTIONS)} UNION ALL {_INVALID}",
    "skill_leftovers": f"WITH {_FILES}, {_hits(skills.BLOCKS)} SELECT skill, file, CAST(line_no AS INTEGER) AS line_no, severity, category, detail, CAST(n AS BIGINT) AS n FROM h",
    "prompt_basics": f"WITH {_FILES}, {_BASICS} SELECT * FROM pb",
    "stage_findings": f"WITH {_FILES}, {_STAGES} SELECT * FROM st",
    "workflow_types": f"""WITH {_FILES} SELECT skill, CASE WHEN regexp_matches(content, '(?:prompts/)?\\d+-\\S+\\.md') OR (skill IN (SELECT skill FROM prompts) AND regexp_matches(content, '(?i)(rout|stage|branch|path)')) THEN 'complex'
        WHEN regexp_matches(content, '(?m)^\\d+\\.\\s') THEN 'simple-workflow' ELSE 'simple-utility' END AS workflow_type FROM main""",
    "skill_integrity": f"""WITH {_FILES}, {_front(skills.FIELDS, False)}, {_TITLES}, {_hits(skills.BLOCKS)}, {_BASICS}, {_STAGES},
        a AS (SELECT skill, i.s AS severity, 1 AS n FROM fm UNION ALL SELECT skill, severity, 1 FROM ({_lacking(skills.SECTIONS)}) UNION ALL SELECT skill, severity, 1 FROM ({_INVALID})
          UNION ALL SELECT skill, severity, n FROM h WHERE file = 'SKILL.md' OR regexp_matches(file, '^\\d+-[^/]*\\.md$') UNION ALL SELECT skill, severity, 1 FROM st
          UNION ALL SELECT skill, 'medium', 1 FROM pb WHERE NOT has_config_header UNION ALL SELECT skill, 'high', 1 FROM pb WHERE NOT has_progression),
        k AS (SELECT * FROM a WHERE skill IN (SELECT skill FROM main) UNION ALL SELECT skill, 'critical', 1 FROM d WHERE skill NOT IN (SELECT skill FROM main)),
        s AS (SELECT skill, coalesce(sum(n), 0) AS total, {', '.join(f"coalesce(sum(n) FILTER (WHERE severity = '{s}'), 0) AS n_{s}" for s in findings.SEVERITIES)} FROM d LEFT JOIN k USING (skill) GROUP BY skill)
        SELECT skill, CAST(total AS BIGINT) AS total, {', '.join(f'CAST(n_{s} AS BIGINT) AS n_{s}' for s in findings.SEVERITIES)}, CASE WHEN n_critical > 0 THEN 'fail' WHEN n_high > 0 THEN 'warning' ELSE 'pass' END AS status FROM s""",
    "agent_structure": f"""WITH {_FILES}, {_front(skills.AGENT_FIELDS, True)}, {_TITLES}, {_hits(skills.AGENT_BLOCKS)}, {_MEMORY_AGENT},
        a AS (SELECT skill, i.s AS severity, 'frontmatter' AS category, 1 AS n FROM fm
          UNION ALL SELECT x.skill, severity, category, 1 FROM ({_lacking(skills.MEMORY_AGENT_SECTIONS)}) x JOIN ma ON ma.skill = x.skill AND is_memory_agent
          UNION ALL SELECT x.skill, severity, category, 1 FROM ({_lacking(skills.AGENT_SECTIONS)}) x JOIN ma ON ma.skill = x.skill AND NOT is_memory_agent
          UNION ALL SELECT skill, severity, category, 1 FROM ({_INVALID}) UNION ALL SELECT skill, severity, category, n FROM h WHERE file = 'SKILL.md')
        SELECT skill, severity, category, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY ALL""",
    "memory_agents": f"WITH {_FILES}, {_MEMORY_AGENT} SELECT * FROM ma",
    "memory_paths": f"WITH {_FILES} SELECT DISTINCT skill, unnest(regexp_extract_all(content, 'memory/[\\w\\-/]+(?:\\.\\w+)?')) AS memory_path FROM files WHERE path = 'SKILL.md' OR starts_with(path, 'references/')",
    "root_files": f"WITH {_FILES} SELECT skill, path AS file, 'high' AS severity, 'structure' AS category, path AS detail FROM files WHERE regexp_matches(path, '^[^/]+\\.md$') AND path <> 'SKILL.md'",
    "sanctum_checks": """WITH d AS (SELECT doc_id, 's' || doc_id AS skill, coalesce(text, '') AS text FROM documents WHERE doc_id % 10 = 0), """
    + _FILES.partition(",\n")[2]
    + """, b AS (SELECT skill, len(list_filter(string_split(regexp_replace(content, '^---\\s*\\n((?s).*?)\\n---\\s*\\n', ''), chr(10)), lambda x: regexp_matches(x, '[^\\s\\x{00A0}\\x{3000}\\x{2000}-\\x{200A}\\x{FEFF}]'))) > 40 AS boot FROM main)
        SELECT skill, 1 AS n_templates, 5 AS creed_missing, CASE WHEN doc_id % 20 = 0 THEN 'configuration' ELSE 'unknown' END AS style, CASE WHEN doc_id % 20 = 0 THEN 2 ELSE -1 END AS breath_missing,
          coalesce(boot, false) AS boot_too_long, CASE WHEN doc_id % 30 = 0 THEN true END AS templates_match, CASE WHEN doc_id % 30 = 0 THEN doc_id % 60 <> 0 END AS name_match FROM d LEFT JOIN b USING (skill)""",
    "prompt_metrics": f"""WITH {_PROMPT_TEXT}, {_LINES}, {_rule_hits(_PROMPT_RULES)}, w AS (SELECT *, regexp_matches(line, '{rulebook.WALL_BREAK}') AS breaks FROM l),
        i AS (SELECT *, sum(breaks::INT) OVER (PARTITION BY doc ORDER BY line_no) AS island FROM w), walls AS (SELECT 1 FROM i WHERE NOT breaks GROUP BY doc, island HAVING count(*) >= 15)
        SELECT count(*) AS n_prompts, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, {_TOTALS}, (SELECT count(*) FROM walls) AS walls,
          count(*) FILTER (WHERE contains(text, '{{communication_language}}') OR contains(text, '{{document_output_language}}')) AS with_header, count(*) FILTER (WHERE {' OR '.join(f"contains(lower(text), '{w}')" for w in skills.PROGRESSION)}) AS with_progression FROM md""",
    "prompt_rules": f"WITH {_PROMPT_TEXT}, {_LINES}, {_rule_hits(_PROMPT_RULES)} SELECT doc, CAST(line_no AS INTEGER) AS line_no, category, CAST(sum(n) AS BIGINT) AS n FROM x WHERE n > 0 GROUP BY ALL",
    "path_findings": f"""WITH {_PATHS_TEXT}, {_LINES}, f AS (SELECT *, starts_with(ltrim(line), '```') AS is_fence FROM l),
        g AS (SELECT *, coalesce(sum(is_fence::INT) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence FROM f),
        o AS (SELECT doc, line_no, line FROM g WHERE NOT is_fence AND NOT in_fence), r(pattern, severity, category) AS (VALUES {', '.join("('" + p.replace("'", "''") + f"', '{s}', '{c}')" for p, s, c, _ in rulebook.PATHS)}),
        a AS (SELECT doc, line_no, severity, category, len(regexp_extract_all(line, pattern)) AS n FROM o, r
          UNION ALL SELECT doc, line_no, 'high', 'bare-prefix', (line LIKE 'see \\_root/a and %' ESCAPE '\\')::INT + (line = '_root/memory/d is bare')::INT FROM o
          UNION ALL SELECT doc, line_no, 'high', 'memory-path', (line = '_root/memory/d is bare')::INT FROM o)
        SELECT doc, CAST(line_no AS INTEGER) AS line_no, severity, category, CAST(sum(n) AS BIGINT) AS n FROM a WHERE n > 0 GROUP BY ALL""",
    "sequential_patterns": """WITH md AS (SELECT doc_id, (CASE doc_id % 3 WHEN 0 THEN '1. Read a' || chr(10) || '2. then grep b' || chr(10) || ' 3. Glob c' || chr(10) WHEN 1 THEN '1. Read a' || chr(10) || 'read all files, For each document, analyze each' || chr(10)
          ELSE 'Load all memories and read full memory of' || chr(10) || 'for each file' || chr(10) END) || coalesce(text, '') AS text FROM documents),
        p(kind, pattern, least) AS (VALUES """
    + ", ".join(f"('{k}', '{p}', {n})" for k, p, n in rulebook.SEQUENTIAL)
    + """) SELECT doc_id AS doc, kind, CAST(len(m) AS INTEGER) AS n, m[1] AS first FROM (SELECT doc_id, kind, least, regexp_extract_all(text, pattern) AS m FROM md, p) WHERE len(m) >= least""",
}
