"""Checks of skill folders: front matter, sections, stages, prompts, and what templates left behind.

Input is a listing ``skill, path, content`` of text files, paths relative to the
skill's folder; ``SKILL.md`` is the main file. Findings are ``skill, file,
line_no, severity, category, detail``. A null content counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylake.functions.text import bound, strip_white
from storylake.operators import findings
from storylake.sources.settings import content_lines, front_matter

MAIN = "SKILL.md"
# What a finished skill must and must not hold.
FIELDS = ("name", "description", "menu-code")
AGENT_FIELDS = ("name", "description")
SECTIONS = ("Overview", "On Activation")
AGENT_SECTIONS = ("Overview", "Identity", "Communication Style", "Principles", "On Activation")
MEMORY_AGENT_SECTIONS = ("The Three Laws", "The Sacred Truth", "On Activation")
INVALID_SECTIONS = (r"^##\s+On\s+Exit\b", r"^##\s+Exiting\b")
BLOCKS = "complex-workflow simple-workflow simple-utility module headless".split()
AGENT_BLOCKS = [*BLOCKS, *"autonomous memory memory-agent stateless-agent evolvable pulse".split()]
PLACEHOLDERS = ("displayName", "skillName")
DIRECTNESS = (
    (r"(?i)\byou should\b", "low", "language", "Suggestive: say it directly"),
    (r"(?i)\bplease\b(?! note)", "low", "language", "Polite: say it directly"),
    (r"(?i)\bhandle appropriately\b", "low", "language", "Ambiguous: say how"),
    (r"(?i)\bwhen ready\b", "low", "language", "Vague: name a condition"),
)
LANGUAGE_VARIABLES = ("{communication_language}", "{document_output_language}")
PROGRESSION = ("progress", "advance", "move to", "next stage", "when complete", "proceed to", "transition", "completion criteria")
TEMPLATES = tuple(f"{n}-template.md" for n in ("INDEX", "PERSONA", "CREED", "BOND", "MEMORY", "CAPABILITIES"))
CREED_SECTIONS = ("The Sacred Truth", "Mission", "Core Values", "Standing Orders", "Philosophy", "Boundaries", "Anti-Patterns", "Dominion")
BREATH_SECTIONS = {
    "calibration": ("Save As You Go", "Pacing", "Chase What Catches", "Absorb Their Voice", "Show Your Work", "Hear the Silence", "The Territories", "Wrapping Up"),
    "configuration": ("Save As You Go", "Discovery", "Urgency", "Wrapping Up"),
}
BOOT_LINES = 40

NUMBERED = r"^\d+-[^/]*\.md$"


def kebab(name: Column) -> Column:
    """Whether a name is lower-case words joined by single hyphens."""
    return F.rlike(name, F.lit(r"^[a-z0-9]+(-[a-z0-9]+)*$"))


def _filled(files: DataFrame) -> DataFrame:
    return files.select("skill", "path", F.coalesce("content", F.lit("")).alias("content"))


def _main(files: DataFrame) -> DataFrame:
    return _filled(files).where(F.col("path") == MAIN)


def _prompts(files: DataFrame) -> DataFrame:
    return _filled(files).where(F.rlike("path", F.lit(NUMBERED)))


def _issue(severity: str, category: str, detail: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), detail.alias("detail"))


def _reported(rows: DataFrame, issues: Column, line_no: Column | None = None) -> DataFrame:
    """One finding for every issue of an array that isn't null."""
    at = F.lit(1) if line_no is None else line_no
    listed = rows.select("skill", F.col("path").alias("file"), at.cast("int").alias("line_no"), F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("i"))
    return listed.select("skill", "file", "line_no", "i.severity", "i.category", "i.detail")


def fields(block: Column) -> Column:
    """``array<struct<key, value>>`` of the ``key: value`` lines of a block, in order, comments left out."""
    lines = F.filter(F.transform(F.split(block, "\n"), strip_white), lambda x: ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit(":")))
    plain = lambda x: F.regexp_replace(strip_white(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), "^[\"']+|[\"']+$", "")
    return F.transform(lines, lambda x: F.struct(strip_white(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), plain(x).alias("value")))


def _value(entries: Column, key: str) -> Column:
    """Last value of a key, empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"], F.lit(""))


def front_matter_findings(files: DataFrame, allowed: tuple[str, ...] = FIELDS, agent: bool = False) -> DataFrame:
    """Front matter that is missing, or whose name, description or further fields aren't as they should be."""

    def checked(entries):
        name, about = _value(entries, "name"), _value(entries, "description")
        extra = F.array_sort(F.array_except(F.transform(entries, lambda e: e["key"]), F.array(*map(F.lit, allowed))))
        named = F.when(name == "", _issue("critical", "frontmatter", F.lit("name missing"))).when(~kebab(name), _issue("high", "frontmatter", F.concat(F.lit("name not in kebab case: "), name)))
        if agent:
            named = named.when(~F.array_contains(F.split(name, "-"), "agent"), _issue("medium", "frontmatter", F.concat(F.lit("name without agent: "), name)))
        told = F.when(about == "", _issue("high", "frontmatter", F.lit("description missing"))).when(~F.rlike(about, F.lit("[Uu]se when")), _issue("medium", "frontmatter", F.lit("description without trigger")))
        more = F.when(F.size(extra) > 0, _issue("low", "frontmatter", F.concat(F.lit("extra fields: "), F.array_join(extra, ", "))))
        return F.array(named, told, more)

    block = front_matter(F.col("content"))
    none = F.array(_issue("critical", "frontmatter", F.lit("no front matter")))
    return _reported(_main(files), F.when(block.isNull(), none).otherwise(bound(fields(block), checked)))


def titles(content: Column) -> Column:
    """Titles of the headings of level 2, in order."""
    return F.transform(F.filter(F.split(content, "\n"), lambda x: F.rlike(x, F.lit(r"^##\s+.+$"))), lambda x: strip_white(F.regexp_extract(x, r"^##\s+(.+)$", 1)))


def missing_sections(rows: DataFrame, required: Column) -> DataFrame:
    """A finding for every required title that a main file lacks."""
    lacking = F.array_except(required, titles(F.col("content")))
    return _reported(rows, F.transform(lacking, lambda t: _issue("high", "sections", t)))


def line_findings(files: DataFrame, rules: tuple) -> DataFrame:
    """Findings of ``(pattern, severity, category, title)`` rules on the lines of files, one for each match."""
    split = _filled(files).select("skill", F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("at", "line"))

    def matched(pattern, severity, category, title):
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)), lambda m: _issue(severity, category, F.lit(title) if title else m))

    hits = F.flatten(F.array(*(matched(*rule) for rule in rules)))
    found = split.select("skill", "file", (F.col("at") + 1).alias("line_no"), F.explode(hits).alias("i"))
    return found.select("skill", "file", "line_no", "i.severity", "i.category", "i.detail")


def invalid_sections(files: DataFrame) -> DataFrame:
    """Sections that would never run, on the line where they stand; the title is the detail."""
    split = _main(files).select("skill", "path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    heading = split.where(F.rlike("line", F.lit(r"^##\s+.+$"))).withColumn("title", strip_white(F.regexp_extract("line", r"^##\s+(.+)$", 1)))
    shown = F.concat(F.lit("## "), F.col("title"))
    return _reported(heading, F.array(*(F.when(F.rlike(shown, F.lit(p)), _issue("high", "invalid-section", F.col("title"))) for p in INVALID_SECTIONS)), F.col("at") + 1)


def artifact_rule(blocks: list[str] = BLOCKS) -> tuple:
    """The rule for conditionals and placeholders that a template left behind; the match is the detail. Run-time variables aren't among them."""
    return (r"\{/?if-(?:" + "|".join(blocks) + r")\}|\{(?:" + "|".join(PLACEHOLDERS) + r")\}", "high", "artifacts", "")


def prompt_basics(files: DataFrame) -> DataFrame:
    """``skill, file, n_lines, has_config_header, has_progression`` of the numbered prompts."""
    has = lambda words, text: reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))
    return _prompts(files).select(
        "skill", F.col("path").alias("file"), F.size(F.split("content", "\n")).alias("n_lines"),
        has(LANGUAGE_VARIABLES, F.col("content")).alias("has_config_header"), has(PROGRESSION, F.lower("content")).alias("has_progression"),
    )


def prompt_findings(basics: DataFrame) -> DataFrame:
    """Findings of :func:`prompt_basics`: prompts without a header, or that name no way on."""
    header = F.when(~F.col("has_config_header"), F.struct(F.lit(1).alias("line_no"), F.lit("medium").alias("severity"), F.lit("config-header").alias("category")))
    onward = F.when(~F.col("has_progression"), F.struct(F.col("n_lines").alias("line_no"), F.lit("high").alias("severity"), F.lit("progression").alias("category")))
    listed = basics.select("skill", "file", F.explode(F.filter(F.array(header, onward), lambda i: i.isNotNull())).alias("i"))
    return listed.select("skill", "file", "i.line_no", "i.severity", "i.category", F.lit("").alias("detail"))


def stage_findings(files: DataFrame) -> DataFrame:
    """Stages that the main file names but aren't there, stages that it doesn't name, and gaps in their numbers."""
    named = _main(files).select("skill", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?:prompts/)?(\d+-[^\s)`]+\.md)"), F.lit(1)))).alias("file"))
    there = _prompts(files).select("skill", F.col("path").alias("file"))
    row = lambda rows, file, severity, category, detail: rows.select("skill", file.alias("file"), F.lit(0).alias("line_no"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), detail.alias("detail"))
    missing = row(named.join(there, ["skill", "file"], "left_anti"), F.lit(MAIN), "critical", "missing-stage", F.col("file"))
    orphaned = row(there.join(named, ["skill", "file"], "left_anti"), F.col("file"), "medium", "naming", F.col("file"))
    numbers = there.groupBy("skill").agg(F.array_sort(F.collect_list(F.regexp_extract("file", r"^(\d+)-", 1).cast("int"))).alias("n"))
    wanted = F.array_except(F.sequence(F.col("n")[0], F.col("n")[0] + F.size("n") - 1), F.col("n"))
    gaps = row(numbers.withColumn("gaps", F.array_join(wanted, ", ")).where("gaps <> ''"), F.col("skill"), "medium", "naming", F.concat(F.lit("gaps: "), F.col("gaps")))
    return reduce(DataFrame.unionByName, [missing, orphaned, gaps])


def workflow_types(files: DataFrame) -> DataFrame:
    """``skill, workflow_type``: ``complex``, ``simple-workflow`` or ``simple-utility``."""
    prompts = _prompts(files).select("skill").distinct().withColumn("has_prompts", F.lit(True))
    is_like = lambda p: F.rlike("content", F.lit(p))
    staged = is_like(r"(?:prompts/)?\d+-\S+\.md") | (F.coalesce("has_prompts", F.lit(False)) & is_like(r"(?i)(rout|stage|branch|path)"))
    kind = F.when(staged, "complex").when(is_like(r"(?m)^\d+\.\s"), "simple-workflow").otherwise("simple-utility")
    return _main(files).join(prompts, "skill", "left").select("skill", kind.alias("workflow_type"))


def integrity(files: DataFrame) -> DataFrame:
    """All findings of workflows. A skill without a main file has that finding only."""
    main = _main(files)
    complete = files.join(main.select("skill"), "skill", "left_semi")
    bare = files.select("skill").distinct().join(main.select("skill"), "skill", "left_anti")
    absent = bare.select("skill", F.lit(MAIN).alias("file"), F.lit(1).alias("line_no"), F.lit("critical").alias("severity"), F.lit("missing-file").alias("category"), F.lit(MAIN).alias("detail"))
    read = complete.where((F.col("path") == MAIN) | F.rlike("path", F.lit(NUMBERED)))
    parts = [
        absent, front_matter_findings(complete), missing_sections(main, F.array(*map(F.lit, SECTIONS))), invalid_sections(complete),
        line_findings(read, (*DIRECTNESS, artifact_rule())), stage_findings(complete), prompt_findings(prompt_basics(complete)),
    ]
    return reduce(DataFrame.unionByName, parts)


def summary(skills: DataFrame, found: DataFrame) -> DataFrame:
    """Findings of every skill by severity and its status, those without findings included."""
    rolled = skills.select("skill").distinct().join(findings.roll_up(found, "skill"), "skill", "left").na.fill(0)
    return rolled.withColumn("status", findings.status("integrity"))


def memory_agents(files: DataFrame) -> DataFrame:
    """``skill, content, is_memory_agent``: whether templates, or the laws in the main file, make a skill one."""
    templates = files.where(F.rlike("path", F.lit(r"^assets/[^/]*-template\.md$"))).select("skill").distinct().withColumn("templates", F.lit(True))
    has = lambda word: F.contains("content", F.lit(word))
    laws = has("First Law:") & has("Second Law:") & has("Sacred Truth")
    return _main(files).join(templates, "skill", "left").select("skill", "path", "content", (F.coalesce("templates", F.lit(False)) | laws).alias("is_memory_agent"))


def agent_findings(files: DataFrame) -> DataFrame:
    """Findings of agents, whose fields and sections differ from those of workflows."""
    agents = memory_agents(files)
    required = F.when(F.col("is_memory_agent"), F.array(*map(F.lit, MEMORY_AGENT_SECTIONS))).otherwise(F.array(*map(F.lit, AGENT_SECTIONS)))
    parts = [front_matter_findings(files, AGENT_FIELDS, agent=True), missing_sections(agents, required), invalid_sections(files), line_findings(_main(files), (*DIRECTNESS, artifact_rule(AGENT_BLOCKS)))]
    return reduce(DataFrame.unionByName, parts)


def memory_paths(files: DataFrame) -> DataFrame:
    """``skill, memory_path``: the paths of memory that the main file and the files beside it name."""
    read = _filled(files).where((F.col("path") == MAIN) | F.rlike("path", F.lit(r"^(?:prompts|resources|references)/[^/]*\.(?:md|json|ya?ml)$")))
    return read.select("skill", F.explode(F.regexp_extract_all("content", F.lit(r"memory/[\w\-/]+(?:\.\w+)?"), F.lit(0))).alias("memory_path")).distinct()


def root_files(files: DataFrame) -> DataFrame:
    """Markdown files that stand beside the main file, as findings."""
    beside = files.where(F.rlike("path", F.lit(r"^[^/]+\.md$")) & (F.col("path") != MAIN))
    return beside.select("skill", F.col("path").alias("file"), F.lit(0).alias("line_no"), F.lit("high").alias("severity"), F.lit("structure").alias("category"), F.col("path").alias("detail"))


def _headings(content: Column) -> Column:
    return F.transform(F.filter(F.split(content, "\n"), lambda x: F.rlike(x, F.lit(r"^#{2,3}\s+.+"))), F.lower)


def _present(headings: Column, wanted: tuple[str, ...]) -> Column:
    """How many of the titles some heading contains, whatever their case."""
    return F.size(F.filter(F.array(*(F.lit(w.lower()) for w in wanted)), lambda w: F.exists(headings, lambda h: F.contains(h, w))))


def sanctum(files: DataFrame) -> DataFrame:
    """Templates, sections and cross checks of every memory agent that has templates.

    ``n_templates`` counts the standard ones, ``creed_missing`` and
    ``breath_missing`` the sections that lack (null without the file), ``style``
    is told from the first breath's sections. ``templates_match`` and
    ``name_match`` compare the initialising script with the folder; they are
    null where there is no script.
    """
    kept = _filled(files)
    named = F.regexp_extract("path", r"^assets/([^/]*-template\.md)$", 1)
    inventory = kept.withColumn("template", named).where("template <> ''").groupBy("skill").agg(
        F.array_sort(F.collect_set("template")).alias("templates"),
        F.max(F.when(F.col("template") == "CREED-template.md", len(CREED_SECTIONS) - _present(_headings(F.col("content")), CREED_SECTIONS))).alias("creed_missing"),
    )
    one = lambda path, name: kept.where(F.col("path") == path).select("skill", F.col("content").alias(name))
    joined = inventory.join(one(MAIN, "main"), "skill", "left").join(one("references/first-breath.md", "breath"), "skill", "left").join(one("scripts/init-sanctum.py", "script"), "skill", "left")
    heads = _headings(F.col("breath"))
    has = lambda word: F.coalesce(F.exists(heads, lambda h: F.contains(h, F.lit(word))), F.lit(False))
    style = F.when(has("absorb"), "calibration").when(has("discovery"), "configuration").otherwise("unknown")
    lacking = {k: len(v) - _present(heads, v) for k, v in BREATH_SECTIONS.items()}
    listed = F.regexp_extract_all(F.regexp_extract("script", r"(?s)TEMPLATE_FILES\s*=\s*\[(.*?)\]", 1), F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1))
    skill_name = F.regexp_extract("script", r"SKILL_NAME\s*=\s*[\"']([^\"']+)[\"']", 1)
    standard = F.array(*map(F.lit, TEMPLATES))
    return joined.select(
        "skill", F.size(F.array_intersect("templates", standard)).alias("n_templates"), "creed_missing", style.alias("style"),
        F.when(F.col("breath").isNotNull(), F.when(style == "calibration", lacking["calibration"]).otherwise(lacking["configuration"])).alias("breath_missing"),
        (F.coalesce(content_lines(F.col("main")), F.lit(0)) > BOOT_LINES).alias("boot_too_long"),
        F.when(F.col("script").isNotNull(), F.array_sort(F.array_distinct(listed)) == F.col("templates")).alias("templates_match"),
        F.when(F.col("script").isNotNull(), skill_name == F.col("skill")).alias("name_match"),
    )
