"""Integrity of a module's catalog against its folders, as findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylake.operators.findings import SEVERITIES
from storylake.operators.merge import broken_references, duplicate_keys
from storylake.sources.shared import settled


def _finding(rows: DataFrame, severity: str, category: str, detail) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), detail.alias("detail"))


def required_files(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """A critical finding for every wanted ``path`` that doesn't exist."""
    return _finding(wanted.join(existing.select("path").distinct(), "path", "left_anti"), "critical", "missing-file", F.col("path"))


def check(catalog: DataFrame, folders: DataFrame) -> DataFrame:
    """``severity, category, detail`` of a catalog ``row_no, skill, action, code, name, after, before``.

    ``folders`` lists ``skill`` folders. Checks: folders without an entry,
    entries without a folder, codes used twice (names in row order), and
    references to ``skill:action`` pairs that no complete row has.
    """
    entries = catalog.where("trim(coalesce(skill, '')) <> ''").withColumn("skill", F.trim("skill"))
    missing = _finding(folders.join(entries.select("skill").distinct(), "skill", "left_anti"), "high", "missing-entry", F.col("skill"))
    orphans = _finding(entries.join(folders.select("skill").distinct(), "skill", "left_anti").select("skill").distinct(), "high", "orphan-entry", F.col("skill"))
    twice = _finding(duplicate_keys(entries.where("code <> ''"), "code", "name", "row_no"), "high", "duplicate-code", F.concat_ws(": ", "code", "names"))
    valid = entries.where("action <> ''").select(F.concat_ws(":", "skill", "action").alias("ref"))
    broken = [_finding(broken_references(entries, "skill", side, valid), "medium", f"invalid-{side}", F.concat_ws(" -> ", "skill", "ref")) for side in ("after", "before")]
    return reduce(DataFrame.unionByName, [missing, orphans, twice, *broken])


def next_steps(catalog: DataFrame, completed: DataFrame) -> DataFrame:
    """What to do next: of the rows not completed, the optional ones of the earliest open phase and its first required one.

    ``catalog`` has ``code, phase, ord, required``.
    """
    left = catalog.join(completed.select("code").distinct(), "code", "left_anti")
    phase = left.where("required").agg(F.min("phase").alias("phase"))
    first = left.where("required").agg(F.min(F.struct("phase", "ord")).alias("first"))
    current = left.join(F.broadcast(phase), "phase", "left_semi")
    return current.join(F.broadcast(first)).where("NOT required OR ord = first.ord").select("code", "phase", "ord", "required")


# Files that a module must have, columns of its catalog, fields of its definition and its entries.
SETUP_FILES = ("SKILL.md", "assets/module.yaml", "assets/module-help.csv")
STANDALONE_FILES = ("assets/module.yaml", "assets/module-help.csv", "assets/module-setup.md", "scripts/merge-config.py", "scripts/merge-help-csv.py")
CATALOG = ("module", "skill", "display-name", "menu-code", "description", "action", "args", "phase", "after", "before", "required", "output-location", "outputs")
DEFINITION_FIELDS = ("code", "name", "description")
ENTRY_FIELDS = ("skill", "display-name", "menu-code", "description")
READ_FIELDS = (*ENTRY_FIELDS, "action", "after", "before")


def skill_folders(files: DataFrame) -> DataFrame:
    """``module, folder``: direct children that hold a main file, of a listing ``module, path``."""
    return files.where(F.rlike("path", F.lit(r"^[^/]+/SKILL\.md$"))).select("module", F.regexp_extract("path", "^([^/]+)/", 1).alias("folder")).distinct()


def structure(files: DataFrame) -> DataFrame:
    """``module, kind, folder, missing`` of a listing ``module, path``.

    ``kind`` is ``setup`` if a folder's name ends in ``-setup`` (the first by
    name), ``standalone`` if the only skill folder holds a definition, else
    ``none``. ``missing`` lists the required files that the folder lacks.
    """
    top = files.select("module", "path", F.substring_index("path", "/", 1).alias("folder"))
    at = lambda file: (F.col("folder") != "") & (F.col("path") == F.concat("folder", F.lit(f"/{file}")))
    first = lambda test: F.min(F.when(test, F.col("folder")))
    setup, skill = F.endswith("folder", F.lit("-setup")) & F.contains("path", F.lit("/")), at("SKILL.md")
    # The least setup folder holds a file if it is also the least of those that hold it; the least and the last skill folder tell whether there is one only.
    known = top.groupBy("module").agg(first(setup).alias("setup"), first(skill).alias("single"), F.max(F.when(skill, F.col("folder"))).alias("last"), *(first(setup & at(f)).alias(f"holds{i}") for i, f in enumerate(SETUP_FILES)))
    known = known.withColumn("single", F.when(F.col("setup").isNull() & (F.col("single") == F.col("last")), F.col("single")))
    held = F.coalesce(*(F.when(at(f), F.lit(f)) for f in STANDALONE_FILES))
    others = top.where(~setup).select("module", F.col("folder").alias("single"), held.alias("file")).where("file IS NOT NULL").groupBy("module", "single").agg(F.collect_set("file").alias("held"))
    known = known.join(others, ["module", "single"], "left")
    alone = F.array_contains("held", STANDALONE_FILES[0])
    kind = F.when(F.col("setup").isNotNull(), "setup").when(alone, "standalone").otherwise("none")
    of_setup = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f"holds{i}") != F.col("setup"), F.lit(True)), F.lit(f)) for i, f in enumerate(SETUP_FILES))))
    missing = F.when(F.col("setup").isNotNull(), of_setup).when(alone, F.array_except(F.array(*map(F.lit, STANDALONE_FILES)), "held"))
    return known.select("module", kind.alias("kind"), F.coalesce("setup", F.when(alone, F.col("single")), F.lit("")).alias("folder"), F.coalesce(F.array_join(F.array_sort(missing), ", "), F.lit("")).alias("missing"))


def definition_findings(definitions: DataFrame) -> DataFrame:
    """Fields that a definition ``module, settings`` (a map) lacks or leaves empty."""
    lacking = F.filter(F.array(*map(F.lit, DEFINITION_FIELDS)), lambda f: F.coalesce(F.try_element_at("settings", f), F.lit("")) == "")
    return definitions.select("module", F.explode(lacking).alias("detail")).select("module", F.lit("high").alias("severity"), F.lit("yaml").alias("category"), "detail")


def header_told(cells: str) -> Column:
    """What a catalog's header lacks and has too much, null if it is as it should be."""
    named = F.array(*map(F.lit, CATALOG))
    less, more = F.array_sort(F.array_except(named, F.col(cells))), F.array_sort(F.array_except(F.col(cells), named))
    told = F.concat_ws("; ", F.when(F.size(less) > 0, F.concat(F.lit("missing: "), F.array_join(less, ", "))), F.when(F.size(more) > 0, F.concat(F.lit("extra: "), F.array_join(more, ", "))))
    return F.when(F.col(cells) != named, told)


def catalog_findings(catalogs: DataFrame) -> DataFrame:
    """Findings of catalogs ``module, row_no, cells``, the header being row 1: its columns, no entries, odd numbers of cells, empty fields."""
    header, rows = catalogs.where("row_no = 1"), catalogs.where("row_no > 1")
    shown = lambda frame, severity, category, detail: frame.select("module", F.lit(severity).alias("severity"), F.lit(category).alias("category"), detail.alias("detail"))
    heads = shown(header.where(header_told("cells").isNotNull()), "high", "csv-header", header_told("cells"))
    empty = shown(header.select("module").join(rows.select("module").distinct(), "module", "left_anti"), "high", "csv-empty", F.lit(""))
    odd = shown(rows.where(F.size("cells") != len(CATALOG)), "medium", "csv-columns", F.concat_ws(": ", F.col("row_no").cast("string"), F.size("cells").cast("string")))
    placed = rows.join(header.select("module", F.col("cells").alias("names")), "module")
    at = lambda field: F.coalesce(F.try_element_at("cells", F.array_position("names", field).cast("int")), F.lit(""))
    blank = placed.select("module", "row_no", F.explode(F.array(*(F.when((F.array_position("names", f) == 0) | (F.trim(at(f)) == ""), F.lit(f)) for f in ENTRY_FIELDS))).alias("field")).where("field IS NOT NULL")
    return reduce(DataFrame.unionByName, [heads, empty, odd, shown(blank, "high", "missing-field", F.concat_ws(": ", F.col("row_no").cast("string"), F.col("field")))])


def row_findings(files: DataFrame, heads: DataFrame, catalogs: DataFrame) -> DataFrame:
    """``module, severity, category, detail, n``: what catalogs ``module, row_no, cells`` and the folders of a listing ``module, path`` tell, row by row and of each other.

    Rows with odd numbers of cells or empty fields, folders without an entry (the
    setup folder needs none), entries without a folder, codes of several entries,
    and references to ``skill:action`` pairs that no entry makes. ``heads`` names
    the modules to check: ``module, setup, at, n_entries`` with the places of
    ``READ_FIELDS`` in the header, null without one. Rows meet their header once
    and become facts, of which all that name the same text meet once more.
    """
    fact = lambda kind, key, **told: F.struct(F.lit(kind).alias("kind"), key.alias("key"), *(F.lit(told.get(c, 0)).alias(c) for c in ("made", "held", "after", "before")))
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.get("at", F.lit(i)) - 1), F.lit("")))
    rows = catalogs.where("row_no > 1").join(heads.select("module", "setup", "at"), "module").select("module", F.col("row_no").cast("string").alias("row_no"), F.size("cells").alias("n_cells"), "setup", F.col("at").isNotNull().alias("headed"), *(cell(i).alias(f) for i, f in enumerate(READ_FIELDS)))
    skill, code, pair = F.col("skill"), F.col("menu-code"), F.when((F.col("skill") != "") & (F.col("action") != ""), F.concat_ws(":", "skill", "action"))
    unless_setup = lambda c: ~F.coalesce(c == F.col("setup"), F.lit(False))
    odd = F.when(F.col("n_cells") != len(CATALOG), fact("csv-columns", F.concat_ws(": ", "row_no", F.col("n_cells").cast("string")), made=1))
    own = [F.when(unless_setup(skill), fact("skill", skill, made=1)), F.when(code != "", fact("code", code, made=1)), F.when(pair.isNotNull(), fact("ref", pair, made=1))]
    own += [F.when(F.col(f) == "", fact("missing-field", F.concat_ws(": ", "row_no", F.lit(f)), made=1)) for f in ENTRY_FIELDS]
    # An entry that names itself needs no other, and most name one or none.
    asked = lambda side: F.when((F.col(side) == "") | ((F.col(side) == F.coalesce(pair, F.lit(""))) & ~F.contains(F.col(side), F.lit(","))), F.array()).otherwise(F.transform(F.filter(F.transform(F.split(side, ","), lambda r: F.trim(r)), lambda r: r != ""), lambda r: fact("ref", r, **{side: 1})))
    facts = rows.select("module", F.explode(F.concat(F.array(odd), F.when(F.col("headed"), F.concat(F.array(*own), asked("after"), asked("before"))).otherwise(F.array()))).alias("f")).where("f IS NOT NULL").select("module", "f.*")
    full = heads.where("n_entries > 0").select("module", "setup").distinct()
    folders = files.where(F.rlike("path", F.lit(r"^[^/]+/SKILL\.md$"))).select("module", F.regexp_extract("path", "^([^/]+)/", 1).alias("skill")).join(full, "module").where(unless_setup(skill))
    facts = facts.unionByName(folders.select("module", fact("skill", skill, held=1).alias("f")).select("module", "f.*"))
    met = facts.groupBy("module", "kind", "key").agg(*(F.sum(c).alias(c) for c in ("made", "held", "after", "before")))
    told = lambda severity, category, detail, n: F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), detail.alias("detail"), F.lit(n).cast("long").alias("n"))
    kind, made, key = F.col("kind"), F.col("made"), F.col("key")
    found = F.array(
        F.when((kind == "skill") & (made == 0), told("high", "missing-entry", key, 1)).when((kind == "skill") & (F.col("held") == 0), told("high", "orphan-entry", key, 1))
        .when((kind == "code") & (made > 1), told("high", "duplicate-menu-code", key, 1)).when(kind == "missing-field", told("high", "missing-field", key, made)).when(kind == "csv-columns", told("medium", "csv-columns", key, made)),
        *(F.when((kind == "ref") & (made == 0) & (F.col(side) > 0), told("medium", "invalid-ref", F.concat_ws(" ", F.lit(side), key), F.col(side))) for side in ("after", "before")),
    )
    return met.select("module", F.explode(found).alias("f")).where("f IS NOT NULL").select("module", "f.*")


def verdicts(files: DataFrame, definitions: DataFrame, catalogs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings ``module, severity, category, detail`` and one verdict of every module of the listing ``module, path``.

    Checks stop early, module by module: without a setup folder or a standalone
    skill that is the only finding; where required files lack, these are; where
    the catalog has no entries, what its rows would tell is left out. A verdict is
    ``module, status, total, n_critical, n_high, n_medium, n_low`` with what is
    known by then: ``kind, folder, code, name, n_entries`` (null after a stop).
    """
    # What several checks read has a row a module and is written once; the rows of catalogs are read by one check only.
    shape = settled(structure(files), "shape")
    critical = lambda frame, detail: frame.select("module", F.lit("critical").alias("severity"), F.lit("structure").alias("category"), detail.alias("detail"))
    none = critical(shape.where("kind = 'none'"), F.lit("no setup skill and no standalone module"))
    lacking = critical(shape.where("missing <> ''"), F.explode(F.split("missing", ", ")))
    going = shape.where("kind <> 'none' AND missing = ''")
    definitions = settled(definitions.join(going, "module", "left_semi").select("module", "settings"), "definitions")
    header = catalogs.where("row_no = 1").select("module", header_told("cells").alias("told"), F.array(*(F.array_position("cells", f).cast("int") for f in READ_FIELDS)).alias("at"))
    entries = catalogs.where("row_no > 1").groupBy("module").agg(F.count("*").alias("n_entries"))
    heads = settled(going.select("module", F.when(F.col("kind") == "setup", F.col("folder")).alias("setup")).join(header, "module", "left").join(entries, "module", "left"), "heads")
    high = lambda frame, category, detail: frame.select("module", F.lit("high").alias("severity"), F.lit(category).alias("category"), detail.alias("detail"))
    heading = [high(heads.where("told IS NOT NULL"), "csv-header", F.col("told")), high(heads.where("at IS NOT NULL AND n_entries IS NULL"), "csv-empty", F.lit(""))]
    once = reduce(DataFrame.unionByName, [none, lacking, definition_findings(definitions), *heading]).withColumn("n", F.lit(1).cast("long"))
    counted = once.unionByName(row_findings(files, heads, catalogs))
    found = counted.select("module", "severity", "category", "detail", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("one")).drop("one")
    of = lambda level: F.sum(F.when(F.col("severity") == level, F.col("n")).otherwise(0)).alias(f"n_{level}")
    counts = counted.groupBy("module").agg(F.sum("n").alias("total"), *map(of, SEVERITIES))
    known = definitions.select("module", *(F.coalesce(F.try_element_at("settings", F.lit(k)), F.lit("")).alias(k) for k in ("code", "name")))
    joined = shape.join(counts, "module", "left").join(known, "module", "left").join(heads.groupBy("module").agg(F.max("n_entries").alias("n_entries")), "module", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", *(f"n_{level}" for level in SEVERITIES))]
    status = F.when(F.coalesce(F.col("n_critical") + F.col("n_high"), F.lit(0)) > 0, "fail").otherwise("pass")
    return found, joined.select("module", status.alias("status"), *numbers, "kind", "folder", "code", "name", "n_entries")


def cleanup_targets(module: Column, extras: Column) -> Column:
    """Folders to clean up, in order and once each: the module, ``core``, then further ones."""
    return F.array_distinct(F.concat(F.array(module, F.lit("core")), extras))


def file_counts(files: DataFrame) -> DataFrame:
    """Files below every folder of a listing ``module, path``, those of folders inside it included."""
    parts = F.split(F.concat_ws("/", "module", "path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count("*").alias("n_files"))


def copy_set(source: DataFrame, skipped: tuple[str, ...]) -> DataFrame:
    """``module, path`` of the files to copy: all but those whose name is to be skipped."""
    return source.where(~F.regexp_extract("path", "([^/]+)$", 1).isin(*skipped)).select("module", "path").distinct()


def not_installed(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """Skill folders of ``wanted`` that no installed listing ``path`` holds at any depth."""
    there = installed.where(F.rlike("path", F.lit(r"(^|/)SKILL\.md$"))).select(F.regexp_extract("path", r"([^/]+)/SKILL\.md$", 1).alias("folder")).distinct()
    return wanted.select("folder").distinct().join(there, "folder", "left_anti")


def capabilities(files: DataFrame, fields: Column, skipped: tuple[str, ...] = ()) -> DataFrame:
    """One markdown table a module of the files ``module, path`` whose ``fields`` (a map) give a name and a code."""
    has = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit(""))
    rows = files.where((has("name") != "") & (has("code") != "") & ~F.col("path").isin(*skipped))
    line = F.concat(F.lit("| ["), has("code"), F.lit("] | "), has("name"), F.lit(" | "), has("description"), F.lit(" |"))
    listed = rows.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("l"))
    return listed.select("module", F.size("l").alias("n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("table"))
