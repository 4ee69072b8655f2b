"""Verdicts on modules against rules told in Python, on headers and entries that are odd."""

from collections import Counter

from storylake.operators import modules

SETUP = [f"a-setup/{f}" for f in modules.SETUP_FILES]


def tables(spark, tmp_path, listing, definitions, catalogs):
    """The three tables, catalogs read from files."""
    spark.createDataFrame([(m, i + 1, c) for m, rows in catalogs.items() for i, c in enumerate(rows)], "module string, row_no int, cells array<string>").write.parquet(str(tmp_path / "catalogs"))
    files = spark.createDataFrame([(m, p) for m, paths in listing.items() for p in paths], "module string, path string")
    return files, spark.createDataFrame(list(definitions.items()), "module string, settings map<string, string>"), spark.read.parquet(str(tmp_path / "catalogs"))


def entry(skill, code="", name="shown", action="run", after="", before=""):
    return ["m", skill, name, code, "told", action, "", "", after, before, "", "", ""]


def test_verdicts_of_odd_modules(spark, tmp_path):
    head, whole = list(modules.CATALOG), {"code": "c", "name": "n", "description": "d"}
    lone = [c for c in head if c != "after"]
    listing = {
        "good": [*SETUP, "k1/SKILL.md", "k1/SKILL.md", "k2/SKILL.md"], "odd": [*SETUP, "k1/SKILL.md", "b-setup/SKILL.md"], "short": [*SETUP, "k1/SKILL.md"], "bare": [*SETUP, "k1/SKILL.md"], "empty": [*SETUP, "k1/SKILL.md"],
        "alone": ["k/SKILL.md", *(f"k/{f}" for f in modules.STANDALONE_FILES), "z/assets/module.yaml"], "less": ["k/SKILL.md", "k/assets/module.yaml"], "two": ["k/SKILL.md", "l/SKILL.md", "k/assets/module.yaml"], "none": ["SKILL.md", "/SKILL.md", "x-setup"],
    }
    catalogs = {
        "good": [head, entry("k1", "A", after="k2:run, k1:run"), entry("k2", "B", before="k1:run"), entry("a-setup")],
        "odd": [head, entry("k1", "A", after="no:run, no:run,k1:run"), entry("k1", "A", name=" ", before="no:run"), entry("", "C", after=":run"), entry("gone", "A", action="", after="gone:"), entry("k1")[:5]],
        "short": [lone, [c for i, c in enumerate(entry("k1", before="k9:run")) if i != 8]], "empty": [head], "alone": [head, entry("k")], "less": [head, entry("x")], "two": [head, entry("x")],
    }
    definitions = {m: whole for m in listing} | {"odd": {"code": "", "name": "n"}}
    found, verdict = modules.verdicts(*tables(spark, tmp_path, listing, definitions, catalogs))
    expected = Counter({
        ("odd", "high", "yaml", "code"): 1, ("odd", "high", "yaml", "description"): 1, ("odd", "medium", "csv-columns", "6: 5"): 1, ("odd", "high", "missing-field", "3: display-name"): 1, ("odd", "high", "missing-field", "4: skill"): 1,
        ("odd", "high", "missing-field", "6: menu-code"): 1, ("odd", "high", "missing-entry", "b-setup"): 1, ("odd", "high", "orphan-entry", ""): 1, ("odd", "high", "orphan-entry", "gone"): 1, ("odd", "high", "duplicate-menu-code", "A"): 1,
        ("odd", "medium", "invalid-ref", "after no:run"): 2, ("odd", "medium", "invalid-ref", "before no:run"): 1, ("odd", "medium", "invalid-ref", "after :run"): 1, ("odd", "medium", "invalid-ref", "after gone:"): 1,
        ("short", "high", "csv-header", "missing: after"): 1, ("short", "medium", "csv-columns", "2: 12"): 1, ("short", "medium", "invalid-ref", "before k9:run"): 1, ("short", "high", "missing-field", "2: menu-code"): 1,
        ("good", "high", "missing-field", "4: menu-code"): 1, ("alone", "high", "missing-field", "2: menu-code"): 1, ("empty", "high", "csv-empty", ""): 1, ("two", "critical", "structure", "no setup skill and no standalone module"): 1, ("none", "critical", "structure", "no setup skill and no standalone module"): 1,
        **{("less", "critical", "structure", f): 1 for f in modules.STANDALONE_FILES[1:]},
    })
    assert Counter(map(tuple, found.select("module", "severity", "category", "detail").collect())) == expected
    rows = {r.module: r for r in verdict.collect()}
    totals = Counter()
    for (module, *_), n in expected.items():
        totals[module] += n
    assert {m: r.total for m, r in rows.items()} == {m: totals[m] for m in listing}
    assert {m: (r.kind, r.folder, r.n_entries) for m, r in rows.items()} == {
        "good": ("setup", "a-setup", 3), "odd": ("setup", "a-setup", 5), "short": ("setup", "a-setup", 1), "bare": ("setup", "a-setup", None), "empty": ("setup", "a-setup", None), "alone": ("standalone", "k", 1), "less": ("standalone", "k", None), "two": ("none", "", None), "none": ("none", "", None),
    }
    assert rows["bare"].status == "pass" and rows["odd"].status == "fail"


def test_rows_of_catalogs_are_read_once(spark, tmp_path):
    """The cells of catalogs' rows are many times larger than all else."""
    files, definitions, catalogs = tables(spark, tmp_path, {"m": SETUP}, {"m": {}}, {"m": [list(modules.CATALOG), entry("k")]})
    _, verdict = modules.verdicts(files, definitions, catalogs)
    plan = verdict._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cells#") > 0 and sum("Relation" in line and "cells#" in line for line in plan.splitlines()) == 1
