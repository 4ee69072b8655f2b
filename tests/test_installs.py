"""Installs of modules against one project at a time in plain dictionaries, and edge cases."""

import random

from storylake.operators import installs

TABLES = {
    "definitions": "project string, key string, value string, variable boolean, result string, user_setting boolean", "answers": "project string, part string, key string, value string",
    "existing": "project string, scope string, key string, value string", "existing_user": "project string, key string, value string", "legacy": "project string, folder string, key string, value string",
}


def run(spark, **rows):
    t = {name: spark.createDataFrame(rows.get(name, []), ddl) for name, ddl in TABLES.items()}
    return installs.installed(*t.values())


def plain(project, rows):
    """The settings of one project, step by step: sections with "" as the root, the user's settings, the status."""
    mine = {name: [r[1:] for r in rows.get(name, []) if r[0] == project] for name in TABLES}
    settings, user = {}, dict(mine["existing_user"])
    for scope, key, value in mine["existing"]:
        settings.setdefault(scope, {})[key] = value
    lines = {r[0]: r for r in mine["definitions"]}
    code = lines["code"][1] if "code" in lines else None
    if not lines or not code:
        return settings, user, "no_code" if lines else "no_source"
    core, own = {}, {}
    for folder in (code, "core"):
        for at, key, value in mine["legacy"]:
            if at == folder and key in installs.CORE_KEYS:
                core[key] = value
            elif at == folder != "core" and key in lines and lines[key][2]:
                own[key] = value
    core |= {k: v for p, k, v in mine["answers"] if p == "core"}
    own |= {k: v for p, k, v in mine["answers"] if p == "module"}
    root = settings.pop("", {}) | settings.pop("core", {})
    root = {k: v for k, v in (root | core).items() if k not in installs.USER_KEYS}
    section = {k: lines[k][1] for k in installs.METADATA if k in lines} | {"version": lines["module_version"][1] if "module_version" in lines else None}
    for key, value in own.items():
        template = lines[key][3] if key in lines and lines[key][2] else None
        section[key] = value if template is None or value is None or "{project-root}" in value else template.replace("{value}", value)
        if template is not None and value is None:
            section[key] = None
    settings |= {"": root, code: section}
    user |= {k: v for k, v in core.items() if k in installs.USER_KEYS} | {k: v for k, v in own.items() if k in lines and lines[k][2] and lines[k][4]}
    return settings, user, "success"


def test_installs_equal_one_project_at_a_time(spark):
    rnd = random.Random(5)
    keys = [*installs.CORE_KEYS, "docs", "plan", "name", "free"]
    rows = {name: [] for name in TABLES}
    value = lambda: rnd.choice([None, "", "v", "{project-root}/w", "x{value}"])
    some = lambda: rnd.sample(keys, rnd.randint(0, 5))
    for n in range(60):
        p = f"p{n}"
        code = rnd.choice(["m", "m", "m", "core", "", None])
        if n % 6:
            rows["definitions"] += [(p, "code", code, False, None, False), (p, "title", "t", False, None, False)]
            rows["definitions"] += [(p, k, rnd.choice(["a", None]), False, None, False) for k in rnd.sample(["name", "description", "default_selected", "module_version"], rnd.randint(0, 4))]
            rows["definitions"] += [(p, k, None, True, rnd.choice([None, "<{value}>", "{project-root}/{value}"]), rnd.random() < 0.5) for k in rnd.sample(["docs", "plan"], rnd.randint(0, 2))]
        rows["answers"] += [(p, part, k, value()) for part in ("core", "module") for k in some()]
        rows["existing"] += [(p, s, k, value()) for s in ("", "core", "m", "other") for k in some()]
        rows["existing_user"] += [(p, k, value()) for k in some()]
        rows["legacy"] += [(p, f, k, value()) for f in ("core", "m", "other") if rnd.random() < 0.6 for k in some()]
    shared, user, report = run(spark, **rows)
    got_shared, got_user, status = {}, {}, {r.project: r for r in report.collect()}
    for r in shared.collect():
        got_shared.setdefault(r.project, {}).setdefault(r.scope, {})[r.key] = r.value
    for r in user.collect():
        got_user.setdefault(r.project, {})[r.key] = r.value
    for p in sorted(status):
        settings, own, how = plain(p, rows)
        assert got_shared.get(p, {}) == {s: v for s, v in settings.items() if v}, p
        assert (got_user.get(p, {}), status[p].status) == (own, how), p
    assert {r.status for r in status.values()} == {"success", "no_code", "no_source"}


def test_repeated_rows_nulls_and_empty_tables(spark):
    shared, user, report = run(spark)
    assert shared.count() == user.count() == report.count() == 0
    made = [("p", "code", "m", False, None, False), ("p", "docs", None, True, "<{value}>", True)]
    shared, user, report = run(
        spark, definitions=made * 2, answers=[("p", "module", "docs", "a"), ("p", "module", "docs", "b"), ("p", None, "docs", "z"), (None, "core", "k", "z"), ("p", "core", None, "z")],
        existing=[("p", None, "k", "1"), ("p", "", "k", "2"), ("p", "m", "gone", "3")], legacy=[("p", "m", "docs", "old"), ("p", None, "docs", "z"), ("p", "core", "user_name", "u")],
    )
    assert {tuple(r) for r in shared.collect()} == {("p", "", "k", "2"), ("p", "m", "version", None), ("p", "m", "docs", "<b>")}
    assert {tuple(r) for r in user.collect()} == {("p", "docs", "b"), ("p", "user_name", "u")}
    assert [tuple(r) for r in report.collect()] == [("p", "success", True, 2, 2, 2)]
