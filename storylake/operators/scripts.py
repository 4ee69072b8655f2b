"""Facts of script files: imports, calls, and an inventory by language."""

from __future__ import annotations

import ast
import warnings
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by extension, and the names under which a script's test may stand.
LANGUAGES = {".py": "python", ".sh": "shell", ".bash": "shell", ".js": "node", ".ts": "node", ".mjs": "node"}
TEST_NAMES = ("test_{stem}{ext}", "test-{stem}{ext}", "{stem}_test{ext}", "{stem}-test{ext}", "{stem}.test{ext}", "{stem}.spec{ext}")
#: Lines under which a script is too short to be one, and up to which it needs no frame.
SHORT, PLAIN = 5, 20
SIMPLE_IMPORTS = ("shutil", "glob", "fnmatch")
UNPINNED = r"\b(?:npx|uvx)\s+[a-zA-Z][\w-]+(?!\S*@)"
# Rules of shell lines: pattern, severity, category, title; comments are left out where the title says so.
SHELL = (
    (r"/usr/bin/(?:python|ruby|node|perl)\b", "medium", "portability", "Hardcoded interpreter path"),
    (r"\b(?:gsed|gawk|ggrep|gfind)\b", "medium", "portability", "Tool of one platform"),
)


def source_facts(source: str) -> list[tuple[int, str, str]]:
    """``(line, kind, name)`` of one Python source; a single ``error`` where it can't be parsed.

    Imported modules; calls of ``input`` and ``exit`` by name and of ``dumps``
    and ``exit`` as attributes; uses of the attribute ``ArgumentParser``. What
    stands in strings and comments is none of these.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # odd escapes in strings are no error
            nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return [(1, "error", "syntax")]
    found = []
    for node in nodes:
        if isinstance(node, ast.Import):
            found += [(node.lineno, "import", alias.name) for alias in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            found.append((node.lineno, "import", node.module))
        elif isinstance(node, ast.Call):
            named, owned = getattr(node.func, "id", None), getattr(node.func, "attr", None)
            if named in ("input", "exit") or owned in ("dumps", "exit"):
                found.append((node.lineno, "call", named or owned))
        elif isinstance(node, ast.Attribute) and node.attr == "ArgumentParser":
            found.append((node.lineno, "attribute", node.attr))
    return sorted(found)


def python_facts(files: DataFrame) -> DataFrame:
    """``path, line_no, kind, name`` of the Python files among ``path, content``, see :func:`source_facts`; null is empty."""
    sources = files.where(language(F.col("path")) == "python").select("path", F.coalesce("content", F.lit("")).alias("content"))
    kind = sources.schema["path"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(i, *fact) for i, source in enumerate(batch.column(1)) for fact in source_facts(source.as_py())]
            at, line, what, name = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(line, pa.int32()), pa.array(what, pa.string()), pa.array(name, pa.string())], names=["path", "line_no", "kind", "name"])

    return sources.mapInArrow(run, f"path {kind}, line_no int, kind string, name string")


def _issue(severity: str, category: str, title: str, line_no=None) -> Column:
    return F.struct((F.lit(1) if line_no is None else line_no).cast("int").alias("line_no"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(title).alias("title"))


def findings(files: DataFrame) -> DataFrame:
    """``path, line_no, severity, category, title`` of Python, shell and Node scripts ``path, content``.

    Of a Python script that can't be parsed only this and its dependencies are told.
    """
    text, lines = F.col("content"), F.split("content", "\n")
    known = files.select("path", F.coalesce("content", F.lit("")).alias("content"), language(F.col("path")).alias("language")).where("language IS NOT NULL").withColumn("n_lines", F.size(F.split("content", "\n")))
    facts = python_facts(known)
    is_call = lambda *names: (F.col("kind") == "call") & F.col("name").isin(*names)
    per_file = facts.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(is_call("input"), F.col("line_no")))).alias("asks"), F.count_if(F.col("kind") == "attribute").alias("parser"), F.count_if(is_call("dumps")).alias("dumps"),
        F.count_if(is_call("exit")).alias("exits"), F.collect_set(F.when(F.col("kind") == "import", F.col("name"))).alias("imports"), F.count_if(F.col("kind") == "error").alias("broken"),
    )
    has = lambda word: F.contains(text, F.lit(word))
    short = F.when(F.col("n_lines") < SHORT, _issue("medium", "over-engineered", "Could be a command in the prompt"))
    framed = lambda count, severity, title: F.when((F.coalesce(count, F.lit(0)) == 0) & (F.col("n_lines") > PLAIN), _issue(severity, "agentic-design", title))
    simple = F.size(F.array_intersect(F.coalesce("imports", F.array().cast("array<string>")), F.array(*map(F.lit, SIMPLE_IMPORTS)))) > 0
    needs = F.array(
        F.when(~has("# /// script"), F.when(has("import "), _issue("medium", "dependencies", "No inline dependencies"))).when(~has("requires-python"), _issue("low", "dependencies", "No version of Python named")),
        F.when(has("requirements.txt") | has("pip install"), _issue("high", "dependencies", "Dependencies outside the script")),
    )
    python = F.array(
        framed(F.col("parser"), "medium", "No argument parser"), framed(F.col("dumps"), "medium", "No structured output"), framed(F.col("exits"), "low", "No exit codes"),
        F.when(simple & (F.col("n_lines") < 30), _issue("low", "over-engineered", "Simpler as shell")), short,
    )
    asks = F.transform(F.coalesce("asks", F.array().cast("array<int>")), lambda n: _issue("critical", "agentic-design", "Asks for input", n))

    def on_lines(pattern: str, issue, comments: bool) -> Column:
        matched = F.transform(lines, lambda x, i: F.when(F.rlike(x, F.lit(pattern)) if comments else F.rlike(x, F.lit(pattern)) & ~F.rlike(x, F.lit(r"^\s*#")), issue(i + 1)))
        return F.filter(matched, lambda x: x.isNotNull())

    unpinned = lambda comments: on_lines(UNPINNED, lambda n: _issue("medium", "dependencies", "Version not pinned", n), comments)
    # A variable counts if an even number of quotes stands before it, and none beside it.
    bare = F.flatten(F.transform(lines, lambda x, i: F.transform(F.when(F.rlike(x, F.lit(r"^\s*#")), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(F.regexp_replace(x, r'"[^"]*("|$)', '""'), F.lit(r'(?<!")\$\w+(?!")'), F.lit(0))), lambda m: _issue("low", "portability", "Unquoted variable", i + 1))))
    first = lines[0]
    shell = F.concat(
        F.array(
            F.when(~F.startswith(first, F.lit("#!")), _issue("high", "portability", "No shebang")).when(~F.contains(first, F.lit("/usr/bin/env")), _issue("medium", "portability", "Shebang with a fixed path")),
            F.when(~has("set -e"), _issue("medium", "error-handling", "Errors are ignored")), short,
        ),
        *(on_lines(pattern, partial(_issue, *rest), True) for pattern, *rest in SHELL), bare, unpinned(False),
    )
    broken = F.array(_issue("critical", "error-handling", "Can't be parsed"))
    issues = F.when(F.col("language") == "python", F.concat(needs, F.when(F.coalesce("broken", F.lit(0)) > 0, broken).otherwise(F.concat(python, asks)))).when(F.col("language") == "shell", shell).otherwise(F.concat(F.array(short), unpinned(True)))
    found = known.join(per_file, "path", "left").select("path", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("i"))
    return found.select("path", "i.line_no", "i.severity", "i.category", "i.title")


def language(path: Column) -> Column:
    found = F
    for ending, name in LANGUAGES.items():
        found = found.when(F.endswith(F.lower(path), F.lit(ending)), name)
    return found.otherwise(F.lit(None).cast("string"))


def inventory(files: DataFrame) -> DataFrame:
    """``path, name, language, tested`` of every script; a test is looked for among the files of ``tests/``."""
    named = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), language(F.col("path")).alias("language"), F.contains("path", F.lit("tests/")).alias("is_test"))
    scripts = named.where("language IS NOT NULL AND NOT is_test").withColumns({"stem": F.regexp_extract("name", r"^(.*)(\.[^.]+)$", 1), "ext": F.regexp_extract("name", r"^(.*)(\.[^.]+)$", 2)})
    filled = [F.concat(*(F.col(p) if p in ("stem", "ext") else F.lit(p) for p in t.replace("{stem}", "\0stem\0").replace("{ext}", "\0ext\0").split("\0") if p)) for t in TEST_NAMES]
    wanted = scripts.select("path", F.explode(F.array(*filled)).alias("test"))
    tested = wanted.join(named.where("is_test").select(F.col("name").alias("test")).distinct(), "test", "left_semi").select("path").distinct().withColumn("tested", F.lit(True))
    return scripts.join(tested, "path", "left").select("path", "name", "language", F.coalesce("tested", F.lit(False)).alias("tested"))


def by_language(scripts: DataFrame) -> DataFrame:
    """Scripts of :func:`inventory` by language, and how many lack a test."""
    return scripts.groupBy("language").agg(F.count("*").alias("n"), F.count_if(~F.col("tested")).alias("n_untested"))


def literals(source: Column) -> dict[str, Column]:
    """Values that a script's source sets: its skill's name, its lists of templates and of skipped files, and whether it evolves (null if not set)."""
    strings = lambda block: F.regexp_extract_all(block, F.lit("[\"']([^\"']+)[\"']"), F.lit(1))
    evolves = F.regexp_extract(source, r"(?m)^EVOLVABLE\s*=\s*(True|False)", 1)
    return {
        "skill_name": F.regexp_extract(source, r"(?m)^SKILL_NAME\s*=\s*[\"']([^\"']+)[\"']", 1),
        "templates": strings(F.regexp_extract(source, r"(?s)TEMPLATE_FILES\s*=\s*\[(.*?)\]", 1)),
        "skipped": strings(F.regexp_extract(source, r"(?s)SKILL_ONLY_FILES\s*=\s*\{(.*?)\}", 1)),
        "evolvable": F.when(evolves != "", evolves == "True"),
    }
