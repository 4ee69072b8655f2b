"""Rule tables for :mod:`storylake.operators.findings`: ``(pattern, severity, category, title)``, and the scans that are built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylake.functions.text import code_point_tokens
from storylake.operators import findings
from storylake.operators.lines import WALL_BREAK, doc_lines, line_arrays, walls
from storylake.operators.skills import LANGUAGE_VARIABLES, PROGRESSION

# Prompt phrases that waste tokens.
WASTE = (
    (r"\b[Mm]ake sure (?:to|you)\b", "low", "defensive-padding", 'Defensive: "make sure to/you"'),
    (r"\b[Dd]on'?t forget (?:to|that)\b", "low", "defensive-padding", 'Defensive: "don\'t forget"'),
    (r"\b[Rr]emember (?:to|that)\b", "low", "defensive-padding", 'Defensive: "remember to/that"'),
    (r"\b[Bb]e sure to\b", "low", "defensive-padding", 'Defensive: "be sure to"'),
    (r"\b[Pp]lease ensure\b", "low", "defensive-padding", 'Defensive: "please ensure"'),
    (r"\b[Ii]t is important (?:to|that)\b", "low", "defensive-padding", 'Defensive: "it is important"'),
    (r"\b[Yy]ou are an AI\b", "low", "meta-explanation", 'Meta: "you are an AI"'),
    (r"\b[Aa]s a language model\b", "low", "meta-explanation", 'Meta: "as a language model"'),
    (r"\b[Aa]s an AI assistant\b", "low", "meta-explanation", 'Meta: "as an AI assistant"'),
    (r"\b[Tt]his (?:workflow|skill|process) is designed to\b", "low", "meta-explanation", 'Meta: "this workflow is designed to"'),
    (r"\b[Tt]he purpose of this (?:section|step) is\b", "low", "meta-explanation", 'Meta: "the purpose of this section is"'),
    (r"\b[Ll]et'?s (?:think about|begin|start)\b", "low", "filler", 'Filler: "let\'s think/begin"'),
    (r"\b[Nn]ow we(?:'ll| will)\b", "low", "filler", 'Filler: "now we\'ll"'),
)

# References that a text can't resolve alone.
BACK_REFERENCES = (
    (r"\bas described above\b", "medium", "back-reference", 'Back-reference: "as described above"'),
    (r"\bper the overview\b", "medium", "back-reference", 'Back-reference: "per the overview"'),
    (r"\bas mentioned (?:above|in|earlier)\b", "medium", "back-reference", 'Back-reference: "as mentioned above/in/earlier"'),
    (r"\bsee (?:above|the overview)\b", "medium", "back-reference", 'Back-reference: "see above/the overview"'),
    (r"\brefer to (?:the )?(?:above|overview|SKILL)\b", "medium", "back-reference", 'Back-reference: "refer to above/overview"'),
)

# Vague orders to load files.
SUGGESTIVE_LOADING = (
    (r"\b[Ll]oad (?:the |all )?(?:relevant|necessary|needed|required)\b", "medium", "suggestive-loading", 'Suggestive loading: "load relevant/necessary"'),
    (r"\b[Rr]ead (?:the |all )?(?:relevant|necessary|needed|required)\b", "medium", "suggestive-loading", 'Suggestive loading: "read relevant/necessary"'),
    (r"\b[Gg]ather (?:the |all )?(?:relevant|necessary|needed)\b", "medium", "suggestive-loading", 'Suggestive loading: "gather relevant/necessary"'),
)

# Paths that won't resolve elsewhere; scan outside code fences.
PATHS = (
    (r"\{project-root\}/\{[^}]+\}", "critical", "double-prefix", "Double prefix"),
    (r"(?:^|[\s\"`'(])/(?:Users|home|opt|var|tmp|etc|usr)/\S+", "high", "absolute-path", "Absolute path"),
    (r"(?:^|[\s\"`'(])~/\S+", "high", "absolute-path", "Home path"),
    (r"(?:^|[\s\"`'(])\.\./\S+", "high", "relative-prefix", "Parent directory reference"),
    (r"(?:^|[\s\"`'(])\./(?:references|scripts|assets)/\S+", "high", "cross-dir-dot-slash", "Cross-directory ./ path"),
)

#: Rules for raw text collections.
TEXT_NOISE = (
    (r'token = "[0-9a-f]+"', "critical", "secret", "Secret in plain text"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "high", "personal-data", "E-mail address"),
    (r"[#$%&*]{3}", "medium", "markup-noise", "Symbol noise"),
    (r"!!", "low", "shouting", "Double exclamation"),
    (r"[Ll]icense", "info", "licence", "Licence statement"),
)

# Wording that tells of work which might run in parallel, and how often it must occur.
SEQUENTIAL = (
    ("sequential-tool-calls", r"(?m)^\s*\d+\.\s+.*?\b(?:Read|Grep|Glob|read|grep|glob)\b.*$", 3),
    ("read-all", r"[Rr]ead all (?:files|documents|prompts)", 1),
    ("for-each-loop", r"[Ff]or each (?:file|document|prompt|stage)", 1),
    ("analyze-each", r"[Aa]nalyze each", 1),
    ("scan-all", r"[Ss]can (?:through|all|each)", 1),
    ("review-all", r"[Rr]eview (?:all|each)", 1),
    ("load-all-memory", r"[Ll]oad all (?:memory|memories)", 1),
    ("read-all-memory", r"[Rr]ead all (?:memory|agent memory) (?:files|data)", 1),
    ("load-entire-memory", r"[Ll]oad (?:entire|full|complete) (?:memory|agent memory)", 1),
    ("load-all-context", r"[Ll]oad all (?:context|state)", 1),
    ("read-entire-memory", r"[Rr]ead (?:entire|full|complete) memory", 1),
    ("multi-source-read-all", r"[Rr]ead all\b", 1),
    ("multi-source-analyze-each", r"[Aa]nalyze each\b", 1),
    ("multi-source-for-each-file", r"[Ff]or each file\b", 1),
)

#: Totals over prompts and the categories that each adds up.
TOTALS = {"waste": ("defensive-padding", "meta-explanation", "filler"), "back_references": ("back-reference",), "suggestive": ("suggestive-loading",)}


def sequential_patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, kind, n, first``: every kind of wording that occurs often enough, how often, and its first occurrence."""
    found = lambda kind, pattern, least: F.struct(F.lit(kind).alias("kind"), F.lit(least).alias("least"), F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)).alias("m"))
    listed = docs.select(F.col(id_col).alias("doc"), F.explode(F.array(*(found(*row) for row in SEQUENTIAL))).alias("f")).where("size(f.m) >= f.least")
    return listed.select("doc", "f.kind", F.size("f.m").alias("n"), F.col("f.m")[0].alias("first"))


def prompt_totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of totals over all prompts: hits of the rule tables, tokens, walls of text, headers and ways on."""
    spark = docs.sparkSession
    lines = doc_lines(docs, id_col, text_col)
    rules = [(f"(?i){p}", *rest) for p, *rest in (*WASTE, *BACK_REFERENCES, *SUGGESTIVE_LOADING)]
    hits = findings.scan(lines, findings.rules(spark, rules)).agg(*(F.count_if(F.col("category").isin(*c)).alias(n) for n, c in TOTALS.items()))
    has = lambda words, text: reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = docs.agg(F.count("*").alias("n_prompts"), F.coalesce(F.sum(code_point_tokens(text)), F.lit(0)).alias("tokens"), F.count_if(has(LANGUAGE_VARIABLES, text)).alias("with_header"), F.count_if(has(PROGRESSION, F.lower(text))).alias("with_progression"))
    # Each is one row, so the joins are of one row with one row.
    return told.join(hits).join(walls(line_arrays(docs, id_col, text_col)).agg(F.count("*").alias("walls")))


def path_findings(spark, fenced: DataFrame, folder: str) -> DataFrame:
    """Findings of ``PATHS`` outside code fences, and of two rules about a project's own ``folder``.

    The folder's name must follow ``{project-root}/`` (within 30 characters), a path into its
    memory within 20; ``fenced`` is :func:`storylake.operators.lines.with_fences`.
    """
    plain = findings.scan(fenced, findings.rules(spark, list(PATHS)), outside_fences=True)
    open_lines = fenced.where("NOT in_fence AND NOT is_fence")
    rooted = "{project-root}/"

    def bare(pattern: str, window: int, category: str) -> DataFrame:
        # Characters before each match: what stands before it in the line, from the cuts that the matches make.
        parts = F.split("line", pattern)
        before = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.right(F.array_join(F.transform(F.slice(parts, 1, n), lambda x, i: F.when(i < n - 1, F.concat(x, F.lit(folder))).otherwise(x)), ""), F.lit(window)))
        wrong = F.filter(before, lambda b: ~F.contains(b, F.lit(rooted)))
        hits = open_lines.where(F.rlike("line", F.lit(pattern))).select("doc", "line_no", "line", F.explode(wrong).alias("b"))
        return hits.select("doc", "line_no", F.lit("high").alias("severity"), F.lit(category).alias("category"), F.lit("Path without the project's root").alias("title"), F.left(F.col("line"), F.lit(findings.CONTEXT)).alias("context"), F.lit(folder).alias("matched"))

    return plain.unionByName(bare(rf"{folder}(?=[/\s])", 30, "bare-prefix")).unionByName(bare(rf"{folder}(?=/memory/\S)", 20, "memory-path"))
