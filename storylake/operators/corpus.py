"""Collections of source documents: types, companions, totals, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Document types by file name in lower case; the first match counts.
DOC_TYPES = (
    (r"discovery[_-]notes", "discovery-notes"),
    (r"product[_-]brief", "product-brief"),
    (r"research[_-]report", "research-report"),
    (r"architecture", "architecture-doc"),
    (r"prd", "prd"),
    (r"distillate", "distillate"),
    (r"changelog", "changelog"),
    (r"readme", "readme"),
    (r"spec", "specification"),
    (r"requirements", "requirements"),
    (r"design[_-]doc", "design-doc"),
    (r"meeting[_-]notes", "meeting-notes"),
    (r"brainstorm", "brainstorming"),
    (r"interview", "interview-notes"),
)
# A companion's name is its base's with one of these endings before the extension.
COMPANIONS = (
    r"^(.+?)(?:-discovery-notes|-discovery_notes)\.(\w+)$",
    r"^(.+?)(?:-appendix|-addendum)(?:-\w+)?\.(\w+)$",
    r"^(.+?)(?:-review|-feedback)\.(\w+)$",
)
# Up to how many files and tokens a corpus is read in one go, what isn't entered, and what counts as text.
SINGLE_FILES, SINGLE_TOKENS, SPLIT_TOKENS = 3, 15_000, 5_000
SKIPPED_DIRS = ("node_modules", ".git", "__pycache__", ".venv", "venv", ".claude", ".cursor", ".vscode")
TEXT_FILES = (".md", ".txt", ".yaml", ".yml", ".json")


def resolve(files: DataFrame, path: str = "path", skipped_dirs: tuple[str, ...] = SKIPPED_DIRS) -> DataFrame:
    """Text files outside the skipped directories, each path once."""
    parts = F.split(F.col(path), "/")
    skipped = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, skipped_dirs)))
    kept = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*TEXT_FILES)
    return files.where(kept & ~skipped).dropDuplicates([path])


def doc_type(name: Column) -> Column:
    """Type of a document by its file name, ``unknown`` if nothing matches."""
    low, found = F.lower(name), F
    for pattern, kind in DOC_TYPES:
        found = found.when(F.rlike(low, F.lit(pattern)), kind)
    return found.otherwise("unknown")


def base_name(name: Column) -> Column:
    """Name of the file that a companion belongs to, by the first ending that fits; null for other files."""
    found = F
    for pattern in COMPANIONS:
        whole = "(?i)" + pattern
        found = found.when(F.rlike(name, F.lit(whole)), F.concat(F.regexp_extract(name, whole, 1), F.lit("."), F.regexp_extract(name, whole, 2)))
    return found.otherwise(F.lit(None).cast("string"))


def groups(files: DataFrame, name: str = "filename") -> DataFrame:
    """``group_key, filename, role``: bases with companions, and what stands alone.

    Names are taken as unique. A companion without its base still heads a group.
    """
    keyed = files.select(F.col(name).alias("filename"), base_name(F.col(name)).alias("base"))
    bases = keyed.where("base IS NOT NULL").select(F.col("base").alias("filename")).distinct().withColumn("has_companion", F.lit(True))
    joined = keyed.join(bases, "filename", "left")
    role = F.when(F.col("base").isNotNull(), "companion").when(F.col("has_companion"), "primary").otherwise("standalone")
    return joined.select(F.coalesce("base", "filename").alias("group_key"), "filename", role.alias("role"))


def totals(files: DataFrame) -> DataFrame:
    """Files, bytes and tokens (a quarter of all bytes, rounded down) with routing and split."""
    sums = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("size_bytes"))
    tokens = F.floor(F.col("size_bytes") / 4).cast("long")
    return sums.select("n_files", "size_bytes", tokens.alias("estimated_tokens"), routing(F.col("n_files"), tokens).alias("routing"), (F.floor(tokens / 3) > SPLIT_TOKENS).alias("split_likely"))


def routing(n_files: Column, tokens: Column) -> Column:
    return F.when((n_files <= SINGLE_FILES) & (tokens <= SINGLE_TOKENS), "single").otherwise("fan-out")
