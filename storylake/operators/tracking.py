"""Sprint tracking: kinds of keys, counts, the next story, statuses that never go back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses by rising rank, older names, and the order in which work is taken up.
STATUSES = ("backlog", "ready-for-dev", "in-progress", "review", "done")
OLDER = {"drafted": "ready-for-dev", "contexted": "in-progress"}
PRIORITY = ("in-progress", "review", "ready-for-dev", "backlog")


def kind(key: Column) -> Column:
    """``epic`` for epic-N, ``retrospective`` for epic-N-retrospective, else ``story``."""
    return F.when(F.rlike(key, F.lit("^epic-[0-9]+$")), "epic").when(F.rlike(key, F.lit("-retrospective$")), "retrospective").otherwise("story")


def current_status(status: Column) -> Column:
    found = F
    for old, new in OLDER.items():
        found = found.when(status == old, new)
    return found.otherwise(status)


def rank(status: Column) -> Column:
    """Place of a status in its order; -1 for unknown ones."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, STATUSES)), status), F.lit(0)).cast("int") - 1


def counts(entries: DataFrame) -> DataFrame:
    """Entries by kind and status."""
    return entries.groupBy(kind(F.col("key")).alias("kind"), current_status(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


def never_back(old: Column, new: Column) -> Column:
    """The one of two statuses that is further on."""
    return F.when(rank(new) > rank(old), new).otherwise(old)


def next_story(entries: DataFrame, group: str) -> DataFrame:
    """The story to take up next in every group: by status, then epic, then number."""
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("status"))
    stories = entries.where(place > 0).withColumns({"place": place, "epic": F.regexp_extract("key", r"^(\d+)-(\d+)", 1).cast("int"), "number": F.regexp_extract("key", r"^(\d+)-(\d+)", 2).cast("int")})
    return stories.groupBy(group).agg(F.min_by(F.struct("key", "status"), F.struct("place", "epic", "number")).alias("s")).select(group, "s.key", "s.status")


def story_key(title: Column) -> Column:
    """``Story 1.1: User Auth`` as ``1-1-user-auth``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(title, r"^Story\s+", "")), "[^a-z0-9]+", "-"), "^-|-$", "")


def loose_ends(entries: DataFrame) -> DataFrame:
    """``key, finding`` of entries ``key, status``: stories whose epic isn't listed, and running epics without a story."""
    known = entries.select("key", "status", kind(F.col("key")).alias("kind"))
    epics = known.where("kind = 'epic'").select("key", "status", F.regexp_extract("key", "^epic-([0-9]+)$", 1).alias("epic"))
    stories = known.where("kind = 'story'").select("key", F.regexp_extract("key", "^([0-9]+)-", 1).alias("epic"))
    orphans = stories.join(epics.select("epic").distinct(), "epic", "left_anti").select("key", F.lit("orphan-story").alias("finding"))
    empty = epics.where("status = 'in-progress'").join(stories.select("epic").distinct(), "epic", "left_anti").select("key", F.lit("empty-epic").alias("finding"))
    return orphans.unionByName(empty).distinct()
