"""Module installs: definitions, answers and older files merged into the settings of many projects at once.

All inputs are long tables with one row a setting, so a project's size never
matters and every step is a join or an aggregation by project:

- ``definitions``: ``project, key, value, variable, result, user_setting``
- ``answers``: ``project, part, key, value``; part is ``core`` or ``module``
- ``existing``: ``project, scope, key, value``; an empty scope is the root
- ``existing_user``: ``project, key, value``
- ``legacy``: ``project, folder, key, value``; a file without settings has no rows and counts as absent

Of repeated rows of one setting the greatest value counts. Values may be null
and then are written as null; rows with a null project or key are left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylake.operators.templates import result_of
from storylake.sources.shared import settled

# Keys that all modules share, those of them that are the user's, and what else a definition tells of its module.
CORE_KEYS = ("user_name", "communication_language", "document_output_language", "output_folder")
USER_KEYS = ("user_name", "communication_language")
METADATA = ("name", "description", "default_selected")


def projects(definitions: DataFrame, *others: DataFrame) -> DataFrame:
    """``project, code, status`` of every project named anywhere: ``no_source`` without a definition, ``no_code`` where it has none, else ``success``."""
    code = F.max(F.when(F.col("key") == "code", F.nullif("value", F.lit("")))).alias("code")
    known = definitions.where("project IS NOT NULL AND key IS NOT NULL").groupBy("project").agg(code)
    named = known.select("project", "code", F.lit(True).alias("source"))
    for other in others:
        named = named.unionByName(other.where("project IS NOT NULL").select("project", F.lit(None).cast("string").alias("code"), F.lit(False).alias("source")))
    found = named.groupBy("project").agg(F.max("code").alias("code"), F.bool_or("source").alias("source"))
    status = F.when(~F.col("source"), "no_source").when(F.col("code").isNull(), "no_code").otherwise("success")
    return found.select("project", "code", status.alias("status"))


def _won(rows: DataFrame, *key: str) -> DataFrame:
    """The row of greatest ``rank`` for every key, of equal ranks that of the greatest value; values may be null."""
    best = F.max(F.struct("rank", "value"))
    return rows.groupBy(*key).agg(best.alias("best")).select(*key, F.col("best.value").alias("value"))


def full_answers(installs: DataFrame, definitions: DataFrame, answers: DataFrame, legacy: DataFrame) -> DataFrame:
    """``project, part, key, value``: answers, and below them what the older files hold of shared keys and of variables still defined.

    A shared key counts first from the folder ``core``, then from the module's
    own; folders of other modules are left alone.
    """
    core = F.col("key").isin(*CORE_KEYS)
    ours = legacy.where("key IS NOT NULL").join(installs.where("status = 'success'"), "project").where("folder = 'core' OR folder = code")
    variables = definitions.where("variable").select("project", "key").distinct()
    shared = ours.where(core).select("project", F.lit("core").alias("part"), "key", "value", F.when(F.col("folder") == "core", 1).otherwise(0).alias("rank"))
    own = ours.where(~core & (F.col("folder") != "core")).join(variables, ["project", "key"], "left_semi").select("project", F.lit("module").alias("part"), "key", "value", F.lit(0).alias("rank"))
    given = answers.where("key IS NOT NULL AND part IN ('core', 'module')").join(installs.where("status = 'success'"), "project").select("project", "part", "key", "value", F.lit(2).alias("rank"))
    return _won(shared.unionByName(own).unionByName(given), "project", "part", "key")


def shaped(value: Column, result: Column) -> Column:
    """An answer put into its variable's template; without one, or if it names the project's root itself, as it is."""
    return F.when(result.isNull(), value).otherwise(result_of(result, value))


def shared_settings(installs: DataFrame, definitions: DataFrame, full: DataFrame, existing: DataFrame) -> DataFrame:
    """``project, scope, key, value`` after the install.

    A section ``core`` moves to the root and wins over it; keys of the user
    leave the root; shared answers overwrite it; the module's section is built
    anew of its metadata and its answers. Projects whose install fails keep what
    they have.
    """
    rows = existing.where("key IS NOT NULL").join(installs, "project")
    done = F.col("status") == "success"
    scope = F.when(done & (F.col("scope") == "core"), "").otherwise(F.coalesce("scope", F.lit("")))
    moved = rows.select("project", scope.alias("scope"), "key", "value", F.when(F.col("scope") == "core", 1).otherwise(0).alias("rank"), "status", "code")
    dropped = done & ((F.col("scope") == F.col("code")) | ((F.col("scope") == "") & F.col("key").isin(*USER_KEYS)))
    parts = [moved.where(~dropped).select("project", "scope", "key", "value", "rank")]
    parts.append(full.where(F.col("part") == "core").where(~F.col("key").isin(*USER_KEYS)).select("project", F.lit("").alias("scope"), "key", "value", F.lit(2).alias("rank")))
    good = installs.where("status = 'success'").select("project", "code")
    told = definitions.where(F.col("key").isin(*METADATA) & ~F.coalesce("variable", F.lit(False))).select("project", "key", "value")
    versions = definitions.where("key = 'module_version'").select("project", F.lit("version").alias("key"), "value")
    unversioned = good.select("project", F.lit("version").alias("key"), F.lit(None).cast("string").alias("value"))
    meta = told.unionByName(versions).unionByName(unversioned).join(good, "project")
    parts.append(meta.select("project", F.col("code").alias("scope"), "key", "value", F.lit(0).alias("rank")))
    templates = definitions.where("variable").groupBy("project", "key").agg(F.max("result").alias("result"))
    own = full.where(F.col("part") == "module").join(templates, ["project", "key"], "left").join(good, "project")
    parts.append(own.select("project", F.col("code").alias("scope"), "key", shaped(F.col("value"), F.col("result")).alias("value"), F.lit(1).alias("rank")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return _won(union, "project", "scope", "key")


def new_user_settings(definitions: DataFrame, full: DataFrame) -> DataFrame:
    """``project, key, value`` of answers that are the user's: two shared keys, and variables so marked, as they were given."""
    core = full.where(F.col("part") == "core").where(F.col("key").isin(*USER_KEYS)).select("project", "key", "value", F.lit(0).alias("rank"))
    marked = definitions.where("variable AND user_setting").select("project", "key").distinct()
    own = full.where(F.col("part") == "module").join(marked, ["project", "key"], "left_semi").select("project", "key", "value", F.lit(1).alias("rank"))
    return _won(core.unionByName(own), "project", "key")


def user_settings(existing_user: DataFrame, new: DataFrame) -> DataFrame:
    """``project, key, value``: what a user has, overwritten by what is new."""
    had = existing_user.where("project IS NOT NULL AND key IS NOT NULL").select("project", "key", "value", F.lit(0).alias("rank"))
    return _won(had.unionByName(new.select("project", "key", "value", F.lit(1).alias("rank"))), "project", "key")


def report(installs: DataFrame, full: DataFrame, shared: DataFrame, new_user: DataFrame, legacy: DataFrame) -> DataFrame:
    """``project, status, core_updated, module_keys, user_keys, legacy_found``: one row a project, with counts of keys written and the folders read."""
    count = lambda rows, name: rows.groupBy("project").agg(F.count("*").alias(name))
    section = shared.join(installs.where("status = 'success'"), "project").where(F.col("scope") == F.col("code"))
    folders = legacy.join(installs.where("status = 'success'"), "project").where("folder = 'core' OR folder = code").select("project", "folder").distinct()
    found = (
        installs.join(count(full.where(F.col("part") == "core"), "core"), "project", "left")
        .join(count(section, "module_keys"), "project", "left")
        .join(count(new_user, "user_keys"), "project", "left")
        .join(count(folders, "legacy_found"), "project", "left")
    )
    filled_in = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return found.select("project", "status", (F.coalesce("core", F.lit(0)) > 0).alias("core_updated"), *map(filled_in, ("module_keys", "user_keys", "legacy_found")))


class Installed(NamedTuple):
    """Shared settings, the user's settings and the report after all installs."""

    shared: DataFrame
    user: DataFrame
    report: DataFrame


def installed(definitions: DataFrame, answers: DataFrame, existing: DataFrame, existing_user: DataFrame, legacy: DataFrame) -> Installed:
    """All projects' installs; what several results rest on is written once to the shared folder."""
    found = settled(projects(definitions, answers, existing, legacy), "installs")
    full = settled(full_answers(found, definitions, answers, legacy), "answers")
    shared, new = settled(shared_settings(found, definitions, full, existing), "settings"), new_user_settings(definitions, full)
    return Installed(shared, user_settings(existing_user, new), report(found, full, shared, new, legacy))
