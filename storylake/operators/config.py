"""Settings of modules: search paths, marker directories, states, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylake.functions.text import bound

from storylake.operators.merge import with_default
from storylake.operators.templates import filled, result_of


def first_existing(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Of every key the first candidate (least ``ord``) whose ``path`` exists, or null."""
    found = candidates.join(existing.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.min_by("path", "ord").alias("path"))
    return candidates.select(key).distinct().join(found, key, "left")


def nearest_marked(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """``path, root``: the nearest directory at or above each path that holds a marker, or null.

    Paths meet directories in a join on distinct directories, not by walking.
    """
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    steps = paths.select("path").distinct().select("path", F.explode(above).alias("dir"))
    near = steps.join(markers.select("dir").distinct(), "dir", "left_semi").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("root"))
    return paths.join(near, "path", "left")


def state(has_project: Column, has_core: Column, has_module: Column) -> Column:
    """``no_project``, ``ready`` if the module's settings are there even without core, ``core_missing`` or ``module_missing``."""
    return F.when(~has_project, "no_project").when(has_module, "ready").when(~has_core, "core_missing").otherwise("module_missing")


def expanded_defaults(variables: DataFrame, answers: Column) -> DataFrame:
    """``name, value``: answers win over defaults, whose placeholders are filled from the answers."""
    return variables.select("name", with_default(F.try_element_at(answers, F.col("name")), filled(F.col("default"), answers)).alias("value"))


def parsed_int(text: Column) -> Column:
    """Leading integer of a text as a browser parses it; null if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def request_fields(body: Column) -> Column:
    """``struct<texts, rate>`` of a JSON request: the strings of a list ``paragraphs`` or else a string ``text``, trimmed, blank ones dropped; rate 1 unless a number.

    Values count by their type: a number is no text, and a quoted number no rate.
    """
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    at = lambda v, field: F.try_variant_get(v, f"$.{field}", "variant")
    strings = lambda values: F.transform(F.filter(values, lambda v: kind(v) == "STRING"), lambda v: F.trim(F.try_variant_get(v, "$", "string")))

    def fields(v):
        listed, text, rate = F.try_variant_get(v, "$.paragraphs", "array<variant>"), at(v, "text"), at(v, "rate")
        texts = strings(F.when(F.startswith(kind(at(v, "paragraphs")), F.lit("ARRAY")), listed).otherwise(F.array(text)))
        number = F.when(F.rlike(kind(rate), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), F.try_variant_get(v, "$.rate", "double"))
        return F.struct(F.filter(texts, lambda t: t != "").alias("texts"), F.coalesce(number, F.lit(1.0)).alias("rate"))

    return bound(F.try_parse_json(body), fields)


def rooted(settings: Column, root: Column) -> Column:
    """A map of settings with ``{project-root}`` resolved in every value."""
    return F.transform_values(settings, lambda _, value: F.replace(value, F.lit("{project-root}"), root))


def only(settings: Column, names: tuple[str, ...]) -> Column:
    """The settings of these names."""
    return F.map_filter(settings, lambda key, _: key.isin(*names))


def without(settings: Column, names: tuple[str, ...]) -> Column:
    """All settings but those of these names."""
    return F.map_filter(settings, lambda key, _: ~key.isin(*names))


def metadata(settings: Column) -> Column:
    """Name, description and default selection where given, and the version, null if it isn't."""
    version = F.create_map(F.lit("version"), F.try_element_at(settings, F.lit("version")))
    return F.map_concat(only(settings, ("name", "description", "default_selected")), version)


def written_settings(variables: Column, answers: Column, context: Column) -> Column:
    """``array<struct<name, value>>`` of variables ``array<struct<name, default, result>>`` in their order.

    An answer wins over the default; the result's template, if there is one,
    shapes it. Every value joins the context from which later ones are filled.
    """
    start = F.struct(context.alias("known"), F.array().cast("array<struct<name:string,value:string>>").alias("done"))

    def step(acc, v):
        given = with_default(F.try_element_at(answers, v["name"]), filled(v["default"], acc["known"]))
        value = F.when(v["result"].isNull(), given).otherwise(filled(result_of(v["result"], given), acc["known"]))
        grown = F.map_concat(F.map_filter(acc["known"], lambda key, _: key != v["name"]), F.create_map(v["name"], value))
        return F.struct(grown.alias("known"), F.concat(acc["done"], F.array(F.struct(v["name"].alias("name"), value.alias("value")))).alias("done"))

    return F.aggregate(variables, start, step, lambda acc: acc["done"])


def arguments(pairs: Column) -> Column:
    """``struct<ok, settings>`` of ``key=value`` texts, split at the first sign; a text without a sign or key spoils all; the last of equal keys counts."""
    sound = F.filter(pairs, lambda p: F.rlike(p, F.lit("(?s)^[^=]+=")))
    entries = F.transform(sound, lambda p: F.struct(F.regexp_extract(p, "(?s)^([^=]+)=", 1).alias("key"), F.regexp_extract(p, "(?s)^[^=]+=(.*)$", 1).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda later: later["key"] == e["key"]))
    return F.struct((F.size(sound) == F.size(pairs)).alias("ok"), F.map_from_entries(last).alias("settings"))
