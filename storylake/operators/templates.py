"""Text templates: variables, conditional blocks, expansion of defaults."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def filled(template: Column, variables: Column) -> Column:
    """``{name}`` replaced by the map's values, entry by entry; unknown names stay, nulls are skipped."""
    entries = F.filter(F.map_entries(variables), lambda e: e["value"].isNotNull())
    return F.aggregate(entries, template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def result_of(template: Column, answer: Column) -> Column:
    """``{value}`` replaced by the answer, which wins as it is if it names the project root itself."""
    return F.when(F.contains(answer, F.lit("{project-root}")), answer).otherwise(F.replace(template, F.lit("{value}"), answer))


_BLOCK = re.compile(r"\{if-([\w-]+)\}(.*?)\{/if-\1\}", re.S)


def resolve_blocks(template: str, true_names: set[str]) -> str:
    """Conditional blocks kept or removed, the leftmost first, until none is left; blank runs shrink to one line."""
    while block := _BLOCK.search(template):
        kept = block[2] if block[1] in true_names else ""
        template = template[: block.start()] + kept + template[block.end() :]
    return re.sub(r"\n{3,}", "\n\n", template)


@F.pandas_udf(StringType())
def resolved(template: pd.Series, true_names: pd.Series) -> pd.Series:
    """:func:`resolve_blocks` on columns; the fixpoint with back-references has no SQL form."""
    return pd.Series([None if t is None else resolve_blocks(t, set(n) if n is not None else set()) for t, n in zip(template, true_names)], dtype=object)
