"""Lines of a chapter without what a site puts around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storylake.functions.text import bound

# Lines that are no part of a chapter where they stand first or last, and the heading that repeats its title.
NOISE = (r"^Ng.+i đăng:", r"^Bạn đang đọc truyện", r"\.com\.vn$|\.com$|\.net$")
HEADING = r"^Chương\s+\d+"


def trimmed(lines: Column, noise: tuple[str, ...] = NOISE) -> Column:
    """``lines`` without the noise at both ends; noise between other lines stays, and noise alone leaves nothing."""
    pattern = "|".join(f"(?:{p})" for p in noise)
    good = F.filter(F.transform(lines, lambda x, i: F.when(~F.rlike(x, F.lit(pattern)), i)), lambda i: i.isNotNull())
    kept = lambda g: F.slice(lines, F.array_min(g) + 1, F.array_max(g) - F.array_min(g) + 1)
    return bound(good, lambda g: F.when(F.size(g) == 0, F.array().cast("array<string>")).otherwise(kept(g)))


def headless(lines: Column) -> Column:
    """``lines`` without the first one if it is a chapter's heading."""
    return F.when(F.coalesce(F.rlike(F.try_element_at(lines, F.lit(1)), F.lit(HEADING)), F.lit(False)), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).otherwise(lines)
