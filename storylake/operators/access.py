"""Access decisions from basic-auth headers, and the routes they apply to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: static files that no decision is made for.
ROUTES = r"^/(?!_next/static|_next/image|favicon\.ico|robots\.txt|sitemap\.xml).*$"


def credentials(header: Column) -> Column:
    """``struct<username, password>`` of a ``Basic`` header, null if it isn't one.

    The prefix is case-sensitive, the text is Latin-1 and split at its first
    colon, which can't come first; a password may be empty.
    """
    text = F.decode(F.try_to_binary(F.substr(header, F.lit(7)), F.lit("base64")), "ISO-8859-1")
    at = F.locate(":", text)
    pair = F.struct(F.substr(text, F.lit(1), at - 1).alias("username"), F.substr(text, at + 1).alias("password"))
    return F.when(F.startswith(header, F.lit("Basic ")) & (at > 1), pair)


def allowed(found: Column, username: Column, password: Column) -> Column:
    """Whether credentials equal the expected ones, which must not be empty; expected values are trimmed."""
    user, word = F.trim(username), F.trim(password)
    return F.coalesce((user != "") & (word != "") & (found["username"] == user) & (found["password"] == word), F.lit(False))


def status_code(production: Column, found: Column, username: Column, password: Column) -> Column:
    """200 outside production or with the right credentials, 500 without expected ones, else 401."""
    configured = F.coalesce((F.trim(username) != "") & (F.trim(password) != ""), F.lit(False))
    return F.when(~production, 200).when(~configured, 500).when(allowed(found, username, password), 200).otherwise(401)


def guarded(path: Column) -> Column:
    """Whether a decision is made for a path."""
    return F.rlike(path, F.lit(ROUTES))
