"""Ignore-file patterns as regular expressions that both Spark and RE2 read."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """One ignore-file pattern, without its ``!``, as a regex over relative paths.

    A pattern with a slash before its end is tied to the root; a match of a
    directory covers what is below it; ``**`` crosses directories.
    """
    body = pattern.strip()
    only_directory = body.endswith("/")
    body = body.rstrip("/")
    tied = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif body[i] == "*":
            out, i = out + "[^/]*", i + (2 if body.startswith("**", i) else 1)
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            j = body.index("]", i + 1)
            inner = body[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]", j + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if tied else "(?:^|/)") + out + ("/" if only_directory else "(?:/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path is ignored: the last pattern that matches decides, ``!`` ones let it in again."""
    out = F.lit(False)
    for p in patterns:
        if not p.strip() or p.startswith("#"):
            continue
        out = F.when(path.rlike(glob_regex(p.removeprefix("!"))), not p.startswith("!")).otherwise(out)
    return out
