"""Which files a source plan takes: include and ignore globs as one Spark predicate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each glob mark matches.
MARKS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for a glob (Java's, Python's and RE2's dialects agree on it)."""
    pieces = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "^" + "".join(MARKS.get(p) or re.sub(r"([.+()|\[\]{}^$\\])", r"\\\1", p) for p in pieces) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """A glob without a slash is held against the last part of the path, any other against all of it."""
    base = F.substring_index(path, "/", -1)
    found = F.lit(False)
    for glob in globs:
        found = found | (path if "/" in glob else base).rlike(glob_pattern(glob))
    return found


def planned(path: Column, include: list[str], ignore: list[str], generated: list[str] = ()) -> Column:
    """Paths that an include glob takes (any, where there is none) and no ignore glob or generated suffix refuses."""
    taken = matches_any(path, include) if include else F.lit(True)
    for suffix in generated:
        taken = taken & ~path.endswith(suffix)
    return taken & ~matches_any(path, ignore)


def planned_roots(path: Column, roots: dict[str, dict], include: list[str] = (), ignore: list[str] = (), generated: list[str] = ()) -> Column:
    """Paths that the plan of their root takes: a root's ignore globs join the general ones, its include globs replace them.

    ``roots``: folder -> {"include": [...], "ignore": [...]}; globs are held against
    the path below the root.  Paths below no root are not taken.
    """
    out = F.lit(False)
    for root, own in roots.items():
        top = root.rstrip("/") + "/"
        below = F.substring(path, len(top) + 1, 1 << 30)
        out = out | (path.startswith(top) & planned(below, list(own.get("include") or include), [*ignore, *(own.get("ignore") or [])], generated))
    return out
