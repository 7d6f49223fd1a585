"""Paths in one spelling, and their order by parts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A scheme of two letters or more, and what names the host; file: is the local root whatever its slashes.
_LOCAL, _REMOTE = r"^(?i:file):/+", r"^([A-Za-z][A-Za-z0-9+.-]+)://([^/]*)"


def _absolute(path: Column) -> Column:
    return path.startswith("/") | path.rlike(_LOCAL) | path.rlike(_REMOTE)


def canonical(path: Column, base: Column | None = None) -> Column:
    """The one spelling of a path: no doubled or trailing separators, no `.`, and no `..` behind a folder.

    `file:` goes, another scheme is in small letters and keeps its host as it is.  `..` above the root is the root; above a
    relative path it stays, unless base (a folder) is given, which relative paths then lie in.  An empty relative path is `.`,
    a null one null.  Links of a file system are not followed: a column expression sees names only.
    """
    whole = path if base is None else F.when(_absolute(path), path).otherwise(F.concat(base, F.lit("/"), path))
    local, remote = whole.rlike(_LOCAL), whole.rlike(_REMOTE) & ~whole.rlike(_LOCAL)
    host = F.when(remote, F.concat(F.lower(F.regexp_extract(whole, _REMOTE, 1)), F.lit("://"), F.regexp_extract(whole, _REMOTE, 2))).otherwise(F.lit(""))
    rest = F.when(local, F.regexp_replace(whole, _LOCAL, "/")).when(remote, F.regexp_replace(whole, _REMOTE, "")).otherwise(whole)
    rooted = _absolute(whole)

    def step(stack: Column, part: Column) -> Column:
        top = F.get(stack, F.size(stack) - 1)
        back = F.when(top != "..", F.slice(stack, 1, F.size(stack) - 1)).when(rooted, stack).otherwise(F.concat(stack, F.array(part)))
        return F.when(part == "..", back).otherwise(F.concat(stack, F.array(part)))

    kept = F.filter(F.split(rest, "/", -1), lambda x: ~x.isin("", "."))
    body = F.array_join(F.aggregate(kept, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(host, F.lit("/"), body)).when(body == "", F.lit(".")).otherwise(body)


def by_parts(path: Column) -> Column:
    """What to order by, so that a folder's files come together: `a/b` before `a-b`, which text has the other way round."""
    return F.split(path, "/", -1)
