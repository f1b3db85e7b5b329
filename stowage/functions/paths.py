"""Paths, names and extensions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest file extension that is told apart.
EXTENSION_LENGTH = 12


def trimmed(path: Column) -> Column:
    """Without slashes at the end."""
    return F.regexp_replace(path, "/+$", "")


def depth(path: Column) -> Column:
    """Number of "/" once slashes at the end are dropped: 0 for the root."""
    return F.size(F.split(trimmed(path), "/")) - 1


def parent(path: Column) -> Column:
    """Path of the folder above; empty for a folder right below the root."""
    p = trimmed(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.substring_index(trimmed(path), "/", -1)


def ancestors(path: Column) -> Column:
    """Array of the path itself and all folders above it, topmost first; without the empty root."""
    parts = F.split(trimmed(path), "/")
    start = F.when(F.startswith(path, F.lit("/")), 2).otherwise(1)
    return F.transform(F.sequence(start, F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def in_subtree(path_lower: Column, under: str) -> Column:
    """At or below ``under``, without case: as a range, so that it reaches Parquet's statistics ("0" follows "/")."""
    p = under.rstrip("/").lower()
    if not p:
        return path_lower.isNotNull()
    return (path_lower == p) | ((path_lower >= p + "/") & (path_lower < p + "0"))


def below(path: Column, root: str) -> Column:
    """Path relative to ``root`` (compared without case); a path that is not below it stays."""
    r = root.rstrip("/")
    if not r:
        return F.regexp_replace(path, "^/+", "")
    n = len(r)
    inside = F.startswith(F.lower(path), F.lit(r.lower() + "/"))
    return F.when(F.lower(path) == r.lower(), "").when(inside, F.substring(path, n + 2, 1 << 30)).otherwise(path)


def full_path(folder: Column, name: Column) -> Column:
    """folder/name; the bare name at the root."""
    return F.when(F.coalesce(folder, F.lit("")) == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; empty if the name begins with that dot, ends in it, or has more than EXTENSION_LENGTH characters after it."""
    return F.regexp_extract(F.lower(name), rf"(?s)^.+\.([^.]{{1,{EXTENSION_LENGTH}}})\z", 1)


def raw_extension(name: Column) -> Column:
    """All after the last dot, however long and wherever the dot; empty without one."""
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise("")


def dir_prefix(folder: Column, levels: int) -> Column:
    """The first ``levels`` components; "(root)" for none; shorter folders stay as they are."""
    cut = F.array_join(F.slice(F.split(folder, "/"), 1, levels), "/")
    return F.when(F.coalesce(folder, F.lit("")) == "", "(root)").otherwise(cut)


def suffix_value(suffix: Column) -> Column:
    """Number of a part's suffix: decimal digits, or letters as base 26 from "aa" = 0."""
    letters = F.aggregate(F.split(suffix, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 97))
    return F.when(suffix.rlike(r"^\d+$"), suffix.try_cast("long")).when(suffix.rlike("^[a-z]+$"), letters)


def suffix_text(value: int, width: int, numeric: bool) -> str:
    """A part's suffix of ``width`` characters."""
    if numeric:
        return str(value).zfill(width)
    out = ""
    for _ in range(width):
        value, k = divmod(value, 26)
        out = chr(97 + k) + out
    return out
