"""File and image names as join keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "[/\\\\\\\\]"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def safe_name(path: Column) -> Column:
    """Letters, digits, dot, dash and underscore stay, all else becomes an underscore."""
    return F.regexp_replace(stem(path), r"[^A-Za-z0-9._-]", "_")


def without_rank(name: Column) -> Column:
    """Drops a worker suffix such as _rank3."""
    return F.regexp_replace(name, r"_rank[0-9]+$", "")


def name_candidates(name: Column) -> Column:
    """Keys to try in order: the name, its base, its stem, each in lower case last."""
    b, s = base_name(name), stem(name)
    return F.array_distinct(F.array(name, b, s, F.lower(name), F.lower(b), F.lower(s)))


def station_of_run(name: Column) -> Column:
    """Site of a run directory: date and experiment suffixes are dropped."""
    return F.regexp_replace(name, r"(-[0-9]{4}|-exp[0-9]+)$", "")
