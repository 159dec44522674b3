"""Text cleaning and parsing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_title(c: Column) -> Column:
    """Newline to space (the catalog title cleaning)."""
    return F.regexp_replace(c, "\n", " ")


def decode_item_id(c: Column, wrapper_only: bool = False) -> Column:
    """Undo a bytes repr of an id.

    Default keeps the reference behaviour: every 'b' and every quote is removed,
    also inside the id. ``wrapper_only`` strips just a surrounding b'...'.
    """
    if wrapper_only:
        return F.regexp_replace(c, r"^b'(.*)'$", "$1")
    return F.regexp_replace(c, "[b']", "")


def parse_paths(c: Column) -> Column:
    """Nested category list text -> sorted list of path keys, empty paths removed.

    A path key is the JSON text of one inner list, e.g. ["A","B"]. Duplicated paths
    stay (they weigh more in the draw, as in the reference).
    """
    nested = F.from_json(c, "array<array<string>>")
    keys = F.transform(F.filter(nested, lambda p: F.size(p) > 0), lambda p: F.to_json(p))
    return F.array_sort(keys)


def parse_paths_compact(c: Column) -> Column:
    """Legacy text variant for compact input like [[A,B],[C]]: strip the outer
    brackets, drop ',[' and split on ']' (empty pieces removed)."""
    inner = F.regexp_replace(F.regexp_replace(c, r"^\[\[", ""), r"\]$", "")
    pieces = F.split(F.regexp_replace(inner, r",\[", ""), r"\]")
    return F.array_sort(F.filter(pieces, lambda p: p != ""))
