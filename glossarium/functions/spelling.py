"""Keys of names that are spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossarium.functions.canonical import canonical_form


def plain_key(text: Column) -> Column:
    """A spelling key: consistent characters, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(canonical_form(text)), r"[^\p{L}\p{N}]+", "")


def parts_key(text: Column) -> Column:
    """A spelling key for names made of parts: the parts in lower case, sorted, joined with '+'."""
    parts = F.filter(F.split(F.lower(canonical_form(text)), r"[^\p{L}\p{N}]+"), lambda p: p != "")
    return F.when(text.isNotNull(), F.array_join(F.array_sort(parts), "+"))


def named_parts(text: Column, names: tuple[str, ...]) -> Column:
    """That of the names which has the parts of the text, in any order; any other text in upper case, without outer blanks."""
    key, found = parts_key(text), F.upper(F.trim(text))
    for n in names:
        found = F.when(key == "+".join(sorted(n.lower().split("+"))), n).otherwise(found)
    return found
