"""Several values packed in one field: one row per value, with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossarium.functions.canonical import canonical_form

# A cut between two values; control characters never survive the consistent form, so this one is free.
_CUT = "\u0001"
# Delimiters: bar, semicolon, tab, line end, a slash between blanks, and a comma that isn't between two digits.
_DELIMITER = r"\r\n|[|;\t\n\r]|\s+/\s+|(?<![0-9]),|,(?![0-9])"
_NUMBERING = rf"(^|{_CUT})\s*(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}}\)|[0-9]{{1,4}}\.(?=\s))\s*"
_ENCLOSED = rf"(^|{_CUT})\s*(?:\[([^\[\]{_CUT}]*)\]|\{{([^{{}}{_CUT}]*)\}}|\(([^(){_CUT}]*)\)|“([^“”{_CUT}]*)”|‘([^‘’{_CUT}]*)’)\s*(?={_CUT}|\z)"
_OPENS = r"(?<=(?:^|[\[{(,;|\t\n/])\s{0,4})'(?=\S)"
_INNER = r"""(?<!(?:^|[\[{(,;|\t\n/])\s{0,4})"(?!\s*(?:$|[,;|\t\n\]})/]))"""
_CLOSES = r"(?<=\S)'(?=\s*(?:$|[,;|\t\n\]})/]))"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _inside(text: Column) -> Column:
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _without_wrapper(text: Column) -> Column:
    """The inside of a list written as a whole in square or curly brackets."""
    whole = text.rlike(r"^\[[^\[\]]*\]$|^\{[^{}]*\}$") | text.rlike(r"""(?s)^\[\s*["'].*["']\s*\]$""")
    return F.when(whole, _inside(text)).otherwise(text)


def _in_double_quotes(text: Column) -> Column:
    """Single quotes that enclose values, written as double quotes; double quotes inside such values are doubled."""
    inner = F.regexp_replace(text, _INNER, '""')
    return F.when(text.contains("'") & text.rlike(_OPENS), F.regexp_replace(F.regexp_replace(inner, _OPENS, '"'), _CLOSES, '"')).otherwise(text)


def _balanced(text: Column) -> Column:
    return F.pmod(F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit(""))), F.lit(2)) == 0


def _folded(pieces: Column) -> Column:
    """One text with a cut between values, of the pieces between quote characters: odd pieces are literals, delimiters
    in even pieces become cuts.  An empty even piece between two literals is a doubled quote; quotes that open inside a
    value are plain characters."""
    last = F.size(pieces) - 1

    def piece(p: Column, i: Column) -> Column:
        before = F.get(pieces, i - 1)
        opens = before.rlike(rf"(?:^|{_DELIMITER})\s*(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}}[.)])?\s*$")
        plain = F.when((p == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.regexp_replace(p, _DELIMITER, _CUT))
        return F.when(F.pmod(i, F.lit(2)) == 0, plain).when(opens, p).otherwise(F.concat(F.lit('"'), p, F.lit('"')))

    return F.when(last == 0, F.regexp_replace(F.get(pieces, F.lit(0)), _DELIMITER, _CUT)).otherwise(F.array_join(F.transform(pieces, piece), ""))


def with_slots(df: DataFrame, field: str) -> DataFrame:
    """df with `slots` ARRAY<STRING> of a packed text field, an empty slot as an empty text, null for a null field; see
    unpack_values()."""
    text, quoted = F.col("_text"), F.col("_quoted")
    rows = df.withColumn("_text", canonical_form(F.col(field)))
    rows = rows.withColumn("_text", _strip(text)).withColumn("_text", _without_wrapper(text))
    rows = rows.withColumn("_text", F.replace(text, F.lit('\\"'), F.lit('""'))).withColumn("_quoted", _in_double_quotes(text))
    rows = rows.withColumn("_pieces", F.when(_balanced(quoted), F.split(quoted, '"')).when(_balanced(text), F.split(text, '"')).otherwise(F.array(text)))
    plain = F.regexp_replace(F.regexp_replace(_folded(F.col("_pieces")), _NUMBERING, "$1"), _ENCLOSED, "$1$2$3$4$5$6")
    slots = F.split(F.lower(F.regexp_replace(plain, rf"\s*{_CUT}\s*", _CUT)), _CUT)
    return rows.withColumn("slots", F.transform(slots, lambda v: F.trim(v))).drop("_text", "_quoted", "_pieces")


def packed_lists(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, slots ARRAY<STRING>) of a packed text field, an empty slot as an empty text; see unpack_values()."""
    rows = df.select(df[key].alias("key"), df[field].alias("text")).where("text is not null")
    return with_slots(rows, "text").select(F.col("key").alias(key), "slots")


def unpack_values(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, pos INT, value) for each value of a packed text field.

    The field is first brought to the consistent character form; values are in lower case, without outer blanks,
    enclosing quotes, brackets or numbering, and doubled quotes inside quotes are single.  pos counts from 1; an empty
    slot takes a position but gives no row.  Quotes that don't balance are plain characters.  A null, empty or blank
    field gives no row; repeated keys each give their rows; other columns of df, whatever their names, are left out.
    """
    # the outer form: the plain one has a filter inferred, into which every stage before would be copied
    rows = packed_lists(df, key, field).select(key, F.posexplode_outer("slots").alias("at", "value")).where("value <> ''")
    return rows.select(key, (F.col("at") + 1).cast("int").alias("pos"), "value")
