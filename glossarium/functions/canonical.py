"""One consistent character form for text that looks alike.

The form replaces only what hides behind another look: full-width and
mathematical letter forms, typographic ligatures, spaces other than the plain
one, invisible characters, accents set apart from their letter, canonical
singletons, and letters of another script inside a Latin word.  Everything else
(composed accents, foreign words, superscripts, fractions, dashes, curly
quotes, tabs, line ends, ae and oe letters) passes unchanged.

Method: a quick-check character class, derived from the Unicode database by
rule, finds the characters that may be unstable.  Only the runs around such
characters are normalised, with their neighbouring letters as context, and are
spliced back into the untouched text.  On Spark the quick check runs inside the
JVM, so that only values that fail it ever reach a Python worker.

Defined results: null stays null, an empty text stays empty.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ԛ": "Q", "Ӏ": "I",
    # Greek
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P",
    "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮤ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K",
    "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W",
    "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}

LATIN = "A-Za-zªºÀ-ÖØ-öø-ɏɐ-ʯḀ-ỿ"
_VISIBLE_FORMATS = (range(0x600, 0x606), range(0x6DD, 0x6DE), range(0x70F, 0x710), range(0x890, 0x892), range(0x8E2, 0x8E3), range(0x110BD, 0x110BE), range(0x110CD, 0x110CE), range(0x13430, 0x13460))
_LINE_MARKS = "\t\n\x0b\x0c\r\x85"
_ODD = re.compile(r"[^\t\n\x0b\x0c\r -~]")


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str | None], set[int]]:
    """(replacement of each unstable character, combining marks), by rule from the Unicode database."""
    single: dict[int, str | None] = {}
    marks: set[int] = set()
    for cp in [*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)]:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        form = unicodedata.decomposition(ch)
        if kind == "Zs":
            if ch != " ":
                single[cp] = " "
        elif kind in ("Cf", "Cc"):
            if ch not in _LINE_MARKS and not any(cp in r for r in _VISIBLE_FORMATS):
                single[cp] = None
        elif 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            single[cp] = None
        elif form.startswith(("<wide>", "<narrow>", "<font>")) or 0xFB00 <= cp <= 0xFB06:
            single[cp] = unicodedata.normalize("NFKC", ch)
        elif unicodedata.combining(ch):
            marks.add(cp)
        elif unicodedata.normalize("NFC", ch) != ch:
            single[cp] = unicodedata.normalize("NFC", ch)
    return single, marks


def _ranges(points: set[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in sorted(points):
        if out and cp == out[-1][1] + 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def _maybe(single: dict, marks: set[int]) -> list[tuple[int, int]]:
    """Ranges that hold every unstable character.  Gaps are closed beyond the common Latin letters and punctuation, as
    a class of few ranges is far quicker to test; the Python side decides exactly."""
    common = {*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x1E00, 0x1F00), *range(0x3001, 0xAC00), *range(0xAC00, 0xD7A4)}
    out: list[tuple[int, int]] = []
    for a, b in _ranges({*single, *marks, *map(ord, LOOKALIKES)}):
        if out and a - out[-1][1] <= 512 and common.isdisjoint(range(out[-1][1] + 1, a)):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def quick_check() -> str:
    """Java regular expression: a text without a match is already in the consistent form."""
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" if a < b else rf"\x{{{a:X}}}" for a, b in _maybe(*_tables())) + "]"


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern, dict[int, str], re.Pattern]:
    single, marks = _tables()

    def chars(points) -> str:
        return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if a < b else "") for a, b in _ranges(set(points)))

    unstable = chars({*single, *marks, *map(ord, LOOKALIKES)})
    run = re.compile(rf"[\w{unstable}]+")
    letters = re.compile(r"[^\W\d_]+")
    look = "".join(map(re.escape, LOOKALIKES))
    mixed = re.compile(rf"(?=[{LATIN}]*[{look}])(?=[{look}]*[{LATIN}])[{LATIN}{look}]+")
    return re.compile(f"[{unstable}]"), run, letters, str.maketrans(LOOKALIKES), mixed


def _segment(match: re.Match) -> str:
    single, _ = _tables()
    unstable, _, letters, look, mixed = _patterns()
    text = match.group()
    if not unstable.search(text):
        return text
    text = unicodedata.normalize("NFC", text.translate(single))
    text = letters.sub(lambda m: m.group().translate(look) if mixed.fullmatch(m.group()) else m.group(), text)
    return unicodedata.normalize("NFC", text)


@lru_cache(maxsize=1)
def _unstable_set() -> frozenset[str]:
    single, marks = _tables()
    return frozenset(map(chr, {*single, *marks})) | frozenset(LOOKALIKES)


def canonical_text(text: str | None) -> str | None:
    """The consistent form of one text; the same rule that canonical_form() applies to a column."""
    # few characters of a text are outside plain ASCII: only these are looked up
    if not text or _unstable_set().isdisjoint(_ODD.findall(text)):
        return text
    unstable, run, *_ = _patterns()
    return " ".join(run.sub(_segment, part) if not (part.isascii() and part.isprintable()) and unstable.search(part) else part for part in text.split(" "))


def _splice(text: Column) -> Column:
    def spliced(texts: pd.Series) -> pd.Series:
        return texts.map(canonical_text, na_action="ignore").astype(object)

    return F.pandas_udf(spliced, StringType())(text)


def is_unstable(text: Column) -> Column:
    """True where the quick check finds a character that may have to change."""
    return F.coalesce(text.rlike(r"[^\t\n\x0b\x0c\r -~]") & text.rlike(quick_check()), F.lit(False))


def canonical_form(text: Column) -> Column:
    """The text in its consistent form; values that pass the quick check never leave the JVM."""
    unstable = is_unstable(text)
    return F.when(unstable, _splice(F.when(unstable, text))).otherwise(text)


assert sys.maxunicode == 0x10FFFF
