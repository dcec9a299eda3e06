"""Parts of the DuckDB queries that stand beside the Spark ones: the consistent form, packed lists and names, each said
by means of its own (normalisation, translation and a cast to JSON), so that agreement shows something."""

from __future__ import annotations

from glossarium.functions.canonical import LATIN, LOOKALIKES

_WIDE, _PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_UNSEEN = r"[\x{AD}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FE00}-\x{FE0F}\x{FEFF}]"
_SPACES = r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def consistent(column: str) -> str:
    """The consistent form: widths, ligatures, spaces and accents of the whole text, and then, run by run of letters,
    letters of other scripts that stand among Latin ones."""
    x = f"translate({column}, '{_WIDE}', '{_PLAIN.replace(chr(39), chr(39) * 2)}')"
    x = f"regexp_replace(regexp_replace({x}, '{_UNSEEN}', '', 'g'), '{_SPACES}', ' ', 'g')"
    for one, letters in _LIGATURES.items():
        x = f"replace({x}, '{one}', '{letters}')"
    look = "".join(LOOKALIKES)
    mixed = f"regexp_full_match(u, '[{LATIN}{look}]+') AND regexp_matches(u, '[{LATIN}]') AND regexp_matches(u, '[{look}]')"
    run = f"CASE WHEN {mixed} THEN translate(u, '{look}', '{''.join(LOOKALIKES.values())}') ELSE u END"
    return f"array_to_string([{run} for u in regexp_extract_all(nfc_normalize({x}), '\\p{{L}}+|[^\\p{{L}}]+')], '')"


_ENDS = r"|;,\t\n\r\x03"
_VALUE = rf'[{_ENDS}]\s*(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}}\)|[0-9]{{1,4}}\.\s)?\s*((?:"(?:[^"]|"")*"|[^{_ENDS}]*))'


def slots(source: str, key: str, field: str, name: str = "sl") -> str:
    """Common table `name` (k, slots): the values of a packed field, empty slots as empty texts.  Lists that are JSON are
    read as JSON, lists in quotes and square brackets by their quotes, and the others value by value."""
    digits = lambda t: f"regexp_replace({t}, '([0-9]),([0-9])', '\\1' || chr(2) || '\\2', 'g')"
    text = digits(digits("regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '\\s+/\\s+', chr(3), 'g')"))
    bare = """CASE WHEN length(v) > 1 AND v[1] = '"' AND v[-1] = '"' THEN replace(v[2:-2], '""', '"') ELSE v END"""
    return rf"""{name}0 AS (SELECT {key} AS k, lower({consistent(field)}) AS t FROM {source} WHERE {field} IS NOT NULL),
 {name}1 AS (SELECT k, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') AS t FROM {name}0),
 {name}2 AS (SELECT k, CASE WHEN json_type(TRY_CAST(t AS JSON)) = 'ARRAY' THEN json_extract_string(TRY_CAST(t AS JSON), '$[*]') WHEN regexp_full_match(t, '\[\s*''.*\]|\[\s*".*\]', 's') THEN [v[2:-2] for v in regexp_extract_all(t, '''[^'']*''|"[^"]*"')] END AS listed,
  CASE WHEN regexp_full_match(t, '\[.*\]|\{{.*\}}', 's') THEN t[2:-2] ELSE t END AS t FROM {name}1),
 {name} AS (SELECT k, [trim(v, ' ') for v in coalesce(listed, [replace({bare}, chr(2), ',') for v in [trim(r, ' ') for r in regexp_extract_all('|' || {text}, '{_VALUE}', 1)]])] AS slots FROM {name}2)"""


def unpacked(source: str, key: str, field: str, name: str) -> str:
    """Rows (tab, row_id, field, pos, value) of a packed field; slots() of that name must stand in the WITH clause."""
    return f"SELECT '{source}' AS tab, k AS row_id, '{field}' AS field, CAST(pos AS INT) AS pos, slots[pos] AS value FROM (SELECT k, slots, unnest(range(1, len(slots) + 1)) AS pos FROM {name}) WHERE slots[pos] <> ''"


def plain_key(column: str) -> str:
    """Letters and digits of the consistent form, in lower case."""
    return rf"regexp_replace(lower({consistent(column)}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def parts_key(column: str) -> str:
    """The parts of a name in lower case, sorted, with a plus between them; null for null."""
    return rf"CASE WHEN {column} IS NOT NULL THEN array_to_string(list_sort([x for x in regexp_split_to_array(lower({consistent(column)}), '[^\p{{L}}\p{{N}}]+') if x <> '']), '+') END"
