"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that mean the same in Java, RE2 and Python.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# Private-use characters that carry inline styling inside text.
_C = {i: chr(0xE000 + i) for i in range(1, 12)}
STRONG, EM, SUP, SUB = (_C[1], _C[2]), (_C[3], _C[4]), (_C[5], _C[6]), (_C[7], _C[8])
NOTE = (_C[9], _C[10], _C[11])
SENTINELS = f"[{_C[1]}-{_C[11]}]"
NOTE_REF = f"{NOTE[0]}([0-9]+){NOTE[1]}([^{NOTE[2]}\n]*){NOTE[2]}"
# What a footnote marker looks like.
MARKER = r"(?:\[[0-9]{1,3}\]|[0-9]{1,3}|[*†‡§¶]{1,3})"
LEADING_MARKER = r"^(\[[0-9]{1,3}\]|[0-9]{1,3}(?![0-9])|[*†‡§¶]{1,3})[.):]?\s*(?=\S)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain(markup: Column) -> Column:
    """Visible text: note references keep their label, all other styling goes."""
    return F.regexp_replace(F.regexp_replace(markup, NOTE_REF, "$2"), SENTINELS, "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+", "")


def visible_separators(text: Column) -> Column:
    """Zero-width spaces become a space; other zero-width marks go."""
    return F.regexp_replace(F.regexp_replace(text, r"\x{200b}+", " "), r"[\x{2060}\x{feff}\x{fffe}\x{ffff}]", "")


def words(text: Column) -> Column:
    """Lower-case word tokens; line-end and inner hyphens are taken out first."""
    joined = F.regexp_replace(plain(text), rf"[-\x{{ad}}]{SPACE}*\n{SPACE}*", "")
    joined = F.regexp_replace(joined, rf"(?<={WORD})[-\x{{ad}}](?={WORD})", "")
    return F.regexp_extract_all(F.lower(joined), F.lit(f"{WORD}+"), F.lit(0))


def letter_words(text: Column) -> Column:
    """Lower-cased runs of three or more ASCII letters."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower)


def lines(text: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")


def starts_lower(text: Column) -> Column:
    return text.rlike(r"^[\p{Ll}ªº]")


def without_hyphen(text: Column) -> Column:
    """The text without its last hyphen; styling after it stays."""
    return F.regexp_replace(F.regexp_replace(text, rf"{SPACE}+$", ""), f"-({SENTINELS}*)$", "$1")


def breakable(letters: Column) -> Column:
    """Whether a run of letters can be hyphenated at all: five letters and more with a consonant between vowels.

    Stands in for a dictionary of hyphenation patterns, which isn't part of this package.
    """
    return (F.length(letters) >= 5) & letters.rlike("(?i)[aeiouy][^aeiouy]+[aeiouy]")


def joined_lines(lines: Column) -> Column:
    """A block's lines as one text: a line that ends in a hyphen joins one that starts lower case if the word can be broken."""

    def step(done: Column, line: Column) -> Column:
        glued = F.concat(without_hyphen(done), line)
        broken = plain(done).endswith("-") & starts_lower(plain(line)) & breakable(F.regexp_replace(plain(glued), "[^A-Za-z]", ""))
        return F.when(done == "", line).when(broken, glued).otherwise(F.concat(done, F.lit(" "), line))

    return collapse(F.aggregate(lines, F.lit(""), step))


def marker_name(marker: Column) -> Column:
    return F.regexp_replace(F.trim(marker), r"^[\[\]]+|[\[\]]+$", "")


def superscripts(markup: Column) -> Column:
    """Names of the superscripts that could refer to notes, in order."""
    found = F.regexp_extract_all(markup, F.lit(f"{SUP[0]}([^{SUP[1]}]*){SUP[1]}"), F.lit(1))
    return F.transform(F.filter(found, lambda t: F.trim(t).rlike(f"^{MARKER}$")), marker_name)


def without_leading_marker(markup: Column) -> Column:
    opening = f"[{''.join(x[0] for x in (STRONG, EM, SUP, SUB))}\t ]{{0,10}}"
    closing = f"[{''.join(x[1] for x in (STRONG, EM, SUP, SUB))}]{{0,10}}"
    return F.regexp_replace(markup, rf"^{opening}(?:\[[0-9]{{1,3}}\]|[0-9]{{1,3}}(?![0-9])|[*†‡§¶]{{1,3}}){closing}[.):]?\s*", "")


#: Replacements of heading noise, in order (pattern, replacement); all ignore case.
HEADING_FIXES = (
    (r"\bpg\.?\s*[0-9]+\b$", ""),
    (r"\bpage\s*[0-9]+\b$", ""),
    (r"\bpg\.?\s*[0-9]+\b", ""),
    (r"\s+pg\.?\s*$", ""),
    (r"\s*[:\-–—]+\s*$", ""),
    (r"^(chapter)\s+1&(?=\s|$)", "$1 14"),
    (r"^(chapter)\s+&(?=\s|$)", "$1 4"),
    (r"^(chapter)\s+s(?=\s|$)", "$1 5"),
    (r"^(chapter\s+[0-9ivxlcdm]+)\s*&\s*", "$1 "),
    (r"^(chapter)\s*&\s*", "$1 "),
    (r"^(chapter)\s+[a-z]\s+(?=(?-i:[A-Z]))", "$1 "),
    (r"(?<=[0-9])\s*&\s*(?=[a-z])", ""),
    (r"(?<=[0-9])\s*&\s*(?=[0-9])", ""),
    (r"\b&\b", " "),
    (r"([0-9])&([0-9])", "$1$2"),
    (r"([0-9])&([a-z])", "$1$2"),
    (r"([a-z])&([0-9])", "$1$2"),
)


def heading(text: Column) -> Column:
    """A heading without page markers, trailing dashes and misread numbers."""
    out = strip(text)
    for pattern, new in HEADING_FIXES:
        out = F.regexp_replace(out, f"(?i){pattern}", new)
    return collapse(out)


def merged_title(left: Column, right: Column) -> Column:
    """One title of two: garbled or contained sides lose, others are joined."""
    garbled = r"(?i)^(chapter|part)\s+(?:&|[a-z])\s*"

    def one(both: Column) -> Column:
        a, b = both["a"], both["b"]
        return (
            F.when(a.rlike(garbled), b)
            .when(b.rlike(garbled), a)
            .when(F.contains(F.lower(b), F.lower(a)), b)
            .when(F.contains(F.lower(a), F.lower(b)), a)
            .otherwise(strip(F.concat_ws(" ", a, b)))
        )

    return F.when(left == "", right).when(right == "", left).otherwise(let(F.struct(heading(left).alias("a"), heading(right).alias("b")), one))


#: Home folders of Windows and Unix paths, and what stands for them and for the user's name.
HOMES = (r"[a-zA-Z]:[\\/](?:Users|Documents and Settings|home)[\\/][^\\/]+[\\/]", r"/(?:Users|home)/[^/]+/")
HOME_MARK, USER_MARK = "<sanitized_path>/", "<user>"


def redacted(text: Column, user: str = "") -> Column:
    """Home folders, and the user's name where it has three letters or more, blacked out."""
    if len(user) >= 3:
        text = F.regexp_replace(text, r"(?iu)" + re.escape(user), USER_MARK)
    for home in HOMES:
        text = F.regexp_replace(text, home, HOME_MARK)
    return text


def error_code(warning: Column) -> Column:
    """A warning's part before the colon as a slug."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.substring_index(warning, ":", 1), "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", ""))


def escaped(text: Column, quote: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quote else out


#: Fixed value: what may stand before an author's name.
AUTHOR_PREFIX = r"(?i)^\s*(?:written\s+by|by)\s*[:\-\s]+"


def author(text: Column) -> Column:
    """A name without 'by' before it; the text as it is when nothing else is left."""
    bare = strip(F.regexp_replace(text, AUTHOR_PREFIX, ""))
    return F.when(bare != "", bare).otherwise(strip(text))


def pdf_date(raw: Column) -> Column:
    """ISO form of a D:YYYYMMDD… date; null when malformed or before 1980."""
    form = r"^D:([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})?([0-9]{2})?([0-9]{2})?"
    year, *rest = (F.regexp_extract(raw, form, i) for i in range(1, 7))
    month, day, *clock = rest
    hour, minute, second = (F.when(c == "", "00").otherwise(c) for c in clock)
    iso = F.concat(F.concat_ws("-", year, month, day), F.lit("T"), F.concat_ws(":", hour, minute, second), F.lit("Z"))
    return F.when(raw.rlike(form) & (year.cast("int") >= 1980), iso)


def archive_second(second: Column) -> Column:
    """Archives keep even seconds."""
    return (second - second % 2).cast("int")


#: File name endings and media types.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}


def media_type(extension: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_replace(extension, r"^\.", ""))], F.lit("application/octet-stream"))


#: Ligatures, typographic quotes, and UTF-8 read as Windows-1252.
QUOTES = {"‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"'}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ"}
MISREAD = {"â€™": "’", "â€œ": "“", "â€\x9d": "”", "â€“": "–", "â€”": "—", "Ã©": "é", "Ã¨": "è", "Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä", "ÃŸ": "ß", "Ã±": "ñ", "Ã³": "ó", "Ã§": "ç"}


def repaired(text: Column, curly: bool = False) -> Column:
    """Common encoding damage put right (in part: see README); `curly` keeps typographic quotes."""
    for some in (MISREAD, LIGATURES, {} if curly else QUOTES):
        for old, new in some.items():
            text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0e-\x1f\x7f]", "")
