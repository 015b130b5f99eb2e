"""Text helpers as Column expressions: trimming, line splitting, guarded numbers, entities.

Everything here is a built-in expression, so it runs inside the JVM and works alike
on batch tables and on streams.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.sqltext import lit

# The characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: what ends a line.
NEWLINE = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"

# Fixed value: texts that read as a decimal number (digits may be grouped by underscores).
NUMBER = (
    r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?"
    r"|inf|infinity|nan)$"
)

# Named character references (the common ones; numbers are decoded by rule).
REFERENCES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0",
    "copy": "©", "reg": "®", "trade": "™", "sect": "§", "deg": "°", "middot": "·", "bull": "•", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "sbquo": "‚", "ldquo": "“", "rdquo": "”", "bdquo": "„",
    "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "times": "×", "iexcl": "¡", "iquest": "¿",
    "agrave": "à", "aacute": "á", "acirc": "â", "atilde": "ã", "auml": "ä", "aring": "å", "aelig": "æ", "ccedil": "ç",
    "egrave": "è", "eacute": "é", "ecirc": "ê", "euml": "ë", "igrave": "ì", "iacute": "í", "icirc": "î", "iuml": "ï",
    "ntilde": "ñ", "ograve": "ò", "oacute": "ó", "ocirc": "ô", "otilde": "õ", "ouml": "ö", "oslash": "ø", "oelig": "œ",
    "ugrave": "ù", "uacute": "ú", "ucirc": "û", "uuml": "ü", "szlig": "ß",
    "Agrave": "À", "Aacute": "Á", "Auml": "Ä", "Ccedil": "Ç", "Egrave": "È", "Eacute": "É", "Ntilde": "Ñ", "Oacute": "Ó",
    "Ouml": "Ö", "Uacute": "Ú", "Uuml": "Ü",
}
_REFERENCE = r"&(?:#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?|([A-Za-z]{2,8});)"


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends (a byte-level trim, no regex)."""
    return F.btrim(text, F.lit(WHITESPACE))


def strip_sql(text: str) -> str:
    return f"btrim({text}, {lit(WHITESPACE)})"


def split_trimmed_sql(text: str) -> str:
    """Split on commas and trim every part."""
    return f"transform(split({text}, ','), part -> {strip_sql('part')})"


def unescape_sql(text: str) -> str:
    """Decode character references in one pass, so nothing is decoded twice.

    Decimal and hexadecimal ones in general (code points that no text can hold become U+FFFD),
    named ones if they are common; an unknown name stays as it is.
    """
    pattern = lit(_REFERENCE)
    names = f"map_from_arrays(split({lit(' '.join(REFERENCES))}, ' '), split({lit(' '.join(REFERENCES.values()))}, ' '))"
    number = "cast(if(lower(left(n, 1)) = 'x', conv(substring(n, 2), 16, 10), n) as bigint)"
    sound = f"if({number} between 1 and 1114111 and not {number} between 55296 and 57343, {number}, 65533)"
    char = f"decode(unhex(lpad(hex({sound}), 8, '0')), 'UTF-32')"
    one = f"if(n <> '', {char}, coalesce(try_element_at({names}, m), concat('&', m, ';')))"
    found = f"zip_with(regexp_extract_all({text}, {pattern}, 1), regexp_extract_all({text}, {pattern}, 2), (n, m) -> {one})"
    out = f"array_join(zip_with(split({text}, {pattern}, -1), {found}, (t, c) -> concat(t, coalesce(c, ''))), '')"
    return f"CASE WHEN contains({text}, '&') THEN {out} ELSE {text} END"


def split_lines(text: Column) -> Column:
    return F.split(text, NEWLINE)


def number(text: Column) -> Column:
    """The text as a double, or null if it is not a number as a whole."""
    return F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def title_case(name: Column) -> Column:
    """``structured_data`` -> ``Structured Data``."""
    return F.initcap(F.translate(name, "_", " "))


def half_even(value: Column) -> Column:
    """Round half to even, as an integer."""
    return F.bround(value, 0).cast("int")


def clamp(value: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
