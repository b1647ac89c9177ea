"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits, underscore and the whole Devanagari block: the marks belong to their words.
TOKEN = r"[\p{L}\p{N}_\x{0900}-\x{097F}]+"


def tokens(text: Column) -> Column:
    """The tokens of a text, lower case; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


#: White space of any script, spelled out: a class of code points is tested far faster than a property.
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def collapsed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def cleaned(text: Column) -> Column:
    """Control characters as blanks, then white space collapsed."""
    return collapsed(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " "))


def detected_language(text: Column) -> Column:
    """By the share of Devanagari letters among these and ASCII letters: ne, en, mixed or unknown."""
    deva, latin = F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}&&\p{L}]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    both = deva + latin
    return F.when(text.isNull() | (both == 0), "unknown").when(deva >= 0.8 * both, "ne").when(latin >= 0.8 * both, "en").otherwise("mixed")


def micros(moment: Column | str) -> Column:
    """Microseconds since 1970 of a time with or without zone (the session's zone is UTC)."""
    return F.unix_micros((F.col(moment) if isinstance(moment, str) else moment).cast("timestamp"))
