"""Problem 2: text that looks the same brought to one form of characters.

The work is done by DuckDB inside Arrow partitions: `SQL` below holds the whole mapping (composition by
nfc_normalize, width and styled forms and spaces by translate, ligatures, invisible characters and joiners by
regular expressions, look-alike letters inside words by a lambda over the words).

Results: a null field stays null and is never `needed`; an empty one stays empty; very long texts are handled
whole. `needed` says whether the unified field differs from the stored one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.session import spread

#: Compatibility classes (Unicode decomposition tags) that only change how a letter is drawn.
STYLES = {"<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<small>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Blocks whose <compat> forms are drawn variants too: Latin and Armenian ligatures, Roman numerals.
STYLED_BLOCKS = ((0xFB00, 0xFB17), (0x2160, 0x217F))
#: Where such characters are: letterlike symbols and enclosed forms, CJK forms, presentation forms, width forms, mathematical and enclosed alphabets.
STYLED_RANGES = ((0x2100, 0x218F), (0x2460, 0x24FF), (0x3200, 0x33FF), (0xFB00, 0xFDFF), (0xFE10, 0xFEFC), (0xFF00, 0xFFEF), (0x1D400, 0x1D7FF), (0x1EE00, 0x1EEFF), (0x1F100, 0x1F1E5))

# Spaces other than the ordinary one, line and tab characters.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u2028\u2029\u0085"
# Characters without a shape of their own (joiners and variation selectors are judged by their neighbours).
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{FDD0}-\x{FDD3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}"

# Letters of other scripts and the Latin letters that look like them.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏк", "ABESIJKMHOPCTYXaesijopcyxhdqwlk", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυκϲϳ", "ABEZHIKMNOPTYXaivopukcj", strict=True))
ARMENIAN = dict(zip("ՏՍՕօոսցհ", "SUOonugh", strict=True))
LATIN = {"ɡ": "g", "ɑ": "a"}
LOOKALIKES = CYRILLIC | GREEK | ARMENIAN | LATIN


@lru_cache(1)
def styled() -> tuple[dict[str, str], dict[str, str]]:
    """Drawn variants with one character in the plain form, and those with several."""
    one, many = {}, {}
    for low, high in STYLED_RANGES:
        for point in range(low, high + 1):
            tag = unicodedata.decomposition(chr(point)).partition(" ")[0]
            if tag in STYLES or tag == "<compat>" and any(a <= point <= b for a, b in STYLED_BLOCKS):
                plain = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", chr(point)))
                (one if len(plain) == 1 else many)[chr(point)] = plain
    return one, many


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(1)
def expression() -> str:
    """The mapping as one SQL expression over a column named `stored`."""
    one = styled()[0]
    source = "".join(one) + SPACES
    target = "".join(one.values()) + " " * len(SPACES)
    steps = f"nfc_normalize(translate(stored, {quoted('\ufdd0\ufdd1\ufdd2\ufdd3')}, ''))"
    # what a joiner or a selector needs beside it; noncharacters stand in for those that stay
    emoji = r"\x{1F000}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2460}-\x{27BF}\x{2900}-\x{297F}\x{2B00}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}©®™ℹ‼⁉"
    for pattern, put in (
        (rf"([{emoji}0-9#*])\x{{FE0F}}", "\\1\ufdd2"),
        (rf"([{emoji}])\x{{FE0E}}", "\\1\ufdd3"),
        (rf"([{emoji}\x{{FDD2}}])\x{{200D}}([{emoji}])", "\\1\ufdd0\\2"),
        (rf"([{emoji}\x{{FDD2}}])\x{{200D}}([{emoji}])", "\\1\ufdd0\\2"),
        (r"(\x{094D})\x{200D}", "\\1\ufdd0"),
        (r"(\x{094D})\x{200C}([\x{0900}-\x{097F}])", "\\1\ufdd1\\2"),
    ):
        steps = f"regexp_replace({steps}, {quoted(pattern)}, {quoted(put)}, 'g')"
    steps = f"regexp_replace({steps}, {quoted('[' + INVISIBLE.replace(chr(92) + 'x{FDD0}-' + chr(92) + 'x{FDD3}', '') + ']')}, '', 'g')"
    steps = f"translate({steps}, {quoted('﷐﷑﷒﷓' + source)}, {quoted(chr(0x200D) + chr(0x200C) + chr(0xFE0F) + chr(0xFE0E) + target)})"
    return steps


def spelled_sql() -> str:
    """Forms that stand for several letters (ligatures, enclosed numbers), over a column named `drawn`."""
    many = styled()[1]
    each = "CASE " + " ".join(f"WHEN c = {quoted(k)} THEN {quoted(v)}" for k, v in many.items()) + " ELSE c END"
    return f"CASE WHEN regexp_matches(drawn, {quoted('[' + ''.join(many) + ']')}) THEN array_to_string(list_transform(string_split(drawn, ''), lambda c: {each}), '') ELSE drawn END"


def words_sql() -> str:
    """Letters of another script inside a word take the form of the script the word is written in."""
    other = "".join(CYRILLIC | GREEK | ARMENIAN)
    scripts = r"\p{Cyrillic}\p{Greek}\p{Armenian}"
    mixed = rf"[A-Za-z\x{{00C0}}-\x{{024F}}]\p{{M}}*[{scripts}]|[{scripts}]\p{{M}}*[A-Za-z\x{{00C0}}-\x{{024F}}]|\p{{Cyrillic}}[\p{{Greek}}\p{{Armenian}}]|[\p{{Greek}}\p{{Armenian}}]\p{{Cyrillic}}|[ɡɑ]"
    rest = rf"[{scripts}]"
    latin = f"translate(w, {quoted(''.join(LOOKALIKES))}, {quoted(''.join(LOOKALIKES.values()))})"
    back = {v: k for k, v in reversed(CYRILLIC.items())}
    cyrillic = f"translate(w, {quoted(''.join(back))}, {quoted(''.join(back.values()))})"
    return (
        f"CASE WHEN regexp_matches(plain, {quoted(mixed)}) THEN array_to_string(list_transform(regexp_extract_all(plain, {quoted(r'[' + chr(92) + 'p{L}' + chr(92) + 'p{M}]+|[^' + chr(92) + 'p{L}' + chr(92) + 'p{M}]+')}), "
        f"lambda w: CASE WHEN NOT regexp_matches(w, {quoted(mixed)}) THEN w WHEN NOT regexp_matches({latin}, {quoted(rest)}) THEN {latin} "
        f"WHEN NOT regexp_matches({cyrillic}, '[A-Za-z]') THEN {cyrillic} ELSE {latin} END), '') ELSE plain END"
    )


@lru_cache(1)
def statement() -> str:
    """Only fields with a character beyond ASCII can differ; the others pass as they are."""
    odd = r"[^\x00-\x7F]"
    return (
        f"WITH given AS (SELECT id, field, stored, stored IS NOT NULL AND regexp_matches(stored, '{odd}') AS odd FROM fields), "
        f"composed AS (SELECT id, field, stored, {expression()} AS drawn FROM given WHERE odd), "
        f"again AS (SELECT id, field, stored, nfc_normalize({spelled_sql()}) AS plain FROM composed), "
        f"done AS (SELECT id, field, stored, {words_sql()} AS unified FROM again) "
        "SELECT id, field, unified, unified <> stored AS needed FROM done "
        "UNION ALL SELECT id, field, stored, false FROM given WHERE NOT odd"
    )


def unify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
    sql = statement()
    for batch in batches:
        if batch.num_rows:
            con.register("fields", pa.Table.from_batches([batch]))
            table = con.sql(sql).to_arrow_table()
            con.unregister("fields")
            yield from table.cast(SCHEMA).to_batches()


SCHEMA = pa.schema([("id", pa.int64()), ("field", pa.string()), ("unified", pa.string()), ("needed", pa.bool_())])


def unified(fields: DataFrame) -> DataFrame:
    """Of rows (id, field, stored): (id, field, unified, needed)."""
    return fields.select("id", "field", "stored").mapInArrow(unify_batches, "id long, field string, unified string, needed boolean")


def fields_of(pages: DataFrame) -> DataFrame:
    """A row (id, field, stored) for the title and for the text of each page."""
    return spread(pages.select("id", "title", "text")).select("id", F.expr("stack(2, 'title', title, 'text', text) AS (field, stored)"))
