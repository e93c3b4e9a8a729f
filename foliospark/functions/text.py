"""Text scalars as Column expressions: tokens, normal forms, language signals, sentences."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-zA-ZÀ-ÿ0-9][a-zA-ZÀ-ÿ0-9_-]+"
PLAIN_WORD = "[a-z0-9_ßœæø]{2,}"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = f"[{LETTERS}]{{2,}}"
INLINE_HYPHEN = f"[{LETTERS}]{{2,}}-[{LETTERS}]{{2,}}"

# Function words of the two languages that language detection counts.
FRENCH = (
    "le la les des une un du de et est dans pour que qui sur par avec plus cette ces aux ont ete etre nous je au en il elle sont "
    "ainsi alors mais ou si se sa son leur leurs comme entre tout tous chapitre resume aussi donc peut cela afin lors sans meme deux trois"
).split()
ENGLISH = (
    "the of and to in a is that for with on as are by this be from at it we which an or has have was were can not but their these "
    "its also more than such been there when however between during chapter figure table each both using"
).split()
LEAST_SIGNALS = 5
# Characters that cleaning replaces one by one, and those it drops.
DASHES = "‐‑‒–—―−⁃"
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟«»″"
SPACES = "           　"
INVISIBLE = "­​‌‍﻿"
# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE"}


def _accents() -> tuple[str, str]:
    """Letters up to U+024F that decompose to one ASCII letter, and those letters; made by rule."""
    pairs = []
    for code in range(0xC0, 0x250):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii() and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def tokens(text: Column) -> Column:
    """Lower-case tokens of two characters or more; none for a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def normalize_text(text: Column) -> Column:
    """Lower case, accents off, every other run one blank, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[^a-z0-9]+", " "))


def normalize_unicode(text: Column) -> Column:
    """Ligatures spelled out, dashes, quotes and spaces in ASCII, invisible characters dropped; composed letters stay as they are."""
    out = F.translate(text, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + SPACES + INVISIBLE, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + " " * len(SPACES))
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out


#: Finds all that normalize_unicode() changes, and some more; a few ranges are looked for faster than each character.
MAYBE_LOOSE = "[\u00a0\u00ab\u00ad\u00bb\u00c6\u00e6\u0152\u0153\u2000-\uffff]"


def normalized(text: str) -> Column:
    """normalize_unicode() of a column by name; ASCII and other texts without any such character are only looked through."""
    loose = (F.length(text) < F.octet_length(text)) & F.col(text).rlike(MAYBE_LOOSE)
    return F.when(loose, normalize_unicode(F.col(text))).otherwise(F.col(text))


def line_keys(text: str) -> Column:
    """line_key() of every newline-separated line of a column by name: all but the trimming is done on the whole text, as none of it goes over a line's end."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(normalized(text)), "[0-9]+", "#"), "[^\\S\n]+", " ")
    return F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x))


def line_key(line: Column) -> Column:
    """The form under which running lines are counted: lower case, digits as #, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(normalize_unicode(line)), "[0-9]+", "#"), "\\s+", " "))


def is_page_number(line: Column) -> Column:
    """A lone number of up to four digits, a Roman numeral of up to eight letters, or `page N` / `p. N`."""
    t = F.trim(line)
    return t.rlike("^[0-9]{1,4}$") | t.rlike("(?i)^[ivxlcdm]{1,8}$") | t.rlike("(?i)^(page|p\\.)\\s*[0-9]{1,4}$")


def signals(text: Column, words: list[str]) -> Column:
    """How many words of the text, e and a without accents, are in the list."""
    plain = F.lower(text)
    for accented, letter in zip("éèêà", "eeea", strict=True):
        plain = F.replace(plain, F.lit(accented), F.lit(letter))
    found = F.regexp_extract_all(plain, F.lit(f"[{LETTERS}']+"), F.lit(0))
    return F.coalesce(F.size(F.filter(found, lambda w: w.isin(words))), F.lit(0))


def language(fr: Column, en: Column, text: Column, default: str = "en") -> Column:
    """STRUCT<lang, confidence> from the two signal counts."""
    total = fr + en
    blank = F.coalesce(~text.rlike("\\S"), F.lit(True))
    pair = lambda a, b: F.struct(a.alias("lang"), b.cast("double").alias("confidence"))
    return (
        F.when(blank, pair(F.lit("unknown"), F.lit(0.0)))
        .when(total < LEAST_SIGNALS, pair(F.lit(default), F.lit(0.0)))
        .when(fr == en, pair(F.lit(default), F.lit(0.5)))
        .otherwise(pair(F.when(fr > en, "fr").otherwise("en"), F.round(F.greatest(fr, en) / total, 3)))
    )


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences of `least` characters or more: blanks collapsed, cut after . ! or ? before a capital or digit."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.filter(F.transform(F.split(flat, "(?<=[.!?])\\s+(?=[A-ZÀ-ÖØ-Þ0-9])"), lambda x: F.trim(x)), lambda s: F.length(s) >= least)


def occurrences(text: Column, term: str) -> Column:
    """Case-insensitive, non-overlapping occurrences of a literal term."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower())))) / len(term)).cast("long")
