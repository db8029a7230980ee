"""Text normalisation, tokens and small extractors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ENDINGS, STOP_WORDS

BLANKS = "[\\s  ]+"


def folded(text: Column) -> Column:
    """Lower case with ß as ss and ё as е."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ё"), F.lit("е"))


def name_key(text: Column) -> Column:
    """Blanks joined, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, BLANKS, " ")))


def material_key(text: Column) -> Column:
    """A name key with ё as е and without outer blanks, dots, commas and colons."""
    return F.regexp_replace(F.replace(name_key(text), F.lit("ё"), F.lit("е")), "^[ .,;:]+|[ .,;:]+$", "")


def compact(text: Column, limit: int) -> Column:
    """Blanks joined; cut to the limit with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, BLANKS, " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def stem(word: Column) -> Column:
    """The first ending of the ordered list that fits and leaves four letters is cut; only words of Cyrillic letters."""
    out = word
    for ending in reversed(ENDINGS):
        n = len(ending)
        out = F.when(word.endswith(ending) & (F.length(word) - n >= 4), word.substr(F.lit(1), F.length(word) - n)).otherwise(out)
    return F.when(word.rlike("^[а-яё]+$"), out).otherwise(word)


def tokens(text: Column) -> Column:
    """Search tokens: at least three characters, no stop words, tokens with digits as they are, others stemmed from four letters on."""
    raw = F.transform(F.regexp_extract_all(folded(text), F.lit(r"[0-9a-zа-я.-]{2,}"), 0), lambda t: F.btrim(t, F.lit(".-")))
    kept = F.filter(raw, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))
    return F.transform(kept, lambda t: F.when(t.rlike("[0-9]") | (F.length(t) < 4), t).otherwise(stem(t)))


def simple_tokens(text: Column) -> Column:
    """tokens without stop words and stems."""
    raw = F.transform(F.regexp_extract_all(folded(text), F.lit(r"[0-9a-zа-я.-]{2,}"), 0), lambda t: F.btrim(t, F.lit(".-")))
    return F.filter(raw, lambda t: F.length(t) >= 3)


def question_terms(question: Column) -> Column:
    """Distinct words of a question that a hit should have: four characters or more, no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("[0-9a-zа-яё]{3,}"), 0)
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 4) & ~t.isin(*STOP_WORDS)))


def term_id(term: Column) -> Column:
    """A 31-bit id from the term's CRC-32."""
    return F.crc32(F.encode(term, "UTF-8")).bitwiseAND(F.lit(0x7FFFFFFF))


def subject_key(subject: Column) -> Column:
    """A mail subject without reply and forward prefixes, however many."""
    return name_key(F.regexp_replace(subject, r"(?iu)^\s*((re|fw|fwd|aw|wg|ответ|пересл)(\[[0-9]+\])?\s*:\s*)+", ""))


def heading_level(line: Column) -> Column:
    """Depth of a markdown or numbered heading, null for other lines."""
    return F.when(line.rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract(line, "^(#{1,6})", 1))).when(
        line.rlike(r"^[0-9]+(\.[0-9]+)*\.?\s+\S"), F.size(F.split(F.regexp_extract(line, r"^([0-9]+(?:\.[0-9]+)*)", 1), r"\."))
    )


def norm_references(text: Column) -> Column:
    """Distinct references to standards, in the order of the text, upper case with joined blanks."""
    found = F.regexp_extract_all(text, F.lit(r"(?iu)\b((?:СП|СНиП|ГОСТ(?:\s+Р)?|ISO|EN|DIN)\s*[0-9]+(?:[.\-][0-9]+)*)"), 1)
    return F.array_distinct(F.transform(found, lambda t: F.upper(F.regexp_replace(t, BLANKS, " "))))


def without_markup(text: Column) -> Column:
    """Break tags, data addresses, long base64 runs and control characters out; runs of blank lines joined."""
    out = F.regexp_replace(text, r"(?i)<br\s*/?>", " ")
    out = F.regexp_replace(out, r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+", "")
    out = F.regexp_replace(out, r"[A-Za-z0-9+/]{256,}={0,2}", "")
    out = F.regexp_replace(out, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again, where that gives Cyrillic and no replacement characters."""
    narrow = text.rlike("^[\\x00-\\xff]*$") & text.rlike("[ÐÑ][\\x80-\\xbf]")
    again = F.when(narrow, F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string")))
    return F.when(again.rlike("[А-Яа-яЁё]"), again).otherwise(text)


def fingerprint(text: Column, limit: int = 500) -> Column:
    """SHA-256 of the first characters of the name key."""
    return F.sha2(F.substring(name_key(text), 1, limit), 256)
