"""Text column functions; all of them are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.functions.contract import AUDIENCE_BYTES, AUDIENCE_MARKS, DEFAULT_AUDIENCE, GENERIC_BIGRAMS, PART_SEPARATOR, SECTIONS, SHORT_TEXT_TYPO

HAN_RUN = r"^\p{IsHan}"
WORD_RUNS = r"[\p{L}\p{Nd}]+"
TOKEN_RUNS = r"\p{IsHan}+|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_newlines(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "\r\n?", "\n")


def collapse_spaces(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def query_fingerprint(text: Column | str) -> Column:
    """Lowercase letters and digits only: equal fingerprints mark duplicate queries."""
    return F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]", "")


def hash_parts(*parts: Column | str) -> Column:
    """SHA-256 over the parts joined by the unit separator; a null part counts as empty."""
    filled = [F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(PART_SEPARATOR, *filled), 256)


def _grams_of_run(run: Column) -> Column:
    size = F.char_length(run)
    singles = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(run, i, F.lit(1)))
    pairs = F.when(
        size > 1,
        F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(run, i, F.lit(2))),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(singles, pairs)


def lower(text: Column | str) -> Column:
    """Lowercase letter by letter: two capitals whose lowercase Java makes depend on context are mapped first."""
    return F.lower(F.translate(col(text), "Σİ", "σi"))


def tokenize(text: Column | str) -> Column:
    """Words lowercased; a Han run gives its characters and then its adjacent pairs.

    Texts without Han characters, where runs are the tokens, skip the per-run work.
    """
    t = col(text)
    runs = F.regexp_extract_all(t, F.lit(TOKEN_RUNS), F.lit(0))
    mixed = F.flatten(
        F.transform(
            runs,
            lambda run: F.when(run.rlike(HAN_RUN), _grams_of_run(run)).otherwise(F.array(lower(run))),
        )
    )
    plain = F.regexp_extract_all(lower(t), F.lit(WORD_RUNS), F.lit(0))
    return F.when(t.rlike(r"\p{IsHan}"), mixed).otherwise(plain)


def byte_slice(text: Column | str, start: Column, end: Column) -> Column:
    """Half-open byte range of the UTF-8 form, decoded back to a string."""
    raw = F.encode(col(text), "UTF-8")
    return F.decode(F.substring(raw, start + 1, end - start), "UTF-8")


def is_han(token: Column, length: int) -> Column:
    return token.rlike(r"^\p{IsHan}{%d}$" % length)


def is_numeric(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$")


def meaningful_terms(tokens: Column, limit: int) -> Column:
    """Distinct search terms of a token list: no lone Han characters, no stop bigrams, no stubs."""
    generic = F.array(*[F.lit(b) for b in GENERIC_BIGRAMS])
    kept = F.filter(
        F.array_distinct(tokens),
        lambda t: ~is_han(t, 1) & ((F.char_length(t) >= 2) | is_numeric(t)),
    )
    return F.slice(F.array_except(kept, generic), 1, limit)


def query_terms(text: Column | str, limit: int) -> Column:
    """Meaningful terms, falling back to single Han characters when nothing else is left."""
    tokens = tokenize(text)
    terms = meaningful_terms(tokens, limit)
    singles = F.slice(F.filter(F.array_distinct(tokens), lambda t: is_han(t, 1)), 1, limit)
    return F.when(F.size(terms) > 0, terms).otherwise(singles)


def trigrams(text: Column | str) -> Column:
    """Distinct padded 3-grams of every word: two blanks before, one after."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.char_length(padded) - 2),
            lambda i: F.substring(padded, i, F.lit(3)),
        )

    return F.array_distinct(F.flatten(F.transform(F.array_distinct(words), grams)))


def gram_similarity(left: Column, right: Column) -> Column:
    """Shared grams over all grams of two distinct-gram arrays."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def typo_variant(text: Column | str, short_suffix: str = SHORT_TEXT_TYPO) -> Column:
    """Drop the middle character; texts under three characters get a fixed suffix instead."""
    t = F.trim(col(text))
    size = F.char_length(t)
    middle = F.floor(size / 2).cast("int")
    return F.when(
        size >= 3,
        F.concat(F.substring(t, F.lit(1), middle), F.substring(t, middle + 2, size)),
    ).otherwise(F.concat(col(text), F.lit(short_suffix)))


def stable_index(key: Column | str, n: int | Column) -> Column:
    """Hash position in ``0..n-1`` from the leading 60 bits of SHA-256."""
    leading = F.conv(F.substring(F.sha2(col(key), 256), 1, 15), 16, 10).cast("bigint")
    return F.pmod(leading, n if isinstance(n, Column) else F.lit(n))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round4(value: Column) -> Column:
    return F.round(value, 4)


def _number(text: Column | str, pattern: str) -> Column:
    found = F.regexp_extract(col(text), pattern, 1)
    return F.when(found != "", found.cast("bigint")).otherwise(F.lit(0))


def body_sections(body: Column | str, title: Column | str, fallback_text: Column | str, note_id: Column | str) -> dict[str, Column]:
    """Figures and sections of templated bodies: days, records, budget, conclusion, audience, record number."""
    conclusion = F.regexp_extract(col(body), SECTIONS["conclusion"], 1)
    begin, end = (F.instr(col(body), mark) for mark in AUDIENCE_MARKS)
    distance = F.octet_length(F.substring(col(body), begin, end - begin))
    between = F.substring(col(body), begin + len(AUDIENCE_MARKS[0]), end - begin - len(AUDIENCE_MARKS[0]))
    record = _number(title, SECTIONS["record"])
    return {
        "days": _number(body, SECTIONS["days"]),
        "records": _number(body, SECTIONS["records"]),
        "budget": _number(body, SECTIONS["budget"]),
        "conclusion": F.trim(F.when(F.regexp_like(col(body), F.lit(SECTIONS["conclusion"])), conclusion).otherwise(col(fallback_text))),
        "audience": F.when((begin > 0) & (end > begin) & (distance < AUDIENCE_BYTES), F.trim(between)).otherwise(F.lit(DEFAULT_AUDIENCE)),
        "record_number": F.when(record > 0, record).otherwise(col(note_id)),
    }
