"""Text columns: ASCII case, terms, bounded lengths, times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


#: What an equal text, and one that contains the phrase, is worth.
EQUAL, CONTAINS = 1.4, 0.9


def score_text(text: Column, phrase: str, terms: Sequence[str], weight: Column | float) -> Column:
    """Lexical score of a lower-cased text: phrase, then the share of terms it contains."""
    whole = F.when(text == phrase, EQUAL).when(text.contains(phrase) if phrase else F.lit(False), CONTAINS).otherwise(0.0)
    matched = F.lit(0)
    for t in terms:
        matched = matched + text.contains(t).cast("int")
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return F.when((whole == 0) & (matched == 0), 0.0).otherwise(weight * (whole + matched / F.lit(float(max(1, len(terms))))))


def clipped(text: Column, characters: int) -> Column:
    """White space made single, and a text that is too long cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > characters, F.concat(F.rtrim(F.substring(flat, 1, characters - 1)), F.lit("…"))).otherwise(flat)


#: Bytes of stored, embedded and summary texts.
STORED_BYTES, EMBEDDED_BYTES, SUMMARY_BYTES = 32 * 1024, 12 * 1024, 160


def bounded_bytes(text: Column, limit: int) -> Column:
    """The trimmed text in at most ``limit`` UTF-8 bytes, cut between characters and marked with an ellipsis."""
    flat = F.trim(text)
    raw = F.encode(flat, "UTF-8")
    room = limit - len("…".encode())
    # the longest prefix of characters that fits: drop trailing bytes of a character that was cut
    cut = F.regexp_replace(F.hex(F.substring(raw, 1, room)), "(?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F])?|[CD][0-9A-F])$", "")
    return F.when(F.octet_length(flat) > limit, F.concat(F.decode(F.unhex(cut), "UTF-8"), F.lit("…"))).otherwise(flat)


def epoch_millis(text: Column) -> Column:
    """Milliseconds of an RFC 3339 time; null where it is none."""
    return F.unix_millis(F.try_to_timestamp(text))
