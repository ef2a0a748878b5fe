"""Scores, vectors and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jointmill.functions.paths import col, trimmed


def defect_score(logits: Column | str) -> Column:
    """One minus the softmax share of the first logit, in double; null for null or empty logits."""
    z = F.transform(col(logits), lambda x: x.cast("double"))
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.when(F.size(z) > 0, 1 - F.exp(F.get(z, F.lit(0)) - top) / total)


def argmax(values: Column | str) -> Column:
    """Index from 0 of the first largest element; null for null or empty arrays."""
    v = col(values)
    return F.when(F.size(v) > 0, F.array_position(v, F.array_max(v)) - 1)


def fingerprint_hex(c: Column | str) -> Column:
    """64 lower-case hex digits of a fingerprint with or without 0x; null if unreadable or zeros only."""
    x = F.regexp_replace(F.lower(trimmed(c)), "^0x", "")
    return F.when(x.rlike("^[0-9a-f]{64}$") & ~x.rlike("^0+$"), x)


def hamming_hex(a: Column | str, b: Column | str, digits: int = 64) -> Column:
    """Differing bits of two hex strings of equal length, in words of eight digits."""
    a, b = col(a), col(b)
    word = lambda x, i: F.conv(F.substring(x, i * 8 + 1, 8), 16, 10).cast("long")
    total = None
    for i in range(digits // 8):
        d = F.bit_count(word(a, i).bitwiseXOR(word(b, i)))
        total = d if total is None else total + d
    return total


def digest_number(text: Column, digits: int = 15, at: int = 1) -> Column:
    """Hex digits of the text's MD5 as a number: any engine can compute it."""
    return F.conv(F.substring(F.md5(text), at, digits), 16, 10).cast("long")


def print_words(hex_digits: Column | str, digits: int = 64) -> Column:
    """A hex string as a struct of longs w0, w1, ..., sixteen digits each."""
    c = col(hex_digits)
    half = lambda at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return F.struct(*[F.shiftleft(half(i * 16 + 1), 32).bitwiseOR(half(i * 16 + 9)).alias(f"w{i}") for i in range(digits // 16)])


def word_digits(words: Column, digits: int = 64) -> Column:
    """The hex string of print_words()."""
    return F.lower(F.concat(*[F.lpad(F.hex(words[f"w{i}"]), 16, "0") for i in range(digits // 16)]))


def hamming_words(a: Column, b: Column, digits: int = 64) -> Column:
    """Differing bits of two structs of print_words()."""
    total = None
    for i in range(digits // 16):
        d = F.bit_count(a[f"w{i}"].bitwiseXOR(b[f"w{i}"]))
        total = d if total is None else total + d
    return total.cast("int")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine with the norms floored at 1e-12."""
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where whole is not positive."""
    return F.when(whole > 0, part.cast("double") / F.nullif(whole, F.lit(0))).otherwise(F.lit(0.0))
