"""Token counts, exact or from samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kinds

SAMPLE_BYTES = 8192
HEAD_CHARS = 4096
#: White space of the measure: wider than a regular expression's own class.
SPACE = r"\s\x{B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_ASTRAL = r"\x{10000}-\x{10FFFF}"

Tokenizer = Callable[[Column], Column]


def count(text: Column) -> Column:
    """A quarter of each run of ASCII word characters, rounded up, and one for each other UTF-16 unit that isn't white space."""
    # In one pass, up to four characters of a run become its first, white space nothing, and what two UTF-16 units take is doubled.
    marks = F.regexp_replace(text, rf"([A-Za-z0-9_])[A-Za-z0-9_]{{0,3}}|[{SPACE}]|([^A-Za-z0-9_{SPACE}{_ASTRAL}])|([{_ASTRAL}])", "$1$2$3$3")
    return F.coalesce(F.length(marks).cast("long"), F.lit(0))


def is_exact(path: Column, size: Column, tier: Column, kind: Column) -> Column:
    """Whether the whole file is measured, not two samples of it."""
    return (kind != "binary") & ~kinds.is_minified(path) & ((tier == 0) | (size <= 2 * SAMPLE_BYTES))


def middle_at(size: Column) -> Column:
    """Where the second sample of a file begins."""
    return F.greatest(F.lit(SAMPLE_BYTES), F.floor(size / 2) - SAMPLE_BYTES // 2)


def measure(path: Column, content: Column, size: Column, tier: Column, kind: Column, tokenizer: Tokenizer = count, second: Column | None = None) -> Column:
    """struct(tokens, estimated, head) of a file's BINARY content; null content is an unreadable file.

    For a file that is sampled, ``content`` may be its first sample only if ``second`` is the other.
    """
    skipped = (kind == "binary") | kinds.is_minified(path) | content.isNull()
    whole = is_exact(path, size, tier, kind)
    other = F.substring(content, middle_at(size).cast("int") + 1, F.lit(SAMPLE_BYTES)) if second is None else F.coalesce(second, F.lit(b""))
    head = _text(F.substring(content, 1, SAMPLE_BYTES))
    sample = F.concat(head, _text(other))
    n = tokenizer(sample)
    rate = F.octet_length(sample) / n
    guess = F.when((n == 0) | (F.octet_length(sample) == 0), F.lit(0)).otherwise(F.floor(size / rate + 0.5)).cast("long")
    text = _text(content)
    tokens = F.when(skipped, F.lit(0).cast("long")).when(whole, tokenizer(text)).otherwise(guess)
    first = F.when(skipped, F.lit("")).when(whole, F.substring(text, 1, HEAD_CHARS)).otherwise(F.substring(head, 1, HEAD_CHARS))
    return F.struct(tokens.alias("tokens"), (skipped | ~whole).alias("estimated"), first.alias("head"))


def _text(content: Column) -> Column:
    """UTF-8, with invalid bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))
