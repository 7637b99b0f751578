"""Column functions on strings, arrays and numbers; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def chars(text: Column) -> Column:
    """The code points of a string; the empty string has none."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Words between runs of white space, as word error rate counts them."""
    return F.array_remove(F.split(F.trim(text), r"\s+"), "")


def strip(text: Column) -> Column:
    """Both ends without any white space, not just spaces."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def zero_fill(number: Column, width: int) -> Column:
    """Leading zeros up to `width`; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def clock(seconds: Column) -> Column:
    """H:MM:SS of floored seconds, hours without padding or bound."""
    whole = F.floor(seconds).cast("long")
    part = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(":", F.floor(whole / 3600).cast("string"), part(F.floor(F.pmod(whole, F.lit(3600)) / 60)), part(F.pmod(whole, F.lit(60))))


def argmax(values: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def collapse(ids: Column) -> Column:
    """Runs of equal neighbours become one."""
    return F.filter(ids, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(ids, i - 1)))


def drop_blank(ids: Column, blank: int = 0) -> Column:
    return F.filter(ids, lambda x: x != blank)


def best_path(frames: Column, length: Column | None = None, ratio: int = 1) -> Column:
    """Argmax of each valid frame, collapsed, then without blanks."""
    valid = frames if length is None else F.slice(frames, F.lit(1), F.floor(length / ratio).cast("int"))
    return drop_blank(collapse(F.transform(valid, argmax)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value computed once: inside a lambda a plain expression is computed anew for each element."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def over_total(values: Column) -> Column:
    return let(values, lambda v: let(total(v), lambda t: F.transform(v, lambda x: x / t)))


def softmax(values: Column) -> Column:
    return let(F.array_max(values), lambda top: over_total(F.transform(values, lambda x: F.exp(x - top))))


def smooth(probs: Column, alpha: float = 1e-6) -> Column:
    """Mix with the uniform distribution and make the sum 1 again."""
    return let(probs, lambda p: over_total(F.transform(p, lambda x: x * (1 - alpha) + F.lit(alpha) / F.size(p))))


def pad(values: Column, size: Column | int) -> Column:
    """Zeros on the right up to a length; longer arrays stay."""
    missing = F.greatest(F.lit(0), (F.lit(size) if isinstance(size, int) else size) - F.size(values))
    return F.concat(values, F.array_repeat(F.lit(0.0), missing.cast("int")))


def ctc_least(label_length: Column, ratio: int) -> Column:
    """Time steps that a label needs at least: two a token, before downsampling."""
    return label_length * 2 * ratio


def downsampled(length: Column, ratio: int = 8) -> Column:
    return F.floor(length / ratio).cast("long")


def row_max_norm(values: Column, eps: float = 1e-6) -> Column:
    """Values over the largest magnitude of the row."""
    return let(F.array_max(F.transform(values, F.abs)), lambda top: F.transform(values, lambda x: x / (top + eps)))


def z_array(values: Column, eps: float = 1e-6) -> Column:
    """Array form of the z-score, population deviation."""
    def scaled(mean: Column) -> Column:
        spread = F.sqrt(total(F.transform(values, lambda x: (x - mean) * (x - mean))) / F.size(values))
        return let(spread + eps, lambda s: F.transform(values, lambda x: (x - mean) / s))

    return let(total(values) / F.size(values), scaled)


def learning_rate(step: Column, per_epoch: int, epochs: int, warmup: int, base: float) -> Column:
    """Linear from 0.01 to 1 times `base` over the warm-up steps, then a cosine to zero."""
    warm = per_epoch * warmup
    rest = max(1, per_epoch * (epochs - warmup))
    rising = F.lit(0.01) + F.lit(0.99) * step / max(1, warm)
    falling = F.lit(0.5) * (1 + F.cos(F.lit(3.141592653589793) * F.least(step - warm, F.lit(rest)) / rest))
    return F.when(step < warm, rising).otherwise(falling) * base


def step_due(step: Column, every: int, last: int) -> Column:
    """Whether a step is a multiple of `every` or the last one; never if `every` is not positive."""
    return ((F.pmod(step, F.lit(every)) == 0) | (step == last)) if every > 0 else F.lit(False)


def invert(mapping: Column) -> Column:
    """A one-to-one map with keys and values exchanged."""
    return F.map_from_entries(F.transform(F.map_entries(mapping), lambda e: F.struct(e["value"], e["key"])))


def word_points(reference: Column, hypothesis: Column) -> tuple[Column, Column]:
    """Two word lists as strings of one code point a word, so that levenshtein counts word edits.

    Points start at U+0100 and stay below the surrogates: a pair may have up to
    about 55,000 different words; beyond that the expression raises.
    """
    def points(words: Column, vocabulary: Column) -> Column:
        hexed = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + 255), 4, "0"))
        few = F.assert_true(F.size(vocabulary) <= 55000, F.lit("a pair has over 55,000 different words")).isNull()
        return F.when(few, F.decode(F.unhex(F.array_join(hexed, "")), "UTF-16BE"))

    vocabulary = F.array_distinct(F.concat(reference, hypothesis))
    return let(vocabulary, lambda v: points(reference, v)), let(vocabulary, lambda v: points(hypothesis, v))
