"""Error rates of predictions, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.text import SPACES, bound, has_hallucination, trim_spaces


def edits(ref: Column, pred: Column) -> Column:
    """Character edits between the trimmed texts."""
    return F.levenshtein(trim_spaces(ref), trim_spaces(pred))


def cer(ref: Column, pred: Column) -> Column:
    """Character error rate, not held to 1. Two empty texts: 0; only the reference empty: 1."""
    r, p = trim_spaces(ref), trim_spaces(pred)
    empty = F.when(p == "", 0.0).otherwise(1.0)
    return F.when(r == "", empty).otherwise(F.levenshtein(r, p) / F.length(r))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"(?U)[{SPACES}]+"), "")


#: Code points below surrogates and above, and the first that is used for words.
_SURROGATES, _SKIPPED, _FIRST, _LAST = 0xD800, 0x800, 0x20, 0x10FFFF


def word_index(words: Column) -> Column:
    """Distinct words dealt by hash into about as many lists as each then holds words."""
    lists = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(words))).cast("int"))
    return F.transform(F.sequence(F.lit(0), lists - 1), lambda i: F.filter(words, lambda w: F.pmod(F.xxhash64(w), lists) == i))


def word_letter(word: Column, index: Column) -> Column:
    """The word's own character: its list and its place there, numbered together."""
    lists = F.size(index).cast("long")
    at = F.pmod(F.xxhash64(word), lists).cast("int")
    code = F.lit(_FIRST) + (F.array_position(F.get(index, at), word) - 1) * lists + at
    code = F.when(code < _SURROGATES, code).otherwise(code + _SKIPPED)
    code = F.when(code <= _LAST, code).otherwise(F.raise_error(F.lit("more distinct words in a pair of texts than there are characters")).cast("long"))
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def token_letters(words: Column, index: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: word_letter(w, index)), "")


def word_edits(ref: Column, pred: Column) -> Column:
    """Word edits, as character edits over a private alphabet (up to some hundred thousand distinct words in a pair, then an error)."""
    both = F.struct(tokens(ref).alias("r"), tokens(pred).alias("p"))

    def edits_of(x: Column) -> Column:
        index = bound(F.array_union(x["r"], x["p"]), word_index)
        return bound(index, lambda i: F.levenshtein(token_letters(x["r"], i), token_letters(x["p"], i)))

    return F.when(ref.isNotNull() & pred.isNotNull(), bound(both, edits_of))


def wer(ref: Column, pred: Column, edits_: Column | None = None) -> Column:
    """Word error rate, not held to 1; `edits_`: the word edits, where they are known already."""
    n = F.size(tokens(ref))
    empty = F.when(F.size(tokens(pred)) == 0, 0.0).otherwise(1.0)
    return F.when(n == 0, empty).otherwise((word_edits(ref, pred) if edits_ is None else edits_) / F.greatest(n, F.lit(1)))


def error_category(ref: Column, pred: Column, rate: Column, hallucinated: Column | None = None) -> Column:
    """PERFECT, HALLUCINATION_LOOP, TRUNCATION, INSERTION, SUBSTITUTION or MINOR_ERROR, first that fits."""
    r, p = F.greatest(F.length(ref), F.lit(1)), F.length(pred)
    return (
        F.when(rate == 0, "PERFECT")
        .when(has_hallucination(pred) if hallucinated is None else hallucinated, "HALLUCINATION_LOOP")
        .when(p < 0.3 * r, "TRUNCATION")
        .when((p > 2.0 * r) & (r > 3), "INSERTION")
        .when(rate > 0.3, "SUBSTITUTION")
        .otherwise("MINOR_ERROR")
    )


def cer_bin(rate: Column) -> Column:
    return F.when(rate == 0, "0").when(rate <= 0.05, "(0,0.05]").when(rate <= 0.15, "(0.05,0.15]").when(rate <= 0.3, "(0.15,0.3]").otherwise(">0.3")
