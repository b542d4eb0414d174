"""Column functions on label texts. All are built-in expressions but `nfc`."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode ranges that labels may use (fixed values).
ALLOWED_RANGES = [
    (0x0009, 0x000A), (0x0020, 0x007E), (0x00A0, 0x00FF), (0x0100, 0x017F), (0x0180, 0x024F),
    (0x0300, 0x036F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x2070, 0x209F), (0x20A0, 0x20CF),
]
#: Script families of characters outside the ranges, first match wins (fixed values).
SCRIPTS = [
    ("CJK", 0x4E00, 0x9FFF), ("CJK", 0x3400, 0x4DBF), ("Khmer", 0x1780, 0x17FF), ("Thai", 0x0E00, 0x0E7F), ("Cyrillic", 0x0400, 0x04FF),
    ("Japanese", 0x3040, 0x30FF), ("Arabic", 0x0600, 0x06FF), ("IPA", 0x0250, 0x02AF), ("Fullwidth", 0xFF00, 0xFFEF),
]
#: White space of any kind, as the body of a class under (?U): Unicode's, and U+001C to U+001F. (Listing
#: Unicode's by code point instead makes patterns several times slower.)
SPACES = r"\s\x1c-\x1f"
#: Repetition patterns (fixed values): character runs, word runs, punctuation runs, short runs at the end.
CHAR_RUN, WORD_RUN = r"(?Ud)(.)\1{3,}", rf"(?U)\b([^{SPACES}]+)(?:[{SPACES}]+\1){{2,}}\b"
MARK_RUN, END_RUN = rf"(?U)([^\w{SPACES}]+)(?:[{SPACES}]+\1){{2,}}", rf"(?U)([{SPACES}]+[^{SPACES}]{{1,4}})\1{{2,}}[{SPACES}]*$"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once: inside a lambda it would be computed for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _to_nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Marked so that a filter on a normalised label is not pushed below it, which would normalise twice.
_nfc = F.pandas_udf(_to_nfc, StringType()).asNondeterministic()


def nfc(text: Column) -> Column:
    """NFC. Only texts with characters from U+0300 on, which alone can change, are sent to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x{02FF}]"), text)), text)


def trim_spaces(text: Column) -> Column:
    """Strip white space of any kind from both ends."""
    return F.regexp_replace(text, rf"(?U)^[{SPACES}]+|[{SPACES}]++$", "")


def collapse_spaces(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U)[{SPACES}]+", " "))


def normalize_label(text: Column) -> Column:
    """Strip, collapse white space, NFC; null where nothing is left."""
    return F.nullif(nfc(collapse_spaces(text)), F.lit(""))


def with_label(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """`df` with its text replaced by the normalised label.

    Each step is exploded from an array of one: a generated column is computed once, where filters on a
    projected one are pushed below the projection and compute it once per condition.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    df = df.select(*kept, F.explode(F.array(collapse_spaces(F.col(text)))).alias("_collapsed"))
    return df.select(*kept, F.explode(F.array(F.nullif(nfc(F.col("_collapsed")), F.lit("")))).alias(label))


def char_class(ranges: list[tuple[int, int]]) -> str:
    """Body of a regular-expression class of code-point ranges; ranges that touch are one."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        merged = [*merged[:-1], (merged[-1][0], max(merged[-1][1], b))] if merged and a <= merged[-1][1] + 1 else [*merged, (a, b)]
    ranges = merged
    return "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in ranges)


def foreign_chars(text: Column, ranges: list[tuple[int, int]] | None = None) -> Column:
    """Array of the characters outside the ranges, in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(f"[^{char_class(ranges or ALLOWED_RANGES)}]"), F.lit(0))


def is_allowed(text: Column, ranges: list[tuple[int, int]] | None = None) -> Column:
    """Whether all characters are in the ranges. Latin-1 runs are matched by a class of their own, which is the fast kind."""
    ranges = ranges or ALLOWED_RANGES
    low = [(a, min(b, 0xFF)) for a, b in ranges if a <= 0xFF]
    high = [(max(a, 0x100), b) for a, b in ranges if b > 0xFF]
    runs = "|".join(f"[{char_class(part)}]++" for part in (low, high) if part)
    return text.rlike(rf"\A(?:{runs})*+\z")


def script_family(char: Column) -> Column:
    """Script family of one character, U+XXXX where it has none."""
    code = F.ascii(char)
    out = F.concat(F.lit("U+"), F.lpad(F.hex(code), 4, "0"))
    out = F.when(code > 0xFFFF, F.concat(F.lit("U+"), F.hex(code))).otherwise(out)
    for name, low, high in reversed(SCRIPTS):
        out = F.when(code.between(low, high), F.lit(name)).otherwise(out)
    return out


def script_families(chars: Column) -> Column:
    """Distinct families of an array of characters, sorted, joined by +."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(chars, script_family))), "+")


def sanitize(text: Column) -> Column:
    """Collapse hallucinated repeats: characters to 3, words and marks to 2, short ends away, spaces to 1."""
    out = F.regexp_replace(text, CHAR_RUN, "$1$1$1")
    out = F.regexp_replace(out, WORD_RUN, "$1 $1")
    out = F.regexp_replace(out, MARK_RUN, "$1 $1")
    out = F.regexp_replace(out, END_RUN, "")
    out = trim_spaces(F.regexp_replace(out, rf"(?U)[{SPACES}]{{2,}}", " "))
    return F.when(~text.rlike(rf"(?U)[^{SPACES}]"), text).otherwise(out)


def has_hallucination(text: Column) -> Column:
    return F.coalesce(text.rlike(CHAR_RUN) | text.rlike(WORD_RUN) | text.rlike(MARK_RUN), F.lit(False))


def skip_token(token: Column) -> Column:
    """Tokens that a language-model corrector leaves alone: no letters or digits, single, numeric, short capitals."""
    clean = F.replace(token, F.lit("_"), F.lit(""))
    letters = F.regexp_replace(clean, r"[^\p{L}]", "")
    short_capitals = (F.length(letters) > 0) & (F.length(letters) <= 5) & letters.rlike(r"^\p{Lu}+$")
    return (F.length(clean) <= 1) | ~clean.rlike(r"[\p{L}\p{N}]") | clean.rlike(r"^[\p{Nd}.,\-/]+$") | short_capitals


def reattach_punctuation(original: Column, corrected: Column) -> Column:
    """Take out the spaces that word segmentation put around punctuation, judged by the original."""
    out = F.regexp_replace(corrected, r"(?U)\s+([)\]}>,.;:!?%])", "$1")
    out = F.regexp_replace(out, r"(?U)([(\[{<])\s+", "$1")
    for mark in ("-", "/", "–", "—"):
        tight = F.contains(original, F.lit(mark)) & ~F.contains(original, F.lit(f" {mark} "))
        out = F.when(tight, F.regexp_replace(out, rf"(?U)\s+{mark}\s+", mark)).otherwise(out)
    out = trim_spaces(F.regexp_replace(out, r"(?U)\s{2,}", " "))
    return F.when((original == "") | (corrected == ""), corrected).otherwise(out)


def desegment(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def safe_label(text: Column, length: int = 10) -> Column:
    """First characters with everything but letters and digits as _ (for file names)."""
    return F.regexp_replace(F.substring(text, 1, length), r"[^\p{L}\p{N}]", "_")


def decode_tokens(ids: Column, vocabulary: Column, special: list[int]) -> Column:
    """Text of token ids: special ids dropped, word-start mark as a space, line mark as a newline."""
    tokens = F.transform(F.filter(ids, lambda i: ~i.isin(special)), lambda i: F.get(vocabulary, i))
    return trim_spaces(F.replace(F.replace(F.array_join(tokens, ""), F.lit("Ġ"), F.lit(" ")), F.lit("Ċ"), F.lit("\n")))


def document_id(stem: Column) -> Column:
    """File stem without a trailing _number."""
    return F.regexp_replace(stem, r"_[0-9]+$", "")


def crop_document_id(stem: Column) -> Column:
    """File stem up to the first _crop."""
    return F.substring_index(stem, "_crop", 1)


def image_name(name: Column, prefix: str | None = None) -> Column:
    """File name with the ending .png and, unless it is there, a prefix."""
    out = F.regexp_replace(name, r"\.[^.]+$", ".png")
    return out if prefix is None else F.when(out.startswith(prefix), out).otherwise(F.concat(F.lit(prefix), out))


def source_tag(source: Column) -> Column:
    """Tag of a handwriting subset in file names: its prefix in short (fixed values)."""
    return F.replace(source, F.lit("UIT_HWDB_"), F.lit("uit_"))


def utf8(text: Column) -> Column:
    """Bytes of a text as they are stored in samples; `F.decode` gives the text back."""
    return F.encode(text, "UTF-8")
