"""Sentences for synthesis: extraction, quality, splitting, templates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import SPACES, bound, collapse_spaces, nfc, trim_spaces

SHORTEST, LONGEST = 8, 200
#: Break points of long sentences, strongest first (fixed values).
BREAKS = [
    r",\s+", r"\s+và\s+", r"\s+hoặc\s+", r"\s+nhưng\s+", r"\s+cũng\s+như\s+", r"\s+trong\s+đó\s+", r"\s+bao\s+gồm\s+",
    r"\s+ngoài\s+ra\s+", r";\s+", r"\s*-\s+", r"\s+do\s+", r"\s+với\s+", r"\s+theo\s+",
]


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def raw_sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, part_no, sentence: lines that are no headings, templates or tables, cut behind . ! ?, references and spaces cleaned.

    Lines and parts are cleaned before they are exploded: a filter on a column that is computed
    afterwards would be pushed below it and compute it once per condition.
    """
    cleaned = F.transform(F.split(text, "\n"), trim_spaces)
    lines = docs.select(key, F.posexplode(cleaned).alias("line_no", "_line"))
    lines = lines.filter((F.col("_line") != "") & ~F.col("_line").rlike(r"^(?:==|\{\{|\|)"))
    parts = F.transform(F.split("_line", rf"(?U)(?<=[.!?])[{SPACES}]+"), lambda p: collapse_spaces(F.regexp_replace(p, r"\[[0-9]+\]", "")))
    return lines.select(key, "line_no", F.posexplode(parts).alias("part_no", "sentence"))


def has_non_ascii(text: Column, least: int = 2) -> Column:
    return text.rlike(rf"(?s)(?:[^\x00-\x7F][\x00-\x7F]*+){{{least}}}")


def good_sentence(text: Column) -> Column:
    """Length, at least 2 non-ASCII characters, at most 3 of either parenthesis, 30 % letters; cheap tests first."""
    return (
        F.length(text).between(SHORTEST, LONGEST) & has_non_ascii(text) & (occurrences(text, "(") <= 3) & (occurrences(text, ")") <= 3)
        & (letters(text) >= F.length(text) * 0.3)
    )


def extract_sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, part_no, sub_no, sentence: good sentences; overlong ones as the good parts between commas."""
    raw = raw_sentences(docs, key, text)
    long = F.length("sentence") > LONGEST
    pieces = F.when(long, F.transform(F.split("sentence", rf"(?U),[{SPACES}]+"), trim_spaces)).otherwise(F.array("sentence"))
    out = raw.select(key, "line_no", "part_no", long.alias("_long"), F.posexplode(pieces).alias("sub_no", "sentence"))
    part = F.length("sentence").between(SHORTEST, LONGEST) & has_non_ascii(F.col("sentence"))
    return out.filter(F.when(F.col("_long"), part).otherwise(good_sentence(F.col("sentence")))).drop("_long")


def joined_parts(parts: Column, joiner: str, longest: int) -> Column:
    """Neighbouring parts joined from the left for as long as they fit; what stays shorter than SHORTEST goes."""

    def step(done: Column, part: Column) -> Column:
        fits = (done["last"] != "") & (F.length(done["last"]) + len(joiner) + F.length(part) <= longest)
        before = F.when(fits, done["before"]).otherwise(F.array_append(done["before"], done["last"]))
        return F.struct(before.alias("before"), F.when(fits, F.concat_ws(joiner, done["last"], part)).otherwise(part).alias("last"))

    start = F.struct(F.array().cast("array<string>").alias("before"), F.get(parts, 0).alias("last"))
    every = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), start, step, lambda done: F.array_append(done["before"], done["last"]))
    return F.filter(every, lambda s: F.length(s) >= SHORTEST)


def pack_segments(text: Column, longest: int) -> Column:
    """Array of segments of each sentence, `longest` characters at most: the text itself if it is that short, else
    parts between the strongest break points that leave only parts that fit, joined by commas; else words.

    Empty parts go, but for one before a break point at the very start, after which the next part begins
    a segment of its own. A text without any segment of SHORTEST characters gives its first characters.
    """

    def between(pattern: str) -> Column:
        pieces = F.transform(F.split(text, f"(?U){pattern}"), trim_spaces)
        parts = F.filter(pieces, lambda p, i: (i == 0) | (p != ""))
        fit = lambda found: F.when((F.size(found) > 0) & F.forall(found, lambda s: F.length(s) <= longest), found)
        word = max(re.split(r"\\s[*+]", pattern), key=len)  # looked for first, which is much faster
        return F.when(F.contains(text, F.lit(word)) & text.rlike(f"(?U){pattern}"), bound(parts, lambda p: bound(joined_parts(p, ", ", longest), fit)))

    words = bound(F.array_remove(F.split(text, rf"(?U)[{SPACES}]+"), ""), lambda w: joined_parts(w, " ", longest))
    by_words = bound(words, lambda found: F.when(F.size(found) > 0, found))
    return F.when(F.length(text) <= longest, F.array(text)).when(text.isNotNull(), F.coalesce(*map(between, BREAKS), by_words, F.array(F.substring(text, 1, longest))))


def clean_corpus(sentences: DataFrame, text: str, order: str, longest: int, shortest: int = 5) -> DataFrame:
    """Distinct sentences in order of first occurrence, long ones split, distinct again: sentence, `order`, seg_no."""
    s = sentences.select(nfc(trim_spaces(F.col(text))).alias("sentence"), order).filter(F.length("sentence") >= shortest)
    s = s.groupBy("sentence").agg(F.min(order).alias(order))
    out = s.select(order, F.posexplode(pack_segments(F.col("sentence"), longest)).alias("seg_no", "sentence"))
    out = out.withColumn("sentence", trim_spaces(F.col("sentence"))).filter(F.length("sentence").between(shortest, longest))
    first = F.min(F.struct(order, "seg_no")).alias("_at")
    return out.groupBy("sentence").agg(first).select("sentence", f"_at.{order}", "_at.seg_no")


def choice(values: Sequence[str], *keys: Column) -> Column:
    """One of the values, picked by a hash of the keys (the same in every run)."""
    return F.element_at(F.array(*map(F.lit, values)), (hash_number(len(values), *keys) + 1).cast("int"))


def hash_number(n: int, *keys: Column) -> Column:
    """0 to n - 1 from the first 15 hex digits of the md5 of the keys' text."""
    digits = F.substring(F.md5(F.concat(*[k.cast("string") for k in keys])), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(n))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Template with {name} replaced by each value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template
