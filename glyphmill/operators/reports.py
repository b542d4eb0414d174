"""Aggregates and reports over predictions and sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.ranking import ranged_rank


def bin_label(value: Column, edges: Sequence[int]) -> Column:
    """[low,high) of a value between rising edges, >=last beyond, null below the first."""
    out = F.when(value >= edges[-1], f">={edges[-1]}")
    for low, high in zip(edges, edges[1:]):
        out = out.when((value >= low) & (value < high), f"[{low},{high})")
    return out


def rates(df: DataFrame, group: str) -> DataFrame:
    """Per group and over all (group null) in one pass: n, micro and macro CER and WER, perfect share.

    Needs the columns edits, ref_len, cer, word_edits, ref_words, wer.
    """
    share = lambda a, b: F.round(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 6)
    return df.groupingSets([[group], []], group).agg(
        F.count(F.lit(1)).alias("n"), share("edits", "ref_len").alias("cer_micro"), F.round(F.avg("cer"), 6).alias("cer_macro"),
        share("word_edits", "ref_words").alias("wer_micro"), F.round(F.avg("wer"), 6).alias("wer_macro"),
        F.count_if(F.col("cer") == 0).alias("perfect"), F.round(100 * F.count_if(F.col("cer") == 0) / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("perfect_pct"),
    )


def tally(before: Column, after: Column) -> list[Column]:
    """Counts of rows that a step helped, hurt and left alone."""
    return [F.count_if(after < before).alias("helped"), F.count_if(after > before).alias("hurt"), F.count_if(after == before).alias("neutral")]


def category_map(df: DataFrame, group: str, category: str) -> DataFrame:
    """group, categories: map from category to count."""
    counts = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "n")))).alias("categories"))


def summary_json(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """group, summary: JSON object of the values."""
    return df.select(group, F.to_json(F.struct(*values)).alias("summary"))


def markdown_table(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """One row `report`: a Markdown table of a small (top-k) result in order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return df.agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["l"]), "\n")).alias("report"))


def places(value: Column | str, digits: int) -> Column:
    """A number as text with so many places, null for null; halves are those of the binary value, exact ones go to the even digit, as in C."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    half = float(f"5e-{digits + 1}")  # the one value that Java's format takes for an exact half though it is none
    out = F.call_function("format_number", value, F.lit(f"0.{'0' * digits}"))
    return F.when(value == half, f"{half:.{digits}f}").when(value == -half, f"{-half:.{digits}f}").otherwise(out)


def percent(value: Column) -> Column:
    """A share as text of a percentage with one place."""
    return F.concat(places(value * 100, 1), F.lit("%"))


def bar(share: Column, width: int = 50) -> Column:
    """A share as a bar of blocks, `width` of them for all."""
    return F.repeat(F.lit("█"), F.floor(share * width).cast("int"))


def timing_line(steps: Sequence[tuple[str, Column]]) -> Column:
    """One line of the steps' seconds and their total; null if one is."""
    parts = [F.concat(F.lit(f"{name}: "), places(seconds, 2), F.lit("s")) for name, seconds in steps]
    total = F.concat(F.lit("**Total: "), places(sum((seconds for _, seconds in steps), F.lit(0.0)), 2), F.lit("s**"))
    return F.concat(*[c for part in parts for c in (part, F.lit(" │ "))], total)


def listing(df: DataFrame, by: Sequence[str], order: Sequence[Column], line: Column) -> DataFrame:
    """by, place (from 1), line: the lines of each group's listing in `order`, which has to tell rows apart where their place matters.

    Ranges of a group are ranked apart (`ranged_rank`), so that no task holds a whole group.
    """
    rows = df.withColumn("line", line)
    return ranged_rank(rows, by, order, "place").select(*by, "place", "line")
