"""What the named queries share: table access, SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.sources.readers import spread


#: Tables of long texts, and their columns, which are worth dealing over all cores.
_LONG = {"documents": "text", "conversations": "text", "pages": "html"}


#: Rows of a task where each text is much work.
HEAVY = 4096


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str, rows: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*cols) if cols else df
    return spread(df, rows) if _LONG.get(name) in df.columns else df


#: White space of any kind, for SQL engines whose \s is ASCII only.
SPACES = r"[\t-\r\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: SQL of the normalised label of a column `text`, '' where nothing is left.
LABEL = rf"nfc_normalize(regexp_replace(regexp_replace(text, '{SPACES}', ' ', 'g'), '^ | $', '', 'g'))"
ASCII_LABEL = rf"regexp_replace({LABEL}, '[^ -~]', '?', 'g')"
#: Characters of words, for engines whose \\w is ASCII only.
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]"


def hallucinated(key: str, text: str, rows: str) -> str:
    """SQL of key, hallucinated over `rows`: repeats without back-references.

    A character four times in a row; or a token that the token before ends with and the token behind
    begins with, at word boundaries, or without any word character.
    """
    return rf"""
  WITH chars AS (SELECT {key}, unnest(string_split({text}, '')) AS c, generate_subscripts(string_split({text}, ''), 1) AS i FROM {rows}),
  runs AS (SELECT DISTINCT {key} FROM (SELECT {key}, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3 FROM chars WINDOW w AS (PARTITION BY {key} ORDER BY i)) WHERE c <> chr(10) AND c = c1 AND c = c2 AND c = c3),
  tokens AS (SELECT {key}, unnest(regexp_split_to_array({text}, '{SPACES}')) AS x, generate_subscripts(regexp_split_to_array({text}, '{SPACES}'), 1) AS i FROM {rows}),
  near AS (SELECT {key}, x, lag(x) OVER w AS a, lead(x) OVER w AS b FROM tokens WHERE x <> '' WINDOW w AS (PARTITION BY {key} ORDER BY i)),
  ends AS (
    SELECT *, regexp_matches(left(x, 1), '{_WORD}') AS first_word, regexp_matches(right(x, 1), '{_WORD}') AS last_word,
      regexp_matches(right(left(a, length(a) - length(x)), 1), '{_WORD}') AS word_before, regexp_matches(substring(b, length(x) + 1, 1), '{_WORD}') AS word_behind
    FROM near WHERE ends_with(a, x) AND starts_with(b, x)),
  loops AS (SELECT DISTINCT {key} FROM ends WHERE (first_word <> word_before AND last_word <> word_behind) OR NOT regexp_matches(x, '{_WORD}'))
  SELECT {key}, {key} IN (SELECT {key} FROM runs) OR {key} IN (SELECT {key} FROM loops) AS hallucinated FROM {rows}"""
