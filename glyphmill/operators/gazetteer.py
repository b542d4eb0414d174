"""Matching of misspelled place names against a gazetteer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import nfc, trim_spaces

#: Keywords that name the level of what follows (fixed values).
PROVINCE_KEYWORDS = ["Thành phố", "Thành Phố", "TP", "Tỉnh"]
DISTRICT_KEYWORDS = ["Quận", "Huyện", "Thị xã", "Thị Xã", "TX"]
WARD_KEYWORDS = ["Phường", "Xã", "Thị trấn", "Thị Trấn", "TT"]
RATIO, PROVINCE_RATIO, SHORTEST = 0.35, 0.3, 2
#: Edits within which names are looked for by their pieces.
NEAR = 2
#: Marks between the pieces of a text.
_CUT, _GAP = "\u0001", "\u0002"


def keyword_pattern(keywords: Sequence[str]) -> str:
    """Java pattern: a keyword at the start or after white space or a comma, white space after it, any case."""
    longest = sorted(keywords, key=len, reverse=True)
    return r"(?iU)(?:^|(?<=[\s,]))(" + "|".join(rf"\Q{k}\E" for k in longest) + r")\s+"


def is_address_like(text: Column) -> Column:
    return F.coalesce(text.rlike(keyword_pattern([*PROVINCE_KEYWORDS, *DISTRICT_KEYWORDS, *WARD_KEYWORDS])), F.lit(False))


def normalize_name(name: Column) -> Column:
    return F.lower(nfc(trim_spaces(name)))


def trailing_segment(text: Column) -> Column:
    """What follows the last comma, stripped; null without a comma."""
    return F.when(F.contains(text, F.lit(",")), trim_spaces(F.substring_index(text, ",", -1)))


def _letters(text: str) -> Column:
    """64 bits: whether a text has letters of each of 32 kinds at all, and twice. An edit sets and clears one bit at most."""
    slot = "pmod(ascii(c), 32)"
    bit = f"shiftleft(1L, cast({slot} + 32 * (shiftright(a, {slot}) & 1L) AS int))"
    return F.expr(f"aggregate(split(`{text}`, ''), 0L, (a, c) -> a | {bit})")


def _pieces(most: Column, length: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of `most` + 1 pieces into which a name of a length is cut, the shorter ones first."""
    each, longer = F.floor(length / (most + 1)), length % (most + 1)
    return i * each + F.greatest(F.lit(0), i - (most + 1 - longer)), each + F.when(i >= most + 1 - longer, 1).otherwise(0)


def _near_pairs(e: DataFrame, n: DataFrame, entity: str, scope: str | None, ratio: float, within: int | None) -> DataFrame:
    """`e` joined to the names (_name, _ord) that are at most `within` edits (None: any number) and `ratio` of the longer length away, with _dist.

    Pairs that meet have their letters (`_has`, `_letters`) compared, of which an edit changes one, before Levenshtein is run.
    """
    scoped = [] if scope is None else [scope]
    tasks = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * e.sparkSession.sparkContext.defaultParallelism)  # few bytes, but much work
    met = _by_length(e, n, entity, scoped, ratio, tasks) if within is None else _by_pieces(e, n, entity, scoped, ratio, within, tasks)
    longer = F.greatest(F.length(entity), F.length("_name"))
    most = F.floor(longer * ratio + 1e-9) if within is None else F.least(F.lit(within).cast("long"), F.floor(longer * ratio + 1e-9))
    alike = [F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b))) <= most for a, b in (("_has", "_letters"), ("_letters", "_has"))]
    dist = F.levenshtein(F.col(entity), F.col("_name")) if within is None else F.levenshtein(F.col(entity), F.col("_name"), within)
    met = met.filter(alike[0] & alike[1]).withColumn("_dist", F.explode(F.array(dist)))  # as a generator, so that conditions on it don't run it again
    return met.filter((F.col("_dist") >= 0) & (F.col("_dist") <= most) & (F.col("_dist") / longer <= ratio))


def _by_length(e: DataFrame, n: DataFrame, entity: str, scoped: list[str], ratio: float, tasks: int) -> DataFrame:
    """Each text beside the names of all lengths that `ratio` lets it reach; texts of a length are dealt over several tasks, to each of which its names go."""
    low, high = F.ceil(F.length(entity) * (1 - ratio) - 1e-9), F.floor(F.length(entity) / (1 - ratio) + 1e-9)
    e = e.withColumn("_long", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), low), high)))
    on, turns = ["_long", "_turn", *scoped], min(64, tasks)
    e = e.withColumn("_turn", F.pmod(F.xxhash64(entity), F.lit(turns))).repartition(tasks, *on)
    n = n.withColumn("_long", F.length("_name").cast("long")).withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))
    return e.join(n, on)


def _by_pieces(e: DataFrame, n: DataFrame, entity: str, scoped: list[str], ratio: float, within: int, tasks: int) -> DataFrame:
    """Each text beside names that share a piece with it; a pair may meet more than once.

    A name is cut into one piece more than edits are allowed, so one piece of it stands unchanged in every text that near, and not
    farther from its place than the edits before and behind it can move it. Names are indexed by (allowed edits,
    length, piece number, piece); a text is looked up by its substrings at those places.
    """
    edits = lambda longer: F.least(F.lit(within).cast("long"), F.floor(longer * ratio + 1e-9))
    place, own, mine = [F.col("_most"), F.col("_long"), F.col("_i")], F.length("_name").cast("long"), F.length(entity).cast("long")
    n = n.withColumn("_long", own).withColumn("_most", F.explode(F.sequence(edits(own), edits(F.floor(own / (1 - ratio) + 1e-9))))).filter("_most > 0")
    n = n.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most"))))
    start, size = _pieces(*place)
    n = n.withColumn("_key", F.xxhash64(*scoped, *place, F.substr("_name", start + 1, size))).drop("_long", "_most", "_i", *scoped)
    low = F.greatest(F.ceil(mine * (1 - ratio) - 1e-9), mine - within)
    high = F.least(F.floor(mine / (1 - ratio) + 1e-9), mine + within)
    e = e.withColumn("_long", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), low), high)))
    e = e.withColumn("_most", edits(F.greatest(mine, "_long"))).filter((F.col("_most") > 0) & (F.abs(mine - F.col("_long")) <= F.col("_most")))
    e = e.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most"))))
    off, rest = mine - F.col("_long"), F.col("_most") - F.col("_i")
    first = F.greatest(F.lit(0).cast("long"), start - F.col("_i"), start + off - rest)
    last = F.least(mine - size, start + F.col("_i"), start + off + rest)
    e = e.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last").withColumn("_at", F.explode(F.sequence("_first", "_last")))
    e = e.withColumn("_key", F.xxhash64(*scoped, *place, F.substr(F.col(entity), F.col("_at") + 1, size)))
    return e.select(entity, "_has", *scoped, "_key").repartition(tasks, "_key").join(n, "_key")


def fuzzy_match(entities: DataFrame, names: DataFrame, key: str, entity: str, name: str, scope: str | None = None, ratio: float = RATIO, ordinal: str = "ord", shortest: int = SHORTEST, near: int = NEAR) -> DataFrame:
    """key, best, dist: for each entity the name with the fewest edits among those within
    edits <= ratio * longer length; ties go to the smaller ordinal. Entities that are names stay out.

    With `scope` (a column of both sides) names are matched within it. Each distinct entity of a scope is matched
    once. Names at most `near` edits away are found by an index of their pieces, which are long and rare; only entities
    without any such name, which is then the best one, meet all names of the lengths that `ratio` allows.
    """
    own = [entity] if scope is None else [entity, scope]
    e = entities.select(*own).distinct().join(names.select(F.col(name).alias("_known")).distinct(), F.col(entity) == F.col("_known"), "left_anti")
    e = e.filter(F.length(entity) >= shortest).withColumn("_has", _letters(entity))
    n = names.select(*own[1:], F.col(name).alias("_name"), F.col(ordinal).alias("_ord")).withColumn("_letters", _letters("_name"))
    least = F.min(F.struct("_dist", "_ord", "_name")).alias("b")
    best = _near_pairs(e, n, entity, scope, ratio, near).groupBy(*own).agg(least)
    rest = e.join(best.select(*own), own, "left_anti")
    best = best.unionAll(_near_pairs(rest, n, entity, scope, ratio, None).groupBy(*own).agg(least))
    best = entities.select(key, *own).join(best, own).groupBy(key).agg(F.min("b").alias("b"))  # a key may be repeated
    return best.select(key, F.col("b._name").alias("best"), F.col("b._dist").alias("dist"))


def gazetteer(provinces: DataFrame, districts: DataFrame, wards: DataFrame) -> DataFrame:
    """scope, name (normalised), ord, original of every name that a keyword can stand before.

    `provinces`: name, ord; the others: name, province, ord. Scopes: P, D and W for the levels, D|province
    and W|province for the names inside one, X for provinces and then districts.
    """
    norm = normalize_name(F.col("name")).alias("name")
    level = lambda rows, scope: rows.select(scope.alias("scope"), norm, F.col("ord").cast("long").alias("ord"), F.col("name").alias("original"))
    inside = lambda letter: F.concat(F.lit(f"{letter}|"), normalize_name(F.col("province")))
    behind = districts.withColumn("ord", F.col("ord") + (1 << 40))
    parts = [level(provinces, F.lit("P")), level(districts, F.lit("D")), level(wards, F.lit("W")), level(districts, inside("D")), level(wards, inside("W")), level(provinces, F.lit("X")), level(behind, F.lit("X"))]
    return reduce(DataFrame.unionAll, parts)


def place_names(texts: DataFrame) -> DataFrame:
    """text, place, mark, rest, entity of every keyword in distinct texts: what stands behind it up to the next
    keyword, and the name that it begins with, up to a comma or anything that is written like a keyword."""
    words = [*PROVINCE_KEYWORDS, *DISTRICT_KEYWORDS, *WARD_KEYWORDS]
    marked = F.regexp_replace("text", keyword_pattern(words).removesuffix(r"\s+") + r"(\s+)", f"{_CUT}$1$2{_GAP}")
    pieces = texts.select("text", F.posexplode(F.split(marked, _CUT)).alias("place", "piece"))
    parts = F.split("piece", _GAP)
    pieces = pieces.select("text", "place", F.when(F.col("place") > 0, parts[0]).alias("mark"), F.when(F.col("place") > 0, parts[1]).otherwise(F.col("piece")).alias("rest"))
    stop = "|".join([",", *(rf"\Q{k}\E" for k in sorted(words, key=len, reverse=True))])
    return pieces.withColumn("entity", F.when(F.col("place") > 0, trim_spaces(F.regexp_extract("rest", rf"(?s)^(.*?)(?:{stop}|$)", 1))))


def own_provinces(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text, province (normalised): the province that a text's last segment names or nearly names."""
    tail = F.regexp_replace(trailing_segment(F.col("text")), "^" + keyword_pattern([*PROVINCE_KEYWORDS, *DISTRICT_KEYWORDS, *WARD_KEYWORDS]), "")
    tails = texts.filter(F.length(trailing_segment(F.col("text"))) >= SHORTEST).select("text", normalize_name(tail).alias("tail")).filter("tail <> ''")
    known = names.filter("scope = 'P'").groupBy("name").agg(F.min("ord").alias("ord"))
    exact = tails.join(known.select(F.col("name").alias("tail")), "tail", "left_semi").select("text", F.col("tail").alias("province"))
    near = fuzzy_match(tails, known, "text", "tail", "name", ratio=PROVINCE_RATIO, shortest=1).select("text", F.col("best").alias("province"))
    return exact.unionAll(near)


def correct_addresses(df: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """`df` with `corrected`: each misspelled name behind a keyword replaced by the closest of its level.

    `names`: a `gazetteer`. Keywords are found in any case, but name a level only as they are written in
    the lists; behind others provinces and districts are searched. Districts and wards are those of the
    text's own province, if it has one that has any. Names that the gazetteer holds, those shorter than SHORTEST and those without a
    close name stay, and so do texts without keyword, or with the control characters U+0001 and U+0002.
    """
    own = F.col("text")
    asked = is_address_like(own) & ~own.rlike(f"[{_CUT}{_GAP}]")
    texts = df.select(F.col(text).alias("text")).distinct().withColumn("_asked", F.explode(F.array(asked))).filter("_asked").drop("_asked")  # generated, so that only distinct texts are looked at
    found = place_names(texts).join(own_provinces(texts, names), "text", "left")
    word = trim_spaces(F.col("mark"))
    letter = F.when(word.isin(PROVINCE_KEYWORDS), "P").when(word.isin(DISTRICT_KEYWORDS), "D").when(word.isin(WARD_KEYWORDS), "W").otherwise("X")
    inner = names.filter("scope LIKE '_|%'").select(F.col("scope").alias("_inner"), F.lit(True).alias("_has")).distinct()
    found = found.withColumn("scope", letter).join(inner, F.concat_ws("|", "scope", "province") == F.col("_inner"), "left")
    found = found.withColumn("scope", F.when(F.col("_has") & F.col("scope").isin("D", "W"), F.col("_inner")).otherwise(F.col("scope")))
    found = found.select("text", "place", "mark", "rest", "entity", "scope", normalize_name(F.col("entity")).alias("norm"))
    asked = found.filter(F.length("entity") >= SHORTEST).select("scope", "norm", F.concat_ws(_CUT, "scope", "norm").alias("_key")).distinct()
    best = fuzzy_match(asked, names, "_key", "norm", "name", scope="scope").join(asked, "_key").select("scope", "norm", F.col("best").alias("name"))
    first = names.groupBy("scope", "name").agg(F.min_by("original", "ord").alias("original"))
    best = best.join(first, ["scope", "name"]).select("scope", "norm", "original")
    rest = F.when(F.col("original").isNotNull(), F.concat("original", F.expr("substring(rest, length(entity) + 1)"))).otherwise(F.col("rest"))
    pieces = found.join(best, ["scope", "norm"], "left").select("text", "place", F.concat(F.coalesce("mark", F.lit("")), rest).alias("piece"))
    whole = pieces.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"))  # bounded by the text
    whole = whole.select(own.alias("_text"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("corrected"))
    return df.join(whole, F.col(text) == F.col("_text"), "left").withColumn("corrected", F.coalesce("corrected", F.col(text))).drop("_text")


def correct_trailing(df: DataFrame, provinces: DataFrame, text: str, name: str = "norm", original: str = "name") -> DataFrame:
    """`df` with `corrected`: the segment after the last comma replaced by the closest province name.

    Left as they are: texts without a comma, segments that start with a keyword, are too short or valid. Of provinces
    with one name the first, by ordinal and then as written, gives its original.
    """
    keywords = keyword_pattern([*PROVINCE_KEYWORDS, *DISTRICT_KEYWORDS, *WARD_KEYWORDS])
    raw = trailing_segment(F.col(text))
    tail = F.lower(nfc(raw))
    fits = (F.length(tail) >= SHORTEST) & ~raw.rlike(keywords.replace(r"(?:^|(?<=[\s,]))", "^"))
    rows = df.withColumn("_tail", F.when(fits, tail))
    asked = rows.select("_tail", F.col("_tail").alias("_key")).filter("_tail IS NOT NULL").distinct()
    best = fuzzy_match(asked, provinces, "_key", "_tail", name)
    first = provinces.groupBy(F.col(name).alias("best")).agg(F.min(F.struct("ord", original))[original].alias("_best"))
    best = best.join(first, "best").select(F.col("_key").alias("_tail"), "_best")
    head = F.regexp_replace(text, ",[^,]*$", "")
    out = rows.join(best, "_tail", "left").withColumn("corrected", F.when(F.col("_best").isNotNull(), F.concat(head, F.lit(", "), F.col("_best"))).otherwise(F.col(text)))
    return out.select(*df.columns, "corrected")
