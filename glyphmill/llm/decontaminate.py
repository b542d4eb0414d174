"""Benchmark decontamination over a distributed positional inverted index. DataFrame functions only.

Every benchmark window needs all its words at fixed distances, so a document can only hold it where the
window's rarest words line up. The corpus is read for the counts of benchmark words, then for the stored
postings (text, word, position) of each window's rarest words; subtracting a word's place in the item from
its position gives an alignment, and alignments that enough rare words agree on are verified word by
word against the whole text. Texts of so few different words that alignments would outnumber their words are
looked through window by window instead, with the same result. Windows that an item repeats are looked for once, so that repeated words do not
multiply alignments. Tables that come from the benchmark are broadcast only after their rows and bytes have
been counted and found small; otherwise Spark joins them by shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphmill.llm.shared import drop_stored, fresh, small, store

#: Words of a window, rarest words of a window whose postings are intersected.
WINDOW, RAREST = 10, 2
#: Anchors that a row's postings meet on the average before the row is looked through by whole windows instead.
DENSE = 32
#: What parts words: all of ASCII but digits and (lower-cased) letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. The fast lower() serves texts in which it changes nothing else."""
    return F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Array of words of a text; empty for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")


def row_key(docs: DataFrame, text: str = "text") -> Column:
    """What postings know a row by: its id and text. Copies with other ids stay apart, whose words would else be
    counted together; rows that share a key share alignments, and are verified each by itself."""
    return F.xxhash64(docs["doc_id"], F.coalesce(docs[text], F.lit("")))


def positions(docs: DataFrame, text: str = "text") -> DataFrame:
    """key, pos, term of every word; rows without words vanish."""
    return docs.select(row_key(docs, text).alias("key"), F.posexplode(words(F.col(text))).alias("pos", "term"))


def item_table(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored table of the segments of distinct items that have words: item_key, item_id, words, w (words of a window).

    A segment is as many words in a row as windows start in that the item did not have before: every
    window of the item is in just one segment, and only once.
    """
    out = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    key = F.sha2(F.to_json(F.struct("item_id", "words")), 256)
    out = store(out.select(key.alias("item"), "item_id", "words", F.least(F.lit(window), F.size("words")).alias("w")), "items")
    starts = out.select("item", "words", "w", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("w"))).alias("s"))
    first = starts.groupBy("item", F.concat_ws(" ", F.slice("words", F.col("s") + 1, F.col("w"))).alias("phrase")).agg(F.min("s").alias("s"))
    island = first.select("item", "s", (F.col("s") - F.row_number().over(W.partitionBy("item").orderBy("s"))).alias("island"))  # one benchmark item a group
    ends = island.groupBy("item", "island").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    cut = F.slice("words", F.col("a") + 1, F.col("b") - F.col("a") + F.col("w"))
    return store(out.join(ends, "item").select(F.concat_ws("-", "item", "a").alias("item_key"), "item_id", cut.alias("words"), "w"), "segments")


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Stored table of the corpus frequency of each benchmark word (words that never occur are left out)."""
    terms = small(store(items.select(F.explode("words").alias("term")).distinct(), "terms"))
    return store(positions(docs).select("term").join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("freq")), "freq")


def anchors(items: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """Stored table item_key, term, q (place in the item), need: the rarest words of every window that can occur."""
    placed = items.select("item_key", "w", F.posexplode("words").alias("q", "term")).join(small(counts), "term", "left")
    arr = F.array_sort(F.collect_list(F.struct("q", "term", F.coalesce("freq", F.lit(0)).alias("freq"))))
    per_item = placed.groupBy("item_key", "w").agg(arr.alias("a"))
    starts = F.sequence(F.lit(1), F.size("a") - F.col("w") + 1)
    ranked = F.transform(starts, lambda s: F.array_sort(F.transform(F.slice("a", s, F.col("w")), lambda x: F.struct(x["freq"].alias("freq"), x["q"].alias("q"), x["term"].alias("term")))))
    alive = F.filter(ranked, lambda r: r[0]["freq"] > 0)
    best = F.array_distinct(F.flatten(F.transform(alive, lambda r: F.slice(r, 1, rarest))))
    out = per_item.select("item_key", F.least(F.lit(rarest), F.col("w")).alias("need"), F.explode(best).alias("x"))
    return store(out.select("item_key", F.col("x.term").alias("term"), F.col("x.q").alias("q"), "need"), "anchors")


def postings(docs: DataFrame, rare: DataFrame) -> DataFrame:
    """Stored table key, term, pos: the index of the corpus for the words of `anchors`."""
    terms = small(store(rare.select("term").distinct(), "rare-terms"))
    return store(positions(docs).join(terms, "term").select("key", "term", "pos"), "postings")


def candidates(index: DataFrame, rare: DataFrame) -> DataFrame:
    """key, item_key, diags: alignments on which enough rare words of an item agree."""
    lists = index.join(small(rare), "term").select("key", "item_key", "need", (F.col("pos") - F.col("q")).alias("diag"))
    agreed = lists.groupBy("key", "item_key", "diag", "need").agg(F.count(F.lit(1)).alias("n")).filter("n >= need")
    return agreed.groupBy("key", "item_key").agg(F.collect_list("diag").alias("diags"))  # no more than the text's words and the item's


def dense_rows(index: DataFrame, rare: DataFrame) -> DataFrame:
    """Stored table key of the rows whose postings meet over DENSE times their number of anchors: few different words, many alignments.

    Counted from the postings and anchors of each word, before any of them meet.
    """
    many = rare.groupBy("term").agg(F.count(F.lit(1)).alias("anchors"))
    lists = index.groupBy("key", "term").agg(F.count(F.lit(1)).alias("n")).join(small(store(many, "anchor-counts")), "term")
    work = lists.groupBy("key").agg(F.sum(F.col("n") * F.col("anchors")).alias("work"), F.sum("n").alias("n"))
    return store(work.filter(F.col("work") > F.lit(DENSE) * F.col("n")).select("key"), "dense")


def window_matches(docs: DataFrame, items: DataFrame, dense: DataFrame) -> DataFrame:
    """Stored table key, found: what occurs in the rows of `dense`, by whole windows. A row is as many windows of each length as it has words."""
    windows = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("w"))).alias("s"), "words")
    windows = windows.select("item_id", "w", F.concat_ws(" ", F.slice("words", F.col("s") + 1, F.col("w"))).alias("phrase"))
    lengths = sorted(r[0] for r in items.select("w").distinct().collect())  # WINDOW at most
    rows = docs.withColumn("key", row_key(docs)).join(small(dense), "key", "left_semi").select("key", words(F.col("text")).alias("words")).dropDuplicates(["key"])
    spots = [
        rows.filter(F.size("words") >= w).select("key", F.lit(w).alias("w"), "words", F.explode(F.sequence(F.lit(0), F.size("words") - w)).alias("start")).select("key", "w", "start", F.concat_ws(" ", F.slice("words", F.col("start") + 1, w)).alias("phrase"))
        for w in lengths
    ]
    met = reduce(DataFrame.unionAll, spots).join(windows, ["w", "phrase"])
    return store(met.groupBy("key").agg(F.collect_list(F.struct("item_id", "start", "w")).alias("found")), "windows")


def _starts(c: Column, diag: Column, text_words: Column) -> Column:
    """Places in a candidate's segment at which a whole window equals the document, when aligned at `diag`."""
    same = F.transform(c["words"], lambda x, q: F.coalesce(F.get(text_words, q + diag) == x, F.lit(False)))
    runs = F.sequence(F.lit(0), F.size(c["words"]) - c["w"])
    return F.filter(runs, lambda s: F.forall(F.slice(same, s + 1, c["w"]), lambda x: x))


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """Every row of `docs` (doc_id, text and more) with two more columns at the end: the number of its
    words, and what was found as an array of struct(item_id, start, w).

    `start` is the document word at which an occurring window begins, `w` its words. Items without
    words never match, null texts have no words. Rows are judged each on its own text, whatever ids they have.
    """
    items = item_table(items, window)
    plain = docs.select("doc_id", "text")
    rare = anchors(items, term_counts(plain, items), rarest)
    key, cand, n, found = fresh(docs, "_key", "_cand", "_n_words", "_found")
    index = postings(plain, rare)
    dense = dense_rows(index, rare)
    crowded = not dense.isEmpty()
    pairs = store(candidates(index.join(small(dense), "key", "left_anti") if crowded else index, rare), "candidates")
    drop_stored(index)
    pairs = pairs.join(small(items), "item_key")
    lists = store(pairs.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("item_id", "words", "w", "diags")).alias(cand)), "aligned")
    out = docs.join(small(lists), row_key(docs) == lists[key], "left").drop(key)
    whole = F.lit(None)
    if crowded:
        key, whole_ = fresh(out, key, "_whole")
        by_window = window_matches(plain, items, dense).select(F.col("key").alias(key), F.col("found").alias(whole_))
        out, whole = out.join(small(by_window), row_key(docs) == by_window[key], "left").drop(key), F.col(whole_)

    def ranges(w: Column) -> Column:
        def one(c: Column, diag: Column) -> Column:
            return F.transform(_starts(c, diag, w), lambda s: F.struct(c["item_id"].alias("item_id"), (s + diag).alias("start"), c["w"].alias("w")))

        return F.flatten(F.transform(cand, lambda c: F.flatten(F.transform(c["diags"], lambda diag: one(c, diag)))))

    text_words = words(F.col("text"))
    once = F.element_at(F.transform(F.array(text_words), ranges), 1)  # the words as a variable: a filter on the result would else split texts once per word
    kind = "array<struct<item_id:string,start:int,w:int>>"
    empty = F.array().cast(kind)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.size(text_words).cast("long").alias(n), F.coalesce(whole.cast(kind), F.when(F.col(cand).isNull(), empty).otherwise(once)).alias(found))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` in which no window of an item occurs. All columns stay."""
    out = phrase_matches(docs, items, window)
    return out.filter(F.size(out.columns[-1]) == 0).drop(*out.columns[-2:])


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 20, terms: int = 3) -> DataFrame:
    """doc_id, item_id, end: places where an item's `terms` rarest words all occur, in any order, within `slop` words.

    Items with fewer words need all they have; items holding a word that no document has never match.
    """
    items = item_table(items, window=1 << 30)
    rare = anchors(items, term_counts(docs, items), terms)
    lists = postings(docs, rare).join(small(rare), "term").select("key", "item_key", "need", "q", "pos")
    near = W.partitionBy("key", "item_key").orderBy("pos").rangeBetween(-slop, 0)
    hit = lists.withColumn("_near", F.size(F.collect_set("q").over(near))).filter("_near >= need")
    hit = hit.join(small(items.select("item_key", "item_id")), "item_key").select("key", "item_id", F.col("pos").alias("end")).distinct()
    return docs.select("doc_id", row_key(docs).alias("key")).join(hit, "key").select("doc_id", "item_id", "end").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs`.

    n_hit: words inside any occurring window. items_sha256: of the comma-joined ids, sorted as strings,
    of items with occurring windows (items without id count as hits but are not listed).
    """
    out = phrase_matches(docs.select("doc_id", "text"), items, window, rarest)
    hits = F.size(F.array_distinct(F.flatten(F.transform("_found", lambda x: F.sequence(x["start"], x["start"] + x["w"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("_found", lambda x: x["item_id"]), lambda i: i.isNotNull())))
    out = out.select("doc_id", F.col("_n_words").alias("n_words"), hits.cast("long").alias("n_hit"), ids.alias("_ids"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
