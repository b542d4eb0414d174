"""Texts and items of few different words: equal to brute force, with work in proportion to the text."""

import random
import time

from pyspark.sql import functions as F

from glyphmill.llm import decontaminate


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w = (t or "").lower().split()
        hit, found = set(), set()
        for item, x in items:
            x = x.lower().split()
            n = min(window, len(x))
            wins = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)} if n else set()
            at = [s for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in wins]
            hit |= {p for s in at for p in range(s, s + n)}
            found |= {item} if at else set()
        out.append((i, len(w), len(hit), len(found)))
    return sorted(out)


def test_two_words(spark):
    r = random.Random(8)
    two = lambda n: " ".join(r.choices("ab", k=n))
    items = [(1, two(300)), (2, two(12)), (3, "a b a"), (4, two(9)), (5, " ".join(r.choices("cdefgh", k=40)))]
    docs = [(i, two(r.randint(0, 400))) for i in range(12)] + [(20, items[4][1] + " " + two(50)), (21, " ".join(r.choices("cdefgh", k=300))), (22, None), (1, two(30)), (1, two(30))]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = decontaminate.contamination(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_hit"], x["n_items"]) for x in got) == brute(docs, items)
    index = decontaminate.item_table(frame(items, "item_id"))
    rare = decontaminate.anchors(index, decontaminate.term_counts(frame(docs, "doc_id"), index))
    assert decontaminate.dense_rows(decontaminate.postings(frame(docs, "doc_id"), rare), rare).count() > 5  # the other way was taken


def test_a_long_text_of_two_words_is_cheap(spark):
    r = random.Random(9)
    two = lambda n: " ".join(r.choices("ab", k=n))
    docs, items = spark.createDataFrame([(1, two(20_000))], "doc_id long, text string"), spark.createDataFrame([(1, two(300))], "item_id long, text string")
    run = lambda d: decontaminate.contamination(d, items).collect()
    run(docs.withColumn("text", F.substring("text", 1, 100)))
    began = time.perf_counter()
    (row,) = run(docs)
    assert row["n_words"] == 20_000 and row["contaminated"] and time.perf_counter() - began < 25
    print(time.perf_counter() - began)
