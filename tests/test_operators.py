import math
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import corpus as C
from glyphmill.operators import gazetteer as G
from glyphmill.operators import quality as Q
from glyphmill.operators import sampling as S
from glyphmill.operators.ranking import bucketed_rank, range_bucket, ranged_rank
from glyphmill.operators.split import determined_split, split_groups, split_rows


@pytest.mark.parametrize("n, sizes", [(10, (8, 1, 1)), (11, (8, 1, 2)), (5796, (4636, 580, 580)), (1, (0, 0, 1))])
def test_split_sizes(spark, n, sizes):
    df = split_rows(spark.range(n), "id")
    found = {r["final_split"]: r["count"] for r in df.groupBy("final_split").count().collect()}
    assert tuple(found.get(s, 0) for s in ("train", "val", "test")) == sizes
    held = math.ceil(n * 0.2)
    assert sum(sizes[1:]) == held and df.select("id").distinct().count() == n


def test_groups_never_straddle(spark):
    df = spark.range(500).withColumn("writer", F.col("id") % 37)
    out = split_groups(df, "writer")
    assert out.groupBy("writer").agg(F.count_distinct("final_split").alias("n")).filter("n > 1").count() == 0 and out.count() == 500


def test_determined(spark):
    rows = [("train", "1"), ("train_pool", "229"), ("train_pool", "230"), ("train_pool", "249"), ("train_pool", "250"), ("train_pool", "abc"), ("odd", "1"), ("train_pool", None)]
    df = spark.createDataFrame(rows, "p string, w string")
    assert [r[0] for r in df.select(determined_split(F.col("p"), F.col("w"))).collect()] == ["train", "train", "val", "val", "train", "train", "unresolved", "train"]


def test_bucketed_rank_matches_window(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2))
    out = bucketed_rank(df, ["g"], [F.col("id")], F.floor(F.col("id") / 100), total="n").toPandas()
    for _, part in out.groupby("g", dropna=False):
        assert list(part.sort_values("id").rn) == list(range(1, len(part) + 1)) and set(part.n) == {len(part)}


@pytest.mark.parametrize("share", [0.0, 0.95])
def test_ranged_rank_under_skew(spark, share):
    """Bounds follow the rows: with one first key in most of them no bucket has over twice the median."""
    df = spark.range(40_000, numPartitions=4).select(F.when(F.col("id") % 100 < 100 * share, 7).otherwise(F.col("id") % 1009).alias("v"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"))
    df = df.withColumn("v", F.when(F.col("k") % 50 == 0, F.lit(None)).otherwise(F.col("v")))
    sizes = df.groupBy(range_bucket(df, [F.col("v"), F.col("k")], buckets=32).alias("b")).count().toPandas()["count"]
    assert len(sizes) == 32 and sizes.max() <= 2 * sizes.median()
    out = ranged_rank(df, [], [F.col("v"), F.col("k")], total="n").toPandas().sort_values("rn")
    assert list(out.rn) == list(range(1, 40_001)) and set(out.n) == {40_000}
    keys = [(v if v == v else -1, k) for v, k in zip(out.v, out.k)]
    assert keys == sorted(keys)
    assert "Join" not in ranged_rank(df, ["v"], [F.col("k")])._jdf.queryExecution().executedPlan().toString()


def test_ranges_of_other_types(spark):
    rows = [(None, "a", 1.5), ("x", None, 2.0), ('"', "b", float("nan")), ("x", "é", -0.0), ("x", "é", 0.5)] * 3
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, s string, d double, _bucket long")
    out = ranged_rank(df, ["g"], [F.col("s"), F.col("d"), F.col("_bucket")], total="n", buckets=4).toPandas()
    assert sorted(zip(out.g.fillna("").astype(str), out.rn, out.n)) == sorted([("", i, 3) for i in (1, 2, 3)] + [('"', i, 3) for i in (1, 2, 3)] + [("x", i, 9) for i in range(1, 10)])
    assert ranged_rank(df.limit(0), ["g"], [F.col("s")]).count() == 0


def test_drop_reason_order(spark):
    rows = [("漢", False, None, None), ("a", False, None, None), ("a", True, None, None), ("a", True, 9, 20), ("a", True, 20, 301), ("a", True, 20, 100), ("a", True, 600, 20), ("a", True, 50, 20)]
    df = spark.createDataFrame(rows, "l string, f boolean, w int, h int")
    got = [r[0] for r in df.select(Q.drop_reason(F.col("l"), F.col("f"), F.col("w"), F.col("h"), Q.WORD_LIMITS)).collect()]
    assert got == ["language", "missing_file", "corrupt", "width_small", "height_large", "aspect_low", "aspect_high", None]


PROVINCES, DISTRICTS, WARDS = ["Hà Nội", "Đà Nẵng"], [("Ba Đình", "Hà Nội"), ("Hải Châu", "Đà Nẵng"), ("Hải An", "Đà Nẵng")], [("Đồng Mai", "Hà Nội"), ("Nam Dương", "Đà Nẵng")]


ADDRESSES = [
    ("Quận Ba Đinh, Hà Nội", "Quận Ba Đình, Hà Nội"), ("Phường Đồng Mai, Quận Hải Chau, Đà Nẵn", "Phường Đồng Mai, Quận Hải Châu, Đà Nẵn"),
    ("no keyword here", "no keyword here"), ("", ""), ("quận Ba Đinh", "quận Ba Đình"), ("Tỉnh Da Nẵng", "Tỉnh Đà Nẵng"), ("Quận X", "Quận X"),
]


def test_addresses(spark):
    rows = lambda names: spark.createDataFrame([(n, p, i) for i, (n, p) in enumerate(names)], "name string, province string, ord int")
    names = G.gazetteer(rows([(n, None) for n in PROVINCES]), rows(DISTRICTS), rows(WARDS))
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate([*ADDRESSES, *ADDRESSES, (None, None), ("Quận \u0001Ba Đinh", None)])], "i int, t string, place string")
    got = {r["i"]: r["corrected"] for r in G.correct_addresses(df, names, "t").collect()}
    assert [got[i] for i in range(len(ADDRESSES))] == [w for _, w in ADDRESSES] == [got[i + len(ADDRESSES)] for i in range(len(ADDRESSES))]
    assert got[2 * len(ADDRESSES)] is None and got[2 * len(ADDRESSES) + 1] == "Quận \u0001Ba Đinh" and len(got) == 2 * len(ADDRESSES) + 2


def test_address_query_reaches_all_levels(spark, sf):
    from glyphmill.plans import corpus

    read = {t: [r.asDict() for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()] for t in ("region", "nation", "supplier", "customer")}
    provinces = [r["r_name"] for r in sorted(read["region"], key=lambda r: r["r_regionkey"])]
    of = {r["r_regionkey"]: r["r_name"] for r in read["region"]}
    nations = sorted(read["nation"], key=lambda r: r["n_nationkey"])
    districts, wards = [(r["n_name"], of[r["n_regionkey"]]) for r in nations], []
    for n in nations:
        wards += [(s["s_name"], of[n["n_regionkey"]]) for s in sorted(read["supplier"], key=lambda s: s["s_suppkey"]) if s["s_nationkey"] == n["n_nationkey"]][:1]

    def edits(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i, j in ((i, j) for i in range(1, len(a) + 1) for j in range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return d[len(a), len(b)]

    def closest(name, pool, ratio=0.35):
        near = [(d, i) for i, n in enumerate(pool) if (d := edits(name.lower(), n.lower())) <= ratio * max(len(name), len(n))]
        return pool[min(near)[1]] if near else name

    def inside(level, province):
        return [n for n, p in level if p == province] or [n for n, _ in level]

    memo = {}

    def want(key):
        district, ward, large = f"NATIOM_{key % 30}", wards[key // 3 % len(wards)][0].replace("pp", "p"), provinces[key // 3 % len(provinces)].replace("I", "L").replace("O", "Q")
        if (spec := (key % 3, district, ward, large)) not in memo:
            province = closest(large, provinces, 0.3) if key % 3 else None
            d = closest(district, inside(districts, province))
            full = closest(ward, inside(wards, province)), d, closest(large, provinces)
            memo[spec] = [f"Quận {d}, REGION", "Phường {}, Huyện {}, Tỉnh {}".format(*full), "12 Street, Xã {}, Thị xã {}, Thành phố {}".format(*full)][key % 3]
        return memo[spec]

    got = {r["c_custkey"]: r["corrected"] for r in corpus.address_correction(spark, sf).collect()}
    assert got == {r["c_custkey"]: want(r["c_custkey"]) for r in read["customer"]}
    assert all(any(f"{word} {n}" in t for t in got.values()) for word, names in (("Phường", wards), ("Xã", wards), ("Huyện", districts)) for n in [names[0][0]])
    assert any("Tỉnh AFRICA" in t for t in got.values()) and any("Thành phố AFRICA" in t for t in got.values())


def test_trailing_province(spark):
    names = spark.createDataFrame([("hà nội", "Hà Nội", 0), ("đà nẵng", "Đà Nẵng", 1)], "norm string, name string, ord int")
    df = spark.createDataFrame([(0, "a, Đà Vưỡng"), (1, "a, Đà Nẵn"), (2, "a"), (3, "a, Hà Nội"), (4, "a, TP Hà Nộ"), (5, None)], "k int, t string")
    got = {r["k"]: r["corrected"] for r in G.correct_trailing(df, names, "t").collect()}
    assert got == {0: "a, Đà Vưỡng", 1: "a, Đà Nẵng", 2: "a", 3: "a, Hà Nội", 4: "a, TP Hà Nộ", 5: None}


def test_fuzzy_ties_go_to_the_first_name(spark):
    names = spark.createDataFrame([("abcd", 1), ("abce", 0)], "name string, ord int")
    df = spark.createDataFrame([(0, "abcx"), (1, "abcd"), (2, "a"), (3, "zzzz")], "k int, e string")
    assert [tuple(r) for r in G.fuzzy_match(df, names, "k", "e", "name").collect()] == [(0, "abce", 1)]


def test_pack_segments(spark):
    long = "một hai ba bốn năm, sáu bảy tám chín mười; mười một mười hai và mười ba mười bốn"
    cases = [
        (long, 60, ["một hai ba bốn năm", "sáu bảy tám chín mười; mười một mười hai và mười ba mười bốn"]),
        (long, 59, ["một hai ba bốn năm, sáu bảy tám chín mười", "mười một mười hai và mười ba mười bốn"]),  # behind a semicolon: nothing stronger fits
        (long, 40, ["một hai ba bốn năm, sáu bảy tám chín", "mười; mười một mười hai và mười ba mười"]),  # words; a rest of three characters goes
        ("aaaaaaaa, bbbb, cccccccc, d", 14, ["aaaaaaaa, bbbb", "cccccccc, d"]), (", aaaaaaaa, bbbbbbbb", 10, ["aaaaaaaa", "bbbbbbbb"]),
        ("short", 40, ["short"]), ("x" * 100, 40, ["x" * 100]), ("a b c d e f g h", 10, ["a b c d e"]), ("abc " * 30, 10, ["abc abc ab"]), ("", 10, [""]), (None, 10, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string")
    got = df.select("i", *[C.pack_segments(F.col("t"), n).alias(str(n)) for n in sorted({n for _, n, _ in cases})]).collect()
    assert [r[str(cases[r["i"]][1])] for r in got] == [cases[r["i"]][2] for r in got]


def test_pseudo_lines_use_every_sample_once(spark):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("b"), F.concat(F.lit("w"), "id").alias("label"))
    out = S.pseudo_lines(df, ["b"], "id", "label", 0.3, 2, 4).toPandas()
    assert sorted(" ".join(out.label).split()) == sorted(f"w{i}" for i in range(100)) and out.words.max() <= 4
    alone = S.pseudo_lines(df, ["b"], "id", "label", 1.0, 2, 4).toPandas()
    assert set(alone.words) == {1}


def test_mixed_batches_wrap(spark):
    out = S.mixed_batches(spark.range(20), spark.range(100, 106), "id", 8, 0.7).toPandas()
    sizes = out.groupby(["batch_no", "pool"]).size().unstack()
    assert list(sizes["first"]) == [5] * 4 and list(sizes["second"]) == [3] * 4


def test_trailing_province_of_equal_names(spark):
    """Two provinces that are equal once normalised: one address in, one row out, with the first one's spelling."""
    names = spark.createDataFrame([("hanoi", "HaNoi", 2), ("hanoi", "Hanoi", 1), ("hue", "Hue", 3)], "norm string, name string, ord int")
    df = spark.createDataFrame([(1, "x, Hanoy"), (1, "x, Hanoy"), (None, "y, Hanoy"), (3, None)], "k int, t string")
    assert sorted(map(str, (tuple(r) for r in G.correct_trailing(df, names, "t").collect()))) == sorted(map(str, [(1, "x, Hanoy", "x, Hanoi")] * 2 + [(None, "y, Hanoy", "y, Hanoi"), (3, None, None)]))


@pytest.mark.parametrize("ratio, near", [(0.35, 2), (0.5, 4)])
def test_fuzzy_index_finds_what_all_pairs_find(spark, ratio, near):
    """Equal to Levenshtein over all pairs: names from one letter on, hot pieces, ties, two scopes."""
    r = random.Random(int(ratio * 100))
    word = lambda a, n: "".join(r.choices(a, k=n))
    names = [word("abc", r.randint(1, 9)) for _ in range(60)] + ["prefix prefix " + word("0123", 5) for _ in range(40)] + [word("abcdefghijé", r.randint(8, 40)) for _ in range(60)]

    def bent(s):
        s = list(s)
        for _ in range(r.randint(1, max(1, int(0.4 * len(s))))):
            at = r.randrange(len(s) + 1)
            s[at : at + r.randint(0, 1)] = r.choice(["", word("abcx01", 1)])
        return "".join(s)

    names = [(n, r.choice("PD"), i) for i, n in enumerate(names)]
    asked = [(i, bent(r.choice(names)[0]), r.choice("PD")) for i in range(400)]
    n, e = spark.createDataFrame(names, "name string, s string, ord int"), spark.createDataFrame(asked, "k int, e string, s string")
    pairs = e.filter("length(e) >= 2").join(n.drop("s").withColumnRenamed("ord", "o"), F.lit(True)).filter(F.levenshtein("e", "name") / F.greatest(F.length("e"), F.length("name")) <= ratio)
    known = {x[0] for x in names}
    want = {x["k"]: (x["b"]["name"], x["b"]["d"]) for x in pairs.groupBy("k", "e").agg(F.min(F.struct(F.levenshtein("e", "name").alias("d"), "o", "name")).alias("b")).collect() if x["e"] not in known}
    got = {x["k"]: (x["best"], x["dist"]) for x in G.fuzzy_match(e, n, "k", "e", "name", ratio=ratio, near=near).collect()}
    assert got == want and len(want) > 150
    inside = e.filter("length(e) >= 2").join(n.withColumnRenamed("ord", "o"), "s").filter(F.levenshtein("e", "name") / F.greatest(F.length("e"), F.length("name")) <= ratio)
    want = {x["k"]: x["b"]["name"] for x in inside.groupBy("k", "e").agg(F.min(F.struct(F.levenshtein("e", "name").alias("d"), "o", "name")).alias("b")).collect() if x["e"] not in known}
    assert {x["k"]: x["best"] for x in G.fuzzy_match(e, n, "k", "e", "name", scope="s", ratio=ratio, near=near).collect()} == want


def test_addresses_are_looked_at_once_each(spark, tmp_path):
    """Keywords are searched in distinct addresses, not in every row's, and rows of one file are dealt over tasks."""
    import os
    import re

    from glyphmill.plans import corpus

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    for t in ("region", "nation", "supplier"):
        os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.range(1, 2_000_001).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = corpus.address_correction(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "RLIKE" in line for line in plan.splitlines())
    assert any(int(n) == 31 for n in re.findall(r"RoundRobinPartitioning\((\d+)\)", df._jdf.queryExecution().toString()))
