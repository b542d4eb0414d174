"""The training-data operators against brute force, libraries and edge cases."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import connect, difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphmill.llm import bwt, decontaminate, language, near_copies, packing, quality, queries, sharding, simhash, suffix_dedup, token_count, topk, url_filter
from glyphmill.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, seeds long, _spans int"


def documents(spark, rows):
    """Rows (doc_id, text) with extra columns whose names clash with ones the operators use."""
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, 2) for i, t in rows], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


P = words(60, 99)
EDGE = [(1, None), (2, ""), (3, "  \n "), (4, words(300, 4)), (5, words(300, 4)), (6, words(200, 6) + P), (7, P + words(150, 7)), (8, "One two"), (9, "one  TWO"), (9, "one  TWO"),
        (None, words(300, 4)), (None, None), (10, words(20_000, 10)), (11, "é" * 80), (12, "a" * 500), (13, "a" * 300), (14, words(300, 4).replace(" ", "  ", 1)), (15, "<|endoftext|> x <|endoftext|>")]


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, sf, name):
    mine = queries.queries()[name](spark, sf).toPandas()
    assert not difference(mine, connect(sf).execute(queries.oracle_sql()[name]).df())


# 1 ------------------------------------------------------------------ top k


def brute_top_k(rows, k):
    ok = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in {i: v for i, v in sorted(ok, key=lambda r: list(r[1]), reverse=True) if i % 50 == 0}.items():
        best = sorted((-int(x @ v), i) for i, v in ok if i != q and len(v) == len(x))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block, per_round", [(4096, 8192), (50, 3)])
def test_top_k(spark, block, per_round):
    r = np.random.default_rng(1)
    centers = r.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + 0.1 * r.normal(size=8)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (None, rows[0][1]), (550, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, v int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block=block, queries=per_round).collect()
    assert {tuple(g) for g in got} == brute_top_k(rows, 5)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_dual_search_prunes(monkeypatch):
    r = np.random.default_rng(4)
    centers = np.floor(200 * r.normal(size=(20, 16)))
    x = np.concatenate([np.floor(c + 5 * r.normal(size=(100, 16))) for c in centers])
    q, seen = np.floor(x[::10] + 1), []
    trees = topk.cover_tree(q, leaf=4), topk.cover_tree(x, leaf=16)
    real = topk.bound
    monkeypatch.setattr(topk, "bound", lambda a, b: seen.append(1) or real(a, b))
    best, asked = topk.Best(np.full(len(q), -np.inf), 3), -1 - np.arange(len(q))
    topk.dual_search(q, asked, best, x, np.arange(len(x)), trees)
    own, ids, score = best.rows(asked)
    want = {(-1 - i, int(j), int((q[i] @ x[j]))) for i in range(len(q)) for j in np.lexsort((np.arange(len(x)), -(x @ q[i])))[:3]}
    assert set(zip(own.tolist(), ids.tolist(), score.tolist())) == want
    leaves = lambda n: sum(map(leaves, n.children)) if n.children else 1
    assert len(seen) < 0.5 * leaves(trees[0]) * leaves(trees[1])
    carried = topk.Best(np.full(len(q), -np.inf), 3)
    for at in (0, 700, 1400):  # blocks of one task: what was found prunes the next
        topk.dual_search(q, asked, carried, x[at : at + 700], np.arange(at, min(at + 700, len(x))), (trees[0], topk.cover_tree(x[at : at + 700], leaf=16)))
    assert all((a == b).all() for a, b in zip(carried.rows(asked), (own, ids, score)))
    first, floor = len(seen), best.kth + 1
    seen.clear()
    topk.dual_search(q, asked, topk.Best(floor, 3), x, np.arange(len(x)), trees)
    assert len(seen) < first  # the more is known, the fewer pairs are bounded


def test_cover_tree_covers():
    x = np.random.default_rng(0).normal(size=(500, 3))

    def rows(node):
        inside = np.concatenate([rows(c) for c in node.children]) if node.children else node.rows
        assert sorted(inside) == sorted(node.rows)
        assert np.sqrt(((x[inside] - node.center) ** 2).sum(1)).max() <= node.radius + 1e-9
        return inside

    tree = topk.cover_tree(x, leaf=8)
    assert sorted(rows(tree)) == list(range(500)) and tree.children


# 2 --------------------------------------------------------- near-duplicates


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)].append(d)
    return sorted(((d, f"{f:016x}", min(low[find(i)], default=None)) for i, (d, f) in enumerate(zip(ids, fps))), key=repr)


def test_near_duplicates(spark, edge, empty):
    assert sorted((tuple(r) for r in simhash.near_duplicates(edge).collect()), key=repr) == brute_components(EDGE)
    assert simhash.near_duplicates(empty).count() == 0
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(edge).collect()}
    assert 4 in kept and 5 not in kept and None in kept and simhash.drop_near_duplicates(edge).columns == edge.columns


@pytest.mark.parametrize("longest", [4096, 3])
def test_links_connect_what_all_pairs_connect(spark, longest):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {b for b in base}
    for b in base[:20]:
        for _ in range(12):
            x = b
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), longest=longest).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in found)

    def parts(pairs):
        parent = {f: f for f in signed}

        def find(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for a, b in pairs:
            parent[find(a)] = find(b)
        groups = defaultdict(set)
        for f in signed:
            groups[find(f)].add(f)
        return {frozenset(g) for g in groups.values()}

    every = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert parts((r[0], r[1]) for r in found) == parts(every)


def test_blocks_cover_all_triples():
    assert len(simhash.blocks()) == 14 and all(any(not set(b) & set(t) for b in simhash.blocks()) for t in itertools.combinations(range(8), 3))


def brute_near_copies(rows):
    """First row's number of each row's group: five-word shingle sets with a Jaccard similarity of 4/5 or more, transitively."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first = {}
    for i in order:
        first.setdefault(group[i], i)
    return [first[g] for g in group]


def planted(n, seed):
    """Texts of 60 to 400 words, each with copies of which 0 to 12 words are changed."""
    r, rows = random.Random(seed), []
    for i in range(n):
        base = words(r.randint(60, 400), 1000 + i).split()
        rows.append(" ".join(base))
        for _ in range(4):
            w = list(base)
            for at in r.sample(range(len(w)), r.randint(0, 12)):
                w[at] = "changed"
            rows.append(" ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("longest", [4096, 3])
def test_planted_near_copies(spark, empty, monkeypatch, longest):
    import corpus_pipeline

    for f, size in ((near_copies.links, longest), (near_copies.verified, longest * 244)):
        monkeypatch.setattr(f, "__defaults__", (size,))
    hot = words(200, 77).split()
    rows = planted(40, 8) + [(500 + i, " ".join(["other" if at == 7 * i % 190 else w for at, w in enumerate(hot)])) for i in range(40)]
    rows += [(600, "one two"), (601, "One  TWO"), (602, "one"), (603, None), (604, " "), (605, "")]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()}
    assert kept == {rows[i][0] for i in brute_near_copies(rows)}
    assert corpus_pipeline.near_duplicates(spark, empty, "").count() == 0


def test_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b = words(100, 1), words(100, 2)
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, b), (None, b), (3, words(80, 3)), (3, words(80, 3)), (None, words(70, 4)), (None, words(70, 4)), (None, None), (None, None), (4, words(60, 5))]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "")
    assert kept.columns == documents(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, a), (1, b), (3, words(80, 3)), (None, words(70, 4)), (None, None), (4, words(60, 5))], key=repr)
    docs = spark.createDataFrame([(None, a, "y"), (None, a, "x"), (None, a, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in near_copies.drop_near_copies(docs).collect()] == [(None, a, None)]


def test_sketches_are_as_similar_as_sets():
    r = np.random.default_rng(4)
    for _ in range(20):
        x = r.integers(0, 1 << 63, 1100, np.uint64)
        a, b = near_copies.sketch(x[:1000]), near_copies.sketch(x[111:])  # similarity 0.81
        assert (a == b).sum() >= near_copies.SHARED and (near_copies.sketch(x[:1000], 64) == a).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


# 3 ------------------------------------------------------ repeated passages


def brute_repeats(rows, length=50):
    first = {}
    for d, t in rows:
        if d is not None:
            b = (t or "").encode()
            for i in range(len(b) - length + 1):
                first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1) if d is not None else []:
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_collection_suffixes():
    r = random.Random(3)
    for most, leave in itertools.product((1, 2, 5, 12, 36), (False, True)):
        for _ in range(20):
            texts = [bytes(r.choices(b"ab\x00\xf4" if most > 2 else b"abc\x00", k=r.randint(most, most + 9))) for _ in range(r.randint(1, 9))]
            texts += texts[: r.randint(0, 3)]
            symbols = np.zeros((len(texts), max(map(len, texts))), np.uint8)
            for row, t in zip(symbols, texts):
                row[: len(t)] = np.frombuffer(t, np.uint8)
            string, offset, run = bwt.collection_suffixes(symbols, np.array([len(t) for t in texts]), most, leave)
            found = [texts[i][o : o + most] for i, o in zip(string, offset)]
            every = sorted(t[o : o + most] for t in texts for o in range(len(t) - most + 1))
            assert found == sorted(found) and (found == every if not leave else not set(x for x in every if every.count(x) > 1) - set(found))
            assert all((run[i] == run[i - 1]) == (found[i] == found[i - 1]) for i in range(1, len(found)))
            assert not leave or all(found.count(x) == every.count(x) for x in found)


@pytest.mark.parametrize("hot, packed, lot", [(32_000, 1_000_000, 30_000), (1, 200, 30_000), (32_000, 200, 100)])
def test_suffix_dedup(spark, edge, empty, monkeypatch, hot, packed, lot):
    for name, value in (("HOT", hot), ("PACKED", packed), ("LOT", lot), ("SORTED", lot // 10), ("SLICE", 70)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = [r for r in EDGE if r[0] != 10] + [(20 + i, words(30, i) + P[:200] + words(10, 50 + i)) for i in range(12)] + [(40 + i, "x" * i + "lorem ipsum dolor sit amet " * 4) for i in range(4)]
    rows += [(5, P[:90]), (6, "short"), (7, words(300, 4)), (44, words(9, 1) + P[10:90]), (44, P[10:90]), (44, P[10:90]), (45, words(40, 2) * 3)]  # different texts of an id
    got = sorted((tuple(r) for r in suffix_dedup.deduplicate(documents(spark, rows)).collect()), key=repr)
    assert got == brute_repeats(rows)
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_lots_settle_hot_lines_within_bounds():
    """A line that all documents have: what a lot hands on is bounded, and its arrays are small."""
    import tracemalloc

    line = words(40, 1)
    tracemalloc.start()
    texts = [np.frombuffer((words(3, i) + line)[:84].encode(), np.uint8) for i in range(8000)]
    matrix, size = np.stack(texts), np.full(8000, 84)
    row, offset = suffix_dedup.repeats(matrix, size, np.arange(8000), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = brute_repeats([(i, t.tobytes().decode()) for i, t in enumerate(texts)])
    assert sum(x[2] > 0 for x in want) == len(set(row.tolist())) and peak < 60e6


def test_removed_texts(spark):
    rows = [(1, "é" * 60), (2, "ab" + "é" * 60 + "cd"), (3, "é" * 60), (4, None), (5, ""), (None, "é" * 60)]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert got == {1: "é" * 60, 2: "abcd", 4: None, 5: "", None: "é" * 60}


# 4 ------------------------------------------------------------------ quality


def test_quality_held_out(spark):
    r = random.Random(0)
    rows, labels = [], []
    for i in range(900):
        good = r.random() < 0.6
        rows.append((i, words(80, i) + "." if good else " ".join(w + r.choice(["$$$", "###", "***"]) for w in words(60, i).split())))
        labels.append((i, int(good), 0))
    rows += [(None, "x"), (901, None), (902, ""), (903, "x" * 100_000), (5, rows[5][1])]
    lab = spark.createDataFrame([*labels, (5, 1, 0), (None, 1, 0), (902, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(documents(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.7) for g in got)
    want = {i: q for i, q, _ in labels}
    held = [g for g in got if g["held_out"] and g["doc_id"] in want]
    assert held and all(zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2 for g in held)
    assert sum(g["predicted"] == want[g["doc_id"]] for g in held) / len(held) > 0.97
    assert quality.classify(documents(spark, rows), lab.limit(0)).filter("score <> 0.5").count() == 0


def test_statistics_by_hand():
    text = "One two, two two!\none two, two two!\n\nÉ 12 #x (end)"
    got = dict(zip(quality.FEATURES, quality.statistics(text)))
    words_, n = text.split(), len(text.encode())
    triples = [tuple(words_[i : i + 3]) for i in range(len(words_) - 2)]
    want = {
        "bytes": n, "words": 12, "letters": sum(c.isascii() and c.isalpha() for c in text) / n, "digits": 2 / n, "spaces": sum(c in " \n" for c in text) / n, "upper": 1 / n, "stops": 4 / n,
        "marks": 7 / n, "other_marks": 3 / n, "non_ascii": 2 / n, "entropy": -sum(text.encode().count(b) / n * np.log2(text.encode().count(b) / n) for b in set(text.encode())),
        "word_length": sum(map(len, words_)) / 12, "distinct_words": len(set(words_)) / 12, "top_word": max(map(words_.count, words_)) / 12, "repeats": 0.0, "long_words": 0.0, "short_words": 3 / 12, "odd_ends": 1 / 12,
        "lines": 3, "line_length": sum(map(len, text.split("\n"))) / 3, "distinct_lines": 1.0, "top_line": 1 / 3, "repeated_trigrams": 1 - len(set(triples)) / len(triples),
    }
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items()), {k: (got[k], want[k]) for k in want if abs(got[k] - want[k]) > 1e-12}
    assert quality.statistics("") == [0.0] * len(quality.FEATURES)


def test_first_split_is_the_best_of_all():
    r = np.random.default_rng(3)
    x = r.integers(0, 12, (200, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (r.random(200) < 0.1)).astype(float)
    forest = quality.grow(x, y, trees=1, depth=1, least=5)
    p = (y.sum() + 0.5) / 201
    g, h, best = p - y, np.full(200, p * (1 - p)), (0.0, None, None)
    for j in range(3):
        for cut in np.unique(x[:, j]):
            left = x[:, j] <= cut
            if min(left.sum(), 200 - left.sum()) >= 5:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality.SMOOTH) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + quality.SMOOTH)
                best = max(best, (gain, j, cut), key=lambda b: b[0])
    left = x[:, best[1]] <= best[2]
    assert forest.feature[0, 0] == best[1] and ((x[:, best[1]] <= forest.threshold[0, 0]) == left).all()
    assert np.allclose(forest.value[0], [-quality.RATE * g[s].sum() / (h[s].sum() + quality.SMOOTH) for s in (left, ~left)])


def test_quality_of_empty_tables(spark, empty):
    assert quality.classify(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_forest_walk_equals_nodes():
    x = np.random.default_rng(2).normal(size=(300, 3))
    forest = quality.grow(x, (x[:, 0] > 0.3).astype(float), trees=5, least=5)

    def one(row):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [one(r) for r in x])


# 5 ------------------------------------------------------------- benchmark


def brute_words(t):
    out, now = [], ""
    for c in (t or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c >= "\x80" or c.isalnum():
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def brute_contamination(rows, items):
    out = []
    for d, t in rows:
        w, hit, ids = brute_words(t), set(), set()
        for item, it in items:
            iw = brute_words(it)
            n = min(10, len(iw))
            wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    ids.add(str(item))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination(spark, empty):
    item = words(25, 77)
    items = [(1, item), (2, "Just three words"), (10, item.upper()), (3, None), (4, "..."), (5, "a a a a a a a a a a a a"), (6, "Émile Été"), (7, words(15, 78))]
    rows = [(1, words(40, 1) + " " + item + " tail"), (2, " ".join(item.split()[3:14])), (3, " ".join(item.split()[:9])), (4, "so just three words, JUST three words"), (5, "a " * 30),
            (6, None), (7, ""), (8, "Émile été Émile Été"), (9, item + " x " + item), (9, item + " x " + item), (None, item), (None, "none"), (11, words(3000, 5))]
    bench = spark.createDataFrame([(i, t, "y", 3) for i, t in [*items, items[0]]], "item_id long, text string, words string, w int")
    got = sorted((tuple(r) for r in decontaminate.contamination(documents(spark, rows), bench).collect()), key=repr)
    assert got == brute_contamination(rows, items)
    kept = decontaminate.drop_contaminated(documents(spark, rows), bench)
    assert sorted(kept.toPandas().doc_id.dropna().astype(int)) == [3, 6, 7, 11] and kept.columns == documents(spark, []).columns
    assert decontaminate.contamination(empty, bench).count() == 0
    again = documents(spark, [(d, t) for d, t in rows if d in (1, 5)] + [(1, "a " * 11), (1, item)])  # different texts of an id
    assert sorted((tuple(r) for r in decontaminate.contamination(again, bench).collect()), key=repr) == brute_contamination([(r["doc_id"], r["text"]) for r in again.collect()], items)
    assert decontaminate.contamination(documents(spark, rows), bench.limit(0)).filter("contaminated").count() == 0


def test_repeated_words_and_windows(spark):
    """Texts of one word, of a period and of two words against items of the same kind."""
    import time

    r = random.Random(6)
    items = [(1, "a " * 200), (2, "b c d " * 50), (3, " ".join(r.choices("ef", k=120)) + " g h i j k l m n o p q " + "a " * 30), (4, "b c d " * 5 + "z")]
    texts = ["a " * 300, "x " + "c d b " * 40 + "y", " ".join(r.choices("ef", k=400)), items[2][1] + "tail", "a " * 9, "b c d " * 5 + "z a", "q " + "a " * 12]
    rows = list(enumerate(texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(x) for x in decontaminate.contamination(documents(spark, rows), bench).collect()) == sorted(brute_contamination(rows, items))
    began = time.time()
    long = documents(spark, [(1, "a " * 20_000)])
    assert [tuple(x)[1:4] for x in decontaminate.contamination(long, bench).collect()] == [(20_000, 20_000, 2)]
    assert time.time() - began < 40


def test_proximity(spark):
    docs = documents(spark, [(1, "red x x blue x green"), (2, "green blue red"), (3, "red " + "x " * 40 + "blue green"), (4, "red blue")])
    bench = spark.createDataFrame([(1, "red blue green")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.proximity_matches(docs, bench, slop=10).collect()} == {1, 2}


# 6 ------------------------------------------------------------------ packing

CLIP, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "A\u001cb", "İI ΑΣ Σ", "e\u0301 ộ", "<|startoftext|>a<|endoftext|>", "'s 'S don't", "漢字テスト 1234 ½", "a\u00a0b\u2003c\u0085d", "x" * 300, "  lead\n\n trail  ", "!?!? ... —–", "\U0001f600 \U00010400"]


def test_encoder_equals_library():
    tok, enc = Tokenizer.from_file(CLIP), packing.Encoder(CLIP)
    chars = [f"a{chr(c)}b {chr(c)}{chr(c)} {chr(c)}1 '{chr(c)}s A{chr(c)}" for c in [*range(0x250), *range(0x300, 0x3100, 11)]]
    for text in [*ODD, *chars, *(t for _, t in EDGE if t)]:
        assert enc.encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(spark, edge, empty):
    tok = Tokenizer.from_file(CLIP)
    got = packing.pack(edge, CLIP, capacity=256).toPandas()
    want = []
    for d, t in EDGE:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, p, p * 256, len(ids[p * 256 : p * 256 + 256]), zlib.crc32(np.array(ids[p * 256 : p * 256 + 256], "<u4").tobytes())) for p in range(-(-len(ids) // 256))]
    mine = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 256
    assert packing.pack(empty, CLIP).count() == 0


def test_ranks_in_buckets_by_count(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(2048).cast("long").alias("length"))
    rows = rows.unionAll(rows.filter("doc_id < 50"))
    counts = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    for bound in (0, 200_000):  # starts of buckets joined by shuffle, by broadcast
        monkeypatch.setattr(packing, "BROADCAST_ROWS", bound)
        ranked = packing.rank_within(rows, counts, ["doc_id"], least=2, most=40)
        assert set(ranked.columns) == {"doc_id", "length", "_rank"}
        got = defaultdict(list)
        for r in ranked.collect():
            got[r["length"]].append(r["_rank"])
        assert {n: sorted(v) for n, v in got.items()} == {r["length"]: list(range(r["n"])) for r in counts.collect()}


def test_plan_is_best_fit():
    r = random.Random(1)
    for _ in range(30):
        lengths = [r.randint(1, 50) for _ in range(r.randint(0, 80))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.plan_best_fit(counts, 50)
        room = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, x in enumerate(room) if x >= n]
            i = min(fits, key=lambda i: room[i]) if fits else len(room)
            room += [] if fits else [50]
            room[i] -= n
        assert plan.sequences == len(room)
        used = defaultdict(list)
        for n, c in counts.items():
            for s, o in zip(*plan.place(np.full(c, n), np.arange(c))):
                used[int(s)].append((int(o), n))
        assert sum(map(len, used.values())) == len(lengths)
        for slots in used.values():
            at = 0
            for o, n in sorted(slots):
                assert o == at
                at += n
            assert at <= 50


# 7 and 8 ------------------------------------------------------ urls, shards


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/en/1?x#y", "http://example.org", "http://a.com/fr/x", "http://a.com/de/x", "http://a.com/x", "http://b.com#f", "x://y://z/w", "http://org/", "http://évil.com/de/", "http://é.COM/fr/1"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, queries.URL_RULES).collect()}
    assert len(got) == len(urls) and url_filter.judge_urls(df, queries.URL_RULES).count() == 2 * len(urls)
    assert got[0][:3] == got[1][:3] == got[2][:3] == ("", "", None)
    assert got[4] == ("www.example.org", "/en/1", "example.org/en/1", "block") and got[5][:3] == ("example.org", "", None)
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block") and got[11][2:] == ("org/", "allow")
    assert got[10][:2] == ("y:", "//z/w") and got[9][:2] == ("b.com", "")
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_domains_and_suffixes(spark):
    want = {"": ("", ""), "uk": ("uk", "uk"), "co.uk": ("co.uk", "co.uk"), "a.co.uk": ("a.co.uk", "co.uk"), "x.a.co.uk": ("a.co.uk", "co.uk"),
            "x.a.com.vn": ("a.com.vn", "com.vn"), "x.a.com": ("a.com", "com"), "x.co.com": ("co.com", "com"), "x.disco.uk": ("disco.uk", "uk"), "m.bbc.uk": ("bbc.uk", "uk")}
    host = F.col("host")
    got = spark.createDataFrame([(h,) for h in want], "host string").select("host", url_filter.host_domain(host), url_filter.host_suffix(host)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want


def test_url_sql_on_country_domains(spark):
    hosts = [f"{w}.{d}" for w in ("www", "m", "a.b") for d in ("spam.co.uk", "good.co.uk", "spam.com.vn", "news.de", "co.uk", "bbc.uk")] + ["uk", "co.uk", "", "x..co.uk"]
    hosts += ["example.org", "m.example.org", "shop.com", "www.shop.com"]
    paths = ["/", "/de/1", "/fr/", "/es/x", "/en/1"]
    rows = [(i, f"http://{hosts[i * 7 % len(hosts)]}{paths[i % 5]}") for i in range(400)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES)
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert got == set(con.execute(queries.OP7_SQL).fetchall())


def test_reputation_shrinks(spark):
    rows = [("bad.x.com", True)] * 40 + [("good.y.com", False)] * 40 + [("one.x.com", True), ("new.x.com", None), ("new.y.com", None), ("far.net", None)]
    df = spark.createDataFrame(rows, "host string, bad boolean")
    got = {r["host"]: r for r in url_filter.reputation(df).collect()}
    assert got["bad.x.com"]["mean"] > 0.9 > 0.1 > got["good.y.com"]["mean"]
    assert got["new.x.com"]["mean"] > got["far.net"]["mean"] > got["new.y.com"]["mean"] and got["new.x.com"]["sd"] > got["bad.x.com"]["sd"]


def test_shards(spark, edge, empty):
    got = sharding.shard_documents(edge, 7).toPandas()
    assert len(got) == len(EDGE) and set(got.law) == {"key"}
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    moved = got[got.grown_shard != got.shard]
    assert set(moved.grown_shard) <= {7}
    again = sharding.shard_documents(edge, 8).toPandas()
    key = lambda d: sorted(zip(d.doc_id.fillna(-1), d.text_crc32, d.iloc[:, 4]))
    assert key(again) == sorted(zip(got.doc_id.fillna(-1), got.text_crc32, got.grown_shard))
    by = {None if np.isnan(r.doc_id) else int(r.doc_id): r for r in got.itertuples()}
    assert (by[1].size, by[1].text_crc32) == (16, 0) and (by[11].size, by[11].text_crc32) == (176, zlib.crc32(("é" * 80).encode()))
    assert sharding.shard_documents(empty, 3).count() == 0


def test_shards_by_recomputed_winner(spark):
    def winner(doc, shards):
        best = []
        for i in range(shards):
            h = xxhash.xxh64_intdigest(int(i).to_bytes(4, "little"), xxhash.xxh64_intdigest(str(doc).encode(), 42))
            best.append(h - (1 << 64) if h >> 63 else h)
        return max(range(shards), key=lambda i: (best[i], -i))

    got = sharding.shard_documents(documents(spark, [(i, f"t{i}") for i in range(300)]), 40).collect()
    assert all((r["shard"], r["grown_shard"]) == (winner(r["doc_id"], 40), winner(r["doc_id"], 41)) for r in got) and {r["shard"] for r in got} == set(range(40))


def test_weighted_shards(spark):
    df = spark.range(20_000).select("id", sharding.rendezvous(F.col("id"), [1.0, 3.0, 0.0]).alias("s"))
    n = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    assert set(n) == {0, 1} and abs(n[1] / 20_000 - 0.75) < 0.02


# 9 and 10 --------------------------------------------------- language, tokens


def test_language(spark, empty):
    sets = {"aa": "abcdef", "bb": "uvwxyz", "cc": "äöüßkl"}
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choices(a, k=5)) for _ in range(30)), lang) for i, (lang, a) in enumerate(list(sets.items()) * 100)]
    rows += [(1000, None, "aa"), (1001, "123 !", "aa"), (1002, "", None), (None, "abc def", "aa"), (1003, "ab" * 50_000, None), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([(*x, "s", "p") for x in rows], "doc_id long, text string, lang string, source string, lang_pred string")
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    want = {i: lang for i, _, lang in rows if i is not None and i < 1000}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and sum(got[i]["lang_pred"] == want[i] for i in held) / len(held) > 0.98
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] == "aa" and all(0 <= g["score"] <= 1 for g in got.values())
    odd = {2000: "½ ²", 2001: "Ⅷ ①", 2002: "٣ १ ੩", 2003: "½ é", 2004: "字"}
    odd_docs = spark.createDataFrame([(i, t, None, "s", "p") for i, t in odd.items()], docs.schema)
    assert {r["doc_id"] for r in language.identify(odd_docs, model).collect() if r["lang_pred"] == "und"} == {2000, 2001, 2002}
    assert {r["doc_id"] for r in language.keep_identified(odd_docs, model, least=0).collect()} == {2003, 2004}
    assert {r["doc_id"] for r in language.keep_identified(odd_docs, model).collect()} == {2003}  # no language has the other's letters
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    nothing = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"} and language.identify(empty, nothing).count() == 0


def test_training_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "solve", lambda rows, langs, *_: seen.append((len(rows), len(np.unique(rows, axis=0)), sorted(set(langs)))))
    rows = [(None if i % 3 else i, words(8, i), "aa") for i in range(3000)] + [(7, "twice", "bb")] * 300
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=50)
    assert seen[0][0] <= 100 and seen[0][1] >= 30 and "aa" in seen[0][2]


def test_documents_stay_where_no_language_was_learned(spark):
    import corpus_pipeline

    docs = documents(spark, [(1, words(20, 1)), (2, "12 !"), (3, None), (4, "é"), (None, "abc")])
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {1, 4, None}


def test_kernel_is_what_the_matrix_product_scores():
    texts = ["abc abd", "xyz", "abx", "zzz y"]
    bits = np.zeros((4, sum(language.BITS)), bool)
    for row, t in zip(bits, texts):
        row[language.ngram_slots(t)] = True
    model = language.solve(np.packbits(bits, axis=1), ["a", "b", "a", "b"])
    k = (bits.astype(float) @ bits.T) / np.sqrt(np.outer(bits.sum(1), bits.sum(1)))
    y = np.array([[1, 0], [0, 1], [1, 0], [0, 1]], float)
    alpha = np.linalg.solve(k.T @ k + 1e-4 * 4 * k + 1e-8 * np.eye(4), k.T @ y)
    assert np.allclose(language.presence(texts) @ model.weights, k @ alpha, atol=1e-3)


def test_token_counts(spark, edge, empty):
    tok = Tokenizer.from_file(BYTES)
    whole = token_count.whole_tokens(BYTES)
    count = token_count.counter(BYTES, whole)
    chars = [f"ab{chr(c)} {chr(c)}c 1{chr(c)}  {chr(c)}\n" for c in [*range(0, 0x3100, 7), 0x85, 0xA0, 0x1C, 0x2028, 0x3000, 0x1F600] if not 0xD800 <= c < 0xE000]
    for text in [*ODD, *chars]:
        assert count(text) == len(tok.encode(text, add_special_tokens=False).ids), repr(text)
    got = sorted((tuple(r) for r in token_count.count_tokens(edge, BYTES).collect()), key=repr)
    n = [(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in EDGE]
    assert got == sorted(((*x, x[2] > 512) for x in n), key=repr)
    assert token_count.count_tokens(empty, BYTES).count() == 0
    assert all(len(tok.encode(t, add_special_tokens=False).ids) == 1 for t in random.Random(0).sample(sorted(whole), 300))


# pipeline ------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, state = dict(corpus_pipeline.STAGES), docs
    names = list(stages)
    for name in names[:-1]:
        before = {r["doc_id"]: r["text"] for r in state.collect()}
        state = spark.createDataFrame(stages[name](spark, state, sf).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in state.collect()}
        if name == "language":
            assert set(before) - set(after) == {d for d, t in before.items() if not any(c.isalpha() for c in t or "")}
        elif name == "near_duplicates":
            rows = list(before.items())  # similarity 4/5 on five-word shingles, not the query's SimHash rule
            assert set(after) == {rows[i][0] for i in brute_near_copies(rows)}
        elif name == "repeated_passages":
            cuts = {d: (n, r) for d, n, r, _, _ in brute_repeats(list(before.items()))}
            assert all(len(t.encode()) <= cuts[d][0] - cuts[d][1] and cuts[d][0] - cuts[d][1] - len(t.encode()) <= 6 * 50 for d, t in after.items() if cuts[d][1])
            assert all(before[d] == t for d, t in after.items() if not cuts[d][1]) and set(before) - set(after) <= {d for d in cuts if cuts[d][1] == cuts[d][0]}
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {d for d, *_, bad in brute_contamination(list(before.items()), items) if not bad}
        assert set(after) <= set(before)
    packed = stages[names[-1]](spark, state, sf).toPandas()
    assert set(packed.doc_id) == set(after)


def test_pipeline_runs_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    def run(rows):
        folder = str(tmp_path / str(len(rows)))
        docs = spark.createDataFrame([(i, t, None, "s", None, 1, "p") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, sequence_id int, _spans string")
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, words(30, 500)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        return corpus_pipeline.run(spark, folder).toPandas()

    assert len(run([])) == 0
    clean, passage = words(300, 1), words(80, 2)
    rows = [(1, clean), (1, clean), (2, clean + " end"), (3, None), (4, ""), (5, "½ ²"), (6, "x " + words(30, 500)), (7, passage + " " + words(200, 3)), (8, words(200, 4) + " " + passage)]
    rows += [(None, words(90, 5)), (None, words(90, 5)), (9, words(30_000, 6)), (10, words(50, 7)), (10, words(70, 8))]  # repeated rows, no id, a very long text, an id of two texts
    packed = run(rows)
    whole = packed.groupby("doc_id", dropna=False).length.sum()
    assert {None if np.isnan(d) else int(d) for d in whole.index} == {1, 7, 8, 9, 10, None}
    tok = Tokenizer.from_file(CLIP)
    ids = lambda t: len(tok.encode(t, add_special_tokens=False).ids) + 1
    assert whole[1] == ids(clean) and whole[9] == ids(words(30_000, 6)) and whole[10] == ids(words(50, 7)) + ids(words(70, 8)) and ids(words(200, 4)) <= whole[8] < ids(rows[8][1]) - 100
    assert packed[packed.doc_id.isna()].length.sum() == ids(words(90, 5))
    for _, part in packed.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 2048


def test_near_copies_meet_through_simhash(spark, monkeypatch):
    """The stage's candidates are SimHash fingerprints in op2's index; pairs far beyond its three bits meet by samples of their shingles."""
    import corpus_pipeline

    asked, original = [], simhash.links
    monkeypatch.setattr(near_copies, "fingerprint_links", lambda fps, bits=simhash.BITS: asked.append(bits) or original(fps, bits))
    base = words(300, 5).split()
    far = " ".join(w if at % 43 else "changed" for at, w in enumerate(base))
    a, b = (near_copies.shingles(" ".join(t)) for t in (base, far.split()))
    both = len(np.intersect1d(a, b))
    assert 0.75 < both / (len(a) + len(b) - both) < 0.9 and int(simhash.majority(a[None])[0] ^ simhash.majority(b[None])[0]).bit_count() > 3
    rows = [(1, " ".join(base)), (2, far), (3, words(300, 6))]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()}
    assert kept == {rows[i][0] for i in brute_near_copies(rows)} and sorted(asked) == [1, 3]


def test_samples_share_fingerprints_as_often_as_sets_are_alike():
    r, met = np.random.default_rng(5), []
    for _ in range(200):
        x = r.integers(0, 1 << 63, 1100, np.uint64)
        a, b = (near_copies.fingerprints(near_copies.sample(s)) for s in (x[:1000], x[111:]))  # similarity 0.81
        met.append((a == b).mean())
    assert abs(np.mean(met) - (889 / 1100) ** 4) < 0.03 and min(met) > 0
