import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import metrics as M
from glyphmill.functions import text as T
from glyphmill.functions.corrector import choose_candidate, post_process

ODD = ["", "  ", "a  b", " x\t\ny ", "ộ", "ộ", "ĐĐĐĐĐ", "12 12 12 12 end", "a - - - -", "quân……………… sang", "text 12 12 12 12", "a\u0085b", "no no no no!", "aaaa bbbb", "a\x1cb \x1f c", "\u3000x\u2028\u00a0y ", "漢字", "ก", "Привет", "ﬃ"]


def column(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r["o"] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def plain_label(t):
    t = unicodedata.normalize("NFC", re.sub(r"\s+", " ", t.strip()))
    return t or None


def plain_sanitize(t):  # the patterns are fixed values
    if not t.strip():
        return t
    t = re.sub(r"(.)\1{3,}", r"\1\1\1", t)
    t = re.sub(r"\b(\S+)(?:\s+\1){2,}\b", r"\1 \1", t)
    t = re.sub(r"([^\w\s]+)(?:\s+\1){2,}", r"\1 \1", t)
    t = re.sub(r"(\s+\S{1,4})\1{2,}\s*$", "", t)
    return re.sub(r"\s{2,}", " ", t).strip()


def test_normalize_label(spark):
    assert column(spark, ODD, T.normalize_label) == [plain_label(t) for t in ODD]
    assert column(spark, [None], T.normalize_label) == [None]


def test_sanitize(spark):
    assert column(spark, ODD, T.sanitize) == [plain_sanitize(t) for t in ODD]


def test_sanitize_recorded_case(spark):
    raw = "quân sang đây" + "." * 20
    assert column(spark, [raw], T.sanitize) == ["quân sang đây..."]
    assert column(spark, [raw, "quân sang"], T.has_hallucination) == [True, False]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text("ab. \t-é", max_size=24), min_size=200, max_size=200))
def test_sanitize_property(spark, texts):
    assert column(spark, texts, T.sanitize) == [plain_sanitize(t) for t in texts]


def test_characters(spark):
    assert column(spark, ["abc", "漢a", "ไก่", "𝒳"], lambda c: T.script_families(T.foreign_chars(c))) == ["", "CJK", "Thai", "U+1D4B3"]
    assert column(spark, ["Đường", "漢"], T.is_allowed) == [True, False]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_rates(spark):
    pairs = [("Hải", "Hai"), ("", ""), ("", "x"), ("ab", "xxxxxxxxxx"), ("a b c", "a x c d"), ("a", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r string, p string")
    got = df.select("i", M.cer(F.col("r"), F.col("p")).alias("c"), M.wer(F.col("r"), F.col("p")).alias("w")).orderBy("i").collect()
    assert [g["c"] for g in got] == [plain_edits(r, p) / len(r) if r else float(bool(p)) for r, p in pairs]
    words = [(r.split(), p.split()) for r, p in pairs]
    assert [round(g["w"], 9) for g in got] == [round(plain_edits(r, p) / len(r), 9) if r else float(bool(p)) for r, p in words]


def test_categories(spark):
    rows = [("abcd", "abcd"), ("abcd", "aaaaaaaa"), ("abcdefghij", "ab"), ("abcd", "abcdefghijk"), ("abcd", "xyzd"), ("abcdefgh", "abcdefgx")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "i int, r string, p string")
    got = df.select("i", M.error_category(F.col("r"), F.col("p"), M.cer(F.col("r"), F.col("p"))).alias("c")).orderBy("i").collect()
    assert [g["c"] for g in got] == ["PERFECT", "HALLUCINATION_LOOP", "TRUNCATION", "INSERTION", "SUBSTITUTION", "MINOR_ERROR"]


def test_tokens_and_punctuation(spark):
    assert column(spark, ["_", ",.", "a", "12/3", "UBND", "Hanoi", "ABCDEF"], T.skip_token) == [True, True, True, True, True, False, False]
    df = spark.createDataFrame([("Marx-Lenin (x).", "Marx - Lenin ( x ) ."), ("a - b", "a - b"), ("", "x ,")], "o string, c string")
    assert [r[0] for r in df.select(T.reattach_punctuation(F.col("o"), F.col("c"))).collect()] == ["Marx-Lenin (x).", "a - b", "x ,"]
    assert column(spark, ["img_crop_12", "a_b"], T.document_id) == ["img_crop", "a_b"]


def test_candidates(spark):
    df = spark.createDataFrame([("hoa", "hoà", 0.9, 3), ("hoa", "hoà", 0.5, 3), ("TP", "Tx", 0.99, 3), ("hoa", "hoà", 0.9, 1)], "t string, c string, p double, n int")
    got = df.select(choose_candidate(F.col("t"), F.col("c"), F.col("p"), F.col("n"))).collect()
    assert [r[0] for r in got] == ["hoà", "hoa", "TP", "hoa"]
    post = post_process(spark.createDataFrame([("x  x",)], "raw string"), "raw", correct=F.upper).first()["post"]
    assert post["corrected"] == "X X" and post["model_corrected"] == "X X"


def test_words_beyond_one_alphabet(spark):
    """More distinct words than there are characters below the surrogates, in linear time."""
    many = " ".join(f"w{i}" for i in range(60_000))
    rows = [(many, "w5 new w59999"), ("w5 new w59999", many), ("a b c", "a x c"), ("", "a"), ("", ""), (None, "a")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, p string")
    got = [x[0] for x in df.orderBy("i").select(M.word_edits(F.col("r"), F.col("p"))).collect()]
    assert got == [59_998, 59_998, 1, 1, 0, None]


def test_desegment_and_formats(spark):
    from glyphmill.operators import reports as Rp

    assert column(spark, ["a_b c__d", ""], T.desegment) == ["a b c  d", ""]
    row = spark.range(1).select(Rp.places(F.lit(1.0049), 2), Rp.percent(F.lit(0.1234)), Rp.timing_line([("a", F.lit(1.0)), ("b", F.lit(0.25))])).first()
    assert tuple(row) == ("1.00", "12.3%", "a: 1.00s │ b: 0.25s │ **Total: 1.25s**")


def test_places_round_the_binary_value(spark):
    from glyphmill.operators import reports as Rp

    values = [6.01875, 1.78125, 13.15625, 4.26875, 0.00005, 0.00015, 0.03125, 0.09375, 2.5, 0.0, 1.0, 12345.67895, 0.99995, -0.00004, -1.78125, 1e-9, 0.05, -0.005]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(*[Rp.places("v", n).alias(str(n)) for n in (1, 2, 4)]).collect()
    assert [tuple(r) for r in got] == [tuple(f"{v:.{n}f}" for n in (1, 2, 4)) for v in values]


def test_previews_are_those_of_the_sql(spark, tmp_path):
    """Rates that end in a half of the fourth place (exact, and below it in binary), and a null text."""
    import duckdb

    from glyphmill.plans import evaluation as E

    texts = [("a" * 32, "b" * 57), ("a" * 32, "b" * 33 + "a" * 5), ("a" * 160, "b" * 963), ("a" * 160, "b" * 683), (None, "b"), ("a", None), ("", "b"), ("a", "a")]
    rows = [(i, turn, role, t) for i, pair in enumerate(texts) for turn, (role, t) in enumerate(zip(("user", "assistant"), pair))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = lambda r: r[:2]
    assert sorted(map(tuple, E.sample_preview(spark, str(tmp_path)).collect()), key=key) == sorted(con.execute(E.SAMPLE_PREVIEW).fetchall(), key=key)
