from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aspectra.functions import text as X
from aspectra.functions.vectors import cosine_distance, normalize, rendered


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return df.select(column.alias("out")).first()["out"]


def test_attribute_normaliser(spark):
    rows = [(None,), ("",), ("  ",), ("A  b\tC ",)]
    found = spark.createDataFrame(rows, "x string").select(X.normalize_attribute(F.col("x"))).collect()
    assert [r[0] for r in found] == ["unknown", "unknown", "", "a b c"]


def test_hash_of_nulls_and_id(spark):
    import hashlib

    hashed = one(spark, X.hardware_hash(F.lit("A 1"), F.lit(None).cast("string"), F.lit("x")))
    assert hashed == hashlib.md5(b"a 1 | unknown | x").hexdigest()
    assert one(spark, X.device_id(F.lit(hashed))) == "DEV-" + hashed[:10].upper()


def test_golden_device_id(spark):
    values = [
        "Apple A18 (3 nm)\r\n6 nhân (2x4.04 GHz + 4x2.20 GHz)\r\nGPU: Apple GPU (4 lõi đồ họa)", "6 nhân", "8GB", "Apple GPU (4 lõi đồ họa)",
        "146.7 x 71.5 x 7.8 mm", "167 g", "Li-Ion 4005 mAh\r\nSạc nhanh (dây) >20W\r\nSạc không dây (Qi) 7.5W",
    ]
    assert one(spark, X.device_id(X.hardware_hash(*map(F.lit, values)))) == "DEV-CF746AC17A"


def test_price_and_urls(spark):
    assert one(spark, X.price_from_text(F.lit("12.990.000 đ"))) == 12990000
    assert one(spark, X.price_from_text(F.lit(""))) == 0
    assert one(spark, X.price_from_text(F.lit("99999999999999"))) == 0
    for url, want in (("https://www.youtube.com/watch?v=abc&t=1", "abc"), ("https://youtu.be/abc/", "abc"), ("https://youtu.be/", None), ("https://x.org/", None), ("not a url", None)):
        assert one(spark, X.video_id(F.lit(url))) == want


def test_safe_names(spark):
    assert one(spark, X.safe_name(F.lit(" Điện thoại! A-1_ "))) == "i_n_tho_i_a-1"
    assert one(spark, X.media_name(F.lit(" Điện thoại! A-1_ "))) == "dien_thoai_a-1"
    assert one(spark, X.object_key("", F.lit("Phone X"), F.lit(" "), F.lit("audio"), F.lit("mp3"))) == "phone_x/asset_audio.mp3"
    assert one(spark, X.safe_title(F.lit(100), F.lit("?"), F.lit("vid"))) == "100_vid"


def test_previews_and_limits(spark):
    assert len(one(spark, X.preview(F.lit("x" * 121)))) == 120
    assert one(spark, X.preview(F.lit("x" * 120))) == "x" * 120
    assert len(one(spark, X.tool_preview(F.lit("x" * 3001)))) == 3001
    assert [one(spark, X.clamp_results(F.lit(n))) for n in (0, 7, 99)] == [1, 7, 50]
    assert one(spark, X.quota_exceeded(F.lit(403), F.array(F.lit("quotaExceeded"))))
    assert not one(spark, X.quota_exceeded(F.lit(500), F.array(F.lit("quotaExceeded"))))


def test_similarity(spark):
    assert abs(one(spark, X.similarity(F.lit("word"), F.lit("two words"))) - 0.363636) < 1e-6
    assert one(spark, X.similarity(F.lit("!"), F.lit("?"))) == 0


def test_aspects(spark):
    cases = {
        "Camera đẹp, pin trâu": {"camera", "battery"}, "bhai": set(), "120Hz": {"display"}, "64MP": {"camera"}, "5000mAh": {"battery"}, "256GB": {"storage"},
        "MÀN HÌNH": {"display"}, "đơ máy": {"performance"}, "Ảnh": {"camera"}, "ngân hàng": set(), "sạc 33W": {"battery"}, "33Wx": set(), "type-c": {"connectivity"}, "": set(),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for row in df.select("t", X.aspects_of(F.col("t")).alias("a")).collect():
        assert set(row["a"]) == cases[row["t"]], row["t"]


def test_vectors(spark):
    a, b, zero = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, cosine_distance(a, b)) == 1.0
    assert one(spark, cosine_distance(a, zero)) is None
    assert one(spark, normalize(b)) == [0.0, 1.0 - 5e-13] or abs(one(spark, normalize(b))[1] - 1) < 1e-9
    assert one(spark, rendered(a)) == "[1.00000000,0.00000000]"


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=30))
def test_collapse_is_idempotent(spark, value):
    once = one(spark, X.collapse_space(F.col("v")), v=value)
    assert once == one(spark, X.collapse_space(F.col("v")), v=once)


def test_units_as_python_reads_them(spark):
    """White space and digits of every script between number and unit."""
    import re

    from aspectra.plans.constants import UNIT_PATTERNS

    spaces = ["", " ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2009", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "_"]
    digits = ["120", "１２０", "٣", "௧", "²", "Ⅷ", ""]
    texts = [f"x {d}{s}{u}{e}" for d in digits for s in spaces for u in ("Hz", "MP", "mAh", "W", "watt", "GB", "tb") for e in ("", " ", "\xa0y", "z")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [set(r[0]) for r in df.select(F.map_keys(X.aspects_of(F.col("t"), {a: ["zzz"] for a in UNIT_PATTERNS}))).collect()]
    assert found == [{a for a, ps in UNIT_PATTERNS.items() if any(re.search(p, t, re.IGNORECASE) for p in ps)} for t in texts]
