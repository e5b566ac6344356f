import pytest
from pyspark.sql import functions as F

from scoremart import functions as fn


def one(spark, value, dtype, expr):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [("100B", 100_000_000_000), ("1.5M", 1_500_000), ("2_000", 2000), ("36T", 36_000_000_000_000), (" ", None),
     ("7k", 7000), ("12", 12), ("0.0005K", 0), ("junk", None), (None, None), ("5.507T", 5_507_000_000_000)],
)
def test_parse_human_int(spark, text, expected):
    assert one(spark, text, "string", fn.parse_human_int) == expected


@pytest.mark.parametrize(
    "n",
    [36 * 10**12, 100 * 10**9, 5507 * 10**9, 1500, 0, None, 999_999, 1_000_000, 1_234_565, 4_555_305, 193_687_500_000_000,
     2_000_000_500_000, 999_999_500, 123_456_789_012_345, 4_194_304_000],
)
def test_format_tokens_equals_general_format(spark, n):
    if n is None:
        expected = "-"
    else:
        unit = next(((s, d) for s, d in (("T", 10**12), ("B", 10**9), ("M", 10**6)) if n >= d), None)
        expected = f"{n / unit[1]:g}{unit[0]}" if unit else f"{n:,}"
    assert one(spark, n, "bigint", fn.format_tokens) == expected


def test_manifest_key(spark):
    df = spark.createDataFrame([("a.b", "x+y")], "m string, l string")
    assert df.select(fn.manifest_key("m", "l").alias("k")).first()["k"] == "a-b--x-y"


@pytest.mark.parametrize(
    "pattern, name, step",
    [("stage1-step{step}", "stage1-step1000", "1000"), ("stage1-step{step}", "stage1-step1000x", ""),
     ("checkpoint_{step}", "checkpoint_0005", "0005"), ("it.{step}*", "it.7-hf", "7"), ("it.{step}*", "itx7", "")],
)
def test_checkpoint_regex(spark, pattern, name, step):
    df = spark.createDataFrame([(pattern, name)], "p string, n string").withColumn("rx", fn.checkpoint_regex("p"))
    assert df.selectExpr("regexp_extract(n, rx, 1) AS s").first()["s"] == step


@pytest.mark.parametrize(
    "task, rank, suffix",
    [("a_code", 0, "_code"), ("a_rc", 4, "_rc"), ("a_b_zz", 5, "_zz"), ("plain", 5, ""), ("x_cot", 1, "_cot")],
)
def test_suffix_class(spark, task, rank, suffix):
    df = spark.createDataFrame([(task,)], "t string")
    r, s = fn.suffix_class("t")
    assert tuple(df.select(r, s).first()) == (rank, suffix)


def test_language_and_display_name(spark):
    df = spark.createDataFrame(
        [("german_x", " - n - "), ("deu_x", ""), ("x_deu_", None), ("fin_", "- -")], "t string, a string"
    )
    got = [tuple(r) for r in df.select(fn.detect_language("t"), fn.clean_display_name(F.col("a"), F.col("t"))).collect()]
    assert got == [("deu", "n"), ("deu", "deu_x"), ("eng", "x_deu_"), ("fin", "")]
