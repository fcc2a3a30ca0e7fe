import pytest
from pyspark.sql import functions as F

from docmeter.functions import intents, text


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "mode", "want"),
    [("the cat", "word", ["the", "cat"]), ("the cat", "fused", ["thecat"]), ("表3.1 数据", "fused", ["3", "1", "表.", ".数", "数据"]), ("好", "fused", ["好"]), ("", "fused", []), (None, "word", [])],
)
def test_terms(spark, raw, mode, want):
    assert spark.createDataFrame([(raw,)], "t string").select(text.terms("t", mode).alias("x")).first()["x"] == want


@pytest.mark.parametrize(
    ("want", "said", "hit"),
    [("4次", "加息四次", True), ("4次", "加息14次", False), ("4次", "加息十四次", False), ("1313851", "共1,313,851辆", True), ("8%", "８％", True), ("21", "210", False), ("", "x", False), ("万1", "万一", False), ("803.96", "803.96亿元", True)],
)
def test_facts(spark, want, said, hit):
    row = spark.createDataFrame([(want, said)], "w string, s string")
    assert row.select(text.contains_fact(text.normalized(F.col("w")), text.normalized(F.col("s"))).alias("x")).first()["x"] is hit


@pytest.mark.parametrize(("run", "n"), [("十五", 15), ("二十一", 21), ("三百零五", 305), ("一万二千", 12000), ("万", None), ("两", 2)])
def test_chinese_numbers(run, n):
    assert text.chinese_number(run) == n


def test_refusals(spark):
    rows = [("根据现有资料无法确定。", True), ("", False), (None, False), ("资料中没有" + "很长" * 80, False), ("答案是四", False)]
    got = spark.createDataFrame(rows, "a string, want boolean").select("want", text.is_refusal(F.col("a")).alias("got")).collect()
    assert all(bool(r["got"]) is r["want"] for r in got)


def test_small_functions(spark):
    assert one(spark, text.approx_tokens(F.col("t")), t="你好 big world") == 4
    assert one(spark, text.truncated(F.col("t"), 4), t="abcdef") == "abc…"
    assert one(spark, text.lines_without_markers(F.col("t")), t="- a\n2. b\n\n2024 年\n3) c") == ["a", "b", "2024 年", "c"]
    assert one(spark, text.is_caption(F.col("t")), t="表 3 . 1 环境")
    assert one(spark, text.formulas(F.col("t")), t="a $x$ b $$y\nz$$") == ["$x$", "$$y\nz$$"]
    assert one(spark, text.clean_latex(F.col("t")), t=r"a \qquad \qquad { b }  \textcircled { = } c") == "a{b}@c"
    assert one(spark, text.reply_to_bool(F.col("t")), t="不能。") is False
    assert one(spark, text.reply_to_bool(F.col("t")), t="Yes!") is True
    assert one(spark, text.reply_to_bool(F.col("t")), t="maybe") is None
    assert one(spark, text.first_json(F.col("t")), t='so {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    assert one(spark, text.first_json(F.col("t"), "["), t="no") is None
    assert one(spark, text.whole_number(F.col("t")), t="12") == 12
    assert one(spark, text.whole_number(F.col("t")), t="1.5") is None
    assert one(spark, text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, text.sentences(F.col("t")), t="一。 \n二！three") == ["一。", "二！", "three"]
    with pytest.raises(ValueError):
        text.window_start(F.col("t"), "week")


def test_prompt_blocks(spark):
    p = one(spark, text.prompt_text(F.lit("S"), F.lit("Q"), memory=F.lit(None).cast("string"), context=F.lit("C")))
    assert p == "S\n\n【参考资料】\nC\n\n【用户问题】\nQ"


@pytest.mark.parametrize(
    ("question", "kind", "refs"),
    [("列出所有表格", "table", []), ("列出表3.1", None, ["表3.1"]), ("图 2 - 3 是什么", None, ["图2.3"]), ("有哪些公式", "formula", []), ("hello", None, []), ("全部代码", "code", [])],
)
def test_intents(spark, question, kind, refs):
    q = F.lit(question)
    row = spark.range(1).select(intents.enumeration(q).alias("k"), intents.references(q).alias("r"), intents.exempt(q).alias("e")).first()
    assert (row["k"], row["r"], row["e"]) == (kind, refs, bool(kind or refs))


def test_texts_reach_python_in_small_batches(spark, sf):
    import pandas as pd
    from docmeter.plans import catalogue

    @F.pandas_udf("int")
    def rows(t: pd.Series) -> pd.Series:
        return pd.Series([len(t)] * len(t))

    before = {k: spark.conf.get(k) for k in text.BATCH}
    try:
        catalogue.QUERIES["f2_spellings"](spark, sf)
        most = lambda n, letters: spark.range(0, n, 1, 1).select(rows(F.repeat(F.lit("x"), letters)).alias("n")).agg(F.max("n")).first()[0]
        assert most(3000, 10) == 1000
        assert most(300, 100_000) <= 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
