"""What a question asks for, and what kind of content a chunk holds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signal words and, by category, the keyword and the numbered reference that rules it out.
SIGNALS = "所有|全部|列出|列举|有哪些|哪些|都有|给出|给我|汇总|统计"
CATEGORIES = {
    "table": (r"(?i)表|表格|table", r"(?i)(表|表格)\s*\d|table\s*\d"),
    "figure": (r"(?i)图|图片|图像|figure|fig", r"(?i)图\s*\d|figure\s*\d"),
    "formula": (r"(?i)公式|equation|formula", r"(?i)公式\s*[（(]?\s*\d|equation\s*\d"),
    "code": (r"(?i)代码|code|程序", None),
}
REFERENCE = r"(表|表格|图|公式)\s*(\d+)\s*(?:[.\-]\s*(\d+))?"


def enumeration(question: Column) -> Column:
    """The category whose members the question wants listed, or null."""
    found = F.lit(None).cast("string")
    for name, (word, numbered) in reversed(CATEGORIES.items()):
        hit = question.rlike(word)
        found = F.when(hit & ~question.rlike(numbered) if numbered else hit, F.lit(name)).otherwise(found)
    return F.when(question.rlike(SIGNALS), found)


def is_kind(content: Column, kind: str) -> Column:
    """P10: whether a chunk looks like a table, figure, formula or code."""
    c = F.coalesce(content, F.lit(""))
    start = F.trim(F.regexp_replace(c, r"^(?U)\s+", ""))
    low = F.lower(c)
    return {
        "table": (F.regexp_count(c, F.lit(r"(?m)^[ \t]*\|")) >= 2) | start.rlike(r"(?i)^(表|Table)\s*\d"),
        "figure": c.contains("<!-- image -->") | low.contains("<!-- figure") | start.rlike("(?i)^(图|Fig)"),
        "formula": (low.contains("formula") & c.contains("<!--")) | c.rlike(r"\$|\\begin\{|\\\("),
        "code": c.contains("```") | low.contains("<!-- code"),
    }[kind]


def references(question: Column) -> Column:
    """Keys of numbered references, such as 表3.1."""
    part = lambda k: F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(REFERENCE), F.lit(k))
    both = F.arrays_zip(part(1).alias("p"), part(2).alias("n"), part(3).alias("m"))
    return F.transform(both, lambda r: F.concat(r["p"], r["n"], F.when(F.length(r["m"]) > 0, F.concat(F.lit("."), r["m"])).otherwise(F.lit(""))))


def exempt(question: Column) -> Column:
    """The question needs everything in its context."""
    return enumeration(question).isNotNull() | (F.size(references(question)) > 0)
