"""Text expressions: columns in, columns out. Null means unknown and stays null unless a docstring says otherwise."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Spellings, markers and word lists that results depend on.
FULL_WIDTH, HALF_WIDTH = "０１２３４５６７８９％．，", "0123456789%.,"
CN_DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}
CN_SECTIONS = {"万": 10_000, "亿": 100_000_000}
CN_COUNTERS = "个名位次年月日号家人辆条种倍批项张枚棵只间座页题轮套件岁层份台架头场届"
REFUSALS = [
    "无法确定", "无法回答", "无法提供", "无法给出", "无法从", "无法协助", "无法帮", "不能提供", "不便提供", "不予回答", "拒绝回答",
    "未检索到", "没有找到相关", "未找到相关", "未找到", "没有相关信息", "不足以为", "不足以回答", "不足以", "资料中没有", "资料中未",
    "文档中没有", "没有相关资料", "资料未提及", "未提及", "文中未", "未包含相关",
]
REFUSAL_CHARS = 120
TRUE_WORDS = ["true", "yes", "是", "是的", "对", "对的", "可以", "能", "支持", "相关", "有用", "成立"]
FALSE_WORDS = ["false", "no", "不是", "否", "不能", "不可以", "无法", "不支持", "不相关", "没用", "无关", "不成立"]
REPLY_PUNCTUATION = r"[\s。，,.!！?？:：;；'\"`*\\\[\]（）()]+"
CONTEXT_PREFIX = "[文档概要]"
CJK = "[㐀-䶿一-鿿]"


def bigrams(run: Column) -> Column:
    """All pairs of neighbours of a run of characters; a single one stays, an empty run has none."""
    more = lambda c: F.greatest(F.size(c) - 1, F.lit(0))
    pairs = lambda c: F.when(F.size(c) < 2, c).otherwise(F.zip_with(F.slice(c, 1, more(c)), F.slice(c, 2, more(c)), lambda x, y: F.concat(x, y)))
    characters = F.regexp_extract_all(run, F.lit("(?s)(.)"), F.lit(1))
    return F.flatten(F.transform(F.array(characters), pairs))  # bound once: the run is not computed anew for each pair


def terms(text: str, mode: str = "word") -> Column:
    """keyword terms with repeats. `word` takes runs of letters and digits of any script, and of runs of CJK characters
    their bigrams; `fused` drops all white space first, then takes ASCII runs whole and bigrams of the rest. A single
    character stays."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    if mode == "word":
        # CJK and all that is neither a letter, a mark nor a digit part words; a split is twice as fast as extracting, and
        # a single class that names ASCII first twice as fast as alternatives
        words = F.array_remove(F.split(low, rf"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f[\x80-\x{{10ffff}}&&[[^\p{{L}}\p{{M}}\p{{N}}]{CJK}]]]+"), "")
        runs = F.regexp_extract_all(low, F.lit(f"({CJK}+)"), F.lit(1))
        return F.when(low.rlike(CJK), F.concat(words, F.flatten(F.transform(runs, bigrams)))).otherwise(words)
    whole = F.regexp_replace(low, r"(?U)\s+", "")
    rest = F.regexp_replace(whole, "[a-z0-9]+", "")
    return F.concat(F.regexp_extract_all(whole, F.lit("([a-z0-9]+)"), F.lit(1)), bigrams(rest))


def embedding_tokens(text: str) -> Column:
    """CJK characters, then runs of ASCII letters and digits."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.concat(F.regexp_extract_all(low, F.lit(f"({CJK})"), F.lit(1)), F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)))


def unspaced(text: Column) -> Column:
    """Half-width digits, no white space, lower case, no thousands separators."""
    half = F.translate(F.coalesce(text, F.lit("")), FULL_WIDTH, HALF_WIDTH)
    return F.regexp_replace(F.lower(F.regexp_replace(half, r"(?U)\s+", "")), r"(?<=\d),(?=\d)", "")


def chinese_number(run: str) -> int | None:
    """A run of numerals as an integer; None for a run of section words only.

    The run is cut at its section words; inside a section a unit counts for the digit right before it (1 without one) and
    a digit counts alone only at the end.
    """
    sections = "".join(CN_SECTIONS)
    if not run.strip(sections):
        return None
    digits, parts = "".join(CN_DIGITS), re.split(f"([{sections}])", run)
    term = re.compile(f"([{digits}]?)([{''.join(CN_UNITS)}])|([{digits}])$")
    amount = lambda part: sum(CN_DIGITS[m[3]] if m[3] else (CN_DIGITS.get(m[1]) or 1) * CN_UNITS[m[2]] for m in term.finditer(part))
    return sum(amount(part) * CN_SECTIONS.get(unit, 1) for part, unit in zip(parts[::2], [*parts[1::2], ""], strict=True))


#: What Python gets of whole texts at once, by setting.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes of an Arrow batch, so that Python's memory follows neither the table nor the texts' length: the defaults (10,000 rows, 64 MB) hold hundreds of MB in each worker."""
    for key, most in BATCH.items():
        given = spark.conf.get(key)
        if not 0 < int(given.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def with_digits(text: Column) -> Column:
    """Numerals before a counter word as digits, in Python, which gets every text: call `small_batches` for long ones."""
    numerals = "".join({**CN_DIGITS, **CN_UNITS, **CN_SECTIONS})
    pattern = f"([{numerals}]+)(?=[{CN_COUNTERS}])"

    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        def one(m: re.Match) -> str:
            n = chinese_number(m[1])
            return m[1] if n is None else str(n)

        return s.map(lambda t: None if t is None else re.sub(pattern, one, t))

    return F.when(text.rlike(pattern), convert(text)).otherwise(text)


def normalized(text: Column, numerals: bool = True) -> Column:
    """F1 with F2: the spelling in which facts are compared."""
    plain = unspaced(text)
    return with_digits(plain) if numerals else plain


def contains_fact(want: Column, text: Column) -> Column:
    """want stands in text and, where its edge is a digit or a dot, touches no further one. Empty want: false."""
    escaped = F.regexp_replace(want, r"([\\.\[\]{}()*+?^$|/\-])", r"\\$1")
    numeric = "[0-9.]"
    head = F.when(want.rlike(f"^{numeric}"), F.lit("(?:^|[^0-9.])")).otherwise(F.lit(""))
    tail = F.when(want.rlike(f"{numeric}$"), F.lit("(?:[^0-9.]|$)")).otherwise(F.lit(""))
    found = (want != "") & text.contains(want) & F.rlike(text, F.concat(head, escaped, tail))
    return F.coalesce(found, F.lit(False))


def is_refusal(answer: Column) -> Column:
    """a short answer that says it cannot answer."""
    a = unspaced(answer)
    return F.length(a).between(1, REFUSAL_CHARS) & a.rlike("|".join(REFUSALS))


def approx_tokens(text: Column) -> Column:
    """CJK characters plus words of the rest."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.regexp_replace(t, CJK, " "), r"(?U)\s+"), "")
    return F.regexp_count(t, F.lit(CJK)) + F.size(words)


def sentences(text: Column) -> Column:
    """F8: split after 。！？!? and line ends; blank ones go."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[。！？!?\n])", -1), lambda s: F.length(F.regexp_replace(s, r"(?U)\s+", "")) > 0)


def lines_without_markers(text: Column) -> Column:
    """lines without list markers, empty ones dropped."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|[\r\n]"), lambda s: F.trim(F.regexp_replace(F.trim(s), r"^(?:[-•*]|\d+[.、)）])\s*", "")))
    return F.filter(bare, lambda s: s != "")


def truncated(text: Column, limit: int) -> Column:
    """at most `limit` characters, the last an ellipsis if something is cut."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, max(1, limit - 1)), F.lit("…")))


def is_caption(line: Column) -> Column:
    """a line that names a table or figure by number."""
    return F.regexp_replace(line, r"(?U)\s+", "").rlike(r"(?i)^(表|图|table|fig)[.\-]?\d")


# What a formula span is, and which macros only space one out.
FORMULA = r"(?:\$\$[\s\S]+?\$\$|(?<!\$)\$(?!\$)[^$\n]+?\$(?!\$))"
SPACERS = [r"\\q?quad", r"\\hspace\*?\{[^}]*\}"]


def formulas(text: Column) -> Column:
    """formula spans with their delimiters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({FORMULA})"), F.lit(1))


def clean_latex(latex: Column) -> Column:
    """runs of spacing macros and blanks become one blank, none is left beside a brace, a circled equals sign is an @."""
    spacer = "|".join(SPACERS)
    single = F.regexp_replace(F.coalesce(latex, F.lit("")), rf"[ \t]*(?:(?:{spacer})[ \t]*)+|[ \t]{{2,}}", " ")
    tight = F.regexp_replace(single, r"\s*([{}])\s*", "$1")
    return F.regexp_replace(F.replace(tight, F.lit(r"\textcircled{=}"), F.lit("@")), r"^\s+|\s+$", "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    """The length of a vector, 1 for a zero vector."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    """cosine; a zero or empty vector gives 0."""
    return dot(a, b) / (norm(a) * norm(b))


def reply_to_bool(reply: Column) -> Column:
    """a short yes or no; null if it is neither."""
    core = F.regexp_replace(F.lower(F.coalesce(reply, F.lit(""))), REPLY_PUNCTUATION, "")
    return F.when((core == "") | (F.length(core) > 12), F.lit(None).cast("boolean")).when(core.isin(FALSE_WORDS), F.lit(False)).when(core.isin(TRUE_WORDS), F.lit(True))


def first_json(text: Column, kind: str = "{") -> Column:
    """F16: the first balanced JSON object (or array, kind "[") of a text as JSON text; null if there is none."""
    close = {"{": "}", "[": "]"}[kind]

    def cut(t: str | None) -> str | None:
        if t is None or kind not in t:
            return None
        begin, deep = t.index(kind), 0
        for m in re.finditer(f"[{re.escape(kind)}{re.escape(close)}]", t[begin:]):
            deep += 1 if m[0] == kind else -1
            if not deep:
                try:
                    return json.dumps(json.loads(t[begin : begin + m.end()]), ensure_ascii=False)
                except ValueError:
                    return None
        return None

    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(cut)

    return F.when(F.contains(text, F.lit(kind)), convert(text))


def window_start(at: Column, window: str, zone: str = "UTC") -> Column:
    """the start of the local day or month."""
    if window not in ("day", "month"):
        raise ValueError(f"window must be day or month, not {window}")
    return F.date_trunc(window, F.from_utc_timestamp(at, zone))


def day_key(at: Column, zone: str = "UTC") -> Column:
    """the local day; empty for an unknown time."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd"), F.lit(""))


def within_days(at: Column, as_of: Column, days: int) -> Column:
    """Inside the last `days` days (1 to 365); an unknown time passes."""
    days = max(1, min(int(days), 365))
    return at.isNull() | (at >= as_of - F.make_interval(days=F.lit(days)))


def session_title(question: Column) -> Column:
    """the first 30 characters of the question on one line."""
    return F.substring(F.trim(F.regexp_replace(question, "\n", " ")), 1, 30)


def turn_text(user: Column, assistant: Column) -> Column:
    """one turn of a conversation."""
    return F.concat(F.lit("用户："), F.coalesce(user, F.lit("")), F.lit("\n助手："), F.coalesce(assistant, F.lit("")))


def context_text(candidates: Column) -> Column:
    """numbered candidates (content, doc_name, page_num, chunk_id) with their sources."""
    line = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(c["content"], F.lit("")), F.lit(" (来源: "), F.coalesce(c["doc_name"], F.lit("未知文档")), F.lit(", 第"), F.coalesce(c["page_num"], F.lit(0)).cast("string"), F.lit("页, chunk_id: "), c["chunk_id"], F.lit(")"))
    return F.array_join(F.transform(candidates, line), "\n\n")


def prompt_text(system: Column, question: Column, memory: Column | None = None, context: Column | None = None, summary: Column | None = None, history: Column | None = None, hint: Column | None = None) -> Column:
    """the blocks of a prompt; those that are null or empty are left out."""
    block = lambda head, body: F.when(F.length(body) > 0, F.concat(F.lit(head), body))
    parts = [system]
    for head, body in (("【已知信息】\n", memory), ("【参考资料】\n", context), ("【更早对话摘要】\n", summary), ("【历史对话】\n", history), ("【注意】", hint)):
        if body is not None:
            parts.append(block(head, body))
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("【用户问题】\n"), question))


def whole_number(value: Column) -> Column:
    """an integer, else null."""
    return F.when(F.trim(value.cast("string")).rlike(r"^[+-]?\d+$"), value.cast("string").try_cast("bigint"))


def without_context_prefix(text: Column) -> Column:
    """The text without its contextual first line."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\[文档概要\][^\n]*\n", "")
