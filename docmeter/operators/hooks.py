"""Places where a model is plugged in (X1 to X7): plain callables; the defaults are deterministic.

X1 embed: retrieval.embed. X2 score: retrieval.model_rerank. X3 count_tokens: here. X4 summarize: conversation.plan.
X5 extract_facts: here. X6 verify and judge: citation.verify, evaluation.judge. X7 answer: a table of answers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmeter.functions import text


def token_count(content: Column, count: Callable[[str], int] | None = None) -> Column:
    """A tokenizer's count in Arrow batches; without one the approximate count."""
    if count is None:
        return text.approx_tokens(content)

    @F.pandas_udf("long")
    def counted(s: pd.Series) -> pd.Series:
        return s.fillna("").map(count)

    return counted(content)


def fact_function(extract: Callable[[str, str], str], limit: int = 5):  # noqa: ANN201
    """A table function (user, assistant) -> (pos, fact, error) of an extraction model's reply: its different lines
    without list markers, at most `limit`. A failure of the model is one row with the error.

    Register it by spark.udtf.register(name, ...) for SQL and lateral joins.
    """
    marker = re.compile(r"^(?:[-•*]|\d+[.、)）])\s*")

    class Facts:
        def eval(self, user: str, assistant: str):  # noqa: ANN202
            try:
                reply = extract(user or "", assistant or "") or ""
            except Exception as e:  # noqa: BLE001  the turn's failure is its row
                yield None, None, f"{type(e).__name__}: {e}"
                return
            bare = (marker.sub("", line.strip(" ")).strip(" ") for line in re.split("\r\n|[\r\n]", reply))
            for pos, fact in enumerate(list(dict.fromkeys(x for x in bare if x))[:limit]):
                yield pos, fact, None

    return F.udtf(Facts, returnType="pos int, fact string, error string", useArrow=True)


def extracted_facts(turns: DataFrame, extract: Callable[[str, str], str], limit: int = 5) -> DataFrame:
    """turns(session_id, turn_no, user, assistant) -> (session_id, turn_no, pos, fact, error), by a lateral join."""
    facts = fact_function(extract, limit)
    return turns.lateralJoin(facts(F.col("user").outer(), F.col("assistant").outer())).select("session_id", "turn_no", "pos", "fact", "error")
