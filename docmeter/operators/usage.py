"""Token usage, cost and quota (Q1 to Q8, A3 to A6, W8, J4, J5). Unknown stays null and is counted apart, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmeter.functions import text
from docmeter.operators.retrieval import small

#: The local model that costs nothing.
BUILTIN = [("fake", 0.0, 0.0)]


def usage(rows: DataFrame, counter: str | None = "approx") -> DataFrame:
    """Q1: rows(prompt_text, answer_text, p_in, p_out, simulated) with tokens and their source; half a report is none."""
    whole = F.col("p_in").isNotNull() & F.col("p_out").isNotNull()
    said = F.coalesce("simulated", F.lit(False))
    source = F.when(said & whole, "simulated").when(~said & whole, "provider").when(F.lit(counter is not None), "local").otherwise("unavailable")
    local = lambda c: text.approx_tokens(F.col(c)).cast("bigint") if counter else F.lit(None).cast("bigint")
    return rows.withColumn("source", source).withColumn("input_tokens", F.when(F.col("source").isin("simulated", "provider"), F.col("p_in")).otherwise(local("prompt_text"))).withColumn("output_tokens", F.when(F.col("source").isin("simulated", "provider"), F.col("p_out")).otherwise(local("answer_text")))


def prices(spark: SparkSession, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(model, price_in, price_out, origin), overrides(model, value as JSON) before builtin; and the issues of malformed ones."""
    builtin = spark.createDataFrame(BUILTIN, "model string, price_in double, price_out double").withColumn("origin", F.lit("builtin"))
    if overrides is None:
        return builtin, builtin.limit(0).select("model", F.lit("").alias("issue"))
    parsed = overrides.select("model", F.from_json("value", "input string, output string").alias("p")).select("model", F.expr("try_cast(p.input as double)").alias("price_in"), F.expr("try_cast(p.output as double)").alias("price_out"))
    good = F.col("price_in").isNotNull() & F.col("price_out").isNotNull()
    every = builtin.withColumn("k", F.lit(1)).unionByName(parsed.where(good).withColumn("origin", F.lit("override")).withColumn("k", F.lit(0)))
    best = every.withColumn("n", F.row_number().over(Window.partitionBy("model").orderBy("k"))).where("n = 1").drop("n", "k")
    return best, parsed.where(~good).select("model", F.lit("needs {input, output} as numbers").alias("issue"))


def with_cost(records: DataFrame, price: DataFrame) -> DataFrame:
    """Q2: cost to 8 decimals; null with a note if tokens or the price are unknown. Prices are one row a model."""
    both = records.join(small(price), "model", "left")
    cost = F.round(F.col("input_tokens") / 1000 * F.col("price_in") + F.col("output_tokens") / 1000 * F.col("price_out"), 8)
    note = F.when(F.col("input_tokens").isNull() | F.col("output_tokens").isNull(), "tokens unknown").when(F.col("price_in").isNull(), "price unknown").otherwise(F.col("origin"))
    return both.select(*records.columns, cost.alias("cost"), note.alias("price_note"))


def totals(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A3: totals of records; null where nothing is known."""
    known = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    return records.groupBy(*(by or [])).agg(F.count("*").alias("records"), F.round(F.sum("cost"), 8).alias("total_cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"), F.sum(F.when(known, F.col("input_tokens"))).alias("input_tokens"), F.sum(F.when(known, F.col("output_tokens"))).alias("output_tokens"), F.count_if(~known).alias("token_unavailable"))


def summary(records: DataFrame) -> DataFrame:
    """A4, Q4: cost by user, by day, by source and in all, in one pass over records(user_id, created_at, source, cost)."""
    keyed = records.withColumn("day", text.day_key(F.col("created_at")))
    sets = keyed.groupingSets([["user_id"], ["day"], ["source"], []], "user_id", "day", "source")
    by = F.when(F.grouping("user_id") == 0, "user").when(F.grouping("day") == 0, "day").when(F.grouping("source") == 0, "source").otherwise("all")
    out = sets.agg(by.alias("by"), F.round(F.sum("cost"), 8).alias("cost"), F.count("cost").alias("priced"), F.count_if(F.col("cost").isNull()).alias("unpriced"), F.count("*").alias("records"))
    return out.select("by", F.coalesce(F.col("user_id").cast("string"), "day", "source").alias("key"), "cost", "priced", "unpriced", "records")


def in_cost_order(breakdown: DataFrame) -> DataFrame:
    """summary() rows with their position in each breakdown: by cost, unknown costs last, then by key."""
    order = Window.partitionBy("by").orderBy(F.round("cost", 8).desc_nulls_last(), "key")
    return breakdown.withColumn("position", F.row_number().over(order))


def with_names(rows: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """The display name, the id where there is none."""
    return rows.join(users.select(F.col("id").alias(key), "username"), key, "left").withColumn("username", F.coalesce("username", F.col(key).cast("string")))


def caliber(totals_row: DataFrame, simulated: Column) -> DataFrame:
    """Q5: what a sum means: simulated rows, nothing priced, or a lower bound."""
    nothing = F.col("total_cost").isNull() & (F.col("records") > 0)
    return totals_row.withColumn("note", F.concat_ws("; ", F.when(simulated > 0, F.concat(F.lit("simulated rows: "), simulated.cast("string"))), F.when(nothing, "nothing priced").when(F.col("unpriced") > 0, F.concat(F.lit("lower bound, unpriced: "), F.col("unpriced").cast("string")))))


def steps_usage(steps: DataFrame, by: list[str]) -> DataFrame:
    """Sums over steps only if every one reported both sides; simulated only if all are."""
    missing = F.count_if(F.col("input_tokens").isNull() | F.col("output_tokens").isNull())
    whole = lambda c: F.when(missing == 0, F.sum(c)).alias(c)
    return steps.groupBy(*by).agg(whole("input_tokens"), whole("output_tokens"), F.every(F.coalesce("simulated", F.lit(False))).alias("simulated"))


def spent(records: DataFrame, since: Column) -> DataFrame:
    """What each user spent since a time, and how many costs are unknown; an unknown time counts."""
    inside = F.col("created_at").isNull() | (F.col("created_at") >= since)
    return records.where(inside).groupBy("user_id").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent"), F.count_if(F.col("cost").isNull()).alias("unknown"))


def quota(requests: DataFrame, limit: float | None, window: str = "day") -> DataFrame:
    """requests(request_id, user_id, created_at, cost, role, own_key): spent before each in its window, and whether it is blocked.

    Reaching the limit blocks the next request. Admins and users of their own key are exempt; no limit never blocks.
    """
    order = Window.partitionBy("user_id", "window").orderBy("created_at", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = requests.withColumn("window", text.window_start(F.col("created_at"), window))
    exempt = (F.coalesce("role", F.lit("")) == "admin") | F.coalesce("own_key", F.lit(False))
    over = F.lit(False) if limit is None or limit <= 0 else F.round("spent_before", 8) >= limit
    return rows.withColumn("spent_before", F.coalesce(F.sum("cost").over(order), F.lit(0.0))).withColumn("unknown_before", F.count_if(F.col("cost").isNull()).over(order)).withColumn("blocked", over & ~exempt)


def billable(records: DataFrame, enabled: bool = True) -> DataFrame:
    """Q7: cache hits leave no record; nor does anything while accounting is off."""
    return records.where(~F.coalesce("cache_hit", F.lit(False)) & F.lit(enabled))


def low_balance(balances: DataFrame, threshold: float) -> DataFrame:
    """Q8: a reminder for a known balance below the threshold; unknown stays unknown."""
    return balances.withColumn("low", F.col("balance") < threshold)
