"""Upserts, deletes and sweeps over document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(items: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """One row an id, the last write."""
    return items.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc()))).where("k = 1").drop("k")


def upload(existing: DataFrame, incoming: DataFrame, overwrite: bool, key: tuple[str, ...] = ("kb_id", "owner_id", "filename"), seq: str = "seq") -> DataFrame:
    """A known name is skipped, or replaced if `overwrite`; inside one batch the first, or the last, counts."""
    order = Window.partitionBy(*key).orderBy(F.col(seq).desc() if overwrite else F.col(seq).asc())
    once = incoming.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    names = list(key)
    if overwrite:
        return existing.join(once.select(*names), names, "left_anti").unionByName(once)
    return existing.unionByName(once.join(existing.select(*names), names, "left_anti"))


def deleted(rows: DataFrame, doc_id: Column | int | str | None = None, kb_id: Column | int | str | None = None) -> DataFrame:
    """Rows without those of a document, a knowledge base, or both; a delete that names neither is refused."""
    if doc_id is None and kb_id is None:
        raise ValueError("a delete names a document or a knowledge base")
    hit = F.lit(True)
    for name, value in (("doc_id", doc_id), ("kb_id", kb_id)):
        if value is not None:
            hit &= F.col(name) == value
    return rows.where(~F.coalesce(hit, F.lit(False)))


def cascade(parents: DataFrame, gone: DataFrame, children: list[tuple[DataFrame, str, str]], key: str = "id") -> list[DataFrame]:
    """Parents without those in gone(id), and each level of children (rows, own key, parent key) without orphans."""
    kept = parents.join(gone.select(key), key, "left_anti")
    out, above, above_key = [kept], kept, key
    for rows, own, up in children:
        level = rows.join(above.select(F.col(above_key).alias(up)), up, "left_semi")
        out.append(level)
        above, above_key = level, own
    return out


def index_source(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Child chunks of indexed documents."""
    return chunks.where("chunk_type = 'child'").join(documents.where("status = 'indexed'").select("doc_id", "filename"), "doc_id")


def swept(documents: DataFrame, started: Column) -> DataFrame:
    """Documents still processing from before `started` have failed."""
    stale = (F.col("status") == "processing") & (F.col("created_at") < started)
    return documents.withColumn("error", F.when(stale, F.lit("interrupted by a restart")).otherwise(F.col("error"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def back_filled(rows: DataFrame, target: T.StructType, defaults: dict[str, object]) -> tuple[DataFrame, list[str]]:
    """Rows with the columns of `target` that they lack, and which those are."""
    added = [f for f in target if f.name not in rows.columns]
    return rows.select("*", *(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in added)), [f.name for f in added]


def name_problem(filename: Column) -> Column:
    """Why an upload's name is refused, or null."""
    n = F.coalesce(filename, F.lit(""))
    return F.when(n == "", "empty").when(n.startswith("."), "leading dot").when(n.contains(".."), "two dots").when(n.rlike(r"[/\\]"), "path separator")


def valid_feedback(feedback: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Ratings of 1 or -1 on the user's own messages."""
    own = messages.join(sessions.select("session_id", "user_id"), "session_id").select("message_id", "user_id")
    return feedback.where(F.col("rating").isin(1, -1)).join(own, ["message_id", "user_id"], "left_semi")


def with_counts(kbs: DataFrame, documents: DataFrame) -> DataFrame:
    """Knowledge bases with their number of documents, 0 where there is none."""
    n = documents.groupBy("kb_id").agg(F.count("*").alias("documents"))
    return kbs.join(n, "kb_id", "left").fillna(0, ["documents"])


def repeated_names(files: DataFrame) -> DataFrame:
    """File names that stand more than once; an evaluation refuses them."""
    return files.groupBy("filename").agg(F.count("*").alias("n")).where("n > 1")


def visible(rows: DataFrame, user_id: Column | int, admin: bool) -> DataFrame:
    """Own rows, or all for an admin."""
    return rows if admin else rows.where(F.col("user_id") == user_id)
