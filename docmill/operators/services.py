"""What stands around the index: archives, reports, guards, throttles, caches, messages for a model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.text import is_list_query
from docmill.scratch import stored

from .models import TextModel, completed


def export(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as Parquet under ``path`` with a manifest (name, n). A folder that exists is an error: nothing is overwritten."""
    spark = next(iter(tables.values())).sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileExistsError(path)
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    rows = [(name, spark.read.parquet(f"{path}/{name}").count()) for name in tables]
    spark.createDataFrame(rows, "name string, n long").coalesce(1).write.json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of an archive, after every table was found to have its number of rows."""
    listed = spark.read.schema("name string, n long").json(f"{path}/manifest")
    for r in listed.collect():
        if spark.read.parquet(f"{path}/{r['name']}").count() != r["n"]:
            raise ValueError(f"{r['name']} doesn't have the {r['n']} rows of the manifest")
    return listed


def checkpoint(cells: DataFrame, order: str, size: int, path: str) -> None:
    """Cells of a run as JSON, a folder for each ``size`` of them in order; folders that are written again are replaced. The cells of a
    run are few (models x questions), which makes one ordered window fit for their numbers."""
    numbered = cells.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / F.lit(size)))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)


def inside(path: Column) -> Column:
    """The path under the folder of sources, without ``docs/`` in front and with ``..`` resolved; missing where it is empty or leaves it."""
    plain = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "^docs/", "")

    def step(acc: Column, part: Column) -> Column:
        up = F.struct((acc["left"] | (F.size(acc["parts"]) == 0)).alias("left"), F.slice(acc["parts"], F.lit(1), F.greatest(F.lit(0), F.size(acc["parts"]) - 1)).alias("parts"))
        down = F.struct(acc["left"].alias("left"), F.concat(acc["parts"], F.array(part)).alias("parts"))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(down)

    start = F.struct(F.startswith(plain, F.lit("/")).alias("left"), F.expr("cast(array() AS array<string>)").alias("parts"))
    end = F.aggregate(F.split(plain, "/"), start, step)
    return F.when(~end["left"] & (F.size(end["parts"]) > 0), F.array_join(end["parts"], "/"))


def throttled(events: DataFrame, key: str, at: str, order: str, gap: int) -> DataFrame:
    """key, order, at of the events that are sent on: the first, those at least ``gap`` after the last one sent, and the very last."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, order])
        keep, last = [], None
        for t in pdf[at]:
            sent = last is None or t - last >= gap
            last = t if sent else last
            keep.append(sent)
        keep[-1] = True
        return pdf[keep]

    return events.select(key, order, at).groupBy(key).applyInPandas(pick, events.select(key, order, at).schema)


def cached(lookups: DataFrame, key: str, at: str, order: str, ttl: int) -> DataFrame:
    """key, order, hit: whether a look-up finds an entry that was loaded less than ``ttl`` before; a miss loads it anew."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, order])
        hits, loaded = [], None
        for t in pdf[at]:
            hit = loaded is not None and t - loaded < ttl
            loaded = loaded if hit else t
            hits.append(hit)
        return pdf.assign(hit=hits)[[key, order, "hit"]]

    kinds = dict(lookups.dtypes)
    return lookups.select(key, order, at).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, hit boolean")


def messages(batch: DataFrame, context: DataFrame, briefs: DataFrame | None = None) -> DataFrame:
    """qid, system, user: which system prompt goes with a question (``sources``, ``list`` or ``plain`` where nothing was found), with what is known
    of the files of its hits (qid, brief) below it, and the question with its context (qid, context)."""
    joined = batch.join(context.select("qid", "context"), "qid", "left")
    found = F.col("context").isNotNull()
    system = F.when(~found, "plain").when(is_list_query(F.col("question")), "list").otherwise("sources")
    if briefs is not None:
        joined = joined.join(briefs.select("qid", "brief"), "qid", "left")
        system = F.concat(system, F.when(found & (F.coalesce("brief", F.lit("")) != ""), F.concat(F.lit("\n\n"), "brief")).otherwise(""))
    user = F.concat(F.lit("Question: "), "question", F.when(found, F.concat(F.lit("\n\nContext:\n"), "context")).otherwise(""))
    return joined.select("qid", system.alias("system"), user.alias("user"))


def replied(asked: DataFrame, model: Callable[[], TextModel], fallback: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """qid, text, backend: a model's answer to each of ``asked`` (qid, system, user), or the passages (qid, text) that were found where it has none."""
    reply = completed(F.concat_ws("\n\n", "system", "user"), model, max_tokens)
    said = stored(asked.select("qid", F.trim(reply).alias("reply")), "replies").join(fallback.select("qid", F.col("text").alias("passages")), "qid", "left")
    none = F.col("reply") == ""
    return said.select("qid", F.when(none, F.coalesce("passages", F.lit("(nothing found)"))).otherwise(F.col("reply")).alias("text"), F.when(none, "none").otherwise("model").alias("backend"))


def completion(replies: DataFrame, citations: DataFrame, model: str) -> DataFrame:
    """qid, body: the reply as a chat service sends it: an object with one choice and the citations (qid, rank, path, score) in order."""
    cited = citations.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path", F.round("score", 6).cast("decimal(18,6)").alias("score")))), lambda c: F.struct(c["path"].alias("path"), c["score"].alias("score"))).alias("citations"))
    choice = F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))
    body = F.struct(F.concat(F.lit("chatcmpl-"), F.col("qid").cast("string")).alias("id"), F.lit("chat.completion").alias("object"), F.lit(model).alias("model"), F.array(choice).alias("choices"), F.coalesce("citations", F.expr("cast(array() AS array<struct<path: string, score: decimal(18,6)>>)")).alias("citations"))
    return replies.join(cited, "qid", "left").select("qid", F.to_json(body).alias("body"))


def chat(turns: DataFrame, system: str = "plain") -> DataFrame:
    """conv_id, messages: a system prompt, the turns before the latest question in order, and that question."""
    latest = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    live = turns.withColumn("latest", latest).filter("turn <= latest")
    content = F.when(F.col("turn") == F.col("latest"), F.concat(F.lit("Question: "), "text")).otherwise(F.col("text"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", content.alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return live.groupBy("conv_id").agg(F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), listed).alias("messages"))
