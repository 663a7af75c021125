"""Queries over what tools and services send, on small fixtures and on tables written as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import models, payloads
from docmill.sources.tables import table

from .registry import query
from .texts import values

CARDS = (
    (1, '{"card0": {"Card series": "RX 7", "VRAM Total Memory (B)": "8589934592", "VRAM Total Used Memory (B)": "1073741824"}, "card1": {"Card model": "Pro", "VRAM Total Memory (B)": "n/a"}, "system": "x"}'),
    (2, '{"card7": {"VRAM Total Memory (B)": "1048576", "VRAM Total Used Memory (B)": "9999999"}}'), (3, "not json"), (4, "{}"),
)


@query("vendor_json_map", "SELECT * FROM (" + values((1, 0, "RX 7", 8192, 7168), (1, 1, "Pro", 0, 0), (2, 7, "Unknown", 1, 0)) + ") AS t(id, idx, name, total_mb, free_mb)")
def vendor_json_map(spark, d):
    raw = spark.createDataFrame(CARDS, "id int, raw string")
    return payloads.cards(raw, "raw", ["Card series", "Card model"], "VRAM Total Memory (B)", "VRAM Total Used Memory (B)")


LISTS = ((1, '[{"Name": "A", "AdapterRAM": 4}, {"Name": "B"}]'), (2, '{"Name": "C", "AdapterRAM": 8}'), (3, "[]"), (4, "junk"))


@query("vendor_json_list", "SELECT * FROM (" + values((1, "A", 4), (1, "B", None), (2, "C", 8)) + ") AS t(id, name, ram)")
def vendor_json_list(spark, d):
    """A list of objects, or one object alone."""
    found = payloads.rows_of(spark.createDataFrame(LISTS, "id int, raw string"), "raw", "Name:string,AdapterRAM:bigint")
    return found.select("id", F.col("Name").alias("name"), F.col("AdapterRAM").alias("ram")).filter("name IS NOT NULL")


@query("http_json_list", "SELECT item_id % 10 AS host, item_id AS model, item_id * 1000 AS size FROM benchmark")
def http_json_list(spark, d):
    """Models that hosts say they have, from their replies: an object with a list in ``models``."""
    b = table(spark, d, "benchmark").select((F.col("item_id") % 10).alias("host"), F.struct(F.col("item_id").alias("name"), (F.col("item_id") * 1000).alias("size")).alias("m"))
    replies = b.groupBy("host").agg(F.to_json(F.struct(F.collect_list("m").alias("models"))).alias("raw"))
    return payloads.rows_of(replies, "raw", "name:bigint,size:bigint", "models").select("host", F.col("name").alias("model"), "size")


@query("json_results", "SELECT conv_id % 3 AS shape, conv_id, turn FROM conversations")
def json_results(spark, d):
    """Judged rows as a list, under ``results``, or one object a file."""
    c = table(spark, d, "conversations").select((F.col("conv_id") % 3).alias("shape"), "conv_id", "turn")
    item = F.struct("conv_id", "turn")
    listed = c.filter("shape = 0").groupBy("shape", "conv_id").agg(F.to_json(F.collect_list(item)).alias("raw")).select("shape", "raw")
    under = c.filter("shape = 1").groupBy("shape", "conv_id").agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("raw")).select("shape", "raw")
    alone = c.filter("shape = 2").select("shape", F.to_json(item).alias("raw"))
    return payloads.rows_of(listed.unionByName(under).unionByName(alone), "raw", "conv_id:bigint,turn:bigint", "results")


@query("html_card_extract", "SELECT page_id, 1 AS pos, 'm-' || page_id AS name, 'Page  of ' || 'words' AS description, 'tools|vision' AS caps, (page_id % 9 + 1) || 'b' AS sizes, page_id || 'K' AS pulls, '3' AS tags, 'now' AS updated FROM pages UNION ALL SELECT page_id, 0, 'first.' || page_id, '', '', '', '', '', '' FROM pages".replace("'Page  of ' || 'words'", "'Page of words'"))
def html_card_extract(spark, d):
    """Cards of catalogue pages: each page of the table with a bare card and a full one behind it."""
    page_id = F.col("page_id").cast("string")
    full = F.concat(
        F.lit('<a class="x" href="/library/m-'), page_id, F.lit('"><p class="max-w-lg y">Page <b> of</b>\n words</p><span x-test-capability c>tools</span><span x-test-capability> vision</span><span x-test-size>'),
        (F.col("page_id") % 9 + 1).cast("string"), F.lit("b</span><span x-test-pull-count>"), page_id, F.lit("K</span><span x-test-tag-count>3</span><span x-test-updated> now </span>"),
    )
    pages = table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("html", "/library/", "/"), F.lit('<a href="/library/first.'), page_id, F.lit('">'), full).alias("html"))
    cards = payloads.library_cards(pages, "html")
    return cards.select("page_id", "pos", "name", "description", F.array_join("caps", "|").alias("caps"), F.array_join("sizes", "|").alias("sizes"), "pulls", "tags", "updated")


@query("reply_stream", """WITH c AS (SELECT *, bool_or(turn = 3) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over_ FROM conversations)
SELECT conv_id AS qid, turn AS pos, CASE WHEN turn = 3 THEN 'error' WHEN role = 'assistant' THEN 'content' ELSE 'thinking' END AS kind, md5(CASE WHEN turn = 3 THEN 'out of memory' ELSE text END) AS digest
FROM c WHERE NOT coalesce(over_, false) AND turn <> 2 AND (turn = 3 OR text <> '')""")
def reply_stream(spark, d):
    """Replies as lines: thoughts and content, a line that isn't JSON (turn 2), an error in the middle (turn 3)."""
    message = F.struct(F.struct(F.when(F.col("role") != "assistant", F.col("text")).alias("thinking"), F.when(F.col("role") == "assistant", F.col("text")).alias("content")).alias("message"), (F.col("turn") > 90).alias("done"))
    line = F.when(F.col("turn") == 2, "{broken").when(F.col("turn") == 3, '{"error": "out of memory"}').otherwise(F.to_json(message))
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), line.alias("line"))
    return payloads.reply_events(lines, "line").select("qid", "pos", "kind", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("ndjson_answers", """SELECT conv_id, '{"qid":' || conv_id || ',"turns":' || count(*) || ',"done":true}' AS line FROM conversations GROUP BY conv_id""")
def ndjson_answers(spark, d):
    """Answers as lines of JSON, the form in which a service sends them."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return c.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("qid"), "turns", F.lit(True).alias("done"))).alias("line"))


WANTED = ((1, "auto"), (2, "server"), (3, "local"), (4, "other"))


@query("backend_choice", "SELECT * FROM (" + values((1, "server", "local", "none"), (2, "server", "none", "none"), (3, "local", "local", "none"), (4, "none", "none", "none")) + ") AS t(id, all_run, only_local, neither)")
def backend_choice(spark, d):
    w = spark.createDataFrame(WANTED, "id int, wanted string")
    pick = lambda a, b: models.backend(F.col("wanted"), [("server", F.lit(a)), ("local", F.lit(b))])
    return w.select("id", pick(True, True).alias("all_run"), pick(False, True).alias("only_local"), pick(False, False).alias("neither"))


@query("installed_models", "SELECT conv_id, turn FROM conversations WHERE (role || ':latest') IN ('user:latest', 'assistant:latest')")
def installed_models(spark, d):
    """Rows whose model is installed: a name without a tag stands for its latest one."""
    tagged = lambda c: F.when(F.contains(c, F.lit(":")), c).otherwise(F.concat(c, F.lit(":latest")))
    have = spark.createDataFrame([("user:latest",), ("assistant",), ("system:7b",)], "name string").select(tagged(F.col("name")).alias("key"))
    return table(spark, d, "conversations").withColumn("key", tagged(F.col("role"))).join(F.broadcast(have), "key", "left_semi").select("conv_id", "turn")


@query("centroid", "SELECT label, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS first, round(avg(list_sum(CAST(embedding AS DOUBLE[]))), 6) AS total FROM embeddings GROUP BY label")
def centroid(spark, d):
    c = models.centroid(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", "n", F.round(F.col("center")[0], 6).alias("first"), F.round(F.aggregate("center", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("embed_hash", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM w), p AS (SELECT doc_id, h % 64 AS pos, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS size FROM p GROUP BY doc_id)
SELECT d.doc_id, 64 AS width, round(coalesce(max(CASE WHEN pos = 0 THEN x END) / nullif(max(size), 0), 0), 6) AS first, round(coalesce(sum(x) / nullif(max(size), 0), 0), 6) AS total FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""")
def embed_hash(spark, d):
    v = table(spark, d, "documents").select("doc_id", models.embedded(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("width"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
