"""Queries over files and services: walking a corpus, parsers, archives, reports, sidecars, caches, progress, answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions.text import strip
from docmill.operators import ranking, services, sidecars
from docmill.scratch import folder, stored
from docmill.sources import parsers, written
from docmill.sources.paged import _open
from docmill.sources.tables import table

from .registry import SQL, query
from .retrieval import KIND_SQL, RANKED, hybrid, questions
from .texts import SPACED, STRIP, collapse_sql, values


def normal_sql(of: str, key: str) -> str:
    """SQL of tables up to j (key, t): texts of ``of`` (key, text) as parsers give them."""
    return f"spaced AS (SELECT {key} AS doc_id, {SPACED} AS text FROM {of}), {collapse_sql('spaced')}, j AS (SELECT doc_id AS {key}, {STRIP.format('string_agg(s, chr(10) ORDER BY pos)')} AS t FROM k GROUP BY doc_id)"


@query("corpus_walk", f"WITH {normal_sql('documents', 'doc_id')} SELECT 's-' || coalesce(source, '') || '/' || (doc_id % 10) || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' ELSE '.rst' END AS path, length(t) AS n, md5(t) AS digest FROM j JOIN documents USING (doc_id) WHERE doc_id % 10 <> 3")
def corpus_walk(spark, d):
    """Texts written as files in nested folders, some with suffixes that no parser takes; the folder is walked and every file parsed, a row for each."""
    path = folder(spark, "corpus")
    suffix = F.when(F.col("doc_id") % 10 == 3, ".bin").when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".TXT").otherwise(".rst")
    name = F.concat(F.lit("s-"), F.coalesce("source", F.lit("")), F.lit("/"), (F.col("doc_id") % 10).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), suffix)
    texts = table(spark, d, "documents").filter("text IS NOT NULL")  # a missing text is no file, an empty one is an empty file
    written.write_files(texts.select(name.alias("path"), F.encode("text", "UTF-8").alias("content")), path)
    below = F.col("path").substr(F.lit(len(_open(path)[1]) + 2), F.length("path"))
    found = parsers.read_parsed(parsers.listed(spark, path), path).select(below.alias("path"), F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return stored(found, "walked").orderBy("path")  # an order looks at its rows twice, so files are parsed before it


#: Chats as paragraphs: lines of a turn that aren't blank, trimmed; characters that XML can't hold are left out.
_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
LINES_SQL = r"""c AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM conversations)"""


def _lines(spark, d):
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", _XML, ""), "\n"), strip), lambda x: x != "")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", lines.alias("ls"))


def _walked(spark, rows, key, pattern):
    """Files (path, content) written, walked and parsed: key from the path, section, text."""
    path = folder(spark, "files")
    written.write_files(rows, path)
    return _parsed(spark, path, key, pattern)


def _parsed(spark, path, key, pattern):
    return parsers.parsed(parsers.corpus(spark, path)).select(F.regexp_extract("path", pattern, 1).cast("long").alias(key), "section", "text")


@query("parse_docx", f"""WITH {LINES_SQL}, last AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id),
raw AS (SELECT c.conv_id * 1000 + c.turn AS no, '# ' || role || ' ' || c.turn || CASE WHEN len(ls) > 0 THEN chr(10) || array_to_string(ls, chr(10)) ELSE '' END || CASE WHEN c.turn = last.turn THEN chr(10) || c.conv_id || ' | end' ELSE '' END AS text FROM c JOIN last USING (conv_id)),
{normal_sql('raw', 'no')} SELECT no // 1000 AS conv_id, role || ' ' || turn AS section, length(t) AS n, md5(t) AS digest FROM j JOIN conversations ON conv_id * 1000 + turn = no""")
def parse_docx(spark, d):
    """Chats as DOCX files: a heading for each turn, its lines as paragraphs, a table at the end that goes into the last section."""
    heading = F.concat("role", F.lit(" "), F.col("turn").cast("string"))
    per = _lines(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", heading.alias("h"), "ls"))).alias("s"))
    content = written.word_files(F.transform("s", lambda x: x["h"]), F.transform("s", lambda x: x["ls"]), F.array(F.col("conv_id").cast("string"), F.lit("end")))
    found = _walked(spark, per.select(F.concat((F.col("conv_id") % 8).cast("string"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".docx")).alias("path"), content.alias("content")), "conv_id", r"/(\d+)\.docx$")
    return found.select("conv_id", "section", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("parse_xlsx", """WITH o AS (SELECT o_custkey % 50 AS book, o_orderstatus AS section, o_orderkey, o_orderkey || ' |  | ' || o_orderpriority AS line FROM orders)
SELECT book, section, count(*) AS rows, md5(string_agg(replace(line, '  ', ' '), chr(10) ORDER BY o_orderkey)) AS digest FROM o GROUP BY ALL""")
def parse_xlsx(spark, d):
    """Orders as workbooks: a sheet for each state, rows with an empty cell, and rows of blanks, which are left out."""
    cells = F.array(F.col("o_orderkey").cast("string"), F.lit(""), "o_orderpriority")
    blank = F.array(F.lit(" "), F.lit(""))
    path = F.concat((F.col("o_custkey") % 50).cast("string"), F.lit(".xlsx")).alias("path")
    o = table(spark, d, "orders").select(path, F.col("o_orderstatus").alias("sheet"), "o_orderkey", "o_orderpriority", F.posexplode(F.when(F.col("o_orderkey") % 5 == 0, F.array(cells, blank)).otherwise(F.array(cells))).alias("place", "cells"))
    books = folder(spark, "files")
    written.write_sheets(o, books, "o_orderkey", "o_orderpriority", "place")
    found = _parsed(spark, books, "book", r"/(\d+)\.xlsx$")
    return found.select("book", "section", F.size(F.split("text", "\n")).cast("long").alias("rows"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("parse_epub", f"""WITH {LINES_SQL}, raw AS (SELECT conv_id * 1000 + turn AS no, array_to_string(ls, chr(10)) AS text FROM c WHERE len(ls) > 0),
{normal_sql('raw', 'no')} SELECT no // 1000 AS conv_id, 'part' || printf('%04d', no % 1000) || '.xhtml' AS section, length(t) AS n, md5(t) AS digest FROM j""")
def parse_epub(spark, d):
    """Chats as EPUB files: a member for each turn; members without text give no section, styles and contents are left out."""
    member = F.concat(F.lit("part"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit(".xhtml"))
    per = _lines(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", member.alias("m"), F.array_join("ls", "\n").alias("t")))).alias("s"))
    content = written.book_files(F.transform("s", lambda x: x["m"]), F.transform("s", lambda x: x["t"]))
    found = _walked(spark, per.select(F.concat(F.col("conv_id").cast("string"), F.lit(".epub")).alias("path"), content.alias("content")), "conv_id", r"/(\d+)\.epub$")
    return found.select("conv_id", "section", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("parse_text", f"WITH spaced AS (SELECT doc_id, {SPACED} AS text FROM documents), {collapse_sql('spaced')}, j AS (SELECT doc_id, {STRIP.format('string_agg(s, chr(10) ORDER BY pos)')} AS t FROM k GROUP BY doc_id) SELECT doc_id, 1 AS sections, length(t) AS n, md5(t) AS digest FROM j")
def parse_text(spark, d):
    """The text parser over the bytes of the documents, every third in Latin-1 where its letters allow."""
    t = table(spark, d, "documents")
    narrow = (F.col("doc_id") % 3 == 0) & ~F.regexp_like("text", F.lit(r"[^\x00-\xFF]"))
    raw = F.when(narrow, F.encode(F.when(narrow, F.col("text")).otherwise(""), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    files = t.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(".md").alias("suffix"), raw.alias("content"))
    one = parsers.parsed(files).select(F.regexp_extract("path", r"^(-?\d+)", 1).cast("long").alias("doc_id"), "text")
    return one.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("sections"), F.max(F.length("text")).cast("long").alias("n"), F.max(F.md5(F.col("text").cast("binary"))).alias("digest"))


@query("parse_csv_linearize", "SELECT n_regionkey, string_agg(n_nationkey || ' | ' || n_name || ', \"x\" | ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def parse_csv_linearize(spark, d):
    """The CSV parser over files of rows with quoted cells: cells joined by bars, one line a row."""
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit(', ""x"""')), F.col("n_regionkey").cast("string"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\r\n").alias("raw"))
    files = rows.select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("path"), F.lit(".csv").alias("suffix"), F.encode("raw", "UTF-8").alias("content"))
    return parsers.parsed(files).select(F.split("path", r"\.")[0].cast("int").alias("n_regionkey"), "text")


@query("parse_mail", "SELECT conv_id, 'Subject: Conversation ' || conv_id || chr(10) || 'From: a@example.org' || chr(10) || 'To: ' AS head, count(*) AS n FROM conversations GROUP BY conv_id")
def parse_mail(spark, d):
    """The mail parser: three header lines, present or not, then the body."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), "\n")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(body.alias("body"))
    raw = F.concat(F.lit("Subject: Conversation "), F.col("conv_id").cast("string"), F.lit("\r\nFrom: a@example.org\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"), "body")
    files = c.select(F.concat(F.col("conv_id").cast("string"), F.lit(".eml")).alias("path"), F.lit(".eml").alias("suffix"), F.encode(raw, "UTF-8").alias("content"))
    text = F.split("text", "\n\n", 2)
    out = parsers.parsed(files).select(F.split("path", r"\.")[0].cast("long").alias("conv_id"), text[0].alias("head"), F.size(F.split(F.trim(text[1]), "\n")).cast("long").alias("n"))
    return out


@query("workspace_archive", "SELECT * FROM (SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier)")
def workspace_archive(spark, d):
    """Tables of a workspace exported to a folder with a manifest, which is checked on import."""
    path = folder(spark, "archive")
    services.export({n: table(spark, d, n) for n in ("nation", "region", "supplier")}, path)
    return services.manifest(spark, path).select("name", "n")


@query("report_checkpoints", "SELECT (n - 1) // 25 AS batch, count(*) AS cells, CAST(sum(doc_id) AS BIGINT) AS total FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id % 50 = 0) GROUP BY ALL")
def report_checkpoints(spark, d):
    """Cells of a run written as JSON, 25 at a time; a rerun of a batch replaces its file."""
    path = folder(spark, "report")
    cells = table(spark, d, "documents").filter("doc_id % 50 = 0").select("doc_id", "source")
    for _ in range(2):
        services.checkpoint(cells, "doc_id", 25, path)
    return spark.read.schema("doc_id long, source string, batch long").json(path).groupBy("batch").agg(F.count(F.lit(1)).alias("cells"), F.sum("doc_id").alias("total"))


PATHS = ((1, "docs/a.pdf"), (2, "docs\\b\\c.pdf"), (3, "docs/../../etc/passwd"), (4, "x/../y.txt"), (5, "/etc/passwd"), (6, ""), (7, "  z.md "), (8, "a/../../b"), (9, ".."))


@query("path_guard", "SELECT * FROM (" + values((1, "a.pdf"), (2, "b/c.pdf"), (3, None), (4, "y.txt"), (5, None), (6, None), (7, "z.md"), (8, None), (9, None)) + ") AS t(id, inside)")
def path_guard(spark, d):
    """Paths of citations as paths under the folder of sources; those that would leave it are missing."""
    return spark.createDataFrame(PATHS, "id int, path string").select("id", services.inside(F.col("path")).alias("inside"))


@query("workspaces_by_mtime", "SELECT user_id AS workspace, max(ts) AS changed, CAST(row_number() OVER (ORDER BY max(ts) DESC, user_id) AS INTEGER) AS place FROM events GROUP BY user_id QUALIFY place <= 20")
def workspaces_by_mtime(spark, d):
    """The twenty workspaces that changed last, newest first."""
    w = table(spark, d, "events").groupBy(F.col("user_id").alias("workspace")).agg(F.max("ts").alias("changed"))
    top = w.orderBy(F.desc("changed"), "workspace").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("changed"), "workspace")))


QUOTED = r"""CASE WHEN contains(v, '''') THEN '"' || replace(replace(v, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' ELSE '''' || v || '''' END"""


@query("toml_quote", f"SELECT page_id, {QUOTED} AS quoted FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '''s \"' || chr(92) ELSE '\"' || chr(92) END AS v FROM pages)")
def toml_quote(spark, d):
    v = F.concat("url", F.when(F.col("page_id") % 3 == 0, "'s \"\\").otherwise('"\\'))
    return table(spark, d, "pages").select("page_id", sidecars.quoted(v).alias("quoted"))


@query("sidecar_toml", "SELECT doc_id, 'Title ''' || lang || ''' ' || doc_id AS title, CASE doc_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'topic-aware' ELSE 'file-only' END AS scope, lang || ',' || source AS topics, doc_id % 7 = 0 AS broken FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, '', 'topic-aware', '', true FROM documents WHERE doc_id % 7 = 0")
def sidecar_toml(spark, d):
    """Sidecars written as TOML and read back; a broken file gives the defaults."""
    t = table(spark, d, "documents")
    scope = F.when(F.col("doc_id") % 3 == 0, "global").when(F.col("doc_id") % 3 == 1, "topic-aware").otherwise("file-only")
    written = t.select("doc_id", sidecars.rendered(F.concat(F.lit("Title '"), "lang", F.lit("' "), F.col("doc_id").cast("string")), scope, F.array("lang", "source")).alias("toml"))
    broken = written.withColumn("toml", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("= ["), "toml")).otherwise(F.col("toml")))
    return sidecars.read(broken, "doc_id", "toml").select("doc_id", "title", "scope", F.array_join("topics", ",").alias("topics"), "broken")


CHAIN = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n, count(*) OVER (PARTITION BY user_id) AS cnt FROM events),
r AS (SELECT key, event_id, tm, n, cnt, tm AS prev, {first} AS flag FROM e WHERE n = 1
  UNION ALL SELECT e.key, e.event_id, e.tm, e.n, e.cnt, CASE WHEN e.tm - r.prev >= {gap} THEN e.tm ELSE r.prev END, (e.tm - r.prev >= {gap}) = {sent} FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
"""


@query("progress_throttle", CHAIN.format(first="true", gap="10000000", sent="true") + "SELECT key AS user_id, event_id, tm AS at FROM r WHERE flag OR n = cnt")
def progress_throttle(spark, d):
    """Progress events of each file at most every ten seconds, and always the last: sequential for each file."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros("ts").alias("at"))
    return services.throttled(e, "user_id", "at", "event_id", 10_000_000)


@query("ttl_cache", CHAIN.format(first="false", gap="14400000000", sent="false") + "SELECT key, event_id, flag AS hit FROM r")
def ttl_cache(spark, d):
    """Look-ups by key against a cache whose entries live four hours: whether each is a hit."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.unix_micros("ts").alias("at"))
    return services.cached(e, "key", "at", "event_id", 4 * 3600 * 1_000_000)


@query("telemetry_snapshot", "SELECT event_type AS device, date_trunc('minute', ts) AS at, arg_max(round(value, 4), [epoch_us(ts), event_id]) AS value, count(*) AS samples FROM events GROUP BY ALL")
def telemetry_snapshot(spark, d):
    """The last sample of each device in every minute, from lines of a sampler."""
    lines = table(spark, d, "events").select("event_id", F.concat_ws(",", "event_type", F.unix_micros("ts").cast("string"), F.round("value", 4).cast("string")).alias("line"))
    c = F.split("line", ",")
    s = lines.select("event_id", c[0].alias("device"), F.timestamp_micros(c[1].cast("long")).alias("ts"), c[2].cast("double").alias("value"))
    return s.groupBy("device", F.date_trunc("minute", "ts").alias("at")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count(F.lit(1)).alias("samples"))


@query("answer_messages", RANKED + """, c AS (SELECT h.qid, string_agg('[' || h.rank || '] (' || d.source || ' p.' || (h.rank + 1) || ')' || chr(10) || d.text, chr(10) || chr(10) ORDER BY h.rank) AS context FROM hy h JOIN documents d USING (doc_id) WHERE h.rank <= 8 GROUP BY h.qid)
SELECT q.qid, CASE WHEN c.context IS NULL OR q.qid % 2 = 1 THEN 'plain' WHEN q.qid % 4 = 2 THEN 'list' ELSE 'sources' END AS system, md5('Question: ' || CASE WHEN q.qid % 4 = 2 THEN 'list ' ELSE '' END || q.question || CASE WHEN c.context IS NULL OR q.qid % 2 = 1 THEN '' ELSE chr(10) || chr(10) || 'Context:' || chr(10) || c.context END) AS digest
FROM q LEFT JOIN c USING (qid)""")
def answer_messages(spark, d):
    """What a model is sent for each question: a system prompt for sources, lists or no sources, and the question with its context."""
    from docmill.operators.prompts import context_block

    batch = questions(spark, d).withColumn("question", F.concat(F.when(F.col("qid") % 4 == 2, "list ").otherwise(""), "question"))
    hits = ranking.with_rows(hybrid(spark, d).filter("qid % 2 = 0"), table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    context = context_block(hits.withColumn("page", F.col("rank") + 1), "source")
    return services.messages(batch, context).select("qid", "system", F.md5(F.col("user").cast("binary")).alias("digest"))


@query("chat_messages", """WITH n AS (SELECT conv_id, turn, role, text, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS latest FROM conversations)
SELECT conv_id, count(*) + 1 AS messages, md5('system: plain' || chr(10) || string_agg(CASE WHEN turn = latest THEN 'user: Question: ' || text ELSE role || ': ' || text END, chr(10) ORDER BY turn)) AS digest FROM n WHERE role <> 'system' AND turn <= latest GROUP BY conv_id""")
def chat_messages(spark, d):
    """Chats as lists of messages: a system prompt, the history in order, the latest question last."""
    c = table(spark, d, "conversations").filter("role <> 'system'")
    return services.chat(c).select("conv_id", F.size("messages").cast("long").alias("messages"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").cast("binary")).alias("digest"))


class Counter:
    """A stand-in for a model that answers by the size of what it is sent; it has no answer to some."""

    def complete(self, prompt: str, max_tokens: int) -> str:
        return "" if len(prompt) % 5 == 2 else f"An answer to {len(prompt)} characters."


_CONTEXT_SQL = "string_agg('[' || h.rank || '] (' || d.source || ' p.' || (h.rank + 1) || ')' || chr(10) || d.text, chr(10) || chr(10) ORDER BY h.rank)"


@query("chat_completions", RANKED + f""", hk AS (SELECT qid, doc_id, rank, {KIND_SQL} FROM hy WHERE rank <= 8),
c AS (SELECT h.qid, {_CONTEXT_SQL} AS context, '[' || string_agg('{{"path":"' || d.source || '/' || h.doc_id || '","score":' || CAST(round(h.score, 6) AS DECIMAL(18,6)) || '}}', ',' ORDER BY h.rank) || ']' AS cited,
  string_agg('[' || h.rank || '] ' || d.source || '/' || h.doc_id, chr(10) ORDER BY h.rank) AS passages FROM hk h JOIN documents d USING (doc_id) GROUP BY h.qid),
b AS (SELECT qid, string_agg('• ' || source || ' — ' || source || '.' || chr(10) || '  Topics: the, de.', chr(10) || chr(10) ORDER BY rank) AS brief FROM (
  SELECT h.qid, d.source, min(h.rank) AS rank, q.question FROM hk h JOIN documents d USING (doc_id) JOIN q USING (qid) GROUP BY ALL) WHERE contains(lower(question), 'the') OR contains(lower(question), 'de') GROUP BY qid),
p AS (SELECT q.qid, length('sources' || CASE WHEN b.brief IS NULL THEN '' ELSE chr(10) || chr(10) || b.brief END || chr(10) || chr(10) || 'Question: ' || q.question || chr(10) || chr(10) || 'Context:' || chr(10) || c.context) AS n, c.cited, c.passages FROM q JOIN c USING (qid) LEFT JOIN b USING (qid))
SELECT qid, CASE n % 5 WHEN 2 THEN 'none' ELSE 'model' END AS backend, md5('{{"id":"chatcmpl-' || qid || '","object":"chat.completion","model":"counter","choices":[{{"index":0,"message":{{"role":"assistant","content":"' ||
  CASE n % 5 WHEN 2 THEN replace(passages, chr(10), chr(92) || 'n') ELSE 'An answer to ' || n || ' characters.' END || '"}},"finish_reason":"stop"}}],"citations":' || cited || '}}') AS digest FROM p""")
def chat_completions(spark, d):
    """Whole answers: prompt with what is known of the files, context, a model's reply or the passages where it has none, and the body that a service sends."""
    from docmill.operators.prompts import brief, context_block

    batch = questions(spark, d)
    hits = stored(ranking.with_rows(hybrid(spark, d).select("qid", "doc_id", "rank", "score"), table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id"), "answer-hits")
    context = context_block(hits.withColumn("page", F.col("rank") + 1), "source")
    topics, none = F.array(F.lit("the"), F.lit("de")), F.array().cast("array<string>")
    meta = hits.join(batch.select("qid", "question"), "qid").select("qid", "rank", F.col("source").alias("path"), "question", F.lit("topic-aware").alias("scope"), F.lit("").alias("title"), F.lit("").alias("description"), topics.alias("topics"), none.alias("entities"))
    asked = services.messages(batch, context, brief(meta))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    passages = hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", path.alias("path")))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["path"])), "\n").alias("text"))
    said = services.replied(asked, Counter, passages)
    body = services.completion(said, hits.withColumn("path", path), "counter")
    return body.join(said.select("qid", "backend"), "qid").select("qid", "backend", F.md5(F.col("body").cast("binary")).alias("digest"))


def _modifiers(spark, d):
    hits = ranking.with_rows(hybrid(spark, d), table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").join(questions(spark, d), "qid")
    scope = F.when(F.col("doc_id") % 3 == 0, "global").when(F.col("doc_id") % 3 == 1, "topic-aware").otherwise("file-only")
    return hits.select("qid", "rank", F.col("source").alias("path"), "question", scope.alias("scope"), F.array(F.lit("the"), F.lit("de")).alias("topics"), F.concat(F.lit("In "), "lang").alias("prefix"), F.lit("briefly").alias("suffix"), F.array("lang", F.upper("lang"), "source").alias("negatives"))


@query("merged_modifiers")
def merged_modifiers(spark, d):
    """Modifiers of the files of a question's hits, merged in rank order by scope. A fold with a search inside, so without SQL."""
    return sidecars.merged(_modifiers(spark, d), "Answer:", "", ["none"])


@query("modified_questions", RANKED + """, m AS (SELECT h.qid, d.source, arg_min(h.doc_id, h.rank) AS doc_id, arg_min(d.lang, h.rank) AS lang, min(h.rank) AS rank FROM hy h JOIN documents d USING (doc_id) WHERE h.rank <= 8 GROUP BY ALL),
a AS (SELECT m.*, row_number() OVER (PARTITION BY m.qid ORDER BY m.rank) AS place FROM m JOIN q USING (qid) WHERE CASE m.doc_id % 3 WHEN 0 THEN true WHEN 1 THEN contains(lower(q.question), 'the') OR contains(lower(q.question), 'de') ELSE m.rank = 1 END),
p AS (SELECT qid, string_agg('In ' || lang, ' ' ORDER BY place) AS prefix FROM (SELECT qid, lang, min(place) AS place FROM a GROUP BY ALL) GROUP BY qid),
n AS (SELECT qid, lower(word) AS low, arg_min(word, [place, i]) AS word, min([place, i]) AS spot FROM (SELECT qid, place, unnest([lang, upper(lang), source]) AS word, unnest([1, 2, 3]) AS i FROM a) WHERE lower(word) <> 'none' GROUP BY ALL),
g AS (SELECT qid, list(word ORDER BY spot) AS words FROM n GROUP BY qid)
SELECT q.qid, md5('Answer:' || coalesce(' ' || p.prefix, '') || ' ' || q.question || CASE WHEN p.qid IS NULL THEN '' ELSE ' briefly' END || '  Avoid: ' || array_to_string((['none'] || coalesce(g.words, []))[1:5], ', ')) AS digest FROM q LEFT JOIN p USING (qid) LEFT JOIN g USING (qid)""")
def modified_questions(spark, d):
    """What is embedded for every question: the workspace's modifiers and those of its hits' files around it."""
    return sidecars.modified(questions(spark, d), _modifiers(spark, d), "Answer:", "", ["none"]).select("qid", F.md5(F.col("searched").cast("binary")).alias("digest"))


@query("sidecar_files", SQL["sidecar_toml"])
def sidecar_files(spark, d):
    """Sidecars written as files beside their documents, found again and read; a broken one gives the defaults."""
    t = table(spark, d, "documents")
    scope = F.when(F.col("doc_id") % 3 == 0, "global").when(F.col("doc_id") % 3 == 1, "topic-aware").otherwise("file-only")
    toml = sidecars.rendered(F.concat(F.lit("Title '"), "lang", F.lit("' "), F.col("doc_id").cast("string")), scope, F.array("lang", "source"))
    path = folder(spark, "sidecars")
    name = F.concat((F.col("doc_id") % 16).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".meta.toml"))
    written.write_files(t.select(name.alias("path"), F.encode(F.concat(F.when(F.col("doc_id") % 7 == 0, "= [").otherwise(""), toml), "UTF-8").alias("content")), path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.toml").load(path)
    # A short file counts as four megabytes where files are dealt to tasks, so there would be a task for every 32 sidecars.
    files = files.coalesce(8 * spark.sparkContext.defaultParallelism)
    found = files.select(F.regexp_extract("path", r"/(\d+)\.meta\.toml$", 1).cast("long").alias("doc_id"), F.decode("content", "UTF-8").alias("toml"))
    return sidecars.read(found, "doc_id", "toml").select("doc_id", "title", "scope", F.array_join("topics", ",").alias("topics"), "broken")
