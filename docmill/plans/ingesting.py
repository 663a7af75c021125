"""Ingest queries: listings, changes, catalogue statistics, chapters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.operators import expand, ingest
from docmill.operators.prefix import running
from docmill.sources.tables import chunks, files, table

from .registry import CHUNKS, FILES, query

#: The stored listing lacks every seventh file, has another digest for every fifth, and 40 files that are gone.
STORED = """
stored AS (SELECT path, CASE WHEN file_id % 5 = 0 THEN sha256(sha256) ELSE sha256 END AS sha256, bytes FROM files WHERE file_id % 7 <> 0
  UNION ALL SELECT 'gone/' || file_id, sha256, bytes FROM files WHERE file_id < 40)
"""
DIFF = f"""WITH {FILES}, {STORED}, diff AS (SELECT coalesce(s.path, n.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN s.sha256 IS NOT DISTINCT FROM n.sha256 THEN 'unchanged' ELSE 'changed' END AS state,
  n.bytes FROM stored s FULL OUTER JOIN files n ON s.path = n.path)
"""


def stored(spark, d):
    f = files(spark, d)
    known = f.filter("file_id % 7 <> 0").select("path", F.when(F.col("file_id") % 5 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"), "bytes")
    return known.unionByName(f.filter("file_id < 40").select(F.concat(F.lit("gone/"), F.col("file_id").cast("string")).alias("path"), "sha256", "bytes"))


@query("ingest_diff", DIFF + "SELECT path, state FROM diff")
def ingest_diff(spark, d):
    return ingest.diff(stored(spark, d), files(spark, d)).select("path", "state")


#: Files of every thirteenth number have a suffix that no parser takes, every seventeenth can't be parsed.
KINDS_SQL = "CASE WHEN CAST(string_split(path, '/')[2] AS BIGINT) % 13 = 0 THEN 'unsupported' WHEN CAST(string_split(path, '/')[2] AS BIGINT) % 17 = 0 THEN 'errored' ELSE 'fine' END"


@query("ingest_stats", DIFF.replace("WITH ", f"WITH {CHUNKS}, ", 1) + f""", k AS (SELECT *, {KINDS_SQL} AS kind, state IN ('new', 'changed') AS work FROM diff), c AS (SELECT f.path, count(*) AS n FROM chunks c JOIN files f ON f.file_id = c.file_id GROUP BY f.path)
SELECT count(*) FILTER (state <> 'removed' AND kind <> 'unsupported') AS seen, count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'removed') AS removed,
count(*) FILTER (state <> 'removed' AND kind = 'unsupported') AS unsupported, count(*) FILTER (work AND kind = 'errored') AS errored, CAST(coalesce(sum(n) FILTER (work AND kind = 'fine'), 0) AS BIGINT) AS chunks FROM k LEFT JOIN c USING (path)""")
def ingest_stats(spark, d):
    """What a run would count: files by state, those that no parser takes, those that fail, and the chunks that are written."""
    no = F.split("path", "/")[1].cast("long")
    kind = F.when(no % 13 == 0, "unsupported").when(no % 17 == 0, "errored").otherwise("fine")
    x = ingest.diff(stored(spark, d), files(spark, d)).withColumn("kind", kind).withColumn("work", F.col("state").isin("new", "changed"))
    n = chunks(spark, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).join(files(spark, d).select("file_id", "path"), "file_id").select("path", "n")
    here = F.col("state") != "removed"
    return x.join(n, "path", "left").agg(
        F.count_if(here & (F.col("kind") != "unsupported")).alias("seen"), *[F.count_if(F.col("state") == s).alias(s) for s in ("new", "changed", "unchanged", "removed")], F.count_if(here & (F.col("kind") == "unsupported")).alias("unsupported"),
        F.count_if(F.col("work") & (F.col("kind") == "errored")).alias("errored"), F.coalesce(F.sum(F.when(F.col("work") & (F.col("kind") == "fine"), F.col("n"))), F.lit(0)).alias("chunks"),
    )


@query("ingest_forced", DIFF + "SELECT path, CASE state WHEN 'unchanged' THEN 'changed' ELSE state END AS state FROM diff")
def ingest_forced(spark, d):
    """With force, files that are known and still there are done anew."""
    return ingest.diff(stored(spark, d), files(spark, d), force=True).select("path", "state")


@query("upsert_cascade", DIFF.replace("WITH ", f"WITH {CHUNKS}, ", 1) + """, p AS (SELECT f.path, c.ord, c.text FROM chunks c JOIN files f ON f.file_id = c.file_id)
SELECT path, ord, CASE state WHEN 'unchanged' THEN 'old' ELSE 'new' END AS version FROM p JOIN diff USING (path) WHERE state <> 'removed' AND NOT (state = 'unchanged' AND ord % 3 = 2)""")
def upsert_cascade(spark, d):
    """Chunks after an ingest: those of unchanged files as they were stored (here without every third), those of others anew."""
    states = ingest.diff(stored(spark, d), files(spark, d)).select("path", "state")
    now = chunks(spark, d).join(files(spark, d).select("file_id", "path"), "file_id").select("path", "ord")
    before = now.filter("ord % 3 <> 2").withColumn("version", F.lit("old"))
    gone = files(spark, d).filter("file_id < 40").select(F.concat(F.lit("gone/"), F.col("file_id").cast("string")).alias("path"), F.lit(0).alias("ord"), F.lit("old").alias("version"))
    return ingest.cascade(before.unionByName(gone), states, now.withColumn("version", F.lit("new")))


@query("upsert_files", f"WITH {FILES}, {STORED} SELECT path, sha256, bytes FROM files UNION ALL SELECT path, sha256, bytes FROM stored WHERE path NOT IN (SELECT path FROM files)")
def upsert_files(spark, d):
    return ingest.upsert(stored(spark, d), files(spark, d).select("path", "sha256", "bytes"))


@query("delete_missing_count", DIFF + "SELECT count(*) FILTER (state = 'removed') AS deleted, count(*) FILTER (state <> 'removed' AND state <> 'new') AS left_ FROM diff")
def delete_missing_count(spark, d):
    """How many stored files a deletion of the missing ones takes away, and how many it leaves."""
    x = ingest.diff(stored(spark, d), files(spark, d))
    return x.agg(F.count_if(F.col("state") == "removed").alias("deleted"), F.count_if(~F.col("state").isin("removed", "new")).alias("left_"))


@query("delete_missing_anti", f"WITH {FILES}, {STORED} SELECT path FROM stored WHERE path NOT IN (SELECT path FROM files)")
def delete_missing_anti(spark, d):
    return stored(spark, d).join(files(spark, d).select("path"), "path", "left_anti").select("path")


@query("update_tokens", f"WITH {CHUNKS} SELECT file_id, ord, CASE WHEN file_id = 3 AND ord = 0 THEN 'new tokens' ELSE lower(text) END AS tokens FROM chunks")
def update_tokens(spark, d):
    point = (F.col("file_id") == 3) & (F.col("ord") == 0)
    return chunks(spark, d).select("file_id", "ord", F.when(point, "new tokens").otherwise(F.lower("text")).alias("tokens"))


@query("file_state", f"WITH {FILES} SELECT file_id, path, sha256, bytes FROM files WHERE file_id = 42")
def file_state(spark, d):
    return files(spark, d).filter("file_id = 42")


@query("chunks_for_file", f"WITH {CHUNKS} SELECT ord, text FROM chunks WHERE file_id = 42")
def chunks_for_file(spark, d):
    return chunks(spark, d).filter("file_id = 42").select("ord", "text").orderBy("ord")


@query("files_status", f"WITH {FILES}, {CHUNKS}, c AS (SELECT file_id, count(*) AS n FROM chunks WHERE file_id % 3 <> 0 GROUP BY file_id) SELECT path, n FROM files LEFT JOIN c USING (file_id) ORDER BY path LIMIT 1000")
def files_status(spark, d):
    c = chunks(spark, d).filter("file_id % 3 <> 0").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return files(spark, d).join(c, "file_id", "left").select("path", "n").orderBy("path").limit(1000)


@query("index_stats", f"WITH {FILES}, {CHUNKS} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM chunks) AS chunks, (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM files) AS bytes, (SELECT lang FROM documents ORDER BY doc_id DESC LIMIT 1) AS latest")
def index_stats(spark, d):
    one = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("bytes"), F.max_by("lang", "doc_id").alias("latest"))
    return one.crossJoin(chunks(spark, d).agg(F.count(F.lit(1)).alias("chunks"))).select("files", "chunks", "bytes", "latest")


@query("ext_breakdown", "SELECT lower(regexp_extract('x.' || source, '(\\.[^.]+)$')) AS ext, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def ext_breakdown(spark, d):
    ext = F.lower(F.regexp_extract(F.concat(F.lit("x."), F.col("source")), r"(\.[^.]+)$", 1))
    return table(spark, d, "documents").groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("bytes")).orderBy(F.desc("n"))


@query("bundle_manifest", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes, min(doc_id) AS first FROM documents GROUP BY source")
def bundle_manifest(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("bytes"), F.min("doc_id").alias("first"))


@query("running_byte_cap", "SELECT source, doc_id, CAST(run AS BIGINT) AS run FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM documents) WHERE run <= 20000")
def running_byte_cap(spark, d):
    return running(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", run="n_chars").filter("run <= 20000").select("source", "doc_id", "run")


@query("ingest_progress", "WITH r AS (SELECT source, doc_id, sum(n_chars) OVER w AS live, sum(n_chars) OVER (PARTITION BY source) AS total, row_number() OVER w AS secs FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) SELECT source, doc_id, round(live / secs::DOUBLE, 6) AS rate, round((total - live) / nullif(live / secs::DOUBLE, 0), 6) AS eta, round(100e0 * live / total, 4) AS pct FROM r")
def ingest_progress(spark, d):
    """Bytes a second so far, seconds left and percent done, a document a second."""
    r = running(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", live="n_chars", secs="1L").withColumnRenamed("live_all", "total")
    rate = F.col("live") / F.col("secs")
    return r.select("source", "doc_id", F.round(rate, 6).alias("rate"), F.round(F.try_divide(F.col("total") - F.col("live"), rate), 6).alias("eta"), F.round(F.lit(100.0) * F.col("live") / F.col("total"), 4).alias("pct"))


@query("page_window", "SELECT p_partkey, unnest(range(greatest(1, p_size - 2), least(50, p_size + 2) + 1)) AS page FROM part")
def page_window(spark, d):
    lo, hi = F.greatest(F.lit(1), F.col("p_size") - 2), F.least(F.lit(50), F.col("p_size") + 2)
    return table(spark, d, "part").select("p_partkey", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("page"))


@query("ttl_sweep", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def ttl_sweep(spark, d):
    e = table(spark, d, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).filter(F.col("ts") < F.col("now") - F.expr("INTERVAL 3 DAY")).select("event_id")


SECTIONS = f"WITH {CHUNKS}, s AS (SELECT file_id, ord, text, CASE WHEN ord % 5 = 4 THEN '  ' ELSE 'S' || (ord // 3) || ' ' END AS section, CASE WHEN ord % 4 <> 3 THEN ord + 1 END AS page FROM chunks)"
ISLANDS = SECTIONS + """, t AS (SELECT *, trim(section) AS title, last_value(page IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS seen FROM s),
u AS (SELECT *, lag(title) OVER (PARTITION BY file_id ORDER BY ord) AS prev FROM t),
r AS (SELECT *, sum(CASE WHEN title IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY ord) AS run FROM u),
g AS (SELECT file_id, run, title, min(ord) AS start_ord, max(ord) AS end_ord, arg_min_null(page, ord) AS start_page, arg_max_null(seen, ord) AS end_page FROM r WHERE title <> '' GROUP BY ALL),
ch AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY run) AS INTEGER) AS chapter, title, start_ord, end_ord, start_page, end_page FROM g)
"""


def sections(spark, d):
    """Windows with a section name (blank at times) and a page (missing at times)."""
    name = F.when(F.col("ord") % 5 == 4, "  ").otherwise(F.concat(F.lit("S"), F.floor(F.col("ord") / 3).cast("string"), F.lit(" ")))
    return chunks(spark, d).withColumn("section", name).withColumn("page", F.when(F.col("ord") % 4 != 3, F.col("ord") + 1))


@query("chapters_from_sections", ISLANDS + "SELECT * FROM ch")
def chapters_from_sections(spark, d):
    return expand.section_chapters(sections(spark, d)).select("file_id", "chapter", "title", "start_ord", "end_ord", "start_page", "end_page")


OUTLINE = f"""WITH {CHUNKS}, c AS (SELECT file_id, ord, ord // 2 + 1 AS page FROM chunks),
b AS (SELECT DISTINCT file_id, page AS pos, 'B' || page AS title, page FROM c WHERE page % 2 = 0 UNION SELECT DISTINCT file_id, 100 + page, 'X' || page, page FROM c WHERE page % 4 = 0),
f AS (SELECT file_id, title, page FROM (SELECT *, row_number() OVER (PARTITION BY file_id, page ORDER BY pos) AS n FROM b) WHERE n = 1),
p AS (SELECT file_id, max(page) AS n_pages, min(ord) AS first_ord, max(ord) AS last_ord FROM c GROUP BY file_id),
s AS (SELECT f.*, p.n_pages, p.first_ord, p.last_ord, coalesce(lead(page) OVER (PARTITION BY f.file_id ORDER BY page) - 1, n_pages) AS end_page FROM f JOIN p ON f.file_id = p.file_id),
l AS (SELECT s.file_id, s.title, s.page, s.end_page, s.first_ord, s.last_ord, min(c.ord) AS lo FROM s JOIN c ON c.file_id = s.file_id AND c.page BETWEEN s.page AND s.end_page GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY page) AS chapter FROM l),
q AS (SELECT *, CASE WHEN chapter = 1 THEN first_ord ELSE lo END AS start_ord FROM o)
"""


@query("outline_chapters", OUTLINE + "SELECT file_id, CAST(chapter AS INTEGER) AS chapter, title, start_ord, coalesce(lead(start_ord) OVER (PARTITION BY file_id ORDER BY page) - 1, last_ord) AS end_ord, CAST(page AS BIGINT) AS start_page, CAST(end_page AS BIGINT) AS end_page FROM q")
def outline_chapters(spark, d):
    c = chunks(spark, d).select("file_id", "ord", (F.floor(F.col("ord") / 2) + 1).alias("page"))
    return expand.outline_chapters(_outline(spark, d), c)


def _outline(spark, d):
    """Bookmarks of every second page, and later ones of every fourth, which a page has already."""
    pages = chunks(spark, d).select("file_id", (F.floor(F.col("ord") / 2) + 1).alias("page")).distinct()
    even = pages.filter("page % 2 = 0").select("file_id", F.col("page").alias("pos"), F.concat(F.lit("B"), F.col("page").cast("string")).alias("title"), "page")
    fourth = pages.filter("page % 4 = 0").select("file_id", (F.col("page") + 100).alias("pos"), F.concat(F.lit("X"), F.col("page").cast("string")).alias("title"), "page")
    return even.unionByName(fourth)


@query("detect_chapters", ISLANDS + """, k AS (SELECT file_id, count(*) AS n FROM ch GROUP BY file_id), a AS (SELECT file_id, min(ord) AS lo, max(ord) AS hi, min(page) AS p0, max(page) AS p1 FROM s GROUP BY file_id)
SELECT ch.file_id, chapter, title, start_ord, end_ord FROM ch JOIN k ON ch.file_id = k.file_id WHERE n > 1
UNION ALL SELECT a.file_id, 1, 'Document', lo, hi FROM a LEFT JOIN k ON a.file_id = k.file_id WHERE coalesce(n, 0) <= 1""")
def detect_chapters(spark, d):
    """Section chapters where a file has several, else one chapter for all of it."""
    return expand.dispatched(sections(spark, d))


_COLS = "file_id, chapter, title, start_ord, end_ord"


@query("detect_chapters_outline", "WITH oc AS (" + OUTLINE + """SELECT file_id, CAST(chapter AS INTEGER) AS chapter, title, start_ord, coalesce(lead(start_ord) OVER (PARTITION BY file_id ORDER BY page) - 1, last_ord) AS end_ord FROM q WHERE file_id % 3 = 0),
sc AS (""" + ISLANDS + """SELECT ch.file_id, chapter, title, start_ord, end_ord FROM ch JOIN (SELECT file_id FROM ch GROUP BY file_id HAVING count(*) > 1) USING (file_id)),
""" + CHUNKS + f""" SELECT {_COLS} FROM oc UNION ALL SELECT {_COLS} FROM sc WHERE file_id NOT IN (SELECT file_id FROM oc)
UNION ALL SELECT file_id, 1, 'Document', min(ord), max(ord) FROM chunks WHERE file_id NOT IN (SELECT file_id FROM oc) AND file_id NOT IN (SELECT file_id FROM sc) GROUP BY file_id""")
def detect_chapters_outline(spark, d):
    """Files with bookmarks take their chapters from these, the others from their sections, or are one chapter."""
    s = sections(spark, d).withColumn("page", F.floor(F.col("ord") / 2) + 1)
    return expand.dispatched(s, _outline(spark, d).filter("file_id % 3 = 0"))


#: Every section is a hit of its file's ranked list.
HITS = "hits AS (SELECT file_id, ord, row_number() OVER (PARTITION BY file_id ORDER BY md5(file_id || '-' || ord)) AS rank FROM s)"


def _hits(spark, d):
    h = sections(spark, d).select("file_id", "ord")
    key = F.md5(F.concat(F.col("file_id").cast("string"), F.lit("-"), F.col("ord").cast("string")).cast("binary"))
    return h.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy(key)).cast("long"))


@query("find_chapter", ISLANDS + f", {HITS}, j AS (SELECT h.file_id, h.ord, c.chapter, c.title, row_number() OVER (PARTITION BY h.file_id, h.ord ORDER BY c.chapter) AS n FROM hits h LEFT JOIN ch c ON c.file_id = h.file_id AND h.ord BETWEEN c.start_ord AND c.end_ord) SELECT file_id, ord, chapter, title FROM j WHERE n = 1")
def find_chapter(spark, d):
    return expand.find_chapter(_hits(spark, d), expand.section_chapters(sections(spark, d))).select("file_id", "ord", "chapter", "title")


@query("expand_to_chapter", ISLANDS + f""", {HITS}, j AS (SELECT h.file_id, h.ord, h.rank, c.chapter, c.title FROM hits h LEFT JOIN ch c ON c.file_id = h.file_id AND h.ord BETWEEN c.start_ord AND c.end_ord),
k AS (SELECT *, CASE WHEN title IS NOT NULL THEN row_number() OVER (PARTITION BY file_id, title ORDER BY rank) END AS turn FROM j),
whole AS (SELECT c.file_id, c.chapter, string_agg(s.text, chr(10) || chr(10) ORDER BY s.ord) AS whole FROM ch c JOIN s ON s.file_id = c.file_id AND s.ord BETWEEN c.start_ord AND c.end_ord AND s.text <> '' GROUP BY ALL)
SELECT k.file_id, k.ord, k.rank, k.title, CASE WHEN k.title IS NULL THEN 'none' WHEN turn > 1 THEN 'chapter-dup' WHEN length(whole) > 16000 THEN 'chapter-skip' ELSE 'chapter' END AS kind, length(whole) AS n FROM k LEFT JOIN whole t ON t.file_id = k.file_id AND t.chapter = k.chapter""")
def expand_to_chapter(spark, d):
    s = sections(spark, d)
    found = expand.expand_chapters(_hits(spark, d), s, expand.section_chapters(s), 16_000)
    return found.select("file_id", "ord", "rank", "title", "kind", F.length("whole").cast("long").alias("n"))
