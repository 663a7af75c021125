"""Text queries: normalising, tokens, predicates and parsers of model replies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.sources.tables import table

from .registry import CHUNKS, query


def values(*rows: tuple) -> str:
    """SQL VALUES of rows, for the twins of small fixtures."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SPACED = r"regexp_replace(regexp_replace(replace(text, chr(0), ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


def collapse_sql(of: str) -> str:
    """SQL of tables up to k (doc_id, pos, s): the lines of ``of`` (doc_id, text), runs of equal short ones as one."""
    return rf"""l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {of}),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM l),
y AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS v FROM x),
z AS (SELECT *, sum(CASE WHEN v IS NOT DISTINCT FROM pv AND pos > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY pos) AS pv FROM y)),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS i FROM z),
k AS (SELECT doc_id, pos, CASE WHEN v <> '' AND length(v) <= 12 AND n >= 6 THEN CASE WHEN i = 1 THEN regexp_extract(line, '^\s*') || v || ' (×' || n || ')' END ELSE line END AS s FROM g)"""


@query("normalize_text", f"WITH spaced AS (SELECT doc_id, {SPACED} AS text FROM documents), {collapse_sql('spaced')}, j AS (SELECT doc_id, {STRIP.format('string_agg(s, chr(10) ORDER BY pos)')} AS t FROM k GROUP BY doc_id) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM j")
def normalize_text(spark, d):
    n = table(spark, d, "documents").select("doc_id", tx.normalised(F.col("text")).alias("n"))
    return n.select("doc_id", F.length("n").cast("long").alias("n"), F.md5(F.col("n").cast("binary")).alias("digest"))


@query("tokenize", r"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''\-]*'), lambda x: lower(x)), ' ')) AS digest, len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''\-]*')) AS n FROM documents")
def tokenize(spark, d):
    t = tx.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(t, " ").cast("binary")).alias("digest"), F.size(t).cast("long").alias("n"))


@query("ws_collapse", r"SELECT doc_id, md5(regexp_replace(text, '\s+', ' ', 'g')) AS digest FROM documents")
def ws_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.regexp_replace("text", r"\s+", " ").cast("binary")).alias("digest"))


@query("garbled", rf"""WITH t AS (SELECT doc_id, {STRIP.format('text')} AS t FROM documents),
m AS (SELECT doc_id, length(t)::DOUBLE AS n, len(regexp_extract_all(t, '\x{{FFFD}}'))::DOUBLE AS rep, len(regexp_extract_all(t, '\\'))::DOUBLE AS back, len(regexp_extract_all(t, '\p{{L}}'))::DOUBLE AS letters,
len(regexp_extract_all(lower(t), '[aeiou]'))::DOUBLE AS vowels, len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\s]'))::DOUBLE AS signs FROM t)
SELECT doc_id, coalesce(n >= 40 AND (rep / n > 0.02 OR back / n > 0.025 OR (letters > 50 AND vowels / letters < 0.20) OR signs / n > 0.45), false) AS garbled FROM m""")
def garbled(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(tx.garbled(F.col("text")), F.lit(False)).alias("garbled"))


TOC_TEXT = "regexp_replace(text, ' ', chr(10), 'g')"


@query("toc_fragment", rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[a-z]{{6,}}', '12', 'g'), '[ ]', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
m AS (SELECT doc_id, len(ls)::DOUBLE AS n, len(list_filter(ls, lambda x: length(x) <= 25)) AS short, len(list_filter(ls, lambda x: regexp_full_match(x, '\.*\s*[0-9]{{1,4}}'))) AS nums, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS total FROM l)
SELECT doc_id, coalesce(n >= 6 AND short / n > 0.40 AND nums / n > 0.15 AND total / n < 22, false) AS toc FROM m""")
def toc_fragment(spark, d):
    """On documents whose words are laid out one to a line, the long ones as numbers."""
    t = F.regexp_replace(F.regexp_replace("text", "[a-z]{6,}", "12"), "[ ]", "\n")
    return table(spark, d, "documents").select("doc_id", F.coalesce(tx.toc_fragment(t), F.lit(False)).alias("toc"))


@query("is_list_query", "SELECT conv_id, turn, " + " OR ".join(f"contains(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '{p}')" for p in tx.LIST_PHRASES) + " AS is_list FROM conversations")
def is_list_query(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.is_list_query(F.col("text")).alias("is_list"))


@query("collapse_table_runs", f"WITH laid AS (SELECT doc_id, regexp_replace(text, ' ', chr(10), 'g') AS text FROM documents), {collapse_sql('laid')} SELECT doc_id, count(s) AS lines, md5(string_agg(s, chr(10) ORDER BY pos)) AS digest FROM k GROUP BY doc_id")
def collapse_table_runs(spark, d):
    from docmill.operators.lines import collapse_runs

    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", " ", "\n").alias("text"))
    return collapse_runs(docs, "doc_id", "text").select("doc_id", "lines", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("strip_tags", r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tx.without_tags(F.col("html")).cast("binary")).alias("digest"))


@query("slugify", r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[^\p{L}\p{N} ._-]', '-', 'g'), '-+', '-', 'g'), '^[- .]+|[- .]+$', '', 'g') AS s FROM pages)
SELECT page_id, CASE WHEN s = '' THEN 'rag' ELSE s END AS slug FROM s""")
def slugify(spark, d):
    return table(spark, d, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("truncate_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '…' ELSE text END AS head FROM documents")
def truncate_ellipsis(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.ellipsis(F.col("text"), 600).alias("head"))


@query("content_hash", "SELECT doc_id, sha256(text) AS sha, substr(sha256(source || '/' || doc_id), 1, 16) AS path_key FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.sha2(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), 256), 1, 16).alias("path_key"))


@query("keyword_hits", "SELECT doc_id, len(list_filter(['the', 'and', 'que', 'der'], lambda k: contains(lower(text), k))) AS hits FROM documents")
def keyword_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.array(*map(F.lit, ["the", "and", "que", "der"])), lambda k: F.contains(F.lower("text"), k))).cast("long").alias("hits"))


@query("substring_groups", """SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'and') AND ((contains(lower(text), 'was') AND contains(lower(text), 'that')) OR contains(lower(text), 'read')) AS hit FROM documents""")
def substring_groups(spark, d):
    """All required parts, and all parts of some group."""
    low = F.lower("text")
    must = F.array(*map(F.lit, ["the", "and"]))
    groups = F.array(F.array(F.lit("was"), F.lit("that")), F.array(F.lit("read")))
    hit = F.forall(must, lambda p: F.contains(low, p)) & F.exists(groups, lambda g: F.forall(g, lambda p: F.contains(low, p)))
    return table(spark, d, "documents").select("doc_id", hit.alias("hit"))


@query("score_gold", """SELECT doc_id, (contains(lower(text), 'the') OR contains(lower(text), 'les'))::INT + (contains(lower(text), 'with'))::INT + (contains(lower(text), 'que') OR contains(lower(text), 'zur'))::INT AS score,
array_to_string(list_filter([CASE WHEN NOT (contains(lower(text), 'the') OR contains(lower(text), 'les')) THEN 'the' END, CASE WHEN NOT contains(lower(text), 'with') THEN 'with' END, CASE WHEN NOT (contains(lower(text), 'que') OR contains(lower(text), 'zur')) THEN 'que' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents""")
def score_gold(spark, d):
    """Groups of synonyms of which one is present; of the others, the first synonym."""
    groups = F.array(*[F.array(*map(F.lit, g)) for g in (["the", "les"], ["with"], ["que", "zur"])])
    has = lambda g: F.exists(g, lambda s: F.contains(F.lower("text"), s))
    missing = F.transform(F.filter(groups, lambda g: ~has(g)), lambda g: g[0])
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(groups, has)).alias("score"), F.array_join(missing, ",").alias("missing"))


@query("ocr_cer", "SELECT p_partkey, round(levenshtein(p_name, p_type) / greatest(1, length(p_name))::DOUBLE, 4) AS cer FROM part")
def ocr_cer(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.levenshtein("p_name", "p_type") / F.greatest(F.lit(1), F.length("p_name")), 4).alias("cer"))


ERRS = tuple((i, t) for i, t in enumerate(("unable to load model x", "CUDA out of memory", "prompt is too long", "HTTP 404", "model foo not found", "Connection refused", "something else", "", None, "502 Bad Gateway: context length")))


@query("classify_error", f"""WITH e AS (SELECT * FROM ({values(*ERRS)}) AS t(id, body)), l AS (SELECT id, lower(coalesce(body, '')) AS b FROM e)
SELECT id, CASE WHEN contains(b, 'unable to load model') THEN 'load_failure' WHEN contains(b, 'out of memory') OR contains(b, 'oom') OR contains(b, 'failed to allocate') THEN 'oom'
WHEN contains(b, 'context length') OR contains(b, 'context_length') OR contains(b, 'exceeds context') OR contains(b, 'n_ctx') OR contains(b, 'input too long') OR contains(b, 'prompt is too long') THEN 'context_overflow'
WHEN contains(b, '404') OR contains(b, 'no such model') OR (contains(b, 'not found') AND contains(b, 'model')) THEN 'model_not_found'
WHEN contains(b, 'connection refused') OR contains(b, 'all connection attempts failed') OR contains(b, '503 service') OR contains(b, '502 bad gateway') THEN 'server_down' ELSE 'generic' END AS kind FROM l""")
def classify_error(spark, d):
    return spark.createDataFrame(ERRS, "id int, body string").select("id", tx.error_class(F.col("body")).alias("kind"))


REPLIES = ((1, "Addresses = 3, specificity=2\ngrounded=9 on_topic = 1"), (2, "addresses=1"), (3, "x ADDRESSES=0 SPECIFICITY=0 GROUNDED=3 ON_TOPIC=3 y"))


JUDGE = r"(?is)addresses\s*=\s*(\d).*?specificity\s*=\s*(\d).*?grounded\s*=\s*(\d).*?on_topic\s*=\s*(\d)"
MARKS = ", ".join(f"TRY_CAST(nullif(regexp_extract(reply, '{JUDGE}', {g}), '') AS INTEGER) AS m{g}" for g in (1, 2, 3, 4))
CAPPED = ["CASE WHEN m%d IS NOT NULL THEN least(3, m%d) END" % (g, g) for g in (1, 2, 3, 4)]


@query("judge_parse", f"""WITH r AS (SELECT * FROM ({values(*REPLIES)}) AS t(id, reply)), m AS (SELECT id, {MARKS} FROM r)
SELECT id, {CAPPED[0]} AS addresses, {CAPPED[1]} AS specificity, {CAPPED[2]} AS grounded, {CAPPED[3]} AS on_topic, {' + '.join(CAPPED)} AS total, m1 IS NULL AS unparseable FROM m""")
def judge_parse(spark, d):
    a, s, g, o = tx.judge_scores(F.col("reply"))
    return spark.createDataFrame(REPLIES, "id int, reply string").select("id", a.alias("addresses"), s.alias("specificity"), g.alias("grounded"), o.alias("on_topic"), (a + s + g + o).alias("total"), a.isNull().alias("unparseable"))


THINK = ((1, "<think>a\nb</think> answer"), (2, "<think>only"), (3, "<think>x</think>"), (4, "plain"), (5, "a <think>b</think> c </think> d"))
_TH = r"regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g')"


@query("strip_thinking", rf"""WITH r AS (SELECT * FROM ({values(*THINK)}) AS v(id, t)), c AS (SELECT id, t, {_TH} AS clean, regexp_replace(string_split(t, '</think>')[-1], '^\s+|\s+$', '', 'g') AS tail FROM r)
SELECT id, CASE WHEN clean <> '' THEN regexp_replace(regexp_replace(clean, '</?think>', '', 'g'), '^\s+|\s+$', '', 'g') WHEN contains(t, '</think>') AND tail <> '' THEN tail ELSE regexp_replace(regexp_replace(t, '</?think>', '', 'g'), '^\s+|\s+$', '', 'g') END AS answer FROM c""")
def strip_thinking(spark, d):
    return spark.createDataFrame(THINK, "id int, t string").select("id", tx.without_thinking(F.col("t")).alias("answer"))


LINES = ((1, "1. How does it work?\n- \"What is that\"\n\nq one\n* third 'x'"), (2, "q one\nQ ONE\n- a\n- b\n- c\n- d"))


@query("clean_lines", rf"""WITH r AS (SELECT * FROM ({values(*LINES)}) AS v(id, t)), l AS (SELECT id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[-•*0-9. ]+|[-•*0-9. ]+$', '', 'g'), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')), lambda x: x <> '' AND lower(x) <> 'q one') AS ls FROM r)
SELECT id, array_to_string(ls[1:3], '|') AS lines FROM l""")
def clean_lines(spark, d):
    return spark.createDataFrame(LINES, "id int, t string").select("id", F.array_join(tx.list_lines(F.col("t"), F.lit("q one"), 3), "|").alias("lines"))


SUGGESTED = ((1, "1) Summarize the files\n- \"What about the fee schedule?\"\n3. short\n\nWhat topics are covered?\n* Who signed the lease in 2019"), (2, "a\nList the documents and their main points.\n- Which parts are new 7.)"))


@query("suggestion_lines", rf"""WITH r AS (SELECT * FROM ({values(*SUGGESTED)}) AS v(id, t)), l AS (SELECT id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[-•*0-9.) ]+|[-•*0-9.) ]+$', '', 'g'), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')), lambda x: length(x) >= 8 AND NOT starts_with(lower(x), 'summarize ') AND lower(x) NOT IN ('what topics are covered?', 'list the documents and their main points.')) AS ls FROM r)
SELECT id, array_to_string(ls[1:3], '|') AS lines FROM l""")
def suggestion_lines(spark, d):
    """Questions that a model suggests, without marks, and without those that fit any corpus."""
    return spark.createDataFrame(SUGGESTED, "id int, t string").select("id", F.array_join(tx.suggestions(F.col("t"), 3), "|").alias("lines"))


TWICE = ((1, "", "second"), (2, "first", "second"), (3, "  ", ""), (4, None, "late"))


@query("answer_retry", f"SELECT id, CASE WHEN trim(coalesce(a, '')) <> '' THEN a ELSE coalesce(b, '') END AS answer, trim(coalesce(a, '')) = '' AS retried FROM ({values(*TWICE)}) AS v(id, a, b)")
def answer_retry(spark, d):
    """An empty answer is asked for once more."""
    empty = F.trim(F.coalesce("a", F.lit(""))) == ""
    return spark.createDataFrame(TWICE, "id int, a string, b string").select("id", F.when(~empty, F.col("a")).otherwise(F.coalesce("b", F.lit(""))).alias("answer"), empty.alias("retried"))


FENCES = ((1, "```json\n{\"a\": 1}\n```"), (2, "no fence"), (3, "```\nx\ny"), (4, "  ```py\nz```  "))


@query("strip_fences", rf"""WITH r AS (SELECT * FROM ({values(*FENCES)}) AS v(id, t))
SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^```[^\n]*\n?', ''), '\n?```\s*$', ''), '^\s+|\s+$', '', 'g') AS body FROM r""")
def strip_fences(spark, d):
    return spark.createDataFrame(FENCES, "id int, t string").select("id", tx.without_fences(F.col("t")).alias("body"))


VERDICTS = ((1, " Clean. It reads well"), (2, "GARBLED"), (3, "maybe"), (4, "partial!!"))


@query("verdict_parse", rf"""WITH r AS (SELECT * FROM ({values(*VERDICTS)}) AS v(id, t)), w AS (SELECT id, regexp_replace(lower(regexp_split_to_array(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\s+')[1]), '[.,:;!?]+$', '') AS w FROM r)
SELECT id, CASE WHEN w IN ('clean', 'garbled', 'partial') THEN w ELSE 'unknown' END AS verdict FROM w""")
def verdict_parse(spark, d):
    return spark.createDataFrame(VERDICTS, "id int, t string").select("id", tx.verdict(F.col("t")).alias("verdict"))


FIXES = ((1, "UNRECOVERABLE text"), (2, "short"), (3, "This passage appears to be about dogs."), (4, "A good correction of the whole page."), (5, "```\nA good correction in a fence, long enough\n```"))


@query("accept_correction", rf"""WITH r AS (SELECT * FROM ({values(*FIXES)}) AS v(id, t)), c AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^```[^\n]*\n?', ''), '\n?```\s*$', ''), '^\s+|\s+$', '', 'g') AS c FROM r)
SELECT id, c <> '' AND NOT starts_with(upper(c), 'UNRECOVERABLE') AND length(c) >= 20 AND NOT (starts_with(lower(c), 'this passage') OR starts_with(lower(c), 'the passage') OR starts_with(lower(c), 'this text') OR starts_with(lower(c), 'the text') OR starts_with(lower(c), 'here is') OR starts_with(lower(c), 'i cannot')) AS accepted FROM c""")
def accept_correction(spark, d):
    return spark.createDataFrame(FIXES, "id int, t string").select("id", tx.acceptable_correction(F.col("t")).alias("accepted"))


@query("placeholder_sub", "SELECT p_partkey, replace(replace('{{name}} by {{brand}}', '{{name}}', p_name), '{{brand}}', p_brand) AS line FROM part")
def placeholder_sub(spark, d):
    parts = F.array(F.struct(F.lit("{{name}}").alias("k"), F.col("p_name").alias("v")), F.struct(F.lit("{{brand}}").alias("k"), F.col("p_brand").alias("v")))
    return table(spark, d, "part").select("p_partkey", F.aggregate(parts, F.lit("{{name}} by {{brand}}"), lambda a, x: F.replace(a, x["k"], x["v"])).alias("line"))


@query("crag_filter", r"""WITH r AS (SELECT * FROM (VALUES (1, 'keep 2, 5 and 99'), (2, 'no idea'), (3, '1 1 3'), (4, 'None of them')) AS t(qid, reply)),
p AS (SELECT qid, regexp_extract_all(lower(reply), '\d+') AS ids FROM r), h AS (SELECT qid, unnest(range(1, 9)) AS rank FROM r)
SELECT h.qid, CAST(h.rank AS INTEGER) AS rank FROM h JOIN p USING (qid) WHERE (len(ids) = 0 AND qid <> 4) OR list_contains(ids, CAST(h.rank AS VARCHAR))""")
def crag_filter(spark, d):
    """Hits whose number a model's reply names, in their order; all where it names none, no hit where it says ``none``."""
    r = spark.createDataFrame([(1, "keep 2, 5 and 99"), (2, "no idea"), (3, "1 1 3"), (4, "None of them")], "qid int, reply string")
    ids = F.transform(F.regexp_extract_all(F.lower("reply"), F.lit(r"(\d+)")), lambda x: x.cast("int"))
    hits = r.select("qid", F.contains(F.lower("reply"), F.lit("none")).alias("none"), ids.alias("ids"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("rank"))
    return hits.filter(((F.size("ids") == 0) & ~F.col("none")) | F.array_contains("ids", F.col("rank"))).select("qid", "rank")


@query("section_context", f"""WITH {CHUNKS} SELECT file_id, ord, right(lag(text) OVER w, 400) AS before, left(lead(text) OVER w, 400) AS after FROM chunks WINDOW w AS (PARTITION BY file_id ORDER BY ord)""")
def section_context(spark, d):
    from docmill.sources.tables import chunks

    w = Window.partitionBy("file_id").orderBy("ord")
    return chunks(spark, d).select("file_id", "ord", F.right(F.lag("text").over(w), F.lit(400)).alias("before"), F.left(F.lead("text").over(w), F.lit(400)).alias("after"))


@query("chunk_overlap", f"""WITH {CHUNKS}, p AS (SELECT file_id, ord, text, lag(string_split(text, ' ')) OVER (PARTITION BY file_id, ord // 3 ORDER BY ord) AS last FROM chunks)
SELECT file_id, ord, md5(CASE WHEN last IS NULL THEN text ELSE array_to_string(last[greatest(1, len(last) - 47):], ' ') || ' ' || text END) AS digest FROM p""")
def chunk_overlap(spark, d):
    """Each piece with the last 48 words of the piece before it in its section."""
    from docmill.sources.tables import chunks

    w = Window.partitionBy("file_id", F.floor(F.col("ord") / 3)).orderBy("ord")
    last = F.split(F.lag("text").over(w), " ")
    tail = F.slice("last", F.greatest(F.lit(1), F.size("last") - 47), F.lit(48))
    with_last = chunks(spark, d).withColumn("last", last)
    return with_last.select("file_id", "ord", F.md5(F.when(F.col("last").isNull(), F.col("text")).otherwise(F.concat(F.array_join(tail, " "), F.lit(" "), F.col("text"))).cast("binary")).alias("digest"))


@query("excerpt_budget", f"""WITH {CHUNKS}, r AS (SELECT file_id, ord, length(text) AS n, sum(length(text)) OVER (PARTITION BY file_id ORDER BY ord) AS run FROM chunks),
f AS (SELECT file_id, min(CASE WHEN run > 3500 THEN ord END) AS over FROM r GROUP BY file_id)
SELECT file_id, ord, n, CAST(run AS BIGINT) AS run FROM r JOIN f USING (file_id) WHERE over IS NULL OR ord < over""")
def excerpt_budget(spark, d):
    """The first pieces of a file up to the first one that overflows 3,500 characters."""
    from docmill.sources.tables import chunks

    w = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    r = chunks(spark, d).select("file_id", "ord", F.length("text").cast("long").alias("n")).withColumn("run", F.sum("n").over(w))
    over = F.min(F.when(F.col("run") > 3500, F.col("ord"))).over(Window.partitionBy("file_id"))
    return r.withColumn("over", over).filter("over IS NULL OR ord < over").select("file_id", "ord", "n", "run")


@query("tolerant_json")
def tolerant_json(spark, d):
    """The first brace-balanced object in a reply, fences and prose around it ignored."""
    from docmill.functions.tolerant import first_object

    rows = [(1, 'sure: {"x": 1} ok'), (2, "not even close"), (3, '```json\n{"a": {"b": "}"}}\n```'), (4, None)]
    return spark.createDataFrame(rows, "id int, reply string").select("id", first_object("reply").alias("object"))
