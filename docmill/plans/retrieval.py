"""Retrieval queries over documents, their windows and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions.text import let, tokens
from docmill.operators import lexical, ranking, retrieve, text_index, vector_index, vectors
from docmill.scratch import stored
from docmill.sources.tables import chunks, files, table

from .registry import CHUNKS, FILES, query

#: The batch of questions: what users say in the conversations whose id is divisible by 50, whole, each with the vector of that id.
Q_SQL = "q AS (SELECT conv_id * 1000 + turn AS qid, text AS question, conv_id AS vec_id FROM conversations WHERE role = 'user' AND conv_id % 50 = 0)"
#: The same of all conversations.
ALL_Q_SQL = Q_SQL.replace(" AND conv_id % 50 = 0", "")
#: Entity terms that are added to the tokens of the texts that hold them.
ENTITIES = ("The", "That", "Und", "Les", "the", "Zebra")


def questions(spark, d):
    return all_questions(spark, d).filter("vec_id % 50 = 0")


def all_questions(spark, d):
    """What users say in all conversations."""
    c = table(spark, d, "conversations").filter("role = 'user'")
    return c.select((F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"), F.col("conv_id").alias("vec_id"))


def boost(text, terms=None):
    """Entity terms that the text holds, in lower case, once each, in order."""
    known = F.array(*map(F.lit, ENTITIES)) if terms is None else terms
    held = let(F.lower(text), lambda low: F.filter(known, lambda t: F.contains(low, F.lower(t))))  # the text is put in lower case once
    return F.array_distinct(F.transform(held, lambda t: F.lower(t)))


def _two_columns(docs):
    """Both indexed columns: the text, and its tokens with the entity terms that it holds."""
    text = F.col("text")
    return docs.select("doc_id", "text", F.array_join(F.concat(tokens(text), boost(text)), " ").alias("tokens"))


def indexed(spark, d):
    return _two_columns(table(spark, d, "documents"))


TERMS_SQL = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
INDEXED_SQL = r"list_concat(" + TERMS_SQL.format("text") + ", " + TERMS_SQL.format(r"array_to_string(list_concat(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''\-]*'), lambda x: lower(x)), list_filter(['the', 'that', 'und', 'les', 'zebra'], lambda t: contains(lower(text), t))), ' ')") + ")"
TERMS = rf"""
t AS (SELECT doc_id, {INDEXED_SQL} AS ts FROM documents),
size AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({TERMS_SQL.format('question')}) AS term FROM q) GROUP BY ALL),
x AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM t),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
"""
BM25 = TERMS + """,
bm AS (SELECT qid, doc_id, sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))) AS score
  FROM tf JOIN df USING (term) CROSS JOIN size JOIN qt USING (term) GROUP BY ALL)
"""
VEC = """
vq AS (SELECT q.qid, CAST(e.embedding AS DOUBLE[]) AS qvec FROM q JOIN embeddings e USING (vec_id)),
vs AS (SELECT qid, vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qvec) AS score FROM embeddings CROSS JOIN vq)
"""


def index_of(spark, d):
    """The stored index of the documents."""
    return text_index.opened(spark, f"{d}/documents", spark.read.parquet(f"{d}/documents.parquet"), indexed(spark, d), "text", "tokens")


def _bm25(spark, d, k, batch=None, **constants):
    return index_of(spark, d).top_k(questions(spark, d) if batch is None else batch, k, **constants)


def _vec(spark, d, k, batch=None):
    e = table(spark, d, "embeddings")
    batch = questions(spark, d) if batch is None else batch
    return vectors.top_k(e.withColumnRenamed("vec_id", "doc_id"), e.join(batch.select("qid", "vec_id"), "vec_id").select("qid", F.col("embedding").alias("qvec")), "doc_id", k)


@query("fts_terms", f"WITH {Q_SQL} SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({TERMS_SQL.format('question')}) AS term FROM q) GROUP BY ALL")
def fts_terms(spark, d):
    return lexical.query_terms(questions(spark, d))


@query("build_bm25_index", f"""
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({INDEXED_SQL}) AS term FROM documents) GROUP BY ALL)
GROUP BY term""")
def build_bm25_index(spark, d):
    return lexical.term_figures(indexed(spark, d), "text", "tokens")


@query("bm25_topk", f"""WITH {Q_SQL}, {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 20""")
def bm25_topk(spark, d):
    return _bm25(spark, d, 20).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


#: After an upkeep: every fifth text is another one, every seventh document is gone, some are new.
KEPT_SQL = """kept AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lang || ' ' || source || ' ' || text || ' anew' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3
  UNION ALL SELECT 1000000000 + doc_id, text FROM documents WHERE doc_id % 11 = 0)"""


@query("index_upkeep", f"""WITH {Q_SQL}, {KEPT_SQL}, {BM25.replace('FROM documents', 'FROM kept')}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 20""")
def index_upkeep(spark, d):
    """A search after files were changed, removed and added: the index takes the changes in, two commits behind the first."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    index = text_index.temporary(spark, "text", "tokens")
    index.refresh(_two_columns(docs))
    other = F.when(F.col("doc_id") % 5 == 0, F.concat_ws(" ", "lang", "source", "text", F.lit("anew"))).otherwise(F.col("text"))
    here = docs.filter("doc_id % 7 <> 3").withColumn("text", other).select("doc_id", "text")
    index.refresh(_two_columns(here))
    index.apply(_two_columns(docs.filter("doc_id % 11 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text")))
    return index.top_k(questions(spark, d), 20).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("bm25_okapi_topk", f"""WITH {Q_SQL}, {TERMS},
bm AS (SELECT qid, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))) AS score
  FROM tf JOIN df USING (term) CROSS JOIN size JOIN qt USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm WHERE score > 0)
SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 20""")
def bm25_okapi_topk(spark, d):
    return _bm25(spark, d, 20, k1=1.5, plus_one=True).filter("score > 0").select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("vector_topk", f"""WITH vq AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qvec FROM embeddings WHERE vec_id % 50 = 0), {VEC.split('),', 1)[1]},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM vs)
SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 20""")
def vector_topk(spark, d):
    """Every vector whose id is divisible by 50 against all vectors."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return vectors.top_k(e.withColumnRenamed("vec_id", "doc_id"), q, "doc_id", 20).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


VECTOR_LISTS = f"""WITH vq AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qvec FROM embeddings WHERE vec_id % 50 = 0), {VEC.split('),', 1)[1]},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM vs)"""


def vector_index_of(spark, d):
    """An index of the vectors, half of them built and the other half taken in behind it."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    index = vector_index.temporary(spark)
    index.build(e.filter("doc_id % 2 = 0"))
    index.apply(e.filter("doc_id % 2 = 1"))
    return index, e.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("qvec"))


@query("vector_index_topk", VECTOR_LISTS + " SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 20")
def vector_index_topk(spark, d):
    """The exact search by way of all lists of the index."""
    index, q = vector_index_of(spark, d)
    return index.top_k(q, 20, probes=None).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("vector_index_recall", VECTOR_LISTS + " SELECT qid, count(*) AS found, true AS enough FROM r WHERE rank <= 20 GROUP BY qid")
def vector_index_recall(spark, d):
    """Searches of some lists against all rows: hits for each query, and whether the batch finds nine tenths of what the exact search finds."""
    index, q = vector_index_of(spark, d)
    some, all_ = (stored(index.top_k(q, 20, probes=n).select("qid", "doc_id"), "found") for n in (0, None))
    both = some.join(all_, ["qid", "doc_id"]).agg(F.count(F.lit(1)).alias("both")).crossJoin(all_.agg(F.count(F.lit(1)).alias("all")))
    enough = both.select((F.col("both") >= 0.9 * F.col("all")).alias("enough"))
    return some.groupBy("qid").agg(F.count(F.lit(1)).alias("found")).crossJoin(F.broadcast(enough))


@query("scan_embeddings", "SELECT vec_id, len(embedding) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first, label FROM embeddings")
def scan_embeddings(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), "label")


@query("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS squares, round(CAST(embedding[2] AS DOUBLE) / (sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) + 1e-12), 6) AS second FROM embeddings")
def l2_normalize(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("squares"), F.round(vectors.unit(F.col("v"))[1], 6).alias("second"))


@query("vector_pad", "SELECT vec_id, 70 AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, round(list_sum(CAST(embedding[1:10] AS DOUBLE[])), 6) AS head FROM embeddings")
def vector_pad(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), 6)
    long = vectors.padded(F.col("v"), 70)
    return v.select("vec_id", F.size(long).alias("width"), total(long).alias("total"), total(vectors.padded(F.col("v"), 10)).alias("head"))


RANKED = f"""WITH {Q_SQL}, {BM25}, {VEC},
fr AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm) WHERE rank <= 30),
vr AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM vs) WHERE rank <= 30),
fused AS (SELECT coalesce(v.qid, f.qid) AS qid, coalesce(v.doc_id, f.doc_id) AS doc_id, v.rank AS vec_rank, f.rank AS fts_rank, v.score AS vec_score, f.score AS fts_score,
  coalesce(1e0 / (60 + v.rank), 0e0) + coalesce(1e0 / (60 + f.rank), 0e0) AS rrf FROM vr v FULL OUTER JOIN fr f ON v.qid = f.qid AND v.doc_id = f.doc_id),
hy AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, vec_rank IS NULL, coalesce(vec_rank, fts_rank)) AS rank FROM fused)
"""


def hybrid(spark, d, k=8, fetch=30, batch=None):
    """Both ranked lists, fused: qid, doc_id, rank, rrf, ranks and scores, kind."""
    return ranking.fuse(_vec(spark, d, fetch, batch), _bm25(spark, d, fetch, batch), "doc_id", k)


@query("rrf_fusion", RANKED + "SELECT qid, doc_id, round(rrf, 9) AS rrf FROM fused")
def rrf_fusion(spark, d):
    return ranking.rrf([_vec(spark, d, 30), _bm25(spark, d, 30)], "doc_id").select("qid", "doc_id", F.round("rrf", 9).alias("rrf"))


KIND_SQL = """greatest(coalesce(vec_score, 0), coalesce(fts_score, 0)) AS score,
CASE WHEN coalesce(round(vec_score, 9), 0) > 0 AND coalesce(round(fts_score, 9), 0) > 0 THEN 'hybrid' WHEN coalesce(round(vec_score, 9), 0) > 0 THEN 'vec' ELSE 'fts' END AS kind"""


@query("hybrid_search", RANKED + f"""SELECT qid, doc_id, rank, vec_rank, fts_rank, rrf, round(score, 6) AS score, kind FROM (SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, CAST(vec_rank AS INTEGER) AS vec_rank,
CAST(fts_rank AS INTEGER) AS fts_rank, round(rrf, 9) AS rrf, {KIND_SQL} FROM hy WHERE rank <= 8)""")
def hybrid_search(spark, d):
    return hybrid(spark, d).select("qid", "doc_id", "rank", "vec_rank", "fts_rank", F.round("rrf", 9).alias("rrf"), F.round("score", 6).alias("score"), "kind")


@query("diversify_by_source", RANKED + """, h AS (SELECT h.qid, h.doc_id, h.rank, d.source FROM hy h JOIN documents d USING (doc_id) WHERE h.rank <= 20),
s AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS n FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n > 1, rank) AS new_rank FROM s)
SELECT qid, doc_id, source, CAST(rank AS INTEGER) AS rank, CAST(new_rank AS INTEGER) AS new_rank FROM o WHERE new_rank <= 8""")
def diversify_by_source(spark, d):
    hits = ranking.with_rows(hybrid(spark, d, 20), table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return ranking.diversify(hits, "source", 1, 8).select("qid", "doc_id", "source", "rank", "new_rank")


@query("reorder_attention", RANKED + """, h AS (SELECT qid, doc_id, rank, count(*) OVER (PARTITION BY qid) AS n FROM hy WHERE rank <= 8)
SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, CAST(CASE WHEN n <= 2 THEN rank - 1 WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE n - 1 - (rank - 2) // 2 END AS BIGINT) AS position FROM h""")
def reorder_attention(spark, d):
    return ranking.attention_order(hybrid(spark, d)).select("qid", "doc_id", "rank", "position")


RERANK = RANKED + r""", h AS (SELECT h.qid, h.doc_id, h.rank, q.question, d.text FROM hy h JOIN documents d USING (doc_id) JOIN q USING (qid) WHERE h.rank <= 30),
s AS (SELECT qid, doc_id, rank, list_distinct(regexp_extract_all(strip_accents(lower(question)), '[\p{L}\p{N}]+')) AS qt, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS tt FROM h),
o AS (SELECT qid, doc_id, rank, len(list_intersect(qt, tt)) / greatest(1, len(qt))::DOUBLE AS overlap FROM s),
rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, rank) AS new_rank FROM o)
"""


@query("rerank_lexical", RERANK + "SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, round(overlap, 6) AS overlap, CAST(new_rank AS INTEGER) AS new_rank FROM rr WHERE new_rank <= 8")
def rerank_lexical(spark, d):
    hits = ranking.with_rows(hybrid(spark, d, 30), table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return ranking.rerank(hits, questions(spark, d), "text", 8).select("qid", "doc_id", "rank", F.round("overlap", 6).alias("overlap"), "new_rank")


def mmr_sql(candidates: str) -> str:
    """SQL of tables up to chosen (qid, doc_id, fr) from cand (qid, doc_id, rank, rel, v): greedy choice of eight, one step of recursion each."""
    return f"""cand AS ({candidates}), cn AS (SELECT qid, count(*) AS n FROM cand GROUP BY qid),
sim AS (SELECT a.qid, a.doc_id AS a, b.doc_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM cand a JOIN cand b ON a.qid = b.qid),
st AS (SELECT qid, 1 AS step, [arg_max(doc_id, [round(rel, 9), -rank])] AS chosen FROM cand GROUP BY qid
  UNION ALL SELECT qid, step + 1, list_append(any_value(chosen), arg_max(doc_id, [round(gain, 9), -rank])) FROM (
    SELECT st.qid, st.step, any_value(st.chosen) AS chosen, c.doc_id, any_value(c.rank) AS rank, 0.5e0 * any_value(c.rel) - 0.5e0 * max(sim.s) AS gain
    FROM st JOIN cand c ON c.qid = st.qid AND NOT list_contains(st.chosen, c.doc_id) JOIN sim ON sim.qid = st.qid AND sim.a = c.doc_id AND list_contains(st.chosen, sim.b) WHERE st.step < 8 GROUP BY st.qid, st.step, c.doc_id) GROUP BY qid, step),
picks AS (SELECT qid, unnest(chosen) AS doc_id, unnest(range(1, len(chosen) + 1)) AS fr FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY step DESC) AS i FROM st) WHERE i = 1),
chosen AS (SELECT c.qid, c.doc_id, CASE WHEN cn.n <= 8 THEN row_number() OVER (PARTITION BY c.qid ORDER BY c.rank) ELSE p.fr END AS fr FROM cand c JOIN cn USING (qid) LEFT JOIN picks p ON p.qid = c.qid AND p.doc_id = c.doc_id WHERE cn.n <= 8 OR p.fr IS NOT NULL)"""


VECTOR_HITS = "SELECT r.qid, r.doc_id, r.rank, r.score AS rel, CAST(e.embedding AS DOUBLE[]) AS v FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM vs) r JOIN embeddings e ON e.vec_id = r.doc_id WHERE r.rank <= 24"


@query("mmr_select", f"WITH RECURSIVE {Q_SQL}, {VEC}, {mmr_sql(VECTOR_HITS)} SELECT qid, doc_id, CAST(fr AS INTEGER) AS new_rank FROM chosen")
def mmr_select(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    hits = ranking.with_rows(_vec(spark, d, 24), e.select("doc_id", "embedding"), "doc_id")
    return ranking.mmr(hits, "doc_id", "embedding", 8, 0.5)


FINAL = """
sd AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY new_rank) AS n FROM picked),
dv AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY n > 3, new_rank) AS fr FROM sd),
f AS (SELECT qid, doc_id, fr, count(*) OVER (PARTITION BY qid) AS n FROM dv WHERE fr <= {k})
SELECT qid, doc_id, CAST(fr AS INTEGER) AS rank, CAST(CASE WHEN n <= 2 THEN fr - 1 WHEN (fr - 1) % 2 = 0 THEN (fr - 1) // 2 ELSE n - 1 - (fr - 2) // 2 END AS BIGINT) AS position FROM f"""
PICKED = ", picked AS (SELECT r.qid, r.doc_id, r.new_rank, d.source FROM rr r JOIN documents d USING (doc_id) WHERE r.new_rank <= {n}),"
SMART = RERANK + PICKED.format(n=22) + FINAL.format(k=8)


def smart(spark, d, config, batch=None, **models):
    """Hits of a batch of questions by all steps that ``config`` asks for."""
    batch = questions(spark, d) if batch is None else batch
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return retrieve.smart(batch, lambda q, k, fetch: hybrid(spark, d, k, fetch, q), docs, e, config, **models)


@query("smart_retrieve", SMART)
def smart_retrieve(spark, d):
    """Fetch wide, rerank, cap per source, cut, order for attention."""
    return smart(spark, d, retrieve.Config()).select("qid", "doc_id", "rank", "position")


@query("smart_retrieve_plain", RANKED + """, f AS (SELECT qid, doc_id, rank AS fr, count(*) OVER (PARTITION BY qid) AS n FROM hy JOIN documents USING (doc_id) WHERE rank <= 8)
SELECT qid, doc_id, CAST(fr AS INTEGER) AS rank, CAST(fr - 1 AS BIGINT) AS position FROM f""")
def smart_retrieve_plain(spark, d):
    """All steps switched off: the fused list."""
    return smart(spark, d, retrieve.Config(rerank=False, per_source=0, reorder=False)).select("qid", "doc_id", "rank", "position")


RERANKED_HITS = "SELECT r.qid, r.doc_id, r.new_rank AS rank, r.overlap AS rel, CAST(e.embedding AS DOUBLE[]) AS v FROM rr r JOIN embeddings e ON e.vec_id = r.doc_id WHERE r.new_rank <= 24"


@query("smart_retrieve_mmr", RERANK.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {mmr_sql(RERANKED_HITS)}, f AS (SELECT qid, doc_id, fr, count(*) OVER (PARTITION BY qid) AS n FROM chosen)
SELECT qid, doc_id, CAST(fr AS INTEGER) AS rank, CAST(CASE WHEN n <= 2 THEN fr - 1 WHEN (fr - 1) % 2 = 0 THEN (fr - 1) // 2 ELSE n - 1 - (fr - 2) // 2 END AS BIGINT) AS position FROM f""")
def smart_retrieve_mmr(spark, d):
    """Relevance diversification by vectors in place of the cap per source."""
    return smart(spark, d, retrieve.Config(mmr=True)).select("qid", "doc_id", "rank", "position")


@query("smart_retrieve_crag", RERANK + PICKED.format(n=22) + FINAL.format(k=8).replace("f AS (SELECT qid, doc_id, fr, count(*) OVER (PARTITION BY qid) AS n FROM dv WHERE fr <= 8)", """
c AS (SELECT v.*, length(d.text) % 3 <> 0 AS fits FROM (SELECT * FROM dv WHERE fr <= 8) v JOIN documents d USING (doc_id)),
g AS (SELECT qid, doc_id, fr, fits OR NOT bool_or(fits) OVER (PARTITION BY qid) AS stays FROM c),
f AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY fr) AS fr, count(*) OVER (PARTITION BY qid) AS n FROM g WHERE stays)"""))
def smart_retrieve_crag(spark, d):
    """A model drops hits that don't fit, unless none would stay; the stand-in keeps texts whose length isn't a multiple of three."""
    return smart(spark, d, retrieve.Config(crag=True), judge=F.length("text") % 3 != 0).select("qid", "doc_id", "rank", "position")


LIST_Q = Q_SQL.replace("text AS question", "'List ' || text AS asked, text || ' names examples' AS question")


@query("smart_retrieve_list", RERANK.replace(Q_SQL, LIST_Q) + PICKED.format(n=38) + FINAL.format(k=16))
def smart_retrieve_list(spark, d):
    """Questions for lists: an imagined answer is searched in place of the question, and twice as many hits are kept."""
    batch = questions(spark, d).withColumn("question", F.concat(F.lit("List "), "question"))
    imagined = F.concat(F.expr("substring(question, 6)"), F.lit(" names examples"))
    return smart(spark, d, retrieve.Config(), batch, imagine=imagined).select("qid", "doc_id", "rank", "position")


@query("smart_retrieve_window", SMART.split("SELECT qid, doc_id, CAST(fr")[0].rstrip() + rf""", {CHUNKS},
o2 AS (SELECT f.qid, f.doc_id, f.fr, c.ord, len(list_intersect(list_distinct({TERMS_SQL.format('q.question')}), {TERMS_SQL.format('c.text')})) AS shared FROM f JOIN q USING (qid) JOIN chunks c ON c.file_id = f.doc_id),
b2 AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY shared DESC, ord) AS n FROM o2)
SELECT b.qid, b.doc_id, CAST(b.fr AS INTEGER) AS rank, b.ord, count(*) AS parts, md5(string_agg(c.text, chr(10) || chr(10) ORDER BY c.ord)) AS digest
FROM b2 b JOIN chunks c ON c.file_id = b.doc_id AND c.ord BETWEEN b.ord - 1 AND b.ord + 1 WHERE b.n = 1 GROUP BY ALL""")
def smart_retrieve_window(spark, d):
    """Every hit as its best window and the windows on both sides."""
    hits = smart(spark, d, retrieve.Config()).select("qid", "doc_id", "rank")
    out = retrieve.with_window(hits, questions(spark, d), chunks(spark, d), 1)
    return out.select("qid", "doc_id", "rank", "ord", "parts", F.md5(F.col("text").cast("binary")).alias("digest"))


#: A question's variants: itself, its long words, its short ones; each with a vector of its own.
VARIANT_SQL = rf"""WITH q AS (SELECT qid * 10 + v AS qid, qid AS base, vec_id + v AS vec_id, CASE v WHEN 0 THEN question
  WHEN 1 THEN array_to_string(list_filter({TERMS_SQL.format('question')}, lambda x: length(x) > 3), ' ') ELSE array_to_string(list_filter({TERMS_SQL.format('question')}, lambda x: length(x) <= 3), ' ') END AS question
  FROM (SELECT conv_id * 1000 + turn AS qid, text AS question, conv_id AS vec_id, unnest([0, 1, 2]) AS v FROM conversations WHERE role = 'user' AND conv_id % 50 = 0))"""


def variants(batch):
    words = lexical.terms(F.col("question"))
    texts = F.array(F.col("question"), F.array_join(F.filter(words, lambda x: F.length(x) > 3), " "), F.array_join(F.filter(words, lambda x: F.length(x) <= 3), " "))
    each = batch.select(F.col("qid").alias("base"), "vec_id", F.posexplode(texts).alias("v", "question"))
    return each.select((F.col("base") * 10 + F.col("v")).alias("qid"), "base", (F.col("vec_id") + F.col("v")).alias("vec_id"), "question")


@query("multi_query_rrf", RANKED.replace("WITH " + Q_SQL, VARIANT_SQL) + f""",
lists AS (SELECT q.base, h.doc_id, h.rank FROM hy h JOIN q USING (qid) WHERE h.rank <= 12),
fu AS (SELECT base, doc_id, sum(1e0 / (60 + rank)) AS rrf FROM lists GROUP BY ALL),
ca AS (SELECT base AS qid, doc_id, row_number() OVER (PARTITION BY base ORDER BY round(rrf, 12) DESC, doc_id) AS rank FROM fu),
s2 AS (SELECT ca.qid, ca.doc_id, ca.rank, len(list_intersect(list_distinct({TERMS_SQL.format('o.question')}), {TERMS_SQL.format('d.text')})) / greatest(1, len(list_distinct({TERMS_SQL.format('o.question')})))::DOUBLE AS overlap
  FROM ca JOIN q o ON o.qid = ca.qid * 10 JOIN documents d USING (doc_id) WHERE ca.rank <= 32),
rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, rank) AS new_rank FROM s2)
""" + PICKED.format(n=8) + FINAL.format(k=8))
def multi_query_rrf(spark, d):
    """Variants of a question are searched each alone; their lists are fused, reranked once by the question itself, capped, cut, ordered."""
    batch = questions(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    asked = variants(batch)
    lists = hybrid(spark, d, 12, 30, asked).join(asked.select("qid", "base"), "qid").select(F.col("base").alias("qid"), "doc_id", "rank")
    return retrieve.finish_many(lists, batch, docs, retrieve.Config()).select("qid", "doc_id", "rank", "position")


@query("agentic_retrieve")
def agentic_retrieve(spark, d):
    """Rounds of retrieval that a model steers; here it is a stand-in that asks for the two longest words of the best hit."""
    from docmill.operators.agent import agentic

    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return agentic(questions(spark, d), docs, lambda q: smart(spark, d, retrieve.Config(), q))


@query("chunk_fixed", f"WITH {CHUNKS} SELECT file_id, ord, md5(text) AS digest FROM chunks")
def chunk_fixed(spark, d):
    return chunks(spark, d).select("file_id", "ord", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("chunk_recursive")
def chunk_recursive(spark, d):
    from docmill.operators.chunking import recursive_chunks

    return recursive_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("chunk_sections")
def chunk_sections(spark, d):
    """Windows as sections of their files, split to some 96 words with overlap inside a section."""
    from docmill.operators.chunking import section_chunks

    out = section_chunks(chunks(spark, d).withColumnRenamed("ord", "section"), "file_id", "section", "text", 128, 16, 16)
    return out.select("file_id", "section", "piece", "ord", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("get_chunks", f"""WITH {CHUNKS}, ids AS (SELECT file_id, ord, row_number() OVER (PARTITION BY file_id ORDER BY md5(CAST(ord AS VARCHAR)), ord) AS rank FROM chunks WHERE file_id % 50 = 0), {FILES}
SELECT i.rank, c.file_id, c.ord, f.path, length(c.text) AS n FROM ids i JOIN chunks c USING (file_id, ord) JOIN files f USING (file_id)""")
def get_chunks(spark, d):
    """Rows of ranked lists of ids, one list for each queried file, in the order of the list; unknown ids fall out."""
    c = chunks(spark, d)
    order = Window.partitionBy("file_id").orderBy(F.md5(F.col("ord").cast("string").cast("binary")), "ord")
    ids = c.filter("file_id % 50 = 0").select("file_id", "ord").withColumn("rank", F.row_number().over(order).cast("long"))
    return ids.join(c, ["file_id", "ord"]).join(files(spark, d), "file_id").select("rank", "file_id", "ord", "path", F.length("text").cast("long").alias("n"))


@query("expand_neighbors", f"""WITH {CHUNKS}, h AS (SELECT file_id, ord FROM chunks)
SELECT h.file_id, h.ord, count(*) AS parts, md5(string_agg(c.text, chr(10) || chr(10) ORDER BY c.ord)) AS digest FROM h JOIN chunks c ON c.file_id = h.file_id AND c.ord BETWEEN h.ord - 1 AND h.ord + 1 GROUP BY ALL""")
def expand_neighbors(spark, d):
    from docmill.operators.expand import neighbours

    c = chunks(spark, d)
    return neighbours(c, 1).select("file_id", "ord", "parts", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("chunk_concat", f"WITH {CHUNKS} SELECT file_id, count(*) AS parts, md5(string_agg(text, chr(10) || chr(10) ORDER BY ord)) AS digest FROM chunks GROUP BY file_id")
def chunk_concat(spark, d):
    from docmill.operators.expand import joined_text

    return chunks(spark, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("parts"), F.md5(joined_text("ord", "text").cast("binary")).alias("digest"))


@query("entity_boost", r"""WITH e AS (SELECT source, CASE WHEN ord % 2 = 0 THEN ['The', 'That', 'Und', 'Les', 'the', 'Zebra'] ELSE ['Und', 'of', 'OF'] END AS terms FROM (SELECT source, row_number() OVER (ORDER BY source) AS ord FROM documents GROUP BY source))
SELECT doc_id, array_to_string(list_filter(CASE WHEN len(terms) = 6 THEN ['the', 'that', 'und', 'les', 'zebra'] ELSE ['und', 'of'] END, lambda t: contains(lower(text), t)), ' ') AS found FROM documents JOIN e USING (source)""")
def entity_boost(spark, d):
    """What is added to the tokens of a text: the entity terms of its source, a table, that the text holds."""
    docs = table(spark, d, "documents")
    place = F.row_number().over(Window.orderBy("source"))
    terms = F.when(place % 2 == 0, F.array(*map(F.lit, ENTITIES))).otherwise(F.array(F.lit("Und"), F.lit("of"), F.lit("OF")))
    known = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", terms.alias("terms"))
    return docs.join(known, "source").select("doc_id", F.array_join(boost(F.col("text"), F.col("terms")), " ").alias("found"))


@query("citations", RANKED.replace(Q_SQL, ALL_Q_SQL) + "SELECT h.qid, CAST(h.rank AS INTEGER) AS rank, d.source || '/' || h.doc_id AS path, substr(d.text, 1, 240) AS snippet FROM hy h JOIN documents d USING (doc_id) WHERE h.rank <= 8")
def citations(spark, d):
    """The hits of everything that users ask, cut before they meet their questions."""
    cited = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.substring("text", 1, 240).alias("snippet"))
    hits = hybrid(spark, d, batch=all_questions(spark, d)).select("qid", "doc_id", "rank")
    return ranking.with_rows(hits, cited, "doc_id").select("qid", "rank", "path", "snippet")


@query("format_context", RANKED + """SELECT h.qid, md5(string_agg('[' || h.rank || '] (' || d.source || ' p.' || (h.rank + 1) || ')' || chr(10) || d.text, chr(10) || chr(10) ORDER BY h.rank)) AS digest
FROM hy h JOIN documents d USING (doc_id) WHERE h.rank <= 8 GROUP BY h.qid""")
def format_context(spark, d):
    from docmill.operators.prompts import context_block

    hits = ranking.with_rows(hybrid(spark, d), table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    return context_block(hits.withColumn("page", F.col("rank") + 1), "source").select("qid", F.md5(F.col("context").cast("binary")).alias("digest"))


@query("passages_fallback", RANKED + """SELECT h.qid, CAST(h.rank AS INTEGER) AS rank, '[' || h.rank || '] ' || CASE WHEN length(d.text) > 600 THEN substr(d.text, 1, 600) || '…' ELSE d.text END AS passage
FROM hy h JOIN documents d USING (doc_id) WHERE h.rank <= 8""")
def passages_fallback(spark, d):
    from docmill.functions.text import ellipsis

    hits = ranking.with_rows(hybrid(spark, d), table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return hits.select("qid", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), ellipsis(F.col("text"), 600)).alias("passage"))
