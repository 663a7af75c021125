"""Queries over the passes of ingest: page recovery, inspection, correction, context; models are stand-ins that SQL can repeat."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from docmill.operators import asks as ask
from docmill.operators import models, passes, scan
from docmill.scratch import folder, stored
from docmill.sources import paged
from docmill.sources.tables import chunks, table

from .registry import CHUNKS, query

#: Windows as pages: every fifth has broken glyphs, the text layer of every eleventh file is missing; recognition finds nothing on some.
PAGES = rf"""WITH {CHUNKS}, pages AS (SELECT file_id, ord + 1 AS page, CASE WHEN file_id % 11 = 0 THEN '' WHEN ord % 5 = 1 THEN translate(text, 'aeiouAEIOU', repeat(chr(92), 10)) ELSE text END AS layer,
  CASE WHEN (file_id + ord) % 7 = 3 THEN ' ' WHEN (file_id + ord) % 7 = 5 THEN regexp_replace(text, '[aeiouAEIOU]', '#', 'g') ELSE text END AS ocr, text FROM chunks),
m AS (SELECT *, length(layer) AS n, (sum(length(layer)) OVER (PARTITION BY file_id) < 50 * count(*) OVER (PARTITION BY file_id)) AND bool_or(trim(ocr) <> '') OVER (PARTITION BY file_id) AS scan FROM pages)
"""


def pages(spark, d):
    c = chunks(spark, d)
    broken = F.translate("text", "aeiouAEIOU", "\\" * 10)
    k = (F.col("file_id") + F.col("ord")) % 7
    layer = F.when(F.col("file_id") % 11 == 0, "").when(F.col("ord") % 5 == 1, broken).otherwise(F.col("text"))
    ocr = F.when(k == 3, " ").when(k == 5, F.regexp_replace("text", "[aeiouAEIOU]", "#")).otherwise(F.col("text"))
    return c.select("file_id", (F.col("ord") + 1).alias("page"), layer.alias("text"), ocr.alias("ocr"))


#: The garbled rule of the SQL twin of ``garbled``, on any column.
GARBLED = r"""(length({0}) >= 40 AND (len(regexp_extract_all({0}, '\\'))::DOUBLE / length({0}) > 0.025 OR (len(regexp_extract_all({0}, '\p{{L}}')) > 50 AND len(regexp_extract_all(lower({0}), '[aeiou]'))::DOUBLE / len(regexp_extract_all({0}, '\p{{L}}')) < 0.20) OR len(regexp_extract_all({0}, '[^\p{{L}}\p{{N}}\s]'))::DOUBLE / length({0}) > 0.45))"""
_RECOVERED = PAGES + f""", g AS (SELECT *, {GARBLED.format('layer')} AS broken, trim(ocr) = '' OR {GARBLED.format('ocr')} AS bad FROM m),
o AS (SELECT *, CASE WHEN scan THEN CASE WHEN trim(ocr) <> '' THEN 'scan' END WHEN trim(layer) = '' THEN NULL WHEN NOT broken THEN 'layer' WHEN NOT bad THEN 'recognised' {{more}} END AS origin FROM g)
SELECT file_id, page, origin, CASE WHEN origin = 'layer' THEN length(layer) ELSE length(ocr) END AS n FROM o WHERE origin IS NOT NULL"""


@query("pdf_recovery", _RECOVERED.replace("{more}", ""))
def pdf_recovery(spark, d):
    """Pages whose text layer is usable, and what recognition makes of the others."""
    return passes.recovered(pages(spark, d)).select("file_id", "page", "origin", F.length("text").cast("long").alias("n"))


@query("pdf_recovery_permissive", _RECOVERED.replace("{more}", "WHEN NOT scan AND trim(ocr) <> '' THEN 'questionable'"))
def pdf_recovery_permissive(spark, d):
    """The same, with questionable pages kept for a later correction."""
    return passes.recovered(pages(spark, d), permissive=True).select("file_id", "page", "origin", F.length("text").cast("long").alias("n"))


class Mirror:
    """A stand-in for a recogniser: a picture is its text, turned round and encoded."""

    def __call__(self, picture: bytes) -> str:
        return picture.decode("utf-8")[::-1]


def paged_files(spark, d):
    """The pages as paged files in a new folder, and the folder."""
    path = folder(spark, "paged")
    rows = pages(spark, d).select("file_id", F.struct("page", "text", F.encode(F.reverse("ocr"), "UTF-8").alias("picture")).alias("p"))
    paged.write_paged(rows.groupBy("file_id").agg(F.array_sort(F.collect_list("p")).alias("pages")), path)
    return path


@query("pdf_pages", _RECOVERED.replace("{more}", ""))
def pdf_pages(spark, d):
    """Paged files read by ranges; only pages that need it are recognised, in a second pass over their pictures."""
    path = paged_files(spark, d)
    number = F.regexp_extract("path", r"(-?\d+)\.paged$", 1).cast("long").alias("file_id")
    layer = stored(paged.read_pages(spark, path).select("path", number, "page", "text"), "page-layers")
    seen = stored(paged.recognised(passes.to_recognise(layer), path, Mirror), "recognised-pages")
    both = layer.join(seen, ["path", "page"], "left").select("file_id", "page", "text", "ocr")
    return passes.recovered(both).select("file_id", F.col("page").cast("int").alias("page"), "origin", F.length("text").cast("long").alias("n"))


class LengthJudge:
    """A stand-in for a model: answers by the length of the prompt, and fails on some."""

    def complete(self, prompt: str, max_tokens: int) -> str:
        if len(prompt) % 13 == 0:
            raise ValueError("no reply")
        return ("clean", "partial", "garbled", "clean")[len(prompt) % 4]


_VERDICT = "CASE WHEN trim(text) = '' THEN 'blank' WHEN length(text) % 13 = 0 THEN 'unknown' WHEN length(text) % 4 = 1 THEN 'partial' WHEN length(text) % 4 = 2 THEN 'garbled' ELSE 'clean' END"


@query("inspect_pass", f"WITH {CHUNKS}, v AS (SELECT file_id, ord, {_VERDICT} AS state FROM chunks) SELECT file_id, ord, state = 'partial' AS partial FROM v WHERE state <> 'garbled'")
def inspect_pass(spark, d):
    """A model's verdict on every section: garbled ones go, partial ones are marked, no reply counts as unknown."""
    c = chunks(spark, d).withColumn("reply", models.completed(F.col("text"), LengthJudge))
    return passes.inspected(c, F.when(F.col("reply") == "", "unknown").otherwise(F.col("reply"))).select("file_id", "ord", "partial")


class Mender:
    """A stand-in for a model that restores texts: it sees the text and what stands around it, gives some up, talks about others and fails on some."""

    def complete(self, prompt: str, max_tokens: int) -> str:
        around, text = prompt.split("Text around it:\n\n", 1)[1].rsplit("\n\nText:\n\n", 1)
        if len(text) % 11 == 0:
            raise ValueError("no reply")
        if len(text) % 5 == 0:
            return "UNRECOVERABLE."
        if len(text) % 7 == 0:
            return "I cannot tell what this says."
        return f"```\n{text}{len(around)}\n```"


_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("correct_pass", f"""WITH {CHUNKS}, w AS (SELECT *, {_STRIPPED.format("right(coalesce(lag(text) OVER o, ''), 400) || chr(10) || chr(10) || left(coalesce(lead(text) OVER o, ''), 400)")} AS around FROM chunks WINDOW o AS (PARTITION BY file_id ORDER BY ord)),
r AS (SELECT *, CASE WHEN length(text) % 11 = 0 OR length(text) % 5 = 0 OR length(text) % 7 = 0 OR length(text || length(around)) < 20 THEN NULL ELSE {_STRIPPED.format("text || length(around)")} END AS cleaned FROM w)
SELECT file_id, ord, ord % 3 = 1 AS corrected, md5(CASE WHEN ord % 3 = 1 THEN cleaned ELSE text END) AS digest FROM r WHERE ord % 3 <> 1 OR cleaned IS NOT NULL""")
def correct_pass(spark, d):
    """Questionable sections as a model rewrites them with their neighbours in view; those it gives up, or only talks about, go."""
    c = stored(passes.with_context(chunks(spark, d)), "sections-in-context")
    asked = c.filter("ord % 3 = 1")  # the model sees only these
    cleaned = stored(asked.select("file_id", "ord", ask.corrected(F.col("text"), F.col("around"), Mender).alias("cleaned")), "corrections")
    out = passes.corrected(c.join(cleaned, ["file_id", "ord"], "left"), F.col("ord") % 3 == 1, F.col("cleaned"))
    return out.select("file_id", "ord", "corrected", F.md5(F.col("text").cast("binary")).alias("digest"))


class Situator:
    """A stand-in for a model that places a chunk in its document; it fails on some."""

    def complete(self, prompt: str, max_tokens: int) -> str:
        document, chunk = prompt.split("\n\n", 1)[1].split("\n\nChunk:\n\n", 1)
        if len(chunk) % 4 == 2:
            raise ValueError("no reply")
        return f" At {document.find(chunk[:40])} of {len(document)}. " if len(chunk) % 4 else ""


@query("contextualize_pass", f"""WITH {CHUNKS}, p AS (SELECT c.file_id, c.ord, c.text, substr(d.text, 1, 3000) AS document FROM chunks c JOIN documents d ON d.doc_id = c.file_id),
r AS (SELECT *, CASE WHEN length(text) % 4 IN (0, 2) OR contains(document, chr(10) || chr(10) || 'Chunk:') THEN '' ELSE 'At ' || (strpos(document, left(text, 40)) - 1) || ' of ' || length(document) || '.' END AS said FROM p)
SELECT file_id, ord, md5(CASE said WHEN '' THEN text ELSE said || chr(10) || chr(10) || text END) AS embed_digest, md5(text) AS text_digest FROM r""")
def contextualize_pass(spark, d):
    """A model's sentence about its place before each chunk, for the embedder only; without a reply the chunk alone."""
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.substring("text", 1, passes.DOCUMENT).alias("document"))
    c = chunks(spark, d).join(documents, "file_id")
    out = passes.contextualised(c.withColumn("said", ask.situated(F.col("text"), F.col("document"), Situator)), F.col("said"))
    return out.select("file_id", "ord", F.md5(F.col("embed_text").cast("binary")).alias("embed_digest"), F.md5(F.col("text").cast("binary")).alias("text_digest"))


class Topics:
    """A stand-in for a model that sums up excerpts: an object in a fence, with words of the excerpts; on some it says nothing that can be read."""

    def complete(self, prompt: str, max_tokens: int) -> str:
        text = prompt.split("\n\n", 1)[1]
        if len(text) % 9 == 4:
            return "There is no object {here"
        words = list(dict.fromkeys(w for w in re.findall(r"\w+", text) if len(w) >= 6))
        return "```json\n" + json.dumps({"title": " ".join(words[:3]), "description": f"{len(text)} characters", "topics": [*words[:12], 7, "", None]}) + "\n```"


class Names:
    """A stand-in for a model that lists names: capitalised words by length, one of them made up; it fails on some excerpts."""

    def complete(self, prompt: str, max_tokens: int) -> str:
        text = prompt.split("\n\n", 1)[1]
        if len(text) % 8 == 5:
            raise ValueError("no reply")
        found: dict[str, list] = {}
        for w in re.findall(r"\b[A-Z][a-z]+", text):
            found.setdefault(scan.BUCKETS[len(w) % 8], []).append(w)
        found.setdefault("npcs", []).append("Zzyzx the Unheard")
        return "Here: " + json.dumps(found | {"other": ["Left Out"], "spells": "none"}) + " and that is all."


@query("sidecar_scan")
def sidecar_scan(spark, d):
    """Title, topics and names of every file by way of sampled windows and two models; without SQL, as the stand-ins read what they are sent."""
    found = scan.scan(chunks(spark, d), Topics, Names)
    lists = F.array_join(F.transform("entities", lambda e: F.concat(e["bucket"], F.lit(": "), F.array_join(e["terms"], ", "))), "; ")
    return found.select("file_id", "title", "description", F.array_join("topics", "|").alias("topics"), lists.alias("entities"))


class Echo:
    """A stand-in for a model: numbers the last paragraph of the prompt and a longer form of it."""

    def complete(self, prompt: str, max_tokens: int) -> str:
        last = prompt.rsplit("\n\n", 1)[-1].replace("\n", " ")
        if last.startswith("fail"):
            raise ValueError("no reply")
        return f"1. {last}\n2. {last} again\n- yes"


#: Questions in a form that the stand-in repeats as it is: words and blanks, a letter first.
ASKS_SQL = r"asks AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN 'fail ' ELSE 'why ' END || array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') AS q FROM conversations WHERE role = 'user')"


def asks(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return c.select("conv_id", "turn", F.concat(F.when(F.col("conv_id") % 9 == 0, "fail ").otherwise("why "), F.array_join(words, " ")).alias("q"))


@query("question_variants", f"WITH {ASKS_SQL} SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN q ELSE trim(q) || '|' || trim(q) || ' again' END AS variants FROM (SELECT conv_id, turn, trim(q) AS q FROM asks)")
def question_variants(spark, d):
    """Other wordings of each question behind the question itself; without a reply the question alone."""
    a = asks(spark, d).withColumn("q", F.trim("q"))
    return a.select("conv_id", "turn", F.array_join(ask.variants(F.col("q"), Echo, 1), "|").alias("variants"))


@query("question_suggestions", f"WITH {ASKS_SQL} SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN '' ELSE array_to_string(list_filter([q, q || ' again'], lambda x: length(x) >= 8), '|') END AS lines FROM (SELECT conv_id, turn, trim(q) AS q FROM asks)")
def question_suggestions(spark, d):
    return asks(spark, d).select("conv_id", "turn", F.array_join(ask.suggested(F.trim("q"), Echo, 3), "|").alias("lines"))


@query("imagined_answers", f"WITH {ASKS_SQL} SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN q ELSE q || ' 1. ' || q || chr(10) || '2. ' || q || ' again' || chr(10) || '- yes' END AS searched FROM (SELECT conv_id, turn, trim(q) AS q FROM asks)")
def imagined_answers(spark, d):
    """What is searched for in place of a question for a list."""
    return asks(spark, d).select("conv_id", "turn", ask.imagined_list(F.trim("q"), Echo).alias("searched"))
