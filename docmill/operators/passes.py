"""Passes over the pages and sections of files on their way into the index: recovery of pages, inspection, correction, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import garbled, normalised, strip, toc_fragment

#: Fixed value: characters a page under which a file is taken for a scan.
SCAN_CHARS = 50
#: Characters of the neighbours that a correction sees on either side, and of the document that a context sees.
AROUND, DOCUMENT = 400, 3000


def recovered(pages: DataFrame, permissive: bool = False) -> DataFrame:
    """file_id, page, text, origin, questionable from pages (file_id, page, text of the text layer, ocr: text of recognition).

    A file with next to no text layer takes all its pages from recognition, blank ones left out. Otherwise readable pages are as they
    are, and a garbled page is replaced by its recognised text; where that is empty, garbled or a torn table of contents the page is
    dropped, or with ``permissive`` kept as questionable unless it is empty."""
    text, ocr = F.coalesce("text", F.lit("")), strip(F.coalesce("ocr", F.lit("")))
    # What a page is by itself is told once, before its file's pages meet, and recognition is looked at only where it may be needed.
    of_page = F.when(strip(F.col("text")) == "", None).when(~garbled(F.col("text")), "layer")
    of_page = of_page.when(~((F.col("ocr") == "") | garbled(F.col("ocr")) | toc_fragment(F.col("ocr"))), "recognised")
    of_page = of_page.when(F.col("ocr") != "", "questionable") if permissive else of_page
    told = pages.select("file_id", "page", text.alias("text"), ocr.alias("ocr")).withColumn("of_page", of_page).withColumn("n", F.length("text"))
    file = Window.partitionBy("file_id")
    scan = (F.sum("n").over(file) < SCAN_CHARS * F.count(F.lit(1)).over(file)) & F.max(F.col("ocr") != "").over(file)
    told = told.withColumn("text", F.when(F.col("of_page") == "layer", F.col("text"))).withColumn("scan", scan)
    found = told.withColumn("origin", F.when(F.col("scan"), F.when(F.col("ocr") != "", "scan")).otherwise(F.col("of_page"))).filter("origin IS NOT NULL")
    chosen = F.when(F.col("origin") == "layer", F.col("text")).otherwise(F.col("ocr"))
    return found.select("file_id", "page", normalised(chosen).alias("text"), "origin", (F.col("origin") == "questionable").alias("questionable"))


def to_recognise(pages: DataFrame) -> DataFrame:
    """The pages (file_id, page, text of the text layer) that have to be recognised: all of a file with next to no text layer, garbled ones of others."""
    file = Window.partitionBy("file_id")
    text = F.coalesce("text", F.lit(""))
    scan = F.sum(F.length(text)).over(file) < SCAN_CHARS * F.count(F.lit(1)).over(file)
    return pages.withColumn("scan", scan).filter(F.col("scan") | ((strip(text) != "") & garbled(text))).drop("scan")


def inspected(sections: DataFrame, verdict: Column) -> DataFrame:
    """Sections that a model doesn't call garbled, with ``partial``; blank sections stay without being asked about."""
    state = F.when(strip(F.coalesce("text", F.lit(""))) == "", "blank").otherwise(F.coalesce(verdict, F.lit("unknown")))
    return sections.withColumn("state", state).filter("state <> 'garbled'").withColumn("partial", F.col("state") == "partial").drop("state")


def with_context(sections: DataFrame) -> DataFrame:
    """``around``: the end of the section before and the start of the one after, for a model that corrects a section."""
    w = Window.partitionBy("file_id").orderBy("ord")
    last, following = F.coalesce(F.lag("text").over(w), F.lit("")), F.coalesce(F.lead("text").over(w), F.lit(""))
    tail = F.substring(last, F.greatest(F.lit(1), F.length(last) - AROUND + 1), F.lit(AROUND))
    return sections.withColumn("around", strip(F.concat(tail, F.lit("\n\n"), F.substring(following, 1, AROUND))))


def corrected(sections: DataFrame, candidate: Column, cleaned: Column) -> DataFrame:
    """Candidates take the model's text, and go where it has none; other sections are as they are."""
    marked = sections.withColumn("asked", candidate).withColumn("cleaned", F.when(F.col("asked"), cleaned))
    return marked.filter("NOT asked OR cleaned IS NOT NULL").withColumn("text", F.coalesce("cleaned", "text")).withColumn("corrected", F.col("asked")).drop("asked", "cleaned")


def contextualised(chunks: DataFrame, context: Column) -> DataFrame:
    """``embed_text``: a model's sentence about the chunk before its text, or the text alone; the stored text stays what it was."""
    said = strip(F.coalesce(context, F.lit("")))
    return chunks.withColumn("embed_text", F.when(said == "", F.col("text")).otherwise(F.concat(said, F.lit("\n\n"), F.col("text"))))
