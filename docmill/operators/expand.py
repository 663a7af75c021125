"""Neighbours and chapters of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.scratch import stored

BREAK = "\n\n"


def joined_text(order: str, text: str) -> Column:
    """Aggregate: the texts of a group in order, blank lines between them."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), BREAK)


def neighbours(chunks: DataFrame, width: int) -> DataFrame:
    """Every chunk with the text of those up to ``width`` places away in its file, and their number.

    Places are dense in a file, so a window frame does it: no range join."""
    frame = Window.partitionBy("file_id").orderBy("ord").rowsBetween(-width, width)
    around = F.collect_list("text").over(frame)
    return chunks.select(*[c for c in chunks.columns if c != "text"], F.array_join(around, BREAK).alias("text"), F.size(around).cast("long").alias("parts"))


def find_chapter(hits: DataFrame, chapters: DataFrame) -> DataFrame:
    """hits (file_id, ord, ...) with number and title of the first chapter in list order that spans the place, or null."""
    span = chapters.select("file_id", "chapter", "title", "start_ord", "end_ord")
    inside = (F.col("ord") >= F.col("start_ord")) & (F.col("ord") <= F.col("end_ord"))
    joined = hits.join(span, (hits["file_id"] == span["file_id"]) & inside, "left").drop(span["file_id"])
    first = joined.groupBy(*hits.columns).agg(F.min(F.struct("chapter", "title")).alias("c"))
    return first.select(*hits.columns, "c.chapter", "c.title")


def expand_chapters(hits: DataFrame, chunks: DataFrame, chapters: DataFrame, limit: int) -> DataFrame:
    """The first hit of each chapter title in a file gets the whole chapter's text, later ones are marked as repeats; a chapter
    over ``limit`` characters is skipped but still used up."""
    located = find_chapter(hits, chapters)
    order = Window.partitionBy("file_id", "title").orderBy("rank")
    located = located.withColumn("turn", F.when(F.col("title").isNotNull(), F.row_number().over(order)))
    inside = chapters.join(chunks.select("file_id", "ord", "text"), "file_id").filter("ord BETWEEN start_ord AND end_ord AND text <> ''")
    whole = inside.groupBy("file_id", "chapter").agg(joined_text("ord", "text").alias("whole"))
    kind = F.when(F.col("title").isNull(), "none").when(F.col("turn") > 1, "chapter-dup").when(F.length("whole") > limit, "chapter-skip").otherwise("chapter")
    return located.join(whole, ["file_id", "chapter"], "left").withColumn("kind", kind)


def section_chapters(chunks: DataFrame) -> DataFrame:
    """file_id, chapter, title, start_ord, end_ord, start_page, end_page: runs of one trimmed section name; blank ones are left out.

    A chapter's last page is the last page seen so far in its file."""
    w = Window.partitionBy("file_id").orderBy("ord")
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    s = chunks.withColumn("title", F.trim("section")).withColumn("seen_page", F.last("page", True).over(seen))
    s = s.withColumn("new", F.when(F.lag("title").over(w).eqNullSafe(F.col("title")), 0).otherwise(1))
    s = s.withColumn("run", F.sum("new").over(seen)).filter("title <> ''")
    g = s.groupBy("file_id", "run", "title").agg(F.min("ord").alias("start_ord"), F.max("ord").alias("end_ord"), F.min_by("page", "ord").alias("start_page"), F.max_by("seen_page", "ord").alias("end_page"))
    return g.withColumn("chapter", F.row_number().over(Window.partitionBy("file_id").orderBy("run"))).drop("run")


def outline_chapters(outline: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bookmarks (file_id, pos, title, page) as chapters: one for each page, up to the page before the next one; the first
    reaches back to the first place, each ends before the next starts, and the last reaches the last place."""
    first = outline.withColumn("n", F.row_number().over(Window.partitionBy("file_id", "page").orderBy("pos"))).filter("n = 1").drop("n")
    by_page = Window.partitionBy("file_id").orderBy("page")
    pages = chunks.groupBy("file_id").agg(F.max("page").alias("n_pages"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    spans = first.join(pages, "file_id").withColumn("end_page", F.coalesce(F.lead("page").over(by_page) - 1, F.col("n_pages")))
    c = chunks.select("file_id", "ord", F.col("page").alias("at_page"))
    placed = spans.join(c, "file_id").filter("at_page BETWEEN page AND end_page").groupBy("file_id", "title", "page", "end_page", "first_ord", "last_ord").agg(F.min("ord").alias("lo"))
    w = Window.partitionBy("file_id").orderBy("page")
    start = F.when(F.row_number().over(w) == 1, F.col("first_ord")).otherwise(F.col("lo"))
    placed = placed.withColumn("start_ord", start)
    return placed.select("file_id", F.row_number().over(w).alias("chapter"), "title", "start_ord", F.coalesce(F.lead("start_ord").over(w) - 1, F.col("last_ord")).alias("end_ord"), F.col("page").alias("start_page"), "end_page")


def dispatched(chunks: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """file_id, chapter, title, start_ord, end_ord of every file of ``chunks`` (file_id, ord, section, page): by its bookmarks where
    it has an outline (file_id, pos, title, page) that leads somewhere, else by its sections if there are several, else one chapter for all of it."""
    cols = ["file_id", "chapter", "title", "start_ord", "end_ord"]
    by_section = section_chapters(chunks).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file_id"))).filter("n > 1").select(*cols)
    whole = chunks.groupBy("file_id").agg(F.min("ord").alias("start_ord"), F.max("ord").alias("end_ord")).select("file_id", F.lit(1).alias("chapter"), F.lit("Document").alias("title"), "start_ord", "end_ord")
    found = None
    if outline is not None:
        found = stored(outline_chapters(outline, chunks.select("file_id", "ord", "page")).select(*cols), "outline-chapters")
        by_section = by_section.join(found.select("file_id").distinct(), "file_id", "left_anti")
    known = by_section if found is None else found.unionByName(by_section)
    known = stored(known, "chapters")
    return known.unionByName(whole.join(known.select("file_id").distinct(), "file_id", "left_anti"))
