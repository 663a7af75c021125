"""Chunkers: fixed word windows in SQL, and the recursive splitter as a Python generator over batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators of the recursive splitter, coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", " ")


def fixed_windows(df: DataFrame, text_col: str, window: int, overlap: int) -> DataFrame:
    """A row for each window of ``window`` words, every ``window - overlap`` words, until one reaches the end."""
    step = window - overlap
    words = F.split(F.regexp_replace(F.col(text_col), r"^\s+|\s+$", ""), r"\s+")
    n = F.size("__words")
    last = F.greatest(F.lit(0), F.ceil((n - window) / F.lit(float(step)))).cast("int")
    rest = [c for c in df.columns if c != text_col]
    cut = df.select(*rest, words.alias("__words")).select("*", F.explode(F.sequence(F.lit(0), last)).alias("ord"))
    return cut.select(*rest, "ord", F.array_join(F.slice("__words", F.col("ord") * step + 1, F.lit(window)), " ").alias("text"))


def split_words(text: str, limit: int, level: int = 0) -> list[str]:
    """Pieces of at most ``limit`` words: parts of the coarsest separator packed greedily, larger parts split further."""
    text = text.strip()
    if not text:
        return []
    if len(text.split()) <= limit:
        return [text]
    if level == len(SEPARATORS):
        words = text.split()
        return [" ".join(words[i : i + limit]) for i in range(0, len(words), limit)]
    mark = SEPARATORS[level]
    parts = text.split(mark)
    if len(parts) == 1:
        return split_words(text, limit, level + 1)
    out: list[str] = []
    held: list[str] = []
    count = 0
    for part in parts:
        n = len(part.split())
        if held and count + n > limit:
            out.append(mark.join(held))
            held, count = [], 0
        if n > limit:
            out += split_words(part, limit, level + 1)
        else:
            held.append(part)
            count += n
    if held:
        out.append(mark.join(held))
    return [p.strip() for p in out if p.strip()]


def recursive_chunks(df: DataFrame, key: str, text_col: str, tokens: int = 512, overlap: int = 64, least: int = 64) -> DataFrame:
    """key, ord, text: the recursive splitter with the tail of the last piece in front of each piece.

    Both sizes are tokens, three quarters of which count as words, ``least`` words at least."""
    return _split(df, [key], text_col, tokens, overlap, least)


def section_chunks(df: DataFrame, file: str, section: str, text_col: str, tokens: int = 512, overlap: int = 64, least: int = 64) -> DataFrame:
    """file, section, piece, ord, text: sections (numbered inside a file) split each for itself, with the tail of the piece before only inside a
    section; ``ord`` goes on from section to section."""
    pieces = _split(df, [file, section], text_col, tokens, overlap, least).withColumnRenamed("ord", "piece")
    place = F.row_number().over(Window.partitionBy(file).orderBy(section, "piece")) - 1
    return pieces.withColumn("ord", place).select(file, section, "piece", "ord", "text")


def _split(df: DataFrame, keys: list[str], text_col: str, tokens: int, overlap: int, least: int) -> DataFrame:
    limit, tail = max(least, int(0.75 * tokens)), max(least, int(0.75 * overlap))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("ord", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *k, text in zip(*[batch[c] for c in keys], batch[text_col], strict=True):
                pieces = split_words(text or "", limit)
                for i, piece in enumerate(pieces):
                    lead = " ".join(pieces[i - 1].split()[-tail:]) + " " if i else ""
                    rows.append((*k, i, lead + piece))
            yield pd.DataFrame(rows, columns=[*keys, "ord", "text"])

    return df.select(*keys, text_col).mapInPandas(run, schema)
