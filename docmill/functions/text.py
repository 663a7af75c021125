"""Text functions as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that mark a question for a list.
LIST_PHRASES = (
    "list ", "name some", "name a few", "give examples", "give me some", "give me examples", "examples of", "names of",
    "what are some", "what cool", "which characters", "which npcs", "which monsters", "which items", "which spells",
    "tell me about", "tell me some", "show me some",
    "the most interesting", "the most unique", "the most memorable", "some interesting", "some unique", "some memorable",
    "some classic", "some notable", "some famous", "any interesting", "any cool", "any examples", "any unique", "any notable", "any famous",
    "interesting characters", "interesting npcs", "interesting monsters", "interesting items", "interesting locations",
    "memorable characters", "memorable npcs", "unique sounding", "notable villains", "notable npcs",
    "suggest some", "suggest a few", "recommend some",
)
#: Shares above (below, for vowels) which a page counts as garbled.
REPLACED, BACKSLASHES, VOWELS, SYMBOLS = 0.02, 0.025, 0.20, 0.45
#: Parts of names that mark an embedding model; vendor words in front of device names.
EMBEDDERS = ("embed", "bge-", "minilm", "e5-", "arctic-embed", "granite-embedding")
VENDORS = ("nvidia ", "amd ", "intel(r) ", "intel ")
#: Equal lines from which on a run collapses, and characters of a line up to which it counts as a table cell.
LEAST_RUN, LONGEST_CELL = 6, 12
#: Openings of a correction that describes its input.
DESCRIBING = ("this passage", "the passage", "this text", "the text", "here is", "i cannot")
#: Parts of error messages by class, tried in this order.
ERRORS = (
    ("load_failure", ("unable to load model",)),
    ("oom", ("out of memory", "cuda out of memory", "oom", "failed to allocate")),
    ("context_overflow", ("context length", "context_length", "exceeds context", "n_ctx", "input too long", "prompt is too long")),
    ("model_not_found", ("404", "no such model")),
)
DOWN = ("connection refused", "all connection attempts failed", "503 service", "502 bad gateway")


def any_of(text: Column, parts) -> Column:
    """Whether the text holds one of a few literal parts."""
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def strip(c: Column) -> Column:
    """Without white space at both ends. A pattern would be tried at every place of the text."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


trimmed = strip


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapsed_runs(c: Column) -> Column:
    """Runs of at least LEAST_RUN equal short lines as one line with their number. Lines and runs are arrays of one row: each array is
    built once and walked once, so time is in proportion to the text; most texts have no such run and stay as they are."""

    def of_cells(lines: Column, cells: Column) -> Column:
        last = F.slice(F.concat(F.array(F.lit(None).cast("string")), cells), F.lit(1), F.size(cells))
        starts = F.filter(F.transform(F.zip_with(cells, last, lambda v, p: F.when(~v.eqNullSafe(p), v)), lambda v, i: F.struct(i.alias("at"), v.alias("v"))), lambda x: x["v"].isNotNull())

        def of_starts(first: Column) -> Column:
            ends = F.concat(F.slice(F.transform(first, lambda x: x["at"]), F.lit(2), F.size(cells)), F.array(F.size(cells)))
            runs = F.zip_with(first, ends, lambda a, z: F.struct(a["at"].alias("at"), a["v"].alias("v"), (z - a["at"]).alias("n")))
            cell = lambda r: (r["n"] >= LEAST_RUN) & (r["v"] != "") & (F.length(r["v"]) <= LONGEST_CELL)

            def of_runs(found: Column) -> Column:
                marks = F.flatten(F.transform(found, lambda r: F.when(cell(r), F.concat(F.array(r["n"]), F.array_repeat(F.lit(0), r["n"] - 1))).otherwise(F.array_repeat(F.lit(1), r["n"]))))
                line = lambda x, m: F.when(m == 1, x).when(m > 1, F.concat(F.regexp_extract(x, r"^\s*", 0), trimmed(x), F.lit(" (×"), m.cast("string"), F.lit(")")))
                return F.when(F.exists(found, cell), F.array_join(F.array_compact(F.zip_with(lines, marks, line)), "\n")).otherwise(c)

            return let(runs, of_runs)

        return let(starts, of_starts)

    # Six lines take five line feeds.
    whole = let(F.split(c, "\n"), lambda lines: let(F.transform(lines, trimmed), lambda cells: of_cells(lines, cells)))
    return F.when(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) >= LEAST_RUN - 1, whole).otherwise(c)


def normalised(c: Column) -> Column:
    """No NUL, single blanks, at most one empty line in a row, runs of table cells collapsed, trimmed."""
    blanks = lambda x: F.when(F.contains(x, F.lit("  ")) | F.contains(x, F.lit("\t")), F.regexp_replace(x, "[ \\t]+", " ")).otherwise(x)
    lines = lambda x: F.when(F.contains(x, F.lit("\n\n\n")), F.regexp_replace(x, "\\n{3,}", "\n\n")).otherwise(x)
    return let(F.replace(c, F.lit("\0"), F.lit("")), lambda x: let(blanks(x), lambda y: let(lines(y), lambda z: strip(collapsed_runs(z)))))


def tokens(c: Column) -> Column:
    """ASCII words in lower case."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9'\-]*"), F.lit(0)), lambda t: F.lower(t))


def is_list_query(c: Column) -> Column:
    return any_of(strip(F.lower(c)), LIST_PHRASES)


def garbled(c: Column) -> Column:
    """Whether a page looks like broken extraction; short texts never do. Each count is made once, and only where those before it don't decide."""

    def of_text(t: Column, n: Column) -> Column:
        sign = lambda s: n - F.length(F.replace(t, F.lit(s), F.lit("")))
        without = lambda p: F.length(F.regexp_replace(t, p, ""))  # noqa: E731  runs of characters at once
        vowels = let(F.lower(t), lambda low: F.length(low) - F.length(reduce(lambda x, v: F.replace(x, F.lit(v), F.lit("")), "aeiou", low)))
        few = let(without(r"\P{L}+"), lambda letters: (letters > 50) & (vowels / letters < VOWELS))
        return (sign("�") / n > REPLACED) | (sign("\\") / n > BACKSLASHES) | few | ((n - without(r"[^\p{L}\p{N}\s]+")) / n > SYMBOLS)

    return let(strip(c), lambda t: let(F.length(t).cast("double"), lambda n: (n >= 40) & of_text(t, n)))


def toc_fragment(c: Column) -> Column:
    """Whether a text is a table of contents torn into short lines and page numbers."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    n = F.size(lines).cast("double")
    short = F.size(F.filter(lines, lambda x: F.length(x) <= 25))
    numbers = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"^\.*\s*[0-9]{1,4}$"))))
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    return (n >= 6) & (short / n > 0.40) & (numbers / n > 0.15) & (total / n < 22)


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N} ._-]", "-"), "-+", "-")
    s = F.regexp_replace(s, "^[- .]+|[- .]+$", "")
    return F.when(s == "", "rag").otherwise(s)


def device_name(c: Column) -> Column:
    """Lower case, single blanks, without the vendor words in front, each tried once in order."""
    s = F.lower(strip(F.regexp_replace(c, r"\s+", " ")))
    for v in VENDORS:
        s = F.when(F.startswith(s, F.lit(v)), F.substring(s, len(v) + 1, 10_000)).otherwise(s)
    return s


def without_fences(c: Column) -> Column:
    s = F.regexp_replace(strip(c), r"^```[^\n]*\n?", "")
    return strip(F.regexp_replace(s, r"\n?```\s*$", ""))


def without_thinking(c: Column) -> Column:
    """Without reasoning between tags; when nothing is left, what follows the last closing tag, or all but the tags."""
    clean = strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    lone = strip(F.regexp_replace(clean, "</?think>", ""))
    tail = strip(F.element_at(F.split(c, "</think>"), -1))
    bare = strip(F.regexp_replace(c, "</?think>", ""))
    return F.when(clean != "", lone).when(F.contains(c, F.lit("</think>")) & (tail != ""), tail).otherwise(bare)


def without_tags(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def _bare(line: Column, marks: str) -> Column:
    x = F.regexp_replace(strip(line), f"^[{marks}]+|[{marks}]+$", "")
    return F.regexp_replace(F.regexp_replace(x, r'^"+|"+$', ""), r"^'+|'+$", "")


def list_lines(c: Column, query: Column, n: int) -> Column:
    """The first n lines without list marks and quotes, but empty ones and the query itself."""
    kept = F.filter(F.transform(F.split(c, "\n"), lambda x: _bare(x, "-•*0-9. ")), lambda x: (x != "") & (F.lower(x) != F.lower(query)))
    return F.slice(kept, 1, n)


#: Suggestions that fit any corpus, and the shortest one that counts.
GENERIC, GENERIC_START, SHORTEST = ("what topics are covered?", "list the documents and their main points."), "summarize ", 8


def suggestions(c: Column, n: int) -> Column:
    """The first n questions that a model suggests, without list marks and quotes, but short and generic ones."""
    bare = F.transform(F.split(c, "\n"), lambda x: _bare(x, "-•*0-9.) "))
    return F.slice(F.filter(bare, lambda x: (F.length(x) >= SHORTEST) & ~F.startswith(F.lower(x), F.lit(GENERIC_START)) & ~F.lower(x).isin(*GENERIC)), 1, n)


def error_class(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = None
    for name, parts in ERRORS:
        test = any_of(low, parts)
        if name == "model_not_found":
            test = test | (F.contains(low, F.lit("not found")) & F.contains(low, F.lit("model")))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(any_of(low, DOWN), "server_down").otherwise("generic")


def verdict(c: Column) -> Column:
    word = F.regexp_replace(F.lower(F.element_at(F.split(strip(c), r"\s+"), 1)), r"[.,:;!?]+$", "")
    return F.when(word.isin("clean", "garbled", "partial"), word).otherwise("unknown")


def acceptable_correction(c: Column) -> Column:
    s = without_fences(c)
    low = F.lower(s)
    describes = reduce(Column.__or__, [F.startswith(low, F.lit(p)) for p in DESCRIBING])
    return (s != "") & ~F.startswith(F.upper(s), F.lit("UNRECOVERABLE")) & (F.length(s) >= 20) & ~describes


def judge_scores(c: Column) -> list[Column]:
    """Four marks of 0 to 3 in a judge's line, or nulls where it can't be read."""
    line = r"(?is)addresses\s*=\s*(\d).*?specificity\s*=\s*(\d).*?grounded\s*=\s*(\d).*?on_topic\s*=\s*(\d)"
    marks = [F.nullif(F.regexp_extract(c, line, i), F.lit("")).cast("int") for i in range(1, 5)]
    return [F.when(m.isNotNull(), F.least(F.lit(3), m)) for m in marks]
