"""Operator 10, personal data by patterns and information-theoretic sanitisation, DataFrame functions only.

Base: e-mail addresses, IP addresses, card numbers and phone numbers by pattern, with their code-point spans. A span comes from
the lengths of the pieces between matches, so no Python is needed. The patterns are written with possessive repeats and
anchors at the start of a run, which match the same strings but neither backtrack nor recurse on very long texts.

Method: the corpus tells how strongly a term reveals a protected entity. Terms are all words: runs of letters, marks and digits
that stand outside of entities. For an entity e and a term t of one document, however far apart, disclosure is the pointwise
mutual information ``log2(P(e | t) / P(e)) = log2(both * documents / (with t * with e))``; t discloses e when ``P(e | t)``
reaches ``REVEALS``, at least ``SUPPORT`` documents show both, and the information reaches ``GENERALISE_BITS``. Counts are of
documents (rows) over the whole corpus. Spans of disclosing terms are added in every document that has them, with or without the
entity; at ``REMOVE_BITS`` or more the term is removed from the sanitised text, below it is generalised to ``[NAME]``.

Scale: entity-term rows come only from documents with entities, and only for entities that can still be disclosed: those in ``SUPPORT``
documents that aren't so common that no term could give the bits. Entities that stand in the same documents count as one, and so do terms, so a long list of
contacts in copies of a text isn't multiplied with its words. Of what is left a document makes pairs of an entity and those of its terms only
that are rare enough for ``REVEALS``. None of this changes the result. All counts are by (entity, term) with map-side partial sums, so a
frequent entity isn't one task; lists are broadcast only when their counted size is under ``BROADCAST_TERMS``, and joined by a
shuffle beyond that.

Terms are looked up in every text on the map side as long as there are ``LITERAL_TERMS`` at most; their table then travels with the
plan, laid out in as many small lists as there are terms, so a look-up costs the same for any number. With more terms the words of
the texts are joined with them, and texts with what was found.

Texts are sanitised one kind after another in the order of ``KINDS``, terms last, and put together from pieces, so the time is in
proportion to the text. Arrays that a fold builds grow in blocks of ``FOLD``, so a text may have any number of matches.

Defined cases: a null or empty text has no spans; overlapping spans of different kinds are all reported, and the first kind replaces
the text that they share; rows that repeat an id have their own spans; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, stash, text_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
TERM = r"[\p{L}\p{M}\p{N}]++"
SUPPORT, REVEALS, GENERALISE_BITS, REMOVE_BITS = 3, 0.9, 4.0, 10.0
BROADCAST_TERMS, LITERAL_TERMS = 200_000, 5_000
FOLD = 256

SPAN = "array<struct<kind:string,start:int,stop:int>>"


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _located(text: Column, pattern: str, wanted=None) -> Column:
    """array<struct<start, stop, value>> of all matches, or of those whose value is wanted, in code points."""
    found, gaps = _pieces(text, pattern)

    def step(acc, x):
        start = acc["at"] + F.char_length(x["gap"])
        stop = start + F.char_length(x["value"])
        out = F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value"))))
        return F.struct(stop.alias("at"), (out if wanted is None else F.when(wanted(x["value"]), out).otherwise(acc["out"])).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return _folded(pairs, "struct<start:int,stop:int,value:string>", step)


def _folded(items: Column, kind: str, step, last=None) -> Column:
    """The array that ``step`` builds from (at, out) and each item, block by block: appending copies a block, not all there is.
    ``last`` may turn the final position into one more array."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(items) / FOLD).cast("int") - 1)), lambda b: F.slice(items, b * FOLD + 1, F.lit(FOLD)))
    none = F.expr(f"cast(array() AS array<{kind}>)")

    def block(acc, x):
        inner = F.aggregate(x, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        joined = F.transform(F.array(inner), lambda y: F.struct(y["at"].alias("at"), F.concat(acc["out"], F.array(y["out"])).alias("out")))
        return joined[0]

    end = (lambda acc: F.flatten(acc["out"])) if last is None else (lambda acc: F.concat(F.flatten(acc["out"]), last(acc["at"])))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() AS array<array<{kind}>>)").alias("out")), block, end)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The card check sum: from the right, every second digit doubled, less 9 where that passes 9."""
    reverse = F.split(F.reverse(digits), "")

    def term(d, i):
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.filter(reverse, lambda d: d != ""), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, "\\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_matches(text: Column, kind: str) -> Column:
    """array<struct<start, stop, value>> of the kind's matches that pass its check."""
    none = F.expr("cast(array() AS array<struct<start:int,stop:int,value:string>>)")
    return F.when(text.rlike(NEEDS[kind]), F.filter(_located(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))).otherwise(none)


def with_base(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id, text, an array of matches for each kind, and the columns ``more``."""
    plain = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *more)
    return plain.select("doc_id", "text", *more, *[base_matches(F.col("text"), k).alias(k) for k in KINDS])


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _outside() -> Column:
    """The text with a blank in place of every entity."""
    rest = F.col("text")
    for kind in KINDS:
        rest = F.when(F.size(kind) > 0, _replaced(rest, PATTERNS[kind], _marked(kind, " "))).otherwise(rest)
    return rest


def entities_and_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """entities and words of each row: its distinct entities, and its distinct words outside of them."""
    based = with_base(docs, id_col, text_col)
    hashed = lambda k: F.transform(k, lambda m: F.xxhash64(F.lit(k), m["value"]))
    rest = based.select(F.array_distinct(F.concat(*map(hashed, KINDS))).alias("entities"), _outside().alias("rest"))
    return rest.select("entities", _words(F.col("rest")).alias("words"))


def _classes(postings: DataFrame, of: str) -> DataFrame:
    """of, n, a, b: how many rows hold each value, and two hashes of the set of these rows."""
    return postings.groupBy(of).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b"))


def _firsts(classes: DataFrame, of: str) -> DataFrame:
    """One value for each set of rows."""
    return classes.groupBy("n", "a", "b").agg(F.min(of).alias(of)).select(of, "n")


def met(seen: DataFrame, entities: DataFrame, terms: DataFrame) -> DataFrame:
    """entity, term, n_seen for each row of ``seen`` (row, entities, words) in which both occur and the term may reveal the entity. entities: entity,
    n_e; terms: term, n_seen. Both lists of a row are brought together once, and a pair is made only if the term isn't too common for the entity."""
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_TERMS else df
    left = seen.select("row", F.explode("entities").alias("entity")).join(small(entities), "entity").groupBy("row").agg(F.collect_list(F.struct("entity", "n_e")).alias("es"))
    right = seen.select("row", F.explode("words").alias("term")).join(small(terms), "term").groupBy("row").agg(F.collect_list(F.struct("term", "n_seen")).alias("ts"))
    each = left.join(right, "row").select(F.explode("es").alias("e"), "ts")
    reach = F.filter("ts", lambda t: t["n_seen"] * REVEALS <= F.col("e.n_e") * (1 + 1e-9))
    return each.select("e.entity", F.explode(reach).alias("t")).select("entity", "t.term", "t.n_seen")


def disclosing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, bits: the terms that reveal some protected entity of the corpus, with the most information that they give."""
    rows = entities_and_words(docs, id_col, text_col)
    marked = F.when(F.size("entities") > 0, F.col("words")).alias("words")
    seen = stash(rows.select(F.monotonically_increasing_id().alias("row"), "entities", marked), "entity-words").filter("size(entities) > 0")
    n = docs.count()
    # P(e | t) is 1 at most, so a more common entity can't reach the bits by any term.
    possible = (F.col("n") >= SUPPORT) & (F.col("n") * 2**GENERALISE_BITS <= n * (1 + 1e-9))
    with_entity = _firsts(_classes(seen.select("row", F.explode("entities").alias("entity")), "entity").filter(possible), "entity")
    with_entity = stash(with_entity.withColumnRenamed("n", "n_e"), "entity-counts")
    most = with_entity.agg(F.max("n_e").alias("n")).first()["n"] or 0
    # A term that more rows with entities hold than P(e | t) allows for the most common of them reveals none.
    open_ = (F.col("n") >= SUPPORT) & (F.col("n") * REVEALS <= most * (1 + 1e-9))
    classes = stash(_classes(seen.select("row", F.explode("words").alias("term")), "term").filter(open_), "term-classes")
    firsts = stash(_firsts(classes, "term").withColumnRenamed("n", "n_seen"), "term-counts")
    both = met(seen, with_entity, firsts).groupBy("entity", "term", "n_seen").agg(F.count(F.lit(1)).alias("n_both"))
    both = both.filter((F.col("n_both") >= SUPPORT) & (F.col("n_both") / F.col("n_seen") >= REVEALS)).join(with_entity, "entity")
    # What holds for a term holds for all that stand in the same rows.
    found = both.select("term", "n_both", "n_e").distinct().join(classes.select("term", "n", "a", "b"), "term").drop("term")
    alike = stash(found.join(classes, ["n", "a", "b"]).select("term", "n_both", "n_e"), "entity-term-counts")
    wanted = alike.select("term").distinct()
    n_wanted = wanted.count()
    # explode() would add a filter on the words' number, for which the patterns run a second time; the joins drop null terms.
    terms = rows.select(F.explode_outer("words").alias("term"))
    if n_wanted <= BROADCAST_TERMS:
        terms = terms.join(F.broadcast(wanted), "term", "left_semi")
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    scored = alike.join(df, "term").withColumn("p", F.col("n_both") / F.col("n_t")).withColumn("bits", F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_t") * F.col("n_e"))))
    return scored.filter((F.col("p") >= REVEALS) & (F.col("bits") >= GENERALISE_BITS)).groupBy("term").agg(F.max("bits").alias("bits"))


TERMS_TYPE = "array<struct<start:int,stop:int,value:string,bits:double>>"


def _listed(terms: list[tuple[str, float]]):
    """A function from a word to the bits of the term that it is, or null, with the terms in the plan."""
    lists: list[list[dict]] = [[] for _ in range(max(1, len(terms)))]
    spark = SparkSession.getActiveSession()
    hashes = spark.createDataFrame([(t,) for t, _ in terms] or [("",)], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(len(lists))).alias("h")).collect()
    where = {r["t"]: r["h"] for r in hashes}
    for term, bits in terms:
        lists[where[term]].append({"t": term, "b": bits})
    table = F.from_json(F.lit(json.dumps(lists)), "array<array<struct<t:string,b:double>>>")  # folded into a constant
    return lambda v: F.get(F.filter(F.get(table, F.pmod(F.xxhash64(v), F.lit(len(lists))).cast("int")), lambda x: x["t"] == v), F.lit(0))["b"]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, one array of matches per kind, and ``terms``: matches of disclosing terms with their bits."""
    listed = stash(disclosing_terms(docs, id_col, text_col), "disclosing-terms")
    n_terms = listed.count()
    if n_terms <= LITERAL_TERMS:
        found = [(r["term"], r["bits"]) for r in listed.orderBy("term").collect()]
        bits = _listed(found)
        based = with_base(docs, id_col, text_col)
        if not n_terms:
            return based.withColumn("terms", F.expr(f"cast(array() AS {TERMS_TYPE})"))
        # Most texts hold no such term, which one look at all their words tells: positions are for the others.
        any_term = F.arrays_overlap(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.from_json(F.lit(json.dumps([t for t, _ in found])), "array<string>"))
    else:
        row, t_id = "row", "id"
        numbered = docs.select(F.col(id_col).alias(t_id), text_of(text_col).alias("text")).withColumn(row, F.xxhash64(t_id, "text"))
        words = numbered.select(row, F.explode(_words(F.col("text"))).alias("term"))
        held = words.join(F.broadcast(listed) if n_terms <= BROADCAST_TERMS else listed, "term").groupBy(row).agg(F.map_from_entries(F.collect_set(F.struct("term", "bits"))).alias("held"))
        based = with_base(numbered.join(held, row, "left"), t_id, "text", "held")
        bits, any_term = (lambda v: F.element_at(F.col("held"), v)), F.col("held").isNotNull()
    located = _located(F.col("text"), TERM, lambda v: bits(v).isNotNull())
    matches = F.transform(located, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value"), bits(m["value"]).alias("bits")))
    return based.select("doc_id", "text", *KINDS, F.coalesce(F.when(any_term, matches), F.expr(f"cast(array() AS {TERMS_TYPE})")).alias("terms"))


def _spans(kind: str, col: str) -> Column:
    return F.transform(F.col(col), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _action(bits: Column) -> Column:
    return F.when(bits >= REMOVE_BITS, "remove").otherwise("generalise")


def _marked(kind: str, mark: str):
    return lambda v: F.when(_valid(kind, v), mark).otherwise(v)


def _replaced(text: Column, pattern: str, put) -> Column:
    """The text with ``put(match)`` in place of every match of the pattern."""
    found, gaps = _pieces(text, pattern)
    pieces = F.zip_with(gaps, F.transform(found, put), lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    return F.array_join(pieces, "")


def sanitise(found: DataFrame) -> DataFrame:
    """``found`` with ``clean``: the text with entities replaced by ``[KIND]``, disclosing terms by ``[NAME]`` or by nothing."""
    out = found.withColumn("clean", F.col("text"))
    for kind in KINDS:
        put = _marked(kind, f"[{kind.upper()}]")
        out = out.withColumn("clean", F.when(F.size(kind) > 0, _replaced(F.col("clean"), PATTERNS[kind], put)).otherwise(F.col("clean")))
    held = F.map_from_entries(F.array_distinct(F.transform("terms", lambda m: F.struct(m["value"], _action(m["bits"])))))
    marks = [f"[{k.upper()}]" for k in KINDS]
    out = out.withColumn("held", held)
    act = lambda v: F.when(F.element_at("held", v) == "remove", "").when(F.element_at("held", v) == "generalise", "[NAME]").otherwise(v)
    put = lambda v: F.when(v.isin(marks), v).otherwise(act(v))
    words = "|".join(rf"\\[{k.upper()}\\]" for k in KINDS) + "|" + TERM
    return out.withColumn("clean", F.when(F.size("terms") > 0, _replaced(F.col("clean"), words, put)).otherwise(F.col("clean"))).drop("held")


def base_columns() -> tuple[list[Column], Column]:
    """The base columns of the contract from the matches of each kind, and the base spans."""
    base = F.concat(*[_spans(k, k) for k in KINDS])
    return [*[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256")], base


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, then the terms found, what is done to each (start:stop:action), and a digest of the sanitised text."""
    found = sanitise(find_personal_data(documents(spark, sf_dir)))
    columns, base = base_columns()
    actions = F.array_join(F.transform("terms", lambda m: F.concat_ws(":", m["start"].cast("string"), m["stop"].cast("string"), _action(m["bits"]))), ",")
    return found.select(
        "doc_id", *columns, _joined(F.concat(base, _spans("term", "terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"), actions.alias("actions"), F.sha2(F.encode("clean", "UTF-8"), 256).alias("clean_sha256"),
    )
