"""Operator 4, mixing sources to target weights by entropy balancing, DataFrame functions only.

Each source has one token constraint: the words that the mix takes from it equal its target. Among all document rates
between 0 and ``CAP`` that meet it, the one of least relative entropy to taking every document once tilts exponentially in the
document's size: ``rate = min(CAP, exp(lambda_source * size / mean size))``. The multipliers maximise a concave dual that is
separate per source; they are found by safeguarded Newton steps, each of which is one distributed aggregate over a table of
(source, size, documents). No per-document state and no group goes to the driver. Steps end when every source is within ``CLOSE``
of its target, which is less than the rounding into copies loses; a dual that isn't solved in ``MAX_STEPS`` is an error.

The rates are then rounded into whole copies: the integer part, and one more for the documents whose hashed uniform number falls
short of the fraction by more than a source's threshold. The threshold is read off two nested histograms; what is left of a
target is then filled ``FILLS`` times with documents that fit into it, so a source's taken words end under its target by less than a
document that would still fit, as far as there are small ones.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
taken 0 words; a source without words has target 0; an empty table gives an empty result; reruns agree, for the
uniform numbers are hashes of the ids (rows that repeat an id get the same number and so the same copies when their
sizes agree); other columns are ignored. Ranks and shares of sources need them in order, which is one task over a row of three numbers
for each source; that is meant for up to ten million sources.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, documents, fresh, n_words, stash, text_of

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL, CAP = 1.5, 2.0
MAX_STEPS, CLOSE = 60, 1e-7
BINS = 2048
#: Times that what is left of a target is filled with smaller documents.
FILLS = 3
#: Sources up to which their parameters are broadcast (under 10 MB); beyond, the join shuffles and Spark splits hot keys.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """skey, source_size, target of every source: shares by weight, cut at ``cap`` times the source's size, the excess
    reshared by weight until none is above. In closed form: sources in order of cap over weight, the first ones full."""
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.min("source").alias("source"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = per.withColumn("w", w).withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "skey").rowsBetween(0, Window.unboundedFollowing)
    budget = ranked.withColumn("all_size", F.sum("source_size").over(everything))
    level = (F.lit(total) * F.col("all_size") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    stepped = budget.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    final = stepped.withColumn("final", F.min(F.when(F.col("fits"), F.struct("ratio", "skey", "level"))).over(everything)["level"])
    target = F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("w") * F.col("final")))
    return final.select("skey", "source_size", target.alias("target"))


def _tilt(lam: Column, x: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * x))))


def solve_dual(hist: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """skey, scale, lam: Newton on every source's dual at once, kept inside a bracket. hist: skey, size, docs.

    The state is a small table, one row per source, written to the shared folder after each step. At the upper end of the bracket
    every document's rate is ``cap``, at the lower end the rates are next to nothing."""
    scale = hist.groupBy("skey").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("scale"), F.min("size").alias("least"))
    short = F.col("scale") / F.col("least")
    state = targets.join(scale, "skey").filter(F.col("target") < cap * F.col("source_size")).select("skey", "target", "scale", F.lit(0.0).alias("lam"), (F.lit(-60.0) * short).alias("lo"), (F.log(F.lit(cap)) * short).alias("hi"), F.lit(1.0).alias("gap"))
    state = stash(state, "dual")
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("scale")
        rate = _tilt(F.col("lam"), x, cap)
        sums = hist.join(_small(state), "skey").groupBy("skey").agg(
            F.sum(F.col("docs") * F.col("size") * rate).alias("have"),
            F.sum(F.when(rate < cap, F.col("docs") * F.col("size") * x * rate)).alias("slope"),
        )
        stepped = state.join(sums, "skey").withColumn("miss", F.col("target") - F.col("have"))
        lo = F.when(F.col("miss") > 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("miss") < 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") + F.col("miss") / F.col("slope")
        inside = F.col("slope").isNotNull() & (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        step = F.when(F.abs("miss") <= CLOSE * F.col("target"), F.col("lam")).when(inside, newton).otherwise((lo + hi) / 2)
        old = state
        state = stash(stepped.select("skey", "target", "scale", step.alias("lam"), lo.alias("lo"), hi.alias("hi"), (F.abs("miss") / F.col("target")).alias("gap")), "dual")
        gap = state.agg(F.max("gap")).first()[0] or 0.0
        discard(old)
        if gap <= CLOSE:
            return state.select("skey", "scale", "lam")
    raise RuntimeError(f"a source is still {gap:.1e} of its target away from it after {MAX_STEPS} steps")


def _small(params: DataFrame) -> DataFrame:
    return F.broadcast(params) if params.count() <= BROADCAST_SOURCES else params


def _threshold(keys: DataFrame, need: DataFrame) -> DataFrame:
    """skey, cut, left: documents whose key is under the cut have sizes that come nearest to ``need`` from below, ``left``
    short of it. Two nested histograms: the first finds the bin in which the running size passes ``need``, the second
    splits that bin once more."""
    state, width = need.select("skey", "need", F.lit(-1.0).alias("lo"), F.lit(0.0).alias("below")), 2.0 / BINS
    for _ in range(2):
        inside = keys.join(_small(state), "skey").filter((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("lo") + width * BINS))
        bins = inside.groupBy("skey", "need", "below", F.floor((F.col("key") - F.col("lo")) / width).alias("bin")).agg(F.sum("size").alias("in_bin"))
        running = F.col("below") + F.sum("in_bin").over(Window.partitionBy("skey").orderBy("bin"))
        rows = bins.withColumn("run", running).groupBy("skey").agg(F.min(F.when(F.col("run") > F.col("need"), F.struct("bin", "run", "in_bin"))).alias("c"), F.max("run").alias("all"))
        lo = F.when(F.col("c").isNull(), F.col("lo") + width * BINS).otherwise(F.col("lo") + F.col("c.bin") * width)
        below = F.coalesce(F.col("c.run") - F.col("c.in_bin"), F.col("all"), F.col("below"))
        state = stash(state.join(rows, "skey", "left").select("skey", "need", lo.alias("lo"), below.cast("double").alias("below")), "cut")
        width /= BINS
    return state.select("skey", F.col("lo").alias("cut"), (F.col("need") - F.col("below")).alias("left"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row. See the module for the method and the cases."""
    sizes = stash(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_of(text_col)).alias("size"))
        .withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))),
        "sizes",
    )
    targets = stash(source_targets(sizes, weights, total, cap), "targets")
    hist = stash(sizes.filter("size > 0").groupBy("skey", "size").agg(F.count(F.lit(1)).alias("docs")), "size-histogram")
    params = targets.join(solve_dual(hist, targets, cap), "skey", "left")
    rate = F.when(F.col("lam").isNull(), F.when(F.col("target") > 0, F.lit(cap)).otherwise(0.0)).otherwise(_tilt(F.col("lam"), F.col("size") / F.col("scale"), cap))
    rated = sizes.join(_small(stash(params, "params")), "skey").withColumn("rate", rate)
    u = (F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    whole = F.floor("rate")
    keyed = stash(rated.withColumn("whole", whole.cast("long")).withColumn("key", u - (F.col("rate") - whole)).select("doc_id", "skey", "size", "source_size", "target", "whole", "key"), "rated")
    need = keyed.groupBy("skey").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"))
    # A document at the cap is whole copies already; the threshold, which can end above 0, is for the others.
    open_ = keyed.filter((F.col("size") > 0) & (F.col("whole") < F.lit(ceil(cap)))).select("doc_id", "skey", "size", "key")
    cuts = _threshold(open_.select("skey", "size", "key"), need)
    # The document at the cut can be long: what is left is filled, each time in another hashed order, with copies that fit into it.
    left = cuts.select("skey", F.col("left").alias("need"))
    now = keyed.join(_small(cuts), "skey", "left").withColumn("copies", F.col("whole") + F.when((F.col("size") > 0) & (F.col("whole") < F.lit(ceil(cap))) & (F.col("key") < F.col("cut")), 1).otherwise(0))
    now = now.select("doc_id", "skey", "size", "source_size", "target", "copies")
    for k in range(FILLS):
        order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(f"fill-{k}")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 51)) - 1
        fits = (F.col("size") > 0) & (F.col("size") <= F.col("need")) & (F.col("copies") < F.lit(int(cap)))
        open_ = stash(now.join(_small(left), "skey", "left").withColumn("key", F.when(fits, order)).drop("need"), "filling")
        found = _threshold(open_.filter("key IS NOT NULL").select("skey", "size", "key"), left)
        left = found.select("skey", F.col("left").alias("need"))
        more = F.when(F.col("key") < F.col("cut"), 1).otherwise(0)
        now = open_.join(_small(found.select("skey", "cut")), "skey", "left").withColumn("copies", F.col("copies") + more).drop("key", "cut")
    copies = F.col("copies").cast("long")
    return now.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every document repeated as often as the mix takes it; its columns are unchanged. Documents without
    words have no part in the mix and stay once. Rows that repeat an id are all repeated by the largest of their copies."""
    t_id, t_copies, t_copy = fresh(docs.columns, "id", "copies", "copy")
    plan = mix(docs, id_col, text_col, source_col).groupBy(F.col("doc_id").alias(t_id)).agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias(t_copies)).filter(F.col(t_copies) > 0)
    joined = docs.join(plan, docs[id_col].eqNullSafe(plan[t_id]))
    return joined.withColumn(t_copy, F.explode(F.sequence(F.lit(1), F.col(t_copies).cast("int")))).select(*[docs[c] for c in docs.columns])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
