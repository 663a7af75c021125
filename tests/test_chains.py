"""Chains of steps against plain Python: sidecar scans, consolidation, paged files, modifiers, chapters of hits, sketches."""

import json
import re
from collections import Counter

from pyspark.sql import functions as F

from docmill.functions.tolerant import balanced
from docmill.operators import expand, lookups, passes, retrieve, scan, sidecars, sketches
from docmill.plans import QUERIES
from docmill.plans.passes import Mirror, Names, Topics
from docmill.scratch import folder
from docmill.sources import paged


def chosen(items, count):
    n = len(items)
    if n <= count:
        return items
    step = max(1, (n - 4) // (count - 4))
    return items[:2] + items[2:-2][::step][: count - 4] + items[-2:]


def scanned(texts):
    """title, description, topics, entities of a file's sections, by the stand-ins."""
    texts = chosen([t.strip() for t in texts if t.strip()], scan.SAMPLE)
    cut = lambda t, n: t[:n] + "…" if len(t) > n else t
    block = lambda ts, n: "\n\n".join(f"[{i}] {cut(t, n)}" for i, t in enumerate(ts, 1))
    if not texts:
        return "", "", "", ""
    bare = lambda r: re.sub(r"\n?```\s*$", "", re.sub(r"^```[^\n]*\n?", "", r.strip())).strip()
    found = balanced(bare(Topics().complete(scan._TOPIC + block(texts, 600), 0)))
    obj = json.loads(found) if found else {}
    topics = [t.strip() for t in obj.get("topics", []) if isinstance(t, str) and t.strip()][:10]
    whole, counts, forms = "\n".join(texts).lower(), {}, {}
    for k in range(0, len(texts), scan.BATCH):
        try:
            reply = Names().complete(scan._ENTITY + block(texts[k : k + scan.BATCH], 400), 0)
        except ValueError:
            continue
        names = json.loads(balanced(reply) or "{}")
        for b in scan.BUCKETS:
            for t in names.get(b, []) if isinstance(names.get(b), list) else []:
                if len(t.strip()) > 1 and t.strip().lower() in whole:
                    counts.setdefault(b, Counter())[t.strip().lower()] += 1
                    forms.setdefault((b, t.strip().lower()), t.strip())
    lists = "; ".join(f"{b}: {', '.join(forms[b, t] for t, _ in sorted(counts[b].items(), key=lambda x: (-x[1], x[0]))[:30])}" for b in scan.BUCKETS if b in counts)
    return str(obj.get("title") or "")[:200], str(obj.get("description") or "")[:500], "|".join(topics), lists


def test_sidecar_scan(spark, data):
    from docmill.sources.tables import chunks

    texts = {}
    for r in chunks(spark, data).orderBy("file_id", "ord").collect():
        texts.setdefault(r["file_id"], []).append(r["text"] or "")
    got = {r["file_id"]: tuple(r)[1:] for r in QUERIES["sidecar_scan"](spark, data).collect()}
    assert got == {k: scanned(t) for k, t in texts.items()}
    assert sum(bool(x[3]) for x in got.values()) > 50 and not any("Unheard" in x[3] for x in got.values())


def test_scan_of_odd_files(spark):
    rows = [(1, 0, None), (1, 1, "  "), (2, 0, "Alpha met Beta in Gamma. " * 3), (3, 5, "lower case only")]
    found = scan.scan(spark.createDataFrame(rows, "file_id long, ord int, text string"), Topics, Names)
    got = {r["file_id"]: r for r in found.collect()}
    assert set(got) == {1, 2, 3} and got[1]["title"] == "" and got[1]["topics"] == [] and got[1]["entities"] == []


def test_consolidation(spark):
    texts = [("a", "The Red Dragon sleeps"), ("a", "near Blackwater, the dragon's lair"), ("b", "nothing of it"), ("a", None), ("a", "xy")]
    terms = [("a", "m", 1, "red dragon"), ("a", "m", 2, "Red Dragon"), ("a", "l", 3, " Blackwater "), ("a", "l", 4, "Whitewater"), ("b", "m", 5, "Red Dragon"), ("a", "l", 6, "x"), ("a", "l", 7, "XY"), ("a", "l", 8, "ea"), ("a", "l", 9, "the dragon's"), ("c", "l", 1, "anything")]
    found = lookups.consolidate(spark.createDataFrame(terms, "grp string, bucket string, pos int, term string"), spark.createDataFrame(texts, "grp string, text string"))
    assert sorted(map(tuple, found.collect())) == [("a", "l", "Blackwater", 1, 1), ("a", "l", "XY", 1, 4), ("a", "l", "ea", 1, 2), ("a", "l", "the dragon's", 1, 3), ("a", "m", "red dragon", 2, 1)]


def test_only_asked_pages_are_recognised(spark):
    ok = "a readable page of text that holds enough words to be judged at all, and some more "
    broken = ok.replace("a", "\\").replace("e", "\\")
    files = {1: [("", "scanned " + ok), ("", " ")], 2: [(ok * 2, "x"), (broken, ok), (" ", ok)], 3: [(ok, ok)] * 30, 4: [("", "")]}
    rows = [(k, [(n, layer, ocr[::-1].encode()) for n, (layer, ocr) in enumerate(ps, 1)]) for k, ps in files.items()]
    path = folder(spark, "paged-test")
    assert paged.write_paged(spark.createDataFrame(rows, "file_id long, pages array<struct<page: int, text: string, picture: binary>>"), path) == 4
    pages = paged.read_pages(spark, path, range=400)
    assert pages.rdd.getNumPartitions() > 8  # a file is many tasks
    layer = pages.withColumn("file_id", F.regexp_extract("path", r"(\d+)\.paged$", 1).cast("long"))
    assert sorted((r["file_id"], r["page"], r["text"]) for r in layer.collect()) == sorted((k, n, t) for k, ps in files.items() for n, (t, _) in enumerate(ps, 1))
    seen = paged.recognised(passes.to_recognise(layer), path, Mirror)
    got = sorted((int(re.findall(r"(\d+)\.paged", r["path"])[0]), r["page"], r["ocr"]) for r in seen.collect())
    assert got == [(1, 1, "scanned " + ok), (1, 2, " "), (2, 2, ok), (4, 1, "")]

    class Bad(Mirror):
        def __call__(self, picture):
            raise ValueError

    assert {r["ocr"] for r in paged.recognised(passes.to_recognise(layer), path, Bad).collect()} == {""}
    assert sorted((r["file_id"], r["page"], r["origin"]) for r in passes.recovered(layer.join(seen, ["path", "page"], "left")).collect() if r["file_id"] < 3) == [(1, 1, "scan"), (2, 1, "layer"), (2, 2, "recognised")]


def test_modifiers_of_a_question(spark):
    batch = spark.createDataFrame([(1, "how does grappling work?"), (2, "plain")], "qid long, question string")
    meta = spark.createDataFrame([(1, 1, "a", "how does grappling work?", "global", [], "In D&D 5e:", "Use 5e terminology.", ["Pathfinder", "3.5e", "pathfinder"])], "qid long, rank int, path string, question string, scope string, topics array<string>, prefix string, suffix string, negatives array<string>")
    got = {r["qid"]: r["searched"] for r in sidecars.modified(batch, meta, "", "", []).collect()}
    assert got == {1: "In D&D 5e: how does grappling work? Use 5e terminology.  Avoid: Pathfinder, 3.5e", 2: "plain"}
    own = {r["qid"]: r["searched"] for r in sidecars.modified(batch, meta.limit(0), "Pre", "Post", ["x"]).collect()}
    assert own[2] == "Pre plain Post  Avoid: x"


def test_chapters_of_hits(spark):
    chunks = spark.createDataFrame([(f, o, f"t{f}.{o}" if o != 4 else "") for f in (1, 2) for o in range(6)], "file_id long, ord int, text string")
    chapters = spark.createDataFrame([(1, 1, "A", 0, 2), (1, 2, "B", 3, 5), (1, 3, "A", 2, 3), (2, 1, "C", 4, 4)], "file_id long, chapter int, title string, start_ord int, end_ord int")
    hits = [(9, f * 10 + o, f, o, r, f"t{f}.{o}", "s", "vec") for r, (f, o) in enumerate([(1, 2), (1, 0), (1, 5), (2, 4), (2, 0)], 1)] + [(8, 11, 1, 1, 1, "t1.1", "s", "fts")]
    df = spark.createDataFrame(hits, "qid long, doc_id long, file_id long, ord int, rank int, text string, source string, kind string")
    places = retrieve.Places(chunks, chapters)
    got = {(r["qid"], r["file_id"], r["ord"]): (r["kind"], r["section"], r["text"]) for r in retrieve.to_chapters(df, places, 14).collect()}
    assert got == {
        (9, 1, 2): ("chapter-skip", None, "t1.2"), (9, 1, 0): ("chapter-dup", None, "t1.0"), (9, 1, 5): ("chapter", "B", "t1.3\n\nt1.5"),
        (9, 2, 4): ("vec", None, "t2.4"), (9, 2, 0): ("vec", None, "t2.0"), (8, 1, 1): ("chapter-skip", None, "t1.1"),
    }
    assert {r["text"] for r in retrieve.to_chapters(df, places, 100).filter("qid = 8").collect()} == {"t1.0\n\nt1.1\n\nt1.2"}
    near = {(r["file_id"], r["ord"]): r["text"] for r in retrieve.with_neighbours(df.filter("qid = 9"), chunks, 1).collect()}
    assert near[1, 0] == "t1.0\n\nt1.1" and near[1, 2] == "t1.1\n\nt1.2\n\nt1.3" and near[1, 5] == "\n\nt1.5"


def test_outline_goes_first(spark):
    chunks = spark.createDataFrame([(f, o, s, o + 1) for f, names in ((1, "aabb"), (2, "aabb"), (3, "cccc")) for o, s in enumerate(names)], "file_id long, ord int, section string, page int")
    outline = spark.createDataFrame([(1, 0, "One", 2), (1, 1, "Two", 4), (4, 0, "None", 1)], "file_id long, pos int, title string, page int")
    got = sorted(tuple(r) for r in expand.dispatched(chunks, outline).collect())
    assert got == [(1, 1, "One", 0, 2), (1, 2, "Two", 3, 3), (2, 1, "a", 0, 1), (2, 2, "b", 2, 3), (3, 1, "Document", 0, 3)]


def test_sketches_are_rolled_up_without_the_rows(spark):
    days = sketches.DaySketches(spark, folder(spark, "sketches-test"))
    rows = spark.range(60_000).selectExpr("CAST(id % 3 AS STRING) AS grp", "date_add(DATE'2024-01-01', CAST(id % 17 AS INT)) AS day", "CAST(pmod(xxhash64(id), 100000) AS DOUBLE) AS value")
    days.update(rows)
    days.update(rows.filter("day = DATE'2024-01-03'"))  # the same day again counts once
    ranks = [0.0, 0.1, 0.5, 0.95, 1.0]
    for where, part in ((None, rows), (F.col("day") < "2024-01-06", rows.filter("day < DATE'2024-01-06'"))):
        for r in days.rollup(ranks, where).collect():
            values = sorted(x["value"] for x in part.filter(F.col("grp") == r["grp"]).collect())
            assert r["n"] == len(values) and (r["low"], r["high"]) == (values[0], values[-1])
            for q, v in zip(ranks, r["q"], strict=True):
                below, upto = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
                assert below - sketches.BOUND <= q <= upto + sketches.BOUND
    assert "sketch" in days.store.tables["days"] and len(days.store.log()) == 2


def test_a_scan_makes_its_sections_once(spark):
    from pyspark.sql import functions as F

    from docmill.operators import scan
    from docmill.plans.passes import Names, Topics

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return f"Words of Section {i} and more" if i % 7 else " "

    sections = spark.range(0, 300, 1, 3).select((F.col("id") % 20).alias("file_id"), (F.col("id") / 20).cast("int").alias("ord"), text(F.col("id")).alias("text"))
    assert scan.scan(sections, Topics, Names).count() == 20
    assert seen.value == 300
