"""Small cases with known results."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.operators import chunking, expand, ingest, lexical, lookups, prompts, ranking, vectors
from docmill.sources import parsers
from docmill.streaming import events as st


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


def test_attention_order(spark):
    hits = spark.createDataFrame([(1, i + 1) for i in range(8)], "qid int, rank int")
    rows = ranking.attention_order(hits).orderBy("position").collect()
    assert [r["rank"] - 1 for r in rows] == [0, 2, 4, 6, 7, 5, 3, 1]
    two = ranking.attention_order(hits.filter("rank <= 2")).orderBy("position").collect()
    assert [r["rank"] for r in two] == [1, 2]


def test_section_islands(spark):
    rows = [(1, i, s, None) for i, s in enumerate(["Intro", "Intro", "Methods", "Methods", "Conclusion"])]
    ch = expand.section_chapters(spark.createDataFrame(rows, "file_id int, ord int, section string, page int")).orderBy("chapter").collect()
    assert [(c["title"], c["start_ord"], c["end_ord"]) for c in ch] == [("Intro", 0, 1), ("Methods", 2, 3), ("Conclusion", 4, 4)]
    blank = spark.createDataFrame([(1, 0, "", None), (1, 1, "Real", None)], "file_id int, ord int, section string, page int")
    assert [c["title"] for c in expand.section_chapters(blank).collect()] == ["Real"]


def test_find_chapter(spark):
    ch = spark.createDataFrame([(1, 1, "A", 0, 4), (1, 2, "B", 5, 9)], "file_id int, chapter int, title string, start_ord int, end_ord int")
    hits = spark.createDataFrame([(1, 3), (1, 7), (1, 99)], "file_id int, ord int")
    assert {r["ord"]: r["title"] for r in expand.find_chapter(hits, ch).collect()} == {3: "A", 7: "B", 99: None}


def test_collapse_runs(spark):
    from docmill.operators.lines import collapse_runs

    rows = [(1, "\n".join(["No"] * 18)), (2, "\n".join(["No"] * 5)), (3, "\n".join(["a line that is long"] * 9))]
    got = {r["id"]: r["text"] for r in collapse_runs(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert got[1] == "No (×18)" and got[2] == rows[1][1] and got[3] == rows[2][1]


def test_garbled_and_toc(spark):
    prose = "The quick brown fox jumps over the lazy dog and then it goes home to eat."
    assert not one(spark, tx.garbled, prose) and not one(spark, tx.garbled, "Chapter 1")
    assert one(spark, tx.garbled, "\\pell\\ \\td\\ \\xx\\ \\yy\\ and some more words here \\a\\ \\b\\")
    assert one(spark, tx.garbled, "brtkl mnpqr stvwx zzkrt plmnb " * 4)
    assert one(spark, tx.toc_fragment, "Fighter\n59\nMonk\n.61\nOmin Dran.\n..196\nBard\n12")
    assert not one(spark, tx.toc_fragment, "a\nb\nc\nd") and not one(spark, tx.toc_fragment, prose)


def test_text_functions(spark):
    assert one(spark, tx.is_list_query, "Please list  the NPCs: name some") and not one(spark, tx.is_list_query, "why is the sky blue")
    assert one(spark, tx.error_class, None) == "generic" and one(spark, tx.error_class, "CUDA Out Of Memory") == "oom"
    assert one(spark, tx.normalised, " a\t b\n\n\n\nc\x00 ") == "a b\n\nc"
    assert one(spark, tx.slug, "a/b: c!!") == "a-b- c" and one(spark, tx.slug, "!!!") == "rag"


def test_modifiers(spark):
    df = spark.createDataFrame([("q",)], "q string")
    neg = F.array(F.lit("x"), F.lit("y"), F.lit("x"))
    assert df.select(prompts.wrapped(F.col("q"), F.lit("pre"), F.lit(""), neg)).first()[0] == "pre\n\nq\n\nAvoid: x, y"


@pytest.mark.parametrize("n, count, want", [(20, 8, 8), (5, 8, 5)])
def test_stratified(spark, n, count, want):
    rows = [r["i"] for r in lookups.stratified(spark.createDataFrame([(1, i) for i in range(n)], "g int, i int").withColumnRenamed("i", "o").withColumnRenamed("o", "v"), "g", "v", count).withColumnRenamed("v", "i").orderBy("i").collect()]
    assert len(rows) == want and rows[:2] == [0, 1] and rows[-2:] == [n - 2, n - 1]


def test_splitter():
    text = "One two three. Four five six.\n\nSeven eight. " + "w " * 50
    pieces = chunking.split_words(text, 8)
    assert all(len(p.split()) <= 8 for p in pieces)
    assert " ".join(pieces).split() == text.split() or sorted(w.strip(".") for p in pieces for w in p.split()) == sorted(w.strip(".") for w in text.split())


def test_mmr(spark):
    rows = [(1, i, i + 1, 1.0 - i / 10, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)]
    hits = spark.createDataFrame(rows, "qid int, id int, rank int, score double, v array<double>")
    picked = [r["id"] for r in ranking.mmr(hits, "id", "v", 3, 0.5).orderBy("new_rank").collect()]
    assert picked[0] == 0 and picked[1] == 3 and len(picked) == 3
    assert ranking.mmr(hits.filter("rank <= 2"), "id", "v", 3, 0.5).count() == 2


def test_rrf_ignores_order_of_lists(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "qid int, id int, rank int")
    b = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "qid int, id int, rank int")
    x, y = ({r["id"]: round(r["rrf"], 12) for r in ranking.rrf(p, "id").collect()} for p in ([a, b], [b, a]))
    assert x == y and max(x, key=x.get) == 2


def test_query_repeats_count_twice(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "bird"), (3, "fish"), (4, "cow")], "id int, text string")
    q = lambda t: spark.createDataFrame([(1, t)], "qid int, question string")
    s = [lexical.bm25(docs, q(t), "id").first()["score"] for t in ("cat", "cat cat")]
    assert abs(s[1] - 2 * s[0]) < 1e-9
    assert lexical.bm25(docs, q("!!"), "id").count() == 0


def test_vector_width(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "id int, embedding array<double>")
    with pytest.raises(Exception, match="differ in width"):
        vectors.top_k(v, spark.createDataFrame([(1, [1.0])], "qid int, qvec array<double>"), "id", 3).count()


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, sha256 string")
    new = spark.createDataFrame([("b", "2"), ("c", "1")], "path string, sha256 string")
    assert {tuple(r) for r in ingest.upsert(old, new).collect()} == {("a", "1"), ("b", "2"), ("c", "1")}
    assert {r["path"]: r["state"] for r in ingest.diff(old, new).collect()} == {"a": "removed", "b": "changed", "c": "new"}
    again = ingest.diff(new, new)
    assert {r["state"] for r in again.collect()} == {"unchanged"}


def test_health(spark):
    rows = [(0, i, ok) for i, ok in enumerate([True, False, True, False, False, False, True])]
    got = [(r["seq"], r["event"]) for r in st.health(spark.createDataFrame(rows, "device long, seq long, ok boolean")).orderBy("seq").collect()]
    assert got == [(4, "down"), (6, "back")]


def _zip(**files):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return raw.getvalue()


def test_parsers(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{s}\'/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    doc = f'<w:document xmlns:w="{w}"><w:body>{p("first")}{p("Title", "Heading1")}{p("body")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    assert parsers.word_file(_zip(**{"word/document.xml": doc})) == [(None, "", "first"), (None, "Title", "# Title\nbody\na | b")]
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c/></row></sheetData></worksheet>'
    book = _zip(**{"xl/workbook.xml": f'<workbook xmlns="{s}"><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>x</t></si></sst>', "xl/worksheets/sheet1.xml": sheet})
    assert parsers.sheets(book) == [(None, "S", "x | 5")]
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    named = _zip(**{
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="A" r:id="i2"/><sheet name="B" r:id="i1"/></sheets></workbook>', "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>x</t></si></sst>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="i1" Target="worksheets/sheet1.xml"/><Relationship Id="i2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": sheet.replace("<v>5</v>", "<v>6</v>"),
    })
    assert parsers.sheets(named) == [(None, "A", "x | 6"), (None, "B", "x | 5")]
    assert parsers.book(_zip(**{"b.xhtml": "<p>two</p>", "a.html": "<nav>n</nav><p>one</p>", "c.css": "x"})) == [(None, "a.html", "one"), (None, "b.xhtml", "two")]
    assert parsers.mail(b"Subject: hi\nFrom: a@b.c\nContent-Type: text/plain\n\nbody\n") == [(None, "", "Subject: hi\nFrom: a@b.c\nTo: \n\nbody\n")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_bytes("é".encode("latin-1"))
    (tmp_path / "in/b.docx").write_bytes(b"not a zip")
    (tmp_path / "in/c.xyz").write_text("no")
    (tmp_path / "in/d.csv").write_text("a,b\nc,d")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in parsers.parsed(parsers.corpus(spark, str(tmp_path / "in"))).collect()}
    assert set(rows) == {"a.md", "b.docx", "d.csv"}
    assert rows["a.md"]["text"] == "é" and rows["d.csv"]["text"] == "a | b\nc | d" and "BadZipFile" in rows["b.docx"]["error"]


def test_tolerant_json():
    from docmill.functions.tolerant import balanced

    assert balanced('here: {"x": 1} thanks') == '{"x":1}' and balanced("not even close") is None and balanced("") is None
    assert balanced('{bad} {"a": "}"}') == '{"a":"}"}'
