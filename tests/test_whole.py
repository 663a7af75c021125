"""Queries read whole texts and all rows: brute force in plain Python."""

import re
from collections import defaultdict

import pandas as pd

from docmill.operators import lookups
from docmill.plans import QUERIES


def test_consolidate_entities(spark, data):
    docs = pd.read_parquet(f"{data}/documents.parquet").sort_values("doc_id")
    texts, forms = defaultdict(list), defaultdict(list)
    for r in docs.itertuples():
        texts[r.source].append((r.text or "").lower())
    for r in docs.itertuples():
        m = re.search("[A-Za-z]+", r.text or "")
        if m and len(m[0]) > 1 and any(m[0].lower() in t for t in texts[r.source]):
            forms[r.source, r.lang, m[0].lower()].append(m[0])
    want = []
    for bucket in {k[:2] for k in forms}:
        best = sorted((-len(f), k[2], f[0]) for k, f in forms.items() if k[:2] == bucket)[:30]
        want += [(*bucket, form, -n, i + 1) for i, (n, _, form) in enumerate(best)]
    got = QUERIES["consolidate_entities"](spark, data).select("grp", "bucket", "form", "n", "place").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_consolidate_looks_in_all_texts(spark):
    found = spark.createDataFrame([(1, "b", 1, "Volo"), (1, "b", 2, "VOLO"), (1, "b", 3, "Made"), (2, "b", 4, "Volo")], "grp int, bucket string, pos int, term string")
    texts = spark.createDataFrame([(1, "nothing"), (1, "x" * 400 + " volo"), (2, "made")], "grp int, text string")
    assert [tuple(r) for r in lookups.consolidate(found, texts).collect()] == [(1, "b", "Volo", 2, 1)]


def test_chat_lines_and_merge_modifiers(spark, tmp_path):
    """Turns beyond 20 characters keep their rest; notes that share their first 12 characters stay apart."""
    turns = [(1, 1, "user", "The same first words, and an end"), (1, 2, "bot", "the same first words, and AN END"), (1, 3, "user", "The same first words, another end"), (2, 1, "user", "é")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    chats = {r["conv_id"]: (r["turns"], r["chat"]) for r in QUERIES["chat_lines"](spark, str(tmp_path)).collect()}
    assert chats == {1: (3, "\n".join(f"{role}: {text}" for _, _, role, text in turns[:3])), 2: (1, "user: é")}
    merged = {r["conv_id"]: r["merged"] for r in QUERIES["merge_modifiers"](spark, str(tmp_path)).collect()}
    assert merged == {1: "the same first words, and an end|the same first words, another end", 2: "é"}


def test_consolidate_writes_forms_not_words(spark, monkeypatch):
    """Short and long terms, within words and across them, against plain Python; what is written has a row for each form, not for each term."""
    kept = lookups.stored
    written = []
    monkeypatch.setattr(lookups, "stored", lambda df, name: written.append(kept(df, name)) or written[-1])
    texts = ["Éclair lieutenantship abc-def", "x" * 30 + "tenantshipmate q2 w", "zz\nabc de", "NO"]
    terms = ["Tenantsh", "tenantshipm", "TENANTSHIPS", "abc-d", "c d", "bc", "q2", "éc", "zz\na", "zz a", "no", "cd", "lieutenantship"] * 2
    found = spark.createDataFrame([(1, "b", i, t) for i, t in enumerate(terms)], "grp int, bucket string, pos int, term string")
    whole = spark.createDataFrame([(1, t) for t in texts] + [(2, "cd tenantships")], "grp int, text string")
    want = sorted({t.lower() for t in terms if any(t.lower() in x.lower() for x in texts)})
    got = lookups.consolidate(found, whole).collect()
    assert [r["form"].lower() for r in sorted(got, key=lambda r: r["place"])] == want and all(r["n"] == 2 for r in got)
    assert {r["form"] for r in got} <= set(terms)
    assert max(df.count() for df in written) == len({t.lower() for t in terms})
