"""Near-duplicates against all pairs: every row whose id is divisible by 50, against all rows of a larger table."""

from collections import defaultdict

from test_dedup import shingle_set

from docmill.llm import near_dedup

DATA = "/root/testdata/sf0.1"


def test_links_of_every_fiftieth_row(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    comp = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, size=4).collect()}
    sets = {r["doc_id"]: shingle_set(r["text"], 4) for r in docs.toLocalIterator()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    links, found = 0, 0
    for i in (i for i in sets if i % 50 == 0 and sets[i]):
        common = defaultdict(int)
        for g in sets[i]:
            for j in holders[g]:
                common[j] += 1
        for j, c in common.items():
            if j != i and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                links += 1
                found += comp[i] == comp[j]
    assert links > 50 and found == links
    # Nothing is put together without a chain of links: a document alone in its neighbourhood is its own component.
    assert all(comp[i] == i or comp[i] < i for i in sets)
