"""Operators over single texts against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as some

from docmill.llm import bpe, pii, quality_model, quality_rules, secrets_crf, token_counts
from docmill.llm import textbatch as tb

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, " ", "\n\n", "a", "a b\n\na b\na b", "x " * 50, "é ü\tñ\x0bz " * 9, "aaa\nbbb\naaa\r\naaa\r\n", "one two three four five six seven eight nine " * 4, "w" * 30_000, "a b " * 9000]


def frame(spark, texts):
    rows = [(i, t, 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, score string")


def test_quality_measures(spark, data):
    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)

    texts = TEXTS + pd.read_parquet(f"{data}/documents.parquet").text.tolist()
    got = quality_rules.judge_quality(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:7] for r in got] == [brute(t) for t in texts]
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality_rules.judge_quality(frame(spark, [])).count() == 0


def test_quality_keeps_clean_documents(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    got = quality_rules.judge_quality(d).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    fine = got[~got.base_failed]
    assert (fine[fine.quality == 1].kept).mean() > 0.99 and not fine[fine.quality == 0].kept.all()


def test_quality_model_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = quality_model.op6_quality_model(spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert all(h == quality_model.held_out(i) for h, i in zip(got.held_out, got.doc_id, strict=True))


def test_quality_model_odd_inputs(spark):
    docs = frame(spark, TEXTS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.fit(*quality_model.training_rows(docs, none))
    got = quality_model.score_rows(docs, model, score_col="s").collect()
    assert len(got) == len(TEXTS) and all(abs(r["s"] - 0.5) < 1e-9 for r in got)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (99, None)], "doc_id long, quality int")
    x, y = quality_model.training_rows(docs, labels)
    assert len(x) == len(y) == sum(not quality_model.held_out(i) for i in range(12))
    assert quality_model.keep_good(frame(spark, []), labels).count() == 0


@settings(max_examples=300, deadline=None)
@given(some.text(alphabet=some.sampled_from("abcdefé ñ\n\t'sretmvlld.,;!?0123 漢🙂\x1c\x85A"), max_size=160))
def test_bpe_joins(text):
    coder = bpe.encoder(RANKS, leaf=8, piece_leaf=4)
    ids = coder.encode(text)
    assert ids == coder.core.encode_ordinary(text) and coder.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["a" * 5000, "ab1" * 3000, "é" * 3000, " " * 5000, "xyz " * 5000, "'" * 900 + "re" * 900])
def test_bpe_long(text):
    coder = bpe.encoder(RANKS, leaf=256, piece_leaf=32)
    assert coder.encode(text) == coder.core.encode_ordinary(text)


def test_bpe_recent_characters():
    """Letters and digits that only some Unicode versions know, next to signs and contractions, in long texts without spaces."""
    coder = bpe.encoder(RANKS)
    odd = [chr(c) for c in (0x323B0, 0xA7CB, 0x1C89, 0x10D40, 0x2B7, 0x16EA0, 0x1E5D0, 0x11BC0, 0xA7DC, 0x33480, 0x180E, 0x85, 0x1C)]
    rnd = random.Random(8)
    spread = [chr(c) for c in range(128, 0x32400, 7) if not 0xD800 <= c < 0xE000]
    for k in range(300):
        alphabet = [*rnd.sample(odd, 5), *rnd.sample(spread, 20), "?", "'s", "'d", "'", "a", "1", *([" "] if k % 3 == 0 else [])]
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([200, 700, 900, 2500])))
        ids = coder.encode(text)
        assert ids == coder.core.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_bpe_query(spark):
    core = bpe.encoder(RANKS).core
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    got = bpe.encode_decode(frame(spark, TEXTS), RANKS, ids=True).orderBy("doc_id").collect()
    for r, t in zip(got, TEXTS, strict=True):
        ids = core.encode_ordinary(t or "")
        assert (r["n_tokens"], r["ids"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), ids, sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    assert bpe.encode_decode(frame(spark, []), RANKS).count() == 0


def test_token_counts(spark):
    texts = ["first line\nsecond one\n", "", None, "no feed", "a\n\n\nb", "x" * 3000]
    core = bpe.encoder(RANKS).core
    for rule in token_counts.RULES:
        got = token_counts.count_tokens(frame(spark, texts), RANKS, rule=rule).orderBy("doc_id").collect()
        for r, t in zip(got, texts, strict=True):
            assert r["n_tokens"] == len(core.encode_ordinary(t or "")) and abs(sum(r["section_tokens"]) - r["n_tokens"]) < 1e-9
    assert token_counts.count_tokens(frame(spark, []), RANKS).count() == 0


def test_token_rules():
    starts, stops = np.array([0, 3, 6]), np.array([3, 6, 9])
    lo, hi = np.array([0, 4]), np.array([4, 8])
    share = lambda rule: token_counts.allocate(starts, stops, lo, hi, rule)
    assert share("start")[0].tolist() == [2, 1] and share("most")[0].tolist() == [1, 2]
    counts, crossing, outside = share("split")
    assert np.allclose(counts, [4 / 3, 4 / 3]) and crossing == 2 and abs(outside - 1 / 3) < 1e-9
    assert token_counts.allocate(starts, stops, lo[:0], hi[:0], "start") [2] == 3


def brute_allocation(tokens, sections, rule):
    """Bytes belong to the first section that starts at or before them; each token goes by the rule."""
    order = sorted(range(len(sections)), key=lambda k: (sections[k][0], k))
    owner = {}
    for k in order:
        for b in range(*sections[k]):
            owner.setdefault(b, k)
    out, outside = [0.0] * len(sections), 0.0
    for a, z in tokens:
        held = [owner.get(b) for b in range(a, z)]
        if rule == "start":
            k = held[0]
        elif rule == "most":
            first = {k: n for n, k in reversed(list(enumerate(held))) if k is not None}
            k = max(first, key=lambda x: (held.count(x), -first[x])) if first else None
        else:
            for k in held:
                if k is None:
                    outside += 1 / (z - a)
                else:
                    out[k] += 1 / (z - a)
            continue
        if k is None:
            outside += 1
        else:
            out[k] += 1
    return out, outside


@settings(max_examples=300, deadline=None)
@given(some.lists(some.integers(1, 6), max_size=25), some.lists(some.tuples(some.integers(0, 70), some.integers(1, 20)), max_size=8), some.sampled_from(token_counts.RULES))
def test_token_allocation(lengths, spans, rule):
    stops = np.cumsum(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
    starts = stops - np.array(lengths, np.int64)
    sections = [(a, a + n) for a, n in spans]
    lo, hi = (np.array([s[k] for s in sections], np.int64) for k in (0, 1))
    counts, _, outside = token_counts.allocate(starts, stops, lo, hi, rule)
    want, want_outside = brute_allocation(list(zip(starts.tolist(), stops.tolist(), strict=True)), sections, rule)
    assert np.allclose(counts, want) and abs(outside - want_outside) < 1e-9


def test_token_sections_of_documents(spark, data):
    """Every line of every document: tokens by their first byte, by brute force over the tokens."""
    texts = pd.read_parquet(f"{data}/documents.parquet").text.tolist()[:60]
    coder = bpe.encoder(RANKS)
    got = token_counts.count_tokens(frame(spark, texts), RANKS).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        raw, at, per = (t or "").encode(), 0, {}
        for i in coder.core.encode_ordinary(t or ""):
            line = raw[:at].count(b"\n")
            per[line] = per.get(line, 0) + 1
            at += len(coder.bytes[i])
        n_lines = raw.count(b"\n") + (not raw.endswith(b"\n") if raw else 0)
        assert r["section_tokens"] == [per.get(k, 0) for k in range(n_lines)]


def test_token_spans(spark):
    df = spark.createDataFrame([(1, "hello world again", [(0, 5), (5, 11)]), (2, "é x", None)], "doc_id long, text string, spans array<struct<start:int,stop:int>>")
    a, b = token_counts.count_tokens(df, RANKS, spans_col="spans").orderBy("doc_id").collect()
    assert a["section_tokens"] == [1, 1] and a["n_outside"] == 1 and b["section_tokens"] == [] and b["n_outside"] == b["n_tokens"]


SECRETS = TEXTS + [
    "my password=abcdef1 and PASSWORD : 'xy12345' token=='abcdefg' api-key=abcdefgh apikey=abcdefg",
    "AKIA" + "A1B2" * 4 + " AKIA123 éAKIA" + "Q" * 17, "é " + "0a" * 12 + "g" + "f" * 23, "secret=short secret = longenough\ntoken:\nvalue123", "ſecret=abcdefgh toKen=abcdefgh",
]


def brute_secrets(t):
    t = t or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        out += [(m.start(), 1, m.end())] * (len(m[0]) >= 20)
    for m in re.finditer(r"[0-9a-f]+", t):
        out += [(m.start(), 2, m.end())] * (len(m[0]) >= 24)
    return sorted(out)


@pytest.fixture(scope="module")
def field(data):
    return secrets_crf.fit([t for t in pd.read_parquet(f"{data}/documents.parquet").text.tolist()[:60] if len(t) < 9000])


def test_secrets_base(spark, data, field):
    texts = SECRETS + pd.read_parquet(f"{data}/documents.parquet").text.tolist()
    got = secrets_crf.scan_secrets(frame(spark, texts), field).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = brute_secrets(t)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, k, _ in want) for kind in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{secrets_crf.KINDS[k]}:{a}:{z}" for a, k, z in want).encode()).hexdigest()
        assert {f"{secrets_crf.KINDS[k]}:{a}:{z}" for a, k, z in want} <= set(r["spans"].split(","))
    assert secrets_crf.scan_secrets(frame(spark, []), field).count() == 0


def test_secrets_query_of_empty_table(spark, tmp_path):
    frame(spark, []).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert secrets_crf.op8_secret_scan(spark, str(tmp_path)).count() == 0


def test_secrets_viterbi(data, field):
    """Skipping certain words gives the tags of the whole Viterbi search."""
    texts = pd.read_parquet(f"{data}/documents.parquet").text.tolist()[:40] + SECRETS[-5:] + ["key sk-" + "aB3" * 14 + " then Bearer " + "x1Y" * 15]
    _, _, row, x = secrets_crf.word_features(*tb.bytes_of(pa.array(texts)))
    e = (x @ field.weights.astype(np.float32)).astype(float)
    tags = field.decode(x, row)
    for r in np.unique(row):
        at = np.flatnonzero(row == r)
        best, back = field.steps[0] + e[at[0]], []
        for k in at[1:]:
            paths = best[:, None] + field.steps
            back.append(paths.argmax(0))
            best = paths.max(0) + e[k]
        tag = int((best + field.steps[:, 0]).argmax())
        for n in range(len(at) - 1, -1, -1):
            assert tags[at[n]] == tag
            tag = int(back[n - 1][tag]) if n else tag


def test_secrets_spans(data, field):
    """Spans of the method: stretches that a plain Viterbi search over the whole text tags, trimmed, beside the base spans."""
    texts = [t for t in pd.read_parquet(f"{data}/documents.parquet").text.tolist()[:80] if t] + ["key sk-" + "aB3" * 14 + " then (Bearer " + "x1Y" * 15 + "), password=hunter2hunter"]
    trim = secrets_crf._TRIM.decode()
    seen = 0
    for t in texts:
        d_, o_ = tb.bytes_of(pa.array([t]))
        _, _, row, x = secrets_crf.word_features(d_, o_)
        e = (x @ field.weights.astype(np.float32)).astype(float)
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        tags, best, back = [], field.steps[0] + e[0] if len(e) else None, []
        for k in range(1, len(e)):
            paths = best[:, None] + field.steps
            back.append(paths.argmax(0))
            best = paths.max(0) + e[k]
        if len(e):
            tags = [int((best + field.steps[:, 0]).argmax())]
            for b in reversed(back):
                tags.insert(0, int(b[tags[0]]))
        base, spans, k = brute_secrets(t), [], 0
        while k < len(tags):
            if tags[k] == secrets_crf.B:
                j = k + 1
                while j < len(tags) and tags[j] == secrets_crf.I:
                    j += 1
                a, z = words[k][0], words[j - 1][1]
                a += len(t[a:z]) - len(t[a:z].lstrip(trim))
                z -= len(t[a:z]) - len(t[a:z].rstrip(trim))
                if z > a and all(z <= p or a >= q for p, _, q in base):
                    spans.append((a, 3, z))
                k = j
            else:
                k += 1
        seen += len(spans)
        assert secrets_crf.scan_block(field, d_, o_)[0] == sorted([*base, *spans])
    assert seen


def test_secrets_held_out(field):
    """Made-up secrets of another seed are found, look-alikes are left alone."""
    rnd = random.Random(99)
    hits, alarms, n = 0, 0, 400
    for _ in range(n):
        words, secret = secrets_crf._made_up(rnd)
        text = "anre thing with that " + " ".join(words) + " ouwhe the reading was there"
        data_, offs = tb.bytes_of(pa.array([text]))
        found = bool(secrets_crf.scan_block(field, data_, offs)[0])
        hits += found and secret
        alarms += found and not secret
    assert hits > 0.9 * n * 0.45 and alarms < 0.05 * n


PRIVATE = TEXTS[:10] + [
    "mail a.b@c.de, x@y, a@b.cc_x@d.ee and é ü@ö.de q@w.e.r", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0.0.0.255 01.002.3.0004", "card 4111 1111 1111 1111, 4111-1111-1111-1112 49927398716 4 9 9 2 7 3 9 8 7 1 6 0 0",
    "call +49 (30) 123-4567 or +1 23 or +1-202-555-0100. then + 1", "1" * 20_000, "a" * 20_000 + "@b.c", "é+1 202 555 0100é",
]


def brute_private(t):
    t = t or ""
    luhn = lambda g: sum(int(q) if i % 2 == 0 else int(q) * 2 - (9 if int(q) > 4 else 0) for i, q in enumerate(g[::-1])) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(q) <= 255 for q in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15],
    ]


def test_private_base(spark, data):
    texts = PRIVATE + pd.read_parquet(f"{data}/documents.parquet").text.tolist()
    got = pii.find_personal_data(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert [[(m["start"], m["stop"]) for m in r[k]] for k in pii.KINDS] == brute_private(t)
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_private_terms(spark, monkeypatch):
    texts = ["Meet Zephyrine at zeph@corp.example.com today"] * 2 + ["Zephyrine wrote zeph@corp.example.com again", "Zephyrine alone zeph@corp.example.com"]
    texts += [f"Common words here {i} and Common mail x{i}@y.example.com" for i in range(60)] + ["Nothing to see"] * 40
    found = pii.find_personal_data(frame(spark, texts))
    held = {m["value"] for r in found.collect() for m in r["terms"]}
    assert held == {"Zephyrine"}
    clean = {r["doc_id"]: r["clean"] for r in pii.sanitise(found).collect()}
    assert clean[3] == "[NAME] alone [EMAIL]" and clean[70] == "Nothing to see"
    monkeypatch.setattr(pii, "REMOVE_BITS", 4.0)
    clean = {r["doc_id"]: r["clean"] for r in pii.sanitise(found).collect()}
    assert clean[3] == " alone [EMAIL]" and clean[2] == " wrote [EMAIL] again"


def test_private_of_very_long_texts(spark):
    """Thousands of matches in one text, found and replaced in time that is in proportion to it."""
    text = " ".join(f"a{i}@b.cd x" for i in range(20_000))
    (row,) = pii.sanitise(pii.find_personal_data(frame(spark, [text]))).collect()
    assert [(m["start"], m["stop"]) for m in row["email"]] == brute_private(text)[0] and row["clean"] == " ".join(["[EMAIL] x"] * 20_000)


def brute_terms(texts):
    """Terms that disclose an entity, with the most bits, from sets of words and entities of every text."""
    kinds = ("email", "ip", "card", "phone")
    words, entities = [], []
    for t in texts:
        spans = brute_private(t)
        entities.append({(k, t[a:z]) for k, s in zip(kinds, spans, strict=True) for a, z in s})
        rest = list(t)
        for s in spans:
            for a, z in s:
                rest[a:z] = " " * (z - a)
        words.append(set(regex.findall(r"[\p{L}\p{M}\p{N}]+", "".join(rest))))
    n, out = len(texts), {}
    for e in set().union(*entities):
        docs = [k for k in range(n) if e in entities[k]]
        for t in set().union(*(words[k] for k in docs)):
            both, n_t = sum(t in words[k] for k in docs), sum(t in w for w in words)
            bits = math.log2(both * n / (n_t * len(docs)))
            if both >= pii.SUPPORT and both / n_t >= pii.REVEALS and bits >= pii.GENERALISE_BITS:
                out[t] = max(bits, out.get(t, 0))
    return out


def test_private_terms_by_brute_force(spark):
    rnd = random.Random(4)
    names = [f"name{k}" for k in range(30)]
    texts = []
    for _ in range(400):
        who = rnd.choice(names)
        said = [rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)]
        if rnd.random() < 0.5:
            said.append(f"{who}@mail.example.org" if rnd.random() < 0.8 else "+49 30 1234567")
            said.append(rnd.choice([who, f"tag{who}", "omega"]))
        rnd.shuffle(said)
        texts.append(" ".join(said))
    want = brute_terms(texts)
    got = {r["term"]: r["bits"] for r in pii.disclosing_terms(frame(spark, texts)).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    found = pii.find_personal_data(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(found, texts, strict=True):
        spans = brute_private(t)
        inside = [m for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", t) if m[0] in want]
        assert [(m["start"], m["stop"]) for m in r["terms"]] == [m.span() for m in inside], (t, spans)


def test_long_lists_of_contacts_dont_square(spark, monkeypatch):
    """Copies of a text of 200 addresses and 2,000 words, edited a little, among texts that use the same words: rows of entity and term stay under the
    words of the texts, and the terms are those of brute force."""
    rnd = random.Random(9)
    common, own = [f"common{k}" for k in range(1500)], [f"own{k}" for k in range(500)]
    addresses = [f"p{k}@corp{k % 9}.example.org" for k in range(200)]
    texts = []
    for k in range(4):
        words = common + own + addresses
        rnd.shuffle(words)
        texts.append(" ".join(w for w in words if rnd.random() < 0.995))
    texts += [" ".join([*rnd.sample(common, 400), f"only{k}@corp.example.org"]) for k in range(30)] + [" ".join(rnd.sample(common, 200)) for _ in range(60)]
    made = []
    plain = pii.met

    def counting(*args):
        out = plain(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(pii, "met", counting)
    got = {r["term"]: r["bits"] for r in pii.disclosing_terms(frame(spark, texts)).collect()}
    want = brute_terms(texts)
    assert len(want) > 300 and got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    assert made[0] < 2_000  # 4 * 200 * 2,000 rows of entity and word


def test_private_terms_of_whole_texts(spark, monkeypatch):
    """Terms count wherever they stand in a document, of any case, script and length, and not inside of entities."""
    far = " and so on" * 30
    texts = [f"zeph@corp.example.com Alexander {i}{far}" for i in range(8)] + [f"zeph@corp.example.com{far} Alexander {i}" for i in (8, 9)]
    texts += [f"qo {far} 山田 {i}: q.r@corp.example.com" for i in range(3)] + [f"far{far} {i}" for i in range(200)] + [f"x{i}@corp.example.com {far}" for i in range(9)]
    texts += [f"{far} corp example com" for i in range(20)]
    got = {}
    for limit in (5000, 2, 0):
        monkeypatch.setattr(pii, "LITERAL_TERMS", limit)
        monkeypatch.setattr(pii, "BROADCAST_TERMS", 10 * limit)
        rows = pii.find_personal_data(frame(spark, texts)).collect()
        got[limit] = {r["doc_id"]: [(m["start"], m["value"]) for m in r["terms"]] for r in rows}
    wide, middle, narrow = got.values()
    assert wide == middle == narrow
    assert {v for terms in wide.values() for _, v in terms} == {"Alexander", "qo", "山田"}
    assert wide[9] == [(texts[9].index("Alexander"), "Alexander")] and wide[10] == [(0, "qo"), (texts[10].index("山田"), "山田")]
