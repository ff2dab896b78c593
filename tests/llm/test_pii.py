import hashlib
import re
import time
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, v):
    d = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return 10 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def base(df):
    return [(r.doc_id, [(s.start, s.end, s.kind) for s in r.base]) for r in df.collect()]


ODD = [
    "", None, "a@b.c_d@e.f", "a@b.c.d@e.f", "é x@y.zz, 1.2.3.4.5 256.1.1.1 000255.1.1.01", "+1 (017) 555-7713 (", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111111111111112",
    "🙂 me@x.org +12345678901 tail", "a" * 50_000, "1" * 20_000, "1 " * 5_000, "a@" + "b." * 5_000 + "c", "+1+1+1 234 567 89 01", "@@a@b..c@d.e", "1.2.3", "..1.1.1.1..", "x@y", "%@-.-",
]


def test_base_spans_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(ODD)], "doc_id bigint, text string, kind string")
    assert sorted(base(pii.find(docs))) == [(i, brute(t)) for i, t in enumerate(ODD)]
    assert pii.find(docs.where("false")).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("a1.@-+ (2_é", max_size=40), min_size=60, max_size=80))
def test_base_spans_of_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", pii.base_spans(F.col("text")).alias("s"))
    for r in docs.collect():
        assert [(s.start, s.end, s.kind) for s in r.s] == brute(texts[r.i]), texts[r.i]


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        said = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in want) for x in PLAIN]
        assert set(said.split(",")) <= set(r.spans.split(","))


def test_contexts_reveal_unseen_identifiers(spark):
    rows = [(i, f"hello there, please write to user{i}@mail.example.com soon, and it was {i} of 300") for i in range(12)]
    rows += [(100, "they said please write to jane42(at)mail soon"), (101, "they said please write to jane42(at)mail, soon"), (102, "and it was 123456 of 300"), (101, "please write to me"), (None, "now write to k9-at-home please")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, s.value, s.kind) for r in pii.find(docs).collect() for s in r.spans[len(r.base) :] if len(r.spans) > len(r.base)}
    assert found == {(100, "jane42(at)mail", "email"), (101, "jane42(at)mail", "email"), (None, "k9-at-home", "email")}


def test_contexts_behind_digits_and_very_long_words(spark):
    long = "w" * 120
    rows = [(i, f"so mail line2 user{i}@mail.example.com soon, then {long} {long} host{i}@mail.example.com or 7 @ me{i}@mail.example.com") for i in range(12)]
    rows += [(100, "again mail line2 jane42(at)mail soon"), (101, f"and {long}\t{long}  k9-at-home soon"), (102, "try 7 @ joe55(at)mail"), (103, "line2 jane43(at)mail"), (104, "7 @"), (105, "not line2 kim77(at)mail")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, s.value, s.kind) for r in pii.find(docs).collect() for s in r.spans[len(r.base) :] if len(r.spans) > len(r.base)}
    assert found == {(100, "jane42(at)mail", "email"), (101, "k9-at-home", "email"), (102, "joe55(at)mail", "email")}


def test_two_whole_words_before_each_token(spark):
    texts = ["a1 b2 c3", "x  y\tz9 1\n2 @ q", "é" * 300 + " " + "v" * 90 + " a@b", "7 " * 300, "s " + "d5" * 40_000 + " " + "e6" * 40_000 + " f7", " 1", "one 2", "\u2028 \x85 3 4\u2028 5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in docs.select("i", pii._placed(F.col("text"), pii._TOKEN, context=True).alias("t")).collect():
        want = [(m.start(), re.split("[ \t\n\x0b\f\r]+", texts[r.i][: m.start()].strip(" \t\n\x0b\f\r"))[-2:]) for m in re.finditer(r"(?<![^ \t\n\x0b\f\r])[^ \t\n\x0b\f\r0-9@]*[0-9@][^ \t\n\x0b\f\r]*", texts[r.i])]
        assert [(x.start, re.split("[ \t\n\x0b\f\r]+", x.before.strip(" \t\n\x0b\f\r"))[-2:]) for x in r.t] == want


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc or 1.2.3.4, é"), (2, "none"), (3, "")], "doc_id bigint, text string")
    got = docs.select("doc_id", pii.redact(F.col("text"), pii.base_spans(F.col("text"))).alias("t")).collect()
    assert [r.t for r in sorted(got)] == ["mail <email> or <ip>, é", "none", ""]


def test_many_matches_in_one_text_take_no_quadratic_time(spark):
    texts = [" ".join(f"user{i}@b.cc" for i in range(90_000)), "x " * 100_000 + "1.2.3.4 " + "+12345678901 " * 40_000, "a@b.c" * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pii.find(docs.limit(1)).collect()
    began = time.perf_counter()
    got = dict(base(pii.find(docs)))
    assert time.perf_counter() - began < 60
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_clashing_and_dotted_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc now", "m", 5, 7, "s", "t"), (None, None, None, None, None, None, None), (1, "mail a@b.cc now", "m", 5, 7, "s", "t")], "`doc.id` bigint, `the.text` string, more string, id2 int, key2 int, spans string, `tokens.x` string")
    got = pii.scrub(docs, id_col="doc.id", text_col="the.text")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "mail <email> now", "m", 5, 7, "s", "t")] * 2 + [(None,) * 7], key=str)
    assert pii.find(docs, id_col="doc.id", text_col="the.text").columns == ["doc.id", "base", "spans"]
    assert pii.scrub(docs.where("false"), id_col="doc.id", text_col="the.text").count() == 0


def brute_graph(docs):
    """The spans that contexts add, by plain dictionaries: seeds, confidences over all occurrences, scores, rounds."""
    space = "[ \t\n\x0b\f\r]+"
    rows, total = [], Counter()
    for doc, text in docs:
        words = [(m.start(), m.group()) for m in re.finditer("[^ \t\n\x0b\f\r]+", text)]
        low = re.split(space, text.lower())
        total.update(f"{a} {b}" for a, b in zip(low, low[1:]))
        spans, at = brute(text), 0
        for i, (start, word) in enumerate(words):
            if start < at or not re.search("[0-9@]", word):
                continue
            own = [s for s in spans if start <= s[0] < start + len(word)]
            if own:
                at, value, kind, place = own[0][1], text[own[0][0] : own[0][1]], own[0][2], own[0][:2]
            else:
                head = len(re.match(r"[^\w+]*", word.replace("_", " ")).group())
                core = re.sub(r"[\W_]*$", "", word[head:])
                value, kind, place = core, None, (start + head, start + head + len(core))
                if len(core) < 5:
                    continue
            if i >= 2:
                rows.append((doc, " ".join(w.lower() for _, w in words[i - 2 : i]), value, kind, place))
    graph, score, trusted = Counter((c, v, k) for _, c, v, k, _ in rows), {}, {}
    for _ in range(pii.ROUNDS):
        mass, values = Counter(), {}
        for (c, v, k), n in graph.items():
            for kind, s in [(k, 1.0)] if k else [(kind, s) for (val, kind), s in score.items() if val == v]:
                mass[c, kind] += n * s
                values.setdefault((c, kind), set()).add(v)
        found = {}
        for (c, k), m in mass.items():
            confidence = min(1.0, m / total[c])
            if confidence >= pii.CONFIDENCE and len(values[c, k]) >= pii.SUPPORT:
                found[c] = max(found.get(c, (0, "")), (confidence, k))
        trusted, score, left = found, {}, {}
        for c, v, k in graph:
            if k is None and c in trusted:
                confidence, kind = trusted[c]
                left[v, kind] = left.get((v, kind), 1.0) * max(1 - confidence, 1e-6)
        score = {vk: 1 - x for vk, x in left.items()}
    return sorted({(doc, *place, trusted[c][1]) for doc, c, _, k, place in rows if k is None and c in trusted})


def test_graph_against_brute_force(spark):
    """Contexts of several kinds and strengths, shared by known and unknown values, some trusted in a later round only."""
    r = np.random.default_rng(5)
    say, docs = ["write to", "mail or", "call me", "from host", "not at", "id no"], []
    for i in range(400):
        parts = []
        for _ in range(r.integers(1, 5)):
            c = say[r.integers(len(say))]
            known = {"write to": f"u{r.integers(99)}@x.org", "mail or": f"v{r.integers(9)}@x.org", "call me": f"+4912345{r.integers(10_000, 99_999)}", "from host": f"10.0.{r.integers(9)}.{r.integers(9)}"}.get(c, "nothing")
            value = [known, f"handle{r.integers(30)}-x", "soon"][r.choice(3, p=[0.75, 0.2, 0.05] if c != "mail or" else [0.45, 0.5, 0.05])]
            parts.append(f"{'so ' * r.integers(0, 3)}{c} {value}{['', ',', ' then'][r.integers(3)]}")
        docs.append((i, " ".join(parts)))
    want = brute_graph(docs)
    got = pii.find(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((x.doc_id, s.start, s.end, s.kind) for x in got for s in x.spans if s not in x.base) == want
    assert len({k for *_, k in want}) >= 2 and len(want) > 50
