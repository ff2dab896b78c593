import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halyard.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


def brute_bits(train, text):
    counts = defaultdict(Counter)
    data = b"".join(langid.PAD + t.encode() for t in train)
    for i in range(langid.ORDER, len(data)):
        for k in range(langid.ORDER + 1):
            counts[data[i - k : i]][data[i]] += 1
    data, total = langid.PAD + text.encode(), 0.0
    for i in range(langid.ORDER, len(data)):
        for k in range(langid.ORDER, -1, -1):
            if c := counts.get(data[i - k : i]):
                n, q = sum(c.values()), len(c)
                if data[i] in c:
                    total -= np.log2(c[data[i]] / (n + q))
                    break
                total -= np.log2(q / (n + q))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    train = {"a": ["the cat sat on the mat", "a hat"], "b": ["le chat dort", "é"], "c": ["x"]}
    texts = ["the hat", "le", "漢字", "", "zzz", "é é"]
    got = langid.Scorer(langid.fit(train)).code_lengths([t.encode() for t in texts])
    want = [[brute_bits(train[x], t) for x in "abc"] for t in texts]
    assert np.allclose(got, want, atol=1e-3)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edge_cases(spark):
    rows = [(1, "the one", "en", 1), (2, "der eine", "de", 1), (3, None, "en", 1), (4, "123 !", None, 1), (None, "the", None, 1), (5, "", "de", 1), (5, "der", None, 2), (6, "z" * 100_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = langid.predict(docs, langid.train(docs, F.lit(True))).collect()
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert len(got) == 8 and {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (5, "de")} <= by
    empty = docs.where("false")
    assert langid.predict(empty, langid.train(empty, F.lit(True))).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(empty, F.lit(True))).collect()} == {"und"}


def test_flat_trees_equal_a_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality.boost(x, y, trees=20, depth=3)

    def walk(row):
        total = t.base
        for f, th, v in zip(t.feature, t.threshold, t.leaf):
            at = 0
            while at < 7:
                at = 2 * at + 1 + (row[f[at]] > th[at])
            total += v[at - 7]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(t.scores(x), [walk(row) for row in x])
    assert ((t.scores(x) > 0.5) == y).mean() > 0.95


def test_quality_of_held_out_documents(spark):
    got = queries.op9_quality(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.9


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, 1), (2, 0), (None, 1), (1, None), (9, 0)]])
def test_quality_edge_cases(spark, labelled):
    docs = spark.createDataFrame([(1, "a b", 0.5), (1, "a b", 0.1), (2, None, None), (None, "", 1.0), (3, "w" * 200_000, 0.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame(labelled, "doc_id bigint, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.where("false"), quality.train(docs, labels)).count() == 0


def test_dotted_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the one", "en", 0.5, "k"), (2, "der eine", "de", 0.1, "k"), (None, None, None, None, None)], "`doc.id` bigint, `a.text` string, `l.ang` string, `sc.ore` double, k0 string")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x")], "`doc.id` bigint, `q.y` int, text string")
    model = langid.train(docs, F.lit(True), id_col="doc.id", text_col="a.text", lang_col="l.ang")
    got = langid.predict(docs, model, text_col="a.text", keep=("doc.id", "sc.ore", "k0"))
    assert got.columns == ["doc.id", "sc.ore", "k0", "lang_pred", "score"] and {r[3] for r in got.collect()} == {"en", "de", "und"}
    trees = quality.train(docs, labels, id_col="doc.id", text_col="a.text", label_col="q.y")
    got = quality.score(docs, trees, text_col="a.text", keep=tuple(docs.columns))
    assert got.columns == [*docs.columns, "score"] and got.count() == 3


def test_samples_are_the_first_by_hash_whatever_repeats(spark):
    rows = [(i, f"text number {i}", "en") for i in range(900)] + [(7, "text number 7", "en")] * 3000 + [(i, f"texte {i}", "fr") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    first = lambda lang: [r.text for r in docs.where(F.col("lang") == lang).distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string"), "text")).limit(30).collect()]
    model = langid.train(docs, F.lit(True), per_lang=30)
    want = langid.fit({"en": first("en"), "fr": first("fr")})
    assert model.langs == want.langs
    probe = [b"text number 123", b"texte 3", b"zq"]
    assert np.allclose(langid.Scorer(model).code_lengths(probe), langid.Scorer(want).code_lengths(probe))


def test_quality_learns_one_row_for_each_label(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "good words here")] * 500 + [(1, "other"), (2, "$$$"), (3, "more good words")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "boost", lambda x, y: seen.append((x, y)))
    quality.train(docs, labels, max_rows=3)
    ((x, y),) = seen
    assert len(x) == len(y) == 3
