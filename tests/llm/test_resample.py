import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from halyard.llm import resample


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest, buckets, percent, least=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for text in texts for g in grams(text, longest)) for texts in ([x for _, x in docs], target))
    big, aim = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (aim + buckets))))
    rows = []
    for i, text in docs:
        g = grams(text, longest)
        weight = sum(gain(bucket(x)) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words(text)), len(g), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fits = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))
    ranked = fits[: sum(r[1] >= least for r in rows) * percent // 100]
    left = Counter(rows) - Counter(ranked)
    return sorted([*((*r, i) for i, r in enumerate(ranked, 1)), *((*r, None) for r in left.elements())], key=str)


ODD = ["", None, "🙂 é É Straße 12a A-B", "x" * 3_000_000, "one two " * 400_000, "\x00\x1f{}", "a b c d e f g h i j k l m n o p q r s t", "A B C D E F G H I J K L M N O P Q R S T"]


@pytest.fixture(scope="module")
def docs():
    many = [(i, " ".join(f"w{(i * j) % (17 + i % 5)}" for j in range(i % 60))) for i in range(300)]
    return [*many, *[(1000 + i, t) for i, t in enumerate(ODD)], (None, "w1 " * 30), (None, "w1 " * 30), (None, None), (7, many[59][1]), (7, many[59][1]), (9, "rare words once only " * 6)]


@pytest.mark.parametrize(("longest", "frequent", "piece"), [(1, 1 << 18, 1 << 20), (1, 1, 1000), (3, 40, 64)])
def test_against_brute_force(spark, docs, monkeypatch, longest, frequent, piece):
    """With strings that are sent to tasks, and with nearly all joined; texts whole and in small pieces."""
    monkeypatch.setattr(resample, "FREQUENT", frequent)
    monkeypatch.setattr(resample, "PIECE", piece)
    docs = docs if longest == 1 else [x for x in docs if len(x[1] or "") < 10_000]
    target = ["w3 w4 w5 é W6", None, "w3 w3 a b c d"]
    df = spark.createDataFrame([(i, t, 1, "n", 5) for i, t in docs], "`doc.id` bigint, text string, feature int, weight string, `key.x` int").repartition(5)
    aim = spark.createDataFrame([(t, 1) for t in target], "body string, text int")
    strings = resample.dictionary(df, aim, target_col="body", longest=longest, buckets=50)
    got = resample.draw(resample.weigh(df, strings, id_col="doc.id", longest=longest), percent=30, id_col="doc.id")
    assert got.columns == ["doc.id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, longest, 50, 30)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    one = spark.createDataFrame([(1, "a b")], none.schema)
    for docs, target in ((none, none), (none, one), (one, none)):
        got = resample.draw(resample.weigh(docs, resample.dictionary(docs, target)), percent=10)
        assert [tuple(r) for r in got.collect()] == brute([tuple(r) for r in docs.collect()], [r.text for r in target.collect()], 1, 10_000, 10)
