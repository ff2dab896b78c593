import random
import zlib
from collections import Counter

import re

from halyard.llm import spelling


def brute_words(docs, shortest, least, one_in):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= shortest
    return {w: c for w, c in n.items() if c >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, times=2):
    form, out = {}, []
    others = {w: [x for x in n if near(w, x)] for w in n}
    for w in n:
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(others[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def test_vocabulary(spark):
    docs = [(1, "Hällo hällo HÄLLO WORLD world, world×÷ 12worlds ab"), (2, None), (None, "world " * 5), (3, ""), (4, "z" * 200_000 + " tail"), (4, ("lorem IPSUM dolor " * 9_000)), (5, "lorem ipsum " * 40)]
    docs += [(i, " ".join(f"{a}{b}ippen" for a in "abcdefgh" for b in "klmnop")) for i in range(20)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "`doc.id` bigint, text string, word string, `n.x` int").repartition(3)
    for least, one_in in ((1, 97), (3, 3)):
        got = {r.word: r.n for r in spelling.vocabulary(df, id_col="doc.id", shortest=5, least=least, one_in=one_in).collect()}
        assert got == brute_words(docs, 5, least, one_in)
    assert spelling.vocabulary(df.where("false"), id_col="doc.id").count() == 0


def test_groups_against_brute_force(spark):
    r = random.Random(1)
    n = {}
    for _ in range(60):
        base = "".join(r.choice("abcé") for _ in range(r.randint(5, 8)))
        n[base] = r.randint(3, 400)
        for _ in range(8):
            i, c, w = r.randrange(len(base)), r.choice("abcéÿ"), r.choice([*n])
            i %= len(w)
            n[r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])] = r.choice([3, 3, 6, 12, 25, 50, 100])
    n |= {"aabbcc" + "d" * i: 3 * 2**i for i in range(12)} | {"ÿ" * 20_000: 5, "ÿ" * 20_001: 10, "ÿ" * 19_999 + "a": 3}
    words = spark.createDataFrame([*n.items()], "word string, n bigint")
    assert sorted(map(tuple, spelling.group(words).select("word", "n", "n_near", "form", "form_n", "root").collect())) == brute(n)
    assert spelling.group(words.where("false")).count() == 0


def test_anagrams_are_only_candidates(spark):
    """All orders of the same letters share a number, and only those whose rest is in order are near."""
    from itertools import permutations

    n = {"".join(p): 3 + i % 7 for i, p in enumerate(permutations("abcde"))} | {"".join(p): 9 for p in permutations("abcd")} | {"abcdx": 40, "abxde": 4}
    words = spark.createDataFrame([*n.items()], "word string, n bigint")
    assert sorted(map(tuple, spelling.group(words).select("word", "n", "n_near", "form", "form_n", "root").collect())) == brute(n)
