import base64
from collections import Counter

import corpus_pipeline
import public_tokenizers as vocab
import tiktoken
from test_jaccard import brute as brute_classes
from test_mixing import brute as brute_mix
from test_pii import brute as brute_spans

from halyard.llm import mixing, quality
from halyard.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    trees = quality.train(docs, table(spark, SF, "labels"))
    good = corpus_pipeline.quality_filter(spark, docs, SF)
    want = {i for i, r in rows.items() if trees.scores(quality.statistics(r.text)[None])[0] >= 0.3}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns and 0 < len(want) <= len(rows)

    once = corpus_pipeline.near_duplicates(spark, good, SF)
    kept = {doc for doc, _, c in brute_classes([(i, rows[i].text) for i in sorted(want)]) if doc == c}
    assert Counter(r.doc_id for r in once.collect()) == Counter(kept)

    clean = corpus_pipeline.personal_data(spark, once, SF)
    texts = {}
    for r in clean.collect():
        text = rows[r.doc_id].text
        at, out = 0, []
        for start, end, kind in brute_spans(text):
            if end <= at:
                continue
            out += [text[at:start], f"<{kind}>"] if start >= at else []
            at = end
        assert r.text == "".join(out) + text[at:] and r.n_chars == len(r.text)
        texts[r.doc_id] = r.text

    mixed = corpus_pipeline.mixture(spark, clean, SF)
    leaf = lambda i: ("crawl" if rows[i].source == "src0" else "curated", rows[i].lang, rows[i].source)
    want = brute_mix([(i, t, leaf(i)) for i, t in texts.items()], mixing.WEIGHTS, None, 2, corpus_pipeline.MIX_SEED)
    copies = Counter()
    for (i, _, _), n in want.items():
        copies[i] += n
    assert Counter(r.doc_id for r in mixed.collect()) == copies and mixed.columns == docs.columns

    with open(vocab.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("t", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in last) == copies
    for r in last:
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, "", "en", "src0", 0), (2, "a b c d e f g", "en", "src0", 13), (2, "a b c d e f g", "en", "src0", 13), (3, "a b c d e f g", "en", "src0", 13), (None, "mail a@b.cc", "en", None, 11), (4, "z" * 100_000, "xx", "src1", 100_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, id int")
    once = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert Counter(r.doc_id for r in once.collect()) == Counter([1, 1, 2, None, 4]) and once.columns == docs.columns
    for source in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, source, SF)
            assert out.count() <= 2 * len(rows) and (name == "tokens" or out.columns == docs.columns)


def test_a_column_that_is_named_like_a_helper_stays(spark):
    rows = [(i, f"one two three four five six number{i}", "en", "src0", 40, f"own{i}", {"epoch": i}) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, mix string, epoch map<string,int>")
    got = corpus_pipeline.mixture(spark, docs, SF)
    assert got.dtypes == docs.dtypes and {(r.doc_id, r.mix, r.epoch["epoch"]) for r in got.collect()} == {(i, f"own{i}", i) for i in range(5)}
