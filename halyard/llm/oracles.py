"""The same results in DuckDB's SQL, for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT win, min(doc_id) AS first FROM p GROUP BY win),
g AS (SELECT DISTINCT doc_id, i + j AS at FROM p JOIN m USING (win), range(13) r(j) WHERE first < doc_id),
t AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT t.doc_id, count(g.at) AS gone, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (g.at IS NULL), '') AS kept
      FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.at = t.i GROUP BY t.doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

NGRAM_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.o)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
"""

NEIGHBOURS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum(list_transform(list_zip(c.x, q.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""


#: crc32 by the table of its 256 bytes, which a recursion makes; `tab` is a one-row table.
_CRC_TABLE = """crc_steps AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE k = 8)"""
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc(text: str) -> str:
    hexed = f"hex(encode({text}))"
    steps = f"list_transform(range(len({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)::BIGINT"


def importance_resampling(percent: int, seed: int, buckets: int = 10_000) -> str:
    """A tenth of the documents of 20 words or more, drawn by their words' gains and noise."""
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
f AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS x FROM w) GROUP BY ALL),
s AS (SELECT x, sum(n) AS s FROM f GROUP BY x),
t AS (SELECT x, count(*) AS t FROM (SELECT unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark) GROUP BY x),
d AS (SELECT x, coalesce(s, 0)::BIGINT AS s, coalesce(t, 0)::BIGINT AS t, {_crc("x")} % {buckets} AS b FROM s FULL JOIN t USING (x), tab),
b AS (SELECT b, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM d GROUP BY b),
a AS (SELECT sum(s)::BIGINT AS big, sum(t)::BIGINT AS aim FROM b),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (big + {buckets})::DOUBLE / ((s + 1)::DOUBLE * (aim + {buckets})::DOUBLE)))::BIGINT AS gain FROM b, a),
m AS (SELECT doc_id, sum(n * gain)::BIGINT AS total FROM f JOIN d USING (x) JOIN g USING (b) GROUP BY doc_id),
r AS (SELECT doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE floor(total::DOUBLE / len(ws)) END::BIGINT AS weight,
      ('0x' || left(sha256('{seed}:' || doc_id), 8))::BIGINT AS h FROM w LEFT JOIN m USING (doc_id)),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM r),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= 20 AND score IS NOT NULL)
SELECT c.*, CASE WHEN rank <= (SELECT {percent} * count(*) // 100 FROM c WHERE n_features >= 20) THEN rank END AS rank FROM c LEFT JOIN o USING (doc_id)
"""


SPELLING_VARIANTS = rf"""
WITH RECURSIVE {_CRC_TABLE},
x AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT w, n, {_crc("doc_id || ':' || w")} AS h FROM x, tab),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
l AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word AS word, b.word AS other, b.n AS m FROM l a JOIN l b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT l.word, v.word, v.n FROM l JOIN v ON l.rest = v.word UNION SELECT v.word, l.word, l.n FROM l JOIN v ON l.rest = v.word),
q AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN q USING (word)),
z AS (SELECT word, word AS last FROM f UNION ALL SELECT z.word, f.form FROM z JOIN f ON z.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, last AS root FROM f JOIN z USING (word) WHERE last IN (SELECT word FROM f WHERE form IS NULL)
"""


def mixing(weights: dict[str, dict[str, int]], seed: int, epochs: int = 2) -> str:
    """The production mixture, its budget being as many words as there are."""
    steps, path, above = [], [], "root"
    for level in ("domain", "lang", "source"):
        w = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.get(level, {}).items())
        w = f"CASE {level} {w} ELSE 1 END" if w else "1"
        up = f"PARTITION BY {', '.join(path)}" if path else ""
        keys = ", ".join([*path, level])
        join = f"JOIN {above} USING ({', '.join(path)})" if path else f", {above}"
        order = f"({up} ORDER BY cap / w, {level} ROWS BETWEEN"
        steps.append(f"""
{level}_n AS (SELECT * FROM (SELECT {keys}, CAST(sum({epochs} * supply) AS BIGINT) AS cap, {w} AS w FROM leaves GROUP BY {keys}) {join}),
{level}_s AS (SELECT *, (budget - coalesce(sum(cap) OVER {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER {order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM {level}_n),
{level}_b AS (SELECT {keys}, CAST(CASE WHEN cap <= share * w THEN cap ELSE floor(max(CASE WHEN cap > share * w THEN share END) OVER ({up}) * w) END AS BIGINT) AS budget FROM {level}_s)""")
        path, above = [*path, level], f"{level}_b"
    return f"""
WITH docs AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END AS domain, lang, source, len({WORDS}) AS n, md5(doc_id::VARCHAR || '|' || coalesce(text, '')) AS digest FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS supply FROM docs GROUP BY ALL),
root AS (SELECT CAST(sum(supply) AS BIGINT) AS budget FROM leaves),{",".join(steps)},
plan AS (SELECT *, budget // supply AS epochs, budget % supply AS rest FROM leaves JOIN source_b USING (domain, lang, source)),
h AS (SELECT *, ('0x' || left(md5('{seed}|' || epochs || '|' || digest), 15))::BIGINT AS h FROM docs JOIN plan USING (domain, lang, source)),
o AS (SELECT *, epochs + CASE WHEN sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h) - sum(n) OVER (PARTITION BY domain, lang, source, h) < rest THEN 1 ELSE 0 END AS copies FROM h)
SELECT doc_id, domain, lang, source, unnest(range(copies)) AS epoch FROM o
"""
