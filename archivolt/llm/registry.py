"""Queries of the operators on the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import decontaminate, embedding_dedup, exact_search, language_id, line_dedup, packing, pii, quality, simhash_dedup, spelling, substring_dedup, token_alignment, warc
from archivolt.llm._io import table

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_of_documents(table(spark, sf_dir, "documents"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS k
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY 1),
s AS (SELECT doc_id, i AS p FROM g JOIN f USING (k) WHERE doc_id > first),
n AS (SELECT doc_id, words[p] AS word, p FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)),
c AS (SELECT n.doc_id, n.p, word,
             coalesce(max(s.p) OVER (PARTITION BY n.doc_id ORDER BY n.p ROWS UNBOUNDED PRECEDING) >= n.p - 49, false) AS gone
      FROM n LEFT JOIN s ON s.doc_id = n.doc_id AND s.p = n.p),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept
      FROM c GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN a USING (doc_id)
""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_documents(table(spark, sf_dir, "documents")).drop("factors")


@query()
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.components(table(spark, sf_dir, "documents"))


@query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query(r"""
WITH low AS (SELECT doc_id AS id, 'd' AS side, text FROM documents UNION ALL SELECT item_id, 'b', text FROM benchmark),
w AS (SELECT id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM low),
l AS (SELECT DISTINCT least(len(words), 10) AS n FROM w WHERE side = 'b' AND len(words) > 0),
b AS (SELECT DISTINCT id AS item_id, least(len(words), 10) AS n, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS gram
      FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM w WHERE side = 'b' AND len(words) > 0)),
d AS (SELECT id AS doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS gram
      FROM (SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, l WHERE side = 'd' AND len(words) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM d JOIN b USING (n, gram)),
s AS (SELECT doc_id, i AS p, max(i + n) AS stop FROM h GROUP BY 1, 2),
q AS (SELECT id AS doc_id, unnest(range(1, len(words) + 1)) AS p FROM w WHERE side = 'd'),
c AS (SELECT q.doc_id, coalesce(max(stop) OVER (PARTITION BY q.doc_id ORDER BY q.p ROWS UNBOUNDED PRECEDING) > q.p, false) AS hit
      FROM q LEFT JOIN s ON s.doc_id = q.doc_id AND s.p = q.p),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (hit) AS n_hit FROM c GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN i USING (doc_id)
""")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < original THEN original END AS refers_to
FROM m
""")
def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


@query(r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
n AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE regexp_matches(line, '[^\x09-\x0D\x20]')),
p AS (SELECT doc_id, i, j, array_to_string(lines[i : j], chr(10)) AS pair FROM n JOIN d USING (doc_id) WHERE j IS NOT NULL),
f AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY pair ORDER BY doc_id, i) AS place FROM p),
g AS (SELECT DISTINCT doc_id, i, true AS gone FROM (SELECT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE place > 1)),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
             string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)) AS kept
      FROM l LEFT JOIN g USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_documents(table(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
""")
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings"))


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"))


@query(r"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(i))),
runs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY 1, 2),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(concat(id, ':', run), ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END))),
           lambda acc, b: xor(acc >> 8, steps[(xor(acc, b) & 255) + 1]))) AS h
  FROM runs, t),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT DISTINCT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS left_over FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.left_over = b.left_over AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN v ON c.left_over = v.word
  UNION SELECT v.word, c.word FROM cut c JOIN v ON c.left_over = v.word),
near AS (SELECT p.word, count(*) AS n_near, min({'less': -v.n, 'other': other}) AS best FROM pairs p JOIN v ON v.word = other GROUP BY 1),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * v.n THEN best.other END AS form,
                  CASE WHEN -best.less >= 5 * v.n THEN -best.less END AS form_n FROM v LEFT JOIN near USING (word)),
chain(word, tip) AS (SELECT word, word FROM formed UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = tip WHERE formed.form IS NOT NULL),
ends AS (SELECT chain.word, tip AS root FROM chain JOIN formed ON formed.word = tip WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), damage=199)


@query("""
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS p
           FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.p, d.p) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.row <> d.row AND len(q.p) = len(d.p))
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 10
""")
def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_rows(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
