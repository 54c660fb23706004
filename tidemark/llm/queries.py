"""The registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, decontaminate, html, langid, linededup, minhash, packing, phrases, quality, simhash, tokens, topk, warc
from tidemark.llm.common import new_path


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; executors find it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(_table(spark, sf_dir, "documents"), whole_passages=True)
    return found.select("doc_id", "text", "n_chunks_removed", "chars_removed")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html.extracted(pages, html.tag_weights(pages))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.trained(docs))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.trained(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archive = warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path, archive)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=10, top=2_000)


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_language_id": op7_language_id,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_token_counts": op10_token_counts,
    "op11_token_alignment": op11_token_alignment,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}

_OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""

#: Every window of item size around every shared shingle; in the smallest tables that takes seconds.
_OP3 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS dn, unnest(range(0, len(w) - 4)) AS p, w FROM d),
dh AS (SELECT doc_id, dn, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM ds),
bs AS (SELECT item_id, len(w) AS bn, unnest(range(0, len(w) - 4)) AS q, w FROM b),
bh AS (SELECT item_id, bn, s, count(*) AS weight FROM (SELECT item_id, bn, array_to_string(w[q + 1:q + 5], ' ') AS s FROM bs) GROUP BY ALL),
hit AS (SELECT doc_id, dn, p, item_id, bn, s, weight FROM dh JOIN bh USING (s)),
win AS (SELECT doc_id, item_id, bn, s, weight, unnest(range(greatest(0, p - bn + 5), least(p, dn - bn) + 1)) AS start_word FROM hit),
shared AS (SELECT doc_id, item_id, bn, start_word, s, least(count(*), min(weight)) AS c FROM win GROUP BY doc_id, item_id, bn, start_word, s),
scored AS (SELECT doc_id, item_id, start_word, bn AS n_words, sum(c) AS shared, bn - 4 AS n FROM shared GROUP BY doc_id, item_id, start_word, bn),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / (2.0 * n - shared) DESC, start_word) AS k FROM scored WHERE 100 * shared >= 80 * (2 * n - shared))
SELECT doc_id, item_id, CAST(start_word AS INTEGER) AS start_word, CAST(n_words AS INTEGER) AS n_words, CAST(shared AS INTEGER) AS shared, CAST(shared AS DOUBLE) / (2 * n - shared) AS similarity FROM best WHERE k = 1
"""

#: All pairs that share a shingle, then the smallest id that each document can reach.
_OP5 = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
h AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reached = u.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""

_OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

#: Every run of one to three words is counted; a phrase is told from another by its words with \\x20 between, which no word holds.
_OP12 = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents),
q AS (SELECT lang, w, row_number() OVER () AS piece FROM p),
i AS (SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS i FROM q),
j AS (SELECT lang, w1, lead(w1) OVER t AS w2, lead(w1, 2) OVER t AS w3 FROM i WINDOW t AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1 AS phrase, w1, NULL AS w2, NULL AS w3 FROM j UNION ALL SELECT lang, 2, w1 || ' ' || w2, w1, w2, NULL FROM j WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3 FROM j WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS f, first(w1) AS w1, first(w2) AS w2, first(w3) AS w3 FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, f AS a FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, k, phrase, a, 1 AS cut, w1 AS x, CASE k WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS y FROM c
        UNION ALL SELECT lang, k, phrase, a, 2, w1 || ' ' || w2, w3 FROM c WHERE k = 3),
s AS (SELECT cut.lang, cut.k, cut.phrase, a, cut, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, w1 || ' ' || w2 AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM c WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT b.* FROM b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR k = 3 OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": _OP2,
    "op3_benchmark_decontamination": _OP3,
    "op5_minhash_near_dedup": _OP5,
    "op9_warc": _OP9,
    "op12_phrase_collocations": _OP12,
}
