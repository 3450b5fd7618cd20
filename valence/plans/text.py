"""Queries over texts: splits, training rows, words and their weights."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from valence.functions.text import preview
from valence.operators import classify, split, terms
from valence.plans.inputs import POSTS_SQL, documents, posts, table

# Java's \s, so that both engines cut at the same characters.
_BLANK = r"[ \t\n\x0B\f\r]"
_WORDS_SQL = f"""words AS (
  SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS position
  FROM (SELECT doc_id,
               string_split_regex(regexp_replace(lower(text), '{_BLANK}+$', ''), '{_BLANK}') AS w
        FROM documents))"""

_HASHED_SQL = (
    _WORDS_SQL
    + """,
-- 32-bit Murmur3 with seed 42 of the UTF-8 bytes, four bytes at a time; the large numbers
-- are fixed values of that hash.
bytes AS (
  SELECT DISTINCT term, hex(encode(term)) AS hx, octet_length(encode(term)) AS len FROM words),
parts AS (
  SELECT term, len,
         list_transform(range(0, len // 4), lambda i: CAST('0x'
           || substr(hx, i * 8 + 7, 2) || substr(hx, i * 8 + 5, 2)
           || substr(hx, i * 8 + 3, 2) || substr(hx, i * 8 + 1, 2) AS UBIGINT)) AS blocks,
         CASE WHEN len % 4 = 0 THEN 0::UBIGINT ELSE CAST('0x'
           || substr(hx, len // 4 * 8 + 5, CASE WHEN len % 4 >= 3 THEN 2 ELSE 0 END)
           || substr(hx, len // 4 * 8 + 3, CASE WHEN len % 4 >= 2 THEN 2 ELSE 0 END)
           || substr(hx, len // 4 * 8 + 1, 2) AS UBIGINT) END AS tail
  FROM bytes),
mixed AS (
  SELECT term, len,
         list_transform(list_append(blocks, tail), lambda b:
           ((((b * 3432918353) % 4294967296 << 15) % 4294967296
             | ((b * 3432918353) % 4294967296 >> 17)) * 461845907) % 4294967296) AS ks
  FROM parts),
body AS (
  SELECT term, len, ks[len(ks)] AS last,
         list_reduce(ks[1:len(ks) - 1], lambda h, k:
           (((xor(h, k) << 13) % 4294967296 | (xor(h, k) >> 19)) * 5 + 3864292196) % 4294967296,
           42::UBIGINT) AS h
  FROM mixed),
fin1 AS (SELECT term, xor(xor(h, last), len::UBIGINT) AS h FROM body),
fin2 AS (SELECT term, (xor(h, h >> 16) * 2246822507) % 4294967296 AS h FROM fin1),
fin3 AS (SELECT term, (xor(h, h >> 13) * 3266489909) % 4294967296 AS h FROM fin2),
fin4 AS (SELECT term, xor(h, h >> 16)::BIGINT AS h FROM fin3),
buckets AS (
  SELECT term,
         ((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 20000 + 20000) % 20000
           AS bucket
  FROM fin4),
counts AS (
  SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS tf
  FROM words JOIN buckets USING (term) GROUP BY doc_id, bucket)"""
)


def exact_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return split.exact_split_names(docs, "doc_id")


def split_counts(spark, sf):
    return split.split_counts(exact_split(spark, sf))


def hash_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return split.hash_split_names(docs, "doc_id", {"train": 0.8, "live": 0.2})


def seeded_shuffle(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return split.shuffle_positions(docs, "doc_id").withColumn("sort_key", split.hash_order("doc_id"))


def training_view(spark, sf):
    return classify.training_view(posts(spark, sf))


def text_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", preview("text").alias("preview"))


def label_index(spark, sf):
    rows = posts(spark, sf).select(F.col("target").alias("raw_label"), "id")
    rows = rows.filter("raw_label IS NOT NULL").filter("id IS NOT NULL")
    return classify.label_indexer().fit(rows).transform(rows)


def label_index_by_frequency(spark, sf):
    rows = posts(spark, sf).select(F.col("target").alias("raw_label"), "id")
    rows = rows.filter("raw_label IS NOT NULL").filter("id IS NOT NULL")
    return classify.label_indexer("frequencyDesc").fit(rows).transform(rows)


def tokenize(spark, sf):
    return terms.words(documents(spark, sf), "doc_id")


def term_counts(spark, sf):
    return terms.term_counts(documents(spark, sf), "doc_id")


def tfidf_terms(spark, sf):
    weights = terms.tfidf_terms(documents(spark, sf), "doc_id")
    return weights.withColumn("tfidf", F.round("tfidf", 6))  # logarithms differ in the last digit


def hashed_tf(spark, sf):
    docs = documents(spark, sf)
    tokenizer, hashing, _ = classify.features()
    vectors = hashing.transform(tokenizer.transform(docs))
    return terms.vector_entries(vectors, "doc_id", "rawFeatures", "tf")


def tfidf_vectors(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    vectors = Pipeline(stages=classify.features()).fit(docs).transform(docs)
    entries = terms.vector_entries(vectors, "doc_id", "features", "tfidf")
    return entries.withColumn("tfidf", F.round("tfidf", 6))


QUERIES = {
    "exact_split": exact_split,
    "split_counts": split_counts,
    "hash_split": hash_split,
    "seeded_shuffle": seeded_shuffle,
    "training_view": training_view,
    "text_preview": text_preview,
    "label_index": label_index,
    "label_index_by_frequency": label_index_by_frequency,
    "tokenize": tokenize,
    "term_counts": term_counts,
    "tfidf_terms": tfidf_terms,
    "hashed_tf": hashed_tf,
    "tfidf_vectors": tfidf_vectors,
}

_RANKED = """ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r,
         floor((SELECT count(*) FROM documents) * 0.8) AS k
  FROM documents)"""

ORACLES = {
    "exact_split": f"""WITH {_RANKED}
SELECT doc_id, CASE WHEN r <= k THEN 'train' ELSE 'live' END AS split FROM ranked""",
    "split_counts": f"""WITH {_RANKED}
SELECT CASE WHEN r <= k THEN 'train' ELSE 'live' END AS split, count(*) AS n
FROM ranked GROUP BY 1""",
    "hash_split": """
SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('42:' || doc_id), 25, 8) AS BIGINT)
                         < round(0.8 * 4294967296) THEN 'train' ELSE 'live' END AS split
FROM documents""",
    "seeded_shuffle": """
SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS BIGINT) AS position,
       md5('42:' || doc_id) AS sort_key FROM documents""",
    "training_view": f"""WITH {POSTS_SQL}
SELECT target AS raw_label, text FROM posts WHERE target IS NOT NULL AND text IS NOT NULL""",
    "text_preview": "SELECT doc_id, substr(text, 1, 50) || '...' AS preview FROM documents",
    "label_index": f"""WITH {POSTS_SQL}
SELECT target AS raw_label, id,
       CAST(dense_rank() OVER (ORDER BY CAST(target AS VARCHAR)) - 1 AS DOUBLE) AS label
FROM posts WHERE target IS NOT NULL""",
    "label_index_by_frequency": f"""WITH {POSTS_SQL},
n AS (SELECT target, count(*) AS c FROM posts WHERE target IS NOT NULL GROUP BY target),
i AS (SELECT target, row_number() OVER (ORDER BY c DESC, CAST(target AS VARCHAR)) - 1 AS i FROM n)
SELECT target AS raw_label, id, CAST(i AS DOUBLE) AS label FROM posts JOIN i USING (target)""",
    "tokenize": f"""WITH {_WORDS_SQL}
SELECT doc_id, CAST(position AS INTEGER) AS position, term FROM words""",
    "term_counts": f"""WITH {_WORDS_SQL}
SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term""",
    "tfidf_terms": f"""WITH {_WORDS_SQL},
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, term, tf, df,
       round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS tfidf
FROM tf JOIN df USING (term)""",
    "hashed_tf": f"WITH {_HASHED_SQL} SELECT doc_id, bucket, tf FROM counts",
    "tfidf_vectors": f"""WITH {_HASHED_SQL},
df AS (SELECT bucket, count(*) AS df FROM counts GROUP BY bucket)
SELECT doc_id, bucket,
       round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS tfidf
FROM counts JOIN df USING (bucket)""",
}
