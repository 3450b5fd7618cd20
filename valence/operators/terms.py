"""Term statistics as tables: what the feature vectors hold, one row per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from valence.functions.text import tokens
from valence.session import written

HOT_TERMS = 10_000  # most terms that count as hot, hence rows of the broadcast
KEY_BUCKETS = 1 << 20  # buckets of keys, hence most rows of the broadcast that names those of repeated keys


def words(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per word, with its position."""
    return docs.select(key, F.posexplode(tokens(text)).alias("position", "term"))


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """How often each term occurs in each document, a document being all rows with its key.

    A row whose key no other row has is counted where it is read, and nothing of it is
    shuffled. Rows with a key in the bucket of a repeated one are counted by key and term,
    and summed up in the tasks before anything is shuffled, so a key of many rows spans many
    tasks. ``docs`` is read more than once, its texts are cut into words once.
    """
    hashed = docs.groupBy(F.xxhash64(key).alias("_hash")).agg(F.count("*").alias("_rows"))
    repeated = F.broadcast(hashed.filter("_rows > 1").select(_bucket("_hash")).distinct())
    rows = docs.select(key, F.col(text).alias("_text"), _bucket(F.xxhash64(key)))
    once = rows.join(repeated, "_bucket", "left_anti").select(key, F.explode(_runs("_text")).alias("_run"))
    term = F.substring_index("_run", "\n", 1)
    tf = F.octet_length("_run") / (F.octet_length(term) + 1)  # divides evenly
    once = once.select(key, term.alias("term"), tf.cast("long").alias("tf"))
    again = rows.join(repeated, "_bucket", "left_semi").select(key, F.explode(tokens("_text")).alias("term"))
    return once.unionByName(again.groupBy(key, "term").agg(F.count("*").alias("tf")))


def _bucket(hashed: Column | str) -> Column:
    return F.pmod(hashed, F.lit(KEY_BUCKETS)).alias("_bucket")


def _runs(text: Column | str) -> Column:
    """The words of a text, sorted, each followed by a line break, cut into runs of one word; words have no line breaks."""
    lines = F.array_join(F.array_append(F.sort_array(tokens(text)), F.lit("")), "\n")
    return F.regexp_extract_all(lines, F.lit(r"([^\n]*\n)\1*"), F.lit(0))


def tfidf_terms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """TF-IDF weight of each term in each document, with smoothed ``ln((n+1)/(df+1))``.

    The texts are cut into words once, and the counts written to a table that the rest
    starts from. Joining it on the term alone would send a word that occurs in every
    document to one task. A term is hot if its document frequency is over 1/HOT_TERMS of
    their sum; there can be at most HOT_TERMS of those, so their frequencies are broadcast
    (under a name of bounded length), and only the entries of other terms are shuffled.
    """
    counts = written(term_counts(docs, key, text), "terms")
    name, whole = _short_name("term").alias("_name"), F.when(_is_long("term"), F.col("term"))
    frequency = written(counts.groupBy(name).agg(F.count("*").alias("df")), "frequency")
    entries = frequency.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first().n
    is_hot = F.col("df") > entries / HOT_TERMS

    named = counts.select(key, "tf", name, whole.alias("_whole"))  # a short term is its name, and shuffled once
    marked = named.join(F.broadcast(frequency.filter(is_hot)), "_name", "left")
    hot = marked.filter(F.col("df").isNotNull())
    rare = marked.filter(F.col("df").isNull()).drop("df")
    rare = rare.join(frequency.filter(~is_hot), "_name")
    weight = F.col("tf") * F.log((docs.count() + F.lit(1)) / (F.col("df") + 1))
    term = F.coalesce("_whole", "_name").alias("term")
    return hot.unionByName(rare).select(key, term, "tf", "df", weight.alias("tfidf"))


def _is_long(term: str) -> Column:
    return F.length(term) > 40


def _short_name(term: str) -> Column:
    """The term, or a hash of it if it is long; words have no tab, so the two cannot meet."""
    hashed = F.concat(F.lit("\t"), F.md5(F.col(term)))
    return F.when(_is_long(term), hashed).otherwise(F.col(term))


def vector_entries(rows: DataFrame, key: str, vector: str, value: str) -> DataFrame:
    """The entries of sparse vectors as rows ``key, bucket, value``; no shuffle."""
    sparse = F.unwrap_udt(vector)
    entries = F.arrays_zip(
        sparse["indices"].alias("bucket"), sparse["values"].alias(value)
    )
    return rows.select(key, F.inline(entries)).toDF(key, "bucket", value)
