"""The registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from valence.llm import (
    alignment, decontaminate, exactdedup, fillmiddle, licenses, lmscore, neardedup, packing, pii, suffixes,
    toxicity, urlfilter, warc,
)
from valence.llm.common import table, training_part

#: The rules that the URL query applies (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Lines and passages by which licenses are known.
TEMPLATES = (
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("mit-line", "Released under the MIT License."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("gpl-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version."""),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template_id string, text string")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def _doc_id(df: DataFrame) -> DataFrame:
    return df.drop("row").withColumnRenamed("id", "doc_id")


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.archived(table(spark, sf, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_id(decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


def op3_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_id(lmscore.lm_scores(table(spark, sf, "documents"), use=training_part("doc_id", 1)))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    learnt = training_part("doc_id", 0)
    found = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"), use=learnt)
    return found.select(
        F.col("id").alias("doc_id"), (~training_part("id", 0)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])).alias("spans"),
    )


def op5_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_id(licenses.license_matches(table(spark, sf, "documents"), templates(spark)))


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf, "pages"), rules(spark)).withColumnRenamed("id", "page_id")


def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_id(exactdedup.exact_groups(table(spark, sf, "documents")))


def op8_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_id(neardedup.near_groups(table(spark, sf, "documents")))


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_id(packing.packed(table(spark, sf, "documents")))


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf, "documents"))

    def number(kind: int) -> F.Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        F.col("id").alias("doc_id"), *[number(k).alias(f"n_{pii.KINDS[k]}") for k in range(4)],
        F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "added")).alias("spans"),
    )


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    paths = [alignment.installed(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = alignment.alignment(table(spark, sf, "documents"), *paths)
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf, "documents"), kept_text=False)
    return _doc_id(found.select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_id(fillmiddle.fill_in_middle(table(spark, sf, "documents"), outputs=False))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_decontamination, op3_lm_scoring, op4_toxicity, op5_license_scan, op6_url_filter,
        op7_exact_dedup, op8_near_dedup, op9_packing, op10_pii, op11_alignment,
        op12_suffix_dedup, op13_fill_in_middle,
    )
}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLES = {
    "op1_warc": """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
numbered AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS origin FROM payloads)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + (i // 4) * 5 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM numbered""",
    "op6_url_filter": f"""
WITH rules(rh, rp, rv) AS (VALUES {_RULE_ROWS}),
split AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM split),
fits AS (
  SELECT page_id, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS k
  FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT urls.page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
FROM urls LEFT JOIN fits ON fits.page_id = urls.page_id AND k = 1""",
    "op7_exact_dedup": r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
grouped AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
         sha256(body) AS text_sha256 FROM plain)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped""",
    "op13_fill_in_middle": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c3,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS c4 FROM units),
cuts AS (
  SELECT doc_id, body, n, array_to_string(u[1:least(c1, c2)], '') AS pre,
    array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid, array_to_string(u[greatest(c1, c2) + 1:n], '') AS suf,
    CASE WHEN body = '' OR c3 >= 50 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') THEN 'plain'
      WHEN c4 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM cuts""",
}
