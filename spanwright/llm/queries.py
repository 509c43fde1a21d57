"""The registered queries of the training-data operators: thin digests of whole-table results."""

from __future__ import annotations

from . import ann, html, langid, mixing, omh, packing, pii, substring, tiff, toxicity
from .common import table


def tokenizer_path() -> str:
    """The public byte-level vocabulary that the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES = {
    "op1_toxicity": lambda spark, d: toxicity.op1_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_packing": lambda spark, d: packing.pack(table(spark, d, "documents"), tokenizer_path()),
    "op3_langid": lambda spark, d: langid.op3_langid(table(spark, d, "documents")),
    "op4_ann": lambda spark, d: ann.op4_ann(table(spark, d, "embeddings")),
    "op5_media": lambda spark, d: tiff.op5_media(table(spark, d, "documents")),
    "op7_pii": lambda spark, d: pii.op7_pii(table(spark, d, "documents"), pii.session_key(spark)),
    "op8_near": lambda spark, d: omh.op8_near(table(spark, d, "documents")),
    "op9_html": lambda spark, d: html.extract(table(spark, d, "pages")),
    "op10_substring": lambda spark, d: substring.op10_substring(table(spark, d, "documents")),
    "op6_mixing": lambda spark, d: mixing.op6_mix(table(spark, d, "documents")),
}

_OP6 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i, 2.0e0 * source_size AS cap FROM s),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0e0 WHEN 1 THEN 1.0e0 ELSE 2.0e0 END AS weight FROM r),
v AS (SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
l AS (SELECT arg_min(lv, cap / weight) AS lv FROM v WHERE lv <= cap / weight),
t AS (SELECT source, source_size, least(cap, coalesce(l.lv * weight, cap)) AS target FROM v LEFT JOIN l ON TRUE),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS base FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
c AS (SELECT g.source, h, size, sum(size) OVER (PARTITION BY g.source ORDER BY h) AS upto, target - base * source_size AS rest
      FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
f AS (SELECT source, arg_min(CASE WHEN upto - rest < rest - (upto - size) THEN h ELSE h - 1 END, h) AS threshold FROM c WHERE upto > rest GROUP BY source)
SELECT d.doc_id, d.size, b.source_size, b.target, d.size * (b.base + CASE WHEN d.h <= f.threshold THEN 1 ELSE 0 END) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""

ORACLES: dict[str, str] = {"op6_mixing": _OP6}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
