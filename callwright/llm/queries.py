"""The registered queries of this subpackage: thin digests over the operators' outputs."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import html_extract, jaccard_join, lexical_search, line_dedup, packing, quality_rules, sentencepiece_codec, sharding, substring_dedup, token_alignment, topk_search, url_lists, word_bpe
from .oracles import ORACLES  # noqa: F401  (the driver's gate reads it)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(c):
    return F.sha2(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), 256)


def op1_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_sharding(spark, sf_dir):
    out = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"), shards=8)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op5_url_lists(spark, sf_dir):
    """Captures: all pages, fetched on a day that follows from the page's id.  List: entries for hosts and
    path prefixes of the pages, added, removed and added again on days that follow from their names."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.withColumn("fetched_on", day(F.pmod(F.col("page_id") * 37, F.lit(730))))
    host = url_lists.host_of(F.col("url"))
    domain = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    prefix = F.concat(host, F.lit("/"), F.lower(F.get(F.split(F.regexp_extract("url", url_lists.PATH, 1), "/"), F.lit(1))))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("pattern")) for k, v in (("domain", host), ("domain", domain), ("prefix", prefix))])
    named = pages.where(host.isNotNull()).select(F.inline(kinds)).where("pattern is not null").distinct()
    code = named.withColumn("c", F.conv(F.substring(F.md5("pattern"), 1, 7), 16, 10).cast("bigint"))
    chosen = code.where("c % 3 = 0")
    turns = F.array(
        F.struct(F.lit("add").alias("action"), day(F.col("c") % 500).alias("at")),
        F.struct(F.lit("remove").alias("action"), day(F.col("c") % 500 + 40 + F.col("c") % 90).alias("at")),
        F.struct(F.lit("add").alias("action"), F.when(F.col("c") % 2 == 0, day(F.col("c") % 500 + 180)).alias("at")),
    )
    entries = chosen.select("pattern", "kind", F.inline(turns))
    return url_lists.as_of(captures, url_lists.intervals(entries))


def op6_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("kept")).alias("kept_sha256"))


def op7_topk_search(spark, sf_dir):
    return topk_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_html_extraction(spark, sf_dir):
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark, sf_dir):
    out = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return token_alignment.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_lexical_search(spark, sf_dir):
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_word_bpe(spark, sf_dir):
    return word_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_packing, op3_sharding, op4_quality_rules, op5_url_lists, op6_line_dedup, op7_topk_search, op8_html_extraction, op9_substring_dedup, op10_jaccard_join, op11_token_alignment, op12_lexical_search, op13_word_bpe)}
