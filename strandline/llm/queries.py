"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, langid, licenses, packing, quality, rules, simhash, store, topk
from .common import Scratch, hex64, read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # A row without an id is in no fold: it teaches nothing, and isn't held out.
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs, model, {"held_out": held_out}).select("doc_id", "held_out", "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(read_table(spark, sf_dir, "documents"), ranks, pattern)
    decoded = bpe.decode_documents(encoded, ranks, pattern)
    decimals = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(read_table(spark, sf_dir, "documents")))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-store").path("store")
    root = store.write_store(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return store.read_digests(spark, path, root)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge_documents(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1).drop("row_id")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id as vec_id,
         list_inner_product(a.q::double[], b.q::double[])::bigint as score
  from v a join v b on a.vec_id <> b.vec_id
  where a.vec_id % 20 = 0
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score
  from s
)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

#: The rules of op8 in SQL. A line fails by any rule; which comes first doesn't matter for the counts.
OP8_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
u as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from w),
g as (select doc_id, i, word, lead(word) over x as w2, lead(word, 2) over x as w3 from u window x as (partition by doc_id order by i)),
c as (select doc_id, i, w3 is not null and count(*) over (partition by doc_id, word, w2, w3) > 1 as again from g),
v as (select doc_id, max(again::int) over (partition by doc_id order by i rows between 2 preceding and current row) as inside from c),
r as (select doc_id, sum(inside)::bigint as n_repeat_words from v group by doc_id),
l0 as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d),
l1 as (select *, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from l0),
l2 as (select *, len(ws) as n, row_number() over (partition by doc_id, line order by i) > 1 as earlier from l1 where len(ws) > 0),
l3 as (select doc_id, line, earlier,
  len(list_filter(string_split_regex(line, '\s+'), lambda x: x in ('|', '»', '›', '·', '•'))) >= 3
  or (n >= 2 and len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > 0.3 * n)
  or (n >= 4 and length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) > 0.7 * greatest(1, length(regexp_replace(line, '[^\p{L}]', '', 'g'))))
  or (n >= 12 and len(list_distinct(ws)) < 0.2 * n)
  or earlier
  or regexp_matches(line, '(?i)\b(?:enable javascript|javascript is (?:disabled|required)|accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|sign up for our newsletter|subscribe to our newsletter|click here to|skip to (?:main )?content|lorem ipsum)\b')
  or (n >= 12 and not regexp_matches(line, '[^\P{P}#*%&@\\/_-]')) as fault
  from l2),
l as (select doc_id, count(*) filter (earlier) as n_dup_lines, coalesce(sum(length(line)) filter (fault), 0) as gone from l3 group by doc_id),
f as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  coalesce(gone, 0)::double / greatest(1, length(text) - (length(text) - length(replace(text, chr(10), '')))) as lost
  from w left join r using (doc_id) left join l using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost <= 0.4 as kept, lost
from f
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_license_scan": op5_license_scan,
    "op6_main_text": op6_main_text,
    "op7_token_store": op7_token_store,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_exact_top_k": op10_exact_top_k,
}

ORACLE_SQL: dict[str, str] = {"op8_quality_rules": OP8_SQL, "op10_exact_top_k": OP10_SQL}
