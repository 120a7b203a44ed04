"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridweave.llm.align import aligned
from gridweave.llm.audio import matches, recordings
from gridweave.llm.binary import read_ids, write_ids
from gridweave.llm.html import extracted
from gridweave.llm.language import identify
from gridweave.llm.lines import without_repeated_lines
from gridweave.llm.minhash import near_duplicates
from gridweave.llm.mixing import mixed
from gridweave.llm.packing import best_fit_packing
from gridweave.llm.resample import resampled
from gridweave.llm.secrets import scan
from gridweave.llm.sentences import without_repeated_spans
from gridweave.llm.shared import new_path, table
from gridweave.llm.topk import top_k


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs, maximal=True).withColumnsRenamed({"_n_lines": "n_lines", "_n_deleted": "n_deleted"})


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_spans(docs).withColumnsRenamed({"_n_sentences": "n_sentences", "_n_removed": "n_removed"})


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed(table(spark, sf_dir, "documents"), texts=False)
    return mix.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


#: The level whose capped targets sum up to the whole is searched among all sources by a plain join.
MIX_SQL = r"""
with sized as (
  select *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), sources as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][(row_number() over (order by source is null, source collate "binary") - 1) % 3 + 1] as weight
  from sized group by source
), levels as (
  select a.source_size / a.weight as reached,
    (sum(b.source_size) - 3 * coalesce(sum(b.source_size) filter (b.source_size / b.weight < a.source_size / a.weight), 0))
      / (sum(b.weight) - coalesce(sum(b.weight) filter (b.source_size / b.weight < a.source_size / a.weight), 0)) as level,
    a.weight, a.source_size
  from sources a, sources b group by a.source, a.source_size, a.weight
), level as (
  select arg_min(level, reached) as level from levels where level * weight <= 3 * source_size
), goal as (
  select source, source_size, coalesce(least(3 * source_size::double, level * weight), 0) as target from sources, level
), placed as (
  select doc_id, size, source_size, target,
    case when source_size > 0 then least(target / source_size, 3.0::double) else 0 end as rate,
    ('0x' || substr(md5('mix:' || coalesce('+' || d.source, '-')), 1, 12))::bigint / (1::bigint << 48)::double as shift,
    row_number() over (partition by d.source order by
      length(bin(size)) * 8 + floor(size / pow(2.0, greatest(length(bin(size)) - 4, 0)))::bigint % 8,
      md5(coalesce(doc_id::varchar, text, '')), doc_id) as place
  from sized d join goal g on d.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  ((floor(place * rate + shift) - floor((place - 1) * rate + shift)) * size)::bigint as taken
from placed
"""


def op9_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each row of embeddings is played as a melody."""
    return matches(recordings(table(spark, sf_dir, "embeddings"))).withColumnRenamed("rec_id", "vec_id")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path)


def op11_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of each distinct word bit by bit: -1 stands for a step of the register, other numbers for a byte that comes in.
RESAMPLE_SQL = r"""
with texts as (
  select row_number() over () as r, doc_id, 0 as goal, text from documents
  union all select row_number() over (), null, 1, text from benchmark
), cut as (
  select r, doc_id, goal, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words
  from texts
), vocabulary as (
  select word, hex(encode(word)) as h from (select distinct unnest(words) as word from cut)
), hashed as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(len(h) // 2),
      lambda k: list_prepend(('0x' || substr(h, 2 * k + 1, 2))::bigint, [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[])))),
    lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295) % 10000 as bucket
  from vocabulary
), found as (
  select r, doc_id, goal, bucket from (select r, doc_id, goal, unnest(words) as word from cut) join hashed using (word)
), counted as (
  select bucket, count(*) filter (goal = 0) as s, count(*) filter (goal = 1) as t from found group by bucket
), gained as (
  select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain
  from counted
), weighed as (
  select r, sum(gain)::bigint as weight from found join gained using (bucket) where goal = 0 group by r
), scored as (
  select c.doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(c.doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from cut c left join weighed w using (r) where goal = 0
), placed as (
  select *, row_number() over (order by n_features < 20, score desc, doc_id nulls first) as place,
    count(*) filter (n_features >= 20) over () * 10 // 100 as drawn
  from scored
)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= drawn then place end as rank from placed
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return aligned(table(spark, sf_dir, "documents"), *names)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_line_dedup": op2_line_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_sentence_spans": op6_sentence_spans,
    "op7_secret_scan": op7_secret_scan,
    "op8_source_mixing": op8_source_mixing,
    "op9_audio_fingerprints": op9_audio_fingerprints,
    "op10_token_binary": op10_token_binary,
    "op11_template_extraction": op11_template_extraction,
    "op12_target_resampling": op12_target_resampling,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op1_exact_topk": TOPK_SQL,
    "op8_source_mixing": MIX_SQL,
    "op12_target_resampling": RESAMPLE_SQL,
}
