"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, decontam, langid, line_dedup, lm_score, near_dedup, packing, page_text, periodic_runs, quality, sharding, substring_dedup, vector_codes
from tidemark.llm.common import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 40)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether the CRC of the id's digits has this remainder; true for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(quality.training_rows(docs, table(spark, sf_dir, "labels"), "quality", held_out(5, 0)))
    return quality.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.learn(docs, held_out(3, 1))
    return langid.identify(docs.select("doc_id", "text"), samples).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(substring_dedup.repeated_spans(table(spark, sf_dir, "documents"), 50))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 4096)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contamination_report(decontam.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return lm_score.cross_entropy_difference(docs, good).drop("text")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.run_report(periodic_runs.collapse_runs(docs, unroll=periodic_runs.planted))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (
        op1_sharding, op2_quality, op3_langid, op4_ann, op5_suffix_dedup, op6_packing,
        op7_decontamination, op8_near_dedup, op9_line_dedup, op10_lm_score, op11_vector_codes,
        op12_page_text, op13_periodic_runs, pipeline,
    )
    return {f.__name__: f for f in found}


#: The rounds of op11 written out: parts against entries by inner products, exact in doubles as all are small whole numbers.
PARTS = """kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) v, row_number() over (order by vec_id) n from embeddings
  where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
parts as materialized (select vec_id, label, n, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] v from kept, range(4) r(p)),
book0 as materialized (select p, n - 1 k, v from parts where n <= 256)"""
ASSIGN = """near{r} as materialized (
  select vec_id, label, p, v, arg_min(k, (d, k)) k, min(d) d
  from (select a.vec_id, a.label, a.p, a.v, b.k, list_inner_product(a.v, a.v) - 2 * list_inner_product(a.v, b.v) + list_inner_product(b.v, b.v) d from parts a join book{r} b using (p))
  group by all)"""
MOVE = """book{n} as materialized (
  select b.p, b.k, coalesce(m.v, b.v) v from book{r} b left join (
    select p, k, list(x order by j) v from (select p, k, j, floor(sum(v[j]) / count(*)) x from near{r}, (select unnest(range(1, (select max(len(v)) + 1 from parts))) j) group by p, k, j) group by p, k
  ) m on b.p = m.p and b.k = m.k)"""


def oracle_sql() -> dict[str, str]:
    rounds = ", ".join(x for r in range(4) for x in (ASSIGN.format(r=r), MOVE.format(r=r, n=r + 1)))
    codes = f"""with {PARTS}, {rounds}, {ASSIGN.format(r=4)},
    coded as (select vec_id, label, string_agg(printf('%02x', k), '' order by p) code, sum(d)::bigint error from near4 group by vec_id, label)
    select vec_id, code, error, sum(error) over (partition by label)::bigint label_error,
      (select sha256(string_agg(list_aggregate(list_transform(v, lambda x: x::bigint::varchar), 'string_agg', ','), ',' order by p, k)) from book4) codebooks_sha256 from coded"""
    return {"op11_vector_codes": codes}
