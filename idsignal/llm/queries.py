"""The registered queries of the text operators and what SQL can say about them.

Each query runs its operator over the whole table with production parameters and derives the
columns it returns from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from idsignal.llm import (audit, fingerprints, language, licenses, mixing, packing, pii, quality, simhash, substrings, topk,
                          toxicity, whitening)
from idsignal.llm.common import fold

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, fold() != 0, fold() == language.CALIBRATION, ["doc_id"])
    return found.select("doc.doc_id", (fold("doc.doc_id") == 0).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "entropy", "rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold() != 0, ["doc_id"])
    return found.select("doc.doc_id", (fold("doc.doc_id") == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("row_id").alias("vec_id"), "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source: 16 to a directory, 256 to its parent; each 16th is a LICENSE file."""
    docs = table(spark, sf_dir, "documents")
    step = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    file = F.when(F.col("doc_id") % 256 == 0, F.concat_ws("/", "source", step(256), F.lit("LICENSE"))).when(
        F.col("doc_id") % 16 == 0, F.concat_ws("/", "source", step(256), step(16), F.lit("LICENSE"))).otherwise(
        F.concat_ws("/", "source", step(256), step(16), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    found = licenses.scan(docs.select("doc_id", "text", file.alias("path")), ["doc_id"])
    return found.select("doc.doc_id", "path", "own", "cosine", "licence", "declared_in")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return judged.select("doc.doc_id", *quality.COUNTS, "base_failed", "kept", "anomaly")


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.group(table(spark, sf_dir, "documents"), ["doc_id"])
    return grouped.select("doc.doc_id", simhash.hex_digits("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    shards = F.array_join(F.transform(F.filter("picks", lambda p: p["taken"] > 0), lambda p: p["shard"].cast("string")), ",")
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), ["doc_id"], tokenizer_path())
    return packed.select("doc.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), ["doc_id"])
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc.doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.followed(table(spark, sf_dir, "documents"), ["doc_id"])
    kept = pairs.withColumn("doc", F.struct("doc.doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256")))
    found = fingerprints.compare(kept, "text", ("edited", "next"))
    edited, after = F.col("others")[0], F.col("others")[1]
    return found.select("doc.doc_id", "doc.n_chars", "doc.edited_sha256", "fingerprint", edited["fingerprint"].alias("edited_fingerprint"),
                        edited["likeness"].alias("near_edited"), after["likeness"].alias("near_next"), "paragraphs",
                        F.size(edited["gone"]).alias("n_gone"), F.size(edited["added"]).alias("n_added"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), ["vec_id"])
    value = F.posexplode("whitened").alias("place", "whitened")
    spread = found.select("doc.vec_id", "n", "deviation", "explained", "identity_error", value)
    return spread.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                         F.get("explained", F.col("place")).alias("explained"), "identity_error")


QUERIES = {
    "op1_language": op1_language,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_top_k": op5_top_k,
    "op6_simhash_groups": op6_simhash_groups,
    "op7_license_scan": op7_license_scan,
    "op8_mix_sources": op8_mix_sources,
    "op9_pack_sequences": op9_pack_sequences,
    "op10_personal_data": op10_personal_data,
    "op11_filter_audit": op11_filter_audit,
    "op12_fingerprints": op12_fingerprints,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {
    "op5_top_k": """
with v as (
  select vec_id, [cast(floor(1024 * cast(x as double)) as double) for x in embedding] as e from embeddings
  where embedding is not null and vec_id is not null
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10""",
    "op11_filter_audit": """
with recursive texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
words as (
  select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, min(doc_id) over (partition by text) as first_id from texts),
marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels where doc_id is not null group by doc_id),
flags as (
  select part,
    (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce((words.doc_id > first_id)::int, 0) as mask,
    coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from words left join marks on words.doc_id = marks.doc_id),
counts as (select part, mask, sum(1) as n, sum(good) as good, sum(toxic) as toxic from flags group by part, mask),
orders as (
  select '' as filter_order, 0 as step, 0 as before, 0 as bit
  union all
  select filter_order || l.letter, step + 1, before | bit, l.b
  from orders join (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) l(letter, b) on ((before | bit) & l.b) = 0),
steps as (
  select f.filter_order, s.step, s.before, s.bit
  from orders f join orders s on f.step = 5 and s.step > 0 and starts_with(f.filter_order, s.filter_order)),
found as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter ((mask & (before | bit)) = 0), 0) as kept,
    coalesce(sum(n) filter ((mask & before) = 0 and (mask & bit) > 0), 0) as removed,
    coalesce(sum(n) filter ((mask & before) > 0 and (mask & bit) > 0), 0) as redundant,
    coalesce(sum(n) filter (mask = bit), 0) as unique_fails,
    coalesce(sum(good) filter ((mask & before) = 0 and (mask & bit) > 0), 0) as good_lost,
    coalesce(sum(toxic) filter ((mask & before) = 0 and (mask & bit) > 0), 0) as toxic_lost
  from counts cross join steps group by part, filter_order, step, bit)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley
from found""",
}
