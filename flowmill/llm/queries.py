"""The operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, decontam, divergence, hard_negatives, langid_nb, line_dedup, mix_waterfill, mpeg_audio, near_dedup, quality_fm, shard_bytes, token_counts, warc_chunks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_fm.Machine:
    return quality_fm.train(docs, table(spark, sf_dir, "labels"), lambda i: held_out(i, 3, 1))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_fm.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op3_langid_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    predicted = langid_nb.predict(docs, langid_nb.train(docs.where(~out)))
    return predicted.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_chunks.read_records(warc_chunks.write_records(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.probe(mpeg_audio.store(table(spark, sf_dir, "documents")))


def op6_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_bytes.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, vocab = brown_lm.train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 7, 2)))
    scored = brown_lm.score(docs, model, vocab)
    return scored.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_mix_waterfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_waterfill.copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, noisy)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_fm, op3_langid_nb, op4_warc_chunks, op5_mpeg_audio, op6_shard_bytes, op7_prob_minhash, op8_brown_lm, op9_mix_waterfill, op10_decontaminate, op11_token_cache, op12_hard_negatives, op13_divergence)}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BIT = "cast(substr(b, {0}, 1) as int)"

ORACLES = {
    "op4_warc_chunks": f"""
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as n, sha1(body) as x, cast(unhex(sha1(body)) as bit)::varchar as b from p),
e as (select page_id, n, x, list_aggregate(list_transform(range(32), lambda i:
        substr('{_BASE32}', 1 + 16 * cast(substr(b, 5 * i + 1, 1) as bigint) + 8 * cast(substr(b, 5 * i + 2, 1) as bigint)
        + 4 * cast(substr(b, 5 * i + 3, 1) as bigint) + 2 * cast(substr(b, 5 * i + 4, 1) as bigint) + cast(substr(b, 5 * i + 5, 1) as bigint), 1)), 'string_agg', '') as digest,
      min(page_id) over (partition by x, n) as first_id from d)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to, true as intact
from e""",
    "op9_mix_waterfill": f"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
             md5(concat_ws(':', '{mix_waterfill.SEED}', cast(doc_id as varchar))) as k from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from d group by source),
c as (select *, 3 * source_size as clamp from s),
l as (select *, (sum(source_size) over () - coalesce(sum(clamp) over w, 0))::double
             / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as lvl
      from c window w as (order by clamp::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
r as (select *, lvl * weight >= clamp as filled from l),
t as (select source, source_size, case when filled then clamp::double else max(case when not filled then lvl end) over () * weight end as target from r),
u as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
x as (select d.*, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size as rest,
        sum(size) over (partition by d.source order by k, doc_id rows unbounded preceding)::bigint as run
      from d join u on d.source is not distinct from u.source)
select doc_id, size, source_size, target,
       size * (whole + case when 2 * run - size <= 2 * rest and rest > 0 then 1 else 0 end)::bigint as taken
from x""",
    "op12_hard_negatives": """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(embedding, lambda x: floor(256 * x::double)) as v
           from embeddings where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
      from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank,
       id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5""",
    "op13_divergence": r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term, count(*) as total from w group by all having count(distinct k) >= 30),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w group by all),
x as (select g.lang, g.source, kept.term, coalesce(n, 0)::hugeint as n, kept.total::hugeint as total
      from g join kept using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
p as (select lang, source, term, n, (1 + 1000000000 * (n + 5) // (sum(n) over s + 5 * count(*) over s))::bigint as p,
             (1 + 1000000000 * (total + 5) // (sum(total) over s + 5 * count(*) over s))::bigint as q from x window s as (partition by lang, source)),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(v, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
         left join (select i.lang, i.source, j.source as item, sum(abs(i.p - j.p)) as v from p i join p j using (lang, term) group by all) s on s.lang = a.lang and s.source = a.source and s.item = b.source),
term as (select lang, source, 'term' as part, term as item, p - q as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pair union all select * from term))
select * from ranked where part = 'pair' or rank <= 50""",
}
