"""The registered queries: each applies its operator to a whole table and derives the columns it returns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, labelled, media, mixing, nearvec, passages, quality, resampling, rules, scratch, sharding, simhash, token_files, toxicity

WORD = r"[^\x20\x09-\x0D]+"
RANKS, WORD_TOKENIZER, END_ID = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)), weights=(5, 2, 1), budget=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, drop_text=True)
    told = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    decoded = bpe.decode(told, path, public_tokenizers.PATTERN, drop_ids=True)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(WORD_TOKENIZER), encoding="utf-8") as f:
        tokenizer = f.read()
    path = scratch.folder(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer, END_ID)
    return token_files.read(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("frame").alias("ids_crc32"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_prints(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, radius=2)
    return near.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine, drop_text=True).select("doc_id", labelled.held_out().alias("held_out"), "score", "predicted")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = passages.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35, drop_text=True)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, forest, drop_text=True).select("doc_id", labelled.held_out().alias("held_out"), "score", "predicted")


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents").select("doc_id", "text"))
    heard = media.listen(stored)
    feature = F.concat_ws(";", *(F.concat_ws("=", F.lit(c), F.col(c).cast("string")) for c in ("coding", "n_samples", "rms", "peak", "crossings", "pcm_crc32")))
    return heard.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"))


def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance", "nearest", "script")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"), seed=2024, share=(10, 100), least_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvec.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), similarity=0.95)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_byte_bpe, op3_token_files, op4_shard, op5_simhash, op6_toxicity, op7_passages, op8_quality, op9_telephony, op10_divergence_rules, op11_resample, op12_codes, op13_near_vectors)}



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds in whole numbers, one CTE after another."""
    valid = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"
    steps = [
        f"kept as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v, len(embedding) // {parts} as w from embeddings where {valid})",
        f"cut as materialized (select vec_id, label, p, v[p * w + 1 : p * w + w] as x from kept, range({parts}) r(p))",
        f"book0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from cut where vec_id in (select vec_id from kept order by vec_id limit {entries}))",
    ]
    away = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    for r in range(rounds + 1):
        steps.append(f"told{r} as materialized (select vec_id, p, any_value(label) as label, any_value(x) as x, min(struct_pack(d := {away}, e := e)) as best from cut join book{r} using (p) group by vec_id, p)")
        if r < rounds:
            steps.append(f"sums{r} as (select p, best.e as e, i, sum(x[i])::bigint as s, count(*) as n from (select p, best, x, unnest(range(1, len(x) + 1)) as i from told{r}) group by all)")
            steps.append(f"mean{r} as (select p, e, list((s - (s % n + n) % n) // n order by i) as m from sums{r} group by p, e)")
            steps.append(f"book{r + 1} as materialized (select p, e, coalesce(m, c) as c from book{r} left join mean{r} using (p, e))")
    steps.append(f"coded as (select vec_id, any_value(label) as label, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' order by p) as code, sum(best.d)::bigint as error from told{rounds} group by vec_id)")
    steps.append(f"digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})")
    return "with " + ",\n".join(steps) + "\nselect vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded, digest"


#: DuckDB SQL, where a query can be said in it.
ORACLE_SQL = {
    "op11_resample": r"""
with steps as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b::bigint, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) as crc),
cut as (select 'd' as kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
words as materialized (select kind, doc_id, unnest(ws) as w from cut),
coded as (select w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint) as bs from (select distinct w from words)),
bucketed as materialized (select w, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket from coded, steps),
held as (select bucket, count(*) filter (kind = 'd') as s, count(*) filter (kind = 'b') as t from words join bucketed using (w) group by 1),
gain as (select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from held) + 10000)::double / ((s + 1)::double * ((select sum(t) from held) + 10000)::double)))::bigint as g from held),
weighed as (select doc_id, sum(g)::bigint as g from words join bucketed using (w) join gain using (bucket) where kind = 'd' group by 1),
scored as (select doc_id, len(ws) as n_features, coalesce(g, 0) as weight, coalesce(g, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from cut left join weighed using (doc_id) where kind = 'd'),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when n <= (select 10 * count(*) // 100 from placed) then n end as rank from scored left join placed using (doc_id)""",
    "op12_codes": _codes_sql(),
    "op13_near_vectors": """
with recursive e as materialized (select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) as (select vec_id, vec_id from embeddings union select reach.a, links.b from reach join links on reach.b = links.a)
select vec_id, coalesce(n, 0) as n_links, root as component_id, vec_id = root as kept from embeddings left join (select a as vec_id, count(*) as n from links group by 1) using (vec_id) join (select a as vec_id, min(b) as root from reach group by 1) using (vec_id)""",
    "op7_passages": r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i : i + 34], ' ') as w from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from words)),
again as (select w from windows group by w having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from windows where w in (select w from again)),
placed as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from words),
left_over as (select placed.doc_id, string_agg(word, ' ' order by placed.p) filter (gone.p is null) as kept, count(gone.p) as n from placed left join gone on gone.doc_id = placed.doc_id and gone.p = placed.p group by 1)
select words.doc_id, len(ws) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from words left join left_over on left_over.doc_id = words.doc_id""",
}
