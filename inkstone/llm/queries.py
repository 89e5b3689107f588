"""One query for each operator of this folder, over whole tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkstone.llm import bpe, centroids, embedding_dedup, language_model, line_dedup, packing, phrases, pii, quality, sharding, simhash, token_counts, toxicity
from inkstone.llm.common import table
from inkstone.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@lru_cache(maxsize=None)
def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on this machine and on the workers."""
    import public_tokenizers

    return public_tokenizers.path(name)


SQL_EMBEDDINGS = """
with recursive
usable as (
  select row_number() over (order by vec_id) as r, vec_id, label, cast(embedding as double[]) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.r as a, b.r as b, b.vec_id as other
  from usable a join usable b on a.label = b.label and a.r <> b.r and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (
  select r as a, r as b from usable
  union
  select reach.a, links.b from reach join links on links.a = reach.b),
least as (select reach.a, min(u.vec_id) as component_id from reach join usable u on u.r = reach.b group by 1),
counts as (select a, count(*) as n from links group by 1)
select u.vec_id, coalesce(n, 0) as n_links, component_id, u.vec_id is not distinct from component_id as kept
from usable u join least on least.a = u.r left join counts on counts.a = u.r
union all
select vec_id, 0, vec_id, true from embeddings e
where label is null or embedding is null or len(list_filter(embedding, lambda x: x is null or not isfinite(x))) > 0
   or len(list_filter(embedding, lambda x: x <> 0)) = 0
"""


@query("op1_embedding_dedup", SQL_EMBEDDINGS)
def op1_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf, "embeddings"))


@query("op2_pii")
def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return pii.find(docs, pii.detector_for(docs))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op5_lm_score")
def op5_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return language_model.score(table(spark, sf, "documents"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


SQL_SHARDS = """
with h as (
  select doc_id, strlen(coalesce(text, '')) as bytes,
         lpad(bin(cast('0x' || left(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 15) as bigint)), 60, '0') as bits
  from documents),
spread as (select doc_id, bytes, bits, cast(d as int) as depth, left(bits, cast(d as int)) as shard from h, range(0, 61) t(d)),
sums as (select depth, shard, sum(bytes) as shard_bytes, count(*) as n from spread group by 1, 2)
select doc_id, bytes, depth, shard, cast(shard_bytes as bigint) as shard_bytes
from spread join sums using (depth, shard)
where shard_bytes <= 1048576 or n = 1
qualify row_number() over (partition by doc_id, bits order by depth) = 1
"""


@query("op8_sharding", SQL_SHARDS)
def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign(table(spark, sf, "documents"), 1 << 20).drop("text_hash")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents")).select("doc_id", "quality.*")


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format

SQL_LINES = f"""
with docs as materialized (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
keyed as materialized (
  select r, doc_id, pos, lines[pos] as line, {LOWER("trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key
  from (select *, unnest(generate_series(1, len(lines))) as pos from docs)),
frequent as (select key as gone from keyed where key <> '' group by key having count(distinct r) >= 10)
select doc_id, count(*) as n_lines, count(gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where gone is null), '')) as kept_sha256
from keyed left join frequent on key = gone group by r, doc_id
"""


@query("op11_line_dedup", SQL_LINES)
def op11_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.drop_frequent_lines(table(spark, sf, "documents"), 10, 1)
    own = F.col(found.columns[-1])
    return found.select("doc_id", own["n_lines"].alias("n_lines"), own["n_dropped"].alias("n_dropped"), F.sha2(own["text"], 256).alias("kept_sha256"))


SQL_PHRASES = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex({LOWER("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
worded as materialized (
  select lang, w from (select lang, list_filter(string_split_regex(piece, '[ \\x09]+'), lambda x: x <> '') as w from pieces) where len(w) > 0),
totals as (select lang, cast(sum(len(w)) as bigint) as n from worded group by lang),
grams as materialized (
  select lang, phrase, words, count(*) as f from (
    select lang, words, array_to_string(w[p : p + words - 1], ' ') as phrase
    from (select lang, w, words, unnest(range(1, len(w) - words + 2)) as p from worded, (select unnest([1, 2, 3, 4]) as words)))
  group by all),
candidates as (select *, string_split(phrase, ' ') as w from grams where words > 1 and f >= 30),
cuts as (
  select lang, phrase, words, w, f as a, k, array_to_string(w[1 : k], ' ') as lhs, array_to_string(w[k + 1 : words], ' ') as rhs
  from (select *, unnest(range(1, words)) as k from candidates)),
scored as (
  select c.*, x.f as l, y.f as r, (cast(c.a as hugeint) * 2000000) // (cast(x.f as hugeint) + y.f) as score
  from cuts c join grams x on x.lang = c.lang and x.phrase = c.lhs join grams y on y.lang = c.lang and y.phrase = c.rhs
  qualify row_number() over (partition by c.lang, c.phrase order by score, k) = 1),
inside as (
  select lang, array_to_string(w[p : p + size - 1], ' ') as phrase, max(f) as most
  from (select *, unnest(range(1, words - size + 2)) as p from (select *, unnest(range(2, words)) as size from candidates))
  group by all),
ranked as (
  select s.lang, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank, s.phrase, s.a, s.l, s.r, s.score
  from scored s left join inside i on i.lang = s.lang and i.phrase = s.phrase
  where i.most is null or 100 * i.most < 80 * s.a)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked join totals using (lang) where rank <= 2000
"""


@query("op12_phrase_collocations", SQL_PHRASES)
def op12_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"), least=30, top=2000)


def _assigned(turn: int) -> str:
    return f"""near{turn} as materialized (
  select r, v, cluster, distance from (
    select p.r, p.v, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) as distance
    from points p cross join centroids{turn} c)
  qualify row_number() over (partition by r order by distance, cluster) = 1)"""


def _moved(turn: int) -> str:
    return f"""centroids{turn + 1} as materialized (
  select c.cluster, coalesce(m.v, c.v) as v from centroids{turn} c left join (
    select cluster, list((s - ((s % n) + n) % n) // n order by i) as v
    from (select cluster, i, sum(v[i]) as s, count(*) as n from near{turn}, range(1, 65) t(i) group by all) group by cluster) m using (cluster))"""


SQL_CENTROIDS = f"""
with points as materialized (
  select row_number() over () as r, vec_id, list_transform(cast(embedding as double[]), lambda x: cast(floor(256 * x) as hugeint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
centroids0 as materialized (
  select cast(row_number() over (order by sha256('2:' || coalesce(cast(vec_id as varchar), '')), r) - 1 as int) as cluster, v from points
  qualify cluster < 40),
{", ".join(f"{_assigned(t)}, {_moved(t)}" for t in range(5))}, {_assigned(5)},
sums as (select cluster, sum(distance) as s from near5 group by cluster)
select p.vec_id, n.cluster, cast(n.distance as bigint) as distance, cast(s.s as bigint) as cluster_inertia,
       cast((select sum(s) from sums) as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from near5 n join points p using (r) join sums s using (cluster) join centroids5 c on c.cluster = n.cluster
"""


@query("op13_centroid_clusters", SQL_CENTROIDS)
def op13_centroid_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster(table(spark, sf, "embeddings"), k=40, rounds=5, seed="2")
