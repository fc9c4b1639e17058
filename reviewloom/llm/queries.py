"""The numbered queries over the tables of a folder, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import table
from reviewloom.llm.conversations import repair_conversations
from reviewloom.llm.decontaminate import contamination
from reviewloom.llm.hnsw import approximate_topk
from reviewloom.llm.mixing import mix_sources
from reviewloom.llm.ngram_join import link_near_duplicates
from reviewloom.llm.pii import find_personal_data
from reviewloom.llm.secrets import scan_secrets
from reviewloom.llm.sharding import shard_by_bytes
from reviewloom.llm.substring_dedup import remove_repeated_chunks
from reviewloom.llm.suffix_dedup import remove_repeats
from reviewloom.llm.token_alignment import align_tokenizers
from reviewloom.llm.topk_search import exact_topk
from reviewloom.llm.toxicity import fit, score_toxicity

N_SHARDS = 40

OP3_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select item_id, array_to_string(w[s : s + 12], ' ') as win, least(len(w), 13) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s from b where len(w) > 0)),
places as (
  select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from windows) where len(w) >= n)),
hits as (select p.doc_id, p.s, p.n, v.item_id from places p join windows v on p.win = v.win and p.n = v.n),
covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + n)) as pos from hits) group by doc_id),
listed as (select doc_id, list_sort(list(distinct cast(item_id as varchar))) as items from hits group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, cast(coalesce(len(l.items), 0) as bigint) as n_items,
       sha256(coalesce(array_to_string(l.items, ','), '')) as items_sha256,
       coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from d left join covered c using (doc_id) left join listed l using (doc_id)
"""

SOURCE_WEIGHTS = (5, 2, 1)

OP4_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
reach(doc_id, seen) as (select doc_id, doc_id from documents union select b, seen from reach join links on a = doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(seen) as component_id
from documents d left join n using (doc_id) join reach r using (doc_id) group by d.doc_id, n.n
"""

OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(place as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from p) where place <= 5
"""


#: CRC-32 by its table of 256 remainders, which the rule of its polynomial gives.
OP7_SQL = r"""
with recursive bits(i, k, v) as (
  select i, 0, i from range(0, 256) as t(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by i) as c from bits where k = 8),
d as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint)) as b
  from documents),
s as (
  select doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, c[(xor(a, x) & 255) + 1])), 4294967295) as text_crc32
  from d, crc),
p as (select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows between unbounded preceding and current row) as upto, sum(size) over () as whole from s),
q as (select *, cast(least(39, (upto * 2 - size) * 40 // (2 * whole)) as int) as shard from p)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'bytes' as law, shard,
       row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot, cast(null as int) as grown_shard
from q
"""

#: Written without the operator's shortcuts: all quotients are ranked, and all runs laid on all documents.
OP8_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         cast('0x' || substr(md5('42:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as draw
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, cast([5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as weight
  from d group by source),
f as (select *, cast(source_size as double) * 3 as cap, cast(source_size as double) * 3 / weight as fill, cast(sum(source_size) over () as double) as total from s),
l as (
  select *, (total - coalesce(sum(cap) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by fill, source nulls last rows between current row and unbounded following) as here,
         row_number() over (order by fill, source nulls last) as place
  from f),
t as (
  select source, source_size, case when lvl is null or lvl * weight > cap then cap else lvl * weight end as target, cast(ceil(source_size / 16) as bigint) as blocks
  from (select *, (select arg_min(here, place) from l where here <= fill) as lvl from l)),
q as (
  select source, row_number() over (order by target / (2 * k + 1) desc, source nulls last, k) as won
  from (select source, target, unnest(range(0, 3 * blocks + 2)) as k from t where target > 0)),
h as (select j, (n * (j + 1) + 20) // 40 as h, n from (select cast(round(sum(target) / 16) as bigint) as n from t), (select unnest(range(0, 40)) as j)),
u as (
  select t.source, j, blocks, least(3 * blocks, (select count(*) from q where q.source is not distinct from t.source and won <= h)) as upto from t, h),
w as (
  select source, j, blocks, coalesce(lag(upto) over (partition by source order by j), 0) as before, upto, max(upto) over (partition by source) as quota,
         cast('0x' || substr(md5('42:' || coalesce(source, '') || ':' || j), 1, 4) as bigint) as u
  from u),
r as (
  select source, (low + shift) * 16 as low, (high + shift) * 16 as high
  from (select *, greatest(before, round * blocks) as low, least(upto, (round + 1) * blocks) as high,
               case when (round + 1) * blocks <= quota then 0 else (blocks - quota % blocks) * (j * 65536 + u) // (40 * 65536) end - round * blocks as shift
        from w, (select unnest([0, 1, 2]) as round) where blocks > 0)
  where low < high),
line as (
  select *, row_number() over () as row, sum(size) over (partition by source order by draw, doc_id, size rows between unbounded preceding and current row) as line_to from d),
taken as (
  select row, sum(greatest(0, least(line_to, high) - greatest(line_to - size, low))) as taken
  from line join r on line.source is not distinct from r.source and low < line_to and high > line_to - size group by row)
select doc_id, size, source_size, round(target, 6) as target, cast(coalesce(taken, 0) as bigint) as taken, line.source as source, draw
from line join t on line.source is not distinct from t.source left join taken using (row)
"""


#: All cheapest ways are kept as strings, from the last row to the first, instead of distances and a walk.
OP11_SQL = r"""
with recursive bits(i, k, v) as (
  select i, 0, i from range(0, 256) as t(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by i) as c from bits where k = 8),
k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))), '..'),
                                                                 lambda x: cast('0x' || x as bigint))),
                         lambda a, x: xor(a >> 8, c[(xor(a, x) & 255) + 1])), 4294967295) % 20 as kind
  from conversations, crc),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as again
  from k),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, substr(text, 1, 256), md5(text)) as i from d),
f as (
  select *, substr(role, 1, 1) as initial, lag(role) over (partition by conv_id order by i) as before,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '' end as fault
  from p),
n as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
         count(*) filter (fault = 't') as truncated, count(*) filter (i > 1 and substr(before, 1, 1) || initial not in ('su', 'ua', 'au')) as illegal
  from f group by conv_id),
w(conv_id, i, b) as (
  select conv_id, n + 1, [{'cost': 0, 'audit': '', 'lines': ''}, {'cost': 6, 'audit': 'II', 'lines': chr(10) || 'user:' || chr(10) || 'assistant:'},
                          {'cost': 3, 'audit': 'I', 'lines': chr(10) || 'assistant:'}, {'cost': 0, 'audit': '', 'lines': ''}]
  from n
  union all
  select conv_id, i, [list_sort([base[1], put2])[1], list_sort([base[2], put2])[1], two, three]
  from (
    select *, {'cost': 3 + two['cost'], 'audit': 'I' || two['audit'], 'lines': chr(10) || 'user:' || two['lines']} as put2
    from (
      select *, list_sort([base[3], {'cost': 3 + base[4]['cost'], 'audit': 'I' || base[4]['audit'], 'lines': chr(10) || 'assistant:' || base[4]['lines']}])[1] as two,
             list_sort([base[4], {'cost': 3 + base[3]['cost'], 'audit': 'I' || base[3]['audit'], 'lines': chr(10) || 'user:' || base[3]['lines']}])[1] as three
      from (
        select conv_id, i, list_transform([1, 2, 3, 4], lambda s: list_sort(list_filter([
                 {'cost': 4 + b[s]['cost'], 'audit': 'D' || b[s]['audit'], 'lines': b[s]['lines']},
                 case when stays and (s = 1 and initial = 's') then {'cost': cut + b[2]['cost'], 'audit': 'K' || b[2]['audit'], 'lines': line || b[2]['lines']} end,
                 case when stays and s <> 3 and initial = 'u' then {'cost': cut + b[3]['cost'], 'audit': 'K' || b[3]['audit'], 'lines': line || b[3]['lines']} end,
                 case when stays and s = 3 and initial = 'a' then {'cost': cut + b[4]['cost'], 'audit': 'K' || b[4]['audit'], 'lines': line || b[4]['lines']} end,
                 case when stays and s <> 3 then {'cost': 3 + cut + b[3]['cost'], 'audit': 'R' || b[3]['audit'], 'lines': chr(10) || 'user:' || text || b[3]['lines']} end,
                 case when stays and s = 3 then {'cost': 3 + cut + b[4]['cost'], 'audit': 'R' || b[4]['audit'], 'lines': chr(10) || 'assistant:' || text || b[4]['lines']} end],
                 lambda o: o is not null))[1]) as base
        from (
          select w.conv_id, f.i, b, initial, text, chr(10) || role || ':' || text as line, fault not in ('b', 'd') as stays, case fault when 't' then 3 else 0 end as cut
          from w join f on w.conv_id is not distinct from f.conv_id and f.i = w.i - 1))))),
s as (select conv_id, b[1] as best from w where i = 1)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       cast(coalesce(best['cost'], 0) as bigint) as cost, coalesce(best['audit'], '') as audit, sha256(coalesce(substr(best['lines'], 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join n on n.conv_id is not distinct from o.conv_id left join s on s.conv_id is not distinct from o.conv_id
"""


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors["vec_id"] % 50 == 0, k=5, scale=256)


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_chunks(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256)).drop("kept_text")


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), N_SHARDS)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)
    return mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source", "draw")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokenizers(table(spark, sf_dir, "documents"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return approximate_topk(vectors, vectors["vec_id"] % 20 == 0, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_secrets,
        op2_toxicity,
        op3_decontamination,
        op4_ngram_join,
        op5_exact_topk,
        op6_chunk_dedup,
        op7_byte_shards,
        op8_source_mix,
        op9_suffix_dedup,
        op10_personal_data,
        op11_conversation_repair,
        op12_token_alignment,
        op13_nearest_neighbours,
    )
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": OP3_SQL,
        "op4_ngram_join": OP4_SQL,
        "op5_exact_topk": OP5_SQL,
        "op7_byte_shards": OP7_SQL,
        "op8_source_mix": OP8_SQL,
        "op11_conversation_repair": OP11_SQL,
    }
