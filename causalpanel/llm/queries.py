"""The registered queries of this subpackage, each a thin digest of its operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitpack, chat, digests, linededup, mixing, mtree, packing, quality, sharding, simhash, toxicity

WORD = r"[^\x20\x09-\x0D]+"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Each query is its operator over the whole table: nulls, empty and long texts, repeats, empty tables and
# further columns are as the operator's docstring says.


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mixing.mix`` of all documents; a row per row."""
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = rf"""
with d as (
  select doc_id, source is null as nul, coalesce(source, '') as src,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as key
  from documents),
s as (select nul, src, sum(size)::bigint as source_size from d group by all),
w as (select *, [5.0, 2.0, 1.0][(row_number() over (order by nul, src) - 1) % 3 + 1]::double as w from s),
c as (select *, source_size * 2.0::double as cap from w),
r as (
  select *, (sum(source_size) over () * 1.5::double
             - coalesce(sum(cap) over (order by cap / w, nul, src rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (order by cap / w, nul, src rows between current row and unbounded following) as rate
  from c),
f as (select *, rate >= cap / w as is_full from r),
t as (
  select nul, src, source_size,
         case when is_full then cap else w * max(case when not is_full then rate end) over () end as target
  from f),
p as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as budget,
         coalesce(sum(d.size) over (partition by d.nul, d.src order by d.key, d.doc_id, d.size
                                    rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join t using (nul, src)),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from p)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::bigint as taken
from e
"""


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``linededup.drop_recurring_lines`` of all documents; a row per row, null texts stay null."""
    return linededup.drop_recurring_lines(_documents(spark, sf_dir).select("doc_id", "text"), counted=("n_lines", "n_dropped"))


OP2_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, text, string_split(text, chr(10)) as lines from documents),
l as (select rid, doc_id, unnest(lines) as line, unnest(range(len(lines))) as no from d),
t as (
  select rid, doc_id, no, regexp_extract_all(line, '{WORD}') as raw,
         list_transform(regexp_extract_all(line, '{WORD}'),
                        lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as toks
  from l where len(regexp_extract_all(line, '{WORD}')) > 0),
k as (
  select toks, count(distinct rid)::bigint as docs, min((doc_id, rid, no)) as first from t group by toks),
p as (
  select toks, docs, len(toks) as n, toks[1:3] as path, unnest(toks) as tok, unnest(range(len(toks))) as pos from k),
f as (select n, path, pos, tok, sum(docs) >= 10 and tok <> '<*>' as constant from p group by n, path, pos, tok),
m as (
  select p.toks, p.n, p.path, list(case when constant then tok else '<*>' end order by pos) as template,
         count(*) filter (not constant) as var
  from p join f using (n, path, pos, tok) group by p.toks, p.n, p.path),
o as (
  select n, path, template, min(first) as kept
  from m join k using (toks) group by n, path, template having sum(docs) >= 10 and n - any_value(var) >= 0.5 * n),
g as (select m.toks, o.kept from m join o using (n, path, template)),
v as (
  select raw, min((doc_id, rid, no)) as kept from t where len(raw) > 3
  group by raw having count(distinct rid) >= case when len(raw) > 50 then 2 else 3 end),
z as (
  select t.rid, t.no from t join g using (toks) where (t.doc_id, t.rid, t.no) <> g.kept
  union select t.rid, t.no from t join v using (raw) where (t.doc_id, t.rid, t.no) <> v.kept),
x as (select rid, list(no) as gone from z group by rid)
select doc_id,
       case when gone is null then text
            else coalesce(array_to_string([lines[i + 1] for i in range(len(lines)) if not list_contains(gone, i)], chr(10)), '') end as text,
       coalesce(len(lines), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_dropped
from d left join x using (rid)
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``simhash.near_duplicates`` of all documents; a row per row, texts without words share the zero print."""
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", "fingerprint", "component_id")


_BITS = " | ".join(f"((2 * sum((h >> {b}) & 1) > count(*))::ubigint << {b})" for b in range(64))
OP3_SQL = rf"""
with recursive d as (
  select row_number() over () as rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) as w
  from documents),
g as (
  select rid, array_to_string(w[i:i + 3], ' ') as s
  from (select rid, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) as i from d)),
{digests.xxh64_sql("g")},
f as (select rid, {_BITS} as print from g join hashed using (s) group by rid),
p as (select doc_id, coalesce(print, 0::ubigint) as print from d left join f using (rid)),
u as (select print, min(doc_id) as least_id from p group by print),
e as (select a.print, b.print as other from u a join u b on a.print <> b.print and bit_count(xor(a.print, b.print)) <= 4),
c as (select print, print as other from u union select c.print, e.other from c join e on c.other = e.print),
m as (select c.print, min(least_id) as component_id from c join u on c.other = u.print group by c.print)
select doc_id, format('{{:016x}}', print) as fingerprint, component_id from p join m using (print)
"""


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chat.link`` of all conversations, whose turns of users and assistants are calls and results; a row per turn."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = chat.exchanges(chat.events(messages))
    return chat.link(found, chat.EXCHANGE).select("conv_id", "turn", "kind", "call_id", "status", "faults", "position", "json")


OP4_SQL = """
with e as (
  select conv_id, turn, role, text,
         case role when 'user' then 'call' when 'assistant' then 'result' else 'message' end as kind,
         case role when 'user' then conv_id || ':' || turn when 'assistant' then conv_id || ':' || (turn - 1) end as call_id
  from conversations),
c as (select distinct conv_id, call_id from e where kind = 'call'),
r as (select distinct conv_id, call_id from e where kind = 'result'),
s as (
  select e.*, case kind when 'call' then case when r.call_id is not null then 'answered' else 'unanswered' end
                        when 'result' then case when c.call_id is not null then 'linked' else 'orphan' end
                        else 'message' end as status
  from e left join c using (conv_id, call_id) left join r using (conv_id, call_id)),
o as (select *, row_number() over (partition by conv_id order by case status when 'linked' then turn - 1 else turn end, call_id nulls first, kind) - 1 as position from s)
select conv_id, turn, kind, call_id, status, '' as faults, position,
       case kind
         when 'call' then '{"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"call_id":' || to_json(call_id) || ',"name":"answer","role":"user"}'
         when 'result' then '{"call_id":' || to_json(call_id) || ',"content":' || to_json(text) || ',"role":"assistant"}'
         else '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' end as json
from o
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``toxicity.score`` of all documents by the model of ``toxicity.train``; a row per row, empty texts score 0."""
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packing.pack`` of all documents; a row per piece, documents without words have one without a bin."""
    return packing.pack(_documents(spark, sf_dir))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality.judge`` of all documents, their sources the hosts; a row per row."""
    return quality.judge(_documents(spark, sf_dir))


OP7_SQL = rf"""
with d as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as text,
         coalesce(regexp_extract_all(text, '{WORD}'), []) as w
  from documents),
g as (
  select rid, i, w[i:i + 4] as g from (select rid, w, unnest(range(1, len(w) - 3)) as i from d)),
c as (select rid, i, count(*) over (partition by rid, g) as n from g),
rep as (select rid, count(distinct i + k)::bigint as n from c, (select unnest(range(5)) as k) where n >= 2 group by rid),
l as (
  select rid, (count(*) - count(distinct line))::bigint as n
  from (select rid, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
m as (
  select doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         coalesce(l.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
         len(w) < 10 or 100 * coalesce(rep.n, 0) > 20 * len(w) as base_failed
  from d left join rep using (rid) left join l using (rid)),
h as (
  select source, rule, count(*)::double as n, count(*) filter (broken)::double as k
  from (select source, unnest(['few_words', 'repeats', 'symbols', 'dup_lines']) as rule,
               unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words, 100 * n_symbols > 10 * word_chars, 100 * n_dup_lines > 5 * n_words]) as broken
        from m where source is not null) group by 1, 2),
f as (
  select rule, sum(k) / sum(n) as p, count(*) - 1 as free, sum(n) - sum(n * n) / sum(n) - count(*) + 1 as room,
         sum(k * k / n) - (sum(k) / sum(n)) ** 2 * sum(n) as s from h group by 1),
y as (select *, (s / nullif(p * (1 - p), 0) - free) / nullif(room, 0) as beyond from f),
w as (select rule, p, greatest(1.0, least(1000.0, case when room > 0 and beyond > 1e-9 then 1 / beyond - 1 else 1000.0 end)) as w from y),
r as (select source, n, p, w, (k + p * w) / (n + w) as rate from h join w using (rule)),
b as (select distinct source, true as bad from r where rate - 2 * sqrt(rate * (1 - rate) / (n + w + 1)) > greatest(p, 0.5))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(bad, false) as host_failed, not base_failed and not coalesce(bad, false) as kept
from m left join b using (source)
"""


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sharding.shard`` of all documents into 16; a row per row."""
    return sharding.shard(_documents(spark, sf_dir))


OP8_SQL = f"""
with d as (select doc_id, text, octet_length(encode(coalesce(text, ''))) + 1 as size from documents),
{digests.crc32_sql("d")},
r as (
  select *, row_number() over by_key as rank, sum(size) over by_key - size as before, sum(size) over () as total
  from summed window by_key as (order by crc, doc_id nulls first rows unbounded preceding)),
p as (select *, ((2 * before + size) * {sharding.SHARDS} // (2 * total))::int as shard from r)
select doc_id, size::bigint as size, crc as text_crc32, 'bytes' as law, shard,
       (rank - min(rank) over (partition by shard))::bigint as slot, null::int as grown_shard
from p
"""


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mtree.top_k`` of all embeddings: five rows per query, or fewer if there are no more others."""
    return mtree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bitpack.token_files`` of all documents, read back; a row per row."""
    import public_tokenizers

    described = bitpack.token_files(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return described.select("doc_id", "start", "n_tokens", "ids_crc32")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``corpus_pipeline.run``: the rows of its last stage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": op1_mix,
        "op2_line_templates": op2_line_templates,
        "op3_simhash": op3_simhash,
        "op4_tool_calls": op4_tool_calls,
        "op5_toxicity": op5_toxicity,
        "op6_packing": op6_packing,
        "op7_host_rules": op7_host_rules,
        "op8_shards": op8_shards,
        "op9_top_k": op9_top_k,
        "pipeline": pipeline,
        "op10_token_files": op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": OP1_SQL, "op2_line_templates": OP2_SQL, "op3_simhash": OP3_SQL, "op4_tool_calls": OP4_SQL, "op7_host_rules": OP7_SQL, "op8_shards": OP8_SQL, "op9_top_k": OP9_SQL}
