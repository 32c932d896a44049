"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import chat_format, decontaminate, html_extract, katz, mixing, periodic, pii, quality, secret_scan, sharding, simhash, toxicity, vector_codes
from riskloom.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "source", F.length(text).cast("long").alias("n_code_points"), F.sha2(text, 256).alias("text_sha256"), F.element_at(F.split("shard", "/"), -1).alias("shard"), "shard_rows", "shard_bytes", "shard_tier", "manifest_version")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = secret_scan.train(secret_scan.labelled_samples(spark))
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), ratios))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_clauses")


#: Both texts of the conversation that op11_chat adds.
SAID = "</s>[INST] ok [/INST]"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    more = spark.sql(f"select * from values (-7L, 0L, 'user', '{SAID}'), (-7L, 1L, 'assistant', '{SAID}') as t(conv_id, turn, role, text)")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digest(conversations, chat_format.windows(conversations))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors' codes, by codebooks of 256 entries for four parts after four rounds."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which a tenth is made periodic by their ids."""
    return periodic.digest(periodic.scan(table(spark, sf_dir, "documents"), periodic.planted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_sharding, op2_secrets, op3_katz, op4_quality, op5_html, op6_pii, op7_simhash, op8_mixing, op9_decontamination, op10_toxicity, op11_chat, op12_codes, op13_periodic)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIXING_SQL = f"""
with keyed as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
  coalesce('=' || source, 'null') as sk, coalesce('=' || cast(doc_id as varchar), 'null') as ik, coalesce(md5(text), 'null') as tie from documents),
sized as (select doc_id, source, size, cast('0x' || substr(md5(concat_ws(':', 'mix{mixing.SEED}', sk, ik, tie, row_number() over (partition by sk, ik, tie) - 1)), 1, 15) as bigint) as place from keyed),
totals as (select source, sum(size) as source_size from sized group by source),
ranked as (select *, (row_number() over (order by source is null, source) - 1) % 3 as k from totals),
weighed as (select source, source_size, case k when 0 then 5 when 1 then 2 else 1 end as weight, {mixing.MOST_REPEATS} * source_size as cap from ranked),
ordered as (select *, row_number() over (order by cast(cap as double) / weight, source is null, source) as nr from weighed),
summed as (select *, coalesce(sum(cap) over (order by nr rows between unbounded preceding and 1 preceding), 0) as caps_before,
  coalesce(sum(weight) over (order by nr rows between unbounded preceding and 1 preceding), 0) as weights_before, sum(source_size) over () as all_size from ordered),
capped as (select *, cast(cap as double) / weight <= cast(all_size - caps_before as double) / ((select sum(weight) from weighed) - weights_before) as is_full from summed),
level as (select cast(max(all_size) - coalesce(sum(case when is_full then cap end), 0) as double) / sum(case when is_full then 0 else weight end) as rate from capped),
goals as (select source, cast(source_size as bigint) as source_size, case when is_full then cast(cap as double) else weight * rate end as target from capped, level),
cut as (select *, coalesce(floor(target / nullif(source_size, 0)), 0) as passes, target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size as rest from goals),
running as (select s.doc_id, s.source, s.size, s.place, c.source_size, c.target, c.passes, c.rest,
  sum(s.size) over (partition by s.source order by s.place rows unbounded preceding) as upto from sized s join cut c on s.source is not distinct from c.source),
beyonds as (select *, count_if(upto > rest) over (partition by source order by place rows unbounded preceding) > 0 as beyond from running),
lacks as (select *, rest - max(case when beyond then 0 else upto end) over (partition by source) as lack from beyonds),
best as (select source, place, row_number() over (partition by source order by abs(size - lack), place) as nr from lacks where beyond and abs(size - lack) < lack)
select l.doc_id, l.size, l.source_size, l.target, cast(l.size * (l.passes + case when not l.beyond or b.nr is not null then 1 else 0 end) as bigint) as taken
from lacks l left join best b on b.nr = 1 and b.place = l.place and b.source is not distinct from l.source
"""

DECONTAMINATION_SQL = f"""
with doc_words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
item_words as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where item_id is not null),
items as (select item_id, least(len(w), {decontaminate.NGRAM_WORDS}) as n, unnest(generate_series(1, greatest(len(w) - {decontaminate.NGRAM_WORDS} + 1, 1))) as i, w from item_words where len(w) > 0),
windows as (select distinct cast(item_id as varchar) as item, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') as g from items),
lengths as (select distinct n from windows),
places as (select doc_id, n, unnest(generate_series(1, len(w) - n + 1)) as i, w from doc_words, lengths where len(w) >= n),
grams as (select doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') as g from places),
met as (select doc_id, i, grams.n, item from grams join windows using (g)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from met) group by 1),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from met) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hits using (doc_id) left join found using (doc_id)
"""


_REST = chat_format._REST
CHAT_SQL = f"""
with recursive src as (select conv_id, turn, role, text from conversations union all select -7, v[1], v[2], '{SAID}' from (values (row(0, 'user')), (row(1, 'assistant'))) t(v)),
turns as (select conv_id, coalesce(turn, -1) as turn, coalesce(role, '') as role, coalesce(text, '') as text,
  greatest(cast(floor(coalesce(turn, -1) / {chat_format.SEGMENT_TURNS}) as bigint), 0) as segment from src),
firsts as (select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) as nr from turns),
spread as (select f.conv_id, {chat_format.HEAD} as turn, f.role, f.text, s.segment from firsts f join (select distinct conv_id, segment from turns where segment > 0) s on s.conv_id is not distinct from f.conv_id where nr = 1 and f.role = 'system'),
shared as (select *, false as again from turns
  union all select conv_id, turn, role, text, segment + 1, true from turns where turn + 1 - (segment + 1) * {chat_format.SEGMENT_TURNS} > -{chat_format.HISTORY_TURNS}
  union all select *, true from spread),
markers as (select *, case role when 'system' then 5 when 'user' then 6 when 'assistant' then 7 else 13 + len(role) + len(role) - len(replace(role, chr(92), '')) + len(regexp_extract_all(role, '[<[]{_REST}')) end + 7
  + len(text) + len(text) - len(replace(text, chr(92), '')) + len(regexp_extract_all(text, '[<[]{_REST}')) as chars, len(regexp_extract_all(text, '{chat_format.TOKEN}')) + {chat_format.MARKER_TOKENS} as tokens from shared),
placed as (select *, row_number() over o - 1 as pos, sum(tokens) over o as after, sum(chars) over o as chars_after,
  first_value(role = 'system' and (turn = {chat_format.HEAD} or segment = 0)) over o as headed, first_value(tokens) over o as first_tokens, first_value(chars) over o as first_chars
  from markers window o as (partition by conv_id, segment order by turn, role, text rows unbounded preceding)),
backed as (select *, case when headed then first_tokens else 0 end as head_tokens, {" + ".join(f"coalesce(cast(pos - {k} >= cast(headed as int) and (after - tokens) - (lag(after - tokens, {k}) over o) <= least({chat_format.HISTORY_TOKENS}, {chat_format.BUDGET} - case when headed then first_tokens else 0 end - tokens) as int), 0)" for k in range(1, chat_format.HISTORY_TURNS + 1))} as back
  from placed window o as (partition by conv_id, segment order by pos)),
ready as (select b.*, case when b.pos = 0 then 0 else f.after - f.tokens - b.head_tokens end as own_base, f.chars_after - f.chars as from_chars
  from backed b join backed f on f.conv_id is not distinct from b.conv_id and f.segment = b.segment and f.pos = b.pos - b.back),
walk as (select conv_id, segment, pos, case when again then 0 else 1 end as nr, case when again then null else own_base end as base from ready where pos = 0
  union all select r.conv_id, r.segment, r.pos, w.nr + cast(opens as int), case when opens then r.own_base else w.base end
  from (select r.*, w.nr, w.base, not r.again and (w.base is null or r.after - w.base > {chat_format.BUDGET}) as opens, w.nr as wnr from walk w join ready r on r.conv_id is not distinct from w.conv_id and r.segment = w.segment and r.pos = w.pos + 1) r
  join walk w on w.conv_id is not distinct from r.conv_id and w.segment = r.segment and w.pos + 1 = r.pos),
spans as (select r.conv_id, r.segment, w.nr, arg_min(r.from_chars, r.pos) as from_chars, max(r.chars_after) as to_chars, min(r.pos) as own, any_value(r.headed) as headed, any_value(r.first_chars) as first_chars
  from ready r join walk w on w.conv_id is not distinct from r.conv_id and w.segment = r.segment and w.pos = r.pos where not r.again group by 1, 2, 3),
shown as (select conv_id, sum(to_chars - from_chars + case when headed and own > 0 then first_chars else 0 end) as chars, count(*) as n from spans group by 1)
select t.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(len(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(any_value(s.chars) as bigint) as formatted_chars, any_value(s.n) as n_windows
from turns t join shown s on s.conv_id is not distinct from t.conv_id group by 1
"""


def _codes_sql() -> str:
    parts, n = vector_codes.PARTS, vector_codes.ENTRIES
    most = "cast(power(2, (61 - cast(ceil(log2(greatest(w, 1))) as int)) // 2 - 1) as bigint)"
    apart = "list_dot_product(a.v, a.v) - 2 * list_dot_product(a.v, b.v) + list_dot_product(b.v, b.v)"
    steps = [
        "v as (select row_number() over () as id, vec_id, label, embedding as x from embeddings where embedding is not null and not list_contains(list_transform(embedding, lambda y: y is null or not isfinite(y)), true))",
        f"w as (select cast(ceil(max(len(x)) / {parts}.0) as bigint) as w from v)",
        f"cut as materialized (select id, vec_id, x, p, list_transform(range(p * w, p * w + w), lambda i: greatest(least(floor({vector_codes.SCALE} * coalesce(cast(x[i + 1] as double), 0)), {most}), -{most})) as v from v, w, range({parts}) r(p))",
        f"b0 as materialized (select p, nr - 1 as e, v from (select *, row_number() over (partition by p order by vec_id nulls last, x, id) as nr from cut) where nr <= {n})",
    ]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"n{k} as materialized (select a.id, a.p, any_value(a.v) as v, min(cast({apart} as bigint) * {n} + b.e) as m from cut a join b{k} b on a.p = b.p group by 1, 2)")
        steps.append(f"s{k} as (select p, e, list(y order by i) as v from (select p, m % {n} as e, i, floor(sum(v[i]) / count(*)) as y from n{k}, w, range(1, w + 1) r(i) group by 1, 2, 3) group by 1, 2)")
        steps.append(f"b{k + 1} as materialized (select b.p, b.e, coalesce(s.v, b.v) as v from b{k} b left join s{k} s on s.p = b.p and s.e = b.e)")
    k = vector_codes.ROUNDS
    steps.append(f"coded as (select id, string_agg(lower(printf('%02x', m % {n})), '' order by p) as code, cast(sum(m // {n}) as bigint) as error from n{k} group by 1)")
    steps.append(f"books as (select sha256(string_agg(t, ',' order by p, e)) as codebooks_sha256 from (select p, e, list_aggregate(list_transform(v, lambda y: cast(cast(y as bigint) as varchar)), 'string_agg', ',') as t from b{k}))")
    return f"with {', '.join(steps)} select v.vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from v join coded using (id), books"


def oracle_sql() -> dict[str, str]:
    """The rest is beyond DuckDB: XXH64, crc32, learned models, markup and files; those are tested in tests/llm."""
    return {"op8_mixing": MIXING_SQL, "op9_decontamination": DECONTAMINATION_SQL, "op11_chat": CHAT_SQL, "op12_codes": _codes_sql()}
