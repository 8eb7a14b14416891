"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import ann_crosspolytope, chat_format, decontaminate, importance_resampling, line_dedup, mixing, prefix_trie, quality_fm, repeated_phrases, sharding, simhash_dedup, token_count, url_filter
from sievework.llm.common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokenizer_path(name: str) -> str:
    """A vocabulary file: in the folder SIEVEWORK_TOKENIZERS names, else with the installed public_tokenizers."""
    if folder := os.environ.get("SIEVEWORK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, meta = table(spark, sf_dir, "documents"), [quality_fm.length_class("n_chars")]
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"), meta=meta)
    scored = quality_fm.scored(docs.select("doc_id", "text", "n_chars"), model, meta=meta)
    return scored.select("doc_id", quality_fm.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: A conversation whose texts are control strings.
TRICKY = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.turns_of_table(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    record = json.dumps({"id": -1, "messages": [{"role": r, "content": TRICKY} for r in ("user", "assistant")]})
    more = chat_format.turns_of_json(spark.range(1).select(F.lit(record).alias("record")))
    chats = chat_format.format_chats(turns.unionByName(more.withColumn("conv_id", F.col("conv_id").cast("long"))))
    read, loss = chat_format.read_back(F.col("formatted")), chat_format.loss_text(F.col("segments"))
    out = chats.select("conv_id", "layout", "formatted", read.alias("read"), loss.alias("loss"))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


OP2_SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, 'turn_rows' as layout from conversations
  union all select -1, 0, 'user', '{TRICKY}', 'messages' union all select -1, 1, 'assistant', '{TRICKY}', 'messages'
), e as (
  select *, length(regexp_replace(text, '([<\[])(\\*){chat_format.TAILS}', '\1\\\2\3', 'g')) as chars,
    length(regexp_replace(role, '([<\[])(\\*){chat_format.TAILS}', '\1\\\2\3', 'g')) as role_chars from t
)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars + case role when 'user' then 22 when 'assistant' then 7 else 22 + role_chars end)::bigint as formatted_chars, any_value(layout) as layout
from e group by conv_id
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = rf"""
with l as (
  select doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)
), common as (select key from l where length(key) >= {line_dedup.MIN_CHARS} group by key having count(distinct doc_id) >= {line_dedup.MIN_DOCS})
select doc_id, count(*)::bigint as n_lines, (count(*) filter (c.key is not null))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (c.key is null), '')) as kept_sha256
from l left join common c on l.key = c.key group by doc_id
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
with d as (select doc_id, {WORDS_SQL} as w from documents),
b as (select item_id, {WORDS_SQL} as w, least(len(w), {decontaminate.WINDOW}) as n from benchmark),
windows as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as gram from b, unnest(range(1, len(w) - n + 2)) as u(i) where n > 0
), lengths as (select distinct n from windows), places as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as gram from d, lengths, unnest(range(1, len(w) - n + 2)) as u(i)
), found as (select distinct doc_id, i, n, item_id from places join windows using (n, gram)),
hits as (select doc_id, count(distinct j) as n_hit from found, unnest(range(i, i + n)) as u(j) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("copies")


OP5_SQL = rf"""
with d as (
  select doc_id, source, coalesce(text, '') as text, coalesce(cast(doc_id as varchar), '') as id, md5(coalesce(text, '')) as text_hash from documents
), k as (
  select doc_id, source, id, text_hash, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as size,
    -ln((('0x' || substr(md5(id || ':7:' || text_hash), 1, {mixing.UNIFORM_DIGITS}))::bigint + 1.0::double) / {float(16**mixing.UNIFORM_DIGITS)!r}::double)
      / greatest(0.05::double, (length(translate(text, '{mixing.NOISE}', '')) + 1.0::double) / (length(text) + 1.0::double)) as key
  from d
), s as (
  select source, sum(size)::bigint as source_size,
    [5.0::double, 2.0::double, 1.0::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as w
  from k group by source
), r as (
  select *, 2 * source_size as cap, row_number() over (order by 2 * source_size / w, source nulls last) as turn,
    sum(source_size) over () * 1.5::double as total
  from s
), l as (
  select *, (total - coalesce(sum(cap) over (order by turn rows between unbounded preceding and 1 preceding), 0)::double)
    / sum(w) over (order by turn rows between current row and unbounded following) as level
  from r
), t as (
  select source, source_size, least(cap::double, (select arg_min(level, turn) from l where level * w <= cap) * w) as target from l
), p as (
  select k.*, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs,
    sum(size) over (partition by k.source order by key, id, text_hash rows between unbounded preceding and current row)::double as upto
  from k join t on k.source is not distinct from t.source
)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
  ((epochs + case when target - epochs * source_size > 0 and upto - size / 2 <= target - epochs * source_size then 1 else 0 end) * size)::bigint as taken
from p
"""


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_crosspolytope.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), keep=["doc_id"])


def dated_lists(hosts: DataFrame) -> DataFrame:
    """Dated list entries made from the hosts of the pages: which hosts, and when, by the MD5 of the name.

    Two block lists name hosts and paths, taken off and put on again at different days; an allow list excepts some hosts.
    """
    h = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit(LISTS_START).cast("date"), n.cast("int"))
    entry = lambda name, polarity, kind, text, action, at: F.struct(F.lit(name).alias("list_name"), F.lit(polarity).alias("polarity"), F.lit(kind).alias("kind"), text.alias("entry"), F.lit(action).alias("action"), at.alias("at"))
    host, above = F.col("host"), F.array_join(F.slice(F.split("host", r"\."), -3, 3), ".")
    all_ = F.array(
        F.when(h % 3 == 0, entry("hosts", "block", "domain", host, "add", day(h % 200))),
        F.when(h % 6 == 0, entry("hosts", "block", "domain", host, "remove", day(h % 200 + 60))),
        F.when(h % 12 == 0, entry("hosts", "block", "domain", host, "add", day(h % 200 + 90))),
        F.when(h % 5 == 1, entry("paths", "block", "url", F.concat(host, F.lit("/en")), "add", day(h % 100))),
        F.when(h % 10 == 1, entry("paths", "block", "url", F.concat(host, F.lit("/en")), "remove", day(h % 100 + 120))),
        F.when(h % 7 == 2, entry("sites", "block", "domain", above, "add", day(h % 150 + 100))),
        F.when(h % 4 == 1, entry("trusted", "allow", "domain", host, "add", day(h % 250))),
    )
    return hosts.select(F.explode(F.filter(all_, lambda e: e.isNotNull())).alias("e")).select("e.*")


LISTS_START = "2024-01-01"


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures; the table has no fetch time, so a page's day is made from its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit(LISTS_START).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    found = url_filter.filter_captures(captures, dated_lists(hosts))
    return found.select("page_id", "url", "fetched", "host", F.size("matches").cast("long").alias("n_matches"), F.array_join("matches", ",").alias("matches"), "blocked")


OP10_SQL = rf"""
with p as (
  select page_id, url, date '{LISTS_START}' + cast(((page_id * 37) % 365 + 365) % 365 as integer) as fetched,
    regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') as rest from pages
), c as (
  select *, nullif(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?#]*')), '^.*@', ''), '\.?(:[0-9]*)?$', ''), '') as host,
    list_filter(string_split(regexp_replace(regexp_extract(rest, '^[^?#]*'), '^[^/]*', ''), '/'), lambda s: s <> '') as path from p
), h as (
  select host, array_to_string(string_split(host, '.')[-3:], '.') as site, ('0x' || substr(md5(host), 1, 4))::integer as h
  from (select distinct host from c where host is not null)
), e as (
  select 'hosts' as list_name, 'block' as polarity, 'd' as kind, host as entry, 1 as on_, h % 200 as d from h where h % 3 = 0
  union all select 'hosts', 'block', 'd', host, 0, h % 200 + 60 from h where h % 6 = 0
  union all select 'hosts', 'block', 'd', host, 1, h % 200 + 90 from h where h % 12 = 0
  union all select 'paths', 'block', 'u', host || '/en', 1, h % 100 from h where h % 5 = 1
  union all select 'paths', 'block', 'u', host || '/en', 0, h % 100 + 120 from h where h % 10 = 1
  union all select 'sites', 'block', 'd', site, 1, h % 150 + 100 from h where h % 7 = 2
  union all select 'trusted', 'allow', 'd', host, 1, h % 250 from h where h % 4 = 1
), k as (select *, date '{LISTS_START}' + cast(d as integer) as since from e),
asked as (
  select distinct page_id, url, fetched, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'd' || array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(0, len(path) + 1), lambda i: 'u' || array_to_string(list_concat([host], path[1:i]), '/')))) as key from c where host is not null
), last as (
  select page_id, url, fetched, list_name, polarity, kind, entry, arg_max(on_, (since, on_)) as on_
  from asked join k on asked.key = k.kind || k.entry and k.since <= fetched group by all
), m as (
  select page_id, url, fetched, count(*) as n_matches, string_agg(list_name || ' ' || polarity || ' ' || kind || ':' || entry, ',' order by list_name || ' ' || polarity || ' ' || kind || ':' || entry) as matches,
    bool_or(polarity = 'block') and not bool_or(polarity = 'allow') as blocked
  from last where on_ = 1 group by all
)
select c.page_id, c.url, c.fetched, c.host, coalesce(n_matches, 0)::bigint as n_matches, coalesce(matches, '') as matches, coalesce(blocked, false) as blocked
from c left join m on c.page_id is not distinct from m.page_id and c.url = m.url and c.fetched = m.fetched
"""


def crc32_sql(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes; DuckDB has no function for it."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)"
    of = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {of}), lambda c, b: {bits}), 4294967295)"


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_phrases.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (
  select doc_id, i, array_to_string(w[i:i + {repeated_phrases.WINDOW - 1}], ' ') as phrase from d, unnest(range(1, len(w) - {repeated_phrases.WINDOW - 2})) as u(i)
), f as (select *, row_number() over (partition by phrase order by doc_id nulls last, i) as place from p),
gone as (select distinct doc_id, unnest(range(i, i + {repeated_phrases.WINDOW})) as j from f where place > 1),
l as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as j from d),
k as (select doc_id, string_agg(word, ' ' order by j) as kept, count(*) as n from l anti join gone using (doc_id, j) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)
"""


#: Conversations that share a head, and what is left when its turns are counted.
SHARING, HEADS = 100, 6


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation with its first turns replaced by those of the first conversation of its hundred; one without turns as a row without digest."""
    head = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % HEADS
    convs = turns.select("conv").distinct()
    heads = turns.where(f"conv % {SHARING} = 0 and at < {HEADS}").withColumnRenamed("conv", "first")
    asked = convs.withColumns({"first": F.col("conv") - F.col("conv") % SHARING, "head": head("conv")})
    borrowed = asked.join(heads, "first").where("at <= head").select(*turns.columns)
    named = convs.select("conv", *(F.lit(None).cast(t).alias(c) for c, t in turns.dtypes if c != "conv"))
    return borrowed.unionByName(turns.where(F.col("at") > head("conv"))).unionByName(named)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(prefix_trie.turns_of(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.trie(rebuilt(turns)).drop("node", "parent")


OP12_SQL = f"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, digest) as pos, digest, length(coalesce(text, '')) as chars
  from (select *, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest from conversations where conv_id is not null)
), c as (select conv_id, ({crc32_sql("conv_id::varchar")}) % {HEADS} as head from (select distinct conv_id from t)),
b as (
  select c.conv_id, pos, digest, chars from c join t on t.conv_id = c.conv_id - c.conv_id % {SHARING} and pos <= head
  union all select conv_id, pos, digest, chars from t join c using (conv_id) where pos > head
), p as (
  select conv_id, row_number() over w as depth, string_agg(digest, '/') over w as node, chars, count(*) over (partition by conv_id) as n_turns from b window w as (partition by conv_id order by pos)
  union all select conv_id, 0, '', 0, (select count(*) from b where b.conv_id = c.conv_id) from c
), n as (
  select node, depth, regexp_replace(node, '/?[^/]*$', '') as parent, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = n_turns), '') as ends
  from p group by node, depth
), f as (select parent, count(*) as n_children from n where depth > 0 group by parent),
s as (
  select p.node, sum(case when f.n_children is null then 1 else 0 end) as n_leaves, sum((n.n_convs - 1) * n.chars) as saved
  from n left join f on f.parent = n.node join p on p.conv_id = n.conv_id and p.depth <= n.depth group by p.node
)
select n.conv_id, n.depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0)::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from n left join n as up on up.node = n.parent and n.depth > 0 left join f on f.parent = n.node join s on s.node = n.node
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


OP13_SQL = f"""
with d as (select doc_id, {WORDS_SQL} as w from documents), dw as (select doc_id, unnest(w) as word from d), tw as (select unnest({WORDS_SQL}) as word from benchmark),
v as (select word, ({crc32_sql("word")}) % {importance_resampling.BUCKETS} as bucket from (select word from dw union select word from tw)),
s as (select bucket, count(*) as n from dw join v using (word) group by bucket), t as (select bucket, count(*) as n from tw join v using (word) group by bucket),
g as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * ((select coalesce(sum(n), 0) from s) + {importance_resampling.BUCKETS}.0::double)
    / ((coalesce(s.n, 0) + 1.0::double) * ((select coalesce(sum(n), 0) from t) + {importance_resampling.BUCKETS}.0::double)))) as gain
  from s full join t using (bucket)
), m as (select doc_id, floor(sum(gain) / count(*))::bigint as weight from dw join v using (word) join g using (bucket) group by doc_id),
r as (
  select doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance_resampling.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
  from d left join m using (doc_id)
), k as (
  select *, row_number() over (partition by n_features >= {importance_resampling.MIN_WORDS} order by score desc, doc_id nulls last) as pos,
    {importance_resampling.PERCENT} * (count(*) filter (n_features >= {importance_resampling.MIN_WORDS}) over ()) // 100 as room from r
)
select doc_id, n_features, weight, score, case when n_features >= {importance_resampling.MIN_WORDS} and pos <= room then pos end as rank from k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_chat_format": op2_chat_format,
        "op3_line_dedup": op3_line_dedup,
        "op4_decontaminate": op4_decontaminate,
        "op5_mix_sources": op5_mix_sources,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_token_counts": op8_token_counts,
        "op9_sharding": op9_sharding,
        "op10_url_filter": op10_url_filter,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": OP2_SQL,
        "op3_line_dedup": OP3_SQL,
        "op4_decontaminate": OP4_SQL,
        "op5_mix_sources": OP5_SQL,
        "op10_url_filter": OP10_SQL,
        "op11_substring_dedup": OP11_SQL,
        "op12_prefix_trie": OP12_SQL,
        "op13_importance_resampling": OP13_SQL,
    }
