"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statframe.llm import chat, codec, collocations, language, licences, merkle, quality, tokens, topk
from statframe.llm.common import read, ship
from statframe.llm.decontaminate import find_matches
from statframe.llm.jaccard import jaccard_components
from statframe.llm.line_dedup import dedup_lines
from statframe.llm.quality import held_out
from statframe.llm.signatures import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return register


# Fixed classes of characters, as the contracts state them.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1_SQL = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents),
keyed as (select doc_id, i, line, {LOWER.format("regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} as key from lines),
frequent as (select key, max(doc_id) as last from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select k.doc_id, count(*)::bigint as n_lines, count(*) filter (where f.last <> k.doc_id)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.last is null or f.last = k.doc_id), '')) as kept_sha256
from keyed k left join frequent f on f.key = k.key group by k.doc_id"""


@query("op1_line_dedup", OP1_SQL)
def _op1(spark, sf_dir):
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = rf"""
with d as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') as w from benchmark),
bw as (select item, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i, w from b where len(w) > 0),
windows as (select distinct item, size, array_to_string(w[i : i + size - 1], ' ') as gram from bw),
sizes as (select distinct size from windows),
dw as (select doc_id, size, unnest(range(1, len(w) - size + 2)) as i, w from d, sizes where len(w) >= size),
hits as (select g.doc_id, g.i, g.size, x.item from (select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as gram from dw) g
         join windows x on x.size = g.size and x.gram = g.gram),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""


@query("op4_decontaminate", OP4_SQL)
def _op4(spark, sf_dir):
    out = find_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op3_language")
def _op3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out = held_out("doc_id")
    model = language.train(docs, learn=~out)
    return language.predict(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_quality")
def _op5(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out = held_out("doc_id")
    model = quality.train(docs, read(spark, sf_dir, "labels"), learn=~out)
    return (quality.score(docs.select("doc_id", "text", out.alias("held_out")), model)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted")))


OP6_SQL = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
           and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
pairs as (select q.vec_id as query_id, c.vec_id, max(list_dot_product(q.x, c.x))::bigint as score from v q join v c
          on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.x) = len(c.x) group by 1, 2)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from pairs
qualify rank <= 5"""


@query("op6_top_k", OP6_SQL)
def _op6(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"), lambda id: id % 50 == 0)


@query("op7_token_counts")
def _op7(spark, sf_dir):
    return tokens.token_counts(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")


# Decoding gives back the text, so the digest of what was decoded is that of the text itself.
@query("op8_sentencepiece")
def _op8(spark, sf_dir):
    out = codec.decode(codec.encode(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


OP9_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 4 then [array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)]
                                         when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * o >= 85 * (p.n + q.n - o)),
reach as (select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join links l on l.x = r.y)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id from d left join n using (doc_id)
join (select x as doc_id, min(y) as component_id from reach group by x) c using (doc_id)"""


@query("op9_jaccard", OP9_SQL)
def _op9(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents"))


# formatted_chars depends on the windows' token budgets, which SQL cannot count: checked by brute force in the tests.
@query("op2_chat")
def _op2(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_windows(turns.unionByName(own)))


_NOTICES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licences.TEMPLATES.items()))
OP10_SQL = rf"""
with t as (select template, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') as w from (values {_NOTICES}) v(template, text)),
tg as (select distinct template, unnest([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) as g from t),
size as (select template, (select count(*) from tg where tg.template = t.template) as n, len(w) - 4 + (len(w) - 4) // 4 as reach from t),
d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5),
hits as (select p.doc_id, i, template, g from p join tg on tg.g = array_to_string(w[i : i + 4], ' ')),
found as (select a.doc_id, a.template, a.i, count(distinct b.g) as shared from hits a join size s using (template)
          join hits b on b.doc_id = a.doc_id and b.template = a.template and b.i >= a.i and b.i < a.i + s.reach group by 1, 2, 3),
best as (select doc_id, template, max(shared) / n as share from found join size using (template) group by doc_id, template, n),
kept as (select doc_id, string_agg(template || '=' || cast(round(share * 1000)::int as varchar), ',' order by template) as licenses, count(*) as n
         from best where share >= 0.8 group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_licenses, coalesce(licenses, '') as licenses from documents left join kept using (doc_id)"""


@query("op10_licenses", OP10_SQL)
def _op10(spark, sf_dir):
    out = licences.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    named = F.transform("licenses", lambda m: F.concat(m["template"], F.lit("="), F.round(m["share"] * 1000).cast("int").cast("string")))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(named, ",").alias("licenses"))


# crc32 is a fold over the digits, eight steps of one bit each; nodes climb one level a step, paths come down by way of the run's other nodes.
_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
OP11_SQL = f"""
with recursive d as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as r, dense_rank() over (order by source nulls first) - 1 as g
  from (select doc_id, source, {_LEAF.format("text")} as leaf, {_LEAF.format(LOWER.format("text"))} as lowered from documents)),
crc as (select doc_id, 4294967295 - list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint),
          lambda c, b: list_reduce([xor(c, b)] || range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))) as crc
        from (select distinct doc_id from documents where doc_id is not null)),
nodes as (select g, 0 as level, r, leaf as h, count(*) over (partition by g) as n from d
  union all select g, any_value(level) + 1, r // 16, sha256(string_agg(h, '' order by r)), (any_value(n) + 15) // 16 from nodes where n > 1 group by g, r // 16),
subroots as (select g, h from nodes where n = 1),
tops as (select 0 as level, g as r, h, count(*) over () as n from subroots
  union all select any_value(level) + 1, r // 16, sha256(string_agg(h, '' order by r)), (any_value(n) + 15) // 16 from tops where n > 1 group by r // 16),
under as (select g, r, 0 as level, r as at, n from nodes where level = 0
  union all select u.g, u.r, u.level + 1, u.at // 16, (u.n + 15) // 16 from under u where u.n > 1),
over as (select r as g, 0 as level, r as at, n from tops where level = 0
  union all select u.g, u.level + 1, u.at // 16, (u.n + 15) // 16 from over u where u.n > 1),
steps as (
  select u.g, u.r, u.level, coalesce(string_agg(o.h, '' order by o.r) filter (where o.r < u.at), '') as l, coalesce(string_agg(o.h, '' order by o.r) filter (where o.r > u.at), '') as t
  from under u join nodes o on o.g = u.g and o.level = u.level and o.r // 16 = u.at // 16 where u.n > 1 group by u.g, u.r, u.level
  union all
  select d.g, d.r, 1000 + u.level, coalesce(string_agg(o.h, '' order by o.r) filter (where o.r < u.at), ''), coalesce(string_agg(o.h, '' order by o.r) filter (where o.r > u.at), '')
  from d join over u on u.g = d.g join tops o on o.level = u.level and o.r // 16 = u.at // 16 where u.n > 1 group by d.g, d.r, u.level),
proofs as (select g, r, list(l order by level) as ls, list(t order by level) as ts, string_agg(l || t, '' order by level) as all_ from steps group by g, r),
start as (select d.*, s.h as subroot, (select h from tops where n = 1) as root, coalesce(all_, '') as all_, coalesce(ls, []) as ls, coalesce(ts, []) as ts,
            case when crc % 5 = 0 then lowered else leaf end as begin
          from d join subroots s using (g) left join proofs using (g, r) left join crc using (doc_id)),
folded as (select g, r, begin as h, ls, ts from start union all select g, r, sha256(ls[1] || h || ts[1]), ls[2:], ts[2:] from folded where len(ls) > 0)
select doc_id, leaf, subroot, root, sha256(all_) as proof_sha256, f.h as folded_root, f.h = root as verified
from start join folded f using (g, r) where len(f.ls) = 0"""


@query("op11_merkle", OP11_SQL)
def _op11(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = merkle.digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lowered])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, other)
    out = merkle.manifest(docs.withColumn("tampered", tampered), carry=["tampered"])
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return (out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


OP12_SQL = rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
words as (select lang, sum(len(w))::hugeint as n from p group by lang),
places as (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from p, (select unnest(range(1, 6)) as m) where len(w) >= m),
f as (select lang, m, phrase, count(*)::hugeint as f from (select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase from places) group by all having count(*) >= 100),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m > 1),
cuts as (select c.lang, c.phrase, c.a, k, l.f as l, r.f as r, n, 1000 * a * n // (l.f * r.f) as score
         from (select *, unnest(range(1, m)) as k from c) c join f l on l.lang = c.lang and l.phrase = array_to_string(w[1:k], ' ')
         join f r on r.lang = c.lang and r.phrase = array_to_string(w[k + 1:], ' ') join words on words.lang = c.lang),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, array_to_string(w[i : i + s - 1], ' ') as phrase, max(a) as longer
           from (select *, unnest(range(1, m - s + 2)) as i from (select *, unnest(range(2, m)) as s from c)) group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r,
       n::bigint as n, score::bigint as score
from best left join inside using (lang, phrase) where longer is null or 100 * longer < 100 * a qualify rank <= 2000"""


@query("op12_collocations", OP12_SQL)
def _op12(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"))


_NEAR_SQL = OP9_SQL.replace("100 * o >= 85 *", "100 * o >= 80 *")
OP13_SQL = f"select doc_id, n_shingles, component_id, doc_id = component_id as kept from ({_NEAR_SQL})"


@query("op13_minhash", OP13_SQL)
def _op13(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))
