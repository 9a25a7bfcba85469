"""The registered queries of the operators in this package, over their whole tables, and SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.bm25_search import bm25_top_k
from varve.llm.decontaminate import contamination
from varve.llm.dual_tree_search import dual_tree_top_k
from varve.llm.fill_middle import fill_in_middle, restore_middle
from varve.llm.html_text import extract_main_text
from varve.llm.langid import fit_languages, identify_language
from varve.llm.license_scan import fit_licences, scan_licences
from varve.llm.mixing import mix_sources
from varve.llm.near_dedup import near_duplicate_groups
from varve.llm.sharding import shard_documents
from varve.llm.substring_dedup import substring_dedup
from varve.llm.tool_calls import SCHEMAS, as_tool_messages, link_tool_calls
from varve.llm.warc import page_id_of, page_records, read_warc, write_warc
from varve.session import stage_root

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        Q[function.__name__] = function
        if sql is not None:
            O[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: ASCII capitals to small letters, as `lower` would change other letters too.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_TOKENS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


@query("""
with c as (select distinct * from conversations),
u as (select conv_id, turn, text, 'c' || conv_id || '-' || turn call_id, len(string_split(text, ' ')) words, case when turn > 1 then 'c' || conv_id || '-' || (turn - 2) end after_id from c where role = 'user'),
a as (select conv_id, turn, text, 'c' || conv_id || '-' || (turn - 1) call_id from c where role = 'assistant'),
e as (select u.*, a.text result, a.call_id is not null answered,
   list_filter([case when length(u.text) > 400 then 'question: against max_length' end, case when words > 60 then 'words: against maximum' end,
     case when after_id is not null and not exists (select 1 from u p where p.call_id = u.after_id) then after_id || ': no such call' end], lambda x: x is not null) errors,
   row_number() over (partition by u.conv_id order by u.turn) - 1 step from u left join a on a.call_id = u.call_id and a.conv_id = u.conv_id)
select conv_id, call_id, turn, case when turn > 1 then 'follow_up' else 'lookup' end as name, step::bigint step, case when answered then 'answered' else 'unanswered' end status, len(errors)::int n_errors,
  '{"arguments":{' || case when after_id is not null then '"after":"' || after_id || '",' else '' end || '"question":' || to_json(text)::varchar || ',"words":' || words || '},"call_id":"' || call_id || '","conv_id":' || conv_id
  || ',"errors":' || to_json(errors)::varchar || ',"name":"' || case when turn > 1 then 'follow_up' else 'lookup' end || '"' || case when answered then ',"result":' || to_json(result)::varchar else '' end
  || ',"status":"' || case when answered then 'answered' else 'unanswered' end || '","step":' || step || ',"turn":' || turn || '}' line
from e
union all
select conv_id, call_id, turn, null, null, 'orphan_result', 0, '{"call_id":"' || call_id || '","conv_id":' || conv_id || ',"errors":[],"result":' || to_json(text)::varchar || ',"status":"orphan_result","turn":' || turn || '}'
from a where not exists (select 1 from u where u.call_id = a.call_id)
""")
def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_tool_calls(as_tool_messages(table(spark, sf_dir, "conversations")), SCHEMAS)
    return out.select("conv_id", "call_id", "turn", "name", "step", "status", F.size("errors").alias("n_errors"), "line")


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    model = fit_languages(docs.where(~held_out))
    out = identify_language(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query(f"""
with recursive w as (select doc_id, regexp_extract_all({_FOLD}, {_WORDS}) l from documents),
s as (select doc_id, case when len(l) >= 4 then list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' ')))
  when len(l) > 0 then [array_to_string(l, ' ')] else [] end l from w),
g as (select l, min(doc_id) id from (select doc_id, list_sort(l) l from s) where len(l) > 0 group by l),
u as (select id, len(l) n, unnest(l) sh from g),
p as (select a.id a, b.id b from u a join u b on a.sh = b.sh and a.id < b.id group by a.id, b.id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e as (select a, b from p union select b, a from p),
r as (select id, id as other from g union select r.id, e.b from r join e on r.other = e.a),
c as (select id, min(other) component_id from r group by id)
select s.doc_id, len(s.l)::bigint n_shingles, coalesce(c.component_id, s.doc_id) component_id, s.doc_id = coalesce(c.component_id, s.doc_id) kept
from s left join g on list_sort(s.l) = g.l left join c on c.id = g.id
""")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


@query(f"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::bigint size, md5(concat_ws('|', '42', 'mix', doc_id::varchar)) h from documents),
s0 as (select source, sum(size)::bigint source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) pos from s0),
s2 as (select *, [5.0, 2.0, 1.0][(pos - 1) % 3 + 1]::double w, 3.0::double * source_size cap from s1),
s3 as (select *, cap * (sum(w) over () - coalesce(sum(w) over o, 0)) <= w * (sum(source_size) over () - coalesce(sum(cap) over o, 0)) as filled
  from s2 window o as (order by cap / w, pos rows between unbounded preceding and 1 preceding)),
s4 as (select *, case when filled then cap else w * (sum(source_size) over () - sum(case when filled then cap else 0 end) over ()) / sum(case when filled then 0 else w end) over () end target from s3),
s5 as (select *, case when source_size > 0 then greatest(1, floor(source_size / 32 + 0.5))::bigint else 0 end blocks from s4),
s6 as (select *, case when source_size > 0 then target * blocks / source_size else 0 end v from s5),
seats as (select floor(sum(v) + 0.5)::bigint n from s6),
offers as (select pos, v, unnest(range(0, 3 * blocks)) j from s6),
won as (select pos, count(*) quota from (select pos, row_number() over (order by v / (2 * j + 1) desc, pos, j) k from offers) where k <= (select n from seats) group by pos),
s7 as (select s6.*, coalesce(quota, 0) quota, case when blocks > 0 then ('0x' || substr(md5(concat_ws('|', '42', 'run', source)), 1, 8))::bigint % blocks else 0 end b0 from s6 left join won using (pos)),
s8 as (select *, case when blocks > 0 then quota // blocks else 0 end passes, case when blocks > 0 then b0 + quota % blocks else 0 end b1 from s7),
s9 as (select *, case when blocks > 0 then b0 * source_size // blocks else 0 end f1, case when blocks > 0 then least(b1, blocks) * source_size // blocks else 0 end t1,
  case when b1 > blocks then (b1 - blocks) * source_size // blocks else 0 end t2 from s8),
p as (select *, coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) a from d)
select p.doc_id, p.size, s9.source_size, s9.target,
  (passes * p.size + greatest(0, least(a + p.size, t1) - greatest(a, f1)) + greatest(0, least(a + p.size, t2) - a))::bigint taken
from p join s9 on p.source is not distinct from s9.source
""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(f"""
with w as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) l from documents),
s as (select r, i, array_to_string(l[i:i + 34], ' ') k from (select r, l, unnest(range(1, len(l) - 33)) i from w)),
rep as (select k from s group by k having count(*) > 1),
hit as (select r, i from s semi join rep using (k)),
words as (select r, doc_id, unnest(l) word, unnest(range(1, len(l) + 1)) i from w),
m as (select words.*, max(hit.i) over (partition by words.r order by words.i rows between 34 preceding and current row) is not null gone from words left join hit on hit.r = words.r and hit.i = words.i),
o as (select r, count(*) filter (gone) n_removed, coalesce(string_agg(word, ' ' order by i) filter (not gone), '') kept from m group by r)
select w.doc_id, len(w.l)::bigint n_words, coalesce(o.n_removed, 0)::bigint n_removed, sha256(coalesce(o.kept, '')) kept_sha256 from w left join o using (r)
""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), width=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query(f"""
with i as (select item_id, regexp_extract_all({_FOLD}, {_TOKENS}) l from benchmark),
iw as (select distinct item_id, least(10, len(l)) n, array_to_string(l[k:k + least(10, len(l)) - 1], ' ') s
  from (select item_id, l, unnest(range(1, greatest(len(l) - 9, 1) + 1)) k from i where len(l) > 0)),
d as (select row_number() over () r, doc_id, regexp_extract_all({_FOLD}, {_TOKENS}) l from documents),
dw as (select r, k, n, array_to_string(l[k:k + n - 1], ' ') s from (select r, l, n, unnest(range(1, len(l) - n + 2)) k from d cross join (select distinct n from iw))),
occ as (select dw.r, dw.k, dw.n, iw.item_id from dw join iw on dw.n = iw.n and dw.s = iw.s),
hit as (select r, count(distinct w) n_hit from (select r, unnest(range(k, k + n)) w from occ) group by r),
it as (select r, count(distinct item_id) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct r, item_id from occ) group by r)
select d.doc_id, len(d.l)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (r) left join it using (r)
""")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"), width=10)
    listed = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_crc32", F.coalesce(F.crc32("text"), F.lit(0)))
    out = shard_documents(docs, shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licences(docs, fit_licences(docs))


@query(f"""
with w as (select doc_id, regexp_extract_all({_FOLD}, {_TOKENS}) l from documents),
t as (select doc_id, unnest(l) term from w),
tf as (select doc_id, term, count(*)::double tf from t group by doc_id, term),
df as (select term, count(*)::double df from tf group by term),
st as (select count(*)::double n, avg(len(l)) m from w),
s as (select q.doc_id query_id, d.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len(w.l) / m))) score
  from tf q join tf d using (term) join df using (term) join w on w.doc_id = d.doc_id cross join st where q.doc_id % 100 = 0 group by q.doc_id, d.doc_id),
r as (select query_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id)::int as rank, doc_id, round(score, 6) score from s)
select * from r where rank <= 10
""")
def op10_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25_top_k(docs, docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), k=10).withColumn("score", F.round("score", 6))


@query("""
with p as (select page_id, coalesce(html, '') payload from pages),
d as (select *, octet_length(encode(payload))::bigint payload_bytes, sha1(payload) h, min(page_id) over (partition by payload) first_id from p),
b as (select *, list_aggregate(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', h[i])]), 'string_agg', '') bits from d)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: bits[5 * i + j]::int * (32 >> j)))::int, 1)), 'string_agg', '') payload_digest,
  case when page_id is not distinct from first_id then 'response' else 'revisit' end record_type, case when page_id is distinct from first_id then first_id end refers_to
from b
""")
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{stage_root(spark)}/{uuid.uuid4().hex}"
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    columns = "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long"
    back = read_warc(spark, path, columns, verify="true").where(F.col("record_type").isin("response", "revisit"))
    return back.select(
        page_id_of("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page_id_of("refers_to").alias("refers_to")
    )


@query(f"""
with w as (select row_number() over () r, doc_id, regexp_extract_all({_FOLD}, {_TERMS}) l from documents),
st as (select count(*)::bigint n, sum(len(l))::bigint l from w where len(l) > 0),
tf as (select r, term, count(*)::bigint tf from (select r, unnest(l) term from w) group by r, term),
df as (select term, count(*)::bigint df from tf group by term),
q as (select item_id, term, count(*)::bigint times from (select item_id, unnest(regexp_extract_all({_FOLD}, {_TERMS})) term from benchmark) group by item_id, term),
qw as (select item_id, q.term, times * floor(1000 * ln((2 * st.n + 2)::double / (2 * df + 1)::double))::bigint w from q join df using (term) cross join st),
m as (select r, doc_id, (100 - 75 + ((75 * len(w.l)::bigint * st.n) // st.l))::bigint m from w cross join st where len(w.l) > 0),
s as (select item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from qw join tf using (term) join m using (r) group by item_id, r),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s join m using (r) where score > 0)
select * from k where rank <= 10
""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree_top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("""
with d as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(doc_id::varchar, '')) h from documents),
g as (select doc_id, t, length(t) n, ('0x' || substr(h, 1, 8))::bigint % (length(t) + 1) c1, ('0x' || substr(h, 9, 8))::bigint % (length(t) + 1) c2,
  ('0x' || substr(h, 17, 8))::bigint % 100 h3, ('0x' || substr(h, 25, 8))::bigint % 100 h4 from d),
f as (select *, least(c1, c2) a, greatest(c1, c2) b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain' when h4 < 20 then 'spm' else 'psm' end form from g),
p as (select *, substr(t, 1, a) prefix, substr(t, a + 1, b - a) middle, substr(t, b + 1) suffix from f)
select doc_id, n::bigint n, form, case when form <> 'plain' then a end::bigint prefix_chars, case when form <> 'plain' then b - a end::bigint middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) output_sha256,
  sha256(t) restored_sha256
from p
""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = restore_middle(fill_in_middle(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
