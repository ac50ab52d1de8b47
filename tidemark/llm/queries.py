"""The numbered queries, with production parameters, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, jaccard, langid, lines, packing, reputation, spans, suffix, variants, warc, whitening
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op2_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.dedup_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the first quarter of its tokens counts as a prompt, without loss."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), max_segments=16, max_loss=3328, prompt_share=0.25)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.LanguageModel.fit(docs.where("not held_out"))
    return model.predict(docs, keep=("doc_id", "held_out"))


def op6_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup_bytes(table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_line_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = lines.LineIndex.build(docs).apply(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_bitmap_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op9_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), most=16)
    parts = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part"))
    return parts.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error")


#: The rules of the query: each holds for its host with all subdomains and for paths that begin with its own.
URL_RULES = [reputation.Rule("allow", "com", "/"), reputation.Rule("block", "example.com", "/en/"), reputation.Rule("allow", "www.example.com", "/en/"), reputation.Rule("block", "net", "/es/"), reputation.Rule("block", "net", "/fr/")]


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, good): pages whose document is labelled. A page shows the document that its URL numbers; it is good if that is
    of quality and not toxic. Of several labels of a document all must be good."""
    labels = table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null")
    labels = labels.groupBy("doc_id").agg(F.every((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    number = F.try_to_number(F.regexp_extract(reputation.path_of(F.col("url")), "/([0-9]{1,18})", 1), F.lit("9" * 18)).cast("long")
    return table(spark, sf_dir, "pages").select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", "good")


def op12_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), URL_RULES)


def op13_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.variant_groups(variants.count_words(table(spark, sf_dir, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_chat_snapshots, op2_multiprobe_lsh, op3_sentence_spans, op4_vector_packing, op5_language_id, op6_suffix_buckets,
    op7_line_filters, op8_bitmap_tiles, op9_benchmark_windows, op10_warc_chunks, op11_embedding_whitening,
    op12_host_reputation, op13_permuterm_variants, pipeline)}

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORTH = """case when coalesce(sum(n * (n - 1.0) * m * (1 - m)), 0) = 0 then 10000.0
  when sum((k - n * m) * (k - n * m)) <= sum(n * m * (1 - m)) then 10000.0
  else least(10000.0, greatest(1.0, sum(n * (n - 1.0) * m * (1 - m)) / (sum((k - n * m) * (k - n * m)) - sum(n * m * (1 - m))) - 1)) end"""

ORACLE: dict[str, str] = {
    "op1_chat_snapshots": """
with t as (select distinct conv_id, turn, role, text from conversations),
conv as (select conv_id, count(*) as n_turns,
    string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by turn nulls first, role nulls first, text nulls first) as rendered
  from t group by conv_id),
numbered as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k,
    count(*) over (partition by conv_id) as n from t),
prefixes as (select a.conv_id, a.k, a.n, string_agg('<|im_start|>' || coalesce(b.role, 'unknown') || chr(10) || coalesce(b.text, '') || '<|im_end|>' || chr(10), '' order by b.k) as prefix
  from numbered a join numbered b on a.conv_id = b.conv_id and b.k <= a.k group by a.conv_id, a.k, a.n),
begun as (select distinct prefix from prefixes where k < n)
select min(c.conv_id) as conv_id, c.n_turns, count(*) as copies, c.rendered
from conv c where not exists (select 1 from begun b where b.prefix = c.rendered)
group by c.n_turns, c.rendered""",
    "op7_line_filters": f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents),
keyed as (select *, {_LOWER.format(f"trim(line, {_WHITE})")} as key from l),
over as (select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select d.doc_id, d.k, d.line, o.key is not null and d.doc_id <> o.keeper as gone from keyed d left join over o on o.key = d.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""",
    "op9_benchmark_windows": f"""
with d as (select doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as words from documents),
b as (select item_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as words from benchmark),
b1 as (select item_id, words, least(10, len(words)) as n from b where len(words) > 0),
bw as (select distinct item_id, n, array_to_string(words[i : i + n - 1], ' ') as gram from (select item_id, n, words, unnest(range(1, len(words) - n + 2)) as i from b1)),
lengths as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') as gram from (select doc_id, words, n, unnest(range(1, greatest(len(words) - n + 2, 1))) as i from d, lengths)),
hits as (select doc_id, i, dw.n, item_id from dw join bw on dw.gram = bw.gram and dw.n = bw.n),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(p.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
  sha256(coalesce(i.items, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from d left join places p using (doc_id) left join items i using (doc_id)""",
    "op8_bitmap_tiles": f"""
with recursive w as (select doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, unnest(case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
m as (select a, min(b) as b from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) as component_id
from documents d left join n using (doc_id) left join m on m.a = d.doc_id""",
    "op10_warc_chunks": """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as s from pages),
g as (select *, max(page_id) over (partition by s, strlen(h)) as keeper from p)
select page_id, strlen(h) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(s, cast(k // 4 * 5 + 1 as int), 5) as bigint) >> cast(15 - 5 * (k % 4) as bigint)) & 31 as int) + 1, 1)), '') as payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type, case when page_id <> keeper then keeper end as refers_to
from g""",
    "op6_suffix_buckets": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select doc_id, h, length(h) // 2 as n from d),
w as (select doc_id, s, md5(substr(h, 2 * s + 1, 400)) as m from (select doc_id, h, unnest(range(0, n - 199)) as s from n where n >= 200)),
o as (select doc_id, s, lag(s) over (partition by doc_id order by s) as p from w where m in (select m from w group by m having count(*) > 1)),
g as (select *, sum(case when p is null or s > p + 200 then 1 else 0 end) over (partition by doc_id order by s) as k from o),
r as (select doc_id, k, min(s) as a, max(s) + 200 as b from g group by 1, 2),
x as (select *, lag(b, 1, 0) over (partition by doc_id order by a) as q from r),
t as (select x.doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * q + 1, 2 * (a - q)), '' order by a) as pre, max(b) as last from x join n using (doc_id) group by 1)
select n.doc_id, n.n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(pre || substr(h, 2 * last + 1), h))) as kept_sha256
from n left join t using (doc_id)""",
    "op12_host_reputation": f"""
with p as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u as (select page_id, url, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
l as (select doc_id, bool_and(quality = 1 and coalesce(toxic, 0) = 0) as good from labels where doc_id is not null and quality is not null group by doc_id),
s as (select host, 0 as n, 0 as k from u union all
  select host, 1, cast(good as int) from u join l on l.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})', 1) as bigint)),
h as (select host, sum(n) as n, sum(k) as k, string_split(host, '.') as w, regexp_matches(host, '^[0-9.]*(:[0-9]+)?$') as num from s group by host),
h2 as (select *, array_to_string(w[-2:], '.') as two, array_to_string(w[-2:], '.') in ({", ".join(f"'{x}'" for x in reputation.TWO_LABELS)}) as long from h),
h3 as (select host, n, k, case when num then '' when long then two else w[-1] end as suffix, case when num then host when long then array_to_string(w[-3:], '.') else two end as domain from h2),
d as (select domain, max(suffix) as suffix, sum(n) as n, sum(k) as k from h3 group by domain),
f as (select suffix, sum(n) as n, sum(k) as k from d group by suffix),
f1 as (select *, (select (sum(k) + 1.0) / (sum(n) + 2.0) from d) as m from f),
fw as (select {_WORTH} as worth from f1),
f2 as (select suffix, (k + worth * m) / (n + worth) as sm from f1, fw),
d1 as (select d.*, sm as m from d join f2 using (suffix)),
dw as (select {_WORTH} as worth from d1),
d2 as (select domain, (k + worth * m) / (n + worth) as dm from d1, dw),
g1 as (select h3.*, dm as m from h3 join d2 using (domain)),
gw as (select case when sum(n) > 0 then {_WORTH} else 2.0 end as worth from g1),
g2 as (select host, n, worth, (k + worth * m) / (n + worth) as mean from g1, gw),
b as (select host from g2 where mean + 1.645 * sqrt(mean * (1 - mean) / (n + worth + 1)) < 0.5),
r(verdict, rh, rp) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (select page_id, url, host, path, max_by(rh || rp, length(rh || rp)) filter (where rh is not null) as rule, max_by(verdict, length(rh || rp)) as ruled
  from u left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id, url, host, path)
select page_id, host, path, rule, coalesce(ruled, case when host in (select host from b) then 'block' else 'allow' end) as verdict from m""",
    "op13_permuterm_variants": f"""
with recursive t as (select doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\u00C0-\u00FF]+')) as run from documents),
c as (select run, cast(doc_id as varchar) || ':' || run as s, count(*) as n from t where length(run) >= 7 group by doc_id, run),
x as (select run, n, hex(encode(s)) as x from c),
k as (select run, n, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(length(x)), lambda i: cast(instr('0123456789ABCDEF', substr(x, cast(case when i % 2 = 0 then i + 2 else i end as int), 1)) - 1 as bigint))),
  lambda a, b: xor([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][cast(xor(a, b) & 15 as int) + 1], a >> 4)), 4294967295) as h from x),
e as (select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, n from k),
w as (select word, cast(sum(n) as bigint) as n from e where length(word) >= 7 group by word having sum(n) >= 2),
g as (select word, substr(word, 1, cast(i - 1 as int)) as a, substr(word, cast(i + 1 as int)) as b from (select word, unnest(range(1, length(word) + 1)) as i from w)),
q as (select distinct word, a || b as short from g),
p as (select l.word, r.word as other from g l join g r on l.a || '*' || l.b = r.a || '*' || r.b and l.word <> r.word
  union select q.word, w.word from q join w on w.word = q.short union select w.word, q.word from q join w on w.word = q.short),
y as (select p.word, p.other, w.n, row_number() over (partition by p.word order by w.n desc, p.other) as place, count(*) over (partition by p.word) as n_near from p join w on w.word = p.other),
z as (select w.word, w.n, coalesce(y.n_near, 0) as n_near, case when y.n >= 10 * w.n then y.other end as form, case when y.n >= 10 * w.n then y.n end as form_n from w left join y on y.word = w.word and y.place = 1),
f(word, tip) as (select word, word from z union all select f.word, z.form from f join z on z.word = f.tip where z.form is not null)
select z.word, form, f.tip as root, n, n_near, form_n from z join f using (word) where not exists (select 1 from z o where o.word = f.tip and o.form is not null)""",
}
