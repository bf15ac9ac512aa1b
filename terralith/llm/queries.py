"""The registered queries of the text operators: thin callers that give each contract's columns."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprints, importance, jaccard, language, lines, mixing, neighbours, packing, substrings, toxicity, url_rules, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ALIGNED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read(spark, sf_dir)).select("doc_id", "class_id", "copy_of", "n_links", "n_text_links")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir).select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"), 5, 0)
    net = language.fit(docs.filter(~out))
    return language.classify(docs.select("doc_id", "text", out.alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(read(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(read(spark, sf_dir)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir).select("doc_id", "text")
    out = language.held_out(F.col("doc_id"), 3, 1)
    labels = read(spark, sf_dir, "labels").filter(~out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.fit(docs.join(labels, "doc_id"))
    return toxicity.score(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted", "matches")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(read(spark, sf_dir)))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve(warc.records_of_pages(read(spark, sf_dir, "pages"))))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(read(spark, sf_dir).select("doc_id", "text")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir), TOKENIZER))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir), *ALIGNED)


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_fingerprints": op3_fingerprints,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_url_filters": op12_url_filters,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"

JACCARD_SQL = f"""
with recursive w as (select doc_id, coalesce(text, '') as text, {WORDS_SQL} as ws from documents),
texts as (select text, any_value(ws) as ws, min(doc_id) as least, count(*) as copies from w where len(ws) > 0 group by text),
sh as (select distinct least, case when len(ws) >= 5 then array_to_string(ws[i:i + 4], ' ') else array_to_string(ws, ' ') end as s from (select *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from texts)),
n as (select least, count(*) as n from sh group by least),
common as (select a.least as a, b.least as b, count(*) as c from sh a join sh b on a.s = b.s and a.least <> b.least group by 1, 2),
links as (select a, b from common join n x on x.least = a join n y on y.least = b where c >= 0.8e0 * (x.n + y.n - c) - 1e-9),
reach as (select least as a, least as b from texts union select r.a, l.b from reach r join links l on l.a = r.b),
class as (select a, min(b) as class_id from reach group by a),
counted as (select a, sum(t.copies) as docs, count(*) as texts from links join texts t on t.least = b group by a)
select w.doc_id, coalesce(c.class_id, w.doc_id) as class_id, coalesce(t.least, w.doc_id) as copy_of, cast(coalesce(k.docs, 0) + coalesce(t.copies - 1, 0) as bigint) as n_links, coalesce(k.texts, 0) as n_text_links
from w left join texts t on t.text = w.text left join class c on c.a = t.least left join counted k on k.a = t.least
"""

SUBSTRING_SQL = f"""
with w as (select doc_id, {WORDS_SQL} as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as k from (select *, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)),
least as (select k, min(doc_id) as first_doc from win group by k),
gone as (select doc_id, list(distinct p) as ps from (select win.doc_id, unnest(range(i, i + 50)) as p from win join least using (k) where win.doc_id > first_doc) group by doc_id),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
kept as (select words.doc_id, string_agg(word, ' ' order by p) as kept from words left join (select doc_id, unnest(ps) as p from gone) g using (doc_id, p) where g.p is null group by words.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join gone using (doc_id) left join kept using (doc_id)
"""

# blank lines carry no number; a line goes if it is in a pair of lines that stands somewhere before, or has 60 characters and stands somewhere before itself
LINES_SQL = """
with raw as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null),
full_lines as (select doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as t from raw where trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
numbered as (select *, row_number() over (partition by doc_id order by pos) as n from full_lines),
pairs as (select doc_id, n, md5(t || chr(10) || lead(t) over (partition by doc_id order by n)) as k, lead(n) over (partition by doc_id order by n) as following from numbered),
marked as (select doc_id, n from (select doc_id, n, row_number() over (partition by k order by doc_id, n) as place from pairs where following is not null) where place > 1),
alone as (select doc_id, n from (select doc_id, n, row_number() over (partition by md5(t) order by doc_id, n) as place from numbered where length(t) >= 60) where place > 1),
gone as (select distinct doc_id, n from (select doc_id, n from marked union all select doc_id, n + 1 from marked union all from alone)),
runs as (select doc_id, count(*) as n_runs from gone g where not exists (select 1 from gone h where h.doc_id = g.doc_id and h.n = g.n - 1) group by doc_id),
kept as (select raw.doc_id, string_agg(line, chr(10) order by raw.pos) as kept from raw left join numbered using (doc_id, pos) left join gone using (doc_id, n) where gone.n is null group by raw.doc_id)
select d.doc_id, cast(coalesce(a.n, 0) as int) as n_lines, cast(coalesce(g.n, 0) as int) as n_lines_removed, cast(coalesce(n_runs, 0) as int) as n_runs, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join (select doc_id, count(*) as n from numbered group by doc_id) a using (doc_id) left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id) left join runs using (doc_id) left join kept using (doc_id)
"""

# the CRC of each different run, byte by byte: eight terms stand for the table of the polynomial
_TABLE = {1 << k: functools.reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), 1 << k) for k in range(8)}
_STEP = functools.reduce(lambda a, b: f"xor({a}, {b})", [f"((x >> {k}) & 1) * {_TABLE[1 << k]}" for k in range(8)]).replace("x >>", "xor(c, b) >>")
IMPORTANCE_SQL = f"""
with words as (select 'd' as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents
  union all select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
runs as (select side, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) as f from words),
counted as (select side, id, f, count(*) as n from runs group by all),
coded as (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::bigint)), lambda c, b: xor(c >> 8, {_STEP})), 4294967295::bigint) % 10000 as bucket from (select distinct f from counted)),
per as (select side, id, bucket, sum(n) as n from counted join coded using (f) group by all),
sums as (select sum(n) filter (side = 'd') as sd, sum(n) filter (side = 'b') as sb from per),
gain as (select b as bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (coalesce(sd, 0) + 10000)::double / ((coalesce(s, 0) + 1)::double * (coalesce(sb, 0) + 10000)::double))) as g
  from (select unnest(range(10000)) as b) left join (select bucket, sum(n) filter (side = 'd') as s, sum(n) filter (side = 'b') as t from per group by bucket) on b = bucket, sums),
weighed as (select id, sum(n) as n_features, sum(n * g) as weight from per join gain using (bucket) where side = 'd' group by id),
scored as (select w.id as doc_id, len(ws) as n_words, cast(coalesce(n_features, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight, cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.id)[1:8])::bigint + 0.5e0) / 4294967296e0))) as bigint) as score from words w left join weighed using (id) where side = 'd'),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= (select 5 * count(*) // 100 from placed) then place end as rank from scored left join placed using (doc_id)
"""

URL_SQL = """
with raw as (select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
cut as (select *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from raw),
given as (select *, case
  when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from cut),
known as (select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end as label,
  case when rest is null then [] else list_sort(list_distinct(list_concat(
    ['scheme ' || translate(split_part(url, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')],
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host ' || x), list_transform(list_filter(regexp_split_to_array(host, '[.-]'), lambda x: x <> ''), lambda x: 'host ' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path ' || regexp_replace(x, '[0-9]+', '#', 'g')),
    list_transform(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1) <> ''), lambda x: 'query ' || split_part(x, '=', 1))))) end as tokens from given),
known_tokens as (select * replace (list_filter(tokens, lambda x: x <> 'scheme ') as tokens) from known),
taught as (select row_number() over () as k, tokens, label from known_tokens where label is not null),
size as (select count(*) as n, count(*) filter (label = 'block') as blocks from taught),
usual as (select case when blocks > n - blocks then 'block' else 'allow' end as label, greatest(blocks, n - blocks) / n as prior, n from size),
each as (select k, label, unnest(tokens) as t from taught),
parts as (select k, label, [t] as p from each union all select a.k, a.label, [a.t, b.t] from each a join each b on a.k = b.k and a.t < b.t
  union all select a.k, a.label, [a.t, b.t, c.t] from each a join each b on a.k = b.k and a.t < b.t join each c on a.k = c.k and b.t < c.t),
counts as (select p, count(*) as all_, count(*) filter (label = 'block') as block_, count(*) filter (label = 'allow') as allow_ from parts group by p),
rules as (select p, r.label, both_, both_ / all_ as sure from (select p, all_, 'block' as label, block_ as both_ from counts union all select p, all_, 'allow', allow_ from counts) r, usual where both_ >= ceil(0.01e0 * n) and both_ / all_ >= 0.8e0 and (r.label <> usual.label or both_ / all_ > prior)),
kept as (select * from rules r where not exists (select 1 from rules g where g.label = r.label and len(g.p) < len(r.p) and list_has_all(r.p, g.p) and g.sure >= r.sure)),
asked as (select distinct tokens from known_tokens where label is null),
best as (select tokens, label, array_to_string(p, ' + ') as because from asked join kept on list_has_all(tokens, p) qualify row_number() over (partition by tokens order by sure desc, both_ desc, label desc, array_to_string(p, ' + ')) = 1)
select page_id, host, path, rule, coalesce(k.label, b.label, usual.label, 'allow') as verdict, case when rule is null then because end as because from known_tokens k left join best b on k.label is null and b.tokens = k.tokens left join usual on true
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": JACCARD_SQL,
    "op7_substring_dedup": SUBSTRING_SQL,
    "op8_warc_revisits": warc.DIGEST_SQL,
    "op9_line_dedup": LINES_SQL,
    "op11_importance_resampling": IMPORTANCE_SQL,
    "op12_url_filters": URL_SQL,
}
