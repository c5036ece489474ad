"""Registered queries of the subpackage, with check SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (centroids, chat, collocations, decontaminate, html_text, language, license_scan, mixture, near_dup, neighbours,
               quality, token_files, url_filter)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = F.col("extracted.text")
    return html_text.extract(pages).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixture.mix(docs).select("doc_id", "mix_leaf.domain", "mix_leaf.language", "mix_leaf.source",
                                    F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("tokens"))


def _shared(children: str, parent: str, name: str) -> str:
    """SQL of mixture.share_out."""
    order = f"partition by {parent} order by capacity / weight, {name}"
    return f"""select *, case when is_full then capacity else cast(floor(
  (budget - coalesce(sum(case when is_full then capacity end) over (partition by {parent}), 0)) * weight
  / sum(case when not is_full then weight end) over (partition by {parent})) as bigint) end as spend
 from (select *, capacity * sum(weight) over ({order} rows between current row and unbounded following)
   <= (budget - coalesce(sum(capacity) over ({order} rows between unbounded preceding and 1 preceding), 0)) * weight
   as is_full from ({children}))"""


def _weights(column: str, weights: dict[str, int]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {w}" for k, w in weights.items()) + " else 1 end"


OP2_SQL = rf"""
with d as materialized (select *, concat('group', (ascii(nullif(regexp_extract(source, '([0-9])$', 1), '')) % 4)) as domain,
  lang as language, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as tokens from documents),
leaves as materialized (select domain, language, source, sum(tokens) as tokens, sum(tokens) * 4 as capacity
 from d where tokens > 0 group by all),
doms as materialized ({_shared(f"select domain, sum(capacity) as capacity, {_weights('domain', mixture.DOMAIN_WEIGHTS)} as weight, "
                  "(select cast(floor(sum(tokens) * 0.5) as bigint) from d) as budget from leaves group by domain", "1 + 1", "domain")}),
langs as materialized ({_shared(f"select l.*, spend as budget from (select domain, language, sum(capacity) as capacity, "
                   f"{_weights('language', mixture.LANGUAGE_WEIGHTS)} as weight from leaves group by all) l "
                   "join (select domain, spend from doms) using (domain)", "domain", "language")}),
plan as materialized ({_shared("select l.*, 1 as weight, spend as budget from leaves l "
                  "join (select domain, language, spend from langs) using (domain, language)", "domain, language", "source")}),
p as materialized (select d.*, plan.tokens as held, spend, cast(spend // plan.tokens as bigint) as whole,
  md5(concat('7|', spend // plan.tokens + 1, '|', doc_id)) as place
 from d join plan using (domain, language, source) where d.tokens > 0),
o as (select *, spend - whole * held as part,
  sum(tokens) over (partition by domain, language, source order by place rows between unbounded preceding and current row) - tokens
  as before from p),
e as (select doc_id, domain, language, source, cast(epoch as integer) as epoch, tokens from o, unnest(range(1, whole + 1)) u(epoch)
 union all
 select doc_id, domain, language, source, cast(whole + 1 as integer), least(tokens, part - before) from o where before < part)
select doc_id, domain, language, source, epoch, cast(tokens as bigint) as tokens from e"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).select("doc_id", *license_scan.license_digest("licenses"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = language.identify(docs, into="found")
    return found.select("doc_id", F.col("found.name").alias("language"), F.col("found.probability").alias("probability"),
                        ((F.col("found.name") != language.UNKNOWN) & (F.col("found.probability") >= 0.5)).alias("accepted"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of raw pages, from their text, markup, address and host."""
    page = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]*>", " ")
    page = page.select("page_id", visible.alias("text"),
                       F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]+)", 1).alias("lang"),
                       F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1)).alias("host"))
    found = language.identify(page, host="host", suffix=F.substring_index("host", ".", -1), into="found")
    return found.select("page_id", F.col("found.name").alias("language"), F.col("found.probability").alias("probability"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


# Fixed value: the text of the added conversation.
ADDED = r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(ADDED).alias("text"))
    return chat.format_digests(rows.unionByName(added))


OP6_SQL = f"""
with c as (
 select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '{ADDED}' union all select -7, 1, 'assistant', '{ADDED}')
select conv_id, count(*) as n_turns,
 sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn nulls first, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(15 + length(role) + case when role in ('user', 'assistant', 'system') then 0 else 1 end + length(text)
  + len(regexp_extract_all(text, '###|</turn>'))) as bigint) as formatted_chars
from c group by conv_id"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.judge(pages).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def _op7_sql(least: float = 0.05) -> str:
    def lower(x: str) -> str:
        return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    fits = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then struct_pack(rule := '{h}{p}', verdict := '{v}')"
        for h, p, v in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1])))
    steps = "".join(f"""
r{k + 1} as materialized (select kind, host, sum(rank) as rank from (
  select kind, host, rank * {1 - url_filter.DAMPING!r} as rank from r0
  union all select kind, n as host, r{k}.rank * share * {url_filter.DAMPING} from r{k} join e using (kind, host)) group by all),"""
                    for k in range(url_filter.STEPS))
    link = url_filter.LINK.replace("'", "''")
    return rf"""
with p as materialized (select page_id, html, {lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
j as materialized (select *, case {fits} end as r from p),
h as materialized (select host, avg(case when r.verdict = 'allow' then 1.0::double else 0 end) as a,
  avg(case when r.verdict = 'block' then 1.0::double else 0 end) as b from j where host <> '' group by host),
l0 as (
 select host as s, {lower("regexp_extract(u, '^(?:[^/?#]*:)?//([^/?#]*)', 1)")} as t
 from (select host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) as u from p) where contains(u, '://') or starts_with(u, '//')
 union all
 select host, case when length(host) - length(replace(host, '.', '')) >= 2 then regexp_replace(host, '^[^.]*\.', '') end
 from (select distinct host from p)),
l as materialized (select s, t, count(*) as n from l0 where s <> '' and t <> '' and s <> t group by all),
b as (select 'trust' as kind, s as host, t as n, n as w from l union all select 'distrust', t, s, n from l),
e as materialized (select kind, host, n, w / sum(w) over (partition by kind, host) as share from b),
r0 as materialized (select * from (
  select 'trust' as kind, host, a / (select coalesce(nullif(sum(a), 0), 1) from h) as rank from h
  union all select 'distrust', host, b / (select coalesce(nullif(sum(b), 0), 1) from h) from h) where rank > 0),{steps}
bad as (select host from r{url_filter.STEPS} group by host
  having coalesce(sum(rank) filter (kind = 'distrust'), 0) * (select count(*) from h) >= {least}
   and coalesce(sum(rank) filter (kind = 'distrust'), 0) > coalesce(sum(rank) filter (kind = 'trust'), 0))
select page_id, host, path, r.rule as rule,
 coalesce(r.verdict, case when host in (select host from bad) and host <> '' then 'block' else 'allow' end) as verdict from j"""


OP7_SQL = _op7_sql()


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    return quality.train(docs, table(spark, sf_dir, "labels"), use=~held_out("doc_id"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *decontaminate.overlap_digest("overlap"))


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP9_SQL = f"""
with d as materialized (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where item_id is not null),
p as materialized (
 select distinct item, least(len(w), 10) as n, array_to_string(w[pos0:pos0 + least(len(w), 10) - 1], ' ') as k
 from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as pos0 from i where len(w) > 0)),
g as (select r, n, pos0, array_to_string(w[pos0:pos0 + n - 1], ' ') as k
 from (select r, w, n, unnest(range(1, len(w) - n + 2)) as pos0 from d, (select distinct n from p) where len(w) >= n)),
h as materialized (select g.r, g.n, g.pos0, p.item from g join p on g.n = p.n and g.k = p.k),
s as (select r, count(distinct pos) as n_hit from (select r, unnest(range(pos0, pos0 + n)) as pos from h) group by r),
t as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items
 from (select distinct r, item from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
 sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join s using (r) left join t using (r)"""

def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = r"""
with recursive w as materialized (
 select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (
 select distinct doc_id, array_to_string(w[pos0:pos0 + 3], ' ') as g
 from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as pos0 from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from s a join s b on a.g = b.g and a.doc_id < b.doc_id
 group by 1, 2),
links as materialized (
 select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_ >= 80 * (x.n + y.n - both_)),
edges as materialized (select a, b from links union select b, a from links),
reach(doc_id, root) as (select a, a from edges union select r.doc_id, e.b from reach r join edges e on r.root = e.a),
c as (select doc_id, min(root) as root from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(root, doc_id) as component_id,
 doc_id = coalesce(root, doc_id) as kept
from documents left join n using (doc_id) left join c using (doc_id)"""

def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read_documents(token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _op12_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    def nearest(c: str) -> str:
        # The nearest of the centroids of table c, ties to the smaller number.
        return f"""select row, any_value(vec_id) as vec_id, any_value(v) as v, min_by(cluster, (d, cluster)) as cluster, min(d) as distance
 from (select w.row, w.vec_id, w.v, cluster, list_sum(list_transform(list_zip(w.v, {c}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from w, {c}) group by row"""

    steps = "".join(f"""
a{n} as materialized ({nearest(f"c{n}")}),
c{n + 1} as materialized (select cluster, coalesce(m.v, c{n}.v) as v from c{n} left join (
  select cluster, list(cast(q - case when s < q * n then 1 else 0 end as bigint) order by d) as v from (
    select cluster, d, sum(x) as s, count(*) as n, sum(x) // count(*) as q from (
      select cluster, unnest(v) as x, unnest(range({size})) as d from a{n}) group by all) group by cluster) m using (cluster)),"""
                    for n in range(rounds))
    return f"""
with w as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
 from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: isfinite(x))) = {size}),
c0 as materialized (select cast(row_number() over (order by h) - 1 as integer) as cluster, v from (
 select sha256(concat('3:', vec_id)) as h, v from w where vec_id is not null order by h limit {k})),{steps}
z as materialized ({nearest(f"c{rounds}")})
select vec_id, z.cluster, cast(distance as bigint) as distance, cast(sum(distance) over (partition by z.cluster) as bigint) as cluster_inertia,
 cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from z join c{rounds} using (cluster)"""


OP12_SQL = _op12_sql()


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = r"""
with p as materialized (select row_number() over () as piece, lang, regexp_extract_all(t, '[^\x20\x09]+') as w from (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as t from documents)),
g as materialized (select lang, k as words, array_to_string(w[s:s + k - 1], ' ') as phrase, count(*) as f from (
  select lang, w, k, unnest(range(1, len(w) - k + 2)) as s from p, (select unnest([1, 2, 3]) as k) where len(w) >= k) group by all),
n as (select lang, sum(f) as n from g where words = 1 group by lang),
f as materialized (select *, string_split(phrase, ' ') as w from g where f >= 10),
c as (select lang, phrase, words, f as a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail
  from (select *, unnest(range(1, words)) as k from f where words > 1)),
s as (select c.*, x.f as l, y.f as r, cast((1000000::hugeint * a * a) // (x.f::hugeint * y.f) as bigint) as score
  from c join f x on x.lang = c.lang and x.phrase = head join f y on y.lang = c.lang and y.phrase = tail),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, part, max(a) as longer from (
  select lang, f as a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part from f where words = 3) group by all)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, score
from b left join i on b.lang = i.lang and b.phrase = i.part join n on n.lang = b.lang
where longer is null or 100 * longer < 50 * a
qualify row_number() over (partition by b.lang order by score desc, a desc, phrase) <= 2000"""

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_mixture": op2_mixture,
    "op3_license_scan": op3_license_scan,
    "op4_language": op4_language,
    "page_languages": page_languages,
    "op5_neighbours": op5_neighbours,
    "op6_chat_format": op6_chat_format,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_token_files": op11_token_files,
    "op12_centroids": op12_centroids,
    "op13_collocations": op13_collocations,
}
ORACLES = {
    "op2_mixture": OP2_SQL,
    "op6_chat_format": OP6_SQL,
    "op7_url_filter": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_near_duplicates": OP10_SQL,
    "op12_centroids": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
