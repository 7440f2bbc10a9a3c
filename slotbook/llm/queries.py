"""Registered queries of this subpackage, and their oracle SQL where SQL has one."""

from __future__ import annotations

import corpus_pipeline
from slotbook.llm import (
    decontaminate,
    html_extract,
    lexical_search,
    license_scan,
    lm_scoring,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    substring_dedup,
    token_files,
    toxicity,
    whitening,
)
from slotbook.session import scratch_path


def _read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op2_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_source_mixing(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.source_labels(docs))


def op4_license_scan(spark, sf_dir):
    return license_scan.license_scan(_read(spark, sf_dir, "documents"))


def op5_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_scores(_read(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    return quality_classifier.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "starts", "ends")


def op10_html_extract(spark, sf_dir):
    return html_extract.main_texts(_read(spark, sf_dir, "pages"))


def op11_token_files(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        content = f.read()
    at = scratch_path(spark, "token-files")
    token_files.write(_read(spark, sf_dir, "documents"), content, at)
    return token_files.documents(spark, at)


def op12_lexical_search(spark, sf_dir):
    return lexical_search.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_license_scan": op4_license_scan,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_html_extract": op10_html_extract,
    "op11_token_files": op11_token_files,
    "op12_lexical_search": op12_lexical_search,
    "op13_embedding_whitening": op13_embedding_whitening,
    "pipeline": corpus_pipeline.run,
}

_SPACED = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL = {
    "op1_substring_dedup": rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
p as (select doc_id, unnest(range(len(w) - 49)) as i, w from d where len(w) >= 50),
g as (select doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) as k from p),
f as (select k, min(doc_id) as first from g group by k),
x as (select distinct g.doc_id, i + unnest(range(50)) as j from g join f using (k) where g.doc_id > f.first),
e as (select doc_id, unnest(w) as t, unnest(range(len(w))) as j from d),
k as (select e.doc_id, count(*) as n, string_agg(t, ' ' order by e.j) as kept
      from e anti join x on e.doc_id = x.doc_id and e.j = x.j group by e.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)
""",
    "op2_near_dedup": rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_SPACED}) as w
  from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct([array_to_string(w[i + 1:i + 5], ' ') for i in range(len(w) - 4)]) end as s from d),
n as (select doc_id, len(s) as n from s),
e as (select doc_id, unnest(s) as x from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
u as (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as b from n union select r.a, u.b from r join u on r.b = u.a)
select doc_id, n as n_shingles, min(b) as component_id, doc_id = min(b) as kept
from n join r on r.a = doc_id group by doc_id, n
""",
    "op6_decontaminate": r"""
with b as (select row_number() over () as r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
i as (select r, item_id, least(len(w), 13) as z, unnest(range(len(w) - least(len(w), 13) + 1)) as k, w from b where len(w) > 0),
x as (select distinct r, item_id, z, md5(array_to_string(w[k + 1:k + z], ' ')) as h from i),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
z as (select distinct z from x),
p as (select doc_id, z, unnest(range(len(w) - z + 1)) as k, w from d, z where len(w) >= z),
g as (select doc_id, z, k, md5(array_to_string(w[k + 1:k + z], ' ')) as h from p),
o as (select g.doc_id, g.k, g.z, x.r, x.item_id from g join x on g.z = x.z and g.h = x.h),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, k + unnest(range(z)) as j from o) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids
      from (select distinct doc_id, r, cast(item_id as varchar) as s from o) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from d left join c using (doc_id) left join t using (doc_id)
""",
    "op12_lexical_search": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
s as (select count(*) filter (len(w) > 0) as big_n, cast(sum(len(w)) as bigint) as big_l from d),
b as (select row_number() over () as q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
a as (select q, t, count(*) as times from (select q, unnest(w) as t from b) group by q, t),
p as (select r, t, count(*) as tf from (select r, unnest(w) as t from d) where t in (select t from a) group by r, t),
f as (select t, cast(floor(1000 * ln(cast(2 * big_n + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as weight
      from p, s group by t, big_n),
m as (select r, doc_id, 100 - 75 + ((75 * len(w) * big_n) // big_l) as m from d, s where len(w) > 0),
x as (select q, r, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
      from a join f using (t) join p using (t) join m using (r) group by q, r, doc_id),
o as (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id) as k from x where score > 0)
select item_id, cast(k as integer) as rank, doc_id, score from o join b using (q) where k <= 10
""",
}
