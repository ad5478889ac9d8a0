"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairtract.llm import bpe, dialogue, html, lm, mixing, near, neighbours, passages, phrases, quality, token_counts, toxicity, urls
from fairtract.llm.storage import new_path

#: The rules of the url query: verdict, host, path.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: Tokens of the second tokenizer version of the count query.
PIECES = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are loaded with estimates, counted, counted by another tokenizer, and freed of copies."""
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "token-counts")
    estimate = F.floor(F.col("n_chars") / 6)
    words, pieces = mixing.word_count(F.col("text")), F.regexp_count("text", F.lit(PIECES))
    load = token_counts.inserted(docs, "words-1", estimate)
    token_counts.commit(spark, path, "load", load)
    token_counts.commit(spark, path, "count", token_counts.revised(docs, "words-1", estimate, words))
    token_counts.commit(spark, path, "pieces", token_counts.inserted(docs, "pieces-1", pieces))
    copies = token_counts.copies(docs)
    gone = token_counts.both(token_counts.deleted(copies, "words-1", words), token_counts.deleted(copies, "pieces-1", pieces))
    token_counts.commit(spark, path, "copies", gone)
    token_counts.commit(spark, path, "load", load)  # again, to no effect
    return token_counts.totals(spark, path)


OP2_SQL = r"""
with d as (
  select *, doc_id > min(doc_id) over (partition by coalesce(text, '')) as is_copy,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as words,
    coalesce(len(regexp_extract_all(text, '[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+')), 0) as pieces
  from documents)
select source, lang, tokenizer, count(*)::bigint as n_docs, sum(n)::bigint as n_tokens
from (select source, lang, 'words-1' as tokenizer, words as n from d where not is_copy
  union all select source, lang, 'pieces-1', pieces from d where not is_copy)
group by all
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit_bands(docs, table(spark, sf_dir, "labels")))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), rows=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('42 ' || coalesce(doc_id::varchar, 'text ' || coalesce(text, ''))) as digest
  from documents),
s0 as (select source, sum(size)::bigint as source_size from sized group by source),
s1 as (select *, [5.0, 2.0, 1.0][1 + (row_number() over (order by source is null, source) - 1) % 3]::double as weight,
    3.0::double * source_size as cap from s0),
s2 as (select *, cap / weight as level_of_cap, (sum(source_size) over ())::double as wanted from s1),
s3 as (select *, (wanted - coalesce(sum(cap) over (order by level_of_cap, source is null, source
      rows between unbounded preceding and 1 preceding), 0)) /
    sum(weight) over (order by level_of_cap, source is null, source
      rows between current row and unbounded following) as level from s2),
s4 as (select *, max(case when level < level_of_cap then level end) over () as final from s3),
t as (select source, source_size, case when level >= level_of_cap then cap else final * weight end as target from s4),
p as (select *, case when source_size > 0 then floor(target / source_size) else 1 end::bigint as whole from t),
d as (select z.*, p.source_size, p.target, p.whole, greatest(p.target - p.whole * p.source_size, 0.0::double) as rest,
    sum(size) over (partition by z.source order by digest, doc_id nulls last, size
      rows between unbounded preceding and current row) as upto
  from sized z join p on z.source is not distinct from p.source)
select doc_id, size, source_size, target,
  (size * (whole + case when source_size > 0 and upto - size / 2.0 < rest then 1 else 0 end))::bigint as taken
from d
"""


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
with u as (
  select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f as (
  select page_id, host, path, max_by(struct_pack(rule := h || p, verdict := r.verdict), length(h || p)) as fit
  from u left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by all)
select page_id, host, path, fit.rule as rule, coalesce(fit.verdict, 'allow') as verdict from f
"""

def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


OP9_SQL = r"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as g
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as shared
  from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as reached from d union select r.doc_id, e.b from r join e on e.a = r.reached)
select r.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(reached) as component_id,
  min(reached) = r.doc_id as kept
from r left join n using (doc_id) group by r.doc_id
"""


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
p as (select doc_id, i, w[i] as word, case when i + 19 <= len(w) then md5(array_to_string(w[i:i + 19], ' ')) end as win
  from (select doc_id, w, unnest(generate_series(1, len(w))) as i from d)),
f as (select win, min({'d': doc_id, 'i': i}) as first from p where win is not null group by win having count(*) > 1),
q as (select p.doc_id, p.i, p.word, coalesce(max((f.win is not null and f.first <> {'d': p.doc_id, 'i': p.i})::int) over (
    partition by p.doc_id order by p.i rows between 19 preceding and current row), 0) = 1 as gone
  from p left join f using (win)),
g as (select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept
  from q group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from d left join g using (doc_id)
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, w[i:i + k - 1] as g, count(*)::bigint as f
  from (select lang, w, unnest(generate_series(1, len(w))) as i from w where len(w) > 0), (values (1), (2), (3)) as t(k)
  where i + k - 1 <= len(w) group by all),
c as (select * from g where len(g) >= 2 and f >= 10),
longer as (select lang, part, max(f) as most from (select lang, f, unnest([g[1:2], g[2:3]]) as part from c where len(g) = 3) group by all),
kept as (select c.* from c left join longer on longer.lang = c.lang and longer.part = c.g where most is null or 100 * most < 50 * c.f),
cuts as (select k.lang, k.g, k.f as a, l.f as l, r.f as r, t.k, ((1000000::hugeint * k.f * k.f) // (l.f::hugeint * r.f))::bigint as score
  from kept k join (values (1), (2)) as t(k) on t.k < len(k.g)
  join g l on l.lang = k.lang and l.g = k.g[1:t.k] join g r on r.lang = k.lang and r.g = k.g[t.k + 1:len(k.g)]),
best as (select lang, g, any_value(a) as a, min({'score': score, 'k': k, 'l': l, 'r': r}) as b from cuts group by lang, g),
n as (select lang, sum(f)::bigint as n from g where len(g) = 1 group by lang),
ranked as (select lang, array_to_string(g, ' ') as phrase, a, b.l as l, b.r as r, b.score as score,
  row_number() over (partition by lang order by b.score desc, a desc, array_to_string(g, ' ')) as rank from best)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = dialogue.repair(dialogue.damage(table(spark, sf_dir, "conversations")))
    return repaired.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_token_counts": op2_token_counts,
    "op3_bpe": op3_bpe,
    "op4_language_model": op4_language_model,
    "op5_quality": op5_quality,
    "op6_source_mix": op6_source_mix,
    "op7_main_text": op7_main_text,
    "op8_url_rules": op8_url_rules,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_collocations": op11_collocations,
    "op12_toxicity": op12_toxicity,
    "op13_dialogue_repair": op13_dialogue_repair,
}
ORACLES = {
    "op2_token_counts": OP2_SQL,
    "op6_source_mix": OP6_SQL,
    "op8_url_rules": OP8_SQL,
    "op9_near_duplicates": OP9_SQL,
    "op10_repeated_passages": OP10_SQL,
    "op11_collocations": OP11_SQL,
}
