"""The registered queries of this subpackage, each over its whole table, and the SQL that some must agree with."""

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tarmac.llm import (
    alignment,
    decontamination,
    lattice,
    line_dedup,
    main_text,
    merkle,
    mixing,
    near_dups,
    packing,
    quality,
    suffix_dedup,
    tokens,
    url_rules,
)
from tarmac.llm.text import SPACES, word_count
from tarmac.plans.session import tune

# The vocabulary of the token counts, and the one that it is aligned with.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents")).drop("dk")


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(list(url_rules.RULES), "verdict string, host string, path string")
    return url_rules.judge_urls(pages, rules).drop("url")


ORACLES["op3_url_filters"] = r"""
with parts as (
  select page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1)) as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
), rules(verdict, rule_host, rule_path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best as (
  select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    arg_max(verdict, length(rule_host || rule_path)) as verdict
  from parts, rules
  where (host = rule_host or suffix(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join best using (page_id)
"""


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack(docs.select("doc_id", word_count(F.col("text")).alias("size")))


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read(spark, sf_dir, "documents")).drop("dk")


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read(spark, sf_dir, "pages"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its lines, those that go, and the numbers of the word lines that stay."""
    docs = read(spark, sf_dir, "documents")
    kept = line_dedup.kept_lines(docs)
    worded = F.size(F.filter("lines", lambda line: F.btrim(line, F.lit(SPACES)) != ""))
    rows = docs.select("doc_id", "text", F.split("text", "\n", -1).alias("lines")).select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("dk"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("text").isNotNull(), worded), F.lit(0)).cast("long").alias("worded"),
    )
    rows = rows.join(kept, "dk", "left")
    stay = F.coalesce(F.size("kept"), F.lit(0))
    return rows.select(
        "doc_id",
        "n_lines",
        (F.col("worded") - F.greatest(stay, F.lit(0))).alias("n_removed"),
        F.coalesce(F.array_join(F.col("kept").cast("array<string>"), ","), F.lit("")).alias("kept_lines"),
    )


ORACLES["op7_line_dedup"] = r"""
with lines as (
  select doc_id, i - 1 as line, string_split(text, chr(10))[i] as value
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i
        from documents where text is not null)
), sets as (
  select doc_id, line, list_distinct(list_filter(string_split_regex(value, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) as w
  from lines
), numbered as (
  select row_number() over (order by doc_id, line) as id, doc_id, line, w, len(w) as n from sets where len(w) > 0
), classes as (
  select min(id) as id, any_value(w) as w, any_value(n) as n from numbered group by list_sort(w)
), tokens as (
  select id, n, unnest(w) as t from classes
), common as (
  select a.id as x, b.id as y, count(*) as shared, any_value(a.n) as n, any_value(b.n) as m
  from tokens a join tokens b on a.t = b.t and a.id < b.id group by 1, 2
), gone as (
  select distinct y from common where 5 * shared >= 4 * (n + m - shared)
), kept as (
  select doc_id, count(*) as stay, string_agg(cast(line as varchar), ',' order by line) as kept_lines
  from numbered where id in (select id from classes) and id not in (select y from gone) group by doc_id
), counts as (
  select doc_id, count(*) as worded from numbered group by doc_id
)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) as n_lines,
  coalesce(c.worded, 0) - coalesce(k.stay, 0) as n_removed, coalesce(k.kept_lines, '') as kept_lines
from documents d left join counts c using (doc_id) left join kept k using (doc_id)
"""


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(VOCABULARY).read_text(encoding="utf-8")
    return tokens.token_counts(read(spark, sf_dir, "documents"), vocabulary)


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), mixing.hash_key().alias("key")
    )
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op10_source_mixing"] = r"""
with docs as (
  select doc_id, source, md5(concat(coalesce(cast(doc_id as varchar), 'null'), ' ', coalesce(text, ''))) as k,
    coalesce(len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')), 0) as size
  from documents
), sources as (
  select source, sum(size) as words, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from docs group by source
), filled as (
  select *, 3 * words as cap, sum(words) over () as all_words, sum(weight) over () as all_weight,
    coalesce(sum(3 * words) over w, 0) as cap_before, coalesce(sum(weight) over w, 0) as weight_before
  from sources
  window w as (order by 3 * words / weight, source nulls last rows between unbounded preceding and 1 preceding)
), marked as (
  select *, cap * (all_weight - weight_before) < (all_words - cap_before) * weight as capped from filled
), rest as (
  select any_value(all_words) - coalesce(sum(cap) filter (capped), 0) as words,
    any_value(all_weight) - coalesce(sum(weight) filter (capped), 0) as weight from marked
), targets as (
  select m.source, m.words as source_size,
    case when capped then cast(cap as double)
      else cast(r.words * m.weight as double) / cast(greatest(r.weight, 1) as double) end as target
  from marked m, rest r
), cuts as (
  select *, cast(floor(target) as bigint) as budget from targets
), placed as (
  select d.doc_id, d.size, c.source_size, c.target, c.budget,
    coalesce(sum(d.size) over (partition by d.source order by d.k rows between unbounded preceding and 1 preceding), 0)
      as before
  from docs d join cuts c on d.source is not distinct from c.source
)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
  cast(case when source_size = 0 then 0
    else (budget // source_size) * size + least(size, greatest(0, budget % source_size - before)) end as bigint) as taken
from placed
"""


@query
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    hit = decontamination.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


ORACLES["op11_benchmark_decontamination"] = r"""
with docs as (
  select row_number() over () as k, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents
), items as (
  select coalesce(cast(item_id as varchar), '') as item, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from benchmark
), windows as (
  select distinct item, size, array_to_string(w[i:i + size - 1], ' ') as gram
  from (select item, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i
        from items where len(w) > 0)
), grams as (
  select k, i, size, array_to_string(w[i:i + size - 1], ' ') as gram
  from (select k, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, (select distinct size from windows))
), found as (
  select k, i, size, item from grams join windows using (size, gram)
), hits as (
  select k, count(distinct place) as n_hit from (select k, unnest(range(i, i + size)) as place from found) group by k
), named as (
  select k, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct k, item from found) group by k
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (k) left join named using (k)
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose decimal id has an even CRC-32 are tampered with: their line feeds go."""
    docs = read(spark, sf_dir, "documents")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.manifest(docs, text)
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(text: str) -> str:
    fields = [f"cast({c} as varchar)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields) + ")"


# Node lists by level, the siblings of every node, and a fold over each document's chain of siblings.
ORACLES["op12_merkle_manifest"] = rf"""
with recursive docs as (
  select row_number() over () as k, *, coalesce('=' || source, '') as tree,
    {_sql_leaf("text")} as leaf,
    {_sql_leaf("case when even then replace(text, chr(10), '') else text end")} as changed
  from (
    select *, coalesce(list_reduce(
      list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
      lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) % 2 = 1, false) as even
    from documents)
), places as (
  select k, tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place,
    count(*) over (partition by tree) as n, leaf from docs
), nodes as (
  select tree, 0 as level, place, n, leaf as node from places
  union all
  select tree, level + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' order by place))
  from nodes where n > 1 group by tree, level, place // 3
), sources as (
  select tree, node as subroot, level as height, row_number() over (order by tree) - 1 as place, count(*) over () as n
  from nodes where n = 1
), tops as (
  select 0 as level, place, n, subroot as node from sources
  union all
  select level + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' order by place))
  from tops where n > 1 group by level, place // 3
), sides as (
  select a.tree, a.level, a.place, coalesce(string_agg(b.node, '' order by b.place) filter (b.place < a.place), '') as l,
    coalesce(string_agg(b.node, '' order by b.place) filter (b.place > a.place), '') as r
  from nodes a join nodes b on a.tree = b.tree and a.level = b.level and a.place // 3 = b.place // 3
  where a.n > 1 group by a.tree, a.level, a.place
), top_sides as (
  select a.level, a.place, coalesce(string_agg(b.node, '' order by b.place) filter (b.place < a.place), '') as l,
    coalesce(string_agg(b.node, '' order by b.place) filter (b.place > a.place), '') as r
  from tops a join tops b on a.level = b.level and a.place // 3 = b.place // 3 where a.n > 1 group by a.level, a.place
), chain as (
  select k, s.level as step, l, r from places p join sides s
    on s.tree = p.tree and s.place = p.place // cast(pow(3, s.level) as bigint)
  union all
  select k, t.height + s.level, l, r from places p join sources t on t.tree = p.tree
    join top_sides s on s.place = t.place // cast(pow(3, s.level) as bigint)
), proofs as (
  select k, sha256(string_agg(l || r, '' order by step)) as proof_sha256 from chain group by k
), folds as (
  select k, 0 as step, changed as node from docs
  union all
  select k, step + 1, sha256(l || node || r) from folds join chain using (k, step)
), folded as (
  select k, arg_max(node, step) as folded_root from folds group by k
)
select doc_id, leaf, subroot, (select node from tops where n = 1) as root, coalesce(proof_sha256, sha256('')) as proof_sha256,
  folded_root, folded_root = (select node from tops where n = 1) as verified
from docs join sources using (tree) left join proofs using (k) join folded using (k)
"""


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = Path(VOCABULARY).read_text(encoding="utf-8"), Path(PIECES).read_bytes()
    return alignment.align_tokens(read(spark, sf_dir, "documents"), *vocabularies)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(tune(spark), sf_dir)
