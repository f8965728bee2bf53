"""Registered queries of the text operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pivotloom.llm import chat_format, imatch, language_id, license_scan, line_dedup, multi_index, packing, sentencepiece_unigram, simhash_dedup, spelling_groups, token_alignment, toxicity, url_filter
from pivotloom.llm.common import fold_of


try:
    import public_tokenizers

    TOKENIZERS = public_tokenizers.path
except ImportError:  # the folder of vocabulary files is then named directly
    TOKENIZERS = "/opt/tokenizers/{}".format


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("found", lambda x: x["confirmed"])
    best = F.array_max(F.transform(sure, lambda x: F.struct(x["probability"], x["family"])))
    return found.select(
        "doc_id", "n_paragraphs", F.size("found").alias("n_predicted"), F.size(sure).alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("licences"),
        best["family"].alias("licence"), best["probability"].alias("score"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_unigram.round_trip(table(spark, sf_dir, "documents"), TOKENIZERS("piece_bpe_32k.model"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))
    return _held_out(found).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZERS("word_bpe_49k.json"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edited(table(spark, sf_dir, "documents"))


def _op8_sql() -> str:
    def hashes(t: str) -> str:
        w = imatch.WIDTH
        subsets = [f"list_filter(k, lambda s: substring(md5(s), {at}, 1) < '{bound}')" for at, bound in imatch.NESTED]
        subsets += [f"list_filter(k, lambda s: instr(md5(s), '{d}') = {j})" for d, n in imatch.FAMILIES for j in range(1, n + 1)]
        parts = [f"substring(md5(array_to_string(k, ' ')), 1, {w})"]
        parts += [f"case when len({p}) > 0 then substring(md5(array_to_string({p}, ' ')), 1, {w}) else '{imatch.EMPTY}' end" for p in subsets]
        return f"list_transform([{t}], lambda k: [{', '.join(parts)}])[1]"

    def terms(t: str) -> str:
        return f"list_sort(list_distinct(list_filter(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')))"

    def near(a: str, b: str) -> str:
        at = f"list_filter(range(1, {imatch.HASHES + 1}), lambda i: {a}[i] <> '{imatch.EMPTY}' or {b}[i] <> '{imatch.EMPTY}')"
        return f"len(list_filter({at}, lambda i: {a}[i] = {b}[i])) / len({at})::double"

    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
own as (select doc_id, t, coalesce(lead(t) over w, first_value(t) over w) as nt from d window w as (order by doc_id desc rows between unbounded preceding and unbounded following)),
ed as (select doc_id, t, nt, substring(t, 1, length(t) - length(t) // 2) || substring(nt, 1, length(t) // 2) as e from own),
tt as (select *, {terms('t')} as a, {terms('nt')} as b, {terms('e')} as c from ed),
lex as (select list(term) as l from (select term, count(*) as df from (select unnest(a) as term from tt) x group by term) y, (select count(*) as n from d) z
  where df between greatest(2, ceil(n * {imatch.LOW})) and greatest(2, floor(n * {imatch.HIGH}))),
k as (select doc_id, t, e, a, b, c, list_intersect(a, l) as ia, list_intersect(b, l) as ib, list_intersect(c, l) as ic from tt, lex),
f as (select doc_id, t, e,
  {hashes("case when len(ia) > 0 then list_sort(ia) else a end")} as fa,
  {hashes("case when len(ib) > 0 then list_sort(ib) else b end")} as fb,
  {hashes("case when len(ic) > 0 then list_sort(ic) else c end")} as fc from k)
select doc_id, length(t) as n_chars, sha256(e) as edited_sha256, array_to_string(fa, '') as fingerprint,
  array_to_string(fc, '') as edited_fingerprint, {near('fa', 'fc')} as near_edited, {near('fa', 'fb')} as near_next
from f
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return _held_out(found).select("doc_id", "held_out", "score", "predicted")


#: What both rows of conversation -7 say.
TRICKY = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest(chat_format.format_conversations(rows))


OP10_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{TRICKY}'
  union all select -7, 1, 'assistant', '{TRICKY}'),
sized as (
  select *, length(text) + length(text) - length(replace(text, '\', ''))
      + length(text) - length(regexp_replace(text, '##(#+)', '##', 'g'))
      + (length(text) - length(replace(text, '</turn>', ''))) // 7 as t,
    length(role) + length(role) - length(regexp_replace(role, '[\\:\n]', '', 'g'))
      + length(role) - length(regexp_replace(role, '##(#+)', '##', 'g'))
      + (length(role) - length(replace(role, '</turn>', ''))) // 7 as r
  from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(r + t + 14) as bigint) as formatted_chars
from sized group by conv_id
"""

def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.dedup(docs, line_dedup.build(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = f"""
with own as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
placed as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as place from own),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from placed),
common as (select key, max(doc_id) as last from keyed where length(key) >= {line_dedup.MIN_CHARS} group by key having count(distinct doc_id) >= {line_dedup.MIN_DOCS}),
judged as (select k.doc_id, line, place, c.key is not null and k.doc_id <> c.last as lost from keyed k left join common c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (not lost), '')) as kept_sha256
from judged group by doc_id
"""


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.group_variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.json"), TOKENIZERS("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_sentencepiece, op3_multi_index, op4_language_id, op5_url_filter, op6_simhash_dedup, op7_packing, op8_imatch, op9_toxicity, op10_chat_format, op11_line_dedup, op12_spelling_groups, op13_token_alignment)}
ORACLE_SQL: dict[str, str] = {"op8_imatch": _op8_sql(), "op10_chat_format": OP10_SQL, "op11_line_dedup": OP11_SQL}
