"""The queries of the training-data operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.llm import decontaminate, embedding_join, html_text, jaccard, language, packing, runs, secrets, spelling, token_files, toxicity, url_filter, warc
from gazeframe.llm.common import table

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Sites whose pages make the list of blocked URLs.
LISTED_SITES = ("spam-farm", "free-bets")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    h, p = url_filter.host(F.col("url")), url_filter.path(F.col("url"))
    listed = pages.where(h.rlike(rf"(^|\.)({'|'.join(LISTED_SITES)})\.")).select(url_filter.canonical(h, p).alias("canon"))
    return url_filter.judge(pages, RULES, listed)


def _op1_sql() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ranked = sorted(RULES, key=lambda r: -len(r[1]))

    def fit(rule: str) -> str:
        name, _, tail = rule.partition("/")
        return f"((host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{tail}'))"

    rule = "case " + " ".join(f"when {fit(r)} then '{r}'" for _, r in ranked) + " end"
    by_rule = "case rule " + " ".join(f"when '{r}' then '{a}'" for a, r in ranked) + " end"
    return f"""
with rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, coalesce({low.format("regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1)")}, '') as host, coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') as path from rest),
ruled as (select *, {rule} as rule, case when host <> '' then concat(regexp_replace(host, '^(www|m)\\.', ''), regexp_replace(path, '(\\.html)?/*$', '')) end as canon from parts),
listed as (select distinct canon as on_list from ruled where regexp_matches(host, '(^|\\.)({"|".join(LISTED_SITES)})\\.'))
select page_id, host, path, rule, coalesce({by_rule}, case when on_list is not null then 'block' else 'allow' end) as verdict,
  on_list is not null as listed
from ruled left join listed on canon = on_list"""


TOXIC_FROM = 0.7


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model | None:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.join(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive(table(spark, sf_dir, "pages"), least=0)
    back = warc.read_archives(manifest, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0, window=1024)
    return packing.digests(pieces)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_files.write_shards(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.read_documents(shards)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=5, percent=80)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


BLANKS = " \t\n\x0b\f\r"


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of documents with h = crc32 of the doc_id divisible by 10, the words from the a-th on repeat with a period p that h gives."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.btrim("text", F.lit(BLANKS)).alias("trimmed"), h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.split("trimmed", r"[\x20\x09-\x0D]+")
    n = F.size(words)
    a = (F.col("g") % n).cast("int")
    p = F.floor((n - a) / (3 + F.col("g") % 8)).cast("int") + 1
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    text = F.array_join(F.concat(F.slice(words, 1, a), repeated), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("trimmed") != ""), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_repeats(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    return (
        found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
        .select("doc_id", "n_runs", F.col("longest.start").alias("start"), (-F.col("longest.less")).alias("length"), F.col("longest.period").alias("period"), "runs_sha256", "collapsed_sha256")
        .withColumn("exponent_milli", F.floor(F.lit(1000) * F.col("length") / F.col("period")))
    )


def dropped_letter(seed: int, word: str, doc: object) -> str:
    """The word without one code point, if the crc32 of doc_id, colon and word is divisible by 31."""
    h = zlib.crc32(word.encode(), seed)
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.vocabulary(table(spark, sf_dir, "documents"), least_length=7, least_count=2, alter=dropped_letter), ratio=10)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = language.identify(docs, language.fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), F.col("lang").alias("lang_pred"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_join": op3_embedding_join,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_token_files": op7_token_files,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_secrets": op9_secrets,
    "op10_html_text": op10_html_text,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_language_id": op13_language_id,
}
ORACLE: dict[str, str] = {"op1_url_filter": _op1_sql()}
