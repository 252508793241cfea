"""The registered queries of the corpus operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chat, decontam, exactdedup, html, langid, mixing, simhash, tokens, toxicity, urlfilter

#: File of the tokenizer that the token query uses.
TOKENIZER = "word_bpe_49k.json"
#: Target weights of the mix, relative; sources without one weigh 1. Fixed values.
MIX_WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 0.5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=3).select("doc_id", "fingerprint", "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, weights=MIX_WEIGHTS).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.listed_table(spark, urlfilter.LISTED, urlfilter.NUMBERED), urlfilter.RULES).drop("listed")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], T.StructType([T.StructField(f.name, f.dataType) for f in turns.schema]))
    return chat.digests(chat.format_chats(turns.unionByName(extra), count=tokens.counter(public_tokenizers.path(TOKENIZER))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_decontamination, op3_language_id, op4_simhash_near_dedup, op5_exact_dedup, op6_source_mixing, op7_toxicity, op8_url_filter, op9_html_extraction, op10_chat_formatting,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
               FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
        dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        m AS (SELECT doc_id, s, dw.n, item FROM dw JOIN iw USING (n, g)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op8_url_filter": f"""
        WITH u AS (SELECT page_id,
                coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '') AS host,
                coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        r AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)}) t(h, p, v)),
        l AS (SELECT * FROM (VALUES {", ".join(f"('{e[:-1]}')" for e in urlfilter.LISTED)}) t(l)
              UNION ALL SELECT printf('listed-%06d.example.org', i) FROM range({urlfilter.NUMBERED}) n(i)),
        lu AS (SELECT printf('pages.example.org/en/%06d', i) AS lu FROM range({urlfilter.NUMBERED}) n(i)),
        b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':\\d*$', ''), '\\.+$', ''), '^www\\.', '') AS bare FROM u),
        p AS (SELECT page_id, host, path, bare || regexp_replace(path, '/+$', '') AS own, string_split(bare, '.') AS parts FROM b),
        c AS (SELECT page_id, host, path, own, array_to_string(parts[i:], '.') AS suffix FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p)),
        k AS (SELECT DISTINCT page_id, host, path FROM c WHERE host <> '' AND (suffix IN (SELECT l FROM l) OR own IN (SELECT lu FROM lu))),
        f AS (SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS ruled
              FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN k.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM f LEFT JOIN k USING (page_id, host, path)""",
}
