"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import (
    collocations, decontaminate, language, near_dup, packing, pii, quality, secret_scan, suffix_dedup, token_counts, toxicity, warc,
    whitening)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"


def query(name: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_warc_index")
def op1(spark, folder):
    index = warc.archive_and_index(table(spark, folder, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "position",
                        "capture_no")


@query("op2_decontaminate")
def op2(spark, folder):
    return decontaminate.digest(decontaminate.find_passages(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query("op3_pii")
def op3(spark, folder):
    found = pii.find_pii(table(spark, folder, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.BASE), F.sha2("base", 256).alias("base_sha256"), "spans", "scores")


@query("op4_best_fit_packing")
def op4(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query("op5_language")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = language.learn(docs.where(~held_out))
    keyed = docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("key"), "text")
    found = language.predict(keyed, model, "key")
    return found.select("key.doc_id", "key.held_out", "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


@query("op6_secret_scan")
def op6(spark, folder):
    return secret_scan.digest(secret_scan.find_secrets(table(spark, folder, "documents")))


@query("op7_near_duplicates")
def op7(spark, folder):
    return near_dup.find_groups(table(spark, folder, "documents"), size=3, percent=85)


@query("op8_token_counts")
def op8(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query("op9_quality_rules")
def op9(spark, folder):
    return quality.apply_rules(table(spark, folder, "documents"))


@query("op10_toxicity")
def op10(spark, folder):
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select(
        "doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), "toxic")
    chain = toxicity.fit(docs, labels, ["low_quality", "toxic"])
    return toxicity.predict(docs, chain)


@query("op11_whitening")
def op11(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op12_suffix_dedup")
def op12(spark, folder):
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_phrases")
def op13(spark, folder):
    return collocations.mine(table(spark, folder, "documents"))


ORACLES["op13_phrases"] = """WITH w AS (SELECT id, lang, list_filter(string_split_regex(piece, '[ \\t]+'), x -> x <> '') AS w
    FROM (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents)),
  grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), i -> w[i:i + k - 1])) AS g FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
  f AS (SELECT lang, g, any_value(k) AS k, count(*)::HUGEINT AS a FROM grams GROUP BY lang, g),
  c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
  cuts AS (SELECT c.lang, c.g, c.k, c.a, x.k AS cut, x.a AS l, y.a AS r, 1000000::HUGEINT * c.a * c.a // (x.a * y.a) AS score
    FROM c JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.g = c.g[1:x.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[x.k + 1:c.k]),
  scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
  held AS (SELECT lang, part AS g, max(a) AS longer FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS part, a FROM c WHERE k = 3) GROUP BY 1, 2)
  SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM
    (SELECT s.lang, array_to_string(s.g, ' ') AS phrase, s.a, l, r, score, row_number() OVER (
       PARTITION BY s.lang ORDER BY score DESC, s.a DESC, array_to_string(s.g, ' ')) AS rank
     FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.g = s.g WHERE h.longer IS NULL OR 100 * h.longer < 50 * s.a)
    JOIN (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000"""
