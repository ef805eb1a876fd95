"""The operators as queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayweave.llm import align, bitplanes, bytepairs, exact, jaccard, langid, neardup, packing, pieces, runs, suffixes, toxicity, wordpiece
from stayweave.llm.base import table
from stayweave.session import configure, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``, with its DuckDB text if there is one."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(configure(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_bit_planes")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4()}"
    bitplanes.write_ids(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return bitplanes.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Smallest node reachable over ``links(a, b)``, itself included.
_REACH = """reach AS (SELECT node, node AS other FROM nodes UNION SELECT node, b FROM reach JOIN links ON other = a),
    least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)"""


@query("op2_embedding_neardup", f"""
    WITH RECURSIVE nodes AS (SELECT vec_id AS node FROM embeddings),
    v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
              WHERE list_cosine_similarity(x.e, y.e) >= 0.93), {_REACH}
    SELECT node AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, node = component_id AS kept
    FROM least LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = node""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_copies(table(spark, folder, "embeddings"), least_cosine=0.93)


@query("op3_ngram_jaccard", rf"""
    WITH RECURSIVE nodes AS (SELECT doc_id AS node FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM w),
    each_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM each_ p JOIN each_ q ON p.x = q.x AND p.doc_id <> q.doc_id
              GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(p.n) + any_value(q.n) - count(*))), {_REACH}
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON node = doc_id""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, folder, "documents"), width=3, num=90, den=100)


@query("op4_sentencepiece")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back (a literal word mark as a space)."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").withColumn("_text", F.coalesce("text", F.lit("")))
    encoded = pieces.encode_pieces(docs, path, text_col="_text", keep="_text")
    decoded = pieces.decode_pieces(encoded, path, keep="_text")
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
                          (F.col("text") == F.translate("_text", "▁", " ")).alias("round_trip"))


@query("op5_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = langid.predict_and_reject(table(spark, folder, "documents"), ~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op8_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.groups_of_copies(table(spark, folder, "documents"), keep="largest")
    return found.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"),
                        F.lower(F.hex("_digest")).alias("text_sha256"))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op10_suffix_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_spans(table(spark, folder, "documents"))


@query("op11_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = align.align_tokens(table(spark, folder, "documents"), a, b)
    found = align.written_groups(aligned).withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    joined = found.drop("groups").join(align.link_statistics(aligned), "_row", "left")
    return joined.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links",
                         F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
                         F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256")


@query("op13_byte_bpe")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bytepairs.encode_bytes(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    decoded = bytepairs.decode_bytes(
        encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "ids"), ranks)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def _with_loops(docs: DataFrame) -> DataFrame:
    """The contract's texts: every tenth id, by hash, ends in a repetition of its own words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)")
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("looped"), F.floor(h / 10).alias("g"))
    some = rows.filter("looped").select("doc_id", words.alias("w"), "g").withColumn("n", F.size("w").cast("bigint"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    some = some.withColumn("a", a).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    changed = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.get("w", place(i).cast("int")))
    text = F.when(F.col("n") > 0, F.array_join(changed, " ")).otherwise("")
    return rows.filter("looped is null or not looped").select("doc_id", "text").unionByName(some.select("doc_id", text.alias("text")))


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.periodic_runs(_with_loops(table(spark, folder, "documents"))).withColumn("best", runs.strongest())
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    milli = F.expr("(1000 * best.length) div best.period")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
                        milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
