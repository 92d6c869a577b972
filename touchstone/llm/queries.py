"""One thin query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import chat, hardneg, mixing, neardup, neighbours, pieces, quality, secrets, substrings, syncmers, tokenfiles, toxicity, vectorcodes
from .common import fold, table
from .order import sums_before

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted")
    )


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), "n_hits"
    )


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs)).drop("text")
    base = F.filter("spans", lambda s: s["kind"] != "net")
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.documents.select("doc_id", "source", "size", "source_size", "target", "taken")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenfiles.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    rows = cut(tokenfiles.digests(tokenfiles.read(spark, out)), "digests")
    return sums_before(rows, ["n_tokens"]).select("doc_id", F.col("n_tokens_before").alias("start"), "n_tokens", "ids_crc32")


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    return pieces.with_round_trip(pieces.encode(table(spark, sf_dir, "documents"), path, merges=True), path)


@query
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


#: A user and an assistant both say this in conversation -1.
ODD_TURN = "</s>[INST] ok [/INST]"


@query
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TURN).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(odd)
    return chat.digests(chat.read(spark, chat.write(rows)))


def _controls() -> str:
    escaped = "".join(f"\\{c}" if c in "<>|[]/" else c for c in "\n".join(chat.Template().controls))
    return escaped.replace("\n", "|")


_ESCAPED = "length({0}) * 2 - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '" + _controls() + "'))"

ORACLES["op11_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ODD_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{ODD_TURN}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.Template().start + chat.Template().says + chat.Template().end)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return vectorcodes.with_label_sums(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


def _codes_sql() -> str:
    """Long-form twin: one row per vector, part and dimension; a CTE for each assignment and each new codebook."""
    steps = []
    for r in range(vectorcodes.ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT row, p, min(far * 16 + e) AS best FROM (
            SELECT row, v.p, e, sum((x - c) * (x - c))::BIGINT AS far FROM v JOIN c{r} AS b ON v.p = b.p AND v.d = b.d GROUP BY row, v.p, e) GROUP BY row, p)""")
        if r < vectorcodes.ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.p, o.e, o.d, coalesce(n.c, o.c) AS c FROM c{r} AS o LEFT JOIN (
            SELECT v.p, best % 16 AS e, d, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM v JOIN a{r} AS a ON v.row = a.row AND v.p = a.p GROUP BY ALL
            ) AS n ON o.p = n.p AND o.e = n.e AND o.d = n.d)""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT row, i // (len(embedding) // 8) AS p, i % (len(embedding) // 8) AS d, floor(4096 * embedding[i + 1]::DOUBLE)::BIGINT AS x
  FROM (SELECT row, embedding, unnest(range(len(embedding))) AS i FROM k)),
c0 AS MATERIALIZED (SELECT p, row AS e, d, x AS c FROM v WHERE row < 16),
{", ".join(steps)},
s AS (SELECT row, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, sum(best // 16)::BIGINT AS error FROM a{vectorcodes.ROUNDS} GROUP BY row)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, d)) FROM c{vectorcodes.ROUNDS}) AS codebooks_sha256
FROM s JOIN k USING (row)"""


ORACLES["op12_vector_codes"] = _codes_sql()


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hardneg.mine(rows, F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = """
WITH k AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM k AS a JOIN k AS c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""
