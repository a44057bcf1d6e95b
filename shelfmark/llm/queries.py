"""The operators of this subpackage as registered queries over whole tables, with their SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    bpe, exact_dedup, hard_negatives, lexical, line_dedup, mixing, near_dedup, quality, sharding, token_counts, token_files, toxicity, warc,
)
from shelfmark.session import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Token shares that the mixing query aims at, by domains that come from the labels.
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a label table."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def fit_split(identity: Column) -> Column:
    """Ids whose labels quality limits may be fitted on: those that toxicity may use, too."""
    return F.crc32(identity.cast("string").cast("binary")) % 3 != 1


@query(
    "op1_near_dedup",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
             ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
    sized AS (SELECT doc_id, s, len(s) AS n, list_sort(s) AS key FROM sets),
    classes AS (SELECT key, n, min(doc_id) AS rep FROM sized WHERE n > 0 GROUP BY key, n),
    shingles AS (SELECT rep, n, unnest(key) AS g FROM classes),
    pairs AS (SELECT a.rep AS x, b.rep AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.rep < b.rep
              AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
              GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
    reach AS (SELECT rep AS x, rep AS y FROM classes UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
    least_of AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
    SELECT sized.doc_id, CAST(sized.n AS BIGINT) AS n_shingles, coalesce(c, sized.doc_id) AS component_id,
           coalesce(c, sized.doc_id) = sized.doc_id AS kept
    FROM sized LEFT JOIN classes ON sized.key = classes.key AND sized.n = classes.n LEFT JOIN least_of ON least_of.x = classes.rep""",
)
def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_components(table(spark, sf_dir, "documents"), words=2, percent=80)


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    third = F.crc32(F.col("id").cast("string").cast("binary")) % 3
    model = toxicity.fit(docs, labels, usable=third != 1)
    scored = toxicity.toxicity(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op3_mixing")
def op3_mixing(spark, sf_dir):
    found = mixing.mixing_rates(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS)
    chances = [F.coalesce(F.col("chances")[d], F.lit(0.0)).alias(f"p_{d}") for d in sorted(TARGETS)]
    return found.select("doc_id", "n_tokens", *chances, "rate", "copies")


@query(
    "op4_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    plain AS (SELECT doc_id, i, line, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS p FROM lines),
    shaped AS (SELECT doc_id, i, line, regexp_replace(p, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS s FROM plain),
    leafed AS (SELECT *, string_split(s, ' ') AS t FROM shaped WHERE s <> ''),
    held AS (SELECT DISTINCT doc_id, s, t, len(t) AS n, array_to_string(t[1:4], ' ') AS head FROM leafed),
    shapes AS (SELECT s, t, n, head, count(*) AS held_by FROM held GROUP BY s, t, n, head),
    tokens AS (SELECT s, n, head, held_by, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM shapes),
    constant AS (SELECT n, head, pos, token FROM tokens WHERE token <> '<*>' GROUP BY n, head, pos, token HAVING sum(held_by) >= 3),
    patterns AS (
      SELECT s, n, head, string_agg(CASE WHEN c.token IS NULL THEN '<*>' ELSE c.token END, ' ' ORDER BY tokens.pos) AS pattern
      FROM tokens LEFT JOIN constant c USING (n, head, pos, token) GROUP BY s, n, head HAVING 100 * count(c.token) >= 50 * n),
    recurring AS (SELECT pattern, n, head FROM held JOIN patterns USING (s, n, head) GROUP BY pattern, n, head HAVING count(DISTINCT doc_id) >= 3),
    gone AS (SELECT DISTINCT s FROM patterns JOIN recurring USING (pattern, n, head))
    SELECT d.doc_id, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_dropped, 0) AS n_dropped, sha256(coalesce(a.rest, d.text, '')) AS text_sha256
    FROM documents d LEFT JOIN (
      SELECT doc_id, count(*) FILTER (s <> '') AS n_lines, count(gone.s) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.s IS NULL), '') AS rest
      FROM shaped LEFT JOIN gone USING (s) GROUP BY doc_id) a USING (doc_id)""",
)
def op4_line_dedup(spark, sf_dir):
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op5_quality")
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    limits = quality.fit(docs, table(spark, sf_dir, "labels"), usable=fit_split(F.col("id")))
    found = quality.judged(docs, keep=["doc_id"], limits=limits)
    names = [*quality.COUNTS, "base_failed", "kept", "ratio", "n_chunks", "bad_chunks"]
    return found.select("doc_id", *(F.col(f"quality_{name}").alias(name) for name in names))


@query("op6_bpe")
def op6_bpe(spark, sf_dir):
    found = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op8_warc",
    r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    k AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id < last THEN last END AS refers_to FROM k""",
)
def op8_warc(spark, sf_dir):
    found = warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_token_files")
def op9_token_files(spark, sf_dir):
    found = token_files.token_round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query(
    "op10_exact_dedup",
    r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
)
def op10_exact_dedup(spark, sf_dir):
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op11_sharding",
    r"""
    WITH powers AS (
      SELECT list(v ORDER BY b) AS crc FROM (
        SELECT b, list_reduce(list_prepend(b, generate_series(1, 8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(generate_series(0::BIGINT, 255::BIGINT)) AS b))),
    d AS (
      SELECT *, coalesce('=' || source, '') AS s, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST, text NULLS FIRST) - 1 AS r, count(*) OVER (PARTITION BY s) AS n FROM d),
    line AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n), n, s) - 1 AS g, count(*) OVER () AS total FROM ranked)
    SELECT doc_id, CAST(len(bytes) + 8 AS BIGINT) AS size,
           xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS text_crc32,
           'rows' AS law, CAST(g * 24 // total AS INTEGER) AS shard, CAST(g - (g * 24 // total * total + 23) // 24 AS BIGINT) AS slot,
           CAST(NULL AS INTEGER) AS grown_shard
    FROM line, powers""",
)
def op11_sharding(spark, sf_dir):
    found = sharding.write_shards(table(spark, sf_dir, "documents"), work_folder(spark, "shards"), shards=24)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return found.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op12_hard_negatives",
    r"""
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.c) = len(b.c) WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3""",
)
def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    asked = rows.select(
        F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.whole_components(F.col("embedding")).alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor")
    )
    return hard_negatives.hard_negatives(asked)


@query(
    "op13_lexical_search",
    r"""
    WITH t AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    i AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
    whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM d),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t SEMI JOIN i USING (term) GROUP BY doc_id, term),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs),
    part AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l))) AS part FROM tf JOIN w USING (term) JOIN d USING (doc_id), whole),
    s AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM i JOIN part USING (term) GROUP BY item_id, doc_id HAVING sum(part) > 0)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
)
def op13_lexical_search(spark, sf_dir):
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
