"""The operators' queries over the standard tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, learn(docs, _table(spark, sf_dir, "labels")))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeats

    return repeats(_table(spark, sf_dir, "documents"))


def op5_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idfiles import id_files

    return id_files(_table(spark, sf_dir, "documents"), vocabulary())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(_table(spark, sf_dir, "pages"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint

    return fingerprint(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), vocabulary())


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, formatted

    table = _table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) as conv_id", "cast(turn as bigint) as turn", "cast(role as string) as role", "cast(text as string) as text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], table.schema)
    return digests(formatted(table.unionByName(extra)))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_join, op2_mixing, op3_toxicity, op4_repeats, op5_id_files, op6_warc, op7_fingerprints, op8_bpe, op9_chat, op10_top_k)}


def oracle_sql() -> dict[str, str]:
    """What SQL can express: targets and the order of the mix, digests of pages and of turns, exact top-k."""
    return {
        "op2_mixing": r"""
            WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn,
                              CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
            src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
            n AS (SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM src),
            f AS (SELECT source, source_size, CASE place WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
                         CAST(3 * source_size AS DOUBLE) AS cap FROM n),
            g AS (SELECT *, cap / weight AS full_at, CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM f),
            h AS (SELECT *, row_number() OVER (ORDER BY full_at, source NULLS LAST) AS place,
                         sum(weight) OVER () - sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS UNBOUNDED PRECEDING) + weight AS left_weight,
                         sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS filled FROM g),
            v AS (SELECT *, (budget - filled) / left_weight AS level FROM h),
            l AS (SELECT arg_min(level, place) AS final FROM v WHERE level <= full_at),
            t AS (SELECT source, source_size, budget, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM v CROSS JOIN l),
            u AS (SELECT d.*, t.source_size, t.target, t.budget,
                         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
                  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
            k AS (SELECT u.*, c.k, CAST(u.upto + c.k * u.source_size AS DOUBLE) / u.target AS finish FROM u CROSS JOIN (VALUES (0), (1), (2)) AS c(k) WHERE u.size > 0),
            r AS (SELECT rid, size, budget, sum(size) OVER (ORDER BY finish, turn, doc_id, source, k, size ROWS UNBOUNDED PRECEDING) AS run FROM k),
            x AS (SELECT rid, CAST(sum(size) AS BIGINT) AS taken FROM r WHERE run <= budget GROUP BY rid)
            SELECT u.doc_id, u.size, u.source_size, u.target, coalesce(x.taken, 0) AS taken FROM u LEFT JOIN x ON u.rid = x.rid""",
        "op6_warc": """
            WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
            t AS (SELECT digest, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY digest)
            SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
                   CASE WHEN t.top IS NULL OR t.top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN t.top <> p.page_id THEN t.top END AS refers_to
            FROM p LEFT JOIN t ON p.digest = t.digest AND p.n >= 1000""",
        "op9_chat": r"""
            WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -1, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
            e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|startoftext\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2+\3', 'g') AS escaped FROM c)
            SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
                   CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
                   CAST(sum(12 + length(role) + 1 + length(escaped) + 11) AS BIGINT) AS formatted_chars, false AS rewrites
            FROM e GROUP BY conv_id""",
        "op10_top_k": """
            WITH v AS (
                SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
            s AS (
                SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                       CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
                WHERE q.vec_id % 100 = 0),
            r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    }
