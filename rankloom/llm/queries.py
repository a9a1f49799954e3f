"""One query for each training-data operator, over its whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import alignment, chat, collocations, decontamination, exact_dedup, html_text, language_id, passage_dedup, piece_codec, quality, simhash, token_counts, warc
from rankloom.llm.common import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "exact")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.formatted_conversations(rows))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_exact_dedup,
        op3_token_counts,
        op4_decontamination,
        op5_passage_dedup,
        op6_simhash,
        op7_warc,
        op8_html_text,
        op9_piece_codec,
        op10_chat,
        op11_collocations,
        op12_alignment,
        op13_quality,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
             g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g
    """,
    "op4_decontamination": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
             i AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
             iw AS (SELECT item_id, w[s : s + least(13, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0)),
             lens AS (SELECT DISTINCT len(win) AS n FROM iw),
             dw AS (SELECT r, p, n, w[p : p + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
             m AS (SELECT dw.r, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win),
             h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
             t AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
    """,
    "op10_chat": r"""
        WITH c AS (SELECT conv_id, turn, role, text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
             t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
             e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?(?:INST|SYS|ROLE)\])', '[\\\1\2', 'g') AS shown FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
               CAST(sum(length(shown) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11 ELSE 14 + 2 * octet_length(encode(role)) END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op11_collocations": rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
             s AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
             g AS (SELECT lang, w[p : p + k - 1] AS w FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM s, range(1, 5) AS q(k) WHERE len(w) >= k)),
             f AS (SELECT lang, w, count(*) AS a FROM g GROUP BY lang, w HAVING count(*) >= 30),
             n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM s GROUP BY lang),
             c AS (SELECT lang, w, a, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
             x AS (SELECT c.lang, c.w, c.a, k, l.a AS l, r.a AS r, 2000000::HUGEINT * c.a // (l.a::HUGEINT + r.a) AS score
                   FROM c JOIN f l ON l.lang = c.lang AND l.w = c.w[1 : k] JOIN f r ON r.lang = c.lang AND r.w = c.w[k + 1 : len(c.w)]),
             b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
             i AS (SELECT lang, w[p : p + m - 1] AS w, max(a) AS outer_a FROM (SELECT lang, w, a, m, unnest(range(1, len(w) - m + 2)) AS p FROM f, range(2, 4) AS q(m) WHERE len(w) > m) GROUP BY ALL),
             o AS (SELECT b.*, array_to_string(b.w, ' ') AS phrase FROM b LEFT JOIN i ON i.lang = b.lang AND i.w = b.w WHERE outer_a IS NULL OR 100::HUGEINT * outer_a < 80::HUGEINT * a),
             z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
        SELECT z.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
             q AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS s FROM p),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY s, n) AS keep FROM q)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest, CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to
        FROM g
    """,
}
