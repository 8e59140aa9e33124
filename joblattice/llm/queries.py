"""The operators of this subpackage as queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm import (
    benchmark_join,
    bpe_trie,
    id_files,
    line_runs,
    multi_index,
    near_dup,
    packing,
    quality,
    repeats,
    shards,
    turn_repair,
    turn_trie,
    va_file,
)
from joblattice.llm.common import Scratch
from joblattice.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op2_hashed_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shards.shuffle_to_shards(table(spark, sf_dir, "documents"), Scratch(spark).path("shards"))
    text = F.coalesce("text", F.lit(""))
    return written.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(shards.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("held_out", quality.held_out("doc_id"))


def op5_approximation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, end_id=0, capacity=2048)


def op7_line_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digests(table(spark, sf_dir, "documents"))


def op8_trie_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_trie.encoded_digests(table(spark, sf_dir, "documents"), path)


def op9_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return id_files.digests(id_files.write_and_read(table(spark, sf_dir, "documents"), path, end_id=1))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op11_radix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.nodes(turn_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_join.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digests(turn_repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {
    "op1_prob_minhash": op1_prob_minhash,
    "op2_hashed_extensions": op2_hashed_extensions,
    "op3_external_shuffle": op3_external_shuffle,
    "op4_support_vectors": op4_support_vectors,
    "op5_approximation_file": op5_approximation_file,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_suffixes": op7_line_suffixes,
    "op8_trie_encoding": op8_trie_encoding,
    "op9_bit_planes": op9_bit_planes,
    "op10_multi_index": op10_multi_index,
    "op11_radix_trie": op11_radix_trie,
    "op12_prefix_join": op12_prefix_join,
    "op13_hirschberg_repair": op13_hirschberg_repair,
}

# crc32 of an ASCII string ``said`` needs the list ``t`` of the 256 table entries, made by its rule
CRC_TABLE = """
    steps(i, k, c) AS (
        SELECT range, 0, range::BIGINT FROM range(256) UNION ALL
        SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
    ), crc AS (
        SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
    )
"""
CRC = """
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(said, ''), lambda x: ascii(x)::BIGINT)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)
"""

ORACLES: dict[str, str] = {
    "op5_approximation_file": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        ) WHERE rank <= 5
    """,
    "op7_line_suffixes": """
        WITH t AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), l AS (
            SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM t
        ), w AS (
            SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM l
        ), c AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY line, following ORDER BY doc_id, i) AS nth
            FROM w WHERE following IS NOT NULL
        ), g AS (
            SELECT doc_id, i FROM c WHERE nth > 1 UNION SELECT doc_id, i + 1 FROM c WHERE nth > 1
        ), m AS (
            SELECT l.*, g.i IS NOT NULL AS gone,
                   coalesce(lag(g.i IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.i), FALSE) AS before
            FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i
        )
        SELECT doc_id, count(*)::INTEGER AS n_lines, count(*) FILTER (gone)::INTEGER AS n_removed,
               count(*) FILTER (gone AND NOT before)::INTEGER AS n_runs,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op11_radix_trie": f"""
        WITH RECURSIVE {CRC_TABLE}, own AS (
            SELECT conv_id, list({{'id': id, 'chars': length(text)}} ORDER BY turn NULLS FIRST, id) AS turns, conv_id::VARCHAR AS said
            FROM (SELECT conv_id, turn, text, md5(length(role) || ':' || role || text) AS id
                  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations))
            WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), hashed AS (
            SELECT own.*, {CRC} % 6 AS h FROM own, crc
        ), rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
            FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
        ), prefixes AS (
            SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt
        ), members AS (
            SELECT conv_id, n, depth, array_to_string(list_transform(turns[1:depth], lambda x: x.id), '') AS node,
                   CASE WHEN depth = 0 THEN 0 ELSE turns[depth].chars END AS chars
            FROM prefixes
        ), nodes AS (
            SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                   sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
            FROM members GROUP BY node, depth
        ), children AS (
            SELECT left(node, 32 * (depth - 1)::INTEGER) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
        ), counted AS (
            SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.node = c.node
        ), summed AS (
            SELECT left(node, 32 * i::INTEGER) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
            FROM (SELECT *, unnest(range(depth + 1)) AS i FROM counted) GROUP BY 1
        )
        SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves::BIGINT AS n_leaves,
               s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
        FROM counted c JOIN summed s ON c.node = s.node
        LEFT JOIN nodes p ON c.depth > 0 AND p.node = left(c.node, 32 * (c.depth - 1)::INTEGER)
    """,
    "op12_prefix_join": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), placed AS (
            SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0
        ), windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS said FROM placed
        ), lengths AS (
            SELECT DISTINCT n FROM windows
        ), runs AS (
            SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths
        ), found AS (
            SELECT r.doc_id, r.i, r.n, x.item_id
            FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS said FROM runs) r JOIN windows x ON r.n = x.n AND r.said = x.said
        ), hit AS (
            SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
    """,
    "op13_hirschberg_repair": f"""
        WITH RECURSIVE {CRC_TABLE}, said AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS said FROM conversations
        ), faulty AS (
            SELECT said.*, {CRC} % 20 AS fault FROM said, crc
        ), rows AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM faulty
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM rows
        ), judged AS (
            SELECT *, CASE WHEN shown = '' THEN 'blank'
                           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                           WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS earlier
            FROM placed
        ), reports AS (
            SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (earlier IS NOT NULL AND left(earlier, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
                   count(i) AS n
            FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON c.conv_id IS NOT DISTINCT FROM j.conv_id GROUP BY c.conv_id
        ), best(conv_id, i, v) AS (
            -- for each state (1 nothing, 2 system, 3 user, 4 assistant) the least edits of the rows after row i
            SELECT conv_id, n, [{{'cost': 0, 'audit': '', 'kept': ''}},
                                {{'cost': 6, 'audit': 'II', 'kept': chr(10) || 'user:' || chr(10) || 'assistant:'}},
                                {{'cost': 3, 'audit': 'I', 'kept': chr(10) || 'assistant:'}}, {{'cost': 0, 'audit': '', 'kept': ''}}]
            FROM reports
            UNION ALL
            SELECT conv_id, i - 1, list_transform([1, 2, 3, 4], lambda s: list_sort([
                edited[s],
                {{'cost': 3 + edited[after[s]].cost, 'audit': 'I' || edited[after[s]].audit,
                  'kept': chr(10) || named[after[s]] || ':' || edited[after[s]].kept}},
                {{'cost': 6 + edited[after[after[s]]].cost, 'audit': 'II' || edited[after[after[s]]].audit,
                  'kept': chr(10) || named[after[s]] || ':' || chr(10) || named[after[after[s]]] || ':' || edited[after[after[s]]].kept}}])[1])
            FROM (
                SELECT conv_id, i, after, named, list_transform([1, 2, 3, 4], lambda s: list_sort(list_filter([
                    {{'cost': 4 + v[s].cost, 'audit': 'D' || v[s].audit, 'kept': v[s].kept}},
                    CASE WHEN open AND legal[s] = initial OR open AND s = 1 AND initial = 's' THEN
                        {{'cost': more + v[strpos(' sua', initial)].cost, 'audit': 'K' || v[strpos(' sua', initial)].audit,
                          'kept': chr(10) || role || ':' || text || v[strpos(' sua', initial)].kept}} END,
                    CASE WHEN open THEN
                        {{'cost': 3 + more + v[after[s]].cost, 'audit': 'R' || v[after[s]].audit,
                          'kept': chr(10) || named[after[s]] || ':' || text || v[after[s]].kept}} END
                ], lambda x: x IS NOT NULL))[1]) AS edited
                FROM (
                    SELECT b.conv_id, b.i, b.v, j.role, j.text, left(j.role, 1) AS initial, j.fault NOT IN ('blank', 'duplicate') AS open,
                           CASE WHEN j.fault = 'truncated' THEN 3 ELSE 0 END AS more,
                           [3, 3, 4, 3] AS after, ['u', 'u', 'a', 'u'] AS legal, ['', '', 'user', 'assistant'] AS named
                    FROM best b JOIN judged j ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND b.i = j.i
                )
            )
        )
        SELECT r.conv_id, gaps, blank, duplicate, truncated, illegal, v[1].cost::BIGINT AS cost, v[1].audit AS audit,
               sha256(substr(v[1].kept, 2)) AS repaired_sha256
        FROM reports r JOIN best b ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 0
    """,
}
