"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelink.llm import bpe, chat, collocations, decontaminate, line_dedup, mixing, prefix_trie, quality_pu, quality_rules, simhash, suffix_dedup, toxicity, url_filters
from orelink.llm.common import crc_fold, table

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = chat.pieces(table(spark, sf_dir, "conversations"))
    return chat.format_conversations(groups, chat.fit(groups))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = crc_fold(F.col("doc_id"), 3)
    model = toxicity.train(toxicity.sample(docs, labels, "toxic", fold != 1))
    return toxicity.score(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "flagged")


def op5_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = crc_fold(F.col("doc_id"), 4)
    return quality_pu.score(docs, quality_pu.fitted(docs, labels, fold != 2)).select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select("doc_id", F.expr("quality = 0 or toxic = 1").alias("bad"))
    return url_filters.judge(url_filters.with_labels(table(spark, sf_dir, "pages"), labels))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), group=100, most=6).drop("start", "end")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=(3, 2), repeats=2)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, share=80, top=2000)


OP10_SQL = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS goes FROM keyed k LEFT JOIN frequent f ON f.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (goes))::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP11_SQL = """
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, max(pos) AS own, conv_id - conv_id % 100 AS base,
    -- crc32 of the decimal id: a byte is added to the sum, -1 shifts it by one bit
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 6 AS h FROM turns GROUP BY conv_id),
sizes AS (SELECT c.*, least(h, coalesce((SELECT max(pos) FROM turns t WHERE t.conv_id = c.base), 0)) AS m FROM crc c),
rebuilt AS (SELECT s.conv_id, pos - h + m AS depth, role, text FROM sizes s JOIN turns t ON t.conv_id = s.conv_id WHERE pos > h
    UNION ALL SELECT s.conv_id, pos, role, text FROM sizes s JOIN turns t ON t.conv_id = s.base WHERE pos <= m),
paths AS (SELECT conv_id, depth, length(text) AS chars, list(md5(md5(role) || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, [] FROM sizes),
ends AS (SELECT *, depth = m + greatest(0, own - h) AS last FROM paths JOIN sizes USING (conv_id)),
nodes AS (SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM ends GROUP BY path),
kids AS (SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.path[:n.depth] = n.path) AS n_children FROM nodes n)
SELECT a.conv_id, a.depth::BIGINT AS depth, (SELECT p.conv_id FROM nodes p WHERE p.depth = a.depth - 1 AND p.path = a.path[:a.depth - 1]) AS parent_conv_id, a.n_convs, a.n_children,
    (SELECT count(*) FROM kids b WHERE b.n_children = 0 AND b.depth >= a.depth AND b.path[:a.depth] = a.path) AS n_leaves,
    (SELECT sum((b.n_convs - 1) * b.chars)::BIGINT FROM kids b WHERE b.depth >= a.depth AND b.path[:a.depth] = a.path) AS saved_tokens, a.ends_sha256
FROM kids a
"""

OP12_SQL = """
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS size, coalesce('s' || source, 't') AS src,
    md5('mix/' || coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS key FROM documents),
sizes AS (SELECT src, sum(size)::BIGINT AS source_size FROM docs GROUP BY src),
weighed AS (SELECT *, 2 * source_size AS top, [5, 2, 1][1 + (row_number() OVER (ORDER BY src) - 1) % 3] AS weight FROM sizes),
filled AS (SELECT *, top / weight AS fills_at, sum(top) OVER w - top AS below, sum(weight) OVER () - sum(weight) OVER w + weight AS heft, 3 * sum(source_size) OVER () AS thrice FROM weighed WINDOW w AS (ORDER BY top / weight, src)),
level AS (SELECT (thrice - 2 * below)::DOUBLE AS rest, (2 * heft)::DOUBLE AS heft FROM filled WHERE top * 2.0 * heft >= (thrice - 2 * below) * weight ORDER BY fills_at, src LIMIT 1),
goals AS (SELECT src, source_size, least(top::DOUBLE, coalesce((SELECT rest * weight / heft FROM level), top::DOUBLE)) AS target FROM filled),
played AS (SELECT row_number() OVER () AS id, d.*, source_size, target, sum(size) OVER (PARTITION BY d.src ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM docs d JOIN goals g ON g.src = d.src),
packets AS (SELECT id, src, least(size, (packet + 1) * 1024) - packet * 1024 AS words, pass * source_size + upto - size + least(size, (packet + 1) * 1024) AS play, target
    FROM played, unnest([0, 1]) AS p(pass), unnest(range(0, (size + 1023) // 1024)) AS q(packet) WHERE size > 0),
line AS (SELECT *, sum(words) OVER (ORDER BY play / target, src, play ROWS UNBOUNDED PRECEDING)::BIGINT AS ends FROM packets),
cut AS (SELECT id, sum(greatest(0, least(words, (SELECT floor(3 * sum(source_size) / 2) FROM sizes) - (ends - words)))) AS taken,
    min(ends - words) FILTER (ends - words < (SELECT floor(3 * sum(source_size) / 2) FROM sizes)) AS starts FROM line GROUP BY id)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, CASE WHEN target > 0 THEN upto / target END AS finish, starts::BIGINT AS starts FROM played LEFT JOIN cut USING (id)
"""

OP13_SQL = """
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM texts),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1 AND f >= 30),
known AS (SELECT lang, phrase, f FROM counts WHERE f >= 30),
cuts AS (SELECT c.*, cut, array_to_string(w[:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM found c, unnest(range(1, k)) AS u(cut)),
scores AS (SELECT c.lang, c.phrase, c.k, a, p.f AS l, q.f AS r, ((2000000::HUGEINT * a) // (p.f + q.f))::BIGINT AS score, cut
    FROM cuts c JOIN known p ON p.lang = c.lang AND p.phrase = x JOIN known q ON q.lang = c.lang AND q.phrase = y),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT DISTINCT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, a AS longer FROM found, unnest([2, 3]) AS s(m), unnest([1, 2, 3]) AS o(i) WHERE m < k AND i + m - 1 <= k),
left_ AS (SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM inner_ h WHERE h.lang = c.lang AND h.phrase = c.phrase AND 100 * longer >= 80 * c.a))
SELECT c.lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_) c JOIN sizes s ON s.lang = c.lang WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = [op1_suffix_dedup, op2_chat_formatting, op3_simhash, op4_toxicity, op5_quality_pu, op6_quality_rules, op7_url_filters, op8_bpe, op9_decontamination, op10_line_dedup, op11_prefix_trie, op12_mixing, op13_collocations, pipeline]
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": url_filters.oracle(), "op10_line_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_mixing": OP12_SQL, "op13_collocations": OP13_SQL}
