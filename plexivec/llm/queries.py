"""The queries of this subpackage and, where SQL can state them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexivec.llm.conversation_trie import conversation_trie
from plexivec.llm.decontaminate import find_items
from plexivec.llm.exact_dedup import exact_dedup
from plexivec.llm.language import held_out, identify_language, learn_profiles
from plexivec.llm.licenses import scan_licences
from plexivec.llm.line_dedup import dedup_lines
from plexivec.llm.mixing import served
from plexivec.llm.near_dedup import near_duplicates
from plexivec.llm.packing import pack_documents
from plexivec.llm.quality import fit_scorer, score_quality
from plexivec.llm.token_shards import token_manifest
from plexivec.llm.urls import fit_url_model, judge_urls
from plexivec.llm.vector_codes import vector_codes
from plexivec.sources.tables import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    profiles = learn_profiles(docs.filter(~F.col("held_out")))
    return identify_language(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op2_token_shards(spark: SparkSession, sf_dir: str, tokenizer_path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    return token_manifest(table(spark, sf_dir, "documents"), tokenizer_path)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit_scorer(docs)).select("doc_id", "quality", "kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, fit_url_model(spark)).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = served(table(spark, sf_dir, "documents"))
    one = pieces.groupBy("doc_id", "source", "seq").agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"))
    return one.select("doc_id", "size", "source_size", "target", "taken")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n_words=2, percent=80).drop("text_hash")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("word_bpe_49k.json")).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_shards": op2_token_shards,
    "op3_line_dedup": op3_line_dedup,
    "op4_licences": op4_licences,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_decontaminate": op7_decontaminate,
    "op8_source_mix": op8_source_mix,
    "op9_near_dedup": op9_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_packing": op13_packing,
}


def _crc32_sql(text: str) -> str:
    """DuckDB's expression for the CRC-32 of an ASCII string, bit by bit."""
    byte = "list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(a, x))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), lambda a, x: {byte}, 4294967295::BIGINT), 4294967295)"


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds one after the other, every part against every entry; whole numbers in doubles are exact here."""
    width = f"(SELECT max(len(v)) // {parts} FROM k)"
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024::DOUBLE * x)) AS v FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))",
        f"x AS MATERIALIZED (SELECT vec_id, label, p::INT AS p, v[p * {width} + 1 : (p + 1) * {width}]::DOUBLE[] AS y FROM k, range({parts}) r(p))",
        f"c0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::INT AS e, y FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT x.vec_id, x.p, c.e, list_inner_product(x.y, x.y) - 2 * list_inner_product(x.y, c.y) + list_inner_product(c.y, c.y) AS d FROM x JOIN c{i} c ON x.p = c.p)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, p, min(d)::BIGINT AS d, arg_min(e, d * 256 + e) AS e FROM d{i} GROUP BY ALL)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT p, e, i, floor(sum(z) / count(*)) AS m FROM (SELECT a.p, a.e, unnest(x.y) AS z, generate_subscripts(x.y, 1) AS i FROM a{i} a JOIN x USING (vec_id, p)) GROUP BY ALL)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.y, c.y) AS y FROM c{i} c LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS y FROM s{i} GROUP BY ALL) m ON c.p = m.p AND c.e = m.e)")
    steps.append(f"h AS (SELECT sha256(string_agg(list_aggregate(list_transform(y, lambda z: (z::BIGINT)::VARCHAR), 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})")
    steps.append(f"o AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN k USING (vec_id), h"


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, trim({_LOWER.format('line')}, {_BLANK}) AS key FROM e),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op8_source_mix": """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
p AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS stops FROM w),
q AS (SELECT *, coalesce(sum(most) OVER u, 0) AS full_, sum(weight) OVER () - coalesce(sum(weight) OVER u, 0) AS left_, sum(source_size) OVER ()::DOUBLE AS total
  FROM p WINDOW u AS (ORDER BY stops, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total * 1.5::DOUBLE - full_) / left_ AS level FROM q),
v AS (SELECT *, max(CASE WHEN stops > level THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL OR stops <= water THEN most ELSE weight * water END AS target FROM v),
o AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || doc_id::VARCHAR), doc_id))::BIGINT - size AS before FROM d)
SELECT doc_id, size, source_size, target,
  (least(size, greatest(floor(target)::BIGINT - before, 0)) + least(size, greatest(floor(target)::BIGINT - source_size - before, 0)))::BIGINT AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source""",
    "op9_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 2 THEN [w[1]]
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM x),
e AS (SELECT doc_id, unnest(s) AS sh FROM x),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN m USING (doc_id)""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, (count(*) OVER g)::BIGINT AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    # the trie by prefixes as lists; a subtree by the walks of its nodes' smallest conversations
    "op11_conversation_trie": f"""
WITH t AS (SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(said ORDER BY pos) AS own FROM t GROUP BY c),
h AS (SELECT *, c - c % 20 AS b, {_crc32_sql('c::VARCHAR')} % 4 AS h FROM o),
w AS (SELECT h.c, list_concat(coalesce(z.own[1:h.h], []), h.own[h.h + 1:]) AS seq FROM h LEFT JOIN o z ON z.c = h.b),
m AS MATERIALIZED (SELECT c, d, len(seq) AS n, seq[1:d] AS node FROM w, unnest(range(len(seq) + 1)) r(d)),
v AS MATERIALIZED (SELECT node, any_value(d) AS depth, count(*) AS n_convs, min(c) AS conv_id,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n), '') AS ends, node[:-2] AS parent FROM m GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY parent),
i AS MATERIALIZED (SELECT v.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent_conv_id,
    CASE WHEN v.depth = 0 THEN 0 ELSE (v.n_convs - 1) * len(regexp_extract_all(v.node[-1].t, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM v LEFT JOIN k ON k.node = v.node LEFT JOIN v p ON v.depth > 0 AND p.node = v.parent),
s AS (SELECT m.node, sum(i.saved)::BIGINT AS saved_tokens, (count(*) FILTER (WHERE i.n_children = 0))::BIGINT AS n_leaves FROM i JOIN m ON m.c = i.conv_id AND m.d <= i.depth GROUP BY m.node)
SELECT i.conv_id, i.depth::BIGINT AS depth, i.parent_conv_id, i.n_convs::BIGINT AS n_convs, i.n_children::BIGINT AS n_children, s.n_leaves, s.saved_tokens, sha256(i.ends) AS ends_sha256
FROM i JOIN s ON s.node = i.node""",
    "op12_vector_codes": _codes_sql(),
}
