"""The operators' queries over the whole of their tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectloom.llm import embedding_dedup, fill_in_middle, language_id, line_dedup, merkle, minhash_dedup, mixing, mpeg_audio, packing, sstable, token_counts, url_filter, word_table
from defectloom.llm.common import ascii_lower, table

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.carried_texts(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_tables(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), shown={"text": text})


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = word_table.encode(table(spark, sf_dir, "documents"), decoded=True)
    return x.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    lengths = [F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return out.select("doc_id", F.col("n_units").alias("n"), "form", *lengths, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_url_filter, op3_mpeg_audio, op4_minhash_dedup, op5_mixing, op6_line_dedup, op7_packing, op8_token_tables, op9_embedding_dedup, op10_language_id, op11_merkle_manifest, op12_bpe_codec, op13_fill_in_middle)
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_url_filter"] = r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id
"""

ORACLE_SQL["op6_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT doc_id, pos, line, shared.key IS NOT NULL AND doc_id <> first AS dropped
  FROM keyed LEFT JOIN shared ON keyed.key = shared.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE_SQL["op4_minhash_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS s
  FROM w
), sizes AS (
  SELECT doc_id, len(s)::BIGINT AS n FROM sets
), one AS (
  SELECT doc_id, unnest(s) AS shingle FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(id, c) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT b, c FROM reach JOIN ways ON a = id WHERE c < b
)
SELECT doc_id, n AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM sizes JOIN reach ON id = doc_id GROUP BY doc_id, n
"""

ORACLE_SQL["op9_embedding_dedup"] = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), ways AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), counts AS (
  SELECT a, count(*) AS n FROM ways GROUP BY a
), reach(id, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT b, c FROM reach JOIN ways ON a = id WHERE c < b
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
FROM embeddings JOIN reach ON id = vec_id LEFT JOIN counts ON a = vec_id GROUP BY vec_id, n
"""

ORACLE_SQL["op13_fill_in_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents
), d AS (
  SELECT *, length(t)::BIGINT AS n,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

ORACLE_SQL["op11_merkle_manifest"] = r"""
WITH RECURSIVE crcs AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM range(256) r(i)
  )
), keyed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
                lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]))) % 3 = 0 AS tampered,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents, crcs
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || CASE WHEN tampered THEN coalesce(strlen(low) || ':' || low, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS shown
  FROM keyed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), tree(lang, level, i, h, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), count(*) OVER (PARTITION BY lang) FROM tree WHERE n > 1 GROUP BY lang, level, i // 8
), subroots AS (
  SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM tree WHERE n = 1
), crown(level, i, h, n) AS (
  SELECT 0, g, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), count(*) OVER () FROM crown WHERE n > 1 GROUP BY level, i // 8
), whole AS (
  SELECT subroots.g, tree.level, i, h, i // 8 AS run, tree.n > 1 AS grows FROM tree JOIN subroots ON tree.lang IS NOT DISTINCT FROM subroots.lang
), runs AS (
  SELECT g, level, run, list(h ORDER BY i) AS hs FROM whole WHERE grows GROUP BY g, level, run
), crown_runs AS (
  SELECT level, i // 8 AS run, list(h ORDER BY i) AS hs FROM crown WHERE n > 1 GROUP BY level, i // 8
), walk(doc_id, leaf, shown, g, height, level, spot, node, others) AS (
  SELECT doc_id, leaf, shown, g, height, 0, pos, shown, '' FROM placed JOIN subroots ON placed.lang IS NOT DISTINCT FROM subroots.lang
  UNION ALL
  SELECT doc_id, leaf, shown, walk.g, height, walk.level + 1,
         CASE WHEN walk.level + 1 = height THEN walk.g ELSE spot // 8 END,
         sha256(array_to_string(list_concat(list_concat(r.hs[:spot % 8], [node]), r.hs[spot % 8 + 2:]), '')),
         others || array_to_string(list_concat(r.hs[:spot % 8], r.hs[spot % 8 + 2:]), '')
  FROM walk JOIN runs r ON r.g = walk.g AND r.level = walk.level AND r.run = spot // 8 WHERE walk.level < height
), climb(doc_id, leaf, shown, g, level, spot, node, others) AS (
  SELECT doc_id, leaf, shown, g, 0, g, node, others FROM walk WHERE level = height
  UNION ALL
  SELECT doc_id, leaf, shown, g, climb.level + 1, spot // 8,
         sha256(array_to_string(list_concat(list_concat(r.hs[:spot % 8], [node]), r.hs[spot % 8 + 2:]), '')),
         others || array_to_string(list_concat(r.hs[:spot % 8], r.hs[spot % 8 + 2:]), '')
  FROM climb JOIN crown_runs r ON r.level = climb.level AND r.run = spot // 8
), root AS (
  SELECT h AS root FROM crown WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, sha256(others) AS proof_sha256, node AS folded_root, node = root AS verified
FROM climb JOIN subroots USING (g), root WHERE climb.level = (SELECT max(level) FROM crown)
"""
