"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from . import chat, decontamination, jaccard, lexical, licenses, merkle, neighbours, packing, quality, sharding, substrings, token_counts, token_files

SHARD_BYTES = 1 << 20


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, against a cache in which what was counted when there were only its English documents is stored."""
    docs, tokenizer, cache = _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), token_counts.new_cache(spark)
    token_counts.count_tokens(docs.filter("lang = 'en'"), tokenizer, cache, limit=1024)
    return token_counts.count_tokens(docs, tokenizer, cache, limit=1024)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licenses.labels_of(base).alias("base_labels"),
        licenses.labels_of(F.col("places")).alias("labels"),
        "score",
        "places",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), max_bytes=SHARD_BYTES)


OP6_SQL = f"""
WITH k AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents
), levels AS (
  SELECT d.depth, k.h >> (60 - d.depth) AS prefix, sum(k.n_bytes) AS bytes, min(k.h) = max(k.h) AS single
  FROM k, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth) d GROUP BY 1, 2
), fits AS (
  SELECT * FROM levels WHERE bytes <= {SHARD_BYTES} OR single OR depth = 60
), first AS (
  SELECT k.doc_id, k.n_bytes, min(f.depth) AS depth, k.h
  FROM k JOIN fits f ON f.prefix = k.h >> (60 - f.depth) GROUP BY k.doc_id, k.n_bytes, k.h
)
SELECT x.doc_id, x.n_bytes, CAST(x.depth AS INTEGER) AS shard_depth, x.h >> (60 - x.depth) AS shard_prefix,
       CAST(f.bytes AS BIGINT) AS shard_bytes, f.bytes > {SHARD_BYTES} AS oversize
FROM first x JOIN fits f ON f.depth = x.depth AND f.prefix = x.h >> (60 - x.depth)
"""


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
ig AS (SELECT DISTINCT item_id, least(5, len(w)) AS n, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents WHERE doc_id IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM d, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN ig USING (n, g) GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM found JOIN (SELECT item_id, count(*) AS item_shingles FROM ig GROUP BY 1) USING (item_id) WHERE shared >= 0.8 * item_shingles
"""


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(chat.repair(_read(spark, sf_dir, "conversations")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(_read(spark, sf_dir, "documents"), window=20)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"), n=3, threshold=Fraction(9, 10))


OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 2], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id, coalesce(l.n, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) r USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM both_ways GROUP BY 1) l USING (doc_id)
"""


def op11_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    token_files.write(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) GROUP BY 1, 2),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) SEMI JOIN i USING (t) GROUP BY 1, 2, 3),
df AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, stats GROUP BY t, docs),
gain AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS g FROM tf JOIN df USING (t), stats),
s AS (SELECT item_id, doc_id, CAST(sum(times * g) AS BIGINT) AS score FROM i JOIN gain USING (t) GROUP BY 1, 2 HAVING sum(times * g) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering: where 5 divides the CRC-32 of the id, A-Z of the text are offered in lower case."""
    text, fields = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), ("doc_id", "source", "lang", "n_chars", "text")
    offered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf([text if f == "text" else F.col(f) for f in fields]))
    found = merkle.manifest(_read(spark, sf_dir, "documents"), id_col="doc_id", group_col="source", fields=fields, offered=offered)
    return found.proofs.drop("path")


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(':' || source, '') AS g, {_leaf_sql("text")} AS leaf, {_leaf_sql(_LOWER.replace("coalesce(text, '')", "text"))} AS folded,
         flatten([[(ascii(c) >> k) & 1 for k in range(8)] for c in string_split(CAST(doc_id AS VARCHAR), '')]) AS bits
  FROM documents
), leaves AS (
  SELECT doc_id, g, leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n,
         CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 5 = 0 THEN folded ELSE leaf END AS offered
  FROM d
), node AS (
  SELECT 0 AS k, g, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT k + 1, g, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY k, g, pos // 16, n
), top AS (
  SELECT 0 AS k, g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), above AS (
  SELECT k, pos, n, h FROM top
  UNION ALL SELECT k + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY k, pos // 16, n
), levels AS (SELECT DISTINCT g, k FROM node WHERE n > 1),
steps AS (
  SELECT doc_id, leaf, l.k, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < p), '') AS a, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > p), '') AS b
  FROM (SELECT doc_id, leaf, g, k, pos // CAST(pow(16, k) AS BIGINT) AS p FROM leaves JOIN levels USING (g)) l JOIN node o ON o.g = l.g AND o.k = l.k AND o.pos // 16 = p // 16 GROUP BY ALL
), higher AS (
  SELECT g, l.k, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < p), '') AS a, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > p), '') AS b
  FROM (SELECT g, x.k, pos // CAST(pow(16, x.k) AS BIGINT) AS p FROM top, (SELECT DISTINCT k FROM above WHERE n > 1) x) l JOIN above o ON o.k = l.k AND o.pos // 16 = p // 16 GROUP BY ALL
), path AS (SELECT doc_id, leaf, list(a || '|' || b ORDER BY k) AS s FROM steps GROUP BY 1, 2),
path_up AS (SELECT g, list(a || '|' || b ORDER BY k) AS s FROM higher GROUP BY 1),
whole AS (
  SELECT doc_id, leaf, top.h AS subroot, (SELECT h FROM above WHERE n = 1) AS root, offered, list_concat(coalesce(path.s, []), coalesce(path_up.s, [])) AS s
  FROM leaves JOIN top USING (g) LEFT JOIN path USING (doc_id, leaf) LEFT JOIN path_up USING (g)
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(s, ''), '|', '')) AS proof_sha256,
       list_reduce(list_prepend(offered, s), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root,
       list_reduce(list_prepend(offered, s), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) = root AS verified
FROM whole
"""


def queries() -> dict:
    found = (
        op1_best_fit_packing,
        op2_token_counts,
        op3_nearest_neighbours,
        op4_quality_classifier,
        op5_license_scans,
        op6_sharding,
        op7_benchmark_decontamination,
        op8_chat_formatting,
        op9_substring_dedup,
        op10_ngram_jaccard_join,
        op11_token_id_files,
        op12_lexical_search,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_sharding": OP6_SQL, "op7_benchmark_decontamination": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op12_lexical_search": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
