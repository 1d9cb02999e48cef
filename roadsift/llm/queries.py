"""The registered queries of the corpus operators: thin digests of their results, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import overlap
from .exact_dedup import exact_duplicates
from .hard_negatives import mine
from .html_extract import extract_pages
from .langid import fit, predict
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix
from .near_dup import near_duplicates
from .packing import pack_documents
from .quality import judge
from .sharding import shard
from .tiered_search import search

#: Bytes of a shard of op5.
SHARD_BYTES = 1 << 20


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_read(spark, sf_dir, "documents"), carry=[]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text_clean").cast("long").alias("n_chars_clean"), F.sha2("text_clean", 256).alias("clean_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_read(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")


def held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    net = fit(docs, ~F.coalesce(held_out("doc_id"), F.lit(False)))
    return predict(docs, net).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "required_labels")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(_read(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 100 == 0, flip=F.col("vec_id") % 7 == 0)


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_exact_dedup, op2_packing, op3_html_extraction, op4_line_dedup, op5_sharding, op6_quality_rules, op7_language_id, op8_source_mixing, op9_minhash_near_dedup, op10_license_scan, op11_decontamination, op12_hard_negatives, op13_tiered_search)
    return {f.__name__: f for f in found}


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
       doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
"""

OP5_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
h AS (
  SELECT doc_id, n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || n_bytes::VARCHAR), 1, 15))::BIGINT AS hash FROM d),
b AS (
  SELECT k.k AS depth, hash >> (60 - k.k) AS prefix, sum(n_bytes)::BIGINT AS bytes, count(*)::BIGINT AS rows_, min(hash) = max(hash) AS equal
  FROM h, (SELECT unnest(range(0, 61)) AS k) k GROUP BY 1, 2),
s AS (
  SELECT h.doc_id, h.n_bytes, b.depth, b.prefix, b.bytes, b.rows_, rank() OVER (PARTITION BY h.doc_id, h.hash ORDER BY b.depth) AS n
  FROM h JOIN b ON b.prefix = h.hash >> (60 - b.depth) AND (b.bytes <= {SHARD_BYTES} OR b.equal))
SELECT doc_id, n_bytes, depth::INTEGER AS shard_depth, prefix AS shard_prefix, bytes AS shard_bytes, rows_ AS shard_rows, bytes <= {SHARD_BYTES} AS fits
FROM s WHERE n = 1
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
worded AS (
  SELECT r, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM worded GROUP BY r),
win AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
cover AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n_repeat_words
  FROM (SELECT win.r, unnest(range(win.i, win.i + 8)) AS p FROM win JOIN twice ON win.r = twice.r AND win.g = twice.g) GROUP BY r),
facts AS (
  SELECT d.r, doc_id, source, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup ON d.r = dup.r LEFT JOIN cover ON d.r = cover.r),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
often AS (
  SELECT d.source, worded.norm, count(DISTINCT d.text) AS n FROM worded JOIN d ON worded.r = d.r GROUP BY 1, 2),
frequent AS (
  SELECT often.source, norm FROM often JOIN hosts ON often.source IS NOT DISTINCT FROM hosts.source
  WHERE n > 20 AND (n > docs * 0.05::DOUBLE OR n > 10000)),
lost AS (
  SELECT worded.r, sum(worded.n)::BIGINT AS words FROM worded JOIN d ON worded.r = d.r
  JOIN frequent ON frequent.source IS NOT DISTINCT FROM d.source AND frequent.norm = worded.norm GROUP BY worded.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(words, 0) <= n_words * 0.5::DOUBLE AS kept,
       coalesce(words, 0)::BIGINT AS n_frequent_words
FROM facts LEFT JOIN lost ON facts.r = lost.r
"""

def _draw_sql(seed: int, *keys: str) -> str:
    return "('0x' || substr(md5('" + str(seed) + "'" + "".join(f" || '|' || coalesce(({k})::VARCHAR, '')" for k in keys) + "), 1, 15))::BIGINT"


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, {_draw_sql(17, "doc_id", "source", f"len({_WORDS})")} AS ord FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS w, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source),
g AS (SELECT *, [1, 2, 3][src % 3 + 1] AS wt, sum(w) OVER ()::BIGINT AS t FROM s),
-- targets: sources are full in the order of cap / weight until the level of the others is below the next ratio
q AS (
  SELECT *, coalesce(sum(3 * w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
         sum(wt) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
  FROM g WINDOW o AS (ORDER BY 3 * w / wt, src)),
lv AS (SELECT (t - caps)::DOUBLE AS left_, rest, 3 * w / wt AS ratio FROM q WHERE 3 * w / wt >= (t - caps) / rest ORDER BY ratio LIMIT 1),
tg AS (
  SELECT g.*, CASE WHEN 3 * w / wt < left_ / rest THEN (3 * w)::DOUBLE ELSE left_ * wt / rest END AS target FROM g, lv),
-- seats of 16 words by the highest quotients
k AS (SELECT src, w, t, target, unnest(range(0, (target / 16)::BIGINT + 3)) AS k FROM tg),
r AS (SELECT src, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, src) AS r, t FROM k),
st AS (SELECT src, count(*) AS seats FROM r WHERE r <= t // 16 GROUP BY src),
qt AS (
  SELECT tg.*, greatest(1, (n + 999) // 1000) AS shards,
         CASE WHEN least(coalesce(seats, 0), 3 * w // 16) > 0 THEN least(seats, 3 * w // 16) * 16 ELSE least(round_even(target, 0)::BIGINT, 3 * w) END AS quota
  FROM tg LEFT JOIN st ON st.src = tg.src),
p AS (
  SELECT d.*, qt.src, w, target, quota, {_draw_sql(18, "ord")} % shards AS shard FROM d JOIN qt ON qt.source IS NOT DISTINCT FROM d.source),
c AS (SELECT src, shard, sum(size)::BIGINT AS cell, max(quota) AS quota, CASE WHEN max(quota) >= 16 AND max(quota) % 16 = 0 THEN 16 ELSE 1 END AS unit FROM p GROUP BY 1, 2),
ck AS (SELECT *, unnest(range(0, cell * 3 // unit)) AS k FROM c),
cr AS (SELECT src, shard, quota // unit AS seats, row_number() OVER (PARTITION BY src ORDER BY cell / (2 * k + 1) DESC, shard) AS r FROM ck),
cs AS (SELECT src, shard, count(*) AS seats FROM cr WHERE r <= seats GROUP BY 1, 2),
cw AS (
  SELECT c.src, c.shard, cell, (coalesce(seats, 0) * unit)::BIGINT AS words,
         {_draw_sql(19, "c.src", "c.shard")} % greatest(1, ceil(cell / 16)::BIGINT) * 16 AS run
  FROM c LEFT JOIN cs ON cs.src = c.src AND cs.shard = c.shard),
e AS (
  SELECT p.*, cell, words, run, (sum(size) OVER (PARTITION BY p.src, p.shard ORDER BY ord, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
  FROM p JOIN cw ON cw.src = p.src AND cw.shard = p.shard),
x AS (SELECT *, stop - size AS start, CASE WHEN cell > 0 THEN words // cell ELSE 0 END AS passes, CASE WHEN cell > 0 THEN words % cell ELSE 0 END AS over FROM e)
SELECT doc_id, size, w AS source_size, target,
       (passes * size + greatest(0, least(run + over, cell, stop) - greatest(run, start)) + greatest(0, least(run + over - cell, stop) - start))::BIGINT AS taken
FROM x
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
edges AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, edges.b FROM reach r JOIN edges ON r.to_id = edges.a)
SELECT doc_id, n.n AS n_shingles, min(to_id) AS component_id, doc_id = min(to_id) AS kept
FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n.n
"""


_LOWER_WORDS, _WORD_TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms_sql(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms_sql(_LOWER_WORDS)} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_terms_sql(_LOWER_WORDS)} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda k: array_to_string(w[k:k + least(len(w), 10) - 1], ' '))) AS g
  FROM i WHERE len(w) > 0),
dw AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g
  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
m AS (SELECT r, p, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r
"""

OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM a JOIN v b ON a.r <> b.r),
p AS (SELECT a, anchor_id, b, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other, b) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, other, s.b)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms_sql(_WORD_TERMS)} AS w FROM documents),
g AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT r, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS r, item_id, {_terms_sql(_WORD_TERMS)} AS w FROM benchmark)),
f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM f GROUP BY t),
p AS (
  SELECT f.r, doc_id, f.t, floor(1000 * ln((2 * g.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf)::BIGINT // (1000 * tf + 20 * (50 + (50 * f.n * g.n)::BIGINT // l))) AS part
  FROM f JOIN df USING (t), g),
s AS (SELECT i.r AS i, item_id, p.r, doc_id, sum(part)::BIGINT AS score FROM i JOIN p USING (t) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op5_sharding": OP5_SQL, "op6_quality_rules": OP6_SQL, "op8_source_mixing": OP8_SQL, "op9_minhash_near_dedup": OP9_SQL, "op11_decontamination": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_tiered_search": OP13_SQL}
