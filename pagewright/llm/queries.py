"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm._shared import fresh_path, read
from pagewright.llm.ann import build_index, search
from pagewright.llm.bpe import round_trip
from pagewright.llm.decontaminate import find_leaks
from pagewright.llm.language_id import learn, predict
from pagewright.llm.licenses import scan
from pagewright.llm.masked_lm import score, train
from pagewright.llm.minhash_dedup import near_duplicates
from pagewright.llm.sharding import Store
from pagewright.llm.substring_dedup import dedup_substrings
from pagewright.llm.url_filter import build, judge

ASCII_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth one, among all others."""
    vectors = read(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.where("vec_id % 100 = 0"), 10)


def op2_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document under a network trained on all of them."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every document and the text they decode to."""
    out = round_trip(read(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page's url."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, build(pages, URL_RULES))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (
  SELECT page_id, arg_max(h || q, length(h || q) * 4096 + length(h)) AS rule, arg_max(v, length(h || q) * 4096 + length(h)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand inside a ten-word window of a benchmark item."""
    out = find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({ASCII_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k
  FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0),
gram AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(1, len(w) - n + 2)) t(i)),
hit AS (SELECT doc_id, i, gram.n, item_id FROM gram JOIN win USING (n, k)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""


ARRIVALS = 11


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it stands in a store to which eleven arrivals were appended, after compaction."""
    store = Store(spark, fresh_path(spark, "store"))
    store.append(read(spark, sf_dir, "documents"), arrival=F.coalesce(F.pmod(F.col("doc_id"), F.lit(ARRIVALS)), F.lit(0)))
    store.compact()
    store.vacuum()
    return store.rows().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("text_sha256"))


OP6_SQL = "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents"


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document, and the number of paragraphs that name one."""
    return scan(read(spark, sf_dir, "documents")).select("doc_id", F.concat_ws(",", "families").alias("families"), "n_licensed", "probability")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.8 or more of their two-word shingles."""
    out = near_duplicates(read(spark, sf_dir, "documents"), width=2)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = r)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from two thirds of the labelled ones."""
    docs = read(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()).select("text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under 35-word windows that occur more than once, for every document."""
    out = dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, {SPACE_WORDS_SQL} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS k FROM d, unnest(range(1, len(w) - 33)) t(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(0, 35) s(j)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {
    "op1_ann": op1_ann,
    "op2_masked_lm": op2_masked_lm,
    "op3_bpe": op3_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_sharding": op6_sharding,
    "op7_licenses": op7_licenses,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_language_id": op9_language_id,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLE = {
    "op4_url_filter": OP4_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_sharding": OP6_SQL,
    "op8_minhash_dedup": OP8_SQL,
    "op10_substring_dedup": OP10_SQL,
}
