"""Queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import derived, language_id, toxicity, url_lists
from corpusloom.llm.decontam import leaks
from corpusloom.llm.exact_dedup import exact_duplicates
from corpusloom.llm.mixing import mixed, ranked_weights
from corpusloom.llm.ngram_join import similarity_classes
from corpusloom.llm.prefix_trie import numbered_turns, prefix_trie, rebuilt_turns
from corpusloom.llm.sharding import placed
from corpusloom.llm.suffix_dedup import repeated_spans
from corpusloom.llm.tool_calls import linked_calls
from corpusloom.llm.warc import page_records, read_archive, write_archive
from corpusloom.llm.whitening import whitened
from corpusloom.sources.scratch import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Categories of the labels, in the order of the chain.
CATEGORIES = ["low_quality", "toxic"]


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, toxicity_labels(spark, sf_dir), CATEGORIES)
    return toxicity.scored(docs, chain, CATEGORIES)


SHARDS = [f"shard-{k:03d}" for k in range(64)]
SLOTS = 65_537


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return placed(docs, SHARDS, SLOTS, F.col("doc_id"), F.col("text")).select("doc_id", "slot", "shard")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_lists.judged(derived.captures(pages), derived.list_changes(pages))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    codes = language_id.train(docs, ~held_out)
    rows = language_id.identified(docs, codes)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = mixed(docs, ranked_weights(docs, [5, 2, 1]), max_epochs=3, seed=7)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = derived.tool_messages(_table(spark, sf_dir, "conversations"))
    return linked_calls(messages, derived.TOOLS)


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    write_archive(_table(spark, sf_dir, "pages"), path, date="2024-01-01T00:00:00Z", min_bytes=0)
    return page_records(read_archive(spark, path))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(_table(spark, sf_dir, "embeddings"), components=16)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = numbered_turns(_table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    taken = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie(*rebuilt_turns(turns, conv - conv % 5, taken, most=8))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_table(spark, sf_dir, "documents"), length=200)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_toxicity, op2_sharding, op3_decontamination, op4_exact_dedup, op5_url_lists, op6_language_id, op7_mixing,
        op8_tool_calls, op9_warc_archive, op10_ngram_join, op11_whitening, op12_prefix_trie, op13_suffix_dedup,
    )
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    return {"op4_exact_dedup": _OP4, "op5_url_lists": _OP5, "op7_mixing": _OP7, "op9_warc_archive": _OP9, "op12_prefix_trie": _OP12}


_OP4 = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), kept AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM kept
"""

_OP5 = r"""
WITH deeper AS (
  SELECT page_id, CASE WHEN ('0x' || substr(md5('deeper ' || page_id), 1, 8))::BIGINT % 3 = 0
                       THEN regexp_replace(url, '/*([?#].*)?$', '') || '/v1/en/Api/ref' ELSE url END AS url
  FROM pages
), parts AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
         lower(regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)', 1)) AS segment,
         lower(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]+)/[^/?#]+', 1)) AS folder,
         list_filter(string_split(lower(regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1)), '/'), lambda s: s <> '') AS segments,
         DATE '2024-01-01' + (('0x' || substr(md5('fetched ' || page_id), 1, 8))::BIGINT % 400)::INTEGER AS fetched
  FROM deeper
), named AS (
  SELECT DISTINCT unnest(['hosts', 'domains', 'paths', 'folders', 'top']) AS list,
         unnest([host, regexp_extract(host, '^[^.]+\.(.+)$', 1), CASE WHEN segment <> '' THEN host || '/' || segment ELSE '' END,
                 CASE WHEN folder <> '' THEN host || folder ELSE '' END, string_split(host, '.')[-1]]) AS target
  FROM parts
), lots AS (
  SELECT *, ('0x' || substr(md5(list || ' ' || target), 1, 8))::BIGINT % 36 AS lot,
         DATE '2024-01-01' + (('0x' || substr(md5('from ' || list || ' ' || target), 1, 8))::BIGINT % 300 - 20)::INTEGER AS begin_day,
         (('0x' || substr(md5('days ' || list || ' ' || target), 1, 8))::BIGINT % 120 + 1)::INTEGER AS last
  FROM named WHERE target <> ''
), changes AS (
  SELECT list, target, begin_day AS day, CASE WHEN lot % 3 = 0 THEN 'allow' ELSE 'block' END AS action FROM lots WHERE lot < 12
  UNION ALL SELECT list, target, begin_day + last, 'remove' FROM lots WHERE lot < 12 AND lot % 2 = 0
  UNION ALL SELECT list, target, begin_day + last * 2, CASE WHEN lot % 3 = 0 THEN 'block' ELSE 'allow' END FROM lots WHERE lot < 12 AND lot % 4 = 0
), spans AS (
  SELECT *, lead(day) OVER (PARTITION BY list, target ORDER BY day) AS until FROM changes
), covering AS (
  SELECT page_id, fetched, unnest(list_concat(
           list_transform(range(1, len(segments) + 1), lambda n: {'depth': -n, 'target': host || '/' || array_to_string(segments[1:n], '/')}),
           list_transform(range(1, len(string_split(host, '.')) + 1),
                          lambda n: {'depth': n, 'target': array_to_string(string_split(host, '.')[n:], '.')}))) AS c
  FROM parts
), verdicts AS (
  SELECT page_id, min({'depth': c.depth, 'lenient': action <> 'block', 'list': list, 'target': s.target, 'action': action}) AS best, count(*) AS active
  FROM covering JOIN spans s ON s.target = lower(c.target) AND action <> 'remove' AND fetched >= day AND (until IS NULL OR fetched < until)
  GROUP BY page_id
)
SELECT page_id, fetched, best.action AS action, best.list AS list, best.target AS target, coalesce(active, 0) AS active
FROM parts LEFT JOIN verdicts USING (page_id)
"""

# The level of the water is the first, by limit per weight, that clamps no further source.
_OP7 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '')) AS seeded
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), steps AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, sum(source_size) OVER ()::DOUBLE AS total,
         coalesce(sum(3 * source_size) OVER before, 0)::DOUBLE AS fixed,
         sum(weight) OVER after::DOUBLE AS free
  FROM sources
  WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), water AS (
  SELECT max((total - fixed) / free) AS level FROM steps
), targets AS (
  SELECT source, source_size, least(weight::DOUBLE * level, most) AS target,
         CASE WHEN source_size > 0 THEN floor(least(weight::DOUBLE * level, most) / source_size)::BIGINT ELSE 0 END AS whole
  FROM steps, water
), ordered AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY seeded, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND earlier + size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""

_OP9 = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM payloads
"""

# crc32 is folded bit by bit; a node's subtree is all nodes that its path leads on to.
_OP12 = """
WITH ids AS (
  SELECT conv_id, list_reduce(
           list_prepend(4294967295::UBIGINT, list_transform(range(len(conv_id::VARCHAR)), lambda i: ord((conv_id::VARCHAR)[i + 1])::UBIGINT)),
           lambda crc, c: list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda k: 0::UBIGINT)),
                                      lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS crc,
         list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
              ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(length(coalesce(role, '')), ' ', coalesce(role, ''), coalesce(text, '')))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), taking AS (
  SELECT *, (xor(crc, 4294967295::UBIGINT) % 9)::BIGINT AS h FROM ids
), rebuilt AS (
  SELECT t.conv_id, list_concat(list_slice(d.own, 1, t.h), list_slice(t.own, t.h + 1, len(t.own))) AS said
  FROM taking t LEFT JOIN ids d ON d.conv_id = t.conv_id - t.conv_id % 5
), prefixes AS (
  SELECT conv_id, len(said) AS total, unnest(range(len(said) + 1)) AS depth, said FROM rebuilt
), members AS (
  SELECT conv_id, depth, total, list_slice(said, 1, depth) AS path, CASE WHEN depth > 0 THEN strlen(said[depth].text) ELSE 0 END AS bytes FROM prefixes
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
         list(conv_id ORDER BY conv_id) FILTER (WHERE depth = total) AS ends
  FROM members GROUP BY path, depth
), children AS (
  SELECT list_slice(path, 1, depth - 1) AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path, depth)
), above AS (
  SELECT unnest(range(depth + 1)) AS up, path, n_children, saved FROM counted
), totals AS (
  SELECT list_slice(path, 1, up) AS path, up AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM above GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens,
       sha256(coalesce(array_to_string(n.ends, ','), '')) AS ends_sha256
FROM counted n JOIN totals t USING (path, depth)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = list_slice(n.path, 1, n.depth - 1) AND n.depth > 0
"""
