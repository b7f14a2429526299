"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from crawlmill.llm import sharding

_DIGITS, _SPAN = sharding.DIGITS, float(1 << 4 * sharding.DIGITS)


def _hash(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {_DIGITS}) AS BIGINT)"


def _score(s: int) -> str:
    return f"-1.0 / ln(({_hash(f'''key || '/{s}' ''')} + 0.5) / {_SPAN:.1f})"


def _shard(n: int) -> str:
    scores = ", ".join(_score(s) for s in range(n))
    return f"CAST(list_position([{scores}], list_max([{scores}])) - 1 AS INTEGER)"


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
_BYTES = "list_transform(range(1, length(digits) + 1, 2), lambda i: CAST('0x' || substr(digits, i, 2) AS BIGINT))"
_CRC = f"xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"

SQL = {
    "op10_rendezvous_sharding": f"""
WITH table_ AS (SELECT {_CRC_TABLE} AS steps),
base AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS digits, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
dealt AS (SELECT *, {_hash('key')} AS h, {_shard(sharding.SHARDS)} AS shard, {_shard(sharding.SHARDS + 1)} AS grown_shard FROM base)
SELECT doc_id, size, CAST({_CRC} AS BIGINT) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, grown_shard FROM dealt, table_
""",
    "op5_recompression_dedup": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
first AS (SELECT key, min(doc_id) AS least FROM windows GROUP BY key HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM windows JOIN first USING (key) WHERE least < doc_id GROUP BY doc_id),
flags AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM words LEFT JOIN hit USING (doc_id)),
each AS (SELECT doc_id, i, w[i] AS word, list_contains(gone, i) AS out FROM (SELECT doc_id, w, gone, unnest(range(1, len(w) + 1)) AS i FROM flags)),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (out) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT out) AS body FROM each GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k USING (doc_id)
""",
}
