"""DuckDB statements with the rows of the registered queries, where SQL can express them on whole tables."""

from __future__ import annotations

from spanloom.llm.factor_dedup import WINDOW
from spanloom.llm.queries import SHARDS
from spanloom.llm.set_join import SHINGLE_WORDS, THRESHOLD

# The words of a text; DuckDB's regular expressions count the same white space.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_FACTOR_DEDUP = rf"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents
), positions AS (
  SELECT r, doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM words
), windows AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM positions WHERE i + {WINDOW - 1} <= len(w)
), found AS (
  SELECT r, doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS again FROM windows
), covered AS (
  SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM found WHERE again
), removed AS (
  SELECT r, list(i) AS gone FROM covered GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256
FROM words LEFT JOIN removed USING (r)
"""


def _shard(count: int) -> str:
    scores = ", ".join(
        f"{{'score': 1.0::DOUBLE / -ln((('0x' || substr(md5(key || ':{i}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE), 'shard': {-i}}}"
        for i in range(count)
    )
    return f"-(list_max([{scores}])).shard"


def _crc_table() -> list[int]:
    """Checksums of the single bytes, from the polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 * (value & 1))
        table.append(value)
    return table


_CRC = f"""xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(content), '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda c, b: xor(c >> 8, ({_crc_table()})[(xor(c, b) & 255) + 1])))"""

_SHARDING = f"""
WITH keyed AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, coalesce(text, '') AS content FROM documents
), placed AS (
  SELECT doc_id, key, (strlen(content) + 8)::BIGINT AS size, ({_CRC})::BIGINT AS text_crc32,
         ({_shard(SHARDS)})::INTEGER AS shard, ({_shard(SHARDS + 1)})::INTEGER AS grown_shard
  FROM keyed
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key), 1, 13))::BIGINT, doc_id, size, text_crc32) - 1)::BIGINT AS slot,
       grown_shard
FROM placed
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SET_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT r, doc_id, array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ') AS h
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE_WORDS - 1}, least(len(w), 1)) + 1)) AS i FROM words)
), sizes AS (
  SELECT r, count(*) AS n FROM sets GROUP BY r
), shared AS (
  SELECT a.r AS x, b.r AS y, count(*) AS n FROM sets a JOIN sets b ON a.h = b.h AND a.r < b.r GROUP BY ALL
), links AS (
  SELECT x, y FROM shared s JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y
  WHERE {THRESHOLD[1]} * s.n >= {THRESHOLD[0]} * (p.n + q.n - s.n)
), edges AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT r AS x, r AS y FROM words UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y
), labels AS (
  SELECT reach.x AS r, min(words.doc_id) AS component_id FROM reach JOIN words ON words.r = reach.y GROUP BY reach.x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM words LEFT JOIN sizes USING (r) JOIN labels USING (r)
"""

ORACLES: dict[str, str] = {
    "op4_factor_dedup": _FACTOR_DEDUP,
    "op8_set_join": _SET_JOIN,
    "op9_sharding": _SHARDING,
}
