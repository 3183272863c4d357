"""SQL for the queries that SQL can express."""

from __future__ import annotations

OP10 = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d AND payload_bytes >= 100
"""

def _words(column: str) -> str:
    lower = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP2 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS size,
         array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS phrase
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
d AS (SELECT doc_id, row_number() OVER () AS r, {_words("text")} AS w FROM documents),
grams AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i,
         unnest([array_to_string(w[i : i + size - 1], ' ') for i in range(1, len(w) - size + 2)]) AS phrase
  FROM d, sizes WHERE len(w) >= size),
hit AS (SELECT r, i, size, item FROM grams JOIN win USING (size, phrase)),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + size)) AS j FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered c USING (r) LEFT JOIN items t USING (r)
"""

CONTROL_STRINGS = ["### System:", "### User:", "### Assistant:", "### Tool:", "### Role:", "</role>", "</turn>"]


def _escaped(column: str) -> str:
    sql = f"replace({column}, chr(92), chr(92) || chr(92))"
    for control in CONTROL_STRINGS:
        sql = f"replace({sql}, '{control}', '{control[0]}' || chr(92) || '{control[1:]}')"
    return sql


OP5 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
t AS (
  SELECT conv_id, turn, role, text, role = 'assistant' AS loss,
         CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length('### ' || role || ': ')
              ELSE length('### Role: ' || {_escaped("role")} || ' </role> ') END
         + length({_escaped("text")}) + length(' </turn>') + 1 AS n
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN loss THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN loss THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

# The crc32 of a text's bytes, from a table of steps built by its rule.
CRC_STEPS = """
table_steps AS (
  SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])),
                        lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS c
  FROM range(256) AS u(i)),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS steps FROM table_steps)"""


def _crc32(column: str) -> str:
    octets = f"[CAST('0x' || hex({column})[2 * i + 1 : 2 * i + 2] AS UBIGINT) for i in range(octet_length(encode({column})))]"
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {octets}),"
        " lambda c, x: xor(c >> 8, steps[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295)"
    )


# A run's period differs from a quarter of the text at most, and five words recur at its distance.
OP11 = f"""
WITH {CRC_STEPS},
ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS name FROM documents),
named AS (SELECT doc_id, CAST({_crc32("name")} AS BIGINT) AS h FROM ids, crc),
d AS (
  SELECT row_number() OVER () AS r, doc_id, h, h // 10 AS g,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents LEFT JOIN named USING (doc_id)),
made AS MATERIALIZED (
  SELECT r, doc_id, len(w) AS n,
         CASE WHEN h % 10 = 0 AND len(w) > 0 THEN
           [w[1 + CASE WHEN i < g % len(w) THEN i
              ELSE g % len(w) + (i - g % len(w)) % (1 + (len(w) - g % len(w)) // (3 + g % 8)) END] for i in range(len(w))]
         ELSE w END AS w
  FROM d),
grams AS MATERIALIZED (
  SELECT r, n, unnest(range(n - 4)) AS i,
         unnest([array_to_string(w[i + 1 : i + 5], ' ') for i in range(n - 4)]) AS gram
  FROM made WHERE n >= 5),
pairs AS (
  SELECT r, a.i, b.i - a.i AS q FROM grams a JOIN grams b USING (r, gram) WHERE a.i < b.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM islands GROUP BY r, q, island),
runs AS MATERIALIZED (
  SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
listed AS (
  SELECT r, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS spans
  FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS words
  FROM (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM made) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli, sha256(coalesce(spans, '')) AS runs_sha256,
       sha256(coalesce(words, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM made LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

OP12 = f"""
WITH {CRC_STEPS},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT {_words("text")} AS w FROM benchmark),
features AS (
  SELECT r, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))],
                               [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) AS feature
  FROM (SELECT r, w FROM d UNION ALL SELECT -1, w FROM b)),
counted AS MATERIALIZED (SELECT r, feature, count(*) AS n FROM features GROUP BY 1, 2),
named AS (SELECT DISTINCT feature FROM counted),
hashed AS MATERIALIZED (SELECT feature, CAST({_crc32("feature")} % 10000 AS INTEGER) AS bucket FROM named, crc),
sides AS (SELECT r >= 0 AS own, bucket, sum(n) AS n FROM counted JOIN hashed USING (feature) GROUP BY 1, 2),
totals AS (SELECT coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM sides),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
           (coalesce(max(n) FILTER (NOT own), 0) + 1)::DOUBLE * (any_value(totals.s) + 10000)::DOUBLE
           / ((coalesce(max(n) FILTER (own), 0) + 1)::DOUBLE * (any_value(totals.t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM sides, totals GROUP BY bucket),
weights AS (
  SELECT r, sum(n) AS n, sum(n * gain) AS weight
  FROM counted JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
         CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8]
              AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * eligible // 100 THEN place END AS "rank"
FROM scored LEFT JOIN ranked USING (r)
"""

SQL: dict[str, str] = {
    "op2_decontamination": OP2, "op5_chat": OP5, "op10_warc": OP10, "op11_periodic_runs": OP11, "op12_resampling": OP12,
}
