"""SQL for the queries of this subpackage that SQL can express."""

#: The eight steps that one byte makes in a CRC-32, from the sum so far (c) and the byte (b).
_BYTE = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"


def crc32(blob: str) -> str:
    """CRC-32 of an expression of type BLOB, unsigned."""
    octets = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: {_BYTE}))"


def _bits(digest: str, k: str = "0") -> str:
    return f"CAST('0x' || substr({digest}, CAST(8 * ({k}) + 1 AS INTEGER), 8) AS BIGINT)"


OP11_SQL = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {crc32("encode(coalesce(text, ''))")} AS text_crc32 FROM documents),
draws AS (
  SELECT doc_id, i AS shard, -ln(({_bits("md5(concat(CAST(doc_id AS VARCHAR), ':', CAST(i // 4 AS VARCHAR)))", "i % 4")} + 0.5::DOUBLE) / 4294967296::DOUBLE) AS draw
  FROM (SELECT DISTINCT doc_id FROM documents) CROSS JOIN (SELECT unnest(range(41)) AS i)),
won AS (
  SELECT doc_id, CAST(arg_min(shard, draw) FILTER (shard < 40) AS INTEGER) AS shard, CAST(arg_min(shard, draw) AS INTEGER) AS grown_shard FROM draws GROUP BY doc_id),
portions AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // 65536 AS portion FROM d),
ordered AS (SELECT *, {_bits("md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR), CAST(text_crc32 AS VARCHAR), CAST(portion AS VARCHAR)))")} AS place FROM portions)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, size, text_crc32, portion) - 1 AS BIGINT) AS slot, grown_shard
FROM ordered JOIN won USING (doc_id)
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces CROSS JOIN (SELECT unnest([1, 2, 3]) AS k))
  GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cuts.k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cuts.k + 1:], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY ALL)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM weakest LEFT JOIN inner_of USING (lang, phrase) JOIN totals USING (lang)
WHERE coalesce(100 * longer < 50 * a, true)
QUALIFY rank <= 2000
"""

OP13_SQL = rf"""
WITH w0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32("encode(CAST(doc_id AS VARCHAR))")} AS h FROM documents),
w1 AS (SELECT *, len(w) AS n, h // 10 AS g FROM w0),
w2 AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM w1),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM w2),
words AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
stretches AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (
    SELECT x.doc_id, y.i - x.i AS p, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
    FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i)
  GROUP BY doc_id, p, island HAVING count(*) >= greatest(p, 12 - p)),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM stretches GROUP BY ALL),
found AS (
  SELECT doc_id, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, max(length) AS length, first(period ORDER BY length DESC, start, period) AS period,
    string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN found USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
