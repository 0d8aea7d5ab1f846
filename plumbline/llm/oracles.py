"""SQL for the queries of this package that SQL can express; the others are tested by brute force."""

OP2 = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS parts FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
c AS (SELECT vec_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.part * c.part)::BIGINT AS score
  FROM c q JOIN c ON q.place = c.place AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5 = """
WITH r AS (
  SELECT page_id, floor(page_id / 500)::BIGINT AS file,
    strlen(concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>',
      chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
      'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''),
      chr(13), chr(10), chr(13), chr(10)))::BIGINT AS length
  FROM pages),
p AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
  AS "offset" FROM r)
SELECT file, "offset", length, CASE WHEN page_id % 41 = 5 THEN 'missing' ELSE 'damaged' END AS status
FROM p WHERE page_id % 41 = 5 OR page_id % 7 = 3
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\'))
    + len(regexp_extract_all(text, '<</SYS>>|<<SYS>>|\[/INST\]|\[INST\]|</s>|<s>')) AS inside FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(inside + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 16 + length(role) END)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


def _weight(path: str, name: str) -> str:
    """The weights that queries.WEIGHTS gives, written out."""
    return f"""CASE WHEN {path} = 'd1/de' THEN 50 WHEN {path} = 'd0' THEN 400 WHEN {path} = 'd1' THEN 300 WHEN {path} = 'd2' THEN 200
      WHEN {name} = 'en' THEN 300 WHEN {name} = 'src0' THEN 50 ELSE 100 END"""


def _deal(level: str, nodes: str, parent: str, name: str) -> str:
    """One level's budgets by water-filling: nodes have cap, weight and the parent's budget given."""
    over = f"PARTITION BY {parent} ORDER BY cap::DOUBLE / weight::DOUBLE, {name}"
    return f"""
{level}_a AS (SELECT *, greatest(given - coalesce(sum(cap) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rest,
    sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM {nodes}),
{level}_b AS (SELECT *, cap * sharing > rest * weight AS is_open FROM {level}_a),
{level} AS (SELECT * EXCLUDE (given, cap, weight, rest, sharing, is_open), CASE WHEN is_open THEN
    (max(CASE WHEN is_open THEN rest END) OVER (PARTITION BY {parent}) * weight)
      // max(CASE WHEN is_open THEN sharing END) OVER (PARTITION BY {parent}) ELSE cap END AS given FROM {level}_b)"""


OP10 = f"""
WITH t AS (
  SELECT doc_id, coalesce('d' || (nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '')::BIGINT % 4), 'other') AS domain,
    coalesce(lang, '') AS language, coalesce(source, '') AS origin,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
leaf AS (SELECT domain, language, origin, sum(tokens) AS tokens, 2 * sum(tokens) AS cap FROM t GROUP BY ALL),
n1 AS (SELECT domain, sum(cap) AS cap, {_weight('domain', 'domain')} AS weight, (SELECT sum(tokens) // 2 FROM leaf) AS given FROM leaf GROUP BY domain),
{_deal('b1', 'n1', '1', 'domain')},
n2 AS (SELECT domain, language, sum(cap) AS cap, {_weight("domain || '/' || language", 'language')} AS weight, max(b1.given) AS given
  FROM leaf JOIN b1 USING (domain) GROUP BY domain, language),
{_deal('b2', 'n2', 'domain', 'language')},
n3 AS (SELECT domain, language, origin, cap, {_weight("domain || '/' || language || '/' || origin", 'origin')} AS weight, b2.given
  FROM leaf JOIN b2 USING (domain, language)),
{_deal('b3', 'n3', 'domain, language', 'origin')},
g AS (SELECT domain, language, origin, b3.given // tokens AS whole, b3.given % tokens AS rest
  FROM leaf JOIN b3 USING (domain, language, origin) WHERE b3.given > 0),
d AS (SELECT t.*, whole, rest, coalesce(sum(t.tokens) OVER (PARTITION BY domain, language, origin
    ORDER BY md5(concat('7:', whole, ':', doc_id)) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS start
  FROM t JOIN g USING (domain, language, origin))
SELECT doc_id, domain, language, origin, tokens, (whole + (start < rest)::INTEGER)::BIGINT AS copies FROM d WHERE whole + (start < rest)::INTEGER > 0
"""

def _crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, bit by bit."""
    return f"""xor(list_reduce([('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode({text})), '..')], lambda crc, byte:
    list_reduce([xor(crc, byte), 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: xor(c >> 1, (c & 1) * 3988292384)), 4294967295::BIGINT), 4294967295)"""


def _field(name: str) -> str:
    """A field as it is hashed in a manifest."""
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


# No group of these tables decides the capacity by itself; shards of such groups are tested by brute force.
OP11 = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, min(doc_id) AS first_id, sum(strlen(text) + 1)::BIGINT AS bytes FROM t GROUP BY text),
e AS (SELECT text, bytes, sum(bytes) OVER (ORDER BY first_id NULLS FIRST, sha256(text))::BIGINT AS "end" FROM g),
-- One step of a fill at a time: a shard more, or the next capacity once the fill is decided.
search AS (
  SELECT max(bytes) AS low, max("end") AS high, 0::BIGINT AS "at", 1 AS used FROM e
  UNION ALL
  SELECT CASE WHEN reach < total AND used = 16 THEN middle + 1 ELSE low END, CASE WHEN reach = total THEN middle ELSE high END,
    CASE WHEN reach = total OR used = 16 THEN 0 ELSE reach END, CASE WHEN reach = total OR used = 16 THEN 1 ELSE used + 1 END
  FROM (SELECT low, high, used, (low + high) // 2 AS middle, max(e."end") AS reach, (SELECT max("end") FROM e) AS total
    FROM search s JOIN e ON e."end" <= s."at" + (s.low + s.high) // 2 WHERE low < high GROUP BY ALL)),
cut AS (
  SELECT 0::BIGINT AS "at"
  UNION ALL
  SELECT max(e."end") FROM cut c JOIN e ON e."end" > c."at" AND e."end" <= c."at" + (SELECT min(low) FROM search WHERE low = high) GROUP BY c."at"),
s AS (SELECT text, "end", (SELECT count(*) FROM cut WHERE cut."at" > 0 AND cut."at" < e."end")::INTEGER AS shard FROM e),
k AS (SELECT text, {_crc32("text")} AS text_crc32 FROM g)
SELECT doc_id, (strlen(t.text) + 1)::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY "end", doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM t JOIN s ON t.text = s.text JOIN k ON t.text = k.text
"""

OP13 = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, text, {_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} AS head FROM documents),
d AS (SELECT doc_id, lang, sha256(head || {_field("text")}) AS leaf,
  CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN sha256(head || {_field("low")}) END AS changed
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM f)),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
-- Every level of every group: n nodes, their places.
tree AS (
  SELECT lang, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM p
  UNION ALL
  SELECT lang, level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (max(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY lang, level, place // 8),
tops AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM tree WHERE n = 1),
above AS (
  SELECT 0 AS level, place, subroot AS node, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (max(n) + 7) // 8 FROM above WHERE n > 1 GROUP BY level, place // 8),
side AS (
  SELECT lang, level, place, coalesce(string_agg(node, '' ORDER BY place) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '' ORDER BY place) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY lang, level, place // 8 ORDER BY place)),
outer_side AS (
  SELECT level, place, coalesce(string_agg(node, '' ORDER BY place) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '' ORDER BY place) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM above WHERE n > 1 WINDOW w AS (PARTITION BY level, place // 8 ORDER BY place)),
steps AS (
  SELECT p.lang, p.place, s.level, s.l, s.r FROM p JOIN side s ON p.lang IS NOT DISTINCT FROM s.lang AND s.place = p.place // (8 ** s.level)::BIGINT
  UNION ALL
  SELECT p.lang, p.place, 1000 + s.level, s.l, s.r FROM p JOIN tops ON p.lang IS NOT DISTINCT FROM tops.lang
    JOIN outer_side s ON s.place = tops.place // (8 ** s.level)::BIGINT),
paths AS (SELECT lang, place, string_agg(l || r, '' ORDER BY level) AS proof, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs FROM steps GROUP BY lang, place),
folds AS (
  SELECT p.lang, p.place, 0 AS k, coalesce(changed, leaf) AS node, coalesce(ls, []) AS ls, coalesce(rs, []) AS rs
  FROM p LEFT JOIN paths ON p.lang IS NOT DISTINCT FROM paths.lang AND p.place = paths.place
  UNION ALL
  SELECT lang, place, k + 1, sha256(ls[k + 1] || node || rs[k + 1]), ls, rs FROM folds WHERE k < len(ls))
SELECT p.doc_id, leaf, subroot, (SELECT node FROM above WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folds.node AS folded_root,
  folds.node = (SELECT node FROM above WHERE n = 1) AS verified
FROM p JOIN tops ON p.lang IS NOT DISTINCT FROM tops.lang
JOIN folds ON p.lang IS NOT DISTINCT FROM folds.lang AND p.place = folds.place AND k = len(ls)
LEFT JOIN paths ON p.lang IS NOT DISTINCT FROM paths.lang AND p.place = paths.place
"""

ORACLES = {"op2_maxscore": OP2, "op5_fixity": OP5, "op8_chat": OP8, "op10_mixing": OP10, "op11_minimax": OP11, "op13_manifest": OP13}
