"""Oracle SQL of the conversation trie: whole sequences as strings, subtrees by joining every node to its own prefixes."""

CONVERSATION_TRIE = r"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, own, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM (SELECT conv_id, count(*) AS own FROM turns GROUP BY conv_id)),
plan AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS lead FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (
  SELECT p.conv_id, k AS d, role, text FROM plan p JOIN turns t ON t.conv_id = p.base AND k <= lead
  UNION ALL
  SELECT p.conv_id, lead + k - h, role, text FROM plan p JOIN turns t USING (conv_id) WHERE k > h),
prefixes AS MATERIALIZED (
  SELECT conv_id, d, text, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d) AS seq FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, '', '' FROM convs),
nodes AS MATERIALIZED (
  SELECT d, seq, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(length(text)) AS saved FROM prefixes GROUP BY d, seq),
tree AS MATERIALIZED (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN prefixes x ON x.conv_id = n.conv_id AND x.d = n.d - 1 LEFT JOIN nodes p ON p.d = x.d AND p.seq = x.seq),
kids AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n FROM tree WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.d, a.seq, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM tree q LEFT JOIN kids k ON k.conv_id = q.conv_id AND k.d = q.d JOIN prefixes a ON a.conv_id = q.conv_id AND a.d <= q.d GROUP BY ALL),
ends AS (
  SELECT d, seq, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS hash
  FROM (SELECT conv_id, max(d) AS d FROM prefixes GROUP BY conv_id) JOIN prefixes USING (conv_id, d) GROUP BY ALL)
SELECT t.conv_id, t.d::BIGINT AS depth, t.parent_conv_id, t.n_convs, coalesce(k.n, 0) AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens,
  coalesce(e.hash, sha256('')) AS ends_sha256
FROM tree t JOIN below b ON b.d = t.d AND b.seq = t.seq LEFT JOIN kids k ON k.conv_id = t.conv_id AND k.d = t.d
LEFT JOIN ends e ON e.d = t.d AND e.seq = t.seq"""
