"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
p AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d),
q AS (SELECT r, i, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM p WINDOW w AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM q WHERE c IS NOT NULL),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_bangs
  FROM d LEFT JOIN cov USING (r) LEFT JOIN ln USING (r)),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_upper > 40 * word_chars THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_bangs > 20 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

ABLATIONS = f"""
WITH o AS ({OP1}),
r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('capitals', 16), ('exclamations', 32), ('word_length', 64)),
p(policy, mask) AS (VALUES ('base', 3), ('v1', 15), ('v2', 127))
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS failed, count(*) FILTER (fail_bits & mask = bit) AS failed_alone,
  count(*) FILTER (fail_bits & mask & ~bit = 0) AS kept_without
FROM p JOIN r ON mask & bit <> 0 CROSS JOIN o GROUP BY policy, rule
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, string_agg(w, ' ') OVER f AS s, count(*) OVER f AS n FROM p
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
x AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(s)) AS first FROM g WHERE n = 50),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM x, (SELECT unnest(range(50)) AS k) WHERE first < doc_id),
r AS (SELECT p.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN w END, ' ' ORDER BY p.i) AS kept
      FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
c AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT l.b, c.m FROM c JOIN l ON c.n = l.a),
low AS (SELECT n, min(m) AS m FROM c GROUP BY n),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, low.m AS component_id, low.m = e.vec_id AS kept
FROM embeddings e JOIN low ON low.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS n_tokens FROM documents),
s AS (SELECT source, count(*) AS docs, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
one AS (SELECT list(CAST(tokens AS DOUBLE)) AS ts, sum(CAST(tokens AS DOUBLE)) AS total, max(CAST(tokens AS DOUBLE)) AS big, min(CAST(tokens AS DOUBLE)) AS small FROM s WHERE tokens > 0),
sh AS (SELECT list_transform(ts, lambda t: t / total) AS p, len(ts) AS n, big, small FROM one),
-- Both bisections on multiples of 2^-24; lo of the first meets the entropy, hi of the second the repetition limit.
bis(k, lo, hi, rlo, rhi) AS (
  SELECT 0, CAST(CASE WHEN ln(list_sum(p)) - list_sum(list_transform(p, lambda x: x * ln(x))) / list_sum(p) >= 0.95 * ln(n) THEN 16777216 ELSE 0 END AS BIGINT), CAST(16777216 AS BIGINT),
    CAST(0 AS BIGINT), CAST(CASE WHEN pow(small / big, -1.0) <= 4.0 OR small >= big THEN 0 ELSE 16777216 END AS BIGINT) FROM sh
  UNION ALL
  SELECT k + 1, CASE WHEN hi - lo > 1 AND h >= goal THEN mid ELSE lo END, CASE WHEN hi - lo > 1 AND h < goal THEN mid ELSE hi END,
    CASE WHEN rhi - rlo > 1 AND rep > 4.0 THEN rmid ELSE rlo END, CASE WHEN rhi - rlo > 1 AND rep <= 4.0 THEN rmid ELSE rhi END
  FROM (SELECT *, 0.95 * ln(n) AS goal, ln(list_sum(list_transform(p, lambda x: pow(x, mid / 16777216.0))))
          - list_sum(list_transform(p, lambda x: pow(x, mid / 16777216.0) * ln(pow(x, mid / 16777216.0)))) / list_sum(list_transform(p, lambda x: pow(x, mid / 16777216.0))) AS h,
          pow(small / big, rmid / 16777216.0 - 1) AS rep
        FROM (SELECT bis.*, sh.*, (lo + hi) // 2 AS mid, (rlo + rhi) // 2 AS rmid FROM bis, sh WHERE k < 26))),
ex AS (SELECT CASE WHEN n = 1 THEN 1.0 ELSE greatest(lo, rhi) / 16777216.0 END AS a FROM bis, sh WHERE k = 26),
nm AS (SELECT sum(pow(CAST(tokens AS DOUBLE), a)) AS norm, max(pow(CAST(tokens AS DOUBLE), 1.0 - a)) AS widest FROM s, ex WHERE tokens > 0),
pl AS (SELECT source, docs, tokens, CAST(CASE WHEN tokens > 0 THEN greatest(floor(pow(CAST(tokens AS DOUBLE), a) / norm * (widest * norm) + 1e-6), tokens) ELSE 0 END AS BIGINT) AS quota, CAST(ceil(docs / 256.0) AS BIGINT) AS blocks FROM s, ex, nm),
ep AS (SELECT *, quota - epoch * tokens AS room FROM (SELECT *, unnest(range(CASE WHEN tokens > 0 THEN greatest(1, CAST(ceil(quota / tokens) AS BIGINT)) ELSE 1 END)) AS epoch FROM pl)),
db AS (SELECT d.doc_id, d.source, n_tokens, CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 8) AS BIGINT) % blocks AS block
       FROM d JOIN pl ON d.source IS NOT DISTINCT FROM pl.source),
bt AS (SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS block_tokens FROM db GROUP BY ALL),
tu AS (SELECT bt.source, block, epoch, tokens, room, coalesce(CAST(sum(block_tokens) OVER (PARTITION BY bt.source, epoch
         ORDER BY md5('7|' || epoch || '|' || coalesce('=' || bt.source, '-') || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
       FROM bt JOIN ep ON bt.source IS NOT DISTINCT FROM ep.source),
pp AS (SELECT db.doc_id, db.source, n_tokens, epoch, db.block, tokens, room, before + coalesce(CAST(sum(n_tokens) OVER (PARTITION BY db.source, db.block, epoch
         ORDER BY md5('7|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '-')), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS spot
       FROM db JOIN tu ON db.source IS NOT DISTINCT FROM tu.source AND db.block = tu.block)
SELECT doc_id, source, n_tokens, CAST(epoch AS INT) AS epoch, block, epoch * tokens + spot AS start
FROM pp WHERE spot < room OR epoch = 0
"""

# crc32 of decimal digits: a table of 256 entries made by the rule, then one step a byte.
CRC = r"""
RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""
CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11 = rf"""
WITH {CRC},
d AS (SELECT doc_id, source, {_leaf("text")} AS leaf,
        CASE WHEN {CRC_OF.format("doc_id")} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS now FROM documents, crc_table),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT source, 0 AS lev, k, n, leaf AS h FROM l UNION ALL
      SELECT source, lev + 1, k // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY k)) FROM t WHERE n > 1 GROUP BY source, lev, k // 16, n),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS k, count(*) OVER () AS n, lev AS height FROM t WHERE n = 1),
u AS (SELECT 0 AS lev, k, n, subroot AS h FROM s UNION ALL
      SELECT lev + 1, k // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY k)) FROM u WHERE n > 1 GROUP BY lev, k // 16, n),
nodes AS (SELECT source, lev, k, h, n, false AS top FROM t UNION ALL SELECT NULL, lev, k, h, n, true FROM u),
sib AS (SELECT a.top, a.source, a.lev, a.k, coalesce(string_agg(b.h, '' ORDER BY b.k) FILTER (b.k < a.k), '') AS l,
          coalesce(string_agg(b.h, '' ORDER BY b.k) FILTER (b.k > a.k), '') AS r
        FROM nodes a JOIN nodes b ON a.top = b.top AND a.source IS NOT DISTINCT FROM b.source AND a.lev = b.lev AND a.k // 16 = b.k // 16 WHERE a.n > 1 GROUP BY ALL),
f AS (SELECT doc_id, leaf, s.subroot, height, s.k AS sk, source, CAST(0 AS BIGINT) AS lev, l.k AS k, now AS h, '' AS p
      FROM l JOIN s USING (source) WHERE source IS NOT NULL
      UNION ALL SELECT doc_id, leaf, s.subroot, height, s.k, l.source, 0, l.k, now, '' FROM l JOIN s ON l.source IS NULL AND s.source IS NULL
      UNION ALL
      SELECT f.doc_id, f.leaf, f.subroot, f.height, f.sk, f.source, f.lev + 1, CASE WHEN f.lev + 1 = f.height THEN f.sk ELSE f.k // 16 END, sha256(sib.l || f.h || sib.r), f.p || sib.l || sib.r
      FROM f JOIN sib ON NOT sib.top AND f.lev < f.height AND sib.source IS NOT DISTINCT FROM f.source AND sib.lev = f.lev AND sib.k = f.k),
g AS (SELECT doc_id, leaf, subroot, 0 AS lev, sk AS k, h, p FROM f WHERE lev = height
      UNION ALL
      SELECT g.doc_id, g.leaf, g.subroot, g.lev + 1, g.k // 16, sha256(sib.l || g.h || sib.r), g.p || sib.l || sib.r FROM g JOIN sib ON sib.top AND sib.lev = g.lev AND sib.k = g.k)
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, g.h AS folded_root, g.h = root AS verified
FROM g JOIN (SELECT lev, h AS root FROM u WHERE n = 1) USING (lev)
"""

OP12 = rf"""
WITH {CRC},
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, {CRC_OF.format("conv_id")} % 6 AS h, conv_id - ((conv_id % 100) + 100) % 100 AS base FROM (SELECT DISTINCT conv_id FROM c), crc_table),
r AS (SELECT k.conv_id, 0 AS part, p, role, text FROM k JOIN c ON c.conv_id = k.base AND p < h
      UNION ALL SELECT conv_id, 1, p, role, text FROM k JOIN c USING (conv_id) WHERE p >= h),
e AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
        md5(string_agg(md5(role) || md5(text), '' ORDER BY part, p) OVER (PARTITION BY conv_id ORDER BY part, p ROWS UNBOUNDED PRECEDING)) AS pre FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)),
f AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS len FROM e
      UNION ALL SELECT conv_id, 0, 0, '', (SELECT count(*) FROM r WHERE r.conv_id = k.conv_id) FROM k),
n AS (SELECT depth, pre, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len) AS ends FROM f GROUP BY depth, pre),
-- A node's prefixes are those of any member.
up AS (SELECT n.depth, n.pre, a.depth AS d, a.pre AS ap FROM n JOIN f a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
kid AS (SELECT d AS depth, ap AS pre, count(*) AS n_children FROM up WHERE d = depth - 1 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kid USING (depth, pre)),
sub AS (SELECT up.d AS depth, up.ap AS pre, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM up JOIN m ON m.depth = up.depth AND m.pre = up.pre GROUP BY ALL),
par AS (SELECT up.depth, up.pre, n.conv_id AS parent_conv_id FROM up JOIN n ON n.depth = up.d AND n.pre = up.ap WHERE up.d = up.depth - 1)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM m JOIN sub USING (depth, pre) LEFT JOIN par USING (depth, pre)
"""
