"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import pipeline
from lamina.llm.approximate_search import op9_nearest
from lamina.llm.chat import op5_chat
from lamina.llm.collocations import op11_collocations
from lamina.llm.exact_search import op8_exact_search
from lamina.llm.line_dedup import op10_line_dedup
from lamina.llm.mixing import op6_mixing
from lamina.llm.packing import op1_packing
from lamina.llm.quality import op2_quality
from lamina.llm.quality_rules import op12_quality_rules
from lamina.llm.simhash_dedup import op4_simhash
from lamina.llm.substring_dedup import op3_substring_dedup
from lamina.llm.toxicity import op7_toxicity
from lamina.llm.turn_repair import op13_turn_repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash": op4_simhash,
    "op5_chat": op5_chat,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_exact_search": op8_exact_search,
    "op9_nearest": op9_nearest,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_quality_rules": op12_quality_rules,
    "op13_turn_repair": op13_turn_repair,
    "pipeline": pipeline.run,
}
#: op8 by brute force; op5 from the rows themselves: what is read back must equal them.
SQL: dict[str, str] = {
    "op5_chat": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
  15 + 2 * length(role) + 2 * length(text) - length(replace(replace(replace(replace(role, '\\', ''), '#', ''), '<', ''), ':', ''))
  - length(replace(replace(replace(text, '\\', ''), '#', ''), '<', '')) AS size FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM o)
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(upto) FILTER (WHERE role = 'assistant' OR rn = n) AS bigint) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op8_exact_search": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: cast(floor(cast(x AS double) * 256) AS bigint)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, max(cast(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS bigint)) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id AND len(d.v) = len(q.v) WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, cast(rn AS int) AS "rank", vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) t WHERE rn <= 5""",
    "op11_collocations": """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, doc, unnest(range(1, len(s) + 1)) AS piece, unnest(s) AS t FROM (SELECT lang, doc, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS s FROM d) q),
w AS (SELECT lang, doc, piece, unnest(range(1, len(s) + 1)) AS place, unnest(s) AS word FROM (SELECT lang, doc, piece, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda x: x <> '') AS s FROM p) q),
g AS (SELECT lang, word AS a1, lead(word, 1) OVER o AS a2, lead(word, 2) OVER o AS a3, lead(word, 3) OVER o AS a4 FROM w WINDOW o AS (PARTITION BY doc, piece ORDER BY place)),
f AS (SELECT lang, [a1] AS p, count(*) AS f FROM g GROUP BY lang, a1
 UNION ALL SELECT lang, [a1, a2], count(*) FROM g WHERE a2 IS NOT NULL GROUP BY lang, a1, a2 HAVING count(*) >= 30
 UNION ALL SELECT lang, [a1, a2, a3], count(*) FROM g WHERE a3 IS NOT NULL GROUP BY lang, a1, a2, a3 HAVING count(*) >= 30
 UNION ALL SELECT lang, [a1, a2, a3, a4], count(*) FROM g WHERE a4 IS NOT NULL GROUP BY lang, a1, a2, a3, a4 HAVING count(*) >= 30),
n AS (SELECT lang, sum(f) AS n FROM f WHERE len(p) = 1 GROUP BY 1),
c AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1),
k AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM c),
s AS (SELECT k.lang, k.p, a, k, x.f AS l, y.f AS r, cast(a AS hugeint) * 2000000 // (cast(x.f AS hugeint) + y.f) AS score
 FROM k JOIN f x ON x.lang = k.lang AND x.p = k.p[1:k] JOIN f y ON y.lang = k.lang AND y.p = k.p[k + 1:]),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS cut FROM s) q WHERE cut = 1),
i AS (SELECT lang, p[i:i + m - 1] AS p, max(a) AS most FROM (SELECT lang, p, a, m, unnest(range(1, len(p) - m + 2)) AS i FROM (SELECT lang, p, a, unnest(range(2, len(p))) AS m FROM c WHERE len(p) > 2) q) t GROUP BY 1, 2),
z AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.p = b.p WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, "rank", phrase, a, l, r, cast(n AS bigint) AS n, cast(score AS bigint) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank" FROM z) q JOIN n USING (lang) WHERE "rank" <= 2000""",
    "op13_turn_repair": """
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)) q),
d AS (SELECT conv_id, turn, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' '), ''), lambda x: cast(ascii(x) AS bigint)),
  lambda c, b: xor(c >> 8, tab[cast(xor(c, b) % 256 AS bigint) + 1]))) % 20 AS fate, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations, tab),
h AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, fate FROM d WHERE fate <> 0),
t AS (SELECT conv_id, turn, role, text FROM h UNION ALL SELECT conv_id, turn, role, text FROM h WHERE fate = 3),
o AS (SELECT *, left(role, 1) AS c, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM t),
f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'd'
  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(c) OVER (PARTITION BY conv_id ORDER BY rn) AS prev FROM o),
v AS (SELECT DISTINCT conv_id, cast(0 AS bigint) AS i, {'c': 0, 'a': '', 'o': ''} AS v0, {'c': 1000000000, 'a': '', 'o': ''} AS v1,
  {'c': 5, 'a': 'I', 'o': chr(10) || 'user:'} AS v2, {'c': 10, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} AS v3 FROM conversations
 UNION ALL
 SELECT conv_id, i, v0, v1, u2, least(u3, {'c': u2.c + 5, 'a': u2.a || 'I', 'o': u2.o || chr(10) || 'assistant:'}) FROM (
 SELECT conv_id, i, v0, v1, least(w2, {'c': v0.c + 5, 'a': v0.a || 'I', 'o': v0.o || chr(10) || 'user:'}, {'c': v1.c + 5, 'a': v1.a || 'I', 'o': v1.o || chr(10) || 'user:'},
   {'c': w3.c + 5, 'a': w3.a || 'I', 'o': w3.o || chr(10) || 'user:'}) AS u2, w3 AS u3 FROM (
 SELECT v.conv_id, v.i + 1 AS i, {'c': v0.c + 2, 'a': v0.a || 'D', 'o': v0.o} AS v0,
  least({'c': v1.c + 2, 'a': v1.a || 'D', 'o': v1.o}, {'c': v0.c + CASE WHEN ok AND r.c = 's' THEN x ELSE 1000000000 END, 'a': v0.a || 'K', 'o': v0.o || said}) AS v1,
  least({'c': v2.c + 2, 'a': v2.a || 'D', 'o': v2.o}, {'c': v0.c + k, 'a': v0.a || e, 'o': v0.o || made}, {'c': v1.c + k, 'a': v1.a || e, 'o': v1.o || made}, {'c': v3.c + k, 'a': v3.a || e, 'o': v3.o || made}) AS w2,
  least({'c': v3.c + 2, 'a': v3.a || 'D', 'o': v3.o}, {'c': v2.c + j, 'a': v2.a || g, 'o': v2.o || done}) AS w3
 FROM v JOIN (SELECT *, CASE WHEN NOT ok THEN 1000000000 WHEN c = 'u' THEN x ELSE x + 1 END AS k, CASE c WHEN 'u' THEN 'K' ELSE 'R' END AS e, CASE c WHEN 'u' THEN said ELSE chr(10) || 'user:' || text END AS made,
   CASE WHEN NOT ok THEN 1000000000 WHEN c = 'a' THEN x ELSE x + 1 END AS j, CASE c WHEN 'a' THEN 'K' ELSE 'R' END AS g, CASE c WHEN 'a' THEN said ELSE chr(10) || 'assistant:' || text END AS done
   FROM (SELECT *, fault IN ('', 't') AS ok, CASE fault WHEN 't' THEN 5 ELSE 0 END AS x, chr(10) || role || ':' || text AS said FROM f) y) r
 ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.rn = v.i + 1) a) b),
n AS (SELECT conv_id, max(i) AS i FROM v GROUP BY 1),
z AS (SELECT v.conv_id, least(v0, v3) AS w FROM v JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id AND n.i = v.i),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
  count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE rn > 1 AND prev || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT z.conv_id, cast(coalesce(gaps, 0) AS bigint) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 cast(w.c AS bigint) AS cost, w.a AS audit, sha256(substr(w.o, 2)) AS repaired_sha256 FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id""",
}
