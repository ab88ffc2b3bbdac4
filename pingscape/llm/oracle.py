"""DuckDB SQL for the queries of this subpackage that SQL can express.

The statements are written from the queries' contracts: repeated windows by their
text instead of hashes, and the chat digests straight from the turns.
"""

from __future__ import annotations

_WS = r"[\x20\x09-\x0D]+"


def _op6() -> str:
    return rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20
), g AS (
  SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS t FROM p
), r AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM g
), gone AS (
  SELECT DISTINCT doc_id, s + j AS i FROM (SELECT doc_id, s, unnest(range(0, 20)) AS j FROM r WHERE k > 1)
), each_word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), left_words AS (
  SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS kept FROM each_word e ANTI JOIN gone USING (doc_id, i) GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_words l ON w.doc_id = l.doc_id"""


_CONTROL = "### |</turn>|<part "


def _op10() -> str:
    escape = rf"regexp_replace(t, '(\\*)({_CONTROL})', '\1\\\2', 'g')"
    return rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, length('### ' || role || ':' || chr(10) || {escape} || chr(10) || '</turn>' || chr(10)) AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN t END, '' ORDER BY turn, role, t), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""


def _op5(threshold: float = 0.98) -> str:
    return f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), u AS (
  SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(v, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) >= {threshold}
), reach(id, other) AS (
  SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), component AS (
  SELECT id, min(other) AS least FROM reach GROUP BY id
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM e LEFT JOIN degree d ON e.vec_id = d.a LEFT JOIN component c ON e.vec_id = c.id"""


def _op11() -> str:
    """Periods from 2**s words are found where equal hashes of 2**s words follow each other at that distance; every one is then compared word for word."""
    gram = ""
    pairs = []
    for s in range(16):
        k = 1 << s
        prev = f"g{s - 1}" if s else "word_hashes"
        gram += f""", g{s} AS MATERIALIZED (
  SELECT doc_id, i, {"g" if not s else f"hash(g, lead(g, {k // 2}) OVER (PARTITION BY doc_id ORDER BY i), {s})"} AS g, n FROM {prev} WHERE n >= {2 * k + 2 if s else 6}
)"""
        pairs.append(f"""SELECT doc_id, q FROM (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id, g ORDER BY i) - i AS q FROM g{s} WHERE i + {k} <= n) WHERE q > {k // 2} AND q <= {k} GROUP BY doc_id, q HAVING count(*) > q""")
    return rf"""
WITH RECURSIVE given AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS ws, CAST(doc_id AS VARCHAR) AS id FROM documents
), crc(doc_id, k, c) AS (
  SELECT doc_id, 0, 4294967295::UBIGINT FROM given
  UNION ALL
  SELECT crc.doc_id, k + 1, CASE WHEN k % 9 = 0 THEN xor(c, CAST(ascii(id[k // 9 + 1]) AS UBIGINT)) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END
  FROM crc JOIN given USING (doc_id) WHERE k < 9 * length(id)
), hashed AS (
  SELECT doc_id, xor(c, 4294967295::UBIGINT) AS h FROM crc JOIN given USING (doc_id) WHERE k = 9 * length(id)
), planned AS (
  SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, CAST(h // 10 AS BIGINT) AS g FROM given JOIN hashed USING (doc_id)
), offsets AS (
  SELECT *, CASE WHEN planted THEN g % n END AS a FROM planned
), words AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE ws END AS ws FROM offsets
), word_hashes AS MATERIALIZED (
  SELECT doc_id, unnest(range(n)) AS i, hash(unnest(ws)) AS g, n FROM words
){gram}, lags AS (
  {" UNION ".join(pairs)}
), equal AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island
  FROM (SELECT doc_id, q, ws, unnest(range(n - q)) AS i FROM lags JOIN words USING (doc_id)) WHERE ws[i + 1] = ws[i + q + 1]
), stretches AS (
  SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM equal GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), told AS (
  SELECT doc_id, count(*) AS n_runs, min({{'minus': -length, 'start': start, 'period': period}}) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), left_words AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(ws) AS word FROM words) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, -best.minus AS length, best.period AS period, CAST((1000 * -best.minus) // best.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM given LEFT JOIN told USING (doc_id) LEFT JOIN left_words USING (doc_id)"""


def _op12() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: CAST(p[1] AS BIGINT) * CAST(p[2] AS BIGINT))) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM ranked WHERE rank <= 10"""


def _op13() -> str:
    return """
WITH RECURSIVE own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT c, c - c % 100 AS base, CAST(c AS VARCHAR) AS id FROM own
), crc(c, k, v) AS (
  SELECT c, 0, 4294967295::UBIGINT FROM ids
  UNION ALL
  SELECT crc.c, k + 1, CASE WHEN k % 9 = 0 THEN xor(v, CAST(ascii(id[k // 9 + 1]) AS UBIGINT)) WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END
  FROM crc JOIN ids USING (c) WHERE k < 9 * length(id)
), cut AS (
  SELECT c, base, CAST(xor(v, 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM crc JOIN ids USING (c) WHERE k = 9 * length(id)
), rebuilt AS (
  SELECT cut.c, pos, role, t FROM cut JOIN own ON own.c = cut.base AND pos < h
  UNION ALL SELECT cut.c, pos, role, t FROM cut JOIN own ON own.c = cut.c AND pos >= h
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY pos) AS depth FROM rebuilt
), named AS (
  SELECT c, depth, length(t) AS chars, string_agg(sha256(role || chr(0) || t), '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING) AS name FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM ids
), members AS (
  SELECT c, depth, chars, min(c) OVER w AS rep, count(*) OVER w AS n, max(depth) OVER (PARTITION BY c) AS last FROM named WINDOW w AS (PARTITION BY depth, name)
), nodes AS (
  SELECT rep, depth, any_value(n) AS n_convs, any_value(chars) AS chars FROM members GROUP BY rep, depth
), parents AS (
  SELECT DISTINCT m.rep, m.depth, u.rep AS up FROM members m JOIN members u ON m.c = u.c AND u.depth = m.depth - 1
), kids AS (
  SELECT up AS rep, depth - 1 AS depth, count(*) AS n_children FROM parents GROUP BY ALL
), below AS (
  SELECT DISTINCT a.rep, a.depth, b.rep AS r, b.depth AS d FROM members a JOIN members b ON a.c = b.c AND b.depth >= a.depth
), sums AS (
  SELECT below.rep, below.depth, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved_tokens
  FROM below JOIN nodes x ON x.rep = r AND x.depth = d LEFT JOIN kids ON kids.rep = r AND kids.depth = d GROUP BY below.rep, below.depth
), ends AS (
  SELECT rep, depth, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM members WHERE depth = last GROUP BY rep, depth
)
SELECT rep AS conv_id, CAST(depth AS BIGINT) AS depth, up AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes LEFT JOIN parents USING (rep, depth) LEFT JOIN kids USING (rep, depth) JOIN sums USING (rep, depth) LEFT JOIN ends USING (rep, depth)"""


SQL = {"op5_embedding_dedup": _op5(), "op6_substring_dedup": _op6(), "op10_chat_formatting": _op10(), "op11_periodic_runs": _op11(), "op12_exact_top_k": _op12(), "op13_prefix_trie": _op13()}
