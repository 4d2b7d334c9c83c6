"""SQL for DuckDB that gives the rows of those queries that SQL can express on small tables.

Each is written from the contract of the query, by comparing everything with everything; none
follows the method of its operator.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_WORD = r"[^\x20\x09-\x0D]+"
_FOLD = f"translate({{}}, '{ascii_uppercase}', '{ascii_lowercase}')"


def _words(table: str, key: str, fold: bool) -> str:
    text = "coalesce(text, '')"
    return f"SELECT {key}, regexp_extract_all({_FOLD.format(text) if fold else text}, '{_WORD}') AS ws FROM {table}"


NGRAM_JOIN = f"""
WITH RECURSIVE w AS ({_words('documents', 'doc_id', True)}),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
        ELSE list_distinct([ws[k:k + 2] FOR k IN range(1, len(ws) - 1)]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id"""

_QUINT = "list_sum([(strpos('0123456789abcdef', substr(p.hex, 5 * (k // 4) + d, 1)) - 1) * (16 ** (5 - d))::BIGINT FOR d IN [1, 2, 3, 4, 5]])::BIGINT"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, strlen(body) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (({_QUINT}) // (32 ** (3 - k % 4))::BIGINT) % 32, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p JOIN f ON p.hex = f.hex"""

SUBSTRING = f"""
WITH w AS ({_words('documents', 'doc_id', False)}),
starts AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 34], ' ')) AS h
           FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w)),
twice AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM (SELECT doc_id, p FROM starts SEMI JOIN twice USING (h)), range(35) r(k)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM (SELECT * FROM each ANTI JOIN gone USING (doc_id, p)) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

EMBEDDING = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id"""

_PART = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
_HOST = _FOLD.format(f"coalesce(regexp_extract(url, {_PART}, 1), '')")
URL_FILTER = f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, coalesce(regexp_extract(url, {_PART}, 2), '') AS path FROM pages),
c AS (SELECT *, concat(regexp_replace(host, '^(www|m)\\.', ''), regexp_replace(path, '(\\.html|/+)$', '')) AS canonical FROM p),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(url, '[?&]utm_source=') AND canonical <> ''),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, h, s)),
best AS (SELECT c.page_id, c.url, arg_max(concat(h, s), length(h) + length(s)) AS rule, arg_max(verdict, length(h) + length(s)) AS verdict
         FROM c JOIN rules ON (host = h OR host LIKE concat('%.', h)) AND starts_with(path, s) GROUP BY ALL)
SELECT c.page_id, c.host, c.path, best.rule,
  coalesce(best.verdict, CASE WHEN c.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best ON best.page_id = c.page_id AND best.url IS NOT DISTINCT FROM c.url"""

# thirteen words with two of them changed hold four unchanged in a row
DECONTAMINATION = f"""
WITH w AS ({_words('documents', 'doc_id', True)}), v AS ({_words('benchmark', 'item_id', True)}),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + 3], ' ') AS four FROM (SELECT *, unnest(range(1, len(ws) - 2)) AS p FROM w)),
h AS (SELECT item_id, p, array_to_string(ws[p:p + 3], ' ') AS four FROM (SELECT *, unnest(range(1, len(ws) - 2)) AS p FROM v WHERE len(ws) >= 13)),
places AS (SELECT DISTINCT doc_id, item_id, g.p - h.p AS o FROM g JOIN h ON g.four = h.four),
same AS (SELECT doc_id, item_id, v.ws AS item, [CASE WHEN w.ws[o + k] = v.ws[k] THEN 1 ELSE 0 END FOR k IN range(greatest(1, 1 - o), least(len(v.ws), len(w.ws) - o) + 1)] AS e
         FROM places JOIN w USING (doc_id) JOIN v USING (item_id)),
hit AS (SELECT doc_id, item, min(item_id) AS item_id FROM same
        WHERE len(e) >= 13 AND list_max([list_sum(e[s:s + 12]) FOR s IN range(1, len(e) - 11)]) >= 11 GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item FROM hit GROUP BY doc_id)
SELECT w.doc_id, n.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, first_item FROM w LEFT JOIN n ON n.doc_id = w.doc_id"""

# CRC-32 bit by bit, over the digits of a number
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT FOR x IN string_split({}::VARCHAR, '')]), lambda c, b:
  list_reduce(list_concat([xor(c, b)], [0::BIGINT FOR z IN range(8)]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

TRIE = f"""
WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST,
             md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT t.conv_id, list_concat(coalesce(b.ts, [])[1:t.h], t.ts[t.h + 1:]) AS ts FROM (SELECT *, {_CRC.format('conv_id')} % 9 AS h FROM t) t LEFT JOIN t b ON b.conv_id = t.conv_id - t.conv_id % 5),
p AS (SELECT conv_id, d AS depth, md5(ts[1:d]::VARCHAR) AS key, ts[1:d] AS pre, len(ts) AS n FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)),
m AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, pre) AS node FROM p),
g AS (SELECT node, depth, count(*) AS n_convs, any_value(strlen(pre[depth].x)) AS size,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
up AS (SELECT g.*, m.node AS parent FROM g LEFT JOIN m ON m.conv_id = g.node AND m.depth = g.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS k FROM up WHERE depth > 0 GROUP BY ALL),
w AS (SELECT up.*, coalesce(k, 0) AS k FROM up LEFT JOIN kids USING (node, depth)),
s AS (SELECT m.node, m.depth, count(*) FILTER (w.k = 0) AS n_leaves, sum((w.n_convs - 1) * coalesce(w.size, 0)) AS saved FROM w JOIN m ON m.conv_id = w.node AND m.depth <= w.depth GROUP BY ALL)
SELECT node AS conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, k::BIGINT AS n_children, n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM w JOIN s USING (node, depth)"""

_KEY = _FOLD.format("trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))")
LINES = f"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, {_KEY} AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, p, line, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


def _leaf(n_chars: str) -> str:
    fields = [f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR) END" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256(concat({', '.join(fields)}))"


MERKLE = f"""
WITH RECURSIVE a AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {_CRC.format('doc_id')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS claimed FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM a),
up AS (SELECT 0 AS level, tree, pos, n, leaf AS digest FROM b
  UNION ALL SELECT level + 1, tree, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, tree, pos // 2, n),
subs AS (SELECT tree, digest FROM up WHERE n = 1),
over AS (SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subs) AS n, digest FROM subs
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY level, pos // 2, n),
low AS (SELECT tree, max(level) AS height FROM up GROUP BY tree),
nodes AS (SELECT level, tree, pos, n, digest FROM up WHERE n > 1 UNION ALL SELECT over.level + low.height, tree, over.pos, over.n, digest FROM over, low WHERE over.n > 1),
heights AS (SELECT tree, height, height + (SELECT max(level) FROM over) AS top FROM low),
step AS (SELECT doc_id, leaf, claimed, b.tree, b.level, nodes.digest AS sibling, spot, pos2 FROM (
    SELECT doc_id, leaf, claimed, tree, height, unnest(range(top)) AS level, pos FROM b JOIN heights USING (tree)) b,
  LATERAL (SELECT CASE WHEN b.level < b.height THEN b.pos >> b.level ELSE b.tree >> (b.level - b.height) END AS spot) x,
  LATERAL (SELECT xor(spot, 1) AS pos2) y LEFT JOIN nodes ON nodes.tree = b.tree AND nodes.level = b.level AND nodes.pos = pos2),
way AS (SELECT doc_id, leaf, claimed, tree, list(struct_pack(s := sibling, lefts := spot > pos2) ORDER BY level) AS steps, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof FROM step GROUP BY ALL),
walk AS (SELECT b.doc_id, b.leaf, b.claimed, b.tree, coalesce(steps, []) AS steps, coalesce(proof, sha256('')) AS proof FROM b LEFT JOIN way ON way.doc_id = b.doc_id AND way.leaf = b.leaf),
fold AS (SELECT doc_id, leaf, tree, steps, proof, 1 AS k, claimed AS digest FROM walk
  UNION ALL SELECT doc_id, leaf, tree, steps, proof, k + 1, sha256(CASE WHEN steps[k].s IS NULL THEN digest WHEN steps[k].lefts THEN concat(steps[k].s, digest) ELSE concat(digest, steps[k].s) END) FROM fold WHERE k <= len(steps))
SELECT doc_id, leaf, subs.digest AS subroot, root.digest AS root, proof AS proof_sha256, fold.digest AS folded_root, fold.digest = root.digest AS verified
FROM fold JOIN subs USING (tree), (SELECT digest FROM over WHERE n = 1) root WHERE k = len(steps) + 1"""

ORACLE = {
    "op1_ngram_jaccard_join": NGRAM_JOIN,
    "op2_warc_capture_index": WARC,
    "op3_substring_dedup": SUBSTRING,
    "op4_embedding_near_dedup": EMBEDDING,
    "op5_url_filter": URL_FILTER,
    "op9_benchmark_decontamination": DECONTAMINATION,
    "op11_conversation_prefix_trie": TRIE,
    "op12_line_dedup": LINES,
    "op13_merkle_manifest": MERKLE,
}
