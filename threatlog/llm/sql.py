"""The results of the operators that SQL can express, as DuckDB SQL."""

from __future__ import annotations

_REACH = """
reach AS (
  SELECT node AS id, node AS seen FROM nodes
  UNION
  SELECT r.id, e.b FROM reach r JOIN edges e ON r.seen = e.a
),
component AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)"""

MINHASH = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
shingled AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM worded WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingled x JOIN shingled y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
),
linked AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
nodes AS (SELECT doc_id AS node FROM documents),{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN component ON component.id = d.doc_id
"""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
) WHERE rank <= 10
"""

WARC = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex, coalesce(html, '') AS body FROM pages
),
last AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS latest,
    list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INTEGER, 5))::INTEGER) AS bits
  FROM hashed
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(bits, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> k) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM last
"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
edges AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.95
),
nodes AS (SELECT vec_id AS node FROM embeddings),{_REACH},
degree AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN degree ON a = e.vec_id JOIN component ON component.id = e.vec_id
"""

ORACLES = {"op3_minhash": MINHASH, "op4_topk": TOPK, "op6_warc": WARC, "op10_near_vectors": NEAR_VECTORS}


def _manifest(inner: int = 5, upper: int = 3) -> str:
    """The manifest of documents, for at most 16**inner documents a source and 16**upper sources."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")

    def leaf(text):
        parts = [text if f == "text" else f for f in fields]
        return "sha256(" + " || ".join(f"coalesce(strlen({p}::VARCHAR)::VARCHAR || ':' || {p}::VARCHAR, '-')" for p in parts) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # The bits of a byte, one after the other; digits and the minus sign are single bytes.
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, 3988292384 * (x % 2)))"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda c, b: {step}), 4294967295)"
    sql = f"""
WITH hashed AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS f0
  FROM documents
),
docs AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM hashed
),
a0 AS (SELECT tree, pos AS i, n, leaf AS node FROM docs)"""
    for name, levels in (("a", inner), ("b", upper)):
        if name == "b":
            sql += f""",
b0 AS (SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, node FROM a{inner})"""
        for k in range(levels):
            sql += f""",
{name}r{k} AS (SELECT tree, i // 16 AS i, n, string_agg(node, '' ORDER BY i) AS run FROM {name}{k} GROUP BY tree, i // 16, n),
{name}{k + 1} AS (SELECT tree, i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS node FROM {name}r{k})"""
    last, step_no = "docs", 0
    for name, levels in (("a", inner), ("b", upper)):
        for k in range(levels):
            tree, pos = ("d.tree", f"(d.pos // {16**k})") if name == "a" else ("0", f"(d.tree // {16**k})")
            left, right = f"substr(r.run, 1, ({64} * ({pos} % 16))::INTEGER)", f"substr(r.run, (64 * ({pos} % 16) + 65)::INTEGER)"
            before = "''" if not step_no else f"d.p{step_no}"
            carried = "d.doc_id, d.tree, d.pos, d.leaf"
            sql += f""",
s{step_no + 1} AS (
  SELECT {carried}, CASE WHEN r.n > 1 THEN sha256({left} || d.f{step_no} || {right}) ELSE d.f{step_no} END AS f{step_no + 1},
    {before} || CASE WHEN r.n > 1 THEN {left} || {right} ELSE '' END AS p{step_no + 1}
  FROM {last} d JOIN {name}r{k} r ON r.tree = {tree} AND r.i = {pos} // 16
)"""
            step_no += 1
            last = f"s{step_no}"
    return sql + f"""
SELECT d.doc_id, d.leaf, a.node AS subroot, b.node AS root, sha256(d.p{step_no}) AS proof_sha256, d.f{step_no} AS folded_root,
  d.f{step_no} = b.node AS verified
FROM {last} d JOIN a{inner} a ON a.tree = d.tree CROSS JOIN b{upper} b
"""


COLLOCATIONS = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)
),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM counts WHERE m >= 2)
),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, p.f AS l, q.f AS r, ((c.a::HUGEINT * 2000000) // (p.f + q.f))::BIGINT AS score
  FROM cuts c JOIN counts p ON p.lang = c.lang AND p.phrase = c.x JOIN counts q ON q.lang = c.lang AND q.phrase = c.y
),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
inside AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, f, m, s, w, unnest(range(1, m - s + 2)) AS i
    FROM (SELECT lang, f, m, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS s FROM counts WHERE m >= 3))
  GROUP BY ALL
),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM lowest b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE place = 1 AND (most IS NULL OR 100 * most < 80 * a)
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""

ORACLES["op12_collocations"] = COLLOCATIONS
ORACLES["op13_manifest"] = _manifest()
