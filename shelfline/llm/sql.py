"""DuckDB SQL of the queries whose statements are built from parameters."""

from __future__ import annotations


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, largest: int = 1 << 26) -> str:
    """Codes of the product quantizer: every round assigns by brute force."""
    out = [f"""WITH ok AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT coalesce(abs(v::DOUBLE * {scale}) < {largest}, false))) = 0),
x AS MATERIALIZED (
  SELECT rid, i // (w // {parts}) AS part, i % (w // {parts}) AS pos, floor(embedding[i + 1]::DOUBLE * {scale})::BIGINT AS v
  FROM (SELECT rid, embedding, len(embedding) AS w, unnest(range(len(embedding))) AS i FROM ok)),
c0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, pos, v AS c FROM x WHERE rid <= {entries})"""]
    for t in range(rounds + 1):
        out.append(f"""a{t} AS MATERIALIZED (
  SELECT rid, part, min(dist) AS dist, arg_min(entry, (dist, entry)) AS entry
  FROM (SELECT rid, part, entry, sum((v - c) * (v - c))::BIGINT AS dist FROM x JOIN c{t} USING (part, pos) GROUP BY rid, part, entry)
  GROUP BY rid, part)""")
        if t < rounds:
            out.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m, c) AS c
  FROM c{t} LEFT JOIN (SELECT part, entry, pos, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS m
                       FROM x JOIN a{t} USING (rid, part) GROUP BY part, entry, pos) USING (part, entry, pos))""")
    out.append(f"""coded AS (
  SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error
  FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM ok JOIN coded USING (rid)""")
    return ",\n".join(out)


def spelling_sql(min_length: int = 6, min_count: int = 5, factor: int = 5, drop_one_in: int = 199) -> str:
    """Spelling variants: near words meet by what is left of them without one
    code point; CRC-32 is folded byte by byte with its polynomial."""
    return f"""WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda r, k: xor(r >> 1, (r & 1) * 3988292384), i::BIGINT)) AS t),
runs AS MATERIALIZED (
  SELECT id || ':' || run AS named, run, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id,
               translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents)
  WHERE length(run) >= {min_length} GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_transform(range(1, 2 * strlen(named), 2), lambda i: ('0x' || substr(hex(named), i, 2))::BIGINT),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) AS h
  FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % {drop_one_in} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                    ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {min_length} GROUP BY word HAVING sum(n) >= {min_count}),
less AS MATERIALIZED (
  SELECT word, n, i AS at, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.at = b.at AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other COLLATE C)) AS form, max(other_n) AS form_n FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= {factor} * w.n THEN form END AS form,
         CASE WHEN form_n >= {factor} * w.n THEN form_n END::BIGINT AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON c.next = f.word)
SELECT f.word, n, n_near, f.form, form_n, root FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL"""


def jaccard_sql(shingle: int = 4, percent: int = 85) -> str:
    """Components of equal or similar shingle sets: pairs meet by their shingles."""
    return f"""WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT rid, list_aggregate(w[i:i + {shingle - 1}], 'string_agg', ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {shingle - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
sized AS MATERIALIZED (SELECT rid, count(*)::BIGINT AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY rid),
one AS MATERIALIZED (SELECT k, min(rid) AS rid, any_value(n) AS n FROM sized GROUP BY k),
t AS MATERIALIZED (SELECT s.rid, g, n FROM s JOIN one USING (rid)),
links AS MATERIALIZED (
  SELECT a.rid AS x, b.rid AS y FROM t a JOIN t b ON a.g = b.g AND a.rid < b.rid AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.rid, a.n, b.rid, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rid AS x, rid AS y FROM one UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x),
least AS (SELECT k, min(doc_id) AS doc_id FROM sized JOIN d USING (rid) GROUP BY k),
comp AS (SELECT o.k, min(l.doc_id) AS component_id FROM one o JOIN reach r ON o.rid = r.x JOIN one p ON p.rid = r.y JOIN least l ON l.k = p.k GROUP BY o.k)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN sized USING (rid) LEFT JOIN comp USING (k)"""
