"""DuckDB SQL of operators whose definition, if not their method, SQL can express."""

from __future__ import annotations

from inkwell.llm import minhash, mixing, quality

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACE}'),
                             lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {minhash.SHINGLE}
    THEN list_transform(range(1, len(w) - {minhash.SHINGLE} + 2),
                        lambda i: array_to_string(w[i:i + {minhash.SHINGLE - 1}], chr(31)))
    WHEN len(w) > 0 THEN [array_to_string(w, chr(31))] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE {minhash.PART} * c >= {minhash.LEAST} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION
          SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN m ON m.a = doc_id LEFT JOIN n USING (doc_id)
"""


def _hash(*parts: str) -> str:
    return f"md5(concat_ws('/', '{mixing.SEED}', {', '.join(parts)}))"


def _tree() -> str:
    out = ["t0 AS (SELECT *, 0 AS shard FROM d)"]
    for level in range(mixing.DEPTH):
        key = _hash(f"'{level}'", "coalesce(source, '-')", "CASE WHEN source IS NULL THEN 'true' ELSE 'false' END",
                    "block::VARCHAR", "epoch::VARCHAR")
        out.append(f"""
t{level + 1} AS (SELECT source, block, epoch, shard * 2 + CASE WHEN
  row_number() OVER (PARTITION BY shard ORDER BY {key}, source, block, epoch)
  <= floor((count(*) OVER (PARTITION BY shard) + 1) / 2) THEN 0 ELSE 1 END AS shard FROM t{level})""")
    return ",".join(out)


BY_CAP = "ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
WEIGHTS = "[" + ", ".join(f"{float(x)}::DOUBLE" for x in mixing.WEIGHTS) + "]"

OP5_SQL = f"""
WITH s AS (SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size
           FROM documents),
k AS (SELECT *, {_hash("coalesce(id::VARCHAR, '-')", "size::VARCHAR")} AS key FROM s),
r AS (SELECT *, ('0x' || substr(key, 1, 7))::BIGINT % {mixing.BLOCKS} AS block FROM k),
w AS (SELECT source, sum(size)::BIGINT AS words, (sum(size) * {float(mixing.MAX_REPEAT)})::DOUBLE AS cap,
             {WEIGHTS}[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS weight
      FROM r GROUP BY source),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS place,
             ((sum(words) OVER () * {mixing.SHARE})::DOUBLE - coalesce(sum(cap) OVER ({BY_CAP}), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER ({BY_CAP}), 0)) AS level FROM w),
f AS (SELECT source, words, coalesce(least((SELECT level FROM l WHERE level * weight <= cap ORDER BY place LIMIT 1)
                                           * weight, cap), cap) AS target FROM l),
q AS (SELECT *, CASE WHEN words = 0 THEN 0 ELSE floor(target / words) END AS whole FROM f),
b AS (SELECT *, target - whole * words AS extra FROM q),
p AS (SELECT r.*, b.words, b.target, b.whole, b.extra, {_hash("'block'", "coalesce(r.source, '-')", "block::VARCHAR")} AS bkey
      FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bkey, block, key, id, size
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p),
o AS (SELECT *, CASE WHEN size > 0 THEN greatest(0, least(size, round(extra) - pos)) WHEN pos < extra THEN 0 END AS part
      FROM a),
v AS (SELECT source, block, min(pos) AS before, any_value(whole) AS whole, any_value(extra) AS extra FROM a GROUP BY ALL),
d AS (SELECT source, block, unnest(range(1, (whole + CASE WHEN before < extra THEN 1 ELSE 0 END)::BIGINT + 1)) AS epoch
      FROM v),
{_tree()},
c AS (SELECT *, whole + CASE WHEN part > 0 OR (size = 0 AND part IS NOT NULL) THEN 1 ELSE 0 END AS copies FROM o)
SELECT c.id AS doc_id, c.size, c.words AS source_size, c.target,
       (c.whole * c.size + coalesce(c.part, 0))::BIGINT AS taken,
       coalesce(string_agg(t.shard::VARCHAR, ',' ORDER BY t.epoch) FILTER (t.epoch <= c.copies), '') AS shards
FROM c LEFT JOIN t{mixing.DEPTH} t ON t.source IS NOT DISTINCT FROM c.source AND t.block = c.block
GROUP BY c.id, c.size, c.words, c.target, c.whole, c.part, c.copies, c.key
"""


def _windows(size: int) -> str:
    """Places of words in windows of so many that occur twice or more in their text."""
    return f"""
g{size} AS (SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], chr(31)) AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size} + 2)) AS i FROM t WHERE len(w) >= {size})),
a{size} AS (SELECT doc_id, i, g FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{size}) WHERE c > 1),
c{size} AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {size})) AS p FROM a{size})
            GROUP BY doc_id)"""


OP9_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
{_windows(3)},{_windows(quality.MIN_REPEAT)},
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM
      (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{WORD}')
      GROUP BY doc_id),
d AS (SELECT x.doc_id, x.i, y.i - x.i AS gap, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS run
      FROM a{quality.MIN_REPEAT} x JOIN a{quality.MIN_REPEAT} y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
r AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) + {quality.MIN_REPEAT - 1} AS n FROM d
                                       GROUP BY doc_id, gap, run) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.n, 0)::BIGINT AS n_repeat_words,
             coalesce(c{quality.MIN_REPEAT}.n, 0)::BIGINT AS covered_words, coalesce(r.n, 0)::BIGINT AS longest_repeat
      FROM t LEFT JOIN l USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c{quality.MIN_REPEAT} USING (doc_id)
             LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * covered_words <= {quality.MAX_COVERED} * n_words
          AND longest_repeat <= {quality.MAX_LONGEST} AS kept
FROM v
"""
