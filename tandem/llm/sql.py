"""DuckDB SQL of the queries that SQL can express."""

from tandem.llm import centroids
from tandem.llm.collocations import LEAST, SCALE, SHARE, TOP
from tandem.llm.licenses import KNOWN, LINES, RULES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NAMES = ", ".join(f"'{name}'" for name in KNOWN.values())
_TEXTS = ", ".join(f"'{text}'" for text in KNOWN)
_RUNS = ", ".join(f"array_to_string(parts[i:i + {k}], ' ')" for k in range(LINES))
_HELD = ", ".join(
    f"CASE WHEN regexp_matches(line, '{',.*,'.join(rule).join([',', ','])}') THEN '{name}' END" for name, rule in RULES
)


def _clusters() -> str:
    """Rounds of assignment and exact means; every vector is compared with every centroid."""
    steps = [
        f"""
kept AS (
  SELECT vec_id, list_transform(e, lambda x: floor({centroids.SCALE} * x)::BIGINT) AS v, row_number() OVER () AS u
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE len(e) = {centroids.WIDTH} AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.WIDTH}
), c0 AS (
  SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS cluster, v AS c
  FROM (SELECT sha256('{centroids.SEED}:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {centroids.CLUSTERS})
)"""
    ]
    for k in range(centroids.ROUNDS + 1):
        steps.append(f"""
a{k} AS (
  SELECT u, vec_id, v, cluster, distance FROM (
    SELECT u, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
    FROM kept, c{k}) QUALIFY row_number() OVER (PARTITION BY u ORDER BY distance, cluster) = 1
)""")
        if k < centroids.ROUNDS:
            steps.append(f"""
s{k} AS (
  SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({centroids.WIDTH})) AS i FROM a{k}) GROUP BY ALL
), m{k} AS (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{k} GROUP BY cluster
), c{k + 1} AS (
  SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster)
)""")
    last = centroids.ROUNDS
    return f"""WITH {",".join(steps)}
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (cluster)
"""


SQL: dict[str, str] = {
    "op7_license_sentences": f"""
WITH cut AS (
  SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t]+', '\\1\n', 'g'), '[\r\n]+') AS lines
  FROM documents
), clean AS (
  SELECT doc_id, list_filter(list_transform(lines,
    lambda x: trim(regexp_replace(translate(x, '{_UPPER}', '{_UPPER.lower()}'), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS parts
  FROM cut
), found AS (
  SELECT doc_id, len(parts) AS n_sentences, row_number() OVER () AS r, parts FROM clean
), places AS (
  SELECT r, i, unnest([1, 2, 3]) AS k, unnest([{_RUNS}]) AS run
  FROM (SELECT r, parts, unnest(range(1, len(parts) + 1)) AS i FROM found)
), firsts AS (
  SELECT r, i, min(k) AS k, list_extract([{_NAMES}], list_position([{_TEXTS}], run)) AS name
  FROM places WHERE list_contains([{_TEXTS}], run) GROUP BY r, i, run
), lists AS (
  SELECT r, string_agg(name, ',' ORDER BY i, k) AS sentences, ',' || string_agg(name, ',,' ORDER BY i, k) || ',' AS line
  FROM firsts GROUP BY r
)
SELECT doc_id, n_sentences, coalesce(sentences, '') AS sentences,
  coalesce((SELECT string_agg(name, ',' ORDER BY n) FROM (
    SELECT name, min(n) AS n FROM (SELECT unnest([{_HELD}]) AS name, unnest(range({len(RULES)})) AS n) WHERE name IS NOT NULL GROUP BY name)), '') AS licenses
FROM found LEFT JOIN lists USING (r)
""",
    "op11_misra_gries_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER own AS keep_id, count(*) OVER own AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW own AS (PARTITION BY text_sha256)
""",
    "op12_stream_collocations": f"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text
  FROM documents
), pieces AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^ \t]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM texts)
), counts AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), (SELECT unnest([1, 2, 3, 4]) AS k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), often AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= {LEAST}
), parts AS (
  SELECT lang, f, array_to_string(w[i:i + s - 1], ' ') AS part
  FROM (SELECT lang, f, w, k, unnest(range(1, k + 1)) AS i FROM often WHERE k > 2), (SELECT unnest([2, 3]) AS s)
  WHERE s < k AND i + s - 1 <= k
), covers AS (
  SELECT lang, part, max(f) AS f FROM parts GROUP BY ALL
), open AS (
  SELECT o.* FROM often o LEFT JOIN covers c ON c.lang = o.lang AND c.part = o.phrase
  WHERE o.k > 1 AND NOT coalesce(100 * c.f >= {SHARE} * o.f, false)
), cuts AS (
  SELECT o.lang, o.phrase, o.f AS a, c, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * o.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM open) o
  JOIN often x ON x.lang = o.lang AND x.phrase = array_to_string(o.w[1:c], ' ')
  JOIN often y ON y.lang = o.lang AND y.phrase = array_to_string(o.w[c + 1:], ' ')
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
""",
    "op13_orchard_clusters": _clusters(),
}
