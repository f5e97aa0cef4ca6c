"""DuckDB statements of the operators that SQL can express."""

from __future__ import annotations


def vector_codes() -> str:
    """The quantiser by all distances, rounds one after the other."""
    ctes = [
        """kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(4)) AS p))""",
        """b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))""",
    ]
    dot = lambda a, b: f"CAST(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) AS BIGINT)"
    far = f"({dot('x', 'x')} - 2 * {dot('x', 'c')} + {dot('c', 'c')})"
    for r in range(5):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min(256 * {far} + e) AS best FROM parts JOIN b{r} USING (p) GROUP BY ALL)")
        if r < 4:
            floor = "(s - ((s % n) + n) % n) // n"
            ctes.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM b{r} LEFT JOIN (
                  SELECT p, e, list({floor} ORDER BY pos) AS m FROM (
                    SELECT p, best % 256 AS e, pos, sum(x[pos]) AS s, count(*) AS n FROM parts JOIN a{r} USING (vec_id, p), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS pos) GROUP BY ALL
                  ) GROUP BY ALL) USING (p, e))"""
            )
    return f"""WITH {", ".join(ctes)},
    coded AS (SELECT vec_id, string_agg(lower(printf('%02x', CAST(best % 256 AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
    book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM b4)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), book"""


def mixing() -> str:
    """Targets by the order of caps per weight, the selection by a running sum over the same keys."""
    return r"""WITH sized AS MATERIALIZED (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        coalesce(greatest(0.01, pow(length(translate(text, '0123456789#*$%&|<>{}[]=_~^@\/+', '')) / CAST(nullif(length(text), 0) AS DOUBLE), 2)), 0.01) AS weight,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 13) AS BIGINT) AS bits
      FROM documents),
    sources AS (SELECT source, sum(size) AS s, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sized GROUP BY source),
    lined AS (SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS over
      FROM sources WINDOW o AS (ORDER BY s / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT arg_max(rest, over) AS rest, max(over) AS over FROM lined WHERE 3 * s * over > rest * w),
    aims AS (SELECT source, s, CASE WHEN level.over IS NULL OR 3 * s * level.over <= level.rest * w THEN 3.0 * s ELSE CAST(level.rest * w AS DOUBLE) / level.over END AS target FROM lined, level),
    ordered AS (SELECT doc_id, sized.source, size, s, CAST(target AS DOUBLE) AS target, sum(size) OVER (PARTITION BY sized.source ORDER BY -ln((bits + 0.5) / 4503599627370496.0::DOUBLE) / weight, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, target,
      CAST(size * (epochs + CASE WHEN size > 0 AND before + size / 2.0 <= target - epochs * s THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs FROM ordered)"""


def collocations() -> str:
    """All phrases of all pieces, counted by their texts."""
    return r"""WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws
      FROM documents WHERE text IS NOT NULL),
    places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
    f AS MATERIALIZED (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS a FROM places, (SELECT unnest(range(1, 5)) AS m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 30),
    totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
    cuts AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1 : m], ' ') AS q FROM (
      SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
    scores AS (SELECT cuts.*, x.a AS l, y.a AS r, CAST(2000000 * CAST(cuts.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p JOIN f y ON y.lang = cuts.lang AND y.phrase = q),
    best AS MATERIALIZED (SELECT lang, m, phrase, a, l, r, score FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (SELECT lang, array_to_string(w[s : s + n - 1], ' ') AS phrase, max(a) AS most FROM (
      SELECT *, unnest(range(1, m - n + 2)) AS s FROM (SELECT lang, m, a, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS n FROM best WHERE m > 2)) GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM best LEFT JOIN longer USING (lang, phrase) JOIN totals USING (lang) WHERE most IS NULL OR 100 * most < 80 * a
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
