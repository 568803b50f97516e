"""SQL spellings of the shared column expressions, for the oracle side."""

from __future__ import annotations


def tok(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower(replace({text}, chr(10), ' ')), '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda w: w <> '')"
    )


def order_key(seed: object, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


def draw(n: object, seed: object, *keys: str) -> str:
    return f"(('0x' || substr({order_key(seed, *keys)}, 1, 15))::BIGINT % {n})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cider_tables(n: int = 4) -> str:
    """CTEs from ``cand(item_id, text)`` and ``refs(item_id, ref_no, text)`` to weighted grams."""
    return f"""
    sents AS (
      SELECT item_id, -1::BIGINT AS ref_no, {tok('text')} AS t FROM cand
      UNION ALL
      SELECT item_id, ref_no::BIGINT, {tok('text')} AS t FROM refs
    ),
    words AS (
      SELECT item_id, ref_no, unnest(t) AS g1, unnest(range(len(t))) AS i FROM sents
    ),
    runs AS (
      SELECT item_id, ref_no, g1,
             {', '.join(f"lead(g1, {k}) OVER s AS w{k}" for k in range(1, n))}
      FROM words WINDOW s AS (PARTITION BY item_id, ref_no ORDER BY i)
    ),
    grams AS (
      SELECT item_id, ref_no, n, gram, count(*) AS tf
      FROM (
        {' UNION ALL '.join(
            f"SELECT item_id, ref_no, {k} AS n, " + " || ' ' || ".join(['g1', *[f'w{j}' for j in range(1, k)]]) + " AS gram FROM runs"
            for k in range(1, n + 1)
        )}
      )
      WHERE gram IS NOT NULL
      GROUP BY ALL
    ),
    freq AS (SELECT n, gram, count(DISTINCT item_id) AS df FROM grams WHERE ref_no >= 0 GROUP BY ALL),
    total AS (SELECT count(*) AS items FROM cand),
    weighted AS (
      SELECT g.*, tf * (ln(items::DOUBLE) - ln(greatest(coalesce(df, 0), 1)::DOUBLE)) AS w
      FROM grams g LEFT JOIN freq USING (n, gram) CROSS JOIN total
    ),
    norms AS (SELECT item_id, ref_no, n, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY ALL)"""


def cider_scores(n: int = 4, sigma: float = 6.0) -> str:
    """CTEs that end in ``scores(item_id, n_refs, cider)``."""
    return f"""{cider_tables(n)},
    dots AS (
      SELECT r.item_id, r.ref_no, n, sum(least(c.w, r.w) * r.w) AS dot
      FROM weighted r JOIN weighted c USING (item_id, n, gram)
      WHERE r.ref_no >= 0 AND c.ref_no = -1
      GROUP BY ALL
    ),
    sims AS (
      SELECT d.item_id, d.ref_no,
             sum(CASE WHEN a.norm > 0 AND b.norm > 0 THEN dot / (a.norm * b.norm) ELSE 0 END) AS sim
      FROM dots d
      JOIN norms a ON a.item_id = d.item_id AND a.n = d.n AND a.ref_no = -1
      JOIN norms b ON b.item_id = d.item_id AND b.n = d.n AND b.ref_no = d.ref_no
      GROUP BY ALL
    ),
    lens AS (SELECT item_id, ref_no, greatest(len(t) - 1, 0) AS bigrams FROM sents),
    scores AS (
      SELECT r.item_id, count(*) AS n_refs,
             avg(10.0 * coalesce(sim, 0) / {n} * exp(-power(c.bigrams - r.bigrams, 2) / {2 * sigma * sigma})) AS cider
      FROM lens r
      JOIN lens c ON c.item_id = r.item_id AND c.ref_no = -1
      LEFT JOIN sims s ON s.item_id = r.item_id AND s.ref_no = r.ref_no
      WHERE r.ref_no >= 0
      GROUP BY r.item_id
    )"""
