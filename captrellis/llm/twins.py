"""DuckDB twins of the corpus queries that SQL can express.

Texts with null, repeated rows and short texts follow the rules of the operators' docstrings. The twins state the
results plainly, over all pairs of places where need be; they are no way to compute them at scale.
"""

from captrellis.llm.licenses import DRIFT, NOTICES, NOTICE_SHARE, PHRASES

# Words of the scans (ASCII letters and digits, non-ASCII, lower case) and words between ASCII white space.
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SCAN_WORDS = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _spread(name: str, table: str, key: str, words: str) -> str:
    """CTEs ``<name>_texts (key, w)`` and ``<name>_words (key, p, word)``; words count from 1."""
    return f"""
    {name}_texts AS (SELECT {key}, {words} AS w FROM {table}),
    {name}_words AS (SELECT {key}, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM {name}_texts)"""


_OP6 = f"""WITH {_spread('d', 'documents', 'doc_id', _SCAN_WORDS)}, {_spread('b', 'benchmark', 'item_id', _SCAN_WORDS)},
    grams AS (
      SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[p:p + 12], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b_texts WHERE len(w) > 0)
    ),
    sizes AS (SELECT DISTINCT size FROM grams),
    places AS (
      SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS gram
      FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d_texts, sizes WHERE len(w) >= size)
    ),
    found AS (SELECT doc_id, p, size, item_id FROM places JOIN grams USING (size, gram)),
    hits AS (
      SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM found) GROUP BY 1
    ),
    items AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
    FROM d_texts LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _covered(size: int) -> str:
    """CTE ``cover_<size>``: words per document that lie in a window of ``size`` words found twice or more in it."""
    return f"""
    windows_{size} AS (
      SELECT doc_id, p, array_to_string(w[p:p + {size - 1}], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS p FROM d_texts WHERE len(w) >= {size})
    ),
    twice_{size} AS (SELECT doc_id, p FROM windows_{size} QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
    cover_{size} AS (
      SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + {size})) AS q FROM twice_{size}) GROUP BY 1
    )"""


# The longest repeat: neighbouring repeated windows that stand as neighbours in the other place too form one repeat. Each pair
# of a repeated window and the next place of it is a diagonal; a run on a diagonal of n windows is a repeat of n + 2 words.
# All pairs are taken, so the longest repeat is among them.
_OP3 = f"""WITH {_spread('d', 'documents', 'doc_id', _WORDS)}, {_covered(3)}, {_covered(8)},
    pairs AS (
      SELECT a.doc_id, b.p - a.p AS lag, a.p FROM windows_3 a JOIN windows_3 b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.p < b.p
    ),
    runs AS (SELECT doc_id, lag, p - row_number() OVER (PARTITION BY doc_id, lag ORDER BY p) AS run FROM pairs),
    longest AS (
      SELECT doc_id, max(n) + 2 AS n FROM (SELECT doc_id, lag, run, count(*) AS n FROM runs GROUP BY ALL) GROUP BY 1
    ),
    lines AS (
      SELECT doc_id, count(*) - count(DISTINCT line) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1
    ),
    measured AS (
      SELECT d.doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.n, 0)::BIGINT AS n_repeat_words,
             coalesce(c8.n, 0)::BIGINT AS covered_words, coalesce(longest.n, 0)::BIGINT AS longest_repeat
      FROM documents d JOIN d_texts t ON d.doc_id = t.doc_id LEFT JOIN lines ON lines.doc_id = d.doc_id
      LEFT JOIN cover_3 c3 ON c3.doc_id = d.doc_id LEFT JOIN cover_8 c8 ON c8.doc_id = d.doc_id LEFT JOIN longest ON longest.doc_id = d.doc_id
    ),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
    SELECT *, NOT base_failed AND covered_words <= 0.3 * n_words AND longest_repeat <= 100 AS kept FROM judged"""

_TEMPLATE_ROWS = ", ".join(f"('{label}', {exact}, '{phrase}')" for rows, exact in ((PHRASES, "true"), (NOTICES, "false")) for phrase, label in rows)
_OP5 = f"""WITH {_spread('d', 'documents', 'doc_id', _SCAN_WORDS)},
    templates AS (SELECT label, exact, string_split(phrase, ' ') AS t FROM (VALUES {_TEMPLATE_ROWS}) AS v(label, exact, phrase)),
    template_pairs AS (
      SELECT label, exact, len(t) - 1 AS length, q, t[q + 1] AS first, t[q + 2] AS second
      FROM (SELECT *, unnest(range(0, len(t) - 1)) AS q FROM templates)
    ),
    votes AS (
      SELECT a.doc_id, label, exact, length, q, a.p - 1 AS p, a.p - 1 - q AS diagonal
      FROM d_words a JOIN d_words b ON a.doc_id = b.doc_id AND b.p = a.p + 1 JOIN template_pairs ON a.word = first AND b.word = second
    ),
    fresh AS (
      SELECT *, exact AND diagonal <> before OR coalesce(diagonal - before > {DRIFT}, true) AS new
      FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, label ORDER BY diagonal, q) AS before FROM votes)
    ),
    runs AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, label ORDER BY diagonal, q ROWS UNBOUNDED PRECEDING) AS run FROM fresh),
    found AS (
      SELECT doc_id, label, exact, run, min(p) AS start, count(DISTINCT q) AS pairs, count(DISTINCT q) / length AS share
      FROM runs GROUP BY doc_id, label, exact, length, run
    ),
    judged AS (
      SELECT *, exact AND share = 1 AS base, CASE WHEN exact THEN share = 1 ELSE share >= {NOTICE_SHARE} END AS counts FROM found
    ),
    summed AS (
      SELECT doc_id, count(*) FILTER (base) AS n, min(start) FILTER (base) AS low, max(start) FILTER (base) AS high,
             list_sort(list_distinct(list(label) FILTER (base))) AS base_list, list_sort(list_distinct(list(label) FILTER (counts))) AS all_list,
             max(share) AS score
      FROM judged GROUP BY 1
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, low::BIGINT AS first_word, high::BIGINT AS last_word,
           coalesce(array_to_string(base_list, ','), '') AS base_labels, coalesce(array_to_string(all_list, ','), '') AS labels,
           coalesce(score, 0)::DOUBLE AS score
    FROM d_texts LEFT JOIN summed USING (doc_id)"""

_NASTY = "'\\### Assistant: </turn> ok'"
# A turn is escaped where one of the grammar's own strings stands in it. Roles are plain here: letters only.
_OP8 = f"""WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', {_NASTY} UNION ALL SELECT -7, 1, 'assistant', {_NASTY}
    ),
    written AS (
      SELECT *, CASE WHEN contains(text, chr(92)) OR contains(text, '###') OR contains(text, '</turn>')
                     THEN regexp_replace(text, '([\\\\#<])', '\\\\\\1', 'g') ELSE text END AS body
      FROM turns
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length('### ' || role || ': ' || body || ' </turn>' || chr(10)))::BIGINT AS formatted_chars
    FROM written GROUP BY conv_id"""

# Shingles numbered within their text turn a multiset into a set. Classes are found by following links to smaller ids.
_OP10 = f"""WITH RECURSIVE {_spread('d', 'documents', 'doc_id', _SCAN_WORDS)},
    shingles AS (
      SELECT doc_id, array_to_string(w[p:p + 4], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d_texts WHERE len(w) > 0)
    ),
    elements AS MATERIALIZED (SELECT doc_id, hash(gram, occ) AS e FROM (
      SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id, gram) AS occ FROM shingles
    )),
    sizes AS (SELECT doc_id, count(*) AS n FROM elements GROUP BY 1),
    common AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL
    ),
    links AS MATERIALIZED (
      SELECT a, b, shared = na AND na = nb AS same FROM (
        SELECT a, b, common.n AS shared, x.n AS na, y.n AS nb FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      ) WHERE shared >= 0.8 * (na + nb - shared) - 1e-9
    ),
    ties AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT id, b FROM reach JOIN ties ON a = seen),
    classes AS (SELECT id, min(seen) AS class_id FROM reach GROUP BY 1),
    copies AS (SELECT b AS id, min(a) AS copy_of FROM links WHERE same GROUP BY 1)
    SELECT doc_id, class_id, coalesce(copy_of, doc_id) AS copy_of, coalesce(n, 0)::BIGINT AS n_shingles
    FROM documents JOIN classes ON classes.id = doc_id LEFT JOIN copies ON copies.id = doc_id LEFT JOIN sizes USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op3_repetition": _OP3,
    "op5_licenses": _OP5,
    "op6_decontaminate": _OP6,
    "op8_chat_format": _OP8,
    "op10_bagminhash": _OP10,
}
