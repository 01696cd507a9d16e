"""SQL equivalents of the operators that SQL can express, for DuckDB over the same tables."""

from riskweave.llm import quality

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


EXACT_DEDUP = """
    WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           text_sha256
    FROM hashed
    WINDOW same AS (PARTITION BY text_sha256)
"""

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = f"""
    WITH items AS (
        SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({ascii_lower("text")}, '{WORDS}') AS w
        FROM benchmark
    ),
    starts AS (
        SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0
    ),
    windows AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM starts),
    docs AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({ascii_lower("text")}, '{WORDS}') AS w
        FROM documents
    ),
    places AS (
        SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
    ),
    found AS (
        SELECT r, i, size, item
        FROM (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM places) JOIN windows USING (size, words)
    ),
    hit AS (
        SELECT r, count(DISTINCT i) AS n_hit
        FROM (SELECT r, unnest(range(i, i + size)) AS i FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r
    ),
    named AS (
        SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

#: One row: the 256 remainders of the usual CRC-32, by its polynomial.
CRC_TABLE = """
    crc_steps(b, k, c) AS (
        SELECT b, 0, b::BIGINT FROM range(256) AS bytes(b)
        UNION ALL
        SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8
    ),
    crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_steps WHERE k = 8)
"""


def crc32(text: str, table: str = "t") -> str:
    """Unsigned CRC-32 of a text in UTF-8; `table` holds `CRC_TABLE`'s list."""
    points = f"list_transform(string_split({text}, ''), lambda ch: unicode(ch))"
    tail = "128 + (p & 63)"
    octets = f"""flatten(list_transform({points}, lambda p: CASE
        WHEN p < 128 THEN [p]
        WHEN p < 2048 THEN [192 + (p >> 6), {tail}]
        WHEN p < 65536 THEN [224 + (p >> 12), 128 + (p >> 6 & 63), {tail}]
        ELSE [240 + (p >> 18), 128 + (p >> 12 & 63), 128 + (p >> 6 & 63), {tail}] END))"""
    folded = f"list_reduce({octets}, lambda c, b: xor(c >> 8, {table}[xor(c & 255, b) + 1]), 4294967295::BIGINT)"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor({folded}, 4294967295) END"


SPELLING = f"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (
        SELECT doc_id, run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all({ascii_lower("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
        GROUP BY doc_id, run
    ),
    hashed AS (SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table),
    words AS (
        SELECT word, sum(n)::BIGINT AS n
        FROM (
            SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
            FROM hashed
        )
        WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
    ),
    -- A word with a gap, and the word that is left: two words of one gap differ by a letter.
    gaps AS (
        SELECT word, n, left(word, i) || '_' || substr(word, i + 2) AS gap, left(word, i) || substr(word, i + 2) AS rest
        FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)
    ),
    near AS (
        SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.word != b.word
        UNION
        SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
        UNION
        SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word
    ),
    best AS (SELECT word, count(*) AS n_near, min({{'m': -n, 'other': other}}) AS top FROM near GROUP BY word),
    linked AS (
        SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
               CASE WHEN -top.m >= 2 * words.n THEN top.other END AS form,
               CASE WHEN -top.m >= 2 * words.n THEN -top.m END AS form_n
        FROM words LEFT JOIN best USING (word)
    ),
    chains(word, root) AS (
        SELECT word, word FROM linked
        UNION ALL
        SELECT chains.word, linked.form FROM chains JOIN linked ON linked.word = chains.root WHERE linked.form IS NOT NULL
    )
    SELECT linked.word, linked.form, chains.root, linked.n, linked.n_near, linked.form_n
    FROM linked JOIN chains USING (word)
    JOIN linked AS ends ON ends.word = chains.root AND ends.form IS NULL
"""

SPACE = r"\x20\x09-\x0D"
#: The grammar's states are "", s, u and a: the initial before. Insertions lead on from each.
CONVERSATIONS = f"""
    WITH RECURSIVE {CRC_TABLE},
    rows_in AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
        FROM conversations, crc_table
    ),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
        FROM rows_in WHERE kind != 0
    ),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
               regexp_extract(text, '([^{SPACE}])[{SPACE}]*$', 1) AS sign
        FROM damaged
    ),
    judged AS (
        SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
               CASE WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                    WHEN sign NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
        FROM placed
    ),
    counted AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM judged GROUP BY conv_id
    ),
    inserted(q, p, cost, audit, text) AS (
        VALUES ('', 'u', 2, 'I', 'user:'), ('', 'a', 4, 'II', E'user:\\nassistant:'), ('s', 'u', 2, 'I', 'user:'),
               ('s', 'a', 4, 'II', E'user:\\nassistant:'), ('u', 'a', 2, 'I', 'assistant:'), ('a', 'u', 2, 'I', 'user:'),
               ('', '', 0, '', NULL), ('s', 's', 0, '', NULL), ('u', 'u', 0, '', NULL), ('a', 'a', 0, '', NULL)
    ),
    follows(q, p) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
    edits AS (
        SELECT conv_id, i, q, q AS p, 3 AS cost, 'D' AS audit, NULL AS text FROM judged, (SELECT DISTINCT q FROM inserted)
        UNION ALL
        SELECT conv_id, i, q, p, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'K', role || ':' || text
        FROM judged JOIN follows ON p = initial WHERE fault NOT IN ('blank', 'duplicate')
        UNION ALL
        SELECT conv_id, i, q, p, CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'R',
               CASE p WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
        FROM judged, follows WHERE p != 's' AND fault NOT IN ('blank', 'duplicate')
    ),
    -- A row and the insertions before it.
    steps AS (
        SELECT conv_id, i, j.q, e.p, j.cost + e.cost AS cost, j.audit || e.audit AS audit,
               nullif(concat_ws(chr(10), j.text, e.text), '') AS text
        FROM edits e JOIN inserted j ON e.q = j.p
    ),
    best(conv_id, i, q, way) AS (
        SELECT conv_id, 0::BIGINT, '', {{'cost': 0, 'audit': '', 'text': NULL::VARCHAR}} FROM counted
        UNION ALL
        SELECT b.conv_id, b.i + 1, s.p,
               min({{'cost': b.way.cost + s.cost, 'audit': b.way.audit || s.audit,
                     'text': nullif(concat_ws(chr(10), b.way.text, s.text), '')}})
        FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i + 1 AND s.q = b.q
        GROUP BY b.conv_id, b.i, s.p
    ),
    ended AS (
        SELECT c.conv_id, min({{'cost': way.cost + j.cost, 'audit': way.audit || j.audit,
                               'text': concat_ws(chr(10), way.text, j.text)}}) AS way
        FROM counted c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n
        JOIN inserted j ON j.q = b.q WHERE j.p IN ('', 'a')
        GROUP BY c.conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0)::BIGINT AS cost,
           coalesce(way.audit, '') AS audit, sha256(coalesce(way.text, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

def last_border(limit: str) -> str:
    return f"list_max(list_filter(borders, lambda b: b <= {limit}))"


def first_border(limit: str) -> str:
    return f"list_min(list_filter(borders, lambda b: b >= {limit}))"


#: A step of `search` fills one more shard up to the capacity in the middle of `low` and `high`.
SHARDING = f"""
    WITH RECURSIVE {CRC_TABLE},
    docs AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents),
    keyed AS (SELECT doc_id, size, {crc32("text")} AS text_crc32, sha256(text) AS text_sha256 FROM docs, crc_table),
    grouped AS (SELECT text_sha256, min(doc_id) AS first_id, sum(size) AS bytes FROM keyed GROUP BY text_sha256),
    sums AS MATERIALIZED (
        SELECT text_sha256, (sum(bytes) OVER (ORDER BY first_id NULLS FIRST, text_sha256))::BIGINT AS through FROM grouped
    ),
    whole AS MATERIALIZED (
        SELECT coalesce(max(through), 0) AS total, list_prepend(0, coalesce(list(through ORDER BY through), [])) AS borders
        FROM sums
    ),
    search(low, high, filled, place) AS (
        SELECT 0::BIGINT, total, 0, 0::BIGINT FROM whole
        UNION ALL
        SELECT CASE WHEN reach < total AND filled = 7 THEN middle + 1 ELSE low END,
               CASE WHEN reach >= total THEN middle ELSE high END,
               CASE WHEN reach >= total OR filled = 7 THEN 0 ELSE filled + 1 END,
               CASE WHEN reach >= total OR filled = 7 THEN 0 ELSE reach END
        FROM (
            SELECT low, high, filled, total, (low + high) // 2 AS middle, {last_border("place + (low + high) // 2")} AS reach
            FROM search, whole WHERE low < high
        )
    ),
    least AS MATERIALIZED (SELECT low AS capacity FROM search WHERE low = high),
    earliest(i, first_place) AS (
        SELECT 7, total FROM whole
        UNION ALL
        SELECT i - 1, {first_border("greatest(0, first_place - capacity)")} FROM earliest, least, whole WHERE i > 0
    ),
    ends(i, place) AS (
        SELECT 0, 0::BIGINT
        UNION ALL
        SELECT i + 1,
               CASE WHEN below_fits AND (NOT above_fits OR ideal - below <= above - ideal) THEN below
                    WHEN above_fits THEN above
                    WHEN ideal < first_place THEN first_place
                    ELSE {last_border("place + capacity")} END
        FROM (
            SELECT *, below BETWEEN greatest(first_place, place) AND place + capacity AS below_fits,
                   above BETWEEN greatest(first_place, place) AND place + capacity AS above_fits
            FROM (
                SELECT *, {last_border("ideal")} AS below, coalesce({first_border("ideal + 1")}, total) AS above
                FROM (
                    SELECT *, place + round_even((total - place) / (8 - i), 0)::BIGINT AS ideal
                    FROM ends JOIN earliest USING (i), least, whole WHERE i < 7
                )
            )
        )
    ),
    cuts AS MATERIALIZED (SELECT list(place) AS places FROM ends WHERE i > 0),
    placed AS (
        SELECT text_sha256, len(list_filter(places, lambda place: place < through))::INTEGER AS shard FROM sums, cuts
    )
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_sha256) - 1 AS slot,
           NULL::INTEGER AS grown_shard, text_sha256
    FROM keyed JOIN placed USING (text_sha256)
"""

#: Parts of the measures of operator 3's rules; the grids are the operator's parameters.
SHARES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
RULE_ROWS = " UNION ALL ".join(
    f"SELECT *, {i} AS place, '{rule}' AS rule, {part} / greatest({whole}, 1)::DOUBLE AS measure, "
    f"{quality.RULES[rule][1]}::DOUBLE[] AS grid FROM measured"
    for i, (rule, (part, whole)) in enumerate(SHARES.items())
)
SHARE = quality.RISK / len(quality.RULES)
QUALITY = f"""
    WITH RECURSIVE {CRC_TABLE},
    docs AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
        FROM documents
    ),
    starts AS (SELECT r, words, unnest(range(1, len(words) - {quality.WINDOW} + 2)) AS i FROM docs),
    windows AS (SELECT r, i, array_to_string(words[i:i + {quality.WINDOW} - 1], ' ') AS w FROM starts),
    again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
    covered AS (
        SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS i FROM again) GROUP BY r
    ),
    measured AS MATERIALIZED (
        SELECT r, doc_id, stratum, len(words) AS n_words,
               length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
               length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS n_symbols,
               len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
        FROM docs LEFT JOIN covered USING (r)
    ),
    rules AS MATERIALIZED ({RULE_ROWS}),
    marks AS (
        SELECT doc_id, min(quality) = 1 AS good, {crc32("doc_id::VARCHAR")} % {quality.LEARNING_PARTS} <> 0 AS holdout
        FROM labels, crc_table WHERE quality IN (0, 1) GROUP BY doc_id, t
    ),
    labelled AS (
        SELECT stratum, rule, good, holdout, len(list_filter(grid, lambda c: c <= measure)) AS reached
        FROM rules JOIN marks USING (doc_id)
    ),
    counts AS (
        SELECT stratum, rule, step,
               count(*) FILTER (good AND holdout) AS good_n, count(*) FILTER (good AND holdout AND reached >= step) AS good_hit,
               count(*) FILTER (good AND NOT holdout) AS fine_n,
               count(*) FILTER (good AND NOT holdout AND reached >= step) AS fine_hit,
               count(*) FILTER (NOT good AND NOT holdout) AS bad_n,
               count(*) FILTER (NOT good AND NOT holdout AND reached >= step) AS bad_hit
        FROM labelled, range(1, {1 + max(len(grid) for _, grid in quality.RULES.values())}) AS steps(step)
        GROUP BY stratum, rule, step
    ),
    tails AS (
        SELECT *, CASE WHEN good_n = 0 OR good_hit > good_n * {SHARE} THEN 1 ELSE list_sum(list_transform(
            range(0, good_hit + 1),
            lambda i: exp(lgamma(good_n + 1) - lgamma(i + 1) - lgamma(good_n - i + 1) + i * ln({SHARE}) + (good_n - i) * ln(1 - {SHARE}))
        )) END AS tail
        FROM counts
    ),
    proven AS (
        SELECT *, max(tail) OVER (PARTITION BY stratum, rule ORDER BY step DESC) AS p,
               (SELECT count(*) FROM (SELECT DISTINCT stratum, rule FROM counts)) AS sequences
        FROM tails
    ),
    strictest AS (
        SELECT stratum, rule, min(step) AS step FROM proven
        WHERE p <= {quality.LEVEL} / sequences AND bad_hit / greatest(bad_n, 1) > {quality.LIFT} * fine_hit / greatest(fine_n, 1)
        GROUP BY stratum, rule
    ),
    rejected AS (
        SELECT r, string_agg(rule, ' ' ORDER BY place) AS rejected_by
        FROM rules JOIN strictest USING (stratum, rule) WHERE measure >= grid[step] GROUP BY r
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < {quality.FEWEST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed,
           rejected_by, NOT base_failed AND rejected_by = '' AS kept
    FROM (SELECT measured.*, coalesce(rejected_by, '') AS rejected_by FROM measured LEFT JOIN rejected USING (r))
"""
