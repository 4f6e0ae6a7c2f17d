"""The queries in DuckDB SQL."""

from __future__ import annotations

from residua.llm import decontaminate, jaccard, negatives, quality, ranking, urls

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = r"[ \t\n\x0B\x0C\r]"


def lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


def plain_words(text: str) -> str:
    return rf"regexp_extract_all({lower(f'coalesce({text}, {chr(39)}{chr(39)})')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def space_words(text: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({text}, ''), '{BLANK}+'), lambda x: x <> '')"


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {plain_words('text')} AS w FROM documents),
i AS (SELECT item_id, {plain_words('text')} AS w FROM benchmark),
iw AS (SELECT item_id, least({decontaminate.WINDOW}, len(w)) AS size, w, unnest(range(1, len(w) - least({decontaminate.WINDOW}, len(w)) + 2)) AS p
       FROM i WHERE len(w) > 0),
ik AS (SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS k FROM iw),
sizes AS (SELECT DISTINCT size FROM ik),
dw AS (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes),
hits AS (SELECT r, p, size, item_id FROM (SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS k FROM dw) JOIN ik USING (size, k)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

CHAT = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, list(struct_pack(role := role, text := text)
      ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM t GROUP BY conv_id),
kept AS (SELECT * FROM c AS a WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.conv_id <> a.conv_id
         AND (b.n > a.n OR b.n = a.n AND b.conv_id < a.conv_id) AND b.turns[1:a.n] = a.turns))
SELECT conv_id, CAST(0 AS BIGINT) AS part, n AS n_turns, array_to_string(list_transform(turns,
       lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), '') AS rendered
FROM kept
"""


def _less(signs: str) -> str:
    """Bytes of a line that are among the signs of a character class."""
    return f"(strlen(line) - strlen(regexp_replace(line, '[{signs}]', '', 'g')))"


_R = quality.RULES
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {space_words('text')} AS w FROM documents),
windows AS (SELECT r, p, array_to_string(w[p:p + {_R.repeat_window - 1}], ' ') AS k
            FROM (SELECT r, w, unnest(range(1, len(w) - {_R.repeat_window - 2})) AS p FROM d)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + {_R.repeat_window})) AS q FROM twice) GROUP BY r),
lines AS (SELECT r, line, {space_words('line')} AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
sized AS (SELECT *, len(w) AS n, strlen(regexp_replace(line, '{BLANK}', '', 'g')) AS size,
          len(list_filter(w, lambda x: list_contains({text_list(quality.NAVIGATION)}, x))) AS signs FROM lines WHERE len(w) > 0),
judged AS (SELECT r, line, n,
    signs >= {_R.navigation_count} AND signs >= {_R.navigation_share} * n
    OR {_less('#*$%&|<>')} >= {_R.symbol_share} * size
    OR n >= 2 AND {_less(r'\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E')} > {_R.punctuation_share} * size
    OR len(list_filter({text_list(quality.BOILERPLATE)}, lambda x: contains({lower('line')}, x))) > 0
    OR n >= {_R.shout_words} AND {_less('A-Z')} > 0 AND {_less('A-Z')} >= {_R.shout_share} * {_less('A-Za-z')}
    OR n >= {_R.repeat_words} AND n - len(list_distinct(w)) > {_R.repeat_share} * n AS failed FROM sized),
by_line AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN failed THEN n ELSE 0 END) AS lost FROM judged GROUP BY r),
counted AS (SELECT doc_id, len(w) AS n_words, len(regexp_replace(text, '{BLANK}', '', 'g')) AS word_chars,
    len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
    FROM d LEFT JOIN repeats USING (r) LEFT JOIN by_line USING (r))
SELECT *, n_words < {_R.least_words} OR 100 * n_repeat_words > {_R.repeat_percent} * n_words AS base_failed,
    NOT (n_words < {_R.least_words} OR 100 * n_repeat_words > {_R.repeat_percent} * n_words)
    AND n_lost_words <= {_R.lost_share} * n_words AS kept FROM counted
"""


def _sites() -> tuple[str, str]:
    rule = verdict = ""
    for host, path, what in sorted(urls.SITE_RULES, key=lambda r: -len(r[0]) - len(r[1])):
        when = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN "
        rule += f"{when}'{host}{path}' "
        verdict += f"{when}'{what}' "
    return rule, verdict


def _patterns() -> str:
    return " OR ".join(f"regexp_matches(rest, '{urls.to_regex(*p)}', 's')" for p in urls.BLOCK_PATTERNS)


URL_FILTERS = rf"""
WITH p AS (SELECT page_id, coalesce({lower("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    coalesce(lower(regexp_extract(url, '^.*?://(.*)$', 1, 's')), '') AS rest FROM pages)
SELECT page_id, host, path, CASE {_sites()[0]}END AS rule,
    coalesce(CASE {_sites()[1]}END, CASE WHEN {_patterns()} THEN 'block' ELSE 'allow' END) AS verdict FROM p
"""

JACCARD = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {space_words(lower("coalesce(text, '')"))} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[p:p + least({jaccard.SHINGLE}, len(w)) - 1], ' ') AS k
    FROM (SELECT r, w, unnest(range(1, len(w) - least({jaccard.SHINGLE}, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.k = b.k AND a.r <> b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n AS x ON x.r = a JOIN n AS y ON y.r = b
    WHERE 100 * c >= {jaccard.PERCENT} * (x.n + y.n - c)),
reach AS (SELECT r, r AS other FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
least_id AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.other GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN least_id USING (r) LEFT JOIN n USING (r)
"""

RANKED = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {plain_words('text')} AS w FROM documents),
total AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
tf AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
    FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
m AS (SELECT r, 10 + (90 * len(w) * docs) // words AS m FROM d, total WHERE len(w) > 0),
items AS (SELECT row_number() OVER () AS q, item_id, {plain_words('text')} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT DISTINCT q, unnest(w) AS t FROM items),
scores AS (SELECT q, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked JOIN weights USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY q, r),
ranked AS (SELECT q, doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
    FROM scores JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (q) WHERE rank <= {ranking.TOP}
"""

NEGATIVES = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({negatives.SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES}),
ranked AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT same AND {negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {negatives.HIGH} * positive_score)
SELECT * FROM ranked WHERE rank <= {negatives.NEGATIVES}
"""
