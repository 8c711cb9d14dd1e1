"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tenurekit.llm.hilbert import BITS, curve_table
from tenurekit.llm.url_terms import SOFT, STRICT

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _hits(documents: str) -> str:
    """CTEs down to hit(doc_id, n, at_, item_id) of a relation of documents."""
    return f"""
iw AS (SELECT item_id, {_TERMS.format(_LOWER.format("text"))} AS ws FROM benchmark),
item AS (
    SELECT DISTINCT item_id, least(len(ws), 10) AS n,
        unnest(list_transform(range(1, greatest(len(ws) - 10, 0) + 2), lambda i: array_to_string(ws[i:i + 9], ' '))) AS span
    FROM iw WHERE len(ws) > 0
),
dw AS (SELECT doc_id, {_TERMS.format(_LOWER.format("text"))} AS ws FROM {documents}),
spans AS (
    SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS at_, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS span
    FROM dw, (SELECT DISTINCT n FROM item) WHERE len(ws) >= n
),
hit AS (SELECT s.doc_id, s.n, at_, item_id FROM spans s JOIN item i ON s.span = i.span AND s.n = i.n)"""


OP3 = f"""WITH {_hits("documents")},
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(at_, at_ + n)) AS place FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SPACED = r"trim(regexp_replace(lower({0}), '[\x20\x09-\x0D]+', ' ', 'g'))"


def _normal(line: str) -> str:
    """A line as lines are compared: digits fold to 0 where letters and marks outnumber them."""
    spaced = _SPACED.format(line)
    letters = f"length(regexp_replace({spaced}, '[ 0-9]', '', 'g'))"
    return f"CASE WHEN length(replace({spaced}, ' ', '')) < 2 * {letters} THEN regexp_replace({spaced}, '[0-9]+', '0', 'g') ELSE {spaced} END"



def _judged(documents: str) -> str:
    """CTEs down to judged(doc_id, the counts, n_gone, base_failed, kept) of a relation of documents."""
    return f"""
text_words AS (SELECT doc_id, source, text, {_WORDS.format("coalesce(text, '')")} AS ws FROM {documents}),
tri AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS g FROM text_words WHERE len(ws) > 2),
twice AS (SELECT doc_id, p FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY doc_id),
line AS (
    SELECT doc_id, coalesce(source, chr(1)) AS host, text, line, {_normal("line")} AS norm, len({_WORDS.format("line")}) AS n
    FROM (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM {documents}) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM line GROUP BY doc_id),
frequent AS (SELECT host, norm FROM line GROUP BY host, norm HAVING count(DISTINCT text) >= 20),
gone AS (SELECT doc_id, sum(n)::BIGINT AS n_gone FROM line JOIN frequent USING (host, norm) GROUP BY doc_id),
counted AS (
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_gone, 0) AS n_gone
    FROM text_words w LEFT JOIN repeated USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)
),
judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_gone >= 0.5 * n_words AND n_words - n_gone >= 50 AS kept FROM counted
)"""


OP4 = f"WITH {_judged('documents')} SELECT * EXCLUDE (n_gone) FROM judged"

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS_IN = "len(list_filter({1}::VARCHAR[], lambda t: regexp_matches({0}, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))::BIGINT"

OP7 = f"""
WITH u AS (
    SELECT page_id, {_FOLD.format("coalesce(url, '')")} AS folded, {_FOLD.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(verdict, domain, prefix)),
fits AS (
    SELECT page_id, host, path, max_by(domain || prefix, length(domain || prefix)) AS rule, max_by(verdict, length(domain || prefix)) AS verdict
    FROM (SELECT DISTINCT page_id, host, path FROM u) JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY ALL
),
found AS (SELECT *, {_TERMS_IN.format("folded", list(STRICT))} AS n_strict, {_TERMS_IN.format("folded", list(SOFT))} AS n_soft FROM u)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN 2 * n_strict + n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM found LEFT JOIN fits USING (page_id, host, path)
"""

def _grouped(documents: str) -> str:
    """CTEs down to grouped(doc_id, n_shingles, component_id) of a relation of documents."""
    return f"""
w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS ws FROM {documents}),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w
),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
grouped AS (
    SELECT w.doc_id, coalesce(max(size.n), 0) AS n_shingles, min(reach.other) AS component_id
    FROM w LEFT JOIN size USING (doc_id) JOIN reach ON reach.doc_id = w.doc_id GROUP BY w.doc_id
)"""


OP8 = f"WITH RECURSIVE {_grouped('documents')} SELECT * FROM grouped"


def _mix(documents: str) -> str:
    """CTEs down to mixed(doc_id, source, size, source_size, target, taken, spin, text) of a relation of documents."""
    place = "('0x' || substr(md5('mix-1|' || {0}), 1, 15))::BIGINT"
    chosen = "((({0} + first) * extra) // greatest(n_blocks, 1) - (first * extra) // greatest(n_blocks, 1))"
    at = "({0} // block)"

    def before(word: str) -> str:
        own = at.format(word)
        here = f"({chosen.format(f'({own} + 1)')} - {chosen.format(own)})"
        return f"(rounds * {word} + {chosen.format(own)} * block + {here} * ({word} - {own} * block))"

    return f"""
sized AS (
    SELECT doc_id, source, text, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size, CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS key,
        {place.format("doc_id::VARCHAR")} AS spin FROM {documents}
),
by_source AS (SELECT key, source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY ALL),
weighted AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS most FROM by_source),
levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER ratio, 0))::BIGINT AS rest, (sum(weight) OVER () - coalesce(sum(weight) OVER ratio, 0))::BIGINT AS rest_weight
    FROM weighted WINDOW ratio AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
filled AS (SELECT *, most * rest_weight <= weight * rest AS is_full FROM levels),
first_free AS (SELECT rest AS free_rest, rest_weight AS free_weight FROM filled WHERE NOT is_full ORDER BY most / weight, source NULLS LAST LIMIT 1),
by_target AS (
    SELECT key, source, source_size, n_docs, CASE WHEN is_full THEN most::DOUBLE ELSE (weight * free_rest)::DOUBLE / free_weight::DOUBLE END AS target,
        greatest(1, ceil((sum(source_size) OVER ())::DOUBLE / 65536))::BIGINT AS block, (sum(source_size) OVER ())::BIGINT AS all_words
    FROM filled LEFT JOIN first_free ON true
),
targeted AS (SELECT *, greatest(1, least(ceil(n_docs / 1000), source_size // (64 * block)))::BIGINT AS n_shards FROM by_target),
dealt AS (SELECT s.*, s.spin % n_shards AS shard, t.source_size, t.target, t.block FROM sized s JOIN targeted t USING (key)),
by_shard AS (
    SELECT key, shard, sum(size)::BIGINT AS shard_size, max(block) AS block, ceil(sum(size)::DOUBLE / max(block))::BIGINT AS n_blocks FROM dealt GROUP BY ALL
),
source_votes AS (SELECT key, target, round(all_words / block)::BIGINT AS total, least((SELECT sum(3 * n_blocks) FROM by_shard b WHERE b.key = t.key), round(all_words / block)) AS most FROM targeted t),
source_seats AS (
    SELECT key, count(*) AS total FROM (
        SELECT key, total, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, key, k) AS place
        FROM (SELECT key, target, total, unnest(range(0, most::BIGINT)) AS k FROM source_votes WHERE target > 0)
    ) WHERE place <= total GROUP BY key
),
shard_seats AS (
    SELECT key, shard, count(*) AS quota FROM (
        SELECT key, shard, total, row_number() OVER (PARTITION BY key ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS place
        FROM (SELECT key, shard, shard_size, total, unnest(range(0, least(total, 3 * n_blocks))) AS k FROM by_shard JOIN source_seats USING (key) WHERE shard_size > 0)
    ) WHERE place <= total GROUP BY key, shard
),
plan AS (
    SELECT key, shard, n_blocks, coalesce(quota, 0) // greatest(n_blocks, 1) AS rounds, coalesce(quota, 0) % greatest(n_blocks, 1) AS extra,
        {place.format("key || '|' || shard")} % greatest(n_blocks, 1) AS first
    FROM by_shard LEFT JOIN shard_seats USING (key, shard)
),
laid AS (SELECT *, (sum(size) OVER (PARTITION BY key, shard ORDER BY spin, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM dealt),
mixed AS (
    SELECT doc_id, source, text, size, source_size, target, spin, ({before("e")} - {before("(e - size)")})::BIGINT AS taken FROM laid JOIN plan USING (key, shard)
)"""


OP9 = f"WITH {_mix('documents')} SELECT doc_id, size, source_size, target, taken FROM mixed"


def _curve(rows: str) -> str:
    """rows(…, x, y, z) with h, the place on the Hilbert curve: a table of states, bit by bit."""
    table = curve_table()
    sql = f"SELECT *, 0 AS s, 0::BIGINT AS h FROM ({rows})"
    for b in range(BITS - 1, -1, -1):
        octant = f"((x >> {b}) & 1) + 2 * ((y >> {b}) & 1) + 4 * ((z >> {b}) & 1)"
        sql = f"SELECT * EXCLUDE (s, h, f), f // 8 AS s, h * 8 + f % 8 AS h FROM (SELECT *, {table}[s * 8 + {octant} + 1] AS f FROM ({sql}))"
    return sql


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by the rule of its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(x >> 1) ^ (0xEDB88320 * (x & 1)) for x in table]
    return table


OP13 = f"""
WITH turns AS (
    SELECT conv_id AS c, turn, length(coalesce(text, ''))::BIGINT AS size,
        md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL
),
taken AS (
    SELECT c, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda x, y: xor(x >> 8, ({_crc_table()}::BIGINT[])[(xor(x, y) & 255) + 1])), 4294967295) % 6)::BIGINT AS h FROM (SELECT DISTINCT c FROM turns)
),
own AS (SELECT c, list(g ORDER BY turn NULLS FIRST, g) AS gs, list(size ORDER BY turn NULLS FIRST, g) AS sizes FROM turns GROUP BY c),
rebuilt AS (
    SELECT o.c, coalesce(b.gs[1:h], []) || o.gs[h + 1:] AS gs, coalesce(b.sizes[1:h], []) || o.sizes[h + 1:] AS sizes
    FROM own o JOIN taken USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 100
),
starts AS (SELECT c, d, array_to_string(gs[1:d], '') AS p, coalesce(sizes[d], 0) AS size, d = len(gs) AS ends FROM (SELECT c, gs, sizes, unnest(range(0, len(gs) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT d, p, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
    FROM starts GROUP BY d, p
),
children AS (SELECT d - 1 AS d, left(p, 32 * (d::INT - 1)) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT *, coalesce(n_children, 0) AS n FROM nodes LEFT JOIN children USING (d, p)),
under AS (
    SELECT a AS d, left(p, 32 * a::INT) AS p, sum((n = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.d AS depth, up.conv_id AS parent_conv_id, c.n_convs, c.n AS n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN under USING (d, p) LEFT JOIN nodes up ON up.d = c.d - 1 AND up.p = left(c.p, 32 * (c.d::INT - 1))
"""


_CELL = "(256 * (rank() OVER (ORDER BY {0}) - 1) // count(*) OVER ())::INT"

#: The rows of the pipeline: quality rules, one of each group, no benchmark items, the mix, shards.
PIPELINE = f"""
WITH d4 AS MATERIALIZED (
    WITH {_judged("documents")},
    common AS (SELECT host, list(norm) AS norms FROM frequent GROUP BY host),
    cleaned AS (
        SELECT d.*, CASE WHEN j.n_gone > 0 THEN array_to_string(list_filter(string_split(d.text, chr(10)), lambda line: NOT list_contains(norms, {_normal("line")})), chr(10)) END AS left_
        FROM documents d JOIN judged j USING (doc_id) LEFT JOIN common c ON c.host = coalesce(d.source, chr(1)) WHERE j.kept
    )
    SELECT * EXCLUDE (left_) REPLACE (coalesce(left_, text) AS text, coalesce(length(left_), n_chars) AS n_chars) FROM cleaned
),
d8 AS MATERIALIZED (WITH RECURSIVE {_grouped("d4")} SELECT d.* FROM d4 d JOIN grouped g USING (doc_id) WHERE doc_id = component_id),
d3 AS MATERIALIZED (WITH {_hits("d8")} SELECT * FROM d8 WHERE doc_id NOT IN (SELECT doc_id FROM hit)),
times AS MATERIALIZED (
    WITH {_mix("d3")} SELECT doc_id, (taken * 1000000 + size * (spin % 1000000)) // (greatest(size, 1) * 1000000) AS times FROM mixed
),
d9 AS (SELECT d.*, unnest(range(0, times)) AS copy_ FROM d3 d JOIN times USING (doc_id) WHERE times > 0),
cells AS (
    SELECT *, {_CELL.format("coalesce(source, '')")} AS x, {_CELL.format("coalesce(lang, '')")} AS y, {_CELL.format("strlen(coalesce(text, ''))")} AS z FROM d9
),
ranked AS (SELECT *, row_number() OVER (ORDER BY h, md5(coalesce(text, '')), doc_id) - 1 AS r, count(*) OVER () AS n_all FROM ({_curve("SELECT * FROM cells")}))
SELECT doc_id, text, lang, source, n_chars, (r * 24 // n_all)::INT AS shard, r - ((r * 24 // n_all) * n_all + 23) // 24 AS slot FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_winnowing": OP3, "op4_line_frequency": OP4, "op7_url_terms": OP7, "op8_jaccard_join": OP8, "op9_apportion": OP9, "op13_prefix_trie": OP13}
