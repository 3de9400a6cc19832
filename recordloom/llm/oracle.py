"""DuckDB SQL for the queries that SQL can express (each document has its own doc_id there)."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
spread AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM spread),
later AS (SELECT doc_id, i FROM windows JOIN (SELECT win, min(doc_id) AS least FROM windows GROUP BY win) USING (win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark) WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM patterns)),
hits AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM places) JOIN patterns USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
blocks AS (SELECT doc_id, n, o, substr(h, 2 * o + 1, 1098) AS h FROM (SELECT *, unnest(range(0, n, 500)) AS o FROM n)),
windows AS (SELECT doc_id, o + i AS i, substr(h, 2 * i - 1, 100) AS win FROM (SELECT *, unnest(range(1, least(500, n - 49 - o) + 1)) AS i FROM blocks)),
later AS (SELECT doc_id, i FROM windows JOIN (SELECT win, min(doc_id) AS least FROM windows GROUP BY win) USING (win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM later),
spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS DISTINCT FROM i - 1) AS n_spans
FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id),
bytes AS (SELECT doc_id, o + i AS i, substr(h, 2 * i - 1, 2) AS b FROM (SELECT *, unnest(range(1, least(500, n - o) + 1)) AS i FROM blocks)),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY i) AS h FROM bytes ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, n.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM n LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _clustering(rounds: int, k: int = 8, size: int = 64, scale: int = 1024, salt: str = "3:") -> str:
    """SQL of op11: a pair of tables a round."""

    def assigned(n: int) -> str:
        return (
            f"a{n} AS MATERIALIZED (SELECT vec_id, min({{'d': d, 'c': c}}) AS best FROM (SELECT vec_id, c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d "
            f"FROM v JOIN m{n} AS m USING (i) GROUP BY vec_id, c) GROUP BY vec_id)"
        )

    def floor_of(s: str, n: str) -> str:
        return f"(({s} - (({s} % {n}) + {n}) % {n}) // {n})::BIGINT"

    steps = [
        f"kept AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"v AS MATERIALIZED (SELECT vec_id, unnest(range(1, {size + 1})) AS i, floor({scale} * unnest(e)::DOUBLE)::BIGINT AS x FROM kept)",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{salt}' || vec_id::VARCHAR)) - 1 AS c FROM kept ORDER BY c LIMIT {k})",
        "m0 AS MATERIALIZED (SELECT c, i, x FROM v JOIN first USING (vec_id))",
    ]
    for n in range(rounds):
        mean = floor_of("sum(v.x)", "count(*)")
        steps.append(assigned(n))
        steps.append(
            f"m{n + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce(t.x, m.x) AS x FROM m{n} AS m LEFT JOIN "
            f"(SELECT a.best.c AS c, v.i AS i, {mean} AS x FROM v JOIN a{n} AS a USING (vec_id) GROUP BY a.best.c, v.i) AS t USING (c, i))"
        )
    steps.append(assigned(rounds))
    steps.append(f"ends AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c)")
    steps.append(f"z AS (SELECT vec_id, best.c AS c, best.d AS d FROM a{rounds})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM z JOIN ends USING (c)"""


OP11 = _clustering(10)

OP12 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, t.b FROM reach AS r JOIN ways AS t ON t.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least_id, doc_id) AS component_id, coalesce(least_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id)
"""


def _repair() -> str:
    """SQL of op13: a step for each turn, with the cheapest edits (cost, audit, text) of each state of the grammar."""

    def edit(x: str, cost: str, letter: str, line: str | None = None) -> str:
        text = f"{x}.t || CASE WHEN {x}.t = '' THEN '' ELSE chr(10) END || {line}" if line else f"{x}.t"
        return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {text}}} END"

    def best(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def only(test: str, x: str) -> str:
        return f"CASE WHEN {test} THEN {x} END"

    own, user, assistant = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    keep = lambda k, letter: only(f"NOT gone AND initial = '{letter}'", edit(f"s{k}", "cut", "K", own))
    again = lambda k, line: only("NOT gone", edit(f"s{k}", "2 + cut", "R", line))
    gone = lambda k: edit(f"s{k}", "3", "D")
    steps = [
        gone(0), best(gone(1), keep(0, "s")),
        best(gone(2), *(keep(k, "u") for k in (0, 1, 3)), *(again(k, user) for k in (0, 1, 3))),
        best(gone(3), keep(2, "a"), again(2, assistant)),
    ]
    told = lambda names: ", ".join(f"{x} AS {n}" for n, x in names.items())
    add = lambda k, role: edit(f"s{k}", "2", "I", f"'{role}:'")
    # turns are inserted after each turn: u, then a, then u again
    more = [("s2", best("s2", *(add(k, "user") for k in (0, 1, 3)))), ("s3", best("s3", add(2, "assistant"))), ("s2", best("s2", add(3, "user")))]

    def closed(source: str) -> str:
        for name, value in more:
            source = f"SELECT * REPLACE ({value} AS {name}) FROM ({source})"
        return source

    none = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    first = closed(f"SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)")
    moved = told(dict(zip(("s0", "s1", "s2", "s3"), steps)))
    step = closed(f"SELECT dp.conv_id, dp.i + 1 AS i, {moved} FROM dp JOIN turns ON turns.conv_id = dp.conv_id AND turns.i = dp.i + 1")
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(k))),
faults AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS nth FROM faults WHERE f <> 0),
marked AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, NOT regexp_matches(text, '[.!?]{space}*$') AS open,
role[1] AS initial FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
turns AS MATERIALIZED (SELECT conv_id, i, turn, role, text, initial, blank, NOT blank AND seen AS again, NOT blank AND NOT seen AND open AS truncated, blank OR seen AS gone, (NOT blank AND open)::INT AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM marked),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (truncated) AS truncated,
count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
dp AS ({first} UNION ALL {step}),
ends AS (SELECT conv_id, {best("s0", "s3")} AS e, i FROM dp)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.c AS cost, e.a AS audit, sha256(e.t) AS repaired_sha256
FROM ends LEFT JOIN counts USING (conv_id) WHERE i = coalesce(n, 0)
"""


OP13 = _repair()
