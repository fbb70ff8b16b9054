"""The same views and operators as plain SQL, written from their definitions, to check the DataFrame plans."""

from __future__ import annotations

from tagforge.operators.taxonomy import Taxonomy, synonym_map

WS = r"[\t-\r \x1c-\x1f\x85\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r \x1c-\x1f\x85\p{Z}]"


def _rows(rows) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def prelude() -> str:
    t = Taxonomy.of()
    edges = [(i, level, p, n) for i, (level, p, n) in enumerate(t.edges())]
    firsts = list(enumerate(t.first))
    thirds = [(i, p, t_) for i, (p, t_) in enumerate((p, x) for p, xs in t.third.items() for x in xs)]
    return f"""WITH edges(ord, level, parent, name) AS (VALUES {_rows(edges)}),
firsts(ord, name) AS (VALUES {_rows(firsts)}),
thirds(ord, parent, name) AS (VALUES {_rows(thirds)}),
syn(name, synonym) AS (VALUES {_rows(sorted(synonym_map().items()))}),
nodes AS (SELECT name FROM edges UNION SELECT name FROM firsts),
par AS (SELECT name, arg_max(parent, ord) AS parent FROM edges GROUP BY name),
branch AS (SELECT name, arg_max('L' || (level - 1) || '::' || parent, ord) AS branch FROM edges GROUP BY name),
kids AS (SELECT parent, list(name ORDER BY ord) AS children FROM edges e
         WHERE level = (SELECT max(level) FROM edges x WHERE x.parent = e.parent) GROUP BY parent),
upper_of AS (SELECT name, min(parent) AS parent FROM edges WHERE level = 2 GROUP BY name),
leaf AS (SELECT (row_number() OVER (ORDER BY e.name) - 1)::INTEGER AS i, e.name AS l3, e.parent AS l2, u.parent AS l1
         FROM edges e JOIN upper_of u ON u.name = e.parent WHERE e.level = 3),
paths AS (SELECT n.name, coalesce(l.l1, u.parent, n.name) AS l1, coalesce(l.l2, n.name) AS l2, n.name AS l3
          FROM nodes n LEFT JOIN leaf l ON l.l3 = n.name LEFT JOIN upper_of u ON u.name = n.name),
opt1 AS (SELECT list(name ORDER BY ord) AS o FROM firsts),
optl AS (SELECT e.level, e.name, (SELECT list(x.name ORDER BY x.ord) FROM edges x WHERE x.level = e.level AND x.parent = e.parent) AS o FROM edges e),
cleaned AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '-\\n{WS}*', '', 'g'), '\\n', ' ', 'g'), '{WS}+', ' ', 'g'), '^ +| +$', '', 'g') AS t FROM documents),
pieces AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]){WS}+([A-Z])', '\\1' || chr(30) || '\\2', 'g'), chr(30)), lambda x: trim(x)), lambda x: length(x) > 20) AS p FROM cleaned),
sent AS (SELECT doc_id, p[1] AS sentence FROM pieces WHERE len(p) > 0),
ment AS (SELECT doc_id, sentence, pos, e[pos + 1] AS entity, i, l1, l2, l3 FROM
    (SELECT doc_id, sentence, e, unnest(range(len(e)))::INTEGER AS pos FROM (SELECT *, regexp_extract_all(sentence, '[\\p{{L}}]{{6,}}')[1:3] AS e FROM sent))
    JOIN leaf ON i = (doc_id * doc_id + 31 * pos) % 155),
pred AS (SELECT doc_id, entity, x.l3 AS category FROM ment m JOIN leaf x ON x.i = CASE WHEN (doc_id + pos) % 7 = 0 THEN (m.i + 1) % 155 ELSE m.i END
         WHERE doc_id % 13 <> 0 AND (doc_id + pos) % 5 <> 0
         UNION ALL SELECT DISTINCT doc_id, 'zzzzzz', 'city' FROM ment WHERE doc_id % 13 <> 0 AND doc_id % 11 = 0),
-- marking: each mention is sought from the end of the last found before it
cur AS (SELECT *, list_reduce(list_prepend(0, list(entity) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)), lambda a, b: 0) AS z FROM (SELECT doc_id, sentence, pos, entity, i, l1, l2, l3 FROM ment)),
cls AS (SELECT (doc_id * 3 + pos) * 3 + k AS row_id, doc_id, pos, k + 1 AS level, entity, sentence, [l1, l2, l3][k + 1] AS answer FROM ment, range(3) r(k)),
hist AS (SELECT answer, count(*) AS n FROM cls GROUP BY answer),
tot AS (SELECT sum(n)::DOUBLE AS total, count(*)::DOUBLE AS k FROM hist),
coh AS (SELECT sum(m * (m - 1) / 2) AS close FROM (SELECT branch, sum(n)::DOUBLE AS m FROM hist JOIN branch ON name = answer GROUP BY branch)),
met AS (SELECT close / (total * (total - 1) / 2) AS cohesion_score,
    (SELECT -sum(n / total * log2(n / total)) / log2(k) FROM hist) AS normalized_entropy,
    (SELECT (k + 1 - 2 * sum(n * (k - rn + 1)) / total) / k FROM (SELECT n, row_number() OVER (ORDER BY n) AS rn FROM hist)) AS gini_coefficient,
    (SELECT stddev_pop(n) / avg(n) FROM hist) AS coefficient_of_variation, total::BIGINT AS n_rows, k::BIGINT AS n_classes FROM tot, coh),
toks AS (SELECT doc_id, sentence, regexp_extract_all(sentence, '{TOKEN}') AS t FROM sent WHERE doc_id IN (SELECT doc_id FROM ment)),
tokp AS (SELECT doc_id, unnest(range(len(t)))::INTEGER AS pos, unnest(t) AS token FROM toks),
placed AS (SELECT m.doc_id, m.pos AS k, list_position(t, entity) - 1 AS at, replace(l3, ' ', '_') AS tag FROM ment m JOIN toks USING (doc_id) WHERE list_contains(t, entity)),
tag AS (SELECT p.doc_id, p.pos, p.token, coalesce('B-' || arg_max(x.tag, x.k), 'O') AS tag FROM tokp p LEFT JOIN placed x ON x.doc_id = p.doc_id AND x.at = p.pos GROUP BY p.doc_id, p.pos, p.token)
"""


PRELUDE = "\n".join(line for line in prelude().splitlines() if not line.startswith(("cur AS", "-- marking")))


def sql(body: str) -> str:
    return PRELUDE + body.strip()
