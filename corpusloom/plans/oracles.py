"""DuckDB SQL of the queries in catalog, over the same tables."""

from __future__ import annotations

TEXTS = """
t AS (SELECT doc_id AS id, doc_id AS number, text AS matn, translate(lower(text), 'éèêàâçôûüäößñóíáú''', 'eeeaacouuaosnoiau') AS norm,
  source AS book, lang AS chapter, split_part(text, chr(10), 1) AS isnad FROM documents)"""

PEOPLE = """
p AS (SELECT s_suppkey AS id, s_name AS name, n_name AS residence, r_name AS region, CASE WHEN s_suppkey % 13 <> 0 THEN 1 + s_suppkey % 12 END AS rank,
  20 + s_suppkey * 7 % 180 AS birth, CASE WHEN s_suppkey % 9 <> 0 THEN 70 + s_suppkey * 11 % 200 END AS death,
  CASE WHEN s_suppkey % 10 <> 0 THEN 1 + s_suppkey % 8 END AS generation, CASE WHEN s_suppkey % 4 = 0 THEN 1 + s_suppkey % 5 END AS tadlis_tier,
  s_suppkey % 6 = 0 AS mixed_up, CASE WHEN s_suppkey % 6 = 0 THEN 1 + s_suppkey % 3 END AS severity, s_suppkey % 12 = 0 AS none_after
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

LINKS = """
lv AS (SELECT text_id, level, person, min(f) AS f FROM (SELECT l_orderkey AS text_id, l_suppkey AS person, l_returnflag AS f,
  dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS level FROM lineitem) GROUP BY ALL),
e AS (SELECT a.text_id, a.level AS step, a.person AS student, b.person AS sheikh, CASE a.f WHEN 'R' THEN 'heard' WHEN 'A' THEN 'from' END AS term
  FROM lv a JOIN lv b ON a.text_id = b.text_id AND b.level = a.level + 1 AND a.person <> b.person)"""

CHAINS = """
c0 AS (SELECT l_orderkey AS text_id, l_suppkey AS student, l_returnflag AS f, lead(l_suppkey) OVER w AS sheikh, row_number() OVER w AS n FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag)),
c AS (SELECT text_id, student, sheikh, CASE f WHEN 'R' THEN 'heard' WHEN 'A' THEN 'from' END AS term, row_number() OVER (PARTITION BY text_id ORDER BY n) AS step
  FROM c0 WHERE sheikh IS NOT NULL AND sheikh <> student)"""

GROUPS = """
g AS (SELECT o_orderkey AS text_id, o_orderkey // 30 AS gid, c_mktsegment AS book FROM orders JOIN customer ON o_custkey = c_custkey)"""

RELATIONS = """
rel AS (SELECT DISTINCT sheikh AS teacher, student FROM c WHERE term = 'heard')"""

RULES = f"{PEOPLE}, {CHAINS}, {GROUPS}, {RELATIONS}, ch AS (SELECT c.*, g.gid, g.book, c.text_id % 3 = 0 AS raised FROM c JOIN g USING (text_id)), tp AS (SELECT *, coalesce(rank, 7) AS t, rank IS NOT NULL AS ranked FROM p)"

SEARCH = "id, book, number, length(norm)::INT AS n FROM t WHERE "
TOP = ""  # these queries give every match


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(norm, '{w}') OR contains(book, '{w}') OR coalesce(contains(isnad, '{w}'), false)" for w in words) + ")"


def _nodes(select: str) -> str:
    return f"""WITH RECURSIVE {PEOPLE}, {LINKS}, {GROUPS},
r AS (SELECT DISTINCT gid, text_id, book, student AS person, NULL::BIGINT AS student, 0 AS step FROM e JOIN g USING (text_id) WHERE step = 1
  UNION ALL SELECT gid, text_id, book, sheikh, student, step FROM e JOIN g USING (text_id)),
low AS (SELECT gid, person, min(step) AS low FROM r GROUP BY ALL),
v AS (SELECT r.* FROM r JOIN p a ON a.id = r.student JOIN p b ON b.id = r.person WHERE r.step > 0 AND r.student <> r.person AND NOT (coalesce(a.rank = 1, false) AND NOT coalesce(b.rank = 1, false)))
{select}"""


_SIDES = """min(CASE WHEN flag THEN t END) AS b1, count(CASE WHEN flag THEN 1 END) AS n1, string_agg(CASE WHEN flag THEN student END, ',' ORDER BY student) AS w1, bool_or(CASE WHEN flag THEN ranked END) AS a1,
  min(CASE WHEN NOT flag THEN t END) AS b0, count(CASE WHEN NOT flag THEN 1 END) AS n0, string_agg(CASE WHEN NOT flag THEN student END, ',' ORDER BY student) AS w0"""
_JUDGED = """j AS (SELECT *, CASE WHEN abs(b1 - b0) >= 2 THEN sign(b0 - b1) WHEN n1 <> n0 THEN sign(n1 - n0) ELSE sign(b0 - b1) END AS k FROM s WHERE n1 > 0 AND n0 > 0),
f AS (SELECT gid, '{kind}' AS type, (CASE WHEN k < 0 AND NOT coalesce(a1, false) THEN 0 WHEN k < 0 THEN 2 WHEN k > 0 THEN 1 ELSE 0 END)::INT AS severity,
  (CASE WHEN k < 0 AND NOT coalesce(a1, false) THEN 0.35 WHEN k < 0 THEN 0.6 WHEN k > 0 THEN 0.5 ELSE 0.4 END)::DOUBLE AS confidence,
  sheikh || ':' || CASE WHEN k < 0 THEN w1 WHEN k > 0 THEN w0 ELSE w1 || '|' || w0 END AS people, (n1 + n0)::BIGINT AS n_texts FROM j)"""

MASKING = f"""WITH {RULES}, m AS (SELECT gid, student, sheikh, bool_or(coalesce(term = 'heard', false)) AS heard, bool_or(coalesce(term = 'from', false)) AS vague,
  bool_or(coalesce(term = 'from', false) AND book IN ('BUILDING')) AS safe, any_value(tadlis_tier) AS t, count(DISTINCT CASE WHEN term = 'from' THEN text_id END) AS n
  FROM ch JOIN p ON p.id = student WHERE tadlis_tier >= 3 GROUP BY gid, student, sheikh)
SELECT gid, 'masking' AS type, (CASE WHEN heard THEN 0 WHEN safe THEN 1 ELSE 2 END)::INT AS severity,
  (CASE WHEN heard THEN 0.3 WHEN safe THEN 0.4 WHEN t >= 4 THEN 0.75 ELSE 0.6 END)::DOUBLE AS confidence, student || ',' || sheikh AS people, n AS n_texts FROM m WHERE vague"""

def _containment() -> str:
    part = lambda name, src: f"""{name}w AS (SELECT k, list_transform(list_filter(regexp_split_to_array(translate(regexp_replace(translate(lower(coalesce(x, '')), 'éèêàâçôûüäößñóíáú''', 'eeeaacouuaosnoiau'), '[^a-z\\s]', ' ', 'g'), 'y', 'i'), '\\s+'), lambda w: w NOT IN ('', 'of', 'to', 'in', 'on', 'at')), lambda w: CASE WHEN length(w) >= 4 AND w[1] IN ('d', 'l', 'n', 's', 'q') THEN w[2:] ELSE w END) AS w FROM ({src})),
{name} AS (SELECT DISTINCT k, w[i] || ' ' || w[i + 1] AS b FROM (SELECT k, w, unnest(range(1, len(w))) AS i FROM {name}w))"""  # noqa: E731
    return f"""{part("a", "SELECT item_id AS k, text AS x FROM benchmark")}, {part("b", "SELECT doc_id AS k, text AS x FROM documents")},
n AS (SELECT k, count(*) AS n FROM a GROUP BY k),
m AS (SELECT a.k AS input_id, b.k AS id, count(*) / any_value(n.n) AS s FROM a JOIN b USING (b) JOIN n ON n.k = a.k GROUP BY a.k, b.k)"""


#: The negators in a text, also behind one joined letter.
_NEGATORS = r"""list_transform(list_filter(regexp_split_to_array(regexp_replace(translate(lower({0}), 'éèêàâçôûüäößñóíáú''', 'eeeaacouuaosnoiau'), '[^a-z\s]', ' ', 'g'), '\s+'),
  lambda w: regexp_full_match(w, '[dl]?(not|no|nor|never|nicht|kein|pas|non)')), lambda w: regexp_replace(w, '^[dl]', ''))"""

SHIFTED = """
a AS (SELECT l_orderkey AS text_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 AS pos, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS id FROM lineitem),
b AS (SELECT text_id, pos + (text_id % 11 = 0)::INT AS pos, CASE WHEN id % 5 <> 0 THEN id END AS id FROM a)"""

ORACLES: dict[str, str] = {
    "symbol_filter": """WITH k AS (SELECT p_size AS item, p_partkey AS id, contains(split_part(p_brand, '#', -1), (p_size % 5 + 1)::VARCHAR) AS f FROM part)
  SELECT item, id FROM (SELECT *, bool_or(f) OVER (PARTITION BY item) AS any_f FROM k) WHERE f OR NOT any_f""",
    "chain_changes": f"""WITH {SHIFTED} SELECT text_id, pos, a.id AS was, b.id AS now, CASE WHEN a.id IS NULL THEN 'gained' WHEN b.id IS NULL THEN 'lost' ELSE 'changed' END AS change
  FROM a FULL JOIN b USING (text_id, pos) WHERE a.id IS DISTINCT FROM b.id""",
    "chain_agreement": f"""WITH {SHIFTED}, s AS (SELECT unnest([-1, 0, 1]) AS shift), x AS (SELECT text_id, pos, shift, id FROM a, s WHERE id IS NOT NULL AND pos < 4),
  y AS (SELECT text_id, pos + shift AS pos, shift, id FROM b, s WHERE id IS NOT NULL AND pos + shift BETWEEN 0 AND 3), j AS (SELECT text_id, shift, x.id AS a, y.id AS b FROM x FULL JOIN y USING (text_id, shift, pos)),
  k AS (SELECT text_id, shift, count(*) FILTER (a = b) AS same, count(*) FILTER (a <> b) AS differ, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right FROM j GROUP BY text_id, shift)
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY same DESC, abs(shift), shift) = 1""",
    "severity_pivot": f"""WITH {RULES}, br AS (SELECT gid, sheikh, student, bool_or(raised) AS flag FROM ch GROUP BY gid, sheikh, student HAVING bool_or(raised) = bool_and(raised)),
  s AS (SELECT gid, sheikh, {_SIDES} FROM br JOIN tp ON tp.id = student GROUP BY gid, sheikh), {_JUDGED.format(kind="raised_stopped")}, every AS (SELECT type, severity FROM f UNION ALL SELECT type, severity FROM ({MASKING.replace("WITH " + RULES + ", m AS", "WITH m AS")}))
  SELECT type, count(*) FILTER (severity = 0) AS notes, count(*) FILTER (severity = 1) AS harmless, count(*) FILTER (severity = 2) AS harmful FROM every GROUP BY type""",
    "normalize_text": f"WITH {TEXTS} SELECT id, norm, len(list_distinct(list_filter(regexp_extract_all(norm, '[a-z]+'), lambda w: length(w) >= 2)))::INT AS n_terms FROM t",
    "search_all_words": f"WITH {TEXTS} SELECT {SEARCH} {_any(['there'])} AND {_any(['anti'])} {TOP}",
    "search_any_word": f"WITH {TEXTS} SELECT {SEARCH} ({_any(['thanedble'])} OR {_any(['eneau'])}) {TOP}",
    "search_exact": f"WITH {TEXTS} SELECT {SEARCH} contains(norm, 'of the ') {TOP}",
    "search_not": f"WITH {TEXTS} SELECT {SEARCH} contains(norm, 'the ') AND NOT contains(norm, 'anti') {TOP}",
    "search_and_or": f"WITH {TEXTS} SELECT {SEARCH} contains(norm, 'en') AND (contains(norm, 'ereau') OR contains(norm, 'thhe')) {TOP}",
    "search_scope_all": f"WITH {TEXTS} SELECT {SEARCH} {_any(['src1'])} {TOP}",
    "search_ordered": f"""WITH {TEXTS} SELECT id, book, number, length(norm)::INT AS n FROM t WHERE norm LIKE '%the %ing%' AND contains(substr(norm, instr(norm, 'the ') + length('ing')), 'ing')
  ORDER BY length(norm), id LIMIT 100""",
    "search_proximity": f"""WITH {TEXTS}, h AS (SELECT * FROM t WHERE contains(norm, 'the ') AND contains(norm, 'ing') ORDER BY length(norm), id LIMIT 100),
  q AS (SELECT *, list_filter(string_split(norm, ' '), lambda w: w <> '') AS ws FROM h), z AS (SELECT *, list_position(list_transform(ws, lambda w: contains(w, 'the')), true) AS x, list_position(list_transform(ws, lambda w: contains(w, 'ing')), true) AS y FROM q)
  SELECT id, book, number, length(norm)::INT AS n FROM z WHERE x > 0 AND y > 0 AND abs(x - y) <= 5""",
    "books": "SELECT DISTINCT source AS book FROM documents",
    "chapters_by_min": "SELECT lang AS chapter, min(doc_id) AS first_number FROM documents WHERE source = 'src1' GROUP BY lang",
    "chapter_items": "SELECT doc_id AS id, doc_id AS number, substr(text, 1, 150) AS head FROM documents WHERE source = 'src1' AND lang = 'en'",
    "related_texts": f"""WITH {TEXTS}, q AS (SELECT id AS of, CASE WHEN length(norm) > 110 THEN substr(norm, 31, 80) WHEN length(norm) > 40 THEN substr(norm, 1, 40) ELSE norm END AS needle FROM t WHERE id IN (SELECT id FROM t WHERE id % 50 = 0)),
  h AS (SELECT of, id, row_number() OVER (PARTITION BY of ORDER BY id) AS n FROM q JOIN t ON contains(norm, needle) AND id <> of WHERE needle <> '') SELECT of, id FROM h WHERE n <= 20""",
    "narrator_detail": f"""WITH {PEOPLE}, ev AS (SELECT doc_id % 100 + 1 AS person, source AS scholar, CASE WHEN toxic = 1 THEN 'blame' WHEN quality = 1 THEN 'praise' ELSE 'none' END AS verdict FROM documents JOIN labels USING (doc_id))
  SELECT id, name, rank::INT AS rank, coalesce((SELECT string_agg(scholar || '=' || verdict, ',' ORDER BY scholar, verdict) FROM ev WHERE person = id), '') AS evaluations FROM p""",
    "narrator_tooltip": f"""WITH {PEOPLE}, ev AS (SELECT doc_id % 100 + 1 AS person, source AS scholar, CASE WHEN toxic = 1 THEN 'blame' WHEN quality = 1 THEN 'praise' ELSE 'none' END AS verdict FROM documents JOIN labels USING (doc_id))
  SELECT id, name, coalesce(['صحابي', 'ثقة ثبت', 'ثقة', 'صدوق', 'صدوق يهم', 'مقبول', 'مستور', 'ضعيف', 'مجهول', 'متروك', 'متهم', 'كذاب'][rank], (SELECT verdict FROM ev WHERE person = id ORDER BY scholar, verdict LIMIT 1), 'غير معروف') AS grade FROM p""",
    "consensus": """WITH ev AS (SELECT doc_id % 100 + 1 AS person, CASE WHEN toxic = 1 THEN 'blame' WHEN quality = 1 THEN 'praise' END AS camp FROM documents JOIN labels USING (doc_id)),
  k AS (SELECT person, count(*) FILTER (camp = 'praise') AS praise, count(*) FILTER (camp = 'blame') AS blame, count(*) FILTER (camp IS NULL) AS other FROM ev GROUP BY person),
  s AS (SELECT *, CASE WHEN praise > 0 AND blame > 0 THEN 'dispute' WHEN praise + blame >= 2 THEN 'agree' WHEN praise + blame = 1 THEN 'single' ELSE 'none' END AS status FROM k)
  SELECT *, CASE status WHEN 'agree' THEN 'supported' WHEN 'none' THEN 'insufficient' ELSE 'verify' END AS evidence FROM s""",
    "chain_tree": f"""WITH RECURSIVE {PEOPLE}, {LINKS}, w(text_id, step, person, parent) AS (SELECT DISTINCT text_id, 0, student, NULL::BIGINT FROM e WHERE step = 1
  UNION ALL SELECT w.text_id, w.step + 1, e.sheikh, w.person FROM w JOIN e ON e.text_id = w.text_id AND e.step = w.step + 1 AND e.student = w.person)
  SELECT text_id, step, person, parent, CASE WHEN rank = 1 THEN 'companion' WHEN rank IN (2, 3) THEN 'reliable' WHEN rank IN (4, 5) THEN 'mostly_reliable' WHEN rank IN (6, 7, 8) THEN 'weak' WHEN rank = 9 THEN 'unknown' WHEN rank IN (10, 11) THEN 'abandoned' WHEN rank = 12 THEN 'fabricator' END AS grade FROM w LEFT JOIN p ON p.id = person""",
    "chain_anomalies": f"""WITH {PEOPLE}, {LINKS}, r AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
  q AS (SELECT id, birth, death, unnest(CASE WHEN id % 4 = 0 THEN [residence, 'NATION_' || id % 25] ELSE [residence] END) AS place FROM p),
  l AS (SELECT id, any_value(birth) AS birth, any_value(death) AS death, list(place) AS places, list(coalesce(r_name, place)) AS regions FROM q LEFT JOIN r ON n_name = place GROUP BY id)
  SELECT text_id, step, student, sheikh, coalesce(a.birth > b.death, false) AS anachronism,
  NOT coalesce(a.birth > b.death, false) AND NOT list_has_any(a.places, b.places) AND NOT list_has_any(a.regions, b.regions) AS apart FROM e JOIN l a ON a.id = student JOIN l b ON b.id = sheikh WHERE step > 1""",
    "merged_nodes": _nodes("""SELECT gid, person, step, n_sources, books, CASE WHEN step > 0 AND k = 1 THEN s END AS parent FROM (SELECT gid, person, min(step) AS step, count(DISTINCT text_id) AS n_sources, string_agg(DISTINCT book, ',' ORDER BY book) AS books
  FROM r JOIN low USING (gid, person) WHERE low > 0 OR step = 0 GROUP BY gid, person) LEFT JOIN (SELECT gid, person, count(DISTINCT student) AS k, min(student) AS s FROM v GROUP BY gid, person) USING (gid, person)"""),
    "merged_edges": _nodes("""SELECT gid, person AS sheikh, student, step, n_sources, books FROM (SELECT gid, person, student, greatest(1, min(step)) AS step, count(DISTINCT text_id) AS n_sources, string_agg(DISTINCT book, ',' ORDER BY book) AS books,
  count(*) OVER (PARTITION BY gid, person) AS k FROM v GROUP BY gid, person, student) JOIN low USING (gid, person) WHERE k > 1 OR low = 0"""),
    "all_paths_uncapped": f"""WITH RECURSIVE {LINKS}, d AS (SELECT DISTINCT text_id, step, student, sheikh FROM e),
  w(text_id, path, step, person, done) AS (SELECT text_id, [student, sheikh], step, sheikh, false FROM d WHERE step = 1
  UNION ALL SELECT text_id, CASE WHEN nxt IS NULL THEN path ELSE list_append(path, nxt) END, coalesce(s, step), coalesce(nxt, person), nxt IS NULL FROM (
    SELECT w.text_id, w.path, w.step, w.person, d.sheikh AS nxt, d.step AS s, min(d.step) OVER (PARTITION BY w.text_id, w.path) AS low FROM w LEFT JOIN d ON d.text_id = w.text_id AND d.student = w.person AND d.step > w.step AND NOT list_contains(w.path, d.sheikh) WHERE NOT w.done) WHERE s IS NULL OR s = low)
  SELECT DISTINCT text_id, array_to_string(path, '>') AS path FROM w WHERE done""",
    "reachable": f"""WITH RECURSIVE {LINKS}, f AS (SELECT text_id, min(sheikh) AS person FROM e GROUP BY text_id),
  u(text_id, person, step) AS (SELECT f.text_id, e.sheikh, e.step FROM f JOIN e ON e.text_id = f.text_id AND e.student = f.person UNION SELECT e.text_id, e.sheikh, e.step FROM u JOIN e ON e.text_id = u.text_id AND e.student = u.person AND e.step = u.step + 1),
  d(text_id, person, step) AS (SELECT f.text_id, e.student, e.step FROM f JOIN e ON e.text_id = f.text_id AND e.sheikh = f.person UNION SELECT e.text_id, e.student, e.step FROM d JOIN e ON e.text_id = d.text_id AND e.sheikh = d.person AND e.step = d.step - 1)
  SELECT text_id, person FROM u UNION SELECT text_id, person FROM d UNION SELECT text_id, person FROM f""",
    "split_points": f"WITH {CHAINS}, {GROUPS} SELECT gid, sheikh AS madar, count(DISTINCT student) AS n_students, count(DISTINCT text_id) AS n_texts, string_agg(DISTINCT student, ',' ORDER BY student) AS students FROM c JOIN g USING (text_id) GROUP BY gid, sheikh HAVING count(DISTINCT student) >= 2",
    "main_companion": f"""WITH {PEOPLE}, {CHAINS}, {GROUPS}, tp AS (SELECT text_id, arg_max(sheikh, step) AS top FROM c GROUP BY text_id), k AS (SELECT gid, top, count(*) AS n, min(text_id) AS f FROM tp JOIN p ON p.id = top JOIN g USING (text_id) WHERE rank = 1 GROUP BY gid, top)
  SELECT gid, top AS main, n FROM k QUALIFY row_number() OVER (PARTITION BY gid ORDER BY n DESC, f) = 1""",
    "witness_flags": f"""WITH {PEOPLE}, {CHAINS}, {GROUPS}, tp AS (SELECT text_id, arg_max(sheikh, step) AS top FROM c GROUP BY text_id), k AS (SELECT gid, top, count(*) AS n, min(text_id) AS f FROM tp JOIN p ON p.id = top JOIN g USING (text_id) WHERE rank = 1 GROUP BY gid, top),
  m AS (SELECT gid, top AS main FROM k QUALIFY row_number() OVER (PARTITION BY gid ORDER BY n DESC, f) = 1) SELECT gid, text_id, top, coalesce(rank = 1 AND top <> main, false) AS is_witness FROM tp JOIN g USING (text_id) LEFT JOIN m USING (gid) LEFT JOIN p ON p.id = top""",
    "weakest_link": f"WITH {PEOPLE}, {CHAINS} SELECT text_id, (SELECT sheikh FROM c x JOIN p ON p.id = sheikh WHERE x.text_id = c.text_id AND rank IS NOT NULL ORDER BY rank DESC, step LIMIT 1) AS weakest, max(rank)::INT AS tier, count(*) FILTER (rank IS NULL) AS unrated FROM c JOIN p ON p.id = sheikh GROUP BY text_id",
    "rule_tadlis": MASKING,
    "rule_ikhtilat": f"""WITH {RULES}, m AS (SELECT gid, sheikh, student, any_value(severity) AS s, any_value(none_after) AS na, any_value(t) AS t, bool_and(book IN ('BUILDING')) AS safe, count(DISTINCT text_id) AS n, (sheikh + student) % 5 AS w FROM ch JOIN tp ON tp.id = sheikh WHERE mixed_up GROUP BY gid, sheikh, student),
  f AS (SELECT *, CASE WHEN w = 1 OR (w = 0 AND na) THEN NULL WHEN w = 2 THEN CASE WHEN s = 3 AND NOT safe THEN 2 WHEN s IN (2, 3) THEN 1 ELSE 0 END WHEN w IN (3, 4) THEN CASE WHEN NOT safe AND s <> 1 THEN 0 END WHEN NOT safe AND s <> 1 AND NOT (s = 2 AND t < 5) THEN 0 END AS sev,
  CASE WHEN w = 2 THEN CASE WHEN s = 3 AND NOT safe THEN 0.8 WHEN s IN (2, 3) THEN 0.5 ELSE 0.35 END WHEN w IN (3, 4) THEN 0.4 WHEN s = 3 THEN 0.45 ELSE 0.3 END AS conf FROM m)
  SELECT gid, 'mixing_up' AS type, sev::INT AS severity, conf::DOUBLE AS confidence, sheikh || ',' || student AS people, n AS n_texts FROM f WHERE sev IS NOT NULL""",
    "rule_hidden_break": f"""WITH {RULES}, k AS (SELECT teacher AS x FROM rel UNION SELECT student FROM rel), m AS (SELECT gid, student, sheikh, bool_or(coalesce(term = 'heard', false)) AS heard, count(DISTINCT text_id) AS n FROM ch WHERE step > 1 GROUP BY gid, student, sheikh)
  SELECT gid, 'hidden_break' AS type, 0 AS severity, (CASE WHEN NOT a.ranked OR NOT b.ranked THEN 0.2 WHEN heard THEN 0.25 ELSE 0.45 END)::DOUBLE AS confidence, m.student || ',' || m.sheikh AS people, n AS n_texts FROM m JOIN tp a ON a.id = m.student JOIN tp b ON b.id = m.sheikh
  WHERE m.student IN (SELECT x FROM k) AND m.sheikh IN (SELECT x FROM k) AND NOT EXISTS (SELECT 1 FROM rel WHERE teacher = m.sheikh AND rel.student = m.student)""",
    "rule_raf_waqf": f"""WITH {RULES}, br AS (SELECT gid, sheikh, student, bool_or(raised) AS flag FROM ch GROUP BY gid, sheikh, student HAVING bool_or(raised) = bool_and(raised)),
  s AS (SELECT gid, sheikh, {_SIDES} FROM br JOIN tp ON tp.id = student GROUP BY gid, sheikh), {_JUDGED.format(kind="raised_stopped")} SELECT * FROM f""",
    "rule_wasl_irsal": f"""WITH {RULES}, sc AS (SELECT id FROM tp WHERE coalesce(rank, 0) <> 1 AND generation BETWEEN 2 AND 5),
  l AS (SELECT gid, text_id, arg_max(sheikh, step) AS top, arg_max(student, step) AS below, bool_or(raised) AS raised FROM ch GROUP BY gid, text_id),
  cut AS (SELECT gid, top AS sheikh, text_id, below AS student FROM l WHERE raised AND top IN (SELECT id FROM sc)),
  jn AS (SELECT u.gid, u.student AS sheikh, u.text_id, d.student FROM ch u JOIN tp ON tp.id = u.sheikh AND rank = 1 JOIN ch d ON d.gid = u.gid AND d.text_id = u.text_id AND d.step = u.step - 1 WHERE (u.gid, u.student) IN (SELECT (gid, sheikh) FROM cut)),
  per AS (SELECT DISTINCT gid, sheikh, student, false AS flag FROM cut UNION SELECT DISTINCT gid, sheikh, student, true FROM jn),
  s AS (SELECT gid, sheikh, {_SIDES} FROM per JOIN tp ON tp.id = student GROUP BY gid, sheikh), {_JUDGED.format(kind="joined_cut")}
  SELECT gid, 'joined_cut' AS type, 0 AS severity, 0.35::DOUBLE AS confidence, sheikh::VARCHAR AS people, count(DISTINCT text_id) AS n_texts FROM cut WHERE (gid, sheikh) NOT IN (SELECT (gid, sheikh) FROM jn) GROUP BY gid, sheikh UNION ALL SELECT * FROM f""",
    "structural_grade": f"""WITH {PEOPLE}, {CHAINS}, {GROUPS}, wk AS (SELECT text_id, (SELECT sheikh FROM c x JOIN p ON p.id = sheikh WHERE x.text_id = c.text_id AND rank IS NOT NULL ORDER BY rank DESC, step LIMIT 1) AS weakest, max(rank) AS tier, count(*) FILTER (rank IS NULL) AS unrated FROM c JOIN p ON p.id = sheikh GROUP BY text_id),
  j AS (SELECT *, tier IS NOT NULL AND (unrated = 0 OR tier >= 6) AS judged, unrated > 0 AND NOT coalesce(tier >= 6, false) AS open FROM wk JOIN g USING (text_id)),
  a AS (SELECT gid, min(CASE WHEN judged THEN tier END)::INT AS best, count(*) FILTER (judged) AS routes, count(*) FILTER (open) AS opens, count(DISTINCT CASE WHEN judged AND tier BETWEEN 6 AND 8 THEN weakest END) AS weak FROM j GROUP BY gid)
  SELECT gid, CASE WHEN routes = 0 AND opens > 0 THEN 'غير محرر' WHEN routes = 0 THEN 'مجهول' WHEN best <= 3 THEN 'صحيح' WHEN best <= 5 THEN 'حسن' WHEN best <= 8 THEN CASE WHEN opens > 0 THEN 'غير محرر' WHEN weak >= 2 THEN 'حسن لغيره' ELSE 'ضعيف' END ELSE 'موضوع / متروك' END AS grade, best, routes FROM a""",
    "finding_counts": f"""WITH f AS ({MASKING}) SELECT gid, count(*) FILTER (severity = 2) AS harmful, count(*) FILTER (severity = 1) AS harmless, count(*) FILTER (severity = 0) AS notes, bool_or(severity = 2) AS has_harmful, count(*) FILTER (severity = 0 AND confidence < 0.3) AS low_confidence FROM f GROUP BY gid""",
    "verify_containment": f"WITH {_containment()} SELECT input_id, id, round_even(s, 3) AS similarity FROM m WHERE s >= 0.3",
    "verify_status": f"""WITH {_containment()}, z AS (SELECT input_id, id, round_even(s, 3) AS similarity, text AS matn FROM m JOIN documents ON doc_id = id WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY round_even(s, 3) DESC, length(text), id) = 1),
  x AS (SELECT item_id, text, coalesce(similarity, 0) AS similarity, id, {_NEGATORS.format("text")} AS given, {_NEGATORS.format("coalesce(matn, '')")} AS held FROM benchmark LEFT JOIN z ON input_id = item_id)
  SELECT item_id AS input_id, similarity, id AS best, CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 3 OR length(text) > 600 THEN 'invalid' WHEN id IS NOT NULL AND len(list_filter(given, lambda w: NOT list_contains(held, w))) > 0 THEN 'not-found' WHEN similarity >= 0.95 THEN 'exact' WHEN similarity >= 0.6 THEN 'variant' ELSE 'not-found' END AS status FROM x""",
    "fame_pick": """WITH k AS (SELECT p_partkey // 3 AS key, p_partkey AS id, p_size AS fame FROM part), r AS (SELECT *, row_number() OVER w AS n, lead(fame) OVER w AS nxt FROM k WINDOW w AS (PARTITION BY key ORDER BY fame DESC, id))
  SELECT key, id FROM r WHERE n = 1 AND (nxt IS NULL OR fame >= 3 * greatest(1, nxt))""",
    "strict_relations": f"""WITH {CHAINS}, {RELATIONS}, k AS (SELECT student AS owner, text_id % 1000 AS item, sheikh AS id FROM c WHERE sheikh <> student),
  a AS (SELECT owner, item, count(DISTINCT k.id) AS n, min(k.id) AS one, count(DISTINCT rel.teacher) AS nb, min(rel.teacher) AS oneb FROM k LEFT JOIN rel ON rel.teacher = k.id AND rel.student = k.owner GROUP BY owner, item)
  SELECT owner, item, CASE WHEN n = 1 THEN one ELSE oneb END AS id FROM a WHERE n = 1 OR nb = 1""",
    "trigram_match": """WITH a AS (SELECT item_id AS k, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')[1:70] AS w FROM benchmark), b AS (SELECT doc_id AS k, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')[1:80] AS w FROM documents),
  ga AS (SELECT DISTINCT k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM a)), gb AS (SELECT DISTINCT k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
  n AS (SELECT k, count(*) AS n FROM ga GROUP BY k HAVING count(*) >= 5), h AS (SELECT ga.k AS left_id, gb.k AS right_id, count(*) / any_value(n.n) AS s FROM ga JOIN n USING (k) JOIN gb USING (x) GROUP BY ga.k, gb.k)
  SELECT left_id, right_id, s AS best, coalesce(nxt, 0) AS second FROM (SELECT *, lead(s) OVER w AS nxt, row_number() OVER w AS r FROM h WINDOW w AS (PARTITION BY left_id ORDER BY s DESC, right_id)) WHERE r = 1""",
    "chain_report": f"""WITH {PEOPLE}, n AS (SELECT g.book, l_orderkey AS text_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 AS pos, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS id FROM lineitem JOIN (SELECT o_orderkey, c_mktsegment AS book FROM orders JOIN customer ON o_custkey = c_custkey) g ON g.o_orderkey = l_orderkey),
  a AS (SELECT book, text_id, count(id) AS k, max(CASE WHEN id IS NOT NULL THEN pos END) AS last, max(pos) AS fin, arg_max(id, CASE WHEN id IS NOT NULL THEN pos END) AS top FROM n GROUP BY book, text_id), r AS (SELECT a.*, rank, k >= 2 AS chain FROM a LEFT JOIN p ON p.id = top)
  SELECT book, count(*) AS chains, count(*) FILTER (chain AND coalesce(rank = 1, false)) AS companion, count(*) FILTER (chain AND coalesce(rank <> 1, true)) AS cut, count(*) FILTER (chain AND last < fin) AS junk, count(*) FILTER (chain AND k < last) AS gap, count(*) FILTER (NOT chain) AS no_chain FROM r GROUP BY ROLLUP (book)""",
    "retrieval_metrics": f"""WITH {_containment()}, k AS (SELECT input_id, row_number() OVER (PARTITION BY input_id ORDER BY round_even(s, 3) DESC, id) AS r, s FROM m WHERE s >= 0.3), bst AS (SELECT input_id, min(CASE WHEN round_even(s, 3) >= 0.95 THEN r END) AS rank FROM k GROUP BY input_id), z AS (SELECT item_id, rank FROM benchmark LEFT JOIN bst ON input_id = item_id)
  SELECT count(*) AS queries, count(*) FILTER (rank <= 1) AS hit1, count(*) FILTER (rank <= 3) AS hit3, count(*) FILTER (rank <= 10) AS hit10, avg(coalesce(1 / rank, 0)) AS mrr FROM z""",
    "json_to_links": """WITH n AS (SELECT l_orderkey AS text_id, row_number() OVER w AS pos, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS id, CASE l_returnflag WHEN 'R' THEN 'heard' ELSE 'from' END AS verb, lag(CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END, 1, 0) OVER w AS prev, lag(CASE l_returnflag WHEN 'R' THEN 'heard' ELSE 'from' END) OVER w AS pv FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag)) SELECT text_id, (row_number() OVER (PARTITION BY text_id ORDER BY pos))::INT AS step, prev AS student, id AS sheikh, pv AS term FROM n WHERE prev IS NOT NULL AND id IS NOT NULL AND prev <> id""",
    "relations_dedup": f"WITH {CHAINS} SELECT DISTINCT sheikh AS teacher, student FROM c WHERE term IN ('heard', 'from')",
    "carry_down": "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events",
    "rate_window": "SELECT event_id, user_id, date_trunc('minute', ts) AS start, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 10 AS allowed FROM events",
}
