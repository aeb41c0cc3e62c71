"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from samewise.functions.normalize import SECRETS, XSS_BASIC
from samewise.plans.queries import THRESHOLDS


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, by rows of the usual table."""
    codes = lambda s: f"list_transform(range(1, length({s}) + 1), lambda j: unicode(substr({s}, j::BIGINT, 1))::INTEGER)"
    cells = f"list_transform(range(1, length({b}) + 1), lambda j: [row[j], row[j + 1], unicode(substr({b}, j::BIGINT, 1))::INTEGER])"
    step = f"list_reduce(list_prepend([0]::INTEGER[], {cells}), lambda acc, t: list_append(acc, CASE WHEN t[3] = x[1] THEN t[1] + 1 ELSE greatest(t[2], acc[-1]) END))"
    rows = f"list_prepend(list_transform(range(0, length({b}) + 1), lambda z: 0::INTEGER), list_transform({codes(a)}, lambda c: [c]))"
    return f"(list_reduce({rows}, lambda row, x: {step}))[-1]"


def ratio(a: str, b: str) -> str:
    return f"((1 - (length({a}) + length({b}) - 2 * {lcs(a, b)}) / (length({a}) + length({b}))) * 100)"


def sort_tokens(a: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex({a}, '\\s+'), lambda w: w <> '')), ' ')"


def as_score(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_NAMES = f"names AS (SELECT DISTINCT {_NORM.format('p_name')} AS n FROM part WHERE p_name IS NOT NULL)"
_TWO = "two AS (SELECT a.n AS a, b.n AS b FROM names a JOIN names b ON a.n < b.n)"
_SETS = """sets AS (SELECT a, b, array_to_string(list_sort(list_intersect(x, y)), ' ') AS c, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS oa,
  array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS ob
  FROM (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM two))"""


def _pairs(score: str, threshold: float, source: str = "two", more: str = "") -> str:
    return f"WITH {_NAMES}, {_TWO}{more} SELECT a AS name_a, b AS name_b, {as_score('s')} AS similarity_score FROM (SELECT a, b, {score} AS s FROM {source}) WHERE s >= {threshold} AND CAST(s AS FLOAT) <> 0"


_SET_SCORE = f"""CASE WHEN c <> '' AND (oa = '' OR ob = '') THEN 100 ELSE greatest(
  (1 - (length(oa) + length(ob) - 2 * {lcs("oa", "ob")}) / (2 * (length(c) + (c <> '')::INT) + length(oa) + length(ob))) * 100,
  CASE WHEN c <> '' THEN (1 - (1 + length(oa)) / (2 * length(c) + 1 + length(oa))) * 100 ELSE 0 END,
  CASE WHEN c <> '' THEN (1 - (1 + length(ob)) / (2 * length(c) + 1 + length(ob))) * 100 ELSE 0 END) END"""

_WINDOWS = """, sides AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM two
  UNION ALL SELECT a, b, b, a FROM two WHERE length(a) = length(b)),
cuts AS (SELECT a, b, s, unnest(list_concat(list_transform(range(1, length(t) - length(s) + 2), lambda i: substr(t, i::BIGINT, length(s))),
  list_transform(range(1, length(s)), lambda k: substr(t, 1, k::BIGINT)), list_transform(range(1, length(s)), lambda k: substr(t, (length(t) - k + 1)::BIGINT, k::BIGINT)))) AS w FROM sides),
best AS (SELECT a, b, max(r) AS r FROM (SELECT a, b, """ + ratio("s", "w") + """ AS r FROM cuts) GROUP BY a, b)"""

_TOKEN = _NORM.format("p_name")
_SORTED_PAIRS = f"np AS (SELECT a.n AS a, b.n AS b, {ratio('a.t', 'b.t')} AS s FROM (SELECT n, {sort_tokens('n')} AS t FROM names) a JOIN (SELECT n, {sort_tokens('n')} AS t FROM names) b ON a.n <> b.n)"


def _components(threshold: float) -> str:
    """CTEs up to g(entity_id, entity_name, group_id) of parts by token_sort_ratio."""
    return f"""{_NAMES}, {_SORTED_PAIRS}, e AS (SELECT a, b FROM np WHERE s >= {threshold}),
reach(n, r) AS (SELECT n, n FROM names UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.n),
root AS (SELECT n, min(r) AS r FROM reach GROUP BY n),
m AS (SELECT p_partkey AS id, p_name, r FROM part JOIN root ON root.n = {_TOKEN}),
num AS (SELECT r, row_number() OVER (ORDER BY min(id)) AS g FROM m GROUP BY r HAVING count(*) > 1),
g AS (SELECT p.p_partkey AS entity_id, p.p_name AS entity_name, coalesce(num.g, 0)::BIGINT AS group_id FROM part p LEFT JOIN m ON m.id = p.p_partkey LEFT JOIN num ON num.r = m.r)"""


_STATS = """per AS (SELECT group_id, count(*) AS size, count(DISTINCT entity_id) AS ids FROM g GROUP BY group_id),
st AS (SELECT coalesce(sum(size), 0)::BIGINT AS total_entities, count(*) FILTER (group_id > 0) AS duplicate_groups, coalesce(sum(ids) FILTER (group_id > 0), 0)::BIGINT AS entities_with_duplicates,
  coalesce(avg(size) FILTER (group_id > 0), 0) AS average_group_size, coalesce(max(size) FILTER (group_id > 0), 0) AS largest_group_size FROM per)"""
_MEASURES = "sz AS (SELECT group_id, count(*)::DOUBLE AS size FROM g GROUP BY group_id)"


def _expanded(threshold: float) -> str:
    """CTEs up to mp(id1, id2, name1, name2, similarity_score) of pairs of part rows by token_sort_ratio."""
    return f"""rows AS (SELECT p_partkey AS id, p_name AS raw, {_TOKEN} AS n, * FROM part),
mp AS (SELECT x.id AS id1, y.id AS id2, x.raw AS name1, y.raw AS name2, {as_score("CASE WHEN x.n = y.n THEN 100.0 ELSE np.s END")} AS similarity_score
  FROM rows x JOIN rows y ON x.id < y.id LEFT JOIN np ON np.a = x.n AND np.b = y.n WHERE x.n = y.n OR np.s >= {threshold})"""


_EXPANDED = _expanded(85)
_CATALOG = """cat AS (SELECT min(p_partkey) AS cid, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS alt_name, min(p_brand) AS brand, min(p_type) AS kind FROM part GROUP BY p_name)"""


def _cross(left: str, right: str) -> str:
    """Distinct scores of two text columns by token_sort_ratio."""
    a, b = _NORM.format(left), _NORM.format(right)
    return f"""(SELECT l, r, {ratio('lt', 'rt')} AS s FROM (SELECT DISTINCT {a} AS l, {sort_tokens(a)} AS lt FROM part), (SELECT DISTINCT {b} AS r, {sort_tokens(b)} AS rt FROM cat))"""


_CROSS = f"""{_CATALOG}, sc AS (SELECT * FROM {_cross('p_name', 'alt_name')} WHERE s >= 75),
cm AS (SELECT p.p_partkey AS id1, cat.cid AS id2, p.p_name AS name1, cat.alt_name AS name2, {as_score('s')} AS similarity_score, cat.brand
  FROM part p JOIN sc ON sc.l = {_TOKEN} JOIN cat ON {_NORM.format('cat.alt_name')} = sc.r)"""
_RANK = "coalesce(list_position(list_transform(range(1, 26), lambda i: 'Brand#' || i), brand), 26)"


def _consolidate(order: str) -> str:
    return f"""WITH {_CROSS}, nearby AS (SELECT *, max(similarity_score) OVER (PARTITION BY id1) - similarity_score <= 15 AS near FROM cm),
rk AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY {order} similarity_score DESC, id2) AS rn FROM nearby),
ag AS (SELECT id1, max(id2) FILTER (rn = 1) AS main_cid, max(similarity_score) FILTER (rn = 1) AS main_similarity_score, count(*) AS total_matches,
  string_agg(id2::VARCHAR, ', ' ORDER BY similarity_score DESC, id2) AS all_match_ids, string_agg(id2::VARCHAR, ', ' ORDER BY similarity_score DESC, id2) FILTER (rn <> 1) AS other_candidates FROM rk GROUP BY id1)
SELECT p.p_partkey AS id, main_cid, main_similarity_score, other_candidates, coalesce(total_matches, 0) AS total_matches, all_match_ids FROM part p LEFT JOIN ag ON ag.id1 = p.p_partkey"""


_CATNAMES = f"cn AS (SELECT cid, alt_name, {_NORM.format('alt_name')} AS n FROM cat)"
_SPACE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _sanitize(x: str) -> str:
    out = _SPACE.format(rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')")
    for p in XSS_BASIC:
        out = f"regexp_replace({out}, '(?is){p}', '', 'g')"
    return out


def _sanitized() -> str:
    return f"SELECT doc_id, {_sanitize('text')} AS text FROM documents"


def _secrets() -> str:
    parts = []
    for kind, p in SECRETS.items():
        p, group = p.replace("'", "''"), 1 if "(" in p else 0
        parts.append(f"""SELECT doc_id, '{kind}' AS type, unnest(v) AS value, unnest(range(1, len(v) + 1))::INTEGER AS nth,
          unnest(list_transform(range(1, len(v) + 1), lambda i: length(array_to_string(cut[:i], '')) + length(array_to_string(hit[:i - 1], ''))))::INTEGER AS position
          FROM (SELECT doc_id, regexp_extract_all(text, '(?i){p}', {group}) AS v, regexp_extract_all(text, '(?i){p}') AS hit, string_split_regex(text, '(?i){p}') AS cut FROM documents)""")
    return " UNION ALL ".join(parts)


# WRatio: texts in three forms (as they are, tokens sorted, distinct tokens sorted), their windows, and the weights
_WEIGHTED = f"""WITH {_NAMES}, {_TWO}, {_SETS},
far AS (SELECT *, greatest(length(a), length(b)) >= 1.5 * least(length(a), length(b)) AS far, CASE WHEN greatest(length(a), length(b)) <= 8 * least(length(a), length(b)) THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS part FROM two),
forms AS (SELECT a, b, 'as' AS form, a AS x, b AS y FROM far WHERE far UNION ALL SELECT a, b, 'sorted', {sort_tokens('a')}, {sort_tokens('b')} FROM far WHERE far
  UNION ALL SELECT a, b, 'sets', array_to_string(list_sort(list_distinct(string_split(a, ' '))), ' '), array_to_string(list_sort(list_distinct(string_split(b, ' '))), ' ') FROM far WHERE far),
sides AS (SELECT a, b, form, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS t FROM forms UNION ALL SELECT a, b, form, y, x FROM forms WHERE length(x) = length(y)),
cuts AS (SELECT DISTINCT a, b, form, s, unnest(list_concat(list_transform(range(1, length(t) - length(s) + 2), lambda i: substr(t, i::BIGINT, length(s))),
  list_transform(range(1, length(s)), lambda k: substr(t, 1, k::BIGINT)), list_transform(range(1, length(s)), lambda k: substr(t, (length(t) - k + 1)::BIGINT, k::BIGINT)))) AS w FROM sides),
best AS (SELECT a, b, form, max(r) AS r FROM (SELECT a, b, form, {ratio('s', 'w')} AS r FROM cuts) GROUP BY a, b, form),
wide AS (SELECT a, b, max(r) FILTER (form = 'as') AS p, max(r) FILTER (form <> 'as') AS pt FROM best GROUP BY a, b),
near AS (SELECT a, b, greatest({ratio('sa', 'sb')}, {_SET_SCORE.replace("THEN 100 ELSE", "THEN 100.0::DOUBLE ELSE")}) AS tokens FROM (SELECT far.a, far.b, {sort_tokens('far.a')} AS sa, {sort_tokens('far.b')} AS sb, c, oa, ob FROM far JOIN sets USING (a, b) WHERE NOT far.far)),
weighted AS (SELECT far.a, far.b, {ratio('far.a', 'far.b')} AS r, far.far, part, tokens, p, CASE WHEN sets.c <> '' THEN 100.0::DOUBLE ELSE pt END AS pt FROM far JOIN sets USING (a, b) LEFT JOIN near USING (a, b) LEFT JOIN wide USING (a, b))
SELECT a AS name_a, b AS name_b, {as_score('s')} AS similarity_score FROM (SELECT a, b, CASE WHEN far THEN greatest(r, part * p, 0.95::DOUBLE * part * pt) ELSE greatest(r, 0.95::DOUBLE * tokens) END AS s FROM weighted) WHERE s >= {THRESHOLDS["WRatio"]}"""
_CAPPED = f"""WITH RECURSIVE {_NAMES}, {_TWO}, raw AS (SELECT a, b, {ratio('a', 'b')} AS s FROM two),
pr AS (SELECT a, b, {as_score('s')} AS s, row_number() OVER (ORDER BY {as_score('s')} DESC, a, b) AS n FROM raw WHERE s >= {THRESHOLDS["ratio"]}),
scan(n, used, take) AS (SELECT 0::BIGINT, MAP {{}}::MAP(VARCHAR, INTEGER), false UNION ALL
  SELECT n, CASE WHEN ok THEN map_concat(used, MAP {{a: ua + 1, b: ub + 1}}) ELSE used END, ok FROM (SELECT *, ua < 2 AND ub < 2 AS ok FROM
    (SELECT pr.n, a, b, used, coalesce(used[a], 0)::INTEGER AS ua, coalesce(used[b], 0)::INTEGER AS ub FROM scan JOIN pr ON pr.n = scan.n + 1)))
SELECT a AS name_a, b AS name_b, s AS similarity_score FROM pr JOIN scan USING (n) WHERE take"""
_RULES = """w AS (SELECT id1, id2, (similarity_score < 90)::INT + (x.p_brand <> y.p_brand)::INT + (ty.s < 40)::INT + (CASE WHEN greatest(x.p_retailprice, y.p_retailprice) > 0 THEN abs(x.p_retailprice - y.p_retailprice) / greatest(x.p_retailprice, y.p_retailprice) * 100 > 30 ELSE false END)::INT + (abs(x.p_size - y.p_size) > 25)::INT AS reasons
        FROM mp JOIN part x ON x.p_partkey = id1 JOIN part y ON y.p_partkey = id2 JOIN ty ON ty.a = x.p_type AND ty.b = y.p_type)"""
_CHECKS = """CASE WHEN doc_id IS NULL THEN 'id is empty' WHEN text IS NULL OR regexp_replace(text, '\\s', '', 'g') = '' THEN 'name is empty' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 10000 THEN 'name is too long' END"""


def _best_of(where: str, order: str) -> str:
    return f"""WITH {_CROSS}, rk AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY {order}) AS rn FROM cm WHERE {where}),
ag AS (SELECT id1, max(id2) FILTER (rn = 1) AS main_cid, max(similarity_score) FILTER (rn = 1) AS main_similarity_score, count(*) AS total_matches,
  string_agg(id2::VARCHAR, ', ' ORDER BY similarity_score DESC, id2) AS all_match_ids, string_agg(id2::VARCHAR, ', ' ORDER BY similarity_score DESC, id2) FILTER (rn <> 1) AS other_candidates FROM rk GROUP BY id1)
SELECT p.p_partkey AS id, main_cid, main_similarity_score, other_candidates, coalesce(total_matches, 0) AS total_matches, all_match_ids FROM part p LEFT JOIN ag ON ag.id1 = p.p_partkey"""


_TYPES = f"ty AS (SELECT a, b, {as_score(ratio('a', 'b'))} AS s FROM (SELECT DISTINCT p_type AS a FROM part), (SELECT DISTINCT p_type AS b FROM part))"
_MATCH_FACTS = f"""WITH {_NAMES}, {_SORTED_PAIRS}, {_EXPANDED}, {_CATALOG},
sn AS (SELECT * FROM {_cross('p_name', 'alt_name')} WHERE s >= 85), st AS (SELECT * FROM {_cross('p_type', 'alt_name')} WHERE s >= 85), ca AS (SELECT cid, {_NORM.format('alt_name')} AS r FROM cat),
by_name AS (SELECT p_partkey, cid FROM part JOIN sn ON sn.l = {_TOKEN} JOIN ca USING (r) WHERE p_partkey % 10 <> 0),
by_any AS (FROM by_name UNION SELECT p_partkey, cid FROM part JOIN st ON st.l = {_NORM.format('p_type')} JOIN ca USING (r)),
c AS (SELECT (SELECT count(*) FROM part) AS n, (SELECT count(*) FROM part WHERE p_partkey % 10 <> 0 AND trim(p_name) <> '') AS named, (SELECT count(*) FROM cat) AS other)
SELECT t.*, 85::DOUBLE AS threshold, 'token_sort_ratio' AS scorer, true AS lowercase FROM (
  SELECT 'self' AS matching_type, named AS entities, NULL::BIGINT AS entities2, (SELECT count(*) FROM mp WHERE id1 % 10 <> 0 AND id2 % 10 <> 0) AS found, ceil(named / 64)::BIGINT AS batches, NULL::BIGINT AS combinations FROM c
  UNION ALL SELECT 'cross_dataset', named, other, (SELECT count(*) FROM by_name), NULL, NULL FROM c
  UNION ALL SELECT 'cross_dataset_multi_column', n, other, (SELECT count(*) FROM by_any), NULL, 4 FROM c) t"""
_SAID = "printf('%.1f', similarity_score)"
_JUDGED = f"jd AS (SELECT id1, id2, {_SAID}::DOUBLE >= 90 AS keep, 'at ' || {_SAID} AS validation_reason FROM mp)"


ORACLES: dict[str, str] = {
    "normalize_names": f"""SELECT id, name, plain AS normalized, {sort_tokens('plain')} AS sorted_tokens FROM (SELECT id, name, {_SPACE.format(f"regexp_replace({_NORM.format('name')}, '[^\\w\\s]', '', 'g')")} AS plain
      FROM (SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT c_custkey, c_name FROM customer))""",
    "ratio_pairs": _pairs(ratio("a", "b"), THRESHOLDS["ratio"]),
    "token_sort_ratio_pairs": _pairs(ratio("sa", "sb"), THRESHOLDS["token_sort_ratio"], "srt", f", srt AS (SELECT a, b, {sort_tokens('a')} AS sa, {sort_tokens('b')} AS sb FROM two)"),
    "token_set_ratio_pairs": _pairs(_SET_SCORE, THRESHOLDS["token_set_ratio"], "sets", f", {_SETS}"),
    "partial_ratio_pairs": _pairs("r", THRESHOLDS["partial_ratio"], "best", _WINDOWS),
    "jaro_pairs": _pairs("jaro_similarity(a, b)", THRESHOLDS["jaro"]),
    "jaro_winkler_pairs": _pairs("jaro_winkler_similarity(a, b)", THRESHOLDS["jaro_winkler"]),
    "match_pairs": f"WITH {_NAMES}, {_SORTED_PAIRS}, {_EXPANDED} SELECT id1, id2, name1, name2, similarity_score FROM mp",
    "symmetric_pairs": f"WITH {_CATALOG}, {_CATNAMES} SELECT a.cid AS id_a, b.cid AS id_b, {as_score('s')} AS similarity_score FROM (SELECT a, b, {ratio('a.n', 'b.n')} AS s FROM cn a JOIN cn b ON a.cid <= b.cid) WHERE s >= 60",
    "duplicate_groups": f"WITH RECURSIVE {_components(80)} SELECT * FROM g",
    "dedup_statistics": f"WITH RECURSIVE {_components(80)}, {_STATS} SELECT *, total_entities - entities_with_duplicates AS singleton_entities FROM st",
    "group_size_analysis": f"WITH RECURSIVE {_components(80)}, {_MEASURES} SELECT 'min' AS measure, min(size) AS value FROM sz UNION ALL SELECT 'max', max(size) FROM sz UNION ALL SELECT 'mean', avg(size) FROM sz UNION ALL SELECT 'median', median(size) FROM sz UNION ALL SELECT 'size_' || n, (SELECT count(*) FROM sz WHERE size = n)::DOUBLE FROM range(2, 11) t(n)",
    **{f"survivors_{k}": f"WITH RECURSIVE {_components(80)}, keep AS (SELECT entity_id FROM g WHERE group_id = 0 UNION SELECT {f}(entity_id) FROM g WHERE group_id > 0 GROUP BY group_id) SELECT p_partkey AS id, p_name AS name, p_brand FROM part WHERE p_partkey IN (SELECT entity_id FROM keep)" for k, f in (("first", "min"), ("last", "max"))},
    "survivors_highest_score": f"""WITH RECURSIVE {_CATALOG}, {_CATNAMES}, pr AS (SELECT a, b, {as_score('s')} AS s FROM (SELECT a.cid AS a, b.cid AS b, {ratio('a.n', 'b.n')} AS s FROM cn a JOIN cn b ON a.cid < b.cid) WHERE s >= 70),
      ed AS (SELECT a, b, s FROM pr UNION ALL SELECT b, a, s FROM pr), reach(n, r) AS (SELECT cid, cid FROM cn UNION SELECT ed.b, reach.r FROM reach JOIN ed ON ed.a = reach.n),
      root AS (SELECT n, min(r) AS r FROM reach GROUP BY n), mean AS (SELECT a, avg(s) AS m FROM ed GROUP BY a),
      best AS (SELECT n, row_number() OVER (PARTITION BY r ORDER BY round(m, 9) DESC, n) AS rn FROM root LEFT JOIN mean ON mean.a = n)
      SELECT cid AS id, alt_name AS name FROM cn JOIN best ON best.n = cn.cid WHERE rn = 1""",
    "removal_summary": f"WITH RECURSIVE {_components(80)}, {_STATS}, k AS (SELECT count(*) FILTER (group_id = 0) + count(DISTINCT group_id) FILTER (group_id > 0) AS n FROM g) SELECT total_entities AS original_count, duplicate_groups AS duplicate_groups_found, entities_with_duplicates, n AS cleaned_count, total_entities - n AS duplicates_removed, (total_entities - n) * 100.0::DOUBLE / total_entities AS removal_rate FROM st, k",
    "rule_validation": f"""WITH {_NAMES}, {_SORTED_PAIRS}, {_EXPANDED}, ty AS (SELECT a, b, {as_score(ratio('a', 'b'))} AS s FROM (SELECT DISTINCT p_type AS a FROM part), (SELECT DISTINCT p_type AS b FROM part)),
      w AS (SELECT id1, id2, (similarity_score < 90)::INT + (x.p_brand <> y.p_brand)::INT + (ty.s < 40)::INT + (CASE WHEN greatest(x.p_retailprice, y.p_retailprice) > 0 THEN abs(x.p_retailprice - y.p_retailprice) / greatest(x.p_retailprice, y.p_retailprice) * 100 > 30 ELSE false END)::INT + (abs(x.p_size - y.p_size) > 25)::INT AS reasons
        FROM mp JOIN part x ON x.p_partkey = id1 JOIN part y ON y.p_partkey = id2 JOIN ty ON ty.a = x.p_type AND ty.b = y.p_type)
      SELECT id1, id2, reasons = 0 AS keep, reasons FROM w""",
    "cross_match_single": f"WITH {_CROSS} SELECT id1, id2, name1, name2, similarity_score FROM cm",
    "cross_match_multi": f"""WITH {_CATALOG}, sc AS ({' UNION ALL '.join(f"SELECT {i} AS i, {j} AS j, l, r, s FROM {_cross(a, b)} WHERE s >= 75" for i, a in enumerate(("p_name", "p_type")) for j, b in enumerate(("alt_name", "kind")))}),
      pl AS (SELECT p_partkey AS id1, 0 AS i, {_NORM.format('p_name')} AS l FROM part UNION ALL SELECT p_partkey, 1, {_NORM.format('p_type')} FROM part),
      cl AS (SELECT cid AS id2, 0 AS j, {_NORM.format('alt_name')} AS r FROM cat UNION ALL SELECT cid, 1, {_NORM.format('kind')} FROM cat)
      SELECT id1, id2, {as_score('s')} AS similarity_score, ['name', 'p_type'][i + 1] AS matched_column1, ['alt_name', 'kind'][j + 1] AS matched_column2
      FROM pl JOIN sc USING (i, l) JOIN cl USING (j, r) QUALIFY row_number() OVER (PARTITION BY id1, id2 ORDER BY CAST(s AS FLOAT) DESC, i, j) = 1""",
    "cross_statistics": f"""WITH {_CROSS}, a AS (SELECT count(*) AS cross_matches, count(DISTINCT id1) AS m1, count(DISTINCT id2) AS m2, coalesce(sum(similarity_score::DECIMAL(38, 18))::DOUBLE / count(*), 0) AS av FROM cm)
      SELECT (SELECT count(*) FROM part) AS df1_total, (SELECT count(*) FROM cat) AS df2_total, cross_matches, m1 AS df1_matched_entities, m2 AS df2_matched_entities, av AS avg_similarity,
      (SELECT count(*) FROM part) - m1 AS df1_unmatched, (SELECT count(*) FROM cat) - m2 AS df2_unmatched FROM a""",
    "merge_datasets": f"WITH {_CROSS} SELECT id1 AS df1_id, id2 AS df2_id, similarity_score, p_name AS name, p_brand, alt_name, cat.brand FROM cm JOIN part ON p_partkey = id1 JOIN cat ON cid = id2",
    "consolidate_strict": _consolidate(f"{_RANK},"),
    "consolidate_threshold": _consolidate(f"near DESC, {_RANK},"),
    "consolidate_best": _consolidate(""),
    "quality_score": "SELECT CAST(0.3 AS DOUBLE) * ((count(c_custkey) + count(c_name)) / (2 * count(*))) + CAST(0.3 AS DOUBLE) * (count(DISTINCT c_custkey) / count(*)) + CAST(0.4 AS DOUBLE) * (count(*) FILTER (regexp_replace(c_name, '\\s', '', 'g') <> '' AND length(c_name) <= 1000) / count(c_name)) AS data_quality_score FROM customer",
    "input_validation": "SELECT CASE WHEN doc_id IS NULL THEN 'id is empty' WHEN text IS NULL OR regexp_replace(text, '\\s', '', 'g') = '' THEN 'name is empty' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 10000 THEN 'name is too long' ELSE 'valid' END AS outcome, count(*) AS n FROM documents GROUP BY 1",
    "sanitized_documents": _sanitized(),
    "excel_clean": "SELECT doc_id, " + ", ".join(_SPACE.format(rf"regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g')") + f" AS {c}" for c in ("text", "source")) + " FROM documents",
    "secret_scan": _secrets(),
    "burst_windows": "SELECT time_bucket(INTERVAL 60 SECONDS, ts) AS window_start, user_id, count(*) AS requests FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "wratio_pairs": _WEIGHTED,
    "degree_capped_pairs": _CAPPED,
    "csv_round_trip": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "json_round_trip": "SELECT doc_id, text, source FROM documents",
    "saved_groups": f"WITH RECURSIVE {_components(80)} SELECT * FROM g",
    "group_members": f"WITH RECURSIVE {_components(80)} SELECT entity_id, entity_name FROM g WHERE entity_id = 1 OR group_id > 0 AND group_id = (SELECT group_id FROM g WHERE entity_id = 1)",
    "entities_kept": f"WITH RECURSIVE {_components(80)} SELECT entity_id FROM g WHERE group_id = 0 UNION ALL SELECT max(entity_id) FROM g WHERE group_id > 0 GROUP BY group_id",
    "saved_pairs": f"WITH {_NAMES}, {_SORTED_PAIRS}, {_expanded(80)} SELECT id1, id2, name1, name2, similarity_score, count(*) OVER () AS duplicate_pairs FROM mp",
    "saved_cross_matches": f"WITH {_CROSS} SELECT id1 AS df1_id, id2 AS df2_id, name1 AS df1_name, name2 AS df2_name, similarity_score, 'No validation' AS validation_reason FROM cm",
    "matches_of_part": f"WITH {_CROSS} SELECT id2 AS df2_id, name2 AS df2_name, similarity_score FROM cm WHERE id1 = 1",
    "matches_of_catalog_entry": f"WITH {_CROSS} SELECT id1 AS df1_id, name1 AS df1_name, similarity_score FROM cm WHERE id2 = 1",
    "merge_outer": f"WITH {_CROSS}, k AS (SELECT id1, id2, similarity_score FROM cm WHERE similarity_score >= 95) SELECT id1 AS df1_id, id2 AS df2_id, similarity_score, p_partkey AS id, cat.cid, cat.alt_name FROM k FULL JOIN part ON p_partkey = id1 FULL JOIN cat ON cat.cid = id2",
    "enriched_matches": f"WITH {_CROSS} SELECT id1 AS df1_id, id2 AS df2_id, similarity_score, p_brand, p_size, cat.brand, cat.kind AS priority FROM cm JOIN part ON p_partkey = id1 JOIN cat ON cat.cid = id2",
    "consolidate_filtered": _best_of("similarity_score >= 90", "similarity_score DESC, id2"),
    "consolidate_selected": _best_of("true", "id2"),
    "scaled_jaro_pairs": f"WITH {_NAMES}, {_TWO} SELECT a AS name_a, b AS name_b, {as_score('s')} * 100::DOUBLE AS similarity_score FROM (SELECT a, b, jaro_similarity(a, b) AS s FROM two) WHERE s >= 0.75 AND {as_score('s')} * 100::DOUBLE >= 75",
    "match_pairs_tied": f"""WITH {_NAMES}, {_SORTED_PAIRS}, rows AS (SELECT row_number() OVER () AS k, p_size::BIGINT AS id, p_brand, p_name AS raw, {_TOKEN} AS n FROM part)
      SELECT x.id AS id1, y.id AS id2, x.raw AS name1, y.raw AS name2, {as_score("CASE WHEN x.n = y.n THEN 100.0 ELSE np.s END")} AS similarity_score
      FROM rows x JOIN rows y ON (x.p_brand, x.id, x.raw, x.k) < (y.p_brand, y.id, y.raw, y.k) LEFT JOIN np ON np.a = x.n AND np.b = y.n WHERE x.n = y.n OR np.s >= 85""",
    "match_counts": f"WITH {_NAMES}, {_SORTED_PAIRS}, {_EXPANDED} SELECT (SELECT count(*) FROM part) AS total_entities, count(*) AS matches_found FROM mp",
    "validation_counts": f"""WITH {_NAMES}, {_SORTED_PAIRS}, {_EXPANDED}, ty AS (SELECT a, b, {as_score(ratio('a', 'b'))} AS s FROM (SELECT DISTINCT p_type AS a FROM part), (SELECT DISTINCT p_type AS b FROM part)), {_RULES}
      SELECT count(*) AS pairs_count, count(*) FILTER (reasons = 0) AS validated_count, count(*) FILTER (reasons > 0) AS removed_count, count(*) FILTER (reasons = 0)::DOUBLE / count(*)::DOUBLE AS validation_rate FROM w""",
    "structure_report": "SELECT NULL::VARCHAR AS column, count(*) AS rows, 0::BIGINT AS nulls FROM documents UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', count(*), count(*) - count({c}) FROM documents" for c in ("doc_id", "text", "lang")),
    "checked_entities": f"SELECT doc_id AS id, {_sanitize("regexp_replace(text, '^" + chr(92) + "s+|" + chr(92) + "s+$', '', 'g')")} AS name FROM documents WHERE {_CHECKS} IS NULL",
    "rejected_entities": f"SELECT doc_id AS id, {_CHECKS} AS reject_reason FROM documents WHERE {_CHECKS} IS NOT NULL",
    "checked_sides": f"SELECT 'df1' AS side, count(*) AS n FROM documents WHERE {_CHECKS} IS NULL UNION ALL SELECT 'df2', count(*) FROM supplier WHERE s_suppkey IS NOT NULL AND trim(s_name) <> ''",
    "sanitized_columns": f"SELECT event_id, {_sanitize('event_type')} AS event_type, {_sanitize('props')} AS props FROM events",
    "reply_json": "SELECT event_id, props AS json FROM events",
    "match_metadata": _MATCH_FACTS,
    "judged_pairs": f"WITH {_NAMES}, {_SORTED_PAIRS}, {_EXPANDED}, {_JUDGED} SELECT * FROM jd",
    "judged_consolidation": f"""WITH {_CROSS}, rk AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY id2) AS rn FROM cm),
      ag AS (SELECT id1, (max(id2) FILTER (rn = 1))::VARCHAR AS main_cid, max(similarity_score) FILTER (rn = 1) AS main_similarity_score, count(*) AS total_matches, 'of ' || count(*) AS llm_reasoning,
        string_agg(id2::VARCHAR, ', ' ORDER BY similarity_score DESC, id2::VARCHAR) FILTER (rn <> 1) AS other_candidates FROM rk GROUP BY id1)
      SELECT p_partkey AS id, main_cid, main_similarity_score, coalesce(total_matches, 0) AS total_matches, llm_reasoning, other_candidates FROM part LEFT JOIN ag ON id1 = p_partkey""",
    "validation_metadata": f"""WITH {_NAMES}, {_SORTED_PAIRS}, {_EXPANDED}, {_TYPES}, {_RULES}, {_JUDGED}
      SELECT *, validated_count::DOUBLE / (validated_count + removed_count)::DOUBLE AS validation_rate FROM (
        SELECT 'rules' AS kind, count(*) FILTER (reasons = 0) AS validated_count, count(*) FILTER (reasons > 0) AS removed_count, 90::DOUBLE AS min_score, 3::BIGINT AS metadata_rules_count, 1::BIGINT AS custom_rules_count,
          NULL::VARCHAR AS model, NULL::BOOLEAN AS custom_rules_applied, NULL::BIGINT AS batches_from_checkpoint FROM w
        UNION ALL SELECT 'judge', count(*) FILTER (keep), count(*) FILTER (NOT keep), NULL, NULL, NULL, 'by-score', true, 0 FROM jd)""",
    "input_metadata": f"""SELECT 'self' AS kind, count(*) AS original_rows, count(*) FILTER ({_CHECKS} IS NULL) AS final_rows, NULL::BIGINT AS original_rows2, NULL::BIGINT AS final_rows2, 'id, name, lang' AS columns_validated FROM documents
      UNION ALL SELECT 'cross', count(*), count(*) FILTER ({_CHECKS} IS NULL), (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier WHERE s_suppkey IS NOT NULL AND trim(s_name) <> ''), NULL FROM documents""",
}
