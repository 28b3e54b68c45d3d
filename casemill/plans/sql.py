"""Standard SQL with the same results as the registered queries, over the same tables."""

from __future__ import annotations

from casemill.schema import ICD10_BLOCKS

_CHAPTERS = ", ".join(f"({i}, '{b}', '{b[:3]}', '{b[4:]}')" for i, b in enumerate(ICD10_BLOCKS))

CASES = f"""
chapters(pos, block, lo, hi) AS (VALUES {_CHAPTERS}),
people AS (
  SELECT o_orderkey AS case_id,
         CASE WHEN o_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex,
         CASE WHEN o_custkey % 10 = 0 THEN 'month' ELSE 'year' END AS unit,
         1 + o_custkey % 90 AS age
  FROM orders),
aged AS (
  SELECT case_id, sex, CASE WHEN unit = 'year' THEN age * 12 + 6 ELSE age END AS age_in_months
  FROM people),
lines AS (
  SELECT l_orderkey AS case_id, l_linenumber,
         's_' || CAST(p_size AS VARCHAR) AS evidence_id,
         CASE l_returnflag WHEN 'R' THEN 'present' WHEN 'A' THEN 'absent' ELSE 'unknown' END AS state,
         chr(CAST(65 + l_partkey % 26 AS INTEGER)) || lpad(CAST(p_size * 2 - 1 AS VARCHAR), 2, '0')
           || CASE WHEN l_suppkey % 3 = 0 THEN '.' || CAST(l_suppkey % 10 AS VARCHAR) ELSE '' END AS code
  FROM lineitem JOIN part ON l_partkey = p_partkey),
codes AS (SELECT DISTINCT case_id, code FROM lines WHERE l_linenumber <= 2),
matched AS (
  SELECT c.code, min_by(h.block, h.pos) AS block
  FROM (SELECT DISTINCT code FROM codes) c LEFT JOIN chapters h ON c.code >= h.lo AND c.code <= h.hi
  GROUP BY c.code),
case_block AS (SELECT DISTINCT case_id, block FROM codes JOIN matched USING (code)),
labelled AS (
  SELECT case_id,
         '[' || string_agg(coalesce('''' || block || '''', 'None'), ', ' ORDER BY block NULLS LAST) || ']'
           AS expected_condition_icd10_blocks
  FROM case_block GROUP BY case_id),
targets AS (
  SELECT case_id, coalesce(expected_condition_icd10_blocks, '[]') AS expected_condition_icd10_blocks
  FROM people LEFT JOIN labelled USING (case_id)),
ternary AS (
  SELECT case_id, evidence_id, min(CASE state WHEN 'absent' THEN -1 ELSE 1 END) AS value
  FROM lines WHERE state <> 'unknown' GROUP BY case_id, evidence_id),
counts AS (
  SELECT case_id,
         count(*) FILTER (WHERE state = 'present') AS present_evidence_count,
         count(*) FILTER (WHERE state = 'absent') AS absent_evidence_count
  FROM lines GROUP BY case_id),
case_counts AS (
  SELECT case_id, coalesce(present_evidence_count, 0) AS present_evidence_count,
         coalesce(absent_evidence_count, 0) AS absent_evidence_count
  FROM people LEFT JOIN counts USING (case_id)),
lists AS (
  SELECT case_id,
         string_agg(DISTINCT '''' || evidence_id || '''', ', ' ORDER BY '''' || evidence_id || '''')
           FILTER (WHERE state = 'present') AS present,
         string_agg(DISTINCT '''' || evidence_id || '''', ', ' ORDER BY '''' || evidence_id || '''')
           FILTER (WHERE state = 'absent') AS absent
  FROM lines GROUP BY case_id)"""

# Fold rule on a table labelled(case_id, label).
_FOLDS = """
classes AS (
  SELECT label, count(*) AS n, min(case_id) AS first_id FROM src GROUP BY label),
placed AS (
  SELECT label, n, coalesce(sum(n) OVER (ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS s FROM classes),
quota AS (
  SELECT label, i, floor((s + n + 4 - i) / 5.0) - floor((s + 4 - i) / 5.0) AS q
  FROM placed, (VALUES (0), (1), (2), (3), (4)) f(i)),
filled AS (SELECT label, i, sum(q) OVER (PARTITION BY label ORDER BY i) AS upto FROM quota),
ranked AS (SELECT case_id, label, row_number() OVER (PARTITION BY label ORDER BY case_id) - 1 AS r FROM src),
folded AS (
  SELECT r.case_id, r.label, CAST(min(f.i) AS INTEGER) AS fold
  FROM ranked r JOIN filled f ON f.label = r.label AND f.upto > r.r GROUP BY r.case_id, r.label)"""

CASE_FOLDS = f"""{CASES},
src AS (SELECT case_id, expected_condition_icd10_blocks AS label FROM labelled),{_FOLDS}"""

VECTOR_FOLDS = f"""
src AS (SELECT vec_id AS case_id, label FROM embeddings),{_FOLDS}"""


# Distances of all pairs of vectors; scores of the majority and of k neighbours in every fold.
_DISTANCES = f"""{VECTOR_FOLDS},
dist AS (
  SELECT a.case_id AS q, a.label AS ql, a.fold AS qf, b.case_id AS t, b.label AS tl, b.fold AS tf,
    list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS d
  FROM folded a JOIN embeddings x ON a.case_id = x.vec_id, folded b JOIN embeddings y ON b.case_id = y.vec_id)"""

_SEARCH = f"""{_DISTANCES},
ranked_pairs AS (
  SELECT i AS fold, q, ql, qf, tl, row_number() OVER (PARTITION BY i, q ORDER BY d, t) AS r
  FROM dist, (VALUES (0), (1), (2), (3), (4)) f(i) WHERE tf <> i),
votes AS (
  SELECT s, k, fold, q, ql, qf, tl, count(*) AS n
  FROM ranked_pairs, (VALUES (0, 2), (1, 5), (2, 10), (3, 20), (4, 50)) g(s, k) WHERE r <= k GROUP BY s, k, fold, q, ql, qf, tl),
chosen AS (SELECT *, row_number() OVER (PARTITION BY k, fold, q ORDER BY n DESC, tl) AS r FROM votes),
knn_scores AS (
  SELECT s, k, fold, avg((ql = tl)::INTEGER) FILTER (WHERE qf <> fold) AS train,
    avg((ql = tl)::INTEGER) FILTER (WHERE qf = fold) AS test
  FROM chosen WHERE r = 1 GROUP BY s, k, fold),
grid AS (
  SELECT CAST(s AS BIGINT) AS seq, k, '{{"n_neighbors":"' || k || '"}}' AS params,
    round(avg(train), 6) AS mean_train_score, round(avg(test), 6) AS mean_test_score
  FROM knn_scores GROUP BY s, k),
best AS (SELECT * FROM grid ORDER BY mean_test_score DESC, seq LIMIT 1),
per_label AS (
  SELECT i AS fold, label, count(*) FILTER (WHERE fold <> i) AS train, count(*) FILTER (WHERE fold = i) AS test
  FROM folded, (VALUES (0), (1), (2), (3), (4)) f(i) GROUP BY i, label),
majority AS (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train DESC, label) AS r,
    sum(train) OVER (PARTITION BY fold) AS all_train, sum(test) OVER (PARTITION BY fold) AS all_test
  FROM per_label),
dummy_scores AS (SELECT fold, train / all_train AS train, test / all_test AS test FROM majority WHERE r = 1)"""

_RESULT = (
    "'{model}' AS model_class, '{model}()' AS model_str, CAST(NULL AS VARCHAR) AS dim_reduction_algorithm, "
    "CAST(NULL AS INTEGER) AS n_dimensions, FALSE AS count_evidence, TRUE AS include_absent_evidence"
)
_MEANS = "round(avg(train), 6) AS mean_train_score, round(avg(test), 6) AS mean_test_score"


def _fd(source: str, key: str, column: str) -> str:
    return (
        f"SELECT '{source}' AS source, '{key}' AS key, '{column}' AS \"column\", "
        f"coalesce(max(d), 0) <= 1 AS derivable FROM "
        f"(SELECT {key}, count(DISTINCT {column}) AS d FROM {source} WHERE {key} IS NOT NULL GROUP BY {key})"
    )


_FD_CHECKS = [
    ("nation", "n_nationkey", ["n_name", "n_regionkey"]),
    ("nation", "n_regionkey", ["n_name"]),
    ("customer", "c_nationkey", ["c_mktsegment", "c_acctbal"]),
    ("customer", "c_custkey", ["c_name", "c_nationkey"]),
    ("part", "p_partkey", ["p_name", "p_brand", "p_size"]),
    ("part", "p_name", ["p_brand", "p_type"]),
    ("events", "user_id", ["event_type", "value"]),
    ("events", "event_id", ["ts", "props"]),
]

_PROFILED = {
    "customer": ["c_custkey*", "c_name", "c_nationkey*", "c_acctbal*", "c_mktsegment"],
    "part": ["p_partkey*", "p_name", "p_brand", "p_type", "p_size*", "p_retailprice*"],
    "nation": ["n_nationkey*", "n_name", "n_regionkey*"],
    "region": ["r_regionkey*", "r_name"],
    "supplier": ["s_suppkey*", "s_name", "s_nationkey*", "s_acctbal*"],
    "events": ["event_id*", "ts", "user_id*", "event_type", "value*", "props"],
}

_LINE_NUMBERS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()


def _profile(source: str, column: str) -> str:
    numeric = column.endswith("*")
    c = column.rstrip("*")
    counts = f"(SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})"
    if numeric:
        stats = (
            f"round(min(CAST({c} AS DOUBLE)), 6) AS min, round(max(CAST({c} AS DOUBLE)), 6) AS max, "
            f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std"
        )
        top = "CAST(NULL AS VARCHAR)"
    else:
        stats = "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std"
        top = f"(SELECT CAST(v AS VARCHAR) FROM {counts} ORDER BY n DESC, v LIMIT 1)"
    return (
        f"SELECT '{source}' AS source, '{c}' AS \"column\", count(*) AS n_rows, "
        f"count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct, "
        f"(SELECT max(n) FROM {counts}) AS top_n, {top} AS top_value, "
        f"round(count(DISTINCT {c}) / count(*), 6) AS distinct_share, {stats} FROM {source}"
    )


_RENDERED = (
    "'[' || coalesce(present, '') || ']' AS evidence_present, "
    "'[' || coalesce(absent, '') || ']' AS evidence_absent"
)
_EVENT_SCORES = "SELECT event_id AS seq, user_id, event_type, value FROM events"

_MINMAX = ", ".join(
    f"round(2.0 * ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) - 1, 6) AS {c}_scaled"
    for c in ("present_evidence_count", "absent_evidence_count")
)

SQL = {
    "age_in_months": f"WITH {CASES} SELECT case_id, age_in_months FROM aged",
    "case_features": f"""WITH {CASES}
SELECT case_id, sex, age_in_months, {_RENDERED}, present_evidence_count, absent_evidence_count
FROM aged LEFT JOIN lists USING (case_id) JOIN case_counts USING (case_id)""",
    "nested_record_scan": f"""WITH {CASES}
SELECT case_id, sex, age_in_months, {_RENDERED}, expected_condition_icd10_blocks
FROM aged LEFT JOIN lists USING (case_id) JOIN targets USING (case_id)""",
    "code_range_lookup": f"WITH {CASES} SELECT case_id, code, block FROM codes JOIN matched USING (code)",
    "wide_range_lookup": """WITH bands AS (
  SELECT p_partkey AS pos, substr(p_name, 1, 2) || lpad(CAST(p_size AS VARCHAR), 2, '0') AS lo,
         substr(p_name, 1, 2) || lpad(CAST(p_size + 3 AS VARCHAR), 2, '0') AS hi, p_brand AS block
  FROM part),
keys AS (
  SELECT ['la', 'ho', 'bl', 're', 'gr', 'sm'][CAST(l_partkey % 6 + 1 AS INTEGER)]
           || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 2, '0') AS code FROM lineitem),
grouped AS (SELECT code, count(*) AS n FROM keys GROUP BY code)
SELECT g.code, min_by(b.block, b.pos) AS block, any_value(g.n) AS n
FROM grouped g LEFT JOIN bands b ON g.code >= b.lo AND g.code <= b.hi GROUP BY g.code""",
    "case_target_label": f"WITH {CASES} SELECT case_id, expected_condition_icd10_blocks FROM targets",
    "target_counts": f"""WITH {CASES}
SELECT expected_condition_icd10_blocks, count(*) AS n FROM targets GROUP BY 1""",
    "rare_targets": f"""WITH {CASES}
SELECT count(*) AS n_rare FROM (
  SELECT count(*) AS n FROM targets GROUP BY expected_condition_icd10_blocks HAVING count(*) < 5)""",
    "block_counts": f"""WITH {CASES}
SELECT coalesce(block, 'None') AS block, count(*) AS n FROM case_block GROUP BY 1""",
    "evidence_vocabulary": f"""WITH {CASES}
SELECT evidence_id, row_number() OVER (ORDER BY evidence_id) - 1 AS idx
FROM (SELECT DISTINCT evidence_id FROM lines WHERE state <> 'unknown')""",
    "evidence_vocabulary_present_only": f"""WITH {CASES}
SELECT evidence_id, row_number() OVER (ORDER BY evidence_id) - 1 AS idx
FROM (SELECT DISTINCT evidence_id FROM lines WHERE state = 'present')""",
    "evidence_ternary": f"WITH {CASES} SELECT case_id, evidence_id, value FROM ternary",
    "evidence_ternary_present_only": f"""WITH {CASES}
SELECT DISTINCT case_id, evidence_id, 1 AS value FROM lines WHERE state = 'present'""",
    "evidence_ternary_fitted": f"""WITH {CASES}
SELECT case_id, evidence_id, value FROM ternary WHERE evidence_id IN (
  SELECT evidence_id FROM lines JOIN aged USING (case_id) WHERE state = 'present' AND age_in_months <= 1)""",
    "evidence_ternary_lists": f"WITH {CASES} SELECT case_id, evidence_id, value FROM ternary",
    "evidence_counts": f"WITH {CASES} SELECT * FROM case_counts",
    "fd_check": " UNION ALL ".join(_fd(t, k, c) for t, k, cs in _FD_CHECKS for c in cs),
    "profile_columns": " UNION ALL ".join(_profile(t, c) for t, cs in _PROFILED.items() for c in cs),
    "profile_encoded": f"""WITH {CASES}
SELECT evidence_id, count(*) FILTER (WHERE value = 1) AS n_present, count(*) FILTER (WHERE value = -1) AS n_absent,
       (SELECT count(*) FROM people) - count(*) AS n_zero,
       round(sum(value) / (SELECT count(*) FROM people), 6) AS mean
FROM ternary GROUP BY evidence_id""",
    "duplicate_rows": """SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicate_rows, count(*) FILTER (WHERE n > 1) AS n_repeated
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""",
    "correlations": " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS corr FROM lineitem"
        for i, a in enumerate(_LINE_NUMBERS)
        for b in _LINE_NUMBERS[i + 1 :]
    ),
    "histogram": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column",
  CAST(least(floor(({c} - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin, count(*) AS n
FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1, 2"""
        for c in _LINE_NUMBERS
    ),
    "stratified_folds": f"""WITH {CASE_FOLDS}
SELECT case_id, label AS expected_condition_icd10_blocks, fold FROM folded""",
    "holdout_split": """SELECT case_id, CASE WHEN r <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT o_orderkey AS case_id, count(*) OVER () AS n,
         row_number() OVER (ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders)""",
    "holdout_split_sizes": """SELECT 'test' AS split, CAST(ceil(count(*) * 0.25) AS BIGINT) AS n FROM orders
UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.25) AS BIGINT) FROM orders""",
    "learning_curve_prefixes": f"""WITH {CASE_FOLDS},
sizes AS (
  SELECT CAST(f AS DOUBLE) AS fraction, CAST(floor(CAST(f AS DOUBLE) * (SELECT count(*) FROM folded WHERE fold <> 0)) AS BIGINT) AS n_rows
  FROM (VALUES (0.85), (0.9), (0.95), (1.0)) v(f)),
train AS (
  SELECT i AS fold, case_id, row_number() OVER (PARTITION BY i ORDER BY case_id) AS r
  FROM folded, (VALUES (0), (1), (2), (3), (4)) k(i) WHERE fold <> i)
SELECT fold, fraction, n_rows, case_id AS cutoff_key FROM train JOIN sizes ON r = n_rows""",
    "majority_baseline_cv": f"""WITH {CASE_FOLDS},
per_label AS (
  SELECT i AS fold, label, count(*) FILTER (WHERE fold <> i) AS train, count(*) FILTER (WHERE fold = i) AS test
  FROM folded, (VALUES (0), (1), (2), (3), (4)) k(i) GROUP BY i, label),
best AS (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train DESC, label) AS r,
         sum(train) OVER (PARTITION BY fold) AS all_train, sum(test) OVER (PARTITION BY fold) AS all_test
  FROM per_label)
SELECT fold, label AS prediction, round(train / all_train, 6) AS train_score, round(test / all_test, 6) AS test_score
FROM best WHERE r = 1""",
    "params_explode": """SELECT event_id, k AS param, v AS value, TRY_CAST(v AS DOUBLE) AS numeric_value FROM (
  SELECT event_id, unnest(json_keys(props)) AS k, props ->> unnest(json_keys(props)) AS v FROM events)""",
    "distinct_param_values": """SELECT k AS param, count(DISTINCT TRY_CAST(v AS DOUBLE)) AS n_values FROM (
  SELECT unnest(json_keys(props)) AS k, props ->> unnest(json_keys(props)) AS v FROM events)
GROUP BY k HAVING count(DISTINCT TRY_CAST(v AS DOUBLE)) > 1""",
    "group_mean_std": """SELECT props ->> 'k' AS k, round(avg(value), 6) AS value_mean,
  round(coalesce(stddev_samp(value), 0), 6) AS value_std FROM events WHERE props ->> 'k' IS NOT NULL GROUP BY 1""",
    "best_per_group": f"""SELECT user_id, seq, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, seq) AS r FROM ({_EVENT_SCORES}))
WHERE r = 1""",
    "best_overall": f"{_EVENT_SCORES} ORDER BY value DESC NULLS LAST, seq LIMIT 1",
    "best_overlay": """WITH ranked AS (
  SELECT event_id AS seq, user_id AS model_str, event_type, value, props,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) AS r FROM events)
SELECT a.model_str, a.seq, coalesce(b.value, a.value) AS value, b.props
FROM (SELECT * FROM ranked WHERE r = 1 AND event_type = 'view') a
LEFT JOIN (SELECT * FROM ranked WHERE r = 1 AND event_type = 'purchase') b USING (model_str)""",
    "sex_ordinal": f"WITH {CASES} SELECT case_id, CASE sex WHEN 'female' THEN 0 ELSE 1 END AS sex_code FROM people",
    "age_standardized": f"""WITH {CASES}
SELECT case_id, round((age_in_months - avg(age_in_months) OVER ()) / stddev_pop(age_in_months) OVER (), 6) AS age_scaled
FROM aged""",
    "evidence_count_minmax": f"""WITH {CASES}
SELECT case_id, {_MINMAX} FROM case_counts""",
    "assembled_features": f"""WITH {CASES},
known AS (
  SELECT evidence_id, row_number() OVER (ORDER BY evidence_id) + 3 AS place
  FROM (SELECT DISTINCT evidence_id FROM lines WHERE state <> 'unknown')),
scaled AS (SELECT case_id, {_MINMAX} FROM case_counts)
SELECT case_id, CAST(place AS INTEGER) AS place, CAST(value AS DOUBLE) AS value FROM (
  SELECT case_id, 0 AS place, CASE sex WHEN 'female' THEN 0.0 ELSE 1.0 END AS value FROM people
  UNION ALL
  SELECT case_id, 1, round((age_in_months - avg(age_in_months) OVER ()) / stddev_pop(age_in_months) OVER (), 6) FROM aged
  UNION ALL SELECT case_id, 2, present_evidence_count_scaled FROM scaled
  UNION ALL SELECT case_id, 3, absent_evidence_count_scaled FROM scaled
  UNION ALL SELECT case_id, place, value FROM ternary JOIN known USING (evidence_id))
WHERE value <> 0""",
    "assembled_features_present_only": f"""WITH {CASES},
known AS (
  SELECT evidence_id, row_number() OVER (ORDER BY evidence_id) + 1 AS place
  FROM (SELECT DISTINCT evidence_id FROM lines WHERE state = 'present'))
SELECT case_id, CAST(place AS INTEGER) AS place, CAST(value AS DOUBLE) AS value FROM (
  SELECT case_id, 0 AS place, CASE sex WHEN 'female' THEN 0.0 ELSE 1.0 END AS value FROM people
  UNION ALL
  SELECT case_id, 1, round((age_in_months - avg(age_in_months) OVER ()) / stddev_pop(age_in_months) OVER (), 6) FROM aged
  UNION ALL
  SELECT DISTINCT case_id, place, 1 FROM lines JOIN known USING (evidence_id) WHERE state = 'present')
WHERE value <> 0""",
    "pca_row_norms": """WITH cells AS (
  SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
centred AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY i) AS x FROM cells)
SELECT vec_id, round(sum(x * x), 6) AS norm2 FROM centred GROUP BY vec_id""",
    "svd_row_norms": """SELECT vec_id, round(sum(x * x), 6) AS norm2 FROM (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id""",
    "vector_sweep": f"""WITH {_SEARCH}
SELECT CAST(0 AS BIGINT) AS seq, {_RESULT.format(model='DummyClassifier')}, '{{}}' AS params, {_MEANS} FROM dummy_scores
UNION ALL
SELECT CAST(1 AS BIGINT), {_RESULT.format(model='KNeighborsClassifier')}, '{{}}', {_MEANS} FROM knn_scores WHERE k = 5""",
    "vector_grid": f"""WITH {_SEARCH}
SELECT seq, {_RESULT.format(model='KNeighborsClassifier')}, params, mean_train_score, mean_test_score FROM grid""",
    "vector_best_parameters": f"""WITH {_SEARCH}
SELECT CAST(0 AS BIGINT) AS seq, {_RESULT.format(model='DummyClassifier')}, '{{}}' AS params, {_MEANS} FROM dummy_scores
UNION ALL
SELECT CAST(1 AS BIGINT), {_RESULT.format(model='KNeighborsClassifier')}, params, mean_train_score, mean_test_score FROM best""",
    "vector_score_by_parameter": f"""WITH {_SEARCH}
SELECT CAST(k AS VARCHAR) AS value, mean_train_score AS mean_train_score_mean, 0.0::DOUBLE AS mean_train_score_std,
  mean_test_score AS mean_test_score_mean, 0.0::DOUBLE AS mean_test_score_std, CAST(k AS DOUBLE) AS numeric_value FROM grid""",
    "vector_best_predictor": f"""WITH {_SEARCH},
near AS (SELECT q, ql, tl, row_number() OVER (PARTITION BY q ORDER BY d, t) AS r FROM dist),
ballot AS (SELECT q, ql, tl, count(*) AS n FROM near WHERE r <= (SELECT k FROM best) GROUP BY q, ql, tl),
elected AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, tl) AS r FROM ballot)
SELECT CAST(ql AS INTEGER) AS label, CAST(tl AS INTEGER) AS prediction, count(*) AS n FROM elected WHERE r = 1 GROUP BY ql, tl""",
    "vector_learning_curve": f"""WITH {_DISTANCES},
sizes AS (
  SELECT CAST(f AS DOUBLE) AS fraction, CAST(floor(CAST(f AS DOUBLE) * (SELECT count(*) FROM folded WHERE fold <> 0)) AS BIGINT) AS n_rows
  FROM (VALUES (0.85), (0.9), (0.95), (1.0)) v(f)),
train AS (
  SELECT i AS fold, case_id, row_number() OVER (PARTITION BY i ORDER BY case_id) AS r
  FROM folded, (VALUES (0), (1), (2), (3), (4)) f(i) WHERE fold <> i),
cuts AS (SELECT fold, fraction, n_rows, case_id AS cut FROM train JOIN sizes ON r = n_rows),
near AS (
  SELECT c.fold, fraction, n_rows, q, ql, qf, tl,
    row_number() OVER (PARTITION BY c.fold, fraction, q ORDER BY d, t) AS r
  FROM cuts c JOIN dist ON tf <> c.fold AND t <= c.cut AND (qf = c.fold OR q <= c.cut)),
ballot AS (
  SELECT fold, fraction, n_rows, q, ql, qf, tl, count(*) AS n FROM near WHERE r <= 5 GROUP BY fold, fraction, n_rows, q, ql, qf, tl),
elected AS (SELECT *, row_number() OVER (PARTITION BY fold, fraction, q ORDER BY n DESC, tl) AS r FROM ballot)
SELECT fraction, n_rows, fold, round(avg((ql = tl)::INTEGER) FILTER (WHERE qf <> fold), 6) AS train_score,
  round(avg((ql = tl)::INTEGER) FILTER (WHERE qf = fold), 6) AS test_score
FROM elected WHERE r = 1 GROUP BY fraction, n_rows, fold""",
    "results_as_text": f"""WITH {_SEARCH}
SELECT seq, 'KNeighborsClassifier' AS model_class, CAST(k AS INTEGER) AS n_neighbors, mean_train_score, mean_test_score FROM grid""",
    "saved_model_predictions": f"""WITH {_DISTANCES},
near AS (SELECT q, ql, tl, row_number() OVER (PARTITION BY q ORDER BY d, t) AS r FROM dist),
ballot AS (SELECT q, ql, tl, count(*) AS n FROM near WHERE r <= 5 GROUP BY q, ql, tl),
elected AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, tl) AS r FROM ballot)
SELECT q AS vec_id, CAST(ql AS INTEGER) AS label, CAST(tl AS INTEGER) AS prediction FROM elected WHERE r = 1""",
    "majority_predict": f"""WITH {VECTOR_FOLDS},
tally AS (
  SELECT i AS fold, label, row_number() OVER (PARTITION BY i ORDER BY count(*) DESC, label) AS r
  FROM folded, (VALUES (0), (1), (2), (3), (4)) k(i) WHERE fold <> i GROUP BY i, label)
SELECT f.case_id AS vec_id, f.fold, f.label, t.label AS prediction FROM folded f JOIN tally t ON f.fold = t.fold AND t.r = 1""",
    "knn_predict": f"""WITH {VECTOR_FOLDS},
pairs AS (
  SELECT q.case_id AS vec_id, q.fold AS fold, q.label AS own, t.label AS label,
         row_number() OVER (PARTITION BY q.case_id ORDER BY
           list_distance(CAST(qe.embedding AS DOUBLE[]), CAST(te.embedding AS DOUBLE[])), t.case_id) AS r
  FROM folded q JOIN embeddings qe ON q.case_id = qe.vec_id,
       folded t JOIN embeddings te ON t.case_id = te.vec_id
  WHERE q.fold <> t.fold),
votes AS (SELECT vec_id, fold, own, label, count(*) AS n FROM pairs WHERE r <= 5 GROUP BY vec_id, fold, own, label)
SELECT vec_id, fold, own AS label, label AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1""",
    "majority_sweep": f"""WITH {CASE_FOLDS},
per_label AS (
  SELECT i AS fold, label, count(*) FILTER (WHERE fold <> i) AS train, count(*) FILTER (WHERE fold = i) AS test
  FROM folded, (VALUES (0), (1), (2), (3), (4)) k(i) GROUP BY i, label),
best AS (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train DESC, label) AS r,
         sum(train) OVER (PARTITION BY fold) AS all_train, sum(test) OVER (PARTITION BY fold) AS all_test
  FROM per_label)
SELECT fold, round(train / all_train, 6) AS train_score, round(test / all_test, 6) AS test_score FROM best WHERE r = 1""",
    "neighbor_graph": """WITH pairs AS (
  SELECT a.vec_id AS src, b.vec_id AS dst,
         list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS w
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS r FROM pairs) WHERE r <= 5)
SELECT src, dst, round(min(w), 6) AS w FROM (
  SELECT src, dst, w FROM near UNION ALL SELECT dst, src, w FROM near) GROUP BY src, dst""",
    "neighbors_blocked": """WITH pairs AS (
  SELECT a.vec_id AS key, b.vec_id AS neighbor,
         list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS w
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT key, neighbor, round(w, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY w, neighbor) AS r FROM pairs) WHERE r <= 5""",
}

# What is read back has the results of the plain queries.
SQL |= {
    "json_lines_cases": SQL["nested_record_scan"],
    "json_array_cases": SQL["nested_record_scan"],
    "parquet_cases": SQL["nested_record_scan"],
    "chapter_file_blocks": SQL["code_range_lookup"],
    "resumed_sweep": SQL["vector_sweep"],
}
