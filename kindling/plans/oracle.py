"""DuckDB SQL twins of the named queries (run on the same parquet tables).

The SQL uses the plainest correct form (global windows, row_number ranking) so it
checks the distributed forms in ``kindling.operators`` independently.
"""

from __future__ import annotations

D = "CAST({} AS DOUBLE)".format

EV = """ev AS (
  SELECT event_id, ts, user_id, CAST(event_type = 'error' AS INTEGER) AS label, value,
         CAST(hour(ts) AS DOUBLE) AS hour
  FROM events)"""

PARTS = EV + """,
parts AS (
  SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-25 00:00:00' THEN 'train'
                 WHEN ts >= TIMESTAMP '2024-01-25 00:00:00' THEN 'valid' END AS part
  FROM ev WHERE ts IS NOT NULL)"""


def balanced(src: str, key: str, out: str = "bal", cap: int | None = None, seed: int = 42) -> str:
    k = "min(n)" if not cap else f"least(min(n), {int(cap)})"
    return f""",
{out}_cnt AS (SELECT part, label, count(*) AS n FROM {src} WHERE label IN (0, 1) GROUP BY part, label),
{out}_k AS (SELECT part, {k} AS k FROM {out}_cnt GROUP BY part),
{out}_rk AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.part, s.label
                                 ORDER BY md5('{seed}:' || CAST(s.{key} AS VARCHAR)), s.{key}) AS rn
  FROM {src} s WHERE s.label IN (0, 1)),
{out} AS (SELECT r.* EXCLUDE (rn) FROM {out}_rk r JOIN {out}_k USING (part) WHERE rn <= k)"""


BAL = PARTS + balanced("parts", "event_id")

ORD = """ord AS (
  SELECT o_orderkey, o_orderdate, CAST(o_orderstatus = 'F' AS INTEGER) AS label, o_totalprice,
         CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority, CAST(month(o_orderdate) AS DOUBLE) AS month
  FROM orders),
oparts AS (
  SELECT *, CASE WHEN o_orderdate < TIMESTAMP '2000-01-01 00:00:00' THEN 'train'
                 WHEN o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' THEN 'valid' END AS part
  FROM ord WHERE o_orderdate IS NOT NULL)"""

LOGITS = EV + """,
logits AS (
  SELECT event_id AS key, 'm50_50' AS model, label, (value - 50.0) / 50.0 AS logit FROM ev
  UNION ALL SELECT event_id, 'm40_30', label, (value - 40.0) / 30.0 FROM ev
  UNION ALL SELECT event_id, 'm60_100', label, (value - 60.0) / 100.0 FROM ev)"""

SCORED = LOGITS + """,
scored AS (SELECT key, model, label, round(1.0 / (1.0 + exp(-logit)), 4) AS score FROM logits)"""


def bce(p: str, y: str) -> str:
    return (f"(-( {D(y)} * (CASE WHEN {p} > 0 THEN greatest(ln({p}), -100.0) ELSE -100.0 END)"
            f" + (1.0 - {D(y)}) * (CASE WHEN 1.0 - {p} > 0 THEN greatest(ln(1.0 - {p}), -100.0) ELSE -100.0 END)))")


def softplus(x: str) -> str:
    return f"(greatest({x}, 0.0) + ln(1.0 + exp(-abs({x}))))"


COUNTS = """,
counts AS (SELECT model, CAST(score AS DOUBLE) AS score, CAST(sum(label) AS BIGINT) AS pos,
                  CAST(sum(1 - label) AS BIGINT) AS neg
           FROM scored WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY model, score),
cc AS (SELECT model, score, pos, neg,
              CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
              row_number() OVER w AS idx,
              CAST(sum(pos) OVER (PARTITION BY model) AS BIGINT) AS tot_p,
              CAST(sum(neg) OVER (PARTITION BY model) AS BIGINT) AS tot_n,
              count(*) OVER (PARTITION BY model) AS m_pts
       FROM counts
       WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pr AS (SELECT model, score AS threshold,
              CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
              CASE WHEN tot_p = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / CAST(tot_p AS DOUBLE) END AS recall
       FROM cc),
best AS (SELECT model, threshold, search_f1 FROM (
           SELECT model, threshold, 2.0 * (precision * recall) / (precision + recall + 1e-8) AS search_f1,
                  row_number() OVER (PARTITION BY model
                                     ORDER BY 2.0 * (precision * recall) / (precision + recall + 1e-8) DESC,
                                              threshold ASC) AS r
           FROM pr) WHERE r = 1),
aucs AS (SELECT model,
                CASE WHEN max(tot_p) > 0 AND max(tot_n) > 0
                     THEN CAST(sum(pos * (2 * (tot_n - fp) + neg)) AS DOUBLE)
                          / (2.0 * CAST(max(tot_p) AS DOUBLE) * CAST(max(tot_n) AS DOUBLE)) END AS auc
         FROM cc GROUP BY model)"""


def cells(thr_sql: str) -> str:
    """Confusion cells and rates per model for a thresholds relation ``(model, threshold)``."""
    return f""",
thr AS ({thr_sql}),
cells AS (
  SELECT c.model, t.threshold,
         CAST(sum(CASE WHEN c.score > t.threshold THEN 0 ELSE c.neg END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN c.score > t.threshold THEN c.neg ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN c.score > t.threshold THEN 0 ELSE c.pos END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN c.score > t.threshold THEN c.pos ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(c.pos + c.neg) AS BIGINT) AS n
  FROM counts c JOIN thr t USING (model) GROUP BY c.model, t.threshold),
rates AS (
  SELECT *, CASE WHEN n <> 0 THEN CAST(tp + tn AS DOUBLE) / CAST(n AS DOUBLE) ELSE 0.0 END AS accuracy,
            CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
            CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall,
            CASE WHEN 2 * tp + fp + fn <> 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE)
                 ELSE 0.0 END AS f1
  FROM cells)"""


FIXED_THR = "SELECT DISTINCT model, CAST(0.5 AS DOUBLE) AS threshold FROM counts"

EVALUATION = COUNTS + cells("SELECT model, threshold FROM best") + f""",
losses AS (SELECT model, sum(pos * {bce('score', '1')} + neg * {bce('score', '0')})
                         / CAST(sum(pos + neg) AS DOUBLE) AS loss FROM counts GROUP BY model),
evaluation AS (
  SELECT r.model, r.n, l.loss, r.accuracy, a.auc, r.precision, r.recall, r.f1, r.tn, r.fp, r.fn, r.tp, r.threshold
  FROM rates r JOIN losses l USING (model) JOIN aucs a USING (model))"""

EVAL_SELECT = """SELECT model, n, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, round(auc, 6) AS auc,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       tn, fp, fn, tp, threshold FROM evaluation"""


def scaler(src: str, feats: list[str], out: str = "params") -> str:
    parts = []
    for f in feats:
        parts.append(f"SELECT '{f}' AS feature, avg({f}) AS mean, "
                     f"CASE WHEN stddev_pop({f}) = 0 OR stddev_pop({f}) IS NULL THEN 1.0 "
                     f"ELSE stddev_pop({f}) END AS std FROM {src}")
    return f""",
{out} AS ({' UNION ALL '.join(parts)})"""


def scaled_cols(feats: list[str], params: str = "params", rnd: bool = True) -> str:
    cols = []
    for f in feats:
        e = (f"({f} - (SELECT mean FROM {params} WHERE feature = '{f}')) / "
             f"(SELECT std FROM {params} WHERE feature = '{f}')")
        cols.append(f"round({e}, 6) AS {f}" if rnd else f"{e} AS {f}")
    return ", ".join(cols)


EVF = ["value", "hour"]
ORF = ["o_totalprice", "priority", "month"]

SQL: dict[str, str] = {}

SQL["table_profile"] = "WITH " + BAL + """
SELECT 'raw' AS stage, 'all' AS part, count(*) AS n_rows, 6 AS n_cols FROM ev
UNION ALL SELECT 'split', part, count(*), 6 FROM parts GROUP BY part
UNION ALL SELECT 'balanced', part, count(*), 6 FROM bal GROUP BY part"""

SQL["class_counts"] = "WITH " + PARTS + """
SELECT part, label, count(*) AS n FROM parts GROUP BY part, label"""

SQL["time_split"] = "WITH " + PARTS + "\nSELECT event_id, part FROM parts"

SQL["balanced_sample"] = "WITH " + BAL + "\nSELECT event_id, part, label FROM bal"

SQL["balanced_sample_capped"] = "WITH " + ORD + balanced("oparts", "o_orderkey", "obal", cap=1000) + \
    "\nSELECT o_orderkey, part, label FROM obal"

SQL["shuffle_order"] = "WITH " + BAL + """
SELECT event_id, part, label, md5('shuffle:42:' || CAST(event_id AS VARCHAR)) AS shuffle_key FROM bal"""

SQL["scaler_params"] = "WITH " + BAL + scaler("(SELECT * FROM bal WHERE part = 'train')", EVF) + """
SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM params"""

SQL["scaler_transform"] = "WITH " + BAL + scaler("(SELECT * FROM bal WHERE part = 'train')", EVF) + f"""
SELECT event_id, part, label, {scaled_cols(EVF)} FROM bal"""

SQL["prepared"] = "WITH " + ORD + balanced("oparts", "o_orderkey", "obal") + \
    scaler("(SELECT * FROM obal WHERE part = 'train')", ORF) + f"""
SELECT o_orderkey, part, label, {scaled_cols(ORF)},
       md5('shuffle:42:' || CAST(o_orderkey AS VARCHAR)) AS shuffle_key FROM obal"""

SQL["probabilities"] = "WITH " + LOGITS + """
SELECT key, model, label, round(1.0 / (1.0 + exp(-logit)), 6) AS score FROM logits"""

SQL["predictions"] = "WITH " + SCORED + """
SELECT key, model, label, score, CAST(score > 0.5 AS INTEGER) AS pred FROM scored"""

SQL["log_loss"] = "WITH " + SCORED + f"""
SELECT model, round(avg({bce('score', 'label')}), 6) AS log_loss FROM scored GROUP BY model"""

SQL["weighted_log_loss"] = "WITH " + LOGITS + f"""
SELECT model, round(avg(2.0 * {D('label')} * {softplus('-logit')} + (1.0 - {D('label')}) * {softplus('logit')}), 6)
       AS weighted_log_loss FROM logits GROUP BY model"""

SQL["accuracy"] = "WITH " + SCORED + COUNTS + cells(FIXED_THR) + """
SELECT model, round(accuracy, 6) AS accuracy FROM rates"""

SQL["confusion"] = "WITH " + SCORED + COUNTS + cells(FIXED_THR) + """
SELECT model, 0 AS label, 0 AS pred, tn AS n FROM cells
UNION ALL SELECT model, 0, 1, fp FROM cells
UNION ALL SELECT model, 1, 0, fn FROM cells
UNION ALL SELECT model, 1, 1, tp FROM cells"""

SQL["binary_metrics"] = "WITH " + SCORED + COUNTS + cells(FIXED_THR) + """
SELECT model, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       tn, fp, fn, tp FROM rates"""

TRAIN_SCORED = SCORED.replace("scored AS (", "all_scored AS (", 1) + """,
scored AS (SELECT s.* FROM all_scored s WHERE s.key IN
           (SELECT event_id FROM ev WHERE ts < TIMESTAMP '2024-01-25 00:00:00'))"""
SQL["epoch_metrics"] = "WITH " + TRAIN_SCORED + COUNTS + f""",
tr AS (SELECT model, round(avg({bce('score', 'label')}), 6) AS loss,
              round(avg(CASE WHEN CAST(score > 0.5 AS INTEGER) = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
              count(*) AS n FROM scored GROUP BY model)
SELECT model, loss, accuracy, round(auc, 6) AS auc, n FROM tr JOIN aucs USING (model)"""

SQL["evaluation_weighted"] = "WITH " + SCORED + COUNTS + cells(FIXED_THR) + f""",
losses AS (SELECT model, sum(2.0 * pos * {bce('score', '1')} + neg * {bce('score', '0')})
                         / CAST(sum(pos + neg) AS DOUBLE) AS loss FROM counts GROUP BY model),
evaluation AS (
  SELECT r.model, r.n, l.loss, r.accuracy, a.auc, r.precision, r.recall, r.f1, r.tn, r.fp, r.fn, r.tp, r.threshold
  FROM rates r JOIN losses l USING (model) JOIN aucs a USING (model))
""" + EVAL_SELECT

SQL["auc"] = "WITH " + SCORED + COUNTS + "\nSELECT model, round(auc, 6) AS auc FROM aucs"

SQL["pr_curve"] = "WITH " + SCORED + COUNTS + """
SELECT model, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM cc"""

ROC_SELECT = """SELECT a.model, a.score AS threshold,
       round(CASE WHEN a.tot_n > 0 THEN CAST(a.fp AS DOUBLE) / CAST(a.tot_n AS DOUBLE) END, 6) AS fpr,
       round(CASE WHEN a.tot_p > 0 THEN CAST(a.tp AS DOUBLE) / CAST(a.tot_p AS DOUBLE) END, 6) AS tpr"""
ROC_START = "\nUNION ALL SELECT DISTINCT model, CAST('Infinity' AS DOUBLE), 0.0, 0.0 FROM cc"

SQL["roc_curve"] = "WITH " + SCORED + COUNTS + "\n" + ROC_SELECT + " FROM cc a" + ROC_START

SQL["roc_reduced"] = "WITH " + SCORED + COUNTS + "\n" + ROC_SELECT + """
FROM cc a LEFT JOIN cc b ON a.model = b.model AND b.idx = a.idx + 1
WHERE a.m_pts <= 2 OR a.idx = 1 OR b.pos IS NULL OR b.pos <> a.pos OR b.neg <> a.neg""" + ROC_START

SQL["trapezoid_auc"] = "WITH " + SCORED + COUNTS + """,
roc AS (SELECT model, threshold, fpr, tpr,
               lag(fpr) OVER (PARTITION BY model ORDER BY threshold DESC) AS fpr0,
               lag(tpr) OVER (PARTITION BY model ORDER BY threshold DESC) AS tpr0
        FROM (SELECT model, score AS threshold, CAST(fp AS DOUBLE) / tot_n AS fpr, CAST(tp AS DOUBLE) / tot_p AS tpr
              FROM cc WHERE tot_p > 0 AND tot_n > 0
              UNION ALL SELECT DISTINCT model, CAST('Infinity' AS DOUBLE), 0.0, 0.0 FROM cc))
SELECT m.model, round(t.area, 6) AS trapezoid_auc
FROM (SELECT DISTINCT model FROM cc) m LEFT JOIN
     (SELECT model, sum((fpr - fpr0) * (tpr + tpr0) / 2.0) AS area FROM roc WHERE fpr0 IS NOT NULL GROUP BY model) t
     USING (model)"""

SQL["mean_precision"] = "WITH " + SCORED + COUNTS + """
SELECT model, round((sum(precision) + 1.0) / (count(*) + 1), 6) AS mean_precision FROM pr GROUP BY model"""

SQL["best_threshold"] = "WITH " + SCORED + COUNTS + """
SELECT model, threshold, round(search_f1, 6) AS search_f1 FROM best"""

SQL["evaluation"] = "WITH " + SCORED + EVALUATION + "\n" + EVAL_SELECT

SQL["model_comparison"] = "WITH " + SCORED + EVALUATION + """
SELECT model, round(accuracy, 6) AS accuracy, round(auc, 6) AS auc, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(0.0 AS DOUBLE) AS training_time, CAST(2 AS BIGINT) AS parameters
FROM evaluation"""

SQL["metric_bars"] = "WITH " + SCORED + EVALUATION + """
SELECT model, metric, round(value, 6) AS value FROM (
  UNPIVOT (SELECT model, accuracy, auc, precision, recall, f1 FROM evaluation)
  ON accuracy, auc, precision, recall, f1 INTO NAME metric VALUE value)"""

SQL["flagship"] = "WITH " + BAL + scaler("(SELECT * FROM bal WHERE part = 'train')", EVF) + f""",
sc AS (SELECT event_id, label, {scaled_cols(EVF, rnd=False)} FROM bal WHERE part = 'valid'),
scored AS (SELECT event_id AS key, 'flagship' AS model, label,
                  round(1.0 / (1.0 + exp(-((-0.2 + 0.8 * value) + 0.1 * hour))), 4) AS score FROM sc)""" + \
    EVALUATION + "\n" + EVAL_SELECT


# --- catalog -----------------------------------------------------------------------------------

LI_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]

LI = "li AS (SELECT l_orderkey, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LI_FEATS) + \
     ", CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"

LI_LONG = LI + ",\nli_long AS (" + " UNION ALL ".join(
    f"SELECT l_orderkey, '{c}' AS feature, {c} AS value FROM li" for c in LI_FEATS) + ")"


def values_rel(rows, cols) -> str:
    vals = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {vals}) t({', '.join(cols)}))"


LI_TAGGED = LI_LONG + f""",
names AS {values_rel([(c,) for c in LI_FEATS], ['feature'])},
kw AS {values_rel([('price', 'price'), ('extended', 'extended'), ('quantity', 'quantity'),
                   ('discount', 'discount'), ('count', 'count')], ['grp', 'keyword'])},
matched AS (SELECT DISTINCT n.feature, k.grp FROM names n JOIN kw k ON contains(lower(n.feature), k.keyword)),
cat AS (SELECT feature, grp FROM matched
        UNION ALL SELECT feature, 'other' FROM names WHERE feature NOT IN (SELECT feature FROM matched)),
tagged AS (SELECT l.l_orderkey, l.feature, l.value, c.grp FROM li_long l JOIN cat c USING (feature))"""

SQL["feature_groups"] = "WITH " + LI_TAGGED + """
SELECT l_orderkey, feature, value, grp AS "group" FROM tagged"""

SQL["group_profile"] = "WITH " + LI_TAGGED + """
SELECT grp AS "group", count(*) AS n_values,
       CAST(sum(CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
       round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max
FROM tagged GROUP BY grp"""

SQL["feature_rank"] = "WITH " + LI + """,
sc AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, CAST(label AS DOUBLE)) AS c FROM li"
                                for c in LI_FEATS) + """)
SELECT feature, round(c, 6) AS corr, round(abs(c), 6) AS importance FROM sc
ORDER BY abs(c) DESC NULLS LAST, feature LIMIT 3"""

# --- derived tables ----------------------------------------------------------------------------

FILLED = """daily AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
                         avg(value) AS value, count(*) AS n_events
                  FROM events GROUP BY 1, 2),
span AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM daily GROUP BY user_id),
grid AS (SELECT user_id, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS day FROM span),
g AS (SELECT grid.user_id, grid.day, d.value, d.n_events FROM grid LEFT JOIN daily d USING (user_id, day)),
g2 AS (SELECT *,
         max(CASE WHEN value IS NOT NULL THEN day END) OVER (PARTITION BY user_id ORDER BY day
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d0,
         min(CASE WHEN value IS NOT NULL THEN day END) OVER (PARTITION BY user_id ORDER BY day
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d1
       FROM g),
filled AS (
  SELECT g2.user_id, g2.day, g2.value, CAST(coalesce(g2.n_events, 0) AS BIGINT) AS n_events,
         CASE WHEN g2.value IS NOT NULL THEN g2.value
              WHEN a.value IS NOT NULL AND b.value IS NOT NULL
                THEN a.value + ((b.value - a.value) * CAST(g2.day - g2.d0 AS DOUBLE)) / CAST(g2.d1 - g2.d0 AS DOUBLE)
              WHEN a.value IS NOT NULL THEN a.value END AS value_filled
  FROM g2 LEFT JOIN daily a ON a.user_id = g2.user_id AND a.day = g2.d0
          LEFT JOIN daily b ON b.user_id = g2.user_id AND b.day = g2.d1),
lagged AS (
  SELECT user_id, day, value_filled AS value,
         lag(value_filled, 1) OVER w AS value_lag_1, lag(value_filled, 2) OVER w AS value_lag_2,
         lag(value_filled, 7) OVER w AS value_lag_7, n_events, lag(n_events, 1) OVER w AS n_events_lag_1
  FROM filled WINDOW w AS (PARTITION BY user_id ORDER BY day))"""

SQL["interpolated"] = "WITH " + FILLED + """
SELECT user_id, day, round(value, 6) AS value, round(value_filled, 6) AS value_filled, n_events FROM filled"""

SQL["lag_features"] = "WITH " + FILLED + """
SELECT user_id, day, round(value, 6) AS value, round(value_lag_1, 6) AS value_lag_1,
       round(value_lag_2, 6) AS value_lag_2, round(value_lag_7, 6) AS value_lag_7, n_events, n_events_lag_1
FROM lagged"""

LAG_NAMES = ["value", "value_lag_1", "value_lag_2", "value_lag_7", "n_events", "n_events_lag_1"]

SQL["lag_groups"] = "WITH " + FILLED + f""",
names AS {values_rel([(c,) for c in LAG_NAMES], ['feature'])},
toks AS (SELECT feature, string_split(feature, '_') AS t FROM names),
parsed AS (
  SELECT feature,
         list_filter(list_transform(range(0, len(t) - 1),
                       lambda i: CASE WHEN lower(t[i + 1]) = 'lag' AND regexp_matches(t[i + 2], '^\\s*[+-]?[0-9]+\\s*$')
                                      THEN CAST(trim(t[i + 2]) AS BIGINT) END),
                     lambda v: v IS NOT NULL)[1] AS lag
  FROM toks),
cat AS (SELECT feature, lag FROM parsed WHERE contains(lower(feature), 'lag') AND lag IS NOT NULL AND lag <> 0
        UNION ALL
        SELECT feature, CAST(0 AS BIGINT) FROM names
        WHERE NOT contains(lower(feature), 'lag') AND feature NOT IN ('is_fire', 'acq_date')),
long AS (SELECT user_id, day, feature, value FROM
           (SELECT user_id, day, value, value_lag_1, value_lag_2, value_lag_7,
                   CAST(n_events AS DOUBLE) AS n_events, CAST(n_events_lag_1 AS DOUBLE) AS n_events_lag_1
            FROM lagged)
           UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(LAG_NAMES)})))
SELECT l.user_id, l.day, l.feature, round(l.value, 6) AS value, c.lag FROM long l JOIN cat c USING (feature)"""

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

SQL["lag_profile"] = SQL["lag_groups"].rsplit("SELECT l.user_id", 1)[0] + """SELECT c.lag, count(*) AS n_values,
       CAST(sum(CASE WHEN l.value IS NULL OR isnan(l.value) THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
       round(avg(l.value), 6) AS mean, round(stddev_pop(l.value), 6) AS std,
       round(min(l.value), 6) AS min, round(max(l.value), 6) AS max
FROM long l JOIN cat c USING (feature) GROUP BY c.lag"""

SQL["standard_names"] = "SELECT c_nationkey, " + ", ".join(
    f"round(avg(CASE WHEN c_mktsegment = '{s}' THEN c_acctbal END), 6) AS {s.lower()}" for s in SEGMENTS) + \
    " FROM customer GROUP BY c_nationkey"

SQL["source_merge"] = """SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment, n.n_name, o.o_totalprice
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
              LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""

# --- history -----------------------------------------------------------------------------------

HIST = """hd AS (
  SELECT user_id AS run, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day,
         coalesce(avg(value), 0.0) / 100.0 AS val_f1,
         coalesce(avg(CASE WHEN event_type = 'view' THEN value END), 0.0) / 100.0 AS train_loss,
         coalesce(avg(CASE WHEN event_type = 'click' THEN value END), 0.0) / 100.0 AS train_acc,
         coalesce(avg(CASE WHEN event_type = 'purchase' THEN value END), 0.0) / 100.0 AS train_auc,
         coalesce(avg(CASE WHEN event_type = 'signup' THEN value END), 0.0) / 100.0 AS val_loss,
         coalesce(avg(CASE WHEN event_type = 'error' THEN value END), 0.0) / 100.0 AS val_acc,
         min(value) AS mn, max(value) AS mx
  FROM events GROUP BY 1, 2),
hist AS (SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY day) - 1 AS INTEGER) AS epoch, day,
                train_loss, train_acc, train_auc, val_loss, val_acc, mn / 100.0 AS val_auc,
                mx / 1000.0 AS val_precision, (mx - mn) / 1000.0 AS val_recall, val_f1 FROM hd),
sched AS (SELECT *, (epoch % 2 = 0) OR (epoch = max(epoch) OVER (PARTITION BY run)) AS searched_epoch FROM hist),
sched2 AS (SELECT *, coalesce(last_value(CASE WHEN searched_epoch THEN val_precision END IGNORE NULLS)
                                OVER (PARTITION BY run ORDER BY epoch
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.5) AS threshold
           FROM sched)"""

SQL["threshold_carry"] = "WITH " + HIST + """
SELECT run, epoch, searched_epoch, round(threshold, 6) AS threshold FROM sched2"""

SQL["early_stop"] = "WITH " + HIST + """,
h AS (SELECT *, val_f1 > greatest(coalesce(max(val_f1) OVER (PARTITION BY run ORDER BY epoch
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS improved
      FROM sched2),
h2 AS (SELECT *, coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_improved FROM h),
h3 AS (SELECT *, epoch - last_improved AS since FROM h2),
st AS (SELECT run, min(CASE WHEN since >= 3 THEN epoch END) AS stop_epoch FROM h3 GROUP BY run)
SELECT h3.run, CAST(st.stop_epoch AS INTEGER) AS stop_epoch, count(*) AS epochs_run,
       CAST(coalesce(max(CASE WHEN improved THEN epoch END), -1) AS INTEGER) AS best_epoch,
       round(max(CASE WHEN improved THEN val_f1 END), 6) AS best_metric,
       round(arg_max(threshold, epoch), 6) AS final_threshold
FROM h3 JOIN st USING (run) WHERE st.stop_epoch IS NULL OR h3.epoch <= st.stop_epoch
GROUP BY h3.run, st.stop_epoch"""

SERIES = ["train_loss", "train_acc", "train_auc", "val_loss", "val_acc", "val_auc", "val_precision", "val_recall",
          "val_f1", "threshold"]

SQL["training_curves"] = "WITH " + HIST + f"""
SELECT run, epoch, series, round(value, 6) AS value FROM
  (SELECT run, epoch, {', '.join(SERIES)} FROM sched2)
  UNPIVOT INCLUDE NULLS (value FOR series IN ({', '.join(SERIES)}))"""


# --- scoring -------------------------------------------------------------------------------------

U = """u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x,
                 unnest(generate_series(0, len(embedding) - 1)) AS i, len(embedding) AS width
          FROM embeddings)"""

SQL["entropy_score"] = "WITH " + U + """,
lc AS (SELECT vec_id, x FROM u WHERE i < 4),
mx AS (SELECT vec_id, max(x) AS m FROM lc GROUP BY vec_id),
e AS (SELECT lc.vec_id, exp(lc.x - mx.m) AS e FROM lc JOIN mx USING (vec_id)),
z AS (SELECT vec_id, sum(e) AS z FROM e GROUP BY vec_id),
ent AS (SELECT e.vec_id, -1.0 * sum((e.e / z.z) * ln(e.e / z.z + 1e-10)) AS ent
        FROM e JOIN z USING (vec_id) GROUP BY e.vec_id),
env AS (SELECT vec_id, sum(x * (CAST(((7 * (i - 4) + 3) % 11) - 5 AS DOUBLE) / 10.0)) AS env
        FROM u WHERE i >= 4 GROUP BY vec_id)
SELECT vec_id, round(ent + coalesce(env, 0.0), 6) AS entropy_score FROM ent LEFT JOIN env USING (vec_id)"""

SQL["dense_layer"] = "WITH " + U + """,
w AS (SELECT i, unnest(range(0, 4)) AS j FROM range(0, 64) t(i)),
w2 AS (SELECT i, j, CAST((7 * i + 3 * j) % 11 - 5 AS DOUBLE) / 10.0 AS w FROM w),
z AS (SELECT u.vec_id, w2.j, sum(u.x * w2.w) AS z FROM u JOIN w2 USING (i) GROUP BY u.vec_id, w2.j)
SELECT vec_id, CAST(j AS INTEGER) AS unit,
       round(greatest(z + (CAST(j AS DOUBLE) - 1.5) / 10.0, 0.0), 6) AS h FROM z"""

BN_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

SQL["batch_norm"] = "WITH st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in BN_COLS) + " FROM lineitem)\nSELECT l_orderkey, " + \
    ", ".join(f"round(({c} - m_{c}) / sqrt(v_{c} + 1e-5), 6) AS {c}" for c in BN_COLS) + " FROM lineitem, st"

SQL["layer_norm"] = "WITH " + U + """,
st AS (SELECT vec_id, avg(x) AS m, var_pop(x) AS v FROM u GROUP BY vec_id)
SELECT u.vec_id, CAST(u.i AS INTEGER) AS pos, round((u.x - st.m) / sqrt(st.v + 1e-5), 6) AS value
FROM u JOIN st USING (vec_id)"""

SQL["conv_features"] = "WITH " + U + """,
c AS (SELECT vec_id, i, x, coalesce(lag(x) OVER w, 0.0) AS xp, coalesce(lead(x) OVER w, 0.0) AS xn
      FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, 0 AS filter, CAST(i AS INTEGER) AS pos, round(0.25 * xp + 0.5 * x + 0.25 * xn + 0.0, 6) AS value FROM c
UNION ALL
SELECT vec_id, 1, CAST(i AS INTEGER), round(-1.0 * xp + 0.0 * x + 1.0 * xn + 0.1, 6) FROM c"""


def _additive_sql() -> str:
    from kindling.plans.tables import ADDITIVE_BIAS, ADDITIVE_BINS, ADDITIVE_SHAPES

    terms = []
    for f, (lo, width, n) in ADDITIVE_BINS.items():
        shape = "[" + ", ".join(repr(float(v)) for v in ADDITIVE_SHAPES[f]) + "]"
        b = f"CAST(least(greatest(floor((CAST({f} AS DOUBLE) - {lo!r}) / {width!r}), 0), {n - 1}) AS INTEGER)"
        terms.append(f"coalesce(CAST({shape} AS DOUBLE[])[{b} + 1], 0.0)")
    return (f"SELECT l_orderkey, round({ADDITIVE_BIAS!r} + " + " + ".join(terms)
            + ", 6) + 0.0 AS additive_score FROM lineitem")


SQL["additive_score"] = _additive_sql()


def _curve_sql() -> str:
    from kindling.plans.tables import ADDITIVE_BIAS, ADDITIVE_SHAPES, CURVE_KNOTS

    terms = []
    for f, knots in CURVE_KNOTS.items():
        x, y = f"CAST({f} AS DOUBLE)", [float(v) for v in ADDITIVE_SHAPES[f]]
        parts = [f"WHEN {x} <= {knots[0]!r} THEN {y[0]!r}"]
        for a, b, u, v in zip(knots[:-1], knots[1:], y[:-1], y[1:]):
            parts.append(f"WHEN {x} <= {b!r} THEN {u!r} + ({x} - {a!r}) / ({b!r} - {a!r}) * ({v!r} - {u!r})")
        terms.append(f"CASE {' '.join(parts)} ELSE {y[-1]!r} END")
    return (f"SELECT l_orderkey, round(CAST({ADDITIVE_BIAS!r} AS DOUBLE) + " + " + ".join(terms)
            + ", 8) + 0.0 AS curve_score FROM lineitem")


SQL["curve_score"] = _curve_sql()

SQL["branch_concat"] = "WITH " + U + """,
bw AS (SELECT li, unnest(range(0, 2)) AS j FROM range(0, 16) t(li)),
br AS (SELECT u.vec_id, u.i // 16 AS bb, bw.j,
              sum(u.x * (CAST((7 * (u.i % 16) + 3 * bw.j + u.i // 16) % 11 - 5 AS DOUBLE) / 10.0)) AS z
       FROM u JOIN bw ON bw.li = u.i % 16 GROUP BY u.vec_id, u.i // 16, bw.j),
bo AS (SELECT vec_id, 2 * bb + j AS p, greatest(z + CAST(0.05 AS DOUBLE) * CAST(bb - j AS DOUBLE), 0.0) AS v FROM br),
rw AS (SELECT i, unnest(range(0, 8)) AS p FROM range(0, 64) t(i)),
rs AS (SELECT u.vec_id, rw.p, sum(u.x * (CAST((5 * u.i + 2 * rw.p) % 9 - 4 AS DOUBLE) / 20.0)) AS r
       FROM u JOIN rw USING (i) GROUP BY u.vec_id, rw.p)
SELECT bo.vec_id, CAST(bo.p AS INTEGER) AS pos, round(bo.v + rs.r, 6) AS value
FROM bo JOIN rs ON bo.vec_id = rs.vec_id AND bo.p = rs.p"""

SQL["feature_slices"] = "WITH " + U + """
SELECT vec_id, CAST(least(i // (width // 4), 3) AS INTEGER) AS slice, CAST(count(*) AS INTEGER) AS n,
       round(sum(x), 6) AS total
FROM u GROUP BY vec_id, least(i // (width // 4), 3)"""


def _zero_safe(sql: str) -> str:
    """Wrap every ``round(…)`` outside string literals as ``(round(…) + 0.0)``: DuckDB rounds
    tiny negatives to -0.0 where Spark gives 0.0; adding 0.0 changes no other value."""
    out, i, n, quoted = [], 0, len(sql), False
    while i < n:
        ch = sql[i]
        if ch == "'":
            quoted = not quoted
        starts = (not quoted and sql.startswith("round(", i)
                  and (i == 0 or not (sql[i - 1].isalnum() or sql[i - 1] == "_")))
        if not starts:
            out.append(ch)
            i += 1
            continue
        depth, k, q = 0, i + 5, False
        while k < n:
            c = sql[k]
            if c == "'":
                q = not q
            elif not q and c == "(":
                depth += 1
            elif not q and c == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append("(round(" + _zero_safe(sql[i + 6:k]) + ") + 0.0)")
        i = k + 1
    return "".join(out)


SQL = {name: _zero_safe(text) for name, text in SQL.items()}


# --- N7, N8, P11, E15 -----------------------------------------------------------------------------

def formula(n: int, m: int, a: int, b: int, scale: float) -> str:
    """The weight table ``(i, j, w)`` of the formula the registered networks use."""
    return (f"(SELECT i, j, CAST(({a} * i + {b} * j) % 11 - 5 AS DOUBLE) / {scale} AS w "
            f"FROM (SELECT i, unnest(range(0, {m})) AS j FROM range(0, {n}) t(i)))")


def layer(name: str, src: str, n: int, m: int, a: int, b: int, scale: float) -> str:
    """``(vec_id, i, x)`` of ``src`` times a weight table, as ``(vec_id, i, x)``."""
    return (f"{name} AS (SELECT s.vec_id, w.j AS i, sum(s.x * w.w) AS x FROM {src} s JOIN "
            f"{formula(n, m, a, b, scale)} w USING (i) GROUP BY s.vec_id, w.j)")


SQL["batch_score"] = "WITH " + U + ",\n" + ",\n".join([
    layer("z0", "u", 64, 8, 7, 3, 20.0),
    "h0 AS (SELECT vec_id, i, greatest(x + (i - 1) / 10.0, 0.0) AS x FROM z0)",
    layer("z1", "h0", 8, 4, 8, 4, 20.0),
    "h1 AS (SELECT vec_id, i, 1.0 - 2.0 / (exp(2.0 * (x + (i - 1) / 10.0)) + 1.0) AS x FROM z1)",
    layer("z2", "h1", 4, 1, 9, 5, 20.0)]) + """
SELECT z2.vec_id, 'ffn' AS model, CAST(e.label >= 5 AS INTEGER) AS target,
       round(1.0 / (1.0 + exp(-(z2.x - 0.1))), 6) AS score
FROM z2 JOIN embeddings e USING (vec_id)"""


def normed(name: str, src: str) -> str:
    return (f"{name} AS (SELECT s.vec_id, i, (x - mu) / sqrt(v + 1e-5) AS x FROM {src} s JOIN "
            f"(SELECT vec_id, avg(x) AS mu, var_pop(x) AS v FROM {src} GROUP BY vec_id) USING (vec_id))")


SQL["frozen_features"] = "WITH " + U + ",\n" + ",\n".join([
    normed("a", "u"), layer("v", "a", 64, 64, 7, 3, 40.0), layer("o", "v", 64, 64, 5, 2, 40.0),
    "h AS (SELECT u.vec_id, u.i, u.x + o.x + 0.1 AS x FROM u JOIN o USING (vec_id, i))",
    normed("f", "h"), layer("p", "f", 64, 16, 3, 4, 40.0),
    "g AS (SELECT vec_id, i, 0.5 * x * (2.0 - 2.0 / (exp(2.0 * (0.7978845608028654 * (x + 0.044715 * x * x * x))) + 1.0)) AS x FROM p)",
    layer("q", "g", 16, 64, 2, 9, 40.0)]) + """
SELECT h.vec_id, CAST(h.i AS INTEGER) AS pos, round(CAST(CAST(h.x + q.x AS FLOAT) AS DOUBLE), 4) + 0.0 AS value
FROM h JOIN q USING (vec_id, i)"""

SQL["assembled"] = "WITH " + LI + """
SELECT l_orderkey, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 2) AS value FROM (
""" + "\nUNION ALL ".join(f"SELECT l_orderkey, {k} AS pos, {c} AS v FROM li" for k, c in enumerate(LI_FEATS)) + ")"

SQL["comparison_display"] = "WITH c AS (" + SQL["model_comparison"] + """)
SELECT model, """ + ", ".join(f"printf('%.4f', {c}) AS {c}" for c in ("accuracy", "auc", "precision", "recall", "f1", "training_time")) + """,
       format('{:,}', parameters) AS parameters FROM c"""

SQL["csv_sink"] = SQL["model_comparison"]

SQL["report_sink"] = "SELECT r.*, run_id FROM (" + SQL["metric_bars"] + ") r, (VALUES ('a'), ('b')) t(run_id)"


# --- the same results by other operators ---------------------------------------------------------------
SQL["wide_profile"] = SQL["group_profile"]
SQL["interpolated_long"] = SQL["interpolated"]
SQL["lag_features_long"] = SQL["lag_features"]

SQL["permutation_importance"] = """WITH o AS (
  SELECT o_orderkey AS key, CAST(o_orderstatus = 'F' AS INTEGER) AS label, o_totalprice,
         CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) AS priority FROM orders),
takers AS (SELECT *, row_number() OVER (ORDER BY md5('take:42:' || key), key) AS place FROM o),
givers AS (SELECT o_totalprice AS given_price, priority AS given_priority,
                  row_number() OVER (ORDER BY md5('give:42:' || key), key) AS place FROM o),
j AS (SELECT * FROM takers JOIN givers USING (place)),
variants AS (
  SELECT key, label, '-1' AS model, o_totalprice AS t, priority AS r FROM j
  UNION ALL SELECT key, label, '0', given_price, priority FROM j
  UNION ALL SELECT key, label, '1', o_totalprice, given_priority FROM j
  UNION ALL SELECT key, label, '2', o_totalprice, priority FROM j),
scored AS (SELECT key, model, label,
                  round(1.0 / (1.0 + exp(-((t - 150000.0) / 100000.0 + (r - 3.0) * 0.2))), 4) AS score FROM variants)
""" + COUNTS + """
SELECT feature, round(w.auc, 6) AS auc, round(a.auc, 6) AS auc_permuted, round(w.auc - a.auc, 6) AS importance
FROM (VALUES ('0', 'o_totalprice'), ('1', 'priority'), ('2', 'month')) f(model, feature)
JOIN aucs a USING (model), (SELECT auc FROM aucs WHERE model = '-1') w"""

SQL["source_asof"] = """WITH b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL),
e AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'error' GROUP BY ALL),
m AS (SELECT b.event_id, b.user_id, c.ts + INTERVAL 1 DAY >= b.ts AS c_fresh, c.ts AS c_ts, c.value AS c_value,
             e.ts + INTERVAL 1 DAY >= b.ts AS e_fresh, e.ts AS e_ts, e.value AS e_value
      FROM b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.ts >= c.ts
             ASOF LEFT JOIN e ON b.user_id = e.user_id AND b.ts >= e.ts)
SELECT event_id, user_id,
       CASE WHEN c_fresh THEN CAST(date_diff('day', DATE '2024-01-01', CAST(c_ts AS DATE)) AS INTEGER) END AS click_day,
       CASE WHEN c_fresh THEN round(c_value, 6) END AS click_value,
       CASE WHEN e_fresh THEN CAST(date_diff('day', DATE '2024-01-01', CAST(e_ts AS DATE)) AS INTEGER) END AS error_day,
       CASE WHEN e_fresh THEN round(e_value, 6) END AS error_value
FROM m"""

SQL["batch_score_saved"] = SQL["batch_score"]
SQL["frozen_features_saved"] = SQL["frozen_features"]
