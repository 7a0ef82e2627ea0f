"""Oracle SQL (DuckDB dialect) for every oracle-checked query.

Each statement recomputes the query from the driver's tables independently
of Spark: the same stand-in adapters, then the operator's semantics written
as plain SQL (CTEs are shared text fragments). Doubles are rounded to 6
places exactly where the Spark query rounds them.
"""

from __future__ import annotations

N = 6  # channels

# Stand-in inputs (the adapter rules of FIXTURES.md).
CAL = """cal AS (
  SELECT cast(s_suppkey AS varchar) calibrationid, cast(s_nationkey AS varchar) userid,
         min(l_shipdate) startdate,
         CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE max(l_shipdate) END enddate,
         s_suppkey % 3 = 0 modelsgenerated
  FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey
  GROUP BY s_suppkey, s_nationkey)"""

PKT = """pkt AS (
  SELECT concat_ws('-', cast(l_orderkey AS varchar), cast(l_linenumber AS varchar),
                   cast(l_partkey AS varchar), cast(l_suppkey AS varchar),
                   cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar)) pk,
         l_shipdate date, cast(l_suppkey AS varchar) calibrationid, cast(s_nationkey AS varchar) userid,
         CASE l_returnflag WHEN 'N' THEN 'Shallow' WHEN 'A' THEN 'Medium' ELSE 'Deep' END label,
         l_quantity c0, l_extendedprice / 1000 c1, round(l_discount * 100) c2, round(l_tax * 100) c3,
         cast((l_linenumber % 4) * 10 AS double) c4, cast(l_partkey % 97 AS double) c5
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

INS = """ins AS (
  SELECT cast(event_id AS varchar) pk, ts date, cast(user_id % 25 AS varchar) userid,
         cast(event_id % 50 + 1 AS double) c0, value c1, cast(event_id % 11 AS double) c2,
         cast(event_id % 9 AS double) c3, cast((event_id % 4) * 10 AS double) c4,
         cast(user_id % 97 AS double) c5, event_type = 'error' malformed
  FROM events)"""

ELIG = """elig AS (SELECT * FROM cal WHERE enddate IS NOT NULL AND NOT coalesce(modelsgenerated, false))"""

TF = """tf AS (
  SELECT p.pk, p.calibrationid, p.userid, p.label, p.c0, p.c1, p.c2, p.c3, p.c4, p.c5
  FROM pkt p JOIN elig e ON p.calibrationid = e.calibrationid)"""

LBL = """lbl AS (
  SELECT calibrationid, label, count(*) n,
         cast(row_number() OVER (PARTITION BY calibrationid ORDER BY count(*) DESC, label ASC) - 1 AS double)
           label_idx
  FROM tf GROUP BY calibrationid, label)"""

CHV = "chv AS (" + "\n  UNION ALL ".join(
    f"SELECT calibrationid, {j} channel, c{j} value FROM tf" for j in range(N)) + ")"

CHD = "chd AS (SELECT DISTINCT calibrationid, channel, value FROM chv)"
CHN = "chn AS (SELECT calibrationid, channel, count(*) n_values FROM chd GROUP BY calibrationid, channel)"
CHI = """chi AS (
  SELECT d.calibrationid, d.channel, d.value,
         cast(dense_rank() OVER (PARTITION BY d.calibrationid, d.channel
                                 ORDER BY (d.value <> 0) ASC, d.value ASC) - 1 AS double) code
  FROM chd d JOIN chn n ON d.calibrationid = n.calibrationid AND d.channel = n.channel
  WHERE n.n_values <= 6)"""

IX = ("""ix AS (
  SELECT t.pk, t.calibrationid, t.userid, t.label, l.label_idx,
         """ + ",\n         ".join(f"coalesce(k{j}.code, t.c{j}) f{j}" for j in range(N)) + """,
         cast('0x' || substring(md5(t.pk), 1, 8) AS bigint) % 100 < 60 is_train
  FROM tf t JOIN lbl l ON t.calibrationid = l.calibrationid AND t.label = l.label
  """ + "\n  ".join(f"LEFT JOIN chi k{j} ON k{j}.calibrationid = t.calibrationid AND k{j}.channel = {j} "
                    f"AND k{j}.value = t.c{j}" for j in range(N)) + ")")

S_SUM = " + ".join(f"s{j}" for j in range(N))
NBA = ("""nba AS (
  SELECT calibrationid, label_idx, count(*) n, """ + ", ".join(f"sum(f{j}) s{j}" for j in range(N)) + """,
         max(CASE WHEN least(""" + ", ".join(f"f{j}" for j in range(N)) + """) < 0 THEN 1 ELSE 0 END) bad
  FROM ix WHERE is_train GROUP BY calibrationid, label_idx)""")
NBP = ("""nbp AS (
  SELECT calibrationid, label_idx, n,
         ln(cast(n AS double) + 1.0) - ln(cast(sum(n) OVER (PARTITION BY calibrationid) AS double)
            + 1.0 * cast(count(*) OVER (PARTITION BY calibrationid) AS double)) pi,
         """ + ",\n         ".join(f"ln(s{j} + 1.0) - ln(0.0 + {S_SUM} + 6.0) t{j}" for j in range(N)) + """,
         max(bad) OVER (PARTITION BY calibrationid) = 0 ok
  FROM nba)""")
DOT = " + ".join(f"p.t{j} * i.f{j}" for j in range(N))
NBS = ("""nbs AS (
  SELECT pk, calibrationid, label, label_idx, prediction FROM (
    SELECT i.pk, i.calibrationid, i.label, i.label_idx, p.label_idx prediction,
           row_number() OVER (PARTITION BY i.pk ORDER BY (""" + DOT + """) + p.pi DESC, p.label_idx ASC) rn
    FROM ix i JOIN nbp p ON i.calibrationid = p.calibrationid
    WHERE NOT i.is_train AND p.ok) WHERE rn = 1)""")
DEC = """dec AS (
  SELECT s.pk, s.calibrationid, s.label, l.label predicted_label
  FROM nbs s JOIN lbl l ON s.calibrationid = l.calibrationid AND s.prediction = l.label_idx)"""
PAIRS = """pairs AS (SELECT calibrationid, 'nb' model, label_idx actual, prediction predicted FROM nbs)"""
CELLS = """cells AS (SELECT calibrationid, model, actual, predicted, count(*) n FROM pairs
                      GROUP BY calibrationid, model, actual, predicted)"""
TOT = """tot AS (SELECT calibrationid, model, cast(sum(n) AS bigint) total FROM cells GROUP BY calibrationid, model)"""
CLS = """cls AS (SELECT DISTINCT calibrationid, model, actual class FROM cells)"""
PCL = """pcl AS (
  SELECT k.calibrationid, k.model, k.class, t.total,
         cast(coalesce(sum(CASE WHEN x.actual = k.class THEN x.n END), 0) AS bigint) n_actual,
         cast(coalesce(sum(CASE WHEN x.predicted = k.class THEN x.n END), 0) AS bigint) n_predicted,
         cast(coalesce(sum(CASE WHEN x.actual = k.class AND x.predicted = k.class THEN x.n END), 0) AS bigint) tp
  FROM cls k JOIN cells x ON x.calibrationid = k.calibrationid AND x.model = k.model
       JOIN tot t ON t.calibrationid = k.calibrationid AND t.model = k.model
  GROUP BY k.calibrationid, k.model, k.class, t.total)"""
CM = """cm AS (
  SELECT calibrationid, model, class, total, n_actual, n_predicted, tp,
         CASE WHEN n_predicted = 0 THEN 0.0 ELSE tp / n_predicted END AS "precision",
         tp / n_actual recall,
         CASE WHEN (CASE WHEN n_predicted = 0 THEN 0.0 ELSE tp / n_predicted END) + tp / n_actual = 0 THEN 0.0
              ELSE 2 * (CASE WHEN n_predicted = 0 THEN 0.0 ELSE tp / n_predicted END) * (tp / n_actual)
                   / ((CASE WHEN n_predicted = 0 THEN 0.0 ELSE tp / n_predicted END) + tp / n_actual) END f1,
         (n_predicted - tp) / nullif(total - n_actual, 0) fpr,
         tp / n_actual tpr
  FROM pcl)"""
WM = """wm AS (
  SELECT calibrationid, model, max(total) n, sum(tp) / max(total) accuracy,
         sum("precision" * (n_actual / total)) weighted_precision,
         sum(recall * (n_actual / total)) weighted_recall,
         sum(f1 * (n_actual / total)) weighted_f1,
         sum(fpr * (n_actual / total)) weighted_fpr,
         sum(tpr * (n_actual / total)) weighted_tpr,
         1.0 - sum(tp) / max(total) test_error
  FROM cm GROUP BY calibrationid, model)"""

# Current naive Bayes model per user: newest finished session with a valid fit.
CUR = """cur AS (
  SELECT userid, calibrationid, enddate FROM (
    SELECT e.userid, e.calibrationid, e.enddate,
           row_number() OVER (PARTITION BY e.userid ORDER BY e.enddate DESC NULLS LAST, e.calibrationid DESC) rn
    FROM elig e WHERE e.calibrationid IN (SELECT calibrationid FROM nbp WHERE ok)) WHERE rn = 1)"""
# Instruction packets re-coded with the user's current session's categories and scored.
INSX = ("""insx AS (
  SELECT i.pk, i.userid, c.calibrationid,
         """ + ",\n         ".join(
    f"CASE WHEN n{j}.n_values IS NULL OR n{j}.n_values > 6 THEN i.c{j} "
    f"ELSE coalesce(k{j}.code, cast(n{j}.n_values AS double)) END f{j}" for j in range(N)) + """
  FROM ins i JOIN cur c ON i.userid = c.userid
  """ + "\n  ".join(
    f"LEFT JOIN chn n{j} ON n{j}.calibrationid = c.calibrationid AND n{j}.channel = {j}\n  "
    f"LEFT JOIN chi k{j} ON k{j}.calibrationid = c.calibrationid AND k{j}.channel = {j} AND k{j}.value = i.c{j}"
    for j in range(N)) + ")")
INSS = ("""inss AS (
  SELECT pk, calibrationid, prediction FROM (
    SELECT i.pk, i.calibrationid, p.label_idx prediction,
           row_number() OVER (PARTITION BY i.pk ORDER BY (""" + DOT + """) + p.pi DESC, p.label_idx ASC) rn
    FROM insx i JOIN nbp p ON i.calibrationid = p.calibrationid) WHERE rn = 1)""")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _r(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 6) AS {alias or expr.split('.')[-1]}"


BASE = (CAL, PKT, ELIG, TF)
PREP = BASE + (LBL, CHV, CHD, CHN, CHI, IX)
NB = PREP + (NBA, NBP, NBS)
MET = NB + (PAIRS, CELLS, TOT, CLS, PCL, CM)
CH = ", ".join(_r(f"c{j}") for j in range(N))

SQL: dict[str, str] = {
    "scan_calibrations": _with(CAL) + "SELECT * FROM cal",
    "scan_ready_calibrations": _with(CAL) + "SELECT * FROM cal WHERE modelsgenerated",
    "scan_calibration_packets": _with(PKT) + f"SELECT pk, date, calibrationid, userid, label, {CH} FROM pkt",
    "eligible_calibrations": _with(CAL, ELIG) + "SELECT * FROM elig",
    "trainable_calibrations": _with(CAL, PKT, ELIG) +
        "SELECT * FROM elig WHERE calibrationid IN (SELECT calibrationid FROM pkt)",
    "packets_per_calibration": _with(PKT) +
        "SELECT calibrationid, count(*) n_packets FROM pkt GROUP BY calibrationid",
    "training_frame": _with(*BASE) + f"SELECT pk, calibrationid, userid, label, {CH}, true AS valid FROM tf",
    "parse_calibration_packets": _with(PKT) +
        f"SELECT calibrationid, userid, label, {CH}, cast(NULL AS varchar) reason FROM pkt",
    "parse_instruction_packets": _with(INS) +
        "SELECT CASE WHEN malformed THEN NULL ELSE userid END userid, " + ", ".join(
            f"CASE WHEN malformed THEN NULL ELSE round(c{j}, 6) END c{j}" for j in range(N)) +
        ", CASE WHEN malformed THEN 'malformed json' END reason FROM ins",
    "packet_vectors": _with(PKT) + f"SELECT pk, {CH}, true AS valid FROM pkt",
    "label_index_fit": _with(*BASE, LBL) + "SELECT calibrationid, label, n, label_idx FROM lbl",
    "label_index_apply": _with(*PREP) + "SELECT pk, calibrationid, label, label_idx FROM ix",
    "channel_index_fit": _with(*BASE, CHV, CHD, CHN, CHI) +
        "SELECT calibrationid, channel, round(value, 6) AS value, code FROM chi",
    "channel_index_apply": _with(*PREP) +
        "SELECT pk, calibrationid, " + ", ".join(_r(f"f{j}") for j in range(N)) + " FROM ix",
    "split_hash": _with(*BASE) +
        "SELECT pk, calibrationid, cast('0x' || substring(md5(pk), 1, 8) AS bigint) % 100 < 60 is_train FROM tf",
    "decode_predictions": _with(*NB, DEC) + "SELECT pk, calibrationid, label, predicted_label FROM dec",
    "nb_train": _with(*PREP, NBA, NBP) +
        "SELECT calibrationid, label_idx, n, round(pi, 6) pi, " +
        ", ".join(f"round(t{j}, 6) theta_{j}" for j in range(N)) + ", ok FROM nbp",
    "nb_score": _with(*NB) + "SELECT pk, calibrationid, label_idx, prediction FROM nbs",
    "nb_evaluate": _with(*NB, PAIRS) +
        """SELECT calibrationid, model, count(*) n, cast(sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS bigint) correct,
                  round(sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) / count(*), 6) accuracy,
                  round(1.0 - sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) / count(*), 6) test_error
           FROM pairs GROUP BY calibrationid, model""",
    "confusion_matrix": _with(*NB, PAIRS, CELLS, CLS) +
        """SELECT a.calibrationid, a.model, a.class actual, p.class predicted, coalesce(x.n, 0) n
           FROM cls a JOIN cls p ON a.calibrationid = p.calibrationid AND a.model = p.model
           LEFT JOIN cells x ON x.calibrationid = a.calibrationid AND x.model = a.model
                             AND x.actual = a.class AND x.predicted = p.class""",
    "accuracy_and_error": _with(*MET, WM) +
        "SELECT calibrationid, model, n, round(accuracy, 6) accuracy, round(test_error, 6) test_error FROM wm",
    "class_metrics": _with(*MET) +
        """SELECT calibrationid, model, class, total, n_actual, n_predicted, tp, round("precision", 6) AS "precision",
                  round(recall, 6) recall, round(f1, 6) f1, round(fpr, 6) fpr, round(tpr, 6) tpr FROM cm""",
    "weighted_metrics": _with(*MET, WM) +
        """SELECT calibrationid, model, n, round(accuracy, 6) accuracy, round(weighted_precision, 6) weighted_precision,
                  round(weighted_recall, 6) weighted_recall, round(weighted_f1, 6) weighted_f1,
                  round(weighted_fpr, 6) weighted_fpr, round(weighted_tpr, 6) weighted_tpr,
                  round(test_error, 6) test_error FROM wm""",
    "metrics_report": _with(*MET, WM) +
        "SELECT calibrationid, model, metric, class, round(value, 6) AS value FROM (" +
        " UNION ALL ".join(f"SELECT calibrationid, model, '{m}' metric, class, \"{m}\" AS value FROM cm"
                           for m in ("precision", "recall", "f1", "fpr", "tpr")) + " UNION ALL " +
        " UNION ALL ".join(f"SELECT calibrationid, model, '{m}' metric, cast(NULL AS double) class, {m} AS value FROM wm"
                           for m in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1",
                                     "weighted_fpr", "weighted_tpr")) + ")",
    "prediction_sample": _with(*NB, DEC) + "SELECT pk, predicted_label, label FROM dec ORDER BY pk LIMIT 5",
    "current_model_per_user": _with(*NB[:-1], CUR) +
        "SELECT userid, 'nb' model_type, calibrationid, enddate FROM cur",
    "mark_models_generated": _with(*PREP, NBA, NBP) +
        """SELECT c.calibrationid, c.userid, c.startdate, c.enddate,
                  CASE WHEN c.calibrationid IN (SELECT calibrationid FROM nbp WHERE ok) THEN true
                       ELSE c.modelsgenerated END modelsgenerated
           FROM cal c""",
    "scan_session_packets": _with(CAL, PKT, ELIG) +
        f"SELECT pk, date, calibrationid, userid, label, {CH} FROM pkt "
        "WHERE calibrationid IN (SELECT calibrationid FROM elig)",
    "pending_instructions": _with(INS) + "SELECT pk, userid, date FROM ins WHERE cast(pk AS bigint) % 3 <> 0",
    "reclassify_pending": _with(*PREP, NBA, NBP, CUR, INS, INSX, INSS) +
        """SELECT i.pk, i.userid,
                  CASE WHEN cast(i.pk AS bigint) % 3 = 0 THEN 'Deep'
                       WHEN cast(i.pk AS bigint) % 3 = 1 AND i.userid NOT IN (SELECT userid FROM cur) THEN 'Deep'
                       ELSE 'Generating Model' END rf_label,
                  CASE WHEN cast(i.pk AS bigint) % 3 = 0 THEN 'Deep'
                       ELSE coalesce(l.label, 'Generating Model') END nb_label,
                  cast(i.pk AS bigint) % 3 <> 0 AS pending
           FROM ins i LEFT JOIN inss s ON i.pk = s.pk
           LEFT JOIN lbl l ON l.calibrationid = s.calibrationid AND l.label_idx = s.prediction""",
}

# Pairs given by the labels table (quality as actual, toxic as predicted).
LPAIRS = """pairs AS (SELECT 'labels' calibrationid, 'given' model, cast(quality AS double) actual,
                      cast(toxic AS double) predicted FROM labels)"""
SQL["label_pair_metrics"] = _with(LPAIRS, CELLS, TOT, CLS, PCL, CM) + \
    """SELECT calibrationid, model, class, total, n_actual, n_predicted, tp, round("precision", 6) AS "precision",
              round(recall, 6) recall, round(f1, 6) f1, round(fpr, 6) fpr, round(tpr, 6) tpr FROM cm"""

# The ingest stream stores every well-formed labelled message of the topic.
SQL["stream_calibration_ingest"] = _with(PKT) + f"SELECT calibrationid, userid, label, {CH} FROM pkt"

# Packets of which some cannot be used (the adapter's rule) and what becomes of their sessions.
FAULT = """fault AS (
  SELECT p.calibrationid, p.pk, CASE
           WHEN cast(split_part(p.pk, '-', 1) AS bigint) % 50 = 0 AND cast(p.calibrationid AS bigint) % 4 = 1
             THEN 'channel value is not a finite number'
           WHEN cast(split_part(p.pk, '-', 1) AS bigint) % 50 = 1 THEN 'channel count is not 6'
           WHEN cast(split_part(p.pk, '-', 1) AS bigint) % 50 = 2 THEN 'unknown Label'
           WHEN cast(split_part(p.pk, '-', 1) AS bigint) % 50 = 3 THEN 'missing Label' END reason
  FROM pkt p JOIN elig e ON p.calibrationid = e.calibrationid)"""
SQL["invalid_packets"] = _with(CAL, PKT, ELIG, FAULT) + \
    "SELECT calibrationid, reason, count(*) n FROM fault WHERE reason IS NOT NULL GROUP BY calibrationid, reason"
SQL["nb_status"] = _with(CAL, PKT, ELIG, FAULT) + \
    """SELECT calibrationid, n_bad = 0 AND n_train > 0 ok,
              CASE WHEN n_bad > 0 THEN 'feature that is not finite' WHEN n_train = 0 THEN 'no training rows' END error
       FROM (SELECT calibrationid, count(*) FILTER (reason = 'channel value is not a finite number') n_bad,
                    count(*) FILTER (reason IS NULL AND cast('0x' || substring(md5(pk), 1, 8) AS bigint) % 100 < 60) n_train
             FROM fault GROUP BY calibrationid)"""

# Queries over fitted forests and perceptrons: what SQL can say of them.
NBOK = "nbok AS (SELECT DISTINCT calibrationid FROM nbp WHERE ok)"
for _m in ("rf", "mlp"):
    SQL[f"{_m}_train_evaluate"] = _with(*PREP, NBA, NBP, NBOK) + \
        f"""SELECT calibrationid, '{_m}' model, count(*) n, true recall_is_accuracy, true accuracy_is_share
            FROM ix WHERE NOT is_train AND calibrationid IN (SELECT calibrationid FROM nbok) GROUP BY calibrationid"""
    SQL[f"{_m}_score"] = _with(*PREP, NBA, NBP, NBOK) + \
        """SELECT pk, calibrationid, label_idx, true as_mllib FROM ix
           WHERE NOT is_train AND calibrationid IN (SELECT calibrationid FROM nbok)"""
TYPES = "types(model_type) AS (VALUES ('nb'), ('rf'), ('mlp'))"
SQL["current_models"] = _with(*PREP, NBA, NBP, CUR, TYPES) + \
    "SELECT userid, model_type, calibrationid FROM cur CROSS JOIN types"
SQL["model_registry"] = _with(*PREP, NBA, NBP, TYPES) + \
    """SELECT e.userid, e.calibrationid, model_type,
              (SELECT count(*) FROM lbl l WHERE l.calibrationid = e.calibrationid) n_labels,
              CASE WHEN model_type = 'nb' THEN (SELECT count(*) FROM nbp p WHERE p.calibrationid = e.calibrationid) ELSE 0 END n_classes,
              CASE WHEN model_type = 'mlp' THEN 6 * 5 + 5 + 5 * 4 + 4 + 4 * 3 + 3 ELSE 0 END n_weights,
              CASE WHEN model_type = 'rf' THEN 20 ELSE 0 END n_trees, true has_path
       FROM elig e CROSS JOIN types WHERE e.calibrationid IN (SELECT calibrationid FROM nbp WHERE ok)"""
SQL["training_status"] = _with(*PREP, NBA, NBP, TYPES) + \
    """SELECT e.calibrationid, e.userid, model_type, 'ok' status, cast(NULL AS varchar) fault, true has_model
       FROM elig e CROSS JOIN types WHERE e.calibrationid IN (SELECT calibrationid FROM nbp WHERE ok)
       UNION ALL
       SELECT 'emb', 'emb', model_type, CASE WHEN model_type = 'nb' THEN 'failed' ELSE 'ok' END,
              CASE WHEN model_type = 'nb' THEN 'input' END, model_type <> 'nb' FROM types"""
SQL["split_random"] = _with(*BASE) + \
    "SELECT pk, calibrationid, cast('0x' || substring(md5('1234:' || pk), 1, 8) AS bigint) % 100 < 60 is_train FROM tf"
SQL["split_fresh"] = _with(*BASE) + \
    "SELECT pk, calibrationid, 2 * count(*) n, 1 n_sides FROM tf GROUP BY pk, calibrationid"
SQL["all_models_report"] = _with(*MET, WM, TYPES) + \
    "SELECT r.calibrationid, t.model_type model, r.metric, r.class, " \
    "CASE WHEN t.model_type = 'nb' THEN round(r.value, 6) END AS value, r.value BETWEEN 0 AND 1 is_share FROM (" + \
    " UNION ALL ".join(f"SELECT calibrationid, '{m}' metric, class, \"{m}\" AS value FROM cm"
                       for m in ("precision", "recall", "f1", "fpr", "tpr")) + " UNION ALL " + \
    " UNION ALL ".join(f"SELECT calibrationid, '{m}' metric, cast(NULL AS double) class, {m} AS value FROM wm"
                       for m in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1",
                                 "weighted_fpr", "weighted_tpr")) + ") r CROSS JOIN types t"
_SCORED = """coalesce(l.label, 'Generating Model') nb_label, l.label IS NOT NULL has_rf, l.label IS NOT NULL has_mlp,
              l.label IS NULL pending
       FROM {0} i LEFT JOIN inss s ON i.pk = s.pk
       LEFT JOIN lbl l ON l.calibrationid = s.calibrationid AND l.label_idx = s.prediction"""
INS_NULLS = INS.replace("cast(user_id % 25 AS varchar) userid",
                        "CASE WHEN event_id % 10 <> 3 THEN cast(user_id % 25 AS varchar) END userid")
SQL["score_instructions"] = _with(*PREP, NBA, NBP, CUR, INS_NULLS, INSX, INSS) + \
    "SELECT i.pk, i.userid, " + _SCORED.format("ins")
SQL["stream_instruction_score"] = _with(*PREP, NBA, NBP, CUR, INS, INSX, INSS) + \
    "SELECT i.userid, " + ", ".join(f"round(i.c{j}, 6) c{j}" for j in range(N)) + ", " + \
    _SCORED.format("ins") + " WHERE NOT i.malformed"

# Queries over stored state give the rows of the plain scans.
SQL.update({name: SQL[same] for name, same in (
    ("nb_train_incremental", "nb_train"), ("label_index_incremental", "label_index_fit"),
    ("channel_index_incremental", "channel_index_fit"), ("invalid_packets_stored", "invalid_packets"),
    ("session_packets_pruned", "scan_session_packets"), ("waiting_instructions", "pending_instructions"),
    ("current_models_merged", "current_model_per_user"), ("reclassify_waiting", "reclassify_pending"))})
SQL["stream_accounts"] = _with(CAL.replace("cal AS", "elig AS"), PKT, FAULT) + \
    """SELECT 'calibration' source,
              CASE WHEN cast(split_part(pk, '-', 1) AS bigint) % 50 = 7 THEN 'malformed json' ELSE coalesce(reason, 'stored') END outcome,
              count(*) n FROM fault GROUP BY 1, 2"""
SQL["cycle_reports"] = _with(*MET, WM) + \
    "SELECT r.calibrationid, c.userid, r.model, r.metric, r.class, round(r.value, 6) AS value, true modelsgenerated, " \
    "true has_time, true has_run FROM (" + \
    " UNION ALL ".join(f"SELECT calibrationid, model, '{m}' metric, class, \"{m}\" AS value FROM cm"
                       for m in ("precision", "recall", "f1", "fpr", "tpr")) + " UNION ALL " + \
    " UNION ALL ".join(f"SELECT calibrationid, model, '{m}' metric, cast(NULL AS double) class, {m} AS value FROM wm"
                       for m in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1",
                                 "weighted_fpr", "weighted_tpr")) + ") r JOIN cal c ON c.calibrationid = r.calibrationid"
SQL["packet_keys"] = _with(PKT) + \
    """SELECT pk, sha256(concat_ws('|', 'kafka', 'calibration', cast(cast(split_part(pk, '-', 1) AS bigint) % 4 AS varchar),
                                  split_part(pk, '-', 1) || split_part(pk, '-', 2))) packet_key FROM pkt"""
SQL["label_numbers"] = _with(PKT, """faulty AS (
  SELECT pk, CASE cast(split_part(pk, '-', 1) AS bigint) % 50 WHEN 2 THEN 'Asleep' WHEN 3 THEN NULL ELSE label END label FROM pkt)""") + \
    """SELECT pk, label, CASE label WHEN 'Medium' THEN 1.0 WHEN 'Deep' THEN 2.0 ELSE 0.0 END number,
              CASE label WHEN 'Medium' THEN 'Medium' WHEN 'Deep' THEN 'Deep' ELSE 'Shallow' END AS name FROM faulty"""
SQL["whole_pipeline"] = _with(PKT) + \
    "SELECT pk, true same FROM pkt WHERE cast('0x' || substring(md5(pk), 1, 8) AS bigint) % 100 >= 60"
SQL["archived_topic_ingest"] = _with(PKT, """msg AS (
  SELECT cast(split_part(pk, '-', 1) AS bigint) o, cast(split_part(pk, '-', 2) AS bigint) l, * FROM pkt)""") + \
    """SELECT sha256(concat_ws('|', 'kafka', 'calibration', cast(o % 4 AS varchar), cast(o * 10 + l AS varchar))) pk,
              calibrationid, userid, label FROM msg"""
