"""The named queries in SQL over the same tables, written without the clean-up that Spark runs."""

from __future__ import annotations

import re

# -- sheets as common table expressions: k dispatcher, wb waybill, ts date ----------------------

CTE: dict[str, str] = {
    "dispatch": """SELECT CAST(l_suppkey AS VARCHAR) k, l_orderkey || '-' || l_linenumber wb, l_shipdate ts,
                          l_quantity * 0.8 w, 'Rider ' || l_suppkey nm FROM lineitem""",
    "ret": """SELECT CAST(CASE WHEN l_linestatus = 'O' THEN l_suppkey + 1 ELSE l_suppkey END AS VARCHAR) k,
                     l_orderkey || '-' || l_linenumber wb, l_shipdate ts FROM lineitem WHERE l_returnflag = 'R'""",
    "pickup": """SELECT CASE WHEN o_totalprice >= 400000 THEN '9000' ELSE CAST(o_custkey // 15 AS VARCHAR) END k,
                        CASE WHEN o_totalprice >= 400000 THEN 'PEN9000' ELSE CAST(o_custkey // 15 AS VARCHAR) END id,
                        o_orderkey || '-3' wb, o_orderdate ts,
                        CASE WHEN o_orderpriority = '1-URGENT' THEN 1.80
                             WHEN o_orderpriority = '2-HIGH' AND o_totalprice / 25000 > 10 THEN 3.00
                             WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 1.00 ELSE 0.05 END commission
                 FROM orders WHERE o_orderstatus = 'P'""",
    "bulky": """SELECT CAST(l_suppkey AS VARCHAR) k, l_orderkey || '-' || l_linenumber wb, l_shipdate ts,
                       l_quantity * 1.03 w FROM lineitem WHERE l_quantity >= 48""",
    "net": """SELECT * FROM dispatch d
              WHERE NOT EXISTS (SELECT 1 FROM ret r WHERE r.k = d.k AND r.wb = d.wb)
                AND NOT EXISTS (SELECT 1 FROM pickup p WHERE p.wb = d.wb)
                AND NOT EXISTS (SELECT 1 FROM bulky b WHERE b.k = d.k AND b.wb = d.wb)""",
    "daily": """SELECT k, CAST(ts AS DATE) d, count(*) n
                FROM (SELECT k, ts FROM net UNION ALL SELECT k, ts FROM bulky) GROUP BY 1, 2""",
    "rated": """SELECT *, k IN ('7', '12') dd,
                  CASE WHEN n > 1 AND d BETWEEN DATE '1996-03-01' AND DATE '1996-06-30' THEN 1.15
                       WHEN n > 0 AND d BETWEEN DATE '1996-05-01' AND DATE '1996-05-31' THEN 1.30 END sr,
                  CASE WHEN n > 1 AND d BETWEEN DATE '1996-03-01' AND DATE '1996-06-30' THEN 'Spring Clearance'
                       WHEN n > 0 AND d BETWEEN DATE '1996-05-01' AND DATE '1996-05-31' THEN 'May Clearance' END sd,
                  CASE WHEN n >= 3 THEN 'Tier 1' WHEN n = 2 THEN 'Tier 2' ELSE 'Tier 3' END tier,
                  CASE WHEN n >= 3 THEN 1.10 WHEN n = 2 THEN 1.00 ELSE 0.95 END rate,
                  sum(n) OVER (PARTITION BY k ORDER BY d) running FROM daily""",
    "days": """SELECT k, d, n, dd, sr,
                 CASE WHEN sr IS NULL AND dd THEN greatest(0, running - greatest(running - n, 300)) ELSE 0 END extra,
                 CASE WHEN sr IS NOT NULL THEN sd WHEN dd THEN 'Designated Driver' ELSE tier END tier,
                 CASE WHEN sr IS NOT NULL THEN sr
                      WHEN dd AND running - greatest(running - n, 300) > 0 THEN 1.00 WHEN dd THEN 0.00 ELSE rate END rate,
                 CASE WHEN sr IS NOT NULL THEN n * sr
                      WHEN dd THEN greatest(0, running - greatest(running - n, 300)) * 1.00 ELSE n * rate END pay
               FROM rated""",
    "pay": """SELECT k, CAST(sum(n) AS BIGINT) parcels, count(*) working, count_if(n >= 2) qualified,
                     bool_or(dd) dd, coalesce(sum(CASE WHEN sr IS NOT NULL THEN pay END), 0) special,
                     CAST(round(sum(pay), 2) + CASE WHEN bool_or(dd) THEN 1700 ELSE 0 END AS DECIMAL(18,2)) base,
                     CASE WHEN bool_or(dd) THEN CASE WHEN sum(n) >= 450 THEN 150 WHEN sum(n) >= 350 THEN 100 ELSE 0 END
                          WHEN sum(n) >= 420 THEN 150 WHEN sum(n) >= 380 THEN 100 ELSE 0 END kpi,
                     CASE WHEN bool_or(dd) THEN CASE WHEN sum(n) >= 450 THEN '450 parcels' WHEN sum(n) >= 350 THEN '350 parcels'
                                                     ELSE 'No KPI achieved' END
                          WHEN sum(n) >= 420 THEN '420 parcels' WHEN sum(n) >= 380 THEN '380 parcels'
                          ELSE 'No KPI achieved' END kpi_text,
                     CASE WHEN count_if(n >= 2) >= 20 THEN 100 ELSE 0 END att,
                     CASE WHEN count_if(n >= 2) >= 20 THEN count_if(n >= 2) || '/20 days qualified (≥2 parcels/day)'
                          ELSE count_if(n >= 2) || '/20 days qualified (need ≥2 parcels/day)' END att_text
              FROM days GROUP BY k""",
    # Penalty records: v amount, w waybill, wk week day of the event.
    "ev": """SELECT CAST(user_id AS VARCHAR) k, CAST(value AS DECIMAL(12,2)) v,
                    user_id || '-' || CAST(floor(value) AS BIGINT) wb, event_type t, ts FROM events""",
    "sup": """SELECT CAST(s_suppkey AS VARCHAR) k, CAST(s_acctbal AS DECIMAL(12,2)) v, s_name nm FROM supplier""",
    "recs": """SELECT k, 'duitnow' kind, NULL wb, v, ts FROM ev WHERE t = 'signup' AND v < 50
               UNION ALL SELECT k, 'ldr', wb, v, ts FROM ev WHERE t = 'purchase'
               UNION ALL SELECT k, 'fake_attempt', wb, 2.00, ts FROM ev WHERE t = 'error'
               UNION ALL SELECT k, 'cod', NULL, v - 30, ts FROM ev WHERE t = 'click'
               UNION ALL SELECT k, 'binding', NULL, v - 60, ts FROM ev WHERE t = 'click' AND v > 60
               UNION ALL SELECT k, 'hub', NULL, v * 0.02, NULL FROM sup WHERE v > 0
               UNION ALL SELECT k, 'pending_parcel', wb, v, ts FROM ev WHERE t = 'view'
               UNION ALL SELECT k, 'no_outbound_scan', wb, 0, ts FROM ev WHERE t = 'error' AND v >= 5
               UNION ALL SELECT k, 'parcel_lost', wb, v - 20, ts FROM ev WHERE t = 'purchase'
               UNION ALL SELECT k, 'attendance', NULL, v - 10, ts FROM ev WHERE t = 'signup'""",
    # The statement sums all amounts and rounds once.
    "pen_a": """SELECT k, kind,
                  CAST(round(CASE WHEN kind = 'no_outbound_scan' THEN count(DISTINCT wb) * 3.00 ELSE sum(v) END, 2) AS DECIMAL(18,2)) amount,
                  CASE kind WHEN 'duitnow' THEN CASE WHEN sum(v) > 0 THEN 1 ELSE 0 END
                            WHEN 'pending_parcel' THEN count(DISTINCT wb) WHEN 'no_outbound_scan' THEN count(DISTINCT wb)
                            WHEN 'attendance' THEN count_if(v > 0) ELSE count(*) END parcels
                FROM recs GROUP BY 1, 2""",
    # The fleet takes positive amounts, each rounded.
    "pen_m": """SELECT k, kind,
                  CAST(CASE WHEN kind = 'no_outbound_scan' THEN count(DISTINCT wb) * 3.00 ELSE sum(round(v, 2)) END AS DECIMAL(18,2)) amount,
                  CASE WHEN kind IN ('pending_parcel', 'no_outbound_scan') THEN count(DISTINCT wb) ELSE count(*) END parcels
                FROM recs WHERE kind <> 'attendance' AND (v > 0 OR kind = 'no_outbound_scan') GROUP BY 1, 2""",
    "ids_a": "SELECT DISTINCT k FROM dispatch",
    "ids_m": "SELECT DISTINCT k FROM net",
    "spine": """SELECT k FROM dispatch UNION SELECT k FROM ret UNION SELECT k FROM pickup UNION SELECT k FROM bulky
                UNION SELECT k FROM recs UNION SELECT k FROM sup""",
    "pick_t": "SELECT k, count(*) n, CAST(sum(commission) AS DECIMAL(18,2)) pay FROM pickup GROUP BY k",
    "ret_t": "SELECT k, count(*) n, CAST(count(*) * 0.50 AS DECIMAL(18,2)) pay FROM ret GROUP BY k",
    "bulky_t": """SELECT k, count(*) n, CAST(sum(CASE WHEN w > 50 THEN 5.00 ELSE 4.00 END) AS DECIMAL(18,2)) pay
                  FROM bulky GROUP BY k""",
    "sup_t": """SELECT k, CAST(CASE WHEN v > 0 THEN v ELSE 0 END AS DECIMAL(18,2)) reward, count_if(v > 0) OVER (PARTITION BY k) n,
                       CAST(round(v * 0.1, 2) AS DECIMAL(18,2)) rental,
                       CAST(round(CASE WHEN v > 0 THEN v * 0.01 ELSE 0 END, 2) AS DECIMAL(18,2)) socso,
                       CAST(CASE WHEN v < 0 THEN -v ELSE 0 END AS DECIMAL(18,2)) overpaid FROM sup""",
}

KINDS = (
    "duitnow", "ldr", "fake_attempt", "cod", "binding", "hub", "pending_parcel", "no_outbound_scan",
    "parcel_lost", "route", "attendance",
)


def _share(ids: str) -> str:
    """Pool of 1000.00 in cents; left-over cents to the first ids in text order."""
    return f"""SELECT k, CAST((100000 // n + CASE WHEN pos < 100000 % n THEN 1 ELSE 0 END) / 100.0 AS DECIMAL(18,2)) share
               FROM (SELECT k, row_number() OVER (ORDER BY k) - 1 pos, count(*) OVER () n FROM {ids})"""


def _wide(pen: str, ids: str | None) -> str:
    kinds = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN kind = '{k}' THEN amount END), 0) AS DECIMAL(18,2)) {k}_penalty" for k in KINDS
    )
    route = f" UNION ALL SELECT k, 'route', share, 1 FROM share_{ids} WHERE share > 0" if ids else ""
    return f"""SELECT k, {kinds}, CAST(sum(amount) AS DECIMAL(18,2)) pen, CAST(sum(parcels) AS BIGINT) pen_n
               FROM (SELECT * FROM {pen}{route}) GROUP BY k"""


CTE["share_a"] = _share("ids_a")
CTE["share_m"] = _share("ids_m")
CTE["wide_a"] = _wide("pen_a", "a")
CTE["wide_m"] = _wide("pen_m", None)

_KIND_LIST = ", ".join(f"coalesce({k}_penalty, 0) {k}_penalty" for k in KINDS)

CTE["stmt"] = f"""
    SELECT s.k, coalesce(p.dd, s.k IN ('7', '12')) dd, coalesce(p.parcels, 0) parcels, coalesce(p.working, 0) working,
           coalesce(p.qualified, 0) qualified, coalesce(p.special, 0) special, coalesce(p.base, 0) base,
           coalesce(p.kpi, 0) kpi, coalesce(p.kpi_text, '') kpi_text, coalesce(p.att, 0) att,
           coalesce(p.att_text, 'No delivery records in selected period') att_text,
           coalesce(c.n, 0) pick_n, coalesce(c.pay, 0) pick, coalesce(r.n, 0) ret_n, coalesce(r.pay, 0) ret,
           coalesce(u.n, 0) reward_n, coalesce(u.reward, 0) reward, coalesce(u.socso, 0) socso, coalesce(u.overpaid, 0) overpaid,
           {_KIND_LIST}, coalesce(w.pen, 0) pen, coalesce(w.pen_n, 0) pen_n
    FROM spine s LEFT JOIN pay p USING (k) LEFT JOIN pick_t c USING (k) LEFT JOIN ret_t r USING (k)
         LEFT JOIN sup_t u USING (k) LEFT JOIN wide_a w USING (k)"""
CTE["final"] = """
    SELECT *, parcels + pick_n + ret_n awb, gross - advance final FROM (
      SELECT *, base + pick + ret + reward + kpi + att - pen - socso - overpaid gross,
             CAST(round(base * 0.4, 2) AS DECIMAL(18,2)) advance FROM stmt)"""
CTE["tier"] = """
    SELECT k, min(nm) nm, count(*) n, count_if(w < 5.01) t1, count_if(w >= 5.01 AND w < 10.01) t2,
           count_if(w >= 10.01 AND w <= 30) t3, count_if(w > 30) t4, sum(CAST(w AS DECIMAL(18,6))) wt FROM net GROUP BY k"""
CTE["tier_pay"] = "SELECT *, CAST(t1 * 1.50 + t2 * 1.60 + t3 * 2.70 + t4 * 4.00 AS DECIMAL(18,2)) pay FROM tier"
CTE["fleet"] = f"""
    SELECT *, disp + pick + ret + bulky + reward - pen - rental - socso - overpaid total FROM (
      SELECT s.k, coalesce(t.nm, 'Unknown') nm, coalesce(t.n, 0) n, coalesce(t1, 0) t1, coalesce(t2, 0) t2,
             coalesce(t3, 0) t3, coalesce(t4, 0) t4, coalesce(t.wt, 0) wt, coalesce(t.pay, 0) disp,
             coalesce(c.n, 0) pick_n, coalesce(c.pay, 0) pick, coalesce(r.n, 0) ret_n, coalesce(r.pay, 0) ret,
             coalesce(b.n, 0) bulky_n, coalesce(b.pay, 0) bulky, coalesce(u.reward, 0) reward, coalesce(u.rental, 0) rental,
             coalesce(u.socso, 0) socso, coalesce(u.overpaid, 0) overpaid, {_KIND_LIST},
             coalesce(w.pen, 0) pen, coalesce(w.pen_n, 0) pen_n
      FROM spine s LEFT JOIN tier_pay t USING (k) LEFT JOIN pick_t c USING (k) LEFT JOIN ret_t r USING (k)
           LEFT JOIN bulky_t b USING (k) LEFT JOIN sup_t u USING (k) LEFT JOIN wide_m w USING (k))"""

_KIND_SUMS = ", ".join(f"sum({k}_penalty) {k}_penalty" for k in KINDS)
CTE["tot"] = f"""
    SELECT count(*) dispatchers, sum(n + ret_n + bulky_n) delivered, sum(n + ret_n + bulky_n + pick_n) awb, sum(wt) wt,
           sum(disp) disp, sum(pick_n) pick_n, sum(pick) pick, sum(ret_n) ret_n, sum(ret) ret, sum(bulky_n) bulky_n,
           sum(bulky) bulky, sum(reward) reward, sum(rental) rental, sum(socso) socso, sum(overpaid) overpaid,
           {_KIND_SUMS}, sum(pen) pen, sum(pen_n) pen_n, sum(total) total FROM fleet"""

# Trend fit over (series, ds, y) in "points".
CTE["ev_points"] = "SELECT event_type series, CAST(ts AS DATE) ds, CAST(count(*) AS DOUBLE) y FROM events GROUP BY 1, 2"
CTE["all_points"] = "SELECT 'all' series, CAST(ts AS DATE) ds, CAST(count(*) AS DOUBLE) y FROM dispatch GROUP BY 2"
CTE["pay_points"] = """
    SELECT 'all' series, CAST(ts AS DATE) ds, CAST(CAST(count_if(w < 5.01) * 1.50 + count_if(w >= 5.01 AND w < 10.01) * 1.60
      + count_if(w >= 10.01 AND w <= 30) * 2.70 + count_if(w > 30) * 4.00 AS DECIMAL(18,2)) AS DOUBLE) y FROM dispatch GROUP BY 2"""


def _fit(points: str, name: str) -> dict[str, str]:
    return {
        f"{name}_t": f"""SELECT series, ds, y, date_diff('day', min(ds) OVER (PARTITION BY series), ds) t,
                                isodow(ds) - 1 wd FROM {points}""",
        f"{name}_line": f"""SELECT series, regr_slope(y, t) b, avg(y) - regr_slope(y, t) * avg(t) a, min(ds) first,
                                   max(ds) last, count(*) n FROM {name}_t GROUP BY series HAVING count(*) >= 7""",
        f"{name}_res": f"SELECT series, wd, y - (a + b * t) r FROM {name}_t JOIN {name}_line USING (series)",
        f"{name}_seas": f"SELECT series, wd, avg(r) s FROM {name}_res GROUP BY 1, 2",
        f"{name}_sd": f"SELECT series, stddev_samp(r - s) sd FROM {name}_res JOIN {name}_seas USING (series, wd) GROUP BY 1",
    }


def _ahead(name: str, days: int) -> str:
    return f"""SELECT series, ds, a + b * date_diff('day', first, ds) + coalesce(s, 0) yhat, sd
               FROM (SELECT *, CAST(last + CAST(g AS INTEGER) AS DATE) ds FROM {name}_line, range(1, {days + 1}) x(g))
               JOIN {name}_sd USING (series)
               LEFT JOIN (SELECT series, wd, s FROM {name}_seas) z USING (series)
               WHERE z.wd = isodow(ds) - 1"""


for _name, _points, _days in (("evf", "ev_points", 30), ("parf", "all_points", 30), ("payf", "pay_points", 30)):
    CTE.update(_fit(_points, _name))
    CTE[f"{_name}_ahead"] = _ahead(_name, _days)
CTE["evw_ahead"] = _ahead("evf", 7)

Z = "1.2815515655446004"
ORACLE: dict[str, str] = {}


def _needed(sql: str) -> list[str]:
    """CTEs that a text reads, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", text)):
            if word in CTE and word not in order:
                visit(CTE[word])
                order.append(word)

    visit(sql)
    return order


def _sql(name: str, body: str) -> None:
    ctes = ", ".join(f"{c} AS ({CTE[c]})" for c in _needed(body))
    ORACLE[name] = f"WITH {ctes} {body}" if ctes else body


def _d(x: str, alias: str) -> str:
    return f"CAST({x} AS DOUBLE) {alias}"


def _n(x: str, alias: str) -> str:
    return f"CAST({x} AS BIGINT) {alias}"


ROWS = "CAST(count(*) AS BIGINT) rows"
_sql("dispatcher_normalize", f"SELECT k dispatcher_key, 'JMR' || lpad(k, 9, '0') penalty_id, {ROWS} FROM dispatch GROUP BY k")
_sql("route_key", f"""
    SELECT CASE WHEN o_totalprice >= 400000 THEN 'PEN9000' WHEN o_orderpriority = '3-MEDIUM' THEN NULL
                ELSE CAST(o_custkey // 15 AS VARCHAR) END route_key, {ROWS} FROM orders WHERE o_orderstatus = 'P' GROUP BY 1""")
_sql("waybill_normalize", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey AS VARCHAR)
      WHEN o_orderstatus = 'F' THEN CAST(o_orderkey * 100 AS VARCHAR) WHEN o_orderpriority = '5-LOW' THEN NULL
      ELSE 'MYE' || o_orderkey END waybill FROM orders""")
_sql("name_clean", f"SELECT nm dispatcher_name, {ROWS} FROM dispatch GROUP BY nm")
_sql("money_parse", f"""
    SELECT k dispatcher_key, {_d('sum(v)', 'amount')}, {_d('sum(round(v, 2))', 'rounded_amount')}
    FROM (SELECT k, CAST(v AS DECIMAL(18,6)) v FROM ev WHERE t = 'purchase'
          UNION ALL SELECT k, CAST(v * 0.02 AS DECIMAL(18,6)) FROM sup) GROUP BY k""")
_sql("weight_parse", f"SELECT CAST(CAST(w AS DECIMAL(10,2)) AS DOUBLE) weight, {ROWS} FROM bulky GROUP BY 1")
_sql("date_parse", f"SELECT CAST(ts AS DATE) AS day, {ROWS} FROM ev WHERE t = 'signup' GROUP BY 1")
_sql("canonical_dispatch", """
    SELECT k dispatcher_key, 'JMR' || lpad(k, 9, '0') dispatcher_id, nm dispatcher_name, wb waybill,
           CAST(ts AS DATE) AS day, w weight FROM dispatch""")
_sql("database_dispatch", f"""
    SELECT k dispatcher_key, 'Unknown' dispatcher_name, {ROWS}, count(DISTINCT wb) waybills,
           (SELECT CAST(sum(l_quantity) AS DOUBLE) FROM lineitem WHERE CAST(l_suppkey AS VARCHAR) = k) weight
    FROM dispatch GROUP BY k""")
_sql("missing_sheets", "SELECT sheet, rows, rows = 0 is_missing, CASE WHEN sheet = 'hub' THEN 'absent' WHEN rows = 0 THEN 'no rows' END reason FROM (" + " UNION ALL ".join(
    f"SELECT '{s}' sheet, CAST(count(*) AS BIGINT) rows FROM {src}" for s, src in (
        ("pickup", "pickup"), ("return", "ret"), ("bulky", "bulky"), ("reward", "sup"), ("rental", "sup"),
        ("attendance", "ev WHERE t = 'signup'"), ("duitnow", "ev WHERE t = 'signup'"), ("ldr", "ev WHERE t = 'purchase'"),
        ("fake_attempt", "ev WHERE t = 'error'"), ("cod", "ev WHERE t = 'click'"), ("binding", "ev WHERE t = 'click'"),
        ("hub", "sup WHERE false"), ("socso", "sup"), ("overpaid", "sup"), ("pending_parcel", "ev WHERE t = 'view'"),
        ("no_outbound_scan", "ev WHERE t = 'error' AND v >= 5"), ("parcel_lost", "ev WHERE t = 'purchase'"),
    )) + ")")
_sql("copied_sheet_guard", f"""
    SELECT 'copy' sheet, CAST(0 AS BIGINT) rows UNION ALL SELECT 'part', count(*) FROM dispatch WHERE w > 20
    UNION ALL SELECT 'return', count(*) FROM ret""")
_sql("mostly_copied_sheet", f"""
    SELECT CAST(95 AS BIGINT) AS share, CAST(0 AS BIGINT) AS rows UNION ALL SELECT 20, count(*) FROM dispatch""")
_sql("dispatch_in_return_tab", f"""
    SELECT 'dispatch' tab, CAST(0 AS BIGINT) AS rows UNION ALL SELECT 'reason', count(*) FROM dispatch
    UNION ALL SELECT 'return', count(*) FROM ret""")
_sql("sheet_fingerprint", f"SELECT {ROWS}, CAST(1 AS BIGINT) fingerprints FROM pickup")
_sql("default_period", """
    SELECT greatest(CAST(min(ts) AS DATE), CAST(date_trunc('month', max(ts)) AS DATE)) period_start,
           CAST(max(ts) AS DATE) period_end FROM dispatch""")
_sql("default_period_rows", f"""
    SELECT k dispatcher_key, {ROWS} FROM dispatch
    WHERE ts >= (SELECT greatest(min(ts), date_trunc('month', max(ts))) FROM dispatch) GROUP BY k""")
_IN = "ts >= DATE '1996-03-01' AND ts < DATE '1996-10-01'"
_sql("period_filter", f"SELECT k dispatcher_key, {ROWS} FROM dispatch WHERE {_IN} GROUP BY k")
_EV_IN = "ts >= DATE '2024-01-10' AND ts < DATE '2024-01-21'"
_sql("period_filter_all_sheets", " UNION ALL ".join(
    f"SELECT '{s}' sheet, CAST(count(*) AS BIGINT) rows FROM {src}" for s, src in (
        ("dispatch", f"dispatch WHERE {_EV_IN}"), ("duitnow", f"ev WHERE t = 'signup' AND {_EV_IN}"),
        ("ldr", f"ev WHERE t = 'purchase' AND {_EV_IN}"), ("cod", f"ev WHERE t = 'click' AND {_EV_IN}"),
        ("pending_parcel", f"ev WHERE t = 'view' AND {_EV_IN}"),
        ("no_outbound_scan", f"ev WHERE t = 'error' AND v >= 5 AND {_EV_IN}"),
        ("attendance", f"ev WHERE t = 'signup' AND {_EV_IN}"), ("hub", "sup"), ("reward", "sup"),
    )))
CTE["undated"] = "SELECT k, CASE WHEN k IN ('3', '5', '8') OR w > 30 THEN NULL ELSE ts END ts FROM dispatch"
CTE["presence"] = f"""SELECT k, coalesce(count_if({_IN}), 0) inside, count_if(ts IS NULL) undated_rows, count(*) all_rows FROM undated GROUP BY k"""
_sql("null_date_retention", f"""
    SELECT k dispatcher_key, {ROWS}, CAST(count_if(ts IS NULL) AS BIGINT) undated
    FROM (SELECT k, ts FROM undated WHERE {_IN}
          UNION ALL SELECT k, ts FROM undated WHERE ts IS NULL AND k IN (SELECT k FROM presence WHERE inside = 0)) GROUP BY k""")
_sql("lost_dispatchers", f"""
    SELECT k dispatcher_key, {_n('all_rows', 'rows')}, {_n('undated_rows', 'rows_without_date')}, undated_rows > 0 retained
    FROM presence WHERE inside = 0""")
CTE["att_ids"] = "SELECT DISTINCT k FROM ev WHERE t = 'signup' AND v > 10"
CTE["in_ids"] = f"SELECT DISTINCT k FROM dispatch WHERE {_IN}"
_sql("presence_counts", """
    SELECT (SELECT count(*) FROM in_ids) dispatch_ids, (SELECT count(*) FROM att_ids) measured_ids,
           (SELECT count(*) FROM att_ids WHERE k IN (SELECT k FROM in_ids)) matched_ids,
           (SELECT count(*) FROM att_ids WHERE k NOT IN (SELECT k FROM in_ids)) unmatched_ids""")
_RET = "EXISTS (SELECT 1 FROM ret r WHERE r.k = d.k AND r.wb = d.wb)"
_PICK = "EXISTS (SELECT 1 FROM pickup p WHERE p.wb = d.wb)"
_sql("exclude_returned_pairs", f"SELECT k dispatcher_key, {ROWS} FROM dispatch d WHERE NOT {_RET} GROUP BY k")
_sql("exclude_pairs_preserving", f"SELECT k dispatcher_key, {ROWS} FROM dispatch d WHERE NOT {_RET} OR {_PICK} GROUP BY k")
_sql("exclude_picked_up", f"SELECT k dispatcher_key, {ROWS} FROM dispatch d WHERE NOT {_PICK} GROUP BY k")
_sql("net_dispatch_rows", "SELECT k dispatcher_key, wb waybill, CAST(ts AS DATE) AS day, w weight FROM net")
_sql("mixed_dates", """
    SELECT o_orderpriority AS file, CASE WHEN o_orderpriority <> '5-LOW' OR o_orderkey % 3 = 2 THEN CAST(o_orderdate AS DATE) END AS day,
           CAST(count(*) AS BIGINT) AS rows FROM orders GROUP BY 1, 2""")
_sql("date_shape_counts", """
    SELECT o_orderstatus AS file, 'shown' AS "column", CASE o_orderkey % 5 WHEN 0 THEN 'unparsed' WHEN 1 THEN 'blank' ELSE 'd-MMM-yyyy[ H:mm[:ss]]' END AS shape,
           CAST(count(*) AS BIGINT) AS "values" FROM orders GROUP BY 1, 3""")
_sql("csv_rejects", """
    SELECT CASE l_linenumber WHEN 6 THEN 'short' WHEN 7 THEN 'long' ELSE 'clean' END AS part, CAST(count(*) AS BIGINT) AS rows,
           CAST(sum(CASE WHEN l_linenumber < 6 THEN l_quantity ELSE 0 END) AS DOUBLE) AS weight FROM lineitem GROUP BY 1""")
_sql("rewritten_periods", """
    SELECT CAST(year(o_orderdate) AS VARCHAR) AS period, o_orderstatus, CAST(count(*) AS BIGINT) AS rows,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders
    WHERE year(o_orderdate) BETWEEN 1992 AND 1998 AND year(o_orderdate) <> 1993 AND (year(o_orderdate) <> 1995 OR o_orderkey % 2 = 0)
    GROUP BY 1, 2""")
_sql("net_dispatch_stored", "SELECT k dispatcher_key, wb waybill, CAST(ts AS DATE) AS day, w weight FROM net")
_sql("stored_export_counts", f"""
    SELECT {_n('count(*)', 'rows_in')}, {_n('count(*) FILTER (WHERE wb NOT IN (SELECT wb FROM ret))', 'rows_out')},
           {_n('(SELECT count(DISTINCT wb) FROM ret)', 'returned_waybills')} FROM dispatch""")
_sql("return_waybill_pairs", "SELECT DISTINCT k dispatcher_key, wb waybill FROM ret")
_sql("export_without_returns", """
    SELECT 'JMR' || lpad(k, 9, '0') dispatcher_id, wb waybill, CAST(ts AS DATE) AS day, w weight
    FROM dispatch d WHERE NOT EXISTS (SELECT 1 FROM ret r WHERE r.wb = d.wb)""")
_sql("export_stats", """
    SELECT 'dispatch_rows_in' metric, CAST(count(*) AS VARCHAR) AS value FROM dispatch
    UNION ALL SELECT 'return_rows', CAST(count(*) AS VARCHAR) FROM ret
    UNION ALL SELECT 'return_waybill_column', 'waybill_number'
    UNION ALL SELECT 'unique_return_awbs_norm', CAST(count(DISTINCT wb) AS VARCHAR) FROM ret
    UNION ALL SELECT 'dispatch_rows_removed', CAST(count(*) AS VARCHAR) FROM dispatch WHERE wb IN (SELECT wb FROM ret)
    UNION ALL SELECT 'dispatch_rows_out', CAST(count(*) AS VARCHAR) FROM dispatch WHERE wb NOT IN (SELECT wb FROM ret)""")
_sql("daily_parcels", f"SELECT k dispatcher_key, d delivery_date, {_n('n', 'daily_parcels')} FROM daily")
_sql("daily_distinct_parcels", """
    SELECT k dispatcher_key, CAST(ts AS DATE) delivery_date, count(DISTINCT wb) daily_parcels FROM dispatch GROUP BY 1, 2""")
CTE["plain_days"] = """SELECT k, d, n, CASE WHEN n >= 3 THEN 'Tier 1' WHEN n = 2 THEN 'Tier 2' ELSE 'Tier 3' END tier,
                              CASE WHEN n >= 3 THEN 1.10 WHEN n = 2 THEN 1.00 ELSE 0.95 END rate FROM daily"""
_sql("tiered_daily_pay", f"""
    SELECT k dispatcher_key, d delivery_date, {_n('n', 'daily_parcels')}, tier, {_d('rate', 'rate_per_parcel')},
           {_d('n * rate', 'payout_per_day')} FROM plain_days""")
_sql("tiered_pay_summary", f"""
    SELECT k dispatcher_key, {_n('sum(n)', 'delivery_parcels')}, {_n('count(*)', 'working_days')},
           {_d('round(sum(n * rate), 2)', 'base_payout')} FROM plain_days GROUP BY k""")
_sql("special_rate_pay", f"""
    SELECT k dispatcher_key, d delivery_date, {_n('n', 'daily_parcels')}, tier, {_d('sr', 'special_rate')},
           {_d('pay', 'payout_per_day')} FROM days WHERE sr IS NOT NULL""")
_sql("rate_card_pay", f"""
    SELECT tier, {_n('count(*)', 'AS days')}, {_d('sum(n * rate)', 'pay')} FROM (
      SELECT n, coalesce((SELECT r_name FROM region WHERE r_regionkey = x.hit), 'Unmatched') tier,
             coalesce(CAST(hit * 0.1 + 1 AS DECIMAL(12,4)), 0) rate
      FROM (SELECT n, CASE WHEN d < DATE '1995-06-01' THEN NULL WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 WHEN n >= 3 THEN 2 END hit
            FROM daily) x) GROUP BY tier""")
_sql("rate_card_overlaps", f"""
    SELECT coalesce(tier, 'Unmatched') tier, {_n('sum(days)', 'AS days')}, {_d('sum(days * n * coalesce(rate, 0))', 'pay')} FROM (
      SELECT d, n, days, arg_min('T' || o_orderkey % 5, o_orderkey) tier,
             arg_min(CAST(o_orderkey % 7 * 0.1 + 1 AS DECIMAL(12,4)), o_orderkey) rate
      FROM (SELECT d, n, count(*) AS days FROM daily GROUP BY 1, 2) p LEFT JOIN orders
        ON d >= CAST(o_orderdate AS DATE) AND (o_orderkey % 3 = 0 OR d <= CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INTEGER))
       AND n >= 1 + o_custkey % 3 AND (o_custkey % 2 = 1 OR n <= 1 + o_custkey % 3 + o_orderkey % 2)
      GROUP BY d, n, days) x GROUP BY 1""")
_sql("designated_driver_pay", f"""
    SELECT k dispatcher_key, d delivery_date, {_n('n', 'daily_parcels')}, tier, {_d('rate', 'rate_per_parcel')},
           {_n('extra', 'extra_parcels')}, {_d('pay', 'payout_per_day')} FROM days WHERE dd""")
_sql("designated_breakdown", f"""
    SELECT k dispatcher_key, parcels delivery_parcels, {_d('1700', 'basic_amount')}, {_n('300', 'basic_parcels')},
           {_d('1', 'rate_after_basic')}, {_n('greatest(0, parcels - 300)', 'extra_parcels')},
           {_d('base - 1700 - special', 'extra_payout')}, {_d('special', 'special_payout')}, {_d('base', 'base_payout')}
    FROM pay WHERE dd""")
_sql("kpi_bonus", f"SELECT k dispatcher_key, parcels delivery_parcels, {_d('kpi', 'kpi_bonus')}, kpi_text kpi_description FROM pay")
_sql("attendance_bonus", f"""
    SELECT k dispatcher_key, {_n('qualified', 'qualified_days')}, {_d('att', 'attendance_bonus')},
           att_text attendance_description FROM pay""")
_sql("flat_parcel_pay", f"""
    SELECT k dispatcher_key, count(DISTINCT wb) parcels, {_d('count(DISTINCT wb) * 1.50', 'payout')} FROM net GROUP BY k""")
_TIERS = ", ".join(_n(f"t{i}", f"tier{i}_parcels") for i in range(1, 5))
_sql("weight_tier_pay", f"""
    SELECT k dispatcher_key, n parcels, {_TIERS}, {_d('wt', 'total_weight')}, CAST(wt AS DOUBLE) / n avg_weight,
           {_d('pay', 'dispatch_payout')}, CAST(pay AS DOUBLE) / n avg_rate FROM tier_pay""")
_sql("daily_breakdown", f"""
    SELECT k dispatcher_key, d AS date, {_n('n', 'total_parcel')}, tier,
           CASE WHEN dd AND rate = 0 THEN 'Basic' ELSE 'RM' || CAST(rate AS DECIMAL(18,2)) END payout_rate,
           'RM' || CAST(round(pay, 2) AS DECIMAL(18,2)) payout FROM days""")
_sql("pickup_pay", f"SELECT k dispatcher_key, n pickup_parcels, {_d('pay', 'pickup_payout')} FROM pick_t")
_sql("return_pay", f"SELECT k dispatcher_key, n return_parcels, {_d('pay', 'return_payout')} FROM ret_t")
_sql("bulky_pay", f"SELECT k dispatcher_key, n bulky_parcels, {_d('pay', 'bulky_payout')} FROM bulky_t")
_sql("bulky_only_rows", f"""
    SELECT k dispatcher_key, {ROWS} FROM bulky b
    WHERE NOT EXISTS (SELECT 1 FROM dispatch d WHERE d.wb = b.wb AND NOT {_RET}) GROUP BY k""")
_sql("reward_total", f"SELECT k dispatcher_key, CAST(1 AS BIGINT) records, {_d('reward', 'amount')} FROM sup_t WHERE reward > 0")
_sql("rental_total", f"SELECT k dispatcher_key, CAST(1 AS BIGINT) records, {_d('rental', 'amount')} FROM sup_t")
_sql("benefit_deductions", f"""
    SELECT 'socso' deduction, k dispatcher_key, CAST(1 AS BIGINT) records, {_d('round(v * 0.01, 2)', 'amount')} FROM sup WHERE v > 0
    UNION ALL SELECT 'overpaid', k, 1, CAST(-v AS DOUBLE) FROM sup WHERE v < 0""")
_sql("rounded_hub_totals", f"""
    SELECT k dispatcher_key, CAST(1 AS BIGINT) records, {_d('round(v * 0.02, 2)', 'amount')} FROM sup WHERE v > 0""")
for _kind in KINDS:
    if _kind != "route":
        _sql(f"penalty_{_kind}", f"""
            SELECT 'statement' profile, k dispatcher_key, {_d('amount', 'amount')}, {_n('parcels', 'parcels')}
            FROM pen_a WHERE kind = '{_kind}'
            UNION ALL SELECT 'fleet', k, CAST(amount AS DOUBLE), parcels FROM pen_m WHERE kind = '{_kind}'""")
_sql("penalty_pending_parcel_priced", f"""
    SELECT k dispatcher_key, {_d('count(DISTINCT wb) * 2', 'amount')}, count(DISTINCT wb) parcels
    FROM ev WHERE t = 'view' GROUP BY k""")
_sql("penalty_ldr_priced", f"""
    SELECT k dispatcher_key, {_d('count(DISTINCT wb) * 100', 'amount')}, count(*) parcels FROM ev WHERE t = 'purchase' GROUP BY k""")
_sql("penalty_route", f"SELECT k dispatcher_key, {_d('share', 'amount')}, CAST(1 AS BIGINT) parcels FROM share_a")
_sql("route_split", """
    SELECT id, CAST(CAST((1234567 // n + CASE WHEN pos < 1234567 % n THEN 1 ELSE 0 END) / 100.0 AS DECIMAL(18,2)) AS DOUBLE) share
    FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 pos, count(*) OVER () n
          FROM (SELECT substr(c_mktsegment, 1, 4) || c_custkey id FROM customer))""")
_KINDS_AS_DOUBLE = ", ".join(_d(f"{k}_penalty", f"{k}_penalty") for k in KINDS)
_sql("penalty_totals", "SELECT k dispatcher_key, " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN kind = '{k}' THEN amount END), 0) AS DOUBLE) {k}_penalty" for k in KINDS
) + f", {_d('sum(amount)', 'penalty_amount')}, {_n('sum(parcels)', 'penalty_count')} FROM pen_a GROUP BY k")
_sql("penalty_by_kind", f"""
    SELECT kind, {_d('sum(amount)', 'amount')}, {_n('sum(parcels)', 'parcels')}, count(*) dispatchers FROM pen_m GROUP BY kind""")
_sql("penalty_waybills", f"""
    SELECT k dispatcher_key, kind, wb waybill, count(*) records, {_d('sum(v)', 'amount')} FROM recs
    WHERE kind IN ('ldr', 'pending_parcel', 'parcel_lost') GROUP BY 1, 2, 3""")
_sql("penalty_waybills_shown", """
    SELECT k dispatcher_key, kind, count(*) waybills,
           array_to_string(list_sort(list(wb))[1:5], ', ') || CASE WHEN count(*) > 5 THEN ' (+' || (count(*) - 5) || ' more)' ELSE '' END shown
    FROM (SELECT DISTINCT k, kind, wb FROM recs WHERE kind IN ('ldr', 'fake_attempt', 'pending_parcel')) GROUP BY 1, 2""")
_sql("scan_dedupe", """
    SELECT k dispatcher_key, wb waybill, CAST(min(ts) AS DATE) first_day, count(*) records FROM recs
    WHERE kind = 'no_outbound_scan' GROUP BY 1, 2""")
CTE["pen_m_sum"] = "SELECT k, sum(amount) pen, sum(parcels) pen_n FROM pen_m GROUP BY k"
CTE["pen_lines"] = """SELECT k, kind, wb, CASE WHEN kind = 'no_outbound_scan' THEN 3.00 ELSE sum(round(v, 2)) END amount FROM recs
                      WHERE kind <> 'attendance' AND (v > 0 OR kind = 'no_outbound_scan') AND wb IS NOT NULL GROUP BY 1, 2, 3"""
_sql("penalty_detail", f"""
    SELECT l.k dispatcher_key, kind, wb waybill, {_d('amount', 'record_amount')}, {_d('pen', 'dispatcher_penalty')}
    FROM pen_lines l JOIN pen_m_sum USING (k) WHERE pen_n > 0
    UNION ALL SELECT k, NULL, CAST(pen_n AS VARCHAR) || ' parcels', CAST(pen AS DOUBLE), CAST(pen AS DOUBLE)
    FROM pen_m_sum WHERE pen_n > 0 AND k NOT IN (SELECT k FROM pen_lines)""")
_sql("penalties_in_period", f"""
    SELECT k dispatcher_key, kind,
      CAST(CASE WHEN kind = 'no_outbound_scan' THEN count(DISTINCT wb) * 3.00 ELSE round(sum(v), 2) END AS DOUBLE) amount,
      CAST(CASE kind WHEN 'duitnow' THEN CASE WHEN sum(v) > 0 THEN 1 ELSE 0 END
                WHEN 'pending_parcel' THEN count(DISTINCT wb) WHEN 'no_outbound_scan' THEN count(DISTINCT wb)
                WHEN 'attendance' THEN count_if(v > 0) ELSE count(*) END AS BIGINT) parcels
    FROM recs WHERE kind = 'hub' OR ({_EV_IN}) GROUP BY 1, 2""")

_STATEMENT = f"""
    SELECT k dispatcher_key, dd designated, {_n('parcels', 'delivery_parcels')}, {_n('working', 'working_days')},
      {_d('base', 'base_payout')}, {_d('special', 'special_pay')}, {_d('kpi', 'kpi_bonus')}, kpi_text kpi_description,
      {_n('qualified', 'qualified_days')}, {_d('att', 'attendance_bonus')}, att_text attendance_description,
      {_n('pick_n', 'pickup_parcels')}, {_d('pick', 'pickup_payout')}, {_n('ret_n', 'return_parcels')}, {_d('ret', 'return_payout')},
      {_n('reward_n', 'reward_count')}, {_d('reward', 'reward_payout')}, {_KINDS_AS_DOUBLE},
      {_d('pen', 'penalty_total')}, {_n('pen_n', 'penalty_count')}, {_d('socso', 'socso_deduction')},
      {_d('overpaid', 'overpaid_deduction')}, {_n('awb', 'total_awb')}, {_d('gross', 'gross_payout')},
      {_d('advance', 'advance_payout')}, {_d('final', 'final_payout')} FROM final"""
_sql("statement_all", _STATEMENT)
_sql("statement_one_dispatcher", f"{_STATEMENT} WHERE k = '7'")

# The same statement with every dated sheet cut to the period.
_full = dict(CTE)
for _c in ("dispatch", "ret", "pickup", "bulky"):
    CTE[_c] = f"SELECT * FROM ({_full[_c]}) WHERE {_IN}"
CTE["ev"] = f"SELECT * FROM ({_full['ev']}) WHERE {_IN}"
_sql("statement_in_period", _STATEMENT)
CTE.clear()
CTE.update(_full)

_LABELS = {
    "duitnow": "DuitNow", "ldr": "LD&R", "fake_attempt": "Fake Attempt", "cod": "COD", "binding": "Binding", "hub": "Hub",
    "pending_parcel": "Pending Parcel", "no_outbound_scan": "No Outbound Scan", "parcel_lost": "Parcel Lost",
    "route": "Route", "attendance": "Attendance",
}


def _line_union(keys: str, source: str, lines: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}CAST({i} AS BIGINT) line, '{label}' AS label, CAST({q} AS BIGINT) quantity, CAST({a} AS DOUBLE) amount "
        f"FROM {source} WHERE {c}"
        for i, (label, q, a, c) in enumerate(lines, 1)
    )


_DD = "dd AND working > 0"
_sql("invoice_lines", _line_union("k dispatcher_key, ", "final", [
    ("Base Delivery Payout", "parcels", "base", "true"),
    ("Basic Amount", "300", "1700", _DD),
    ("Extra Parcels", "greatest(0, parcels - 300)", "base - special - 1700", f"{_DD} AND base - special - 1700 > 0"),
    ("Special Rate Incentive", "NULL", "special", f"{_DD} AND special > 0"),
    ("Pickup Payout", "pick_n", "pick", "true"),
    ("Return Payout", "ret_n", "ret", "true"),
    ("Reward", "reward_n", "reward", "true"),
    ("KPI Bonus", "NULL", "kpi", "true"),
    ("Attendance Bonus", "qualified", "att", "true"),
    ("Total Penalties", "pen_n", "-pen", "true"),
    *[(f"{_LABELS[k]} Penalty", "NULL", f"-{k}_penalty", f"{k}_penalty > 0") for k in KINDS],
    ("SOCSO", "NULL", "-socso", "true"),
    ("Overpaid", "NULL", "-overpaid", "true"),
    ("Gross Payout", "awb", "gross", "true"),
    ("Advance Payout", "NULL", "-advance", "true"),
    ("Final Payout", "NULL", "final", "true"),
]))
_FLEET = f"""
    SELECT k dispatcher_key, nm dispatcher_name, {_n('n + ret_n + bulky_n', 'parcels_delivered')},
      {_n('n + ret_n + bulky_n + pick_n', 'total_awb')}, {_TIERS}, {_d('wt', 'total_weight')},
      CASE WHEN n > 0 THEN CAST(wt AS DOUBLE) / n ELSE 0 END avg_weight, {_d('disp', 'dispatch_payout')},
      CASE WHEN n > 0 THEN CAST(disp AS DOUBLE) / n ELSE 0 END avg_rate,
      {_n('pick_n', 'pickup_parcels')}, {_d('pick', 'pickup_payout')}, {_n('ret_n', 'return_parcels')}, {_d('ret', 'return_payout')},
      {_n('bulky_n', 'bulky_parcels')}, {_d('bulky', 'bulky_payout')}, {_d('reward', 'reward')}, {_d('rental', 'rental')},
      {_KINDS_AS_DOUBLE}, {_d('pen', 'penalty_amount')}, {_n('pen_n', 'penalty_count')}, {_d('socso', 'socso_deduction')},
      {_d('overpaid', 'overpaid_deduction')}, {_d('total', 'total_payout')} FROM fleet"""
_sql("fleet_summary", _FLEET)
CTE["wide_m"] = _wide("pen_m", "m")
_sql("fleet_summary_with_route", _FLEET)
CTE["wide_m"] = _full["wide_m"]
CTE["pen_m"] = f"""{_full['pen_m']} UNION ALL
    SELECT k, kind, CAST(round(sum(v), 2) AS DECIMAL(18,2)), 0 FROM recs
    WHERE kind = 'attendance' AND v > 0 AND k NOT LIKE '%7' GROUP BY 1, 2"""
_sql("fleet_summary_with_attendance", _FLEET)
CTE["pen_m"] = _full["pen_m"]
_sql("fleet_totals", f"""
    SELECT dispatchers, {_n('delivered', 'parcels_delivered')}, {_n('awb', 'total_awb')}, {_n('pick_n', 'pickup_parcels')},
      {_n('ret_n', 'return_parcels')}, {_n('bulky_n', 'bulky_parcels')}, {_n('pen_n', 'penalty_count')}, {_d('wt', 'total_weight')},
      {_d('disp', 'dispatch_payout')}, {_d('pick', 'pickup_payout')}, {_d('ret', 'return_payout')}, {_d('bulky', 'bulky_payout')},
      {_d('reward', 'reward')}, {_KINDS_AS_DOUBLE}, {_d('pen', 'penalty_amount')}, {_d('rental', 'rental')},
      {_d('socso', 'socso_deduction')}, {_d('overpaid', 'overpaid_deduction')}, {_d('total', 'total_payout')},
      {_d('disp + pick + ret + bulky + reward', 'gross_earnings')}, {_d('pen + rental + socso + overpaid', 'total_deduction')} FROM tot""")
_sql("fleet_invoice_lines", _line_union("", "tot", [
    ("Delivery Parcels Payout", "delivered", "disp", "true"),
    ("Pickup Payout", "pick_n", "pick", "true"),
    ("Return Parcels Payout", "ret_n", "ret", "true"),
    ("Bulky Parcels Payout", "bulky_n", "bulky", "true"),
    ("Total Reward", "NULL", "reward", "true"),
    ("Gross Payout", "awb", "disp + pick + ret + bulky + reward", "true"),
    *[(f"{_LABELS[k]} Penalty", "NULL", f"-{k}_penalty", "true") for k in KINDS],
    ("Total Penalty", "pen_n", "-pen", "true"),
    ("Total Rental (deduction)", "NULL", "-rental", "true"),
    ("SOCSO", "NULL", "-socso", "true"),
    ("Overpaid", "NULL", "-overpaid", "true"),
    ("Total Deduction", "NULL", "-(pen + rental + socso + overpaid)", "true"),
    ("Total Payout", "dispatchers", "total", "true"),
]))


def _rm(x: str) -> str:
    return f"'RM' || format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def _minus(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN '-' || {_rm(x)} ELSE 'RM0.00' END"


_SHOWN = {
    "dispatch_payout": _rm("disp"), "pickup_payout": _rm("pick"), "return_payout": _rm("ret"), "bulky_payout": _rm("bulky"),
    "reward": _rm("reward"), "total_payout": _rm("total"), "penalty_amount": _minus("pen"), "rental": _minus("rental"),
    "socso_deduction": _minus("socso"), "overpaid_deduction": _minus("overpaid"),
    "total_weight": "format('{:.2f}', CAST(wt AS DOUBLE))",
    **{f"{k}_penalty": _minus(f"{k}_penalty") for k in KINDS},
}
_sql("fleet_display", f"""
    SELECT k dispatcher_key, nm dispatcher_name, {_n('n + ret_n + bulky_n', 'parcels_delivered')},
      {_n('n + ret_n + bulky_n + pick_n', 'total_awb')}, {_TIERS}, {_n('pick_n', 'pickup_parcels')}, {_n('ret_n', 'return_parcels')},
      {_n('bulky_n', 'bulky_parcels')}, {', '.join(f'{x} AS {c}' for c, x in _SHOWN.items())} FROM fleet""")
_sql("top_performers", f"""
    SELECT k dispatcher_key, nm dispatcher_name, {_d('total', 'total_payout')} FROM fleet ORDER BY total DESC, k LIMIT 10""")
_sql("top_penalties", f"""
    SELECT k dispatcher_key, {_d('pen', 'penalty_amount')}, {_n('pen_n', 'penalty_count')} FROM fleet WHERE pen > 0
    ORDER BY pen DESC, k LIMIT 5""")
_sql("payout_share", f"""
    SELECT k dispatcher_key, {_d('total', 'total_payout')},
           round(CAST(total AS DOUBLE) / (SELECT CAST(sum(total) AS DOUBLE) FROM fleet), 9) share FROM fleet""")
CTE["ment"] = """
    SELECT DISTINCT k, 'JMR' || lpad(k, 9, '0') id, nm, 1 p FROM dispatch
    UNION ALL SELECT DISTINCT k, 'JMR' || k, NULL, 4 FROM bulky
    UNION ALL SELECT k, 'JMR' || k, nm, 3 FROM sup
    UNION ALL SELECT k, k, NULL, 2 FROM sup
    UNION ALL SELECT DISTINCT k, CASE t WHEN 'view' THEN 'JMR00' || k ELSE k END, NULL, 2 FROM ev
    UNION ALL SELECT DISTINCT k, 'ECP' || k, NULL, 2 FROM ev WHERE t = 'error'
    UNION ALL SELECT DISTINCT k, 'JMR' || k, NULL, 2 FROM ev WHERE t = 'signup'"""
_sql("dispatcher_directory", """
    SELECT k dispatcher_key, id dispatcher_id, nm dispatcher_name, CASE WHEN nm <> '' THEN id || ' - ' || nm ELSE id END display
    FROM (SELECT k, arg_min(id, lpad(CAST(p AS VARCHAR), 2, '0') || id) id,
                 coalesce(arg_min(nm, lpad(CAST(p AS VARCHAR), 2, '0') || nm) FILTER (nm IS NOT NULL), '') nm FROM ment GROUP BY k)""")
_sql("pickup_detail", "SELECT id dispatcher_id, count(DISTINCT wb) pickup_parcels FROM pickup GROUP BY id")
_sql("return_detail", "SELECT k dispatcher_key, count(*) return_parcels FROM ret GROUP BY k")
_sql("daily_trend", "SELECT CAST(ts AS DATE) signature_date, count(*) total_parcels FROM dispatch GROUP BY 1")
_sql("daily_payout_trend", """
    SELECT ds signature_date, y total_payout, (SELECT count(*) FROM dispatch WHERE CAST(ts AS DATE) = ds) parcel_count FROM pay_points""")
_sql("daily_stats", f"""
    SELECT k dispatcher_key, CAST(sum(n) AS DOUBLE) / count(*) avg_daily_parcels, {_n('max(n)', 'max_daily_parcels')},
           CAST(sum(pay) AS DOUBLE) / count(*) avg_daily_payout, {_d('round(max(pay), 2)', 'best_day_payout')},
           (SELECT min(d) FROM days b WHERE b.k = a.k AND b.pay = max(a.pay)) best_day FROM days a GROUP BY k""")


def _band(x: str, digits: int, alias: str, kind: str = "DOUBLE") -> str:
    return f"CAST(round({x}, {digits}) AS {kind}) {alias}"


_sql("forecast", f"""
    SELECT series, ds, {_band('yhat', 6, 'yhat')}, {_band(f'yhat - sd * {Z}', 6, 'yhat_lower')},
           {_band(f'yhat + sd * {Z}', 6, 'yhat_upper')} FROM evf_ahead""")
CTE["recent"] = """SELECT series, avg(y) h FROM (SELECT series, y, row_number() OVER (PARTITION BY series ORDER BY ds DESC) n
                   FROM ev_points) WHERE n <= 7 GROUP BY series"""
_sql("forecast_metrics", f"""
    SELECT series, round(h, 6) avg_historical, round(m, 6) avg_forecast, round(sd, 6) forecast_std, round(hi, 6) max_forecast,
           round(lo, 6) min_forecast, round(total, 6) total_forecast, round((m - h) / h * 100, 6) change_pct,
           CASE WHEN (m - h) / h * 100 > 10 THEN 'growing' WHEN (m - h) / h * 100 < -10 THEN 'declining' ELSE 'stable' END trend
    FROM recent JOIN (SELECT series, avg(yhat) m, stddev_samp(yhat) sd, max(yhat) hi, min(yhat) lo, sum(yhat) total
                      FROM evf_ahead GROUP BY series) USING (series)""")
_sql("combined_forecast", f"""
    SELECT series, ds, {_band('p.yhat', 0, 'parcels_forecast', 'BIGINT')}, {_band(f'p.yhat - p.sd * {Z}', 0, 'parcels_lower', 'BIGINT')},
           {_band(f'p.yhat + p.sd * {Z}', 0, 'parcels_upper', 'BIGINT')}, {_band('m.yhat', 2, 'payout_forecast')},
           {_band(f'm.yhat - m.sd * {Z}', 2, 'payout_lower')}, {_band(f'm.yhat + m.sd * {Z}', 2, 'payout_upper')}
    FROM parf_ahead p JOIN payf_ahead m USING (series, ds)""")
_sql("history_and_forecast", """
    SELECT series, ds, 'Historical' AS type, round(y, 6) y FROM ev_points
    UNION ALL SELECT series, ds, 'Forecast', round(yhat, 6) FROM evw_ahead""")


# Joint fit: terms 1 to 12 are level, slope, breaks at 0.2, 0.4 and 0.6 of the history, and Monday to Sunday.
_TERM = """CASE WHEN i = 1 THEN 1.0 WHEN i = 2 THEN t WHEN i = 3 THEN greatest(t - 0.8 * 1 / 4, 0) WHEN i = 4 THEN greatest(t - 0.8 * 2 / 4, 0)
           WHEN i = 5 THEN greatest(t - 0.8 * 3 / 4, 0) WHEN isodow(ds) = i - 5 THEN 1.0 ELSE 0.0 END"""
_RIDGE = "CASE WHEN i = 1 THEN 0.0 WHEN i = 2 THEN 1e-6 WHEN i <= 5 THEN 1.0 ELSE 0.01 END"
_JOINT = f"""WITH RECURSIVE ev_points AS ({CTE['ev_points']}),
    j_head AS (SELECT series, min(ds) f, max(ds) l, avg(y) my, count(*) n FROM ev_points GROUP BY series HAVING count(*) >= 7),
    j_at AS (SELECT series, ds, y - my r, CAST(date_diff('day', f, ds) AS DOUBLE) / greatest(date_diff('day', f, l), 1) t
             FROM ev_points JOIN j_head USING (series)),
    j_x AS (SELECT series, ds, r, i, CAST({_TERM} AS DOUBLE) v FROM j_at, range(1, 13) q(i)),
    j_b AS (SELECT series, i, sum(v * r) b FROM j_x GROUP BY ALL),
    j_g AS (SELECT a.series, a.i, c.i j, sum(a.v * c.v) g FROM j_x a JOIN j_x c ON a.series = c.series AND a.ds = c.ds GROUP BY ALL),
    j_cells AS (SELECT series, i, j, g + CASE WHEN i = j THEN {_RIDGE} ELSE 0 END v FROM j_g
                UNION ALL SELECT series, i, 13, b FROM j_b
                UNION ALL SELECT series, i, 13 + j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM j_g),
    j_rows AS (SELECT series, i, list(CAST(v AS DOUBLE) ORDER BY j) w FROM j_cells GROUP BY series, i),
    j_steps AS (SELECT series, 1 k, list(w ORDER BY i) m FROM j_rows GROUP BY series
                UNION ALL
                SELECT series, k + 1, list_transform(m, lambda w, i: CASE WHEN i = k THEN list_transform(w, lambda x: x / m[k][k])
                  ELSE list_transform(w, lambda x, j: x - m[k][j] * w[k] / m[k][k]) END) FROM j_steps WHERE k <= 12),
    j_beta AS (SELECT series, i, m[i][13] beta, m[i][13 + i] own, m FROM j_steps, range(1, 13) q(i) WHERE k = 13),
    j_sd AS (SELECT series, sqrt(greatest(any_value(rr) - sum(beta * b + {_RIDGE} * beta * beta), 0)
                                 / greatest(any_value(n) - 12 + sum({_RIDGE} * own), 1)) sd
             FROM j_beta JOIN j_b USING (series, i) JOIN j_head USING (series)
                  JOIN (SELECT series, sum(r * r) rr FROM j_at GROUP BY series) USING (series) GROUP BY series)"""
ORACLE["joint_forecast"] = f"""{_JOINT},
    j_days AS (SELECT series, CAST(l + CAST(h AS INTEGER) AS DATE) ds, my,
                      CAST(date_diff('day', f, l) + h AS DOUBLE) / greatest(date_diff('day', f, l), 1) t FROM j_head, range(1, 31) q(h)),
    j_new AS (SELECT series, ds, my, i, CAST({_TERM} AS DOUBLE) v FROM j_days, range(1, 13) q(i)),
    j_hat AS (SELECT series, ds, any_value(my) + sum(v * beta) yhat FROM j_new JOIN j_beta USING (series, i) GROUP BY series, ds),
    j_var AS (SELECT a.series, a.ds, sum(a.v * c.v * m[a.i][13 + c.i]) q FROM j_new a JOIN j_new c ON a.series = c.series AND a.ds = c.ds
              JOIN j_beta ON j_beta.series = a.series AND j_beta.i = a.i GROUP BY a.series, a.ds)
    SELECT series, ds, round(yhat, 6) yhat, round(yhat - {Z} * sd * sqrt(1 + q), 6) yhat_lower, round(yhat + {Z} * sd * sqrt(1 + q), 6) yhat_upper
    FROM j_hat JOIN j_var USING (series, ds) JOIN j_sd USING (series)"""
ORACLE["joint_components"] = f"""{_JOINT}
    SELECT series, n points, round(max(beta) FILTER (i = 2) / greatest(date_diff('day', f, l), 1), 6) slope_first,
           round(sum(beta) FILTER (i BETWEEN 2 AND 5) / greatest(date_diff('day', f, l), 1), 6) slope_last, round(sd, 6) spread,
           {', '.join(f'round(max(beta) FILTER (i = {6 + w}), 6) weekday_{w}' for w in range(7))}
    FROM j_beta JOIN j_head USING (series) JOIN j_sd USING (series) GROUP BY series, n, f, l, sd"""
