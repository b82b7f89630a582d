"""DuckDB SQL for every registered query, written from the metric definitions and not from the Spark plans.

Where the Spark side uses a shortcut (telescoped gaps, counted fan-outs, month-grain cohorts), the SQL here takes the
literal way: windows over rows, full joins, distinct counts.
"""

from __future__ import annotations

from donorlens.sources.sample_tables import CAMPAIGN, NO_SOURCE, SPINE_MONTHS, SPINE_START, TOP_K, YEARS

D = f"""d AS (
  SELECT o_orderkey AS order_id, o_orderkey AS action_id, o_custkey AS cid, o_orderdate AS ts,
         CAST(o_totalprice AS DECIMAL(18,2)) AS price,
         CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'notpaid' WHEN 'P' THEN 'fail' END AS status,
         o_orderdate >= TIMESTAMP '{CAMPAIGN[0]}' AND o_orderdate < TIMESTAMP '{CAMPAIGN[1]}' AS campaign,
         o_orderpriority = '2-HIGH' AS recurrent
  FROM orders)"""

A = """a AS (
  SELECT o_custkey AS cid, l_shipdate AS ts, c_mktsegment AS channel, n_name AS source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

EVENT_ACTIONS = "a AS (SELECT user_id AS cid, ts FROM events)"
EVENT_DONATIONS = "d AS (SELECT user_id AS cid, ts FROM events)"

SPINE = f"""spine AS (
  SELECT strftime(DATE '{SPINE_START}-01' + INTERVAL (i) MONTH, '%Y-%m') AS m FROM range({SPINE_MONTHS}) r(i))"""

_start_year, _start_month = (int(part) for part in SPINE_START.split("-"))
MONTHS = [
    f"{_start_year + (_start_month - 1 + i) // 12}-{(_start_month - 1 + i) % 12 + 1:02d}" for i in range(SPINE_MONTHS)
]


def rnd(x: str, digits: int = 2) -> str:
    """Half-up rounding of the decimal expansion."""
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def cents(total: str, n: str) -> str:
    """total / n rounded half up to cents in whole numbers, for amounts that are not negative."""
    return f"CAST((2 * CAST(100 * {total} AS HUGEINT) + {n}) // (2 * {n}) AS DOUBLE) / 100"


def days(later: str, earlier: str) -> str:
    return f"(date_diff('microsecond', {earlier}, {later}) / 86400000000.0::DOUBLE)"


Y = "strftime(ts, '%Y')"
YM = "strftime(ts, '%Y-%m')"
YEAR_LIST = ", ".join(f"'{y}'" for y in YEARS)


def per_year(cell: str) -> str:
    """One column per listed year; ``cell`` holds {y}."""
    return ", ".join(f'{cell.format(y=y)} AS "{y}"' for y in YEARS)


def wide(value: str, months: list[str] = MONTHS) -> str:
    return ", ".join(f"max({value}) FILTER (WHERE m = '{m}') AS \"{m}\"" for m in months)


ORACLE: dict[str, str] = {}

# users ---------------------------------------------------------------------------------------------------------------

ORACLE["unique_action_users"] = f"WITH {A} SELECT count(DISTINCT cid) AS unique_users_customers FROM a"
ORACLE["unique_donors"] = f"WITH {D} SELECT count(DISTINCT cid) AS unique_users_orders FROM d"
ORACLE["non_matched_ids"] = f"""WITH {D}, {EVENT_ACTIONS}
SELECT cid AS unique_user_id FROM a WHERE cid NOT IN (SELECT cid FROM d)
UNION ALL SELECT cid FROM d WHERE cid NOT IN (SELECT cid FROM a)"""
ORACLE["non_matched_users_by_year"] = f"""WITH {D}, {EVENT_ACTIONS}
SELECT CAST(NULL AS VARCHAR) AS order_year, count(DISTINCT a.cid) AS unique_user_count, 'customers_only' AS source
FROM a WHERE NOT EXISTS (FROM d WHERE d.cid = a.cid) HAVING count(*) > 0
UNION ALL
SELECT {Y}, count(DISTINCT d.cid), 'orders_only'
FROM d WHERE NOT EXISTS (FROM a WHERE a.cid = d.cid) GROUP BY 1"""

# campaign ------------------------------------------------------------------------------------------------------------

ORACLE["campaign_window"] = f"WITH {D} SELECT min(ts) AS newyear_start, max(ts) AS newyear_end FROM d WHERE campaign"
ORACLE["campaign_users"] = f"WITH {D} SELECT count(DISTINCT cid) AS user_count_newyear FROM d WHERE campaign"
ORACLE["campaign_participation_pct"] = f"""WITH {D}
SELECT {rnd("count(DISTINCT cid) FILTER (WHERE campaign)::DOUBLE / count(DISTINCT cid) * 100")} AS percent_participated_newyear
FROM d"""
ORACLE["campaign_users_by_first_action_year"] = f"""WITH {D}, {A},
joined AS (SELECT cid FROM d WHERE campaign GROUP BY cid),
began AS (SELECT cid, min(ts) AS began FROM a SEMI JOIN joined USING (cid) GROUP BY cid)
SELECT strftime(began, '%Y') AS active_year, count(DISTINCT cid) AS user_count,
  {dbl("sum(price)")} AS total_planned_donations,
  {dbl("sum(CASE WHEN status = 'Paid' THEN price ELSE 0 END)")} AS paid_donations,
  CASE WHEN sum(price) > 0 THEN
    {rnd("sum(CASE WHEN status = 'Paid' THEN price ELSE 0 END)::DOUBLE * 100 / sum(price)::DOUBLE")}
  ELSE 0 END AS total_donations_percentage
FROM began JOIN d USING (cid) GROUP BY 1"""
ORACLE["campaign_returned_users"] = f"""WITH {D},
first_gift AS (SELECT cid, min(ts) AS t FROM d WHERE campaign GROUP BY cid)
SELECT count(DISTINCT d.cid) AS post_newyear_user_count FROM d JOIN first_gift f ON d.cid = f.cid AND d.ts > f.t"""
_FIRST_TIME = f"""WITH {D},
bounds AS (SELECT min(ts) AS lo, max(ts) AS hi FROM d WHERE campaign),
debut AS (SELECT cid, min(ts) AS t FROM d GROUP BY cid),
newcomer_rows AS (
  SELECT d.cid FROM d JOIN debut USING (cid), bounds WHERE campaign AND t >= lo AND t <= hi)"""
ORACLE["campaign_first_time_donors"] = f"{_FIRST_TIME} SELECT count(*) AS newyear_user_count FROM newcomer_rows"
ORACLE["campaign_first_time_returned"] = f"""{_FIRST_TIME}
SELECT count(DISTINCT d.cid) AS users_with_repeat_payment
FROM d, bounds WHERE ts > hi AND cid IN (SELECT cid FROM newcomer_rows)"""

# recurrent users, repeat payments ------------------------------------------------------------------------------------

ORACLE["recurrent_users"] = f"WITH {D} SELECT count(DISTINCT cid) AS recurrents_count FROM d WHERE recurrent"
ORACLE["recurrent_users_by_first_year"] = f"""WITH {D}
SELECT strftime(t, '%Y') AS first_payment_year, count(*) AS recurrent_users_count
FROM (SELECT cid, min(ts) AS t FROM d WHERE recurrent GROUP BY cid) GROUP BY 1"""
_PAYERS = "payers AS (SELECT DISTINCT cid FROM d WHERE status = 'Paid' AND NOT recurrent)"
ORACLE["repeat_payers_non_recurrent"] = f"""WITH {D}, {_PAYERS}
SELECT count(*) AS users_with_repeat_payment
FROM (SELECT cid FROM d JOIN payers USING (cid) GROUP BY cid HAVING count(DISTINCT action_id) > 1)"""
ORACLE["avg_days_between_payments"] = f"""WITH {D}, {_PAYERS},
gaps AS (
  SELECT cid, {days("ts", "lag(ts) OVER (PARTITION BY cid ORDER BY ts)")} AS gap
  FROM d JOIN payers USING (cid) WHERE status = 'Paid')
SELECT {rnd("avg(user_gap)")} AS overall_avg_days_between_payments
FROM (SELECT avg(gap) AS user_gap FROM gaps WHERE gap IS NOT NULL GROUP BY cid)"""
ORACLE["paid_users_by_first_channel"] = f"""WITH {D}, {A},
opening AS (SELECT cid, channel, ts FROM a QUALIFY ts = min(ts) OVER (PARTITION BY cid)),
counted AS (
  SELECT channel, strftime(o.ts, '%Y') AS y, count(DISTINCT d.cid) AS n
  FROM opening o JOIN d ON d.cid = o.cid AND d.status = 'Paid' GROUP BY ALL)
SELECT channel AS user_source, {per_year("CAST(coalesce(sum(n) FILTER (WHERE y = '{y}'), 0) AS BIGINT)")},
  {big(f"coalesce(sum(n) FILTER (WHERE y IN ({YEAR_LIST})), 0)")} AS total
FROM counted GROUP BY channel"""
ORACLE["avg_days_first_to_second"] = f"""WITH {D},
opening AS (SELECT cid, min(ts) AS t1 FROM d WHERE status = 'Paid' AND NOT recurrent GROUP BY cid),
follow AS (SELECT d.cid, t1, min(ts) AS t2 FROM d JOIN opening o ON d.cid = o.cid AND ts > t1 GROUP BY ALL)
SELECT {big(f"round(avg({days('t2', 't1')}))")} AS avg_days_between_1_and_2_payments FROM follow"""

# payment status ------------------------------------------------------------------------------------------------------

ORACLE["payments_by_status"] = f"WITH {D} SELECT status AS payment_status, count(*) AS count_payments FROM d GROUP BY 1"
ORACLE["payments_by_status_year"] = f"""WITH {D}
SELECT status AS payment_status, {per_year("count(*) FILTER (WHERE strftime(ts, '%Y') = '{y}')")}
FROM d WHERE {Y} IN ({YEAR_LIST}) GROUP BY 1"""
ORACLE["users_by_status"] = f"""WITH {D}, {A}
SELECT status AS payment_status, count(DISTINCT a.cid) AS unique_user_count FROM a JOIN d USING (cid) GROUP BY 1"""
ORACLE["users_by_status_count"] = f"""WITH {D}, {A}
SELECT k AS status_count, count(*) AS user_count
FROM (SELECT count(DISTINCT status) AS k FROM a JOIN d USING (cid) GROUP BY cid) GROUP BY 1"""
ORACLE["users_by_status_year"] = f"""WITH {D}, {A}
SELECT status AS payment_status, {per_year("count(DISTINCT a.cid) FILTER (WHERE strftime(d.ts, '%Y') = '{y}')")}
FROM a JOIN d ON a.cid = d.cid WHERE strftime(d.ts, '%Y') IN ({YEAR_LIST}) GROUP BY 1"""


def _status_sum(status: str) -> str:
    return dbl(f"sum(CASE WHEN status = '{status}' THEN price ELSE 0 END)")


ORACLE["revenue_by_status_year"] = f"""WITH {D}
SELECT {Y} AS financial_year, {dbl("sum(price)")} AS total_amount, {_status_sum("Paid")} AS total_paid,
  {_status_sum("notpaid")} AS total_not_paid, {_status_sum("fail")} AS total_failed
FROM d GROUP BY 1"""
ORACLE["max_donations"] = f"""WITH {D}
SELECT {dbl("max(price)")} AS max_order_amount,
  {dbl("max(price) FILTER (WHERE status = 'Paid')")} AS max_paid_order_amount,
  {dbl("max(price) FILTER (WHERE status = 'notpaid')")} AS max_not_paid_order_amount
FROM d"""
for _key, _status in (("paid_in_range", "Paid"), ("unpaid_in_range", "notpaid")):
    ORACLE[_key] = f"""WITH {D} SELECT count(*) AS paid_orders_count
FROM d WHERE status = '{_status}' AND price > 500 AND price < 200000"""

# channels ------------------------------------------------------------------------------------------------------------

ORACLE["top_channels_by_year"] = f"""WITH {D}, {A},
counted AS (
  SELECT source, strftime(a.ts, '%Y') AS y, count(DISTINCT d.cid) AS n
  FROM a JOIN d ON a.cid = d.cid WHERE source IS NOT NULL AND source <> '{NO_SOURCE}' GROUP BY ALL),
best AS (FROM counted QUALIFY row_number() OVER (PARTITION BY y ORDER BY n DESC, source) <= {TOP_K})
SELECT source, {per_year("CAST(coalesce(sum(n) FILTER (WHERE y = '{y}'), 0) AS BIGINT)")} FROM best GROUP BY source"""
ORACLE["top_channel_orders"] = f"""WITH {D}, {A},
counted AS (
  SELECT strftime(a.ts, '%Y') AS year, source, count(DISTINCT d.cid) AS user_count,
    count(*) FILTER (WHERE status = 'Paid') AS total_paid_orders,
    {cents("sum(price) FILTER (WHERE status = 'Paid')", "count(price) FILTER (WHERE status = 'Paid')")} AS avg_check_per_user
  FROM a JOIN d ON a.cid = d.cid WHERE source IS NOT NULL AND source <> '{NO_SOURCE}' GROUP BY ALL)
FROM counted QUALIFY row_number() OVER (PARTITION BY year ORDER BY user_count DESC, source) <= {TOP_K}"""

# activity ------------------------------------------------------------------------------------------------------------


def _activity(source: str, label: str, period: str, total: bool) -> str:
    def counts(name: str, span: str) -> str:
        return f"{name} AS (SELECT strftime(ts, '{period}') AS p, count(DISTINCT cid) AS n FROM d GROUP BY p, {span})"

    def rates(dau: str, wau: str, mau: str) -> str:
        return f"""{rnd(dau)} AS avg_dau, {rnd(wau)} AS avg_wau, {rnd(mau)} AS avg_mau,
  {rnd(f"{dau} / {mau} * 100")} AS sticky_factor_mau, {rnd(f"{dau} / {wau} * 100")} AS sticky_factor_wau"""

    def mean_of(name: str, where: str) -> str:
        return f"(SELECT avg(x.n) FROM {name} x {where})"

    own = [mean_of(name, "WHERE x.p = base.p") for name in ("dd", "ww", "mm")]
    every = [mean_of(name, "") for name in ("dd", "ww", "mm")]
    sql = f"""WITH {source},
{counts("dd", "CAST(ts AS DATE)")},
{counts("ww", "strftime(ts, '%W')")},
{counts("mm", "strftime(ts, '%m')")}
SELECT base.p AS {label}, {rates(*own)} FROM (SELECT DISTINCT p FROM mm) base"""
    return sql + (f"\nUNION ALL SELECT 'Total', {rates(*every)}" if total else "")


ORACLE["activity_by_year"] = _activity(D, "year", "%Y", True)
ORACLE["activity_by_month"] = _activity(D, "month", "%Y-%m", False)
ORACLE["activity_by_year_events"] = _activity(EVENT_DONATIONS, "year", "%Y", True)
ORACLE["activity_by_month_events"] = _activity(EVENT_DONATIONS, "month", "%Y-%m", False)

# conversion, lifetime value ------------------------------------------------------------------------------------------

ORACLE["conversion_rate"] = f"""WITH {D}, {A}
SELECT u AS unique_users, p AS paying_users_count, {rnd("p * 100.0::DOUBLE / u")} AS conversion_rate
FROM (SELECT count(DISTINCT cid) AS u FROM a), (SELECT count(DISTINCT cid) AS p FROM d WHERE status = 'Paid')"""
_CONVERSION = f"""WITH {D}, {A},
monthly AS (
  SELECT month, u AS unique_users, coalesce(p, 0) AS paying_users_count,
    {rnd("coalesce(p, 0) * 100.0::DOUBLE / nullif(u, 0)")} AS conversion_rate
  FROM (SELECT {YM} AS month, count(DISTINCT cid) AS u FROM a GROUP BY 1)
  LEFT JOIN (SELECT {YM} AS month, count(DISTINCT cid) AS p FROM d WHERE status = 'Paid' GROUP BY 1) USING (month))"""
ORACLE["conversion_by_month"] = f"{_CONVERSION} FROM monthly"
ORACLE["avg_conversion_below_100"] = f"""{_CONVERSION}
SELECT {rnd("avg(conversion_rate)")} AS average_conversion_rate FROM monthly WHERE conversion_rate < 100"""
ORACLE["clv_by_year"] = f"""WITH {D},
user_years AS (
  SELECT cid, {Y} AS y, sum(price)::DOUBLE / count(price) AS check_size, count(order_id) AS n,
    {days("max(ts)", "min(ts)")} / 30 AS months
  FROM d GROUP BY 1, 2)
SELECT y AS order_year, {rnd("sum(check_size * n) / nullif(sum(months), 0)")} AS average_clv FROM user_years GROUP BY 1"""

# revenue -------------------------------------------------------------------------------------------------------------

ORACLE["total_paid"] = f"WITH {D} SELECT {dbl('sum(price)')} AS total_donate FROM d WHERE status = 'Paid'"
ORACLE["total_paid_by_year"] = f"""WITH {D}
SELECT {Y} AS financial_year, {dbl("sum(price)")} AS total_donate FROM d WHERE status = 'Paid' GROUP BY 1"""


def _arpu(label: str, period: str) -> str:
    return f"""WITH {D}, {A},
income AS (SELECT {period} AS p, sum(price) AS s FROM d WHERE status = 'Paid' GROUP BY 1),
people AS (SELECT {period} AS p, count(DISTINCT cid) AS total_users FROM a GROUP BY 1)
SELECT people.p AS {label}, {dbl("coalesce(s, 0)")} AS total_income, total_users,
  {dbl("coalesce(s, 0)")} / nullif(total_users, 0) AS arpu
FROM people LEFT JOIN income ON people.p = income.p"""


def _arppu(label: str, period: str) -> str:
    return f"""WITH {D}
SELECT {period} AS {label}, {dbl("coalesce(sum(price), 0)")} AS total_income, count(DISTINCT cid) AS paying_users_count,
  {dbl("coalesce(sum(price), 0)")} / nullif(count(DISTINCT cid), 0) AS arppu
FROM d WHERE status = 'Paid' GROUP BY 1"""


ORACLE["arpu_by_year"] = _arpu("year", Y)
ORACLE["arpu_by_month"] = _arpu("year_month", YM)
ORACLE["arppu_by_year"] = _arppu("year", Y)
ORACLE["arppu_by_month"] = _arppu("year_month", YM)
_CHECK = cents("sum(price)", "count(price)")
ORACLE["avg_check_by_year"] = f"""WITH {D}
SELECT {Y} AS year, {_CHECK} AS average_check FROM d WHERE status = 'Paid' GROUP BY 1
UNION ALL SELECT 'Total', {_CHECK} FROM d WHERE status = 'Paid'"""
ORACLE["avg_payments_and_lifetime"] = f"""WITH {D}
SELECT {rnd("avg(span)")} AS avg_days_between_first_last_pay, {rnd("avg(n)")} AS average_payments_per_user
FROM (SELECT {days("max(ts)", "min(ts)")} AS span, count(*) AS n FROM d WHERE status = 'Paid' GROUP BY cid)"""
ORACLE["avg_daily_check"] = f"""WITH {D}
SELECT {rnd("avg(c)")} AS overall_average_check
FROM (SELECT sum(price)::DOUBLE / count(*) AS c FROM d WHERE status = 'Paid' GROUP BY CAST(ts AS DATE))"""

# RFM -----------------------------------------------------------------------------------------------------------------

# Segment -> codes. The first segment that lists a code owns it.
_CODES = {
    "Key clients": ["123", "133", "143", "223", "233", "243", "323", "333", "343"],
    "Prospective clients": ["112", "122", "113", "213", "214", "232", "312"],
    "One-time donors": ["111", "112", "121", "131", "211", "221", "311"],
    "Rarely active": ["141", "142", "144", "241", "242", "244", "341", "342", "344", "444"],
    "Moderately active": ["114", "124", "132", "213", "222", "224", "234", "324"],
    "Growth potential clients": ["213", "222", "231", "312", "323"],
    "Highly active": ["221", "311", "321", "322", "331"],
}


def _segment_texts(code: str) -> str:
    names = " ".join(f"WHEN {code} IN {tuple(codes)} THEN '{name}'" for name, codes in _CODES.items())
    return f"""CASE {names} ELSE 'Lost clients' END AS segment_name,
  CASE WHEN {code}[1] = '4'
    THEN 'Churned clients with extremely low transfer frequency and extremely small donation amounts'
    ELSE ['Inactive', 'Relatively active', 'Active'][{code}[1]::INT] || ' clients with '
      || ['low', 'medium', 'high', 'extremely low'][{code}[2]::INT] || ' transfer frequency and '
      || ['small', 'medium', 'high', 'extremely small'][{code}[3]::INT] || ' donation amounts' END AS segment_description"""


_RFM = f"""WITH {D},
gifts AS (SELECT DISTINCT cid, CAST(ts AS DATE) AS day, price FROM d WHERE status = 'Paid'),
gaps AS (SELECT *, date_diff('day', day, lead(day) OVER (PARTITION BY cid ORDER BY day)) AS gap FROM gifts),
facts AS (
  SELECT cid, date_diff('day', max(day), (SELECT max(day) FROM gifts)) AS recency,
    CASE WHEN count(*) > 1 AND avg(gap) > 0 THEN 30.0::DOUBLE / avg(gap) END AS frequency, sum(price) AS spent
  FROM gaps WHERE cid IS NOT NULL GROUP BY cid),
kept AS (FROM facts WHERE recency <> 0),
typical AS (
  SELECT sum(recency)::DOUBLE / count(recency) AS r, avg(frequency) AS f, sum(spent)::DOUBLE / count(spent) AS m FROM kept),
scored AS (
  SELECT kept.*,
    CASE WHEN recency <= r THEN 3 WHEN recency <= 2 * r THEN 2 WHEN recency <= 3 * r THEN 1 ELSE 4 END AS rs,
    CASE WHEN frequency >= 3 * f THEN 3 WHEN frequency >= 2 * f THEN 2 WHEN frequency >= f THEN 1 ELSE 4 END AS fs,
    CASE WHEN spent::DOUBLE >= 3 * m THEN 3 WHEN spent::DOUBLE >= 2 * m THEN 2 WHEN spent::DOUBLE >= m THEN 1 ELSE 4 END AS ms
  FROM kept, typical),
coded AS (SELECT *, rs::VARCHAR || fs::VARCHAR || ms::VARCHAR AS code FROM scored)"""

ORACLE["rfm_customers"] = f"""{_RFM}
SELECT cid AS customer_id, recency AS recency_days, frequency AS order_frequency_per_month, {dbl("spent")} AS total_spent,
  {big("rs")} AS recency_score, {big("fs")} AS frequency_score, {big("ms")} AS monetary_score, code AS RFM,
  {rnd("(count(*) OVER (PARTITION BY code))::DOUBLE * 100 / (count(*) OVER ())")} AS percentage_RFM,
  {_segment_texts("code")}
FROM coded"""
ORACLE["rfm_segments"] = f"""{_RFM}
SELECT code AS rfm_segment, count(*) AS users_count_in_segment,
  {rnd("sum(recency)::DOUBLE / count(recency)")} AS avg_lifetime, {rnd("avg(frequency)")} AS avg_orders_count,
  {cents("sum(spent)", "count(spent)")} AS mean_donation_per_user, {dbl("sum(spent)")} AS total_donation_sum,
  {_segment_texts("code")}
FROM coded GROUP BY code"""
ORACLE["segment_labels"] = f"{_RFM} SELECT DISTINCT code AS RFM, {_segment_texts('code')} FROM coded"

# cohorts by first donation -------------------------------------------------------------------------------------------

_BASE = f"""WITH {D}, {SPINE},
gifts AS (
  SELECT cid, {YM} AS m, price, min({YM}) OVER (PARTITION BY cid) AS cohort
  FROM d WHERE cid IS NOT NULL AND ts IS NOT NULL),
cells AS (SELECT cohort, m, count(DISTINCT cid) AS people, sum(price) AS sales FROM gifts GROUP BY ALL),
sizes AS (SELECT cohort, count(DISTINCT cid) AS size FROM gifts WHERE m = cohort GROUP BY cohort),
inside AS (SELECT cells.*, size FROM cells JOIN sizes USING (cohort) SEMI JOIN spine USING (m)),
filled AS (
  SELECT spine.m, cohort, people, sales, size FROM spine LEFT JOIN cells ON spine.m = cells.m LEFT JOIN sizes USING (cohort))"""
_RATE = rnd("people * 100.0::DOUBLE / size", 1)
_CELL_CHECK = f"coalesce({cents('sales', 'people')}, 0)"
_MEAN_CHECK = cents("sum(CAST(c AS DECIMAL(18,2)))", "count(c)")

ORACLE["retention_long"] = f"""{_BASE}
SELECT cohort, size AS n_customers_start, m AS month, people AS n_customers, {_RATE} AS retention_rate FROM inside"""
ORACLE["retention_matrix"] = f"""{_BASE}
SELECT cohort, size AS n_customers_start, {wide("rate")} FROM (SELECT *, {_RATE} AS rate FROM inside) GROUP BY 1, 2"""
ORACLE["rearranged_matrix"] = f"""{_BASE}
SELECT cohort, size AS n_customers_start, {wide("rate", MONTHS[::-1])}
FROM (SELECT *, {_RATE} AS rate FROM inside) GROUP BY 1, 2"""
ORACLE["avg_check_matrix"] = f"""{_BASE}
SELECT cohort, size AS n_customers_start, {wide("c")}, {_MEAN_CHECK} AS average_cohort_check
FROM (SELECT *, {_CELL_CHECK} AS c FROM inside) GROUP BY 1, 2"""
_COHORT_CHECKS = f"""{_BASE},
checks AS (
  SELECT cohort, {_MEAN_CHECK} AS average_check FROM (SELECT *, {_CELL_CHECK} AS c FROM filled) GROUP BY cohort)"""
ORACLE["avg_check_by_cohort"] = f"{_COHORT_CHECKS} FROM checks"
ORACLE["top_bottom_avg_check"] = f"""{_COHORT_CHECKS}
SELECT cohort, average_check, CASE WHEN k <= {TOP_K} THEN 'top' ELSE 'bottom' END AS top_or_bottom
FROM (SELECT *, row_number() OVER (ORDER BY average_check DESC, cohort NULLS FIRST) AS k FROM checks)
WHERE k <= {TOP_K} OR k > (SELECT count(*) FROM checks) - {TOP_K}"""
ORACLE["ltv_matrix"] = f"""{_BASE},
running AS (SELECT cohort, m, sum(sales) OVER (PARTITION BY cohort ORDER BY m)::DOUBLE AS v FROM inside)
SELECT cohort, 1::BIGINT AS n_customers_start, {wide("v")} FROM running GROUP BY cohort"""
ORACLE["ltv_running"] = f"""{_BASE}
SELECT cohort, size AS n_customers_start, m AS order_month,
  coalesce(sum(sales) OVER (PARTITION BY cohort ORDER BY m ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS ltv
FROM filled"""
_LTV = f"{_BASE}, totals AS (SELECT cohort, sum(sales)::DOUBLE AS ltv FROM cells GROUP BY cohort)"
ORACLE["ltv_by_cohort"] = f"{_LTV} FROM totals"
ORACLE["ltv_by_cohort_per_user"] = f"""{_BASE}
SELECT cohort, sum(CAST({cents("sales", "size")} AS DECIMAL(18,2)))::DOUBLE AS ltv
FROM cells JOIN sizes USING (cohort) GROUP BY cohort"""
ORACLE["top_bottom_ltv"] = f"""{_LTV}
SELECT cohort, ltv, CASE WHEN k <= {TOP_K} THEN 'top' ELSE 'bottom' END AS category
FROM (SELECT *, row_number() OVER (ORDER BY ltv DESC, cohort) AS k FROM totals)
WHERE k <= {TOP_K} OR k > (SELECT count(DISTINCT cohort) FROM totals) - {TOP_K}"""

# cohorts by first action ---------------------------------------------------------------------------------------------

_JOINED = f"""WITH {D}, {A},
members AS (SELECT cid, strftime(min(ts), '%Y-%m') AS cohort_month FROM a GROUP BY cid)"""
_RETENTION = f"""{_JOINED},
sizes AS (SELECT cohort_month, count(DISTINCT cid) AS total_users FROM members GROUP BY 1),
active AS (
  SELECT cohort_month, strftime(d.ts, '%Y-%m') AS m, count(DISTINCT d.cid) AS back
  FROM members LEFT JOIN d ON members.cid = d.cid GROUP BY ALL),
rates AS (
  SELECT cohort_month, total_users, {rnd("avg(back::DOUBLE / nullif(total_users, 0) * 100)")} AS average_retention_rate,
    count(DISTINCT m) AS n_months
  FROM active JOIN sizes USING (cohort_month) GROUP BY 1, 2)"""


def _ends(source: str, columns: str, value: str) -> str:
    return f"""(SELECT {columns}, 'top' AS category FROM {source}
  ORDER BY {value} DESC NULLS LAST, cohort_month NULLS FIRST LIMIT {TOP_K})
UNION ALL
(SELECT {columns}, 'bottom' FROM {source} ORDER BY {value} NULLS FIRST, cohort_month NULLS FIRST LIMIT {TOP_K})"""


ORACLE["avg_retention_by_cohort"] = f"{_RETENTION} SELECT cohort_month, total_users, average_retention_rate FROM rates"
ORACLE["top_bottom_retention"] = f"""{_RETENTION}, lasting AS (FROM rates WHERE n_months >= 12)
{_ends("lasting", "cohort_month, total_users, average_retention_rate", "average_retention_rate")}"""
_PURCHASES = f"""{_JOINED},
means AS (
  SELECT cohort_month, {rnd("avg(coalesce(n, 0))")} AS average_purchases_per_user
  FROM members LEFT JOIN (SELECT cid, count(*) AS n FROM d GROUP BY cid) USING (cid) GROUP BY 1)"""
ORACLE["avg_orders_by_cohort"] = f"{_PURCHASES} FROM means"
ORACLE["top_bottom_avg_orders"] = f"""{_PURCHASES}
{_ends("means", "cohort_month, average_purchases_per_user", "average_purchases_per_user")}"""
ORACLE["avg_orders_all_cohorts"] = f"""{_PURCHASES}
SELECT {rnd("avg(average_purchases_per_user)")} AS overall_average_purchases FROM means"""

# cleaning and profiling ----------------------------------------------------------------------------------------------

_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORACLE["null_rates"] = "WITH c AS (SELECT * REPLACE (nullif(c_mktsegment, 'BUILDING') AS c_mktsegment) FROM customer)\n" + (
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", {rnd(f"count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*)", 5)} AS null_pct FROM c"""
        for c in _CUSTOMER
    )
)
_PART = {
    "p_partkey": "bigint",
    "p_name": "string",
    "p_brand": "string",
    "p_type": "string",
    "p_size": "int",
    "p_retailprice": "double",
}
ORACLE["dataset_profile"] = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS missing FROM part"""
    for c, dtype in _PART.items()
)
ORACLE["distinct_values"] = "SELECT DISTINCT o_orderpriority FROM orders"
ORACLE["value_counts"] = """SELECT l_returnflag, count(*) AS "count" FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1"""
ORACLE["row_delta"] = f"""WITH {D}
SELECT 'orders' AS dataset, count(*) AS rows_before, count(*) FILTER (WHERE status = 'Paid') AS rows_after,
  {rnd("(count(*) - count(*) FILTER (WHERE status = 'Paid'))::DOUBLE / count(*) * 100")} AS deleted_pct
FROM d"""
_FEATURES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _histogram(tall: str) -> str:
    return f"""WITH tall AS ({tall}),
stats AS (
  SELECT feature, min(v) AS a, max(v) AS b, median(v) AS median, {rnd("avg(v)", 4)} AS mean,
    least(20, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END)) AS k
  FROM tall GROUP BY feature HAVING count(DISTINCT v) > 1),
placed AS (
  SELECT feature, a, b, k, median, mean, {big("least(k, floor(k::DOUBLE * (v - a) / (b - a)) + 1)")} AS bucket
  FROM tall JOIN stats USING (feature) WHERE v IS NOT NULL)
SELECT feature, bucket, a + (b - a) / k * (bucket - 1) AS lo, a + (b - a) / k * bucket AS hi, count(*) AS n, median, mean
FROM placed GROUP BY ALL"""


ORACLE["histogram_table"] = _histogram(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM lineitem" for c in _FEATURES)
)
ORACLE["histogram_of_times"] = _histogram("SELECT 'o_orderdate' AS feature, epoch_us(o_orderdate) / 1e6 AS v FROM orders")
ORACLE["duplicate_column_check"] = """WITH x AS (
  SELECT l_quantity + CASE WHEN l_linenumber = 6 THEN 0.5 ELSE 0 END AS q,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END END AS c FROM lineitem)
SELECT count(*) AS compared, count(*) FILTER (WHERE q IS DISTINCT FROM CAST(trunc(c) AS BIGINT)) AS different
FROM x WHERE c IS NOT NULL"""
ORACLE["coerce_types"] = """SELECT event_id, CAST(trunc(value) AS BIGINT) AS number_text,
  CAST(trunc(TRY_CAST(event_type AS DOUBLE)) AS BIGINT) AS bad_number, ts AS time_text,
  TRY_CAST(props AS TIMESTAMP) AS bad_time FROM events"""
ORACLE["drop_empty_columns"] = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
ORACLE["union_by_name"] = """SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment,
  CASE WHEN c_acctbal < 0 THEN c_acctbal END AS c_acctbal FROM customer"""

# whole tables in order

ORACLE["payment_gaps"] = f"""WITH {D}
SELECT cid AS customer_id, order_id AS first_action_id, ts AS order_ts,
  round({days("ts", "lag(ts) OVER w")}, 5) AS days_since_previous, round({days("lead(ts) OVER w", "ts")}, 5) AS days_to_next
FROM d WHERE status = 'Paid' AND cid IS NOT NULL WINDOW w AS (PARTITION BY cid ORDER BY ts, order_id)"""
ORACLE["running_revenue"] = f"""WITH {D}
SELECT order_id AS first_action_id, ts AS order_ts, count(*) OVER w AS payments_so_far, {dbl("sum(price) OVER w")} AS revenue_so_far
FROM d WHERE status = 'Paid' WINDOW w AS (ORDER BY ts, order_id ROWS UNBOUNDED PRECEDING)"""
ORACLE["donation_ranks"] = f"""WITH {D}
SELECT order_id AS first_action_id, {dbl("price")} AS total_price,
  row_number() OVER (ORDER BY price DESC, order_id) AS row_number, rank() OVER (ORDER BY price DESC) AS rank FROM d"""

# sources, tables, reports

_EXPORT = """export AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) END AS id_copy,
    CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS user_text,
    CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS VARCHAR) END AS moment FROM events)"""
ORACLE["csv_round_trip"] = "SELECT * FROM customer"
ORACLE["load_report"] = f"""WITH {_EXPORT},
counted AS (
  SELECT count(*) AS n, count(id) AS id, count(TRY_CAST(user_text AS BIGINT)) AS u, count(user_text) AS ut,
    count(TRY_CAST(moment AS TIMESTAMP)) AS m, count(moment) AS mt FROM export),
columns AS (
  SELECT 'id' AS "column", 'string' AS dtype, id AS non_null, NULL::BIGINT AS given, n FROM counted
  UNION ALL SELECT 'user', 'bigint', u, ut, n FROM counted
  UNION ALL SELECT 'moment', 'timestamp_ntz', m, mt, n FROM counted)
SELECT "column", dtype, non_null, n - non_null AS missing, round({dbl("n - non_null")} / n * 100, 5) AS null_pct,
  round({dbl("given - non_null")} / given, 5) AS lost, n AS rows_before, n AS rows_after FROM columns"""
ORACLE["published_tables"] = """SELECT coalesce(o.id, e.id) AS customer_id, n_donations, n_actions
FROM (SELECT o_custkey AS id, count(*) AS n_donations FROM orders GROUP BY 1) o
FULL JOIN (SELECT user_id AS id, count(*) AS n_actions FROM events GROUP BY 1) e ON o.id = e.id"""
ORACLE["sql_with_parameters"] = """SELECT o_custkey AS customer_id, count(*) AS n_orders, max(o_orderkey) AS last_order
FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' GROUP BY o_custkey"""
ORACLE["view_of_payers"] = "SELECT o_custkey AS customer_id, count(*) AS n_paid FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"
ORACLE["drop_columns_lenient"] = "SELECT * EXCLUDE (c_mktsegment) FROM customer"
ORACLE["drop_columns_strict"] = "SELECT * EXCLUDE (p_brand) FROM part"
ORACLE["schema_changes"] = f"""WITH {_EXPORT},
counted AS (SELECT count(id_copy) AS copies, count(user_text) AS users, count(moment) AS moments FROM export)
SELECT 'id_copy' AS "column", 'removed' AS change, 'string' AS type_before, NULL::VARCHAR AS type_after, copies AS n_values FROM counted
UNION ALL SELECT 'note', 'removed', 'string', NULL, 0 FROM counted
UNION ALL SELECT 'user', 'retyped', 'string', 'bigint', users FROM counted
UNION ALL SELECT 'moment', 'retyped', 'string', 'timestamp_ntz', moments FROM counted"""
ORACLE["random_customers"] = """SELECT c_custkey, c_name, c_mktsegment FROM customer
ORDER BY md5('7|=' || c_custkey || coalesce('|=' || c_name, '|') || coalesce('|=' || c_mktsegment, '|')), c_custkey LIMIT 50"""
ORACLE["random_orders_by_status"] = """SELECT o_orderstatus, o_orderkey, o_custkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7|=' || o_orderkey || '|=' || o_custkey), o_orderkey) <= 20"""
