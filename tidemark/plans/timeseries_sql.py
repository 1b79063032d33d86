"""SQL for DuckDB of the queries p1 to p6 that SQL expresses, written directly from the statement of each problem."""

from __future__ import annotations

#: Texts that time zones have, hours east of UTC.
_OFFSET = "CASE {z} WHEN 'Z' THEN 0 WHEN 'UTC' THEN 0 WHEN 'EET' THEN 7200 WHEN 'EEST' THEN 10800 ELSE (CASE WHEN {z}[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr({z}, 2, 2) AS INT) * 3600 + coalesce(TRY_CAST(substr(replace({z}, ':', ''), 4, 2) AS INT), 0) * 60) END"


def _parsed(table: str, key: str, text: str, zone: str, fold: str, more: str = "") -> str:
    """CTE ``<table>_t``: key, us, usual, twice and further columns; every form of TESTDATA by its own pattern."""
    patterns = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%d.%m.%Y %H:%M", "%Y%m%dT%H%M%S", "%d %b %Y %H:%M", "%d %b %Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S", "%b %d, %Y %I:%M %p"]
    tries = ", ".join(f"try_strptime(b, '{p}')" for p in patterns)
    return f"""
{table}_a AS (SELECT *, regexp_replace({text}, '[.,]\\d+(Z|z|[+-].*)?$', '\\1') AS s FROM {table}),
{table}_b AS (SELECT *, nullif(regexp_extract(s, '(?:[:\\d]\\d|T\\d{{6}})\\s*(Z|z|UTC|EET|EEST|Europe/Tallinn|[+-]\\d\\d:?(?:\\d\\d)?)$', 1), '') AS z FROM {table}_a),
{table}_c AS (SELECT *, upper(CASE WHEN z = 'Europe/Tallinn' THEN NULL ELSE z END) AS o, replace(trim(CASE WHEN z IS NULL OR regexp_matches(s, '^\\d{{4}}-\\d\\d-\\d\\d$') THEN s ELSE left(s, length(s) - length(z)) END), 't', 'T') AS b FROM {table}_b),
{table}_d AS (SELECT *, epoch_us(coalesce({tries})) AS wall,
  CASE WHEN regexp_matches(s, '^\\d{{10}}$') THEN CAST(s AS BIGINT) * 1000000 WHEN regexp_matches(s, '^\\d{{13}}$') THEN CAST(s AS BIGINT) * 1000 WHEN regexp_matches(s, '^\\d{{16}}$') THEN CAST(s AS BIGINT) END AS unix FROM {table}_c),
{table}_e AS (SELECT *, CASE WHEN unix IS NOT NULL THEN unix WHEN o IS NOT NULL THEN wall - CAST(1000000 AS BIGINT) * ({_OFFSET.format(z='o')}) END AS fixed,
  epoch_us(make_timestamp(wall) AT TIME ZONE '{zone}') AS there FROM {table}_d),
{table}_f AS (SELECT *, fixed IS NULL AND epoch_us((make_timestamptz(there - 3600000000)) AT TIME ZONE '{zone}') = wall AS later, fixed IS NULL AND epoch_us((make_timestamptz(there + 3600000000)) AT TIME ZONE '{zone}') = wall AS earlier FROM {table}_e),
{table}_g AS (SELECT *, CASE WHEN later THEN there - 3600000000 ELSE there END AS first_us, later OR earlier AS twice FROM {table}_f),
{table}_t AS (SELECT {key} AS rec_key, {more} coalesce(fixed, first_us + CASE WHEN twice AND {key} > min({key}) OVER (PARTITION BY {fold}) THEN 3600000000 ELSE 0 END) AS us,
  regexp_matches({text}, '^\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d$') AS usual, twice FROM {table}_g)"""


_TRAIN = _parsed("train", "row_id", "datetime", "Europe/Tallinn", "prediction_unit_id, is_consumption, datetime", "county, is_business, product_type, prediction_unit_id, is_consumption, data_block_id, target,")
_PRICES = _parsed("electricity_prices", "row_id", "forecast_date", "Europe/Tallinn", "forecast_date")
_PRSA = """
p_a AS (SELECT DISTINCT "No", year, month, day, hour FROM prsa_data),
p_b AS (SELECT *, regexp_matches(year, '^\\d{4}$') AND month IS NOT NULL AND day IS NOT NULL AND hour BETWEEN 0 AND 23 AS usual FROM p_a),
p_t AS (SELECT "No" AS rec_key, usual, CASE
  WHEN month IS NOT NULL THEN epoch_us(make_timestamp(CAST(CASE WHEN length(year) = 2 THEN '20' || year ELSE left(year, 4) END AS BIGINT), month, day, 0, 0, 0) + to_hours(hour - 8))
  WHEN regexp_matches(year, '^\\d{10}$') THEN CAST(year AS BIGINT) * 1000000
  WHEN regexp_matches(year, '^\\d{13}$') THEN CAST(year AS BIGINT) * 1000
  WHEN regexp_matches(year, '^\\d{4}/') THEN epoch_us(strptime(year, '%Y/%m/%d %H:%M') - INTERVAL 8 HOUR)
  WHEN year LIKE '%Z' THEN epoch_us(try_strptime(year, '%Y-%m-%dT%H:%M:%SZ'))
  WHEN year LIKE '%T%' THEN epoch_us(CAST(year AS TIMESTAMPTZ))
  ELSE epoch_us(try_strptime(left(year, length(year) - 6), '%d %b %Y %H:%M:%S') - to_seconds((CASE WHEN left(right(year, 5), 1) = '-' THEN -1 ELSE 1 END) * (CAST(left(right(year, 4), 2) AS INT) * 3600 + CAST(right(year, 2) AS INT) * 60))) END AS us FROM p_b)"""

P4 = f"""WITH {_TRAIN}, {_PRICES}, {_PRSA}
SELECT 'train' AS tab, rec_key, us AS utc_us FROM train_t WHERE us IS NOT NULL AND (NOT usual OR twice)
UNION ALL SELECT 'electricity_prices', rec_key, us FROM electricity_prices_t WHERE us IS NOT NULL AND (NOT usual OR twice)
UNION ALL SELECT 'prsa_data', rec_key, us FROM p_t WHERE us IS NOT NULL AND NOT usual"""

P1 = f"""WITH {_TRAIN},
counted AS (SELECT *, CAST(make_timestamptz(us) AT TIME ZONE 'Europe/Tallinn' AS DATE) AS d FROM train_t WHERE is_consumption = 1 AND us IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY prediction_unit_id, us ORDER BY data_block_id DESC, rec_key DESC) = 1),
daily AS (SELECT prediction_unit_id AS u, d, sum(target) AS s FROM counted GROUP BY ALL),
span AS (SELECT u, min(d) AS lo, max(d) AS hi FROM daily GROUP BY u),
days AS (SELECT u, lo, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM span),
sums AS (SELECT x.u, x.lo, x.d, coalesce(sum(CASE WHEN y.d > x.d - 7 THEN y.s END), 0) / 7 AS a7, coalesce(sum(y.s), 0) / 30 AS a30 FROM days x LEFT JOIN daily y ON y.u = x.u AND y.d <= x.d AND y.d > x.d - 30 GROUP BY ALL)
SELECT u AS prediction_unit_id, strftime(d, '%Y-%m-%d') AS day FROM sums WHERE d >= lo + 29 AND (a7 < 0.5 * a30 OR a7 > 2 * a30)"""

P1_TOTALS = P1[: P1.rindex("SELECT u AS prediction_unit_id")] + """SELECT x.u AS prediction_unit_id, CAST(x.d - DATE '1970-01-01' AS INT) AS day, CAST(x.lo - DATE '1970-01-01' AS INT) AS first_day, {value}, {sum_7}, {avg_7}, {sum_30}, {avg_30} FROM sums x LEFT JOIN daily y USING (u, d)""".format(
    **{k: f"round({e} + 1.3e-7, 6) + 0.0 AS {k}" for k, e in {"value": "coalesce(y.s, 0)", "sum_7": "x.a7 * 7", "avg_7": "x.a7", "sum_30": "x.a30 * 30", "avg_30": "x.a30"}.items()}
)
P3 = f"""WITH {_TRAIN},
ev AS (SELECT rec_key, county, is_business, product_type, CAST(make_timestamptz(us) AT TIME ZONE 'Europe/Tallinn' AS DATE) AS d FROM train_t WHERE us IS NOT NULL),
c AS (SELECT DISTINCT county, is_business, product_type, CAST(date AS DATE) AS cd, data_block_id AS b FROM client WHERE date IS NOT NULL),
pair AS (SELECT e.rec_key, max(ROW(c.cd, c.b)) AS by_date, max(CASE WHEN DATE '2023-10-09' + c.b <= e.d THEN ROW(c.cd, c.b) END) AS known
  FROM ev e JOIN c ON c.county = e.county AND c.is_business = e.is_business AND c.product_type = e.product_type AND c.cd < e.d GROUP BY e.rec_key)
SELECT rec_key AS row_id, coalesce(strftime(known[1], '%Y-%m-%d'), '') AS client_date, coalesce(known[2], -1) AS client_block FROM pair WHERE by_date IS DISTINCT FROM known"""

#: First deliveries of measurements, and per source and day (of event_time) when the source had passed the day's end: by an event
#: a lateness behind it, or in a silence of more than the idle time. {late} and {idle} are hours.
_CLOSES = """m AS (SELECT record_id, entity_id, source_id, feature_name, epoch_us(event_time) AS e, epoch_us(available_time) AS a, CASE WHEN NOT isnan(value_num) THEN value_num END AS v,
  (value_num IS NOT NULL AND NOT isnan(value_num)) OR value_cat IS NOT NULL AS present FROM record_log WHERE kind = 'measurement' AND event_time IS NOT NULL AND available_time IS NOT NULL),
arrivals AS (SELECT source_id, a, lead(a) OVER (PARTITION BY source_id ORDER BY a) AS nxt FROM (SELECT DISTINCT source_id, a FROM m)),
gaps AS (SELECT source_id, a AS lo, coalesce(nxt, 4000000000000000000) AS hi FROM arrivals
  UNION ALL SELECT source_id, (SELECT min(a) FROM m), min(a) FROM m GROUP BY source_id),
probe AS (SELECT d.day, s.source_id FROM (SELECT DISTINCT e // 86400000000 AS day FROM m) d, (SELECT DISTINCT source_id FROM m) s),
marks AS (SELECT source_id, (least(e, a) - {late} * 3600000000) // 86400000000 AS upto, min(a) AS a FROM m GROUP BY ALL),
by_mark AS (SELECT p.day, p.source_id, min(k.a) AS at FROM probe p LEFT JOIN marks k ON k.source_id = p.source_id AND k.upto > p.day GROUP BY ALL),
by_idle AS (SELECT p.day, p.source_id, min(greatest(g.lo + {idle} * 3600000000, (p.day + 1) * 86400000000 + {late} * 3600000000)) AS at FROM probe p
  JOIN gaps g ON g.source_id = p.source_id AND g.hi - g.lo > {idle} * 3600000000 AND g.hi >= (p.day + 1) * 86400000000 + {late} * 3600000000 GROUP BY ALL),
closes AS (SELECT day, max(least(x.at, y.at)) AS closed_us FROM by_mark x JOIN by_idle y USING (day, source_id) GROUP BY day),
placed AS (SELECT f.*, e // 86400000000 AS day, closed_us,
  CASE WHEN a > closed_us THEN 'closed' WHEN a - e > 72 * 3600000000 THEN 'cut_off' WHEN a <= (e // 86400000000 + 1) * 86400000000 + 6 * 3600000000 THEN 'first' ELSE 'correction' END AS place
  FROM (SELECT record_id, d.a, d.entity_id, d.source_id, d.feature_name, d.e, d.v, d.present FROM (SELECT record_id, min({{'a': a, 'entity_id': entity_id, 'source_id': source_id, 'feature_name': feature_name, 'e': e, 'v': v, 'present': present}}) AS d FROM m GROUP BY record_id)) f
  JOIN closes c ON c.day = f.e // 86400000000 WHERE present)"""

P3_CAPACITY = P3[: P3.rindex("SELECT rec_key AS row_id")] + """, r AS (SELECT county, is_business, product_type, CAST(date AS DATE) AS cd, data_block_id AS b, max(ROW(installed_capacity, eic_count)) AS c FROM client WHERE date IS NOT NULL GROUP BY ALL)
SELECT t.rec_key AS row_id, CAST(p.by_date[1] - DATE '1970-01-01' AS INT) AS by_date_day, CAST(p.by_date[2] AS INT) AS by_date_block, CAST(p.known[1] - DATE '1970-01-01' AS INT) AS known_day, CAST(p.known[2] AS INT) AS known_block, k.c[1] AS known_capacity
FROM train_t t LEFT JOIN pair p ON p.rec_key = t.rec_key LEFT JOIN r k ON k.county = t.county AND k.is_business = t.is_business AND k.product_type = t.product_type AND k.cd = p.known[1] AND k.b = p.known[2]"""

P5_EDITIONS = f"""WITH {_CLOSES.format(late=72, idle=48)}
SELECT entity_id, source_id, feature_name, day AS period, count(*) FILTER (place = 'first') AS first_n, sum(v) FILTER (place = 'first') AS first_sum,
  count(*) FILTER (place = 'correction') AS corrections, max(a) FILTER (place = 'correction') AS corrected_us, count(*) FILTER (place IN ('first', 'correction')) AS n,
  sum(v) FILTER (place IN ('first', 'correction')) AS sum, min(v) FILTER (place IN ('first', 'correction')) AS min, max(v) FILTER (place IN ('first', 'correction')) AS max,
  count(*) FILTER (place IN ('closed', 'cut_off')) AS diverted, max(closed_us) AS closed_us
FROM placed GROUP BY entity_id, source_id, feature_name, day"""

P5_DIVERTED = f"""WITH {_CLOSES.format(late=24, idle=6)}
SELECT record_id, entity_id, source_id, feature_name, strftime(make_timestamp(e), '%Y-%m-%d') AS day, e AS event_us, a AS available_us, closed_us, place FROM placed WHERE place IN ('closed', 'cut_off')"""

P4_INSTANTS = f"""WITH {_TRAIN}, {_PRICES}, {_PRSA},
a AS (SELECT 'train' AS tab, rec_key, us, usual, coalesce(twice, false) AS twice, first_us + 3600000000 = us AS second FROM train_t JOIN (SELECT row_id AS rec_key, first_us FROM train_g) USING (rec_key)
  UNION ALL SELECT 'electricity_prices', rec_key, us, usual, coalesce(twice, false), first_us + 3600000000 = us FROM electricity_prices_t JOIN (SELECT row_id AS rec_key, first_us FROM electricity_prices_g) USING (rec_key)
  UNION ALL SELECT 'prsa_data', rec_key, us, usual, false, false FROM p_t)
SELECT tab, rec_key, us AS utc_us, CASE WHEN us IS NULL THEN 'unparsed' WHEN twice AND second THEN 'second' WHEN twice THEN 'first' ELSE 'ok' END AS status, us IS NOT NULL AND coalesce(usual, false) AS usual FROM a"""

P5 = """WITH f AS (SELECT record_id, entity_id, source_id, feature_name, epoch_us(min(event_time)) AS e, epoch_us(min(available_time)) AS a FROM record_log
  WHERE kind = 'measurement' AND ((value_num IS NOT NULL AND NOT isnan(value_num)) OR value_cat IS NOT NULL) GROUP BY ALL)
SELECT DISTINCT entity_id, source_id, feature_name, strftime(make_timestamp(e), '%Y-%m-%d') AS day FROM f
WHERE a - e <= 72 * 3600000000 AND a > (e // 86400000000 + 1) * 86400000000 + 6 * 3600000000"""

P6 = """WITH r AS (SELECT DISTINCT "No" AS no, "PM2.5" AS pm, CASE WHEN lower(trim(station)) IN ('', '-', 'na', 'n/a', 'null', 'unknown', 'nan', 'none') THEN NULL ELSE trim(station) END AS st FROM prsa_data),
files AS (SELECT st, min(no) AS lo, max(no) AS hi FROM r WHERE st IS NOT NULL GROUP BY st),
named AS (SELECT r.no, r.pm, r.st, coalesce(r.st, f.st) AS station FROM r LEFT JOIN files f ON r.st IS NULL AND r.no BETWEEN f.lo AND f.hi)
SELECT no, 'PM2.5' AS field, station FROM named WHERE pm IS NULL OR isnan(pm) OR pm IN (-999, -9999)
UNION SELECT no, 'station', station FROM named WHERE st IS NULL"""

ORACLES = {"p1_found": P1, "p1_totals": P1_TOTALS, "p3_capacity": P3_CAPACITY, "p4_instants": P4_INSTANTS, "p3_found": P3, "p4_found": P4, "p5_found": P5, "p5_editions": P5_EDITIONS, "p5_diverted": P5_DIVERTED, "p6_found": P6}
