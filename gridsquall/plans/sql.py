"""The adapters of ``sources.adapters`` as DuckDB expressions, put before each oracle."""

BASE = """
ev AS (SELECT event_id, user_id AS sid, epoch_us(ts) AS us, event_type, value FROM events),
stations AS (SELECT DISTINCT sid, 52.0::DOUBLE + (sid*37 % 101)/1000.0::DOUBLE AS lat, 5.0::DOUBLE + (sid*53 % 103)/700.0::DOUBLE AS lon, (1.0 + sid % 9)::DOUBLE AS cap FROM ev),
series AS (SELECT sid, event_id, us, CASE WHEN event_type <> 'signup' THEN value/100.0::DOUBLE END AS k FROM ev),
steps AS (SELECT sid, event_id, lag(us) OVER w AS start_us, us AS end_us, (value - lag(value) OVER w)/100.0::DOUBLE AS delta_k FROM ev WINDOW w AS (PARTITION BY sid ORDER BY us, event_id)),
ramps AS (SELECT sid, event_id, start_us, end_us, delta_k, abs(delta_k) AS mag, CASE WHEN delta_k > 0 THEN 'up' ELSE 'down' END AS direction,
  (end_us - start_us)/6e7::DOUBLE AS duration_min, CASE WHEN start_us >= epoch_us(TIMESTAMP '2024-01-23') THEN 'test' ELSE 'train' END AS split
  FROM steps WHERE start_us IS NOT NULL AND abs(delta_k) >= 0.10),
wind AS (SELECT us // 3600000000 * 3600000000 AS us, avg(value)/10 AS speed, (sum(event_id)*37 % 360)::BIGINT AS dir FROM ev WHERE event_type = 'view' GROUP BY 1)
"""

HAVERSINE = "2*6371000.0::DOUBLE*asin(sqrt(least(1.0, power(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*power(sin(radians(b.lon-a.lon)/2),2))))"

PAIRS = f"""
pairs AS (SELECT a.sid AS i, b.sid AS j, a.lat AS lat_i, a.lon AS lon_i, b.lat AS lat_j, b.lon AS lon_j, {HAVERSINE} AS dist FROM stations a JOIN stations b ON a.sid < b.sid)
"""

#: Daily largest ramp of the training part, with an explicit 0 where a station had none.
DAILY = """
train AS (SELECT * FROM ramps WHERE split = 'train'),
daymax AS (SELECT sid, start_us // 86400000000 AS day, max(mag) AS m, arg_max((start_us % 86400000000) / 6e7, (mag, -start_us, -event_id)) AS minute FROM train GROUP BY 1, 2),
grid AS (SELECT s.sid, d.day FROM (SELECT DISTINCT sid FROM train) s, (SELECT DISTINCT day FROM daymax) d),
daily AS (SELECT g.sid, g.day, coalesce(x.m, 0.0) AS m, x.minute FROM grid g LEFT JOIN daymax x USING (sid, day)),
margins AS (SELECT sid, day, m, minute, row_number() OVER (PARTITION BY sid ORDER BY m, day) / (count(*) OVER (PARTITION BY sid) + 1.0)::DOUBLE AS u FROM daily)
"""


def sql(body: str, *parts: str) -> str:
    return "WITH " + ",".join((BASE, *parts)) + body
