"""Common table expressions that say in SQL what the sources and operators say in DataFrames."""

from __future__ import annotations

# Written out here, not taken from the operators, so that a wrong value there shows.
SIGNS = ["Aries", "Taurus", "Gemini", "Cancer", "Leo", "Virgo", "Libra", "Scorpio", "Sagittarius", "Capricorn", "Aquarius", "Pisces"]
NAKSHATRAS = [
    "Ashwini", "Bharani", "Krittika", "Rohini", "Mrigashira", "Ardra", "Punarvasu", "Pushya", "Ashlesha", "Magha", "Purva Phalguni", "Uttara Phalguni", "Hasta", "Chitra", "Swati",
    "Vishakha", "Anuradha", "Jyeshtha", "Moola", "Purva Ashadha", "Uttara Ashadha", "Shravana", "Dhanishta", "Shatabhisha", "Purva Bhadrapada", "Uttara Bhadrapada", "Revati",
]

BARS = """bars AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
 FROM (SELECT *, l_extendedprice / l_quantity AS p, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) GROUP BY 1, 2)"""

RET = (
    BARS
    + """, ret AS (SELECT symbol, date, open, high, low, close, volume,
 CASE WHEN prev > 0 THEN round_even((close - prev) / prev * 100, 4) END AS daily_return,
 CASE WHEN open > 0 AND prev > 0 THEN round_even((open - prev) / prev * 100, 4) END AS gap_pct,
 CASE WHEN open > 0 THEN round_even((high - low) / open * 100, 4) END AS daily_range_pct
 FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM bars))"""
)

_names = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_sign = "CAST(floor(lon / 30) AS INTEGER)"
_span = repr(360 / 27)
_nak = f"CAST(floor(lon / CAST({_span} AS DOUBLE)) AS INTEGER)"
_place = f"""{_sign} AS sign, {_names(SIGNS)}[{_sign} + 1] AS sign_name, {_nak} AS nakshatra, {_names(NAKSHATRAS)}[{_nak} + 1] AS nakshatra_name,
 CAST(floor((lon - floor(lon / CAST({_span} AS DOUBLE)) * CAST({_span} AS DOUBLE)) / (CAST({_span} AS DOUBLE) / 4)) + 1 AS INTEGER) AS nakshatra_pada"""
_dist = lambda a, b: f"least(abs({a} - {b}), 360 - abs({a} - {b}))"
_combust = "WHEN 'Moon' THEN 12.0 WHEN 'Mars' THEN 17.0 WHEN 'Mercury' THEN 14.0 WHEN 'Jupiter' THEN 11.0 WHEN 'Venus' THEN 10.0 WHEN 'Saturn' THEN 15.0"

CAL = BARS + ", cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM bars)"

_cents = "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT)"
POS = (
    CAL
    + f""", near AS (SELECT date, planet, CAST(cents % 36000000 AS DOUBLE) / 100000 AS lon FROM (SELECT CAST(l_shipdate AS DATE) AS date, ['Sun', 'Moon', 'Mars', 'Mercury', 'Jupiter', 'Venus', 'Saturn', 'Rahu'][l_suppkey % 8 + 1] AS planet, {_cents} AS cents FROM lineitem GROUP BY 1, 2)),
moved AS (SELECT *, lon - lag(lon) OVER (PARTITION BY planet ORDER BY date) AS d FROM near),
raw AS (SELECT date, planet, lon, round_even(lon, 6) AS longitude, round_even(coalesce(d - 360 * floor((d + 180) / 360), 0), 6) AS speed FROM moved),
nine AS (SELECT * FROM raw UNION ALL SELECT date, 'Ketu', lon, round_even(lon, 6), -speed FROM (SELECT date, longitude + 180 - 360 * floor((longitude + 180) / 360) AS lon, speed FROM raw WHERE planet = 'Rahu')),
pos AS (SELECT n.date, n.planet, n.longitude, n.speed, n.speed < 0 OR n.planet = 'Ketu' AS retrograde, {_place},
 coalesce({_dist('n.longitude', 's.longitude')} <= CASE n.planet {_combust} END, FALSE) AS combust FROM nine n LEFT JOIN (SELECT date, longitude FROM raw WHERE planet = 'Sun') s ON n.date = s.date)"""
)

_inside = "(lon - floor(lon / 30) * 30)"
MOON = f""", moon AS (SELECT date, time_ist, round_even(lon, 6) AS longitude, speed, {_place},
 ({_sign} IN (3, 7, 11) AND {_inside} > 26.67) OR ({_sign} IN (0, 4, 8) AND {_inside} < 3.33) AS gandanta
 FROM (SELECT date, time_ist, CAST(cents % 36000000 AS DOUBLE) / 100000 AS lon, CAST(cents % 1500 AS DOUBLE) / 100 AS speed
 FROM (SELECT CAST(l_shipdate AS DATE) AS date, ['09:15', '12:30', '14:45', '15:30'][l_linenumber % 4 + 1] AS time_ist, {_cents} AS cents FROM lineitem GROUP BY 1, 2)))"""

_pairs = "('Mars', 'Saturn'), ('Mars', 'Rahu'), ('Mercury', 'Rahu'), ('Saturn', 'Rahu'), ('Jupiter', 'Saturn'), ('Sun', 'Saturn'), ('Sun', 'Mercury')"
_bands = "WHEN d <= 10 THEN 'conjunction' WHEN abs(d - 180) <= 10 THEN 'opposition' WHEN abs(d - 90) <= 8 THEN 'square' WHEN abs(d - 120) <= 8 THEN 'trine'"
_orbs = "WHEN d <= 10 THEN round_even(d, 2) WHEN abs(d - 180) <= 10 THEN round_even(abs(d - 180), 2) WHEN abs(d - 90) <= 8 THEN round_even(abs(d - 90), 2) WHEN abs(d - 120) <= 8 THEN round_even(abs(d - 120), 2)"
ASP = f""", pair(planet_1, planet_2) AS (VALUES {_pairs}),
asp AS (SELECT date, planet_1, planet_2, aspect_type, round_even(d, 2) AS angle, orb, orb <= 1.0 AS exact FROM (
 SELECT *, CASE {_bands} END AS aspect_type, CASE {_orbs} END AS orb FROM (
 SELECT a.date, planet_1, planet_2, {_dist('a.longitude', 'b.longitude')} AS d FROM pair JOIN pos a ON a.planet = planet_1 JOIN pos b ON b.planet = planet_2 AND b.date = a.date)) WHERE aspect_type IS NOT NULL)"""

_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_STATIONS = ["Mercury", "Venus", "Mars", "Jupiter", "Saturn"]
EVT = f""", days AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM pos)),
chg AS (SELECT * FROM (SELECT *, lag(date) OVER w AS od, lag(nakshatra_name) OVER w AS onak, lag(sign_name) OVER w AS osign, lag(retrograde) OVER w AS oret FROM pos WINDOW w AS (PARTITION BY planet ORDER BY date)) JOIN days USING (date) WHERE od = before),
evt AS (SELECT date AS event_date, 'nakshatra_change' AS event_type, planet, onak AS from_value, nakshatra_name AS to_value, CASE WHEN nakshatra_name IN {_in(["Ardra", "Moola", "Jyeshtha"])} THEN 'high' ELSE 'normal' END AS severity FROM chg WHERE onak <> nakshatra_name
 UNION ALL SELECT date, 'sign_change', planet, osign, sign_name, 'normal' FROM chg WHERE osign <> sign_name
 UNION ALL SELECT date, CASE WHEN retrograde THEN 'retrograde_start' ELSE 'retrograde_end' END, planet, CASE WHEN oret THEN 'retrograde' ELSE 'direct' END, CASE WHEN retrograde THEN 'retrograde' ELSE 'direct' END, 'high' FROM chg WHERE oret <> retrograde AND planet IN {_in(_STATIONS)})"""

FAC = f""", fac AS (SELECT planet || ' Retrograde' AS factor, date FROM pos WHERE planet IN {_in(_STATIONS)} AND retrograde
 UNION SELECT planet_1 || '-' || planet_2 || ' Hard Aspect', date FROM asp WHERE aspect_type IN {_in(["conjunction", "opposition", "square"])}
 UNION SELECT 'Moon in ' || nakshatra_name, date FROM moon WHERE time_ist = '09:15' UNION SELECT 'Moon Gandanta', date FROM moon WHERE gandanta)"""

_flag = lambda p: f"bool_or(planet = '{p}' AND retrograde) AS {p.lower()}_r"
_kind = lambda a, b: f"arg_min(aspect_type, orb) FILTER (least(planet_1, planet_2) = '{min(a, b)}' AND greatest(planet_1, planet_2) = '{max(a, b)}') AS {a.lower()}_{b.lower()}_kind"
_near = lambda a, b: f"min(CASE WHEN least(planet_1, planet_2) = '{min(a, b)}' AND greatest(planet_1, planet_2) = '{max(a, b)}' THEN orb END) AS {a.lower()}_{b.lower()}"
_used = [("Saturn", "Rahu"), ("Jupiter", "Saturn"), ("Mars", "Saturn"), ("Mars", "Rahu"), ("Mercury", "Rahu")]
DAY = f""", day AS (SELECT d.date, r.* EXCLUDE (date, daily), h.* EXCLUDE (date, malefic), coalesce(h.malefic, 0) AS malefic, coalesce(nullif(m.nakshatra_name, ''), r.daily) AS moon_nakshatra, coalesce(m.gandanta, FALSE) AS gandanta
 FROM (SELECT DISTINCT date FROM ret) d
 LEFT JOIN (SELECT date, {', '.join(map(_flag, _STATIONS))}, max(CASE WHEN planet = 'Moon' THEN nakshatra_name END) AS daily FROM pos GROUP BY date) r ON r.date = d.date
 LEFT JOIN (SELECT date, {', '.join(_near(a, b) for a, b in _used)}, CAST(sum(CASE WHEN planet_1 IN {_in(["Mars", "Saturn", "Rahu", "Ketu"])} AND planet_2 IN {_in(["Mars", "Saturn", "Rahu", "Ketu"])} THEN 1 ELSE 0 END) AS BIGINT) AS malefic FROM asp WHERE aspect_type IN {_in(["conjunction", "opposition", "square"])} GROUP BY date) h ON h.date = d.date
 LEFT JOIN (SELECT * FROM moon WHERE time_ist = '09:15') m ON m.date = d.date)"""

_pts = lambda c, p: f"CASE WHEN {c} IS NULL THEN 0 WHEN {c} <= 1.0 THEN {p}.0 ELSE round_even(CAST(greatest(0, {p} * (1 - abs({c}) / 10)) AS DOUBLE), 1) END"
_yes = lambda c, p: f"CASE WHEN {c} THEN {p}.0 ELSE 0 END"
RISK = f""", dims AS (SELECT date,
 CAST(least({_yes('saturn_r', 8)} + {_yes('jupiter_r', 5)} + {_pts('saturn_rahu', 7)} + {_pts('jupiter_saturn', 5)}, 25) AS DOUBLE) AS structural,
 CAST(least({_yes('mars_r', 10)} + {_pts('mars_saturn', 10)} + {_pts('mars_rahu', 8)}, 25) AS DOUBLE) AS momentum,
 CAST(least({_yes(f'moon_nakshatra IN {_in(["Ardra", "Moola", "Jyeshtha", "Ashlesha"])}', 10)} + {_yes('gandanta', 8)} + CASE WHEN malefic >= 3 THEN 7 WHEN malefic = 2 THEN 4 ELSE 0 END, 25) AS DOUBLE) AS volatility,
 CAST(least({_yes('mercury_r', 12)} + {_pts('mercury_rahu', 10)} + {_yes('venus_r', 3)}, 25) AS DOUBLE) AS deception FROM day),
risk AS (SELECT *, CASE WHEN composite_score <= 30 THEN 'Accumulation' WHEN composite_score <= 50 THEN 'Expansion' WHEN composite_score <= 70 THEN 'Distribution' ELSE 'Capital Protection' END AS regime
 FROM (SELECT *, round_even(structural + momentum + volatility + deception, 1) AS composite_score FROM dims))"""

_parts = [
    ("structural", [("'Saturn Retrograde'", _yes("saturn_r", 8), "TRUE"), ("'Jupiter Retrograde'", _yes("jupiter_r", 5), "TRUE"), ("'Saturn-Rahu ' || saturn_rahu_kind", _pts("saturn_rahu", 7), "saturn_rahu <= 1.0"), ("'Jupiter-Saturn ' || jupiter_saturn_kind", _pts("jupiter_saturn", 5), "jupiter_saturn <= 1.0")]),
    ("momentum", [("'Mars Retrograde'", _yes("mars_r", 10), "TRUE"), ("'Mars-Saturn ' || mars_saturn_kind", _pts("mars_saturn", 10), "mars_saturn <= 1.0"), ("'Mars-Rahu ' || mars_rahu_kind", _pts("mars_rahu", 8), "mars_rahu <= 1.0")]),
    ("volatility", [("'Moon in ' || moon_nakshatra", _yes("moon_nakshatra IN ('Ardra', 'Moola', 'Jyeshtha', 'Ashlesha')", 10), "TRUE"), ("'Moon Gandanta'", _yes("gandanta", 8), "TRUE"), ("malefic || CASE WHEN malefic >= 3 THEN ' malefic aspects clustering' ELSE ' malefic aspects' END", "CASE WHEN malefic >= 3 THEN 7 WHEN malefic = 2 THEN 4 ELSE 0 END", "TRUE")]),
    ("deception", [("'Mercury Retrograde'", _yes("mercury_r", 12), "TRUE"), ("'Mercury-Rahu ' || mercury_rahu_kind", _pts("mercury_rahu", 10), "mercury_rahu <= 1.0"), ("'Venus Retrograde'", _yes("venus_r", 3), "TRUE")]),
]
_each = " UNION ALL ".join(f"SELECT date, '{d}' AS dim, {10 * i + j} AS place, {n} AS name, CAST({p} AS DOUBLE) AS points, coalesce({w}, FALSE) AS whole FROM kinds" for i, (d, fs) in enumerate(_parts) for j, (n, p, w) in enumerate(fs))
_num = lambda x, whole: f"CASE WHEN {whole} THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST(CAST({x} AS DECIMAL(10, 1)) AS VARCHAR) END"
TEXT = f""", kinds AS (SELECT day.*, k.* EXCLUDE (date) FROM day LEFT JOIN (SELECT date, {', '.join(_kind(a, b) for a, b in _used)} FROM asp WHERE aspect_type IN ('conjunction', 'opposition', 'square') GROUP BY date) k ON k.date = day.date),
each_part AS (SELECT * FROM ({_each}) WHERE points > 0),
top_parts AS (SELECT date, string_agg(name || ' (+' || {_num('points', 'whole')} || ')', ', ' ORDER BY points DESC, place) AS shown FROM (SELECT * FROM each_part QUALIFY row_number() OVER (PARTITION BY date ORDER BY points DESC, place) <= 3) GROUP BY 1),
broken AS (SELECT date, bool_or(b) AS broken FROM (SELECT date, dim, bool_or(NOT whole) AND sum(points) <= 25 AS b FROM each_part GROUP BY 1, 2) GROUP BY 1),
said AS (SELECT r.date, 'Risk ' || {_num('composite_score', 'NOT coalesce(broken, FALSE)')} || '/100 (' || regime || '). ' || coalesce('Key factors: ' || shown, 'No significant risk factors active.') AS explanation FROM risk r LEFT JOIN top_parts t ON t.date = r.date LEFT JOIN broken b ON b.date = r.date)"""

ALL = "WITH " + POS.replace(BARS, RET) + MOON + ASP + FAC + DAY + RISK
STATS = "count(*) AS n, avg(CASE WHEN daily_return < 0 THEN 100.0 ELSE 0.0 END) AS down, avg(daily_return) AS mean, coalesce(avg(daily_range_pct), 0) AS reach"
