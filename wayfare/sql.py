"""DuckDB SQL of the queries: shared relations, and one statement for each query that SQL can express."""

from __future__ import annotations

TRIPS = """raw AS (SELECT event_id AS order_id, user_id AS driver_id, ts AS departure_time,
  ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS finish_time, event_id % 25 AS origin_cluster_id,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 AS destination_cluster_id FROM events),
t AS (SELECT * FROM raw WHERE finish_time > departure_time)"""
LABELS = (
    TRIPS
    + """, m AS (SELECT *, max(finish_time) OVER (PARTITION BY driver_id ORDER BY departure_time, finish_time, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM t),
i AS (SELECT *, sum(CASE WHEN pm IS NULL OR departure_time >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY driver_id ORDER BY departure_time, finish_time, order_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
l AS (SELECT order_id, driver_id, departure_time, finish_time, origin_cluster_id, destination_cluster_id,
  CASE WHEN count(*) OVER (PARTITION BY driver_id, island) > 1 THEN 'carpool' ELSE 'exclusive' END AS service_type FROM i)"""
)


def _segments(daily: bool) -> str:
    key = "proc_date, driver_id" if daily else "driver_id"
    day = "proc_date, " if daily else ""
    name = "'carpool_' || driver_id || '_' || strftime(proc_date, '%Y-%m-%d') || '_' || CAST(g AS BIGINT)" if daily else "'carpool_' || driver_id || '_' || CAST(g AS BIGINT)"
    return (
        LABELS
        + f""", ld AS (SELECT *, CAST(departure_time AS DATE) AS proc_date FROM l),
cm AS (SELECT *, max(finish_time) OVER (PARTITION BY {key} ORDER BY departure_time, finish_time, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM ld WHERE service_type = 'carpool'),
ci AS (SELECT *, sum(CASE WHEN pm IS NULL OR departure_time >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY departure_time, finish_time, order_id ROWS UNBOUNDED PRECEDING) AS g FROM cm),
cg AS (SELECT {key}, {name} AS segment_id, min(departure_time) AS trip_start, max(finish_time) AS trip_end,
  first(origin_cluster_id ORDER BY departure_time, finish_time, order_id) AS origin_cluster_id, first(destination_cluster_id ORDER BY finish_time DESC, departure_time, order_id) AS destination_cluster_id,
  'carpool' AS service_type, string_agg(CAST(order_id AS VARCHAR), ',' ORDER BY departure_time, finish_time, order_id) AS order_ids FROM ci GROUP BY {key}, g),
ex AS (SELECT {key}, 'order_' || order_id AS segment_id, departure_time AS trip_start, finish_time AS trip_end, origin_cluster_id, destination_cluster_id, service_type, CAST(order_id AS VARCHAR) AS order_ids FROM ld WHERE service_type = 'exclusive'),
s AS (SELECT {key}, segment_id, trip_start, trip_end, origin_cluster_id, destination_cluster_id, service_type, order_ids FROM ex UNION ALL SELECT {key}, segment_id, trip_start, trip_end, origin_cluster_id, destination_cluster_id, service_type, order_ids FROM cg),
sd AS (SELECT *, strftime(trip_start, '%Y-%m-%d') AS date_, lag(trip_end) OVER w AS pe, lag(strftime(trip_start, '%Y-%m-%d')) OVER w AS pd FROM s WINDOW w AS (PARTITION BY {key} ORDER BY trip_start, trip_end, segment_id)),
ss AS (SELECT *, sum(CASE WHEN pd IS NULL OR epoch_us(trip_start) - epoch_us(pe) > 3600000000 OR pd <> date_ THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, date_ ORDER BY trip_start, trip_end, segment_id ROWS UNBOUNDED PRECEDING) AS chain_seq FROM sd),
sc AS (SELECT *, driver_id || '_' || date_ || '_' || CAST(chain_seq AS BIGINT) AS chain_id FROM ss),
sl AS (SELECT *, lead(trip_start) OVER (PARTITION BY {day}chain_id ORDER BY trip_start, trip_end, segment_id) AS idle_end FROM sc),
idle AS (SELECT {day}chain_id, driver_id, destination_cluster_id AS cluster_id, trip_end AS idle_start, idle_end, (epoch_us(idle_end) - epoch_us(trip_end)) / 60000000.0 AS idle_minutes FROM sl WHERE idle_end > trip_end AND epoch_us(idle_end) - epoch_us(trip_end) <= 3600000000)"""
    )


SEGMENTS, DAILY = _segments(False), _segments(True)


def _slots(source: str, a: str, b: str, columns: str) -> str:
    return f"SELECT {columns}, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, {a}, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 15 MINUTE, {b} - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01'), INTERVAL 15 MINUTE)) AS slot_start FROM {source}"


def _supply(daily: bool) -> str:
    day = "proc_date, " if daily else ""
    return (
        (DAILY if daily else SEGMENTS)
        + f""", ix AS ({_slots("idle", "idle_start", "idle_end", day + "driver_id, cluster_id")}),
sx AS ({_slots("s", "trip_start", "trip_end", day + "driver_id, origin_cluster_id, destination_cluster_id")}),
av AS (SELECT {day}slot_start, cluster_id, count(DISTINCT driver_id) AS available_vehicles FROM ix GROUP BY ALL),
seen AS (SELECT {day}slot_start, cluster_id, driver_id FROM ix UNION ALL SELECT {day}slot_start, origin_cluster_id, driver_id FROM sx UNION ALL SELECT {day}slot_start, destination_cluster_id, driver_id FROM sx),
gl AS (SELECT {day}slot_start, count(DISTINCT driver_id) AS global_fleet_lower_bound FROM seen GROUP BY ALL),
fl AS (SELECT {day}slot_start, cluster_id, fleet_lower_bound, global_fleet_lower_bound FROM (SELECT {day}slot_start, cluster_id, count(DISTINCT driver_id) AS fleet_lower_bound FROM seen GROUP BY ALL) JOIN gl USING ({day}slot_start))"""
    )


SUPPLY, DAILY_SUPPLY = _supply(False), _supply(True)
OD = LABELS + """, od AS (SELECT time_bucket(INTERVAL 15 MINUTE, departure_time, TIMESTAMP '1970-01-01') AS slot_start, origin_cluster_id, destination_cluster_id, count(*) FILTER (service_type = 'exclusive') AS exclusive_count, count(*) FILTER (service_type = 'carpool') AS carpool_count, count(*) AS total_count FROM l GROUP BY ALL)"""
ROADS = """seg0 AS (SELECT p_partkey AS seg_id, p_partkey // 3 AS u, CASE WHEN p_partkey % 7 = 0 THEN p_partkey // 6 ELSE p_partkey // 3 + 1 END AS v, p_brand AS name, p_partkey % 11 AS osmid, p_type AS highway, CAST(p_retailprice AS DOUBLE) AS length,
  CAST((p_partkey * 37) % 180 AS DOUBLE) AS bearing, p_partkey % 10 AS cluster_id, CAST((p_partkey * 7919) % 1000 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 1000 AS DOUBLE) AS y, p_size <= 5 AS is_connector FROM part),
seg AS (SELECT * FROM seg0 WHERE NOT is_connector), con AS (SELECT * FROM seg0 WHERE is_connector),
inc AS (SELECT DISTINCT seg_id, unnest([u, v]) AS node FROM seg),
pairs AS (SELECT a.seg_id AS seg_id_a, b.seg_id AS seg_id_b, count(*) AS n_nodes FROM inc a JOIN inc b ON a.node = b.node AND a.seg_id < b.seg_id GROUP BY ALL),
cpairs AS (SELECT least(l.seg_id, r.seg_id) AS seg_id_a, greatest(l.seg_id, r.seg_id) AS seg_id_b, con.seg_id AS connector_id, con.highway AS connector_highway FROM con JOIN inc l ON l.node = con.u JOIN inc r ON r.node = con.v AND l.seg_id <> r.seg_id)"""
EDGES = (
    ROADS
    + """, contrib AS (SELECT seg_id_a, seg_id_b, CAST(n_nodes AS DOUBLE) AS d, 0.0::DOUBLE AS c, NULL::VARCHAR AS id, NULL::VARCHAR AS kind FROM pairs UNION ALL SELECT seg_id_a, seg_id_b, 0.0, 0.8, CAST(connector_id AS VARCHAR), connector_highway FROM cpairs),
grp AS (SELECT seg_id_a, seg_id_b, sum(d) AS direct_weight, round(sum(c), 9) AS connector_weight, count(id) AS connector_count, coalesce(string_agg(DISTINCT id, '|' ORDER BY id), '') AS connector_ids, coalesce(string_agg(DISTINCT kind, '|' ORDER BY kind), '') AS connector_highways FROM contrib GROUP BY ALL),
scored AS (SELECT g.*, CASE WHEN a.name = b.name AND a.name <> '' THEN 2.0 ELSE 0.0 END + CASE WHEN a.osmid = b.osmid THEN 1.5 ELSE 0.0 END + CASE WHEN a.highway = b.highway AND a.highway <> '' THEN 0.5 ELSE 0.0 END
  + CASE WHEN least(abs(a.bearing - b.bearing) % 180, 180 - abs(a.bearing - b.bearing) % 180) <= 35 THEN 1.0 ELSE 0.0 END AS continuity_score, coalesce(a.name = b.name AND a.name <> '', false) AS same_name
  FROM grp g JOIN seg a ON a.seg_id = g.seg_id_a JOIN seg b ON b.seg_id = g.seg_id_b),
e AS (SELECT seg_id_a, seg_id_b, direct_weight, connector_weight, connector_count, CAST(continuity_score AS DOUBLE) AS continuity_score, CAST(continuity_score * 2 AS DOUBLE) AS continuity_weight, CAST(direct_weight + connector_weight + continuity_score * 2 AS DOUBLE) AS base_weight,
  direct_weight > 0 AS has_direct, connector_count > 0 AS has_connector, continuity_score > 0 AS has_continuity, same_name,
  concat_ws('|', CASE WHEN connector_count > 0 THEN 'connector' END, CASE WHEN continuity_score > 0 THEN 'continuity' END, CASE WHEN direct_weight > 0 THEN 'direct' END) AS relation_types, connector_ids, connector_highways FROM scored),
cut AS (SELECT e.*, a.cluster_id AS c_a, b.cluster_id AS c_b, a.cluster_id <> b.cluster_id AS is_cut FROM e JOIN seg a ON a.seg_id = e.seg_id_a JOIN seg b ON b.seg_id = e.seg_id_b)"""
)
FEATURES = (
    TRIPS
    + """, ends AS (SELECT order_id % 500 AS seg_id, true AS p, hour(departure_time) AS h, isodow(departure_time) <= 5 AS w FROM t UNION ALL SELECT driver_id, false, hour(departure_time), isodow(departure_time) <= 5 FROM t),
f0 AS (SELECT seg_id, count(*) FILTER (p) AS pickup_count, count(*) FILTER (NOT p) AS dropoff_count, count(*) AS order_total, count(*) FILTER (p AND h BETWEEN 7 AND 9) AS morning_peak_pickups, count(*) FILTER (p AND h BETWEEN 17 AND 18) AS evening_peak_pickups,
  count(*) FILTER (p AND (h >= 22 OR h < 6)) AS night_pickups, count(*) FILTER (p AND w) AS weekday_pickups, count(*) FILTER (p AND NOT w) AS weekend_pickups FROM ends GROUP BY seg_id),
f AS (SELECT *, pickup_count - dropoff_count AS pickup_dropoff_imbalance, weekday_pickups - weekend_pickups AS weekday_weekend_diff FROM f0)"""
)
POI = """poi AS (SELECT user_id AS seg_id, event_type AS category FROM events), pc AS (SELECT seg_id, category, count(*) AS n FROM poi GROUP BY ALL)"""
POI_FEATURES = POI + """, pf AS (SELECT seg.seg_id, coalesce(x.total, 0)::BIGINT AS poi_total, coalesce(x.total, 0) / (greatest(seg.length, 1.0) / 1000) AS poi_density,
  CASE WHEN kinds > 1 THEN (ln(x.total) - nlogn / x.total) / ln((SELECT count(DISTINCT category) FROM poi)) ELSE 0.0 END AS poi_entropy, dominant AS dominant_poi_type
  FROM seg LEFT JOIN (SELECT seg_id, sum(n) AS total, count(*) AS kinds, sum(n * ln(n)) AS nlogn, first(category ORDER BY n DESC, category) AS dominant FROM pc GROUP BY seg_id) x USING (seg_id))"""
TABLE = """ct AS (SELECT seg.cluster_id, count(*) AS num_segments, sum(length) AS total_length, sum(coalesce(order_total, 0))::BIGINT AS order_total FROM seg LEFT JOIN f USING (seg_id) GROUP BY ALL)"""
FLOWS = """od AS (SELECT l_shipdate AS slot_start, s_nationkey AS origin_cluster_id, c_nationkey AS destination_cluster_id, count(*) AS order_count FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"""
RUNS = """runs AS (SELECT p_brand AS run_id, round(avg((p_partkey % 97) / 97.0), 6) AS od_sparsity, round(avg((p_partkey % 89) / 89.0), 6) AS connector_cut_ratio, round(avg((p_partkey % 83) / 83.0), 6) AS continuity_cut_ratio, round(avg((p_partkey % 79) / 79.0), 6) AS order_count_cv,
  round(avg((p_partkey % 73) / 73.0), 6) AS poi_similarity, round(avg((p_partkey % 71) / 71.0), 6) AS order_similarity, CAST(sum(p_partkey % 2) % 4 <> 0 AS DOUBLE) AS connected_cluster_ratio, CAST(1 + sum(p_partkey) % 3 AS DOUBLE) AS mean_components,
  count(*) % 2 = 0 AS is_regularized, 10::BIGINT AS num_clusters, 'init_' || (sum(p_partkey) % 3) AS initialization FROM part GROUP BY p_brand)"""
BASELINES = """base AS (SELECT initialization, round(avg(od_sparsity), 6) AS od_sparsity, round(avg(connector_cut_ratio), 6) AS connector_cut_ratio, round(avg(continuity_cut_ratio), 6) AS continuity_cut_ratio, round(avg(order_count_cv), 6) AS order_count_cv FROM runs GROUP BY ALL)"""
#: The longest distance at which points meet lines in the spatial queries.
RADIUS = 120.0
SPATIAL = f"""pt AS (SELECT c_custkey AS point_id, CAST(c_acctbal AS DOUBLE) AS px, CAST(c_custkey % 1000 AS DOUBLE) AS py FROM customer),
ln0 AS (SELECT s_suppkey AS seg_id, CAST(s_acctbal AS DOUBLE) AS x0, CAST((s_suppkey * 37) % 1000 AS DOUBLE) AS y0 FROM supplier),
near0 AS (SELECT point_id, seg_id, px, py, x0, y0, least(1.0, greatest(0.0, ((px - x0) * 100.0 + (py - y0) * 50.0) / 12500.0)) AS k FROM pt JOIN ln0 ON px BETWEEN x0 - {RADIUS} AND x0 + 100 + {RADIUS} AND py BETWEEN y0 - {RADIUS} AND y0 + 50 + {RADIUS}),
near AS (SELECT point_id, seg_id, sqrt(pow(px - (x0 + k * 100.0), 2) + pow(py - (y0 + k * 50.0), 2)) AS distance FROM near0)"""
HINGE = "pow(greatest(0.5 - order_total / tg, 0), 2) + pow(greatest(order_total / tg - 1.5, 0), 2)"


def ratio(num: str, den: str) -> str:
    return f"round(CASE WHEN abs({den}) > 1e-9 THEN ({num}) / ({den}) END, 6)"


def cv(c: str) -> str:
    return f"round(CASE WHEN abs(avg({c})) > 1e-9 THEN stddev_pop({c}) / avg({c}) END, 6)"


def _cut(prefix: str, flag: str, weight: str) -> str:
    w = f"greatest(coalesce({weight}, 0), 0)"
    return f"count(*) FILTER ({flag}) AS {prefix}_edges, count(*) FILTER ({flag} AND is_cut) AS {prefix}_cut_edges, {ratio(f'sum(CASE WHEN {flag} AND is_cut THEN {w} ELSE 0 END)', f'sum(CASE WHEN {flag} THEN {w} ELSE 0 END)')} AS {prefix}_cut_ratio"


def _share(weight: str) -> str:
    return f"sum(CASE WHEN is_cut THEN greatest({weight}, 0) ELSE 0 END) / greatest(sum(greatest({weight}, 0)), 1e-12)"


def objective(roads: str) -> str:
    """The objective over relations ct (clusters' table) and cut."""
    return f"""{roads}, tgt AS (SELECT sum(order_total) / count(*) AS tg FROM ct), o1 AS (SELECT avg({HINGE}) AS r_cap FROM ct, tgt),
o2 AS (SELECT {_share("base_weight")} AS r_graph, {_share("continuity_weight")} AS r_cont, {_share("connector_weight")} AS r_conn FROM cut)"""


def topk(score: str, order: str, k: int, agg: str) -> str:
    return f"SELECT least(i, j) AS a, greatest(i, j) AS b, {agg} FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY {order}, j) AS r FROM ({score})) WHERE r <= {k} GROUP BY 1, 2"


_SEG_COLUMNS = "segment_id, driver_id, trip_start, trip_end, origin_cluster_id, destination_cluster_id, service_type, order_ids"
_CHAINS = """SELECT chain_id, driver_id, date_, CAST(chain_seq AS BIGINT) AS chain_seq, min(trip_start) AS chain_start, last(trip_end ORDER BY trip_start, trip_end, segment_id) AS chain_end, first(origin_cluster_id ORDER BY trip_start, trip_end, segment_id) AS start_cluster_id,
last(destination_cluster_id ORDER BY trip_start, trip_end, segment_id) AS end_cluster_id, count(*) AS num_segments, string_agg(segment_id, ',' ORDER BY trip_start, trip_end, segment_id) AS segment_ids FROM sc GROUP BY chain_id, driver_id, date_, chain_seq"""
_GRID = """cal AS (SELECT unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, min(a), TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 15 MINUTE, max(b) - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01'), INTERVAL 15 MINUTE)) AS slot_start FROM (SELECT trip_start AS a, trip_end AS b FROM s UNION ALL SELECT idle_start, idle_end FROM idle)),
uni AS (SELECT DISTINCT cluster_id FROM (SELECT origin_cluster_id AS cluster_id FROM s UNION ALL SELECT destination_cluster_id FROM s UNION ALL SELECT cluster_id FROM idle) WHERE cluster_id IS NOT NULL)"""
#: The grid of each day, from its segments alone: idle windows are between them.
_DAY_GRID = """cal AS (SELECT proc_date, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, min(trip_start), TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 15 MINUTE, max(trip_end) - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01'), INTERVAL 15 MINUTE)) AS slot_start FROM s GROUP BY proc_date),
uni AS (SELECT DISTINCT proc_date, cluster_id FROM (SELECT proc_date, origin_cluster_id AS cluster_id FROM s UNION ALL SELECT proc_date, destination_cluster_id FROM s UNION ALL SELECT proc_date, cluster_id FROM idle) WHERE cluster_id IS NOT NULL)"""
_POISIM = """pv AS (SELECT pf.seg_id, poi_total, ln(1 + poi_density) AS ld, poi_entropy FROM pf),
sp AS (SELECT greatest(max(ld) - min(ld), 1) AS d, greatest(max(poi_entropy) - min(poi_entropy), 1) AS en FROM pv),
nrm AS (SELECT seg_id, sqrt(sum(n * n)) AS nn FROM pc GROUP BY seg_id),
dt AS (SELECT e.seg_id_a, e.seg_id_b, sum(x.n * y.n) AS dot FROM e JOIN pc x ON x.seg_id = e.seg_id_a JOIN pc y ON y.seg_id = e.seg_id_b AND y.category = x.category GROUP BY ALL),
ps AS (SELECT e.*, CASE WHEN a.poi_total > 0 AND b.poi_total > 0 THEN 0.7 * coalesce(dot / (na.nn * nb.nn), 0) + 0.2 * greatest(0, 1 - abs(a.ld - b.ld) / d) + 0.1 * greatest(0, 1 - abs(a.poi_entropy - b.poi_entropy) / en) ELSE 0.0 END AS poi_similarity
  FROM e JOIN pv a ON a.seg_id = e.seg_id_a JOIN pv b ON b.seg_id = e.seg_id_b CROSS JOIN sp LEFT JOIN dt USING (seg_id_a, seg_id_b) LEFT JOIN nrm na ON na.seg_id = e.seg_id_a LEFT JOIN nrm nb ON nb.seg_id = e.seg_id_b)"""
_ORDER_COLUMNS = "pickup_count dropoff_count order_total pickup_dropoff_imbalance morning_peak_pickups evening_peak_pickups night_pickups weekday_pickups weekend_pickups weekday_weekend_diff".split()
_ORDSIM = f"""fv AS (SELECT seg_id, [{", ".join(f"sign({c}) * ln(1 + abs({c}))" for c in _ORDER_COLUMNS)}] AS v FROM f WHERE order_total > 0),
os AS (SELECT e.seg_id_a, e.seg_id_b, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 0.0 ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END AS order_similarity FROM e LEFT JOIN fv a ON a.seg_id = e.seg_id_a LEFT JOIN fv b ON b.seg_id = e.seg_id_b)"""
_SCORE_WEIGHTS = {"od_sparsity": 0.30, "connector_cut_ratio": 0.30, "order_count_cv": 0.20, "continuity_cut_ratio": 0.20}


def _scaled(m: str) -> str:
    return f"coalesce(CASE WHEN max({m}) OVER () > min({m}) OVER () THEN ({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ()) ELSE 0 END, 0)"


SCORED = RUNS + f""", scored AS (SELECT *, {" + ".join(f"{w} * {_scaled(m)}" for m, w in _SCORE_WEIGHTS.items())} AS balanced_score FROM runs WHERE is_regularized)"""


def _dominated(x: str, y: str, table: str = "runs") -> str:
    return f"EXISTS (SELECT 1 FROM {table} o WHERE o.{x} <= r.{x} AND o.{y} <= r.{y} AND (o.{x} < r.{x} OR o.{y} < r.{y}))"


_HOLD = lambda m, s: f"coalesce(r.{m} <= CASE WHEN abs(b.{m}) <= 1e-12 THEN b.{m} + {s} ELSE b.{m} + {s} * abs(b.{m}) END, false)"
_ALL3 = "o.od_sparsity <= r.od_sparsity AND o.connector_cut_ratio <= r.connector_cut_ratio AND o.order_count_cv <= r.order_count_cv AND (o.od_sparsity < r.od_sparsity OR o.connector_cut_ratio < r.connector_cut_ratio OR o.order_count_cv < r.order_count_cv)"

#: Edges inside clusters both ways, their components, and each cluster's.
_INNER = """lo AS (SELECT seg_id_a AS a, seg_id_b AS b FROM cut WHERE NOT is_cut), bo AS (SELECT a, b FROM lo UNION ALL SELECT b, a FROM lo),
re AS (SELECT a AS node, a AS root FROM bo UNION SELECT bo.b, re.root FROM re JOIN bo ON bo.a = re.node WHERE re.root < bo.b), cm AS (SELECT node, min(root) AS component FROM re GROUP BY ALL),
lab AS (SELECT seg.seg_id, seg.cluster_id, seg.length, coalesce(cm.component, seg.seg_id) AS component FROM seg LEFT JOIN cm ON cm.node = seg.seg_id)"""
CONNECTED = _INNER + """, pt AS (SELECT cluster_id, component, count(*) AS n FROM lab GROUP BY ALL), ec AS (SELECT cluster_id, count(*) AS c, max(n) / sum(n) AS share FROM pt GROUP BY ALL)"""


def _sweep(name: str, start: str) -> str:
    """Least distances from the nodes of a relation of starts (node), each within its component."""
    return f"""{name} (node, dist) USING KEY (node) AS (SELECT node, 0.0::DOUBLE FROM {start} UNION SELECT w.b, min({name}.dist + w.w) FROM {name} JOIN w ON w.a = {name}.node LEFT JOIN recurring.{name} AS old ON old.node = w.b WHERE old.dist IS NULL OR {name}.dist + w.w < old.dist GROUP BY w.b)"""


_MOVE_TABLE = """seg2 AS (SELECT seg.* REPLACE (CASE WHEN seg_id = (SELECT min(seg_id) FROM seg) THEN 3 ELSE cluster_id END AS cluster_id) FROM seg), ct2 AS (SELECT x.cluster_id, sum(coalesce(order_total, 0))::BIGINT AS order_total FROM seg2 x LEFT JOIN f USING (seg_id) GROUP BY ALL), tgt2 AS (SELECT sum(order_total) / count(*) AS tg FROM ct2),
cut2 AS (SELECT e.*, a.cluster_id <> b.cluster_id AS is_cut FROM e JOIN seg2 a ON a.seg_id = e.seg_id_a JOIN seg2 b ON b.seg_id = e.seg_id_b)"""


ORACLES: dict[str, str] = {
    "valid_trips": f"WITH {TRIPS} SELECT * FROM t",
    "staging_counters": f"""WITH {TRIPS}, c AS (SELECT *, coalesce(finish_time > departure_time, false) AS ok FROM raw), w AS (SELECT *, ok AND departure_time >= TIMESTAMP '2024-01-05' AND departure_time < TIMESTAMP '2024-01-20' AS win FROM c)
SELECT count(*) AS rows_read, count(*) FILTER (NOT ok) AS invalid_time, count(*) FILTER (ok AND NOT win) AS outside_window, count(*) FILTER (win) AS in_window, count(*) FILTER (win AND driver_id IS NULL) AS invalid_driver,
count(*) FILTER (win AND (origin_cluster_id IS NULL OR destination_cluster_id IS NULL)) AS unmatched, count(*) FILTER (win AND driver_id IS NOT NULL AND origin_cluster_id IS NOT NULL AND destination_cluster_id IS NOT NULL) AS staged FROM w""",
    "service_labels": f"WITH {LABELS} SELECT order_id, service_type FROM l",
    "service_type_counts": f"WITH {LABELS} SELECT service_type, count(*) AS n, count(DISTINCT driver_id) AS drivers FROM l GROUP BY ALL",
    "assigned_orders": f"WITH {LABELS} SELECT order_id, driver_id, strftime(departure_time, '%Y-%m-%d %H:%M:%S') AS departure_time, strftime(finish_time, '%Y-%m-%d %H:%M:%S') AS finish_time, CAST(origin_cluster_id AS VARCHAR) AS origin_cluster_id, CAST(destination_cluster_id AS VARCHAR) AS destination_cluster_id, service_type FROM l",
    "od_slots_15min": f"WITH {OD} SELECT * FROM od",
    "od_bounds": f"WITH {TRIPS} SELECT time_bucket(INTERVAL 15 MINUTE, min(departure_time), TIMESTAMP '1970-01-01') AS first_slot, time_bucket(INTERVAL 15 MINUTE, max(departure_time), TIMESTAMP '1970-01-01') AS last_slot FROM t",
    "slot_calendar": f"WITH {TRIPS} SELECT unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, min(departure_time), TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 15 MINUTE, max(departure_time), TIMESTAMP '1970-01-01'), INTERVAL 15 MINUTE)) AS slot_start FROM t",
    "od_tensor_dense": f"""WITH {OD}, cal AS (SELECT unnest(generate_series(min(slot_start), max(slot_start), INTERVAL 15 MINUTE)) AS slot_start FROM od), ix AS (SELECT DISTINCT origin_cluster_id AS id FROM l)
SELECT cal.slot_start, o.id AS o, d.id AS d, coalesce(exclusive_count, 0) AS y_exclusive, coalesce(carpool_count, 0) AS y_carpool, coalesce(total_count, 0) AS y_total FROM cal CROSS JOIN ix o CROSS JOIN ix d LEFT JOIN od ON od.slot_start = cal.slot_start AND od.origin_cluster_id = o.id AND od.destination_cluster_id = d.id""",
    "carpool_groups": f"WITH {SEGMENTS} SELECT {_SEG_COLUMNS} FROM cg",
    "exclusive_segments": f"WITH {SEGMENTS} SELECT {_SEG_COLUMNS} FROM ex",
    "trip_segments": f"WITH {SEGMENTS} SELECT {_SEG_COLUMNS} FROM s",
    "driver_chains": f"WITH {SEGMENTS} {_CHAINS}",
    "idle_windows": f"WITH {SEGMENTS} SELECT chain_id, driver_id, cluster_id, idle_start, idle_end, round(idle_minutes, 6) AS idle_minutes FROM idle",
    "driver_slot_expansion": f"WITH {SEGMENTS} {_slots('s', 'trip_start', 'trip_end', 'segment_id, driver_id')}",
    "supply_available": f"WITH {SUPPLY}, {_GRID} SELECT slot_start, cluster_id, coalesce(available_vehicles, 0) AS available_vehicles FROM cal CROSS JOIN uni LEFT JOIN av USING (slot_start, cluster_id)",
    "supply_in_service_od": f"WITH {SUPPLY} SELECT slot_start, origin_cluster_id, destination_cluster_id, count(DISTINCT driver_id) AS in_service_vehicles FROM sx GROUP BY ALL",
    "fleet_lower_bound": f"WITH {SUPPLY} SELECT * FROM fl",
    "supply_demand_merge": f"WITH {SUPPLY}, dm AS (SELECT time_bucket(INTERVAL 15 MINUTE, departure_time, TIMESTAMP '1970-01-01') AS slot_start, origin_cluster_id AS cluster_id, count(*) AS demand FROM l GROUP BY ALL) SELECT slot_start, CAST(cluster_id AS VARCHAR) AS cluster_id, demand, available_vehicles, fleet_lower_bound, global_fleet_lower_bound FROM dm LEFT JOIN av USING (slot_start, cluster_id) LEFT JOIN fl USING (slot_start, cluster_id)",
    "supply_daily_mode": f"WITH {DAILY} SELECT proc_date, {_SEG_COLUMNS} FROM s",
    "supply_daily_chains": f"WITH {DAILY} {_CHAINS}".replace("SELECT chain_id, driver_id, date_", "SELECT proc_date, chain_id, driver_id, date_").replace("GROUP BY chain_id", "GROUP BY proc_date, chain_id"),
    "supply_daily_idle": f"WITH {DAILY} SELECT proc_date, chain_id, driver_id, cluster_id, idle_start, idle_end, round(idle_minutes, 6) AS idle_minutes FROM idle",
    "supply_daily_available": f"WITH {DAILY_SUPPLY}, {_DAY_GRID} SELECT proc_date, slot_start, cluster_id, coalesce(available_vehicles, 0) AS available_vehicles FROM cal JOIN uni USING (proc_date) LEFT JOIN av USING (proc_date, slot_start, cluster_id)",
    "supply_daily_in_service": f"WITH {DAILY_SUPPLY} SELECT proc_date, slot_start, origin_cluster_id, destination_cluster_id, count(DISTINCT driver_id) AS in_service_vehicles FROM sx GROUP BY ALL",
    "supply_daily_fleet": f"WITH {DAILY_SUPPLY}, {_DAY_GRID} SELECT proc_date, slot_start, cluster_id, coalesce(fleet_lower_bound, 0) AS fleet_lower_bound, coalesce(gl.global_fleet_lower_bound, 0) AS global_fleet_lower_bound FROM cal JOIN uni USING (proc_date) LEFT JOIN (SELECT proc_date, slot_start, cluster_id, fleet_lower_bound FROM fl) USING (proc_date, slot_start, cluster_id) LEFT JOIN gl USING (proc_date, slot_start)",
    "departure_dates": f"WITH {TRIPS} SELECT DISTINCT CAST(departure_time AS DATE) AS date_ FROM t",
    "segment_order_features": f"WITH {FEATURES} SELECT * FROM f",
    "segment_od_pairs": f"WITH {TRIPS} SELECT origin_cluster_id, destination_cluster_id, count(*) AS order_count FROM t GROUP BY ALL",
    "hourly_od_weekday": f"WITH {TRIPS} SELECT time_bucket(INTERVAL 1 HOUR, departure_time, TIMESTAMP '1970-01-01') AS slot_start, origin_cluster_id, destination_cluster_id, count(*) AS order_count FROM t WHERE isodow(departure_time) <= 5 AND origin_cluster_id IS NOT NULL AND destination_cluster_id IS NOT NULL GROUP BY ALL",
    "category_mapping": f"WITH {POI} SELECT 'poi_cat_' || lpad(CAST(row_number() OVER (ORDER BY category) - 1 AS VARCHAR), 2, '0') AS category_col, category FROM (SELECT DISTINCT category FROM poi)",
    "poi_counts": f"WITH {POI} SELECT * FROM pc",
    "poi_counts_wide": f"WITH {ROADS}, {POI} SELECT seg.seg_id, count(*) FILTER (category = 'click') AS poi_cat_00, count(*) FILTER (category = 'error') AS poi_cat_01, count(*) FILTER (category = 'purchase') AS poi_cat_02, count(*) FILTER (category = 'signup') AS poi_cat_03, count(*) FILTER (category = 'view') AS poi_cat_04, count(category) AS poi_total FROM seg LEFT JOIN poi USING (seg_id) GROUP BY ALL",
    "poi_features": f"WITH {ROADS}, {POI_FEATURES} SELECT seg_id, poi_total, round(poi_density, 6) AS poi_density, round(poi_entropy, 6) AS poi_entropy, dominant_poi_type FROM pf",
    "segment_roles": "SELECT p_partkey AS seg_id, CASE WHEN p_type LIKE '%STEEL' AND p_retailprice <= 1200 THEN 'connector' ELSE 'ordinary' END AS segment_role FROM part",
    "name_match": "SELECT p_partkey AS seg_id, replace(trim(p_brand), ' ', '') AS normalized_name FROM part WHERE contains(replace(trim(p_brand), ' ', ''), '1') AND NOT contains(replace(trim(p_brand), ' ', ''), '3')",
    "access_filter": """SELECT p_partkey AS seg_id, CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false WHEN p_size % 5 = 0 THEN false ELSE true END AS allowed,
CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'motor_vehicle=no' WHEN p_size % 5 = 0 THEN 'access=private' END AS reason FROM part""",
    "service_filter": "SELECT p_partkey AS seg_id FROM part WHERE NOT (p_size % 4 = 0 AND p_size % 3 = 0)",
    "incident_pairs": f"WITH {ROADS} SELECT * FROM pairs",
    "connector_pairs": f"WITH {ROADS} SELECT * FROM cpairs",
    "relation_edges": f"WITH {EDGES} SELECT * FROM e",
    "poi_similarity": f"WITH {EDGES}, {POI_FEATURES}, {_POISIM} SELECT seg_id_a, seg_id_b, round(poi_similarity, 6) AS poi_similarity FROM ps",
    "order_similarity": f"WITH {EDGES}, {FEATURES}, {_ORDSIM} SELECT seg_id_a, seg_id_b, round(order_similarity, 6) AS order_similarity FROM os",
    "edge_variants": f"WITH {EDGES}, {POI_FEATURES}, {_POISIM}, {FEATURES}, {_ORDSIM}, vr(variant, p, o) AS (VALUES ('road', 0.0, 0.0), ('road_poi', 1.0, 0.0), ('road_poi_order', 1.0, 1.0)) SELECT variant, seg_id_a, seg_id_b, round(base_weight + p * poi_similarity + o * order_similarity, 6) AS weight FROM ps JOIN os USING (seg_id_a, seg_id_b) CROSS JOIN vr",
    "bearing_angle": "SELECT s_suppkey AS seg_id, round(((degrees(atan2(((s_suppkey * 37) % 1000)::DOUBLE - 500, s_acctbal::DOUBLE)) % 180) + 180) % 180, 6) AS bearing FROM supplier",
    "cluster_road_edges": f"WITH {EDGES} SELECT least(c_a, c_b) AS cluster_a, greatest(c_a, c_b) AS cluster_b, round(sum(greatest(base_weight, 0)), 6) AS weight, count(*) AS edge_count FROM cut WHERE is_cut GROUP BY ALL",
    "cluster_index": f"WITH {ROADS} SELECT cluster_id, count(*) AS num_segments, round(sum(length), 6) AS total_length_m, round(sum(x * length) / sum(length), 6) AS centroid_x, round(sum(y * length) / sum(length), 6) AS centroid_y FROM seg GROUP BY ALL",
    "cluster_summary": f"WITH {ROADS}, k AS (SELECT cluster_id, highway, count(*) AS n FROM seg GROUP BY ALL) SELECT cluster_id, num_segments, total_length, dominant_highway, num_names FROM (SELECT cluster_id, count(*) AS num_segments, round(sum(length), 6) AS total_length, count(DISTINCT name) AS num_names FROM seg GROUP BY ALL) JOIN (SELECT cluster_id, first(highway ORDER BY n DESC, highway) AS dominant_highway FROM k GROUP BY ALL) USING (cluster_id)",
    "road_name_diagnostics": f"WITH {ROADS} SELECT name, count(*) AS num_segments, count(DISTINCT cluster_id) AS num_clusters, round(sum(length), 6) AS total_length FROM seg WHERE trim(name) <> '' GROUP BY ALL HAVING count(*) > 1",
    "cluster_poi_topk": f"WITH {POI}, v AS (SELECT seg_id % 50 AS id, category AS key, sum(n)::DOUBLE AS value FROM pc GROUP BY ALL), nn AS (SELECT id, sqrt(sum(value * value)) AS norm FROM v GROUP BY ALL), un AS (SELECT v.id, key, value / norm AS w FROM v JOIN nn USING (id)), sc AS (SELECT a.id AS i, b.id AS j, round(sum(a.w * b.w), 9) AS score FROM un a JOIN un b ON a.key = b.key AND a.id <> b.id GROUP BY ALL) {topk('SELECT * FROM sc WHERE score > 0', 'score DESC', 10, 'round(max(score), 6) AS weight')}",
    "distance_topk": f"WITH {ROADS}, c AS (SELECT cluster_id, sum(x * length) / sum(length) AS cx, sum(y * length) / sum(length) AS cy FROM seg GROUP BY ALL), dd AS (SELECT p.cluster_id AS i, q.cluster_id AS j, sqrt(pow(p.cx - q.cx, 2) + pow(p.cy - q.cy, 2)) AS dist FROM c p JOIN c q ON p.cluster_id <> q.cluster_id) {topk('SELECT * FROM dd', 'dist', 3, 'round(max(exp(-dist / 3000.0)), 6) AS weight, round(min(dist), 6) AS distance')}",
    "adjacency_normalized": f"WITH {EDGES}, g AS (SELECT least(c_a, c_b) AS a, greatest(c_a, c_b) AS b, sum(greatest(base_weight, 0)) AS w FROM cut WHERE is_cut GROUP BY ALL), fu AS (SELECT a AS r, b AS c, w FROM g UNION ALL SELECT b, a, w FROM g UNION ALL SELECT DISTINCT cluster_id, cluster_id, 1.0 FROM seg), dg AS (SELECT r, sum(w) AS d FROM fu GROUP BY ALL) SELECT fu.r AS row, fu.c AS col, round(w / sqrt(x.d) / sqrt(y.d), 6) AS value FROM fu JOIN dg x ON x.r = fu.r JOIN dg y ON y.r = fu.c",
    "nearest_segment": f"WITH {SPATIAL}, b AS (SELECT point_id, seg_id, distance, row_number() OVER (PARTITION BY point_id ORDER BY distance, seg_id) AS r FROM near WHERE distance <= {RADIUS}) SELECT pt.point_id, b.seg_id, round(b.distance, 6) AS distance FROM pt LEFT JOIN b ON b.point_id = pt.point_id AND r = 1",
    "point_in_buffer": f"WITH {SPATIAL} SELECT point_id, seg_id, round(distance, 6) AS distance FROM near WHERE distance < {RADIUS}",
    "edge_cut_metrics": f"WITH {EDGES} SELECT {_cut('direct', 'has_direct', 'direct_weight')}, {_cut('connector', 'has_connector', 'connector_weight')}, {_cut('continuity', 'has_continuity', 'continuity_weight')}, round(avg(CAST(is_cut AS DOUBLE)), 6) AS edge_cut_ratio FROM cut",
    "connector_type_metrics": f"WITH {EDGES}, x AS (SELECT *, unnest(CASE WHEN connector_highways = '' THEN ['unknown'] ELSE string_split(connector_highways, '|') END) AS connector_type FROM cut WHERE has_connector) SELECT connector_type, count(*) AS edges, count(*) FILTER (is_cut) AS cut_edges, round(avg(CAST(is_cut AS DOUBLE)), 6) AS cut_ratio, {ratio('sum(CASE WHEN is_cut THEN connector_weight ELSE 0 END)', 'sum(connector_weight)')} AS weight_cut_ratio FROM x GROUP BY ALL",
    "road_integrity": f"WITH {EDGES}, p AS (SELECT name, cluster_id, sum(length) AS len FROM seg WHERE trim(name) <> '' GROUP BY ALL), n AS (SELECT name, count(*) AS k, sum(len) AS total, max(len) / (sum(len) + 1e-9) AS share FROM p GROUP BY ALL) SELECT round(avg(k), 6) AS mean_clusters_per_name, round(avg(share), 6) AS mean_dominant_share, {ratio('sum(share * total)', 'sum(total)')} AS weighted_dominant_share, (SELECT round(avg(CAST(is_cut AS DOUBLE)) FILTER (same_name), 6) FROM cut) AS same_name_cut_ratio FROM n",
    "cluster_table": f"WITH {ROADS}, {FEATURES}, {TABLE} SELECT cluster_id, num_segments, round(total_length, 6) AS total_length, order_total FROM ct",
    "cluster_cv": f"WITH {ROADS}, {FEATURES}, {TABLE} SELECT count(*) AS num_clusters, {cv('num_segments')} AS segment_count_cv, {cv('total_length')} AS length_cv, {cv('order_total')} AS order_count_cv FROM ct",
    "length_spread": f"WITH {ROADS} SELECT round(avg(length), 6) AS length_mean, min(length) AS length_min, max(length) AS length_max, round(quantile_cont(length, 0.5), 6) AS length_median FROM seg",
    "small_clusters": f"WITH {ROADS}, {FEATURES}, {TABLE} SELECT count(*) FILTER (num_segments < 5 OR total_length < 1000 OR order_total < 100) AS small_clusters, round(avg(CAST(num_segments < 5 OR total_length < 1000 OR order_total < 100 AS DOUBLE)), 6) AS small_cluster_ratio FROM ct",
    "capacity_metrics": f"WITH {ROADS}, {FEATURES}, {TABLE}, tgt AS (SELECT avg(order_total) AS tg FROM ct) SELECT round(avg(CAST(NOT (order_total >= 0.5 * tg AND order_total <= 1.5 * tg) AS DOUBLE)), 6) AS capacity_violation_ratio, round(avg({HINGE}), 6) AS capacity_hinge_loss FROM ct, tgt",
    "wss": f"WITH {ROADS}, {FEATURES}, j AS (SELECT f.*, seg.cluster_id FROM f JOIN seg USING (seg_id)), q AS (SELECT pow(pickup_count - avg(pickup_count) OVER w, 2) + pow(dropoff_count - avg(dropoff_count) OVER w, 2) AS s FROM j WINDOW w AS (PARTITION BY cluster_id)) SELECT round(sum(s), 4) AS order_wss, round(sum(s) / count(*), 6) AS order_wss_per_segment FROM q",
    "poi_cluster_entropy": f"WITH {ROADS}, {POI}, lg AS (SELECT cluster_id, category, sum(n) AS n FROM pc JOIN seg USING (seg_id) GROUP BY ALL), tt AS (SELECT cluster_id, sum(n) AS total, max(n) AS top FROM lg GROUP BY ALL), en AS (SELECT cluster_id, -sum(n / total * ln(n / total + 1e-9)) AS entropy FROM lg JOIN tt USING (cluster_id) GROUP BY ALL) SELECT round(avg(entropy), 6) AS poi_entropy_mean, round(avg(top / total), 6) AS poi_purity_mean, round(sum(entropy * total) / sum(total), 6) AS poi_entropy_weighted, round(sum(top / total * total) / sum(total), 6) AS poi_purity_weighted FROM tt JOIN en USING (cluster_id)",
    "imbalance_var": f"WITH {ROADS}, {FEATURES}, v AS (SELECT cluster_id, var_pop((pickup_count - dropoff_count) / (pickup_count + dropoff_count + 1e-9)) AS v FROM f JOIN seg USING (seg_id) GROUP BY ALL) SELECT round(avg(v), 6) AS order_imbalance_variance FROM v",
    "od_metrics": f"WITH {FLOWS}, pr AS (SELECT origin_cluster_id, destination_cluster_id, sum(order_count) AS n FROM od GROUP BY ALL), sl AS (SELECT slot_start, count(*) / 625.0 AS share FROM od GROUP BY ALL) SELECT (SELECT round(1 - avg(share), 6) FROM sl) AS od_sparsity, (SELECT round(avg(order_count), 6) FROM od) AS mean_nonzero_flow, (SELECT quantile_cont(order_count, 0.5)::DOUBLE FROM od) AS median_nonzero_flow, (SELECT count(*) FROM pr WHERE n >= 10) AS effective_od_pairs, (SELECT round(sum(pow(n / ((SELECT sum(n) FROM pr) + 1e-9), 2)), 9) FROM pr) AS od_hhi",
    "od_pair_sparsity": f"WITH {FLOWS} SELECT round(1 - count(DISTINCT (origin_cluster_id, destination_cluster_id)) / 625.0, 6) AS od_pair_sparsity FROM od",
    "historical_average": f"""WITH {TRIPS}, od AS (SELECT time_bucket(INTERVAL 1 HOUR, departure_time, TIMESTAMP '1970-01-01') AS slot_start, origin_cluster_id AS o, destination_cluster_id AS d, count(*) AS n FROM t WHERE isodow(departure_time) <= 5 GROUP BY ALL),
dr AS (SELECT dt, row_number() OVER (ORDER BY dt) AS r, count(*) OVER () AS k FROM (SELECT DISTINCT CAST(slot_start AS DATE) AS dt FROM od)),
x AS (SELECT hour(slot_start) AS h, o, d, sum(CASE WHEN r <= 4 THEN n ELSE 0 END) / 4.0 AS p, sum(CASE WHEN r = k THEN n ELSE 0 END) AS a FROM od JOIN dr ON dr.dt = CAST(slot_start AS DATE) WHERE r <= 4 OR r = k GROUP BY ALL)
SELECT round(sum(abs(p - a)) / 15000.0, 6) AS mae, round(sqrt(sum(pow(p - a, 2)) / 15000.0), 6) AS rmse, round(sum(abs(p - a)) / sum(a), 6) AS wape FROM x""",
    "intra_similarity": f"WITH {EDGES}, {POI_FEATURES}, {_POISIM} SELECT round(avg(poi_similarity) FILTER (a.cluster_id = b.cluster_id), 6) AS intra_poi_similarity FROM ps JOIN seg a ON a.seg_id = seg_id_a JOIN seg b ON b.seg_id = seg_id_b",
    "objective_components": f"WITH {EDGES}, {FEATURES}, {TABLE}, {objective('one AS (SELECT 1)')} SELECT round(r_cap, 6) AS r_cap, round(r_graph, 6) AS r_graph, round(r_cont, 6) AS r_cont, round(r_conn, 6) AS r_conn, round(r_cap + r_graph + r_cont + r_conn, 6) AS objective FROM o1, o2",
    "components": f"""WITH RECURSIVE {ROADS}, lo AS (SELECT seg_id_a AS a, seg_id_b AS b FROM pairs JOIN seg x ON x.seg_id = seg_id_a JOIN seg y ON y.seg_id = seg_id_b WHERE x.cluster_id = y.cluster_id),
bo AS (SELECT a, b FROM lo UNION ALL SELECT b, a FROM lo), re AS (SELECT a AS node, a AS root FROM bo UNION SELECT bo.b, re.root FROM re JOIN bo ON bo.a = re.node WHERE re.root < bo.b)
SELECT node, min(root) AS component FROM re GROUP BY ALL""",
    "pareto_2d": f"WITH {RUNS} SELECT run_id, od_sparsity, connector_cut_ratio FROM runs r WHERE NOT {_dominated('od_sparsity', 'connector_cut_ratio')}",
    "pareto_nd": f"WITH {RUNS} SELECT run_id FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE {_ALL3})",
    "pareto_summary": f"WITH {RUNS} SELECT 'od_sparsity|order_count_cv' AS pair, run_id FROM runs r WHERE NOT {_dominated('od_sparsity', 'order_count_cv')} UNION ALL SELECT 'connector_cut_ratio|continuity_cut_ratio', run_id FROM runs r WHERE NOT {_dominated('connector_cut_ratio', 'continuity_cut_ratio')}",
    "pareto_frontier": f"WITH {RUNS}, b AS (SELECT *, min(order_count_cv) OVER (ORDER BY od_sparsity, order_count_cv, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM runs) SELECT run_id, od_sparsity, order_count_cv FROM b WHERE best IS NULL OR order_count_cv < best",
    "balanced_score": f"WITH {SCORED} SELECT run_id, round(balanced_score, 6) AS balanced_score FROM scored",
    "best_run": f"WITH {SCORED}, g AS (SELECT * FROM scored WHERE connected_cluster_ratio >= 1 AND num_clusters = 10) SELECT run_id, round(balanced_score, 6) AS balanced_score FROM g r WHERE NOT {_dominated('od_sparsity', 'connector_cut_ratio', 'g')} ORDER BY r.balanced_score, run_id LIMIT 1",
    "ranked_summary": f"WITH {RUNS}, s AS (SELECT run_id, connected_cluster_ratio - greatest(mean_components - 1, 0) - connector_cut_ratio - continuity_cut_ratio AS st, poi_similarity + order_similarity + od_sparsity AS se, -order_count_cv AS ba FROM runs) SELECT run_id, round(st, 6) AS structure_score, round(se, 6) AS semantic_score, round(ba, 6) AS balance_score, row_number() OVER (ORDER BY st DESC, se DESC, ba DESC, run_id) AS rank FROM s",
    "candidate_gates": f"WITH {RUNS}, {BASELINES} SELECT run_id, coalesce(r.connector_cut_ratio < b.connector_cut_ratio, false) AS improves_connector_cut_ratio, {_HOLD('od_sparsity', 0.02)} AS holds_od_sparsity, {_HOLD('order_count_cv', 0.1)} AS holds_order_count_cv, coalesce(r.connector_cut_ratio < b.connector_cut_ratio, false) AND {_HOLD('od_sparsity', 0.02)} AND {_HOLD('order_count_cv', 0.1)} AS passes FROM runs r JOIN base b USING (initialization)",
    "heatmap_pivot": f"WITH {RUNS} SELECT initialization, round(avg(od_sparsity) FILTER (is_regularized), 6) AS regularized, round(avg(od_sparsity) FILTER (NOT is_regularized), 6) AS baseline FROM runs GROUP BY ALL",
    "embedding_cosine_topk": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS s FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(s, 6) AS score, rank FROM r WHERE rank <= 10",
    "setting_grid": "WITH c(lambda_c, a) AS (VALUES (0.2::DOUBLE, '0p2'), (0.5, '0p5'), (1.0, '1p0'), (2.0, '2p0')), r(lambda_r, b) AS (VALUES (0.5::DOUBLE, '0p5'), (1.0, '1p0'), (2.0, '2p0'), (4.0, '4p0')) SELECT lambda_c, lambda_r, 'lambda_c' || a || '_lambda_r' || b AS setting_id FROM c, r",
    "coverage_gaps": f"WITH {ROADS} SELECT seg_id, 'missing' AS problem FROM seg WHERE seg_id % 13 = 0 UNION ALL SELECT seg_id, 'extra' FROM con",
    "connectivity": f"WITH RECURSIVE {EDGES}, {CONNECTED} SELECT round(avg(CAST(c = 1 AS DOUBLE)), 6) AS connected_cluster_ratio, CAST(sum(c - 1) AS BIGINT) AS fragments, round(avg(c), 6) AS mean_components, max(c) AS max_components, round(avg(share), 6) AS mean_largest_share, round(min(share), 6) AS min_largest_share FROM ec",
    "network_diameter": f"""WITH RECURSIVE {EDGES}, {_INNER}, w AS (SELECT bo.a, bo.b, (x.length + y.length) / 2 AS w FROM bo JOIN seg x ON x.seg_id = bo.a JOIN seg y ON y.seg_id = bo.b), st AS (SELECT DISTINCT component AS node FROM lab),
{_sweep("d1", "st")}, en AS (SELECT first(d1.node ORDER BY d1.dist DESC, d1.node) AS node FROM d1 JOIN lab ON lab.seg_id = d1.node GROUP BY lab.component),
{_sweep("d2", "en")}, dm AS (SELECT lab.cluster_id, max(d2.dist) AS diameter FROM d2 JOIN lab ON lab.seg_id = d2.node GROUP BY ALL)
SELECT round(avg(diameter), 6) AS diameter_mean, round(max(diameter), 6) AS diameter_max, round(avg(CAST(diameter > 30000 AS DOUBLE)), 6) AS large_diameter_ratio FROM dm""",
    "move_delta": f"""WITH {EDGES}, {FEATURES}, {TABLE}, {objective('one AS (SELECT 1)')}, {_MOVE_TABLE}, p1 AS (SELECT avg({HINGE}) AS c2 FROM ct2, tgt2), p2 AS (SELECT {_share("base_weight")} AS g2, {_share("continuity_weight")} AS t2, {_share("connector_weight")} AS n2 FROM cut2)
SELECT round(c2 - r_cap, 6) AS delta_r_cap, round(g2 - r_graph, 6) AS delta_r_graph, round(t2 - r_cont, 6) AS delta_r_cont, round(n2 - r_conn, 6) AS delta_r_conn, round(c2 + g2 + t2 + n2 - r_cap - r_graph - r_cont - r_conn, 6) AS delta_objective FROM o1, o2, p1, p2""",
    "nearest_polyline": f"""WITH {SPATIAL}, lg AS (SELECT seg_id, x0, y0, 100.0 AS dx, 50.0 AS dy FROM ln0 UNION ALL SELECT seg_id, x0 + 100.0, y0 + 50.0, 60.0, -80.0 FROM ln0),
c AS (SELECT point_id, seg_id, px, py, x0, y0, dx, dy, least(1.0, greatest(0.0, ((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy))) AS k FROM pt JOIN lg ON px BETWEEN x0 - {RADIUS} AND x0 + dx + {RADIUS} AND py BETWEEN least(y0, y0 + dy) - {RADIUS} AND greatest(y0, y0 + dy) + {RADIUS}),
b AS (SELECT point_id, seg_id, sqrt(pow(px - (x0 + k * dx), 2) + pow(py - (y0 + k * dy), 2)) AS distance FROM c), r AS (SELECT point_id, first(seg_id ORDER BY distance, seg_id) AS seg_id, min(distance) AS distance FROM b WHERE distance <= {RADIUS} GROUP BY point_id) SELECT pt.point_id, r.seg_id, round(r.distance, 6) AS distance FROM pt LEFT JOIN r USING (point_id)""",
    "smallest_polygon": f"""WITH {SPATIAL}, pg AS (SELECT seg_id AS poly_id, x0, y0, (seg_id % 3 + 1) * 100.0 AS w FROM ln0), b AS (SELECT point_id, first(poly_id ORDER BY w, poly_id) AS poly_id, min(w * w) AS area FROM pt JOIN pg ON px >= x0 AND px < x0 + w AND py >= y0 AND py < y0 + w GROUP BY point_id)
SELECT pt.point_id, b.poly_id, round(CAST(b.area AS DOUBLE), 6) AS area FROM pt LEFT JOIN b USING (point_id)""",
    "polyline_centroids": f"WITH {SPATIAL}, l AS (SELECT sqrt(12500.0) AS a, 100.0 AS b) SELECT seg_id, round(((x0 + 50) * a + (x0 + 130) * b) / (a + b), 6) AS x, round(((y0 + 25) * a + (y0 + 10) * b) / (a + b), 6) AS y, round(a + b, 6) AS length FROM ln0, l",
    "inside_ratio": f"""WITH {SPATIAL}, lg AS (SELECT seg_id, x0, y0, 100.0 AS dx, 50.0 AS dy FROM ln0 UNION ALL SELECT seg_id, x0 + 100.0, y0 + 50.0, 60.0, -80.0 FROM ln0),
c AS (SELECT seg_id, sqrt(dx * dx + dy * dy) AS n, greatest(0.0, -x0 / dx, least(-y0 / dy, (600 - y0) / dy)) AS low, least(1.0, (5000 - x0) / dx, greatest(-y0 / dy, (600 - y0) / dy)) AS high FROM lg)
SELECT seg_id, round(sum(greatest(high - low, 0) * n) / sum(n), 6) AS inside_ratio FROM c GROUP BY ALL""",
    "heatmap_lambda": """WITH r AS (SELECT 'init_' || (p_size % 3) AS initialization, [0.2, 0.5, 1.0, 2.0][1 + p_partkey % 4]::DOUBLE AS lambda_c, [0.5, 1.0, 2.0, 4.0][1 + (p_partkey // 4) % 4]::DOUBLE AS lambda_r, p_partkey % 97 / 97.0 AS od_sparsity, p_partkey % 79 / 79.0 AS order_count_cv FROM part WHERE p_partkey % 5 > 0)
SELECT initialization, 'od_sparsity' AS metric, lambda_c, lambda_r, round(avg(od_sparsity), 6) AS value FROM r GROUP BY ALL UNION ALL SELECT initialization, 'order_count_cv', lambda_c, lambda_r, round(avg(order_count_cv), 6) FROM r GROUP BY ALL""",
}
_SIZES = f"""WITH {ROADS}, {FEATURES}, {TABLE} SELECT round(avg(num_segments), 6) AS mean_segments_per_cluster, min(num_segments) AS min_segments_per_cluster, max(num_segments) AS max_segments_per_cluster, round(avg(total_length), 6) AS mean_cluster_length_m, round(min(total_length), 6) AS min_cluster_length_m, round(max(total_length), 6) AS max_cluster_length_m,
count(*) FILTER (order_total < 100) AS clusters_below_min_order, round(avg(CAST(order_total < 100 AS DOUBLE)), 6) AS ratio_clusters_below_min_order, round(avg(order_total), 6) AS target_order_capacity FROM ct"""
_INTRA = f"WITH {EDGES}, {POI_FEATURES}, {_POISIM}, {FEATURES}, {_ORDSIM} SELECT round(avg(poi_similarity), 6) AS intra_poi_similarity, round(avg(order_similarity), 6) AS intra_order_similarity FROM ps JOIN os USING (seg_id_a, seg_id_b) JOIN cut USING (seg_id_a, seg_id_b) WHERE NOT is_cut"
#: Hourly flows between the clusters of trips.
_HOURLY = TRIPS + """, od AS (SELECT time_bucket(INTERVAL 1 HOUR, departure_time, TIMESTAMP '1970-01-01') AS slot_start, origin_cluster_id, destination_cluster_id, count(*) AS order_count FROM t WHERE isodow(departure_time) <= 5 AND origin_cluster_id IS NOT NULL AND destination_cluster_id IS NOT NULL GROUP BY ALL)"""
_ROW = {"_sizes": _SIZES, "_intra": _INTRA, "_od": ORACLES["od_metrics"].replace(FLOWS, _HOURLY), "_pairs": ORACLES["od_pair_sparsity"].replace(FLOWS, _HOURLY)}
ORACLES["metric_row"] = "SELECT * FROM " + ", ".join(f"({q}) AS q{i}" for i, q in enumerate([*_ROW.values(), *(ORACLES[n] for n in "cluster_cv small_clusters capacity_metrics edge_cut_metrics road_integrity wss poi_cluster_entropy imbalance_var historical_average connectivity network_diameter".split())]))
ORACLES["evaluation_row"] = f"""WITH RECURSIVE {EDGES}, {CONNECTED}, {POI_FEATURES}, {_POISIM}, {FEATURES}, {_ORDSIM}, l AS (SELECT cluster_id, count(*) AS n, sum(length) AS len FROM seg GROUP BY ALL), rn AS (SELECT name, count(DISTINCT cluster_id) AS k FROM seg WHERE trim(name) <> '' GROUP BY ALL HAVING count(*) > 1)
SELECT (SELECT count(*) FROM l) AS num_clusters, (SELECT count(*) FROM seg) AS num_segments, (SELECT round(avg(len), 6) FROM l) AS mean_cluster_length_m, (SELECT round(stddev_pop(len) / avg(len), 6) FROM l) AS size_balance_cv, (SELECT round(avg(CAST(c = 1 AS DOUBLE)), 6) FROM ec) AS connected_cluster_ratio, (SELECT round(avg(c), 6) FROM ec) AS mean_components_per_cluster,
(SELECT round(avg(CAST(is_cut AS DOUBLE)) FILTER (has_connector), 6) FROM cut) AS connector_edge_cut_ratio, (SELECT round(avg(CAST(is_cut AS DOUBLE)) FILTER (has_continuity), 6) FROM cut) AS continuity_edge_cut_ratio,
(SELECT round(avg(poi_similarity), 6) FROM ps JOIN cut USING (seg_id_a, seg_id_b) WHERE NOT is_cut) AS poi_intra_edge_homogeneity, (SELECT round(avg(order_similarity), 6) FROM os JOIN cut USING (seg_id_a, seg_id_b) WHERE NOT is_cut) AS order_intra_edge_homogeneity,
(SELECT round(avg(k), 6) FROM rn) AS mean_clusters_per_named_road, (SELECT max(k) FROM rn) AS max_clusters_per_named_road, (SELECT od_pair_sparsity FROM ({_ROW["_pairs"]})) AS cluster_od_sparsity"""
