"""DuckDB SQL for the rows of the station queries, written from the rules and not from the plans.

Windows are exploded, chunks are numbered by ``ntile`` over whole splits, and grids are joined: what the
operators avoid at scale is done here by brute force.
"""

from __future__ import annotations

from .config import CALENDAR_COLUMNS, OCCUPANCY_COLUMNS, SPLITS, VALUE_COLUMNS
from .queries import CFG, FEATURES, FILE_STATIONS, IID_CLIENTS, MODEL_BYTES, PATIENCE

_SUMS = ("duration", "volume")
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
W, H = CFG.window, CFG.horizon


def _agg(c: str) -> str:
    return f"{'sum' if c in _SUMS else 'avg'}({c}) AS {c}"


def _num(c: str, digits: int = 6, name: str | None = None) -> str:
    return f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {name or c}"


def _text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


def _readings(station: str) -> str:
    return f"""readings AS (
    SELECT CAST({station} AS VARCHAR) AS station_id,
        CASE WHEN event_id % 101 = 0 THEN 'not-a-time' ELSE strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') END AS time,
        CASE WHEN event_id % 31 = 0 THEN 'bad' WHEN event_id % 23 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS volume,
        CASE WHEN event_id % 13 <> 0 THEN CAST(k % 7 AS VARCHAR) END AS busy,
        CAST(k % 5 AS VARCHAR) AS idle, CAST(k % 3 AS VARCHAR) AS fast_busy, CAST(k % 4 AS VARCHAR) AS fast_idle,
        CAST(k % 2 AS VARCHAR) AS slow_busy, CAST(k % 6 AS VARCHAR) AS slow_idle, CAST(k * 5 AS VARCHAR) AS duration,
        CAST(CAST(0.5 AS DOUBLE) + (k % 10) / CAST(10 AS DOUBLE) AS VARCHAR) AS s_price,
        CAST(CAST(0.3 AS DOUBLE) + (k % 4) / CAST(10 AS DOUBLE) AS VARCHAR) AS e_price
    FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)
)"""


#: Readings of stations renamed, with volumes spoilt by the hour.
_FILE_READINGS = f"""file_readings AS (
    SELECT * REPLACE (
        CASE station_id {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FILE_STATIONS.items())} END AS station_id,
        CASE substr(time, 12, 2) WHEN '03' THEN '1d' WHEN '04' THEN 'NaN' WHEN '05' THEN '0x1p3' ELSE volume END AS volume
    ) FROM readings
)"""

_CLEAN_READINGS = f"""parsed AS (
    SELECT station_id, try_strptime(time, '%Y-%m-%d %H:%M:%S') AS time,
        {", ".join(f"CASE WHEN regexp_matches({c}, '{_NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END AS {c}" for c in VALUE_COLUMNS)}
    FROM readings
), clean AS (SELECT * FROM parsed WHERE time IS NOT NULL)"""
_COLLAPSED = f"collapsed AS (SELECT station_id, time, {', '.join(map(_agg, VALUE_COLUMNS))}, count(*) AS rows FROM clean GROUP BY station_id, time)"
_HOURLY = f"""rolled AS (
    SELECT station_id, date_trunc('hour', time) AS time, {", ".join(map(_agg, VALUE_COLUMNS))} FROM collapsed GROUP BY ALL
), grid AS (
    SELECT station_id, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM rolled GROUP BY station_id
), hourly AS (SELECT g.station_id, g.time, {", ".join(VALUE_COLUMNS)} FROM grid g LEFT JOIN rolled r ON g.station_id = r.station_id AND g.time = r.time)"""


def _share(p: str) -> str:
    a, b = f"{p}busy", f"({p}busy + {p}idle)"
    return f"CASE WHEN isfinite({a}) AND isfinite{b} AND {b} <> 0 THEN {a} / {b} ELSE 0.0 END AS {p}occupancy_rate"


_FEATURES = f"""featured AS (
    SELECT *, {", ".join(map(_share, ("", "fast_", "slow_")))},
        hour(time) AS hour, isodow(time) - 1 AS day_of_week, CASE WHEN isodow(time) >= 6 THEN 1 ELSE 0 END AS is_weekend,
        sin(2 * pi() * hour(time) / 24.0) AS hour_sin, cos(2 * pi() * hour(time) / 24.0) AS hour_cos,
        sin(2 * pi() * (isodow(time) - 1) / 7.0) AS dow_sin, cos(2 * pi() * (isodow(time) - 1) / 7.0) AS dow_cos
    FROM hourly
)"""
_SPLIT = """counted AS (
    SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY time) - 1 AS row_idx, count(*) OVER (PARTITION BY station_id) AS total FROM featured
), ends AS (
    SELECT *, CASE WHEN total <= 2 THEN least(total, 1) ELSE least(greatest(CAST(floor(total * CAST(0.70 AS DOUBLE)) AS BIGINT), 1), total - 2) END AS train_end FROM counted
), both_ends AS (
    SELECT *, CASE WHEN total <= 2 THEN train_end ELSE train_end + least(greatest(CAST(floor(total * CAST(0.05 AS DOUBLE)) AS BIGINT), 1), total - train_end - 1) END AS val_end FROM ends
), split_rows AS (SELECT *, CASE WHEN row_idx < train_end THEN 'train' WHEN row_idx < val_end THEN 'val' ELSE 'test' END AS split FROM both_ends)"""


def _filled(c: str) -> str:
    group = "PARTITION BY station_id, split ORDER BY time"
    return f"coalesce(last_value({c} IGNORE NULLS) OVER ({group} ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER ({group} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"


_IMPUTED = f"""filled AS (SELECT station_id, split, time, volume, {", ".join(map(_filled, FEATURES))} FROM split_rows),
complete AS (
    SELECT station_id, split, time, {", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in ["volume", *FEATURES])}
    FROM filled WHERE {" AND ".join(f"{c} IS NOT NULL" for c in ["volume", *FEATURES])}
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY station_id, split ORDER BY time) AS rn, count(*) OVER (PARTITION BY station_id, split) AS n FROM complete
), valid AS (SELECT station_id FROM complete WHERE split = 'train' GROUP BY station_id HAVING count(*) >= {W + H})"""
_TARGETS = f"samples AS (SELECT station_id, split, time AS t, volume AS y, rn FROM numbered WHERE rn >= {W + H} AND station_id IN (SELECT station_id FROM valid))"
_WINDOWS = f"""windows AS (
    SELECT s.station_id, s.split, s.t, s.y, r.rn - (s.rn - {W + H - 1}) AS step, {", ".join("r." + c for c in FEATURES)}
    FROM samples s JOIN numbered r ON r.station_id = s.station_id AND r.split = s.split AND r.rn BETWEEN s.rn - {W + H - 1} AND s.rn - {H}
)"""
_TRAIN_LONG = f"""train_long AS (
    {" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM windows WHERE split = 'train'" for c in FEATURES)}
), standard AS (
    SELECT feature, avg(x) AS center, CASE WHEN var_pop(x) <= count(*) * 2.220446049250313e-16 * var_pop(x) + pow(count(*) * avg(x) * 2.220446049250313e-16, 2) THEN 1.0 ELSE stddev_pop(x) END AS scale
    FROM train_long GROUP BY feature
)"""
_NAIVE = f"""naive AS (
    SELECT s.t, s.station_id, s.split, CAST(s.y AS DOUBLE) AS y_true, CAST(p.volume AS DOUBLE) AS y_pred, m.method_name
    FROM samples s CROSS JOIN (VALUES ('naive_last_value', {H}), ('naive_seasonal_24h', {W + H - 1})) m(method_name, back)
    JOIN numbered p ON p.station_id = s.station_id AND p.split = s.split AND p.rn = s.rn - m.back
)"""
_ROUNDS = f"""rounds AS (SELECT *, day(time) AS round, station_id AS client_id FROM complete),
sizes AS (SELECT round, client_id, count(*) AS n, avg(CAST(volume AS DOUBLE)) AS loss FROM rounds GROUP BY ALL),
states AS ({" UNION ALL ".join(f"SELECT round, client_id, '{c}' AS name, 0 AS idx, avg(CAST({c} AS DOUBLE)) AS value FROM rounds GROUP BY ALL" for c in FEATURES)})"""
_HISTORY = "history AS (SELECT station_id AS run, day(time) AS epoch, round(sqrt(avg(pow(CAST(volume AS DOUBLE), 2))), 1) AS val_rmse FROM complete GROUP BY ALL)"

_FILE_CLEAN = _CLEAN_READINGS.replace("FROM readings", "FROM file_readings")
_TO_COMPLETE = (_CLEAN_READINGS, _COLLAPSED, _HOURLY, _FEATURES, _SPLIT, _IMPUTED)


def _with(*parts: str, query: str, station: str = "event_type") -> str:
    return "WITH " + ",\n".join([_readings(station), *parts]) + "\n" + query


def _iid(clients: int) -> str:
    return f"""keyed AS (
    SELECT *, CASE WHEN split = 'train' THEN md5('{CFG.seed}:' || station_id || ':' || strftime(t, '%Y-%m-%d %H:%M:%S')) ELSE '' END AS digest FROM samples
), assigned AS (
    SELECT split, station_id, t, row_number() OVER (PARTITION BY split ORDER BY digest, station_id, t) - 1 AS position,
        format('client_{{:03d}}', ntile({clients}) OVER (PARTITION BY split ORDER BY digest, station_id, t) - 1) AS client_id
    FROM keyed
)"""


def _metrics(keys: str) -> str:
    return f"""SELECT {keys}, {_num("sqrt(avg(pow(y_pred - y_true, 2)))", name="rmse")}, {_num("avg(abs(y_pred - y_true))", name="mae")},
    {_num("CASE WHEN count(*) < 2 THEN CAST('nan' AS DOUBLE) WHEN min(y_true) = max(y_true) THEN (CASE WHEN sum(pow(y_pred - y_true, 2)) = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - sum(pow(y_pred - y_true, 2)) / (var_pop(y_true) * count(*)) END", name="r2")},
    {_num("avg(pow(y_pred - y_true, 2))", name="mse")}, count(*) AS sample_count FROM naive GROUP BY {keys}"""


def _digest(name: str) -> str:
    """The digest of a set of names that an aggregate sees once each."""
    bits = lambda at: f"CAST('0x' || substr(md5({name}), {at}, 15) AS BIGINT)"
    return f"concat_ws('-', CAST(count({name}) AS VARCHAR), format('{{:X}}', bit_xor({bits(1)})), CAST(sum({bits(16)}) AS VARCHAR))"


def _missing(table: str, name: str) -> str:
    parts = " UNION ALL ".join(f"SELECT station_id, '{c}' AS c, count(*) AS n FROM {table} WHERE {c} IS NULL GROUP BY station_id" for c in VALUE_COLUMNS)
    return f"{name} AS (SELECT station_id, string_agg(c || '=' || n, ',' ORDER BY c) AS counts FROM ({parts}) GROUP BY station_id)"


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    hours = (_CLEAN_READINGS, _COLLAPSED, _HOURLY)
    complete = _TO_COMPLETE
    rn_windows = lambda s, c: f"greatest(count(*) FILTER (WHERE split = '{s}'{c}) - {W + H - 1}, 0)"
    values = ", ".join(map(_num, VALUE_COLUMNS))
    features5 = ", ".join(_num(c, 5) for c in FEATURES)
    out = {
        "clean_readings": _with(_CLEAN_READINGS, query=f"SELECT station_id, {_text('time')}, {values} FROM clean"),
        "duplicate_collapse": _with(_CLEAN_READINGS, _COLLAPSED, query=f"SELECT station_id, {_text('time')}, {values}, rows FROM collapsed"),
        "hourly_rollup": _with(*hours, query=f"SELECT station_id, {_text('time')}, {values} FROM hourly"),
        "hourly_rollup_users": _with(*hours, query=f"SELECT station_id, {_text('time')}, {values} FROM hourly", station="user_id"),
        "quality_report": _with(
            *hours,
            _missing("clean", "raw_missing"),
            _missing("hourly", "hourly_missing"),
            query=f"""SELECT r.station_id, r.n AS rows_before_cleaning, coalesce(c.n, 0) AS rows_after_time_cleaning, r.bad AS invalid_time_rows_dropped,
            coalesce(c.dups, 0) AS duplicate_timestamps_collapsed, coalesce(e.n, 0) AS fully_missing_numeric_rows, coalesce(h.n, 0) AS rows_after_hourly_aggregation,
            coalesce(rm.counts, '') AS raw_missing_value_counts, coalesce(hm.counts, '') AS hourly_missing_counts, {_text("h.hourly_start").replace("AS h.", "AS ")}, {_text("h.hourly_end").replace("AS h.", "AS ")}
            FROM (SELECT station_id, count(*) AS n, count(*) FILTER (WHERE time IS NULL) AS bad FROM parsed GROUP BY station_id) r
            LEFT JOIN (SELECT station_id, count(*) AS n, CAST(sum(rows - 1) AS BIGINT) AS dups FROM collapsed GROUP BY station_id) c USING (station_id)
            LEFT JOIN (SELECT station_id, count(*) AS n FROM clean WHERE {" AND ".join(f"{c} IS NULL" for c in VALUE_COLUMNS)} GROUP BY station_id) e USING (station_id)
            LEFT JOIN (SELECT station_id, count(*) AS n, min(time) AS hourly_start, max(time) AS hourly_end FROM hourly GROUP BY station_id) h USING (station_id)
            LEFT JOIN raw_missing rm USING (station_id) LEFT JOIN hourly_missing hm USING (station_id)""",
        ),
        "run_counters": _with(*hours, query="SELECT (SELECT count(DISTINCT station_id) FROM readings) AS stations_discovered, count(DISTINCT station_id) AS stations_processed, count(*) AS hourly_rows FROM hourly"),
        "occupancy_features": _with(*hours, _FEATURES, query=f"SELECT station_id, {_text('time')}, {', '.join(map(_num, OCCUPANCY_COLUMNS))} FROM featured"),
        "calendar_features": _with(*hours, _FEATURES, query=f"SELECT station_id, {_text('time')}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in CALENDAR_COLUMNS[:3])}, {', '.join(map(_num, CALENDAR_COLUMNS[3:]))} FROM featured"),
        "chronological_split": _with(*hours, _FEATURES, _SPLIT, query=f"SELECT station_id, {_text('time')}, row_idx, split FROM split_rows"),
        "split_stats": _with(
            *complete,
            query="SELECT r.station_id, "
            + ", ".join(f"r.{s} AS {s}_rows_raw, coalesce(k.{s}, 0) AS {s}_rows_clean, r.{s} - coalesce(k.{s}, 0) AS {s}_rows_dropped, greatest(coalesce(k.{s}, 0) - {W + H - 1}, 0) AS {s}_windows" for s in SPLITS)
            + "".join(f" {join} (SELECT station_id, {', '.join(f'count(*) FILTER (WHERE split = {chr(39)}{s}{chr(39)}) AS {s}' for s in SPLITS)} FROM {table} GROUP BY station_id) {a}" for join, table, a in (("FROM", "split_rows", "r"), ("LEFT JOIN", "complete", "k")))
            + " USING (station_id)",
        ),
        "imputed_split": _with(*complete, query=f"SELECT station_id, split, {_text('time')}, {_num('volume', 5)}, {features5} FROM complete"),
        "valid_stations": _with(*complete, query=f"SELECT station_id, {rn_windows('train', '')} AS train_windows FROM complete GROUP BY station_id HAVING count(*) FILTER (WHERE split = 'train') >= {W + H}"),
        "scaler_standard": _with(*complete, _TARGETS, _WINDOWS, _TRAIN_LONG, query=f"SELECT feature, {_num('center')}, {_num('scale')} FROM standard"),
        "scaler_minmax": _with(
            *complete, _TARGETS, _WINDOWS, _TRAIN_LONG,
            query=f"SELECT feature, {_num('min(x)', name='center')}, {_num('CASE WHEN max(x) - min(x) < 2.220446049250313e-15 THEN 1.0 ELSE max(x) - min(x) END', name='scale')} FROM train_long GROUP BY feature",
        ),
        "scaled_features": _with(
            *complete, _TARGETS, _WINDOWS, _TRAIN_LONG,
            query=f"SELECT station_id, split, {_text('time')}, "
            + ", ".join(_num(f"CAST((CAST({c} AS DOUBLE) - (SELECT center FROM standard WHERE feature = '{c}')) / (SELECT scale FROM standard WHERE feature = '{c}') AS FLOAT)", 4, c) for c in FEATURES)
            + f", {_num('volume', 4)} FROM complete WHERE station_id IN (SELECT station_id FROM valid)",
        ),
        "sliding_windows_long": _with(*complete, _TARGETS, _WINDOWS, query=f"SELECT station_id, split, {_text('t')}, {_num('y', 5)}, step, {features5} FROM windows"),
        "window_violations": _with(*complete, _TARGETS, query="SELECT station_id, split, count(*) AS windows, count(*) AS wrong_length, CAST(0 AS BIGINT) AS wrong_width, CAST(0 AS BIGINT) AS not_finite FROM samples GROUP BY ALL"),
        "non_finite_windows": _with(*complete, _TARGETS, query="SELECT station_id, split, count(*) AS windows FROM samples WHERE hour(t) = 5 GROUP BY ALL"),
        "sample_explained": _with(*complete, query=f"SELECT station_id, CAST(1 AS BIGINT) AS sample, rn - 1 AS step, {_text('time')}, {_num('volume', 5, 'value')}, CASE WHEN rn <= {W} THEN 'history' ELSE 'target' END AS role FROM numbered WHERE split = 'train' AND n >= {W + H} AND (rn <= {W} OR rn = {W + H})"),
        "naive_predictions": _with(*complete, _TARGETS, _NAIVE, query=f"SELECT {_text('t')}, station_id, split, {_num('y_true', 5)}, {_num('y_pred', 5)}, {_num('y_pred - y_true', 5, 'error')}, {_num('abs(y_pred - y_true)', 5, 'abs_error')}, method_name FROM naive"),
        "baseline_metrics": _with(*complete, _TARGETS, _NAIVE, query=_metrics("method_name, split")),
        "station_metrics": _with(*complete, _TARGETS, _NAIVE, query=_metrics("method_name, split, station_id")),
        "sample_universe_check": _with(
            *complete, _TARGETS,
            query=f"""SELECT split, a.n AS actual_samples, e.n AS expected_samples, a.s AS actual_stations, e.s AS expected_stations, a.d AS actual_digest, e.d AS expected_digest
            FROM (SELECT split, CAST(sum(n) AS BIGINT) AS n, count(*) AS s, {_digest("station_id")} AS d FROM (SELECT split, station_id, count(*) AS n FROM samples GROUP BY ALL) GROUP BY split) a
            FULL JOIN (SELECT split, CAST(sum(w) AS BIGINT) AS n, count(*) FILTER (WHERE w > 0) AS s, {_digest("CASE WHEN w > 0 THEN station_id END")} AS d FROM (SELECT station_id, split, greatest(count(*) - {W + H - 1}, 0) AS w FROM split_rows GROUP BY ALL) GROUP BY split) e USING (split)
            WHERE a.n IS DISTINCT FROM e.n OR a.s IS DISTINCT FROM e.s OR a.d IS DISTINCT FROM e.d""",
        ),
        "centralized_counts": _with(*complete, _TARGETS, query="SELECT 'all' AS client_id, s.split, coalesce(n, 0) AS samples FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN (SELECT split, count(*) AS n FROM samples GROUP BY split) USING (split)"),
        "non_iid_clients": _with(*complete, _TARGETS, query=f"SELECT 'client_' || station_id AS client_id, 'non_iid_station' AS scenario, station_id, split, {_text('t')} FROM samples"),
        "iid_clients": _with(*complete, _TARGETS, _iid(IID_CLIENTS), query=f"SELECT split, station_id, {_text('t')}, position, client_id FROM assigned"),
        "client_counts": _with(
            *complete, _TARGETS, _iid(1000),
            query="""SELECT g.client_id, g.split, coalesce(n, 0) AS samples FROM (SELECT format('client_{:03d}', i) AS client_id, split FROM range(1000) r(i) CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split)) g
            LEFT JOIN (SELECT client_id, split, count(*) AS n FROM assigned GROUP BY ALL) a USING (client_id, split)""",
        ),
        "client_summary": _with(
            *complete, _TARGETS,
            query="SELECT 'client_' || station_id AS client_id, " + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}_samples" for s in SPLITS)
            + ", CAST(max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train_station_count, "
            + ", ".join(f"strftime({m}(t) FILTER (WHERE split = '{s}'), '%Y-%m-%d %H:%M:%S') AS {s}_{m}_t" for s in SPLITS for m in ("min", "max"))
            + " FROM samples GROUP BY station_id",
        ),
        "usable_clients": _with(*complete, _TARGETS, _iid(60), query="SELECT client_id, count(*) FILTER (WHERE split = 'train') > 0 AS trains FROM assigned GROUP BY client_id HAVING count(*) FILTER (WHERE split = 'val') > 0 AND count(*) FILTER (WHERE split = 'test') > 0"),
        "fedavg_parameters": _with(*complete, _ROUNDS, query=f"SELECT CAST(round AS INTEGER) AS round, name, CAST(idx AS BIGINT) AS idx, {_num('CASE WHEN name = \'is_weekend\' THEN arg_min(value, client_id) ELSE sum(value * n) / sum(n) END', name='value')} FROM states JOIN sizes USING (round, client_id) GROUP BY round, name, idx"),
        "client_loss_means": _with(*complete, _ROUNDS, query=f"SELECT CAST(round AS INTEGER) AS round, count(*) AS client_count, {_num('avg(loss)', name='train_loss_mean')}, {_num('sum(loss * n) / sum(n)', name='train_loss_weighted')} FROM sizes GROUP BY round"),
        "round_traffic": _with(
            *complete, _ROUNDS,
            query="SELECT CAST(round AS INTEGER) AS round, count(*) AS client_count, "
            + ", ".join(_num(f"count(*) * {MODEL_BYTES} * {k} / CAST(1048576 AS DOUBLE)", name=f"communication_{c}_mb") for c, k in (("upload", 1), ("download", 1), ("total", 2), ("cumulative", "2 * round")))
            + " FROM sizes GROUP BY round",
        ),
        "communication_rounds": _with(*complete, _ROUNDS, query=f"SELECT CAST(round AS INTEGER) AS round, count(*) AS client_count, count(*) AS messages_up, count(*) AS messages_down, count(*) * {MODEL_BYTES} AS payload_bytes_up, count(*) * {MODEL_BYTES} AS payload_bytes_down, 2 * count(*) * {MODEL_BYTES} AS payload_bytes_total FROM sizes GROUP BY round"),
        "best_round": _with(*complete, _HISTORY, query=f"SELECT run, CAST(epoch AS BIGINT) AS best_epoch, {_num('val_rmse', name='best_val_rmse')} FROM history QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_rmse, epoch) = 1"),
        "early_stop": _with(
            *complete, _HISTORY,
            query=f"""SELECT run, CAST(coalesce(min(epoch) FILTER (WHERE waited >= {PATIENCE}), max(epoch)) AS BIGINT) AS stopped_at, count(*) FILTER (WHERE waited >= {PATIENCE}) > 0 AS stopped_early FROM (
                SELECT *, i - coalesce(max(CASE WHEN before IS NULL OR val_rmse < before THEN i END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS waited FROM (
                    SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i, min(val_rmse) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM history)) GROUP BY run""",
        ),
        "align_columns": _with(*hours, query=f"SELECT station_id, {_text('time')}, {_num('CASE WHEN hour(time) < 12 THEN busy END', name='busy')}, {_num('volume')}, {_num('CASE WHEN hour(time) >= 12 THEN idle END', name='idle')} FROM rolled"),
    }
    for name in ("imputed_split", "scaler_standard", "scaled_features", "baseline_metrics", "iid_clients"):
        out[f"{name}_users"] = out[name].replace(_readings("event_type"), _readings("user_id"))
    file_hours = (_FILE_READINGS, _FILE_CLEAN, _COLLAPSED, _HOURLY)
    absent = "CASE WHEN station_id IN ('007', 'st 1') THEN NULL ELSE e_price END"
    out |= {
        "station_files": _with(_FILE_READINGS, _FILE_CLEAN, query=f"SELECT station_id, {_text('time')}, {', '.join(_num(absent if c == 'e_price' else c, name=c) for c in VALUE_COLUMNS)} FROM clean"),
        "hourly_files": _with(*file_hours, query=f"SELECT station_id, {_text('time')}, {values} FROM hourly"),
        "hourly_csv_files": _with(*file_hours, query=f"SELECT station_id, {_text('time')}, {', '.join(_num('CASE WHEN hour(time) IN (7, 8) THEN NULL ELSE volume END' if c == 'volume' else c, name=c) for c in VALUE_COLUMNS)} FROM rolled"),
        "window_files": _with(
            *complete, _TARGETS, _WINDOWS, _iid(IID_CLIENTS),
            query=f"""SELECT l.scenario, l.client_id, w.split, w.station_id, {_text("w.t").replace("AS w.", "AS ")}, {_num("any_value(w.y)", 5, "y")}, {_num(f"max(CASE WHEN step = 0 THEN {FEATURES[0]} END)", 5, "first")}, {_num(f"max(CASE WHEN step = {W - 1} THEN {FEATURES[-1]} END)", 5, "last")}
            FROM windows w JOIN (SELECT 'centralized' AS scenario, 'all' AS client_id, split, station_id, t FROM samples UNION ALL SELECT 'non_iid_station', 'client_' || station_id, split, station_id, t FROM samples
            UNION ALL SELECT 'iid', client_id, split, station_id, t FROM assigned) l ON l.split = w.split AND l.station_id = w.station_id AND l.t = w.t GROUP BY l.scenario, l.client_id, w.split, w.station_id, w.t""",
        ),
        "client_job": _with(
            *complete, _TARGETS,
            query="SELECT 'client_' || station_id AS client_id, " + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}_samples" for s in SPLITS)
            + ", strftime(min(t) FILTER (WHERE split = 'train'), '%Y-%m-%d %H:%M:%S') AS train_min_t, strftime(max(t) FILTER (WHERE split = 'test'), '%Y-%m-%d %H:%M:%S') AS test_max_t FROM samples GROUP BY station_id"
            + " HAVING count(*) FILTER (WHERE split = 'val') > 0 AND count(*) FILTER (WHERE split = 'test') > 0",
        ),
        "layout_counts": _with(
            *complete, _TARGETS, _iid(IID_CLIENTS),
            query=f"""SELECT g.scenario, g.client_id, split, count(l.t) AS samples FROM (
                SELECT 'centralized' AS scenario, 'all' AS client_id UNION ALL SELECT 'iid', format('client_{{:03d}}', i) FROM range({IID_CLIENTS}) r(i) UNION ALL SELECT DISTINCT 'non_iid_station', 'client_' || station_id FROM samples
            ) g CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN (
                SELECT 'centralized' AS scenario, 'all' AS client_id, split, t FROM samples UNION ALL SELECT 'non_iid_station', 'client_' || station_id, split, t FROM samples UNION ALL SELECT 'iid', client_id, split, t FROM assigned
            ) l USING (scenario, client_id, split) GROUP BY ALL""",
        ),
        "experiment_metadata": _with(
            *complete, _TARGETS,
            query=f"""SELECT CAST({W} AS BIGINT) AS window_size, CAST({H} AS BIGINT) AS horizon, '{CFG.target}' AS target_column, CAST({CFG.seed} AS BIGINT) AS seed, '{CFG.scaler}' AS scaler, CAST({IID_CLIENTS} AS BIGINT) AS iid_clients,
            CAST({len(FEATURES)} AS BIGINT) AS feature_count, '{",".join(FEATURES)}' AS features, (SELECT count(*) FROM valid) AS stations, (SELECT string_agg(station_id, ',' ORDER BY station_id) FROM valid) AS station_ids, (SELECT {_digest("station_id")} FROM valid) AS station_digest,
            """
            + ", ".join(f"(SELECT count(*) FROM samples WHERE split = '{s}') AS {s}_samples" for s in SPLITS)
            + ", " + ", ".join(f"CAST({v} AS DOUBLE) AS {s}_ratio" for s, v in CFG.ratios.items()),
        ),
        "results_payload": _with(
            *complete, _TARGETS, _NAIVE,
            query=f"""SELECT method_name, split, rmse, mae, CASE WHEN isnan(r2) THEN NULL ELSE r2 END AS r2, max(CASE WHEN split = 'val' THEN rmse END) OVER (PARTITION BY method_name) AS best_val_rmse, coalesce(sample_count, 0) AS sample_count,
            coalesce(sample_count, 0) AS split_count, (SELECT count(*) FROM valid) AS logical_client_count, CAST(0 AS BIGINT) AS payload_bytes_total
            FROM (SELECT DISTINCT method_name FROM naive) CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN ({_metrics("method_name, split")}) USING (method_name, split)""",
        ),
    }
    blend = "blend AS (SELECT t, station_id, split, y_true, avg(y_pred) AS y_pred, 'blend' AS method_name FROM naive GROUP BY t, station_id, split, y_true)"
    scores = _metrics("method_name, split").replace("FROM naive", "FROM blend")
    scores = f"SELECT split, rmse, mae, CASE WHEN isnan(r2) THEN NULL ELSE r2 END AS r2, mse, coalesce(sample_count, 0) AS sample_count FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN ({scores}) USING (split)"
    stops = f"""stops AS (SELECT run, CAST(coalesce(min(epoch) FILTER (WHERE waited >= {PATIENCE}), max(epoch)) AS BIGINT) AS stopped_at, count(*) FILTER (WHERE waited >= {PATIENCE}) > 0 AS stopped_early FROM (
        SELECT *, i - coalesce(max(CASE WHEN before IS NULL OR val_rmse < before THEN i END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS waited FROM (
            SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i, min(val_rmse) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM history)) GROUP BY run),
    done AS (SELECT h.*, stopped_at, stopped_early FROM history h JOIN stops USING (run) WHERE epoch <= stopped_at)"""
    out |= {
        "scored_predictions": _with(
            *complete, _TARGETS, _NAIVE, blend,
            query=f"SELECT 'blend' AS method, split, rmse, mae, r2, mse, sample_count, (SELECT count(*) FROM blend WHERE split = 'test') AS test_rows, CAST(9 AS BIGINT) AS steps, CAST(4 AS BIGINT) AS best_step, true AS stopped_early, CAST(77 AS BIGINT) AS parameters, CAST(0 AS BIGINT) AS bytes FROM ({scores})",
        ),
        "federated_results": _with(
            *complete, _TARGETS, _NAIVE, blend, _ROUNDS, "evaluation AS (SELECT round, round(sqrt(avg(pow(CAST(volume AS DOUBLE), 2))), 1) AS val_rmse FROM rounds GROUP BY round)",
            "sent AS (SELECT round, count(*) AS n FROM sizes GROUP BY round)",
            query=f"""SELECT split, rmse, sample_count, (SELECT count(*) FROM sent) AS rounds, (SELECT max(n) FROM sent) AS clients, (SELECT CAST(sum(n) AS BIGINT) FROM sent) AS messages_up, (SELECT CAST(sum(n) AS BIGINT) * {MODEL_BYTES} FROM sent) AS bytes_up,
            (SELECT CAST(sum(n) AS BIGINT) * {2 * MODEL_BYTES} FROM sent) AS bytes, {_num(f"(SELECT sum(n) * {2 * MODEL_BYTES} / CAST(1048576 AS DOUBLE) FROM sent)", name="megabytes")},
            (SELECT CAST(round AS BIGINT) FROM evaluation ORDER BY val_rmse, round LIMIT 1) AS best_step, CAST({len(FEATURES)} AS BIGINT) AS parameters, {_num("(SELECT min(val_rmse) FROM evaluation)", name="best_round_rmse")} FROM ({scores})""",
        ),
        "run_history": _with(
            *complete, _HISTORY, stops,
            query=f"SELECT run, CAST(epoch AS BIGINT) AS epoch, {_num('val_rmse')}, CAST(first_value(epoch) OVER best AS BIGINT) AS best_epoch, {_num('min(val_rmse) OVER (PARTITION BY run)', name='best_val_rmse')}, stopped_at, stopped_early, count(*) OVER (PARTITION BY run) AS steps FROM done WINDOW best AS (PARTITION BY run ORDER BY val_rmse, epoch)",
        ),
        "time_formats": out["clean_readings"],
        "imputed_split_chunks": out["imputed_split_users"],
        "sliding_windows_chunks": out["sliding_windows_long"],
        "baseline_metrics_chunks": out["baseline_metrics_users"],
        "scaler_chunks": out["scaler_standard_users"],
        "client_windows": _with(
            *complete, _TARGETS, _WINDOWS, _iid(300),
            query=f"""SELECT client_id, w.split, w.station_id, {_text("w.t").replace("AS w.", "AS ")}, {_num("w.y", 5, "y")}, {_num(f"w.{FEATURES[0]}", 5, "first")}
            FROM windows w JOIN assigned a ON a.split = w.split AND a.station_id = w.station_id AND a.t = w.t WHERE step = 0 AND client_id IN ('client_000', 'client_007', 'client_256', 'client_299')""",
        ),
        "fedavg_chunks": out["fedavg_parameters"],
        "scaler_files": out["scaler_standard"],
        "prediction_files": _with(*complete, _TARGETS, _NAIVE, query=f"SELECT form, {_text('t')}, station_id, {_num('y_true', 5)}, {_num('y_pred', 5)}, method_name AS method FROM naive CROSS JOIN (VALUES ('long'), ('short')) f(form) WHERE split = 'test'"),
        "metric_files": out["baseline_metrics"],
        "round_files": out["communication_rounds"],
        "skipped_stations": _with(query="SELECT station_id, count(*) AS rows_before_cleaning, 'no valid time' AS reason FROM readings GROUP BY station_id HAVING CAST(station_id AS BIGINT) % 7 = 0 OR count(*) FILTER (WHERE time <> 'not-a-time') = 0", station="user_id"),
        "task_violations": _with(
            *complete,
            query="SELECT * FROM (SELECT 'window_size' AS setting, '24' AS found, '12' AS supported UNION ALL SELECT 'stations', CAST(count(*) AS VARCHAR), '3' FROM valid) WHERE found <> supported",
        ),
        "first_rows": _with(*complete, _TARGETS, _NAIVE, query=f"SELECT {_text('t')}, station_id, method_name, {_num('y_true', 5)}, {_num('y_pred', 5)} FROM naive ORDER BY naive.t, station_id, method_name LIMIT 500"),
    }
    return out
