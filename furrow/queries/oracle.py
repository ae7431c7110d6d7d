"""SQL that states the expected result of each registered query on the same tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def sql(name: str, *ctes: str, recursive: bool = False, body: str) -> None:
    head = ""
    if ctes:
        head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"
    ORACLE[name] = head + body


def r(expr: str, places: int = 6) -> str:
    return f"(round({expr}, {places}) + 0.0)"


def settled(expr: str, places: int = 9) -> str:
    return r(f"{expr} + CAST(1e-11 AS DOUBLE)", places)


# --- histograms -----------------------------------------------------------

PX = """px AS (SELECT user_id AS image_id, event_type AS batch,
       CAST(least(255, floor(value / 2) + user_id % 8) AS INTEGER) AS bin FROM events)"""
HIST = "hist AS (SELECT image_id, bin, count(*) AS n FROM px GROUP BY image_id, bin)"
TOTAL = "total AS (SELECT bin, sum(n) AS n FROM hist GROUP BY bin)"


def shift_cte(name: str, hist: str, ref: str) -> str:
    return f"""{name} AS (
  SELECT image_id, CAST(lag AS INTEGER) AS shift FROM (
    SELECT image_id, lag, row_number() OVER (PARTITION BY image_id ORDER BY c DESC, lag) AS k FROM (
      SELECT h.image_id, h.bin - t.bin AS lag, sum(h.n * t.n) AS c
      FROM {hist} h CROSS JOIN {ref} t GROUP BY h.image_id, h.bin - t.bin)) WHERE k = 1)"""


SHIFT = shift_cte("shifts", "hist", "total")
sql("image_histogram", PX, body="SELECT image_id, bin, count(*) AS n FROM px GROUP BY image_id, bin")
ORACLE["cached_histogram"] = ORACLE["image_histogram"]
sql(
    "mean_histogram", PX, HIST, TOTAL,
    body=f"""SELECT CAST(b.bin AS INTEGER) AS bin,
  {r("coalesce(total.n, 0) / (SELECT count(DISTINCT image_id) FROM hist)")} AS mean_n
FROM range(256) b(bin) LEFT JOIN total ON total.bin = b.bin""",
)
sql("histogram_shift_mean", PX, HIST, TOTAL, SHIFT, body="SELECT image_id, shift FROM shifts")
sql(
    "histogram_shift_first", PX, HIST, TOTAL,
    "lead AS (SELECT * FROM hist WHERE image_id = (SELECT min(image_id) FROM hist))",
    shift_cte("own", "hist", "lead"), shift_cte("overall", "lead", "total"),
    body="SELECT image_id, CAST(shift + (SELECT shift FROM overall) AS INTEGER) AS shift FROM own",
)
sql(
    "histogram_shift_by_batch", PX,
    "hist AS (SELECT batch, image_id, bin, count(*) AS n FROM px GROUP BY ALL)",
    "total AS (SELECT batch, bin, sum(n) AS n FROM hist GROUP BY ALL)",
    body="""SELECT batch, image_id, CAST(lag AS INTEGER) AS shift FROM (
  SELECT batch, image_id, lag, row_number() OVER (PARTITION BY batch, image_id ORDER BY c DESC, lag) AS k FROM (
    SELECT h.batch, h.image_id, h.bin - t.bin AS lag, sum(h.n * t.n) AS c
    FROM hist h JOIN total t ON h.batch = t.batch GROUP BY ALL)) WHERE k = 1""",
)
sql(
    "aligned_mean_histogram", PX, HIST, TOTAL, SHIFT,
    "moved AS (SELECT ((bin - shift) % 256 + 256) % 256 AS bin, sum(n) AS n FROM hist JOIN shifts USING (image_id) GROUP BY 1)",
    body=f"""SELECT CAST(b.bin AS INTEGER) AS bin,
  {r("coalesce(moved.n, 0) / (SELECT count(DISTINCT image_id) FROM hist)")} AS mean_n
FROM range(256) b(bin) LEFT JOIN moved ON moved.bin = b.bin""",
)
sql(
    "flower_fraction", PX, HIST, TOTAL, SHIFT,
    body=f"""SELECT image_id, shift,
  {r("coalesce(sum(n) FILTER (WHERE bin BETWEEN 20 + shift AND 60 + shift), 0) / sum(n)")} AS share
FROM hist JOIN shifts USING (image_id) GROUP BY image_id, shift""",
)
COARSE = """hist AS (SELECT user_id AS image_id, least(255, floor(value / 8)) AS bin, count(*) AS n FROM events GROUP BY ALL),
images AS (SELECT image_id, max(n) AS largest, CAST(sum(n) AS BIGINT) AS n_pixels FROM hist GROUP BY image_id)"""
sql("largest_bin", COARSE, body="SELECT image_id, largest FROM images")
sql("bad_frames", COARSE, body="SELECT image_id FROM images WHERE largest >= CAST(0.2 AS DOUBLE) * n_pixels")
sql(
    "drop_bad_frames", COARSE,
    body="SELECT image_id, n_pixels FROM images WHERE NOT largest >= CAST(0.2 AS DOUBLE) * n_pixels",
)

# --- frame series ---------------------------------------------------------

CLOCK = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"

FR = """fr AS (SELECT strftime(ts, '%Y-%m-%d') AS batch, event_id AS image_id, ts, value AS metric,
       event_type = 'error' AS counted FROM events)"""
NUMBERED = "num AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY ts NULLS FIRST, image_id) AS rn FROM fr)"


def nearest(label: str, value: str, centroids) -> str:
    gaps = [f"abs({value} - {c})" for c in centroids]
    whens = [
        f"WHEN {' AND '.join(f'{gaps[i]} <= {g}' for g in gaps[i + 1:])} THEN {i}" for i in range(len(gaps) - 1)
    ]
    return f"CAST(CASE {' '.join(whens)} ELSE {len(gaps) - 1} END AS INTEGER) AS {label}"


def interpolated(value: str) -> str:
    back = "OVER (PARTITION BY batch ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "OVER (PARTITION BY batch ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""known AS (SELECT *, CASE WHEN counted THEN CAST({value} AS DOUBLE) END AS kv,
           CASE WHEN counted THEN rn END AS kr FROM num),
near AS (SELECT *, last_value(kv IGNORE NULLS) {back} AS pv, last_value(kr IGNORE NULLS) {back} AS pr,
         first_value(kv IGNORE NULLS) {ahead} AS nv, first_value(kr IGNORE NULLS) {ahead} AS nr FROM known),
filled AS (SELECT *, CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL OR nr = pr THEN pv
           ELSE pv + (nv - pv) * (rn - pr) / (nr - pr) END AS estimate FROM near)"""


SMOOTHED = """smoothed AS (SELECT *, avg({0}) OVER (PARTITION BY batch ORDER BY rn
              ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING) AS mean FROM {1})"""
sql(
    "fill_timestamps",
    "gap AS (SELECT event_id AS image_id, CASE WHEN event_id % 7 <> 3 THEN ts END AS ts FROM events)",
    "num AS (SELECT *, row_number() OVER (ORDER BY image_id) AS rn FROM gap)",
    """near AS (SELECT *, last_value(ts IGNORE NULLS) OVER w AS pt,
      last_value(CASE WHEN ts IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS pr
      FROM num WINDOW w AS (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    body=f"SELECT image_id, {CLOCK.format('pt + (rn - pr) * INTERVAL 1 MINUTE')} AS ts FROM near",
)
sql("known_timestamps", FR, body=f"SELECT image_id, {CLOCK.format('ts')} AS ts FROM fr WHERE image_id IN (SELECT image_id FROM fr WHERE counted)")
sql("interpolate_metric", FR, NUMBERED, interpolated("metric"),
    body=f"SELECT batch, image_id, {r('estimate', 8)} AS estimate FROM filled")
sql("interpolate_count", FR, NUMBERED, interpolated("floor(metric)"),
    body=f"SELECT batch, image_id, {r('estimate', 8)} AS estimate FROM filled")
sql("moving_average_60", FR, NUMBERED, SMOOTHED.format("metric", "num"),
    body=f"SELECT batch, image_id, {r('mean', 8)} AS smoothed FROM smoothed")
sql("estimate_metric", FR, NUMBERED, interpolated("metric"), SMOOTHED.format("estimate", "filled"),
    body=f"SELECT batch, image_id, {settled('mean')} AS estimate FROM smoothed")

PERIODS = """per AS (SELECT *, CAST(CASE WHEN hour({0}) >= 18 THEN 3 WHEN hour({0}) >= 12 THEN 2
       WHEN hour({0}) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS period FROM {1}),
every AS (SELECT batch, CAST(p.period AS INTEGER) AS period
          FROM (SELECT DISTINCT batch FROM {2}) CROSS JOIN range(4) p(period))"""


def modal(source: str, keys: str, value: str, tol: int, name: str) -> str:
    using = ", ".join(keys)
    same = " AND ".join(f"s.{k} = v.{k}" for k in keys)
    return f"""span AS (SELECT {using}, floor(min({value}) / {tol}) * {tol} AS lo, ceil(max({value}) / {tol}) * {tol} AS hi
         FROM {source} GROUP BY {using}),
bins AS (SELECT {", ".join("v." + k for k in keys)},
         s.lo + {tol} * least(floor((v.{value} - s.lo) / {tol}), greatest(1, (s.hi - s.lo) / {tol}) - 1) AS bin_left,
         count(*) AS n FROM {source} v JOIN span s ON {same} GROUP BY ALL),
modes AS (SELECT {using}, bin_left + {tol} / CAST(2 AS DOUBLE) AS {name} FROM (
          SELECT *, row_number() OVER (PARTITION BY {using} ORDER BY n DESC, bin_left) AS k FROM bins) WHERE k = 1)"""


MEANS = f"""SELECT every.batch, every.period, {settled("coalesce(m, -1)")} AS mean_share FROM every LEFT JOIN
  (SELECT batch, period, avg(metric) AS m FROM per GROUP BY batch, period) g
  ON g.batch = every.batch AND g.period = every.period"""
sql("fraction_by_period", FR, PERIODS.format("ts", "fr", "fr"), body=MEANS)
sql(
    "fraction_by_local_period", FR,
    "loc AS (SELECT *, ts - INTERVAL 6 HOUR AS lts FROM fr)",
    "day AS (SELECT batch, CAST(arg_min(lts, image_id) AS DATE) AS d FROM loc GROUP BY batch)",
    "today AS (SELECT loc.* FROM loc JOIN day ON day.batch = loc.batch AND CAST(lts AS DATE) = d)",
    PERIODS.format("lts", "today", "fr"),
    body=MEANS,
)
sql("fraction_by_day", FR, body=f"SELECT batch, 0 AS period, {settled('avg(metric)')} AS mean_share FROM fr GROUP BY batch")
sql(
    "modal_count_by_period", FR, PERIODS.format("ts", "fr", "fr"),
    "tallied AS (SELECT * FROM per WHERE counted)", modal("tallied", ["batch", "period"], "metric", 5, "typical"),
    body="""SELECT every.batch, every.period, CAST(coalesce(typical, -1) AS DOUBLE) AS typical
FROM every LEFT JOIN modes ON modes.batch = every.batch AND modes.period = every.period""",
)
sql("modal_count_by_day", FR, modal("fr", ["batch"], "metric", 10, "typical"),
    body="SELECT batch, 0 AS period, CAST(typical AS DOUBLE) AS typical FROM modes")
sql("count_histogram", FR, "spots AS (SELECT batch, floor(metric) AS spots FROM fr)",
    modal("spots", ["batch"], "spots", 4, "typical"),
    body="SELECT batch, CAST(bin_left AS DOUBLE) AS bin_left, n FROM bins")
sql(
    "between_counted", FR, "span AS (SELECT batch, min(ts) AS lo, max(ts) AS hi FROM fr WHERE counted GROUP BY batch)",
    body="SELECT fr.batch, image_id, metric FROM fr JOIN span ON fr.batch = span.batch AND ts BETWEEN lo AND hi",
)
sql("fraction_series", FR, body=f"SELECT batch, {CLOCK.format('ts')} AS ts, metric FROM fr")
sql(
    "best_frames", FR,
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY metric, image_id) AS k, "
    f"count(*) OVER (PARTITION BY batch) AS n, {nearest('cluster', 'metric', (10, 60, 150))} FROM fr)",
    body="""SELECT batch, image_id, metric FROM ranked
WHERE k <= floor(n * CAST(0.1 AS DOUBLE)) AND cluster = 0""",
)
sql(
    "systematic_sample", FR, NUMBERED,
    "sizes AS (SELECT batch, count(*) AS n FROM fr GROUP BY batch)",
    """spots AS (SELECT batch, CASE WHEN n <= 24 THEN i ELSE CAST(round_even(i * (n / CAST(24 AS DOUBLE)), 0) AS BIGINT) END + 1
       AS rn FROM sizes CROSS JOIN range(24) t(i))""",
    body="SELECT batch, image_id, rn FROM num WHERE (batch, rn) IN (SELECT (batch, rn) FROM spots)",
)
sql("parity_split", body="SELECT event_id AS image_id, (row_number() OVER (ORDER BY event_id) - 1) % 2 = 0 AS is_train FROM events")
sql("first_frame", FR, body="SELECT batch, min(image_id) AS image_id, arg_min(metric, image_id) AS metric FROM fr GROUP BY batch")
sql("frame_number", FR,
    body="SELECT batch || '/' || image_id || '.jpg' AS path, image_id AS number FROM fr")
sql("reset_clusters", FR, body="SELECT batch, 0 AS cluster, count(*) AS n FROM fr GROUP BY batch")
sql("cluster_filter", FR, body=f"""SELECT image_id, cluster FROM
  (SELECT image_id, {nearest('cluster', 'metric', (10, 60, 150))} FROM fr) WHERE cluster IN (1, 2)""")
sql("flowers_present", FR,
    body="SELECT CAST(max(metric) > 0.0001 AS INTEGER) AS present, max(metric) AS max_share FROM fr")
sql("assign_1d", FR, body=f"SELECT image_id, {nearest('cluster', 'metric', (1, 20, 50, 120))} FROM fr")
sql("two_level_cluster", FR, body=f"""SELECT image_id, CAST(CASE WHEN coarse = 0 THEN fine ELSE coarse + 1 END AS INTEGER) AS cluster
FROM (SELECT image_id, {nearest('coarse', 'metric', (10, 60, 150))}, {nearest('fine', 'metric', (5, 25))} FROM fr)""")


#: Rounds after which no centroid moves any more.
SETTLED = 150


def lloyd(name: str, source: str, k: int, rounds: int) -> str:
    cs = [f"c{j}" for j in range(k)]
    start = ", ".join(f"min(metric) + (max(metric) - min(metric)) * ({j + 0.5} / CAST({k} AS DOUBLE)) AS c{j}" for j in range(k))
    moved = ", ".join(f"coalesce(avg(metric) FILTER (WHERE label = {j}), any_value(c{j})) AS c{j}" for j in range(k))
    return f"""{name}(round, batch, {", ".join(cs)}) AS (
  SELECT 0, batch, {start} FROM {source} GROUP BY batch
  UNION ALL
  SELECT round + 1, batch, {moved} FROM (
    SELECT {name}.*, f.metric, {nearest('label', 'f.metric', [f"{name}.{c}" for c in cs])}
    FROM {name} JOIN {source} f ON f.batch = {name}.batch WHERE round < {rounds})
  GROUP BY round, batch)"""


sql("centroids_by_batch", FR, lloyd("km", "fr", 3, SETTLED), recursive=True,
    body=" UNION ALL ".join(
        f"SELECT batch, CAST({j} AS INTEGER) AS cluster, {settled(f'c{j}')} AS centroid FROM km WHERE round = {SETTLED}" for j in range(3)))
sql(
    "two_level_fit", FR, lloyd("km", "fr", 3, SETTLED),
    "coarse AS (SELECT f.*, " + nearest("coarse", "metric", ("c0", "c1", "c2"))
    + f" FROM fr f JOIN km ON km.batch = f.batch AND km.round = {SETTLED})",
    "low AS (SELECT * FROM coarse WHERE coarse = 0)",
    lloyd("km2", "low", 2, SETTLED),
    "labelled AS (SELECT f.batch, metric, coarse, " + nearest("fine", "metric", ("c0", "c1"))
    + f" FROM coarse f JOIN km2 ON km2.batch = f.batch AND km2.round = {SETTLED})",
    recursive=True,
    body="""SELECT batch, CAST(CASE WHEN coarse = 0 THEN fine ELSE coarse + 1 END AS INTEGER) AS cluster,
  count(*) AS n, min(metric) AS lo FROM labelled GROUP BY 1, 2""",
)
sql(
    "daily_report", FR, NUMBERED, interpolated("metric"), SMOOTHED.format("estimate", "filled"),
    PERIODS.format("ts", "smoothed", "fr"),
    "tallied AS (SELECT batch, period, floor(metric) AS spots FROM per WHERE counted)",
    modal("tallied", ["batch", "period"], "spots", 5, "typical"),
    body=f"""SELECT every.batch, every.period, {settled("coalesce(m, -1)")} AS mean_share,
  CAST(coalesce(typical, -1) AS DOUBLE) AS typical_count
FROM every LEFT JOIN (SELECT batch, period, avg(mean) AS m FROM per GROUP BY batch, period) g
  ON g.batch = every.batch AND g.period = every.period
LEFT JOIN modes ON modes.batch = every.batch AND modes.period = every.period""",
)

# --- geometry and pixels --------------------------------------------------

GRAY = """gray AS (SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(v AS DOUBLE) AS v
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings))"""
BYTES = """bytes AS (SELECT vec_id, i, greatest(0, least(255, floor(CAST(128 AS DOUBLE) + 300 * CAST(v AS DOUBLE) + 0.5))) AS b
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)),
bgr AS (SELECT vec_id // 3 AS image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
  CAST(coalesce(max(b) FILTER (WHERE vec_id % 3 = 0), 0) AS DOUBLE) AS b,
  CAST(coalesce(max(b) FILTER (WHERE vec_id % 3 = 1), 0) AS DOUBLE) AS g,
  CAST(coalesce(max(b) FILTER (WHERE vec_id % 3 = 2), 0) AS DOUBLE) AS r
  FROM bytes GROUP BY vec_id // 3, i)"""


def linear_light(c: str) -> str:
    return f"CASE WHEN {c} / 255 <= CAST(0.04045 AS DOUBLE) THEN {c} / 255 / CAST(12.92 AS DOUBLE) ELSE pow(({c} / 255 + 0.055) / 1.055, 2.4) END"


def lab_curve(t: str) -> str:
    return f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + CAST(16 AS DOUBLE) / 116 END"


LAB = f"""light AS (SELECT image_id, y, x, {linear_light('b')} AS lb, {linear_light('g')} AS lg, {linear_light('r')} AS lr FROM bgr),
xyz AS (SELECT image_id, y, x, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS yy,
  (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS zz FROM light),
lab AS (SELECT image_id, y, x, CAST(greatest(0, least(255, floor(
  200 * (({lab_curve('yy')}) - ({lab_curve('zz')})) + 128 + 0.5))) AS INTEGER) AS lab_b FROM xyz)"""
IN_PLOT = "x BETWEEN 2 AND 6 AND y BETWEEN 2 AND 6"
PLOT_LAB = f"plot AS (SELECT * FROM lab WHERE {IN_PLOT})"

sql("quad_mask", GRAY,
    body=f"SELECT image_id, count(*) AS n_pixels, {r('sum(v)')} AS total FROM gray WHERE {IN_PLOT} GROUP BY image_id")
sql("region_mask", GRAY, body="""SELECT image_id, y, x FROM gray
WHERE (x BETWEEN 3 AND 4 AND y BETWEEN 3 AND 4) OR (x BETWEEN 6 AND 7 AND y BETWEEN 6 AND 7)""")
sql("mask_union", GRAY, body=f"""SELECT image_id, count(*) AS n_pixels, {r('sum(v)')} AS total FROM gray
WHERE (x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 3) OR (x BETWEEN 3 AND 6 AND y BETWEEN 3 AND 6) GROUP BY image_id""")
POINTS = """pt AS (SELECT l_linestatus AS image_id, (l_orderkey * 7 + l_partkey) % 1280 AS x,
  (l_partkey * 3 + l_suppkey) % 720 AS y FROM lineitem)"""
sql("default_plot_points", POINTS, body="""SELECT image_id, count(*) AS n_points FROM pt
WHERE x > 207 AND x < 1014 AND y > 156 AND y < 677 GROUP BY image_id""")
sql("default_area_points", POINTS, body="""SELECT image_id, count(*) AS n_points FROM pt
WHERE x > 476 AND x < 745 AND y > 329 AND y < 503 GROUP BY image_id""")
sql("gray_pixels", BYTES,
    body="SELECT image_id, y, x, CAST(floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5) AS INTEGER) AS gray FROM bgr")
sql("lab_b_pixels", BYTES, LAB, body="SELECT image_id, y, x, lab_b FROM lab")
sql("luminance", BYTES,
    body=f"SELECT image_id, y, x, {r('(0.2125 * r + 0.7154 * g + 0.0721 * b) / 255', 9)} AS luma FROM bgr")
sql("masked_histogram", BYTES, LAB, PLOT_LAB,
    body="SELECT image_id, lab_b AS bin, count(*) AS n FROM plot GROUP BY image_id, lab_b")
sql("flower_mask_pixels", BYTES, LAB, PLOT_LAB, body="SELECT image_id, y, x FROM plot WHERE lab_b BETWEEN 120 AND 200")
sql("highlight_logistic", BYTES, LAB, PLOT_LAB,
    body=f"SELECT image_id, y, x, {r('1 / (1 + exp(ln(1 / CAST(0.99 AS DOUBLE) - 1) / 5 * (lab_b - 135)))')} AS v FROM plot")
sql("highlight_linear", BYTES, LAB, PLOT_LAB, body=f"""SELECT image_id, y, x,
  {r("greatest(0, least(1, (least(greatest(lab_b, 0), 150) - 132) / CAST(150 AS DOUBLE)))")} AS v FROM plot""")
PLOT_HIST = "hist AS (SELECT image_id, lab_b AS bin, count(*) AS n FROM plot GROUP BY ALL)"
SHIFTED = [BYTES, LAB, PLOT_LAB, PLOT_HIST, TOTAL, SHIFT]
RAMP = "((140 + shift) % 256 + 256) % 256"
sql("flower_mask_shifted", *SHIFTED,
    body="SELECT image_id, y, x FROM plot JOIN shifts USING (image_id) WHERE lab_b BETWEEN 120 + shift AND 150 + shift")
sql("highlight_logistic_shifted", *SHIFTED, body=f"""SELECT image_id, y, x,
  {r('1 / (1 + exp(ln(1 / CAST(0.99 AS DOUBLE) - 1) / 5 * (lab_b - 135 - shift)))')} AS v FROM plot JOIN shifts USING (image_id)""")
sql("highlight_linear_shifted", *SHIFTED, body=f"""SELECT image_id, y, x,
  {r("greatest(0, least(1, (least(greatest(lab_b, 0), t + 10) - (t - 8)) / CAST(t + 10 AS DOUBLE)))")} AS v
FROM (SELECT *, {RAMP} AS t FROM plot JOIN shifts USING (image_id))""")
PEAKS = """peaks AS (SELECT * FROM gray a WHERE v > 0.1 AND NOT EXISTS (
  SELECT 1 FROM gray b WHERE b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1
  AND (b.y <> a.y OR b.x <> a.x)
  AND (b.v > a.v OR (b.v = a.v AND (b.y < a.y OR (b.y = a.y AND b.x < a.x))))))"""
sql("spot_peaks", GRAY, PEAKS, body=f"SELECT image_id, y, x, {r('v')} AS score FROM peaks")
sql("spot_count", GRAY, PEAKS, body="""SELECT i.image_id, count(peaks.image_id) AS n_spots
FROM (SELECT DISTINCT image_id FROM gray) i LEFT JOIN peaks ON peaks.image_id = i.image_id GROUP BY i.image_id""")
sql(
    "frame_analysis", BYTES, LAB, PLOT_LAB,
    "hist AS (SELECT image_id % 2 AS batch, image_id, lab_b AS bin, count(*) AS n FROM plot GROUP BY ALL)",
    "total AS (SELECT batch, bin, sum(n) AS n FROM hist GROUP BY ALL)",
    "lead AS (SELECT * FROM hist WHERE image_id IN (SELECT min(image_id) FROM hist GROUP BY batch))",
    """own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c DESC, lag) AS k FROM (
      SELECT h.batch, h.image_id, h.bin - t.bin AS lag, sum(h.n * t.n) AS c FROM hist h JOIN lead t ON h.batch = t.batch
      GROUP BY ALL)) WHERE k = 1)""",
    """overall AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY c DESC, lag) AS k FROM (
      SELECT h.batch, h.bin - t.bin AS lag, sum(h.n * t.n) AS c FROM lead h JOIN total t ON h.batch = t.batch
      GROUP BY ALL)) WHERE k = 1)""",
    "shifts AS (SELECT own.batch, image_id, own.lag + overall.lag AS shift FROM own JOIN overall ON own.batch = overall.batch)",
    """share AS (SELECT hist.image_id, coalesce(sum(n) FILTER (WHERE bin BETWEEN 120 + shift AND 200 + shift), 0) / 25 AS share
      FROM hist JOIN shifts ON hist.image_id = shifts.image_id GROUP BY hist.image_id)""",
    "level AS (SELECT plot.*, ((120 + shift) % 256 + 256) % 256 AS t FROM plot JOIN shifts ON plot.image_id = shifts.image_id)",
    """bright AS (SELECT image_id, y, x,
      greatest(0, least(1, (least(lab_b, t + 10) - (t - 8)) / CAST(t + 10 AS DOUBLE))) AS v FROM level)""",
    """spots AS (SELECT image_id, count(*) AS n FROM bright a WHERE v > 0 AND NOT EXISTS (
      SELECT 1 FROM bright b WHERE b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1
      AND (b.v > a.v OR (b.v = a.v AND (b.y < a.y OR (b.y = a.y AND b.x < a.x))))) GROUP BY image_id)""",
    body=f"""SELECT CAST(s.batch AS VARCHAR) AS batch, CAST(s.image_id AS VARCHAR) AS image_id,
  CAST(shift AS INTEGER) AS shift, {r('share')} AS share, CAST(coalesce(spots.n, 0) AS INTEGER) AS n_spots
FROM shifts s JOIN share ON share.image_id = s.image_id LEFT JOIN spots ON spots.image_id = s.image_id""",
)

# --- descriptors ----------------------------------------------------------

VALUES = """vals AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS i
  FROM embeddings)"""
sql("explode_descriptors", VALUES, body=f"""SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS pos, {r('sum(v)')} AS total
FROM vals GROUP BY vec_id, i // 8""")
sql("first_descriptor", VALUES,
    body=f"SELECT vec_id AS image_id, {r('sum(v)')} AS total FROM vals WHERE i < 8 GROUP BY vec_id")
sql("tile_descriptors", GRAY, body=f"""SELECT image_id, CAST(y // 4 AS BIGINT) AS tile_y, CAST(x // 4 AS BIGINT) AS tile_x,
  {r('avg(v)')} AS mean, {r('var_pop(v)')} AS variance,
  {r('covar_pop(v, x % 4) / var_pop(x % 4)')} AS slope_x, {r('covar_pop(v, y % 4) / var_pop(y % 4)')} AS slope_y
FROM gray GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY image_id, y // 4, x // 4"))
WORDS = f"""{VALUES},
centres AS (SELECT label, i, avg(v) AS c FROM vals GROUP BY label, i),
words AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS word FROM (SELECT DISTINCT label FROM embeddings)),
dists AS (SELECT vec_id, word, sqrt(sum((v - c) * (v - c))) AS dist
  FROM vals JOIN centres ON vals.i = centres.i JOIN words ON words.label = centres.label GROUP BY vec_id, word),
assigned AS (SELECT vec_id % 50 AS image_id, vec_id AS pos, word, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, word) AS k FROM dists) WHERE k = 1)"""


def pooled(agg: str) -> str:
    return f"""pooled AS (SELECT im.image_id, words.word, coalesce(p.pooled, 0) AS pooled, p.pooled IS NOT NULL AS used
  FROM (SELECT DISTINCT image_id FROM assigned) im CROSS JOIN words
  LEFT JOIN (SELECT image_id, word, {agg}(dist) AS pooled FROM assigned GROUP BY image_id, word) p
  ON p.image_id = im.image_id AND p.word = words.word)"""


sql("nearest_center", WORDS, body=f"SELECT image_id, pos, word, {r('dist')} AS dist FROM assigned")
sql("pooled_max", WORDS, pooled("max"), body=f"SELECT image_id, word, {r('pooled')} AS pooled FROM pooled")
sql("pooled_sum", WORDS, pooled("sum"), body=f"SELECT image_id, word, {r('pooled')} AS pooled FROM pooled")
PICK = """picked AS (SELECT image_id, CAST(word + 1 AS INTEGER) AS "group" FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pooled, word) AS k FROM pooled{0}) WHERE k = 1)"""
sql("image_group", WORDS, pooled("max"), PICK.format(""), body="SELECT * FROM picked")
sql("image_group_used", WORDS, pooled("max"), PICK.format(" WHERE used"), body="SELECT * FROM picked")
sql("group_members", WORDS, pooled("max"), PICK.format(" WHERE used"),
    body='SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY image_id) AS position FROM picked')


def fitted(source: str, k: int, rounds: int) -> str:
    """Lloyd's rounds over (id, e) from the first k vectors by id; ``words`` holds each vector's nearest final centre."""
    steps = [f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS word, e AS c FROM (SELECT * FROM {source} ORDER BY id LIMIT {k}))"]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT id, e, word, dist FROM (SELECT id, e, word, list_distance(e, c) AS dist,
  row_number() OVER (PARTITION BY id ORDER BY list_distance(e, c), word) AS place FROM {source}, c{i}) WHERE place = 1)""")
        steps.append(f"""m{i} AS MATERIALIZED (SELECT word, list(x ORDER BY i) AS c FROM (SELECT word, i, avg(x) AS x FROM
  (SELECT word, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{i}) GROUP BY word, i) GROUP BY word)""")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.word, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m ON m.word = o.word)")
    return ",\n".join(steps)


DOUBLES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e"
sql(
    "kmeans_groups", f"vecs AS MATERIALIZED (SELECT vec_id AS id, {DOUBLES} FROM embeddings)", fitted("vecs", 3, 5),
    """pooled AS (SELECT im.image_id, w.word, coalesce(p.pooled, 0) AS pooled FROM (SELECT DISTINCT id % 50 AS image_id FROM vecs) im CROSS JOIN range(3) w(word)
  LEFT JOIN (SELECT id % 50 AS image_id, word, max(dist) AS pooled FROM a5 GROUP BY ALL) p ON p.image_id = im.image_id AND p.word = w.word)""",
    PICK.format(""), body="SELECT * FROM picked",
)
sql(
    "kmeans_first", f"vecs AS MATERIALIZED (SELECT vec_id % 50 AS id, arg_min(e, vec_id) AS e FROM (SELECT vec_id, {DOUBLES} FROM embeddings) GROUP BY 1)",
    fitted("vecs", 3, 20), body='SELECT id AS image_id, CAST(word + 1 AS INTEGER) AS "group" FROM a20',
)

# --- count tables ---------------------------------------------------------

COUNTS = """counts AS (SELECT l_linestatus AS condition, l_suppkey AS sample_id, p_brand AS taxon, sum(l_quantity) AS n,
  l_linestatus || '|' || l_suppkey AS sample
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_linestatus, l_suppkey, p_brand)"""
FINE = COUNTS.replace("p_brand", "p_brand || '/' || p_size")


def linked(base: str, number: str, *groups: int) -> str:
    names = ", ".join([base, *(f"'group of {g}/' || CAST({number} // {g} AS VARCHAR)" for g in groups)])
    return f"""counts AS (SELECT l_linestatus AS condition, l_suppkey AS sample_id, taxon, sum(l_quantity) AS n,
  l_linestatus || '|' || l_suppkey AS sample
  FROM (SELECT l_linestatus, l_suppkey, l_quantity, unnest([{names}]) AS taxon FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY l_linestatus, l_suppkey, taxon)"""


BRAND = "CAST(substr(p_brand, 7) AS INTEGER)"
LINKED = linked("p_brand", BRAND, 2, 3)
LINKED_FINE = linked("p_brand || '/' || p_size", f"({BRAND} * 100 + p_size)", 2)
PROFILE = """profile AS (SELECT taxon, coalesce(sum(n) FILTER (WHERE condition = 'F'), 0) AS a,
  coalesce(sum(n) FILTER (WHERE condition = 'O'), 0) AS b FROM counts GROUP BY taxon)"""
PRUNED = "kept AS (SELECT taxon FROM counts GROUP BY taxon HAVING max(n) > 90)"
sql("stack_conditions", COUNTS,
    body="SELECT condition, count(*) AS n_cells, sum(n) AS total FROM counts GROUP BY condition")
sql(
    "wide_matrix", COUNTS,
    body="""SELECT s.sample, t.taxon, CAST(coalesce(c.n, 0) AS DOUBLE) AS n
FROM (SELECT DISTINCT sample FROM counts) s CROSS JOIN (SELECT DISTINCT taxon FROM counts) t
LEFT JOIN counts c ON c.sample = s.sample AND c.taxon = t.taxon""",
)
sql("melt_positive", FINE, body="SELECT taxon AS var1, condition AS var2, sum(n) AS edge FROM counts GROUP BY ALL HAVING sum(n) > 0")
sql("prune_taxa", FINE, PRUNED, body="SELECT taxon, condition, sample_id, n FROM counts WHERE taxon IN (SELECT taxon FROM kept)")
sql("smooth_a", COUNTS,
    body=f"SELECT sample, taxon, {r('(n + 1) / sum(n) OVER (PARTITION BY taxon)', 9)} AS smoothed FROM counts")
sql("smooth_b", COUNTS, body=f"""SELECT sample, taxon,
  {r('(n + 1) / (sum(n) OVER (PARTITION BY taxon) + (SELECT count(DISTINCT sample) FROM counts))', 9)} AS smoothed FROM counts""")
sql("profiles", FINE, PROFILE, body="SELECT taxon, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM profile")
ORACLE["csv_profiles"] = ORACLE["profiles"]
sql("align_profiles", FINE, PROFILE, PRUNED,
    body="SELECT taxon, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM profile WHERE taxon IN (SELECT taxon FROM kept)")
sql("smooth_profiles", FINE, PROFILE, body=f"""SELECT taxon, {r('(a + 1) / (sum(a) OVER () + count(*) OVER ())', 9)} AS a,
  {r('(b + 1) / (sum(b) OVER () + count(*) OVER ())', 9)} AS b FROM profile""")

# Dense cells: absent ones count as zero.
CELLS = """cells AS (SELECT s.sample, t.taxon, CAST(coalesce(c.n, 0) AS DOUBLE) AS n
  FROM (SELECT DISTINCT sample FROM counts) s CROSS JOIN (SELECT DISTINCT taxon FROM counts) t
  LEFT JOIN counts c ON c.sample = s.sample AND c.taxon = t.taxon)"""
RANKED = """ranked AS (SELECT sample, taxon, rank() OVER (PARTITION BY taxon ORDER BY n)
  + (count(*) OVER (PARTITION BY taxon, n) - 1) / CAST(2 AS DOUBLE) AS n FROM cells)"""


def pairs(source: str) -> str:
    return f"""pairs AS (SELECT a.taxon AS t1, b.taxon AS t2, corr(a.n, b.n) AS r FROM {source} a JOIN {source} b
  ON a.sample = b.sample AND a.taxon < b.taxon GROUP BY a.taxon, b.taxon)"""


SPARSE_PAIRS = """stats AS (SELECT taxon, sum(n) AS s, sum(n * n) AS q FROM counts GROUP BY taxon),
size AS (SELECT count(DISTINCT sample) AS m FROM counts),
products AS (SELECT a.taxon AS t1, b.taxon AS t2, sum(a.n * b.n) AS p FROM counts a JOIN counts b
  ON a.sample = b.sample AND a.taxon < b.taxon GROUP BY a.taxon, b.taxon),
pairs AS (SELECT a.taxon AS t1, b.taxon AS t2,
  (m * coalesce(p, 0) - a.s * b.s) / (sqrt(m * a.q - a.s * a.s) * sqrt(m * b.q - b.s * b.s)) AS r
  FROM stats a JOIN stats b ON a.taxon < b.taxon CROSS JOIN size
  LEFT JOIN products ON products.t1 = a.taxon AND products.t2 = b.taxon)"""


STRONG = "edges AS (SELECT t1 AS src, t2 AS dst, round(abs(r), 9) AS weight FROM pairs WHERE round(abs(r), 9) >= 0.5)"


EDGES = f"SELECT src, dst, {r('weight')} AS weight FROM edges"
sql("pearson_matrix", COUNTS, CELLS, pairs("cells"), body=f"SELECT t1, t2, {r('r')} AS r FROM pairs")
sql("spearman_matrix", COUNTS, CELLS, RANKED, pairs("ranked"), body=f"SELECT t1, t2, {r('r')} AS r FROM pairs")
sql("pearson_edges", LINKED, CELLS, pairs("cells"), STRONG, body=EDGES)
sql("spearman_edges", LINKED, CELLS, RANKED, pairs("ranked"), STRONG, body=EDGES)
sql("sparse_pearson_edges", LINKED_FINE, SPARSE_PAIRS, STRONG, body=EDGES)
sql("sparse_spearman_edges", LINKED_FINE, CELLS, RANKED, pairs("ranked"), STRONG, body=EDGES)

# --- graphs ---------------------------------------------------------------

GRAPH = [
    LINKED, CELLS, pairs("cells"), STRONG,
    "nodes AS (SELECT taxon AS id FROM cells GROUP BY taxon HAVING min(n) < max(n))",
    "size AS (SELECT count(*) AS n FROM nodes)",
    "adj AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)",
]
DEGREE = "deg AS (SELECT id AS node, (count(dst) + {0}) / (any_value(n) - 1) AS score FROM nodes CROSS JOIN size LEFT JOIN adj ON src = id GROUP BY id)"
DIST = """walk(s, v, d) AS (SELECT id, id, 0 FROM nodes
  UNION SELECT s, dst, d + 1 FROM walk JOIN adj ON v = src CROSS JOIN size WHERE d + 1 < n),
dist AS (SELECT s, v, min(d) AS d FROM walk GROUP BY s, v)"""
sql("degree_centrality", *GRAPH, DEGREE.format(0), body=f"SELECT node, {r('score')} AS score FROM deg")
sql("degree_with_self_loops", *GRAPH, DEGREE.format(2), body=f"SELECT node, {r('score')} AS score FROM deg")
sql("top_taxa", *GRAPH, DEGREE.format(0),
    body=f"SELECT node, {r('score')} AS score FROM deg ORDER BY round(score, 6) DESC, node LIMIT 5")
CLOSENESS = f"""SELECT s AS node, {r("coalesce((count(*) - 1) / nullif(sum(d), 0) * (count(*) - 1) / (any_value(n) - 1), 0)")} AS score
FROM dist CROSS JOIN size GROUP BY s"""
sql("closeness_centrality", *GRAPH, DIST, recursive=True, body=CLOSENESS)
sql("closeness_sketch", *GRAPH, DIST, recursive=True, body=CLOSENESS)
THROUGH = [
    """paths(s, v, d, c) AS (SELECT id, id, 0, CAST(1 AS DOUBLE) FROM nodes
  UNION ALL SELECT paths.s, adj.dst, paths.d + 1, sum(c) FROM paths JOIN adj ON paths.v = adj.src
  JOIN dist ON dist.s = paths.s AND dist.v = adj.dst AND dist.d = paths.d + 1 GROUP BY paths.s, adj.dst, paths.d + 1)""",
    """through AS (SELECT a.v AS node, sum(a.c * b.c / e.c) AS score FROM paths a JOIN paths b ON a.v = b.s
  JOIN paths e ON e.s = a.s AND e.v = b.v AND e.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY a.v)""",
]
BETWEENNESS = f"""SELECT id AS node, {r("coalesce(score, 0) / ((n - 1) * (n - 2))")} AS score
FROM nodes CROSS JOIN size LEFT JOIN through ON node = id"""
sql("betweenness_centrality", *GRAPH, DIST, *THROUGH, recursive=True, body=BETWEENNESS)
sql("betweenness_draws", *GRAPH, DIST, *THROUGH, recursive=True, body=BETWEENNESS)


def squared(rounds: int) -> str:
    """The matrix of links and one loop a node, squared and scaled again and again: a power of 2**rounds."""
    steps = ["m0 AS MATERIALIZED (SELECT src AS i, dst AS j, CAST(1 AS DOUBLE) AS x FROM adj UNION ALL SELECT id, id, 1 FROM nodes)"]
    for k in range(rounds):
        product = f"SELECT a.i, b.j, sum(a.x * b.x) AS x FROM m{k} a JOIN m{k} b ON a.j = b.i GROUP BY a.i, b.j"
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT i, j, x / max(x) OVER () AS x FROM ({product}))")
    return ",\n".join(steps)


sql(
    "eigenvector_centrality", *GRAPH, squared(16), "lead AS (SELECT i AS node, sum(x) AS x FROM m16 GROUP BY i)",
    body=f"SELECT node, {r('x / sqrt(sum(x * x) OVER ())')} AS score FROM lead",
)

# --- divergence and winnowing ---------------------------------------------

SMOOTH = """smooth AS (SELECT taxon, (a + 1) / (sum(a) OVER () + count(*) OVER ()) AS a,
  (b + 1) / (sum(b) OVER () + count(*) OVER ()) AS b FROM profile)"""
KL = "sum(a / sa * log2((a / sa) / (b / sb)))"
sql("kl_divergence", FINE, PROFILE, SMOOTH,
    body=f"SELECT {r(KL, 9)} AS kl FROM smooth CROSS JOIN (SELECT sum(a) AS sa, sum(b) AS sb FROM smooth)")
sql("kl_divergence_raw", FINE, PROFILE, body=f"""SELECT CASE WHEN max(CASE WHEN a > 0 AND b = 0 THEN 1 ELSE 0 END) = 1
  THEN CAST(1e50 AS DOUBLE) ELSE {r("sum(CASE WHEN a > 0 AND b > 0 THEN a / sa * log2((a / sa) / (b / sb)) ELSE 0 END)", 9)} END AS kl
FROM profile CROSS JOIN (SELECT sum(a) AS sa, sum(b) AS sb FROM profile)""")
sql(
    "divergence_curve", FINE, PROFILE, SMOOTH,
    "ranked AS (SELECT *, row_number() OVER (ORDER BY round(a + b, 12) DESC, taxon) AS rank FROM smooth)",
    """rest AS (SELECT k.rank - 1 AS k, e.a, e.b, sum(e.a) OVER (PARTITION BY k.rank) AS sa, sum(e.b) OVER (PARTITION BY k.rank) AS sb
  FROM ranked k JOIN ranked e ON e.rank >= k.rank)""",
    body=f"SELECT k, {r(KL, 9)} AS kl FROM rest GROUP BY k",
)
sql(
    "winnow_loop",
    LINKED.replace("counts AS", "raw AS"),
    "counts AS (SELECT * FROM raw WHERE taxon IN (SELECT taxon FROM raw GROUP BY taxon HAVING max(n) > 3))",
    *GRAPH[1:], PROFILE,
    """pull(step, gone, taxon, score) AS (
  SELECT -1, CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE)
  UNION ALL
  SELECT step + 1, list_append(gone, first(node ORDER BY deg DESC, node)), first(node ORDER BY deg DESC, node),
    CASE WHEN count(*) > 1 THEN max(deg) / CAST(count(*) - 1 AS DOUBLE) ELSE 1 END
  FROM (SELECT step, gone, id AS node, count(dst) AS deg FROM pull JOIN nodes ON NOT list_contains(gone, id)
    LEFT JOIN adj ON src = id AND NOT list_contains(gone, dst) WHERE step < 49 GROUP BY step, gone, id)
  GROUP BY step, gone)""",
    """rest AS (SELECT step, a + 1 AS a, b + 1 AS b, sum(a + 1) OVER (PARTITION BY step) AS sa, sum(b + 1) OVER (PARTITION BY step) AS sb
  FROM pull JOIN profile ON NOT list_contains(gone, profile.taxon) WHERE step >= 0)""",
    recursive=True,
    body=f"""SELECT CAST(pull.step AS INTEGER) AS step, taxon, {r('score')} AS score, kl
FROM pull LEFT JOIN (SELECT step, {r(KL, 9)} AS kl FROM rest GROUP BY step) g ON g.step = pull.step WHERE pull.step >= 0""",
)



def winnowed(steps: int) -> list[str]:
    """Betweenness of what is left, and its highest node, for every step."""
    parts = ["left0 AS MATERIALIZED (SELECT id FROM nodes)"]
    for k in range(steps):
        parts.append(f"""adj{k} AS MATERIALIZED (SELECT src, dst FROM adj WHERE src IN (FROM left{k}) AND dst IN (FROM left{k})),
walk{k}(s, v, d) AS (SELECT id, id, 0 FROM left{k} UNION SELECT s, dst, d + 1 FROM walk{k} JOIN adj{k} ON v = src CROSS JOIN size WHERE d + 1 < n),
dist{k} AS MATERIALIZED (SELECT s, v, min(d) AS d FROM walk{k} GROUP BY s, v),
paths{k}(s, v, d, c) AS (SELECT id, id, 0, CAST(1 AS DOUBLE) FROM left{k}
  UNION ALL SELECT p.s, a.dst, p.d + 1, sum(c) FROM paths{k} p JOIN adj{k} a ON p.v = a.src
  JOIN dist{k} t ON t.s = p.s AND t.v = a.dst AND t.d = p.d + 1 GROUP BY p.s, a.dst, p.d + 1),
held{k} AS MATERIALIZED (FROM paths{k}),
through{k} AS (SELECT a.v AS node, sum(a.c * b.c / e.c) AS score FROM held{k} a JOIN held{k} b ON a.v = b.s
  JOIN held{k} e ON e.s = a.s AND e.v = b.v AND e.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY a.v),
best{k} AS MATERIALIZED (SELECT {k} AS step, id AS taxon, coalesce(score, 0) / greatest(1, (n - 1) * (n - 2)) AS score
  FROM left{k} CROSS JOIN (SELECT count(*) AS n FROM left{k}) LEFT JOIN through{k} ON node = id
  ORDER BY round(coalesce(score, 0) / greatest(1, (n - 1) * (n - 2)), 9) DESC, id LIMIT 1),
left{k + 1} AS MATERIALIZED (SELECT id FROM left{k} WHERE id NOT IN (SELECT taxon FROM best{k}))""")
    return [*parts, f"pull AS MATERIALIZED ({' UNION ALL '.join(f'FROM best{k}' for k in range(steps))})"]


DEFAULTS = [
    LINKED.replace("counts AS", "raw AS"),
    "counts AS MATERIALIZED (SELECT * FROM raw WHERE taxon IN (SELECT taxon FROM raw GROUP BY taxon HAVING max(n) > 3))",
    CELLS, RANKED, pairs("ranked").replace("pairs AS", "pairs AS MATERIALIZED"), *GRAPH[3:], PROFILE, SMOOTH,
]
DEFAULTS = [part.replace("adj AS (", "adj AS MATERIALIZED (") for part in DEFAULTS]
sql(
    "winnow_default", *DEFAULTS, *winnowed(50),
    """rest AS (SELECT step, a + 1 AS a, b + 1 AS b, sum(a + 1) OVER (PARTITION BY step) AS sa, sum(b + 1) OVER (PARTITION BY step) AS sb
  FROM range(50) s(step) JOIN profile ON profile.taxon NOT IN (SELECT taxon FROM pull WHERE pull.step <= s.step))""",
    recursive=True,
    body=f"""SELECT CAST(pull.step AS INTEGER) AS step, taxon, {r('score')} AS score, kl
FROM pull LEFT JOIN (SELECT step, {r(KL, 9)} AS kl FROM rest GROUP BY step) g ON g.step = pull.step""",
)
sql("winnow_kept", *DEFAULTS, *winnowed(10), recursive=True,
    body=f"SELECT taxon, {r('a', 9)} AS a, {r('b', 9)} AS b FROM smooth WHERE taxon NOT IN (SELECT taxon FROM pull)")
sql("winnow_matrix", *DEFAULTS, *winnowed(10), recursive=True,
    body=f"""SELECT * FROM (SELECT condition, sample_id, taxon, {r('(n + 1) / (sum(n) OVER (PARTITION BY taxon) + (SELECT count(DISTINCT sample) FROM counts))', 9)} AS smoothed
FROM counts) WHERE taxon NOT IN (SELECT taxon FROM pull)""")

# --- sources and sinks ----------------------------------------------------

sql("group_files", FR,
    body=f'SELECT CAST(image_id AS VARCHAR) AS image_id, {nearest(chr(34) + "group" + chr(34), "metric", (10, 60, 150))} FROM fr')
sql("frame_view", FR, body="SELECT batch, count(*) AS n_frames, count(*) FILTER (WHERE counted) AS n_counted FROM fr GROUP BY batch")
