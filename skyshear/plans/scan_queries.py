"""Queries over product files and scan times."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyshear.model import PRODUCTS, STATIONS
from skyshear.operators import match, scan
from skyshear.plans.views import oracle, view
from skyshear.sources import probes
from skyshear.sources.store import shared_dir
from skyshear.streaming.claims import claims

_PRODUCTS = ", ".join(f"('{c}', '{q}', '{r}')" for c, q, r in PRODUCTS)
_STATIONS = ", ".join(f"('{s}', {a}, {o})" for s, a, o, _ in STATIONS)


def _side(spark, sf, station, name):  # noqa: ANN001, ANN202
    return view(spark, sf, "scans").filter(F.col("station") == station).select(F.col("sec").alias(name))


def _sides(spark, sf):  # noqa: ANN001, ANN202
    return _side(spark, sf, 1, "t1"), _side(spark, sf, 2, "t2")


def _sweeps(spark, sf):  # noqa: ANN001, ANN202
    return view(spark, sf, "gates").select(F.col("radar").alias("station"), "sweep", F.bround(F.col("ray") % 9 * 0.505, 3).alias("elevation")).distinct()


def _nyquist(spark, sf):  # noqa: ANN001, ANN202
    wanted = view(spark, sf, "features").select("id", ((F.col("id") % 200) * 0.1).alias("elevation"))
    config = view(spark, sf, "profile").select((F.col("level") * 0.35).alias("elev"), F.col("speed").alias("speed"))
    return scan.nyquist(wanted, config).select("id", F.round("nyquist", 6).alias("nyquist"))


def _resolve(spark, sf):  # noqa: ANN001, ANN202
    seen = view(spark, sf, "features").select(F.concat(F.lit("Z9"), (F.col("id") % 300 + 300).cast("string")).alias("station"), (F.col("id") % 50).cast("double").alias("header_lat"), (F.col("id") % 70 + 70).cast("double").alias("header_lon"))
    return scan.resolve_stations(seen)


def _domains(spark, sf):  # noqa: ANN001, ANN202
    d = view(spark, sf, "features")
    return scan.dem_tiles(d.select("id", (F.col("fx") / 2e4 + 35).alias("lat_min"), (F.col("fx") / 2e4 + 36.5).alias("lat_max"), (F.col("fy") / 2e4 + 117).alias("lon_min"), (F.col("fy") / 2e4 + 118.2).alias("lon_max")))


def _docs(spark, sf):  # noqa: ANN001, ANN202
    return spark.read.parquet(f"{sf}/documents.parquet")


def _labels(spark, sf):  # noqa: ANN001, ANN202
    return scan.label_names(view(spark, sf, "features").select("id", F.concat(F.lit("a|b "), F.when(F.col("id") % 2 == 0, F.lit("| town ")).otherwise(""), F.col("id").cast("string"), F.lit(" ")).alias("name")))


def _rays(spark, sf):  # noqa: ANN001, ANN202
    rays = scan.volume_rays(view(spark, sf, "gates").withColumn("elevation", F.col("sweep") * 1.5 + 0.5))
    return rays.select("radar", "sweep", "ray", "ray_idx", F.size("values").alias("n"), F.size(F.filter("values", lambda v: v.isNotNull())).alias("present"), F.round(F.aggregate(F.filter("values", lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


MINUTES = (1, 2, 3, 4, 5, 6, 7, 10)
_SIDES = "a AS (SELECT sec AS t1 FROM scans WHERE station = 1), b AS (SELECT sec AS t2 FROM scans WHERE station = 2)"
#: The nearest of the sorted other side stands just before or just after.
_NEAR = """p AS (SELECT t1, t2 FROM a ASOF JOIN b ON a.t1 >= b.t2), n AS (SELECT t1, t2 FROM a ASOF JOIN b ON a.t1 <= b.t2),
  near AS (SELECT t1, t2, abs(t1 - t2) AS diff FROM (SELECT * FROM p UNION SELECT * FROM n)),
  best AS (SELECT t1, t2, diff FROM (SELECT *, row_number() OVER (PARTITION BY t1 ORDER BY diff, t2) AS r FROM near) WHERE r = 1)"""
_MATCH = f"""+{_SIDES}, {_NEAR},
  claims AS (SELECT *, row_number() OVER (PARTITION BY t2 ORDER BY t1) AS c FROM best WHERE diff <= 120)
  """


def _matches(spark, sf):  # noqa: ANN001, ANN202
    return match.match_times(*_sides(spark, sf), 120)


def _stream_claims(spark, sf):  # noqa: ANN001, ANN202
    """The match of all events as a stream, as far as its watermark settles it."""
    path = f"{sf}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")  # a stream takes a folder or a pattern
    side = lambda n: events.filter(F.col("user_id") % 2 + 1 == n).select(F.col("ts").cast("timestamp").alias("ts"))
    matched = claims(side(1), side(2), 120)
    root = f"{shared_dir(spark)}/claims-{uuid.uuid4().hex}"
    stream = matched.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/rows").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(matched.schema).parquet(f"{root}/rows")


def _as_files(spark, sf):  # noqa: ANN001, ANN202
    """Texts as files of bytes, and of 40 times their length."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return _docs(spark, sf).select(F.col("doc_id").alias("path"), content.alias("content"), (40 * F.octet_length(content)).cast("long").alias("length"))


QUERIES = {
    "file_name_parse": lambda s, d: scan.parse_names(view(s, d, "names")),
    "product_map_join": lambda s, d: scan.parse_names(view(s, d, "names")).join(scan.products(s), "code").select("name", "quantity", "resolution"),
    "discover_files": lambda s, d: scan.discover(view(s, d, "names"), "velocity", "high"),
    "name_timestamps": lambda s, d: scan.stamps(view(s, d, "names")),
    "distinct_timestamps": lambda s, d: scan.parse_names(view(s, d, "names")).select("station", "ts").distinct(),
    "nyquist_lookup": _nyquist,
    "volume_rays": _rays,
    "repeated_sweeps": lambda s, d: scan.repeated_sweeps(_sweeps(s, d)),
    "gate_stats": lambda s, d: scan.gate_stats(view(s, d, "gates")),
    "byte_histogram": lambda s, d: scan.byte_histogram(_docs(s, d)),
    "header_strings": lambda s, d: probes.strings(_as_files(s, d), separator=" ").withColumnRenamed("path", "doc_id"),
    "shape_candidates": lambda s, d: probes.shapes(_as_files(s, d)).withColumnRenamed("path", "doc_id"),
    "content_sha256": lambda s, d: scan.provenance(_docs(s, d)),
    "station_resolve": _resolve,
    "dem_tiles": _domains,
    "label_names": _labels,
    "time_match_greedy": _matches,
    "time_match_stream": _stream_claims,
    "best_pair": lambda s, d: match.best_pair(_matches(s, d)),
    "nearest_within_tol": lambda s, d: match.nearest_within(*_sides(s, d), 600),
    "tolerance_sweep": lambda s, d: match.tolerance_sweep(*_sides(s, d), MINUTES),
    "scan_intervals": lambda s, d: match.intervals(view(s, d, "scans")),
    "volume_pairs": lambda s, d: match.volume_pairs(view(s, d, "scans")),
    "vwp_station_choice": lambda s, d: match.choose_profile(view(s, d, "profile").select((F.col("level") % 4).alias("station"), (F.col("speed") > 9.5).alias("valid"))),
}
_PARSE = "x AS (SELECT name, string_split(name, '_') AS p FROM names), y AS (SELECT name, CASE WHEN len(p) >= 4 THEN p[1] END AS station, CASE WHEN len(p) >= 4 THEN p[2] END AS ts, CASE WHEN len(p) >= 4 THEN p[3] END AS product, CASE WHEN len(p) >= 4 THEN p[4] END AS layer, p[5] AS code FROM x)"
_MAP = f"m(code, quantity, resolution) AS (VALUES {_PRODUCTS})"
ORACLES = {
    "file_name_parse": oracle("names", f"+{_PARSE} SELECT name, station, ts, product, layer, code FROM y"),
    "product_map_join": oracle("names", f"+{_PARSE}, {_MAP} SELECT name, quantity, resolution FROM y JOIN m USING (code)"),
    "discover_files": oracle("names", f"+{_PARSE}, {_MAP} SELECT station, ts, layer, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(*) AS files FROM y JOIN m USING (code) WHERE product <> 'ProductIndex' AND quantity = 'velocity' AND resolution = 'high' GROUP BY station, ts, layer"),
    "name_timestamps": oracle("names", "+x AS (SELECT name, list_filter(string_split(name, '_'), lambda p: length(p) = 15 AND p LIKE '%Z') AS f FROM names) SELECT name, f[1] AS ts1, coalesce(f[2], f[1]) AS ts2 FROM x"),
    "distinct_timestamps": oracle("names", f"+{_PARSE} SELECT DISTINCT station, ts FROM y"),
    "nyquist_lookup": oracle("features profile", """+w AS (SELECT id, (id % 200) * 0.1::DOUBLE AS e FROM features), c AS (SELECT level * 0.35::DOUBLE AS elev, speed FROM profile),
      d AS (SELECT id, speed, round(abs(e - elev), 6) AS d FROM w, c), l AS (SELECT id, min(d) AS m FROM d GROUP BY id)
      SELECT id, round(coalesce(max(speed) FILTER (WHERE m <= 0.25 AND d <= round(m + 0.02::DOUBLE, 6) AND speed > 0), 30), 6) AS nyquist FROM d JOIN l USING (id) GROUP BY id"""),
    "volume_rays": oracle("gates", """+f AS (SELECT radar, arg_min(n, sweep) AS n FROM (SELECT radar, sweep, max(gate) + 1 AS n FROM gates GROUP BY ALL) GROUP BY radar),
      r AS (SELECT radar, sweep, ray, n, count(vr) FILTER (WHERE gate < n) AS present, round(coalesce(sum(vr) FILTER (WHERE gate < n), 0), 6) + 0e0 AS total FROM gates JOIN f USING (radar) GROUP BY ALL)
      SELECT radar, sweep, ray, (row_number() OVER (PARTITION BY radar ORDER BY sweep, ray) - 1)::INT AS ray_idx, n, present, total FROM r"""),
    "repeated_sweeps": oracle("gates", """+s AS (SELECT DISTINCT radar AS station, sweep, round_even(ray % 9 * 0.505::DOUBLE, 3) AS elevation FROM gates),
      c AS (SELECT station, round_even(elevation, 2) AS e, count(*) AS same FROM s GROUP BY ALL) SELECT s.station, sweep, elevation, same, same > 1 AS repeated FROM s JOIN c ON s.station = c.station AND round_even(s.elevation, 2) = c.e"""),
    "gate_stats": oracle("gates", "SELECT radar, count(*) AS total, count(vr) AS present, count(*) FILTER (WHERE abs(vr) <= 20) AS passed, count(*) FILTER (WHERE abs(vr) > 20) AS masked FROM gates GROUP BY radar"),
    "byte_histogram": "SELECT byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents) GROUP BY byte ORDER BY n DESC, byte LIMIT 8",
    "header_strings": """WITH h AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..')[1:512] AS h FROM documents),
      c AS (SELECT doc_id, string_split(array_to_string(list_transform(h, lambda b: chr(('0x' || b)::INT)), ''), ' ') AS p FROM h),
      t AS (SELECT doc_id, seq::INT AS seq, regexp_replace(p[seq + 1], '^[\\x09-\\x0d\\x20]+|[\\x09-\\x0d\\x20]+$', '', 'g') AS text FROM c, unnest(range(len(p))) u(seq))
      SELECT doc_id, seq, regexp_replace(text, '[^\\x00-\\x7f]', '�', 'g') AS text FROM t WHERE length(text) >= 3 AND regexp_matches(text, '[A-Za-z0-9]')""",
    "shape_candidates": """SELECT doc_id, azimuths, gates, header, item_bytes, header + azimuths * gates * item_bytes AS expected FROM (SELECT doc_id, 40 * octet_length(encode(text)) AS n FROM documents),
      (VALUES (360), (720), (1440)) a(azimuths), (VALUES (230), (460), (920), (1000)) g(gates), (VALUES (1024, 1), (2048, 1), (128, 2)) l(header, item_bytes)
      WHERE n > 1024 AND abs(n - (header + azimuths * gates * item_bytes)) < 2000""",
    "content_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "station_resolve": oracle("features", f"+k(station, lat, lon) AS (VALUES {_STATIONS}), s AS (SELECT 'Z9' || (id % 300 + 300) AS station, (id % 50)::DOUBLE AS a, (id % 70 + 70)::DOUBLE AS o FROM features) SELECT station, coalesce(lat, a)::DOUBLE AS lat, coalesce(lon, o)::DOUBLE AS lon, lat IS NOT NULL AS registered FROM s LEFT JOIN k USING (station)"),
    "dem_tiles": oracle("features", """+d AS (SELECT id, fx / 2e4 + 35 AS a, fx / 2e4 + 36.5::DOUBLE AS b, fy / 2e4 + 117 AS c, fy / 2e4 + 118.2::DOUBLE AS e FROM features),
      la AS (SELECT *, unnest(range(floor(a)::BIGINT, ceil(b)::BIGINT)) AS la FROM d), lo AS (SELECT *, unnest(range(floor(c)::BIGINT, ceil(e)::BIGINT)) AS lo FROM la) SELECT DISTINCT id, printf('N%02dE%03d', la, lo) AS tile FROM lo"""),
    "label_names": oracle("features", "SELECT id, trim(string_split('a|b ' || CASE WHEN id % 2 = 0 THEN '| town ' ELSE '' END || id || ' ', '|')[-1]) AS label FROM features"),
    "time_match_greedy": oracle("scans", _MATCH + "SELECT t1, t2, diff FROM claims WHERE c = 1"),
    "time_match_stream": oracle("scans", _MATCH + "SELECT t1, t2, diff FROM claims WHERE c = 1 AND 1000 * (t2 + 241) < (SELECT epoch_ms(max(ts)) FROM events) - 600000"),
    "best_pair": oracle("scans", _MATCH + "SELECT t1, t2, diff FROM claims WHERE c = 1 ORDER BY diff, t1 LIMIT 1"),
    "nearest_within_tol": oracle("scans", f"+{_SIDES}, {_NEAR} SELECT a.t1, best.t2, best.diff FROM a LEFT JOIN best ON a.t1 = best.t1 AND diff <= 600"),
    "tolerance_sweep": oracle("scans", f"+{_SIDES}, {_NEAR}, m(minutes) AS (VALUES {', '.join(f'({x})' for x in MINUTES)}) SELECT minutes, count(DISTINCT t2) AS matches FROM best, m WHERE diff <= 60 * minutes GROUP BY minutes"),
    "scan_intervals": oracle("scans", "+g AS (SELECT station, sec - lag(sec) OVER (PARTITION BY station ORDER BY sec) AS gap FROM scans) SELECT station, min(gap) AS shortest, max(gap) AS longest, count(*) AS scans FROM g GROUP BY station"),
    "volume_pairs": oracle("scans", "+g AS (SELECT station, sec, lead(sec) OVER (PARTITION BY station ORDER BY sec) AS next FROM scans) SELECT station, sec, next, next - sec AS seconds, (sec + next) / 2 AS midpoint FROM g WHERE next IS NOT NULL"),
    "vwp_station_choice": oracle("profile", "SELECT level % 4 AS station, count(*) FILTER (WHERE speed > 9.5::DOUBLE) AS levels FROM profile GROUP BY 1 HAVING levels >= 3 ORDER BY levels DESC, station LIMIT 1"),
}
