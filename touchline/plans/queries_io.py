"""Registered queries for season-file scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.plans import pipeline as P
from touchline.plans import sqlbase as SB
from touchline.plans.registry import NOT_ROUNDED, register, sql_select
from touchline.sources import files as FS
from touchline.sources.testdata import round_doubles

NOT_ROUNDED.update({"n_files", "n_rows", "n_columns", "n_missing", "column_name"})

SCAN_COLS = ["match_id", "season", "date_raw", "home_team_name", "home_team_corner_count", "odds_home_raw",
             "odds_over25", "odds_btts_yes"]


def _files(spark, sf):
    raw = P.raw(spark, sf)
    types = {f.name: f.dataType.simpleString() for f in raw.schema.fields}
    root = FS.scratch(spark, "season_files")
    return FS.write_season_files(raw, root), types


def _scan(spark, sf):
    root, types = _files(spark, sf)
    return FS.scan_season_files(spark, root, types)


def _register():
    fx = SB.fixture_ctes()
    odd = {c: f"CASE WHEN season % 2 = 1 THEN {c} END" for c in FS.ODD_SEASON_ONLY}
    odd["odds_home_raw"] = "odds_home"
    register("scan_season_files",
             lambda s, d: round_doubles(_scan(s, d).withColumnRenamed("odds_home", "odds_home_raw").select(*SCAN_COLS)),
             f"WITH {fx}\nSELECT {sql_select(SCAN_COLS, odd)} FROM raw")
    register("load_matches",
             lambda s, d: round_doubles(FS.sink_combined(_scan(s, d), FS.scratch(s, "combined"))
                                        .withColumnRenamed("odds_home", "odds_home_raw").select(*SCAN_COLS)),
             f"WITH {fx}\nSELECT {sql_select(SCAN_COLS, odd)} FROM raw")

    def audit(s, d):
        return FS.schema_audit(FS.file_headers(s, _files(s, d)[0]))

    from touchline.sources.testdata import MATCH_COLUMNS
    parts = []
    for name, _ in MATCH_COLUMNS:
        cond = " WHERE season % 2 = 1" if name in FS.ODD_SEASON_ONLY else ""
        parts.append(f"SELECT '{name}' AS column_name, count(DISTINCT season) AS n_files FROM raw{cond}")
    register("schema_audit", audit, f"WITH {fx}\n" + " UNION ALL ".join(parts))

    def union(s, d):
        return _scan(s, d).groupBy("season").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("odds_over25").isNull().cast("int")).cast("bigint")
            .alias("n_missing"))

    register("union_by_name", union, f"WITH {fx}\nSELECT season, count(*) AS n, "
             "CAST(sum(CASE WHEN season % 2 = 1 THEN 0 ELSE 1 END) AS BIGINT) AS n_missing FROM raw GROUP BY season")

    def sink(s, d):
        out = FS.sink_combined(_scan(s, d), FS.scratch(s, "combined"))
        return out.groupBy("season").agg(F.count(F.lit(1)).alias("n"))

    register("sink_combined", sink, f"WITH {fx}\nSELECT season, count(*) AS n FROM raw GROUP BY season")

    def shape(s, d):
        root, types = _files(s, d)
        return FS.shape_summary(FS.scan_season_files(s, root, types), FS.file_headers(s, root))

    register("shape_summary", shape, f"WITH {fx}\nSELECT count(*) AS n_rows, {len(MATCH_COLUMNS)} AS n_columns, "
             "count(DISTINCT season) AS n_files FROM raw")


_register()
