"""A team that plays a third of all matches is spread over bounded window partitions."""

import datetime as dt

from pyspark.sql import functions as F

from touchline.operators import history as H

SCHEMA = ("match_id BIGINT, date_gmt TIMESTAMP_NTZ, home_team_name STRING, away_team_name STRING, "
          "home_team_corner_count DOUBLE, away_team_corner_count DOUBLE, "
          "home_team_goal_count DOUBLE, away_team_goal_count DOUBLE")


def test_hot_team_is_chunked_and_exact(spark):
    rows = []
    for i in range(600):
        d = dt.datetime(2020, 1, 1) + dt.timedelta(days=i // 3)
        home = "HOT" if i % 3 == 0 else f"T{i % 17}"
        away = f"T{(i * 7) % 19}x"
        rows.append((i, d, home, away, float(i % 11), float(i % 7), float(i % 4), float(i % 3)))
    df = spark.createDataFrame(rows, SCHEMA)
    chunk = 50
    long = H.with_halo_chunks(H.sequence_position(H.team_long(df), ["team"]), "prior", chunk)
    sizes = long.groupBy("team", "__chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= chunk + H.HALO
    assert long.where(F.col("team") == "HOT").select("__chunk").distinct().count() >= 200 // chunk
    a = H.team_history(df, chunk_rows=chunk)
    b = H.team_history(df)
    diff = a.alias("a").join(b.alias("b"), ["match_id", "side"]).where(
        F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in H.SIDE_FEATURES]) > 1e-9)
    assert a.count() == 1200 and diff.count() == 0
