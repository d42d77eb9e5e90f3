"""History windows vs a plain row loop written from the sequential semantics."""

import math
from datetime import datetime

from pyspark.sql import functions as F

from touchline.operators import history as H
from touchline.operators.features import SEASONAL_FACTORS
from touchline.plans import pipeline as P

TOL = 1e-9


def _mean(xs):
    return sum(xs) / len(xs)


def _mean_nan(xs):
    return float("nan") if any(x is None for x in xs) else _mean(xs)


def _pvar(xs):
    m = _mean(xs)
    return sum((x - m) ** 2 for x in xs) / len(xs)


def _minus_years(d: datetime, years: int) -> datetime:
    try:
        return d.replace(year=d.year - years)
    except ValueError:  # 29 February
        return d.replace(year=d.year - years, day=28)


def loop_v3(rows):
    teams, h2h, out = {}, {}, {}
    for r in rows:
        h, a = r["home_team_name"], r["away_team_name"]
        hs = teams.setdefault(h, {"cf": [], "ca": [], "gf": [], "ga": []})
        as_ = teams.setdefault(a, {"cf": [], "ca": [], "gf": [], "ga": []})

        def last(st, key, n):
            return _mean(st[key][-n:]) if len(st[key]) >= n else 0.0

        hf, ha, af, aa = last(hs, "cf", 6), last(hs, "ca", 6), last(as_, "cf", 6), last(as_, "ca", 6)
        hv = _pvar(hs["cf"][-5:]) if len(hs["cf"]) >= 5 else 0.0
        av = _pvar(as_["cf"][-5:]) if len(as_["cf"]) >= 5 else 0.0
        vol = (hv + av) / 2
        clash = abs((hf - ha) - (af - aa))
        seasonal = SEASONAL_FACTORS.get(r["date_gmt"].month, 1.0)
        etc = ((hf + aa + af + ha) / 2) * (1 + (vol - 2) * 0.1) * (1 + clash * 0.05) * seasonal
        same, rev = h2h.get((h, a)), h2h.get((a, h))
        data = same if same is not None else (rev or [])
        hist = _mean(data[-3:]) if data else 0.0
        fam = float(len(same or []) + len(rev or []))

        def gd(st):
            if len(st["gf"]) < 5:
                return 0.0
            return _mean_nan(st["gf"][-5:]) - _mean_nan(st["ga"][-5:])

        d = (2 - gd(hs)) + (2 - gd(as_))
        desp = (0.0 if math.isnan(d) else max(0.0, d)) / 4
        out[r["match_id"]] = {"expected_total_corners": etc, "h2h_corner_history": hist,
                              "teams_familiarity": fam, "attacking_desperation_factor": desp}
        hc, ac, hg, ag = (r["home_team_corner_count"], r["away_team_corner_count"],
                          r["home_team_goal_count"], r["away_team_goal_count"])
        hs["cf"].append(hc); hs["ca"].append(ac); hs["gf"].append(hg); hs["ga"].append(ag)
        as_["cf"].append(ac); as_["ca"].append(hc); as_["gf"].append(ag); as_["ga"].append(hg)
        h2h.setdefault((h, a), []).append(hc + ac)
    return out


def loop_tv_h2h(rows):
    lists, out = {}, {}
    for r in rows:
        h, a = r["home_team_name"], r["away_team_name"]
        data = lists.get((h, a), []) + lists.get((a, h), [])
        out[r["match_id"]] = ((_mean([t for _, t in data[-3:]]) if data else 0.0), float(len(data)))
        lst = lists.setdefault((h, a), [])
        lst.append((r["date_gmt"], r["home_team_corner_count"] + r["away_team_corner_count"]))
        cutoff = _minus_years(r["date_gmt"], 5)
        lists[(h, a)] = [(d, t) for d, t in lst if d >= cutoff]
    return out


def _rows(df):
    cols = ["match_id", "date_gmt", "home_team_name", "away_team_name", "home_team_corner_count",
            "away_team_corner_count", "home_team_goal_count", "away_team_goal_count"]
    return [r.asDict() for r in df.select(cols).orderBy("date_gmt", "match_id").collect()]


def test_v3_history_matches_row_loop(spark, sf):
    f = P.features_v3(spark, sf)
    expect = loop_v3(_rows(f))
    got = H.history_features_v3(f, chunk_rows=13).select(
        "match_id", "expected_total_corners", "h2h_corner_history", "teams_familiarity",
        "attacking_desperation_factor").collect()
    assert len(got) == len(expect)
    for r in got:
        e = expect[r["match_id"]]
        for k, v in e.items():
            assert abs(r[k] - v) < TOL, (r["match_id"], k, r[k], v)


def test_tv_pruned_h2h_matches_row_loop(spark, sf):
    f = P.features_tv(spark, sf)
    expect = loop_tv_h2h(_rows(f))
    got = H.pair_history(f).collect()
    for r in got:
        avg, n = expect[r["match_id"]]
        assert abs(r["h2h_avg_corners"] - avg) < TOL and r["h2h_matches_count"] == n, r


def test_chunked_windows_equal_single_chunk(spark, sf):
    """Splitting a team's history into chunks (with halo rows) changes nothing."""
    f = P.features_v3(spark, sf)
    a = H.team_history(f, chunk_rows=11).drop("opponent")
    b = H.team_history(f).drop("opponent")
    key = ["match_id", "side"]
    diff = a.join(b, key, "full_outer").where(
        F.greatest(*[F.abs(a[c] - b[c]) for c in H.SIDE_FEATURES]) > TOL)
    assert a.count() == b.count() == 2 * f.count()
    assert diff.count() == 0


def test_no_look_ahead(spark, sf):
    """Changing a match's result changes no feature of it or of earlier matches."""
    f = P.features_v3(spark, sf)
    ordered = f.orderBy("date_gmt", "match_id").select("match_id", "date_gmt").collect()
    pivot = ordered[len(ordered) // 2]
    changed = f.withColumn("home_team_corner_count",
                           F.when(F.col("match_id") == pivot["match_id"], F.lit(25.0))
                           .otherwise(F.col("home_team_corner_count")))
    cols = ["expected_total_corners", "h2h_corner_history", "home_corners_avg_3", "away_corners_avg_10"]
    base = H.history_features_v3(f).select("match_id", "date_gmt", *cols)
    alt = H.history_features_v3(changed).select("match_id", *[F.col(c).alias("alt_" + c) for c in cols])
    j = base.join(alt, "match_id").where(
        (F.col("date_gmt") < pivot["date_gmt"]) |
        ((F.col("date_gmt") == pivot["date_gmt"]) & (F.col("match_id") <= pivot["match_id"])))
    bad = j.where(F.greatest(*[F.abs(F.col(c) - F.col("alt_" + c)) for c in cols]) > TOL)
    assert j.count() > 0 and bad.count() == 0
