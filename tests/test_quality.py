"""Column profiles and timestamps against brute force and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from dsforge.operators import quality_profile as Q
from dsforge.operators import timestamps as T


@pytest.mark.parametrize(("text", "order", "zone", "want"), [
    ("08/01/2026", "dmy", None, "2026-01-08"), ("08/01/2026", "mdy", None, "2026-08-01"), ("13.08.22 10:40", "dmy", "Europe/Berlin", "2022-08-13T08:40:00.000000Z"), ("20230127", None, None, "2023-01-27"),
    ("1er mars 2019", None, None, "2019-03-01"), ("31 mars 2024 à 2h40", None, "Europe/Paris", "2024-03-31T01:40:00.000000Z"), ("2019-10-27 02:30:00", None, "Europe/Paris", "2019-10-27T00:30:00.000000Z"),
    ("Tue, 18 Aug 2015 16:38:23 GMT", None, "Asia/Tokyo", "2015-08-18T16:38:23.000000Z"), ("2012-10-24T11:53:04.5-05:00[America/New_York]", None, None, "2012-10-24T16:53:04.500000Z"), ("20170106T021823Z", None, None, "2017-01-06T02:18:23.000000Z"),
    ("1384738338601", None, None, "2013-11-18T01:32:18.601000Z"), ("1419563313394540", None, None, "2014-12-26T03:08:33.394540Z"), ("1571569383.589", None, None, "2019-10-20T11:03:03.589000Z"), ("October 21, 2019 5:02 pm", None, "America/Los_Angeles", "2019-10-22T00:02:00.000000Z"),
    ("2 March 2021, 12:07 AM", None, "UTC", "2021-03-02T00:07:00.000000Z"), ("2014-09-09 15:57:27 CEST", None, None, "2014-09-09T13:57:27.000000Z"), (" 2012-03-02. ", None, None, "2012-03-02"),
    ("2022-02-29", None, None, None), ("32/01/2020", "dmy", None, None), ("0000-00-00 00:00:00", None, None, None), ("2021-13-04T08:00:00Z", None, None, None), ("2020-01-01 25:00", None, None, None), ("yesterday", None, None, None), ("", None, None, None), (None, None, None, None),
])
def test_one_value(spark, text, order, zone, want):
    df = spark.createDataFrame([(1, "s", text, None)], "row_no long, source_site string, date string, last_updated string")
    sites = spark.createDataFrame([("s", zone, order)], "source_site string, tz_name string, date_order string")
    got = [r.utc_value for r in T.normalise(df, sites).collect()]
    assert got == ([] if want is None else [want])


def test_viterbi_in_blocks_equals_one_pass(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["a", "b", None]), f"{rnd.randint(1, 14):02d}/{rnd.randint(1, 14):02d}/20{rnd.randint(10, 12)}" if rnd.random() < 0.8 else "2011-05-05", None) for i in range(400)]
    df = spark.createDataFrame(rows, "row_no long, source_site string, date string, last_updated string")
    sites = spark.createDataFrame([("c", "UTC", "dmy")], "source_site string, tz_name string, date_order string")
    whole = sorted(map(tuple, T.normalise(df, sites).collect()))
    assert whole and sorted(map(tuple, T.normalise(df, sites, block=7).collect())) == whole


def test_viterbi_finds_the_cheapest_sequence():
    """Against all sequences of short records, with all interpretations and with those left that are possible."""
    import itertools

    rnd = random.Random(21)
    for _ in range(150):
        values = [rnd.choice([f"{rnd.randint(1, 14):02d}/{rnd.randint(1, 14):02d}/20{rnd.randint(10, 12)}", "2011-05-05", "2019-10-27 02:30"]) for _ in range(6)]
        order = rnd.choice([None, None, "dmy", "mdy"])
        found = [f for v in values if (f := T.interpretations(v, order, "Europe/Paris"))]
        cands = [[(f, at, cost) for f, cost, at, _ in x] for x in found]
        cost = lambda c: sum(x[2] for x in c) + sum(T._step(p, x) for p, x in zip(c, c[1:]))
        least = min(cost(c) for c in itertools.product(*cands))
        assert abs(cost([c[i] for c, i in zip(cands, T._viterbi(cands, None, None))]) - least) < 1e-9
        left = [[(f, at, cost) for f, cost, at, _ in T.possible(x)] for x in found]
        assert abs(min(cost(c) for c in itertools.product(*left)) - least) < 1e-9


def test_undeclared_sources_recover_their_order(spark):
    """Records of undeclared sources in order of time: neighbours tell days from months far better than a rule for each value."""
    import datetime

    rnd, rows, truth = random.Random(8), [], {}
    for s in range(12):
        day, form = datetime.date(2015, 1, 1), "%d/%m/%Y" if s % 2 else "%m/%d/%Y"
        for k in range(120):
            day += datetime.timedelta(days=rnd.randint(0, 5))
            no = 1000 * s + 7 * k
            rows.append((no, f"s{s}", day.strftime(form), None))
            truth[no] = day.isoformat()
    df = spark.createDataFrame(rows, "row_no long, source_site string, date string, last_updated string")
    none = spark.createDataFrame([], "source_site string, tz_name string, date_order string")
    got = {r.row_no: r.utc_value for r in T.normalise(df, none, block=50).collect()}
    rule = {no: f[0][2] for no, _, t, _ in rows if (f := T.interpretations(t))}
    right = sum(got[n] == truth[n] for n in truth) / len(truth)
    by_rule = sum((datetime.date(1970, 1, 1) + datetime.timedelta(days=rule[n] // T.DAY)).isoformat() == truth[n] for n in truth) / len(truth)
    assert right > 0.97 > 0.9 > by_rule


def test_undeclared_source_follows_its_neighbours(spark):
    rows = [(i, "s", t, None) for i, t in enumerate(["01/25/2020", "01/26/2020", "02/03/2020", "02/28/2020", "03/04/2020"])]
    df = spark.createDataFrame(rows, "row_no long, source_site string, date string, last_updated string")
    none = spark.createDataFrame([], "source_site string, tz_name string, date_order string")
    assert [r.utc_value for r in T.normalise(df, none).orderBy("row_no").collect()] == ["2020-01-25", "2020-01-26", "2020-02-03", "2020-02-28", "2020-03-04"]
    assert T.normalise(df.where("false"), none).count() == 0


COLUMNS, COMPARED = ["code", "ref", "x", "flag"], ["code", "x", "flag"]
SCHEMA = "load_no int, ex_no long, g string, code string, ref string, x double, flag boolean, _value int, _load int"


def loads(faults: dict, n: int = 300, k: int = 8):
    rnd, rows = random.Random(1), []
    for load in range(1, k + 1):
        for i in range(n):
            row = {"code": rnd.choice(["AA", "AA", "BB", "CC"]), "ref": f"R-{load * 1000 + i}", "x": rnd.gauss(50, 10), "flag": rnd.random() < 0.3}
            for c in row:
                if rnd.random() < 0.05:
                    row[c] = None
            row |= faults.get(load, lambda r, i: {})(row, i)
            rows.append((load, load * 100_000 + i, "g", row["code"], row["ref"], row["x"], row["flag"], 1, 1))
    return rows


def faults(df, reports=None, patterns=("code",), bounds=None, group_col=None, **more):
    return {tuple(r) for r in Q.find_faults(df, reports, COLUMNS, COMPARED, list(patterns), ["ref"], bounds, item_col="ex_no", group_col=group_col, **more).collect()}


def test_planted_faults(spark):
    planted = {
        2: lambda r, i: {"x": None} if i % 3 == 0 else {}, 3: lambda r, i: {"code": r["code"] and r["code"].lower()} if i % 4 == 0 else {}, 4: lambda r, i: {"ref": f"R-{9000 + i % 50}"}, 5: lambda r, i: {"x": 500.0} if i == 7 else {},
        6: lambda r, i: {"code": "CC"} if i % 2 else {}, 7: lambda r, i: {"flag": True} if i % 2 else {},
    }
    df = spark.createDataFrame(loads(planted), SCHEMA)
    bounds = spark.createDataFrame([("g", "x", 0.0, 100.0), ("g", "code", None, None)], "g string, name string, min_value double, max_value double")
    present = df.where("load_no = 8").agg(F.count("code")).first()[0]
    reports = spark.createDataFrame([(8, "code", present + 1, (present + 1) / 300), (1, "x", None, None), (8, "flag", None, None)], "load_no int, column_name string, n_non_null long, coverage double")
    got = faults(df, reports, ["code", "ref"], bounds, "g")
    assert got == {(2, "x", "nulls"), (3, "code", "pattern"), (4, "ref", "distinct"), (5, "x", "range"), (6, "code", "distribution"), (7, "flag", "distribution"), (8, "code", "reported")}
    # without the regression nothing tells the loads apart
    assert faults(df, None, ["code", "ref"], bounds, "g", steps=0) == {x for x in got if x[2] not in ("distribution", "reported")}


def test_a_single_odd_value_counts(spark):
    df = spark.createDataFrame(loads({3: lambda r, i: {"code": "A?"} if i == 5 else {}}), SCHEMA)
    assert faults(df) == {(3, "code", "pattern")}


def test_joint_weights_blame_the_column_that_changed(spark):
    """The flag follows the code in every load; only the code's spread changes, so the flag's does too, but it says nothing more once the code is known."""

    def follow(share):
        rnd = random.Random(3)

        def fill(r, i):
            code = "CC" if rnd.random() < share else rnd.choice(["AA", "BB"])
            return {"code": code, "flag": (code == "CC") != (rnd.random() < 0.1)}

        return fill

    df = spark.createDataFrame(loads({k: follow(0.8 if k == 5 else 0.2) for k in range(1, 9)}, n=1200), SCHEMA)
    assert faults(df) == {(5, "code", "distribution")}


def test_change_among_rare_values_is_seen(spark):
    """Values beyond the most frequent ones have bins of their own by hash."""
    rnd = random.Random(4)
    many = [f"V{i:03d}" for i in range(400)]
    df = spark.createDataFrame(loads({k: lambda r, i, k=k: {"code": rnd.choice(many[:12] if k == 6 else many)} for k in range(1, 9)}, n=900), SCHEMA)
    assert faults(df) == {(6, "code", "distribution")}


def test_profile_edges(spark):
    df = spark.createDataFrame(loads({}, n=40, k=2), SCHEMA)
    assert faults(df) == set()  # two loads are too few to compare
    assert faults(df.where("false")) == set()
    gone = spark.createDataFrame(loads({3: lambda r, i: {"code": None, "x": None, "flag": None, "ref": None}}), SCHEMA)
    assert faults(gone) == {(3, c, "nulls") for c in COLUMNS}
    odd = "Ab 9é٣Ǆ\u00a0\t x"
    one = spark.createDataFrame([(odd,)], "v string").select(Q.form(F.col("v")).alias("f")).first().f
    assert one == Q.form_of(odd)
