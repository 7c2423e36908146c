"""Replays, transformers known at origins, and open requests, against plain code over small tables."""

import random
from datetime import date, timedelta

from depotlane.operators import enrich, histories, nowcast, replay

START = date(2024, 1, 1)


def day(k):
    return START + timedelta(days=k)


def test_known_at_equals_filtering(spark):
    rng = random.Random(3)
    rows = [(rng.choice("AB"), rng.choice(["SI", "NO"]), str(rng.randrange(30)), rng.randrange(3), float(rng.randrange(1, 9)), day(rng.randrange(60)), day(rng.randrange(60))) for _ in range(200)]
    services = [(rng.choice("AB"), rng.choice(["SI", "NO"]), day(rng.randrange(60))) for _ in range(100)]
    columns = "service_type string, urgency string, code string, offset int, quantity double, pick_date date, date date"
    matched, served = spark.createDataFrame(rows, columns), spark.createDataFrame(services, "service_type string, urgency string, date date")
    origins = [day(0), day(17), day(40), day(59)]
    model = nowcast.fit_transformer_at(matched, served, spark.createDataFrame([(o,) for o in origins], "origin date"))
    for o in origins:
        known = [r for r in rows if max(r[5], r[6]) <= o]
        early = [s for s in services if s[2] <= o]
        plain = nowcast.fit_transformer(spark.createDataFrame(known, columns), spark.createDataFrame(early, "service_type string, urgency string, date date"))
        for name, table in plain.items():
            got = model[name].where(f"origin = date'{o}'").select(*table.columns).collect()
            assert sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got)) == sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in table.collect()), (o, name)


def test_transformer_by_origin(spark):
    model = {
        "intensity": spark.createDataFrame([(day(0), "A", "SI", 2.0, 5.0), (day(0), "A", "NO", 1.0, 1.0)], "origin date, service_type string, urgency string, lines_per_service double, units_per_service double"),
        "offsets": spark.createDataFrame([(day(0), "A", "SI", 1, 1.0)], "origin date, service_type string, urgency string, offset int, share double"),
        "urgency": spark.createDataFrame([(day(0), "A", "SI", 0.25), (day(0), "A", "NO", 0.75)], "origin date, service_type string, urgency string, mix double"),
        "overall": spark.createDataFrame([(day(0), 0, 0.5), (day(0), 2, 0.5)], "origin date, offset int, share double"),
    }
    services = spark.createDataFrame([(day(0), day(5), "A", 8.0), (day(1), day(5), "A", 8.0)], "origin date, date date, service_type string, forecast double")
    got = {(r.origin, r.pick_date): (r.lines, r.units) for r in nowcast.apply_transformer(services, model, ["origin"]).collect()}
    assert got == {(day(0), day(4)): (4.0, 10.0), (day(0), day(5)): (3.0, 3.0), (day(0), day(3)): (3.0, 3.0)}  # nothing is known at the later origin
    direct = spark.createDataFrame([(day(0), "lines", day(5), 2.0, 9.0), (day(0), "lines", day(6), 2.0, 9.0)], "origin date, kpi string, date date, y_true double, y_pred double")
    both = nowcast.direct_and_transformed(direct, nowcast.apply_transformer(services, model, ["origin"]))
    assert sorted((r.source, str(r.date)[-2:], r.y_pred) for r in both.collect()) == [("direct", "06", 9.0), ("direct", "07", 9.0), ("transformer", "06", 3.0), ("transformer", "07", 0.0)]


def test_replay_knows_nothing_later(spark):
    values = {k: float((k * 7) % 11) for k in range(60)}
    frame = lambda upto: spark.createDataFrame([(kpi, day(k), v) for kpi in ("sge", "lines") for k, v in values.items() if k <= upto], "kpi string, date date, target double")
    requests = spark.createDataFrame([(day(c), day(c + w), "SGE") for c in range(0, 60, 2) for w in (1, 4)], "created date, due date, service_type string")
    scaler = spark.createDataFrame([("SGE", 2.0)], "service_type string, scaler double")
    curves = spark.createDataFrame([("SGE", h, 0.5) for h in range(5)], "service_type string, horizon int, visible double")
    settings = {"before": replay.Settings(), "after": replay.Settings(nowcast.WEIGHTS, policies={"sge": {"round": True}, "lines": {"add_bias": 1.0}})}

    def run(upto, low, high):
        folded = histories.run_dates(histories.dense(frame(upto), key="kpi"), str(day(low)), str(day(high)))
        origins = spark.createDataFrame([(day(k),) for k in range(low, high + 1)], "origin date")
        signal = nowcast.signals(enrich.open_at(requests, origins, "created", "due", ["service_type"]), scaler, curves)
        return replay.replay(replay.base(folded, {"sge": "SGE"}, 10), signal, settings)

    rows = run(59, 30, 45)
    alone = {(r.variant, r.kpi, r.target_date): r.forecast_value for r in run(33, 33, 33).collect()}
    many = {(r.variant, r.kpi, r.target_date): r.forecast_value for r in rows.where(f"run_date = date'{day(33)}'").collect()}
    assert many == alone and len(alone) == 40
    one = {(r.variant, r.horizon): r for r in rows.where(f"run_date = date'{day(34)}' and kpi = 'sge'").collect()}
    base = values[28]  # a week before the day after the run
    assert one["before", 1].base == base and one["before", 1].signal == 1 / 0.5 * 2.0  # one request due, half of them visible, twice as many come
    assert one["before", 1].forecast_value == 0.35 * base + 0.65 * 4.0 and one["after", 1].forecast_value == 4.0
    assert one["after", 5].signal is None and one["after", 10].statistical == 1.0
    plain = rows.where("kpi = 'lines'").collect()
    assert all(r.statistical is None and r.forecast_value == r.base + (r.variant == "after") for r in plain)
    report = {(r.kpi, r.bucket): r for r in replay.report(rows, ["kpi", "bucket"]).collect()}
    assert set(report) == {(k, b) for k in ("sge", "lines") for b in ("D+1", "D+2_D+3", "D+4_D+7", "D+8_D+14")}
    assert all(r.n_before == r.n_after and r.impact in ("helpful", "harmful", "neutral") for r in report.values())
    assert abs(report["lines", "D+1"].delta_bias - 1.0) < 1e-9
    weeks = replay.weekly(rows, frame(59).withColumnRenamed("target", "actual_value"))
    got = weeks.where(f"variant = 'before' and kpi = 'lines' and run_date = date'{day(34)}'").collect()
    assert {str(r.week) for r in got} == {"2024-02-05", "2024-02-12"}
    assert all(r.actual_value == sum(v for k, v in values.items() if 0 <= (day(k) - r.week).days < 7) for r in got)


def test_open_at_adds_up_requests_of_the_same_days(spark):
    rng = random.Random(9)
    rows = [(day(rng.randrange(20)), day(rng.randrange(5, 40)), rng.choice("AB"), rng.randrange(5)) for _ in range(300)]
    origins = [day(3), day(4), day(11), day(33)]
    got = enrich.open_at(spark.createDataFrame(rows, "c date, d date, k string, lines int"), spark.createDataFrame([(o,) for o in origins], "origin date"), "c", "d", ["k"], ["lines"]).collect()
    want = {}
    for c, d, k, n in rows:
        for o in origins:
            if c <= o <= d:
                was = want.get((o, d, k), (0, 0))
                want[o, d, k] = (was[0] + 1, was[1] + n)
    assert {(r.origin, r.target_date, r.k): (r.open_requests, r.open_lines) for r in got} == want
