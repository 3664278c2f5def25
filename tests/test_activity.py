"""Activity from one row per facility: no window, no sort of the panel's rows, the same statuses as month by month."""

import datetime as dt
import random

import pytest

from tessera.operators import activity as ac
from tessera.operators import reporting as rp
from tessera.operators.activity import INACTIVE, REPORTING, SILENT, Roles

ROLES = Roles()
FIRST = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(30)]


def made(spark):
    r = random.Random(5)
    rows, k = [], 0
    for hf in [*"abcdefghij", None]:
        share = r.choice([0.05, 0.2, 0.6, 0.9])
        for m in FIRST:
            for _ in range(r.choice([0, 1, 1, 2])):
                k += 1
                rows.append((k, hf, m.replace(day=r.randint(1, 28)), r.choice("xy"), 1.0 if r.random() < share and hf != "a" else None, 2.0 if r.random() < share / 2 and hf != "a" else None))
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "record_id long, hf string, date date, adm1 string, conf double, test double")


def by_hand(rows, window):
    months = [m for m in FIRST if min(x[2] for x in rows if x[1]).replace(day=1) <= m <= max(x[2] for x in rows if x[1]).replace(day=1)]
    first = {}
    for x in sorted(rows):
        first.setdefault((x[1], x[2].replace(day=1)), x[4] is not None or x[5] is not None)
    out = {}
    for hf in sorted({x[1] for x in rows if x[1]}):
        r = [first.get((hf, m), False) for m in months]
        for i, m in enumerate(months):
            past, next_ = [j for j in range(i + 1) if r[j]], [j for j in range(i, len(r)) if r[j]]
            gap = (next_[0] if next_ else len(r)) - past[-1] - 1 if past else None
            out[hf, m] = INACTIVE if not past else REPORTING if r[i] else INACTIVE if gap >= window else SILENT
    return out


@pytest.mark.parametrize("window", [2, 6])
def test_statuses_and_episodes_month_by_month(spark, window):
    rows, df = made(spark)
    want = by_hand(rows, window)
    assert {(r.hf, r.month): r.method3 for r in ac.classify_activity(df, ROLES, ["conf", "test"], window).collect()} == want
    got = ac.activity_episodes(df, ROLES, ["conf", "test"], window=window).orderBy("hf", "episode").collect()
    assert {(r.hf, m): r.status for r in got for m in FIRST if r.start_month <= m <= r.end_month} == want
    assert sum(r.n_months for r in got) == len(want)
    for a, b in zip(got, got[1:]):
        assert a.hf != b.hf or (a.episode + 1 == b.episode and a.status != b.status and a.end_month < b.start_month)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panels_are_not_sorted(spark):
    _, df = made(spark)
    for got in (f(df, ROLES, ["conf", "test"]) for f in (ac.classify_activity, ac.binary_activity, ac.activity_episodes, ac.active_summary, ac.methods_compared)):
        assert "Window" not in plan(got) and "SortMergeJoin" not in plan(got)


def test_rates_hold_a_facility_once(spark):
    rows, df = made(spark)
    active = {k for k, v in by_hand(rows, 6).items() if v != INACTIVE}
    kept = [x for x in rows if (x[1], x[2].replace(day=1)) in active]
    got = rp.rate_combined(df, ["conf", "test"], "adm1", ROLES)
    each = rp.rate_per_variable(df, ["conf", "test"], "adm1", ROLES)
    assert "Expand" not in plan(got) + plan(each)
    count = lambda y, f: len({x[1] for x in kept if x[3] == y and f(x)})
    assert {(r.adm1, r.rep, r.exp) for r in got.collect()} == {(y, count(y, lambda x: x[4] or x[5]), count(y, lambda x: True)) for y in "xy"}
    assert {(r.adm1, r.variable, r.rep, r.exp) for r in each.collect()} == {(y, v, count(y, lambda x: x[i]), count(y, lambda x: True)) for y in "xy" for i, v in ((4, "conf"), (5, "test"))}
