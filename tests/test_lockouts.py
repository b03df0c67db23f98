"""ST1 lockout fold: edge cases by hand, random histories against a plain fold."""

import datetime as dt
import random

from tillpoint.streaming.lockouts import ACCOUNT, ADDRESS, detect_lockouts, fold_rows

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)


def attempts(spark, rows):
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz, success boolean")


def at(minutes, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def locks(spark, rows, preset=ACCOUNT):
    out = detect_lockouts(attempts(spark, rows), preset).collect()
    return sorted((r["key"], r["locked_at"], r["locked_until"], r["failures"]) for r in out)


def test_fifth_failure_exactly_at_window_end_locks(spark):
    rows = [("a", at(m), False) for m in (0, 1, 2, 3, 15)]
    assert locks(spark, rows) == [("a", at(15), at(30), 5)]


def test_failure_after_window_starts_over(spark):
    rows = [("a", at(m), False) for m in (0, 1, 2, 3)] + [("a", at(15, 1), False)]
    assert locks(spark, rows) == []


def test_failures_during_lock_are_not_counted_and_lock_end_clears(spark):
    rows = [("a", at(m), False) for m in range(5)]          # lock at 4 until 19
    rows += [("a", at(m), False) for m in (5, 10, 18)]      # refused
    rows += [("a", at(m), False) for m in (19, 20, 21, 22)]  # fresh start at 19: 4 failures
    assert locks(spark, rows) == [("a", at(4), at(19), 5)]
    rows.append(("a", at(23), False))
    assert locks(spark, rows) == [("a", at(4), at(19), 5), ("a", at(23), at(38), 5)]


def test_success_clears(spark):
    rows = [("a", at(m), False) for m in (0, 1, 2, 3)] + [("a", at(4), True)] + [("a", at(5), False)]
    assert locks(spark, rows) == []


def test_random_histories_match_plain_fold(spark):
    rnd = random.Random(3)
    rows = []
    for key in ["hot"] * 6 + [f"k{i}" for i in range(20)]:
        t = T0 + dt.timedelta(minutes=rnd.randint(0, 600))
        for _ in range(rnd.randint(5, 60)):
            t += dt.timedelta(seconds=rnd.choice([5, 10, 20, 30, 60, 90, 240, 600, 900, 901, 2000]))
            rows.append((key, t, rnd.random() < 0.1))
    for preset in (ACCOUNT, ADDRESS):
        want = []
        for key in sorted({r[0] for r in rows}):
            mine = sorted((int(r[1].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6), r[2]) for r in rows if r[0] == key)
            _, events = fold_rows((None, 0, None), mine, preset)
            for a, b, n in events:
                conv = lambda us: dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
                want.append((key, conv(a), conv(b), n))
        assert locks(spark, rows, preset) == sorted(want)
        assert want, f"fixture should produce some locks for {preset}"


def test_a_burst_on_one_key_is_spread_and_exact(spark):
    """A third of all attempts on one key in one hour: the same locks as a plain
    fold, and the windows that find the gaps are split by minute."""
    rnd = random.Random(5)
    rows = [("hot", T0 + dt.timedelta(seconds=i), rnd.random() < 0.05) for i in range(0, 3600, 2)]
    rows += [(f"k{i % 40}", T0 + dt.timedelta(seconds=rnd.randrange(90000)), rnd.random() < 0.1) for i in range(3600)]
    want = []
    for key in {r[0] for r in rows}:
        mine = sorted((int(r[1].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6), r[2]) for r in rows if r[0] == key)
        want += [(key, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=a), n) for a, _, n in fold_rows((None, 0, None), mine, ACCOUNT)[1]]
    got = [(r["key"], r["locked_at"], r["failures"]) for r in detect_lockouts(attempts(spark, rows), ACCOUNT).collect()]
    assert sorted(got) == sorted(want) and any(k == "hot" for k, _, _ in got)
