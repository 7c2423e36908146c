"""Pairs by period against brute force, and those of frequent pairs only against all of them."""

import datetime as dt
import itertools
from collections import Counter, defaultdict

from depotlane.operators import basket

DAYS = {"t1": "2001-06-30", "t2": "2001-05-02", "t3": "2000-09-01", "t4": "1999-02-03", "t5": None}
ROWS = [(t, a, float(k + 1), DAYS[t]) for t, items in {"t1": "abc", "t2": "ab", "t3": "ac", "t4": "bcd", "t5": "ab"}.items() for k, a in enumerate(items)]
ROWS[1] = ("t1", "b", 9.0, "2001-01-15")  # a row of t1 in another quarter


def table(spark):
    rows = [(*r[:3], r[3] and dt.datetime.fromisoformat(r[3])) for r in ROWS]
    return spark.createDataFrame(rows, "transaction_id string, article string, quantity_sum double, last_completion_date timestamp")


def periods(day):
    out = {"full_history"}
    if day:
        d, last = dt.date.fromisoformat(day), dt.date(2001, 6, 30)
        out |= {f"last_{n}_days" for n in (365, 180, 90) if d >= last - dt.timedelta(n)} | {f"year_{d.year}", f"quarter_{d.year}Q{(d.month + 2) // 3}"}
    return out


def test_temporal_pairs_against_brute_force(spark):
    single, total, pairs = Counter(), defaultdict(set), Counter()
    for t, a, _, day in ROWS:
        for p in periods(day):
            single[p, a] += 1
            total[p].add(t)
    for x, y in itertools.combinations(ROWS, 2):
        if x[0] == y[0]:
            for p in periods(x[3]) & periods(y[3]):
                pairs[p, x[1], y[1]] += 1
    wanted = {(p, a, b): (n, n * len(total[p]) / (single[p, a] * single[p, b]), len(total[p])) for (p, a, b), n in pairs.items() if len(total[p]) >= 2}
    made = basket.temporal_pairs(table(spark)).collect()
    assert len(made) == len(wanted)
    for r in made:
        n, lift, transactions = wanted[r.period, r.article_a, r.article_b]
        assert (r.shared_transactions, r.period_transactions) == (n, transactions) and abs(r.lift - lift) < 1e-9


def test_frequent_pairs_are_those_of_all(spark):
    items = table(spark)
    whole = basket.temporal_pairs(items)
    often = {(r.article_a, r.article_b) for r in whole.where("period = 'full_history' and shared_transactions >= 2").collect()}
    columns = sorted(whole.columns)
    rounded = lambda df: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()}
    kept = whole.where("concat(article_a, article_b) in ({})".format(",".join(f"'{a}{b}'" for a, b in often)))
    assert 0 < kept.count() < whole.count()
    assert rounded(basket.temporal_pairs(items, at_least=2)) == rounded(kept)
    found = basket.period_totals(basket.dated(items)).where("paired").count()
    assert found == whole.select("period").distinct().count()
