"""Secrets: patterns against plain ones, what a ledger scans again, and SQL."""

import os
import random
import re

import duckdb
import pytest

from depotlane.llm import ledger

PLAIN = {
    "assign": (r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def plain(text):
    found = []
    for i, (pattern, group, least) in enumerate(PLAIN.values()):
        found += [(m.start(), i, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(found)


def made(rng):
    parts = ["token", "SECRET", "Api_Key", "apikey", "ſecret", "toKen", "password", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", "é🙂", "\n", "x", "abc.def", "==", "secret=token: abcdefgh"]
    return "".join(rng.choices(parts, k=rng.randint(0, 25)))


def test_equals_plain_patterns(spark):
    rng = random.Random(2)
    rows = [(i, made(rng)) for i in range(1000)] + [(None, None), (1, ""), (1, "token = abcdef")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, blob string")
    got = sorted((str(r.doc_id), [tuple(s) for s in r.found]) for r in ledger.report(df, ledger.scan(df, rules=ledger.BASE), ledger.BASE).collect())
    assert got == sorted((str(k), plain(t)) for k, t in rows)
    assert sum(len(f) for _, f in got) > 200


def test_only_missing_pairs_are_scanned(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "token=abcdef1"), ("b", 1, "token=abcdef1"), ("a", 2, "nothing"), ("c", 1, None)], "path string, version int, text string")
    folder = str(tmp_path / "ledger")
    first = ledger.extend(spark, old, folder, ledger.BASE[:1])
    assert first.count() == 3 and ledger.missing(old, first, ledger.BASE[:1]).count() == 0
    new = old.unionByName(spark.createDataFrame([("d", 3, "AKIA" + "Z" * 16), ("e", 1, "nothing")], old.schema))
    left = {r.text: len(r.rules) for r in ledger.missing(new, first, ledger.BASE).collect()}
    assert left == {"token=abcdef1": 2, "nothing": 2, "": 2, "AKIA" + "Z" * 16: 3}
    both = ledger.extend(spark, new, folder, ledger.BASE)
    assert both.count() == 7 and ledger.missing(new, both, ledger.BASE).count() == 0
    again = ledger.extend(spark, new, folder, ledger.BASE)
    assert again.count() == 7
    found = {(r.path, tuple(map(tuple, r.found))) for r in ledger.report(new, both, ledger.BASE, key="path").collect()}
    assert found == {("a", ((0, 0, 13),)), ("b", ((0, 0, 13),)), ("a", ()), ("c", ()), ("d", ((0, 1, 20),)), ("e", ())}
    changed = ledger.Rule("assign", "token", 0)
    assert ledger.missing(new, both, (changed,)).count() == 4  # a rule of another version is unseen
    twice = both.unionByName(both)  # rows written twice after a loss
    assert ledger.report(new, twice, ledger.BASE, key="path").where("size(found) > 1").count() == 0


def test_further_rules_and_cases(spark):
    texts = ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "A1" * 18, "x" * 200_000 + " secret: '123456'", "-----BEGIN CERTIFICATE-----"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [ledger.RULES[s.kind].kind for s in r.found] for r in ledger.report(df, ledger.scan(df)).collect()}
    assert got == {0: ["keyblock"], 1: ["prefixed"], 2: ["assign"], 3: []}
    empty = ledger.scan(df.limit(0))
    assert empty.count() == 0 and ledger.report(df.limit(0), empty).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_sql(spark):
    got = ledger.op11_ledger(spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(ledger.oracle())
    assert sorted(got.select(*want.columns).toPandas().itertuples(index=False, name=None)) == sorted(want.fetchall())
