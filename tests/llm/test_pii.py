"""Personal data: base spans against plain Python, and odd rows."""

import random
import re

from depotlane.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PLAIN[kind], t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(8)
    parts = ["a.b@c.de", "é🙂 ", "x_y@z.q_w@e.r", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.003.255", "+1 (614) 555-8001", "+12", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "5500000000000004", "call 614 555 8001", "joe [at] mail [dot] com", "@", ".", "-", "+", " ", "\n", "9", "12", "a@b", "a@b.", "%", "1 2", "(", "token = \"abe29c\""]
    return ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(600)] + [None, "", "7" * 30000, "a" * 30000, "1 " * 20000, "1." * 20000, "4111111111111111" * 2]


def test_base(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(k, t, 1) for k, t in rows] + [(None, "a@b.c", 2)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    for k, t in rows:
        assert [tuple(s) for s in got[k].base] == brute(t), t
        assert set(map(tuple, got[k].base)) <= set(map(tuple, got[k].spans))
    assert len(got[None].base) == 1
    assert pii.spans(df.limit(0)).count() == 0


def labelled(n=1200):
    """Texts with one thing each, its place and whether it should be found by the trees."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abdeilmnorstu", k=rng.randint(3, 9)))
    number = lambda k: "".join(rng.choices("0123456789", k=k))
    mail = lambda: (f"{word()}.{number(2)}", f"{word()}.com")

    def card():
        d = "4" + number(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    makers = {
        "base email": lambda: "@".join(mail()), "base ip": lambda: ".".join(str(rng.randint(10, 255)) for _ in range(4)), "base card": card,
        "base phone": lambda: f"+1 ({number(3)}) 555-{number(4)}", "decoy number": lambda: "7" + number(15), "decoy word": lambda: "".join(word() for _ in range(7)),
        "secret": lambda: f'token = "{rng.getrandbits(160):040x}"', "spelled email": lambda: " [at] ".join(mail()), "national phone": lambda: f"({number(3)}) 555-{number(4)}",
    }
    weights = [6, 6, 6, 6, 6, 6, 6, 1, 1]
    for i in range(n):
        kind = rng.choices(list(makers), weights)[0]
        shown = makers[kind]()
        before = " ".join(word() for _ in range(6)) + " "
        yield i, kind, before + shown + " " + word(), len(before), len(before) + len(shown)


def test_trees_add_and_refuse(spark):
    rows = list(labelled())
    got = {r.doc_id: r for r in pii.spans(spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, text string")).collect()}
    added = {kind: [] for kind in {r[1] for r in rows}}
    for i, kind, text, a, b in rows:
        more = [s for s in got[i].spans if s not in got[i].base]
        added[kind].append(any(s.a < b and a < s.b for s in more))
        ends = [(s.a, s.b) for s in got[i].spans]
        assert all(x[1] <= y[0] for x, y in zip(sorted(map(tuple, ends)), sorted(map(tuple, ends))[1:])), text
    share = {kind: sum(v) / len(v) for kind, v in added.items()}
    for kind in ("secret", "spelled email", "national phone"):
        assert share[kind] >= 0.9, share
    for kind in ("base email", "base ip", "base card", "base phone", "decoy number", "decoy word"):
        assert share[kind] <= 0.02, share


def test_overlaps_leave_the_higher_score(spark):
    from pyspark.sql import functions as F
    spans = [(0, 2, 5, 0.9), (3, 4, 9, 0.95), (8, 3, 12, 0.7), (20, 0, 25, 0.8), (20, 1, 22, 0.8), (25, 1, 27, 0.8)]
    df = spark.createDataFrame([(spans,), ([],)], "s array<struct<a:int,kind:int,b:int,p:double>>")
    got = [[tuple(x)[:3] for x in r.k] for r in df.select(pii._best("s").alias("k")).collect()]
    assert got == [[(3, 4, 9), (20, 0, 25), (25, 1, 27)], []]
