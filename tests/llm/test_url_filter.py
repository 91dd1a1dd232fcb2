import datetime as dt
import random

from tessera.llm import url_filter as x

DAY = dt.datetime(2024, 1, 1)
at = lambda d: DAY + dt.timedelta(days=d)

ENTRIES = [
    ("ads", "Evil.example", "add", at(0)),
    ("ads", "evil.example", "remove", at(100)),
    ("ads", "evil.example", "add", at(400)),
    ("ads", "deep.sub.good.example", "add", at(0)),
    ("paths", "good.example/bad", "add", at(10)),
    ("paths", "good.example/bad", "add", at(10)),
    ("both", "tie.example", "add", at(5)),
    ("both", "tie.example", "remove", at(5)),
    ("ads", None, "add", at(0)),
    ("ads", "x.example", None, at(0)),
    ("ads", "x.example", "add", None),
]
CAPTURES = [
    ("https://user:pw@www.EVIL.example:8080/a?b#c", at(50), "ads:evil.example"),
    ("http://a.b.evil.example", at(99.999), "ads:evil.example"),
    ("http://evil.example/", at(0), "ads:evil.example"),
    ("http://evil.example/", at(100), None),
    ("http://evil.example/", at(399), None),
    ("http://evil.example/", at(5000), "ads:evil.example"),
    ("http://notevil.example/", at(50), None),
    ("http://good.example/bad/x/y", at(20), "paths:good.example/bad"),
    ("http://good.example/bad?q", at(20), "paths:good.example/bad"),
    ("http://good.example/badly", at(20), None),
    ("http://good.example/bad", at(9), None),
    ("http://sub.good.example/bad", at(20), None),
    ("http://deep.sub.good.example/bad", at(20), "ads:deep.sub.good.example"),
    ("http://tie.example/", at(6), None),
    ("http://x.example/", at(6), None),
    ("no url at all", at(6), None),
    ("", at(6), None),
    (None, at(6), None),
    ("http://evil.example/", None, None),
    ("http://evil.example/", at(0), "ads:evil.example"),
]


def frames(spark):
    entries = spark.createDataFrame(ENTRIES, "list string, key string, action string, dated timestamp")
    captures = spark.createDataFrame([(i, u, t, w, "x") for i, (u, t, w) in enumerate(CAPTURES)], "id long, url string, fetched timestamp, want string, key string")
    return captures, entries


def test_every_capture(spark):
    captures, entries = frames(spark)
    got = x.filter_urls(captures, entries)
    assert got.columns == [*captures.columns, "blocked", "n_matches", "matched"]
    rows = got.collect()
    assert len(rows) == len(CAPTURES)
    for r in rows:
        assert (r.matched, r.blocked) == (r.want, r.want is not None), r


def test_empty(spark):
    captures, entries = frames(spark)
    assert x.filter_urls(captures.limit(0), entries).count() == 0
    assert x.filter_urls(captures, entries.limit(0)).where("blocked").count() == 0


def test_no_python_in_the_plan(spark, capsys):
    x.filter_urls(*frames(spark)).explain("formatted")
    plan = capsys.readouterr().out
    assert not [x for x in ("EvalPython", "InPandas", "InArrow", "PythonUDF") if x in plan]


def test_against_brute_force(spark):
    rnd = random.Random(2)
    keys = ["com", "a.com", "b.a.com", "c.org", "c.org/x", "c.org/x/y"]
    entries = [(rnd.choice(["l", "m", None]), rnd.choice(keys), rnd.choice(["add", "remove"]), at(rnd.randrange(400))) for _ in range(2000)]
    entries.append(("late", "c.org", "add", dt.datetime(2150, 1, 1)))
    captures = [(i, rnd.choice(["http://a.com/", "http://b.a.com/q", "http://c.org/x/y/z", "http://c.org/x", "http://d.com"]), at(rnd.randrange(-5, 420) + rnd.choice([0, 0.5]))) for i in range(300)]
    captures += [(900, "http://c.org/", dt.datetime(9000, 1, 1)), (901, "http://c.org/x?" + "q" * 100_000, at(500)), (902, None, at(1)), (902, None, at(1))]
    cover = {"http://a.com/": {"com", "a.com"}, "http://b.a.com/q": {"com", "a.com", "b.a.com"}, "http://c.org/x/y/z": {"c.org", "c.org/x", "c.org/x/y"}, "http://c.org/x": {"c.org", "c.org/x"}, "http://d.com": {"com"}, "http://c.org/": {"c.org"}}
    want = set()
    for i, u, t in captures:
        here = cover.get(u, {"c.org", "c.org/x"} if u else set())
        on = []
        for l, k in {(e[0], e[1]) for e in entries}:
            past = [(d, a == "remove") for ll, kk, a, d in entries if (ll, kk) == (l, k) and d <= t]
            if k in here and past and not max(past)[1]:
                on.append(f"{l or ''}:{k}")
        want.add((i, len(on), min(on, default=None)))
    df = spark.createDataFrame(captures, "id long, url string, fetched timestamp").selectExpr("*", "1 AS `__url`", "2 AS `__n`", "3 AS since", "4 AS asked_url", "5 AS blocked")
    table = spark.createDataFrame(entries, "list string, key string, action string, dated timestamp")
    assert x.histories(table).where("size(history) > 1 and until is not null").count() > 0
    got = x.filter_urls(df, table).collect()
    assert len(got) == len(captures) and {(r.id, r.n_matches, r.matched) for r in got} == want
