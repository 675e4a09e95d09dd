import datetime as dt
import random

from pyspark.sql import functions as F

from corpusloom.llm.url_lists import judged, url_targets, validity


def day(n):
    return None if n is None else dt.date(2024, 1, 1) + dt.timedelta(days=n)


def changes(spark, rows):
    rows = [(a, b, day(c), d) for a, b, c, d in rows]
    return spark.createDataFrame(rows, "list string, target string, day date, action string")


def captures(spark, rows):
    return spark.createDataFrame([(a, b, day(c)) for a, b, c in rows], "page_id long, url string, fetched date")


def expected(rows, dated):
    """Brute force: replay each entry's changes up to the day of every capture."""
    rank = {"allow": 0, "block": 1, "remove": 2}
    out = []
    for page_id, url, fetched in rows:
        found = []
        if url and fetched is not None and "://" in url:
            host, _, path = url.split("://")[1].partition("/")
            host = host.lower()
            segments = [s.lower() for s in path.split("?")[0].split("#")[0].split("/") if s]
            labels = host.split(".")
            covers = [host + "/" + "/".join(segments[:n]) for n in range(len(segments), 0, -1)]
            covers += [".".join(labels[n:]) for n in range(len(labels))]
            for name, target in {(a, b) for a, b, _, _ in dated}:
                mine = sorted(((c, rank[d], d) for a, b, c, d in dated if (a, b) == (name, target) and c <= fetched))
                state = mine[-1][2] if mine else None
                if state in ("allow", "block") and target in covers:
                    found.append((covers.index(target), state != "block", name, target, state))
        best = min(found) if found else (None,) * 5
        out.append((page_id, day(fetched), best[4], best[2], best[3], len(found)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.example", "www.a.example", "b.example", "x.y.b.example", "c.test"]
    rows = [(k, f"https://{rng.choice(hosts)}/{rng.choice(['', 'en', 'en/x', 'EN/x/y?q=1', 'de#f', 'en/x/y/a/b/c/d'])}", rng.randrange(120)) for k in range(300)]
    targets = ["a.example", "example", "b.example", "y.b.example", "www.a.example/en", "b.example/en/x", "c.test", "a.example/de", "b.example/en/x/y/a/b/c", "test"]
    dated = [(rng.choice(["p", "q"]), rng.choice(targets), rng.randrange(-50, 130), rng.choice(["block", "allow", "remove"])) for _ in range(80)]
    got = judged(captures(spark, rows), changes(spark, dated)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, dated)


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "nonsense", 5), (3, "https://a.example/", None), (4, "https://a.example/x", 5), (4, "https://a.example/x", 5),
            (None, "https://a.example/" + "y" * 100_000, 5), (6, "https://u:p@A.EXAMPLE:80/", 5)]
    dated = [("l", "a.example/", 0, "block"), ("l", "a.example", 0, "block"), (None, "a.example", 0, "allow"), ("l", None, 0, "block"),
             ("l", "a.example", None, "remove"), ("l", "a.example", 9, None)]
    df = captures(spark, rows).withColumn("target", F.lit("x")).withColumn("period", F.lit(1)).withColumn("list", F.lit(1))
    got = sorted(((str(r.page_id), r.action, r.active) for r in judged(df, changes(spark, dated)).collect()), key=str)
    assert got == [("1", None, 0), ("2", None, 0), ("3", None, 0), ("4", "block", 1), ("4", "block", 1), ("6", "block", 1), ("None", "block", 1)]
    assert judged(captures(spark, []), changes(spark, dated)).collect() == []
    assert [r.active for r in judged(captures(spark, rows[3:4]), changes(spark, [])).collect()] == [0]


def test_intervals_do_not_overlap(spark):
    dated = [("l", "t", 3, "block"), ("l", "t", 3, "allow"), ("l", "t", 9, "remove"), ("l", "t", 9, "block"), ("l", "t", 20, "allow")]
    got = sorted((r.action, r.valid_from, r.valid_to) for r in validity(changes(spark, dated)).collect())
    assert got == [("allow", day(20), None), ("block", day(3), day(9))]


def test_targets(spark):
    def of(url):
        return spark.range(1).select(url_targets(F.lit(url)).alias("t")).first().t

    assert of("https://A.b.example/x/Y/?q") == ["a.b.example/x/y", "a.b.example/x", "a.b.example", "b.example", "example"]
    assert of("https://one") == ["one"] and of("one") == []


def test_hot_host_is_keyed_by_time(spark):
    rows = [(k, "https://hot.example/", k % 700) for k in range(2000)]
    plan = judged(captures(spark, rows), changes(spark, [("l", "hot.example", 1, "block")]))
    assert plan.where("action = 'block'").count() == sum(k % 700 >= 1 for k in range(2000))


def test_long_paths_and_hosts(spark):
    deep, host = "/".join("abcdefg"), ".".join("klmnopqrs") + ".example"
    rows = [(1, f"https://a.example/{deep}", 5), (2, f"https://{host}/x", 5), (3, "https://b.example/" + "s/" * 20_000, 5)]
    dated = [("l", "a.example/A/b/c/d/e/", 0, "block"), ("l", "a.example/a/b/c/d", 0, "allow"), ("l", "l.m.n.o.p.q.r.s.example", 0, "block"),
             ("l", "m.n.o.p.q.r.s.example", 0, "allow"), ("l", "b.example" + "/s" * 20_000, 0, "block")]
    got = sorted((r.page_id, r.action, r.target, r.active) for r in judged(captures(spark, rows), changes(spark, dated)).collect())
    assert [g[:2] + g[3:] for g in got] == [(1, "block", 2), (2, "block", 2), (3, "block", 1)]
    assert [g[2] for g in got] == ["a.example/a/b/c/d/e", "l.m.n.o.p.q.r.s.example", "b.example" + "/s" * 20_000]
    every = spark.range(1).select(url_targets(F.lit(f"https://{host}/{deep}"))).first()[0]
    assert every == [f"{host}/{deep[:n]}" for n in range(13, 0, -2)] + [host[n:] for n in range(0, 20, 2)]


def test_top_level_domains(spark):
    rows, dated = [(1, "https://www.a.example/x", 5), (2, "https://example/", 5)], [("l", "example", 0, "block")]
    seen = [sorted((r.page_id, r.active) for r in judged(captures(spark, rows), changes(spark, dated), **k).collect()) for k in ({"top_level": False}, {})]
    assert seen == [[(1, 0), (2, 1)], [(1, 1), (2, 1)]]
