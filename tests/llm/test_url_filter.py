import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sievework.llm import url_filter as u

START = date(2024, 1, 1)
ENTRIES = "list_name string, polarity string, kind string, entry string, action string, at date"


def test_hosts_and_paths(spark):
    urls = {
        "https://User:pw@WWW.Example.com:8080/a/b?x#y": ("www.example.com", ["a", "b"]),
        "http://example.com.": ("example.com", []),
        "example.com//A/": ("example.com", ["A"]),
        "http://[::1]:80/x": ("[::1]", ["x"]),
        "/only/path": (None, ["only", "path"]),
        "": (None, []),
        "  http://a.b?q=/x/y ": ("a.b", []),
    }
    df = spark.createDataFrame([(x,) for x in urls], "url string")
    for r in df.select("url", u.host_of(F.col("url")).alias("h"), u.path_of(F.col("url")).alias("p")).collect():
        assert (r.h, r.p) == urls[r.url], r.url


def brute(captures, entries):
    out = {}
    for id_, host, path, at in captures:
        names = []
        keys = {(e[0], e[1], e[2], e[3]) for e in entries}
        for name, polarity, kind, entry in sorted(keys):
            named = (host == entry or host.endswith("." + entry)) if kind == "domain" else (f"{host}/{path}/" + "").startswith(entry + "/")
            before = [(e[5], e[4] == "add") for e in entries if e[:4] == (name, polarity, kind, entry) and e[5] <= at]
            if named and before and max(before)[1]:
                names.append((f"{name} {polarity} {kind[0]}:{entry}", polarity))
        out[id_] = (sorted(n for n, _ in names), any(p == "block" for _, p in names) and not any(p == "allow" for _, p in names))
    return out


@pytest.mark.parametrize(("sent", "heavy"), [(1 << 24, 1000), (-1, 1000), (-1, 5), (-1, 1)])
def test_equals_brute_force(spark, monkeypatch, sent, heavy):
    """With list names that hold blanks and the names of the polarities; the list sent, or met in a shuffle with heavy keys and without."""
    monkeypatch.setattr(u, "HEAVY", heavy)
    rng = random.Random(6)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "xa.com", "d.org", "com"]
    paths = ["x", "x/y", "x/y/z", "xy", ""]
    entries = []
    for _ in range(120):
        kind = rng.choice(["domain", "url"])
        entry = rng.choice(hosts) + ("/" + rng.choice(paths[:4]) if kind == "url" else "")
        entries.append((rng.choice(["L", "easy list", "my allow", "block x block", "allow"]), rng.choice(["block", "block", "allow"]), kind, entry, rng.choice(["add", "remove"]), START + timedelta(rng.randrange(30))))
    captures = [(i, rng.choice(hosts), rng.choice(paths), START + timedelta(rng.randrange(-2, 33))) for i in range(400)]
    df = spark.createDataFrame([(i, f"https://{h}/{p}?q", at) for i, h, p, at in captures], "page_id long, url string, fetched date")
    got = u.filter_captures(df, spark.createDataFrame(entries, ENTRIES), sent_bytes=sent).collect()
    assert {r.page_id: (r.matches, r.blocked) for r in got} == brute(captures, entries)
    # Every interval is real: none is empty and none touches the next.
    for r in u.intervals(spark.createDataFrame(entries, ENTRIES)).collect():
        for v in r.valid:
            assert v.stop is None or v.start < v.stop


def test_polarity_is_not_read_from_texts(spark):
    df = spark.createDataFrame([(1, "http://a.com/x", START), (2, "http://b.com/", START)], "page_id long, url string, fetched date")
    entries = [("easy list", "block", "domain", "a.com", "add", START), ("x allow", "block", "domain", "b.com", "add", START), ("not block", "allow", "url", "b.com/z", "add", START)]
    got = {r.page_id: (r.matches, r.blocked) for r in u.filter_captures(df, spark.createDataFrame(entries, ENTRIES)).collect()}
    assert got == {1: (["easy list block d:a.com"], True), 2: (["x allow block d:b.com"], True)}


def test_no_task_gets_a_heavy_key(spark):
    """A list too large to send: what meets in the shuffle holds no key that many ask for, nor captures without host."""
    rows = [(i, f"http://h{i}.com/x" if i % 3 else None, START) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched date").repartition(4)
    entries = [("L", "block", "domain", f"h{i}.com", "add", START) for i in range(0, 3000, 2)] + [("L", "block", "domain", "com", "remove", START)]
    got = u.filter_captures(df, spark.createDataFrame(entries, ENTRIES), sent_bytes=-1)
    assert got.where("blocked").count() == sum(1 for i, url, _ in rows if url and i % 2 == 0)
    assert "LeftAnti" in got._jdf.queryExecution().toString() and got.count() == 3000


def test_query_equals_sql(same_as_sql):
    rows = same_as_sql("op10_url_filter")
    assert any(r[0] for r in rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, START), (2, "", START), (3, "http://a.com/x", None), (None, "http://a.com/x", START), (4, "http://a.com/x", START), (4, "http://a.com/x", START), (5, "http://a.com/" + "x/" * 20_000, START)], "page_id long, url string, fetched date")
    df = df.selectExpr("*", "1 as host", "2 as key", "3 as id", "4 as valid")
    entries = [("L", None, "domain", "a.com", "add", START), ("L", "block", "domain", "a.com", "remove", START), (None, "block", "domain", "a.com", "add", START), ("L", "block", "other", "a.com", "add", START), ("L", "block", "url", "a.com/x/x", "add", START), ("M", "block", "domain", "", "add", START), ("M", "block", "domain", "a.com", None, START)]
    got = {r.page_id: (r.matches, r.blocked) for r in u.filter_captures(df, spark.createDataFrame(entries, ENTRIES)).collect()}
    yes = (["L block d:a.com"], True)
    assert got == {1: ([], False), 2: ([], False), 3: ([], False), None: yes, 4: yes, 5: (["L block d:a.com", "L block u:a.com/x/x"], True)}
    none = spark.createDataFrame([], ENTRIES)
    assert sorted(str(r.page_id) for r in u.filter_captures(df, none).collect()) == ["1", "2", "3", "4", "4", "5", "None"]
    assert u.filter_captures(df, none).count() == 7 and u.filter_captures(df.limit(0), none).count() == 0
