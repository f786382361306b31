from __future__ import annotations

import pytest

from corpusloom.llm import tables, url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, chars: min([len(s), *(s.find(c) for c in chars if c in s)])
    host, rest = rest[: cut(rest, "/?#")], rest[cut(rest, "/?#") :]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[: cut(rest, "?#")]


def rule_of(host, path):
    fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return (best[1] + best[2], best[0]) if best else (None, None)


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.train(url_filter.labelled_urls(spark))


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "http://com/", "http://com", "http://xcom/a", "http://example.com/EN/",
    "http://a.b.example.com/en/x?y#z", "http://net/es/", "http://n.net/fr/?q", "http://é.É.net/es/1", "x://y://z.com/a", "http://a.net?b/es/",
    "http://www.casino-win.example.org/en/1", "http://ththth.example.org/en/825\nnext", "://h.com/p",
]


def check(rows, urls):
    seen = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in rows), key=repr)
    assert seen == sorted(((i, *parts(u), rule_of(*parts(u))[0]) for i, u in urls), key=repr)
    for r in rows:
        verdict = rule_of(r["host"], r["path"])[1]
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_query(spark, sf_dir):
    urls = [tuple(r) for r in tables.read(spark, sf_dir, "pages").select("page_id", "url").collect()]
    check(url_filter.op10(spark, sf_dir).collect(), urls)


def test_edge_cases(spark, model):
    urls = [*enumerate(URLS), (3, "http://a.com/"), (3, "http://a.com/"), (None, "http://b.org/")]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string")
    rows = url_filter.judge(df, model).collect()
    check(rows, urls)
    by = {r["page_id"]: r["verdict"] for r in rows}
    assert by[0] == by[1] == by[2] == "allow" and by[15] == "block" and by[16] == "allow"
    assert url_filter.judge(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    rows = [(url, label, i % 4) for label, urls in url_filter.LABELLED.items() for i, url in enumerate(urls.split())]
    right = total = 0
    for fold in range(4):
        model = url_filter.train(spark.createDataFrame([(u, y) for u, y, k in rows if k != fold], "url string, label int"))
        test = [(i, u, y) for i, (u, y, k) in enumerate(rows) if k == fold]
        out = url_filter.judge(spark.createDataFrame([(i, u) for i, u, _ in test], "page_id long, url string"), model, rules=()).collect()
        got = {r["page_id"]: r["verdict"] == "block" for r in out}
        right, total = right + sum(got[i] == bool(y) for i, _, y in test), total + len(test)
    assert right / total > 0.8
