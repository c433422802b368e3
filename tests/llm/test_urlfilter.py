import numpy as np
import pandas as pd

from quillspan.llm import urlfilter

URLS = [
    "http://a.net/x", "https://example.net/en/1", "http://www.EXAMPLE.net/en/1?q=/de/", "http://example.com/de/1", "http://example.com/d", "http://org/fr/", "http://x.org/fr/1#a", "http://a.net", "http://net/",
    "http://spam-farm.example.org/en", "http://www.cheap-pills.example.com/en", "http://a.net?x", "no scheme/net/", "", None, "http://", "x://http://a.net/", "http://a..net/", "http://xnet/", "http://a.net:80/", "http://é.net/é",
]


def plain(url, rules, hosts):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(r), len(r.split("/")[0]), r) for r in rules if under(r.split("/")[0]) and path.startswith(r[len(r.split("/")[0]) :])]
    rule = max(fits)[2] if fits else None
    return host, path, rule, rules[rule] if rule else "block" if any(map(under, hosts)) else "allow"


def frames(spark, rules, hosts):
    return spark.createDataFrame([*rules.items(), (None, "block")], "key string, verdict string"), spark.createDataFrame([(h,) for h in [*hosts, None]], "key string")


def judged(spark, urls, rules, hosts, **options):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    return {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(pages, ["page_id"], *frames(spark, rules, hosts), **options).collect()}


def check(spark, urls, rules, hosts, **options):
    assert judged(spark, urls, rules, hosts, **options) == {i: plain(u, rules, hosts) for i, u in enumerate(urls)}


def test_contract_rules(spark):
    check(spark, URLS * 2, urlfilter.RULES, urlfilter.HOSTS)


def test_shards_and_many_rules(spark):
    rules = {f"h{i}.net/p{i % 7}": ("block", "allow")[i % 2] for i in range(40)} | {"net/": "block"}
    urls = [f"http://a.h{i}.net/p{i % 7}/x" for i in range(0, 60, 2)] + [f"http://b{i}.com/" for i in range(50)]
    check(spark, urls, rules, ["b7.com"], max_bytes=40)


def test_no_rules_and_no_pages(spark):
    check(spark, URLS, {}, [])
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(pages, ["page_id"]).count() == 0


def test_cascade_is_exact_on_its_universe(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 3)  # many false positives, so several levels
    keys = [f"k{i}" for i in range(2000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = urlfilter.build(universe.where("cast(substring(key, 2) as int) < 300"), universe)
    assert len(cascade.levels) > 3
    assert cascade.member(pd.Series(keys)).tolist() == [i < 300 for i in range(2000)]


def test_verdicts_come_from_the_cascades(spark):
    """With cascades that take in every key, or none, rows change: nothing else knows the lists."""
    everything, nothing = urlfilter.Cascade(), urlfilter.Cascade()
    everything.levels = [(np.full(1, np.iinfo(np.uint64).max, np.uint64), 64)]
    true = judged(spark, URLS, urlfilter.RULES, urlfilter.HOSTS)
    loose = judged(spark, URLS, urlfilter.RULES, urlfilter.HOSTS, make=lambda *_: [everything])
    deaf = judged(spark, URLS, urlfilter.RULES, urlfilter.HOSTS, make=lambda *_: [nothing])
    assert {r[3] for r in loose.values() if r[0]} == {"block"} and loose != true
    assert {(r[2], r[3]) for r in deaf.values()} == {(None, "allow")} and deaf != true


def test_a_key_listed_twice_blocks(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    rules = spark.createDataFrame([("a.net/", "allow"), ("a.net/", "block"), ("a.net/x", "odd")], "key string, verdict string")
    assert tuple(urlfilter.judge(pages, ["page_id"], rules).first()) == (1, "a.net", "/x", "a.net/", "block")
