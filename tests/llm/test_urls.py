"""URL filter: parsing and rules against plain Python, models against dictionaries."""

import math

import numpy as np
import pytest
from readweave.llm import urls

SF = "/root/testdata/sf0.001"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def plain_rule(host, path):
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


CASES = [None, "", "x", "://", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "a://b://c/d", "http://com", "http://com/", "http://example.com?/en/", "http://É.com#/", "http://x.net/es/a?b", "http://xnet/es/", "http://net/fr/", "http://example.com/en", "http://a.example.com/en/", "http://www.example.com/en/q", "http://u.org/a\nb"]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(CASES)], "page_id int, url string, host string")
    got = {r["page_id"]: r for r in urls.judged(df).collect()}
    for i, u in enumerate(CASES):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = {r["page_id"]: r for r in urls.op7_urls(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        rule, verdict = plain_rule(*plain_parts(p["url"]))
        assert got[p["page_id"]]["rule"] == rule and verdict in (None, got[p["page_id"]]["verdict"])


def test_likelihood_is_the_smoothed_markov_model():
    learn, test = [b"abcabc", b"abd", b"a/b"], [b"abc", b"", b"zz", b"a"]
    seen = {}
    for t in learn:
        t = bytes(urls.ORDER) + t
        for i in range(urls.ORDER, len(t)):
            for k in range(urls.ORDER + 1):
                for key in ((t[i - k : i],), (t[i - k : i], t[i])):
                    seen[key] = seen.get(key, 0) + 1
    want = []
    for t in test:
        t, total = bytes(urls.ORDER) + t, 0.0
        for i in range(urls.ORDER, len(t)):
            p = 1 / 256
            for k in range(urls.ORDER + 1):
                c = t[i - k : i]
                p = (seen.get((c, t[i]), 0) + urls.PULL * p) / (seen.get((c,), 0) + urls.PULL)
            total += math.log(p)
        want.append(total / max(1, len(t) - urls.ORDER))
    assert np.allclose(urls.log_likelihood(urls.count(learn), test), want)


def test_models_tell_hosts_apart(spark):
    rows = [(f"good{i}.site/news/{i}", "allow") for i in range(400)] + [(f"spam{i}.farm/win/{i}", "block") for i in range(300)]
    model = urls.fitted(spark.createDataFrame(rows, "text string, verdict string"))
    s = model.scores([b"good999.site/news/5", b"spam999.farm/win/5"])
    assert s[0] <= model.threshold < s[1]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "http://a.org/x"), (1, "http://a.org/x")]])
def test_edges(spark, rows):
    out = urls.judged(spark.createDataFrame(rows, "page_id int, url string")).collect()
    assert len(out) == len(rows) and all(r["verdict"] == "allow" for r in out)
