import random
import re

from quillon.llm import url_rules
from quillon.llm.url_rules import judge


def plain(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), h + p, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[4] if best else default


def urls(n=400):
    rng = random.Random(5)
    label = ["com", "example", "a", "b", "net", "www", "Éx", "x-y", "EXAMPLE", "co", "c", ""]
    part = ["en", "7", "de", "8", "72", "e", "", "x/y"]
    made = [f"{rng.choice(['http', 'HTTPS', ''])}://" + ".".join(rng.choices(label, k=rng.randint(1, 4))) + rng.choice(["", "/", "?"]) + "/".join(rng.choices(part, k=rng.randint(0, 3))) + rng.choice(["", "?q=a/b", "#t://x"]) for _ in range(n)]
    return made + [None, "", "example.com/en/", "http://", "http://com/en/", "http://www.example.com:80/en/7", "://net/de/", "x://a.net/de/#://org/es/", "http://example.com" + "/en/7" * 5000]


def check(spark, rules, default="allow"):
    made = urls()
    docs = spark.createDataFrame([(i, u, "clash", 3) for i, u in enumerate(made)] + [(0, made[0], "clash", 3)], "page_id long, url string, host string, salt int")
    out = judge(docs, rules, default).collect()
    assert len(out) == len(made) + 1
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == plain(made[r.page_id], rules, default), made[r.page_id]


def test_rules_of_the_query(spark):
    check(spark, url_rules.RULES)


def test_nested_rules_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rules = sorted({(".".join(rng.choices(["com", "example", "a", "b", "net", "co", "c"], k=rng.randint(1, 3))), "/" + "/".join(rng.choices(["en", "7", "de", ""], k=rng.randint(0, 2)))) for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    check(spark, rules, "block")
    monkeypatch.setattr(url_rules, "MAX_RULES", 25)
    check(spark, rules, "block")


def test_empty(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
