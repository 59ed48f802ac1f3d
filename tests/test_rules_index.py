"""Rules by join keys against a plain loop over all rows and rules."""

import random
import re

from pagequarry.operators import rules

HOSTS = ["www.a.com", "a.com", "nota.com", "blog.a.com", "x.blog.org", "b.org", "", None]
URLS = ["https://a.com/", "https://a.com/docs/x", "https://a.com/docs/deep/y.html", "https://b.org/en/1", "https://b.org/en", "", None]
PATHS = ["/", "/docs/x", "/docs/deep/y.html", "/en/1", "/en", "", None]
PATTERNS = ["*", "*.a.com", "*.com", "*.", "*.*", "*.blog.*", "*.a.*", "https://a.com/docs/x", "https://a.com/docs/*", "https://a.com/*/x", "ht*", "https://[ab].org/en/?", "[", None, ""]
GLOBS = ["/docs/*", "/docs/deep/*.html", "/en/?", "*", "/*/x", "/[de]*/1", "[", None, None, None, ""]


def plain(rows, listed):
    out = set()
    for i, url, host, path, kind in rows:
        hits = []
        for r in listed:
            ok = r.get("enabled") is not False
            if r["url_pattern"]:
                place, regex = rules.url_regex(r["url_pattern"])
                value = host if place == "host" else url
                ok = ok and (regex == "^" or (value is not None and re.search(regex, value) is not None))
            ok = ok and (not r["content_type"] or kind == r["content_type"]) and (not r["domain"] or host == r["domain"])
            ok = ok and (not r["path_pattern"] or (path is not None and re.search(rules.glob_regex(r["path_pattern"]), path) is not None))
            if ok:
                hits.append((-(r["priority"] or 0), r["id"], r["action"]))
        out |= {(i, rid, -p, action, n + 1) for n, (p, rid, action) in enumerate(sorted(hits))}
    return out


def made(rng, n):
    return [
        {"id": f"r{i:05}", "url_pattern": rng.choice(PATTERNS), "content_type": rng.choice([None, None, "api", ""]), "domain": rng.choice([None, None, None, "a.com", "b.org"]), "path_pattern": rng.choice(GLOBS), "priority": rng.choice([None, 1, 2, 9]), "enabled": rng.choice([True, None, False]), "action": rng.choice(["x", None])}
        for i in range(n)
    ]


def test_rules_by_key(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(URLS), rng.choice(HOSTS), rng.choice(PATHS), rng.choice(["api", "article", None])) for i in range(120)]
    listed = made(rng, 150)
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, path string, content_type string")
    got = [(r["page_id"], r["rule_id"], r["priority"], r["action"], r["rank"]) for r in rules.matches(frame, rules.rules_table(spark, listed)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, listed)
    assert rules.matches(frame, rules.rules_table(spark, [])).count() == 0
    assert rules.matches(frame.limit(0), rules.rules_table(spark, listed)).count() == 0


def test_a_hundred_thousand_rules(spark):
    """The plan does not grow with the rules, and a row meets only the rules under its keys."""
    rows = spark.createDataFrame([(i, f"https://h{i}.site{i % 9}.org/s{i % 50}/p", f"h{i}.site{i % 9}.org", f"/s{i % 50}/p", "api") for i in range(200)], "page_id long, url string, host string, path string, content_type string")
    few = rules.rules_table(spark, [{"id": "1", "domain": "h1.site1.org"}])
    table = spark.range(100_000).selectExpr(
        "concat('r', id) AS id", "CASE id % 4 WHEN 0 THEN concat('*.site', id, '.org') WHEN 1 THEN concat('https://h', id, '.site', id % 9, '.org/*') END AS url_pattern", "CAST(NULL AS STRING) AS content_type",
        "CASE id % 4 WHEN 2 THEN concat('h', id, '.site', id % 9, '.org') END AS domain", "CASE id % 4 WHEN 3 THEN concat('/s', id, '/*') END AS path_pattern", "CAST(id % 5 AS INT) AS priority", "true AS enabled", "'a' AS action")
    matched = rules.matches(rows, rules.compiled(table))
    size = lambda df: len(re.findall(r"\n", df._jdf.queryExecution().optimizedPlan().toString()))
    assert size(matched) == size(rules.matches(rows, few))
    got = {(r["page_id"], r["rule_id"]) for r in matched.collect()}
    want = set()
    for i in range(200):
        want |= {(i, f"r{i % 9}")} if (i % 9) % 4 == 0 else set()
        want |= {(i, f"r{i}")} if i % 4 == 2 else set()
        want |= {(i, f"r{i % 50}")} if (i % 50) % 4 == 3 else set()
    assert got == want
