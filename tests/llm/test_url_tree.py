from marlstone.llm import url_tree


def verdicts(spark, urls):
    rows = [(k, u) for k, u in enumerate(urls)]
    return {r.page_id: r for r in url_tree.judge(spark.createDataFrame(rows, "page_id int, url string")).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://Sub.Example.NET/en/1?x#y", "sub.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/de/1", "example.net", "/de/1", "net/", "block"),
        ("https://example.net?x", "example.net", "", None, None),
        ("//no", "", "", None, None),
        (None, "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", None, None),
        ("http://m.example.com/de/", "m.example.com", "/de/", "example.com/de/", "block"),
        ("http://ÄB.org/fr/x", "Äb.org", "/fr/x", "org/fr/", "allow"),
        ("http://x.org/FR/x", "x.org", "/FR/x", None, None),
    ]
    got = verdicts(spark, [c[0] for c in cases])
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict or (verdict is None and got[k].verdict in ("allow", "block"))


def test_tree_generalises_and_rejects(spark):
    urls = [f"http://a.example.com/de/{k}" for k in range(40)] + [f"http://a.example.com/en/{k}" for k in range(40)]
    slugs = [f"http://b.example.com/tag/{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    got = verdicts(spark, urls + slugs)
    assert {got[k].template for k in range(40)} != {got[k].template for k in range(40, 80)}
    assert {got[k].verdict for k in range(40)} == {"block"} and {got[k].verdict for k in range(40, 80)} == {"allow"}
    assert {got[80 + k].template for k in range(len(slugs))} == {"/tag/*"}


def test_rejected_templates_reach_unlisted_pages(spark):
    """The listed path has a doubled slash; shapes don't, so the other pages share its template."""
    urls = [f"http://a.example.com/de/{k}" for k in range(40)] + [f"http://a.example.com//de/{k}" for k in range(3)]
    got = verdicts(spark, urls)
    assert [got[k].rule for k in (40, 41, 42)] == [None] * 3 and {got[k].verdict for k in (40, 41, 42)} == {"block"}


def test_paths_of_any_depth_are_told_apart(spark):
    deep = "a/b/c/d/e/f/g"
    urls = [f"http://x.org/{deep}/good/{k}" for k in range(30)] + [f"http://x.org/{deep}/bad/{k}" for k in range(30)] + ["http://x.org/" + "q/" * 3000]
    labels = spark.createDataFrame([(u, "block" if "bad" in u else "allow") for u in urls[:60]], "url string, label string")
    got = {r.url: r for r in url_tree.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules=(), labels=labels).collect()}
    assert [got[u].verdict for u in urls] == ["allow"] * 30 + ["block"] * 30 + ["allow"]
    assert got[urls[0]].template == f"/{deep}/good/#" and got[urls[-1]].template == "/" + "/".join("q" * 3000)


def test_siblings_alike_merge_with_each_other(spark):
    """Two sorts of folders, both far from what they share on average."""
    urls = [f"http://x.org/{f}{g}/{k}" for f in ("bad", "good") for g in "abc" for k in range(40)]
    labels = spark.createDataFrame([(u, "block" if "bad" in u else "allow") for u in urls], "url string, label string")
    got = {r.url: r for r in url_tree.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules=(), labels=labels).collect()}
    assert {got[u].template for u in urls if "bad" in u} in ({"/~1/#"}, {"/~1/*"}) and {got[u].template for u in urls if "good" in u} in ({"/~0/#"}, {"/~0/*"})


def test_hosts_without_labels_learn_from_others(spark):
    urls = [f"http://{h}.org/{f}/{k}" for h in "abcdef" for f in ("casino", "news") for k in range(20)]
    labels = spark.createDataFrame([(u, "block" if "casino" in u else "allow") for u in urls if "//f." not in u], "url string, label string")
    judged = url_tree.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules=(), labels=labels)
    assert all(r.verdict == ("block" if "casino" in r.url else "allow") for r in judged.collect())


def test_the_tree_decides_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    row = url_tree.unlisted_blocked(url_tree.judge(pages)).first()
    assert row.pages == pages.count() and 0 < row.blocked < row.unlisted


def test_edges(spark):
    rows = spark.createDataFrame([(1, "http://a.org/fr/", "x", 0), (1, "http://a.org/fr/", "x", 0)], "page_id int, url string, Host string, verdict int")
    assert url_tree.judge(rows).count() == 2 and url_tree.judge(rows.limit(0)).count() == 0
    plan = url_tree.judge(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
