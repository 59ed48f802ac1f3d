"""Extension surfaces and further sources."""

import json

import pytest

from pagequarry.sources import extensions


def fetch(url):
    if "bad" in url:
        raise OSError("gone")
    return 200, f"<p>{url}</p>"


def test_page_source(spark, tmp_path):
    spark.dataSource.register(extensions.page_source("quarry_pages", fetch))
    got = {r["url"]: r for r in spark.read.format("quarry_pages").option("urls", "http://a http://bad http://c").option("partitions", "2").load().collect()}
    assert got["http://a"]["html"] == "<p>http://a</p>" and got["http://bad"]["error"].startswith("OSError") and len(got) == 3
    assert spark.read.format("quarry_pages").load().count() == 0
    spark.createDataFrame([(f"http://s/{i}",) for i in range(9)] + [("# note",), (" ",)], "value string").repartition(3).write.text(str(tmp_path / "seeds"))
    seeded = spark.read.format("quarry_pages").option("seeds", str(tmp_path / "seeds")).load()
    assert seeded.rdd.getNumPartitions() == 3 and sorted(r["url"] for r in seeded.collect()) == [f"http://s/{i}" for i in range(9)]


def test_capped_fetch_and_download(tmp_path):
    get = extensions.capped(lambda u: (200 if u == "ok" else 404, b"abcdef"), 4)
    assert get("ok") == b"abcd"
    with pytest.raises(OSError):
        get("no")
    calls = []
    down = extensions.download(lambda u: calls.append(u) or b"x", str(tmp_path / "d"))
    assert down("u", "n") == down("u", "n") and calls == ["u"]


def test_results_and_watch(spark, tmp_path):
    rows = spark.createDataFrame([("t", "u1", "control", True, 1.0), ("t", "u2", "experiment", False, 2.0)], "test_id string, user_id string, variant string, success boolean, response_time double")
    extensions.record_results(rows.coalesce(2), str(tmp_path / "r"))
    (tmp_path / "old.json").write_text(json.dumps([{"test_id": "t", "user_id": "u3", "variant": "control", "success": True, "response_time": 3}]))
    assert extensions.experiment_results(spark, str(tmp_path / "old.json")).count() == 1
    assert extensions.spilled(spark, str(tmp_path / "r"), "user_id string").count() == 2
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.json").write_text('{"k": 1}')
    query = extensions.watch(spark, str(tmp_path / "w"), "k int").writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("watched").count() == 1


def test_crawler_page(spark):
    rows = spark.createDataFrame([("<title> T </title>x y",), ("<h1>H</h1>",), ('<meta property="og:title" content="O">',), ("",), (None,)], "html string")
    assert [r[0] for r in rows.select(extensions.crawler_page(rows.html)["title"]).collect()] == ["T", "H", "O", "Untitled", "Untitled"]
