"""Databases and data sources."""

import json
import random
import time

import pytest

from aspectra.operators.catalog import crawl_pages
from aspectra.sources.crawl_source import catalogue_source, recorded_site
from aspectra.sources.database import read_in_ranges, unclassified_comments
from aspectra.sources.files import write_jdbc

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def database(name):
    return f"jdbc:derby:memory:{name};create=true"


def test_ranges_of_a_skewed_key(spark):
    rng, url = random.Random(6), database("ranges")
    keys = [*range(900), *(10**6 + rng.randrange(10**12) for _ in range(100)), None, None]
    rows = [(k, f"row {i}") for i, k in enumerate(keys)]
    write_jdbc(spark.createDataFrame(rows, "id long, body string"), url, "skewed", **DRIVER)
    got = read_in_ranges(spark, url, "skewed", "id", 8, fetch_rows=7, **DRIVER)
    parts = got.rdd.glom().collect()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for p in parts for r in p)
    assert len(parts) == 8 and max(map(len, parts)) <= 2 * len(rows) / 8
    seen = [r["id"] for p in parts for r in p if r["id"] is not None]
    assert seen == sorted(seen)  # ranges in order, and each sorted
    # rows that come after the ranges were cut are for the next read
    write_jdbc(spark.createDataFrame([(10**14, "new")], "id long, body string"), url, "skewed", **DRIVER)
    assert got.count() == len(rows) and read_in_ranges(spark, url, "skewed", "id", 8, **DRIVER).count() == len(rows) + 1


def test_ranges_of_odd_tables(spark):
    url = database("odd")
    write_jdbc(spark.createDataFrame([], "id long, name string"), url, "nothing", **DRIVER)
    write_jdbc(spark.createDataFrame([(None, "a"), (None, "b")], "id long, name string"), url, "nameless", **DRIVER)
    write_jdbc(spark.createDataFrame([(5, "a")] * 9 + [(6, "b")], "id long, name string"), url, "crowd", **DRIVER)
    assert read_in_ranges(spark, url, "nothing", "id", 4, **DRIVER).count() == 0
    assert read_in_ranges(spark, url, "nameless", "id", 4, **DRIVER).count() == 2
    assert read_in_ranges(spark, url, "crowd", "id", 4, **DRIVER).count() == 10
    assert read_in_ranges(spark, url, "crowd", "id", 1, columns=["name"], where='"id" > 5', **DRIVER).collect() == [("b",)]
    with pytest.raises(ValueError, match="no.* number|not a whole"):
        read_in_ranges(spark, url, "crowd", "name", 4, **DRIVER)


def test_unclassified_comments(spark):
    url = database("comments")
    rows = [(1, "good camera", None), (2, "  a ", None), (3, "fast", "{}"), (4, "abc", None), (5, None, None)]
    write_jdbc(spark.createDataFrame(rows, "comment_id long, comment_text string, aspects string"), url, "dim_video_comments", **DRIVER)
    got = unclassified_comments(spark, url, partitions=2, **DRIVER)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "good camera"), (4, "abc")]


@pytest.fixture
def site(tmp_path):
    """Recorded pages of three slugs: one full, one that repeats itself, one with a gap; and their rows."""
    rng, rows = random.Random(9), []
    for slug, pages in {"full": range(1, 9), "again": range(1, 7), "gap": [1, 2, 4]}.items():
        for page in pages:
            n = 3 if slug == "again" and page > 3 else 40
            found = [{"url": f"{slug}/{rng.randrange(n)}", "name": f"p{i}"} for i in range(5)] + [{"url": None, "name": "-"}, {"url": "", "name": "-"}]
            if slug == "again" and page > 3:
                found = [{"url": r[1], "name": "old"} for r in rows if r[0] == "again"][:5]
            (tmp_path / slug).mkdir(exist_ok=True)
            (tmp_path / slug / f"{page}.json").write_text(json.dumps(found))
            rows += [(slug, r["url"], page) for r in found]
    return str(tmp_path), rows


def crawled(df):
    return sorted((r["slug"], r["page"], r["url"]) for r in df.collect())


def test_catalogue_as_a_data_source(spark, site):
    root, rows = site
    spark.dataSource.register(catalogue_source(recorded_site(root)))
    pages = spark.createDataFrame(rows, "slug string, url string, page int")
    for most in (60, 2):
        want = crawled(crawl_pages(pages, "slug", "page", "url", most))
        got = spark.read.format("catalogue").options(slugs="full, again,gap,none", maxPages=most, wait=0).load()
        assert crawled(got) == want and len(want) > 10
        assert got.rdd.getNumPartitions() == 4
    named = spark.read.format("catalogue").schema("name string, url string").options(slugs="gap", wait=0).load()
    assert named.columns == ["name", "url"] and all(r["name"].startswith("p") for r in named.collect())
    with pytest.raises(Exception, match="slugs"):
        spark.read.format("catalogue").load().count()


def test_catalogue_as_a_stream_with_restarts(spark, site, tmp_path):
    root, rows = site
    spark.dataSource.register(catalogue_source(recorded_site(root), "catalogue_stream"))
    want = crawled(crawl_pages(spark.createDataFrame(rows, "slug string, url string, page int"), "slug", "page", "url", 12))

    def run(batches):
        stream = spark.readStream.format("catalogue_stream").options(slugs="full,again,gap", maxPages=12, pagesPerBatch=2, wait=0).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        end = time.time() + 60
        while time.time() < end and (query.lastProgress or {}).get("batchId", -1) < batches - 1:
            time.sleep(0.2)
        query.processAllAvailable()
        query.stop()
        return spark.read.schema("url string, slug string, page int").parquet(f"{tmp_path}/out")

    run(2)
    assert crawled(run(6)) == want
