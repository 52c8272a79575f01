import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.plans import pipeline, providers
from aspectra.plans.assistant import Assistant
from aspectra.plans.constants import ASPECTS
from aspectra.plans.schemas import PRODUCT_LINK
from aspectra.sources import files, html


def test_registry_matches_itself():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracle_of_every_engine_query(spark, small):
    import duckdb

    from aspectra.plans.queries import ORACLE, QUERIES
    from tools.compare import TABLES, canonical

    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, make in QUERIES.items():
        df = make(spark, small)
        found = df.collect()
        if name in ORACLE:
            result = db.execute(ORACLE[name])
            columns = [c[0] for c in result.description]
            assert sorted(columns) == sorted(df.columns), name
            assert canonical(found, df.columns) == canonical(result.fetchall(), columns), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0


def test_html(spark):
    page = '<a href="/x">A<b>c</b></a><div class="product-list-item"><p class="name"><a href="/p"> N </a></p><p class=price>1.000 đ<img class="lazy big" data-original=i.png></div><div class="product-list-item">no name</div>'
    assert html.product_items(page) == [{"product_name": "N", "url": "/p", "price_str": "1.000 đ", "image": "i.png"}]
    assert html.product_items(None) == [] and html.spec_table("") == {}
    table = '<div class="product-lightbox-content"><table><tr><td>A:</td><td> 1 </td></tr><tr><td>A</td><td>2</td></tr><tr><td>x</td></tr></table></div>'
    assert html.spec_table(table) == {"A": "2"}
    df = spark.createDataFrame([(1, page), (2, None)], "k long, h string")
    assert html.catalogue_links(df, "k", "h").first()["price_vnd"] == 1000
    assert html.page_anchors(df, "k", "h").count() == 2
    assert {r["k"]: r["specs"] for r in html.spec_maps(df, "k", "h").collect()} == {1: {}, 2: {}}


def test_files(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"product_name": "a", "url": "u", "price_vnd": 1, "extra": 2}]))
    bad.write_text("{}")
    assert files.read_json_list(spark, str(good), PRODUCT_LINK).first()["price_vnd"] == 1
    with pytest.raises(ValueError):
        files.read_json_list(spark, str(bad), PRODUCT_LINK)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_json_list(spark, str(tmp_path / "none.json"), PRODUCT_LINK)
    comments = spark.createDataFrame([("u", 'a "b"\nc, d')], "user_name string, comment_text string")
    files.write_comments_csv(comments, str(tmp_path / "c"))
    assert files.read_comments_csv(spark, str(tmp_path / "c")).first()["comment_text"] == 'a "b"\nc, d'
    files.create_tables(spark, str(tmp_path / "db"), {"links": PRODUCT_LINK})
    row = spark.createDataFrame([("a", "u", 1, "1", "i", "s")], PRODUCT_LINK)
    assert files.append_new(spark, row, str(tmp_path / "db/links"), ["url"]).count() == 1
    assert files.append_new(spark, row, str(tmp_path / "db/links"), ["url"]).count() == 0
    for _ in range(2):
        files.overwrite_parts(row, str(tmp_path / "parts"), "slug")
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 1


def test_steps(spark, tmp_path):
    ran = []
    steps = [
        pipeline.Step("a", str(tmp_path / "a"), lambda: (ran.append("a"), (tmp_path / "a").write_text("x"))),
        pipeline.Step("load", str(tmp_path / "a"), lambda: ran.append("load"), always=True),
    ]
    assert pipeline.run_steps(spark, steps) == ["a", "load"]
    assert pipeline.run_steps(spark, steps) == ["load"]


def test_a_half_written_step_runs_again(spark, tmp_path):
    out, ran = str(tmp_path / "out"), []
    step = pipeline.Step("tables", out, lambda: (ran.append(1), spark.range(3).write.mode("overwrite").parquet(out)))
    spark.range(9).write.parquet(out)
    (tmp_path / "out" / "_SUCCESS").unlink()  # as a job that died before its commit leaves it
    assert pipeline.run_steps(spark, [step]) == ["tables"] and pipeline.run_steps(spark, [step]) == []
    assert spark.read.parquet(out).count() == 3 and len(ran) == 1


def test_key_pool_and_ingest():
    pool = providers.KeyPool(["a", "b", "a"])
    assert {pool.take(), pool.take()} == {"a", "b"}
    pool.exhaust("a")
    pool.exhaust("b")
    with pytest.raises(providers.ExhaustedKeys):
        pool.take()
    with pytest.raises(providers.ExhaustedKeys):
        pipeline.ingest(["x"], lambda name: pool.take())
    assert pipeline.ingest(["x", "y"], lambda name: None) == ["x", "y"]


def test_query_vector():
    encoder = providers.hashing_encoder(16)
    plain = providers.query_vector("good phone", encoder)
    assert np.linalg.norm(plain) == pytest.approx(1)
    assert providers.query_vector("good phone", encoder, lambda q, k: ["", None, "  "]) == plain
    mixed = providers.query_vector("good phone", encoder, lambda q, k: ["bad phone"] * 9)
    assert np.linalg.norm(mixed) == pytest.approx(1) and mixed != plain


def test_names(spark):
    df = spark.createDataFrame([("Galaxy S23 cũ (Snapdragon 8 Gen 2)", "Qualcomm Snapdragon 8 Gen 2 (4 nm)"), ("cũ", None)], "n string, c string")
    assert [r[0] for r in df.select(providers.normalized_name(F.col("n"), F.col("c"))).collect()] == ["Galaxy S23 Snapdragon 8 Gen 2", "cũ"]


def test_assistant(spark):
    products = spark.createDataFrame([(1, "phone one", 10), (2, "tablet", 20)], "product_id int, product_name string, price int")
    dims = {a: spark.createDataFrame([(1, 1, *["v"] * len(c))], "dim_id int, product_id int, " + ", ".join(f"{x} string" for x in c)) for a, (_, c) in ASPECTS.items()}
    encoder = providers.hashing_encoder(8)
    chunks = spark.createDataFrame([(i, 1, "dim_camera", t) for i, t in enumerate(["good photo", "good photo", "bad lens"])], "chunk_id int, dim_id int, dim_table string, chunk_text string")
    vectors = providers.embed(chunks, ["chunk_id", "dim_id", "dim_table"], "chunk_text", encoder, 8)
    made = Assistant(products, dims, vectors, encoder)
    assert made.search_product("phone").first()["product_id"] == 1
    assert made.get_all_specs(1).count() == 8
    assert [r["chunk_text"] for r in made.get_comments(1, "camera", "good photo").orderBy("rank").collect()] == ["good photo", "bad lens"]
    assert made.get_comments(1, "battery", "x").count() == 0

    def broken(texts):
        raise ConnectionError("no encoder")

    made.encoder = broken
    with pytest.raises(ConnectionError):  # an encoder's error is the caller's; what the search itself fails in is not
        made.get_comments(1, "camera", "good photo")
    made.encoder = encoder
    made.embeddings = vectors.withColumn("embedding", F.expr("cast(raise_error('no vectors') as array<float>)"))
    assert {r["chunk_text"] for r in made.get_comments(1, "camera", "good photo").select("chunk_text").collect()} == {"good photo", "bad lens"}
    with pytest.raises(ValueError):
        made.ask("  ", [])
    assert made.ask("?", [("list_products", (15,))])[0].count() == 1


def test_fallback_where_a_search_fails(spark, monkeypatch):
    from aspectra.operators import search

    products = spark.createDataFrame([(1, "phone one", 10), (2, "tablet", 20)], "product_id int, product_name string, price int")
    made = Assistant(products, {}, products, providers.hashing_encoder(8))
    monkeypatch.setattr(search, "search_trigram", lambda p, q: p.where(F.expr("raise_error('no such operator') is null")))
    assert [r["product_id"] for r in made.search_product("PHONE").collect()] == [1]


def test_stream_into_partitions(spark, tmp_path):
    from aspectra.streaming.incremental import append_batches

    rows = [(i, f"d{i % 3}" if i % 4 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, day string")
    df.write.parquet(str(tmp_path / "in"))
    df.limit(0).write.partitionBy("day").parquet(str(tmp_path / "out"))
    for run in ("a", "b"):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        append_batches(stream, str(tmp_path / "out"), ["k", "day"], "k", str(tmp_path / run), lambda b: b, by="day")
    assert sorted(map(tuple, spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect())) == rows


def test_a_batch_is_transformed_once(spark, tmp_path):
    from aspectra.streaming.incremental import append_batches

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(day):
        seen.add(1)
        return day

    df = spark.createDataFrame([(i, f"d{i % 3}") for i in range(30)], "k long, day string")
    df.write.parquet(str(tmp_path / "in"))
    df.limit(0).write.partitionBy("day").parquet(str(tmp_path / "out"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    append_batches(stream, str(tmp_path / "out"), ["k", "day"], "k", str(tmp_path / "state"), lambda b: b.withColumn("day", counted("day")), by="day")
    assert seen.value == 30 and spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_windowed_stream(spark, small, tmp_path):
    from aspectra.streaming.incremental import windowed_counts

    schema = spark.read.parquet(f"{small}/events.parquet").schema
    stream = windowed_counts(spark.readStream.schema(schema).parquet(f"{small}/events*.parquet"), "ts", "event_type", "1 day")
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()


def test_retries_and_blocked_ingest():
    waits, calls = [], []

    def fails_twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return "up"

    assert pipeline.with_retries(fails_twice, 2, lambda a: 1.0 + a, sleep=waits.append) == "up" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        pipeline.with_retries(lambda: (_ for _ in ()).throw(OSError()), 1, lambda a: 0, sleep=lambda s: None)
    turned_away, waits = set(), []

    def one(name):
        if name not in turned_away:
            turned_away.add(name)
            raise pipeline.Blocked("403")

    assert pipeline.ingest(["x", "y"], one, sleep=waits.append) == ["x", "y"] and waits == [600, 600]


def test_crawl_by_pages(spark):
    from aspectra.sources.crawl import crawl, pages_of

    site = {("a", 1): ["u1", "u2", "u1", ""], ("a", 2): ["u2", "u3"], ("a", 3): ["u3"], ("a", 4): ["u9"], ("b", 1): []}
    fetch = lambda slug, page: [{"url": u, "name": u.upper()} for u in site.get((slug, page), [])]
    assert [(r["url"], r["page"]) for r in pages_of("a", fetch)] == [("u1", 1), ("u2", 1), ("u3", 2)]
    assert [r["url"] for r in pages_of("a", fetch, max_pages=1)] == ["u1", "u2"]
    tries = []

    def flaky(slug, page):
        tries.append(page)
        if len(tries) < 3:
            raise OSError
        return fetch(slug, page)

    assert len(list(pages_of("a", flaky, wait=0))) == 3 and tries == [1, 1, 1, 2, 3]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("slug", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("name", T.StringType())])
    slugs = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "s string")
    assert sorted(map(tuple, crawl(slugs, "s", fetch, schema).collect())) == [("a", 1, "u1", "U1"), ("a", 1, "u2", "U2"), ("a", 2, "u3", "U3")]


def test_parts_and_database(spark, tmp_path):
    df = spark.range(120).selectExpr("id as k", "'v' || id as v")
    path = str(tmp_path / "parts")
    assert files.write_parts_once(df.where("k < 70"), path, "k", 25) == 3
    assert files.write_parts_once(df, path, "k", 25) == 3  # the two full parts stay, the open one is written again
    assert files.write_parts_once(df, path, "k", 25) == 1
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect())) == [(i, f"v{i}") for i in range(120)]
    url, driver = "jdbc:derby:memory:parts;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for overwrite, many in ((True, 120), (False, 240), (True, 120)):
        files.write_jdbc(df, url, "items", overwrite, **driver)
        assert spark.read.jdbc(url, "items", properties=driver).count() == many
