import pytest
from pyspark.sql import functions as F

from aspectra.operators import catalog, chunking, dedup, integrity, media, reviews, search, sessions
from aspectra.plans.constants import KEYWORDS, SPEC_LABELS
from aspectra.plans.schemas import dim_schema, spec_record_schema


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_keyword_counts():
    assert {a: len(set(k)) for a, k in KEYWORDS.items()} == {
        "camera": 36, "battery": 32, "display": 25, "performance": 39, "design": 33, "storage": 13, "connectivity": 19, "utilities": 24,
    }
    assert len(SPEC_LABELS) == 48
    assert len(spec_record_schema()) == 13


def test_dedup_partition_and_ties(spark):
    df = spark.createDataFrame([(1, "abc", "x"), (2, "ab", "x"), (3, "zz", "x"), (4, "q", None), (5, "", None)], "ord int, name string, hw string")
    masters, others = dedup.elect_masters(df, ["hw"], "name", "ord")
    assert rows(masters, "ord") == [(2,), (5,)]
    assert rows(others, "ord") == [(1,), (3,), (4,)]
    assert {r["id"] for r in masters.collect()} == {r["reference_id"] for r in others.collect()}
    empty, none = dedup.elect_masters(df.limit(0), ["hw"], "name", "ord")
    assert empty.count() == none.count() == 0


def test_distinct_urls(spark):
    df = spark.createDataFrame([(1, "u"), (2, ""), (3, None), (4, "u"), (5, "w")], "ord int, url string")
    assert rows(dedup.distinct_urls(df, "url", "ord"), "ord") == [(1,), (5,)]
    assert rows(dedup.distinct_urls(df, "url", "ord", 1), "ord") == [(1,)]


def test_final_key(spark):
    df = spark.createDataFrame([(" A ", "x"), (" ", " B"), (None, None), (None, "")], "q string, p string")
    assert [r[0] for r in df.select(dedup.final_name_key(F.col("q"), F.col("p"))).collect()] == ["a", " b", "unknown", "unknown"]


def test_sequential_ids(spark):
    df = spark.createDataFrame([(i * i,) for i in range(100)], "ord long").repartition(7)
    found = dedup.sequential_ids(df, "ord", "id", slices=5).collect()
    assert sorted((r["ord"], r["id"]) for r in found) == [(i * i, i + 1) for i in range(100)]
    assert dedup.sequential_ids(df.limit(0), "ord", "id").count() == 0


def test_idempotent_insert(spark):
    batch = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "b", 0)], "n int, k string, j int")
    stored = spark.createDataFrame([(9, "b", 0)], batch.schema)
    fresh = dedup.insert_new(stored, batch, ["k", "j"], "n")
    assert rows(fresh, "n") == [(1,)]
    again = dedup.insert_new(stored.unionByName(fresh.select(stored.columns)), batch, ["k", "j"], "n")
    assert again.count() == 0


def test_cap(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "g string, i int")
    assert dedup.cap_per_group(df, "g", ["i"], 2).count() == 3
    assert dedup.cap_per_group(df, "g", ["i"], 0).count() == 6


def test_over_fetch_may_give_fewer(spark):
    data = [(i, "same" if i < 10 else f"t{i}", float(i)) for i in range(20)]
    df = spark.createDataFrame(data, "id int, text string, d double").withColumn("g", F.lit(1))
    found = dedup.distinct_texts(df, ["g"], "text", "d", "id", top=3, over_fetch=2)
    assert rows(found, "id", "rank") == [(0, 1)]
    found = dedup.distinct_texts(df, ["g"], "text", "d", "id", top=3, over_fetch=5)
    assert rows(found, "id", "rank") == [(0, 1), (10, 2), (11, 3)]


def test_list_products(spark):
    df = spark.createDataFrame([(1, "Ab 1", 5), (2, "ab 2", None), (3, "c", 9), (4, "ab", 0)], "product_id int, product_name string, price int")
    ids = lambda d: [r["product_id"] for r in d.collect()]
    assert ids(search.list_products(df)) == [2, 3, 1, 4]
    assert ids(search.list_products(df, brand="")) == [2, 3, 1, 4]
    assert ids(search.list_products(df, max_price=0)) == []
    assert ids(search.list_products(df, max_price=9, brand="AB")) == [1]
    assert ids(search.list_products(df, brand="a_ 1")) == [1]


def test_specs_and_validators(spark):
    dims = spark.createDataFrame([(2, 7, "", None, "w"), (1, 7, "x", None, "")], "dim_id int, product_id int, design_style string, dimensions string, weight string")
    found = search.specs_of(dims, 7, "design").first()
    assert found["specs"] == {"design_style": "x", "weight": ""}
    with pytest.raises(ValueError):
        search.specs_of(dims, 7, "colour")
    with pytest.raises(ValueError):
        dim_schema("colour")


def test_mean_vector(spark):
    df = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 4.0]), (2, [0.0, 2.0])], "g int, v array<double>")
    found = {r["g"]: r["mean"] for r in search.mean_vector(df, "g", "v").collect()}
    assert found[1] == pytest.approx([0.6, 0.8]) and found[2] == pytest.approx([0.0, 1.0])


def test_roll_up_keeps_null_texts_and_old_reviews(spark):
    data = [(1, 2, None, {"camera": 1}), (1, 1, "a", {"camera": 1, "battery": 1}), (None, 3, "lost", {"camera": 1}), (2, 4, "none", {}), (2, 5, "untagged", None)]
    comments = spark.createDataFrame(data, "product_id int, comment_id int, t string, aspects map<string,int>")
    rolled = reviews.roll_up(comments, "product_id", "comment_id", "t")
    assert {(r["product_id"], r["aspect"]): (r["total"], r["comments"]) for r in rolled.collect()} == {(1, "camera"): (2, ["a", None]), (1, "battery"): (1, ["a"])}
    dims = spark.createDataFrame([(1, "old"), (2, "old")], "product_id int, user_review string")
    kept = {r["product_id"]: r["user_review"] for r in reviews.apply_reviews(dims, rolled, "camera").collect()}
    assert kept[2] == "old" and kept[1].startswith('{"total":2')
    assert reviews.aspect_coverage(comments).first()[:] == (1, 1)


def test_explode_reviews(spark):
    texts = ['{"total":3,"comments":["a"," ","b"]}', "not json", " ", None, "[1]", '{"comments":[{"text":"  x  y "},{"comment":"z"},5,null]}', '{"comments":"no list"}']
    df = spark.createDataFrame(list(enumerate(texts)), "dim_id int, user_review string")
    found = rows(reviews.explode_reviews(df, ["dim_id"]), "dim_id", "list_index", "chunk_text")
    assert found == [(0, 0, "a"), (0, 2, "b"), (5, 0, "x y"), (5, 1, "z"), (5, 2, "5")]


def test_reference_checks(spark):
    dims = {"a": (spark.createDataFrame([(1,)], "k int"), "k")}
    df = spark.createDataFrame([("bad", 1), ("a", 2), ("a", 1)], "dim_table string, dim_id long")
    assert rows(integrity.reference_violations(df, dims), "dim_table", "dim_id", "reason") == [("a", 2, "missing id"), ("bad", 1, "unknown table")]
    assert integrity.checked(df.where("dim_table = 'a' and dim_id = 1"), dims).count() == 1
    with pytest.raises(Exception, match="no row for"):
        integrity.checked(df, dims).collect()


def test_cascade_delete(spark):
    videos = spark.createDataFrame([(1, 10), (2, 20)], "product int, video int")
    comments = spark.createDataFrame([(10, 1), (20, 2)], "video_id int, comment int")
    left, kept = integrity.cascade_delete(videos, comments, spark.createDataFrame([(1,)], "product int"), "product", "video", "video_id")
    assert rows(left, "video") == [(20,)] and rows(kept, "comment") == [(2,)]


def test_sessions_at_the_limit(spark):
    df = spark.sql("select 1 u, i, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s) ts from values (0, 0), (1, 1800), (2, 3599) t(i, s)")
    found = sessions.session_threads(df, "u", "ts", "i").orderBy("i").collect()
    assert [r["thread"] for r in found] == [1, 2, 2]


def test_history(spark):
    data = [(1, 0, "user"), (1, 1, "assistant"), (1, 2, "user"), (1, 3, "assistant"), (2, 0, "assistant")]
    df = spark.createDataFrame(data, "c int, t int, role string")
    assert rows(sessions.trimmed_history(df, "c", "t", "role", F.lit(1), 3), "c", "t") == [(1, 2), (1, 3)]
    assert rows(sessions.last_turn(df, "c", "t", "role"), "c", "t") == [(1, 2), (1, 3), (2, 0)]


def test_chunks():
    text = "one two three. four five six seven eight nine ten. eleven"
    found = chunking.split_recursively(text, lambda t: len(t.split()), size=4, overlap=1)
    assert all(len(c.split()) <= 4 for c in found)
    assert set(" ".join(found).replace(".", " ").split()) == set(text.replace(".", " ").split())
    assert chunking.hard_limit(" ".join(map(str, range(300))), str.split, " ".join).split() == [str(i) for i in range(254)]


def test_chunk_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, ""), (3, None), (4, "a b")], "k int, t string")
    found = rows(chunking.window_chunks(df, "k", "t", 10, 2), "k", "chunk_index", "chunk_text")
    assert [(k, i) for k, i, _ in found] == [(1, 0), (1, 1), (1, 2), (4, 0)]
    assert found[1][2].split()[0] == "8" and found[2][2].split() == [str(i) for i in range(16, 25)]
    assert chunking.recursive_chunks(df, "k", "t").where("k = 4").first()["chunk_text"] == "a b"


def test_links_last_wins(spark):
    records = spark.createDataFrame([("u",), ("w",)], "url string")
    links = spark.createDataFrame([("u", 1, 5), ("u", 2, 7)], "url string, ord int, price int")
    assert rows(catalog.enrich(records, links, "url", ["ord"], ["price"]), "url", "price") == [("u", 7), ("w", None)]


def test_skip_existing_is_case_sensitive(spark):
    records = spark.createDataFrame([(1, "A"), (2, "A"), (3, "a"), (4, " "), (5, None), (6, "B")], "ord int, name string")
    loaded = spark.createDataFrame([("B",)], "name string")
    assert rows(catalog.skip_existing(records, loaded, "name", "ord"), "ord") == [(1,), (3,)]


def test_star_tables(spark):
    raw = spark.createDataFrame([("u", "P", {"Chipset": " X ", "RAM": " ", "GPU": "g"}), ("v", None, {})], "url string, name string, raw map<string,string>")
    records = catalog.spec_records(raw.withColumn("pn", F.lit("")), "raw", "url", "pn", "name")
    assert records.count() == 1 and records.first()["fact_product"]["product_name"] == "P"
    numbered = catalog.star_load(records.withColumn("ord", F.lit(1)), "ord")
    tables = catalog.dim_tables(numbered)
    assert len(tables) == 8
    made = tables["dim_performance"].first()
    assert (made["dim_id"], made["chipset"], made["ram_capacity"], made["gpu_chip"]) == (1, "X", None, "g")


def test_top_up_plan(spark):
    products = spark.createDataFrame([(1, "b", 1), (2, "a", 2), (3, "n", 3), (4, "m", 4)], "pid int, name string, ord int")
    videos = spark.createDataFrame([(1,), (1,), (2,)], "pid int")
    completed = spark.createDataFrame([("a",), ("b",)], "name string")
    plan = media.top_up_plan(products, videos, completed, "pid", "name", "ord", 2).orderBy("place").collect()
    assert [(r["name"], r["phase"], r["place"]) for r in plan] == [("a", "top-up", 1), ("n", "fresh", 2), ("m", "fresh", 3)]


def test_comment_source(spark):
    df = spark.sql("select 1 k, array(named_struct('text', ' a ', 'author', ' '), named_struct('text', '', 'author', 'x'), named_struct('text', null, 'author', 'x')) comments")
    assert rows(media.comments_of_info(df, ["k"]), "comment_text", "user_name") == [("a", None)]


def test_crawl_stops_without_news(spark):
    data = [("s", 1, "u1"), ("s", 2, "u1"), ("s", 3, "u3"), ("t", 1, "u1"), ("t", 3, "u9")]
    pages = spark.createDataFrame(data, "slug string, page int, url string")
    assert rows(catalog.crawl_pages(pages, "slug", "page", "url"), "slug", "page", "url") == [("s", 1, "u1"), ("t", 1, "u1")]


def test_names(spark):
    products = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "product_id int, product_name string")
    assert rows(catalog.ids_by_name(products, ["x"]), "product_name", "product_id") == [("x", 2)]
    assert catalog.ids_by_name(products, []).count() == 0
    unknown = spark.createDataFrame([(9,)], "product_id int")
    assert catalog.names_by_id(unknown, products).first()["product_name"].endswith("(id=9)")


def test_sequential_ids_with_nulls_ties_and_few_slices(spark):
    from aspectra.operators.dedup import sequential_ids

    rows = [(None if i % 3 == 0 else i % 50, chr(97 + i % 7) if i % 5 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b string, _slice long").repartition(5)
    for order in ("a", ["b", "a"], ["a", "b", "_slice"]):
        for slices in (1, 2, 17, None):
            plain = sequential_ids(df.withColumnRenamed("_slice", "row") if order != ["a", "b", "_slice"] else df.withColumnRenamed("_slice", "c"), [o if o != "_slice" else "c" for o in ([order] if isinstance(order, str) else order)], "n", slices)
            found = sorted(plain.collect(), key=lambda r: r["n"])
            assert [r["n"] for r in found] == list(range(1, 401))
            names = [o if o != "_slice" else "c" for o in ([order] if isinstance(order, str) else order)]
            keys = [tuple((r[o] is not None, r[o] if r[o] is not None else 0) if o != "b" else (r[o] is not None, r[o] or "") for o in names) for r in found]
            assert keys == sorted(keys)
    again = sequential_ids(df.repartition(3).withColumnRenamed("_slice", "c"), "a", "n").collect()
    assert set(again) == set(sequential_ids(df.withColumnRenamed("_slice", "c"), "a", "n").collect())
    assert sequential_ids(df.limit(0).withColumnRenamed("_slice", "c"), "a", "n").count() == 0


def test_numbering_runs_in_no_single_task_over_rows(spark, small):
    """Only summaries, a row per slice, meet in one partition."""
    import re

    from aspectra.plans.queries import QUERIES

    for name in ("topup_plan", "surrogate_star_load"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        whole = [line for line in plan.splitlines() if re.search(r"Window \[", line) and re.search(r"\], \[_slice", line) is None]
        assert all("_slice" in line for line in whole), whole


def test_codec_and_segmenter(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from aspectra.operators.chunking import recursive_chunks
    from aspectra.plans.providers import compound_segmenter, vocabulary_codec

    encode, decode = vocabulary_codec(public_tokenizers.path("byte_bpe_50k.json"))
    assert decode(encode("a phone, good")) == "a phone, good"
    segment = compound_segmenter(["màn hình", "pin", "thời lượng pin", "hình"])
    assert segment("Màn hình đẹp, thời lượng pin tốt") == "Màn_hình đẹp, thời_lượng_pin tốt"
    assert compound_segmenter([])("a b") == "a b"
    df = spark.createDataFrame([(1, "màn hình " * 200 + "end. " * 30), (2, None), (3, " ")], "k long, t string")
    chunks = recursive_chunks(df, "k", "t", encode, decode, segment).orderBy("k", "chunk_index").collect()
    assert {r["k"] for r in chunks} == {1} and [r["chunk_index"] for r in chunks] == list(range(len(chunks)))
    assert all(len(encode(r["chunk_text"])) <= 160 for r in chunks) and "màn_hình" in chunks[0]["chunk_text"]


def test_comments_meet_their_products(spark):
    from aspectra.operators import reviews

    comments = spark.createDataFrame([(1, 10, "good camera"), (2, 11, "camera"), (3, 12, "pin"), (4, 99, "camera")], "comment_id long, video_id long, comment_text string")
    videos = spark.createDataFrame([(10, 5, "u"), (11, 5, "v"), (12, None, "w")], "video_id long, product_id long, youtube_url string")
    tagged = reviews.with_product(reviews.tag(comments, "comment_text"), videos)
    rolled = reviews.roll_up(tagged, "product_id", "comment_id", "comment_text").collect()
    assert [(r["product_id"], r["aspect"], r["total"], r["comments"]) for r in rolled] == [(5, "camera", 2, ["good camera", "camera"])]


@pytest.mark.parametrize("alike", [False, True])
def test_a_key_of_many_rows_has_many_slices(spark, monkeypatch, alike):
    """300,000 rows of one order value, or alike in all columns, are numbered by more than one task."""
    from aspectra.operators import dedup

    df = spark.range(300_000).select(F.lit(7).alias("o"), (F.lit(0) if alike else F.col("id")).alias("x"))
    numbered = dedup.sequential_ids(df, "o", "n", slices=8)
    assert numbered.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 300_000, 300_000)
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") >= 1  # there are cuts
    sizes = numbered.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) <= 200_000
