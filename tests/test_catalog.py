import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from basketry.functions import scalars
from basketry.operators import catalog, coldstart, ids, profiles, ranking
from basketry.plans import catalog_queries
from basketry.sources import catalog_files, checks
from basketry.sources import profiles as profile_files


def test_image_lists_in_every_spelling(spark):
    texts = [
        '["https://x/1.jpg", "https://x/2.jpg"]',
        "['https://x/1.jpg'\n 'https://x/2.jpg']",
        "[]", "", None, "https://x/1.jpg",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        scalars.parse_image_list(F.col("t")).alias("urls")).collect()
    pair = ["https://x/1.jpg", "https://x/2.jpg"]
    assert [r["urls"] for r in rows] == [pair, pair, [], None, None, pair[:1]]


def test_picture_and_labels(spark):
    rows = spark.createDataFrame(
        [(["https://x/1"], "Books", 3.9, "t" * 101), (["ftp://x"], "Books", 4.0, "t" * 100),
         ([], "Nowhere", 5.0, "t"), (None, None, 0.5, None)],
        "urls array<string>, category string, rating double, title string").select(
        scalars.image_or_icon(F.col("urls"), F.col("category")).alias("p"),
        scalars.stars(F.col("rating")).alias("s"), scalars.shorten(F.col("title"), 100).alias("t")).collect()
    assert [r["p"] for r in rows] == ["https://x/1", "📚", "📦", "📦"]
    assert [len(r["s"]) for r in rows] == [3, 4, 5, 0]
    assert rows[0]["t"] == "t" * 100 + "..." and rows[1]["t"] == "t" * 100


def test_explanations(spark):
    rows = spark.createDataFrame([
        ("Books", 0.8, "Books", 20.0, 4.25, 11.0), ("Books", 0.2, "Toys", 250.0, 4.0, 10.0),
        (None, None, "Toys", 20.0, None, None)],
        "fav string, sens double, cat string, price double, rating double, pop double")
    texts = [r[0] for r in rows.select(scalars.explain_recommendation(
        *[F.col(c) for c in ("fav", "sens", "cat", "price", "rating", "pop")])).collect()]
    assert texts[0].startswith("Matches your interest in Books | Good value for money | Highly rated (4.")
    assert texts[0].endswith("Popular among customers")
    assert texts[1:] == ["Premium quality product", "Recommended based on your preferences"]


def test_result_key_matches_the_json_hash(spark):
    import hashlib

    key = spark.range(1).select(scalars.result_key("recs", F.lit("u1"), {"model": F.lit("hy\"b")})).first()[0]
    text = json.dumps({"model": 'hy"b'}, sort_keys=True)
    assert key == "recs:u1:" + hashlib.md5(text.encode()).hexdigest()[:8]
    assert spark.range(1).select(scalars.plain_key("p", F.lit(1), b=2, a="x")).first()[0] == "p:1:a=x:b=2"


def test_search_is_literal(spark):
    items = spark.createDataFrame(
        [("1", "C++ (2nd ed.)", None, "Acme", "Books", 10.0), ("2", "Cpp", "about c", None, "Books", 20.0),
         ("3", None, None, None, "C++", 5.0)],
        "item_id string, title string, description string, brand string, category string, price double")
    columns = ["title", "description", "brand", "category"]

    def found(query, **filters):
        return sorted(r["item_id"] for r in catalog.search(items, query, columns, **filters).collect())

    assert found(" c++ ") == ["1", "3"]
    assert found("(2nd") == ["1"]
    assert found(".*") == []
    assert found("c", min_price=10, max_price=10) == ["1"]
    assert found("c", brand="Acme", category="Books") == ["1"]
    page = catalog.search_page(catalog.search(items, "c", columns), size=2).collect()
    assert len(page) == 2 and {r["total_count"] for r in page} == {3}


def test_samples_repeat_and_prefer_images(spark):
    items = spark.createDataFrame(
        [(i, ["http://x"] if i % 3 == 0 else []) for i in range(30)], "item_id int, valid_image_urls array<string>")
    first = [r["item_id"] for r in ranking.sample_with_images_first(items, 12, seed=1).collect()]
    assert sum(i % 3 == 0 for i in first) == 10
    assert first == [r["item_id"] for r in ranking.sample_with_images_first(items, 12, seed=1).collect()]
    assert first != [r["item_id"] for r in ranking.sample_with_images_first(items, 12, seed=2).collect()]


def test_index_is_dense_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(13)
    rows = ids.with_contiguous_index(df, ["k"], "i").collect()
    assert sorted((r["k"], r["i"]) for r in rows) == [(i, i) for i in range(1000)]


def test_category_files(spark, tmp_path):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")

    save("products_Video_Games_cleaned.parquet", [("a1", "Game", "[]", ["fun", "game"])],
         "asin string, product_title string, valid_image_urls string, description array<string>")
    save("products_Software_cleaned.parquet", [("Tool", "Acme", 9.5), ("App", "Acme", 1.0)],
         "name string, brand string, price double")
    loaded = catalog_files.load_products(spark, [
        f"{tmp_path}/products_{c}_cleaned.parquet" for c in ("Video_Games", "Software", "Missing")])
    rows = {r["item_id"]: r for r in loaded.collect()}
    assert set(rows) == {"a1", "Software_0", "Software_1"}
    assert rows["a1"]["title"] == "Game" and rows["a1"]["brand"] == "Unknown" and rows["a1"]["price"] == 0.0
    assert rows["a1"]["description"] == "fun game"
    assert rows["Software_0"]["title"] == "App" and rows["Software_0"]["category"] == "Software"
    with pytest.raises(FileNotFoundError):
        catalog_files.load_products(spark, [f"{tmp_path}/products_Missing_cleaned.parquet"])

    save("reviews_Software_cleaned.parquet", [("x", 4.0, "r1")], "product_id string, star_rating double, reviewerID string")
    review = catalog_files.load_reviews(spark, [f"{tmp_path}/reviews_Software_cleaned.parquet"]).first()
    assert (review["asin"], review["overall"], review["category"]) == ("x", 4.0, "Software")


def test_checks(spark):
    items = spark.createDataFrame(
        [(1, ["https://x"]), (2, ["x"]), (3, [""]), (4, []), (5, None)], "id int, valid_image_urls array<string>")
    row = checks.image_coverage(items).first()
    assert tuple(row) == (5, 3, 2, 2, 1)
    shape = {r["column_name"]: r for r in checks.table_shape(items).collect()}
    assert shape["valid_image_urls"]["filled_count"] == 4 and shape["id"]["row_count"] == 5


def test_profile_documents(spark, tmp_path):
    good = {"user_preferences": {"email": "a@x", "favorite_categories": ["Books"]},
            "wishlist": [{"item_id": "1", "category": "Books", "price": 2.0}], "rec_seed": 7}
    (tmp_path / "ann.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bob.json").write_text(json.dumps({"user_preferences": {}, "wishlist": []}))
    (tmp_path / "broken.json").write_text("{not json")
    loaded = {r["user_id"]: r for r in profile_files.load_profiles(spark, str(tmp_path)).collect()}
    assert set(loaded) == {"ann", "bob"}
    assert loaded["bob"]["rec_seed"] == 42 and loaded["bob"]["cart"] == []
    assert [r["user_id"] for r in profile_files.load_profiles(spark, str(tmp_path), "ann").collect()] == ["ann"]
    profile_files.save_profiles(profile_files.load_profiles(spark, str(tmp_path)), f"{tmp_path}/saved")
    again = {r["user_id"]: r for r in profile_files.load_saved_profiles(spark, f"{tmp_path}/saved").collect()}
    assert again["ann"]["wishlist"][0]["price"] == 2.0 and again["ann"]["user_preferences"]["email"] == "a@x"


def test_profile_files_of_odd_users(spark, tmp_path):
    """One file per user in a bounded number of folders; names come back as they were, broken and unfinished files are passed over."""
    users = ["1", "a/b", "..", "50%", "%", "é +", "", None, "cut", "empty"]
    text = json.dumps({"wishlist": [{"item_id": "1", "title": "é\nx"}]})
    rows = [(u, {"cut": text[:30], "empty": ""}.get(u, text)) for u in users]
    documents = spark.createDataFrame(rows, "user_id string, value string")
    for _ in range(2):  # a second run replaces the files
        assert profile_files.save_profile_files(documents, f"{tmp_path}/files") == len(users)
    names = [f for _, _, files in os.walk(tmp_path / "files") for f in files]
    assert len(names) == len(set(names)) == len(users) and all(n.endswith(".json") for n in names)
    part = next(os.scandir(tmp_path / "files")).path
    with open(f"{part}/1.json.part", "w") as f:
        f.write(text)
    loaded = profile_files.load_profile_files(spark, f"{tmp_path}/files").collect()
    assert sorted(r.user_id or repr(r.user_id) for r in loaded) == sorted(u or repr(u) for u in users[:8])
    assert all(r.wishlist[0].title == "é\nx" and r.cart == [] and r.rec_seed == 42 for r in loaded)


def test_a_file_per_user_makes_no_folder_per_user(spark, tmp_path):
    documents = spark.range(1000).select(F.col("id").alias("user_id"), F.lit("{}").alias("value"))
    profile_files.save_profile_files(documents, f"{tmp_path}/files")
    folders = list(os.walk(tmp_path / "files"))
    assert sum(len(files) for *_, files in folders) == 1000 and len(folders) <= profile_files.FOLDERS + 1
    assert profile_files.load_profile_files(spark, f"{tmp_path}/files").count() == 1000


ENTRY = "user_id string, kind string, item_id string, category string, price double, added_at timestamp_ntz"


@pytest.fixture(scope="module")
def entries(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    return spark.createDataFrame([
        ("a", "purchase", "1", "Books", 10.0, t), ("a", "wishlist", "2", "Toys", 5.0, t),
        ("a", "wishlist", "3", "Gone", 5.0, t), ("b", "wishlist", "1", "Books", 10.0, t),
        ("c", "cart", "1", "Books", 10.0, t)], ENTRY)


def test_profile_totals(spark, entries):
    users = spark.createDataFrame([("a", "a@x", None), ("b", None, "2024"), ("c", None, None), ("d", None, None)],
                                  "user_id string, email string, registered string")
    total = profiles.activity_totals(users, entries).first()
    assert tuple(total) == (4, 2, 1, 3, 1, 10.0)
    rows = {r["user_id"]: r for r in profiles.user_detail_rows(users, entries).collect()}
    assert rows["d"]["email"] == "N/A" and rows["d"]["cart_items"] == 0 and rows["a"]["wishlist_items"] == 2


def test_target_categories(spark, entries):
    users = spark.createDataFrame([(u,) for u in "abcde"], "user_id string")
    named = spark.createDataFrame([("c", "Toys"), ("c", "Gone"), ("d", "Gone")], "user_id string, category string")
    items = spark.createDataFrame([("Books",), ("Toys",)], "category string")
    rows = {r["user_id"]: (r["categories"], r["source"])
            for r in profiles.target_categories(users, entries, named, items).collect()}
    assert rows == {
        "a": (["Books", "Toys"], "purchase history"), "b": (["Books"], "wishlist"),
        "c": (["Toys"], "registration preferences"), "d": ([], "general"), "e": ([], "general")}


def test_new_entries(spark):
    fields = "user_id string, asin string, title string, price double"
    held = spark.createDataFrame([("u", "a", "T", 1.0), ("u", None, "Plain", 5.0)], fields)
    wanted = spark.createDataFrame([
        ("u", "a", "T", 1.0), ("u", "b", "T", 1.0), ("u", "b", "T", 1.0), ("v", "a", "T", 1.0),
        ("u", None, "Plain", 5.005), ("u", None, "Plain", 5.02), ("u", None, "Other", 5.0),
        ("w", None, "Near", 10.0), ("w", None, "Near", 10.005), ("w", None, "Near", 10.011), ("w", "c", "Y", 3.0),
        ("w", "c", "X", 2.0), ("w", None, "Free", None), ("w", None, "Free", None)], fields)
    got = sorted((r["user_id"], r["asin"] or "", r["title"], r["price"])
                 for r in profiles.new_entries(wanted, held).collect())
    assert got == [("u", "", "Other", 5.0), ("u", "", "Plain", 5.02), ("u", "b", "T", 1.0), ("v", "a", "T", 1.0),
                   ("w", "", "Free", None), ("w", "", "Near", 10.0), ("w", "", "Near", 10.011), ("w", "c", "X", 2.0)]


def test_cold_start_against_brute_force(spark):
    import random

    pick = random.Random(3)
    items = [(f"i{i:03d}", pick.choice(["A", "B", None]), pick.choice(["x", "y", "z"]),
              50.0 if i % 3 == 0 else float(pick.randrange(100)), float(pick.randrange(1, 6)), pick.randrange(5))
             for i in range(300)]
    people = []
    for i in range(60):
        low = pick.choice([None, float(pick.randrange(100)), 50.0])
        high = pick.choice([None, float(pick.randrange(100)), 50.0])
        people.append((f"u{i}", pick.sample(["A", "B", "C"], pick.randrange(3)),
                       pick.sample(["x", "y"], pick.randrange(3)), low, high))
    catalog_rows = spark.createDataFrame(
        items, "item_id string, category string, brand string, price double, rating double, review_count int")
    profiles_rows = spark.createDataFrame(
        people, "user_id string, categories array<string>, brands array<string>, min_price double, max_price double")
    for edges in (4, 64):
        found = coldstart.cold_start_recommendations(profiles_rows, catalog_rows, 7, price_edges=edges).collect()
        got = {}
        for r in sorted(found, key=lambda r: r["rank"]):
            got.setdefault(r["user_id"], []).append((r["item_id"], round(r["score"], 9)))
        for user, cats, brands, low, high in people:
            fit = [it for it in items if (not cats or it[1] in cats) and (not brands or it[2] in brands)
                   and (low is None or it[3] >= low) and (high is None or it[3] <= high)]
            fit.sort(key=lambda it: (-it[4], -it[5], it[0]))
            expected = [(it[0], round(min(it[4] * 0.5 + (0.3 if it[1] in cats else 0)
                                          + (0.2 if it[2] in brands else 0), 5.0), 9)) for it in fit[:7]]
            assert got.get(user, []) == expected, user


def test_cold_start_rows_bear_no_preferences(spark):
    """Profiles with the same bands of a shelf meet its nodes once, and no row carries the lists of its profile; equal user ids share a list."""
    catalog = spark.createDataFrame(
        [(i, f"c{i % 2}", f"b{i % 3}", float(i % 50), float(i % 7), i) for i in range(300)],
        "item_id long, category string, brand string, price double, rating double, review_count long")
    rows = [(u, ["c0", "nowhere"], ["b1", "b2"], 5.0, 40.0) for u in range(30)] + [(1, [], None, None, 3.0), (None, ["c1"], [], 9.0, 9.0)]
    asked = spark.createDataFrame(
        rows, "user_id long, categories array<string>, brands array<string>, min_price double, max_price double")
    found = coldstart.cold_start_recommendations(asked, catalog, 4, price_edges=16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "categories" not in plan and "brands" not in plan
    items, expected = catalog.collect(), {}
    for user, categories, brands, low, high in rows:
        for r in items:
            if ((not categories or r.category in categories) and (not brands or r.brand in brands)
                    and (low is None or r.price >= low) and (high is None or r.price <= high)):
                score = r.rating * 0.5 + (0.3 if r.category in categories else 0.0) + (0.2 if r.brand in (brands or []) else 0.0)
                expected.setdefault(user, []).append((-r.rating, -r.review_count, r.item_id, min(score, 5.0)))
    told = sorted((str(r.user_id), r["rank"], r.item_id, r.score) for r in found.collect())
    assert told == sorted((str(u), k + 1, x[2], x[3]) for u, xs in expected.items() for k, x in enumerate(sorted(xs)[:4]))


def test_image_lists_with_apostrophes(spark):
    from basketry.functions.scalars import parse_image_list

    rows = [('["http://x/it\'s.jpg", "http://y/o\'z.jpg"]', ["http://x/it's.jpg", "http://y/o'z.jpg"]),
            ("['a.jpg' 'b.jpg']", ["a.jpg", "b.jpg"]), ("['a.jpg'\n 'b.jpg']", ["a.jpg", "b.jpg"]), ("[]", []),
            ("http://x", ["http://x"]), (" ", None), (None, None)]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").select(
        "i", parse_image_list(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == [r[1] for r in rows]


def test_plus_in_file_names(spark, tmp_path):
    for name in ("a b", "a+b", "a%2Bc"):
        (tmp_path / f"{name}.json").write_text('{"rec_seed": 1}')
    (tmp_path / "bad.json").write_text("{no json")
    got = sorted(r.user_id for r in profile_files.load_profiles(spark, str(tmp_path)).collect())
    assert len(got) == len(set(got)) == 3


def test_category_files_are_made_of_rows_worked_out_once(spark):
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def category(n):
        worked.add(1)
        return ["A", "B", "", None][n % 4]
    rows = spark.range(40).select(F.col("id").alias("asin"), category("id").alias("category"))
    shelf = spark.createDataFrame([("A",), ("B",), ("",), ("C",)], "category string")
    paths = catalog_queries._category_paths(SimpleNamespace(spark=spark, catalog=lambda: shelf), "reviews", rows, {"B": {"asin": "item_id"}})
    assert worked.value == 40
    assert [spark.read.parquet(p).count() for p in paths[:4]] == [10, 10, 10, 0]
    assert spark.read.parquet(paths[2]).columns == ["item_id"]
