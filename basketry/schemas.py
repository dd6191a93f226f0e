"""Declared schemas of the data model."""

from pyspark.sql import types as T

ENTRY = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("asin", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("valid_image_urls", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("purchase_date", T.StringType()),
])

PROFILE = T.StructType([
    T.StructField("user_preferences", T.StructType([
        T.StructField("username", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("favorite_categories", T.ArrayType(T.StringType())),
        T.StructField("registration_date", T.StringType()),
    ])),
    T.StructField("wishlist", T.ArrayType(ENTRY)),
    T.StructField("purchase_history", T.ArrayType(ENTRY)),
    T.StructField("cart", T.ArrayType(ENTRY)),
    T.StructField("rec_seed", T.IntegerType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

USER_FEATURES = [
    "avg_rating", "rating_count", "favorite_category", "price_sensitivity",
    "activity_level", "account_age_days", "last_purchase_days_ago",
]
ITEM_FEATURES = [
    "category", "brand", "price", "avg_rating", "review_count",
    "popularity_score", "availability", "discount_percentage",
]

# Days a feature row stays usable after its event time.
USER_FEATURE_TTL_DAYS = 30
ITEM_FEATURE_TTL_DAYS = 7
