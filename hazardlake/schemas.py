"""Declared schemas of posts, envelopes, reports, catalogues and metric tables."""

from pyspark.sql import types as T


def _s(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


S, L, D, B, I = (T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(),
                 T.IntegerType())
STRINGS = T.ArrayType(S)

YOUTUBE_COMMENT = _s(("user", S), ("text", S), ("likes", L), ("timestamp", S))
REACTIONS = _s(("like", L), ("love", L), ("care", L), ("angry", L), ("sad", L), ("wow", L))

# One wide nullable row for the five platforms. `comments` is a number on two of them and
# an array on the third, so it is read as text and typed by `sources.posts.read_posts`.
POST = _s(
    ("id", S), ("timestamp", S), ("platform", S), ("lang", S), ("hashtags", STRINGS),
    ("user", S), ("text", S), ("image_url", S), ("retweets", L), ("likes", L), ("replies", L),
    ("content", S), ("caption", S), ("images", STRINGS), ("comments", S), ("shares", L),
    ("saves", L), ("story_highlights", B), ("reactions", REACTIONS),
    ("outlet", S), ("author", S), ("reporter", S), ("headline", S), ("article_content", S),
    ("location", S), ("category", S), ("reading_time", S),
    ("channel", S), ("title", S), ("description", S), ("thumbnail_url", S), ("views", L),
    ("dislikes", L), ("duration", S), ("subscribers", L), ("channel_description", S),
    ("channel_type", S),
    ("verified", B), ("follower_count", L), ("bio", S), ("profile_pic", S),
    ("account_type", S), ("_corrupt_record", S),
)

ENVELOPE = _s(("post_data", S), ("timestamp", S), ("platform", S), ("post_type", S))

CASUALTIES = _s(("deaths", L), ("injured", L), ("missing", L), ("rescued", L), ("displaced", L))
REPORT = _s(
    ("id", S), ("title", S), ("description", S), ("disaster_type", S), ("severity", S),
    ("location", _s(("name", S), ("state", S), ("lat", D), ("lng", D))),
    ("verification", _s(("status", S), ("confidence", D), ("source_count", L),
                        ("platforms", STRINGS), ("verified_by", S))),
    ("impact", _s(("affected_area_km2", D), ("estimated_affected_people", L),
                  ("casualties", CASUALTIES), ("infrastructure_damage", STRINGS),
                  ("economic_loss_crore", D))),
    ("sources", T.ArrayType(_s(("platform", S), ("post_id", S), ("snippet", S),
                               ("author", S), ("timestamp", S)))),
    ("timeline", T.ArrayType(_s(("timestamp", S), ("event", S)))),
    ("response_actions", STRINGS), ("created_at", S), ("updated_at", S),
)

MANIFEST = _s(("s1", S), ("label", S))
MANIFEST_TRIPLE = _s(("pre", S), ("post", S), ("label", S))

METRICS = _s(
    ("event_id", S), ("tile_id", S), ("accuracy", S), ("precision", S), ("recall", S),
    ("f1", S), ("iou", S), ("tp", S), ("fp", S), ("fn", S), ("tn", S), ("n_pred", S),
    ("n_gt", S), ("pred_km2", S), ("gt_km2", S), ("time_s", S),
)

SEARCH_RESPONSE = _s(
    ("data", T.ArrayType(_s(("id", S), ("author_id", S), ("text", S), ("created_at", S),
                            ("lang", S), ("geo", _s(("place_id", S)))))),
    ("includes", _s(("users", T.ArrayType(_s(("id", S), ("username", S)))),
                    ("places", T.ArrayType(_s(("id", S), ("name", S)))))),
)

EVENT_TILE = _s(("event", S), ("tile_id", S), ("source_split", S), ("mgrs", S),
                ("year", I), ("doy", I))
