"""Text rules on hand-made inputs."""

from pyspark.sql import functions as F

from hazardlake.functions import lexicons as L
from hazardlake.functions import seriousness as Z
from hazardlake.functions import text as X
from hazardlake.functions.let import let
from hazardlake.operators import feed
from hazardlake.sources import pages as P
from hazardlake.sources.posts import append_jsonl, read_posts

CASES = [
    ("serious", "Warning issued: tsunami alert for the coast, evacuation begins",
     "The government confirms that rescue teams work through the emergency. Live coverage follows.",
     "City News", "A channel with breaking news", ["Stay safe", "The rescue goes on", "Authorities ask for evacuation"], True),
    ("comedy", "Funny flood prank, a hilarious reaction", "lol, this is just for fun, pure entertainment. Don't take seriously!",
     "Prank Show", "Comedy and nothing else", ["haha so funny", "great prank", "rofl, hilarious"], False),
    ("coastal", "Storm surge hits the harbour", "Coastal flooding reaches the old town; emergency teams are out.",
     "Weather Office", "Official weather channel", ["The storm surge is rising", "Emergency services at work"], True),
]


def test_labelled_cases(spark):
    rec = spark.createDataFrame([c[:5] for c in CASES], "id string, title string, description string, ctitle string, cdesc string")
    com = spark.createDataFrame([(c[0], i, t) for c in CASES for i, t in enumerate(c[5])], "id string, turn int, ctext string")
    out = Z.score_threads(rec, com, "id", ["title", "description", "ctitle", "cdesc"], "ctext", ["turn"])
    got = {r["id"]: r["verdict"]["is_serious"] for r in out.collect()}
    assert got == {c[0]: c[6] for c in CASES}


def _score(h, s, c):
    c2, s2 = 2 * c, s + 2 * c
    if h + s2 + c2 == 0:
        serious, conf = True, 0.5
    else:
        w = s2 + 1.5 * c2
        conf = w / (h + w)
        serious = conf > 0.6 or (c2 > 0 and h < s2)
    if h > s2 + c2 + 2:
        serious, conf = False, 1 - conf
    return serious, round(conf, 9)


def test_verdict_rule(spark):
    hits = [(h, s, c) for h in range(7) for s in range(4) for c in range(3)]
    df = spark.createDataFrame(hits, "h int, s int, c int").select("h", "s", "c", Z.verdict(F.col("h"), F.col("s"), F.col("c")).alias("v"))
    for r in df.collect():
        assert (r["v"]["is_serious"], round(r["v"]["confidence"], 9)) == _score(r["h"], r["s"], r["c"])


def test_entry_listed_twice_counts_twice(spark):
    df = spark.createDataFrame([("a spoof, a joke",)], "t string")
    n = let(F.lower("t"), lambda low: X.lexicon_count(low, X.tokens_of(low), L.HUMOUR))
    assert df.select(n).first()[0] == 3


def test_words_end_at_letters_of_any_script(spark):
    df = spark.createDataFrame([("élan #ñandú #ab_1 @Zoë2 live-blog alive",)], "t string")
    hits = let(F.lower("t"), lambda low: X.lexicon_hits(low, X.tokens_of(low), ["live", "lan", "blog", "live blog"]))
    r = df.select(X.hashtags(F.col("t")), X.mentions(F.col("t")), hits).first()
    assert r[0] == ["#ab_1", "#ñandú"] and r[1] == ["@Zoë2"] and r[2] == ["live", "blog"]


def test_places_grouped_by_letter_match_like_the_list(spark):
    import re

    text = "navi mumbai, mumbai and goan goa; west bengal - Uttar Pradesh uttarakhand tamil nadu, kota kotah"
    want = [m.lower() for m in re.findall(r"\b(?:" + "|".join(L.PLACES) + r")\b", text, re.IGNORECASE)]
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.place_mentions(F.lower("t"))).first()[0] == want


def test_tags(spark):
    df = spark.createDataFrame([("Flood alert #Flood in Mumbai", "Heavy rain with damage, see #rain", ["NEWS", "flood"])],
                               "t string, d string, g array<string>")
    t = df.select(X.comprehensive_tags(F.col("t"), F.col("d"), F.col("g")).alias("x")).first()["x"]
    assert t["hashtags"] == ["#flood", "#rain"]
    assert t["disaster_keywords"] == ["alert", "damage", "flood", "heavy", "mumbai", "rain"]
    assert t["location_mentions"] == ["mumbai"] and t["youtube_tags"] == ["flood", "news"]
    assert t["total_tag_count"] == len(t["unified_tags"]) == len(set(t["unified_tags"]))


def test_verdict_texts(spark):
    raw = [('{"is_genuine": true, "verification_score": 0.8}', True, 0.8, None),
           ('Here: {"is_genuine": false, "reasoning": "x {y}"} end', False, 0.0, None),
           ("nothing", False, 0.0, "Invalid response format"), ('{"is_genuine": tr}', False, None, "broken JSON"), ("}{", False, 0.0, "Invalid response format")]
    df = spark.createDataFrame([(r[0],) for r in raw], "raw string").select(X.parse_verdict(F.col("raw")).alias("v"))
    for got, want in zip(df.collect(), raw):
        assert (got["v"]["is_genuine"], got["v"]["verification_score"], got["v"]["error"]) == want[1:]


def test_urls_and_truncation(spark):
    df = spark.createDataFrame([("see http://a.example/x?y=1&z=%20 and https://b.example, end", "y" * 130)], "t string, long string")
    r = df.select(X.urls(F.col("t")), X.ellipsis(F.col("long")), X.snippet(F.lit(""), F.col("long"))).first()
    assert r[0] == ["http://a.example/x?y=1&z=%20", "https://b.example,"]
    assert r[1] == "y" * 100 + "..." and r[2] == "y" * 120


def test_feed_items(spark):
    xml = ("<rss><item><title>Flood &amp; storm</title><description><b>Rain</b> falls</description><link>http://a</link></item>"
           "<entry><title>Second</title><summary>Dry</summary><guid>g2</guid></entry></rss>")
    rows = P.extract_items(spark.createDataFrame([(1, xml)], "id int, x string"), "id", "x", 20).orderBy("pos").collect()
    assert [(r["title"], r["content"], r["link"]) for r in rows] == [("Flood & storm", "Rain falls", "http://a"), ("Second", "Dry", "g2")]


def test_post_log_keeps_bad_lines_and_types_comments(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "a.json").write_text('{"id": "1", "platform": "facebook", "comments": 7}\n'
                                 '{"id": "2", "platform": "youtube", "comments": [{"user": "u", "text": "t", "likes": 3}]}\n{broken\n')
    got = {r["id"]: r for r in read_posts(spark, str(path)).collect()}
    assert got["1"]["comment_count"] == 7 and got["1"]["comment_list"] is None
    assert got["2"]["comment_list"][0]["likes"] == 3 and got[None]["_corrupt_record"] == "{broken"


def test_seen_ids(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert feed.drop_seen(ids, ids.limit(0)).count() == 3
    assert feed.drop_seen(ids, ids).count() == 0


def test_unreadable_time_is_kept(spark):
    df = spark.createDataFrame([("2024-01-30T00:00:00Z",), ("2024-01-01T00:00:00Z",), (None,), ("soon",)], "t string")
    now = F.lit("2024-01-31").cast("timestamp")
    assert [r[0] for r in df.select(feed.recent(F.col("t"), now)).collect()] == [True, False, True, True]


def test_append_writes_nulls(spark, tmp_path):
    append_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "x"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "x").glob("*.json"))
