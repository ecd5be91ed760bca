"""Registered queries over document, comment and page texts (whole texts)."""

from pyspark.sql import functions as F

from hazardlake.functions import seriousness as Z
from hazardlake.functions import text as X
from hazardlake.functions.let import let
from hazardlake.operators import feed as O
from hazardlake.plans import fixtures as A
from hazardlake.plans.common import iso, joined, r, sql_iso
from hazardlake.registry import query
from hazardlake.sources import pages as P
from hazardlake.sources.posts import decode_envelope

# lexicons made of words that occur in the given prose
HUMOUR = ["that", "und", "with", "haha", "that", "of the"]
SERIOUS = ["the", "and", "der", "que", "in the"]
COASTAL = ["tion", "sh", "le"]
PLACES = ["de la", "la", "the of", "und", "is"]
STOP = ["with", "that", "from", "this"]
LEVELS = {"high": ["haha", "enst"], "medium": ["that", "und"], "low": ["the", "la", "de la"]}

W = r"\p{L}\p{N}_"


def _hit(text, term):
    """Whole-word test without lookaround."""
    return f"regexp_matches({text}, '(?i)(^|[^{W}]){term}($|[^{W}])')::int"


def _sum(text, terms):
    return "(" + " + ".join(_hit(text, t) for t in terms) + ")"


def _list(text, terms):
    cases = ", ".join(f"case when {_hit(text, t)} = 1 then '{t}' end" for t in dict.fromkeys(terms))
    return f"list_filter([{cases}], lambda x: x is not null)"


def _docs(spark, sf):
    return A.table(spark, sf, "documents")


TAGGED = r"regexp_replace(text, '([A-Z])', '#\1', 'g')"


def _tagged():
    return F.regexp_replace("text", "([A-Z])", "#$1")


@query("hashtags_mentions", "X-1",
       rf""", t as (select doc_id, {TAGGED} as t from documents)
       select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '#[{W}]+'))), '|') as hashtags,
       len(regexp_extract_all(t, '#[{W}]+')) as n_tags,
       array_to_string(list_sort(list_distinct(regexp_extract_all(t, '@[{W}]+'))), '|') as mentions from t""")
def _(spark, sf):
    d = _docs(spark, sf).select("doc_id", _tagged().alias("t"))
    t = F.col("t")
    return d.select("doc_id", joined(X.hashtags(t)).alias("hashtags"), F.size(X.hashtags_lower(t)).cast("bigint").alias("n_tags"),
                    joined(X.mentions(t)).alias("mentions"))


@query("page_urls", "X-2",
       r"""select page_id, array_to_string(regexp_extract_all(url || ' ' || replace(html, 'href="/', 'href="https://site.example/'),
       'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+'), '|') as urls from pages""")
def _(spark, sf):
    p = A.table(spark, sf, "pages")
    t = F.concat(F.col("url"), F.lit(" "), F.replace(F.col("html"), F.lit('href="/'), F.lit('href="https://site.example/')))
    return p.select("page_id", joined(X.urls(t)).alias("urls"))


@query("lexicon_hits", "X-3", f"select doc_id, array_to_string({_list('text', SERIOUS + COASTAL)}, '|') as hits from documents")
def _(spark, sf):
    hits = let(F.lower("text"), lambda low: X.lexicon_hits(low, X.tokens_of(low), SERIOUS + COASTAL))
    return _docs(spark, sf).select("doc_id", joined(hits).alias("hits"))


# RE2 has no Unicode word boundary: all but ASCII letters of a word become 'x', lengths kept
ASCII = r"regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')"


@query("place_mentions", "X-4",
       rf"""select doc_id, lower(array_to_string(regexp_extract_all({ASCII}, '(?i)\b(?:{"|".join(PLACES)})\b'), '|')) as places from documents""")
def _(spark, sf):
    t = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return _docs(spark, sf).select("doc_id", joined(X.place_mentions(F.lower(t), PLACES)).alias("places"))


@query("content_words", "X-5",
       rf""", w as (select doc_id, list_filter(regexp_extract_all(lower({ASCII}), '\b[a-z]{{4,}}\b'),
         lambda x: x not in ({", ".join(f"'{s}'" for s in STOP)})) as w from documents)
       select doc_id, len(w) as n, array_to_string(list_sort(list_distinct(w[1:20])), '|') as first_words from w""")
def _(spark, sf):
    words = X.content_words(F.lower(F.regexp_replace("text", r"[^\x00-\x7F]", "x")), STOP)
    d = _docs(spark, sf).select("doc_id", words.alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n"),
                    joined(F.array_sort(F.array_distinct(F.slice("w", 1, 20)))).alias("first_words"))


@query("hash_tokens", "X-6",
       rf"""select doc_id, array_to_string(list_filter(regexp_split_to_array({TAGGED}, '\s+'), lambda x: starts_with(x, '#')), '|') as tokens from documents""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", joined(X.hash_tokens(_tagged())).alias("tokens"))


def _score_sql(src, key):
    return f""", hits as (select {key}, {_sum('text', HUMOUR)} as h, {_sum('text', SERIOUS)} as s0, {_sum('text', COASTAL)} as c0 from {src})"""


FINAL = """, sc as (select *, s0 + 2 * c0 as s, 2 * c0 as c, s0 + 2 * c0 + 1.5::double * 2 * c0 as w from tot),
  cf as (select *, case when h + s + c = 0 then 0.5::double else w / (h + w) end as conf, h > s + c + 2 as veto from sc)
  select {key}, h as humour, s as serious, c as coastal,
    ((h + s + c = 0) or conf > 0.6 or (c > 0 and h < s)) and not veto as is_serious,
    round(case when veto then 1 - conf else conf end, 6) as confidence from cf"""


def _verdict(df, key):
    v = F.col("verdict")
    return df.select(key, v["humour"].alias("humour"), v["serious"].alias("serious"), v["coastal"].alias("coastal"),
                     v["is_serious"].alias("is_serious"), r(v["confidence"]).alias("confidence"))


@query("seriousness", "X-7",
       f""", tot as (select doc_id, {_sum('text', HUMOUR)} + {_sum('source', HUMOUR)} as h, {_sum('text', SERIOUS)} + {_sum('source', SERIOUS)} as s0,
       {_sum('text', COASTAL)} + {_sum('source', COASTAL)} as c0 from documents)""" + FINAL.format(key="doc_id"))
def _(spark, sf):
    d = Z.score_texts(_docs(spark, sf), ["source", "text"], humour=HUMOUR, serious=SERIOUS, coastal=COASTAL)
    return _verdict(d, "doc_id")


def _note(label, terms):
    return f"case when {_sum('text', terms)} > 0 then '{label} in text: ' || array_to_string({_list('text', terms)}[1:3], ', ') end"


@query("seriousness_reasons", "X-7",
       f""", t as (select doc_id, {_sum('text', HUMOUR)} as h, {_sum('text', SERIOUS)} + 2 * {_sum('text', COASTAL)} as s, 2 * {_sum('text', COASTAL)} as c,
         {_note('Humor indicators', HUMOUR)} as a, {_note('Serious indicators', SERIOUS)} as b, {_note('Coastal hazard indicators', COASTAL)} as d from documents)
       select doc_id, array_to_string(list_filter([a, b, d,
         case when h + s + c = 0 then 'No clear humor or serious indicators found - defaulting to serious' end,
         case when h > s + c + 2 then 'High humor content detected - marked as non-serious' end], lambda x: x is not null), '|') as reasons from t""")
def _(spark, sf):
    d = Z.score_texts(_docs(spark, sf), ["text"], humour=HUMOUR, serious=SERIOUS, coastal=COASTAL)
    return d.select("doc_id", joined("reasons").alias("reasons"))


@query("seriousness_threads", "X-7",
       f""", x as (select video, turn, row_number() over (partition by video, turn > 0 order by turn) as k, {_sum('text', HUMOUR)} as h,
         {_sum('text', SERIOUS)} as s0, {_sum('text', COASTAL)} as c0 from videos),
       tot as (select video, sum(h)::bigint as h, sum(s0)::bigint as s0, sum(c0)::bigint as c0 from x where turn = 0 or k <= 10 group by video)"""
       + FINAL.format(key="video"), ("videos",))
def _(spark, sf):
    c = A.comments(spark, sf)
    out = Z.score_threads(c.filter("turn = 0").select("video", "text"),
                          c.filter("turn > 0").select("video", "turn", F.col("text").alias("ctext")),
                          "video", ["text"], "ctext", ["turn"], humour=HUMOUR, serious=SERIOUS, coastal=COASTAL)
    return _verdict(out, "video")


@query("keep_serious", "F-10",
       f""", tot as (select doc_id, {_sum('text', HUMOUR)} as h, {_sum('text', SERIOUS)} as s0, {_sum('text', COASTAL)} as c0 from documents)
       select doc_id from (""" + FINAL.format(key="doc_id").replace(", sc as", "with sc as", 1) + ") where is_serious")
def _(spark, sf):
    d = Z.score_texts(_docs(spark, sf), ["text"], humour=HUMOUR, serious=SERIOUS, coastal=COASTAL)
    return O.keep_serious(d).select("doc_id")


FULL = rf"(source || ' ' || regexp_replace({TAGGED}, '[^\x00-\x7F]', 'x', 'g'))"


@query("comprehensive_tags", "X-8 U-4",
       rf""", t as (select doc_id, {FULL} as t, [upper(lang), lang] as given from documents),
       p as (select doc_id, list_transform(regexp_extract_all(t, '#[{W}]+'), lambda x: lower(x)) as tags, {_list('t', SERIOUS)} as kw,
         list_transform(regexp_extract_all(t, '(?i)\b(?:{"|".join(PLACES)})\b'), lambda x: lower(x)) as pl,
         list_transform(given, lambda x: lower(x)) as own,
         list_filter(regexp_extract_all(lower(t), '\b[a-z]{{4,}}\b'), lambda x: x not in ({", ".join(f"'{s}'" for s in STOP)})) as w from t),
       u as (select *, list_sort(list_distinct(tags || kw || pl || own || w[1:10])) as unified from p)
       select doc_id, array_to_string(list_sort(list_distinct(tags)), '|') as hashtags, array_to_string(list_sort(kw), '|') as keywords,
       array_to_string(list_sort(list_distinct(pl)), '|') as places, array_to_string(list_sort(list_distinct(own)), '|') as own,
       array_to_string(list_sort(list_distinct(w[1:20])), '|') as words, array_to_string(unified, '|') as unified,
       len(unified) as n from u""")
def _(spark, sf):
    text = F.regexp_replace(_tagged(), r"[^\x00-\x7F]", "x")
    tags = X.comprehensive_tags(F.col("source"), text, F.array(F.upper("lang"), F.col("lang")), SERIOUS, PLACES, STOP)
    d = _docs(spark, sf).select("doc_id", tags.alias("t"))
    return d.select("doc_id", joined("t.hashtags").alias("hashtags"), joined("t.disaster_keywords").alias("keywords"),
                    joined("t.location_mentions").alias("places"), joined("t.youtube_tags").alias("own"),
                    joined("t.extracted_keywords").alias("words"), joined("t.unified_tags").alias("unified"),
                    F.col("t.total_tag_count").cast("bigint").alias("n"))


@query("snippet_ellipsis", "X-9 X-10",
       """select doc_id, left(coalesce(nullif(case when lang = 'en' then text else '' end, ''), source, ''), 120) as snippet,
       case when length(text) > 100 then left(text, 100) || '...' else text end as short from documents""")
def _(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", X.snippet(F.when(F.col("lang") == "en", F.col("text")).otherwise(F.lit("")), F.col("source")).alias("snippet"),
        X.ellipsis(F.col("text")).alias("short"))


@query("instruction_text", "X-12",
       """select id, md5('Judge the post.' || chr(10) || 'PLATFORM: ' || platform || chr(10) || 'LANGUAGE: ' || lang || chr(10) || 'USER: ' || "user"
       || chr(10) || 'VERIFIED_ACCOUNT: ' || verified::varchar || chr(10) || 'CONTENT: ' || body) as digest from posts""", ("posts",))
def _(spark, sf):
    p = A.posts(spark, sf)
    t = X.instruction("Judge the post.", F.col("platform"), F.col("lang"), F.col("user"), F.col("verified"), F.col("body"))
    return p.select("id", F.md5(t.cast("binary")).alias("digest"))


@query("lexicon_labels", "X-34",
       "select doc_id, case " + " ".join(f"when {_sum('text', ws)} > 0 then '{n}'" for n, ws in LEVELS.items())
       + f" end as level, {_sum('text', ['that', 'und la', 'the'])} > 0 as first_person from documents")
def _(spark, sf):
    def labels(low, tokens):
        return F.struct(X.lexicon_label(low, tokens, LEVELS).alias("level"),
                        (X.lexicon_count(low, tokens, ["that", "und la", "the"]) > 0).alias("first_person"))

    x = let(F.lower("text"), lambda low: let(X.tokens_of(low), lambda tokens: labels(low, tokens)))
    return _docs(spark, sf).select("doc_id", x.alias("x")).select("doc_id", "x.*")


@query("contains_any", "F-3",
       """select doc_id from documents where (contains(lower(text), 'ouheha') or contains(lower(text), 'tionsh') or contains(lower(text), 'ään'))
       and (contains(lower(text), 'der ') or contains(lower(text), 'the '))""")
def _(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).filter(X.contains_any(t, ["ouheha", "tionsh", "ään"]) & X.contains_any(t, ["der ", "the "])).select("doc_id")


@query("text_gate", "F-4", "select doc_id from documents where length(trim(text)) > 50 and (contains(lower(text), 'tionsh') or contains(lower(text), 'quela'))")
def _(spark, sf):
    return _docs(spark, sf).filter(X.text_gate(F.col("text"), 50, ["tionsh", "quela"])).select("doc_id")


@query("coastal_flag", "F-17",
       """select doc_id, contains(k, 'coastal') or contains(k, 'tsunami') or contains(k, 'storm surge') or contains(k, 'tidal') or contains(k, 'ocean')
       or contains(k, 'sea') as coastal from (select doc_id, lower((['Tsunami India', 'Flood India', 'Arabian Sea cyclone'])[doc_id % 3 + 1] || ' ' || text) as k from documents)""")
def _(spark, sf):
    k = F.concat(F.expr("element_at(array('Tsunami India', 'Flood India', 'Arabian Sea cyclone'), cast(doc_id % 3 as int) + 1)"), F.lit(" "), F.col("text"))
    return _docs(spark, sf).select("doc_id", X.coastal_flag(k).alias("coastal"))


@query("document_key", "X-35",
       "select id, platform || '_' || floor(epoch(ts))::bigint || '_' || md5(id || '|' || post_type) as doc_key from stream", ("stream",))
def _(spark, sf):
    return A.stream(spark, sf).select("id", X.document_key(F.col("platform"), F.unix_seconds("ts"), F.col("id").cast("string"), F.col("post_type")).alias("doc_key"))


@query("try_number", "X-33",
       """select id, try_cast(v as double) as num, v as raw from (select id, case post_type when 'error' then 'n/a' when 'view' then '' else value::varchar end as v from stream)""",
       ("stream",))
def _(spark, sf):
    s = A.stream(spark, sf).select("id", F.expr("case post_type when 'error' then 'n/a' when 'view' then '' else cast(value as string) end").alias("raw"))
    return s.select("id", X.try_number(F.col("raw")).alias("num"), "raw")


@query("first_k", "X-36", "select vec_id, round(embedding[1]::double, 6) as a, round(embedding[2]::double, 6) as b, round(embedding[3]::double, 6) as c from embeddings")
def _(spark, sf):
    k = A.table(spark, sf, "embeddings").select("vec_id", X.first_k(F.col("embedding"), 3).alias("k"))
    return k.select("vec_id", *[r(F.col("k")[i].cast("double")).alias(n) for i, n in enumerate("abc")])


@query("decode_envelope", "S-2",
       """select id, json_extract(props, '$.k')::bigint as k, coalesce(nullif(platform, 'news'), 'unknown') as platform,
       coalesce(nullif(post_type, 'error'), 'unknown') as post_type from stream""", ("stream",))
def _(spark, sf):
    env = A.stream(spark, sf).selectExpr("id", "props as post_data", "nullif(platform, 'news') as platform",
                                         "nullif(post_type, 'error') as post_type", "date_format(ts, 'yyyy-MM-dd') as timestamp")
    return decode_envelope(env, "k bigint").select("id", F.col("post.k").alias("k"), "platform", "post_type")


STRIP = r"trim(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'))"


def _strip(x):
    return STRIP.replace('\\"', '"').format(x=x)


def _el(x, tag):
    return f"nullif({_strip(f'''regexp_extract({x}, '(?is)<(?:{tag})(?:\\s[^>]*)?>(.*?)</(?:{tag})>', 1)''')}, '')"


@query("page_summary", "S-14",
       f"""select page_id, {_el('html', 'title')} as title, md5({_el('html', 'p')}) as summary,
       array_to_string(regexp_extract_all(html, '(?i)href="([^"]*)"', 1), ' ') as links from pages""")
def _(spark, sf):
    s = P.page_summary(A.table(spark, sf, "pages"), "page_id", "html")
    return s.select("page_id", "title", F.md5(F.col("summary").cast("binary")).alias("summary"), joined("links", " ").alias("links"))


@query("page_items", "S-14 W-5",
       rf""", i as (select page_id, regexp_extract_all(html, '(?is)<(?:li)(?:\s[^>]*)?>(.*?)</(?:li)>', 1)[1:15] as items from pages),
       x as (select page_id, unnest(items) as b, unnest(range(len(items))) as pos from i)
       select page_id, pos::int as pos, coalesce({_el('b', 'a')}, '') as title, coalesce(regexp_extract(b, '(?i)href="([^"]*)"', 1), '') as link from x""")
def _(spark, sf):
    return P.extract_items(A.table(spark, sf, "pages"), "page_id", "html", 15, ("li",)).select("page_id", "pos", "title", "link")


@query("feed_entries", "S-14 W-5",
       f"""select doc_id, 0 as pos, source as title, md5(coalesce({_strip('text')}, '')) as content,
       case when doc_id % 2 = 0 then 'https://example.org/' || doc_id else 'g' || doc_id end as link from documents""")
def _(spark, sf):
    """Each document as a feed of one entry, in either of the two feed formats."""
    d = _docs(spark, sf)
    item = F.concat(F.lit("<item><title>"), "source", F.lit("</title><description><![CDATA["), "text",
                    F.lit("]]></description><link>https://example.org/"), "doc_id", F.lit("</link></item>"))
    entry = F.concat(F.lit("<entry><title>"), "source", F.lit("</title><summary>"), "text",
                     F.lit("</summary><guid>g"), "doc_id", F.lit("</guid></entry>"))
    feeds = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, item).otherwise(entry).alias("xml"))
    rows = P.extract_items(feeds, "doc_id", "xml", 15)
    return rows.select("doc_id", "pos", "title", F.md5(F.col("content").cast("binary")).alias("content"), "link")


@query("page_blocks", "S-14 F-4",
       rf""", i as (select page_id, regexp_extract_all(html, '{P.element_pattern(("div", "p", "td"))}', 0) as items from pages),
       x as (select page_id, unnest(items) as b, unnest(range(len(items))) as pos from i), t as (select page_id, pos, {_strip('b')} as c from x),
       k as (select *, row_number() over (partition by page_id order by pos) as n from t where length(trim(c)) > 50 and (contains(lower(c), 'tion') or contains(lower(c), 'und')))
       select page_id, pos::int as pos, md5(c) as digest from k where n <= 10""")
def _(spark, sf):
    b = P.text_blocks(A.table(spark, sf, "pages"), "page_id", "html", ("div", "p", "td"), 10, 50, ["tion", "und"])
    return b.select("page_id", "pos", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("flatten_search", "S-15 J-6",
       f"""select o_orderkey::varchar as id, {sql_iso('o_orderdate')} as datetime, case when o_orderkey % 4 = 0 then 'unknown' else 'u' || o_custkey end as "user",
       o_orderpriority as content, case when o_orderkey % 3 = 0 then 'P' || o_custkey % 25 end as place, coalesce(nullif(o_orderstatus, 'P'), 'unknown') as lang from orders""")
def _(spark, sf):
    o = A.table(spark, sf, "orders").selectExpr(
        """array(named_struct('id', cast(o_orderkey as string), 'author_id', cast(o_custkey as string), 'text', o_orderpriority,
           'created_at', date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'), 'lang', nullif(o_orderstatus, 'P'),
           'geo', named_struct('place_id', cast(o_custkey % 25 as string)))) as data""",
        """named_struct('users', if(o_orderkey % 4 = 0, array(), array(named_struct('id', cast(o_custkey as string), 'username', concat('u', o_custkey)))),
           'places', if(o_orderkey % 3 = 0, array(named_struct('id', cast(o_custkey % 25 as string), 'name', concat('P', o_custkey % 25))), array())) as includes""")
    return P.flatten_search(o)


@query("flatten_search_pages", "S-15 J-6",
       """, p as (select *, o_custkey % 97 as page from orders),
       u as (select page, o_custkey % 13 as who, arg_max('u' || o_orderkey, o_orderkey) as name from p group by all)
       select o_orderkey::varchar as id, strftime(o_orderdate, '%Y') as datetime, coalesce(name, 'unknown') as "user", o_orderpriority as content,
       case when o_orderkey % 2 = 0 then 'place ' || p.page end as place, 'unknown' as lang
       from p left join u on u.page = p.page and u.who = o_custkey % 17""")
def _(spark, sf):
    """Many hits a response, and side lists that name a user several times: the last name wins."""
    o = A.table(spark, sf, "orders").selectExpr(
        "o_custkey % 97 as page", "o_orderkey", "o_custkey % 13 as who",
        """named_struct('id', cast(o_orderkey as string), 'author_id', cast(o_custkey % 17 as string), 'text', o_orderpriority,
           'created_at', date_format(o_orderdate, 'yyyy'), 'lang', cast(null as string),
           'geo', named_struct('place_id', if(o_orderkey % 2 = 0, 'here', 'nowhere'))) as hit""")
    user = F.struct("o_orderkey", F.col("who").cast("string").alias("id"), F.concat(F.lit("u"), F.col("o_orderkey")).alias("username"))
    pages = o.groupBy("page").agg(F.collect_list("hit").alias("data"), F.array_sort(F.collect_list(user)).alias("users"))
    return P.flatten_search(pages.select("data", F.struct("users", F.expr(
        "array(named_struct('id', 'here', 'name', concat('place ', page)))").alias("places")).alias("includes")))


@query("flatten_threads", "S-16",
       """, a as (select conv_id, turn, role, text from conversations),
       m as (select a.conv_id as video, a.turn as id, a.role as author, 'main_comment' as type, null as parent_id, null as parent_text, md5(a.text) as digest from a where turn % 2 = 0),
       r as (select b.conv_id, b.turn, b.role, 'reply', a.turn::varchar, case when length(a.text) > 100 then left(a.text, 100) || '...' else a.text end, md5(b.text)
         from a join a b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.turn % 2 = 0)
       select * from m union all select * from r""")
def _(spark, sf):
    c = A.table(spark, sf, "conversations").selectExpr(
        "conv_id as video", "turn div 2 as thread",
        "named_struct('id', turn, 'author', role, 'text', text, 'likes', length(text)) as x")
    t = c.groupBy("video", "thread").agg(
        F.min_by("x", F.col("x.id")).alias("top"),
        F.filter(F.sort_array(F.collect_list("x")), lambda x: x["id"] % 2 == 1).alias("replies"))
    return P.flatten_threads(t).select("video", "id", "author", "type", "parent_id", "parent_text", F.md5(F.col("text").cast("binary")).alias("digest"))
