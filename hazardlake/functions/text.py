"""Text expressions: tags, lexicon hits, gates, truncation, safe parsing. All built-in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlake.functions import lexicons as L
from hazardlake.functions.let import let

# letters, digits, every sign from $ to _ and the exclamation mark
URL_PATTERN = r"https?://[!$-_a-z]+"


# letters, digits and the underscore of any script; combining marks end a word
WORD = r"[\p{L}\p{N}_]"
NO_WORD = r"[^\p{L}\p{N}_]"


def whole_word(pattern: str) -> str:
    """The pattern between word ends."""
    return f"(?<!{WORD})(?:{pattern})(?!{WORD})"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def hashtags(text: Column) -> Column:
    """Distinct ``#word`` tags as written, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(#{WORD}+)"), F.lit(1))))


def hashtags_lower(text: Column) -> Column:
    """All ``#word`` tags in lower case, repeats kept, in text order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(#{WORD}+)"), F.lit(1)), F.lower)


def mentions(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(@{WORD}+)"), F.lit(1))))


def urls(text: Column) -> Column:
    """All URLs in text order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(f"({URL_PATTERN})"), F.lit(1))


def tokens_of(low: Column) -> Column:
    """Word runs of a lower-case text; a whole-word test is membership among them."""
    return F.split(low, f"{NO_WORD}++")


def _is_word(term: str) -> bool:
    return all(c.isalnum() or c == "_" for c in term)


def _phrase_hit(low: Column, phrase: str) -> Column:
    # a byte search settles most texts; the constant pattern is compiled once per task
    return low.contains(phrase) & low.rlike(whole_word(phrase))


def lexicon_hits(low: Column, tokens: Column, lexicon: list[str]) -> Column:
    """Distinct lexicon terms found as whole words of a lower-case text, in list order."""
    single = [w for w in lexicon if _is_word(w)]
    found = F.array_intersect(_words(single), tokens)
    phrases = [p for p in lexicon if not _is_word(p)]
    if not phrases:
        return found
    some = F.filter(F.array(*[F.when(_phrase_hit(low, p), F.lit(p)) for p in phrases]),
                    lambda p: p.isNotNull())
    return F.array_intersect(_words(list(dict.fromkeys(lexicon))), F.concat(found, some))


def lexicon_count(low: Column, tokens: Column, lexicon: list[str]) -> Column:
    """Number of list entries found; an entry listed twice counts twice."""
    single = [w for w in lexicon if _is_word(w)]
    terms, level = [], 1
    while True:
        again = [w for w in dict.fromkeys(single) if single.count(w) >= level]
        if not again:
            break
        terms.append(F.size(F.array_intersect(_words(again), tokens)))
        level += 1
    terms += [_phrase_hit(low, p).cast("int") for p in lexicon if not _is_word(p)]
    return F.coalesce(reduce(lambda a, b: a + b, terms, F.lit(0)), F.lit(0))


def lexicon_label(low: Column, tokens: Column, levels: dict[str, list[str]],
                  default: str | None = None) -> Column:
    """First level, in order, with any whole-word hit."""
    out = None
    for name, words in levels.items():
        hit = lexicon_count(low, tokens, words) > 0
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def contains_any(text: Column, words: list[str]) -> Column:
    """Any word occurs as a substring, case-insensitive."""
    return let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in words]))


def text_gate(text: Column, min_len: int, words: list[str]) -> Column:
    """Trimmed text longer than ``min_len`` that holds any of the words."""
    return (F.length(F.trim(text)) > min_len) & contains_any(text, words)


def coastal_flag(keyword: Column) -> Column:
    return contains_any(keyword, L.COASTAL_TERMS)


def _by_initial(terms: list[str]) -> str:
    """Alternation grouped by first letter: at one position only one group can match, and
    inside a group the order of the list stays, so the matches are the same."""
    groups: dict[str, list[str]] = {}
    for t in terms:
        groups.setdefault(t[0], []).append(t[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items())


def place_mentions(low: Column, places: list[str] = L.PLACES) -> Column:
    """Place names of a lower-case text in text order, repeats kept."""
    return F.regexp_extract_all(low, F.lit(f"({whole_word(_by_initial(places))})"), F.lit(1))


def content_words(low: Column, stop: list[str] = L.COMMON_WORDS) -> Column:
    """Words of four or more ASCII letters of a lower-case text, without stop words."""
    words = F.regexp_extract_all(low, F.lit(f"({whole_word('[a-z]{4,}+')})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(stop))


def hash_tokens(text: Column) -> Column:
    """Whitespace tokens that start with ``#``."""
    return F.filter(F.split(text, r"\s+"), lambda w: w.startswith("#"))


def comprehensive_tags(title: Column, description: Column, given: Column,
                       keywords: list[str] = L.HAZARD_TAGS, places: list[str] = L.PLACES,
                       stop: list[str] = L.COMMON_WORDS) -> Column:
    """Five tag arrays, their sorted distinct union, and its size; each search runs once."""
    def uniq(a: Column) -> Column:
        return F.array_sort(F.array_distinct(a))

    def search(low: Column) -> Column:
        return F.struct(
            F.regexp_extract_all(low, F.lit(f"(#{WORD}+)"), F.lit(1)).alias("tags"),
            lexicon_hits(low, tokens_of(low), keywords).alias("found"),
            place_mentions(low, places).alias("spots"), F.slice(content_words(low, stop), 1, 20).alias("words"),
            F.transform(F.coalesce(given, F.array().cast("array<string>")), F.lower).alias("own"))

    def join(p: Column) -> Column:
        union = uniq(F.concat(p["tags"], p["found"], p["spots"], p["own"], F.slice(p["words"], 1, 10)))
        return let(union, lambda u: F.struct(
            uniq(p["tags"]).alias("hashtags"), uniq(p["found"]).alias("disaster_keywords"),
            uniq(p["spots"]).alias("location_mentions"), uniq(p["own"]).alias("youtube_tags"),
            uniq(p["words"]).alias("extracted_keywords"), u.alias("unified_tags"), F.size(u).alias("total_tag_count")))

    full = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    return let(F.lower(full), lambda low: let(search(low), join))


def non_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def snippet(text: Column, headline: Column, n: int = 120) -> Column:
    return F.substring(F.coalesce(non_empty(text), non_empty(headline), F.lit("")), 1, n)


def ellipsis(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


VERDICT = ("is_genuine boolean, verification_score double, reasoning string, confidence string, "
           "_corrupt_record string")


def json_slice(raw: Column) -> Column:
    """From the first ``{`` to the last ``}``, null when there is none."""
    return non_empty(F.regexp_extract(raw, r"(?s)\{.*\}", 0))


def parse_verdict(raw: Column) -> Column:
    """Verdict struct out of free text.

    No braces gives a false verdict with the parse reason; broken JSON gives a false
    verdict without one.
    """
    def build(x: Column) -> Column:
        none, got = x["none"], x["got"]
        broken = got["_corrupt_record"].isNotNull()
        return F.struct(
            F.when(none | broken, F.lit(False)).otherwise(F.coalesce(got["is_genuine"], F.lit(False))).alias("is_genuine"),
            F.when(none, F.lit(0.0)).when(~broken, F.coalesce(got["verification_score"], F.lit(0.0))).alias("verification_score"),
            F.when(none, F.lit("Failed to parse response")).when(~broken, got["reasoning"]).alias("reasoning"),
            F.when(none, F.lit("Invalid response format")).when(broken, F.lit("broken JSON")).alias("error"))

    def parse(text: Column) -> Column:
        return F.struct(text.isNull().alias("none"), F.from_json(text, VERDICT).alias("got"))

    return let(let(json_slice(raw), parse), build)


def instruction(task: str, platform: Column, lang: Column, user: Column, verified: Column,
                content: Column) -> Column:
    """Instruction text for a classifier column; the task text is the caller's."""
    return F.concat_ws(
        "\n", F.lit(task),
        F.concat(F.lit("PLATFORM: "), F.coalesce(platform, F.lit("unknown"))),
        F.concat(F.lit("LANGUAGE: "), F.coalesce(lang, F.lit("unknown"))),
        F.concat(F.lit("USER: "), F.coalesce(user, F.lit("unknown"))),
        F.concat(F.lit("VERIFIED_ACCOUNT: "), F.coalesce(verified, F.lit(False)).cast("string")),
        F.concat(F.lit("CONTENT: "), F.coalesce(content, F.lit(""))))


def document_key(platform: Column, epoch: Column, *stable: Column) -> Column:
    """``platform_time_hash``: a stable hash replaces the running number."""
    return F.concat_ws("_", platform, epoch.cast("string"), F.md5(F.concat_ws("|", *stable).cast("binary")))


def try_number(col: Column) -> Column:
    """Number where the text is one, else null (the text column stays beside it)."""
    return col.try_cast("double")


def first_k(arr: Column, k: int) -> Column:
    return F.slice(arr, 1, k)
