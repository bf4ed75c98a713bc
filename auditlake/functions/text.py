"""Text measures as Column expressions: all run in the JVM, inside generated code where Spark has it."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
FINGERPRINT_WORDS = 80

#: The words that tell seven languages apart, and the thresholds of the decision.
STOPWORDS = {
    "en": "the and to of in is for on with that this you your from as are be or our we can more about",
    "de": "der die das und ist zu den von mit für auf ein eine im sich des dem auch als wir sie mehr über",
    "es": "el la los las y de que en para con una un por es del se su como más al nos sobre",
    "pt": "o a os as e de que em para com uma um por é do da se sua como mais ao nos sobre",
    "fr": "le la les et de des du que en pour avec une un par est dans ce cette vous plus sur nous",
    "it": "il lo la i gli le e di che in per con una un è del della da si come più su noi",
    "nl": "de het een en van in is voor met op dat die te als om aan uw je meer ook we over",
}
LEAST_WORDS, LEAST_SCORE, LEAST_LEAD, LEAST_SHARE, MOST_PER_WORD = 60, 8, 1.6, 0.39, 5

#: Two-letter language codes.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu "
    "fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn "
    "ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os "
    "pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw "
    "ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()


def countries() -> list[str]:
    """Two-letter country codes, in lower case, from the table that comes with the time zone data."""
    table = resources.files("tzdata").joinpath("zoneinfo/iso3166.tab").read_text(encoding="utf-8")
    return [line.split("\t")[0].lower() for line in table.splitlines() if line and not line.startswith("#")]


def clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(WORD)).cast("long")


def normalized(x: Column) -> Column:
    """What a content hash is taken of: lower case, letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def content_hash(x: Column) -> Column:
    return F.when(word_count(x) >= FINGERPRINT_WORDS, F.sha2(normalized(x), 256))


def content_hash_status(words: Column) -> Column:
    """Fixed text: whether a content hash was made of that many words, and if not, why."""
    return F.when(words >= FINGERPRINT_WORDS, "available").otherwise(F.concat(F.lit("not generated ("), words.cast("string"), F.lit(f" fingerprint words; minimum {FINGERPRINT_WORDS})")))


def language_base(code: Column) -> Column:
    return F.lower(F.split_part(code, F.lit("-"), F.lit(1)))


def page_directive(value: Column, name: str) -> Column:
    """Page rules split at white space, commas and semicolons."""
    return F.coalesce(F.array_contains(F.split(F.lower(value), r"[\s,;]+"), name), F.lit(False))


def site_directive(value: Column, name: str) -> Column:
    """Site checks split at colons too, so that an agent's own directive counts."""
    return F.coalesce(F.array_contains(F.split(F.lower(value), r"[\s,;:]+"), name), F.lit(False))


def is_noindex(robots: Column, x_robots: Column) -> Column:
    return site_directive(robots, "noindex") | site_directive(x_robots, "noindex")


def mentions_noindex(value: Column) -> Column:
    """Hreflang relations look for the word anywhere."""
    return F.coalesce(F.contains(F.lower(value), F.lit("noindex")), F.lit(False))


def valid_hreflang(code: Column, country_codes: list[str] | None = None) -> Column:
    parts = F.split(F.lower(code), "-")
    part = lambda k: F.get(parts, F.lit(k))
    language, country = part(0).isin(LANGUAGES), lambda k: part(k).isin(country_codes or countries())
    script = (part(0) == "zh") & part(1).isin("hans", "hant")
    n = F.size(parts)
    return (F.lower(code) == "x-default") | (language & ((n == 1) | ((n == 2) & (script | country(1))) | ((n == 3) & script & country(2))))


def language_scores(text: Column) -> Column:
    """The text's words; those among them that any language lists, each five times at most; and the score of a list over these, the column `kept`.

    Sorted, equal words stand side by side, so that one replacement cuts their runs; a score then is one pass over what is left.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    known = sorted({w for s in STOPWORDS.values() for w in s.split()})
    in_order = F.array_join(F.array_sort(F.filter(words, lambda w: w.isin(known))), " ")
    kept = F.split(F.regexp_replace(in_order, rf"(?<![^ ])([^ ]+)((?: \1(?![^ ])){{{MOST_PER_WORD - 1}}})(?: \1(?![^ ]))+", "$1$2"), " ")
    score = lambda s: F.size(F.filter("kept", lambda w: w.isin(s.split())))
    return words, kept, score


def detect_language(df, text: str):
    """Adds detected_lang (null if unsure) and confidence (3 decimals) for the column `text`."""
    words, kept, score = language_scores(F.col(text))
    df = df.withColumn("kept", kept).withColumn("_words", F.size(words))
    scores = F.array(*[F.struct(score(s).alias("score"), F.lit(-k).alias("rank"), F.lit(lang).alias("lang")) for k, (lang, s) in enumerate(STOPWORDS.items())])
    df = df.withColumn("_scores", F.sort_array(scores, asc=False))
    top, second = F.get("_scores", F.lit(0)), F.get("_scores", F.lit(1))["score"]
    total = F.aggregate("_scores", F.lit(0), lambda acc, s: acc + s["score"])
    share = F.when(total > 0, top["score"] / total).otherwise(F.lit(0.0))
    enough = F.col("_words") >= LEAST_WORDS
    sure = (top["score"] >= LEAST_SCORE) & ((second == 0) | (top["score"] >= second * F.lit(LEAST_LEAD))) & (share >= LEAST_SHARE)
    return (
        df.withColumn("detected_lang", F.when(enough & sure, top["lang"]))
        .withColumn("confidence", F.when(enough, F.round(share, 3)).otherwise(F.lit(0.0)))
        .drop("kept", "_words", "_scores")
    )
