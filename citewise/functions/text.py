"""Column expressions over titles, headings, queries and prose: markers, data points, years, topics, intents, formats, page types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewise.functions.exprs import IDEOGRAPH, jaccard

# Phrases that count as marks of experience, of original data, of machine-written prose, and of health, money or law.
MARKERS = {
    "experience": (
        r"\bin (?:our|my) experience\b", r"\b(?:we|i) (?:tested|tried)\b", r"\b(?:we|i) used\b(?! to\b)", r"\b(?:we|i) found\b", r"\bhands-on\b", r"\bwe (?:measured|ran|spent|interviewed)\b",
        r"\bour results\b", r"\bour test(?:s|ing)?\b", r"\bafter (?:testing|using)\b", r"\bcase stud(?:y|ies)\b", r"\bfirst-?hand\b", r"\bscreenshots? of\b",
    ),
    "original_data": (
        r"\bour (?:surveys?|stud(?:y|ies)|analys[ie]s|datasets?|data|research|benchmarks?)\b", r"\bwe (?:surveyed|analy[sz]ed|collected|tracked|audited|sampled|reviewed) \d",
        r"\bsample of \d", r"\bn ?= ?\d", r"\bmethodolog(?:y|ies)\b", r"\bwe found that \d",
    ),
    "ai_phrase": (
        r"\bdelv(?:e|es|ed|ing)\b", r"\bin today's (?:fast-paced|digital|ever-changing)\b", r"\bunlock(?:ing)? the (?:full potential|power|potential)\b", r"\bgame[- ]changers?\b",
        r"\bit's (?:important|worth) (?:to note|noting)\b", r"\bnavigat(?:e|ing) the (?:complex|ever-changing|ever-evolving)\b", r"\bever-evolving landscape\b", r"\bin the realm of\b",
        r"\brich tapestry\b", r"\bembark(?:ing)? on (?:a|your) journey\b", r"\blook no further\b", r"\bwhether you're a (?:beginner|seasoned)\b", r"\belevate your\b", r"\bseamlessly integrat",
    ),
    "ymyl": (
        r"\bsymptoms?\b", r"\bdiagnos(?:is|es|ed)\b", r"\btreatments?\b", r"\bmedications?\b", r"\bdosages?\b", r"\bdiseases?\b", r"\bcancers?\b", r"\bdiabet(?:es|ic)\b", r"\bpregnan(?:cy|cies|t)\b",
        r"\bmental health\b", r"\btherap(?:y|ies|ist|ists)\b", r"\bloans?\b", r"\bmortgages?\b", r"\bcredit scores?\b", r"\binvest(?:s|ed|ing|ments?|ors?)?\b", r"\btax(?:es)?\b", r"\bretirement\b",
        r"\binsurance\b", r"\bcrypto(?:currency|currencies)?\b", r"\btrading\b", r"\blawyers?\b", r"\battorneys?\b", r"\blawsuits?\b", r"\bvisas?\b", r"\bimmigration\b", r"\bdivorces?\b", r"\bcustody\b",
    ),
}


def collapsed(text: Column) -> Column:
    """Single spaces, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def clipped(text: Column, most: int) -> Column:
    """The first most characters; code points are never split."""
    return F.substring(text, 1, most)


def plain_marks(text: Column) -> Column:
    """Curly apostrophes and odd hyphens as plain ones."""
    return F.translate(F.coalesce(text, F.lit("")), "‘’ʼ′‐‑", "''''--")


def count_markers(text: Column, kind: str) -> Column:
    """Occurrences, not overlapping, of the phrases of one kind of MARKERS; 0 for null."""
    return F.regexp_count(plain_marks(text), F.lit("(?i)" + "|".join(MARKERS[kind])))


# Dates and times, and units after a number.
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DATES = "(?i)" + "|".join(
    (
        r"\b\d{4}-\d{1,2}-\d{1,2}(?:[tT ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[zZ]|[+-]\d{2}:?\d{2})?)?", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{1,2}:\d{2}(?::\d{2})?(?:\s?[ap]\.?m\.?)?",
        rf"\b{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b", rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH},?\s+\d{{4}}\b",
    )
)
UNITS = (
    r"%|percent\b|pct\b|x\b|k\b|m\b|bn\b|million\b|billion\b|trillion\b|thousand\b|ms\b|secs?\b|seconds?\b|mins?\b|minutes?\b|hrs?\b|hours?\b|days?\b|weeks?\b|months?\b|years?\b|"
    r"kb\b|mb\b|gb\b|tb\b|px\b|kg\b|lbs?\b|km\b|miles?\b|cm\b|°[cf]?"
)
MONEY = "$€£¥₹"
_NUMBER = rf"(?i)(?<![\p{{L}}\p{{N}}_.,])([{MONEY}]\s?)?(\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.(\d+))?(\s?(?:{UNITS}))?(?![\p{{L}}\p{{N}}_])"


def count_data_points(text: Column) -> Column:
    """Numbers that say something: with money or a unit, or of two digits and more; dates, times, years and numbers like 07 don't count."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), DATES, " ")
    part = lambda g: F.regexp_extract_all(t, F.lit(_NUMBER), F.lit(g))
    found = F.arrays_zip(part(1).alias("money"), part(2).alias("whole"), part(3).alias("frac"), part(4).alias("unit"))
    year = lambda x: (x["frac"] == "") & x["whole"].rlike("^(?:19|20)[0-9]{2}$")
    digits = lambda x: F.length(F.regexp_replace(x["whole"], ",", "")) + F.length(x["frac"])
    bare_counts = lambda x: ~year(x) & (digits(x) >= 2) & ~((x["frac"] == "") & x["whole"].rlike(r"^0\d$"))
    return F.size(F.filter(found, lambda x: (x["money"] != "") | (x["unit"] != "") | bare_counts(x)))


_COPYRIGHT = r"(?i)(?:©|\(c\)|\bcopyright\b)(?:\s|©|\(c\))*(?:(?:19|20)\d{2}\s*(?:[-–—]|to)\s*)?(?:19|20)\d{2}(?!\d)"
_ADDRESS_WORD = r"(?i)(?<!\S)[^\p{L}\p{N}\s]*(?:[a-z][a-z0-9+.-]*://|www\.|[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?::\d+)?/)\S*"
_YEAR = (
    rf"(?i)(?<![\p{{L}}\p{{N}}_#{MONEY}])(?<![{MONEY}]\s)(?:(?<!\d\.)|(?<=(?:^|[^\d.])\d{{1,2}}\.\d{{1,2}}\.))(199\d|20\d{{2}})(?![\p{{L}}\p{{N}}_])"
    rf"(?!\.(?!\d{{1,2}}\.\d{{1,2}}(?!\d))\d)(?!(?!\s[xkm]\b)\s?(?:{UNITS}))"
)


def years_in(text: Column, most: int = 12) -> Column:
    """The years from 1990 to 2099 that a text speaks of, sorted, the newest most: not in addresses, versions, prices, copyright notices or before a unit."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _ADDRESS_WORD, " "), _COPYRIGHT, " ")
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(_YEAR), F.lit(1)), lambda y: y.cast("int"))))
    return F.slice(years, F.greatest(F.size(years) - most + 1, F.lit(1)), most)


# --- titles

# Nouns after a promised number, words of bait and of shouting.
LIST_WORDS = (
    "ways|best|tips|tools|examples|reasons|steps|things|ideas|strategies|mistakes|alternatives|questions|signs|tricks|hacks|apps|platforms|options|methods|techniques|lessons|rules|books|places|websites|sites|"
    "companies|brands|features|benefits|factors|metrics|kpis|prompts|templates|plugins|extensions|resources|trends|stats|statistics|facts|myths|secrets|habits|practices|tactics|products|services|solutions|"
    "agencies|courses|picks|keywords|checks|errors|issues|types"
)
_NO_COUNT = r"(?!\s*-?\s*(?:%|percent\b|x\b|k\b|m\b|ms\b|secs?\b|seconds?\b|mins?\b|minutes?\b|hrs?\b|hours?\b|days?\b|weeks?\b|months?\b|years?\b|am\b|pm\b))"
PROMISES = (
    r"(?i)\btop[-\s]+(\d{1,3})\b", rf"(?i)(?<![\d.,/])\b(\d{{1,3}})\b{_NO_COUNT}\s+(?:[\p{{L}}'’&-]+\s+){{0,3}}?(?:{LIST_WORDS})\b", rf"(?i)^[^\p{{L}}\p{{N}}]*(\d{{1,2}})(?![\d.,%/:])\b{_NO_COUNT}",
)
BAIT = r"(?i)\byou won'?t believe\b|\bshocking\b|\binsane\b|\bmind[- ]?blowing\b|\bthis one trick\b|\bwhat happens next\b|\bsecrets?\b"
_SEPARATOR = r"\s(?:\||-|–|—|·|•|»|::)\s"
SHOUTED = tuple("FREE NOW NEW HUGE BEST WOW OMG MUST SALE HOT TOP BIG EVER JUST ALL OFF WIN STOP DONT WHY HOW WHAT THIS THAT YOU YOUR THE AND FOR WITH NOT ONLY LAST NEXT REAL TRUE FAST EASY WILL CAN".split())
ACRONYMS = tuple("HTTPS HIPAA NASDAQ UNESCO UNICEF OAUTH SCORM COVID ASEAN OPENAI".split())


def title_year(title: Column) -> Column:
    """The newest year from 1990 on in a title, else null."""
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"(?<!\d)(199\d|20\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int")))


def title_number(title: Column) -> Column:
    """The number of things a title promises ('top 10', '7 proven ways', a leading number), else null; status codes promise nothing."""
    t = F.regexp_replace(plain_marks(title), r"(?i)\b[1-5]\d{2}\s+(?:errors?|status(?:es)?|codes?|pages?|redirects?|responses?)\b", " ")
    numbers = [F.try_to_number(F.nullif(F.regexp_extract(t, p, 1), F.lit("")), F.lit("999")).cast("int") for p in PROMISES]
    return F.coalesce(*(F.when(n >= 1, n) for n in numbers))


def title_brand(title: Column) -> Column:
    """What stands after a title's last separator, up to six words and no question, else null."""
    b = collapsed(F.regexp_extract(collapsed(title), rf"^.*{_SEPARATOR}(.*)$", 1))
    return F.when((b != "") & ~b.endswith("?") & (F.size(F.split(b, " ")) <= 6), clipped(b, 100))


def title_head(title: Column) -> Column:
    """What stands before a title's last separator, or all of it."""
    return F.regexp_replace(collapsed(title), rf"^(.*){_SEPARATOR}.*$", "$1")


def clickbait_hits(title: Column) -> Column:
    """Words of bait in a title, one more for an exclamation mark, one more if three words in ten shout."""
    head = title_head(plain_marks(title))
    words = F.regexp_extract_all(head, F.lit(r"\p{L}[\p{L}'’]*"), F.lit(0))
    letters = F.transform(words, lambda w: F.regexp_replace(w, "['’]", ""))
    shouts = F.filter(letters, lambda w: (F.length(w) >= 2) & (w == F.upper(w)) & (w != F.lower(w)) & (w.isin(*SHOUTED) | ((F.length(w) >= 5) & ~w.isin(*ACRONYMS))))
    loud = (F.size(words) >= 3) & (F.size(shouts) >= 0.3 * F.size(words))
    return F.regexp_count(head, F.lit(BAIT)) + head.contains("!").cast("int") + loud.cast("int")


# Words that begin a question, and words after them that make none.
QUESTION_WORDS = "what|how|why|when|where|which|who|can|does|do|is|are|should"


def is_question(heading: Column) -> Column:
    """A heading that ends in a question mark or begins with a question's word, unless it goes on about oneself."""
    h = F.coalesce(heading, F.lit(""))
    ends = h.rlike(r"[?？؟][^\p{L}\p{N}]*$")
    asks = h.rlike(rf"(?i)^[^\p{{L}}]*(?:{QUESTION_WORDS})(?:['’](?:s|re|ll|d|ve))?(?!\p{{L}}|['’]\p{{L}})")
    selfish = h.rlike(rf"(?i)^[^\p{{L}}]*(?:{QUESTION_WORDS})(?:['’](?:s|re|ll|d|ve))?[^\p{{L}}]+(?:we|us|our|it|its)(?:['’](?:s|re|ll|d|ve))?(?!\p{{L}}|['’]\p{{L}})")
    return h.rlike(r"\p{L}") & (ends | (asks & ~selfish))


def estimated_pixels(text: Column, size: int = 20) -> Column:
    """A text's width by a model of four widths of letters."""
    t = F.coalesce(text, F.lit(""))
    narrow, wide = F.regexp_count(t, F.lit(r"[ilI.,;:'|!jft ]")), F.regexp_count(t, F.lit("[mwMW]"))
    large = F.regexp_count(t, F.lit("[A-HJ-LN-VX-Z0-9]"))
    rest = F.length(t) - narrow - wide - large
    return F.floor(narrow * (size * 0.28) + wide * (size * 0.85) + large * (size * 0.62) + rest * (size * 0.5) + 0.5)


# --- words and topics

# Words that are no topic of a page, words that are no topic of a query, and words never cut to a singular.
TOPIC_STOP = tuple(
    "the and for with your you our are can how what why when where who which best top guide ultimate complete tip way step list free online new versus review example thing need know everything about into from this that "
    "these those doe does should will get use using used make more most really simple easy quick beginner introduction intro overview explained update updated year month not all any its than then there their them they was "
    "were has have had been also just only very much many some such each other over under after before between without within out per via here now today part page home blog post article learn read checklist template tool "
    "software app platform solution service company inc llc ltd official welcome start started getting work works vs faq".split()
)
QUERY_STOP = tuple(
    "a an the and or but nor so yet of in on at to for from by with without about into onto over under after before between through during per via vs versus is are was were be been being am do does did doing done have has "
    "had having will would shall should can could may might must it its this that these those there here what whats which who whom whose why how hows when where i me my mine we us our ours you your yours youre he him his she "
    "her hers they them their theirs as if than then also just very too more most much many any all each every some such own same other others not no only up down out off again further once dont doesnt isnt arent cant wont "
    "didnt lets really even still like com www net org io co http https".split()
)
KEEP_PLURAL = tuple("news series species ios macos windows less mass always saas paas iaas".split())
KEYWORD_STOP = tuple("a an the of for to in on and or with at by from is are".split())


def light_stem(word: Column) -> Column:
    """A word's singular by its end: ies to y, s dropped; ss, us and is stay. The stemmer of page topics."""
    n = F.length(word)
    return F.when((n > 4) & word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when((n > 3) & word.endswith("s") & ~word.rlike("(?:ss|us|is)$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def stem(word: Column) -> Column:
    """A word's singular by its end, with exceptions and es after x, ch, sh, zz and ss. The stemmer of queries and headings."""
    n = F.length(word)
    return (
        F.when((n <= 3) | word.isin(*KEEP_PLURAL), word)
        .when(word.endswith("ies") & (n > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(?:sses|xes|ches|shes|zzes)$"), F.regexp_replace(word, "es$", ""))
        .when(word.endswith("s") & ~word.rlike("(?:ss|us|is)$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def letters_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, apostrophes dropped before."""
    return letters_of(F.regexp_replace(F.coalesce(text, F.lit("")), "['’]", ""))


def topic_tokens(text: Column, brand_words: Column | None = None) -> Column:
    """The distinct topic words of a title or heading: three letters at least, no numbers, no stop or brand words, singular."""
    own = F.array().cast("array<string>") if brand_words is None else brand_words
    keep = lambda w: (F.length(w) >= 3) & ~w.isin(*TOPIC_STOP) & ~F.array_contains(own, w)
    words = F.transform(F.filter(letters_of(text), lambda w: keep(w) & ~w.rlike("^[0-9]+$")), light_stem)
    return F.array_distinct(F.filter(words, keep))


def without_brand(words: Column, brands: Column) -> Column:
    """words less those that hold a brand's key of three letters or more, alone or as two or three of them written together."""
    brands = F.filter(F.transform(brands, lambda b: F.regexp_replace(F.lower(b), r"[^\p{L}\p{N}]", "")), lambda b: F.length(b) >= 3)

    def joined(i: Column, first: int, n: int) -> Column:
        start = i + 1 + first
        return F.when((start >= 1) & (start + n - 1 <= F.size(words)), F.array_join(F.slice(words, F.greatest(start, F.lit(1)), n), ""))

    def hit(w: Column, i: Column) -> Column:
        windows = F.array(*(joined(i, first, n) for n in (2, 3) for first in range(1 - n, 1)))
        return F.exists(brands, lambda b: w.contains(b)) | F.exists(windows, lambda x: F.coalesce(F.array_contains(brands, x), F.lit(False)))

    return F.filter(words, lambda w, i: ~hit(w, i))


def core_tokens(query: Column, brands: Column) -> Column:
    """The distinct words of a query that carry it: no brand, no stop words, two letters at least, singular."""
    kept = F.filter(without_brand(query_words(query), brands), lambda w: ~w.isin(*QUERY_STOP) & (F.length(w) >= 2))
    return F.array_distinct(F.transform(kept, stem))


def heading_tokens(text: Column) -> Column:
    """The distinct words of a heading: as core_tokens without brands, and no numbers, ordinals or decades."""
    keep = lambda w: ~w.isin(*QUERY_STOP) & (F.length(w) >= 2)
    words = F.filter(query_words(text), lambda w: keep(w) & ~w.rlike(r"^\d+(?:st|nd|rd|th|s)?$"))
    return F.array_distinct(F.filter(F.transform(words, stem), keep))


def same_topic(a: Column, b: Column, least: float = 0.5) -> Column:
    """Whether half of two headings' words are shared; headings without words share no topic."""
    x, y = heading_tokens(a), heading_tokens(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (jaccard(x, y) >= least)


def keyword_key(keyword: Column) -> Column:
    """One key for wordings of a keyword: its distinct singular words in order, without function words."""
    words = F.transform(F.filter(letters_of(keyword), lambda w: ~w.isin(*KEYWORD_STOP)), light_stem)
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def word_tokens(text: Column) -> Column:
    """Lower-case words for shingles; each ideograph is one."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"({IDEOGRAPH})", " $1 ")
    return F.regexp_extract_all(spaced, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# --- brands

# Legal forms in a brand, second levels of public suffixes.
LEGAL_FORMS = r"\b(inc|llc|ltd|limited|corp|corporation|co|gmbh|plc|pty)\b\.?"
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac", "ne", "or")


def bare_host(text: Column) -> Column:
    """A host in lower case without scheme, path, port, dot at the end or www."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "^[a-z]+://", ""), "[/?#].*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r":\d+$", ""), r"\.$", ""), r"^www\.", "")


def domain_label(domain: Column) -> Column:
    """The label that names a domain: the one before the public suffix."""
    p = F.filter(F.split(bare_host(domain), r"\."), lambda x: x != "")
    n = F.size(p)
    second = (n >= 3) & F.get(p, n - 2).isin(*SECOND_LEVEL) & (F.length(F.get(p, n - 1)) == 2)
    return F.when(second, F.get(p, n - 3)).when(n >= 2, F.get(p, n - 2)).otherwise(F.coalesce(F.get(p, F.lit(0)), F.lit("")))


def organisation_key(name: Column) -> Column:
    """A brand's key: lower case, no legal form, letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), LEGAL_FORMS, " "), r"[^\p{L}\p{N}]+", "")


def keys_match(a: Column, b: Column) -> Column:
    """Equal keys, or of three letters and more one within the other; an empty key matches nothing."""
    return (a != "") & (b != "") & ((a == b) | ((F.length(a) >= 3) & (F.length(b) >= 3) & (a.contains(b) | b.contains(a))))


def is_label_query(query: Column, label: str) -> Column:
    """Whether a query holds a brand's label, written together or not; labels under three letters count as whole words only."""
    low, compact = label.lower(), "".join(c for c in label.lower() if c.isascii() and c.isalnum())
    q = F.lower(F.coalesce(query, F.lit("")))
    if not compact:
        return F.lit(False)
    if len(compact) < 3:
        return q.rlike(r"(^|[^a-z0-9])\Q" + low + r"\E([^a-z0-9]|$)")
    return q.contains(low) | F.regexp_replace(q, "[^a-z0-9]", "").contains(compact)


def is_brand_query(query: Column, brands: Column) -> Column:
    """Whether a query holds one of the brands' keys of three letters or more, as written or written together."""
    q = F.lower(F.coalesce(query, F.lit("")))
    compact = F.regexp_replace(q, r"[^\p{L}\p{N}]", "")
    return F.exists(brands, lambda b: (F.length(b) >= 3) & (q.contains(b) | compact.contains(b)))


def is_brand_keyword(keyword: Column, tokens: Column) -> Column:
    """Whether a keyword written together holds one of the tokens."""
    compact = F.regexp_replace(F.lower(F.coalesce(keyword, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    return F.exists(tokens, lambda t: (t != "") & compact.contains(t))


# --- intent and format

# Words of intents, places, and words with which a brand's own query is still about the brand.
PLACES = (
    "new york|nyc|los angeles|chicago|houston|phoenix|philadelphia|san antonio|san diego|dallas|jacksonville|austin|fort worth|san jose|columbus|charlotte|indianapolis|san francisco|seattle|denver|oklahoma city|nashville|"
    "washington|el paso|las vegas|boston|detroit|portland|louisville|memphis|baltimore|milwaukee|albuquerque|tucson|fresno|sacramento|mesa|atlanta|kansas city|colorado springs|omaha|raleigh|miami|virginia beach|long beach|"
    "oakland|minneapolis|bakersfield|tulsa|tampa|arlington"
)
INTENT_WORDS = (
    ("commercial", "vs|versus|best|top|review|reviews|alternative|alternatives|compare|comparison|comparisons|comparing"),
    ("transactional", "price|prices|pricing|cost|costs|buy|buying|coupon|coupons|discount|discounts|free trial"),
    ("local", f"near me|{PLACES}"),
    ("informational", "what (?:is|are|does)|whats|how (?:to|do|does|can)|why|guide|guides|meaning|definition|define|tutorial|tutorials|explained"),
)
OWN_WORDS = ("login", "log", "signin", "sign", "app", "website", "site", "official", "homepage", "home", "account", "dashboard")
NO_BRANDS = ()


def intent(query: Column, brands: Column) -> Column:
    """navigational, commercial, transactional, local or informational, by the first rule that holds; null for null.

    A brand's query is navigational if nothing but words for its own pages is left, and where no rule holds.
    """
    text = F.concat(F.lit(" "), F.array_join(query_words(query), " "), F.lit(" "))
    branded = is_brand_query(query, brands)
    out = F.when(query.isNull(), F.lit(None).cast("string")).when(branded & F.forall(core_tokens(query, brands), lambda t: t.isin(*OWN_WORDS)), "navigational")
    for name, words in INTENT_WORDS:
        out = out.when(text.rlike(f" (?:{words}) "), name)
    return out.when(branded, "navigational").otherwise("informational")


# Marks of a page's format in its title, types of products and of local businesses, groups of formats, and the formats an intent takes.
_LISTED = (
    "best|top|ways?|tips?|tools?|examples?|ideas?|reasons?|things?|steps?|mistakes?|alternatives?|apps?|sites?|websites?|platforms?|software|strateg(?:y|ies)|tactics?|questions?|signs?|types?|trends?|myths?|hacks?|tricks?|"
    "methods?|options?|resources?|templates?|books?|courses?|plugins?|extensions?|companies|agencies|brands?|products?|places?|restaurants?|features?|benefits?|services?|providers?"
)
VERSUS = r"(?i)(?:^|\s)(?:vs\.?|versus)(?=\s|$)"
COMPARE = r"(?i)\bcompar(?:e|es|ed|ing|ison|isons)\b"
LISTICLE = rf"(?i)^(?:the\s+)?(?:\d{{1,3}}\+?\s+)?(?:best|top)\b|\btop\s+\d{{1,3}}\b|(?:^|[^\d])\d{{1,3}}\+?\s+(?:[a-z0-9-]+\s+){{0,2}}(?:{_LISTED})\b"
HOW_TO = r"(?i)\bhow\s+to\b"
DEFINITION = r"(?i)\bwhat\s+(?:is|are)\b|\bwhat['’]s\b|\bmeaning\b|\bdefinition\b"
NO_SUBJECT = r"(?i)^(?:this|that|it|we|you|they|there|here|these|those|i|he|she|our|your|my|his|her|its|their|what|which|who|how|why|when|where|if|in|on|at|for|with|as|so|but|and|or|because|while|whether|today|now|every|each|all|some|most|many|no|one)\b"
LEAD = r"(?i)^([^.!?:;]{2,80}?)\s+(?:is|are|refers to|means|describes)\s+(?:a|an|the|one|any|how|when|what|defined|used|simply|basically|essentially)\b"
PRODUCT_TYPES = ("product", "productgroup", "individualproduct", "productmodel")
LOCAL_TYPES = tuple(
    "localbusiness restaurant foodestablishment store autorepair automotivebusiness dentist medicalbusiness medicalclinic physician legalservice attorney realestateagent homeandconstructionbusiness professionalservice "
    "lodgingbusiness hotel healthandbeautybusiness beautysalon dayspa financialservice accountingservice insuranceagency entertainmentbusiness sportsactivitylocation childcare drycleaningorlaundry employmentagency "
    "travelagency plumber electrician locksmith hvacbusiness roofingcontractor generalcontractor movingcompany barorpub cafeorcoffeeshop bakery fastfoodrestaurant optician pharmacy veterinarycare notary selfstorage "
    "shoppingcenter hairsalon nailsalon gasstation exercisegym".split()
)
TELEPHONE = r"\(?\b\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"
STREET = r"\b\d{1,5}\s+(?:[A-Z][a-z]+\s){1,3}(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Way|Ct|Court|Pl|Place|Hwy|Highway)\b"
FORMAT_GROUPS = {"comparison": "list", "listicle": "list", "product": "commerce", "pricing": "commerce", "homepage": "commerce", "definition": "editorial", "article": "editorial", "how-to": "editorial", "local": "local", "other": "other"}
ACCEPTABLE = {
    "informational": ("definition", "how-to", "listicle", "article"), "commercial": ("comparison", "listicle", "product", "pricing", "article"),
    "transactional": ("product", "pricing", "homepage"), "navigational": ("homepage", "product", "pricing"), "local": ("local", "homepage"),
}


def defines(first_paragraph: Column) -> Column:
    """Whether a first paragraph begins with 'X is a ...' of up to eight words X, X being no pronoun."""
    s = collapsed(first_paragraph)
    return ~s.rlike(NO_SUBJECT) & s.rlike(LEAD) & (F.size(F.split(F.trim(F.regexp_extract(s, LEAD, 1)), r"\s+")) <= 8)


def says_what_it_is(title: Column, sample: Column) -> Column:
    """Whether a text says of the words of the title's longest part that they are something."""
    parts = F.filter(F.split(collapsed(title), r"\s+[|\-–—·]\s+|\s*[|·]\s*|:\s+"), lambda x: x != "")
    longest = F.reduce(parts, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    words = F.slice(query_words(longest), 1, 6)
    topic = F.array_join(words, r"[^\p{L}\p{N}]+")
    pattern = F.concat(F.lit(r"(?i)(?:^|[^\p{L}\p{N}])"), topic, F.lit(r"(?![\p{L}\p{N}])([^.!?]{0,160}?)\s(?:is|are|refers to|means|describes)\s+(?:a|an|the|one|any)\b"))
    between = F.call_function("regexp_extract", collapsed(sample), pattern, F.lit(1))
    return (F.size(words) > 0) & F.regexp_like(collapsed(sample), pattern) & ~between.rlike(r"(?i)\b(?:which|that|who|whom|whose|where|when|while|if)\b")


def page_format(title: Column, page_type: Column, is_root: Column, types: Column, n_h2: Column, n_tables: Column, n_list_items: Column, n_ordered: Column, first_paragraph: Column, sample: Column) -> Column:
    """One of FORMAT_GROUPS' formats, by the first of eleven rules that holds, else other. types: JSON-LD types in lower case."""
    t = collapsed(title)
    has = lambda names: F.exists(types, lambda x: x.isin(*names))
    editorial = ~(is_root | F.coalesce(page_type.isin("home", "pricing", "product"), F.lit(False)))
    spoken = F.concat_ws(" ", sample, first_paragraph)
    return (
        F.when(t.rlike(VERSUS) | ((n_tables >= 1) & t.rlike(COMPARE)), "comparison")
        .when(t.rlike(LISTICLE), "listicle").when(t.rlike(HOW_TO), "how-to")
        .when(t.rlike(DEFINITION) | (editorial & (defines(first_paragraph) | says_what_it_is(title, sample))), "definition")
        .when(page_type == "pricing", "pricing").when((page_type == "product") | has(PRODUCT_TYPES), "product")
        .when(has(LOCAL_TYPES) | (spoken.rlike(TELEPHONE) & spoken.rlike(STREET)), "local")
        .when((page_type == "home") | is_root, "homepage").when((n_list_items >= 8) & (n_h2 >= 5), "listicle")
        .when((n_ordered >= 1) & (n_h2 >= 3), "how-to").when(page_type == "article", "article").otherwise("other")
    )


def format_group(fmt: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in FORMAT_GROUPS.items() for x in kv)), fmt)


def intent_match(intent_: Column, guessed: Column, fmt: Column, serp_format: Column) -> Column:
    """Whether a page's format serves a query: by the intent's formats and the group that ranks; by that group alone where the intent is a guess; null if neither is known."""
    known = serp_format.isNotNull() & (serp_format != "other")
    fits = format_group(fmt) == format_group(serp_format)
    ok = reduce(lambda out, kv: F.when(intent_ == kv[0], fmt.isin(*kv[1])).otherwise(out), ACCEPTABLE.items(), F.lit(None).cast("boolean"))
    return F.when(guessed, F.when(known, fits)).otherwise(F.when(known, ok & fits).otherwise(ok))


# --- page types, in two ways that differ

# Words of paths.
ARTICLE_TYPES = "^(article|blogposting|newsarticle|techarticle|scholarlyarticle|report)$"


def path_of(url: Column) -> Column:
    """The path of an address, / if it has none, without query."""
    p = F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def page_type(url: Column, types: Column, n_words: Column, n_h1: Column, n_h2: Column) -> Column:
    """home, legal, contact, pricing, product, article, listing or other, as the checks see a page. types in lower case."""
    p = F.lower(path_of(url))
    return (
        F.when(p == "/", "home")
        .when(p.rlike(r"/(privacy|terms|tos|legal|cookie|cookies|imprint|impressum|disclaimer|gdpr|refund)"), "legal")
        .when(p.rlike(r"/(contact|contact-us|about|about-us|team|support|careers)(/|$)"), "contact")
        .when(p.rlike(r"/(pricing|plans|price)(/|$)"), "pricing")
        .when(F.exists(types, lambda t: t.endswith("product")) | p.rlike(r"/(product|products|shop|store|item|items|p)/[^/]+"), "product")
        .when(F.exists(types, lambda t: t.rlike(ARTICLE_TYPES)) | p.rlike(r"/(blog|news|articles?|posts?|guides?|insights|resources|learn|stories|journal)/[^/]+"), "article")
        .when(p.rlike(r"/(blog|news|articles|posts|guides|resources|category|categories|tag|tags|topics)/?$"), "listing")
        .when((n_words >= 1000) & (F.size(segments(p)) >= 2) & (n_h1 >= 1) & (n_h2 >= 3), "article")
        .otherwise("other")
    )


def parsed_page_type(url: Column, types: Column, n_dated: Column) -> Column:
    """The same eight types as the parser sees a page: by whole parts of the path, types in lower case and dated paragraphs."""
    p = F.lower(path_of(url))
    s = segments(p)
    has = lambda words: F.exists(s, lambda x: x.rlike(f"^({words})$"))
    after = lambda words: F.regexp_extract(F.concat(F.lit("/"), F.array_join(s, "/"), F.lit("/")), rf"^(?:/(?!(?:{words})/)[^/]+)*/(?:{words})/([^/]*)", 1)
    product, article = "product|products|shop|store|item|items", "blog|news|article|articles|post|posts|guide|guides|docs|documentation|insights|resources|learn|stories|journal|tutorials?"
    return (
        F.when((F.size(s) == 0) | p.isin("/index.html", "/index.php", "/home"), "home")
        .when(has("pricing|plans|prices|price"), "pricing")
        .when(has("privacy|privacy-policy|terms|terms-of-service|terms-and-conditions|tos|legal|cookie|cookies|cookie-policy|imprint|impressum|disclaimer|gdpr|refund|refund-policy"), "legal")
        .when(has("contact|contact-us|about|about-us"), "contact")
        .when(F.exists(types, lambda t: t.isin(*PRODUCT_TYPES)) | (after(product) != ""), "product")
        .when(F.exists(types, lambda t: t.rlike("^(article|blogposting|newsarticle|techarticle|scholarlyarticle|report|liveblogposting)$")), "article")
        .when((after(article) != "") & ~after(article).rlike("^(page|category|tag|tags|topics|author|authors)$"), "article")
        .when(n_dated >= 2, "article")
        .when(has("category|categories|tag|tags|search|listing|listings|archive|archives|topics|collections?") | has(article) | has(product) | (F.get(s, F.size(s) - 2) == "page"), "listing")
        .otherwise("other")
    )


TOOL_PATH = (
    r"^/(login|log-in|signin|sign-in|signup|sign-up|register|logout|cart|basket|checkout|search|account|my-account|dashboard|admin|wp-admin|wp-login\.php|user|users|profile|settings|auth|api|thank-you|thanks|unsubscribe|"
    r"password|reset)(/|$)"
)
FOCUS_SKIP = r"(?i)/(?:tags?|authors?|category|categories|page)(?:/|$)|/(?:privacy|terms|tos|legal|cookies?|imprint|impressum|disclaimer|gdpr|refund|accessibility)(?:[-_./]|$)|^/(?:contact|contact-us|about|about-us|team|our-team|support|help|careers?|jobs?|pricing|plans|price)(?:/|$)|\.(?:jpe?g|png|gif|webp|avif|svg|ico|pdf|xml|txt|csv|zip|gz|mp4|mp3|webm|css|js|json)$"


def is_tool_path(url: Column) -> Column:
    """A path of logging in, buying, searching or managing, which may well be noindex."""
    return F.lower(path_of(url)).rlike(TOOL_PATH)


def slug_topic(url: Column, brand_words: Column | None = None) -> Column:
    """The topic words of an address's last part if it has two words or more, else null; null too for pages of other use."""
    path = path_of(url)
    last = F.regexp_replace(F.coalesce(F.get(segments(path), F.size(segments(path)) - 1), F.lit("")), r"(?i)\.(?:html?|php|aspx?)$", "")
    words = F.filter(F.split(F.coalesce(F.try_url_decode(last), last), r"[-_+.\s]+"), lambda w: w != "")
    topic = topic_tokens(F.array_join(words, " "), brand_words)
    skip = path.rlike(FOCUS_SKIP) | is_tool_path(url) | url.rlike(r"[?&]page=\d+")
    return F.when(~skip & (F.size(words) >= 2) & (F.size(topic) > 0), topic)


# --- sentences

_SHORT = r"e\.g|i\.e|vs|mr|mrs|ms|dr|prof|st|jr|sr|inc|ltd|co|corp|no|fig|figs|approx|est|dept|vol|u\.s|u\.k|a\.m|p\.m"


def sentence_count(text: Column) -> Column:
    """Sentences of a text: parts of its lines after a closing mark and space, each with a letter or digit; abbreviations and initials end none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)(?<![\p{{L}}.])(?=[\p{{L}}.]{{1,6}}\.[^\S\n])({_SHORT}|\p{{L}})\.(?=[^\S\n])", "$1\u0002")  # the first look passes over longer words
    parts = F.split(F.regexp_replace(t, r"([.!?][\"'”’)\]]*)[^\S\n]+", "$1\n"), "\n+")
    return F.size(F.filter(parts, lambda s: s.rlike(r"[\p{L}\p{N}]")))

