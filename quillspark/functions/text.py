"""Text functions: scripts and language, Arabic normalisation, token estimates, splitting.

All are column expressions, so they stay in the JVM and inside code generation
where Spark allows it.  Null text gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks dropped, digits and letters folded, and what deletes.
MARK_RANGES = ((0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC), (0x06DF, 0x06E4), (0x06E7, 0x06E8), (0x06EA, 0x06ED), (0x08D3, 0x08E1), (0x08E3, 0x08FF))
LETTER_FOLDS = {0x0622: 0x0627, 0x0623: 0x0627, 0x0625: 0x0627, 0x0671: 0x0627, 0x0649: 0x064A, 0x0629: 0x0647, 0x0624: 0x0621, 0x0626: 0x0621}
TATWEEL = 0x0640
# Characters per token, and the share of Arabic letters that makes a text Arabic.
ARABIC_CHARS_PER_TOKEN, OTHER_CHARS_PER_TOKEN = 3.34, 4.45
ARABIC_SHARE = 0.2
# Function words that Arabic prose contains.
ARABIC_FUNCTION_WORDS = ("في", "من", "على", "إلى", "عن", "مع", "التي", "الذي", "هذا", "هذه")
# What is said when the sources have no answer.
REFUSALS = {
    "ar": "لم أجد هذه المعلومة في مصادر الشركة — هل أحوّلك إلى أحد الموظفين؟",
    "en": "We couldn't find that in the company's sources. Would you like us to pass your question to the team?",
}

SPACE = r"\p{IsWhite_Space}"
# The same characters one by one, and Arabic script, whose lookup costs much, told by its range first.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ARABIC = r"[\x{600}-\x{10ffff}&&\p{IsArabic}]"


def trim_space(text: Column) -> Column:
    """Trim Unicode white space, not only U+0020."""
    return F.btrim(text, F.lit(SPACES))


def is_inked(text: Column) -> Column:
    """Whether anything but white space stands in a text."""
    return F.rlike(text, F.lit(r"\P{IsWhite_Space}"))


def collapse_space(text: Column) -> Column:
    """One space for every run of white space, none at the ends; single spaces are passed over."""
    return F.trim(F.regexp_replace(text, rf"[{SPACE}&&[^ ]]{SPACE}*+| {SPACE}++", " "))


def count_chars(text: Column, kind: str) -> Column:
    """How many characters are of a regex character class, met by runs, without a list of matches."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def arabic_letters(text: Column) -> Column:
    return count_chars(text, r"[\p{L}&&\p{IsArabic}]")


def latin_letters(text: Column) -> Column:
    return count_chars(text, r"[\p{L}&&\p{IsLatin}]")


def direction(language: Column) -> Column:
    return F.when(language == "ar", "rtl").otherwise("ltr")


def detect_language(text: Column, fallback: Column | str = "en") -> Column:
    """Struct ``language, dir, ratio, mixed`` from Arabic and Latin letters alone."""
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    arabic, latin = arabic_letters(text), latin_letters(text)
    total = arabic + latin
    ratio = F.when(total == 0, 0.0).otherwise(arabic / total)
    language = F.when(total == 0, fallback).when(ratio >= ARABIC_SHARE, "ar").otherwise("en")
    mixed = (arabic > 0) & (latin > 0) & (ratio > 0.1) & (ratio < 0.9)
    return F.struct(language.alias("language"), direction(language).alias("dir"), ratio.alias("ratio"), mixed.alias("mixed"))


def conversation_language(texts: Column, fallback: str = "en") -> Column:
    """Language of the last five visitor messages, weighted by recency and by letters (200 at most)."""
    last = F.slice(texts, F.greatest(F.size(texts) - 4, F.lit(1)), 5)
    shares = F.transform(
        last,
        lambda t, i: F.struct(
            ((i + 1) * F.least(arabic_letters(t) + latin_letters(t), F.lit(200))).cast("double").alias("w"),
            F.coalesce(F.try_divide(arabic_letters(t), arabic_letters(t) + latin_letters(t)), F.lit(0.0)).alias("r"),
        ),
    )
    weight = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x["w"])
    score = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x["w"] * x["r"])
    return F.when(F.coalesce(weight, F.lit(0.0)) == 0, fallback).when(score / weight >= ARABIC_SHARE, "ar").otherwise("en")


def normalize_arabic(text: Column) -> Column:
    """Drop vowel marks, fold letter variants and digits, collapse white space; case and punctuation stay."""
    marks = "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in MARK_RANGES) + "]"
    folds = {0x0660 + d: 0x30 + d for d in range(10)} | {0x06F0 + d: 0x30 + d for d in range(10)} | LETTER_FOLDS
    source, target = "".join(map(chr, folds)), "".join(map(chr, folds.values()))
    folded = F.translate(F.regexp_replace(text, marks, ""), source + chr(TATWEEL), target)
    return collapse_space(F.when(F.rlike(text, F.lit(r"[\x{600}-\x{8ff}]")), folded).otherwise(text))


def estimate_tokens(text: Column) -> Column:
    """Tokens a model would see, from character counts; blank text has none, any other at least one."""
    arabic = count_chars(text, ARABIC)
    other = F.length(F.regexp_replace(text, rf"[{SPACE}{ARABIC}]+", ""))
    estimate = F.floor(arabic / F.lit(ARABIC_CHARS_PER_TOKEN) + other / F.lit(OTHER_CHARS_PER_TOKEN) + 0.5).cast("int")
    return F.when(~is_inked(text), 0).otherwise(F.greatest(F.lit(1), estimate))


def split_paragraphs(text: Column) -> Column:
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n", -1)
    return F.filter(F.transform(parts, trim_space), lambda p: p != "")


def split_sentences(text: Column) -> Column:
    """Sentences with their ends; a full stop between two digits is none."""
    ends = "(?<=[.!?\\x{61f}\\x{6d4}\\n])(?!(?<=\\p{Nd}\\.)\\p{Nd})"
    return F.filter(F.transform(F.split(text, ends, -1), trim_space), lambda s: s != "")


def tidy(text: Column) -> Column:
    """Collapse white space in lines, drop blank lines and immediate repeats, part lines by blank lines."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), collapse_space), lambda line: line != "")
    # Bound in an array of one, as Spark evaluates a repeated expression inside a filter for every element.
    joined = F.transform(F.array(lines), lambda found: F.array_join(drop_repeats(found), "\n\n"))
    return F.get(joined, F.lit(0))


def drop_repeats(items: Column) -> Column:
    """Array without elements equal to the one before."""
    return F.filter(items, lambda x, i: (i == 0) | (x != F.get(items, i - 1)))


def has_presentation_forms(text: Column) -> Column:
    return F.rlike(text, F.lit("[\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"))


def readability(text: Column) -> Column:
    """``ok``, or why extracted text can't be vouched for."""
    letters, arabic = count_chars(text, r"\p{L}"), arabic_letters(text)
    broken = F.regexp_count(text, F.lit("\\x{FFFD}"))
    count = lambda words: sum(((F.size(F.split(text, f" {w} ", -1)) - 1) for w in words), F.lit(0))
    forward, backward = count(ARABIC_FUNCTION_WORDS), count([w[::-1] for w in ARABIC_FUNCTION_WORDS])
    return (
        F.when(letters == 0, "no readable characters")
        .when(broken * 10 > letters, "encoding not decoded")
        .when(arabic * 100 < letters * 20, "ok")
        .when(has_presentation_forms(text), "display glyphs")
        .when(arabic < 200, "ok")
        .when(backward > forward, "display order")
        .when(forward == 0, "no recognisable words")
        .otherwise("ok")
    )


def contact_kind(contact: Column) -> Column:
    """``email``, ``phone`` (7 to 15 ASCII digits) or ``other``."""
    c = trim_space(contact)
    address = r"[^\s@<>,;:\"()\[\]\\.]+(\.[^\s@<>,;:\"()\[\]\\.]+)*@[^\s@<>,;:\"()\[\]\\.]+(\.[^\s@<>,;:\"()\[\]\\.]+)*"
    digits = F.regexp_count(c, F.lit("[0-9]"))
    return F.when(F.rlike(c, F.lit(rf"^({address}|[^<>@]*<{address}>)$")), "email").when((digits >= 7) & (digits <= 15), "phone").otherwise("other")


def normalize_email(email: Column) -> Column:
    """Lower-cased bare address of at most 254 bytes, else null."""
    e = F.lower(trim_space(email))
    bare = r"^[^\s@<>,;:\"()\[\]\\.]+(\.[^\s@<>,;:\"()\[\]\\.]+)*@[^\s@<>,;:\"()\[\]\\.]+(\.[^\s@<>,;:\"()\[\]\\.]+)*$"
    return F.when((F.octet_length(e) <= 254) & F.rlike(e, F.lit(bare)), e)


def display_name(name: Column, email: Column) -> Column:
    """Name, else the email's local part made readable, else a label; 120 characters at most."""
    own = trim_space(F.coalesce(name, F.lit("")))
    local = F.when(F.contains(email, F.lit("@")), F.split_part(F.split_part(email, F.lit("@"), F.lit(1)), F.lit("+"), F.lit(1))).otherwise("")
    words = collapse_space(F.translate(F.coalesce(local, F.lit("")), "._-", "   "))
    readable = F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 2**31 - 1))
    return F.left(F.when(own != "", own).when(words != "", readable).otherwise("My workspace"), F.lit(120))


def refusal(language: Column) -> Column:
    return F.when(language == "ar", REFUSALS["ar"]).otherwise(REFUSALS["en"])


def truncate(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def short_reason(message: Column) -> Column:
    """A failure reason without the prefixes of the layers it came through."""
    return truncate(F.regexp_replace(message, "ingest: |crawl: |fetch: |extract: ", ""), 2000)


def short_error(message: Column) -> Column:
    """Drop the first prefix of a long message; cut at 180 bytes (of whole characters)."""
    cut = F.when((F.octet_length(message) > 90) & F.contains(message, F.lit(": ")), F.substring(message, F.instr(message, ": ") + 2, F.length(message))).otherwise(message)
    return F.when(F.octet_length(cut) > 180, F.concat(F.left(cut, F.lit(180)), F.lit("…"))).otherwise(cut)


def pieces(text: Column, size: int = 60) -> Column:
    """Fixed-width pieces of a text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def render_prompt(business: Column, language: Column, passages: Column, rules: str, assistant: str = "Assistant") -> Column:
    """Grounding prompt: who speaks, the rules with the refusal, and numbered, fenced passages.

    ``passages`` is an array of ``(title, url, text)``.  A fence inside a passage is
    neutralised, so its text cannot break out of its block.
    """
    fence = '"""'
    body = lambda p: F.concat(F.lit("    "), F.replace(F.replace(p["text"], F.lit(fence), F.lit("'''")), F.lit("\n"), F.lit("\n    ")))
    one = lambda p, i: F.concat(
        F.lit("\n["), (i + 1).cast("string"), F.lit("] "), F.coalesce(F.nullif(p["title"], F.lit("")), F.lit("untitled source")), F.lit("\n"),
        F.when(F.coalesce(p["url"], F.lit("")) != "", F.concat(F.lit("    "), p["url"], F.lit("\n"))).otherwise(""),
        F.lit(f"    {fence}\n"), body(p), F.lit(f"\n    {fence}\n"),
    )
    who = F.concat(F.lit(f"You are {assistant}"), F.when(business != "", F.concat(F.lit(", the customer support assistant for "), business)).otherwise(""), F.lit(".\n\n"))
    sources = F.when(F.size(passages) == 0, F.lit("SOURCES: none were found.\n")).otherwise(F.concat(F.lit("SOURCES:\n"), F.array_join(F.transform(passages, one), "")))
    return F.concat(who, F.lit(rules), refusal(language), F.lit("\n\n"), sources)


def echo_reply(prompt: Column, marker: str = "[ECHO]") -> Column:
    """What the stand-in model says: the prompt's sources."""
    parts = F.split(prompt, "SOURCES:", 2)
    return F.concat(F.lit(f"{marker}\n"), trim_space(F.coalesce(F.get(parts, F.lit(1)), prompt)))


def empty_crawl(skipped: Column, summary: Column) -> Column:
    """Why a crawl has no pages, from how many were left out and their summary."""
    return F.when(skipped == 0, "we could not read any pages from this address").otherwise(F.concat(F.lit("no pages could be indexed. "), summary))


def format_number(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def plural_category(language: Column, n: Column) -> Column:
    """The plural form a whole number takes in English or Arabic."""
    hundred = n % 100
    arabic = F.when(n == 0, "zero").when(n == 1, "one").when(n == 2, "two").when(hundred.between(3, 10), "few").when(hundred.between(11, 99), "many").otherwise("other")
    return F.when(language == "ar", arabic).when(n == 1, "one").otherwise("other")


def plural(language: Column, n: Column, forms: Column) -> Column:
    """A number with its noun from a map of forms; Arabic none, one and two are told by the noun alone."""
    category = plural_category(language, n)
    noun = F.coalesce(forms[category], forms["other"], F.lit(""))
    return F.when((language == "ar") & category.isin("zero", "one", "two"), noun).otherwise(F.concat(format_number(n), F.lit(" "), noun))
