"""Text, date and metadata expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: word lists and rewrite patterns that results depend on -------------------------

QUERY_STOP = "the and for are but not you all can was this that have with from they been has will its our let did how what who why when where about know remember tell show does".split()
LEMMA_STOP = (
    "the a an is are was were be been being i you he she it we they me us them my your his her its our their this that these those and or but if because so as than to of in on at by for with about from"
    " do does did have has had will would should what who when where why how which not no yes"
).split()
NOISE = [
    (r"\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}[^\]]*\]", ""),
    (r"\[Tool call: [^\]]+\]\s*", ""),
    (r"(?m)^Conversation info \(untrusted metadata\):.*?\n```[\s\S]*?\n```\s*", ""),
    (r"(?m)^Conversation info[^\n]*\n(?:```[\s\S]*?```\s*\n?)?", ""),
    (r"(?m)^Sender \(untrusted[^)]*\):.*?\n```[\s\S]*?\n```\s*", ""),
    (r"(?m)^Sender \(untrusted[^)]*\)[^\n]*\n", ""),
    (r"(?m)^Node:\s+\S+[^\n]*·\s*mode\s+\w+\s*\n", ""),
    (r"(?m)^System:\s*\[[^\]]*\]\s*", ""),
    (r"\n{3,}", "\n\n"),
]
EVENT_DATE = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T\s(]+.*?(\d{1,2}):(\d{2}))?"

# --- expressions ------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits: the terms of the text index."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def query_terms(text: Column) -> Column:
    """Distinct search terms: no punctuation, two characters at least, no stop words."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[?.!,;:()\[\]{}\"']", " ")), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*QUERY_STOP)))


def lemmas(text: Column) -> Column:
    """Stop-filtered, crudely stemmed words for overlap measures."""

    def stem(w: Column) -> Column:
        n = F.length(w)
        cut = lambda k: F.substring(w, F.lit(1), n - k)
        return F.when(w.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))).when(w.endswith("ing") & (n > 4), cut(3)).when(w.endswith("ed") & (n > 3), cut(2)).when(w.endswith("s") & (n > 3), cut(1)).otherwise(w)

    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z][a-z'-]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*LEMMA_STOP)), stem))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 0.0).otherwise(shared / union)


def clean(text: Column) -> Column:
    """Text without transport marks: time stamps, tool calls, metadata blocks, system lines."""
    for pattern, to in NOISE:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def clean_for_search(text: Column, role: Column) -> Column:
    """Older cleaning rule: time stamps and headers, and tool invocations of users."""
    out = clean(text)
    return F.when(role == "user", F.trim(F.regexp_replace(out, r"(?i)^(?:use|run|call|execute)\s+(?:the\s+)?\w+_\w+\s*(?:tool)?[:,]?\s*", ""))).otherwise(out)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def quote(text: Column, width: int = 80) -> Column:
    """White space collapsed, cut to ``width`` code points with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def event_date(value: Column) -> Column:
    """Leading year-month-day with optional time, UTC; overflow and other text give null."""
    v = F.trim(value)
    part = lambda i: F.regexp_extract(v, EVENT_DATE, i)
    day = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    hour, minute = F.coalesce(F.nullif(part(4), F.lit("")), F.lit("0")).cast("int"), F.coalesce(F.nullif(part(5), F.lit("")), F.lit("0")).cast("int")
    at = F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))
    return F.when(v.rlike(EVENT_DATE) & (hour < 24) & (minute < 60), at + F.make_dt_interval(F.lit(0), hour, minute))


def resolve_event_date(metadata: Column) -> Column:
    return F.coalesce(event_date(F.try_element_at(metadata, F.lit("occurredAt"))), event_date(F.try_element_at(metadata, F.lit("createdAt"))))


def humanize_days(days: Column) -> Column:
    a = F.abs(days)
    n = days.cast("string")
    unit = lambda k, word: F.concat(F.lit(word), F.when(k == 1, "").otherwise("s"))
    weeks, months, years = F.floor(a / 7 + 0.5), F.floor(a / 30.44 + 0.5), F.floor(a / 365.25 * 10 + 0.5) / 10
    tilde = F.when(a % 7 == 0, "").otherwise("~")
    year_text = F.when(years == F.floor(years), years.cast("long").cast("string")).otherwise(F.format_number(years, 1))
    return (
        F.when(a < 14, F.concat(n, F.lit(" "), unit(a, "day")))
        .when(a < 61, F.concat(n, F.lit(" days ("), tilde, weeks.cast("string"), F.lit(" "), unit(weeks, "week"), F.lit(")")))
        .when(a < 366, F.concat(n, F.lit(" days (~"), months.cast("string"), F.lit(" "), unit(months, "month"), F.lit(")")))
        .otherwise(F.concat(n, F.lit(" days (~"), year_text, F.lit(" "), unit(years, "year"), F.lit(")")))
    )


def time_context(at: Column) -> dict[str, Column]:
    """ISO year-week, weekday and part of day."""
    h = F.hour(at)
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))
    part = F.when((h >= 6) & (h < 12), "morning").when((h >= 12) & (h < 17), "afternoon").when((h >= 17) & (h < 21), "evening").otherwise("night")
    return {"year_week": week, "day_of_week": F.lower(F.date_format(at, "EEEE")), "time_of_day": part}


def julian(at: Column) -> Column:
    return F.unix_micros(at) / 86_400_000_000 + 2_440_587.5


def from_julian(day: Column) -> Column:
    return F.timestamp_micros(F.round((day - 2_440_587.5) * 86_400_000_000).cast("long"))


def iso_dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})(?!\d)"), F.lit(1))


def dates_anchored(text: Column, allowed: Column) -> Column:
    """Whether every ISO date of a text is among the allowed ones."""
    return F.size(F.array_except(iso_dates(text), allowed)) == 0


def merge_metadata(a: Column, b: Column) -> Column:
    """Shallow merge, the later map wins."""
    keep = F.map_filter(F.coalesce(a, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False)))
    return F.map_concat(keep, F.coalesce(b, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))


def parse_parts(content: Column) -> Column:
    """Content that is a JSON array of parts, as an array of structs; null for plain strings."""
    return F.when(F.trim(content).startswith("["), F.from_json(content, "array<struct<type:string,text:string,name:string,content:string>>"))


def parts_text(content: Column) -> Column:
    """Searchable text of a message: text parts joined by newlines, plain strings as they are."""
    parts = parse_parts(content)
    texts = F.filter(F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"])), lambda t: t.isNotNull())
    return clean(F.when(parts.isNotNull(), F.array_join(texts, "\n")).otherwise(content))


def embed_text(text: Column, previous: Column, preamble: Column) -> Column:
    """Text to embed for a turn: preamble or the tails of the two turns before, then the text."""
    tail = lambda c, n: F.when(F.length(c) > n, F.right(c, F.lit(n))).otherwise(c)
    context = F.array_join(F.transform(previous, lambda p: tail(p, 500)), "\n")
    return (
        F.when(preamble.isNotNull(), tail(F.concat_ws("\n", preamble, text), 1500))
        .when((F.length(text) > 20) & (F.size(previous) > 0), F.concat_ws("\n", tail(context, 500), tail(text, 1000)))
        .otherwise(text)
    )


def divisible_id(id_: Column, n: int = 50) -> Column:
    """Whether an id, read as a hexadecimal number of its digits (32 at most), is divisible by ``n``."""
    digits = F.lpad(F.regexp_replace(id_, "[^0-9a-fA-F]", ""), 32, "0")
    high, low = (F.conv(F.substring(digits, at, 16), 16, 10).cast("decimal(20,0)") % n for at in (1, 17))
    return (high * (2**64 % n) + low) % n == 0
