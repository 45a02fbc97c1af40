"""Text functions of feeds and opinions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named character references, and words that exclude or mark a record.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))
EXCLUDED_WORDS = ("sealed", "juvenile", "expunged")
SEARCH_WORDS = ("suppress", "search", "seizure", "warrant")
NONDISCLOSURE_WORDS = ("not produced", "never disclosed", "chain of custody documentation was not")
#: Docket markers, in the order in which they are tried.
DOCKET_MARKERS = (r"case no\.", r"no\.", r"nos\.")


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


def is_excluded(docket: Column, raw: Column) -> Column:
    """Whether a record must not be shown: raw.blocked is true, or an excluding word occurs anywhere in docket or raw."""
    text = F.lower(F.concat_ws(" ", docket, raw))
    blocked = F.coalesce(F.get_json_object(raw, "$.blocked") == "true", F.lit(False))
    return blocked | _any_of(text, EXCLUDED_WORDS)


def mentions_search(text: Column) -> Column:
    return _any_of(F.lower(text), SEARCH_WORDS)


def mentions_nondisclosure(text: Column) -> Column:
    return _any_of(F.lower(text), NONDISCLOSURE_WORDS)


def decode_entities(text: Column) -> Column:
    """Named references and the decimal ones of apostrophe and blank; the ampersand last, so nothing is decoded twice."""
    for name, char in (*ENTITIES, ("&#39;", "'"), ("&#160;", " ")):
        text = F.replace(text, F.lit(name), F.lit(char))
    # other decimal references, longest first occurrence by occurrence, through the pieces between them
    pieces = F.split(text, r"(?=&#\d{1,7};)")
    code = lambda p: F.regexp_extract(p, r"^&#(\d{1,7});", 1)
    valid = lambda p: (code(p) != "") & (code(p).try_cast("int").between(1, 55295) | code(p).try_cast("int").between(57344, 1114111))
    one = lambda p: F.when(valid(p), F.concat(_from_code(code(p).try_cast("int")), F.regexp_replace(p, r"^&#\d{1,7};", ""))).otherwise(p)
    return F.replace(F.array_join(F.transform(pieces, one), ""), F.lit("&amp;"), F.lit("&"))


def _from_code(code: Column) -> Column:
    """The character of a code point, through its UTF-16 bytes: two, or those of a pair of surrogates."""
    unit = lambda c: F.lpad(F.hex(c), 4, "0")
    above = code - 65536
    pair = F.concat(unit(F.lit(55296) + F.floor(above / 1024)), unit(F.lit(56320) + above % 1024))
    return F.decode(F.unhex(F.when(code < 65536, unit(code)).otherwise(pair)), "UTF-16BE")


def strip_html(text: Column) -> Column:
    """Tags become blanks, references characters, runs of blanks one; an unclosed tag swallows the rest."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"<[^>]*$", "")
    return F.trim(F.regexp_replace(decode_entities(bare), r"[\s ]+", " "))


def summary_text(text: Column) -> Column:
    """A feed summary without markup and without the link label that feeds add."""
    return F.trim(F.replace(strip_html(text), F.lit("Original document"), F.lit("")))


def slug(text: Column) -> Column:
    """Lower-case letters and digits, other runs one dash, 48 characters at most."""
    dashed = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 48)


def url_encode(text: Column) -> Column:
    """Percent encoding that leaves letters, digits and -_.~ and writes a blank as +."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def absolute_url(url: Column, base: str) -> Column:
    """url, after base unless it begins with http."""
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit(base), url))


def opinion_number(url: Column) -> Column:
    """The digits after /opinion/; null if there are none or other characters follow them."""
    found = F.regexp_extract(url, r"/opinion/(\d+)(?:/|$)", 1)
    return F.when(found != "", found)


def docket_from_text(text: Column) -> Column:
    """The first printed docket number: after the first marker that one follows, at least four characters with a digit.

    Full stops at its end are cut."""
    out = F.lit(None).cast("string")
    for marker in reversed(DOCKET_MARKERS):
        tokens = F.regexp_extract_all(text, F.lit(rf"(?i){marker}\s*([A-Za-z0-9\-:./]*)"), F.lit(1))
        cut = F.transform(tokens, lambda t: F.regexp_replace(t, r"\.+$", ""))
        fit = F.filter(cut, lambda t: (F.length(t) >= 4) & t.rlike(r"\d"))
        out = F.coalesce(F.try_element_at(fit, F.lit(1)), out)
    return out


def first_date(text: Column) -> Column:
    """The first ten characters as a date; null if they are none."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def utc_midnight(day: Column) -> Column:
    """A date as the instant at which it begins in UTC, as a timestamp_ntz in UTC whatever the session's zone."""
    return day.cast("date").cast("timestamp_ntz")


def contains_word(text: Column, word: Column) -> Column:
    """Whether word occurs in text with no ASCII letter or digit beside it, case aside; false for an empty word."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.lower(word), F.lit(r"\E(?![A-Za-z0-9])"))
    return F.coalesce((F.length(word) > 0) & F.regexp_like(F.lower(text), quoted), F.lit(False))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def search_caveat(partial: Column, total: Column) -> Column:
    """Which note goes with a search result: whether most of its texts are partial."""
    return F.when(partial * 2 > total, "mostly_partial").otherwise("mostly_full")
