"""Names of officials as Column expressions: normal forms, parsing of fields that may hold several, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings dropped anywhere, titles dropped in front, fields that name a court, labels before a name.
ENDINGS = ("jr", "sr", "esq", "esquire", "hon", "honorable", "judge", "justice", "j", "iii", "ii", "iv")
TITLES = ("chief", "associate", "senior", "presiding", "acting", "magistrate", "district", "circuit", "administrative", "the", "mr", "mrs", "ms")
COLLECTIVE = ("per curiam", "percuriam", "by the court", "the court", "en banc", "panel", "unassigned", "unknown", "none", "n a", "not available", "unpublished")
DISPLAY_TITLES = (*TITLES, "judge", "judges", "justice", "hon", "honorable")
POST_NOMINALS = ("j", "jj", "cj", "js")
LABELS = ("before:", "panel:", "coram:", "judges:", "judge:", "opinion by:", "opinion by", "author:")


def once(value: Column, use) -> Column:
    """use(value) with value written and computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _array(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _drop_front(tokens: Column, is_title) -> Column:
    """tokens without those in front for which is_title holds: the kept part starts at the first other one."""
    def from_first(t: Column) -> Column:
        marks = F.transform(t, lambda x: ~is_title(x))
        first = F.array_position(marks, True).cast("int")
        return F.when(first > 0, F.slice(t, first, F.size(t))).otherwise(F.array().cast("array<string>"))

    return once(tokens, from_first)


def _bare(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"[^\p{L}\p{N}]", ""))


def normalize_name(raw: Column) -> Column:
    """Lower case, words of letters and digits, without endings anywhere and titles in front."""
    words = _words(F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}]", " "))
    kept = F.filter(words, lambda t: ~F.array_contains(_array(ENDINGS), t))
    return F.array_join(_drop_front(kept, lambda t: F.coalesce(t.isin(*TITLES), F.lit(False))), " ")


def display_name(raw: Column) -> Column:
    """A name as it is shown: without titles in front, reporter's letters behind and stray commas; case is kept."""
    front = _drop_front(_words(raw), lambda t: F.coalesce(_bare(t).isin(*DISPLAY_TITLES), F.lit(False)))
    back = F.reverse(_drop_front(F.reverse(front), lambda t: F.coalesce(_bare(t).isin(*POST_NOMINALS), F.lit(False))))
    return F.trim(F.regexp_replace(F.trim(F.array_join(back, " ")), r"^[,;]+|[,;]+$", ""))


def without_artifacts(raw: Column) -> Column:
    """A field without form labels and leading captions, blanks runs as one, edges cut to letters, digits and full stops."""
    s = F.regexp_replace(F.replace(raw, F.lit("’"), F.lit("'")), r"[\n\t]", " ")
    s = F.regexp_replace(s, r"(?is)^(.*?)form field[\d\s]*", "$1")
    for label in LABELS:
        s = F.regexp_replace(s, rf"(?i)^\s*{label}", "")
    return F.regexp_replace(F.array_join(_words(s), " "), r"^[^.\p{L}\p{N}]+|[^.\p{L}\p{N}]+$", "")


def collective_marker(text: Column) -> Column:
    """The marker that the whole field amounts to, or null."""
    norm = F.array_join(_words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " ")), " ")
    return F.when(norm.isin(*COLLECTIVE), norm)


def split_names(text: Column) -> Column:
    """Parts between semicolons, ampersands and the word and; empty ones dropped."""
    parts = F.split(text, r"(?i);|&|(?<=^|\s)and(?=\s|$)")
    trimmed = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.trim(F.array_join(_words(p), " ")), r"^,+|,+$", "")))
    return F.filter(trimmed, lambda p: p != "")


def _segment(segment: Column) -> Column:
    """The names of one part, or null where its commas can be read in several ways."""
    pieces = F.transform(F.split(segment, ","), lambda p: once(F.trim(p), lambda q: F.struct(q.alias("text"), normalize_name(q).alias("norm"))))

    def read(p: Column) -> Column:
        counts = F.transform(p, lambda x: F.size(F.split(x["norm"], " ")))
        single, n = F.forall(counts, lambda c: c == 1), F.size(p)
        turned = F.array(display_name(F.concat_ws(" ", F.get(p, F.lit(1))["text"], F.get(p, F.lit(0))["text"])))
        return (
            F.when(n <= 1, F.array(display_name(segment)))
            .when(single & (n >= 3), F.transform(p, lambda x: display_name(x["text"])))
            .when(single, F.lit(None).cast("array<string>"))
            .when((n == 2) & (F.get(counts, F.lit(0)) == 1), turned)
        )

    return once(F.filter(pieces, lambda x: x["norm"] != ""), read)


def parse_officials(raw: Column) -> Column:
    """struct(kind, names, reason) of a field: individuals with their names, collective, or ambiguous.

    One ambiguous part makes the whole field ambiguous; null, blank and fields naming a court are collective."""
    clean = without_artifacts(F.coalesce(raw, F.lit("")))
    result = lambda kind, names, reason: F.struct(F.lit(kind).alias("kind"), names.alias("names"), reason.alias("reason"))
    none = F.array().cast("array<string>")

    def of_parts(c: Column, found: Column) -> Column:
        unclear = F.exists(found, lambda x: x.isNull())
        names = F.filter(F.flatten(F.filter(found, lambda x: x.isNotNull())), lambda x: normalize_name(x) != "")
        told = lambda k: F.when(F.size(k) == 0, result("collective", none, F.lit("no name remained after titles were removed"))).otherwise(result("individuals", k, F.lit(None).cast("string")))
        return F.when(unclear, result("ambiguous", none, F.lit("a part is either one name written surname first or several names"))).otherwise(once(names, told))

    def read(c: Column) -> Column:
        marked = lambda m: F.when(m.isNotNull(), result("collective", none, F.concat(m, F.lit(" names the court, not an individual")))).otherwise(
            once(F.transform(split_names(c), _segment), lambda found: of_parts(c, found))
        )
        return F.when(c == "", result("collective", none, F.lit("the field is empty"))).otherwise(once(collective_marker(c), marked))

    return once(clean, read)


def fingerprint(role: Column, normalized: Column, jurisdiction: Column, bar: Column, badge: Column) -> Column:
    """The key under which an official is filed."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.concat_ws("|", F.coalesce(role, F.lit("")), F.coalesce(normalized, F.lit("")), low(jurisdiction), low(bar), low(badge))


def name_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance of two normal forms over the longer length; 1 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))
