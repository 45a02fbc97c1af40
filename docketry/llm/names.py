"""Names typed by people: reading them, and how alike two of them are. Plain functions, used inside Spark tasks."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Titles before a name, endings after it, and fields that name nobody.
TITLES = frozenset("the hon honorable honourable judge justice chief presiding senior associate magistrate commissioner mr mrs ms miss dr prof officer ofc sgt sergeant det detective deputy lt capt atty attorney ada da aka".split())
SUFFIXES = {"jr": "jr", "sr": "sr", "ii": "ii", "iii": "iii", "iv": "iv", "esq": "", "phd": "", "md": ""}
NOBODY = frozenset("per curiam|by the court|en banc|n a|na|none|unknown|unassigned|not assigned|tbd|pending|visiting judge|visiting|judge|the court|court|panel|see docket|illegible|various|vacant|assigned judge|to be assigned|clerk|magistrate judge|chief judge|justice".split("|"))
# Words of bodies, with the short forms they are typed in.
BODY_WORDS = {
    "county": "county", "co": "county", "cnty": "county", "cty": "county", "office": "office", "ofc": "office", "off": "office", "offc": "office",
    "laboratory": "laboratory", "lab": "laboratory", "labs": "laboratory", "crime": "crime", "forensic": "forensic", "forensics": "forensic", "prosecutor": "prosecutor", "prosecutors": "prosecutor", "pros": "prosecutor",
    "defender": "defender", "defenders": "defender", "def": "defender", "public": "public", "pub": "public", "sheriff": "sheriff", "sheriffs": "sheriff", "sher": "sheriff",
    "police": "police", "department": "department", "dept": "department", "dpt": "department", "service": "service", "services": "service", "svc": "service", "attorney": "attorney", "atty": "attorney", "general": "general", "gen": "general",
    "court": "court", "courts": "court", "ct": "court", "district": "district", "dist": "district", "clinic": "clinic", "bureau": "bureau", "unit": "unit", "panel": "panel", "agency": "agency", "division": "division", "div": "division",
    "commission": "commission", "board": "board", "city": "city", "state": "state", "medical": "medical", "med": "medical", "examiner": "examiner", "exam": "examiner", "probation": "probation", "prob": "probation", "judiciary": "judiciary",
}
#: Words that alone show that a field names a body.
BODY_MARKS = frozenset("county laboratory office sheriff police department service court clinic bureau agency division commission board probation judiciary".split())
# Words that belong to the family name after them.
PARTICLES = frozenset("van von der den de del della di du la le bin ibn ter ten dos das".split())
FILLER = frozenset("of the for and s office in at".split())
# Usual English short forms of given names. A default: every operator takes another table.
NICKNAMES = {
    "al": ("albert", "alan", "alexander"), "alex": ("alexander", "alexandra"), "andy": ("andrew",), "annie": ("anne", "ann", "anna"), "art": ("arthur",), "barb": ("barbara",), "becky": ("rebecca",), "ben": ("benjamin",), "benny": ("benjamin",),
    "bess": ("elizabeth",), "beth": ("elizabeth",), "betsy": ("elizabeth",), "betty": ("elizabeth",), "bill": ("william",), "billy": ("william",), "bob": ("robert",), "bobby": ("robert",), "cathy": ("catherine", "katherine"), "charlie": ("charles",),
    "chuck": ("charles",), "chris": ("christopher", "christine"), "cindy": ("cynthia",), "clem": ("clementine", "clement"), "dan": ("daniel",), "danny": ("daniel",), "dave": ("david",), "deb": ("deborah",), "debbie": ("deborah",), "dick": ("richard",),
    "don": ("donald",), "dot": ("dorothy",), "ed": ("edward", "edmund"), "eddie": ("edward",), "eliza": ("elizabeth",), "ellie": ("eleonora", "eleanor"), "fran": ("frances",), "frank": ("francis",), "fred": ("frederick",), "freddy": ("frederick",),
    "gabe": ("gabriel",), "gerry": ("gerald",), "greg": ("gregory",), "hank": ("henry",), "harry": ("henry", "harold"), "jack": ("john",), "jake": ("jacob",), "jamie": ("james",), "jen": ("jennifer",), "jenny": ("jennifer",), "jerry": ("gerald", "jerome"),
    "jim": ("james",), "jimmy": ("james",), "jo": ("josephine", "joanna"), "joe": ("joseph",), "johnny": ("john",), "jon": ("jonathan",), "josie": ("josephine",), "kate": ("katherine",), "kathy": ("katherine",), "katie": ("katherine",), "ken": ("kenneth",),
    "kit": ("christopher",), "larry": ("lawrence",), "leo": ("leopold", "leonard"), "len": ("leonard",), "liz": ("elizabeth",), "lizzie": ("elizabeth",), "maggie": ("margaret",), "meg": ("margaret",), "peggy": ("margaret",), "marge": ("margaret",),
    "matt": ("matthew",), "max": ("maxwell",), "mike": ("michael",), "mick": ("michael",), "mickey": ("michael",), "nate": ("nathaniel", "nathan"), "ned": ("edward",), "nick": ("nicholas",), "nell": ("eleonora", "eleanor"), "pat": ("patricia", "patrick"),
    "patty": ("patricia",), "trish": ("patricia",), "pete": ("peter",), "phil": ("philip",), "ray": ("raymond",), "rich": ("richard",), "rick": ("richard",), "rob": ("robert",), "robbie": ("robert",), "ron": ("ronald",), "ros": ("rosalind",), "roz": ("rosalind",),
    "sam": ("samuel", "samantha"), "sandra": ("alexandra",), "sandy": ("alexandra",), "steve": ("stephen",), "sue": ("susannah", "susan"), "susie": ("susannah", "susan"), "suzy": ("susannah",), "ted": ("theodore", "edward"), "tim": ("timothy",), "tom": ("thomas",), "tommy": ("thomas",), "tony": ("anthony",),
    "vic": ("victor", "victoria"), "vicky": ("victoria",), "vicki": ("victoria",), "wally": ("walter",), "wendy": ("gwendolyn",), "will": ("william",), "willy": ("william",), "win": ("winifred",), "winnie": ("winifred",), "zack": ("zachary",),
}


class Name(NamedTuple):
    """kind: person, body or nobody. A person has a surname, given names (full or one letter) and a suffix; a body words."""

    kind: str
    surname: str
    given: tuple[str, ...]
    suffix: str
    words: tuple[str, ...]

    @property
    def form(self) -> str:
        return "|".join((self.kind, self.surname, " ".join(self.given), self.suffix, " ".join(self.words)))


def from_form(form: str) -> Name:
    kind, surname, given, suffix, words = form.split("|")
    return Name(kind, surname, tuple(given.split()), suffix, tuple(words.split()))


_DIGITS = str.maketrans({"0": "o", "1": "l", "3": "e", "5": "s", "8": "b"})


def plain(text: str) -> str:
    """Lower case without accents, digits read as the letters they are typed for."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    text = text.replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("’", "'")
    return text.translate(_DIGITS)


def _fold(word: str) -> str:
    """A word with the letter pairs that scans confuse read as one letter."""
    return word.replace("rn", "m").replace("vv", "w")


def read(text: str | None) -> Name:
    """A typed field as a name; null, blank and placeholders name nobody."""
    nobody = Name("nobody", "", (), "", ())
    if text is None:
        return nobody
    flat = " ".join(text.split())
    words = re.findall(r"[^\W_]+", plain(flat).replace("'s ", "s ").replace("'", ""))
    if not words or " ".join(words) in NOBODY:
        return nobody
    known = [BODY_WORDS.get(w, w) for w in words]
    if sum(w in BODY_MARKS for w in known) and sum(w in BODY_WORDS for w in words) >= 2:
        return Name("body", "", (), "", tuple(sorted({w for w in known if w not in FILLER})))
    parts = [p.strip() for p in flat.split(",") if p.strip()]
    suffix = ""
    while len(parts) > 1 and (s := re.sub(r"[^a-z]", "", plain(parts[-1]))) in SUFFIXES:
        suffix = suffix or SUFFIXES[s]
        parts.pop()
    if len(parts) > 2:
        return nobody
    tokens = [_tokens(p) for p in parts]
    for t in tokens:
        while t and t[-1][0] in SUFFIXES and len(t) > 1:
            suffix = suffix or SUFFIXES[t.pop()[0]]
        while t and t[0][0] in TITLES and not (len(parts) == 2 and t is tokens[1]):
            t.pop(0)
    tokens = [t for t in tokens if t]
    if not tokens:
        return nobody
    if len(tokens) == 2:
        surname, given = tokens[0], tokens[1]
        # titles may stand after the comma too
        given = [g for g in given if g[0] not in TITLES] or given
        if [w for w, _ in given] in (["j"], ["jj"], ["cj"]):
            given = []  # "Smith, J." is how opinions write Judge Smith
    else:
        t = tokens[0]
        if len(t) > 1 and t[-1][0] in ("j", "jj", "cj", "pj") and len(t[0][0]) > 1:
            t = t[:-1]
        if len(t) > 1 and len(t[-1][0]) == 1 and len(t[0][0]) > 1:
            surname, given = t[:1], t[1:]  # "Smith John A" and "Smith J" name the family first
        else:
            at = len(t) - 1
            while at > 1 and t[at - 1][0] in PARTICLES:
                at -= 1
            surname, given = t[at:], t[:at]
    last = "".join(w for w, _ in surname)
    if len(last) < 2:
        return nobody
    first: list[str] = []
    for w, initials in given:
        first += list(w) if initials else [w]
    return Name("person", last, tuple(first), suffix, ())


def _tokens(part: str) -> list[tuple[str, bool]]:
    """Words of one part of a name, and whether a word is initials typed together (R.C., RW)."""
    out = []
    mixed = any(c.islower() for c in part) or " " not in part
    for raw in part.split():
        letters = "".join(c for c in plain(raw) if c.isalpha())
        if not letters:
            continue
        dots = raw.count(".") >= 2 and len(letters) == raw.count(".")
        vowels = set(letters) & set("aeiouy")
        out.append((letters, letters.isascii() and len(letters) > 1 and (dots or len(letters) == 2 and raw.isupper() and (mixed or not vowels) and letters not in SUFFIXES)))
    return out


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """Edit distance in which two letters that changed places are one edit."""
    if a == b:
        return 0
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


def within_one(a: str, b: str) -> bool:
    """Whether edits(a, b) is 1 at most, without counting further."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) > len(b):
        return a[i + 1 :] == b[i:]
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def closeness(a: str, b: str) -> float:
    """1 less the share of letters to edit, as typed or with confused letter pairs folded, whichever is nearer."""
    best = 1 - edits(a, b) / max(len(a), len(b), 1)
    fa, fb = _fold(a), _fold(b)
    return best if best == 1 or (fa, fb) == (a, b) else max(best, 1 - edits(fa, fb) / max(len(fa), len(fb), 1))


class Given:
    """Given names under a table of short forms (short form to the names it may stand for)."""

    def __init__(self, nicknames: dict[str, tuple[str, ...]]):
        self.nicknames, self.short = nicknames, {}
        for short, full in nicknames.items():
            for f in full:
                self.short.setdefault(f, set()).add(short)
        self.forms_of = lru_cache(maxsize=50_000)(self._forms_of)
        self.letters_of = lru_cache(maxsize=50_000)(self._letters_of)

    def _forms_of(self, given: str) -> frozenset[str]:
        """A given name and the names it may be short for, also if the short form has a typo."""
        out = {given, *self.nicknames.get(given, ())}
        if len(given) >= 3 and given not in self.nicknames and given not in self.short:
            for short, full in self.nicknames.items():
                if len(short) >= 4 and within_one(given, short):
                    out.update(full)
        return frozenset(out)

    def _letters_of(self, given: str) -> tuple[frozenset[str], frozenset[str]]:
        """Letters a given name may be written with: its own and its full forms', and those of its short forms."""
        forms = self.forms_of(given)
        near = {f for g in forms if len(g) >= 5 for f in self.short if within_one(g, f)}
        return frozenset(f[0] for f in forms), frozenset(s[0] for f in forms | near for s in self.short.get(f, ()))

    def closeness(self, a: str, b: str) -> float:
        """0 if the two can't be one given name, else up to 1; a letter agrees with every name that begins with it, and
        less with one whose short form does."""
        if len(a) == 1 or len(b) == 1:
            (own_a, short_a), (own_b, short_b) = self.letters_of(a), self.letters_of(b)
            return 0.9 if own_a & own_b else 0.55 if own_a & short_b or short_a & own_b else 0.0
        best = max(closeness(x, y) - (0.12 if x[0] != y[0] else 0.0) for x in self.forms_of(a) for y in self.forms_of(b))
        return best if best >= GIVEN_CLOSE else 0.0


ENGLISH = Given(NICKNAMES)

#: How close two typed surnames, given names, words of bodies, and whole bodies must be to be one.
SURNAME_CLOSE, GIVEN_CLOSE, WORD_CLOSE, BODY_CLOSE = 0.72, 0.6, 0.74, 0.82


#: How close surname and given name must be where one of two names is read in another order, and what that costs.
REORDERED_CLOSE, REORDERED = 0.85, 0.9


def likeness(a: Name, b: Name, weight, given: Given = ENGLISH) -> float:
    """0 if a and b can't be the same, else their soft weighted token similarity, up to 1.

    weight(token) is larger for rarer tokens. Of persons, parts that only one of them has don't count; surnames must be
    close, given names and suffixes must not contradict each other. Names that are not alike as they were read may be with
    the family name first, or with a second family name left out (see reordered())."""
    if a.kind != b.kind or a.kind == "nobody":
        return 0.0
    if a.kind == "body":
        both = min(_covered(a.words, b.words, weight), _covered(b.words, a.words, weight))
        return both if both >= BODY_CLOSE else 0.0
    as_read = _persons(a, b, weight, given)
    if as_read:
        return as_read
    other = reordered(a, b)
    return REORDERED * _persons(*other, weight, given) if other else 0.0


def _persons(a: Name, b: Name, weight, given: Given) -> float:
    last = closeness(a.surname, b.surname)
    if last < SURNAME_CLOSE or (a.suffix and b.suffix and a.suffix != b.suffix):
        return 0.0
    w = min(weight(a.surname), weight(b.surname))  # a typo makes a common token look rare
    total, score = w, w * last
    for x, y in zip(a.given, b.given, strict=False):
        g = given.closeness(x, y)
        if not g:
            return 0.0
        w = min(weight(x), weight(y))
        total, score = total + w, score + w * g
    return score / total


def reordered(a: Name, b: Name) -> tuple[Name, Name] | None:
    """The two persons with one of them read otherwise, if surname and first given name, both in full, are close then."""
    for x, y, turned in ((a, b, False), (b, a, True)):
        readings = []
        if x.given and len(x.given[0]) >= 2:
            readings.append(x._replace(surname=x.given[0], given=(*x.given[1:], x.surname)))
        if len(x.given) >= 2 and len(x.given[-1]) >= 3:
            readings.append(x._replace(surname=x.given[-1], given=x.given[:-1]))
        for r in readings:
            if y.given and len(y.given[0]) >= 2 and len(r.given[0]) >= 2 and closeness(r.surname, y.surname) >= REORDERED_CLOSE and closeness(r.given[0], y.given[0]) >= REORDERED_CLOSE:
                return (y, r) if turned else (r, y)
    return None


def contradict(a: Name, b: Name, given: Given = ENGLISH) -> bool:
    """Whether two persons' names can't be one, beyond what typos explain: their suffixes differ, or their middle
    letters do, or their given names are plainly others. Bodies and surnames alone contradict nothing."""
    if a.kind != "person" or b.kind != "person":
        return a.kind != b.kind
    if a.suffix and b.suffix and a.suffix != b.suffix:
        return True
    if closeness(a.surname, b.surname) < SURNAME_CLOSE and (other := reordered(a, b)):
        a, b = other
    for i, (x, y) in enumerate(zip(a.given, b.given, strict=False)):
        if not i and len(x) == len(y) == 1:
            continue  # B. and W. may both stand for William
        if not given.closeness(x, y) and (i or len(x) == 1 or len(y) == 1 or max(closeness(f, g) for f in given.forms_of(x) for g in given.forms_of(y)) < 0.5):
            return True
    return False


def _covered(a: tuple[str, ...], b: tuple[str, ...], weight) -> float:
    total = score = 0.0
    for x in a:
        best = max((closeness(x, y) for y in b), default=0.0)
        w = weight(x)
        total += w
        score += w * best if best >= WORD_CLOSE else 0.0
    return score / total if total else 0.0


def rank(name: Name) -> int:
    """How much a name says: 3 full given name and middle, 2 full given name or several initials, 1 an initial, 0 a
    surname alone; bodies 3."""
    if name.kind == "body":
        return 3
    if not name.given:
        return 0
    full = len(name.given[0]) > 1
    return 3 if full and len(name.given) > 1 else 2 if full or len(name.given) > 1 else 1


def tokens(name: Name) -> tuple[str, ...]:
    return name.words if name.kind == "body" else (name.surname, *name.given)


def heads(name: Name) -> list[str]:
    """What a name is looked up by, each with its role: s a person's surname, as typed and folded, g given names in full,
    which may be the surname of a name read in another order, b the words of a body."""
    if name.kind == "body":
        return ["b:" + " ".join(name.words)]
    given = {"g:" + g for g in name.given if len(g) >= 3 or (len(g) == 2 and not g.isascii())}
    return sorted({"s:" + name.surname, "s:" + _fold(name.surname), *given})


def most_edits(length: int) -> int:
    """Edits by which a close surname may differ, of a word so long or a longer one."""
    return int((1 - SURNAME_CLOSE) * length + 1e-9)


def grams_lost(length: int) -> int:
    """Padded 2-grams of a word of this length that a close one may lack at most: an inserted letter breaks one, any other
    edit three at most (two letters that change places)."""
    return max((i + 3 * max(0, most_edits(length + i) - i) for i in range(length + 2) if i <= most_edits(length + i)), default=0)
