"""Reading of names as people type them: folding, parts, nicknames, organisations."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

# Letters that canonical decomposition leaves whole.
LETTERS = str.maketrans(
    {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE",
     "ı": "i", "þ": "th", "Þ": "Th", "ð": "d", "ħ": "h"}
)
# TeX accents and letters in names from bibliography files.
TEX = re.compile(r"\{?\\(?:[\"'`^~=.]|[uvHcdbrk](?=[{\s]))\s*\{?\\?([A-Za-z])\}?\}?")
TEX_LETTERS = {"l": "l", "L": "L", "o": "o", "O": "O", "ss": "ss", "ae": "ae", "AE": "AE", "aa": "a", "AA": "A", "i": "i", "j": "j"}
TEX_LETTER = re.compile(r"\{?\\(ss|ae|AE|aa|AA|l|L|o|O|i|j)(?:\{\}|\}|\b ?)\}?")

# Words that belong to the family name but are often left out.
PARTICLES = {"von", "van", "der", "den", "de", "del", "della", "di", "da", "do", "dos", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "zu", "zur", "zum", "af", "av"}
GLUED = re.compile(f"^(?:{'|'.join(sorted(PARTICLES))})-")
WHOLE = re.compile(f"^(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))})+$")
CAMEL = re.compile(r"\b((?:von|van|der|den|de|la|di|da|do|del)+)(?=[A-Z])")
# Titles, suffixes and remarks that are no part of a name.
NOISE = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "phd", "md", "msc", "bsc", "jr", "sr", "ii", "iii", "iv", "esq", "eds", "ed", "editor"}
REMARK = re.compile(r"\((?:[^()]*author|[^()]*equal|deceased|ed(?:itor)?s?\.?|corresponding|presenter)[^()]*\)|[*†‡§¶#]+|(?<=[^\W\d])\d+(?:\s*,\s*\d+)*\s*$", re.I)
NOBODY = re.compile(
    r"^\W*(?:and\s+)?(?:others?|et\.?\s*al\.?|et alii|anon(?:ymous)?|unknown(?: authors?)?|n/?a|none|null|nil|nan|undefined|various(?: authors)?"
    r"|no authors?(?: listed| given)?|\[?no author\]?|authors?|not available|tbd|staff|the editors?|(?:the )?\w* ?editors|redaktion|collective authors?|-+|\?+|\.+)\W*$",
    re.I,
)
# Short forms of given names. One short form may stand for several names.
NICKNAMES = {
    "aga": "agnieszka", "alex": "alexander aleksandra", "sasha": "alexander aleksandra", "ola": "aleksandra", "al": "alexander",
    "andy": "andrew", "jedrek": "andrzej", "ania": "anna", "tony": "anthony", "toni": "anthony", "ben": "benjamin", "benny": "benjamin",
    "chris": "christopher christina", "kit": "christopher", "tina": "christina", "dan": "daniel", "danny": "daniel", "deb": "deborah",
    "debbie": "deborah", "dima": "dmitri", "mitya": "dmitri", "ed": "edward", "ted": "theodore edward", "teddy": "theodore edward",
    "katya": "ekaterina", "beth": "elizabeth", "liz": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "eliza": "elizabeth",
    "paco": "francisco", "pancho": "francisco", "fran": "francisco", "fred": "frederick friedrich", "freddy": "frederick",
    "fritz": "friedrich", "gabi": "gabriela", "gaby": "gabriela", "beppe": "giuseppe", "greg": "gregory", "lupe": "guadalupe",
    "hans": "johannes", "jan": "johannes", "isa": "isabella", "bella": "isabella", "nacho": "ignacio", "jen": "jennifer",
    "jenny": "jennifer", "jon": "jonathan", "jo": "josephine", "josie": "josephine", "pepe": "jose", "kate": "katherine",
    "kathy": "katherine", "katie": "katherine", "kat": "katherine", "maggie": "margaret", "meg": "margaret", "peggy": "margaret",
    "gosia": "malgorzata", "malgosia": "malgorzata", "matt": "matthew", "max": "maximilian", "mike": "michael", "mick": "michael",
    "misha": "mikhail", "nick": "nicholas", "pat": "patricia", "patty": "patricia", "trish": "patricia", "becky": "rebecca",
    "rob": "robert", "bob": "robert", "bobby": "robert", "sam": "samuel samantha", "steve": "stephen", "steph": "stephen",
    "sanne": "susanne", "susi": "susanne", "theo": "theodore", "tom": "thomas tomasz", "tommy": "thomas", "tomek": "tomasz",
    "vicky": "victoria", "vika": "victoria", "volodya": "vladimir", "vova": "vladimir", "willi": "wilhelm", "will": "william",
    "bill": "william", "billy": "william", "nadya": "nadia", "lenka": "jelena", "lena": "jelena", "marta": "marta", "jola": "jolanta",
}
# Words of organisations with their abbreviations.
ORG_WORDS = {
    "university": "univ", "department": "dept", "institute": "inst", "centre": "cent", "center": "cent", "consortium": "cons",
    "network": "netw", "survey": "surv", "group": "grp", "laboratory": "lab", "society": "soc", "association": "assoc",
    "collaboration": "collab", "committee": "comm", "council": "counc", "foundation": "found", "agency": "agcy", "office": "off",
    "initiative": "init", "programme": "prog", "program": "prog", "project": "proj", "team": "team", "working": "work",
    "national": "natl", "international": "intl", "academy": "acad", "college": "coll", "school": "sch", "hospital": "hosp",
    "faculty": "fac", "division": "div", "observatory": "obs", "station": "stn", "museum": "mus", "federation": "fed", "union": "un",
}
ORG_SHORT = {short: word for word, short in ORG_WORDS.items()} | {
    "centr": "centre", "ctr": "centre", "consort": "consortium", "gr": "group", "collabor": "collaboration", "wkg": "working", "wg": "working",
    "labs": "laboratory", "nat": "national", "int": "international", "instit": "institute", "net": "network", "div": "division",
}
SMALL = {"the", "of", "and", "for", "on", "in", "at", "a", "an", "to", "behalf", "by"}


MOJIBAKE = re.compile("[ÃÂÄÅ].")


def mended(text: str) -> str:
    """UTF-8 read as Latin-1 or Windows-1252 turned back where that is possible throughout."""
    if not text.isascii() and MOJIBAKE.search(text):
        for code in ("cp1252", "latin-1"):
            try:
                return text.encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return text


_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")


def unaccented(text: str) -> str:
    """Text without accents or compatibility forms, its case kept."""
    return _COMBINING.sub("", unicodedata.normalize("NFKD", text.translate(LETTERS)))


def fold(text: str) -> str:
    """Lower-case text without accents, TeX or compatibility forms."""
    if text.isascii() and "\\" not in text:
        return text.lower().replace("`", "'")
    text = mended(text)
    if "\\" in text:
        text = TEX.sub(r"\1", text)
        text = TEX_LETTER.sub(lambda m: TEX_LETTERS[m[1]], text).replace("{", "").replace("}", "")
    return unaccented(text).lower().replace("’", "'").replace("`", "'")


@dataclass
class Name:
    kind: str  # person, org or none
    family: str = ""  # of an organisation its key, empty if only an acronym is given
    given: tuple[str, ...] = ()  # folded; an initial has one letter, an abbreviation ends with a dot; (acronym, place) of an organisation
    sure: bool = False  # the order of the parts is certain


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\s_]+", text) if w.strip(".,;:'\"()[]-")]


def _given(text: str) -> tuple[str, ...]:
    """Parts of a given name: ``A.B.`` and ``AB`` (few capitals) are initials."""
    out: list[str] = []
    for word in re.split(r"[\s\-]+|(?<=\.)(?=[^\W\d])", text):
        short = word.endswith(".")
        w = re.sub(r"[^a-z]", "", word)
        if not w or (w in NOISE and len(w) > 1 and len(out) > 0) or w in ("dr", "prof"):
            continue
        out.append(w + "." if short and len(w) > 1 else w)
    return tuple(out)


def _family(text: str) -> str:
    """Letters of the family name without particles that stand apart; hyphens dropped."""
    parts = [re.sub(r"[^a-z\-]", "", w) for w in _words(text)]
    parts = [w for w in parts if w.strip("-")]
    parts = [w for w in parts if w not in NOISE or len(parts) == 1]
    while len(parts) > 1 and WHOLE.match(parts[0]):
        parts = parts[1:]
    joined = "".join(GLUED.sub("", w) if len(w) > 5 else w for w in parts).replace("-", "")
    return re.sub("([aou])e", r"\1", joined)  # umlauts written out


def organisation(text: str) -> tuple[str, str] | None:
    """(key, acronym) of an organisation's folded name, or null for what is none.

    The key is its words spelt out, the place first, without small words and
    spaces; the acronym is their initials in the same order.
    """
    t = re.sub(r"\([^()]*\)\s*$", "", text)
    t = re.sub(r"^\W*(?:on behalf of|for)\s+", "", t)
    m = re.fullmatch(r"(.*\s.*),\s*(?:the\s+)?([^\s,]+)\s*", t)
    if m:
        t = f"{m[2]} {m[1]}"
    words = [re.sub(r"[^a-z]", "", w) for w in re.split(r"[\s,;/&\-]+", t)]
    words = [ORG_SHORT.get(w, w) for w in words if w]
    solid = [w for w in words if w not in SMALL]
    plain = any(w in ORG_WORDS or (len(w) > 5 and any(near(w, o) for o in ORG_WORDS)) for w in solid)
    if len(solid) < 3 or not (plain or ("of" in words and len(words) > 4)):
        return None
    return "".join(solid), "".join(w[0] for w in solid)


class Known:
    """Common given names, also recognised with one typing error."""

    def __init__(self, names: frozenset[str] = frozenset()):
        self.names = names
        self.cuts: dict[str, list[str]] = {}
        for n in names:
            for c in {n, *(n[:i] + n[i + 1 :] for i in range(len(n)))}:
                self.cuts.setdefault(c, []).append(n)
        self.seen: dict[str, bool] = {}
        self.words: dict[str, str | None] = {}

    def __contains__(self, w: str) -> bool:
        if w in self.names or w in NICKNAMES:
            return True
        if w not in self.seen:
            cuts = {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} if len(w) > 2 else ()
            self.seen[w] = any(near(w, n) for c in cuts for n in self.cuts.get(c, ()))
        return self.seen[w]


def initials_only(raw: str) -> bool:
    """``AB``, ``A.B.``, ``A-B`` or ``A B``: initials in capitals."""
    letters = re.sub(r"[^\w]|[\d_]", "", raw)
    return 0 < len(letters) <= 3 and letters == letters.upper() and not re.search(r"[^\W\d]{4}", raw)


def _spread(raw: str) -> tuple[str, ...]:
    return tuple(re.sub(r"[^a-z]", "", fold(raw)))


def read(name: str | None, given: str | None = None, family: str | None = None, known: Known = Known()) -> Name:
    """The parts of a name; ``known`` holds the given names that are common in the corpus."""
    raw = re.sub(r"[\s\u200b\u00a0]+", " ", mended(name or "")).strip(" ,;")
    if not raw and (family or given):
        raw = f"{family or ''}, {given or ''}".strip(" ,")
    raw = CAMEL.sub(r"\1 ", REMARK.sub("", raw)).strip(" ,;")
    raw = re.sub(r",?\s*\b(?:Jr|Sr|PhD|Ph\.D)\.?\s*$", "", raw).strip(" ,;")
    if len(re.findall(r"[^\s,]+", raw)) > 2:  # after a family name alone these are initials
        raw = re.sub(r",?\s*\b(?:II|III|IV|MD|M\.D)\.?\s*$", "", raw).strip(" ,;")
    raw = re.sub(r"^(?:(?:Dr|Prof|Professor|Mr|Mrs|Ms|Sir)\.?\s+)+", "", raw, flags=re.I)
    raw = re.sub(r",\s*(?:(?:Dr|Prof)\.?\s+)+", ", ", raw, flags=re.I)
    if not re.search(r"[^\W\d]", raw) or NOBODY.match(raw):
        return Name("none")
    text = fold(raw)
    short = re.fullmatch(r"([A-Z]{4,8})(?:[\s,]+([^\W\d]{4,}))?", raw)
    if short and (short[2] or not re.search("[AEIOU]", short[1])):
        return Name("org", "", (short[1].lower(), fold(short[2] or "")), False)
    org = organisation(text)
    if org:
        return Name("org", org[0], (org[1],), True)
    if "," in raw:
        left, right = raw.split(",", 1)
        right = right.replace(",", " ")
        if left.strip() and right.strip():
            g = _spread(right) if initials_only(right) else _given(fold(right))
            f = fold(left).strip()
            if g and f in known and len(g[0].rstrip(".")) > 2 and g[0] not in known:  # given name, family name
                return Name("person", _family(fold(right)), _given(f), True)
            return Name("person", _family(f), g, True)
        raw = left.strip() or right.strip()
        text = fold(raw)
    words = _words(raw)
    folded = [fold(w) for w in words]
    if len(words) == 1:
        return Name("person", _family(text), (), False)

    def is_given(w: str, f: str) -> bool:
        plain = re.sub(r"[^a-z]", "", f)
        first = re.sub(r"[^a-z]", "", f.split("-")[0])
        return len(plain) == 1 or w.endswith(".") or initials_only(w) or plain in known or ("-" in f and first in known)

    def givens(start: int, end: int) -> tuple[str, ...]:
        return tuple(x for w, f in zip(words[start:end], folded[start:end]) for x in (_spread(w) if initials_only(w) else _given(f)))

    flags = [is_given(w, f) for w, f in zip(words, folded)]
    lead = next((i for i, x in enumerate(flags[:-1]) if not x), len(flags) - 1)
    tail = next((i for i, x in enumerate(reversed(flags[1:])) if not x), len(flags) - 1)
    if tail and not lead:  # the family name stands first
        return Name("person", _family(" ".join(folded[: len(words) - tail])), givens(len(words) - tail, len(words)), True)
    start = lead or 1
    return Name("person", _family(" ".join(folded[start:])), givens(0, start), lead > 0)


def fits(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """0: the given names conflict; 1: only initials or absence agree; 2: a full first name agrees."""
    if not a or not b:
        return 1
    first = part_fits(a[0], b[0])
    if not first:
        return 0
    for x, y in zip(a[1:], b[1:]):
        if not part_fits(x, y):
            return 0
    return first


#: The short forms of each given name.
SHORT: dict[str, set[str]] = {}
for _short, _full in NICKNAMES.items():
    for _name in _full.split():
        SHORT.setdefault(_name, set()).add(_short)


def loosely(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """The first part of one may be the initial of a short form of the other's (H. for Johannes)."""
    if not a or not b:
        return False
    for x, y in ((a[0], b[0]), (b[0], a[0])):
        if len(x.rstrip(".")) == 1 and any(s[0] == x[0] for s in SHORT.get(y.rstrip("."), ())):
            return True
    return False


def part_fits(x: str, y: str) -> int:
    xs, ys = x.rstrip("."), y.rstrip(".")
    if len(xs) == 1 or len(ys) == 1:
        alike = xs[:1] == ys[:1] or any(n[:1] == o[:1] for a, o in ((xs, ys), (ys, xs)) for n in NICKNAMES.get(a, "").split())
        return 1 if alike else 0
    if xs == ys:
        return 2
    if (x.endswith(".") and ys.startswith(xs)) or (y.endswith(".") and xs.startswith(ys)):
        return 2
    if ys in NICKNAMES.get(xs, "").split() or xs in NICKNAMES.get(ys, "").split():
        return 2
    if set(NICKNAMES.get(xs, "").split()) & set(NICKNAMES.get(ys, "").split()):
        return 2
    return 2 if near(xs, ys) else 0


def near(a: str, b: str) -> bool:
    """Damerau-Levenshtein distance of at most 1, for words of which one has four letters or more."""
    if min(len(a), len(b)) < 3 or max(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return a == b
    if a[0] != b[0] and a[-1] != b[-1]:  # one error leaves one end as it is
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    return ra == rb or ra[1:] == rb or ra == rb[1:] or ra[1:] == rb[1:] or (ra[:2] == rb[:2][::-1] and ra[2:] == rb[2:] and len(ra) > 1)
