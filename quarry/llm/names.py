"""Parsing and comparing names of persons and organisations as people type them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words that stand in for a name, legal forms, lines of business with their abbreviations, nicknames.
FILLERS = {
    "", "-", "--", "n/a", "na", "none", "null", "nil", "tbd", "to be determined", "unknown", "applicant", "owner", "property owner", "see application",
    "see attached", "various", "various owners", "city initiated", "city-initiated", "same", "same as above", "same as owner", "not provided", "not available",
    "home", "about", "about us", "contact", "contact us", "welcome", "menu", "login", "log in", "sign in", "privacy policy", "terms of use", "read more",
    "learn more", "our team", "services", "our services", "search", "site map", "sitemap", "news", "careers", "products", "page not found", "home page", "index", "get a quote", "free quote",
}
LEGAL = {
    "llc": "llc", "llcs": "llc", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "lp": "lp", "llp": "llp", "ltd": "ltd", "limited": "ltd",
    "trust": "trust", "tr": "trust", "pllc": "pllc", "pc": "pc", "plc": "plc", "gmbh": "gmbh",
}
BUSINESS = {
    "properties": "properties property props prop",
    "designgroup": "designgroup dsgngroup designgrp dsgngrp",
    "associates": "associates associate assocs assoc assn",
    "homes": "homes home hms",
    "builders": "builders builder bldrs bldr",
    "development": "development developments dev devel devt develop",
    "construction": "construction constn constr const cnstr",
    "engineering": "engineering engineers engr engrg eng",
    "holdings": "holdings holding hldgs hldg",
    "landcompany": "landcompany landco",
    "planningservices": "planningservices plngsvcs planningsvc planningsvcs plngservices plngsvc planningservice",
    "capital": "capital cap capitol",
    "investments": "investments investment invest invts investmts invst",
    "management": "management mgmt mngmt mgt",
    "realty": "realty rlty realtors realestate",
    "contractors": "contractors contractor contrs contr contracting",
    "architects": "architects architect archs arch architecture",
    "bakery": "bakery", "dental": "dental dentistry", "autoglass": "autoglass", "clinic": "clinic", "consulting": "consulting consultants",
    "partners": "partners partnership", "group": "group grp", "services": "services svcs svc service", "company": "company co", "enterprises": "enterprises", "ventures": "ventures",
}
NICKNAMES = {
    "bob": "robert", "rob": "robert", "bobby": "robert", "robbie": "robert", "bill": "william", "will": "william", "billy": "william", "liam": "william",
    "jim": "james", "jimmy": "james", "jamie": "james", "mike": "michael", "mick": "michael", "dan": "daniel", "danny": "daniel", "dave": "david",
    "steve": "stephen steven", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "ted": "theodore edward", "teddy": "theodore", "theo": "theodore",
    "fred": "frederick", "freddie": "frederick", "greg": "gregory", "ken": "kenneth", "kenny": "kenneth", "len": "leonard", "lenny": "leonard",
    "nick": "nicholas", "nicky": "nicholas", "phil": "philip phillip", "sam": "samuel samantha", "sammy": "samuel", "vince": "vincent", "vinny": "vincent",
    "walt": "walter", "wally": "walter", "zack": "zachary", "zach": "zachary", "zak": "zachary", "chris": "christopher christine", "joe": "joseph", "joey": "joseph",
    "ben": "benjamin", "benny": "benjamin", "bernie": "bernard", "harry": "harold henry", "hal": "harold", "matt": "matthew", "andy": "andrew", "drew": "andrew",
    "alex": "alexandra alexander", "lexi": "alexandra", "sandra": "alexandra", "lexie": "alexandra", "deb": "deborah", "debbie": "deborah", "debra": "deborah",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "kathryn": "katherine", "cathy": "catherine katherine", "liz": "elizabeth", "beth": "elizabeth",
    "betsy": "elizabeth", "eliza": "elizabeth", "lizzie": "elizabeth", "sue": "susan", "suzy": "susan", "susie": "susan", "tilly": "matilda", "mattie": "matilda", "maggie": "margaret",
    "meg": "margaret", "peggy": "margaret", "marge": "margaret", "pat": "patricia patrick", "patty": "patricia", "tricia": "patricia", "trish": "patricia", "becky": "rebecca", "becca": "rebecca",
    "fran": "francine frances francis", "frannie": "francine", "lucy": "lucinda", "cindy": "lucinda", "ellie": "eleanor", "nell": "eleanor", "nora": "eleanor", "vicky": "victoria", "vicki": "victoria", "tori": "victoria",
    "gwen": "gwendolyn", "wendy": "gwendolyn", "izzy": "isadora", "dora": "isadora", "char": "charlotte", "lottie": "charlotte", "charlie": "charlotte charles", "rick": "richard", "dick": "richard", "rich": "richard",
    "jen": "jennifer", "jenny": "jennifer", "larry": "lawrence", "jerry": "gerald", "ron": "ronald", "don": "donald", "ed": "edward", "eddie": "edward", "chuck": "charles", "hank": "henry", "jack": "john", "johnny": "john", "peg": "margaret", "quin": "quentin", "quent": "quentin", "ollie": "olympia", "lanny": "orlando", "vonnie": "yvonne", "evie": "yvonne", "nadi": "nadia", "rene": "irene", "immy": "imogen", "urs": "ursula", "hec": "hector",
}

ABBREVIATED = {w: k for k, words in BUSINESS.items() for w in words.split()}
NICK = {k: tuple(v.split()) for k, v in NICKNAMES.items()}
TITLES = {"mr", "mrs", "ms", "mx", "dr", "prof", "hon", "atty"}
SUFFIXES = {"pe", "aia", "esq", "jr", "sr", "ii", "iii", "iv", "phd", "md", "cpa", "ra", "pls", "aicp"}
LONG_BUSINESS = [w for w in ABBREVIATED if len(w) >= 6]


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def osa(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance, most + 1 when it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before = last
    return min(row[-1], most + 1)


@lru_cache(100_000)
def business_of(word: str) -> str | None:
    """The line of business a word or its abbreviation stands for; one typo in a long word is let pass."""
    if word in ABBREVIATED:
        return ABBREVIATED[word]
    if len(word) >= 6:
        near = {ABBREVIATED[w] for w in LONG_BUSINESS if osa(word, w, 1) == 1}
        return near.pop() if len(near) == 1 else None
    return None


def parse(name: str | None) -> dict | None:
    """{core, initials, business, legal, joined} of a name; None for a null, blank or filler one.

    core: the words that tell the name, in the order surname-last; initials: single letters in writing
    order, a leading one first; business, legal: canonical words or None; joined: two names joined by
    an ampersand, "and" or a hyphen.
    """
    if name is None:
        return None
    text = re.sub(r"\s+", " ", plain(name)).strip()
    if text.strip(" .") in FILLERS:
        return None
    text = re.sub(r"\([^)]*\)", " ", text)
    text = re.sub(r"\s[-–]\s*(?:attn|attention|c/o|care of)\b.*$", " ", text)
    text = re.sub(r",?\s+et\.?\s+al\.?,?", " ", text)
    text = re.sub(r"\bl\.?\s?l\.?\s?c\b\.?", " llc ", text)
    text = re.sub(r"\bl\.\s?p\.|\bl p\b", " lp ", text)
    text = re.sub(r"limited\s+liability\s+company", " llc ", text)
    text = re.sub(r"limited\s+partnership", " lp ", text)
    text = text.replace("dev't", "devt")
    text = re.sub(r"^\s*the\s+", "", text)
    joined = bool(re.search(r"[a-z]\s*(?:&|\band\b)\s*[a-z]|[a-z]{3}-[a-z]{3}", text))
    head, comma, tail = text.partition(",")
    words_of = lambda t: re.findall(r"[a-z0-9]+", t.replace("'", "").replace("’", ""))
    first, second = words_of(head), words_of(tail)
    legal = next((LEGAL[w] for w in second + first[1:] if w in LEGAL), None)
    drop = lambda ws: [w for w in ws if w not in LEGAL and w not in ("and",)]
    first, second = drop(first), drop(second)
    second = [w for w in second if w not in SUFFIXES] if len(second) else second
    if comma and second:  # "Last, First M" and "Contractors, Bridgewharf Rivet"
        words = second + first
        turned = True
    else:
        words, turned = first, False
    words = [w for i, w in enumerate(words) if not (w in TITLES and i == 0)]
    while len(words) > 2 and words[-1] in SUFFIXES:
        words = words[:-1]
    business, core = None, []
    i = 0
    while i < len(words):
        two = business_of(words[i] + words[i + 1]) if i + 1 < len(words) else None
        if two and len(words[i]) > 1 and ABBREVIATED.get(words[i] + words[i + 1]) and two in ("designgroup", "landcompany", "planningservices", "autoglass", "realty"):
            business, i = business or two, i + 2
            continue
        # a word of business counts as such after two words of the name, or before them when a comma turned the order
        b = business_of(words[i]) if len(words[i]) > 1 else None
        left = sum(len(w) > 1 for w in core)
        if b and (left >= 1 or turned):
            business = business or b
        else:
            core.append(words[i])
        i += 1
    initials = [w for w in core if len(w) == 1]
    core = [w for w in core if len(w) > 1]
    if not core:
        return None
    if turned and len(core) > 1 and not business and not legal and len(first) == 1:
        pass  # words already stand as first, last
    return {"core": core, "initials": initials, "business": business, "legal": legal, "joined": joined}


def expansions(token: str) -> tuple[str, ...]:
    """The token and the full given names it may abbreviate."""
    return (token, *NICK.get(token, ()))


def near(a: str, b: str) -> bool:
    """One word in two writings: equal, a nickname of the other, or within one edit (two in words of nine letters or more)."""
    if a == b or set(expansions(a)) & set(expansions(b)):
        return True
    if min(len(a), len(b)) < 4:
        return False
    return osa(a, b, 2) <= (2 if min(len(a), len(b)) >= 9 else 1)


def merged(core: list[str]) -> list[tuple[str, ...]]:
    """The core as written and with each two neighbouring words run together, for names split in two."""
    out = [tuple(core)]
    if len(core) > 2:
        out += [tuple(core[:i] + [core[i] + core[i + 1]] + core[i + 2 :]) for i in range(len(core) - 1)]
    elif len(core) == 2:
        out.append((core[0] + core[1],))
    return out


def assigned(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether each word of a can have a near word of b of its own: a perfect matching by augmenting paths."""
    options = [[j for j, q in enumerate(b) if near(p, q)] for p in a]
    taken: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        for j in options[i]:
            if j not in tried:
                tried.add(j)
                if j not in taken or place(taken[j], tried):
                    taken[j] = i
                    return True
        return False

    return len(a) == len(b) and all(options) and all(place(i, set()) for i in range(len(a)))


def aligned(a: list[str], b: list[str]) -> bool:
    """Whether some assignment pairs all words of a with all of b, each pair being near; split words may be run together.

    Equal words count whatever their length; a single word in another writing needs six letters.
    """
    if sorted(a) == sorted(b):
        return True
    for x in merged(a):
        for y in merged(b):
            if x == y or len(x) == len(y) and (len(x) > 1 or len(x[0]) >= 6) and assigned(x, y):
                return True
    return False


def middles_agree(a: list[str], b: list[str]) -> bool:
    """Initials beside full names conflict only when both are stated and differ."""
    return not a or not b or a[-1] == b[-1]


def initials_fit(initials: list[str], surname: str, core: list[str], other: list[str]) -> bool:
    """Whether "Z. R. Surname" may abbreviate a full name: the surname is near its last word, the first initial begins its first."""
    if len(core) != 2 or not near(surname, core[-1]):
        return False
    starts = {w[0] for w in expansions(core[0])}
    return initials[0] in starts and (len(initials) < 2 or not other or initials[1] == other[-1])
