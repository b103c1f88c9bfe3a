"""Problem 2: personal data inside free text, found with its type and place and replaced.

Detection anchors on given names, titles, labels and number shapes and looks at the words around
them. Replacement is either a typed placeholder or a keyed surrogate of the same type, gender,
script and format. Numbers, letters and listed given names go through keyed permutations; for surnames,
streets, cities and hosts the corpus's distinct words are gathered in a table, and words that draw the
same surrogate are told apart there. So over the whole corpus one entity keeps one surrogate, and
different ones stay different.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import cut, spread

try:  # one pass over a text for all words that may begin a name
    import ahocorasick
except ImportError:
    ahocorasick = None

# Common given names by the gender they usually go with, titles, words that follow names of things.
FEMALE = set(
    "alexandra alice amanda amy andrea angela ann anna anne barbara beth betty brenda carol caroline carolyn catherine charlotte cheryl christine cindy claire cynthia deborah debbie diana diane donna dora"
    " dorothy eleanor elizabeth ellen ellie emily emma evelyn frances francine gloria gwen gwendolyn hannah heather helen imogen irene isabel isadora jane janet janice jean jennifer jessica joan"
    " joyce judith judy julia julie karen kate katherine kathleen kathryn kathy kelly kimberly laura lauren lexi linda lisa lori lucinda lucy margaret maggie maria marie martha mary matilda megan melissa michelle"
    " nadia nancy nicole olivia olympia pamela patricia peggy rachel rebecca becky ruth samantha sandra sarah sharon shirley sofia sophia stephanie susan sue tammy teresa theresa tilly tina ursula victoria virginia wendy yvonne".split()
)
MALE = set(
    "aaron adam alan albert alexander andrew anthony arthur benjamin ben bernard bill billy bob bobby brandon brian bruce bryan carl charles chris christopher craig dan daniel david dennis donald doug douglas"
    " edward eric ethan eugene frank fred frederick gabriel gary george gerald greg gregory hal harold harry hector henry howard isaac jack jacob james jason jeffrey jeremy jerry jesse jim joe joel john jonathan jordan jose joseph"
    " joshua juan justin keith ken kenneth kevin kyle larry lawrence len leonard logan louis luis marcus martin matthew michael mike nathan nicholas nick noah orlando oscar patrick paul peter phil philip phillip quentin ralph"
    " raymond richard robert roger ronald roy russell ryan sam samuel scott sean stephen steve steven ted terry theodore theo thomas tim timothy tom tony tyler vincent vince walt walter wayne william zachary zack zach".split()
)
TITLES = ("mr", "mrs", "ms", "mx", "dr", "prof", "professor", "commissioner", "councilmember", "councilor", "judge", "rev", "hon")
STREET_TYPES = "street|str|st|avenue|ave|av|road|rd|drive|dr|lane|ln|court|ct|boulevard|boul|blvd|parkway|pkwy|pky|place|pl|circle|cir|way|terrace|ter|trail|trl|highway|hwy|square|sq|loop|alley|plaza"
#: After a name these tell of a place or an organisation that bears it.
BORNE = set(
    "memorial library park school elementary middle high academy college university hospital center centre hall foundation family trust estate church bridge field stadium museum garden gardens creek"
    " llc inc corp lp ltd llp company co associates builders capital construction contractors design development engineering holdings homes investments land management planning properties realty architects partners group".split()
) | set(STREET_TYPES.split("|"))
#: Words before a comma that lead to a name and are none.
LEADS = set("signed sincerely regards respectfully attention attn trustee dear thanks by from owner applicant agent contact tenant resident neighbor witness respectively also and or commissioner member chair".split())
STOP = set("the a an of and or to in on at by for with from is are was were be has have had this that it not no never said asked wrote".split())

DIGIT = re.compile(r"[0-9]")
WORD_END = r"(?![\w])"
EMAIL = re.compile(
    r"(?<![\w.+%-])[\w.+%'-]+(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[A-Za-z0-9-]+)+", re.I)
PHONE = re.compile(r"(?<![\w.+/-])(?<!\d[ .-])(?:\+?1[ .-]?\(\d{3}\)\s?|\+1[ .-]?\d{3}[ .-]?|1[ .-]\d{3}[ .-]|\(\d{3}\)\s?|[2-9]\d{2}[ .-]?)[2-9]\d{2}[ .-]?\d{4}(?![\w]|[.-]\d|[ -]\d{3})")
NOT_PHONE = re.compile(r"(?:invoice|account|acct|meter|entry|receipt|parcel|record|webinar id|meeting id|id|case|permit|serial|book|page)\s*(?:no\.?|number|#|:)?\s*$", re.I)
SSN = re.compile(r"(?<![\w-])(\d{3})([- ])\d{2}\2\d{4}(?![\w-])")
BARE_ID = re.compile(r"(?<![\w-])\d{9}(?![\w-])")
ID_LABEL = re.compile(r"(?:\bssn|social security(?: number| no\.?)?|taxpayer[^.\d]{0,24}|not show the number|\bitin|\btin)\s*[:#]?\s*$", re.I)
DOCUMENT = re.compile(r"\b(?:passports?|driver'?s?'? licen[cs]e|driving licen[cs]e|\bdl)\s*(?:no\.?|number|num\.?|#|:)?\s*[:#]?\s*([A-Z]{0,2} ?\d[\dA-Z]{3,9}(?:-[\dA-Z]{3,6}){0,3})(?![\w])", re.I)
DIRECTION = r"(?:[NSEW]\.?|No\.?|So\.?|North|South|East|West)"
BOX = re.compile(r"(?<!\w)(?:P\.?\s?O\.?\s?|Post Office )Box\s+#?\d+", re.I)
STREET = re.compile(
    rf"(?<![\w.,:/$#-])\d{{1,6}}[A-Z]?\s+(?:{DIRECTION}\s+)?(?:[A-Z][\w'’-]*\s+){{1,3}}(?:{STREET_TYPES}){WORD_END}|(?<![\w.,:/$#-])\d{{1,6}}\s+(?:{DIRECTION}\s+)?\d{{1,3}}(?:st|nd|rd|th)\s+(?:{STREET_TYPES}){WORD_END}", re.I)
AFTER_STREET = re.compile(rf"\.?(?:\s+{DIRECTION}{WORD_END})?(?:,?\s*(?:(?:Suite|Ste\.?|Unit|Apt\.?|Apartment|Bldg\.?|Lot|#)\s*#?\w{{1,6}}))?(?:,\s*[A-Z][a-z]+(?: [A-Z][a-z]+)?(?:,\s*[A-Z]{{2}}\s+\d{{5}})?)?(?:,\s*[A-Z ]{{4,24}},\s*[A-Z]{{2}}\s+\d{{5}})?")
AFTER_BOX = re.compile(r"(?:,\s*[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)?(?:,\s*[A-Z]{2}\s+\d{5})?)?")
SURNAME = r"[A-Z](?:['’])?[A-Za-z]+(?:['’][A-Za-z]+)?(?:-[A-Z][A-Za-z'’]+)*"
FORWARD = re.compile(rf"(?: +[A-Z]\.?(?= ))? +({SURNAME})")
FORWARD_LOW = re.compile(r"(?: [a-z]\.?(?= ))? ([a-z](?:['’])?[a-z]+(?:-[a-z]+)*)")
BACKWARD = re.compile(rf"({SURNAME}),\s*$")
AFTER_TITLE = re.compile(rf"\.? +(?=((?:[A-Z]\. ?){{0,2}}{SURNAME}))")
INITIALS = re.compile(rf"(?<![\w.'’&/-])(?:[A-Z]\. ?){{1,2}}({SURNAME})")
MIDDLE = re.compile(r" [A-Z]\.?(?![\w'’])")
NEXT_WORD = re.compile(r"[ ]+([A-Za-z]+)")


def anchors():
    """All given names and titles in one automaton, or one pattern where the library is missing."""
    words = {**{w: "given" for w in FEMALE | MALE}, **{w: "title" for w in TITLES}}
    if ahocorasick:
        a = ahocorasick.Automaton()
        for w, k in words.items():
            a.add_word(w, (len(w), k))
        a.make_automaton()
        return lambda low: ((end - n + 1, end + 1, k) for end, (n, k) in a.iter(low))
    p = re.compile(r"[a-z]+")
    return lambda low: ((m.start(), m.end(), words[m[0]]) for m in p.finditer(low) if m[0] in words)


@lru_cache(1)
def anchored():
    return anchors()


def followed_by_thing(text: str, end: int) -> bool:
    m = NEXT_WORD.match(text, end)
    return bool(m) and m[1].lower() in BORNE and (m[1][0].isupper() or m[1].lower() in ("park", "library", "school"))


def detect(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of the items of a text in order, without overlaps; 0-based. Null and empty texts have none."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= s or a >= e for _, s, e in found)

    if "@" in text or "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        for m in EMAIL.finditer(text):
            a = m.start() + len(m[0]) - len(m[0].lstrip("'.-"))
            found.append(("email", a, m.end()))
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length with their case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if DIGIT.search(text):
        for m in BOX.finditer(text) if "box" in low else ():
            found.append(("address", m.start(), AFTER_BOX.match(text, m.end()).end()))
        for m in STREET.finditer(text):
            words = m[0].lower().split()[1:]
            if free(m.start(), m.end()) and STOP.isdisjoint(words) and len(words) >= 2:
                found.append(("address", m.start(), AFTER_STREET.match(text, m.end()).end()))
        for m in DOCUMENT.finditer(text) if "passport" in low or "licen" in low or "dl" in low else ():
            if free(m.start(1), m.end(1)):
                found.append(("id_number", m.start(1), m.end(1)))
        for m in BARE_ID.finditer(text):
            if ID_LABEL.search(text, max(0, m.start() - 48), m.start()) and free(m.start(), m.end()):
                found.append(("id_number", m.start(), m.end()))
        for m in SSN.finditer(text):
            if free(m.start(), m.end()):
                found.append(("id_number", m.start(), m.end()))
        for m in PHONE.finditer(text):
            if free(m.start(), m.end()) and not NOT_PHONE.search(text, max(0, m.start() - 24), m.start()):
                found.append(("phone", m.start(), m.end()))
    names: list[tuple[int, int]] = []
    n = len(text)
    for a, b, kind in anchored()(low):
        if (a and (low[a - 1].isalnum() or low[a - 1] in "_'’")) or (b < n and (low[b].isalnum() or low[b] in "_")):
            continue
        if a and low[a - 1] == "-" and a > 1 and low[a - 2].isalnum():
            continue
        if not free(a, b) or any(s <= a < e for s, e in names):
            continue
        if kind == "title":
            m = AFTER_TITLE.match(text, b)
            if m and text[a].isupper():
                s, e = m.start(1), m.end(1)
                first = m[1].split()[-1].lower()
                if first in FEMALE or first in MALE:  # the given name follows; it is an anchor itself
                    continue
                if free(s, e) and not followed_by_thing(text, e) and first not in STOP:
                    names.append((s, e))
            continue
        if text[a].isupper():
            # "Surname, Given" unless the word before the comma leads to the name
            m = BACKWARD.search(text, max(0, a - 40), a)
            if m and m[1].lower() not in LEADS and m[1].lower() not in STOP and free(m.start(), b) and not any(s < b and m.start(1) < e for s, e in names):
                mid = MIDDLE.match(text, b)
                end = mid.end() if mid else b
                if not followed_by_thing(text, end):
                    names.append((m.start(1), end))
                continue
            m = FORWARD.match(text, b)
            if m and m[1].lower() not in STOP and m[1].lower() not in BORNE and free(a, m.end()) and not followed_by_thing(text, m.end()):
                names.append((a, m.end()))
        else:
            m = FORWARD_LOW.match(text, b)
            if m and len(m[1]) > 3 and m[1] not in STOP and m[1] not in BORNE and free(a, m.end()) and text[a:b] in LOWER_SAFE:
                names.append((a, m.end()))
    for m in INITIALS.finditer(text):
        if free(m.start(), m.end()) and not any(s < m.end() and m.start() < e for s, e in names) and not followed_by_thing(text, m.end()) and m[1].lower() not in BORNE | STOP | {"box"}:
            before = text[max(0, m.start() - 8) : m.start()].rstrip()
            if not (before and before[-1].isdigit()) and not before.endswith((" No", "Passport")):
                names.append((m.start(), m.end()))
    found += [("name", s, e) for s, e in names]
    return sorted(found, key=lambda x: x[1])


#: Given names that are also common words are taken as names only in capitals.
LOWER_SAFE = (FEMALE | MALE) - {"bill", "bob", "dan", "sue", "grant", "may", "will", "frank", "jack", "jean", "joy", "mark", "rob", "ray", "art", "dick", "pat", "drew", "dean", "carol", "sandra", "jordan", "logan", "tim", "len", "hal", "dora", "martin", "scott", "ted", "tom", "nick", "sam", "ken", "phil", "jim", "joe", "gary", "harry", "terry", "wayne", "kelly", "ben", "walt", "vince", "tony"}


#: Copies of the table of surrogates that meet the texts, so a word of a third of all texts is met in several tasks.
SALTS = 8


def digest(key: str, text: str) -> int:
    return int.from_bytes(hmac.new(key.encode(), text.encode(), hashlib.sha256).digest()[:8], "big")


def shuffled_digits(key: str, digits: str) -> str:
    """A keyed permutation of the digit strings of one length (a Feistel network), so different numbers stay different."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + 1 + digest(key, "digit") % 9) % 10) if digits else digits
    h = n // 2
    a, b = digits[:h], digits[h:]
    for r in range(6):
        if r % 2 == 0:
            a = str((int(a) + digest(key, f"{r}|{n}|{b}")) % 10 ** len(a)).zfill(len(a))
        else:
            b = str((int(b) + digest(key, f"{r}|{n}|{a}")) % 10 ** len(b)).zfill(len(b))
    return a + b


def walked(key: str, digits: str, fits: Callable[[str], bool]) -> str:
    """The same permutation walked on until the result has the form that the digits have; again a permutation of such digits."""
    new = shuffled_digits(key, digits)
    while fits(digits) and not fits(new):
        new = shuffled_digits(key, new)
    return new


def is_phone(d: str) -> bool:
    """Ten digits whose area and exchange begin with 2 to 9."""
    return len(d) == 10 and d[0] > "1" and d[3] > "1"


def is_social(d: str) -> bool:
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def no_leading_zero(d: str) -> bool:
    return d[:1] != "0"


STARTS = "Al Ber Cor Dar El Far Gal Har Il Jor Kel Lor Mar Nor Or Per Quin Ros Sel Tor Ul Ver Wil Yor".split()
MIDDLES = "an be co da en fi go ha in ka lo ma na or pe ra si ta un va".split()
ENDS = "berg by dale den field ford gard ham ley man mere mond ner ridge sen shaw son stad ton vik wood".split()


@lru_cache(1)
def pool() -> tuple[str, ...]:
    """All words that the parts make, each once, in a fixed order."""
    return tuple(dict.fromkeys(a + b + c + d for a in STARTS for b in MIDDLES for c in MIDDLES for d in ENDS))


def made_word(slot: int, turn: int) -> str:
    """The word of a slot; later turns of one slot get further parts behind hyphens, so no two (slot, turn) share a word."""
    parts = [pool()[slot]]
    while turn > 0:
        turn, part = divmod(turn - 1, len(ENDS))
        parts.append(ENDS[part].capitalize())
    return "-".join(parts)


def slot_of(key: str, kind: str, word: str) -> int:
    return digest(key, f"{kind}|{word}") % len(pool())


def cased(new: str, like: str) -> str:
    return new.upper() if like.isupper() and len(like) > 1 else new.lower() if like.islower() else new[:1].upper() + new[1:]


@lru_cache(4096)
def letter_order(key: str, base: int, category: str) -> dict[str, str]:
    """A keyed permutation of the letters of one category in a block of 32 characters; none stays itself where there are two or more."""
    letters = [chr(base + j) for j in range(32) if unicodedata.category(chr(base + j)) == category]
    mixed = sorted(letters, key=lambda c: digest(key, f"letter|{c}"))
    return {c: mixed[(i + 1) % len(mixed)] for i, c in enumerate(mixed)}


def other_letters(key: str, word: str) -> str:
    """A word with every letter permuted within its block and category; marks, script and length stay, different words stay different."""
    return "".join(letter_order(key, ord(c) & ~0x1F, unicodedata.category(c)).get(c, c) if c.isalpha() else c for c in word)


@lru_cache(64)
def given_order(key: str) -> dict[str, str]:
    """A keyed permutation of the listed given names, those of one gender among themselves."""
    out: dict[str, str] = {}
    for names in (FEMALE, MALE - FEMALE):
        mixed = sorted(names, key=lambda n: digest(key, f"given|{n}"))
        out |= {n: mixed[(i + 1) % len(mixed)] for i, n in enumerate(mixed)}
    return out


#: What stands in an address and is no name of a street or city.
KEPT_WORDS = set(STREET_TYPES.split("|")) | {"n", "s", "e", "w", "no", "so", "north", "south", "east", "west", "p", "o", "po", "box", "post", "office", "suite", "ste", "unit", "apt", "apartment", "bldg", "lot", "st", "nd", "rd", "th"}
WORDS = re.compile(r"[^\W\d_]+")


def kind_of(word: str) -> str:
    return "given" if word.lower() in FEMALE or word.lower() in MALE else "surname"


def email_parts(text: str) -> tuple[str, str, str]:
    return re.match(r"(.*?)(\s?(?:@|[\[(]\s?at\s?[\])])\s?)(.*)", text, re.I | re.S).groups()


def words_needed(kind: str, text: str) -> list[tuple[str, str]]:
    """(kind, word) of the words of an item whose surrogates the corpus's table gives; ascii words of two letters or more, in lower case."""
    names = lambda t: [("surname", w.lower()) for w in WORDS.findall(t) if len(w) > 1 and w.isascii() and kind_of(w) == "surname"]
    if kind == "name":
        return names(text)
    if kind == "email":
        local, _, domain = email_parts(text)
        return [*names(local), ("host", host_label(domain))]
    if kind == "address":
        return [("place", w.lower()) for w in place_words(text)]
    return []


def host_label(domain: str) -> str:
    return re.split(r"\.|\s?[\[(]\s?dot\s?[\])]\s?", domain, maxsplit=1)[0].lower()


def place_words(text: str) -> list[str]:
    """The words of an address that name a street or a city; a state's two letters stay."""
    return [m[0] for m in WORDS.finditer(text) if m[0].isascii() and m[0].lower() not in KEPT_WORDS and len(m[0]) > 2]


class Surrogates:
    """Replacements by a key and a table {(kind, word): surrogate} of the corpus's words; a word outside the table takes its slot's first one."""

    def __init__(self, key: str, table: dict[tuple[str, str], str]) -> None:
        self.key, self.table = key, table

    def word(self, kind: str, word: str) -> str:
        low = word.lower()
        if not word.isascii():
            return other_letters(self.key, word)
        if len(word) == 1:
            return cased(letter_order(self.key, 0x60, "Ll").get(low, low), word if word.islower() else word + word)
        if kind == "given":
            return cased(given_order(self.key)[low], word)
        return cased(self.table.get((kind, low)) or made_word(slot_of(self.key, kind, low), 0), word)

    def name(self, text: str) -> str:
        return WORDS.sub(lambda m: self.word(kind_of(m[0]), m[0]), text)

    def digits(self, text: str, keep: int, fits: Callable[[str], bool]) -> str:
        digits = re.sub(r"\D", "", text)
        new = iter(digits[:keep] + walked(self.key, digits[keep:], fits))
        return re.sub(r"\d", lambda _: next(new), text)

    def email(self, text: str) -> str:
        local, sep, domain = email_parts(text)
        label = host_label(domain)
        head = WORDS.sub(lambda m: self.word(kind_of(m[0]), m[0]), local)
        head = re.sub(r"\d+", lambda m: shuffled_digits(self.key, m[0]), head)
        new = self.table.get(("host", label)) or made_word(slot_of(self.key, "host", label), 0)
        return head + sep + cased(new.replace("-", ""), domain[: len(label)]) + domain[len(label) :]

    def address(self, text: str) -> str:
        named = iter(place_words(text))
        following = next(named, None)

        def one(m: re.Match) -> str:
            nonlocal following
            if m[0] != following:
                return m[0]
            following = next(named, None)
            return self.word("place", m[0])

        text = re.sub(r"\d+", lambda m: walked(self.key, m[0], no_leading_zero), text)
        return WORDS.sub(one, text)

    def replace(self, kind: str, text: str) -> str:
        if kind == "phone":
            digits = re.sub(r"\D", "", text)
            return self.digits(text, 1 if len(digits) == 11 and digits[0] == "1" else 0, is_phone)
        if kind == "id_number":
            order = letter_order(self.key, 0x60, "Ll")
            letters = re.sub(r"[A-Za-z]", lambda m: cased(order[m[0].lower()], m[0] + m[0] if m[0].isupper() else m[0]), text)
            return self.digits(letters, 0, is_social)
        return {"email": self.email, "name": self.name, "address": self.address}[kind](text)


def table_of(key: str, words: Iterable[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """The table of a corpus small enough for one place; surrogate_table makes the same one for any corpus."""
    slots: dict[tuple[str, int], list[tuple[int, str]]] = {}
    for kind, word in set(words):
        slots.setdefault((kind, slot_of(key, kind, word)), []).append((digest(key, f"turn|{kind}|{word}") >> 1, word))
    return {(kind, w): made_word(slot, i) for (kind, slot), ws in slots.items() for i, (_, w) in enumerate(sorted(ws))}


PLACEHOLDER = {"email": "EMAIL", "phone": "PHONE", "id_number": "ID_NUMBER", "address": "ADDRESS", "name": "NAME"}


def redact(text: str | None, key: str, table: dict[tuple[str, str], str] | None = None) -> tuple[str | None, str | None]:
    """(text with typed placeholders, text with surrogates). Equal items of a text share a numbered placeholder; null stays null.

    Without a table the text is a corpus of its own.
    """
    if text is None:
        return None, None
    spans = detect(text)
    if table is None:
        table = table_of(key, [w for kind, start, end in spans for w in words_needed(kind, text[start:end])])
    s, numbers, a, b, at = Surrogates(key, table), {}, [], [], 0
    for kind, start, end in spans:
        item = text[start:end]
        same = (kind, re.sub(r"\W", "", item.lower()))
        numbers.setdefault(same, 1 + sum(k == kind for k, _ in numbers))
        a += [text[at:start], f"[{PLACEHOLDER[kind]}_{numbers[same]}]"]
        b += [text[at:start], s.replace(kind, item)]
        at = end
    return "".join([*a, text[at:]]), "".join([*b, text[at:]])


def texts_of(investigation: DataFrame, identity: DataFrame) -> DataFrame:
    """(evidence_id, text) of both evidence tables."""
    return investigation.select("evidence_id", F.col("evidence_text").alias("text")).union(identity.select("evidence_id", F.col("snippet").alias("text")))


def items(texts: DataFrame) -> DataFrame:
    """(evidence_id, pii_type, start_pos, length), distinct; start_pos is 1-based. Null and empty texts give no rows.

    Each text is read where it lies; only found items travel, so an id that holds many rows costs no more than its items.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, k, s + 1, e - s) for i, t in zip(b["evidence_id"], b["text"], strict=True) for k, s, e in detect(t)]
            yield pd.DataFrame(out, columns=["evidence_id", "pii_type", "start_pos", "length"])

    some = spread(texts.where(F.col("evidence_id").isNotNull() & (F.length("text") > 0)))
    return some.mapInPandas(run, "evidence_id long, pii_type string, start_pos int, length int").distinct()


def needed(texts: DataFrame) -> DataFrame:
    """(row, kind, word): the words of each text's items whose surrogates come from the table, each once per text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {(row, *w) for row, t in zip(b["row"], b["text"], strict=True) if isinstance(t, str) for kind, s, e in detect(t) for w in words_needed(kind, t[s:e])}
            yield pd.DataFrame(list(out), columns=["row", "kind", "word"])

    return spread(texts.select("row", "text").where(F.length("text") > 0)).mapInPandas(run, "row long, kind string, word string")


def surrogate_table(words: DataFrame, key: str) -> DataFrame:
    """(kind, word, surrogate) of distinct words (kind, word): words that draw one slot take turns in a keyed order, so no two of a kind share a surrogate."""

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(slot=[slot_of(key, k, w) for k, w in zip(b["kind"], b["word"], strict=True)], place=[digest(key, f"turn|{k}|{w}") >> 1 for k, w in zip(b["kind"], b["word"], strict=True)])

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["kind", "word"]].assign(surrogate=[made_word(s, t) for s, t in zip(b["slot"], b["turn"], strict=True)])

    slots = words.select("kind", "word").distinct().mapInPandas(drawn, "kind string, word string, slot long, place long")
    turns = slots.withColumn("turn", F.row_number().over(Window.partitionBy("kind", "slot").orderBy("place", "word")) - 1)
    return turns.mapInPandas(made, "kind string, word string, surrogate string")


def with_tables(texts: DataFrame, key: str) -> DataFrame:
    """texts (evidence_id, text), distinct, with the part of the corpus's table that each needs. Words meet the table over salted copies of it; texts move once."""
    rows = texts.select("evidence_id", "text").withColumn("row", F.xxhash64("evidence_id", "text"))
    words = cut(needed(rows).distinct())
    table = surrogate_table(words, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = words.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(table, ["kind", "word", "salt"])
    own = met.groupBy("row").agg(F.collect_list(F.struct("kind", "word", "surrogate")).alias("own"))
    return rows.dropDuplicates(["row"]).join(own, "row", "left").select("evidence_id", "text", "own")


def own_table(own) -> dict[tuple[str, str], str]:
    return {(x["kind"], x["word"]): x["surrogate"] for x in own} if own is not None else {}


def redacted(texts: DataFrame, key: str) -> DataFrame:
    """(evidence_id, placeholder_text, surrogate_text) of every distinct row; one entity has one surrogate in all texts, different ones have different ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [redact(t if isinstance(t, str) else None, key, own_table(o)) for t, o in zip(b["text"], b["own"], strict=True)]
            yield pd.DataFrame({"evidence_id": b["evidence_id"], "placeholder_text": [x for x, _ in both], "surrogate_text": [y for _, y in both]})

    return with_tables(texts, key).mapInPandas(run, "evidence_id long, placeholder_text string, surrogate_text string")


def surrogate_faults(texts: DataFrame, key: str) -> DataFrame:
    """(pii_type, shared, split) over the whole corpus: surrogates that two entities share, and entities that have two surrogates.

    An entity is an item's letters and digits without case; phones and numbers count by their digits and letters alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bare = lambda t: re.sub(r"[\W_]", "", t.lower())
        for b in batches:
            out = []
            for t, o in zip(b["text"], b["own"], strict=True):
                if isinstance(t, str):
                    s = Surrogates(key, own_table(o))
                    out += [(k, bare(t[x:y]), bare(s.replace(k, t[x:y]))) for k, x, y in detect(t)]
            yield pd.DataFrame(out, columns=["pii_type", "entity", "surrogate"])

    pairs = cut(with_tables(texts, key).mapInPandas(run, "pii_type string, entity string, surrogate string").distinct())
    shared = pairs.groupBy("pii_type", "surrogate").agg(F.count("*").alias("n")).groupBy("pii_type").agg(F.count_if(F.col("n") > 1).alias("shared"))
    split = pairs.groupBy("pii_type", "entity").agg(F.count("*").alias("n")).groupBy("pii_type").agg(F.count_if(F.col("n") > 1).alias("split"))
    return shared.join(split, "pii_type")
