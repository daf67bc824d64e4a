"""Personal information inside free text, and its replacement by typed placeholders.

Method: format-preserving Feistel pseudonyms.  A number is brought to its canonical form first (a phone number to country
code and national digits, an identity number to its digits and letters), checked by the rules of its format, permuted by
a keyed Feistel network, and written back into the layout it was found in.  So every spelling of one value has one
pseudonym in every document, and different values have different ones.  The permutation stays within the numbers that
the format's rules judge alike: a valid number becomes a valid one (check characters included), one that fails them
becomes one that fails.  Dates are permuted within the calendar.  Values without a format (names, mail addresses, street
addresses) get a keyed 128-bit code.

Defined cases
-------------
* Null, empty and blank texts hold nothing; the masked text of a null is null.  Very long texts are read whole.
* One row for each kind that occurs in a text; repeated rows of a record give one.  Ties of overlapping finds go to
  the earlier, then the longer one, then in the order of ``KINDS``.
* A number that fails its format's check is personal all the same: people mistype.
* Technical identifiers, hosts, git remotes, versions, ticket and order numbers aren't personal.
* A national phone number without its country code can't be told to be the one with it, but for a leading Russian 8.
* First names are a parameter, taken from the users table; a name is also found by initials, by its introduction and by
  its title.  Up to ``MAX_NAMES`` names go to every task, beyond that the names in each text are found by a join.
* Empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.sized import distinct_wide
from quarryline.session import cut_lineage, spread

KINDS = ("email", "id_number", "phone", "address", "name", "date")
MAX_NAMES = 500_000
_L, _U, _A = r"a-zà-öø-ÿßа-яё", r"A-ZÀ-ÖØ-ÞА-ЯЁ", r"A-Za-zÀ-ÖØ-öø-ÿßА-Яа-яЁё"

_AT, _DOT = r"(?:@|\s?[\[({]\s?(?:at|собака|arroba)\s?[\])}]\s?)", r"(?:\.|\s?[\[({]\s?(?:dot|точка|punkt|punto)\s?[\])}]\s?)"
_EMAIL = re.compile(rf"(?<![\w/:.+-])(?P<v>[\w][\w.+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}})(?![\w@]|:[\w/~])", re.I)
_ID_WORD = (
    r"(?:ssn|social security(?: number| no\.?)?|national[ _-]?(?:id|insurance)(?:[ _](?:card|number|no\.?))?|ni number|nino|id[ _-]?(?:card|number|no\.?)|passport(?:[ _](?:number|no\.?))?|driv(?:er|ing)(?:'?s)?[ _-]?licen[cs]e(?: (?:number|no\.?))?"
    r"|tax[ _-]?(?:id|number)|tin|doc(?:ument)?(?:_(?:no|id|number))?|паспорт(?:а|е)?|инн|снилс|удостоверени[ея]|водительск\w+ (?:права|удостоверени\w+)|полис(?: омс)?|dni|nie|nif|pasaporte|n[úu]mero de identidad"
    r"|personalausweis|ausweis|reisepass|f[üu]hrerschein|steuer-?(?:id|nummer)|sozialversicherungsnummer)"
)
_ID_KEYED = re.compile(
    rf"(?<![A-Za-zА-Яа-яЁё]){_ID_WORD}[-\s\"'=:]*(?:(?:no|nr|num|núm|n)\.?[ºo]?|number|nummer|номер|№|#)?[\s\"'=:#№.-]*(?P<v>(?:серия\s*)?(?:[A-Z]{{1,3}}[ -]?)?\d(?:[\d -]*\d)?(?:\s*(?:номер|№)\s*\d+)?(?:[ -]?[A-Z]\b)?)",
    re.I,
)
_IDS = [
    re.compile(r"(?<![\w.-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-]|\.\d)"),  # social security
    re.compile(r"(?<![\w.-])(?P<v>\d{3}-\d{3}-\d{3}[ -]\d{2})(?![\w-]|\.\d)"),  # insurance account
    re.compile(r"(?<![\w.-])(?P<v>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?!\w)"),  # national insurance
    re.compile(r"(?<![\w.-])(?P<v>[A-Z]\d{3}-\d{4}-\d{4})(?![\w-])"),  # driver's licence
    re.compile(r"(?<![\w.-])(?P<v>серия\s*\d{2}\s?\d{2}\s*(?:номер|№)\s*\d{6})(?!\d)", re.I),
]
_EXT = r"(?:\s*(?:ext\.?|x|доб\.?|extension|#)\s*\d{1,5})?"
_PHONES = [
    re.compile(rf"(?<![\w.+-])(?P<v>\+\d{{1,3}}(?:[\s.-]?\(?\d{{1,5}}\)?){{2,6}}{_EXT})(?![\w-]|\.\d)"),
    re.compile(rf"(?<![\w.+-])(?P<v>00\d{{1,3}}(?:[ -]\d{{2,5}}){{2,5}}{_EXT})(?![\w-]|\.\d|:\d)"),
    re.compile(rf"(?<![\w.+-])(?P<v>8[\s-]?\(?\d{{3}}\)?[\s-]?\d{{3}}[\s-]?\d{{2}}[\s-]?\d{{2}}{_EXT})(?![\w-]|\.\d|:\d)"),
    re.compile(rf"(?<![\w.+-])(?P<v>\(\d{{3}}\)[ .-]?\d{{3}}[ .-]\d{{4}}{_EXT})(?![\w-]|\.\d|:\d)"),
    re.compile(rf"(?<![\w.+-])(?P<v>\d{{3}}([.-])\d{{3}}\2\d{{4}}{_EXT})(?![\w-]|\.\d|:\d)"),
    re.compile(r"(?<![\w.+-])(?P<v>\d{3}-\d{4}\s*(?:ext\.?|x|доб\.?)\s*\d{1,5}|555-\d{4})(?![\w-]|\.\d|:\d)"),
    re.compile(rf"(?<![\w.+-])(?P<v>0\d{{2,4}}[ /]\d{{3,5}}(?:[ -]\d{{2,5}}){{0,2}}{_EXT})(?![\w-]|\.\d|:\d)"),
    re.compile(rf"(?:\b(?:tel|phone|mobile|telefon|teléfono|móvil|handy|call me on|cell)|(?<!\w)(?:тел|телефон|моб|звоните))\b[.:\"'= ]{{1,5}}(?P<v>\+?\(?\d(?:[\d ()./-]{{5,18}})\d{_EXT})(?![\w-]|\.\d)", re.I),
]
_NUM = r"\d{1,5}[A-Za-zА-Яа-я]?(?:[/-]\d{1,4}[A-Za-zА-Яа-я]?)?"
_STREET_EN = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|court|ct|square|sq|close|terrace|way|place|pl|crescent|row|hill|gardens|mews|parade|highway|hwy|walk|grove)"
_ADDRESSES = [
    re.compile(rf"(?<![\w.:])(?P<v>(?:(?:flat|apt|unit|suite)\.? ?\d+\w?,? )?\d{{1,5}}[A-Za-z]?,? (?:[NSEW]\.? )?(?:[{_U}][\w'’-]+ ){{1,3}}(?i:{_STREET_EN})\b\.?)(?!\s*=|\s+(?i:map|tile|layer))"),
    re.compile(rf"(?<![\w.:])(?P<v>(?:(?:flat|apt|unit|suite)\.? ?\d+\w?,? )?\d{{1,5}}[a-z]? (?:[nsew]\.? )?(?:[a-z][a-z'’-]{{2,}} ){{1,2}}(?:street|road|avenue|lane|drive|boulevard|st\.|ave\.|rd\.))(?=[\s,.;!?]|$)(?!\s+(?:map|tile|layer))"),
    re.compile(rf"(?<![\w])(?P<v>(?i:ул(?:ица)?|пр(?:осп(?:ект)?|-т)?|пер(?:еулок)?|наб(?:ережная)?|бульвар|б-р|шоссе|проезд|пл(?:ощадь)?)\.?\s+(?:[\w-]+\s){{0,2}}?[{_A}0-9-]+,?\s+(?:(?:д|дом)\.?\s*)?{_NUM}(?:,?\s*(?:корп|к|стр|кв)\.?\s*\d+)*)"),
    re.compile(rf"(?<![\w])(?P<v>[{_A}-]+(?:\s[{_A}-]+)?\s(?i:улица|проспект|переулок|набережная|бульвар|шоссе|проезд|площадь|тракт),?\s+(?:(?:д|дом)\.?\s*)?{_NUM}(?:,?\s*(?:корп|к|стр|кв)\.?\s*\d+)*)", re.I),
    re.compile(rf"(?<![\w-])(?P<v>(?:[{_U}{_L}][{_A}-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|ring|steig|chaussee)|(?:[{_U}][{_L}]+ )(?:Straße|Strasse|Str\.|Gasse|Weg|Allee|Platz|Ufer|Damm|Ring))\s+\d{{1,4}}\s?[a-z]?)(?![\w.]\d)", re.I),
    re.compile(rf"(?<![\w])(?P<v>(?:calle|c/|avenida|avda?\.?|plaza|pza\.?|paseo|camino|ronda|carretera|travesía|callejón|glorieta|vía)\s+(?:(?:de|del|la|las|los|el)\s+)*[{_A}-]+(?:\s(?:de|del|la|las|los|el|y)\s[{_A}-]+|\s[{_U}][{_L}]+)*,?\s+(?:n\.?[ºo°]?\s*)?\d{{1,4}}(?:\s?[A-Za-z]\b)?)", re.I),
]
_DATE = re.compile(r"(?:\b(?:born(?: on)?|dob|date of birth|birth ?date|geboren am|geb\.|nacid[oa] el|fecha de nacimiento)|дата рождения|родил(?:ся|ась))[\s:=]*(?P<v>(?:19|20)\d{2}-\d{2}-\d{2}|\d{2}[./]\d{2}[./](?:19|20)\d{2})", re.I)
_WORD = rf"[{_U}{_L}](?:[{_A}'’-]*[{_A}])?"
_INITIAL = re.compile(rf"(?<![\w.])(?P<v>(?:[{_U}]\.\s?){{1,2}}[{_U}][{_L}{_U}'’-]{{3,}})(?![\w(.]*[(_])(?!\s+(?i:{_STREET_EN})\b)")
_TURNED = re.compile(rf"(?<![\w.])(?P<v>[{_U}][{_A}'’-]{{2,}}\s(?:[{_U}]\.\s?){{1,2}})(?=[\s,;:!?)\"'.]|$)")
_PAIR = re.compile(rf"(?<![\w.@/\\-])({_WORD})(\s+|,\s+)(?=({_WORD})(?![\w@/\\(]|\.\w))")


_WORDS2 = rf"[{_U}][{_L}'’-]+(?:\s[{_U}][{_L}'’-]+){{1,2}}"
#: What introduces a person by name, whoever it is.
_INTRODUCED = re.compile(rf"(?:(?i:\bmy name is|\bi am called|\bich heiße|\bmein name ist|\bme llamo|\bmi nombre es|меня зовут)\s+|\b(?:Mr|Mrs|Ms|Dr|Herrn?|Frau|Sr|Sra|Señora?|Prof)\.?\s+|(?<!\w)(?:г-н|г-жа|госпожа|господин)\s+)(?P<v>{_WORDS2})(?![\w@/\\(]|\.\w)")


_GREETINGS = frozenset("thanks regards cheers best sincerely hi hello dear hey gruß grüße hallo danke saludos atentamente hola gracias уважением спасибо привет здравствуйте bitte please".split())


class Finder:
    def __init__(self, first_names: list[str] | None):
        self.first = {n.strip().casefold() for n in first_names or () if n and len(n.strip()) > 1}

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """Ascending (start, end, kind) without overlaps."""
        if not text or not text.strip():
            return []
        out: list[tuple[int, int, str]] = []
        if "@" in text or re.search(r"[\[({]\s?(?:at|собака|arroba)\s?[\])}]", text, re.I):
            for m in _EMAIL.finditer(text):
                local = m.group("v").split("@")[0].lower()
                if local not in ("git", "svn", "hg") and not self._in_url(text, m.start("v")):
                    out.append((m.start("v"), m.end("v"), "email"))
        if any(c.isdigit() for c in text):
            for p in _IDS:
                out += [(m.start("v"), m.end("v"), "id_number") for m in p.finditer(text)]
            for m in _ID_KEYED.finditer(text):
                digits = sum(c.isdigit() for c in m.group("v"))
                if 6 <= digits <= 14:
                    out.append((m.start("v"), m.end("v"), "id_number"))
            for p in _PHONES:
                for m in p.finditer(text):
                    digits = sum(c.isdigit() for c in re.split(r"(?i)ext|x|доб", m.group("v"))[0])
                    if 7 <= digits <= 15 and (digits >= 9 or "-" in m.group("v")):
                        out.append((m.start("v"), m.end("v"), "phone"))
            for p in _ADDRESSES:
                out += [(m.start("v"), m.end("v"), "address") for m in p.finditer(text)]
            out += [(m.start("v"), m.end("v"), "date") for m in _DATE.finditer(text)]
        out += self._names(text)
        out = [(s, self._trim(text, s, e), kind) for s, e, kind in out]
        return self._settle(out)

    @staticmethod
    def _trim(text: str, s: int, e: int) -> int:
        """The end without a closing mark that was opened before the start."""
        while e > s and (text[e - 1] in "'’,;" or text[e - 1] == ")" and text.count("(", s, e) < text.count(")", s, e)):
            e -= 1
        return e

    @staticmethod
    def _in_url(text: str, at: int) -> bool:
        start = max(text.rfind(c, 0, at) for c in " \n\t\"'<") + 1
        return "://" in text[start:at]

    def _names(self, text: str) -> list[tuple[int, int, str]]:
        out = []
        for m in _INITIAL.finditer(text):
            if not re.search(r"\d[A-Za-z]?,? $", text[max(0, m.start() - 8) : m.start()]):
                out.append((m.start("v"), m.end("v"), "name"))
        out += [(m.start("v"), m.end("v"), "name") for m in _INTRODUCED.finditer(text)]
        if not self.first:
            return out
        for m in _PAIR.finditer(text):
            a, gap, b = m.group(1), m.group(2), m.group(3)
            fold_a, fold_b = a.casefold(), b.casefold()
            if gap[0] == ",":
                if "\n" not in gap and fold_a not in _GREETINGS and fold_b in self.first and fold_a not in self.first and a[0].isupper() == b[0].isupper() and len(a) > 3:
                    out.append((m.start(1), m.end(3), "name"))
            elif fold_a in self.first and len(b) > 3 and (b[0].isupper() or not a[0].isupper()) and "\n" not in gap:
                out.append((m.start(1), m.end(3), "name"))
            elif fold_b in self.first and fold_a not in self.first and len(a) > 3 and a[0].isupper() and b[0].isupper() and a.isupper() != b.istitle() and _SURNAME.search(a):
                out.append((m.start(1), m.end(3), "name"))
        out += [(m.start("v"), m.end("v"), "name") for m in _TURNED.finditer(text) if _SURNAME.search(m.group("v").split()[0])]
        return out

    @staticmethod
    def _settle(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        for s, e, kind in sorted(set(found), key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
            if out and s < out[-1][1]:
                # An id or an address that begins inside a shorter phone find is the better reading of it.
                if kind in ("id_number", "address") and out[-1][2] == "phone" and e > out[-1][1]:
                    out[-1] = (s, e, kind)
                continue
            out.append((s, e, kind))
        return out


#: Endings of family names, for forms without another sign.
_SURNAME = re.compile(r"(?:ов|ова|ев|ева|ин|ина|енко|ский|ская|цкий|цкая|ук|юк|чук|ик|ун|унов|унова|ян|дзе|швили|son|sen|berg|man|mann|stein|ez)$", re.I)


class Pseudonyms:
    """Keyed permutations within a format."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, n: int, tweak: str, value: int, size: int) -> int:
        h = hashlib.blake2b(f"{n}|{tweak}|{value}|{size}".encode(), key=self.key, digest_size=16)
        return int.from_bytes(h.digest(), "big")

    def permute(self, value: int, radix_a: int, radix_b: int, tweak: str) -> int:
        """A Feistel permutation of 0 .. radix_a * radix_b - 1, seen as pairs."""
        a, b = divmod(value, radix_b)
        for n in range(8):
            if n % 2:
                b = (b + self._round(n, tweak, a, radix_b)) % radix_b
            else:
                a = (a + self._round(n, tweak, b, radix_a)) % radix_a
        return a * radix_b + b

    def within(self, text: str, tweak: str, alike) -> str:
        """``text`` of digits and capital letters permuted among those of its shape for which ``alike`` says the same.

        Walking the cycle of a permutation until the judgement is the same again permutes within the judged class.
        """
        judged, out = alike(text), text
        while True:
            out = self._turn(out, tweak)
            if alike(out) == judged:
                return out

    def _turn(self, text: str, tweak: str) -> str:
        for alphabet in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            places = [i for i, c in enumerate(text) if c in alphabet]
            if not places:
                continue
            n = len(alphabet)
            value = 0
            for i in places:
                value = value * n + alphabet.index(text[i])
            half = len(places) // 2
            value = self.permute(value, n ** (len(places) - half), n**half, f"{tweak}|{''.join('#' if c in alphabet else c for c in text)}")
            chars = list(text)
            for i in reversed(places):
                value, d = divmod(value, n)
                chars[i] = alphabet[d]
            text = "".join(chars)
        return text

    def number(self, text: str, tweak: str) -> str:
        """The identity number in ``text`` permuted within its format, in the layout of ``text``."""
        places, plain = canonical(text)
        check = id_check(plain)
        if check is None:
            return laid_out(text, places, self.within(plain, tweak, lambda _: True))
        name, body, complete, plausible = check
        judged = complete(plain[:body]) == plain and plausible(plain)
        if judged:
            # The check characters follow from the rest: that is permuted, and they are made anew.
            return laid_out(text, places, complete(self.within(plain[:body], f"{tweak}|{name}", lambda x: plausible(complete(x)))))
        return laid_out(text, places, self.within(plain, f"{tweak}|{name}|fails", lambda x: (id_check(x) or ("",))[0] == name and not (complete(x[:body]) == x and plausible(x))))

    def phone(self, text: str) -> str:
        """The phone number in ``text`` permuted within its numbering plan, in the layout of ``text``."""
        m = _EXTENSION.search(text)
        main, tail = (text[: m.start()], m) if m else (text, None)
        places = [i for i, c in enumerate(main) if c.isascii() and c.isdigit()]
        plain = "".join(main[i] for i in places)
        code, skip = phone_code(main.lstrip(), plain)
        rest = plain[skip:]
        american = code == "1" or not code and len(rest) == 10 and not rest.startswith("0")
        alike = (lambda x: x[:1] > "1" and x[3:4] > "1") if american and len(rest) == 10 else (lambda x: x[:1] == "0")
        out = laid_out(main, places[skip:], self.within(rest, f"phone|{code}", alike)) if rest else main
        return out + (tail.group(1) + self.within(tail.group(2), "extension", lambda _: True) if tail else "")

    def day(self, text: str) -> str:
        """A calendar date permuted within 1900 to 2099, in its own notation."""
        parts = [int(x) for x in re.split(r"[-./]", text)]
        iso = "-" in text
        try:
            d = date(*parts) if iso else date(parts[2], parts[1], parts[0])
        except ValueError:
            return self.number(text, "date")
        low, days = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()
        v = d.toordinal() - low
        while True:  # cycle walking: the pair domain is a little larger than the days
            v = self.permute(v, 271, 271, "date")
            if v < days:
                break
        d = date.fromordinal(low + v)
        return d.isoformat() if iso else d.strftime(f"%d{text[2]}%m{text[2]}%Y")

    def code(self, text: str, kind: str) -> str:
        norm = " ".join(re.sub(r"[^\w@.+]+", " ", text.casefold()).split())
        return hashlib.blake2b(f"{kind}|{norm}".encode(), key=self.key, digest_size=16).hexdigest()

    def of(self, text: str, kind: str) -> str:
        if kind == "date":
            return self.day(text)
        if kind == "phone":
            return self.phone(text)
        if kind == "id_number":
            return self.number(text, "id")
        return self.code(text, kind)


def canonical(text: str) -> tuple[list[int], str]:
    """Places and text of the digits and Latin letters of an identity number; words of a layout (``No``) aren't part of it."""
    skip = {i for m in re.finditer(r"(?i)\b(?:no|nr|num|number|nummer)\b", text) for i in range(*m.span())}
    places = [i for i, c in enumerate(text) if c.isascii() and c.isalnum() and i not in skip]
    return places, "".join(text[i] for i in places).upper()


def laid_out(text: str, places: list[int], plain: str) -> str:
    chars = list(text)
    for i, c in zip(places, plain):
        chars[i] = c.lower() if text[i].islower() else c
    return "".join(chars)


_EXTENSION = re.compile(r"(\s*(?:ext\.?|x|доб\.?|extension|#)\s*)(\d{1,5})$", re.I)
#: Country codes of one and two digits (fixed values of the numbering plan); all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone_code(text: str, plain: str) -> tuple[str, int]:
    """(country code, digits before the national number) of a phone number; "" and 0 where none is written."""
    if text.startswith("+"):
        skip = 0
    elif plain.startswith("00"):
        skip = 2
    elif plain.startswith("8") and len(plain) == 11:
        return "7", 1
    else:
        return "", 0
    size = next((n for n in (1, 2) if plain[skip : skip + n] in _CODES), 3)
    return plain[skip : skip + size], skip + size


def _weighed(body: str, weights: tuple[int, ...]) -> int:
    return sum(int(c) * w for c, w in zip(body, weights))


def _insurance_account(body: str) -> str:
    return body + f"{_weighed(body, (9, 8, 7, 6, 5, 4, 3, 2, 1)) % 101 % 100:02d}"


def _person_letter(body: str) -> str:
    digits = body if body[0].isdigit() else str("XYZ".find(body[0])) + body[1:]
    return body + "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23]


def _taxpayer(body: str) -> str:
    first = body + str(_weighed(body, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10)
    return first + str(_weighed(first, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10)


#: Formats with rules: pattern of the canonical form, characters before the check characters, the number completed by
#: them, and what else must hold.
_FORMATS = (
    ("security", re.compile(r"\d{9}"), 9, lambda x: x, lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"),
    ("account", re.compile(r"\d{11}"), 9, _insurance_account, lambda x: True),
    ("taxpayer", re.compile(r"\d{12}"), 10, _taxpayer, lambda x: True),
    ("insurance", re.compile(r"[A-Z]{2}\d{6}[A-D]"), 9, lambda x: x, lambda x: x[0] not in "DFIQUV" and x[1] not in "DFIOQUV" and x[-1] in "ABCD" and x[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")),
    ("person", re.compile(r"(?:\d{8}|[XYZ]\d{7})[A-Z]"), 8, _person_letter, lambda x: x[0].isdigit() or x[0] in "XYZ"),
)


def id_check(plain: str):
    """(name, body, complete, plausible) of the format whose shape ``plain`` has, or None."""
    return next(((name, body, complete, plausible) for name, shape, body, complete, plausible in _FORMATS if shape.fullmatch(plain)), None)


def mask(text: str | None, spans: list[tuple[int, int, str]], names: Pseudonyms) -> str | None:
    if text is None:
        return None
    parts, last = [], 0
    for s, e, kind in spans:
        parts += [text[last:s], f"<{kind.upper()} {names.of(text[s:e], kind)}>"]
        last = e
    return "".join([*parts, text[last:]])


def known_first_names(users: DataFrame, most: int = MAX_NAMES) -> list[str] | DataFrame:
    """The distinct first names: a list of at most ``most``, or else a table of their lower-case forms (column n)."""
    names = users.select(F.trim("first_name").alias("n")).where("n is not null and n <> ''").distinct()
    rows = names.limit(most + 1).collect()
    return sorted(r.n for r in rows) if len(rows) <= most else cut_lineage(names.select(F.lower("n").alias("n")).distinct())


def _with_names(source: DataFrame, first_names: list[str] | DataFrame) -> DataFrame:
    """``source`` with the known first names of each text in ``names`` (null: those every task has)."""
    if isinstance(first_names, list):
        return source.withColumn("names", F.lit(None).cast("array<string>"))
    keyed = source.withColumn("_h", F.md5("text"))
    words = keyed.select("_h", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}][\p{L}'’-]*)"), F.lit(1)))).alias("n"))
    mine = words.join(first_names, "n").groupBy("_h").agg(F.collect_set("n").alias("names"))
    return keyed.join(mine, "_h", "left").drop("_h").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def _each(batches, first_names, emit):
    everywhere = Finder(first_names) if isinstance(first_names, list) else None
    for b in batches:
        rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
        yield emit(b, [(i, t, (everywhere if names is None and everywhere else Finder(names)).find(t)) for i, t, names in rows])


def personal_kinds(rows: DataFrame, record_id: str, text: str, first_names: list[str] | DataFrame) -> DataFrame:
    """(record_id, kind) of each kind of personal data in each text."""
    known = first_names if isinstance(first_names, list) else None

    def emit(b, found):
        pairs = [(i, kind) for i, _, spans in found for kind in sorted({k for _, _, k in spans} - {"date"})]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], b.column(0).type), pa.array([k for _, k in pairs], pa.string())], ["record_id", "kind"])

    source = spread(rows.select(F.col(record_id).alias("record_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()))
    return _with_names(source, first_names).mapInArrow(lambda b: _each(b, known, emit), f"record_id {dict(source.dtypes)['record_id']}, kind string").distinct()


def masked_texts(rows: DataFrame, record_id: str, text: str, first_names: list[str] | DataFrame, key: bytes) -> DataFrame:
    """(record_id, text) of every distinct record, personal data replaced by typed placeholders."""
    known = first_names if isinstance(first_names, list) else None

    def emit(b, found):
        names = Pseudonyms(key)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([mask(t, spans, names) for _, t, spans in found], pa.string())], ["record_id", "text"])

    source = distinct_wide(spread(rows.select(F.col(record_id).alias("record_id"), F.col(text).alias("text"))), ["record_id"], "text")
    return _with_names(source, first_names).mapInArrow(lambda b: _each(b, known, emit), f"record_id {dict(source.dtypes)['record_id']}, text string")
