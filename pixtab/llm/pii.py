"""Personal data replaced by keyed surrogates of the same type, format, gender and script."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixtab.functions.lineage import materialize
from pixtab.llm.arrow import map_rows

KEY = "pixtab-surrogates"
ROUNDS = 6

# Titles by gender, given names by script and gender, syllables of surnames by script, alphabets.
TITLES = {"m": "Mr Herr Señor Sr Monsieur Don".split(), "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Doña".split(), "": "Dr Prof".split()}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Charles Daniel Hans Peter Klaus Jürgen Pierre Jean Luc Carlos José Miguel".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Nancy Anna Ursula Monika Petra Marie Claire Sophie Carmen Lucía María".split(),
    ("cyrillic", "m"): "Иван Сергей Дмитрий Алексей Николай Павел Андрей Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Παναγιώτης Βασίλης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Αναστασία Βασιλική".split(),
}
SYLLABLES = {
    "latin": "bal cor den fal gar hol jun kel lor mar nel ost pel quin ras sol tor ul ven wil yar zel bri dro".split(),
    "cyrillic": "бал вор гар дан жел зор кал лев мир нов пал рос сав тор хол чер".split(),
    "greek": "βαλ γορ δαν ζελ θορ καλ λευ μιρ νοβ παλ ροσ σαβ τορ φολ χερ ψαν".split(),
}
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "àâäáãåæçèéêëíîïñòóôöõøùúûüÿßœ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω",
             "0123456789")
RESERVED = ("example", "test", "invalid", "localhost")
#: First numbers of addresses that are not routed like others; an address keeps such a number.
SPECIAL_NETS = (0, 10, 100, 127, 169, 172, 192, 198, 203)

PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|[.-]\d)")
#: International numbers by groups of 1 to 8 digits or none, national ones with a leading 0, and 3-3-4. Digits are counted after.
INTERNATIONAL = re.compile(r"(?<![\w+])\+\d{1,15}(?:[ .-]?\(\d{1,4}\)[ .-]?\d{1,8})?(?:[ ./-]\d{1,8}){0,6}(?!\w|[.-]\d)")
NATIONAL = re.compile(r"(?<![\w+.,/:-])(?:\(0\d{1,5}\)[ ]?\d{1,8}(?:[ ./-]\d{1,8}){0,5}|0\d{1,5}(?:[ ./-]\d{1,8}){1,6}|0\d{9,10})(?!\w|[.-]\d)")
GROUPED = re.compile(r"(?<![\w+.,/:-])\d{3} \d{3} \d{4}(?!\w|[.-]\d)")
DATE = re.compile(r"\d{2}([./ -])\d{2}\1\d{4}(?!\d)")
#: Country codes of one and two digits; all others have three.
CODES = {"1", "7", "20", "27", *map(str, (*range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98))}
ADDRESS = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
NUMBER = re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{3}-\d{2}-\d{4})(?!\w|[.-]\d)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
LOCAL = re.compile(r"[\w.+%-]{1,64}$")
DOMAIN = re.compile(r"(?:[\w-]{1,63}\.)+[^\W\d_]{2,24}")
_TITLE = "|".join(sorted({t for own in TITLES.values() for t in own}, key=lambda t: (-len(t), t)))
_GIVEN = "|".join(sorted({g for own in GIVEN.values() for g in own}, key=lambda g: (-len(g), g)))


def _ranges(chars: Iterable[int]) -> str:
    """A regular expression's class of these characters, without the brackets."""
    out: list[list[int]] = []
    for c in chars:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


_UPPER = _ranges(c for c in range(sys.maxunicode + 1) if chr(c).isalpha() and (chr(c).isupper() or chr(c).istitle()))
_NAME = rf"[{_UPPER}][^\W\d_]+(?:[-'’][^\W\d_]+)?"
NAMED = re.compile(rf"(?<!\w)(?:(?P<title>{_TITLE})\.?[ ]+(?P<who>{_NAME}(?:[ ]{_NAME}){{0,2}})|(?P<given>{_GIVEN})[ ](?P<sur>{_NAME}))(?!\w)")

KNOWN = {g for own in GIVEN.values() for g in own}
WORD = re.compile(r"\w")

Span = tuple[int, int, str, str]


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` + check digit valid."""
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def iban_check(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def phones(text: str) -> Iterator[tuple[int, int]]:
    """Spans of telephone numbers. One with more digits than a number has ends before the group that is too much."""
    yield from (m.span() for m in PHONE.finditer(text))
    yield from (m.span() for m in GROUPED.finditer(text))
    for pattern, least, most in ((INTERNATIONAL, 7, 15), (NATIONAL, 9, 13)):
        for m in pattern.finditer(text):
            if pattern is NATIONAL and DATE.match(m[0]):
                continue
            end, n = 0, 0
            for group in re.finditer(r"\d+\)?", m[0]):
                n += sum(c.isdigit() for c in group[0])
                if n > most:
                    break
                end = group.end()
            if sum(c.isdigit() for c in m[0][:end]) >= least:
                yield m.start(), m.start() + end


def detect(text: str) -> list[Span]:
    """``(start, end, kind, detail)`` of the entities of a text, by start, not overlapping; the longer wins.

    A surname seen once with a title or given name is found in every later whole-word mention of the text.
    Kinds: email, phone, address, number, iban, name. The detail of a name is its gender (m, f or empty).
    """
    found: list[Span] = []
    at = text.find("@")
    while at >= 0:
        head, tail = LOCAL.search(text, max(0, at - 64), at), DOMAIN.match(text, at + 1)
        if head and tail:
            # A sentence's full stop before the address is not part of it.
            start = head.start() + len(head[0]) - len(head[0].lstrip("."))
            if start < at and text[at - 1] != ".":
                found.append((start, tail.end(), "email", ""))
        at = text.find("@", at + 1)
    found += [(a, b, "phone", "") for a, b in phones(text)]
    found += [(m.start(), m.end(), "address", "") for m in ADDRESS.finditer(text)
              if all(str(int(o)) == o and int(o) < 256 for o in m[0].split("."))]
    found += [(m.start(), m.end(), "number", "") for m in NUMBER.finditer(text)]
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if iban_check(plain[4:] + plain[:4]) == 1:
            found.append((m.start(), m.end(), "iban", ""))
    surnames: dict[str, tuple[int, str]] = {}
    for m in NAMED.finditer(text):
        if m["title"]:
            gender = next(g for g, own in TITLES.items() if m["title"] in own)
            found.append((m.start("who"), m.end("who"), "name", gender))
        else:
            gender = next(g for (_, g), own in GIVEN.items() if m["given"] in own)
            found.append((m.start("given"), m.end("sur"), "name", gender))
        surname = (m["who"] or m["sur"]).split(" ")[-1]
        if surname not in KNOWN:
            for form in {surname, surname.upper()}:
                surnames.setdefault(form, (m.end(), gender))
    # Later mentions of a surname alone; a longer one that holds it is found at the same place or before.
    for surname, (at, gender) in surnames.items():
        at = text.find(surname, at)
        while at >= 0:
            end = at + len(surname)
            if not WORD.match(text[at - 1]) and not WORD.match(text[end:end + 1]):
                found.append((at, end, "name", gender))
            at = text.find(surname, end)
    out: list[Span] = []
    for s in sorted(found, key=lambda s: (s[0], s[0] - s[1], s[2])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


class Surrogates:
    """Keyed replacements. ``attempts`` holds the name parts whose first choices were taken by others.

    Formats with digits or letters are permuted as whole numbers of their space by a keyed Feistel network,
    so distinct values never meet, and the same value has the same surrogate everywhere. Surnames are
    made from syllables, so they can meet: ``settle`` finds who has to try again.
    """

    def __init__(self, key: str = KEY, attempts: Mapping[str, int] | None = None):
        self.key, self.attempts = hashlib.blake2b(key.encode()).digest(), attempts or {}

    def digest(self, *of: object) -> int:
        return int.from_bytes(hashlib.blake2b(repr(of).encode(), key=self.key, digest_size=32).digest(), "big")

    def permute(self, x: int, n: int, space: str, back: bool = False) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        low = (1 << half) - 1
        while True:  # steps outside the space are walked on; they come back into it
            a, b = x >> half, x & low
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    a, b = b ^ self.digest(space, n, r, a) & low, a
                else:
                    a, b = b, a ^ self.digest(space, n, r, b) & low
            x = a << half | b
            if x < n:
                return x

    def moved(self, x: int, n: int, space: str) -> int:
        """A permutation of range(n) that leaves nothing in place (if n > 1)."""
        return self.permute((self.permute(x, n, space) + 1) % n, n, space, back=True)

    def text(self, value: str, space: str) -> str:
        """Letters become letters of the same alphabet and case, digits digits; the rest stays."""
        slots = [(i, a) for i, c in enumerate(value.lower()) for a in ALPHABETS if c in a] if len(value.lower()) == len(value) else []
        x, n, shape = 0, 1, list(value.lower())
        for i, a in slots:
            x, n, shape[i] = x * len(a) + a.index(shape[i]), n * len(a), a[0]
        out = list(value)
        x = self.moved(x, n, f"{space}:{''.join(shape)}") if n > 1 else x
        for i, a in reversed(slots):
            x, d = divmod(x, len(a))
            up = a[d].upper()
            out[i] = up if value[i] != value[i].lower() and len(up) == 1 else a[d]
        return "".join(out)

    def digits(self, value: str, keep: int = 0, fixed: Sequence[int] = (), space: str = "digits") -> str:
        """Digits after the first ``keep`` and not at the places ``fixed`` are moved; marks stay."""
        places = [i for i, c in enumerate(value) if c.isdigit()]
        free = [p for k, p in enumerate(places) if k >= keep and k not in fixed]
        own = [value[p] for p in places]
        stay = "".join(own[k] for k in range(len(own)) if k < keep or k in fixed)
        n = 10 ** len(free)
        moved = str(self.moved(int("".join(value[p] for p in free)), n, f"{space}:{stay}")).zfill(len(free))
        out = list(value)
        for p, d in zip(free, moved, strict=True):
            out[p] = d
        return "".join(out)

    def email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        *labels, top = domain.split(".")
        keep = next((i for i, label in enumerate(labels) if label.lower() in RESERVED), len(labels))
        return f"{self.text(local, 'local@' + domain.lower())}@{'.'.join([*(self.text(x, 'label') for x in labels[:keep]), *labels[keep:], top])}"

    def phone(self, value: str) -> str:
        code = len(re.match(r"\+(\d{1,3})[ .(-]", value)[1]) if re.match(r"\+\d{1,3}[ .(-]", value) else 0
        if not code and value[0] == "+":
            own = re.match(r"\+(\d+)", value)[1]
            code = next((k for k in (1, 2) if own[:k] in CODES), min(3, len(own)))
        elif not code:
            code = int(re.match(r"\(?0", value) is not None)  # the leading 0 of a national number
        groups = [m.span() for m in re.finditer(r"\d+", value)]
        places = [i for i, c in enumerate(value) if c.isdigit()]
        # The exchange 555 is nobody's: it stays so.
        lo, hi = groups[-2] if len(groups) > 1 else (0, 0)
        fixed = [places.index(i) for i in range(lo, hi)] if value[lo:hi] == "555" else []
        return self.digits(value, code, fixed, "phone")

    def address(self, value: str) -> str:
        a, rest = int(value.split(".")[0]), 0
        for o in value.split(".")[1:]:
            rest = rest << 8 | int(o)
        if a in SPECIAL_NETS:
            first, rest = a, self.moved(rest, 1 << 24, f"net:{a}")
        else:
            own = [o for o in range(256) if o not in SPECIAL_NETS and (o >= 224) == (a >= 224)]
            i, rest = divmod(self.moved(own.index(a) << 24 | rest, len(own) << 24, f"nets:{a >= 224}"), 1 << 24)
            first = own[i]
        return ".".join(map(str, (first, rest >> 16 & 255, rest >> 8 & 255, rest & 255)))

    def number(self, value: str) -> str:
        """Valid card numbers stay valid and others invalid: the place of the last digit against the check digit stays."""
        own = "".join(c for c in value if c.isdigit())
        if len(own) < 13:
            return self.digits(value, space="short")
        off = (int(own[-1]) - luhn(own[:-1])) % 10
        head = self.digits(own[:-1], space=f"number:{off}")
        new = iter(head + str((luhn(head) + off) % 10))
        return "".join(next(new) if c.isdigit() else c for c in value)

    def iban(self, value: str) -> str:
        plain = value.replace(" ", "")
        body = self.text(plain[4:], f"iban:{plain[:2]}")
        new = iter(plain[:2] + f"{98 - iban_check(body + plain[:2] + '00'):02d}" + body)
        return "".join(c if c == " " else next(new) for c in value)

    def name(self, value: str, gender: str) -> str:
        """Part by part, so that a surname alone and with a given name stay the same person."""
        return re.sub(r"[^\W\d_]+", lambda m: self.name_part(m[0], gender), value)

    def name_part(self, part: str, gender: str) -> str:
        for (script, g), own in GIVEN.items():
            if part in own:
                return own[self.moved(own.index(part), len(own), f"given:{script}:{g}")]
        return cased(part, self.surname(part.lower(), self.attempts.get(part.lower(), 0)))

    def surname(self, part: str, attempt: int) -> str:
        own = SYLLABLES[script_of(part)]
        x = self.digest("surname", part, attempt)
        out = []
        for _ in range(3 + attempt // 4):
            x, i = divmod(x, len(own))
            out.append(own[i])
        return "".join(out)

    def replace(self, value: str, kind: str, detail: str) -> str:
        return self.name(value, detail) if kind == "name" else getattr(self, kind)(value)


def script_of(word: str) -> str:
    c = word[:1]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def surname_parts(text: str) -> set[str]:
    return {p.lower() for m in NAMED.finditer(text) for p in re.findall(r"[^\W\d_]+", m["who"] or m["sur"]) if p not in KNOWN}


def settle(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``(part, attempt)`` of the surname parts that may not keep their first surrogate; usually empty.

    All parts of the corpus choose; of those with the same choice the smallest keeps it, and a choice that
    is somebody's real name is nobody's. The others try again, against all choices kept before, until
    all differ. Each round is a checkpoint, and only shuffles distinct parts.
    """
    def parts():
        return lambda body: ((p,) for p in surname_parts(body or ""))

    def choose():
        own = Surrogates(key)
        return lambda part, attempt: ((part, attempt, own.surname(part, attempt)),)

    real = materialize(map_rows(docs.select(text), parts, "part string").distinct())
    trying, done = real.withColumn("attempt", F.lit(0)), None
    while True:
        chosen = map_rows(trying, choose, "part string, attempt int, chosen string")
        free = chosen.join(real.select(F.col("part").alias("chosen")), "chosen", "left_anti")
        free = free if done is None else free.join(done.select("chosen"), "chosen", "left_anti")
        kept = free.groupBy("chosen").agg(F.min("part").alias("part"), F.min_by("attempt", "part").alias("attempt"))
        kept = materialize(kept.select("part", "attempt", "chosen"))
        done = kept if done is None else materialize(done.unionByName(kept))
        trying = materialize(trying.join(kept.select("part"), "part", "left_anti").withColumn("attempt", F.col("attempt") + 1))
        if trying.isEmpty():
            return done.where("attempt > 0").select("part", "attempt")


def rewritten(text: str | None, own: Surrogates) -> tuple[str | None, list[Span]]:
    if not text:
        return text, []
    spans, out, last = detect(text), [], 0
    for a, b, kind, detail in spans:
        out += [text[last:a], own.replace(text[a:b], kind, detail)]
        last = b
    return "".join([*out, text[last:]]) if spans else text, spans


def surrogate_texts(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), key: str = KEY) -> DataFrame:
    """``keep`` columns, the rewritten ``text``, ``n_entities`` and ``entities``, a row for each row of ``docs``.

    ``entities`` lists kind:start:end (code points of the text given, end exclusive), comma-joined.
    Null and empty texts stay as they are, with no entities. Null ids and repeated rows give rows of
    their own; an empty table gives an empty result; other columns are not read. Texts are rewritten
    whole, one at a time. The same key gives the same surrogates in every run, as long as no name has
    to give way to another.
    """
    again = settle(docs, text, key)
    shape = docs.select(*keep).schema.add("text", "string").add("n_entities", "long").add("entities", "string")

    def make():
        def one(body, moved, *kept) -> Iterator[tuple]:
            out, spans = rewritten(body, Surrogates(key, {m["part"]: m["attempt"] for m in moved or ()}))
            yield (*kept, out, len(spans), ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans))
        return one

    none = F.lit(None).cast("array<struct<part:string,attempt:int>>").alias("_moved")
    if again.isEmpty():
        return map_rows(docs.select(F.col(text).alias("_text"), none, *keep), make, shape)
    # Texts that hold such parts, by a hash of the text: copies share an entry.
    def holds():
        return lambda h, body: ((h, p) for p in surname_parts(body or ""))
    hashed = docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_h"), F.col(text).alias("_text"), *keep)
    of = map_rows(hashed.select("_h", "_text"), holds, "_h string, part string").distinct().join(again, "part")
    moved = materialize(of.groupBy("_h").agg(F.collect_list(F.struct("part", "attempt")).alias("_moved")))
    return map_rows(hashed.join(moved, "_h", "left").select("_text", "_moved", *keep), make, shape)


def op9_pii(docs: DataFrame) -> DataFrame:
    return surrogate_texts(docs)
