"""Surrogates for personal data: keyed, of the same type, script, gender and format.

Detected are e-mail, IPv4 and IPv6 addresses, payment cards, bank account
numbers (IBAN), telephone and identity numbers, names of persons, and secrets
such as passwords and keys.  A surrogate is a keyed permutation of the values
of the entity's own shape, so by construction different entities never share
one, the same entity gets the same one in every document, and none is its own
surrogate.  A surrogate may be the value of another entity, which is replaced
as well, so it still stands for one entity only; :func:`collisions` checks this
on the corpus.

A person is a known given name, in any letter case, with the capitalised words
behind it, or a capitalised word behind a title.  A family name found so is
replaced wherever else the text has it.  A given name that is a common word or
a place too isn't taken for a person on its own, and none is before the name of
a square, school and the like.  Cyrillic and Greek family names keep their
gendered endings, and a couple's names stay alike.

Cases: null, empty and clean texts come back unchanged; entities that differ
only in letter case are the same one, and the surrogate takes over the case;
repeated rows get the same result; an empty table gives an empty result;
further columns stay as they are, but a column ``entities`` is replaced.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.text import slices, tune
from cipherlake.plans.scratch import materialize

# Given names by script and gender.
NAMES = {
    ("latin", "f"): "Aisha Alice Amelia Anna Barbara Camille Carmen Charlotte Chloe Elena Elizabeth Emily Emma Fatima Greta Hannah Ingrid Isabel Jennifer Jessica Julia Karen Laura Leila Linda Lucia Margaret Maria Marie Mary Mei Nadia Nancy Olivia Patricia Priya Rebecca Sarah Sophie Susan Teresa Yasmin".split(),
    ("latin", "m"): "Adam Ahmed Albert Ali Andreas Andrew Antonio Brian Carlos Charles Daniel David Edward Felix George Hans Henry Hiroshi Ivan Jack James Jean Jose John Juan Karl Klaus Louis Luis Martin Michael Mohammed Omar Pablo Paul Peter Pierre Rajesh Richard Robert Stefan Thomas William Yusuf".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Надежда Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Борис Виктор Дмитрий Иван Михаил Николай Павел Пётр Сергей Юрий".split(),
    ("greek", "f"): "Αθηνά Άννα Βασιλική Γεωργία Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αλέξανδρος Ανδρέας Βασίλης Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παύλος Πέτρος".split(),
}
# Frequent family names by script, those of Cyrillic and Greek without their gendered endings.
FAMILIES = (
    "Anderson Bauer Bernard Brown Chen Clark Davis Dubois Evans Fischer Garcia Gonzalez Hall Hill Hoffmann Johnson Jones Khan King Klein Kumar Lee Lefebvre Lewis Lopez Martinez Meyer Miller Moore Moreau Nguyen Patel Perez Petit Roberts Robinson Rodriguez Rossi Sanchez Schmidt Schneider Scott Singh Smith Taylor Tanaka Thompson Torres Wagner Walker Weber White Wilson Wright Young".split(),
    "Васил Волк Иван Козл Кузнец Лебед Мороз Новик Павл Петр Поп Семён Смирн Сокол Фёдор".split(),
)
# Gendered endings of family names, the man's and the woman's.
ENDINGS = "ский ская|цкий цкая|ов ова|ев ева|ёв ёва|ин ина|ын ына|όπουλος οπούλου|ίδης ίδου|άκης άκη|άδης άδου".split("|")
# Given names that are common words or places too; words behind a name that isn't a person's; titles.
COMMON = {"carmen", "charlotte", "jack", "jean", "mei", "ali", "mary", "вера", "надежда", "σοφία"}
PLACES = "Airport Avenue Award Bay Bridge Building Center Centre College County Hall Hospital House Institute Island Library Museum Park Prize River Road School Square Stadium Station Street Theatre Tower University Village".split()
TITLES = "Mr Mrs Ms Miss Mister Dr Prof Professor Sir Madam Herr Frau Monsieur Madame Mme Mlle Señor Señora Señorita Sr Sra Don Doña господин госпожа г-н г-жа κύριος κυρία".split()
# Letters that stand in for each other.
ALPHABETS = ("0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâäèéêëìíîïòóôöùúûü", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ")
CLASS_OF = {c: a for a in ALPHABETS for c in a}
HEX = dict.fromkeys("0123456789abcdef", "0123456789abcdef")

#: Characters that are permuted together.
PIECE = 64

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[A-Za-z0-9]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:api[_-]?key|access[_-]?key|auth|token|secret|passwd|password)\b[\"']?\s*[=:]\s*[\"']?)(?P<secret_value>[A-Za-z0-9_+/=-]{8,})|\b(?=[0-9a-f]*[a-f])[0-9a-f]{32,}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ip6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]{3,39}(?![\w:]))[0-9A-Fa-f:]*[0-9A-Fa-f]?::[0-9A-Fa-f:]*)(?![\w:])",
    "iban": r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "card": r"(?<![\w.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\w)",
    "phone": r"(?<![\w.])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]\(?\d{2,6}\)?){1,4})(?!\w)",
    "id": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
}
ENTITY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
TRIGGER = re.compile(r"[0-9@]|::|(?i:secret|passw|token|key|auth)|[a-f]{32}")
GIVEN = {name.lower(): (group, names.index(name)) for group, names in NAMES.items() for name in names}
LISTED = {name.lower(): names for names in FAMILIES for name in names}
#: Ending and the other gender's, longest first.
ENDS = sorted(((end, pair.split()) for pair in ENDINGS for end in pair.split()), key=lambda e: -len(e[0]))
_names = sorted((name for names in NAMES.values() for name in names), key=len, reverse=True)
PERSON = re.compile(rf"\b(?:{'|'.join(_names)}|{'|'.join(n.upper() for n in _names)})\b")
TITLE = re.compile(rf"\b(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? (?=[^\W\d_])")
NEXT, PLACE = re.compile(r" ([^\W\d_]{2,})\b"), re.compile(rf" (?:{'|'.join(PLACES)})\b")
#: What is replaced if nothing else is asked for.
PERSONAL = ("email", "secret", "ip", "ip6", "iban", "card", "phone", "id", "given", "family")


def capitalised(word: str) -> bool:
    return word[0].isupper() or word[0].istitle()


def valid(kind: str, value: str) -> bool:
    if kind == "iban":
        plain = value.replace(" ", "")
        return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "ip6":
        try:
            return len(value) > 3 and bool(ipaddress.IPv6Address(value))
        except ValueError:
            return False
    if kind == "phone" and value.startswith("+"):
        return 8 <= sum(c.isdigit() for c in value) <= 15
    return True


class Surrogates:
    """The keyed permutations."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple[str, str], str] = {}

    def number(self, size: int, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=self.key, digest_size=64).digest(), "big") % size

    def shuffle(self, x: int, size: int, tweak: str, forward: bool) -> int:
        """A permutation of range(size): Feistel rounds on two factors of a square that covers it, walked until inside."""
        side = max(2, int(size**0.5) if size < 2**50 else 1 << (size.bit_length() + 1) // 2)
        while side * side < size:
            side += 1
        while True:
            left, right = divmod(x, side)
            for turn in range(6) if forward else range(5, -1, -1):
                if forward:
                    left, right = right, (left + self.number(side, tweak, turn, right)) % side
                else:
                    left, right = (right - self.number(side, tweak, turn, left)) % side, left
            x = left * side + right
            if x < size:
                return x

    def moved(self, x: int, size: int, tweak: str) -> int:
        """A permutation without fixed points: the next number in shuffled order."""
        if size < 2:
            return x
        return self.shuffle((self.shuffle(x, size, tweak, True) + 1) % size, size, tweak, False)

    def shaped(self, value: str, tweak: str, kinds: dict[str, str] = CLASS_OF) -> str:
        """Letters and digits replaced by others of their kind; everything else, and letter case, stays.

        Long values go piece by piece, each under a key of what came before, which is a permutation too.
        """
        if len(value) > PIECE:
            pieces, before = [], hashlib.blake2b()
            for a in range(0, len(value), PIECE):
                pieces.append(self.shaped(value[a : a + PIECE], f"{tweak}:{before.hexdigest()}", kinds))
                before.update(pieces[-1].encode("utf-8", "surrogatepass"))
            return "".join(pieces)
        lower = [c.lower() if len(c.lower()) == 1 else c for c in value]
        x, size = 0, 1
        for c in lower:
            if group := kinds.get(c):
                x, size = x * len(group) + group.index(c), size * len(group)
        shape = "\x1f".join(kinds.get(c, c) for c in lower)
        x = self.moved(x, size, f"{tweak}:{shape}")
        out = []
        for old, c in zip(reversed(value), reversed(lower), strict=True):
            if group := kinds.get(c):
                x, k = divmod(x, len(group))
                out.append(group[k].upper() if old != c else group[k])
            else:
                out.append(old)
        return "".join(reversed(out))

    def email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        *labels, top = domain.split(".")
        return f"{self.shaped(local, 'local')}@{'.'.join(self.shaped(label, 'label') for label in labels)}.{top}"

    def ip(self, value: str) -> str:
        """Octets permuted within 1-9, 10-99 and 100-255 keep their width; 0 stays."""
        parts = [int(p) for p in value.split(".")]
        spans = [(0, 1) if p == 0 else (1, 9) if p < 10 else (10, 90) if p < 100 else (100, 156) for p in parts]
        x, size = 0, 1
        for p, (low, n) in zip(parts, spans, strict=True):
            x, size = x * n + p - low, size * n
        x = self.moved(x, size, f"ip:{spans}")
        out = []
        for low, n in reversed(spans):
            x, k = divmod(x, n)
            out.append(low + k)
        return ".".join(map(str, reversed(out)))

    def card(self, value: str) -> str:
        """The digits between the first and the last are permuted; the last keeps the check sum right (or as wrong as it was)."""
        digits = [int(c) for c in value if c.isdigit()]

        def check(body: list[int]) -> int:
            return -sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(body))) % 10

        off = (digits[-1] - check(digits[:-1])) % 10
        body = [digits[0], *map(int, self.shaped("".join(map(str, digits[1:-1])), f"card:{digits[0]}:{off}"))]
        new = iter([*body, (check(body) + off) % 10])
        return "".join(str(next(new)) if c.isdigit() else c for c in value)

    def phone(self, value: str) -> str:
        """The digits behind a country's code are permuted, whatever stands between them, and take their places."""
        country = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        kept = country.group() if country else ""
        rest = value[len(kept) :]
        new = iter(self.shaped("".join(c for c in rest if c.isdigit()), "phone"))
        return kept + "".join(next(new) if c.isdigit() else c for c in rest)

    def secret(self, value: str) -> str:
        return self.shaped(value, "secret", HEX if re.fullmatch("[0-9a-f]+", value) else CLASS_OF)

    def ip6(self, value: str) -> str:
        """The address's groups are permuted among those of as many digits without leading zeros; groups of zero and the spelling stay.

        So all spellings of one address become spellings of one other.
        """
        groups = [int(g, 16) for g in ipaddress.IPv6Address(value).exploded.split(":")]
        spans = [(16 ** (len(f"{g:x}") - 1), 15 * 16 ** (len(f"{g:x}") - 1)) if g else (0, 1) for g in groups]
        x, size = 0, 1
        for g, (low, n) in zip(groups, spans, strict=True):
            x, size = x * n + g - low, size * n
        x = self.moved(x, size, f"ip6:{spans}")
        new: list[str] = []
        for low, n in reversed(spans):
            x, k = divmod(x, n)
            new.append(f"{low + k:x}")
        new.reverse()
        head, gap, tail = value.partition("::")
        written = [g for g in head.split(":") if g], [g for g in tail.split(":") if g]
        places = [*range(len(written[0])), *range(8 - len(written[1]), 8)]
        laid = [new[k].zfill(len(old)) for k, old in zip(places, [*written[0], *written[1]], strict=True)]
        laid = [g.upper() if value.isupper() else g for g in laid]
        return ":".join(laid[: len(written[0])]) + gap + ":".join(laid[len(written[0]) :])

    def iban(self, value: str) -> str:
        """Country and grouping stay, the account is permuted, the check digits follow from it."""
        plain = value.replace(" ", "")
        account = self.shaped(plain[4:].lower(), f"iban:{plain[:2]}").upper()
        check = 98 - int("".join(str(int(c, 36)) for c in f"{account}{plain[:2]}00")) % 97
        new = iter(f"{plain[:2]}{check:02d}{account}")
        return "".join(" " if c == " " else next(new) for c in value)

    def given(self, value: str) -> str:
        """Another name of the same script and gender, each used once."""
        group, at = GIVEN[value.lower()]
        new = NAMES[group][self.moved(at, len(NAMES[group]), f"given:{group}")]
        return new.upper() if value.isupper() and len(value) > 1 else new

    def family(self, value: str) -> str:
        """A listed name becomes another one of its list, any other one letters of its shape; gendered endings stay."""
        lower = value.lower()
        end = next((e for e, _ in ENDS if lower.endswith(e) and len(lower) > len(e) + 1), "")
        stem = value[: len(value) - len(end)] if end else value
        if names := LISTED.get(stem.lower()):
            at = next(k for k, name in enumerate(names) if name.lower() == stem.lower())
            new = names[self.moved(at, len(names), f"family:{names[0]}")]
            new = new.upper() if stem.isupper() else new if capitalised(stem) else new.lower()
        else:
            # Walked on until outside the lists, so that it stays a permutation; both genders' stems go the same way.
            new = self.shaped(stem, "family")
            while new.lower() in LISTED:
                new = self.shaped(new, "family")
        return new + value[len(value) - len(end) :] if end else new

    def of(self, kind: str, value: str) -> str:
        if (found := self.known.get((kind, value))) is None:
            if len(self.known) > 100_000:
                self.known.clear()
            make = {"email": self.email, "ip": self.ip, "card": self.card, "phone": self.phone, "secret": self.secret, "given": self.given, "family": self.family, "ip6": self.ip6, "iban": self.iban}.get(kind)
            found = self.known[kind, value] = make(value) if make else self.shaped(value, kind)
        return found

    def persons(self, text: str) -> list[tuple[int, int, str]]:
        """Places of given and family names."""
        spans: dict[tuple[int, int], str] = {}
        done, taken = 0, False
        for m in PERSON.finditer(text):
            if m.start() < done:
                # A further given name of the one before.
                if taken:
                    spans[m.span()] = "given"
                continue
            at, family, place = m.end(), None, False
            # Behind a given name: further given names, then a family name.
            while (word := NEXT.match(text, at)) and capitalised(word[1]):
                place = PLACE.match(text, at) is not None or PLACE.match(text, word.end()) is not None
                if word[1].lower() not in GIVEN:
                    family = word.span(1)
                    break
                at = word.end()
            done, taken = at, not place and (family is not None or at > m.end() or m[0].lower() not in COMMON)
            if taken:
                spans[m.span()] = "given"
                if family:
                    spans[family] = "family"
        for m in TITLE.finditer(text):
            if (word := NEXT.match(text, m.end() - 1)) and capitalised(word[1]) and not PLACE.match(text, word.end()):
                if word[1].lower() not in GIVEN:
                    spans.setdefault(word.span(1), "family")
                elif (after := NEXT.match(text, word.end())) is None or not capitalised(after[1]):
                    spans.setdefault(word.span(1), "given")
        # Family names once found, wherever they stand.
        families = {text[a:b] for (a, b), kind in spans.items() if kind == "family"}
        if families:
            for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(families, key=len, reverse=True)))})\b", text):
                if not PLACE.match(text, m.end()):
                    spans.setdefault(m.span(), "family")
        return [(a, b, kind) for (a, b), kind in spans.items()]

    def replaced(self, text: str, kinds: tuple[str, ...] = PERSONAL) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and (type, entity, surrogate) in order of place."""
        spans = []
        if TRIGGER.search(text):
            for m in ENTITY.finditer(text):
                kind = "secret" if m.lastgroup == "secret_value" else m.lastgroup
                if kind in kinds and valid(kind, m.group()):
                    spans.append((*(m.span("secret_value") if m["secret_value"] else m.span()), kind))
        if "given" in kinds or "family" in kinds:
            spans += [span for span in self.persons(text) if span[2] in kinds]
        if not spans:
            return text, []
        out, found, at = [], [], 0
        for a, b, kind in sorted(spans):
            if a >= at:
                new = self.of(kind, text[a:b])
                out += [text[at:a], new]
                found.append((kind, text[a:b], new))
                at = b
        return "".join([*out, text[at:]]), found


def surrogates(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = PERSONAL) -> DataFrame:
    """``docs`` with surrogates in ``text`` for entities of ``kinds``, and their list in ``entities (kind, entity, surrogate)``."""
    kind = "array<struct<kind:string,entity:string,surrogate:string>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))
    others = [c for c in docs.columns if c not in (doc_id, text, "entities")]
    plain = docs.select(doc_id, F.col(text).cast("string").alias(text), *others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + f", entities {kind}"

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for batch in slices(batches):
            done = [(None, []) if t is None else make.replaced(t, kinds) for t in batch.column(1).to_pylist()]
            listed = pa.array([[dict(zip(("kind", "entity", "surrogate"), e, strict=True)) for e in found] for _, found in done], arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), *batch.columns[2:], listed], [*batch.schema.names, "entities"])

    return tune(plain).mapInArrow(replace, schema)


def checked_surrogates(docs: DataFrame, key: bytes, **options: object) -> DataFrame:
    """:func:`surrogates`, written once and checked on the whole corpus: raises where distinctness or coreference doesn't hold."""
    done = materialize(surrogates(docs, key, **options))
    if wrong := collisions(done).take(5):
        raise ValueError(f"surrogates that don't stand for one entity: {wrong}")
    return done


def normal(kind: Column, value: Column) -> Column:
    """What is alike in all spellings of an entity: the digits of telephone and card numbers, the groups of addresses, letters in lower case."""
    text = F.lower(value)
    halves = F.split(text, "::")
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    head, tail = groups(halves[0]), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    zeros = F.when(F.size(halves) > 1, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(head) - F.size(tail), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    address = F.array_join(F.transform(F.concat(head, zeros, tail), lambda g: F.lpad(g, 4, "0")), ":")
    return F.when(kind.isin("phone", "card"), F.regexp_replace(text, "[^0-9+]", "")).when(kind == "iban", F.replace(text, F.lit(" "))).when(kind == "ip6", address).otherwise(text)


def collisions(replaced: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one entity, or entities with more than one surrogate; none is expected.

    Spellings of one telephone number, card, account or address count as one entity.
    """
    e = F.col("e")
    each = replaced.select(F.explode("entities").alias("e")).select("e.kind", normal(e["kind"], e["entity"]).alias("entity"), normal(e["kind"], e["surrogate"]).alias("surrogate")).distinct()
    by = lambda a, b: each.groupBy("kind", F.col(a).alias("value")).agg(F.count(b).alias("n")).where("n > 1")
    return by("surrogate", "entity").union(by("entity", "surrogate"))
