"""PII surrogates: detected entities get keyed replacements of their own type, format, script and gender.

Replacements are permutations: an entity, normalised so that its spellings agree, is a number below the size of its format's domain,
and a keyed permutation without fixed points moves it: P(P'(v) + 1), where P is a Feistel network and P' its inverse, is one cycle over
the whole domain. So equal entities always get equal surrogates (coreference across all documents) and different entities of a format
different ones (distinctness), without a table of entities. Formats don't share surrogates: what tells them apart (kinds of characters,
country codes, endings) stays. `checked` runs `collisions` on the corpus all the same.

A long entity is permuted in blocks, each under a tweak that takes in the blocks before it, so that the whole is a permutation too.

The key is the caller's secret: who has it can turn surrogates back.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import chunks, materialise, tidied

ROUNDS = 8
#: Characters of a block of a long entity.
BLOCK = 64

_DIGITS = "0123456789"
_HEX = "0123456789abcdef"
#: Letters that stand for each other, by script; vowels and consonants apart, so that surrogates can be read.
_LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñß", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Amanda Barbara Beatrice Caroline Charlotte Christina Claudia Deborah Dorothy Eleanor Elisabeth Emily Francesca Gabriela Helena Isabel Jane Jennifer Jessica Katharina Laura Linda Margaret Maria Martha Mary Monica Nancy Nicole Olivia Patricia Rebecca Sandra Sarah Sophia Susanna Teresa Ursula Victoria".split(),
    ("latin", "m"): "Albert Alexander Andrew Antonio Benjamin Brian Charles Christopher Daniel David Edward Fernando Francis Frederick George Gregory Heinrich Henry Jacob James John Jonathan Joseph Kevin Lawrence Leonard Manuel Martin Matthew Michael Nicholas Oliver Patrick Paul Peter Richard Robert Sebastian Stefan Steven Thomas William".split(),
    ("cyrillic", "f"): "Анна Валентина Вера Галина Екатерина Елена Ирина Людмила Мария Надежда Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай Павел Сергей Фёдор Юрий".split(),
    ("greek", "f"): "Αικατερίνη Βασιλική Γεωργία Δήμητρα Ελένη Ιωάννα Μαρία Σοφία".split(),
    ("greek", "m"): "Αθανάσιος Βασίλειος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης".split(),
}
#: Titles that announce a person.
_TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sra|Sr|Don|Doña"
#: Words that announce a name.
_CUES = r"[Mm]y name is|[Nn]ame:|[Ff]rom:|[Tt]o:|[Cc]ontact:|[Aa]uthor:|[Ss]igned by|[Ww]ritten by|[Ss]incerely,|[Rr]egards,"
#: Last letters that mark feminine names in several languages; a name not in the lists keeps the kind of its ending.
_FEMININE = "aáаяαη"
_NAMES = {name: key for key, names in GIVEN.items() for name in names}
_KNOWN = {name.lower(): name for name in _NAMES}
_NAME = r"[^\W\d_a-zß-öø-ÿа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"

#: Kind, pattern with the entity in group 1, and what a text must hold for the pattern to be tried.
PATTERNS = [
    ("email", r"(?<![\w.+-])([\w.+-]+@[\w-]+(?:\.[\w-]+)+)", "@"),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----\s++([A-Za-z0-9+/=]++(?:\s++[A-Za-z0-9+/=]++)*+)\s++-----END", "-----BEGIN"),
    ("aws_key", r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])", "IA"),
    ("token", r"(?<![A-Za-z0-9])((?:gh[pousr]_|sk-|xox[baprs]-|glpat-)[A-Za-z0-9_-]{16,})", None),
    ("secret", r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_.-]{6,})", None),
    ("iban", r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", None),
    ("ip", r"(?<![\d.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d]|\.\d)", "."),
    ("card", r"(?<![\d-])(\d{13,19}|(?:\d{4} ){3}\d{1,7}|(?:\d{4}-){3}\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\d-])", None),
    ("phone", r"(?<![\w+])(\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)", None),
    ("ssn", r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])", "-"),
    ("person", rf"\b(?:{_TITLES})\b\.?[  ]({_NAME}(?: {_NAME})?)", None),
    ("person", rf"(?<!\w)(?:{_CUES})\s+({_NAME} {_NAME})", None),
    ("person", rf"\b((?:{'|'.join(_NAMES)}) {_NAME})", None),
]
_COMPILED = [(kind, re.compile(p), hint) for kind, p, hint in PATTERNS]
_ANY_DIGIT = re.compile(r"\d[\d .()-]{4,}\d|[A-Z]{2}\d{2}")
_NEEDS_DIGIT = {"iban", "ip", "card", "phone", "ssn"}
_SECRET_HINT = re.compile(r"(?i)pass|pwd|secret|token|api|gh[pousr]_|sk-|xox|glpat")


def permute(value: int, size: int, tweak: str, key: str, back: bool = False) -> int:
    """A keyed permutation of the numbers below size, or its inverse: a Feistel network on enough bits, walked until it comes back below size."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, n = (1 << half) - 1, (half + 7) // 8
    secret, person = key.encode()[:64], blake2b(tweak.encode(), digest_size=16).digest()
    while True:
        left, right = value >> half, value & mask
        if back:
            left, right = right, left
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            out = blake2b(right.to_bytes(n, "big"), key=secret, salt=bytes([r]), person=person).digest()
            while len(out) < n:
                out += blake2b(out, key=secret).digest()
            left, right = right, left ^ (int.from_bytes(out[:n], "big") & mask)
        value = right << half | left if back else left << half | right
        if value < size:
            return value


def moved(value: int, size: int, tweak: str, key: str) -> int:
    """A keyed permutation of the numbers below size (2 at least) that leaves none in place: a single cycle over all of them."""
    return permute((permute(value, size, tweak, key, True) + 1) % size, size, tweak, key)


@lru_cache(maxsize=20_000)
def _alphabet(c: str) -> str | None:
    """The letters (in lower case) or digits that stand for a character: those of its class, or the other letters of its 128 code points."""
    low = c.lower()
    if found := next((a for a in (_DIGITS, *_LETTERS) if low in a), None):
        return found
    if len(low) != 1 or not _is_letter(low):
        return None
    first = ord(low) & ~0x7F
    block = "".join(k for k in map(chr, range(first, first + 128)) if _is_letter(k) and not any(k in a for a in _LETTERS))
    return block if len(block) > 1 else None


def _is_letter(c: str) -> bool:
    """Letters that are their own lower case and come back from their upper case."""
    return unicodedata.category(c)[0] == "L" and c.lower() == c and len(c.upper()) == 1 and c.upper().lower() == c


def _class(alphabet: str | None) -> str:
    """Short name of an alphabet; a dot for none."""
    known = [_DIGITS, *_LETTERS, _HEX]
    return "." if alphabet is None else chr(65 + known.index(alphabet)) if alphabet in known else f"<{ord(alphabet[0]) >> 7}>"


def recast(text: str, kind: str, key: str, hexadecimal: bool = False) -> str:
    """Letters and digits permuted within their classes; other characters and the case of each letter stay.

    What is permuted is the text without case, so spellings that differ in case stay the same entity. `hexadecimal` text keeps its
    alphabet.
    """
    classes = [_HEX if hexadecimal and c.lower() in _HEX else _alphabet(c) for c in text]
    shape = kind + ":" + "".join(map(_class, classes)) + ":" + "".join(c.lower() for c, a in zip(text, classes) if a is None)
    if len(text) <= BLOCK:
        return _recast(text, classes, shape, key)
    out, chain = [], blake2b(shape.encode(), digest_size=16)
    for at in range(0, len(text), BLOCK):
        part = text[at : at + BLOCK]
        out.append(_recast(part, classes[at : at + BLOCK], f"{kind}:{at}:{chain.hexdigest()}", key))
        chain.update("".join(c.lower() if a else c for c, a in zip(part, classes[at : at + BLOCK])).encode())
    return "".join(out)


def _recast(text: str, classes: list[str | None], shape: str, key: str) -> str:
    """A block of recast(): its letters and digits as one number, moved."""
    value, size = 0, 1
    for c, a in zip(text, classes):
        if a:
            value, size = value * len(a) + a.index(c.lower()), size * len(a)
    if size < 2:
        return text
    out = moved(value, size, shape, key)
    chars = []
    for c, a in zip(reversed(text), reversed(classes)):
        if a:
            out, at = divmod(out, len(a))
            c = ("ẞ" if a[at] == "ß" else a[at].upper()) if c.isupper() else a[at]
        chars.append(c)
    return "".join(reversed(chars))


def luhn(digits: str) -> int:
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10


def is_card(text: str) -> bool:
    """Whether digits are those of a payment card: first digit 2 to 6, and the check digit holds. Other long numbers are no cards."""
    digits = re.sub(r"\D", "", text)
    return digits[0] in "23456" and luhn(digits) == 0


def _like(digits: str, form: str) -> str:
    """Digits in the places of those of another text."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in form)


def _card(text: str, key: str) -> str:
    """The first digit stays, and the check digit holds again."""
    digits = re.sub(r"\D", "", text)
    inner = digits[0] + recast(digits[1:-1], f"card{digits[0]}", key)
    return _like(inner + next(d for d in _DIGITS if luhn(inner + d) == 0), text)


def _public(address: ipaddress.IPv4Address) -> bool:
    return address.is_global and not address.is_multicast


def _ip(text: str, key: str) -> str:
    """Private addresses stay in their network, others stay public."""
    address = ipaddress.ip_address(text)
    for net in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8"):
        net = ipaddress.ip_network(net)
        if address in net:
            return str(net[moved(int(address) - int(net[0]), net.num_addresses, str(net), key)])
    if not _public(address):
        while True:
            address = ipaddress.ip_address(moved(int(address) & 0xFFFF, 1 << 16, text.rsplit(".", 2)[0], key) | int(address) & 0xFFFF0000)
            if not _public(address):
                return str(address)
    value = int(address)
    while True:
        value = moved(value, 1 << 32, "ip", key)
        if _public(ipaddress.ip_address(value)):
            return str(ipaddress.ip_address(value))


#: Country codes of one and of two digits; all others have three. No code begins another.
_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def country_code(digits: str) -> str:
    """The country code that an international number begins with."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3])


def _phone(text: str, key: str) -> str:
    """The country code of an international number stays; numbers agree however they are punctuated, national ones and those with a code."""
    digits = re.sub(r"\D", "", text)
    code = country_code(digits) if text.startswith("+") else ""
    rest = digits[len(code) :]
    return _like(code + recast(rest, f"phone{len(rest)}", key), text)


def _remainder(iban: str) -> int:
    """A compact IBAN as a number, its head behind, modulo 97: 1 where its check digits hold."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def iban_length(text: str) -> int:
    """How much of a text that looks like an IBAN is one: the most, ending where a group does, whose check digits hold; 0 if none."""
    ends = [len(text), *(k for k in range(len(text) - 1, 14, -1) if text[k] == " ")]
    return next((k for k in ends if 15 <= len(text[:k].replace(" ", "")) <= 34 and _remainder(text[:k].replace(" ", "")) == 1), 0)


def _iban(text: str, key: str) -> str:
    """The country stays, and the check digits hold again; spaces stay where they are."""
    compact = text.replace(" ", "")
    inner = recast(compact[4:], "iban" + compact[:2], key)
    new = iter(f"{compact[:2]}{98 - _remainder(compact[:2] + '00' + inner):02d}{inner}")
    return "".join(c if c == " " else next(new) for c in text)


def _name(part: str, key: str) -> str:
    """Known given names move within their script and gender. Other names keep script, length, case and the kind of their ending, and
    don't become known ones: the permutation is walked on until it comes to a name of the same kind, so it stays one."""
    if name := _KNOWN.get(part.lower()):
        names = GIVEN[_NAMES[name]]
        new = names[moved(names.index(name), len(names), "given" + "".join(_NAMES[name]), key)]
        return new.upper() if part.isupper() else new
    ends = lambda x: x[-1].lower() in _FEMININE
    first = new = recast(part, "name", key)
    while new.lower() in _KNOWN or ends(new) != ends(part) or new.lower() == part.lower():
        new = recast(new, "name", key)
        if new == first:  # no other name of this kind and shape
            return part
    return new


def _person(text: str, key: str) -> str:
    return " ".join(_name(part, key) for part in text.split(" "))


@lru_cache(maxsize=50_000)
def surrogate(kind: str, text: str, key: str) -> str:
    """The replacement of an entity."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{recast(local + '@' + name, 'email' + top.lower(), key)}.{top}"
    if kind == "aws_key":
        return text[:4] + recast(text[4:], kind, key)
    if kind == "token":
        head = re.match(r"[a-z]+[-_]", text)[0]
        return head + recast(text[len(head) :], kind + head, key)
    if kind == "secret":
        of_hex = lambda x: re.fullmatch(r"[0-9a-f]+", x.lower()) is not None
        new = recast(text, kind, key, hexadecimal=of_hex(text))
        while of_hex(new) and not of_hex(text):
            new = recast(new, kind, key)
        return new
    special = {"card": _card, "iban": _iban, "ip": _ip, "phone": _phone, "person": _person}.get(kind)
    return special(text, key) if special else recast(text, kind, key)


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the entities of a text, in order and without overlap; earlier kinds of PATTERNS win."""
    digits, secrets = _ANY_DIGIT.search(text), _SECRET_HINT.search(text)
    starts, stops, found = [], [], []  # in order of place
    for kind, pattern, hint in _COMPILED:
        if hint and hint not in text or kind in _NEEDS_DIGIT and not digits or kind in ("token", "secret") and not secrets:
            continue
        at = 0
        while m := pattern.search(text, at):
            a, b = m.span(1)
            if kind == "iban":
                b = a + iban_length(m[1])
            if kind == "card" and not is_card(m[1]) or a == b:
                at = m.end(1) if kind == "card" else m.start() + 1
                continue
            first, behind = bisect_right(stops, a), bisect_right(starts, b - 1)
            if first >= behind:
                for column, x in ((starts, a), (stops, b), (found, (a, b, kind))):
                    column.insert(first, x)
                at = max(b, m.start() + 1)
            else:
                at = max(m.start() + 1, stops[behind - 1])  # behind what is taken, the pattern may match anew
    return found


_WORD = re.compile(r"\w+")


def mentions(text: str) -> list[tuple[int, int, str]]:
    """What detect() finds, and the further places of the persons it found by a part of their name alone (words, or two with a hyphen)."""
    found = detect(text)
    parts = {p for a, b, kind in found if kind == "person" for p in text[a:b].split(" ")}
    if parts:
        taken = iter([*found, (len(text), len(text), "")])
        now, more, joined = next(taken), [], any("-" in p for p in parts)
        words = _WORD.finditer(text)
        m = next(words, None)
        while m:
            a, b = m.span()
            behind = next(words, None)
            if joined and behind and behind.start() == b + 1 and text[b] == "-" and text[a : behind.end()] in parts:
                b, behind = behind.end(), next(words, None)
            if text[a:b] in parts:
                while now[1] <= a:
                    now = next(taken, (len(text) + 1, len(text) + 1, ""))
                if b <= now[0]:
                    more.append((a, b, "person"))
            m = behind
        found = sorted(found + more)
    return found


def replace(text: str, key: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each mention."""
    out, at, made = [], 0, []
    for a, b, kind in mentions(text):
        new = surrogate(kind, text[a:b], key)
        out += [text[at:a], new]
        made.append((kind, text[a:b], new))
        at = b
    return ("".join([*out, text[at:]]), made) if made else (text, made)


ENTITIES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "entity", "surrogate")]))


def added_column(docs: DataFrame) -> str:
    """The name of the column with_surrogates() adds: `_entities`, with more underscores where docs has that one."""
    name = "_entities"
    while name in docs.columns:
        name = "_" + name
    return name


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """All columns of docs with `text` replaced, then an array of (kind, entity, surrogate) under the name of added_column().

    Null stays null and has no entities; texts without entities stay as they are. Repeated rows get equal surrogates. Very long texts
    are a step by themselves; an empty table stays empty.
    """
    kept, added = [c for c in docs.columns if c != "text"], added_column(docs)
    fields = T.StructType([*docs.select("text", *kept).schema.fields, T.StructField(added, ENTITIES)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts, entities = [], []
            for text in batch.column(0).to_pylist():
                new, made = (None, []) if text is None else replace(text, key)
                texts.append(new)
                entities.append([dict(zip(("kind", "entity", "surrogate"), m)) for m in made])
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(0).type), *batch.columns[1:], pa.array(entities, kind)], names=["text", *kept, added])

    return docs.select("text", *kept).mapInArrow(run, fields).select(*docs.columns, added)


def collisions(replaced: DataFrame, entities: str = "_entities") -> DataFrame:
    """Surrogates of one kind that stand for several entities (spellings without case, and numbers without punctuation, are one; an
    international number isn't a national one)."""
    bare = lambda c: F.when(F.col("e.kind") == "phone", F.regexp_replace(c, r"[^\d+]", "")).when(F.col("e.kind") == "card", F.regexp_replace(c, r"\D", "")).when(F.col("e.kind") == "iban", F.replace(c, F.lit(" "), F.lit("")))
    plain = lambda c: bare(c).otherwise(F.lower(c))
    made = replaced.select(F.explode(entities).alias("e")).select("e.kind", plain("e.entity").alias("entity"), plain("e.surrogate").alias("surrogate"))
    return made.groupBy("kind", "surrogate").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).filter("a <> b")


def checked(docs: DataFrame, key: str) -> DataFrame:
    """with_surrogates, written to the shared folder, and held to be free of collisions: a surrogate that two entities share is an error, as
    each format is permuted in a range of its own."""
    done = materialise(with_surrogates(docs, key), "surrogates")
    shared = collisions(done, added_column(docs)).select("kind").limit(1).collect()
    if shared:
        raise RuntimeError(f"surrogates of kind {shared[0]['kind']} collide")
    return done


@tidied
def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities, kinds for every row of docs. Columns other than doc_id and text are not read."""
    done = checked(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), key)
    return done.select("doc_id", "text", F.size("_entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("_entities.kind")), ",").alias("kinds"))
