"""Operator 9, PII: surrogate generation. Detected entities receive keyed, type-consistent replacements.

Kinds: e-mail addresses, phone numbers, IPv4 addresses, payment cards (Luhn), national numbers (ddd-dd-dddd), IBANs, access keys,
passwords and tokens, and names of persons. A name is known by what stands around it: a title, a phrase of introduction, a salutation,
a field such as `Contact:` with one name or a list of them, an e-mail address in the same text whose local part spells it, or a given name of the
lists before a surname. Once a text has named somebody, each part of the name is found wherever else it stands there alone.

Replacement is a keyed permutation of the strings of one form: letters stay letters of their case and script class, digits digits,
punctuation stays, so the surrogate has the original's kind and format (cards keep their first digit and pass Luhn again, phones their
country code, passwords and tokens their name). Listed given names are permuted within the names of their gender and script. Other names
become names of syllables in their script: the name is a number among all strings of its alphabet, the number is permuted and written
with syllables for digits, which can be read back in one way only. After a title that has a gender, a given name that isn't listed is
led by a listed one of that gender, as in Emma-Kelori. The permutations have no fixed points. As the key and the string alone decide (and
the gender that a text gives it), an entity has the same surrogate in every document, in whatever case or spacing it is written, and
distinct entities stay distinct without a table that would grow with the corpus. `checked` makes sure of that over all pairs that a corpus in fact has and
raises an error otherwise; the query and the pipeline's stage call it.

The key is an argument that has no default. `key_of` takes it from the session (spark.tidemill.surrogate.key); where none is set
it draws one for the run, which nobody knows afterwards.

Defined results: null texts count as empty here and stay null in the pipeline's stage; a null doc_id is kept; texts without entities come back unchanged; where finds overlap,
the leftmost counts, and of those the longest; very long texts are searched whole, one after the other; repeated rows are rewritten alike; an empty table gives an empty result; extra
columns are ignored here and kept by the pipeline's stage, also those whose names differ from a needed one's in case alone.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_bytes, keyed_texts, pieces, with_row

KEY_SETTING = "spark.tidemill.surrogate.key"
ROUNDS = 8
NAMES = {
    ("latin", "f"): "Mary Anna Maria Sarah Laura Emma Julia Sophie Claire Camille Ingrid Greta Helga Katrin Lucia Elena Carmen Isabel Alice Emily Nora Olivia Marie Jeanne Ursula Sabine Pilar Teresa Susan Linda".split(),
    ("latin", "m"): "John James Robert Peter Thomas David Paul Louis Pierre Jean Hans Klaus Stefan Jürgen Carlos Miguel José Pedro Henry Oliver Lucas Martin Michel Laurent Dieter Karl Diego Pablo William George".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Наталья Татьяна Светлана Вера Дарья".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Андрей Михаил Павел Виктор".split(),
    ("greek", "f"): "Ελένη Μαρία Σοφία Κατερίνα Άννα Ειρήνη Δήμητρα Ιωάννα".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Πέτρος Παύλος Ανδρέας".split(),
}
KNOWN = {name.lower(): group for group, names in NAMES.items() for name in names}
#: Letters are permuted within their class.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àâäáãåèéêëìíîïòóôöõùúûü", "ñçß", "ÀÂÄÁÃÅÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜ", "ÑÇ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩΆΈΉΊΌΎΏ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
WORDS = {c: k for k, c in enumerate(CLASSES) for c in c}
ALNUM = ["0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
HEX = ["0123456789abcdef", "ABCDEF"]


def _classes(sets: list[str]) -> dict[str, tuple[str, int]]:
    return {c: (s, k) for s in sets for k, c in enumerate(s)}


BY_WORD, BY_ALNUM, BY_HEX = _classes(CLASSES), _classes(ALNUM), _classes(HEX)


def _number(symbols: list[tuple[str, int]]) -> tuple[int, int]:
    value, size = 0, 1
    for s, k in symbols:
        value, size = value * len(s) + k, size * len(s)
    return value, size


def permuted(text: str, kind: str, key: bytes, table: dict) -> str:
    """A keyed bijection on the strings that have text's class at each place; what is in no class stays.

    The halves of a Feistel network are numbers in mixed radix; the form, kind and key decide the permutation.
    """
    places = [k for k, c in enumerate(text) if c in table]
    if not places:
        return text
    symbols = [table[text[k]] for k in places]
    half = len(symbols) // 2
    a, b = symbols[:half], symbols[half:]
    (x, nx), (y, ny) = _number(a), _number(b)
    form = repr((kind, [s for s, _ in symbols])).encode()
    x, y = _moved(x, y, nx, ny, key, form)
    out = list(text)
    for part, value in ((list(zip(places[:half], a, strict=True)), x), (list(zip(places[half:], b, strict=True)), y)):
        for place, (s, _) in reversed(part):
            value, k = divmod(value, len(s))
            out[place] = s[k]
    return "".join(out)


def _moved(x: int, y: int, nx: int, ny: int, key: bytes, form: bytes) -> tuple[int, int]:
    """A keyed permutation of the pairs under (nx, ny) that leaves none where it is: a Feistel network, a step, and the network backwards."""
    n = nx * ny
    if n == 1:
        return x, y
    for r in range(ROUNDS):
        if r % 2 == 0:
            y = (y + _keyed(key, form, r, x)) % ny
        else:
            x = (x + _keyed(key, form, r, y)) % nx
    x, y = divmod((x * ny + y + (1 if n > 1 << 20 else 1 + _keyed(key, form, ROUNDS, 0) % (n - 1))) % n, ny)
    for r in reversed(range(ROUNDS)):
        if r % 2 == 0:
            y = (y - _keyed(key, form, r, x)) % ny
        else:
            x = (x - _keyed(key, form, r, y)) % nx
    return x, y


def _keyed(key: bytes, form: bytes, r: int, value: int) -> int:
    h = hashlib.blake2b(form + b"|%d|%d" % (r, value), key=key[:64], digest_size=32)
    return int.from_bytes(h.digest(), "big")


def luhn_digit(digits: str) -> str:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def _poured(digits: str, form: str) -> str:
    """The characters of form with its letters and digits replaced, in order, by `digits`."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in form)


def _card(text: str, key: bytes) -> str:
    d = "".join(c for c in text if c.isdigit())
    inner = permuted(d[1:-1], f"card{d[0]}", key, BY_WORD)
    new = d[0] + inner
    return _poured(new + luhn_digit(new), text)


def _phone(text: str, key: bytes) -> str:
    lead = re.match(r"\+\d{1,3}(?=[ (.-])", text)
    code, rest = (lead.group(), text[lead.end() :]) if lead else ("", text)
    d = "".join(c for c in rest if c.isdigit())
    return code + _poured(permuted(d, f"phone{code}", key, BY_WORD), rest)


def _ip(text: str, key: bytes) -> str:
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    x, y = _moved(*divmod(value, 65536), 65536, 65536, key, b"ip")
    return ".".join(map(str, (x * 65536 + y).to_bytes(4, "big")))


def _cased(new: str, like: str) -> str:
    return new.upper() if like.isupper() and len(like) > 1 else new.lower() if like.islower() else new


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.rpartition("@")
    name, dot, top = domain.rpartition(".")
    new = permuted(local.lower(), "local", key, BY_WORD) + "@" + permuted(name.lower(), "domain", key, BY_WORD) + dot + top.lower()
    return new.upper() if text.isupper() else new


def _secret(text: str, key: bytes) -> str:
    head = re.match(r"(AKIA|(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)", text, re.I)
    start = head.end() if head else 0
    body = text[start:]
    if body.upper() == body.lower():  # digits alone are permuted among themselves: a walk would hardly ever come back to them
        return text[:start] + permuted(body, "secret", key, BY_WORD)
    form, shout = _secret_form(body), body.isupper()
    new = body.lower() if shout else body
    while True:  # walking on along the cycle until the form is the same again keeps it a permutation of the strings of that form
        new = permuted(new, "secret", key, BY_HEX if form[0] else BY_ALNUM)
        if _secret_form(new.upper() if shout else new) == form:
            return text[:start] + (new.upper() if shout else new)


def _secret_form(body: str) -> tuple:
    """Whether it is hexadecimal, has lower-case letters, has upper-case letters."""
    return re.fullmatch(r"[0-9a-fA-F]+", body) is not None, body.upper() != body, body.lower() != body


VOWELS = "a e i o u ia io ea ai".split()
ONSETS = "b c d f g h j k l m n p r s t v w z br ch cl dr fl gr kr pl pr sh sl st th tr".split()
#: By alphabet: its letters, and the onsets and vowels that its surrogates are made of; each syllable is a run of consonants and one of vowels.
ALPHABETS = [
    ("latin", "abcdefghijklmnopqrstuvwxyz", ONSETS, VOWELS),
    ("latin", "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøœßùúûüýÿšžłńśćźżąęğışčřůěő", ONSETS, "é è á à ó ö ü í ä ê â".split()),
    ("cyrillic", "абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", "б в г д ж з к л м н п р с т ф х ч ш бр гр др кр пр ст тр вл".split(), "а е и о у я ю".split()),
    ("greek", "αάβγδεέζηήθιίϊκλμνξοόπρσςτυύφχψωώ", "β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ στ τρ πρ κρ".split(), "α ε η ι ο υ ω ου αι".split()),
]
BY_LETTER = [_classes([letters]) for _, letters, _, _ in ALPHABETS]


def _syllables(word: str, which: int) -> str:
    """A lower-case word as the syllables whose number it has among all words of its alphabet."""
    _, letters, onsets, vowels = ALPHABETS[which]
    value, shorter = 0, 0
    for k, c in enumerate(word):
        value, shorter = value * len(letters) + BY_LETTER[which][c][1], shorter + len(letters) ** k
    number, out = value + shorter, []
    base = len(onsets) * len(vowels)
    while number > 0:  # bijective numeration: every number in one way
        number, digit = divmod(number - 1, base)
        out.append(onsets[digit // len(vowels)] + vowels[digit % len(vowels)])
    return "".join(out)


@lru_cache(maxsize=1024)
def _letters_near(c: str) -> str:
    """The letters of c's case among the 64 characters around it, for scripts without an alphabet here."""
    return "".join(x for x in map(chr, range(ord(c) & ~63, (ord(c) | 63) + 1)) if x.isalpha() and x.islower() == c.islower() and x.isupper() == c.isupper())


def _word(name: str, key: bytes, gender: str = "") -> str:
    """The surrogate of one word of a name; gender: of a given name, where the text tells it."""
    low = name.lower()
    if low in KNOWN:
        return _cased(_rotated(NAMES[KNOWN[low]], name[:1].upper() + low[1:], key), name)
    if parts := re.split("([-'’])", low)[1:]:
        first, *rest = re.split("([-'’])", low)
        return _cased(_word(first.capitalize(), key, gender) + "".join(x if x in "-'’" else _word(x.capitalize(), key) if x else x for x in rest), name) if parts else name
    which = next((k for k, table in enumerate(BY_LETTER) if all(c in table for c in low)), None)
    if which is None:
        table = {c: (_letters_near(c), _letters_near(c).index(c)) for c in low if c.isalpha() and c in _letters_near(c)}
        return _cased(permuted(low, "name", key, table).capitalize(), name)
    new = permuted(low, f"name{which}", key, BY_LETTER[which])
    while (out := _syllables(new, which)) in KNOWN:  # walking on along the cycle keeps distinct names distinct
        new = permuted(new, f"name{which}", key, BY_LETTER[which])
    pool = NAMES.get((ALPHABETS[which][0], gender))
    lead = pool[_keyed(key, b"lead" + gender.encode(), 0, int.from_bytes(low.encode(), "big")) % len(pool)] + "-" if pool else ""
    return _cased(lead + out.capitalize(), name)


def _rotated(pool: list[str], name: str, key: bytes) -> str:
    """One cycle through the whole pool in a keyed order: a permutation without fixed points."""
    order = sorted(pool, key=lambda n: hashlib.blake2b(n.encode(), key=key[:64], digest_size=16).digest())
    known = {n.lower(): k for k, n in enumerate(order)}
    return order[(known[name.lower()] + 1) % len(order)]


TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sra": "f", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
NAME = r"[^\W\d_a-zà-öø-ÿа-яё](?:[^\W\d_]+(?:[-'’][^\W\d_]+)*|(?:['’][^\W\d_]+)+(?:-[^\W\d_]+)*)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?i:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{6,}",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]*\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])",
    "national": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\.?\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
}
STRUCTURED = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
UNCARDED = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items() if k != "card"))
CARD, PHONE = re.compile(PATTERNS["card"]), re.compile(PATTERNS["phone"])
INTRODUCED = re.compile(rf"(?P<title>\b(?:{'|'.join(TITLES)})\b\.? |[Mm]y name is |[Ii]ch heiße |[Jj]e m'appelle |[Mm]e llamo |[Мм]еня зовут )(?P<name>{NAME}(?: {NAME})?)")
GIVEN = re.compile(rf"\b(?P<first>{'|'.join(sorted((n for p in NAMES.values() for n in p), key=len, reverse=True))}) (?P<last>{NAME})\b")
LABELS = "contact|contacts|name|names|full name|attn|attention|author|authors|signed|signed by|signature|from|to|cc|patient|customer|client|employee|manager|kontakt|ansprechpartner|nom|auteur|nombre|autor|контакт|имя|фио|автор|όνομα|επαφή"
FIELD = re.compile(rf"\b(?i:{LABELS}) ?: ?(?P<list>{NAME} {NAME}(?:(?:, | and | & |; ){NAME} {NAME})*)")
SALUTATION = re.compile(rf"\b(?:Dear|Hi|Hello|Regards|regards|Sincerely|Liebe|Lieber|Cher|Chère|Querido|Querida|Уважаемый|Уважаемая),? \n*(?P<name>{NAME} {NAME})(?=[,.!\n]|$)")
ONE_NAME = re.compile(rf"{NAME} {NAME}")
CUES = [*TITLES, "name is ", "heiße ", "m'appelle ", "me llamo ", "Me llamo ", "зовут "]
SURROGATES = {"email": _email, "secret": _secret, "ip": _ip, "card": _card, "phone": _phone, "national": lambda t, k: permuted(t, "national", k, BY_WORD), "iban": lambda t, k: t[:2] + permuted(t[2:], f"iban{t[:2]}", k, BY_ALNUM)}


@lru_cache(maxsize=20_000)
def surrogate(kind: str, text: str, key: bytes, gender: str = "") -> str:
    """Of a name's words the first is a given name if there are two, or if `gender` says so."""
    if kind != "name":
        return SURROGATES[kind](text, key)
    return " ".join(_word(p, key, gender if k == 0 else "") for k, p in enumerate(text.split(" ")))


def key_of(spark: SparkSession) -> bytes:
    """The session's key, or one for this run."""
    return spark.conf.get(KEY_SETTING, "").encode() or secrets.token_bytes(32)


def card_end(text: str, start: int, end: int) -> int:
    """Where the longest card number from start on ends: 13 digits or more up to end, valid, and followed by no digit. 0 if there is none."""
    digits = [k for k in range(start, end) if text[k].isdigit()]
    for n in range(len(digits), 12, -1):
        stop = digits[n - 1] + 1
        if not text[stop : stop + 1].isdigit() and luhn("".join(text[k] for k in digits[:n])):
            return stop
    return 0


def entity_at(text: str, start: int) -> tuple[int, str]:
    """The end and kind of what starts here; digits that are a whole number of another kind are no card with what follows. (0, "") if nothing does."""
    if m := UNCARDED.match(text, start):
        return m.end(), m.lastgroup
    m = CARD.match(text, start)
    end = card_end(text, start, m.end()) if m else 0
    return end, "card" if end else ""


def phone_end(text: str, start: int, end: int) -> int:
    """Where a number with a country code ends, without groups of digits that begin another entity, which reaches further."""
    for k in range(start + 1, end):
        if text[k].isdigit() and text[k - 1] == " " and PHONE.fullmatch(text, start, k - 1) and entity_at(text, k)[0] > end:
            return k - 1
    return end


def names_in(text: str, emails: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, gender of its given name or "") of what is a name by what stands around it, and of its parts elsewhere in the text."""
    found = []
    if any(c in text for c in CUES):
        for m in INTRODUCED.finditer(text):
            gender = TITLES.get(m["title"].strip(" ."), "") if " " in m["name"] else ""
            found.append((m.start("name"), m.end("name"), gender))
    if ":" in text:
        for m in FIELD.finditer(text):
            found += [(n.start(), n.end(), "") for n in ONE_NAME.finditer(text, m.start("list"), m.end("list"))]
    found += [(m.start("name"), m.end("name"), "") for m in SALUTATION.finditer(text)]
    found += [(m.start(), m.end(), "") for m in GIVEN.finditer(text)]
    for mail in emails:
        parts = re.split(r"[._-]", mail.partition("@")[0])
        if len(parts) == 2 and all(len(p) > 1 and p.isalpha() for p in parts):
            found += [(m.start(), m.end(), "") for m in re.finditer(rf"\b{parts[0].capitalize()} {parts[1].capitalize()}\b", text)]
    if not found:
        return found
    genders: dict[str, str] = {}
    for start, end, gender in found:
        words = text[start:end].split(" ")
        for k, w in enumerate(words):
            genders[w] = genders.get(w) or (gender if k == 0 else "")
    told = [(start, end, gender or genders[text[start:end].split(" ")[0]]) for start, end, gender in found]
    alone = re.compile(rf"(?<![\w@.-])(?:{'|'.join(sorted(map(re.escape, genders), key=len, reverse=True))})(?![\w@])")
    return told + [(m.start(), m.end(), genders[m.group()]) for m in alone.finditer(text)]


def found_in(text: str, structured: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender), from left to right, none overlapping; structured: the text has a digit, an @ or such a word at all."""
    found = []
    at = 0
    while structured and (m := STRUCTURED.search(text, at)):
        start, end, kind = m.start(), m.end(), m.lastgroup
        if kind == "card":
            end, kind = entity_at(text, start)
            if not end:
                at = start + 1
                continue
        elif kind == "phone" and text[start] == "+":
            end = phone_end(text, start, end)
        found.append((start, end, kind, ""))
        at = end
    found += [(a, b, "name", gender) for a, b, gender in names_in(text, [text[a:b] for a, b, kind, _ in found if kind == "email"])]
    found.sort(key=lambda e: (e[0], -e[1], e[2] == "name", not e[3]))
    out, last = [], 0
    for e in found:
        if e[0] >= last:
            out.append(e)
            last = e[1]
    return out


def entities(text: str, structured: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind), from left to right, none overlapping."""
    return [e[:3] for e in found_in(text, structured)]


def rewritten(text: str, key: bytes, structured: bool = True) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with its entities replaced, and (kind, original, surrogate) of each."""
    out, made, last = [], [], 0
    for start, end, kind, gender in found_in(text, structured):
        old = text[start:end]
        new = surrogate(kind, old, key, gender)
        out += [text[last:start], new]
        made.append((kind, old, new))
        last = end
    return "".join([*out, text[last:]]), made


def _maybe(batch: pa.RecordBatch) -> list[bool]:
    """Whether each text (column 1) has a digit, an @, = or : or the beginning of an access key, without which it has no entity but names."""
    data, off = flat_bytes(batch.column(1))
    marks = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64) | (data == 61) | (data == 58), dtype=np.int64)])[off]
    keys = pa.compute.match_substring(batch.column(1), "AKIA").to_pylist()
    return [m or bool(k) for m, k in zip((np.diff(marks) > 0).tolist(), keys, strict=True)]


def replaced_batches(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ..) to the same with the texts rewritten, and n_entities at the end."""
    for whole in batches:
        for batch in pieces(whole):
            pairs = [rewritten(t, key, m) for t, m in zip(batch.column(1).to_pylist(), _maybe(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in pairs], batch.column(1).type), *batch.columns[2:], pa.array([len(m) for _, m in pairs], pa.int32())], names=[*batch.schema.names, "n_entities"])


def surrogate_texts(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_entities) for every row."""
    return keyed_texts(docs).mapInArrow(lambda b: replaced_batches(b, key), "doc_id long, text string, n_entities int")


def surrogate_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of docs with their texts rewritten, n_chars (if there) counted again, and all other columns as they are."""
    wide, again = with_row(docs, "doc_id", "text")
    wide = wide.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "row")
    place = {n: next((k for k, c in enumerate(docs.columns) if c == n), next((k for k, c in enumerate(docs.columns) if c.lower() == n), None)) for n in ("text", "n_chars")}

    def safe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = b.column(1).is_null()
            filled = b.set_column(1, b.schema.field(1), pa.compute.fill_null(b.column(1), ""))
            at = 0
            for out in replaced_batches(iter([filled]), key):
                text = pa.compute.if_else(none.slice(at, out.num_rows), pa.scalar(None, out.column(1).type), out.column(1))
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([text, out.column(2)], names=["text", "row"])

    out = wide.mapInArrow(safe, f"text string, row {wide.schema['row'].dataType.simpleString()}")
    new = out.withColumn("row", F.col("row").withField(f"c{place['text']}", F.col("text")))
    if place["n_chars"] is not None:
        at = f"c{place['n_chars']}"
        new = new.withColumn("row", F.col("row").withField(at, F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col(f"row.{at}")).cast(docs.schema[place["n_chars"]].dataType)))
    return again(new)


def entity_table(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, original, surrogate, n): every entity of the corpus, names word by word; names and addresses in lower case."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                count: Counter = Counter()
                for text, maybe in zip(batch.column(1).to_pylist(), _maybe(batch), strict=True):
                    for kind, old, new in rewritten(text, key, maybe)[1]:
                        if kind in ("name", "email"):
                            old, new = old.lower(), new.lower()
                        for pair in zip(old.split(" "), new.split(" "), strict=True) if kind == "name" else [(old, new)]:
                            count[(kind, *pair)] += 1
                kinds, olds, news = zip(*count, strict=True) if count else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (kinds, olds, news)] + [pa.array(count.values(), pa.int64())], names=["kind", "original", "surrogate", "n"])

    found = keyed_texts(docs).mapInArrow(rows, "kind string, original string, surrogate string, n long")
    return found.groupBy("kind", "original", "surrogate").agg(F.sum("n").alias("n"))


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, surrogate, originals, same): surrogates that stand for more than one original, or for itself. It is empty."""
    seen = entity_table(docs, key).groupBy("kind", "surrogate").agg(F.countDistinct("original").alias("originals"), F.max(((F.col("kind") != "secret") & (F.col("original") == F.col("surrogate"))).cast("int")).alias("same"))  # a secret may have nothing but hyphens
    return seen.filter("originals > 1 or same > 0")


def checked(docs: DataFrame, key: bytes) -> DataFrame:
    """docs, once it is certain that this key keeps all of their entities apart."""
    if wrong := collisions(docs, key).limit(5).collect():
        raise ValueError(f"surrogates that aren't distinct, use another key: {[(r['kind'], r['surrogate']) for r in wrong]}")
    return docs
