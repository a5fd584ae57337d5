"""Personal data replaced by surrogates: keyed, of the same type, gender, script and format, distinct where the originals are, equal where they are equal.

A name's surrogate is drawn, by a keyed hash, from syllables of its script and
endings of its gender and role. All others come from a keyed cipher that keeps
every symbol in its class (digits stay digits, vowels vowels of the same
script, and so on), so formats and lengths stay and no two entities of one
format get the same. One entity gets one surrogate in all documents. What this
can't rule out is checked over the table of all distinct entities: a surrogate
that is a real entity of the corpus, or that another one arrives at too, is
drawn again with the next attempt. Only these exceptions are looked up when
documents are rewritten; all other surrogates are computed where they are
needed. Who has the key can undo the cipher, so it is for the caller to keep.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import OWN, materialise, table
from .textkit import chunks, tidy

TEXT, ENTITIES = OWN + "surrogated", OWN + "entities"
#: The key of the registered query, which is a test.
TEST_KEY = b"key of the test query"
#: Attempts after which a name grows by a syllable, and after which an entity is an error.
GROW, MOST_ATTEMPTS = 2, 64

#: Symbol classes of the cipher, and forms of address by gender.
ALPHABETS = [
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "áàâäãåéèêëíìîïóòôöõúùûü",
    "аеиоуыэюя",
    "бвгджзклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
]
MALE = "Mr Herr Señor Sr Monsieur Signor г-н".split()
FEMALE = "Mrs Ms Miss Frau Señora Sra Señorita Madame Mme Mademoiselle Signora г-жа".split()
NEUTRAL = "Dr Prof".split()
#: Those that count with a full stop only, since without one they stand for other things too.
DOTTED = "Sr Sra".split()
#: Of each script the first syllables of a name, further ones, and endings: of given names (male, female, either) and of family names (male, female, either).
SYLLABLES = {
    "latin": (
        "Al Bel Cor Dan El Fer Gal Hel Il Jor Kal Lor Mar Nor Ol Per Quin Ros Sel Tor Ul Val Wil Yor Zan".split(),
        "ba be da di fa ga la le li lo ma me mi na ne ra re ri ro sa ta ti va vi".split(),
        {"mg": "no ro rik mond ton bert".split(), "fg": "na lia rine tta bella sa".split(), "ng": "ren lin kim ris nel".split(), "ms": "son man ner ford wick".split(), "fs": "ley sen land worth mer".split(), "ns": "berg stein dell ham ton".split()},
    ),
    "cyrillic": (
        "Ал Бор Вад Гер Дан Ев Зах Иль Кор Лев Мар Ник Ол Пет Род Сав Тим Фед".split(),
        "ба ва да ди ка ла ле ли ма ми на не ра ри са та".split(),
        {"mg": "мир слав рий тан дим".split(), "fg": "мира слава рия лина на".split(), "ng": "ша ня ли".split(), "ms": "нов лев ров нин".split(), "fs": "нова лева рова нина".split(), "ns": "ко нко ян дзе".split()},
    ),
    "greek": (
        "Αλ Βασ Γερ Δαμ Ευ Ζην Ηλ Θαλ Κων Λεων Μαρ Νικ Παυλ Σταμ Φιλ".split(),
        "βα δα κα λα λε λι μα μι να νι ρα ρι σα τα".split(),
        {"mg": "νος ρης μος".split(), "fg": "να ρα νη".split(), "ng": "λι νε".split(), "ms": "πουλος κης δης".split(), "fs": "πουλου κη δου".split(), "ns": "λα νου".split()},
    ),
    "han": (
        list("王李张刘陈杨赵黄周吴徐孙"),
        list("文志海春建国家永金玉"),
        {"mg": list("伟强磊军勇杰"), "fg": list("芳娜敏静丽艳"), "ng": list("平宁安"), "ms": list("山川林"), "fs": list("梅云花"), "ns": list("方石田")},
    ),
}
PUBLIC_OCTETS = [x for x in range(1, 224) if x not in (10, 100, 127, 169, 172, 192, 198, 203)]

EMAIL = re.compile(r"(?<![\w.@+-])\w[\w.+-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w@])")
SECRET = re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd)\b[\"']?\s*[:=]\s*[\"']?([^\s\"',;]{8,})")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\w)")
CARD = re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]|\.\d)")
PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|[.-]\d)")
SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_TITLES = "|".join(t + (r"\." if t in DOTTED else r"\.?") for t in sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
NAME = re.compile(r"(?<!\w)((?:(?:" + _TITLES + r")[ \xa0])+)((?:[^\W\d_a-z]\w+(?:-[^\W\d_]\w+)*)(?:[ \xa0][^\W\d_a-z]\w+(?:-[^\W\d_]\w+)*)?)")
WORD = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
#: Without these, a text has no entity but names; without the last, no name.
DIGIT, ADDRESS = re.compile(r"[0-9]"), re.compile(r"(?<!\w)(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\b")


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def digits_of(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def names(text: str) -> list[tuple[int, int, str, str]]:
    """Names of a text as entities: each word after a form of address, and every other capitalised word with the same letters.

    The normal form is the gender (m, f or n for neither), the role (g: given,
    s: family) and the lowered word. The gender is that of the form of
    address. Other mentions have the one gender that the word has in the text;
    if it has both there, that of the nearest mention with a form of address
    before it, or else of the first.
    """
    titled, given = {}, set()
    for m in NAME.finditer(text):
        forms = {t.strip(". ") for t in m[1].replace("\xa0", " ").split()}
        gender = "m" if forms & set(MALE) else "f" if forms & set(FEMALE) else "n"
        parts = list(re.finditer(r"[^\W\d_]+", m[2]))
        blank = re.search(r"[ \xa0]", m[2])
        for part in parts:
            titled[m.start(2) + part.start()] = part[0], gender
            if blank and part.start() < blank.start():
                given.add(part[0].lower())
    if not titled:
        return []
    by_word: dict[str, list[tuple[int, str]]] = {}
    for at, (word, gender) in sorted(titled.items()):
        if gender != "n":
            by_word.setdefault(word.lower(), []).append((at, gender))
    known = {word.lower() for word, _ in titled.values()}
    places = {at: word for at, (word, _) in titled.items()}
    places |= {m.start(): m[0] for m in WORD.finditer(text) if m[0][0].isupper() and m[0].lower() in known}
    out = []
    for at, word in places.items():
        told = by_word.get(word.lower(), [(0, "n")])
        gender = next((g for place, g in reversed(told) if place <= at), told[0][1])
        out.append((at, at + len(word), "name", f"{gender}{'g' if word.lower() in given else 's'}|{word.lower()}"))
    return out


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of a text: start, end, kind and normal form, in order, not overlapping; the earlier and then the longer one wins."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in SECRET.finditer(text)]
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ip", m[0]) for m in IP.finditer(text)]
        found += [(m.start(), m.end(), "ssn", digits_of(m[0])) for m in SSN.finditer(text)]
        found += [(m.start(), m.end(), "card", d) for m in CARD.finditer(text) if luhn(d := digits_of(m[0]))]
        found += [(m.start(), m.end(), "phone", "+" * m[0].startswith("+") + digits_of(m[0])) for m in PHONE.finditer(text) if 7 <= len(digits_of(m[0])) <= 15]
        found += [(m.start(), m.end(), "iban", v) for m in IBAN.finditer(text) if 15 <= len(v := m[0].replace(" ", "")) <= 34 and iban_ok(v)]
    if ADDRESS.search(text):
        found += names(text)
    out, last = [], 0
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if e[0] >= last:
            out.append(e)
            last = e[1]
    return out


def cipher(key: bytes, label: str, values: list[int], sizes: list[int]) -> list[int]:
    """A keyed bijection of the lists of values below sizes: rounds that shift every second value by what the others give."""
    values = list(values)
    for r in range(8):
        fixed = ",".join(map(str, values[(r + 1) % 2 :: 2]))
        mine = range(r % 2, len(values), 2)
        stream, k = b"", 0
        while len(stream) < 4 * len(mine):
            stream += hashlib.blake2b(f"{label}|{r}|{k}|{len(values)}|{fixed}".encode(), key=key).digest()
            k += 1
        for n, i in enumerate(mine):
            values[i] = (values[i] + int.from_bytes(stream[4 * n : 4 * n + 4], "big")) % sizes[i]
    return values


def letters(key: bytes, label: str, value: str, fixed: set[int] = frozenset()) -> str:
    """The cipher over a text: each symbol stays in its alphabet, case included; others, and places in fixed, stay as they are."""
    places = [(i, a, a.index(c)) for i, c in enumerate(value.lower()) if i not in fixed and len(value.lower()) == len(value) for a in ALPHABETS if c in a]
    new = cipher(key, label, [p[2] for p in places], [len(p[1]) for p in places])
    out = list(value)
    for (i, a, _), x in zip(places, new):
        out[i] = a[x].upper() if value[i].isupper() else a[x]
    return "".join(out)


def script_of(word: str) -> str:
    for script, low, high in (("cyrillic", "\u0400", "\u052f"), ("greek", "\u0370", "\u03ff"), ("han", "\u3400", "\u9fff")):
        if low <= word[0] <= high:
            return script
    return "latin"


def name_of(key: bytes, value: str, attempt: int) -> str:
    """A name of the same script, gender and role; longer from attempt to attempt, so that there are always more."""
    first, further, endings = SYLLABLES[script_of(value[3:])]
    tables = [first, *[further] * (1 + attempt // GROW), endings[value[:2]]]
    stream = hashlib.blake2b(f"name|{attempt}|{value}".encode(), key=key).digest()
    while len(stream) < 2 * len(tables):
        stream += hashlib.blake2b(stream, key=key).digest()
    return "".join(t[int.from_bytes(stream[2 * k : 2 * k + 2], "big") % len(t)] for k, t in enumerate(tables)).lower()


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of a normal form, itself a normal form of the same kind (of a name: the word alone)."""
    label = f"{kind}|{attempt}"
    if kind == "email":
        # one domain has one surrogate, whatever stands before it
        local, _, domain = value.rpartition("@")
        name, dot, top = domain.rpartition(".")
        return letters(key, f"{label}|{domain}", local) + "@" + letters(key, "domain", name) + dot + top
    if kind == "name":
        return name_of(key, value, attempt)
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        sets = [PUBLIC_OCTETS if octets[0] in PUBLIC_OCTETS else [octets[0]], range(256) if octets[0] in PUBLIC_OCTETS or octets[0] in (10, 127) else [octets[1]], range(256), range(256)]
        new = cipher(key, label, [s.index(o) for s, o in zip(sets, octets)], [len(s) for s in sets])
        return ".".join(str(s[x]) for s, x in zip(sets, new))
    if kind == "card":
        body = value[0] + letters(key, label, value[1:-1])
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "iban":
        body = letters(key, label, value[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "phone" and value.startswith("+"):
        country = 2 if value[1] in "17" else 3
        return value[:country] + letters(key, label + value[:country], value[country:])
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        new = cipher(key, label, [int(c, 16) for c in value], [16] * len(value))
        return "".join("0123456789abcdef"[x] for x in new)
    return letters(key, label, value)


def dressed(original: str, kind: str, normal: str) -> str:
    """A surrogate in the format of the place: its separators and case."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(normal.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in original)
    if kind == "iban":
        symbols = iter(normal)
        return "".join(c if c == " " else next(symbols) for c in original)
    if kind in ("email", "name"):
        if len(original) > 1 and original.isupper():
            return normal.upper()
        if len(original) == len(normal):
            return "".join(n.upper() if o.isupper() else n for o, n in zip(original, normal))
        return normal.capitalize() if original[:1].isupper() else normal
    return normal


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int], known=None) -> tuple[str, list[dict]]:
    """A text with surrogates, and kind, start and end of each in it."""
    known = known or surrogate
    out, spans, last, size = [], [], 0, 0
    for start, end, kind, normal in find(text):
        new = dressed(text[start:end], kind, known(key, kind, normal, attempts.get((kind, normal), 0)))
        out += [text[last:start], new]
        size += start - last
        spans.append({"kind": kind, "start": size, "end": size + len(new)})
        size, last = size + len(new), end
    return "".join(out) + text[last:], spans


def mentions(rows: DataFrame) -> DataFrame:
    """doc, sum, kind and value of the distinct entities of each text. rows has doc, sum and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                out: list[list] = [[], [], [], []]
                for i in range(chunk.hi - chunk.lo):
                    for kind, value in dict.fromkeys((e[2], e[3]) for e in find(chunk.text(i).decode())):
                        for c, x in zip(out, (batch.column(0)[chunk.lo + i].as_py(), batch.column(1)[chunk.lo + i].as_py(), kind, value)):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc", "sum", "kind", "value"])

    return rows.mapInArrow(tidy(run), "doc long, sum long, kind string, value string")


def drawn(entities: DataFrame, key: bytes, attempt: int) -> DataFrame:
    """entities (kind, value) with their surrogates of an attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(key, k, v, attempt) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string())], names=["kind", "value", "new"])

    return entities.select("kind", "value").mapInArrow(tidy(run), "kind string, value string, new string")


def exceptions(entities: DataFrame, key: bytes) -> DataFrame | None:
    """kind, value and attempt of the entities whose first surrogate collides; None if there are none. entities has distinct kinds and values."""
    word = F.when(F.col("kind") == "name", F.substring("value", 4, 1 << 30)).otherwise(F.col("value"))
    real = entities.select("kind", word.alias("new"))
    open_, taken, settled, attempt = entities, None, None, 0
    while True:
        got = materialise(drawn(open_, key, attempt), "drawn")
        first = got.groupBy("kind", "new").agg(F.min("value").alias("value"))
        good = first.join(real, ["kind", "new"], "left_anti")
        if taken is not None:
            good = good.join(taken, ["kind", "new"], "left_anti")
        good = materialise(good, "settled")
        if attempt:
            now = good.select("kind", "value", F.lit(attempt).alias("attempt"))
            settled = now if settled is None else settled.unionByName(now)
        taken = good.select("kind", "new") if taken is None else taken.unionByName(good.select("kind", "new"))
        open_ = materialise(got.join(good.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value"), "open")
        if open_.isEmpty():
            return settled
        attempt += 1
        if attempt == MOST_ATTEMPTS:
            raise ValueError("entities are left without a surrogate of their own")


def pseudonymise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, key: bytes, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all by default) with TEXT and ENTITIES (kind, start and end of each surrogate in TEXT).

    Emails, secrets, IPv4 addresses, card numbers (that pass Luhn's check),
    IBANs, phone and social security numbers, and names are replaced; all
    else stays as it is, and so do texts without them. A name is known by a
    form of address before one of its mentions in the text, which stays; all
    its other capitalised mentions there are replaced alike (see names()). The
    addresses of one domain keep one domain. key (at most 64 bytes) makes the
    surrogates; equal keys give equal ones. Null stays null, empty empty. Rows are rewritten
    one by one with the surrogates of the whole corpus, so repeated rows get
    equal texts; ids may be null. An empty table gives no rows; other columns
    are passed on as they are.
    """
    keep = [c for c in docs.columns if c not in (TEXT, ENTITIES)] if keep is None else keep
    check = F.xxhash64(F.col(text))
    found = mentions(docs.select(F.col(doc_id).cast("long").alias("doc"), check.alias("sum"), F.col(text).alias("text")))
    found = materialise(found, "found")
    entities = materialise(found.select("kind", "value").distinct(), "entities")
    other = exceptions(entities, key)
    rows = docs.select(*keep, F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias(OWN + "doc"), check.alias(OWN + "sum"), F.col(text).alias(OWN + "text"))
    pairs = F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>")
    if other is None:
        rows = rows.withColumn(OWN + "other", pairs)
    else:
        of_doc = found.join(other, ["kind", "value"]).groupBy(F.coalesce("doc", F.lit(-1)).alias(OWN + "doc"), F.col("sum").alias(OWN + "sum"))
        rows = rows.join(of_doc.agg(F.collect_set(F.struct("kind", "value", "attempt")).alias(OWN + "other")), [OWN + "doc", OWN + "sum"], "left")
    n = len(keep)
    rows = rows.select(*keep, OWN + "text", OWN + "other")
    schema = docs.select(*keep).withColumn(TEXT, F.lit(None).cast("string")).withColumn(ENTITIES, F.lit(None).cast("array<struct<kind:string,start:int,end:int>>")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(100_000)(surrogate)
        for batch in batches:
            texts, spans = [], []
            for t, other in zip(batch.column(n), batch.column(n + 1)):
                t = t.as_py()
                attempts = {(x["kind"], x["value"]): x["attempt"] for x in other.as_py() or ()}
                new, where = (None, []) if t is None else replaced(t, key, attempts, known)
                texts.append(new)
                spans.append(where)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array(spans, kind)], names=[*keep, TEXT, ENTITIES])

    return rows.mapInArrow(tidy(run), schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=TEST_KEY, keep=["doc_id"])
    return got.select("doc_id", F.col(TEXT).alias("text"), F.size(ENTITIES).cast("long").alias("n_entities"), F.col(ENTITIES).alias("entities"))
