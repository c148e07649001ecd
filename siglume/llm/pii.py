"""Surrogates for personal data: keyed, type-consistent, format-preserving, distinct and coreferent.

Every digit string, hexadecimal string and e-mail address is replaced by a keyed permutation of its own
format domain without fixed points (a Feistel network over the string's alphabet). A permutation can't map
two entities to one surrogate, and depends on the entity alone, so the same entity gets the same surrogate in
every document on every executor without any exchange. Check digits keep what they were: a valid card number or
IBAN gets a valid surrogate, an invalid one an invalid one.

Names are found by a title and a bounded grammar of name words; in such a text every other mention of those words is
replaced too. Each distinct name word of the corpus has one surrogate word, generated from syllables of its own script
with an ending for its role and gender, numbered by keyed rank without gaps, and checked against all name words of the
corpus: none is a real name. Word counts, separators, initials and capitals stay.
"""

from __future__ import annotations

import hashlib
import hmac
import re

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import discard, materialize, small

LOWER = "abcdefghijklmnopqrstuvwxyz"
#: One alternative per type. Order matters: an earlier alternative wins where two start at one place.
DETECT = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?<![A-Za-z0-9])(?P<token>(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}))(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?P<key>(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,48}))(?![A-Za-z0-9])"
    r"|(?<![0-9.])(?P<ip>(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]))(?![0-9]|\.[0-9])"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9])"
    r"|(?<![0-9A-Za-z-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"
    r"|(?<![0-9A-Za-z])(?P<card>[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7})(?![0-9])"
    r"|(?<![0-9A-Za-z])(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])"
    r"|(?P<name>\b(?P<title>Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora|Sr|Sra|господин|госпожа)\.? (?P<person>[^\W\d_]+\.?(?:[ '’-][^\W\d_]+\.?){0,3}))"
)
#: A text without any of these can hold no entity (each alternative of DETECT contains one); most texts stop here.
HINT = re.compile(r"@|[0-9]{3}|[0-9]\.[0-9]|\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señora?|Sra?|госпо)|AKIA|gh[pousr]_|sk-|\+[0-9]|[0-9a-f]{32}|[0-9A-F]{32}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11}")
FEMALE = {"Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "госпожа"}
#: A text without any of these holds no titled name (a superset that the scan tests before Python sees a text).
TITLES = r"(Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora|Sr|Sra|господин|госпожа)\.? "
#: Syllables and endings of surrogate names by script: consonants, vowels, and the endings of (role, gender). A string of
#: syllables alone, one with a closing consonant and one with a closing pair of vowels are never equal, so no two classes meet.
SYLLABLES = {
    "latin": ("bdfgklmnprstv", "aeiou", {("given", "f"): "ia", ("given", "m"): "n", ("family", "f"): "s", ("family", "m"): "r"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {("given", "f"): "ия", ("given", "m"): "н", ("family", "f"): "ва", ("family", "m"): "в"}),
    "greek": ("βγδζκλμνπρστ", "αεηιο", {("given", "f"): "ια", ("given", "m"): "ς", ("family", "f"): "ου", ("family", "m"): "ν"}),
}
#: Letters of scripts without syllable tables (ranges of code points): surrogates there are strings of letters.
LETTERS = {
    "hebrew": (0x5D0, 0x5EA), "arabic": (0x628, 0x64A), "devanagari": (0x915, 0x939), "thai": (0xE01, 0xE2E), "georgian": (0x10D0, 0x10F0),
    "hangul": (0xAC00, 0xD7A3), "hiragana": (0x3042, 0x3093), "katakana": (0x30A2, 0x30F3), "han": (0x4E00, 0x9FA5),
}


def script_of(word: str) -> str:
    """Script of a word's first letter; scripts unknown here count as Latin."""
    cp = ord(word[0])
    if 0x400 <= cp <= 0x52F:
        return "cyrillic"
    if 0x370 <= cp <= 0x3FF or 0x1F00 <= cp <= 0x1FFF:
        return "greek"
    wide = {"arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "hiragana": (0x3041, 0x309F), "katakana": (0x30A0, 0x30FF), "han": (0x3400, 0x9FFF)}
    return next((k for k, (a, b) in (LETTERS | wide).items() if a <= cp <= b), "latin")


def made_name(rank: int, script: str, role: str, gender: str, length: int) -> str:
    """The name of a rank: different ranks of a class give different names, and so do different classes."""
    if script in LETTERS:
        a, b = LETTERS[script]
        base, out = b - a + 1, []
        rank = rank * 4 + 2 * (role == "family") + (gender == "f")  # four classes side by side
        while rank or len(out) < max(2, length):
            rank, d = divmod(rank, base)
            out.append(chr(a + d))
        return "".join(out)
    consonants, vowels, endings = SYLLABLES[script]
    base, count = len(consonants) * len(vowels), 2
    while rank >= base**count:
        rank -= base**count
        count += 1
    out = []
    for _ in range(count):
        rank, d = divmod(rank, base)
        out.append(consonants[d // len(vowels)] + vowels[d % len(vowels)])
    return "".join(out) + endings[role, gender]


def _round(key: bytes, tweak: str, n: int, base: int, r: int, half: int) -> int:
    return int.from_bytes(hmac.new(key, f"{tweak}|{n}|{base}|{r}|{half}".encode(), hashlib.sha256).digest(), "big")


def permute(text: str, alphabet: str, key: bytes, tweak: str) -> str:
    """Keyed permutation without fixed points of the strings of this length over ``alphabet``.

    A Feistel network of ten rounds maps the string to a number; adding a constant that isn't 0 and mapping
    back through the network gives a permutation that moves every string.
    """
    n, base = len(text), len(alphabet)
    if n == 0:
        return text
    u = n // 2
    sizes = (base**u, base ** (n - u))
    halves = [0, 0]
    for i, c in enumerate(text):
        halves[i >= u] = halves[i >= u] * base + alphabet.index(c)
    for r in range(10):
        halves[r % 2] = (halves[r % 2] + _round(key, tweak, n, base, r, halves[1 - r % 2])) % sizes[r % 2]
    whole = base**n
    step = _round(key, tweak, n, base, -1, 0) % (whole - 1) + 1
    number = (halves[0] * sizes[1] + halves[1] + step) % whole
    halves = [number // sizes[1], number % sizes[1]]
    for r in reversed(range(10)):
        halves[r % 2] = (halves[r % 2] - _round(key, tweak, n, base, r, halves[1 - r % 2])) % sizes[r % 2]
    number, out = halves[0] * sizes[1] + halves[1], []
    for _ in range(n):
        number, d = divmod(number, base)
        out.append(alphabet[d])
    return "".join(reversed(out))


def _within(entity: str, alphabet: str, key: bytes, tweak: str) -> str:
    """Permutes the characters of ``alphabet`` in ``entity``; all others stay where they are."""
    new = iter(permute("".join(c for c in entity if c in alphabet), alphabet, key, tweak))
    return "".join(next(new) if c in alphabet else c for c in entity)


DIGITS, HEX, HEX_UP = "0123456789", "0123456789abcdef", "0123456789ABCDEF"


def _octets(ip: str, key: bytes) -> str:
    """Addresses keep being addresses: a permutation of the 32-bit numbers, as eight hexadecimal digits."""
    word = "".join(f"{int(x):02x}" for x in ip.split("."))
    new = permute(word, HEX, key, "ip")
    return ".".join(str(int(new[i : i + 2], 16)) for i in range(0, 8, 2))


def _cased(text: str, key: bytes, tweak: str) -> str:
    """Permutes the ASCII letters without regard to case; each place keeps its case."""
    new = iter(permute("".join(c for c in text.lower() if c in LOWER), LOWER, key, tweak))
    return "".join((n.upper() if c.isupper() else n) if c.lower() in LOWER and (n := next(new)) else c for c in text)


def _mixed(text: str, key: bytes, tweak: str) -> str:
    """Permutes digits, small and capital letters, each among themselves."""
    for alphabet in (DIGITS, LOWER, LOWER.upper()):
        text = _within(text, alphabet, key, tweak + re.sub("[" + alphabet + "]", "#", text))
    return text


def _luhn(body: str) -> int:
    """The check digit that makes a card number of these digits valid."""
    total = 0
    for i, c in enumerate(reversed([c for c in body if c.isdigit()])):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _kept_check(old: str, valid_before: str, valid_now: str) -> str:
    """Valid check digits stay valid and others invalid: the two valid pairs change places, all others stay."""
    return valid_now if old == valid_before else valid_before if old == valid_now else old


def surrogate(kind: str, entity: str, key: bytes) -> str:
    """Replacement of a non-name entity: the same type, length, separators and letter case."""
    if kind == "email":
        local, domain = entity.split("@", 1)
        host, top = domain.rsplit(".", 1)
        shape = re.sub(r"[A-Za-z]", "a", local) + "@" + domain.lower()  # with the digits, which the next step moves
        half = _cased(local, key, "email|" + shape)
        local = _within(half, DIGITS, key, "email|" + re.sub(r"[0-9]", "0", half.lower()) + "@" + domain.lower())
        half = _cased(host, key, "host|" + re.sub(r"[A-Za-z]", "a", host) + "." + top.lower())
        return local + "@" + _within(half, DIGITS, key, "host|" + re.sub(r"[0-9]", "0", half.lower()) + "." + top.lower()) + "." + top
    if kind == "ip":
        return _octets(entity, key)
    if kind == "token":
        return permute(entity, HEX if entity == entity.lower() else HEX_UP, key, "token")
    if kind == "iban":
        body = _mixed(entity[4:], key, f"iban|{entity[:2]}|")
        return entity[:2] + _kept_check(entity[2:4], _iban_check(entity[:2], entity[4:]), _iban_check(entity[:2], body)) + body
    if kind == "key":
        head = entity.index("_") + 1 if "_" in entity else 4 if entity.startswith("AKIA") else 3
        return entity[:head] + _mixed(entity[head:], key, f"key|{entity[:head]}|")
    if kind == "card":
        at = max(i for i, c in enumerate(entity) if c.isdigit())
        body = _within(entity[:at], DIGITS, key, "card|" + re.sub("[0-9]", "0", entity[:at]))
        return body + str((int(entity[at]) - _luhn(entity[:at]) + _luhn(body)) % 10) + entity[at + 1 :]
    head = len(re.match(r"(\+[0-9]{1,3})?", entity).group()) if kind == "phone" else 0
    rest = entity[head:]
    return entity[:head] + _within(rest, DIGITS, key, f"{kind}|{entity[:head]}|" + re.sub("[0-9]", "0", rest))


WORD = re.compile(r"[^\W\d_]+\.?")


def _words(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of the name words at the start of a person: the first may be any word, a further one starts with a letter that
    isn't lower case, in a script without case only the second counts. A full stop belongs to an initial alone."""
    out: list[tuple[int, int]] = []
    for m in WORD.finditer(text, start, end):
        a, b = m.span()
        if text[b - 1] == "." and b - a != 2:
            b -= 1
        caseless = text[a].lower() == text[a].upper()
        if out and (text[a].islower() or caseless and len(out) > 1 or a - out[-1][1] != 1):
            break
        out.append((a, b))
        if b != m.end():
            break
    return out


def entities(text: str):
    """``(kind, start, end, title)`` of each entity; cards must pass the length rule, tokens the mixed-character rule, names
    the grammar of ``_words``, and what follows a name is looked at again."""
    if not text or not HINT.search(text):
        return
    at = 0
    while m := DETECT.search(text, at):
        at = m.end()
        kind = m.lastgroup if m.lastgroup not in ("title", "person") else "name"
        start, end = m.span("person") if kind == "name" else m.span()
        if kind == "name":
            at = end = _words(text, start, end)[-1][1]
            if end - start < 2:
                continue
        if kind == "card" and not 13 <= sum(c.isdigit() for c in text[start:end]) <= 19:
            continue
        if kind == "token" and text[start:end].isdigit():
            continue
        yield kind, start, end, (m.group("title") if kind == "name" else None)


def _initial(text: str) -> bool:
    return len(text) == 2 and text[1] == "."


def name_words(text: str) -> set[tuple[str, str, str]]:
    """``(word, role, gender)``, words folded to one case, of the titled names in a text: the last word of a name is a family
    name, those before are given names; initials are no words."""
    out = set()
    for kind, a, b, title in entities(text):
        if kind == "name":
            words = [text[x:y] for x, y in _words(text, a, b)]
            for i, w in enumerate(words):
                if not _initial(w):
                    out.add((w.casefold(), "family" if i + 1 == len(words) else "given", "f" if title in FEMALE else "m"))
    return out


def _shaped(word: str, like: str) -> str:
    return word.upper() if len(like) > 1 and like.isupper() else word[:1].upper() + word[1:]


def replaced(text: str, names: dict[str, str], key: bytes) -> tuple[str, list[dict]]:
    """The text with surrogates, and its entities. ``names`` maps the folded name words of this text; every mention of them
    outside other entities counts, not just those with a title."""
    found = [(k, a, b) for k, a, b, _ in entities(text)]
    if names:
        taken, more = [(a, b) for _, a, b in found], []
        at = 0
        for m in re.finditer(r"[^\W\d_]{2,}(?:[ '’-][^\W\d_]{2,})*", text):
            run: list[int] = []
            for w in re.finditer(r"[^\W\d_]+", m.group()):
                a, b = m.start() + w.start(), m.start() + w.end()
                while at < len(taken) and taken[at][1] <= a:
                    at += 1
                free = at == len(taken) or b <= taken[at][0]
                if free and not text[a].islower() and w.group().casefold() in names:
                    if run and run[1] + 1 == a:
                        run[1] = b
                    else:
                        more += [("name", *run)] if run else []
                        run = [a, b]
            more += [("name", *run)] if run else []
        found = sorted(found + more, key=lambda e: e[1])
    parts, spots, at = [], [], 0
    step = _round(key, "initial", 0, 0, 0, 0) % 25 + 1
    for kind, a, b in found:
        new = text[a:b]
        if kind == "name":
            one = lambda m: (chr((ord(m.group()[0].upper()) - 65 + step) % 26 + 65) + "." if "A" <= m.group()[0].upper() <= "Z" else m.group()) if _initial(m.group()) else _shaped(names[m.group().rstrip(".").casefold()], m.group()) + ("." if m.group()[-1] == "." else "")
            new = WORD.sub(one, new)
        else:
            new = surrogate(kind, new, key)
        parts += (text[at:a], new)
        spots.append({"kind": kind, "start": a, "end": b, "surrogate": new})
        at = b
    return "".join((*parts, text[at:])), spots


def _words_kernel(batches):
    """``th, word, role, gender, script`` of the titled names of rows ``th, text``, once a batch."""
    import pyarrow as pa

    for batch in batches:
        found = set()
        for th, value in zip(batch.column("th").to_pylist(), batch.column("text")):
            found |= {(th, *w, script_of(w[0])) for w in name_words(value.as_py() or "")}
        rows = sorted(found)
        kinds = (("th", pa.int64()), ("word", pa.string()), ("role", pa.string()), ("gender", pa.string()), ("script", pa.string()))
        yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds)})


def names_table(words: DataFrame, key: bytes) -> DataFrame:
    """``word, surrogate`` for every distinct ``word`` of ``words(word, role, gender, script)``.

    A word that is a family name anywhere counts as one, and one of both genders as female. Words are ranked within their
    class by keyed hash; ranks come from hash ranges with prefix counts, never from one sorted task. Surrogates that are
    name words themselves are made anew from ranks beyond the class, until none is left.
    """
    words = words.groupBy("word").agg(F.min("role").alias("role"), F.min("gender").alias("gender"), F.min("script").alias("script"))
    words = materialize(words, "pii-names")
    group = ["script", "role", "gender"]
    ranged = words.withColumn("h", F.sha2(F.concat(F.lit(key.hex()), "word"), 256)).withColumn("lot", F.substring("h", 1, 3))  # 4,096 lots
    counts = ranged.groupBy(*group, "lot").count()
    upto = F.sum("count").over(W.partitionBy(*group).orderBy("lot"))
    starts = counts.select(*group, "lot", (upto - F.col("count")).alias("start"), F.sum("count").over(W.partitionBy(*group)).alias("size"))  # lots of some 50 classes
    rank = F.row_number().over(W.partitionBy(*group, "lot").orderBy("h")) - 1
    ranked = ranged.withColumn("r", rank).join(F.broadcast(starts), [*group, "lot"])
    left = materialize(ranked.select("word", *group, (F.col("r") + F.col("start")).alias("rank"), "size"), "pii-ranks")

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("rank", *group, "word")))
            made = pa.array([made_name(*r[:4], len(r[4])) for r in rows], pa.string())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("word", *group, "rank", "size")} | {"surrogate": made})

    out = None
    while True:
        tried = left.mapInArrow(make, "word string, script string, role string, gender string, rank long, size long, surrogate string")
        real = words.select(F.col("word").alias("surrogate"), F.lit(True).alias("real"))
        tried = materialize(tried.join(real, "surrogate", "left"), "pii-tried")
        done = tried.where("real is null").select("word", "surrogate")
        out = done if out is None else out.unionByName(done)
        left = tried.where("real").select("word", *group, (F.col("rank") + F.col("size")).alias("rank"), "size")
        if left.isEmpty():
            break
    out = materialize(out, "pii-surrogates")
    if not out.groupBy("surrogate").count().where("count > 1").isEmpty():
        raise ValueError("two names share a surrogate")
    return out


def replace(docs: DataFrame, key: str) -> DataFrame:
    """One row per input row: ``doc_id, text`` (with surrogates), ``n_entities`` and ``entities`` (kind, start, end in the
    input text, surrogate).

    Null text stays null with no entity; empty text stays empty. Repeated rows keep their rows; extra columns
    are ignored; an empty table gives an empty result. The same entity gets the same surrogate everywhere, two entities
    never share one (checked for names), and the same ``key`` and corpus give the same surrogates again. Only texts with a
    titled name are shuffled, to meet their own names; however many names there are, none are collected.
    """
    if not key:
        raise ValueError("a key is needed")
    secret = hashlib.sha256(key.encode()).digest()
    kind = docs.schema["doc_id"].dataType.simpleString()
    has_title = F.coalesce(F.col("text").rlike(TITLES), F.lit(False))
    rows = docs.select("doc_id", "text")
    titled = materialize(rows.where(has_title).withColumn("th", F.xxhash64("text")), "pii-titled")
    found = materialize(titled.select("th", "text").mapInArrow(_words_kernel, "th long, word string, role string, gender string, script string").distinct(), "pii-words")
    spot = "array<struct<kind:string,start:int,end:int,surrogate:string>>"

    def kernel(batches):
        import pyarrow as pa

        for batch in batches:
            texts, spots = [], []
            for value, own in zip(batch.column("text"), batch.column("names") if "names" in batch.schema.names else [None] * batch.num_rows):
                text = value.as_py()
                new, seen = replaced(text, dict(own.as_py() or ()) if own is not None else {}, secret) if text else (text, [])
                texts.append(new)
                spots.append(seen)
            kinds = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()), "entities": pa.array(spots, pa.list_(kinds))})

    schema = f"doc_id {kind}, text string, entities {spot}"
    if found.isEmpty():
        discard(titled, found)
        out = rows.mapInArrow(kernel, schema)
    else:
        names = names_table(found.select("word", "role", "gender", "script"), secret)
        # by text hash: two texts of one hash share a map that holds the names of both
        mine = found.select("th", "word").distinct().join(small(names), "word").groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct("word", "surrogate"))).alias("names"))
        own = titled.join(mine, "th", "left").select("doc_id", "text", "names").mapInArrow(kernel, schema)
        out = own.unionByName(rows.where(~has_title).mapInArrow(kernel, schema))
    return out.withColumn("n_entities", F.size("entities").cast("long"))
