"""PII surrogates, in DataFrame functions only.

Entities found by pattern are replaced by keyed surrogates of their kind and format. Digit strings go through a
keyed Feistel permutation (distinct numbers stay distinct; card check digits, separators and country codes keep
their form), other kinds through a keyed stream that respects character class, script and, for names after a title,
gender. A name that follows a title anywhere in a document is also replaced where it stands there without one, by the
same surrogate. Surrogates depend on the canonical entity alone, so one entity has one surrogate in all documents however
it is written. Over all distinct entities it is then checked that no two share a surrogate and that no surrogate is
itself an entity of the input; those that fail take the next attempt until none is left. Only such exceptions are
joined to documents; all others are computed where the text lies.

Whoever has the key can undo the permutations. It is an argument, or the setting spark.tesselace.pii.key; without either
each session draws its own, and surrogates then differ from session to session.

Null text stays null; empty text stays empty. U+0001 and U+0002 in a text are kept. Repeated rows are treated alike.
Other columns are kept as they are; input columns named n_entities or kinds are replaced by those of the result.
"""

from __future__ import annotations

import secrets
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, release

FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|г-жа"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин|г-н"
TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:{FEMALE}|{MALE})\.? [\p{{Lu}}\p{{Lo}}]"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
SECRET = r"(?<![A-Za-z0-9])(?=[a-f]*\d)[0-9a-f]{32,64}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{13,19})(?![\d-]*\d)"
PHONE = r"(?<![\p{L}\d+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+(?!1[ (.-])\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
REST = r"[\p{L}\p{M}'’-]"
NAME = rf"{TITLE}(?:(?<=\p{{Lu}}){REST}+(?: \p{{Lu}}{REST}+)*|(?<=\p{{Lo}}){REST}*(?: \p{{Lo}}{REST}*)?)"
ENTITY = "|".join((EMAIL, SECRET, IBAN, IP, SSN, CARD, PHONE, NAME))
#: What any entity has; texts without it are not searched further.
HINT = rf"[0-9@]|{TITLE}"
DIGITS = ("card", "phone", "ssn", "ip")


def let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f)[0]


def keyed(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *(p.cast("string") for p in parts)), 256)


def number(digest: Column, start, length: int = 15) -> Column:
    return F.conv(F.substr(digest, start if isinstance(start, Column) else F.lit(start), F.lit(length)), 16, 10).cast("long")


def permuted(d: Column, key: str, kind: Column, attempt: Column, rounds: int = 6) -> Column:
    """Keyed permutation of the digit strings of one length (2 to 20 digits)."""
    n = F.length(d)
    low = (n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left = F.substr(d, F.lit(1), low).cast("long")
    right = F.substr(d, low + 1, n).cast("long")

    def step(acc, r):
        a, b = acc["a"], acc["b"]
        return F.when(
            r % 2 == 1,
            F.struct(F.pmod(a + number(keyed(F.lit(key), kind, n, attempt, r, b), 1), ten(low)).alias("a"), b.alias("b")),
        ).otherwise(F.struct(a.alias("a"), F.pmod(b + number(keyed(F.lit(key), kind, n, attempt, r, a), 1), ten(n - low)).alias("b")))

    start = F.struct(left.alias("a"), right.alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda z: F.concat(F.lpad(z["a"].cast("string"), low, F.lit("0")), F.lpad(z["b"].cast("string"), n - low, F.lit("0"))))


def luhn(prefix: Column) -> Column:
    """The check digit for a card number without its last digit."""
    chars = F.reverse(F.split(prefix, ""))
    doubled = F.transform(chars, lambda c, i: let(c.cast("int"), lambda v: F.when(i % 2 == 1, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v))))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, v: a + v), F.lit(10))


def alphabet(first: str, last: str) -> Column:
    return F.lit("".join(map(chr, range(ord(first), ord(last) + 1))))


#: First and last letter of a run of letters of each further script, and how its letters are told.
SCRIPTS = (
    (r"\p{IsGreek}", "α", "ρ"),
    (r"\p{IsHebrew}", "א", "ת"),
    (r"\p{IsArabic}", "ب", "غ"),
    (r"\p{IsDevanagari}", "क", "न"),
    (r"\p{IsThai}", "ก", "ฮ"),
    (r"\p{IsHiragana}", "か", "ぢ"),
    (r"\p{IsKatakana}", "カ", "ヂ"),
    (r"\p{IsHangul}", "가", "깋"),
    (r"\p{IsHan}", "丁", "亿"),
)


def like(s: Column, stream: Column) -> Column:
    """Each letter or digit replaced by one of its class and script, by a keyed stream; the rest stays."""

    def one(c, i):
        r = number(keyed(stream, (i / 8).cast("int")), 1 + i % 8 * 7, 7)
        pick = lambda letters: F.substr(letters, F.lit(1) + (r % F.length(letters)).cast("int"), F.lit(1))
        plain = (
            F.when(c.rlike("[0-9]"), pick(alphabet("0", "9")))
            .when(c.rlike(r"[a-z]"), pick(alphabet("a", "z")))
            .when(c.rlike(r"[а-яё]"), pick(alphabet("а", "я")))
            .when(c.rlike(r"[А-ЯЁ]"), pick(alphabet("А", "Я")))
        )
        for script, first, last in SCRIPTS:
            plain = plain.when(c.rlike(f"(?=\\p{{L}}){script}"), pick(alphabet(first, last)))
        return plain.when(c.rlike(r"\p{Lu}"), pick(alphabet("A", "Z"))).when(c.rlike(r"\p{L}"), pick(alphabet("a", "z"))).otherwise(c)

    return F.array_join(F.transform(F.split(s, ""), one), "")


def syllables(consonants: str, vowels: str) -> Column:
    return F.array(*(F.lit(c + v) for c in consonants for v in vowels))


def name_like(kind: Column, canon: Column, stream: Column, attempt: Column) -> Column:
    """A pronounceable lower-case name of the script; the ending follows the gender. In scripts other than Latin and
    Cyrillic, letters of the script."""
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    other = canon.rlike("|".join(script for script, _, _ in SCRIPTS))

    def build(parts: Column, female: str, male: str, family: str) -> Column:
        body = F.transform(
            F.sequence(F.lit(1), F.lit(2) + F.least(attempt, F.lit(6))),
            lambda i: F.element_at(parts, F.lit(1) + (number(stream, i * 7 - 6, 7) % F.size(parts)).cast("int")),
        )
        end = F.when(kind == "given_f", F.lit(female)).when(kind == "given_m", F.lit(male)).otherwise(F.lit(family))
        return F.concat(F.array_join(body, ""), end)

    return F.when(other, like(canon, stream)).when(cyrillic, build(syllables("бвдклмнрст", "аеиоу"), "на", "н", "ров")).otherwise(build(syllables("bdfklmnprstv", "aeiou"), "na", "n", "ler"))


def iban(canon: Column, stream: Column) -> Column:
    country = F.substr(canon, F.lit(1), F.lit(2))
    return let(
        F.concat(like(F.substr(canon, F.lit(5), F.length(canon)), stream), country),
        lambda tail: F.concat(
            country,
            F.lpad(
                (
                    F.lit(98)
                    - F.aggregate(
                        F.split(F.concat(tail, F.lit("00")), ""),
                        F.lit(0),
                        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
                    )
                ).cast("string"),
                2,
                "0",
            ),
            F.substr(tail, F.lit(1), F.length(tail) - 2),
        ),
    )


def kind_of(part: Column) -> Column:
    return (
        F.when(part.contains("@"), "email")
        .when(part.rlike(r"^\d+(?:\.\d+){3}$"), "ip")
        .when(part.rlike("^[0-9a-f]{32,64}$"), "secret")
        .when(part.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(part.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(part.rlike(r"^\p{L}"), "name")
        .when(part.rlike(r"^[\d -]+$") & (F.length(F.regexp_replace(part, r"\D", "")) >= 13), "card")
        .otherwise("phone")
    )


def canonical(kind: Column, part: Column) -> Column:
    """One form for all spellings; for phones the country code (one digit for 1 and 7, else two) is set apart by ':'."""
    digits = F.regexp_replace(part, r"\D", "")
    return (
        F.when(kind == "email", F.lower(part))
        .when(kind == "ip", F.array_join(F.transform(F.split(part, r"\."), lambda x: F.lpad(x, 3, "0")), ""))
        .when(kind == "secret", part)
        .when(kind == "iban", F.regexp_replace(part, " ", ""))
        .when((kind == "phone") & part.startswith("+"), F.regexp_replace(digits, "^([17]|..)", "$1:"))
        .when(kind == "phone", F.concat(F.lit(":"), digits))
        .otherwise(digits)
    )


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a canonical entity."""
    stream = keyed(F.lit(key), kind, canon, attempt)
    n = F.length(canon)
    middle = F.substr(canon, F.lit(2), n - 2)
    first = F.substr(canon, F.lit(1), F.lit(1))
    card = let(
        F.concat(first, permuted(middle, key, F.concat(kind, first), attempt)),
        lambda p: F.concat(p, F.pmod(luhn(p) + F.substr(canon, n, F.lit(1)).cast("int") - luhn(F.concat(first, middle)), F.lit(10)).cast("string")),
    )
    after = F.substring_index(canon, ":", -1)
    before = F.substring_index(canon, ":", 1)
    word = lambda i: F.substr(canon, F.lit(i), F.lit(3)).cast("long")

    def half(acc, r):
        a, b = acc["a"], acc["b"]
        return F.when(r % 2 == 1, F.struct(((a + number(keyed(F.lit(key), kind, attempt, r, b), 1)) % 65536).alias("a"), b.alias("b"))).otherwise(
            F.struct(a.alias("a"), ((b + number(keyed(F.lit(key), kind, attempt, r, a), 1)) % 65536).alias("b"))
        )

    octet = lambda v: F.lpad(v.cast("string"), 3, "0")
    address = F.aggregate(
        F.sequence(F.lit(1), F.lit(6)),
        F.struct((word(1) * 256 + word(4)).alias("a"), (word(7) * 256 + word(10)).alias("b")),
        half,
        lambda z: F.concat(octet(F.floor(z["a"] / 256)), octet(z["a"] % 256), octet(F.floor(z["b"] / 256)), octet(z["b"] % 256)),
    )
    at = F.instr(canon, "@")
    domain = F.substr(canon, at + 1, n)
    site = F.regexp_replace(domain, r"\.[^.]*$", "")
    mail = F.concat(
        like(F.substr(canon, F.lit(1), at - 1), stream),
        F.lit("@"),
        like(site, keyed(F.lit(key), F.lit("site"), site, attempt)),
        F.substr(domain, F.length(site) + 1, n),
    )
    return (
        F.when(kind == "card", card)
        .when(kind == "ssn", permuted(canon, key, kind, attempt))
        .when(kind == "phone", F.concat(before, F.lit(":"), permuted(after, key, F.concat(kind, before), attempt)))
        .when(kind == "ip", address)
        .when(kind == "email", mail)
        .when(kind == "secret", F.substr(stream, F.lit(1), n))
        .when(kind == "iban", iban(canon, stream))
        .otherwise(name_like(kind, canon, stream, attempt))
    )


def refilled(part: Column, chars: Column, kind: str) -> Column:
    """chars put in place of the letters or digits of part, in its format."""
    slot = "[0-9]" if kind == "digits" else "[A-Z0-9]"
    other = F.lit("[^0-9]" if kind == "digits" else "[^A-Z0-9]")
    return F.array_join(
        F.transform(
            F.split(part, ""),
            lambda c, i: F.when(c.rlike(slot), F.substr(chars, F.length(F.regexp_replace(F.substr(part, F.lit(1), i + 1), other, F.lit(""))), F.lit(1))).otherwise(c),
        ),
        "",
    )


def name_kind(part: Column, i: Column, n: Column) -> Column:
    return F.when(i == n - 1, "family").when(part.rlike(rf"^(?:{FEMALE})[ .]"), "given_f").otherwise("given_m")


def in_case(new: Column, old: Column) -> Column:
    return F.when((F.upper(old) == old) & (F.length(old) > 1), F.upper(new)).otherwise(F.initcap(new))


def name_words(part: Column) -> Column:
    """Array of (kind, canon, word) of the words of a name after its title."""
    words = F.split(part, " ")
    named = F.transform(words, lambda w, i: F.struct(name_kind(part, i, F.size(words)).alias("kind"), F.lower(w).alias("canon"), w.alias("word"), i.alias("i")))
    return F.filter(named, lambda e: e["i"] > 0)


def named_in(parts: Column) -> Column:
    """All name words of a document's parts, those of longer names first."""
    names = F.filter(odd_parts(parts), lambda p: kind_of(p) == "name")
    length = lambda p: F.size(F.split(p, " "))
    return let(names, lambda n: F.flatten(F.transform(F.concat(F.filter(n, lambda p: length(p) > 2), F.filter(n, lambda p: length(p) <= 2)), name_words)))


def kinds_of_names(named: Column) -> Column:
    """Map from canonical name to its kind: that of its first mention."""
    canons = F.array_distinct(F.transform(named, lambda e: e["canon"]))
    return let(canons, lambda c: F.map_from_arrays(c, F.transform(c, lambda x: F.get(F.filter(named, lambda e: e["canon"] == x), F.lit(0))["kind"])))


def bare_names(parts: Column, named: Column) -> Column:
    """The parts, cut also at mentions of the names without a title."""
    words = F.array_distinct(F.transform(F.filter(named, lambda e: (F.length(e["word"]) > 1) | e["word"].rlike(r"\p{Lo}")), lambda e: e["word"]))
    longest = F.array_sort(words, lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])("), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}]|-\p{L})"))
    marked = let(pattern, lambda q: F.transform(parts, lambda p, i: F.when(i % 2 == 1, p).otherwise(F.regexp_replace(p, q, F.lit("\u0001$1\u0001")))))
    return F.when(F.size(words) > 0, F.split(F.array_join(marked, "\u0001"), "\u0001")).otherwise(parts)


def odd_parts(parts: Column) -> Column:
    return F.filter(parts, lambda p, i: i % 2 == 1)


def kind_in(names: Column, part: Column, word: Column, i: Column, n: Column) -> Column:
    """Kind of one word of a name: as elsewhere in the document."""
    return F.coalesce(F.try_element_at(names, F.lower(word)), name_kind(part, i, n))


def entities(part: Column, names: Column) -> Column:
    """Array of (kind, canon) of one found part; a name has one for each of its words."""
    words = F.split(part, " ")
    titled = F.size(words) > 1
    named = F.transform(words, lambda w, i: F.struct(kind_in(names, part, w, i, F.size(words)).alias("kind"), F.lower(w).alias("canon"), i.alias("i")))
    named = F.filter(named, lambda e: (e["i"] > 0) | ~titled)
    return let(
        kind_of(part),
        lambda k: F.when(k == "name", F.transform(named, lambda e: F.struct(e["kind"].alias("kind"), e["canon"].alias("canon")))).otherwise(
            F.array(F.struct(k.alias("kind"), canonical(k, part).alias("canon")))
        ),
    )


def replaced(part: Column, attempt_of, key: str, names: Column) -> Column:
    """The part with surrogates, in its own format. attempt_of: (kind, canon) -> attempt."""
    words = F.split(part, " ")
    titled = F.size(words) > 1
    name = F.array_join(
        F.transform(
            words,
            lambda w, i: F.when((i == 0) & titled, w).otherwise(
                let(F.struct(kind_in(names, part, w, i, F.size(words)).alias("k"), F.lower(w).alias("c")), lambda e: in_case(surrogate(e["k"], e["c"], attempt_of(e["k"], e["c"]), key), w))
            ),
        ),
        " ",
    )

    def other(k: Column) -> Column:
        return let(
            canonical(k, part),
            lambda c: let(
                surrogate(k, c, attempt_of(k, c), key),
                lambda s: F.when(k == "email", s)
                .when(k == "ip", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10), F.lit(3)), lambda i: F.substr(s, i, F.lit(3)).cast("int").cast("string")), "."))
                .when(k == "secret", s)
                .when(k == "iban", refilled(part, s, "mixed"))
                .otherwise(refilled(part, F.regexp_replace(s, ":", ""), "digits")),
            ),
        )

    return let(kind_of(part), lambda k: F.when(k == "name", name).otherwise(other(k)))


def split_parts(text: Column) -> Column:
    """The text cut at entities: those are the parts at odd positions (from 0)."""
    safe = F.replace(F.replace(text, F.lit("\u0002"), F.lit("\u0002b")), F.lit("\u0001"), F.lit("\u0002a"))
    return F.split(F.regexp_replace(safe, f"({ENTITY.replace(chr(92) + '1', chr(92) + '2')})", "\u0001$1\u0001"), "\u0001")


def joined_parts(parts: Column) -> Column:
    safe = F.array_join(parts, "")
    return F.replace(F.replace(safe, F.lit("\u0002a"), F.lit("\u0001")), F.lit("\u0002b"), F.lit("\u0002"))


def settle(found: DataFrame, key: str, rounds: int = 100) -> DataFrame | None:
    """(kind, canon, attempt) of the entities that cannot keep attempt 0; None if there are none."""
    table = materialise(found.distinct().withColumn("attempt", F.lit(0)), "pii-entities")
    moved = False
    for _ in range(rounds):
        made = table.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        first = Window.partitionBy("kind", "made").orderBy("attempt", "canon")
        real = table.select("kind", F.col("canon").alias("made"), F.lit(True).alias("real"))
        judged = made.withColumn("nth", F.row_number().over(first)).join(real, ["kind", "made"], "left")
        failed = (F.col("nth") > 1) | F.col("real").isNotNull()
        judged = materialise(judged.select("kind", "canon", F.when(failed, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), failed.alias("failed")), "pii-attempts")
        del made, first, real, failed
        release(found.sparkSession)
        if judged.where("failed").isEmpty():
            discard(judged)
            if not moved:
                discard(table)
            return table.select("kind", "canon", "attempt").where("attempt > 0") if moved else None
        discard(table)
        moved, table = True, judged
    raise RuntimeError("surrogates still collide; the space of a kind is too small for its entities")


@lru_cache(1)
def drawn_key() -> str:
    return secrets.token_hex(32)


def replace_entities(docs: DataFrame, key: str | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """docs with surrogates in text, n_entities (long) and kinds (the entities' kinds, in order)."""
    key = key or docs.sparkSession.conf.get("spark.tesselace.pii.key", None) or drawn_key()
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    plain = [F.col(c) for c in docs.columns if c.lower() not in ("n_entities", "kinds")]
    docs = docs.select(*plain)
    cut = docs.where(hinted).withColumn("__parts", split_parts(F.col("text"))).withColumn("__named", named_in(F.col("__parts")))
    cut = cut.withColumn("__parts", F.when(F.size("__named") > 0, bare_names(F.col("__parts"), F.col("__named"))).otherwise(F.col("__parts")))
    cut = cut.withColumn("__names", kinds_of_names(F.col("__named"))).drop("__named")
    searched = materialise(cut.withColumn("__text_key", F.sha2("text", 256)), "pii-searched")
    release(docs.sparkSession)
    hit = searched.where(F.size("__parts") > 1)
    odd, names = odd_parts(F.col("__parts")), F.col("__names")
    found = hit.select("__text_key", F.explode(F.flatten(F.transform(odd, lambda p: entities(p, names)))).alias("e")).select("__text_key", "e.kind", "e.canon")
    exceptions = settle(found.select("kind", "canon"), key)
    attempt_of = lambda k, c: F.lit(0)
    if exceptions is not None:
        by_text = found.distinct().join(exceptions, ["kind", "canon"]).groupBy("__text_key").agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "canon"), "attempt"))).alias("__attempts")
        )
        by_text = materialise(by_text, "pii-exceptions")
        release(docs.sparkSession)
        hit = hit.join(F.broadcast(by_text) if by_text.count() <= broadcast_rows else by_text, "__text_key", "left")
        attempt_of = lambda k, c: F.coalesce(F.try_element_at(F.col("__attempts"), F.concat_ws(":", k, c)), F.lit(0))
    new = F.transform("__parts", lambda p, i: F.when(i % 2 == 1, replaced(p, attempt_of, key, names)).otherwise(p))
    done = hit.withColumn("text", joined_parts(new)).select(*plain, F.size(odd).cast("long").alias("n_entities"), F.transform(odd, kind_of).alias("kinds"))
    none = (F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    rest = [searched.where(F.size("__parts") <= 1), docs.where(~hinted)]
    return reduce(DataFrame.unionByName, [done, *(x.select(*plain, *none) for x in rest)])
