"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern of alternatives; the text between them stays as it is.  Each is
replaced by a keyed surrogate of its own type and format, the same one wherever it stands:

- texts without a digit, an @, a quotation mark or a title hold none and pass by;
- numbers (cards, phones, social security and IP addresses) go through a keyed permutation of all
  numbers of their length, a Feistel network, so different ones stay different; separators, country
  codes, a fictional 555 exchange and whether a card's check digit is right are kept;
- e-mail addresses, account numbers, long IP addresses and secrets get characters of the same class from a keyed
  digest, e-mail domains under example.net; an account number keeps its country, and right check digits are right again;
- a name after a title has its given and its family name replaced each by itself, so that the same person with
  and without a given name keeps one family name: a given name of the title's gender and a family name of syllables, in their script.

Digests can collide, and a surrogate can be another entity of the corpus.  So all distinct entities
are gathered once, by a partial aggregation, and those whose surrogate is another's or is itself
an entity get another one, until there are none; after `most` rounds without an end that is an
error.  There are next to none; only if there are any does a join by document carry them to their texts.

Cases: a null text stays null, with 0 entities; an empty one stays empty; repeated rows get equal
results, and rows that share a doc_id, or have none, get the corrections of their own texts; an empty table gives an empty result;
other columns, whatever their names, are kept by replace() and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stage

# Titles by gender, given names by gender and script, and syllables of family names by script.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Señora", "Sra", "Госпожа", "г-жа"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "г-н"]}
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nina", "Sofia"],
    ("m", "latin"): ["Adam", "Daniel", "Felix", "Hugo", "Martin", "Oscar", "Paul", "Victor"],
    ("f", "cyrillic"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"],
    ("m", "cyrillic"): ["Антон", "Борис", "Иван", "Максим", "Олег", "Павел", "Роман", "Юрий"],
}
# First, middle and last letters of a family name's syllables, by script.
LETTERS = {"latin": ("bcdfghklmnprstvw", "aeio", "lnrsmtdk"), "cyrillic": ("бвгдзклмнпрстфхч", "аеио", "лнрсмтдк")}
#: What secrets of some services start with, which stays.
PREFIXES = r"AKIA|ASIA|gh[pousr]_|xox[abp]-|eyJ"

_TITLE = "|".join(t for g in ("f", "m") for t in TITLES[g])
#: Type and pattern, in the order in which they're tried at a place; all start where no letter or digit stands before.
PATTERNS = {
    "email": r"(?<![._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ipv6": r"(?<![:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![:\w])",
    "phone": r"(?<!\+)\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<!-)\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![.-])\d{4}(?:(?: \d{4}){3}|(?:-\d{4}){3})(?![\d-])|\d{13,16}(?![0-9A-Za-z])",
    "secret": r"(?=[0-9A-Fa-f]{32})(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})(?![0-9A-Za-z])|(?i:token|secret|password|api_key|apikey) ?[=:] ?\"[!#-~]{8,}+(?=\")|(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])|xox[abp]-[0-9A-Za-z-]{10,}+|eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[0-9A-Za-z+/=\s]{16,}+-----END [A-Z ]{0,30}PRIVATE KEY-----",
    "name": rf"(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}{{1,30}}(?: \p{{Lu}}\p{{Ll}}{{1,30}})?(?!\p{{L}})",
}
ANY = rf"(?<![\p{{L}}\d])(?:{'|'.join(f'(?:{p})' for p in PATTERNS.values())})"
#: A character that Unicode keeps out of texts; it's put around entities.
MARK = "\ufdd0"


def suspicious(text: Column) -> Column:
    """False for texts that can't hold an entity: without a digit, an @, a quotation mark or a title."""
    return reduce(lambda c, t: c | F.contains(text, F.lit(t)), TITLES["f"] + TITLES["m"], text.rlike(r'[0-9@"]'))


def pieces(text: Column) -> Column:
    """text cut at its entities: what stands at odd places (from 0) is one.  A mark in the text itself is doubled meanwhile."""
    safe = F.replace(text, F.lit(MARK), F.lit("\ufdd1\ufdd2"))
    cut = F.transform(F.split(F.regexp_replace(safe, ANY, f"{MARK}$0{MARK}"), MARK, -1), lambda p: F.replace(p, F.lit("\ufdd1\ufdd2"), F.lit(MARK)))
    return F.when(suspicious(text), cut).otherwise(F.array(text))


def _digest(key: str, what: str, *parts: Column) -> Column:
    """64 hexadecimal digits that follow from the key, the purpose and the parts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(what), *[p.cast("string") for p in parts]), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it's used."""
    return F.transform(F.array(value), then)[0]


def permute(key: str, what: str, left: Column, right: Column, left_size: Column, right_size: Column, then: Callable[[Column, Column], Column], salt: Column | None = None, rounds: int = 6) -> Column:
    """then() of a keyed permutation of pairs of numbers below the two sizes: a Feistel network with sums.  Another salt is another permutation."""
    more = [] if salt is None else [salt]

    def step(r: int, left: Column, right: Column) -> Column:
        if r == rounds:
            return then(left, right)
        new_left = F.pmod(left + F.pmod(_number(_digest(key, f"{what}{r}", right, *more)), left_size), left_size)
        new_right = lambda x: F.pmod(right + F.pmod(_number(_digest(key, f"{what}{r + 1}", x, *more)), right_size), right_size)
        return let(new_left, lambda x: let(new_right(x), lambda y: step(r + 2, x, y)))

    return let(left, lambda x: let(right, lambda y: step(0, x, y)))


def _digits(key: str, what: str, digits: Column, salt: Column | None = None) -> Column:
    """A permutation of all strings of as many digits, of which there are 2 to 18."""

    def of(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        size = [F.pow(F.lit(10.0), x).cast("long") for x in (a, n - a)]
        joined = lambda x, y: F.concat(F.lpad(x.cast("string"), a, "0"), F.lpad(y.cast("string"), n - a, "0"))
        return permute(key, what, d.substr(F.lit(1), a).cast("long"), d.substr(a + 1, n - a).cast("long"), *size, joined, salt)

    return let(digits, of)


def _refill(shape: Column, fill: Column) -> Column:
    """shape with its digits replaced, in order, by those of fill."""

    def filled(f: Column) -> Column:
        step = F.aggregate(
            F.split(shape, ""),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], f.substr(s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        )
        return step["out"]

    return let(fill, filled)


def _luhn(digits: Column) -> Column:
    """The check digit that a number lacks on its right."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda s, x: s + x), F.lit(10))


def _card(key: str, e: Column, salt: Column | None = None) -> Column:
    def of(d: Column) -> Column:
        body, last = d.substr(F.lit(1), F.length(d) - 1), F.substring(d, -1, 1).cast("int")
        # a right check digit stays right, a wrong one as wrong as it was
        check = lambda new: F.pmod(_luhn(new) + last - _luhn(body), F.lit(10))
        return let(_digits(key, "card", body, salt), lambda new: _refill(e, F.concat(new, check(new).cast("string"))))

    return let(F.regexp_replace(e, r"\D", ""), of)


def _phone(key: str, e: Column, salt: Column | None = None) -> Column:
    country = F.regexp_extract(e, r"^\+\d{1,3}(?=[ .(-])", 0)

    def of(rest: Column, d: Column) -> Column:
        # the exchange 555 is no one's and stays
        fictional = d.rlike(r"^\d{3}555\d{4}$")
        free = F.when(fictional, F.concat(F.substring(d, 1, 3), F.substring(d, 7, 4))).otherwise(d)
        back = lambda new: F.when(fictional, F.concat(F.substring(new, 1, 3), F.lit("555"), F.substring(new, 4, 4))).otherwise(new)
        return let(_digits(key, "phone", free, salt), lambda new: F.concat(country, _refill(rest, back(new))))

    rest = e.substr(F.length(country) + 1, F.length(e) - F.length(country))
    return let(rest, lambda r: let(F.regexp_replace(r, r"\D", ""), lambda d: of(r, d)))


def _ip(key: str, e: Column, salt: Column | None = None) -> Column:
    size = F.lit(1 << 16).cast("long")
    part = F.transform(F.split(e, r"\."), lambda x: x.cast("long"))
    written = lambda x, y: F.concat_ws(".", F.floor(x / 256), x % 256, F.floor(y / 256), y % 256)
    return let(part, lambda p: permute(key, "ip", p[0] * 256 + p[1], p[2] * 256 + p[3], size, size, written, salt))


def _classes(e: Column, digest: Column) -> Column:
    """e with letters and digits replaced by others of their class, from as many digests as e needs."""

    def of(stream: Column, e: Column) -> Column:
        def letter(c: Column, i: Column) -> Column:
            x = lambda n, first: let(F.conv(stream.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int"), lambda v: F.chr(first + v % n))
            return F.when(c.between("0", "9"), x(10, 48)).when(c.between("a", "z"), x(26, 97)).when(c.between("A", "Z"), x(26, 65)).otherwise(c)

        hexadecimal = stream.substr(F.lit(1), F.length(e))
        # long hexadecimal numbers stay such; of others each character keeps its class
        return F.when(e.rlike(r"^[0-9a-f]{32,}$") & e.rlike("[a-f]"), hexadecimal).when(e.rlike(r"^[0-9A-F]{32,}$") & e.rlike("[A-F]"), F.upper(hexadecimal)).otherwise(F.array_join(F.transform(F.split(e, ""), letter), ""))

    stream = lambda d, e: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(e) / 32).cast("int")), lambda i: F.sha2(F.concat(d, i.cast("string")), 256)), "")
    return let(e, lambda x: let(digest, lambda d: let(stream(d, x), lambda s: of(s, x))))


def _email(key: str, e: Column, attempt: Column) -> Column:
    local, domain = F.substring_index(e, "@", 1), F.lower(F.substring_index(e, "@", -1))
    # at least ten letters, so that short ones don't meet
    long = F.concat(local, F.repeat(F.lit("x"), F.greatest(F.lit(10) - F.length(local), F.lit(0)) + 4 * attempt))
    at = _classes(F.substring_index(domain, ".", 1), _digest(key, "domain", domain))
    return F.concat(_classes(long, _digest(key, "email", F.lower(e), attempt)), F.lit("@"), at, F.substring(_digest(key, "zone", domain), 1, 6), F.lit(".example.net"))


def _hexed(e: Column, digest: Column) -> Column:
    """e, of at most 64 hexadecimal digits, with each replaced and all else kept; its letters keep their case."""
    low = F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("[0-9A-Fa-f]"), digest.substr(i + 1, F.lit(1))).otherwise(c))
    return let(F.array_join(low, ""), lambda x: F.when(e.rlike("[A-F]"), F.upper(x)).otherwise(x))


def _mod97(text: Column) -> Column:
    """A number with letters from A (10) to Z (35), modulo 97."""
    digit = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(c.between("0", "9"), 10).otherwise(100) + digit(c)) % 97))


def _spaced(shape: Column, fill: Column) -> Column:
    """fill with spaces where shape has them."""
    step = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))).otherwise(F.struct(F.concat(s["out"], fill.substr(s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))),
    )
    return step["out"]


def _iban(key: str, e: Column, attempt: Column) -> Column:
    def of(x: Column) -> Column:
        country, account = F.substring(x, 1, 2), x.substr(F.lit(5), F.length(x) - 4)
        valid = _mod97(F.concat(account, F.substring(x, 1, 4))) == 1
        right = lambda new: F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        check = lambda new: F.when(valid, right(new)).otherwise(_classes(F.substring(x, 3, 2), _digest(key, "check", x, attempt)))
        return let(_classes(account, _digest(key, "iban", x, attempt)), lambda new: let(F.concat(country, check(new), new), lambda made: _spaced(e, made)))

    return let(F.replace(e, F.lit(" "), F.lit("")), of)


def _name(key: str, e: Column, attempt: Column) -> Column:
    """The title, a given name for a given name and a family name for a family name; another attempt changes the given one, or else the family's."""

    def of(words: Column, script: str) -> Column:
        title, whole = words[0], F.size(words) > 2
        tried = F.when(whole, F.lit(0)).otherwise(attempt)
        female = F.regexp_replace(title, r"\.$", "").isin(TITLES["f"])
        first, middle, last = LETTERS[script]
        byte = lambda digest, at: F.conv(digest.substr(at, F.lit(2)), 16, 10).cast("int")
        pick = lambda letters, digest, at: F.lit(letters).substr(byte(digest, at) % len(letters) + 1, F.lit(1))
        syllable = lambda digest, i: F.concat(pick(first, digest, i * 6 + 1), pick(middle, digest, i * 6 + 3), pick(last, digest, i * 6 + 5))
        syllables = lambda digest, n: F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: syllable(digest, i)), ""))
        family = lambda digest: syllables(digest, F.least(4 + 2 * tried, F.lit(10)))
        listed = lambda digest, g: F.element_at(F.array(*map(F.lit, GIVEN[g, script])), byte(digest, F.lit(1)) % 8 + 1)
        plain = lambda digest: F.when(female, listed(digest, "f")).otherwise(listed(digest, "m"))
        given = lambda digest: F.when(attempt > 0, F.concat(plain(digest), F.lit("-"), syllables(digest, F.least(1 + attempt, F.lit(10))))).otherwise(plain(digest))
        surname = let(_digest(key, "family", F.lower(F.element_at(words, -1)), tried), family)
        return F.when(whole, F.concat_ws(" ", title, let(_digest(key, "given", F.lower(words[1]), attempt), given), surname)).otherwise(F.concat_ws(" ", title, surname))

    return let(F.split(e, " "), lambda w: F.when(e.rlike(r"\p{IsCyrillic}"), of(w, "cyrillic")).otherwise(of(w, "latin")))


def kind(e: Column) -> Column:
    """The type of an entity: the first pattern that takes it whole."""
    whole = {k: p if k != "secret" else p.replace('(?=\\")', "") for k, p in PATTERNS.items()}
    return reduce(lambda c, k: c.when(e.rlike(f"^(?:{whole[k]})$"), F.lit(k)), whole, F.when(F.lit(False), F.lit(""))).otherwise(F.lit("secret"))


def _secret(key: str, e: Column, attempt: Column) -> Column:
    before = F.regexp_extract(e, rf'^(?:\w+ ?[=:] ?\"|-----BEGIN [A-Z ]*-----|{PREFIXES})?', 0)
    after = F.regexp_extract(e, r"(?:-----END [A-Z ]*-----)?$", 0)
    value = e.substr(F.length(before) + 1, F.length(e) - F.length(before) - F.length(after))
    return F.concat(before, _classes(value, _digest(key, "secret", value, attempt)), after)


def surrogate(e: Column, key: str, attempt: Column | None = None) -> Column:
    """The replacement of an entity; attempts after 0 are for those that collided."""
    salt, attempt = attempt, F.lit(0) if attempt is None else attempt
    return let(
        kind(e),
        lambda k: F.when(k == "email", _email(key, e, attempt))
        .when(k == "ip", _ip(key, e, salt))
        .when(k == "ipv6", let(_digest(key, "ipv6", F.lower(e), attempt), lambda d: _hexed(e, d)))
        .when(k == "phone", _phone(key, e, salt))
        .when(k == "ssn", _refill(e, _digits(key, "ssn", F.regexp_replace(e, r"\D", ""), salt)))
        .when(k == "iban", _iban(key, e, attempt))
        .when(k == "card", _card(key, e, salt))
        .when(k == "name", _name(key, e, attempt))
        .otherwise(_secret(key, e, attempt)),
    )


def corrections(docs: DataFrame, key: str, most: int = 50) -> DataFrame:
    """(entity, replacement) of entities whose first surrogate is another's or an entity, each with one of its own."""
    cut = docs.filter(suspicious(F.col("text"))).select(pieces(F.col("text")).alias("p"))
    found = cut.select(F.explode(F.filter("p", lambda p, i: i % 2 == 1)).alias("entity")).distinct()
    now = stage(found.select("entity", F.lit(0).alias("attempt"), surrogate(F.col("entity"), key).alias("replacement")), "surrogates")
    real = now.select(F.col("entity").alias("replacement"))
    for k in range(1, most):
        shared = now.groupBy("replacement").agg(F.min("entity").alias("owner"), F.count("*").alias("n")).filter("n > 1").select("replacement", "owner")
        late = now.join(shared, "replacement").filter("entity <> owner").select("entity").unionByName(now.join(real, "replacement", "left_semi").select("entity")).distinct()
        late = stage(late.withColumn("late", F.lit(True)), f"collisions{k}")
        if late.isEmpty():
            return now.filter("attempt > 0").select("entity", "replacement")
        now = now.join(late, "entity", "left").select("entity", F.when(F.col("late"), F.lit(k)).otherwise(F.col("attempt")).alias("attempt"), F.when(F.col("late"), surrogate(F.col("entity"), key, F.lit(k))).otherwise(F.col("replacement")).alias("replacement"))
        now = stage(now, f"surrogates{k}")
    raise RuntimeError(f"surrogates still collide after {most} rounds: too many entities for their formats")


def replace(docs: DataFrame, key: str = "rillgrid") -> DataFrame:
    """docs with entities in `text` replaced, all other columns as they were."""
    inner = docs.withColumnRenamed("_found", "_found_") if "_found" in docs.columns else docs
    return _replaced(inner, key).select(*inner.columns).toDF(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with `text` replaced and the entities in one more column, the last."""
    parts, wrong = _free(docs, "_pieces"), _free(docs, "_wrong")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    late = corrections(docs.select("text"), key)
    found = docs.withColumn(parts, pieces(F.col("text")))
    entities = F.filter(F.col(parts), lambda p, i: i % 2 == 1)
    mend = lambda p: surrogate(p, key)
    if not late.isEmpty():
        # a document by its content: rows of one text have the same corrections, whatever their ids
        content = F.array(F.xxhash64("text"), F.length("text").cast("long"))
        hit = found.select(content.alias("_c"), F.explode(entities).alias("entity")).distinct().join(late, "entity").groupBy("_c").agg(F.map_from_entries(F.collect_set(F.struct("entity", "replacement"))).alias(wrong))
        # written first, so that its size is known: a small table is sent to the texts, and none is shuffled
        hit = stage(hit, "mends")
        found = found.join(hit, content == hit["_c"], "left").drop(hit["_c"])
        mend = lambda p: F.coalesce(F.col(wrong)[p], surrogate(p, key))
    new = F.array_join(F.transform(F.col(parts), lambda p, i: F.when(i % 2 == 1, mend(p)).otherwise(p)), "")
    return found.withColumn("text", F.when(F.size(F.col(parts)) > 1, new).otherwise(F.col("text"))).withColumn("_found", F.coalesce(entities, F.array().cast("array<string>"))).drop(parts, wrong)


def surrogates(docs: DataFrame, key: str = "rillgrid") -> DataFrame:
    """One row per document: doc_id, n_entities, counts by type, and the text with surrogates."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _replaced(rows, key).withColumn("kinds", F.transform("_found", kind))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("int").alias(f"n_{k}")
    return out.select("doc_id", F.size("_found").cast("int").alias("n_entities"), *[count(k) for k in PATTERNS], "text")


def replace_documents(docs: DataFrame, key: str = "rillgrid") -> DataFrame:
    """replace(), with n_chars as the new text's length where docs has that column."""
    out = replace(docs, key)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
