"""Format-preserving pseudonyms for personal data, in SQL functions alone.

Found: e-mail addresses, payment card numbers that pass the Luhn test, social security numbers of valid ranges, IPv4
addresses, telephone numbers, and valid dates (yyyy-mm-dd, also before a time, dd/mm/yyyy, dd.mm.yyyy).  Secrets (access
keys, ``password=`` values, long hexadecimal tokens in quotes) are replaced in the same way.  Every value is taken apart
into its characters' classes: a keyed balanced Feistel network of eight rounds over its digits (and one over its letters)
permutes values of one format among themselves, so equal values get equal pseudonyms in all documents and, with the
key, no two values the same one.

* card: the digits between the first and the last are permuted and the check digit made anew, so that it stays valid;
* telephone, number: the digits are permuted, separators and a leading country code stay;
* date: the day number within 1900-2099 is permuted, so that it stays a date, in its own format;
* address of a host: the four octets as one 32-bit number;
* e-mail: the digits and letters of the part before the @ each among themselves; the domain likewise but for its end;
* hexadecimal token: its digits as blocks of base 16, in its own case;
* other secrets, whatever else they hold: digits, small and capital letters each among themselves, all else stays.

Values that fail validation stay as they are; of overlapping ones the first counts, at one place the first of ``KINDS``.
Null text stays null; empty text and text without such data is unchanged, very long texts are searched whole.  Repeated
rows get equal answers, an empty table an empty one.  Every column stays, whatever its name, but one named
``n_private``, whose place the count takes.  No shuffle, no Python, one pass over whole texts.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta.llm.common import free_name, plain, table

#: Where the session's configuration has the key.
KEY_SETTING = "spark.veduta.pseudonym.key"
#: The registered query's key where that is unset; it protects nothing.
TEST_KEY = "pseudonym-key-1"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
CARD = r"(?<![\w-])\d{4}([ -]?)\d{4}\1\d{4}\1(?:\d{4}\1\d{1,3}|\d{1,7})(?![\w-])|(?<![\w-])3[47]\d\d[ -]?\d{6}[ -]?\d{5}(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
HOST = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w+])\+\d{1,3}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){2,3}(?![\w-])|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
DATE = r"(?<![\w/.-])(?:(?:19|20)\d\d-\d\d-\d\d(?:(?=T\d\d:)|(?![\w/-]))|(?:\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![\w/-]))"
HEX = r"[0-9a-f]{32,64}|[0-9A-F]{32,64}"
SECRET = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=password=)[^\s\"'<>&]{4,64}|(?<=[\"'])(?:" + HEX + r")(?=[\"'])"
KINDS = {"email": EMAIL, "host": HOST, "date": DATE, "ssn": SSN, "card": CARD, "phone": PHONE, "secret": SECRET}
#: The back-reference of CARD is its only group.
ANY = "|".join(f"(?:{KINDS[k]})" for k in KINDS)
#: In every text that holds a value; cheap, and true of few texts.
HINT = r"@|[0-9]\.?[0-9]|password=|AKIA|[\"'][0-9a-fA-F]{32}"
ROUNDS, CHUNK = 8, 16


def _let(x: Column, f) -> Column:
    """``f(x)`` with x computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _feistel(x: Column, left: Column | int, right: Column | int, label: Column, key: str) -> Column:
    """Permutes the integers below left * right, each at most 2**31; the halves' moduli take turns."""
    left, right = (F.lit(v).cast("long") if isinstance(v, int) else v for v in (left, right))
    given = F.struct(x.alias("x"), left.alias("m"), right.alias("n"), label.alias("t"))

    def step(s: Column, r: Column) -> Column:
        f = F.pmod(F.xxhash64(F.lit(key), r, s["t"], s["b"]), s["m"])
        return F.struct(s["b"].alias("a"), ((s["a"] + f) % s["m"]).alias("b"), s["n"].alias("m"), s["m"].alias("n"), s["t"].alias("t"))

    def run(g: Column) -> Column:
        state = F.struct(F.floor(g["x"] / g["n"]).cast("long").alias("a"), (g["x"] % g["n"]).alias("b"), g["m"].alias("m"), g["n"].alias("n"), g["t"].alias("t"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, step, lambda s: s["a"] * s["n"] + s["b"])

    return _let(given, run)


def _blocks(s: Column, size: int, f) -> Column:
    """``f(block, its length, its number)`` of each block of ``size`` characters, joined."""

    def each(s: Column) -> Column:
        one = lambda i: _let(F.substring(s, i * size + 1, F.lit(size)), lambda part: f(part, F.length(part), i))
        return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), one), ""))

    return _let(s, each)


def _digits(d: Column, label: Column, key: str) -> Column:
    """Permutes digit strings of each length, in blocks of at most 16."""
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")

    def one(part: Column, m: Column, i: Column) -> Column:
        high = F.floor(m / 2).cast("int")
        tag = F.concat_ws(" ", label, m.cast("string"), i.cast("string"))
        return F.lpad(_feistel(part.try_cast("long"), ten(high), ten(m - high), tag, key).cast("string"), m, F.lit("0"))

    return _blocks(d, CHUNK, one)


def _letters(s: Column, label: Column, key: str, alphabet: str) -> Column:
    """Permutes strings over one alphabet, in blocks of six."""
    base = len(alphabet)
    power = lambda k: F.pow(F.lit(float(base)), k).cast("long")

    def one(part: Column, m: Column, i: Column) -> Column:
        value = F.aggregate(F.sequence(F.lit(1), m), F.lit(0).cast("long"), lambda a, k: a * base + F.ascii(F.substring(part, k, F.lit(1))) - ord(alphabet[0]))
        high = F.floor(m / 2).cast("int")
        out = _feistel(value, power(high), power(m - high), F.concat_ws(" ", label, m.cast("string"), i.cast("string")), key)
        spell = lambda v: F.array_join(F.transform(F.sequence(m - 1, F.lit(0)), lambda k: F.char(F.floor(v / power(k)) % base + ord(alphabet[0]))), "")
        return _let(out, spell)

    return _blocks(s, 6, one)


def _refilled(shape: Column, pattern: str, chars: Column) -> Column:
    """``shape`` with the characters that match ``pattern`` replaced by those of ``chars`` in turn."""
    join = lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    return F.array_join(F.zip_with(F.split(shape, pattern, -1), F.split(chars, "(?!^)"), join), "")


def _class(s: Column, pattern: str, alphabet: str | None, label: str, key: str) -> Column:
    shape = F.concat(F.lit(label + " "), F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A"))

    def run(g: Column) -> Column:
        new = _digits(g["own"], g["shape"], key) if alphabet is None else _letters(g["own"], g["shape"], key, alphabet)
        return F.when(F.length(g["own"]) > 0, _refilled(g["s"], pattern, new)).otherwise(g["s"])

    return _let(F.struct(s.alias("s"), F.regexp_replace(s, pattern.replace("[", "[^"), "").alias("own"), shape.alias("shape")), run)


def _hex(s: Column, key: str) -> Column:
    """Permutes hexadecimal strings of each length, in blocks of at most 12 digits; in small letters."""
    power = lambda k: F.pow(F.lit(16.0), k).cast("long")

    def one(part: Column, m: Column, i: Column) -> Column:
        high = F.floor(m / 2).cast("int")
        out = _feistel(F.conv(part, 16, 10).cast("long"), power(high), power(m - high), F.concat_ws(" ", F.lit("hex"), m.cast("string"), i.cast("string")), key)
        return F.lower(F.lpad(F.hex(out), m, F.lit("0")))

    return _blocks(s, 12, one)


def _permuted(s: Column, label: str, key: str, letters: bool) -> Column:
    """Every class of characters of ``s`` permuted for itself."""
    out = _let(s, lambda x: _class(x, "[0-9]", None, label, key))
    if letters:
        out = _let(out, lambda x: _class(x, "[a-z]", "abcdefghijklmnopqrstuvwxyz", label, key))
        out = _let(out, lambda x: _class(x, "[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", label, key))
    return out


def luhn(d: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10."""

    def run(d: Column) -> Column:
        n = F.length(d)
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10

    return _let(d, run)


def _card(s: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        return F.length(d).between(13, 19) & (luhn(d) == 0)

    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _digits(F.substring(d, F.lit(2), F.length(d) - 2), F.lit("card"), key))
        return _let(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))

    def run(d: Column) -> Column:
        # A fifth group may be a number that merely follows.
        four = s.rlike(r"^\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{1,3}$")
        first = F.substring(d, 1, 16)
        behind = F.concat(_refilled(F.substring(s, 1, 19), "[0-9]", _let(first, new)), F.substring(s, F.lit(20), F.length(s)))
        return F.when(valid(d), _refilled(s, "[0-9]", new(d))).when(four & valid(first), behind).otherwise(s)

    return _let(F.regexp_replace(s, "[^0-9]", ""), run)


def _moved(inside, spelt, first: int, days: int):
    return lambda n: F.when(n.between(0, days - 1), spelt(F.date_add(F.lit("1970-01-01").cast("date"), (inside(n) + first).cast("int"))))


def _date(s: Column, key: str) -> Column:
    first, days = -25567, 73049  # 1900-01-01 to 2099-12-31 as days since 1970
    walk = lambda x: _feistel(x, 271, 270, F.lit("date"), key)  # noqa: E731  below 73,170: seldom a step outside
    out = s
    for pattern, form in ((r"^\d{4}-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), (r"^\d\d\.", "dd.MM.yyyy")):

        inside = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(8)), walk(n), lambda x, _: F.when(x >= days, walk(x)).otherwise(x))
        spelt = partial(F.date_format, format=form)
        moved = _moved(inside, spelt, first, days)
        number = (F.unix_date(F.to_date(F.try_to_timestamp(s, F.lit(form)))) - first).cast("long")
        out = F.when(s.rlike(pattern), F.coalesce(_let(number, moved), s)).otherwise(out)
    return out


def _host(s: Column, key: str) -> Column:
    value = F.aggregate(F.split(s, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    spell = lambda v: F.array_join(F.transform(F.array(*[F.lit(p) for p in (16777216, 65536, 256, 1)]), lambda p: (F.floor(v / p) % 256).cast("string")), ".")
    return _let(_feistel(value, 65536, 65536, F.lit("host"), key), spell)


def _email(s: Column, key: str) -> Column:
    host = F.regexp_extract(s, r"@(.*)\.[A-Za-z]+$", 1)
    return F.concat(_permuted(F.regexp_extract(s, "^[^@]*", 0), "name", key, True), F.lit("@"), _permuted(host, "domain", key, True), F.regexp_extract(s, r"\.[A-Za-z]+$", 0))


def _ssn(s: Column, key: str) -> Column:
    area, ok = F.substring(s, 1, 3), ~s.rlike(r"^(000|666|9..)|-00-|-0000$")
    value = F.concat(F.substring(s, 5, 2), F.substring(s, 8, 4)).cast("long")
    new = F.lpad(_feistel(value, 1000, 1000, F.concat(F.lit("ssn "), area), key).cast("string"), 6, "0")
    return F.when(ok, _let(new, lambda n: F.concat(area, F.lit("-"), F.substring(n, 1, 2), F.lit("-"), F.substring(n, 3, 4)))).otherwise(s)


def _phone(s: Column, key: str) -> Column:
    country = F.regexp_extract(s, r"^\+\d{1,3}(?=[ .(-])", 0)
    return _let(country, lambda c: F.concat(c, _permuted(F.substring(s, F.length(c) + 1, F.length(s)), "phone", key, False)))


def pseudonym(s: Column, key: str) -> Column:
    """Of one value that ``ANY`` found; a value that fails its validation stays."""
    whole = lambda k: s.rlike(f"^(?:{_bare(KINDS[k])})$")
    out = F
    for k, f in (("email", _email), ("host", _host), ("date", _date), ("ssn", _ssn), ("card", _card), ("phone", _phone)):
        out = out.when(whole(k), f(s, key))
    out = out.when(s.rlike("^[0-9a-f]{32,64}$"), _hex(s, key)).when(s.rlike("^[0-9A-F]{32,64}$"), F.upper(_hex(F.lower(s), key)))
    return out.otherwise(_permuted(s, "secret", key, True))


def _bare(pattern: str) -> str:
    """Without its look-arounds, which need the text about a value."""
    import re

    return re.sub(r"\(\?<?[!=](?:\[[^\]]*\]|[^()\[\]])*\)", "", pattern)


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The rows of ``docs`` with the text pseudonymised, and ``n_private``: how many values were changed.

    Without a key given or set as ``spark.veduta.pseudonym.key`` there is no answer.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"no key: give one or set {KEY_SETTING}")
    found, rest, new = (free_name(docs, x) for x in ("found", "rest", "new"))
    likely = F.col("text").rlike(HINT)
    marked = docs.withColumns({found: F.when(likely, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))), rest: F.when(likely, F.split("text", ANY, -1))})
    changed = marked.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda x: pseudonym(x, key))))
    text = F.when(F.size(found) > 0, F.array_join(F.zip_with(rest, new, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")).otherwise(F.col("text"))
    n = F.when(F.size(found) > 0, F.aggregate(F.zip_with(found, new, lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda a, x: a + x)).otherwise(0)
    return changed.select(*[text.alias(c) if c == "text" else plain(c) for c in docs.columns if c != "n_private"], n.alias("n_private"))


def op5_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, TEST_KEY))
