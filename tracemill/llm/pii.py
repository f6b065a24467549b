"""Surrogates for personal data, in DataFrame functions only.

Entities are found by patterns (below).  Each gets a replacement derived from
SHA-256 of (key, type, canonical form, attempt): of the same type and format,
digits for digits and letters for letters of the same case, a name of the same
gender and script.  The same canonical form gets the same surrogate in every
text, so what referred to one entity still does.  The key is the caller's secret:
without it surrogates can be recomputed by nobody.

What is found
    e-mail addresses (local part of up to 64 characters, up to 16 labels);
    secrets, that is values after a key word (password, token and so on), quoted
    or not, and ``=`` or ``:``, unquoted ones if they hold a digit or another sign
    than a letter, and keys with the prefix AKIA or ASIA; IBANs; IPv4 addresses; US
    social security numbers; card numbers of 13 to 19 digits that start with 2
    to 6 and pass Luhn's test (of 13 digits only those that start with 4); phone
    numbers with a country or area code; names after a title and, in the texts
    that hold such a name, every other mention of it in full or by family name.
    Names never mentioned with a title are not found.

Names
    the given and the family name are entities of their own, so that ``Mr. John
    Smith``, ``John Smith`` and ``Mr. Smith`` come out as one person.  After a
    title for both genders the given name decides: one in a, а or я is female.

Distinctness is checked over the whole table: of entities of a type that come to
one surrogate, and of surrogates that equal an entity found or one given before,
the first keeps it and the others try again with the next attempt, until none is
left; only those attempts are joined back.  From ``LONGER`` attempts on the
surrogate is longer than its format, so that a format too small for its entities
ends the search.

Defined results
    null text stays null, text without an entity stays as it is; repeated rows
    are replaced alike; an empty input gives no rows.  Every pattern takes time
    in proportion to the text, however long.  Input columns but the text travel in
    the struct ``record``, so none can clash.  Give a table or a checkpoint,
    whose rows come in the same order when a lost task runs again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ordinal, written

LONGER = 6

_MALE, _FEMALE = r"(?:Mr|Herrn?|Monsieur|Señor|Sr|г-н)", r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Dra|г-жа)"
_EITHER = r"(?:Dr|Prof|Doctor|Professor|д-р|проф)"
_NAME = r"\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)?"
#: What precedes the name after a title.
_TITLE = rf"(?:(?:{_MALE}|{_FEMALE})\.? (?:{_EITHER}\.? ){{0,2}}|(?:{_EITHER}\.? ){{1,2}})"

#: Patterns by type, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,16}\p{L}{2,63}",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key))[\"']?\s*[=:]\s*[\"']?[^\s\"',;]{6,}",
    "cloud_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3,4}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}{_NAME}(?: {_NAME})?",
}
#: Every match starts where no letter or digit precedes, but for keys of a fixed form.
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + f")|{PATTERNS['cloud_key']}"
#: What every text with a match has; other texts are passed on as they are.
MAYBE = rf"[@\d=:]|AKIA|ASIA|(?<![\p{{L}}\p{{N}}]){_TITLE}"

#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    ("latin", "male"): "Adam Bruno Carl David Edwin Frank Georg Henri Ivan Jonas Karl Louis Martin Noel Oscar Paul".split(),
    ("latin", "female"): "Alice Berta Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olivia Paula".split(),
    ("cyrillic", "male"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Фёдор".split(),
    ("cyrillic", "female"): "Анна Вера Галина Дарья Елена Жанна Ирина Клара Лидия Мария Нина Ольга Полина Раиса София Юлия".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke la le li lo ma mi mo na ne ni ra re ri ro sa se ta to".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ха хе ка ке ла ле ли ло ма ми мо на не ни ра ре ри ро са се та то".split(),
}


def kind_of(match: Column) -> Column:
    """The type of a match: the first whose pattern is all of it; null for what fails the tests of its type."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, pattern in PATTERNS.items():
        holds = F.lit(True)
        if kind == "card":
            digits = _digits(match)
            body = F.substring(digits, F.lit(1), F.length(digits) - 1)
            holds = F.rlike(digits, F.lit(r"^(?:4\d{12}|[2-6]\d{13,18})$")) & (_luhn(body) == digits)
        if kind == "secret":
            holds = F.rlike(secret_value(match), F.lit(r"\P{L}")) | F.rlike(match, F.lit(r"[=:]\s*[\"']"))
        out = out.when(F.rlike(match, F.lit(f"^(?:{pattern})$")), F.when(holds, F.lit(kind)))
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def secret_value(match: Column) -> Column:
    return F.regexp_extract(match, r"""^[^=:]*[=:]\s*["']?(.*)$""", 1)


def canonical(kind: Column, match: Column) -> Column:
    """What mentions of one entity have in common."""
    digits = _digits(match)
    return (
        F.when(kind == "email", F.lower(match))
        .when(kind == "secret", secret_value(match))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.substring(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10)))
        .when(kind == "iban", F.regexp_replace(match, " ", ""))
        .otherwise(match)
    )


def with_surrogate(entities: DataFrame, attempt: int, key: str) -> DataFrame:
    """``entities`` (kind, entity) with the surrogate ``made`` of an attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "entity", F.lit(str(attempt)))
    noise = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring("hexes", i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return (
        entities.withColumn("hexes", F.concat(F.sha2(F.concat(F.lit("a"), seed), 256), F.sha2(F.concat(F.lit("b"), seed), 256)))
        .withColumn("noise", noise)
        .withColumn("made", surrogate(F.col("kind"), F.col("entity"), F.lit(attempt), F.col("noise")))
        .drop("hexes", "noise")
    )


_DIGIT, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX, _CYR_UPPER, _CYR_LOWER = "0123456789abcdef", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "абвгдежзиклмнопрстуфхцчшщэюя"


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _like(value: Column, noise: Column, hexadecimal: bool = False) -> Column:
    """``value`` with digits, and letters by case and script, drawn anew."""

    def one(ch: Column, i: Column) -> Column:
        n = F.element_at(noise, i % 64 + 1) + F.floor(i / 64).cast("int")
        out = (
            F.when(F.rlike(ch, F.lit(r"\d")), _pick(_DIGIT, n))
            .when(F.rlike(ch, F.lit(r"[\p{IsCyrillic}&&\p{Lu}]")), _pick(_CYR_UPPER, n))
            .when(F.rlike(ch, F.lit(r"\p{IsCyrillic}")), _pick(_CYR_LOWER, n))
            .when(F.rlike(ch, F.lit(r"\p{Lu}")), _pick(_UPPER, n))
            .when(F.rlike(ch, F.lit(r"\p{L}")), _pick(_LOWER, n))
            .otherwise(ch)
        )
        return _pick(_HEX, n) if hexadecimal else out

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(body: Column) -> Column:
    """``body`` with its check digit."""
    chars = F.reverse(F.split(body, ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _iban(country: Column, rest: Column) -> Column:
    """Country, check digits and ``rest``, with the checks of ISO 13616."""
    number = lambda c: F.when(F.rlike(c, F.lit(r"\d")), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda s, c: (s * F.when(F.rlike(c, F.lit(r"\d")), 10).otherwise(100) + number(c)) % 97
    left = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), step)
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def surrogate(kind: Column, entity: Column, attempt: Column, noise: Column) -> Column:
    """The replacement of a canonical form from 64 numbers below 256; given names
    take the gender that ends the form."""
    n = lambda i: F.element_at(noise, i)
    local, digits = F.substring_index(entity, "@", 1), entity
    longer = F.when(attempt >= LONGER, F.concat(*[_pick(_DIGIT, n(40 + j)) for j in range(8)])).otherwise(F.lit(""))
    plain = _like(digits, noise)
    length = F.length(entity)
    email = F.concat(
        _like(F.when(F.length(local) < 6, F.rpad(local, 6, "x")).otherwise(local), noise), longer,
        F.lit("@example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), n(64) % 3 + 1),
    )
    octets = F.concat_ws(".", F.lit("10"), n(1).cast("string"), n(2).cast("string"), (n(3) % 254 + 1).cast("string"))
    card = _luhn(F.concat(F.substring(entity, 1, 1), F.substring(plain, F.lit(2), length - 2), longer))
    ssn = F.concat(F.lit("9"), F.substring(plain, 2, 8), longer)
    # Ten digits: an area code from 2 on, the reserved exchange 555 and a line.
    phone = F.when(
        length == 10, F.concat((n(1) % 8 + 2).cast("string"), F.substring(plain, 2, 2), F.lit("555"), F.substring(plain, 7, 4), longer)
    ).otherwise(F.concat((n(1) % 8 + 2).cast("string"), F.substring(plain, F.lit(2), length - 1), longer))
    cloud = F.concat(F.substring(entity, 1, 4), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: _pick(_UPPER + "234567", n(i))), ""), longer)
    secret = F.concat(F.when(F.rlike(entity, F.lit("^[0-9a-f]{8,}$")), _like(entity, noise, True)).otherwise(plain), longer)

    def spelt(script: str, first: int, count: int) -> Column:
        return F.initcap(F.concat(*[F.element_at(F.array(*map(F.lit, SYLLABLES[script])), n(first + j) % 32 + 1) for j in range(count)]))

    def name(script: str) -> Column:
        more = F.when(attempt >= LONGER, F.concat(F.lit("-"), spelt(script, 20, 4))).otherwise(F.lit(""))
        listed = lambda gender: F.element_at(F.array(*map(F.lit, GIVEN[script, gender])), n(1) % 16 + 1)
        # The list is soon used up; then given names are spelt, female ones with a last a.
        female = F.endswith(entity, F.lit("/f"))
        own = F.concat(spelt(script, 30, 3), F.when(female, "a" if script == "latin" else "а").otherwise("n" if script == "latin" else "н"))
        given = F.when(attempt > 0, own).otherwise(F.when(female, listed("female")).otherwise(listed("male")))
        return F.concat(F.when(kind == "given", given).otherwise(spelt(script, 10, 4)), more)

    return (
        F.when(kind == "email", email)
        .when(kind == "secret", secret)
        .when(kind == "cloud_key", cloud)
        .when(kind == "iban", _iban(F.substring(entity, 1, 2), F.concat(F.substring(plain, F.lit(5), length - 4), longer)))
        .when(kind == "ip", F.when(attempt < LONGER, octets).otherwise(F.concat_ws(".", octets, n(4).cast("string"))))
        .when(kind == "ssn", ssn)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .otherwise(F.when(F.rlike(entity, F.lit(r"\p{IsCyrillic}")), name("cyrillic")).otherwise(name("latin")))
    )


def render(kind: Column, match: Column, made: Column) -> Column:
    """The surrogate ``made`` in the format of the mention ``match``."""
    size = F.length(_digits(match))

    def digit(ch: Column, i: Column) -> Column:
        # The k-th digit from the right is the surrogate's; digits before those stay (a country code).
        k = size - F.length(_digits(F.substring(match, F.lit(1), i + 1)))
        at = F.length(made) - k
        return F.when(F.rlike(ch, F.lit(r"\d")) & (at >= 1), F.substring(made, at, F.lit(1))).otherwise(ch)

    spread = F.array_join(F.transform(F.split(match, ""), digit), "")
    extra = F.length(made) - F.length(canonical(kind, match))
    formatted = F.when(extra > 0, made).otherwise(spread)
    value = secret_value(match)
    at = F.instr(match, "@")
    cased = F.transform(
        F.split(F.substring_index(made, "@", 1), ""),
        lambda ch, i: F.when((i + 1 < at) & F.rlike(F.substring(match, i + 1, F.lit(1)), F.lit(r"\p{Lu}")), F.upper(ch)).otherwise(ch),
    )
    domain = F.concat(F.lit("@"), F.substring_index(made, "@", -1))
    capitals = F.substring(match, at, F.length(match)) == F.upper(F.substring(match, at, F.length(match)))
    return (
        F.when(kind == "secret", F.concat(F.substring(match, F.lit(1), F.length(match) - F.length(value)), made))
        .when(kind == "email", F.concat(F.array_join(cased, ""), F.when(capitals, F.upper(domain)).otherwise(domain)))
        .when(kind.isin("phone", "card", "ssn"), formatted)
        .when(kind == "iban", F.when(F.contains(match, F.lit(" ")), F.trim(F.regexp_replace(made, "(.{4})", "$1 "))).otherwise(made))
        .otherwise(made)
    )


def names_of(text: Column) -> Column:
    """(given or null, family, gender) of each name after a title in ``text``."""

    def one(match: Column) -> Column:
        title = F.regexp_extract(match, f"^{_TITLE}", 0)
        words = F.split(F.substring(match, F.length(title) + 1, F.length(match)), " ")
        given = F.when(F.size(words) > 1, F.get(words, F.lit(0)))
        by_name = F.when(F.rlike(given, F.lit("[aая]$")), "f").otherwise("m")
        gender = F.when(F.rlike(title, F.lit(rf"^{_FEMALE}\.? ")), "f").when(F.rlike(title, F.lit(rf"^{_MALE}\.? ")), "m").otherwise(by_name)
        return F.struct(given.alias("given"), F.element_at(words, -1).alias("family"), gender.alias("gender"))

    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)), one)
    return F.when(F.rlike(text, F.lit(_TITLE)), F.array_distinct(found)).otherwise(F.array().cast("array<struct<given:string,family:string,gender:string>>"))


def pattern_of(names: Column) -> Column:
    """``ANY`` and, in a text with ``names``, these without a title, in full or by family name."""
    full = F.transform(F.filter(names, lambda x: x["given"].isNotNull()), lambda x: F.concat(x["given"], F.lit(" "), x["family"]))
    bare = F.array_distinct(F.concat(full, F.transform(names, lambda x: x["family"])))
    more = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?:"), F.array_join(bare, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(names) > 0, more).otherwise(F.lit(ANY))


def mentions(rows: DataFrame) -> DataFrame:
    """row, at (place in the text) and kind of every match; and of each part of
    it that is an entity (two of a full name): k, part_kind, entity, before (what
    stands before the part in the match) and shown.  What fails the tests of its
    type has no kind and no entity."""
    found = rows.where(F.rlike("text", F.lit(MAYBE))).withColumn("names", names_of(F.col("text")))
    found = found.select("row", "names", F.posexplode(F.regexp_extract_all("text", pattern_of(F.col("names")), F.lit(0))).alias("at", "match"))
    match = F.col("match")
    title = F.regexp_extract(match, f"^{_TITLE}", 0)
    bare = F.exists("names", lambda x: (match == x["family"]) | (match == F.concat(x["given"], F.lit(" "), x["family"])))
    typed = found.withColumn("kind", F.coalesce(kind_of(match), F.when(bare, "name")))
    kind = F.col("kind")
    named = typed.withColumn("title", F.when(kind == "name", title)).withColumn(
        "words", F.when(kind == "name", F.split(F.substring(match, F.length("title") + 1, F.length(match)), " "))
    )
    gender = F.coalesce(F.get(F.filter("names", lambda x: x["given"] == F.get("words", F.lit(0))), F.lit(0))["gender"], F.lit("m"))

    def part(k: int, kind: Column, entity: Column, before: Column, shown: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), kind.alias("part_kind"), entity.alias("entity"), before.alias("before"), shown.alias("shown"))

    first, last, none = F.get("words", F.lit(0)), F.element_at("words", -1), F.lit("")
    parts = (
        F.when(kind.isNull(), F.array(part(0, kind, F.lit(None).cast("string"), none, match)))
        .when(kind != "name", F.array(part(0, kind, canonical(kind, match), none, match)))
        .when(F.size("words") > 1, F.array(
            part(0, F.lit("given"), F.concat(first, F.lit("/"), gender), F.col("title"), first),
            part(1, F.lit("family"), last, F.lit(" "), last),
        ))
        .otherwise(F.array(part(0, F.lit("family"), last, F.col("title"), last)))
    )
    return named.select("row", "at", "kind", F.inline(parts))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, made) with distinct surrogates, none of which is an entity.

    ``entities`` has each (kind, entity) once.  A round writes only what is still open.
    """
    spark = entities.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = entities.select("kind", F.regexp_replace("entity", "/[mf]$", "").alias("made")).distinct()
    attempt, settled = 0, []
    while True:
        # Dealt out by number, as the making of surrogates costs more than their few bytes tell.
        tried = written(with_surrogate(entities.repartition(tasks, "kind", "entity"), attempt, key), "tried")
        # The least hash of those that came to a surrogate keeps it.
        owner = tried.groupBy("kind", "made").agg(F.min(F.struct(F.xxhash64("entity").alias("h"), "entity")).alias("own"))
        free = owner.join(taken, ["kind", "made"], "left_anti")
        decided = written(
            tried.join(free, ["kind", "made"], "left")
            .select("kind", "entity", "made", F.coalesce(F.col("own.entity") == F.col("entity"), F.lit(False)).alias("stays")),
            "decided",
        )
        won = decided.where("stays").select("kind", "entity", "made")
        settled.append(won)
        entities = decided.where("not stays").select("kind", "entity")
        if entities.isEmpty():
            return reduce(DataFrame.union, settled)
        taken, attempt = taken.union(won.select("kind", "made")), attempt + 1


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """text (with surrogates), entities (at, kind and surrogate of each mention,
    in order) and record (the other input columns) of each row."""
    rows = docs.select(
        ordinal(docs).alias("row"), F.col(f"`{text_col}`").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("record"),
    )
    found = written(mentions(rows.select("row", "text")), "mentions")
    known = found.where("part_kind is not null")
    made = surrogates(known.select(F.col("part_kind").alias("kind"), "entity").distinct(), key).withColumnRenamed("kind", "part_kind")
    # An entity of very many texts is matched in the parts of the input that hold it.
    part = F.shiftright("row", 33).alias("part")
    local = known.select(part, "part_kind", "entity").distinct().join(made, ["part_kind", "entity"])
    shown = F.concat("before", render(F.col("part_kind"), F.col("shown"), F.col("made")))
    pieces = (
        known.withColumn("part", part).join(local, ["part", "part_kind", "entity"]).select("row", "at", "kind", "k", shown.alias("piece"))
        .union(found.where("part_kind is null").select("row", "at", "kind", "k", "shown"))
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "")
    whole = pieces.groupBy("row", "at", "kind").agg(joined.alias("surrogate"))
    replaced = whole.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "surrogate"))).alias("found"))
    replaced = written(replaced, "replaced")
    rebuilt = F.array_join(
        F.transform(F.split("text", pattern_of(names_of(F.col("text"))), -1), lambda b, i: F.concat(b, F.coalesce(F.get("found", i)["surrogate"], F.lit("")))), ""
    )
    none = F.array().cast(replaced.schema["found"].dataType)
    entities = F.filter(F.coalesce("found", none), lambda x: x["kind"].isNotNull()).alias("entities")
    maybe = F.coalesce(F.rlike("text", F.lit(MAYBE)), F.lit(False))
    # Only texts that may hold an entity are shuffled.
    return (
        rows.where(maybe).join(replaced, "row", "left")
        .select(F.when(F.col("found").isNull(), F.col("text")).otherwise(rebuilt).alias("text"), entities, "record")
        .union(rows.where(~maybe).select("text", none.alias("entities"), "record"))
    )
