"""Surrogates for personal data: keyed, type-consistent replacements in DataFrame expressions only."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash128, stored, text_of, without

#: Titles before a name, by the gender they tell. Fixed values.
TITLES_F = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Госпожа"]
TITLES_M = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
TITLES_N = ["Dr", "Prof"]

#: Given names by script and gender, for surrogates, for the gender of a name without a telling title, and for names without one. Fixed values.
GIVEN = {
    ("latin", "f"): ["Anna", "Maria", "Julia", "Laura", "Sofia", "Emma", "Clara", "Nora", "Alice", "Elena", "Sarah", "Lucia", "Marta", "Ingrid", "Paula", "Irene"],
    ("latin", "m"): ["David", "Martin", "Thomas", "Daniel", "Peter", "Oscar", "Simon", "Felix", "Hugo", "Robert", "Victor", "Adrian", "Julian", "Stefan", "Bruno", "Marco"],
    ("latin", "n"): ["Alex", "Robin", "Kim", "Jordan", "Taylor", "Morgan", "Casey", "Jamie"],
    ("cyrillic", "f"): ["Анна", "Мария", "Ольга", "Елена", "Ирина", "Вера", "Нина", "Дарья"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Олег", "Павел", "Антон", "Борис", "Роман", "Юрий"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Шура"],
}
#: Further given names whose gender is told. Fixed values.
KNOWN = {
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Karen", "Margaret", "Emily", "Ingeborg", "Ursula", "Petra", "Heike", "Claire", "Sophie", "Camille", "Carmen", "Pilar", "Isabel", "Catherine", "Helen", "Ruth", "Jane", "Jean", "Татьяна", "Наталья", "Светлана", "Екатерина"],
    "m": ["John", "James", "Michael", "William", "Richard", "Joseph", "Charles", "Christopher", "Matthew", "Andrew", "Paul", "Mark", "George", "Kevin", "Carl", "Hans", "Klaus", "Jürgen", "Wolfgang", "Pierre", "Jacques", "Antoine", "Carlos", "José", "Juan", "Miguel", "Henry", "Edward", "Сергей", "Алексей", "Дмитрий", "Николай"],
}
SYLLABLES = {
    "latin": ["bar", "ben", "cor", "dal", "den", "far", "gar", "hol", "kan", "lan", "lor", "mar", "mel", "nor", "pel", "ran", "ros", "sal", "sen", "tal", "ter", "val", "ver", "wen"],
    "cyrillic": ["бар", "бел", "вар", "вол", "гор", "дан", "дор", "зол", "кар", "кор", "лан", "мар", "мел", "нор", "пал", "рад", "рос", "сав", "сол", "тар", "тел", "фед", "хар", "чер"],
}
LATIN, DIGIT, HEX = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0123456789",), ("0123456789abcdef",)
ALNUM = (*LATIN, *DIGIT)
#: From this attempt on, surrogates of a form that is nearly used up become longer.
WIDER = 8

_EDGE, _END = r"(?=\p{Lu})(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_PART = r"\p{Lu}(?:['’]\p{Lu})?\p{L}++"
_NAME = rf"{_PART}(?:-{_PART})?"
_GIVEN_WORD = rf"(?:{_NAME}|(?:\p{{Lu}}\.){{1,2}}) "
#: What issuers put before their keys. Fixed values.
_PREFIX = r"(?:(?:sk|pk|rk)[-_](?:[a-z]{2,8}[-_])?|gh[opsur]_|github_pat_|glpat-|xox[abeprs]-|hf_|npm_|AKIA|ASIA|AIza)"
_TITLE = "|".join([*TITLES_F, *TITLES_M, *TITLES_N, *(t.upper() for t in ("Mrs", "Ms", "Miss", "Mr", "Sir", "Herr", "Frau", "Dr", "Prof"))])
_FIRST = "|".join(sorted({n for names in (*(v for (_, g), v in GIVEN.items() if g != "n"), *KNOWN.values()) for n in names}))
_H = "[0-9A-Fa-f]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: In the order in which they claim a place in the text. No pattern tries more than a bounded number of characters again:
#: long runs are entered at their start only, or taken possessively.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "secret": rf"(?<![0-9A-Za-z])[0-9a-fA-F]{{32,}}+(?![0-9A-Za-z])|(?<![0-9A-Za-z_-]){_PREFIX}[0-9A-Za-z_-]{{16,}}+|(?<![0-9A-Za-z_-])eyJ[0-9A-Za-z_-]{{8,}}+\.[0-9A-Za-z_-]{{8,}}+\.[0-9A-Za-z_-]{{8,}}+",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])"
    rf"|(?<![0-9A-Za-z:.])(?:(?:{_H}:){{7}}{_H}|(?=[0-9A-Fa-f:]{{0,40}}[0-9])(?:(?:{_H}:){{1,7}}:(?:{_H}(?::{_H}){{0,6}})?|::{_H}(?::{_H}){{0,6}}))(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|(?:[0-9]{4}[ -]){4}[0-9]{3}|(?<![0-9][.,])[0-9]{13,19})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}(?:\)?[ .-]|\))[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[1-9](?:\)?[ .-]?\(?[0-9]){6,14}(?![0-9])"
    r"|(?<![0-9.,/-])(?:0[0-9]{1,4}[ /-]|\(0[0-9]{1,4}\) ?)[0-9]{3,4}[ -]?[0-9]{3,5}(?![0-9])|(?<![0-9.,/-])0[1-9](?:[ .][0-9]{2}){4}(?![0-9.])",
    "person": rf"{_EDGE}(?:{_TITLE}){_END}\.? (?:{_GIVEN_WORD}){{0,2}}{_NAME}|{_EDGE}(?:{_FIRST}) (?:{_GIVEN_WORD})?{_NAME}",
}
#: No entity that begins with a letter begins inside a word: told first, since that is where most characters stand.
ENTITY = r"(?:(?=[0-9+(:])|(?<!\p{L}))(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: A text without any of these holds no entity; these tests are much cheaper than the patterns.
_MAYBE = ["[0-9@]", r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{19}", rf"{_EDGE}(?:{_TITLE}|{_FIRST}){_END}"]


def kind_of(entity: Column) -> Column:
    """The type whose pattern the whole entity matches; digits that are a card's only by a check digit they lack are a "number"."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        digits = F.regexp_replace(entity, "[^0-9]", "")
        own = F.when((F.length(digits) != 16) & (_luhn(digits.substr(F.lit(1), F.length(digits) - 1)) != F.substring(digits, -1, 1)), "number").otherwise(kind) if kind == "card" else F.lit(kind)
        out = F.when(entity.rlike(f"^(?:{pattern})$"), own).otherwise(out)
    return out


def _digest(key: str, *parts: Column) -> Column:
    """A keyed hash, from which all draws for a value come."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *parts), 256)


def _number(digest: Column, *places: Column | int) -> Column:
    """A number below 2^32 for these places of a digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", digest, *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in places]), 256), 1, 8), 16, 10).cast("long")


def _pick(options: Sequence[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (number % len(options) + 1).cast("int"))


def _same_form(value: Column, digest: Column, attempt: Column, alphabets: Sequence[str]) -> Column:
    """value with each letter or digit replaced by a drawn one of its alphabet; all else stays."""

    def swap(c: Column, i: Column) -> Column:
        n, out = _number(digest, attempt, i), c
        for alphabet in alphabets:
            out = F.when(c.isin(*alphabet), F.lit(alphabet).substr((n % len(alphabet) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), swap), "")


def _extra(digest: Column, attempt: Column, alphabet: str = "0123456789", after: int = WIDER) -> Column:
    """As many drawn characters as the attempt is beyond `after`."""
    return F.when(attempt <= after, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), attempt - after)), lambda i: F.lit(alphabet).substr((_number(digest, attempt, F.lit("extra"), i) % len(alphabet) + 1).cast("int"), F.lit(1))), ""))


def _luhn(digits: Column) -> Column:
    """The last digit of a card number whose others are `digits`."""
    total = F.aggregate(
        F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return ((10 - total % 10) % 10).cast("string")


def _in_groups(value: Column, plain: Column, kind: str) -> Column:
    """The characters of `plain` in the places of those of a class in value, which keeps its other characters."""
    place = lambda i: F.length(F.regexp_replace(value.substr(F.lit(1), i + 1), f"[^{kind}]", ""))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(f"[{kind}]"), plain.substr(place(i), F.lit(1))).otherwise(c)), "")


def _card(value: Column, digest: Column, attempt: Column) -> Column:
    """Digits in the same groups, the first one kept, with a right check digit where the original has one."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    others = digits.substr(F.lit(1), F.length(digits) - 1)
    body = F.concat(digits.substr(1, 1), _same_form(others.substr(F.lit(2), F.length(digits)), digest, attempt, DIGIT))
    last = F.when(_luhn(others) == F.substring(digits, -1, 1), _luhn(body)).otherwise(_pick(DIGIT[0], _number(digest, attempt, "check")))
    return F.concat(_in_groups(value, F.concat(body, last), "0-9"), _extra(digest, attempt))


def _mod97(code: Column) -> Column:
    """The remainder by 97 of a code whose letters count from 10."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(code, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97)


def _iban(value: Column, digest: Column, attempt: Column) -> Column:
    """The country and the groups stay; the check digits are right where the original's are."""
    plain = F.regexp_replace(value, " ", "")
    country, old = plain.substr(1, 2), plain.substr(F.lit(5), F.length(plain))
    body = _same_form(old, digest, attempt, (*DIGIT, LATIN[1]))
    right = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    check = F.when(_mod97(F.concat(old, plain.substr(1, 4))) == 1, right).otherwise(_same_form(plain.substr(3, 2), digest, F.concat(attempt.cast("string"), F.lit("check")), DIGIT))
    return F.concat(_in_groups(value, F.concat(country, check, body), "0-9A-Z"), _extra(digest, attempt))


def _secret(value: Column, digest: Column, attempt: Column) -> Column:
    """Hexadecimal digits in the case of the original; of other keys the prefix stays and the rest keeps its form."""
    hexes = _same_form(F.lower(value), digest, attempt, HEX)
    cased = F.array_join(F.zip_with(F.split(value, ""), F.split(hexes, ""), lambda c, h: F.when(c.rlike("[A-F]"), F.upper(h)).otherwise(h)), "")
    hexes = F.when(~value.rlike("[A-F]"), hexes).when(~value.rlike("[a-f]"), F.upper(hexes)).otherwise(cased)
    prefix = F.regexp_extract(value, f"^({_PREFIX}|eyJ)", 1)
    form = F.concat(prefix, _same_form(value.substr(F.length(prefix) + 1, F.length(value)), digest, attempt, ALNUM))
    return F.when(value.rlike("^[0-9a-fA-F]+$"), hexes).otherwise(form)


def _ip(value: Column, digest: Column, attempt: Column) -> Column:
    """An address outside 0.x and above 223.x, or one of the same groups; then one of the local range of version 6."""
    four = F.concat_ws(".", *[(_number(digest, attempt, i) % (256 if i else 223) + (0 if i else 1)).cast("string") for i in range(4)])
    six = _same_form(F.lower(value), digest, attempt, HEX)
    local = F.concat_ws(":", F.concat(F.lit("fd"), F.substring(F.sha2(F.concat_ws("|", digest, attempt.cast("string"), F.lit("net")), 256), 1, 2)), *[F.lower(F.lpad(F.hex(_number(digest, attempt, i) % 65536), 4, "0")) for i in range(7)])
    return F.when(attempt >= WIDER, local).when(value.contains(":"), six).otherwise(four)


def _email(value: Column, key: str, digest: Column, attempt: Column) -> Column:
    """The local part's form with new letters and digits, longer from the second attempt on; equal domains stay equal, under a reserved ending."""
    local, domain = F.regexp_extract(value, "^([^@]+)@", 1), F.lower(F.regexp_extract(value, "@(.+)$", 1))
    site = F.substring(_digest(key, F.lit("domain"), domain), 1, 16)
    return F.concat(_same_form(local, digest, attempt, ALNUM), _extra(digest, attempt, LATIN[0], 0), F.lit("@host-"), site, F.lit(".example"))


def _phone(value: Column, digest: Column, attempt: Column) -> Column:
    """The country code or a first 0 stays; digits are drawn anew in the same groups."""
    code = F.regexp_extract(value, r"^(\+[0-9]{1,3}|\(?0[1-9]?)", 1)
    return F.concat(code, _same_form(value.substr(F.length(code) + 1, F.length(value)), digest, attempt, DIGIT), _extra(digest, attempt))


def _made(script: Column, digest: Column, attempt: Column, part: Column, syllables: int = 4) -> Column:
    """A made name in lower case, one syllable longer with each attempt."""
    one = lambda j: F.when(script == "cyrillic", _pick(SYLLABLES["cyrillic"], _number(digest, attempt, part, j))).otherwise(_pick(SYLLABLES["latin"], _number(digest, attempt, part, j)))
    return F.array_join(F.transform(F.sequence(F.lit(1), attempt + syllables), one), "")


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _parts(word: Column) -> Column:
    """The parts of a name and the signs between them."""
    return F.regexp_extract_all(word, F.lit(r"[^-'’.]+|[-'’.]"), F.lit(0))


def _surname(unit: Column, digest: Column, attempt: Column) -> Column:
    """A made last name in lower case, of as many parts as the original; Cyrillic ones that end like a woman's do so again."""
    script = _script(unit)
    made = F.transform(_parts(unit), lambda p, i: F.when(p.rlike("[-'’.]"), p).when(F.length(p) == 1, F.substring(_made(script, digest, attempt, i), 1, 1)).otherwise(_made(script, digest, attempt, i)))
    return F.concat(F.array_join(made, ""), F.when((script == "cyrillic") & unit.rlike("[ая]$"), "а").otherwise(""))


def _given(names: Column, gender: Column, key: str, attempt: Column) -> Column:
    """Given names in lower case: listed ones of the same script and gender, made ones after a clash; initials stay initials."""
    script = _script(F.array_join(names, " "))

    def name(part: Column, i: Column) -> Column:
        digest = _digest(key, F.lit("given"), part)
        listed = F.lit(None).cast("string")
        for (s, g), options in GIVEN.items():
            listed = F.when((script == s) & (gender == g), F.lower(_pick(options, _number(digest, 0)))).otherwise(listed)
        made = F.concat(_made(script, digest, attempt, i), F.when(gender == "f", F.when(script == "cyrillic", "а").otherwise("a")).otherwise(""))
        full = F.when(attempt == 0, listed).otherwise(made)
        return F.when(part.rlike("[-'’.]"), part).when(F.length(part) == 1, F.substring(made, 1, attempt + 1)).otherwise(full)

    return F.array_join(F.transform(names, lambda word: F.array_join(F.transform(_parts(word), name), "")), " ")


def _cased(made: Column, like: Column) -> Column:
    """The made words with capitals as in the words that they replace."""
    up = lambda word: F.array_join(F.transform(_parts(word), F.initcap), "")
    return F.array_join(F.zip_with(F.split(made, " "), F.split(like, " "), lambda m, w: F.when((w == F.upper(w)) & (F.length(w) > 2) & ~w.contains("."), F.upper(m)).otherwise(up(m))), " ")


def settle(rows: DataFrame, by: Sequence[str], key_col: str, target: Callable[[Column], Column], real: bool) -> DataFrame:
    """rows (one for each `by` and key) with attempt and target, such that no two keys of a group share a target.

    Of keys that want one target the least keeps it and the others draw again;
    with `real`, a target that is itself a key of its group is drawn again as
    well. Targets get longer with the attempts, so there is always room, and
    the rounds end when no clash is left; a round leaves far fewer than before.
    """
    state = stored(rows.withColumn("attempt", F.lit(0)).withColumn("target", target(F.col("attempt"))), "surrogates")
    keys = rows.select(*by, F.col(key_col).alias("target"))
    while True:
        shared = state.groupBy(*by, "target").agg(F.min(key_col).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        moved = state.join(shared, [*by, "target"]).where(F.col(key_col) != F.col("owner")).select(*by, key_col)
        if real:
            moved = moved.unionAll(state.join(keys, [*by, "target"], "left_semi").select(*by, key_col)).distinct()
        moved = stored(moved.withColumn("again", F.lit(1)), "clashes")
        if not moved.limit(1).count():
            return state
        state = state.join(moved, [*by, key_col], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        state = stored(state.withColumn("target", F.when(F.col("again").isNull(), F.col("target")).otherwise(target(F.col("attempt")))).drop("again"), "surrogates")


def surrogate(kind: Column, value: Column, key: str, digest: Column, attempt: Column) -> Column:
    """A replacement of the same type and form (of a person, of the last name), a pure function of key, type, value and attempt."""
    return (
        F.when(kind == "email", _email(value, key, digest, attempt))
        .when(kind == "secret", _secret(value, digest, attempt))
        .when(kind == "ip", _ip(value, digest, attempt))
        .when(kind == "card", _card(value, digest, attempt))
        .when(kind == "ssn", F.concat(F.lit("9"), _same_form(value.substr(F.lit(2), F.length(value)), digest, attempt, DIGIT), _extra(digest, attempt)))
        .when(kind == "phone", _phone(value, digest, attempt))
        .when(kind == "person", _surname(value, digest, attempt))
        .otherwise(_iban(value, digest, attempt))
    )


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for the distinct (kind, value) rows.

    No two values of a kind share a surrogate, however many there are, and no
    surrogate is itself a value found in the corpus. E-mail addresses that
    differ in case only are one, and so are persons that differ in case or
    title only. A last name is replaced alike in all names, so mentions stay
    coreferent; the full names of one last name are kept apart by their given
    names. Gender is told by the title, else by the title of another mention
    of the full name, else by the given name's list; an untold one gets names
    of no gender. ALL CAPS, hyphens, apostrophes and initials keep their form.
    """
    title = F.regexp_extract("value", rf"^((?:{_TITLE}){_END}\.? )", 1)
    values = values.withColumn("title", F.when(F.col("kind") == "person", title).otherwise("")).withColumn("name", F.expr("substring(value, length(title) + 1)"))
    unit = F.when(F.col("kind") == "person", F.lower(F.element_at(F.split("name", " "), -1))).when(F.col("kind") == "email", F.lower("value")).otherwise(F.col("value"))
    values = stored(values.withColumn("unit", unit), "entity-values")
    units = values.select("kind", "unit").distinct().withColumn("digest", _digest(key, F.col("kind"), F.col("unit")))
    units = settle(stored(units, "entity-units"), ["kind"], "unit", lambda a: surrogate(F.col("kind"), F.col("unit"), key, F.col("digest"), a), real=True)

    others = values.where("kind <> 'person'").join(units, ["kind", "unit"])
    # Only e-mail addresses have values beside their unit: the local part takes the case of the value.
    own = F.when(F.col("kind") == "email", _email(F.col("value"), key, F.col("digest"), F.col("attempt"))).otherwise(F.col("target"))
    others = others.select("kind", "value", own.alias("surrogate"))

    word = F.lower(F.regexp_replace("title", r"\.? $", ""))
    low = lambda names: [n.lower() for n in names]
    told = F.when(word.isin(low(TITLES_F)), "f").when(word.isin(low(TITLES_M)), "m")
    first = F.lower(F.element_at(F.split("name", " "), 1))
    listed = F.lit("n")
    for g in ("m", "f"):
        listed = F.when(first.isin(low([*GIVEN["latin", g], *GIVEN["cyrillic", g], *KNOWN[g]])), g).otherwise(listed)
    people = values.where("kind = 'person'").select("value", "title", "name", "unit", F.lower("name").alias("full"), told.alias("told"), listed.alias("listed"))
    elsewhere = people.groupBy("full").agg(F.min("told").alias("elsewhere"))
    people = stored(people.join(elsewhere, "full").withColumn("gender", F.coalesce("told", "elsewhere", "listed")), "entity-people")
    names = F.split("full", " ")
    fulls = people.select("unit", F.concat_ws(" ", "gender", "full").alias("who"), "gender", F.slice(names, F.lit(1), F.size(names) - 1).alias("given")).where("size(given) > 0").distinct()
    given = settle(fulls, ["unit"], "who", lambda a: _given(F.col("given"), F.col("gender"), key, a), real=False).select("unit", "who", F.col("target").alias("given_target"))
    last = units.where("kind = 'person'").select("unit", F.col("target").alias("last_target"))
    people = people.withColumn("who", F.concat_ws(" ", "gender", "full")).join(last, "unit").join(given, ["unit", "who"], "left")
    made = F.concat_ws(" ", "given_target", "last_target")
    people = people.select(F.lit("person").alias("kind"), "value", F.concat("title", _cased(made, F.col("name"))).alias("surrogate"))
    return others.unionAll(people)


def replace_personal_data(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with personal data replaced, plus n_entities, entity_kinds (sorted, distinct) and entities.

    Found are e-mail addresses, hexadecimal secrets of 32 digits or more, keys
    with an issuer's prefix and signed tokens, IBANs, IP addresses of versions
    4 and 6, card numbers (16 digits, or 13 to 19 with a right check digit),
    US social security numbers, telephone numbers (3-3-4 digits, international
    ones after a plus, national ones from 0), names after a title, and names
    that begin with a listed given name. `entities` lists (kind, surrogate,
    start) in the order of the text, start counted in characters of the new
    text. The same value has the same surrogate everywhere, and different
    values have different ones (see `surrogates`). Who knows the key can tell
    which surrogate a value gets, so it must be secret and has no default.

    A null text stays null, and a text without personal data stays as it is,
    with no entities. Rows that repeat come out alike. An empty table gives no
    rows. Columns of the input named like a result column are replaced.

    The patterns run once over each text, and in linear time; the cut texts
    are written and read again. Rows with entities meet their surrogates by
    their list of entities: equal lists are worked on once, and the join's
    other side has one row a list, so a list or a value in a third of all rows
    is a skewed join that Spark splits.
    """
    if not key:
        raise ValueError("a secret key is needed")
    docs = without(docs, "n_entities", "entity_kinds", "entities", "_parts", "_found", "_f1", "_f2", "_new")
    text = text_of(text_col)
    # The mark holds a hash of the text itself, so that no text has it by chance.
    mark = F.concat(F.lit("\u0001"), F.hex(F.xxhash64(text)), F.lit("\u0001"))
    cut = F.split(F.regexp_replace(text, F.lit(ENTITY), F.concat(mark, F.lit("$0"), mark)), mark, -1)
    rest = [c for c in docs.columns if c != text_col]
    parts = F.when(F.col(text_col).isNull(), F.lit(None)).when(functools.reduce(operator.or_, [text.rlike(p) for p in _MAYBE]), cut).otherwise(F.array(text))
    rows = stored(docs.select(*[F.col(f"`{c}`") for c in rest], parts.alias("_parts")), "cut-texts")
    clean = rows.where("_parts is null or size(_parts) = 1")
    found = F.filter("_parts", lambda _, i: i % 2 == 1)
    hit = rows.where("size(_parts) > 1").withColumn("_found", found)
    f1, f2 = hash128(F.col("_found"))
    hit = hit.withColumns({"_f1": f1, "_f2": f2})

    lists = stored(hit.select("_f1", "_f2", "_found").dropDuplicates(["_f1", "_f2"]), "entity-lists")
    each = lists.select("_f1", "_f2", F.posexplode("_found").alias("at", "value"))
    kinds = stored(each.select("value").distinct().withColumn("kind", kind_of(F.col("value"))), "kinds")
    # Numbers that are no cards after all stand for themselves.
    plain = kinds.where("kind = 'number'").select("value", "kind", F.col("value").alias("surrogate"))
    named = stored(surrogates(kinds.where("kind <> 'number'").select("kind", "value"), key).select("value", "kind", "surrogate").unionAll(plain), "named")
    new = each.join(named, "value").groupBy("_f1", "_f2").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "surrogate"))).alias("_new"))

    between = F.filter("_parts", lambda _, i: i % 2 == 0)
    steps = F.zip_with(between, "_new", lambda b, e: F.struct(b.alias("before"), e.alias("entity")))
    rebuilt = F.array_join(F.transform(steps, lambda s: F.concat(s["before"], F.coalesce(s["entity"]["surrogate"], F.lit("")))), "")
    kind = "array<struct<kind:string,surrogate:string,start:int>>"
    starts = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda a, s: F.struct(
            (a["at"] + F.length(s["before"]) + F.coalesce(F.length(s["entity"]["surrogate"]), F.lit(0))).alias("at"),
            F.when(F.coalesce(s["entity"]["kind"], F.lit("number")) == "number", a["out"])
            .otherwise(F.concat(a["out"], F.array(F.struct(s["entity"]["kind"].alias("kind"), s["entity"]["surrogate"].alias("surrogate"), (a["at"] + F.length(s["before"])).alias("start")))))
            .alias("out"),
        ),
    )["out"]
    out = lambda made, entities: [*[made.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], entities.alias("entities")]
    changed = hit.join(new, ["_f1", "_f2"]).select(*out(rebuilt, starts))
    kept = clean.select(*out(F.col("_parts")[0], F.array().cast(kind)))
    return changed.unionAll(kept).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("entities").cast("long").alias("n_entities"),
        F.sort_array(F.array_distinct(F.col("entities.kind"))).alias("entity_kinds"),
        "entities",
    )
