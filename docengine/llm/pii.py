"""Surrogates for personal data: keyed, type-consistent, distinct, the same wherever an entity occurs. SQL functions only.

One regular expression cuts a text into entities and what lies between. Each distinct entity gets a surrogate
made from an HMAC under the caller's key: e-mail addresses, phone numbers, card numbers (16 digits, Luhn-valid if the original is; other Luhn-valid
numbers of 13 to 19 digits), IPv4 addresses (reserved range 240-255), IPv6 addresses (documentation range 2001:db8), US social security numbers (unused area 9xx), IBANs, secrets (hex or base-62 of
equal length and case) and names. What makes a mention the same entity is its value alone: a secret without its label, a North American number with or without
+1, a name without its form of address. Given and family names are entities of their own, so a full name and the family name alone agree; once a
name is known in a document, its later mentions without a form of address are replaced too. Surrogates keep gender, script, separators, digit
groups and letter case. Surrogates that meet each other or a real entity of the corpus are made again with
the next attempt number, until none does; so distinct entities stay distinct, and no surrogate is a real value.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, checked_broadcast, spread_join

MOST_ATTEMPTS = 50
KEY = "spark.docengine.surrogate.key"

# Patterns of the entity types, in order of precedence.
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,256}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.)+[A-Za-z]{2,24}"
SECRET = r"(?i:token|secret|password|api_?key|access_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_\-]{16,128}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}(?![0-9A-Za-z])"
CARD_BY_LUHN = r"(?<![0-9A-Za-z])(?:[0-9]{4}[ \-]?[0-9]{6}[ \-]?[0-9]{4,5}|[0-9]{13,19})(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])"
_GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[A-Fa-f:]*[0-9])(?:(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}}|(?:{_GROUP}:){{1,7}}:|:(?::{_GROUP}){{1,7}}))(?![0-9A-Za-z:]|\.[0-9])"
INTERNATIONAL = r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])"
BRACKETED = r"(?<![0-9A-Za-z])\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z])"
SEPARATED = r"(?<![0-9A-Za-z.\-])(?:1[ .\-])?(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|[0-9]{3} [0-9]{3}[ \-][0-9]{4})(?![.\-]?[0-9A-Za-z])"
# With a trunk zero, of 9 to 14 digits, and not a date.
TRUNK = r"(?<![0-9A-Za-z.\-+])(?!0[1-9][\-/][01][0-9][\-/][12][0-9]{3})(?=0(?:[ /\-]?[0-9]){8,13}(?![ /\-]?[0-9]))0[1-9][0-9]{0,3}[ /\-][0-9]{2,8}(?:[ \-][0-9]{2,8}){0,4}(?![0-9A-Za-z])"
PHONE = "|".join((INTERNATIONAL, BRACKETED, SEPARATED, TRUNK))
TITLE = "(?:Mrs|Mr|Ms|Miss|Mx|Sir|Madam|Dra|Dr|Professorin|Professor|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora|Señor|Sra|Sr|Господин|Госпожа|Доктор|Профессор)"
NAME = rf"(?<!\p{{L}}){TITLE}\.? (?:{TITLE}\.? ){{0,2}}\p{{Lu}}\p{{L}}{{1,30}}(?: \p{{Lu}}\p{{L}}{{1,30}})?"
# Without a form of address: two capitalised words after words that announce a name.
CUE = r"(?:[Mm]y name is|[Nn]ame:|[Cc]ontact:|[Aa]ttn:|[Aa]uthor:|[Dd]ear|[Ss]igned by|[Rr]egards,|[Ss]incerely,)"
CUED = rf"\p{{Lu}}(?<={CUE}[ \n]\p{{Lu}})\p{{Ll}}{{1,30}} \p{{Lu}}\p{{Ll}}{{1,30}}(?!\p{{L}})"
# Guards before groups of patterns spare most places of a text the patterns themselves.
NUMBERS = rf"(?=[0-9A-Za-f(+:])(?<![0-9A-Za-z])(?:{'|'.join((IBAN, CARD, CARD_BY_LUHN, SSN, IPV6, PHONE))})"
ENTITY = rf"{EMAIL}|(?=[tTsSpPaA]){SECRET}|(?=[0-9]){IPV4}|{NUMBERS}|(?=\p{{Lu}}){NAME}|{CUED}"
LABEL = r"(?i:token|secret|password|api_?key|access_?key)\s{0,3}[=:]\s{0,3}[\"']?"
TITLES = rf"(?:{TITLE}\.? )+"

# Forms of address by gender, and the syllables of names by script.
MALE = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
NEUTRAL = ["Mx", "Dr", "Professor", "Prof", "Доктор", "Профессор"]
LATIN_SYLLABLES = ["ba", "ca", "de", "fe", "go", "ha", "ki", "la", "mo", "ne", "po", "ra", "so", "ta", "vi", "zu"]
LATIN_ENDINGS = {"m": ["n", "r", "s", "l"], "f": ["lia", "na", "ra", "ta"]}
CYRILLIC_SYLLABLES = ["ба", "ва", "го", "де", "жо", "за", "ки", "ла", "мо", "не", "по", "ра", "со", "та", "фи", "шу"]
CYRILLIC_ENDINGS = {"m": ["н", "р", "с", "л"], "f": ["лия", "на", "ра", "та"]}


def session_key(spark: SparkSession) -> str:
    """The key in the session's ``spark.docengine.surrogate.key``; where that is unset, a random one that lasts as long as the application."""
    named = spark.conf.get(KEY, None)
    return named or _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


_own_keys: dict[str, str] = {}


def kind(entity: Column) -> Column:
    """The type of a matched entity."""
    whole = lambda p: entity.rlike(rf"\A(?:{p})\z")
    return (
        F.when(entity.contains("@"), "email").when(whole(SECRET), "secret").when(whole(IPV4), "ipv4").when(whole(SSN), "ssn").when(whole(CARD) | whole(CARD_BY_LUHN), "card").when(whole(IPV6), "ipv6").when(whole(PHONE), "phone").when(whole(IBAN), "iban").otherwise("name")
    )


def canonical(entity: Column, of: Column) -> Column:
    """What makes two mentions the same entity: e-mails and IPv6 addresses without case, numbers without separators and phone numbers without +1, secrets without their label, the rest as written."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    phone = F.when(digits.rlike(r"\A1[0-9]{10}\z"), F.substring(digits, 2, 10)).when(entity.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    return (
        F.when(of.isin("email", "ipv6"), F.lower(entity)).when(of.isin("card", "ssn"), digits).when(of == "phone", phone)
        .when(of == "iban", F.regexp_replace(entity, " ", "")).when(of == "secret", F.regexp_replace(entity, rf"\A{LABEL}", "")).otherwise(entity)
    )


def entities_of(mention: Column) -> Column:
    """The entities that a mention names: array<struct<slot, kind, value, gender>>. A name is its given name (slot 0), if told, and its family name (slot 1)."""
    of = kind(mention)
    bare = F.split(F.regexp_replace(mention, rf"\A{TITLES}", ""), " ")
    form = F.regexp_extract(mention, rf"\A({TITLE})\.? ", 1)
    gender = F.when(form.isin("", *NEUTRAL), "n").when(form.isin(MALE), "m").otherwise("f")
    part = lambda slot, name, value, g: F.struct(F.lit(slot).alias("slot"), F.lit(name).alias("kind"), value.alias("value"), g.alias("gender"))
    family = part(1, "family", F.element_at(bare, -1), F.lit(""))
    other = F.struct(F.lit(0).alias("slot"), of.alias("kind"), canonical(mention, of).alias("value"), F.lit("").alias("gender"))
    return F.when(of != "name", F.array(other)).when(F.size(bare) > 1, F.array(part(0, "given", bare[0], gender), family)).otherwise(F.array(family))


def hmac(key: str, text: Column) -> Column:
    """HMAC-SHA-256 in hex."""
    block = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    inner, outer = (F.lit(bytes(b ^ pad for b in block.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def _digest(key: str, of: Column, value: Column, attempt: Column) -> Column:
    """128 hex digits that only the key's holder can make."""
    text = F.concat_ws("|", of, attempt.cast("string"), value)
    return F.concat(hmac(key, F.concat(F.lit("1|"), text)), hmac(key, F.concat(F.lit("2|"), text)))


def _number(digest: Column, i: Column, below: int) -> Column:
    """The i-th number (from 0) of a digest, below ``below``."""
    return F.pmod(F.conv(F.substring(digest, (i % 30) * 4 + 1, F.lit(4)), 16, 10).cast("int") + i, F.lit(below)).cast("int")


def _pick(digest: Column, i: int, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), _number(digest, F.lit(i), len(names)) + 1)


def _fill(shape: Column, digest: Column, kept: Column) -> Column:
    """``shape`` with every digit, upper-case and lower-case ASCII letter after the first ``kept`` characters replaced by one of its kind."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def sign(c: Column, i: Column) -> Column:
        return (
            F.when(i < kept, c)
            .when(c.rlike("[0-9]"), _number(digest, i, 10).cast("string"))
            .when(c.rlike("[a-z]"), F.substring(F.lit(letters), _number(digest, i, 26) + 1, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substring(F.lit(letters.upper()), _number(digest, i, 26) + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(shape, ""), sign), "")


def _hex_fill(shape: Column, digest: Column, kept: Column) -> Column:
    """As ``_fill``, for hexadecimal secrets: digits and letters from the digest's own."""
    def sign(c: Column, i: Column) -> Column:
        d = F.substring(digest, i % 128 + 1, F.lit(1))
        return F.when(i < kept, c).when(c.rlike("[A-F]"), F.upper(d)).when(c.rlike("[0-9a-f]"), d).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), sign), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum (mod 10) of a string of digits."""
    n = F.char_length(digits)

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), part), F.lit(0), lambda a, x: a + x) % 10


def _name(d: Column, attempt: Column, value: Column, syllables: int, ending) -> Column:
    """A name of the value's script: ``syllables`` and one more after every four attempts, so that names don't run out."""

    def made(parts: list[str], ends: dict[str, list[str]]) -> Column:
        stem = F.transform(F.sequence(F.lit(1), syllables + F.floor(attempt / 4).cast("int")), lambda i: F.element_at(F.array(*[F.lit(p) for p in parts]), _number(d, i, len(parts)) + 1))
        return F.initcap(F.concat(F.array_join(stem, ""), ending(ends)))

    return F.when(value.rlike(r"\p{IsCyrillic}"), made(CYRILLIC_SYLLABLES, CYRILLIC_ENDINGS)).otherwise(made(LATIN_SYLLABLES, LATIN_ENDINGS))


def surrogate(of: Column, value: Column, gender: Column, attempt: Column, d: Column) -> Column:
    """The surrogate of a canonical entity at an attempt, in canonical form; ``d`` is its digest."""
    email = F.concat(F.substring(d, 1, 2), F.lit("."), F.substring(d, 40, 12), F.lit("@mail.example.org"))
    ipv4 = F.concat_ws(".", _number(d, F.lit(0), 15) + 240, *[_number(d, F.lit(i), 256) for i in (1, 2, 3)])
    ipv6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.substring(d, 4 * i + 1, 4) for i in range(6)])
    body = F.substring(_fill(value, d, F.lit(0)), F.lit(1), F.char_length(value) - 1)
    check = (10 - luhn(F.concat(body, F.lit("0")))) % 10
    check = F.when(luhn(value) == 0, check).otherwise((check + 1 + _number(d, F.lit(29), 9)) % 10)
    card = F.concat(body, check.cast("string"))
    country = F.char_length(F.regexp_extract(value, r"^(?:\+[0-9]{2}|0)?", 0))
    hexadecimal = value.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z")
    male = F.when(gender == "n", _number(d, F.lit(0), 2) == 0).otherwise(gender == "m")
    given = lambda ends: F.when(male, _pick(d, 5, ends["m"])).otherwise(_pick(d, 5, ends["f"]))
    return (
        F.when(of == "email", email).when(of == "ipv4", ipv4).when(of == "ipv6", ipv6).when(of == "card", card)
        .when(of == "ssn", F.concat(F.lit("9"), F.substring(_fill(value, d, F.lit(0)), 2, 8)))
        .when(of == "phone", _fill(value, d, country)).when(of == "iban", _fill(value, d, F.lit(2)))
        .when(of == "secret", F.when(hexadecimal, _hex_fill(value, d, F.lit(0))).otherwise(_fill(value, d, F.lit(0))))
        .when(of == "given", _name(d, attempt, value, 3, given)).otherwise(_name(d, attempt, value, 4, lambda _: F.lit("")))
    )


def dressed(mention: Column, plain: Column, given: Column) -> Column:
    """The surrogate ``plain`` in the format of a mention: separators, grouping and a leading 1 of numbers, letter case of e-mails, labels of secrets, form of address of names (with the ``given`` name's surrogate)."""
    of = kind(mention)
    signs = F.regexp_replace(plain, "[^0-9A-Za-z]", "")
    lead = F.char_length(F.regexp_replace(mention, "[^0-9A-Za-z]", "")) - F.char_length(signs)

    def sign(acc: Column, c: Column) -> Column:
        is_sign = c.rlike("[0-9A-Za-z]")
        next_sign = F.when(acc["i"] < acc["lead"], c).otherwise(F.substring(acc["take"], acc["i"] - acc["lead"] + 1, F.lit(1)))
        return F.struct((acc["i"] + F.when(is_sign, 1).otherwise(0)).alias("i"), F.concat(acc["t"], F.when(is_sign, next_sign).otherwise(c)).alias("t"), acc["take"].alias("take"), acc["lead"].alias("lead"))

    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("t"), signs.alias("take"), lead.alias("lead"))
    grouped = F.aggregate(F.split(mention, ""), start, sign)["t"]
    upper = (mention == F.upper(mention)) & (mention != F.lower(mention))
    name = F.concat(F.regexp_extract(mention, rf"\A(?:{TITLES})?", 0), F.coalesce(F.concat(given, F.lit(" ")), F.lit("")), plain)
    return (
        F.when(of.isin("card", "phone", "ssn", "iban"), grouped).when((of == "email") & upper, F.upper(plain))
        .when(of == "secret", F.concat(F.regexp_extract(mention, rf"\A{LABEL}", 0), plain)).when(of == "name", name).otherwise(plain)
    )


def surrogates(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """``entities`` (kind, value, gender), distinct by kind and value, with ``plain``: distinct surrogates of a kind, none of them an entity's value.

    Of entities whose surrogates meet, that of the smallest value keeps it; the others try again. The number of rounds
    follows from the spaces' load, not from the rows; names grow longer, and where a kind of number has more entities than surrogates the run fails after ``MOST_ATTEMPTS``.
    """
    todo, done = entities.select("kind", "value", "gender"), None
    for attempt in range(MOST_ATTEMPTS):
        drawn = scratch.table(todo.withColumn("d", _digest(key, F.col("kind"), F.col("value"), F.lit(attempt))), f"drawn{attempt}")
        made = scratch.table(drawn.select("kind", "value", "gender", surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.lit(attempt), F.col("d")).alias("plain")), f"made{attempt}")
        scratch.drop(f"drawn{attempt}")
        taken = entities.select(F.col("kind").alias("k"), F.col("value").alias("p"))
        if done is not None:
            taken = taken.union(done.select("kind", "plain"))
        winners = made.groupBy("kind", "plain").agg(F.min("value").alias("value"))
        free = winners.join(taken, (F.col("kind") == F.col("k")) & (F.col("plain") == F.col("p")), "left_anti").select("kind", "value", "plain")
        free = scratch.table(free, f"free{attempt}")
        done = free if done is None else done.union(free)
        todo = made.join(free.select(F.col("kind").alias("k"), F.col("value").alias("v")), (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")), "left_anti").select("kind", "value", "gender")
        if todo.isEmpty():
            return done
    raise ValueError("no free surrogates are left for some entities")


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in column ``text`` replaced under the secret ``key``; all columns stay, ``n_entities`` (mentions replaced) is added.

    Null and empty texts, and texts without entities, stay as they are (0 entities); texts may be of any length, and are searched once; repeated rows get the same
    text; an empty table gives an empty one. An own column ``n_entities`` of ``docs`` is overwritten; other columns may have any name.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    scratch = Scratch(docs.sparkSession, "pii")
    body = F.col(f"`{text}`")
    own = [c for c in docs.columns if c != "n_entities"]
    found = F.regexp_extract_all(body, F.lit(ENTITY), 0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.monotonically_increasing_id().alias("row_id"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    rows = scratch.table(rows, "rows")
    hit, same = rows.where(F.size("found") > 0), rows.where(F.size("found") == 0)

    parts = hit.select("row_id", F.explode(F.array_distinct("found")).alias("mention")).withColumn("e", F.explode(entities_of(F.col("mention"))))
    # Numbers that aren't cards by their length alone have to be by their check digit; others stay.
    unsure = (F.col("kind") == "card") & ~F.col("mention").rlike(rf"\A(?:{CARD})\z")
    parts = parts.select("row_id", "mention", "e.*").where(~F.when(unsure, luhn(F.col("value")) != 0).otherwise(F.lit(False)))
    parts = scratch.table(parts.withColumn("entity", F.concat_ws("|", "kind", "value")), "parts")
    # A given name has one surrogate: of the gender that a form of address tells anywhere, the first if several do.
    gender = F.coalesce(F.min(F.when(F.col("gender") != "n", F.col("gender"))), F.lit("n"))
    entities = scratch.table(parts.groupBy("kind", "value").agg(gender.alias("gender")), "entities")
    plain = surrogates(entities, scratch, key).select(F.concat_ws("|", "kind", "value").alias("entity"), "plain")
    known = scratch.table(spread_join(parts.select("row_id", "mention", "slot", "kind", "value", "entity"), scratch.table(plain, "plain"), "entity", 256), "known")

    named = F.col("kind").isin("given", "family")
    whole = known.groupBy("row_id", "mention").agg(F.max(F.when(~named | (F.col("slot") == 1), F.col("plain"))).alias("plain"), F.max(F.when(named & (F.col("slot") == 0), F.col("plain"))).alias("given"))
    whole = whole.select("row_id", "mention", dressed(F.col("mention"), F.col("plain"), F.col("given")).alias("new"))
    later = known.where(named & (F.char_length("value") > 2)).groupBy("row_id", F.col("value").alias("mention")).agg(F.max(F.struct("slot", "plain"))["plain"].alias("new"))
    new = scratch.table(whole.unionByName(later), "new")
    names = later.groupBy(F.col("row_id").alias("id")).agg(F.sort_array(F.collect_set("mention")).alias("names"))

    inner = F.col(f"row.`{text}`")
    pattern = F.when(F.col("names").isNull(), F.lit(ENTITY)).otherwise(F.concat(F.lit(ENTITY + r"|(?<!\p{L})(?:"), F.array_join("names", "|"), F.lit(r")(?!\p{L})")))
    cut = hit.join(names, F.col("row_id") == F.col("id"), "left").withColumn("pattern", pattern)
    cut = cut.select("row", "row_id", F.when(F.col("names").isNull(), F.col("found")).otherwise(F.regexp_extract_all(inner, F.col("pattern"), F.lit(0))).alias("found"), F.split(inner, F.col("pattern"), -1).alias("between"))
    cut = scratch.table(cut, "cut")
    places = cut.select("row_id", F.posexplode("found").alias("place", "mention")).join(new, ["row_id", "mention"], "left")
    lists = places.groupBy(F.col("row_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", "mention", "new"))).alias("places"))
    told = F.transform("places", lambda x: F.coalesce(x["new"], x["mention"]))
    filled = F.array_join(F.zip_with("between", told, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    joined = cut.join(lists, F.col("row_id") == F.col("id"))
    changed = joined.select(*[filled.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in own], F.size(F.filter("places", lambda x: x["new"].isNotNull())).alias("n_entities"))
    return same.select(*[F.col(f"row.`{c}`").alias(c) for c in own], F.lit(0).alias("n_entities")).unionByName(changed)
