"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern of alternatives. Each is made of units (an address, a number, a secret, a given name, a surname),
and every distinct unit gets one surrogate wherever it stands: a keyed hash (HMAC) draws characters of the same classes, so length,
separators and case stay; card and bank account numbers stay valid or invalid by their check digits; network addresses stay in their private range;
names are drawn from syllables of their script, with an ending of the title's gender (one of its own where the title tells none). A name that stands after a title or
such words as "my name is" somewhere in a text is replaced in the whole of that text, also where it stands alone. What kind an entity is, a secret above all, follows from the alternative
that matched, not from its characters. Mail addresses are one and the same in upper and lower case; their surrogates take on the case of each place. Surrogates are checked over all distinct units: none may equal another's, nor a unit that stands in the
corpus; what fails is drawn again until nothing fails.

Defined results: null and empty texts and texts without entities stay as they are. Of units that draw the same
surrogate the smallest keeps it. After ``ROUNDS`` draws, which only a format with hardly a free value needs, surrogates may be longer than what they stand for,
and network addresses leave their range. Repeated rows get the same result each. Extra columns are kept, but one with the name of the count is replaced. An
empty table gives an empty table. Texts are used whole, whatever their length.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, discard, staged, unboxed

#: Titles by gender; a name follows them.
MALE = ("Mr", "Mister", "Herr", "Sr", "Señor", "Don", "Monsieur", "Господин", "Κύριος")
NEUTRAL = ("Dr", "Prof", "Professor", "Доктор", "Профессор", "Δρ")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Doña", "Madame", "Mme", "Mlle", "Госпожа", "Κυρία")
#: Words before a name that is no title.
SAID = ("my name is", "My name is", "mein Name ist", "Mein Name ist", "me llamo", "Me llamo", "je m'appelle", "Je m'appelle", "меня зовут", "Меня зовут")
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def one_of(words: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(sorted(words, key=len, reverse=True))})"


#: What stands before a name: words that introduce it, a title, more academic titles. No academic title is a name itself.
BEFORE = rf"(?:{one_of(SAID)} |{one_of(MALE + FEMALE + NEUTRAL)}\.? )(?:{one_of(NEUTRAL)}\.? )*+(?!{one_of(NEUTRAL)}(?!\p{{L}}))"
NAMES = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9][A-Za-z0-9-]*+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"
#: Kinds in the order in which they are tried, each with its pattern. Secrets come first, so that no other kind takes a part of one.
KINDS = (
    ("secret", r"((?<=password=)[^\s\"']{6,64}|(?<=token = \")[0-9A-Za-z_-]{16,128}(?=\")|(?<=api_key=)[^\s\"']{8,128})"),
    ("email", EMAIL),
    ("ip", rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[.-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{13,19})(?![0-9])"),
    ("access", r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    ("person", rf"(?<!\p{{L}}){BEFORE}{NAMES}"),
)
PATTERN = "|".join(pattern for _, pattern in KINDS)
#: The group of the pattern that holds a secret; group 2 is the separator of a card number.
SECRET = 1
#: What stands before secrets, as a quick test of a text with entities.
SHOWS_SECRET = "password=|token = |api_key="
#: What stands in every entity, as a quick test of a text.
GATE = rf"[0-9@]|A[KS]IA|{SHOWS_SECRET}|{one_of(SAID)} |{one_of(MALE + FEMALE + NEUTRAL)}\.? "

#: Syllables by script; a name takes some of them and an ending by gender.
SYLLABLES = {
    "latin": ("ba be da de fa fe ga ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se si ta te va ve".split(), ("lo", "na", "son", "rin")),
    "cyrillic": ("ба бе да де фа фе га ка ке ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си та те ва ве".split(), ("слав", "ла", "енко", "ша")),
    "greek": ("βα βε δα δε φα φε γα κα κε λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι τα τε ζα ζε".split(), ("ος", "ία", "άκης", "ι")),
}
#: Draws after which surrogates may leave the format of what they stand for.
ROUNDS = 40
PERSON = rf"^{BEFORE}{NAMES}$"


def kind_of(match: Column) -> Column:
    """The kind of an entity that is no secret: those differ in their characters."""
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip")
        .when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(match.rlike(r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), "card")
        .when(match.rlike(r"^[+(0-9][0-9 ().-]+$"), "phone")
        .when(match.rlike(r"^A[KS]IA[A-Z0-9]{16}$"), "access")
        .when(match.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), "iban")
        .otherwise("person")
    )


def units_of(match: Column, is_secret: Column) -> Column:
    """The parts of an entity: structs of kind (null: kept as it is) and value, to be joined by blanks."""
    unit = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    # What stands before the name is kept; its first word tells the gender.
    names = F.regexp_replace(match, f"^{BEFORE}", "")
    before = F.substr(match, F.lit(1), F.length(match) - F.length(names) - 1)
    title = F.regexp_replace(F.substring_index(before, " ", 1), r"\.", "")
    gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("n")
    script = F.when(match.rlike(r"\p{IsCyrillic}{2}"), "cyrillic").when(match.rlike(r"\p{IsGreek}{2}"), "greek").otherwise("latin")
    words = F.split(names, " ")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    given, surname = F.concat(F.lit("given-"), gender, F.lit("-"), script), F.concat(F.lit("surname-"), script)
    # A single name is a surname after a title, a given name after "my name is".
    alone = F.when(before.isin(*SAID), given).otherwise(surname)
    kept = unit(F.lit(None).cast("string"), before)
    person = F.when(F.size(words) > 1, F.array(kept, unit(given, first), unit(surname, second))).otherwise(F.array(kept, unit(alone, first)))
    # A whole mail address is the same one behind "password=" as elsewhere.
    kind = F.when(is_secret & ~match.rlike(f"^{EMAIL}$"), "secret").otherwise(kind_of(match))
    return F.when(kind == "person", person).otherwise(F.array(unit(kind, match)))


def keyed(secret: str, *parts: Column) -> Column:
    """HMAC-SHA512 of the parts, as hexadecimal digits."""
    key = secret.encode()
    key = (hashlib.sha512(key).digest() if len(key) > 128 else key).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    said = F.concat_ws("\u001f", *parts).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, said), 512))), 512)


def drawn(stream: Column, i: Column, below: int) -> Column:
    """The i-th number below ``below`` of a stream of hexadecimal digits."""
    return (F.conv(F.substring(stream, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int") % below).cast("int")


def characters(value: Column, stream: Column, letters: int = 26) -> Column:
    """Each digit and letter replaced by one of its class; anything else stays."""

    def other(c: Column, i: Column) -> Column:
        digit = F.substring(F.lit("0123456789"), drawn(stream, i, 10) + 1, F.lit(1))
        lower = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), drawn(stream, i, letters) + 1, F.lit(1))
        return F.when((c >= "0") & (c <= "9"), digit).when((c >= "a") & (c <= "z"), lower).when((c >= "A") & (c <= "Z"), F.upper(lower)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), other), "")


def check_digit(body: Column) -> Column:
    """The last digit that makes the digits of ``body`` a valid card number."""
    digits = F.reverse(F.split(F.regexp_replace(body, "[^0-9]", ""), ""))
    each = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(F.lit(10) - F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10, F.lit(10)).cast("string")


def remainder(account: Column) -> Column:
    """The remainder by 97 of a bank account number (IBAN), with its first four characters moved to the end."""
    moved = F.split(F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97))


def address(value: Column, stream: Column, attempt: Column) -> Column:
    """A network address in the same private range, or a public one for a public one."""
    octet = lambda i, low, high: (drawn(stream, F.lit(i), high - low) + low).cast("string")
    parts = F.split(value, r"\.")
    first, second = parts[0].cast("int"), parts[1].cast("int")
    ends = F.concat_ws(".", octet(2, 0, 256), octet(3, 1, 255))
    return (
        F.when(attempt >= ROUNDS, F.concat_ws(".", octet(0, 1, 224), octet(1, 0, 256), ends))
        .when((first == 192) & (second == 168), F.concat(F.lit("192.168."), ends))
        .when((first == 169) & (second == 254), F.concat(F.lit("169.254."), ends))
        .when((first == 172) & second.between(16, 31), F.concat_ws(".", F.lit("172"), octet(1, 16, 32), ends))
        .when(first.isin(10, 127), F.concat_ws(".", parts[0], octet(1, 0, 256), ends))
        .otherwise(F.concat_ws(".", octet(0, 11, 100), octet(1, 0, 256), ends))
    )


def name(stream: Column, script: Column, ending: Column, count: Column) -> Column:
    """A name of ``count`` syllables and an ending of the script: 0 male, 1 female, 2 surname, 3 either."""

    def of(which: str) -> Column:
        parts, ends = SYLLABLES[which]
        table = F.array(*map(F.lit, parts))
        made = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.get(table, drawn(stream, i, len(parts)))), "")
        return F.initcap(F.concat(made, F.get(F.array(*map(F.lit, ends)), ending)))

    return F.when(script == "cyrillic", of("cyrillic")).when(script == "greek", of("greek")).otherwise(of("latin"))


def in_case_of(made: Column, shown: Column) -> Column:
    """``made`` with upper case where ``shown`` has it, counted from the end."""
    ahead = F.length(shown) - F.length(made)
    at = lambda i: F.substr(shown, i + 1 + ahead, F.lit(1))
    upper = F.transform(F.split(made, ""), lambda c, i: F.when((i + ahead >= 0) & at(i).rlike("[A-Z]"), F.upper(c)).otherwise(c))
    return F.when(shown.rlike("[A-Z]"), F.array_join(upper, "")).otherwise(made)


def surrogate(kind: Column, value: Column, attempt: Column, secret: str) -> Column:
    """The ``attempt``-th surrogate of a unit."""
    stream = keyed(secret, kind, value, attempt.cast("string"))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    host, top = F.regexp_extract(domain, r"^(.*)(\.[^.]*)$", 1), F.regexp_extract(domain, r"^(.*)(\.[^.]*)$", 2)
    email = F.concat(characters(local, stream), F.lit("@"), characters(host, keyed(secret, F.lit("host"), F.lower(domain))), top)
    body = F.concat(F.substring(value, 1, 1), characters(F.substr(value, F.lit(2), F.length(value) - 2), stream))
    valid = check_digit(F.substr(value, F.lit(1), F.length(value) - 1)) == F.right(value, F.lit(1))
    card = F.concat(body, F.when(valid, check_digit(body)).otherwise(drawn(stream, F.lit(31), 10).cast("string")))
    code = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 0)
    phone = F.concat(code, characters(F.substr(value, F.length(code) + 1), stream))
    access = F.concat(F.substring(value, 1, 4), characters(F.substr(value, F.lit(5)), stream))
    land, account = F.substring(value, 1, 2), characters(F.substr(value, F.lit(5)), stream)
    digits = F.lpad((98 - remainder(F.concat(land, F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(land, F.when(remainder(value) == 1, digits).otherwise(characters(F.substring(value, 3, 2), stream)), account)
    hexadecimal = value.rlike("^[0-9a-f]+$")
    plain = F.when(hexadecimal, characters(value, stream, 6)).otherwise(characters(value, stream))
    script = F.substring_index(kind, "-", -1)
    count = (F.lit(2) + attempt / 2).cast("int")
    given = name(stream, script, F.when(kind.startswith("given-f"), 1).when(kind.startswith("given-n"), 3).otherwise(0), count)
    # Where a format has hardly a free value, surrogates grow.
    more = F.when(attempt >= ROUNDS, F.repeat(F.lit("0"), attempt - ROUNDS + 1)).otherwise("")
    grown = lambda made: F.concat(made, characters(more, keyed(secret, F.lit("more"), kind, value, attempt.cast("string"))))
    email = F.when(attempt >= ROUNDS, F.concat(grown(F.lit("x")), email)).otherwise(email)
    return (
        F.when(kind == "email", email).when(kind == "ip", address(value, stream, attempt)).when(kind.startswith("given-"), given).when(kind.startswith("surname-"), name(stream, script, F.lit(2), count))
        .otherwise(grown(F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "access", access).when(kind == "iban", iban).otherwise(plain)))
    )


def surrogate_table(units: DataFrame, secret: str) -> DataFrame:
    """One row for each distinct (kind, value): its surrogate, which is no other unit's and stands nowhere in the corpus."""
    known = staged(units.distinct(), "units")
    settled: list[DataFrame] = []
    pending = known
    for attempt in count():
        tried = staged(pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.lit(attempt), secret)), "tried")
        first = tried.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        taken = known.select("kind", F.col("value").alias("surrogate"))
        free = first.join(taken, ["kind", "surrogate"], "left_anti")
        for done in settled:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        settled.append(staged(free.select("kind", "value", "surrogate"), "settled"))
        left = staged(pending.join(settled[-1].select("kind", "value"), ["kind", "value"], "left_anti"), "pending")
        discard(tried)
        if pending is not known:
            discard(pending)
        pending = left
        if pending.isEmpty():
            discard(known, pending)
            return reduce(DataFrame.unionByName, settled)


def replace(docs: DataFrame, secret: str, text: str = "text", entities: str | None = "n_entities") -> DataFrame:
    """``docs`` with surrogates in place of the personal data of ``text``, and (unless None) how many entities were replaced. ``secret`` is the key of the surrogates.

    The pattern runs over each text once; what it finds is written with the texts.
    """
    added = [entities] if entities else []
    columns, counted = unboxed(docs.columns, text, *added), lambda n: [n.cast("long").alias(e) for e in added]
    may = F.coalesce(F.col("text").rlike(GATE), F.lit(False))
    first = F.when(may, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    seen = staged(boxed(docs, text, *added).withColumn("found", first), "searched")
    clean = seen.filter(F.size("found") == 0).select(*columns, *counted(F.lit(0)))
    # Names that a title has shown are looked for in the whole text.
    shown = F.flatten(F.transform(F.filter("found", lambda m: m.rlike(PERSON)), lambda m: F.filter(units_of(m, F.lit(False)), lambda u: u["kind"].isNotNull())))
    held = seen.filter(F.size("found") > 0).withColumn("names", shown)
    alone = F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join(F.array_distinct(F.transform("names", lambda u: u["value"])), "|"), F.lit(r")(?!\p{L})"))
    held = held.withColumn("pattern", F.when(F.size("names") > 0, alone).otherwise(PATTERN))
    held = held.withColumn("found", F.when(F.size("names") > 0, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("found")))
    # A secret is told from the rest by the alternative that matched.
    groups = F.regexp_extract_all("text", F.col("pattern"), F.lit(SECRET))
    held = held.withColumn("secrets", F.when(F.col("text").rlike(SHOWS_SECRET), groups).otherwise(F.array().cast("array<string>")))
    held = staged(held.withColumn("row", F.monotonically_increasing_id()), "private")
    match, is_secret = F.col("match"), F.coalesce(F.get("secrets", "at") != "", F.lit(False))
    each = held.select("row", "names", "secrets", F.posexplode("found").alias("at", "match"))
    each = each.select("row", "names", "at", "match", is_secret.alias("is_secret"))
    known = F.filter("names", lambda u: (u["value"] == match) & ~F.col("is_secret"))
    units = F.when(F.size(known) > 0, F.slice(known, 1, 1)).otherwise(units_of(match, F.col("is_secret")))
    each = each.select("row", "at", F.posexplode(units).alias("part", "unit"))
    one = F.when(F.col("unit.kind") == "email", F.lower("unit.value")).otherwise(F.col("unit.value"))
    each = staged(each.select("row", "at", "part", "unit.kind", one.alias("value"), F.col("unit.value").alias("shown")), "private-units")
    table = surrogate_table(each.filter("kind is not null").select("kind", "value"), secret)
    say = F.when(F.col("kind") == "email", in_case_of(F.col("surrogate"), F.col("shown"))).otherwise(F.coalesce("surrogate", "value"))
    told = each.join(table, ["kind", "value"], "left").select("row", F.struct("at", "part", say.alias("say")).alias("say"))
    lists = told.groupBy("row").agg(F.array_sort(F.collect_list("say")).alias("say"))
    # The parts of an entity are joined by blanks; entities alternate with what stands between them.
    before = lambda s: F.when(s["part"] > 0, F.lit(" ")).otherwise(F.get("gap", s["at"]))
    said = F.array_join(F.transform("say", lambda s: F.concat(before(s), s["say"])), "")
    gaps = F.when(F.size("names") > 0, F.split("text", F.col("pattern"), -1)).otherwise(F.split("text", PATTERN, -1))
    rebuilt = held.join(lists, "row").withColumn("gap", gaps).withColumn("text", F.concat(said, F.element_at("gap", -1))).select(*columns, *counted(F.size("found")))
    return clean.unionByName(rebuilt)


def op3(docs: DataFrame, secret: str) -> DataFrame:
    """Each document with surrogates, how many entities were replaced, and a digest of the new text."""
    out = replace(docs.select("doc_id", "text"), secret)
    return out.select("doc_id", "text", "n_entities", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
