"""PII: every detected entity gets a keyed surrogate of its own type, gender, script and format.

All of it is DataFrame expressions. A surrogate is a function of the key, the entity's canonical form
and an attempt number, so mentions of one entity agree over all documents. Attempts are settled on the
distinct entities alone: a surrogate that another entity has, or that is an entity of the corpus
itself, is refused and drawn again. Attempts over 0 are few, and only they are joined to mentions.

A name is found by a title before it, and its words are entities of their own: given names by script and
gender, surnames by script. So "Ms. Smith" has the surname of "Anna Smith" everywhere, and distinct names
stay distinct. In a document with such a name, all its other forms are found too: untitled, in part, in
capitals or after another title. A given name's gender is that of its first title that tells one, in its
document, else anywhere.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.scratch import discard, table, written

#: The conf that holds the key of the surrogates. Without it each application draws its own, and runs do not agree.
KEY_CONF = "spark.jobloom.pii.key"
MOST_ATTEMPTS = 64
#: From this attempt on, numbers and addresses that have a reserved range are drawn from all of their format.
WIDER_ATTEMPT = 16

#: Titles that tell a gender, by script.
TITLES = {
    ("latin", "f"): r"Mrs\.|Ms\.|Miss|Mme|Mlle|Frau|Señora|Sra\.|Signora|Dña\.|MRS\.|MS\.|MISS|MME|MLLE|FRAU|SRA\.",
    ("latin", "m"): r"Mr\.|Herrn?|Señor|Sr\.|Signor|Monsieur|MR\.|HERRN?|SR\.|MONSIEUR",
    ("cyrillic", "f"): r"Госпожа|Г-жа",
    ("cyrillic", "m"): r"Господин|Г-н",
    ("greek", "f"): r"Κυρία|Κα\.",
    ("greek", "m"): r"Κύριος|Κος",
}
#: Titles that tell none; they may also stand after one that does.
NEUTRAL_TITLES = {"latin": r"Dr\.|Prof\.|DR\.|PROF\.", "cyrillic": r"Д-р|Доктор|Проф\.", "greek": r"Δρ\.|Καθ\."}
GIVEN_NAMES = {
    ("latin", "f"): "Ada Clara Elena Greta Ines Julia Laura Marta Nora Olivia Paula Rosa Sofia Teresa Vera Yvonne",
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Leon Marco Oscar Paul Simon Victor",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лариса Мария Нина Ольга Полина Раиса Софья Тамара Ульяна Юлия",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Фёдор",
    ("greek", "f"): "Άννα Δάφνη Ειρήνη Ελένη Ζωή Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Όλγα Ρέα Σοφία Τίνα Φανή Χλόη",
    ("greek", "m"): "Άρης Βασίλης Γιώργος Δημήτρης Ηλίας Θάνος Ιάσων Κώστας Λάμπρος Μάριος Νίκος Πέτρος Σπύρος Τάσος Φώτης Χρήστος",
}
#: Where no gender is known.
NEUTRAL_NAMES = {
    "latin": "Alex Andrea Charlie Chris Dominique Jo Kai Kim Lou Nicola Noa Pat Robin Sam Sasha Toni",
    "cyrillic": "Валя Вася Женя Лёня Паша Саша Слава Шура",
    "greek": "Αλέξ Άγγελ Βάσια Μαρίν Νικόλ Παν Σταύρ Φοίβη",
}
#: Ends of given names that are put together from syllables.
GIVEN_ENDS = {
    ("latin", "f"): "na", ("latin", "m"): "n", ("latin", "n"): "i", ("cyrillic", "f"): "на", ("cyrillic", "m"): "н", ("cyrillic", "n"): "й",
    ("greek", "f"): "να", ("greek", "m"): "νος", ("greek", "n"): "ν",
}
SURNAME_SYLLABLES = {
    "latin": "ba be bo da de do fa fe go ha ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te to",
    "cyrillic": "ба бе бо ва ве во га го да де до жа за зе ка ко ла ле ло ма ме мо на не но па пе ра ре ро са со",
    "greek": "βα βε βο γα γε γο δα δε δο ζα θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε το",
}

_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{L}+(?:['’-]\p{Lu}\p{L}+)*"
#: Characters of an address before its @: letters may have accents.
_LOCAL = r"[\p{IsLatin}\p{M}0-9._%+-]"
_NEUTRAL = "|".join(NEUTRAL_TITLES.values())
#: Initials stay as they are.
_NAME = rf"(?:(?:{_NEUTRAL}) )*(?:\p{{Lu}}\. ){{0,3}}{_WORD}(?: {_WORD})*+"
_V4 = r"(?=[0-9])(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_HEXES = f"{_HEX}(?::{_HEX}){{0,5}}"
_V6 = rf"(?=[0-9A-Fa-f]{{0,4}}:)(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEXES})?::(?:{_HEXES})?)(?![0-9A-Za-z:]|\.[0-9])"
#: What each type looks like; where two begin at one place, the earlier wins. Every group is non-capturing. Words of
#: any script end before a secret's or phone's start and a name's title; the others may follow letters of other scripts.
PATTERNS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@(?:(?:[A-Za-z0-9-]++\.(?=[A-Za-z0-9]))++[A-Za-z]{{2,24}}|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){{0,8}}\.[A-Za-z]{{2,24}})",
    "access_key": r"(?=[Ag])(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+)(?![A-Za-z0-9])",
    "secret": r"(?=[PpSsTtAa])(?<![\p{L}0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key)(?-i:) {0,2}[=:] {0,2}\"?[A-Za-z0-9+/_.-]{6,}+\"?",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": f"(?:{_V4}|{_V6})",
    "card": r"(?=[0-9])(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9-])",
    "ssn": r"(?=[0-9])(?<![0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![0-9] )[0-9]{3} [0-9]{2} [0-9]{4}(?! ?[0-9]))",
    # with a + eight to fifteen digits, however they are grouped; without, two separators, a code in brackets, or a word for phones before
    "phone": r"(?=[+(0-9])(?<![\p{L}0-9+])(?:\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])|\([0-9]{2,5}\) ?[0-9]{5,9}(?![0-9])"
    r"|(?<=(?<!\p{L})(?i:tel|phone|mobile|fax)[.:]{0,2} {0,2})[0-9]{7,15}(?![0-9])|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9]))",
} | {f"name_{script}_{gender}": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{titles}) {_NAME}" for (script, gender), titles in TITLES.items()}
_NEUTRAL_PATTERNS = {f"name_{script}_n": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{titles}) {_NAME}" for script, titles in NEUTRAL_TITLES.items()}
_ALL = PATTERNS | _NEUTRAL_PATTERNS
#: After an ASCII letter only numbers begin, and after a digit only names. This stands before all patterns, so most places fail at one look.
_START = r"(?:(?<![A-Za-z0-9])|(?<![0-9])(?=[0-9])|(?<=[0-9])(?=\p{Lu}))"
ANY = _START + "(?:" + "|".join(f"(?:{p})" for p in _ALL.values()) + ")"
#: Entities but names, and titled names.
_VALUES = {k: p for k, p in _ALL.items() if not k.startswith("name_")}
_TITLED = {k: p for k, p in _ALL.items() if k.startswith("name_")}
VALUES, TITLED = (_START + "(?:" + "|".join(f"(?:{p})" for p in some.values()) + ")" for some in (_VALUES, _TITLED))
_ALL_TITLES = "|".join([*TITLES.values(), _NEUTRAL])
#: A text with an entity matches this as well; it is much cheaper. Access keys and names may lack all of the first class.
GATE = r"[0-9@=:]|(?=\p{Lu})(?:A[KS]IA|(?<!\p{L})(?:" + _ALL_TITLES + "))"


def entity_type(mention: Column, patterns: dict[str, str] = _ALL) -> Column:
    """The first type whose pattern the mention is; a mention is a match of one of them, so it has one."""
    # digits that only the word before them tells are a phone's
    found = F.when(F.regexp_like(mention, F.lit("^[0-9]+$")), "phone")
    for kind, pattern in reversed(patterns.items()):
        # at the mention's edges look-around finds nothing to object to
        found = F.when(F.regexp_like(mention, F.lit(f"^(?:{pattern})$")), F.lit(kind)).otherwise(found)
    return found


def value_part(kind: Column, mention: Column) -> Column:
    """The part of a mention that is replaced: of a secret what follows its name, of a name its words after title and initials."""
    secret = F.regexp_extract(mention, r"[=:] {0,2}\"?([A-Za-z0-9+/_.-]+)\"?$", 1)
    name = F.regexp_extract(mention, rf"^(?:(?:{_ALL_TITLES}) )+(?:\p{{Lu}}\. )*(.*)$", 1)
    return F.when(kind == "secret", secret).when(kind.startswith("name_"), name).otherwise(mention)


def canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity share: digits of numbers, lower case of addresses, all groups of an IPv6 address.

    A phone number has its country's digits but for +1, without which the same numbers are written as well.
    """
    digits = F.regexp_replace(value, "[^0-9]", "")
    home = value.startswith("+1") & (F.length(digits) == 11)
    groups = lambda side: F.filter(F.split(side, ":"), lambda x: x != "")
    left, right = groups(F.substring_index(value, "::", 1)), groups(F.substring_index(value, "::", -1))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    whole = F.when(value.contains("::"), F.concat(left, zeros, right)).otherwise(F.split(value, ":"))
    v6 = F.array_join(F.transform(whole, lambda x: F.regexp_replace(F.lower(x), "^0+(?=.)", "")), ":")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "phone", F.when(home, F.substring(digits, 2, 10)).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when((kind == "ip") & value.contains(":"), v6)
        .otherwise(value)
    )


def _mod97(s: Column) -> Column:
    """The number that capital letters (A is 10) and digits write, modulo 97."""

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def is_valid(kind: Column, canon: Column) -> Column:
    """Whether the check digits of an IBAN hold; other types have none that all mentions keep."""
    turned = F.concat(F.substr(canon, F.lit(5)), F.substring(canon, 1, 4))
    return F.when(kind == "iban", _mod97(turned) == 1).otherwise(True)


def _digest(key: str, *parts: Column) -> Column:
    inner = F.sha2(F.concat_ws("\x00", F.lit(key), *parts), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def _digits(h: Column) -> Column:
    """48 decimal digits of a hexadecimal digest."""
    part = lambda k: F.right(F.lpad(F.conv(F.substring(h, k, 14), 16, 10), 17, "0"), F.lit(12))
    return F.concat(part(1), part(15), part(29), part(43))


def _byte(h: Column, k: Column | int) -> Column:
    """The k-th byte (from 0) of a digest, round and round."""
    at = F.pmod(F.lit(k) if isinstance(k, int) else k, F.lit(32)) * 2 + 1
    return F.conv(F.substr(h, at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _of(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), (F.pmod(n, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


def _same_classes(value: Column, h: Column, keep: Column) -> Column:
    """value with every ASCII letter and digit after the first `keep` drawn anew from its own class; other letters stay."""

    def drawn(c: Column, i: Column) -> Column:
        b = _byte(h, i)
        letter = F.when(c.rlike("[0-9]"), _of("0123456789", b)).when(c.rlike("[a-z]"), _of("abcdefghijklmnopqrstuvwxyz", b))
        return F.when(i < keep, c).otherwise(letter.when(c.rlike("[A-Z]"), _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)).otherwise(c))

    return F.array_join(F.transform(F.split(value, ""), drawn), "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn weights of a string of digits; its last digit counts once."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weight), F.lit(0), lambda a, x: a + x)


def with_surrogate(rows: DataFrame, key: str, drawn: Callable[..., Column] | None = None) -> DataFrame:
    """rows (kind, canon, attempt, ...) with new, the surrogate of that attempt."""
    # a column of its own: the expressions below read it many times
    hashed = rows.withColumn("h", _digest(key, F.col("kind"), F.col("canon"), F.col("attempt").cast("string")))
    return hashed.withColumn("new", (drawn or _surrogate)(*map(F.col, ("kind", "canon", "attempt", "h")))).drop("h")


def _surrogate(kind: Column, value: Column, attempt: Column, h: Column) -> Column:
    """The surrogate of a canonical value or word of a name, in canonical form, by its digest."""
    return F.when(kind.rlike("^(?:given|surname)_"), _name_surrogate(kind, value, attempt, h)).otherwise(_value_surrogate(kind, value, attempt, h))


def _value_surrogate(kind: Column, value: Column, attempt: Column, h: Column) -> Column:
    """That of an entity but a name; later attempts of emails are longer."""
    local = F.when(kind == "email", F.substring_index(value, "@", 1)).when(kind == "iban", F.substr(value, F.lit(5))).otherwise(value)
    same = _same_classes(local, h, F.when(kind == "access_key", 4).otherwise(0))
    # evaluated once for all the branches that use it
    return F.transform(F.array(same), lambda x: _shaped_surrogate(kind, value, attempt, h, x))[0]


def _shaped_surrogate(kind: Column, value: Column, attempt: Column, h: Column, same: Column) -> Column:
    n = F.length(value)
    drawn = _digits(h)
    card = F.concat(F.substring(value, 1, 1), F.substr(drawn, F.lit(2), n - 1))
    unchecked = F.concat(F.substr(card, F.lit(1), n - 1), F.lit("0"))
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(unchecked), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn_sum(value), F.lit(10)) == 0, F.concat(F.substr(card, F.lit(1), n - 1), check)).otherwise(card)
    country = F.greatest(F.lit(0), n - 10)  # digits before the last ten stay: the country's
    phone = F.concat(F.substr(value, F.lit(1), country), (F.substring(drawn, 1, 1).cast("int") % 8 + 2).cast("string"), F.substr(drawn, F.lit(2), n - country - 1))
    # exchange 555 as long as it has numbers left
    phone = F.when((n == 10) & (attempt < 4), F.concat(F.substring(phone, 1, 3), F.lit("555"), F.substring(phone, 7, 4))).otherwise(phone)
    # reserved ranges: 240.0.0.0/4, 2001:db8::/32, and social security numbers of area 9xx; where many attempts met taken ones, all of the format
    more = attempt >= WIDER_ATTEMPT
    octets = [F.when(more, _byte(h, 4)).otherwise(F.lit(240) + F.pmod(_byte(h, 0), F.lit(15))).cast("string"), *(_byte(h, k).cast("string") for k in (1, 2, 3))]
    hextets = [F.regexp_replace(F.substring(h, 9 + 4 * k, 4), "^0+(?=.)", "") for k in range(6)]
    ip = F.when(value.contains(":"), F.concat_ws(":", F.lit("2001"), F.lit("db8"), *hextets)).otherwise(F.concat_ws(".", *octets))
    ssn = F.when(more, F.substr(drawn, F.lit(1), n)).otherwise(F.concat(F.lit("9"), F.substr(drawn, F.lit(1), n - 1)))
    country2 = F.substring(value, 1, 2)
    iban = F.concat(country2, F.lpad((98 - _mod97(F.concat(same, country2, F.lit("00")))).cast("string"), 2, "0"), same)
    blocks = F.transform(F.sequence(F.lit(0), (n / 64).cast("int")), lambda k: F.sha2(F.concat(h, k.cast("string")), 256))
    hexes = F.substr(F.array_join(blocks, ""), F.lit(1), n)
    wider = F.when(attempt >= 4, F.concat(F.lit("."), F.right(drawn, F.lit(6)))).otherwise("")
    host = F.concat(F.lit("mail"), F.substring(drawn, 20, 4), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), F.pmod(_byte(h, 31), F.lit(3)) + 1))
    return (
        F.when(kind == "email", F.concat(same, wider, F.lit("@"), host))
        .when((kind == "secret") & value.rlike("^[0-9a-f]+$"), hexes)
        .when(kind == "iban", iban)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "ssn", ssn)
        .when(kind == "phone", phone)
        .otherwise(same)
    )


def _name_surrogate(kind: Column, value: Column, attempt: Column, h: Column) -> Column:
    """That of a given name or surname, of its script and gender; later attempts have more syllables."""

    def of(choices: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for ending, said in choices.items():
            out = F.when(kind.endswith(ending), F.lit(said)).otherwise(out)
        return out

    scripts = list(SURNAME_SYLLABLES)
    syllables = F.split(of({x: SURNAME_SYLLABLES[x] for x in scripts} | {f"{x}_{g}": SURNAME_SYLLABLES[x] for x in scripts for g in "fmn"}), " ")
    names = F.split(of({f"{x}_{g}": GIVEN_NAMES.get((x, g)) or NEUTRAL_NAMES[x] for x in scripts for g in "fmn"}), " ")
    given = kind.startswith("given_")
    n = F.when(given, 2).otherwise(3) + F.least(attempt, F.lit(3))
    made = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.get(syllables, F.pmod(_byte(h, k), F.lit(32)))), "")
    made = F.initcap(F.concat(made, F.coalesce(of({f"{x}_{g}": GIVEN_ENDS[x, g] for x in scripts for g in "fmn"}), F.lit(""))))
    return F.when(given & (attempt == 0), F.get(names, F.pmod(_byte(h, 0), F.size(names)))).otherwise(made)


def in_format(kind: Column, mention: Column, value: Column, new: Column) -> Column:
    """The mention with its value replaced by a canonical surrogate, in the mention's own format."""

    lacking = F.length(F.regexp_replace(value, "[^0-9]", "")) - F.length(new)

    def digit(c: Column, i: Column) -> Column:
        # digits that the canonical form lacks stay
        before = F.length(F.regexp_replace(F.substr(value, F.lit(1), i), "[^0-9]", "")) - lacking
        return F.when(c.rlike("[0-9]") & (before >= 0), F.substr(new, (before + 1).cast("int"), F.lit(1))).otherwise(c)

    numbers = F.array_join(F.transform(F.split(value, ""), digit), "")
    groups = F.trim(F.regexp_replace(new, "(.{4})", "$1 "))
    shaped = (
        F.when(kind.isin("card", "ssn", "phone"), numbers)
        .when((kind == "iban") & value.contains(" "), groups)
        .when((kind == "email") | ((kind == "ip") & value.contains(":")), F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(new)).otherwise(new))
        .otherwise(new)
    )
    return F.concat(F.substr(mention, F.lit(1), F.instr(mention, value) - 1), shaped, F.substr(mention, F.instr(mention, value) + F.length(value), F.length(mention)))


def settle(entities: DataFrame, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """kind, canon, attempt, new of every distinct entity: surrogates are distinct and none is an entity.

    Of entities with one surrogate the smallest keeps it. Each round writes what it settles and what it
    leaves; a round leaves only what collided. Returns the tables that hold the rows as well.
    """
    known = entities.select("kind", F.col("canon").alias("new"))
    settled: list[DataFrame] = []
    tables: list[DataFrame] = []
    left = entities
    for attempt in range(MOST_ATTEMPTS):
        drawn = with_surrogate(left.select("kind", "canon", F.lit(attempt).alias("attempt")), key)
        taken = known
        for earlier in settled:
            taken = taken.unionByName(earlier.select("kind", "new"))
        # first draws of given names are few: the smallest of each is found before anything is shuffled
        drawn = written(drawn, f"drawn-{attempt}")
        firsts = drawn.groupBy("kind", "new").agg(F.min("canon").alias("first")).join(taken, ["kind", "new"], "left_anti")
        marked = drawn.join(firsts, ["kind", "new"], "left").withColumn("kept", F.coalesce(F.col("canon") == F.col("first"), F.lit(False)))
        round_ = written(marked.drop("first"), f"surrogates-{attempt}")
        discard(drawn)
        tables.append(round_)
        settled.append(round_.where("kept").select("kind", "canon", "attempt", "new"))
        left = round_.where("not kept").select("kind", "canon")
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"{MOST_ATTEMPTS} attempts leave entities without a surrogate of their own")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out, tables


def known_names(found: DataFrame) -> DataFrame:
    """row, word (lower case), form (as it is written), kind of every word of every titled name of found (row, titled).

    Of several words the last is a surname, the others are given names; one alone is a surname, unless its document
    has it as a given name. What a word is, its first place in the document says.
    """
    said = found.select("row", F.posexplode("titled").alias("at", "mention")).withColumn("kind", entity_type(F.col("mention"), _TITLED))
    said = said.withColumn("words", F.split(value_part(F.col("kind"), F.col("mention")), " "))
    tag = F.split("kind", "_")
    said = said.select("row", "at", tag[1].alias("script"), tag[2].alias("gender"), F.size("words").alias("n"), F.posexplode("words").alias("k", "form"))
    said = said.select("row", "script", F.lower("form").alias("word"), "form", "gender", "at", (F.col("n") == 1).alias("alone"), (F.col("k") < F.col("n") - 1).alias("given"))
    told = F.when(F.col("gender") != "n", F.struct("at", "gender"))
    words = said.groupBy("row", "script", "word").agg(
        F.min(F.struct("alone", "at", "given"))["given"].alias("given"), F.min(told)["gender"].alias("gender"), F.collect_set("form").alias("forms")
    )
    anywhere = words.where("given AND gender IS NOT NULL").groupBy("script", "word").agg(F.min("gender").alias("elsewhere"))
    words = words.join(anywhere, ["script", "word"], "left")
    given = F.concat_ws("_", F.lit("given"), "script", F.coalesce("gender", "elsewhere", F.lit("n")))
    return words.select("row", "word", "forms", F.when(F.col("given"), given).otherwise(F.concat_ws("_", F.lit("surname"), "script")).alias("kind"))


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """docs with every entity in `text` replaced, and n_entities (long), its number of mentions, in place of any column so named.

    Documents without entities pass by without a shuffle. The others are written once with a row
    number, and their replacements come back to them by it.

    Defined cases: a null text stays null and has 0 entities, as has an empty one; texts of any length are
    read whole; all other columns are kept as they are, whatever their names; rows of one doc_id are
    rewritten each; an IBAN whose check digits do not hold is no entity; an empty table gives an empty result.
    """
    columns = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != "n_entities"]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc.text")
    some = F.coalesce(F.regexp_like(text, F.lit(GATE)) & F.regexp_like(text, F.lit(ANY)), F.lit(False))
    all_of = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = whole.where(some).select(F.monotonically_increasing_id().alias("row"), "doc", all_of(VALUES).alias("mentions"), all_of(TITLED).alias("titled"))
    found = written(found, "pii-documents")
    said = found.select("row", F.posexplode("mentions").alias("at", "mention")).withColumn("kind", entity_type(F.col("mention"), _VALUES))
    said = said.withColumn("value", value_part(F.col("kind"), F.col("mention")))
    said = said.withColumn("canon", canonical(F.col("kind"), F.col("value"))).withColumn("valid", is_valid(F.col("kind"), F.col("canon")))
    names = written(known_names(found), "pii-names")
    entities = said.where("valid").select("kind", "canon").unionByName(names.select("kind", F.col("word").alias("canon")))
    entities = written(entities.distinct(), "pii-entities")
    settled, tables = settle(entities, key)
    # in nearly all mentions the first attempt stands, and needs no join
    later = settled.where("attempt > 0").select("kind", "canon", "attempt")
    drawn = lambda rows, by: with_surrogate(rows.join(later, ["kind", "canon"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0))), key, by)
    new = in_format(*map(F.col, ("kind", "mention", "value", "new")))
    said = drawn(said, _value_surrogate).withColumn("new", F.when(F.col("valid"), new).otherwise(F.col("mention")))
    by_row = said.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("new"), F.count_if("valid").alias("n"))
    by_row = written(by_row.select("row", F.col("new.new").alias("new"), "n"), "pii-replacements")
    words = drawn(names.withColumnRenamed("word", "canon"), _name_surrogate).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("canon", "new"))).alias("words"), F.flatten(F.collect_list("forms")).alias("forms")
    )
    words = written(words, "pii-words")
    discard(entities, names, *tables)
    between = F.split(text, VALUES, -1)
    rewritten = F.array_join(F.zip_with(between, F.concat("new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    text_now = F.when(F.col("new").isNull(), text).otherwise(rewritten)
    changed = found.join(by_row, "row", "left").withColumn("text", text_now).drop("mentions", "titled", "new")
    changed = _with_names(changed.join(words, "row", "left"))
    n = F.coalesce("n", F.lit(0)) + F.coalesce(F.size("runs"), F.lit(0))
    changed = changed.select(F.col("doc").withField("text", F.col("text")).alias("doc"), n.cast("long").alias("n_entities"))
    same = whole.where(~some).select("doc", F.lit(0).cast("long").alias("n_entities"))
    return changed.unionByName(same).select(*columns, "n_entities")


def _with_names(rows: DataFrame) -> DataFrame:
    """rows (text, words, forms) with their names replaced in text, and the runs of name words that stood there; all null without words."""
    spelled = F.flatten(F.transform("forms", lambda x: F.array(x, F.upper(x), F.initcap(F.lower(x)))))
    # the longest first, so that no word is taken for a part of another
    spelled = F.array_sort(F.array_distinct(spelled), lambda a, b: F.length(b) - F.length(a))
    either = F.concat(F.lit("(?:"), F.array_join(spelled, "|"), F.lit(")"))
    rows = rows.withColumn("pattern", F.concat(F.lit(r"(?<!\p{L})"), either, F.lit("(?: "), either, F.lit(r")*(?!\p{L})")))
    rows = rows.withColumn("runs", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))

    def renamed(run: Column) -> Column:
        word = lambda w: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(F.try_element_at("words", F.lower(w)))).otherwise(F.try_element_at("words", F.lower(w)))
        return F.array_join(F.transform(F.split(run, " "), word), " ")

    between = F.split("text", F.col("pattern"), -1)
    new = F.concat(F.transform("runs", renamed), F.array(F.lit("")))
    renamed_text = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, b)), "")
    return rows.withColumn("text", F.when(F.col("runs").isNull(), F.col("text")).otherwise(renamed_text))


_own_keys: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The key under KEY_CONF; where it is unset, one that this application has drawn."""
    return spark.conf.get(KEY_CONF, None) or _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents", "doc_id", "text"), key_of(spark))
