"""Surrogates for personal data, in DataFrame expressions only.

Entities are found by one pattern. A surrogate depends on a key, the entity's type and its canonical form (so all spellings
of one value in all documents get the same one) and is written in the entity's own format: digits and punctuation stay
where they are, card numbers and IBANs keep their check digits' validity, addresses their class, secrets the prefix that tells
their kind. Given and family names are keyed apart, so a person keeps the family name with and without the given one; they
match script and gender. Numbers are permuted by keyed Feistel rounds, so distinct ones stay distinct; all surrogates are
checked against each other and against the corpus' real values, and clashes are drawn again.

Plain numbers, dates and times are no entities: a card needs an issuer's first digits and the right check digit, other
numbers the word that says what they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.llm.shared import bit_marked, stored

#: Draws of a name before its surrogate gets longer.
LONG_FROM = 4
#: Titles by gender, and those that tell none.
MALE = "Mr|Sir|Lord|Herrn|Herr|Monsieur|Señor|Sr|Don|Г-н|Господин|Κύριος|κύριος"
FEMALE = "Mrs|Ms|Miss|Lady|Frau|Madame|Mademoiselle|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña|Г-жа|Госпожа|Κυρία|κυρία"
NEUTRAL = "Dr|Prof|Professor|Doctor|Доктор|Профессор"
#: Forms of address that follow a name.
HONORIFIC = "さん|さま|様|くん|ちゃん|先生|女士|小姐"
#: Given names by script and gender; surrogates are taken from them, and they mark names without a title.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Henry Ivan Jonas Karl Louis Marco Nils Oscar Paul Robin Simon Thomas Victor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Fiona Greta Helen Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sofia Tina Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Григорий Денис Егор Иван Кирилл Лев Максим Николай Олег Павел Роман Сергей Тимур".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Елена Ирина Ксения Лариса Мария Нина Ольга Полина Раиса Софья Тамара".split(),
    ("greek", "m"): "Αντώνης Βασίλης Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Πέτρος Σπύρος Χρήστος".split(),
    ("greek", "f"): "Άννα Βάσω Δήμητρα Ελένη Κατερίνα Μαρία Νίκη Σοφία Φωτεινή Χριστίνα".split(),
    ("han", "m"): "健太 大輔 誠 隆 学 翔 浩 修 豊 進".split(),
    ("han", "f"): "花子 愛 恵 幸子 美咲 由美 陽子 直美 裕子 和子".split(),
}
#: Further given names that mark a name without a title.
COMMON = {
    "m": "Alexander Andreas Antonio Bob Carlos Charles Christian Daniel Edward Frank George Hans James Jan Jean John José Juan Klaus Luis Manuel Mark Martin Matthew Michael Miguel Patrick Pedro Peter Philippe Pierre Richard Robert Stefan Steven William Wolfgang".split(),
    "f": "Alice Amy Barbara Carmen Catherine Christine Claire Elena Elizabeth Eva Heike Ingrid Isabel Jane Jennifer Karen Katharina Lisa Lucia Margaret Marie Mary Monika Nathalie Nicole Petra Sabine Sarah Sophie Susan Ursula".split(),
}
#: Syllables of family names by script.
SYLLABLES = {
    "latin": "bar ben bor dal den dor fal fen gar gol hal hol kar kel lan lor mar mel nor pol ran ros sal sten tal tor val ven wal zel".split(),
    "cyrillic": "бар бел бор вал вер гал гор дан дор зел зор кар кол лан лев мар мел нор пав пол рад рос сав сол тал тор фед хар чер шал".split(),
    "greek": "βαλ βελ γαρ δαλ δορ ζαρ θαλ καρ κελ λαν λορ μαρ μελ νορ παλ ραδ ρος σαλ ταλ τορ φαλ χαρ".split(),
    "han": "石 岩 梅 江 岡 柏 金 川 木 北 黒 坂 沢 島 杉 高 竹 谷 中 西 野 橋 林 原 東 広 藤 松 森 山".split(),
}
_WORD = r"\p{Lu}[\p{L}'’-]++"
_KNOWN = "|".join(n for names in [*GIVEN.values(), *COMMON.values()] for n in names if not n[0] > "　")
_TITLE = rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.? "
_HAN = rf"\p{{IsHan}}{{1,4}}(?={HONORIFIC})"
#: Words that say what the number after them is.
_NUMBERED = "account|acct|konto|compte|cuenta|счёт|passport|pasaporte|passeport|ausweis|phone|tel|telefon|teléfono|téléphone|mobile|fax"
PATTERNS = {
    "secret": r"(?<=[=: \"'])(?=[A-Za-z0-9_+/-]{12})(?<=(?i:token|secret|password|passwd|api_key|apikey|key) {0,2}[=:] {0,2}[\"']?)[A-Za-z0-9_+/-]{12,}+|(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|[0-9A-Fa-f]{32,64})(?![A-Za-z0-9])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) \d{3}-\d{4}(?!\d)",
    "social": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\dA-Za-z])(?:4|5[1-5]|2[2-7]|3[47]|6)\d?\d?\d?(?:[ -]?\d){9,15}(?![\dA-Za-z])",
    "account": rf"(?<![\p{{L}}\p{{N}}])(?=[ACKPTMFСackptmfс])(?i:{_NUMBERED})(?:[ -]?(?i:no|nr|number|nummer|numéro|número|n°))?[.:]? ?#?\d(?:[ ./-]?\d){{5,17}}(?![\dA-Za-z])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=[\p{{Lu}}κ])(?:(?=\p{{L}}[-\p{{L}}]{{0,12}}+\.? \p{{Lu}}){_TITLE}{_WORD}(?: {_WORD})?|(?=\p{{L}}++ \p{{Lu}})(?:{_KNOWN}) {_WORD})|{_HAN}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity holds one of these (one-digit octets and spaced digits too, and hex secrets without two digits side by
#: side); a quick test that spares texts without any the long pattern.
HINT = rf"\d[. /-]?\d|@|AKIA|[0-9A-Fa-f]{{32}}|[=:] {{0,2}}[\"']?[A-Za-z0-9_+/-]{{12}}|(?=[\p{{Lu}}κ]\p{{L}}?[-\p{{L}}]{{0,12}}\.? \p{{Lu}})(?:{_TITLE}|(?:{_KNOWN}) )\p{{Lu}}|\p{{IsHan}}(?:{HONORIFIC})"
#: Marks entities within a text while they are replaced; a code point that is no character.
MARK = "﷐"
#: What kinds of secrets begin with, and keep.
_PREFIX = r"^(?:AKIA|gh[a-z]_|[sp]k[-_]|xox[a-z]-|AIza)?"


def _digest(key: str, salt: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(salt), *parts), 256)


def _number(digest: Column, start: int = 1) -> Column:
    """A number below 2**52 from a hex digest."""
    return F.conv(F.substring(digest, start, 13), 16, 10).cast("long")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def is_card(value: Column) -> Column:
    """13 to 19 digits whose last is the right check digit."""
    digits = _digits(value)
    return F.length(digits).between(13, 19) & (_luhn(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1).cast("int"))


def entity_type(value: Column) -> Column:
    """An entity's type by its form; null for a number that is no card."""
    return (
        F.when(value.rlike("^[0-9A-Fa-f]{32,64}$"), F.lit("secret"))  # some in upper case look like an IBAN
        .when(value.rlike(rf"^(?:{PATTERNS['ip']})$"), F.lit("ip"))
        .when(value.rlike(r"^[+(]\d"), F.lit("phone"))
        .when(value.rlike(rf"^(?:{PATTERNS['social']})$"), F.lit("social"))
        .when(value.rlike(rf"^(?:{PATTERNS['card']})$"), F.when(is_card(value), F.lit("card")))
        .when(value.rlike(rf"^(?:{PATTERNS['iban']})$"), F.lit("iban"))
        .when(value.rlike(rf"^(?:{PATTERNS['email']})$"), F.lit("email"))
        .when(value.rlike(rf"^(?:{PATTERNS['account']})$"), F.lit("account"))
        .when(value.rlike(rf"^(?:{_TITLE}|(?:{_KNOWN}) {_WORD}$|\p{{IsHan}}+$)"), F.lit("name"))
        .otherwise(F.lit("secret"))
    )


def canonical(kind: Column, value: Column) -> Column:
    """What the spellings of one value have in common; a phone number keeps its plus sign. Names have atoms instead."""
    return (
        F.when(kind.isin("social", "card", "account"), _digits(value))
        .when(kind == "phone", F.regexp_replace(value, r"[^\d+]", ""))
        .when(kind == "email", F.lower(value))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "ip", F.array_join(F.transform(F.split(value, r"\."), lambda o: o.cast("int").cast("string")), "."))
        .otherwise(value)
    )


def _script(word: Column) -> Column:
    cases = [(r"\p{IsCyrillic}", "cyrillic"), (r"\p{IsGreek}", "greek"), (r"\p{IsHan}", "han")]
    return reduce(lambda c, x: c.when(word.rlike(x[0]), F.lit(x[1])), cases[1:], F.when(word.rlike(cases[0][0]), F.lit(cases[0][1]))).otherwise(F.lit("latin"))


def _gender(value: Column, given: Column) -> Column:
    """m or f by the title, else by the given name, else n."""
    of = lambda g: given.isin(*[n for (_, own), names in GIVEN.items() if own == g for n in names], *COMMON[g])
    return F.when(value.rlike(rf"^(?:{FEMALE})\.? "), "f").when(value.rlike(rf"^(?:{MALE})\.? "), "m").when(of("f"), "f").when(of("m"), "m").otherwise("n")


def atoms(kind: Column, value: Column) -> Column:
    """array<struct<kind, plain>>: what of an entity gets a surrogate of its own. A name has its family name and, before
    it, its given name, which also goes by gender; any other entity is one atom, in its canonical form."""
    bare = F.regexp_replace(value, rf"^{_TITLE}", "")
    words = F.split(bare, " ")
    family, given = F.element_at(words, -1), F.element_at(words, 1)
    make = lambda k, p: F.struct(k.alias("kind"), p.alias("plain"))
    last = make(F.concat(F.lit("family:"), _script(family)), F.lower(family))
    first = make(F.concat_ws(":", F.lit("given"), _script(given), _gender(value, given)), F.lower(given))
    return F.when(kind == "name", F.when(F.size(words) > 1, F.array(first, last)).otherwise(F.array(last))).otherwise(F.array(make(kind, canonical(kind, value))))


def _modulo(digits: Column) -> Column:
    """Ten to the number of ``digits`` (18 at most), as a long."""
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(digits))).cast("long")


def permute_digits(digits: Column, key: str, attempt: Column) -> Column:
    """A keyed permutation of the digit strings of each length up to 36: four Feistel rounds over the two halves."""
    half = F.floor(F.length(digits) / 2).cast("int")
    state = F.struct(F.substring(digits, F.lit(1), half).alias("l"), F.substring(digits, half + 1, F.length(digits)).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.when(s["l"] == "", F.lit("")).otherwise(
            F.lpad(((s["l"].cast("long") + _number(_digest(key, "digits", i.cast("string"), attempt.cast("string"), s["r"]))) % _modulo(s["l"])).cast("string"), F.length(s["l"]), "0")
        )
        return F.struct(s["r"].alias("l"), left.alias("r"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(4)), state, turn)
    return F.concat(out["l"], out["r"])


def _luhn(prefix: Column) -> Column:
    """The check digit that completes ``prefix``."""
    digits = F.transform(F.split(F.reverse(prefix), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    total = F.aggregate(digits, F.lit(0), lambda a, b: a + b)
    return F.pmod(F.lit(10) - total % 10, F.lit(10))


def _card(digits: Column, key: str, attempt: Column) -> Column:
    """The issuer's first two digits stay, the others but the last are permuted, and the last is the right check digit."""
    issuer = F.substring(digits, 1, 2)
    new = F.concat(issuer, permute_digits(F.substring(digits, F.lit(3), F.length(digits) - 3), key, attempt))
    return F.concat(new, _luhn(new).cast("string"))


def _written(value: Column, new: Column, places: str = r"\d") -> Column:
    """``value`` with its digits (or other ``places``) replaced, in order, by those of ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(s: Column, c: Column) -> Column:
        is_place = c.rlike(f"^{places}$")
        return F.struct(F.concat(s["out"], F.when(is_place, F.substring(new, s["n"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["n"] + is_place.cast("int")).alias("n"))

    return F.aggregate(F.split(value, ""), start, put)["out"]


def _like(value: Column, seed: Column, key: str, attempt: Column, hexes: bool = True) -> Column:
    """Each letter or digit of ``value`` replaced by one of its own class (with ``hexes``, hex letters by hex letters), keyed
    by ``seed``."""
    lower_hex, upper_hex = value.rlike("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]+$"), value.rlike("^(?=.*[A-F])(?=.*[0-9])[0-9A-F]+$")
    mixed_hex = value.rlike("^[0-9A-Fa-f]{32,64}$")

    def put(c: Column, i: Column) -> Column:
        n = _number(_digest(key, "like", seed, attempt.cast("string"), i.cast("string")))
        pick = lambda letters: F.substring(F.lit(letters), (n % len(letters) + 1).cast("int"), F.lit(1))
        in_hex = (
            F.when(lower_hex, pick("0123456789abcdef"))
            .when(upper_hex, pick("0123456789ABCDEF"))
            .when(mixed_hex & c.rlike("[a-f]"), pick("abcdef"))
            .when(mixed_hex & c.rlike("[A-F]"), pick("ABCDEF"))
        )
        return (
            (in_hex if hexes else F)
            .when(c.rlike("[0-9]"), pick("0123456789"))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"\p{L}"), pick("aeioubcdfglmnprst"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), put), "")


def _secret(value: Column, key: str, attempt: Column) -> Column:
    """The prefix that tells the kind of secret stays."""
    prefix = F.regexp_extract(value, _PREFIX, 0)
    rest = F.substring(value, F.length(prefix) + 1, F.length(value))
    return F.concat(prefix, F.when(rest == "", "").otherwise(_like(rest, value, key, attempt)))


def _iban_check(country: Column, account: Column) -> Column:
    """The check number (2 to 98) of an account: 98 less the remainder by 97, letters counting as 10 to 35."""
    add = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.lit(98) - F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), add)


def _iban(plain: Column, key: str, attempt: Column) -> Column:
    """Country kept, the account drawn anew; the check digits stay as far from the right ones as they were."""
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    new = _like(account, plain, key, attempt, hexes=False)
    off = F.substring(plain, 3, 2).cast("int") - _iban_check(country, account)
    check = F.pmod(_iban_check(country, new) + off - 2, F.lit(97)) + 2
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)


def _email(value: Column, key: str, attempt: Column) -> Column:
    """A local part of the same shape with a keyed tag, at a reserved domain that stands for the real one."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    tag = F.substring(_digest(key, "tag", value, attempt.cast("string")), 1, 10)
    host = F.substring(_digest(key, "host", domain), 1, 8)
    return F.concat(_like(local, value, key, attempt), F.lit("."), tag, F.lit("@m"), host, F.lit(".example"))


#: Classes of addresses that stay among themselves, as first address and number of free bits.
ADDRESS_CLASSES = {"10.0.0.0": 24, "127.0.0.0": 24, "169.254.0.0": 16, "172.16.0.0": 20, "192.168.0.0": 16, "224.0.0.0": 28, "240.0.0.0": 28, "0.0.0.0": 24}


def _address(text: str) -> int:
    return reduce(lambda n, o: n * 256 + int(o), text.split("."), 0)


def _feistel(number: Column, bits: int, key: str, attempt: Column) -> Column:
    """A keyed permutation of the numbers of an even number of bits: four rounds over its halves."""
    half = 1 << (bits // 2)
    state = F.struct(F.floor(number / half).alias("l"), (number % half).alias("r"))
    turn = lambda s, i: F.struct(s["r"].alias("l"), ((s["l"] + _number(_digest(key, f"ip{bits}", i.cast("string"), attempt.cast("string"), s["r"].cast("string")))) % half).alias("r"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(4)), state, turn)
    return out["l"] * half + out["r"]


def _ip(plain: Column, key: str, attempt: Column) -> Column:
    """A keyed permutation of the addresses of each class. Public ones are permuted again as long as they fall into another
    class, at most 24 times (a chance of less than 1e-15)."""
    o = F.split(plain, r"\.")
    number = F.aggregate(o, F.lit(0).cast("long"), lambda n, x: n * 256 + x.cast("long"))
    inside = lambda n, first, bits: (n >= first) & (n < first + (1 << bits))
    special = [(_address(a), bits) for a, bits in ADDRESS_CLASSES.items()]
    is_special = lambda n: reduce(lambda a, b: a | b, [inside(n, *c) for c in special])
    step = lambda n, i: F.when((i == 1) | is_special(n), _feistel(n, 32, key, attempt)).otherwise(n)
    public = F.aggregate(F.sequence(F.lit(1), F.lit(24)), number, step)
    new = reduce(lambda c, x: c.when(inside(number, *x), x[0] + _feistel(number - x[0], x[1], key, attempt)), special[1:], F.when(inside(number, *special[0]), special[0][0] + _feistel(number - special[0][0], special[0][1], key, attempt)))
    return F.aggregate(F.array(new.otherwise(public)), F.lit(""), lambda a, n: F.concat_ws(".", *[F.floor(n / 256**k) % 256 for k in (3, 2, 1, 0)]))


def _choose(names: Column, n: Column, salt: str, kind: Column, plain: Column, key: str, attempt: Column) -> Column:
    """``n`` of the names, drawn by the key."""
    at = lambda i: (_number(_digest(key, salt, kind, plain, attempt.cast("string"), i.cast("string"))) % F.size(names) + 1).cast("int")
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(names, at(i)))


def _listed(kind: Column, lists: dict[str, list[str]]) -> Column:
    """The list of the kind; as one text that is cut, which keeps plans small."""
    first, *more = lists.items()
    words = lambda v: F.lit(" ".join(v))
    return F.split(reduce(lambda c, x: c.when(kind == x[0], words(x[1])), more, F.when(kind == first[0], words(first[1]))), " ")


def _given(kind: Column, plain: Column, key: str, attempt: Column) -> Column:
    """A given name of the gender and script, in lower case; drawn again it is a double name, later a longer one."""
    own = lambda s, g: GIVEN[s, g] if g != "n" else GIVEN[s, "m"] + GIVEN[s, "f"]
    names = _listed(kind, {f"given:{s}:{g}": [x.lower() for x in own(s, g)] for s in SYLLABLES for g in "mfn"})
    n = F.when(attempt == 0, 1).when(attempt < LONG_FROM, 2).when(attempt < 2 * LONG_FROM, 3).otherwise(6)
    drawn = _choose(names, n, "given", kind, plain, key, attempt)
    return F.when(kind.contains(":han:"), F.array_join(drawn, "")).otherwise(F.array_join(drawn, "-"))


def _family(kind: Column, plain: Column, key: str, attempt: Column) -> Column:
    """A family name of four syllables (two in Han script), after ``LONG_FROM`` draws of twice as many; Cyrillic endings of
    either gender stay."""
    parts = _listed(kind, {f"family:{s}": v for s, v in SYLLABLES.items()})
    n = F.when(kind == "family:han", 2).otherwise(4) * F.when(attempt >= LONG_FROM, 2).otherwise(1)
    return F.concat(F.array_join(_choose(parts, n, "family", kind, plain, key, attempt), ""), F.regexp_extract(plain, "(ова|ева|ина|ов|ев|ин)$", 1))


def surrogate(kind: Column, plain: Column, key: str, attempt: Column) -> Column:
    """The replacement of an atom in canonical form, by its kind."""
    country = F.substring(plain, F.lit(1), F.when(plain.startswith("+"), 2).otherwise(0))  # the plus and the first digit stay
    return (
        F.when(kind == "phone", F.concat(country, permute_digits(F.substring(plain, F.length(country) + 1, F.length(plain)), key, attempt)))
        .when(kind == "card", _card(plain, key, attempt))
        .when(kind.isin("social", "account"), permute_digits(plain, key, attempt))
        .when(kind == "email", _email(plain, key, attempt))
        .when(kind == "ip", _ip(plain, key, attempt))
        .when(kind == "iban", _iban(plain, key, attempt))
        .when(kind.startswith("given"), _given(kind, plain, key, attempt))
        .when(kind.startswith("family"), _family(kind, plain, key, attempt))
        .otherwise(_secret(plain, key, attempt))
    )


def _spelt(kind: Column, value: Column, masks: Column) -> Column:
    """The surrogates of an entity's atoms in the entity's own format."""
    one, last = masks[0], F.element_at(masks, -1)
    words = F.split(F.regexp_replace(value, rf"^{_TITLE}", ""), " ")
    title = F.regexp_extract(value, rf"^{_TITLE}", 0)
    cased = lambda new, old: F.when((F.length(old) > 1) & (old == F.upper(old)) & (old != F.lower(old)), F.upper(new)).otherwise(F.regexp_replace(F.initcap(F.replace(new, F.lit("-"), F.lit(" "))), " ", "-"))
    name = F.concat(title, F.when(F.size(masks) > 1, F.concat(cased(one, words[0]), F.lit(" "))).otherwise(""), cased(last, F.element_at(words, -1)))
    return (
        F.when(kind.isin("phone", "social", "card", "account"), _written(value, F.regexp_replace(one, r"\D", "")))
        .when(kind == "iban", _written(value, one, "[A-Z0-9]"))
        .when(kind == "name", name)
        .otherwise(one)
    )


def entities(text: Column) -> Column:
    """All that the patterns find in a text, in order; empty for null. Numbers that are no card have no type."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _drawn(rows: DataFrame, key: str) -> DataFrame:
    """(kind, plain, attempt) with the surrogate as ``mask``."""
    return rows.withColumn("mask", surrogate(F.col("kind"), F.col("plain"), key, F.col("attempt")))


def exceptions(found: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """(kind, plain, attempt) of atoms whose first surrogate is another one's or a real one; empty as a rule.

    ``found``: (kind, plain), distinct. Each round draws clashing atoms again and checks all surrogates anew, until no clash
    is left; clashes left after ``rounds`` are an error (a corpus that holds almost all numbers of a length). Given names of
    both genders are checked together.
    """
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.select("kind", "plain").repartition(n, "kind", "plain")  # drawing is the work, whatever the bytes
    current = stored(_drawn(dealt.withColumn("attempt", F.lit(0)), key), "surrogates")
    space = F.when(F.col("kind").startswith("given"), F.lit("given")).otherwise(F.col("kind")).alias("space")
    atom = F.struct("kind", "plain")
    for _ in range(rounds):
        rows = current.select("*", space)
        # The least atom keeps a shared surrogate; nobody keeps a real value.
        owners = rows.groupBy("space", "mask").agg(F.min(atom).alias("owner"), F.max(atom).alias("other")).where("owner <> other")
        shared = rows.join(owners, ["space", "mask"]).where(atom != F.col("owner")).select("kind", "plain")
        real = rows.join(rows.select("space", F.col("plain").alias("mask")), ["space", "mask"], "left_semi").select("kind", "plain")
        clash = stored(shared.union(real).distinct(), "clashes")
        if not clash.limit(1).count():
            return current.where("attempt > 0").select("kind", "plain", "attempt")
        again = current.join(clash, ["kind", "plain"], "left_semi").withColumn("attempt", F.col("attempt") + 1).drop("mask")
        current = stored(current.join(clash, ["kind", "plain"], "left_anti").unionByName(_drawn(again.repartition(n, "kind", "plain"), key)), "surrogates")
    raise RuntimeError(f"surrogates clash after {rounds} rounds")


def _replaced(text: Column, key: str, attempts: Column) -> Column:
    """struct(text, n): the text with its entities replaced, and their number.

    The long pattern runs once: it marks entities, and the text is cut at the marks. A text that holds the mark itself is
    cut by the pattern instead. ``attempts``: from an atom to its draw, where that is not the first.
    """
    marked = F.split(F.regexp_replace(text, f"(?:{ANY})", f"{MARK}$0{MARK}"), MARK, -1)
    own, rest = F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.split(text, ANY, -1)
    twice = F.flatten(F.transform(rest, lambda p, i: F.when(i == 0, F.array(p)).otherwise(F.array(own[i - 1], p))))
    parts = F.when(text.contains(MARK), twice).otherwise(marked)
    # One step per transform, so that a later step reads the earlier one's value instead of computing it again.
    typed = F.transform(parts, lambda v, i: F.struct(v.alias("value"), F.when(i % 2 == 1, entity_type(v)).alias("kind")))
    split = F.transform(typed, lambda e: e.withField("atoms", F.when(e["kind"].isNotNull(), atoms(e["kind"], e["value"]))))
    attempt = lambda a: F.coalesce(F.element_at(attempts, F.concat_ws("|", a["kind"], a["plain"])), F.lit(0))
    masked = F.transform(split, lambda e: e.withField("masks", F.transform(e["atoms"], lambda a: surrogate(a["kind"], a["plain"], key, attempt(a)))))
    spelt = F.transform(masked, lambda e: F.when(e["kind"].isNull(), e["value"]).otherwise(_spelt(e["kind"], e["value"], e["masks"])))
    n = F.size(F.filter(typed, lambda e: e["kind"].isNotNull()))
    some = F.struct(F.array_join(spelt, "").alias("text"), n.cast("long").alias("n"))
    none = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    return F.when(text.rlike(HINT), some).otherwise(none)


def replace_entities(docs: DataFrame, key: str, count: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text``, and the number of entities as ``count``; all other columns and all rows stay.

    Null text stays null and has no entities. Equal rows give equal rows. A column of ``docs`` named ``count`` is replaced.
    Texts with an entity that was drawn again (found by a bitmap of fixed size) are met with its draw by a join.
    """
    if not key:
        raise ValueError("a key is needed")
    mention = docs.where(F.col("text").rlike(HINT)).select(F.md5("text").alias("t"), F.explode(F.array_distinct(entities(F.col("text")))).alias("value"))
    mention = mention.withColumn("kind", entity_type(F.col("value"))).where("kind is not null")
    mention = stored(mention.select("t", F.explode(atoms(F.col("kind"), F.col("value"))).alias("a")).select("t", "a.*").distinct(), "mentions")
    redrawn = stored(exceptions(mention.select("kind", "plain").distinct(), key), "exceptions")
    named = mention.join(redrawn, ["kind", "plain"]).select("t", F.struct(F.concat_ws("|", "kind", "plain"), "attempt").alias("e"))
    attempts = stored(named.groupBy("t").agg(F.map_from_entries(F.collect_list("e")).alias("__attempts")), "attempts")  # a text's own
    columns = [c for c in docs.columns if c != count]
    rows = bit_marked(docs.select(F.struct(*columns).alias("__doc"), F.md5("text").alias("__t")), "__t", attempts, "t", "__maybe")
    text = F.col("__doc.text")
    once = rows.where("not __maybe").select("__doc", F.lit(None).cast(attempts.schema["__attempts"].dataType).alias("__attempts"))
    again = rows.where("__maybe").join(attempts, F.col("__t") == F.col("t"), "left").select("__doc", "__attempts")
    out = once.union(again).select("__doc", _replaced(text, key, F.col("__attempts")).alias("__new"))
    return out.select(*[F.col("__new.text").alias(c) if c == "text" else F.col("__doc")[c].alias(c) for c in columns], F.col("__new.n").alias(count))
