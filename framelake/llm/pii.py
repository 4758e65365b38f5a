"""Surrogates for personal data, with DataFrame functions only.

One pattern finds entities; a text is cut at them, and each gets a surrogate
that depends on a key, its type and its canonical form, so mentions of one
entity (any case, any punctuation of a number) stay one entity, everywhere. A
name is cut into its words, each an entity of its own: a surname alone, after a
title or after a given name has one surrogate; in a text that holds names,
their words are found standing alone, too. Surrogates keep type, length and
format of numbers and addresses; names keep script and gender. Distinct
entities get distinct surrogates, none of them equal to an entity of the
corpus: candidates that collide are drawn again in rounds, over the table of
distinct entities.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

# Words that announce a name, given names by gender, family names, and words that say that no name or one is near.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madame", "Mme", "Mlle", "Frau", "Señora", "Señorita", "Sra", "Doña", "Signora", "Κυρία", "г-жа", "госпожа")
MALE_TITLES = ("Mr", "Mister", "Sir", "Monsieur", "Herr", "Señor", "Sr", "Signor", "Κύριος", "г-н", "господин")
NEUTRAL_TITLES = ("Dr", "Prof", "Professor", "Doctor")
FEMALE_NAMES = (
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Jessica", "Karen", "Emily", "Anna", "Barbara", "Nancy", "Margaret", "Laura", "Emma", "Olivia", "Sophia", "Hannah",
    "Sophie", "Camille", "Juliette", "Amélie", "Chloé", "Claire", "Marie", "Nathalie", "Isabelle", "Ursula", "Ingrid", "Heike", "Sabine", "Katrin", "Petra", "Greta",
    "Lucía", "Carmen", "Isabel", "María", "Ana", "Sofía", "Elena", "Giulia", "Chiara", "Francesca", "Agnieszka", "Katarzyna", "Priya", "Anjali", "Fatima", "Aisha", "Leila", "Yuki", "Sakura", "Mei", "Amina", "Ngozi",
    "Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана", "Екатерина", "Юлия", "Μαρία", "Ελένη", "Αικατερίνη",
)
MALE_NAMES = (
    "James", "Robert", "John", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Mark", "Paul", "Steven", "Andrew", "Peter", "George", "Henry",
    "Pierre", "Jean", "François", "Jacques", "Louis", "Antoine", "Nicolas", "Hans", "Jürgen", "Klaus", "Wolfgang", "Stefan", "Lukas", "Otto", "Fritz",
    "Carlos", "Javier", "Miguel", "José", "Juan", "Luis", "Pedro", "Marco", "Giovanni", "Luca", "Piotr", "Tomasz", "Rajesh", "Arjun", "Amit", "Mohammed", "Ahmed", "Omar", "Ali", "Hiroshi", "Kenji", "Chukwu", "Kwame",
    "Иван", "Алексей", "Дмитрий", "Сергей", "Андрей", "Михаил", "Николай", "Владимир", "Павел", "Александр", "Γιώργος", "Δημήτρης", "Νίκος",
)
NEUTRAL_NAMES = ("Wei", "Ming", "Jin", "Hong", "Xin", "Alex", "Kim", "Robin", "Taylor", "Jordan", "Andrea", "Sasha", "Dominique", "Camilo", "Minh", "Thanh")
FAMILY_NAMES = (
    "Smith", "Johnson", "Williams", "Brown", "Jones", "Davis", "Miller", "Wilson", "Anderson", "Taylor", "Thompson", "Martin", "Jackson", "Harris", "Clark", "Lewis", "Robinson", "Walker", "Wright", "Campbell",
    "Dupont", "Durand", "Dubois", "Moreau", "Lefebvre", "Bernard", "Müller", "Schmidt", "Schneider", "Fischer", "Weber", "Meyer", "Wagner", "Becker", "Hoffmann",
    "García", "Garcia", "González", "Gonzalez", "Rodríguez", "Rodriguez", "Fernández", "López", "Lopez", "Martínez", "Martinez", "Sánchez", "Pérez", "Rossi", "Russo", "Ferrari", "Bianchi", "Silva", "Santos", "Oliveira", "Kowalski", "Nowak",
    "Patel", "Singh", "Kumar", "Sharma", "Gupta", "Khan", "Hussain", "Hassan", "Zhang", "Wang", "Li", "Chen", "Liu", "Yang", "Huang", "Zhao", "Wu", "Zhou", "Nguyen", "Tran", "Kim", "Park", "Tanaka", "Suzuki", "Sato", "Yamamoto", "Okafor", "Mensah",
    "Иванов", "Иванова", "Смирнов", "Смирнова", "Кузнецов", "Кузнецова", "Попов", "Попова", "Петров", "Петрова", "Παπαδόπουλος",
)
PARTICLES = ("van", "von", "der", "den", "de", "la", "le", "di", "da", "del", "dos", "bin", "al", "el")
INTRODUCTIONS = ("my name is ", "My name is ", "mein Name ist ", "Mein Name ist ", "Ich heiße ", "ich heiße ", "je m'appelle ", "Je m'appelle ", "me llamo ", "Me llamo ", "меня зовут ", "Меня зовут ")
SPEECH = ("said", "says", "wrote", "writes", "called", "told", "asked", "replied", "answered", "lives", "lived", "died", "married", "sagte", "schrieb", "wohnt", "dit", "habite", "dijo", "vive", "сказал", "сказала")
NO_NAMES = (
    "The", "This", "That", "These", "Those", "A", "An", "In", "On", "At", "By", "For", "From", "With", "And", "But", "Or", "If", "When", "While", "Dear", "Our", "My", "His", "Her", "Their", "New", "No", "All", "General", "Public", "Open",
    "Der", "Die", "Das", "Ein", "Eine", "Le", "La", "Les", "Un", "Une", "El", "Los", "Las", "Una",
)
NO_FAMILY = ("Inc", "Corp", "Ltd", "Company", "Group", "University", "College", "Institute", "License", "Public", "Bank", "Street", "Road", "City", "County", "States", "Kingdom", "Department", "Ministry", "Times", "Post", "News", "Version")

_CAP = r"\p{Lu}(?:['’]\p{Lu})?+\p{Ll}++(?:-?\p{Lu}\p{Ll}++)?+"
_END = r"(?![\p{L}\p{N}])"


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


_TITLE = _any(FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES)
_FAMILY = rf"(?:{_any(PARTICLES)} ){{0,2}}{_CAP}"
_SURE = rf"(?!{_any(NO_NAMES)} ){_CAP} (?!{_any(NO_FAMILY)}{_END}){_FAMILY}"  # two capitalised words that may be a name where their neighbours say so
_SECRET_HEAD = r"(?:(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)"
_TOKEN_HEAD = r"(?:AKIA|gh[pousr]_|sk-|xox[abpr]-)"
_LABEL = r"[\p{L}\p{N}]++(?:-++[\p{L}\p{N}]++)*+"
_HEX = "[0-9A-Fa-f]{1,4}"
#: By type, in the order in which alternatives are tried. No group repeats without a bound but possessively (Java's
#: matcher then loops and doesn't recurse), and no two starts scan the same run: the time is linear in the text.
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+\-])[\p{{L}}\p{{N}}._%+\-]++@(?=[\p{{L}}\p{{N}}\-.]*?\.\p{{L}}{{2}}){_LABEL}(?:\.{_LABEL})++",
    "secret": _SECRET_HEAD + r"[^\s\"']{6,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}+|sk-[0-9A-Za-z]{20,}+|xox[abpr]-[0-9A-Za-z\-]{10,}+",
    "ip": rf"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)|(?:{_HEX}:){{7}}{_HEX}(?![\p{{L}}\p{{N}}:])|(?=[0-9A-Fa-f:]{{0,38}}\d)(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}(?![\p{{L}}\p{{N}}:])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?:4\d{12}(?:\d{3}){0,2}|(?:5[1-5]|2[2-7]|35|65)\d{14}|6011\d{12}|3[4678]\d{12,13}|(?:4\d|5[1-5]|2[2-7]|35|60|65)\d\d[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|3[47]\d\d[ \-]\d{6}[ \-]\d{5})(?![\p{L}\p{N}])",
    "phone": r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,5}(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "name": rf"{_TITLE}\.? (?:\p{{Lu}}\. )?{_CAP}(?: {_FAMILY}){{0,2}}"
    rf"|{_any(FEMALE_NAMES + MALE_NAMES + NEUTRAL_NAMES)} (?:\p{{Lu}}\. )?(?!{_any(NO_FAMILY)}{_END}){_FAMILY}(?: {_CAP})?"
    rf"|(?!{_any(NO_NAMES)} ){_CAP} {_any(FAMILY_NAMES)}{_END}"
    rf"|{_any(INTRODUCTIONS)}{_CAP}(?: {_FAMILY}){{0,2}}"
    rf"|{_SURE}(?= (?:(?:and|und|et|y|и) {_CAP} {_CAP} )?{_any(SPEECH)}{_END})",
}
_BARE = _CAP + _END
#: What a name begins with that is no part of it.
_NAME_HEAD = rf"(?:{_TITLE}\.? |{_any(INTRODUCTIONS)})"
_NAME_WORD = rf"(?:{_CAP}|\p{{Lu}}\.|{_any(PARTICLES)})"
_NAME_SHAPE = rf"\A{_NAME_HEAD}?+{_NAME_WORD}(?: {_NAME_WORD})*+\z"
_LOWER = "".join(sorted({t[0] for t in FEMALE_TITLES + MALE_TITLES + INTRODUCTIONS if t[0].islower()}))
_LOWER_HEADS = _any(tuple(t for t in FEMALE_TITLES + MALE_TITLES + INTRODUCTIONS if t[0].islower()))


def _pattern(email: bool, bare: bool) -> str:
    """All of ``PATTERNS`` behind looks at the next letter, which spare most places most alternatives."""
    start = r"(?<![\p{L}\p{N}])"
    kinds = [rf"(?=[\d+(]){start}(?:" + "|".join(PATTERNS[k] for k in ("ip", "card", "phone", "ssn")) + ")"]
    kinds.append(rf"(?=[aAgpPsStTx]){start}(?:{PATTERNS['secret']})")
    kinds.append(rf"(?=[a-fA-F]){start}(?=[0-9A-Fa-f]{{1,4}}:)(?:{PATTERNS['ip']})")
    kinds.append(rf"(?=\p{{Lu}}){start}(?:{PATTERNS['iban']}|{PATTERNS['name']}{f'|{_BARE}' * bare})")
    kinds.append(rf"(?=[{_LOWER}]){start}(?={_LOWER_HEADS})(?:{PATTERNS['name']})")
    return "|".join([PATTERNS["email"]] * email + kinds)


# What names are made of, by script; endings by gender.
SYLLABLES = {
    "latin": ("ba", "del", "mi", "ro", "ve", "lan", "to", "ri", "sa", "ne", "ko", "lu", "fe", "dar", "mo", "ti"),
    "cyrillic": ("ба", "ли", "ро", "ми", "та", "ве", "но", "ка", "са", "ди", "ле", "ну", "го", "ри", "фе", "зо"),
    "greek": ("βα", "λι", "ρο", "μι", "τα", "νε", "κο", "σα", "δι", "λε", "νυ", "γο", "ρι", "φε", "ζω", "θα"),
}
ENDINGS = {
    ("latin", "given", "f"): ("ina", "elle", "ia", "ra"), ("latin", "given", "m"): ("on", "us", "an", "er"), ("latin", "given", "n"): ("en", "is", "y", "el"),
    ("cyrillic", "given", "f"): ("ина", "ия", "а", "ея"), ("cyrillic", "given", "m"): ("ан", "ий", "ор", "ил"), ("cyrillic", "given", "n"): ("им", "ен", "ис", "ир"),
    ("greek", "given", "f"): ("ία", "νη", "α", "ούλα"), ("greek", "given", "m"): ("ος", "ης", "ας", "ων"), ("greek", "given", "n"): ("ι", "ιν", "υ", "ω"),
    ("latin", "family", "f"): ("son", "mar", "den", "witt"), ("latin", "family", "m"): ("son", "mar", "den", "witt"), ("latin", "family", "n"): ("son", "mar", "den", "witt"),
    ("cyrillic", "family", "f"): ("ова", "ева", "ина", "ская"), ("cyrillic", "family", "m"): ("ов", "ев", "ин", "ский"), ("cyrillic", "family", "n"): ("ко", "ук", "як", "дзе"),
    ("greek", "family", "f"): ("ίδου", "άκη", "οπούλου", "ού"), ("greek", "family", "m"): ("ίδης", "άκης", "όπουλος", "ός"), ("greek", "family", "n"): ("ί", "έα", "ά", "ώ"),
}

#: What looks like an entity and isn't one: a card's number that fails the Luhn test. It stays as it is.
NONE = "none"
#: A capitalised word by itself: an entity if a name in the same text has it.
BARE = "bare"
_DIGITS_ONLY = ("card", "phone", "ssn", "iban")
MAX_ROUNDS = 40


# --- finding -----------------------------------------------------------------


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def _is(value: Column, kind: str) -> Column:
    return value.rlike(rf"\A(?:{PATTERNS[kind]})\z")


def _name_head(value: Column) -> Column:
    """The title or introduction that a name begins with, or an empty text."""
    return F.regexp_extract(value, rf"\A({_NAME_HEAD}?+)", 1)


def _title_gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"[. ]", "")
    return F.when(bare.isin(*FEMALE_TITLES), "f").when(bare.isin(*MALE_TITLES), "m").otherwise("n")


def _family_gender(word: Column) -> Column:
    """What the ending of a Cyrillic family name says."""
    return F.when(word.rlike(r"(?:ова|ева|ина|ская|цкая)\z"), "f").when(word.rlike(r"(?:ов|ев|ин|ский|цкий)\z"), "m").otherwise("n")


def _item(pre: Column, value: Column, post: Column, kind: Column, canon: Column, gender: Column, first: Column) -> Column:
    return F.struct(pre.alias("pre"), value.alias("value"), post.alias("post"), kind.alias("kind"), canon.alias("canon"), gender.alias("gender"), first.alias("first"))


def _name_items(gap: Column, value: Column) -> Column:
    """One item for each word of a name, with what stands before it, and after the last."""
    title = _name_head(value)
    held = F.array(F.struct(title.alias("title"), _title_gender(title).alias("gender"), F.substring(value, F.length(title) + 1, F.length(value)).alias("rest")))

    def cut(x: Column) -> Column:
        words, between = F.regexp_extract_all(x["rest"], F.lit(_CAP), 0), F.split(x["rest"], _CAP, -1)
        return F.transform(
            words,
            lambda w, i: _item(
                F.when(i == 0, F.concat(gap, x["title"], between[0])).otherwise(F.get(between, i)),
                w,
                F.when(i == F.size(words) - 1, F.element_at(between, -1)).otherwise(""),
                F.when((i == 0) & (F.size(words) > 1), "given").otherwise("family"),
                F.lower(w),
                F.when((i == 0) & (F.size(words) > 1), F.when(w.isin(*FEMALE_NAMES), "f").when(w.isin(*MALE_NAMES), "m").otherwise(x["gender"]))
                .when(_family_gender(w) != "n", _family_gender(w))
                .when((x["gender"] == "n") & words[0].isin(*FEMALE_NAMES), "f")
                .when((x["gender"] == "n") & words[0].isin(*MALE_NAMES), "m")
                .otherwise(x["gender"]),
                i == 0,
            ),
        )

    return F.transform(held, cut)[0]


def _items(gap: Column, value: Column) -> Column:
    """array of struct(pre, value, post, kind, canon, gender, first) of a match with the text before it: the canonical form is what mentions of one entity share."""
    kinds = [k for k in PATTERNS if k not in ("name", "secret")]
    kind = F.lit("secret")
    for name in reversed(kinds):
        kind = F.when(_is(value, name), name).otherwise(kind)
    kind = F.when(value.rlike(rf"\A{_BARE}\z"), BARE).when(value.rlike(_NAME_SHAPE), "name").otherwise(kind)
    alnum = F.regexp_replace(value, r"[^0-9A-Za-z]", "")
    kind = F.when((kind == "card") & (F.pmod(_luhn_sum(alnum), F.lit(10)) != 0), NONE).otherwise(kind)

    def made(x: Column) -> Column:
        alnum = x["alnum"]
        canon = (
            F.when(x["kind"] == "phone", F.when(F.length(alnum) > 10, F.substring(alnum, -10, 10)).otherwise(alnum))
            .when(x["kind"].isin(*_DIGITS_ONLY), alnum)
            .when(x["kind"] == "secret", F.regexp_replace(value, rf"\A{_SECRET_HEAD}", ""))
            .otherwise(F.lower(value))
        )
        one = F.array(_item(gap, value, F.lit(""), x["kind"], canon, F.lit("n"), F.lit(True)))
        return F.when(x["kind"] == "name", _name_items(gap, value)).otherwise(one)

    return F.transform(F.array(F.struct(kind.alias("kind"), alnum.alias("alnum"))), made)[0]


def with_items(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __pii_items (in order) and __pii_tail, the text after the last. Where a text holds a name, all its capitalised words are items."""
    of = F.col(text)
    some, named = F.size("__pii_values") > 0, F.col("__pii_named")
    # a text without the sign needs no look for addresses at all its words
    found = lambda bare: F.when(of.contains("@"), F.regexp_extract_all(of, F.lit(_pattern(True, bare)), 0)).otherwise(F.regexp_extract_all(of, F.lit(_pattern(False, bare)), 0))
    gaps = lambda bare: F.when(of.contains("@"), F.split(of, _pattern(True, bare), -1)).otherwise(F.split(of, _pattern(False, bare), -1))
    docs = docs.withColumn("__pii_values", found(False)).withColumn("__pii_named", F.exists("__pii_values", lambda v: v.rlike(_NAME_SHAPE)))
    docs = docs.withColumn("__pii_values", F.when(named, found(True)).otherwise(F.col("__pii_values")))
    docs = docs.withColumn("__pii_gaps", F.when(some, F.when(named, gaps(True)).otherwise(gaps(False))))
    items = F.flatten(F.zip_with(F.slice("__pii_gaps", F.lit(1), F.size("__pii_values")), "__pii_values", _items))
    docs = docs.withColumn("__pii_items", F.when(some, items)).withColumn("__pii_tail", F.when(some, F.element_at("__pii_gaps", -1)))
    return docs.drop("__pii_values", "__pii_named", "__pii_gaps")


# --- surrogates --------------------------------------------------------------


def _byte(digest: Column, i) -> Column:
    at = F.pmod(i, F.lit(64)) if isinstance(i, Column) else F.lit(i % 64)
    return F.conv(F.substring(digest, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: tuple[str, ...], byte: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), F.pmod(byte, F.lit(len(options))) + 1)


def _same_format(text: Column, digest: Column) -> Column:
    """Digits for digits, letters for letters of the same case (hexadecimal ones in a hexadecimal text); the rest stays."""
    once = F.array(F.struct(text.alias("text"), digest.alias("digest"), text.rlike(r"\A[0-9a-f:]*\z").alias("hexadecimal")))  # not again for each character

    def change(held: Column, c: Column, i: Column) -> Column:
        b = _byte(held["digest"], i)
        return (
            F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
            .when(c.rlike("[a-z]"), F.char(F.lit(97) + F.pmod(b, F.when(held["hexadecimal"], 6).otherwise(26))))
            .when(c.rlike("[A-Z]"), F.char(F.lit(65) + F.pmod(b, F.lit(26))))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(tuple("абвгдежзиклмнопрст"), b))
            .when(c.rlike(r"\p{IsGreek}"), _pick(tuple("αβγδεζηθικλμνοπρστυφχψω"), b))
            .when(c.rlike(r"\p{L}"), F.char(F.lit(97) + F.pmod(b, F.lit(26))))
            .otherwise(c)
        )

    return F.transform(once, lambda held: F.array_join(F.transform(_chars(held["text"]), lambda c, i: change(held, c, i)), ""))[0]


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, counted from its right end."""

    def value(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(F.pmod(i, F.lit(2)) == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(_chars(F.reverse(digits)), value), F.lit(0), lambda a, x: a + x)


def _number(kind: str, canon: Column, digest: Column) -> Column:
    if kind == "card":
        kept, rest = F.substring(canon, 1, 1), F.substring(canon, F.lit(2), F.length(canon))
        drawn = F.concat(kept, _same_format(rest, digest))
        open_end = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), F.lit("0"))
        check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(open_end), F.lit(10)), F.lit(10)).cast("string")
        return F.when(F.pmod(_luhn_sum(canon), F.lit(10)) == 0, F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), check)).otherwise(drawn)
    if kind == "iban":
        return F.concat(F.substring(canon, 1, 2), _same_format(F.substring(canon, F.lit(3), F.length(canon)), digest))
    if kind == "phone":
        return F.concat((F.pmod(_byte(digest, 63), F.lit(8)) + 2).cast("string"), _same_format(F.substring(canon, F.lit(2), F.length(canon)), digest))
    return _same_format(canon, digest)


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)


def candidate(key: str, attempt: int) -> Column:
    """The attempt-th surrogate of (kind, canon, gender)."""
    kind, canon = F.col("kind"), F.col("canon")
    digest = _keyed(key, kind, canon, F.lit(str(attempt)))
    domain = F.regexp_extract(canon, r"@(.*)\z", 1)
    host, tld = F.regexp_extract(domain, r"\A(.*)\.[^.]*\z", 1), F.regexp_extract(domain, r"(\.[^.]*)\z", 1)
    email = F.concat(_same_format(F.regexp_extract(canon, r"\A(.*)@", 1), digest), F.lit("@"), _same_format(host, _keyed(key, F.lit("domain"), domain)), tld)
    issuer = F.regexp_extract(canon, rf"\A({_TOKEN_HEAD}?)", 1)
    octets = F.concat_ws(".", *[(F.pmod(_byte(digest, i), F.lit(254)) + 1).cast("string") for i in range(4)])
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def name(part: str) -> Column:
        made = F.lit(None).cast("string")
        for (s, p, g), ends in ENDINGS.items():
            if p == part:
                body = F.concat(*[_pick(SYLLABLES[s], _byte(digest, i)) for i in range((2 if part == "given" else 3) + min(attempt, 8))])
                made = F.when((script == s) & (F.col("gender") == g), F.concat(body, _pick(ends, _byte(digest, 40)))).otherwise(made)
        return made

    drawn = (
        F.when(kind == "email", email)
        .when(kind == "ip", F.when(canon.contains(":"), _same_format(canon, digest)).otherwise(octets))
        .when(kind == "secret", F.concat(issuer, _same_format(F.substring(canon, F.length(issuer) + 1, F.length(canon)), digest)))
        .when(kind == "given", name("given"))
        .when(kind == "family", name("family"))
    )
    for number in _DIGITS_ONLY:
        drawn = F.when(kind == number, _number(number, canon, digest)).otherwise(drawn)
    if attempt > 3:  # the format has too few members: longer ones follow
        longer = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(attempt - 3)), lambda i: F.pmod(_byte(digest, i + 41), F.lit(10)).cast("string")), "")
        drawn = F.when(kind == "email", F.concat(longer, drawn)).when(kind.isin("given", "family", "ip"), drawn).otherwise(F.concat(drawn, longer))
        drawn = F.when((kind == "ip") & ~canon.contains(":"), F.concat(octets, F.lit(":"), longer)).otherwise(drawn)
    return drawn


def _assigned(entities: DataFrame, key: str, work: Workspace, name: str) -> DataFrame:
    """kind, canon, surrogate: rounds over the distinct entities until none collides."""
    real = entities.select("kind", F.col("canon").alias("surrogate"))
    open_, taken = entities, None
    for attempt in range(MAX_ROUNDS):
        drawn = work.stage(open_.withColumn("surrogate", candidate(key, attempt)), f"{name}-drawn{attempt}")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        won = first.join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            won = won.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = work.stage(won.select("kind", "canon", "surrogate"), f"{name}-won{attempt}")
        taken = won if taken is None else taken.unionByName(won)
        open_ = drawn.drop("surrogate").join(won.select("kind", "canon"), ["kind", "canon"], "left_anti")
        if open_.isEmpty():
            return taken
    raise RuntimeError(f"{MAX_ROUNDS} rounds left entities without a surrogate")


def surrogates(occurrences: DataFrame, key: str, work: Workspace) -> DataFrame:
    """kind, canon, surrogate of all entities among the occurrences (kind, canon, gender). A name of both genders takes a neutral surrogate."""
    of = lambda g: F.max(F.col("gender") == g)
    gender = F.when(of("f") & of("m"), "n").when(of("f"), "f").when(of("m"), "m").otherwise("n")
    entities = work.stage(occurrences.groupBy("kind", "canon").agg(gender.alias("gender")), "entities")
    return work.stage(_assigned(entities, key, work, "basic"), "surrogates")


def _linked(seen: DataFrame) -> DataFrame:
    """Occurrences of entities: those found, and the bare words that a name of the same text has (as a family name, if as both)."""
    words = seen.where(F.col("kind").isin("given", "family")).groupBy("id", "hash", "canon").agg(F.min("kind").alias("kind"))
    bare = seen.where(F.col("kind") == BARE).drop("kind").alias("b").join(words.alias("w"), F.expr("b.id <=> w.id and b.hash = w.hash and b.canon = w.canon"))
    return seen.where(~F.col("kind").isin(NONE, BARE)).unionByName(bare.select("b.id", "b.hash", "b.at", "w.kind", "b.canon", "b.gender"))


# --- rewriting ---------------------------------------------------------------


def _rendered(item: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the format of this mention."""
    value, canon = item["value"], item["canon"]
    shouted = (value == F.upper(value)) & (value != F.lower(value))
    name = F.array_join(F.transform(F.split(surrogate, "-"), F.initcap), "-")
    kept = F.length(F.regexp_replace(value, r"[^0-9A-Za-z]", "")) - F.length(canon)  # a country code before the number
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def place(acc: Column, c: Column) -> Column:
        counts = c.rlike("[0-9A-Za-z]")
        new = F.when(~counts | (acc["n"] < kept), c).otherwise(F.substring(surrogate, acc["n"] - kept + 1, F.lit(1)))
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["n"] + counts.cast("int")).alias("n"))

    placed = F.concat(F.aggregate(_chars(value), start, place, lambda a: a["out"]), F.substring(surrogate, F.length(canon) + 1, F.length(surrogate)))
    secret = F.concat(F.regexp_extract(value, rf"\A({_SECRET_HEAD}?)", 1), surrogate)
    plain = F.when(shouted, F.upper(surrogate)).otherwise(surrogate)
    return (
        F.when(surrogate.isNull(), value).when(kind.isin("given", "family"), name).when(kind.isin(*_DIGITS_ONLY), placed).when(kind == "secret", secret).otherwise(plain)
    )


def surrogate_key(spark: SparkSession) -> str:
    """The session's ``framelake.pii.key``; where it names none, a random key that lasts as long as the session."""
    key = spark.conf.get("framelake.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("framelake.pii.key", key)
    return key


def with_surrogates(spark: SparkSession, docs: DataFrame, key: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with surrogates in ``text``, and n_entities.

    Surrogates follow from ``key``, a secret of the caller's: who has it can
    test guesses of what was replaced. Rows without an entity, null and empty
    texts among them, pass unchanged and unshuffled. Texts are searched once: a
    written table holds each text, or its cuts and entities. Occurrences (no
    texts) meet the surrogates by entity; both sides are plain exchanges, so an
    entity in a third of all texts is split. Only texts with entities are dealt,
    by id and text hash: null ids and repeated rows (whose surrogates are equal)
    are as good as any. The time is linear in a text's length, whatever it
    holds. A column n_entities of the input is replaced.
    """
    if not key:
        raise ValueError("surrogates need a key")
    work = Workspace(spark, "pii")
    names = [c for c in docs.columns if c != "n_entities"]
    searched = with_items(docs.drop("n_entities").withColumn("__pii_hash", F.xxhash64(text)), text)
    found = work.stage(searched.withColumn(text, F.when(F.col("__pii_items").isNull(), F.col(text))), "found")  # no text and its cuts both
    some = found.where("__pii_items is not null")
    items = some.select(F.col(id_column).alias("id"), F.col("__pii_hash").alias("hash"), F.posexplode(F.transform("__pii_items", lambda x: F.struct(x["kind"], x["canon"], x["gender"]))).alias("at", "e"))
    seen = _linked(work.stage(items.select("id", "hash", "at", "e.kind", "e.canon", "e.gender"), "seen"))
    mapped = seen.join(surrogates(seen, key, work), ["kind", "canon"])
    lists = mapped.groupBy("id", "hash").agg(F.array_sort(F.collect_set(F.struct("at", "kind", "surrogate"))).alias("__pii_new"))
    joined = some.join(lists.withColumnsRenamed({"id": "__pii_id", "hash": "__pii_list"}), F.col(id_column).eqNullSafe(F.col("__pii_id")) & (F.col("__pii_hash") == F.col("__pii_list")), "left")
    # the list has the places that change; those between are laid beside it
    last = F.size("__pii_items")
    places = F.transform("__pii_new", lambda n: n["at"])
    begins, ends = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1)), F.concat(places, F.array(last))
    kept = lambda a, b: F.array_join(F.transform(F.slice("__pii_items", a + 1, F.greatest(b - a, F.lit(0))), lambda x: F.concat(x["pre"], x["value"], x["post"])), "")
    between = F.zip_with(begins, ends, kept)
    changed = F.transform("__pii_new", lambda n: F.transform(F.array(F.get("__pii_items", n["at"])), lambda x: F.concat(x["pre"], _rendered(x, n["kind"], n["surrogate"]), x["post"]))[0])
    whole = F.concat(F.array_join(F.zip_with(between, F.concat(changed, F.array(F.lit(""))), lambda k, c: F.concat(k, c)), ""), F.col("__pii_tail"))
    alone = F.concat(F.array_join(F.transform("__pii_items", lambda x: F.concat(x["pre"], x["value"], x["post"])), ""), F.col("__pii_tail"))
    counted = F.coalesce(F.size(F.filter("__pii_new", lambda n: F.get("__pii_items", n["at"])["first"])), F.lit(0))
    rebuilt = joined.withColumn("n_entities", F.when(F.col("__pii_new").isNull(), 0).otherwise(counted)).withColumn(text, F.when(F.col("__pii_new").isNull(), alone).otherwise(whole))
    same = found.where("__pii_items is null").withColumn("n_entities", F.lit(0))
    return rebuilt.select(*names, "n_entities").unionByName(same.select(*names, "n_entities"))
