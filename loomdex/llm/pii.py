"""Surrogate generation for personal data, in DataFrame functions only.

Entities are found by one pattern: e-mail addresses, IPv4 addresses, telephone and card numbers, social security numbers,
IBANs, access keys, credentials after a name such as password or token, and persons after a title or with a listed given
name. Card numbers need an issuer's first digits and a right check digit. Each consists of parts (local part and domain; given name and surname) with a canonical form, and each distinct
part of the whole table gets one surrogate, derived from a keyed hash and of the same kind: the same length, case,
separators and alphabet, a valid check digit where the original has one, a given name of the same gender and script. Those come
from lists that share no name with the ones that persons are found by; when a list has no free name left, names are built of
syllables with endings of that gender. So what refers to one thing before does so afterwards, in every spelling and document.
Surrogates that fall together with each other or with an original are found by grouping and drawn again until none is left, so
different things stay different; more than the stated number of rounds is an error. What is settled is not drawn again.

The key is the caller's: whoever knows it can recompute surrogates of what he guesses. Texts without entities do not take part in any shuffle and stay as they are. Null and empty texts stay as they are. Texts are
matched by digest, so repeated rows get equal results. Columns of the input are carried along; helper columns have names
that start with ``__pii_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.shared import cut

#: Session setting that holds the key of registered queries; production sets its own secret.
KEY_SETTING = "spark.loomdex.pii.key"
TITLES_M = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "Госпожа", "Κυρία")
TITLES_U = ("Dr", "Prof", "Доктор")
LATIN_M = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Mark", "Steven", "Paul", "Andrew", "Joshua", "Kenneth", "Kevin", "Brian", "George", "Edward", "Peter", "Pierre", "Jean", "Hans", "Klaus", "Carlos", "Miguel", "José", "Juan")
LATIN_F = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Margaret", "Lisa", "Betty", "Sandra", "Ashley", "Emily", "Donna", "Michelle", "Laura", "Anna", "Helen", "Ruth", "Julia", "Marie", "Claire", "Greta", "Ingrid", "Carmen", "Lucía", "Ana", "Isabel")
CYRILLIC_M = ("Иван", "Алексей", "Дмитрий", "Сергей", "Андрей", "Николай", "Павел", "Олег", "Михаил", "Владимир")
CYRILLIC_F = ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана", "Юлия", "Вера")
GREEK_M = ("Γιώργος", "Δημήτρης", "Νίκος", "Κώστας", "Γιάννης", "Παύλος")
GREEK_F = ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Ειρήνη")
#: Given names that surrogates are drawn from first; none is in the lists above.
OTHER_LATIN_M = ("Alden", "Bastian", "Cedric", "Dorian", "Emil", "Fabian", "Gideon", "Hector", "Ivo", "Jasper", "Kilian", "Lorenz", "Magnus", "Nils", "Oskar", "Quentin", "Rufus", "Silas", "Tobias", "Ulrich", "Valentin", "Wendel", "Xaver", "Yannick")
OTHER_LATIN_F = ("Adela", "Beatrix", "Cordelia", "Daphne", "Edith", "Flora", "Gisela", "Hedwig", "Ilse", "Jolanda", "Katja", "Leonie", "Mathilda", "Nadine", "Odette", "Petra", "Ramona", "Selma", "Thea", "Ursula", "Viola", "Wilma", "Xenia", "Yvette")
OTHER_CYRILLIC_M = ("Борис", "Виктор", "Глеб", "Егор", "Захар", "Игнат", "Кирилл", "Лев", "Максим", "Роман")
OTHER_CYRILLIC_F = ("Алла", "Валерия", "Галина", "Дарья", "Злата", "Зоя", "Кира", "Лариса", "Нина", "Раиса")
OTHER_GREEK_M = ("Ανδρέας", "Βασίλης", "Ηλίας", "Θωμάς", "Λουκάς", "Στέφανος")
OTHER_GREEK_F = ("Αγγελική", "Βασιλική", "Ζωή", "Θεοδώρα", "Ιωάννα", "Χριστίνα")
#: Onsets and vowels that surnames are made of, by script.
SYLLABLES = {"latin": ("bdfghjklmnprstvwz", "aeiou"), "cyrillic": ("бвгдзклмнпрстфх", "аеиоу"), "greek": ("βγδζκλμνπρστφχ", "αειου")}

_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_PHONE = r"(?<![\d+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)"
#: First four digits that issuers use for numbers of 16 digits.
_ISSUER = r"(?:4\d{3}|5[1-5]\d{2}|2(?:22[1-9]|2[3-9]\d|[3-6]\d{2}|7[01]\d|720)|35(?:2[89]|[3-8]\d)|6(?:011|4[4-9]\d|5\d{2}))"
_CARD = rf"(?<![\d.-])(?:{_ISSUER}(?:\d{{12}}| \d{{4}} \d{{4}} \d{{4}}|-\d{{4}}-\d{{4}}-\d{{4}})|3[47]\d{{13}})(?![\d-])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_AWS = r"(?<![\p{L}\p{N}])A[KS]IA[0-9A-Z]{16}(?![\p{L}\p{N}])"
_NAMED = r"(?i:(?<![\p{L}\p{N}])(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\x22']?)"
#: All of the value, of any length and with dots inside, as far as eight characters without a dot stand together somewhere.
_SECRET = _NAMED + r"(?=[A-Za-z0-9_+/=.-]*[A-Za-z0-9_+/=-]{8})[A-Za-z0-9_+/=-][A-Za-z0-9_+/=.-]*(?<!\.)"
_GIVEN_ALL = (*LATIN_M, *LATIN_F, *CYRILLIC_M, *CYRILLIC_F, *GREEK_M, *GREEK_F)
_TITLE = r"(?:" + "|".join((*TITLES_M, *TITLES_F, *TITLES_U)) + r")\.? "
_WORD = r"\p{Lu}[\p{L}’'-]{1,30}"


def _persons(first: str, alphabet: str) -> str:
    """Title and one or two words, or listed given name and a word. Its first letter is looked at first, by a class that is one range of
    characters: that rules out nearly every place at little cost."""
    mine = lambda names: "|".join(n for n in names if (n[0] < "\x7f") == (alphabet == "latin"))
    title = rf"(?:{mine((*TITLES_M, *TITLES_F, *TITLES_U))})\.? "
    return rf"(?={first})(?<![\p{{L}}\p{{N}}])(?:{title}{_WORD}(?: {_WORD})?|(?:{mine(_GIVEN_ALL)}) {_WORD})(?![\p{{L}}\p{{N}}])"


_LATIN, _OTHER = _persons("[A-Z]", "latin"), _persons(r"[\x{370}-\x{4FF}]", "other")
_PERSON = f"{_LATIN}|{_OTHER}"
PATTERN = "|".join((_EMAIL, _SECRET, _AWS, _IBAN, _IP, _CARD, _SSN, _PHONE, _PERSON))


def hint(text: Column) -> Column:
    """No entity without one of these; most texts have none, and the long pattern does not run on them."""
    return text.rlike("[0-9@=:]") | text.rlike(_LATIN) | text.rlike(_OTHER)


def find(text: Column) -> Column:
    """All entities in order."""
    return F.when(hint(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _is(raw: Column, pattern: str) -> Column:
    return raw.rlike(f"^(?:{pattern})$")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _part(kind: Column | str, norm: Column, shown: Column, lead: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(kind).alias("kind"), norm.alias("norm"), shown.alias("shown"), as_column(lead).alias("lead"))


def parts(raw: Column) -> Column:
    """Parts of an entity, in order: kind, canonical form, how it is written, and what stands before it."""
    digits = F.regexp_replace(raw, r"\D", "")
    at = F.instr(raw, "@")
    local, domain = F.substring(raw, F.lit(1), at - 1), F.substring(raw, at + 1, F.length(raw))
    email = F.array(_part("email", F.lower(raw), local, ""), _part("domain", F.lower(domain), domain, "@"))
    lead = F.regexp_extract(raw, f"^{_NAMED}", 0)
    value = F.substring(raw, F.length(lead) + 1, F.length(raw))
    title = F.regexp_extract(raw, f"^{_TITLE}", 0)
    words = F.split(F.substring(raw, F.length(title) + 1, F.length(raw)), " ")
    bare, first, last = F.regexp_replace(title, r"[. ]+$", ""), F.element_at(words, 1), F.element_at(words, -1)
    gender = F.when(first.isin(*LATIN_M, *CYRILLIC_M, *GREEK_M) | bare.isin(*TITLES_M), "m").when(first.isin(*LATIN_F, *CYRILLIC_F, *GREEK_F) | bare.isin(*TITLES_F), "f").otherwise("u")
    sex = F.when(_script(last) == "cyrillic", gender).otherwise("")
    surname = lambda before: _part(F.concat(F.lit("surname_"), _script(last), sex), F.lower(last), last, before)
    given = _part(F.concat(F.lit("given_"), _script(first), gender), F.lower(first), first, title)
    person = F.when(F.size(words) > 1, F.array(given, surname(" "))).otherwise(F.array(surname(title)))
    one = lambda kind, norm, shown=raw, before="": F.array(_part(kind, norm, shown, before))
    return (
        F.when(raw.contains("@") & _is(raw, _EMAIL), email)
        .when(_is(raw, _SECRET), one("secret", value, value, lead))
        .when(_is(raw, _AWS), one("access_key", raw))
        .when(_is(raw, _IBAN), one("iban", F.regexp_replace(raw, " ", "")))
        .when(_is(raw, _IP), one("ip", raw))
        .when(_is(raw, _CARD), one("card", digits))
        .when(_is(raw, _SSN), one("ssn", digits))
        .when(_is(raw, _PHONE), one("phone", F.when(raw.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(F.concat(F.lit("+1"), digits))))
        .otherwise(person)
    )


def _pick(alphabet: str, byte: Column) -> Column:
    return F.substring(F.lit(alphabet), (byte % len(alphabet) + 1).cast("int"), F.lit(1))


#: Bytes of the keyed hash that a surrogate is drawn from, at least; longer parts have a byte for each character.
BYTES = 192


def noise_of(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """array<int> of keyed bytes, 64 by each hash. It is to be a column: surrogate() reads it in very many places."""
    seed = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    # of a long seed the digest stands for it, so that each block costs the same
    seed = F.when(F.length(norm) > BYTES, F.sha2(seed, 512)).otherwise(seed)
    blocks = F.ceil(F.greatest(F.length(norm), F.lit(BYTES)) / 64).cast("int")
    digits = F.transform(F.sequence(F.lit(0), blocks - 1), lambda n: F.sha2(F.concat(seed, F.lit("|"), n.cast("string")), 512))
    return F.flatten(F.transform(digits, lambda d: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(d, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))))


def _each(norm: Column, noise: Column, start: int, change) -> Column:
    """norm with every character changed by change(character, its byte)."""
    out = F.transform(F.split(norm, ""), lambda c, i: change(c, F.get(noise, i + start)))
    return F.when(norm == "", norm).otherwise(F.array_join(out, ""))


def _alike(c: Column, byte: Column) -> Column:
    return (
        F.when(c.rlike("[0-9]"), _pick("0123456789", byte))
        .when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцчшщэюя", byte))
        .when(c.rlike(r"\p{IsGreek}"), _pick("αβγδεζηθικλμνξοπρστυφχψω", byte))
        .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", byte))
        .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", byte))
        .otherwise(c)
    )


def luhn(digits: Column) -> Column:
    """Sum of the Luhn rule modulo 10, for digits with their check digit."""
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + (c.cast("int") >= 5).cast("int")))
    return F.aggregate(backwards, F.lit(0), lambda a, x: a + x) % 10


def iban_check(country: Column, rest: Column) -> Column:
    """Check digits of an IBAN, by the remainder modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    left = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97))
    return F.lpad((98 - left).cast("string"), 2, "0")


def surrogate(kind: Column, norm: Column, attempt: Column, noise: Column) -> Column:
    """Canonical form of the surrogate that a part gets at this attempt. noise: noise_of() them."""
    byte = lambda i: F.get(noise, F.lit(i))
    alike = lambda text, start=0: _each(text, noise, start, _alike)
    digits = lambda text, start=0: _each(text, noise, start, lambda c, b: _pick("0123456789", b))
    # short words have few of their kind: from the third attempt on they get longer
    more = F.least(F.lit(12), attempt + 1)
    longer = F.when(attempt >= 2, F.array_join(F.transform(F.slice(noise, F.lit(100), more), lambda b: (b % 10).cast("string")), "")).otherwise("")
    before = F.when(kind == "email", F.substring_index(norm, "@", 1)).otherwise(F.substring_index(norm, ".", 1))
    label = F.concat(alike(before), longer)
    ending = F.element_at(F.array(*[F.lit(x) for x in (".example.com", ".example.net", ".example.org")]), byte(60) % 3 + 1)
    address = F.when(kind == "email", label).otherwise(F.concat(label, ending))
    ip = F.concat_ws(".", (byte(0) % 223 + 1).cast("string"), *[byte(n).cast("string") for n in (1, 2)], (byte(3) % 254 + 1).cast("string"))
    body = F.concat(F.substring(norm, 1, 1), digits(F.substring(norm, F.lit(2), F.length(norm) - 2)))
    last = F.when(luhn(norm) == 0, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string")).otherwise(_pick("0123456789", byte(70)))
    card = F.concat(body, last)
    ssn = F.concat((byte(0) % 8 + 1).cast("string"), digits(F.substring(norm, F.lit(2), F.length(norm)), 1))
    # + and country code stay; the first digit after it is no 0 or 1
    code = F.when(norm.startswith("+1"), "+1").otherwise(F.substring(norm, 1, 3))
    number = F.substring(norm, F.length(code) + 1, F.length(norm))
    phone = F.concat(code, F.when(number != "", _pick("23456789", byte(80))).otherwise(""), digits(F.substring(number, F.lit(2), F.length(number))))
    country, rest = F.substring(norm, 1, 2), alike(F.substring(norm, F.lit(5), F.length(norm)))
    iban = F.concat(country, iban_check(country, rest), rest)
    hexadecimal = _each(norm, noise, 0, lambda c, b: _pick("0123456789abcdef", b))
    secret = F.when(norm.rlike("^[0-9a-f]+$"), hexadecimal).otherwise(alike(norm))
    access = F.concat(F.substring(norm, 1, 4), _each(F.substring(norm, F.lit(5), F.length(norm)), noise, 0, lambda c, b: _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", b)))
    out = F.when(kind.isin("email", "domain"), address).when(kind == "ip", ip).when(kind == "card", card).when(kind == "ssn", ssn)
    out = out.when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "secret", secret).when(kind == "access_key", access)
    return out.otherwise(_name(kind, attempt, noise))


def _name(kind: Column, attempt: Column, noise: Column) -> Column:
    """A given name of the kind's gender and script, from the lists at first and then of syllables, or a surname of syllables."""
    byte = lambda i: F.get(noise, F.lit(i))
    tail = {"latin": ("n", "n", "n"), "cyrillic": ("ов", "ова", "ко"), "greek": ("ς", "ς", "ς")}
    names = {"latin": (OTHER_LATIN_M, OTHER_LATIN_F), "cyrillic": (OTHER_CYRILLIC_M, OTHER_CYRILLIC_F), "greek": (OTHER_GREEK_M, OTHER_GREEK_F)}
    endings = {"latin": (("n", "r", "s", "l"), ("na", "la", "ra", "lia")), "cyrillic": (("н", "р", "й", "л"), ("на", "ла", "ия", "ра")), "greek": (("νος", "ρης", "λας", "τος"), ("να", "ρια", "λη", "τη"))}
    out = F.lit(None).cast("string")
    for script, (m, f) in names.items():
        onset, vowel = SYLLABLES[script]

        def syllables(start: int, count: int = 6, onset: str = onset, vowel: str = vowel) -> Column:
            pairs = F.slice(noise, F.lit(start), F.lit(count))
            return F.array_join(F.transform(pairs, lambda b, i: F.when(i % 2 == 0, _pick(onset, b)).otherwise(_pick(vowel, b))), "")

        more = F.when(attempt >= 1, syllables(20)).otherwise("")
        gender = F.when(kind.endswith("m"), 0).when(kind.endswith("f"), 1).otherwise(byte(41) % 2)
        one = lambda values: F.element_at(F.array(*map(F.lit, values)), byte(0) % len(values) + 1)
        listed = F.lower(F.when(gender == 0, one(m)).otherwise(one(f)))
        built = F.concat(syllables(20, 4), F.when(attempt >= 3, syllables(30)).otherwise(""), F.when(gender == 0, one(endings[script][0])).otherwise(one(endings[script][1])))
        end = F.when(kind.endswith(f"{script}m"), tail[script][0]).when(kind.endswith(f"{script}f"), tail[script][1]).otherwise(tail[script][2])
        given = F.when(attempt == 0, listed).otherwise(built)
        out = F.when(kind.startswith(f"given_{script}"), given).when(kind.startswith(f"surname_{script}"), F.concat(syllables(3), more, end)).otherwise(out)
    return out


def written(kind: Column, shown: Column, canonical: Column) -> Column:
    """The surrogate in the original's way of writing: separators of numbers, and case of words."""
    filled = F.aggregate(
        F.split(shown, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(c.rlike(r"[0-9A-Z]"), F.struct(F.concat(a["out"], F.substring(canonical, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: a["out"],
    )
    spaced = F.aggregate(
        F.split(shown, ""),
        F.struct(F.lit("").alias("out"), (F.when(shown.startswith("+"), 2).otherwise(3)).alias("at")),
        lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substring(canonical, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: a["out"],
    )
    cased = F.when((F.upper(shown) == shown) & (F.lower(shown) != shown), F.upper(canonical)).when(F.substring(shown, 1, 1) != F.lower(F.substring(shown, 1, 1)), F.concat(F.upper(F.substring(canonical, 1, 1)), F.substring(canonical, F.lit(2), F.length(canonical)))).otherwise(canonical)
    return F.when(kind == "phone", spaced).when(kind.isin("card", "ssn", "iban"), filled).when(kind.isin("secret", "access_key", "ip"), canonical).otherwise(cased)


def assign(things: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """(kind, norm, canonical) for distinct (kind, norm): within a family of kinds, no two are the same and none is an original."""
    canon = F.when(F.col("kind") == "email", F.substring_index("norm", "@", 1)).otherwise(F.col("norm"))
    family = F.regexp_extract("kind", "^[a-z]+(?:_key)?", 0)
    base = cut(things.select("kind", "norm", family.alias("family"), canon.alias("canon")).distinct())
    taken = base.select("family", F.col("canon").alias("canonical")).distinct()
    # a number of its own: parts are short, but drawing for them is work that AQE must not put into one task
    tasks = int(things.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo, held = base.select("kind", "norm", "family"), None
    for n in range(rounds):
        attempt = F.lit(n)
        noisy = todo.repartition(tasks, "kind", "norm").withColumn("noise", noise_of(F.col("kind"), F.col("norm"), attempt, key))
        drawn = cut(noisy.withColumn("canonical", surrogate(F.col("kind"), F.col("norm"), attempt, F.col("noise"))).drop("noise"))
        # of those that coincide the first stays
        best = drawn.groupBy("family", "canonical").agg(F.min(F.struct("kind", "norm")).alias("best")).join(taken, ["family", "canonical"], "left_anti")
        best = best if held is None else best.join(held.select("family", "canonical"), ["family", "canonical"], "left_anti")
        won = cut(best.select("best.kind", "best.norm", "family", "canonical"))
        held = won if held is None else held.union(won)
        todo = drawn.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm", "family")
        if todo.isEmpty():
            return held.select("kind", "norm", "canonical")
    raise RuntimeError("surrogates still coincide: there are too few of some format")


def fine(raw: Column) -> Column:
    """Whether what matches the pattern is an entity: card numbers need a right check digit."""
    return ~_is(raw, _CARD) | (luhn(F.regexp_replace(raw, r"\D", "")) == 0)


def replacements(raws: DataFrame, key: str) -> DataFrame:
    """(raw, replacement) for distinct raw that are entities."""
    split = cut(raws.where(fine(F.col("raw"))).select("raw", F.posexplode(parts(F.col("raw"))).alias("at", "part")).select("raw", "at", "part.*"))
    known = assign(split.select("kind", "norm"), key)
    made = split.join(known, ["kind", "norm"]).select("raw", "at", F.concat("lead", written(F.col("kind"), F.col("shown"), F.col("canonical"))).alias("new"))
    return made.groupBy("raw").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]), "").alias("replacement"))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with surrogates in text_col, and __pii_count, the number of entities replaced."""
    text = F.col(text_col)
    # has: matching stops at the first entity; all are extracted from texts that hold one only, and once
    has = F.coalesce(hint(text) & text.rlike(PATTERN), F.lit(False))
    some = cut(docs.where(has).withColumns({"__pii_found": F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), "__pii_text": F.sha2(text.cast("binary"), 256)}))
    each = cut(some.select("__pii_text", "__pii_found").dropDuplicates(["__pii_text"]).select("__pii_text", F.posexplode("__pii_found").alias("at", "raw")))
    # cut: with an exchange of its own on either side, AQE may split an entity that is in very many texts
    new = cut(replacements(each.select("raw").distinct(), key))
    named = each.join(new, "raw", "left").select("__pii_text", "at", F.coalesce("replacement", "raw").alias("new"), "replacement")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"])
    lists = named.groupBy("__pii_text").agg(in_order.alias("__pii_new"), F.count("replacement").alias("__pii_count"))
    joined = some.join(lists, "__pii_text")
    # regexp_extract_all and split see the same matches, so between any two pieces stands one entity
    pieces = F.split(text, PATTERN, -1)
    filled = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("__pii_new"), i), F.lit("")))), "")
    done = joined.withColumn(text_col, filled).select(*docs.columns, "__pii_count")
    return docs.where(~has).select(*docs.columns, F.lit(0).cast("long").alias("__pii_count")).unionByName(done)


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs, rows and columns as they are, with surrogates in text and n_chars, if it is there, to match."""
    out = pseudonymise(docs, key)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("__pii_count") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def session_key(spark: SparkSession) -> str:
    """The secret in KEY_SETTING; where it is unset, a public one, which protects nobody: for tests and test tables."""
    return spark.conf.get(KEY_SETTING, "public")
