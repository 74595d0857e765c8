"""Surrogate generation for personal data, with DataFrame functions only.

Detected entities get keyed replacements of the same kind, format, script and, for names, gender. A value is
known by its normal form (names and addresses without case, numbers without punctuation), so one entity has one
surrogate however it is written, and each mention is written in the format of the original. A person's words
also change where they stand without a title in the same text. A collision check over all values keeps
different values different and away from any value that really occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import dropped, written

MALE_TITLES = "Mr|Herr|Hr|Señor|Sr|Don|Monsieur|Господин|господин|Κύριος|κύριος"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Fr|Señora|Sra|Señorita|Srta|Doña|Madame|Mme|Mademoiselle|Mlle|Госпожа|госпожа|Κυρία|κυρία"
NEUTRAL_TITLES = "Mx|Dr|Prof|Professor|Доктор|доктор"
#: A word of a name, with parts behind hyphens or apostrophes. Repeats are bounded, so that no text is too deep for it.
NAME_WORD = r"\p{Lu}(?:\p{L}+|['’]\p{Lu}\p{L}+)(?:['’\-]\p{Lu}\p{L}+){0,3}"
_HEX4 = "[0-9A-Fa-f]{1,4}"
#: Kinds with the pattern of a whole value, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "ipv4": r"(?<![\w.])(?<!(?i:version|release|ver\.|v\.)\s{0,2})(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "mac": r"(?<![\w:\-])(?:(?:[0-9A-Fa-f]{2}:){5}|(?=[A-Fa-f\-]*\d)(?:[0-9A-Fa-f]{2}-){5})[0-9A-Fa-f]{2}(?![:\-]?\w)",
    "ipv6": rf"(?<![\w:.])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?=[A-Fa-f:]*\d)(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}})(?![:.]?\w)",
    "card": r"\b(?:4\d{3}|5[1-5]\d{2}|2[2-7]\d{2}|6011|65\d{2})([ \-]?)\d{4}\1\d{4}\1\d{4}\b|\b3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}\b|\b4\d{12}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w\-])\d{3}-\d{3}-\d{4}(?![\w\-])",
    "name": rf"(?<![\p{{L}}])(?:{MALE_TITLES}|{FEMALE_TITLES}|{NEUTRAL_TITLES})\.? {NAME_WORD}(?: {NAME_WORD})?",
    "secret": r"(?<=(?:[pP]assword|passwd|pwd|[tT]oken|[sS]ecret|api_key|apikey|API_KEY)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_\-+/.]{8,}",
}
_TITLE_STARTS = "".join(sorted({t[0] for t in f"{MALE_TITLES}|{FEMALE_TITLES}|{NEUTRAL_TITLES}".split("|")}))
#: Cheap tests that come before a pattern in ANY: what stands before and at a value's first character.
_GUARDS = {"secret": r"(?<=[=:\s\"'])(?<=[=:][\"']?|[=:]\s[\"']?|[=:]\s\s[\"']?)", "name": rf"(?=[{_TITLE_STARTS}])", "aws_key": "(?=A)", "iban": r"(?=[A-Z]{2}\d)", "ipv4": r"(?=\d{1,3}\.\d)", "mac": r"(?=[0-9A-Fa-f]{2}[:\-][0-9A-Fa-f]{2}[:\-])", "ipv6": rf"(?={_HEX4}:[0-9A-Fa-f:])", "card": r"(?=[2-6]\d{3})", "ssn": r"(?=\d{3}-)", "phone": r"(?=[+(\d])", "email": r"(?=[A-Za-z0-9._%+\-])"}
ANY = "|".join(f"(?:{_GUARDS[k]}{p})" for k, p in PATTERNS.items()).replace(r"([ \-]?)\d{4}\1\d{4}\1", r"(?:(?:\d{4}){2}|(?: \d{4}){2} |(?:-\d{4}){2}-)")
#: What any value holds, to pass over other texts: a digit, a mark or a key's first letters, or a title before a
#: capital letter.
HINTS = ("[0-9@=:]|AKIA|ASIA", rf" (?=\p{{Lu}})(?<=(?:{MALE_TITLES}|{FEMALE_TITLES}|{NEUTRAL_TITLES})\.? )")
#: Given names by gender and script (public common names).
GIVEN = {
    ("m", "latin"): "Adam Albert Bruno Carl David Edgar Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oskar Paul Robert Simon Thomas Victor Walter Anton Emil",
    ("f", "latin"): "Anna Berta Clara Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Teresa Ursula Vera Wanda Alice Emma",
    ("n", "latin"): "Alex Andrea Robin Kim Sasha Dominique Camille Jules Maxime Noa Sam Charlie Jamie Luca Mika Toni Pat Lee Chris Billie Frankie Jessie Kai Remy",
    ("m", "cyrillic"): "Антон Борис Виктор Георгий Денис Егор Иван Кирилл Максим Никита Олег Павел Роман Сергей Тимур Юрий",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Надежда Ольга Полина Раиса Юлия",
    ("n", "cyrillic"): "Саша Женя Валя Шура Слава Паша Тоня Сима",
    ("m", "greek"): "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Λευτέρης Μιχάλης Νίκος Πέτρος Σταύρος",
    ("f", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα",
    ("n", "greek"): "Άγις Χάρις Φώτις Θάλεια",
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi",
    "cyrillic": "ба ва га да жа за ка ла ма на ра са та бе ве ре не ми ли ни ро ко ло мо",
    "greek": "βα γα δα κα λα μα να πα ρα σα τα βε κε λε με νε ρε σε τε βι λι μι νι",
}
ENDINGS = {"latin": "son man ner berg ton ley sen well", "cyrillic": "енко ин ов ук", "greek": "ίδης άκης όπουλος έλης"}
#: Rounds of collision checks, each leaving a vanishing part to the next; what is left gets a longer form by hash.
ROUNDS = 24
#: Longest lengths that values of a kind keep; from this round on a drawn value grows by one character a round.
GROWS = 8
#: Calling codes after a plus sign (fixed values of the numbering plan): one digit, two digits, else three.
CALLING_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
NAMES = ("surname", "given")
#: Months that are names too (fixed values): without a title they stay.
CALENDAR = ("april", "may", "june", "july", "august", "mai", "juni", "abril", "marzo", "mayo")


def _lit_words(x: str) -> Column:
    return F.array(*(F.lit(w) for w in x.split()))


def _kind(hit: Column) -> Column:
    out = F.lit("secret")
    for k, p in reversed([x for x in PATTERNS.items() if x[0] != "secret"]):
        out = F.when(hit.rlike(f"^(?:{p})$"), F.lit(k)).otherwise(out)
    return out


def _bytes(seed: Column, n: Column) -> Column:
    """An array of n numbers below 256, drawn from a seed."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 32).cast("int")), lambda j: F.sha2(F.concat_ws("|", seed, j.cast("string")), 256))
    text = F.array_join(blocks, "")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def _pick(words: Column, number: Column) -> Column:
    return F.element_at(words, (F.pmod(number, F.size(words)) + 1).cast("int"))


def _alike(value: Column, seed: Column, fixed: Column) -> Column:
    """Each digit and ASCII letter after the first fixed characters replaced by one of its class; lower-case
    hexadecimal values stay hexadecimal."""
    chars = F.split(value, "")
    noise = _bytes(seed, F.greatest(F.size(chars), F.lit(1)))
    hexa = value.rlike("^[0-9a-f]+$")
    letter = lambda base, b, n: F.chr((F.lit(base) + F.pmod(b, n)).cast("int"))

    def one(c, i):
        b = F.element_at(noise, i + 1)
        return F.when(i < fixed, c).when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string")).when(c.rlike("[a-z]"), letter(97, b, F.when(hexa, F.lit(6)).otherwise(F.lit(26)))).when(c.rlike("[A-Z]"), letter(65, b, F.lit(26))).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _luhn(value: Column) -> Column:
    """The value with its last digit set so that the Luhn sum holds."""
    body = F.substring(value, F.lit(1), F.length(value) - 1)
    digits = F.reverse(F.split(F.regexp_replace(body, "[^0-9]", ""), ""))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int"))), F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))


def _check_digits(value: Column) -> Column:
    """The IBAN with check digits that hold: 98 less the remainder of the rest, then the country and 00, by 97."""
    moved = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 2), F.lit("00"))
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.coalesce(F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c), F.lit(97)).cast("int"), a))
    return F.concat(F.substring(value, 1, 2), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), F.substring(value, F.lit(5), F.length(value)))


def _long_ipv6(value: Column) -> Column:
    """An IPv6 address in lower case as eight groups without leading zeros."""
    halves = F.split(F.lower(value), "::")
    groups = lambda x: F.transform(F.split(x, ":"), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    left, right = groups(F.get(halves, 0)), groups(F.get(halves, 1))
    return F.array_join(F.when(F.size(halves) == 1, left).otherwise(F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)), ":")


def _normal(kind: Column, value: Column) -> Column:
    """What a value is known by, whatever its case and punctuation."""
    digits = F.regexp_replace(value, "[^0-9+]", "")
    return F.when(kind.isin("email", *NAMES), F.lower(value)).when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind == "mac", F.lower(F.regexp_replace(value, "[:\\-]", ""))).when(kind == "ipv6", _long_ipv6(value)).otherwise(value)


def _written(kind: Column, value: Column, new: Column) -> Column:
    """The surrogate of a normal form in the format of a value: separators at their places, names and addresses in its case."""
    upper = (value == F.upper(value)) & (F.length(value) > 1)
    plus = F.when(new.startswith("+"), 1).otherwise(0)  # the value's own plus sign is kept
    filled = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(acc["out"], F.substring(new, acc["at"] + plus, F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(new, acc["at"] + plus, F.length(new))),
    )
    return F.when(kind.isin(*NAMES), F.when(upper, F.upper(new)).when(value == F.lower(value), F.lower(new)).otherwise(new)).when((kind == "mac") & upper, F.upper(filled)).when(kind.isin("email", "ipv6") & upper, F.upper(new)).when(kind.isin("phone", "card", "ssn", "iban", "mac"), filled).otherwise(new)


def _surrogate(kind: Column, value: Column, gender: Column, key: str, attempt: int) -> Column:
    """The attempt's keyed surrogate of a normal form."""
    seed = F.concat_ws("|", F.lit(key), kind, value, F.lit(str(attempt)))
    noise = _bytes(seed, F.lit(24))
    at = lambda i: F.element_at(noise, i)
    number = lambda i: at(i) * 256 + at(i + 1)
    domain = F.substring_index(value, "@", -1)
    d = _bytes(F.concat_ws("|", F.lit(key), F.lit("domain"), F.lower(domain)), F.lit(10))
    letters = lambda a: F.array_join(F.transform(a, lambda b: F.chr((F.lit(97) + F.pmod(b, F.lit(26))).cast("int"))), "")
    local = F.substring_index(value, "@", 1)
    longer = F.lit("") if attempt < 3 else letters(F.slice(noise, 1, attempt))  # short values run out of room
    email = F.concat(_alike(local, seed, F.lit(0)), longer, F.lit("@"), letters(d), F.lit(".example"))
    grown = F.lit("") if attempt < GROWS else F.array_join(F.transform(F.slice(noise, 1, attempt - GROWS + 1), lambda b: F.pmod(b, F.lit(10)).cast("string")), "")
    reserved = (F.lit(240) + F.pmod(at(1), F.lit(15))) if attempt < 8 else F.lit(1) + F.pmod(at(1), F.lit(254))
    ip = F.concat_ws(".", reserved.cast("string"), *(at(i).cast("string") for i in range(2, 5 if attempt < 2 * GROWS else 6)))
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    by_script = lambda f: reduce(lambda out, s: F.when(script == s, f(s)).otherwise(out), ("cyrillic", "greek"), f("latin"))
    more = lambda s, n, first: F.concat(*(_pick(_lit_words(SYLLABLES[s]), number(first + 2 * i)) for i in range(n)))
    surname = by_script(lambda s: F.concat(F.initcap(more(s, 2 + attempt // 4, 3)), _pick(_lit_words(ENDINGS[s]), number(1))))
    extra = 0 if attempt < 2 else 1 + min(attempt // 4, 4)
    given = lambda g: by_script(lambda s: F.concat(_pick(_lit_words(GIVEN[g, s]), number(1)), more(s, extra, 3) if extra else F.lit("")))
    # a name's form: parts behind a hyphen get a second name, a letter before an apostrophe stays
    joint = F.regexp_extract(value, r"(?<=\p{L}{2})['’\-]", 0)
    second = F.when(kind == "surname", by_script(lambda s: F.concat(F.initcap(more(s, 2, 19)), _pick(_lit_words(ENDINGS[s]), number(23))))).otherwise(F.when(gender == "m", by_script(lambda s: _pick(_lit_words(GIVEN["m", s]), number(19)))).when(gender == "f", by_script(lambda s: _pick(_lit_words(GIVEN["f", s]), number(19)))).otherwise(by_script(lambda s: _pick(_lit_words(GIVEN["n", s]), number(19)))))
    formed = lambda x: F.concat(F.upper(F.regexp_extract(value, r"^\p{L}['’]", 0)), x, F.when(joint != "", F.concat(joint, second)).otherwise(""))
    hexes = F.transform(F.sequence(F.lit(1), F.lit(11), F.lit(2)), lambda i: F.lower(F.hex((F.element_at(noise, i) * 256 + F.element_at(noise, i + 1)).cast("long"))))
    prefix = F.length(F.regexp_extract(value, CALLING_CODE, 0))
    out = F.concat(_alike(value, seed, F.when(kind == "aws_key", 4).when(kind == "iban", 2).when(kind == "phone", prefix).otherwise(0)), grown)
    out = F.when(kind == "card", _luhn(F.concat(_alike(value, seed, F.lit(1)), grown))).when(kind == "ssn", F.concat(F.lit("9"), F.substring(_alike(value, seed, F.lit(0)), 2, 20), grown)).otherwise(out)
    out = F.when(kind == "iban", _check_digits(out)).when(kind == "mac", F.concat(F.lit("02"), F.substring(_alike(value, seed, F.lit(0)), 3, 10))).when(kind == "ipv6", F.concat(F.lit("2001:db8:"), F.array_join(hexes, ":"))).otherwise(out)
    out = F.when(kind == "email", email).when(kind == "ipv4", ip).otherwise(out)
    return F.when(kind == "surname", formed(surname)).when(kind == "given", formed(F.when(gender == "m", given("m")).when(gender == "f", given("f")).otherwise(given("n")))).otherwise(out)


def surrogate_table(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct normal forms (kind, value, gender): one surrogate each, no two alike
    and none equal to an occurring value, within a kind; all words of names count as one kind. A value keeps its
    first draw unless a smaller value drew the same or the draw occurs; formats that run out of room get longer."""
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kin = F.when(F.col("kind").isin(*NAMES), "name").otherwise(F.col("kind")).alias("kin")
    plain = lambda c: F.when(F.col("kin") == "name", F.lower(c)).otherwise(F.col(c))
    gender = F.col("gender") if "gender" in values.columns else F.lit("n").alias("gender")
    # many small parts: drawing costs far more than reading
    values = written(values.select("kind", "value", gender, kin).dropDuplicates(["kind", "value"]).repartition(parts, "kind", "value"), "values")
    taken = values.select("kin", F.col("value").alias("plain"))
    won_so_far: DataFrame | None = None
    open_ = values
    for attempt in range(ROUNDS + 1):
        new = _surrogate(F.col("kind"), F.col("value"), F.col("gender"), key, attempt)
        if attempt == ROUNDS:  # a hash of the value tells it from all others
            new = F.concat(new, F.sha2(F.concat_ws("|", F.lit(key), "kind", "value"), 256))
        drawn = open_.repartition(parts, "kind", "value").withColumn("surrogate", new)
        first = drawn.withColumn("plain", plain("surrogate")).groupBy("kin", "plain").agg(F.min(F.struct("value", "kind", "surrogate")).alias("x"))
        free = first.join(taken, ["kin", "plain"], "left_anti")
        if won_so_far is not None:
            free = free.join(won_so_far.select("kin", "plain"), ["kin", "plain"], "left_anti")
        won = written(free.select("kin", "plain", "x.kind", "x.value", "x.surrogate"), "surrogates")
        won_so_far = won if won_so_far is None else won_so_far.unionByName(won)
        after = written(open_.join(won, ["kind", "value"], "left_anti"), "open")
        dropped(open_ if attempt else None)
        open_ = after
        if open_.isEmpty():
            break
    return won_so_far.select("kind", "value", "surrogate")


def _units(hit: Column) -> Column:
    """What of a hit gets surrogates: the words of a name by part, any other hit whole."""
    kind = _kind(hit)
    title = F.regexp_extract(hit, r"^(\p{L}+)\.? ", 1)
    gender = F.when(title.rlike(f"^(?:{MALE_TITLES})$"), "m").when(title.rlike(f"^(?:{FEMALE_TITLES})$"), "f").otherwise("n")
    words = F.split(F.regexp_replace(hit, r"^\p{L}+\.? ", ""), " ")
    named = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise("given").alias("kind"), w.alias("value"), gender.alias("gender")))
    lead = F.when(kind == "name", F.regexp_extract(hit, r"^\p{L}+\.? ", 0)).otherwise("")
    return F.struct(lead.alias("lead"), F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), hit.alias("value"), F.lit("n").alias("gender")))).alias("units"))


def _bare(text: Column, names: Column, gap: Column) -> Column:
    """text with each of the names' words replaced where it stands alone, except months and words that the text also
    has in lower case, which are common words there."""
    edge = "(?<![\\p{L}\\p{N}])"
    end = "(?![\\p{L}\\p{N}])"
    alone = lambda w: F.concat(F.lit(edge), w, F.lit(end))
    common = lambda w: w.isin(*CALENDAR) | (text.contains(w) & F.regexp_like(text, alone(w)))
    kept = F.filter(names, lambda x: ~common(F.lower(x["value"])))
    return F.aggregate(kept, text, lambda acc, x: F.regexp_replace(acc, alone(x["value"]), F.concat(gap, x["new"], gap)))


def replace_pii(docs: DataFrame, text_col: str = "text", key: str = "lodestar", count_col: str | None = "n_entities") -> DataFrame:
    """docs with every detected value in text_col replaced by its surrogate, whole texts, all columns and rows
    kept, and the number of values in count_col (None: not told).

    A null text stays null and counts 0; a text without values stays as it is. A name is found by its title; its
    words change in the rest of the same text too, unless they are months or stand there in lower case as well. A given name's gender is that of most of its titles. A column
    of docs named count_col is replaced; other names of the input can't clash. The same key gives the same
    surrogates on the same table.
    """
    text = F.col(f"`{text_col}`")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, count_col)]
    lone = F.struct(*(others or [F.lit(0)])).alias("__row")  # without the text, which is shuffled once
    d = docs.select(lone, text.alias("__text"))
    hint = F.coalesce(F.col("__text").rlike(HINTS[0]) | F.col("__text").rlike(HINTS[1]), F.lit(False))
    found = d.where(hint).select("__text", F.regexp_extract_all("__text", F.lit(ANY), F.lit(0)).alias("hits")).where(F.size("hits") > 0)
    # one line for each different text with values: copies share it
    found = found.groupBy(F.md5("__text").alias("id"), F.xxhash64("__text").alias("id2")).agg(F.first("hits").alias("hits"))
    found = written(found, "hits")
    units = found.select("id", "id2", F.posexplode("hits").alias("pos", "hit")).withColumn("u", _units(F.col("hit")))
    units = units.select("id", "id2", "pos", "u.lead", F.posexplode("u.units").alias("part", "unit")).select("id", "id2", "pos", "lead", "part", "unit.kind", F.col("unit.value").alias("raw"), "unit.gender")
    units = written(units.withColumn("value", _normal(F.col("kind"), F.col("raw"))), "units")
    male, female = F.count_if(F.col("gender") == "m"), F.count_if(F.col("gender") == "f")
    table = surrogate_table(units.groupBy("kind", "value").agg(F.when(female > male, "f").when(male > 0, "m").otherwise("n").alias("gender")), key)
    named = units.join(table, ["kind", "value"]).withColumn("new", _written(F.col("kind"), F.col("raw"), F.col("surrogate")))
    joined = named.groupBy("id", "id2", "pos").agg(F.concat(F.first("lead"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]), " ")).alias("new"), F.collect_list(F.when(F.col("kind").isin(*NAMES), F.struct((F.col("kind") == "given").alias("given"), F.col("raw").alias("value"), "new"))).alias("names"))
    lists = joined.groupBy("id", "id2").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("new"), F.flatten(F.collect_list("names")).alias("names"))
    # as written, and in capitals; where one word is a given name and a surname, the surname goes first
    lists = lists.withColumn("names", F.sort_array(F.array_distinct(F.flatten(F.transform("names", lambda x: F.array(x, F.struct(x["given"].alias("given"), F.upper(x["value"]).alias("value"), F.upper(x["new"]).alias("new"))))))))
    lists = written(lists, "replacements")
    parts = F.split("__text", ANY, -1)
    # words of names elsewhere in the text; what is put in is fenced, so that no later word matches it
    fence, seam = F.concat(F.lit("5"), "id", F.lit("5")), F.concat(F.lit("\uE002"), "id", F.lit("\uE002"))
    whole = F.aggregate(parts, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, seam, x)))
    rest = F.replace(_bare(whole, F.col("names"), fence), fence, F.lit(""))
    parts = F.when(F.size("names") > 0, F.split(rest, seam, -1)).otherwise(parts)
    new = F.array_join(F.zip_with(parts, F.col("new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    # texts that may hold values meet their replacements; all others stay where they are
    some = d.where(hint).withColumns({"id": F.md5("__text"), "id2": F.xxhash64("__text")}).join(lists, ["id", "id2"], "left")
    some = some.select("__row", F.coalesce(F.size("new"), F.lit(0)).alias("__n"), F.when(F.col("new").isNull(), F.col("__text")).otherwise(new).alias("__new"))
    none = d.where(~hint).select("__row", F.lit(0).alias("__n"), F.col("__text").alias("__new"))
    out = none.unionByName(some)
    cols = [F.col("__new").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c != count_col]
    return out.select(*cols, *([F.col("__n").cast("int").alias(count_col)] if count_col else []))
