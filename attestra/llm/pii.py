"""Surrogates for personal data, in DataFrame functions alone.

Detected: e-mail addresses, IPv4 addresses, payment card numbers, social
security numbers, telephone numbers, and names after an honorific. Each gets a
replacement of its own kind, drawn by a keyed hash of its canonical form: letters for
letters, digits for digits, separators as they stand, upper case kept, card
numbers that pass the Luhn check replaced by such (13 to 19 digits in one run that do not pass it are no card), names by names of the
honorific's gender and of their script, with their hyphens and apostrophes, a given name as an entity of its own beside the surname (after a title of no
gender it is of the gender that the corpus gives it elsewhere, if that is one alone). Mentions of one entity, in whatever
format or document, get the same replacement (coreference).

Distinctness: all distinct entities are listed once; those that share a replacement, or
whose replacement is itself an entity of the corpus, draw again with a higher
attempt number, all but the first, until none is left. Later attempts of e-mails
and names are longer; should ROUNDS draws not be enough (an address space as full as the corpus), an error is raised. Only entities with attempt
numbers above 0 are joined back to their documents.

Cases: null and empty texts stay as they are, as do texts without entities;
repeated rows are replaced alike; an empty table gives no rows; other columns
pass through unchanged, whatever their names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, split_for, written
from .fingerprint import let

#: The session setting that holds the key. Where it is unset, a session draws a key of its own.
KEY_SETTING = "spark.attestra.pii.key"
#: Texts with entities of later attempts are broadcast up to so many; beyond, they are joined by shuffle.
BROADCAST_TEXTS = 20_000
#: Draws of an entity at most; what still collides then is an error, never passed over.
ROUNDS = 64

#: Telephone numbers of ten digits in groups, with or without a country code; all their mentions agree in the last ten digits.
NATIONAL = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+-])(?:\+\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"
#: A capital word of a name: McDonald, O'Brien, Smith-Jones.
WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{L}++(?:-\p{L}++|['’]\p{Lu}\p{L}++)*"
INITIAL = r"\p{Lu}\.[\x20-]?|\p{Lu}\x20"
TITLES = "Mrs|Mr|Ms|Miss|Mx|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora|Señor|Господин|Госпожа|Κύριος|Κυρία"
#: Each pattern starts only where a run starts, so long runs of word characters are read once.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._+-])[._+-]*+[A-Za-z0-9][A-Za-z0-9._+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "card": r"(?<![\w+])(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<![\w+])\d{13,19}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": NATIONAL + r"|(?<![\w+])\+(?=(?:[ .()-]{0,2}\d){8,15}(?!\d))\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,14}+)++|(?<![\w+.-])0\d(?:[ .-]\d{2}){4}(?!\w)|(?<![\w+./=-])[2-9]\d{9}(?!\w)",
    # after a title in capitals all words are, so fewer of them are taken for the name
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{TITLES}|mrs|mr|dr|prof)\.?\x20(?:{INITIAL}|{WORD}\x20){{0,3}}{WORD}|(?:{TITLES.upper()})\.?\x20(?:{INITIAL})*(?:{WORD}\x20)?{WORD})(?![\p{{L}}\p{{N}}])",
}
PATTERN = "|".join(PATTERNS.values())
#: What any entity holds.
HINT = rf"[0-9@]|(?:{TITLES}|mrs|mr|dr|prof|{TITLES.upper()})\.?\x20"

FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Κυρία"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"]
#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): ["Ada", "Bea", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna", "Ines", "Julia", "Klara", "Lena", "Maria", "Nora", "Olga", "Paula"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noah", "Oscar", "Paul"],
    ("latin", "n"): ["Alex", "Andrea", "Ariel", "Casey", "Charlie", "Dana", "Jamie", "Jordan", "Kim", "Lou", "Morgan", "Noel", "Robin", "Sam", "Sascha", "Toni"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Инна", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "Софья", "Тамара", "Ульяна", "Юлия"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел", "Роман", "Сергей", "Тимур", "Юрий"],
    ("greek", "f"): ["Άννα", "Βέρα", "Δάφνη", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Καίτη", "Λυδία", "Μαρία", "Νίκη", "Ξένια", "Όλγα", "Ρέα", "Σοφία"],
    ("greek", "m"): ["Άρης", "Βασίλης", "Γιάννης", "Δήμος", "Ηλίας", "Θάνος", "Ιάσων", "Κώστας", "Λάμπρος", "Μάριος", "Νίκος", "Ορέστης", "Πέτρος", "Ρήγας", "Σπύρος", "Τάσος"],
    ("greek", "n"): ["Αλέξ", "Βάγια", "Γκάμπι", "Ντάνη", "Έλι", "Ζίζι", "Θέκη", "Ίρι", "Κέλυ", "Λίλη", "Μέλι", "Νόα", "Πόπη", "Ρόμπι", "Σάμι", "Τόνι"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Слава", "Паша", "Никита", "Шура", "Миша", "Витя", "Ася", "Тоня", "Лёня", "Сева", "Тася", "Стася", "Митя"],
}
#: Surnames are made of syllables, as are the endings of given names of later attempts; more attempts, more syllables.
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wu", "za"],
    "greek": ["βα", "δε", "φι", "γο", "χυ", "κα", "λε", "μι", "νο", "που", "ρα", "σε", "τι", "βο", "λου", "ζα"],
    "cyrillic": ["ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "лу", "за"],
}
SURNAME_SYLLABLES = 4


def _hex(key: str, kind: Column | str, canonical: Column, attempt: Column) -> Column:
    """128 hexadecimal digits."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical, attempt.cast("string")), 512)


def key_of(spark: SparkSession) -> str:
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return found


def kind_of(m: Column) -> Column:
    """Null: no entity after all."""
    bare_number = F.when(_luhn_rest(F.regexp_replace(m, "[^0-9]", "")) == 0, "card")
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(r"^\p{L}"), "name")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[+(]"), "phone")
        .when(m.rlike(r"^\d{13,19}$"), bare_number)
        .when(digits >= 13, "card")
        .otherwise("phone")
    )


def gender_of(m: Column) -> Column:
    bare = F.initcap(F.regexp_substr(m, F.lit(r"^\p{L}+")))
    return F.when(bare.isin(FEMALE_TITLES), "f").when(bare.isin(MALE_TITLES), "m").otherwise("n")


def given_of(m: Column) -> Column:
    """The canonical form of a name's given name: its gender and the lower-case name; null without one."""
    given = F.trim(F.regexp_extract(m, r"^\p{L}+\.?\x20(.*[\x20.]-?)[^\x20.]+$", 1))
    return F.when(given != "", F.concat(gender_of(m), F.lit(":"), F.lower(given)))


def canonical_of(m: Column, kind: Column) -> Column:
    """What all mentions of an entity have in common: lower-case address, digits (the last ten of a telephone number in groups of 3, 3 and 4), surname."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(kind == "email", F.regexp_replace(F.lower(m), "^[._+-]+", ""))
        .when(kind == "ip", m)
        .when((kind == "phone") & m.rlike(rf"^(?:{NATIONAL})$"), F.right(digits, F.lit(10)))
        .when(kind == "name", F.translate(F.lower(F.regexp_substr(m, F.lit(r"[^\x20.]+$"))), "’", "'"))
        .otherwise(digits)
    )


def _digit(h: Column, at: Column) -> Column:
    """A decimal digit from hexadecimal digits: two of them modulo 10."""
    return (F.conv(F.substr(h, (at * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int") % 10).cast("string")


def _drawn(template: Column, h: Column) -> Column:
    """Letters for letters and digits for digits of template, all else kept."""
    letter = lambda i: F.translate(F.substr(h, (i % 128) + 1, F.lit(1)), "0123456789abcdef", "abcdefghiklmnoprs")
    one = lambda c, i: F.when(c.rlike("[a-z]"), letter(i)).when(c.rlike("[0-9]"), _digit(h, i)).otherwise(c)
    return F.array_join(F.transform(F.split(template, ""), one), "")


def _luhn_rest(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    rev = F.split(F.reverse(digits), "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
    return F.aggregate(F.transform(rev, value), F.lit(0), lambda s, x: s + x) % 10


def surrogate(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The replacement of a canonical form, itself a canonical form. Its hash is bound once, so the expression stays small."""
    return let(_hex(key, kind, canonical, attempt), lambda h: _formed(h, kind, canonical, attempt, key))


def _formed(h: Column, kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    def email(host: Column) -> Column:
        top = F.regexp_substr(host, F.lit(r"\.[a-z0-9-]+$"))
        inner = F.substr(host, F.lit(1), F.length(host) - F.length(top))
        more = F.substr(F.translate(h, "0123456789abcdef", "abcdefghiklmnoprs"), F.lit(100), F.least(attempt * 3, F.lit(28)))
        drawn = let(_hex(key, "host", host, F.lit(0)), lambda hh: _drawn(inner, hh))
        return F.concat(_drawn(F.substring_index(canonical, "@", 1), h), more, F.lit("@"), drawn, top)

    def card(digits: Column) -> Column:
        head = F.substr(digits, F.lit(1), F.length(digits) - 1)
        check = (10 - _luhn_rest(F.concat(head, F.lit("0")))) % 10
        return F.concat(head, ((_luhn_rest(canonical) + check) % 10).cast("string"))  # keeps the original's remainder, 0 if it is valid

    octet = lambda i: (F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string")
    name = F.when(kind == "given", F.regexp_replace(canonical, "^[fmn]:", "")).otherwise(canonical)
    first_letter = F.regexp_substr(name, F.lit(r"\p{L}"))
    known = F.when(first_letter.rlike(r"\p{IsLatin}"), "latin")
    for s_ in SYLLABLES:
        known = known.when(first_letter.rlike(rf"\p{{Is{s_.capitalize()}}}"), s_)
    nibble = lambda i: F.conv(F.substr(h, i % 128 + 1, F.lit(1)), 16, 10).cast("int")
    # names of other scripts are made of their own letters
    own = F.array_distinct(F.filter(F.split(name, ""), lambda c: c.rlike(r"\p{L}")))
    syllables = F.coalesce(F.element_at(F.create_map(*[x for s_, v in SYLLABLES.items() for x in (F.lit(s_), F.array(*map(F.lit, v)))]), known), own)

    def spelt(first: Column, n: Column) -> Column:
        return let(syllables, lambda s: F.array_join(F.transform(F.sequence(first, first + n - 1), lambda i: F.element_at(s, nibble(i) % F.size(s) + 1)), ""))

    def surname() -> Column:
        """Each part between hyphens and apostrophes drawn anew; a single letter for a single letter."""
        parts = F.split(canonical, "(?<=[-'])")
        last = F.size(parts) - 1

        def part(p: Column, k: Column) -> Column:
            n = F.lit(SURNAME_SYLLABLES) + F.when(k == last, F.least(attempt, F.lit(60))).otherwise(0)
            short = F.char_length(F.regexp_replace(p, "[-']", "")) == 1
            drawn = F.when(short & (k < last), F.substr(spelt(k * 17, F.lit(1)), F.lit(1), F.lit(1))).otherwise(spelt(k * 17, n))
            return F.concat(drawn, F.regexp_extract(p, "[-']$", 0))

        return F.array_join(F.transform(parts, part), "")

    def given() -> Column:
        names = F.create_map(*[x for (s_, g_), ns in GIVEN.items() for x in (F.lit(f"{s_}{g_}"), F.array(*[F.lit(n.lower()) for n in ns]))])
        group = F.concat(known, F.substr(canonical, F.lit(1), F.lit(1)))
        first = F.coalesce(F.element_at(F.try_element_at(names, group), nibble(F.lit(0)) + 1), spelt(F.lit(40), F.lit(SURNAME_SYLLABLES)))
        ending = F.when(attempt > 0, spelt(F.lit(1), F.least(attempt, F.lit(60)) + (SURNAME_SYLLABLES - 1))).otherwise("")
        return F.concat(F.substr(canonical, F.lit(1), F.lit(2)), first, ending)

    return (
        F.when(kind == "email", let(F.substring_index(canonical, "@", -1), email)).when(kind == "ip", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), octet), "."))
        .when(kind == "card", let(_drawn(canonical, h), card)).when(kind == "name", surname()).when(kind == "given", given()).otherwise(_drawn(canonical, h))
    )


def rendered(m: Column, kind: Column, canonical: Column, s: Column, given: Column) -> Column:
    """The replacement in the mention's own format. s: the entity's surrogate, given: that of its given name."""
    digits_before = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i), "[^0-9]", ""))

    def filled(lead: Column) -> Column:
        """Digits in place of digits; those of a country code stay."""
        one = lambda c, n: F.when(c.rlike("[0-9]") & (n >= lead), F.substr(s, n - lead + 1, F.lit(1))).otherwise(c)
        return F.array_join(F.transform(F.split(m, ""), lambda c, i: let(digits_before(i), lambda n: one(c, n))), "")

    title = F.regexp_substr(m, F.lit(r"^\p{L}+\.?"))
    last = F.regexp_substr(m, F.lit(r"[^\x20.]+$"))
    before = F.substr(m, F.char_length(title) + 1, F.char_length(m) - F.char_length(title) - F.char_length(last))
    shouted = lambda t: (t == F.upper(t)) & t.rlike(r"\p{L}{2}")
    capital = lambda t: F.array_join(F.transform(F.split(t, "(?<=[-'])"), F.initcap), "")
    as_in = lambda of, new: F.when(shouted(of), F.upper(new)).otherwise(capital(new))
    called = F.coalesce(F.concat(as_in(before, F.substr(given, F.lit(3))), F.lit(" ")), F.lit(""))
    surname = F.when(F.contains(last, F.lit("’")), F.translate(as_in(last, s), "'", "’")).otherwise(as_in(last, s))
    full = F.concat(title, F.lit(" "), called, surname)
    upper = (m == F.upper(m)) & (m != F.lower(m))
    email = F.concat(F.regexp_extract(m, "^[._+-]*", 0), F.when(upper, F.upper(s)).otherwise(s))
    digits = let(F.length(F.regexp_replace(m, "[^0-9]", "")) - F.length(canonical), filled)
    return F.when(kind == "email", email).when(kind == "name", full).when(kind == "ip", s).otherwise(digits)


def pieces(text: Column) -> Column:
    """text cut before and after every entity: entities stand at odd places. Null without any."""
    mark = F.concat(F.lit("﷐"), F.hex(F.xxhash64(text)), F.lit("﷑"))  # no text holds its own hash
    cut = F.split(F.regexp_replace(text, F.lit(PATTERN), F.concat(mark, F.lit("$0"), mark)), mark)
    return F.when(text.rlike(HINT) & text.rlike(PATTERN), cut)


def entities(docs: DataFrame) -> DataFrame:
    """Every mention: kind, canonical, with the document's columns; a name with a given name once more for that, as kind given."""
    cut = docs.withColumn("_cut", pieces(F.col("text"))).where("_cut is not null")
    odd = F.filter("_cut", lambda _, i: i % 2 == 1)
    found = cut.withColumn("mention", F.explode(odd)).withColumn("kind", let(F.col("mention"), kind_of)).where("kind is not null")
    own = F.struct("kind", canonical_of(F.col("mention"), F.col("kind")).alias("canonical"))
    given = F.when(F.col("kind") == "name", F.struct(F.lit("given").alias("kind"), given_of(F.col("mention")).alias("canonical")))
    found = found.withColumn("_entity", F.explode(F.array(own, given))).where("_entity.canonical is not null")
    return found.withColumn("kind", F.col("_entity.kind")).withColumn("canonical", F.col("_entity.canonical")).drop("_cut", "_entity")


def aliases(known: DataFrame) -> DataFrame:
    """canonical, same: given names after a title of no gender that are known with titles of one gender, and of that one alone, are of that gender."""
    g = known.where("kind = 'given'").select("canonical", F.substr("canonical", F.lit(1), F.lit(1)).alias("g"), F.substr("canonical", F.lit(3)).alias("name"))
    per = g.groupBy("name").agg(F.max((F.col("g") == "f").cast("int")).alias("f"), F.max((F.col("g") == "m").cast("int")).alias("m"), F.max((F.col("g") == "n").cast("int")).alias("n")).where("n = 1 and f + m = 1")
    return per.select(F.concat(F.lit("n:"), "name").alias("canonical"), F.concat(F.when(F.col("f") == 1, "f:").otherwise("m:"), "name").alias("same"))


def assigned(docs: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """kind, canonical, surrogate, attempt of every distinct entity; no two of a kind share a surrogate."""
    if known is None:
        known = written(entities(docs.select("text")).select("kind", "canonical").distinct(), "entities")
    other = aliases(known).select(F.lit("given").alias("kind"), "canonical")
    known = known.join(other, ["kind", "canonical"], "left_anti")
    out = known.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("canonical"), F.col("attempt"), key))
    out = written(out, "surrogates")
    for _ in range(ROUNDS):
        # all that claim a form: its own entity first, then surrogates by attempt and canonical form
        claims = out.select("kind", F.col("surrogate").alias("form"), "attempt", "canonical").unionByName(out.select("kind", F.col("canonical").alias("form"), F.lit(-1).alias("attempt"), F.lit("").alias("canonical")))
        first = claims.groupBy("kind", "form").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canonical")).alias("holder")).where("n > 1")
        lost = out.join(first.withColumnRenamed("form", "surrogate"), ["kind", "surrogate"]).where((F.col("holder.attempt") != F.col("attempt")) | (F.col("holder.canonical") != F.col("canonical"))).select("kind", "canonical", F.lit(True).alias("lost"))
        lost = written(lost, "collisions")
        if lost.isEmpty():
            return out
        again = out.join(lost, ["kind", "canonical"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("lost", F.lit(False)).cast("int"))
        out = written(again.select("kind", "canonical", "attempt", surrogate(F.col("kind"), F.col("canonical"), F.col("attempt"), key).alias("surrogate")), "surrogates")
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds: {lost.limit(5).collect()}")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text; all columns and rows as before."""
    known = written(entities(docs.select("text")).select("kind", "canonical").distinct(), "entities")
    drawn_again = assigned(docs, key, known).where("attempt > 0").select("kind", "canonical", "attempt")
    # what a mention can't tell by itself, in one number: four times the attempt, and 1 or 2 if its given name is a woman's or a man's
    same = aliases(known).join(drawn_again.where("kind = 'given'").select(F.col("canonical").alias("same"), "attempt"), "same", "left")
    gender = F.when(F.startswith("same", F.lit("f")), 1).otherwise(2)
    again = drawn_again.select("kind", "canonical", (F.col("attempt") * 4).alias("attempt")).unionByName(same.select(F.lit("given").alias("kind"), "canonical", (F.coalesce("attempt", F.lit(0)) * 4 + gender).alias("attempt")))
    again = written(again, "attempts")
    columns = docs.columns
    cut, tries, text_hash = (split_for(docs, c) for c in ("_cut", "_attempts", "_text_hash"))
    rows = docs
    if again.isEmpty():
        rows = rows.withColumn(tries, F.lit(None).cast("map<string,int>"))
    else:
        # texts with such an entity, named by their hash: few, but joined by shuffle if they are not
        found = entities(docs.select("text")).select(F.xxhash64("text").alias(text_hash), "kind", "canonical").distinct().join(again, ["kind", "canonical"])
        found = written(found.groupBy(text_hash).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "canonical"), "attempt"))).alias(tries)), "attempts")
        few = found.count() <= BROADCAST_TEXTS
        rows = rows.withColumn(text_hash, F.xxhash64("text")).join(F.broadcast(found) if few else found, text_hash, "left")
    rows = rows.withColumn(cut, pieces(F.col("text")))

    told = lambda k, c: F.coalesce(F.try_element_at(F.col(tries), F.concat_ws("\x1f", k, c)), F.lit(0))
    own = lambda c, n: F.when(n % 4 == 1, F.concat(F.lit("f"), F.substr(c, F.lit(2)))).when(n % 4 == 2, F.concat(F.lit("m"), F.substr(c, F.lit(2)))).otherwise(c)
    drawn = lambda k, c: let(told(k, c), lambda n: surrogate(k, own(c, n), F.floor(n / 4).cast("int"), key))

    def replaced(m: Column, i: Column) -> Column:
        of_given = lambda: let(given_of(m), lambda g: F.when(g.isNotNull(), drawn(F.lit("given"), g)))
        named = lambda kind: F.when(kind == "name", of_given())
        new = lambda kind, canonical: let(drawn(kind, canonical), lambda s: let(named(kind), lambda g: rendered(m, kind, canonical, s, g)))
        return F.when(i % 2 == 1, let(kind_of(m), lambda kind: let(canonical_of(m, kind), lambda canonical: F.when(kind.isNull(), m).otherwise(new(kind, canonical))))).otherwise(m)

    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.col(cut), replaced), ""))
    return rows.withColumn("text", text).select(*[F.col(f"`{c}`") for c in columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pseudonymised(docs.select("doc_id", "text"), key_of(spark))
