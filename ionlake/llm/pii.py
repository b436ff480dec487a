"""Keyed surrogates for personal data, by DataFrame functions alone.

Entities are found by one pattern: e-mail and IP addresses, bank account numbers, payment cards,
social security and telephone numbers, and people who are named by title, by a known given name or
after a cue, with initials, middle names and particles. Account and card numbers have to have valid
check digits. Each distinct entity of the corpus gets one surrogate, made from SHA-512 of key, type,
entity and attempt: letters stay letters of their case and script, digits stay digits, all else
stays; cards and accounts have valid check digits, an address keeps its top-level domain, an octet
its range. A person's parts are replaced one by one: a given name by one of its gender and script, a
surname by one that is built as surnames of its script are and keeps the ending that tells the
gender. Equal entities get equal surrogates everywhere (names and mail domains by part, so that a
person stays the same person under a title or a given name). Candidates are checked against all
other surrogates and all real entities of their type, and those that clash are drawn again until none
does; given names are permuted within their list, so that they stay distinct, and since no surrogate
of a surname is a real one, no person's surrogate is a real person. Of a telephone number the country
code, or the trunk 0 and the digit behind it, or an area code's first digit stays.

Who is named in a text once is replaced all over it: after the entities, each capitalised word that is
a given name or surname of a person found in the same text gets that part's surrogate, alone, in
another order or before an apostrophe. A part that the text also writes in lower case is taken for a
word, and stays where no entity is.

Only distinct entities are shuffled and joined, and each distinct text with entities gets a map of
its own. Texts with entities are shuffled once, by their MD5, to meet those maps; others don't move.

Nulls and ties: null and empty texts have no entities and stay. Of entities that draw the same
surrogate the one that sorts first keeps it. Overlapping matches: the leftmost, then the kind that
stands first in KINDS. Repeated rows get the same text each. All columns of the input are carried
through, and a column n_chars is brought up to date by ``replaced``. Where a format has too few values
for all entities, surrogates grow by digits. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Given names by script and gender, and titles.
GIVEN = {
    ("latin", "female"): "Alexandra Alice Angela Barbara Brigitte Caroline Catherine Charlotte Claudia Cristina Deborah Elizabeth Emily Fatima Florence Francesca Gabriela Hannah Isabella Jennifer Jessica Julia Katharina Laura Linda Lucia Margaret Maria Michelle Monika Natalie Nicole Olivia Patricia Priya Rachel Rebecca Sabine Sandra Sophie Stephanie Susan Ursula Valentina Victoria Aisha Amina Ananya Astrid Chiara Fiona Ingrid Leila Mei Siobhan Yuki Zainab",
    ("latin", "male"): "Alexander Andreas Anthony Antonio Benjamin Carlos Charles Christopher Daniel David Diego Edward Fernando Francisco Frank George Gerhard Hans Henry Jacques James Javier Johann John Joseph Juan Kenneth Klaus Lucas Manuel Mark Matthew Michael Mohammed Nicholas Patrick Peter Philippe Rajesh Richard Robert Stefan Thomas Timothy Walter William Wolfgang Ahmed Ali Arjun Hiroshi Kenji Kwame Lars Liam Luca Omar Pierre Sean Sven Wei",
    ("cyrillic", "female"): "Александра Анастасия Анна Валентина Вера Виктория Галина Дарья Екатерина Елена Ирина Ксения Людмила Марина Мария Наталья Оксана Ольга Светлана Татьяна Юлия",
    ("cyrillic", "male"): "Александр Алексей Андрей Борис Виктор Владимир Геннадий Григорий Дмитрий Евгений Иван Игорь Константин Максим Михаил Николай Олег Павел Сергей Фёдор Юрий",
    ("greek", "female"): "Αγγελική Αικατερίνη Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Μαρία Σοφία",
    ("greek", "male"): "Αθανάσιος Αντώνιος Βασίλειος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Χρήστος",
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Herrn Frau Monsieur Madame Mme Mlle Señor Señora Sra Don Doña"

_GIVEN = "|".join(n for names in GIVEN.values() for n in names.split())
_TITLE = "|".join(TITLES.split())
_CAP = r"(?:\p{Lu}['’])?\p{Lu}\p{L}*\p{Ll}(?:-\p{Lu}\p{L}*\p{Ll})?"
#: Particles of surnames, which stay, and what stands before a name.
PARTICLES = "von van de der den del della da di bin ibn al la".split()
CUES = ("[Nn]ame is", "[Nn]ame:", "[Cc]ontact", "[Rr]egards,", "[Ss]incerely,", "From:", "To:", "Attn:", "[Pp]atient:", "[Aa]uthor:")
_BETWEEN = rf"(?:\p{{Lu}}\. ?|{_CAP} |(?:{'|'.join(PARTICLES)}) )"
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"

#: Kinds and their patterns, by which kind wins where two begin together.
KINDS = {
    "email": r"(?<![._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ipv6": r"(?<![:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "ipv4": r"(?<!\.)(?<![Vv]ersion )(?<![Rr]elease )(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "iban": rf"{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
    "card": r"(?<![+.-])(?:[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9A-Za-z]|-[0-9])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<!\+)(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?<![0-9][ .,])[2-9][0-8][0-9] [2-9][0-9]{2} [0-9]{4}(?! [0-9])|\(?0[0-9]{1,4}\)?[ /-][0-9]{3,4}[ -]?[0-9]{3,4}|0[0-9](?: [0-9]{2}){4})(?![0-9A-Za-z]|[.-][0-9])",
    "person": rf"(?=\p{{Lu}}){_EDGE}(?:(?:(?:{_TITLE})\.? {_BETWEEN}{{0,3}}|(?:{_GIVEN}) {_BETWEEN}{{0,2}}){_CAP}|(?<=(?:{'|'.join(CUES)}) ){_CAP} {_BETWEEN}{{0,2}}{_CAP}){_END}",
}
#: Nothing begins inside a word.
PATTERN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
#: What a text with an entity has to contain; looked for first.
HINT = rf"[0-9@]|:[0-9A-Fa-f]{{0,4}}:|(?=\p{{Lu}}){_EDGE}(?:{_TITLE}|{_GIVEN})\.? \p{{L}}|(?:{'|'.join(CUES)}) \p{{Lu}}"


def _has_entities(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(HINT) & F.col(text).rlike(PATTERN), F.lit(False))


def _entities(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _kind(entity: Column) -> Column:
    found = F.lit("person")
    for kind in reversed([k for k in KINDS if k != "person"]):
        found = F.when(entity.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(found)
    return found


def _part_kind(part: Column) -> Column:
    """Of a person: what stays, an initial, a given name or a surname."""
    stays = part.rlike(rf"^(?:(?:{_TITLE})\.?|{'|'.join(PARTICLES)})$")
    return F.when(stays, "stays").when(part.rlike(r"^\p{Lu}\.$"), "initial").when(part.isin(*_GIVEN.split("|")), "given").otherwise("surname")


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


_LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def _masked(text: Column, digest: Column) -> Column:
    """Each letter and digit replaced by one of its kind."""

    def drawn(c: Column, i: Column) -> Column:
        byte = _byte(digest, i)
        draw = lambda alphabet: F.substring(F.lit(alphabet), byte % len(alphabet) + 1, F.lit(1))
        out = F.when(c.rlike("^[0-9]$"), draw("0123456789"))
        for script, letters in _LOWER.items():
            name = {"latin": "IsLatin", "cyrillic": "IsCyrillic", "greek": "IsGreek"}[script]
            out = out.when(c.rlike(rf"^[\p{{{name}}}&&\p{{Ll}}]$"), draw(letters)).when(c.rlike(rf"^[\p{{{name}}}&&\p{{Lu}}]$"), draw(letters.upper()))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), drawn), "")


def _luhn(digits: Column) -> Column:
    """The sum that a valid card number has as a multiple of ten."""
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + _doubled(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))


def _doubled(digit: Column, twice: Column) -> Column:
    return F.when(~twice, digit).when(digit > 4, digit * 2 - 9).otherwise(digit * 2)


def _card(entity: Column, digest: Column) -> Column:
    """The first digit stays; the last is the check digit."""
    body = F.concat(F.substring(entity, 1, 1), _masked(F.substring(entity, F.lit(2), F.length(entity) - 2), digest))
    digits = F.concat(F.regexp_replace(body, "[^0-9]", ""), F.lit("0"))
    last = (10 - _luhn(digits) % 10) % 10
    return F.concat(body, last.cast("string"))


def _mod_97(account: Column) -> Column:
    """The remainder of an account number that is 1 if its check digits are right."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda r, c: F.when(value(c) > 9, r * 100 + value(c)).otherwise(r * 10 + value(c)) % 97)


def _iban(entity: Column, digest: Column) -> Column:
    """The country stays, and the check digits are right."""
    rest = _masked(F.substring(entity, F.lit(5), F.length(entity)), digest)
    check = F.lit(98) - _mod_97(F.concat(F.substring(entity, 1, 2), F.lit("00"), rest))
    return F.concat(F.substring(entity, 1, 2), F.lpad(check.cast("string"), 2, "0"), rest)


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.lit(key), *parts), 512)


def _email(entity: Column, digest: Column, key: str, attempt: Column) -> Column:
    local, domain = F.substring_index(entity, "@", 1), F.lower(F.substring_index(entity, "@", -1))
    top = F.substring_index(domain, ".", -1)
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    longer = F.when(attempt < 4, "").otherwise(F.substring(digest, F.lit(1), attempt))  # short addresses run out
    return F.concat(_masked(local, digest), longer, F.lit("@"), _masked(name, _digest(key, F.lit("domain"), name)), F.lit("."), top)


def _ipv4(entity: Column, digest: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + _byte(digest, i) % 254).cast("string")), ".")


def _ipv6(entity: Column, digest: Column) -> Column:
    """Each hexadecimal digit by another, no group with a leading zero that had none."""
    drawn = lambda c, i: F.substring(F.when(c.rlike("[A-F]"), F.lit("123456789ABCDEF")).otherwise(F.lit("123456789abcdef")), _byte(digest, i) % 15 + 1, F.lit(1))
    return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c == ":", c).otherwise(drawn(c, i))), "")


#: What stays of a telephone number: its country code, trunk 0 with what follows, or an area code's first digit.
_PREFIX = r"^(?:\+[0-9]{1,3}[ .-]|\+(?:[17]|[2-9][0-9])|\(?0[0-9]|\(?[0-9])"


def _phone(entity: Column, digest: Column) -> Column:
    code = F.regexp_extract(entity, _PREFIX, 0)
    return F.concat(code, _masked(F.substring(entity, F.length(code) + 1, F.length(entity)), digest))


#: By script, vowels and consonants, and endings of surnames, of which those of one gender stand for those of the other.
_SOUNDS = {"latin": ("aeiou", "bdfglmnprstvk"), "cyrillic": ("аеиоу", "бвгдзклмнпрстш"), "greek": ("αειο", "βγδζκλμνπρστφχ")}
_ENDINGS = "(?:овска|евска|ова|ева|ёва|ина|ына|ская|цкая|ский|цкий|ов|ев|ёв|ин|ын|енко|ук|юк|ич|όπουλος|οπούλου|ίδης|ίδου|άκης|άκη|ής|ης|ος|ού|ου|ας|ά|α|ovská|ová|ova|eva|ska|ski|ov|ev)$"


def _stem(surname: Column) -> Column:
    return F.regexp_replace(surname, _ENDINGS, "")


def _surname(entity: Column, key: str, attempt: Column) -> Column:
    """As many letters of the same script and case, consonants and vowels by turns, and the same ending."""
    stem = F.when(F.length(_stem(entity)) >= 2, _stem(entity)).otherwise(entity)
    digest = _digest(key, F.lit("surname"), stem, attempt.cast("string"))

    def drawn(c: Column, i: Column) -> Column:
        byte = _byte(digest, i)
        out = F.when(~c.rlike(r"\p{L}"), c)
        for script, (vowels, consonants) in _SOUNDS.items():
            of = lambda letters: F.substring(F.lit(letters), byte % len(letters) + 1, F.lit(1))  # noqa: B023, E731
            letter = F.when(i % 2 == 1, of(vowels)).otherwise(of(consonants))
            inside = c.rlike(rf"^\p{{Is{script.capitalize()}}}$")
            out = out.when(inside & c.rlike(r"^\p{Lu}$"), F.upper(of(consonants))).when(inside, letter)
        return out.otherwise(c)

    longer = F.when(attempt < 4, "").otherwise(F.translate(F.substring(digest, F.lit(1), attempt), "0123456789abcdef", "aeioulmnrstvaeio"))
    longer = F.when(entity.rlike(r"\p{IsLatin}"), longer).otherwise(F.repeat(F.substring(stem, F.length(stem), F.lit(1)), F.greatest(attempt - 3, F.lit(0))))
    return F.concat(F.array_join(F.transform(F.split(stem, ""), drawn), ""), longer, F.substring(entity, F.length(stem) + 1, F.length(entity)))


def _given_names(entities: DataFrame, key: str) -> DataFrame:
    """value and surrogate for each known given name: the next one of its gender and script in keyed order."""
    spark = entities.sparkSession
    rows = [(name, f"{script} {gender}") for (script, gender), names in GIVEN.items() for name in names.split()]
    names = spark.createDataFrame(rows, "value string, pool string").groupBy("pool").agg(F.array_sort(F.collect_list(F.struct(_digest(key, F.col("value")).alias("h"), "value"))).alias("ring"))
    return names.select(F.posexplode("ring").alias("i", "x"), "ring").select(F.col("x.value").alias("value"), F.get("ring", (F.col("i") + 1) % F.size("ring"))["value"].alias("surrogate"))


def _candidate(key: str) -> Column:
    value, attempt = F.col("value"), F.col("attempt")
    digest = F.col("digest")
    return (
        F.when(F.col("kind") == "email", _email(value, digest, key, attempt))
        .when(F.col("kind") == "ipv4", _ipv4(value, digest))
        .when(F.col("kind") == "ipv6", _ipv6(value, digest))
        .when(F.col("kind") == "iban", _iban(value, digest))
        .when(F.col("kind") == "card", _card(value, digest))
        .when(F.col("kind") == "surname", _surname(value, key, attempt))
        .when(F.col("kind") == "phone", _phone(value, digest))
        .otherwise(_masked(value, digest))
    )


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    rows = entities.withColumn("digest", _digest(key, F.col("kind"), F.col("value"), F.col("attempt").cast("string"))).withColumn("surrogate", _candidate(key))
    # a format whose values run out grows by digits
    more = F.when((F.col("attempt") < 3) | F.col("kind").isin("email", "surname"), "").otherwise(F.translate(F.substring(F.col("digest"), F.lit(9), F.col("attempt") - 2), "abcdef", "012345"))
    return rows.withColumn("surrogate", F.concat("surrogate", more)).drop("digest")


def _distinct_surrogates(values: DataFrame, key: str) -> DataFrame:
    """value, kind and surrogate of distinct (value, kind), no two surrogates of a kind equal and none a
    real value of it."""
    now = cut(_drawn(values.withColumn("attempt", F.lit(0)), key))
    while True:
        owner = now.groupBy("kind", "surrogate").agg(F.min("value").alias("__owner"))
        real = now.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("__real"))
        judged = now.join(owner, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        judged = judged.withColumn("__clash", (F.col("value") != F.col("__owner")) | F.col("__real").isNotNull())
        clashing = judged.where("__clash").select("value", "kind", (F.col("attempt") + 1).alias("attempt"))
        if clashing.isEmpty():
            return now.select("value", "kind", "surrogate")
        now = cut(judged.where("not __clash").select("value", "kind", "attempt", "surrogate").unionByName(_drawn(clashing, key)))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """value, kind and surrogate of each distinct ``value``."""
    kinds = entities.select("value").distinct().withColumn("kind", _kind(F.col("value")))
    parts = kinds.where("kind = 'person'").select("value", F.posexplode(F.split("value", " ")).alias("at", "part")).withColumn("part_kind", _part_kind(F.col("part")))
    parts = cut(parts.withColumn("whole", F.col("value")))
    surnames = parts.where("part_kind = 'surname'").select(F.col("part").alias("value"), F.lit("surname").alias("kind")).distinct()
    single = _distinct_surrogates(kinds.where("kind <> 'person'").select("value", "kind").unionByName(surnames), key)
    single = cut(single)
    given = _given_names(entities, key).select(F.col("value").alias("part"), F.col("surrogate").alias("__given"))
    named = parts.join(single.where("kind = 'surname'").select(F.col("value").alias("part"), "surrogate"), "part", "left").join(F.broadcast(given), "part", "left")  # GIVEN is fixed
    initial = F.concat(F.substring(F.translate(_digest(key, F.lit("initial"), F.col("part")), "0123456789abcdef", "ABCDEFGHKLMNPRST"), 1, 1), F.lit("."))
    new = F.when(F.col("part_kind") == "initial", initial).when(F.col("part_kind") == "given", F.col("__given")).when(F.col("part_kind") == "surname", F.col("surrogate")).otherwise(F.col("part"))
    people = named.groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("at", new.alias("new")))).alias("p"))  # a few parts each
    people = people.select(F.col("whole").alias("value"), F.lit("person").alias("kind"), F.array_join(F.transform("p", lambda x: x["new"]), " ").alias("surrogate"))
    return single.where("kind <> 'surname'").unionByName(people)


def _found(docs: DataFrame) -> DataFrame:
    """__text (a text's MD5) and value of each distinct entity of each distinct text."""
    texts = docs.where(F.col("text").rlike(HINT)).select(F.md5("text").alias("__text"), F.array_distinct(_entities("text")).alias("__values")).where(F.size("__values") > 0)
    found = texts.select("__text", F.explode("__values").alias("value")).distinct().withColumn("kind", _kind(F.col("value")))
    number = F.regexp_replace("value", "[^0-9]", "")  # what fails its check digits is another number
    valid = F.when(F.col("kind") == "card", _luhn(number) % 10 == 0).when(F.col("kind") == "iban", _mod_97(F.col("value")) == 1).otherwise(F.lit(True))
    return found.where(valid).select("__text", "value")


#: A capitalised word, which may mention a person by a part of the name.
_MENTION = rf"(?=\p{{Lu}}){_EDGE}{_CAP}{_END}"


def _parts() -> Column:
    """part and new of the names of the persons in ``__map``."""
    people = F.filter(F.map_entries("__map"), lambda x: ~x["key"].rlike("[0-9@:]"))
    zipped = F.transform(people, lambda x: F.zip_with(F.split(x["key"], " "), F.split(x["value"], " "), lambda part, new: F.struct(part.alias("part"), new.alias("new"))))
    return F.array_distinct(F.filter(F.flatten(zipped), lambda x: x["part"].rlike(rf"^(?!(?:{_TITLE})$){_CAP}$")))


def _words_too(text: str) -> Column:
    """The ``__parts``, in lower case, that ``text`` has in lower case."""
    return F.array_intersect(F.transform("__parts", lambda x: F.lower(x["part"])), F.split(text, r"[^\p{L}'’-]+"))


def _renamed(plain: Column) -> Column:
    """``plain`` with the parts in ``__names`` replaced."""
    new = F.transform(F.regexp_extract_all(plain, F.lit(_MENTION), F.lit(0)), lambda w: F.coalesce(F.try_element_at("__names", w), w))
    return F.array_join(F.zip_with(F.split(plain, _MENTION, -1), new, lambda between, w: F.concat(between, F.coalesce(w, F.lit("")))), "")


def replaced(docs: DataFrame, key: str, counts: str | None = None) -> DataFrame:
    """``docs`` with surrogates in column text; with ``counts``, a column of that name has the number
    of entities replaced in each row, further mentions of their persons not counted."""
    found = cut(_found(docs))
    table = cut(surrogates(found.select("value"), key))
    # written, so that the join below deals both sides out anew and a text with many copies can be split
    maps = cut(found.join(table, "value").groupBy("__text").agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("__map")))
    has = _has_entities("text")
    rows = docs.where(has).withColumn("__text", F.md5("text")).join(maps, "__text", "left")
    rows = rows.withColumn("__entities", F.when(F.col("__map").isNotNull(), _entities("text"))).withColumn("__parts", _parts())
    words = F.when(F.size("__parts") > 0, _words_too("text"))
    rows = rows.withColumn("__words", words).withColumn("__names", F.map_from_entries(F.filter("__parts", lambda x: ~F.array_contains("__words", F.lower(x["part"])))))
    between = F.when(F.size("__names") > 0, F.transform(F.split("text", PATTERN, -1), _renamed)).otherwise(F.split("text", PATTERN, -1))
    changed = F.zip_with(between, F.transform("__entities", lambda e: F.coalesce(F.try_element_at("__map", e), e)), lambda plain, e: F.concat(plain, F.coalesce(e, F.lit(""))))
    text = F.when(F.col("__map").isNull(), F.col("text")).otherwise(F.array_join(changed, ""))
    rows = rows.withColumns({"__new": text, "__count": F.coalesce(F.size(F.filter("__entities", lambda e: F.map_contains_key("__map", e))), F.lit(0)).cast("long")})
    columns = [F.col("__new").alias("text") if c == "text" else F.when(F.col("__map").isNull(), F.col("n_chars")).otherwise(F.char_length("__new")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns if c != counts]
    rows = rows.select(*columns, *([F.col("__count").alias(counts)] if counts else []))
    others = docs.where(~has).select(*[c for c in docs.columns if c != counts], *([F.lit(0).cast("long").alias(counts)] if counts else []))
    return others.unionByName(rows)
