"""Personal data replaced by surrogates, with built-in functions only.

Found are e-mail addresses, IPv4 and IPv6 addresses, account numbers (IBAN), card numbers (16 digits, or 13 to 19 with a
right check digit), phone numbers (three, three and four digits, or international with a plus), social security
numbers, and names of persons: titles or a known given name and the run of names after it, with initials, particles,
hyphens and apostrophes, over blanks and single line breaks. Words of a name that stand alone elsewhere in the same text
are replaced as well. Each entity gets a replacement of its own kind:

* keyed: drawn from SHA-256 of a secret key, the kind and the normalised entity;
* consistent: letters, digits and marks stay where they are. A mail address keeps the shape of its local part
  and moves to an example domain; a card keeps its first digit, its length and whether its check digit is right; an
  account keeps its country and gets right check digits; a phone number keeps its country code; an IPv4 address stays one,
  an IPv6 address becomes one of the range for documentation; a given name stays one of its gender,
  and names keep their script (Latin, Cyrillic or Greek), their capitals, marks and blanks; initials move by a keyed step;
* coreferent: entities are normalised first (mail in lower case, the national digits of a phone number, names word
  by word), so all spellings of one entity in all documents get the same replacement;
* distinct: a drawn replacement that another entity got, or that is itself an entity of the corpus, is
  drawn again, in rounds over the table of distinct entities, until none is left. A kind has at least 10^6 (phone numbers of
  six national digits) to 10^8 (social security numbers) replacements; if 64 draws find none, an error is raised.

Not found are names with neither a title nor a listed given name in their text, phone numbers without plus in other
forms, and postal addresses.

The work is on distinct entities; texts are read to find entities and again to replace them. Only texts
with an entity are shuffled, by the digest of the text, so copies share one list of replacements.

Cases: a null or empty text has no entities and stays as it is; texts without entities are passed on as
they are; texts of any length are read whole; equal rows get equal rows; an empty table gives no rows. Extra
columns are ignored by :func:`report` and kept by :func:`replace`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponflow.llm.tables import small_side
from couponflow.session import stage

KEY = "replace-me-with-a-secret"
#: Draws after which the space of a kind counts as used up.
MAX_DRAWS = 64
#: Draws after which mail addresses and names get longer.
GROW_AFTER = 4

# Common given names, titles, particles, and words that start a sentence rather than go on with a name.
FEMALE = (
    "Anna Maria Julia Laura Sophie Emma Marie Elena Lucia Carmen Claire Camille Ingrid Katharina Sabine Petra Susan "
    "Linda Mary Patricia Jennifer Elizabeth Barbara Jessica Sarah Karen Ann Anne Olivia Sophia Isabella Charlotte Amelia "
    "Emily Margaret Nancy Helen Alice Chloe Hannah Lena Martina Monika Ursula Isabel Pilar Giulia Francesca Chiara "
    "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Μαρία Ελένη Κατερίνα Σοφία"
).split()
MALE = (
    "James John Robert Michael William David Richard Thomas Charles Daniel Hans Peter Klaus Wolfgang Pierre Jean Louis "
    "Antoine Carlos Juan Pablo Miguel Jose José Luis Stefan Joseph George Edward Henry Paul Peter Matthew Andrew Steven Kevin "
    "Brian Oliver Noah Liam Lucas Benjamin Alexander Martin Andreas Jürgen Michel Philippe François Marco Giuseppe Diego "
    "Иван Сергей Алексей Дмитрий Андрей Николай Владимир Михаил Γιώργος Νίκος Δημήτρης Κώστας"
).split()
TITLES = (
    "Mr Mrs Ms Miss Dr Prof Professor Doctor Herr Frau Mme Madame Mlle Monsieur Sr Sra Señor Señora Signor Signora Sir Lady Lord"
).split()
PARTICLES = "van von de der den del della da di dos du la le ter zu bin al el y".split()
STOPS = (
    "The This That These Those There Then They He She It We You And But Or So If In On At By To For From With Of As An "
    "Is Was When While After Before Where Who What Why How Not No Yes Our My His Her Its Their".split()
)
#: Syllables and the endings of female and male given names and of surnames, by script.
SCRIPTS = {
    "latin": ("ba be bi do fa ge ka la li lo ma me mi na ne no ra re ri ro sa se ta ti va ve".split(), "na la ra sa".split(), "n l r s".split(), "ner ler man son".split()),
    "cyrillic": ("ба ве ви да ге ка ла ли ло ма ме ми на не но ра ре ри ро са се та ти фа".split(), "на ла ра са".split(), "н л р с".split(), "нов лов ров сов".split()),
    "greek": ("βα γε δο κα λα λι λο μα με μι να νε νο ρα ρε ρι ρο σα σε τα τι φα".split(), "να λα ρα σα".split(), "νης λης ρης σης".split(), "νος λος ρος σος".split()),
}

# Also written in capitals.
_GIVEN = [form for name in FEMALE + MALE for form in (name, name.upper())]
_LETTERS = r"[\p{L}\p{M}]"
_NAME = rf"(?!(?:{'|'.join(STOPS)})(?!\p{{L}}))\p{{Lu}}(?:['’]\p{{Lu}})?{_LETTERS}++(?:[-'’]\p{{Lu}}{_LETTERS}*+){{0,4}}"
_GAP = r"(?:[ \t\u00A0]{1,8}|[ \t]{0,4}\r?\n[ \t]{0,4})"
_LINK = rf"(?:(?:{'|'.join(PARTICLES)}){_GAP}){{0,3}}"
_NEXT = rf"(?:{_NAME}|\p{{Lu}}\.)"
# At most twelve words, as every repetition takes some of the matcher's stack.
_MORE = rf"(?:{_GAP}{_LINK}{_NEXT})"
_HEX = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    # A domain name has at most 127 labels; without this bound a very long one exhausts the matcher's stack.
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.){1,126}\p{L}{2,}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{0,30}[0-9])"
    rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:)(?![0-9A-Za-z:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    # Written in groups, a card has no other group of digits beside it.
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{16}|[2-6][0-9]{12,18}|(?<![0-9][ -])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}"
    r"|[2-6][0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5}|[2-6][0-9]{3}(?:[ -][0-9]{4}){2,3}[ -][0-9]{1,3})(?![ -][0-9]))(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"|(?<!\+)\+[1-9](?:[ .()/-]{0,2}[0-9]){8,14})(?![0-9A-Za-z])",
    "person": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:(?:{'|'.join(TITLES)})\.?{_GAP}){{1,3}}{_LINK}{_NEXT}{_MORE}{{0,11}}"
    rf"|(?:{'|'.join(_GIVEN)})(?:-\p{{Lu}}{_LETTERS}++)?{_MORE}{{1,11}})(?!\p{{L}})",
}
#: Words of a name, and words of a text that may be one.
_WORD = rf"(?<!\p{{L}})\p{{Lu}}{_LETTERS}{{2,}}+"
#: Alphabets in which initials move.
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
ANY = "|".join(PATTERNS.values())
#: Every entity has a digit, an @, or starts with a title or given name. Most texts have none of these,
#: and this is found faster than that no pattern matches.
GATE = rf"[0-9@]|(?=\p{{Lu}})(?<!\p{{L}})(?:{'|'.join(TITLES + _GIVEN)})"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _all(text: Column, pattern: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))


def _entity(value: Column) -> Column:
    """Whether a match is an entity: a number of other than 16 digits is a card only with a right check digit."""
    number = _digits(value)
    other = F.regexp(value, F.lit(r"^[0-9](?:[ -]?[0-9]){12,18}$")) & (F.length(number) != 16)
    return ~other | (_luhn(number) % 10 == 0)


def _found(text: Column) -> Column:
    """``values``, the matches of a text in order of place (empty for null), and ``pattern`` by which they are found."""
    none = F.array().cast("array<string>")

    def with_names(values: Column) -> Column:
        people = F.filter(values, lambda v: F.regexp(v, F.lit(r"^\p{Lu}[^0-9@]*$")))
        words = F.array_except(F.flatten(F.transform(people, lambda v: _all(v, _WORD))), F.array(*map(F.lit, TITLES)))
        forms = F.array_union(words, F.array_union(F.transform(words, F.upper), F.transform(words, F.initcap)))
        alone = F.when(F.size(people) > 0, F.array_sort(F.array_intersect(forms, _all(text, _WORD)))).otherwise(none)
        # Longer words first, where one begins another.
        choice = F.array_join(F.reverse(alone), "|")
        pattern = F.concat(F.lit(ANY + r"|(?=\p{Lu})(?<!\p{L})(?:"), choice, F.lit(r")(?!\p{L})"))
        again = _let(F.when(F.size(alone) > 0, pattern), lambda p: F.struct(F.when(p.isNull(), values).otherwise(_all(text, p)).alias("values"), p.alias("pattern")))
        return again

    found = F.when(F.regexp(text, F.lit(GATE)), _all(text, ANY))
    return _let(F.coalesce(found, none), with_names)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _parts(value: Column) -> Column:
    """An entity's parts to be drawn: ``kind``, ``norm`` and ``surface``, in order of place."""

    def one(kind: str, norm: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), norm.alias("norm"), value.alias("surface")))

    def word(w: Column) -> Column:
        bare = F.regexp_replace(w, r"\.$", "")
        kind = (
            F.when(bare.isin(TITLES + PARTICLES) | ~F.regexp(w, F.lit(r"^\p{L}")), "kept")
            .when(F.length(bare) == 1, "initial")
            .when(F.lower(w).isin([n.lower() for n in FEMALE]), "female")
            .when(F.lower(w).isin([n.lower() for n in MALE]), "male")
            .otherwise("surname")
        )
        return F.struct(kind.alias("kind"), F.lower(w).alias("norm"), w.alias("surface"))

    whole = {k: F.regexp(value, F.lit(f"^(?:{p})$")) for k, p in PATTERNS.items()}
    # The country code is what stands before the first mark, else one digit for the zones 1 and 7, else two.
    code = F.when(F.length(_digits(value)) > 10, F.regexp_extract(value, r"^\+(1(?=[ .(-]|[0-9]{10}$)|7|[0-9]{1,3}(?=[ .()/-])|[0-9]{2})", 1)).otherwise(
        F.regexp_extract(value, r"^\+([0-9]{1,3}(?=[ .()/-])|[0-9]{2})", 1)
    )
    return (
        F.when(whole["email"], one("email", F.lower(value)))
        .when(whole["ip"], one("ip", value))
        .when(whole["ip6"], one("ip6", F.lower(value)))
        .when(whole["iban"], one("iban", F.replace(value, F.lit(" "), F.lit(""))))
        .when(whole["card"], one("card", _digits(value)))
        .when(whole["ssn"], one("ssn", _digits(value)))
        .when(whole["phone"], one("phone", F.substring(_digits(value), F.length(code) + 1, F.lit(20))))
        .otherwise(F.transform(_all(value, r"\p{L}[\p{L}\p{M}]*\.?|[^\p{L}]+"), word))
    )


def _number(key: str, place: Column | int, below: int) -> Column:
    """Number below ``below`` for a place of the entity at hand, from 60 bits of a keyed SHA-256."""
    seed = F.concat_ws("|", F.lit(key), "kind", "norm", F.col("draw").cast("string"), (place if isinstance(place, Column) else F.lit(place)).cast("string"))
    return (F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long") % below).cast("int")


_SMALL = "abcdefghijklmnopqrstuvwxyz"


def _letters(key: str, text: Column) -> Column:
    """Letters and digits of a lower-case text drawn anew in their script, all else kept."""

    def of(alphabet: str, i: Column) -> Column:
        return F.substring(F.lit(alphabet), _number(key, i, len(alphabet)) + 1, F.lit(1))

    return F.array_join(
        F.transform(
            F.filter(F.split(text, ""), lambda c: c != ""),
            lambda c, i: F.when(F.regexp(c, F.lit(r"\p{N}")), _number(key, i, 10).cast("string"))
            .when(F.regexp(c, F.lit(r"\p{IsCyrillic}")), of(ALPHABETS[1].lower(), i))
            .when(F.regexp(c, F.lit(r"\p{IsGreek}")), of("αβγδεζηθικλμνξοπρστυφχψω", i))
            .when(F.regexp(c, F.lit(r"\p{L}")), of(_SMALL, i))
            .otherwise(c),
        ),
        "",
    )


def _numerals(key: str, n: int, first: int = 0) -> Column:
    """``n`` digits, the first one at least ``first``."""
    digits = [_number(key, i, 10) for i in range(n)]
    digits[0] = first + _number(key, 0, 10 - first)
    return F.concat(*[d.cast("string") for d in digits])


def _luhn(number: Column) -> Column:
    """Sum of the Luhn rule; right if it ends in 0."""
    digits = F.transform(F.split(F.reverse(number), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d)


def _card(key: str) -> Column:
    body = F.concat(F.substring("norm", 1, 1), F.substring(_numerals(key, 17), F.lit(1), F.length("norm") - 2))
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    # A number whose check digit is wrong keeps a wrong one.
    wrong = (check + 1 + _number(key, 99, 9)) % 10
    return F.concat(body, F.when(_luhn(F.col("norm")) % 10 == 0, check).otherwise(wrong).cast("string"))


def _iban(key: str) -> Column:
    """Same country and length, letters and digits drawn, and right check digits (98 less the rest by 97)."""
    country = F.substring("norm", 1, 2)
    body = F.upper(_letters(key, F.lower(F.substring("norm", F.lit(5), F.length("norm")))))
    values = F.transform(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: F.instr(F.lit("0123456789" + _SMALL.upper()), c) - 1)
    rest = F.aggregate(values, F.lit(0), lambda r, v: F.when(v < 0, r).otherwise((r * F.when(v > 9, 100).otherwise(10) + v) % 97))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _email(key: str) -> Column:
    local, domain = F.substring_index("norm", "@", 1), F.substring_index("norm", "@", -1)
    labels = F.split(domain, r"\.")
    above = F.array_join(F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda s: _letters(key, F.concat(F.lit("h"), s))), ".")
    top = F.element_at(labels, -1)
    top = F.when(top.isin("com", "net", "org"), top).otherwise("com")
    longer = F.when(F.col("draw") >= GROW_AFTER, _numerals(key, 6)).otherwise("")
    host = F.concat(F.when(above != "", F.concat(above, F.lit("."))).otherwise(""), F.lit("example."), top)
    return F.concat(_letters(key, local), longer, F.lit("@"), host)


def _choice(key: str, place: int, words: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, words)), _number(key, place, len(words)))


def _name(key: str) -> Column:
    """A made name of the kind's ending, in the script of the norm (lower case)."""

    def of(script: str) -> Column:
        syllables, female, male, surname = SCRIPTS[script]
        start = F.concat(*[_choice(key, i, syllables) for i in range(3)])
        longer = F.when(F.col("draw") >= GROW_AFTER, _choice(key, 7, syllables)).otherwise("")
        longest = F.when(F.col("draw") >= 2 * GROW_AFTER, F.concat(_choice(key, 8, syllables), _choice(key, 9, syllables))).otherwise("")
        end = (
            F.when(F.col("kind") == "female", _choice(key, 5, female))
            .when(F.col("kind") == "male", _choice(key, 5, male))
            .otherwise(_choice(key, 5, surname))
        )
        return F.concat(start, longer, longest, end)

    return (
        F.when(F.regexp("norm", F.lit(r"\p{IsCyrillic}")), of("cyrillic"))
        .when(F.regexp("norm", F.lit(r"\p{IsGreek}")), of("greek"))
        .otherwise(of("latin"))
    )


def _drawn(key: str) -> Column:
    """The replacement of ``kind, norm`` at the draw numbered ``draw``, itself normalised."""
    octets = F.concat_ws(".", *[(1 + _number(key, i, 254)).cast("string") for i in range(4)])
    return (
        F.when(F.col("kind") == "email", _email(key))
        .when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "ip6", F.concat_ws(":", F.lit("2001:db8"), *[F.lower(F.hex(_number(key, i, 65536))) for i in range(6)]))
        .when(F.col("kind") == "iban", _iban(key))
        .when(F.col("kind") == "card", _card(key))
        # No social security number starts with 9.
        .when(F.col("kind") == "ssn", F.concat(F.lit("9"), _numerals(key, 8)))
        .when(F.col("kind") == "phone", F.substring(_numerals(key, 14, first=2), F.lit(1), F.length("norm")))
        .otherwise(_name(key))
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, norm, surrogate`` for distinct ``kind, norm``: distinct, and no entity themselves."""
    entities = stage(entities.distinct(), "entities")
    done = entities.limit(0).select("kind", "norm", F.col("norm").alias("surrogate"))
    left, draw = entities, 0
    taken = entities.select("kind", F.col("norm").alias("surrogate"))
    while not left.isEmpty():
        if draw == MAX_DRAWS:
            raise ValueError("a kind has too few replacements for its entities")
        tried = left.withColumn("draw", F.lit(draw)).withColumn("surrogate", _drawn(key))
        tried = stage(tried.select("kind", "norm", "surrogate"), "surrogates-drawn")
        free = tried.join(taken, ["kind", "surrogate"], "left_anti")
        # Of several entities with one replacement, the first keeps it.
        won = free.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm")).select("kind", "norm", "surrogate")
        won = stage(won, "surrogates")
        done = done.unionByName(won)
        taken = taken.unionByName(won.select("kind", "surrogate"))
        left = stage(tried.select("kind", "norm").join(won, ["kind", "norm"], "left_anti"), "entities-left")
        draw += 1
    return done


def _in_shape(surface: Column, kind: Column, norm: Column, made: Column) -> Column:
    """The replacement in the format of the entity's surface."""
    digits = _digits(surface)
    # Digits before the normalised ones (a country code) stay.
    all_digits = F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(norm)), made)

    def shaped(c: Column, i: Column) -> Column:
        place = F.length(_digits(F.substring(surface, F.lit(1), i + 1)))
        return F.when(F.regexp(c, F.lit("[0-9]")), F.substring(all_digits, place, F.lit(1))).otherwise(c)

    numbers = F.array_join(F.transform(F.split(surface, ""), shaped), "")
    capital = F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, F.lit(2), F.length(made)))
    loud = (surface == F.upper(surface)) & (surface != F.lower(surface))
    return (
        F.when(kind.isin("card", "ssn", "phone"), numbers)
        # An account number keeps its blanks.
        .when(kind == "iban", F.when(F.contains(surface, F.lit(" ")), F.rtrim(F.regexp_replace(made, "(.{4})", "$1 "))).otherwise(made))
        .when(kind.isin("email", "ip", "ip6"), F.when(loud, F.upper(made)).otherwise(made))
        .otherwise(F.when(loud, F.upper(made)).otherwise(capital))
    )


def _replacements(found: DataFrame, key: str) -> DataFrame:
    """``key, known`` (entity -> replacement) per text; ``found``: distinct ``key`` with ``values``."""
    entities = found.select("key", F.explode(F.filter(F.array_distinct("values"), _entity)).alias("value"))
    values = stage(entities.select("value").distinct(), "entity-values")
    parts = values.select("value", F.posexplode(_parts(F.col("value"))).alias("place", "part")).select(
        "value", "place", "part.*"
    )
    # Marks, blanks, titles and initials are the same in many names; they need no draw and no join.
    fixed = F.col("kind").isin("kept", "initial")
    drawn = parts.where(~fixed)
    made = stage(surrogates(drawn.select("kind", "norm"), key), "all-surrogates")
    step = int(hashlib.sha256(key.encode()).hexdigest(), 16)
    turned = ["".join(a[(i + 1 + step % (len(a) - 1)) % len(a)] for i in range(len(a))) for a in ALPHABETS]
    initial = F.translate("surface", "".join(ALPHABETS), "".join(turned))
    kept = parts.where(fixed).select(
        "value", F.struct("place", F.when(F.col("kind") == "initial", initial).otherwise(F.col("surface")).alias("text")).alias("part")
    )
    shaped = drawn.join(small_side(made), ["kind", "norm"]).select(
        "value",
        F.struct("place", _in_shape(F.col("surface"), F.col("kind"), F.col("norm"), F.col("surrogate")).alias("text")).alias("part"),
    )
    whole = shaped.unionByName(kept).groupBy("value").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    whole = stage(whole.select("value", F.array_join("parts.text", "").alias("replacement")), "replacements")
    pairs = entities.join(small_side(whole), "value")
    return pairs.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("value", "replacement"))).alias("known"))


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    """``row`` (all columns), ``values`` (its entities in order) and ``new`` (its text) of every document."""
    read = docs.select(F.struct("*").alias("row"), _found(F.col("text")).alias("found"))
    read = read.select("row", "found.*")
    # Written once, as the patterns cost far more than a copy of the texts.
    read = stage(read.withColumn("key", F.when(F.size("values") > 0, F.md5("row.text"))), "texts-and-entities")
    entities = F.filter("values", _entity).alias("values")
    touched = read.where("key IS NOT NULL")
    known = stage(_replacements(touched.select("key", "values").dropDuplicates(["key"]), key), "replacements-by-text")
    between = F.split("row.text", F.coalesce("pattern", F.lit(ANY)), -1)
    instead = F.concat(
        F.transform("values", lambda v: F.coalesce(F.try_element_at(F.col("known"), v), v)), F.array(F.lit(""))
    )
    new = F.array_join(F.zip_with(between, instead, lambda a, b: F.concat(a, b)), "")
    clean = read.where("key IS NULL").select("row", "values", F.col("row.text").alias("new"))
    return clean.unionByName(touched.join(known, "key", "left").select("row", entities, new.alias("new")))


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``doc_id, text`` (replaced) and ``n_entities`` of every document."""
    done = _replaced(docs.select("doc_id", "text"), key)
    return done.select("row.doc_id", F.col("new").alias("text"), F.size("values").cast("long").alias("n_entities"))


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All documents with their columns, personal data in ``text`` replaced."""
    done = _replaced(docs, key)
    return done.select(*[F.col("new").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
