"""PII surrogates: detected entities get keyed replacements of their type, script, gender and format.

An entity is a type and a canonical value (digits of a number, lower-cased address, a name's
word), so its mentions share one replacement wherever they stand. A given name has the gender that
its titles agree on. A full name that a document has once with a title is one there without it too.
Replacements are derived from a keyed hash and checked: none equals another entity's, nor any value
found in the texts; those that do are derived anew, and grow where short forms run out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written

KEY = "seedloom"
MAX_ATTEMPTS = 30
#: A name gets one syllable more every so many attempts, so that there are more names than any input has.
LONGER_EVERY = 3
#: From this attempt on numbers and secrets get one character more at each, where their own length has too few forms.
STRETCH_FROM = 8

#: Titles by gender, in the languages of the corpus and two other scripts.
MALE = "Mr|Mister|Sir|Herr|Señor|Don|Monsieur|господин|г-н|κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Señorita|Doña|Madame|Mme|Mademoiselle|госпожа|г-жа|κυρία"
NEUTRAL = "Dr|Prof"
#: Syllables that names are made of, by script; the last list ends female names, the one before male ones.
SYLLABLES = {
    "latin": (["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "ta", "ve", "ka", "lo", "mi", "pe", "du"], ["n", "r", "s", "l", "k", "d", "m", "t"], ["na", "ra", "sa", "la", "ka", "da", "ma", "ta"]),
    "cyrillic": (["ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "та", "ве", "ка", "ло", "ми", "пе", "ду"], ["н", "р", "с", "л", "к", "д", "м", "т"], ["на", "ра", "са", "ла", "ка", "да", "ма", "та"]),
    "greek": (["βα", "δε", "φι", "γο", "λυ", "μα", "νε", "ρι", "σο", "τα", "βε", "κα", "λο", "μι", "πε", "δυ"], ["ν", "ρος", "σης", "λος", "κης", "δης", "μος", "τος"], ["να", "ρα", "σα", "λα", "κα", "δα", "μα", "τα"]),
}

#: Types in the order they are tried. A pattern starts at most once in a run of word characters, so time is linear in a text.
PATTERNS = {
    "email": r"(?<![\w.%+@-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![\w])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[\w/+=.~-]{6,}+|(?<![\w])(?:AKIA|ASIA)[0-9A-Z]{16}(?![\w])|(?<![\w])gh[pousr]_[A-Za-z0-9]{20,}+|(?<![\w])sk-[A-Za-z0-9-]{20,}+",
    "iban": r"(?<![\w])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?![\w])",
    "card": r"(?<![\w.-])(?:\d{4}[ -]?){3}\d{1,4}(?![\w])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w])|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w])|(?<![\w.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w])",
    "name": rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE}|{NEUTRAL})\.?[ ]\p{{Lu}}[\p{{L}}'-]++(?:[ ]\p{{Lu}}[\p{{L}}'-]++){{0,2}}",
}
ANY = "|".join(PATTERNS.values())
DIGITS = ("card", "ssn", "phone")
#: What of a secret stays: the word and sign before it.
SECRET_HEAD = r"^((?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?|AKIA|ASIA|gh[pousr]_|sk-)"
NAME_HEAD = rf"^((?:{MALE}|{FEMALE}|{NEUTRAL})\.?[ ])"


def kind_of(mention: Column) -> Column:
    return reduce(lambda rest, k: F.when(F.rlike(mention, F.lit(f"^(?:{PATTERNS[k]})$")), F.lit(k)).otherwise(rest), reversed(PATTERNS), F.lit("secret"))


def gender(mention: Column) -> Column:
    return F.when(F.rlike(mention, F.lit(rf"^(?:{FEMALE})\.?[ ]")), "f").when(F.rlike(mention, F.lit(rf"^(?:{MALE})\.?[ ]")), "m").otherwise("n")


def script(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(value, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def parts_of(kind: Column, mention: Column) -> Column:
    """Entities in a mention, as structs (kind, value, gender): one, but for names, whose words are entities each (given names by gender, the last word a family name)."""
    head = lambda p: F.regexp_replace(mention, F.lit(p), F.lit(""))
    one = lambda v: F.array(F.struct(kind.alias("kind"), v.alias("value"), F.lit("").alias("gender")))
    names = let(F.split(head(NAME_HEAD), " "), lambda ws: F.transform(ws, lambda w, i: F.struct(F.when(i == F.size(ws) - 1, "family").otherwise("given").alias("kind"), F.lower(w).alias("value"), F.when(i == F.size(ws) - 1, "").otherwise(gender(mention)).alias("gender"))))
    return (
        F.when(kind.isin(*DIGITS), one(F.regexp_replace(mention, r"[^0-9]", "")))
        .when(kind == "iban", one(F.replace(mention, F.lit(" "), F.lit(""))))
        .when(kind == "email", one(F.lower(mention)))
        .when(kind == "secret", one(head(SECRET_HEAD)))
        .when(kind == "name", names)
        .otherwise(one(mention))
    )


def number(digest: Column, i: Column) -> Column:
    """Pseudo-random number at place ``i``, from 0 to 65535; places beyond the digest fold it with the place."""
    return (F.conv(F.substr(digest, F.pmod(i * 3, F.lit(120)) + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 40).cast("int") * 7919) % 65536


def letters(value: Column, digest: Column) -> Column:
    """Each letter or digit by another of its class (hexadecimal stays hexadecimal); signs stay."""
    hexa = F.rlike(value, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))
    pick = lambda from_, i: F.substr(F.lit(from_), number(digest, i) % len(from_) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(F.rlike(c, F.lit("[0-9]")), pick("0123456789", i))
            .when(F.rlike(c, F.lit("[a-z]")), F.when(hexa, pick("abcdef", i)).otherwise(pick("abcdefghijklmnopqrstuvwxyz", i)))
            .when(F.rlike(c, F.lit("[A-Z]")), F.when(hexa, pick("ABCDEF", i)).otherwise(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)))
            .when(F.rlike(c, F.lit(r"\p{L}")), pick("abcdefghijklmnopqrstuvwxyz", i))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn(body: Column) -> Column:
    """Check digit for a string of digits."""
    each = F.transform(F.split(F.reverse(body), ""), lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def name(value: Column, gender_: Column, digest: Column, attempt: Column) -> Column:
    extra = F.floor(attempt / LONGER_EVERY).cast("int")

    def made(of: str) -> Column:
        body, male, female = SYLLABLES[of]
        at = lambda from_, i: F.get(F.array(*map(F.lit, from_)), number(digest, i) % len(from_))
        syllable = lambda from_, i: at(from_, F.lit(i))
        longer = F.when(extra < 1, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: at(body, i * 2 + 9)), ""))
        end = F.when(gender_ == "f", syllable(female, 9)).when(gender_ == "m", syllable(male, 9)).otherwise(syllable(male + female, 9))
        return F.initcap(F.concat(syllable(body, 0), syllable(body, 3), F.when(number(digest, F.lit(6)) % 2 == 0, syllable(body, 7)).otherwise(""), longer, end))

    sc = script(value)
    return F.when(sc == "cyrillic", made("cyrillic")).when(sc == "greek", made("greek")).otherwise(made("latin"))


def surrogate(kind: Column, value: Column, gender_: Column, attempt: int, key: str) -> Column:
    """Replacement of an entity's value: as many digits or letters of the same classes; addresses are in 10.0.0.0/8 (from the fourth try on in the reserved 240.0.0.0/4, from the ninth on anywhere), social security numbers start with the unissued 9, cards keep their first digit and a valid check digit, account numbers their country, mail domains their last label."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, F.lit(str(attempt))), 512)
    more = max(0, attempt - STRETCH_FROM + 1)
    value = F.when(kind.isin("ip", "email", "given", "family"), value).otherwise(F.concat(value, F.lit("0" * more)))

    def by(d: Column) -> Column:
        mixed_ = letters(value, d)
        octet = lambda i, n=254, low=1: (number(d, F.lit(i)) % n + low).cast("string")
        body = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(mixed_, F.lit(2), F.length(value) - 2))
        mail = F.concat(letters(F.concat(F.lit("a" * more), F.regexp_extract(value, r"^(.*)(\.[^.]*)$", 1)), d), F.regexp_extract(value, r"^(.*)(\.[^.]*)$", 2))
        first = F.lit("10") if attempt < 3 else octet(3, 15, 240) if attempt < 8 else octet(3)
        return (
            F.when(kind == "ip", F.concat_ws(".", first, octet(0), octet(1), octet(2)))
            .when(kind == "card", F.concat(body, luhn(body)))
            .when(kind == "ssn", F.concat(F.lit("9"), F.substr(mixed_, F.lit(2))))
            .when(kind == "phone", F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(mixed_, F.lit(2))))
            .when(kind == "iban", F.concat(F.substr(value, F.lit(1), F.lit(2)), F.substr(mixed_, F.lit(3))))
            .when(kind == "email", mail)
            .when(kind.isin("given", "family"), name(value, gender_, d, F.lit(attempt)))
            .otherwise(mixed_)
        )

    return let(digest, by)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, gender, new): a replacement for each entity (kind, value, gender), different from all others' and from every value in the texts.

    In each round entities without one propose; of those proposing the same the smallest wins if nobody holds it. Names, numbers and secrets grow with the rounds and so do not run out. If some are left all the same (more addresses than there are), that is an error.
    """
    values = written(entities.select(F.lower("value").alias("taken")).distinct(), "values")
    open_, held = entities, None
    for attempt in range(MAX_ATTEMPTS):
        new = open_.withColumn("new", surrogate(F.col("kind"), F.col("value"), F.col("gender"), attempt, key)).withColumn("low", F.lower("new"))
        first = F.row_number().over(Window.partitionBy("low").orderBy("kind", "value", "gender"))
        new = new.withColumn("turn", first).join(values, F.col("low") == F.col("taken"), "left")
        ok = (F.col("turn") == 1) & F.col("taken").isNull()
        if held is not None:
            new = new.join(held.select(F.col("low").alias("held")), F.col("low") == F.col("held"), "left")
            ok = ok & F.col("held").isNull()
        tried = written(new.select("kind", "value", "gender", "new", "low", ok.alias("ok")), "tried")
        won = tried.filter("ok").drop("ok")
        held = won if held is None else held.union(won)
        open_ = tried.filter("not ok").select("kind", "value", "gender")
        if open_.isEmpty():
            return held.drop("low")
    raise RuntimeError("entities are left without a replacement")


def shaped(kind: Column, mention: Column, new: Column) -> Column:
    """A mention with the replacements of its parts, in its own format."""
    def placed(v: Column, sign: str) -> Column:
        """Characters of ``v`` at the mention's places of a sign, one by one; what is longer follows."""
        rest = lambda c, i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), F.lit(f"(?!{sign})."), F.lit("")))
        chars = F.transform(F.split(mention, ""), lambda c, i: F.when(F.rlike(c, F.lit(sign)), F.substr(v, rest(c, i), F.lit(1))).otherwise(c))
        return F.concat(F.array_join(chars, ""), F.substr(v, F.length(F.regexp_replace(mention, F.lit(f"(?!{sign})."), F.lit(""))) + 1))

    digits, blocks = (lambda v: placed(v, "[0-9]")), (lambda v: placed(v, "[^ ]"))
    one = F.get(new, F.lit(0))
    head = lambda p: F.regexp_extract(mention, p, 1)
    return F.when(kind.isin(*DIGITS), digits(one)).when(kind == "iban", blocks(one)).when(kind == "secret", F.concat(head(SECRET_HEAD), one)).when(kind == "name", F.concat(head(NAME_HEAD), F.array_join(new, " "))).otherwise(one)


def bare_names(found: Column) -> Column:
    """Full names, of two words or more, that stand behind a title in these mentions."""
    names = F.filter(found, lambda m: F.rlike(m, F.lit(f"^(?:{PATTERNS['name']})$")))
    return F.array_distinct(F.filter(F.transform(names, lambda m: F.regexp_replace(m, F.lit(NAME_HEAD), F.lit(""))), lambda n: F.contains(n, F.lit(" "))))


def pseudonymized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """Per document: id, n_entities (mentions), kinds (their types in order), text with surrogates.

    The same entity has the same surrogate in all documents, and different entities different
    ones. A full name behind a title is replaced where the document has it without one, too. Null
    texts stay null with no entities; texts without any stay as they are. Each row gives a row,
    repeated rows alike. Other columns are not read.

    Texts are searched once, and written with what was found; only those with names are again.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    none = F.array().cast("array<string>")
    rows = written(own.withColumn("found", F.coalesce(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), none)), "found")
    with_some = rows.filter(F.size("found") > 0).withColumn("key", F.md5("text")).withColumn("bare", bare_names(F.col("found")))
    with_some = with_some.withColumn("pattern", F.when(F.size("bare") > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}])(?:"), F.array_join(F.reverse(F.array_sort("bare")), "|"), F.lit(r")(?![\p{L}])"))))
    with_some = with_some.withColumn("found", F.when(F.col("pattern").isNull(), F.col("found")).otherwise(F.regexp_extract_all("text", "pattern", F.lit(0))))
    mentions = with_some.select("key", "found", "bare").dropDuplicates(["key"]).select("key", "bare", F.posexplode("found").alias("at", "mention"))
    kind = F.when(F.array_contains("bare", F.col("mention")), "name").otherwise(kind_of(F.col("mention")))
    mentions = written(mentions.select("key", "at", "mention", kind.alias("kind")), "mentions")
    forms = mentions.select("kind", "mention").distinct().withColumn("parts", parts_of(F.col("kind"), F.col("mention")))
    parts = written(forms.select(F.col("kind").alias("of"), "mention", F.posexplode("parts").alias("i", "part")).select("of", "mention", "i", "part.*"), "parts")
    female, male = (F.max((F.col("gender") == g).cast("int")) for g in "fm")
    entities = parts.groupBy("kind", "value").agg((female - male).alias("lean")).select("kind", "value", F.when(F.col("kind") != "given", "").when(F.col("lean") > 0, "f").when(F.col("lean") < 0, "m").otherwise("n").alias("gender"))
    new = assigned(entities, key).select(F.col("kind").alias("nk"), F.col("value").alias("nv"), "new")
    shapes = parts.join(new, (F.col("kind") == F.col("nk")) & (F.col("value") == F.col("nv")))
    shapes = shapes.groupBy("of", "mention").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]).alias("new"))
    shapes = shapes.select(F.col("of").alias("sk"), F.col("mention").alias("sm"), shaped(F.col("of"), F.col("mention"), F.col("new")).alias("shape"))
    told = mentions.join(shapes, (F.col("kind") == F.col("sk")) & (F.col("mention") == F.col("sm")))
    told = told.groupBy(F.col("key").alias("tk")).agg(F.array_sort(F.collect_list(F.struct("at", "kind", "shape"))).alias("told"))
    between = F.when(F.col("pattern").isNull(), F.split("text", ANY, -1)).otherwise(F.split(F.col("text"), F.col("pattern"), F.lit(-1)))
    text = F.array_join(F.flatten(F.zip_with(between, "told", lambda gap, t: F.array(gap, F.coalesce(t["shape"], F.lit(""))))), "")
    changed = with_some.join(told, F.col("key") == F.col("tk")).select("id", F.size("found").cast("bigint").alias("n"), F.transform("told", lambda x: x["kind"]).alias("kinds"), text.alias("text"))
    same = rows.filter(F.size("found") == 0).select("id", F.lit(0).cast("bigint").alias("n"), none.alias("kinds"), "text")
    return changed.union(same).select(F.col("id").alias(id_col), F.col("n").alias("n_entities"), "kinds", "text")
