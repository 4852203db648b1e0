"""Personal data: detected entities get keyed surrogates of the same type, in DataFrame functions only.

Found are e-mail addresses, IPv4 addresses, payment cards (in their usual groupings, with a right check digit), phone numbers,
social security numbers, IBANs, and names after a title; in a text with such a name also each further mention of one of its
words, with a title, another one or none. A surrogate is drawn from a keyed hash of the entity's normal form and an attempt.
It has the entity's type and format: cards keep their first digit, length and a right check digit, phones their country
code, IBANs their country. Names are replaced word by word, so that a short mention agrees with the long one; a word's
surrogate has its script, its capitals if it has nothing else, and an ending of the title's gender. A title without a gender
takes that of another mention in the text. Mentions are words alike but for case: after "Mr. May" the month is replaced, too. Written forms of one entity get one surrogate, each in its own format.

All distinct entities of a type are checked together: an attempt is taken if no other entity draws the same surrogate
before (of equal draws the entity that sorts first wins) and the surrogate isn't itself an entity of the corpus; else the next
attempt is drawn, for names from a longer and longer space, for addresses and social security numbers at last from the whole
one. Only a type with more entities than it has values stops the job. Texts without an entity are passed through as they are
and are never shuffled.

Null texts stay null and have no entities, empty texts stay empty. Repeated rows get the same text each; null doc_ids pass
through; empty tables give no rows; very long texts are read whole. A column n_entities in docs is replaced, all others are
kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import inside, outside, written

#: Fixed patterns, in the order in which they are tried at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}(?: [0-9]{3})?|[0-9]{4}(?:-[0-9]{4}){3}(?:-[0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9](?: [0-9]){12,18}|[0-9](?:-[0-9]){12,18})(?!-?[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
MALE = r"Mr|Sir|Herr|Monsieur|Señor|г-н"
FEMALE = r"Mrs|Miss|Ms|Frau|Madame|Mme|Señora|г-жа"
NEUTRAL = r"Dr|Prof|Professor|Doktor|Docteur|д-р"
TITLE = rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.? "
#: A name's word: letters with a first capital, capitals inside (McDonald, SMITH), and apostrophes before one (O'Brien).
WORD = r"\p{Lu}['’]?[\p{L}\p{M}]++(?:['’]\p{Lu}[\p{L}\p{M}]*+)*+(?![\p{L}\p{N}])"
NAME = rf"(?<![\p{{L}}\p{{N}}-]){TITLE}{WORD}(?:[ -]{WORD}){{0,2}}"
PATTERN = "|".join((EMAIL, IP, IBAN, CARD, SSN, PHONE, NAME))
#: A word that may be a name's, unless an address begins in it.
BARE = rf"(?<![\p{{L}}\p{{N}}]){WORD}(?![A-Za-z0-9._%+-]*@)"
#: Whatever PATTERN finds holds one of these.
HINT = rf"[0-9][ .-]?[0-9]|@|{TITLE}\p{{Lu}}"
#: Fixed parts of invented names, by script.
PARTS = {
    "Latin": ("ba", "der", "fel", "gor", "hal", "jen", "kor", "lin", "mar", "nor", "pol", "rus", "sel", "tam", "vel", "wes"),
    "Cyrillic": ("ба", "вор", "гал", "дем", "жин", "зор", "кал", "лев", "мир", "нов", "пол", "рус", "сав", "тим", "чер", "юр"),
    "Greek": ("βαρ", "γον", "δελ", "ζημ", "θαν", "καλ", "λερ", "μιν", "νορ", "παλ", "ρηγ", "σολ", "τιμ", "φερ", "χαν", "ψηλ"),
}
ENDINGS = {"Latin": ("a", ""), "Cyrillic": ("ова", "ов"), "Greek": ("α", "ος")}
#: From this attempt on, types with a reserved space draw from all values; beyond the last one a type has no free value.
WHOLE_SPACE, MOST_ATTEMPTS = 8, 200


def kind(m: Column) -> Column:
    """The type of a match, null for digits that only look like a card."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    bare = m.rlike("^[0-9][0-9 -]*$")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(bare & F.length(digits).between(13, 19), F.when(luhn(digits) % 10 == 0, "card"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^[+(0-9]"), "phone")
    )


def luhn(digits: Column) -> Column:
    """The sum whose last digit a valid number has as 0."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def normal(m: Column, type_: Column) -> Column:
    """What the written forms of one entity share."""
    return F.when(type_ == "email", F.lower(m)).when(type_ == "ip", m).when(type_ == "iban", F.replace(m, F.lit(" "), F.lit(""))).otherwise(F.regexp_replace(m, "[^0-9]", ""))


def gender(m: Column) -> Column:
    """Of a title: m, f, or n where it says nothing."""
    return F.when(m.rlike(rf"^(?:{MALE})\.? "), "m").when(m.rlike(rf"^(?:{FEMALE})\.? "), "f").otherwise("n")


def alike(w: Column) -> Column:
    """A name's word without regard to case and the form of its apostrophes."""
    return F.lower(F.translate(w, "’", "'"))


def name_words(m: Column) -> Column:
    return F.split(F.regexp_replace(m, f"^{TITLE}", ""), "[ -]")


def surrogate(key: str, attempt: Column, type_: str = "type", entity: str = "entity") -> Column:
    """The attempt-th surrogate of an entity's normal form, itself a normal form."""
    e = F.col(entity)
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), F.col(type_), e, attempt.cast("string")), 256)

    def byte(i: Column) -> Column:
        return F.conv(F.substring(stream, (2 * (i % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")

    def drawn(text: Column, keep: Column | None = None) -> Column:
        def one(c, i):
            alike = F.when(c.rlike("[0-9]"), (byte(i) % 10).cast("string")).when(c.rlike("[a-z]"), F.chr(97 + byte(i) % 26)).when(c.rlike("[A-Z]"), F.chr(65 + byte(i) % 26)).otherwise(c)
            return alike if keep is None else F.when(i < keep, c).otherwise(alike)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    body = drawn(F.substring(e, F.lit(1), F.length(e) - 1), F.lit(1))
    card = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    octets = F.concat_ws(".", F.when(attempt < WHOLE_SPACE, 240 + byte(F.lit(0)) % 15).otherwise(byte(F.lit(0))).cast("string"), *((byte(F.lit(i)) % 256).cast("string") for i in (1, 2, 3)))
    email = F.concat(drawn(F.substring_index(e, "@", 1)), F.lit("@"), F.array_join(F.transform(F.sequence(F.lit(20), F.lit(27)), lambda i: F.chr(97 + byte(i) % 26)), ""), F.lit(".example.net"))
    iban = F.concat(F.substring(e, 1, 2), F.lit("00"), drawn(F.substring(e, F.lit(5), F.length(e))))
    ssn = F.when(attempt < WHOLE_SPACE, F.concat(F.lit("9"), F.substring(drawn(e), 2, 8))).otherwise(drawn(e))
    name = F.concat(F.substring(e, 1, 2), _invented(e, byte, attempt))
    kinds = {"email": email, "ip": octets, "iban": iban, "card": card, "ssn": ssn, "name": name}
    out = F.lit(None).cast("string")
    for k, v in kinds.items():
        out = F.when(F.col(type_) == k, v).otherwise(out)
    # a phone's country code is what stands before its last ten digits
    return F.when(F.col(type_) == "phone", drawn(e, F.greatest(F.length(e) - 10, F.lit(0)))).otherwise(out)


def _invented(e: Column, byte, attempt: Column) -> Column:
    """A word of the entity's script with an ending of its gender, longer with each attempt."""
    def body(script: str) -> Column:
        table = F.array(*map(F.lit, PARTS[script]))
        return F.array_join(F.transform(F.sequence(F.lit(0), 3 + attempt), lambda j: F.get(table, (byte(j) + F.floor(j / 32)).cast("int") % 16)), "")

    out = F.lit(None).cast("string")
    for script in PARTS:
        female, male = ENDINGS[script]
        word = F.concat(body(script), F.when(e.startswith("f"), female).when(e.startswith("m"), male).otherwise(""))
        out = word if script == "Latin" else F.when(e.rlike(rf"\p{{Is{script}}}"), word).otherwise(out)
    return out


def written_as(m: str, type_: str, chosen: str) -> Column:
    """A surrogate in the format of an occurrence."""
    spots = F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[0-9A-Z]") & (c.rlike("[0-9]") | (F.col(type_) == "iban")), F.length(F.regexp_replace(F.substring(F.col(m), F.lit(1), i + 1), F.when(F.col(type_) == "iban", "[^0-9A-Z]").otherwise("[^0-9]"), ""))).otherwise(0))
    placed = F.array_join(F.zip_with(F.split(m, ""), spots, lambda c, n: F.when(n > 0, F.substring(F.col(chosen), n, F.lit(1))).otherwise(c)), "")
    word = F.substring(F.col(chosen), F.lit(3), F.length(chosen))
    return F.when(F.col(type_).isin("email", "ip"), F.col(chosen)).when(F.col(type_) == "name", F.when(F.col(m) == F.upper(m), F.upper(word)).otherwise(F.initcap(word))).otherwise(placed)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """type, entity, surrogate: distinct surrogates, none of them an entity of the same type. entities: distinct type and entity."""
    real = entities.select("type", F.col("entity").alias("surrogate"))
    settled, left, attempt = None, entities, 0
    while True:
        drawn = left.withColumn("surrogate", surrogate(key, F.lit(attempt)))
        drawn = drawn.join(real, ["type", "surrogate"], "left_anti")
        if settled is not None:
            drawn = drawn.join(settled.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        first = written(drawn.groupBy("type", "surrogate").agg(F.min("entity").alias("entity")).select("type", "entity", "surrogate"))
        settled = first if settled is None else settled.unionAll(first)
        left = written(left.join(first, ["type", "entity"], "left_anti"))
        attempt += 1
        if left.isEmpty():
            return settled
        if attempt == MOST_ATTEMPTS:
            raise RuntimeError(f"no free surrogates for some entities after {attempt} attempts")


def _by_pattern(f, text: Column) -> Column:
    """f of the text and the pattern to look for: with single words where the text has a name."""
    return F.when(F.col("named"), f(text, F.lit(f"{PATTERN}|{BARE}"))).otherwise(f(text, F.lit(PATTERN)))


def entities(texts: DataFrame) -> DataFrame:
    """d, t, pos, wi, before, m, after, type, entity: the entity at each match, or each word of a name there. texts: d, t, in_text, named.

    A word whose title tells no gender, or that has none, stands for the entity of its first mention with a gender in its text, or
    else of its first one; words meet their mentions as rows.
    """
    df = texts.withColumn("ms", _by_pattern(lambda x, p: F.regexp_extract_all(x, p, F.lit(0)), F.col("in_text")))

    def pieces(m: Column, pos: Column) -> Column:
        none, separators = F.lit(""), F.regexp_extract_all(F.regexp_replace(m, f"^{TITLE}", ""), F.lit("[ -]"), F.lit(0))
        piece = lambda wi, before, w, after, type_, entity, says: F.struct(pos.alias("pos"), wi.alias("wi"), before.alias("before"), w.alias("m"), after.alias("after"), type_.alias("type"), entity.alias("entity"), says.alias("says"))
        name = F.transform(name_words(m), lambda w, j: piece(j, F.when(j == 0, F.regexp_extract(m, f"^{TITLE}", 0)).otherwise(""), w, F.coalesce(F.get(separators, j), none), F.lit("name"), alike(w), gender(m)))
        word = F.array(piece(F.lit(0), none, m, none, F.lit("name"), alike(m), none))
        other = F.array(piece(F.lit(0), none, m, none, kind(m), normal(m, kind(m)), F.lit(None).cast("string")))
        return F.when(m.rlike(f"^{TITLE}"), name).when(m.rlike(f"^{WORD}$"), word).otherwise(other)

    all_ = df.select("d", "t", F.explode(F.transform("ms", pieces)).alias("x")).select("d", "t", F.inline("x")).filter("type IS NOT NULL AND entity IS NOT NULL").distinct()
    all_ = written(all_)  # the patterns run once
    shown = ["d", "t", "pos", "wi", "before", "m", "after", "type"]
    plain = all_.filter("says IS NULL").select(*shown, "entity")
    words = all_.filter("says IS NOT NULL")
    first = F.min(F.struct((F.col("says") == "n").alias("unsure"), "pos", "wi", "says"))
    known = words.filter("says <> ''").groupBy(F.col("d").alias("kd"), F.col("t").alias("kt"), F.col("entity").alias("ke")).agg(first.alias("first"))
    told = words.join(known, F.col("d").eqNullSafe(F.col("kd")) & (F.col("t") == F.col("kt")) & (F.col("entity") == F.col("ke")))
    says = F.when(F.col("says").isin("", "n"), F.col("first.says")).otherwise(F.col("says"))
    return plain.unionByName(told.select(*shown, F.concat(says, F.lit(":"), "entity").alias("entity")))


def _by_place(pairs: Column) -> Column:
    """An array with each pair's text at its place, and null at all others. pairs: (pos, shown) in order, each place once."""
    back = lambda k: F.when(k > 0, F.get(pairs, k - 1)["pos"]).otherwise(-1)
    return F.flatten(F.transform(pairs, lambda x, k: F.concat(F.array_repeat(F.lit(None).cast("string"), x["pos"] - back(k) - 1), F.array(x["shown"]))))


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs with text rewritten and n_entities, the number of places in it that were replaced. key: whoever has it can redo the surrogates."""
    own = inside(docs, "n_entities")
    maybe = F.coalesce(F.col("in_text").rlike(HINT), F.lit(False))
    clean = own.filter(~maybe).withColumn("n_entities", F.lit(0).cast("long"))
    some = own.filter(maybe).withColumns({"d": F.col("in_doc_id"), "t": F.xxhash64("in_text"), "named": F.col("in_text").rlike(NAME)})
    found = written(entities(some.select("d", "t", "in_text", "named")))
    chosen = assign(written(found.select("type", "entity").distinct()), key)
    shown = found.join(chosen, ["type", "entity"]).select("d", "t", "pos", "wi", F.concat("before", written_as("m", "type", "surrogate"), "after").alias("shown"))
    whole = shown.groupBy("d", "t", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("wi", "shown"))), lambda x: x["shown"]), "").alias("shown"))
    by_doc = whole.groupBy(F.col("d").alias("bd"), F.col("t").alias("bt")).agg(F.sort_array(F.collect_list(F.struct("pos", "shown"))).alias("all"))
    joined = some.join(by_doc, F.col("d").eqNullSafe(F.col("bd")) & (F.col("t") == F.col("bt")), "left").withColumn("placed", _by_place(F.col("all")))
    joined = joined.withColumn("between", _by_pattern(lambda x, p: F.split(x, p, -1), F.col("in_text"))).withColumn("ms", _by_pattern(lambda x, p: F.regexp_extract_all(x, p, F.lit(0)), F.col("in_text")))
    # what is shown at each match: a surrogate, or itself; the two arrays are read side by side, as a lambda's body would make placed anew for each match
    joined = joined.withColumn("put", F.zip_with("ms", "placed", lambda m, shown: F.coalesce(shown, m)))
    woven = F.concat(F.get("between", F.lit(0)), F.array_join(F.zip_with("put", F.slice("between", F.lit(2), F.size("put")), lambda shown, rest: F.concat(shown, rest)), ""))
    places = F.size("all").cast("long")
    out = joined.withColumn("in_text", F.when(F.col("all").isNull(), F.col("in_text")).otherwise(woven)).withColumn("n_entities", F.when(F.col("all").isNull(), 0).otherwise(places))
    both = clean.unionByName(out.select(*clean.columns))
    return both.select(*outside(both), "n_entities")
