"""Surrogates for personal data, with DataFrame functions only.

Found are e-mail addresses, telephone, payment-card, social-security and bank-account numbers, IPv4 addresses, access keys
and names behind a title. Each entity (its canonical form: digits alone, or lower case) gets a replacement that only
the key decides, so every mention of it, in any format and document, gets the same one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import free, release, saved

#: Titles, by the gender that they tell.
MALE = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа")
NEUTRAL = ("Dr", "Prof")

#: The parts that surrogate names are made of, by script, and endings of first names by gender.
PARTS = {
    "latin": ("ba", "ce", "di", "fo", "ga", "he", "jo", "ka", "li", "ma", "ne", "pa", "ro", "sa", "te", "vi"),
    "cyrillic": ("ба", "ве", "го", "ди", "жа", "зо", "ка", "ле", "ми", "но", "па", "ро", "са", "те", "фи", "ша"),
    "greek": ("βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "φε", "χι", "ψο"),
}
ENDINGS = {
    "latin": {"male": ("rd", "us"), "female": ("na", "lia"), "neutral": ("n", "ri"), "last": ("son", "ker")},
    "cyrillic": {"male": ("н", "р"), "female": ("на", "лия"), "neutral": ("ль", "ри"), "last": ("нов", "ский")},
    "greek": {"male": ("ς", "ρος"), "female": ("νη", "λια"), "neutral": ("ν", "ρι"), "last": ("ίδης", "όπουλος")},
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w-])[3-6]\d{3}(?:[ -]?\d{4}){3}(?![\w-])|(?<![\w-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "key": r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)",
    "hex": r"(?<=[\"'=: ])(?=[a-fA-F]*+\d)(?=\d*+[a-fA-F])[0-9a-fA-F]{40}(?!\w)",
    "name": rf"(?<!\p{{L}})(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? \p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?",
}
MENTION = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No mention without one of these.
HINT = r"[@0-9]|AKIA|\b(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\b"
DIGITS = ("ssn", "phone", "card")


#: What a key looks like in a plan; :func:`hide_keys` has Spark leave it out wherever plans are shown or logged.
SHOWN = r"pii-key-[0-9a-f]{64}"


def _secret(key: str) -> Column:
    """A literal that depends on the key but does not tell it."""
    return F.lit("pii-key-" + hashlib.sha256(b"surrogates\x01" + key.encode()).hexdigest())


def hide_keys(spark: SparkSession) -> None:
    if not spark.conf.get("spark.sql.redaction.string.regex", None):
        spark.conf.set("spark.sql.redaction.string.regex", SHOWN)


def keyed(key: str, *parts: Column) -> Column:
    """128 hex digits that only who has the key can compute: a keyed hash of a keyed hash."""
    message = F.concat_ws("\u0001", _secret(key), *parts)
    return F.sha2(F.concat_ws("\u0001", _secret(key), F.sha2(message, 256)), 512)


def sealed(key: str, value: Column) -> Column:
    """Equal values have equal sealed forms; whatever is stored or shuffled of an entity is sealed."""
    return F.base64(F.aes_encrypt(value, F.unhex(F.sha2(_secret(key), 256)), F.lit("ECB")))


def opened(key: str, value: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), F.unhex(F.sha2(_secret(key), 256)), F.lit("ECB")).cast("string")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often the result refers to it."""
    return F.transform(F.array(value), then)[0]


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substr(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(first: int, n: int, b: Column) -> Column:
    return F.char((F.lit(first) + b % n).cast("long"))


def _digit_from(h: Column, i: Column) -> Column:
    return (_byte(h, i) % 10).cast("string")


def _restyled(value: Column, h: Column) -> Column:
    """Digits for digits and letters for letters of the same case; other characters stay."""
    each = lambda c, i: (
        F.when(c.between("0", "9"), _digit_from(h, i)).when(c.between("a", "z"), _letter(97, 26, _byte(h, i) + i)).when(c.between("A", "Z"), _letter(65, 26, _byte(h, i) + i)).otherwise(c)
    )
    return F.array_join(F.transform(F.split(value, ""), each), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check that payment cards carry, modulo 10."""
    doubled = lambda c, i: F.when(i % 2 == 1, F.when(c > 4, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    values = F.transform(F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int")), doubled)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _made_name(h: Column, kind: Column, attempt: Column) -> Column:
    """Three parts and an ending in the name's script, the ending by gender; one more part after each collision. Null for other kinds."""
    many = lambda xs: F.array(*map(F.lit, xs))
    parts, endings = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
    for script in PARTS:
        parts = F.when(kind.endswith(f"_{script}"), many(PARTS[script])).otherwise(parts)
        for gender, known in ENDINGS[script].items():
            endings = F.when(kind == f"name_{gender}_{script}", many(known)).otherwise(endings)

    def put(x: Column) -> Column:
        one = lambda i: F.element_at(x["parts"], _byte(h, F.when(i < 3, i).otherwise(i + 1)) % F.size(x["parts"]) + 1)  # noqa: E731  byte 3 decides the ending
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), one), ""), F.element_at(x["endings"], _byte(h, F.lit(3)) % F.size(x["endings"]) + 1))

    return _let(F.struct(parts.alias("parts"), endings.alias("endings")), put)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The replacement of an entity in canonical form, after so many collisions.

    Where a kind has few surrogates the attempts widen its space: names get a part and mailboxes a letter for each, telephone numbers
    a digit for every fourth; private addresses move to 10.0.0.0/8 from the 16th and to any address from the 32nd.
    """
    return _let(_given(key, kind, canon, attempt), lambda x: _surrogate(key, x["kind"], x["canon"], x["h"], x["attempt"]))


def _given(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return F.struct(kind.alias("kind"), canon.alias("canon"), attempt.cast("int").alias("attempt"), keyed(key, kind, canon, attempt.cast("string")).alias("h"))


def _surrogate(key: str, kind: Column, canon: Column, h: Column, attempt: Column) -> Column:
    more = lambda n, each: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), each), "")

    def numbers(keep: Column, low: Column) -> Column:
        first = (low + _byte(h, keep) % (F.lit(10) - low)).cast("string")
        return F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(i < keep, c).when(i == keep, first).otherwise(_digit_from(h, i))), "")

    keep = F.when(kind == "ssn", 0).otherwise(1)
    low = F.when(kind == "phone", 2).when(kind == "ssn", 1).otherwise(0)
    checked = lambda stem: F.concat(stem, F.pmod(_luhn(canon) - _luhn(F.concat(stem, F.lit("0"))), F.lit(10)).cast("string"))
    number = _let(numbers(keep, low), lambda n: F.when(kind == "card", _let(F.substr(n, F.lit(1), F.length(n) - 1), checked)).when(kind == "phone", F.concat(n, more(F.floor(attempt / 4).cast("int"), lambda i: _digit_from(h, 63 - i)))).otherwise(n))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(_restyled(local, h), more(attempt, lambda i: _letter(97, 26, _byte(h, 64 - i))), F.lit("@"), _let(host, lambda x: _let(keyed(key, F.lit("host"), x), lambda k: _restyled(x, k))), top)
    private = F.regexp_extract(canon, r"^(10|192\.168|172\.(?:1[6-9]|2\d|3[01])|127)\.", 1)
    private = F.when((attempt < 16) | (private == ""), private).when(attempt < 32, "10").otherwise("")
    octet = lambda p: lambda c, i: F.when((p != "") & (i < F.size(F.split(p, r"\."))), F.get(F.split(p, r"\."), i)).otherwise((_byte(h, i) * 7 % 254 + 1).cast("string"))
    ip = _let(private, lambda p: F.array_join(F.transform(F.split(canon, r"\."), octet(p)), "."))
    country, account = F.substr(canon, F.lit(1), F.lit(2)), _restyled(F.substr(canon, F.lit(5)), h)
    iban = _let(account, lambda x: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind.isin(*DIGITS), number)
        .when(kind == "iban", iban)
        .when(kind == "key", F.concat(F.lit("AKIA"), _restyled(F.substr(canon, F.lit(5)), h)))
        .when(kind == "hex", F.substr(h, F.lit(1), F.length(canon)))
        .otherwise(F.coalesce(_made_name(h, kind, attempt), canon))
    )


def kind_of(mention: Column) -> Column:
    whole = lambda name: mention.rlike(f"^(?:{PATTERNS[name]})$")
    return (
        F.when(F.contains(mention, F.lit("@")), "email")
        .when(mention.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(whole("ssn"), "ssn")
        .when(mention.startswith("AKIA"), "key")
        .when(mention.rlike("^[0-9a-fA-F]{40}$"), "hex")
        .when(mention.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(mention.rlike(r"^\p{L}"), "name")
        .when(whole("card"), "card")
        .otherwise("phone")
    )


def _canon(kind: Column, mention: Column) -> Column:
    return F.when(kind.isin(*DIGITS), F.regexp_replace(mention, r"\D", "")).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind.isin("email", "hex"), F.lower(mention)).otherwise(mention)


def _name_kind(word: Column, gender: Column) -> Column:
    script = F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    return F.concat_ws("_", F.lit("name"), gender, script)


def _name_words(mention: Column) -> list[tuple[Column, Column]]:
    """(kind, word) of a name's first name, null without one, and last name."""
    words = F.split(mention, " ")
    title = F.regexp_replace(words[0], r"\.$", "")
    gender = F.when(title.isin(*MALE), "male").when(title.isin(*FEMALE), "female").otherwise("neutral")
    first = F.when(F.size(words) == 3, words[1])
    last = F.element_at(words, -1)
    return [(_name_kind(first, gender), first), (_name_kind(last, F.lit("last")), last)]


def entities(mention: Column) -> Column:
    """array of (kind, canon) of a mention: one, or the parts of a name."""

    def of(kind: Column) -> Column:
        names = F.array(*[F.struct(k.alias("kind"), F.lower(w).alias("canon")) for k, w in _name_words(mention)])
        one = F.array(F.struct(kind.alias("kind"), _canon(kind, mention).alias("canon")))
        return F.filter(F.when(kind == "name", names).otherwise(one), lambda e: e["canon"].isNotNull())

    return _let(kind_of(mention), of)


def _cased(like: Column, value: Column) -> Column:
    return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(value)).otherwise(F.initcap(value))


def _shaped(mention: Column, kind: Column, plain: Column) -> Column:
    """A surrogate in canonical form with the mention's separators and capitals."""
    each = lambda f: F.array_join(F.transform(F.split(mention, ""), f), "")
    to = lambda i: F.substr(mention, F.lit(1), i + 1)
    at = lambda n: F.substr(plain, n, F.lit(1))
    digits = each(lambda c, i: F.when(c.between("0", "9"), at(F.length(F.regexp_replace(to(i), r"\D", "")))).otherwise(c))
    count = F.length(F.regexp_replace(mention, r"\D", ""))
    digits = F.concat(digits, F.substr(plain, count + 1, F.length(plain)))
    extra = F.length(plain) - F.length(mention)  # letters that attempts put behind a mailbox
    behind = lambda i: F.when(i < F.instr(mention, "@") - 1, i + 1).otherwise(i + 1 + extra)
    letters = each(lambda c, i: F.when(c == "@", F.substr(plain, i + 1, extra + 1)).when(c.between("A", "Z"), F.upper(at(behind(i)))).otherwise(at(behind(i))))
    spaced = each(lambda c, i: F.when(c == " ", c).otherwise(at(F.length(F.replace(to(i), F.lit(" "), F.lit(""))))))
    return F.when(kind.isin(*DIGITS), digits).when(kind == "email", letters).when(kind == "iban", spaced).when((kind == "hex") & (mention == F.upper(mention)), F.upper(plain)).otherwise(plain)


def _tried(key: str, kind: Column, canon: Column, attempts: Column) -> Column:
    return F.coalesce(F.try_element_at(attempts, F.concat_ws(" ", kind, sealed(key, canon))), F.lit(0))


def _new_name(key: str, kind: Column, word: Column, attempts: Column) -> Column:
    """:func:`surrogate` of a name's word, with the word's capitals."""
    return _cased(word, _let(_given(key, kind, F.lower(word), _tried(key, kind, F.lower(word), attempts)), lambda x: _made_name(x["h"], x["kind"], x["attempt"])))


def rendered(key: str, mention: Column, attempts: Column) -> Column:
    """The surrogate in the mention's own format. ``attempts`` maps ``kind canon``, sealed, to its number of collisions."""
    words = F.split(mention, " ")
    named = lambda e, i, n: _new_name(key, e["kind"], F.element_at(words, i - n), attempts)

    def put(x: Column) -> Column:
        name = F.concat_ws(" ", words[0], F.array_join(F.transform(x["e"], lambda e, i: named(e, i, F.size(x["e"]))), " "))
        one = x["e"][0]
        other = _let(surrogate(key, one["kind"], one["canon"], _tried(key, one["kind"], one["canon"], attempts)), lambda plain: _shaped(mention, x["kind"], plain))
        return F.when(x["kind"] == "name", name).otherwise(other)

    return _let(F.struct(kind_of(mention).alias("kind"), entities(mention).alias("e")), put)


def _real(mention: Column) -> Column:
    """Whether a match is a mention: what has the form of a payment card must have its check digit."""
    return ~mention.rlike(f"^(?:{PATTERNS['card']})$") | (_luhn(F.regexp_replace(mention, r"\D", "")) == 0)


def mentions(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.filter(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), _real)).otherwise(F.array().cast("array<string>"))


def collisions(found: DataFrame, key: str, most: int = 64) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate would not do; canon is sealed here and in ``found``.

    A surrogate must differ from that of every other entity of its kind and from every real one. Of entities with the
    same one the first keeps it and the others try again, until none is left; raises after ``most`` rounds.
    """
    known = table = saved(found.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)), "entities")
    made = sealed(key, surrogate(key, F.col("kind"), opened(key, F.col("canon")), F.col("attempt")))
    for _ in range(most):
        tried = known.withColumn("sur", made)
        order = Window.partitionBy("kind", "sur").orderBy("attempt", "canon")
        real = known.select(F.col("kind").alias("real_kind"), F.col("canon").alias("real"))
        checked = tried.withColumn("nth", F.row_number().over(order)).join(real, (F.col("kind") == F.col("real_kind")) & (F.col("sur") == F.col("real")), "left")
        again = F.when((F.col("nth") > 1) | F.col("real").isNotNull(), 1).otherwise(0)
        former, table = table, saved(checked.select("kind", "canon", (F.col("attempt") + again).alias("attempt"), again.alias("again")), "entities")
        release(former)
        if table.where("again = 1").isEmpty():
            return table.where("attempt > 0").select("kind", "canon", "attempt")
        known = table.drop("again")
    raise ValueError("there are too few surrogates of some kind")


def _rewritten(key: str, text: Column, attempts: Column) -> Column:
    """(text, n): a text with surrogates and the number of mentions replaced.

    Parts come by turns: text, mention, text and so on. Names found in a document are then looked for in its other parts, so "Smith"
    and "John Smith" follow "Mr. John Smith"; as written there or in capitals, but not in lower case, where they may be common words.
    """
    plain = lambda s: F.array(F.struct(s.alias("s"), F.lit(0).alias("n")))
    done = lambda s: F.array(F.struct(s.alias("s"), F.lit(1).alias("n")))

    def named(part: Column, known: Column) -> Column:
        """A part between mentions, with the known names in it replaced."""
        forms = F.flatten(F.transform(known, lambda k: F.array(k["word"], F.upper(k["word"]))))
        pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(forms, "|"), F.lit(r")(?!\p{L})"))
        kind = lambda w: F.filter(known, lambda k: F.lower(k["word"]) == F.lower(w))[0]["kind"]
        each = lambda w, i: F.when(i % 2 == 0, plain(w)).otherwise(done(_new_name(key, kind(w), w, attempts)))
        return F.flatten(F.transform(F.split(F.regexp_replace(part, pattern, F.lit("\u0001$0\u0001")), "\u0001"), each))

    def names(mention: Column) -> Column:
        words = F.array(*[F.struct(k.alias("kind"), w.alias("word")) for k, w in _name_words(mention)])
        return F.when(kind_of(mention) == "name", F.filter(words, lambda w: w["word"].isNotNull())).otherwise(F.array().cast("array<struct<kind:string,word:string>>"))

    def whole(parts: Column) -> Column:
        known = F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda p, i: (i % 2 == 1) & (p != "\u0002")), names)))

        def put(k: Column) -> Column:
            between = lambda p: F.when(F.size(k) == 0, plain(p)).otherwise(named(p, k))
            mention = lambda p: F.when(_real(p), done(rendered(key, p, attempts))).otherwise(plain(p))
            return F.flatten(F.transform(parts, lambda p, i: F.when(i % 2 == 0, between(p)).when(p == "\u0002", plain(F.lit("\u0001"))).otherwise(mention(p))))

        joined = lambda x: F.struct(F.array_join(x["s"], "").alias("text"), F.aggregate(x["n"], F.lit(0), lambda a, n: a + n).alias("n"))
        return F.when(F.size(parts) > 1, _let(_let(known, put), joined)).otherwise(F.struct(parts[0].alias("text"), F.lit(0).alias("n")))

    # a mark on both sides of each mention; those that the text has itself are set aside
    parts = F.split(F.regexp_replace(F.replace(text, F.lit("\u0001"), F.lit("\u0001\u0002\u0001")), MENTION, "\u0001$0\u0001"), "\u0001")
    return F.when(text.rlike(HINT), _let(parts, whole)).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """``docs``, all columns, with surrogates in text, and a last column pii_mentions with the number replaced.

    Surrogates are computed in place from the key. Only the few entities whose surrogate collides need a look-up:
    their documents, named by a hash of the text, are joined with their numbers of attempts, a table that the
    planner broadcasts if its files are small and shuffles otherwise. Tables stored on the way hold entities sealed with the key only, and
    plans show neither it nor what it was made of.

    ``docs`` needs text; a column pii_mentions of its own is replaced, others stay. A null text stays null and
    an empty one empty, with no mentions. Repeated rows get equal results; an empty table gives no rows; a text of any length is read whole.
    """
    hide_keys(docs.sparkSession)
    text = F.col("text").cast("string")
    listed = docs.select(text.alias("text")).where(text.rlike(HINT)).select("text", mentions(F.col("text")).alias("m")).where(F.size("m") > 0)
    hidden = F.transform(F.array_distinct(F.flatten(F.transform("m", entities))), lambda e: F.struct(e["kind"].alias("kind"), sealed(key, e["canon"]).alias("canon")))
    listed = saved(listed.select(sealed(key, F.sha2("text", 256)).alias("of"), hidden.alias("e")), "mentions")
    each = listed.select("of", F.explode("e").alias("e")).select("of", "e.kind", "e.canon")
    odd = saved(collisions(each, key), "collisions")
    own = docs.drop("pii_mentions")
    attempts, of, made = free(own, "pii_attempts"), free(own, "pii_of"), free(own, "pii_made")
    if odd.isEmpty():
        looked = own.withColumn(attempts, F.lit(None).cast("map<string,int>"))
    else:
        pair = F.struct(F.concat_ws(" ", "kind", "canon").alias("entity"), "attempt")
        maps = each.distinct().join(odd, ["kind", "canon"]).groupBy("of").agg(F.map_from_entries(F.collect_list(pair)).alias(attempts))
        maps = saved(maps.withColumnRenamed("of", free(own, "pii_key")), "attempts")
        looked = own.withColumn(of, F.when(text.rlike(HINT), sealed(key, F.sha2(text, 256))))
        looked = looked.join(maps, F.col(of) == F.col(maps.columns[0]), "left").drop(of, maps.columns[0])
    looked = looked.withColumn(made, _rewritten(key, text, F.col(attempts)))
    kept = [F.col(f"`{c}`") if c != "text" else F.col(made)["text"].alias("text") for c in own.columns]
    return looked.select(*kept, F.coalesce(F.col(made)["n"], F.lit(0)).alias("pii_mentions"))
