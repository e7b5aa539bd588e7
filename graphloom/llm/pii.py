"""Personal data by surrogate generation, in DataFrame expressions only.

Entities are found in whole texts by one pattern. Each distinct entity gets a surrogate from a keyed hash that keeps its type
and form: digits for digits in the same layout (card numbers that pass the Luhn check get surrogates that pass it), addresses
for addresses, names of the same gender, script and letter case behind the same title. Whoever has the key can make the same
surrogates again, so it comes from the caller.

Names are replaced word by word: a surname has one surrogate behind any title, given name or initial, a given name one before any
surname, and no two surnames, given names or initials share one, so distinct names stay distinct and mentions of one person
agree. Listed given names take turns within their gender and script; other given names and surnames are made of syllables.
In a document, capitalised words that are a surname or given name of one of its names, and stand alone, are replaced too.
Surrogates that coincide with one another or with a real entity or name are drawn again, and grow while they do: words by
syllables, from the third draw on, numbers by an extension, from the twentieth draw on (where a layout is used up).

Null texts stay null and empty ones empty. Null ids are kept. Rows that repeat give repeated results. Texts are read whole, in
time proportional to their length. An empty table gives an empty result. ``surrogates`` keeps other columns, whatever their
names; those named like one of its counts are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, slim

# Titles by gender, given names by gender and script, and syllables of invented surnames.
TITLES = {"m": "Mr Mister Sir Herr Monsieur Señor Sr Don г-н господин κύριος", "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Srta Doña г-жа госпожа κυρία", "n": "Dr Prof Mx"}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter Hans Klaus Jürgen Pierre Jean Luc Carlos José Miguel",
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna Ursula Monika Marie Sophie Claire María Carmen Lucía Elena",
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Николай Павел Михаил",
    ("cyrillic", "f"): "Мария Анна Елена Ольга Наталья Ирина Татьяна Светлана",
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Άννα Σοφία Ειρήνη",
}
SYLLABLES = {"latin": "bar bel cor dan del fal gar hol jen kar lan lor mar mer nor pal ran ros sel tan ter val wen zor", "cyrillic": "бар вел гор дан кол лар мор нов пал рос сел тар", "greek": "βαλ γαρ δελ καρ λαν μαρ νικ παλ ροδ σελ ταρ φιλ"}
_TITLE = "|".join(t for own in TITLES.values() for t in own.split())
_FIRST = "|".join(n for own in GIVEN.values() for n in own.split())
# What a title or a given name starts with: a capital, or the first letter of a lower-case title.
_INITIAL = r"\p{Lu}гκ"
_CAP = r"\p{Lu}[\p{L}'’-]+"
_INITIALS = r"(?:\p{Lu}\.?[ \u00a0])*+"
# a further word of a name, behind any initials; the title of the next name is none
_MORE = rf"[ \u00a0]{_INITIALS}(?!(?:{_TITLE})(?![\p{{L}}'’-])){_CAP}"
# Each pattern first looks at what a place starts with, so that most places of a text cost one look.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "phone": r"(?=[\d+(])(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\p{L}\d])",
    "card": r"(?=\d)(?<![\p{L}\d])(?:\d{4}[ -]?){3}\d{1,7}(?![\p{L}\d])",
    "ssn": r"(?=\d)(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\p{L}\d-])",
    "iban": r"(?=[A-Z])(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "name": rf"(?=[{_INITIAL}])(?<![\p{{L}}])(?:(?:{_TITLE})\.?[ \u00a0]{_INITIALS}{_CAP}(?:{_MORE})*+|(?:{_FIRST})(?:{_MORE})++)",
}
KINDS = tuple(PATTERNS)
ANY = rf"{PATTERNS['email']}|(?=[\d+({_INITIAL}])(?:" + "|".join(p for k, p in PATTERNS.items() if k != "email") + ")"


# A capitalised word, for bare mentions of names.
_WORD = r"(?<![\p{L}])\p{Lu}\p{L}++(?![\p{L}\d._%+'-]{0,64}@)"
WIDE = f"{ANY}|{_WORD}"
# Capital letters that initials take turns in.
CAPITALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


def _whole(kind: str) -> str:
    return f"^(?:{PATTERNS[kind]})$"


def kind_of(entity: Column) -> Column:
    out = F.when(entity.rlike(r"^\p{Lu}\p{L}+$"), F.lit("word"))
    for k in KINDS:
        out = out.when(entity.rlike(_whole(k)), F.lit(k))
    return out.otherwise(F.lit("name"))


def _stream(key: str, *parts: Column) -> Column:
    """192 keyed hexadecimal digits."""
    seed = F.concat_ws("\u0001", F.lit(key), *parts)
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\u0002")), 256), F.sha2(F.concat(seed, F.lit("\u0003")), 256))


def _number(hex_digits: Column, at: int, n: int, below: int) -> Column:
    return F.conv(F.substring(hex_digits, at, n), 16, 10).cast("long") % below


def _draw(choices: str, stream: Column, at: int) -> Column:
    words = choices.split()
    return F.element_at(F.array(*map(F.lit, words)), (_number(stream, at, 8, len(words)) + 1).cast("int"))


def _form(entity: Column, stream: Column) -> Column:
    """Digits for digits and letters for letters of the same case, everything else as it is."""

    def one(i: Column) -> Column:
        c = F.substring(entity, i, F.lit(1))
        v = F.conv(F.concat(F.substring(stream, (i - 1) % 150 + 1, F.lit(8))), 16, 10).cast("long")
        pick = lambda letters: F.substring(F.lit(letters), (v % len(letters) + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    n = F.length(digits)
    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)),
        F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v),
    )
    return total % 10


def _card(entity: Column, stream: Column) -> Column:
    """Another number in the same layout with the same first digit; the last one makes it valid where the original is valid."""
    drawn = F.concat(F.substring(entity, 1, 1), F.substring(_form(entity, stream), 2, 64))
    digits, own = F.regexp_replace(drawn, "[^0-9]", ""), F.regexp_replace(entity, "[^0-9]", "")
    open_ = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))
    last = ((10 - _luhn(open_)) % 10).cast("string")
    return F.when(_luhn(own) == 0, F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), last)).otherwise(drawn)


def surrogate(key: str, entity: Column, kind: Column, attempt: Column) -> Column:
    """Another entity of the kind and form (of all kinds but names)."""
    stream = _stream(key, kind, entity, attempt.cast("string"))
    octets = F.concat_ws(".", *(((_number(stream, 1 + 8 * i, 8, 254) + 1).cast("string")) for i in range(4)))
    at = F.instr(entity, "@")
    mail = F.concat(_form(F.substring(entity, F.lit(1), at - 1), stream), F.lit("@mail"), _number(stream, 150, 8, 10_000).cast("string"), F.lit(".example."), _draw("com org net", stream, 160))
    phone_kept = F.regexp_extract(entity, r"^(\+\d{1,3}(?=[ .(-])|\+?)", 1)
    phone = F.concat(phone_kept, _form(F.substring(entity, F.length(phone_kept) + 1, F.lit(64)), stream))
    iban = F.concat(F.substring(entity, 1, 2), _form(F.substring(entity, 3, 64), stream))
    new = F.when(kind == "email", mail).when(kind == "ip", octets).when(kind == "phone", phone).when(kind == "card", _card(entity, stream)).when(kind == "iban", iban).otherwise(_form(entity, stream))
    return F.when(attempt < 20, new).otherwise(F.concat(new, F.lit("x"), _number(stream, 100, 8, 1 << 30).cast("string")))


def script_of(word: Column) -> Column:
    return F.when(word.rlike("\\p{IsCyrillic}"), "cyrillic").when(word.rlike("\\p{IsGreek}"), "greek").otherwise("latin")


def listed(key: str) -> dict[str, str]:
    """Each listed given name and the one that stands for it: the next in keyed order of its gender and script, so none stands for itself or for two."""
    out = {}
    for group, names in GIVEN.items():
        order = sorted(names.split(), key=lambda n: hashlib.sha256(f"{key}\u0001{group}\u0001{n}".encode()).digest())
        out |= {a.lower(): b for a, b in zip(order, [*order[1:], order[0]])}
    return out


def invented(key: str, role: Column, script: Column, low: Column, attempt: Column) -> Column:
    """A capitalised word of syllables: three of them for given names and four for surnames, and one more for each draw from the third on."""
    seed = F.concat_ws("\u0001", F.lit(key), role, script, low, attempt.cast("string"))
    n = F.when(role == "given", 3).otherwise(4) + F.greatest(attempt - 1, F.lit(0))
    which = lambda i, size: (F.conv(F.substring(F.sha2(F.concat(seed, F.lit("\u0002"), i.cast("string")), 256), 1, 8), 16, 10).cast("long") % size + 1).cast("int")
    make = lambda parts: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(F.array(*map(F.lit, parts)), which(i, len(parts)))), "")
    word = F.when(script == "cyrillic", make(SYLLABLES["cyrillic"].split())).when(script == "greek", make(SYLLABLES["greek"].split())).otherwise(make(SYLLABLES["latin"].split()))
    return F.initcap(word)


def _settle(held: DataFrame, within: list[str], draw: Column, real: DataFrame) -> DataFrame:
    """``held`` with attempt and ``new``, drawn again until no two rows that agree on ``within`` share one and none is in ``real`` (_low, _real)."""
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = held.columns
    current = cut(held.withColumn("attempt", F.lit(0)).repartition(parts, *keys).withColumn("new", draw))
    while True:
        order = Window.partitionBy(*within, "new").orderBy("attempt", *keys)
        seen = current.withColumn("_nth", F.row_number().over(order)).withColumn("_low", F.lower("new")).join(real, "_low", "left")
        clash = cut(seen.select(*keys, "attempt", "new", ((F.col("_nth") > 1) | F.coalesce("_real", F.lit(False))).alias("_clash")))
        if clash.filter("_clash").isEmpty():
            return current
        again = clash.withColumn("attempt", F.when(F.col("_clash"), F.col("attempt") + 1).otherwise(F.col("attempt")))
        current = cut(again.withColumn("new", F.when(F.col("_clash"), draw).otherwise(F.col("new"))).drop("_clash"))


def words_of(names: DataFrame) -> DataFrame:
    """(id, i, role, core, tail, low, script) of each word of each name (id, entity); tail: a genitive ending or sign."""
    words = F.split("entity", "[ \u00a0]")
    out = names.select("id", F.size(words).alias("_n"), words.alias("_words")).select("id", "_n", F.posexplode("_words").alias("i", "_w"))
    tail = F.regexp_extract("_w", "(?:['’]s)?['’-]*$", 0)
    role = F.when((F.col("i") == 0) & F.col("_w").rlike(f"^(?:{_TITLE})\\.?$"), "title").when(F.col("_w").rlike(r"^\p{Lu}\.?$"), "initial").when(F.col("i") == F.col("_n") - 1, "surname").otherwise("given")
    out = out.withColumn("role", role).withColumn("tail", F.when(F.col("role").isin("surname", "given"), tail).otherwise(""))
    out = out.withColumn("core", F.substring(F.col("_w"), F.lit(1), F.length("_w") - F.length("tail")))
    return out.select("id", "i", "role", "core", "tail", F.lower("core").alias("low"), script_of(F.col("core")).alias("script"))


def name_words(words: DataFrame, key: str) -> DataFrame:
    """(role, script, low, new) of each distinct given name and surname."""
    every = words.filter(F.col("role").isin("given", "surname")).groupBy("role", "script", "low").agg(F.count("*").alias("_n")).select("role", "script", "low")
    known = listed(key)
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    every = cut(every.withColumn("_own", F.when(F.col("role") == "given", F.element_at(names, F.col("low")))))
    taken = every.select(F.col("low").alias("_low")).union(words.sparkSession.createDataFrame([(x,) for x in known], "_low string")).distinct().withColumn("_real", F.lit(True))
    draw = invented(key, F.col("role"), F.col("script"), F.col("low"), F.col("attempt"))
    made = _settle(every.filter("_own is null").select("role", "script", "low"), ["role"], draw, taken)
    return made.select("role", "script", "low", "new").union(every.filter("_own is not null").select("role", "script", "low", "_own"))


def initial(key: str, core: Column) -> Column:
    """Another initial of the same alphabet."""
    a, b = "", ""
    for letters in CAPITALS:
        by = 1 + int(hashlib.sha256(f"{key}\u0001{letters}".encode()).hexdigest(), 16) % (len(letters) - 1)
        a, b = a + letters, b + letters[by:] + letters[:by]
    return F.translate(core, a, b)


def mapping(entities: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(id, entity, kind, surrogate) of each distinct entity, no surrogate twice and none itself an entity; and (id, role, low, new) of the words of names."""
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = entities.groupBy("entity").agg(F.count("*").alias("_n")).select("entity")
    held = cut(distinct.repartition(parts, "entity").withColumn("kind", kind_of(F.col("entity"))).filter("kind <> 'word'").withColumn("id", F.monotonically_increasing_id()))
    real = held.select(F.lower("entity").alias("_low"), F.lit(True).alias("_real")).distinct()
    made = _settle(held.filter("kind <> 'name'"), [], surrogate(key, F.col("entity"), F.col("kind"), F.col("attempt")), real)
    named = held.filter("kind = 'name'")
    words = cut(words_of(named))
    new = name_words(words, key)
    shaped = F.when((F.upper("core") == F.col("core")) & (F.length("core") > 1), F.upper("new")).otherwise(F.col("new"))
    piece = F.when(F.col("role") == "initial", initial(key, F.col("core"))).otherwise(F.coalesce(shaped, F.col("core")))
    pieces = cut(words.join(new, ["role", "script", "low"], "left").select("id", "i", "role", "low", "new", F.concat(piece, "tail").alias("piece")))
    whole = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "piece"))).alias("_w"))
    gaps = F.concat(F.array(F.lit("")), F.regexp_extract_all("entity", F.lit("[ \u00a0]"), F.lit(0)))
    both = F.arrays_zip(gaps.alias("g"), F.transform("_w", lambda w: w["piece"]).alias("p"))
    names = named.join(whole, "id").select("id", "entity", "kind", F.array_join(F.transform(both, lambda z: F.concat(z["g"], z["p"])), "").alias("surrogate"))
    return made.select("id", "entity", "kind", F.col("new").alias("surrogate")).union(names), pieces.filter("new is not null").select("id", "role", "low", "new")


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """The documents with every entity replaced, the number of entities of each kind as ``n_<kind>``, and that of bare names as ``n_bare``.

    Only documents that have entities meet their surrogates, in joins; the others pass through.
    """
    has = F.col("text").rlike(ANY)
    hits = cut(docs.filter(has).select(F.struct(*docs.columns).alias("d"), F.split("text", WIDE, -1).alias("parts"), F.regexp_extract_all("text", F.lit(WIDE), F.lit(0)).alias("found")).withColumn("row", F.monotonically_increasing_id()))
    places = hits.select("row", F.posexplode("found").alias("at", "entity"))
    known, words = mapping(places.select("entity"), key)
    known = cut(known)
    single = F.col("entity").rlike(r"^\p{Lu}\p{L}+$")
    whole = cut(places.filter(~single).join(known, "entity").select("row", "at", "id", "kind", "surrogate"))
    own = whole.filter("kind = 'name'").select("row", "id").distinct().join(words, "id").groupBy("row", "low").agg(F.max(F.struct("role", "new"))["new"].alias("new"))
    shaped = F.when(F.upper("entity") == F.col("entity"), F.upper("new")).otherwise(F.col("new"))
    bare = places.filter(single).withColumn("low", F.lower("entity")).join(own, ["row", "low"], "left")
    bare = bare.select("row", "at", F.when(F.col("new").isNotNull(), "bare").otherwise("word").alias("kind"), F.coalesce(shaped, "entity").alias("surrogate"))
    kinds = [*KINDS, "bare"]
    count = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds]
    done = whole.select("row", "at", "kind", "surrogate").union(bare).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("new"), *count)
    pieces = F.arrays_zip(F.col("parts").alias("p"), F.transform("new", lambda s: s["surrogate"]).alias("s"))
    text = F.array_join(F.transform(pieces, lambda z: F.concat(z["p"], F.coalesce(z["s"], F.lit("")))), "")
    keep = [c for c in docs.columns if c != "text" and c not in {f"n_{k}" for k in kinds}]
    changed = hits.join(done, "row").select(*(F.col("d")[c].alias(c) for c in keep), text.alias("text"), *(f"n_{k}" for k in kinds))
    same = docs.filter(F.col("text").isNull() | ~has).select(*keep, "text", *(F.lit(0).cast("long").alias(f"n_{k}") for k in kinds))
    return changed.unionByName(same)


def protect(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_<kind>...) of every document."""
    return surrogates(slim(docs), key)
