"""Surrogates for personal data, in built-in columns.

Entities are found by pattern and reduced to a canonical form (digits of a
number, lower case of an address, single names of a person), so every mention
of an entity gets the same surrogate. A name is one entity wherever it stands in
a person's names; its gender is agreed over all its titles. Names found after a
title are then replaced in their whole document, with a title or bare. The distinct entities of the corpus are
one table; each gets a keyed replacement of its own kind: addresses keep
lengths and signs, numbers keep digits and separators (card numbers stay valid
under their check digit, other long numbers are account numbers), names keep script, case and the gender their titles agree on.
Replacements that two entities share, or that are themselves an entity of the
corpus, are drawn again until none is left, so distinct stays distinct and no
surrogate points at somebody else of the corpus.

Texts are shuffled only where an entity was found, to meet their replacements.
All are written once with their matches, so that the patterns run over a text a
single time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgrid.session import settle

# fixed values: titles that tell a gender, and those that do not
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "г-жа", "госпожа"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин"]
OPEN = ["Mx", "Dr", "Prof"]
TITLES = sorted([*FEMALE, *MALE, *OPEN], key=len, reverse=True)
# an upper-case title has a point or an upper-case name: "MS Word" is nobody
TITLE = "(?:(?:" + "|".join(TITLES) + r")\.?|(?:" + "|".join(t.upper() for t in TITLES) + r")(?:\.|(?= \p{Lu}[\p{Lu}'’-]+(?!\p{L}))))"

NAME = r"\p{Lu}(?:\p{L}|['’-](?=\p{L})(?![sS](?!\p{L})))+"  # without the ending of a possessive
# fixed values: words that stand inside a name, and words before which a capitalised word is a noun
PARTICLES = "van von der den dem de la las los del della di dos bin ibn al ten ter".split()
PARTICLE = r"(?:(?:van|von)(?: (?:der|den|dem|de))?|de(?: (?:la|las|los))?|del|della|di|dos|bin|ibn|al|ten|ter)"
ARTICLES = (
    "the a an this that these those my your his her its our their der die das dem den des ein eine einem einen einer eines kein keine diese dieser dieses "
    "im am zum zur vom beim le la les un une des du au aux ce cet cette ces el los las una unos unas al del este esta estos estas"
).split()
INITIAL = r"\p{Lu}\."
BARE = rf"(?<![\p{{L}}\p{{N}}_@])(?<!\p{{L}}['’-]){NAME}(?![\p{{N}}_@])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\w.-])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+(-])(?:\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{2,4}[ .-]?[0-9]{2,4}"
    r"|\+[0-9]{1,3}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}"
    r"|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-]|\.[0-9])",
    "card": r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w-]|\.[0-9])",
    "person": rf"(?<![\p{{L}}-]){TITLE} (?:{INITIAL} ?)*{NAME}(?: (?:(?:{INITIAL}|{PARTICLE}) )*{NAME})*",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
HINT = r"[0-9@]|(?:" + "|".join([*TITLES, *(t.upper() for t in TITLES)]) + r")\b"

# syllables of made-up names; every script has the same number
SYLLABLES = {
    "latin": ["ba", "be", "da", "de", "fa", "ga", "ha", "je", "ka", "ke", "la", "le", "ma", "me", "na", "ne", "ra", "re", "sa", "se", "ta", "te", "va", "ve", "wi", "zi"],
    "cyrillic": ["ба", "бе", "да", "де", "фа", "га", "ха", "же", "ка", "ке", "ла", "ле", "ма", "ме", "на", "не", "ра", "ре", "са", "се", "та", "те", "ва", "ве", "ви", "зи"],
    "greek": ["βα", "βε", "δα", "δε", "φα", "γα", "χα", "ζε", "κα", "κε", "λα", "λε", "μα", "με", "να", "νε", "ρα", "ρε", "σα", "σε", "τα", "τε", "θα", "θε", "ψι", "ξι"],
}
ENDINGS = {
    "latin": {"female": "lina", "male": "lor", "open": "lis", "surname": "ner"},
    "cyrillic": {"female": "лина", "male": "лор", "open": "лис", "surname": "нер"},
    "greek": {"female": "λινα", "male": "λορ", "open": "λις", "surname": "νερ"},
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAMES = ["female", "male", "open", "surname"]
KEPT = "kept"  # the kind of a word of a person that is no name
ROUNDS = 6  # draws of the entity's own shape; later ones are longer
# fixed values: country codes of two digits; 1 and 7 stand alone, all others have three
COUNTRY_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ENTITY = "array<struct<kind:string,canon:string,surface:string>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """Sum of digits with every second one from the right doubled; the last digit counts once."""
    letters = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(letters, value), F.lit(0), lambda a, b: a + b)


def name_words(match: Column, title: Column) -> Column:
    """The words of a person after the title; initials that stand together are words of their own."""
    names = F.regexp_replace(F.substring(match, F.length(title) + 2, F.length(match)), rf"({INITIAL})(?=\p{{Lu}})", "$1 ")
    return F.filter(F.split(names, " "), lambda n: n != "")


def entities(match: Column) -> Column:
    """What a match names: one entity, or one for each name of a person; empty for look-alikes."""
    one = lambda kind, canon, surface: F.struct(F.lit(kind).alias("kind"), canon.alias("canon"), surface.alias("surface"))
    number = digits(match)
    title = F.regexp_extract(match, rf"^({TITLE}) ", 1)
    bare = F.upper(F.regexp_replace(title, r"\.", ""))
    gender = F.when(bare.isin([t.upper() for t in FEMALE]), "female").when(bare.isin([t.upper() for t in MALE]), "male").otherwise("open")
    names = name_words(match, title)
    last = F.size(names) - 1
    kind = lambda n, i: F.when(n.isin(PARTICLES) | n.rlike(rf"^{INITIAL}$"), KEPT).when(i == last, "surname").otherwise(gender)
    person = F.transform(names, lambda n, i: F.struct(kind(n, i).alias("kind"), F.lower(n).alias("canon"), n.alias("surface")))
    alone = lambda kind, canon: F.array(one(kind, canon, match)).cast(ENTITY)
    return (
        F.when(F.contains(match, F.lit("@")), alone("email", F.lower(match)))
        .when(match.rlike(rf"^(?:{TITLE}) "), person.cast(ENTITY))
        .when(match.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), alone("ip", match))
        .when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), alone("ssn", number))
        .when(match.rlike(r"^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$") & F.length(number).between(7, 15), alone("phone", F.concat(F.regexp_extract(match, r"^\+", 0), number)))
        .when((luhn_sum(number) % 10 == 0) & F.length(number).between(13, 19), alone("card", number))
        .when(F.length(number).between(13, 19), alone("number", number))
        .otherwise(F.array().cast(ENTITY))
    )


def family(kind: Column) -> Column:
    """One kind for all names: what a mention is looked up by."""
    return F.when(kind.isin(NAMES), "name").otherwise(kind)


def agreed(kind: Column) -> Column:
    """The kind of all mentions of an entity: a name once given is no surname, and open where titles differ."""
    female, male, open_ = (F.max(kind == k) for k in ("female", "male", "open"))
    name = F.when(female & ~male, "female").when(male & ~female, "male").when(female | open_, "open").otherwise("surname")
    return F.when(F.max(kind.isin(NAMES)), name).otherwise(F.first(kind))


def in_case(surface: Column, replacement: Column) -> Column:
    """A name in upper case where its mention is, else with a capital."""
    return F.when((F.upper(surface) == surface) & (F.length(surface) > 2), F.upper(replacement)).otherwise(F.initcap(replacement))


def _bytes(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """64 keyed numbers from 0 to 255 for an entity."""
    secret = F.lit(key)
    inner = F.sha2(F.concat_ws("\n", secret, kind, canon, attempt.cast("string")), 512)
    outer = F.sha2(F.concat_ws("\n", secret, inner), 512)
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(outer, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))


def _script(canon: Column) -> Column:
    return F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def surrogate(kind: Column, canon: Column, attempt: Column, drawn: Column) -> Column:
    """The canonical form of the replacement, from the 64 numbers ``drawn`` for this attempt.

    After ``ROUNDS`` draws that were taken, replacements grow: addresses get
    another first part, numbers more digits. So even a shape with fewer forms
    than entities, or with nothing to change, ends with a replacement.
    """
    at = lambda i: F.element_at(drawn, (i % 64 + 1).cast("int"))
    more = F.greatest(attempt - ROUNDS, F.lit(0))
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    letters = F.filter(F.split(canon, ""), lambda c: c != "")
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyz")
    keep_from = F.length(canon) - F.length(F.substring_index(canon, ".", -1))  # the last part of a domain stays

    def shaped(c: Column, i: Column) -> Column:
        letter = F.substring(alphabet, at(i) % 26 + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), (at(i) % 10).cast("string")).when(c.rlike("[a-z]") & (i < keep_from), letter).otherwise(c)

    email = F.array_join(F.transform(letters, shaped), "")
    fresh = F.array_join(F.transform(steps(more + 6), lambda i: F.substring(alphabet, at(i + 20) % 26 + 1, F.lit(1))), "")
    domain = F.substring_index(email, "@", -1)
    domain = F.when(domain.rlike("^[a-z0-9]"), domain).otherwise(F.concat(fresh, F.lit("."), F.substring_index(domain, ".", -1)))
    email = F.when(more > 0, F.concat(fresh, F.lit("@"), domain)).otherwise(email)
    added = F.array_join(F.transform(steps(more), lambda i: (at(i + 40) % 10).cast("string")), "")
    digit = lambda i: (at(i) % 10).cast("string")
    number = F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) & (c != "0"), (at(i) % 9 + 1).cast("string")).otherwise(digit(i))), "")
    number = F.concat(number, added)
    kept = F.when(canon.rlike(r"^\+[17]"), 2).when(canon.rlike(r"^\+(" + "|".join(COUNTRY_2) + ")"), 3).when(canon.startswith("+"), 4).otherwise(1)
    phone = F.concat(F.substring(canon, F.lit(1), kept), F.array_join(F.transform(letters, lambda c, i: F.when(i >= kept, digit(i)).otherwise("")), ""), added)
    body = F.substring(number, F.lit(1), F.length(number) - 1)
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    last = F.substring(number, -1, 1).cast("int")
    # an account number that came out as a valid card moves on by one
    account = F.when(luhn_sum(number) % 10 == 0, F.concat(body, ((last + 1) % 10).cast("string"))).otherwise(number)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (at(i) % 254 + 1).cast("string")), ".")
    wide = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.lower(F.hex((at(2 * i) * 256 + at(2 * i + 1)).cast("long")))), ":")
    ip = F.when(more > 0, F.concat(F.lit("2001:db8:"), wide)).otherwise(ip)  # once four octets are used up
    name = F.lit(None).cast("string")
    count = F.lit(2) + F.least(F.floor(attempt / 2).cast("int"), F.lit(20))
    for script, parts in SYLLABLES.items():
        table = F.array(*[F.lit(p) for p in parts])
        ends = ENDINGS[script]
        end = F.when(kind == "female", ends["female"]).when(kind == "male", ends["male"]).when(kind == "surname", ends["surname"]).otherwise(ends["open"])
        made = F.transform(F.sequence(F.lit(0), count - 1), _syllable(table, at))
        name = F.when(_script(canon) == script, F.concat(F.array_join(made, ""), end)).otherwise(name)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ssn", number).when(kind == "number", account).when(kind == "phone", phone).when(kind == "card", F.concat(body, check)).otherwise(name)
    )


def _syllable(table: Column, at):
    return lambda i: F.element_at(table, (at(i) % len(SYLLABLES["latin"]) + 1).cast("int"))


def distinct_surrogates(known: DataFrame, key: str) -> DataFrame:
    """``kind, canon, replacement`` for each distinct entity; no two of a kind share one.

    Of entities that drew the same, the first in order keeps it; what equals an
    entity of the corpus is always drawn again. Only entities still in
    conflict change between rounds, and their forms grow in number.
    """

    def draw(rows: DataFrame) -> DataFrame:
        # little data and much work: dealt to as many tasks as a shuffle has, which are not merged
        rows = rows.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "canon")
        rows = rows.withColumn("drawn", _bytes(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        return rows.withColumn("replacement", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), F.col("drawn"))).drop("drawn")

    drawn = settle(draw(known.withColumn("attempt", F.lit(0))), "surrogates")
    while True:
        first = drawn.groupBy("kind", "replacement").agg(F.min("canon").alias("first"), F.count("*").alias("n"))
        shared = first.where("n > 1").select("kind", "replacement", "first")
        real = known.select(family(F.col("kind")).alias("family"), F.col("canon").alias("replacement"), F.lit(True).alias("real")).distinct()
        marked = drawn.join(shared.hint("merge"), ["kind", "replacement"], "left").withColumn("family", family(F.col("kind")))
        marked = marked.join(real.hint("merge"), ["family", "replacement"], "left")
        again = F.coalesce(F.col("real"), F.lit(False)) | F.coalesce(F.col("first") != F.col("canon"), F.lit(False))
        marked = settle(marked.select("kind", "canon", "attempt", "replacement", again.alias("again")), "surrogates")
        if marked.where("again").isEmpty():
            return marked.select("kind", "canon", "replacement")
        settled = marked.where("NOT again").select("kind", "canon", "attempt", "replacement")
        renewed = marked.where("again").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        drawn = settle(settled.unionByName(draw(renewed)), "surrogates")


def rendered(kind: Column, surface: Column, replacement: Column) -> Column:
    """A replacement in the form of the mention: separators and case of the surface."""
    letters = F.filter(F.split(surface, ""), lambda c: c != "")
    plain = F.regexp_replace(replacement, r"^\+", "")
    count = F.length(digits(surface))
    nth = lambda i: F.length(digits(F.substring(surface, F.lit(1), i + 1))).cast("int")
    number = F.array_join(F.transform(letters, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(plain, nth(i), F.lit(1))).otherwise(c)), "")
    number = F.concat(number, F.substring(plain, count + 1, F.length(plain)))  # what a grown one has more
    cased = F.array_join(
        F.transform(
            letters,
            lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.substring(replacement, i + 1, F.lit(1)))).otherwise(F.substring(replacement, i + 1, F.lit(1))),
        ),
        "",
    )
    cased = F.when(F.length(surface) == F.length(replacement), cased).otherwise(replacement)
    name = in_case(surface, replacement)
    return F.when(kind.isin("ssn", "phone", "card", "number"), number).when(kind == "email", cased).when(kind == "ip", replacement).otherwise(name)


def with_surrogates(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns ``doc_id, text, n_entities, n_changed``, one row per input row.

    ``key`` decides all first draws: the same key gives an entity the same
    surrogate in every corpus, unless a collision moves it or titles tell
    another gender of a name. ``n_entities`` counts mentions (each name of a
    person is one, with a title or bare). Initials are turned by the key, and
    particles inside a name stay. Null texts stay null,
    empty ones empty; texts without entities come back as they are. Repeated
    rows are changed alike; rows without an id are kept. Only id and text are
    read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    matches = F.when(hinted, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    # the patterns run over a text once; what they match is written beside it
    rows = settle(rows.withColumn("own", matches).withColumn("found", F.transform("own", entities)), "matches")
    has = F.coalesce(F.exists("found", lambda e: F.size(e) > 0), F.lit(False))
    key_of = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)), 256)
    held = settle(rows.where(has).select(key_of.alias("key"), "found").distinct(), "entities")
    each = held.select("key", F.posexplode("found").alias("nth", "names")).select("key", "nth", F.posexplode("names").alias("part", "e"))
    each = each.select("key", "nth", "part", "e.kind", "e.canon", "e.surface").where(F.col("kind") != KEPT)
    each = each.withColumn("family", family(F.col("kind")))
    known = settle(each.groupBy("family", "canon").agg(agreed(F.col("kind")).alias("kind")).select("kind", "canon"), "entities")
    replaced = distinct_surrogates(known, key).select(family(F.col("kind")).alias("family"), "canon", "replacement")
    mentions = each.join(replaced.hint("merge"), ["family", "canon"])
    mentions = mentions.withColumn("new", rendered(F.col("kind"), F.col("surface"), F.col("replacement")))
    by_doc = mentions.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "part", "new", "surface", "family", "canon", "replacement"))).alias("mentions"))

    # texts with entities meet their replacements; the others never move
    plain = rows.where(~has).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit(0).cast("long").alias("n_changed"))
    joined = rows.where(has).select("doc_id", "text", "own", key_of.alias("key")).join(by_doc.hint("merge"), "key")
    between = F.split("text", ANY, -1)

    shift = int.from_bytes(hashlib.sha256(key.encode()).digest()[:4], "big") % 25 + 1
    turned = ALPHABET[shift:] + ALPHABET[:shift]

    def changed(match: Column, i: Column) -> Column:
        mine = F.filter("mentions", lambda m: m["nth"] == i)
        title = F.regexp_extract(match, rf"^({TITLE}) ", 1)
        # initials turn with the key, particles stay
        word = lambda w, k: F.coalesce(F.get(F.filter(mine, lambda m: m["part"] == k), 0)["new"], F.translate(w, ALPHABET, turned))
        kept = lambda w, k: F.when(w.isin(PARTICLES), w).otherwise(word(w, k))
        person = F.concat(title, F.lit(" "), F.array_join(F.transform(name_words(match, title), kept), " "))
        return F.when(F.size(mine) == 0, match).when(title != "", person).otherwise(F.get(mine, 0)["new"])

    # names of the document that stand without a title: the first name after one
    # is a name; what follows it may be the next word of the sentence, and counts
    # as a name if the document never has it in lower case or behind an article
    joined = joined.withColumn("gaps", between).withColumn("around", F.array_join("gaps", "\n"))
    own_words = F.filter("mentions", lambda m: m["family"] == "name")
    noun = lambda m: F.concat(F.lit(rf"(?:^|[^\p{{L}}])(?:(?i:{'|'.join(ARTICLES)}) \Q"), m["surface"], F.lit(r"\E|\Q"), m["canon"], F.lit(r"\E)(?:$|[^\p{L}])"))
    first = lambda m: m["part"] == F.array_min(F.transform(F.filter(own_words, lambda o: o["nth"] == m["nth"]), lambda o: o["part"]))
    sure = F.filter(own_words, lambda m: first(m) | ~F.regexp_like(F.col("around"), noun(m)))
    pairs = F.transform(sure, lambda m: F.struct(m["canon"], m["replacement"]))
    joined = joined.withColumn("names", F.map_from_entries(F.array_distinct(pairs)))
    named = F.size("names") > 0

    def bare(gap: Column) -> Column:
        return F.regexp_extract_all(gap, F.lit(BARE), F.lit(0))

    def renamed(gap: Column) -> Column:
        new = F.transform(bare(gap), lambda w: F.coalesce(in_case(w, F.col("names")[F.lower(w)]), w))
        parts = F.arrays_zip(F.split(gap, BARE, -1).alias("gap"), new.alias("own"))
        return F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(p["own"], F.lit("")))), "")

    gaps = F.when(named, F.transform("gaps", renamed)).otherwise(F.col("gaps"))
    again = F.flatten(F.transform("gaps", lambda g: F.filter(bare(g), lambda w: F.col("names")[F.lower(w)].isNotNull())))
    again = F.when(named, F.size(again)).otherwise(0).cast("long")
    pieces = F.arrays_zip(gaps.alias("gap"), F.transform("own", changed).alias("own"))
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(p["own"], F.lit("")))), "")
    count = F.size("mentions").cast("long") + again
    moved = F.size(F.filter("mentions", lambda m: m["new"] != m["surface"])).cast("long") + again  # a surrogate is no name of the corpus
    return plain.union(joined.select("doc_id", text.alias("text"), count.alias("n_entities"), moved.alias("n_changed")))
