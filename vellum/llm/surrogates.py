"""Keyed surrogates for personal data, of DataFrame functions alone.

E-mail and IP addresses, phone, payment card and account numbers and names after a title are found
in whole texts. Every distinct entity gets a replacement derived from a key: digits become digits
and letters letters of the same case, in the same layout; mail addresses lie in reserved domains;
private and loopback IPv4 addresses stay in their range, others go to the reserved 240.0.0.0/4, IPv6
ones to the documentation range 2001:db8::/32; cards and account numbers pass their check if the
original does; names keep gender (from the title), script (Latin, Cyrillic, Greek or Armenian) and
case. The same entity gets the same replacement everywhere (a name's words one by one, so 'Ms Ann
Lee' and 'Ms Lee' stay one person), and different entities of a kind get different ones:
replacements that collide, or equal an entity of the input, are derived anew until none does. Names
and mail addresses grow with each attempt, numbers after TIGHT of them, so there is room for any
number of entities.

A person is a first and a last word after a title; if titles tell a gender anywhere, it holds for
all the person's mentions (that of women, if titles differ). A document's name words are replaced
wherever they recur in it capitalised or in capitals, with or without a title.

Texts are searched once, into a table of parts; those without entities are passed on from there,
only the others' parts and the table of distinct entities are shuffled, and an entity that very many
texts hold is joined in several tasks.

Defined cases: null texts stay null, empty ones empty; rows that share a doc_id or repeat are each
rewritten; an empty table gives an empty result; all other columns are kept as they are. Positions
are code points of the original text, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, spread_join

KEY = "surrogates 1"
#: Titles by gender (m, f, or n where they don't tell).
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "госпожа"), "n": ("Dr", "Prof", "Mx")}
_NAME = r"\p{Lu}[\p{L}'’-]+"
#: What a genitive adds to a name.
_GENITIVE = "['’][sS]?$"
_TITLE = "|".join(t for some in TITLES.values() for t in some)
_V4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: IPv6: eight groups, or fewer with '::', or with an IPv4 address at the end; one digit at least.
_V6 = rf"(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:{_HEX}:){{6}}{_V4}|(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}:){{0,5}}{_V4}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:]|\.\d)"
_GAP = r"[\x20./-]"
_PHONES = (
    rf"(?:\+|00)1{_GAP}?\(?\d{{3}}\)?{_GAP}?\d{{3}}{_GAP}?\d{{4}}",
    rf"(?:\+33|0033){_GAP}?(?:\(0\){_GAP}?)?[1-9](?:{_GAP}?\d{{2}}){{4}}",
    rf"(?:\+34|0034){_GAP}?[6-9](?:{_GAP}?\d){{8}}",
    # any other country: 8 to 15 digits
    rf"(?:\+|00(?=[1-9]))\d(?:{_GAP}?\(?\d\)?){{7,14}}",
    # France; three groups; Spain; Germany; ten digits as in North America
    rf"0[1-9](?:{_GAP}?\d{{2}}){{4}}",
    r"(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)[\x20.-]?|\d{2,4}[\x20.-])\d{3,4}[\x20.-]\d{3,4}",
    rf"[6-9]\d{{2}}(?:{_GAP}\d{{2}}){{3}}|[89]\d{_GAP}\d{{3}}{_GAP}\d{{2}}{_GAP}\d{{2}}",
    rf"(?=(?:[^\d\n]{{0,2}}\d){{8}})(?:\(0[1-9]\d{{1,4}}\)\x20?|0[1-9]\d{{1,4}}(?:\x20?/\x20?|[\x20-]))\d{{3,8}}(?:[\x20-]\d{{2,5}}){{0,2}}",
    r"[2-9]\d{2}[2-9]\d{6}",
)
#: Kinds in order of precedence where they could begin at one place.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,7}\.[A-Za-z]{2,24}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_V4})(?![\w]|\.\d)|{_V6}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.-])[3-6]\d{3}([\x20-]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": rf"(?<![\w.+-])(?:{'|'.join(_PHONES)})(?![\w-])",
    "name": rf"(?<!\w)(?:{_TITLE})\.?\x20{_NAME}(?:\x20{_NAME}){{0,2}}",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that every text with an entity passes.
_HINT = rf"[@\d]|(?:{_TITLE})\.?\x20\p{{Lu}}"
_SYLLABLES = {
    "latin": "ba be da do fa ga ka la le li lo ma mi na ne no ra re ri ro sa se ta ti to va ve vi za zo ru lu".split(),
    "cyrillic": "ба бе ва ве га да де до жа за ка ко ла ле ли ло ма ми мо на не но ра ри ро са се та ти то ру лу".split(),
    "greek": "βα βε γα γε δα δε δο ζα θα θε κα κο λα λε λι λο μα με μι μο να νε νο ρα ρι ρο σα σε τα τι φα χα".split(),
    "armenian": "բա բե գա գե դա դե զա թա լա լե լի լո կա կո հա մա մե մի նա նե նո պա ռա սա սե վա տա տի րա րե րո փա".split(),
}
#: How a word ends by its part in a name: given names of men, women and others, and last names.
_ENDINGS = {
    "latin": {"m": "n", "f": "a", "n": "is", "s": "ner"},
    "cyrillic": {"m": "н", "f": "а", "n": "ий", "s": "ко"},
    "greek": {"m": "ος", "f": "α", "n": "ις", "s": "άκης"},
    "armenian": {"m": "ն", "f": "ա", "n": "իկ", "s": "յան"},
}
_SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "armenian": r"\p{IsArmenian}"}
#: Attempts after which replacements of numbers grow, and IPv4 addresses become IPv6 ones.
TIGHT = 12


def _hash(*parts: Column) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def _number(h: Column, place: Column | int, digits: int = 4) -> Column:
    """An integer from some of a hash's digits."""
    at = place if isinstance(place, int) else place.cast("int")
    return F.conv(F.substring(h, at, F.lit(digits)) if not isinstance(at, int) else F.substring(h, at, digits), 16, 10).cast("long")


def _kind(entity: Column) -> Column:
    whole = [F.when(entity.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()]
    return F.coalesce(*whole, F.lit("name"))


def _shaped(entity: Column, h: Column, keep: Column) -> Column:
    """Digits to digits and ASCII letters to letters of the same case, but for the first `keep` characters."""

    def one(c: Column, i: Column) -> Column:
        r = F.conv(F.substring(F.sha2(F.concat(h, i.cast("string")), 256), 1, 8), 16, 10).cast("long")
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (r % 26 + 1).cast("int"), F.lit(1))
        return F.when(i < keep, c).when(c.rlike("[0-9]"), (r % 10).cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(entity, ""), lambda c: c != ""), one), "")


def _check_sum(digits: Column) -> Column:
    """The sum of the check-digit test over a string of digits, its last doubled none."""
    n = F.length(digits)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), one), F.lit(0), lambda a, x: a + x)


def _card(entity: Column, shaped: Column) -> Column:
    """A card number whose last digit makes the test come out as the original's."""
    off = _check_sum(F.regexp_replace(entity, r"\D", "")) % 10
    head = F.expr("substring(shaped, 1, length(shaped) - 1)")
    need = (off - _check_sum(F.concat(F.regexp_replace(head, r"\D", ""), F.lit("0"))) + 1000) % 10
    return F.concat(head, need.cast("string"))


def _mod97(code: Column) -> Column:
    """The remainder of an account number's check: letters count as 10 to 35."""

    def step(sum_: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (sum_ * 10 + c.cast("int")) % 97).otherwise((sum_ * 100 + F.ascii(F.upper(c)) - 55) % 97)

    return F.aggregate(F.filter(F.split(code, ""), lambda c: c != ""), F.lit(0), step)


def _iban(entity: Column, shaped: Column) -> Column:
    """An account number whose check digits make the test come out as the original's."""
    dense, made = F.regexp_replace(entity, " ", ""), F.regexp_replace(shaped, " ", "")
    country = F.substring(entity, 1, 2)
    off = _mod97(F.concat(F.expr("substring(replace(entity, ' ', ''), 5)"), F.substring(dense, 1, 4)))
    rest = _mod97(F.concat(F.substring(made, F.lit(5), F.length(made)), country, F.lit("00")))
    check = (off - rest + 97) % 97
    return F.concat(country, F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), F.substring(shaped, F.lit(5), F.length(shaped)))


def _ip(entity: Column, h: Column, attempt: Column) -> Column:
    octet = [(_number(h, 1 + 4 * i) % 254 + 1).cast("string") for i in range(4)]
    inner = [
        (r"^10\.", F.lit("10"), octet[1]),
        (r"^127\.", F.lit("127"), octet[1]),
        (r"^192\.168\.", F.lit("192"), F.lit("168")),
        (r"^172\.(1[6-9]|2\d|3[01])\.", F.lit("172"), (_number(h, 5) % 16 + 16).cast("string")),
        (r"^169\.254\.", F.lit("169"), F.lit("254")),
    ]
    made = F.coalesce(*[F.when(entity.rlike(p), F.concat_ws(".", a, b, *octet[2:])) for p, a, b in inner], F.concat_ws(".", (_number(h, 1) % 15 + 240).cast("string"), *octet[1:]))
    six = F.concat_ws(":", F.lit("2001:db8"), *[F.substring(h, 1 + 4 * i, 4) for i in range(6)])
    return F.when(F.contains(entity, F.lit(":")) | (attempt >= TIGHT), six).otherwise(made)


def _syllables(h: Column, script: str, part: Column, attempt: Column) -> Column:
    some = F.array(*map(F.lit, _SYLLABLES[script]))
    pick = lambda n: F.element_at(some, (n % len(_SYLLABLES[script]) + 1).cast("int"))
    body = F.concat(*[pick(_number(h, 1 + 4 * i)) for i in range(3)], F.when(_number(h, 20) % 2 == 0, pick(_number(h, 24))).otherwise(F.lit("")))
    more = F.transform(F.sequence(F.lit(1), attempt), lambda i: pick(_number(F.sha2(F.concat(h, i.cast("string")), 256), 1)))
    longer = F.when(attempt > 0, F.concat(body, F.array_join(more, ""))).otherwise(body)
    ending = F.coalesce(*[F.when(part == k, F.lit(v)) for k, v in _ENDINGS[script].items()])
    return F.initcap(F.concat(longer, ending))


def _word(entity: Column, h: Column, part: Column, attempt: Column) -> Column:
    made = F.coalesce(*[F.when(entity.rlike(p), _syllables(h, script, part, attempt)) for script, p in _SCRIPTS.items()], _syllables(h, "latin", part, attempt))
    return F.when((F.length(entity) > 1) & (F.upper(entity) == entity), F.upper(made)).otherwise(made)


def _derive(entities: DataFrame, key: str) -> DataFrame:
    """Adds `surrogate` to (kind, entity, attempt)."""
    h = _hash(F.lit(key), F.col("kind"), F.lower("entity"), F.col("attempt").cast("string"))
    kept = F.when(F.col("kind") == "card", 1).when(F.col("kind") == "iban", 2).when(F.col("kind") == "phone", F.length(F.regexp_extract("entity", r"^\+\d{1,3}(?=\D)", 0))).otherwise(0)
    attempt, hexa = F.col("attempt"), F.col("h")
    grown = F.concat(F.col("shaped"), F.when(attempt >= TIGHT, F.concat(F.lit("-"), _number(hexa, 1, 7).cast("string"))).otherwise(F.lit("")))
    rows = entities.withColumn("h", h).withColumn("shaped", _shaped(F.when(F.col("kind") == "email", F.substring_index("entity", "@", 1)).otherwise(F.col("entity")), F.col("h"), kept))
    rows = rows.withColumn("shaped", F.when(F.col("kind") == "email", F.concat("shaped", F.when(attempt > 0, F.substring(hexa, 30, 6)).otherwise(F.lit("")))).otherwise(grown))
    domain = F.concat(F.lit("@mail"), F.conv(F.substring(hexa, 1, 5), 16, 10), F.lit(".example"))
    part = F.regexp_extract("kind", r"name_(.)", 1)
    surrogate = (
        F.when(F.col("kind") == "email", F.concat("shaped", domain))
        .when(F.col("kind") == "ip", _ip(F.col("entity"), hexa, attempt))
        .when(F.col("kind") == "card", _card(F.col("entity"), F.col("shaped")))
        .when(F.col("kind") == "iban", _iban(F.col("entity"), F.col("shaped")))
        .when(F.col("kind").startswith("name_"), _word(F.col("entity"), hexa, part, attempt))
        .otherwise(F.col("shaped"))
    )
    return rows.withColumn("surrogate", surrogate).drop("h", "shaped")


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, entity, surrogate for distinct (kind, entity): no two share a surrogate, none is an entity.

    Each round derives again what lost a collision; rounds go on until none is left.
    """
    rows = cut_lineage(_derive(entities.select("kind", "entity").distinct().withColumn("attempt", F.lit(0)), key))
    taken = rows.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
    while True:
        first = rows.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("first"))
        judged = rows.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left").withColumn("lost", F.col("real").isNotNull() | (F.col("first.entity") != F.col("entity")))
        lost = cut_lineage(judged.select("kind", "entity", "attempt", "surrogate", "lost"))
        if lost.filter("lost").isEmpty():
            return rows.select("kind", "entity", "surrogate")
        anew = _derive(lost.filter("lost").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), key).select("kind", "entity", "attempt", "surrogate")
        rows = cut_lineage(lost.filter("not lost").select("kind", "entity", "attempt", "surrogate").unionByName(anew))


def _units(kind: Column, entity: Column) -> Column:
    """What is replaced as one: an entity, or each word of a name; title words stay, and so does a genitive's end.

    `person` joins the mentions of somebody named by several words.
    """
    words = F.split(entity, " ")
    bare = F.transform(words, lambda w: F.regexp_replace(w, _GENITIVE, ""))
    titled = F.regexp_replace(words[0], r"\.$", "").isin(*(t for some in TITLES.values() for t in some))
    gender = F.coalesce(*[F.when(F.regexp_replace(words[0], r"\.$", "").isin(*some), F.lit(g)) for g, some in TITLES.items()], F.lit("n"))
    last, first = F.size(words) - 1, F.when(titled, 1).otherwise(0)
    person = F.when(titled & (last > 1), F.lower(F.concat_ws(" ", bare[1], F.element_at(bare, -1))))
    one = lambda kind, entity, tail, person: F.struct(kind.alias("kind"), entity.alias("entity"), tail.alias("tail"), person.alias("person"))
    named = F.transform(
        words,
        lambda w, i: one(
            F.when(i < first, F.lit("title")).when(~titled, F.lit("again")).when(i == last, F.lit("name_s")).otherwise(F.concat(F.lit("name_"), gender)),
            F.when(i < first, w).otherwise(F.get(bare, i)),
            F.when(i < first, F.lit("")).otherwise(F.regexp_extract(w, _GENITIVE, 0)),
            person,
        ),
    )
    return F.when(kind == "name", named).otherwise(F.array(one(kind, entity, F.lit(""), F.lit(None).cast("string"))))


def _all_units(parts: DataFrame, found: str) -> DataFrame:
    one = parts.filter(f"{found} is not null").select("row", "i", F.posexplode(_units(F.col("found_kind"), F.col(found))).alias("j", "unit"))
    return one.select("row", "i", "j", "unit.*")


def _name_words(units: DataFrame) -> DataFrame:
    """row, word (lower case), kind of every name word of a row; each person has one gender."""
    names = units.filter(F.col("kind").startswith("name_"))
    settled = names.filter("person is not null and kind in ('name_f', 'name_m')").groupBy("person").agg(F.min("kind").alias("settled"))
    known = names.join(settled, "person", "left").withColumn("kind", F.when(F.col("kind") == "name_s", F.col("kind")).otherwise(F.coalesce("settled", "kind")))
    # a word is what it is in a name of several words, and else a last word
    rank = F.struct(F.col("person").isNull(), F.col("kind"))
    return known.groupBy("row", F.lower("entity").alias("word")).agg(F.min(rank).alias("k"), F.collect_set("entity").alias("forms")).select("row", "word", F.col("k.kind").alias("word_kind"), "forms")


def _with_mentions(parts: DataFrame, words: DataFrame) -> DataFrame:
    """Parts cut further where a row's name words recur between its entities."""
    forms = F.array_distinct(F.flatten(F.collect_list(F.concat("forms", F.transform("forms", F.upper)))))
    some = F.concat(F.lit("(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    patterns = words.filter(F.length("word") > 1).groupBy("row").agg(some.alias("some")).select("row", F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.col("some"), F.lit(r"(?:\x20"), F.col("some"), F.lit(")*")).alias("names"))
    joined = parts.join(patterns, "row", "left")
    gaps = F.when(F.col("names").isNull(), F.array("gap")).otherwise(F.split("gap", F.col("names"), -1))
    told = F.when(F.col("names").isNull(), F.array().cast("array<string>")).otherwise(F.expr("regexp_extract_all(gap, names, 0)"))
    cut = joined.select("row", "kept", "i", "found", "found_kind", gaps.alias("gaps"), told.alias("told"))
    again = cut.select("*", F.posexplode("gaps").alias("k", "part"))
    at_end = F.col("k") == F.size("gaps") - 1
    return again.select(
        "row",
        F.when(F.col("k") == 0, F.col("kept")).alias("kept"),
        F.struct("i", "k").alias("i"),
        F.col("part").alias("gap"),
        F.when(at_end, F.col("found")).otherwise(F.get("told", F.col("k"))).alias("found"),
        F.when(at_end, F.col("found_kind")).otherwise(F.lit("name")).alias("found_kind"),
    )


def replace_personal(docs: DataFrame, key: str = KEY) -> DataFrame:
    """`docs` with entities in text replaced, and a column entities: kind, start, end, surrogate.

    Only texts with entities leave their place, in parts that are joined to the entities' table and
    put together again by row.
    """
    kept = [c for c in docs.columns if c not in ("text", "entities")]
    listed = "array<struct<kind:string,start:bigint,end:bigint,surrogate:string>>"
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in kept)).alias("kept"), F.col("text").cast("string").alias("text"))
    zipped = F.arrays_zip(F.split("text", _ANY, -1).alias("gap"), F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)).alias("entity"))
    named = F.transform(zipped, lambda p: F.struct(p["gap"].alias("gap"), p["entity"].alias("found"), F.when(p["entity"].isNotNull(), _kind(p["entity"])).alias("found_kind")))
    # all texts are searched here and nowhere else
    cut = rows.select("kept", "text", F.when(F.col("text").rlike(_HINT), named).alias("parts"))
    cut = cut_lineage(cut.select(F.monotonically_increasing_id().alias("row"), "kept", F.when(F.coalesce(F.size("parts"), F.lit(0)) < 2, F.col("text")).alias("text"), F.when(F.size("parts") > 1, F.col("parts")).alias("parts")))
    clean = cut.filter("parts is null").select("kept", "text", F.array().cast(listed).alias("entities"))
    parts = cut.filter("parts is not null").select("row", "kept", F.posexplode("parts").alias("i", "part"))
    parts = cut_lineage(parts.select("row", F.when(F.col("i") == 0, F.col("kept")).alias("kept"), "i", "part.*"))
    words = cut_lineage(_name_words(_all_units(parts.filter("found_kind = 'name'"), "found")))
    parts = cut_lineage(_with_mentions(parts, words))
    word = words.select(F.col("row").alias("word_row"), "word", "word_kind")
    every = _all_units(parts, "found")
    named = every.filter("kind = 'again' or kind like 'name\\_%'").join(word, (F.col("row") == F.col("word_row")) & (F.lower("entity") == F.col("word")), "left").withColumn("kind", F.col("word_kind"))
    columns = ("row", "i", "j", "kind", "entity", "tail")
    units = cut_lineage(every.filter("kind <> 'again' and kind not like 'name\\_%'").select(*columns).unionByName(named.select(*columns)))
    table = assign(units.filter("kind != 'title'"), key)
    said = spread_join(units, table, ["kind", "entity"], "left").groupBy("row", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", F.concat(F.coalesce("surrogate", "entity"), F.col("tail")).alias("s")))), lambda x: x["s"]), " ").alias("surrogate"))
    whole = parts.join(said, ["row", "i"], "left").groupBy("row").agg(F.first("kept", ignorenulls=True).alias("kept"), F.array_sort(F.collect_list(F.struct("i", "gap", "found", "found_kind", "surrogate"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["gap"], F.coalesce(p["surrogate"], F.lit("")))), "")
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(listed).alias("out")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["gap"]) + F.coalesce(F.length(p["found"]), F.lit(0))).alias("at"),
            F.when(p["found"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(p["found_kind"].alias("kind"), (s["at"] + F.length(p["gap"])).alias("start"), (s["at"] + F.length(p["gap"]) + F.length(p["found"])).alias("end"), p["surrogate"].alias("surrogate"))))).alias("out"),
        ),
    )["out"]
    changed = whole.select("kept", text.alias("text"), spans.alias("entities"))
    return clean.unionByName(changed).select(*(F.col(f"kept.`{c}`").alias(c) for c in kept), "text", "entities")
