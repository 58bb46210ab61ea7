"""Surrogates for personal data (operator 10), native.

Detected: e-mail addresses, telephone numbers (with +, with 00, and North American ones),
IPv4 and IPv6 addresses, card numbers with a right check digit, social security numbers,
IBANs (whatever their check number), hexadecimal secrets and access tokens with a known
beginning, and names after a form of address. Each entity has a canonical form (digits
of a number with its country code, lower case of an address, gender and name of a
person), and each distinct canonical form gets one surrogate, keyed by SHA-512 over key,
type, form and attempt. So all mentions of an entity read alike afterwards (coreference),
in the format of each mention: separators, letter case, country code, right check digits
of cards and IBANs, a name's gender, script and number of words stay. Further mentions of
a name of two words or more in the same document are replaced without a form of address
too. A name that never follows one isn't found.

Distinct entities get distinct surrogates, which no detected entity already has: equal
proposals and proposals that exist in the corpus are found by grouping, all but the
first propose again with the next attempt, and this goes on until none is left. From
the fourth attempt on proposals grow by a place each time, so that no kind runs out.

Only DataFrame functions are used. Documents with entities are written once with a
row number, their entities are looked up and the texts are put together again; all
others pass as they are.

Defined results: null and empty texts stay; a text of any length is searched whole; where
kinds overlap the leftmost match counts, then the order of PATTERNS; of equal proposals
the first by form wins; repeated rows stay and get the same surrogates; an empty table
stays empty; further columns, whatever their names, are returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared

TEXT = "text"
# Forms of address. Those that tell no gender count as the first kind.
MALE, FEMALE = "Mr|Sir|Lord|Dr|Prof|Herr|Señor|Sr|Monsieur|Signor|Г-н|Κύριος", "Mrs|Ms|Miss|Lady|Frau|Señora|Sra|Madame|Mme|Signora|Г-жа|Κυρία"
WORD = r"\p{Lu}(?:\.|[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*)"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
GROUP = "[0-9A-Fa-f]{1,4}"
ADDRESS = rf"{OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)"
#: Country codes: one digit, two, else three.
COUNTRY = r"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: What ends an international number once it has seven digits: a number that reads as
#: a card, a social security number or a telephone number itself.
OTHER = r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d|[ -]\d{4}(?!\d))|\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)|\d{13}|\d{3}-\d{2}-\d{4}(?![\d-])|\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
# A repeated group has no known length for Java's lookbehind, so it is written out.
NEXT = rf"(?!{ADDRESS})(?!(?<={r'\d[ .()-]{0,2}' * 7})(?:{OTHER}))"
SIXTEEN = r"\d[ .()-]{0,2}" * 15 + r"\d"

#: Kinds in order of precedence. None has a capturing group.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": rf"(?<![\d.]){ADDRESS}",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?=[0-9A-Fa-f:]*\d)(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}}|(?:{GROUP}:){{2,7}}:|::(?:{GROUP}:){{1,6}}{GROUP})(?![\p{{L}}\p{{N}}:])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,128}(?![\p{L}\p{N}])",
    # How access tokens of public services begin.
    "token": r"(?<![\p{L}\p{N}_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|github_pat_[A-Za-z0-9_]{20,255}|sk-[A-Za-z0-9_-]{20,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|AIza[A-Za-z0-9_-]{35})(?![\p{L}\p{N}_-])",
    "ssn": r"(?<![\d-])(?:\d{3}-\d{2}-\d{4}|(?<!\d )\d{3} \d{2} \d{4}(?! \d))(?![\d-])",
    # A run of numbers that may hold a card; `pieces` takes it apart.
    "card": rf"(?<![\d+(.-])(?=\d(?:[ -]?\d){{12}})\d[\d -]{{11,}}\d(?![\d-]|(?:\.{OCTET}){{3}}(?!\d|\.\d))",
    # Ten digits after +1 and +7, elsewhere up to 15 with the country code.
    "phone": rf"(?<![\p{{L}}\d+])\+[17][ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{2}}[ .-]?\d{{2}}(?!\d)|(?<![\p{{L}}\d+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?{NEXT}\d{{1,5}}(?:[ .-]?{NEXT}\d{{2,5}}){{1,5}}(?!\d)(?<!{SIXTEEN})"
    rf"|(?<![\p{{L}}\d+.-])(?<!\d )00[1-9]\d{{0,2}}[ .-](?:\(\d{{1,4}}\)[ .-]?)?{NEXT}\d{{1,5}}(?:[ .-]?{NEXT}\d{{2,5}}){{1,5}}(?!\d)(?<!{SIXTEEN})"
    r"|(?<![\d(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "name": rf"(?<![\p{{L}}\p{{N}}-])(?:{MALE}|{FEMALE})\.? {WORD}(?: {WORD}){{0,2}}",
}
#: A text without any of these holds no entity.
TRIGGER = rf"[0-9@]|::|(?<![\p{{L}}\p{{N}}-])(?:{MALE}|{FEMALE})\.? \p{{Lu}}"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What else a run of numbers can hold.
REST = f"(?:{PATTERNS['ssn']})|(?:{PATTERNS['phone']})"
MARK = "\x01"  # in no match

#: Syllables of surrogate names, for each script: the starts and the vowels, equal in number.
SCRIPTS = {
    "cyrillic": (r"\p{IsCyrillic}", "бвгдзклмнпрстфхц", "аеиоуяюэаеиоуыеи", "н", "а"),
    "greek": (r"\p{IsGreek}", "βγδζθκλμνπρστφχψ", "αεηιουωαεηιουωαε", "ς", "α"),
    "latin": ("", "bcdfghjklmnprstv", "aeiouaeioyaeioua", "n", "a"),
}
HEX = "0123456789abcdef"
#: From this attempt on proposals grow.
GROWS = 3
#: Parts a surrogate's added digits from the others.
MORE = "x"

def pieces(match: Column) -> Column:
    """A match as structs (part, is_entity). A run of numbers is searched for cards: whole
    numbers, 13 to 19 digits with a right check digit, all but the last of at least four
    digits; the earliest and then the shortest is taken, but the whole run before its
    parts. What is left is searched for the kinds of REST. A run without either is a card
    in any grouping if its check digit is right, and otherwise stays."""

    def bound(value: Column, then) -> Column:
        """then(value), with value computed once."""
        return F.element_at(F.transform(F.array(value), then), 1)

    def valid(number: Column) -> Column:
        return bound(number, lambda x: F.when(F.length(x).between(13, 19), _luhn(x) % 10 == 0).otherwise(False))

    run = F.struct(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0)).alias("numbers"), F.split(match, "[0-9]+", -1).alias("between"))
    split = bound(run, lambda x: _taken_apart(match, x["numbers"], x["between"], bound, valid))
    return F.when(match.rlike(r"\A\d[\d -]{11,}\d\z"), split).otherwise(F.array(F.struct(match.alias("part"), F.lit(True).alias("is_entity"))))


def _taken_apart(match: Column, numbers: Column, between: Column, bound, valid) -> Column:
    def window(i: Column, j: Column) -> Column:
        inner = F.forall(F.slice(between, i + 2, j - i), lambda x: F.length(x) == 1) & F.forall(F.slice(numbers, i + 1, j - i), lambda x: F.length(x) >= 4)
        return F.when(inner, valid(F.array_join(F.slice(numbers, i + 1, j - i + 1), ""))).otherwise(False)

    def taken(state: Column, i: Column, ends: Column) -> Column:
        last = F.when(F.size(ends) > 0, F.get(ends, F.lit(0))).otherwise(i)
        longer = F.zip_with(F.slice(between, i + 2, last - i), F.slice(numbers, i + 2, last - i), lambda a, b: F.concat(a, b))
        mark = F.when(F.size(ends) > 0, MARK).otherwise("")
        text = F.concat(F.element_at(between, i + 1), mark, F.element_at(numbers, i + 1), F.array_join(longer, ""), mark)
        return F.struct((last + 1).alias("free"), F.concat(state["out"], F.array(text)).alias("out"))

    def step(state: Column, i: Column) -> Column:
        ends = F.filter(F.sequence(i, F.least(i + 4, F.size(numbers) - 1)), lambda j: window(i, j))
        return F.when(i < state["free"], state).otherwise(bound(ends, lambda x: taken(state, i, x)))

    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("out"))
    cards = F.array_join(F.aggregate(F.sequence(F.lit(0), F.size(numbers) - 1), start, step)["out"], "")
    marked = F.transform(F.split(cards, MARK, -1), lambda x, k: F.when(k % 2 == 1, F.concat(F.lit(MARK), x, F.lit(MARK))).otherwise(F.regexp_replace(x, REST, f"{MARK}$0{MARK}")))
    whole = F.concat(F.lit(MARK), match, F.lit(MARK))
    evenly = F.forall(F.slice(between, 2, F.size(numbers) - 1), lambda x: F.length(x) == 1) & F.forall(F.slice(numbers, 1, F.size(numbers) - 1), lambda x: F.length(x) >= 4)
    right = valid(F.array_join(numbers, ""))
    chosen = F.when(evenly & right, whole).otherwise(bound(F.array_join(marked, ""), lambda x: F.when(x.contains(MARK), x).when(right, whole).otherwise(match)))
    return F.transform(F.split(chosen, MARK, -1), lambda x, k: F.struct(x.alias("part"), (k % 2 == 1).alias("is_entity")))


def kind(entity: Column) -> Column:
    """The kind of a match; null for a number that fails a card's check."""
    out = F.lit("name")
    for name, pattern in [*reversed(PATTERNS.items())][1:]:
        whole = entity.rlike(rf"\A(?:{pattern})\z")
        if name == "card":
            whole &= _luhn(F.regexp_replace(entity, "[^0-9]", "")) % 10 == 0
        out = F.when(whole, name).otherwise(out)
    return F.when((out == "name") & entity.rlike(r"\A\d"), None).otherwise(out)


def canonical(of: Column, entity: Column) -> Column:
    """What all mentions of one entity have in common."""
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    gender = F.when(entity.rlike(rf"\A(?:{FEMALE})\.? "), "f:").otherwise("m:")
    phone = F.when(entity.startswith("+"), F.concat(F.lit("+"), digits)).when(entity.startswith("00"), F.concat(F.lit("+"), F.substring(digits, F.lit(3), F.length(digits)))).otherwise(F.concat(F.lit("+1"), digits))
    return (
        F.when(of.isin("card", "ssn"), digits)
        .when(of == "phone", phone)
        .when(of == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(of == "token", entity)
        .when(of == "name", F.concat(gender, F.regexp_replace(entity, r"\A\S+ ", "")))
        .otherwise(F.lower(entity))
    )


def _drawn(hash_: Column, at: Column, most: int) -> Column:
    """A number below `most` from two hexadecimal digits of a 128-digit hash."""
    return F.conv(F.substring(hash_, 1 + 2 * (at % 64), F.lit(2)), 16, 10).cast("int") % most


def _letters(form: Column, hash_: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """The form with other letters and digits, all else unchanged."""

    def put(c: Column, i: Column) -> Column:
        lower = F.substring(F.lit(letters), 1 + _drawn(hash_, i, len(letters)), F.lit(1))
        return F.when(c.rlike("[0-9]"), _drawn(hash_, i, 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(lower)).when(c.rlike(r"\p{L}"), lower).otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), put), "")


def _luhn(digits: Column) -> Column:
    """The check digit's sum over all digits, the last one counted singly."""
    n = F.length(digits)

    def weighed(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(F.split(digits, ""), weighed), F.lit(0), lambda a, b: a + b)


def _remainder(iban: Column) -> Column:
    """Modulo 97 of a string of capitals and digits, A as 10 and so on."""

    def step(at: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (at * 10 + c.cast("int")) % 97).otherwise((at * 100 + letter) % 97)

    return F.aggregate(F.split(iban, ""), F.lit(0), step)


def _name(form: Column, hash_: Column, attempt: Column, starts: str, vowels: str, male: str, female: str) -> Column:
    """A name of as many words; the first word ends as the gender's names do."""

    def word(_: Column, i: Column) -> Column:
        def syllable(k: int) -> Column:
            start, vowel = (F.substring(hash_, 1 + 30 * i + 2 * k + j, F.lit(1)) for j in (0, 1))
            return F.concat(F.translate(start, HEX, starts), F.translate(vowel, HEX, vowels))

        grown = F.concat(*[F.when(attempt >= GROWS + k, syllable(4 + k)).otherwise("") for k in range(8)])
        more = F.when(attempt >= GROWS, grown).otherwise("")
        ends = F.when((i == 0) & form.startswith("f:"), female).otherwise(vowels[3] + male)
        return F.initcap(F.concat(syllable(0), syllable(1), more, F.translate(F.substring(hash_, 26 + 30 * i, F.lit(1)), HEX, starts), ends))

    return F.concat(F.substring(form, 1, 2), F.array_join(F.transform(F.split(F.substring(form, F.lit(3), F.length(form)), " "), word), " "))


def proposal(of: Column, form: Column, attempt: Column, key: str) -> Column:
    """The surrogate form that an entity proposes at an attempt."""
    hash_ = F.sha2(F.concat_ws("\x1f", F.lit(key), of, form, attempt.cast("string")), 512)
    extra = F.when(attempt >= GROWS, F.translate(F.substring(hash_, 100, 8), HEX, "abcdefghijklmnop")).otherwise("")
    # A place more for each attempt; the number of attempts is a part of the hash.
    digits = F.concat(F.lit(MORE), F.substring(F.translate(hash_, "abcdef", "012345"), F.lit(1), attempt - GROWS + 1))
    more = F.when(attempt >= GROWS, digits).otherwise("")
    local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    top = F.substring_index(domain, ".", -1)
    inner = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    spread = _letters(F.concat(local, F.lit("@"), inner), hash_)
    email = F.concat(F.substring_index(spread, "@", 1), extra, F.lit("@"), F.substring_index(spread, "@", -1), F.lit("."), top)
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + _drawn(hash_, i, 254)).cast("string"))
    country = F.regexp_extract(form, rf"\A\+{COUNTRY}", 0)
    rest = F.substring(form, F.length(country) + 1, F.length(form))
    phone = F.concat(country, (2 + _drawn(hash_, F.lit(63), 8)).cast("string"), _letters(F.substring(rest, F.lit(2), F.length(rest)), hash_))
    body = F.concat(F.substring(form, 1, 1), _letters(F.substring(form, F.lit(2), F.length(form) - 2), hash_))
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.concat(body, check.cast("string"))
    account = _letters(F.substring(form, F.lit(5), F.length(form)), hash_)
    check97 = 98 - _remainder(F.concat(account, F.substring(form, 1, 2), F.lit("00")))
    iban = F.concat(F.substring(form, 1, 2), F.lpad(check97.cast("string"), 2, "0"), account)
    begins = F.regexp_extract(form, r"\A(?:AKIA|AIza|github_pat_|gh[pousr]_|sk-|xox[abprs]-)", 0)
    token = F.concat(begins, _letters(F.substring(form, F.length(begins) + 1, F.length(form)), hash_))
    name = _name(form, hash_, attempt, *SCRIPTS["latin"][1:])
    for pattern, *script in (SCRIPTS["greek"], SCRIPTS["cyrillic"]):
        name = F.when(form.rlike(pattern), _name(form, hash_, attempt, *script)).otherwise(name)
    numbers = (
        F.when(of == "ip", F.array_join(octets, "."))
        .when(of == "phone", phone)
        .when(of == "card", card)
        .when(of == "iban", iban)
        .when(of == "ssn", _letters(form, hash_))
        .when(of == "token", token)
        .when(of == "ipv6", _letters(F.regexp_replace(form, "[a-f]", "a"), hash_, "abcdef"))
        .when(of == "secret", _letters(F.regexp_replace(form, "[a-f]", "a"), hash_, "abcdef"))
    )
    return F.when(of == "email", email).when(of == "name", name).otherwise(F.concat(numbers, more))


def shown(of: Column, surrogate: Column) -> Column:
    """The form of a surrogate, as it would be detected."""
    return F.when(of.isin("email", "name"), surrogate).otherwise(F.concat(F.substring_index(surrogate, MORE, 1), F.when(surrogate.contains(MORE), F.substring_index(surrogate, MORE, -1)).otherwise("")))


def surrogate_map(forms: DataFrame, key: str) -> DataFrame:
    """kind, form, surrogate for the distinct rows (kind, form)."""
    forms = _shared.written(forms.distinct(), "forms")
    settled, open_ = None, forms.withColumn("attempt", F.lit(0))
    while True:  # ends, as proposals grow
        proposed = open_.withColumn("surrogate", proposal(F.col("kind"), F.col("form"), F.col("attempt"), key))
        proposed = _shared.written(proposed.withColumn("shown", shown(F.col("kind"), F.col("surrogate"))), "proposals")
        # The first by form wins, unless the surrogate is taken or is a form of the corpus.
        first = proposed.groupBy("kind", "shown").agg(F.min(F.struct("form", "surrogate")).alias("x"))
        taken = forms.select("kind", F.col("form").alias("shown"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "shown"))
        winners = first.join(taken, ["kind", "shown"], "left_anti").select("kind", F.col("x.form").alias("form"), F.col("x.surrogate").alias("surrogate"), "shown")
        winners = _shared.written(winners, "winners")
        settled = winners if settled is None else settled.union(winners)
        after = proposed.join(winners, ["kind", "form"], "left_anti").select("kind", "form", (F.col("attempt") + 1).alias("attempt"))
        open_ = _shared.written(after, "open")
        _shared.discard(proposed)
        if open_.isEmpty():
            return settled.select("kind", "form", "surrogate")


def mention(of: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate in the format of a mention."""
    base = F.substring_index(surrogate, MORE, 1)
    more = F.when(surrogate.contains(MORE), F.substring_index(surrogate, MORE, -1)).otherwise("")
    mine, its = (F.regexp_replace(x, "[^0-9]", "") for x in (entity, base))

    def digit(c: Column, i: Column) -> Column:
        # Numbers end alike; a country code may be missing, or begin with 00.
        at = F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), "[^0-9]", "")) + F.length(its) - F.length(mine) + 1
        return F.when(c.rlike("[0-9]") & (at > 0), F.substring(its, at, F.lit(1))).otherwise(c)

    def letter(c: Column, i: Column) -> Column:
        before = F.length(F.replace(F.substring(entity, F.lit(1), i), F.lit(" "), F.lit("")))
        return F.when(c == " ", c).otherwise(F.substring(base, before + 1, F.lit(1)))

    def cased(value: Column) -> Column:
        """As the entity: in capitals as a whole, or letter by letter."""
        each = F.transform(F.split(value, ""), lambda c, i: F.when(F.substring(entity, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
        whole = (entity == F.upper(entity)) & entity.rlike(r"\p{Lu}")
        return F.when(whole, F.upper(value)).when(entity == F.lower(entity), value).otherwise(F.array_join(each, ""))

    chars = F.split(entity, "")
    return (
        F.when(of.isin("card", "ssn", "phone"), F.concat(F.array_join(F.transform(chars, digit), ""), more))
        .when(of == "iban", F.concat(F.array_join(F.transform(chars, letter), ""), more))
        .when(of == "name", F.concat(F.regexp_extract(entity, r"\A\S+ ", 0), F.substring(surrogate, F.lit(3), F.length(surrogate))))
        .when(of == "token", F.concat(base, more))
        .when(of.isin("ip", "ipv6", "secret"), F.concat(cased(base), more))
        .otherwise(cased(surrogate))
    )


def replaced(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """docs with surrogates in the text. key: a secret, without which nobody can tell which
    surrogate an entity has; the same key gives the same surrogates unless forms collide.
    count: a column for the number of entities."""
    if not key:
        raise ValueError("surrogates need a key")
    _shared.prepare(docs.sparkSession)
    columns = docs.columns
    place = _shared.place(columns, TEXT)
    inner = _shared.numbered(docs)
    text = F.col(f"c{place}").cast("string")
    found = F.when(text.rlike(TRIGGER), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    marked = inner.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    held = _shared.written(marked.where(F.size("found") > 0).withColumn("row", F.monotonically_increasing_id()), "entities")
    each = held.select("row", F.posexplode("found").alias("at", "match")).select("row", "at", F.posexplode(pieces(F.col("match"))).alias("sub", "x"))
    each = each.select("row", "at", "sub", F.col("x.part").alias("entity"), F.when(F.col("x.is_entity"), kind(F.col("x.part"))).alias("kind"))
    each = each.withColumn("form", canonical(F.col("kind"), F.col("entity")))
    map_ = surrogate_map(each.where("kind is not null").select("kind", "form"), key)
    new = F.when(F.col("kind").isNull(), F.col("entity")).otherwise(mention(F.col("kind"), F.col("entity"), F.col("surrogate")))
    bare = F.when((F.col("kind") == "name") & F.col("form").contains(" "), F.struct(F.substring("form", F.lit(3), F.length("form")).alias("old"), F.substring("surrogate", F.lit(3), F.length("surrogate")).alias("new")))
    spoken = each.join(map_, ["kind", "form"], "left").select("row", F.struct("at", "sub", new.alias("new")).alias("x"), F.col("kind").isNotNull().cast("long").alias("is"), bare.alias("bare"))
    news = spoken.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("x"), F.sum("is").alias("n"), F.sort_array(F.collect_set("bare"), False).alias("names"))
    parts = F.split(text, ANY, -1)
    # The pieces of a match form one string again.
    joined = F.array_join(F.transform("x", lambda y: F.concat(F.when(y["sub"] == 0, MARK).otherwise(""), y["new"])), "")
    news_then_end = F.concat(F.slice(F.split(joined, MARK, -1), F.lit(2), F.size("found")), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(parts, news_then_end, lambda a, b: F.concat(a, b)), "")
    # Names without a form of address, longer ones first; no name has a backslash.
    told = F.aggregate("names", whole, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}'’-])\Q"), x["old"], F.lit(r"\E(?![\p{L}\p{N}]|['’-]\p{L})")), x["new"]))
    changed = held.join(news, "row").withColumn(f"c{place}", F.when(F.size("names") > 0, told).otherwise(whole))
    out = [F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]
    number = [c.alias(count) for c in (F.lit(0).cast("long"), F.col("n"))] if count else []
    untouched = marked.where(F.size("found") == 0).select(*out, *number[:1])
    return untouched.union(changed.select(*out, *number[1:]))
