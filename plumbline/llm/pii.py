"""Personal data: entities get keyed surrogates of their type, script, gender and format (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.lines import row_key
from plumbline.llm.tables import materialize

KEY = "surrogates-1"

_MALE = r"Mr|Herrn?|Señor|Sr|Monsieur|г-н"
_FEMALE = r"Mrs|Ms|Miss|Frau|Señora|Señorita|Sra|Mme|Madame|Mlle|г-жа"
_EITHER = r"Dr|Prof|Doctor|Professor|Doktor"
_TITLE = rf"(?:{_MALE}|{_FEMALE}|{_EITHER})\.?[  ]"
#: A capitalised word, also behind Mc, Mac, O', D' and the like; all in capitals; an initial.
_NAME = r"(?:\p{Lu}\p{Ll}{0,3}['’]?)?\p{Lu}\p{Ll}{1,30}"
_CAPITALS = r"\p{Lu}(?:['’]?\p{Lu}){1,30}"
_INITIAL = r"\p{Lu}\."
_PARTICLE = r"(?:von|van|de|der|den|del|della|di|da|dos|du|la|le|ten|ter|zu|zur|bin|ibn|al)"
_PART = rf"(?:{_NAME}|{_CAPITALS}|{_INITIAL})(?![\p{{L}}\p{{N}}])"
#: Up to five parts with particles before them.
_FULL = rf"(?:{_PARTICLE}[  ]){{0,2}}{_PART}(?:[  \-](?:{_PARTICLE}[  ]){{0,2}}{_PART}){{0,4}}"
_WORD = rf"(?<![\p{{L}}\p{{N}}])(?:{_NAME}|{_CAPITALS})(?![\p{{L}}\p{{N}}])"
#: Names that are common words or months too, which stay where they stand alone.
_COMMON = "April August Best Bill Black Brown Chase Frank Good Grace Grant Green Hill Hope June King Long Mark May Rich Rose Will White Wise Young".split()
_DATE = r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./\-]\d{1,2}[./\-]\d{4}"
_BORN = r"(?:DOB|[Dd]ate of birth|[Bb]orn|[Bb]orn on|[Gg]eboren am|[Nn]ée? le|[Nn]acid[oa] el|[Рр]одил(?:ся|ась))"
_STREET = r"(?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Lane|Boulevard|Blvd\.|Drive|Court)"
_STRASSE = r"(?:straße|strasse|gasse|platz|weg|allee)"

#: Kinds and their patterns; of overlapping matches the first in the text counts, then the first kind here.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[\p{L}\p{N}\-]{1,63}+\.){1,8}[\p{L}]{2,24}",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}{_FULL}",
    "secret": r"(?<![\p{L}\p{N}_])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+|A[KS]IA[A-Z0-9]{16}|eyJ[A-Za-z0-9_\-]{8,512}+\.[A-Za-z0-9_\-]{8,2048}+\.[A-Za-z0-9_\-]{8,512}+|(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-][A-Za-z0-9_\-]{16,128}+)(?![\p{L}\p{N}_])",
    "iban": r"(?<![\p{L}\p{N}])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?\d{4}){3,7}(?: ?\d{1,3})?)(?![\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\d:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\d:])",
    "ip": r"(?<![\p{L}\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\d]|\.\d)",
    "birth": rf"(?<={_BORN}:?[  ])(?:{_DATE})(?!\d)",
    "passport": r"(?<=[Pp]assport(?: [Nn]o\.?| [Nn]umber)?:?[  ])[A-Z]{0,2}\d{6,9}(?![\p{L}\d])",
    "address": rf"(?<![\p{{L}}\d])(?:\d{{1,5}} (?:{_NAME} ){{1,2}}{_STREET}|{_NAME}{_STRASSE} \d{{1,4}})(?![\p{{L}}\d])",
    "phone": r"(?<![\p{L}\d+])(?:0\d{4} \d{6}|\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\p{L}\d])",
    "ssn": r"(?<![\p{L}\d\-])\d{3}-\d{2}-\d{4}(?![\p{L}\d\-])",
    "card": r"(?<![\p{L}\d.\-])\d(?:[ \-]?\d){12,18}(?![\p{L}\d])",
}
#: The kinds whose patterns look at what comes before, as a mention alone shows them.
_WHOLE = PATTERNS | {"birth": _DATE, "passport": r"[A-Z]{0,2}\d{6,9}"}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must hold to be looked at closely.
_HINT = rf"[0-9@]|{_TITLE}\p{{Lu}}|[a-fA-F]{{32}}|eyJ|(?:sk|pk|gh[po]|xox[bp])[_\-]|[a-fA-F]:[a-fA-F:]"

#: Names of surrogates are put together: a beginning, a middle and an end that tells given from family name and gender.
BEGINNINGS = {
    "latin": "Bar Bel Cor Dal Dor Fal Fen Gal Gar Hal Jor Kal Ker Lan Lor Mal Mer Nor Per Quin Ral Ros Sal Sel Tal Tor Val Ver Wen Zan".split(),
    "cyrillic": "Бар Вел Гор Дар Жел Зар Кор Лад Мал Нов Пер Рад Сав Тар Фед Хол Чер Шел Юр Яр".split(),
}
MIDDLES = {
    "latin": "ab ad al am an ar as ed el em en er ev id il im in ir od ol om on or os ub ul un ur".split(),
    "cyrillic": "ад ал ам ан ар ед ел ем ен ер ид ил им ин од ол ом он ор уд ул ур".split(),
}
ENDINGS = {
    ("family", "latin"): "son berg ley man well ton field ford by sen worth wick".split(),
    ("male", "latin"): "o us rick bert win do".split(),
    ("female", "latin"): "a ia ine ella issa etta".split(),
    ("any", "latin"): "is ey o a en el".split(),
    ("family", "cyrillic"): "ов ев ин".split(),
    ("male", "cyrillic"): "ей ий ан ир".split(),
    ("female", "cyrillic"): "а ия ина ея".split(),
    ("any", "cyrillic"): "ан а ий ия".split(),
}


def kind_of(mention: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(_WHOLE.items()):
        found = F.when(mention.rlike(rf"\A(?:{pattern})\z"), F.lit(kind)).otherwise(found)
    return found


def canonical(mention: Column, kind: Column) -> Column:
    """The form that all mentions of an entity share: digits for numbers, lower case for addresses."""
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    return (
        F.when(kind == "phone", F.concat(F.when(mention.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.upper(F.replace(mention, F.lit(" "), F.lit(""))))
        .when(kind.isin("email", "ipv6"), F.lower(mention))
        .otherwise(mention)
    )


def _noise(key: str, kind: Column, value: Column, attempt: int) -> Column:
    """256 hex digits from the key, the entity and the attempt."""
    return F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), kind, F.lit(f"{attempt}|{part}"), value), 512) for part in range(2)])


def _byte(noise: Column, at: Column) -> Column:
    # three hex digits, so that no remainder is much likelier than another
    return F.conv(F.substring(noise, F.pmod(at * 3, F.lit(252)) + 1, F.lit(3)), 16, 10).cast("int")


def _pick(chars: str, noise: Column, at: Column) -> Column:
    return F.substring(F.lit(chars), F.pmod(_byte(noise, at), F.lit(len(chars))) + 1, F.lit(1))


_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"


def _like(value: Column, noise: Column, hexadecimal: Column) -> Column:
    """A string with a character of the same script, case and kind for each letter or digit; the rest as it is."""

    def swap(c: Column, i: Column) -> Column:
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC, noise, i)).otherwise(_pick(_LATIN, noise, i))
        letter = F.when(hexadecimal, _pick("abcdef", noise, i)).otherwise(letter)
        return (
            F.when(c.rlike(r"[0-9]"), _pick("0123456789", noise, i))
            .when(c.rlike(r"\p{Lu}"), F.upper(letter))
            .when(c.rlike(r"\p{L}"), letter)
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), swap), "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, x: Column) -> Column:
        d = F.substring(digits, x, F.lit(1)).cast("int")
        doubled = F.when((n - x) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + doubled

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _iban_check(country: Column, body: Column) -> Column:
    """The two check digits that make the remainder by 97 right."""

    def step(rest: Column, c: Column) -> Column:
        digit = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.pmod(rest * F.when(digit > 9, F.lit(100)).otherwise(F.lit(10)) + digit, F.lit(97))

    rest = F.aggregate(F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != ""), F.lit(0), step)
    return F.lpad((F.lit(98) - rest).cast("string"), 2, "0")


def _date_like(value: Column, noise: Column) -> Column:
    """A date of the same form, valid whichever of its short numbers is the month: both lie between 1 and 12."""

    def one(part: Column, i: Column) -> Column:
        year = (F.pmod(_byte(noise, i), F.lit(60)) + 1940).cast("string")
        short = F.when(F.length(part) == 1, F.pmod(_byte(noise, i), F.lit(9)) + 1).otherwise(F.pmod(_byte(noise, i), F.lit(12)) + 1)
        return F.when(F.length(part) == 4, year).otherwise(F.lpad(short.cast("string"), F.length(part), F.lit("0")))

    joined = F.array_join(F.transform(F.split(value, r"[./\-]"), one), "/")
    return F.replace(joined, F.lit("/"), F.regexp_extract(value, r"[./\-]", 0))


def surrogate(kind: Column, value: Column, attempt: Column, noise: Column, host_noise: Column) -> Column:
    """The surrogate of an entity in canonical form, from the noise of its attempt.

    From the fourth attempt on, addresses, secrets and names grow longer, as a short format may have too
    few forms for all entities that share it.
    """
    more = F.greatest(attempt - 3, F.lit(0))
    longer = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda j: _pick(_LATIN, noise, j + 60)), "")).otherwise(F.lit(""))
    no = F.lit(False)
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(host, ".", -1)
    sites = F.substring(host, F.lit(1), F.length(host) - F.length(top))
    email = F.concat(_like(local, noise, no), longer, F.lit("@"), _like(sites, host_noise, no), top)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: (F.pmod(_byte(noise, j), F.lit(254)) + 1).cast("string")), ".")
    fixed = F.when(value.startswith("0"), F.lit(1)).when(~value.startswith("+"), F.lit(0)).when(value.rlike(r"^\+[17]"), F.lit(2)).otherwise(F.lit(3))
    phone = F.concat(F.substring(value, F.lit(1), fixed), _like(F.substring(value, fixed + 1, F.length(value)), noise, no))
    body = _like(F.substring(value, F.lit(1), F.length(value) - 1), noise, no)
    check = F.pmod(_luhn(value) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    account = _like(F.substring(value, F.lit(5), F.length(value)), noise, no)
    iban = F.concat(F.substring(value, 1, 2), _iban_check(F.substring(value, 1, 2), account), account)
    cased = F.when(value.rlike(r"\A[0-9a-fA-F]+\z"), F.lit(True)).otherwise(no)
    prefix = F.when(cased, F.lit("")).otherwise(F.regexp_extract(value, r"\A(A[KS]IA|eyJ|[a-z]{2,4}[_\-])", 1))
    secret = F.concat(prefix, _like(F.substring(value, F.length(prefix) + 1, F.length(value)), noise, cased), longer)
    kept = F.regexp_extract(value, rf"(?: {_STREET}|{_STRASSE})(?= \d+\z|\z)", 0)
    at = F.instr(value, kept)
    address = F.concat(_like(F.substring(value, F.lit(1), at - 1), noise, no), kept, _like(F.substring(value, at + F.length(kept), F.length(value)), host_noise, no))

    def named(kind: str, script: str) -> Column:
        parts = [F.array(*[F.lit(x) for x in names]) for names in (BEGINNINGS[script], MIDDLES[script], MIDDLES[script], ENDINGS[kind, script])]
        one = lambda k: F.element_at(parts[k], F.pmod(_byte(noise, F.lit(k)), F.size(parts[k])) + 1)
        middle = F.when(attempt == 0, one(1)).otherwise(F.concat(one(1), one(2)))
        extra = F.when(attempt > 3, F.repeat(one(2), F.greatest(attempt - 3, F.lit(0)))).otherwise(F.lit(""))
        return F.concat(one(0), middle, extra, one(3))

    cyrillic = value.rlike(r"\p{IsCyrillic}")
    found = F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "phone", phone).when(kind == "card", F.concat(body, check))
    found = found.when(kind == "iban", iban).when(kind == "secret", secret).when(kind.isin("ssn", "passport"), _like(value, noise, no))
    found = found.when(kind == "ipv6", _like(value, noise, F.lit(True))).when(kind == "birth", _date_like(value, noise)).when(kind == "address", address)
    for name in ("male", "female", "any", "family"):
        by_script = F.when(cyrillic, named(name, "cyrillic")).otherwise(named(name, "latin"))
        found = found.when(kind == ("family" if name == "family" else f"given-{name}"), by_script)
    return found


#: Family names that add an ending for women.
_WITH_ENDING = r"(?:ов|ев|ёв|ин|ын)а\z"


def _tokens_of(mention: Column) -> Column:
    """The words of a name behind its title, particles and initials too."""
    return F.split(F.regexp_replace(mention, rf"\A{_TITLE}", ""), r"[  \-]")


def _is_part(token: Column) -> Column:
    return ~token.rlike(rf"\A(?:{_PARTICLE}|{_INITIAL})\z")


def _parts_of(mention: Column) -> Column:
    """The words that get a surrogate, as they are written."""
    return F.filter(_tokens_of(mention), _is_part)


def _same(part: Column) -> Column:
    """The form that a name in capitals shares with others."""
    return F.initcap(F.lower(part))


def _family(name: Column) -> Column:
    """The form that men and women of a family share."""
    return F.when(name.rlike(_WITH_ENDING), F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)


def entities(mention: Column, kind: Column) -> Column:
    """array<struct<kind, value>>: a mention's entities; of a name the last word, with those joined to it, is the family's, others are given."""
    one = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    parts = F.transform(_parts_of(mention), _same)
    joined = F.regexp_extract(mention, r"[^  ]+\z", 0)
    families = F.size(F.filter(F.split(joined, "-"), _is_part))
    title = lambda words: mention.rlike(rf"\A(?:{words})\.?[  ]")
    given = F.when(title(_MALE), F.lit("given-male")).when(title(_FEMALE), F.lit("given-female")).otherwise(F.lit("given-any"))
    names = F.transform(parts, lambda x, i: F.when(i < F.size(parts) - families, one(given, x)).otherwise(one(F.lit("family"), _family(x))))
    return F.when(kind == "name", names).otherwise(F.array(one(kind, canonical(mention, kind))))


def _as_written(part: Column, chosen: Column, family: Column) -> Column:
    """A surrogate with the ending and the case of the word that it replaces."""
    ended = F.concat(chosen, F.when(family & _same(part).rlike(_WITH_ENDING), F.lit("а")).otherwise(F.lit("")))
    return F.when((part == F.upper(part)) & (F.length(part) > 1), F.upper(ended)).otherwise(ended)


def _rendered(mention: Column, kind: Column, chosen: Column) -> Column:
    """The surrogates in the format of a mention: its separators, its title, its case."""
    value = F.element_at(chosen, 1)
    lower = mention.rlike(r"[a-z]")
    plain = F.regexp_replace(F.when((kind == "iban") & lower, F.lower(value)).otherwise(value), r"^\+", "")

    def fill(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"[^0-9A-Za-z]", ""))
        return F.when(c.rlike(r"[0-9A-Za-z]"), F.substring(plain, place, F.lit(1))).otherwise(c)

    filled = F.array_join(F.transform(F.split(mention, ""), fill), "")
    title = F.regexp_extract(mention, rf"\A{_TITLE}", 0)
    tokens = _tokens_of(mention)
    marks = F.regexp_extract_all(F.substring(mention, F.length(title) + 1, F.length(mention)), F.lit("[  \\-]"), F.lit(0))

    def written(token: Column, i: Column) -> Column:
        at = F.size(F.filter(F.slice(tokens, 1, i + 1), _is_part))
        new = _as_written(token, F.try_element_at(chosen, at), at == F.size(chosen))
        # an initial becomes that of the family's surrogate
        new = F.when(token.rlike(rf"\A{_INITIAL}\z"), F.concat(F.substring(F.element_at(chosen, -1), 1, 1), F.lit("."))).when(_is_part(token), new).otherwise(token)
        return F.concat(new, F.coalesce(F.get(marks, i), F.lit("")))

    name = F.concat(title, F.array_join(F.transform(tokens, written), ""))
    upper = (mention == F.upper(mention)) & mention.rlike(r"\p{Lu}")
    return (
        F.when(kind == "name", name)
        .when(kind.isin("phone", "card", "ssn", "iban"), filled)
        .when(kind.isin("email", "ipv6") & upper, F.upper(value))
        .otherwise(value)
    )


def _alone(mention: Column, kind: Column, chosen: Column) -> Column:
    """array<struct<mention, replacement>>: the names of a titled mention as they may stand alone, in capitals too."""
    parts = _parts_of(mention)
    pair = lambda a, b: F.struct(a.alias("mention"), b.alias("replacement"))
    family = lambda i: i == F.size(parts) - 1
    own = F.transform(parts, lambda x, i: pair(x, _as_written(x, F.get(chosen, i), family(i))))
    own = F.concat(own, F.transform(parts, lambda x, i: pair(_same(x), _as_written(_same(x), F.get(chosen, i), family(i)))))
    last, new, ending = _family(_same(F.element_at(parts, -1))), F.element_at(chosen, -1), F.lit("а")
    forms = F.array(*[pair(F.concat(last, e), F.concat(new, e)) for e in (F.lit(""), ending)])
    none = F.array().cast("array<struct<mention:string,replacement:string>>")
    both = F.concat(own, F.when(last.rlike(r"\p{IsCyrillic}"), forms).otherwise(none))
    both = F.filter(both, lambda e: ~e["mention"].isin(_COMMON))
    capitals = F.transform(both, lambda e: pair(F.upper(e["mention"]), F.upper(e["replacement"])))
    return F.when((kind == "name") & (F.size(parts) > 0), F.concat(both, F.filter(capitals, lambda e: F.length(e["mention"]) > 2))).otherwise(none)


def mentions(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(none)


def assign_surrogates(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, surrogate): distinct entities with a surrogate that is theirs alone.

    found: (kind, value). A surrogate collides if another entity of the kind has it too, or if it is
    itself an entity of the texts; upper and lower case count as the same. Of those that share one the
    least value keeps it; the others, and those that hit an entity, try again until none is left.
    """
    known = materialize(found.distinct(), "entities")
    group = F.regexp_replace("kind", "-(?:male|female|any)$", "")  # names of all genders share a space
    taken = known.select(group.alias("group"), F.lower("value").alias("lower")).distinct()
    settled, open_, attempt = None, known, 0
    while True:
        host = F.substring_index("value", "@", -1)  # addresses of a host stay together
        noisy = open_.select(
            "kind", "value", _noise(key, F.col("kind"), F.col("value"), attempt).alias("noise"), _noise(key, F.lit("host"), host, 0).alias("host_noise")
        )
        new = surrogate(F.col("kind"), F.col("value"), F.lit(attempt), F.col("noise"), F.col("host_noise"))
        tried = materialize(materialize(noisy, "noise").select("kind", "value", group.alias("group"), new.alias("surrogate")), "surrogates-tried")
        best = tried.groupBy("group", F.lower("surrogate").alias("lower")).agg(F.min(F.struct("value", "kind", "surrogate")).alias("best"))
        won = best.join(taken, ["group", "lower"], "left_anti").select("best.kind", "best.value", "best.surrogate", "group", "lower")
        won = materialize(won, "surrogates-won")
        settled = won if settled is None else settled.unionByName(won)
        taken = taken.unionByName(won.select("group", "lower"))
        open_ = materialize(open_.join(won, ["kind", "value"], "left_anti"), "surrogates-open")
        if open_.isEmpty():
            return settled.select("kind", "value", "surrogate")
        attempt += 1


def replace_entities(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """All columns of docs with each entity of the text replaced by its surrogate, and n_replaced.

    The same entity has the same surrogate in all texts, whatever the format of its mention, and no two
    entities share one; a family's men and women share theirs. Names are found after a title, of up to five parts
    with particles and initials; in the same text their parts are replaced wherever they stand alone too, but for a list of
    common words. A surrogate follows from key and entity alone, except where it collides.

    Nulls: a null text stays null with none replaced; ids may be null or repeat. A text without entities
    stays as it is. An input column named n_replaced is replaced. An empty table gives none.
    """
    text = F.col(f"`{text_col}`").cast("string")
    row_a, row_b = row_key(id_col, text_col)
    spoken = docs.select(row_a, row_b, F.explode(F.array_distinct(mentions(text))).alias("mention")).distinct()
    spoken = materialize(spoken, "mentions")
    distinct = spoken.select("mention").distinct().withColumn("kind", kind_of(F.col("mention")))
    distinct = materialize(distinct.select("*", entities(F.col("mention"), F.col("kind")).alias("entities")), "mentions-distinct")
    each = distinct.select("mention", F.col("kind").alias("mention_kind"), F.posexplode("entities").alias("place", "e"))
    each = each.select("mention", "mention_kind", "place", "e.kind", "e.value")
    chosen = (
        each.join(assign_surrogates(each.select("kind", "value"), key), ["kind", "value"])
        .groupBy("mention", "mention_kind")
        .agg(F.array_sort(F.collect_list(F.struct("place", "surrogate")))["surrogate"].alias("chosen"))  # two at most
    )
    m, k, c = F.col("mention"), F.col("mention_kind"), F.col("chosen")
    rendered = materialize(chosen.select("mention", _rendered(m, k, c).alias("replacement"), _alone(m, k, c).alias("alone")), "replacements")
    own = F.array(F.struct("mention", "replacement"))
    each = spoken.join(rendered, "mention").select("row_a", "row_b", F.inline(F.concat(own, F.col("alone"))).alias("key", "replacement"))
    each = each.groupBy("row_a", "row_b", "key").agg(F.min("replacement").alias("replacement"))
    by_row = each.groupBy("row_a", "row_b").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "replacement"))).alias("replacements"), F.bool_or(F.col("key").rlike(rf"\A(?:{_NAME}|{_CAPITALS})\z")).alias("named")
    )
    kept = [c for c in docs.columns if c.lower() != "n_replaced"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), row_a, row_b).join(by_row, ["row_a", "row_b"], "left")
    text = F.col("row")[text_col].cast("string")
    rows = rows.select("row", text.alias("text"), "replacements", "named")
    # two patterns for all rows, each compiled once: where names may stand alone every capitalised word is looked up
    whole, words = F.lit(_ANY), F.lit(f"{_ANY}|{_WORD}")
    found = lambda pattern: F.regexp_extract_all("text", pattern, F.lit(0))
    rows = rows.withColumn("mentions", F.when(F.col("replacements").isNull(), F.lit(None)).when(F.col("named"), found(words)).otherwise(found(whole)))
    known = lambda m: F.try_element_at("replacements", m)
    pieces = F.when(F.col("named"), F.split("text", words, -1)).otherwise(F.split("text", whole, -1))
    new = F.transform("mentions", lambda m: F.coalesce(known(m), m))
    woven = F.array_join(F.zip_with(pieces, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    left = F.when(F.col("mentions").isNotNull(), woven).otherwise(F.col("text"))
    rows = rows.select("row", left.alias("left"), F.size(F.filter("mentions", lambda m: known(m).isNotNull())).alias("n"))
    rows = rows.withColumn("n_replaced", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long"))
    return rows.select(*[F.col("left").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept], "n_replaced")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_replaced")
