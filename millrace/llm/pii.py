"""PII surrogates, by DataFrame functions only.

Entities are found by one pattern: e-mail addresses, IPv4 addresses, phone,
card, IBAN and social security numbers, access keys, assigned secrets, dates of birth (after a
word that says so), street addresses, and
person names after a title, a word that introduces one ("spoke with", "signed by", "Dear") or a known
given name, or before a Han honorific. Names without any such sign are not found. Every distinct entity (its
canonical form: case, blanks and punctuation aside) gets one keyed surrogate of
its type, so mentions of one entity stay mentions of one entity. A surrogate
that equals an entity of the corpus or another entity's surrogate is drawn
again until none does, so distinct entities stay distinct; names are of one syllable
more with each draw, so there are always enough of them. Surrogates are laid
into each mention's own format: separators, case, digits as digits, letters of
the same script as letters; card and IBAN check digits stay valid; octets stay
octets, dates dates, kinds of streets their words; names keep the gender of title, honorific or given name. Where all values of a
format are taken (a few one-digit octets, say), draws after WIDEN of them leave the
mention's lengths, and after LENGTHEN they append digits.

Only documents with entities are joined with surrogates; the others pass.

Defined results: null and empty texts and texts without entities stay as they
are, with n_entities 0; rows that repeat get equal results; an empty table
gives an empty result; all other columns pass unchanged, and helper columns
avoid their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, free_name

KEY = "millrace"
#: Draws from which a surrogate may leave its mention's lengths, and from which it grows by a digit each.
WIDEN = 6
LENGTHEN = 12

# Given names, surnames by script; the lists are examples and can be passed in.
GIVEN = {
    ("latin", "f"): ["Alice", "Anna", "Carla", "Diana", "Elena", "Emma", "Clara", "Helen", "Irene", "Julia", "Laura", "Maria", "Martha", "Nora", "Olivia", "Paula", "Rosa", "Sarah", "Sophie", "Teresa"],
    ("latin", "m"): ["Adam", "Albert", "Carlos", "Daniel", "David", "Eric", "Felix", "George", "Hugo", "James", "John", "Lucas", "Martin", "Michael", "Oscar", "Paul", "Peter", "Robert", "Simon", "Thomas"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    ("cyrillic", "m"): ["Антон", "Борис", "Иван", "Игорь", "Максим", "Олег", "Павел", "Роман"],
    ("greek", "f"): ["Άννα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"],
    ("greek", "m"): ["Αντώνης", "Γιώργος", "Κώστας", "Νίκος", "Πέτρος"],
}
FAMILY = {
    "latin": ["Abbott", "Barker", "Carver", "Dalton", "Ellery", "Fischer", "Garner", "Holmes", "Irving", "Keller", "Lambert", "Marlow", "Norton", "Osborne", "Palmer", "Quincy", "Romero", "Sutton", "Turner", "Vidal", "Weber", "Young"],
    "cyrillic": ["Волков", "Громов", "Зайцев", "Котов", "Лебедев", "Морозов", "Орлов", "Соколов"],
    "greek": ["Αγγέλου", "Βασιλείου", "Γεωργίου", "Δημητρίου", "Ιωάννου", "Παππάς"],
    "han": "王 李 张 刘 陈 杨 黄 赵 周 吴 林 高".split(),
}
# Syllables of further names: first and middle ones by script, last ones by script and gender, or of surnames (s).
FIRST = {
    "latin": "Al Ar Bel Bran Cal Cor Dal Del El Er Fal Fen Gar Gil Hal Her Il Jan Jor Kal Kel Lan Lor Mal Mer Nal Nor Or Pal Per Ral Ros Sal Ser Tal Tor Val Ver Wil Zan".split(),
    "cyrillic": "Ар Бел Вел Гор Дар Ер Жар Зал Ил Кал Лад Мел Нар Ор Пел Рад Сав Тар Фед Яр".split(),
    "greek": "Αλ Βαρ Γαλ Δελ Ερ Ζαν Καλ Λαμ Μελ Ναρ Ορ Παρ Ροδ Σελ Ταρ Φιλ".split(),
}
MIDDLE = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе ва ве га го да де ла ле ли ло ма ме ми мо на не ра ре ри ро са се та те".split(),
    "greek": "βα βε γα γε δα δε κα κε λα λε μα με να νε ρα ρε σα σε τα τε".split(),
    "han": "安 白 长 春 东 方 光 海 和 华 家 金 景 明 平 青 思 文 小 新 雪 永 玉 志".split(),
}
LAST = {
    ("latin", "f"): ["na", "lia", "ria", "tta", "ssa", "lina", "nora", "vira"],
    ("latin", "m"): ["nus", "lor", "rick", "ton", "mund", "bert", "dor", "vin"],
    ("latin", "s"): ["nson", "ley", "field", "man", "well", "worth", "sby", "ner"],
    ("cyrillic", "f"): ["на", "лия", "рина", "слава", "мила", "вия"],
    ("cyrillic", "m"): ["мир", "слав", "рий", "тон", "лад", "рим"],
    ("cyrillic", "s"): ["нов", "рев", "лин", "ренко", "вич", "нюк"],
    ("greek", "f"): ["νία", "λία", "ρίνη", "νθη", "σία", "ρώ"],
    ("greek", "m"): ["νος", "λης", "ρίας", "νας", "σιος", "ρων"],
    ("greek", "s"): ["νίδης", "ρίδης", "λάκης", "νάκος", "σιάδης", "τάκος"],
    ("han", "f"): "芳 娜 敏 静 丽 娟 霞 燕".split(),
    ("han", "m"): "伟 强 磊 军 勇 杰 涛 刚".split(),
}
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Lady", "Dame", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "m": ["Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "": ["Dr", "Doctor", "Prof", "Professor", "Rev", "Mx", "Доктор"],
}
HONORIFICS = {"f": ["女士", "小姐"], "m": ["先生"], "": ["様", "氏", "さん"]}
#: What introduces a name of two words.
CUES = ["[Ss]poke (?:with|to)", "[Mm]et with", "[Ss]igned by", "[Ww]ritten by", "[Rr]eported by", "[Mm]y name is", "(?:[Nn]ame|[Cc]ontact|[Aa]uthor|[Pp]atient|[Cc]ustomer):", "Dear", "(?:Sincerely|Regards),"]
#: Words of streets that stay.
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Place|Terrace"
GERMAN_STREETS = "straße|strasse|weg|platz|gasse|allee"
FRENCH_STREETS = "rue|avenue|boulevard|place|chemin"

_NAME = r"\p{Lu}\p{Ll}{1,30}(?:-\p{Lu}\p{Ll}{1,30})?"
_TITLE = "(?:" + "|".join(t for g in TITLES.values() for t in g) + ")"
_GIVEN = "(?:" + "|".join(n for g in GIVEN.values() for n in g) + ")"
_CUE = "(?:" + "|".join(CUES) + ")"
_HONORIFIC = "(?:" + "|".join(h for g in HONORIFICS.values() for h in g) + ")"
_BORN = "(?:[Bb]orn(?: on)?|DOB|[Dd]ate of [Bb]irth|[Nn]ée? le|[Gg]eboren(?: am)?|[Nn]acid[oa] el):? "
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Type and pattern, in the order in which they are tried.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}",
    "secret": r"(?<![\p{L}\p{N}])(?=[PpSsTtAa])(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]{0,2}[=:][ \t]{0,2}[\"']?(?=[A-Za-z+/_.-]*+[0-9]|[^ \t\"']{0,128}[0-9])[A-Za-z0-9+/_.-]{8,}+[\"']?",
    "key": r"(?<![\p{L}\p{N}])(?:AKIA|ASIA)[A-Z0-9]{16}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.+-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\p{L}\p{N}-])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "dob": rf"{_BORN}(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:[0-9]{{4}}|[0-9]{{2}})|[0-9]{{4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}})(?![\p{{L}}\p{{N}}])",
    "address": rf"[0-9]{{1,5}}[A-Za-z]? (?:\p{{Lu}}\p{{Ll}}{{1,20}} ){{1,3}}(?:{STREETS})(?![\p{{L}}\p{{N}}])|[0-9]{{1,4}},? (?:{FRENCH_STREETS}) (?:de la |de |du |des )?\p{{Lu}}\p{{Ll}}{{1,20}}|Calle (?:de )?\p{{Lu}}\p{{Ll}}{{1,20}},? [0-9]{{1,4}}(?![\p{{L}}\p{{N}}])|(?=\p{{Lu}}\p{{Ll}}{{4,31}}+ [0-9])\p{{Lu}}\p{{Ll}}{{2,20}}?(?:{GERMAN_STREETS}) [0-9]{{1,4}}(?![\p{{L}}\p{{N}}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\p{L}\p{N}-])|(?<![\p{L}\p{N}.-])\+[0-9]{8,15}(?![\p{L}\p{N}-])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:{_TITLE}\.? {_NAME}(?: {_NAME})?|{_GIVEN} {_NAME})(?![\p{{L}}\p{{N}}])|{_CUE} {_NAME} {_NAME}(?![\p{{L}}\p{{N}}])|\p{{IsHan}}{{1,4}}?{_HONORIFIC}",
}
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(KINDS.values()) + ")"  # all begin at a word's start; said once, it spares most places the rest
#: What a text must hold for PATTERN to find anything; cheap to look for.
HINT = rf"[0-9@]|(?<!\p{{L}})(?=\p{{Lu}})(?:{_TITLE[3:-1]}|{_GIVEN[3:-1]})\b|{_HONORIFIC}|(?<!\p{{L}}){_CUE} \p{{Lu}}"

_DIGITS = "0123456789"
_ALPHABETS = [
    ("[0-9]", _DIGITS), ("[a-f]", "abcdef"), ("[g-z]", "ghijklmnopqrstuvwxyz"), ("[à-öø-ÿ]", "àáâäçèéêëìíîïñòóôöùúûü"),
    ("[а-я]", "абвгдежзиклмнопрстуфхцчшщыэюя"), ("[α-ωά-ώ]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[぀-ゟ]", "あいうえおかきくけこさしすせそ"), ("[゠-ヿ]", "アイウエオカキクケコサシスセソ"), ("[一-鿿]", "安白大方高和黄李林马明平石文新"),
]


def entities(text: Column) -> Column:
    """All entities of text in order; null without any."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(HINT), found)


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def head_of(kind: Column, value: Column) -> Column:
    """What a surrogate keeps as it is at the start: a secret's keyword, a key's prefix, a name's title, a country."""
    return (
        F.when(kind == "secret", F.regexp_extract(value, r"^.*?[=:][ \t]*[\"']?", 0))
        .when(kind == "name", F.regexp_extract(value, rf"^(?:{_TITLE}\.? |{_CUE} )?", 0))
        .when(kind == "dob", F.regexp_extract(value, f"^{_BORN}", 0))
        .when(kind == "phone", F.regexp_extract(value, r"^(?:\+[0-9]{1,3}(?=[^0-9])|\+[0-9])?", 0))
        .when(kind == "key", F.substring(value, 1, 4))
        .when(kind == "iban", F.substring(value, 1, 4))
        .otherwise(F.lit(""))
    )


def tail_of(kind: Column, value: Column) -> Column:
    """What it keeps at the end: the top-level domain, a closing quote, an honorific."""
    return F.when(kind == "name", F.regexp_extract(value, f"{_HONORIFIC}$", 0)).when(kind == "email", F.regexp_extract(value, r"\.[^.]*$", 0)).when(kind == "secret", F.regexp_extract(value, "[\"']?$", 0)).otherwise(F.lit(""))


def core_of(value: Column, head: Column, tail: Column) -> Column:
    return F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail))


def canonical(kind: Column, core: Column) -> Column:
    """The form that all mentions of one entity share."""
    plain = F.regexp_replace(core, r"[^\p{L}\p{N}]", "")
    return F.when(kind.isin("email", "ip"), F.lower(core)).when(kind == "name", F.initcap(F.lower(core))).when(kind.isin("secret", "key", "dob", "address"), core).otherwise(plain)


def drawn(digest: Column, i: Column, n: int | Column) -> Column:
    return F.pmod(F.xxhash64(digest, i), n if isinstance(n, Column) else F.lit(n)).cast("int")


def map_char(c: Column, digest: Column, i: Column) -> Column:
    """A letter or digit of the same kind, drawn from digest; anything else as it is."""
    low = F.lower(c)
    out = c
    for pattern, alphabet in reversed(_ALPHABETS):
        pick = F.substring(F.lit(alphabet), drawn(digest, i, len(alphabet)) + 1, F.lit(1))
        out = F.when(low.rlike(f"^{pattern}$"), F.when(low != c, F.upper(pick)).otherwise(pick)).otherwise(out)
    return out


def chars(value: Column) -> Column:
    return F.split(value, "")


def map_chars(value: Column, digest: Column) -> Column:
    mapped = F.transform(chars(value), lambda c, i: map_char(c, digest, i))
    return F.array_join(mapped, "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10 (0: valid)."""
    total = F.aggregate(
        F.transform(F.reverse(chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda s, x: s + x,
    )
    return total % 10


def card(core: Column, digest: Column) -> Column:
    """First digit kept; the last one set so that Luhn's rule holds exactly where it held."""
    mapped = F.concat(F.substring(core, 1, 1), F.substring(map_chars(core, digest), F.lit(2), F.length(core) - 2))
    fixed = F.pmod(10 - luhn(F.concat(mapped, F.lit("0"))), F.lit(10)).cast("string")
    off = F.pmod(10 - luhn(F.concat(mapped, F.lit("0"))) + 1 + drawn(digest, F.lit(99), 9), F.lit(10)).cast("string")
    return F.concat(mapped, F.when(luhn(core) == 0, fixed).otherwise(off))


def octets(core: Column, digest: Column, draws: Column) -> Column:
    """Octets of as many digits as before; of any after WIDEN draws."""
    part = F.transform(
        F.split(core, r"\."),
        lambda o, i: F.when(draws >= WIDEN, drawn(digest, i, 256)).when(F.length(o) == 1, 1 + drawn(digest, i, 9)).when(F.length(o) == 2, 10 + drawn(digest, i, 90)).otherwise(100 + drawn(digest, i, 155)).cast("string"),
    )
    return F.array_join(part, ".")


def date(core: Column, digest: Column, draws: Column) -> Column:
    """A date in core's format: years of four digits from 1930 to 2009, or any after WIDEN draws; other parts from 1 to 12, which suits days and months."""
    part = F.transform(
        F.split(core, "[./-]"),
        lambda p, i: F.when(F.length(p) == 4, F.when(draws >= WIDEN, 1000 + drawn(digest, i, 9000)).otherwise(1930 + drawn(digest, i, 80)).cast("string"))
        .when(F.length(p) == 2, F.lpad((1 + drawn(digest, i, 12)).cast("string"), 2, "0")).otherwise((1 + drawn(digest, i, 9)).cast("string")),
    )
    return F.array_join(F.transform(part, lambda p, i: F.concat(F.when(i == 0, F.lit("")).otherwise(F.regexp_extract(core, "[./-]", 0)), p)), "")


def made_name(script: Column, end: Column, digest: Column, middles: Column, i: int | Column) -> Column:
    """A name of syllables: a first one, as many middle ones as said (1 at least), a last one that tells gender or surname."""
    last = {"".join(k): v for k, v in LAST.items()}
    between = F.transform(F.sequence(F.lit(1), F.greatest(middles, F.lit(1)).cast("int")), lambda k: one_of(listed(MIDDLE, script), digest, k + 100 * i))
    return F.concat(one_of(listed(FIRST, script), digest, F.lit(10) + i), F.array_join(between, ""), one_of(listed(last, F.concat(script, end)), digest, F.lit(20) + i))


def street(core: Column, digest: Column, draws: Column) -> Column:
    """Numbers and names drawn word by word; words that say what kind of street it is stay."""
    fixed = rf"^(?:{STREETS}|{FRENCH_STREETS}|Calle|de|la|du|des),?$"
    suffix = f"(?:{GERMAN_STREETS})$"

    def word(w: Column, i: Column) -> Column:
        name = made_name(F.lit("latin"), F.lit("s"), digest, draws, 30 + i)
        number = F.concat((1 + drawn(digest, i, 9)).cast("string"), F.substring(map_chars(w, F.concat(digest, i.cast("string"))), F.lit(2), F.length(w)))
        return F.when(w.rlike(fixed), w).when(w.rlike("^[0-9]"), number).when(w.rlike(suffix), F.concat(name, F.regexp_extract(w, suffix, 0))).when(w.endswith(","), F.concat(name, F.lit(","))).otherwise(name)

    return F.array_join(F.transform(F.split(core, " "), word), " ")


def script_of(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").when(value.rlike(r"\p{IsHan}"), "han").otherwise("latin")


def gender_of(head: Column, core: Column, tail: Column) -> Column:
    """By the title or honorific, or else the given name; null: unknown."""
    first = F.element_at(F.split(core, " "), 1)
    title = F.trim(F.regexp_replace(head, r"\.", ""))
    known = lambda g: [n for (_, x), names in GIVEN.items() if x == g for n in names]
    out = F.lit(None).cast("string")
    for g in ("m", "f"):
        out = F.when(first.isin(known(g)), g).otherwise(out)
    for g in ("m", "f"):
        out = F.when(title.isin(TITLES[g]) | tail.isin(HONORIFICS[g]), g).otherwise(out)
    return out


def listed(table: dict[str, list[str]], key: Column) -> Column:
    """The list of this key, as an array."""
    out = F.lit("")
    for k, names in table.items():
        out = F.when(key == k, F.lit(" ".join(names))).otherwise(out)
    return F.split(out, " ")


def one_of(names: Column, digest: Column, i: Column) -> Column:
    return F.element_at(names, drawn(digest, i, F.size(names)) + 1)


def person(core: Column, gender: Column, digest: Column, draws: Column) -> Column:
    """Names of the same script and gender: from the lists first, then of syllables, of one more with each draw."""
    script = script_of(core)
    own = F.coalesce(gender, F.when(drawn(digest, F.lit(5), 2) == 0, "f").otherwise("m"))

    def name(names: dict, end: Column, i: int) -> Column:
        keyed = {"".join(k): v for k, v in names.items()}
        return F.when(draws == 0, one_of(listed(keyed, F.concat(script, end)), digest, F.lit(i))).otherwise(made_name(script, end, digest, draws, i))

    family = name({(k, "s"): v for k, v in FAMILY.items()}, F.lit("s"), 2)
    middles = F.when(draws > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(draws, F.lit(1))), lambda k: one_of(listed(MIDDLE, script), digest, k)), "")).otherwise("")
    han = F.concat(one_of(listed(FAMILY, script), digest, F.lit(2)), middles, one_of(listed({"".join(k): v for k, v in LAST.items()}, F.concat(script, own)), digest, F.lit(20)))
    return F.when(script == "han", han).when(core.contains(" "), F.concat_ws(" ", name(GIVEN, own, 1), family)).otherwise(family)


def iban_remainder(value: Column) -> Column:
    """value modulo 97, letters read as 10 to 35."""
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(chars(value), code), F.lit(0), lambda s, v: (F.when(v > 9, s * 100 + v).otherwise(s * 10 + v) % 97).cast("int"))


def candidate(key: str) -> Column:
    """The surrogate of (kind, gender, canon) at this number of draws, in canonical form."""
    kind, canon, draws = F.col("kind"), F.col("canon"), F.col("draws")
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, draws.cast("string")), 256)
    found = (
        F.when(kind == "card", card(canon, digest))
        .when(kind == "ip", octets(canon, digest, draws))
        .when(kind == "dob", date(canon, digest, draws))
        .when(kind == "address", street(canon, digest, draws))
        .when(kind == "name", person(canon, F.col("gender"), digest, draws))
        .otherwise(map_chars(canon, digest))
    )
    more = F.array_join(F.transform(F.sequence(F.lit(LENGTHEN), F.greatest(draws, F.lit(LENGTHEN))), lambda i: drawn(digest, 500 + i, 10).cast("string")), "")
    return F.when((draws >= LENGTHEN) & ~kind.isin("name", "address"), F.concat(found, more)).otherwise(found)


def draw_surrogates(found: DataFrame, key: str) -> DataFrame:
    """kind, gender, canon, surrogate for distinct (kind, gender, canon); surrogates differ from each other and from all canons of the kind.

    Of those that draw the same, the least takes it. All joins are on keys that are unique on both sides, or nearly.
    """
    originals = found.select("kind", F.col("canon").alias("surrogate")).distinct()
    pending, settled, i = found, None, 0
    while True:
        tried = pending.withColumn("draws", F.lit(i)).withColumn("surrogate", candidate(key))
        first = tried.groupBy("kind", "surrogate").agg(F.min(F.struct("canon", "gender")).alias("of")).select("kind", "of.gender", "of.canon", "surrogate")
        taken = originals if settled is None else originals.union(settled.select("kind", "surrogate"))
        good = durable(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "gender", "canon", "surrogate"))
        settled = good if settled is None else settled.unionByName(good)
        done = good.select(F.col("kind").alias("kind_"), F.col("gender").alias("gender_"), F.col("canon").alias("canon_"))
        last, pending = pending, durable(pending.join(done, (F.col("canon") == F.col("canon_")) & (F.col("kind") == F.col("kind_")) & F.col("gender").eqNullSafe(F.col("gender_")), "left_anti"))
        if i:
            forget(last)
        if not pending.limit(1).count():
            forget(pending)
            return settled
        i += 1


def lay(core: Column, surrogate: Column) -> Column:
    """The surrogate's letters and digits in core's format and case, where their numbers agree; else the surrogate."""
    plain = F.regexp_replace(surrogate, r"[^\p{L}\p{N}]", "")
    n = F.length(F.regexp_replace(core, r"[^\p{L}\p{N}]", ""))
    laid = F.transform(
        chars(core),
        lambda c, i: F.when(
            c.rlike(r"^[\p{L}\p{N}]$"),
            F.when(F.lower(c) != c, F.upper(F.substring(plain, F.length(F.regexp_replace(F.substring(core, F.lit(1), i + 1), r"[^\p{L}\p{N}]", "")), F.lit(1))))
            .otherwise(F.substring(plain, F.length(F.regexp_replace(F.substring(core, F.lit(1), i + 1), r"[^\p{L}\p{N}]", "")), F.lit(1))),
        ).otherwise(c),
    )
    return F.when(F.length(plain) == n, F.array_join(laid, "")).otherwise(surrogate)


def finished(kind: Column, head: Column, core: Column, tail: Column, surrogate: Column) -> Column:
    # Secrets and keys are drawn in their own format; lay takes time with the square of the length.
    body = F.when(kind.isin("name", "ip", "secret", "key", "dob", "address"), surrogate).otherwise(lay(core, surrogate))
    country = F.substring(head, 1, 2)
    checks = F.lpad((98 - iban_remainder(F.concat(surrogate, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(kind == "iban", F.concat(country, checks, body)).otherwise(F.concat(head, body, tail))


def replace(documents: DataFrame, *, key: str = KEY) -> DataFrame:
    """documents with surrogates in text, and the columns n_entities int and kinds (of the entities, in order).

    Where documents has columns of those names, the new ones get underscores before theirs.
    """
    names = {c: free_name(documents, c) for c in ("n_entities", "kinds", "e0", "k0", "k1", "ek", "es", "et")}
    text = F.col("text").cast("string")
    marked = documents.withColumn(names["e0"], entities(text))
    some = F.size(F.coalesce(F.col(names["e0"]), F.array().cast("array<string>"))) > 0
    with_some = marked.where(some).withColumns({names["k0"]: F.xxhash64(text), names["k1"]: F.hash(text)})
    value, kind, head, tail, core = (F.col(c) for c in ("value", "kind", "head", "tail", "core"))
    mention = with_some.select(F.col(names["k0"]).alias("k0"), F.col(names["k1"]).alias("k1"), F.posexplode(names["e0"]).alias("i", "value")).distinct()
    mention = mention.withColumn("kind", F.coalesce(kind_of(value), F.lit("key"))).withColumn("head", head_of(kind, value)).withColumn("tail", tail_of(kind, value))
    mention = mention.withColumn("core", core_of(value, head, tail)).withColumn("canon", canonical(kind, core)).withColumn("gender", F.when(kind == "name", gender_of(head, core, tail)))
    mention = durable(mention)
    surrogates = draw_surrogates(mention.select("kind", "gender", "canon").distinct(), key)
    right = surrogates.select(F.col("kind").alias("kind_"), F.col("gender").alias("gender_"), F.col("canon").alias("canon_"), "surrogate")
    same = (F.col("canon") == F.col("canon_")) & (F.col("kind") == F.col("kind_")) & F.col("gender").eqNullSafe(F.col("gender_"))
    put = mention.join(right, same).select("k0", "k1", "i", "kind", finished(kind, head, core, tail, F.col("surrogate")).alias("new"))
    by_text = durable(put.groupBy("k0", "k1").agg(F.sort_array(F.collect_list(F.struct("i", "kind", "new"))).alias("m")))
    forget(mention)
    by_text = by_text.select(F.col("k0").alias("_k0"), F.col("k1").alias("_k1"), F.transform("m", lambda m: m["kind"]).alias(names["ek"]), F.transform("m", lambda m: m["new"]).alias(names["es"]))
    pair = (F.col(names["k0"]) == F.col("_k0")) & (F.col(names["k1"]) == F.col("_k1"))
    gaps = F.split(text, PATTERN, -1)
    rebuilt = F.array_join(F.zip_with(gaps, F.col(names["es"]), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    changed = with_some.join(by_text, pair).withColumns({"text": rebuilt, names["n_entities"]: F.size(names["es"]), names["kinds"]: F.col(names["ek"])})
    same_text = marked.where(~some).withColumns({names["n_entities"]: F.lit(0), names["kinds"]: F.array().cast("array<string>")})
    columns = [*documents.columns, names["n_entities"], names["kinds"]]
    return changed.select(columns).unionByName(same_text.select(columns))


def replace_in_place(documents: DataFrame, **options) -> DataFrame:
    """documents with surrogates in text; no further columns."""
    return replace(documents, **options).select(documents.columns)
