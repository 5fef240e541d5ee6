"""PII: surrogate generation in DataFrame functions alone.

One pattern finds e-mail addresses, phones, IPv4 addresses, payment cards, IBANs, social security numbers and persons: the
names after a title, or after a common given name. A person's match is taken apart: given names by gender (the title's,
or else the name's) and surnames are entities of their own, so that "Mrs. Anna Smith", "Anna Smith" and "Ms SMITH" stay
one person (coreference). A text is matched once; its matches are kept for the other steps.

Each distinct entity gets a surrogate from an HMAC: of the same type, length and format, a card or IBAN with valid check
digits, an address of a private range, a phone number of a fictional exchange, a name of the same gender and script.
Capitals, hyphens and apostrophes of names, separators of numbers and title dots stay as they are written; initials are
shifted in their alphabet, which keeps them distinct.

Collision checks: all distinct entities of the corpus are held against each other and against the surrogates,
and of those that share a surrogate, or whose surrogate is someone's real value, all but the first try the next
hash, until none is left (distinctness). These are counts over entities, with partial sums; a document's
entities are the largest group. The first SAME_LENGTH tries keep the length; from then on each try has more
characters than the one before (a subdomain, syllables, digits at the end; for IPv4 the reserved range 240/4 and
then the documentation range of IPv6), so that the rounds end however few surrogates of one length there are or are
left free by real values. Only texts that may have entities are moved, once, to meet their surrogates.

Bounds of detection: a name without a title is found only after a given name of the list; words beyond Latin, Cyrillic,
Greek, Han, Hangul, Arabic and Hebrew get Latin surrogates; "Roe" alone is an ordinary word.

Defined results: null and empty texts have no entities and stay as they are; rows are told apart by id and text
(a null id is an id), so ties and repeated rows get equal results; extra columns are kept by
``with_surrogates``, where a column with the name of the count is replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.llm.common import checkpoint, possible_members

# Titles by gender (n: none), common given names by gender, surrogates' given names by gender and script, and
# syllables of surnames by script.
TITLES = {"f": "Mrs Ms Miss Madam Frau Madame Señora Госпожа Κυρία".split(), "m": "Mr Sir Herr Monsieur Señor Господин Κύριος".split(), "n": "Dr Prof Professor Доктор".split()}
GIVEN = {
    "f": """Alice Amy Anna Anne Barbara Brigitte Camille Carmen Carol Caroline Catherine Charlotte Christine Claire Diana Elena Elizabeth Emily Emma Eva
        Helen Ines Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucia Margaret Maria Marie Martha Mary Michelle Monika Nancy
        Nicole Olivia Patricia Petra Rebecca Rosa Sabine Sandra Sara Sarah Sofia Sophie Susan Teresa Ursula
        Анна Вера Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Ελένη Μαρία Κατερίνα Σοφία""".split(),
    "m": """Alan Alexander Andreas Andrew Anthony Antonio Brian Carlos Charles Christian Christopher Daniel David Edward Eric Frank Georg George Hans
        Henry Jack Jacques James Jason Jean Jeffrey John Jonathan Jorge Joseph José Juan Klaus Kevin Luis Luc Manuel Mark Martin Matthew Michael Miguel
        Nicolas Oliver Pablo Patrick Paul Pedro Peter Philippe Pierre Richard Robert Ronald Ryan Stefan Stephen Steven Thomas Timothy Walter William Wolfgang
        Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Пётр Сергей Γιάννης Γιώργος Δημήτρης Νίκος""".split(),
}
FIRST_NAMES = {
    "latin f": ("anna", "clara", "elena", "julia", "laura", "maria", "nina", "sofia"),
    "latin m": ("adam", "carl", "david", "jonas", "leon", "martin", "paul", "simon"),
    "latin n": ("alex", "andrea", "kim", "luca", "noel", "robin", "sascha", "toni"),
    "cyrillic f": ("анна", "вера", "елена", "ирина", "мария", "нина", "ольга", "софья"),
    "cyrillic m": ("антон", "борис", "иван", "лев", "марк", "олег", "павел", "роман"),
    "greek f": ("άννα", "ελένη", "ζωή", "ιωάννα", "μαρία", "νίκη", "σοφία", "χρύσα"),
    "greek m": ("άγγελος", "γιάννης", "λευτέρης", "μάρκος", "νίκος", "πέτρος", "στέλιος", "φώτης"),
}
#: Ends of made-up given names that tell the gender.
ENDINGS = {"latin f": "a", "latin m": "o", "cyrillic f": "а", "cyrillic m": "ий", "greek f": "α", "greek m": "ος"}
SYLLABLES = {
    "latin": "ba den fel gar hol kim lan mor nel pas ric sol tan ver wil zan".split(),
    "cyrillic": "ба вер гор дин зан кол лан мор нел пас рин сол тан фил хар чен".split(),
    "greek": "βα γιαν δου ζαν θεο κολ λαν μαρ νικ παπ ρου σολ ταν φιλ χατ ψαλ".split(),
    "han": "王 李 张 刘 陈 杨 黄 赵 吴 周 徐 孙 马 朱 胡 林".split(),
    "hangul": "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황".split(),
    "arabic": "با حس خال دي را زي سا شا صا طا عل فا قا كر لي نو".split(),
    "hebrew": "אב בר גל דן הד זיו חן טל ים כר לב מור נוי עוז פז רון".split(),
}
SCRIPTS = {"cyrillic": "Cyrillic", "greek": "Greek", "han": "Han", "hangul": "Hangul", "arabic": "Arabic", "hebrew": "Hebrew"}

#: Tries that keep an entity's length; each one after that has a larger space than the one before.
SAME_LENGTH = 4


def _any_of(words) -> str:
    """A pattern for one of some words, by their first letters."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        heads.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{h}(?:{'|'.join(t)})" for h, t in heads.items()) + ")"


_TITLE = _any_of(t for g in TITLES.values() for t in g)
_GIVEN = _any_of(n for g in GIVEN.values() for n in g)
_NAME = r"(?:[\p{Lu}\p{Lo}][\p{L}\p{M}'’-]+|[\p{Lu}]\.)"
_LAST = r"[\p{Lu}\p{Lo}][\p{L}\p{M}'’-]+"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: kind -> pattern; where several match at a place, the first counts.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+(?!1[ .(-])[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9A-Za-z.-])[2-9][0-9]{2}([.-])[2-9][0-9]{2}\1[0-9]{4}(?![0-9A-Za-z-])"
    r"|(?<![0-9A-Za-z.-])00[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])",
    "person": rf"(?<![\p{{L}}])(?:{_TITLE}\.? (?:{_NAME} ){{0,2}}{_LAST}|{_GIVEN}(?: [\p{{Lu}}]\.)*(?: {_LAST}){{1,2}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def keyed(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hex."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _characters(s: Column) -> Column:
    return F.split(s, "")


def _pick(values, h: Column, at: int | Column) -> Column:
    """One of a few values by two hex digits of a hash."""
    return F.element_at(F.array(*map(F.lit, values)), (F.conv(F.substring(h, at, F.lit(2) if isinstance(at, Column) else 2), 16, 10).cast("int") % len(values) + 1))


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum of a digit string; the last digit is doubled if doubled is 1."""
    worth = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.reverse(_characters(digits)), lambda c, i: F.when((i + doubled) % 2 == 1, worth(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _mod_97(s: Column) -> Column:
    """An IBAN's remainder, its first four characters put last."""
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))

    def step(r: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        return F.when(letter, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(_characters(moved), F.lit(0), step)


def kind_of(match: Column) -> Column:
    """The kind of a match of ANY; null where check digits are wrong."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    out = F.when(F.lit(False), F.lit(""))
    for kind, pattern in PATTERNS.items():
        holds = match.rlike(f"^(?:{pattern})$")
        if kind == "card":
            holds = holds & (_luhn_sum(digits, 0) % 10 == 0)
        if kind == "iban":
            holds = holds & (_mod_97(match) == 1)
        out = out.when(holds, F.lit(kind))
    return out


def canonical(kind: Column, match: Column) -> Column:
    """What tells entities apart: the digits of numbers, an address in lower case.

    A phone's digits begin with its country: 00 is as good as +, and ten digits with an area code in signs have country 1.
    """
    numbers = F.regexp_replace(match, "[^0-9]", "")
    phone = F.when(match.startswith("00"), F.substring(numbers, 3, 40)).when((F.length(numbers) == 10) & ~match.startswith("+"), F.concat(F.lit("1"), numbers)).otherwise(numbers)
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), numbers).when(kind == "email", F.lower(match)).otherwise(match)


def _script(word: Column) -> Column:
    out = F.lit("latin")
    for name, script in SCRIPTS.items():
        out = F.when(word.rlike(rf"\p{{Is{script}}}"), F.lit(name)).otherwise(out)
    return out


def name_parts(match: Column) -> Column:
    """array<struct<kind, value, form>> of a person's words; kind is null for the title and for initials."""
    words = F.split(match, " ")
    first = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    titles = [t for g in TITLES.values() for t in g]
    own = lambda word: F.when(word.isin(*GIVEN["f"]), "f").when(word.isin(*GIVEN["m"]), "m").otherwise("n")
    by_title = F.when(first.isin(*TITLES["f"]), "f").when(first.isin(*TITLES["m"]), "m")

    def part(word: Column, i: Column) -> Column:
        title, initial, last = (i == 0) & first.isin(*titles), word.rlike(r"^\p{Lu}\.$"), i == F.size(words) - 1
        plain = F.when(last, F.concat(F.lit("surname "), _script(word), F.when((_script(word) == "cyrillic") & (by_title == "f"), F.lit(" f")).otherwise(F.lit("")))).otherwise(F.concat_ws(" ", F.lit("given"), _script(word), F.coalesce(by_title, own(word))))
        return F.struct(F.when(~title & ~initial, plain).alias("kind"), F.lower(word).alias("value"), F.when(title | ~initial, word).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "KLMNOPQRSTUVWXYZABCDEFGHIJЛМНОПРСТУФХЦЧШЭЮЯАБВГДЕЖЗИК")).alias("form"))

    return F.transform(words, part)


def _made(script: str, h: Column, at: int, syllables: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.lit(20), syllables) - 1), lambda i: _pick(SYLLABLES[script], h, 2 * i + at)), "")


def name_surrogate(kind: Column, value: Column, h: Column, attempt: Column) -> Column:
    """A given name or surname in lower case, in the script and of the gender of its kind; hyphens and O' stay."""
    more = F.greatest(F.lit(0), attempt - (SAME_LENGTH - 1))
    given = F.when(F.lit(False), F.lit(""))
    last = F.when(F.lit(False), F.lit(""))
    for script in reversed(SYLLABLES):
        asked = kind.rlike(rf"\b{script}\b") if script != "latin" else F.lit(True)
        listed = F.when(F.lit(False), F.lit(""))
        for gender in "fmn":
            names = FIRST_NAMES.get(f"{script} {gender}", ())
            invented = F.concat(_made(script, h, 3, attempt + 1), F.lit(ENDINGS.get(f"{script} {gender}", "")))
            listed = listed.when(kind.endswith(" " + gender), F.when(attempt < 2, _pick(names, h, 1)).otherwise(invented) if names else invented)
        given = given.when(asked, listed)
        made = _made(script, h, 3, (2 if script in ("han", "hangul") else 3) + more)
        last = last.when(asked, F.concat(made, F.lit("а")) if script == "cyrillic" else made)
    last = F.when(kind.rlike("cyrillic$"), F.regexp_replace(last, "а$", "")).otherwise(last)
    word = F.when(kind.startswith("given "), given).otherwise(last)
    word = F.when(value.contains("-"), F.concat_ws("-", word, F.when(kind.rlike("cyrillic"), _made("cyrillic", h, 41, F.lit(2))).otherwise(_made("latin", h, 41, F.lit(2))))).otherwise(word)
    return F.when(value.rlike("^\\p{L}['’]"), F.concat(F.substring(value, 1, 2), word)).otherwise(word)


def surrogate(kind: Column, value: Column, attempt: Column, h: Column) -> Column:
    """The surrogate of an entity in canonical form; h is its keyed hash for the attempt."""
    digits = F.translate(F.concat(h, F.reverse(h)), "abcdef", "135790")
    n, more = F.length(value), F.greatest(F.lit(0), attempt - (SAME_LENGTH - 1))
    take = lambda at, k: F.substring(digits, at, k)
    octet = lambda at: (F.conv(F.substring(h, at, 2), 16, 10).cast("int")).cast("string")

    body = F.concat(F.substring(value, 1, 1), F.substring(digits, F.lit(2), n - 2 + more))
    card = F.concat(body, ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string"))
    account = F.array_join(F.transform(_characters(F.substring(value, 5, 40)), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, i + 1, F.lit(1))).otherwise(F.substring(F.translate(F.upper(h), "0123456789", "GHIJKLMNOP"), i + 1, F.lit(1)))), "")
    account = F.concat(account, F.substring(digits, F.lit(65), more))
    check = 98 - _mod_97(F.concat(F.substring(value, 1, 2), F.lit("00"), account))
    iban = F.concat(F.substring(value, 1, 2), F.lpad(check.cast("string"), 2, "0"), account)
    # fictional numbers: exchange 555 of the North American plan; elsewhere the country's first digits stay
    fictional = F.concat(F.lit("1"), _pick("23456789", h, 1), take(3, 2), F.lit("555"), F.substring(digits, F.lit(7), 4 + more))
    phone = F.when((n == 11) & value.startswith("1"), fictional).otherwise(F.concat(F.substring(value, 1, 3), F.substring(digits, F.lit(1), n - 3 + more)))
    letters = F.translate(F.concat(h, F.reverse(h)), "0123456789", "ghijklmnop")
    local = F.substring_index(value, "@", 1)
    written = F.transform(_characters(local), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, i % 64 + 1, F.lit(1))).when(c.rlike(r"\p{L}"), F.substring(letters, i % 64 + 1, F.lit(1))).otherwise(c))
    below = F.when(more > 0, F.concat(F.substring(F.reverse(letters), F.lit(1), 2 * more), F.lit("."))).otherwise(F.lit(""))
    email = F.concat(F.array_join(written, ""), F.lit("@"), below, F.lit("mail"), F.substring(F.translate(F.col("domain"), "abcdef", "135790"), 1, 6), F.lit(".example.org"))
    reserved = F.concat_ws(".", (240 + F.conv(F.substring(h, 7, 1), 16, 10).cast("int")).cast("string"), octet(1), octet(3), octet(5))
    wide = F.concat_ws(":", F.lit("2001:db8"), *[F.substring(h, i, 4) for i in range(1, 25, 4)])
    ip = F.when(more == 0, F.concat_ws(".", F.lit("10"), octet(1), octet(3), octet(5))).when(more <= SAME_LENGTH, reserved).otherwise(wide)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .when(kind == "phone", phone)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(digits, F.lit(1), 8 + more)))
        .otherwise(name_surrogate(kind, value, h, attempt))
    )


def written_as(form: Column, kind: Column, new: Column) -> Column:
    """A surrogate in the format of what it replaces: separators stay, digits are filled in, those of a longer surrogate at the end; capitals of names stay."""
    places = F.transform(_characters(form), lambda c: F.when(c.rlike("[0-9]"), 1).otherwise(0))
    numbers = F.regexp_replace(form, "[^0-9]", "")
    new = F.when((kind == "phone") & form.startswith("00"), F.concat(F.lit("00"), new)).when((kind == "phone") & (F.length(numbers) == 10) & ~form.startswith("+"), F.substring(new, 2, 80)).otherwise(new)
    filled = F.transform(_characters(form), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(new, F.aggregate(F.slice(places, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x), F.lit(1))).otherwise(c))
    beyond = F.substring(new, F.length(numbers) + 1, F.length(new))
    capital = F.regexp_replace(F.initcap(F.regexp_replace(new, "([-'’])", "$1 ")), "([-'’]) ", "$1")
    cased = F.when(form == F.upper(form), F.upper(new)).otherwise(capital)
    return F.when(kind.isin("phone", "card", "ssn"), F.concat(F.array_join(filled, ""), beyond)).when(kind.rlike("^(given|surname) "), cased).otherwise(new)


def _matches(text: Column) -> Column:
    """array of the text's matches in order, each an array<struct<kind, value, form>> of its parts; a part without kind stays."""

    def parts(x: Column) -> Column:
        one = F.array(F.struct(x["kind"].alias("kind"), canonical(x["kind"], x["match"]).alias("value"), x["match"].alias("form")))
        return F.when(x["kind"] == "person", name_parts(x["match"])).otherwise(one)

    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("match")))
    return F.transform(found, parts)


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value) of distinct entities -> the same with new, no two alike within a kind and none a real value."""
    pending, done = checkpoint(entities.withColumn("attempt", F.lit(0))), None
    real = pending.select("kind", F.col("value").alias("new"))
    for _ in count():
        hashed = pending.withColumn("h", keyed(key, F.concat_ws("|", "kind", "value", F.col("attempt").cast("string"))))
        hashed = hashed.withColumn("domain", F.when(F.col("kind") == "email", keyed(key, F.substring_index("value", "@", -1))))
        tried = hashed.withColumn("new", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), F.col("h"))).drop("h", "domain")
        taken = real if done is None else real.unionByName(done.select("kind", "new"))
        turn = F.row_number().over(Window.partitionBy("kind", "new").orderBy("value"))
        tried = checkpoint(tried.withColumn("turn", turn).join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "new"], "left"))
        free = (F.col("turn") == 1) & F.col("taken").isNull()
        good = tried.filter(free).select("kind", "value", "new")
        done = good if done is None else done.unionByName(good)
        pending = tried.filter(~free).select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return done


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", count_col: str | None = None) -> DataFrame:
    """The documents with every entity replaced; length_col is brought up to date, count_col (entities) added if named."""
    text = F.col("doc")[text_col]
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc")).select("doc", F.col("doc")[id_col].cast("string").alias("id"), F.xxhash64(text, F.length(text)).alias("hash"))
    real = lambda m: F.exists(m, lambda part: part["kind"].isNotNull())
    found = rows.select("id", "hash", _matches(text).alias("m"))
    found = checkpoint(found.filter(F.exists("m", real)))
    each = found.select("id", "hash", F.explode(F.array_distinct(F.transform(F.filter(F.flatten("m"), lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["value"].alias("value"))))).alias("e")).select("id", "hash", "e.kind", "e.value")
    new = distinct_surrogates(each.select("kind", "value").distinct(), key)
    entry = F.struct(F.concat_ws(" ", "kind", "value").alias("name"), F.col("new"))
    own = each.distinct().join(new, ["kind", "value"]).groupBy("id", "hash").agg(F.map_from_entries(F.collect_list(entry)).alias("own"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))

    def replaced(part: Column) -> Column:
        to = F.element_at(F.col("own"), F.concat_ws(" ", part["kind"], part["value"]))
        return F.when(part["kind"].isNull() | to.isNull(), part["form"]).otherwise(written_as(part["form"], part["kind"], to))

    put = F.transform("m", lambda m: F.array_join(F.transform(m, replaced), " "))
    meant = found.dropDuplicates(["id", "hash"]).join(own.withColumnsRenamed({"id": "__id", "hash": "__hash"}), same)
    meant = meant.select("__id", "__hash", put.alias("put"), F.size(F.filter("m", real)).alias("n_found"))

    marked = possible_members(rows, F.col("hash"), F.col("hash"), found)
    joined = marked.filter("__possible").join(meant, same, "left").select("doc", "put", "n_found")
    rest = marked.filter(~F.col("__possible")).select("doc", F.lit(None).cast("array<string>").alias("put"), F.lit(None).cast("int").alias("n_found"))
    parts = F.zip_with(F.split(text, ANY, -1), F.col("put"), lambda gap, to: F.concat(gap, F.coalesce(to, F.lit(""))))
    clean = F.when(F.col("put").isNull(), text).otherwise(F.array_join(parts, ""))
    changed = {text_col: F.col("clean")}
    if length_col in docs.columns:
        changed[length_col] = F.length("clean").cast(docs.schema[length_col].dataType)
    kept = [changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns if c != count_col]
    counted = [F.coalesce("n_found", F.lit(0)).alias(count_col)] if count_col else []
    return joined.unionByName(rest).withColumn("clean", clean).select(*kept, *counted)


def op10_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """doc_id, the number of entities, and the whole text with surrogates."""
    return with_surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet"), key="murmur", count_col="n_entities").select("doc_id", "n_entities", "text")
