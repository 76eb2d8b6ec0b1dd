"""Surrogates for personal data. Built-in Spark functions only.

Detected: e-mail addresses, long hexadecimal secrets, IPv4 addresses, social security numbers, phone numbers, IBANs, card
numbers and names of persons (a known given name with a surname, or a title with a name).

Every entity has a normal form (digits only, lower case, without title), so spellings of one entity are one. The
surrogate of a normal form is drawn from SHA-256 over key, kind, form and attempt: the same everywhere (coreference), not to
be inverted without the key. It keeps the kind's look: digits for digits and letters for letters in the same places,
the issuer digit and a valid check digit of cards that had one, the country code of phones and IBANs, valid octets, the
top-level domain of addresses, the case of letters, gender and script of names.

Distinctness: surrogates of the corpus are checked against each other and against all real entities. Of several with one
surrogate, and of those that equal a real entity, all but the smallest form draw again with the next attempt, until no
collision is left. The entity table has one row per distinct entity and is never collected.

Nulls and texts without entities stay as they are. Repeated rows are replaced alike. Extra columns are kept. Empty tables
give empty results. Long texts are matched whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.session import settle

KEY = "a key for tests; pass your own"
MOST_ATTEMPTS = 40

# Names by gender and script, titles by gender.
GIVEN = {
    ("f", "latin"): "Anna Maria Laura Julia Sarah Emma Sophie Claire Lucia Elena Marta Nina Helen Alice Carla Ines Paula Irene Diana Eva",
    ("m", "latin"): "John Peter Paul Thomas Michael David Robert James Martin Lukas Hugo Louis Pierre Carlos Diego Pablo Marco Felix Oscar Daniel",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Юлия Вера Нина Галина",
    ("m", "cyrillic"): "Иван Пётр Павел Сергей Андрей Дмитрий Алексей Николай Михаил Юрий Олег Антон",
}
SURNAMES = {
    "latin": "Adler Baker Costa Duran Evans Fuchs Garnier Hoffman Ibarra Jansen Keller Lambert Moreau Novak Ortega Parker Quinn Romero "
    "Schmidt Torres Ulrich Vidal Wagner Young Zimmer",
    "cyrillic": "Бондаренко Волкович Гончар Дорошенко Ермак Жук Зайченко Коваль Лысенко Мельник Новик Остапенко Петренко Романюк Сидоренко Ткач",
}
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"]}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ALL_GIVEN = " ".join(GIVEN.values()).split()
_ALL_TITLES = [t for titles in TITLES.values() for t in titles]
_INITIALS = "A-ZА-Я"  # ranges, as a long list of letters is slow to test
_CAPITAL = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Fa-f]{0,31}[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "name": rf"(?=[{_INITIALS}])(?<!\p{{L}})(?:(?:{'|'.join(_ALL_TITLES)})\.? {_CAPITAL}(?: {_CAPITAL})?|(?:{'|'.join(_ALL_GIVEN)}) {_CAPITAL})(?!\p{{L}})",
}
# An entity begins with one of these characters, and within a word of ASCII letters only with a digit, + or (. Told first,
# this keeps the matcher from trying every pattern at every character.
ANY = rf"(?=[0-9a-z+({_INITIALS}])(?:(?<![A-Za-z])|(?=[0-9+(]))(?:{'|'.join(PATTERNS.values())})"
# Every entity but a name holds a digit or an @, and a name has a capital after its first word: most texts are told clean by this.
MARKS = "[0-9@]"
TWO_CAPITALS = rf"[{_INITIALS}]\p{{L}}*+\.? \p{{Lu}}"


def _text(value: str) -> str:
    """SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: str) -> str:
    return "array(" + ", ".join(_text(v) for v in values.split()) + ")"


def _kind(e: str) -> str:
    """The first pattern that the whole entity matches."""
    return "CASE " + " ".join(f"WHEN {e} RLIKE {_text(f'^(?:{p})$')} THEN '{k}'" for k, p in PATTERNS.items()) + " END"


_TITLE = _text(rf"^(?:{'|'.join(_ALL_TITLES)})\.? ")


def _normal(e: str) -> str:
    return (
        f"CASE WHEN kind IN ('ssn', 'card', 'phone') THEN regexp_replace({e}, '[^0-9]', '') "
        f"WHEN kind = 'iban' THEN replace({e}, ' ', '') WHEN kind = 'name' THEN lower(regexp_replace({e}, {_TITLE}, '')) "
        f"WHEN kind = 'secret' THEN lower({e}) WHEN kind = 'email' THEN lower({e}) ELSE {e} END"
    )


def _byte(i: str) -> str:
    """The i-th byte (from 0, cyclic) of the drawn hash `h` of 64 hexadecimal digits."""
    return f"CAST(conv(substring(h, 2 * pmod({i}, 32) + 1, 2), 16, 10) AS INT)"


def _like(value: str, keep_first: str, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """`value` with every digit and letter behind the first `keep_first` characters drawn anew, of the same sort."""
    small, large = _text(letters), _text(letters.upper())
    n = len(letters)
    mixed = f"({_byte('i')} + 7 * (i DIV 32))"
    return (
        f"array_join(transform(sequence(0, length({value}) - 1), i -> CASE WHEN i < {keep_first} THEN substring({value}, i + 1, 1) "
        f"WHEN substring({value}, i + 1, 1) RLIKE '[0-9]' THEN CAST({mixed} % 10 AS STRING) "
        f"WHEN substring({value}, i + 1, 1) RLIKE '[a-z]' THEN substring({small}, {mixed} % {n} + 1, 1) "
        f"WHEN substring({value}, i + 1, 1) RLIKE '[A-Z]' THEN substring({large}, {mixed} % {n} + 1, 1) "
        f"ELSE substring({value}, i + 1, 1) END), '')"
    )


def _luhn(digits: str, last_is_check: bool) -> str:
    """Luhn sum of a digit string; without its check digit, every place counts one further left."""
    shift = 0 if last_is_check else 1
    d = f"CAST(substring({digits}, length({digits}) - i, 1) AS INT)"
    doubled = f"IF(2 * {d} > 9, 2 * {d} - 9, 2 * {d})"
    return f"aggregate(transform(sequence(0, length({digits}) - 1), i -> IF((i + {shift}) % 2 = 1, {doubled}, {d})), 0, (a, x) -> a + x)"


def _draw() -> str:
    """Surrogate of `norm` (columns kind, norm, gender, script, h, attempt), in normal form."""
    card = _like("norm", "1")
    body = f"substring({card}, 1, length(norm) - 1)"
    card = f"IF({_luhn('norm', True)} % 10 = 0, concat({body}, CAST((10 - {_luhn(body, False)} % 10) % 10 AS STRING)), {card})"
    at = "length(norm) - length(substring_index(norm, '.', -1))"
    email = f"concat({_like(f'substring(norm, 1, {at})', '0')}, substring_index(norm, '.', -1))"
    secret = (
        f"array_join(transform(sequence(0, length(norm) - 1), i -> substring('0123456789abcdef', ({_byte('i')} + 5 * (i DIV 32)) % 16 + 1, 1)), '')"
    )
    ip = "concat_ws('.', " + ", ".join(f"CAST({_byte(str(i))} % 254 + 1 AS STRING)" for i in range(4)) + ")"
    given = "CASE " + " ".join(
        f"WHEN gender = '{g}' AND script = '{s}' THEN element_at({_list(v)}, {_byte('0')} % {len(v.split())} + 1)" for (g, s), v in GIVEN.items()
    ) + " END"
    surname = lambda k: "IF(script = 'cyrillic', " + ", ".join(
        f"element_at({_list(SURNAMES[s])}, {_byte(str(k))} % {len(SURNAMES[s].split())} + 1)" for s in ("cyrillic", "latin")
    ) + ")"
    # A name of one word is a surname; later attempts add further surnames, so drawing can't run out.
    family = f"concat_ws('-', slice(array({', '.join(surname(k) for k in range(1, 9))}), 1, least(8, 1 + attempt DIV 2)))"
    name = f"lower(IF(instr(norm, ' ') > 0, concat({given}, ' ', {family}), {family}))"
    phone = _like("norm", "kept")
    return (
        f"CASE kind WHEN 'email' THEN {email} WHEN 'secret' THEN {secret} WHEN 'ip' THEN {ip} WHEN 'card' THEN {card} "
        f"WHEN 'iban' THEN {_like('norm', '2')} WHEN 'name' THEN {name} WHEN 'phone' THEN {phone} ELSE {_like('norm', '0')} END"
    )


def _render() -> str:
    """`surrogate` (normal form) in the format of `entity`."""
    digits = (
        "array_join(transform(sequence(1, length(entity)), i -> IF(substring(entity, i, 1) RLIKE '[0-9A-Za-z]', "
        "substring(surrogate, length(regexp_replace(substring(entity, 1, i), '[^0-9A-Za-z]', '')), 1), substring(entity, i, 1))), '')"
    )
    case = (
        "array_join(transform(sequence(1, length(entity)), i -> IF(substring(entity, i, 1) RLIKE '[A-Z]', upper(substring(surrogate, i, 1)), "
        "substring(surrogate, i, 1))), '')"
    )
    bare = f"regexp_replace(entity, {_TITLE}, '')"
    name = f"concat(regexp_extract(entity, {_TITLE}, 0), IF({bare} = upper({bare}), upper(surrogate), replace(initcap(replace(surrogate, '-', '- ')), '- ', '-')))"
    return f"CASE WHEN kind IN ('ssn', 'card', 'phone', 'iban') THEN {digits} WHEN kind IN ('email', 'secret') THEN {case} WHEN kind = 'name' THEN {name} ELSE surrogate END"


def _entities(found: DataFrame) -> DataFrame:
    """(entity, kind, norm, gender, script, kept) of each distinct spelling."""
    female = _text(rf"^(?:(?:{'|'.join(TITLES['f'])})\.? |(?:{'|'.join((GIVEN['f', 'latin'] + ' ' + GIVEN['f', 'cyrillic']).split())}) )")
    kinds = found.select("entity").distinct().withColumn("kind", F.expr(_kind("entity"))).where("kind IS NOT NULL")
    return kinds.selectExpr(
        "entity", "kind", f"{_normal('entity')} AS norm", f"IF(entity RLIKE {female}, 'f', 'm') AS gender",
        r"IF(entity RLIKE '\\p{IsCyrillic}', 'cyrillic', 'latin') AS script",
        r"length(regexp_extract(entity, '^\\+([0-9]{1,3})[^0-9]', 1)) AS kept",
    )


def mapping(found: DataFrame, key: str) -> DataFrame:
    """(entity, kind, replacement): one row per distinct spelling, surrogates all different."""
    spellings = settle(_entities(found))
    forms = settle(
        spellings.groupBy("kind", "norm").agg(F.min("gender").alias("gender"), F.min("script").alias("script"), F.max("kept").alias("kept"))
        .withColumn("attempt", F.lit(0))
    )
    real = forms.selectExpr("kind", "norm AS surrogate", "true AS is_real")
    done = None
    for attempt in range(MOST_ATTEMPTS):
        drawn = forms.withColumn("attempt", F.lit(attempt)).withColumn(
            "h", F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "norm", F.col("attempt").cast("string")), 256)
        ).withColumn("surrogate", F.expr(_draw()))
        taken = real if done is None else real.union(done.selectExpr("kind", "surrogate", "true"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("owner"))
        judged = settle(
            drawn.join(first, ["kind", "surrogate"]).join(taken.distinct(), ["kind", "surrogate"], "left")
            .withColumn("good", F.expr("norm = owner AND is_real IS NULL"))
        )
        good = judged.where("good").select("kind", "norm", "surrogate")
        done = good if done is None else settle(done.union(good))
        forms = judged.where("NOT good").select("kind", "norm", "gender", "script", "kept", "attempt")
        if forms.isEmpty():
            return spellings.join(done, ["kind", "norm"]).selectExpr("entity", "kind", f"{_render()} AS replacement")
    raise ValueError(f"surrogates still collide after {MOST_ATTEMPTS} attempts")


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """`docs` with surrogates in `text`, and n_entities and the sorted `kinds` found."""
    pattern = _text(ANY)
    maybe = f"(text RLIKE {_text(MARKS)} OR text RLIKE {_text(TWO_CAPITALS)} AND text RLIKE {_text(PATTERNS['name'])})"
    names = [f"`{c}`" for c in docs.columns if c != "text"]
    plain = docs.where(f"NOT coalesce({maybe} AND text RLIKE {pattern}, false)").selectExpr(
        *names, "text", "0L AS n_entities", "CAST(array() AS ARRAY<STRING>) AS kinds"
    )
    hit = docs.where(f"{maybe} AND text RLIKE {pattern}").withColumn("_hash", F.xxhash64("text")).withColumn(
        "_found", F.expr(f"regexp_extract_all(text, {pattern}, 0)")
    )
    found = settle(hit.select("doc_id", "_hash", F.explode(F.array_distinct("_found")).alias("entity")).distinct())
    mapped = found.join(mapping(found, key), "entity").groupBy("doc_id", "_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "replacement"))).alias("_map"),  # of one document
        F.array_sort(F.collect_set("kind")).alias("kinds"),
    )
    both = hit.join(mapped, hit["doc_id"].eqNullSafe(mapped["doc_id"]) & (hit["_hash"] == mapped["_hash"])).drop(mapped["doc_id"]).drop(mapped["_hash"])
    pieces = f"split(text, {pattern}, -1)"
    text = f"array_join(flatten(transform({pieces}, (x, i) -> array(x, coalesce(element_at(_map, get(_found, i)), get(_found, i), '')))), '')"
    return plain.unionByName(both.selectExpr(*names, f"{text} AS text", "CAST(size(_found) AS BIGINT) AS n_entities", "kinds"))
