"""Personal data and secrets replaced by keyed surrogates, with DataFrame functions only.

One pattern finds e-mail addresses, phone numbers, IPv4 addresses, card
numbers, access keys, assigned secrets (``password=...``) and titled person
names.  An entity consists of one or two *atoms* (an address has a local part
and a domain, a person a given name and a surname), and atoms are what is
replaced, so ``Mr John Smith`` and ``Mr Smith``, two addresses of one domain,
or two spellings of one phone number keep pointing to the same thing.

An atom's surrogate is drawn from a keyed SHA-512 of its kind and normal form:
digits become digits, letters become letters of their script, separators and
fixed prefixes stay; a given name has one surrogate, of the gender that its
titles show anywhere in the corpus (none or both: neutral); card numbers keep
their first digit and whether their check digit holds; addresses in private
networks stay private.  Collisions are checked over the whole corpus: a
surrogate may neither be another atom's surrogate nor an atom that really
occurs; atoms that collide draw again with the next round's hash.  From
``WIDEN`` rounds on surrogates get longer and addresses come from the reserved
range 240.0.0.0/4; from twice as many on they come from the private IPv6 range
fd00::/8, which no corpus exhausts, so this ends.

Defined results: NULL and empty texts stay as they are; rows with one text are
treated alike, whatever their ids; all columns are kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table, with_length

KEY = "documented test key: pass your own"
WIDEN = 6

# Titles by gender, and given names by gender and script.
TITLES = {"m": "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία",
          "u": "Dr|Prof"}
GIVEN = {
    ("m", "latin"): "James Peter Martin Daniel Paul Thomas Simon Lucas Victor Adrian Hugo Oscar",
    ("f", "latin"): "Anna Maria Laura Julia Clara Helena Nora Emma Sofia Alice Irene Diana",
    ("u", "latin"): "Alex Robin Sasha Kim Dominique Andrea Charlie Noa Sam Jamie Toni Chris",
    ("m", "cyrillic"): "Иван Пётр Павел Сергей Андрей Николай", ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Вера",
    ("u", "cyrillic"): "Саша Женя Валя Слава", ("m", "greek"): "Γιώργος Νίκος Πέτρος Παύλος",
    ("f", "greek"): "Μαρία Ελένη Άννα Σοφία", ("u", "greek"): "Αλέξης Άρης Φώτης"}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя",
             "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)*+"
# possessive throughout: a repeated group that may give back recurses in Java, and a long host name ends the executor
_LABEL = r"-*+[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
_ALL_TITLES = "|".join(TITLES.values())
# what a secret is assigned to, in any case; an underscore may stand before (API_TOKEN)
_ASSIGNED = r"(?i:password|passwd|pwd|secret|token|api_key|apikey)\s?[=:]\s?[\"']?"
PATTERNS = {
    "email": rf"(?<![\w.%+-])[\w.%+-]++@{_LABEL}(?:\.{_LABEL})++",
    "secret": rf"(?<![^\W_]){_ASSIGNED}[^\s\"',;]{{6,}}+",
    "access": r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)"
             r"|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "card": r"(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])",
    "person": rf"(?<!\w)(?:{_ALL_TITLES})\.? {_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(PATTERNS.values())
#: A text without these has no entity; cheap, so most texts are passed over quickly.  Every alternative of PATTERN needs one.
HINT = (rf"[0-9]{{3}}|[0-9]\.[0-9]|\+[0-9]|@|[=:]|(?:AKIA|ASIA)[0-9A-Z]{{16}}|"
        rf"(?<!\w)(?:{_ALL_TITLES})\.? \p{{Lu}}")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def kind_of(entity: Column) -> Column:
    """The entity's kind: the first pattern that matches all of it."""
    out = F.lit("card")
    for kind in reversed([k for k in PATTERNS if k != "card"]):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _script(c: Column) -> Column:
    return (F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin"))


def _person(entity: Column) -> tuple[Column, Column, Column]:
    """Gender, given name (may be empty) and surname."""
    title = F.regexp_extract(entity, rf"^({_ALL_TITLES})\.? ", 1)      # to the blank: Mr is no Mrs
    names = F.regexp_extract(entity, rf"^(?:{_ALL_TITLES})\.? (.*)$", 1)
    gender = F.when(title.rlike(f"^(?:{TITLES['m']})$"), "m").when(title.rlike(f"^(?:{TITLES['f']})$"), "f").otherwise("u")
    two = names.contains(" ")
    given = F.when(two, F.substring_index(names, " ", 1)).otherwise("")
    return gender, given, F.substring_index(names, " ", -1)


_SECRET = rf"^({_ASSIGNED})([^\s\"',;]++)$"
_COUNTRY = r"^\+(\d{1,3}?)(?:[ .(-]|(?=\d{9,}$))"


def atoms_of(kind: Column, entity: Column) -> Column:
    """Array of (kind, norm), one or two per entity; an absent given name is left out."""
    gender, given, surname = _person(entity)

    def atom(k, norm):
        return F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), norm.alias("norm"))

    country = F.regexp_extract(entity, _COUNTRY, 1)
    phone = F.concat(country, F.lit(" "), F.substr(_digits(entity), F.length(country) + F.lit(1)))
    return (F.when(kind == "email", F.array(atom("local", F.lower(F.substring_index(entity, "@", 1))),
                                            atom("domain", F.lower(F.substring_index(entity, "@", -1)))))
            .when(kind == "phone", F.array(atom("phone", phone)))
            .when(kind == "ip", F.array(atom("ip", entity)))
            .when(kind == "card", F.array(atom("card", _digits(entity))))
            .when(kind == "access", F.array(atom("access", entity)))
            .when(kind == "secret", F.array(atom("secret", F.regexp_extract(entity, _SECRET, 2))))
            .otherwise(F.filter(F.array(
                atom(F.concat(F.lit("given_"), gender, F.lit("_"), _script(given)), F.lower(given)),
                atom(F.concat(F.lit("surname_"), _script(surname)), F.lower(surname))), lambda a: a["norm"] != "")))


def _byte(stream: Column, i) -> Column:
    """The i-th pseudo-random number (0 to 65535) of a hex stream of 64 such numbers."""
    at = F.pmod(i if isinstance(i, Column) else F.lit(i), F.lit(64)) * F.lit(4) + F.lit(1)
    return F.conv(F.substr(stream, at, F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + F.lit(1), F.lit(1))


def _alike(text: Column, stream: Column, hexa: Column, keep: Column | None = None) -> Column:
    """Each character replaced by one of its class; the first ``keep`` characters stay."""
    keep = F.lit(0) if keep is None else keep

    def swap(c, i):
        n = _byte(stream, i)
        out = F.when(i < keep, c).when(c.rlike("[0-9]"), _pick("0123456789", n)).when(
            c.rlike("[a-z]"), F.when(hexa, _pick("abcdef", n)).otherwise(_pick(ALPHABETS["latin"], n)))
        out = out.when(c.rlike("[A-Z]"), _pick(ALPHABETS["latin"].upper(), n))
        for script in ("cyrillic", "greek"):
            block = "IsCyrillic" if script == "cyrillic" else "IsGreek"
            out = out.when(c.rlike(rf"\p{{{block}}}"), F.when(c.rlike(r"\p{Lu}"), _pick(ALPHABETS[script].upper(), n))
                           .otherwise(_pick(ALPHABETS[script], n)))
        return out.when(c.rlike(r"\p{L}"), _pick(ALPHABETS["latin"], n)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def _check_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string."""
    def add(total, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, double).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - F.lit(1)), F.lit(0), add)


def seeded(kind: Column, norm: Column, round_: int, key: str) -> list[Column]:
    """What a draw needs of the whole atom: its pseudo-random numbers, and whether it is a hex string.

    These are made columns of their own before characters are drawn, because
    what stands inside a transform is worked out for every character.
    """
    seed = F.concat_ws("|", F.lit(key), kind, norm, F.lit(str(round_)))
    stream = F.concat(F.sha2(F.concat(seed, F.lit("|a")), 512), F.sha2(F.concat(seed, F.lit("|b")), 512))
    return [stream.alias("stream"), norm.rlike("^[0-9a-f]+$").alias("hexa")]


def candidate(kind: Column, norm: Column, stream: Column, hexa: Column, round_: int) -> Column:
    """The surrogate of an atom in one round of draws."""
    octet = [_byte(stream, k) for k in range(4)]
    inner = [F.pmod(o, F.lit(254)) + 1 for o in octet]
    ip = (F.when(norm.startswith("10."), F.concat_ws(".", F.lit("10"), *inner[1:]))
          .when(norm.startswith("127."), F.concat_ws(".", F.lit("127"), *inner[1:]))
          .when(norm.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), *inner[2:]))
          .when(norm.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\."),
                F.concat_ws(".", F.lit("172"), F.pmod(octet[1], F.lit(16)) + 16, *inner[2:]))
          .otherwise(F.concat_ws(".", F.pmod(octet[0], F.lit(99)) + 11, *inner[1:])))
    if round_ >= 2 * WIDEN:
        ip = F.concat_ws(":", F.concat(F.lit("fd"), F.substr(stream, F.lit(1), F.lit(2))),
                         *[F.substr(stream, F.lit(4 * k + 3), F.lit(4)) for k in range(7)])
    elif round_ >= WIDEN:
        ip = F.concat_ws(".", F.pmod(octet[0], F.lit(16)) + 240, *[F.pmod(o, F.lit(256)) for o in octet[1:]])
    card = _alike(norm, stream, hexa, F.lit(1))
    body = F.substr(card, F.lit(1), F.length(card) - F.lit(1))
    last = F.pmod(F.lit(10) - F.pmod(_check_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    card = F.when(F.pmod(_check_sum(norm), F.lit(10)) == 0, F.concat(body, last.cast("string"))).otherwise(card)
    labels = F.length(norm) - F.length(F.substring_index(norm, ".", -1)) - F.lit(1)
    domain = F.concat(_alike(F.substr(norm, F.lit(1), labels), stream, hexa), F.substr(norm, labels + F.lit(1)))
    country = F.length(F.substring_index(norm, " ", 1))
    out = (F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "domain", domain)
           .when(kind == "phone", _alike(norm, stream, hexa, country))
           .when(kind == "access", _alike(norm, stream, hexa, F.lit(4))))
    if round_ == 0:
        for (gender, script), names in GIVEN.items():
            listed = names.lower().split(" ")
            out = out.when(kind == f"given_{gender}_{script}",
                           F.get(F.array(*[F.lit(n) for n in listed]), F.pmod(octet[0], F.lit(len(listed)))))
    ending = F.when(kind.rlike("^given_f_latin"), "a").when(kind.rlike("^given_m_latin"), "o").when(
        kind.rlike("^given_f_cyr"), "а").when(kind.rlike("^given_f_greek"), "α").otherwise("")
    out = out.when(kind.startswith("given_"), F.concat(_alike(norm, stream, hexa), ending)).otherwise(
        _alike(norm, stream, hexa))
    if round_ >= WIDEN:
        wider = F.concat_ws("", *[_pick("0123456789", _byte(stream, 63 - k)) for k in range(round_ - WIDEN + 2)])
        out = F.when(kind == "domain", F.concat(F.lit("n"), wider, F.lit("."), out)).when(
            kind == "ip", ip).otherwise(F.concat(out, wider))
    return out


def one_gender(parts: DataFrame) -> DataFrame:
    """``parts`` with the kind of a given name set to the one gender that its titles show, neutral if none or both."""
    said = F.regexp_extract("kind", "^given_([mfu])_", 1)
    names = parts.filter(F.col("kind").startswith("given_")).groupBy(_family(F.col("kind")).alias("family"), "norm").agg(
        F.max((said == "m").cast("int")).alias("m"), F.max((said == "f").cast("int")).alias("f"))
    gender = F.when(F.col("m") > F.col("f"), "given_m_").when(F.col("f") > F.col("m"), "given_f_").otherwise("given_u_")
    resolved = names.select("family", "norm", F.concat(gender, F.expr("substring(family, 7)")).alias("resolved"))
    return (parts.withColumn("family", _family(F.col("kind"))).join(resolved, ["family", "norm"], "left")
            .select("entity", "what", F.coalesce("resolved", "kind").alias("kind"), "norm"))


def _family(kind: Column) -> Column:
    """The kind without a gender: collisions are checked within it."""
    return F.regexp_replace(kind, "^given_[mfu]_", "given_")


def surrogates(atoms: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, surrogate) for every different atom; surrogates are different and none occurs as an atom."""
    real = cut(atoms.distinct().withColumn("family", _family(F.col("kind"))), "pii-atoms")
    todo, done, turn = real, [], 0
    # drawing costs about a millisecond an atom: spread by number, as the table's few bytes would be one task
    tasks = int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        ready = todo.select("*", *seeded(F.col("kind"), F.col("norm"), turn, key)).repartition(tasks, "kind", "norm")
        drawn = ready.withColumn("surrogate", candidate(
            F.col("kind"), F.col("norm"), F.col("stream"), F.col("hexa"), turn))
        taken = reduce(DataFrame.unionByName, [d.select("family", "surrogate") for d in done],
                       real.select("family", F.col("norm").alias("surrogate")))
        won = (drawn.join(taken, ["family", "surrogate"], "left_anti").groupBy("family", "surrogate")
               .agg(F.min(F.struct("kind", "norm")).alias("first")).select("family", "first.*", "surrogate"))
        done.append(cut(won, "pii-surrogates"))
        todo = cut(todo.join(done[-1], ["kind", "norm"], "left_anti"), "pii-left")
        turn += 1
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done).select("kind", "norm", "surrogate")


def _case_like(surrogate: Column, original: Column) -> Column:
    return (F.when((original == F.upper(original)) & (F.length(original) > 1) & (original != F.lower(original)),
                   F.upper(surrogate))
            .when(F.substr(original, F.lit(1), F.lit(1)).rlike(r"\p{Lu}"), F.initcap(surrogate)).otherwise(surrogate))


def _digits_into(entity: Column, digits: Column) -> Column:
    """The entity with its digits replaced one by one; digits left over are appended."""
    count = F.length(_digits(entity))
    put = F.transform(F.split(entity, ""), lambda c, i: F.when(
        c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(entity, F.lit(1), i + 1))), F.lit(1))).otherwise(c))
    return F.concat(F.array_join(put, ""), F.substr(digits, count + F.lit(1)))


def rebuilt(kind: Column, entity: Column, parts: Column) -> Column:
    """The entity's replacement from its atoms' surrogates (a map from atom kind to surrogate)."""
    _, given, surname = _person(entity)

    def part(name):
        return F.get(F.map_values(F.map_filter(parts, lambda k, _: k.startswith(name))), F.lit(0))

    title = F.regexp_extract(entity, rf"^((?:{_ALL_TITLES})\.? )", 1)
    person = F.concat(title, F.when(given != "", F.concat(_case_like(part("given_"), given), F.lit(" "))).otherwise(""),
                      _case_like(part("surname_"), surname))
    local, host = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)

    def upper_like(surrogate, original):
        return F.when((original == F.upper(original)) & (original != F.lower(original)), F.upper(surrogate)).otherwise(surrogate)

    return (F.when(kind == "email", F.concat(upper_like(part("local"), local), F.lit("@"), upper_like(part("domain"), host)))
            .when(kind == "phone", _digits_into(entity, _digits(part("phone"))))
            .when(kind == "card", _digits_into(entity, part("card")))
            .when(kind == "secret", F.concat(F.regexp_extract(entity, _SECRET, 1), part("secret")))
            .when(kind == "person", person).otherwise(part("")))


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with every entity of the text replaced (see the module's docstring)."""
    text = F.col(text_col).cast("string")
    found = F.regexp_extract_all(text, F.lit(PATTERN), 0)
    hint = F.coalesce(text.rlike(HINT), F.lit(False))
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    row = F.xxhash64(*[F.col(f"`{c}`") for c in plain])     # equal keys only merge maps of one and the same function
    hits = cut(docs.filter(hint).select(row.alias("key"), found.alias("entities"))
               .filter("size(entities) > 0").select("key", F.explode(F.array_distinct("entities")).alias("entity")),
               "pii-hits")
    entities = (hits.groupBy("entity").agg(F.lit(1).alias("one")).select("entity", kind_of(F.col("entity")).alias("what"))
                .select("entity", "what", atoms_of(F.col("what"), F.col("entity")).alias("atoms")))
    entities = cut(entities, "pii-entities")
    parts = one_gender(entities.select("entity", "what", F.explode("atoms").alias("atom"))
                       .select("entity", "what", "atom.*"))
    drawn = surrogates(parts.select("kind", "norm"), key)
    names = (parts.join(drawn, ["kind", "norm"]).groupBy("entity", "what")
             .agg(F.map_from_entries(F.collect_list(F.struct("kind", "surrogate"))).alias("parts"))
             .select("entity", rebuilt(F.col("what"), F.col("entity"), F.col("parts")).alias("replacement")))
    names = cut(names, "pii-names")
    # written tables on both sides: what very many texts hold can be split by the planner
    per_text = cut(hits.distinct().join(names, "entity").groupBy(F.col("key").alias("_key"))
                   .agg(F.map_from_entries(F.collect_list(F.struct("entity", "replacement"))).alias("_names")),
                   "pii-texts")
    # whole rows in one struct, so that no column of the input meets a name of ours
    body = F.col("_row")[text_col].cast("string")
    masked = F.array_join(F.zip_with(
        F.split(body, PATTERN, -1),
        F.concat(F.transform(F.regexp_extract_all(body, F.lit(PATTERN), 0), lambda e: F.col("_names")[e]),
                 F.array(F.lit(""))),
        lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    replaced = (docs.filter(hint).select(whole.alias("_row"), row.alias("_key")).join(per_text, "_key", "left")
                .withColumn("_text", F.when(F.col("_names").isNull(), body).otherwise(masked))
                .select(*[F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns]))
    return docs.filter(~hint).withColumn(text_col, text).unionByName(replaced)


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with personal data and secrets replaced by surrogates."""
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, personal data and secrets replaced."""
    return with_length(replace_entities(docs))
