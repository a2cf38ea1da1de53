"""Surrogates for personal data, in DataFrame functions only.

Detected entities (e-mail and IP addresses, phone and card numbers, hexadecimal
secrets, names behind a title) get replacements of the same kind: a keyed digest of the
normalised entity drives a substitution that keeps its format (letters, case,
digits, separators, valid octets and card check digits) and, for names, gender and script.

Coreference: an entity has one surrogate in the whole corpus, in whatever format it is
written (a number's digits, an address in any case, a family name alone or behind a
given name). Distinctness: a registry of all entities holds each one's surrogate;
entities whose surrogates meet, or meet an entity that occurs in the corpus, are drawn
again until there is no collision.

Only texts with entities are shuffled, once, by a hash of the text; entities travel as
short rows, pre-aggregated, so an entity or text that a third of all rows share
is one row of the registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.llm.scratch import stored

# fixed values: titles and the gender they state
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mademoiselle", "Mme", "Mlle", "г-жа", "Κυρία"],
    "m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н", "Κύριος"],
    "x": ["Dr", "Prof"],
}
SYLLABLES = {
    "latin": "ba re mi lo du fa ne ri to vu ga le si ko mu da".split(),
    "cyrillic": "ба ре ми ло ду фа не ри то ву га ле си ко му да".split(),
    "greek": "βα ρε μι λο δυ φα νε ρι το ζυ γα λε σι κο μυ δα".split(),
}
GIVEN_END = {"latin": {"f": "na", "m": "son", "x": "ly"}, "cyrillic": {"f": "на", "m": "сон", "x": "ли"}, "greek": {"f": "να", "m": "σων", "x": "λη"}}

_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?[ \t]{1,3}"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_GROUP = "[0-9A-Fa-f]{1,4}"
_PHONES = [
    r"(?:\+1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}",  # North America
    r"(?:\+|00)[1-9](?:[ ./-]?(?:\(\d{1,4}\)[ ./-]?)?\d){6,14}",  # country code, trunk (0), any groups
    r"\(\d{2,5}\)[ ./-]?\d{2,4}(?:[ ./-]?\d{2,4}){1,4}",  # area code in brackets
    r"(?!\d{2}[./-]\d{2}[./-](?:19|20)\d{2}(?!\d))(?=(?:[ ./-]{0,3}\d){8})0[1-9]\d{0,3}(?:[ ]?[./-][ ]?|[ ])\d{2,8}(?:[ .-]\d{2,4}){0,4}",  # trunk 0; no date
    r"[6-9]\d{2}(?:[ .-]\d{2}){3}",  # Spain
    r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ ]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}",
    r"[2-9]\d{2}[2-9]\d{6}|0[1-9]\d{8,9}",  # no separators
]
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "card": r"(?<![\p{L}\p{N}.])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\p{L}\p{N}]|\.\d)",
    "secret": r"(?<![\p{L}\p{N}])(?=[0-9A-Fa-f]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![\p{L}\p{N}])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![\p{{L}}\p{{N}}:]|\.\d)",
    "phone": rf"(?<![\p{{L}}\p{{N}}.+])(?:{'|'.join(_PHONES)})(?![\p{{L}}\p{{N}}]|[./]\d)",
    "person": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}{_NAME}(?:[ \t]{_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = r"[@0-9]|(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?[ \t]"
"""Every entity holds a match of this; texts without one are passed through."""


def _whole(entity: Column, kind: str) -> Column:
    # look-arounds hold at the ends of an entity as they did in its text
    return entity.rlike(f"^(?:{PATTERNS[kind]})$")


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        out = F.when(_whole(entity, kind), kind).otherwise(out)
    return out


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, f"^{_TITLE}", 0)


def _gender(entity: Column) -> Column:
    title = F.regexp_replace(_title(entity), r"[.\s]+$", "")
    return F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m").otherwise("x")


def parts_of(entity: Column, kind: Column) -> Column:
    """array<struct<kind, norm, raw>>: what is replaced on its own. A name's given and family
    name are parts, anything else is one; ``norm`` is equal for writings of one entity."""
    part = lambda k, norm, raw: F.struct(k.alias("kind"), norm.alias("norm"), raw.alias("raw"))
    name = F.regexp_replace(entity, f"^{_TITLE}", "")
    words = F.split(name, r"[ \t]")
    family, given = F.element_at(words, -1), F.element_at(words, 1)
    person = F.when(F.size(words) == 1, F.array(part(F.lit("family"), F.lower(family), family))).otherwise(
        F.array(part(F.concat(F.lit("given_"), _gender(entity)), F.lower(given), given), part(F.lit("family"), F.lower(family), family))
    )
    norm = F.when(kind == "phone", F.substring(_digits(entity), -10, 10)).when(kind == "card", _digits(entity)).otherwise(F.lower(entity))
    return F.when(kind == "person", person).otherwise(F.array(part(kind, norm, entity)))


def _draw(seed: Column, at: Column, n: int) -> Column:
    """A number below n from a keyed digest and a position."""
    return F.pmod(F.xxhash64(seed, at.cast("long")), F.lit(n)).cast("int")


def _pick(seed: Column, at: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), _draw(seed, at, len(alphabet)) + 1, 1)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _shape(s: Column, seed: Column) -> Column:
    """Letters for letters (case kept), digits for digits, the rest as it is."""
    letters, figures = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    swap = lambda c, i: F.when(c.rlike(r"\d"), _pick(seed, i, figures)).when(c.rlike(r"\p{Lu}"), F.upper(_pick(seed, i, letters))).when(c.rlike(r"\p{L}"), _pick(seed, i, letters)).otherwise(c)
    return F.array_join(F.transform(_chars(s), swap), "")


def _hex(s: Column, seed: Column) -> Column:
    swap = lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(_pick(seed, i, "abcdef"))).when(c.rlike("[a-z]"), _pick(seed, i, "abcdef")).otherwise(_pick(seed, i, "0123456789"))
    return F.array_join(F.transform(_chars(s), swap), "")


def _fill(s: Column, digits: Column) -> Column:
    """``s`` with its last digits replaced by those of ``digits`` (a string), right-aligned."""
    def step(acc: Column, c: Column) -> Column:
        takes = c.rlike(r"\d") & (F.length(acc["left"]) > 0)
        out = F.concat(F.when(takes, F.substring(acc["left"], -1, 1)).otherwise(c), acc["out"])
        left = F.when(takes, F.substring(acc["left"], F.lit(1), F.length(acc["left"]) - 1)).otherwise(acc["left"])
        return F.struct(out.alias("out"), left.alias("left"))

    start = F.struct(F.lit("").alias("out"), digits.alias("left"))
    return F.aggregate(F.reverse(_chars(s)), start, step)["out"]


def _luhn(body: Column) -> Column:
    """``body`` (digits) and its check digit."""
    weigh = lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.reverse(_chars(body)), weigh), F.lit(0), lambda a, v: a + v)
    return F.concat(body, F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _run(seed: Column, n: Column, first: str = "0123456789") -> Column:
    """n digits, the first of them out of ``first``."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i == 1, _pick(seed, i, first)).otherwise(_pick(seed, i, "0123456789"))), "")


def _syllable(seed: Column, pool: str):
    return lambda i: F.substring(F.lit(pool), _draw(seed, i, len(pool) // 2) * 2 + 1, F.lit(2))


def _named(kind: Column, norm: Column, seed: Column, attempt: Column) -> Column:
    """A lower-case name of the same script; longer with each attempt, so there is always a free one."""
    places = F.sequence(F.lit(1), attempt + F.when(kind == "family", 4).otherwise(3))
    out = None
    for script in SYLLABLES:  # Latin stands for all scripts without a pool
        pool = "".join(SYLLABLES[script])  # two letters each
        stem = F.array_join(F.transform(places, _syllable(seed, pool)), "")
        end = F.lit("")
        for gender, ending in GIVEN_END[script].items():
            end = F.when(kind == f"given_{gender}", ending).otherwise(end)
        own = F.concat(stem, end)
        out = own if out is None else F.when(norm.rlike(rf"^\p{{Is{script.title()}}}"), own).otherwise(out)
    return out


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The normalised surrogate of a normalised part."""
    seed = F.sha2(F.concat_ws("\x01", F.lit(key), kind, norm, attempt.cast("string")), 256)
    # a domain has one surrogate whoever writes from it
    domain = F.regexp_extract(norm, "@(.*)$", 1)
    home = F.sha2(F.concat_ws("\x01", F.lit(key), F.lit("domain"), domain), 256)
    email = F.concat(_shape(F.regexp_extract(norm, "^(.*)@", 1), seed), F.lit("@"), _shape(F.regexp_replace(domain, r"\.[^.]*$", ""), home), F.lit(".example"))
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    # a documentation address; groups without a leading zero
    groups = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.lower(F.hex(_draw(seed, i, 61440) + 4096))), ":")
    return (
        F.when(kind == "email", email)
        .when(kind == "ip6", F.concat(F.lit("2001:db8:"), groups))
        .when(kind == "ip", octets)
        .when(kind == "card", _luhn(F.concat(F.substring(norm, 1, 1), _run(seed, F.length(norm) - 2))))
        .when(kind == "phone", _run(seed, F.length(norm), "23456789"))
        .when(kind == "secret", _hex(norm, seed))
        .otherwise(_named(kind, norm, seed, attempt))
    )


def _dress(kind: Column, raw: Column, plain: Column) -> Column:
    """The normalised surrogate in the format of the entity as written."""
    cased = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(plain))
    return (
        F.when(kind.isin("card", "phone"), _fill(raw, plain))
        .when(kind.isin("email", "secret", "ip", "ip6"), cased.otherwise(plain))
        .otherwise(cased.otherwise(F.initcap(plain)))
    )


def registry(parts: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt, plain): one row per entity, no two surrogates of a kind equal and
    none equal to an entity of the corpus."""
    reg = parts.select("kind", "norm").distinct().withColumn("attempt", F.lit(0))
    while True:
        reg = stored(reg.select("kind", "norm", "attempt", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key).alias("plain")), "entities")
        first = reg.groupBy("kind", "plain").agg(F.min("norm").alias("owner"), F.count("*").alias("n")).where("n > 1").select("kind", "plain", "owner")
        real = reg.select("kind", F.col("norm").alias("plain"), F.lit(True).alias("real"))
        again = reg.join(first, ["kind", "plain"], "left").join(real, ["kind", "plain"], "left")
        again = again.withColumn("clash", F.coalesce(F.col("owner") != F.col("norm"), F.lit(False)) | F.coalesce("real", F.lit(False)))
        if again.where("clash").isEmpty():
            return reg
        reg = again.select("kind", "norm", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """Every row with its text's entities replaced, and their number in ``count_col``.

    ``key`` is the secret that surrogates hang on. Null texts stay null (0 entities); empty
    texts and texts without entities are unchanged. Repeated rows are treated alike.
    All other columns are passed through whatever their names; ``count_col`` is replaced.
    An empty table gives an empty result.
    """
    cols = [c for c in docs.columns if c != count_col]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(text_col).cast("string").alias("text"))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    found = F.when(hinted, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = src.withColumn("found", found)
    dirty, clean = marked.where(F.size("found") > 0), marked.where(F.size("found") == 0)

    each = dirty.select(F.xxhash64("text").alias("h"), F.explode(F.array_distinct("found")).alias("entity")).distinct()
    each = each.withColumn("kind", kind_of(F.col("entity")))
    parts = each.select("h", "entity", F.col("kind").alias("whole"), F.posexplode(parts_of(F.col("entity"), F.col("kind"))).alias("k", "part")).select("h", "entity", "whole", "k", "part.*")
    parts = stored(parts, "mentions")
    known = registry(parts, key)
    new = parts.join(known, ["kind", "norm"]).withColumn("new", _dress(F.col("kind"), F.col("raw"), F.col("plain")))
    whole = new.groupBy("h", "entity", "whole").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "new"))), lambda p: p["new"]), " ").alias("new"))
    whole = whole.withColumn("new", F.when(F.col("whole") == "person", F.concat(_title(F.col("entity")), F.col("new"))).otherwise(F.col("new")))
    # one map for each text: as long as the text's own list of entities
    maps = whole.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("news"))
    joined = dirty.withColumn("h", F.xxhash64("text")).join(maps, "h")
    between = F.split("text", ANY, -1)
    text = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.element_at(F.col("news"), F.get("found", i)), F.lit("")))), "")
    own = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in cols]
    same = [F.col("row")[c].alias(c) for c in cols]
    n = F.size("found").cast("long").alias(count_col)
    return joined.select(*own, n).unionByName(clean.select(*same, n))
