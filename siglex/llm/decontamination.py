"""Operator 1, native: benchmark decontamination by template windows.

A text's words are canonicalised: numbers, names and units become typed
placeholders, the rest is lower-cased without punctuation. Windows of eight
template words are hash-joined between benchmark items and documents; what the
placeholders stand for on both sides (the slots) must map one value to one
value within a window and over a stretch of neighbouring windows of an aligned
occurrence; a conflict ends the stretch. What templates can't tell (windows
with too few literal words, items of few words) is joined as plain lower-cased
words, and the first word of a window counts as a name and as a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglex.llm.scratch import bit_table, long_array

WINDOW, SHORTEST, LITERALS = 8, 5, 4
TABLE_BITS = 20

#: Unit words that follow a number.
UNITS = "kg|g|mg|km|m|cm|mm|l|ml|lb|lbs|oz|ft|in|mi|mph|kmh|hz|khz|mhz|w|kw|v|usd|eur|gbp|dollars?|euros?|pounds?|cents?|percent|miles?|feet|foot|inch|inches|yards?|meters?|metres?|kilometers?|kilometres?|grams?|kilograms?|liters?|litres?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?"
#: The placeholders.
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Punctuation taken off words.
PUNCTUATION = r"""[.,;:!?"'()\[\]{}]+(?=\s|$)|(?<!\S)["'(\[{]+"""


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def template(text: Column) -> Column:
    """The text with typed placeholders; it has as many words (split at single blanks) as the squeezed text."""
    t = F.regexp_replace(text, r"[0-9](?<![^\s$€£].)\S*", NUMBER)
    t = F.regexp_replace(t, r"\p{Lu}(?<=[^.!?:\s] .)[\p{L}'-]*", NAME)
    t = F.when(F.contains(t, F.lit(NUMBER)), F.regexp_replace(t, rf"(?i)(?<=<num> )(?:{UNITS})(?![\p{{L}}\p{{N}}])", UNIT)).otherwise(t)
    return F.lower(F.regexp_replace(t, PUNCTUATION, ""))


def _words(df: DataFrame, key: str) -> DataFrame:
    return (
        df.select(key, _squeezed(F.col("text")).alias("flat"))
        .where(F.col("flat") != "")
        .select(key, F.split("flat", " ").alias("raw"), F.split(template(F.col("flat")), " ").alias("words"), F.split(_plain(F.col("flat")), " ").alias("plain"))
    )


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, PUNCTUATION, ""))


def _literal(word: Column) -> Column:
    return ~word.isin(NUMBER, NAME, UNIT)


def _slots(w: Column | str, r: Column | str) -> Column:
    """What the placeholders of the template words ``w`` stand for."""
    return F.filter(F.transform(w, lambda x, i: F.when(_literal(x), F.lit(None)).otherwise(_plain(F.get(r, i)))), lambda s: s.isNotNull())


def _hash(w: Column | str, kind: str = "") -> Column:
    return F.md5(F.concat(F.lit(kind), F.array_join(w, " ")).cast("binary"))


def _places(df: DataFrame, key: str, starts: Column, lengths: Column, *words: str) -> DataFrame:
    """Rows (key, at, len) with the slices of ``words`` for each start and length that fits."""
    return (
        df.select(key, *words, F.explode(starts).alias("at"))
        .select(key, "at", *words, F.explode(lengths).alias("len"))
        .where(F.col("at") + F.col("len") <= F.size(words[0]))
        .select(key, "at", "len", *(F.slice(w, F.col("at") + 1, F.col("len")).alias(w) for w in words))
    )


def _enough(w: Column | str) -> Column:
    return F.size(F.filter(w, _literal)) >= F.least(F.lit(LITERALS), F.size(w))


def _windows(df: DataFrame, key: str, starts: Column, lengths: Column) -> DataFrame:
    """Rows (key, at, len, window, slots) for each start and length that fits and holds enough literal words."""
    rows = _places(df, key, starts, lengths, "words", "raw").where(_enough("words"))
    return rows.select(key, "at", "len", _hash("words").alias("window"), _slots("words", "raw").alias("slots"))


def _plain_windows(df: DataFrame, key: str, starts: Column, lengths: Column) -> DataFrame:
    """Rows (key, at, len, window, slots) of lower-cased windows; they have no slots."""
    rows = _places(df, key, starts, lengths, "plain")
    return rows.select(key, "at", "len", _hash("plain", "=").alias("window"), F.array().cast("array<string>").alias("slots"))


def _wanted(items: DataFrame) -> DataFrame:
    """Rows (item_id, at, len, window, slots, head, kind, fixed) of the benchmark's windows.

    A document may read a window's first word as a name, a unit or a literal,
    by what stands before it, so each such reading gives a row; where it makes a
    literal a placeholder, the word must be the same (``fixed``). Windows of
    which a reading has too few literal words are plain too (kind 1 to 3: words
    in the head; templates have kind 0).
    """
    n = F.size("plain")
    length = F.least(n, F.lit(WINDOW))
    rows = _places(items, "item_id", F.sequence(F.lit(0), n - length), F.array(length), "plain", "words", "raw").where(F.array_join("plain", "") != "").distinct()
    first, own = F.get("words", 0), F.get("plain", 0)
    rest = F.slice("words", 2, F.size("words") - 1)
    reading = lambda word, fixed: F.struct(F.concat(F.array(word), rest).alias("w"), F.lit(fixed).alias("fixed"))
    capital = _plain(F.regexp_replace(F.get("raw", 0), r"^\p{Lu}[\p{L}'-]*", NAME))
    readings = F.array(
        reading(first, False),
        F.when(first.isin(NAME, UNIT), reading(own, False)),
        F.when(_literal(first) & (capital == NAME), reading(F.lit(NAME), True)),
        F.when(_literal(first) & own.rlike(f"^(?:{UNITS})$"), reading(F.lit(UNIT), True)),
    )
    read = rows.withColumn("x", F.explode(F.filter(readings, lambda x: x.isNotNull()))).select("*", "x.*")
    strong = (F.col("len") >= SHORTEST) & _enough("w")
    templates = read.where(strong).select("item_id", "at", "len", _hash("w").alias("window"), _slots("w", "raw").alias("slots"), _head(F.col("w"), 0).alias("head"), F.lit(0).alias("kind"), "fixed")
    kind = F.least(F.col("len"), F.lit(3))
    plain = read.where(~strong).select("item_id", "at", "len", _hash("plain", "=").alias("window"), F.array().cast("array<string>").alias("slots"), F.when(kind == 1, _plain_head("plain", F.lit(0), 1)).when(kind == 2, _plain_head("plain", F.lit(0), 2)).otherwise(_plain_head("plain", F.lit(0), 3)).alias("head"), kind.alias("kind"), F.lit(False).alias("fixed"))
    return templates.union(plain).distinct()


def _head(words: Column, i: Column | int) -> Column:
    """Hash of three words, for the bit table."""
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _plain_head(words: Column | str, i: Column, k: int) -> Column:
    """Hash of ``k`` plain words, for the same table."""
    return F.xxhash64(F.lit(k), *(F.get(words, i + j) for j in range(k)))


def _consistent(slots: Column) -> Column:
    """No value of the item stands for two values of the document."""
    return F.size(F.array_distinct(slots)) == F.size(F.array_distinct(F.transform(slots, lambda s: s["item_slots"])))


def _stretches(windows: Column, kind: str, least: int) -> Column:
    """(n, slots) of the windows, ascending, that lie in maximal consistent stretches of ``least`` or more."""
    none = F.array().cast(kind)
    state = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"), none.alias("slots"), F.lit(0).alias("own_n"), none.alias("own"))

    def ended(s: Column) -> tuple[Column, Column]:
        enough = s["own_n"] >= least
        return s["n"] + F.when(enough, s["own_n"]).otherwise(0), F.when(enough, F.array_distinct(F.concat(s["slots"], s["own"]))).otherwise(s["slots"])

    def step(s: Column, x: Column) -> Column:
        both = F.array_distinct(F.concat(s["own"], x["slots"]))
        n, slots = ended(s)
        new = F.when(x["item_at"] == s["last"], 0).otherwise(1)
        return F.when(
            _consistent(both),
            F.struct(x["item_at"].alias("last"), s["n"].alias("n"), s["slots"].alias("slots"), (s["own_n"] + new).alias("own_n"), both.alias("own")),
        ).otherwise(F.struct(x["item_at"].alias("last"), n.alias("n"), slots.alias("slots"), new.alias("own_n"), x["slots"].alias("own")))

    return F.aggregate(windows, state, step, lambda s: F.struct(ended(s)[0].alias("n"), ended(s)[1].alias("slots")))


def leaks(docs: DataFrame, benchmark: DataFrame, min_windows: int = 1) -> DataFrame:
    """Rows (doc_id, item_id, n_windows, n_item_windows, coverage, n_slots, verbatim), one for each leak.

    Items of eight words or more give all their windows of eight, shorter ones
    a single window. Templates need five words and four literal ones; other
    windows match as plain lower-cased words without punctuation. Items without
    a word match nothing, nor do null or empty texts. Documents are searched
    whole; starts are first sieved with a bit table of fixed size over the
    windows' first three words, which lets through every start that can match.
    ``n_windows`` counts an alignment's windows in consistent stretches of
    ``min_windows`` or more. Rows repeated in either table count once; an empty
    table gives an empty result. Columns other than the ids and texts are not read.
    """
    spark = docs.sparkSession
    wanted = _wanted(_words(benchmark, "item_id")).persist()
    n = F.size("words")
    table = bit_table(wanted, F.col("head"), TABLE_BITS)
    longs = [int.from_bytes(table[i : i + 8], "little", signed=True) for i in range(0, len(table), 8)]
    forms = [(r.kind, r.len) for r in wanted.select("kind", "len").distinct().collect()]  # at most 4 by 8
    lengths = sorted(size for kind, size in forms if not kind) or [WINDOW]
    bits = long_array(longs)

    def has_bit(h: Column) -> Column:
        place = F.pmod(h, F.lit(1 << TABLE_BITS))
        return F.getbit(F.element_at(bits, F.shiftright(place, 6).cast("int") + 1), (place % 64).cast("int")) == 1

    def searched(df: DataFrame) -> DataFrame:
        may = F.filter(F.sequence(F.lit(0), n - min(lengths)), lambda i: has_bit(_head(F.col("words"), i)))
        out = _windows(df.where(n >= min(lengths)), "doc_id", may, F.lit(lengths))
        for k in sorted({kind for kind, _ in forms if kind}):
            sizes = sorted(size for kind, size in forms if kind == k)
            may = F.filter(F.sequence(F.lit(0), n - min(sizes)), lambda i: has_bit(_plain_head("plain", i, k)))  # noqa: B023
            out = out.union(_plain_windows(df.where(n >= min(sizes)), "doc_id", may, F.lit(sizes)))
        return out

    found = searched(_words(docs, "doc_id")).withColumnRenamed("slots", "doc_slots").withColumnRenamed("at", "doc_at")
    pairs = found.join(wanted.select("item_id", F.col("at").alias("item_at"), "window", F.col("slots").alias("item_slots"), "fixed"), "window")
    pairs = pairs.where(~F.col("fixed") | F.get("item_slots", 0).eqNullSafe(F.get("doc_slots", 0))).withColumn("slots", F.array_distinct(F.arrays_zip("item_slots", "doc_slots")))
    aligned = pairs.where(_consistent(F.col("slots"))).groupBy("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.sort_array(F.collect_set(F.struct("item_at", "slots"))).alias("windows"))
    kept = (
        aligned.select("doc_id", "item_id", _stretches(F.col("windows"), aligned.schema["windows"].dataType.elementType["slots"].dataType.simpleString(), min_windows).alias("s"))
        .select("doc_id", "item_id", "s.n", F.array_distinct("s.slots").alias("slots"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("n").alias("n_windows"), F.max(F.size("slots")).alias("n_slots"), F.bool_or((F.col("n") > 0) & F.forall("slots", lambda s: s["item_slots"].eqNullSafe(s["doc_slots"]))).alias("verbatim"))
        .where(F.col("n_windows") >= F.greatest(F.lit(min_windows), F.lit(1)))
    )
    sizes = wanted.groupBy("item_id").agg(F.count_distinct("at").alias("n_item_windows"))
    return kept.join(sizes, "item_id").select(
        "doc_id",
        "item_id",
        F.col("n_windows").cast("long"),
        F.col("n_item_windows").cast("long"),
        (F.col("n_windows") / F.col("n_item_windows")).alias("coverage"),
        F.col("n_slots").cast("long"),
        "verbatim",
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of ``benchmark``."""
    keyed = docs.select(F.struct("*").alias("row"), F.concat_ws("-", F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id")).alias("doc_id"), "text")
    found = leaks(keyed.select("doc_id", "text"), benchmark).select("doc_id").distinct()
    return keyed.join(found, "doc_id", "left_anti").select("row.*")
