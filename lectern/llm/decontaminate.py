"""Benchmark decontamination by templates: questions are found again with other numbers, names and units.

Texts become words; numbers, names inside a sentence and units become typed
placeholders. Windows of the templates are hash-joined, windows that lie on one
diagonal are evidence of one place, and what stands in the slots must be
exchanged consistently there: a name or unit of the question has one value in
the text. A number may stand for two things, and then has a value for each.
Beside the templates, windows are joined

* by looser templates, in which a capitalised word at the beginning of a
  sentence is a name as well, since questions often begin with one;
* by their plain lower-case words, so that a verbatim copy is found whatever its
  words become in a template.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..session import materialise
from .common import narrow

#: Words in a window; literal words it needs; windows in a row that make a finding (13 words).
WINDOW, LITERALS, WINDOWS = 8, 4, 6
#: Windows of the benchmark that may be sent to all tasks (16 bytes of key and place each, and their words).
SENT_WINDOWS = 1 << 17
#: First words of short items up to which windows are chosen by them.
FIRSTS = 1024
_NAME, _FIRST = "\x01", "\x02"
#: Kinds of windows: by template, by looser template, by plain words.
STRICT, LOOSE, EXACT = 0, 1, 2
#: Fixed lists: number words and units.
NUMBERS = "two three four five six seven eight nine ten eleven twelve hundred thousand million billion".split()
UNITS = (
    "mm cm m km mg g kg ml l liter liters litre litres meter meters metre metres mile miles inch inches foot feet yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars euro euros cent cents percent degree degrees"
).split()


def words(text: Column) -> Column:
    """Lower-case words of a text with their marks: a capitalised word has one, and another one if it follows a word of its sentence."""
    # capitals are rare, so they are looked for first, and then at what stands before
    named = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Lu}(?<=[\p{Ll}\p{Nd},;)] \p{Lu})", f"{_NAME}$0")
    marked = F.regexp_replace(named, r"\p{Lu}(?<![\p{L}\p{Nd}\x01]\p{Lu})", f"{_FIRST}$0")
    return F.split(F.trim(F.regexp_replace(F.lower(marked), r"[^\p{L}\p{Nd}\x01\x02]+", " ")), " ")


def unmarked(word: Column) -> Column:
    """A word as strict templates see it."""
    return F.replace(word, F.lit(_FIRST), F.lit(""))


def slot(word: Column) -> Column:
    """Kind of placeholder that a word becomes, null for a literal."""
    return (
        F.when(word.startswith(_NAME), "<name>")
        .when(((word >= "0") & (word < ":")) | word.isin(NUMBERS), "<number>")
        .when(word.isin(UNITS), "<unit>")
    )


def loose_slot(word: Column) -> Column:
    """The same where a capitalised word is a name anywhere."""
    return F.coalesce(slot(unmarked(word)), F.when(word.startswith(_FIRST), "<name>"))


def _entry(word: Column, loose: bool) -> Column:
    """What stands for a word in a template."""
    return F.coalesce(loose_slot(word), word) if loose else F.coalesce(slot(word), word)


def template(found: Column) -> Column:
    """Words with placeholders, as hashes; the words have no marks of beginnings."""
    return F.transform(found, lambda w: F.xxhash64(_entry(w, False)))


def loose_template(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(_entry(w, True)))


def plain(found: Column) -> Column:
    """Words without marks."""
    return F.transform(found, lambda w: F.translate(w, _NAME + _FIRST, ""))


def surface(found: Column) -> Column:
    """Plain words as hashes; a literal has the hash that it has in a template."""
    return F.transform(found, lambda w: F.xxhash64(F.replace(w, F.lit(_NAME), F.lit(""))))


def _places(found: Column, length: int) -> Column:
    """Where windows of ``length`` begin."""
    return F.when(F.size(found) >= length, F.sequence(F.lit(0), F.size(found) - length)).otherwise(F.array().cast("array<int>"))


def _key(hashes: Column, place: Column, length: int) -> Column:
    return F.xxhash64(F.slice(hashes, place + 1, F.lit(length)), F.lit(length))


def _keys(hashes: Column, length: int) -> Column:
    return let(hashes, lambda h: F.transform(_places(h, length), lambda i: _key(h, i, length)))


def _probes(marked: Column, lengths: dict[int, list[int] | None]) -> Column:
    """Keys that a text is looked up by: of all its windows, and by looser template of those that a sentence begins.

    Of windows below the usual length only those are keyed whose first word is,
    in some form, the first of one of the few items that are so short.
    """
    name = F.xxhash64(F.lit("<name>"))

    def all_keys(typed: Column, bare: Column) -> Column:
        # a word that is its own entry is a literal; so slots are not looked for again
        loose = F.transform(marked, lambda m, i: F.when(m.startswith(_FIRST) & (F.get(typed, i) == F.get(bare, i)), name).otherwise(F.get(typed, i)))
        return let(loose, lambda h: F.concat(*[x for n, firsts in lengths.items() for x in of_length(typed, bare, h, n, firsts)]))

    def of_length(typed: Column, bare: Column, h: Column, n: int, firsts: list[int] | None) -> list[Column]:
        def key(hashes: Column, i: Column, wanted: Column) -> Column:
            return F.when(wanted, _key(hashes, i, n))

        if firsts is None:
            begun = F.transform(marked, lambda m, i: key(h, i, m.startswith(_FIRST) & (i <= F.size(h) - n)))
            return [_keys(typed, n), _keys(bare, n), F.array_compact(begun)]

        def few(m: Column, i: Column) -> Column:
            """One look at a word for all three forms."""
            a, b, c = F.get(typed, i).isin(firsts), F.get(bare, i).isin(firsts), m.startswith(_FIRST)
            return F.when((a | b | c) & (i <= F.size(h) - n), F.array(key(typed, i, a), key(bare, i, b), key(h, i, c)))

        return [F.flatten(F.array_compact(F.transform(marked, few)))]

    return let(F.transform(marked, unmarked), lambda w: let(template(w), lambda typed: let(surface(w), lambda bare: all_keys(typed, bare))))


def _firsts(asked: DataFrame, length: int) -> list[int] | None:
    """Hashes of the first words of the items of a length below the usual, None where they are many."""
    if length == WINDOW:
        return None
    first = F.col("asked")[0]
    entry = F.when(F.col("kind") == STRICT, F.xxhash64(_entry(first, False))).otherwise(F.xxhash64(first))
    found = asked.where((F.col("length") == length) & (F.col("kind") != LOOSE)).select(entry.alias("first")).distinct().limit(FIRSTS + 1).collect()
    return [r["first"] for r in found] if len(found) <= FIRSTS else None


def _windows(found: Column, length: int, hashed=template) -> Column:
    """Place, key and words of each window."""

    def each(w: Column, h: Column) -> Column:
        return F.transform(
            _places(w, length),
            lambda i: F.struct(i.alias("place"), _key(h, i, length).alias("key"), F.slice(w, i + 1, F.lit(length)).alias("given")),
        )

    return let(found, lambda w: let(hashed(w), lambda h: each(w, h)))


def _sent(windows: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(windows) if small else windows


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", bare: bool = False) -> DataFrame:
    """(key, item, at, length, asked, kind, windows, wide) per window, written; an item below a window's length is one.

    Windows with enough literals are there as templates, as looser ones where a
    word begins a sentence, and all windows with a literal, or all with a word
    if ``bare``, as plain words. ``windows`` is how many the item has by
    templates or by plain words, ``wide`` by templates of either kind.
    """
    items = narrow(benchmark, item=item_col, text=text_col).distinct().select("item", words(F.col("text")).alias("words"))
    sized = items.withColumn("length", F.least(F.size("words"), F.lit(WINDOW)))
    each = sized.select(
        "item", "words", "length", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("at")
    ).select("item", "at", "length", F.slice("words", F.col("at") + 1, F.col("length")).alias("marked"))
    each = each.withColumn("asked", F.transform("marked", unmarked))

    def literals(column: str, slot_of) -> Column:
        return F.size(F.filter(column, lambda w: slot_of(w).isNull() & (w != "")))

    def of_kind(rows: DataFrame, asked: Column, kind: int, hashed) -> DataFrame:
        key = F.xxhash64(hashed(F.col("asked")), F.col("length"))
        return rows.select("item", "at", "length", asked.alias("asked"), F.lit(kind).alias("kind")).withColumn("key", key)

    enough = F.least(F.lit(LITERALS), F.col("length"))
    begins = F.exists("marked", lambda w: w.startswith(_FIRST))
    worded = each.where(F.forall("asked", lambda w: w != "") if bare else literals("asked", slot) > 0)
    keyed = (
        of_kind(each.where(literals("asked", slot) >= enough), F.col("asked"), STRICT, template)
        .unionByName(of_kind(each.where(begins & (literals("marked", loose_slot) >= enough)), F.col("marked"), LOOSE, loose_template))
        .unionByName(of_kind(worded, plain(F.col("asked")), EXACT, surface))
    )

    def places(name: str, *kinds: int) -> Column:
        return F.count_distinct(F.when(F.col("kind").isin(*kinds), F.col("at"))).alias(name)

    whole = keyed.groupBy(F.col("item").alias("whole")).agg(places("strict", STRICT), places("wide", STRICT, LOOSE), places("exact", EXACT))
    joined = keyed.join(whole, F.col("item").eqNullSafe(F.col("whole")))
    windows = F.when(F.col("kind") == EXACT, F.col("exact")).otherwise(F.col("strict")).alias("windows")
    return materialise(joined.select("key", "item", "at", "length", "asked", "kind", windows, "wide"), "windows")


def find(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", bare: bool = False,
) -> DataFrame:
    """A row per document and benchmark item found in it: id, print, item, matched, windows, exchanged.

    ``matched`` counts the item's windows on the best diagonal, at least 6 or
    all but one that it has (``windows``; its first word may be no name here
    and one there); ``exchanged`` the slot values there that
    differ. ``print`` is a hash of the text: rows with equal ids and different
    texts are different documents, equal rows give one row. Null and empty
    texts have no windows. In texts that no item is found in so,
    windows by looser templates are counted with those by strict ones, if the
    text has any window of an item, by looser template one that a sentence begins. Items that neither finds, as their windows
    have less than four literal words (or all of a shorter item) or as a name
    meets two names, are found by windows of equal words, which are counted in
    the same way. A window without any literal is no evidence unless ``bare``.
    """
    asked = benchmark_windows(benchmark, item_col, item_text_col, bare)
    lengths = sorted(r.length for r in asked.select("length").distinct().collect())  # WINDOW at most
    small = asked.count() <= SENT_WINDOWS
    texts = narrow(df, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("print"), "text")
    # which texts share a window at all: a text is split once, and only hashes are exploded and joined
    every = let(words(F.col("text")), lambda marked: _probes(marked, {n: _firsts(asked, n) for n in lengths or [WINDOW]}))
    each = texts.select("id", "print", F.explode_outer(every).alias("key"))
    touched = each.join(_sent(asked.select("key").distinct(), small), "key", "left_semi").select("id", "print").distinct()
    touched = materialise(touched, "touched").alias("touched")
    here = F.col("texts.id").eqNullSafe(F.col("touched.id")) & (F.col("texts.print") == F.col("touched.print"))
    few = texts.alias("texts").join(touched, here, "left_semi")
    found_in = materialise(few.select("id", "print", words(F.col("text")).alias("marked")), "texts").withColumn("words", F.transform("marked", unmarked))

    def meetings(kind: int, column: str, hashed, rows: DataFrame) -> DataFrame:
        met = None
        wanted = asked.where(F.col("kind") == kind)
        for length in lengths or [WINDOW]:
            # the outer form, as the plain one makes the optimizer compute the windows a second time
            each = rows.select("id", "print", F.explode_outer(_windows(F.col(column), length, hashed)).alias("w")).select("id", "print", "w.*")
            part = each.where("key IS NOT NULL").join(_sent(wanted.where(F.col("length") == length), small), "key")
            met = part if met is None else met.unionByName(part)
        return met.select("id", "print", "item", "at", (F.col("place") - F.col("at")).alias("diagonal"), "windows", "wide", "asked", "given")

    def typed(loose: bool, rows: DataFrame) -> DataFrame:
        """Windows of one template, each with the values in its slots."""
        met = meetings(LOOSE, "marked", loose_template, rows) if loose else meetings(STRICT, "words", template, rows)
        kind_of = loose_slot if loose else slot
        # different templates with one hash end here
        same = F.forall(F.zip_with("asked", "given", lambda a, b: _entry(a, loose) == _entry(b, loose)), lambda x: x)
        pair = F.zip_with("asked", "given", lambda a, b: F.struct(kind_of(a).alias("kind"), unmarked(a).alias("a"), unmarked(b).alias("b")))
        return met.where(same).select(
            "id", "print", "item", "at", "diagonal", "windows", "wide", F.filter(pair, lambda p: p["kind"].isNotNull()).alias("pairs")
        )

    def enough(windows: str) -> Column:
        return F.col("matched") >= F.greatest(F.lit(1), F.least(F.lit(WINDOWS), F.col(windows) - 1))

    def accepted(met: DataFrame, windows: str) -> DataFrame:
        along = met.groupBy("id", "print", "item", "diagonal").agg(
            F.count_distinct("at").alias("matched"),
            F.max(windows).alias("windows"),
            F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),  # an item's slots at most
        )
        told = F.filter("pairs", lambda p: p["kind"] != "<number>")
        consistent = F.size(told) == F.size(F.array_distinct(F.transform(told, lambda p: p["a"])))
        exchanged = F.size(F.filter("pairs", lambda p: p["a"] != p["b"]))
        return along.where(consistent & enough("windows")).select(
            "id", "print", "item", "matched", "windows", exchanged.alias("exchanged"), F.lit(1).alias("typed")
        )

    strict = materialise(typed(False, found_in), "strict")
    verbatim = meetings(EXACT, "words", surface, found_in).where(F.col("asked") == plain(F.col("given"))).groupBy("id", "print", "item", "diagonal").agg(
        F.count_distinct("at").alias("matched"), F.max("windows").alias("windows")
    )
    columns = ["id", "print", "item", "matched", "windows"]
    verbatim = verbatim.where(enough("windows")).select(*columns, F.lit(0).alias("exchanged"), F.lit(0).alias("typed"))
    found = materialise(accepted(strict, "windows").unionByName(verbatim), "found")
    # looser templates are for texts in which nothing has been found
    known = found.select("id", "print").distinct().alias("known")

    def rest(rows: DataFrame) -> DataFrame:
        same_text = F.col("rows.id").eqNullSafe(F.col("known.id")) & (F.col("rows.print") == F.col("known.print"))
        return rows.alias("rows").join(known, same_text, "left_anti")

    found = found.unionByName(accepted(rest(strict).unionByName(typed(True, rest(found_in))), "wide"))
    best = found.groupBy("id", "print", "item").agg(
        F.max(F.struct("typed", "matched", (-F.col("exchanged")).alias("kept"), "windows")).alias("b")  # plain words only if no template is found
    )
    return best.select(
        F.col("id").alias(id_col), "print", F.col("item").alias(item_col), F.col("b.matched").alias("matched"),
        F.col("b.windows").alias("windows"), (-F.col("b.kept")).cast("long").alias("exchanged"),
    )


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` in which no item is found, columns unchanged."""
    found = find(df, benchmark, id_col, text_col, bare=True).select(F.col(id_col).alias("id"), "print").distinct().alias("found")
    rows = df.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("print")).alias("rows")
    same = F.col("rows.id").eqNullSafe(F.col("found.id")) & (F.col("rows.print") == F.col("found.print"))
    return rows.join(found, same, "left_anti").select("row.*")
