"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words, not in capitals altogether, inside a sentence) and units after numbers become typed
placeholders, one for a name of several words and one for a number with its unit; case, punctuation and white space are
evened out. Items and documents meet by a hash join of windows of WINDOW template
words: all windows of an item against every STRIDE-th of a document, so that any passage of WINDOW + STRIDE - 1 words
meets. For each meeting the two templates are laid over each other. A document holds an item if at least COVERAGE
percent of the item's words agree in one lay, or one to one in runs of WINDOW words of neighbouring lays (where words
were inserted or left out), and the slots are consistent: each value of the item's slots stands for one value of the
document's, which catches questions whose numbers or names were changed, and leaves alone texts that only share a form.

All of it is DataFrame and SQL functions. Item windows are broadcast only where their counted number allows it.

Defined results: null and empty texts have no windows; items of fewer than WINDOW + STRIDE - 1 words, and windows of
fewer than LITERALS words beside placeholders, are not looked for; each pair of a document row and an item gives one
row, of the lay with most agreement (ties: consistent, verbatim, then the later one) or of the chain of lays if only
that one suffices; repeated rows give repeated
results; items with a null id or text take no part; other columns pass through ``clean`` untouched; texts of any length
are read whole, in time in proportion to their length and the lays found in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import quoted, written

WINDOW, STRIDE, LITERALS, COVERAGE = 6, 3, 3, 50
#: Rows of two numbers that may be broadcast: 64 MB at most.
BROADCAST = 2_000_000
#: Units of measure that follow numbers.
UNITS = "km|cm|mm|kg|mg|lbs?|oz|mph|kmh|ml|litres?|liters?|grams?|metres?|meters?|miles?|feet|inch(?:es)?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|percent|dollars?|euros?|cents?"


#: A number with its separators; possessive, as other loops of a group recurse once for each turn.
NUMBER = r"[0-9]++(?:[.,:/-][0-9]++)*+"
#: Between the words that are one.
JOINT = "\x01"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def spaced(text: Column) -> Column:
    """Single spaces; the words of a name, and a number and its unit, are joined by JOINT to one word. Patterns begin with
    the space, so that what is around it is looked at only there."""
    x = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\s{JOINT}]+", " "))
    x = F.regexp_replace(x, r" (?=\p{Lu}\p{Ll})(?<=[^ .!?:] \p{Lu}\p{Ll}{1,30} )", JOINT)
    return F.regexp_replace(x, rf" (?<=[0-9] )(?=(?:{UNITS})(?!\p{{L}}))", JOINT)


def template(text: Column) -> Column:
    """Of an evened text, its words in the same places: literals in lower case, placeholders <name>, <num>, <unit>."""
    x = F.regexp_replace(text, r"(?<=[^ .!?:] )\p{Lu}\p{Ll}\S*", "<name>")
    x = F.regexp_replace(x, NUMBER, "<num>")
    x = F.regexp_replace(x, rf"<num>{JOINT}?(?:{UNITS})(?![\p{{L}}])", "<num><unit>")
    return F.split(F.regexp_replace(F.lower(x), r"[^\p{L}<> ]", ""), " ")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _windows(words: str, stride: int) -> Column:
    """at, h of the windows of an array column."""
    last = F.size(words) - WINDOW
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h")))


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """key (digest of the text), item_id, coverage (percent), kind ('verbatim' or 're-parameterised')."""
    texts = docs.where("text IS NOT NULL").select("text")
    own = items.where("item_id IS NOT NULL").select("item_id", spaced(F.col("text")).alias("text"))
    own = own.select("item_id", F.split("text", " ").alias("raw_i"), template(F.col("text")).alias("words_i")).where(F.size("words_i") >= WINDOW + STRIDE - 1)
    own = written(own, "decontam-items")
    placed = own.select("item_id", "words_i", F.inline(_windows("words_i", 1)))
    literal = F.size(F.filter(F.slice("words_i", F.col("at") + 1, F.lit(WINDOW)), lambda w: ~F.startswith(w, F.lit("<"))))
    windows = placed.where(literal >= LITERALS).select("h", "item_id", F.col("at").alias("at_i"))

    in_docs = texts.select(_key(F.col("text")).alias("key"), template(spaced(F.col("text"))).alias("words")).select("key", F.inline(_windows("words", STRIDE)))
    # Written, as it is read twice: the windows of all texts are made once.
    lays = written(in_docs.join(_small(windows), "h").select("key", "item_id", (F.col("at") - F.col("at_i")).alias("shift")).distinct(), "decontam-lays")

    keyed = texts.withColumn("key", _key(F.col("text")))
    met = keyed.join(_small(lays.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"]).select("key", spaced(F.col("text")).alias("text")).select("key", F.split("text", " ").alias("raw"), template(F.col("text")).alias("words"))
    # Written, as in a join they would be worked out anew for each lay.
    met = written(met, "decontam-met")
    # Of a text, a lay takes only the words that it covers.
    sized = lays.join(own.select("item_id", F.size("words_i").alias("n")).groupBy("item_id").agg(F.max("n").alias("n")), "item_id")
    from_ = F.greatest(F.col("shift"), F.lit(0))
    covered = lambda c: F.slice(c, from_ + 1, F.greatest(F.col("n") + F.col("shift") - from_, F.lit(0))).alias(c)
    both = sized.join(met, "key").select("key", "item_id", "shift", (F.col("shift") - from_).alias("off"), covered("raw"), covered("words")).join(own, "item_id")
    place = F.sequence(F.lit(0), F.size("words_i") - 1)
    equal = F.transform(place, lambda p: F.coalesce(F.get("words", p + F.col("off")) == F.get("words_i", p), F.lit(False)))
    laid = both.select("key", "item_id", "shift", "off", "raw", "raw_i", "words_i", F.size("words_i").alias("n"), equal.alias("equal"))
    in_run = lambda p: F.exists(F.sequence(p - (WINDOW - 1), p), lambda s: F.forall(F.sequence(s, s + (WINDOW - 1)), lambda t: (t >= 0) & F.coalesce(F.get("equal", t), F.lit(False))))

    def cell(p: Column) -> Column:
        slot = F.contains(F.get("words_i", p), F.lit("<"))
        value = lambda raw: F.when(slot, _value(raw))
        return F.struct(p.alias("p"), (p + F.col("shift")).alias("q"), in_run(p).alias("run"), value(F.get("raw_i", p)).alias("i"), value(F.get("raw", p + F.col("off"))).alias("d"))

    agree = F.filter(place, lambda p: F.get("equal", p))
    cells = laid.select("key", "item_id", "shift", "n", F.transform(agree, cell).alias("cells"))
    one = cells.select("key", "item_id", "shift", "n", "cells", *_judged(F.col("cells"), F.size("cells")))
    best = F.max(F.struct("coverage", "consistent", "verbatim", "shift"))
    lays_of = one.groupBy("key", "item_id").agg(best.alias("b"), F.first("n").alias("n"), F.collect_list(F.struct("shift", "cells")).alias("lays"))
    near = F.filter("lays", lambda x: F.abs(x["shift"] - F.col("b.shift")) * 2 <= F.col("n"))
    chain = F.array_distinct(F.filter(F.flatten(F.transform(near, lambda x: x["cells"])), lambda c: c["run"]))
    chained = lays_of.select("key", "item_id", "b", "n", chain.alias("cells"))
    size = F.least(F.size(F.array_distinct(F.transform("cells", lambda c: c["p"]))), F.size(F.array_distinct(F.transform("cells", lambda c: c["q"]))))
    enough = lambda b: (F.col(f"{b}.coverage") >= COVERAGE) & F.col(f"{b}.consistent")
    chained = chained.select("key", "item_id", "b", F.struct(*_judged(F.col("cells"), size)).alias("c"))
    won = F.when(enough("b"), F.struct("b.coverage", "b.verbatim")).when(enough("c"), F.struct("c.coverage", "c.verbatim"))
    found = chained.select("key", "item_id", won.alias("w")).where("w IS NOT NULL")
    return found.select("key", "item_id", F.round("w.coverage", 2).alias("coverage"), F.when(F.col("w.verbatim"), "verbatim").otherwise("re-parameterised").alias("kind"))


def _judged(cells: Column, size: Column) -> list[Column]:
    """coverage, consistent, verbatim of agreeing words, with the item's size in n."""
    slots = F.transform(F.filter(cells, lambda c: c["i"].isNotNull()), lambda c: F.struct(c["i"].alias("i"), c["d"].alias("d")))
    consistent = F.size(F.array_distinct(slots)) == F.size(F.array_distinct(F.transform(slots, lambda s: s["i"])))
    return [(size * 100.0 / F.col("n")).alias("coverage"), consistent.alias("consistent"), F.forall(slots, lambda s: s["i"] == s["d"]).alias("verbatim")]


def _value(raw: Column) -> Column:
    """A slot's value without the punctuation around it: the number without its unit, the last word of a name."""
    bare = F.regexp_replace(raw, r"^[^\p{L}0-9]++|(?<![^\p{L}0-9])[^\p{L}0-9]++$", "")
    return F.when(bare.rlike("^[0-9]"), F.regexp_extract(bare, "^" + NUMBER, 0)).otherwise(F.substring_index(bare, JOINT, -1))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, kind: a row for each document row and item that it holds."""
    keys = docs.select("doc_id", _key(F.col("text")).alias("key"))
    return keys.join(found(docs, items), "key").select("doc_id", "item_id", "coverage", "kind")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    held = written(found(docs, items).select("key").distinct(), "decontam-held")
    rows = docs.select(_key(F.col("text")).alias("key"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    return rows.join(_small(held), "key", "left_anti").select("row.*")
