"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence.

The patterns find e-mail addresses, IP addresses, card and phone numbers; each is a protected entity. Terms are the words
outside of such mentions. Over all documents, n(e) counts the rows that mention entity e, n(t) those that hold term t and
n(e, t) those that do both; with N rows, the disclosure of e by t is

    PMI(e; t) / IC(e) = log(n(e, t) N / (n(e) n(t))) / log(N / n(e)),

1 where every row with t mentions e. Terms at GENERALISE or more are replaced by their type, at REMOVE or more they are
removed. A pair is used if its disclosure is still GENERALISE or more with the lower Wilson bound (Z) of n(e, t) / n(t),
for which only different texts are evidence: rare entities have revealing terms, copies of one text add nothing. As the
scale of the disclosure is log N, the bound itself must also be SURE or more: else ever more words of other texts would
count as revealing as a corpus grows.
Every occurrence of a term that reveals some entity is marked, in all texts, with or without a mention.

All of it is DataFrame and SQL functions: spans are found where texts are read; counts, mentions, spans
and the texts that hold a revealing term are shuffled, and where there are more than BROADCAST revealing terms, the
distinct words of each text.

Defined results: null text counts as empty; offsets are code points, ends exclusive; spans follow from the text and
the counts, so repeated rows give repeated results; doc_id may be null or repeated; an empty table gives an empty
result; texts of any length are read whole, in time in proportion to their length; columns other than text and n_chars
pass through ``redacted`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import quoted, written

KINDS = ("email", "ip", "card", "phone")
GENERALISE, REMOVE, SURE, Z = 0.8, 0.95, 0.25, 1.645
#: Revealing terms, or spans, that may be broadcast; digests of texts (16 bytes each) that may be.
BROADCAST, KEYS = 500_000, 2_000_000
#: Possessive forms of the base patterns: they match the same spans without backtracking or recursion. A card is a
#: whole run of digits (single spaces or hyphens between them) with 13 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A character without which there is no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"\p{L}{4,}"

_SPANS = "array<struct<start: int, end: int, value: string>>"


#: Matches that are numbered together, and characters that are rewritten together: what is done to one place costs no more
#: than that, so that a text's cost is in proportion to its length.
TOGETHER, PIECE = 256, 4096


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str | Column) -> Column:
    """start, end and value of each match, leftmost first, from the matches and the gaps between them."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))

    def placed(all_: Column) -> Column:
        """A block's matches, from where the blocks before it end."""
        blocks = F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(TOGETHER))
        of = lambda k: F.slice(all_, k + 1, F.lit(TOGETHER))
        size = lambda k: F.aggregate(of(k), F.lit(0), lambda n, m: n + m["gap"] + F.coalesce(F.length(m["value"]), F.lit(0)))
        starts = F.aggregate(F.transform(blocks, size), F.array(F.lit(0)), lambda x, n: F.array_append(x, F.element_at(x, -1) + n))

        def add(state: Column, m: Column) -> Column:
            start = state["at"] + m["gap"]
            end = start + F.length(m["value"])
            return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"))).alias("out"))

        zero = lambda at: F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out"))
        return _once(starts, lambda at: F.flatten(F.transform(blocks, lambda k: F.aggregate(of(k), zero(F.get(at, F.floor(k / TOGETHER).cast("int"))), add, lambda state: state["out"]))))

    # The last gap has no match after it.
    found = _once(both, lambda x: F.when(F.size(x) > 1, F.filter(placed(x), lambda s: s["end"].isNotNull())).otherwise(F.array().cast(_SPANS)))
    return found


def rewritten(text: Column, changes: Column, to: Callable[[Column, Column], Column]) -> Column:
    """The text with something else in the places of the changes (start, end, more; sorted by start): for each, ``to`` its
    struct and where the one before it ended; what is covered twice is left out once."""

    def in_pieces(z: Column) -> Column:
        pieces, all_ = z["pieces"], z["changes"]

        def piece(state: Column, n: Column) -> Column:
            begin, own = n * PIECE, F.get(pieces, n)
            # Those that start in this piece are the next ones, and no more than it has characters for each kind.
            next_ = F.filter(F.slice(all_, state["seen"] + 1, F.lit(PIECE * (len(KINDS) + 1))), lambda s: s["start"] < begin + PIECE)

            def one(st: Column, s: Column) -> Column:
                before = F.when(s["start"] > st["at"], F.substring(own, st["at"] - begin + 1, s["start"] - st["at"])).otherwise("")
                return F.struct(F.greatest(st["at"], s["end"]).alias("at"), F.concat(st["out"], before, to(s, st["at"])).alias("out"))

            zero = F.struct(F.greatest(state["at"], begin).alias("at"), F.lit("").alias("out"))

            def whole(st: Column) -> Column:
                rest = F.when(st["at"] < begin + PIECE, F.substring(own, st["at"] - begin + 1, F.lit(PIECE))).otherwise("")
                return F.struct(st["at"].alias("at"), F.concat(st["out"], rest).alias("out"))

            return _once(next_, lambda found: _once(F.aggregate(found, zero, one, whole), lambda st: F.struct(st["at"].alias("at"), (state["seen"] + F.size(found)).alias("seen"), F.array_append(state["out"], st["out"]).alias("out"))))

        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("seen"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 1), zero, piece, lambda state: F.array_join(state["out"], ""))

    both = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), changes.alias("changes"))
    return F.when(F.size(changes) > 0, _once(both, in_pieces)).otherwise(text)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(spans(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(_SPANS)) if kind in NEEDS else found


def _small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """Marked for broadcast, if its rows (or the sum of their weights) are few enough."""
    n = df.count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST else df


def _masked(text: Column, base: Column) -> Column:
    """The text with blanks in the places of its base spans."""
    blanks = lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)))
    return rewritten(text, F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), blanks)


def _words(masked: Column) -> Column:
    """Distinct words as they are written; a term is a word in lower case."""
    return F.array_distinct(F.regexp_extract_all(masked, F.lit(TERM), F.lit(0)))


def _terms(masked: Column) -> Column:
    return F.array_distinct(F.transform(_words(masked), F.lower))


def _entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _with_spans(docs: DataFrame, *ids: str) -> DataFrame:
    """The ids, text, the spans of each kind, and masked (the text without them)."""
    rows = docs.select(*ids, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(*ids, "text", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    return rows.withColumn("masked", _masked(F.col("text"), F.concat(*KINDS)))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text), base (kind, start, end), and of documents with base spans entities and terms."""
    rows = _with_spans(docs, "doc_id")

    def of_kind(kind: str) -> tuple[Column, Column]:
        base = F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return base, F.transform(kind, lambda s: _entity(kind, s["value"]))

    base, entities = (F.concat(*parts) for parts in zip(*map(of_kind, KINDS)))
    terms = F.when(F.size(base) > 0, _terms(F.col("masked"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", _key(F.col("text")).alias("key"), base.alias("base"), F.array_distinct(entities).alias("entities"), terms.alias("terms"))


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n_t: how many rows hold each term."""
    return _with_spans(docs).select(F.explode(_terms(F.col("masked"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def _lower_bound(share: Column, n: Column) -> Column:
    """Of a share of n texts, the lower end of its one-sided Wilson interval."""
    z2 = Z * Z
    return (share + z2 / (2 * n) - Z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosures(described: DataFrame, counts: DataFrame, rows: int, every: bool = True) -> DataFrame:
    """entity, term, disclosure of the pairs that are revealing by the lower bound of their share; of entities that stand in
    the same texts only one, if not ``every``."""
    mentions = described.where(F.size("entities") > 0).groupBy("key").agg(F.count("*").alias("n"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    mentions = written(mentions, "pii-mentions")
    named = mentions.select("key", "n", F.explode("entities").alias("entity"))
    # Entities of the same texts have the same counts with every term: one stands for all of them.
    texts = [F.bit_xor(F.xxhash64("key", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)]
    entities = named.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts"), *texts).where(F.col("n_e") < rows)
    entities = written(entities, "pii-entities")
    same = ["n_e", "texts", "h1", "h2"]
    first = entities.groupBy(*same).agg(F.min("entity").alias("entity"))
    named = written(named.join(first.select("entity", "n_e"), "entity"), "pii-named")
    # A share is n_e / n_t at most: terms of too many rows go before they are paired.
    reach = named.groupBy("key").agg(F.max("n_e").alias("reach"))
    terms = mentions.select("key", F.explode("terms").alias("term")).join(reach, "key").join(counts, "term").where(F.col("n_t") * SURE <= F.col("reach"))
    pairs = terms.select("key", "term", "n_t").join(named, "key").groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("texts"), F.max("n_e").alias("n_e"), F.max("n_t").alias("n_t"))
    total = F.lit(float(rows))
    pairs = pairs.withColumn("share", F.least("n_et", "n_e", "n_t") / F.col("n_t"))
    score = lambda p: F.log(p * total / F.col("n_e")) / F.log(total / F.col("n_e"))
    bound = pairs.withColumn("bound", _lower_bound(F.col("share"), F.col("texts") / F.col("share")))
    revealing = bound.where((F.col("bound") >= SURE) & (score(F.col("bound")) >= GENERALISE)).select("entity", "term", score(F.col("share")).alias("disclosure"))
    if not every:
        return revealing
    alike = entities.join(first.withColumnRenamed("entity", "first"), same).select("entity", "first")
    return revealing.withColumnRenamed("entity", "first").join(alike, "first").select("entity", "term", "disclosure")


def occurrences(docs: DataFrame, revealing: DataFrame) -> DataFrame:
    """key, terms (start, end, action): every occurrence of a revealing term, of each text that holds one."""
    action = F.when(F.max("disclosure") >= REMOVE, "remove").otherwise("generalise")
    terms = _small(written(revealing.groupBy("term").agg(action.alias("action")), "pii-terms"))
    words = _with_spans(docs).select(_key(F.col("text")).alias("key"), F.explode(_words(F.col("masked"))).alias("word"))
    held = words.withColumn("term", F.lower("word")).join(terms, "term")
    of = lambda name: F.collect_set(F.when(F.col("action") == name, F.col("word"))).alias(name)
    held = written(held.groupBy("key").agg(F.collect_set("word").alias("words"), of("remove")), "pii-held")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", _key(F.col("text")))
    texts = texts.join(_small(held.select("key")), "key", "left_semi").dropDuplicates(["key"])
    placed = _with_spans(texts, "key").select("key", "masked").join(held, "key")

    def marked(z: Column) -> Column:
        """Words are looked up in buckets by hash, as many as keep them short, not in the whole list."""
        hit = lambda name, s: F.array_contains(F.get(z[name], _bucket(s["value"], F.size(z["words"]))), s["value"])
        done = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(hit("remove", s), "remove").otherwise("generalise").alias("action"))
        return F.transform(F.filter(z["all"], lambda s: hit("words", s)), done)

    n = F.ceil(F.sqrt(F.size("words"))).cast("int")
    dealt = lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(c, lambda w: _bucket(w, n) == b)).alias(c)
    return placed.select("key", _once(F.struct(spans(F.col("masked"), TERM).alias("all"), dealt("words"), dealt("remove")), marked).alias("terms"))


def _bucket(word: Column, n: Column) -> Column:
    return F.pmod(F.hash(word), n)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, key, base and terms (start, end, action) of every document; one row for each row of docs."""
    base = written(described(docs), "pii-base")
    terms = written(occurrences(docs, disclosures(base, term_counts(docs), base.count(), every=False)), "pii-spans")
    return base.select("doc_id", "key", "base").join(_small(terms, F.size("terms") + 1), "key", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start: int, end: int, action: string>>")))


def _written_as(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_term."""
    terms = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found(docs).select("doc_id", *[count(k) for k in KINDS], F.sha2(_written_as(F.col("base")), 256).alias("base_sha256"), _written_as(F.concat("base", terms)).alias("spans"), F.size("terms").cast("bigint").alias("n_term"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with spans replaced: pattern spans by their kind, generalised terms by [TERM], removed terms by nothing.

    Only texts with spans are joined to them; the others go round the join."""
    by_key = found(docs).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["key"])
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("to")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("to")))
    spans_ = written(by_key.select("key", F.array_sort(F.concat(base, terms)).alias("spans")), "pii-changes")
    rows = docs.select(_key(F.coalesce("text", F.lit(""))).alias("key"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    text = F.col("row.text")

    new = rewritten(text, F.col("spans"), lambda s, at: F.when(s["start"] < at, "").otherwise(s["to"]))
    kinds = dict(docs.dtypes)
    of = {"text": F.col("new"), "n_chars": F.length("new")}

    def changed(joined: DataFrame) -> DataFrame:
        there = joined.select("row", F.when(F.col("spans").isNotNull(), new).alias("new"))
        return there.select(*[F.coalesce(of[c].cast(kinds[c]), f"row.{quoted(c)}").alias(c) if c in of else F.col(f"row.{quoted(c)}") for c in docs.columns])

    if spans_.count() > KEYS:
        return changed(rows.join(spans_, "key", "left"))
    keys = F.broadcast(spans_.select("key"))
    return rows.join(keys, "key", "left_anti").select("row.*").union(changed(rows.join(keys, "key", "left_semi").join(spans_, "key")))
