"""Removal of repeated and almost repeated lines, by joining deletion variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.llm.bounded import MOST_BROADCAST, small
from revisit.llm.copies import Copies, marks, split_by_marks
from revisit.plans.durable import durable

# Lines of fewer words go only if they are equal; one word of so many characters is compared by them.
MIN_WORDS = 5
MIN_CHARS = 20
_ONE_LONG_WORD = r"\A[\x20\x09-\x0D]*+[^\x20\x09-\x0D]{%d,}+[\x20\x09-\x0D]*\z" % MIN_CHARS


def _with_units(lines: DataFrame) -> DataFrame:
    """``lines`` with their column ``line`` replaced by ``words``: what an edit changes.

    These are the line's words in lower case. A line without spaces is as many units as it has
    characters, if it is long; two empty units in front keep it apart from lines of words.
    The array is exploded from an array of one, so that filters on it do not split lines again.
    """
    others = [c for c in lines.columns if c != "line"]
    line = F.lower("line")
    words = F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")
    characters = F.regexp_extract_all(line, F.lit(r"[^\x20\x09-\x0D]"), F.lit(0))
    # Most lines have a space and are not matched; a line is split one way only.
    long_word = ~F.contains(F.trim("line"), F.lit(" ")) & line.rlike(_ONE_LONG_WORD)
    units = F.when(long_word, F.concat(F.array(F.lit(""), F.lit("")), characters)).otherwise(words)
    return lines.select(*others, F.explode(F.array(units)).alias("words"))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def _identity() -> list[Column]:
    return [F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2")]


SIDES = ("first", "last")


def _half(n: Column, less: int) -> Column:
    return F.floor((n - less) / 2).cast("int")


def _halves(side: str) -> Column:
    """Hashes of which lines within one word of each other share one, of one side or the other.

    One word is changed, left out or put in: either the words before or those after it are a half
    of the line. Lengths may differ by one, so halves of two lengths are taken.
    """
    n = F.size("words")
    found = []
    for less in (1, 2):
        a = _half(n, less)
        begin = F.lit(1) if side == "first" else n - a + 1
        found.append(F.xxhash64(F.lit(side), a, F.slice("words", begin, a)))
    return F.array_distinct(F.array(*found))


def repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """(key, line, kept_key, kept_line, exact): every line to be removed and the one that stands for it.

    Lines are what \\n separates, numbered from 0 and compared as words in lower case. A line goes if
    an earlier line, by (key, number), has the same words; of equal lines the first stays. Lines of
    ``min_words`` words or more also go if an earlier one differs by one edit (one word changed, left
    out or put in). A line that is one word of ``MIN_CHARS`` characters or more (writing without
    spaces) is compared by its characters, one of which may differ. Whether a line goes is judged on
    the input, and the kept line named is the earliest within one edit of it, or else the first that
    is equal. Lines without a word are left alone.

    Method: distinct lines that share no half with another one have no partner. The others emit
    one variant per left-out word, keyed by its hash and place, and themselves; lines meet in equal
    variants, only each key's earliest line is looked at, and its words are compared at the end. So
    no step makes pairs of all lines of a key.

    Null and empty texts have no lines to remove; a null key is before all others. Rows of equal
    keys are one place: equal lines with equal keys and numbers do not remove each other. Other
    columns are not read.
    """
    return _repeated(docs, key, text, min_words, Copies(docs.sparkSession))


def _repeated(docs: DataFrame, key: str, text: str, min_words: int, copies: Copies) -> DataFrame:
    """``repeated_lines``; ``copies`` are those that the result reads."""
    passing = Copies(docs.sparkSession)
    lines = _with_units(_lines(docs, key, text)).where("size(words) > 0")
    some = F.size("words") >= min_words
    halves = [F.when(some, _halves(side)).otherwise(F.array().cast("array<bigint>")).alias(side) for side in SIDES]
    lines = copies.keep(lines.select("doc", "pos", *_identity(), *halves), "lines")
    distinct = lines.groupBy("h1", "h2").agg(
        F.min(F.struct("doc", "pos")).alias("place"),
        F.count("*").alias("times"),
        F.first("first").alias("first"),
        F.first("last").alias("last"),
    )
    distinct = passing.keep(distinct, "distinct-lines")

    # Lines that share a half with another line, and on which side.
    sides = [
        distinct.select("h1", "h2", F.lit(side).alias("side"), F.explode(side).alias("half")) for side in SIDES
    ]
    halves = sides[0].union(sides[1])
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    near = halves.join(passing.keep(shared, "halves"), "half").groupBy("h1", "h2").agg(
        F.bool_or(F.col("side") == "first").alias("by_first"), F.bool_or(F.col("side") == "last").alias("by_last")
    )
    near = distinct.select("h1", "h2", "place").join(near, ["h1", "h2"])
    near = passing.keep(near.withColumnsRenamed({"h1": "g1", "h2": "g2"}), "near-lines")
    asked = docs.select(key, text)
    if near.count() <= MOST_BROADCAST:
        near = F.broadcast(near)
    else:  # only lines of documents that have such a line move
        named = passing.keep(marks(near.select(F.col("place.doc").alias("doc")), "doc"), "near-marks")
        asked, _ = split_by_marks(asked, key, named)
    texts = _with_units(_lines(asked, key, text).join(near, _at("doc", "pos", "place")))
    texts = texts.select(*_identity(), "g1", "g2", "place", "by_first", "by_last", "words")
    texts = texts.where("h1 = g1 AND h2 = g2").drop("g1", "g2").dropDuplicates(["h1", "h2"])
    texts = passing.keep(texts, "near-line-words")

    found = _partners(texts, passing).withColumnsRenamed({"h1": "g1", "h2": "g2"})
    same = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    decided = distinct.select("h1", "h2", "place", "times").join(found, same, "left")
    decided = decided.where("times > 1 OR partner IS NOT NULL").select(
        F.col("h1").alias("g1"), F.col("h2").alias("g2"), "place", "partner"
    )
    decided = small(copies.keep(decided, "line-decisions"))
    passing.forget()
    kept = F.coalesce("partner", "place")
    return (
        lines.select("doc", "pos", "h1", "h2")
        .join(decided, same)
        .where(F.col("partner").isNotNull() | ~_at("doc", "pos", "place"))
        .select(
            F.col("doc").alias(key),
            F.col("pos").alias("line"),
            kept["doc"].alias(f"kept_{key}"),
            kept["pos"].alias("kept_line"),
            F.col("partner").isNull().alias("exact"),
        )
    )


def _at(doc: str, pos: str, place: str) -> Column:
    return F.col(doc).eqNullSafe(F.col(f"{place}.doc")) & (F.col(pos) == F.col(f"{place}.pos"))


def _variants(texts: DataFrame) -> DataFrame:
    """(v0, v1, p, doc, pos): hashes of each line without word p, and of the line itself as p = -1.

    A line's hash is the exclusive or over words of a hash of place and word. Without word p, the
    words before it keep their places and those behind it move up by one. A line that shares halves
    of one side only differs from its partners in the other half.
    """
    word = texts.select(
        "place.doc", "place.pos", F.size("words").alias("n"), "by_first", "by_last",
        F.posexplode("words").alias("i", "word"),
    )
    names = ["doc", "pos", "n", "by_first", "by_last", "i"]
    hashes = word.select(
        *names,
        *[F.xxhash64(F.lit(salt), "i", "word").alias(f"s{k}") for k, salt in enumerate((3, 5))],
        *[F.xxhash64(F.lit(salt), F.col("i") - 1, "word").alias(f"m{k}") for k, salt in enumerate((3, 5))],
    )
    whole = Window.partitionBy("doc", "pos")
    before = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)

    def key(column: Column, k: int) -> Column:
        return (column if k == 0 else column.bitwiseAND(0x7FFFFFFF).cast("int")).alias(f"v{k}")

    def rest(k: int) -> Column:
        moved = F.bit_xor(f"m{k}").over(whole).bitwiseXOR(F.bit_xor(f"m{k}").over(upto))
        return F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0)).bitwiseXOR(moved)

    left_out = hashes.select(*names, key(rest(0), 0), key(rest(1), 1))
    a = _half(F.col("n"), 2)
    in_first, in_last = F.col("i") < F.col("n") - a, F.col("i") >= a
    wanted = (F.col("by_last") & in_first) | (F.col("by_first") & in_last)
    left_out = left_out.where(wanted).select("v0", "v1", F.col("i").alias("p"), "doc", "pos")
    itself = hashes.groupBy("doc", "pos").agg(key(F.bit_xor("s0"), 0), key(F.bit_xor("s1"), 1))
    return left_out.union(itself.select("v0", "v1", F.lit(-1).alias("p"), "doc", "pos"))


def _partners(texts: DataFrame, copies: Copies) -> DataFrame:
    """(h1, h2, partner): the earliest line within one edit of each line, where it is earlier."""
    variants = copies.keep(_variants(texts), "line-variants")
    met = variants.groupBy("v0", "v1").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    variants = copies.keep(variants.join(copies.keep(met, "equal-variants"), ["v0", "v1"]), "met-variants")

    # The earliest line of a variant: with the same word left out, or one word shorter or longer.
    own = F.struct("doc", "pos", "p")
    changed = variants.where("p >= 0").groupBy("v0", "v1", "p").agg(F.min(own).alias("other"), F.count("*").alias("n"))
    changed = copies.keep(changed.where("n > 1").drop("n"), "changed-words")
    lengths = variants.groupBy("v0", "v1").agg(
        F.min(F.when(F.col("p") < 0, own)).alias("shorter"), F.min(F.when(F.col("p") >= 0, own)).alias("longer")
    )
    lengths = copies.keep(lengths.where("shorter IS NOT NULL AND longer IS NOT NULL"), "left-out-words")
    other = F.when(F.col("p") < 0, F.col("longer")).otherwise(F.col("shorter")).alias("other")
    pairs = variants.join(changed, ["v0", "v1", "p"]).select("doc", "pos", "p", "other").union(
        variants.join(lengths, ["v0", "v1"]).select("doc", "pos", "p", other)
    )
    near = F.struct("other.doc", "other.pos", "p", F.col("other.p").alias("q"))
    earlier = pairs.where(F.struct("other.doc", "other.pos") < F.struct("doc", "pos"))
    earliest = earlier.groupBy("doc", "pos").agg(F.min(near).alias("near"))

    # Both lines' words, without the words left out, must be the same.
    mine = texts.select("h1", "h2", "place", "words").join(earliest, _at("doc", "pos", "place"))
    theirs = texts.select(F.col("place").alias("there"), F.col("words").alias("other_words"))

    def without(words: str, p: Column) -> Column:
        cut = F.concat(F.slice(words, F.lit(1), F.greatest(p, F.lit(0))), F.slice(words, p + 2, F.size(words)))
        return F.when(p < 0, F.col(words)).otherwise(cut)

    equal = without("words", F.col("near.p")) == without("other_words", F.col("near.q"))
    return mine.join(theirs, _at("near.doc", "near.pos", "there")).where(equal).select(
        "h1", "h2", F.struct("near.doc", "near.pos").alias("partner")
    )


def without_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``docs`` with the remaining lines as their text, and ``length`` (if there) as its length.

    All rows stay, a text that loses all its lines is empty; null texts stay null.
    """
    copies = Copies(docs.sparkSession)
    gone = _repeated(docs.select(key, text), key, text, min_words, copies)
    gone = gone.groupBy(F.col(key).alias("cut key")).agg(F.collect_set("line").alias("cut lines"))
    gone = durable(gone, "cut-lines")
    copies.forget()
    # Documents that lose no line stay where they are; the others meet their lines by key.
    touched, whole = split_by_marks(docs, key, durable(marks(gone, "cut key"), "cut-marks"))
    split = touched.join(gone.hint("merge"), touched[key].eqNullSafe(gone["cut key"]), "left").select(
        touched["*"], "cut lines", F.split(touched[text], "\n").alias("all lines")
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("all lines") - 1), "cut lines")
    rest = F.array_join(F.transform(stay, lambda i: F.get("all lines", i)), "\n")
    cut = F.col("cut lines").isNotNull()
    joined = split.select("*", F.when(cut, rest).otherwise(split[text]).alias("new text"))
    made = {text: F.col("new text").alias(text)}
    if length in docs.columns:
        kind = docs.schema[length].dataType
        new = F.length("new text").cast(kind)
        made[length] = F.when(cut, new).otherwise(joined[length]).alias(length)
    return joined.select(*[made.get(c, joined[c]) for c in docs.columns]).union(whole)
